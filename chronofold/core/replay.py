"""The fold of one provision's operations in order. No Spark here."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from chronofold.core.subdoc import edit
from chronofold.core.wording import body_of, is_clean_id, names_part


@dataclass
class Replay:
    """A provision's text (null: absent), what could not be applied, and its versions."""

    text: str | None = None
    flags: list[tuple[str, int]] = field(default_factory=list)  # why, place of the operation
    versions: list[tuple[str, str | None, int]] = field(default_factory=list)  # date, text, place of the operation


def outcome(text: str | None, para: str | None, change_type: str | None, instruction: str | None, payload: str | None) -> tuple[str | None, str | None]:
    """(text after the operation, why it was not applied: null if it was, empty for an operation without a type).

    A whole-provision repeal removes; a payload that opens with its own ``§`` heading overwrites, whatever the change
    is called, unless only the heading changes; other payloads edit below the provision, or begin an absent one.
    """
    said = instruction or ""
    part = names_part(said)
    if change_type == "repeal" and para:
        if not part:
            return None, None
        changed = edit(text or "", said, payload)
        return (text, "repeal-subunit") if changed is None else (changed, None)
    heading = "overskrift" in said
    if para and payload and not heading and payload.lstrip().startswith("§"):
        return body_of(payload), None
    if change_type in ("add", "change") and para and payload:
        if heading:
            return text, None
        changed = edit(text or "", said, payload)
        if changed is not None:
            return changed, None
        if text is None and not part and is_clean_id(para):
            return body_of(payload), None
    return text, change_type or ""


def outcome_by_kind(text: str | None, kind: str | None, instruction: str | None, payload: str | None) -> tuple[str | None, str | None]:
    """The same for operations that are typed by ``kind``: replacements overwrite with their payload as it is."""
    if kind in ("replace", "add") and payload:
        return payload, None
    if kind == "repeal":
        return None, None
    if kind == "subprovision":
        changed = edit(text or "", instruction, payload)
        return (text, kind) if changed is None else (changed, None)
    return text, kind or ""


def replay(base: str | None, para: str | None, ops: Iterable[tuple[str | None, str | None, str | None, str | None]], by_kind: bool = False) -> Replay:
    """Folds operations (date, change type or kind, instruction, payload), already in order, over a base text.

    An operation without a provision can only be reported.
    """
    out = Replay(base)
    for k, (date, change, instruction, payload) in enumerate(ops):
        if by_kind:
            text, why = outcome_by_kind(out.text, change, instruction, payload)
        else:
            text, why = outcome(out.text, para, change, instruction, payload)
        if why is not None:
            out.flags.append((why, k))
        if text != out.text:
            out.versions.append((date or "", text, k))
        out.text = text
    return out
