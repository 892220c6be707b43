"""A gazette issue's table of contents, act headings and the place where a law's text ends, by scanning words. No Spark here."""

from __future__ import annotations

from collections.abc import Iterator

from chronofold.core import scan
from chronofold.core.acts import ends
from chronofold.core.wording import squeeze

#: Titles that an act's heading goes on with (fixed values).
LAW_TITLES = ("om", "um")


def numbered(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, number) of ``Lov nr. 7`` wherever it stands, in any case."""
    low = scan.lowered(text)
    for start, said in scan.phrases(low, "lov", "nr"):
        number = scan.blanks(text, scan.dot(text, said))
        end = scan.digits(text, number)
        if end > number:
            yield start, end, int(text[number:end])


def _back(text: str, at: int, part) -> int:
    """The start of the run of characters of a kind that ends at a place."""
    while at > 0 and part(text[at - 1]):
        at -= 1
    return at


def day_before(text: str, at: int) -> tuple[int, int, int] | None:
    """(start, month, day) of ``mai 3.`` before a place."""
    stop = _back(text, at, str.isspace)
    if text[stop - 1 : stop] != ".":
        return None
    day = _back(text, stop - 1, str.isdecimal)
    end = _back(text, day, str.isspace)
    end -= text[end - 1 : end] == "."
    word = _back(text, end, str.isalpha)
    month = scan.month_of(text[word:end])
    return (word, month, int(text[day : stop - 1])) if 0 < stop - 1 - day <= 2 and month else None


def line_end(text: str, at: int) -> int:
    end = text.find("\n", at)
    return len(text) if end < 0 else end


def entries(contents: str) -> list[tuple[int, int, int, str]]:
    """(number, month, day, rest of the line) of the acts that a table of contents lists by date; before ``Innhold`` nothing counts."""
    text = contents[max(contents.find("Innhold"), 0) :]
    out, behind = [], 0
    for start, end, number in numbered(text):
        dated = day_before(text, start)
        if dated and dated[0] >= behind:
            behind = line_end(text, end)
            out.append((number, *dated[1:], text[end:behind].strip()))
    return out


def chosen_heads(text: str, numbers: list[int]) -> list[tuple[int, int, int]]:
    """(number, start, end) of acts' bodies: a number's first heading behind the one chosen before; headings fill their line."""
    places: dict[int, list[int]] = {}
    for start, end, number in numbered(text):
        stop = line_end(text, end)
        if stop < len(text) and text.startswith("Lov", start) and not text[end:stop].strip():
            places.setdefault(number, []).append(start)
    picked: list[tuple[int, int]] = []
    for number in sorted(set(numbers)):
        after = next((p for p in places.get(number, []) if not picked or p > picked[-1][1]), None)
        if after is not None:
            picked.append((number, after))
    stops = ends([start for _, start in picked], len(text))
    return [(number, start, stop) for (number, start), stop in zip(picked, stops, strict=True)]


def bleeds(text: str, start: int, end: int, number: int) -> bool:
    """Whether a body holds a heading of the act with this number."""
    return bool(chosen_heads(text[start:end], [number]))


def next_act(text: str, start: int) -> int:
    """Where the next act begins: a line ``3. mai Lov nr. 7`` (its day may be missing), then perhaps a page number, then ``Lov om``."""
    for at, end, _ in numbered(text):
        if at < start:
            continue
        word_end = _back(text, at, str.isspace)
        word_end -= text[word_end - 1 : word_end] == "."
        word = _back(text, word_end, str.isalpha)
        begin = _back(text, word, lambda c: c.isdecimal() or c in ". ")
        line = text.rfind("\n", 0, begin) + 1
        day = text[begin:word].strip().removesuffix(".")
        stop = line_end(text, end)
        fits = scan.month_of(text[word:word_end]) and (not day or (day.isdecimal() and len(day) <= 2)) and not text[line:begin].strip() and not text[end:stop].strip()
        if not fits or line < start or stop == len(text):
            continue
        title = scan.blanks(text, stop)
        page = scan.digits(text, title, 2)
        if page > title and not text[page : line_end(text, page)].strip():
            title = scan.blanks(text, page)
        low = text[title : title + 80].lower()
        if any((told := scan.phrase(low, 0, "lov", word)) >= 0 and scan.is_word(low, told - len(word), told) for word in LAW_TITLES):
            return line
    return len(text)


def law_text(text: str, needle: str, end_needle: str | None = None) -> str | None:
    """A law from its title on, to the end of an end phrase or to the next act; neither counts within the first 50 characters."""
    at = text.find(needle)
    if at < 0:
        return None
    rest = text[at:]
    stop = rest.find(end_needle, 50) if end_needle else -1
    return rest[: stop + len(end_needle)] if stop >= 0 else rest[: next_act(rest, 50)]


def sliced(text: str, marks: list[tuple[str, int]]) -> list[tuple[str, str, bool, bool]]:
    """(id, body, verbatim, heading fits) of provisions that begin on given lines, counted from 1 and rising.

    The body is the lines to the next mark without the heading's number, white space squeezed.
    """
    lines = text.split("\n")
    whole = squeeze(text)
    out = []
    for k, (para, line) in enumerate(marks):
        stop = marks[k + 1][1] - 1 if k + 1 < len(marks) else len(lines)
        part = "\n".join(lines[line - 1 : stop])
        begin = scan.blanks(part, 0)
        after = scan.reference(part, begin)
        body = squeeze(part[scan.blanks(part, scan.dot(part, after)) :] if after >= 0 else part)
        number = para.lstrip("§").rstrip("abcdefghijklmnopqrstuvwxyz")
        head = "".join((lines[line - 1] if line <= len(lines) else "").split())
        out.append((para, body, body in whole, "".join(number.split()) in head))
    return out
