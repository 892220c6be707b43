"""Wording rules of provisions and instructions, for use inside Arrow functions. No Spark here."""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass

from chronofold.core import likeness

# ---- fixed values: the vocabulary of Norwegian statutes and gazettes ----

ORDINALS = {"første": 1, "andre": 2, "annet": 2, "tredje": 3, "fjerde": 4, "femte": 5, "sjette": 6, "syvende": 7, "sjuende": 7, "åttende": 8, "niende": 9, "tiende": 10, "ellevte": 11, "tolvte": 12}
LAST = -1
MONTHS = {
    "januar": 1, "jan": 1, "februar": 2, "feb": 2, "mars": 3, "mar": 3, "april": 4, "apr": 4, "mai": 5, "juni": 6, "jun": 6, "juli": 7, "jul": 7,
    "august": 8, "aug": 8, "september": 9, "sept": 9, "sep": 9, "oktober": 10, "okt": 10, "november": 11, "nov": 11, "desember": 12, "des": 12,
}
#: Months as provenance notes and running headers shorten them.
SHORT_MONTHS = ("jan", "feb", "mars", "apr", "mai", "juni", "juli", "aug", "sep", "sept", "okt", "nov", "des")
PROVENANCE_VERBS = ("Endret", "Endra", "Endres", "Endrast", "Tilføyd", "Tilføygd", "Tilfoyd", "Tilfoygd", "Opphevet", "Oppheva")
#: Letters that OCR puts for others in Norwegian text, and what they stand for.
OCR_FROM, OCR_TO = "öÖäÄüÜïÏëË", "oOaAuUiIeE"

#: Ordinals that OCR splits, and what they are.
SPLIT_WORDS = {"anne t": "annet", "førs te": "første", "tredj e": "tredje", "fjerd e": "fjerde", "femt e": "femte"}
#: Words for the units below a provision, and the letters that an id can end with.
UNITS, LETTERS = frozenset(("ledd", "punktum", "bokstav", "nr")), tuple("abcdefghijklmnopqrstuvwxyzæøå")
NORWEGIAN = "abcdefghijklmnopqrstuvwxyz0123456789æøå"

# ---- end of fixed values ----

_OTHER = re.compile(f"[^{NORWEGIAN}]+")


def names_part(instruction: str) -> bool:
    """Whether a unit below the provision is named as a word of its own."""
    return not UNITS.isdisjoint(re.findall(r"\w+", instruction))


def is_clean_id(para: str) -> bool:
    """Whether an id is ``§`` and one or two numbers with a dash between, each with a letter at most."""
    numbers = para[1:].split("-")
    bare = (n[:-1] if n[-1:] in LETTERS else n for n in numbers)
    return para.startswith("§") and len(numbers) <= 2 and all(n.isdecimal() for n in bare)


def heading_end(text: str) -> int:
    """Behind a provision's number at the text's start with what belongs to it, 0 without one.

    A letter belongs to it where it follows at once, or at a distance where it has a full stop.
    """

    def run(at: int, fits) -> int:
        while at < len(text) and fits(text[at]):
            at += 1
        return at

    at = run(0, str.isspace)
    if not text.startswith("§", at):
        return 0
    first = run(at + 1, str.isspace)
    end = run(first, str.isdecimal)
    if end == first:
        return 0
    if text.startswith("-", end) and (more := run(end + 1, str.isdecimal)) > end + 1:
        end = more
    small = lambda k: text[k : k + 1].isascii() and text[k : k + 1].islower()
    apart = run(end, str.isspace)
    if small(apart) and text.startswith(".", apart + 1):
        return run(apart + 2, str.isspace)
    end += small(end)
    return run(end + text.startswith(".", end), str.isspace)


def squeeze(text: str) -> str:
    return " ".join(text.split())


def _ends_word(text: str, at: int) -> bool:
    return not (text[at : at + 1].isalnum() or text.startswith("_", at))


def history_start(text: str) -> int:
    """Where a provision's amendment history begins: a capitalised verb before ``ved``, or a note of force or of a law."""
    found = [at for at in (text.find("Denne lov trer i kraft"),) if at >= 0]
    for verb in PROVENANCE_VERBS:
        at = text.find(verb)
        while at >= 0:
            rest = text[at + len(verb) :]
            by = rest.lstrip()
            if by != rest and by.startswith("ved") and _ends_word(by, 3) and (at == 0 or _ends_word(text, at - 1)):
                found.append(at)
                break
            at = text.find(verb, at + 1)
    at = text.find("Lov nr.")
    while at >= 0:
        number = text[at + 7 :].lstrip()
        n = len(number) - len(number.lstrip("0123456789"))
        if n and _ends_word(number, n) and (at == 0 or _ends_word(text, at - 1)):
            found.append(at)
            break
        at = text.find("Lov nr.", at + 1)
    return min(found, default=len(text))


def without_brackets(text: str) -> str:
    """Brackets that say when something is in force, ``(ikr. ...)`` or ``(i kraft ...)``, as one blank each."""
    at = text.find("(")
    while at >= 0:
        own = text[at + 1 :].lstrip()
        close = text.find(")", at)
        word = own[1:].removeprefix(".").lstrip() if own[:1] == "i" else ""
        short = word.startswith("kr") and _ends_word(word, 2)
        long = own[:1] == "i" and own[1:2].isspace() and word.startswith("kraft") and _ends_word(word, 5)
        if close >= 0 and (short or long):
            kept = text[:at].rstrip()
            text, at = f"{kept} {text[close + 1 :]}", len(kept)
        at = text.find("(", at + 1)
    return text


#: How far the parts of a footnote may stand apart.
REACH = 40


def without_footnotes(text: str) -> str:
    """Footnotes ``1 1 Fra <date> iflg. res. <date> nr. 672.`` with the numbers before them, as one blank each."""
    at = text.find("Fra")
    while at >= 0:
        marks = text[:at]
        while (bare := marks.rstrip()) != marks and bare[-1:].isdecimal():
            before = bare.rstrip("0123456789")
            if before and not _ends_word(before, len(before) - 1):
                break
            marks = before
        end = _footnote_end(text, at + 3) if len(marks) < at and _ends_word(text, at + 3) else -1
        if end >= 0:
            text = f"{marks.rstrip()} {text[end:]}"
            at = len(marks.rstrip())
        at = text.find("Fra", at + 1)
    return text


def _footnote_end(text: str, at: int) -> int:
    for _ in range(2):  # by what it was resolved, then its number
        line = text.find("\n", at)
        reach = min(at + REACH, line if line >= 0 else len(text))
        for start in range(at, reach + 1):
            after = text[start + 4 :].removeprefix(".").lstrip() if not _ and text.startswith("iflg", start) else ""
            if after.startswith("res."):
                at = len(text) - len(after) + 4
                break
            number = text[start + 3 :].lstrip() if _ and text.startswith("nr.", start) else ""
            if number[:1].isdecimal():
                tail = number.lstrip("0123456789").lstrip()
                return len(text) - len(tail.removeprefix(".")) if tail.startswith(".") else len(text) - len(tail)
        else:
            return -1
    return -1


def without_provenance(text: str) -> str:
    """A provision without its amendment history: cut where that begins, in-force notes taken out in place."""
    text = text[: history_start(text)]
    text = without_brackets(text) if "(" in text else text
    return without_footnotes(text) if "iflg" in text else text


def canonical(text: str) -> str:
    """The form in which provisions are compared: no history, lower case, Norwegian letters and digits, single blanks."""
    return _OTHER.sub(" ", without_provenance(text).lower()).strip()


def ratio(a: str, b: str, autojunk: bool = False, least: float = 0.0) -> float:
    """Ratcliff-Obershelp similarity, first argument first (it is not symmetric). Two empty texts are alike, one is not.

    A ratio below ``least`` may come out as any value below it. With ``autojunk`` it is the library's with its junk rule.
    """
    if not a or not b:
        return float(a == b)
    if autojunk:
        return difflib.SequenceMatcher(None, a, b, autojunk=True).ratio()
    if a in b or b in a:  # the longest block is the shorter text, and nothing is left of it
        return 2.0 * min(len(a), len(b)) / (len(a) + len(b))
    return likeness.ratio(a, b, least)


def similarity(a: str | None, b: str | None) -> float:
    return ratio(canonical(a or ""), canonical(b or ""))


def body_of(text: str) -> str:
    """A whole-provision text without its heading number, blanks squeezed."""
    return squeeze(text[heading_end(text) :])


def best_first(text: str, candidates: list[str]) -> tuple[int | None, float]:
    """The first of the most similar candidates that is similar at all, and its similarity."""
    scored = [similarity(text, c) for c in candidates]
    top = max(scored, default=0.0)
    return (scored.index(top), top) if top > 0 else (None, 0.0)


@dataclass(frozen=True)
class Target:
    """The unit that a replacement is most like; of equals the last."""

    index: int | None
    score: float
    second: float

    MARGIN, SAME = 0.25, 0.999

    @property
    def clear(self) -> bool:
        return self.index is not None and self.score - self.second >= self.MARGIN

    @property
    def there_already(self) -> bool:
        return self.index is not None and self.score >= self.SAME


def target_of(units: list[str], text: str) -> Target:
    ranked = sorted(((similarity(text, u), k) for k, u in enumerate(units)), reverse=True)
    if not ranked:
        return Target(None, 0.0, 0.0)
    return Target(ranked[0][1], ranked[0][0], ranked[1][0] if len(ranked) > 1 else 0.0)


def squeezed_with_places(text: str) -> tuple[str, list[int]]:
    """The text with single blanks and none around it, and for each of its characters the place in the text."""
    out, places = [], []
    for word in re.finditer(r"\S+", text):
        if out:
            out.append(" ")
            places.append(gap)
        out.append(word.group())
        places.extend(range(word.start(), word.end()))
        gap = word.end()  # a run of white space stands where it begins
    return "".join(out), places
