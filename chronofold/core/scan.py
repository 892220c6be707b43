"""A cursor's moves over text: blanks, words, digits, references and dates. What sources word is put together from these."""

from __future__ import annotations

from collections.abc import Iterator

from chronofold.core.wording import MONTHS


def blanks(text: str, at: int) -> int:
    """Behind the white space at a place."""
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def digits(text: str, at: int, most: int = 1 << 30) -> int:
    end = at
    while end < len(text) and end - at < most and text[end].isdecimal():
        end += 1
    return end


def letters(text: str, at: int) -> int:
    """Behind the word characters at a place."""
    while at < len(text) and (text[at].isalnum() or text[at] == "_"):
        at += 1
    return at


def dot(text: str, at: int) -> int:
    return at + text.startswith(".", at)


def is_word(text: str, start: int, end: int) -> bool:
    """Whether no word goes on beyond either end."""
    part = lambda k: 0 <= k < len(text) and (text[k].isalnum() or text[k] == "_")
    return not part(start - 1) and not part(end)


def phrase(text: str, at: int, *words: str) -> int:
    """Behind words with white space between them that stand at a place, else -1; as they are written."""
    for k, word in enumerate(words):
        begin = blanks(text, at) if k else at
        if (k and begin == at) or not text.startswith(word, begin):
            return -1
        at = begin + len(word)
    return at


def phrases(text: str, *words: str, start: int = 0) -> Iterator[tuple[int, int]]:
    """(start, end) of a phrase wherever it stands."""
    at = text.find(words[0], start)
    while at >= 0:
        end = phrase(text, at, *words)
        if end >= 0:
            yield at, end
        at = text.find(words[0], at + 1)


def words_of(text: str) -> Iterator[tuple[int, int, str]]:
    at = 0
    while at < len(text):
        end = letters(text, at)
        if end > at:
            yield at, end, text[at:end]
        at = max(end, at + 1)


def reference(text: str, at: int) -> int:
    """Behind the provision reference at a place, else -1: a number with one more behind a dash, and a single letter.

    The number may begin with a letter that OCR reads for 1; all parts may stand apart.
    """
    if not text.startswith("§", at):
        return -1
    at = blanks(text, at + 1)
    at += at < len(text) and text[at] in "lI"
    end = digits(text, at)
    if end == at:
        return -1
    dash = blanks(text, end)
    if dash < len(text) and text[dash] in "-—" and (more := digits(text, begin := blanks(text, dash + 1))) > begin:
        end = more
    letter = blanks(text, end)
    if letter < len(text) and text[letter].isascii() and text[letter].isalpha() and not text[letter + 1 : letter + 2].isalpha():
        end = letter + 1
    return end


def references(text: str) -> list[tuple[int, int]]:
    found = []
    at = text.find("§")
    while at >= 0:
        end = reference(text, at)
        if end >= 0:
            found.append((at, end))
        at = text.find("§", max(end, at + 1))
    return found


def month_of(word: str) -> int | None:
    """The month whose name or abbreviation a word begins with; the longest counts."""
    word = word.lower()
    known = max((m for m in MONTHS if word.startswith(m)), key=len, default=None)
    return MONTHS.get(known)


def dated_number(text: str, at: int) -> tuple[int, str] | None:
    """(end, ``YYYY-MM-DD-N``) of ``21. november 1952 nr. 2`` at a place."""
    day = digits(text, at, 2)
    word = blanks(text, dot(text, day))
    after = letters(text, word)
    month = month_of(text[word:after]) if day > at else None
    if month is None:
        return None
    year = blanks(text, dot(text, after))
    number = blanks(text, year + 4)
    if digits(text, year, 4) != year + 4 or text[number : number + 2].lower() != "nr":
        return None
    number = blanks(text, dot(text, number + 2))
    end = digits(text, number)
    return (end, f"{text[year : year + 4]}-{month:02d}-{int(text[at:day]):02d}-{int(text[number:end])}") if end > number else None


def lowered(text: str) -> str:
    """The text in lower case, every letter at its own place."""
    low = text.lower()  # a letter whose lower form is longer would move all places
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def citations(text: str) -> Iterator[tuple[int, int, int, str]]:
    """(place of ``lov``, of the date, end, law) of laws cited by date, ``lov`` and an ``av`` before it in any case."""
    low = lowered(text)
    at = low.find("lov")
    while at >= 0:
        date = blanks(text, at + 3)
        if date > at + 3:
            of = phrase(low, date, "av")
            date = blanks(text, of) if of >= 0 and blanks(text, of) > of else date
            found = dated_number(text, date)
            if found:
                yield at, date, *found
        at = low.find("lov", at + 1)
