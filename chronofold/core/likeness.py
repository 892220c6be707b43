"""Similarity of long texts: a bound from a bit-parallel common subsequence, and the exact ratio by hashed blocks. No Spark here."""

from __future__ import annotations

import difflib
import math

import numpy as np

#: Rows of the second text between two looks at the bound, and sides under which a block is sought character by character.
ROWS, SMALL = 128, 48
#: An odd multiplier for rolling sums of code points modulo 2**64; equal sums are compared letter by letter.
_BASE = 0x9E3779B97F4A7C15


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Masks:
    """For every letter of a text the places where it stands, as the bits of one whole number."""

    def __init__(self, text: str):
        self.n = len(text)
        codes = points(text)
        self.of = {chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes).tolist()}


def common(masks: Masks, other: str, least: int) -> int:
    """The length of a longest common subsequence, or -1 where it is below ``least``.

    One row of the usual table is a whole number with a zero wherever the length grows, and a row follows from the one
    before by an addition (Hyyro 2004). A subsequence of ``least`` letters leaves at most n - least and m - least letters
    out, so its path stays in a band around the diagonal: other bits are not touched, and the search ends at the first
    look at which the band holds no path that is good enough.
    """
    n, m = masks.n, len(other)
    x, y = n - least, m - least
    if x < 0 or y < 0:
        return -1
    row, low, width, zeros = 0, 0, 0, 0  # the bits of columns low to low + width; zeros counts those below
    for j in range(0, m, ROWS):
        end = min(j + ROWS, m)
        new_low, high = max(0, j - y), min(n, end + x)
        gone = min(new_low - low, width)
        if gone > 0:
            zeros += gone - (row & ((1 << gone) - 1)).bit_count()
            row, low, width = row >> gone, low + gone, width - gone
        if high > low + width:
            row |= ((1 << (high - low - width)) - 1) << width
            width = high - low
        window = (1 << width) - 1
        part = other[j:end]
        here = {c: (masks.of.get(c, 0) >> low) & window for c in set(part)}
        for c in part:
            hit = row & here[c]
            row = ((row + hit) | (row - hit)) & window
        # at row ``end`` the path stands at a column of at most end - y + x letters of the first text, with end - y of them matched
        reach = min(n, end - y + x)
        if reach > low:
            span = min(reach - low, width)
            matched = zeros + span - (row & ((1 << span) - 1)).bit_count()
        else:
            matched = zeros
        if matched < end - y:
            return -1
    found = zeros + width - row.bit_count()
    return found if found >= least else -1


class _Grams:
    """Rolling sums of a text, from which those of all its pieces of one length come at once."""

    def __init__(self, codes: np.ndarray, powers: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[: len(codes)])])

    def of(self, low: int, high: int, size: int, powers: np.ndarray, most: int) -> np.ndarray:
        """The sums of the pieces of ``size`` that begin from ``low`` on and end by ``high``, each moved to the same power."""
        raw = self.sums[low + size : high + 1] - self.sums[low : high + 1 - size]
        return raw * powers[most - np.arange(low, high + 1 - size)]


class Blocks:
    """The longest common blocks of two texts: of equally long ones the first in ``a``, then the first in ``b``."""

    def __init__(self, a: str, b: str):
        self.a, self.b = a, b
        self.x, self.y = points(a), points(b)
        self.most = max(len(a), len(b)) + 1
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.most, _BASE, np.uint64)]))
            self.ours, self.theirs = _Grams(self.x, self.powers), _Grams(self.y, self.powers)

    def _at(self, size: int, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int] | None:
        """The first places of a common piece of ``size`` letters."""
        ours = self.ours.of(alo, ahi, size, self.powers, self.most)
        theirs = self.theirs.of(blo, bhi, size, self.powers, self.most)
        for i in np.flatnonzero(np.isin(ours, theirs)).tolist():
            for j in np.flatnonzero(theirs == ours[i]).tolist():
                if np.array_equal(self.x[alo + i : alo + i + size], self.y[blo + j : blo + j + size]):
                    return alo + i, blo + j
        return None

    def longest(self, alo: int, ahi: int, blo: int, bhi: int, most: int | None = None) -> tuple[int, int, int]:
        """(place in a, place in b, size) between the bounds, of at most ``most`` letters; size 0 where no letter is common."""
        low, high = 0, min(ahi - alo, bhi - blo, *([] if most is None else [most]))
        found = (alo, blo)
        size = 1
        with np.errstate(over="ignore"):
            while size <= high:  # doubling, then halving: most blocks are short
                at = self._at(size, alo, ahi, blo, bhi)
                if at is None:
                    high = size - 1
                    break
                found, low, size = at, size, min(max(2 * size, 1), high) if size < high else high + 1
            while low < high:
                middle = (low + high + 1) // 2
                at = self._at(middle, alo, ahi, blo, bhi)
                if at is None:
                    high = middle - 1
                else:
                    found, low = at, middle
        return (*found, low)


#: Bits of a place in a text in one number with its text's, and the most places that are looked at together.
_PLACE, _MOST = 22, 1 << 21


def sizes_of(length: float) -> tuple[int, int]:
    """Sizes of pieces of which unlike texts of a length share a dozen, and then some fifty."""
    size = math.ceil(math.log(max(length, 1) ** 2 / 6 + 1) / 1.3) - 1
    return max(size, 4), max(size - 2, 3)


def _pieces(texts: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place) of every piece of ``size`` letters."""
    every = np.concatenate(texts).astype(np.uint64) + np.uint64(1)
    lengths = np.array([len(t) for t in texts], np.int64)
    n = max(len(every) - size + 1, 0)
    out = every[:n].copy()
    for k in range(1, size):
        out *= np.uint64(_BASE)
        out += every[k : k + n]
    out ^= out >> np.uint64(29)
    text = np.repeat(np.arange(len(texts)), lengths)[:n]
    place = np.arange(n) - (np.cumsum(lengths) - lengths)[text]
    whole = np.flatnonzero(place + size <= lengths[text])
    return out[whole], text[whole], place[whole]


class Pieces:
    """All pieces of a size of many texts, sorted, to tell which of them cannot be much like another text.

    A ratio takes the longest common block first, wherever it stands, and all that is crosswise to it is lost. In two
    texts that have only words in common it seldom stands at like places in both, so one or two blocks mostly show that
    too much is lost. Every block of ``size`` or more letters is found by its pieces, so the longest is known.
    """

    def __init__(self, texts: list[np.ndarray], size: int):
        self.size, self.lengths = size, np.array([len(t) for t in texts], np.int64)
        self.letters, self.starts = np.concatenate([*texts, np.zeros(1, np.uint32)]), np.cumsum(self.lengths) - self.lengths
        hashed, text, place = _pieces(texts, size)
        order = np.argsort(hashed)
        hashed, text, place = hashed[order], text[order], place[order]
        self.first = np.flatnonzero(np.concatenate([np.ones(min(len(hashed), 1), bool), hashed[1:] != hashed[:-1]]))
        self.keys, self.count = hashed[self.first], np.diff(self.first, append=len(hashed))
        at = self.starts[text] + place
        self.before = np.where(place > 0, self.letters[at - 1], 0xFFFFFFFF).astype(np.uint32)
        self.behind = np.where(place + size < self.lengths[text], self.letters[np.minimum(at + size, len(self.letters) - 1)], 0xFFFFFFFF).astype(np.uint32)
        self.text, self.place = text.astype(np.int32), place.astype(np.int32)

    def open(self, others: list[np.ndarray], alive: np.ndarray, least: float, lane_first: np.ndarray) -> np.ndarray:
        """``alive`` (other, text) without pairs whose ratio is sure to be below ``least``.

        ``lane_first`` tells the pairs of which this index's text is the ratio's first argument: of equally long blocks
        the first one there is taken.
        """
        if not alive.any() or not len(self.keys):
            return alive
        blocks = self.blocks(others, alive)
        if blocks is not None:
            return self._left(others, *blocks, alive, least, lane_first)
        if len(others) == 1:
            return alive
        half = len(others) // 2
        return np.concatenate([self.open(others[:half], alive[:half], least, lane_first[:half]), self.open(others[half:], alive[half:], least, lane_first[half:])])

    def blocks(self, others: list[np.ndarray], alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """(pair, place in the other, place in the text, size) of all common blocks of ``self.size`` letters or more, pair by pair.

        A pair's number is its place in ``alive``. Nothing where these are too many to be looked at together.
        """
        if max(int(self.lengths.max()), *(len(t) for t in others)) >> (_PLACE - 1) or alive.size >> (62 - 2 * _PLACE):
            return None
        hashed, other, place = _pieces(others, self.size)
        order = np.argsort(hashed)
        hashed = hashed[order]
        at = np.searchsorted(self.keys, hashed)
        at[at == len(self.keys)] = 0
        met = np.flatnonzero(self.keys[at] == hashed)
        at, order = at[met], order[met]
        count = self.count[at]
        total = int(count.sum())
        if total > _MOST:
            return None
        lengths = np.array([len(t) for t in others], np.int64)
        starts = np.cumsum(lengths) - lengths
        letters = np.concatenate([*others, np.zeros(1, np.uint32)])
        other, place = other[order], place[order]
        mine = starts[other] + place
        before = np.where(place > 0, letters[mine - 1], 0xFFFFFFFE).astype(np.uint32)
        behind = np.where(place + self.size < lengths[other], letters[mine + self.size], 0xFFFFFFFE).astype(np.uint32)
        held = np.arange(total) + np.repeat(self.first[at] - (np.cumsum(count) - count), count)
        asked = np.repeat(np.arange(len(at)), count)
        pair = other[asked] * len(self.lengths) + self.text[held]
        here = np.flatnonzero(alive.ravel()[pair])
        held, asked, pair = held[here], asked[here], pair[here]
        # a block's first and last pieces, in the same order of pairs, diagonals and places
        ends = []
        for ours, theirs in ((before, self.before), (behind, self.behind)):
            edge = np.flatnonzero(ours[asked] != theirs[held])
            i = place[asked[edge]]
            key = (((pair[edge] << _PLACE) | (self.place[held[edge]] - i + (1 << (_PLACE - 1)))) << _PLACE) | i
            key.sort()
            ends.append(key)
        low = (1 << _PLACE) - 1
        i = ends[0] & low
        j = ((ends[0] >> _PLACE) & low) - (1 << (_PLACE - 1)) + i
        return ends[0] >> (2 * _PLACE), i, j, (ends[1] & low) + self.size - i

    def _left(self, others: list[np.ndarray], pair: np.ndarray, i: np.ndarray, j: np.ndarray, size: np.ndarray, alive: np.ndarray, least: float, lane_first: np.ndarray) -> np.ndarray:
        """Pairs that are left when their common blocks (place i in the other, j in the text) are taken, the longest first.

        After each block the larger side of it goes on, the other side counts as if all of it matched. A pair is left
        where no block of ``self.size`` letters is in that side.
        """
        alive = alive.copy()
        flat, first = alive.ravel(), lane_first.ravel()
        letters, lengths = np.concatenate(others), np.array([len(t) for t in others], np.int64)
        starts = np.cumsum(lengths) - lengths
        begin = np.flatnonzero(np.concatenate([np.ones(min(len(pair), 1), bool), pair[1:] != pair[:-1]]))
        pairs = pair[begin]
        a, b = pairs // len(self.lengths), pairs % len(self.lengths)
        alo, ahi, blo, bhi = np.zeros(len(pairs), np.int64), lengths[a], np.zeros(len(pairs), np.int64), self.lengths[b]
        most, need, swap = np.minimum(ahi, bhi), least * (ahi + bhi) / 2 - 1e-6, first[pairs]
        while len(pairs):
            count = np.diff(begin, append=len(i))
            of = np.repeat(np.arange(len(pairs)), count)
            skip = np.maximum(np.maximum(alo[of] - i, blo[of] - j), 0)
            long = np.minimum(np.minimum(ahi[of] - i, bhi[of] - j), size) - skip
            best = np.maximum.reduceat(long, begin)
            x, y = i + skip, j + skip
            place = np.where(swap[of], (y << 32) | x, (x << 32) | y)
            place[long != best[of]] = 1 << 62
            place = np.minimum.reduceat(place, begin)
            x, y = np.where(swap, place & 0xFFFFFFFF, place >> 32), np.where(swap, place >> 32, place & 0xFFFFFFFF)
            found = np.flatnonzero(best >= self.size)
            if not len(found):
                break
            # equal hashes are not yet equal letters
            n = best[found]
            begins = np.cumsum(n) - n
            ramp = np.arange(int(n.sum())) - np.repeat(begins, n)
            same = letters[np.repeat(starts[a[found]] + x[found], n) + ramp] == self.letters[np.repeat(self.starts[b[found]] + y[found], n) + ramp]
            on = np.zeros(len(pairs), bool)
            on[found] = np.logical_and.reduceat(same, begins)
            left, right = np.minimum(x - alo, y - blo), np.minimum(ahi - x - best, bhi - y - best)
            most = most - np.minimum(ahi - alo, bhi - blo) + best + left + right
            flat[pairs[on & (most < need)]] = False
            on &= most >= need
            if not on.any():
                break
            lower = left >= right
            alo, ahi, blo, bhi = (np.where(lower, *w)[on] for w in ((alo, x + best), (x, ahi), (blo, y + best), (y, bhi)))
            rows = on[of]
            i, j, size = i[rows], j[rows], size[rows]
            pairs, a, b, most, need, swap, count = pairs[on], a[on], b[on], most[on], need[on], swap[on], count[on]
            begin = np.cumsum(count) - count
        return alive


def ratio(a: str, b: str, least: float = 0.0) -> float:
    """Ratcliff-Obershelp similarity, first argument first, as the standard library's without its junk rule.

    All blocks of some letters are found at once by the hashes of their pieces, the longest in each part is taken, and
    parts without one are searched by hashes of other lengths; what is short is left to the standard library. Where the
    ratio cannot reach ``least`` any more, what was found so far is returned, which is below it.
    """
    total = len(a) + len(b)
    if not a or not b:
        return float(a == b)
    if min(len(a), len(b)) <= SMALL:
        return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
    need = least * total / 2 - 1e-6
    x, y = points(a), points(b)
    index = Pieces([y], sizes_of(total / 2)[1])
    known = index.blocks([x], np.ones((1, 1), bool))
    runs = np.zeros((3, 0), np.int64) if known is None else np.stack(known[1:])
    whole = known is not None  # whether all blocks of a size are among the runs
    blocks = None
    matched, open_ = 0, min(len(a), len(b))
    todo = [(0, len(a), 0, len(b), runs)]
    while todo:
        alo, ahi, blo, bhi, runs = todo.pop()
        most = min(ahi - alo, bhi - blo)
        open_ -= most
        if most <= SMALL:
            own = sum(x.size for x in difflib.SequenceMatcher(None, a[alo:ahi], b[blo:bhi], autojunk=False).get_matching_blocks()) if most else 0
            matched += own
        else:
            size = 0
            if whole and runs.shape[1]:
                # the part of each run that is between the bounds
                skip = np.maximum(np.maximum(alo - runs[0], blo - runs[1]), 0)
                long = np.minimum(np.minimum(ahi - runs[0], bhi - runs[1]), runs[2]) - skip
                inside = long >= index.size
                runs, long = (runs + np.stack([skip, skip, -skip]))[:, inside], long[inside]
                if len(long):
                    k = int(np.lexsort((runs[1], runs[0], -long))[0])
                    i, j, size = int(runs[0, k]), int(runs[1, k]), int(long[k])
                    if a[i : i + size] != b[j : j + size]:  # equal hashes are not yet equal letters
                        whole, size = False, 0
            if not size:
                blocks = blocks or Blocks(a, b)
                i, j, size = blocks.longest(alo, ahi, blo, bhi, index.size - 1 if whole else None)
            matched += size
            if size:
                for part in ((alo, i, blo, j), (i + size, ahi, j + size, bhi)):
                    if part[0] < part[1] and part[2] < part[3]:
                        todo.append((*part, runs))
                        open_ += min(part[1] - part[0], part[3] - part[2])
        if matched + open_ < need:
            break
    return 2.0 * matched / total
