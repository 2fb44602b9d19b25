"""Indel similarity of short phrases, vectorised over many text windows.

The indel ratio of a and b is 200 * LCS(a, b) / (len a + len b). The LCS of one phrase with many windows at once is
kept as one 64-bit word per window (a bit per phrase character), so a character step is a few numpy operations.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

RATIO_MIN = 85.0
WORD_MIN = 90.0
#: So few windows are aligned one after the other, more of them together.
FEW_STARTS = 40
_DROP = str.maketrans("", "", string.punctuation)
SPACES = " \t\n\x0b\f\r"  # what \\s means in the SQL expressions
_BLANKS = re.compile(f"[{SPACES}]+")
_WORD = re.compile(f"[^{SPACES}]+")


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence length. One bit per character of ``a`` in a Python integer, so a step over ``b``
    costs a few big-integer operations; whole documents take well under a second."""
    head = 0
    limit = min(len(a), len(b))
    while head < limit and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < limit - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return head + tail
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        common = state & places.get(c, 0)
        if common:
            state = ((state + common) | (state - common)) & full
    return head + tail + len(a) - state.bit_count()


def lcs_at_least(a: str, b: str, least: int) -> int | None:
    """The longest common subsequence length if it reaches ``least``, else None.

    A common head and tail go first, then the characters that only one text has: neither is part of the search. What is left and
    differs in d characters is walked along by their common stretches (Myers' greedy search, stretches found by halving), in d * d short steps. Where d
    grows so far that the bit matrix is cheaper, that one takes over; it stops once the rest of the text cannot reach ``least``.
    """
    n, m = len(a), len(b)
    most = n + m - 2 * least  # characters only one of them has
    if most < 0 or abs(n - m) > most:
        return None
    if a == b:
        return n
    head = _common(a, b, 0, 0)
    a, b = a[head:], b[head:]
    tail = _common(a[::-1], b[::-1], 0, 0)
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    counts, others = Counter(a), Counter(b)
    both = counts.keys() & others.keys()
    if len(both) < len(counts):
        a = a.translate(dict.fromkeys(map(ord, counts.keys() - both)))
    if len(both) < len(others):
        b = b.translate(dict.fromkeys(map(ord, others.keys() - both)))
    # what may still differ, beside the characters that have gone
    counts.subtract(others)
    if sum(map(abs, counts.values())) > most:
        return None
    found = _core_at_least(a, b, max(0, least - head - tail))
    return found if found is None else head + tail + found


def _core_at_least(a: str, b: str, least: int) -> int | None:
    """``lcs_at_least`` of texts without a common head or tail."""
    n, m = len(a), len(b)
    if not n or not m:
        return None if least else 0
    most = n + m - 2 * least
    if most < 0:
        return None
    steps = min(most, max(16, math.isqrt(n * m // 4000)))
    d = _differences(a, b, steps)
    if d is not None:
        return (n + m - d) // 2
    return None if steps == most else _lcs_bits(a, b, least)


def _differences(a: str, b: str, most: int) -> int | None:
    """The number of inserts and drops from ``a`` to ``b``, if it isn't above ``most``."""
    n, m = len(a), len(b)
    far = {1: 0}  # by diagonal: how far into a
    for d in range(most + 1):
        for k in range(-d, d + 1, 2):
            x = far[k + 1] if k == -d or (k != d and far.get(k - 1, -1) < far.get(k + 1, -1)) else far[k - 1] + 1
            if x > n or x - k > m:
                far[k] = x
                continue
            x += _common(a, b, x, x - k)
            if x >= n and x - k >= m:
                return d
            far[k] = x
    return None


def _common(a: str, b: str, i: int, j: int) -> int:
    """Length of the common stretch of a from i and b from j."""
    most = min(len(a) - i, len(b) - j)
    done, size = 0, 16
    while done < most:
        size = min(size, most - done)
        if a[i + done : i + done + size] == b[j + done : j + done + size]:
            done, size = done + size, size * 2
            continue
        while size > 1:  # the first difference is within these
            half = size // 2
            if a[i + done : i + done + half] == b[j + done : j + done + half]:
                done, size = done + half, size - half
            else:
                size = half
        return done
    return done


def _lcs_bits(a: str, b: str, least: int) -> int | None:
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state, rest = full, len(b)
    for c in b:
        common = state & places.get(c, 0)
        rest -= 1
        if common:
            state = ((state + common) | (state - common)) & full
        if not rest & 255 and len(a) - state.bit_count() + rest < least:
            return None
    found = len(a) - state.bit_count()
    return found if found >= least else None


def indel_ratio(a: str | None, b: str | None, minimum: float | None = None) -> float | None:
    """200 * LCS / lengths. With ``minimum``, null where it is not reached, which is often known early."""
    if a is None or b is None:
        return None
    total = len(a) + len(b)
    if total == 0:
        return 100.0
    if minimum is None:
        return 200.0 * lcs_length(a, b) / total
    least = math.ceil(minimum * total / 200.0 - 1e-9)
    found = lcs_at_least(a, b, max(0, least))
    return None if found is None else 200.0 * found / total


def clean_with_map(text: str) -> tuple[str, np.ndarray]:
    """Lower-cased text without ASCII punctuation, and the source index of every kept character."""
    low = text.lower()
    if len(low) == len(text):
        codes = np.frombuffer(low.encode("utf-32-le"), dtype=np.uint32)
        return low.translate(_DROP), np.flatnonzero(~_IS_PUNCT[np.minimum(codes, 127)])
    parts = [c.lower().translate(_DROP) for c in text]
    return "".join(parts), np.repeat(np.arange(len(text)), [len(p) for p in parts])


def normal(phrase: str) -> str:
    """A phrase as it is looked for: clean, with single blanks."""
    return _BLANKS.sub(" ", clean_with_map(phrase)[0]).strip()


_IS_PUNCT = np.array([chr(i) in string.punctuation for i in range(128)])


@dataclass(frozen=True)
class Pattern:
    """A boundary phrase; ``kind`` is 'start' or 'end'."""

    kind: str
    phrase: str
    required: tuple[str, ...] = ()


@dataclass(frozen=True)
class Match:
    kind: str
    phrase: str
    start: int
    end: int
    score: float


@dataclass(frozen=True)
class Dense:
    """What any good enough window of a phrase has: at least ``least`` characters of the phrase's own, at most ``foreign`` others.

    For a window of w <= m characters with a common subsequence of L, 2 L >= r (m + w): so L >= r m / (2 - r), and w - L <= (1 - r) m.
    """

    chars: str
    least: int
    foreign: int

    @staticmethod
    def of(phrase: str, ratio_min: float) -> Dense:
        m, r = len(phrase), ratio_min / 100.0
        return Dense("".join(sorted(set(phrase))), max(1, math.ceil(r * m / (2 - r) - 1e-9)), int((1 - r) * m + 1e-9))

    @property
    def others(self) -> str:
        """Pattern of a character that isn't the phrase's."""
        return "[^" + "".join(re.escape(c) for c in self.chars) + "]"

    @property
    def run(self) -> str:
        """Pattern of the run of own characters that ``least`` of them with so few others between have somewhere."""
        return f"[{''.join(re.escape(c) for c in self.chars)}]{{{-(-self.least // (self.foreign + 1))}}}"


@dataclass(frozen=True)
class _Phrase:
    number: int
    pattern: Pattern
    phrase: str
    bits: dict[int, int]
    pairs: list[str]
    needed: int


class PhraseMatcher:
    """Finds boundary phrases in texts. Built once per Python worker from a small pattern list."""

    def __init__(self, patterns: list[Pattern], ratio_min: float = RATIO_MIN):
        self.ratio_min = ratio_min
        # phrases by the required words they share, so that most are passed over at once
        self.groups: dict[frozenset[str], list[_Phrase]] = {}
        for i, p in enumerate(patterns):
            phrase = normal(p.phrase)
            if not phrase:
                raise ValueError(f"a phrase needs characters: {p.phrase!r}")
            entry = _Phrase(i, p, phrase, _char_bits(phrase), *_pairs(phrase, ratio_min))
            self.groups.setdefault(frozenset(p.required), []).append(entry)
        self.required = sorted({q for p in patterns for q in p.required})
        self._near_words: dict[str, frozenset[str]] = {}

    def best_per_pattern(self, text: str, min_end: int = 0, heard: Iterable[str] = ()) -> list[Match]:
        """Each pattern's best match that ends after ``min_end``: highest score, then leftmost, then longest.
        ``heard`` are required words that stand before the text.

        Pairs of neighbouring characters are looked up in the text once for all phrases that share them; only windows with enough of a phrase's are aligned.
        """
        cleaned, where = clean_with_map(text)
        if not cleaned:
            return []
        near: set[str] = set(heard)
        for word in set(_BLANKS.split(cleaned)):
            near |= self._required_near(word)
        codes = None
        index: dict[str, list[int]] = {}
        found = []
        for required, phrases in self.groups.items():
            if not required <= near:
                continue
            for p in phrases:
                if len(cleaned) < len(p.phrase):
                    continue
                exact = _find_after(cleaned, p.phrase, where, min_end)
                if exact >= 0:  # nothing scores higher, and only the phrase itself scores as high
                    end = int(where[exact + len(p.phrase) - 1]) + 1
                    found.append((p.number, Match(p.pattern.kind, p.pattern.phrase, int(where[exact]), end, 100.0)))
                    continue
                starts = _likely_starts(cleaned, index, len(p.phrase), p.pairs, p.needed)
                if not starts:
                    continue
                if codes is None:
                    codes = np.frombuffer(cleaned.encode("utf-32-le"), dtype=np.uint32)
                hit = self._scan(codes, where, starts, p.phrase, p.bits, min_end)
                if hit:
                    found.append((p.number, Match(p.pattern.kind, p.pattern.phrase, *hit)))
        return [m for _, m in sorted(found, key=lambda x: x[0])]

    def required_at(self, text: str) -> dict[str, int]:
        """Required words near some word of the text, and where the last such word starts."""
        return {q: m.start() for m in _WORD.finditer(text) for q in self._required_near(m[0])}

    def _required_near(self, word: str) -> frozenset[str]:
        """Required words that a word of the text stands for; remembered by the word as it is written, since texts repeat their words."""
        got = self._near_words.get(word)
        if got is None:
            clean = clean_with_map(word)[0]
            got = frozenset(q for q in self.required if clean and _near(clean, q))
            if len(self._near_words) < 500_000:
                self._near_words[word] = got
        return got

    def _scan(self, codes, where, starts, phrase, bits, min_end):
        m = len(phrase)
        if m > 63 or len(starts) < FEW_STARTS:
            return self._scan_long(codes, where, starts, phrase, bits, min_end)
        starts = np.array(starts)
        lookup = _window_bits(codes, bits)
        room = np.minimum(m, codes.size - starts)
        state = np.full(starts.size, ~np.uint64(0))
        mask = np.uint64((1 << m) - 1)
        best = None
        scores = np.zeros((m, starts.size))
        for step in range(m):
            inside = room > step
            at = np.where(inside, starts + step, 0)
            eq = np.where(inside, lookup[at], np.uint64(0))
            common = state & eq
            state = (state + common) | (state - common)
            lcs = np.bitwise_count(~state & mask)
            ends_late = where[at] + 1 > min_end
            scores[step] = np.where(inside & ends_late, 200.0 * lcs / (m + step + 1), 0.0)
        top = scores.max()
        if top >= self.ratio_min:
            hits = np.argwhere(scores == top)  # (length - 1, start position)
            first = starts[hits[:, 1]].min()
            longest = hits[starts[hits[:, 1]] == first][:, 0].max()
            best = (int(where[first]), int(where[first + longest]) + 1, float(top))
        return best

    def _scan_long(self, codes, where, starts, phrase, bits, min_end):
        """As ``_scan``, one window at a time: a phrase of any length is one Python integer."""
        m, full = len(phrase), (1 << len(phrase)) - 1
        best = None
        for start in starts:
            state = full
            for step, code in enumerate(codes[start : start + m].tolist()):
                common = state & bits.get(code, 0)
                state = ((state + common) | (state - common)) & full
                score = 200.0 * (m - state.bit_count()) / (m + step + 1)
                # starts come from left to right: a later one must be better, a longer one from the same start as good
                if score >= self.ratio_min and where[start + step] + 1 > min_end:
                    rank = (score, -start, step)
                    if best is None or rank > best:
                        best = rank
        if best is None:
            return None
        score, start, step = best[0], -best[1], best[2]
        return int(where[start]), int(where[start + step]) + 1, float(score)

    def match_first(self, text: str, min_end: int = 0, heard: Iterable[str] = ()) -> Match | None:
        """The match to act on: earliest end, then highest score; a longer one from the same start wins if it scores
        at least as high."""
        return choose(self.best_per_pattern(text, min_end, heard))


def _find_after(cleaned: str, phrase: str, where: np.ndarray, min_end: int) -> int:
    at = cleaned.find(phrase)
    while at >= 0 and where[at + len(phrase) - 1] + 1 <= min_end:
        at = cleaned.find(phrase, at + 1)
    return at


def choose(matches: list[Match]) -> Match | None:
    if not matches:
        return None
    lead = min(matches, key=lambda x: (x.end, -x.score, x.start, x.kind, x.phrase))
    rivals = [x for x in matches if x.start == lead.start and x.score >= lead.score]
    return min(rivals, key=lambda x: (-x.end, -x.score, x.kind, x.phrase))


def snap(text: str, match: Match) -> tuple[int, int]:
    """Real word range of a match: without trailing blanks, then on to the next whitespace."""
    end = match.start + len(text[match.start : match.end].rstrip(SPACES))
    while end < len(text) and text[end] not in SPACES:
        end += 1
    return match.start, end


def _near(word: str, wanted: str) -> bool:
    total = len(word) + len(wanted)
    if 200.0 * min(len(word), len(wanted)) / total < WORD_MIN:
        return False
    return word == wanted or 200.0 * lcs_length(word, wanted) / total >= WORD_MIN


def _char_bits(phrase: str) -> dict[int, int]:
    bits: dict[int, int] = {}
    for i, c in enumerate(phrase):
        bits[ord(c)] = bits.get(ord(c), 0) | (1 << i)
    return bits


def _window_bits(codes: np.ndarray, bits: dict[int, int]) -> np.ndarray:
    keys = np.array(sorted(bits), dtype=np.uint32)
    vals = np.array([bits[int(k)] for k in keys], dtype=np.uint64)
    slot = np.minimum(np.searchsorted(keys, codes), keys.size - 1)
    return np.where(keys[slot] == codes, vals[slot], np.uint64(0))


def _pairs(phrase: str, ratio_min: float) -> tuple[list[str], int]:
    """The phrase's pairs of neighbouring characters, and how many of them a good enough window must hold.

    A dropped character spoils two pairs, an inserted one spoils one. With i inserts the common subsequence has r (m + i) / (2 - r) characters at
    least, so as many as are missing from m are dropped. A phrase that may lose all its pairs has its single characters instead (a drop spoils one).
    """
    m, r = len(phrase), ratio_min / 100.0
    inserts = range(int((1 - r) * m + 1e-9) + 1)
    drops = [m - math.ceil(r * (m + i) / (2 - r) - 1e-9) for i in inserts]
    needed = m - 1 - max(2 * d + i for i, d in zip(inserts, drops))
    if needed > 0:
        return sorted({phrase[i : i + 2] for i in range(m - 1)}), needed
    return sorted(set(phrase)), max(1, m - max(drops))


def _likely_starts(cleaned: str, index: dict[str, list[int]], m: int, pieces: list[str], needed: int) -> list[int]:
    """Starts of windows of ``m`` characters that hold enough of the pieces. ``index`` keeps the places of pieces in this text."""
    places: list[int] = []
    for piece in pieces:
        if (at := index.get(piece)) is None:
            at = index[piece] = _all_places(cleaned, piece)
        places += at
    if len(places) < needed:
        return []
    places.sort()
    starts: list[int] = []
    size, upto = len(pieces[0]), 0  # starts below ``upto`` are decided
    for first, last in zip(places, places[needed - 1 :]):
        if last + size - m > first:
            continue
        low = max(upto, last + size - m, 0)
        if low <= first:
            starts.extend(range(low, first + 1))
        upto = max(upto, first + 1)
    return starts


def _all_places(text: str, piece: str) -> list[int]:
    out, at = [], text.find(piece)
    while at >= 0:
        out.append(at)
        at = text.find(piece, at + 1)
    return out
