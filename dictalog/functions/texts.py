"""Text cleaning and boundary-phrase predicates as column expressions."""

from __future__ import annotations

import re

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = string.punctuation  # the 32 ASCII marks
WORD_MIN = 90.0


def clean_text(text: Column) -> Column:
    """Lower-case without ASCII punctuation; whitespace and other marks stay."""
    return F.translate(F.lower(text), PUNCTUATION, "")


def clean_map(text: Column) -> Column:
    """For every character of ``clean_text``, its 0-based place in ``text``."""
    chars = F.split(text, "")
    kept = F.transform(chars, lambda c, i: F.struct(i.alias("i"), F.length(clean_text(c)).alias("n")))
    return F.flatten(F.transform(kept, lambda k: F.array_repeat(k["i"], k["n"])))


def collapse_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def tokens(text: Column) -> Column:
    """Words of the cleaned text."""
    return F.filter(F.split(clean_text(text), r"\s+"), lambda w: w != "")


def near_word(word: Column, wanted: Column) -> Column:
    """True if the indel ratio of two words is at least 90.

    With word lengths adding up to less than 20, at most one character may be added or dropped, so one edit with a
    length difference of one is the whole condition. Longer words go through the general form.
    """
    total = F.length(word) + F.length(wanted)
    short = (word == wanted) | (
        (F.abs(F.length(word) - F.length(wanted)) == 1)
        & (total >= 11)
        & (F.levenshtein(word, wanted, 1) == 1)
    )
    return F.when(total < 20, short).otherwise(_near_long(word, wanted))


def near_pattern(wanted: list[str]) -> str | None:
    """Pattern that finds a word near one of ``wanted`` in a cleaned text, by the same rule: one regular expression instead of a comparison per word. None if
    one of them is too long for that."""
    if not wanted or max(map(len, wanted)) > 9:
        return None
    forms: set[str] = set()
    for w in wanted:
        n = len(w)
        forms.add(re.escape(w))
        if 2 * n - 1 >= 11:
            forms |= {re.escape(w[:i] + w[i + 1 :]) for i in range(n)}
        if 2 * n + 1 >= 11:
            forms |= {re.escape(w[:i]) + r"\S" + re.escape(w[i:]) for i in range(n + 1)}
    return rf"(?:^|\s)(?:{'|'.join(sorted(forms))})(?=\s|$)"


def _near_long(word: Column, wanted: Column) -> Column:
    """A ratio of 90 allows total/10 inserts and drops. Few words are within as many edits; for those the longest common
    subsequence decides."""
    total = F.length(word) + F.length(wanted)
    return (F.levenshtein(word, wanted) <= F.floor(total / 10)) & (200 * lcs_length(word, wanted) >= WORD_MIN * total)


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two short texts, one row of the table after the other."""
    letters = F.split(b, "")

    def next_row(row: Column, letter: Column) -> Column:
        def cell(done: Column, i: Column) -> Column:
            hit = F.get(letters, i) == letter
            longest = F.greatest(F.get(row, i + 1), F.get(done, i))
            return F.concat(done, F.array(F.when(hit, F.get(row, i) + 1).otherwise(longest)))

        return F.aggregate(F.sequence(F.lit(0), F.size(letters) - 1), F.array(F.lit(0)), cell)

    return F.aggregate(F.split(a, ""), F.array_repeat(F.lit(0), F.size(letters) + 1), next_row, lambda row: F.element_at(row, -1))


def has_required_words(words: Column, required: Column) -> Column:
    """Every required word is near some word of the text."""
    return F.forall(required, lambda q: F.exists(words, lambda w: near_word(w, q)))


def ends_with_space(text: Column) -> Column:
    return text.rlike(r"\s$")


def seam(left: Column, right: Column) -> Column:
    """1 if a space has to be put between two texts: both non-empty, no whitespace on either side."""
    needs = (F.length(left) > 0) & ~ends_with_space(left) & ~right.rlike(r"^\s")
    return F.when(F.coalesce(needs, F.lit(False)), F.lit(1)).otherwise(F.lit(0))


def snap_end(text: Column, start: Column, end: Column) -> Column:
    """End of the match without trailing blanks, moved on to the next whitespace (or the end of the text)."""
    matched = F.substring(text, start + 1, end - start)
    bare_end = start + F.length(F.regexp_replace(matched, r"\s+$", ""))
    rest = F.substring(text, bare_end + 1, F.greatest(F.length(text) - bare_end, F.lit(0)))
    return bare_end + F.length(F.regexp_extract(rest, r"^\S*", 0))


def boundary_words_at_edges(text: Column, commands: list[str], edge: int = 10) -> Column:
    """True if a left-over command word stands among the first or last ``edge`` words."""
    words = tokens(text)
    first = F.slice(words, 1, edge)
    last = F.slice(words, F.greatest(F.size(words) - (edge - 1), F.lit(1)), F.lit(edge))
    return F.arrays_overlap(F.concat(first, last), F.array(*[F.lit(c) for c in commands]))
