"""Similarity of two strings as columns, and the score of a quotation against a sentence."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the score.
LEAST_BONUS_LENGTH, BONUS, LEAST_JACCARD = 12, 0.08, 0.35


def ngrams(text, n: int) -> Column:
    """The set of n-grams; a shorter text is its own, an empty one has none."""
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n))))
    return F.when(text == "", F.array().cast("array<string>")).when(F.char_length(text) <= n, F.array(text)).otherwise(many)


def dice(a, b) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def ngram_score(a, b) -> Column:
    return (dice(ngrams(a, 2), ngrams(b, 2)) + dice(ngrams(a, 3), ngrams(b, 3))) / 2


def edit_similarity(a, b) -> Column:
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b)))


def length_similarity(a, b) -> Column:
    return 1 - F.abs(F.char_length(a) - F.char_length(b)) / F.greatest(F.char_length(a), F.char_length(b))


def char_jaccard(a, b) -> Column:
    x, y = (F.array_distinct(F.filter(F.split(t, ""), lambda c: c != "")) for t in (a, b))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.size(F.array_union(x, y)))


def common_substring_ratio(a, b) -> Column:
    """2 * longest common substring / both lengths, by growing the length while some substring of ``a`` is in ``b``."""
    longest = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.char_length(a), F.lit(1))), F.lit(0),
        lambda best, i: F.aggregate(F.sequence(F.lit(1), F.greatest(F.char_length(a), F.lit(1))), best, lambda now, _: F.when((i + now <= F.char_length(a)) & F.contains(b, F.substring(a, i, now + 1)), now + 1).otherwise(now)),
    )
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(2.0 * longest / (F.char_length(a) + F.char_length(b)))


def boundary_bonus(query, candidate, label: str, start, end) -> Column:
    """Extra score of a match at the start (start_anchor) or end (end_anchor) of the candidate, for queries that are long enough. start is 0-based."""
    cover = F.least(F.lit(1.0), F.char_length(query) / F.greatest(F.lit(1), F.char_length(candidate)))
    fits = start == 0 if label == "start_anchor" else end == F.char_length(candidate) if label == "end_anchor" else F.lit(True)
    return F.when((F.char_length(query) >= LEAST_BONUS_LENGTH) & (start >= 0) & (end >= 0) & fits, BONUS * (0.5 + 0.5 * cover)).otherwise(F.lit(0.0))


def contained_score(query_raw, candidate_raw, query, candidate, label: str) -> Column:
    """The first four rungs of the score: equal, equal when normalised, contained either way; null when only a window can match."""
    q, c = F.char_length(query), F.char_length(candidate)
    at = F.instr(candidate, query) - 1
    return (
        F.when((query == "") | (candidate == ""), F.lit(0.0))
        .when(F.trim(query_raw) == F.trim(candidate_raw), F.lit(1.0))
        .when(query == candidate, F.lit(0.995))
        .when(F.contains(candidate, query), F.least(F.lit(1.0), 0.75 + 0.25 * q / c + boundary_bonus(query, candidate, label, at, at + q)))
        .when(F.contains(query, candidate), F.least(F.lit(0.92), 0.78 + 0.14 * c / q))
    )


# The same measures for Python workers: the window search needs a loop.

_SPACE = re.compile(r"\s+")
_HYPHEN = re.compile(r"([^\W\d_])\s*[-‐‑]\s+(?=[^\W\d_])")


def latin(c: str) -> bool:
    return c.isalpha() and "LATIN" in unicodedata.name(c, "")


@lru_cache(1 << 14)
def normalize(text: str) -> str:
    """Comparison form: white space only between Latin letters (and dropped with them), hyphen breaks joined, no punctuation or symbols, Latin letters without case and marks."""
    out = []
    for c in text:
        if c.isspace() or unicodedata.category(c)[0] in "PS":
            continue
        out.append("".join(x for x in unicodedata.normalize("NFD", c.lower()) if not unicodedata.combining(x)) if latin(c) else c)
    return "".join(out)


def _grams(text: str, n: int) -> set[str]:
    return {text[i : i + n] for i in range(len(text) - n + 1)} if len(text) > n else {text} - {""}


def _dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def lcs_ratio(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        up = 0
        for j, y in enumerate(b, 1):
            up, row[j] = row[j], up + 1 if x == y else 0
            if row[j] > best:
                best = row[j]
    return 2 * best / (len(a) + len(b))


def edit_ratio(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return 1 - row[-1] / max(len(a), len(b))


def _bonus(query: str, candidate: str, label: str, start: int, end: int) -> float:
    if len(query) < LEAST_BONUS_LENGTH or start < 0 or end < 0 or label == "start_anchor" and start or label == "end_anchor" and end != len(candidate):
        return 0.0
    return BONUS * (0.5 + 0.5 * min(1.0, len(query) / max(1, len(candidate))))


def score(query_raw: str, candidate_raw: str, label: str) -> dict:
    """score, raw, normalized, substring, start and end of the best match of a quotation in a sentence."""
    query_raw, candidate_raw = query_raw.strip(), candidate_raw.strip()
    q, c = normalize(query_raw), normalize(candidate_raw)
    made = lambda s, raw=False, norm=False, sub=False, start=0, end=len(c): {"score": s, "raw": raw, "normalized": norm, "substring": sub, "start": start, "end": end}
    if not q or not c:
        return made(0.0, start=-1, end=-1)
    if query_raw == candidate_raw:
        return made(1.0, True, True, True)
    if q == c:
        return made(0.995, norm=True)
    if q in c:
        at = c.index(q)
        return made(min(1.0, 0.75 + 0.25 * len(q) / len(c) + _bonus(q, c, label, at, at + len(q))), sub=True, start=at, end=at + len(q))
    if c in q:
        return made(min(0.92, 0.78 + 0.14 * len(c) / len(q)))
    best, where = 0.0, (-1, -1)
    largest = min(len(c), max(len(q), int(len(q) * 1.2)))
    smallest = min(largest, max(1, int(len(q) * 0.8)))
    letters, two, three = set(q), _grams(q, 2), _grams(q, 3)
    for size in range(smallest, largest + 1):
        for at in range(len(c) - size + 1):
            w = c[at : at + size]
            seen = set(w)
            if len(letters & seen) / len(letters | seen) < LEAST_JACCARD:
                continue
            near = (_dice(two, _grams(w, 2)) + _dice(three, _grams(w, 3))) / 2
            extra = 0.1 * (1 - abs(len(q) - size) / max(len(q), size)) + _bonus(q, c, label, at, at + size)
            if 0.35 * near + 0.55 + extra <= best:  # even perfect measures wouldn't be better
                continue
            total = 0.35 * near + 0.35 * lcs_ratio(q, w) + 0.2 * edit_ratio(q, w) + extra
            if total > best:
                best, where = min(1.0, total), (at, at + size)
    return made(best, start=where[0], end=where[1])
