"""String and vector similarity: column expressions where Spark has them, Arrow-batched
Python where the measure itself is sequential."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions import text as tx


def py_ratio(a: str | None, b: str | None) -> float:
    return SequenceMatcher(None, (a or "").lower(), (b or "").lower()).ratio()


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """U-01: Ratcliff-Obershelp ratio of the lower-case strings, argument order kept."""
    seen: dict[tuple, float] = {}
    out = []
    for pair in zip(a, b):
        if pair not in seen:
            seen[pair] = py_ratio(*pair)
        out.append(seen[pair])
    return pd.Series(out, dtype="float64")


def ratio_from(least: float):
    """U-01 where it reaches ``least``, else null: a bit-parallel subsequence bound, never below the ratio, spares the others the costly measure."""

    @F.pandas_udf(T.DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict[tuple, float | None] = {}
        out = []
        for x, y in zip(a, b):
            pair = ((x or "").lower(), (y or "").lower())
            if pair not in seen:
                x, y = pair
                total, short = len(x) + len(y), min(len(x), len(y))
                # the same quotient as the ratio's own, so it is not below it after rounding either
                far = total and (2.0 * short / total < least or 2.0 * _lcs(_masks(x), len(x), y) / total < least)
                r = None if far else py_ratio(x, y)
                seen[pair] = r if r is not None and r >= least else None
            out.append(seen[pair])
        return pd.Series(out, dtype="float64")

    return score


#: From this length of the second string on, ``SequenceMatcher`` lets no match begin at a frequent character.
POPULAR = 200


def _holds(a: str, b: str) -> bool:
    """Whether one string holds the other, so that the shorter one is the whole match."""
    return len(b) < POPULAR and (a in b if len(a) <= len(b) else b in a)


def py_changed_chars(a: str, b: str) -> int:
    a, b = a or "", b or ""
    if _holds(a, b):
        return max(0, len(b) - len(a))
    ops = SequenceMatcher(None, a, b).get_opcodes()
    return sum(j2 - j1 for tag, _, _, j1, j2 in ops if tag != "equal")


@F.pandas_udf(T.IntegerType())
def changed_chars(a: pd.Series, b: pd.Series) -> pd.Series:
    """U-02: right-hand characters in changed spans; a pure deletion counts 0."""
    return pd.Series([py_changed_chars(x, y) for x, y in zip(a, b)], dtype="int32")


# --- U-03: partial and token-set ratio, 0 to 100 ------------------------------------------


def _lcs(masks: dict[str, int], width: int, text: str) -> int:
    """Longest common subsequence length by bit-parallel row updates."""
    full = (1 << width) - 1
    row = full
    for ch in text:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return width - row.bit_count()


def _masks(s: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, ch in enumerate(s):
        out[ch] = out.get(ch, 0) | (1 << i)
    return out


def _indel(a: str, b: str) -> float:
    if not a and not b:
        return 100.0
    return 200.0 * _lcs(_masks(a), len(a), b) / (len(a) + len(b)) if a else 0.0


def py_partial_ratio(a: str, b: str) -> float:
    """Best indel ratio of the shorter string against any window of the longer one."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    n, masks, best = len(short), _masks(short), 0.0
    for end in range(1, len(long) + n):
        window = long[max(0, end - n):min(end, len(long))]
        if window[-1] not in masks and end < len(long):
            continue
        best = max(best, 200.0 * _lcs(masks, n, window) / (n + len(window)))
    return best


class WindowProbe:
    """Whether a window of a longer text reaches the threshold near a given place."""

    def __init__(self, short: str, threshold: float, shift: int):
        self.size, self.threshold, self.shift, self.masks = len(short), threshold, shift, _masks(short)

    def near(self, long: str, start: int) -> bool:
        for at in range(start - self.shift, start + self.shift + 1):
            window = long[max(0, at):max(0, at + self.size)]
            if window and 200.0 * _lcs(self.masks, self.size, window) >= self.threshold * (self.size + len(window)):
                return True
        return False


def py_token_set_ratio(a: str, b: str) -> float:
    """Indel ratio over the shared tokens and each side's rest, the best of three pairings."""
    ta, tb = set(a.split()), set(b.split())
    if not ta or not tb:
        return 0.0
    both, only_a, only_b = ta & tb, sorted(ta - tb), sorted(tb - ta)
    if both and (not only_a or not only_b):
        return 100.0
    shared = " ".join(sorted(both))
    left = (shared + " " + " ".join(only_a)).strip()
    right = (shared + " " + " ".join(only_b)).strip()
    best = _indel(left, right)
    if both:
        best = max(best, _indel(shared, left), _indel(shared, right))
    return best


class RatioBlock:
    """Ratios of left strings against a block of right strings, computed only where they can matter.

    The matching blocks of a ratio form a common subsequence, so 2*LCS/(la+lb) bounds it from above.
    All right strings share one bit vector, byte-aligned with a guard bit between them that
    swallows the carry, so one pass over a left string gives its LCS with every right string.
    """

    def __init__(self, rights: list[str]):
        self.rights = rights
        self.first: dict[str, int] = {}
        for j, r in enumerate(rights):
            self.first.setdefault(r, j)
        self.lengths = np.array([len(r) for r in rights])
        sizes = [len(r) // 8 + 1 for r in rights]
        self.starts = np.cumsum([0, *sizes[:-1]])
        self.n_bytes = int(sum(sizes))
        parts: dict[str, bytearray] = {}
        full = bytearray(self.n_bytes)
        for start, r in zip(self.starts.tolist(), rights):
            for i, ch in enumerate(r):
                if ch not in parts:
                    parts[ch] = bytearray(self.n_bytes)
                parts[ch][start + i // 8] |= 1 << (i % 8)
                full[start + i // 8] |= 1 << (i % 8)
        self.masks = {ch: int.from_bytes(m, "little") for ch, m in parts.items()}
        self.full = int.from_bytes(full, "little")
        self.matchers: dict[int, SequenceMatcher] = {}

    def bounds(self, left: str) -> np.ndarray:
        row, full, masks = self.full, self.full, self.masks
        for ch in left:
            hit = row & masks.get(ch, 0)
            if hit:
                row = ((row + hit) | (row - hit)) & full
        ones = np.bitwise_count(np.frombuffer(row.to_bytes(self.n_bytes, "little"), dtype="uint8"))
        common = self.lengths - np.add.reduceat(ones.astype("int64"), self.starts)
        total = self.lengths + len(left)
        return np.where(total > 0, 2.0 * common / np.maximum(total, 1), 1.0)

    def ratio(self, left: str, j: int) -> float:
        right = self.rights[j]
        if _holds(left, right):
            return 2.0 * min(len(left), len(right)) / (len(left) + len(right)) if left or right else 1.0
        if j not in self.matchers:
            self.matchers[j] = SequenceMatcher(None)
            self.matchers[j].set_seq2(right)
        self.matchers[j].set_seq1(left)
        return self.matchers[j].ratio()

    def first_over(self, left: str, cut: float) -> tuple[int, float] | None:
        """First right string more similar than ``cut``."""
        total = self.lengths + len(left)
        # no match is longer than the shorter string: where every length differs too much, the pass over the block is spared
        if not (np.where(total > 0, 2.0 * np.minimum(self.lengths, len(left)) / np.maximum(total, 1), 1.0) > cut).any():
            return None
        for j in np.flatnonzero(self.bounds(left) > cut).tolist():
            if (r := self.ratio(left, j)) > cut:
                return j, r
        return None

    def best(self, left: str, least: float) -> tuple[int, float] | None:
        """Most similar right string with a positive ratio of at least ``least``, the first on a tie. Only equal strings have ratio 1."""
        if (equal := self.first.get(left)) is not None and least <= 1.0:
            return equal, 1.0
        bounds = self.bounds(left)
        found: tuple[int, float] | None = None
        # the ratio of the likeliest tells which others can matter, so only these are put in order
        top = int(bounds.argmax()) if len(bounds) else 0
        if not len(bounds) or bounds[top] < least or bounds[top] == 0.0:
            return None
        if (r := self.ratio(left, top)) >= least and r > 0.0:
            found = (top, r)
        some = np.flatnonzero(bounds >= max(found[1] if found else 0.0, least))
        for j in some[np.argsort(-bounds[some], kind="stable")].tolist():
            if j == top:
                continue
            bar = found[1] if found else 0.0
            if bounds[j] < max(bar, least) or bounds[j] == 0.0:
                break
            r = self.ratio(left, j)
            if r >= least and (r > bar or (found and r == bar and j < found[0])):
                found = (j, r)
        return found


@F.pandas_udf(T.DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([py_partial_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([py_token_set_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


# --- native measures ----------------------------------------------------------------------


def word_tokens(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(tx.col(c)), F.lit("(?U)\\w+"), F.lit(0)))


def token_overlap(a: Column | str, b: Column | str) -> Column:
    """U-04: share of a's word tokens that b has."""
    ta = word_tokens(a)
    return F.size(F.array_intersect(ta, word_tokens(b))) / F.greatest(F.lit(1), F.size(ta))


def contained_tokens(phrase: Column | str, body: Column | str) -> Column:
    """U-05: how many word tokens of more than 4 characters occur inside the body."""
    low = F.lower(tx.col(body))
    toks = F.regexp_extract_all(F.lower(tx.col(phrase)), F.lit("(?U)\\w+"), F.lit(0))
    return F.size(F.filter(toks, lambda t: (F.length(t) > 4) & low.contains(t)))


def dot(a: Column | str, b: Column | str) -> Column:
    """U-06: inner product, summed in double."""
    prods = F.zip_with(tx.col(a), tx.col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def l2(a: Column | str, b: Column | str) -> Column:
    """U-06: squared Euclidean distance."""
    sq = F.zip_with(tx.col(a), tx.col(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.aggregate(sq, F.lit(0.0), lambda acc, x: acc + x)
