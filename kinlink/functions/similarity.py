"""String similarity of two columns, 0 to 1 (or 0 to 100 where named a ratio).

Levenshtein and exact equality are built in. The others run as Arrow-batched
functions on bit-parallel cores; equal pairs of a batch are computed once. They are
rounded to nine digits, so that equal similarities tie whichever way they were reached.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word operation for each character of b."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    free = full = (1 << len(a)) - 1
    for c in b:
        hit = free & places.get(c, 0)
        free = (free + hit | free - hit) & full
    return len(a) - free.bit_count()


def ratio_of(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths, in percent; two empty strings are alike."""
    n = len(a) + len(b)
    return 200.0 * lcs_length(a, b) / n if n else 100.0


def lcs_of(a: str, b: str) -> float:
    n = max(len(a), len(b))
    return lcs_length(a, b) / n if n else 1.0


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro similarity, raised by a common prefix of up to four characters where it is over 0.7."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, of_a = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                of_a.append(c)
                break
    if not (m := len(of_a)):
        return 0.0
    of_b = [c for c, t in zip(b, taken) if t]
    swapped = sum(x != y for x, y in zip(of_a, of_b)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def token_sort_of(a: str, b: str) -> float:
    return ratio_of(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_of(a: str, b: str) -> float:
    """The best ratio among the shared tokens, and either side's own tokens added to them."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both, only_a, only_b = left & right, " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if both and not (only_a and only_b):
        return 100.0
    n = len(" ".join(both))
    gap = 1 if both else 0
    la, lb = n + gap + len(only_a), n + gap + len(only_b)
    apart = len(only_a) + len(only_b) - 2 * lcs_length(only_a, only_b)
    best = 100.0 * (1 - apart / (la + lb))
    if both:
        best = max(best, 100.0 * 2 * n / (n + la), 100.0 * 2 * n / (n + lb))
    return best


def partial_of(a: str, b: str) -> float:
    """The best ratio of the shorter string and any window of the longer one, windows over the ends included."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    n, letters, best = len(short), set(short), 0.0
    for end in range(1, len(long) + n):
        window = long[max(0, end - n) : end]
        edge = window[-1] if end <= len(long) else window[0]
        if edge in letters:
            best = max(best, ratio_of(short, window))
            if best == 100.0:
                break
    if len(a) == len(b):
        for end in range(1, 2 * n):
            window = short[max(0, end - n) : end]
            if window:
                best = max(best, ratio_of(long, window))
    return best


def levenshtein_of(a: str, b: str) -> float:
    """One less the edit distance over the longer length, as :func:`levenshtein`; bit-parallel."""
    longest = max(len(a), len(b))
    if not longest:
        return 1.0
    if not a or not b:
        return 0.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = full, 0, len(a)
    for c in b:
        hit = places.get(c, 0)
        across = (((hit & up) + up) ^ up) | hit | down
        more, less = down | ~(across | up) & full, up & across
        distance += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = less | ~((hit | down) | more) & full, more & (hit | down)
    return 1 - distance / longest


#: Pairs of texts whose similarity a worker remembers, for each function.
KNOWN = 1 << 18
_known: dict[str, dict[tuple[str, str], float]] = {}


def matrix_of(f: Callable[[str, str], float], texts: list[str], wanted: np.ndarray) -> np.ndarray:
    """f of the wanted (i, j) pairs of texts, rounded as a column of :func:`_arrow` and then to six digits, halves up."""
    known = _known.setdefault(f.__name__, {})
    out = np.zeros(wanted.shape)
    for i, j in np.argwhere(wanted).tolist():
        pair = texts[i], texts[j]
        if (sim := known.get(pair)) is None:
            sim = f(*pair) if f is levenshtein_of else round(f(*pair), 9)
            sim = float(Decimal(repr(sim)).quantize(Decimal("0.000001"), ROUND_HALF_UP))
            if len(known) >= KNOWN:
                known.clear()
            known[pair] = sim
        out[i, j] = sim
    return out


def _arrow(f: Callable[[str, str], float]):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict[tuple[str, str], float] = {}
        out = []
        for x, y in zip(a, b):
            if x is None or y is None:
                out.append(None)
                continue
            if (x, y) not in seen:
                seen[x, y] = round(f(x, y), 9)
            out.append(seen[x, y])
        return pd.Series(out, dtype="float64")

    return run


def levenshtein(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


jaro_winkler = _arrow(jaro_winkler_of)
lcs = _arrow(lcs_of)
ratio = _arrow(ratio_of)
token_sort = _arrow(token_sort_of)
token_set = _arrow(token_set_of)
partial = _arrow(partial_of)


def same_text(a: Column, b: Column) -> Column:
    """Equal and not empty."""
    return (a == b) & (a != "")
