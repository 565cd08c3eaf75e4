"""Character similarity, and the evidence arithmetic built on token arrays."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from bidloom import vocabulary as V
from bidloom.functions.common import round_half_up


#: From this length on the library's ratio leaves frequent letters of the second text out.
LONG_TEXT = 200
#: Letters of windows compared in one step.
_AREA = 1 << 16


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as rows of code points, and their lengths."""
    size = np.array([len(t) for t in texts], np.int64)
    width = max(1, int(size.max(initial=1)))
    return np.array(texts, f"U{width}").view(np.uint32).reshape(len(texts), width), size


def _windows(letters: np.ndarray, low: np.ndarray, high: np.ndarray, filler: int) -> np.ndarray:
    """The letters from low to high of every row, padded to one width."""
    at = low[:, None] + np.arange(int((high - low).max()))
    return np.where(at < high[:, None], np.take_along_axis(letters, np.minimum(at, letters.shape[1] - 1), 1), np.uint32(filler))


def _longest_block(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest common run of every pair of rows: start in a, start in b, length; the first in a, then in b, on a tie."""
    rows, width = b.shape
    run, last = np.zeros((rows, width + 1), np.int16), np.zeros((rows, width + 1), np.int16)
    size = np.zeros(rows, np.int16)
    end_a, end_b = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for i in range(a.shape[1]):
        run, last = last, run
        np.multiply(last[:, :-1] + np.int16(1), b == a[:, i:i + 1], out=run[:, 1:])
        top = run.max(1)
        better = np.flatnonzero(top > size)
        if len(better):
            size[better], end_a[better], end_b[better] = top[better], i + 1, run[better].argmax(1)
    size = size.astype(np.int64)
    return end_a - size, end_b - size, size


def matched_letters(left: list[str], right: list[str]) -> np.ndarray:
    """Letters in matching blocks of every pair: the longest common run, then likewise on both sides of it.

    All pairs advance together: each round takes the longest run of every open window and
    opens the windows before and after it.
    """
    (a, size_a), (b, size_b) = _letters(left), _letters(right)
    total = np.zeros(len(left), np.int64)
    open_ = np.stack([np.arange(len(left)), np.zeros(len(left), np.int64), size_a, np.zeros(len(left), np.int64), size_b])
    while open_.shape[1]:
        open_ = open_[:, (open_[2] > open_[1]) & (open_[4] > open_[3])]
        # Windows of like size go together, so little of a step is padding.
        open_ = open_[:, np.argsort(open_[4] - open_[3], kind="stable")]
        fresh, start = [], 0
        while start < open_.shape[1]:
            width = open_[4, start:] - open_[3, start:]
            stop = start + max(1, int(np.searchsorted(np.arange(1, len(width) + 1) * width, _AREA, "right")))
            pair, a0, a1, b0, b1 = open_[:, start:stop]
            i, j, k = _longest_block(_windows(a[pair], a0, a1, 0xFFFFFFFF), _windows(b[pair], b0, b1, 0xFFFFFFFE))
            np.add.at(total, pair, k)
            some = k > 0
            before = np.stack([pair, a0, a0 + i, b0, b0 + j])[:, some]
            after = np.stack([pair, a0 + i + k, a1, b0 + j + k, b1])[:, some]
            fresh += [before, after]
            start = stop
        open_ = np.concatenate(fresh, 1) if fresh else open_[:, :0]
    return total


def block_ratios(left: list[str], right: list[str]) -> np.ndarray:
    """The matching-blocks ratio of every pair, twice the letters in blocks over all letters; 1 for two empty texts."""
    out = np.ones(len(left))
    short = np.array([len(b) < LONG_TEXT for b in right], bool)
    for i in np.flatnonzero(~short):
        out[i] = difflib.SequenceMatcher(None, left[i], right[i]).ratio()
    at = np.array([i for i in np.flatnonzero(short) if left[i] or right[i]], np.int64)
    if len(at):
        a, b = [left[i] for i in at], [right[i] for i in at]
        out[at] = 2.0 * matched_letters(a, b) / np.array([len(x) + len(y) for x, y in zip(a, b)])
    return out


@pandas_udf(DoubleType())
def _matching_blocks_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(block_ratios(left.fillna("").tolist(), right.fillna("").tolist()))


def text_similarity(a: Column, b: Column, mode: str = "exact") -> Column:
    """0-1 likeness of two texts. `exact` is the matching-blocks ratio (Arrow batches);
    `portable` stays in the JVM and is what any SQL engine can reproduce."""
    left, right = F.lower(a), F.lower(b)
    if mode == "exact":
        return _matching_blocks_ratio(left, right)
    longest = F.greatest(F.length(left), F.length(right))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(left, right) / longest)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def marker_clash(markers_a: Column, markers_b: Column) -> Column:
    """The distinguishing words of two texts hardly coincide."""
    both = (F.size(markers_a) > 0) & (F.size(markers_b) > 0)
    return F.coalesce(F.when(both, jaccard(markers_a, markers_b) < V.MARKER_AGREEMENT), F.lit(False))


def contradicts(figures_a: Column, figures_b: Column, markers_a: Column, markers_b: Column) -> Column:
    """Two texts name different items: each has a figure the other lacks, or their
    distinguishing words hardly coincide."""
    by_figure = (F.size(F.array_except(figures_a, figures_b)) > 0) & (F.size(F.array_except(figures_b, figures_a)) > 0)
    return by_figure | marker_clash(markers_a, markers_b)


def evidence_score(tokens_a: Column, tokens_b: Column, size_a: Column, size_b: Column, markers_a: Column, markers_b: Column) -> Column:
    """Everything in the agreement score except the character term."""
    overlap = F.size(F.array_intersect(tokens_a, tokens_b)) / F.least(F.size(tokens_a), F.size(tokens_b))
    dimension = F.when(size_a.isNull() | size_b.isNull(), F.lit(0.5)).when(size_a == size_b, F.lit(1.0)).otherwise(F.lit(0.0))
    both = (F.size(markers_a) > 0) & (F.size(markers_b) > 0)
    kind = F.when(both, jaccard(markers_a, markers_b)).otherwise(F.lit(0.5))
    return 0.45 * overlap + 0.30 * dimension + 0.15 * kind


def agreement(evidence: Column, similarity: Column) -> Column:
    return round_half_up(evidence + 0.10 * similarity, 3)
