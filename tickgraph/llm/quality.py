"""Quality classifier: a generalised additive model with pairwise interactions over counts of whole texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytescan as B
from .decontaminate import carried
from .labelled import remainder, sample
from ..sources.scratch import Scratch

NAMES = (
    "log_bytes log_words word_length upper digits exclaim pipes marks blanks wide short_words long_words distinct "
    "repeats near_repeats marked_words shouted_words lines line_length same_lines worst_marks worst_upper worst_pipes "
    "worst_repeats ends capital_starts"
).split()

_MARKS = np.zeros(256, bool)
_MARKS[list(b"#$%&*+<=>@\\^_`{}~")] = True
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = B.ALNUM.copy()
_LETTER[48:58] = False
_LETTER[65:91] = True


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _per_group(keys: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Distinct keys of each group."""
    if not len(keys):
        return np.zeros(groups)
    mixed = np.unique(keys ^ B.splitmix(group.astype(np.uint64)), return_index=True)[1]
    return np.bincount(group[mixed], minlength=groups)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of NAMES for each text, of the whole text; all zero but for the ends for an empty one."""
    texts = len(offsets) - 1
    size = np.diff(offsets)
    starts, ends, before = B.words_of(data, offsets, ~B.SPACE)
    words = np.diff(before)
    length = ends - starts
    of = np.repeat(np.arange(texts), words)
    lowered = B.lower_ascii(data)
    hashes = B.span_hashes(lowered, starts, ends)
    first = np.zeros(len(starts), bool)
    first[before[:-1][words > 0]] = True
    again = np.zeros(len(starts), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & ~first[1:]
    near = np.zeros(len(starts), bool)
    near[2:] = (hashes[2:] == hashes[:-2]) & (of[2:] == of[:-2])
    letters, upper, marks = _LETTER[data], _UPPER[data], _MARKS[data]
    exclaim, pipes = data == 33, data == 124
    total_marks = np.concatenate([[0], np.cumsum(marks | exclaim, dtype=np.int64)])
    total_upper = np.concatenate([[0], np.cumsum(upper, dtype=np.int64)])
    total_letters = np.concatenate([[0], np.cumsum(letters, dtype=np.int64)])
    word_marks = total_marks[ends] - total_marks[starts]
    word_upper = total_upper[ends] - total_upper[starts]
    word_letters = total_letters[ends] - total_letters[starts]
    cuts = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
    line_of = np.searchsorted(offsets, cuts[:-1], side="right") - 1 if len(cuts) > 1 else np.zeros(0, np.int64)
    line_size = np.diff(cuts)
    line_words = np.searchsorted(starts, cuts)
    lines = np.bincount(line_of, minlength=texts)
    line_hash = B.span_hashes(data, cuts[:-1], cuts[1:]) if len(cuts) > 1 else np.zeros(0, np.uint64)

    def worst(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        out = np.zeros(texts)
        np.maximum.at(out, line_of, part / np.maximum(whole, 20))
        return out

    line_letters = _sums(letters, cuts)
    n_words = _sums(np.ones(len(starts), bool), line_words)
    last = np.zeros(texts)
    full = np.flatnonzero(words > 0)
    last[full] = _ENDS[data[ends[before[full + 1] - 1] - 1]]
    columns = [
        np.log1p(size),
        np.log1p(words),
        _share(_sums(length, before), words),
        _share(_sums(upper, offsets), _sums(letters, offsets)),
        _share(_sums((data >= 48) & (data < 58), offsets), size),
        _share(_sums(exclaim, offsets), words),
        _share(_sums(pipes, offsets), words),
        _share(_sums(marks, offsets), size),
        _share(_sums(B.SPACE[data], offsets), size),
        _share(_sums(data >= 128, offsets), size),
        _share(_sums(length <= 3, before), words),
        _share(_sums(length >= 20, before), words),
        _share(_per_group(hashes, of, texts), words),
        _share(_sums(again, before), words),
        _share(_sums(near, before), words),
        _share(_sums(word_marks >= 2, before), words),
        _share(_sums((word_upper == word_letters) & (word_letters >= 2), before), words),
        np.log1p(lines),
        _share(size, lines),
        1 - _share(_per_group(line_hash, line_of, texts), lines),
        worst(_sums(marks, cuts), line_size),
        worst(_sums(upper, cuts), line_letters),
        worst(_sums(pipes, cuts), n_words),
        worst(_sums(again, line_words), n_words),
        last,
        _share(_sums(upper[starts], before), words),
    ]
    return np.stack(columns, 1).astype(np.float64) if texts else np.zeros((0, len(NAMES)))


class AdditiveModel:
    """Lookup tables of single features and of pairs, found by cyclic boosting of shallow trees on the logistic loss."""

    def __init__(self, bins: int = 32, pair_bins: int = 8, rounds: int = 80, pairs: int = 8, rate: float = 0.2, least: float = 20.0):
        self.bins, self.pair_bins, self.rounds, self.pairs, self.rate, self.least = bins, pair_bins, rounds, pairs, rate, least

    def _edges(self, x: np.ndarray, bins: int) -> list[np.ndarray]:
        return [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]

    @staticmethod
    def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)], 1)

    def _tree(self, grad: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Values per bin of a tree with up to three cuts, each the best of its part."""
        out = np.zeros(len(grad))
        parts = [(0, len(grad))]
        for _ in range(3):
            best = None
            for k, (lo, hi) in enumerate(parts):
                g, w = np.cumsum(grad[lo:hi]), np.cumsum(weight[lo:hi])
                if hi - lo < 2:
                    continue
                gain = g[:-1] ** 2 / (w[:-1] + 1) + (g[-1] - g[:-1]) ** 2 / (w[-1] - w[:-1] + 1) - g[-1] ** 2 / (w[-1] + 1)
                j = int(np.argmax(gain))
                if gain[j] > 1e-9 and (best is None or gain[j] > best[0]):
                    best = (gain[j], k, lo + j + 1)
            if best is None:
                break
            lo, hi = parts.pop(best[1])
            parts += [(lo, best[2]), (best[2], hi)]
        for lo, hi in parts:
            out[lo:hi] = grad[lo:hi].sum() / (weight[lo:hi].sum() + self.least / 4)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        self.edges, self.pair_edges = self._edges(x, self.bins), self._edges(x, self.pair_bins)
        binned, coarse = self._binned(x, self.edges), self._binned(x, self.pair_edges)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        score = np.full(len(y), self.base)

        def slopes():
            p = 1 / (1 + np.exp(-score))
            return y - p, p * (1 - p)

        for _ in range(self.rounds):
            for f, table in enumerate(self.tables):
                g, w = slopes()
                step = self.rate * self._tree(np.bincount(binned[:, f], g, len(table)), np.bincount(binned[:, f], w, len(table)))
                table += step
                score += step[binned[:, f]]
        g, w = slopes()
        gains = []
        for i in range(x.shape[1]):
            for j in range(i):
                cell = coarse[:, i] * self.pair_bins + coarse[:, j]
                gc, wc = np.bincount(cell, g, self.pair_bins**2), np.bincount(cell, w, self.pair_bins**2)
                gains.append((float((gc**2 / (wc + self.least / 4)).sum()), i, j))
        self.chosen = [(i, j) for _, i, j in sorted(gains, reverse=True)[: self.pairs]]
        self.pair_tables = [np.zeros(self.pair_bins**2) for _ in self.chosen]
        for _ in range(self.rounds // 4):
            for (i, j), table in zip(self.chosen, self.pair_tables, strict=True):
                cell = coarse[:, i] * self.pair_bins + coarse[:, j]
                g, w = slopes()
                step = self.rate * np.bincount(cell, g, len(table)) / (np.bincount(cell, w, len(table)) + self.least / 4)
                table += step
                score += step[cell]
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        binned, coarse = self._binned(x, self.edges), self._binned(x, self.pair_edges)
        for f, table in enumerate(self.tables):
            score += table[binned[:, f]]
        for (i, j), table in zip(self.chosen, self.pair_tables, strict=True):
            score += table[coarse[:, i] * self.pair_bins + coarse[:, j]]
        return 1 / (1 + np.exp(-score))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, most: int = 20_000) -> AdditiveModel:
    """The model of labels.quality, from at most `most` labelled documents, whose counts alone go to the driver."""

    def run(batches):
        for batch in batches:
            for part in B.pieces_of(batch, "text"):
                rows = features(*B.texts_of(part.column("text")))
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(NAMES), pa.int32()), pa.array(rows.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("y"), listed], ["y", "x"])

    rows = sample(docs, labels, "quality", allowed, most).select("y", "text").mapInArrow(run, "y int, x array<double>").collect()
    if not rows:
        return AdditiveModel(rounds=0).fit(np.zeros((2, len(NAMES))), np.array([0.0, 1.0]))
    x, y = np.array([r[1] for r in rows]), np.array([r[0] for r in rows], np.float64)
    order = np.lexsort((*x.T, y))
    return AdditiveModel().fit(x[order], y[order])


def score(docs: DataFrame, model: AdditiveModel, carry: list[str] | None = None) -> DataFrame:
    """(row, score): the probability of label 1 for each document, in one scan.

    Null text counts as empty and has a score as well; repeated rows are scored each; an empty table gives no rows;
    extra columns are ignored unless carried. Without any label the model is even and all scores are 0.5.
    """
    source = carried(docs, carry or ["doc_id"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in B.pieces_of(batch, "text"):
                p = shared.value.probability(features(*B.texts_of(part.column("text"))))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(p)], ["row", "score"])

    return source.mapInArrow(run, f"row {source.schema['row'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted): learned only from rows whose id's crc32 leaves another remainder than `held`."""
    rest = F.coalesce(remainder("doc_id", modulus) != held, F.lit(False))
    scored = score(docs, fit(docs, labels, rest))
    out = scored.select(F.col("row.doc_id").alias("doc_id"), "score")
    return out.select(
        "doc_id",
        F.coalesce(remainder("doc_id", modulus) == held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
