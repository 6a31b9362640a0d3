"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every whole text gives fourteen statistics.  Trees are grown on binned statistics with
gradient and hessian histograms, then laid out in flat arrays; scoring walks all rows of a batch
through one level of one tree at a time.

Defined results: a null text counts as empty and is scored like any other; repeated rows and null
ids are scored row by row; an empty table gives an empty result; without labelled rows every score
is 0.5.  Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rttscope.llm.anomaly import SYMBOLS, UPPER, one_label, repeated_words
from rttscope.llm.text import SPACE, fold_remainder, map_texts
from rttscope.session import materialise

STATISTICS = ("log_words", "mean_word", "distinct_words", "symbols", "upper", "shouts", "digits", "stops", "commas",
              "wide", "lines", "dup_lines", "repeats", "longest_word")
#: The trees are fitted on at most so many labelled rows, the first by a hash of their id.
FIT_ROWS = 40_000
BINS = 64
TREES = 80
DEPTH = 5
RATE = 0.12
L2 = 2.0
LEAST_HESSIAN = 4.0
THRESHOLD = 0.7


def statistics_of(text: str | None) -> tuple[float, ...]:
    """The statistics of one whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    size, words = len(raw), raw.split()
    having = lambda chars: size - len(raw.translate(None, chars))
    n, chars = max(len(words), 1), max(len(text) - having(SPACE), 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(len(lines), 1)
    return (
        float(np.log1p(len(words))), chars / n, len(set(words)) / n, having(SYMBOLS) / n, having(UPPER) / n, having(b"!?") / n,
        having(b"0123456789") / n, having(b".") / n, having(b",;") / n, (size - len(text)) / chars, k / n,
        (len(lines) - len(set(lines))) / k, repeated_words(words) / n, float(max(map(len, words), default=0)),
    )


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, [id_col, text_col], f"{id_col} {kind}, " + ", ".join(f"{s} double" for s in STATISTICS),
                     lambda ids, texts: [(i, *statistics_of(t)) for i, t in zip(ids, texts, strict=True)])


class Trees:
    """Boosted trees in arrays of shape (tree, node); node k has children 2k+1 and 2k+2, feature -1 is a leaf."""

    def __init__(self, base: float, trees: int, depth: int):
        size = 2 ** (depth + 1) - 1
        self.base, self.depth = base, depth
        self.feature = np.full((trees, size), -1, np.int16)
        self.cut = np.zeros((trees, size))
        self.value = np.zeros((trees, size))

    def margin(self, rows: np.ndarray) -> np.ndarray:
        total, at = np.full(len(rows), self.base), np.arange(len(rows))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f >= 0, 2 * node + 1 + (rows[at, np.maximum(f, 0)] > cut[node]), node)
            total += value[node]
        return total

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(rows), -40, 40)))


def fit_trees(rows: np.ndarray, target: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Boost by levels: one histogram of gradients and hessians per node, feature and bin."""
    n, width = rows.shape
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], rows[:, f], side="left") for f in range(width)], 1)
    share = np.clip(target.mean(), 1e-3, 1 - 1e-3)
    model = Trees(float(np.log(share / (1 - share))), trees, depth)
    margin = np.full(n, model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - target, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            live = np.flatnonzero(node >= first)
            if not len(live):
                break
            cell = (((node[live] - first)[:, None] * width + np.arange(width)) * bins + binned[live]).ravel()
            g, h = (np.bincount(cell, np.repeat(v[live], width), count * width * bins).reshape(count, width, bins).cumsum(2) for v in (gradient, hessian))
            all_g, all_h = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + L2) + (all_g - g) ** 2 / (all_h - h + L2) - all_g**2 / (all_h + L2)
            gain[(h < LEAST_HESSIAN) | (all_h - h < LEAST_HESSIAN)] = 0
            for f in range(width):
                gain[:, f, len(edges[f]):] = 0
            best = gain.reshape(count, -1).argmax(1)
            f, b = best // bins, best % bins
            split = gain.reshape(count, -1)[np.arange(count), best] > 1e-3
            for k in np.flatnonzero(split):
                model.feature[t, first + k], model.cut[t, first + k] = f[k], edges[f[k]][b[k]]
            own = node[live] - first
            go = split[own]
            node[live[go]] = 2 * node[live[go]] + 1 + (binned[live[go], f[own[go]]] > b[own[go]])
        size = model.value.shape[1]
        g, h = np.bincount(node, gradient, size), np.bincount(node, hessian, size)
        model.value[t] = -RATE * g / (h + L2)
        margin += model.value[t][node]
    return model


def fit(statistics: DataFrame, labels: DataFrame, id_col: str = "doc_id", fit_rows: int = FIT_ROWS) -> Trees | None:
    """Trees over a bounded sample of the labelled rows of ``statistics``; None without any."""
    labelled = statistics.join(one_label(labels, "quality", id_col), id_col)
    first = labelled.orderBy(F.xxhash64(id_col), id_col, *STATISTICS).limit(fit_rows).select("label", *STATISTICS).toPandas()
    return fit_trees(first[list(STATISTICS)].to_numpy(float), (first["label"] > 0).to_numpy(float)) if len(first) else None


def score(statistics: DataFrame, model: Trees | None, id_col: str = "doc_id") -> DataFrame:
    """``score`` per row: the probability of label 1."""
    if model is None:
        return statistics.select(id_col, F.lit(0.5).alias("score"))
    shared = statistics.sparkSession.sparkContext.broadcast(model)  # TREES x 2^(DEPTH+1) nodes
    kind = statistics.schema[id_col].dataType.simpleString()

    def run(frames):
        for frame in frames:
            yield frame[[id_col]].assign(score=shared.value.probability(frame[list(STATISTICS)].to_numpy(float)))

    return statistics.mapInPandas(run, f"{id_col} {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all ``docs``; rows whose id falls in the held-out fold are not learned from."""
    statistics = materialise(document_statistics(docs, id_col, text_col), "quality-statistics")
    model = fit(statistics.where(fold_remainder(id_col, modulus) != held), labels, id_col)
    return score(statistics, model, id_col).select(
        id_col, (fold_remainder(id_col, modulus) == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
