"""Quality rules judged by an isolation forest.

Fixed rules give counts per text; five ratios of them feed a forest of random splits.  A text
that few random splits set apart (a short mean path) is anomalous.  The score above which a text
is rejected comes from all labelled rows.

Defined results: a null text counts as empty; an empty or wordless text has zero counts and
fails the base rule; repeated rows and null ids are judged row by row; an empty table gives an
empty result; without labelled rows of both kinds the forest rejects nothing.  Only the id and
text columns are read, so further columns may have any name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rttscope.llm.text import SPACE, free_names, map_texts, numbered
from rttscope.session import materialise

SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = b"!?"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
RATIOS = ("mean_word", "symbols", "dup_lines", "upper", "marks")
#: Added to each denominator, so that a few marks in a short text weigh little.
SHRINK = 20
#: The forest is fitted on at most so many labelled rows, the first by a hash of their id.
FIT_ROWS = 8192
TREES = 128
SUBSAMPLE = 256
DEPTH = 8
SCORE_BINS = 2000
#: Share of labelled good rows that the calibrated threshold may reject.
GOOD_LOSS = 0.002


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` (a power of two) words that occur twice or more.

    Windows get exact ranks by doubling: the rank of 2k words is the rank of a pair of k-word ranks.
    """
    n = len(words)
    if n <= window:
        return 0
    ranks, width = numbered(words), 1
    while True:
        ranks = ranks[:-width] * np.int64(ranks.max() + 1) + ranks[width:]
        width *= 2
        _, ranks, counts = np.unique(ranks, return_inverse=True, return_counts=True)
        if counts.max() == 1:
            return 0
        if width == window:
            break
    starts = counts[ranks] > 1
    edge = np.zeros(n + 1, np.int64)
    edge[: len(starts)] += starts
    edge[window : window + len(starts)] -= starts
    return int((np.cumsum(edge)[:n] > 0).sum())


def counts_of(text: str | None) -> tuple:
    """The rule counts and the ratios of one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    size = len(raw)
    without = lambda chars: size - len(raw.translate(None, chars))
    n, chars, symbols = len(words), len(text) - without(SPACE), without(SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup, repeats = len(lines) - len(set(lines)), repeated_words(words)
    per_word, per_line = n + SHRINK, len(lines) + SHRINK / 5
    ratios = ((chars + 5 * SHRINK) / per_word, symbols / per_word, dup / per_line,
              without(UPPER) / per_word, without(MARKS) / per_word)
    return n, chars, symbols, dup, repeats, *map(float, ratios)


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"{r} double" for r in RATIOS)


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and ratios of every whole text, beside its id."""
    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, [id_col, text_col], f"{id_col} {kind}, {FIELDS}", lambda ids, texts: [(i, *counts_of(t)) for i, t in zip(ids, texts, strict=True)])


def average_path(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


class Forest:
    """Random split trees as flat arrays: node k has children 2k+1 and 2k+2.

    Each tree isolates a subsample of the good rows.  Cuts are drawn over the range of ``box``,
    which holds all labelled rows: ratios that are constant among good rows still get cuts, and
    a text in a region without good rows ends after few splits.
    """

    def __init__(self, sample: np.ndarray, box: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, depth: int = DEPTH, seed: int = 11):
        rng = np.random.default_rng(seed)
        size = 2 ** (depth + 1) - 1
        self.depth, self.subsample = depth, min(subsample, len(sample))
        self.feature = np.full((trees, size), -1, np.int16)
        self.cut = np.zeros((trees, size))
        self.path = np.zeros((trees, size))
        for t in range(trees):
            part = sample[rng.choice(len(sample), self.subsample, replace=False)]
            work = [(0, 0, part, box.min(0), box.max(0))]
            while work:
                node, level, rows, low, high = work.pop()
                open_features = np.flatnonzero(high > low)
                if level == depth or len(rows) < 2 or not len(open_features):
                    self.path[t, node] = level + average_path(len(rows))
                    continue
                f = rng.choice(open_features)
                cut = rng.uniform(low[f], high[f])
                self.feature[t, node], self.cut[t, node] = f, cut
                left, below, above = rows[:, f] <= cut, high.copy(), low.copy()
                below[f] = above[f] = cut
                work += [(2 * node + 1, level + 1, rows[left], low, below), (2 * node + 2, level + 1, rows[~left], above, high)]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly between 0 and 1; all trees are walked level by level over arrays."""
        total = np.zeros(len(rows))
        at = np.arange(len(rows))
        for t in range(len(self.feature)):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = self.feature[t, node]
                right = rows[at, np.maximum(f, 0)] > self.cut[t, node]
                node = np.where(f >= 0, 2 * node + 1 + right, node)
            total += self.path[t, node]
        return 2.0 ** (-total / len(self.feature) / max(float(average_path(self.subsample)), 1.0))


def one_label(labels: DataFrame, column: str, id_col: str = "doc_id") -> DataFrame:
    """One label per id: the larger where rows disagree; null ids and labels are left out."""
    return labels.where(F.col(id_col).isNotNull() & F.col(column).isNotNull()).groupBy(id_col).agg(F.max(column).alias("label"))


def labelled(statistics: DataFrame, labels: DataFrame, id_col: str, label_id: str) -> DataFrame:
    """``statistics`` with column ``label``; rows that the base rule rejects take no part."""
    given = one_label(labels, "quality", label_id).withColumnRenamed(label_id, "label_id")
    return statistics.where(~F.col("base_failed")).join(given, F.col(id_col) == F.col("label_id"))


def fit_forest(statistics: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_id: str = "doc_id", fit_rows: int = FIT_ROWS) -> Forest | None:
    """A forest over a bounded sample of labelled rows; None if fewer than two are good."""
    first = labelled(statistics, labels, id_col, label_id).orderBy(F.xxhash64("label_id"), "label_id", *RATIOS).limit(fit_rows).select("label", *RATIOS).toPandas()
    box = first[list(RATIOS)].to_numpy(float)
    good = box[first["label"].to_numpy() == 1]
    return Forest(good, box) if len(good) > 1 else None


def with_score(statistics: DataFrame, forest: Forest | None) -> DataFrame:
    """Adds ``anomaly`` to every row."""
    if forest is None:
        return statistics.withColumn("anomaly", F.lit(0.0))
    shared = statistics.sparkSession.sparkContext.broadcast(forest)  # TREES x 2^(DEPTH+1) nodes

    def run(frames):
        for frame in frames:
            yield frame.assign(anomaly=shared.value.scores(frame[list(RATIOS)].to_numpy(float)))

    return statistics.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in statistics.schema) + ", anomaly double")


def threshold(scored: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_id: str = "doc_id", good_loss: float = GOOD_LOSS) -> float:
    """The lowest score that rejects at most ``good_loss`` of all labelled good rows.

    Only counts per score bin reach the driver.
    """
    bins = (
        labelled(scored, labels, id_col, label_id)
        .groupBy(F.ceil(F.col("anomaly") * SCORE_BINS).alias("bin")).agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("good"), F.count("*").alias("n")).collect()
    )
    good = sum(r.good for r in bins)
    if not good or good == sum(r.n for r in bins):
        return 1.0
    kept_bad, cut = good_loss * good, SCORE_BINS
    for r in sorted(bins, key=lambda r: -r.bin):
        kept_bad -= r.good
        if kept_bad < 0:
            break
        cut = r.bin - 1
    return cut / SCORE_BINS


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", join_id: str | None = None, label_id: str = "doc_id") -> DataFrame:
    """Counts, base verdict, anomaly and final verdict for every row of ``docs``.

    ``join_id`` names the id that labels go by where ``id_col`` is a struct that holds it.
    """
    join_id = join_id or id_col
    base = rule_statistics(docs, id_col, text_col).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    )
    base = materialise(base, "rule-statistics")
    scored = materialise(with_score(base, fit_forest(base, labels, join_id, label_id)), "rule-scores")
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= threshold(scored, labels, join_id, label_id)))


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    The rejected rows are told by id and text hash, so rows of equal id but other text keep their own verdict.
    """
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    verdicts = judge(docs.select(F.struct(F.col(id_col).alias("i"), h.alias("h")).alias("rule_key"), F.col(text_col).alias("rule_text")), labels, "rule_key", "rule_text", "rule_key.i", id_col)
    i, key = free_names(docs.columns, "rejected_id", "rejected_hash")
    rejected = verdicts.where(~F.col("kept")).select(F.col("rule_key.i").alias(i), F.col("rule_key.h").alias(key)).distinct()
    return docs.join(rejected, F.col(id_col).eqNullSafe(F.col(i)) & (h == F.col(key)), "left_anti")
