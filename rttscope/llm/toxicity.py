"""Toxicity by maximal scoring segments of token log-odds.

Tokens get log-odds of the toxic against the clean class under a Dirichlet prior in proportion to
their count in the whole corpus.  A token's log-odds less ``MARGIN`` standard errors, less ``DRIFT``, is
its score where that is positive; every other token costs ``DRIFT``.  A linear scan finds all maximal scoring
segments of a text.  The chance of a segment's score among clean texts follows an extreme-value
law with parameters from all clean training rows, and a logistic curve turns the rarity of a
text's segments into a probability.

Toxic-class counts take a token once per context (its neighbours on both sides), so that groups
of copies count once.

Defined results: a null, empty or wordless text has no segment and gets the lowest score; repeated
rows and null ids are scored row by row; an empty table gives an empty result; with no toxic label
every text gets the lowest score.  Only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rttscope.llm.anomaly import one_label
from rttscope.llm.text import fold_remainder, map_texts
from rttscope.session import materialise

TOKEN = re.compile(r"[^\W_]+")
#: Counts are learned from at most so many labelled rows, the first by a hash of their id.
FIT_ROWS = 200_000
#: The prior weighs as much as this share of the corpus.
PRIOR = 0.05
MARGIN = 2.5
LEAST_CONTEXTS = 5
DRIFT = 0.25
SLOTS = 1 << 20
FLUSH = 200_000
MIN_SEGMENT = 1.0
#: Rarity (minus log of the chance) is binned for the logistic fit.
RARITY_BINS = 400
RARITY_MOST = 40.0
TEXT_BATCH = 64


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def digest(word: str) -> int:
    """A signed 64-bit digest of a word."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)


def labelled_sample(labels: DataFrame, modulus: int, held: int, id_col: str, fit_rows: int = FIT_ROWS) -> dict:
    """Ids and labels of the bounded training sample."""
    rows = one_label(labels, "toxic", id_col).where(fold_remainder(id_col, modulus) != held).orderBy(F.xxhash64(id_col), id_col).limit(fit_rows).collect()
    return {r[0]: int(r[1] > 0) for r in rows}


def token_counts(docs: DataFrame, sample: dict, id_col: str, text_col: str) -> DataFrame:
    """(token, toxic, clean, total): toxic counts distinct contexts, the others every place."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(sample)  # at most FIT_ROWS ids

    def run(batches):
        import pyarrow as pa

        counts, clean, toxic = Counter(), Counter(), set()

        def flush():
            words = list(counts)
            rows = [(digest(w), 0, clean[w], counts[w]) for w in words] + [(t, c, 0, 0) for t, c in toxic]
            counts.clear(), clean.clear(), toxic.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["token", "context", "clean", "total"])

        for batch in batches:
            for start in range(0, batch.num_rows, TEXT_BATCH):
                part = batch.slice(start, TEXT_BATCH)
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = tokens(text)
                    counts.update(words)
                    label = shared.value.get(i)
                    if label == 0:
                        clean.update(words)
                    elif label:
                        near = ["", *words, ""]
                        toxic.update((digest(w), digest(f"{a} {w} {b}") or 1) for a, w, b in zip(near, words, near[2:]))
                if len(counts) + len(toxic) > FLUSH:
                    yield flush()
        if counts:
            yield flush()

    cells = docs.select(id_col, text_col).mapInArrow(run, "token long, context long, clean long, total long")
    # one row per token and context first, so that a frequent token's contexts are counted in many tasks
    once = cells.groupBy("token", "context").agg(F.sum("clean").alias("clean"), F.sum("total").alias("total"))
    return once.groupBy("token").agg(F.sum((F.col("context") != 0).cast("long")).alias("toxic"), F.sum("clean").alias("clean"), F.sum("total").alias("total"))


def log_odds(counts: DataFrame, share: float = PRIOR) -> tuple[DataFrame, int, int]:
    """Log-odds with an informative Dirichlet prior, and their standard errors."""
    n = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("toxic", "clean", "total"))).first()
    if not n.toxic or not n.clean:
        return counts.sparkSession.createDataFrame([], "token long, odds double, error double, clean long"), n.toxic, n.clean
    prior = share * n.total
    a = F.col("total") * share
    t, c = F.col("toxic") + a, F.col("clean") + a
    table = counts.where(F.col("toxic") >= LEAST_CONTEXTS).select(
        "token", (F.log(t / (n.toxic + prior - t)) - F.log(c / (n.clean + prior - c))).alias("odds"), F.sqrt(1 / t + 1 / c).alias("error"), "clean"
    )
    return table, n.toxic, n.clean


class Lexicon:
    """Positive token scores in a table of fixed size, addressed by the low bits of the digest.

    Tokens whose slot is taken stand in a dictionary.
    """

    def __init__(self, rows: list):
        self.key = np.zeros(SLOTS, np.int64)
        self.value = np.zeros(SLOTS, np.float32)
        self.more: dict[int, float] = {}
        for r in rows:
            slot = r.token & (SLOTS - 1)
            if self.value[slot] > 0:
                self.more[r.token] = float(np.float32(r.score))
            else:
                self.key[slot], self.value[slot] = r.token, r.score

    def of(self, word: str) -> float:
        d = digest(word)
        slot = d & (SLOTS - 1)
        return float(self.value[slot]) if self.key[slot] == d else self.more.get(d, 0.0)


class Memo(dict):
    """Scores of words seen lately; emptied when large."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        if len(self) > FLUSH:
            self.clear()
        self[word] = score = self.lexicon.of(word)
        return score


def segments(scores: np.ndarray, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in one scan.

    ``scores`` holds positive token scores and zeros; a zero costs ``drift``.  Only the positive
    places are visited: between two of them the running sum falls by drift times the gap.
    """
    places = np.flatnonzero(scores > 0)
    # start, end, sum before, sum at the end, place of the nearest earlier entry with a smaller sum before
    stack: list[tuple[int, int, float, float, int]] = []
    total, last = 0.0, -1
    for p, s in zip(places.tolist(), scores[places].tolist(), strict=True):
        total -= drift * (p - last - 1)
        start, before, total, last = p, total, total + s, p
        end = p + 1
        # every jump takes an entry off the chain that starts at the newest one, so all jumps are linear in the places
        j = len(stack) - 1
        while j >= 0 and stack[j][2] >= before:
            j = stack[j][4]
        while j >= 0 and stack[j][3] < total:
            start, _, before, _, lower = stack[j]
            del stack[j:]
            j = lower
        stack.append((start, end, before, total, j))
    return [(a, b, after - before) for a, b, before, after, _ in stack]


def segment_table(docs: DataFrame, lexicon: Lexicon, id_col: str, text_col: str) -> DataFrame:
    """Per text: its tokens, its segments and their scores."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # SLOTS entries and the few whose slot is taken
    memo: list[Memo] = []

    def of(ids, texts):
        if not memo:
            memo.append(Memo(shared.value))
        out = []
        for i, text in zip(ids, texts, strict=True):
            words = tokens(text)
            scores = np.fromiter(map(memo[0].__getitem__, words), np.float64, len(words))
            found = [x for x in segments(scores) if x[2] >= MIN_SEGMENT] if scores.any() else []
            out.append((i, len(words), [x[0] for x in found], [x[1] for x in found], [x[2] for x in found]))
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, [id_col, text_col], f"{id_col} {kind}, n_tokens long, starts array<int>, ends array<int>, scores array<double>", of, TEXT_BATCH)


def decay(rows: list, n_clean: int, drift: float = DRIFT) -> float:
    """The positive root of the mean of exp(x * score) = 1 over clean tokens."""
    share = np.array([r.clean for r in rows], float) / max(n_clean, 1)
    score = np.array([r.score for r in rows], float)
    mean = lambda x: float((share * np.exp(np.minimum(x * score, 600))).sum() + (1 - share.sum()) * np.exp(-x * drift))
    low, high = 0.0, 4.0
    if mean(high) < 1:
        return high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    return high


def logistic(rarity: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Intercept and non-negative slope of a logistic curve over binned rows, by Newton steps."""
    a, b = 0.0, 0.0
    x = np.stack([np.ones_like(rarity), rarity])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * rarity, -30, 30)))
        gradient = x @ (toxic - n * p) - np.array([0, 1e-3]) * b
        curve = (x * (n * p * (1 - p))) @ x.T + np.diag([1e-3, 1e-3])
        step = np.linalg.solve(curve, gradient)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
    return a, max(b, 0.0)


def score(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's toxic segments, rarity and score; rows of the held-out fold are not learned from."""
    sample = labelled_sample(labels, modulus, held, id_col)
    table, _, n_clean = log_odds(materialise(token_counts(docs, sample, id_col, text_col), "token-counts"))
    lower = table.withColumn("score", F.col("odds") - MARGIN * F.col("error") - DRIFT).where("score > 0")
    rows = lower.select("token", "score", "clean").collect()  # words with LEAST_CONTEXTS toxic contexts in the bounded sample
    found = materialise(segment_table(docs, Lexicon(rows), id_col, text_col), "toxic-segments")

    learned = found.where(fold_remainder(id_col, modulus) != held).join(one_label(labels, "toxic", id_col), id_col)
    rate = decay(rows, n_clean)
    # clean places expect K * exp(-rate * score) segments a token: K from all clean segments
    seen = learned.where("label = 0").agg(F.sum("n_tokens").alias("tokens"), F.sum(F.aggregate("scores", F.lit(0.0), lambda t, s: t + 1)).alias("n")).first()
    constant = ((seen.n or 0) + 1) / ((seen.tokens or 0) + 1) * float(np.exp(rate * MIN_SEGMENT))
    best = F.coalesce(F.array_max("scores"), F.lit(0.0))
    expected = F.lit(constant) * F.greatest("n_tokens", F.lit(1)) * F.exp(-rate * best)
    # all segments count: their summed score beyond the best one's adds to the rarity
    more = F.aggregate("scores", F.lit(0.0), lambda t, s: t + s) - best
    rarity = F.when(F.size("scores") == 0, 0.0).otherwise(
        F.least(F.greatest(-F.log(F.greatest(1 - F.exp(-expected), F.lit(1e-300))), F.lit(0.0)) + rate * more, F.lit(RARITY_MOST)))
    bins = learned.select(F.floor(rarity / RARITY_MOST * RARITY_BINS).alias("bin"), "label").groupBy("bin").agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).collect()
    toxic = sum(int(r.toxic) for r in bins)
    a, b = (-30.0, 0.0) if not toxic else logistic(*(np.array(v, float) for v in zip(*((r.bin * RARITY_MOST / RARITY_BINS, r.toxic, r.n) for r in bins), strict=True)))
    return found.select(
        id_col, (fold_remainder(id_col, modulus) == held).alias("held_out"), (1 / (1 + F.exp(-(a + b * rarity)))).alias("score"),
        "n_tokens", F.size("scores").alias("n_segments"), "starts", "ends", rarity.alias("rarity"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
