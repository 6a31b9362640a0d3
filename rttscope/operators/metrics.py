"""Confusion counts and the metric conventions built on them.

One aggregate pass yields nine counters per group; everything after that is arithmetic on
one row per group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rttscope import contract as K

CELLS = [(r, p) for r in K.CLASSES for p in K.CLASSES]


def cell(real: str, pred: str) -> str:
    return f"m_{real}_{pred}"


def _total(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def confusion(df: DataFrame, keys: list[str], real: str = "alvo", pred: str = "previsto") -> DataFrame:
    """Nine counters per group: rows of real class r predicted as p."""
    return df.groupBy(*keys).agg(*[
        F.count_if((F.col(real) == r) & (F.col(pred) == p)).alias(cell(r, p)) for r, p in CELLS
    ])


def class_scores(absent: str = "skip") -> dict[str, Column]:
    """Precision, recall, F1 and support per class from the counters.

    ``absent='skip'``: a class without real rows has no scores and leaves the averages.
    ``absent='zero'``: it scores 0 and counts in the macro average.
    """
    out: dict[str, Column] = {}
    for c in K.CLASSES:
        hit = F.col(cell(c, c))
        support = _total([F.col(cell(c, p)) for p in K.CLASSES])
        called = _total([F.col(cell(r, c)) for r in K.CLASSES])
        scores = {
            "precisao": F.coalesce(F.try_divide(hit, called), F.lit(0.0)),
            "recall": F.coalesce(F.try_divide(hit, support), F.lit(0.0)),
            "f1": F.coalesce(F.try_divide(2 * hit, support + called), F.lit(0.0)),
        }
        for name, value in scores.items():
            out[f"{name}_{c}"] = F.when(support > 0, value) if absent == "skip" else value
        out[f"suporte_{c}"] = support
    return out


def macro_f1(absent: str = "skip") -> Column:
    """Average F1 over the classes, present ones only with ``skip``."""
    f1 = [F.col(f"f1_{c}") for c in K.CLASSES]
    if absent == "zero":
        return _total(f1) / len(f1)
    present = _total([F.col(f"f1_{c}").isNotNull().cast("int") for c in K.CLASSES])
    return F.try_divide(_total([F.coalesce(c, F.lit(0.0)) for c in f1]), present)


def scores(wide: DataFrame, absent: str = "skip") -> DataFrame:
    """Full metric row per group from :func:`confusion` counters."""
    out = wide.withColumns(class_scores(absent))
    n = _total([F.col(cell(r, p)) for r, p in CELLS])
    weighted = _total([
        F.coalesce(F.col(f"f1_{c}"), F.lit(0.0)) * F.col(f"suporte_{c}") for c in K.CLASSES
    ])
    return out.withColumns({
        "n": n,
        "macro_f1": macro_f1(absent) if absent == "skip" else F.when(n > 0, macro_f1(absent)),
        "f1_ponderado": F.try_divide(weighted, n),
        "acuracia": F.try_divide(_total([F.col(cell(c, c)) for c in K.CLASSES]), n),
    })


def long_matrix(wide: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (group, real class) with the predicted counts as columns."""
    rows = F.array(*[
        F.struct(F.lit(r).alias("real"), *[F.col(cell(r, p)).alias(f"prev_{p}") for p in K.CLASSES])
        for r in K.CLASSES
    ])
    return wide.select(*keys, F.inline(rows))


def dominant_anchor(df: DataFrame, keys: list[str], real: str = "alvo") -> DataFrame:
    """Per group the anchor with most FALHA rows (ties: smallest id as text) and its share."""
    by_anchor = df.where((F.col(real) == "FALHA") & F.col("anchor_id").isNotNull()).groupBy(
        *keys, F.col("anchor_id").cast("string").alias("anchor_id")
    ).agg(F.count(F.lit(1)).alias("c"))
    best = F.min(F.struct((-F.col("c")).alias("neg"), F.col("anchor_id").alias("id")))
    return by_anchor.groupBy(*keys).agg(best.alias("_best"), F.sum("c").alias("_all")).select(
        *keys, F.col("_best.id").alias("anchor_dominante"),
        (-F.col("_best.neg") / F.col("_all")).alias("fracao_dominante"),
    )


def _sliced_counts(df: DataFrame, keys: list[str], real: str, pred: str, now: str) -> DataFrame:
    """One row per group with a struct of nine counters per slice.

    Rows are counted once per (group, anchor), combined in each task before the shuffle; the slice
    without the dominant anchor is the general slice less that anchor's counters, so no row is
    replicated or joined.
    """
    r, c = F.col(real), F.col(now)
    inside = {"geral": F.lit(True), "transicoes": c != r, "inicio_falha": (c != "FALHA") & (r == "FALHA")}
    names = [(s, a, b) for s in inside for a, b in CELLS]
    per_anchor = df.groupBy(*keys, F.col("anchor_id").cast("string").alias("_anchor")).agg(*[
        F.count_if(inside[s] & (r == a) & (F.col(pred) == b)).alias(f"{s}_{cell(a, b)}") for s, a, b in names
    ], F.count_if(r == "FALHA").alias("_falhas"))
    own = F.struct(*[F.col(f"geral_{cell(a, b)}").alias(cell(a, b)) for a, b in CELLS])
    rank = F.struct((-F.col("_falhas")).alias("neg"), F.col("_anchor").alias("id"), own.alias("own"))
    total = per_anchor.groupBy(*keys).agg(
        *[F.sum(f"{s}_{cell(a, b)}").alias(f"{s}_{cell(a, b)}") for s, a, b in names],
        F.min(F.when((F.col("_falhas") > 0) & F.col("_anchor").isNotNull(), rank)).alias("_top"),
    )
    def of(slice_):
        if slice_ in inside:
            return [F.col(f"{slice_}_{cell(a, b)}") for a, b in CELLS]
        return [F.col(f"geral_{cell(a, b)}") - F.coalesce(F.col("_top.own")[cell(a, b)], F.lit(0)) for a, b in CELLS]

    return total.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(s).alias("fatia"), *[x.alias(cell(a, b)) for x, (a, b) in zip(of(s), CELLS)]) for s in K.SLICES
    ])))


def sliced_scores(df: DataFrame, keys: list[str], real="alvo", pred="previsto", now="classe_atual",
                  absent="skip") -> DataFrame:
    """Metric row per (group, slice); a slice without rows appears with n = 0."""
    return scores(_sliced_counts(df, keys, real, pred, now), absent)


def gain(model: DataFrame, persistence: DataFrame, keys: list[str]) -> DataFrame:
    """Macro-F1 gain over persistence; undefined on transitions, where persistence is 0."""
    right = persistence.select(*keys, F.col("macro_f1").alias("macro_f1_persistencia"))
    return model.join(right, keys, "left").withColumn(
        "ganho", F.when(F.col("fatia") != "transicoes", F.col("macro_f1") - F.col("macro_f1_persistencia"))
    )


def proportions(col: str) -> list[Column]:
    """Share of each class in a group, zero where absent."""
    return [
        F.coalesce(F.avg((F.col(col) == c).cast("double")), F.lit(0.0)).alias(f"prop_{c}")
        for c in K.CLASSES
    ]


def metric_flags(rows: DataFrame) -> DataFrame:
    """Warning flags per (candidate, slice) metric row joined with its gain.

    Expects ``macro_f1_treino``, ``macro_f1``, ``gap``, ``ganho``, ``recall_falha`` and
    ``fracao_dominante``.
    """
    def sure(c):
        return F.coalesce(c, F.lit(False))

    general = F.col("fatia") == "geral"
    return rows.withColumns({
        "sobreajuste": sure(general & (F.col("gap") > K.OVERFIT_GAP)),
        "fraco": sure(general & (F.col("macro_f1_treino") < K.LOW_MACRO_F1) & (F.col("macro_f1") < K.LOW_MACRO_F1)),
        "recall_baixo": sure(general & (F.col("recall_falha") < K.LOW_FAIL_RECALL)),
        "inicio_baixo": sure((F.col("fatia") == "inicio_falha") & (F.col("recall_falha") < K.LOW_ONSET_RECALL)),
        "ganho_pequeno": sure(general & (F.col("ganho") < K.SMALL_GAIN)),
        "depende_de_anchor": sure(
            (F.col("fatia") == "sem_anchor_dominante")
            & ((F.col("fracao_dominante") > K.DOMINANT_SHARE) | sure(F.col("ganho") < K.SMALL_GAIN))
        ),
        "pior_que_persistencia": sure((F.col("fatia") != "transicoes") & (F.col("ganho") < 0)),
    })


def test_flags(rows: DataFrame) -> DataFrame:
    """Warning flags per slice of the test split.

    Expects ``fatia``, ``macro_f1``, ``ganho``, ``recall_falha`` and ``macro_f1_validacao``, the general macro-F1
    on the validation split.
    """
    def sure(c):
        return F.coalesce(c, F.lit(False))

    general = F.col("fatia") == "geral"
    return rows.withColumns({
        "queda_no_teste": sure(general & (F.col("macro_f1_validacao") - F.col("macro_f1") > K.TEST_DROP)),
        "ganho_pequeno": sure(general & (F.col("ganho") < K.SMALL_GAIN)),
        "inicio_baixo": sure((F.col("fatia") == "inicio_falha") & (F.col("recall_falha") < K.LOW_ONSET_RECALL)),
        "pior_que_persistencia": sure((F.col("fatia") != "transicoes") & (F.col("ganho") < 0)),
    })
