import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rttscope import contract as K
from rttscope.operators import drift, quantiles
from rttscope.operators.series import series_windows


def series(spark, seed, hot=1):
    """Two flows, one with most rows; gaps longer than several chunks, chunks of one row."""
    rng = random.Random(seed)
    rows = []
    for flow, n in (("hot", 150 * hot), ("thin", 12)):
        t = 0
        for _ in range(n):
            t += rng.choice([1, 2, 3, 5, 400, 2500])
            rows.append((flow, t, rng.choice([None, 0.0, 1.0, 2.0]), rng.random() < 0.8))
    return spark.createDataFrame(rows, "flow string, ts long, x double, lost boolean")


def exprs(w):
    frame = w.rowsBetween(-11, 0)
    return {"avg12": F.avg("x").over(frame), "max3": F.max("x").over(w.rowsBetween(-2, 0)),
            "nxt": F.lead("ts").over(w), "prv": F.lag("ts").over(w)}


@pytest.mark.parametrize("seed,chunk", [(1, 10), (2, 100), (3, 1000), (4, 1), (5, 100000)])
def test_chunked_windows_equal_plain_ones(spark, seed, chunk):
    df = series(spark, seed)
    got = series_windows(df, ["flow"], ["ts"], exprs, before=11, after=1, reset=~F.col("lost"), chunk_s=chunk)
    w = Window.partitionBy("flow").orderBy("ts")
    isl = df.withColumn("isl", F.sum((~F.col("lost")).cast("int")).over(w))
    w2 = Window.partitionBy("flow", "isl").orderBy("ts")
    want = isl.withColumns({**exprs(w), "pos": F.row_number().over(w),
                            "since_reset": F.sum(F.col("lost").cast("int")).over(w2)})
    cols = ["flow", "ts", "avg12", "max3", "nxt", "prv", "pos", "since_reset"]
    a = sorted(map(str, got.select(*cols).collect()))
    b = sorted(map(str, want.select(*cols).collect()))
    assert a == b


def test_exact_quantiles_against_numpy(spark):
    rng = np.random.default_rng(7)
    groups = {"a": rng.lognormal(3, 1, 500), "b": rng.normal(0, 50, 333), "c": np.repeat(4.2, 100), "d": np.array([1.5])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {f"q{i}": p for i, p in enumerate((0, 0.1, 1 / 3, 0.5, 0.95, 0.99, 1))}
    for r in quantiles.exact_quantiles(df, ["k"], "v", probs).collect():
        assert r.n == len(groups[r.k])
        for name, p in probs.items():
            assert r[name] == pytest.approx(float(np.quantile(groups[r.k], p)), abs=1e-9)


@pytest.mark.parametrize("few", [5, 50, 100_000])
def test_quantiles_by_levels(spark, few):
    """Small limits force further levels: one bucket with many values, one value with many rows, tiny and huge values."""
    rng = np.random.default_rng(few)
    groups = {
        "narrow": 1000 + rng.random(3000) * 1e-3, "one": np.full(500, 7.25), "heavy": np.r_[np.full(900, 3.0), 3 + rng.random(100) * 1e-9],
        "wide": np.r_[rng.normal(0, 1, 200), 1e300, -1e300, 0.0, -0.0, 5e-324], "single": np.array([42.0]),
    }
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("narrow", None), ("one", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    probs = {f"q{i}": i / 8 for i in range(9)}
    got = {r.k: r for r in quantiles.exact_quantiles(df, ["k"], "v", probs, few).collect()}
    assert got.keys() == groups.keys()
    for k, v in groups.items():
        assert got[k].n == len(v)
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(float(np.quantile(v, p)), rel=1e-12, abs=1e-12)


def test_quantiles_shuffle_no_values_outside_wanted_buckets(spark):
    """A million different values in one first-level bucket: what is put in order stays below the limit."""
    df = spark.range(1_000_000).select(F.lit("k").alias("k"), (1000 + F.col("id") * 1e-6).alias("v"))
    assert df.select(quantiles.bucket_of(F.col("v")).alias("b")).distinct().count() == 1
    seen = []
    plain = quantiles._inside

    def watched(rows, open_, on, *more):
        seen.append(open_.agg(F.max("_c")).first()[0])
        return plain(rows, open_, on, *more)

    quantiles._inside = watched
    try:
        out = quantiles.exact_quantiles(df, ["k"], "v", {"m": 0.5, "p": 0.999}, 2000)
    finally:
        quantiles._inside = plain
    text = out._jdf.queryExecution().executedPlan().toString()
    assert seen == [1_000_000] and "quantile-rows" in text
    r = out.first()
    assert r.m == pytest.approx(1000.4999995, abs=1e-9) and r.p == pytest.approx(1000 + 0.999 * 999_999e-6, abs=1e-9)


@pytest.mark.parametrize("few", [4, 64, 100_000])
def test_largest_gap_by_levels(spark, few):
    rng = np.random.default_rng(few)
    pairs = {"a": (rng.normal(0, 1, 900), rng.normal(0.3, 1, 700)), "b": (5 + rng.random(400) * 1e-4, 5 + rng.random(300) ** 2 * 1e-4), "c": (np.full(50, 1.0), np.full(20, 1.0)), "d": (np.r_[np.zeros(90), 1.0], np.r_[np.zeros(10), np.ones(50)])}
    frames = [spark.createDataFrame([(k, float(x)) for k, v in pairs.items() for x in v[i]] + [("a", None)], "k string, v double") for i in (0, 1)]
    got = {r.k: r for r in quantiles.largest_gap(*frames, ["k"], "v", few).collect()}
    for k, (x, y) in pairs.items():
        grid = np.concatenate([x, y])
        gap = np.abs(np.searchsorted(np.sort(x), grid, "right") / len(x) - np.searchsorted(np.sort(y), grid, "right") / len(y)).max()
        assert (got[k].na, got[k].nb) == (len(x), len(y)) and got[k].gap == pytest.approx(gap, abs=1e-12)


def _wide(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "perda_pct double")


def psi(ref, cur, bins=10):
    edges = np.unique(np.quantile(ref, np.linspace(0, 1, bins + 1)))
    def props(x):
        c = np.bincount(np.digitize(x, edges[1:-1]), minlength=len(edges) - 1).astype(float)
        c = np.maximum(c, 1e-6)
        return c / c.sum()
    p, q = props(ref), props(cur)
    return float(((q - p) * np.log(q / p)).sum())


def test_psi_and_ks_against_numpy(spark):
    rng = np.random.default_rng(11)
    ref, cur = rng.normal(0, 1, 400), rng.normal(0.7, 1.5, 300)
    a, b = (drift.unpivot(_wide(spark, x), [], ("perda_pct",)) for x in (ref, cur))
    assert drift.psi_between(a, b, []).first().psi == pytest.approx(psi(ref, cur), rel=1e-9)
    assert drift.psi_between(a, a, []).first().psi == pytest.approx(0.0, abs=1e-12)
    grid = np.sort(np.concatenate([ref, cur]))
    gap = np.abs(np.searchsorted(np.sort(ref), grid, "right") / 400 - np.searchsorted(np.sort(cur), grid, "right") / 300)
    row = drift.ks(a, b, ["feature"]).first()
    assert row.ks == pytest.approx(gap.max(), abs=1e-12) and 0 <= row.ks_p < 0.01


def test_psi_of_a_constant_reference(spark):
    ref = drift.unpivot(_wide(spark, [2.0] * 50), [], ("perda_pct",))
    same = drift.unpivot(_wide(spark, [2.0] * 40), [], ("perda_pct",))
    moved = drift.unpivot(_wide(spark, [2.0] * 39 + [3.0]), [], ("perda_pct",))
    assert drift.psi_between(ref, same, []).first().psi == 0.0
    assert drift.psi_between(ref, moved, []).first().psi == 1.0


def test_js_and_chi_square(spark):
    row = spark.range(1).select(
        drift.js_divergence([F.lit(x) for x in (1.0, 0.0, 0.0)], [F.lit(x) for x in (0.0, 1.0, 0.0)]).alias("far"),
        drift.js_divergence([F.lit(x) for x in (0.5, 0.3, 0.2)], [F.lit(x) for x in (5.0, 3.0, 2.0)]).alias("same"),
        drift.chi_square([F.lit(x) for x in (50.0, 30.0, 20.0)], [F.lit(x) for x in (40.0, 30.0, 30.0)])[0].alias("x2"),
    ).first()
    assert row.far == pytest.approx(1.0) and row.same == pytest.approx(0.0, abs=1e-12)
    assert row.x2 == pytest.approx(100 / 50 + 0 + 100 / 20)


def test_bins_are_counted_by_a_join_and_equal_those_of_a_plain_count(spark):
    """Values on and beside edges, outside them, missing and NaN; features with one edge, without inner edges, without any; null keys."""
    edges = {"a": [0.0, 1.0, 2.5, 4.0], "b": [3.0], "c": [1.0, 2.0], "d": [float(x) for x in range(11)]}
    values = [None, float("nan"), -5.0, 0.0, 0.5, 1.0, 2.0, 2.5, 2.5000001, 3.0, 4.0, 9.0, 9.5, 10.0, 99.0]
    rows = [(k, f, v) for k in ("x", None) for f in "abcde" for v in values]
    long = spark.createDataFrame(rows, "chave string, feature string, valor double")
    table = spark.createDataFrame(list(edges.items()), "feature string, bordas array<double>")
    want = {}
    for k, f, v in rows:
        if f in edges:
            inner = edges[f][1:-1]
            b = None if v is None or v != v else 0 if len(edges[f]) < 2 else sum(e <= v for e in inner)
            want[k, f, b] = want.get((k, f, b), 0) + 1
    counted = drift.bin_counts(long, table, ["chave"])
    assert {(r.chave, r.feature, r.bin): r.c for r in counted.collect()} == want
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "element_at" not in plan and "lambda" not in plan


def test_calibration_advice_reads_its_rows_once(spark, tmp_path):
    rows = spark.range(600).selectExpr("cast(id % 12 as string) as id_fluxo", *[f"cast(id * {k + 3} % 101 as double) as {f}" for k, f in enumerate(K.FEATURES)])
    path = str(tmp_path / "rows")
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    edges = drift.bin_edges(drift.unpivot(rows, []), ["feature"])
    per_feature = drift.calibration(rows, edges)
    assert per_feature.count() == len(K.FEATURES)
    advice = drift.calibration_advice(per_feature)
    assert advice.count() == 1
    assert not [f for df in (per_feature, advice) for f in df.inputFiles() if path in f]
