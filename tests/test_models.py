"""Grid trees read off the deepest one, stored models, and the order of splits."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rttscope import contract as K
from rttscope.operators import forest, metrics, models, saved_models
from rttscope.session import work_path
from rttscope.sources.readers import ContractError


@pytest.fixture(scope="module")
def final(spark):
    """Rows with classes that depend on three features and some noise, in time order by split."""
    i = F.col("id")
    noise = F.pmod(F.xxhash64(i), F.lit(97)) / 97.0
    rows = spark.range(900).select(
        i, F.concat_ws("_", i % 3, i % 2).alias("id_fluxo"), (i % 2).alias("anchor_id"), i.alias("timestamp"),
        F.when(i < 500, "treino").when(i < 700, "validacao").otherwise("teste").alias("split"),
        *[(F.pmod(F.xxhash64(i, F.lit(k)), F.lit(1000)) / 10.0).alias(f) for k, f in enumerate(K.FEATURES)])
    x = F.col(K.FEATURES[0]) + F.col(K.FEATURES[1]) * noise
    cls = F.when(x > 110, "FALHA").when((x > 60) | (F.col(K.FEATURES[2]) > 90), "RISCO").otherwise("OK")
    return rows.withColumn("alvo", cls).withColumn("classe_atual", F.lag("alvo", 1, "OK").over(Window.orderBy("timestamp"))).drop("id").cache()


def test_trees_of_less_depth_are_the_deepest_cut_off(spark, final):
    rows = final.where("split <> 'teste'")
    points = [p for p in models.candidates(("arvore_decisao",)) if p["params"]["min_samples_leaf"] == 20]
    scores, fitted = models.run_grid(rows, points=points, threads=2)
    got = {(r.candidato, r.split): r.macro_f1 for r in scores.where("fatia = 'geral'").collect()}
    assert len(got) == 2 * len(points) == 20
    ready = models.vectors(rows)
    for p in fitted:
        if p["params"]["max_depth"] not in (3, 5):
            continue
        model = models.build(p["familia"], p["params"]).fit(models.weighted(ready.where("split = 'treino'"), p["params"]["class_weight"]))
        scored = models.predicted(model, ready).select(*models.KEEP, "previsto")
        for r in metrics.sliced_scores(scored, ["split"]).where("fatia = 'geral'").collect():
            assert got[p["candidato"], r.split] == pytest.approx(r.macro_f1, abs=1e-12)


def test_bayes_points_of_one_pass_equal_single_models(spark, final):
    rows = final.where("split <> 'teste'")
    scores, fitted = models.run_grid(rows, ("naive_bayes",))
    stats = models.GaussianNB.statistics(rows.where("split = 'treino'"))
    for p in fitted:
        model = models.GaussianNB(stats, p["params"]["var_smoothing"], K.FEATURES)
        scored = models.predicted(model, rows).select(*models.KEEP, "previsto")
        want = {r.split: r.macro_f1 for r in metrics.sliced_scores(scored, ["split"]).where("fatia = 'geral'").collect()}
        got = {r.split: r.macro_f1 for r in scores.where((F.col("candidato") == p["candidato"]) & (F.col("fatia") == "geral")).collect()}
        assert got == pytest.approx(want, abs=1e-12)


def test_stored_model_scores_as_recorded_and_others_are_refused(spark, final):
    train = models.vectors(final.where("split = 'treino'"))
    fit = lambda depth: models.build("arvore_decisao", {"max_depth": depth, "min_samples_leaf": 5, "class_weight": None}).fit(models.weighted(train, None))
    paths = [work_path(spark, "model") for _ in range(2)]
    one, two = (saved_models.save(fit(d), spark, p) for d, p in zip((3, 4), paths))
    assert one != two and one.startswith("sha256:") and one == saved_models.digest(spark, paths[0])
    rows = final.where("split = 'teste'")
    recorded = models.predicted(fit(3), models.vectors(rows)).select("id_fluxo", "timestamp", F.col("previsto").alias("classe_prevista"), F.lit(one).alias("modelo_hash"))
    again = saved_models.rescored(spark, paths[0], "arvore_decisao", recorded, rows)
    assert again.join(recorded, ["id_fluxo", "timestamp", "classe_prevista"]).count() == recorded.count() == 200
    with pytest.raises(ContractError):
        saved_models.rescored(spark, paths[1], "arvore_decisao", recorded, rows)


def test_a_fit_sees_no_test_rows_and_keeps_time_order(final):
    models.time_ordered(final.where("split <> 'teste'"))
    with pytest.raises(ContractError):
        models.time_ordered(final)
    with pytest.raises(ContractError):
        models.time_ordered(final.where("split <> 'teste'").withColumn("timestamp", -F.col("timestamp")))
    with pytest.raises(ContractError):
        models.time_ordered(final.where("split = 'treino'"))


def test_every_row_is_recorded_and_rescored(spark, final, monkeypatch):
    """All splits, repeated rows and rows without a flow: one row each."""
    from rttscope.plans import queries_ml

    odd = final.where("timestamp < 20")
    rows = final.unionByName(odd).unionByName(odd.withColumn("id_fluxo", F.lit(None).cast("string")))
    monkeypatch.setattr(queries_ml, "published", lambda *_: rows)
    got = queries_ml.j16_recorded_vs_rescored(spark, None).collect()
    assert len(got) == 940 and all(r.mesmo_modelo and r.igual == (r.timestamp % 50 != 0) for r in got)
    assert sum(r.id_fluxo is None for r in got) == 20


def brute_tree(codes, label, times, tree, place, limit, least, weights):
    """{place: (feature, bin, shares)} by trying every cut of every node."""
    counts = np.array([times[label == c].sum() for c in range(3)], float)
    heavy = counts * weights
    gini = lambda w: 1 - ((w / w.sum()) ** 2).sum() if w.sum() else 0.0
    out = {place: (-1, 0, tuple(np.round(heavy / heavy.sum(), 6)))}
    if place.bit_length() - 1 >= limit or counts.sum() < 2 * least:
        return out
    best, found = 1e-9, None
    for f in forest.drawn_features(tree, np.array([place]), codes.shape[1], forest.tries(codes.shape[1]))[0]:
        for b in np.unique(codes[:, f]):
            left = codes[:, f] <= b
            parts = [np.array([times[m & (label == c)].sum() for c in range(3)], float) for m in (left, ~left)]
            if min(p.sum() for p in parts) < least:
                continue
            gain = gini(heavy) - sum((p * weights).sum() / heavy.sum() * gini(p * weights) for p in parts)
            if gain > best + 1e-9:
                best, found = gain, (int(f), int(b), left)
    if found is None:
        return out
    f, b, left = found
    out[place] = (f, b, out[place][2])
    for mask, child in ((left, 2 * place), (~left, 2 * place + 1)):
        out |= brute_tree(codes[mask], label[mask], times[mask], tree, child, limit, least, weights)
    return out


def by_place(nodes):
    out, todo = {}, [(0, 1)]
    while todo:
        k, place = todo.pop()
        n = nodes[k]
        out[place] = (int(n["indice"]), int(n["bin"]) if n["indice"] >= 0 else 0, tuple(np.round(n["pesos"].astype(float), 6)))
        if n["indice"] >= 0:
            todo += [(n["esquerda"], 2 * place), (n["direita"], 2 * place + 1)]
    return out


@pytest.mark.parametrize("least, weights", [(1, (1.0, 1.0, 1.0)), (7, (1.0, 1.0, 1.0)), (5, (0.4, 1.3, 3.0))])
def test_a_forest_tree_takes_the_best_cut_of_every_node(least, weights):
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 40, (300, 21)).astype(np.uint8)
    label = ((codes[:, 3] > 20).astype(int) + (codes[:, 7] + codes[:, 9] > 50)).astype(np.uint8)
    times = forest.copies(rng.integers(0, 1 << 62, 300).astype(np.uint64), 4)
    bag = times > 0
    nodes = forest.grow(codes[bag], label[bag], times[bag], 4, 1, 8, least, np.array(weights))
    got, want = by_place(nodes), brute_tree(codes[bag], label[bag], times[bag].astype(int), 4, 1, 8, least, np.array(weights))
    assert {p: n[:2] for p, n in got.items()} == {p: n[:2] for p, n in want.items()} and len(got) > 15
    for p, n in got.items():
        assert n[2] == pytest.approx(want[p][2], abs=1e-5)


def test_trees_of_unlike_leaves_share_the_nodes_they_cut_alike(monkeypatch):
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 40, (600, 21)).astype(np.uint8)
    label = ((codes[:, 3] > 20).astype(int) + (codes[:, 7] + codes[:, 9] > 50)).astype(np.uint8)
    times, weights, looked = rng.integers(1, 4, 600), np.array([0.4, 1.3, 3.0]), []
    draw = forest.drawn_features
    monkeypatch.setattr(forest, "drawn_features", lambda tree, places, *more: looked.append(len(places)) or draw(tree, places, *more))
    alone = [forest.grow(codes, label, times, 4, 1, 8, least, weights) for least in (5, 30)]
    apart = sum(looked)
    looked.clear()
    beside = forest.grow_beside(codes, label, times, 4, 1, 8, [5, 30], weights)
    assert [by_place(n) for n in beside] == [by_place(n) for n in alone]
    assert len(alone[0]) > len(alone[1]) > 10 and sum(looked) < apart
    for least, nodes in zip((5, 30), beside):
        want = brute_tree(codes, label, times, 4, 1, 8, least, weights)
        assert {p: n[:2] for p, n in by_place(nodes).items()} == {p: n[:2] for p, n in want.items()}


def test_kinds_of_forests_grown_in_one_pass_equal_those_grown_alone(spark):
    rng = np.random.default_rng(9)
    given = [(int(rng.integers(0, 3)), int(rng.integers(0, 1 << 62)), rng.integers(0, 20, 4).astype(np.uint8).tobytes()) for _ in range(400)]
    rows = spark.createDataFrame(given, "label int, h long, _codes binary")
    kinds = [forest.Growth(9, 30, 5, (1.0, 1.0, 1.0)), forest.Growth(9, 30, 20, (1.0, 1.0, 1.0)), forest.Growth(4, 3, 5, (0.5, 1.0, 4.0))]
    held = lambda df: {r.arvore: by_place(np.frombuffer(r.nos, forest.NODE)) for r in df.collect()}
    together = forest.grown_beside(rows, kinds, features=4)
    for kind, nodes in zip(kinds, together):
        got = held(nodes)
        assert len(got) == kind.trees and got == held(forest.grown(rows.repartition(3), kind, features=4))
    bins = spark.createDataFrame([(k, codes) for k, (_, _, codes) in enumerate(given)], "linha long, _codes binary")
    wide = {r.linha: r[1:] for r in forest.wide_sums(together[0], bins, [(9, 30), (4, 2)], features=4).collect()}
    long = {(r.linha, r.corte): r[2:] for r in forest.sums(together[0], bins, [(9, 30), (4, 2)], features=4).collect()}
    assert len(wide) == 400 and all(long[k, 0] + long[k, 1] == v for k, v in wide.items())


def scored(nodes, codes, cuts):
    return {(r.linha, r.corte): r[2:] for r in forest.sums(nodes, codes, cuts).collect()}


def test_forests_of_fewer_and_lower_trees_are_cuts_and_large_nodes_grow_alike(spark, final, monkeypatch):
    """Grown each by itself, cut off the largest one, over other partitions, or with nodes too large for a task: the same sums."""
    ready = models.vectors(final.where("split <> 'teste'"))
    train = ready.where("split = 'treino'")
    cuts = forest.thresholds(train)
    assert all(0 < len(c) < forest.BINS for c in cuts)
    rows = forest.training_rows(train, cuts)
    lines = forest.coded(ready.withColumn("linha", F.col("timestamp")), cuts, "linha")
    weights = (0.5, 1.0, 4.0)
    most = forest.Growth(12, 30, 5, weights)
    nodes = forest.grown(rows, most)
    both = scored(nodes, lines, [(12, 30), (5, 3)])
    assert len(both) == 2 * 700
    for corte, kind in enumerate((most, forest.Growth(5, 3, 5, weights))):
        alone = scored(forest.grown(rows.repartition(3), kind, local=60), lines, [(kind.trees, kind.depth)])
        for (line, _), sums in alone.items():
            assert sums == pytest.approx(both[line, corte], abs=1e-6)
    monkeypatch.setattr(forest, "HELD_NODES", 100)  # several sets of trees
    again = scored(nodes, lines, [(12, 30), (5, 3)])
    assert all(again[k] == pytest.approx(v, abs=1e-6) for k, v in both.items()) and len(again) == len(both)


def test_rows_that_a_task_can_hold_are_not_dealt_tree_by_tree(spark, monkeypatch):
    rows = spark.range(forest.LOCAL + 1).selectExpr("int(id % 3) label", "xxhash64(id) h", "unhex(concat('0', id % 3, '0', id % 7)) _codes")
    kind = forest.Growth(2, 3, 5, (1.0, 1.0, 1.0))
    alone = forest.grown_alone
    monkeypatch.setattr(forest, "grown_alone", None)
    got = {r.arvore: forest.assembled({r.lugar: np.frombuffer(r.nos, forest.NODE)}) for r in forest.grown(rows, kind, features=2).collect()}
    pieces: dict = {}
    for r in alone(rows, forest.LOCAL + 1, kind, 2, 1000).collect():
        pieces.setdefault(r.arvore, {})[r.lugar] = np.frombuffer(r.nos, forest.NODE)
    assert {t: by_place(x) for t, x in got.items()} == {t: by_place(forest.assembled(x)) for t, x in pieces.items()} and len(got) == 2


def test_the_grown_forest_is_as_good_as_the_librarys(spark, final):
    rows = final.where("split <> 'teste'")
    points = [p for p in models.candidates(("random_forest",)) if p["params"]["min_samples_leaf"] == 5]
    scores, fitted = models.run_grid(rows, points=points, threads=2)
    got = {(r.candidato, r.split): r.macro_f1 for r in scores.where("fatia = 'geral'").collect()}
    assert len(got) == 2 * len(points) == 24
    ready = models.vectors(rows)
    for p in fitted:
        if p["params"]["n_estimators"] != 100 or p["params"]["max_depth"] == 12:
            continue
        model = models.build(p["familia"], p["params"]).fit(models.weighted(ready.where("split = 'treino'"), p["params"]["class_weight"]))
        theirs = models.predicted(model, ready).select(*models.KEEP, "previsto")
        for r in metrics.sliced_scores(theirs, ["split"]).where("fatia = 'geral'").collect():
            assert got[p["candidato"], r.split] == pytest.approx(r.macro_f1, abs=0.08), (p, r)


def test_a_winning_forest_scores_as_in_the_grid(spark, final):
    rows = final.where("split <> 'teste'")
    points = [p for p in models.candidates(("random_forest",)) if p["ordem"] == 5]
    scores, fitted = models.run_grid(rows, points=points)
    model = models.refit(models.grid_table(scores, fitted), rows)
    out = models.score(model, rows)
    assert out.count() == 700 and out.where("abs(aggregate(map_values(proba), 0D, (a, x) -> a + x) - 1) > 1e-9").isEmpty()
    again = metrics.sliced_scores(out.withColumn("previsto", F.col("classe_prevista")), ["split"]).where("fatia = 'geral'")
    want = {r.split: r.macro_f1 for r in scores.where("fatia = 'geral'").collect()}
    assert {r.split: r.macro_f1 for r in again.collect()} == pytest.approx(want, abs=1e-12)
