"""Spark ML classifiers over the 21 features: grid, winner, scoring, explanation."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import reduce
from itertools import product
from math import log, pi

from pyspark import inheritable_thread_target
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rttscope import contract as K
from rttscope.operators import forest, metrics
from rttscope.session import materialise, remove, work_path
from rttscope.sources.readers import ContractError, require_columns

# Depth used where a grid says "no limit": the deepest tree the library grows.
DEEPEST = 30
# Histogram bins per feature when a tree looks for a cut.
MAX_BINS = 64
KEEP = ("id_fluxo", "anchor_id", "timestamp", "split", "classe_atual", "alvo")


def candidates(families=K.FAMILIES) -> list[dict]:
    """The ordered grid, simplest value of each parameter first."""
    out = []
    for family in families:
        names = list(K.GRIDS[family])
        for i, values in enumerate(product(*K.GRIDS[family].values())):
            out.append({"familia": family, "ordem": i, "params": dict(zip(names, values))})
    return out


def parameter_text(params: dict) -> str:
    """Parameters as used: a depth without limit shows the depth that trees may reach."""
    shown = {"max_depth": DEEPEST}
    return ";".join(f"{k}={shown.get(k, 'nenhum') if v is None else v}" for k, v in params.items())


def class_index(col: str) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in K.CLASSES]), F.col(col)).cast("double") - 1


def vectors(df: DataFrame, names=K.FEATURES) -> DataFrame:
    """Feature vector and numeric label; a missing or NaN feature fails the assembly."""
    require_columns(df, names, "model input")
    return VectorAssembler(inputCols=list(names), outputCol="features", handleInvalid="error").transform(
        df.withColumn("label", class_index("alvo"))
    )


def class_weights(df: DataFrame) -> dict[str, float]:
    """Balanced class weights n / (k * n_class) from one small count table."""
    counts = {r["alvo"]: r["n"] for r in df.groupBy("alvo").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    return {c: total / (len(counts) * n) for c, n in counts.items()}


def weighted(df: DataFrame, mode: str | None) -> DataFrame:
    """Rows with their class weight; without a mode all weigh the same."""
    if mode is None:
        return df.withColumn("peso", F.lit(1.0))
    pairs = [x for c, w in class_weights(df).items() for x in (F.lit(c), F.lit(w))]
    return df.withColumn("peso", F.create_map(*pairs)[F.col("alvo")])


class GaussianNB:
    """Gaussian naive Bayes with variance smoothing, fitted by one aggregate.

    Class means and variances (3 x 21 numbers) come from a single grouped pass; scoring is
    plain column arithmetic.  The largest overall feature variance times ``var_smoothing``
    is added to every variance.
    """

    def __init__(self, stats: dict, smoothing: float, names):
        self.stats, self.smoothing, self.names = stats, smoothing, names

    @classmethod
    def statistics(cls, df: DataFrame, names=K.FEATURES) -> dict:
        """Counts, means and variances per class, and the largest overall variance."""
        aggs = [F.count(F.lit(1)).alias("n")]
        for i, f in enumerate(names):
            x = F.col(f).cast("double")
            aggs += [F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
        rows = {r["alvo"]: r for r in df.groupBy("alvo").agg(*aggs).collect()}
        whole = df.agg(*[F.var_pop(F.col(f).cast("double")).alias(f"v{i}") for i, f in enumerate(names)]).first()
        return {"classes": rows, "largest": max(whole)}

    def _log_joint(self, row, total: int) -> Column:
        extra = self.smoothing * self.stats["largest"]
        out = F.lit(log(row["n"] / total))
        for i, f in enumerate(self.names):
            var = row[f"v{i}"] + extra
            shift = F.col(f).cast("double") - F.lit(row[f"m{i}"])
            out = out - F.lit(0.5 * log(2 * pi * var)) - shift * shift / F.lit(2 * var)
        return out

    def joint(self) -> Column:
        """Log joint density per class, in class order."""
        rows = self.stats["classes"]
        total = sum(r["n"] for r in rows.values())
        none = F.lit(float("-inf"))
        return F.array(*[self._log_joint(rows[c], total) if c in rows else none for c in K.CLASSES])

    def transform(self, df: DataFrame) -> DataFrame:
        joint = df.withColumn("_joint", self.joint())
        weights = F.transform("_joint", lambda x: F.exp(x - F.array_max("_joint")))
        share = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
        return joint.withColumns({
            "prediction": F.array_position("_joint", F.array_max("_joint")).cast("double") - 1,
            "probability": array_to_vector(F.transform(weights, lambda x: x / share)),
        }).drop("_joint")


def build(family: str, params: dict):
    """The Spark ML estimator of one tree, or of a forest of Spark's (the grid grows its own, see ``growth``).

    Per-tree reweighting is approximated by global class weights.
    """
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "peso"}
    depth = params["max_depth"] or DEEPEST
    tree = {"maxDepth": depth, "minInstancesPerNode": params["min_samples_leaf"], "seed": K.SEED, "maxBins": MAX_BINS}
    if family == "arvore_decisao":
        return DecisionTreeClassifier(**common, **tree)
    # a deep forest looks its rows' nodes up instead of walking every tree from its root at each level
    return RandomForestClassifier(
        **common, **tree, numTrees=params["n_estimators"], featureSubsetStrategy="sqrt", subsamplingRate=1.0,
        cacheNodeIds=depth > 10, maxMemoryInMB=1024,
    )


def growth(params: dict, weights: dict[str | None, dict]) -> forest.Growth:
    """The forest of one grid point; class weights by mode."""
    by_class = weights[params["class_weight"]]
    return forest.Growth(params["n_estimators"], params["max_depth"] or DEEPEST, params["min_samples_leaf"], tuple(by_class.get(c, 1.0) for c in K.CLASSES))


def time_order(df: DataFrame) -> DataFrame:
    """One row: last training and first validation instant, test rows present, and whether a fit is allowed."""
    row = df.agg(
        F.max(F.when(F.col("split") == "treino", F.col("timestamp"))).alias("ultimo_treino"),
        F.min(F.when(F.col("split") == "validacao", F.col("timestamp"))).alias("primeira_validacao"),
        F.count_if(F.col("split") == "teste").alias("linhas_teste"),
    )
    ordered = F.coalesce(F.col("ultimo_treino") < F.col("primeira_validacao"), F.lit(False))
    return row.withColumns({"em_ordem": ordered, "permitido": ordered & (F.col("linhas_teste") == 0)})


def time_ordered(df: DataFrame) -> None:
    """Refuse to fit when test rows are present or a training row is not older than every validation row."""
    row = time_order(df).first()
    if row["linhas_teste"]:
        raise ContractError("test rows must not be present while fitting")
    if not row["em_ordem"]:
        raise ContractError("training rows must all be older than validation rows")


def predicted(model, data: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(c) for c in K.CLASSES])
    out = model.transform(data)
    return out.withColumn("previsto", F.element_at(names, F.col("prediction").cast("int") + 1))


def side_by_side(spark, work: Callable, items: list, threads: int) -> list:
    """``work`` over items in a few threads: jobs of small fits fill the cluster together; the first error is raised."""
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), items))


def node_rows(spark, path: str) -> DataFrame:
    """The nodes of a saved tree or forest as a table, read from the model's own files.

    (arvore, no, folha, indice, limiar, esquerda, direita, linhas, pesos, classe): ``pesos`` are the weights of the
    training rows per class, ``classe`` the class index a walk that ends there predicts.
    """
    rows = spark.read.parquet(f"{path}/data")
    if "nodeData" in rows.columns:
        rows = rows.select(F.col("treeID").alias("arvore"), "nodeData.*")
    else:
        rows = rows.withColumn("arvore", F.lit(0))
    return rows.select(
        "arvore", F.col("id").alias("no"), (F.col("leftChild") < 0).alias("folha"), F.col("split.featureIndex").alias("indice"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("limiar"), F.col("leftChild").alias("esquerda"), F.col("rightChild").alias("direita"),
        F.col("rawCount").alias("linhas"), F.col("impurityStats").alias("pesos"), F.col("prediction").cast("int").alias("classe"),
    )


def walked(rows: DataFrame, nodes: DataFrame, depths: list[int], deepest: int) -> DataFrame:
    """The node each row reaches in its tree when the tree is cut at each depth: columns ``corte`` and ``classe`` are added.

    ``rows`` has the tree ``arvore`` and the features as array ``_x``; each level is one join with the node table, which is
    small.  A node's split does not depend on the depth limit, so a tree with a smaller limit is the deeper
    one cut off.
    """
    step = nodes.select("arvore", F.col("no").alias("_no"), "indice", "limiar", "esquerda", "direita")
    at = rows.withColumn("_no", F.lit(0))
    marks = {}
    for level in range(1, deepest + 1):
        goes_left = F.get("_x", F.col("indice")) <= F.col("limiar")
        to = F.when(F.col("esquerda") < 0, F.col("_no")).when(goes_left, F.col("esquerda")).otherwise(F.col("direita"))
        at = at.join(step, ["arvore", "_no"]).withColumn("_no", to).drop("indice", "limiar", "esquerda", "direita")
        if level in depths:
            marks[level] = f"_no{level}"
            at = at.withColumn(marks[level], F.col("_no"))
    # below the last level nothing moves
    cut = F.explode(F.array(*[F.struct(F.lit(d).alias("corte"), F.col(marks.get(d, "_no")).alias("no")) for d in depths]))
    reached = at.withColumn("_m", cut).select(*[c for c in rows.columns if c != "_x"], "_m.*")
    return reached.join(nodes.select("arvore", "no", "classe"), ["arvore", "no"]).drop("no")


def run_grid(final: DataFrame, families=K.FAMILIES, points: list[dict] | None = None, threads: int = 4) -> tuple[DataFrame, list]:
    """Fit every candidate on ``treino`` and score both splits.

    Each fit is a distributed job over the cached feature vectors; ``threads`` of them run side by side, and no more
    models are held at a time.  The naive Bayes points share one fit and one pass.  Of trees that differ
    in their depth limit alone only the deepest is fitted, and all of them are read off it in one pass; so are forests that
    differ in depth limit and number of trees alone, whose trees are the same, and those of equal class weights are grown
    together as long as their nodes are.  Returns the scores (``candidato``, ``split``, ``fatia``) and the candidates.
    """
    spark = final.sparkSession
    rows = final.where(F.col("split").isin("treino", "validacao"))
    time_ordered(final)
    ready = vectors(rows).persist()
    fitted = [{**p, "candidato": i} for i, p in enumerate(points if points is not None else candidates(families))]
    of = lambda family: [p for p in fitted if p["familia"] == family]
    modes = {p["params"]["class_weight"] for p in fitted if "class_weight" in p["params"]}
    weights = {m: weighted(ready.where("split = 'treino'"), m).persist() for m in {p["params"]["class_weight"] for p in of("arvore_decisao")}}
    path = work_path(spark, "grid-scores")

    def counted(scored: DataFrame, lot: str) -> None:
        metrics.sliced_scores(scored, ["candidato", "split"]).write.parquet(f"{path}/lote={lot}")

    def several(data: DataFrame, guesses: dict[int, Column]) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("candidato"), c.alias("previsto")) for i, c in guesses.items()]))
        return data.select(*KEEP, each.alias("_g")).select(*KEEP, "_g.*")

    if bayes := of("naive_bayes"):
        # the smoothing acts at scoring, so all its grid points share one fit and one pass
        stats = GaussianNB.statistics(ready.where("split = 'treino'"))
        names = F.array(*[F.lit(c) for c in K.CLASSES])
        joints = ready.withColumns({f"_j{p['candidato']}": GaussianNB(stats, p["params"]["var_smoothing"], K.FEATURES).joint() for p in bayes})
        guess = lambda c: F.get(names, F.array_position(c, F.array_max(c)).cast("int") - 1)
        counted(several(joints, {p["candidato"]: guess(F.col(f"_j{p['candidato']}")) for p in bayes}), "bayes")

    nested: dict = {}
    for p in of("arvore_decisao"):
        nested.setdefault((p["params"]["min_samples_leaf"], p["params"]["class_weight"]), []).append(p)

    def grow(group: list[dict]) -> tuple[str, int]:
        deepest = max(group, key=lambda p: p["params"]["max_depth"] or DEEPEST)["params"]
        where = work_path(spark, "grid-tree")
        model = build("arvore_decisao", deepest).fit(weights[deepest["class_weight"]])
        model.write().save(where)
        return where, model.depth

    if nested:
        grown = side_by_side(spark, grow, list(nested.values()), threads)
        trees = [node_rows(spark, where).withColumn("arvore", F.lit(k)) for k, (where, _) in enumerate(grown)]
        nodes = materialise(reduce(DataFrame.unionByName, trees), "grid-nodes")
        named = {(k, p["params"]["max_depth"] or DEEPEST): p["candidato"] for k, group in enumerate(nested.values()) for p in group}
        each = ready.select(*KEEP, vector_to_array("features").alias("_x"), F.explode(F.array(*[F.lit(k) for k in range(len(trees))])).alias("arvore"))
        found = walked(each, nodes, sorted({d for _, d in named}), max(depth for _, depth in grown))
        known = F.create_map(*[x for (k, d), i in named.items() for x in (F.lit(k * 100 + d), F.lit(i))])
        names = F.array(*[F.lit(c) for c in K.CLASSES])
        guessed = found.withColumns({"candidato": F.try_element_at(known, F.col("arvore") * 100 + F.col("corte")), "previsto": F.get(names, F.col("classe"))})
        counted(guessed.where("candidato is not null").select("candidato", *KEEP, "previsto"), "arvores")
        for where, _ in grown:
            remove(spark, where)

    woods: dict = {}
    for p in of("random_forest"):
        woods.setdefault((p["params"]["min_samples_leaf"], p["params"]["class_weight"]), []).append(p)
    if woods:
        train = ready.where("split = 'treino'")
        known = {m: class_weights(train) if m else {} for m in modes}
        cuts = forest.thresholds(train)
        coded = forest.training_rows(train, cuts)
        lines = materialise(ready.withColumn("linha", F.monotonically_increasing_id()), "forest-lines")
        codes = materialise(forest.coded(lines, cuts, "linha"), "forest-codes")

    def forest_guesses(grown: tuple[list[dict], DataFrame]) -> DataFrame:
        group, nodes = grown
        found = forest.wide_sums(nodes, codes, [(k.trees, k.depth) for k in (growth(p["params"], known) for p in group)])
        names = F.array(*[F.lit(c) for c in K.CLASSES])
        scored = lines.select("linha", *KEEP).join(found, "linha")
        return several(scored, {p["candidato"]: F.get(names, forest.prediction(f"c{i}_").cast("int")) for i, p in enumerate(group)})

    if woods:
        groups = list(woods.values())
        kinds = [[growth(p["params"], known) for p in group] for group in groups]
        most = [replace(k[0], trees=max(x.trees for x in k), depth=max(x.depth for x in k)) for k in kinds]
        grown = forest.grown_beside(coded, most, run=lambda work, items: side_by_side(spark, work, items, threads))
        counted(reduce(DataFrame.unionByName, side_by_side(spark, forest_guesses, list(zip(groups, grown)), threads)), "florestas")
    for cached in (ready, *weights.values()):
        cached.unpersist()
    return spark.read.parquet(path).drop("lote"), fitted


def grid_table(scores: DataFrame, fitted: list) -> DataFrame:
    """One row per candidate in the published layout, plus the tie-break columns."""
    spark = scores.sparkSession
    described = spark.createDataFrame(
        [(
            p["candidato"], p["familia"], parameter_text(p["params"]), p["ordem"], K.FAMILIES.index(p["familia"]),
            p["params"].get("max_depth", 0) or (DEEPEST if "max_depth" in p["params"] else 0),
            p["params"].get("n_estimators", 0), MAX_BINS if "max_depth" in p["params"] else None,
        ) for p in fitted],
        "candidato int, familia string, hiperparametros string, ordem int, simplicidade int, profundidade long, arvores int, max_bins int",
    )
    general = scores.where("fatia = 'geral'").groupBy("candidato").agg(
        F.max(F.when(F.col("split") == "treino", F.col("macro_f1"))).alias("macro_f1_treino"),
        F.max(F.when(F.col("split") == "validacao", F.col("macro_f1"))).alias("macro_f1_validacao"),
        F.max(F.when(F.col("split") == "validacao", F.col("f1_FALHA"))).alias("f1_falha_validacao"),
        F.max(F.when(F.col("split") == "validacao", F.col("recall_FALHA"))).alias("recall_falha_validacao"),
    ).withColumn("gap", F.col("macro_f1_treino") - F.col("macro_f1_validacao"))
    return described.join(general, "candidato")


def winner(grid: DataFrame) -> DataFrame:
    """Best validation macro-F1, then smaller gap, then the simpler model."""
    return grid.orderBy(
        F.desc("macro_f1_validacao"), "gap", "simplicidade", "profundidade", "arvores", "ordem"
    ).limit(1)


def refit(grid: DataFrame, final: DataFrame):
    """The winning grid point fitted once more on ``treino``: the grid keeps no models."""
    best = winner(grid).select("familia", "ordem").first()
    params = candidates((best["familia"],))[best["ordem"]]["params"]
    rows = vectors(final.where("split = 'treino'"))
    if best["familia"] == "naive_bayes":
        return GaussianNB(GaussianNB.statistics(rows), params["var_smoothing"], K.FEATURES)
    if best["familia"] == "random_forest":
        kind = growth(params, {params["class_weight"]: class_weights(rows) if params["class_weight"] else {}})
        cuts = forest.thresholds(rows)
        return forest.ForestModel(forest.grown(forest.training_rows(rows, cuts), kind), cuts, kind.trees, kind.depth)
    return build(best["familia"], params).fit(weighted(rows, params["class_weight"]))


def score(model, df: DataFrame) -> DataFrame:
    """Class and probability map by class name for each row."""
    out = predicted(model, vectors(df))
    probabilities = vector_to_array("probability")
    names = F.array(*[F.lit(c) for c in K.CLASSES])
    return out.withColumn("proba", F.map_from_arrays(names, probabilities)).withColumn(
        "classe_prevista", F.col("previsto")
    ).drop("features", "rawPrediction", "probability", "prediction", "label")


def evaluate_test(model, final: DataFrame) -> DataFrame:
    """Slice metrics of model and persistence on the test split, with the gain."""
    rows = final.where("split = 'teste'")
    mine = metrics.sliced_scores(predicted(model, vectors(rows)).select(*KEEP, "previsto"), ["split"])
    base = metrics.sliced_scores(rows.withColumn("previsto", F.col("classe_atual")), ["split"])
    return metrics.gain(mine, base, ["split", "fatia"])


# ---------------------------------------------------------------- explanation of one tree
def tree_nodes(model, names=K.FEATURES) -> list[dict]:
    """Nodes of a fitted tree: id, depth, split, children and the path text.

    A tree is a bounded object of the driver: at most 2^(depth+1) nodes.
    """
    out: list[dict] = []

    def walk(node, path, conditions):
        me = {"no": len(out), "profundidade": len(path), "caminho": " e ".join(path) or "raiz", "condicoes": conditions}
        out.append(me)
        inner = node.getClass().getSimpleName() == "InternalNode"
        me["folha"] = not inner
        if inner:
            split = node.split()
            name, limit = names[split.featureIndex()], float(split.threshold())
            me.update(feature=name, limiar=limit)
            walk(node.leftChild(), [*path, f"{name} <= {limit:.2f}"], [*conditions, (name, limit, True)])
            walk(node.rightChild(), [*path, f"{name} > {limit:.2f}"], [*conditions, (name, limit, False)])

    walk(model._call_java("rootNode"), [], [])
    return out


def node_table(model, df: DataFrame, names=K.FEATURES) -> DataFrame:
    """Real class counts of the rows reaching each node, from one scan."""
    nodes = tree_nodes(model, names)

    def reached(node):
        hits = [
            (F.col(f) <= limit) if left else (F.col(f) > limit) for f, limit, left in node["condicoes"]
        ]
        return reduce(lambda a, b: a & b, hits, F.lit(True))

    marks = F.filter(F.array(*[F.when(reached(n), F.lit(n["no"])) for n in nodes]), lambda x: x.isNotNull())
    counts = df.select("alvo", F.explode(marks).alias("no")).groupBy("no").agg(
        F.count(F.lit(1)).alias("linhas"), *[F.count_if(F.col("alvo") == c).alias(f"n_{c}") for c in K.CLASSES]
    )
    described = df.sparkSession.createDataFrame(
        [(n["no"], n["profundidade"], n["folha"], n.get("feature"), n.get("limiar"), n["caminho"]) for n in nodes],
        "no int, profundidade int, folha boolean, feature string, limiar double, caminho string",
    )
    return described.join(counts, "no", "left").na.fill(0, ["linhas", *[f"n_{c}" for c in K.CLASSES]])


def purest_leaf(nodes: DataFrame, cls: str = "FALHA") -> DataFrame:
    share = F.try_divide(F.col(f"n_{cls}"), F.col("linhas"))
    return nodes.where("folha and linhas > 0").withColumn("pureza", share).orderBy(
        F.desc("pureza"), F.desc("linhas"), "no"
    ).limit(1)


def tree_checks(nodes: DataFrame, rows: int, depth: int, names=K.FEATURES) -> DataFrame:
    """Depth limit, leaf rows adding up, and only allowed features."""
    return nodes.agg(
        (F.max("profundidade") <= depth).alias("profundidade_ok"),
        (F.sum(F.when(F.col("folha"), F.col("linhas")).otherwise(0)) == rows).alias("folhas_somam"),
        F.every(F.col("feature").isNull() | F.col("feature").isin(*names)).alias("features_ok"),
    )


def permutation_importance(model, sample: DataFrame, key: list[str], repeats: int = 3, names=K.FEATURES,
                           seed: int = K.SEED) -> DataFrame:
    """Macro-F1 lost when one feature's values are shuffled among the sampled rows.

    The sample (200 rows) is replicated once per (feature, repeat); inside each replica the
    feature's values are re-dealt by seeded ranks; one transform scores everything.
    """
    scope = ["_f", "_r"]
    base = sample.select(*key, "alvo", *names)
    copies = base.withColumn("_f", F.explode(F.array(*[F.lit(n) for n in names]))).withColumn(
        "_r", F.explode(F.sequence(F.lit(1), F.lit(repeats)))
    )
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), "_f", "_r", *key))
    place = F.row_number().over(Window.partitionBy(*scope).orderBy(*key))
    deal = F.row_number().over(Window.partitionBy(*scope).orderBy(draw, *key))
    own = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))])[F.col("_f")]
    ranked = copies.withColumns({"_place": place, "_deal": deal, "_own": own})
    dealt = ranked.select(*scope, F.col("_deal").alias("_place"), F.col("_own").alias("_new"))
    mixed = ranked.join(dealt, [*scope, "_place"]).withColumns({
        n: F.when(F.col("_f") == n, F.col("_new")).otherwise(F.col(n).cast("double")) for n in names
    })
    plain = base.withColumns({"_f": F.lit("_base"), "_r": F.lit(0)})
    cols = [*scope, "alvo", *names]
    both = mixed.select(*cols).unionByName(plain.select(*cols))
    scores = metrics.scores(metrics.confusion(predicted(model, vectors(both)), scope, "alvo", "previsto"), "zero")
    reference = scores.where("_f = '_base'").select("macro_f1").scalar()
    return scores.where("_f <> '_base'").groupBy(F.col("_f").alias("feature")).agg(
        F.avg("macro_f1").alias("_m")
    ).withColumn("importancia", reference - F.col("_m")).drop("_m")
