"""Each stage of the pipeline against a brute-force version, on given tables and on odd rows."""

from collections import Counter, defaultdict

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rttscope.llm import packing, pii, queries, simhash
from test_tables import packed_right

STAGES = dict(corpus_pipeline.STAGES)


def shingle_set(text, size=5):
    words = brute.WORDS.findall((text or "").translate(brute.ASCII_LOWER))
    return frozenset(" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def jaccard_classes(texts, least=0.8):
    """Smallest id of each component of pairs with enough similarity, by an inverted index over shingles."""
    sets = {i: shingle_set(t) for i, t in texts}
    index = defaultdict(list)
    for i, s in sets.items():
        for g in s or {""}:
            index[g].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        common = Counter(j for g in (s or {""}) for j in index[g] if j < i)
        for j, c in common.items():
            if c >= least * (len(s) + len(sets[j]) - c) - 1e-9 or sets[i] == sets[j]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_near_copies_match_brute_force(spark, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    want = jaccard_classes([(r.doc_id, r.text) for r in docs.collect()])
    got = corpus_pipeline.near_copies(spark, docs, None)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(i for i, c in want.items() if c == i)


def test_near_copies_are_found_and_others_stay(spark):
    base = [f"{a}{k}" for k in range(120) for a in "ab"]
    edit = lambda at: " ".join("zz" if k in at else w for k, w in enumerate(base))
    rows = [(1, edit(())), (2, edit((50,))), (3, edit((9, 180))), (4, edit(range(0, 240, 7))), (5, edit((50,)).upper()), (5, "other words only here"), (6, "other words only here")]
    rows += [(100 + k, edit((k,))) for k in range(60)]  # more than a small shard holds
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), None).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([rows[0], rows[3], rows[5]])


def test_spanning_forest_keeps_groups_whole():
    import numpy as np

    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**63, (6, 8), dtype=np.int64).view(np.uint64)
    values = np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 63, (20, 8)).astype(np.uint64)) for c in centres])
    a, b = simhash.grow(values, 20)
    root = brute.classes(range(len(values)), lambda i, j: int(np.bitwise_count(values[i] ^ values[j]).sum()) <= 20)
    assert len(a) == len(values) - len(set(root.values())) and all(root[i] == root[j] for i, j in zip(a.tolist(), b.tolist()))


def crowd(families, seed=3):
    """Texts of one template: two of a family at a similarity of 0.816, families mostly below 0.8."""
    import numpy as np

    rng = np.random.default_rng(seed)
    template = [f"t{k}" for k in range(400)]
    texts = []
    for f in range(families):
        places = [int(5 * p) + 2 for p in rng.permutation(79)[:14]]
        for n, at in enumerate((places[:6], places)):
            texts.append(" ".join(f"f{f}n{n if k in places[6:] else 0}k{k}" if k in at else w for k, w in enumerate(template)))
    return list(enumerate(texts))


def test_crowd_of_one_template_matches_brute_force(spark):
    texts = crowd(1000)
    sets = [{hash(g) for g in shingle_set(t)} for _, t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            c = len(s & sets[j])
            if c >= 0.8 * (len(s) + len(sets[j]) - c) - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(texts, "doc_id long, text string"), None)
    kept, want = {r.doc_id for r in got.collect()}, {i for i in range(len(sets)) if find(i) == i}
    # blocks find a pair of just the similarity with probability RECALL; a pair that no block holds stays apart
    assert want <= kept and len(kept - want) <= 2 * (1 - simhash.RECALL) * (len(sets) - len(want))


def test_large_shards_are_dealt_in_bounded_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 64)
    by_cell, largest = simhash.by_cell, []

    def watched(rows, keys, fields, found):
        largest.append(rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0)
        return by_cell(rows, keys, fields, found)

    monkeypatch.setattr(simhash, "by_cell", watched)
    texts = crowd(150)
    want = {i for i, c in jaccard_classes(texts).items() if c == i}
    got = {r.doc_id for r in corpus_pipeline.near_copies(spark, spark.createDataFrame(texts, "doc_id long, text string"), None).collect()}
    assert want <= got and len(got - want) <= 5
    assert len(largest) == 2 and max(largest) <= 4 * 64  # two chunks, dealt by a hash


def test_no_table_of_a_crowd_holds_its_pairs(spark, monkeypatch):
    texts, made = crowd(300), {}

    def watched(df, name, *more):
        out = materialise(df, name, *more)
        made[name] = max(made.get(name, 0), out.count())
        return out

    materialise = simhash.materialise
    monkeypatch.setattr(simhash, "materialise", watched)
    blocks = simhash.wide_plan(len(texts), 0.8)[2]
    corpus_pipeline.near_copies(spark, spark.createDataFrame(texts, "doc_id long, text string"), None).count()
    assert made["near-crowd-ends"] and max(n for name, n in made.items() if name.startswith("near-crowd")) <= len(texts) * blocks


def test_unlike_texts_of_a_large_shard_are_not_compared_again(spark, monkeypatch):
    by_cell, dealt = simhash.by_cell, []

    def watched(rows, keys, fields, found):
        dealt.append({r.content for r in rows.select("content").distinct().collect()})
        return by_cell(rows, keys, fields, found)

    monkeypatch.setattr(simhash, "by_cell", watched)
    line = " ".join(f"c{k}" for k in range(64))
    plain = [f"{line} " + " ".join(f"p{k}w{n}" for n in range(45)) for k in range(600)]  # shards of over 48, similarity 0.4
    texts = list(enumerate([t for _, t in crowd(100)] + plain))
    want = {i for i, c in jaccard_classes(texts).items() if c == i}
    got = {r.doc_id for r in corpus_pipeline.near_copies(spark, spark.createDataFrame(texts, "doc_id long, text string"), None).collect()}
    assert want <= got and len(got - want) <= 5
    alone = {simhash.content(t) for t in plain}
    assert len(dealt) == 2 and alone <= dealt[0] and dealt[1] - alone and len(dealt[1] & alone) < len(alone) / 4


def test_short_near_copies_match_brute_force(spark):
    texts = []  # pairs of just the similarity whose few shingles make fingerprints differ more than those of long texts
    for f in range(600):
        n = (4, 8, 9, 18, 27)[f % 5]
        words = [f"w{f}x{k}" for k in range(n + 4)]
        others = [f"z{f}y{k}" for k in range(n // 4 if n < 9 else n // 9)]
        texts += [" ".join(words), " ".join((words if n < 9 else words[: -len(others)]) + others)]
    texts = list(enumerate(texts))
    want = {i for i, c in jaccard_classes(texts).items() if c == i}
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(texts, "doc_id long, text string"), None)
    assert len(want) == 600 and {r.doc_id for r in got.collect()} == want


def test_common_shingles_are_met_in_bounded_cells(spark, monkeypatch):
    texts, links = crowd(200), simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda shards, large, most: links(shards.where("false"), large.where("false"), most))  # blocks find no pair
    want = {i for i, c in jaccard_classes(texts).items() if c == i}
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, rows, None).collect()} == want
    monkeypatch.setattr(simhash, "CELL", 64)
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, rows, None).collect()} == want


def test_quality_stage(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in queries.op6_rules(spark, sf).where("kept").collect()}
    got = corpus_pipeline.quality_rules(spark, docs, sf)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(kept)
    clash = odd.selectExpr("*", "0 rule_key", "1 rejected_id", "2 REJECTED_HASH", "3 rule_text", "4 i", "5 h")
    odd_kept = corpus_pipeline.quality_rules(spark, clash, sf)
    assert odd_kept.columns == clash.columns and not [r for r in odd_kept.collect() if brute.rule_counts(r.text)[-1]]
    assert corpus_pipeline.quality_rules(spark, none, sf).count() == 0


def test_decontamination_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {d for d, _, _ in brute.contained([(r.doc_id, r.text) for r in docs.collect()], items)}
    got = corpus_pipeline.decontamination(spark, docs, sf)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == {r.doc_id for r in docs.collect()} - bad


def test_personal_data_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    got = corpus_pipeline.personal_data(spark, docs, sf).collect()
    assert len(got) == len(before)
    for r in got:
        spans = brute.personal(before[r.doc_id])
        assert r.n_chars == len(r.text) and (spans or r.text == before[r.doc_id] or "[TERM]" in r.text or len(r.text) < len(before[r.doc_id]))
        assert sum(r.text.count(f"[{k.upper()}]") for k in pii.KINDS) >= bool(spans)


def test_whole_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    rows = corpus_pipeline.run(spark, sf).collect()
    packed_right(rows, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_stages_take_odd_and_no_rows(spark, sf, odd, none):
    for table in (odd, none):
        docs = table.withColumn("n_chars", F.length("text").cast("long")).selectExpr(
            "*", "0 bad_id", "1 bad_hash", "2 rejected_id", "3 rejected_hash", "4 near_id", "5 near_h", "6 near_copies", "7 pii_id", "8 pii_h", "9 pii_spans", "10 rule_key", "'x' id", "'y' h", "11 i", "12 t")
        names = docs.columns
        for name, stage in corpus_pipeline.STAGES[1:-1]:  # the first stage rejects most odd rows
            docs = stage(spark, docs, sf)
            assert docs.columns == names, name
        if table is none:
            assert docs.count() == 0
        else:
            ids = [r.doc_id for r in docs.collect()]
            assert len(ids) == len(set(ids)) and {0, 3, 4, 5, 6, 8, 9} <= {*ids} and not {1, 2, 7, 15} & {*ids}
        assert corpus_pipeline.best_fit_packing(spark, docs, sf).count() >= docs.count()
