"""Operators that judge one text at a time: rules, quality, toxicity, personal data, licenses."""

import time

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from rttscope.llm import anomaly, licenses, pii, quality_trees, queries, toxicity


def by_id(rows, *cols):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0), *(r[c] for c in cols)) for r in rows)


def test_rule_counts(odd, labels, none):
    got = anomaly.judge(odd, labels).collect()
    want = [(((r.doc_id is None), r.doc_id or 0), *brute.rule_counts(r.text)) for r in odd.collect()]
    assert by_id(got, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want)
    assert all(not r.kept for r in got if r.base_failed)
    assert anomaly.judge(none, labels).count() == 0


def test_rules_on_tables(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op6_rules(spark, sf).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.rule_counts(docs[r.doc_id])


def test_rules_catch_junk_and_keep_good(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op6_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {r.quality: r.kept for r in got.collect()}
    assert kept[1] > 0.99 and kept[0] < 0.6


def test_forest_isolates_an_outlier():
    rng = np.random.default_rng(0)
    good = rng.normal(0, 1, (500, 3))
    forest = anomaly.Forest(good, np.vstack([good, [[9, 9, 9]]]))
    scores = forest.scores(np.array([[0.0, 0, 0], [9, 9, 9]]))
    assert scores[1] > scores[0] + 0.2


def test_no_labels_reject_nothing(odd, labels):
    got = anomaly.judge(odd, labels.where("false")).collect()
    assert all(r.kept != r.base_failed for r in got)


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op2_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.97


def test_quality_folds_and_odd_texts(odd, labels, none):
    got = quality_trees.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (brute.crc_fold("" if r.doc_id is None else r.doc_id, 4) == 2) for r in got)
    assert quality_trees.classify(none, labels).count() == 0
    assert {r.score for r in quality_trees.classify(odd, labels.where("false")).collect()} == {0.5}


def test_held_out_labels_do_not_matter(spark, odd, labels):
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    flipped = labels.withColumn("quality", F.when(fold == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (by_id(quality_trees.classify(odd, x).collect(), "score") for x in (labels, flipped))
    assert a == b


def test_quality_statistics_and_walk_match_plain_versions(spark, sf, odd):
    docs = odd.select("doc_id", "text").union(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    rows = quality_trees.document_statistics(docs).collect()
    got = sorted((tuple(r)[1:] for r in rows))
    want = sorted(brute.quality_statistics(r.text) for r in docs.collect())
    assert np.allclose(got, want, rtol=1e-12)
    x = np.array(got)
    model = quality_trees.fit_trees(x, (np.arange(len(x)) % 3 == 0).astype(float), trees=20)
    assert np.allclose(model.probability(x), [brute.boosted(model, r) for r in x])


def test_boosting_learns_a_step():
    x = np.linspace(0, 1, 400)[:, None]
    model = quality_trees.fit_trees(x, (x[:, 0] > 0.5).astype(float), trees=20)
    assert model.probability(np.array([[0.1], [0.9]])).round() .tolist() == [0, 1]


def test_segments_match_definition():
    rng = np.random.default_rng(1)
    for _ in range(200):
        s = np.where(rng.random(30) < 0.4, rng.random(30) * 2, 0)
        real = np.where(s > 0, s, -toxicity.DRIFT)
        want, work = [], [(0, 30)]
        while work:  # the best segment, then both sides of it
            a, b = work.pop()
            best = max(((real[i:j].sum(), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0, 0, 0))
            if best[0] > 1e-9:
                want.append((best[3], best[4], round(float(best[0]), 6)))
                work += [(a, best[3]), (best[4], b)]
        got = [(a, b, round(x, 6)) for a, b, x in toxicity.segments(s)]
        assert sorted(x[2] for x in got) == pytest.approx(sorted(x[2] for x in want))
        assert {p for a, b, _ in got for p in range(a, b)} == {p for a, b, _ in want for p in range(a, b)}


def test_segment_scan_is_linear():
    # every place starts below all earlier ones, so a walk over all of them would take hours
    falling = np.zeros(4_000_000)
    falling[::20] = 1.0
    rising = np.tile([1.0, 0.0], 200_000)
    started = time.process_time()
    assert len(toxicity.segments(falling)) == 200_000 and len(toxicity.segments(rising)) == 1
    assert time.process_time() - started < 20


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op8_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n[1, 1] > 0.75 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) < 0.01 * n[0, 0]


def test_lexicon_keeps_tokens_that_share_a_slot():
    from pyspark.sql import Row

    words = [f"bad{k}" for k in range(20_000)]
    digests = [toxicity.digest(w) for w in words]
    rows = [Row(slot=d & (toxicity.SLOTS - 1), token=d, score=1.0 + k % 7, clean=0) for k, d in enumerate(digests)]
    assert len({r.slot for r in rows}) < len(rows)
    lexicon = toxicity.Lexicon(rows)
    assert [lexicon.of(w) for w in words] == [r.score for r in rows] and lexicon.of("other") == 0.0


def test_toxicity_odd_texts(odd, labels, none):
    got = toxicity.score(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (brute.crc_fold("" if r.doc_id is None else r.doc_id, 5) == 0) for r in got)
    assert toxicity.score(none, labels).count() == 0
    assert toxicity.score(odd, labels.where("false")).where("predicted = 1").isEmpty()


def test_personal_data(spark, odd, none, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op10_pii(spark, str(tmp_path)).collect()
    want = []
    for r in odd.collect():
        spans = brute.personal(r.text)
        want.append((((r.doc_id is None), r.doc_id or 0), *(sum(k == x[0] for x in spans) for k in pii.KINDS), brute.sha(brute.spans_text(spans))))
    assert by_id(got, "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want)
    assert pii.find(none).count() == 0


def test_personal_data_on_tables(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op10_pii(spark, sf).collect():
        base = brute.personal(docs[r.doc_id])
        assert r.base_sha256 == brute.sha(brute.spans_text(base)) and r.spans.startswith(brute.spans_text(base))


def test_terms_that_give_an_entity_away(spark):
    filler = "many other plain words stand here and there in this quiet little text"
    rows = [(k, f"{filler} call Zorblat at bob@mail.example.com or {k} {k + 1} {k + 2} then go on with the rest {filler}") for k in range(6)]
    rows += [(100 + k, filler + f" number{k} without anybody") for k in range(200)] + [(900, "the one named Zorblat again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.id: r.spans for r in pii.find(docs).collect()}
    text = dict(rows)
    terms = lambda i: {text[i][s.start : s.end] for s in found[i] if s.kind == "term"}
    assert "Zorblat" in terms(0) and "Zorblat" in terms(900) and not terms(105)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "Zorblat" not in clean[900] and "[EMAIL]" in clean[0] and "bob@" not in clean[0] and clean[105] == text[105]


def test_terms_match_brute_force(spark):
    d = "/root/testdata/sf0.1"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    terms = brute.disclosing_terms(docs.values(), pii.NEAR, pii.LEAST_LETTERS, pii.LEAST_CONTEXTS, pii.GENERALISE)
    want = {i: brute.term_spans(t, terms) for i, t in docs.items()}
    got = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("term:")] for r in queries.op10_pii(spark, d).collect()}
    assert any(want.values()) and got == want


def test_copies_prove_nothing(spark):
    docs = spark.createDataFrame([(k, "only Zorblat writes to bob@mail.example.com every day") for k in range(50)], "doc_id long, text string")
    assert all(s.kind == "email" for r in pii.find(docs).collect() for s in r.spans)


def test_sanitise_keeps_columns(odd):
    got = pii.sanitise(odd)
    assert got.columns == odd.columns and got.count() == odd.count()


def test_license_places(odd, none):
    got = licenses.scan(odd).collect()
    want = []
    for r in odd.collect():
        n, at = brute.license_places(r.text)
        every = [x for v in at.values() for x in v]
        want.append((((r.doc_id is None), r.doc_id or 0), n, len(every), min(every, default=-1), max(every, default=-1), ",".join(sorted(at))))
    have = sorted((((r.doc_id is None), r.doc_id or 0), r.n_words, r.n_base, -1 if r.first_word is None else r.first_word, -1 if r.last_word is None else r.last_word, r.base_labels) for r in got)
    assert have == sorted(want)
    labels = {r.doc_id: r.labels for r in got}
    assert labels[10] == "cc-by,cc-by-nc,gpl,reserved" and labels[11] == "mit" and labels[0] == ""
    assert licenses.scan(none).count() == 0


def test_every_license_of_a_line_is_found(spark):
    bsd = next(notice for label, notice in licenses.TEMPLATES if label == "bsd").split()
    lines = lambda n, end: end.join(" ".join(bsd[k : k + n]) for k in range(0, len(bsd), n))
    texts = {
        1: ("Released under the MIT License. Licensed under the Apache License, Version 2.", "apache-2.0,mit"),
        2: (lines(4, "\n"), "bsd"), 3: (lines(8, "\n\n \t\n"), "bsd"), 4: (lines(1, "\n"), "bsd"),
        5: ("other words before the notice in its first line; " * 3 + lines(3, "\n* "), "bsd"),
        6: ("licensed under cc by nc 4.0", "cc-by,cc-by-nc"), 7: ("licensed under cc by sa 4.0 and licensed under cc by nc 4.0", "cc-by,cc-by-nc,cc-by-sa"),
        8: ("licensed under\n\nthe apache\nlicense", ""), 9: (" ".join(bsd[:10]) + " " + "x " * 40 + " ".join(bsd[10:]), "bsd"), 10: (" ".join(bsd[:10]) + "\n" + "x " * 40 + "\n" + " ".join(bsd[10:]), ""),
    }
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")).collect()}
    assert got == {i: labels for i, (_, labels) in texts.items()}


def test_blocks_of_a_frequent_token_are_not_gathered(spark):
    """The given templates travel to the blocks: no shuffle by token."""
    rules = licenses.template_table(spark)
    ordered = sorted({t for r in rules.select("tokens").collect() for t in r.tokens})
    blocks = spark.range(500).selectExpr("id as row", "0 as block", "array('license', 'mit', 'released', 'the', 'under') as tokens")
    found = licenses.containment(blocks, rules, ordered)
    assert "hashpartitioning(token" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.label, r.containment) for r in found.collect()} == {("mit", 1.0)} and found.count() == 500
