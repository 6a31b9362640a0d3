"""Operators over whole tables: containment, urls, packing, chats, near copies."""

import duckdb
import brute
import numpy as np
import pytest
import zlib
from pyspark.sql import functions as F

from rttscope.llm import chat, contamination, packing, queries, simhash, url_rules
from rttscope.llm.components import components


def docs_of(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def test_containment_matches_brute_force(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id, r.found) for r in queries.op1_contamination(spark, sf).collect()}
    assert got == brute.contained(docs_of(spark, sf), items) and got


def test_containment_of_odd_rows(spark, odd, none):
    words = [f"v{k}" for k in range(40)]
    text = " ".join(words)
    near = " ".join(w if k not in (20,) else "zz" for k, w in enumerate(words))
    docs = odd.select("doc_id", "text", F.lit(1).alias("item_id"), F.lit("x").alias("row")).union(
        spark.createDataFrame([(50, f"long {'pad ' * 9000}{text} {'pad ' * 9000}", 1, "x"), (51, near, 1, "x"), (52, " ".join(words[:25]), 1, "x"), (52, text.upper(), 1, "x")], "doc_id long, text string, item_id int, row string"))
    items = [(1, text), (1, text), (2, "one"), (3, None), (4, ""), (None, text), (5, "tie tie tie"), (6, "quick brown fox jumps over the lazy dog the")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = contamination.search(docs, table).collect()
    want = brute.contained([(r.doc_id, r.text) for r in docs.collect()], [i for i in items if i[0] is not None])
    assert {(r.doc_id, r.item_id, r.found) for r in got} == want
    assert sum(r.item_id == 1 and r.doc_id == 50 for r in got) == 2  # the item is there twice
    assert contamination.search(none, table).count() == 0 and contamination.search(odd, table.where("false")).count() == 0
    clash = docs.selectExpr("*", "0 bad_id", "1 bad_hash", "2 k", "3 t")
    kept = contamination.clean(clash, table)
    assert kept.columns == clash.columns and {50, 51} .isdisjoint({r.doc_id for r in kept.collect()})


def test_sketch_loses_no_item():
    rng = np.random.default_rng(3)
    for m in range(1, 130):
        k = contamination.sketch_size(m, 0.8)
        assert k > m - int(np.ceil(0.8 * m - 1e-9)) or k >= m


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    res = con.execute(queries.ORACLE[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(repr, res.fetchall()))


def test_odd_urls(spark):
    urls = [None, "", "no scheme/com/", "http://A.Example.COM/en/x?y#z", "http://www.example.com/en/", "http://example.com", "x://com/", "://com", "http://com?/", "http://notexample.com/en/",
            "http://net/es/#", "http://a.net/ES/", "ftp://b.c.net/fr/" + "p/" * 3000, "http://" + "a." * 3000 + "net/es/", "http://x.com://y.net/es/"]
    pages = spark.createDataFrame([(i, u, "rule") for i, u in enumerate(urls + urls[:4])], "page_id long, url string, rule string")
    rules = spark.createDataFrame([*queries.URL_RULES, (None, "/", "block"), ("org", "", "block"), ("com", "/", "allow")], "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, rules).collect()}
    for i, u in enumerate(urls + urls[:4]):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = "".join(__import__("itertools").takewhile(lambda c: c not in "/?#", rest))
        path = "".join(__import__("itertools").takewhile(lambda c: c not in "?#", rest[len(host):]))
        host = host.translate(brute.ASCII_LOWER)
        fit = [(h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fit, key=lambda x: len(x[0]), default=(None, "allow"))
        assert got[i] == (host, path, *rule)
    assert url_rules.judge(pages.where("false"), rules).count() == 0
    assert {r.verdict for r in url_rules.judge(pages, rules.where("false")).collect()} == {"allow"}


def packed_right(rows, texts, capacity=2048):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for i, t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k, a in enumerate(range(0, len(ids), capacity)):
            cut = ids[a : a + capacity]
            want.append((i is None, i or 0, k, a, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    used = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
        assert used[r.sequence_id] <= capacity
    return len(used), sum(w[4] for w in want)


def test_packing_round_trip(spark, sf, odd, none):
    n, tokens = packed_right(queries.op4_packing(spark, sf).collect(), docs_of(spark, sf))
    assert n <= 1.05 * tokens / 2048 + 2
    more = spark.createDataFrame([(70, "<|endoftext|> a<|startoftext|>b"), (71, "\u03a3\u0399\u03a3 \u0308x \u0130I \u1112\u1161 don't they'll 12 34"), (72, "a\r\nb\tc\u00a0d\u3000e")], "doc_id long, text string")
    rows = odd.select("doc_id", "text").union(more)
    packed_right(packing.pack(rows, queries.tokenizer_path()).collect(), [tuple(r) for r in rows.collect()])
    assert packing.pack(none, queries.tokenizer_path()).count() == 0


def test_ids_of_every_script(spark):
    """Random parts of letters of all scripts, marks and breaks against the tokenizer itself."""
    rng = np.random.default_rng(11)
    letters = [chr(c) for c in range(0x41, 0x1E900) if chr(c).isalpha()]
    marks = list("!\"#$%&()*+,-./:;=>?@[]^_`{|}~'<") + ["\u0307", "\u0301", "\u0308", "\u200d", "\u00b7", "1", "\u0663"]
    breaks = [" ", "\n", "\t", "\r\n", "\u00a0", "\u3000", "\u0085"]
    parts = []
    for _ in range(6000):
        kind = rng.integers(4)
        pool = ["\u0130", "i", "S", "\u03a3", "\u1e9e", "\u01c5", "\ufb01"] if kind == 0 else [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()] if kind == 1 else letters
        word = "".join(pool[k] for k in rng.integers(0, len(pool), rng.integers(1, 5)))
        side = lambda: "".join(marks[k] for k in rng.integers(0, len(marks), rng.integers(0, 3)))
        parts.append(side() + word + side() + breaks[rng.integers(len(breaks))])
    texts = [(k, "".join(parts[k * 3 : k * 3 + 3])) for k in range(2000)] + [(9001, "\u0130> \u0130_ x\u0130! \u0130\u0130[")]
    table = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 piece", "2 start", "3 unit", "4 sequence_id", "5 offset")
    packed_right(packing.pack(table, queries.tokenizer_path()).collect(), texts)


def test_bins_place_in_the_fullest():
    bins = packing.Bins(100, 2, 0)
    assert [bins.place(s) for s in (50, 60, 40, 30)] == [(0, 0), (1, 0), (1, 60), (0, 50)]
    assert bins.place(90) == (2, 0) and bins.place(80) == (3, 0)  # two are open; the fullest of three closes
    assert bins.open == 2


def test_reply_trees(spark):
    rows = [("c", 1, None, "user", "hi", 0.0), ("c", 2, 1, "assistant", "low", 1.0), ("c", 3, 1, "assistant", "high [x]\\e<|end|>", 5.0), ("c", 4, 3, "user", None, 0.0),
            ("c", 5, 2, "user", "tie", 4.0), ("d", 1, 9, None, "orphan", None), ("e", 1, 2, "user", "cycle", 0.0), ("e", 2, 1, "user", "cycle", 0.0), (None, 1, None, "sys\ntem", "x", 0.0)]
    table = spark.createDataFrame(rows, "conv_id string, msg_id long, parent long, role string, text string, score double").withColumn("leaf", F.lit(0))
    got = {(r.conv_id, r["rank"]): [(t.role, t.text, t.loss) for t in r.turns] for r in chat.read_back(chat.formatted(table, branches=2)).collect()}
    assert got["c", 1] == [("user", "hi", False), ("assistant", "high [x]\\e<|end|>", True), ("user", "", False)]  # equal means: the smaller leaf id
    assert got["c", 2] == [("user", "hi", False), ("assistant", "low", True), ("user", "tie", False)]
    assert got["d", 1] == [("", "orphan", False)] and got[None, 1] == [("sys\ntem", "x", False)]
    assert not any(k[0] == "e" for k in got)
    assert chat.formatted(table.where("false")).count() == 0


def test_long_chain_with_ties(spark):
    rows = [(1, k // 2, "user" if k % 2 else "assistant", f"t{k}") for k in range(700)] + [(2, 0, "user", "same")] * 3
    got = {r.conv_id: r.turns for r in chat.read_back(chat.formatted(chat.reply_chain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()}
    assert [t.text for t in got[1]] == [r[3] for r in sorted(rows[:700], key=lambda r: r[1:4])] and [t.text for t in got[2]] == ["same"] * 3


def test_simhash_matches_brute_force(spark, sf):
    texts = docs_of(spark, sf)
    prints = {i: brute.fingerprint(t) for i, t in texts}
    want = brute.classes(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = queries.op9_simhash(spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_simhash_of_odd_rows(odd, none):
    got = simhash.group(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        text = next(x.text for x in odd.collect() if x.doc_id == r.doc_id) if r.doc_id is not None else None
        if r.doc_id is not None:
            assert r.fp % (1 << 64) == brute.fingerprint(text)
    assert {r.component for r in got if r.doc_id in (0, 1, 2)} == {0} and {r.component for r in got if r.doc_id in (14, 15)} == {14}
    assert simhash.group(none).count() == 0


@pytest.mark.parametrize("shard", [4, 20_000])
def test_tree_search_finds_every_link(spark, shard):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    near = [b ^ (1 << int(p)) ^ (1 << int(q)) for b in base.tolist() for p, q in rng.integers(0, 62, (12, 2))]
    values = sorted({*base.tolist(), *near})
    links = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), 4, shard)
    roots = {r.node: r.root for r in components(links, "a", "b").collect()}
    want = brute.classes(values, lambda a, b: (a ^ b).bit_count() <= 4)
    assert {v: roots.get(v, v) for v in values} == want


def test_large_shards_are_divided_into_bounded_cells(spark):
    rng = np.random.default_rng(8)
    mask = np.int64(~0x1FFF)  # all rows agree in the first block
    base = rng.integers(-(2**63), 2**63, 100_000, dtype=np.int64) & mask
    pairs = [(b, b ^ sum(1 << int(p) for p in places)) for b, places in zip(base[:300].tolist(), (13 + rng.permuted(np.tile(np.arange(50), (300, 1)), axis=1))[:, :4])]
    rows = spark.createDataFrame([(v,) for v in {*base.tolist(), *(x for _, x in pairs)}], "fp long")
    bound = 1_000
    sizes = simhash.cells(rows, 4, bound).groupBy(*simhash.CELL_KEYS).count().agg({"count": "max"}).first()[0]
    assert sizes <= bound
    roots = {r.node: r.root for r in components(simhash.links(rows, 4, bound), "a", "b").collect()}
    assert all(roots[a] == roots[x] for a, x in pairs)


def test_trees_split_on_tables(spark, monkeypatch):
    d = "/root/testdata/sf0.1"
    prints = simhash.fingerprints(spark.read.parquet(f"{d}/documents.parquet")).select("fp").distinct()
    shards = {}
    for r in simhash.cells(prints).collect():
        shards.setdefault(tuple(r)[:-1], []).append(r.fp)
    sides = []
    monkeypatch.setattr(simhash, "across", lambda values, left, right, *rest, plain=simhash.across: (sides.append(left is right), plain(values, left, right, *rest)))
    for rows in shards.values():
        simhash.search(np.array(rows, np.int64).view(np.uint64), 4, simhash.Forest(len(rows)))
    assert not all(sides)  # rows on both sides of a border were compared


def test_components_of_chains_and_stars(spark):
    pairs = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert {got[k] for k in range(301)} == {0} and {got[k] for k in range(1000, 1300)} == {1000} and 5000 not in got
