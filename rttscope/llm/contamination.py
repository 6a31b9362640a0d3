"""Benchmark decontamination: size-partitioned MinHash containment search, exactly verified.

An item is contained in a document if the document holds at least ``threshold`` of the item's
distinct word shingles.  Items are partitioned by size in powers of two.  An item's sketch is its
``k`` smallest shingle hashes (bottom-k MinHash); ``k`` is set per partition from its largest size ``u``
as u - ceil(threshold * u) + 1.  A document that lacks all ``k`` lacks too many shingles to reach the
threshold, so the search has full recall for short items in documents of any length.  (Banded
signatures of whole documents cannot do that: an item of 40 shingles in a document of 20,000
has a Jaccard similarity of 0.002.)  Documents with fewer shingles than a partition's smallest
items need take no part in it.

Candidates are verified by counting the item's shingles, as texts, in the document.

Words are runs of letters and digits, lower-cased.  Defined results: an item of fewer words than
a shingle is one shingle of all its words, an item without words or with a null id matches nothing;
a null document is empty; repeated documents and repeated items give a row each; empty tables
give an empty result.  Only the id and text columns are read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rttscope.llm.text import free_names, map_texts
from rttscope.session import materialise

WORD = re.compile(r"[^\W_]+")
SHINGLE = 5
THRESHOLD = 0.8
#: Bits of the filters that documents are probed with, whatever the number of items.
FILTER_BITS = 1 << 23


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def word_hashes(words: list[str], memo: dict) -> np.ndarray:
    """A 64-bit hash per word, remembered for words seen lately."""
    if len(memo) > 200_000:
        memo.clear()
    out = []
    for w in words:
        h = memo.get(w)
        if h is None:
            h = memo[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 7)
        out.append(h)
    return np.array(out, np.uint64)


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    total ^= total >> np.uint64(31)
    return total * np.uint64(0xBF58476D1CE4E5B9)


def sketch_size(shingles: int, threshold: float) -> int:
    """Sketch length for the partition that an item of ``shingles`` falls in."""
    largest = 1 << max(0, math.ceil(math.log2(max(shingles, 1))))
    return largest - math.ceil(threshold * largest - 1e-9) + 1


def item_shingles(items: DataFrame, shingle: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(item, content, size, m, hash, shingle, in_sketch) for every distinct shingle of every item."""
    def of(ids, texts):
        out = []
        for i, text in zip(ids, texts, strict=True):
            words = words_of(text)
            if i is None or not words:
                continue
            size = min(shingle, len(words))
            keys = shingle_hashes(word_hashes(words, {}), size).view(np.int64).tolist()
            distinct = dict(zip((" ".join(words[k : k + size]) for k in range(len(keys))), keys))
            small = set(sorted(distinct.values())[: sketch_size(len(distinct), threshold)])
            content = xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass")) - (1 << 63)
            out += [(i, content, size, len(distinct), h, t, h in small) for t, h in distinct.items()]
        return out

    kind = items.schema[id_col].dataType.simpleString()
    return map_texts(items, [id_col, text_col], f"item {kind}, content long, size int, m int, hash long, shingle string, in_sketch boolean", of)


def bit_filter(table: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of ``bits`` bits over column ``hash`` of ``table``: its size is fixed."""
    place = table.select((F.pmod("hash", F.lit(bits)) + 1).alias("p"))  # bitmap functions count from 1
    rows = place.groupBy(F.expr("bitmap_bucket_number(p)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r.bits), np.uint8)
        start = (r.bucket - 1) * len(part)
        out[start : start + len(part)] = part
    return out


def passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the bitmap."""
    place = np.mod(hashes.view(np.int64), len(bitmap) * 8)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def search(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, shingles, found, containment) for every contained item."""
    spark = docs.sparkSession
    table = materialise(item_shingles(items, shingle, threshold, item_col, item_text), "item-shingles")
    sizes = sorted(r[0] for r in table.select("size").distinct().collect())  # 1 to ``shingle``
    shared = spark.sparkContext.broadcast((bit_filter(table.where("in_sketch")), bit_filter(table)))  # 1 MB each
    memo: dict = {}

    def probe(ids, texts):
        sketches, whole = shared.value
        out = []
        for i, text in zip(ids, texts, strict=True):
            words = words_of(text)
            hashes, hits, seen, n = word_hashes(words, memo), [], set(), 0
            for size in sizes:
                keys = shingle_hashes(hashes, size)
                n = max(n, len(keys))
                at = np.flatnonzero(passes(whole, keys)) if len(keys) else []
                if len(at):
                    hits += np.unique(keys[at][passes(sketches, keys[at])]).view(np.int64).tolist()
                    seen |= {" ".join(words[k : k + size]) for k in at.tolist()}
            if hits:
                out.append((i, n, hits, list(seen)))
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    probed = map_texts(docs, [id_col, text_col], f"id {kind}, n int, hits array<long>, seen array<string>", probe, 64)
    probed = materialise(probed.withColumn("row", F.expr("uuid()")), "probed-documents")
    need = F.ceil(F.col("m") * threshold - 1e-9)
    item = ["item", "content", "m"]
    copies = table.groupBy(*item, "shingle", "hash", "in_sketch").agg(F.count("*").alias("copies"))
    candidates = probed.select("row", "id", "n", F.explode("hits").alias("hash")).join(copies.where("in_sketch").select(*item, "hash"), "hash").where(F.col("n") >= need)
    holds = probed.select("row", F.explode("seen").alias("shingle")).join(copies.select(*item, "shingle", "copies"), "shingle")
    counts = holds.groupBy("row", *item).agg(F.count("*").alias("found"), F.min("copies").alias("copies"))
    verified = candidates.select("row", "id", *item).distinct().join(counts, ["row", *item]).where(F.col("found") >= need)
    repeated = verified.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return repeated.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("m").alias("shingles"), F.col("found").cast("int").alias("found"), (F.col("found") / F.col("m")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that contain an item; a null id is told apart by its text."""
    bad_id, bad_hash = free_names(docs.columns, "bad_id", "bad_hash")
    found = search(docs.select(F.struct(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h")).alias("k"), F.col(text_col).alias("t")), items, id_col="k", text_col="t", **options)
    bad = found.select(F.col("k.i").alias(bad_id), F.col("k.h").alias(bad_hash)).distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(bad_id)) & (F.xxhash64(text_col) == F.col(bad_hash)), "left_anti")
