"""SimHash near-duplicates by vantage-point trees over sharded fingerprints.

Texts become 64-bit fingerprints of their word shingles.  Distinct fingerprints are cut into as
many bit blocks as the radius plus one: two fingerprints within the radius agree in at least one
block, which is a distance of zero in that block's projection, so shards by block value miss no
pair.  A shard is searched by a vantage-point tree: its rows are split at the median Hamming distance
from a vantage point, both halves are searched apart, and only rows within the radius of the border
(by the triangle inequality no others can link) are compared across.  A shard larger than
``SHARD`` is divided before: by the bits outside its block, cut once more into radius + 1 parts of which linked rows
share one, and a piece that is still too large by its rows' distances to two vantage points; a row is
home in one ring cell and a guest in the cells whose rings it overlaps.

Each shard returns a spanning forest of its links; components of all forests join the documents.

Defined results: a null text counts as empty; texts without words have fingerprint zero and link
like any other; repeated rows keep their rows; null ids take part but never name a component unless
all its ids are null; an empty table gives an empty result.  Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rttscope.llm.components import components
from rttscope.llm.text import free_names, map_texts
from rttscope.session import materialise

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
#: Rows of a shard that one group searches.
SHARD = 20_000
#: Rows that a tree compares without a further split.
LEAF = 8
CELL_KEYS = ["block", "value", "part", "piece", "ring1", "ring2"]
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of lower-cased words, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle, len(words))
    starts = [0, *(ends[: len(words) - k] + 1).tolist()]
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    return np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, len(words) - k + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half the hashes."""
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 8192):
        part = hashes[start : start + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, [id_col, text_col], f"{id_col} {kind}, fp long",
                     lambda ids, texts: [(i, signed(fingerprint(shingle_hashes(t, shingle)))) for i, t in zip(ids, texts, strict=True)])


class Forest:
    """Labels of a shard's rows; links merge them, and each merge that joins two trees is kept."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            la, lb = self.label[a], self.label[b]
            differ = la != lb
            if not differ.any():
                return
            a, b, low, high = a[differ], b[differ], np.minimum(la, lb)[differ], np.maximum(la, lb)[differ]
            np.minimum.at(self.label, high, low)
            while True:
                shorter = self.label[self.label]
                if (shorter == self.label).all():
                    break
                self.label = shorter


def across(values: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int, forest: Forest) -> None:
    """Link rows of ``left`` with rows of ``right`` (places in ``values``), block by block."""
    if not len(left) or not len(right):
        return
    step = max(1, 2_000_000 // max(1, len(right)))
    for start in range(0, len(left), step):
        part = left[start : start + step]
        if (forest.label[part] == forest.label[right[0]]).all() and (forest.label[right] == forest.label[right[0]]).all():
            continue
        near = np.bitwise_count(values[part][:, None] ^ values[right][None, :]) <= radius
        i, j = np.nonzero(near)
        if len(i):
            forest.join(part[i], right[j])


def search(values: np.ndarray, radius: int, forest: Forest) -> None:
    """All links among ``values``: a vantage-point tree, walked with a stack."""
    work = [np.arange(len(values))]
    while work:
        rows = work.pop()
        if len(rows) <= LEAF:
            across(values, rows, rows, radius, forest)
            continue
        distance = np.bitwise_count(values[rows] ^ values[rows[0]]).astype(np.int64)
        ball = rows[distance <= radius]
        forest.join(ball, np.full(len(ball), rows[0]))
        if (forest.label[rows] == forest.label[rows[0]]).all():
            continue  # joined already: further links would change no component
        border = int(np.median(distance))
        inner = distance <= border
        if inner.all():
            border = int(distance.max()) - 1
            inner = distance <= border
        if not inner.any() or inner.all():
            across(values, rows, rows, radius, forest)
            continue
        work += [rows[inner], rows[~inner]]
        across(values, rows[inner & (distance > border - radius)], rows[~inner & (distance <= border + radius)], radius, forest)


def blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, width) of radius + 1 blocks that cover all bits."""
    cuts = [round(k * BITS / (radius + 1)) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def sharded(distinct: DataFrame, radius: int) -> DataFrame:
    """(block, value, rest, fp): every fingerprint once per block, with its bits outside the block."""
    keys = []
    for k, (first, width) in enumerate(blocks(radius)):
        rest = F.col("fp").bitwiseAND((1 << first) - 1)
        if first + width < BITS:
            rest = rest.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", first + width), first))
        keys.append(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", first).bitwiseAND((1 << width) - 1).alias("value"), rest.alias("rest")))
    return distinct.select("fp", F.explode(F.array(*keys)).alias("shard")).select("fp", "shard.*")


def divided(rows: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """The rows of large shards by cell (block, value, part, piece, ring1, ring2).

    Linked rows of a shard differ in at most ``radius`` bits outside its block, so they agree in
    one of ``radius`` + 1 parts of these.  A piece that is still too large is cut by distance rings
    around two vantage points; rings are wider than twice the radius, so a row is a guest in one
    neighbouring ring per vantage point at most.
    """
    bits = BITS - min(width for _, width in blocks(radius))
    cuts = [round(k * bits / (radius + 1)) for k in range(radius + 2)]
    parts = F.array(*(
        F.struct(F.lit(k + 1).alias("part"), F.shiftrightunsigned("rest", a).bitwiseAND((1 << (b - a)) - 1).alias("piece")) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))
    ))
    pieces = rows.select("block", "value", "fp", F.explode(parts).alias("p")).select("block", "value", "p.*", "fp")
    keys = ["block", "value", "part", "piece"]
    sizes = pieces.groupBy(*keys).agg(F.count("*").alias("n"), F.min("fp").alias("v1"), F.max("fp").alias("v2")).where("n > 1")
    cells, width = pieces.join(sizes, keys), 2 * radius + 2
    for k in ("1", "2"):
        d = F.bit_count(F.col("fp").bitwiseXOR(F.col(f"v{k}")))
        home, low, high = F.floor(d / width), F.floor((d - radius) / width), F.floor((d + radius) / width)
        ring = F.when(F.col("n") > shard_rows, F.array_distinct(F.array(home, F.greatest(low, F.lit(0)), high))).otherwise(F.array(F.lit(0).cast("long")))
        cells = cells.withColumn(f"ring{k}", F.explode(ring))
    return cells.select(*CELL_KEYS, "fp")


def cells(distinct: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD) -> DataFrame:
    """Every fingerprint in each cell (``CELL_KEYS``) that may hold a link of it."""
    rows = sharded(distinct, radius)
    sizes = materialise(rows.groupBy("block", "value").agg(F.count("*").alias("n")).where("n > 1"), "shard-sizes")
    none = [F.lit(0).cast(kind).alias(c) for c, kind in (("part", "int"), ("piece", "long"), ("ring1", "long"), ("ring2", "long"))]
    small = rows.join(sizes.where(F.col("n") <= shard_rows), ["block", "value"]).select("block", "value", *none, "fp")
    large = sizes.where(F.col("n") > shard_rows)
    if large.isEmpty():
        return small
    return small.unionByName(divided(rows.join(large.drop("n"), ["block", "value"]), radius, shard_rows))


def links(distinct: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD) -> DataFrame:
    """(a, b): a spanning forest of all links among distinct fingerprints (column fp)."""
    return grouped(cells(distinct, radius, shard_rows), radius)


def grouped(rows: DataFrame, radius: int) -> DataFrame:
    """Search every shard cell; rows come sorted by cell, so a task reads one cell after the other."""
    keys = CELL_KEYS
    dealt = rows.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "fp")

    def run(frames):
        import pandas as pd

        held, key = [], None

        def found(parts):
            values = np.concatenate(parts)
            forest = Forest(len(values))
            search(values.view(np.uint64), radius, forest)
            child = np.flatnonzero(forest.label != np.arange(len(values)))
            return values[child], values[forest.label[child]]

        for frame in frames:
            cell = frame[keys].to_numpy(np.int64)
            fp = frame["fp"].to_numpy(np.int64)
            cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]).any(1)) + 1).tolist(), len(fp)]
            out = []
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if key is not None and tuple(cell[a]) != key:
                    out.append(found(held))
                    held = []
                key = tuple(cell[a])
                held.append(fp[a:b])
            if out:
                yield pd.DataFrame({"a": np.concatenate([x[0] for x in out]), "b": np.concatenate([x[1] for x in out])})
        if held:
            a, b = found(held)
            yield pd.DataFrame({"a": a, "b": b})

    return dealt.mapInPandas(run, "a long, b long")


def group(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = SHARD) -> DataFrame:
    """(id, fp, component): component is the smallest id that links reach from the document."""
    own = materialise(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = materialise(own.groupBy("fp").agg(F.min(id_col).alias("first"), F.count("*").alias("n")), "distinct-fingerprints")
    forest = materialise(links(distinct.select("fp"), radius, shard_rows), "fingerprint-links")
    roots = components(forest, "a", "b")
    classes = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("first").alias("component"))
    named = materialise(classes.join(smallest, "root").select("fp", "component"), "fingerprint-classes")
    return own.join(named, "fp").select(id_col, "fp", "component")


# Near copies by similarity of shingle sets, where a radius of a few bits would miss most of them.

#: Agreement per bit of two texts whose shingle sets have Jaccard similarity s: 1 - acos(2s / (1 + s)) / pi.
RECALL = 0.99
LEAST_WORDS = 8
SMALL_SHARD = 48
#: Rows of a chunk of a large shard; pairs compared at a time; shingles of a part of the verified sets.
CELL = 5_000
PAIRS = 1 << 21
SET_WORDS = 2_000_000
#: Counters that order shingles by how common they are; bits of a parity map; prefix shingles of a bucket; slices the counters are added up in.
COUNTERS = 1 << 20
MAP_BITS = 1 << 10
PREFIX_WORDS = 1 << 20
SLICES = 16


def agreement(similarity: float) -> float:
    return 1 - float(np.arccos(2 * similarity / (1 + similarity))) / np.pi


def wide_plan(n: int, similarity: float) -> tuple[int, int, int, int]:
    """(words, width, blocks, most): fingerprint words, bits per block, blocks, largest distance of a candidate.

    Blocks are wide enough for shards of some dozen random rows; as many are taken as find a pair of
    just the similarity with probability ``RECALL``.
    """
    p = agreement(similarity)
    width = int(np.clip(np.ceil(np.log2(max(n, 2) / 32)), 6, 20))
    blocks = int(np.ceil(np.log(1 - RECALL) / np.log1p(-(p**width))))
    words = max(LEAST_WORDS, -(-blocks * width // BITS))
    bits = words * BITS
    return words, width, blocks, int(np.ceil(bits * (1 - p) + 4 * np.sqrt(bits * p * (1 - p))))


def wide_fingerprint(hashes: np.ndarray, words: int) -> list[int]:
    """``words`` independent fingerprints of the distinct shingles, each from another mix of their hashes."""
    out = []
    for k in range(words):
        mixed = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1))) * np.uint64(0xD6E8FEB86659FD93)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out.append(signed(fingerprint(mixed ^ (mixed >> np.uint64(29)))))
    return out


def content(text: str | None) -> int:
    """A digest of the lower-cased word sequence."""
    return signed(xxhash.xxh64_intdigest(b" ".join((text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()), SEED))


def grow(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a minimum spanning forest among the rows of ``values`` at distance up to ``most``.

    Nearest rows are joined first, so no group is split that a larger distance would not split too.
    Memory is linear in the rows.
    """
    n = len(values)
    nearest, best, free = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.ones(n, bool)
    at, a, b = 0, [], []
    for _ in range(n):
        free[at] = False
        distance = np.bitwise_count(values ^ values[at]).sum(1, dtype=np.int64)
        closer = free & (distance < best)
        best[closer], nearest[closer] = distance[closer], at
        open_best = np.where(free, best, np.iinfo(np.int64).max)
        at = int(open_best.argmin())
        if not free[at]:
            break
        if best[at] <= most:
            a.append(at), b.append(nearest[at])
    return np.array(a, np.int64), np.array(b, np.int64)


def block_values(values: np.ndarray, width: int, blocks: int) -> np.ndarray:
    """Block values of fingerprints, one column per block."""
    out = np.empty((len(values), blocks), np.int64)
    for k in range(blocks):
        word, bit = divmod(k * width, BITS)
        value = values[:, word] >> np.uint64(bit)
        if bit + width > BITS:
            value = value | values[:, word + 1] << np.uint64(BITS - bit)
        out[:, k] = (value & np.uint64((1 << width) - 1)).view(np.int64)
    return out


def near_shards(reps: DataFrame, width: int, blocks: int) -> DataFrame:
    """(block, value, content, fp): every content once per block."""
    parts = []
    for k in range(blocks):
        word, bit = divmod(k * width, BITS)
        value = F.shiftrightunsigned(F.col("fp")[word], bit)
        if bit + width > BITS:
            value = value.bitwiseOR(F.shiftleft(F.col("fp")[word + 1], BITS - bit))
        parts.append(F.struct(F.lit(k).alias("block"), value.bitwiseAND((1 << width) - 1).alias("value")))
    return reps.select("content", "fp", F.explode(F.array(*parts)).alias("s")).select("s.block", "s.value", "content", "fp")


def chunk(n, *seed):
    """A content's part of ``n`` parts; the seed differs by block, so that blocks part a group unlike."""
    return F.pmod(F.xxhash64("content", *seed), n)


def by_cell(rows: DataFrame, keys: list[str], fields: list[str], found) -> DataFrame:
    """(a, b, shard, island) of every cell; ``found(key, columns)`` yields their arrays."""
    return in_cells(rows, keys, fields, found, "a long, b long, shard long, island long")


def shard_number(block: int, value: int) -> int:
    return int(block) << 32 | int(value)  # a block's value has 20 bits at most


def shard_columns() -> list:
    return [F.shiftright("shard", 32).cast("int").alias("block"), F.col("shard").bitwiseAND(0xFFFFFFFF).alias("value")]


def in_cells(rows: DataFrame, keys: list[str], fields: list[str], found, schema: str) -> DataFrame:
    """``found(key, columns)`` yields the arrays of the ``schema`` for every cell; rows come sorted by cell, so a task holds one cell."""
    names = [f.split()[0] for f in schema.split(", ")]
    dealt = rows.select(*keys, *fields).repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "content")

    def run(frames):
        import pandas as pd

        held, key = [], None

        def flush():
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            if len(columns[0]) > 1:
                for out in found(key, columns):
                    if len(out[0]):
                        yield pd.DataFrame(dict(zip(names, out, strict=True)))

        for frame in frames:
            if not len(frame):
                continue
            cell = frame[keys].to_numpy(np.int64)
            columns = [np.stack(frame[f].to_numpy()).astype(np.int64).view(np.uint64) if f == "fp" else frame[f].to_numpy(None if f in ("shingles", "maps") else np.int64) for f in fields]
            cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]).any(1)) + 1).tolist(), len(cell)]
            for a, b in zip(cuts, cuts[1:]):
                if key is not None and tuple(cell[a]) != key:
                    yield from flush()
                    held = []
                key = tuple(cell[a])
                held.append([c[a:b] for c in columns])
        if held:
            yield from flush()

    return dealt.mapInPandas(run, schema)


def near_links(shards: DataFrame, large: DataFrame, most: int) -> DataFrame:
    """(a, b, shard, island): first candidates, within ``most`` bits: all pairs of a small shard, forests of the cells of a large one.

    The trees of a large shard of one cell are its islands, named by their smallest content: two of its contents within
    ``most`` bits are on one island.  Other links have the shard -1.
    """
    cells = large.where(F.col("n") > CELL).select("block", "value", F.ceil(F.col("n") / CELL).alias("cells"))
    rows = shards.join(cells, ["block", "value"], "left").withColumn("cell", F.coalesce(chunk(F.col("cells"), "block"), F.lit(-1)))

    def found(key, columns):
        names, values = columns
        block, value, cell = key
        shard, island = -1, np.full(len(names), -1)
        if len(names) <= SMALL_SHARD:
            i, j = np.nonzero(np.triu(np.bitwise_count(values[:, None] ^ values[None]).sum(2, dtype=np.int64) <= most, 1))
        else:
            i, j = grow(values, most)
            if cell < 0:  # the whole shard; rows come by content, so a tree's first row has its smallest
                trees = Forest(len(names))
                trees.join(i, j)
                shard, island = shard_number(block, value), names[trees.label]
        yield np.minimum(names[i], names[j]), np.maximum(names[i], names[j]), np.full(len(i), shard), island[i]

    return by_cell(rows, ["block", "value", "cell"], ["content", "fp"], found)


def apart_pairs(left, right, values, groups, block: int, width: int, blocks: int, most: int, same: bool):
    """(i, j) arrays of the rows ``left`` and ``right`` within ``most`` bits and not of one group, first met in this block."""
    before = block_values(values, width, blocks)[:, :block]
    step = max(1, PAIRS // max(1, len(right)))
    for start in range(0, len(left), step):
        part = left[start : start + step]
        near = groups[part][:, None] != groups[right][None]
        distance = np.zeros(near.shape, np.int16)
        for k in range(values.shape[1]):
            distance += np.bitwise_count(values[part, k][:, None] ^ values[right, k][None])
        i, j = np.nonzero(near & (distance <= most))
        i, j = part[i], right[j]
        once = i < j if same else np.ones(len(i), bool)
        i, j = i[once], j[once]
        for at in range(0, len(i), PAIRS // 16):
            a, b = i[at : at + PAIRS // 16], j[at : at + PAIRS // 16]
            new = ~(before[a] == before[b]).any(1)
            yield a[new], b[new]


def crowd_rows(found: DataFrame, shards: DataFrame, large: DataFrame) -> DataFrame:
    """(block, value, island, content): contents of large shards that may have others within ``most`` bits.

    Of a shard of one cell these are the contents that its forest has linked, by island; the rest have none.  A shard of
    several cells is one island.
    """
    linked = found.where("shard >= 0").select(*shard_columns(), "island", F.explode(F.array("a", "b")).alias("content")).distinct()
    whole = shards.join(large.where(F.col("n") > CELL).select("block", "value"), ["block", "value"])
    return linked.unionByName(whole.select("block", "value", F.lit(0).cast("long").alias("island"), "content"))


def crowd_ends(islands: DataFrame, reps: DataFrame, roots: DataFrame, width: int, blocks: int, most: int) -> DataFrame:
    """(block, value, island, content): contents of an island within ``most`` bits of one that no verified link has put into their group.

    An island's largest group is never compared with itself.  The others are dealt into chunks, and each two
    chunks of which one is not of the largest group meet in a cell of their own.  A pair is found in the first
    block in which it agrees; a cell names the ends of its pairs, not the pairs.
    """
    keys = ["block", "value", "island"]
    rows = islands.join(roots.withColumnRenamed("node", "content"), "content", "left").withColumn("root", F.coalesce("root", "content"))
    groups = rows.groupBy(*keys, "root").agg(F.count("*").alias("c"))
    sizes = groups.groupBy(*keys).agg(F.max_by("root", "c").alias("main"), F.max("c").alias("m"), F.sum("c").alias("n")).where("n > m")
    sizes = materialise(sizes.select(*keys, "main", F.ceil((F.col("n") - F.col("m")) / CELL).alias("others"), F.ceil(F.col("m") / CELL).alias("mains")), "near-crowds")
    rows = rows.join(sizes, keys).join(reps.select("content", "fp"), "content")
    rows = rows.withColumn("chunk", F.when(F.col("root") == F.col("main"), F.col("others") + chunk(F.col("mains"))).otherwise(chunk(F.col("others"))))
    partners = F.sequence(F.lit(0).cast("long"), F.when(F.col("root") == F.col("main"), F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1))
    rows = rows.withColumn("other", F.explode(partners)).withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other"))

    def found(key, columns):
        names, values, groups, chunks = columns
        block, value, island, low, high = key
        ends = np.zeros(len(names), bool)
        for i, j in apart_pairs(np.flatnonzero(chunks == low), np.flatnonzero(chunks == high), values, groups, block, width, blocks, most, low == high):
            ends[i] = ends[j] = True
        met = names[ends]
        yield met, met, np.full(len(met), shard_number(block, value)), np.full(len(met), island)

    ends = by_cell(rows, [*keys, "low", "high"], ["content", "fp", "root", "chunk"], found)
    return ends.select(*shard_columns(), "island", F.col("a").alias("content")).distinct()


def crowd_forest(ends: DataFrame, reps: DataFrame, sets: DataFrame, roots: DataFrame, width: int, blocks: int, most: int, similarity: float, exact: bool = False) -> DataFrame:
    """(a, b): links of the crowds' ends (block, value, island, content) whose shingle sets have at least the similarity.

    The ends of an island are dealt into parts of bounded size, and each two parts meet in a cell with their sets.  A cell
    compares its pairs where they meet and gives a spanning forest of those that hold, so no pair leaves it.  With ``exact`` these are
    all pairs that the sets' sizes and parity maps allow, whatever their fingerprints.
    """
    rows = ends.join(reps.select("content", "fp"), "content").join(sets, "content").join(roots.withColumnRenamed("node", "content"), "content", "left")
    rows = materialise(rows.withColumn("root", F.coalesce("root", "content")), "near-crowd-sets")
    bound = F.greatest(F.ceil(F.sum(F.size("shingles")) / SET_WORDS), F.ceil(F.count("*") / CELL), F.lit(1))
    keys = ["block", "value", "island"]
    rows = rows.join(rows.groupBy(*keys).agg(bound.alias("parts")), keys).withColumn("chunk", chunk(F.col("parts"), F.lit("set")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other"))

    def found(key, columns):
        names, values, groups, chunks, shingles = columns
        block, _, _, low, high = key
        sizes = np.array([len(x) for x in shingles])
        distinct, numbers = np.unique(np.concatenate(list(shingles)), return_inverse=True)
        numbers, mark = np.split(numbers, np.cumsum(sizes)[:-1]), np.zeros(len(distinct) + 1, np.int64)
        trees = {}

        def root(x):
            while (up := trees.setdefault(x, x)) != x:
                trees[x] = x = trees.setdefault(up, up)
            return x

        kept, sides = [], (np.flatnonzero(chunks == low), np.flatnonzero(chunks == high))
        if exact:
            pairs = bounded_pairs(*sides, fitting_maps(shingles, sizes.max()), sizes, groups, similarity, low == high)
        else:
            pairs = apart_pairs(*sides, values, groups, block, width, blocks, most, low == high)
        for i, j in pairs:
            cuts = [0, *(np.flatnonzero(i[1:] != i[:-1]) + 1).tolist(), len(i)]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                one = int(i[x])
                mark[numbers[one]] = 1
                for start in range(x, y, 1024):
                    here = root(int(groups[one]))
                    others = [k for k in j[start : min(start + 1024, y)].tolist() if root(int(groups[k])) != here]
                    if not others:
                        continue
                    ends = np.cumsum(sizes[others])
                    sums = np.concatenate([[0], np.cumsum(mark[np.concatenate([numbers[k] for k in others])])])
                    both = sums[ends] - sums[ends - sizes[others]]
                    for n in np.flatnonzero(both >= similarity * (sizes[one] + sizes[others] - both) - 1e-9).tolist():
                        if (there := root(int(groups[others[n]]))) != root(int(groups[one])):
                            trees[there] = root(int(groups[one]))
                            kept.append((names[one], names[others[n]]))
                mark[numbers[one]] = 0
        a, b = np.array(kept, np.int64).reshape(-1, 2).T
        yield np.minimum(a, b), np.maximum(a, b)

    return in_cells(rows, [*keys, "low", "high"], ["content", "fp", "root", "chunk", "shingles"], found, "a long, b long")


def verified(candidates: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """A spanning forest of the candidates whose shingle sets (content, shingles) have at least the similarity.

    A cell keeps the links that join two of its trees, so it gives fewer links than it has contents, and a candidate
    whose ends verified links have joined is not compared.  Contents are dealt into parts of about ``SET_WORDS`` shingles; a cell holds the sets of two parts once,
    and its pairs stream past them.
    """
    total = sets.agg(F.sum(F.size("shingles"))).first()[0] or 0
    parts = F.lit(-(-int(total) // SET_WORDS) or 1)
    pa_, pb = (F.pmod(F.xxhash64(c), parts) for c in "ab")
    pairs = candidates.select(F.least(pa_, pb).alias("low"), F.greatest(pa_, pb).alias("high"), "a", "b")
    ends = pairs.select("low", "high", F.explode(F.array("a", "b")).alias("content")).distinct()
    given = ends.join(sets, "content").select("low", "high", F.lit(0).alias("kind"), F.col("content").alias("a"), F.lit(0).cast("long").alias("b"), "shingles")
    asked = pairs.select("low", "high", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("array<long>").alias("shingles"))
    dealt = given.unionByName(asked).repartition("low", "high").sortWithinPartitions("low", "high", "kind", "a", "b")

    def run(batches):
        import pyarrow as pa

        key, held, ready, trees = None, {}, None, {}

        def root(x):
            while (up := trees.setdefault(x, x)) != x:
                trees[x] = x = trees.setdefault(up, up)
            return x

        def index():
            """Every set as numbers of the cell's distinct shingles."""
            names = list(held)
            ends = np.cumsum([len(held[n]) for n in names])[:-1] if names else []
            distinct, numbers = np.unique(np.concatenate([held[n] for n in names]), return_inverse=True) if names else (np.zeros(0), np.zeros(0, np.int64))
            return dict(zip(names, np.split(numbers, ends), strict=True)), np.zeros(len(distinct) + 1, np.int64)

        for batch in batches:
            low, high, kind, a, b = (batch.column(k).to_numpy() for k in range(5))
            shingles = batch.column(5)
            turn = (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (kind[1:] != kind[:-1]) | ((kind[1:] == 1) & (a[1:] != a[:-1]))
            cuts = [0, *(np.flatnonzero(turn) + 1).tolist(), len(a)]
            kept = []
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                if (low[x], high[x]) != key:
                    key, held, ready, trees = (low[x], high[x]), {}, None, {}
                if kind[x] == 0:
                    held.update((int(a[k]), shingles[k].values.to_numpy()) for k in range(x, y))
                    continue
                if ready is None:
                    ready, held = index(), {}
                numbers, mark = ready
                name = int(a[x])
                own = numbers[name]
                mark[own] = 1
                for start in range(x, y, 1024):
                    here = root(name)
                    apart = [(k, v) for k, v in enumerate(b[start : min(start + 1024, y)].tolist(), start) if root(v) != here]
                    if not apart:
                        continue
                    others = [numbers[v] for _, v in apart]
                    sizes = np.array([len(o) for o in others])
                    sums = np.concatenate([[0], np.cumsum(mark[np.concatenate(others)])])
                    ends = np.cumsum(sizes)
                    both = sums[ends] - sums[ends - sizes]
                    for n in np.flatnonzero(both >= similarity * (len(own) + sizes - both) - 1e-9).tolist():
                        k, v = apart[n]
                        if (there := root(v)) != root(name):
                            trees[there] = root(name)
                            kept.append(k)
                mark[own] = 0
            if kept:
                k = np.array(kept)
                yield pa.RecordBatch.from_arrays([pa.array(a[k], pa.int64()), pa.array(b[k], pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


# What blocks of fingerprints leave to chance: all other pairs, by the shingles that the similarity makes two texts share.


def parity_map(hashes: np.ndarray, bits: int = MAP_BITS) -> np.ndarray:
    """Whether an odd number of the distinct hashes fall on each bit: two sets differ in at least as many shingles as their maps in bits."""
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<u8")


def fitting_maps(shingles, largest: int) -> np.ndarray:
    """Parity maps of sets, of about two bits for a shingle of the largest."""
    bits = 1 << int(np.clip(np.ceil(np.log2(2 * max(1, largest))), 6, 15))
    return np.stack([parity_map(np.asarray(x, np.int64).view(np.uint64), bits) for x in shingles])


def apart_most(a, b, similarity: float):
    """The shingles in which two sets of sizes ``a`` and ``b`` may differ at the similarity."""
    return np.floor((a + b) * ((1 - similarity) / (1 + similarity)) + 1e-6)


def bounded_pairs(left, right, maps, sizes, groups, similarity: float, same: bool):
    """(i, j) arrays of the rows ``left`` and ``right`` that are not of one group and that sizes and parity maps allow to have the similarity."""
    step = max(1, PAIRS // max(1, len(right)))
    for start in range(0, len(left), step):
        part = left[start : start + step]
        able = groups[part][:, None] != groups[right][None]
        able &= np.minimum(sizes[part][:, None], sizes[right][None]) >= similarity * np.maximum(sizes[part][:, None], sizes[right][None]) - 1e-6
        if same:
            able &= part[:, None] < right[None]
        i, j = np.nonzero(able)
        i, j = part[i], right[j]
        for at in range(0, len(i), PAIRS // maps.shape[1]):
            a, b = i[at : at + PAIRS // maps.shape[1]], j[at : at + PAIRS // maps.shape[1]]
            near = np.bitwise_count(maps[a] ^ maps[b]).sum(1, dtype=np.int64) <= apart_most(sizes[a], sizes[b], similarity)
            yield a[near], b[near]


def counter_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def prefix_words(hashes: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest of a text's distinct shingles: two texts of the similarity have one of them in common.

    They share at least the similarity's part of either set, so the first shingle they share in any order that holds for all texts is
    among the first ones of both.  Rare ones come first; how well the counters tell that changes the work, not the result.
    """
    n = len(hashes)
    return hashes[np.lexsort((hashes, counts[counter_of(hashes)]))[: n - int(np.ceil(similarity * n - 1e-6)) + 1]] if n else hashes


def counted_words(parts: DataFrame) -> np.ndarray:
    """The counters that all tasks have added up, from their rows (slice, counts)."""
    def run(batches):
        import pyarrow as pa

        total = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(data, np.int32).astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slice", "counts"])

    counts = np.zeros((SLICES, COUNTERS // SLICES), np.int64)
    # numbers of a fixed count, however large the tables
    for k, data in parts.repartition(SLICES, "slice").mapInArrow(run, "slice int, counts binary").collect():
        counts[k] += np.frombuffer(data, np.int64)
    return counts.reshape(-1)


def shared_words(rows: DataFrame, shingle: int, counts: np.ndarray, similarity: float) -> DataFrame:
    """(word, content): the prefix shingles that more than one content has, from texts (column text).

    Tasks send their prefixes packed by bucket of the shingle; a bucket holds about ``PREFIX_WORDS`` of them.
    """
    shared = rows.sparkSession.sparkContext.broadcast(counts)
    buckets = int(counts.sum() * (1 - similarity)) // PREFIX_WORDS + 8

    def packed(batches):
        import pyarrow as pa

        from rttscope.llm.text import slices

        words, names, held = [], [], 0

        def out():
            w, c = np.concatenate(words), np.concatenate(names)
            order = np.lexsort((c, w))
            w, c = w[order], c[order]
            new = np.append(True, (w[1:] != w[:-1]) | (c[1:] != c[:-1]))
            w, c = w[new], c[new]
            bucket = (w % np.uint64(buckets)).astype(np.int64)
            found = [(k, w[at].tobytes(), c[at].tobytes()) for k in np.unique(bucket).tolist() for at in [bucket == k]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "words", "contents"])

        for batch in batches:
            for part in slices([batch], 64):
                for t in part.column(0).to_pylist():
                    first = prefix_words(np.unique(shingle_hashes(t, shingle)), shared.value, similarity)
                    words.append(first), names.append(np.full(len(first), content(t), np.int64))
                    held += len(first)
                if held >= PREFIX_WORDS // 2:
                    yield out()
                    words, names, held = [], [], 0
        if held:
            yield out()

    def met(batches):
        import pyarrow as pa

        held = {}
        for batch in batches:
            for k, w, c in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                held.setdefault(k, []).append((w, c))
        while held:
            _, parts = held.popitem()
            w, c = (np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*parts), (np.uint64, np.int64)))
            order = np.lexsort((c, w))
            w, c = w[order], c[order]
            new = np.append(True, (w[1:] != w[:-1]) | (c[1:] != c[:-1]))
            w, c = w[new], c[new]
            like = w[1:] == w[:-1]
            several = np.append(False, like) | np.append(like, False)
            if several.any():
                yield pa.RecordBatch.from_arrays([pa.array(w[several].view(np.int64)), pa.array(c[several])], ["word", "content"])

    dealt = rows.select("text").mapInArrow(packed, "bucket int, words binary, contents binary").repartitionById(buckets, "bucket")
    return dealt.mapInArrow(met, "word long, content long")


def word_links(words: DataFrame, reps: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(a, b): per shared shingle a spanning forest of the contents that may have the similarity and are not of one group yet.

    ``words`` has (word, content), ``reps`` the parity map and the number of shingles.  The contents of a common shingle are dealt into chunks of
    about ``CELL``; two chunks meet in a cell of their own unless both are of the shingle's largest group.
    """
    rows = words.join(roots.withColumnRenamed("node", "content"), "content", "left").withColumn("root", F.coalesce("root", "content"))
    groups = rows.groupBy("word", "root").agg(F.count("*").alias("c"))
    sizes = groups.groupBy("word").agg(F.max_by("root", "c").alias("main"), F.max("c").alias("m"), F.sum("c").alias("n")).where("n > m")
    one, parts = F.col("n") <= CELL, lambda c: F.ceil(c / CELL)
    sizes = materialise(sizes.select("word", "main", F.when(one, 1).otherwise(parts(F.col("n") - F.col("m"))).alias("others"), F.when(one, 0).otherwise(parts(F.col("m"))).alias("mains")), "near-words")
    rows = rows.join(sizes, "word").join(reps.select("content", "map", "size"), "content")
    in_main = (F.col("root") == F.col("main")) & (F.col("mains") > 0)
    rows = rows.withColumn("chunk", F.when(in_main, F.col("others") + chunk(F.col("mains"))).otherwise(chunk(F.col("others"))))
    last = F.when(in_main, F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other"))
    keys = ["word", "low", "high"]
    dealt = rows.select(*keys, "content", "root", "chunk", "size", "map").repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "content")

    def run(frames):
        import pandas as pd

        def found(frame):
            cell, names, groups, chunks, sizes = (frame[k].to_numpy(np.int64) for k in (keys, "content", "root", "chunk", "size"))
            maps = np.stack(frame["map"].to_numpy()).astype(np.int64).view(np.uint64)
            starts = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]).any(1)))
            held = np.diff(np.append(starts, len(cell)))
            small = np.repeat(np.where(held <= SMALL_SHARD, np.arange(len(held)), -1), held)
            trees = Forest(len(cell))
            for away in range(1, int(held[held <= SMALL_SHARD].max(initial=1))):
                # small cells are looked at together: rows that stand so far from each other
                i = np.flatnonzero((small[away:] == small[:-away]) & (small[away:] >= 0) & (groups[away:] != groups[:-away]))
                j = i + away
                ok = (chunks[i] == cell[i, 1]) & (chunks[j] == cell[i, 2]) | (chunks[j] == cell[i, 1]) & (chunks[i] == cell[i, 2])
                ok &= np.minimum(sizes[i], sizes[j]) >= similarity * np.maximum(sizes[i], sizes[j]) - 1e-6
                i, j = i[ok], j[ok]
                near = np.bitwise_count(maps[i] ^ maps[j]).sum(1, dtype=np.int64) <= apart_most(sizes[i], sizes[j], similarity)
                trees.join(i[near], j[near])
            for k in np.flatnonzero(held > SMALL_SHARD).tolist():
                here = np.arange(starts[k], starts[k] + held[k])
                _, low, high = cell[starts[k]]
                for i, j in bounded_pairs(here[chunks[here] == low], here[chunks[here] == high], maps, sizes, groups, similarity, low == high):
                    trees.join(i, j)
            child = np.flatnonzero(trees.label != np.arange(len(names)))
            return pd.DataFrame({"a": names[child], "b": names[trees.label[child]]})

        rest = None
        for frame in frames:
            if rest is not None:
                frame = pd.concat([rest, frame], ignore_index=True)
            if not len(frame):
                continue
            cell = frame[keys].to_numpy(np.int64)
            other = np.flatnonzero((cell != cell[-1]).any(1))
            end = other[-1] + 1 if len(other) else 0  # the last cell may go on in the next frame
            if end:
                yield found(frame[:end])
            rest = frame[end:]
        if rest is not None and len(rest):
            yield found(rest)

    return dealt.mapInPandas(run, "a long, b long")


def map_links(islands: DataFrame, sets: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(a, b): a spanning forest of the pairs of an island (island, content) that maps as wide as its largest set allow.

    The map that every content has says little of a text of thousands of shingles; maps of an island are a small part of its sets.
    """
    rows = islands.join(sets, "content").join(roots.withColumnRenamed("node", "content"), "content", "left")
    rows = rows.select("island", "content", F.coalesce("root", "content").alias("root"), F.size("shingles").cast("long").alias("size"), "shingles")
    bounds = rows.groupBy("island").agg(F.max("size").alias("largest"), F.ceil(F.count("*") / CELL).alias("parts"))

    def maps(frames):
        for frame in frames:
            yield frame.assign(maps=[fitting_maps([x], n)[0].view(np.int64) for x, n in zip(frame["shingles"], frame["largest"])]).drop(columns=["shingles", "largest"])

    rows = rows.join(bounds, "island").mapInPandas(maps, "island long, content long, root long, size long, parts long, maps array<long>")
    rows = materialise(rows.withColumn("chunk", chunk(F.col("parts"), F.lit("map"))), "near-maps")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other"))

    def found(key, columns):
        names, values, groups, chunks, sizes = columns
        _, low, high = key
        trees, values = Forest(len(names)), np.stack(values).view(np.uint64)
        for i, j in bounded_pairs(np.flatnonzero(chunks == low), np.flatnonzero(chunks == high), values, sizes, groups, similarity, low == high):
            trees.join(i, j)
        child = np.flatnonzero(trees.label != np.arange(len(names)))
        yield names[child], names[trees.label[child]]

    return in_cells(rows, ["island", "low", "high"], ["content", "maps", "root", "chunk", "size"], found, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, copies, keep): one row per id and text; ``keep`` marks the one of its group that stays.

    Groups are the components of links with a Jaccard similarity of at least ``similarity`` between sets of
    ``shingle``-word shingles.  First candidates come from blocks of wide fingerprints; what these leave apart is met by its rarest
    shingles, of which any two texts of the similarity share one.  Every candidate is verified on the shingle sets.  The smallest id of a group stays (of equal ids the smaller text hash; null ids last).
    """
    from rttscope.llm.contamination import bit_filter, passes

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    words, width, blocks, most = wide_plan(rows.count(), similarity)

    held = {}  # of a task: how often each counter met a shingle

    def of(ids, hashes, texts):
        sets = [np.unique(shingle_hashes(t, shingle)) for t in texts]
        np.add.at(held.setdefault("counts", np.zeros(COUNTERS, np.int32)), counter_of(np.concatenate(sets)), 1)
        return [(i, h, content(t), wide_fingerprint(x, words), parity_map(x).view(np.int64), len(x), None, None) for i, h, t, x in zip(ids, hashes, texts, sets, strict=True)]

    def counted():
        return [(None, 0, 0, None, None, 0, k, x.tobytes()) for k, x in enumerate(held["counts"].reshape(SLICES, -1))] if held else []

    made = map_texts(rows, ["id", "h", "text"], f"id {kind}, h long, content long, fp array<long>, map array<long>, size long, slice int, counts binary", of, 64, counted)
    made = materialise(made, "wide-fingerprints")
    own, counts = made.where("slice is null").drop("slice", "counts"), counted_words(made.where("slice is not null").select("slice", "counts"))
    reps = own.groupBy("content").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("h"))).alias("first"), F.any_value("fp").alias("fp"), F.any_value("map").alias("map"), F.any_value("size").alias("size"))
    reps = materialise(reps, "contents")
    shards = near_shards(reps, width, blocks)
    large = materialise(shards.groupBy("block", "value").agg(F.count("*").alias("n")).where(F.col("n") > SMALL_SHARD), "near-large-shards")

    def sets_of(contents):
        # shingle sets of the contents' first documents only: a further scan keeps what a filter of fixed size lets through
        wanted = materialise(contents.join(reps.select("content", F.col("first.h").alias("h")), "content"), "near-ends")
        shared = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted.select(F.col("h").alias("hash"))))

        def sets(hashes, texts):
            ok = passes(shared.value, np.array(hashes, np.int64)) if hashes else []
            return [(h, np.unique(shingle_hashes(t, shingle)).view(np.int64).tolist()) for h, t, o in zip(hashes, texts, ok, strict=True) if o]

        found = map_texts(rows, ["h", "text"], "h long, shingles array<long>", sets, 64).groupBy("h").agg(F.any_value("shingles").alias("shingles"))
        return materialise(wanted.join(found, "h").select("content", "shingles"), "near-sets")

    found = materialise(near_links(shards, large, most), "near-found")
    candidates = materialise(found.select("a", "b").distinct(), "near-candidates")
    ends = sets_of(candidates.select(F.explode(F.array("a", "b")).alias("content")).distinct())
    links = materialise(verified(candidates, ends, similarity), "near-links")
    roots = components(links, "a", "b")
    if not large.isEmpty():
        # a forest's link that failed stood for others: what is still apart on an island is compared pair by pair
        islands = materialise(crowd_rows(found, shards, large), "near-crowd-rows")
        crowd = materialise(crowd_ends(islands, reps, roots, width, blocks, most), "near-crowd-ends")
        if not crowd.isEmpty():
            apart = sets_of(crowd.select("content").distinct())
            links = links.union(materialise(crowd_forest(crowd, reps, apart, roots, width, blocks, most, similarity), "near-links"))
            roots = components(links, "a", "b")
    # a pair that no block holds, or whose fingerprints differ more than expected: all of these share one of their rarest shingles
    common = materialise(shared_words(rows, shingle, counts, similarity), "near-shared")
    maybe = materialise(word_links(common, reps, roots, similarity).distinct(), "near-maybe")
    if not maybe.isEmpty():
        wide = components(maybe, "a", "b").select(F.col("root").alias("island"), F.col("node").alias("content"))
        sets = sets_of(wide.select("content"))
        maybe = materialise(map_links(wide, sets, roots, similarity), "near-maybe")
    if not maybe.isEmpty():
        left = components(maybe, "a", "b").select(F.lit(0).alias("block"), F.lit(0).cast("long").alias("value"), F.col("root").alias("island"), F.col("node").alias("content"))
        more = crowd_forest(left, reps, sets, roots, width, blocks, most, similarity, exact=True)
        roots = components(links.union(materialise(more, "near-links")), "a", "b")
    classes = reps.select("content", "first").join(roots, F.col("content") == F.col("node"), "left").select("content", "first", F.coalesce("root", "content").alias("root"))
    stays = classes.groupBy("root").agg(F.min("first").alias("stay"))
    kept = materialise(stays.select(F.col("stay.id").alias("kid"), F.col("stay.h").alias("kh")), "near-kept")
    counted = own.groupBy("id", "h").agg(F.count("*").alias("copies"))
    return counted.join(kept, F.col("id").eqNullSafe(F.col("kid")) & (F.col("h") == F.col("kh")), "left").select("id", "h", "copies", F.col("kh").isNotNull().alias("keep"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group; of equal rows one stays."""
    names = docs.columns
    kept = materialise(near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where("keep"), "near-decisions")
    near_id, near_h, copies = free_names(names, "near_id", "near_h", "near_copies")
    kept = kept.select(F.col("id").alias(near_id), F.col("h").alias(near_h), F.col("copies").alias(copies))
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    joined = docs.join(kept, F.col(id_col).eqNullSafe(F.col(near_id)) & (h == F.col(near_h)))
    once, again = joined.where(F.col(copies) == 1).select(*names), joined.where(F.col(copies) > 1).dropDuplicates([near_id, near_h]).select(*names)
    return once.unionByName(again)
