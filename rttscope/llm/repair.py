"""Structure repair of conversations: the cheapest edits that give the roles ``(s?(ua)+)?``.

Rows of a conversation are edited in order: Keep (0), Rerole to user or assistant (3), Delete (4, required for
blank and duplicate rows) and Insert of an empty user or assistant row (3); a truncated row that is not deleted
adds 3.  After a system row or at the start only a user row may follow, after a user an assistant, after an
assistant a user, so from each of four states every kind of edit leads to one state.

1. Equal rows are counted before they are shuffled and stay one row with a number of copies.  Slim rows (text as a
   digest) are sorted by range, so a long conversation lies over many partitions; runs of at most ``SEGMENT``
   rows of one conversation are segments.
2. Where a conversation has several segments, each yields a 4 x 4 table of least costs from state to state; those
   tables are folded from the back, which gives every segment the costs behind it.
3. A cost DP runs backwards through the rows of a segment, all segments of a batch in step.  Its optimal arcs make a
   graph whose nodes are ranked by the audits of length 1, 2, 4, ... that start at them (prefix doubling: the rank
   at 2L is the rank of the pair of ranks at L, the pointer at 2L the pointer of the pointer).  At each node the arc
   of least initial and least rank behind it is taken, and the path is read through the doubled pointers.
4. Segments are chained by the state each ends in; the edits meet their texts again.

A conversation has one audit string, one character an edit, which bounds its segments to some hundred thousand.

Defined results: null roles and texts count as one space; null turns come first; rows of equal turn are ordered by
role, then SHA-256 of the text; null ids form one conversation; ``repair`` gives no row for a conversation without rows;
an empty table gives an empty result.  Only the four columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rttscope.session import materialise

REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: Rows of a segment, as a power of two.
SEGMENT_BITS = 12
SPACE = r"\x20\x09-\x0D"
#: State after a system, user or assistant row, by the state before; 0 start, 1 system, 2 user, 3 assistant; 4 none.
NEXT = np.array([[1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4], [4, 4, 4, 4]])
#: State after a row of the one role among user and assistant that may follow.
MEND = np.array([2, 2, 3, 2])
FAR = 1 << 40
#: Edits by ASCII order of their initials; 0 ends a path.
D, I, K, R = 1, 2, 3, 4
CLOSED = np.array([0, 2 * INSERT, INSERT, 0])

_KEY = ["conv_id", "turn", "role", "digest"]


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows dropped, emptied, cut, repeated or reroled by the hash of their key."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    table = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), case.alias("case")).where("case <> 0")
    changed = F.when(F.col("case") == 1, F.lit("")).when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return table.select("conv_id", "turn", F.when(F.col("case") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), changed.alias("text"),
                        F.when(F.col("case") == 3, 2).otherwise(1).cast("long").alias("copies"))


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys, null equal to null; the right side's keys go."""
    there = right.select(*(F.col(c).alias(f"{c}_there" if c in keys else c) for c in right.columns))
    on = [F.col(k).eqNullSafe(F.col(f"{k}_there")) for k in keys]
    return left.join(there, on, how).drop(*(f"{k}_there" for k in keys))


def ordered(rows: DataFrame, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """Slim rows in their order: ``_KEY``, copies, blank, cut, first (no earlier row has role and text), rid, segment."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    slim = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.sha2(text, 256).alias("digest"), F.col("copies"),
                       (~text.rlike(f"[^{SPACE}]")).alias("blank"), (~text.rlike(rf"[.!?][{SPACE}]*\z")).alias("cut"))
    counted = materialise(slim.groupBy(*_KEY, "blank", "cut").agg(F.sum("copies").alias("copies")), "repair-rows")
    firsts = counted.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("t"), F.col("turn"))).alias("x"))
    firsts = firsts.select("conv_id", "role", "digest", F.col("x.turn").alias("turn"), F.lit(True).alias("first"))
    told = same(counted, firsts, _KEY, "left").withColumn("first", F.coalesce("first", F.lit(False)))
    dealt = told.repartitionByRange(*_KEY).sortWithinPartitions(*_KEY).withColumn("rid", F.monotonically_increasing_id())
    return materialise(dealt.withColumn("segment", F.shiftright("rid", segment_bits)), "repair-ordered")


def segments(rows: DataFrame) -> DataFrame:
    """One row per segment: its rows in order, and the first and last segment of its conversation."""
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).cast("int")
    gone = ~F.col("first") | F.col("blank")
    row = F.struct("rid", "turn", "role", "digest", code.alias("code"), F.when(gone, F.lit(-1)).when(F.col("cut"), CUT).otherwise(0).cast("int").alias("keep"), "copies")
    held = rows.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    held = materialise(held, "repair-segments")
    spans = held.groupBy("conv_id").agg(F.min("segment").alias("low"), F.max("segment").alias("high"))
    return same(held, spans, ["conv_id"])


def padded(column: pa.Array, width: int, fill: int) -> np.ndarray:
    """A list column as a table of ``width`` columns."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.full((len(sizes), width), fill, np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def costs(code: np.ndarray, keep: np.ndarray, copies: np.ndarray, size: np.ndarray, end: np.ndarray) -> np.ndarray:
    """f[segment, row, state]: least cost of the edits from there on, given the costs ``end`` behind the last row."""
    n, width = code.shape
    f = np.full((n, width + 1, 4), FAR, np.int64)
    f[np.arange(n), size] = end
    for i in range(width - 1, -1, -1):
        rows = np.flatnonzero(size > i)
        after = f[rows, i + 1]
        k, extra = keep[rows, i], DELETE * (copies[rows, i] - 1)
        best = after + DELETE
        to = np.concatenate([after, np.full((len(rows), 1), FAR)], 1)
        stay = k >= 0
        kept = np.take_along_axis(to, NEXT[code[rows, i]], 1) + k[:, None]
        mended = after[:, MEND] + REROLE + k[:, None]
        best = np.where(stay[:, None], np.minimum(best, np.minimum(kept, mended)), best) + extra[:, None]
        user, assistant = np.minimum(best[:, 2], best[:, 3] + INSERT), np.minimum(best[:, 3], best[:, 2] + INSERT)
        f[rows, i] = np.stack([np.minimum(best[:, 0], user + INSERT), np.minimum(best[:, 1], user + INSERT), user, assistant], 1)
    return f


def arcs(f: np.ndarray, code: np.ndarray, keep: np.ndarray, copies: np.ndarray, size: np.ndarray) -> np.ndarray:
    """target[node, edit]: the node that an optimal edit leads to, -1 where the edit is not optimal.

    Nodes are numbered (segment, row, state); the node behind a segment's last row has no arc.
    """
    n, width = code.shape
    node = np.arange(n * (width + 1) * 4).reshape(n, width + 1, 4)
    target = np.full((n, width + 1, 4, 5), -1, np.int64)
    inside = (np.arange(width) < size[:, None])[:, :, None]
    here, after, then = f[:, :width], f[:, 1:], node[:, 1:]
    stay = inside & (keep >= 0)[:, :, None]
    extra, k = DELETE * (copies - 1)[:, :, None], keep[:, :, None]

    def put(edit, ok, cost, to):
        target[:, :width, :, edit] = np.where(ok & (here == cost) & (cost < FAR), to, -1)

    put(D, inside, after + DELETE + extra, then)
    put(I, inside, here[:, :, MEND] + INSERT, node[:, :width][:, :, MEND])
    to = NEXT[code]
    legal = np.minimum(to, 3)
    put(K, stay & (to < 4), np.take_along_axis(after, legal, 2) + k + extra, np.take_along_axis(then, legal, 2))
    put(R, stay, after[:, :, MEND] + REROLE + k + extra, then[:, :, MEND])
    return target.reshape(-1, 5)


def least_paths(target: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, edits) of the path with the ASCII-least audit from every start, padded with edit 0."""
    nodes = np.arange(len(target))
    ends = (target < 0).all(1)
    # arcs that leave a node differ in their initials, so the least initial names one pointer
    least = np.where(ends, 0, (target >= 0).argmax(1))
    pointer = np.where(ends, nodes, target[nodes, least])
    rank, doubled = least, [pointer]
    while True:
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + rank[doubled[-1]], return_inverse=True)[1]
        if ends[doubled[-1]].all():
            break
        doubled.append(doubled[-1][doubled[-1]])
    # ranks now order whole audits: take the arc of least (initial, rank behind it)
    behind = np.where(target >= 0, np.arange(5) * (len(target) + 1) + rank[target], np.iinfo(np.int64).max)
    edit = np.where(ends, 0, behind.argmin(1))
    path = start[:, None]
    for pointer in doubled:
        path = np.concatenate([path, pointer[path]], 1)
    return path, edit[path]


def walk(path: list[int], edits: list[int], copies: list[int], last: bool) -> tuple[list[str], int]:
    """The token of each row along one path, and the state it ends in; the last segment closes its conversation.

    A token is the initials of inserted roles (``u``, ``a``), then ``K``, ``U`` or ``A`` (reroled) or ``D``,
    and a ``D`` for every further copy.
    """
    out, held = [], ""
    at = 0
    while edits[at]:
        state, edit = path[at] % 4, edits[at]
        role = "a" if state == 2 else "u"
        if edit == I:
            held += role
        else:
            out.append(held + ("D" if edit == D else "K" if edit == K else role.upper()) + "D" * (copies[len(out)] - 1))
            held = ""
        at += 1
    state = path[at] % 4
    if last and state in (1, 2):
        out[-1] += "ua" if state == 1 else "a"
    return out, state


def _columns(batch: pa.RecordBatch):
    """Codes, keeps and copies of a batch of segments as padded tables, and their sizes."""
    rows = batch.column("rows")
    size = rows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(size.max(initial=0))
    flat = rows.flatten()
    ends = np.concatenate([[0], np.cumsum(size)])
    of = lambda name, fill: padded(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.field(name)), width, fill)
    return of("code", 3), of("keep", -1), of("copies", 1), size


def _some(batches, cells: int = 1 << 18):
    """Slices of a few segments of like size, so that padding them to the longest stays cheap."""
    for batch in batches:
        size = batch.column("rows").value_lengths().to_numpy(zero_copy_only=False)
        order = np.argsort(size, kind="stable")
        batch, size = batch.take(pa.array(order)), size[order]
        start = 0
        while start < batch.num_rows:
            stop, most = start, 0
            while stop < batch.num_rows and (stop == start or (stop - start + 1) * max(most, size[stop]) <= cells):
                most = max(most, size[stop])
                stop += 1
            yield batch.slice(start, stop - start)
            start = stop


def behind(parts: DataFrame) -> DataFrame:
    """(conv_id, segment, end): for every segment of a conversation with several, the least costs behind it by state."""
    several = parts.where("low < high")

    def tables(batches):
        for batch in _some(batches, 1 << 16):
            code, keep, copies, size = _columns(batch)
            out = np.stack([costs(code, keep, copies, size, np.where(np.arange(4) == e, 0, FAR)[None])[:, 0] for e in range(4)], 2)
            lists = [np.minimum(t, FAR).ravel().tolist() for t in out]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("segment"), pa.array(lists, pa.list_(pa.int64()))], ["conv_id", "segment", "costs"])

    kind = parts.schema["conv_id"].dataType.simpleString()
    found = several.select("conv_id", "segment", "rows").mapInArrow(tables, f"conv_id {kind}, segment long, costs array<long>")
    lists = found.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("segment", "costs")), asc=False).alias("parts"))

    def fold(batches):
        for batch in batches:
            for conv, parts in zip(batch.column("conv_id").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                end, names, ends = CLOSED, [], []
                for part in parts:
                    names.append(part["segment"])
                    ends.append(end.tolist())
                    end = np.minimum((np.array(part["costs"]).reshape(4, 4) + end).min(1), FAR)
                yield pa.RecordBatch.from_arrays([pa.array([conv] * len(names), batch.column("conv_id").type), pa.array(names, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], ["conv_id", "segment", "end"])

    return lists.mapInArrow(fold, f"conv_id {kind}, segment long, end array<long>")


def solved(parts: DataFrame) -> DataFrame:
    """(conv_id, segment, low, high, rows, cost, illegal, ends, exits, tokens): per state at the segment's start, the state
    at its end and the tokens of its rows; a conversation's first segment starts in state 0 only."""
    told = same(parts, behind(parts), ["conv_id", "segment"], "left")
    told = told.withColumn("end", F.coalesce("end", F.array(*(F.lit(int(x)).cast("long") for x in CLOSED)))).select("conv_id", "segment", "low", "high", "rows", "end")
    kinds = {f.name: f.dataType.simpleString() for f in told.schema}
    fields = ", ".join(f"{c} {kinds[c]}" for c in ("conv_id", "segment", "low", "high", "rows")) + ", cost long, illegal long, ends array<int>, exits array<int>, tokens array<array<string>>"

    def run(batches):
        for batch in _some(batches):
            code, keep, copies, size = _columns(batch)
            n, width = code.shape
            end = np.array(batch.column("end").to_pylist(), np.int64).reshape(n, 4)
            first, final = (batch.column("segment").to_numpy() == batch.column(c).to_numpy() for c in ("low", "high"))
            f = costs(code, keep, copies, size, end)
            start = [(s, e) for s in range(n) for e in (range(1) if first[s] else range(4))]
            path, edits = least_paths(arcs(f, code, keep, copies, size), np.array([s * (width + 1) * 4 + e for s, e in start]))
            exits, words = [[] for _ in range(n)], [[] for _ in range(n)]
            counts = [copies[s, : size[s]].tolist() for s in range(n)]
            for (s, _), p, x in zip(start, path, edits, strict=True):
                many = [*x.tolist(), 0]
                token, state = walk([*p.tolist(), int(p[-1])], many, counts[s], bool(final[s]))
                words[s].append(token)
                exits[s].append(int(state))
            inside = np.arange(width) < size[:, None]
            pairs = inside[:, 1:] & ~legal(code[:, :-1], code[:, 1:])
            illegal = pairs.sum(1) + np.where(inside, copies - 1, 0).sum(1)
            ends = [[int(code[s, 0]), int(code[s, size[s] - 1])] for s in range(n)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv_id", "segment", "low", "high", "rows")), pa.array(f[:, 0, 0]), pa.array(illegal, pa.int64()),
                 pa.array(ends, pa.list_(pa.int32())), pa.array(exits, pa.list_(pa.int32())), pa.array(words, pa.list_(pa.list_(pa.string())))],
                ["conv_id", "segment", "low", "high", "rows", "cost", "illegal", "ends", "exits", "tokens"])

    return materialise(told.mapInArrow(run, fields), "repair-solved")


def legal(a, b):
    """Whether a row of code ``b`` may follow one of code ``a`` (su, ua, au)."""
    return ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))


def entered(parts: DataFrame) -> DataFrame:
    """(conv_id, segment, entry, border): the state in which each segment of a long conversation starts, and whether
    its first row may not follow the row before."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    lists = parts.where("low < high").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("segment", "exits", "ends"))).alias("parts"))

    def fold(batches):
        for batch in batches:
            for conv, parts in zip(batch.column("conv_id").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                state, before, out = 0, None, []
                for part in parts:
                    out.append((part["segment"], state, int(before is not None and not legal(before, part["ends"][0]))))
                    state, before = part["exits"][state], part["ends"][1]
                names, entry, border = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([conv] * len(out), batch.column("conv_id").type), pa.array(names, pa.int64()), pa.array(entry, pa.int32()), pa.array(border, pa.int64())], ["conv_id", "segment", "entry", "border"])

    return lists.mapInArrow(fold, f"conv_id {kind}, segment long, entry int, border long")


def edits(rows: DataFrame, segment_bits: int = SEGMENT_BITS) -> tuple[DataFrame, DataFrame]:
    """The edits of every row, and a summary per conversation.

    First table: conv_id, turn, role, digest, rid (their order) and token (see ``walk``).  Second: conv_id, cost,
    illegal, audit and the counts gaps, blank, duplicate, truncated.  ``rows`` has conv_id, turn, role, text, copies.
    """
    slim = ordered(rows, segment_bits)
    done = solved(segments(slim))
    told = same(done, entered(done), ["conv_id", "segment"], "left")
    told = told.select("conv_id", "segment", "rows", (F.col("illegal") + F.coalesce("border", F.lit(0))).alias("illegal"), F.when(F.col("segment") == F.col("low"), F.col("cost")).alias("cost"),
                       F.element_at("tokens", F.coalesce("entry", F.lit(0)) + 1).alias("tokens"))
    told = materialise(told, "repair-told")
    audit = F.translate(F.array_join("tokens", ""), "uaUA", "IIRR")
    per = told.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"), F.sort_array(F.collect_list(F.struct("segment", audit.alias("audit")))).alias("parts"))
    per = per.select("conv_id", "cost", "illegal", F.array_join(F.transform("parts", lambda p: p["audit"]), "").alias("audit"))
    one = F.when(F.col("first"), 1).otherwise(0)
    faults = {"blank": F.when(F.col("blank"), F.col("copies")), "duplicate": F.when(~F.col("blank"), F.col("copies") - one), "truncated": F.when(~F.col("blank") & F.col("first") & F.col("cut"), 1)}
    turns = slim.groupBy("conv_id", "turn").agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(name) for name, x in faults.items()))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    counts = turns.groupBy("conv_id").agg(gaps.alias("gaps"), *(F.sum(name).alias(name) for name in faults))
    each = told.select("conv_id", F.explode(F.arrays_zip("rows", "tokens")).alias("x")).select("conv_id", "x.rows.turn", "x.rows.role", "x.rows.digest", "x.rows.rid", F.col("x.tokens").alias("token"))
    return each, same(per, counts, ["conv_id"])


def repaired(rows: DataFrame, each: DataFrame) -> DataFrame:
    """(conv_id, rid, made): the repaired conversations; ``made`` holds the (role, text) that a row and the inserts at it give."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    texts = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.sha2(text, 256).alias("digest"), text.alias("text"), F.lit(None).cast("long").alias("rid"), F.lit(None).cast("string").alias("token"))
    met = texts.unionByName(each.withColumn("text", F.lit(None).cast("string"))).groupBy(*_KEY).agg(*(F.max(c).alias(c) for c in ("text", "rid", "token")))

    def make(c: Column) -> Column:
        of = lambda role, body: F.struct(role.alias("role"), body.alias("text"))
        user, assistant, none = F.lit("user"), F.lit("assistant"), F.lit("")
        return (F.when(c == "u", of(user, none)).when(c == "a", of(assistant, none)).when(c == "K", of(F.col("role"), F.col("text")))
                .when(c == "U", of(user, F.col("text"))).when(c == "A", of(assistant, F.col("text"))))

    steps = F.transform(F.sequence(F.lit(1), F.length("kept")), lambda k: make(F.substring("kept", k, F.lit(1))))
    return met.withColumn("kept", F.replace("token", F.lit("D"), F.lit(""))).where("kept <> ''").select("conv_id", "rid", steps.alias("made"))


def digests(made: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of each conversation's ``role:text`` lines, read in order and never held whole."""
    kind = made.schema["conv_id"].dataType.simpleString()
    lines = F.array_join(F.transform("made", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    dealt = made.select("conv_id", "rid", lines.alias("lines")).repartition("conv_id").sortWithinPartitions("conv_id", "rid")

    def run(batches):
        held, key = None, None
        for batch in batches:
            out = []
            for conv, text in zip(batch.column("conv_id").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                if held is not None and conv == key:
                    held.update(b"\n")
                else:
                    if held is not None:
                        out.append((key, held.hexdigest()))
                    held, key = hashlib.sha256(), conv
                held.update(text.encode("utf-8"))
            if out:
                yield pack(out, batch.column("conv_id").type)
        if held is not None:
            yield pack([(key, held.hexdigest())], batch.column("conv_id").type)

    def pack(out, kind):
        convs, hashes = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(hashes, pa.string())], ["conv_id", "repaired_sha256"])

    return dealt.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def summary(conversations: DataFrame, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """One row per conversation of the table before damage; one without rows after it has zeros and an empty audit."""
    rows = damage(conversations)
    each, per = edits(rows, segment_bits)
    told = same(conversations.select("conv_id").distinct(), same(per, digests(repaired(rows, each)), ["conv_id"], "left"), ["conv_id"], "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return told.select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
