"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Each task packs its own rows online: a bitset keyed by free space holds a fixed number of open
sequences; a piece goes to the fullest one it fits in, and when too many are open the fullest closes.
What is still open at a task's end is a unit of its size, and units are packed once more
in one task for every ``FAN_IN``.  Nothing is shuffled but these units.

Defined results: a null text counts as empty and becomes the single end id; only texts longer than
the capacity are cut; repeated rows and null ids are packed row by row; an empty table gives an
empty result.  Only the id and text columns are read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import chain
from unicodedata import ucd_3_2_0

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rttscope.session import materialise

CAPACITY = 2048
OPEN = 512
#: Tasks that one task of the next round takes over.
FAN_IN = 16
#: A sequence with at most this much free space closes at once.
SLACK = 8
#: Rows sorted by size before they are placed.
LOOKAHEAD = 4096
WORDS_KEPT = 400_000
#: Below it, letters change by lower-casing one by one and have no other form.
LATIN = "\u0130"
#: The vocabulary writes bytes as letters: printable Latin-1 ones as they are, the rest from 256 on in order.
BYTE_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
END_ID = struct.pack("<I", 0)
#: A task numbers its sequences in so many bits.
TASK_BITS = 36


class Bins:
    """Open sequences by free space; bit f of ``mask`` says that one with free space f is open."""

    def __init__(self, capacity: int, most: int, first_id: int):
        self.capacity, self.most, self.next = capacity, most, first_id
        self.mask, self.open = 0, 0
        self.by_free: dict[int, list[int]] = defaultdict(list)

    def _take(self, free: int) -> int:
        ids = self.by_free[free]
        found = ids.pop()
        self.open -= 1
        if not ids:
            self.mask &= ~(1 << free)
        return found

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) for a piece."""
        fitting = self.mask >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            found = self._take(free)
        else:
            free, found = self.capacity, self.next
            self.next += 1
        offset, left = self.capacity - free, free - size
        if left > SLACK:
            self.by_free[left].append(found)
            self.mask |= 1 << left
            self.open += 1
            if self.open > self.most:
                self._take((self.mask & -self.mask).bit_length() - 1)
        return found, offset

    def still_open(self):
        for free, ids in self.by_free.items():
            for i in ids:
                yield i, self.capacity - free


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def letters(text: str) -> bool:
    """Whether all are letters, in Unicode's first versions too: the tokenizer may know no later ones.

    Lower-cased text is asked for: a dotted capital I becomes an i and a mark, which joins the marks behind it.
    """
    return text.isascii() and text.isalpha() or all(ucd_3_2_0.category(c)[0] == "L" for c in text)


class Encoder:
    """Texts to little-endian 32-bit ids; parts between blanks and line breaks are encoded once and remembered.

    The tokenizer's pieces never span white space, so a text's ids are those of its parts in turn.  A part that is
    letters between plain marks is looked up in three: the tokenizer always cuts between letters and marks.
    """

    SPLIT = re.compile(r"([!-&(-;=-@\[-`{-~]*)([^\W\d_]+)([!-&(-;=-@\[-`{-~]*)")  # no apostrophe, no "<"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {"": b""}

    def learn(self, texts: list[list[str]]) -> None:
        """Encode the unknown parts of a slice of texts together."""
        if len(self.parts) > WORDS_KEPT:
            self.parts = {"": b""}
        if len(self.pieces) > WORDS_KEPT:
            self.pieces = {"": b""}
        new = set(chain.from_iterable(texts)).difference(self.parts)
        cut = {}
        for p in new:
            m = self.SPLIT.fullmatch(p)
            cut[p] = (m[1], m[2].lower() if max(m[2]) < LATIN else m[2], m[3]) if m and letters(m[2].lower()) else (p,)
        unknown = {x for xs in cut.values() for x in xs if x not in self.pieces}
        # lower-case Latin letters are one word that normalisation leaves alone: the model alone encodes it
        plain = [x for x in unknown if x.isalpha() and max(x) < LATIN and x.islower()]
        model = self.tokenizer.model.tokenize
        for x in plain:
            self.pieces[x] = packed([t.id for t in model(x if x.isascii() else x.encode().decode("latin-1").translate(BYTE_LETTERS))])
        unknown = list(unknown.difference(plain))
        for x, e in zip(unknown, self.tokenizer.encode_batch_fast(unknown, add_special_tokens=False) if unknown else (), strict=True):
            self.pieces[x] = packed(e.ids)
        known = self.pieces
        for p, xs in cut.items():
            self.parts[p] = b"".join([known[x] for x in xs])

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        split = [(t or "").replace("\n", " ").split(" ") for t in texts]
        self.learn(split)
        of = self.parts.__getitem__
        return [b"".join([*map(of, parts), END_ID]) for parts in split]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder for a Python worker, which runs many tasks."""
    return Encoder(path)


FIELDS = "piece int, start long, length long, ids_crc32 long, unit long, inner long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, open_bins: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of every text with the unit (a sequence of this task) and place they got."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = docs.sparkSession.createDataFrame([], f"{id_col} {kind}, {FIELDS}").schema

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        encode = encoder(tokenizer_path)
        bins = Bins(capacity, open_bins, TaskContext.get().partitionId() << TASK_BITS)
        for batch in batches:
            for at in range(0, batch.num_rows, LOOKAHEAD):
                rows = []
                for start in range(at, min(at + LOOKAHEAD, batch.num_rows), 256):
                    part = batch.slice(start, min(256, at + LOOKAHEAD - start))
                    for i, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                        for k, first in enumerate(range(0, len(ids) // 4, capacity)):
                            cut = ids[4 * first : 4 * (first + capacity)]
                            rows.append((i, k, first, len(cut) // 4, zlib.crc32(cut)))
                rows.sort(key=lambda r: -r[3])
                placed = [(*r, *bins.place(r[3])) for r in rows]
                if placed:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*placed, strict=True), arrow, strict=True)], schema=arrow)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def repack(units: DataFrame, tasks: int, capacity: int, open_bins: int, number: int) -> DataFrame:
    """(unit, target, shift): what is packed together, by tasks of ``FAN_IN`` former ones."""
    first = (number + 1) << 60  # ids of this round differ from those of every other

    def run(frames):
        import pandas as pd

        bins = Bins(capacity, open_bins, first + (TaskContext.get().partitionId() << TASK_BITS))
        for frame in frames:
            frame = frame.sort_values(["size", "unit"], ascending=[False, True])
            placed = [bins.place(s) for s in frame["size"].tolist()]
            yield pd.DataFrame({"unit": frame["unit"], "target": [p[0] for p in placed], "shift": [p[1] for p in placed]})

    dealt = units.repartition(tasks, F.pmod(F.xxhash64("unit"), F.lit(tasks))).sortWithinPartitions("unit")
    return dealt.mapInPandas(run, "unit long, target long, shift long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, open_bins: int = OPEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its sequence and its gapless place there."""
    table = materialise(pieces(docs, tokenizer_path, capacity, open_bins, id_col, text_col), "pieces")
    sizes = table.groupBy("unit").agg(F.sum("length").alias("size"))
    units = materialise(sizes, "units")
    tasks = max(1, units.select(F.shiftright("unit", TASK_BITS)).distinct().count() // FAN_IN)
    moved = materialise(repack(units.where(F.col("size") < capacity - SLACK), tasks, capacity, open_bins * 4, 1), "repacked")
    return table.join(moved, "unit", "left").select(
        id_col, "piece", "start", "length", "ids_crc32", F.coalesce("target", "unit").alias("sequence_id"), (F.col("inner") + F.coalesce("shift", F.lit(0))).alias("offset"))
