"""Small helpers shared by the operators: row slices of Arrow batches and digests of words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = b" \t\n\v\f\r"


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into short slices, so that few texts are Python strings at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_texts(docs: DataFrame, columns: list[str], fields: str, fn: Callable[[list], list[tuple]], rows: int = 256, last: Callable[[], list[tuple]] | None = None) -> DataFrame:
    """``fn`` turns a slice's column lists into output rows, ``last`` gives a task's rows behind them; only ``columns`` leave the scan."""
    schema = docs.sparkSession.createDataFrame([], fields).schema
    names = schema.fieldNames()

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        made = (fn(*(part.column(i).to_pylist() for i in range(part.num_columns))) for part in slices(batches, rows))
        for out in chain(made, (x() for x in [last] if x)):
            if out:
                cells = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, arrow.field(n).type) for c, n in zip(cells, names, strict=True)], schema=arrow)

    return docs.select(*columns).mapInArrow(run, schema)


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted column names, each prefixed until no column of ``taken`` has it (names differ in more than case)."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def numbered(words: list) -> np.ndarray:
    """Each word's number by first appearance in the list."""
    ids: defaultdict = defaultdict(count().__next__)
    return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))


def fold_remainder(column: str, modulus: int):
    """``crc32`` of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus
