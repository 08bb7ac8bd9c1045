"""Work by blocks of documents: what a block repeats is listed once, so joins see each key once for each block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage

#: Characters of text in a block; a longer document is a block of its own.
BLOCK_CHARS = 4 << 20
#: Keys with at least one part in so many of all rows are broadcast; there can't be more of them than this number.
HEAVY = 1 << 14
#: Keys longer than this many characters are joined, however frequent.
HEAVY_LENGTH = 64


def of_texts(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_CHARS) -> Iterator[tuple[list, pa.Array]]:
    """``(id, text)`` batches -> ``(texts, ids)`` of about ``limit`` characters; a null text is an empty one."""
    texts, ids, held = [], [], 0
    for batch in batches:
        begin = 0
        for at, text in enumerate(batch.column(1)):
            text = text.as_py() or ""
            if texts and held + len(text) > limit:
                yield texts, _joined([*ids, batch.column(0).slice(begin, at - begin)])
                texts, ids, held, begin = [], [], 0, at
            texts.append(text)
            held += len(text)
        ids.append(batch.column(0).slice(begin))
    if texts:
        yield texts, _joined(ids)


def _joined(parts: list[pa.Array]) -> pa.Array:
    return pa.concat_arrays([p for p in parts if len(p)])


def row_of(columns: dict) -> pa.RecordBatch:
    """One row; an Arrow array as a value becomes a list."""
    one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) if isinstance(v, pa.Array) else pa.array([v])
    return pa.RecordBatch.from_arrays([one(v) for v in columns.values()], list(columns))


def pack(numbers) -> bytes:
    return zstandard.compress(np.asarray(numbers, np.uint32).tobytes())


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), np.uint32).astype(np.int64)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Written with ``block``, a number for each row."""
    return stage(rows.withColumn("block", F.monotonically_increasing_id()), name)


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    """``rows`` with the other columns of ``table``, which has one row for each key and in ``weight`` how many rows ask for it.

    Keys that a share of 1/HEAVY of all rows or more ask for are broadcast: by that rule they are at most HEAVY, and
    text keys among them have at most HEAVY_LENGTH characters. So no key that is left has more rows than a task can
    hold, and those that make up most of the rows aren't shuffled.
    """
    total = table.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    heavy = F.col(weight) * HEAVY >= total
    for key in keys:
        if table.schema[key].dataType.simpleString() == "string":
            heavy = heavy & (F.length(key) <= HEAVY_LENGTH)
    table = table.withColumn("heavy_", heavy)
    often, rare = table.where("heavy_").drop("heavy_", weight), table.where("not heavy_").drop("heavy_", weight)
    few = F.broadcast(often.select(*keys))
    return rows.join(F.broadcast(often), keys).unionByName(rows.join(few, keys, "left_anti").join(rare.hint("merge"), keys))
