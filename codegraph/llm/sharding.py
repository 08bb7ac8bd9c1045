"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .prp import key_of, permute
from .shared import free_name, quoted, stage

SHARDS, SEED = 16, 20
#: Input partitions are joined into at most so many lanes, which bounds the matrix.
LANES = 4096
#: A shard is written in slices of about so many rows and bytes of text, whichever makes more of them.
SLICE_ROWS, SLICE_BYTES = 1 << 16, 64 << 20
#: Counts are drawn within so many standard deviations of their mode (and this many more); what lies outside is below 1e-30.
REACH = 12


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows drawn without replacement are good, for populations of any size.

    The distribution's weights follow from its mode by the ratio of neighbours, exact up to the rounding of doubles.
    """
    total, low, high = good + bad, max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    spread = math.sqrt(n * (good / total) * (bad / total) * ((total - n) / max(total - 1, 1)))
    reach = int(REACH * spread) + 60
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    above = np.cumprod((good - up) * (n - up) / ((up + 1) * (bad - n + up + 1)))
    below = np.cumprod(down * (bad - n + down) / ((good - down + 1) * (n - down + 1)))
    weights = np.concatenate([below[::-1], [1.0], above])
    sums = np.cumsum(weights)
    return mode - len(below) + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """How many rows each lane sends to each shard, drawn as a uniform shuffle would send them.

    Row sums are ``rows``; column sums differ by at most one, larger ones first.
    """
    total = sum(rows)
    return counts_with_sums(rows, [total // shards + (s < total % shards) for s in range(shards)], np.random.default_rng(seed))


def counts_with_sums(rows: list[int], room: list[int], rng: np.random.Generator) -> np.ndarray:
    """A table of counts with the row sums ``rows`` and the column sums ``room``, drawn as a uniform shuffle gives it."""
    out = np.zeros((len(rows), len(room)), np.int64)
    for lane, n in enumerate(rows):
        left, rest = n, sum(room)
        for s in range(len(room)):
            rest -= room[s]
            out[lane, s] = hypergeometric(rng, room[s], rest, left)
            left -= out[lane, s]
        room = [a - int(b) for a, b in zip(room, out[lane])]
    return out


def shard(df: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``df`` with ``shard`` (0 to shards-1) and ``slot`` (0 to size-1, gapless in a shard), in the order of the slots.

    Shard sizes differ by at most one row and don't depend on what a row holds, so copies and null rows spread like
    any others. Rows are first written with their place in the partition they lie in; every later step is a
    function of that place, so a task that runs again gives the same rows. Counts and bytes of partitions meet on the driver (two
    numbers for each input partition); rows never do. Columns named ``shard`` and ``slot`` are replaced; other columns
    are kept. An empty table gives an empty result.
    """
    df = df.drop("shard", "slot")
    part, at = free_name("part", df), free_name("at", df)
    low = (1 << 33) - 1
    placed = stage(df.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id().bitwiseAND(low)), "placed")
    wide = [F.coalesce(F.octet_length(quoted(f.name)), F.lit(0)) for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    tallied = placed.groupBy(part).agg(F.count("*"), F.sum(sum(wide, F.lit(0)).cast("long"))).collect()
    counts, volume = {r[0]: r[1] for r in tallied}, sum(r[2] or 0 for r in tallied)
    parts = max(counts, default=0) + 1
    sizes = np.array([counts.get(p, 0) for p in range(parts)], np.int64)
    lane_of = np.arange(parts) * min(LANES, parts) // parts
    lanes = np.bincount(lane_of, weights=sizes).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    first -= np.concatenate([[0], np.cumsum(lanes)])[lane_of]
    matrix = communication_matrix(lanes.tolist(), shards, seed)
    starts = np.concatenate([np.zeros((len(lanes), 1), np.int64), np.cumsum(matrix, axis=1)], axis=1)
    arrived = np.cumsum(matrix, axis=0) - matrix
    room = matrix.sum(axis=0)
    slices = max(1, -(-int(room.max(initial=0)) // SLICE_ROWS), -(-volume // (shards * SLICE_BYTES)))

    @F.pandas_udf("shard int, slot long, slice int")
    def place(parts_: pd.Series, at_: pd.Series) -> pd.DataFrame:
        p = parts_.to_numpy()
        lane = lane_of[p]
        local = permute(first[p] + at_.to_numpy(), lanes[lane], key_of(seed, 1, lane))
        to = (local[:, None] >= starts[lane, 1:]).sum(axis=1)
        slot = permute(arrived[lane, to] + local - starts[lane, to], room[to], key_of(seed, 2, to))
        return pd.DataFrame({"shard": to.astype("int32"), "slot": slot, "slice": (to * slices + slot * slices // np.maximum(room[to], 1)).astype("int32")})

    got = free_name("got", df)
    sent = placed.withColumn(got, place(part, at)).repartitionById(shards * slices, F.col(f"{got}.slice"))
    return sent.select(*map(quoted, df.columns), F.col(f"{got}.shard").alias("shard"), F.col(f"{got}.slot").alias("slot")).sortWithinPartitions("shard", "slot")
