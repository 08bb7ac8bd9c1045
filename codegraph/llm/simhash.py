"""Near duplicates by SimHash and covering locality-sensitive hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shared import stage

SHINGLE, SEED, RADIUS, BITS = 3, 42, 2, 64
#: Shingles hashed at once, so that a very long text needs no more memory than this.
CHUNK = 1 << 14
#: Buckets of up to so many fingerprints are compared pair by pair.
PAIRS = 16


def simhash(text: str | None, k: int = SHINGLE) -> int:
    """The fingerprint of one text as a signed 64-bit number; 0 for a text without words and for null.

    ASCII letters are lower-cased, words are split at ASCII blanks, shingles are ``k`` words with repeats; fewer
    words make one shingle. A bit is set if over half of the shingles' XXH64 values have it.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) < k:
        words = [b" ".join(words)]
        k = 1
    n, ones = len(words) - k + 1, np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : min(at + CHUNK, n) + k - 1]
        ones += _ones(np.array([xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*(part[i:] for i in range(k))))], "<u8"))
    return _print(ones, n)


def _ones(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _print(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingles that are hashed already."""
    return _print(sum((_ones(hashes[at : at + CHUNK]) for at in range(0, len(hashes), CHUNK)), np.zeros(BITS, np.int64)), len(hashes))


@F.pandas_udf(T.LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(t) for t in texts], dtype="int64")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """``2**(radius+1) - 1`` masks such that any ``radius`` positions are all outside one of them.

    Position i carries a nonzero vector phi(i) of radius+1 bits; mask v holds the positions with <phi(i), v> odd. Any
    ``radius`` vectors are orthogonal to some v, so two fingerprints within the radius agree on a whole mask.
    """
    order = np.random.default_rng(7).permutation(bits)
    top = (1 << (radius + 1)) - 1
    phi = {int(i): 1 + n % top for n, i in enumerate(order)}
    return [sum(1 << i for i in range(bits) if (phi[i] & v).bit_count() % 2) for v in range(1, top + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(classes: DataFrame, every: bool = False) -> DataFrame:
    """``classes(fp, node)``, one row for each fingerprint -> edges ``(a, b)`` that connect those within 2 bits.

    Buckets of the covering tables hold every such pair. In a bucket of up to PAIRS fingerprints they are compared with
    each other. In a larger one the pairs aren't listed: each fingerprint goes to itself and to its one-bit
    neighbours in the positions that the mask leaves free. Two fingerprints are within two bits if and only if they
    meet at such a point, and at most 1 + 37 fingerprints meet at one, so the work is linear in a bucket of any size.
    With ``every`` the edges are all pairs within 2 bits, each once with ``a > b``, at most 2080 for a fingerprint.
    """
    masks = covering_masks()
    tables = F.array(*[F.struct(F.lit(t).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])
    placed = classes.select("fp", "node", F.inline(tables))
    full = placed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = stage(placed.join(full, ["t", "key"]).select("t", "key", "n", "fp", "node"), "buckets")
    small = buckets.where(F.col("n") <= PAIRS)
    other = small.select("t", "key", F.col("fp").alias("fp2"), F.col("node").alias("b"))
    pairs = small.join(other, ["t", "key"]).where((F.col("node") > F.col("b")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= RADIUS)).select(F.col("node").alias("a"), "b")
    flips = F.array(*[F.array(*[F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1]]) for m in masks])
    points = buckets.where(F.col("n") > PAIRS).select("t", "node", "fp", F.explode(flips[F.col("t").cast("int")]).alias("flip")).select("t", "node", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    if every:
        met = points.select("t", "point", "node").join(points.select("t", "point", F.col("node").alias("least")), ["t", "point"]).where("node > least")
    else:
        met = points.select("node", F.expr("min(node) over (partition by t, point)").alias("least"))
    return pairs.unionAll(met.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, fingerprint, component_id)``.

    Equal fingerprints are one class, named by its smallest id; classes within two bits are linked and components are
    taken over classes, so a group of copies is one node. Null and empty texts have fingerprint zero and link like any
    other. Repeated rows come back as often as they came. A row with a null id keeps its fingerprint; its
    component_id is that of its class, null if no row of the class has an id.
    """
    marked = stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(F.col(text_col)).alias("fp")), "fingerprints")
    classes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    found = connected_components(near_links(classes.where("node is not null")))
    named = stage(classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "named")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
