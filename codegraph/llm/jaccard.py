"""Near duplicates by exact Jaccard similarity of word shingles.

Each pair of texts is the matter of one of two searches. Pairs whose SimHash fingerprints lie within the radius of the
covering tables are found by these alone. Similar texts may lie farther apart than any radius that can be covered, so
pairs beyond it, and those of fingerprints that too many texts share, are found by a prefix filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shared import drop_staged, free_name, quoted, stage, with_rows
from .simhash import RADIUS, majority, near_links

#: The similarity is a fraction, so that it is compared in whole numbers.
SHINGLE, THRESHOLD, SEED = 5, (4, 5), 42
#: Shingles are ordered by how full their slot of 2**SLOT_BITS is. The order decides how much work there is, not what is found.
SLOT_BITS = 16
#: A sketch has the parities of the shingles that fall on each of its bits, so sets differ in at least as many shingles as
#: their sketches in bits. It has over SKETCH_SPREAD bits for each shingle, a power of two: halves fold onto each other.
SKETCH_SPREAD, LEAST_SKETCH = 1, 128
#: In buckets of up to so many documents all pairs are candidates. Fingerprints of more texts aren't looked up in the tables.
SMALL = 16
#: Texts whose shingles a task holds at once.
TEXTS = 256
#: Pairs, and words of sketches of pairs, that are compared at once.
PAIRS = 1 << 19
#: Documents of a crowded bucket meet in blocks of about so many each.
BLOCK = 1024


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The distinct XXH64 values of runs of ``k`` words, sorted; fewer words make one shingle. Words are those of ``simhash``."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    k = min(k, max(len(words), 1))
    if not words:
        return np.zeros(0, np.int64)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(k))))), np.uint64, len(words) - k + 1)).view(np.int64)


def word_print(text: str | None) -> int:
    """The SimHash fingerprint of a text's distinct words.

    A changed word changes ``k`` shingles of ``k`` words but one word, so similar texts are nearer than by shingles.
    """
    words = set(text.encode("utf-8", "surrogatepass").lower().split()) if text else ()
    return majority(np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words)))


def _slots(h: np.ndarray) -> np.ndarray:
    return h & ((1 << SLOT_BITS) - 1)


def _fill(frames: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    for frame in frames:
        for text in frame["text"]:
            np.add.at(counts, _slots(shingles(text, k)), 1)
    at = np.flatnonzero(counts)
    yield pd.DataFrame({"slot": at, "n": counts[at]})


def prefix(h: np.ndarray, fill: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> np.ndarray:
    """The first shingles in the common order, one more than a text of the threshold's similarity may lack.

    Two sets of that similarity share at least that part of the larger one, so their prefixes have a shingle in common.
    """
    over, under = threshold
    n = len(h) - -(-len(h) * over // under) + 1 if len(h) else 0
    return h[np.lexsort((h, fill[_slots(h)]))[:n]]


def sketch(h: np.ndarray) -> np.ndarray:
    bits = max(LEAST_SKETCH, 1 << (SKETCH_SPREAD * len(h)).bit_length())
    odd = np.bincount((h >> 20) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _folded(x, y):
    """The sketch ``x`` in the size of ``y`` if that is half its own."""
    half = (F.size(x) / 2).cast("int")
    return F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda a, b: a.bitwiseXOR(b))).otherwise(F.col(x))


def _same_size(nx, ny, threshold):
    """Whether the sizes of two sets allow the threshold: the smaller may hold at most that part of the larger."""
    over, under = threshold
    return (under * nx >= over * ny) & (under * ny >= over * nx)


def _may_be_similar(apart, n, threshold):
    """Whether sets of ``n`` shingles together, ``apart`` or more of them in one alone, can reach the threshold."""
    over, under = threshold
    return (over + under) * apart <= (under - over) * n


def _by_tables(fx, fy):
    """Whether a pair is the covering tables' matter; one with a null fingerprint isn't."""
    return F.coalesce(F.bit_count(fx.bitwiseXOR(fy)) <= RADIUS, F.lit(False))


def _similar(both, n, threshold):
    """Whether sets of ``n`` shingles together, ``both`` of them in both, reach the threshold."""
    over, under = threshold
    return (over + under) * both >= over * n


def _possible(frame: pd.DataFrame, threshold: tuple[int, int]) -> pd.DataFrame:
    """The rows of two blocks, or of one, whose size and sketch let them be similar to a row of another component."""
    n, group, width = frame["n"].to_numpy(), frame["component"].to_numpy(), frame["sketch"].map(len).to_numpy()
    first, second = (frame["block"].to_numpy() == frame[c].iat[0] for c in ("r", "s"))
    keep = np.zeros(len(frame), bool)
    for w in np.unique(width):
        for v in (w // 2, w, w * 2):
            a, b = np.flatnonzero(first & (width == w)), np.flatnonzero(second & (width == v))
            if not len(a) or not len(b):
                continue
            x, y = (_fold(np.stack(frame["sketch"].iloc[i].to_numpy()).view(np.uint64), min(v, w)) for i in (a, b))
            for at in range(0, len(a), rows := max(1, PAIRS // len(b))):
                some = a[at : at + rows]
                i, j = np.nonzero(_same_size(n[some][:, None], n[b], threshold) & (group[some][:, None] != group[b]))
                for k in range(0, len(i), step := max(1, PAIRS // min(v, w))):
                    u, o = i[k : k + step], j[k : k + step]
                    apart = np.bitwise_count(x[at + u] ^ y[o]).sum(axis=1, dtype=np.int64)
                    good = _may_be_similar(apart, n[some[u]] + n[b[o]], threshold)
                    keep[some[u[good]]] = True
                    keep[b[o[good]]] = True
    return frame.loc[keep, ["h", "r", "s", "block", "node", "component"]]


def _fold(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else x[:, :width] ^ x[:, width:]


def _meet(frame: pd.DataFrame, threshold: tuple[int, int]) -> pd.DataFrame:
    """The pairs of two blocks, or of one, that join groups: what is connected already isn't compared again."""
    group = frame["component"].to_list()
    up = {c: c for c in group}

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    sets, nodes, out = [set(x) for x in frame["set"]], frame["node"].to_list(), []
    first, second = (np.flatnonzero(frame["block"] == frame[c].iat[0]) for c in ("r", "s"))
    same = frame["r"].iat[0] == frame["s"].iat[0]
    for i in first:
        for j in second:
            if same and j <= i or (a := root(group[i])) == (b := root(group[j])):
                continue
            x, y = sets[i], sets[j]
            if _similar(min(len(x), len(y)), len(x) + len(y), threshold) and _similar(len(x & y), len(x) + len(y), threshold):
                up[b] = a
                out.append((nodes[i], nodes[j]))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _links(crowded: DataFrame, sketches: DataFrame, printed: DataFrame, sets_of, threshold: tuple[int, int]) -> DataFrame:
    """``crowded(h, node, n, least)``, the buckets of shingles -> edges ``(a, b)`` that connect what is similar in a bucket.

    First the documents of buckets up to SMALL meet each other; in larger ones each meets the least, unless they are a
    pair that the covering tables answer for. Such pairs, ``printed(a, b)``, come with them. A larger bucket whose
    others are then one component is done. In the rest all pairs of different components are compared, block by block;
    buckets of the same documents are one. Sets are fetched only where sketches let two documents be similar.
    """
    small = crowded.where(F.col("n") <= SMALL)
    small = small.select("h", "node").join(small.select("h", F.col("node").alias("least")), "h").where("node > least").select("node", "least")
    large = crowded.where((F.col("n") > SMALL) & (F.col("node") != F.col("least")))
    pairs = small.unionAll(large.select("node", "least")).withColumn("tables", F.lit(False))
    pairs = pairs.unionAll(printed.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("least"), F.lit(True)))
    pairs = stage(pairs.distinct(), "pairs")
    left, right = sketches.select("node", F.col("n").alias("nx"), F.col("fp").alias("fx")), sketches.select(F.col("node").alias("least"), F.col("n").alias("ny"), F.col("fp").alias("fy"))
    fit = _same_size(F.col("nx"), F.col("ny"), threshold) & (F.col("tables") == _by_tables(F.col("fx"), F.col("fy")))
    sized = stage(pairs.join(right, "least").join(left, "node").where(fit).select("node", "least"), "sized")
    left, right = sketches.select("node", F.col("n").alias("nx"), F.col("sketch").alias("sx")), sketches.select(F.col("node").alias("least"), F.col("n").alias("ny"), F.col("sketch").alias("sy"))
    apart = F.aggregate(F.zip_with(_folded("sx", "sy"), _folded("sy", "sx"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, c: a + c)
    likely = stage(sized.join(right, "least").join(left, "node").where(_may_be_similar(apart, F.col("nx") + F.col("ny"), threshold)).select("node", "least"), "likely")
    drop_staged(pairs, sized)
    sets = stage(sets_of(likely.select(F.explode(F.array("node", "least")).alias("row")).distinct()), "sets")
    left, right = sets.select("node", F.col("set").alias("x")), sets.select(F.col("node").alias("least"), F.col("set").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    near = stage(likely.join(right, "least").join(left, "node").where(_similar(both, F.size("x") + F.size("y"), threshold)).select(F.col("node").alias("a"), F.col("least").alias("b")), "near")
    drop_staged(likely, sets)
    parts = stage(connected_components(near), "parts")
    rest = stage(large.join(parts, "node", "left").select("h", "node", F.coalesce("component", "node").alias("component")), "rest")
    buckets = rest.groupBy("h").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"), F.bit_xor(F.xxhash64("node")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(SEED), "node")).alias("s2")).where("low < high")
    buckets = stage(buckets.groupBy("n", "s1", "s2").agg(F.min("h").alias("h")).select("h", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "open")
    dealt = rest.join(buckets, "h").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("h", F.least("block", "other").alias("r"), F.greatest("block", "other").alias("s"), "block", "node", "component").join(sketches.drop("fp"), "node")
    possible = stage(dealt.groupBy("h", "r", "s").applyInPandas(lambda f: _possible(f, threshold), "h long, r int, s int, block int, node long, component long"), "possible")
    drop_staged(rest, buckets, parts)
    sets = sets_of(possible.select(F.col("node").alias("row")).distinct())
    more = possible.join(sets, "node").groupBy("h", "r", "s").applyInPandas(lambda f: _meet(f, threshold), "a long, b long")
    more = stage(more.distinct(), "more")
    drop_staged(possible)
    return near.unionByName(more)


def keep_one(docs: DataFrame, k: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that with the smallest id, rows without an id last.

    Two rows are near duplicates if their sets of ``k``-word shingles have at least the Jaccard similarity
    ``threshold`` (over, under); groups are the components of that relation, and no pair is missed: those whose
    fingerprints of distinct words differ in up to RADIUS bits come from the covering tables, unless over SMALL classes
    of texts have the same fingerprint, all others from the prefix filter. Shingles are compared by 64-bit hashes. Texts
    without words, null ones too, are one group. Rows are told apart by their place, so equal or missing ids don't matter.
    """
    number = free_name("row", docs)
    rows = with_rows(docs, number)
    texts = rows.select(F.col(number).alias("row"), F.col(quoted(text_col)).alias("text"))
    fill = np.zeros(1 << SLOT_BITS, np.int64)
    for slot, n in texts.select("text").mapInPandas(lambda fs: _fill(fs, k), "slot long, n long").groupBy("slot").agg(F.sum("n")).collect():
        fill[slot] = n

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (frame.iloc[at : at + TEXTS] for frame in frames for at in range(0, len(frame), TEXTS)):
            found = [shingles(t, k) for t in part["text"]]
            prints = [xxhash.xxh3_128_digest(h.tobytes()) for h in found]
            yield pd.DataFrame({"row": part["row"], "print": prints, "fp": [word_print(t) for t in part["text"]], "n": [len(h) for h in found], "sketch": [sketch(h) for h in found], "prefix": [prefix(h, fill, threshold) for h in found]})

    marked = stage(texts.mapInPandas(mark, "row long, print binary, fp long, n long, sketch array<long>, prefix array<long>"), "marked")
    # One class for each set of shingles, named by its row that is kept; among classes the same rule decides.
    named = marked.select("row", "print").join(rows.select(F.col(number).alias("row"), F.col(quoted(id_col)).alias("id")), "row")
    classes = stage(named.groupBy("print").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")).select("best", F.col("best.row").alias("node")), "classes")
    placed = stage(marked.join(classes.select(F.col("node").alias("row")), "row", "left_semi").select(F.explode("prefix").alias("h"), F.col("row").alias("node")), "prefixes")
    worded = stage(marked.where("n > 0").select(F.col("row").alias("node"), "fp").join(classes.select("node"), "node", "left_semi"), "worded")
    prints = stage(worded.groupBy("fp").agg(F.count("*").alias("w")), "prints")
    few = prints.where(F.col("w") <= SMALL)
    met = near_links(few.select("fp", F.col("fp").alias("node")), every=True).unionAll(few.where("w > 1").select("fp", "fp"))
    met = met.join(worded.select(F.col("fp").alias("a"), "node"), "a").join(worded.select(F.col("fp").alias("b"), F.col("node").alias("other")), "b")
    printed = stage(met.where("a <> b or node > other").select(F.col("node").alias("a"), F.col("other").alias("b")), "printed")
    shared = stage(placed.groupBy("h").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1").select("h", "n", "least"), "shared")
    crowded = stage(placed.join(shared, "h").select("h", "node", "n", "least"), "crowded")
    met = crowded.select("node").unionAll(printed.select(F.explode(F.array("a", "b")))).distinct()
    many = prints.where(F.col("w") > SMALL).select("fp", F.lit(True).alias("many"))
    sketches = marked.select(F.col("row").alias("node"), "n", "fp", "sketch").join(met, "node", "left_semi").join(many, "fp", "left")
    sketches = stage(sketches.select("node", "n", F.when(F.col("many").isNull(), F.col("fp")).alias("fp"), "sketch"), "sketches")
    drop_staged(placed, shared, marked, worded, prints)
    hashed = F.pandas_udf(lambda ts: pd.Series([shingles(t, k) for t in ts]), T.ArrayType(T.LongType()))
    sets_of = lambda some: texts.join(some, "row", "left_semi").select(F.col("row").alias("node"), hashed("text").alias("set"))
    parts = connected_components(_links(crowded, sketches, printed, sets_of, threshold))
    kept = stage(classes.join(parts, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("best").alias("best")).select("best.row"), "kept")
    drop_staged(crowded, sketches, classes, printed)
    return rows.join(kept.withColumnRenamed("row", number), number, "left_semi").select(*map(quoted, docs.columns))
