"""Hard negatives by exact inner products: a cover tree over norm-augmented candidates."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .shared import stage

#: Components of larger magnitude would let inner products leave the range of exact doubles or longs.
LIMIT = 1 << 20
#: Cells are fitted to at most so many rows, the first by a hash of the id; every row is put into a cell.
SAMPLE, MAX_CELLS = 8192, 4096
#: Candidates in a block, which has a tree of its own, and anchors that meet it in a task.
BLOCK, ANCHORS = 4096, 2048
#: Radii of the levels of a tree shrink by this factor; up to LEAF points, or where a level would have a node for every
#: two points, there are no further levels.
BASE, LEAF = 1.3, 128
#: Relative slack of bounds that are computed in doubles.
SLACK = 1e-7


class Tree:
    """A cover tree over the rows of a block, each of which lies on a sphere through an added component.

    On the sphere of radius ``norm`` the inner product of an anchor with a point is |anchor| * norm * cos of the angle
    between them (the anchor's added component is 0), so the angle of a node's covering radius bounds those of all its points.
    """

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, norm: float):
        self.x, self.labels, self.norm = vectors, labels, norm
        rest = np.sqrt(np.maximum(norm * norm - (vectors * vectors).sum(axis=1), 0))
        self.sphere = np.column_stack([vectors, rest])
        self.centers, self.radius, self.low, self.high, self.below, self.points = [], [], [], [], [], []
        todo = [(self._node(np.arange(len(vectors)), int(np.argmax(self.sphere @ self.sphere.mean(axis=0)))))]
        while todo:
            me = todo.pop()
            for part, center in self._level(me):
                self.below[me].append(child := self._node(part, center))
                todo.append(child)
            if self.below[me]:
                self.points[me] = None
        self.centers = np.array(self.centers)
        self.cos, self.sin = np.cos(self.radius), np.sin(self.radius)
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.below = [np.array(b) for b in self.below]

    def _node(self, part: np.ndarray, center: int) -> int:
        far = np.sqrt(((self.sphere[part] - self.sphere[center]) ** 2).sum(axis=1)).max(initial=0)
        self.centers.append(center)
        self.radius.append(2 * np.arcsin(min(1, far / (2 * self.norm))) if self.norm else 0.0)
        self.low.append(self.labels[part].min())
        self.high.append(self.labels[part].max())
        self.below.append([])
        self.points.append(part)
        return len(self.centers) - 1

    def _level(self, node: int) -> list[tuple[np.ndarray, int]]:
        """The parts of the next level: centers farther than its radius from each other, the others with the nearest."""
        part = self.points[node]
        if len(part) <= LEAF or self.radius[node] == 0:
            return []
        here = self.sphere[part]
        # All points have one norm, so squared distances follow from products. They only choose centers; bounds don't use them.
        whole = 2 * self.norm * self.norm
        aim = (2 * self.norm * np.sin(self.radius[node] / 2) / BASE) ** 2
        centers, owner = [self.centers[node]], np.zeros(len(part), int)
        near = whole - 2 * (here @ self.sphere[centers[0]])
        while near.max() > aim:
            if 2 * len(centers) > len(part):
                return []
            far = int(near.argmax())
            d = whole - 2 * (here @ here[far])
            closer = d < near
            owner[closer], near[closer] = len(centers), d[closer]
            centers.append(int(part[far]))
        if len(centers) == 1:
            return []
        return [(part[owner == c], center) for c, center in enumerate(centers)]

    def bounds(self, nodes: np.ndarray, anchor: np.ndarray, length: float) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest inner product that a point of each node can have with the anchor."""
        top = length * self.norm
        if not top:
            return np.zeros(len(nodes)), np.zeros(len(nodes))
        return _cone(self.x[self.centers[nodes]] @ anchor / top, self.cos[nodes], self.sin[nodes], top)

    def search(self, anchor: np.ndarray, label: int, wanted: "Wanted") -> None:
        """Visit the leaves in the order of their bounds and offer the scores of their rows."""
        length = float(np.sqrt(anchor @ anchor))
        root = np.array([0])
        low, high = self.bounds(root, anchor, length)
        heap = [(-high[0], low[0], 0)]
        while heap:
            high, low, node = heappop(heap)
            if not wanted.reached(low, -high):
                if wanted.done(-high):
                    return
                continue
            below = self.below[node]
            if not len(below):
                part = self.points[node]
                part = part[wanted.allowed(self.labels[part], label)]
                wanted.offer(part, self.x[part] @ anchor)
                continue
            below = below[wanted.possible(self.low[below], self.high[below], label)]
            low, high = self.bounds(below, anchor, length)
            good = wanted.reached(low, high)
            for n, lo, hi in zip(below[good], low[good].tolist(), high[good].tolist()):
                heappush(heap, (-hi, lo, n))


def _cone(cos, cos_r, sin_r, top):
    """Bounds of ``top`` * cos of the angles within a cone around an angle of the given cosine."""
    cos = np.clip(cos, -1, 1)
    sin = np.sqrt(1 - cos * cos)
    high = np.where(cos >= cos_r, 1.0, cos * cos_r + sin * sin_r)
    low = np.where(cos <= -cos_r, -1.0, cos * cos_r - sin * sin_r)
    return (low - SLACK) * top, (high + SLACK) * top


class Wanted:
    """The best ``k`` rows of each window of scores: higher scores first, then smaller ids.

    ``least`` holds for each window a score that is reached for certain; ``same`` tells whether rows are to have
    the anchor's label or another one.
    """

    def __init__(self, k: int, windows: list[tuple[float, float]], least: list[float], ids: np.ndarray, same: bool, skip: np.ndarray | None):
        self.k, self.windows, self.least, self.ids, self.same, self.skip = k, windows, list(least), ids, same, skip
        self.found: list[list] = [[] for _ in windows]

    def reached(self, low, high):
        """Whether scores from ``low`` to ``high`` (arrays too) can hold anything that a window wants."""
        out = np.zeros(np.shape(high), bool)
        for (lo, hi), least in zip(self.windows, self.least):
            out |= (high >= max(lo, least)) & (low <= hi)
        return out

    def done(self, high: float) -> bool:
        """Whether no window wants anything that has no higher bound than this."""
        return all(high < max(lo, least) for (lo, _), least in zip(self.windows, self.least))

    def allowed(self, labels, label):
        return (labels == label) == self.same

    def possible(self, low, high, label):
        return (low <= label) & (label <= high) if self.same else (low != label) | (high != label)

    def offer(self, part: np.ndarray, scores: np.ndarray) -> None:
        if self.skip is not None:
            part, scores = part[keep := ~self.skip[part]], scores[keep]
        for w, (lo, hi) in enumerate(self.windows):
            some = np.flatnonzero((scores >= max(lo, self.least[w])) & (scores <= hi))
            if len(some) > self.k:
                edge = np.partition(scores[some], len(some) - self.k)[len(some) - self.k]
                some = some[scores[some] >= edge]
            if len(some):
                best = sorted([*self.found[w], *zip((-scores[some]).tolist(), self.ids[part[some]].tolist(), part[some].tolist())])[: self.k]
                self.found[w] = best
                if len(best) == self.k:
                    self.least[w] = max(self.least[w], -best[-1][0])


def _matrix(vectors) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


class Cells:
    """The top level: centers that every row is put to, with the angle and the labels of each cell's rows."""

    def __init__(self, sample: pd.DataFrame, rows: int, norm: float):
        x = _matrix(sample["v"])
        self.norm, self.sample, self.labels, self.ids = norm, x, sample["label"].to_numpy(), sample["row"].to_numpy()
        sphere, n = _on_sphere(x, norm), min(MAX_CELLS, max(1, -(-rows // BLOCK)))
        centers, near = [0], ((sphere - sphere[0]) ** 2).sum(axis=1)
        while len(centers) < n and near.max() > 0:
            centers.append(int(near.argmax()))
            near = np.minimum(near, ((sphere - sphere[centers[-1]]) ** 2).sum(axis=1))
        self.centers = sphere[centers]

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest center of each row, and the angle to it."""
        sphere = _on_sphere(x, self.norm)
        cell = np.concatenate([(sphere[i : i + 1024] @ self.centers.T).argmax(axis=1) for i in range(0, len(sphere), 1024)])
        chord = np.sqrt(((sphere - self.centers[cell]) ** 2).sum(axis=1))
        return cell, 2 * np.arcsin(np.minimum(1, chord / (2 * self.norm))) if self.norm else np.zeros(len(x))

    def measured(self, stats: pd.DataFrame) -> "Cells":
        """With ``stats(cell, n, radius, low, high)``, which are over all rows."""
        stats = stats.set_index("cell").reindex(range(len(self.centers)))
        self.blocks = np.ceil(stats["n"].fillna(0).to_numpy() / BLOCK).astype(int)
        self.radius, self.low, self.high = (stats[c].fillna(0).to_numpy() for c in ("radius", "low", "high"))
        self.cos, self.sin = np.cos(np.minimum(self.radius, np.pi)), np.sin(np.minimum(self.radius, np.pi))
        return self

    def visited(self, anchor: np.ndarray, label: int, wanted: Wanted) -> list[tuple[int, int]]:
        """The blocks that may hold what is wanted."""
        top = float(np.sqrt(anchor @ anchor)) * self.norm
        cos = self.centers[:, :-1] @ anchor / top if top else np.zeros(len(self.centers))
        low, high = _cone(cos, self.cos, self.sin, top)
        good = (self.blocks > 0) & wanted.possible(self.low, self.high, label)
        return [(int(c), b) for c in np.flatnonzero(good & wanted.reached(low, high)) for b in range(self.blocks[c])]

    def seen(self, anchor: np.ndarray, label: int, row: int, k: int, windows, same: bool) -> list[float]:
        """For each window the score of the ``k``-th best row of the sample, which the best of all rows reach."""
        scores = self.sample @ anchor
        good = ((self.labels == label) == same) & (self.ids != row)
        out = []
        for lo, hi in windows:
            some = scores[good & (scores >= lo) & (scores <= hi)]
            out.append(float(np.partition(some, len(some) - k)[len(some) - k]) if len(some) >= k else -np.inf)
        return out


def _on_sphere(x: np.ndarray, norm: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0))])


def windows_of(scores, low: int, high: int) -> list[tuple[int, int]]:
    """From ``low`` to ``high`` hundredths of each score, in whole numbers; empty below zero."""
    return [(-(-low * int(p) // 100), high * int(p) // 100) for p in scores]


def _best(asked: DataFrame, candidates: DataFrame, cells: Cells, k: int, same: bool, bounds: tuple[int, int] | None) -> DataFrame:
    """``asked(row, label, v, scores)`` -> ``(row, place, other, score, rank)``: the best ``k`` candidates for each window.

    Without ``bounds`` there is one window of all scores, else one for each of ``scores``. Anchors go to the blocks that
    the cells' bounds leave, in groups of at most ANCHORS or so, and meet each block's tree there.
    """
    windows = (lambda s: windows_of(s, *bounds)) if bounds else lambda s: [(-np.inf, np.inf)]

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row, label, v, s in zip(frame["row"], frame["label"], frame["v"], frame["scores"]):
                anchor, spans = np.asarray(v, np.float64), windows(s)
                least = cells.seen(anchor, label, row, k, spans, same)
                wanted = Wanted(k, spans, least, cells.ids, same, None)
                out += [(row, label, v, s, least, c, b) for c, b in cells.visited(anchor, label, wanted)]
            yield pd.DataFrame(out, columns=["row", "label", "v", "scores", "least", "cell", "block"])

    routed = stage(asked.select("row", "label", "v", "scores").mapInPandas(visit, "row long, label int, v array<int>, scores array<long>, least array<double>, cell int, block int"), "routed")
    groups = routed.groupBy("cell", "block").agg(F.ceil(F.count("*") / ANCHORS).cast("int").alias("parts"))
    left = routed.join(groups, ["cell", "block"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    right = candidates.join(groups, ["cell", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys, norm = ["cell", "block", "part"], cells.norm

    def meet(anchors: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(block):
            tree, ids, rows = Tree(_matrix(block["v"]), block["label"].to_numpy(), norm), block["vec_id"].to_numpy(), block["row"].to_numpy()
            for row, label, v, s, least in zip(anchors["row"], anchors["label"], anchors["v"], anchors["scores"], anchors["least"]):
                wanted = Wanted(k, windows(s), least, ids, same, rows == row if same else None)
                tree.search(np.asarray(v, np.float64), label, wanted)
                out += [(row, w, int(rows[i]), int(i_), int(-score)) for w, found in enumerate(wanted.found) for score, i_, i in found]
        return pd.DataFrame(out, columns=["row", "place", "other", "other_id", "score"]).astype("int64")

    left = left.select(*[F.col(c).alias(c) for c in (*keys, "row", "label", "v", "scores", "least")])
    right = right.select(*[F.col(c).alias(c) for c in (*keys, "row", "vec_id", "label", "v")])
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "row long, place int, other long, other_id long, score long")
    order = W.partitionBy("row", "place").orderBy(F.desc("score"), "other_id", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def quantised(embedding, scale: int = 256):
    """A column: each component times ``scale``, rounded down; null where the list or a component is null or not finite."""
    scaled = F.transform(embedding, lambda x: F.floor(x.cast("double") * scale))
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < LIMIT))
    return F.when(F.coalesce(good, F.lit(False)), scaled.cast("array<int>"))


def mine(vectors: DataFrame, is_anchor, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``vectors(vec_id, label, v array<int>)`` -> ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    The score of two rows is the inner product of their vectors. Rows of a label that is null, a null vector or a null
    id take no part, nor do vectors with components of a magnitude of 2**20 or more (:func:`quantised` makes them null).
    Anchors are the rows that the column ``is_anchor`` holds for. An anchor's positives are the ``positives`` best other
    rows of its label; for each, its negatives are the ``negatives`` best rows of other labels whose score lies
    between ``low`` and ``high`` hundredths of the positive's, ends included. Higher scores are better, then smaller ids;
    rows of equal ids are rows of their own. Only vectors of the same length are compared; an empty table, an anchor without
    positives or windows that hold nothing give no rows.

    Of equal vectors of one label only the first few ids can be in a result; the rest are left out as candidates (not as
    anchors), so a group of copies, however large, is a few rows. All rows are put into cells around centers that
    are fitted to a sample, cells are split into blocks, and each block has a cover tree. Cells and nodes whose bounds
    lie outside all windows are skipped; what is left is scored exactly.
    """
    known = vectors.where("vec_id is not null and label is not null and v is not null")
    known = stage(known.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "v", F.size("v").alias("width"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.aggregate("v", F.lit(0).cast("double"), lambda a, x: a + x.cast("double") * x).alias("square")), "vectors")
    same = W.partitionBy("v", "label").orderBy("vec_id", "row")
    first = stage(known.withColumn("at", F.row_number().over(same)).where(F.col("at") <= max(positives + 1, negatives)).drop("at", "anchor"), "candidates")
    out = None
    for width, rows, square in first.groupBy("width").agg(F.count("*"), F.max("square")).orderBy("width").collect():
        part = _mine_width(first.where(F.col("width") == width), known.where((F.col("width") == width) & F.col("anchor")), rows, float(np.sqrt(square)), positives, negatives, low, high)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out


def _mine_width(first: DataFrame, anchors: DataFrame, rows: int, norm: float, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    sample = first.select("row", "label", "v", F.xxhash64("vec_id").alias("at")).orderBy("at", "row").limit(SAMPLE).toPandas()
    cells = Cells(sample, rows, norm * (1 + 1e-12))

    @F.pandas_udf("cell int, radius double")
    def put(v: pd.Series) -> pd.DataFrame:
        cell, radius = cells.of(_matrix(v))
        return pd.DataFrame({"cell": cell.astype("int32"), "radius": radius})

    placed = stage(first.select("row", "vec_id", "label", "v", put("v").alias("p")).select("row", "vec_id", "label", "v", "p.cell", "p.radius"), "placed")
    cells.measured(placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("radius").alias("radius"), F.min("label").alias("low"), F.max("label").alias("high")).toPandas())
    counts = F.broadcast(placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    candidates = stage(placed.join(counts, "cell").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).drop("blocks", "radius"), "blocks")

    asked = anchors.select("row", "vec_id", "label", "v", F.array().cast("array<long>").alias("scores"))
    found = stage(_best(asked, candidates, cells, positives, True, None).select("row", "rank", "other_id", "score"), "positives")
    sets = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "other_id", "score"))).alias("found"))
    asked = stage(anchors.join(sets, "row").select("row", "vec_id", "label", "v", "found", F.col("found.score").alias("scores")), "anchors")
    mined = _best(asked, candidates, cells, negatives, False, (low, high))
    named = mined.join(asked.select("row", "vec_id", "found"), "row").withColumn("positive", F.get("found", F.col("place")))
    return named.select(F.col("vec_id").alias("anchor_id"), F.col("positive.other_id").alias("positive_id"), "rank", F.col("other_id").alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"))


#: The same rows in DuckDB; scores are whole numbers below 2**53.
ORACLE_SQL = """
WITH t AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM t a JOIN t b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank, other_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
