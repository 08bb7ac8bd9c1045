"""Near duplicates of vectors by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import stage

THRESHOLD, RECALL, SEED = 0.93, 0.999, 4
#: Codebooks of a length are fitted to about SAMPLE of its vectors; the traversal is calibrated with about QUERIES of them.
SAMPLE, QUERIES, ITERATIONS = 20_000, 1000, 12
#: Samples are chosen by a hash of the id in this range, which holds for any number of vectors.
FULL = 1 << 40
#: Words of a codebook: such that a cell of the grid holds about PER_CELL vectors, within these limits.
PER_CELL, WORDS = 32, (2, 1024)
#: Residents and visitors of a cell meet in blocks of about so many each.
BLOCK = 1024
#: Bins of the calibration, over costs of 0 to 4.
BINS = 4000
#: Partners that are made for each sampled vector, turned away from it by exactly the threshold.
TURNS = 8


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _codebook(x: np.ndarray, words: int) -> np.ndarray:
    """Lloyd's algorithm from a random start."""
    rng = np.random.default_rng(SEED)
    c = x[rng.permutation(len(x))[:words]]
    for _ in range(ITERATIONS):
        near = ((c**2).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _costs(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1), 0)


def multi_sequence(d1: np.ndarray, d2: np.ndarray, slack: float) -> list[int]:
    """Cells (i * len(d2) + j) in the order of d1[i] + d2[j], as far as the nearest cost plus ``slack``."""
    o1, o2 = d1.argsort(kind="stable"), d2.argsort(kind="stable")
    a, b = d1[o1].tolist(), d2[o2].tolist()
    limit, heap, out = a[0] + b[0] + slack, [(a[0] + b[0], 0, 0)], []
    while heap and heap[0][0] <= limit:
        _, i, j = heapq.heappop(heap)
        out.append(int(o1[i]) * len(b) + int(o2[j]))
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return out


class Space:
    """The index of the vectors of one length: a codebook for each half, and how much more than the nearest cell a visit may cost.

    Lengths that the sample has no vector of (they are rare), and length 1, have one cell, in which all are compared.
    """

    def __init__(self, sample: np.ndarray, total: int):
        self.half, words = sample.shape[1] // 2, int(min(max((total / PER_CELL) ** 0.5, WORDS[0]), WORDS[1]))
        self.books = [_codebook(sample[:, : self.half], words), _codebook(sample[:, self.half :], words)]
        self.slack = 0.0

    def costs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _costs(x[:, : self.half], self.books[0]), _costs(x[:, self.half :], self.books[1])

    def cells(self, x: np.ndarray) -> list[list[int]]:
        return [multi_sequence(a, b, self.slack) for a, b in zip(*self.costs(x))]

    def need(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For pairs of rows the least slack with which one end visits the other's home cell."""
        (x1, x2), (y1, y2), at = self.costs(x), self.costs(y), np.arange(len(x))
        home_x, home_y = (x1.argmin(axis=1), x2.argmin(axis=1)), (y1.argmin(axis=1), y2.argmin(axis=1))
        there = x1[at, home_y[0]] + x2[at, home_y[1]] - x1[at, home_x[0]] - x2[at, home_x[1]]
        back = y1[at, home_x[0]] + y2[at, home_x[1]] - y1[at, home_y[0]] - y2[at, home_y[1]]
        return np.minimum(there, back)

    def least(self, sample: np.ndarray, threshold: float, recall: float) -> float:
        """The slack for pairs at exactly the threshold: sampled vectors, and partners turned away from them in random directions."""
        rng, x = np.random.default_rng(SEED), np.repeat(sample[: QUERIES * 4], TURNS, axis=0)
        away = rng.normal(size=x.shape)
        away -= (away * x).sum(axis=1, keepdims=True) * x
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
        return float(np.quantile(self.need(x, threshold * x + (1 - threshold**2) ** 0.5 * away), recall))


def _calibrate(classes: DataFrame, spaces: dict[int, Space], totals: dict[int, int], threshold: float, recall: float) -> None:
    """Widen each space's slack to what ``recall`` of the true pairs of sampled queries need; each query counts the same.

    A query with thousands of near copies weighs no more than one with a single partner.
    """
    share = F.create_map(*[F.lit(x) for d in spaces for x in (d, max(1, FULL * min(QUERIES, totals[d]) // totals[d]))])[F.size("v")]
    chosen = classes.where(F.pmod(F.xxhash64("node", F.lit(SEED)), F.lit(FULL)) < share).select("label", "v", "node").toPandas()
    chosen = chosen.assign(d=[len(v) for v in chosen["v"]])
    asked = {key: (rows, _unit(chosen["v"].iloc[rows]), chosen["node"].to_numpy()[rows]) for key, rows in chosen.groupby(["d", "label"]).indices.items()}

    def need(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, rows in frame.groupby(["d", "label"]).indices.items():
                if key not in asked:
                    continue
                numbers, q, ids = asked[key]
                x = _unit(frame["v"].iloc[rows])
                k, r = np.nonzero((q @ x.T >= threshold) & (ids[:, None] != frame["node"].to_numpy()[rows]))
                if len(k):
                    bins = np.minimum(spaces[key[0]].need(q[k], x[r]) * (BINS / 4), BINS - 1).astype(int)
                    out.append(pd.DataFrame({"d": key[0], "query": numbers[k], "bin": bins}).value_counts().rename("n").reset_index())
            if out:
                yield pd.concat(out)

    found = classes.where(F.size("v").isin(*spaces)).select("label", "v", "node", F.size("v").alias("d")).mapInPandas(need, "d int, query long, bin long, n long")
    found = found.groupBy("d", "query", "bin").agg(F.sum("n").alias("n")).toPandas()
    for d, part in found.groupby("d"):
        weight = (part["n"] / part.groupby("query")["n"].transform("sum")).groupby(part["bin"]).sum().sort_index().cumsum()
        at = weight.index[np.searchsorted(weight.to_numpy(), recall * weight.iloc[-1] - 1e-9)]
        spaces[d].slack = max(spaces[d].slack, (at + 1) * 4 / BINS * 1.1)


def _meet(frames: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Rows sorted by block, residents first -> ``(node, links, other)``: numbers of links and a spanning forest of them."""
    key, residents, x = None, None, None
    for frame in frames:
        starts = np.flatnonzero(np.append(True, (frame["block"].to_numpy()[1:] != frame["block"].to_numpy()[:-1]) | (frame["visits"].to_numpy()[1:] != frame["visits"].to_numpy()[:-1])))
        out = []
        for a, b in zip(starts, np.append(starts[1:], len(frame))):
            part = frame.iloc[a:b]
            if part["block"].iat[0] != key:
                key, residents, x = part["block"].iat[0], None, None
            if not part["visits"].iat[0]:
                residents = part if residents is None else pd.concat([residents, part])
                x = None
            elif residents is not None:
                if x is None:
                    x = _unit(residents["v"])
                out += _links(residents, x, part, threshold)
        if out:
            yield pd.concat(out)


def _links(residents: pd.DataFrame, x: np.ndarray, visitors: pd.DataFrame, threshold: float) -> list[pd.DataFrame]:
    r, v = residents["node"].to_numpy(), visitors["node"].to_numpy()
    near = (x @ _unit(visitors["v"]).T >= threshold) & (r[:, None] != v)
    if not near.any():
        return []
    rows, cols = near.any(axis=1), near.any(axis=0)
    near, residents, visitors = near[rows][:, cols], residents[rows], visitors[cols]
    r, v, home, cell = r[rows], v[cols], visitors["home"].to_numpy(), residents["home"].iat[0]
    # A pair that both ends find is counted by each as a visitor; if only one end finds it, the resident counts it here.
    back = near & (home != cell)
    i, j = np.nonzero(back)
    if len(i):
        lists, homes = residents["cells"].to_list(), {h: k for k, h in enumerate(sorted(set(home.tolist())))}
        seen = np.zeros((len(lists), len(homes)), bool)
        for k, cells in enumerate(lists):
            seen[k, [homes[c] for c in cells if c in homes]] = True
        back[i, j] = ~seen[i, [homes[h] for h in home[j].tolist()]]
    links = np.concatenate([near.T @ residents["w"].to_numpy(), back @ visitors["w"].to_numpy()])
    low_r, low_v, top = r.copy(), v.copy(), np.iinfo(np.int64).max
    while True:
        before = low_r.sum() + low_v.sum()
        low_r = np.minimum(low_r, np.where(near, low_v, top).min(axis=1))
        low_v = np.minimum(low_v, np.where(near, low_r[:, None], top).min(axis=0))
        if before == low_r.sum() + low_v.sum():
            break
    return [pd.DataFrame({"node": np.concatenate([v, r]), "links": links, "other": np.concatenate([low_v, low_r])})]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``vectors``.

    Vectors of one label and one length are linked if their cosine in double precision is at least ``threshold``; only
    links that the index finds count, and every link that counts was verified. The index is laid out so that
    ``recall`` of pairs at exactly the threshold are found, and ``recall`` of the true pairs of sampled queries.
    Each length of vectors has an index of its own; of length 1 all of one sign are equal. A vector that is null, empty or
    zero, has a null or non-finite component, or no label links with nothing. Equal vectors of a label are one class,
    so copies are compared once. Repeated rows count as copies. A row with a null id has no component of its own.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = F.col("v").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists("v", lambda c: c != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    # Two numbers have cosine 1 or -1, so all of a sign are one class.
    rows = rows.withColumn("v", F.when(F.size("v") == 1, F.transform("v", F.signum)).otherwise(F.col("v")))
    rows = stage(rows.withColumn("h1", F.when(F.col("usable"), F.xxhash64("label", "v"))).withColumn("h2", F.when(F.col("usable"), F.xxhash64(F.lit(SEED), "v", "label"))), "vectors")
    classes = rows.where("usable").groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("w"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = stage(classes, "classes")
    links = _linked(classes, threshold, recall)
    found = stage(classes.select("h1", "h2", "node", "w").join(links, "node", "left").select("h1", "h2", F.col("node").alias("own"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("component", "node").alias("component")), "linked")
    joined = rows.select("vec_id", "h1", "h2").join(found, ["h1", "h2"], "left")
    return joined.select(F.col("vec_id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), (F.col("vec_id") == F.coalesce("component", "vec_id")).alias("kept"))


def _spaces(classes: DataFrame, threshold: float, recall: float) -> dict[int, Space]:
    """An index for each length of vectors in a sample of bounded size."""
    total = classes.count()
    sample = classes.where(F.pmod(F.xxhash64("node", F.lit(SEED + 1)), F.lit(FULL)) <= FULL * min(SAMPLE, total) // max(total, 1)).select("v").toPandas()["v"]
    groups = {d: _unit(part) for d, part in sample.groupby(sample.map(len)) if d > 1}
    if not groups:
        return {}
    totals = {r[0]: r[1] for r in classes.groupBy(F.size("v").alias("d")).count().where(F.col("d").isin(*groups)).collect()}
    out = {d: Space(x, totals[d]) for d, x in groups.items()}
    for d, x in groups.items():
        out[d].slack = out[d].least(x, threshold, recall)
    _calibrate(classes, out, totals, threshold, recall)
    return out


def _linked(classes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """``(node, links, component)`` of the classes that have a link."""
    spaces = _spaces(classes, threshold, recall)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cells, lengths = [[0]] * len(frame), frame["v"].map(len)
            for d, rows in frame.groupby(lengths).indices.items():
                if d in spaces:
                    for i, found in zip(rows, spaces[d].cells(_unit(frame["v"].iloc[rows]))):
                        cells[i] = found
            yield frame.assign(label=lengths.astype(str) + "/" + frame["label"], home=[c[0] for c in cells], cells=cells)

    # From here on the label holds the length too, so only vectors of one length meet.
    index = stage(classes.select("node", "label", "v", "w").mapInPandas(place, "node long, label string, v array<double>, w long, home long, cells array<long>"), "index")
    residents = index.groupBy("label", F.col("home").alias("cell")).agg(F.count("*").alias("n"))
    visits = index.select("label", F.explode("cells").alias("cell")).groupBy("label", "cell").agg(F.count("*").alias("m"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    cells = stage(residents.join(visits, ["label", "cell"]).where("m > 1").select("label", "cell", blocks("n").alias("rs"), blocks("m").alias("vs")), "cells")
    mine = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    row = ["label", "cell", "r", "s", "node", "w", "v", "home", "cells"]
    stay = index.withColumn("cell", F.col("home")).join(cells, ["label", "cell"]).withColumn("r", mine("rs")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("vs") - 1))).select(*row, F.lit(False).alias("visits"))
    come = index.withColumn("cell", F.explode("cells")).withColumn("cells", F.array().cast("array<long>")).join(cells, ["label", "cell"]).withColumn("s", mine("vs")).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rs") - 1))).select(*row, F.lit(True).alias("visits"))
    met = stay.unionByName(come).withColumn("block", F.concat_ws("/", "cell", "r", "s", "label")).repartition("block").sortWithinPartitions("block", "visits")
    found = stage(met.select("block", "visits", "node", "w", "v", "home", "cells").mapInPandas(lambda f: _meet(f, threshold), "node long, links long, other long"), "found")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    return counts.join(parts, "node", "left").select("node", "links", F.coalesce("component", "node").alias("component"))
