"""Callable documents, and the search for similar ones by squared distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import CALLABLES, collection_name, document_text
from ..sources.shared import stage

#: Queries and documents of a block: what one task compares; queries whose products with a block are held at once.
QUERY_BLOCK, BLOCK, STRIP = 8192, 8192, 128
#: Pivots of a group, documents that are compared between two looks at the bound, and the relative slack of bounds.
PIVOTS, STRETCH, SLACK = 8, 256, 1e-9
#: Vectors are compared inside a language and a length.
GROUP = ["language", "width"]


def callable_symbols(symbols: DataFrame) -> DataFrame:
    """Functions, methods and constructors that have a body."""
    return symbols.where(F.col("kind").isin(*CALLABLES) & (F.coalesce("body", F.lit("")) != ""))


def callable_documents(symbols: DataFrame, prefix: str = "codegraph") -> DataFrame:
    """One document for each callable with the columns to filter by, and the collection of its language."""
    cols = ["id", document_text(F.col("signature"), F.col("body")).alias("document"), F.col("id").alias("symbol_id"), F.col("kind").alias("symbol_kind"), "language", "path", "name", "qualified_name", "parent_name", "start_line", "end_line"]
    return callable_symbols(symbols).select(*cols, collection_name(F.lit(prefix), F.col("language")).alias("collection"))


def usable(embedding: Column) -> Column:
    """The vector in double precision; null where it is null or a component is null or not finite."""
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(F.coalesce(good, F.lit(False)), embedding.cast("array<double>"))


def _vectors(rows: DataFrame, name: str) -> DataFrame:
    rows = rows.select(F.col(name).cast("string").alias("id"), F.col("language").alias("language"), usable(F.col("embedding")).alias("embedding"))
    return rows.where("id is not null and language is not null and embedding is not null").withColumn("width", F.size("embedding"))


def _to_pivots(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """``rows`` with ``away``, the distances to the pivots of their group."""
    far = lambda p: F.sqrt(F.aggregate(F.zip_with(p, "embedding", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    return rows.join(pivots, GROUP).withColumn("away", F.transform("pivots", far)).drop("pivots")


def pivot_index(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``documents(id, language, embedding)`` -> ``(index, pivots)``, to be written once and searched often.

    A group is a language and a length of vectors. Its pivots are PIVOTS of its documents, the first by a hash of the id.
    ``index`` has each usable document with ``away``, its distances to the pivots, and the cell of its nearest pivot,
    cut into blocks of about BLOCK documents. Other documents are left out.
    """
    docs = _vectors(documents, "id")
    first = docs.withColumn("at", F.row_number().over(W.partitionBy(*GROUP).orderBy(F.xxhash64("id"), "id"))).where(F.col("at") <= PIVOTS)
    pivots = stage(first.groupBy(*GROUP).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "embedding"))), lambda x: x.embedding).alias("pivots")), "pivots")
    placed = stage(_to_pivots(docs, pivots).withColumn("cell", (F.array_position("away", F.array_min("away")) - 1).cast("int")), "placed")
    sizes = placed.groupBy(*GROUP, "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    index = placed.join(sizes, [*GROUP, "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    return index, pivots


def similar(queries: DataFrame, documents: DataFrame, k: int, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``queries(query_id, language, embedding)`` and ``documents(id, language, embedding)`` -> ``(query_id, id, rank, distance)``.

    The ``k`` nearest documents of the query's language by squared Euclidean distance in double precision; ties go to
    the smaller id. Vectors are compared with those of their length; null ones, and those with a null or infinite
    component, find and are nothing; ``k`` below 1 gives no rows. ``index`` is a :func:`pivot_index` of the documents.

    Equal vectors are one: each distinct vector of a language is searched for once, among the distinct vectors of the
    documents, and what is found holds for all queries and documents that have it.

    By the triangle inequality a document is at least as far from a query as their distances to any pivot differ. Ranges
    of these distances tell for each block how near and how far its documents can be; blocks that can't hold one of the
    ``k`` nearest aren't visited, in the others products of matrices tell which documents can be among them (see
    :func:`_nearest`).
    """
    if k < 1:
        return queries.sparkSession.createDataFrame([], "query_id string, id string, rank int, distance double")
    wanted, members = _classes(_vectors(queries, "query_id"))
    if index:
        (index, stored), pivots = _classes(index[0], "away", "cell", "block"), index[1]
    else:
        distinct, stored = _classes(_vectors(documents, "id"))
        index, pivots = pivot_index(distinct)
        index = stage(index, "index")
    asked = stage(_to_pivots(wanted, pivots), "asked")
    spans = [F.array(*[f(F.get("away", F.lit(j))) for j in range(PIVOTS)]).alias(name) for name, f in (("low", F.min), ("high", F.max))]
    blocks = index.groupBy(*GROUP, "cell", "block").agg(F.count("*").alias("n"), *spans)
    parts = asked.groupBy(*GROUP).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("parts"))
    left = asked.join(parts, GROUP).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    right = blocks.join(parts, GROUP).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    plain = lambda df, *cols: df.select(*[F.col(c).alias(c) for c in (*GROUP, *cols)])
    keys = [*GROUP, "part"]
    routed = plain(left, "part", "id", "embedding", "away").groupBy(*keys).cogroup(plain(right, "part", "cell", "block", "n", "low", "high").groupBy(*keys))
    routed = stage(routed.applyInPandas(lambda q, b: _route(q, b, k), "language string, width int, cell int, block int, id string, embedding array<double>, away array<double>, most double"), "routed")
    keys = [*GROUP, "cell", "block"]
    parts = routed.groupBy(*keys).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("parts"))
    left = routed.join(parts, keys).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    right = index.join(parts, keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys.append("part")
    met = plain(left, "cell", "block", "part", "id", "embedding", "away", "most").groupBy(*keys).cogroup(plain(right, "cell", "block", "part", "id", "embedding", "away").groupBy(*keys))
    found = met.applyInPandas(lambda q, d: _nearest(q, d, k), "language string, width int, query_id string, id string, distance double")
    best = W.partitionBy(*GROUP, "query_id").orderBy("distance", "id")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")
    # The k nearest documents have the k nearest vectors, and of each vector they are its first k.
    first = stored.withColumn("place", F.row_number().over(W.partitionBy(*GROUP, "class").orderBy("id"))).where(F.col("place") <= k)
    found = found.withColumnRenamed("id", "class").join(first.drop("place"), [*GROUP, "class"])
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(*GROUP, F.col("query_id").alias("class"), "id", "rank", "distance")
    return members.withColumnRenamed("id", "query_id").join(found, [*GROUP, "class"]).select("query_id", "id", "rank", "distance")


def _classes(rows: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """The distinct vectors of ``rows(id, language, width, embedding)``, and ``(id, class)`` of all rows.

    A vector's name is the least id that has it, so that names are ordered as ids are, with a hash, as an id may come with several vectors.
    """
    rows = stage(rows, "vectors")
    least = rows.groupBy(*GROUP, "embedding").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in more])
    least = stage(least.withColumn("id", F.concat("id", F.lit("\0"), F.xxhash64("embedding").cast("string"))), "distinct")
    named = rows.join(least.select(*GROUP, "embedding", F.col("id").alias("class")), [*GROUP, "embedding"])
    return least, stage(named.select(*GROUP, "class", "id"), "members")


def _matrix(rows) -> np.ndarray:
    return np.array([np.asarray(r, np.float64) for r in rows])


def _route(queries: pd.DataFrame, blocks: pd.DataFrame, k: int) -> pd.DataFrame:
    """The blocks that each query has to visit, with the distance within which its ``k`` nearest lie for certain."""
    columns = ["language", "width", "cell", "block", "id", "embedding", "away", "most"]
    if not len(queries) or not len(blocks):
        return pd.DataFrame({c: [] for c in columns})
    used = len(queries["away"].iat[0])
    low, high, n, out = _matrix(blocks["low"])[:, :used], _matrix(blocks["high"])[:, :used], blocks["n"].to_numpy(), []
    where = blocks[["language", "width", "cell", "block"]].to_numpy()
    for i, v, away in zip(queries["id"], queries["embedding"], queries["away"]):
        with np.errstate(invalid="ignore"):
            # Distances beyond double precision tell nothing.
            least, most = np.nan_to_num(np.maximum(np.maximum(away - high, low - away).max(axis=1), 0), nan=0.0, posinf=np.inf), (away + high).min(axis=1)
        order = np.argsort(most)
        enough = np.searchsorted(np.cumsum(n[order]), k)
        limit = most[order[enough]] * (1 + SLACK) if enough < len(order) else np.inf
        out += [(*where[b], i, v, away, limit) for b in np.flatnonzero(least * (1 - SLACK) <= limit)]
    return pd.DataFrame(out, columns=columns)


def _nearest(queries: pd.DataFrame, documents: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best ``k`` of a block of documents for each query of a block.

    Squared distances come from products of matrices first, a strip of queries at a time. Those differ from the exact
    ones by rounding, at most ``slack``; so what is above the ``k``-th of them by more than two slacks is no candidate, and
    candidates are compared exactly. Where squares are beyond double precision the bounds of the pivots are left.
    """
    if not len(queries) or not len(documents):
        return pd.DataFrame({"language": [], "width": [], "query_id": [], "id": [], "distance": []}).astype({"language": str, "width": "int32", "query_id": str, "id": str, "distance": float})
    x, names = _matrix(documents["embedding"]), documents["id"].to_numpy().astype(str)
    vs, away, rest = _matrix(queries["embedding"]), None, queries["away"].to_numpy()
    ids, nearest, distances, asked = [], [], [], queries["id"].to_numpy()
    with np.errstate(over="ignore", invalid="ignore"):
        xx = (x**2).sum(axis=1)
        for at in range(0, len(vs), STRIP):
            v = vs[at : at + STRIP]
            vv = (v**2).sum(axis=1)
            near_by = xx + vv[:, None] - 2 * (v @ x.T)
            slack = 4 * (x.shape[1] + 8) * np.finfo(float).eps * (np.sqrt(xx.max()) + np.sqrt(vv)) ** 2
            most = np.partition(near_by, k - 1, axis=1)[:, k - 1] if k < len(x) else np.full(len(v), np.inf)
            for i, bound in enumerate(most + 2 * slack):
                if np.isfinite(slack[i]):
                    near = np.flatnonzero(near_by[i] <= bound)
                    d = ((x[near] - v[i]) ** 2).sum(axis=1)
                else:
                    away = _matrix(documents["away"]) if away is None else away
                    near, d, _ = within(x, away, v[i], np.asarray(rest[at + i], np.float64), k, queries["most"].iat[at + i])
                near = near[order := np.lexsort((names[near], d))[:k]]
                ids += [asked[at + i]] * len(near)
                nearest.append(names[near])
                distances.append(d[order])
    return pd.DataFrame({"language": queries["language"].iat[0], "width": queries["width"].iat[0], "query_id": ids, "id": np.concatenate(nearest), "distance": np.concatenate(distances)})


def within(x: np.ndarray, away: np.ndarray, v: np.ndarray, q: np.ndarray, k: int, most: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of ``x`` that hold the ``k`` nearest to ``v`` within ``most``, their squared distances, and how many were computed.

    ``away`` and ``q`` are the distances to the pivots. Rows are compared in the order of their bounds, a stretch at a
    time, until no bound is below the ``k``-th distance.
    """
    least = np.nan_to_num(np.abs(away - q), nan=0.0, posinf=np.inf).max(axis=1) * (1 - SLACK)
    order = np.flatnonzero(least <= most)
    order = order[np.argsort(least[order], kind="stable")]
    found, at = np.zeros(0), 0
    while at < len(order):
        if len(found) >= k and least[order[at]] ** 2 > np.partition(found, k - 1)[k - 1]:
            break
        some = order[at : at + STRETCH]
        # Row by row in one way, so that equal vectors have exactly equal distances.
        found = np.concatenate([found, ((x[some] - v) ** 2).sum(axis=1)])
        at += len(some)
    return order[:at], found, at


def similar_code(seeds: DataFrame, documents: DataFrame, k: int = 5) -> DataFrame:
    """As :func:`similar` for seeds whose query text is not blank; the vectors are the caller's."""
    return similar(seeds.where(F.coalesce("query_text", F.lit("")).rlike(r"\S")), documents, k)
