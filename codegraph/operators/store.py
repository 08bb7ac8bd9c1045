"""Node, edge and document tables: upserts, deletes and counts by id and path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _last(df: DataFrame, order: str, key: str = "id") -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*").select(*df.columns)


def node_label(kind):
    return F.when(kind == "file", "File").otherwise("CodeEntity")


def storable_relations(edges: DataFrame) -> DataFrame:
    return edges.where("source_id is not null and destination_id is not null")


def dedupe_first(edges: DataFrame) -> DataFrame:
    """Of the relations of a file with one id the first."""
    rest = [c for c in edges.columns if c not in ("path", "id")]
    return edges.groupBy("path", "id").agg(F.min_by(F.struct(*rest), "ordinal").alias("r")).select("path", "id", "r.*").select(*edges.columns)


def dedupe_last(edges: DataFrame) -> DataFrame:
    """Of the relations with one id the last, as the store takes them."""
    return _last(edges, "ordinal")


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """``nodes`` with those of ``new`` in place of the same ids; of equal new ids the last row (by ordinal) counts."""
    return nodes.join(new.select("id"), "id", "left_anti").unionByName(_last(new, "ordinal"))


def upsert_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` with those of ``new`` whose two ends are nodes; other new ones are dropped."""
    ids = nodes.select("id").distinct()
    good = dedupe_last(storable_relations(new))
    good = good.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "destination_id"), "destination_id", "left_semi").select(*edges.columns)
    return edges.join(good.select("id"), "id", "left_anti").unionByName(good)


def delete_edges_by_path(edges: DataFrame, paths: DataFrame) -> DataFrame:
    return edges.join(paths.select("path"), "path", "left_anti").select(*edges.columns)


def delete_nodes_by_path(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without those of the paths, edges without those that touch a removed node, whatever file they are of."""
    gone = nodes.join(paths.select("path"), "path", "left_semi").select("id").distinct()
    left = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "destination_id"), "destination_id", "left_anti")
    return nodes.join(paths.select("path"), "path", "left_anti").select(*nodes.columns), left.select(*edges.columns)


def symbols_by_paths(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """``(path, symbol_ids)`` for every asked path, ids sorted, an empty array for unknown paths."""
    found = paths.select("path").distinct().join(nodes.select("path", "id"), "path", "left")
    return found.groupBy("path").agg(F.sort_array(F.collect_list("id")).alias("symbol_ids"))


def documents_by_paths(documents: DataFrame, paths: DataFrame, language: str) -> DataFrame:
    """``(path, document_ids)`` for the asked paths that have documents of the language."""
    found = documents.where(F.col("language") == language).join(paths.select("path").distinct(), "path", "left_semi")
    return found.groupBy("path").agg(F.sort_array(F.collect_list("id")).alias("document_ids"))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    marked = nodes.select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionAll(edges.select(F.lit(0).alias("n"), F.lit(1).alias("e")))
    return marked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("node_count"), F.coalesce(F.sum("e"), F.lit(0)).alias("edge_count"))


def document_counts(documents: DataFrame, languages: list[str]) -> DataFrame:
    """``(language, documents)`` for each distinct language asked, 0 without any."""
    asked = documents.sparkSession.createDataFrame([(x,) for x in sorted(set(languages))], "language string")
    counts = documents.groupBy("language").agg(F.count("*").alias("n"))
    return asked.join(counts, "language", "left").select("language", F.coalesce("n", F.lit(0)).alias("documents"))


def unique_id_check(rows: DataFrame, key: str) -> DataFrame:
    """The values of ``key`` that more than one row has."""
    return rows.groupBy(F.col(key).alias("value")).agg(F.count("*").alias("n")).where("n > 1")


#: Rows of a table are told apart by two hashes of all their columns.
DIGEST = ("rows", "sum", "xor")


def digests(rows: DataFrame, buckets: int, key: str = "path") -> DataFrame:
    """``(bucket, rows, sum, xor)``: for each bucket of ``key`` how many rows it has, and what they are, in any order.

    The sum of one hash of each row and the exclusive or of another: repeats count in the sum. Digests of
    disjoint sets of rows add up, so those of a changed bucket can be computed from its rows alone (see ``Store``).
    Columns count in the order of their names; maps as their sorted entries.
    """
    plain = [F.array_sort(F.map_entries(c)) if rows.schema[c].dataType.typeName() == "map" else F.col(c) for c in sorted(rows.columns)]
    marks = [F.isnull(c).cast("int") for c in sorted(rows.columns)]
    hashed = rows.select(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"), F.xxhash64(F.lit(1), *marks, *plain).alias("a"), F.xxhash64(F.lit(2), *marks, *plain).alias("b"))
    return hashed.groupBy("bucket").agg(F.count("*").alias("rows"), F.sum(F.col("a").cast("decimal(38,0)")).cast("decimal(38,0)").alias("sum"), F.bit_xor("b").alias("xor"))


def changed_buckets(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """``(bucket, expected_rows, stored_rows)`` of the buckets whose :func:`digests` differ, those that one side lacks with 0."""
    e, s = (df.select("bucket", F.struct(*DIGEST).alias(n)) for df, n in ((expected, "e"), (stored, "s")))
    both = e.join(s, "bucket", "full").where(~F.col("e").eqNullSafe(F.col("s")))
    return both.select("bucket", F.coalesce("e.rows", F.lit(0)).alias("expected_rows"), F.coalesce("s.rows", F.lit(0)).alias("stored_rows"))


def verify_index(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: the first of nodes, edges and documents whose counts differ, with both counts; nulls if all agree."""
    e, s = expected.select("nodes", "edges", "documents"), stored.select(*[F.col(c).alias(f"s_{c}") for c in ("nodes", "edges", "documents")])
    pair = e.select(F.lit(1).alias("k"), "*").join(s.select(F.lit(1).alias("k"), "*"), "k")
    first = F.lit(None).cast("struct<what:string,expected:bigint,found:bigint>")
    for c in ("documents", "edges", "nodes"):
        first = F.when(F.col(c) != F.col(f"s_{c}"), F.struct(F.lit(c).alias("what"), F.col(c).cast("long").alias("expected"), F.col(f"s_{c}").cast("long").alias("found"))).otherwise(first)
    return pair.select(first.alias("f")).select(F.col("f.what").alias("mismatch"), F.col("f.expected").alias("expected"), F.col("f.found").alias("found"))
