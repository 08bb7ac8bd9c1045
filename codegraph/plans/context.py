"""Context packages: what a diff changes, what is around it in the graph, and what is similar."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import language_of_path
from ..operators import changed, documents, explore, package
from ..operators import symbols as symbols_
from ..sources.shared import stage
from ..sources.syntax import python_syntax_nodes


def lenient_nodes(files: DataFrame) -> DataFrame:
    return python_syntax_nodes(files, lenient=True)


def read_sources(paths: DataFrame, files: DataFrame, parse: Callable[[DataFrame], DataFrame] = lenient_nodes) -> tuple[DataFrame, DataFrame]:
    """``(files(path, parse_error), symbols)`` of the files of ``paths(path)`` as they are now, errors and all.

    ``files(repo_id, path, language, content)``; only the files that are asked for are read and parsed. A file with
    errors gives the symbols of what is valid in it, unlike in the index, which leaves it out; ``parse_error`` is left
    for files that can't be read as text.
    """
    there = stage(files.join(paths.select("path").distinct(), "path", "left_semi").select("repo_id", "path", "language", "content"), "there")
    nodes = stage(parse(there), "syntax")
    bad = nodes.where("parse_error").select("path").distinct().withColumn("parse_error", F.lit(True))
    status = there.select("path").distinct().join(bad, "path", "left").select("path", F.coalesce("parse_error", F.lit(False)).alias("parse_error"))
    return status, stage(symbols_.extract_symbols(nodes.where(~F.coalesce("parse_error", F.lit(False)))), "symbols")


def named_paths(diff_files: DataFrame) -> DataFrame:
    """Every path that a diff names, old and new."""
    return diff_files.select(F.explode(F.array_compact(F.array("path", "new_path", "old_path"))).alias("path")).distinct()


def changed_code_context(diff_files: DataFrame, files: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(changed_files, changed_symbols)``: the last entry of each path with its status, and the symbols that hunks touch.

    ``files(path, parse_error)`` and ``symbols`` are those of :func:`read_sources` for the paths that the diffs name. A
    file that is missing, of no supported language or unreadable keeps its row with a ``skip_reason`` and gives no
    symbols; a loaded one has ``source_loaded`` and its ``language``. Symbols are those of the file that was found,
    which for a renamed file may be at the old path.
    """
    found = changed.resolve_source_path(diff_files, files)
    bad = files.groupBy(F.col("path").alias("source_path")).agg(F.max("parse_error").alias("parse_error"))
    found = found.join(bad, "source_path", "left")
    language = language_of_path(F.col("source_path"))
    found = found.withColumn("skip_reason", changed.changed_file_status(F.col("source_path"), language, F.col("parse_error"))).drop("parse_error")
    loaded = F.col("skip_reason").isNull()
    found = found.withColumn("source_loaded", loaded).withColumn("language", F.when(loaded, language))
    touched = changed.overlap_symbols(changed.ranges_of(found.where(loaded).withColumn("path", F.col("source_path"))), changed.seed_symbols(symbols))
    return changed.changed_files_last(found), changed.changed_symbols(touched)


def context_tables(diff_files: DataFrame, files: DataFrame, symbols: DataFrame, nodes: DataFrame, edges: DataFrame, docs: DataFrame, vectors: DataFrame, max_depth: int = 2) -> dict[str, DataFrame]:
    """The parts of context packages as tables: changed_files, changed_symbols, graph_paths, modified_code and neighbor_code.

    ``vectors(id, language, embedding)`` holds the vectors of documents and of changed symbols, made by the caller.
    What several parts read is written once. With hubs the paths of a diff can be many; here they stay rows.
    """
    changed_files, seeds = changed_code_context(diff_files, files, symbols)
    seeds = stage(seeds, "seeds")
    start = explore.known_seeds(seeds.select("diff_id", F.col("symbol_id").alias("id")), nodes)
    best = stage(explore.nearest_paths(start, explore.adjacency(edges), max_depth), "best")
    around = explore.explore_nodes(start, best, nodes)
    graph = package.graph_neighbors(around, seeds, symbols)
    queries = stage(package.query_seeds(seeds, symbols).where("query_text <> ''").drop("query_text"), "queries")
    asked = queries.select("query_id", "language").distinct().join(vectors.select(F.col("id").alias("query_id"), "embedding"), "query_id")
    stored = docs.select("id", "language").join(vectors.select("id", "embedding"), "id")
    vector = package.vector_neighbors(documents.similar(asked, stored, package.VECTOR_LIMIT), queries, seeds, docs)
    modified = changed.modified_code(seeds, symbols).join(seeds.select("diff_id", "symbol_id", "matched_line_ranges"), ["diff_id", "symbol_id"])
    return {"changed_files": changed_files, "changed_symbols": seeds, "graph_paths": best, "modified_code": modified, "neighbor_code": package.neighbor_code(graph, vector)}


def context_package(diff_files: DataFrame, *tables: DataFrame, max_depth: int = 2) -> DataFrame:
    """One row for each diff: the parts of :func:`context_tables`, which has the same arguments, as arrays.

    Arrays are sorted as the parts are: files and symbols as first seen, paths by length and ids, snippets by path and
    line, neighbours from the graph before those from vectors.
    """

    def packed(df, name, order, cols):
        rows = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("order"), F.struct(*cols).alias("row"))))
        return df.groupBy("diff_id").agg(rows.alias("x")).select("diff_id", F.transform("x", lambda r: r.row).alias(name))

    place = ["path", "start_line", "end_line", "qualified_name", "symbol_id"]
    parts = {
        "changed_files": (["file_ordinal"], ["path", "change_type", "old_path", "new_path", "source_path", "language", "source_loaded", "skip_reason", "hunks", "changed_line_ranges"]),
        "changed_symbols": (["seed_ordinal", "symbol_id"], ["symbol_id", "matched_line_ranges"]),
        "graph_paths": (["hop_count", "seed_id", "terminal_node_id", "edge_ids"], ["seed_id", "terminal_node_id", "node_ids", "edge_ids", "hop_count"]),
        "modified_code": (place, [*package.SNIPPET, "matched_line_ranges"]),
        "neighbor_code": (["source_rank", *place], [*package.SNIPPET, "source"]),
    }
    rows, out = context_tables(diff_files, *tables, max_depth=max_depth), diff_files.select("diff_id").distinct()
    for name, (order, cols) in parts.items():
        out = out.join(packed(rows[name], name, order, cols), "diff_id", "left")
    return out
