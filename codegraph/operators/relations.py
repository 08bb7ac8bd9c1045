"""Relations between the symbols of a file; every join is inside (path), which all tables share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import stab
from ..functions.text import CALLABLES, edge_id
from .store import dedupe_first

#: Kinds that own reads and writes (fixed values).
OWNERS = ("file", "class", "struct", "interface", "enum", "record", "function", "method", "constructor")
COLUMNS = ["id", "kind", "path", "source", "destination", "source_id", "destination_id", "metadata", "ordinal"]


def last_by_name(symbols: DataFrame) -> DataFrame:
    """``(path, qualified_name, id)``: of the symbols of one name in a file the last."""
    return symbols.groupBy("path", "qualified_name").agg(F.max_by("id", "ordinal").alias("id"))


def _edges(rows: DataFrame, kind, order) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    metadata = F.col("metadata") if "metadata" in rows.columns else F.create_map().cast("map<string,boolean>")
    return rows.select(edge_id(kind, F.col("path"), F.col("source"), F.col("destination")).alias("id"), kind.alias("kind"), "path", "source", "destination", "source_id", "destination_id", metadata.alias("metadata"), order.alias("ordinal"))


def contains_edges(symbols: DataFrame) -> DataFrame:
    """An edge to each symbol from its parent if the file has that name (from its last symbol), else from the file."""
    files = symbols.where("kind = 'file'").groupBy("path").agg(F.min_by(F.struct("id", "qualified_name"), "ordinal").alias("file"))
    parents = last_by_name(symbols).select("path", F.col("qualified_name").alias("parent_name"), F.col("id").alias("parent_id"))
    rows = symbols.where("kind <> 'file'").select("path", "parent_name", F.col("qualified_name").alias("destination"), F.col("id").alias("destination_id"), "ordinal")
    rows = rows.join(files, "path").join(parents, ["path", "parent_name"], "left")
    source = F.when(F.col("parent_id").isNotNull(), F.col("parent_name")).otherwise(F.col("file.qualified_name"))
    rows = rows.withColumn("source", source).withColumn("source_id", F.coalesce("parent_id", "file.id"))
    return _edges(rows, "contains", F.struct(F.lit(0).alias("stage"), F.col("ordinal").cast("long").alias("at"), F.lit(0).alias("part"), F.lit(0).alias("place")))


def imports_edges(symbols: DataFrame) -> DataFrame:
    """From the file to each import, named without ``static:``."""
    files = symbols.where("kind = 'file'").groupBy("path").agg(F.min_by(F.struct("id", "qualified_name"), "ordinal").alias("file"))
    rows = symbols.where("kind = 'import'").join(files, "path")
    rows = rows.select("path", F.col("file.qualified_name").alias("source"), F.regexp_replace("qualified_name", r"\Astatic:", "").alias("destination"), F.col("file.id").alias("source_id"), F.col("id").alias("destination_id"), F.create_map(F.lit("is_static"), F.coalesce("is_static", F.lit(False))).alias("metadata"), "ordinal")
    return _edges(rows, "imports", F.struct(F.lit(0).alias("stage"), F.col("ordinal").cast("long").alias("at"), F.lit(1).alias("part"), F.lit(0).alias("place")))


def enclosing_symbol(spans: DataFrame, symbols: DataFrame, kinds=OWNERS) -> DataFrame:
    """``spans(path, node_id, start_line, start_column, end_line, end_column)`` with the innermost symbol around each.

    Innermost: fewest lines, then columns, then the earliest start; ties go to the symbol that was extracted first.
    Spans outside all symbols have no row.
    """
    s = symbols.where(F.col("kind").isin(*kinds)).select("path", F.struct("id", "kind", "qualified_name", "parent_name").alias("owner"), *[F.col(c).alias(f"s_{c}") for c in ("start_line", "start_column", "end_line", "end_column")], F.col("ordinal").alias("s_ordinal"))
    inside = (F.struct("s_start_line", "s_start_column") <= F.struct(F.col("start_line").alias("s_start_line"), F.col("start_column").alias("s_start_column"))) & (F.struct(F.col("end_line").alias("s_end_line"), F.col("end_column").alias("s_end_column")) <= F.struct("s_end_line", "s_end_column"))
    rank = F.struct(F.col("s_end_line") - F.col("s_start_line"), F.col("s_end_column") - F.col("s_start_column"), "s_start_line", "s_start_column", "s_ordinal")
    return stab(spans, s, ["path"], "start_line", "s_start_line", "s_end_line").where(inside).groupBy("path", "node_id").agg(F.min_by("owner", rank).alias("owner"))


def calls_edges(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """``calls(path, node_id, callee, span...)`` -> edges from the enclosing callable; the end has an id if the file has a callable of that name."""
    owners = enclosing_symbol(calls, symbols, CALLABLES)
    named = last_by_name(symbols.where(F.col("kind").isin(*CALLABLES))).select("path", F.col("qualified_name").alias("callee"), F.col("id").alias("destination_id"))
    rows = calls.where("callee <> ''").select("path", "node_id", "callee").join(owners, ["path", "node_id"]).join(named, ["path", "callee"], "left")
    rows = rows.select("path", F.col("owner.qualified_name").alias("source"), F.col("callee").alias("destination"), F.col("owner.id").alias("source_id"), "destination_id", "node_id")
    return _edges(rows, "calls", F.struct(F.lit(1).alias("stage"), F.col("node_id").cast("long").alias("at"), F.lit(0).alias("part"), F.lit(0).alias("place")))


def resolve_variable(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """``references(path, node_id, place, name, owner, ...)`` with the variable each name means; unresolved ones have no row.

    A variable of the owning callable itself comes first, then one of the owner's type or outer scope, then one of
    the module; of equal rank the one that starts first, then the one extracted first.
    """
    keys = references.columns
    # Null scopes are a value of their own. Of a scope only its first variable of a name counts, so that a name that many
    # callables use doesn't meet all its variables.
    scope_key = lambda c: F.coalesce(F.concat(F.lit("in "), c), F.lit("module"))
    v = symbols.where("kind = 'variable'").select("path", "name", scope_key(F.col("parent_name")).alias("scope_"), F.struct(F.col("start_line").alias("v_line"), F.col("ordinal").alias("v_ordinal"), F.col("qualified_name").alias("variable")).alias("v"))
    v = v.groupBy("path", "name", "scope_").agg(F.min("v").alias("v"))
    outer = F.col("owner.parent_name")
    of_type = F.when(F.col("owner.kind").isin("method", "constructor") & outer.contains("."), F.regexp_replace(outer, r"(?s)\.[^.]*\z", "")).otherwise(outer)
    tier = lambda good, rank, scope: F.when(good, F.struct(F.lit(rank).alias("rank"), scope_key(scope).alias("scope_")))
    tiers = F.array_compact(F.array(
        tier(F.col("owner.kind").isin(*CALLABLES) & F.col("owner.qualified_name").isNotNull(), 0, F.col("owner.qualified_name")),
        tier(of_type != "", 1, of_type),
        tier(outer != "", 1, outer),
        tier(F.lit(True), 2, F.lit(None).cast("string")),
    ))
    found = references.select(*keys, F.explode(F.array_distinct(tiers)).alias("t_")).select(*keys, "t_.rank", "t_.scope_").join(v, ["path", "name", "scope_"])
    best = found.groupBy(*keys).agg(F.min(F.struct("rank", "v")).alias("best_"))
    return best.select(*keys, F.col("best_.v.variable").alias("variable"))


def access_edges(accesses: DataFrame, symbols: DataFrame) -> DataFrame:
    """``accesses(path, node_id, place, mode, name, span...)``, mode reads or writes -> edges from owners to variables.

    A variable counts once for a node and mode; the end is the last variable of that qualified name.
    """
    spans = accesses.select("path", "node_id", "start_line", "start_column", "end_line", "end_column").distinct()
    owned = accesses.select("path", "node_id", "place", "mode", "name").join(enclosing_symbol(spans, symbols), ["path", "node_id"])
    rows = resolve_variable(owned, symbols).groupBy("path", "node_id", "mode", "variable").agg(F.min("place").alias("place"), F.first("owner").alias("owner"))
    ids = last_by_name(symbols.where("kind = 'variable'")).select("path", F.col("qualified_name").alias("variable"), F.col("id").alias("destination_id"))
    rows = rows.join(ids, ["path", "variable"]).select("path", "mode", F.col("owner.qualified_name").alias("source"), F.col("variable").alias("destination"), F.col("owner.id").alias("source_id"), "destination_id", "node_id", "place")
    # Writes of a node come before its reads.
    part = F.when(F.col("mode") == "writes", 0).otherwise(1)
    return _edges(rows.where(F.col("mode").isin("writes", "reads")), F.col("mode"), F.struct(F.lit(2).alias("stage"), F.col("node_id").cast("long").alias("at"), part.alias("part"), F.col("place").cast("int").alias("place")))


def all_relations(symbols: DataFrame, calls: DataFrame, accesses: DataFrame) -> DataFrame:
    """All relations of the files, the first of each id in a file; ordinals become whole places in the order of extraction."""
    both = contains_edges(symbols).unionByName(imports_edges(symbols)).unionByName(calls_edges(calls, symbols)).unionByName(access_edges(accesses, symbols))
    return dedupe_first(both)
