"""From changed lines to changed symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import stab
from ..functions.text import strip
from .diffs import hunk_ranges

#: Kinds of symbols that a change can seed (fixed values).
SEED_KINDS = ("class", "struct", "interface", "enum", "record", "annotation", "function", "method", "constructor", "type_alias")


def seed_symbols(symbols: DataFrame) -> DataFrame:
    return symbols.where(F.col("kind").isin(*SEED_KINDS))


def resolve_source_path(diff_files: DataFrame, files: DataFrame) -> DataFrame:
    """``diff_files`` with ``source_path``: the first of path, new_path and old_path that is in ``files(path)``, else null."""
    names = F.array_compact(F.array("path", "new_path", "old_path"))
    tried = diff_files.select("diff_id", "file_ordinal", F.posexplode(names).alias("pos", "candidate"))
    found = tried.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate").groupBy("diff_id", "file_ordinal").agg(F.min_by("candidate", "pos").alias("source_path"))
    return diff_files.join(found, ["diff_id", "file_ordinal"], "left")


def changed_file_status(source_path, language, parse_error):
    """Why a changed file is not loaded, null if it is."""
    return F.when(source_path.isNull(), "source_missing").when(language.isNull(), "unsupported_language").when(parse_error, "parse_error")


def changed_files_last(diff_files: DataFrame) -> DataFrame:
    """Of several entries of a diff with one path the last."""
    rest = [c for c in diff_files.columns if c not in ("diff_id", "path")]
    last = diff_files.groupBy("diff_id", "path").agg(F.max_by(F.struct(*rest), "file_ordinal").alias("f"))
    return last.select("diff_id", "path", "f.*").select(*diff_files.columns)


def ranges_of(diff_files: DataFrame) -> DataFrame:
    """``(diff_id, file_ordinal, path, range_ordinal, range_start, range_count)``."""
    rows = diff_files.select("diff_id", "file_ordinal", "path", F.posexplode(hunk_ranges(F.col("hunks"))).alias("range_ordinal", "r"))
    return rows.select("diff_id", "file_ordinal", "path", "range_ordinal", F.col("r.start_line").alias("range_start"), F.col("r.line_count").alias("range_count"))


def overlap_symbols(ranges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Ranges with the symbols of their path that they touch; a range of no lines touches what contains its point.

    Two intervals meet if one begins inside the other. Ranges that begin in a symbol, and symbols that begin in a range
    after its first line, are two joins of points with intervals; a pair is in one of them.
    """
    s = symbols.select("path", F.col("id").alias("symbol_id"), F.col("ordinal").alias("symbol_ordinal"), F.col("start_line").alias("symbol_start"), F.col("end_line").alias("symbol_end"))
    r = ranges.withColumn("last_", F.col("range_start") + F.greatest(F.col("range_count") - 1, F.lit(0)))
    out = [*ranges.columns, *[c for c in s.columns if c != "path"]]
    inside = stab(r, s, ["path"], "range_start", "symbol_start", "symbol_end").where("symbol_start <= range_start and symbol_end >= range_start")
    after = stab(s, r, ["path"], "symbol_start", "range_start", "last_").where("symbol_start > range_start and symbol_start <= last_ and symbol_end >= range_start")
    return inside.select(*out).unionByName(after.select(*out))


def changed_symbols(overlaps: DataFrame) -> DataFrame:
    """``(diff_id, symbol_id, seed_ordinal, matched_line_ranges)``: each range once, symbols and ranges in first-seen order."""
    seen = F.array_sort(F.collect_list(F.struct("file_ordinal", "range_ordinal", F.col("range_start").alias("start_line"), F.col("range_count").alias("line_count"))))
    found = overlaps.groupBy("diff_id", "symbol_id").agg(F.min(F.struct("file_ordinal", "symbol_ordinal")).alias("seed_ordinal"), seen.alias("seen"))
    ranges = F.array_distinct(F.transform("seen", lambda x: F.struct(x.start_line.alias("start_line"), x.line_count.alias("line_count"))))
    return found.select("diff_id", "symbol_id", "seed_ordinal", ranges.alias("matched_line_ranges"))


def modified_code(changed: DataFrame, symbols: DataFrame) -> DataFrame:
    """A snippet for each changed symbol with code, stripped; ``changed(diff_id, symbol_id)``."""
    first = symbols.groupBy("id").agg(F.min_by(F.struct("path", "language", "kind", "qualified_name", "start_line", "end_line", "code"), "ordinal").alias("s"))
    code = strip(F.col("s.code"))
    found = changed.select("diff_id", F.col("symbol_id").alias("id")).distinct().join(first, "id").where(code != "")
    return found.select("diff_id", F.col("id").alias("symbol_id"), "s.path", "s.language", "s.kind", "s.qualified_name", "s.start_line", "s.end_line", code.alias("code"))
