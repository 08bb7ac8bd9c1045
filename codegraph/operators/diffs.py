"""Unified diffs to files, hunks and changed lines, one row of text at a time and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import let, split_lines, strip
from ..sources.shared import stage

#: A shell-like token: quoted pieces, escaped characters and plain runs in any order.
TOKEN = r"""(?:"(?:[^"\\]|\\.)*"|'[^']*'|\\.|[^ \t\r\n"'\\])+"""
PIECE = r""""(?:[^"\\]|\\.)*"|'[^']*'|\\.|[^"'\\]+"""
HEADER = rf"(?s)\Adiff --git[ \t\r\n]+({TOKEN})[ \t\r\n]+({TOKEN})[ \t\r\n]*\z"
PATH_LINE = rf"(?s)\A({TOKEN})(?:[ \t\r\n]+{TOKEN})*[ \t\r\n]*\z"
HUNK = r"\A@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
#: Before each header that starts a line.
FILE_START = r"(?s)(?<=\A|[\n\r\x0b\x0c\x1c-\x1e\x85  ])(?=diff --git )"


def unquote(token: Column) -> Column:
    """The text that a shell would read: quotes removed, escapes resolved."""
    pieces = F.regexp_extract_all(token, F.lit(PIECE), 0)

    def plain(p):
        inner = F.substring(p, 2, 1 << 30)
        inner = F.substr(inner, F.lit(1), F.length(inner) - 1)
        return F.when(p.startswith('"'), F.regexp_replace(inner, r'\\(["\\])', "$1")).when(p.startswith("'"), inner).when(p.startswith("\\"), F.substring(p, 2, 1 << 30)).otherwise(p)

    return F.array_join(F.transform(pieces, plain), "")


def clean_path(path: Column) -> Column:
    """Slashes forward and one leading ``a/`` or ``b/`` off; null for ``/dev/null``."""
    return F.when(path != "/dev/null", F.regexp_replace(F.translate(path, "\\", "/"), r"\A[ab]/", ""))


def header_paths(line: Column) -> tuple[Column, Column, Column]:
    """Old path, new path and whether the line is a header of exactly two paths."""
    old, new = (clean_path(unquote(F.regexp_extract(line, HEADER, g))) for g in (1, 2))
    good = line.rlike(HEADER)
    return F.when(good, old), F.when(good, new), good


def path_of_line(line: Column) -> Column:
    """The path of a ``---`` or ``+++`` line: its first token, or up to the first tab or blank where quotes don't close."""
    rest = strip(F.substring(line, 5, 1 << 30))
    token = unquote(F.regexp_extract(rest, PATH_LINE, 1))
    return clean_path(F.when(rest.rlike(PATH_LINE), token).otherwise(F.substring_index(F.substring_index(rest, "\t", 1), " ", 1)))


def hunk_header(line: Column) -> Column:
    """Four numbers as a struct; a count that is left out is 1, a count of 0 stays. Null for a line that is none or has a number beyond int."""
    names = ("old_start_line", "old_line_count", "new_start_line", "new_line_count")

    def of(parts):
        number = lambda g: F.coalesce(F.nullif(F.get(parts, g), F.lit("")), F.lit("01"[g % 2])).try_cast("int")
        return F.when(F.forall(parts, lambda p: (p == "") | p.try_cast("int").isNotNull()), F.struct(*[number(g).alias(n) for g, n in enumerate(names)]))

    return F.when(line.rlike(HUNK), let(F.split(F.regexp_replace(line, rf"(?s){HUNK}.*", "$1/$2/$3/$4"), "/", -1), of))


def _last(lines: Column, prefix: str, value) -> Column:
    """``value`` of the last line with the prefix, in an array that is empty without one (the value may be null)."""
    found = F.filter(lines, lambda x: x.startswith(prefix))
    return F.transform(F.when(F.size(found) > 0, F.slice(found, F.size(found), 1)).otherwise(found), value)


def change_type(mode: Column, old_path: Column, new_path: Column) -> Column:
    """What a mode line says, else by which path is missing."""
    return F.coalesce(mode, F.when(old_path.isNull() & new_path.isNotNull(), "added").when(new_path.isNull() & old_path.isNotNull(), "deleted").otherwise("modified"))


def changed_line_ranges(kind: Column, hunks: Column) -> Column:
    """Old ranges of a deleted file, new ranges otherwise."""
    pick = lambda a: F.transform(hunks, lambda h: F.struct(h[f"{a}_start_line"].alias("start_line"), h[f"{a}_line_count"].alias("line_count")))
    return F.when(kind == "deleted", pick("old")).otherwise(pick("new"))


def _file(section: Column) -> Column:
    """A section from one header to the next as a struct, with ``error`` for the first line that can't be read."""

    def of(lines):
        first = F.get(lines, 0)
        old0, new0, good = header_paths(first)
        rest = F.slice(lines, 2, 1 << 30)

        def fault(x):
            return F.when((x.startswith("--- ") | x.startswith("+++ ")) & (strip(F.substring(x, 5, 1 << 30)) == ""), "missing_path").when(x.startswith("@@ ") & hunk_header(x).isNull(), "bad_hunk")

        faults = F.filter(F.transform(rest, lambda x: F.struct(fault(x).alias("error"), x.alias("line"))), lambda x: x.error.isNotNull())
        mode = F.filter(rest, lambda x: x.startswith("new file mode ") | x.startswith("deleted file mode "))
        said = F.get(mode, F.size(mode) - 1)
        said = F.when(said.startswith("new"), "added").when(said.startswith("deleted"), "deleted")
        old, new = _last(rest, "--- ", path_of_line), _last(rest, "+++ ", path_of_line)
        hunks = F.array_compact(F.transform(F.filter(rest, lambda x: x.startswith("@@ ")), hunk_header))
        return F.struct(
            F.when(~good, "bad_header").otherwise(F.get(faults, 0).error).alias("error"),
            F.when(~good, first).otherwise(F.get(faults, 0).line).alias("line"),
            F.when(F.size(old) > 0, F.get(old, 0)).otherwise(old0).alias("old_path"),
            F.when(F.size(new) > 0, F.get(new, 0)).otherwise(new0).alias("new_path"),
            said.alias("mode"),
            hunks.alias("hunks"),
        )

    return let(split_lines(section), of)


def _found(diff: Column) -> Column:
    """The sections of a text as structs, with an error row for what stands before the first header, unless it is blank."""

    def begin(s):
        return F.when(s.startswith("diff --git "), _file(s)).when(
            strip(s) != "",
            F.struct(
                F.lit("content_before_header").alias("error"),
                F.get(F.filter(split_lines(s), lambda x: strip(x) != ""), 0).alias("line"),
                F.lit(None).cast("string").alias("old_path"),
                F.lit(None).cast("string").alias("new_path"),
                F.lit(None).cast("string").alias("mode"),
                F.array().cast("array<struct<old_start_line:int,old_line_count:int,new_start_line:int,new_line_count:int>>").alias("hunks"),
            ),
        )

    return F.filter(F.transform(F.split(diff, FILE_START, -1), begin), lambda f: f.isNotNull())


def read_files(diffs: DataFrame) -> DataFrame:
    """``diffs(diff_id, diff, ...)`` -> one row for each file section, with ``error`` and ``line`` where it can't be read.

    Text before the first header is an error unless it is blank. A diff without a header has no rows. Every row of
    a diff carries ``diff_error``, the first error of the diff. Rows may be whole diffs, or sections with ``part`` and
    ``offset`` (see :func:`codegraph.sources.scan.read_diff_sections`), which are numbered through their diff.
    """
    if "offset" in diffs.columns:
        return _read_sections(diffs)
    keys = [c for c in diffs.columns if c != "diff"]
    whole = let(_found(F.col("diff")), lambda fs: F.struct(fs.alias("files"), F.get(F.filter(F.transform(fs, _error), lambda e: e.isNotNull()), 0).alias("diff_error")))
    return _rows(diffs.select(*keys, F.inline(F.array(whole))).select(*keys, F.posexplode("files").alias("file_ordinal", "f"), "diff_error"), keys)


def _read_sections(sections: DataFrame) -> DataFrame:
    """Ordinals are sums: of the sections in the parts before, and of those before in the part, so a large diff isn't one task."""
    keys = [c for c in sections.columns if c not in ("diff", "part", "offset")]
    rows = stage(sections.select(*keys, "part", "offset", _found(F.col("diff")).alias("files")), "sections")
    before = "rows between unbounded preceding and 1 preceding"
    parts = rows.groupBy("diff_id", "part").agg(F.sum(F.size("files")).alias("n"))
    parts = parts.select("diff_id", "part", F.expr(f"coalesce(sum(n) over (partition by diff_id order by part {before}), 0) as first_"))
    rows = rows.withColumn("inside_", F.expr(f"coalesce(sum(size(files)) over (partition by diff_id, part order by offset {before}), 0)")).join(parts, ["diff_id", "part"])
    files = rows.select(*keys, "first_", "inside_", F.posexplode("files").alias("at_", "f")).select(*keys, (F.col("first_") + F.col("inside_") + F.col("at_")).cast("int").alias("file_ordinal"), "f")
    bad = files.where(_error(F.col("f")).isNotNull()).groupBy("diff_id").agg(F.min_by(_error(F.col("f")), "file_ordinal").alias("diff_error"))
    return _rows(files.join(bad, "diff_id", "left"), keys)


def _rows(files: DataFrame, keys: list[str]) -> DataFrame:
    kind = change_type(F.col("f.mode"), F.col("f.old_path"), F.col("f.new_path"))
    path = F.when(kind == "deleted", F.col("f.old_path")).otherwise(F.col("f.new_path"))
    return files.select(
        *keys, "file_ordinal", "diff_error", _error(F.col("f")).alias("error"), F.col("f.line").alias("line"), path.alias("path"), kind.alias("change_type"), F.col("f.old_path").alias("old_path"), F.col("f.new_path").alias("new_path"), changed_line_ranges(kind, F.col("f.hunks")).alias("changed_line_ranges"), F.col("f.hunks").alias("hunks")
    )


def _error(f: Column) -> Column:
    kind = change_type(f["mode"], f["old_path"], f["new_path"])
    return F.coalesce(f["error"], F.when(F.when(kind == "deleted", f["old_path"]).otherwise(f["new_path"]).isNull(), "no_target_path"))


def parse_diffs(diffs: DataFrame) -> DataFrame:
    """The files of all diffs that can be read from end to end."""
    return read_files(diffs).where("diff_error is null").drop("diff_error", "error", "line")


def diff_errors(diffs: DataFrame) -> DataFrame:
    """The first error of each diff that can't be read, with its line."""
    keys = [c for c in diffs.columns if c not in ("diff", "part", "offset")]
    bad = read_files(diffs).where("error is not null")
    first = bad.groupBy(*keys).agg(F.min_by(F.struct("error", "line"), "file_ordinal").alias("e"))
    return first.select(*keys, "e.error", "e.line")


def diff_file_index(lines: DataFrame) -> DataFrame:
    """``lines(diff_id, line_no, line)`` with the number of headers up to the line, 0 before the first."""
    w = W.partitionBy("diff_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    return lines.withColumn("file_index", F.sum(F.col("line").startswith("diff --git ").cast("int")).over(w))


def diff_lines(diffs: DataFrame) -> DataFrame:
    return diffs.select("diff_id", F.posexplode(split_lines(F.col("diff"))).alias("line_no", "line"))


def hunk_ranges(hunks: Column) -> Column:
    """Old range, new range, or a point where both counts are 0, for each hunk in order."""
    span = lambda s, n: F.struct(s.alias("start_line"), n.alias("line_count"))

    def of(h):
        old, new = h.old_line_count, h.new_line_count
        both = F.array(F.when(old > 0, span(h.old_start_line, old)), F.when(new > 0, span(h.new_start_line, new)), F.when((old == 0) & (new == 0), span(h.new_start_line, new)))
        return F.filter(both, lambda r: r.isNotNull())

    return F.flatten(F.transform(hunks, of))
