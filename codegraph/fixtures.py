"""Code-shaped tables derived from the star schema and the documents, for queries and tests; each has the same rule in SQL."""

from __future__ import annotations

import re

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import symbol_id
from .operators.diffs import changed_line_ranges
from .sources.shared import shared_path, stage

LANGUAGE = {"en": ("python", ".py"), "fr": ("java", ".java"), "de": ("c", ".c"), "es": ("cpp", ".cpp")}
KINDS = ("class", "function", "method", "variable", "import", "constructor")
SUFFIXES = (".py", ".PY", ".java", ".c", ".h", ".cc", ".hpp", ".md")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, i):
    return F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))


def _doc_path(root: str):
    suffix = F.create_map(*[F.lit(x) for k, v in LANGUAGE.items() for x in (k, v[1])])[F.col("lang")]
    return F.concat(F.lit(root), F.col("source"), F.lit("/d"), F.col("doc_id"), suffix)


def symbols(spark, sf_dir) -> DataFrame:
    """A document is a file, a line is a symbol."""
    language = F.create_map(*[F.lit(x) for k, v in LANGUAGE.items() for x in (k, v[0])])[F.col("lang")]
    d = table(spark, sf_dir, "documents").select(_doc_path("/repo/").alias("path"), language.alias("language"), F.split("text", "\n", -1).alias("ls"))
    d = d.select("path", "language", F.size("ls").cast("long").alias("nl"), F.posexplode("ls").alias("pos", "code")).withColumn("n", (F.col("pos") + 1).cast("long"))
    qn = F.concat(F.lit("s"), F.col("n") % 7)
    kind = _pick(KINDS, F.col("n") % 6)
    return d.select(
        symbol_id(kind, F.col("path"), qn, F.col("n")).alias("id"), kind.alias("kind"), "language", "path", qn.alias("name"), qn.alias("qualified_name"), F.concat(F.lit("sig "), qn).alias("signature"),
        F.col("n").alias("start_line"), F.lit(1).cast("long").alias("start_column"), F.least(F.col("n") + F.col("n") % 4, F.col("nl")).alias("end_line"), F.lit(100).cast("long").alias("end_column"),
        "code", F.when(F.col("n") % 3 == 0, "").otherwise(F.col("code")).alias("body"), F.when(F.col("n") % 2 == 0, F.concat(F.lit("s"), (F.col("n") + 3) % 7)).alias("parent_name"), (F.col("n") % 5 == 4).alias("is_static"), F.col("n").alias("ordinal"),
    )


def file_symbols(spark, sf_dir) -> DataFrame:
    """The file symbol of each document."""
    s = symbols(spark, sf_dir)
    f = s.groupBy("path", "language").agg(F.max("ordinal").alias("nl"))
    one = F.lit(1).cast("long")
    return f.select(
        symbol_id(F.lit("file"), F.col("path"), F.col("path"), one).alias("id"), F.lit("file").alias("kind"), "language", "path", F.substring_index("path", "/", -1).alias("name"), F.col("path").alias("qualified_name"), F.col("path").alias("signature"),
        one.alias("start_line"), one.alias("start_column"), F.col("nl").alias("end_line"), F.lit(100).cast("long").alias("end_column"), F.lit("").alias("code"), F.lit("").alias("body"), F.lit(None).cast("string").alias("parent_name"), F.lit(False).alias("is_static"), F.lit(0).cast("long").alias("ordinal"),
    )


def all_symbols(spark, sf_dir) -> DataFrame:
    return symbols(spark, sf_dir).unionByName(file_symbols(spark, sf_dir))


def _page_path():
    i = F.col("page_id")
    folder = F.when(i % 11 == 0, "node_modules/").when(i % 11 == 1, "build/").otherwise("")
    return F.concat(folder, F.lit("src"), i % 7, F.lit("/m"), i, _pick(SUFFIXES, i % 8))


def files(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select(_page_path().alias("path"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("size"), (F.col("page_id") % 13 == 0).alias("parse_error"))


def written_files(spark, sf_dir) -> str:
    """A folder with the pages as files, made by the tasks; the paths are those of :func:`files`."""
    root = re.sub(r"^(?:file:/+)?/", "file:///", shared_path(spark, "pages"))

    def write(frames):
        fs, top = arrow_fs.FileSystem.from_uri(root)
        for frame in frames:
            for path, html in zip(frame["path"], frame["html"]):
                fs.create_dir(f"{top}/{path.rpartition('/')[0]}", recursive=True)
                with fs.open_output_stream(f"{top}/{path}", compression=None) as out:
                    out.write((html or "").encode("utf-8", "surrogatepass"))
            yield frame[["path"]]

    pages = table(spark, sf_dir, "pages").select(_page_path().alias("path"), "html")
    stage(pages.mapInPandas(write, "path string"), "written")
    return root


def hunks(spark, sf_dir) -> DataFrame:
    """Events change the documents in turn, all of them where there are enough events."""
    i, n = F.col("event_id"), max(table(spark, sf_dir, "documents").count(), 1)
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("diff_id"), "event_type", (i % n).alias("doc_id"))
    d = table(spark, sf_dir, "documents").select("doc_id", _doc_path("").alias("path"))
    kind = F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    return e.join(d, "doc_id").select("diff_id", "event_id", "path", kind.alias("change_type"), (i % 9 + 1).alias("old_start"), (i % 4).alias("old_count"), (i % 7 + 1).alias("new_start"), (i % 3).alias("new_count"))


def diff_files(spark, sf_dir) -> DataFrame:
    """The rows that parsing :func:`diffs` gives, made without text; paths are storage paths; file_ordinal is the event."""
    h = F.struct(*[F.col(c).cast("int").alias(f"{c.replace('_start', '_start_line').replace('_count', '_line_count')}") for c in ("old_start", "old_count", "new_start", "new_count")])
    path = F.concat(F.lit("/repo/"), F.col("path"))
    return hunks(spark, sf_dir).select("diff_id", F.col("event_id").alias("file_ordinal"), path.alias("path"), "change_type", F.when(F.col("change_type") != "added", path).alias("old_path"), F.when(F.col("change_type") != "deleted", path).alias("new_path"), F.array(h).alias("hunks")).withColumn("changed_line_ranges", changed_line_ranges(F.col("change_type"), F.col("hunks")))


def diffs(spark, sf_dir) -> DataFrame:
    """:func:`hunks` as unified diffs, one text for each diff."""
    return _as_text(hunks(spark, sf_dir))


def _as_text(hunks_: DataFrame) -> DataFrame:
    p, t = F.col("path"), F.col("change_type")
    mode = F.when(t == "added", "new file mode 100644\n").when(t == "deleted", "deleted file mode 100644\n").otherwise("")
    old, new = F.when(t == "added", "/dev/null").otherwise(F.concat(F.lit("a/"), p)), F.when(t == "deleted", "/dev/null").otherwise(F.concat(F.lit("b/"), p))
    numbers = F.format_string("@@ -%d,%d +%d,%d @@\n x\n", "old_start", "old_count", "new_start", "new_count")
    section = F.concat(F.lit("diff --git a/"), p, F.lit(" b/"), p, F.lit("\n"), mode, F.lit("--- "), old, F.lit("\n+++ "), new, F.lit("\n"), numbers)
    rows = hunks_.select("diff_id", F.struct("event_id", section.alias("s")).alias("x"))
    return rows.groupBy("diff_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.s), "").alias("diff"))


def source_diffs(spark, sf_dir) -> DataFrame:
    """Diffs of the files of :func:`sources`, each of one repository: of even ids /repo, of odd ids /other."""
    i, n = F.col("event_id"), max(table(spark, sf_dir, "documents").count(), 1)
    d = i % n
    kind = F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    e = table(spark, sf_dir, "events").select((F.col("user_id") * 2 + d % 2).alias("diff_id"), "event_id", F.concat(F.lit("m"), F.floor(d / 2), F.lit(".py")).alias("path"), kind.alias("change_type"), (i % 9 + 1).alias("old_start"), (i % 4).alias("old_count"), (i % 7 + 1).alias("new_start"), (i % 3).alias("new_count"))
    return _as_text(e)


def source_root():
    """Where the paths of a diff of :func:`source_diffs` begin."""
    return F.when(F.col("diff_id").cast("long") % 2 == 0, "/repo").otherwise("/other")


def edges(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    parts = (
        ("calls", "order", "part", li.select(F.col("l_orderkey").alias("a"), F.col("l_partkey").cast("long").alias("b")).distinct()),
        ("reads", "order", "supp", li.select(F.col("l_orderkey").alias("a"), F.col("l_suppkey").cast("long").alias("b")).distinct()),
        ("contains", "cust", "order", table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b")).distinct()),
        ("imports", "supp", "nation", table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").cast("long").alias("b")).distinct()),
    )
    out = None
    for kind, left, right, df in parts:
        e = df.select(F.lit(kind).alias("kind"), F.concat(F.lit(f"{left}:"), "a").alias("source_id"), F.concat(F.lit(f"{right}:"), "b").alias("destination_id"), F.concat(F.lit("f"), F.col("a") % 50, F.lit(".py")).alias("path"))
        out = e if out is None else out.unionByName(e)
    return out.select(F.concat("kind", F.lit(":"), "source_id", F.lit("->"), "destination_id").alias("id"), "kind", "path", F.col("source_id").alias("source"), F.col("destination_id").alias("destination"), "source_id", "destination_id")


def nodes(spark, sf_dir) -> DataFrame:
    ids = edges(spark, sf_dir).select(F.explode(F.array("source_id", "destination_id")).alias("id")).distinct()
    k = F.substring_index("id", ":", -1).cast("long")
    return ids.select("id", F.substring_index("id", ":", 1).alias("kind"), F.lit("python").alias("language"), F.concat(F.lit("f"), k % 50, F.lit(".py")).alias("path"), F.col("id").alias("name"), F.concat(F.lit("q."), "id").alias("qualified_name"), F.concat(F.lit("sig "), "id").alias("signature"), (k % 90 + 1).alias("start_line"), (k % 90 + 5).alias("end_line"))


def seeds(spark, sf_dir) -> DataFrame:
    e = edges(spark, sf_dir).where("source_id like 'order:%'")
    return e.where(F.substring_index("source_id", ":", -1).cast("long") % 100 == 0).select(F.col("source_id").alias("id")).distinct()


def vectors(spark, sf_dir) -> DataFrame:
    language = _pick(("python", "java", "c", "cpp"), F.col("label") % 4)
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.lpad(F.col("vec_id").cast("string"), 8, "0")).alias("id"), language.alias("language"), F.col("embedding").cast("array<double>").alias("embedding"), (F.col("vec_id") % 100 == 0).alias("is_query"))


def repo_files(spark, sf_dir) -> DataFrame:
    """The files after the diffs: a tenth is missing, some can't be parsed."""
    d = table(spark, sf_dir, "documents").where("doc_id % 10 <> 3")
    return d.select(_doc_path("/repo/").alias("path"), (F.col("doc_id") % 13 == 0).alias("parse_error"))


def sources(spark, sf_dir, after: bool = False, broken: bool = False) -> DataFrame:
    """Python files of two repositories that share all relative paths; what a line says depends on its number alone.

    ``after`` the diffs a tenth of them is missing, some can't be parsed, and the others end after half their lines. In
    ``broken`` ones every eleventh line gives a block with an error, in a function's body, a class's header or a bracket.
    Files are dealt to tasks as a scan deals them, before they have content: the table may lie in a few blocks.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n", -1)).alias("nl"))
    d = d.repartition(4 * spark.sparkContext.defaultParallelism, "doc_id")
    if after:
        d = d.where("doc_id % 10 <> 3").withColumn("nl", F.floor((F.col("nl") + 1) / 2).cast("int"))
    block = lambda n: (
        F.when(n % 3 == 1, F.concat(F.lit("def f"), n, F.lit("(a, b=1):\n    v"), n, F.lit(" = a\n    w = g(v"), n, F.lit(")\n    return f"), F.greatest(n - 3, F.lit(0)), F.lit("(w)\n")))
        .when(n % 3 == 2, F.concat(F.lit("class C"), n, F.lit("(Base):\n    x = 1\n\n    def m(self):\n        y = self.x\n        return y\n")))
        .otherwise(F.concat(F.lit("k"), n, F.lit(" = k"), n - 3, F.lit("\n")))
    )
    def wrong(n):
        text = F.regexp_replace(block(n), r"(v\d+) = a", "$1 = = a")
        return F.when(n % 11 == 5, F.regexp_replace(F.regexp_replace(text, r"\(Base\)", "(Base"), r"\A(k\d+) = ", "$1 = (")).otherwise(block(n))

    content = F.array_join(F.transform(F.sequence(F.lit(1), F.col("nl")), wrong if broken else block), "")
    if after:
        content = F.when(F.col("doc_id") % 13 == 0, "def (:\n").otherwise(content)
    repo = F.when(F.col("doc_id") % 2 == 0, "repo").otherwise("other")
    return d.select(repo.alias("repo_id"), F.concat(F.lit("/"), repo, F.lit("/m"), F.floor(F.col("doc_id") / 2), F.lit(".py")).alias("path"), F.lit("python").alias("language"), content.cast("binary").alias("content"))


#: The same tables in DuckDB, by name.
SQL = {
    "fx_docs": "SELECT doc_id, source, CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'java' WHEN 'de' THEN 'c' ELSE 'cpp' END AS language, source || '/d' || doc_id || CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.java' WHEN 'de' THEN '.c' ELSE '.cpp' END AS rel, string_split(text, chr(10)) AS ls FROM documents",
    "fx_lines": "SELECT *, len(ls) AS nl, unnest(range(1, len(ls) + 1)) AS n FROM fx_docs",
    "fx_plain": "SELECT CASE n % 6 WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 2 THEN 'method' WHEN 3 THEN 'variable' WHEN 4 THEN 'import' ELSE 'constructor' END AS kind, language, '/repo/' || rel AS path, 's' || (n % 7) AS name, 's' || (n % 7) AS qualified_name, 'sig s' || (n % 7) AS signature, n AS start_line, least(n + n % 4, nl) AS end_line, ls[n] AS code, CASE WHEN n % 3 = 0 THEN '' ELSE ls[n] END AS body, CASE WHEN n % 2 = 0 THEN 's' || ((n + 3) % 7) END AS parent_name, n % 5 = 4 AS is_static, n AS ordinal FROM fx_lines",
    "fx_symbols": "SELECT kind || ':' || path || ':' || qualified_name || ':' || start_line AS id, * FROM fx_plain",
    "fx_all": "SELECT * FROM fx_symbols UNION ALL SELECT 'file:/repo/' || rel || ':/repo/' || rel || ':1', 'file', language, '/repo/' || rel, string_split(rel, '/')[-1], '/repo/' || rel, '/repo/' || rel, 1, len(ls), '', '', NULL, false, 0 FROM fx_docs",
    "fx_files": "SELECT (CASE page_id % 11 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'build/' ELSE '' END) || 'src' || (page_id % 7) || '/m' || page_id || (['.py', '.PY', '.java', '.c', '.h', '.cc', '.hpp', '.md'])[page_id % 8 + 1] AS path, coalesce(octet_length(encode(html)), 0) AS size, page_id % 13 = 0 AS parse_error, (['python', 'python', 'java', 'c', 'c', 'cpp', 'cpp', NULL])[page_id % 8 + 1] AS language, page_id % 11 < 2 AS excluded FROM pages",
    "fx_hunks": "SELECT e.user_id AS diff_id, e.event_id, d.rel AS path, CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS change_type, 1 + event_id % 9 AS old_start, event_id % 4 AS old_count, 1 + event_id % 7 AS new_start, event_id % 3 AS new_count FROM events e JOIN fx_docs d ON d.doc_id = e.event_id % (SELECT greatest(count(*), 1) FROM documents)",
    "fx_ranges": "SELECT diff_id, event_id, '/repo/' || path AS path, 0 AS k, old_start AS range_start, old_count AS range_count FROM fx_hunks WHERE old_count > 0 UNION ALL SELECT diff_id, event_id, '/repo/' || path, CASE WHEN old_count > 0 THEN 1 ELSE 0 END, new_start, new_count FROM fx_hunks WHERE new_count > 0 OR old_count = 0",
    "fx_overlaps": "SELECT r.*, s.id AS symbol_id, s.kind, s.ordinal AS symbol_ordinal FROM fx_ranges r JOIN fx_symbols s ON s.path = r.path AND s.start_line <= r.range_start + greatest(r.range_count - 1, 0) AND s.end_line >= r.range_start",
    "fx_pairs": "SELECT DISTINCT 'calls' AS kind, 'order:' || l_orderkey AS source_id, 'part:' || l_partkey AS destination_id, l_orderkey AS k FROM lineitem UNION ALL SELECT DISTINCT 'reads', 'order:' || l_orderkey, 'supp:' || l_suppkey, l_orderkey FROM lineitem UNION ALL SELECT DISTINCT 'contains', 'cust:' || o_custkey, 'order:' || o_orderkey, o_custkey FROM orders UNION ALL SELECT DISTINCT 'imports', 'supp:' || s_suppkey, 'nation:' || s_nationkey, s_suppkey FROM supplier",
    "fx_edges": "SELECT kind || ':' || source_id || '->' || destination_id AS id, kind, 'f' || (k % 50) || '.py' AS path, source_id, destination_id FROM fx_pairs",
    "fx_ids": "SELECT source_id AS id FROM fx_pairs UNION SELECT destination_id FROM fx_pairs",
    "fx_nodes": "SELECT id, string_split(id, ':')[1] AS kind, 'f' || (string_split(id, ':')[2]::BIGINT % 50) || '.py' AS path, 'q.' || id AS qualified_name, string_split(id, ':')[2]::BIGINT % 90 + 1 AS start_line, string_split(id, ':')[2]::BIGINT % 90 + 5 AS end_line FROM fx_ids",
    "fx_seeds": "SELECT DISTINCT source_id AS id FROM fx_pairs WHERE kind IN ('calls', 'reads') AND k % 100 = 0",
    "fx_adj": "SELECT source_id AS here, destination_id AS there, id AS edge_id FROM fx_edges UNION ALL SELECT destination_id, source_id, id FROM fx_edges WHERE source_id <> destination_id",
    "fx_one": "SELECT s.id AS seed_id, a.there AS terminal_node_id, 1 AS hop_count, [a.edge_id] AS edge_ids, [s.id, a.there] AS node_ids FROM fx_seeds s JOIN fx_adj a ON a.here = s.id WHERE a.there <> s.id",
    "fx_two": "SELECT s.id AS seed_id, b.there AS terminal_node_id, 2 AS hop_count, [a.edge_id, b.edge_id] AS edge_ids, [s.id, a.there, b.there] AS node_ids FROM fx_seeds s JOIN fx_adj a ON a.here = s.id JOIN fx_adj b ON b.here = a.there WHERE a.edge_id <> b.edge_id AND b.there <> s.id",
    "fx_ranked": "SELECT *, row_number() OVER (PARTITION BY seed_id, terminal_node_id ORDER BY hop_count, edge_ids, node_ids) AS rn FROM (SELECT * FROM fx_one UNION ALL SELECT * FROM fx_two)",
    "fx_best": "SELECT * FROM fx_ranked WHERE rn = 1",
    "fx_vectors": "SELECT 'v' || lpad(vec_id::VARCHAR, 8, '0') AS id, (['python', 'java', 'c', 'cpp'])[label % 4 + 1] AS language, embedding::DOUBLE[] AS embedding, vec_id % 100 = 0 AS is_query FROM embeddings",
    "fx_repo": "SELECT '/repo/' || rel AS path, doc_id % 13 = 0 AS parse_error FROM fx_docs WHERE doc_id % 10 <> 3",
    "fx_changes": "SELECT h.diff_id, h.event_id AS file_ordinal, '/repo/' || h.path AS path, CASE WHEN change_type = 'deleted' THEN 'deleted' WHEN r.path IS NULL THEN 'missing_file' WHEN r.parse_error THEN 'parse_error' ELSE 'analysed' END AS status FROM fx_hunks h LEFT JOIN fx_repo r ON r.path = '/repo/' || h.path",
    "fx_last": "SELECT path, CASE WHEN bool_or(status = 'deleted') AND max_by(status, [diff_id, file_ordinal]) IN ('parse_error', 'missing_file') THEN 'deleted' ELSE max_by(status, [diff_id, file_ordinal]) END AS status, max_by(diff_id, [diff_id, file_ordinal]) AS diff_id FROM fx_changes GROUP BY path",
    "fx_src": "SELECT CASE WHEN doc_id % 2 = 0 THEN '/repo/m' ELSE '/other/m' END || (doc_id // 2) || '.py' AS path, n, 1 + 11 * ((n - 1) // 3) + (CASE n % 3 WHEN 1 THEN 0 WHEN 2 THEN 4 ELSE 10 END) AS line FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS n FROM fx_docs)",
    "fx_py": "SELECT path, n, 'function' AS kind, 'f' || n AS qn, NULL AS parent, line FROM fx_src WHERE n % 3 = 1 UNION ALL SELECT path, n, 'variable', 'f' || n || '.v' || n, 'f' || n, line + 1 FROM fx_src WHERE n % 3 = 1 UNION ALL SELECT path, n, 'variable', 'f' || n || '.w', 'f' || n, line + 2 FROM fx_src WHERE n % 3 = 1 UNION ALL SELECT path, n, 'class', 'C' || n, NULL, line FROM fx_src WHERE n % 3 = 2 UNION ALL SELECT path, n, 'variable', 'C' || n || '.x', 'C' || n, line + 1 FROM fx_src WHERE n % 3 = 2 UNION ALL SELECT path, n, 'method', 'C' || n || '.m', 'C' || n, line + 3 FROM fx_src WHERE n % 3 = 2 UNION ALL SELECT path, n, 'variable', 'C' || n || '.m.y', 'C' || n || '.m', line + 4 FROM fx_src WHERE n % 3 = 2 UNION ALL SELECT path, n, 'variable', 'k' || n, NULL, line FROM fx_src WHERE n % 3 = 0",
    "fx_refs": "SELECT path, r.mode, r.name, s.line + r.at AS line FROM fx_src s, LATERAL (SELECT unnest(CASE n % 3 WHEN 1 THEN [{'mode': 'writes', 'name': 'v' || n, 'at': 1}, {'mode': 'reads', 'name': 'a', 'at': 1}, {'mode': 'writes', 'name': 'w', 'at': 2}, {'mode': 'reads', 'name': 'v' || n, 'at': 2}, {'mode': 'reads', 'name': 'w', 'at': 3}] WHEN 2 THEN [{'mode': 'writes', 'name': 'x', 'at': 1}, {'mode': 'writes', 'name': 'y', 'at': 4}, {'mode': 'reads', 'name': 'x', 'at': 4}, {'mode': 'reads', 'name': 'y', 'at': 5}] ELSE [{'mode': 'writes', 'name': 'k' || n, 'at': 0}, {'mode': 'reads', 'name': 'k' || (n - 3), 'at': 0}] END) AS r)",
    "fx_pyedges": "SELECT DISTINCT path, n, kind, source, destination FROM (SELECT path, n, 'contains' AS kind, coalesce(parent, path) AS source, qn AS destination FROM fx_py UNION ALL SELECT path, n, 'calls', 'f' || n, 'f' || (n - 3) FROM fx_src WHERE n % 3 = 1 AND n > 3 UNION ALL SELECT path, n, 'writes', 'f' || n, 'f' || n || '.v' || n FROM fx_src WHERE n % 3 = 1 UNION ALL SELECT path, n, 'writes', 'f' || n, 'f' || n || '.w' FROM fx_src WHERE n % 3 = 1 UNION ALL SELECT path, n, 'reads', 'f' || n, 'f' || n || '.v' || n FROM fx_src WHERE n % 3 = 1 UNION ALL SELECT path, n, 'reads', 'f' || n, 'f' || n || '.w' FROM fx_src WHERE n % 3 = 1 UNION ALL SELECT path, n, 'writes', 'C' || n || '.m', 'C' || n || '.m.y' FROM fx_src WHERE n % 3 = 2 UNION ALL SELECT path, n, 'reads', 'C' || n || '.m', 'C' || n || '.m.y' FROM fx_src WHERE n % 3 = 2 UNION ALL SELECT path, n, 'reads', 'C' || n || '.m', 'C' || n || '.x' FROM fx_src WHERE n % 3 = 2 UNION ALL SELECT path, n, 'writes', path, 'k' || n FROM fx_src WHERE n % 3 = 0 UNION ALL SELECT path, n, 'reads', path, 'k' || (n - 3) FROM fx_src WHERE n % 3 = 0 AND n > 3)",
    "fx_pyrows": "SELECT 'node' AS what, path, n, kind || ':' || path || ':' || qn || ':' || line AS id FROM fx_py UNION ALL SELECT 'node', path, 0, 'file:' || path || ':' || path || ':1' FROM fx_src WHERE n = 1 UNION ALL SELECT 'edge', path, n, kind || ':' || path || ':' || source || '->' || destination FROM fx_pyedges UNION ALL SELECT 'document', path, n, kind || ':' || path || ':' || qn || ':' || line FROM fx_py WHERE kind IN ('function', 'method')",
    "fx_pychanges": "SELECT e.user_id * 2 + d.doc_id % 2 AS diff_id, e.event_id, CASE WHEN d.doc_id % 2 = 0 THEN '/repo/m' ELSE '/other/m' END || (d.doc_id // 2) || '.py' AS path, CASE WHEN event_type = 'error' THEN 'deleted' WHEN d.doc_id % 10 = 3 THEN 'missing_file' WHEN d.doc_id % 13 = 0 THEN 'parse_error' ELSE 'analysed' END AS status FROM events e JOIN documents d ON d.doc_id = e.event_id % (SELECT greatest(count(*), 1) FROM documents)",
    "fx_lenient": "SELECT *, line + CASE kind WHEN 'function' THEN 3 WHEN 'class' THEN 5 WHEN 'method' THEN 2 ELSE 0 END AS last FROM fx_py WHERE n % 11 <> 5 OR (n % 3 = 1 AND qn NOT LIKE '%.v%')",
    "fx_pyhunks": "SELECT e.user_id * 2 + d.doc_id % 2 AS diff_id, e.event_id, d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN '/repo/m' ELSE '/other/m' END || (d.doc_id // 2) || '.py' AS path, 1 + event_id % 9 AS old_start, event_id % 4 AS old_count, 1 + event_id % 7 AS new_start, event_id % 3 AS new_count FROM events e JOIN documents d ON d.doc_id = e.event_id % (SELECT greatest(count(*), 1) FROM documents)",
    "fx_pyranges": "SELECT diff_id, path, old_start AS a, old_start + old_count - 1 AS b FROM fx_pyhunks WHERE old_count > 0 AND doc_id % 10 <> 3 UNION ALL SELECT diff_id, path, new_start, new_start + greatest(new_count - 1, 0) FROM fx_pyhunks WHERE (new_count > 0 OR old_count = 0) AND doc_id % 10 <> 3",
    "fx_pylast": "SELECT path, CASE WHEN bool_or(status = 'deleted') AND max_by(status, [diff_id, event_id]) IN ('parse_error', 'missing_file') THEN 'deleted' ELSE max_by(status, [diff_id, event_id]) END AS status FROM fx_pychanges GROUP BY path",
    "fx_pyafter": "SELECT r.what, r.id, l.status FROM fx_pyrows r JOIN (SELECT path, max(n) AS nl FROM fx_src GROUP BY path) s ON s.path = r.path LEFT JOIN fx_pylast l ON l.path = r.path WHERE l.status IS NULL OR l.status = 'parse_error' OR (l.status = 'missing_file' AND r.what <> 'document') OR (l.status = 'analysed' AND 2 * r.n <= s.nl + 1)",
    "fx_callable": "SELECT *, CASE WHEN trim(body) = '' THEN signature ELSE signature || chr(10) || trim(body) END AS document FROM fx_symbols WHERE kind IN ('function', 'method', 'constructor') AND body <> ''",
    "fx_named": "SELECT path, qualified_name, max_by(id, ordinal) AS id FROM fx_all GROUP BY path, qualified_name",
    "fx_contains": "SELECT 'contains:' || s.path || ':' || CASE WHEN p.id IS NULL THEN s.path ELSE s.parent_name END || '->' || s.qualified_name AS id, 'contains' AS kind, s.path, CASE WHEN p.id IS NULL THEN s.path ELSE s.parent_name END AS source, s.qualified_name AS destination, coalesce(p.id, 'file:' || s.path || ':' || s.path || ':1') AS source_id, s.id AS destination_id, s.ordinal FROM fx_symbols s LEFT JOIN fx_named p ON p.path = s.path AND p.qualified_name = s.parent_name",
}


def with_tables(sql: str) -> str:
    """``sql`` after a WITH clause of the derived tables that it names, in the order of their definition."""
    need, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for name in SQL:
            if name in text and name not in need:
                need.add(name)
                todo.append(SQL[name])
    ctes = ", ".join(f"{name} AS ({SQL[name]})" for name in SQL if name in need)
    return f"WITH {ctes} {sql}" if ctes else sql


#: How line n of a document becomes a syntax node, by n % 5: (type path, types of the named nodes around it and how far back their lines are).
NODE_RULES = {
    "java": (("program/import_declaration", ()), ("program/class_declaration", ()), ("program/class_declaration/class_body/method_declaration", (("class_declaration", 1),)), ("program/class_declaration/class_body/method_declaration/block/if_statement/local_variable_declaration/variable_declarator", (("class_declaration", 2), ("method_declaration", 1))), ("program/ERROR", ())),
    "c": (("translation_unit/function_definition", ()), ("translation_unit/declaration/identifier", ()), ("translation_unit/struct_specifier", ()), ("translation_unit/struct_specifier/field_declaration_list/field_declaration/pointer_declarator", (("struct_specifier", 1),)), ("translation_unit/preproc_if/function_definition", ())),
    "cpp": (("translation_unit/namespace_definition", ()), ("translation_unit/namespace_definition/declaration_list/class_specifier", (("namespace_definition", 1),)), ("translation_unit/namespace_definition/declaration_list/class_specifier/field_declaration_list/function_definition", (("namespace_definition", 2), ("class_specifier", 1))), ("translation_unit/template_declaration/function_definition", ()), ("translation_unit/using_declaration", ())),
}


def syntax_nodes(spark, sf_dir, language: str) -> DataFrame:
    """Syntax nodes of the documents of one language: a root, and one node for each line with two nodes below it.

    Names are ``x`` and the line; the body of a node is the second half of its text. Below lie a parameter and a base.
    """
    d = table(spark, sf_dir, "documents").where(F.col("lang").isin(*[k for k, v in LANGUAGE.items() if v[0] == language]))
    d = d.select(_doc_path("/repo/").alias("path"), F.size(F.split("text", "\n", -1)).cast("long").alias("nl"))
    n, rules = F.col("n"), NODE_RULES[language]
    rows = d.select("path", "nl", F.explode(F.sequence(F.lit(1).cast("long"), F.col("nl"))).alias("n"))
    type_path = _pick([r[0] for r in rules], n % 5)
    around = F.array().cast("array<struct<type:string,name:string>>")
    for i, (_, names) in enumerate(rules):
        if names:
            around = F.when(n % 5 == i, F.array(*[F.struct(F.lit(t).alias("type"), F.concat(F.lit("x"), n - back).alias("name")) for t, back in names])).otherwise(around)
    long = lambda x: F.lit(x).cast("long")

    def row(df, node_id, parent, path_, text, start, end, name, anc, field=None, ordinal=0):
        own = df.select(F.lit("r").alias("repo_id"), "path", F.lit(language).alias("language"), node_id.alias("node_id"), parent.alias("parent_id"), F.lit(ordinal).alias("child_ord"), F.lit(field).cast("string").alias("field"), F.substring_index(path_, "/", -1).alias("type"), path_.alias("type_path"), anc.alias("anc_names"), name.alias("name"), F.col("n").cast("int").alias("start_line"), F.lit(1).alias("start_column"), F.col("n").cast("int").alias("end_line"), F.lit(50).alias("end_column"), start.alias("start_byte"), end.alias("end_byte"), text.alias("text"))
        return own.withColumn("body_start_byte", F.when(~F.col("type_path").contains("parameter") & ~F.col("type_path").contains("type_identifier"), F.col("start_byte") + F.length("text") / 2).cast("long")).withColumn("body_end_byte", F.when(F.col("body_start_byte").isNotNull(), F.col("end_byte")))

    none = F.array().cast("array<struct<type:string,name:string>>")
    root = row(d.withColumn("n", long(1)), long(0), F.lit(None).cast("long"), F.lit(rules[0][0].split("/")[0]), F.concat(F.lit("all of "), "path"), long(0), F.col("nl") * 100, F.lit(None).cast("string"), none)
    text = F.concat(F.lit("head "), n, F.lit(" {body}"))
    own = row(rows, n * 10, long(0), type_path, text, n * 100, n * 100 + F.length(text), F.concat(F.lit("x"), n), around)
    below = {"java": ("formal_parameters/formal_parameter", "superclass/type_identifier"), "c": ("pointer_declarator/function_declarator/parameter_list/parameter_declaration", "none/type_identifier"), "cpp": ("function_declarator/parameter_list/parameter_declaration", "base_class_clause/type_identifier")}[language]
    for i, rest in enumerate(below):
        for twice in (0, 1):
            place = n * 100 + 1 + i * 2 + twice
            own = own.unionByName(row(rows, n * 10 + 1 + i * 2 + twice, n * 10 + 9 - i, F.concat(type_path, F.lit(f"/{rest}")), F.concat(F.lit(f" t{twice * (1 - i)} "), n), place, place + 1, F.lit(None).cast("string"), around, None, twice))
    return root.unionByName(own).withColumn("parse_error", F.lit(False))
