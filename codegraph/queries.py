"""One query for each operator, over tables derived from the given ones, with the same result in DuckDB where SQL has it."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fixtures as fx
from .functions import text as tx
from .operators import changed, diffs, documents, explore, package, relations, store, symbols, update
from .plans import context, incremental, index
from .sources import scan, sinks, syntax
from .sources.shared import shared_path, stage
from .streaming import updates

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = fx.with_tables(sql)
        return f

    return add


def _join(c, mark=","):
    return F.array_join(c, mark)


# --- scan and filters -------------------------------------------------------------------------------------------------


@query("SELECT path, language FROM fx_files")
def language_of_path(s, d):
    return fx.files(s, d).select("path", tx.language_of_path(F.col("path")).alias("language"))


def _scanned(s, d):
    f = fx.files(s, d).where(~scan.excluded_path(F.col("path")))
    return f.withColumn("language", tx.language_of_path(F.col("path"))).withColumn("skip_reason", tx.skip_reason(F.col("language"), F.col("size"), F.col("parse_error"), 8000))


_REASON = "CASE WHEN language IS NULL THEN 'unsupported_language' WHEN size > 8000 THEN 'file_too_large' WHEN parse_error THEN 'parse_error' END"


@query(f"SELECT path, size, {_REASON} AS skip_reason FROM fx_files WHERE NOT excluded")
def skip_reason(s, d):
    return _scanned(s, d).select("path", "size", "skip_reason")


@query("SELECT path AS relative_path, language, size, CASE WHEN language IS NULL THEN 'unsupported_language' WHEN size > 8000 THEN 'file_too_large' END AS skip_reason, CASE WHEN language IS NOT NULL AND size <= 8000 THEN md5(p.html) END AS content FROM fx_files f JOIN pages p ON p.page_id = regexp_extract(path, 'm([0-9]+)[.]', 1)::BIGINT WHERE NOT excluded")
def scan_files(s, d):
    """The pages are written as files, listed, filtered and read."""
    f = scan.scan_files(s, fx.written_files(s, d), max_file_bytes=8000)
    return f.select("relative_path", "language", "size", "skip_reason", F.md5("content").alias("content"))


@query(f"SELECT CASE WHEN {_REASON} IS NULL THEN 'scanned' ELSE 'skipped' END AS status, {_REASON} AS skip_reason, count(*) AS files FROM fx_files WHERE NOT excluded GROUP BY ALL")
def scan_counts(s, d):
    return scan.scan_counts(_scanned(s, d))


@query("SELECT id, CASE WHEN kind = 'file' THEN 'File' ELSE 'CodeEntity' END AS label FROM fx_all")
def node_labels(s, d):
    return fx.all_symbols(s, d).select("id", store.node_label(F.col("kind")).alias("label"))


@query("SELECT id, kind FROM fx_all WHERE kind IN ('class', 'function', 'method', 'constructor')")
def seed_symbols(s, d):
    return changed.seed_symbols(fx.all_symbols(s, d)).select("id", "kind")


@query("SELECT id, language FROM fx_callable")
def callable_symbols(s, d):
    return documents.callable_symbols(fx.all_symbols(s, d)).select("id", "language")


@query("SELECT DISTINCT o.diff_id, o.symbol_id AS id, s.path, s.kind, s.qualified_name FROM fx_overlaps o JOIN fx_symbols s ON s.id = o.symbol_id WHERE s.kind NOT IN ('variable', 'import')")
def build_seed_nodes(s, d):
    return explore.build_seed_nodes(_changed(s, d), fx.symbols(s, d))


def _relations(s, d):
    """Relations of a file with some ends unknown and repeated ids."""
    c = relations.contains_edges(fx.all_symbols(s, d)).withColumn("ordinal", F.col("ordinal.at"))
    return c.withColumn("destination_id", F.when(F.col("ordinal") % 4 != 1, F.col("destination_id")))


_SOME = "(SELECT id, path, source_id, CASE WHEN ordinal % 4 <> 1 THEN destination_id END AS destination_id, ordinal FROM fx_contains)"


@query(f"SELECT id, destination_id FROM {_SOME} WHERE destination_id IS NOT NULL")
def storable_relations(s, d):
    return store.storable_relations(_relations(s, d)).select("id", "destination_id")


@query("SELECT here, there, edge_id FROM fx_adj JOIN fx_edges ON fx_edges.id = edge_id WHERE kind IN ('calls', 'imports')")
def allowed_kinds(s, d):
    return explore.adjacency(fx.edges(s, d), explore.allowed_kinds(("imports", "calls", "calls")))


def _asked(s, d):
    e = fx.table(s, d, "events").select((F.col("event_id") % 60).alias("k")).distinct()
    return e.select(F.concat(F.lit("f"), "k", F.lit(".py")).alias("path"))


_ASKED = "(SELECT DISTINCT 'f' || (event_id % 60) || '.py' AS path FROM events)"


@query(f"SELECT a.path, coalesce(string_agg(n.id, ',' ORDER BY n.id), '') AS symbol_ids FROM {_ASKED} a LEFT JOIN fx_nodes n ON n.path = a.path GROUP BY a.path")
def symbols_by_paths(s, d):
    return store.symbols_by_paths(fx.nodes(s, d), _asked(s, d)).select("path", _join("symbol_ids").alias("symbol_ids"))


_CHANGED_PATHS = "(SELECT DISTINCT '/repo/' || path AS path FROM fx_hunks)"


@query(f"SELECT c.path, string_agg(c.id, ',' ORDER BY c.id) AS document_ids FROM fx_callable c JOIN {_CHANGED_PATHS} p ON p.path = c.path WHERE language = 'python' GROUP BY c.path")
def documents_by_paths(s, d):
    found = store.documents_by_paths(_documents(s, d), fx.diff_files(s, d), "python")
    return found.select("path", _join("document_ids").alias("document_ids"))


# --- relations --------------------------------------------------------------------------------------------------------


@query("SELECT id, path, source, destination, source_id, destination_id FROM fx_contains")
def contains_edges(s, d):
    return relations.contains_edges(fx.all_symbols(s, d)).select("id", "path", "source", "destination", "source_id", "destination_id")


@query("SELECT 'imports:' || path || ':' || path || '->' || qualified_name AS id, 'file:' || path || ':' || path || ':1' AS source_id, id AS destination_id, '{\"is_static\": ' || is_static || '}' AS metadata FROM fx_symbols WHERE kind = 'import'")
def imports_edges(s, d):
    return relations.imports_edges(fx.all_symbols(s, d)).select("id", "source_id", "destination_id", tx.metadata_json(F.col("metadata")).alias("metadata"))


def _spans(s, d):
    """A node in every line: it starts in column 5, ends in column 9 and calls a name."""
    n = fx.symbols(s, d)
    return n.select("path", F.col("ordinal").alias("node_id"), "start_line", F.lit(5).alias("start_column"), F.col("start_line").alias("end_line"), F.lit(9).alias("end_column"), F.concat(F.lit("s"), F.col("ordinal") % 9).alias("callee"))


_INNER = "(SELECT n.path, n.ordinal AS node_id, s.id AS owner_id, s.kind, s.qualified_name AS owner, s.parent_name, row_number() OVER (PARTITION BY n.path, n.ordinal ORDER BY s.end_line - s.start_line, s.start_line, s.ordinal) AS rn FROM fx_symbols n JOIN fx_all s ON s.path = n.path AND s.start_line <= n.start_line AND s.end_line >= n.start_line WHERE s.kind IN ({}))"
_ALL_OWNERS = _INNER.format("'file', 'class', 'function', 'method', 'constructor'")
_CALLERS = _INNER.format("'function', 'method', 'constructor'")


@query(f"SELECT path, node_id, owner_id FROM {_ALL_OWNERS} WHERE rn = 1")
def enclosing_symbol(s, d):
    return relations.enclosing_symbol(_spans(s, d), fx.all_symbols(s, d)).select("path", "node_id", F.col("owner.id").alias("owner_id"))


@query(
    f"SELECT 'calls:' || c.path || ':' || c.owner || '->s' || (node_id % 9) AS id, c.owner_id AS source_id, t.id AS destination_id, node_id FROM {_CALLERS} c LEFT JOIN (SELECT path, qualified_name, max_by(id, ordinal) AS id FROM fx_symbols WHERE kind IN ('function', 'method', 'constructor') GROUP BY ALL) t ON t.path = c.path AND t.qualified_name = 's' || (node_id % 9) WHERE rn = 1"
)
def calls_edges(s, d):
    e = relations.calls_edges(_spans(s, d), fx.all_symbols(s, d))
    return e.select("id", "source_id", "destination_id", F.col("ordinal.at").alias("node_id"))


def _accesses(s, d):
    n = _spans(s, d).drop("callee")
    rows = n.select("*", F.posexplode(F.array(F.col("node_id") % 7, (F.col("node_id") + 2) % 7, F.col("node_id") % 7)).alias("place", "k"))
    return rows.select(*n.columns, "place", F.when(F.col("place") == 0, "writes").otherwise("reads").alias("mode"), F.concat(F.lit("s"), "k").alias("name"))


_REFS = "(SELECT c.*, p.place, 's' || ((node_id + CASE p.place WHEN 1 THEN 2 ELSE 0 END) % 7) AS name, CASE p.place WHEN 0 THEN 'writes' ELSE 'reads' END AS mode FROM " + _ALL_OWNERS + " c, (SELECT unnest([0, 1, 2]) AS place) p WHERE c.rn = 1)"
_RANKED = f"(SELECT r.path, r.node_id, r.place, r.mode, r.owner, r.owner_id, v.qualified_name AS variable, row_number() OVER (PARTITION BY r.path, r.node_id, r.place ORDER BY CASE WHEN r.kind IN ('function', 'method', 'constructor') AND v.parent_name = r.owner THEN 0 WHEN v.parent_name = r.parent_name THEN 1 ELSE 2 END, v.start_line, v.ordinal) AS vn FROM {_REFS} r JOIN fx_symbols v ON v.path = r.path AND v.kind = 'variable' AND v.name = r.name WHERE (r.kind IN ('function', 'method', 'constructor') AND v.parent_name = r.owner) OR v.parent_name = r.parent_name OR v.parent_name IS NULL)"


@query(f"SELECT path, node_id, place, variable FROM {_RANKED} WHERE vn = 1")
def resolve_variable(s, d):
    a = _accesses(s, d)
    owned = a.select("path", "node_id", "place", "name").join(relations.enclosing_symbol(a, fx.all_symbols(s, d)), ["path", "node_id"])
    return relations.resolve_variable(owned, fx.all_symbols(s, d)).select("path", "node_id", "place", "variable")


@query(f"SELECT DISTINCT r.mode AS kind, r.path, r.node_id, r.owner_id AS source_id, t.id AS destination_id FROM {_RANKED} r JOIN (SELECT path, qualified_name, max_by(id, ordinal) AS id FROM fx_symbols WHERE kind = 'variable' GROUP BY ALL) t ON t.path = r.path AND t.qualified_name = r.variable WHERE vn = 1")
def access_edges(s, d):
    e = relations.access_edges(_accesses(s, d), fx.all_symbols(s, d))
    return e.select("kind", "path", F.col("ordinal.at").alias("node_id"), "source_id", "destination_id")


@query(f"SELECT id, path, min(ordinal) AS ordinal, arg_min(coalesce(destination_id, ''), ordinal) AS destination_id FROM {_SOME} GROUP BY id, path")
def dedupe_relations_first(s, d):
    return store.dedupe_first(_relations(s, d)).select("id", "path", "ordinal", F.coalesce("destination_id", F.lit("")).alias("destination_id"))


@query(f"SELECT id, max(ordinal) AS ordinal, arg_max(destination_id, ordinal) AS destination_id FROM {_SOME} WHERE destination_id IS NOT NULL GROUP BY id")
def dedupe_relations_last(s, d):
    return store.dedupe_last(store.storable_relations(_relations(s, d))).select("id", "ordinal", "destination_id")


# --- the store --------------------------------------------------------------------------------------------------------


def _numbered(df):
    return df.withColumn("k", F.substring_index("id", ":", -1).cast("long"))


def _node_tables(s, d):
    """The stored nodes, and new rows that replace some and add others; some ids come twice."""
    n = fx.nodes(s, d).select("id", "kind", "path", "start_line", F.lit(0).cast("long").alias("ordinal"))
    k = F.substring_index("id", ":", -1).cast("long")
    old = n.where(k % 3 != 0)
    new = n.where(k % 2 == 0).select("id", F.lit("new").alias("kind"), "path", "start_line", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("ordinal"))
    return old, new.withColumn("start_line", F.col("start_line") + F.col("ordinal"))


_K = "string_split({}id, ':')[2]::BIGINT"


@query(f"SELECT id, kind, path, start_line, 0 AS ordinal FROM fx_nodes WHERE {_K.format('')} % 3 <> 0 AND {_K.format('')} % 2 <> 0 UNION ALL SELECT id, 'new', path, start_line + 2, 2 FROM fx_nodes WHERE {_K.format('')} % 2 = 0")
def upsert_nodes(s, d):
    return store.upsert_nodes(*_node_tables(s, d)).select("id", "kind", "path", "start_line", F.col("ordinal").cast("int").alias("ordinal"))


@query(
    f"SELECT e.id, CASE WHEN string_split(e.source_id, ':')[2]::BIGINT % 2 = 0 AND a.id IS NOT NULL AND b.id IS NOT NULL THEN 'new' ELSE e.kind END AS kind FROM fx_edges e LEFT JOIN (SELECT id FROM fx_nodes WHERE {_K.format('')} % 3 <> 0) a ON a.id = e.source_id LEFT JOIN (SELECT id FROM fx_nodes WHERE {_K.format('')} % 3 <> 0) b ON b.id = e.destination_id"
)
def upsert_edges(s, d):
    e = fx.edges(s, d).select("id", "kind", "path", "source_id", "destination_id", F.lit(0).alias("ordinal"))
    new = e.where(F.substring_index("source_id", ":", -1).cast("long") % 2 == 0).withColumn("kind", F.lit("new"))
    return store.upsert_edges(e, new, _node_tables(s, d)[0]).select("id", "kind")


def _gone(s, d):
    return fx.table(s, d, "nation").select(F.concat(F.lit("f"), F.col("n_nationkey") * 2, F.lit(".py")).alias("path")).where("path like 'f1%'")


_GONE = "(SELECT 'f' || (n_nationkey * 2) || '.py' AS path FROM nation WHERE 'f' || (n_nationkey * 2) || '.py' LIKE 'f1%')"


@query(f"SELECT id, path FROM fx_edges WHERE path NOT IN {_GONE}")
def delete_edges_by_path(s, d):
    return store.delete_edges_by_path(fx.edges(s, d), _gone(s, d)).select("id", "path")


@query(f"SELECT 'node' AS what, id FROM fx_nodes WHERE path NOT IN {_GONE} UNION ALL SELECT 'edge', id FROM fx_edges WHERE source_id NOT IN (SELECT id FROM fx_nodes WHERE path IN {_GONE}) AND destination_id NOT IN (SELECT id FROM fx_nodes WHERE path IN {_GONE})")
def delete_nodes_by_path(s, d):
    n, e = store.delete_nodes_by_path(fx.nodes(s, d), fx.edges(s, d), _gone(s, d))
    return n.select(F.lit("node").alias("what"), "id").unionAll(e.select(F.lit("edge").alias("what"), "id"))


@query("SELECT (SELECT count(*) FROM fx_nodes) AS node_count, (SELECT count(*) FROM fx_edges) AS edge_count")
def graph_counts(s, d):
    return store.graph_counts(fx.nodes(s, d), fx.edges(s, d))


@query("SELECT l.language, count(c.id) AS documents FROM (SELECT unnest(['python', 'java', 'rust']) AS language) l LEFT JOIN fx_callable c ON c.language = l.language GROUP BY l.language")
def document_counts(s, d):
    return store.document_counts(_documents(s, d), ["java", "python", "rust", "java"])


@query("SELECT 'orders' AS what, 'edge' AS kind, l_orderkey || '/' || l_linenumber AS value, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT 'nodes', 'node', id, count(*) FROM fx_nodes GROUP BY ALL HAVING count(*) > 1")
def unique_id_check(s, d):
    li = fx.table(s, d, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("id"))
    a = store.unique_id_check(li, "id").select(F.lit("orders").alias("what"), F.lit("edge").alias("kind"), "value", "n")
    return a.unionAll(store.unique_id_check(fx.nodes(s, d), "id").select(F.lit("nodes").alias("what"), F.lit("node").alias("kind"), "value", "n"))


@query("SELECT CASE WHEN n <> n2 THEN 'nodes' WHEN e <> e2 THEN 'edges' END AS mismatch, CASE WHEN n <> n2 THEN n WHEN e <> e2 THEN e END AS expected, CASE WHEN n <> n2 THEN n2 WHEN e <> e2 THEN e2 END AS found FROM (SELECT (SELECT count(*) FROM fx_nodes) AS n, (SELECT count(*) FROM fx_nodes) AS n2, (SELECT count(*) FROM fx_edges) AS e, (SELECT count(*) FROM fx_edges WHERE kind <> 'imports') AS e2)")
def verify_index(s, d):
    def counted(n, e):
        return store.graph_counts(n, e).select(F.col("node_count").alias("nodes"), F.col("edge_count").alias("edges"), F.lit(0).cast("long").alias("documents"))

    n, e = fx.nodes(s, d), fx.edges(s, d)
    return store.verify_index(counted(n, e), counted(n, e.where("kind <> 'imports'")))


# --- diffs ------------------------------------------------------------------------------------------------------------


@query("SELECT diff_id, row_number() OVER (PARTITION BY diff_id ORDER BY event_id) - 1 AS file_ordinal, path, change_type, CASE WHEN change_type <> 'added' THEN path END AS old_path, CASE WHEN change_type <> 'deleted' THEN path END AS new_path, old_start || ',' || old_count || ',' || new_start || ',' || new_count AS hunks FROM fx_hunks")
def parse_diffs(s, d):
    f = diffs.parse_diffs(fx.diffs(s, d))
    hunk = F.transform("hunks", lambda h: F.concat_ws(",", h.old_start_line, h.old_line_count, h.new_start_line, h.new_line_count))
    return f.select("diff_id", F.col("file_ordinal").cast("long").alias("file_ordinal"), "path", "change_type", "old_path", "new_path", _join(hunk, ";").alias("hunks"))


def _header_lines(s, d):
    """Headers and path lines with odd names, made of urls and numbers."""
    p, i = fx.table(s, d, "pages"), F.col("page_id")
    name = F.regexp_replace("url", "[^a-z0-9/.]", "_")
    old = F.when(i % 5 == 0, F.concat(F.lit('"a/'), name, F.lit(' x\\"y"'))).when(i % 5 == 1, F.concat(F.lit("'a/"), name, F.lit(" z'"))).when(i % 5 == 2, "/dev/null").otherwise(F.concat(F.lit("a/"), name))
    return p.select(i.alias("page_id"), F.concat(F.lit("diff --git "), old, F.lit(" b/"), name, F.when(i % 7 == 0, " extra").otherwise("")).alias("line"))


_NAME = "regexp_replace(url, '[^a-z0-9/.]', '_', 'g')"


@query(f"SELECT page_id, page_id % 7 <> 0 AS good, CASE WHEN page_id % 7 <> 0 THEN CASE page_id % 5 WHEN 0 THEN {_NAME} || ' x\"y' WHEN 1 THEN {_NAME} || ' z' WHEN 2 THEN NULL ELSE {_NAME} END END AS old_path, CASE WHEN page_id % 7 <> 0 THEN {_NAME} END AS new_path FROM pages")
def diff_headers(s, d):
    old, new, good = diffs.header_paths(F.col("line"))
    return _header_lines(s, d).select("page_id", good.alias("good"), old.alias("old_path"), new.alias("new_path"))


@query("SELECT event_id, 1 + event_id % 9 AS old_start_line, CASE WHEN event_id % 2 = 0 THEN 1 ELSE event_id % 4 END AS old_line_count, 1 + event_id % 7 AS new_start_line, event_id % 3 AS new_line_count FROM events WHERE event_id % 11 <> 0")
def hunk_header(s, d):
    i = F.col("event_id")
    bad = F.when(i % 11 == 0, "@@ -x").otherwise(F.concat(F.lit("@@ -"), i % 9 + 1, F.when(i % 2 == 0, "").otherwise(F.concat(F.lit(","), i % 4)), F.lit(" +"), i % 7 + 1, F.lit(","), i % 3, F.lit(" @@ text")))
    h = fx.table(s, d, "events").select("event_id", diffs.hunk_header(bad).alias("h")).where("h is not null")
    return h.select("event_id", *[F.col(f"h.{c}").cast("long").alias(c) for c in ("old_start_line", "old_line_count", "new_start_line", "new_line_count")])


@query("SELECT diff_id, row_number() OVER (PARTITION BY diff_id ORDER BY event_id) AS file_index, CASE WHEN change_type = 'modified' THEN 5 ELSE 6 END AS lines FROM fx_hunks")
def diff_file_index(s, d):
    lines = diffs.diff_file_index(diffs.diff_lines(fx.diffs(s, d)))
    return lines.groupBy("diff_id", "file_index").agg(F.count("*").alias("lines"))


@query("SELECT event_type, op IS NULL AS no_old, np IS NULL AS no_new, CASE WHEN event_type = 'view' THEN 'added' WHEN op IS NULL AND np IS NOT NULL THEN 'added' WHEN np IS NULL AND op IS NOT NULL THEN 'deleted' ELSE 'modified' END AS change_type, count(*) AS n FROM (SELECT event_type, CASE WHEN event_id % 3 = 0 THEN 'a' END AS op, CASE WHEN event_id % 4 = 0 THEN 'b' END AS np FROM events) GROUP BY ALL")
def change_type(s, d):
    i = F.col("event_id")
    e = fx.table(s, d, "events").select("event_type", F.when(i % 3 == 0, "a").alias("op"), F.when(i % 4 == 0, "b").alias("np"))
    kind = diffs.change_type(F.when(F.col("event_type") == "view", "added"), F.col("op"), F.col("np"))
    return e.groupBy("event_type", F.col("op").isNull().alias("no_old"), F.col("np").isNull().alias("no_new"), kind.alias("change_type")).agg(F.count("*").alias("n"))


@query("SELECT diff_id, event_id, CASE WHEN change_type = 'deleted' THEN old_start || '+' || old_count ELSE new_start || '+' || new_count END AS ranges FROM fx_hunks")
def changed_line_ranges(s, d):
    f = fx.diff_files(s, d)
    r = diffs.changed_line_ranges(F.col("change_type"), F.col("hunks"))
    return f.select("diff_id", F.col("file_ordinal").alias("event_id"), _join(F.transform(r, lambda x: F.concat_ws("+", x.start_line, x.line_count))).alias("ranges"))


def _broken(s, d):
    """Texts of one file section each, some of which can't be read."""
    i = F.col("event_id")
    head = F.when(i % 6 == 0, "junk\ndiff --git a/x b/x\n").when(i % 6 == 1, "diff --git a/x b/x y\n").otherwise("diff --git a/x b/x\n")
    rest = F.when(i % 6 == 2, "--- \n+++ b/x\n").when(i % 6 == 3, "@@ -1 +x @@\n").when(i % 6 == 4, "--- /dev/null\n+++ /dev/null\n").otherwise("--- a/x\n+++ b/x\n@@ -1 +1 @@\n")
    return fx.table(s, d, "events").select(i.alias("diff_id"), F.concat(head, rest).alias("diff"))


@query("SELECT event_id AS diff_id, CASE event_id % 6 WHEN 0 THEN 'content_before_header' WHEN 1 THEN 'bad_header' WHEN 2 THEN 'missing_path' WHEN 3 THEN 'bad_hunk' ELSE 'no_target_path' END AS error, CASE event_id % 6 WHEN 0 THEN 'junk' WHEN 1 THEN 'diff --git a/x b/x y' WHEN 2 THEN '--- ' WHEN 3 THEN '@@ -1 +x @@' END AS line FROM events WHERE event_id % 6 <> 5")
def diff_errors(s, d):
    return diffs.diff_errors(_broken(s, d))


@query("SELECT diff_id, event_id, path, range_start, range_count FROM fx_ranges")
def hunk_ranges(s, d):
    return changed.ranges_of(fx.diff_files(s, d)).select("diff_id", F.col("file_ordinal").alias("event_id"), "path", F.col("range_start").cast("long").alias("range_start"), F.col("range_count").cast("long").alias("range_count"))


@query("SELECT diff_id, event_id, symbol_id, range_start, range_count FROM fx_overlaps")
def overlap_symbols(s, d):
    o = changed.overlap_symbols(changed.ranges_of(fx.diff_files(s, d)), fx.symbols(s, d))
    return o.select("diff_id", F.col("file_ordinal").alias("event_id"), "symbol_id", F.col("range_start").cast("long").alias("range_start"), F.col("range_count").cast("long").alias("range_count"))


def _changed(s, d):
    return changed.changed_symbols(changed.overlap_symbols(changed.ranges_of(fx.diff_files(s, d)), changed.seed_symbols(fx.symbols(s, d))))


_FIRST_RANGES = "(SELECT diff_id, symbol_id, range_start, range_count, min([event_id, k]) AS seen FROM fx_overlaps {} GROUP BY ALL)"
_SEEDS_ONLY = "WHERE kind NOT IN ('variable', 'import')"


@query(f"SELECT diff_id, symbol_id, string_agg(range_start || '+' || range_count, ',' ORDER BY seen) AS ranges FROM {_FIRST_RANGES.format('')} GROUP BY diff_id, symbol_id")
def merge_line_ranges(s, d):
    m = changed.changed_symbols(changed.overlap_symbols(changed.ranges_of(fx.diff_files(s, d)), fx.symbols(s, d)))
    return m.select("diff_id", "symbol_id", _join(F.transform("matched_line_ranges", lambda x: F.concat_ws("+", x.start_line, x.line_count))).alias("ranges"))


@query(f"SELECT diff_id, symbol_id, min(event_id) AS first_file, min(symbol_ordinal) AS symbol_ordinal FROM fx_overlaps {_SEEDS_ONLY} GROUP BY diff_id, symbol_id")
def changed_symbols(s, d):
    return _changed(s, d).select("diff_id", "symbol_id", F.col("seed_ordinal.file_ordinal").alias("first_file"), F.col("seed_ordinal.symbol_ordinal").alias("symbol_ordinal"))


@query("SELECT diff_id, path, max(event_id) AS file_ordinal, max_by(change_type, event_id) AS change_type FROM (SELECT diff_id, event_id, '/repo/' || path AS path, change_type FROM fx_hunks) GROUP BY diff_id, path")
def changed_files_last(s, d):
    return changed.changed_files_last(fx.diff_files(s, d)).select("diff_id", "path", "file_ordinal", "change_type")


def _renamed(s, d):
    """The file's own path is asked first, then another document's path."""
    f = fx.diff_files(s, d)
    return f.withColumn("old_path", F.regexp_replace("path", r"/d(\d)", "/d$1$1")).withColumn("new_path", F.lit(None).cast("string"))


@query("SELECT h.diff_id, h.event_id, coalesce(a.path, b.path) AS source_path FROM (SELECT *, '/repo/' || path AS p, regexp_replace('/repo/' || path, '/d(\\d)', '/d\\1\\1') AS q FROM fx_hunks) h LEFT JOIN fx_repo a ON a.path = h.p LEFT JOIN fx_repo b ON b.path = h.q")
def resolve_source_path(s, d):
    r = changed.resolve_source_path(_renamed(s, d), fx.repo_files(s, d))
    return r.select("diff_id", F.col("file_ordinal").alias("event_id"), "source_path")


@query("SELECT h.diff_id, h.event_id, CASE WHEN r.path IS NULL THEN 'source_missing' WHEN r.parse_error THEN 'parse_error' END AS status FROM fx_hunks h LEFT JOIN fx_repo r ON r.path = '/repo/' || h.path")
def changed_file_status(s, d):
    r = changed.resolve_source_path(fx.diff_files(s, d), fx.repo_files(s, d)).join(fx.repo_files(s, d).withColumnRenamed("path", "source_path"), "source_path", "left")
    status = changed.changed_file_status(F.col("source_path"), tx.language_of_path(F.col("source_path")), F.col("parse_error"))
    return r.select("diff_id", F.col("file_ordinal").alias("event_id"), status.alias("status"))


# --- exploration ------------------------------------------------------------------------------------------------------


def _paths(s, d, depth=2):
    return explore.paths(explore.known_seeds(fx.seeds(s, d), fx.nodes(s, d)), explore.adjacency(fx.edges(s, d)), depth)


def _digest(*texts):
    """A sum over rows that tells sets of texts apart; it needs no order and no list."""
    return F.sum(F.conv(F.substring(F.md5(F.concat_ws("|", *texts)), 1, 8), 16, 10).cast("long"))


def _path_rows(p, *keys):
    """How many paths each group has, and a digest of them all."""
    return p.groupBy(*keys).agg(F.count("*").alias("n"), _digest("seed_id", "terminal_node_id", _join("edge_ids"), _join("node_ids")).alias("digest"))


_DIGEST = "sum(('0x' || substr(md5({}), 1, 8))::BIGINT)::BIGINT"
_PATHS = "count(*) AS n, " + _DIGEST.format("concat_ws('|', seed_id, terminal_node_id, array_to_string(edge_ids, ','), array_to_string(node_ids, ','))") + " AS digest"


@query(f"SELECT seed_id, terminal_node_id, {_PATHS} FROM fx_one GROUP BY ALL")
def one_hop(s, d):
    return _path_rows(_paths(s, d, 1), "seed_id", "terminal_node_id")


@query(f"SELECT seed_id, edge_ids[1] AS first_edge, {_PATHS} FROM fx_two GROUP BY ALL")
def two_hop(s, d):
    return _path_rows(_paths(s, d).where("hop_count = 2").withColumn("first_edge", F.get("edge_ids", 0)), "seed_id", "first_edge")


@query(f"SELECT seed_id, edge_ids[1] AS first_edge, hop_count, {_PATHS} FROM fx_best GROUP BY ALL")
def best_paths(s, d):
    seeds, adj = explore.known_seeds(fx.seeds(s, d), fx.nodes(s, d)), explore.adjacency(stage(fx.edges(s, d), "edges"))
    return _path_rows(explore.nearest_paths(seeds, adj).withColumn("first_edge", F.get("edge_ids", 0)), "seed_id", "first_edge", "hop_count")


_ON = "(SELECT DISTINCT unnest(node_ids) AS id FROM fx_best)"


@query(f"SELECT 'node' AS what, n.id, n.path, n.start_line FROM fx_nodes n JOIN {_ON} o ON o.id = n.id UNION ALL SELECT 'node', n.id, n.path, 0 FROM fx_nodes n JOIN fx_seeds s ON s.id = n.id WHERE n.id NOT IN (SELECT id FROM {_ON}) UNION ALL SELECT 'edge', e.id, e.path, 0 FROM fx_edges e JOIN (SELECT DISTINCT unnest(edge_ids) AS id FROM fx_best) b ON b.id = e.id")
def explore_result(s, d):
    seeds, nodes, edges = fx.seeds(s, d), fx.nodes(s, d), stage(fx.edges(s, d), "edges")
    best = explore.nearest_paths(explore.known_seeds(seeds, nodes), explore.adjacency(edges))
    n = explore.explore_nodes(seeds, best, nodes).select(F.lit("node").alias("what"), "id", "path", "start_line")
    return n.unionAll(explore.explore_edges(best, edges).select(F.lit("edge").alias("what"), "id", "path", F.lit(0).cast("long").alias("start_line")))


# --- documents and search ---------------------------------------------------------------------------------------------


def _documents(s, d):
    return documents.callable_documents(fx.symbols(s, d))


@query("SELECT id, md5(document) AS document, path, language FROM fx_callable")
def document_text(s, d):
    return _documents(s, d).select("id", F.md5("document").alias("document"), "path", "language")


@query("SELECT id, md5(trim(CASE WHEN body = '' THEN code ELSE body END)) AS query_text FROM fx_symbols")
def query_text(s, d):
    return fx.symbols(s, d).select("id", F.md5(tx.query_text(F.col("body"), F.col("code"))).alias("query_text"))


@query("SELECT page_id, 'main-' || trim(regexp_replace(lower(url), '[^\\p{L}\\p{N}]+', '-', 'g'), '-') || '-code-impl' AS collection FROM pages")
def collection_name(s, d):
    return fx.table(s, d, "pages").select("page_id", tx.collection_name(F.lit("--Main "), F.col("url")).alias("collection"))


@query("SELECT doc_id, md5(array_to_string(list_transform(string_split(trim(text, ' ' || chr(10)), chr(10)), lambda x: trim(x)), chr(10))) AS code FROM documents")
def normalize_code(s, d):
    return fx.table(s, d, "documents").select("doc_id", F.md5(tx.normalize_code(F.col("text"))).alias("code"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{}' WHEN 1 THEN '{\"is_static\": true}' ELSE '{\"a\": false, \"is_static\": true}' END AS metadata FROM events")
def metadata_json(s, d):
    i = F.col("event_id")
    m = F.when(i % 3 == 0, F.create_map().cast("map<string,boolean>")).when(i % 3 == 1, F.create_map(F.lit("is_static"), F.lit(True))).otherwise(F.create_map(F.lit("is_static"), F.lit(True), F.lit("a"), F.lit(False)))
    return fx.table(s, d, "events").select("event_id", tx.metadata_json(m).alias("metadata"))


@query("SELECT page_id, '/repo/src/' || CASE page_id % 3 WHEN 0 THEN 'm' || page_id WHEN 1 THEN 'x/m' || page_id ELSE 'm' || page_id END || '.py' AS path FROM pages")
def storage_path(s, d):
    i = F.col("page_id")
    p = F.when(i % 3 == 0, F.concat(F.lit("./src/../src/m"), i)).when(i % 3 == 1, F.concat(F.lit("src\\x\\m"), i)).otherwise(F.concat(F.lit("lib/../src//m"), i))
    return fx.table(s, d, "pages").select("page_id", tx.storage_path(F.lit("/repo/"), F.concat(p, F.lit(".py"))).alias("path"))


@query("SELECT id FROM fx_symbols")
def symbol_id(s, d):
    return fx.symbols(s, d).select(tx.symbol_id(F.col("kind"), F.col("path"), F.col("qualified_name"), F.col("start_line")).alias("id"))


@query("SELECT id, CASE WHEN parent_name IS NULL THEN name ELSE parent_name || '.' || name END AS full_name FROM fx_symbols")
def qualified_name(s, d):
    return fx.symbols(s, d).select("id", tx.qualified_name(F.col("name"), F.col("parent_name")).alias("full_name"))


def _hits(s, d):
    v = fx.vectors(s, d)
    q = v.where("is_query").select(F.col("id").alias("query_id"), "language", "embedding")
    return documents.similar(q, v.select("id", "language", "embedding"), 5)


@query("SELECT query_id, id, rank FROM (SELECT q.id AS query_id, v.id, row_number() OVER (PARTITION BY q.id ORDER BY list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), v.id) AS rank FROM fx_vectors q JOIN fx_vectors v ON v.language = q.language WHERE q.is_query) WHERE rank <= 5")
def similar_code(s, d):
    return _hits(s, d).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


# --- packages ---------------------------------------------------------------------------------------------------------


@query(f"SELECT o.diff_id, o.symbol_id, s.path, s.start_line, md5(trim(s.code)) AS code FROM (SELECT DISTINCT diff_id, symbol_id FROM fx_overlaps {_SEEDS_ONLY}) o JOIN fx_symbols s ON s.id = o.symbol_id WHERE trim(s.code) <> ''")
def modified_code(s, d):
    return changed.modified_code(_changed(s, d), fx.symbols(s, d)).select("diff_id", "symbol_id", "path", "start_line", F.md5("code").alias("code"))


def _graph_nodes(s, d):
    """Nodes of each diff: all symbols of its files, some with another id or other lines."""
    f = fx.diff_files(s, d).select("diff_id", "path").distinct()
    n = fx.symbols(s, d).join(f, "path")
    o = F.col("ordinal")
    return n.select("diff_id", F.when(o % 2 == 0, F.col("id")).otherwise(F.concat(F.lit("x:"), "id")).alias("id"), "path", "qualified_name", F.when(o % 3 == 0, o + 1000).otherwise(F.col("start_line")).alias("start_line"), "end_line")


_NODES = "(SELECT f.diff_id, CASE WHEN ordinal % 2 = 0 THEN id ELSE 'x:' || id END AS id, s.path, qualified_name, CASE WHEN ordinal % 3 = 0 THEN ordinal + 1000 ELSE start_line END AS start_line, end_line FROM fx_symbols s JOIN (SELECT DISTINCT diff_id, '/repo/' || path AS path FROM fx_hunks) f ON f.path = s.path)"
_MATCHED = f"(SELECT n.*, s.id AS symbol_id, s.code, row_number() OVER (PARTITION BY n.diff_id, n.id ORDER BY CASE WHEN s.id = n.id THEN 0 WHEN s.start_line = n.start_line AND s.end_line = n.end_line THEN 1 ELSE 2 END, s.ordinal) AS mn FROM {_NODES} n JOIN fx_symbols s ON s.path = n.path AND (s.id = n.id OR s.qualified_name = n.qualified_name))"
_CHANGED_IDS = f"(SELECT DISTINCT diff_id, symbol_id AS id FROM fx_overlaps {_SEEDS_ONLY})"


@query(f"SELECT diff_id, id, symbol_id FROM {_MATCHED} WHERE mn = 1")
def match_node_symbol(s, d):
    return package.match_node_symbol(_graph_nodes(s, d), fx.symbols(s, d)).select("diff_id", "id", F.col("symbol.id").alias("symbol_id"))


_TOP10 = f"(SELECT diff_id, symbol_id, trim(code) AS code, row_number() OVER (PARTITION BY diff_id ORDER BY path, start_line, end_line, qualified_name, id) AS place FROM {_MATCHED} m WHERE mn = 1 AND trim(code) <> '' AND NOT EXISTS (SELECT 1 FROM {_CHANGED_IDS} c WHERE c.diff_id = m.diff_id AND c.id = m.id))"


def _graph(s, d):
    return package.graph_neighbors(_graph_nodes(s, d), _changed(s, d), fx.symbols(s, d))


@query(f"SELECT diff_id, place, symbol_id, md5(code) AS code FROM {_TOP10} WHERE place <= 10")
def graph_neighbors_top10(s, d):
    return _graph(s, d).select("diff_id", F.col("place").cast("long").alias("place"), "symbol_id", F.md5("code").alias("code"))


def _vector_tables(s, d):
    """Hits of the vectors as hits of diffs: a query is a seed of three diffs, a vector is a document with a symbol."""
    v = fx.vectors(s, d)
    k = F.substring("id", 2, 8).cast("long")
    docs = v.select("id", F.when(k % 9 == 0, " ").otherwise(F.concat(F.lit("doc "), k % 40)).alias("document"), F.concat(F.lit("sym"), k % 60).alias("symbol_id"), F.lit("function").alias("symbol_kind"), F.when(k % 7 == 0, "rust").otherwise(F.col("language")).alias("language"), F.lit("p").alias("path"), F.concat(F.lit("q"), k % 30).alias("qualified_name"), k.alias("start_line"), k.alias("end_line"))
    seeds = v.where("is_query").select(F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"), "*").select(((k / 100).cast("long") % 4 + F.col("i")).alias("diff_id"), k.alias("seed_ordinal"), F.col("id").alias("query_id"), "language")
    changed_ids = s.range(6).select(F.col("id").alias("diff_id"), F.concat(F.lit("sym"), F.col("id") * 3).alias("symbol_id"))
    return _hits(s, d), seeds, changed_ids, docs


_RANKS = "(SELECT q.id AS query_id, substr(q.id, 2, 8)::BIGINT AS qk, q.language AS qlang, substr(v.id, 2, 8)::BIGINT AS k, v.language, row_number() OVER (PARTITION BY q.id ORDER BY list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), v.id) AS rank FROM fx_vectors q JOIN fx_vectors v ON v.language = q.language WHERE q.is_query)"
_VHITS = f"(SELECT (qk // 100) % 4 + i AS diff_id, 'sym' || (k % 60) AS symbol_id, qk, rank, 'doc ' || (k % 40) AS code, 'q' || (k % 30) AS qualified_name, k FROM {_RANKS} r, (SELECT unnest([0, 1, 2]) AS i) t WHERE rank <= 5 AND k % 9 <> 0 AND k % 7 <> 0)"
_VFIRST = f"(SELECT *, row_number() OVER (PARTITION BY diff_id ORDER BY qk, rank) AS place FROM (SELECT *, row_number() OVER (PARTITION BY diff_id, symbol_id ORDER BY qk, rank) AS f FROM {_VHITS} WHERE diff_id >= 6 OR symbol_id <> 'sym' || (diff_id * 3)) WHERE f = 1)"


@query(f"SELECT diff_id, symbol_id, place FROM {_VFIRST} WHERE place <= 5")
def vector_neighbors_top5(s, d):
    return package.vector_neighbors(*_vector_tables(s, d)).select("diff_id", "symbol_id", F.col("place").cast("long").alias("place"))


@query(
    f"SELECT diff_id, source, symbol_id FROM (SELECT *, row_number() OVER (PARTITION BY diff_id, qualified_name, code ORDER BY source, place) AS rn FROM (SELECT 'graph' AS source, t.diff_id, t.symbol_id, s.qualified_name, t.code, t.place FROM {_TOP10} t JOIN fx_symbols s ON s.id = t.symbol_id WHERE place <= 10 UNION ALL SELECT 'vector', diff_id, symbol_id, qualified_name, code, place FROM {_VFIRST} WHERE place <= 5)) WHERE rn = 1"
)
def neighbor_code(s, d):
    return package.neighbor_code(_graph(s, d), package.vector_neighbors(*_vector_tables(s, d))).select("diff_id", "source", "symbol_id")


# --- updates ----------------------------------------------------------------------------------------------------------


def _changes(s, d):
    return update.classify_changes(fx.diff_files(s, d), fx.repo_files(s, d))


@query("SELECT diff_id, file_ordinal, path, status FROM fx_changes")
def classify_changes(s, d):
    return _changes(s, d).select("diff_id", "file_ordinal", "path", "status")


_LANG = "CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.java' THEN 'java' WHEN path LIKE '%.c' THEN 'c' ELSE 'cpp' END"


@query(f"SELECT language, string_agg(path, ',' ORDER BY path) AS paths FROM (SELECT DISTINCT path, {_LANG} AS language FROM fx_changes WHERE status <> 'parse_error') GROUP BY language")
def paths_by_language(s, d):
    return update.paths_by_language(_changes(s, d)).select("language", _join("paths").alias("paths"))


@query("SELECT DISTINCT path FROM fx_changes WHERE status IN ('deleted', 'analysed')")
def paths_to_replace(s, d):
    return update.paths_to_replace(_changes(s, d))


def _graph_tables(s, d):
    """A graph of the files' symbols, and new rows for the changed files: their symbols of even lines."""
    cols = ["id", "kind", "path", "qualified_name", "ordinal"]
    n = stage(fx.all_symbols(s, d).select(*cols, "parent_name", "start_line"), "nodes")
    e = relations.contains_edges(n).select("id", "kind", "path", "source_id", "destination_id", F.col("ordinal.at").alias("ordinal"))
    n, e = n.select(*cols), stage(store.dedupe_first(e), "edges")
    last = stage(update.last_per_path(_changes(s, d)), "last")
    gone, fresh = update.paths_to_replace(last), last.where("status = 'analysed'").select("path")
    new_nodes = n.where("ordinal % 2 = 0").join(fresh, "path", "left_semi")
    new_edges = e.where("ordinal % 2 = 0").join(fresh, "path", "left_semi")
    return n, e, gone, new_nodes, new_edges


_E = "(SELECT id, path, min(ordinal) AS ordinal, arg_min(source_id, ordinal) AS source_id, arg_min(destination_id, ordinal) AS destination_id FROM fx_contains GROUP BY id, path)"
_NEWN = "(SELECT a.id, a.path FROM fx_all a LEFT JOIN fx_last l ON l.path = a.path WHERE l.status IS NULL OR l.status NOT IN ('deleted', 'analysed') OR (l.status = 'analysed' AND a.ordinal % 2 = 0))"


@query(f"SELECT 'node' AS what, id FROM {_NEWN} UNION ALL SELECT 'edge', e.id FROM {_E} e LEFT JOIN fx_last l ON l.path = e.path WHERE (l.status IS NULL OR l.status NOT IN ('deleted', 'analysed')) OR (l.status = 'analysed' AND e.ordinal % 2 = 0 AND e.source_id IN (SELECT id FROM {_NEWN}) AND e.destination_id IN (SELECT id FROM {_NEWN}))")
def replace_graph_by_path(s, d):
    n, e = update.replace_graph(*_graph_tables(s, d))
    return n.select(F.lit("node").alias("what"), "id").unionAll(e.select(F.lit("edge").alias("what"), "id"))


@query("SELECT c.id FROM fx_callable c LEFT JOIN fx_last l ON l.path = c.path WHERE l.status IS NULL OR l.status = 'parse_error' OR (l.status = 'analysed' AND c.ordinal % 2 = 0)")
def replace_documents_by_path(s, d):
    last = update.last_per_path(_changes(s, d))
    new = _documents(s, d).where("start_line % 2 = 0").join(last.where("status = 'analysed'").select("path"), "path", "left_semi").select(*_documents(s, d).columns)
    return update.replace_documents(_documents(s, d), last, new).select("id")


_FRESH = "(SELECT a.id FROM fx_all a JOIN fx_last l ON l.path = a.path WHERE l.status = 'analysed' AND a.ordinal % 2 = 0)"


@query(f"SELECT (SELECT count(*) FROM fx_changes) AS changed_files, (SELECT count(*) FROM {_FRESH}) AS updated_nodes, (SELECT count(*) FROM {_E} e JOIN fx_last l ON l.path = e.path WHERE l.status = 'analysed' AND e.ordinal % 2 = 0 AND e.source_id IN (SELECT id FROM {_FRESH}) AND e.destination_id IN (SELECT id FROM {_FRESH})) AS updated_edges, (SELECT count(*) FROM fx_callable c JOIN fx_last l ON l.path = c.path WHERE l.status = 'analysed' AND c.ordinal % 2 = 0) AS reindexed_embeddings, 'ok' AS status")
def update_summary(s, d):
    *_, new_nodes, new_edges = _graph_tables(s, d)
    new = _documents(s, d).where("start_line % 2 = 0").join(update.last_per_path(_changes(s, d)).where("status = 'analysed'").select("path"), "path", "left_semi")
    return update.update_summary(_changes(s, d), new_nodes, index.accepted_edges(new_edges, new_nodes), new)


# --- syntax nodes to symbols ------------------------------------------------------------------------------------------


@query("SELECT path, 'function_definition' AS type, name, line FROM (SELECT path, 'f' || n AS name, line FROM fx_src WHERE n % 3 = 1 UNION ALL SELECT path, 'm', line + 3 FROM fx_src WHERE n % 3 = 2) UNION ALL SELECT path, 'class_definition', 'C' || n, line FROM fx_src WHERE n % 3 = 2 UNION ALL SELECT path, 'call', 'g', line + 2 FROM fx_src WHERE n % 3 = 1 UNION ALL SELECT path, 'call', 'f' || greatest(n - 3, 0), line + 3 FROM fx_src WHERE n % 3 = 1 UNION ALL SELECT path, 'assignment', string_split(qn, '.')[-1], line FROM fx_py WHERE kind = 'variable' UNION ALL SELECT path, 'return_statement', NULL, line + CASE n % 3 WHEN 1 THEN 3 ELSE 5 END FROM fx_src WHERE n % 3 > 0 UNION ALL SELECT DISTINCT path, 'module', NULL, 1 FROM fx_src")
def python_syntax_nodes(s, d):
    n = syntax.python_syntax_nodes(fx.sources(s, d)).where("type in ('module', 'function_definition', 'class_definition', 'call', 'assignment', 'return_statement')")
    return n.select("path", "type", "name", F.col("start_line").cast("long").alias("line"))


@query("SELECT 'symbol' AS what, kind || ':' || path || ':' || qn || ':' || line AS id, last FROM fx_lenient UNION ALL SELECT DISTINCT 'strict', path, 0 FROM fx_src WHERE n = 5")
def lenient_symbols(s, d):
    """Symbols of files with errors: what is valid alone has its own, with its lines; the strict parser leaves such files out."""
    files = fx.sources(s, d, broken=True)
    x = symbols.extract_symbols(syntax.python_syntax_nodes(files, lenient=True)).where("kind <> 'file'")
    strict = syntax.python_syntax_nodes(files).where("parse_error")
    return x.select(F.lit("symbol").alias("what"), "id", F.col("end_line").cast("long").alias("last")).unionAll(strict.select(F.lit("strict"), "path", F.lit(0).cast("long")))


@query("SELECT 'file:/repo/' || rel || ':/repo/' || rel || ':1' AS id, string_split(rel, '/')[-1] AS name, '/repo/' || rel AS signature FROM fx_docs WHERE language <> 'python'")
def file_symbol(s, d):
    out = None
    for language in fx.NODE_RULES:
        f = symbols.file_symbols(fx.syntax_nodes(s, d, language)).select("id", "name", "signature")
        out = f if out is None else out.unionAll(f)
    return out


@query("SELECT kind || ':' || path || ':' || qn || ':' || line AS id, parent AS parent_name, CASE kind WHEN 'function' THEN 'def ' || qn || '(a, b=1)' WHEN 'class' THEN 'class ' || qn WHEN 'method' THEN 'def m(self)' ELSE string_split(qn, '.')[-1] || ' = ...' END AS signature FROM fx_py")
def python_symbols(s, d):
    x = symbols.extract_symbols(syntax.python_syntax_nodes(fx.sources(s, d))).where("kind <> 'file'")
    return x.select("id", "parent_name", "signature")


def _expected(language, cases):
    """SQL: kind, qualified name and parent of the nodes by n % 5."""
    kind = " ".join(f"WHEN {i} THEN '{k}'" for i, (k, _) in cases.items())
    parent = " ".join(f"WHEN {i} THEN {p}" for i, (_, p) in cases.items())
    return f"SELECT kind || ':' || path || ':' || CASE WHEN parent_name IS NULL THEN '' ELSE parent_name || '.' END || 'x' || n || ':' || n AS id, parent_name FROM (SELECT '/repo/' || rel AS path, n, CASE n % 5 {kind} END AS kind, CASE n % 5 {parent} END AS parent_name FROM fx_lines WHERE language = '{language}') WHERE kind IS NOT NULL"


def _extracted(s, d, language):
    return symbols.extract_symbols(fx.syntax_nodes(s, d, language)).where("kind <> 'file'").select("id", "parent_name")


_ONE, _UP = "'x' || (n - 1)", "'x' || (n - 2) || '.x' || (n - 1)"


@query(_expected("java", {0: ("import", "NULL"), 1: ("class", "NULL"), 2: ("method", _ONE), 3: ("variable", _UP)}))
def java_symbols(s, d):
    return _extracted(s, d, "java")


@query(_expected("c", {0: ("function", "NULL"), 1: ("variable", "NULL"), 2: ("struct", "NULL"), 3: ("variable", _ONE)}))
def c_symbols(s, d):
    return _extracted(s, d, "c")


@query(_expected("cpp", {0: ("namespace", "NULL"), 1: ("class", _ONE), 2: ("method", _UP), 3: ("function", "NULL")}) + " UNION ALL SELECT 'import:/repo/' || rel || ':x' || n || ':' || n, NULL FROM fx_lines WHERE language = 'cpp' AND n % 5 = 4")
def cpp_symbols(s, d):
    return _extracted(s, d, "cpp")


_TEXT = "('head ' || n || ' {body}')"


@query(f"SELECT 'function:/repo/' || rel || ':x' || n || ':' || n AS id, trim({_TEXT}[1:len({_TEXT}) // 2]) AS signature, {_TEXT} AS code, {_TEXT}[len({_TEXT}) // 2 + 1:] AS body FROM fx_lines WHERE language = 'c' AND n % 5 = 0")
def signature_code_body(s, d):
    return symbols.extract_symbols(fx.syntax_nodes(s, d, "c")).where("kind = 'function'").select("id", "signature", "code", "body")


@query("SELECT 'class:/repo/' || rel || ':x' || n || ':' || n AS id, 't0 ' || n AS super_types, '' AS parameters FROM fx_lines WHERE language = 'java' AND n % 5 = 1 UNION ALL SELECT 'method:/repo/' || rel || ':x' || (n - 1) || '.x' || n || ':' || n, 't0 ' || n, 't0 ' || n || ',t1 ' || n FROM fx_lines WHERE language = 'java' AND n % 5 = 2")
def parameters_super_types(s, d):
    x = symbols.extract_symbols(fx.syntax_nodes(s, d, "java")).where("kind in ('class', 'method')")
    # The fixture puts a parameter and a base below every node; a class has no parameters to the library either way.
    return x.select("id", _join("super_types").alias("super_types"), F.when(F.col("kind") == "method", _join("parameters")).otherwise("").alias("parameters"))


@query("SELECT path, mode, name, line FROM fx_refs WHERE name <> 'k0' UNION ALL SELECT path, 'reads', 'k0', line FROM fx_src WHERE n = 3")
def reference_names(s, d):
    r = symbols.reference_names(syntax.python_syntax_nodes(fx.sources(s, d)))
    return r.select("path", "mode", "name", F.col("start_line").cast("long").alias("line"))


# --- whole jobs -------------------------------------------------------------------------------------------------------


def _rows(what, df):
    return df.select(F.lit(what).alias("what"), "id")


@query("SELECT what, id FROM fx_pyrows UNION ALL SELECT 'counts', 'scanned ' || (SELECT count(DISTINCT path) FROM fx_src) || ' skipped 0 nodes ' || count(*) FILTER (what = 'node') || ' edges ' || count(*) FILTER (what = 'edge') || ' documents ' || count(*) FILTER (what = 'document') || ' mismatch none' FROM fx_pyrows")
def initial_index(s, d):
    """The ids of all rows that are read back, and the counts, for two repositories with the same relative paths."""
    f, path = fx.sources(s, d), shared_path(s, "index")
    row = index.initial_index(f.select("path", F.lit(None).cast("string").alias("skip_reason")), syntax.python_syntax_nodes(f), path)
    counts = F.concat_ws(" ", F.lit("scanned"), "scanned_files", F.lit("skipped"), "skipped_files", F.lit("nodes"), "verified_nodes", F.lit("edges"), "verified_edges", F.lit("documents"), "verified_documents", F.lit("mismatch"), F.coalesce("mismatch", F.lit("none")))
    out = _rows("counts", row.select(counts.alias("id")))
    for what in ("node", "edge", "document"):
        out = out.unionAll(_rows(what, s.read.schema("id string").parquet(f"{path}/{what}s")))
    return out


_TOUCHED = f"(SELECT DISTINCT o.diff_id, o.symbol_id FROM fx_overlaps o JOIN fx_repo r ON r.path = o.path AND NOT r.parse_error {_SEEDS_ONLY})"


@query(f"SELECT diff_id, 'symbol' AS what, symbol_id AS name, NULL AS reason FROM {_TOUCHED} UNION ALL SELECT diff_id, 'file', path, CASE max_by(status, file_ordinal) WHEN 'missing_file' THEN 'source_missing' WHEN 'parse_error' THEN 'parse_error' END FROM (SELECT h.diff_id, h.event_id AS file_ordinal, '/repo/' || h.path AS path, CASE WHEN r.path IS NULL THEN 'missing_file' WHEN r.parse_error THEN 'parse_error' ELSE 'ok' END AS status FROM fx_hunks h LEFT JOIN fx_repo r ON r.path = '/repo/' || h.path) GROUP BY diff_id, path")
def changed_code_context(s, d):
    f, seeds = context.changed_code_context(fx.diff_files(s, d), fx.repo_files(s, d), fx.symbols(s, d))
    return seeds.select("diff_id", F.lit("symbol").alias("what"), F.col("symbol_id").alias("name"), F.lit(None).cast("string").alias("reason")).unionAll(f.select("diff_id", F.lit("file"), "path", "skip_reason"))


@query(
    "SELECT DISTINCT r.diff_id, s.kind || ':' || s.path || ':' || s.qn || ':' || s.line AS name, 'symbol' AS state FROM fx_pyranges r JOIN fx_lenient s ON s.path = r.path AND s.kind <> 'variable' AND s.line <= r.b AND s.last >= r.a UNION ALL SELECT DISTINCT diff_id, path, CASE WHEN doc_id % 10 = 3 THEN 'source_missing' ELSE 'python, loaded, ranges ' || max_by(CASE WHEN event_type = 'error' THEN h.old_start || '+' || h.old_count ELSE h.new_start || '+' || h.new_count END, h.event_id) END FROM fx_pyhunks h JOIN events e ON e.event_id = h.event_id GROUP BY diff_id, path, doc_id"
)
def lenient_changed_symbols(s, d):
    """Diffs of files that hold errors now: the files that are named are read as they are, and give the symbols that hunks touch."""
    changes = stage(_source_changes(fx.source_diffs(s, d)), "diffs")
    there = fx.sources(s, d, broken=True).where("pmod(2 * cast(regexp_extract(path, 'm([0-9]+)[.]', 1) as long) + if(repo_id = 'repo', 0, 1), 10) <> 3")
    f, seeds = context.changed_code_context(changes, *context.read_sources(context.named_paths(changes), there))
    r = F.get("changed_line_ranges", F.lit(0))
    state = F.coalesce("skip_reason", F.concat("language", F.when(F.col("source_loaded"), ", loaded, ranges "), r.start_line, F.lit("+"), r.line_count))
    return seeds.select("diff_id", F.col("symbol_id").alias("name"), F.lit("symbol").alias("state")).unionAll(f.select("diff_id", "path", state))


def _package(s, d):
    sym = stage(fx.all_symbols(s, d), "symbols")
    plain = sym.where("kind <> 'file'")
    e = stage(store.dedupe_first(relations.contains_edges(sym)).drop("ordinal", "metadata"), "edges")
    docs = stage(documents.callable_documents(plain), "documents")
    v = fx.vectors(s, d).select(F.substring("id", 2, 8).cast("long").alias("k"), "embedding")
    k = F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long") % max(v.count(), 1)
    placed = lambda df: df.select("id", k.alias("k")).join(v, "k").select("id", "embedding")
    return context.context_package(stage(fx.diff_files(s, d), "diffs"), fx.repo_files(s, d), plain, sym, e, docs, stage(placed(plain), "vectors"))


_ADJ = f"(SELECT source_id AS here, destination_id AS there, id FROM {_E} UNION ALL SELECT destination_id, source_id, id FROM {_E} WHERE source_id <> destination_id)"


_WALK = f"(SELECT DISTINCT diff_id, symbol_id, there FROM (SELECT t.diff_id, t.symbol_id, a.there FROM {_TOUCHED} t JOIN {_ADJ} a ON a.here = t.symbol_id UNION ALL SELECT t.diff_id, t.symbol_id, b.there FROM {_TOUCHED} t JOIN {_ADJ} a ON a.here = t.symbol_id JOIN {_ADJ} b ON b.here = a.there AND b.id <> a.id) WHERE there <> symbol_id)"
_OTHER = f"NOT EXISTS (SELECT 1 FROM {_TOUCHED} t WHERE t.diff_id = a.diff_id AND t.symbol_id = a.id)"
_P_GRAPH = f"(SELECT a.diff_id, s.id AS symbol_id, s.qualified_name, trim(s.code) AS code, row_number() OVER (PARTITION BY a.diff_id ORDER BY s.path, s.start_line, s.end_line, s.qualified_name, s.id) AS place FROM (SELECT DISTINCT diff_id, there AS id FROM {_WALK}) a JOIN fx_symbols s ON s.id = a.id WHERE trim(s.code) <> '' AND {_OTHER})"
_KEY = "('0x' || substr(md5(id), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings) AS k"
_DIST = "(SELECT a.vec_id AS qk, b.vec_id AS k, list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist FROM embeddings a, embeddings b)"
_P_HITS = f"(SELECT x.qk, d.language, d.id, row_number() OVER (PARTITION BY x.qk, d.language ORDER BY x.dist, d.id) AS rank FROM {_DIST} x JOIN (SELECT id, language, {_KEY} FROM fx_callable) d ON d.k = x.k)"
_P_SEEDS = f"(SELECT o.diff_id, o.symbol_id, any_value(s.language) AS language, any_value(s.k) AS k, min([o.event_id, o.symbol_ordinal]) AS seen FROM fx_overlaps o JOIN fx_repo r ON r.path = o.path AND NOT r.parse_error JOIN (SELECT id, language, {_KEY} FROM fx_symbols WHERE trim(code) <> '') s ON s.id = o.symbol_id {_SEEDS_ONLY} GROUP BY o.diff_id, o.symbol_id)"
_P_FIRST = f"(SELECT a.diff_id, a.id, min([a.seen[1], a.seen[2], a.rank]) AS seen FROM (SELECT q.diff_id, q.seen, h.id, h.rank FROM {_P_SEEDS} q JOIN {_P_HITS} h ON h.qk = q.k AND h.language = q.language AND h.rank <= 5) a WHERE {_OTHER} GROUP BY a.diff_id, a.id)"
_P_VECTOR = f"(SELECT f.diff_id, f.id AS symbol_id, c.qualified_name, trim(c.document) AS code, row_number() OVER (PARTITION BY f.diff_id ORDER BY f.seen, f.id) AS place FROM {_P_FIRST} f JOIN fx_callable c ON c.id = f.id)"
_PLAIN = "array_to_string(list_transform(string_split(trim(code, ' ' || chr(10)), chr(10)), lambda x: trim(x)), chr(10))"
_P_NEAR = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY diff_id, qualified_name, {_PLAIN} ORDER BY source, place) AS rn FROM (SELECT *, 'graph' AS source FROM {_P_GRAPH} WHERE place <= 10 UNION ALL SELECT *, 'vector' FROM {_P_VECTOR} WHERE place <= 5)) WHERE rn = 1)"


@query(
    f"SELECT f.diff_id, f.n AS changed_files, coalesce(t.n, 0) AS changed_symbols, coalesce(t.m, 0) AS modified_code, coalesce(p.n, 0) AS graph_paths, coalesce(c.n, 0) AS neighbor_code, coalesce(c.digest, 0) AS neighbors FROM (SELECT diff_id, count(DISTINCT path) AS n FROM fx_hunks GROUP BY diff_id) f LEFT JOIN (SELECT diff_id, count(*) AS n, count(*) FILTER (trim(s.code) <> '') AS m FROM {_TOUCHED} x JOIN fx_symbols s ON s.id = x.symbol_id GROUP BY diff_id) t ON t.diff_id = f.diff_id LEFT JOIN (SELECT diff_id, count(*) AS n FROM {_WALK} GROUP BY diff_id) p ON p.diff_id = f.diff_id LEFT JOIN (SELECT diff_id, count(*) AS n, {_DIGEST.format("concat_ws('|', source, symbol_id)")} AS digest FROM {_P_NEAR} GROUP BY diff_id) c ON c.diff_id = f.diff_id"
)
def context_package(s, d):
    """Sizes of the packages' parts, and which neighbours each has from which source."""
    p = _package(s, d)
    mark = F.transform("neighbor_code", lambda x: F.conv(F.substring(F.md5(F.concat_ws("|", x.source, x.symbol_id)), 1, 8), 16, 10).cast("long"))
    sizes = [F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long").alias(c) for c in ("changed_files", "changed_symbols", "modified_code", "graph_paths", "neighbor_code")]
    return p.select("diff_id", *sizes, F.coalesce(F.aggregate(mark, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).alias("neighbors"))


@query()
def context_package_json(s, d):
    """The whole packages as JSON, for the command line and as the flagship query."""
    p = _package(s, d)
    return p.select("diff_id", F.to_json(F.struct(*[c for c in p.columns if c != "diff_id"])).alias("package"))


def _index(s, d):
    """Symbols, storable relations and documents of the source files, written once."""
    found, edges = index.analyse(stage(syntax.python_syntax_nodes(fx.sources(s, d)), "syntax"))
    return found, index.accepted_edges(edges, found).withColumn("ordinal", F.col("ordinal.at")), documents.callable_documents(found)


def _source_changes(diffs_):
    return incremental.stored_paths(diffs.parse_diffs(diffs_), fx.source_root())


_AFTER = "SELECT what, id FROM fx_pyafter"


@query(f"{_AFTER} UNION ALL SELECT 'summary', 'changed ' || (SELECT count(*) FROM fx_pychanges) || ' nodes ' || count(*) FILTER (what = 'node') || ' edges ' || count(*) FILTER (what = 'edge') || ' documents ' || count(*) FILTER (what = 'document') || ' ok' FROM fx_pyafter WHERE status = 'analysed'")
def incremental_update(s, d):
    """Diffs of two repositories with the files after them: the changed files are analysed again, all ids are compared."""
    out = incremental.incremental_update(_source_changes(fx.source_diffs(s, d)), fx.sources(s, d, after=True), *_index(s, d))
    row = out["summary"].select(F.concat_ws(" ", F.lit("changed"), "changed_files", F.lit("nodes"), "updated_nodes", F.lit("edges"), "updated_edges", F.lit("documents"), "reindexed_embeddings", "status").alias("id"))
    return _rows("node", out["nodes"]).unionAll(_rows("edge", out["edges"])).unionAll(_rows("document", out["documents"])).unionAll(_rows("summary", row))


def _diffs_written(s, d, diffs_=None):
    path = shared_path(s, "diffs")
    (diffs_ or fx.diffs(s, d)).select(F.lpad(F.col("diff_id").cast("string"), 8, "0").alias("diff_id"), "diff").write.partitionBy("diff_id").text(path)
    return path


_SECTION = "'diff --git a/' || path || ' b/' || path || chr(10) || CASE change_type WHEN 'added' THEN 'new file mode 100644' || chr(10) WHEN 'deleted' THEN 'deleted file mode 100644' || chr(10) ELSE '' END || '--- ' || CASE change_type WHEN 'added' THEN '/dev/null' ELSE 'a/' || path END || chr(10) || '+++ ' || CASE change_type WHEN 'deleted' THEN '/dev/null' ELSE 'b/' || path END || chr(10) || '@@ -' || old_start || ',' || old_count || ' +' || new_start || ',' || new_count || ' @@' || chr(10) || ' x' || chr(10)"


@query(f"SELECT diff_id, md5(string_agg({_SECTION}, '' ORDER BY event_id) || chr(10)) AS diff FROM fx_hunks GROUP BY diff_id")
def read_diffs(s, d):
    r = scan.read_diffs(s, _diffs_written(s, d))
    return r.select(F.col("diff_id").cast("long").alias("diff_id"), F.md5("diff").alias("diff"))


@query("SELECT diff_id, row_number() OVER (PARTITION BY diff_id ORDER BY event_id) - 1 AS file_ordinal, path, change_type, new_start FROM fx_hunks")
def read_diff_sections(s, d):
    """The diffs are read in ranges of some hundred bytes, whose sections are parsed and numbered through each diff."""
    f = diffs.parse_diffs(scan.read_diff_sections(s, _diffs_written(s, d), split_bytes=700))
    return f.select(F.col("diff_id").cast("long").alias("diff_id"), F.col("file_ordinal").cast("long").alias("file_ordinal"), "path", "change_type", F.get("hunks", F.lit(0)).new_start_line.cast("long").alias("new_start"))


@query(_AFTER)
def stream_incremental_update(s, d):
    """The same diffs arrive as files, in two batches; the store's tables are as after a batch update."""
    store_ = sinks.Store(s, shared_path(s, "store"), buckets=16).create(*_index(s, d))
    diffs_ = stage(fx.source_diffs(s, d), "texts")
    updates.stream_incremental_update(s, _diffs_written(s, d, diffs_), shared_path(s, "stream"), store_, lambda: fx.sources(s, d, after=True), fx.source_root(), max_files=1 + diffs_.count() // 2, arrival=F.col("diff_id").cast("long"))
    return _rows("node", store_.read("nodes")).unionAll(_rows("edge", store_.read("edges"))).unionAll(_rows("document", store_.read("documents")))


@query("SELECT 'nodes' AS what, path, count(*) AS n FROM fx_nodes GROUP BY path UNION ALL SELECT 'edges', path, count(*) FROM fx_edges GROUP BY path")
def write_graph(s, d):
    path = shared_path(s, "graph")
    sinks.write_graph(fx.nodes(s, d), fx.edges(s, d), path)
    count = lambda name: s.read.parquet(f"{path}/{name}").groupBy(F.lit(name).alias("what"), "path").agg(F.count("*").alias("n"))
    return count("nodes").unionAll(count("edges"))


@query("SELECT 'codegraph-' || language || '-code-impl' AS collection, count(*) AS n FROM fx_callable GROUP BY language")
def write_documents(s, d):
    path = shared_path(s, "documents")
    sinks.write_documents(_documents(s, d), path)
    return s.read.parquet(f"{path}/documents").groupBy("collection").agg(F.count("*").alias("n"))


@query("SELECT diff_id, count(*) AS files FROM fx_hunks GROUP BY diff_id")
def write_package_json(s, d):
    path = shared_path(s, "packages")
    f = diffs.parse_diffs(fx.diffs(s, d))
    sinks.write_package_json(f.groupBy("diff_id").agg(F.collect_list("path").alias("changed_files")), path)
    return s.read.schema("diff_id long, changed_files array<string>").json(path).select("diff_id", F.size("changed_files").cast("long").alias("files"))
