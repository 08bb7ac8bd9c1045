"""Diffs, changed symbols, the store and exploration, on small cases and against plain models."""

import random
import shlex

import pytest
from pyspark.sql import functions as F

from codegraph.functions import text as tx
from codegraph.operators import changed, diffs, documents, explore, package, relations, store, symbols, update
from codegraph.plans import context, incremental, index
from codegraph.sources import scan, sinks, syntax
from codegraph.streaming import updates

DIFF = "diff_id long, diff string"


def _one(spark, kind, value, make):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x"))).first()[0]


def test_lines_and_strips_are_those_of_python(spark):
    rng = random.Random(1)
    marks = "ab \t\n\r\x0b\x0c\x1c\x1d\x1e\x85  \xa0\u3000"
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(12))) for _ in range(400)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.split_lines(F.col("t")).alias("l"), tx.strip(F.col("t")).alias("s"), tx.normalize_code(F.col("t")).alias("n")).collect()
    for r in got:
        assert r.l == r.t.splitlines() and r.s == r.t.strip() and r.n == "\n".join(x.strip() for x in r.t.strip().splitlines())


def test_names_and_paths(spark):
    for path, want in {"a/B.PY": "python", "x.h": "c", "x.hh": "cpp", "x.java": "java", ".py": None, "a/.c": None, "x.md": None, "dir.py/x": None}.items():
        assert _one(spark, "string", path, tx.language_of_path) == want
    assert _one(spark, "string", "C++", lambda x: tx.collection_name(F.lit("My Main"), x)) == "my-main-c-code-impl"
    assert _one(spark, "string", "++", lambda x: tx.collection_name(F.lit("a"), x)) is None
    assert _one(spark, "string", "./a/../b\\c.py", lambda x: tx.storage_path(F.lit("/r/"), x)) == "/r/b/c.py"
    assert _one(spark, "map<string,boolean>", {"is_static": True}, tx.metadata_json) == '{"is_static": true}'
    assert _one(spark, "map<string,boolean>", {}, tx.metadata_json) == "{}"
    assert _one(spark, "string", "  ", lambda x: tx.document_text(F.lit("sig"), x)) == "sig"
    assert _one(spark, "string", "", lambda x: tx.query_text(x, F.lit(" code "))) == "code"


def test_headers_are_read_as_a_shell_reads_them(spark):
    rng = random.Random(2)
    bits = ["a", "b/", " ", '"', "'", "\\", "x y", "\t", "a/q"]
    lines = ["diff --git " + "".join(rng.choice(bits) for _ in range(rng.randrange(1, 9))) for _ in range(600)] + ['diff --git "a/x y.py" "b/x y.py"', "diff --git a/p b/p"]
    old, new, good = diffs.header_paths(F.col("l"))
    for r in spark.createDataFrame([(x,) for x in lines], "l string").select("l", old.alias("o"), new.alias("n"), good.alias("g")).collect():
        try:
            tokens = shlex.split(r.l)
        except ValueError:
            tokens = []
        assert r.g == (len(tokens) == 4), r.l
        if r.g:
            clean = lambda p: None if p == "/dev/null" else (lambda q: q[2:] if q[:2] in ("a/", "b/") else q)(p.replace("\\", "/"))
            assert (r.o, r.n) == (clean(tokens[2]), clean(tokens[3]))


def test_parse_diffs(spark):
    text = (
        "\ndiff --git a/m.py b/m.py\nindex 1..2 100644\n--- a/m.py\n+++ b/m.py\n@@ -1,2 +1,3 @@ def f\n-x\n@@ -10 +11,0 @@\r\n"
        "diff --git a/new.py b/new.py\nnew file mode 100644\n--- /dev/null\n+++ b/new.py\n@@ -0,0 +1,2 @@\n"
        "diff --git a/old.py b/old.py\ndeleted file mode 100644\n--- a/old.py\n+++ /dev/null\n@@ -1,3 +0,0 @@\n"
        'diff --git "a/with space.py" "b/with space.py"\n--- "a/with space.py"\n+++ "b/with space.py"\n@@ -3 +3 @@\n'
        "diff --git a/r1.py b/r2.py\nsimilarity index 100%\nrename from r1.py\nrename to r2.py\n"
    )
    got = diffs.parse_diffs(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, " \n")], DIFF)).orderBy("file_ordinal").collect()
    assert [(r.path, r.change_type, r.old_path, r.new_path) for r in got] == [("m.py", "modified", "m.py", "m.py"), ("new.py", "added", None, "new.py"), ("old.py", "deleted", "old.py", None), ("with space.py", "modified", "with space.py", "with space.py"), ("r2.py", "modified", "r1.py", "r2.py")]
    assert [tuple(h) for h in got[0].hunks] == [(1, 2, 1, 3), (10, 1, 11, 0)] and [tuple(x) for x in got[0].changed_line_ranges] == [(1, 3), (11, 0)]
    assert [tuple(x) for x in got[2].changed_line_ranges] == [(1, 3)] and got[4].hunks == []


def test_bad_diffs_are_set_aside(spark):
    head = "diff --git a/x b/x\n"
    rows = [(1, "junk\n" + head), (2, "diff --git a/x\n"), (3, head + "@@ -1 +z @@\n"), (4, head + "--- \n"), (5, head + "--- /dev/null\n+++ /dev/null\n"), (6, head + "@@ -1 +1 @@\n"), (7, 'diff --git "a/x b/x\n'), (8, head + "--- it's\n")]
    df = spark.createDataFrame(rows, DIFF)
    assert {r.diff_id: r.error for r in diffs.diff_errors(df).collect()} == {1: "content_before_header", 2: "bad_header", 3: "bad_hunk", 4: "missing_path", 5: "no_target_path", 7: "bad_header"}
    assert {r.diff_id: r.old_path for r in diffs.parse_diffs(df).collect()} == {6: "x", 8: "it's"}


def test_a_removed_line_can_look_like_a_path_line(spark):
    text = "diff --git a/q.sql b/q.sql\n--- a/q.sql\n+++ b/q.sql\n@@ -1 +0,0 @@\n--- drop it\n"
    assert diffs.parse_diffs(spark.createDataFrame([(1, text)], DIFF)).first().old_path == "drop"


SOURCE = b'''LIMIT = 3

@dec(1)
class Greeter(Base):
    name = "x"

    @staticmethod
    def greet(self, who: str = "y") -> str:
        message = helper(who)
        self.name = message
        if who:
            hidden = 1
        def inner():
            z = 1
        return message + self.name + LIMIT

async def helper(v):
    t = normalize(v, k=LIMIT)
    return t
'''


@pytest.fixture(scope="module")
def repo(spark):
    files = spark.createDataFrame([("r", "/r/g.py", "python", bytearray(SOURCE)), ("r", "/r/bad.py", "python", bytearray(b"def (:")), ("r", "/r/one.py", "python", bytearray(b"class A:\n    q = 1\n    def m(self):\n        return self.q")), ("r", "/r/bin.py", "python", bytearray(b"\xff\xfe")), ("r", "/r/empty.py", "python", bytearray(b""))], "repo_id string, path string, language string, content binary")
    nodes = syntax.python_syntax_nodes(files).cache()
    found, edges = index.analyse(nodes)
    return files, nodes, found.cache(), edges.cache()


def test_python_symbols(repo):
    _, nodes, found, _ = repo
    got = {(r.kind, r.qualified_name): r for r in found.where("path = '/r/g.py'").collect()}
    assert set(got) == {("file", "/r/g.py"), ("variable", "LIMIT"), ("class", "Greeter"), ("variable", "Greeter.name"), ("method", "Greeter.greet"), ("variable", "Greeter.greet.message"), ("variable", "Greeter.greet.self.name"), ("function", "helper"), ("variable", "helper.t")}
    m = got["method", "Greeter.greet"]
    assert m.signature == 'def greet(self, who: str = "y") -> str' and m.start_line == 8 and m.body.startswith("message = helper") and m.parent_name == "Greeter" and m.id == "method:/r/g.py:Greeter.greet:8"
    assert got["class", "Greeter"].signature == "class Greeter" and got["variable", "LIMIT"].body is None
    assert {r.path for r in nodes.where("parse_error").collect()} == {"/r/bad.py", "/r/bin.py"}


def test_relations(repo):
    got = {(r.kind, r.source, r.destination, r.destination_id is not None) for r in repo[3].where("path = '/r/g.py'").collect()}
    assert {("calls", "Greeter.greet", "helper", True), ("calls", "helper", "normalize", False), ("contains", "Greeter", "Greeter.greet", True), ("writes", "Greeter.greet", "Greeter.name", True), ("reads", "Greeter.greet", "LIMIT", True), ("reads", "helper", "LIMIT", True), ("writes", "helper", "helper.t", True)} <= got
    one = {(r.kind, r.source, r.destination) for r in repo[3].where("path = '/r/one.py'").collect()}
    assert ("reads", "A.m", "A.q") in one and ("contains", "A", "A.m") in one


def test_enclosing_ties_go_to_the_first(spark):
    s = spark.createDataFrame([("p", "file", "file", 0, 1, 1, 9, 1), ("p", "A", "class", 1, 1, 1, 9, 1), ("p", "A.m", "method", 2, 3, 1, 5, 9)], "path string, id string, kind string, ordinal long, start_line int, start_column int, end_line int, end_column int").withColumn("qualified_name", F.col("id")).withColumn("parent_name", F.lit(None).cast("string"))
    spans = spark.createDataFrame([("p", 1, 2, 1, 2, 5), ("p", 2, 3, 1, 5, 9), ("p", 3, 3, 0, 5, 9), ("p", 4, 9, 1, 10, 1)], "path string, node_id long, start_line int, start_column int, end_line int, end_column int")
    assert {r.node_id: r.owner.id for r in relations.enclosing_symbol(spans, s).collect()} == {1: "file", 2: "A.m", 3: "file"}


def test_overlaps_and_merging(spark):
    files = spark.createDataFrame([(1, 0, "p", [(5, 2, 5, 0), (9, 0, 9, 0)]), (1, 1, "p", [(5, 2, 20, 1)])], "diff_id long, file_ordinal int, path string, hunks array<struct<old_start_line:int,old_line_count:int,new_start_line:int,new_line_count:int>>")
    s = spark.createDataFrame([("p", "a", 1, 1, 5), ("p", "b", 2, 6, 8), ("p", "c", 3, 9, 9), ("p", "d", 4, 10, 19), ("q", "e", 5, 1, 99)], "path string, id string, ordinal long, start_line int, end_line int")
    got = {r.symbol_id: [tuple(x) for x in r.matched_line_ranges] for r in changed.changed_symbols(changed.overlap_symbols(changed.ranges_of(files), s)).collect()}
    assert got == {"a": [(5, 2)], "b": [(5, 2)], "c": [(9, 0)]}


def _graph(spark, pairs):
    nodes = sorted({x for p in pairs for x in p[1:]})
    n = spark.createDataFrame([(x, "function", "python", f"/{x}.py", x, f"q.{x}", "s", 1, 2, 1) for x in nodes], "id string, kind string, language string, path string, name string, qualified_name string, signature string, start_line int, end_line int, ordinal int")
    e = spark.createDataFrame([(f"{k}:{a}->{b}", k, f"/{a}.py", a, b, a, b, 1) for k, a, b in pairs], "id string, kind string, path string, source string, destination string, source_id string, destination_id string, ordinal int")
    return n, e


def test_best_paths_against_a_plain_model(spark):
    rng = random.Random(5)
    pairs = sorted({(rng.choice(explore.KINDS), f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(40)})
    n, e = _graph(spark, pairs)
    seeds = spark.createDataFrame([("n0",), ("n1",), ("gone",)], "id string")
    kinds = ("calls", "reads", "contains")
    best = {}
    for s in ("n0", "n1"):
        steps = [(x, f"{k}:{a}->{b}") for k, a, b in pairs if k in kinds for x, y in ((b, a), (a, b)) if y == s]
        found = [([i], x) for x, i in steps]
        for x, i in steps:
            found += [([i, f"{k}:{a}->{b}"], z) for k, a, b in pairs if k in kinds and f"{k}:{a}->{b}" != i for z, y in ((b, a), (a, b)) if y == x]
        for ids, x in found:
            if x != s and ((s, x) not in best or (len(ids), ids) < best[s, x]):
                best[s, x] = len(ids), ids
    known, adj = explore.known_seeds(seeds, n), explore.adjacency(e, kinds)
    got = explore.best_paths(explore.paths(known, adj))
    assert {(r.seed_id, r.terminal_node_id): (r.hop_count, r.edge_ids) for r in got.collect()} == best
    for depth in (1, 2):
        listed, direct = explore.best_paths(explore.paths(known, adj, depth)), explore.nearest_paths(known, adj, depth)
        assert listed.columns == direct.columns and sorted(map(str, listed.collect())) == sorted(map(str, direct.collect()))
    with pytest.raises(ValueError):
        explore.paths(seeds, explore.adjacency(e), 3)


def test_seeds_without_a_path_keep_a_placeholder(spark):
    n, e = _graph(spark, [("calls", "a", "b")])
    seeds = spark.createDataFrame([("a",), ("b",)], "id string")
    none = explore.best_paths(explore.paths(seeds, explore.adjacency(e, ("reads",))))
    assert {(r.id, r["name"], r.language, r.start_line) for r in explore.explore_nodes(seeds, none, n).collect()} == {("a", "a", "", 0), ("b", "b", "", 0)}


def test_the_store_replaces_and_detaches(spark):
    n, e = _graph(spark, [("calls", "a", "b"), ("calls", "c", "a"), ("calls", "c", "d")])
    gone = spark.createDataFrame([("/a.py",)], "path string")
    left_n, left_e = store.delete_nodes_by_path(n, e, gone)
    assert {r.id for r in left_n.collect()} == {"b", "c", "d"} and [r.id for r in left_e.collect()] == ["calls:c->d"]
    new = n.where("id = 'b'").withColumn("kind", F.lit("x")).unionByName(n.where("id = 'b'").withColumn("kind", F.lit("y")).withColumn("ordinal", F.lit(2)))
    assert {r.id: r.kind for r in store.upsert_nodes(n, new).collect()} == {"a": "function", "b": "y", "c": "function", "d": "function"}
    more = e.select("id", "kind", "path", "source", "destination", "source_id", F.lit("nowhere").alias("destination_id"), "ordinal").limit(1)
    assert store.upsert_edges(e, more, n).count() == 3
    expected = spark.createDataFrame([(3, 4, 5)], "nodes long, edges long, documents long")
    assert store.verify_index(expected, expected).first().mismatch is None
    assert tuple(store.verify_index(expected, expected.withColumn("documents", F.lit(4)).withColumn("edges", F.lit(9))).first()) == ("edges", 4, 9)


def test_similar_against_brute_force_with_ties(spark):
    rng = random.Random(3)
    docs = [(f"d{i:03}", "python" if i % 2 else "c", [float(rng.randrange(3)) for _ in range(4)]) for i in range(80)] + [("dnull", "c", None)]
    queries = [(f"q{i}", "python", [float(rng.randrange(3)) for _ in range(4)]) for i in range(5)] + [("qn", "c", None)]
    got = documents.similar(spark.createDataFrame(queries, "query_id string, language string, embedding array<double>"), spark.createDataFrame(docs, "id string, language string, embedding array<double>").repartition(5), 7).collect()
    for q, language, v in queries[:5]:
        want = sorted((sum((a - b) ** 2 for a, b in zip(v, x)), i) for i, k, x in docs if k == language and x)[:7]
        assert [(r.distance, r.id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
    assert len(got) == 35
    assert documents.similar(spark.createDataFrame(queries, "query_id string, language string, embedding array<double>"), spark.createDataFrame(docs, "id string, language string, embedding array<double>"), 0).count() == 0


def test_classes_of_changes(spark):
    f = spark.createDataFrame([(1, 0, "a.py", "deleted"), (1, 1, "b.py", "modified"), (1, 2, "c.md", "modified"), (1, 3, "d.py", "added"), (1, 4, "e.py", "added"), (2, 0, "a.py", "added")], "diff_id long, file_ordinal int, path string, change_type string")
    now = spark.createDataFrame([("c.md", False), ("d.py", True), ("e.py", False), ("a.py", False)], "path string, parse_error boolean")
    c = update.classify_changes(f, now)
    assert {(r.diff_id, r.path): r.status for r in c.collect()} == {(1, "a.py"): "deleted", (1, "b.py"): "missing_file", (1, "c.md"): "unsupported_language", (1, "d.py"): "parse_error", (1, "e.py"): "analysed", (2, "a.py"): "analysed"}
    assert {r.path for r in update.paths_to_replace(c).collect()} == {"a.py", "e.py"}
    assert update.paths_by_language(c).first().paths == ["a.py", "b.py", "e.py"]
    assert {r.path: r.status for r in update.last_per_path(c).collect()}["a.py"] == "analysed"


def test_scan_lists_hidden_files_and_skips_folders(spark, tmp_path):
    for name in ("pkg/__init__.py", "pkg/.hidden.py", "pkg/a.py", "node_modules/x.py", "pkg/build/y.py", "build.py", "readme.md", "big.java"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n" * (20 if name == "big.java" else 1))
    rows = scan.scan_files(spark, str(tmp_path), "r", max_file_bytes=32).collect()
    got = {r.relative_path: (r.language, r.skip_reason, r.content and bytes(r.content)) for r in rows}
    assert all(r.path == f"{tmp_path}/{r.relative_path}" and r.repo_id == "r" for r in rows) and [r.relative_path for r in rows] == sorted(got)
    ok = ("python", None, b"x = 1\n")
    assert got == {"pkg/__init__.py": ok, "pkg/.hidden.py": ok, "pkg/a.py": ok, "build.py": ok, "readme.md": (None, "unsupported_language", None), "big.java": ("java", "file_too_large", None)}


def test_index_then_update_then_the_same_again(spark, repo, tmp_path):
    files, nodes, found, edges = repo
    row = index.initial_index(files.select("path", F.lit(None).cast("string").alias("skip_reason")), nodes, str(tmp_path / "index")).first()
    assert (row.scanned_files, row.skipped_files, row.mismatch) == (3, 2, None) and row.upserted_nodes == row.verified_nodes == found.count()
    docs = documents.callable_documents(found)
    stored = index.accepted_edges(edges, found).withColumn("ordinal", F.col("ordinal.at"))
    text = "".join(f"diff --git a/{p} b/{p}\n{m}--- a/{p}\n+++ b/{p}\n@@ -1 +1 @@\n" for p, m in (("g.py", "deleted file mode 1\n"), ("one.py", ""), ("empty.py", ""), ("gone.py", ""), ("x.md", "")))
    change = incremental.stored_paths(diffs.parse_diffs(spark.createDataFrame([(1, text)], DIFF)), "/r")
    now = spark.createDataFrame([("r", "/r/one.py", "python", bytearray(b"class B:\n    def k(self):\n        return 1\n")), ("r", "/r/empty.py", "python", bytearray(b"def (")), ("r", "/r/x.md", None, None), ("r", "/r/bin.py", "python", bytearray(b"z = 1"))], "repo_id string, path string, language string, content binary")
    once = incremental.incremental_update(change, now, found, stored, docs)
    names = {(r.path, r.kind, r.name) for r in once["nodes"].collect()}
    assert names == {("/r/one.py", "file", "one.py"), ("/r/one.py", "class", "B"), ("/r/one.py", "method", "k"), ("/r/empty.py", "file", "empty.py")}
    assert [(r.path, r.name) for r in once["documents"].collect()] == [("/r/one.py", "k")]
    assert tuple(once["summary"].first()) == (5, 3, 2, 1, "ok")
    twice = incremental.incremental_update(change, now, once["nodes"], once["edges"], once["documents"])
    kept = sinks.Store(spark, str(tmp_path / "store"), buckets=4).create(found, stored, docs)
    before = {name: set(kept._read(name).inputFiles()) for name in ("nodes", "edges", "documents")}
    ids = lambda table: sorted(r.id for r in table.select("id").collect())
    want = {name: ids(once[name]) for name in before}
    assert {name: ids(twice[name]) for name in before} == want
    for _ in range(2):
        assert tuple(incremental.update_store(change, now, kept).first()) == (5, 3, 2, 1, "ok")
        assert {name: ids(kept.read(name)) for name in before} == want
    assert before["nodes"] - set(kept._read("nodes").inputFiles())


def test_a_store_rewrites_only_what_is_touched(spark, tmp_path):
    n, e = _graph(spark, [("calls", f"n{i}", f"n{i + 1}") for i in range(40)])
    docs = n.select("id", "path", "language", F.col("id").alias("document"))
    kept = sinks.Store(spark, str(tmp_path), buckets=32).create(n, e, docs)
    files = lambda name: set(kept._read(name).inputFiles())
    folders = lambda names: {f.rpartition("/")[0] for f in names}
    old = files("nodes"), files("edges")
    change = spark.createDataFrame([("/n7.py", "deleted")], "path string, status string")
    kept.replace(change, n.limit(0), e.limit(0), docs.limit(0))
    assert {r.id for r in kept.read("nodes").collect()} == {f"n{i}" for i in range(41)} - {"n7"}
    assert {r.id for r in kept.read("edges").collect()} == {f"calls:n{i}->n{i + 1}" for i in range(40)} - {"calls:n6->n7", "calls:n7->n8"}
    assert {r.path for r in kept.read("documents").collect()} == {f"/n{i}.py" for i in range(41)} - {"/n7.py"}
    assert len(folders(old[0] - files("nodes"))) == 1 and len(folders(old[1] - files("edges"))) <= 2 and old[0] & files("nodes") and old[1] & files("edges")


def test_two_repositories_with_the_same_paths(spark):
    """The same sources under two roots give the same symbols and relations, each with its own ids."""
    one, two = ([("r" + root, f"{root}/src/m.py", "python", bytearray(SOURCE)), ("r" + root, f"{root}/src/k.py", "python", bytearray(b"def helper():\n    return 1\n"))] for root in ("/a", "/b"))
    files = "repo_id string, path string, language string, content binary"
    both = [index.analyse(syntax.python_syntax_nodes(spark.createDataFrame(x, files))) for x in (one, two, one + two)]
    ids = [[sorted(r.id for r in table.collect()) for table in pair] for pair in both]
    for k in (0, 1):
        assert sorted(ids[0][k] + ids[1][k]) == ids[2][k] and len(set(ids[2][k])) == len(ids[2][k])
        assert [i.replace("/a/", "/b/") for i in ids[0][k]] == ids[1][k]
    with pytest.raises(Exception, match="not an absolute path"):
        symbols.extract_symbols(syntax.python_syntax_nodes(spark.createDataFrame([("r", "src/m.py", "python", bytearray(SOURCE))], files))).collect()


def test_context_package(spark, repo):
    _, _, found, edges = repo
    text = "diff --git a/g.py b/g.py\n--- a/g.py\n+++ b/g.py\n@@ -18,1 +18,1 @@\ndiff --git a/none.py b/none.py\n--- a/none.py\n+++ b/none.py\n@@ -1 +1 @@\n"
    f = incremental.stored_paths(diffs.parse_diffs(spark.createDataFrame([(1, text)], DIFF)), "/r")
    docs = documents.callable_documents(found)
    vectors = found.select("id", F.array(F.length("code").cast("double"), F.lit(1.0)).alias("embedding"))
    stored = index.accepted_edges(edges, found)
    p = context.context_package(f, spark.createDataFrame([("/r/g.py", False)], "path string, parse_error boolean"), found, found, stored, docs, vectors).first()
    assert [(x.path, x.skip_reason) for x in p.changed_files] == [("/r/g.py", None), ("/r/none.py", "source_missing")]
    assert [x.symbol_id for x in p.changed_symbols] == ["function:/r/g.py:helper:17"] and [x.qualified_name for x in p.modified_code] == ["helper"]
    assert {x.qualified_name for x in p.neighbor_code if x.source == "graph"} >= {"Greeter.greet", "LIMIT"}
    assert {x.qualified_name for x in p.neighbor_code if x.source == "vector"} == {"A.m", "Greeter.greet"}
    assert [x.hop_count for x in p.graph_paths] == sorted(x.hop_count for x in p.graph_paths)


def test_neighbours_from_the_graph_win(spark):
    row = "diff_id long, place int, symbol_id string, path string, language string, kind string, qualified_name string, start_line int, end_line int, code string"
    graph = spark.createDataFrame([(1, 1, "g", "p", "c", "function", "q", 1, 2, "a\n b")], row)
    vector = spark.createDataFrame([(1, 1, "v", "p", "c", "function", "q", 1, 2, " a\nb "), (1, 2, "w", "p", "c", "function", "q", 1, 2, "c")], row)
    assert sorted((r.source, r.symbol_id) for r in package.neighbor_code(graph, vector).collect()) == [("graph", "g"), ("vector", "w")]


def test_the_stream_applies_diffs_once(spark, repo, tmp_path):
    _, _, found, edges = repo
    stored = index.accepted_edges(edges, found).withColumn("ordinal", F.col("ordinal.at"))
    kept = sinks.Store(spark, str(tmp_path / "store"), buckets=4).create(found, stored, documents.callable_documents(found))
    now = spark.createDataFrame([("r", "/r/one.py", "python", bytearray(b"def k():\n    return 1\n"))], "repo_id string, path string, language string, content binary")
    (tmp_path / "in").mkdir()
    go = lambda: updates.stream_incremental_update(spark, str(tmp_path / "in"), str(tmp_path / "cp"), kept, lambda: now, "/r")
    (tmp_path / "in/one.diff").write_text("diff --git a/one.py b/one.py\n--- a/one.py\n+++ b/one.py\n@@ -1 +1 @@\n")
    go()
    go()
    assert {r.qualified_name for r in kept.read("nodes").where("path = '/r/one.py'").collect()} == {"/r/one.py", "k"} and kept.read("nodes").where("path = '/r/g.py'").count() > 5
    assert [r.destination for r in kept.read("edges").where("path = '/r/one.py'").collect()] == ["k"]
    (tmp_path / "in/two.diff").write_text("diff --git a/one.py b/one.py\ndeleted file mode 1\n--- a/one.py\n+++ /dev/null\n@@ -1 +0,0 @@\n")
    go()
    assert kept.read("nodes").where("path = '/r/one.py'").count() == 0 and kept.read("documents").where("path = '/r/one.py'").count() == 0


def test_sinks(spark, tmp_path):
    n, e = _graph(spark, [("calls", "a", "b")])
    sinks.write_graph(n, e, str(tmp_path), buckets=4)
    assert spark.read.parquet(f"{tmp_path}/nodes").count() == 2 and spark.read.parquet(f"{tmp_path}/edges").count() == 1


def test_kinds_of_c_and_java_nodes(spark):
    cases = [("c", "translation_unit/type_definition/type_identifier", "declarator", "type_alias"), ("c", "translation_unit/type_definition/primitive_type", "type", "enum"), ("c", "translation_unit/type_definition/struct_specifier", "type", "struct"), ("c", "translation_unit/declaration/function_declarator", "declarator", None), ("c", "translation_unit/function_definition/compound_statement/if_statement/declaration/identifier", None, None), ("java", "program/enum_declaration/enum_body/enum_constant", None, "enum_member"), ("java", "program/class_declaration/class_body/record_declaration", None, "record"), ("java", "program/class_declaration/class_body/method_declaration/block/method_declaration", None, None), ("cpp", "translation_unit/template_declaration/class_specifier/field_declaration_list/field_declaration/union_specifier", None, "union"), ("cpp", "translation_unit/class_specifier/field_declaration_list/template_declaration/function_definition", None, None)]
    df = spark.createDataFrame([(i, *c, c[1].split("/")[-1]) for i, c in enumerate(cases)], "i int, language string, type_path string, field string, want string, type string")
    assert all(r.kind == r.want for r in df.withColumn("kind", symbols.symbol_kind()).collect())
