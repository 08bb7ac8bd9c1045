"""The store's reverse index and the stream's state: what a change reads, and in which order changes count."""

import os
import random

import pytest
from pyspark.sql import functions as F

from codegraph.operators import diffs, documents, update
from codegraph.plans import incremental, index
from codegraph.sources import scan, sinks, syntax
from codegraph.streaming import updates

NODE = "id string, kind string, language string, path string, ordinal int"
EDGE = "id string, kind string, path string, source string, destination string, source_id string, destination_id string, ordinal int"


def _tables(spark, nodes, pairs):
    """A node for each name, in the file of its first part (``a.x`` lies in /a), and an edge for each pair, in its source's file."""
    at = lambda x: "/" + x.split(".")[0]
    n = spark.createDataFrame([(x, "function", "python", at(x), i) for i, x in enumerate(nodes)], NODE)
    e = spark.createDataFrame([(f"{a}->{b}", "calls", at(a), a, b, a, b, i) for i, (a, b) in enumerate(pairs)], EDGE)
    return n, e, n.select("id", "path", "language", F.col("id").alias("document"))


def _state(kept):
    return {name: sorted(r.id for r in kept.read(name).collect()) for name in ("nodes", "edges", "documents")}


def _plain(nodes, pairs, gone, new_nodes, new_pairs):
    at = lambda x: "/" + x.split(".")[0]
    nodes = {x for x in nodes if at(x) not in gone}
    pairs = {p for p in pairs if at(p[0]) not in gone and p[1] in nodes}
    nodes |= set(new_nodes)
    return nodes, pairs | {p for p in new_pairs if set(p) <= nodes}


def test_replacing_against_a_plain_model(spark, tmp_path):
    rng = random.Random(6)
    name = lambda: f"f{rng.randrange(12)}.n{rng.randrange(3)}"
    nodes = sorted({name() for _ in range(30)})
    pairs = sorted({(rng.choice(nodes), rng.choice(nodes)) for _ in range(40)})
    kept = sinks.Store(spark, str(tmp_path / "store"), buckets=8).create(*_tables(spark, nodes, pairs))
    for step in range(4):
        gone = {f"/f{rng.randrange(12)}" for _ in range(2)}
        fresh = sorted({x for x in (name() for _ in range(8)) if "/" + x.split(".")[0] in gone})
        # Ends may be in files that the change doesn't touch, or nowhere.
        new_pairs = sorted({(a, rng.choice([*nodes, *fresh, "f99.none"])) for a in fresh for _ in range(2)})
        n, e, d = _tables(spark, fresh, new_pairs)
        if step % 2:
            e = e.withColumn("destination_path", F.concat(F.lit("/"), F.substring_index("destination_id", ".", 1)))
        change = spark.createDataFrame([(p, "analysed" if any(x.startswith(p[1:] + ".") for x in fresh) else "deleted") for p in gone], "path string, status string")
        kept = sinks.Store(spark, str(tmp_path / "store"), buckets=8) if step == 2 else kept
        for _ in range(2 if step == 3 else 1):
            kept.replace(change, n, e, d.limit(0))
        nodes, pairs = (sorted(x) for x in _plain(nodes, pairs, gone, fresh, new_pairs))
        got = _state(kept)
        assert (got["nodes"], got["edges"]) == (nodes, sorted(f"{a}->{b}" for a, b in pairs))
        far = {(r.end_path, r.end_id, r.edge_path) for r in kept.read("ends").collect()}
        assert far == {("/" + x.split(".")[0], x, "/" + a.split(".")[0]) for a, b in pairs for x in (b,) if x.split(".")[0] != a.split(".")[0]}


@pytest.mark.parametrize("files", [30, 300])
def test_a_small_change_opens_few_files(spark, tmp_path, files, monkeypatch):
    nodes = [f"f{i}.n" for i in range(files)]
    n, e, d = _tables(spark, nodes, [(f"f{i}.n", f"f{i + 1}.n") for i in range(files - 1)])
    kept = sinks.Store(spark, str(tmp_path), buckets=256).create(n.repartition(1), e.repartition(1), d.repartition(1))
    opened = []
    read = kept._read

    def counted(name, at=None):
        df = read(name, at)
        opened.extend(df.inputFiles())
        return df

    monkeypatch.setattr(kept, "_read", counted)
    before = {f for name in ("nodes", "edges", "ends", "documents") for f in read(name).inputFiles()}
    new_edges = e.where("path = '/f7'").withColumn("destination_path", F.lit("/f8"))
    kept.replace(spark.createDataFrame([("/f7", "analysed")], "path string, status string"), n.where("path = '/f7'"), new_edges, d.where("path = '/f7'"))
    after = {f for name in ("nodes", "edges", "ends", "documents") for f in read(name).inputFiles()}
    # Two edges end in the file or begin there, so the folders of two files are read, whatever the size of the store.
    assert len(set(opened)) <= 10 and len(before - after) <= 8 and len(before) > 3 * min(files, 100)
    assert len(_state(kept)["edges"]) == files - 2


def _diff(path, deleted=False):
    mode, new = ("deleted file mode 1\n", "/dev/null") if deleted else ("", f"b/{path}")
    return f"diff --git a/{path} b/{path}\n{mode}--- a/{path}\n+++ {new}\n@@ -1 +1 @@\n"


def test_the_last_change_is_that_which_arrived_last(spark, tmp_path):
    rows = [("9", 0, "/a", 5), ("10", 0, "/a", 6), ("x", 0, "/b", 1), ("9", 0, "/b", 2), ("10", 3, "/c", 0), ("10", 12, "/c", 1)]
    df = spark.createDataFrame(rows, "diff_id string, file_ordinal int, path string, n int")
    assert {r.path: r.n for r in update.last_per_path(df).collect()} == {"/a": 6, "/b": 1, "/c": 1}
    later = df.withColumn("arrival", -F.col("n"))
    assert {r.path: r.n for r in update.last_per_path(later).collect()} == {"/a": 5, "/b": 1, "/c": 0}
    for i, name in enumerate(("b.diff", "a.diff")):
        (tmp_path / name).write_text(_diff("x.py"))
        os.utime(tmp_path / name, (1000 + i, 1000 + i))
    got = update.last_per_path(diffs.parse_diffs(scan.read_diffs(spark, str(tmp_path))))
    assert [r.diff_id for r in got.collect()] == ["a"]


def test_documents_of_many_paths_are_replaced_row_by_row(spark):
    changes = spark.createDataFrame([("/a.py", "deleted"), ("/a.py", "analysed"), ("/b.c", "missing_file"), ("/c.md", "analysed"), ("/d.py", "parse_error")], "path string, status string")
    assert {tuple(r) for r in update.documents_to_replace(changes).collect()} == {("python", "/a.py"), ("c", "/b.c")}
    docs = spark.createDataFrame([("1", "python", "/a.py"), ("2", "c", "/a.py"), ("3", "c", "/b.c"), ("4", "python", "/d.py")], "id string, language string, path string")
    out = update.replace_documents(docs, changes, docs.limit(0))
    assert "collect_" not in out._jdf.queryExecution().optimizedPlan().toString() and sorted(r.id for r in out.collect()) == ["2", "4"]


@pytest.mark.parametrize("order", ["given", "shuffled"])
def test_late_diffs_undo_nothing(spark, tmp_path, order):
    """Diffs of the same paths, in batches of two files with a restart between, give what one batch in order gives."""
    files = "repo_id string, path string, language string, content binary"
    old = spark.createDataFrame([("r", f"/r/{x}.py", "python", bytearray(b"def old():\n    return 1\n")) for x in "abcd"], files)
    now = spark.createDataFrame([("r", f"/r/{x}.py", "python", bytearray(b"def new():\n    return 1\n")) for x in "ab"], files)
    found, edges = index.analyse(syntax.python_syntax_nodes(old))
    stored, docs = index.accepted_edges(edges, found).withColumn("ordinal", F.col("ordinal.at")), documents.callable_documents(found)
    kept = sinks.Store(spark, str(tmp_path / "store"), buckets=4).create(found, stored, docs)
    now = now.union(spark.createDataFrame([("r", "/r/c.py", "python", bytearray(b"def (")), ("r", "/r/d.py", "python", bytearray(b"def ("))], files))
    # By arrival: a is deleted and comes back, b is changed and then deleted, c is deleted and comes back broken, d gets broken.
    texts = {"9": _diff("a.py", True) + _diff("b.py") + _diff("c.py", True), "10": _diff("a.py"), "11": _diff("b.py", True) + _diff("d.py"), "12": _diff("c.py")}
    for when, ids in enumerate((("9", "10"), ("11", "12")) if order == "given" else (("11", "10"), ("12", "9"))):
        (tmp_path / "in").mkdir(exist_ok=True)
        for i in ids:
            (tmp_path / f"in/{i}.diff").write_text(texts[i])
            os.utime(tmp_path / f"in/{i}.diff", (5000 + when, 5000 + when))
        updates.stream_incremental_update(spark, str(tmp_path / "in"), str(tmp_path / "cp"), kept, lambda: now, "/r", max_files=2 if order == "given" else 1, arrival=F.col("diff_id").cast("long"))
    change = incremental.stored_paths(diffs.parse_diffs(spark.createDataFrame([(i, t) for i, t in texts.items()], "diff_id string, diff string")), "/r")
    want = incremental.incremental_update(change, now, found, stored, docs)
    assert _state(kept) == {name: sorted(r.id for r in want[name].collect()) for name in ("nodes", "edges", "documents")}
    assert {(r.path, r.qualified_name) for r in kept.read("nodes").where("kind <> 'file'").collect()} == {("/r/a.py", "new"), ("/r/d.py", "old")}


@pytest.mark.parametrize("line", ["@@ -99999999999 +1 @@", "@@ -1,3000000000 +1 @@", "@@ -1 +1,2147483648 @@ x"])
def test_numbers_beyond_int_are_an_error_row(spark, line):
    good = _diff("a.py")
    df = spark.createDataFrame([(1, good), (2, good + line + "\n"), (3, good.replace("@@ -1 +1 @@", "@@ -2147483647,0 +1 @@"))], "diff_id long, diff string")
    assert {r.diff_id for r in diffs.parse_diffs(df).collect()} == {1, 3}
    assert [tuple(r) for r in diffs.diff_errors(df).collect()] == [(2, "bad_hunk", line)]


def test_digests_find_what_counts_hide(spark, tmp_path):
    n, e, d = _tables(spark, [f"f{i}.n" for i in range(40)], [(f"f{i}.n", f"f{i + 1}.n") for i in range(39)])
    kept = sinks.Store(spark, str(tmp_path), buckets=16).create(n, e, d)
    assert kept.verify({"nodes": n.repartition(7), "edges": e, "documents": d}).count() == 0
    other = n.withColumn("kind", F.when(F.col("path") == "/f7", "class").otherwise(F.col("kind")))
    found = kept.verify({"nodes": other, "edges": e}).collect()
    at = n.where("path = '/f7'").select(F.pmod(F.xxhash64("path"), F.lit(16)).cast("int")).first()[0]
    assert [(r.table, r.bucket) for r in found] == [("nodes", at)] and found[0].expected_rows == found[0].stored_rows
    swapped = n.withColumn("kind", F.when(F.col("path") == "/f7", F.lit(None)).otherwise(F.col("kind")))
    assert [r.bucket for r in kept.verify({"nodes": swapped}).collect()] == [at]
    assert {r.table for r in kept.verify({"nodes": n.unionAll(n.where("path = '/f7'")), "documents": d.limit(0)}).collect()} == {"nodes", "documents"}
    kept.replace(spark.createDataFrame([("/f7", "analysed"), ("/f9", "deleted")], "path string, status string"), other.where("path = '/f7'"), e.limit(0), d.limit(0))
    now = {name: kept.read(name) for name in ("nodes", "edges", "documents")}
    assert kept.verify(now).count() == 0 and all(kept.damaged(name).count() == 0 for name in now)
    assert kept.verify({"nodes": n}).count() > 0
    # A folder that was changed behind the store's back shows by its rows.
    name = f"{tmp_path}/nodes/bucket={at}"
    spark.read.parquet(name).withColumn("kind", F.lit("x")).write.parquet(str(tmp_path / "copy"))
    spark.read.parquet(str(tmp_path / "copy")).write.mode("overwrite").parquet(name)
    assert [r.bucket for r in kept.damaged("nodes").collect()] == [at] and kept.damaged("nodes", [at]).count() == 1 and kept.damaged("nodes", [(at + 1) % 16]).count() == 0


def test_a_staged_table_leaves_no_shuffle_files(spark):
    from codegraph.sources import shared

    blocks = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    spark.range(10).count()
    before, setting = blocks(), spark.conf.get(shared.CLEANUP, None)
    staged = shared.stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert staged.count() == 7 and spark.conf.get(shared.CLEANUP, None) == setting and blocks() <= before + 8
