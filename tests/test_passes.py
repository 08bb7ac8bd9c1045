"""How often the jobs read and parse what they are given."""

import pytest

from codegraph.operators import relations, symbols
from codegraph.sources import syntax

SOURCE = b"class C(Base):\n    x = 1\n\n    def m(self):\n        y = self.x\n        return y\n\n\ndef f(a):\n    v = w = g(a)\n    return f(v)\n"


@pytest.fixture
def files(spark):
    """Three files, and how often one was read."""
    read = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    columns = "repo_id string, path string, language string, content binary"
    rows = spark.createDataFrame([("r", f"/r/{i}.py", "python", bytearray(SOURCE)) for i in range(3)], columns)
    return rows.mapInPandas(count, columns), read


def test_symbols_of_python_files_take_one_pass(files):
    found = symbols.extract_symbols(syntax.python_syntax_nodes(files[0]))
    got = {(r.kind, r.qualified_name, r.parent_name, r.signature, tuple(r.parameters)) for r in found.where("path = '/r/1.py'").collect()}
    assert files[1].value == 3
    assert got == {("file", "/r/1.py", None, "/r/1.py", ()), ("class", "C", None, "class C", ()), ("variable", "C.x", "C", "x = ...", ()), ("method", "C.m", "C", "def m(self)", ()), ("variable", "C.m.y", "C.m", "y = ...", ()), ("function", "f", None, "def f(a)", ()), ("variable", "f.v", "f", "v = ...", ())}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_references_take_one_pass(files):
    found = symbols.reference_names(syntax.python_syntax_nodes(files[0]))
    got = sorted((r["mode"], r["name"], r.start_line) for r in found.where("path = '/r/2.py'").collect())
    assert files[1].value == 3
    # The inner of two assignments in one statement is a part of the outer one.
    assert got == [("reads", "a", 10), ("reads", "a", 10), ("reads", "v", 11), ("reads", "w", 10), ("reads", "x", 5), ("reads", "y", 6), ("writes", "v", 10), ("writes", "w", 10), ("writes", "x", 2), ("writes", "y", 5)]


def test_accesses_are_read_for_spans_and_names_alone(spark):
    """Writes and reads, and what a name means, come of one pass over the accesses and one over their spans."""
    read = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    columns = "path string, node_id long, place long, mode string, name string, start_line int, start_column int, end_line int, end_column int"
    accesses = spark.createDataFrame([("/r/a.py", 10 * n, 10 * n + i, mode, "w", n, 5, n, 9) for n in (2, 4) for i, mode in enumerate(("writes", "reads"))], columns).mapInPandas(count, columns)
    rows = [("function", "f", "f", None, 1, 3, 1), ("variable", "w", "f.w", "f", 2, 2, 2), ("variable", "w", "f.w", "f", 3, 3, 3), ("variable", "w", "w", None, 4, 4, 4), ("file", "a.py", "/r/a.py", None, 1, 9, 0)]
    found = spark.createDataFrame([("/r/a.py", f"{k}:{q}:{a}", k, n, q, p, a, 1, b, 99, o) for k, n, q, p, a, b, o in rows], "path string, id string, kind string, name string, qualified_name string, parent_name string, start_line int, start_column int, end_line int, end_column int, ordinal long")
    got = sorted((r.kind, r.source, r.destination_id) for r in relations.access_edges(accesses, found).collect())
    # The edge ends at the last variable of the name that is meant.
    assert got == [("reads", "/r/a.py", "variable:w:4"), ("reads", "f", "variable:f.w:3"), ("writes", "/r/a.py", "variable:w:4"), ("writes", "f", "variable:f.w:3")]
    assert read.value == 8
