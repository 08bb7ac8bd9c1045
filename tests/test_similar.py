"""Similar documents: the pivot index against all distances, and what hits without names are called."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codegraph.operators import documents, package

Q, D = "query_id string, language string, embedding array<double>", "id string, language string, embedding array<double>"


def _plain(queries, docs, k):
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    out = []
    for q, language, v in queries:
        if not ok(v):
            continue
        found = sorted((float(((np.array(x) - np.array(v)) ** 2).sum()), i) for i, m, x in docs if m == language and ok(x) and len(x) == len(v))
        out += [(q, i, r, d) for r, (d, i) in enumerate(found[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.0, 0.05, 2.0])
def test_the_nearest_of_mixed_vectors(spark, monkeypatch, spread):
    monkeypatch.setattr(documents, "BLOCK", 40)
    monkeypatch.setattr(documents, "QUERY_BLOCK", 7)
    monkeypatch.setattr(documents, "STRETCH", 8)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(5, 6))
    docs = [(f"d{i:03}", "c" if i % 4 else "java", (centers[i % 5] + spread * rng.normal(size=6)).tolist()[: 6 if i % 9 else 4]) for i in range(300)]
    docs += [("n1", "c", None), ("n2", "c", [1.0, None, 1.0, 1.0, 1.0, 1.0]), ("n3", "c", [float("nan")] * 6), ("n4", "c", [float("inf")] * 6), ("n5", "c", [])]
    queries = [(f"q{i:02}", language, (centers[i % 5] + spread * rng.normal(size=6)).tolist()[:w]) for i in range(20) for language, w in [(("c", 6), ("java", 6), ("c", 4), ("cpp", 6))[i % 4]]]
    queries += [("qn", "c", None), ("qx", "c", [None] * 6), ("qe", "c", [])]
    a, b = spark.createDataFrame(queries, Q), spark.createDataFrame(docs, D).repartition(3)
    for k in (1, 5, 400):
        got = sorted((r.query_id, r.id, r["rank"], r.distance) for r in documents.similar(a, b, k).collect())
        want = _plain(queries, docs, k)
        assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])
    index = documents.pivot_index(b)
    assert sorted(map(tuple, documents.similar(a, b, 5, index).select("query_id", "id", "rank").collect())) == [w[:3] for w in _plain(queries, docs, 5)]


def test_the_index_saves_distances():
    rng = np.random.default_rng(5)
    x = np.concatenate([c + 0.02 * rng.normal(size=(200, 16)) for c in rng.normal(size=(20, 16))])
    pivots = x[rng.choice(len(x), documents.PIVOTS, replace=False)]
    away = np.sqrt(((x[:, None] - pivots) ** 2).sum(axis=2))
    computed = 0
    for i in range(0, len(x), 101):
        near, d, n = documents.within(x, away, x[i], away[i], 5, np.inf)
        computed += n
        full = np.sort(((x - x[i]) ** 2).sum(axis=1))[:5]
        assert np.allclose(np.sort(d)[:5], full)
    assert computed < 0.25 * len(x) * len(range(0, len(x), 101))


def test_hits_without_names(spark):
    docs = spark.createDataFrame([("r1", "text", None, None, "c", None, None, "nm", None, None), ("r2", "text", "", "function", "c", "/p", "", "", 3, 4), ("r3", "text", "s3", "function", "c", "/p", "q3", "n3", 5, 6)], "id string, document string, symbol_id string, symbol_kind string, language string, path string, qualified_name string, name string, start_line int, end_line int")
    hits = spark.createDataFrame([("q", f"r{i}", i) for i in (1, 2, 3)], "query_id string, id string, rank int")
    seeds = spark.createDataFrame([(1, 0, "q", "c")], "diff_id long, seed_ordinal int, query_id string, language string")
    changed = spark.createDataFrame([], "diff_id long, symbol_id string")
    got = package.vector_neighbors(hits, seeds, changed, docs).orderBy("place")
    assert [tuple(r) for r in got.select("symbol_id", "path", "kind", "qualified_name", "start_line", "end_line").collect()] == [("r1", "", "", "nm", 0, 0), ("r2", "/p", "function", "r2", 3, 4), ("s3", "/p", "function", "q3", 5, 6)]
    assert got.where(F.col("language") == "c").count() == 3


def test_equal_vectors_are_searched_for_once(spark, monkeypatch):
    """Ids that share vectors, of queries as of documents, get all that is theirs; vectors too long for squares in double precision too."""
    monkeypatch.setattr(documents, "BLOCK", 6)
    searched = []
    monkeypatch.setattr(documents, "_to_pivots", lambda rows, pivots, plain=documents._to_pivots: searched.append(rows.count()) or plain(rows, pivots))
    vectors = [[float(i), 1.0] for i in range(8)] + [[-0.0, 3.0], [0.0, 3.0], [1e200, 0.0], [1e200, 1.0]]
    docs = [(f"d{i:03}", "c" if i % 5 else "java", vectors[i % 12]) for i in range(120)] + [("d000", "c", vectors[3])]
    queries = [(f"q{i:03}", "c", vectors[i % 12]) for i in range(60)]
    a, b = spark.createDataFrame(queries, Q), spark.createDataFrame(docs, D).repartition(3)
    for k in (1, 9, 25):
        got = sorted((r.query_id, r.id, r["rank"]) for r in documents.similar(a, b, k).collect())
        with np.errstate(over="ignore"):
            assert got == [w[:3] for w in _plain(queries, docs, k)]
    assert searched[1::2] == [11, 11, 11], "queries that are compared"
