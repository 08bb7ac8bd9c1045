"""Dyadic blocks, the joins that use them, and walks by frontiers."""

import random

from pyspark.sql import functions as F

from codegraph.functions.intervals import dyadic, stab
from codegraph.operators import changed, explore, relations


def test_blocks_are_disjoint_and_few(spark):
    rng = random.Random(1)
    rows = [(0, 0), (0, 1), (1, 1), (1, 2), (0, 1023), (1, 1022), (7, 8), (0, 500_000 // 32)] + [(lambda a, b: (min(a, b), max(a, b)))(rng.randrange(5000), rng.randrange(5000)) for _ in range(200)]
    for r in spark.createDataFrame(rows, "lo long, hi long").select("lo", "hi", dyadic(F.col("lo"), F.col("hi")).alias("b")).collect():
        held = sorted(x for b in r.b for x in range(b["at"] << b["level"], (b["at"] + 1) << b["level"]))
        assert held == list(range(r.lo, r.hi + 1)) and len(r.b) <= 2 * (r.hi - r.lo + 1).bit_length()


def test_points_meet_the_intervals_around_them_once(spark):
    rng = random.Random(2)
    points = [(i, rng.choice("ab"), rng.randrange(-3, 3000)) for i in range(150)]
    spans = [(i, rng.choice("abc"), a := rng.randrange(-3, 2500), a + rng.choice((-2, 0, 5, 40, 900))) for i in range(100)]
    p = spark.createDataFrame(points, "p long, path string, x int")
    s = spark.createDataFrame(spans, "s long, path string, lo int, hi int")
    for unit in (1, 32):
        got = stab(p, s, ["path"], "x", "lo", "hi", unit).collect()
        at = lambda x: max(x, 0) // unit
        want = sorted((i, j) for i, k, x in points for j, m, lo, hi in spans if k == m and at(lo) <= at(x) <= at(max(lo, hi)))
        assert sorted((r.p, r.s) for r in got) == want


def test_a_long_class_is_few_rows(spark):
    s = spark.createDataFrame([("/a", 1, 500_000)], "path string, lo int, hi int")
    assert s.select(F.explode(dyadic(F.floor(F.col("lo") / 32), F.floor(F.col("hi") / 32)))).count() <= 28
    symbols = spark.createDataFrame([("c", "class", "/a", "C", None, 1, 1, 500_000, 9, 1), ("m", "method", "/a", "C.m", "C", 400_000, 5, 400_100, 9, 2)], "id string, kind string, path string, qualified_name string, parent_name string, start_line int, start_column int, end_line int, end_column int, ordinal int")
    spans = spark.createDataFrame([("/a", i, n, 6, n, 9) for i, n in enumerate((2, 399_999, 400_000, 400_050, 400_101, 499_999))], "path string, node_id long, start_line int, start_column int, end_line int, end_column int")
    got = {r.node_id: r.owner.id for r in relations.enclosing_symbol(spans, symbols).collect()}
    assert got == {0: "c", 1: "c", 2: "m", 3: "m", 4: "c", 5: "c"}


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(3)
    ranges = [(1, i, f"/{i % 3}", 0, rng.randrange(300), rng.choice((0, 1, 2, 50, 200))) for i in range(60)]
    symbols = [(f"s{i}", f"/{i % 4}", i, a := rng.randrange(1, 250), a + rng.choice((0, 3, 60, 250))) for i in range(60)]
    r = spark.createDataFrame(ranges, "diff_id long, file_ordinal long, path string, range_ordinal int, range_start int, range_count int")
    s = spark.createDataFrame(symbols, "id string, path string, ordinal int, start_line int, end_line int")
    got = sorted((x.file_ordinal, x.symbol_id) for x in changed.overlap_symbols(r, s).collect())
    assert got == sorted((i, k) for _, i, p, _, a, n in ranges for k, q, _, lo, hi in symbols if p == q and lo <= a + max(n - 1, 0) and hi >= a)


def test_few_seeds_shuffle_few_edges(spark):
    """The edges meet a broadcast frontier before anything of them is exchanged; a large frontier gives the same."""
    edges = spark.range(2000).select(F.concat(F.lit("calls:n"), "id").alias("id"), F.lit("calls").alias("kind"), F.concat(F.lit("n"), F.col("id") % 97).alias("source_id"), F.concat(F.lit("n"), F.col("id") % 89).alias("destination_id"))
    adj, seeds = explore.adjacency(edges), spark.createDataFrame([("n1",), ("n2",), ("gone",)], "id string")
    plan = explore.steps_from(seeds.select(F.col("id").alias("here")), adj)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
    want = sorted(map(str, explore.best_paths(explore.paths(seeds, adj)).collect()))
    assert sorted(map(str, explore.nearest_paths(seeds, adj).collect())) == want
    before, explore.FRONTIER_BYTES = explore.FRONTIER_BYTES, -1
    try:
        assert sorted(map(str, explore.nearest_paths(seeds, adj).collect())) == want
    finally:
        explore.FRONTIER_BYTES = before
