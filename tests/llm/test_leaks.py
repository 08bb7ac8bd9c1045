"""Leaks are found through the sketches and dropped row by row."""

import random

import corpus_pipeline
from codegraph.llm import decontaminate


def test_only_rows_that_share_a_sketch_are_candidates(spark):
    rng = random.Random(3)
    item = [f"w{i}" for i in range(60)]
    items = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    known = decontaminate.item_shingles(items)
    sketch = {r.shingle for r in known.where("in_sketch").collect()}
    outside = [" ".join(item[i : i + 5]) for i in range(56) if " ".join(item[i : i + 5]) not in sketch]
    assert outside
    hits = known.where("not in_sketch").select("h", "shingle").selectExpr("1L as row", "h", "shingle")
    assert decontaminate._candidates(hits, known).count() == 0
    docs, want = [], set()
    for i in range(60):
        w = [x if rng.random() > i / 300 else "other" for x in item]
        have = {tuple(w[j : j + 5]) for j in range(56)} & {tuple(item[j : j + 5]) for j in range(56)}
        docs.append((i, " ".join(w)))
        want |= {(i, len(have))} if 10 * len(have) >= 8 * 56 else set()
    got = decontaminate.contained(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.matched) for r in got} == want and 0 < len(want) < 60


def test_leaking_rows_without_an_id_go_and_clean_ones_with_the_same_id_stay(spark, tmp_path):
    leak = "one two three four five six seven"
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, f"a {leak} b"), (None, "clean text"), (1, leak), (1, "also clean"), (2, None)], "doc_id long, text string")
    got = corpus_pipeline.drop_leaks(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, [r for r in docs.collect() if leak not in (r.text or "")]))


def test_a_phrase_of_all_items_and_many_documents_makes_few_candidates(spark):
    """The phrase is in each item; it is no part of the sketch of an item that has enough other shingles."""
    rng = random.Random(4)
    phrase = "the same words stand in every item"
    items = [(i, " ".join(f"i{i}w{j}" for j in range(40)) + " " + phrase) for i in range(30)]
    docs = [(i, " ".join(f"d{rng.randrange(10**6)}" for _ in range(50)) + " " + phrase) for i in range(200)] + [(900 + i, t) for i, t in items[:3]]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    known = decontaminate.item_shingles(items)
    assert known.where("in_sketch").where("shingle like 'the same words%'").count() == 0
    got = decontaminate.contained(docs, items)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(900, 0), (901, 1), (902, 2)]


def test_without_the_sketch_there_are_other_candidates(spark):
    item = [f"w{i}" for i in range(60)]
    known = decontaminate.item_shingles(spark.createDataFrame([(0, " ".join(item))], "item_id long, text string"))
    hits = known.selectExpr("cast(in_sketch as long) as row", "h", "shingle")
    assert [r.row for r in decontaminate._candidates(hits, known).collect()] == [1]
    assert decontaminate._candidates(hits, known.withColumn("in_sketch", known.h.isNotNull())).count() == 2
