"""The pipeline on small tables, each stage held against a plain version of what it decides."""

import random

import pytest

import __spark_entry__
import corpus_pipeline
from codegraph.llm import decontaminate, mixing
from codegraph.llm.shared import stage
from plain_models import targets


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda base: "".join(rng.choice(base) for _ in range(rng.randint(2, 7)))
    text = lambda n, base="abcdefgh": " ".join(word(base) for _ in range(n))
    item = text(30)
    rows = [(i, text(rng.randint(20, 150), "klmnop" if i % 4 == 0 else "abcdefgh"), "xx" if i % 4 == 0 else "yy", f"src{i % 3}") for i in range(80)]
    rows += [(100 + i, rows[i % 5][1], rows[i % 5][2], "src1") for i in range(12)]
    rows += [(200, text(40) + " " + item + " " + text(40), "yy", "src0"), (201, None, "yy", "src0"), (202, "... 123", "yy", "src0"), (203, "", None, None), (204, text(50), None, None)]
    out = tmp_path_factory.mktemp("tables")
    docs = [(i, t, k, s, None if t is None else len(t)) for i, t, k, s in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def _shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language_id", "simhash_dedup", "decontamination", "mixing", "sharding"]
    before = {r.doc_id: r for r in docs.collect()}
    kept = {}
    for name, step in steps.items():
        docs = stage(step(spark, docs, sf_dir), name)
        kept[name] = docs.collect()
        if name != "sharding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in kept["language_id"]} == set(before) - {201, 202, 203}
    sets = {r.doc_id: _shingles(r.text) for r in kept["language_id"]}
    groups = {}
    for i in sorted(sets):
        near = {groups[j] for j in groups if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
        for j in groups:
            if groups[j] in near:
                groups[j] = min(near)
        groups[i] = min(near | {i})
    assert {r.doc_id for r in kept["simhash_dedup"]} == set(groups.values())
    assert {r.doc_id for r in kept["decontamination"]} == set(groups.values()) - {200}
    assert all(r == before[r.doc_id] for r in kept["decontamination"])
    size = lambda rows: sum(len(r.text.split()) for r in rows)
    names = sorted({r.source for r in kept["decontamination"]}, key=lambda s: (s is None, s or ""))
    sizes = [size(r for r in kept["decontamination"] if r.source == s) for s in names]
    for s, want in zip(names, targets(sizes, [5, 2, 1, 5])):
        assert abs(size(r for r in kept["mixing"] if r.source == s) - want) <= 2 * mixing.BLOCK_WORDS
    assert all(set(r.text.split()) <= set(before[r.doc_id].text.split()) and r.n_chars == len(r.text) for r in kept["mixing"])
    last = kept["sharding"]
    assert len(last) == len(kept["mixing"])
    for s in range(16):
        assert sorted(r.slot for r in last if r.shard == s) == list(range(len(last) // 16 + (s < len(last) % 16)))


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    """Columns with the names that stages use inside are kept as they are; all texts are clean and differ."""
    rng = random.Random(5)
    names = ("spans", "row", "doc", "found_lang", "found_score", "part", "at", "got", "h", "node", "item", "src")
    rows = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)), "yy", "s", 9, *[f"{n}{i}" for n in names]) for i in range(20)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *names])
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
        got = docs.collect()
        assert len(got) == 20 and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names), name


def test_run_is_the_registered_query(spark, sf_dir):
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    a, b = (sorted((r.doc_id, r.text) for r in corpus_pipeline.run(spark, sf_dir).collect()) for _ in range(2))
    assert a == b and a


def test_empty_tables(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_without_an_id_are_kept_by_the_filters(spark):
    docs = spark.createDataFrame([(None, "one two three four five six"), (1, "one two three four five six")], "doc_id long, text string")
    items = spark.createDataFrame([(0, "one two three four five six")], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.decontaminate(docs, items).collect()] == [None]
