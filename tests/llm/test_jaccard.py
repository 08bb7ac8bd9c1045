"""The pipeline's near-dedup held against all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from codegraph.llm import jaccard, shared, simhash


def _grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def _expected(rows):
    """Places of the rows that stay, by comparing all pairs."""
    sets, group = [_grams(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    best = {}
    for i, g in enumerate(group):
        best[g] = min(best.get(g, i), i, key=lambda x: (rows[x][0] is None, rows[x][0] or 0))
    return sorted(((rows[i][0] is None, rows[i][0] or 0, rows[i][1] or "") for i in best.values()))


def _edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def _check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got) == _expected(rows)


def test_rows_of_files_have_stable_numbers(spark, tmp_path):
    spark.range(1000).selectExpr("id as doc_id", "cast(id as string) text", "id as file", "id as number", "id as `a.b`").repartition(3).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    rows = shared.with_rows(docs, "row")
    first = {r.doc_id: r.row for r in rows.select("doc_id", "row").collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert {r.doc_id: r.row for r in rows.where("doc_id % 2 = 0").collect()} == {i: n for i, n in first.items() if i % 2 == 0}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(set(first.values())) == 1000 and rows.columns == [*docs.columns, "row"]
    derived = shared.with_rows(docs.where("doc_id < 10"), "row")
    assert derived.count() == 10 == derived.select("row").distinct().count()
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == 1000


@pytest.mark.parametrize("block, small", [(1024, 16), (4, 2)])
def test_near_dedup_against_all_pairs(spark, monkeypatch, block, small):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SMALL", small)
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(300)}" for _ in range(n)) for n in (30, 80, 150, 150, 200)]
    line = " ".join(f"common{i}" for i in range(40))
    rows = [(i, _edited(rng, rng.choice(base), rng.choice((0, 1, 2, 3, 5, 8)))) for i in range(120)]
    rows += [(200 + i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(60)) + " " + line) for i in range(20)]
    rows += [(300, None), (301, ""), (302, "A b"), (303, "a  B"), (304, "a b c")]
    assert 20 < len(_expected(rows)) < len(rows) - 20
    _check(spark, rows)


def test_near_copies_one_changed_word_apart(spark):
    text = " ".join(f"w{i}" for i in range(100))
    _check(spark, [(1, text), (2, text.replace("w50 ", "other ")), (3, " ".join(f"v{i}" for i in range(100)))])


def test_copies_without_an_id_or_with_the_same_id(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (None, text + " end"), (4, text), (4, text), (None, "alone " * 9), (None, "alone " * 9), (4, "quite another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(4, text), (None, "alone " * 9), (4, "quite another text")], key=str)


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(1)
    fill = rng.integers(0, 50, 1 << jaccard.SLOT_BITS)
    for n in range(1, 120):
        a = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        keep = a[rng.permutation(len(a))[: -(-len(a) * 4 // 5)]]
        assert set(jaccard.prefix(a, fill)) & set(jaccard.prefix(keep, fill))


def _apart(a, b):
    return ((jaccard.word_print(a) ^ jaccard.word_print(b)) & (1 << 64) - 1).bit_count()


def test_pairs_within_the_radius_come_from_the_covering_tables(spark, monkeypatch):
    """Without the tables such a pair isn't found; pairs farther apart are found all the same."""
    rng = random.Random(3)
    texts = [" ".join(f"{c}{i}" for i in range(200)) for c in "vw"]
    edits = [[_edited(rng, t, 1) for _ in range(200)] for t in texts]
    near = next(e for e in edits[0] if 0 < _apart(texts[0], e) <= simhash.RADIUS)
    far = max(edits[1], key=lambda e: _apart(texts[1], e))
    assert _apart(texts[1], far) > simhash.RADIUS
    rows = [(1, texts[0]), (2, near), (3, texts[1]), (4, far)]
    _check(spark, rows)
    links = simhash.near_links
    monkeypatch.setattr(jaccard, "near_links", lambda *a, **k: links(*a, **k).limit(0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 2, 3]


def test_texts_of_the_same_words_in_other_orders(spark):
    """Their fingerprints are equal: those of few texts are looked up in the tables, those of many aren't."""
    rng, texts = random.Random(4), []
    for base, n in (("x", 4), ("y", 30)):
        for _ in range(n):
            w = [f"{base}{i}" for i in range(120)]
            rng.shuffle(w)
            texts.append(" ".join(w))
            if rng.random() < 0.6:
                i = rng.randrange(119)
                w[i], w[i + 1] = w[i + 1], w[i]
                texts.append(" ".join(w))
    rows = list(enumerate(texts))
    assert 34 == len(_expected(rows)) < len(rows)
    _check(spark, rows)


def test_all_pairs_of_fingerprints_within_the_radius(spark):
    rng, prints = random.Random(6), set()
    for size in (400, 10):
        base = rng.getrandbits(64)
        for _ in range(size):
            x = base
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(24)
            prints.add(x - (1 << 64) if x >> 63 else x)
    prints = sorted(prints)
    want = {(a, b) for a in prints for b in prints if a > b and ((a ^ b) & (1 << 64) - 1).bit_count() <= simhash.RADIUS}
    got = simhash.near_links(spark.createDataFrame([(x, x) for x in prints], "fp long, node long"), every=True).collect()
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want
