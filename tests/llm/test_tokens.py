"""Encoding by distinct words, alignment of tokenizers, and hard negatives."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codegraph.llm import alignment, blocks, hard_negatives, pieces
from codegraph.llm.queries import tokenizer_file

MODEL, BYTES = tokenizer_file("piece_bpe_32k.model"), tokenizer_file("byte_bpe_50k.json")
ODD = ["", None, " ", "  two  blanks ", "\n\ta\r\n", "▁ a mark ▁▁x", "<s> not a token </s>", "<|endoftext|> x", "日本語のテキスト 🙂🙂", "é ﬁ  x　y", "a" * 3000, "word " * 2000, "\x00\x01", "ab cd", "ab cd", "<0x41> <unk>"]


def test_encoding_is_that_of_the_library(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "no id", "x"), (3, "ab cd", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string").repartition(3)
    ids = pieces.encode(docs, MODEL)
    got = ids.select("doc_id", "piece_ids", pieces.decode(F.col("piece_ids"), MODEL).alias("text")).collect()
    sp = pieces.processor(MODEL)
    want = Counter((i, tuple(sp.encode(t or "")), sp.decode(sp.encode(t or ""))) for i, t, _ in rows)
    assert Counter((r.doc_id, tuple(r.piece_ids), r.text) for r in got) == want
    assert pieces.encode(docs.limit(0), MODEL).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" ▁\n\tab<s>"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_words_segment_alone(text):
    sp = pieces.processor(MODEL)
    words = pieces.marked_words(text, MODEL)
    assert [i for ids in pieces.segment(words, MODEL) for i in ids] == sp.encode(text)


def test_a_model_whose_pieces_cross_marks_is_refused(monkeypatch):
    class Crossing:
        get_piece_size = lambda self: 3
        id_to_piece = lambda self, i: ["▁a", "a▁b", "▁"][i]
        piece_to_id = lambda self, p: 2

    monkeypatch.setattr(pieces, "processor", lambda model: Crossing())
    with pytest.raises(ValueError, match="cross"):
        pieces.check("m")


def test_each_word_of_a_table_is_segmented_once(monkeypatch):
    asked, whole = [], pieces.segment
    monkeypatch.setattr(pieces, "segment", lambda words, model: asked.extend(words) or whole(words, model))
    table, sp = pieces.Table(MODEL), pieces.processor(MODEL)
    for texts in (["one two  two", "", "two one "], ["three one"], []):
        for text, codes in zip(texts, table.codes(texts)):
            assert table.ids(np.array(codes, np.int64)).tolist() == sp.encode(text)
    assert len(asked) == len(set(asked)) == len(table.known)


def test_often_used_keys_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(blocks, "HEAVY", 4)
    monkeypatch.setattr(blocks, "HEAVY_LENGTH", 3)
    words = ["ab"] * 30 + ["a long word"] * 30 + [f"w{i}" for i in range(10)]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "at int, word string")
    table = rows.groupBy("word").agg(F.count("*").alias("weight"), F.length("word").alias("n"))
    got = blocks.lookup(rows, table, ["word"])
    assert sorted((r.at, r.n) for r in got.collect()) == [(i, len(w)) for i, w in enumerate(words)]


def plain_alignment(text):
    left, right = alignment.byte_level(BYTES), alignment.sentence_pieces(MODEL)
    if not text:
        return [], [], [], []
    a, b = left.encode([" " + text])[0], right.encode([text])[0]
    raw = (" " + text).encode()
    if b"".join(left.tokens[i] for i in a) != raw or b"".join(right.tokens[i] for i in b) != raw:
        return [], [], [], []

    def spans(ids, side):
        out, at = [], 0
        for i in ids:
            out.append((at, at := at + len(side.tokens[i])))
        return out

    sa, sb = spans(a, left), spans(b, right)
    links = [(i, j) for i, (s, e) in enumerate(sa) for j, (u, v) in enumerate(sb) if max(s, u) < min(e, v)]
    groups, before = [], 0
    for end in sorted({e for _, e in sa} & {e for _, e in sb}):
        groups.append(([i for i, (s, e) in zip(a, sa) if before <= s and e <= end], [i for i, (s, e) in zip(b, sb) if before <= s and e <= end]))
        before = end
    return a, b, groups, links


def test_alignment_against_all_pairs(spark):
    pick = random.Random(3)
    texts = [t if t is None or len(t) < 500 else t[:300] for t in ODD] + ["".join(pick.choice(["the ", "unhappi", "ness", "é", "東京", "🙂", "  ", "\n", "12", "x▁"]) for _ in range(pick.randrange(30))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "the end"), (2, "the end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit(1)).repartition(3)
    plain = [(i, *plain_alignment(t)) for i, t in rows]
    counts = Counter((a[i], b[j]) for _, a, b, _, links in plain for i, j in links)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    want = Counter()
    for doc, a, b, groups, links in plain:
        met = [counts[a[i], b[j]] for i, j in links]
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        want[doc, len(a), len(b), len(groups), len(links), sum(counts[a[i], b[j]] == best[b[j]] for i, j in links), sum(met), hashlib.sha256(shown.encode()).hexdigest() if a else ""] += 1
    got = alignment.link_counts(docs, BYTES, MODEL)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == want
    aligned = alignment.align(docs, BYTES, MODEL).collect()
    assert Counter((r.doc_id, tuple(r.ids_a), tuple(r.ids_b), len(r.cuts_a)) for r in aligned) == Counter((d, tuple(a), tuple(b), len(g)) for d, a, b, g, _ in plain)
    assert alignment.link_counts(docs.limit(0), BYTES, MODEL).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("  ab'sé東🙂\n\t1\xa0\x85\u3000."), st.characters(exclude_categories=["Cs"])), min_size=1, max_size=40))
def test_words_align_alone(text):
    left, right = alignment.byte_level(BYTES), alignment.sentence_pieces(MODEL)
    words = alignment.words_of(text)
    assert "".join(words) == " " + text
    ((a, b),) = alignment.tokens_of([text], left, right)
    if a:
        assert [i for ids in left.encode(words) for i in ids] == a
        assert [i for ids in right.encode([w[1:] for w in words]) for i in ids] == b
        found = alignment.cuts(a, b, left, right)
        met = alignment.links(a, b, *found, left, right)
        plain = plain_alignment(text)
        assert sorted(met) == sorted(alignment.pair(a[i], b[j]) for i, j in plain[3]) and len(met) == len(a) + len(b) - len(found[0])
        alone = alignment.Words(words, left, right)
        assert alone.links == met and ";".join(alone.groups) == alignment.groups_text(a, b, *found, left, right)


def plain_negatives(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    known = [(n, i, label, v) for n, (i, label, v) in enumerate(rows) if i is not None and label is not None and v is not None]
    out = []
    for n, i, label, v in known:
        if not is_anchor(i):
            continue
        others = sorted((-sum(x * y for x, y in zip(v, w)), j, m, k) for m, j, k, w in known if m != n and len(w) == len(v))
        for p, j, _, _ in [o for o in others if o[3] == label][:positives]:
            fitting = [o for o in others if o[3] != label and low * -p <= 100 * -o[0] <= high * -p][:negatives]
            out += [(i, j, r, o[1], -p, -o[0]) for r, o in enumerate(fitting, 1)]
    return Counter(out)


@pytest.mark.parametrize("shape", ["spread", "groups", "copies", "odd"])
def test_hard_negatives_against_all_scores(spark, monkeypatch, shape):
    monkeypatch.setattr(hard_negatives, "BLOCK", 40)
    monkeypatch.setattr(hard_negatives, "LEAF", 4)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 8)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(6, 8)) * 60
    rows = []
    for n in range(300):
        noise = rng.normal(size=8) * {"spread": 60, "groups": 6, "copies": 0, "odd": 3}[shape]
        v = (noise if shape == "spread" else centers[n % 6] + noise).astype(int).tolist()
        if shape == "odd":
            v = None if n % 17 == 0 else [0] * 8 if n % 11 == 0 else v[:5] if n % 5 == 0 else v
        rows.append((n if shape != "odd" or n % 23 else None if n % 2 else n - 1, None if shape == "odd" and n % 13 == 0 else int(rng.integers(0, 4)), v))
    df = spark.createDataFrame(rows, "vec_id long, label int, v array<int>").withColumn("row", F.lit("x"))
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0)
    assert Counter(map(tuple, got.collect())) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_bounds_hold_and_windows_skip_nodes():
    rng = np.random.default_rng(2)
    x = np.floor(np.concatenate([c + rng.normal(size=(60, 6)) * 3 for c in rng.normal(size=(20, 6)) * 90]))
    labels = np.repeat(np.arange(20) % 3, 60)
    tree = hard_negatives.Tree(x, labels, float(np.sqrt((x * x).sum(axis=1).max())))
    under = lambda n: tree.points[n] if not len(tree.below[n]) else np.concatenate([under(b) for b in tree.below[n]])
    nodes = np.arange(len(tree.centers))
    assert sorted(under(0).tolist()) == list(range(len(x))) and len(nodes) > 20
    for anchor in x[::97]:
        low, high = tree.bounds(nodes, anchor, float(np.sqrt(anchor @ anchor)))
        for n in nodes:
            scores = x[under(n)] @ anchor
            assert low[n] <= scores.min() and scores.max() <= high[n]
    scored = []
    wanted = hard_negatives.Wanted(3, [(0, float(x[0] @ x[0]) * 0.95)], [-np.inf], np.arange(len(x)), False, None)
    offer = wanted.offer
    wanted.offer = lambda part, scores: (scored.append(len(part)), offer(part, scores))
    tree.search(x[0], 0, wanted)
    best = sorted((-float(x[i] @ x[0]), i) for i in range(len(x)) if labels[i] != 0 and 0 <= x[i] @ x[0] <= 0.95 * (x[0] @ x[0]))[:3]
    assert [(s, i) for s, i, _ in wanted.found[0]] == best and sum(scored) < len(x) / 2


def test_quantised_components(spark):
    df = spark.sql("select * from values (array(0.5D, -0.001D)), (array(1D, null)), (array(double('nan'))), (array(double('-infinity'))), (null), (array(4096D)), (array()) as t(e)")
    assert [r[0] for r in df.select(hard_negatives.quantised(F.col("e"))).collect()] == [[128, -1], None, None, None, None, None, []]
    empty = spark.createDataFrame([], "vec_id long, label int, v array<int>")
    assert hard_negatives.mine(empty, F.lit(True)).count() == 0
