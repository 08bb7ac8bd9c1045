"""Operators on pages, vectors and whole corpora."""

import base64
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from codegraph.llm import mixing, multiindex, prp, sharding, urlfilter, warc
from codegraph.llm.shared import WORD
from plain_models import targets


def _permuted(i, n, key):
    return int(prp.permute(np.array([i]), np.array([n]), key)[0])


def test_permutations_are_bijections():
    for n in (0, 1, 2, 3, 7, 64, 1000):
        for key in (1, 99):
            assert sorted(prp.permute(np.arange(n), n, key)) == list(range(n))
    big = prp.permute(np.arange(1000), 10**15 + 3, 5)
    assert len(set(big)) == 1000 and big.max() < 10**15 + 3
    both = prp.permute(np.array([0, 1, 2, 0, 1]), np.array([3, 3, 3, 2, 2]), np.array([4, 4, 4, 5, 5]))
    assert sorted(both[:3]) == [0, 1, 2] and sorted(both[3:]) == [0, 1]


def test_the_matrix_has_exact_sums():
    m = sharding.communication_matrix([10, 0, 33, 7, 1], 4, 1)
    assert m.sum(axis=1).tolist() == [10, 0, 33, 7, 1] and m.sum(axis=0).tolist() == [13, 13, 13, 12] and (m >= 0).all()
    means = sum(sharding.communication_matrix([8, 24], 4, s) for s in range(300)) / 300
    assert abs(means[0] - 2).max() < 0.3


def test_a_shuffle_against_a_plain_model(spark):
    """The place of each row, step by step in plain Python: lanes, the matrix, and both permutations."""
    df = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(101)], "doc_id long, `a.b` string").repartition(5).cache()
    placed = df.select("doc_id", F.spark_partition_id().alias("part")).collect()
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(df, shards=4, seed=3).collect()}
    lanes = [[r.doc_id for r in placed if r.part == p] for p in range(1 + max(r.part for r in placed))]
    matrix = sharding.communication_matrix([len(x) for x in lanes], 4, 3)
    want, arrived = {}, [0] * 4
    for lane, ids in enumerate(lanes):
        for at, i in enumerate(ids):
            local = _permuted(at, len(ids), prp.key_of(3, 1, lane))
            to = next(k for k in range(4) if local < matrix[lane, : k + 1].sum())
            place = arrived[to] + local - int(matrix[lane, :to].sum())
            want[i] = (to, _permuted(place, int(matrix[:, to].sum()), prp.key_of(3, 2, to)))
        arrived = [a + int(m) for a, m in zip(arrived, matrix[lane])]
    assert got == want


@pytest.mark.parametrize("good, bad, n", [(7, 9, 5), (3, 100, 50), (50, 50, 50), (1, 1, 1), (5, 0, 3), (1000, 3, 900)])
def test_the_draw_is_hypergeometric(good, bad, n):
    rng, got = np.random.default_rng(1), {}
    for _ in range(8000):
        k = sharding.hypergeometric(rng, good, bad, n)
        got[k] = got.get(k, 0) + 1
    want = {k: math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(max(0, n - bad), min(n, good) + 1)}
    assert set(got) <= set(want) and max(abs(got.get(k, 0) / 8000 - p) for k, p in want.items()) < 0.025


@pytest.mark.parametrize("total", [10**8, 999_999_999, 10**9, 10**9 + 1, 10**11, 10**13])
def test_the_draw_is_the_same_law_at_every_size(total):
    """Mean and spread on both sides of 10**9, where numpy's own generator ends."""
    rng, good, n = np.random.default_rng(2), total // 16, total // 1000
    x = np.array([sharding.hypergeometric(rng, good, total - good, n) for _ in range(400)], np.float64)
    mean, spread = n * good / total, math.sqrt(n * (good / total) * (1 - good / total) * (total - n) / (total - 1))
    assert abs(x.mean() - mean) < 5 * spread / 20 and 0.85 < x.std() / spread < 1.15


@pytest.mark.parametrize("n", [0, 1, 15, 16, 500])
def test_shards_are_exact_and_slots_gapless(spark, n):
    rows = [(i // 3, None if i % 5 == 0 else "copy", i, "old") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, part string, at int, slot string").repartition(5)
    got = sharding.shard(df).collect()
    assert sorted((r.doc_id, r.part or "", r["at"]) for r in got) == sorted((a, b or "", c) for a, b, c, _ in rows)
    for s in range(16):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(n // 16 + (s < n % 16)))


def test_slices_have_a_bound_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLICE_BYTES", 1000)
    df = spark.createDataFrame([(i, "x" * 100) for i in range(1600)], "doc_id long, text string")
    got = sharding.shard(df)
    assert got.rdd.getNumPartitions() == 160 and sorted((r.shard, r.slot) for r in got.collect()) == [(s, i) for s in range(16) for i in range(100)]


def test_shards_rerun_alike_and_mix_the_input(spark):
    df = spark.range(2000).withColumnRenamed("id", "doc_id")
    a, b = ({r.doc_id: (r.shard, r.slot) for r in sharding.shard(df).collect()} for _ in range(2))
    assert a == b
    first = [a[i][0] for i in range(500)]
    assert all(10 < first.count(s) < 60 for s in range(16))
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.shard(df, seed=5).collect()} != a


def _targets(spark, names, sizes, **how):
    df = spark.createDataFrame([*zip(names, sizes, [1] * len(sizes))], "source string, source_size long, n_rows long").repartition(3)
    return {r.source: r.target for r in mixing.with_targets(df, **how).collect()}


def test_targets_stop_at_the_cap(spark):
    for sizes in ([10, 10, 10], [1, 100, 100], [0, 4], [0, 0], [], [1, 2, 4, 8, 16, 1000, 3], [7]):
        names = [chr(97 + i) for i in range(len(sizes))]
        assert _targets(spark, names, sizes) == pytest.approx(dict(zip(names, targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))]))))
    assert targets([1, 100, 100], [5, 2, 1]) == pytest.approx([3, 132, 66])
    names = ["é", "z", "Z", "日本", "\U0001f600", None]
    by_place = ["Z", "z", "é", "日本", "\U0001f600", None]
    assert _targets(spark, names, [10] * 6) == pytest.approx(dict(zip(by_place, targets([10] * 6, [5, 2, 1, 5, 2, 1]))))


def test_counts_of_shards_are_multivariate_hypergeometric(spark):
    rows = [(i, i, f"s{i % 7}", 32 * (1 + i % 5)) for i in range(2000)]
    plan = mixing.Plan(spark.createDataFrame(rows, "row long, id long, source string, size long"))
    due = {r.src: r.due for r in plan.sources.collect()}
    counts = {r.src: r.counts for r in plan.shard_counts().collect()}
    assert {k: sum(v) for k, v in counts.items()} == due
    # Multinomial counts given both sums: the variance has a factor for what the other sources leave.
    total = sum(due.values())
    z = [(n - due[k] / 16) / math.sqrt(due[k] * 15 / 256 * (total - due[k]) / (total - 1)) for k, v in counts.items() for n in v]
    assert max(map(abs, z)) < 5 and 0.6 < sum(x * x for x in z) / len(z) < 1.5
    slots = plan.slots().groupBy("shard", "src").count().collect()
    assert {(r.shard, r.src): r["count"] for r in slots} == {(i, k): n for k, v in counts.items() for i, n in enumerate(v) if n}


def test_mix_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, None if i % 41 == 0 else " ".join("w%d" % rng.randrange(99) for _ in range(rng.randrange(0, 200))), rng.choice(["b", "a", "a", "a", None])) for i in range(300)]
    rows += [(999, "long " * 30000, "c"), (1000, "tiny", "d"), (1001, "", "e"), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame([(i, t, s, 1, 2, "x", 3) for i, t, s in rows], "doc_id long, text string, source string, row int, size int, spans string, src int")
    got = mixing.mix_sizes(docs).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(WORD, t or ""))
    names = ["a", "b", "c", "d", "e", None]
    sizes = [sum(size(t) for _, t, s in rows if s == n) for n in names]
    want = dict(zip(names, targets(sizes, [5, 2, 1, 5, 2, 1])))
    source = {i: s for i, _, s in rows}
    for r in got:
        assert r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == sizes[names.index(source[r.doc_id])] and r.taken <= 3 * r.size
    for n in names:
        taken = sum(r.taken for r in got if source[r.doc_id] == n)
        assert abs(taken - want[n]) <= 1.5 * mixing.BLOCK_WORDS
    again = mixing.mix_sizes(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got if r.doc_id != 5) == sorted((r.doc_id, r.taken) for r in again if r.doc_id != 5)
    mixed = mixing.mix(docs).collect()
    for i in {r.doc_id for r in got} - {5}:
        assert sum(size(r.text) for r in mixed if r.doc_id == i) == sum(r.taken for r in got if r.doc_id == i)
    assert mixed[0].asDict().keys() == docs.first().asDict().keys()
    assert mixing.mix_sizes(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def _mix_rows(spark, n=240):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(rng.randrange(0, 150))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


def test_what_the_mix_takes_against_a_plain_model(spark):
    rows, docs = _mix_rows(spark)
    got = {r.doc_id: r for r in mixing.mix_sizes(docs).collect()}
    at = {r.doc_id: r.at for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(mixing.SEED)).alias("at")).collect()}
    names, block = ["a", "b", "c", None], mixing.BLOCK_WORDS
    sizes = [sum(len(t.split()) for _, t, s in rows if s == n) for n in names]
    taken, total = {}, 0
    for src, (name, want) in enumerate(zip(names, targets(sizes, [5, 2, 1, 5]))):
        mine = [(i, t) for i, t, s in rows if s == name]
        chunks = max(1, -(-len(mine) // mixing.CHUNK_ROWS))
        words = [i for i, t in sorted(mine, key=lambda x: (at[x[0]] % chunks, at[x[0]])) for _ in t.split()]
        b = -(-len(words) // block)
        due = min(round(want * b / len(words)), 3 * b)
        total += due
        for j in range(due):
            k = _permuted(j % b, b, prp.key_of(mixing.SEED, src, j // b))
            for i in words[k * block : (k + 1) * block]:
                taken[i] = taken.get(i, 0) + 1
    assert {i: r.taken for i, r in got.items()} == {i: taken.get(i, 0) for i, _, _ in rows}
    assert all(sum(r.shard_words) == r.taken and len(r.shard_words) == 16 for r in got.values())


def test_the_drawn_counts_decide_the_shards(spark, monkeypatch):
    rows, docs = _mix_rows(spark)
    blocks = mixing.mix_blocks(docs).collect()
    by_shard, text, source = {}, dict((i, t) for i, t, _ in rows), {i: s for i, _, s in rows}
    for r in blocks:
        by_shard.setdefault(r.shard, []).append(r)
        assert len(r.text.split()) == r.n_words <= mixing.BLOCK_WORDS and {source[int(w[1:].split("_")[0])] for w in r.text.split()} == {r.source}
    sizes = [len(by_shard[k]) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(r.slot for r in v) == list(range(len(v))) for v in by_shard.values())
    got = {r.doc_id: (r.taken, r.shard_words) for r in mixing.mix_sizes(docs).collect()}
    words = {}
    for r in blocks:
        for w in r.text.split():
            doc, k = map(int, w[1:].split("_"))
            assert text[doc].split()[k] == w
            words.setdefault(doc, [0] * 16)[r.shard] += 1
    assert {i: g[1] for i, g in got.items() if g[0]} == words
    plan = mixing.Plan(spark.createDataFrame([(i, i, s, len(t.split())) for i, t, s in rows], "row long, id long, source string, size long"))
    counts = {r.src: r.counts for r in plan.shard_counts().collect()}
    due = {r.src: r.due for r in plan.sources.collect()}
    assert {s: sum(c) for s, c in counts.items()} == due and [sum(c[k] for c in counts.values()) for k in range(16)] == plan.room
    # Other counts with the same sums: the same words are taken, but they go to other shards.
    monkeypatch.setattr(mixing, "counts_with_sums", lambda rows, room, rng: sharding.counts_with_sums(rows, room, np.random.default_rng(99)))
    other = {r.doc_id: (r.taken, r.shard_words) for r in mixing.mix_sizes(docs).collect()}
    assert {i: g[0] for i, g in other.items()} == {i: g[0] for i, g in got.items()} and other != got


def test_sources_are_drawn_in_groups(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUPS", 3)
    rows = spark.createDataFrame([(i, i, f"s{i % 11:02}", 40 + i) for i in range(60)], "row long, id long, source string, size long")
    plan = mixing.Plan(rows, shards=4)
    drawn = plan.shard_counts().collect()
    due = {r.src: r.due for r in plan.sources.collect()}
    assert {r.src: sum(r.counts) for r in drawn} == due and [sum(r.counts[k] for r in drawn) for k in range(4)] == plan.room
    slots = plan.slots().collect()
    assert len({(r.shard, r.slot) for r in slots}) == len(slots) == sum(due.values()) and all(r.slot < plan.room[r.shard] for r in slots)


def test_running_starts_are_those_of_one_order(spark):
    rows = spark.range(5000).select(F.col("id").alias("row"), (F.col("id") % 2).cast("int").alias("src"), F.lit(2500).cast("long").alias("n_rows"), F.xxhash64("id").alias("at"), (F.col("id") % 7).alias("size"))
    got = sorted((r.src, r.start, r.size) for r in mixing.running_start(rows).collect() if r.size)
    for src in (0, 1):
        at = 0
        for _, start, size in (x for x in got if x[0] == src):
            assert start == at
            at += size


def gzip_head(spark, r):
    import gzip

    with open(r.file.removeprefix("file://"), "rb") as f:
        f.seek(r.offset)
        return gzip.decompress(f.read(r.length)).partition(b"\r\n\r\n")[0].decode()


def test_archives_round_trip(spark):
    html = ["<p>é</p>", "same", "same", "", None, "same", "big " * 100000, "x\r\n\r\ny", "<p>é</p>"]
    rows = [(i, None if i == 3 else f"http://h/{i}?a=%20 b\n", t, 1, "d") for i, t in enumerate(html)] + [(5, "http://again", "same", 1, "d"), (None, "u", "same", 1, "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int, digest string").repartition(3)
    index = warc.write_archives(pages)
    assert index.count() == len(rows) and index.where("length <= 0").count() == 0
    got = {(r.page_id, r.url): r for r in warc.read_records(index).collect()}
    assert len(got) == len(rows)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    last = {}
    for i, _, t, *_ in rows:
        if i is not None:
            last[t or ""] = max(i, last.get(t or "", -1))
    for i, u, t, *_ in rows:
        r, first = got[i, u], last[t or ""]
        assert (r.payload_bytes, r.payload_digest) == (len((t or "").encode()), digest(t))
        assert (r.record_type, r.refers_to) == (("response", None) if i == first else ("revisit", first))
        assert (None if r.payload is None else bytes(r.payload)) == ((t or "").encode() if r.record_type == "response" else None)
    heads = [re.search(r"WARC-Record-ID: (\S+)", gzip_head(spark, r))[1] for r in index.collect()]
    assert len(set(heads)) == len(rows)
    some = warc.read_records(index.where("page_id in (6, 7)")).collect()
    assert sorted(r.page_id for r in some) == [6, 7]
    assert warc.read_records(warc.write_archives(pages, min_bytes=5)).where("record_type = 'revisit'").count() == 1
    assert warc.read_records(warc.write_archives(pages.limit(0))).count() == 0


def test_target_uris_are_those_of_the_page():
    import gzip

    for url, target in (("http://h/a%20b?x=%C3%A9", "http://h/a%20b?x=%C3%A9"), ("http://h/a b%20c", "http://h/a%20b%20c"), ("http://h/é\n", "http://h/é%0A")):
        member = warc.record(1, url, b"p", warc.base32_sha1(b"p"), None)
        assert f"WARC-Target-URI: {target}\r\n" in gzip.decompress(member).decode() and warc.parse(member)[1] == url


def test_a_damaged_payload_fails():
    member = warc.record(1, "u", b"payload", warc.base32_sha1(b"payload"), None)
    assert warc.parse(member)[2] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, "u", b"payload", warc.base32_sha1(b"other"), None))


def _vectors(rng, n, copies):
    out = []
    for k in range(n):
        v = rng.normal(size=16)
        for _ in range(copies(k)):
            out.append((v + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.2, 0.35]), k % 3))
    return out


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    made = _vectors(rng, 120, lambda k: 90 if k == 0 else 1 + k % 4)
    rows = [(i, [float(x) for x in v], int(g)) for i, (v, g) in enumerate(made)]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [math.nan] + [1.0] * 15, 1), (1003, [None] + [1.0] * 15, 1), (1004, rows[0][1], None), (1005, [1.0, 2.0], 1), (1006, [math.inf] + [1.0] * 15, 1), (1007, rows[0][1], rows[0][2]), (1008, [2 * x for x in rows[0][1]], rows[0][2])]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "vec_id long, embedding array<double>, label int, w int, node int")
    good = [(i, np.array(v) / np.linalg.norm(v), g) for i, v, g in rows if i < 1000 or i in (1007, 1008)]
    pairs = [(a[0], b[0]) for a in good for b in good if a[0] < b[0] and a[2] == b[2] and a[1] @ b[1] >= 0.93]
    found = {r.vec_id: r for r in multiindex.near_duplicates(df).collect()}
    assert len(found) == len(rows)
    links = {i: 0 for i, *_ in rows}
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    assert all(found[i].n_links <= links[i] for i in links)
    assert sum(r.n_links for r in found.values()) >= 0.9 * sum(links.values()) > 0
    assert all(found[i].n_links == 0 and found[i].component_id == i and found[i].kept for i in (1000, 1001, 1002, 1003, 1004, 1005, 1006))
    assert found[1007].component_id == found[0].component_id == found[1008].component_id
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())
    assert multiindex.near_duplicates(df.limit(0)).count() == 0 and multiindex.near_duplicates(df.where("vec_id = 1001")).count() == 1


def test_vectors_of_each_length_meet_their_like(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v], g) for i, (v, g) in enumerate(_vectors(rng, 40, lambda k: 3))]
    rows += [(200, [1.0, 1.0], 1), (201, [2.0, 2.0], 1), (202, [1.0, -1.0], 1), (203, [1.0], 1), (204, [2.0], 1), (205, [-3.0], 1), (206, [], 1), (207, [1.0], 2), (208, [1.0, 1.0, 0.0], 1), (209, [1.0, 1.05, 0.0], 1)]
    rows += [(300 + i, [float(x) for x in np.append(v, v[:3])], 0) for i, (v, _) in enumerate(_vectors(rng, 30, lambda k: 2))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in multiindex.near_duplicates(df).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows if v}
    want = {i: sum(j != i and g == h and len(v) == len(w) and i in unit and j in unit and unit[i] @ unit[j] >= 0.93 for j, w, h in rows) for i, v, g in rows}
    assert got == want and got[200] == got[201] == got[203] == got[204] == 1 and got[205] == got[207] == 0


def test_recall_of_pairs_just_above_the_threshold(spark):
    """No near copies but pairs of cosine 0.93 to 0.95, and a third of all vectors in one tight group."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(3000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = rng.normal(size=(600, 64))
    away -= (away * base[:600]).sum(axis=1, keepdims=True) * base[:600]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cos = rng.uniform(0.9301, 0.95, (600, 1))
    near = cos * base[:600] + np.sqrt(1 - cos**2) * away
    tight = base[0] + rng.normal(size=(1000, 64)) * 0.002
    x = np.concatenate([base, near, tight])
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in multiindex.near_duplicates(df).collect()}
    assert sum(got[i] > 0 for i in range(3001, 3600)) >= 0.98 * 599


def test_cells_come_in_the_order_of_their_cost():
    rng = np.random.default_rng(2)
    d1, d2 = rng.random(9), rng.random(7)
    got = multiindex.multi_sequence(d1, d2, 0.6)
    cost = (d1[:, None] + d2[None, :]).ravel()
    want = [c for c in np.argsort(cost, kind="stable") if cost[c] <= cost.min() + 0.6]
    assert got == want


def test_rules_and_hosts(spark):
    urls = [
        ("http://A.Example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"), ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"), ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("http://x.com/fr/a", "x.com", "/fr/a", "com/fr/", "allow"), ("x://y.com/de/?q", "y.com", "/de/", "com/de/", "block"), ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("http://é.net#/p", "é.net", "", None, None),
        ("http://z.com", "z.com", "", None, None), ("http://org", "org", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("plain/org/", "", "", None, None), ("a://b.org/c://d", "b.org", "/c://d", "org/", "allow"),
    ]
    df = spark.createDataFrame([(i, u[0], "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urlfilter.judge(df).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert urlfilter.judge(df.limit(0)).count() == 0
    alone = urlfilter.judge(df.where("url is null or url like '%net%'")).collect()
    assert [r.verdict for r in alone] == ["allow", "allow"]


def _model_score(url, seen):
    """The score by plain counting: ``seen[good]`` maps a context and a byte (or None for any) to its count."""
    if not url:
        return 0.0
    b, total = bytes([2] * urlfilter.ORDER) + url.encode() + b"\x03", 0.0
    for i in range(urlfilter.ORDER, len(b)):
        for good, sign in ((True, 1), (False, -1)):
            p = 1 / 257
            for k in range(urlfilter.ORDER + 1):
                c = b[i - k : i]
                p = (seen[good].get((c, b[i]), 0) + urlfilter.TRUST * p) / (seen[good].get((c, None), 0) + urlfilter.TRUST)
            total += sign * math.log(p)
    return total / (len(b) - urlfilter.ORDER)


def test_the_models_against_brute_force(spark):
    rng = random.Random(1)
    word = lambda s: "".join(rng.choice(s) for _ in range(8))
    make = lambda good: f"http://{word('abcdef') if good else word('uvwxyz')}.net/{word('abc' if good else 'xyzé')}/{rng.randrange(99)}"
    rows = [(make(i % 3 > 0), i % 3 > 0, 1 + i % 2) for i in range(300)] + [("http://long/" + "a" * 20000, True, 1)]
    seen = {True: {}, False: {}}
    for url, good, n in rows:
        b = bytes([2] * urlfilter.ORDER) + url.encode() + b"\x03"
        for i in range(urlfilter.ORDER, len(b)):
            for k in range(urlfilter.ORDER + 1):
                for key in ((b[i - k : i], b[i]), (b[i - k : i], None)):
                    seen[good][key] = seen[good].get(key, 0) + n
    model = urlfilter.learn(spark.createDataFrame(rows, "url string, good boolean, n long")).cache()
    fresh = [(make(g), g) for g in [True, False] * 50] + [("", True), ("日本/" * 20, True)]
    got = {r.url: r.score for r in urlfilter.score(spark.createDataFrame([(u,) for u, _ in fresh], "url string"), model).collect()}
    assert got == pytest.approx({u: _model_score(u, seen) for u, _ in fresh}, abs=1e-9)
    assert sum((got[u] >= 0) == g for u, g in fresh[:100]) >= 97
    assert urlfilter.learn(spark.createDataFrame([], "url string, good boolean, n long")).count() == 0


def test_thresholds(spark):
    rows = [(True, 1, 0.5), (True, 2, 0.25), (False, 3, -0.2), (False, 1, 0.1)]
    df = spark.createDataFrame(rows, "good boolean, n long, score double")
    assert urlfilter.threshold_of(df) == pytest.approx(0.11) and urlfilter.threshold_of(df.where("good")) == -math.inf


def test_verdicts_follow_the_model(spark):
    rng = random.Random(2)
    word = lambda s: "".join(rng.choice(s) for _ in range(9))
    rows = [(f"http://{word('abcde')}.org/{word('abcd')}", "allow") if i % 2 else (f"http://{word('vwxyz')}.com/de/{word('wxyz')}", "block") for i in range(400)]
    rest = [(f"http://{word('abcde')}.net/{word('abcd')}", "allow") if i % 2 else (f"http://{word('vwxyz')}.net/{word('wxyz')}", "block") for i in range(60)]
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate([*rows, *rest, *rest])], "page_id long, url string")
    got = {r.page_id: r for r in urlfilter.judge(df).collect()}
    assert len(got) == 520 and sum(got[400 + i].verdict == v for i, (_, v) in enumerate(rest)) >= 57
    assert all(got[400 + i].verdict == got[460 + i].verdict and got[400 + i].rule is None for i in range(60))
