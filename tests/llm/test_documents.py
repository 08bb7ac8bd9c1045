"""Operators on documents: near duplicates, languages, benchmark leaks, licences and private data."""

import random
import re

import pytest
from pyspark.sql import functions as F

from codegraph.llm import components, decontaminate, langid, pseudonyms, simhash

DOC = "doc_id long, text string"


def _words(rng, n, base="abcdefgh"):
    return [("".join(rng.choice(base) for _ in range(rng.randint(2, 6)))) for _ in range(n)]


def _roots(nodes, pairs):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {n: root(n) for n in nodes}


def test_components_against_union_find(spark):
    rng = random.Random(1)
    for n, m in ((1, 0), (40, 30), (60, 90)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(100, 130)] + [(500, k) for k in range(501, 540)]
        e = spark.createDataFrame([*pairs, (None, 3), (7, 7)], "a long, b long")
        got = {r.node: r.component for r in components.connected_components(e).collect()}
        want = _roots({x for p in pairs for x in p}, pairs)
        assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in pairs)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_every_pair_within_the_radius_shares_a_mask():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    for i in range(64):
        for j in range(64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_simhash_against_brute_force(spark):
    rng = random.Random(2)
    base = [_words(rng, 120) for _ in range(12)]
    rows = []
    for k in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            w[rng.randrange(len(w))] = "changed"
        rows.append((k, " ".join(w)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "One two"), (204, "oNE\ttwo"), (205, "x " * 70000), (5, rows[5][1]), (None, "alone text here")]
    docs = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, fp int, node string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    prints = {i: simhash.simhash(t) for i, t in rows if i is not None}
    want = _roots(prints, [(a, b) for a in prints for b in prints if a < b and ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= 2])
    for r in got:
        if r.doc_id is not None:
            assert (int(r.fingerprint, 16), r.component_id) == (prints[r.doc_id] & (2**64 - 1), want[r.doc_id])
    assert next(r for r in got if r.doc_id is None).component_id is None
    assert len({r.component_id for r in got if r.doc_id in (200, 201, 202)}) == 1
    assert simhash.near_duplicates(spark.createDataFrame([], DOC)).count() == 0


def test_crowded_buckets_find_what_pairs_find(spark, monkeypatch):
    """Fingerprints that agree on a whole mask, with buckets above and below the size that is compared pair by pair."""
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(3)]
    prints = sorted({b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(4))) for b in base for _ in range(60)})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(prints)], "fp long, node long")
    want = _roots(range(len(prints)), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    for size in (0, 16, 10**6):
        monkeypatch.setattr(simhash, "PAIRS", size)
        links = simhash.near_links(df).collect()
        assert _roots(range(len(prints)), [(r.a, r.b) for r in links]) == want
        assert all((prints[r.a] ^ prints[r.b]).bit_count() <= 2 for r in links)


def test_a_bit_is_set_by_more_than_half_of_the_shingles():
    import xxhash

    text = "A b c d e f g h b c d"
    w = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(len(w) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.simhash(text) & (2**64 - 1) == want


@pytest.fixture(scope="module")
def languages():
    rng = random.Random(3)
    return {"aa": lambda n: " ".join(_words(rng, n, "aeioubdk")), "bb": lambda n: " ".join(_words(rng, n, "xyzqwvñé")), "cc": lambda n: " ".join(_words(rng, n, "абвгдежз"))}


def test_languages_are_told_apart_on_held_out_texts(spark, languages):
    rows = [(i, languages[k](random.Random(i).randint(10, 60)), k) for i, k in enumerate(sorted(languages) * 60)]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !?", "cc"), (1003, "badike " * 200000, "aa"), (1004, rows[0][1], None), (0, rows[0][1], rows[0][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("mine"))
    prototypes = langid.learn(docs.where(~langid.held_out()))
    assert sorted(prototypes) == sorted(languages)
    got = {r.doc_id: r for r in langid.predict(docs, prototypes).collect()}
    for i, _, k in rows[:180]:
        assert got[i].lang_pred == k
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(docs, prototypes).count() == len(rows)


@pytest.mark.parametrize("table, counts", [(160, 1 << 22), (1, 50)])
def test_profiles_and_cosines_against_plain_bundles(spark, monkeypatch, table, counts):
    """Each trigram's vector is made and added one by one."""
    import numpy as np

    monkeypatch.setattr(langid, "TABLE", table)
    monkeypatch.setattr(langid, "COUNTS", counts)
    texts = ["Hello, wörld", "привет мир! hello", "日本語 テキスト", "a", "12", None, "x y  z\n" * 40]

    def plain(text):
        letters, total = [0], np.zeros(langid.DIM)
        for c in (text or "").lower() + " ":
            x = ord(c) if c.isalpha() else 0
            if x or letters[-1]:
                letters.append(x)
        for a, b, c in zip(letters, letters[1:], letters[2:]):
            v = [langid._letter_vector(i).astype(int) for i in (a, b, c)]
            total += np.array([v[0][(i - 2) % langid.DIM] * v[1][(i - 1) % langid.DIM] * v[2][i] for i in range(langid.DIM)])
        return total / max(np.linalg.norm(total), 1e-9)

    got, want = langid.profiles(texts), np.array([plain(t) for t in texts])
    assert np.allclose(got, want, atol=1e-5)
    prototypes = {"one": want[0], "two": want[1]}
    found = langid.predict(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOC), prototypes).orderBy("doc_id").collect()
    for r, p in zip(found, want):
        cosines = [float(p @ want[0]), float(p @ want[1])]
        assert r.score == pytest.approx(max(0, *cosines), abs=1e-4) and r.lang_pred == ("und" if not p.any() else ["one", "two"][int(cosines[1] > cosines[0])])


def test_nothing_learned_means_no_language(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.learn(none) == {} and langid.predict(none, {}).count() == 0
    assert langid.predict(spark.createDataFrame([(1, "abc")], DOC), {}).first().lang_pred == "und"


def test_pieces_of_a_long_text_give_the_trigrams_of_the_whole(monkeypatch):
    import numpy as np

    text = "Ab  c,de\n\nfg 12 hij k" * 9
    whole = np.sort(np.concatenate(list(langid._codes(text))))
    monkeypatch.setattr(langid, "LETTERS", 7)
    assert (np.sort(np.concatenate(list(langid._codes(text)))) == whole).all()


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    items = [(i, " ".join(_words(rng, n))) for i, n in enumerate([5, 8, 20, 40, 41, 80, 200])] + [(7, "short item"), (8, None), (9, ""), (0, "another text for the same item id here"), (10, "who wrote war peace"), (11, "zebra")]
    rows = []
    for k in range(60):
        w = _words(rng, rng.randint(0, 300))
        for _ in range(rng.randint(0, 2)):
            part = rng.choice(items[:7])[1].split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                part[rng.randrange(len(part))] = "zz"
            at = rng.randint(0, len(w))
            w[at:at] = part
        rows.append((k, (", " if k % 2 else " \n").join(w).upper()))
    rows += [(100, None), (101, ""), (102, "Short  ITEM!"), (103, "a short item"), (105, "He asked: who wrote War, Peace and more?"), (104, items[2][1] * 3000), (0, rows[0][1]), (None, items[4][1])]

    def shingles(t, n):
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()

    length = lambda t: min(5, len([x for x in re.split(r"[\W_]+", t or "") if x]))
    want = {}
    for d, t in rows:
        for i, x in items:
            q = shingles(x, length(x))
            if q and (c := len(q & shingles(t, length(x))) / len(q)) >= 0.8:
                want[d, i] = max(c, want.get((d, i), 0))
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, h int, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.containment for r in decontaminate.contained(docs, bench).collect()}
    assert got == pytest.approx(want) and (104, 2) in got and (102, 7) in got and (103, 7) in got and (105, 10) in got and (None, 4) in got
    assert decontaminate.contained(docs, bench.limit(0)).count() == 0 and decontaminate.contained(docs.limit(0), bench).count() == 0
    assert decontaminate.decontaminate(docs, bench).count() == sum((d is None) or not any(k[0] == d for k in want) for d, _ in rows)


def _luhn(digits):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 * (int(c) > 4)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms_keep_format_validity_and_links(spark):
    cards = ["4539148803436467", "4539 1488 0343 6467", "6011000990139424", "4539148803436468"]
    text = f"a {cards[0]} b {cards[1]} c {cards[2]} d {cards[3]} mail ann.B-7@host.example.org ip 10.1.2.3 and 10.1.2.999, born 1984-02-29 or 31/12/1999, not 2023-02-30, ssn 123-45-6789 not 000-12-3456, DE89 3704 0044 0532 0130 00, +1 (617) 555-7713; token = \"9b0b3c6a43eb78aa99cbd7049c572391524f37a8\""
    rows = [(1, text), (2, f"again {cards[0]}"), (3, None), (4, ""), (5, "clean text, 3 words"), (6, "x " * 100000 + "10.1.2.3"), (6, "10.1.2.3")]
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, found int")
    got = pseudonyms.pseudonymise(docs, "a key").collect()
    by = {r.doc_id: r for r in got[:5]}
    out = by[1].text
    for gone in (cards[0], cards[1], cards[2], "ann.B", "10.1.2.3 ", "1984-02-29", "31/12/1999", "123-45-6789", "3704 0044", "555-7713", "9b0b3c6a"):
        assert gone not in out
    for kept in (cards[3], "10.1.2.999", "2023-02-30", "000-12-3456", "@host.example.org", "+1 ("):
        assert kept in out
    first = re.search(r"a (\d{16}) b (\d{4} \d{4} \d{4} \d{4}) c (\d{16})", out)
    assert first[1] == first[2].replace(" ", "") and _luhn(first[1]) and _luhn(first[3]) and first[1] != first[3]
    assert by[2].text == f"again {first[1]}"
    assert re.search(r"born \d{4}-\d\d-\d\d or \d\d/\d\d/\d{4},", out) and re.search(r"ssn \d{3}-\d\d-\d{4} not", out) and re.search(r"token = \"[0-9a-f]{40}\"", out)
    iban = re.search(r"DE\d\d( \d{4}){4} \d\d", out)[0].replace(" ", "")
    assert int(re.sub(r"[A-Z]", lambda m: str(ord(m[0]) - 55), iban[4:] + iban[:4])) % 97 == 1
    assert by[3].text is None and by[4].text == "" and by[5].text == rows[4][1] and by[5].n_private == 0
    assert got[5].text.split()[-1] == got[6].text and got[5].found == 9
    assert by[1].private_kinds == ["card", "date", "email", "iban", "ip", "phone", "secret", "ssn"]
    other = pseudonyms.pseudonymise(docs, key="another").collect()
    assert other[1].text != by[2].text
    assert pseudonyms.pseudonymise(spark.createDataFrame([], DOC), "k").count() == 0


def test_the_permutation_has_no_collisions(spark):
    ids = spark.range(256 * 16).select(F.array(F.col("id") % 256, F.floor(F.col("id") / 256)).alias("v"), F.array(F.lit(256).cast("long"), F.lit(16).cast("long")).alias("m"))
    moved = ids.select(pseudonyms.feistel(F.col("v"), F.col("m"), "k", "t").alias("x"))
    assert moved.distinct().count() == 256 * 16 and moved.where("x[0] not between 0 and 255 or x[1] not between 0 and 15").count() == 0
    ten = spark.range(10000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("s"))
    assert ten.select(pseudonyms.permute_text(F.col("s"), "k", "t")).distinct().count() == 10000
