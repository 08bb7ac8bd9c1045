"""Pseudonyms against a plain model: detection by the same shapes in Python, permutations one value at a time."""

import datetime
import hashlib
import random

import pytest
import regex
from pyspark.sql import functions as F

from codegraph.llm import pseudonyms as ps

KEY = "model key"


def _hashed(*parts):
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def _feistel(values, sizes, tweak):
    if len(values) == 1 and sizes[0] <= 64:
        return [sorted(range(sizes[0]), key=lambda j: _hashed(KEY, tweak, "one", j, KEY)).index(values[0])]
    state, half = list(values), len(values) // 2
    for k in range(ps.ROUNDS):
        first = k % 2 == 0
        other = ",".join(map(str, state[half:] if first else state[:half]))
        state = [(x + _hashed(KEY, tweak, k, i, other, KEY)) % sizes[i] if (i < half) == first else x for i, x in enumerate(state)]
    return state


def _permute_all(text, tweak):
    out = []
    for at in range(0, len(text), ps.PIECE):
        spans = []
        for c in text[at : at + ps.PIECE]:
            n = ord(c)
            span = next(((a, b - a + 1) for a, b in ps.ALPHABETS if a <= n <= b), None)
            spans.append(span or ((n - n % 64, 64) if regex.match(r"[\p{L}\p{N}\p{M}]", c) else (n, 1)))
        moved = _feistel([ord(c) - a for c, (a, _) in zip(text[at : at + ps.PIECE], spans)], [s for _, s in spans], f"{tweak}/{at // ps.PIECE}")
        out += [chr(a + m) for (a, _), m in zip(spans, moved)]
    return "".join(out)


def _run(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.text for r in ps.pseudonymise(df, KEY).orderBy("doc_id").collect()]


def test_emails_and_secrets_against_the_model(spark):
    rng = random.Random(1)
    locals_ = ["a", "7", "михаил", "ann.B-7", "ünïcode", "x" * 65, "ab.c" * 60, "名前", "q%+_."]
    values = ["".join(rng.choice("abcXYZ0189_+/.-") for _ in range(rng.choice((20, 47, 48, 49, 97, 300)))) + "7" for _ in range(8)]
    got = _run(spark, [f"to {x}@host.example.org now" for x in locals_] + [f"token = {v}" for v in values])
    assert got == [f"to {_permute_all(x, 'email')}@host.example.org now" for x in locals_] + [f"token = {_permute_all(v, 'secret')}" for v in values]


def test_no_part_of_a_long_value_stays(spark):
    rng = random.Random(2)
    token = "".join(rng.choice("abcdefghij0123456789GHIJ") for _ in range(300))
    late = "abcdefghij" * 40 + "1"
    got = _run(spark, [f"secret: {token} end", f"password={late}", "q" * 200 + "@a.example.com", "x@" + "a." * 5000 + "org", "x@a..org y@b.org. z@c.org1"])
    assert all(token[i : i + 12] not in got[0] for i in range(0, 288, 4)) and got[0].endswith(" end") and len(got[0]) == len(f"secret: {token} end")
    assert "abcdefghij" not in got[1] and got[2] != "q" * 200 + "@a.example.com" and got[2].endswith("@a.example.com")
    assert got[3].endswith("a.org") and got[4].startswith("x@a..org ") and got[4].endswith("z@c.org1") and "@b.org. " in got[4]


def test_bare_keys(spark):
    keys = ["AKIA" + "IOSFODNN7EXAMPLE", "ghp_" + "a1B2" * 9, "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.abc_DEF-123"]
    got = _run(spark, [f"see {k} here" for k in keys] + ["AKIA short, ghp_x, task-force"])
    for k, t in zip(keys, got):
        assert k not in t and t.startswith("see " + k[:3]) and t.endswith(" here") and len(t) == len(f"see {k} here")
    assert got[3] == "AKIA short, ghp_x, task-force"


def test_month_first_dates_stay_apart(spark):
    days = spark.range(ps.LATE_DAYS[0] * ps.LATE_DAYS[1])
    back = days.select("id", ps._late_date(F.col("id")).alias("d")).select("id", "d", ps._late_rank(F.col("d")).alias("r"))
    assert back.where("id <> r or day(d) <= 12").count() == 0 and back.select("d").distinct().count() == days.count()
    start = datetime.date(1984, 1, 1)
    dates = [start + datetime.timedelta(i) for i in range(0, 1500, 3)]
    written = [d.strftime("%m/%d/%Y") for d in dates if d.day > 12] + [d.strftime("%d/%m/%Y") for d in dates]
    got = [t.removeprefix("on ") for t in _run(spark, [f"on {d}" for d in written])]
    assert len(set(got)) == len(set(written)) and all(len(t) == 10 for t in got)
    n = len([d for d in dates if d.day > 12])
    assert all(datetime.datetime.strptime(t, "%m/%d/%Y").day > 12 for t in got[:n]) and all(datetime.datetime.strptime(t, "%d/%m/%Y") for t in got[n:])


@pytest.mark.parametrize("sizes", [(10,), (64,), (10, 10), (26, 10, 64), (189, 773)])
def test_the_permutation_is_the_model_and_has_no_collisions(spark, sizes):
    total = 1
    for s in sizes:
        total *= s
    split, rest = [], F.col("id")
    for s in sizes:
        split.append(rest % s)
        rest = F.floor(rest / s)
    df = spark.range(total).select("id", F.array(*split).alias("v"))
    out = df.select("id", "v", ps.feistel(F.col("v"), F.array(*[F.lit(s).cast("long") for s in sizes]), KEY, "t").alias("m"))
    rows = out.sample(0.01, seed=1).limit(50).collect() if total > 2000 else out.collect()
    assert all(_feistel(r.v, sizes, "t") == r.m for r in rows)
    assert out.select("m").distinct().count() == total


def test_detection_against_the_model(spark):
    """What is found is what the shapes find in Python, and nothing else of a text changes."""
    rng = random.Random(3)
    bits = ["4539148803436467", "10.1.2.3", "10.1.2.999", "1984-02-29", "2023-02-30", "123-45-6789", "000-12-3456", "DE89 3704 0044 0532 0130 00", "+1 (617) 555-7713", "a@b.org", "words", "é", "12", "token: abcdefgh12345678", "\n"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    for t, out in zip(texts, _run(spark, texts)):
        at, rest = 0, []
        for m in regex.finditer(ps.SHAPE, t):
            rest.append(t[at : m.start()])
            at = m.end()
        rest.append(t[at:])
        at = 0
        for gap in rest:
            at = out.index(gap, at) + len(gap)
        for bad in ("10.1.2.999", "2023-02-30", "000-12-3456"):
            assert out.count(bad) == t.count(bad)
        for good in ("4539148803436467", "DE89 3704 0044 0532 0130 00", "abcdefgh12345678"):
            assert good not in out


HIDDEN = {
    "token      = abcdefghij1234567890": "token      = ", "AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG/bPxRfiCY": "AWS_SECRET_ACCESS_KEY=", "my_password=correcthorsebattery": "my_password=", "Api-Key:\t'a1b2c3d4e5f6a7b8c9": "Api-Key:\t'",
    "+14155552671": "+14", "(020) 7946 0958": "(0", "555 867 5309": "", "2001:0db8:85a3:0000:0000:8a2e:0370:7334": "", "fe80::1ff:fe23:4567:890a": "", "2001:DB8::A1": "", "de89370400440532013000": "de", "2024/01/31": "", "1650-03-01": "", "2150-01-01": "", "31.12.9699": "", "12/25/1640": "",
}


def test_more_shapes_are_hidden_in_their_format(spark):
    got = _run(spark, [f"see {v} now" for v in HIDDEN])
    for (v, head), t in zip(HIDDEN.items(), got):
        out = t.removeprefix("see ").removesuffix(" now")
        assert out != v and out.startswith(head) and len(out) == len(v), (v, out)
        same = lambda c: "d" if c.isdigit() else "x" if c.isalpha() else c
        if ":" not in v and "=" not in v:
            assert [same(c) for c in out] == [same(c) for c in v], (v, out)
    kinds = [r.private_kinds for r in ps.pseudonymise(spark.createDataFrame([(v,) for v in HIDDEN], "text string"), KEY).collect()]
    assert kinds == [["secret"]] * 4 + [["phone"]] * 3 + [["ip"]] * 3 + [["iban"]] + [["date"]] * 5


def test_what_only_looks_private_stays(spark):
    clean = ["std::cout << a::b", "at 12:30:45 or 1::", "0099-01-01 and 9700-01-01", "100 200 3000", "password: none of it", "the token of my love", "2024/13/31", "1:2:3:4:5:6:7:8:9", "a+b=c", "pwd=x"]
    assert _run(spark, clean) == clean


def test_dates_of_a_cycle_stay_apart(spark):
    start = datetime.date(2101, 1, 1)
    written = [(start + datetime.timedelta(i)).strftime("%Y/%m/%d") for i in range(0, 4000, 7)]
    got = [t.removeprefix("on ") for t in _run(spark, [f"on {d}" for d in written])]
    days = [datetime.datetime.strptime(t, "%Y/%m/%d") for t in got]
    assert len(set(got)) == len(written) and all(2100 <= d.year < 2500 for d in days)
