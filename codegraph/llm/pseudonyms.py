"""Private data: validated values get format-preserving pseudonyms from a keyed Feistel permutation.

Everything is built of DataFrame functions, so it runs inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .shared import free_name, quoted

ROUNDS = 8
DIGITS, HEX, UPPER, LOWER = "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A name that ends in such a word, or goes on after it with a mark, then a sign and the value.
SECRET_HEAD = r"(?i:token|secret|passw(?:or)?d|api[_-]?key)(?:[_-][A-Za-z0-9_-]*+)?[\"']?[ \t]*+[=:][ \t]*+[\"']?"
PASSWORD_HEAD = r"(?i:passw(?:or)?d|pwd)(?:[_-][A-Za-z0-9_-]*+)?[ \t]*+=[ \t]*+[\"']?"
#: Prefixes by which keys of well-known services show without a name before them, and what follows (fixed values).
KEY_HEADS = r"(?:(?:AKIA|ASIA)(?=[A-Z0-9]{16}(?![A-Za-z0-9]))|gh[oprsu]_(?=[A-Za-z0-9]{36})|github_pat_(?=[A-Za-z0-9_]{22})|AIza(?=[A-Za-z0-9_-]{35})|xox[abeoprs]-(?=[A-Za-z0-9-]{10})|sk-(?=[A-Za-z0-9_-]{20})|eyJ(?=[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.))"
#: What may be private, in the order in which alternatives are tried; some of it is validated below. No repeat has an upper
#: bound but where the format itself has one, so a value is found and replaced whole.
SHAPES = {
    "secret": SECRET_HEAD + r"(?=[A-Za-z0-9_+/.-]*\d)[A-Za-z0-9_+/.-]{16,}+",
    "key": r"(?<![A-Za-z0-9])" + KEY_HEADS + r"[A-Za-z0-9_.-]++",
    "password": PASSWORD_HEAD + r"[\p{L}\p{N}_+/.!@#$%^*-]{6,}+",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}+(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])(?:[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}\d{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ip6": r"(?<![\w:.])(?=[A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\w:]|\.\d)",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "date": r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]\d{2,4}){2,5}|\+[1-9]\d{6,14}|\(0\d{1,4}\) ?\d{3,4}[ -]\d{3,4}|[2-9]\d{2} [2-9]\d{2} \d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\d-])",
    "card": r"(?<![\d.])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)",
}
SHAPE = "|".join(SHAPES.values())
#: Days of one Gregorian cycle of 400 years from FIRST_DAY as two factors, and those after the 12th of a month. Dates move
#: within their cycle; those of the whole cycles with years of four digits, CYCLES before and after the first, are dates.
FIRST_DAY, DAYS, LATE_DAYS, CYCLES = "1700-01-01", (189, 773), (9, 9833), (-4, 19)
#: Long values are permuted in pieces of so many characters, each with its place as part of the key.
PIECE = 48
#: Alphabets as first and last code point: a character moves within its own. Other letters and digits move within their
#: aligned block of 64 code points.
ALPHABETS = ((48, 57), (65, 90), (97, 122), (0xC0, 0xD6), (0xD8, 0xDE), (0xDF, 0xF6), (0xF8, 0xFF), (0x391, 0x3A1), (0x3A3, 0x3A9), (0x3B1, 0x3C9), (0x410, 0x42F), (0x430, 0x44F))


def _whole(pattern: str) -> str:
    return rf"\A(?:{pattern})\z"


def _hashed(*parts) -> Column:
    """60 bits of a keyed hash."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 15), 16, 10).cast("long")


def feistel(values: Column, sizes: Column, key: str, tweak: Column | str) -> Column:
    """A keyed permutation of arrays of whole numbers, ``values[i]`` in ``range(sizes[i])``.

    Rounds alternate between the halves: each number of one half is moved, modulo its size, by a keyed hash of its
    place and the other half. So it can be undone for any mix of sizes, and no value leaves its range. A single number
    has no other half: it becomes its place when all of its range (up to 64 numbers, else a shift) are sorted by their hashes.
    """
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak

    def round_(state, k):
        half = F.floor(F.size(state) / 2).cast("int")
        first = k % 2 == 0
        other = F.array_join(F.transform(F.when(first, F.slice(state, half + 1, F.size(state) - half)).otherwise(F.slice(state, 1, half)), lambda x: x.cast("string")), ",")

        def moved(o):
            shift = lambda i: _hashed(F.lit(key), tweak, k, i, o, F.lit(key))
            return F.transform(state, lambda x, i: F.when((i < half) == first, F.pmod(x + shift(i), F.get(sizes, i))).otherwise(x))

        return let(other, moved)

    def ranked(n):
        order = F.array_sort(F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(_hashed(F.lit(key), tweak, F.lit("one"), j, F.lit(key)).alias("h"), j.alias("j"))))
        return F.array(F.array_position(F.transform(order, lambda x: x.j), F.get(values, 0)) - 1)

    alone = (F.size(values) == 1) & (F.get(sizes, 0) <= 64)
    return F.when(alone, let(F.get(sizes, 0), ranked)).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, round_))


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _alphabet(c: Column) -> Column:
    return F.when(c.between("0", "9"), DIGITS).when(c.between("a", "z"), LOWER).otherwise(UPPER)


def permute_text(value: Column, key: str, tweak: str, alphabet: str | None = None) -> Column:
    """Letters and digits (ASCII) permuted within their class or ``alphabet``; all else stays, and doesn't count."""
    of = (lambda c: F.lit(alphabet)) if alphabet else _alphabet
    clean = F.regexp_replace(value, "[^A-Za-z0-9]", "")

    def out(chars):
        numbers = F.transform(chars, lambda c: F.call_function("locate", c, of(c)).cast("long") - 1)
        sizes = F.transform(chars, lambda c: F.length(of(c)).cast("long"))
        moved = let(sizes, lambda s: feistel(numbers, s, key, tweak))
        text = let(moved, lambda m: F.array_join(F.transform(chars, lambda c, i: F.call_function("substring", of(c), (F.get(m, i) + 1).cast("int"), F.lit(1))), ""))
        # The kept characters go back between the moved ones.
        return let(text, lambda t: F.array_join(F.transform(_chars(value), lambda c, i: F.when(c.rlike("[A-Za-z0-9]"), F.call_function("substring", t, F.length(F.regexp_replace(F.call_function("substring", value, F.lit(1), i + 1), "[^A-Za-z0-9]", "")), F.lit(1))).otherwise(c)), ""))

    return F.when(F.length(clean) > 0, let(_chars(clean), out)).otherwise(value)


def permute_all(value: Column, key: str, tweak: str) -> Column:
    """All letters and digits of any script permuted within their alphabets; other characters stay at their places.

    A value of any length: pieces are permuted one by one, so work grows with the length.
    """

    def alphabet(c):
        code = F.call_function("ascii", c).cast("long")

        def of(n):
            out = F.when(c.rlike(r"[\p{L}\p{N}\p{M}]"), F.struct((n - n % 64).alias("low"), F.lit(64).cast("long").alias("size"))).otherwise(F.struct(n.alias("low"), F.lit(1).cast("long").alias("size")))
            for low, high in reversed(ALPHABETS):
                out = F.when(n.between(low, high), F.struct(F.lit(low).cast("long").alias("low"), F.lit(high - low + 1).cast("long").alias("size"))).otherwise(out)
            return F.struct(n.alias("n"), out["low"].alias("low"), out["size"].alias("size"))

        return let(code, of)

    def piece(text, at):
        def out(cs):
            moved = feistel(F.transform(cs, lambda x: x["n"] - x["low"]), F.transform(cs, lambda x: x["size"]), key, F.concat_ws("/", F.lit(tweak), at))
            return let(moved, lambda m: F.array_join(F.transform(cs, lambda x, i: F.decode(F.unhex(F.lpad(F.hex(x["low"] + F.get(m, i)), 8, "0")), "UTF-32")), ""))

        return let(F.transform(_chars(text), alphabet), out)

    places = F.sequence(F.lit(0), F.floor((F.length(value) - 1) / PIECE).cast("int"))
    return F.when(F.length(value) > 0, F.array_join(F.transform(places, lambda at: piece(F.call_function("substring", value, at * PIECE + 1, F.lit(PIECE)), at)), "")).otherwise(value)


def luhn_sum(digits: Column, doubled_first: bool) -> Column:
    """The Luhn sum from the right; with ``doubled_first`` for digits that lack their check digit."""
    odd = 0 if doubled_first else 1
    return F.aggregate(
        F.transform(F.reverse(_chars(digits)), lambda c, i: let(c.cast("int") * F.when(i % 2 == odd, 2).otherwise(1), lambda x: x - F.when(x > 9, 9).otherwise(0))),
        F.lit(0),
        lambda a, x: a + x,
    )


def _mod97(s: Column) -> Column:
    value = lambda c: F.call_function("locate", c, F.lit(DIGITS + UPPER)) - 1
    return F.aggregate(_chars(s), F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


def _date(value: Column) -> Column:
    iso, year, slash, dot = (F.to_date(F.try_to_timestamp(value, F.lit(f))) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "dd.MM.yyyy"))
    month_first = F.to_date(F.try_to_timestamp(value, F.lit("MM/dd/yyyy")))
    return F.when(value.rlike(r"\A\d{4}-"), iso).when(value.rlike(r"\A\d{4}/"), year).when(value.contains("/"), F.coalesce(slash, month_first)).otherwise(dot)


def _cycle(day: Column) -> Column:
    """The cycle of 400 years that a day lies in, 0 for that from FIRST_DAY."""
    return F.floor(F.datediff(day, F.lit(FIRST_DAY).cast("date")) / (DAYS[0] * DAYS[1])).cast("int")


def _kind(v: Column) -> Column:
    """The kind of a value that has a shape and is valid; null for what only looks like it."""
    digits = F.regexp_replace(v, r"\D", "")
    plain = F.upper(F.replace(v, F.lit(" "), F.lit("")))
    valid = {
        "secret": F.lit(True),
        "key": F.substring_index(v, ".", 1).rlike(r"\d") | v.contains("."),
        "password": F.lit(True),
        "email": ~F.substring_index(v, "@", -1).rlike(r"\.\.|[.-]\z"),
        "iban": F.length(plain).between(15, 34) & (_mod97(F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4))) == 1),
        "ip6": ~v.contains("::") | F.size(F.filter(F.split(v, ":"), lambda x: x != "")).between(2, 7),
        "ip": F.forall(F.split(v, r"\."), lambda x: x.cast("int") <= 255),
        "date": F.coalesce(_cycle(_date(v)).between(*CYCLES), F.lit(False)),
        "ssn": ~v.rlike(r"\A(?:000|666|9)|-00-|-0000\z"),
        "phone": F.length(digits).between(7, 15),
        "card": F.length(digits).between(13, 19) & (luhn_sum(digits, False) % 10 == 0) & ~digits.rlike(r"\A0+\z"),
    }
    out = F.lit(None).cast("string")
    for kind, ok in reversed(valid.items()):
        out = F.when(v.rlike(_whole(SHAPES[kind])), F.when(ok, F.lit({"key": "secret", "password": "secret", "ip6": "ip"}.get(kind, kind)))).otherwise(out)
    return out


def _late_rank(day: Column) -> Column:
    """The place of a date after the 12th of its month among all such dates from FIRST_DAY."""
    start = F.lit(FIRST_DAY).cast("date")
    months = (F.year(day) - F.year(start)) * 12 + F.month(day) - 1
    return (F.datediff(day, start) - 12 * (months + 1)).cast("long")


def _late_date(rank: Column) -> Column:
    """The date with that place: its month is the last whose late days begin at or before it."""
    start = F.lit(FIRST_DAY).cast("date")
    guess = F.floor(rank * 4800 / (LATE_DAYS[0] * LATE_DAYS[1])).cast("int")
    begins = lambda m: F.datediff(F.add_months(start, m), start) - 12 * m
    months = F.filter(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda j: F.greatest(guess + j, F.lit(0))), lambda m: begins(m) <= rank)
    return let(F.array_max(months), lambda m: F.date_add(F.add_months(start, m), (rank - begins(m) + 12).cast("int")))


def _pseudonym(v: Column, kind: Column, key: str) -> Column:
    def secret():
        head = F.regexp_extract(v, rf"\A(?:{SECRET_HEAD}|{PASSWORD_HEAD}|{KEY_HEADS})", 0)
        rest = F.substr(v, F.length(head) + 1)
        return F.concat(head, F.when(rest.rlike(r"\A[0-9a-f]{1,64}\z"), permute_text(rest, key, "hex", HEX)).otherwise(permute_all(rest, key, "secret")))

    def email():
        return F.concat(permute_all(F.substring_index(v, "@", 1), key, "email"), F.lit("@"), F.substring_index(v, "@", -1))

    def iban():
        plain = F.upper(F.replace(v, F.lit(" "), F.lit("")))
        country, body = F.substring(plain, 1, 2), permute_text(F.substring(plain, 5, 34), key, "iban")

        def spaced(b):
            check = F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
            full = F.concat(country, check, b)
            full = F.when(v == F.lower(v), F.lower(full)).otherwise(full)
            return F.when(v.contains(" "), F.rtrim(F.regexp_replace(full, "(.{4})", "$1 "))).otherwise(full)

        return let(body, spaced)

    def numbers(values, sizes, tweak, out):
        return let(feistel(F.array(*[x.cast("long") for x in values]), F.array(*[F.lit(s).cast("long") for s in sizes]), key, tweak), lambda m: out(*[F.get(m, i) for i in range(len(sizes))]))

    def ip():
        parts, six = F.split(v, r"\."), permute_text(F.lower(v), key, "ip6", HEX)
        return F.when(v.contains(":"), F.when(v.rlike("[A-F]"), F.upper(six)).otherwise(six)).otherwise(numbers([F.get(parts, i).cast("int") for i in range(4)], [256] * 4, "ip", lambda *x: F.concat_ws(".", *[y.cast("string") for y in x])))

    def date():
        # The calendar repeats after a cycle, so a date is moved as its like in the first one.
        shift = _cycle(_date(v)) * (DAYS[0] * DAYS[1])
        like = F.date_sub(_date(v), shift)
        day = F.datediff(like, F.lit(FIRST_DAY).cast("date"))

        def out(a, b):
            moved = F.date_add(F.lit(FIRST_DAY).cast("date"), (a * DAYS[1] + b).cast("int") + shift)
            return F.when(v.rlike(r"\A\d{4}-"), F.date_format(moved, "yyyy-MM-dd")).when(v.rlike(r"\A\d{4}/"), F.date_format(moved, "yyyy/MM/dd")).when(v.contains("/"), F.date_format(moved, "dd/MM/yyyy")).otherwise(F.date_format(moved, "dd.MM.yyyy"))

        # Month first shows only by a day after the 12th; such dates stay among their like.
        month_first = v.rlike(r"\A\d\d/") & F.try_to_timestamp(v, F.lit("dd/MM/yyyy")).isNull()
        late = lambda a, b: F.date_format(F.date_add(_late_date(a * LATE_DAYS[1] + b), shift), "MM/dd/yyyy")
        rank = _late_rank(like)
        return F.when(month_first, numbers([F.floor(rank / LATE_DAYS[1]), rank % LATE_DAYS[1]], LATE_DAYS, "month first", late)).otherwise(numbers([F.floor(day / DAYS[1]), day % DAYS[1]], DAYS, "date", out))

    def ssn():
        area = F.substring(v, 1, 3).cast("int")
        place = area - F.when(area > 666, 2).otherwise(1)
        back = lambda a: a + F.when(a >= 665, 2).otherwise(1)
        return numbers([place, F.substring(v, 5, 2).cast("int") - 1, F.substring(v, 8, 4).cast("int") - 1], (898, 99, 9999), "ssn", lambda a, g, s: F.concat_ws("-", F.lpad(back(a).cast("string"), 3, "0"), F.lpad((g + 1).cast("string"), 2, "0"), F.lpad((s + 1).cast("string"), 4, "0")))

    def phone():
        head = F.regexp_extract(v, r"\A(?:\+\d{1,3}(?=[ .(-])|\+\d{2}|\(0)", 0)
        return F.concat(head, permute_text(F.substr(v, F.length(head) + 1), key, "phone"))

    def card():
        body = permute_text(v.substr(F.lit(1), F.length(v) - 1), key, "card")
        return let(body, lambda b: F.concat(b, F.pmod(-luhn_sum(F.regexp_replace(b, r"\D", ""), True), F.lit(10)).cast("string")))

    out = v
    for name, make in (("secret", secret), ("email", email), ("iban", iban), ("ip", ip), ("date", date), ("ssn", ssn), ("phone", phone), ("card", card)):
        out = F.when(kind == name, make()).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", kinds_col: str = "private_kinds", count_col: str = "n_private") -> DataFrame:
    """``docs`` with private values in the text replaced, and with the kinds found and their number.

    E-mail addresses (but for their domain), phone numbers, secrets of 16 characters or more with a digit after a name like
    ``token =`` or ``AWS_SECRET_ACCESS_KEY:``, what is set as a password by ``=``, keys with the prefix of a well-known
    service, IPv4 and IPv6 addresses, valid dates from the year 100 to 9699, social security numbers, cards and bank accounts with valid check
    digits get a value of the same format that is valid again. Values of any length are found and replaced whole.
    Equal values get equal ones in all documents under one ``key``, different values of a kind and format different ones. What only looks like a number of these kinds stays, as does the rest of the text. Null and empty texts
    stay as they are, with no kinds. Columns of the two names are replaced; other columns are kept.
    """
    text, names = F.col(text_col), [c for c in docs.columns if c not in (kinds_col, count_col)]

    def replaced(hits):
        kinds = F.transform(hits, _kind)
        return let(kinds, lambda ks: F.struct(F.transform(hits, lambda v, i: let(F.get(ks, i), lambda k: F.when(k.isNull(), v).otherwise(_pseudonym(v, k, key)))).alias("values"), ks.alias("kinds")))

    found = F.when(text.rlike("(?i)[0-9@]|passw|pwd"), let(F.regexp_extract_all(text, F.lit(SHAPE), 0), lambda h: F.when(F.size(h) > 0, replaced(h))))
    got = free_name("found", docs)
    rows = docs.withColumn(got, found)
    joined = F.array_join(F.transform(F.split(text, SHAPE, -1), lambda gap, i: F.concat(gap, F.coalesce(F.get(F.col(f"{got}.values"), i), F.lit("")))), "")
    kinds = F.filter(F.coalesce(F.col(f"{got}.kinds"), F.array().cast("array<string>")), lambda k: k.isNotNull())
    return rows.select(*[F.when(F.col(got).isNotNull(), joined).otherwise(text).alias(c) if c == text_col else F.col(quoted(c)) for c in names], F.array_sort(F.array_distinct(kinds)).alias(kinds_col), F.size(kinds).cast("long").alias(count_col))
