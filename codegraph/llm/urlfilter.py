"""URL filters: rules by host and path, and a character language-model ratio for what no rule covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, stage

#: (rule, verdict); a rule is a host and the start of a path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: The longest context in bytes, and how many counts' worth of trust the next shorter context gets.
ORDER, TRUST = 5, 4.0
#: What stands before and after a URL: ORDER times the one, once the other.
BEGIN, END = "\x02", "\x03"
#: Contexts of up to NARROW bytes are at most 1 + 256 + 1, so their table is broadcast; longer ones are joined by a shuffle.
NARROW = 1
#: Bytes of a URL that are cut into grams at a time.
PIECE = 256
#: Every FOLD-th labelled URL (by hash) calibrates the threshold and is not counted. Scores are binned by BIN in +-RANGE.
FOLD, BIN, RANGE = 5, 0.01, 16.0


def host_and_path(url) -> tuple:
    """Columns (host, path): host lies after the first ``://``, with A-Z lower-cased; both empty without it and for null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    raw = F.regexp_extract(rest, r"(?s)\A[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"(?s)\A[^?#]*", 0)
    return F.coalesce(ascii_lower(raw), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host, path, rules=RULES):
    """The longest rule that fits: its host is the URL's or a parent domain of it, and the URL's path starts with its path."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _grams(url: Column) -> Column:
    """For each byte of a URL and its end: the ORDER bytes before it and itself, one character for each byte."""
    line = F.concat(F.lit(BEGIN * ORDER), F.decode(F.encode(url, "utf-8"), "iso-8859-1"), F.lit(END))
    cut = lambda text, i, n: F.call_function("substring", text, i + 1, F.lit(n))
    # A character's place is found by walking to it, so long URLs are cut into overlapping pieces first.
    pieces = F.transform(F.sequence(F.lit(0), F.octet_length(url), F.lit(PIECE)), lambda i: cut(line, i, PIECE + ORDER))
    grams = lambda piece: F.transform(F.sequence(F.lit(0), F.length(piece) - ORDER - 1), lambda i: cut(piece, i, ORDER + 1))
    return F.flatten(F.transform(pieces, grams))


def _contexts(gram: Column) -> Column:
    """The contexts of a gram's last byte, of 0 to ORDER bytes."""
    return F.array(*[F.substring(gram, ORDER - k + 1, k) for k in range(ORDER + 1)])


def learn(labelled: DataFrame) -> DataFrame:
    """``labelled(url, good, n)`` -> ``(context, good, bad, nexts)``: the counts of two Markov models, for blocked and allowed URLs.

    A row is a context of 0 to ORDER bytes with how often any byte follows it, and ``nexts`` maps the bytes seen after
    it (at most 257) to such counts. All are exact counts of all rows, made by Spark, so the table grows with the URLs.
    """
    grams = labelled.select(F.explode(_grams(F.col("url"))).alias("gram"), F.when(F.col("good"), F.col("n")).otherwise(0).alias("good"), F.when(F.col("good"), 0).otherwise(F.col("n")).alias("bad"))
    grams = grams.groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    seen = grams.select(F.explode(_contexts(F.col("gram"))).alias("context"), F.substring("gram", ORDER + 1, 1).alias("next"), "good", "bad")
    seen = seen.groupBy("context", "next").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    return seen.groupBy("context").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.map_from_entries(F.collect_list(F.struct("next", F.struct("good", "bad")))).alias("nexts"))


def _ratios(grams: DataFrame, model: DataFrame) -> DataFrame:
    """``grams(gram)``, one row each -> ``(gram, ratio)``: log P(allow) - log P(block) of the last byte after the others.

    A byte's probability mixes its count in a context with its probability in the next shorter one, down to 1/257.
    """
    next_ = F.substring("gram", ORDER + 1, 1)

    def found(contexts, table):
        row = F.struct(F.length("context").alias("k"), *[F.col(c).cast("double").alias(c) for c in ("good", "bad")], *[F.coalesce(F.col("nexts")[next_][c], F.lit(0)).cast("double").alias(f"next_{c}") for c in ("good", "bad")])
        return contexts.join(table, "context").select("gram", row.alias("row"))

    each = grams.select("gram", F.explode(_contexts(F.col("gram"))).alias("context"))
    short = found(each.where(F.length("context") <= NARROW), F.broadcast(model.where(F.length("context") <= NARROW)))
    long = found(each.where(F.length("context") > NARROW), model.where(F.length("context") > NARROW))
    rows = short.unionByName(long).groupBy("gram").agg(F.array_sort(F.collect_list("row")).alias("rows"))

    def p(side):
        return F.aggregate("rows", F.lit(1 / 257), lambda acc, x: (x[f"next_{side}"] + F.lit(TRUST) * acc) / (x[side] + F.lit(TRUST)))

    known = rows.select("gram", (F.ln(p("good")) - F.ln(p("bad"))).alias("ratio"))
    return grams.select("gram").join(known, "gram", "left").select("gram", F.coalesce("ratio", F.lit(0.0)).alias("ratio"))


def score(urls: DataFrame, model: DataFrame) -> DataFrame:
    """``urls(url)``, distinct and not null -> ``(url, score)``: the mean over bytes of log P(allow) - log P(block); 0 for an empty URL.

    Each distinct gram is looked up once; URLs then collect the ratios of their grams. Sums are of whole parts of
    2**-32, so their order doesn't matter.
    """
    numbered = urls.select("url", F.xxhash64("url").alias("u1"), F.xxhash64(F.lit(FOLD), "url").alias("u2"))
    placed = stage(numbered.where("url <> ''").select("u1", "u2", F.explode(_grams(F.col("url"))).alias("gram")), "grams")
    ratios = stage(_ratios(placed.select("gram").distinct(), model), "ratios")
    part = F.round(F.col("ratio") * F.lit(float(1 << 32))).cast("long")
    sums = placed.join(ratios, "gram").groupBy("u1", "u2").agg(F.sum(part).alias("s"), F.count("*").alias("n"))
    return numbered.join(sums, ["u1", "u2"], "left").select("url", F.coalesce(F.col("s").cast("double") / F.lit(float(1 << 32)) / F.col("n"), F.lit(0.0)).alias("score"))


def threshold_of(fold: DataFrame) -> float:
    """``fold(good, n, score)`` -> the threshold with the best mean of both classes' accuracy; of equal ones that nearest to 0.

    Without one of the classes it is below every score, so that everything is allowed. Scores meet the driver as counts in bins.
    """
    at = F.floor(F.greatest(F.lit(-RANGE), F.least(F.lit(RANGE), F.col("score"))) / BIN)
    bins = fold.groupBy(at.alias("bin")).agg(F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("good"), 0).otherwise(F.col("n"))).alias("bad")).orderBy("bin").collect()
    good, bad = sum(r.good for r in bins), sum(r.bad for r in bins)
    if not good or not bad:
        return -float("inf")
    best, below, over, low = [], 0, bad, -RANGE
    for r in [*bins, None]:
        # Any value from the end of the last bin to the start of this one parts the fold alike.
        x = min(max(0.0, low), r["bin"] * BIN if r else RANGE)
        best.append(((good - below) / good + (bad - over) / bad, -abs(x), x))
        if r:
            below, over, low = below + r.good, over - r.bad, r["bin"] * BIN + BIN
    return max(best)[2]


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for each row of ``pages``.

    A rule that fits decides. The URLs that rules allow and block teach the two models (but for every fifth, which
    sets the threshold); they judge the rest: allow at or above the threshold. Null and empty URLs score 0. Repeated
    rows count as often as they come, and are scored once.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    said = F.create_map(*[F.lit(x) for rule in rules for x in rule])[F.col("rule")]
    urls = stage(rows.where("url is not null").groupBy("url", "rule").agg(F.count("*").alias("n")).withColumn("good", said == "allow").withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLD)) == 0), "urls")
    model = stage(learn(urls.where("rule is not null and not fold").select("url", "good", "n")), "model")
    asked = urls.where("rule is null or fold")
    scored = stage(asked.join(score(asked.select("url"), model), "url").select("url", "rule", "good", "n", "score"), "scores")
    limit = threshold_of(scored.where("rule is not null"))
    verdicts = scored.where("rule is null").select("url", F.when(F.col("score") >= limit, "allow").otherwise("block").alias("by_model"))
    nothing = "allow" if limit <= 0 else "block"
    judged = rows.join(verdicts, "url", "left")
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), said).otherwise(F.coalesce("by_model", F.lit(nothing))).alias("verdict"))
