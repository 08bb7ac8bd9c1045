"""Benchmark decontamination: short test items inside long documents, by size-partitioned MinHash containment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import let
from .shared import free_name, quoted, stage

SHINGLE, THRESHOLD = 5, 0.8
#: The filter of benchmark shingles has from 2**MIN_BITS to 2**MAX_BITS bits (512 KB), about 16 for each shingle.
MIN_BITS, MAX_BITS = 18, 22
WORD_BREAK = r"[^\p{L}\p{N}\p{M}]+"


def _words(text):
    return F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: w != "")


def _hash(hashes, i, k: int):
    """Of the shingle at ``i``, from its words' hashes."""
    return F.xxhash64(*[F.get(hashes, i + j) for j in range(k)])


def _shingle(words, i, k: int):
    return F.array_join(F.slice(words, i + 1, k), " ")


def _found(words, hashes, k: int, wanted=None):
    """``(h, shingle)`` for each place with ``k`` words after it, those with ``wanted(h)`` if given; none in a shorter text."""
    starts = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))
    if wanted:
        starts = F.filter(starts, lambda i: wanted(_hash(hashes, i, k)))
    return F.transform(starts, lambda i: F.struct(_hash(hashes, i, k).alias("h"), _shingle(words, i, k).alias("shingle")))


def _with_words(text, body):
    """``body(words, hashes)`` of a text."""
    return let(_words(text), lambda w: let(F.transform(w, lambda x: F.xxhash64(x)), lambda hw: body(w, hw)))


def item_shingles(items: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, item_id, words, h, shingle, shingles, in_sketch)``: one row for each distinct shingle of an item.

    A shingle has ``k`` words, ``words`` in an item of fewer: the whole item. Items are partitioned by size, a power of two
    to the next. The MinHash sketch of an item is its smallest hashes under a second hash function, and has one more
    than the largest item of its partition may lack, so that a text that holds ``threshold`` of an item holds a hash
    of its sketch for certain, whichever shingles it has. Shingles of many items come last, by powers of two, so that
    a common phrase is in a sketch only where an item has little else.
    """

    def of(w, hw):
        out = F.array().cast("array<struct<h:bigint,shingle:string>>")
        for n in range(1, k + 1):
            out = F.when(F.size(w) >= n if n == k else F.size(w) == n, _found(w, hw, n)).otherwise(out)
        return F.struct(F.least(F.size(w), F.lit(k)).alias("words"), F.array_distinct(out).alias("found"))

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.explode(F.array(_with_words(F.col(text_col), of))).alias("x"))
    rows = rows.select("item", "item_id", "x.words", F.size("x.found").cast("long").alias("shingles"), F.explode("x.found").alias("y")).select("item", "item_id", "words", "shingles", "y.h", "y.shingle")
    largest = F.pow(F.lit(2), F.floor(F.log2("shingles")) + 1) - 1
    sketch = (F.floor(largest * (1 - threshold) + 1e-9) + 1).cast("int")
    common = rows.groupBy("h", "shingle").agg(F.floor(F.log2(F.count("*"))).alias("common"))
    order = W.partitionBy("item").orderBy("common", F.xxhash64("h", F.lit(k)), "h", "shingle")
    ranked = rows.join(common, ["h", "shingle"]).withColumn("place", F.row_number().over(order))
    return ranked.select("item", "item_id", "words", "h", "shingle", "shingles", (F.col("place") <= sketch).alias("in_sketch"))


def _filter(shingles: DataFrame, bits: int):
    """The shingles' Bloom filter as a literal array of 64-bit words, made by Spark; its size is fixed by ``bits``."""
    places = shingles.select(F.explode(_places(F.col("h"), bits)).alias("at"))
    found = places.groupBy(F.shiftright("at", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("word"))
    words = dict.fromkeys(range(1 << (bits - 6)), 0) | {r[0]: r[1] for r in found.collect()}
    return F.split(F.lit(",".join(map(str, words.values()))), ",").cast("array<bigint>")


def _places(h, bits: int):
    low = (1 << bits) - 1
    return F.array(h.bitwiseAND(low), F.shiftrightunsigned(h, 32).bitwiseAND(low))


def _may_hold(words, h, bits: int):
    low = (1 << bits) - 1

    def one(at):
        return F.call_function("shiftright", F.get(words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1

    return one(h.bitwiseAND(low)) & one(F.shiftrightunsigned(h, 32).bitwiseAND(low))


def _candidates(hits: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs ``(row, item)`` that share a shingle of the item's sketch."""
    return hits.join(known.where("in_sketch").select("h", "shingle", "item"), ["h", "shingle"]).select("row", "item").distinct()


def _pairs(rows: DataFrame, items: DataFrame, k: int, threshold: float, item_id: str, text_col: str) -> DataFrame:
    """``rows(row, doc_id, text)`` -> ``(row, doc_id, item_id, matched, shingles, containment)`` of the pairs that reach the threshold."""
    known = stage(item_shingles(items, k, threshold, item_id, text_col), "items")
    bits = min(max(MIN_BITS, (16 * known.count()).bit_length()), MAX_BITS)
    words, lengths = _filter(known, bits), sorted(r[0] for r in known.select("words").distinct().collect())
    holds = lambda h: _may_hold(words, h, bits)
    found = F.array_distinct(_with_words(F.col(text_col), lambda w, hw: F.flatten(F.array(*[_found(w, hw, n, holds) for n in lengths]))) if lengths else F.array().cast("array<struct<h:bigint,shingle:string>>"))
    rows = stage(rows.select("row", "doc_id", found.alias("found")).where(F.size("found") > 0), "found")
    candidates = stage(_candidates(rows.select("row", F.explode("found").alias("x")).select("row", "x.h", "x.shingle"), known), "candidates")
    whole = stage(known.groupBy("item", "item_id", "shingles").agg(F.collect_list("shingle").alias("all")), "whole")
    both = candidates.join(rows.select("row", "doc_id", F.col("found.shingle").alias("some")), "row").join(whole, "item")
    pairs = both.select("row", "doc_id", "item_id", F.size(F.array_intersect("all", "some")).cast("long").alias("matched"), "shingles")
    return pairs.withColumn("containment", F.col("matched") / F.col("shingles")).where(F.col("containment") >= threshold)


def contained(docs: DataFrame, items: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """Pairs ``(doc_id, item_id, matched, shingles, containment)`` with at least ``threshold`` of the item's shingles in the document.

    A word is a run of letters, digits and marks, lower-cased; a shingle is ``k`` words, repeats count once. An item of
    fewer words is one shingle, which is found wherever its words follow each other in a document. Null and empty
    texts match nothing. Rows with equal ids give one pair, with the largest containment, of equal ones the most shingles.

    Documents keep only the shingles that a Bloom filter of the benchmark lets through (no true one is lost). They are
    joined with the items' sketches alone; a row and an item that share a hash of the sketch are a candidate, and
    only candidates are verified: they count if their exact shingles reach the threshold.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), text_col)
    best = _pairs(rows, items, k, threshold, item_id, text_col).groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "matched", "shingles")).alias("best"))
    return best.select(F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id), "best.matched", "best.shingles", "best.containment")


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """``docs`` without those that hold a test item, by id. Rows with a null id are kept: see :func:`drop_rows`."""
    return docs.join(contained(docs, items, doc_id=doc_id, **how).select(doc_id).distinct(), doc_id, "left_anti")


def drop_rows(docs: DataFrame, items: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a test item, whatever their ids.

    Whether a row goes depends on its text alone, so texts are judged once each and told apart by 128 bits of hashes.
    Null and empty texts stay; repeated rows go or stay together.
    """
    one, two = free_name("text_hash", docs), free_name("text_hash2", docs)
    hashes = [F.xxhash64(text_col).alias(one), F.xxhash64(F.lit(k), F.col(text_col)).alias(two)]
    texts = docs.where(F.col(text_col).isNotNull()).select(F.struct(*hashes).alias("row"), F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias(text_col))
    leaks = stage(_pairs(texts, items, k, threshold, item_id, text_col).select(F.col(f"row.{one}").alias(one), F.col(f"row.{two}").alias(two)).distinct(), "leaks")
    return docs.select("*", *hashes).join(leaks, [one, two], "left_anti").select(*map(quoted, docs.columns))


#: The same pairs in DuckDB. Documents give shingles of five words, and of as many as a shorter item has.
ORACLE_SQL = r"""
WITH t AS (
  SELECT 'd' AS k, doc_id AS id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}\p{M}]+'), lambda w: w <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}\p{M}]+'), lambda w: w <> '') FROM benchmark),
sizes AS (SELECT DISTINCT least(len(w), 5) AS n FROM t WHERE k = 'i' AND len(w) > 0),
s AS (
  SELECT DISTINCT k, id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' '))) AS g
  FROM t JOIN sizes ON len(w) >= n AND (k = 'd' OR n = least(len(w), 5))),
n AS (SELECT id, count(*) AS shingles FROM s WHERE k = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS matched, any_value(n.shingles) AS shingles, count(*) / any_value(n.shingles) AS containment
FROM s d JOIN s i ON d.g = i.g AND d.n = i.n AND d.k = 'd' AND i.k = 'i' JOIN n ON n.id = i.id
GROUP BY d.id, i.id HAVING count(*) / any_value(n.shingles) >= 0.8
"""
