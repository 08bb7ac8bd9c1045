"""Mix sources to target weights by blocks of words."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let
from .prp import key_of, permute
from .sharding import counts_with_sums
from .shared import WORD, free_name, quoted, stage, with_rows

#: A source comes within a block of its target. Blocks of 32 words suit small corpora; over 100 TB some 4096 words keep the
#: block table near 4 * 10**9 rows.
WEIGHTS, CAP, SHARDS, BLOCK_WORDS, SEED = (5, 2, 1), 3, 16, 32, 10
#: Running sums are made in chunks of about so many rows, and chunks are summed in runs of so many.
CHUNK_ROWS, RUN = 128, 4096
#: Slots are listed in chunks of so many, and dealt to tasks of about so many.
CHUNK_SLOTS, TASK_SLOTS = 1 << 14, 1 << 18
#: Sources are drawn in at most so many groups, whose counts meet on the driver.
GROUPS = 4096
#: The table of sources is broadcast up to so many sources (under 200 bytes each, longer names apart).
BROADCAST_SOURCES = 100_000


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_targets(sources: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """``sources(source, source_size, n_rows)``, one row each -> with ``src``, its place by code point (null last), and ``target``.

    All words are shared by weight, and what goes beyond ``cap`` sizes is shared again among the rest. So a target is
    its weight times a common level, or ``cap`` sizes where that is less. The level rises as more sources reach their
    cap; each step is one sum over the table, which stays on the executors however many sources there are.
    """
    parts = sources.repartitionByRange(F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source")
    placed = stage(parts.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "sources")
    counts, before, total = placed.groupBy("part").count().orderBy("part").collect(), {}, 0
    for part, n in counts:
        before[part] = total
        total += n
    if not total:
        return placed.select("source", "source_size", "n_rows", F.col("at").alias("src"), F.lit(0.0).alias("target"))
    first = F.create_map(*[F.lit(x) for part, n in before.items() for x in (part, n)])[F.col("part")]
    ranked = placed.select("source", "source_size", "n_rows", (first + F.col("at")).cast("long").alias("src"))
    ranked = ranked.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), (F.col("src") % len(weights)).cast("int")))
    most, level, known = F.col("source_size") * cap, 0.0, -1
    while True:
        full = F.lit(level) * F.col("weight") > most
        row = ranked.agg(F.sum("source_size"), F.sum(F.when(full, most)), F.sum(F.when(full, 0).otherwise(F.col("weight"))), F.count(F.when(full, 1))).first()
        if row[3] == known or not row[2]:
            break
        known, level = row[3], (row[0] - (row[1] or 0)) / row[2]
    return ranked.withColumn("target", F.least(F.lit(level) * F.col("weight"), most.cast("double"))).drop("weight")


def running_start(rows: DataFrame) -> DataFrame:
    """``rows(src, n_rows, at, row, size, ...)`` with ``start``: the words of the same source before this row.

    The order is that of ``at`` (a hash of the id) within chunks, so that no source, however large, meets in a task.
    """
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / CHUNK_ROWS)).cast("long")
    rows = rows.withColumn("chunk", F.pmod("at", chunks))
    sums = rows.groupBy("src", "chunk").agg(F.sum("size").alias("n")).withColumn("run", F.floor(F.col("chunk") / RUN))
    runs = sums.groupBy("src", "run").agg(F.sum("n").alias("n"))
    before = "rows between unbounded preceding and 1 preceding"
    runs = runs.select("src", "run", F.expr(f"coalesce(sum(n) over (partition by src order by run {before}), 0) as run_start"))
    sums = sums.select("src", "run", "chunk", F.expr(f"coalesce(sum(n) over (partition by src, run order by chunk {before}), 0) as chunk_start"))
    starts = sums.join(runs, ["src", "run"]).select("src", "chunk", (F.col("run_start") + F.col("chunk_start")).alias("chunk_start"))
    rows = rows.withColumn("inside", F.expr(f"coalesce(sum(size) over (partition by src, chunk order by at, row {before}), 0)"))
    return rows.join(starts, ["src", "chunk"]).withColumn("start", F.col("chunk_start") + F.col("inside")).drop("chunk", "chunk_start", "inside")


class Plan:
    """What the mix takes, as tables of one row for each source, slot and block."""

    def __init__(self, rows: DataFrame, weights=WEIGHTS, cap: int = CAP, shards: int = SHARDS, block: int = BLOCK_WORDS, seed: int = SEED):
        """``rows``: ``(row, id, source, size)``, written already; row tells rows apart, id gives the order."""
        sources = with_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), weights, cap)
        blocks = F.ceil(F.col("source_size") / block).cast("long")
        due = F.when(F.col("source_size") > 0, F.round(F.col("target") * blocks / F.col("source_size"))).otherwise(0).cast("long")
        self.sources = stage(sources.withColumn("blocks", blocks).withColumn("due", F.least(due, blocks * cap)), "targets")
        self.total = self.sources.agg(F.coalesce(F.sum("due"), F.lit(0))).first()[0]
        self.block, self.seed, self.shards, self.rows = block, seed, shards, rows

    @property
    def room(self) -> list[int]:
        """The blocks of each output shard: equal, or one more in the first ones."""
        return [self.total // self.shards + (k < self.total % self.shards) for k in range(self.shards)]

    def shard_counts(self) -> DataFrame:
        """``(src, blocks, counts, firsts, starts)``: how many blocks of a source each output shard takes.

        A shard's counts are multinomial over the sources; that all shards have ``room`` and each source is due exactly
        its sum makes them multivariate hypergeometric together, and so they are drawn. Sources are drawn in groups of
        neighbours: first what each group gives to each shard, which is at most GROUPS rows on the driver, then in a
        task for each group what its sources give. ``firsts`` are the source's slots before a shard's, ``starts`` the
        shard's blocks before the source's.
        """
        seed, shards = self.seed, self.shards
        n = self.sources.count()
        each = max(1, -(-n // GROUPS))
        group = F.floor(F.col("src") / each).cast("long")
        due = {r[0]: r[1] for r in self.sources.groupBy(group.alias("g")).agg(F.sum("due")).collect()}
        order = sorted(due)
        drawn = counts_with_sums([due[g] for g in order], self.room, np.random.default_rng([seed, 0]))
        before = np.cumsum(drawn, axis=0) - drawn
        rows = self.sources.sparkSession.createDataFrame([(g, drawn[i].tolist(), before[i].tolist()) for i, g in enumerate(order)], "g long, room array<long>, before array<long>")

        def draw(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("src")
            g = int(frame["g"].iat[0])
            counts = counts_with_sums(frame["due"].tolist(), frame["room"].iat[0].tolist(), np.random.default_rng([seed, 1, g]))
            starts = np.cumsum(counts, axis=0) - counts + frame["before"].iat[0]
            firsts = np.cumsum(counts, axis=1) - counts
            return pd.DataFrame({"src": frame["src"], "blocks": frame["blocks"], "counts": list(counts), "firsts": list(firsts), "starts": list(starts)})

        asked = self.sources.select("src", "blocks", "due", group.alias("g")).join(rows, "g")
        return asked.groupBy("g").applyInPandas(draw, "src long, blocks long, counts array<long>, firsts array<long>, starts array<long>")

    def slots(self) -> DataFrame:
        """``(shard, slot, src, block)``: one row for each block of the output; the slots of a shard are gapless.

        The i-th block that a shard takes from a source is slot j of the source, its slots in earlier shards plus i: block
        pi(j mod blocks) of pass j div blocks, with another permutation for each pass. In the shard it stands at a
        place that the shard's own permutation gives. Slots are listed by chunks that are dealt out first, so no source
        is one task.
        """
        seed, room = self.seed, np.array(self.room or [0], np.int64)

        @F.pandas_udf("slot long, block long")
        def choose(shard: pd.Series, src: pd.Series, blocks: pd.Series, first: pd.Series, start: pd.Series, i: pd.Series) -> pd.DataFrame:
            k, s, b, at = (x.to_numpy() for x in (shard, src, blocks, i))
            j = first.to_numpy() + at
            return pd.DataFrame({"slot": permute(start.to_numpy() + at, room[k], key_of(seed, 2, k)), "block": permute(j % b, b, key_of(seed, s, j // b))})

        shards = self.shard_counts().select("src", "blocks", F.posexplode(F.arrays_zip("counts", "firsts", "starts")).alias("shard", "c")).select("shard", "src", "blocks", "c.*").where("counts > 0")
        chunks = shards.select("shard", "src", "blocks", "firsts", "starts", "counts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("counts") - 1, F.lit(CHUNK_SLOTS).cast("long"))).alias("at"))
        # A chunk is a short row that many slots come of, so the number of tasks is set by the slots, not by bytes.
        chunks = chunks.repartition(1 + self.total // TASK_SLOTS, "src", "shard", "at")
        each = F.sequence("at", F.least(F.col("at") + CHUNK_SLOTS, F.col("counts")) - 1)
        picked = chunks.select("shard", "src", "blocks", "firsts", "starts", F.explode(each).alias("i"))
        return picked.select("shard", "src", choose("shard", "src", "blocks", "firsts", "starts", "i").alias("c")).select("shard", "c.slot", "src", "c.block")

    def cut(self) -> tuple[DataFrame, DataFrame]:
        """``rows`` with ``src``, targets and ``start``, and ``(row, src, block, at, place, words)``: the part of a row in each of its blocks.

        ``at`` is where the part begins in the row, ``place`` where it lies in the block.
        """
        b = self.block
        sources = self.sources.withColumnRenamed("source", "name").drop("blocks", "due")
        sources = F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources
        rows = self.rows.join(sources, F.col("source").eqNullSafe(F.col("name"))).drop("name")
        rows = running_start(rows.withColumn("at", F.xxhash64("id", F.lit(self.seed))))
        first, last = F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b)
        parts = rows.where("size > 0").select("row", "src", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
        begin = F.greatest("start", F.col("block") * b)
        return rows, parts.select("row", "src", "block", (begin - F.col("start")).alias("at"), (begin - F.col("block") * b).alias("place"), (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b) - begin).alias("words"))

    def taken(self) -> DataFrame:
        """``(row, id, source, size, source_size, target, taken, shard_words, spans)``.

        ``shard_words`` has the words that each output shard takes of the row; spans are (at, words, times) in the
        order of the text.
        """
        rows, parts = self.cut()
        # Both sides grow with the corpus, and the counts compress so well that they would pass for a small table.
        used = self.slots().groupBy("src", "block").agg(F.collect_list("shard").alias("shards")).hint("merge")
        used = parts.join(used, ["src", "block"], "left").withColumn("shards", F.coalesce("shards", F.array().cast("array<int>")))
        spans = F.sort_array(F.collect_list(F.struct("at", "words", "shards")))
        used = used.groupBy("row").agg(F.sum(F.expr("words * size(shards)")).alias("taken"), spans.alias("spans"))
        in_shard = lambda k: F.aggregate("spans", F.lit(0).cast("long"), lambda a, p: a + p.words * F.size(F.filter(p.shards, lambda s: s == k)))
        used = used.withColumn("shard_words", F.transform(F.sequence(F.lit(0), F.lit(self.shards - 1)), in_shard))
        used = used.withColumn("spans", F.transform("spans", lambda p: F.struct(p.at.alias("at"), p.words.alias("words"), F.size(p.shards).cast("long").alias("times"))))
        kept = ["row", "id", "source", "size", "source_size", "target"]
        none = F.array_repeat(F.lit(0).cast("long"), self.shards)
        return rows.select(*kept).join(used, "row", "left").select(*kept, F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("shard_words", none).alias("shard_words"), "spans")


def _numbered(docs: DataFrame, *cols) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), *cols)


def mix_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, shard_words)`` for each row of ``docs``: how many of its words the mix takes.

    ``shard_words`` has how many of them go to each output shard.

    Size is the number of words, 0 for null and empty texts, of which the mix takes nothing. A null source is a
    source. No row is taken more than ``cap`` times. The order of packing is that of a hash of the id, so the result
    doesn't depend on how rows lie in files; rows with equal ids may swap their results.
    """
    rows = stage(_numbered(docs, F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    return Plan(rows, **how).taken().select(F.col("id").alias(id_col), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "shard_words")


def mix_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixed corpus as blocks of words: ``(shard, slot, source, n_words, text)``, one row for each block of each shard.

    Shards have equally many blocks, or one more; the slots of a shard are gapless and in random order of the sources. A
    block has the words of neighbouring documents of its source, joined by blanks; only a source's last block is shorter.
    Null and empty texts have no words.
    """
    rows = stage(_numbered(docs, F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.col(text_col).alias("text")), "rows")
    plan = Plan(rows.drop("text"), **how)
    parts = plan.cut()[1].groupBy("row").agg(F.collect_list(F.struct("src", "block", "at", "place", "words")).alias("parts"))
    piece = lambda words: F.transform("parts", lambda p: F.struct(p.src.alias("src"), p.block.alias("block"), p.place.alias("place"), F.array_join(F.slice(words, (p.at + 1).cast("int"), p.words.cast("int")), " ").alias("text"), p.words.alias("words")))
    pieces = rows.join(parts, "row").select(F.explode(let(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), piece)).alias("p")).select("p.*")
    whole = pieces.groupBy("src", "block").agg(F.sum("words").alias("n_words"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x.text), " ").alias("text"))
    names = plan.sources.select("src", "source")
    return plan.slots().hint("merge").join(whole, ["src", "block"]).join(names, "src").select("shard", "slot", "source", "n_words", "text")


def _copies(text, spans):
    """The copies of a text: the k-th has the words of the spans that are taken at least k times, or is the whole text."""

    def of(words):
        def copy(k):
            some = F.filter(spans, lambda p: p.times >= k)
            part = F.flatten(F.transform(some, lambda p: F.slice(words, (p.at + 1).cast("int"), p.words.cast("int"))))
            return F.when(F.size(some) == F.size(spans), text).otherwise(F.array_join(part, " "))

        return F.transform(F.sequence(F.lit(1), F.array_max(F.transform(spans, lambda p: p.times)).cast("int")), copy)

    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: for each document as many rows as its most used block is taken times.

    Row k holds the words of the blocks that are taken at least k times; a whole document keeps its text as it is.
    Documents of which nothing is taken have no row; null and empty texts are among them.
    """
    mark, parts = free_name("row", docs), free_name("spans", docs)
    kept = with_rows(docs, mark)
    rows = stage(kept.select(F.col(mark).alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    spans = Plan(rows, **how).taken().where("taken > 0").select(F.col("row").alias(mark), F.col("spans").alias(parts))
    copies = kept.join(spans, mark).withColumn(text_col, F.explode(_copies(F.col(text_col), F.col(parts))))
    return copies.select(*map(quoted, docs.columns))
