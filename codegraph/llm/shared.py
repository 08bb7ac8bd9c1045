"""What the operators of this package share: words, and tables on the way."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import delete, drop_staged, shared_path
from ..sources.shared import stage as written

__all__ = ["BLANKS", "WORD", "ascii_lower", "drop_staged", "free_name", "new_path", "quoted", "stage", "step"]

#: What every word-based operator calls a word: a run of characters other than ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

new_path = shared_path
#: Folders of tables that the running step of a pipeline has staged; None outside of steps.
_made: list[str] | None = None


def stage(df: DataFrame, name: str) -> DataFrame:
    """As :func:`codegraph.sources.shared.stage`; inside a :func:`step` the table lives until the next one begins."""
    out = written(df, name)
    if _made is not None:
        _made.extend({f.rpartition("/")[0] for f in out.inputFiles()})
    return out


def step(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A step ``run(spark, docs, ...)`` of a pipeline, whose result is written before the next step reads it.

    When a step begins, the tables that the steps before it staged are deleted, but for those that its ``docs`` read.
    """

    @wraps(run)
    def scoped(spark, docs, *rest):
        global _made
        read = {f.rpartition("/")[0] for f in docs.inputFiles()}
        kept = [folder for folder in _made or () if folder in read]
        for folder in set(_made or ()) - set(kept):
            delete(spark, folder)
        _made = kept
        return run(spark, docs, *rest)

    return scoped


def quoted(name: str) -> str:
    """A column's name as it has to be written to select it, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def free_name(name: str, df: DataFrame) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text):
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


#: Spark writes the same file's address with one slash or with three.
SLASHES = ":/+"


def with_rows(docs: DataFrame, mark: str) -> DataFrame:
    """``docs`` with a number for each row in the column ``mark``, the same whenever it is read.

    Rows of Parquet files have the number of their file and their place in it, so nothing is copied. Any other table is
    written first, with the numbers that its rows have at that moment.
    """
    plan = docs._jdf.queryExecution().analyzed()
    scan = plan.getClass().getSimpleName() == "LogicalRelation" and plan.relation().toString().lower() == "parquet"
    if not scan or "_metadata" in {c.lower() for c in docs.columns}:
        return stage(docs.withColumn(mark, F.monotonically_increasing_id()), "rows")
    file, at, number = (free_name(n, docs) for n in ("file", "at", "number"))
    # A row for each file of the table, which the driver lists anyway.
    numbers = docs.sparkSession.createDataFrame([(re.sub(SLASHES, ":/", f, count=1), i) for i, f in enumerate(sorted(docs.inputFiles()))], f"{file} string, {number} long")
    known = docs.select("*", F.regexp_replace("_metadata.file_path", rf"\A([^/]*){SLASHES}", "$1:/").alias(file), F.col("_metadata.row_index").alias(at)).join(F.broadcast(numbers), file, "left")
    row = F.shiftleft(F.coalesce(number, F.raise_error(F.concat(F.lit("an unknown file: "), file)).cast("long")), 40).bitwiseOR(F.col(at))
    return known.select(*map(quoted, docs.columns), row.alias(mark))
