"""SentencePiece encoding and decoding through a table of distinct marked words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks
from .shared import quoted

MARK = "▁"
#: A run of marks with what follows up to the next; only at the start of a text there may be none.
MARKED = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Words that the library segments at once, and after how many words a table ends with the block.
WORDS, MOST_WORDS = 4096, 1 << 20


@cache
def processor(model: str):
    """The library's processor for a model file, once for each Python worker."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


@cache
def adds_mark(model: str) -> bool:
    return processor(model).normalize("a") == MARK + "a"


def check(model: str) -> None:
    """Raise where a piece has a mark after another character, or the mark is none: words can't be segmented one by one then."""
    sp = processor(model)
    crossing = [p for p in (sp.id_to_piece(i) for i in range(sp.get_piece_size())) if MARK in p.lstrip(MARK)]
    if sp.id_to_piece(sp.piece_to_id(MARK)) != MARK:
        raise ValueError("the whitespace mark is no piece")
    if crossing:
        raise ValueError(f"pieces cross whitespace marks: {crossing[:3]}")


def marked_words(text: str, model: str) -> list[str]:
    """The words of the normalised text, each with the marks before it; joined they are that text."""
    return MARKED.findall(processor(model).normalize(text))


def segment(words: list[str], model: str) -> list[list[int]]:
    """The ids of each marked word.

    The library puts a mark of its own before a text, in place of the word's first, but none before an empty one.
    """
    drop, sp = adds_mark(model), processor(model)
    found = sp.encode([(w[1:] if drop and w.startswith(MARK) else w).replace(MARK, " ") for w in words], num_threads=1)
    return [[sp.piece_to_id(MARK)] if w == MARK else ids for w, ids in zip(words, found)]


class Table:
    """Distinct words with their ids: words are numbered as they come, and each is segmented once."""

    def __init__(self, model: str):
        self.model, self.known, self.size, self.pieces = model, {}, np.zeros(0, np.int64), np.zeros(0, np.int32)

    def codes(self, texts: list[str]) -> list[list[int]]:
        """The numbers of the words of each text by position; new words are added."""
        before, known = len(self.known), self.known
        out = [[known.setdefault(w, len(known)) for w in marked_words(t, self.model)] for t in texts]
        new = list(islice(known, before, None))
        found = [ids for at in range(0, len(new), WORDS) for ids in segment(new[at : at + WORDS], self.model)]
        self.size = np.concatenate([self.size, np.fromiter(map(len, found), np.int64, len(found))])
        self.pieces = np.concatenate([self.pieces, np.fromiter(chain.from_iterable(found), np.int32)])
        return out

    def ids(self, codes: np.ndarray) -> np.ndarray:
        return _gather(self.pieces, (np.cumsum(self.size) - self.size)[codes], self.size[codes])


def _gather(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``values`` one after the other."""
    ends = np.cumsum(size)
    return values[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, piece_ids)`` for each row: the ids that the library gives for the whole text, without begin or end ids.

    Pieces of the model never hold a whitespace mark after another character (else this raises), so no merge crosses the
    start of a marked word. A task keeps a table of the distinct words that it has met, each of which it segments once;
    a text is the ids of its words by position. A table with over a million words is begun anew, which bounds it, so
    nothing is shuffled or written on the way. Null and empty texts have no ids; rows with equal or null ids are rows
    like others; further columns are not read. Texts are held by about 4 million characters, a longer one by itself.
    """
    check(model)
    names = [id_col, "piece_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(model)
        for texts, ids in blocks.of_texts(batches):
            if len(table.known) > MOST_WORDS:
                table = Table(model)
            codes = table.codes(texts)
            ends = np.cumsum([0, *map(len, codes)])
            flat = np.fromiter(chain.from_iterable(codes), np.int64, ends[-1])
            offsets = np.concatenate([[0], np.cumsum(table.size[flat])])[ends]
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(table.ids(flat)))], names)

    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece_ids", T.ArrayType(T.IntegerType()))])
    return docs.select(docs[quoted(id_col)], docs[quoted(text_col)].cast("string")).mapInArrow(run, out)


def _arrow_type(data_type: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(data_type)


def decode(piece_ids, model: str):
    """A column: the text that the library decodes from whole lists of ids; null for null."""

    @F.pandas_udf(T.StringType())
    def run(lists: pd.Series) -> pd.Series:
        sp = processor(model)
        return pd.Series([None if ids is None else sp.decode(ids.tolist()) for ids in lists], dtype=object)

    return run(piece_ids)
