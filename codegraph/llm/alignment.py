"""Alignment of two tokenizers' tokens over the same bytes, and how often tokens meet in the corpus."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks
from .pieces import MARK, _arrow_type, _gather, processor
from .shared import quoted, stage

#: Characters of text that a block has.
BLOCK_CHARS = 16 << 20
#: Words, and characters of texts, that are tokenized at once.
WORDS, BATCH_CHARS = 4096, 1 << 17


class Side:
    """A tokenizer with the bytes of each of its tokens."""

    def __init__(self, encode, tokens: list[bytes]):
        self.encode, self.tokens = encode, tokens
        self.widths, self.names = [len(t) for t in tokens], [str(i) for i in range(len(tokens))]


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for U+0100 and on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


@cache
def byte_level(path: str) -> Side:
    """A byte-level BPE file of the tokenizers library; strings of special tokens inside texts are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer, byte = Tokenizer.from_file(path), _byte_of_char()
    tokenizer.encode_special_tokens = True
    special = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    token = lambda i: special[i].encode() if i in special else bytes(byte[c] for c in tokenizer.id_to_token(i) or "")
    return Side(lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], [token(i) for i in range(tokenizer.get_vocab_size())])


@cache
def sentence_pieces(path: str) -> Side:
    """A SentencePiece model with byte fallback, whose mark stands for a space."""
    sp = processor(path)
    token = lambda i: bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(MARK, " ").encode()
    return Side(lambda texts: sp.encode(texts, num_threads=1), [token(i) for i in range(sp.get_piece_size())])


def ends_of(ids: list[int], side: Side) -> dict[int, int]:
    """For each byte offset at which a token ends, how many tokens have ended there."""
    return dict(zip(accumulate(map(side.widths.__getitem__, ids)), count(1)))


def cuts(a: list[int], b: list[int], left: Side, right: Side) -> tuple[list[int], list[int]]:
    """After how many tokens of ``a`` and of ``b`` the groups end: where both have a token end.

    The ends of each side are the keys of a dictionary; the keys of both, in order, cut the two lists.
    """
    ends_a, ends_b = ends_of(a, left), ends_of(b, right)
    common = sorted(ends_a.keys() & ends_b.keys())
    return [ends_a[e] for e in common], [ends_b[e] for e in common]


def links(a: list[int], b: list[int], cut_a: list[int], cut_b: list[int], left: Side, right: Side) -> list[int]:
    """The pairs of ids (``pair``) of all pairs of tokens whose byte ranges overlap, group by group."""
    out, x, y = [], 0, 0
    for i, j in zip(cut_a, cut_b):
        if i == x + 1 or j == y + 1:
            # A token that is alone on its side is linked with all of the other side.
            out += [s << 32 | t for s in a[x:i] for t in b[y:j]]
        else:
            at_x, at_y = left.widths[a[x]], right.widths[b[y]]
            while True:
                out.append(pair(a[x], b[y]))
                shift = at_x - at_y
                x, y = x + (shift <= 0), y + (shift >= 0)
                if x == i or y == j:
                    break
                at_x, at_y = at_x + (left.widths[a[x]] if shift <= 0 else 0), at_y + (right.widths[b[y]] if shift >= 0 else 0)
        x, y = i, j
    return out


def pair(a: int, b: int) -> int:
    return a << 32 | b


def tokens_of(texts: list[str], left: Side, right: Side) -> list[tuple[list[int], list[int]]]:
    """The tokens of both sides: ``left`` reads a space and the text, ``right`` the text, before which it puts a space.

    None on both sides for an empty text, and where the bytes of the tokens of a side aren't a space and the text.
    """
    out = []
    for text, a, b in zip(texts, left.encode([" " + t for t in texts]), right.encode(texts)):
        raw = b" " + text.encode()
        same = text and b"".join(map(left.tokens.__getitem__, a)) == raw and b"".join(map(right.tokens.__getitem__, b)) == raw
        out.append((a, b) if same else ([], []))
    return out


def words_of(text: str) -> list[str]:
    """A space and the text, cut before each space between a character that is no space and one that is not blank.

    No token of either side crosses such a place: a pattern of the left side begins there, and pieces of the right side
    have marks at their start alone. So tokens, groups and links of a text are those of its words.
    """
    out, open_ = [], False
    for part in text.split(" "):
        if open_ and part and not part[0].isspace() or not out:
            out.append(" " + part)
        else:
            out[-1] += " " + part
        open_ = part != ""
    return out


def groups_text(a: list[int], b: list[int], cut_a: list[int], cut_b: list[int], left: Side, right: Side) -> str:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
    names_a, names_b, out, x, y = list(map(left.names.__getitem__, a)), list(map(right.names.__getitem__, b)), [], 0, 0
    for i, j in zip(cut_a, cut_b):
        out.append(f"{names_a[x] if i == x + 1 else ','.join(names_a[x:i])}|{names_b[y] if j == y + 1 else ','.join(names_b[y:j])}")
        x, y = i, j
    return ";".join(out)


#: What a block has for each document, and its distinct pairs of ids.
PER_DOCUMENT = ("n_a", "n_b", "n_groups", "n_links")


class Words:
    """Distinct words, aligned: ``good`` unless bytes differ, counts as in PER_DOCUMENT, groups as text, and all links."""

    def __init__(self, words: list[str], left: Side, right: Side):
        self.good, self.counts, self.groups, self.links = [], [], [], []
        for at in range(0, len(words), WORDS):
            part = words[at : at + WORDS]
            for w, a, b in zip(part, left.encode(part), right.encode([w[1:] for w in part])):
                good = b"".join(map(left.tokens.__getitem__, a)) == w.encode() == b"".join(map(right.tokens.__getitem__, b))
                self.good.append(good)
                if not good:
                    a, b = [], []
                cut_a, cut_b = cuts(a, b, left, right)
                before = len(self.links)
                self.links += links(a, b, cut_a, cut_b, left, right)
                self.groups.append(groups_text(a, b, cut_a, cut_b, left, right))
                self.counts += (len(a), len(b), len(cut_a), len(self.links) - before)


def _align(left_path: str, right_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = byte_level(left_path), sentence_pieces(right_path)
        for texts, ids in blocks.of_texts(batches, BLOCK_CHARS):
            # Each distinct word of the block is tokenized and aligned once.
            known: dict[str, int] = {}
            coded = [np.array([known.setdefault(w, len(known)) for w in words_of(t)] if t else [], np.uint32) for t in texts]
            words = Words(list(known), left, right)
            good, counts = np.array(words.good, bool), np.array(words.counts, np.int64).reshape(-1, 4)
            coded = [c if good[c].all() else c[:0] for c in coded]
            totals = np.array([counts[c].sum(axis=0) for c in coded], np.int64).reshape(-1, 4)
            digests = [hashlib.sha256(";".join(map(words.groups.__getitem__, c.tolist())).encode()).hexdigest() if len(c) else "" for c in coded]
            pairs, of_link = np.unique(np.array(words.links, np.int64), return_inverse=True)
            size = counts[:, 3]
            begin = np.cumsum(size) - size
            own = [np.unique(_gather(of_link, begin[c], size[c]), return_counts=True) for c in coded]
            codes, times = (np.concatenate([o[i] for o in own]) for i in (0, 1))
            met = np.bincount(codes, weights=times, minlength=len(pairs)).astype(np.int64)
            packed = {"lengths": blocks.pack([len(o[0]) for o in own]), "codes": blocks.pack(codes), "times": blocks.pack(times)}
            numbers = {c: pa.array(totals[:, i], pa.int64()) for i, c in enumerate(PER_DOCUMENT)}
            used = np.flatnonzero(met)
            yield blocks.row_of({"ids": ids, **numbers, "groups_sha256": pa.array(digests, pa.string()), **packed, "at": pa.array(used, pa.int32()), "a": pa.array(pairs[used] >> 32, pa.int32()), "b": pa.array(pairs[used] & 0xFFFFFFFF, pa.int32()), "met": pa.array(met[used], pa.int64())})

    return run


def _sum(id_type: pa.DataType, id_name: str):
    def run(block: pa.Table, pairs: pa.Table) -> pa.Table:
        lengths, codes, times = (blocks.unpack(block.column(c)[0].as_py()) for c in ("lengths", "codes", "times"))
        at = pairs.column("at").to_numpy()
        count = np.zeros(at.max(initial=-1) + 1, np.int64)
        best = np.zeros(len(count), bool)
        count[at] = pairs.column("links").to_numpy()
        best[at] = pairs.column("links").to_numpy() == pairs.column("most").to_numpy()
        ends = np.concatenate([[0], np.cumsum(lengths)])
        part = lambda x: (lambda s: s[ends[1:]] - s[ends[:-1]])(np.concatenate([[0], np.cumsum(x)]))
        of = lambda c: block.column(c).combine_chunks().flatten()
        columns = {id_name: of("ids").cast(id_type)} | {c: of(c) for c in PER_DOCUMENT}
        return pa.table(columns | {"n_best": part(times * best[codes]), "count_sum": part(times * count[codes]), "groups_sha256": of("groups_sha256")})

    return run


def align(docs: DataFrame, left: str, right: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids_a, ids_b, cuts_a, cuts_b)``: the ids of both sides and after how many of them each group ends.

    ``left`` is a byte-level BPE file, ``right`` a SentencePiece model; ``left`` reads a space and the text. Groups end at
    the byte offsets where tokens of both end. Texts that are null or empty, or that the tokens of a side don't
    spell byte by byte, have empty lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = byte_level(left), sentence_pieces(right)
        for texts, ids in blocks.of_texts(batches, BATCH_CHARS):
            found = [(a, b, *cuts(a, b, *sides)) for a, b in tokens_of(texts, *sides)]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([f[i] for f in found], pa.list_(pa.int32())) for i in range(4)]], [id_col, *names])

    names = ("ids_a", "ids_b", "cuts_a", "cuts_b")
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(n, T.ArrayType(T.IntegerType())) for n in names]])
    return docs.select(docs[quoted(id_col)], docs[quoted(text_col)].cast("string")).mapInArrow(run, out)


def link_counts(docs: DataFrame, left: str, right: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``.

    A link is a pair of token occurrences, one of each side, whose bytes overlap. The count of a pair of ids is how
    many links of the corpus hold it; ``n_best`` has the links whose count is the highest of their right id, ties
    included, ``count_sum`` adds the counts of all links. Tokens, groups and texts without tokens are those of
    :func:`align`; texts without tokens have zeros and an empty digest. Rows with equal or null ids are rows like others.

    Documents are aligned by blocks, each distinct word of a block once, as no group crosses the space before a word. A
    block lists its distinct pairs once, with how often it has each; these are summed over the corpus, and the counts go back to the blocks. The highest count is known for each right id, at most the
    vocabulary, which is broadcast.
    """
    id_field = docs.schema[id_col]
    fields = [("ids", T.ArrayType(id_field.dataType)), *[(c, T.ArrayType(T.LongType())) for c in PER_DOCUMENT], ("groups_sha256", T.ArrayType(T.StringType())), *[(c, T.BinaryType()) for c in ("lengths", "codes", "times")], ("at", T.ArrayType(T.IntegerType())), ("a", T.ArrayType(T.IntegerType())), ("b", T.ArrayType(T.IntegerType())), ("met", T.ArrayType(T.LongType()))]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    aligned = blocks.numbered(docs.select(docs[quoted(id_col)], docs[quoted(text_col)].cast("string")).mapInArrow(_align(left, right), schema), "aligned")
    pairs = aligned.select("block", F.explode(F.arrays_zip("at", "a", "b", "met")).alias("p")).select("block", "p.*")
    counts = stage(pairs.groupBy("a", "b").agg(F.sum("met").alias("links"), F.count("*").alias("weight")), "counts")
    most = counts.groupBy("b").agg(F.max("links").alias("most"))
    table = stage(counts.join(F.broadcast(most), "b"), "pairs")
    found = blocks.lookup(pairs.drop("met"), table, ["a", "b"]).select(F.col("block").alias("block"), "at", "links", "most")
    out = T.StructType([id_field, *[T.StructField(c, T.LongType()) for c in (*PER_DOCUMENT, "n_best", "count_sum")], T.StructField("groups_sha256", T.StringType())])
    whole = aligned.drop("at", "a", "b", "met").groupBy("block").cogroup(found.groupBy("block"))
    return whole.applyInArrow(_sum(_arrow_type(id_field.dataType), id_col), out)
