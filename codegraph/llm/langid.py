"""Language identification by hyperdimensional letter profiles."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, quoted

DIM, SEED = 1024, 6
#: Bits of a code point, and up to how many different letters a table of all their trigrams is used to number them.
POINT, TABLE = 21, 160
#: At most about so many texts of a language are learned from, chosen by a hash of their id.
PER_LANGUAGE = 10_000
#: Texts and letters that are held at once, and n-grams and counts that are multiplied at once.
TEXTS, LETTERS, GRAMS, COUNTS = 512, 1 << 20, 2048, 1 << 22
#: Sums of unit vectors are kept as whole numbers of this part, so that their order doesn't matter.
UNIT = 1 << 20
UNKNOWN = "und"


@functools.lru_cache(1 << 15)
def _letter_vector(point: int) -> np.ndarray:
    """The random vector of a code point; 0 stands for all that is no letter."""
    return np.random.default_rng([SEED, point]).integers(0, 2, DIM, np.int8) * 2 - 1


@functools.cache
def _letters() -> np.ndarray:
    """Every code point as itself if it is a letter, else as 0."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], np.int64)


def _codes(text: str) -> Iterator[np.ndarray]:
    """Codes of the letter trigrams of one text, in pieces; a run of other characters counts as one blank."""
    tail = np.zeros(1, np.int64)
    for at in range(0, len(text), LETTERS):
        piece = text[at : at + LETTERS].lower().encode("utf-32-le", "surrogatepass")
        x = np.concatenate([tail, _letters()[np.frombuffer(piece, "<u4")]])
        if at + LETTERS >= len(text):
            x = np.append(x, 0)
        x = x[np.append(True, (x[1:] != 0) | (x[:-1] != 0))]
        if len(x) > 2:
            yield x[:-2] << 2 * POINT | x[1:-1] << POINT | x[2:]
        tail = x[-2:]


def _numbered(codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The number of each trigram among the different ones; those as three rows of letter numbers; and the letters."""
    low = (1 << POINT) - 1
    seen = np.zeros(0x110000, bool)
    for k in range(3):
        seen[codes >> k * POINT & low] = True
    letters = np.flatnonzero(seen)
    n, place = len(letters), np.cumsum(seen, dtype=np.int64) - 1
    local = (place[codes >> 2 * POINT] * n + place[codes >> POINT & low]) * n + place[codes & low]
    if n <= TABLE:
        there = np.zeros(n**3, bool)
        there[local] = True
        grams, number = np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - 1)[local]
    else:
        grams, number = np.unique(local, return_inverse=True)
    return number, [grams // (n * n), grams // n % n, grams % n], letters


def _gram_vectors(vectors: np.ndarray, grams: list[np.ndarray]) -> np.ndarray:
    """An n-gram is its letters' vectors, rotated by their places and multiplied."""
    return np.roll(vectors[grams[0]], 2, axis=1) * np.roll(vectors[grams[1]], 1, axis=1) * vectors[grams[2]]


def profiles(texts) -> np.ndarray:
    """The bundled n-gram vectors of each text, scaled to length 1; zeros for null and for texts without a letter."""
    out = np.zeros((len(texts), DIM), np.float32)
    rows, parts, held = [], [], 0
    for i, text in enumerate(texts):
        for codes in _codes(text) if isinstance(text, str) else ():
            if codes.any():
                rows.append(i)
                parts.append(codes)
                held += len(codes)
            if held >= LETTERS or len(rows) >= TEXTS:
                _bundle(out, rows, parts)
                rows, parts, held = [], [], 0
    _bundle(out, rows, parts)
    out /= np.maximum(np.sqrt(np.einsum("ij,ij->i", out, out, dtype=np.float64)), 1e-9)[:, None].astype(np.float32)
    return out


def _bundle(out: np.ndarray, rows: list[int], parts: list[np.ndarray]) -> None:
    """Add the counted n-gram vectors of each part to its row, in blocks that need a bounded table of counts."""
    if not rows:
        return
    number, grams, letters = _numbered(np.concatenate(parts))
    vectors, n = np.stack([_letter_vector(int(c)) for c in letters]), len(grams[0])
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    step = max(1, COUNTS // n)
    for first in range(0, len(rows), step):
        some, last = rows[first : first + step], min(first + step, len(rows))
        owner = np.repeat(np.arange(last - first), np.diff(ends[first : last + 1]))
        counts = np.bincount(owner * n + number[ends[first] : ends[last]], minlength=len(some) * n).reshape(len(some), n)
        sums = np.zeros((len(some), DIM), np.float32)
        for at in range(0, n, GRAMS):
            sums += counts[:, at : at + GRAMS].astype(np.float32) @ _gram_vectors(vectors, [g[at : at + GRAMS] for g in grams]).astype(np.float32)
        np.add.at(out, some, sums)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = PER_LANGUAGE) -> dict[str, np.ndarray]:
    """A prototype for each language: the bundle of its texts' profiles.

    Rows with a null text or language teach nothing. Of a language with more than ``per_language`` texts a sample of
    about that size is used; it depends on the ids only. Sums are made in the tasks and by Spark, the driver gets
    one vector for each language.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    full = 1 << 20
    share = {k: -(-full * per_language // max(n, per_language)) for k, n in counts.items()}
    if not share:
        return {}
    limit = F.create_map(*[F.lit(x) for k, n in share.items() for x in (k, n)])[F.col("lang")]
    sample = known.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(full)) < limit)

    def bundle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for frame in frames:
            for at in range(0, len(frame), TEXTS):
                part = frame.iloc[at : at + TEXTS]
                unit = np.rint(profiles(part["text"].tolist()).astype(np.float64) * UNIT).astype(np.int64)
                for lang, rows in part.groupby("lang").indices.items():
                    sums[lang] = sums.get(lang, 0) + unit[rows].sum(axis=0)
        for lang, v in sums.items():
            yield pd.DataFrame({"lang": lang, "at": np.arange(DIM), "v": v})

    sums = sample.select("lang", "text").mapInPandas(bundle, "lang string, at int, v long").groupBy("lang", "at").agg(F.sum("v").alias("v")).collect()
    out = {k: np.zeros(DIM) for k in sorted(share)}
    for r in sums:
        out[r.lang][r["at"]] = r.v
    return {k: v / n for k, v in out.items() if (n := np.linalg.norm(v))}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the language whose prototype has the largest cosine with the text, and that cosine, 0 at least.

    Ties go to the first name. Null texts, texts without a letter, and every text if nothing was learned get ``und``
    and 0. Only the text is read. Columns of the two names are replaced; others are kept.
    """
    names = [*prototypes, UNKNOWN]
    matrix = np.array([*prototypes.values()], np.float32).reshape(-1, DIM)

    @F.pandas_udf("lang string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        best, score = [], []
        for at in range(0, len(texts), TEXTS):
            p = profiles(texts.iloc[at : at + TEXTS].tolist())
            cosines = p @ matrix.T
            some = p.any(axis=1) & (len(matrix) > 0)
            best += np.where(some, cosines.argmax(axis=1) if len(matrix) else 0, len(names) - 1).tolist()
            score += np.where(some, np.clip(cosines.max(axis=1, initial=0), 0, 1), 0).astype(float).tolist()
        return pd.DataFrame({"lang": [names[i] for i in best], "score": np.array(score, float)}, index=texts.index)

    got = free_name("got", docs)
    kept = [quoted(c) for c in docs.columns if c not in (lang_col, score_col)]
    return docs.withColumn(got, judge(F.col(text_col))).select(*kept, F.col(f"{got}.lang").alias(lang_col), F.col(f"{got}.score").alias(score_col))


def held_out(id_col: str = "doc_id"):
    """Documents that are never learned from: those whose id as text has a CRC-32 of remainder 1 by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
