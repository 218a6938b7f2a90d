"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point and the seed. A trigram's vector binds (multiplies) the
first letter's vector rolled twice, the second's rolled once and the third's; a text's vector bundles (adds) those of its
trigrams, and a language's prototype those of all its training texts. A text gets the language whose prototype has the
largest cosine with it, ties to the smaller name.

Some texts at a time are a matrix of trigram counts times the matrix of their distinct trigrams' vectors, a block of trigrams after
another, so neither many letters nor a long text (which is read in pieces) need much memory. Training is one pass whose
partial sums (languages x dimensions) are added up by Spark; scoring is a second pass without a shuffle. The prototypes sent
along are languages x dimensions numbers; the number of languages is checked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import batches_as_lists, fold_bucket, table, text_rows

DIMENSIONS, SEED, MAX_LANGUAGES = 512, 7, 2000
#: Characters and texts looked at together; trigrams counted in one table, and turned into vectors at once.
SLICE_CHARS, SLICE_TEXTS, TABLE, BLOCK = 1_000_000, 512, 16_384, 4096
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """By code point: is it a letter?"""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, count=0x110000)


@lru_cache(maxsize=16_384)
def letter_vector(code: int, dimensions: int, seed: int) -> np.ndarray:
    bits = np.frombuffer(hashlib.shake_256(f"{seed}:{code}".encode()).digest(-(-dimensions // 8)), np.uint8)
    return np.unpackbits(bits)[:dimensions].astype(np.float32) * 2 - 1


def _windows(code: np.ndarray, doc: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams (rows of three) of normalised code points and the text each is of. A blank's neighbours are of one text; else the text
    is the middle letter's."""
    whole = letter[1:-1] | (letter[:-2] & letter[2:] & (doc[:-2] == doc[2:]))
    return np.stack([code[:-2], code[1:-1], code[2:]], axis=1)[whole], doc[1:-1][whole]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _short(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of some texts at once. Runs of other characters than letters count as one blank, also before and after a text."""
    parts = [_codes(t.lower()) for t in texts]
    blank = np.array([32], "<u4")
    code = np.concatenate([blank, *(x for p in parts for x in (p, blank))])
    doc = np.r_[0, np.repeat(np.arange(len(texts)), [len(p) + 1 for p in parts])]
    letter = _letters()[code]
    keep = letter | np.r_[True, letter[:-1]]
    return _windows(np.where(letter, code, 32)[keep], doc[keep], letter[keep])


def _long(text: str) -> Iterator[np.ndarray]:
    """The trigrams of a long text, piece by piece; each piece takes up the last two symbols of the one before."""
    low, before, last = text.lower(), np.array([32], "<u4"), False
    for at in range(0, len(low) + 1, SLICE_CHARS):
        code = _codes(low[at : at + SLICE_CHARS] + " " * (at + SLICE_CHARS > len(low)))
        if not len(code):
            continue
        letter = _letters()[code]
        keep = letter | np.r_[last, letter[:-1]]
        last = bool(letter[-1])
        symbols = np.concatenate([before, np.where(letter, code, 32)[keep].astype("<u4")])
        yield _windows(symbols, np.zeros(len(symbols), int), symbols != 32)[0]
        before = symbols[-2:]


def _slices(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, trigrams, the text of each counted from ``from``) of runs of texts, or of a piece of a long one."""
    start = chars = 0
    for i, t in enumerate([*texts, None]):
        if t is None or len(t) > SLICE_CHARS or chars + len(t) > SLICE_CHARS or i - start >= SLICE_TEXTS:
            if start < i:
                yield start, i, *_short(texts[start:i])
            start, chars = i, 0
        if t is not None and len(t) > SLICE_CHARS:
            for trigrams in _long(t):
                yield i, i + 1, trigrams, np.zeros(len(trigrams), int)
            start = i + 1
        elif t is not None:
            chars += len(t)


def bundles(texts: list[str], group: np.ndarray, groups: int, dimensions: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """By group of texts the sum of their trigrams' vectors, and the number of trigrams."""
    out, n = np.zeros((groups, dimensions)), np.zeros(groups, np.int64)
    for i, j, trigrams, doc in _slices(texts):
        if not len(trigrams):
            continue
        names, of = np.unique(group[i:j], return_inverse=True)  # the groups of this slice
        row = of[doc]
        n[names] += np.bincount(row, minlength=len(names))
        present = np.zeros(0x110000, bool)
        present[trigrams] = True
        symbols = np.flatnonzero(present).astype("<u4")
        place, m = np.zeros(0x110000, np.int64), len(symbols)
        place[symbols] = np.arange(m)
        index = place[trigrams]
        key = (index[:, 0] * m + index[:, 1]) * m + index[:, 2]
        if m**3 <= 1 << 24:
            seen = np.flatnonzero(np.bincount(key, minlength=1))
            number = np.zeros(m**3, np.int32)
            number[seen] = np.arange(len(seen), dtype=np.int32)
            at = number[key]
        else:
            seen, at = np.unique(key, return_inverse=True)
        by_trigram = np.argsort(at, kind="stable") if len(seen) > TABLE else None
        for low in range(0, len(seen), TABLE):
            size = min(TABLE, len(seen) - low)
            if by_trigram is None:
                here = slice(None)
            else:
                here = by_trigram[np.searchsorted(at, low, sorter=by_trigram) : np.searchsorted(at, low + size, sorter=by_trigram)]
            counts = np.bincount(row[here] * size + (at[here] - low), minlength=len(names) * size).reshape(len(names), size).astype(np.float32)
            for b in range(0, size, BLOCK):
                some = seen[low + b : low + min(b + BLOCK, size)]
                codes = symbols[np.stack([some // (m * m), some // m % m, some % m], axis=1)]
                # float32 holds whole numbers up to 2**24, and a slice has fewer trigrams
                out[names] += counts[:, b : b + BLOCK] @ _vectors(codes, dimensions, seed)
    return out, n


def _vectors(trigrams: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    codes, index = np.unique(trigrams, return_inverse=True)
    index = index.reshape(trigrams.shape)
    base = np.array([letter_vector(int(c), dimensions, seed) for c in codes], np.float32).reshape(-1, dimensions)
    return np.roll(base, 2, axis=1)[index[:, 0]] * np.roll(base, 1, axis=1)[index[:, 1]] * base[index[:, 2]]


def _decode(texts: list[bytes]) -> list[str]:
    return [t.decode("utf-8", "replace") for t in texts]


def fit(docs: DataFrame, folds: int = 4, held: int = 2, dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Prototypes by language, from rows whose crc32 of doc_id is not ``held`` modulo ``folds`` and whose lang is not null.
    A null doc_id counts as the empty text."""
    rows = text_rows(docs, F.col("lang").cast("string").alias("lang"), fold_bucket(F.col("doc_id"), folds).alias("fold")).where(F.col("lang").isNotNull() & (F.col("fold") != held)).select("lang", "text")

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for langs, texts in batches_as_lists(batches, "lang", "text"):
            own = sorted(set(langs))
            group = np.array([own.index(k) for k in langs]) if len(own) < 20 else np.searchsorted(np.array(own, object), np.array(langs, object))
            for k, v in zip(own, bundles(_decode(texts), group, len(own), dimensions, seed)[0]):
                sums[k] = sums.get(k, 0) + np.rint(v).astype(np.int64)
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(v)], ["lang", "at", "value"])

    total = rows.mapInArrow(run, "lang string, at int, value long").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    # bounded: one row more than the checked number of languages has
    found = total.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("v")).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {r.lang: np.array(r.v, np.float64) for r in sorted(found, key=lambda r: r.lang)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], folds: int = 4, held: int = 2, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score (the cosine, 0 if it is negative).

    Null and empty texts, texts without letters, and all texts if nothing was learned: ``und`` with score 0. A text is never cut.
    Repeated rows give repeated rows; an empty table gives none. Of ``docs`` only doc_id and text are read."""
    names = list(prototypes)
    length = {k: np.sqrt(v @ v) for k, v in prototypes.items()}
    unit = np.array([v / length[k] if length[k] else v for k, v in prototypes.items()]).reshape(-1, dimensions)
    rows = text_rows(docs, (fold_bucket(F.col("doc_id"), folds) == held).alias("held_out"))

    def run(batches):
        for b in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            texts = _decode(b.column(1).to_pylist())
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if names:
                bundle, n = bundles(texts, np.arange(len(texts)), len(texts), dimensions, seed)
                size = np.sqrt((bundle * bundle).sum(axis=1))
                cosine = bundle @ unit.T / np.where(size > 0, size, 1)[:, None]
                best = cosine.argmax(axis=1)
                for k in np.flatnonzero(n):
                    lang[k], score[k] = names[best[k]], min(1.0, max(0.0, cosine[k, best[k]]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(lang), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op9_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
