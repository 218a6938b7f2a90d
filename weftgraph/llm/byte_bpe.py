"""Byte-level BPE in two tiers.

A text is cut into pre-tokens by a pattern. A minimal perfect hash (hash and displace: as many slots as vocabulary entries,
one small number a bucket) resolves those that are vocabulary entries as they are; a slot's bytes are compared, so a stranger
is never taken for an entry. The others are merged from their bytes: pieces are a linked list over the bytes, pairs wait in a
heap by rank and place, so a pre-token of n bytes takes O(n log n) whatever its length. Results of either tier are kept in a
memo of bounded size, since words repeat.

The whole is one narrow pass over the documents: no shuffle. Vocabulary and hash go with the task; they are as large as the
rank file (50,256 entries), which does not grow with the data and whose size is checked.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, text_rows

#: Entries of the memo and the longest pre-token that it keeps; rows handled at a time; the most vocabulary entries.
MEMO, MEMO_CHARS, SLICE, MAX_VOCABULARY = 150_000, 40, 500, 1_000_000
#: The characters with the property White_Space, as a class's inside.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Texts with characters below this only are cut by the quicker of the two pattern engines.
FEW = 0x250


class PerfectHash:
    """Minimal perfect hash from byte strings to 0 .. n - 1."""

    def __init__(self, keys: list[bytes]):
        if len(set(keys)) < len(keys):
            raise ValueError("keys repeat")
        self.n, self.buckets = len(keys), max(1, len(keys) // 3)
        for self.seed in range(1000):  # nearly always the first will do
            if (shift := self._displace([xxhash.xxh64_intdigest(k, self.seed) for k in keys])) is not None:
                self.shift: list[int] = shift
                return
        raise ValueError("no displacement found")

    def _displace(self, hashes: list[int]) -> list[int] | None:
        """A number for each bucket, the fullest first, that puts all its keys into free slots."""
        n = self.n
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for h in hashes:
            members[h % self.buckets].append(h)
        shift, free = [0] * self.buckets, np.ones(n, bool)
        order = sorted(range(self.buckets), key=lambda b: -len(members[b]))
        tries = np.arange(256, dtype=np.uint64)[:, None]
        for b in order:
            h = np.array(members[b], np.uint64)
            if len(h) < 2:
                break
            start, step = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
            for base in range(0, 1 << 20, len(tries)):
                at = np.sort((start + (tries + np.uint64(base)) * step) % np.uint64(n), axis=1)
                good = np.flatnonzero(free[at].all(axis=1) & (at[:, 1:] != at[:, :-1]).all(axis=1))
                if len(good):
                    shift[b] = base + int(good[0])
                    free[at[good[0]]] = False
                    break
                if base > 4 * n:
                    return None
            else:
                return None
        left = iter(np.flatnonzero(free).tolist())
        for b in order:
            if len(members[b]) == 1:
                shift[b] = -1 - next(left)  # a single key takes a free slot by its number
        return shift

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh64_intdigest(key, self.seed)
        d = self.shift[h % self.buckets]
        return -1 - d if d < 0 else ((h >> 32) + d * ((h & 0xFFFFFFFF) | 1)) % self.n if self.n else -1


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each entry, its bytes in base64 and its rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"{len(ranks)} entries are too many to send along with every task")
    return ranks


def _classes(pattern: str, inside: dict[str, str]) -> str:
    """``pattern`` with its escapes for character classes spelled out."""
    out, depth = [], 0
    for part in re.findall(r"\\p\{\w\}|\\.|.", pattern, re.S):
        if part in inside:
            out.append(inside[part] if depth else f"[{inside[part]}]")
        elif part == r"\S" and not depth:
            out.append(f"[^{inside[chr(92) + 's']}]")
        else:
            depth += {"[": 1, "]": -1}.get(part, 0)
            out.append(part)
    return "".join(out)


class Cutter:
    """Cuts texts into pre-tokens."""

    def __init__(self, pattern: str):
        def few(kind: str) -> str:
            return "".join(re.escape(chr(c)) for c in range(FEW) if unicodedata.category(chr(c)).startswith(kind))

        self.all = regex.compile(_classes(pattern, {r"\s": WHITE}))
        self.quick = re.compile(_classes(pattern, {r"\s": WHITE, r"\p{L}": few("L"), r"\p{N}": few("N")}))
        self.far = re.compile(f"[^\\x00-\\u{FEW - 1:04x}]")

    def __call__(self, text: str) -> list[str]:
        return (self.all if not text.isascii() and self.far.search(text) else self.quick).findall(text)


class Tokenizer(dict):
    """The two tiers; as a dict, the memo of pre-token to ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.hash = PerfectHash(list(ranks))
        self.entry: list[tuple[bytes, int]] = [(b"", 0)] * len(ranks)
        for key, rank in ranks.items():
            self.entry[self.hash.slot(key)] = (key, rank)
        self.cut = Cutter(pattern)

    def __reduce__(self):
        return _restore, (xxhash.xxh64_intdigest(repr((self.pattern, self.entry))), self.ranks, self.pattern, self.hash, self.entry)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = self.encode_piece(piece.encode())
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = found
        return found

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        key, rank = self.entry[self.hash.slot(piece)]
        return (rank,) if key == piece else self.merge(piece)

    def merge(self, b: bytes) -> tuple[int, ...]:
        rank, n = self.ranks.get, len(b)
        end, prev = list(range(1, n + 1)), list(range(-1, n - 1))  # of the piece that begins at a byte; end 0: it was merged
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(b[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, e = heappop(heap)
            m = end[i]
            if not m or m >= n or end[m] != e:
                continue  # one of the two has changed since
            end[i], end[m] = e, 0
            if e < n:
                prev[e] = i
                if (r := rank(b[i : end[e]])) is not None:
                    heappush(heap, (r, i, end[e]))
            if i and (r := rank(b[prev[i] : e])) is not None:
                heappush(heap, (r, prev[i], e))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[b[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode(self, text: str) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.__getitem__, self.cut(text))), dtype=np.int32)


#: The tokenizer of this Python worker, with its memo, by digest: kept from task to task.
_KEPT: dict[int, Tokenizer] = {}


def _restore(digest: int, ranks, pattern, hash_, entry) -> Tokenizer:
    if digest not in _KEPT:
        t = Tokenizer.__new__(Tokenizer)
        t.ranks, t.pattern, t.hash, t.entry, t.cut = ranks, pattern, hash_, entry, Cutter(pattern)
        _KEPT.clear()
        _KEPT[digest] = t
    return _KEPT[digest]


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *(len(v) for v in values)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *values])))


def encode(docs: DataFrame, ranks_path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """(doc_id long, ids array<int>) of every row's whole text; with ``decoded`` also the bytes that the ids stand for.

    Null and empty texts have no ids. Bytes that are no UTF-8 count as U+FFFD. The text of a special token is plain text.
    Repeated rows give repeated rows; an empty table gives none. Columns other than doc_id and text are ignored.
    The rank file is read once, on the driver; every single byte must be an entry."""
    ranks = read_ranks(ranks_path)
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"{len(missing)} single bytes are not in the vocabulary")
    tokenizer = Tokenizer(ranks, pattern)
    entries = _entries(ranks) if decoded else None

    def run(batches):
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), SLICE):
                b = whole.slice(at, SLICE)
                ids = _lists([tokenizer.encode(t.decode("utf-8", "replace")) for t in b.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0), ids, *([_decoded(ids, entries)] if decoded else [])], ["doc_id", "ids", "decoded"][: 2 + decoded])

    return text_rows(docs).mapInArrow(run, "doc_id long, ids array<int>" + ", decoded binary" * decoded)


def _entries(ranks: dict[bytes, int]) -> pa.Array:
    by_id = [None] * (max(ranks.values()) + 1)
    for key, rank in ranks.items():
        by_id[rank] = key
    return pa.array(by_id, pa.binary())


def _decoded(ids: pa.ListArray, entries: pa.Array) -> pa.Array:
    """The joined bytes of each list."""
    return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, entries.take(ids.values)), pa.scalar(b"", pa.binary()))


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, decoded binary) from (doc_id, ids array<int>). Null ids count as none; an id without entry fails."""
    entries = _entries(read_ranks(ranks_path))

    def run(batches):
        for b in batches:
            ids = pa.ListArray.from_arrays(*(lambda c: (c.offsets, c.values))(b.column(1))) if b.column(1).offset == 0 else pa.array(b.column(1).to_pylist(), pa.list_(pa.int32()))
            out = _decoded(ids, entries)
            if out.null_count:
                raise ValueError("an id has no entry in the vocabulary")
            yield pa.RecordBatch.from_arrays([b.column(0), out], ["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long"), F.coalesce("ids", F.expr("cast(array() as array<int>)")).alias("ids")).mapInArrow(run, "doc_id long, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The query's columns, from the ids and the decoded bytes."""
    found = encode(docs, ranks_path, pattern, decoded=True)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(ranks), public_tokenizers.PATTERN)
