"""Exact top-k inner products over a bit-sliced index.

The index holds rows in blocks. In a block every attribute, quantised to its SLICES highest bits (two's complement less
the block's minimum, so unsigned), is kept as bit slices: one bitmap over the block's rows for each bit. For a query the
slices are added up with bitmap arithmetic (carry-save adders: a full adder over bitmaps replaces three of a weight by one of
the same and one of the next), each attribute's slices taken for the set bits of its quantised query weight; some queries are
done at once. The sum's slices are walked from the most significant one downwards: rows that are surely in, and rows tied so far,
until the k-th best sum is known. Rows within the quantisation's proven error of it are the boundary; they get their exact
score, and the best k are the answer.

Index blocks are built in one narrow pass. Blocks and queries meet on a grid whose cells hold about CELL_BLOCKS blocks and CELL_QUERIES
queries (less where that would leave cores idle), dealt by hash. So a block is copied once for CELL_QUERIES queries and a query once for
CELL_BLOCKS * BLOCK rows, in the fewest bytes that hold its values, and a cell gives k rows for each of its queries whatever it holds.
The best k of all cells are the answer. Values of any finite size are exact: those beyond 32 bits, and sums that may need more than 64, are
worked with as Python's integers.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import settle, table

#: Rows of an index block, blocks and queries of a cell, queries added up at once, bits kept of attributes and of query weights.
BLOCK, CELL_BLOCKS, CELL_QUERIES, TOGETHER, ATTRIBUTE_BITS, WEIGHT_BITS = 4096, 32, 16_384, 32, 8, 8
#: The range of scores as they are returned.
LEAST, LARGEST = -(2**63), 2**63 - 1

_INDEX = "block long, n int, dims int, ids binary, width int, values binary, slices binary, shift int, queries binary"


def stored(x: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers in the fewest bytes each: 1, 2, 4 or 8; 0: larger ones, pickled."""
    top = max((abs(int(v)) for v in (x.min(initial=0), x.max(initial=0))), default=0)
    width = next((w for w in (1, 2, 4) if top < 1 << 8 * w - 1), 0)
    return width, x.astype(f"i{width}").tobytes() if width else pickle.dumps(x.astype(object).ravel().tolist())


def restored(width: int, b: bytes, dims: int) -> np.ndarray:
    """Rows of whole numbers: of 64 bits, or Python's if they need more than 32."""
    x = np.frombuffer(b, f"i{width}").astype(np.int64) if width else np.array(pickle.loads(b), object)
    return x.reshape(-1, dims)


def scaled(v: list[float], scale: int) -> np.ndarray | list[int]:
    """floor(scale * x) of each component: an array if all are below 2**31."""
    with np.errstate(over="ignore"):
        x = np.floor(np.array(v, np.float64) * scale)
    if np.abs(x).max() < 1 << 31:
        return x.astype(np.int64)
    return [math.floor(y) if math.isfinite(y := scale * x) else scale * int(x) for x in v]


def quantise(x: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """Per column (x - its minimum) >> shift, which has at most ``bits`` bits; one shift for all columns."""
    low = x.min(axis=0)
    top = int((x - low).max()) if x.size else 0
    shift = max(0, top.bit_length() - bits)
    return ((x - low) >> shift).astype(np.int64), shift


def slices(q: np.ndarray, bits: int) -> np.ndarray:
    """Bitmaps [attribute, bit, word] over the rows of ``q`` (rows x attributes), padded to words of 64 bits."""
    rows = -(-len(q) // 64) * 64
    out = np.empty((q.shape[1], bits, rows // 64), np.uint64)
    for b in range(bits):
        plane = np.zeros((rows, q.shape[1]), np.uint8)
        plane[: len(q)] = q >> b & 1
        out[:, b] = np.ascontiguousarray(np.packbits(plane.T, axis=1, bitorder="little")).view(np.uint64)
    return out


class Adder:
    """Adds up bitmaps of weights 2**k by full adders; at most two bitmaps of a weight wait."""

    def __init__(self):
        self.waiting: list[list[np.ndarray]] = []

    def add(self, k: int, plane: np.ndarray) -> None:
        while len(self.waiting) <= k:
            self.waiting.append([])
        own = self.waiting[k]
        if len(own) < 2:
            own.append(plane)
            return
        a, b = own
        x = a ^ b
        carry = (a & b) | (x & plane)
        own[:] = [x ^ plane]
        self.add(k + 1, carry)

    def sums(self) -> list[np.ndarray | None]:
        """The sum's slices, the least first; None: no bit set."""
        k = 0
        while k < len(self.waiting):
            own = self.waiting[k]
            if len(own) == 2:
                a, b = own
                own[:] = [a ^ b]
                self.add(k + 1, a & b)
            k += 1
        return [own[0] if own else None for own in self.waiting]


def top_sums(sums: list[np.ndarray | None], among: np.ndarray, k: int) -> np.ndarray:
    """For each query (row) the k-th largest sum among the rows of its bitmap (the least, if there are fewer), bit by bit from
    the top."""
    wanted = np.minimum(k, np.bitwise_count(among).sum(axis=1, dtype=np.int64))
    value, tied, sure = np.zeros(len(among), np.int64), among, np.zeros(len(among), np.int64)
    for b in range(len(sums) - 1, -1, -1):
        if sums[b] is None:
            continue
        ones = tied & sums[b]
        n = np.bitwise_count(ones).sum(axis=1, dtype=np.int64)
        set_ = sure + n >= wanted
        value |= np.where(set_, 1 << b, 0)
        tied = np.where(set_[:, None], ones, tied & ~ones)
        sure += np.where(set_, 0, n)
    return value


def at_least(sums: list[np.ndarray | None], among: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each query the bitmap of the rows of its bitmap whose sum is ``value`` or more."""
    over, tied = np.where((value <= 0)[:, None], among, np.uint64(0)), np.where((value >> len(sums) > 0)[:, None], np.uint64(0), among)
    for b in range(len(sums) - 1, -1, -1):
        plane = np.zeros_like(among) if sums[b] is None else sums[b]
        bit = (np.maximum(value, 0) >> b & 1).astype(bool)[:, None]
        over = np.where(bit, over, over | (tied & plane))
        tied = tied & np.where(bit, plane, ~plane)
    return over | tied


_ALL = np.uint64(2**64 - 1)


class Block:
    def __init__(self, row: dict):
        self.n, self.dims, self.shift = row["n"], row["dims"], row["shift"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.values = restored(row["width"], row["values"], self.dims)
        self.small = row["width"] > 0
        self.top = max(1, int(self.values.max(initial=0)), -int(self.values.min(initial=0)))
        self.slices = np.frombuffer(row["slices"], np.uint64).reshape(self.dims, ATTRIBUTE_BITS, -1)
        self.all = slices(np.ones((self.n, 1), np.int64), 1)[0, 0]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        """For each query: positions and exact scores of its k best rows (ties to smaller ids), without rows of its own id."""
        among = np.repeat(self.all[None], len(queries), axis=0)
        for at in np.flatnonzero(np.isin(query_ids, self.ids)):
            among[at] &= ~slices((self.ids == query_ids[at])[:, None].astype(np.int64), 1)[0, 0]
        # score = query . low + query . a with a = x - low >= 0; a negative weight takes its attribute's complement:
        # w * a = |w| * (top - a) - |w| * top, so all that is added is positive and the rest is a constant of the query
        # bounds may need more than 64 bits: Python's integers
        weight = np.abs(queries.astype(object))
        coarse = max(0, int(weight.max(initial=0)).bit_length() - WEIGHT_BITS)
        w = ((weight + (1 << coarse >> 1)) >> coarse).astype(np.int64)
        flip = np.where(queries < 0, _ALL, np.uint64(0))
        adder = Adder()
        for j in range(self.dims):
            masks = [(c, np.where(w[:, j] >> c & 1, _ALL, np.uint64(0))[:, None]) for c in range(int(w[:, j].max(initial=0)).bit_length())]
            masks = [(c, x) for c, x in masks if x.any()]
            for b in range(ATTRIBUTE_BITS) if masks else ():
                plane = self.slices[j, b][None] ^ flip[:, j][:, None]
                for c, mask in masks:
                    adder.add(b + c, plane & mask)
        sums = adder.sums()
        # between exact and sum * unit lie the bits lost of attributes and of weights
        unit, full = 1 << (self.shift + coarse), ((1 << ATTRIBUTE_BITS) << self.shift) - 1
        used = w.astype(object) << coarse
        lost = (used * ((1 << self.shift) - 1)).sum(axis=1) + (np.abs(weight - used) * full).sum(axis=1)
        chosen = at_least(sums, among, top_sums(sums, among, k) - (-(-2 * lost // unit)).astype(np.int64))
        reach = weight.sum(axis=1) * self.top  # no score, and no part of its sum, is larger
        for query, most, rows in zip(queries, reach, np.unpackbits(chosen.view(np.uint8), axis=1, bitorder="little")[:, : self.n]):
            exact = np.int64 if self.small and most <= LARGEST else object
            rows = np.flatnonzero(rows)
            scores = self.values[rows].astype(exact) @ query.astype(exact)
            best = np.lexsort((self.ids[rows], -scores))[:k] if exact is np.int64 else np.array(sorted(range(len(rows)), key=lambda i: (-scores[i], self.ids[rows[i]]))[:k], int)  # noqa: B023
            yield rows[best], scores[best]


def index(vectors: DataFrame, scale: int = 256, query_modulus: int = 50, block: int = BLOCK) -> DataFrame:
    """Index blocks of (vec_id, embedding): every row with a vec_id and a vector of finite components, floor(scale * x).
    A block holds vectors of one length only. ``queries``: the positions of rows whose id is divisible by ``query_modulus``."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        open_: dict[int, tuple[list, list]] = {}

        def made(dims):
            nonlocal seq
            ids, rows = open_.pop(dims)
            x = np.array(rows, np.int64 if all(isinstance(r, np.ndarray) for r in rows) else object)
            ids = np.array(ids, np.int64)
            q, shift = quantise(x, ATTRIBUTE_BITS)
            seq += 1
            row = [part << 32 | seq, len(ids), dims, ids.tobytes(), *stored(x), slices(q, ATTRIBUTE_BITS).tobytes(), shift, np.flatnonzero(ids % query_modulus == 0).astype(np.int32).tobytes()]
            return pa.RecordBatch.from_pylist([dict(zip((c.split()[0] for c in _INDEX.split(", ")), row))], schema=_index_schema())

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not v:
                    continue
                ids, rows = open_.setdefault(len(v), ([], []))
                ids.append(i)
                rows.append(scaled(v, scale))
                if len(ids) >= block:
                    yield made(len(v))
        for dims in list(open_):
            yield made(dims)

    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).mapInArrow(run, _INDEX)


def _index_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _INDEX.split(", ")])


def top_k(vectors: DataFrame, k: int = 5, query_modulus: int = 50, scale: int = 256, block: int = BLOCK, cell_blocks: int = CELL_BLOCKS, cell_queries: int = CELL_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``query_modulus`` the ``k`` rows with other
    ids and the highest inner products, ties to smaller ids.

    Null ids and vectors that are null, empty or hold null or non-finite components take no part. Vectors of other lengths
    than the query's are no candidates. A repeated candidate row counts as often as it occurs; a repeated query row gets a
    list for each occurrence. Scores are compared exactly; one that no long holds is returned as the nearest long. An empty table
    gives none. Other columns than vec_id and embedding are ignored."""
    built = settle(index(vectors, scale, query_modulus, block))
    n, asked = built.agg(F.count("*"), F.coalesce(F.sum(F.length("queries") / 4), F.lit(0))).first()
    row_cells, query_cells = max(1, -(-n // cell_blocks)), max(1, -(-int(asked) // cell_queries))
    row_cells = max(row_cells, min(n, -(-2 * vectors.sparkSession.sparkContext.defaultParallelism // query_cells)))
    # r and c are int on both sides: cogroup does not cast, and an int and a long of one value are dealt to different tasks, so they never meet
    blocks = built.drop("queries").select("*", F.expr(f"CAST(pmod(xxhash64(block), {row_cells}) AS INT)").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(query_cells - 1))).alias("c"))
    query_schema = pa.schema([("asker", pa.int64()), ("place", pa.int64()), ("query_id", pa.int64()), ("dims", pa.int32()), ("width", pa.int32()), ("query", pa.binary())])

    def ask(batches):
        for b in batches:
            for row in b.to_pylist():
                at = np.frombuffer(row["queries"], np.int32)
                ids, x = np.frombuffer(row["ids"], np.int64)[at], restored(row["width"], row["values"], row["dims"])[at]
                out = [dict(zip(query_schema.names, (row["block"], int(p), int(i), row["dims"], *stored(v)))) for p, i, v in zip(at, ids, x)]
                yield pa.RecordBatch.from_pylist(out, schema=query_schema)

    queries = built.where("length(queries) > 0").select("block", "dims", "ids", "width", "values", "queries").mapInArrow(ask, "asker long, place long, query_id long, dims int, width int, query binary")
    queries = queries.select("*", F.expr(f"CAST(pmod(xxhash64(asker, place), {query_cells}) AS INT)").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(row_cells - 1))).alias("r"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        by_dims: dict[int, list[dict]] = {}
        for q in right.select(query_schema.names).to_pylist():
            by_dims.setdefault(q["dims"], []).append(q)
        best: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # by query its k best (-score, vec_id) so far
        for row in left.to_pylist():
            own, asked = Block(row), by_dims.get(row["dims"], [])
            for at in range(0, len(asked), TOGETHER):
                some = asked[at : at + TOGETHER]
                x = [restored(q["width"], q["query"], row["dims"])[0] for q in some]
                x = np.array(x, np.int64 if all(q["width"] for q in some) else object)
                for q, (rows, scores) in zip(some, own.search(np.array([q["query_id"] for q in some], np.int64), x, k)):
                    key, found = (q["asker"], q["place"], q["query_id"]), list(zip((-scores).tolist(), own.ids[rows].tolist()))
                    best[key] = sorted(best[key] + found)[:k] if key in best else found
        out = [(*key, i, -s) for key, found in best.items() for s, i in found]
        # scores beyond a long are told apart as text by the cut to the best k
        columns = [pa.array([r[i] for r in out], pa.int64()) for i in range(4)]
        return pa.table([*columns, pa.array([min(LARGEST, max(LEAST, r[4])) for r in out], pa.int64()), pa.array([_sortable(r[4]) for r in out], pa.binary())], names=["asker", "place", "query_id", "vec_id", "score", "exact"])

    met = blocks.groupBy("r", "c").cogroup(queries.groupBy("r", "c")).applyInArrow(cell, "asker long, place long, query_id long, vec_id long, score long, exact binary")
    order = Window.partitionBy("asker", "place").orderBy(F.desc("score"), F.desc("exact"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _sortable(score: int) -> bytes | None:
    """Of a score that no long holds, bytes in the order of such scores; null of any other."""
    if LEAST <= score <= LARGEST:
        return b"\xff" * 3 if score == LEAST else None
    size = score.bit_length() // 8 + 1
    shown = size if score > 0 else 0xFFFF - size
    return shown.to_bytes(2) + (score + (1 << 8 * size) * (score < 0)).to_bytes(size)


def op1_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
