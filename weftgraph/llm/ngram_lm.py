"""Language-model scores by a weighted backoff automaton.

States are the n-gram contexts seen in training. A state's arcs carry the log-probability of the words seen after it and lead to the
longest state that ends there; its failure arc carries the weight of the unseen rest and leads to the state of the shorter
context, at last to the root, whose arcs know every word. Scoring a text is one left-to-right traversal that carries the
state: at each word take its arc, or failure arcs until there is one, and add the weights.

The smoothing interpolates each order with the next shorter one:
    p(w | h) = (C(hw) + m(h) p(w | h')) / (C(h) + m(h)),   m(h) = TYPES * C(h) ** GROWTH
m(h) is what Witten and Bell take, the number of distinct words after h, as Heaps' law expects it; so the evidence of a context
weighs more the more often the context was seen. An arc weighs log10 p(w | h) and the failure arc log10 (m(h) / (C(h) + m(h))); for each
h these sum to one over all words. The root is the add-0.1 distribution over the V known words and one unknown. Each text
starts in the state of end tokens, and the end token is scored like a word.

The automaton grows with the corpus, so it is never held in one place. Texts are gathered to blocks of bounded size. A block
sends each of its distinct n-grams once (a sorted array of 64-bit hashes with its own counts) to the hash ranges that sum
them up, and gets back in the same order what the others counted: the part of the automaton that its own texts can reach. So
a frequent word costs one entry a block, no matter how often it occurs, and all that is exchanged is packed arrays. From order 3 on
a block sends only n-grams whose two shorter ones are held by other blocks too; what no other block can hold, it counts alone.
A block sends to FAN places at most, or to the square root of the ranges if that is more: beyond, relays merge the messages of many blocks for
a group of ranges, pass them on, and share out the answers. So messages stay packed whatever the corpus's size.
Two different n-grams with equal 64-bit hashes would share a count (at 10^9 distinct n-grams, a chance of 3 in 100 that any do).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import batches_as_lists, fold_bucket, settle, table, text_rows

#: m(h) = TYPES * C(h) ** GROWTH, see above. Of growths from 0.5 to 0.9 the one with the best held-out likelihood on 4 million words.
TYPES, GROWTH = 1.0, 0.9
#: Tokens of a block and entries of a hash range, about: what one task holds at a time. Ranges that a block sends to directly.
BLOCK_TOKENS, RANGE_ENTRIES, FAN = 4_000_000, 4_000_000, 1024
#: Words of a text that are read in one go; longer texts are read in several, side by side.
LANE = 1024
#: Stands for the end token; no word holds a blank.
END = b" end "

_BLOCK = "block long, n_tokens long, n_train long, ids binary, held binary, lengths binary, tokens binary, vocabulary binary"
_MESSAGE = "cell long, source long, order int, keys binary, counts binary, many binary"
_ANSWER = "source long, cell long, order int, known long, more binary, shared binary"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _pack(a: np.ndarray, ascending: bool = False) -> bytes:
    """Compressed, the n-th bytes of all numbers together; of ascending numbers their differences."""
    a = np.ascontiguousarray(a)
    if ascending and len(a):
        a = np.r_[a[:1], a[1:] - a[:-1]]
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def _unpack(b: bytes, dtype, ascending: bool = False) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    a = np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)
    return np.cumsum(a, dtype=dtype) if ascending else a


def _mix(a: np.ndarray, salt: int) -> np.ndarray:
    """splitmix64."""
    z = a + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _blocks(docs: DataFrame, block_tokens: int) -> DataFrame:
    """Bounded runs of documents as word numbers of an own vocabulary, given by its hashes."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        ids, held, lengths, tokens, numbers = [], [], [], [], {}

        def block():
            words = np.fromiter((xxhash.xxh64_intdigest(w) for w in numbers), dtype=np.uint64, count=len(numbers))
            n, h = np.array(lengths, np.int64), np.array(held, bool)
            cols = [part << 32 | seq, int(n.sum()), int(n[~h].sum()), b"".join(b"\1" * 8 + int(i).to_bytes(8, "little", signed=True) if i is not None else bytes(16) for i in ids), h.tobytes(), n.tobytes(), _pack(np.concatenate(tokens)), words.tobytes()]
            return pa.RecordBatch.from_pylist([dict(zip((c.split()[0] for c in _BLOCK.split(", ")), cols))], schema=_schema(_BLOCK))

        size = 0
        for batch in batches_as_lists(batches, "doc_id", "held_out", "text"):
            for i, out, text in zip(*batch):
                words = text.lower().split()
                words.append(END)
                tokens.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint32, len(words)))
                ids.append(i)
                held.append(out)
                lengths.append(len(words))
                size += len(words)
                if size >= block_tokens:
                    yield block()
                    seq, size = seq + 1, 0
                    ids, held, lengths, tokens, numbers = [], [], [], [], {}
        if ids:
            yield block()

    return docs.mapInArrow(run, _BLOCK)


class _Grams:
    """The n-grams of a block, for each order: its distinct hashes in order (``keys``), the number among them of the n-gram that ends at
    each position (``at``), and their counts in the block's training texts (``own``). Before a text stand end tokens."""

    def __init__(self, row: dict, order: int):
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        self.held = np.frombuffer(row["held"], bool)
        tokens = _unpack(row["tokens"], np.uint32)
        words = np.frombuffer(row["vocabulary"], np.uint64)
        self.start = np.cumsum(self.lengths) - self.lengths
        self.train = np.repeat(~self.held, self.lengths)
        self.keys, self.at, self.own, self.size = [], [], [], []
        keys, number = np.unique(_mix(words, 1), return_inverse=True)
        self._add(keys, number.astype(np.int32)[tokens])
        hash_, earlier, end = _mix(words, 1)[tokens], words[tokens], np.uint64(xxhash.xxh64_intdigest(END))
        for k in range(2, order + 1):
            earlier = self.before(earlier, end)  # the word k-1 before
            hash_ = _mix(hash_ ^ _mix(earlier, 100 + k), k)
            keys, number = np.unique(hash_, return_inverse=True)
            self._add(keys, number.astype(np.int32))

    def _add(self, keys: np.ndarray, at: np.ndarray) -> None:
        self.keys.append(keys)
        self.at.append(at)
        self.size.append(len(keys))
        self.own.append(np.bincount(at[self.train], minlength=len(keys)).astype(np.int32))

    def before(self, values: np.ndarray, first) -> np.ndarray:
        """By position the value one position earlier in its text, ``first`` where a text starts."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.start] = first
        return out

    def of_gram(self, k: int, values: np.ndarray) -> np.ndarray:
        """By n-gram of order k what ``values`` says at its positions (the same at all of them)."""
        out = np.empty(self.size[k - 1], values.dtype)
        out[self.at[k - 1]] = values
        return out


# --- what blocks exchange ---------------------------------------------------------------------------------------------------------------


def _cuts(keys: np.ndarray, cells: int) -> np.ndarray:
    """Where each of ``cells`` equal hash ranges begins among sorted keys."""
    bounds = np.array([(r << 64) // cells for r in range(1, cells)], np.uint64)
    return np.r_[0, np.searchsorted(keys, bounds), len(keys)]


def _messages(source: int, order: int, keys: np.ndarray, counts: np.ndarray, many: np.ndarray, cells: int) -> list[dict]:
    """One message to each hash range that has any of the sorted ``keys``; many: those known to be held by two blocks or more."""
    cut = _cuts(keys, cells)
    return [{"cell": r, "source": source, "order": order, "keys": _pack(keys[i:j], ascending=True), "counts": _pack(counts[i:j].astype(np.int64)), "many": _pack(many[i:j])} for r, (i, j) in enumerate(zip(cut[:-1], cut[1:])) if j > i]


def _merged(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int], np.ndarray]:
    """Of messages of one order: the distinct keys, their counts, whether several blocks hold them; each message's place in the
    concatenation, and every concatenated key's number."""
    parts = [_unpack(r["keys"], np.uint64, ascending=True) for r in rows]
    keys, number = np.unique(np.concatenate(parts), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, number, np.concatenate([_unpack(r["counts"], np.int64) for r in rows]))
    many = np.bincount(number, minlength=len(keys)) > 1
    many[number[np.concatenate([_unpack(r["many"], bool) for r in rows])]] = True
    return keys, counts, many, np.concatenate([_unpack(r["counts"], np.int64) for r in rows]), np.cumsum([0, *map(len, parts)]).tolist(), number


def _by_order(rows: list[dict]) -> dict[int, list[dict]]:
    out: dict[int, list[dict]] = {}
    for r in sorted(rows, key=lambda r: (r["order"], r["source"], r["cell"])):
        out.setdefault(r["order"], []).append(r)
    return out


def _answers(rows: list[dict], totals: np.ndarray, shared: np.ndarray, own: np.ndarray, places: list[int], number: np.ndarray, known: int) -> list[dict]:
    """For each message what others counted of its keys, in its order."""
    out = []
    for r, i, j in zip(rows, places, places[1:]):
        n = number[i:j]
        out.append({"source": r["source"], "cell": r["cell"], "order": r["order"], "known": known, "more": _pack(totals[n] - own[i:j]), "shared": _pack(shared[n])})
        known = 0
    return out


def exchange(sent: DataFrame, groups: int, ranges: int) -> DataFrame:
    """The answers to messages ``sent`` to ``groups`` hash ranges, each of which stands for ``ranges`` smaller ones. known: how many of a
    range's n-grams of this order occur in training, said once a range."""

    def total(group: pa.Table) -> pa.Table:
        out = []
        for rows in _by_order(group.to_pylist()).values():
            _, counts, many, own, places, number = _merged(rows)
            out += _answers(rows, counts, many, own, places, number, int((counts > 0).sum()))
        return pa.Table.from_pylist(out, schema=_schema(_ANSWER))

    if ranges == 1:
        return sent.groupBy("cell").applyInArrow(total, _ANSWER)
    # as many relays as ranges: a group's messages are dealt to ``ranges`` of them by source
    sent = sent.withColumn("relay", F.col("cell") * ranges + F.pmod(F.xxhash64("source"), F.lit(ranges)))

    def pass_on(group: pa.Table) -> pa.Table:
        out, relay = [], group["relay"][0].as_py()
        for k, rows in _by_order(group.to_pylist()).items():
            keys, counts, many, *_ = _merged(rows)
            out += _messages(relay, k, keys, counts, many, groups * ranges)
        return pa.Table.from_pylist(out, schema=_schema(_MESSAGE))

    def share_out(left: pa.Table, right: pa.Table) -> pa.Table:
        out, answers = [], _by_order([{**r, "source": 0} for r in right.to_pylist()])
        for k, rows in _by_order(left.to_pylist()).items():
            _, counts, _, own, places, number = _merged(rows)
            more = np.concatenate([_unpack(a["more"], np.int64) for a in answers[k]])
            shared = np.concatenate([_unpack(a["shared"], bool) for a in answers[k]])
            out += _answers(rows, counts + more, shared, own, places, number, sum(a["known"] for a in answers[k]))
        return pa.Table.from_pylist(out, schema=_schema(_ANSWER))

    passed = sent.groupBy("relay").applyInArrow(pass_on, _MESSAGE).groupBy("cell").applyInArrow(total, _ANSWER)
    return sent.groupBy("relay").cogroup(passed.groupBy("source")).applyInArrow(share_out, _ANSWER)


def _with_answers(g: _Grams, answers: list[dict], order: int, asked: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(counts in all training texts, held by other blocks too?) of a block's n-grams of an order, of which ``asked`` were sent."""
    rows = sorted((a for a in answers if a["order"] == order), key=lambda a: a["cell"])
    total, shared = g.own[order - 1].astype(np.int64), np.zeros(g.size[order - 1], bool)
    at = slice(None) if asked is None else np.flatnonzero(asked)
    if rows:
        total[at] += np.concatenate([_unpack(a["more"], np.int64) for a in rows])
        shared[at] = np.concatenate([_unpack(a["shared"], bool) for a in rows])
    return total, shared


def _asked(g: _Grams, shared: np.ndarray, k: int) -> np.ndarray:
    """Which n-grams of order k another block may hold, given which of order k - 1 one does."""
    here = shared[g.at[k - 2]]
    return g.of_gram(k, here & g.before(here, True))


# --- the automaton ------------------------------------------------------------------------------------------------------------------------


@dataclass
class Automaton:
    """State 0 is the root. By state: ``length`` of its context, the state its failure arc leads to (``fail``) and that arc's weight. By order k
    and n-gram number, the arc that reads the n-gram's last word after its others: its weight (nan: no such arc) and target."""

    length: np.ndarray
    fail: np.ndarray
    fail_weight: np.ndarray
    arc: list[np.ndarray]
    target: list[np.ndarray]
    start: int

    def step(self, state: np.ndarray, grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Reads one word for each of ``state``; grams[k - 1]: the number of the n-gram of order k that ends with it. The next states, and
        the weights of the arcs taken."""
        state, weight, to = state.copy(), np.zeros(len(state)), np.zeros(len(state), np.int64)
        level = self.length[state]
        for k in range(len(self.arc), 0, -1):
            here = np.flatnonzero(level == k - 1)
            if not len(here):
                continue
            gram = grams[k - 1][here]
            arc = self.arc[k - 1][gram]
            has = ~np.isnan(arc)
            taken, failing = here[has], here[~has]
            weight[taken] += arc[has]
            to[taken] = self.target[k - 1][gram[has]]
            level[taken] = -1
            weight[failing] += self.fail_weight[state[failing]]
            state[failing] = self.fail[state[failing]]
            level[failing] = self.length[state[failing]]
        return to, weight


def _spare(count: np.ndarray) -> np.ndarray:
    """m(h) of contexts seen ``count`` times."""
    return TYPES * count.astype(float) ** GROWTH


def compiled(g: _Grams, totals: list[np.ndarray], n_train: int, n_known: int) -> Automaton:
    """The automaton as far as the block's texts reach; totals[k - 1]: the counts of its n-grams of order k in all training texts."""
    order = len(totals)
    ends = int(totals[0][g.at[0][g.start[0] + g.lengths[0] - 1]])  # training texts: how often each context of end tokens was seen
    # states: the root, the n-grams of orders 1 to order - 1 that were seen, the end tokens of orders 2 and more
    number, length, fail, fail_weight = [], [np.zeros(1, np.int8)], [np.zeros(1, np.int32)], [np.zeros(1)]
    at = 1
    for k in range(1, order):
        seen = totals[k - 1] > 0
        own = np.where(seen, at + np.cumsum(seen, dtype=np.int32) - 1, -1).astype(np.int32)
        shorter = np.zeros(len(own), np.int32) if k == 1 else number[k - 2][g.of_gram(k, g.at[k - 2])]
        c = totals[k - 1][seen]
        number.append(own)
        length.append(np.full(len(c), k, np.int8))
        fail.append(shorter[seen])
        fail_weight.append(np.log10(_spare(c) / (c + _spare(c))))
        at += len(c)
    start = 0
    if ends and order > 1:
        start = int(number[0][g.at[0][g.start[0] + g.lengths[0] - 1]])
        for k in range(2, order):
            length.append(np.array([k], np.int8))
            fail.append(np.array([start], np.int32))
            spare = _spare(np.array([ends]))
            fail_weight.append(np.log10(spare / (ends + spare)))
            start, at = at, at + 1
    # arcs; large arrays are changed in place
    p = (totals[0] + 0.1) / (n_train + 0.1 * (n_known + 1))
    arc, target = [np.log10(p)], [np.maximum(number[0], 0) if order > 1 else np.zeros(len(p), np.int32)]
    for k in range(2, order + 1):
        suffix = g.of_gram(k, g.at[k - 2])
        target.append(number[k - 1] if k < order else np.maximum(number[k - 2][suffix], 0))
        p = p[suffix]
        del suffix
        c = g.of_gram(k, g.before(totals[k - 2][g.at[k - 2]], ends))
        m = _spare(c)
        p *= m
        p += totals[k - 1]
        m += c
        # a context without a state has no arc
        m[c == 0] = 1.0
        p /= m
        del c, m
        weight = np.full(len(p), np.nan)
        arc.append(np.log10(p, out=weight, where=totals[k - 1] > 0))
    return Automaton(np.concatenate(length), np.concatenate(fail), np.concatenate(fail_weight), arc, target, start)


def traverse(a: Automaton, g: _Grams) -> np.ndarray:
    """The score of each text: one pass from left to right over all texts side by side, each carrying its state. Of a long
    text several pieces are read side by side; a piece first reads as many words before it as a state can remember, unweighted."""
    remembered = len(a.arc) - 1
    pieces = -(-g.lengths // LANE)
    text = np.repeat(np.arange(len(pieces)), pieces)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    warm = np.minimum(remembered, nth * LANE)
    begin = g.start[text] + nth * LANE - warm
    steps = np.minimum(LANE, g.lengths[text] - nth * LANE) + warm
    longest = np.argsort(-steps, kind="stable")
    text, nth, warm, begin, steps = (x[longest] for x in (text, nth, warm, begin, steps))
    state, total = np.where(nth > 0, 0, a.start), np.zeros(len(text))
    reading = np.searchsorted(-steps, -np.arange(steps[0]))  # how many pieces have a word for each step
    for t, n in enumerate(reading.tolist()):
        at = begin[:n] + t
        state[:n], weight = a.step(state[:n], [x[at] for x in g.at])
        total[:n] += np.where(warm[:n] <= t, weight, 0.0)
    return np.bincount(text, weights=total, minlength=len(pieces))


def lm_scores(docs: DataFrame, folds: int = 10, order: int = 3, block_tokens: int = BLOCK_TOKENS, range_entries: int = RANGE_ENTRIES, fan: int = FAN) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (see the module).

    Learns from rows whose crc32 of doc_id as text is not 0 modulo ``folds``; a null doc_id counts as the empty text and is
    held out. Null texts count as empty: one token, the end. Without training rows every word is unknown and N is 0.
    Repeated rows give repeated rows and count as often. An empty table gives none. Columns other than doc_id and text
    are ignored."""
    if not 1 <= order <= LANE:
        raise ValueError(f"order is from 1 to {LANE}")
    rows = text_rows(docs, (fold_bucket(F.col("doc_id"), folds) == 0).alias("held_out"))
    blocks = settle(_blocks(rows, block_tokens))
    n_tokens, n_train = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0))).first()

    def shape(entries: int) -> tuple[int, int]:
        wanted = max(1, -(-entries // range_entries))
        groups = wanted if wanted <= fan else max(fan, math.isqrt(wanted))
        return groups, -(-wanted // groups)

    def first(batches):
        for b in batches:
            for row in b.to_pylist():
                g, out = _Grams(row, min(order, 2)), []
                for k in range(1, min(order, 2) + 1):
                    out += _messages(row["block"], k, g.keys[k - 1], g.own[k - 1], np.zeros(len(g.keys[k - 1]), bool), groups)
                yield pa.RecordBatch.from_pylist(out, schema=_schema(_MESSAGE))

    def replayed(g: _Grams, answers: list[dict], upto: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The totals of orders 1 to ``upto``, and which n-grams of the last are held by other blocks."""
        totals, shared = [], None
        for k in range(1, upto + 1):
            total, shared = _with_answers(g, answers, k, _asked(g, shared, k) if k > 2 else None)
            totals.append(total)
        return totals, shared

    def later(k: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out, answers = [], right.to_pylist()
            for row in left.to_pylist():
                g = _Grams(row, k)
                asked = _asked(g, replayed(g, answers, k - 1)[1], k)
                out += _messages(row["block"], k, g.keys[k - 1][asked], g.own[k - 1][asked], np.zeros(int(asked.sum()), bool), groups)
            return pa.Table.from_pylist(out, schema=_schema(_MESSAGE))

        return run

    groups, ranges = shape(n_tokens * min(order, 2))
    answers = settle(exchange(blocks.select("block", "held", "lengths", "tokens", "vocabulary").mapInArrow(first, _MESSAGE), groups, ranges), release=True)
    n_known = answers.where("order = 1").agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    for k in range(3, order + 1):
        groups, ranges = shape(n_tokens)
        more = exchange(blocks.groupBy("block").cogroup(answers.groupBy("source")).applyInArrow(later(k), _MESSAGE), groups, ranges)
        # after relays the last answers are settled too: the blocks are dealt once more, but not while the relays' messages are on disk
        answers = answers.unionByName(settle(more, release=True) if k < order or ranges > 1 else more)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out, answers = [], right.to_pylist()
        for row in left.to_pylist():
            g = _Grams(row, order)
            totals = replayed(g, answers, order)[0]
            del g.own, g.keys
            automaton = compiled(g, totals, n_train, n_known)
            ids, by_text = np.frombuffer(row["ids"], np.int64).reshape(-1, 2), lambda x: np.add.reduceat(x[g.at[0]], g.start)  # noqa: B023
            out.append(pa.table({
                "doc_id": pa.array(ids[:, 1], pa.int64(), mask=ids[:, 0] == 0), "held_out": pa.array(g.held), "n_tokens": pa.array(g.lengths), "n_known": pa.array(by_text((totals[0] > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(len(ids), n_train)), "base_score": pa.array(by_text(automaton.arc[0])), "score": pa.array(traverse(automaton, g)),
            }))
        return pa.concat_tables(out)

    return blocks.groupBy("block").cogroup(answers.groupBy("source")).applyInArrow(run, schema)


def op4_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
