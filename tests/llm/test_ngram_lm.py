import math
import os
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from weftgraph.llm import ngram_lm as lm

SCHEMA = "doc_id long, text string, score string, block string"


def brute(rows, order):
    """p(w | h) straight from the definition, by recursion over the orders."""
    words = lambda t: [w for w in (t or "").encode().lower().split()] + [lm.END]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    grams, contexts, n = Counter(), Counter(), 0
    for i, t in rows:
        if not held(i):
            w = [lm.END] * (order - 1) + words(t)
            n += len(w) - order + 1
            for at in range(order - 1, len(w)):
                for k in range(1, order + 1):
                    grams[tuple(w[at - k + 1 : at + 1])] += 1
                    contexts[tuple(w[at - k + 1 : at])] += 1
    known = sum(len(g) == 1 for g in grams)

    def p(h, w):
        if not h:
            return (grams[(w,)] + 0.1) / (n + 0.1 * (known + 1))
        c, low = contexts[h], p(h[1:], w)
        m = lm.TYPES * c**lm.GROWTH
        return (grams[(*h, w)] + m * low) / (c + m) if c else low

    out = []
    for i, t in rows:
        w = [lm.END] * (order - 1) + words(t)
        at = range(order - 1, len(w))
        out.append((i, held(i), len(at), sum(grams[(w[j],)] > 0 for j in at), n, sum(math.log10(p((), w[j])) for j in at), sum(math.log10(p(tuple(w[j - order + 1 : j]), w[j])) for j in at)))
    return sorted(out, key=str)


ROWS = [(i, t) for i, t in enumerate(["The cat sat", "the CAT sat on the mat", "", None, "a b a b a b a b c", "unheard words here", "the the the", "x\ty\nz  x y", "É é", "long " * 5000] * 4)] + [(None, "the cat"), (3, "again the cat"), (3, "again the cat")]


#: The last two send by relays: 4 and 2 groups of several ranges.
@pytest.mark.parametrize(("order", "block_tokens", "range_entries", "fan"), [(1, 50, 2000, 1024), (2, 40, 700, 1024), (2, 10**6, 10**6, 1024), (3, 30, 2500, 1024), (3, 30, 1500, 4), (4, 25, 3000, 2)])
def test_matches_definition(spark, order, block_tokens, range_entries, fan):
    docs = spark.createDataFrame([(i, t, "s", None) for i, t in ROWS], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in lm.lm_scores(docs, order=order, block_tokens=block_tokens, range_entries=range_entries, fan=fan).collect()), key=str)
    want = brute(ROWS, order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_the_registered_query_matches_definition(spark):
    from weftgraph.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    want = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()], 3)
    got = sorted((tuple(r) for r in QUERIES["op4_ngram_lm"](spark, sf).collect()), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_an_automaton_of_one_block():
    """States, failure arcs and arcs of "a b" seen twice and "a c" once."""
    texts, numbers = ["a b", "a b", "a c"], {b"a": 0, b"b": 1, lm.END: 2, b"c": 3}
    tokens = [numbers[w] for t in texts for w in [*t.encode().split(), lm.END]]
    row = {"lengths": np.array([3, 3, 3]).tobytes(), "held": np.zeros(3, bool).tobytes(), "tokens": lm._pack(np.array(tokens, np.uint32)), "vocabulary": np.array([lm.xxhash.xxh64_intdigest(w) for w in numbers], np.uint64).tobytes()}
    g = lm._Grams(row, 3)
    a = lm.compiled(g, g.own, 9, 4)
    # the root, 4 words, 5 pairs (end a, a b, a c, b end, c end), two end tokens
    assert sorted(a.length.tolist()) == [0] + [1] * 4 + [2] * 6
    assert (a.length[a.fail] == np.maximum(a.length - 1, 0)).all() and a.length[a.start] == 2
    state = np.array([a.start])
    for at, length in zip(range(3), (2, 2, 2)):
        state, _ = a.step(state, [x[[at]] for x in g.at])
        assert a.length[state[0]] == length
    unseen = [np.array([len(k)]) for k in g.keys]
    a.arc[0], a.target[0] = np.r_[a.arc[0], -5.0], np.r_[a.target[0], 0]
    a.arc[1:], a.target[1:] = [np.r_[x, np.nan] for x in a.arc[1:]], [np.r_[x, 0] for x in a.target[1:]]
    to, weight = a.step(np.array([a.start]), unseen)
    assert to[0] == 0 and weight[0] == pytest.approx(-5.0 + a.fail_weight[a.start] + a.fail_weight[a.fail[a.start]])


def test_pieces_of_a_long_text_agree_with_one(monkeypatch):
    texts, numbers = [f"{'x ' * i}a b c b a {'b c ' * i}" for i in range(40)], {}
    tokens = [[numbers.setdefault(w, len(numbers)) for w in [*t.encode().split(), lm.END]] for t in texts]
    row = {"lengths": np.array(list(map(len, tokens))).tobytes(), "held": np.arange(40) % 3 == 0, "tokens": lm._pack(np.array(sum(tokens, []), np.uint32)), "vocabulary": np.array([lm.xxhash.xxh64_intdigest(w) for w in numbers], np.uint64).tobytes()}
    row["held"] = row["held"].tobytes()
    for order in (1, 2, 3, 4):
        g = lm._Grams(row, order)
        a = lm.compiled(g, g.own, int(g.train.sum()), len(numbers))
        whole = lm.traverse(a, g)
        for lane in (4, 7, 50):
            monkeypatch.setattr(lm, "LANE", lane)
            assert np.allclose(lm.traverse(a, g), whole, rtol=1e-12)
        monkeypatch.undo()


def test_empty_table_and_no_training_rows(spark):
    assert lm.lm_scores(spark.createDataFrame([], SCHEMA)).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = lm.lm_scores(spark.createDataFrame([(only, "a b", None, None)], SCHEMA)).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (True, 3, 0, 0, 0.0, 0.0)


def shuffles(spark):
    """Bytes on disk by shuffle."""
    files, sizes = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n"), Counter()
    for f in filter(re.compile(r"/shuffle_\d+_\d+_\d+\.data$").search, files):
        if os.path.exists(f):
            sizes[int(os.path.basename(f).split("_")[1])] += os.path.getsize(f)
    return sizes


@pytest.mark.parametrize(("fan", "times"), [(1024, 2), (2, 3)])
def test_messages_leave_the_disk_once_answered(spark, monkeypatch, fan, times):
    """Direct or by relays: when the answers are settled, no shuffle of the messages is left, and none were settled as well."""
    settle, settled = lm.settle, []
    monkeypatch.setattr(lm, "settle", lambda df, **more: settled.append(df) or settle(df, **more))  # kept, so that no garbage collection takes their files
    docs = spark.createDataFrame([(i, t, "s", None) for i, t in ROWS], SCHEMA).coalesce(3)
    before = set(shuffles(spark))
    scores = lm.lm_scores(docs, block_tokens=30, range_entries=1500, fan=fan)
    for _ in range(100):
        # more than what the sums of a row for each partition take
        if not (left := {k: n for k, n in shuffles(spark).items() if k not in before and n > 1000}):
            break
        time.sleep(0.1)
    assert not left
    assert not any("cell" in df.columns and "keys" in df.columns for df in settled)
    assert len(settled) == times  # the blocks, the answers of orders 1 and 2, after relays those of order 3
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    want = brute(ROWS, 3)
    got = sorted((tuple(r) for r in scores.collect()), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_relays_read_their_messages_from_one_exchange(spark):
    sent = spark.createDataFrame([(c, s, 1, lm._pack(np.array([c << 62 | s], np.uint64), True), lm._pack(np.array([1], np.int64)), lm._pack(np.array([False]))) for c in range(2) for s in range(8)], lm._MESSAGE)
    answers = lm.exchange(sent.mapInArrow(lambda batches: batches, lm._MESSAGE), 2, 3)
    rows = answers.collect()
    assert len(rows) == 16 and not any(lm._unpack(r["more"], np.int64).any() or lm._unpack(r["shared"], bool).any() for r in rows)
    final = answers._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") == 1
