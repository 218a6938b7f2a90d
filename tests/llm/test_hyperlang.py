import re
import tracemalloc

import numpy as np

from weftgraph.llm import hyperlang as h

SF = "/root/testdata/sf0.01"


def brute_vector(text):
    """Trigram by trigram."""
    t = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    t = re.sub(" +", " ", t)
    v, n = np.zeros(h.DIMENSIONS), 0
    for a, b, c in zip(t, t[1:], t[2:]):
        v += np.roll(h.letter_vector(ord(a), h.DIMENSIONS, h.SEED), 2) * np.roll(h.letter_vector(ord(b), h.DIMENSIONS, h.SEED), 1) * h.letter_vector(ord(c), h.DIMENSIONS, h.SEED)
        n += 1
    return v, n


def check(texts):
    got, n = h.bundles(texts, np.arange(len(texts)), len(texts), h.DIMENSIONS, h.SEED)
    for t, g, k in zip(texts, got, n):
        want, count = brute_vector(t)
        assert k == (count if any(x.isalpha() for x in t) else 0)
        assert np.allclose(g, want if k else 0)


def test_batch_vectors_match_brute_force(monkeypatch):
    texts = ["The cat, the DOG", "", "123 !!", "x", "é à — ñandú", "a1b2c3 d", " lead", "trail ", "İstanbul ßtraße 漢字", "long " * 300, "!a", "a ", "ab"]
    check(texts)
    many = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 400))  # too many symbols for a table of all trigrams
    check([many, *texts])
    monkeypatch.setattr(h, "TABLE", 100)
    monkeypatch.setattr(h, "BLOCK", 30)
    check([many, *texts])
    for size in range(1, 9):  # texts longer than this are read in pieces
        monkeypatch.setattr(h, "SLICE_CHARS", size)
        check(texts)
    together, n = h.bundles(texts, np.arange(len(texts)) % 2, 2, h.DIMENSIONS, h.SEED)
    apart, m = h.bundles(texts, np.arange(len(texts)), len(texts), h.DIMENSIONS, h.SEED)
    assert np.allclose(together, [apart[::2].sum(axis=0), apart[1::2].sum(axis=0)]) and n.tolist() == [m[::2].sum(), m[1::2].sum()]


def test_a_large_alphabet_and_a_long_text_need_little_memory():
    rng = np.random.default_rng(4)
    text = lambda n: "".join(map(chr, rng.integers(0x4E00, 0x9FA5, n)))
    texts = [text(2000) for _ in range(200)] + [text(1_000_000)]
    tracemalloc.start()
    _, n = h.bundles(texts, np.arange(len(texts)), len(texts), h.DIMENSIONS, h.SEED)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n.tolist() == [2000] * 200 + [1_000_000]
    assert peak < 600e6


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = [r for r in h.op9_hyperdimensional_language(spark, SF).collect() if r.held_out]
    assert len(rows) > 150 and sum(truth[r.doc_id] == r.lang_pred for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en", "x"), (2, "der hund und die katze", "de", "x"), (3, None, "en", None), (4, "", None, None), (5, "12 !", "de", None), (None, "the dog", None, "x"), (6, "und der hund", None, "x"), (6, "und der hund", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = {(r.doc_id, r.lang_pred) for r in h.predict(docs, h.fit(docs, folds=1)).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (6, "de"), (None, "en")} <= got
    none = docs.where("false")
    assert h.predict(none, h.fit(none)).count() == 0
    assert {r.lang_pred for r in h.predict(docs, {}).collect()} == {"und"}
