import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from weftgraph.llm import simhash
from weftgraph.llm.components import connected_components
from weftgraph.llm.shared import join_labels


def brute_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """By union-find over all pairs."""
    parent = list(range(len(fps)))

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[top(i)] = top(j)
    return [top(i) for i in range(len(fps))]


def documents(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(40):
        w = [rng.choice(words) for _ in range(rng.choice([2, 5, 60, 200]))]
        texts.append(" ".join(w))
        for _ in range(rng.choice([0, 0, 1, 6])):
            v = list(w)
            v[rng.randrange(len(v))] = rng.choice(words)
            texts.append("\n ".join(v))
    texts += ["", None, "\t \n", "Ünïcode TEXT ABC", "ünïcode text abc", "one", "one two", "x " * 30000]
    rows = [(i + 10, t, "fp", "c") for i, t in enumerate(texts)] + [(None, texts[0], "", ""), (10, texts[0], None, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, fp string, component string")


def test_matches_brute_force_over_all_pairs(spark):
    rows, docs = documents(spark)
    fps = [brute_fingerprint(r[1]) for r in rows]
    top = brute_components(fps)
    least = {}
    for r, t in zip(rows, top):
        if r[0] is not None:
            least[t] = min(r[0], least.get(t, r[0]))
    expected = sorted(((r[0], f & (2**64 - 1), least.get(t)) for r, f, t in zip(rows, fps, top)), key=str)
    got = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == expected


def test_links_are_whole_with_tiny_cells(spark):
    """Hot anchors: many fingerprints around one, cut into a grid; components must be those of all pairs."""
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 2, 3, 4, 9) for _ in range(40)} | {rng.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    label = {r.node & (2**64 - 1): r.component for r in connected_components(simhash.links(df, cell_rows=8)).collect()}
    top = brute_components(fps)
    for i in range(len(fps)):
        for j in range(i):
            same = label.get(fps[i], fps[i]) == label.get(fps[j], fps[j])
            assert same == (top[i] == top[j])


def test_anchor_covers(spark):
    """Any two fingerprints at one differing bit within a half share an anchor there."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**62, 50)
    fps = sorted({int(v) for v in x} | {int(v) ^ (1 << b) for v in x[:3] for b in range(31)})
    at = {}
    for r in simhash.anchors(spark.createDataFrame([(f,) for f in fps], "fp long")).collect():
        at.setdefault(r.fp, set()).add(r.anchor)
    low = lambda s: {a for a in s if a < 2**31}
    for v in x[:3]:
        for b in range(31):
            assert low(at[int(v)]) & low(at[int(v) ^ (1 << b)])


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chain_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}
    assert connected_components(edges.where(F.lit(False))).count() == 0


def test_one_row_of_each_component_stays(spark):
    rows, docs = documents(spark)
    fps = [brute_fingerprint(r[1]) for r in rows]
    top = brute_components(fps)
    got = simhash.representatives(docs)
    assert got.columns == docs.columns
    kept = [(r.doc_id, brute_fingerprint(r.text)) for r in got.collect()]
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    want = {t: min(((r[0] if r[0] is not None else 2**63 - 1, signed(f), r[0]) for r, f, u in zip(rows, fps, top) if u == t)) for t in set(top)}
    assert sorted(kept, key=str) == sorted(((i, f & (2**64 - 1)) for _, f, i in want.values()), key=str)
    only_null = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, "x y z w v u")], "doc_id long, text string")
    assert sorted(r.text for r in simhash.representatives(only_null).collect()) == ["a b c", "x y z w v u"]
    assert simhash.representatives(docs.where("false")).count() == 0


def test_labels_reach_hot_and_other_keys(spark):
    """One key has half of all rows; whatever counts as hot, every row gets its label once."""
    keys = [0] * 60 + [1] * 20 + list(range(2, 42))
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    labels = spark.createDataFrame([(k, f"label {k}", keys.count(k)) for k in set(keys)], "k long, label string, n long")
    for hot_keys in (1, 3, 10, 1000):
        got = join_labels(rows, labels, "k", hot_keys)
        assert got.columns == ["k", "i", "label"]
        assert sorted((r.i, r.label) for r in got.collect()) == [(i, f"label {k}") for i, k in enumerate(keys)]
    assert join_labels(rows.where("false"), labels.where("false"), "k").count() == 0
