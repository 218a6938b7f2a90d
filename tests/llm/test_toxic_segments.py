import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from weftgraph.llm import toxic_segments as m

SF = "/root/testdata/sf0.01"


def brute(scores, i=0, j=None):
    """By definition: the largest segment (the shortest of equals), and the same to its left and right."""
    j = len(scores) if j is None else j
    best = None
    for a in range(i, j):
        total = 0.0
        for b in range(a, j):
            total += scores[b]
            if total > 0 and (best is None or total > best[2] + 1e-12):
                best = (a, b + 1, total)
    return [] if best is None else [*brute(scores, i, best[0]), best, *brute(scores, best[1], j)]


def test_segments_match_definition():
    rng = random.Random(4)
    for _ in range(800):
        scores = [rng.choice([-1, -0.5, -2, 1, 2, 0.7, -0.3]) + rng.random() / 100 for _ in range(rng.randrange(14))]
        assert [s[:2] for s in m.segments(scores)] == [s[:2] for s in brute(scores)]


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in m.op8_toxic_segments(spark, SF).collect() if r.held_out and r.doc_id in labels]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    hit = Counter((labels[r.doc_id], r.predicted) for r in rows)
    assert hit[0, 1] <= 0.03 * (hit[0, 0] + hit[0, 1])
    assert hit[1, 1] >= 0.6 * (hit[1, 0] + hit[1, 1])


def corpus(spark):
    rng = random.Random(6)
    plain = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = []
    for i in range(300):
        w = [rng.choice(plain) for _ in range(60)]
        if i % 4 == 0:
            w[10:10] = ["nasty", "vilething", "nasty"]
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, passages string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None), (999, 1), (0, 0)], "doc_id long, toxic int")


def test_finds_the_passage_and_odd_rows(spark):
    docs, labels = corpus(spark)
    model = m.fit(docs, labels)
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1002, "12 !! "), (None, "a nasty b"), (1003, "worda " * 20000 + "nasty nasty vilething nasty"), (1003, "again")], "doc_id long, text string")
    got = m.score(odd, model, with_passages=True).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    long = next(r for r in got if r.passages and r.doc_id == 1003)
    assert [(p.from_word, p.to_word) for p in long.passages] == [(20000, 20004)]
    assert {r.score for r in got if r.doc_id in (1001, 1002)} == {next(r.score for r in got if r.doc_id == 1000)}
    again = m.fit(docs.repartition(5), labels)
    assert (again.score, again.weights) == (model.score, model.weights)


def test_nothing_to_learn(spark):
    docs, labels = corpus(spark)
    assert len({r.score for r in m.score(docs, m.fit(docs, labels.where("toxic = 0"))).collect()}) == 1
    empty = docs.where("false")
    assert m.score(empty, m.fit(empty, labels)).count() == 0


def brute_terms(rows):
    """Terms that pass Benjamini and Hochberg's test, by sorting all of them; rows: (text, toxic)."""
    seen = {0: Counter(), 1: Counter()}
    for t, y in rows:
        own = set(re.findall(r"[^\W\d_]+", (t or "").lower()))
        # a prefix once a text
        seen[y].update(own | {w[:k] + "-" for w in own for k in (4, 5) if len(w) > k})
    out = {}
    for kind in (0, 4, 5):
        of = lambda t: (len(t) - 1 if t[-1] == "-" else 0) == kind  # noqa: B023, E731
        na, nb = (sum(n for t, n in seen[y].items() if of(t)) for y in (1, 0))
        if not na or not nb:
            continue
        tests = sorted((*m.evidence(seen[1][t], seen[0][t], na, nb), t) for t in seen[0].keys() | seen[1].keys() if of(t) and seen[0][t] + seen[1][t] >= m.LEAST)
        last = max((i for i, (c, *_) in enumerate(tests, 1) if c <= math.log(m.RATE * i / len(tests))), default=0)
        out |= {t: (c, d) for c, d, t in tests[:last] if abs(d) >= m.LARGE}
    return out


def test_evidence_matches_the_binomial_sum():
    for x, y, na, nb in ((3, 0, 50, 400), (0, 9, 50, 60), (7, 7, 100, 300), (40, 2, 900, 900)):
        share = na / (na + nb)
        n = x + y
        tail = lambda k, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))  # noqa: B023, E731
        chance, d = m.evidence(x, y, na, nb)
        assert math.isclose(math.exp(chance), tail(x, share) if d >= 0 and x / n > share else tail(y, 1 - share), rel_tol=1e-6)


def test_model_and_scores_match_brute_force(spark):
    docs, labels = corpus(spark)
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    label = {r.doc_id: r.toxic for r in labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").max("toxic").toDF("doc_id", "toxic").collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    model = m.fit(docs, labels)
    want = brute_terms([(text[i], y) for i, y in label.items() if i in text and not held(i)])
    assert set(model.score) == set(want) and {"nasty", "vilething", "vile-"} <= set(want)
    for t, pair in want.items():
        assert np.allclose(model.score[t], pair)

    def probability(t):
        scores = []
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            known = [want[x] for x in (w, w[:5] + "-" if len(w) > 5 else "", w[:4] + "-" if len(w) > 4 else "") if x in want]
            scores.append(min(known)[1] - m.DRIFT if known else -m.DRIFT)
        n, found = len(scores), [(s, len(scores) * math.exp(-model.rate * s)) for *_, s in brute(scores)]
        best = -math.log(min(e for _, e in found)) if found else -math.log(n) - 1
        x = (math.copysign(math.log1p(abs(best)), best), math.log1p(sum(s for s, e in found if e <= m.SIGNIFICANT)) / n**0.25)
        z = model.weights[0] + sum(w * (v - c) for w, v, c in zip(model.weights[1:], x, model.centre))
        return 1 / (1 + math.exp(-z))

    got = m.score(docs, model).collect()
    assert len(got) == len(text)
    for r in got:
        assert r.held_out == held(r.doc_id) and math.isclose(r.score, probability(text[r.doc_id]), rel_tol=1e-6)


def test_all_terms_are_tested(spark):
    """More terms than any cap would keep: the rare ones that mark toxic texts are still found."""
    rng = random.Random(2)
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    rows = []
    for i in range(400):
        w = [name(rng.randrange(26**4)) for _ in range(200)] + ["qqrare"] * (i % 5 == 0 and i < 300)
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = m.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert model.score["qqrare"][1] > m.LARGE
