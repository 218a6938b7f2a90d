import json
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from weftgraph.llm import quality_rules as q

SF = "/root/testdata/sf0.01"
P = len(q.FLOORS)


def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, v in enumerate(windows) if windows.count(v) > 1 for k in range(3)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)]


def test_counts_match_brute_force():
    rng = random.Random(8)
    texts = ["", " \n ", "a", "a b a b a b a b", "x\ny\nx\n\n\n y\ny", "é ñ # $$", " nbsp  \x1c here", "<b> | & </b>\r\n<b>"]
    texts += ["".join(rng.choice(["a ", "b ", "cc ", "\n", "#", "é", "a b c "]) for _ in range(rng.randrange(60))) for _ in range(200)]
    for t in texts:
        m = q.measure(t.encode())
        assert [m[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == brute_counts(t), t


def brute_starts(x):
    """Medians and spreads, and the scatters that they make with no, sign and tanh correlations."""
    low = np.trunc(np.abs(x) / 8) * np.sign(x) * 8.0  # toward zero, as div does
    half = lambda v: np.sort(v)[math.ceil(len(v) / 2) - 1]
    centre = np.array([half(low[:, i]) for i in range(P)])
    floors = np.array(list(q.FLOORS.values())) * q.GRID
    spread = np.array([math.hypot(1.4826 * half(np.abs(low[:, i] - centre[i])), floors[i]) for i in range(P)])
    z = (x - centre) / spread
    out = [np.diag(spread**2)]
    for u in (z / np.sqrt((z * z).sum(axis=1, keepdims=True) + 1e-12), np.tanh(z)):
        m = np.array([[np.rint(u[:, i] * u[:, j] * 2**20).sum() for j in range(P)] for i in range(P)]) + np.eye(P)
        out.append(m / np.sqrt(np.outer(np.diag(m), np.diag(m))) * np.outer(spread, spread))
    return [(centre, s + np.diag(floors**2)) for s in out]


def brute_step(x, centre, scatter, target):
    d = x - centre
    c = np.floor(32 * np.log2(1 + np.maximum(np.einsum("ri,ij,rj->r", d, np.linalg.inv(scatter), d), 0)))
    wanted, weight = math.ceil(q.H * len(x)), np.zeros(len(x))
    for k in np.unique(c):
        weight[c == k] = min(1.0, max(0.0, (wanted - (c < k).sum()) / (c == k).sum()))
    mean = weight @ x / wanted
    inner = (weight[:, None] * (x - mean)).T @ (x - mean) / wanted * q._inflation(P)
    if target is not None:
        own = len(x) / (len(x) + q.PRIOR)
        mean, inner = own * mean + (1 - own) * target[0], own * inner + (1 - own) * target[1]
    return mean, inner + np.diag((np.array(list(q.FLOORS.values())) * q.GRID) ** 2)


def brute_mcd(x, target=None):
    """Rows one by one instead of sums by class: (centre, scatter)."""
    found = []
    for at, (centre, scatter) in enumerate(brute_starts(x)):
        det = math.inf
        for step in range(q.TRIALS):
            new = brute_step(x, centre, scatter, target)
            if not (now := np.linalg.slogdet(new[1])[1]) < det - 1e-9:
                break
            (centre, scatter), det = new, now
        found.append((det, at, centre, scatter, step + 1 == q.TRIALS and det == now))
    det, _, centre, scatter, open_ = min(found, key=lambda f: f[:2])
    for _ in range(q.STEPS if open_ else 0):
        new = brute_step(x, centre, scatter, target)
        if not (now := np.linalg.slogdet(new[1])[1]) < det - 1e-9:
            break
        (centre, scatter), det = new, now
    return centre, scatter


def brute_fit(rows):
    """rows: (lang, source, x). By language and source its estimate."""
    group = lambda key: {k: np.array([x for *g, x in rows if key(g) == k], float) for k in {key(g) for *g, _ in rows}}
    language = {k: brute_mcd(x) for k, x in group(lambda g: g[0]).items()}
    return {k: brute_mcd(x, language[k[0]]) for k, x in group(tuple).items()}


def test_estimates_match_brute_force(spark):
    rng = np.random.default_rng(9)
    mix = rng.normal(size=(P, P))
    x = np.rint(np.r_[rng.normal(size=(500, P)) @ mix * 300, rng.normal(size=(60, P)) * 50 + 9000]).astype(int)
    rows = [("en", "s", [int(v) for v in r]) for r in x] + [("en", None, [int(v) + 100 for v in r]) for r in x[:9]] + [(None, "s", [int(v) for v in r]) for r in x[20:50]] + [("de", "t", [1600, 0, 0, 0, -2000, -2500, -3000])]
    found = {r.key: r for r in q.fit(spark.createDataFrame(rows, "lang string, source string, x array<bigint>")).collect()}
    want = brute_fit(rows)
    named = {json.dumps({k: v for k, v in zip(("lang", "source"), g) if v is not None}, separators=(",", ":")): g for g in want}
    assert set(found) == set(named)
    for k, r in found.items():
        centre, scatter = want[named[k]]
        assert np.allclose(r.centre, centre)
        assert np.allclose(q._square(r.scatter), scatter, rtol=1e-6, atol=1e-6)
        assert np.allclose(q._square(r.inverse) * (np.eye(P) + 1) / 2, np.linalg.inv(scatter), rtol=1e-5, atol=1e-12)
    assert (np.abs(want["en", "s"][0]) < 500).all()  # the sixty far rows have no say
    det = lambda s: np.linalg.slogdet(s)[1]
    assert all(det(want["en", "s"][1]) <= det(brute_step(x.astype(float), *start, brute_mcd(np.array([r[2] for r in rows if r[0] == "en"], float)))[1]) + 1e-9 for start in brute_starts(x.astype(float)))


def test_verdicts_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.lang if r.doc_id % 7 else None, r.source, r.text) for r in docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    stats = {i: q.measure(t.encode()) for i, *_, t in rows}
    failed = {i: m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"] for i, m in stats.items()}
    estimates = brute_fit([(lang, source, stats[i]["x"]) for i, lang, source, _ in rows if not failed[i]])

    def far(i, lang, source):
        d = np.array(stats[i]["x"], float) - estimates[lang, source][0]
        return d @ np.linalg.inv(estimates[lang, source][1]) @ d > q._chi2(q.QUANTILE, P)

    want = {i: not failed[i] and not far(i, lang, source) for i, lang, source, _ in rows}
    got = {r.doc_id: r.kept for r in q.verdicts(docs).collect()}
    assert got == want and 0 < sum(want.values()) < sum(not f for f in failed.values())
    assert {r.doc_id for r in q.keep(docs).collect()} == {i for i, k in want.items() if k}


def test_many_groups_meet_their_rows_by_parts(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(map(tuple, q.verdicts(docs).collect()))
    monkeypatch.setattr(q, "BROADCAST_GROUPS", 3)
    assert sorted(map(tuple, q.verdicts(docs).collect())) == want


def test_labelled_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = q.verdicts(docs).collect()
    clean = [r for r in got if good.get(r.doc_id) == 1 and not r.base_failed]
    junk = [r for r in got if good.get(r.doc_id) == 0]
    assert sum(r.kept for r in clean) >= 0.98 * len(clean)
    assert sum(r.kept for r in junk) <= 0.05 * len(junk)
    again = q.verdicts(docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    kept = q.keep(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}


def test_odd_rows(spark):
    ok = " ".join(f"word{i} and" for i in range(40))
    rows = [(1, None, "en", "s"), (2, "", None, None), (3, ok, None, None), (3, ok, None, None), (None, ok + " x", "en", None), (4, "same " * 100, "en", "s"), (5, "z" * 100_000, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"m": F.lit(1), "quality": F.lit("x"), "kept": F.lit(None).cast("string"), "quality_text": F.lit(2)})
    got = sorted((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in q.verdicts(docs).collect())
    assert got == [(0, 81, False, True), (1, 0, True, False), (2, 0, True, False), (3, 80, False, True), (3, 80, False, True), (4, 100, True, False), (5, 1, True, False)]
    kept = q.keep(docs)
    assert kept.columns == docs.columns and kept.count() == 3
    assert q.verdicts(docs.where("false")).count() == 0 and q.keep(docs.where("false")).count() == 0
