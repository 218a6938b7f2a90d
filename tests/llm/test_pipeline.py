"""The pipeline against brute force, stage by stage, on the smallest tables."""

import hashlib

import corpus_pipeline
import pytest
import numpy as np
from pyspark.sql import functions as F

from .test_quality_rules import brute_fit
from .test_secret_scan import brute_base
from .test_simhash import brute_components, brute_fingerprint
from .test_source_mix import brute_targets

from weftgraph.llm import quality_rules, secret_scan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("pipeline")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append((name, before, docs))
    return {name: (before, after) for name, before, after in out}


def test_columns_and_order(stages):
    assert list(stages) == ["quality", "near_dedup", "secrets", "mix", "tokens"]
    for name, (before, after) in stages.items():
        assert name == "tokens" or after.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality(spark, stages):
    before, after = stages["quality"]
    rows = before.collect()
    stats = {r.doc_id: quality_rules.measure(r.text.encode()) for r in rows}
    passing = [r for r in rows if stats[r.doc_id]["n_words"] >= 50 and 100 * stats[r.doc_id]["n_repeat_words"] <= 50 * stats[r.doc_id]["n_words"]]
    estimates = brute_fit([(r.lang, r.source, stats[r.doc_id]["x"]) for r in passing])

    def distance(r):
        centre, scatter = estimates[r.lang, r.source]
        d = np.array(stats[r.doc_id]["x"], float) - centre
        return d @ np.linalg.inv(scatter) @ d

    kept = {r.doc_id for r in passing if distance(r) <= quality_rules._chi2(quality_rules.QUANTILE, len(quality_rules.FLOORS))}
    assert {r.doc_id for r in after.collect()} == kept and 0 < len(kept) < len(passing)


def test_near_dedup(stages):
    before, after = (df.collect() for df in stages["near_dedup"])
    top = brute_components([brute_fingerprint(r.text) for r in before])
    least = {}
    for r, t in zip(before, top):
        least[t] = min(r.doc_id, least.get(t, r.doc_id))
    assert sorted(r.doc_id for r in after) == sorted(least.values())


def test_secrets(spark, stages):
    before, after = stages["secrets"]
    text = {r.doc_id: r.text for r in after.collect()}
    spans = {r.doc_id: r.spans for r in secret_scan.scan(before).collect()}
    for r in before.collect():
        want, at = "", 0
        for s in filter(None, spans[r.doc_id].split(",")):
            a, b = map(int, s.split(":")[1:])
            if a >= at:
                want += r.text[at:a] + "[SECRET]"
            at = max(at, b)
        assert text[r.doc_id] == want + r.text[at:]
        # whatever the models add, no base span of the brute force is left
        for s in filter(None, brute_base(r.text).split(",")):
            a, b = map(int, s.split(":")[1:])
            assert any(x <= a and b <= y for x, y in (map(int, z.split(":")[1:]) for z in spans[r.doc_id].split(",")))
    assert {r.doc_id: r.n_chars for r in after.collect()} == {i: len(t) for i, t in text.items()}


def test_mix_and_tokens(stages):
    before, after = stages["mix"]
    docs = [(r.source, int(hashlib.md5(f"mix-1:{r.doc_id}".encode()).hexdigest()[:15], 16), r.doc_id, len(r.text.split())) for r in before.collect()]
    total = {s: sum(d[3] for d in docs if d[0] == s) for s in {d[0] for d in docs}}
    target, at, want = brute_targets(total), dict.fromkeys(total, 0), []
    for source, _, i, size in sorted(docs, key=lambda d: (d[0] is None, d[0] or "", *d[1:])):
        whole = int(target[source] // total[source])
        taken = whole * size + min(max(int(target[source]) - whole * total[source] - at[source], 0), size)
        at[source] += size
        want += [i] * (int(taken / size + 0.5) if size else 0)
    want.sort()
    assert sorted(r.doc_id for r in after.collect()) == want
    before, after = (df.collect() for df in stages["tokens"])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((r.doc_id, r.decoded_sha256) for r in after) == sorted((r.doc_id, sha(r.text)) for r in before)


def test_odd_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, clashing names, an empty table: each stage has a result."""
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    words = lambda a, n: " ".join(f"{word(i * 7919)}{'.' if i % 9 == 0 else ''}" for i in range(a, a + n))
    text = words(0, 120)
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, words(500, 120) + " token = 'abcdefgh12'", "en", "s", 5), (3, None, None, None, None), (None, words(900, 90), None, None, None), (4, "", "en", "s", 0), (5, words(2000, 40_000), "de", "t", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"kept": F.lit("x"), "spans": F.lit(1), "quality": F.lit(None).cast("string"), "taken": F.lit(2.0), "fp": F.lit(b"z")})
    for start in (docs, docs.where("false")):
        empty = start is not docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, start, SF)
            assert (out.count() == 0) == empty, name
            assert name == "tokens" or out.columns == docs.columns
    secrets = corpus_pipeline.secrets(spark, docs, SF)
    assert secrets.count() == len(rows) and {r.text is None for r in secrets.where("doc_id = 3").collect()} == {True}
    assert "abcdefgh12" not in secrets.where("doc_id = 2").first().text
    assert corpus_pipeline.near_dedup(spark, docs, SF).where("doc_id = 1").count() == 1


def test_run(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages["tokens"][1].collect()))
