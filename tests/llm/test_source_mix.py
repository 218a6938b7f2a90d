import random

import duckdb
import pandas as pd
import pytest

from weftgraph.llm import source_mix as m


def rows():
    rng = random.Random(7)
    out = []
    for i in range(400):
        s = rng.choice(["a", "a", "a", "b", "c", "é", "Z", None, "tiny"] if i % 50 == 0 else ["a", "a", "a", "b", "c", "Z", None])
        out.append((i, " ".join("w" for _ in range(rng.choice([0, 1, 3, 40, 200]))), s))
    out += [(None, "x y z", "b"), (7, "x y", "b"), (7, "x y", "b"), (900, None, "a"), (901, "", "zero"), (902, "long " * 30000, "c")]
    return [(i, t, s, "key", 5) for i, t, s in out]


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, sum(sizes.values()), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= 3 * sizes[s]
            open_.remove(s)
    return target


def test_budgets_are_exact(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string, key string, taken int")
    got = m.mix(docs).collect()
    assert len(got) == len(rows())
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    assert taken == {s: int(t + 1e-9) for s, t in want.items()}
    assert sorted(m.mix(docs.repartition(7)).collect(), key=str) == sorted(got, key=str)
    # whole epochs: no document is taken twice more than another of its source
    for s in sizes:
        copies = [r.taken / r.size for r in got if r.source == s and r.size]
        assert not copies or max(copies) - min(copies) <= 1
    assert m.mix(docs.where("false")).count() == 0


def test_sql_agrees(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, key string, taken int")
    got = sorted((tuple(r) for r in m.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)
    con = duckdb.connect()
    con.register("raw", pd.DataFrame([(None if i is None else str(i), t, s) for i, t, s, *_ in data], columns=["doc_id", "text", "source"]))
    con.execute("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, source FROM raw")
    assert sorted(con.execute(m.SQL).fetchall(), key=str) == got


def test_rows_as_taken(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string, key string, taken int")
    out = m.mixed_rows(docs)
    assert out.columns == docs.columns
    by_id = {r.doc_id: r for r in m.mix(docs).where("doc_id < 400 and doc_id <> 7").collect()}
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert all(counts.get(i, 0) == (int(r.taken / r.size + 0.5) if r.size else 0) for i, r in by_id.items())
