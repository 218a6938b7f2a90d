import duckdb
import numpy as np
import pytest

from weftgraph.llm import bitsliced_topk as m

SCHEMA = "vec_id long, embedding array<float>, r int, block string"


def brute(rows, k, modulus):
    good = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for qi, q in good:
        if qi % modulus == 0:
            found = sorted((-int(q @ c), ci) for ci, c in good if ci != qi and len(c) == len(q))[:k]
            out += [(qi, n, ci, -s) for n, (s, ci) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "blocks", "queries"), [(16, 2, 4), (16, 100, 7), (100, 1, 1000)])
def test_matches_brute_force(spark, block, blocks, queries):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 7)).astype(np.float32)
    x[50:90] = x[50]  # ties
    x[100:110] = np.round(x[100:110])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5, [1.0] * 7), (10, [0.5] * 7), (10, [0.5] * 7), (-20, [-3.0] * 7), (400, None), (401, []), (402, [1.0, None]), (403, [float("nan")] * 7), (404, [float("inf")] + [0.0] * 6), (None, [1.0] * 7), (410, [1.0, 2.0]), (411, [3.0, 1.0]), (420, [0.0] * 7), (430, [1000.0] * 7)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    got = sorted(tuple(r) for r in m.top_k(df, k=5, query_modulus=10, block=block, cell_blocks=blocks, cell_queries=queries).collect())
    assert got == brute(rows, 5, 10)


def test_large_finite_values_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(60, 5)))]
    rows += [(100 + i, [float(v) for v in r * 1e7]) for i, r in enumerate(rng.normal(size=(30, 5)))]  # beyond 32 bits
    rows += [(200 + i, [float(v) for v in r * 1e30]) for i, r in enumerate(rng.normal(size=(30, 5)))]  # beyond 64
    rows += [(300, [1.7e308] * 5), (301, [-1.7e308] * 5), (310, [1e7] * 5), (311, [1e7] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    scaled = {i: [(n * 256) // d for n, d in (x.as_integer_ratio() for x in v)] for i, v in rows}
    want = []
    for i, q in scaled.items():
        if i % 10 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in scaled.items() if j != i)[:5]
            want += [(i, n, j, min(2**63 - 1, max(-(2**63), -s))) for n, (s, j) in enumerate(found, 1)]
    for block in (1000, 8):
        got = sorted(tuple(r) for r in m.top_k(df, k=5, query_modulus=10, block=block, cell_blocks=2, cell_queries=3).collect())
        assert got == sorted(want)
    scores = sorted(rng.integers(-(2**62), 2**62, 300).astype(object) * 2**40 // rng.integers(1, 2**30, 300).astype(object) ** 2)
    clipped = [(min(m.LARGEST, max(m.LEAST, s)), m._sortable(s) or b"") for s in scores]
    assert clipped == sorted(clipped)


def test_sums_beyond_64_bits_of_values_within_32(spark):
    rng = np.random.default_rng(6)
    rows = [(i, np.round(r * 2e6).tolist()) for i, r in enumerate(rng.normal(size=(120, 64)))] + [(200, [2e6] * 64), (201, [8e6] * 64), (202, [-8e6] * 64), (203, [7e6] * 64)]
    scaled = {i: [256 * int(x) for x in v] for i, v in rows}
    want = []
    for i, q in scaled.items():
        if i % 10 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in scaled.items() if j != i)[:5]
            want += [(i, n, j, min(m.LARGEST, max(m.LEAST, -s))) for n, (s, j) in enumerate(found, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (1000, 1):
        assert sorted(tuple(r) for r in m.top_k(df, k=5, query_modulus=10, block=block).collect()) == sorted(want)


def test_cells_meet_in_every_task(spark):
    """Blocks and queries of a cell reach the same task however many there are: small tables are read by one task, large ones are not."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(400, 6)))] + [(i, [1.0] * 6) for i in range(400, 440)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "23"}
    before = {name: spark.conf.get(name) for name in conf}
    try:
        for name, value in conf.items():
            spark.conf.set(name, value)
        for blocks, queries in ((1, 5), (2, 1000), (1000, 3)):
            got = m.top_k(df, k=5, query_modulus=10, block=16, cell_blocks=blocks, cell_queries=queries).collect()
            assert sorted(tuple(r) for r in got) == brute(rows, 5, 10)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_sql_agrees_on_the_table(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    got = sorted(tuple(r) for r in m.op1_bitsliced_topk(spark, "/root/testdata/sf0.01").collect())
    assert got == sorted(con.execute(m.SQL).fetchall()) and len(got) == 50


def test_adders():
    rng = np.random.default_rng(13)
    planes = {k: [rng.integers(0, 2**63, (2, 3), dtype=np.uint64) for _ in range(n)] for k, n in ((0, 5), (1, 1), (2, 4), (5, 2))}
    bits = lambda a: np.unpackbits(a.view(np.uint8), axis=1, bitorder="little").astype(int)
    want = sum(bits(p) << k for k, own in planes.items() for p in own)
    adder = m.Adder()
    for k, own in planes.items():
        for plane in own:
            adder.add(k, plane)
    sums = adder.sums()
    assert (sum(bits(p) << k for k, p in enumerate(sums) if p is not None) == want).all()
    everyone = np.full((2, 3), 2**64 - 1, np.uint64)
    for k in (1, 7, 192, 500):
        assert m.top_sums(sums, everyone, k).tolist() == [sorted(w)[-min(k, 192)] for w in want]
    for v in (-3, 0, 1, 17, 10**6):
        assert (bits(m.at_least(sums, everyone, np.array([v, 20]))) == (want >= np.array([[v], [20]]))).all()


def test_empty_table(spark):
    assert m.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
