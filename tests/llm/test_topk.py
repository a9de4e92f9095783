import math

import numpy as np

from stylomill.llm import topk as K

SCHEMA = "vec_id long, embedding array<float>, rank int, score long, label int"


def vectors():
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(330)]
    rows += [(400 + k, rows[200][1]) for k in range(15)]  # ties
    rows += [(500, [0.0] * 8), (501, None), (502, [float("nan")] * 8), (503, [None] * 8), (600, [float("inf")] * 8), (None, [1.0] * 8), (300, rows[7][1]), (600, [0.5] * 8), (601, [0.5] * 8), (601, [0.5] * 8)]
    return [(i, v, 1, 2, 3) for i, v in rows]


def expected(rows):
    ok = [(i, np.floor(1024 * np.array(np.float32(v), np.float64)).astype(np.int64)) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in ok if i % 100 == 0}:
        best = {}
        for i, v in ok:
            for j, w in ok:
                if i == q and j != q:
                    best[j] = max(best.get(j, -(10**18)), int(v @ w))
        out |= {(q, k + 1, j, s) for k, (j, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:10])}
    return out


def test_same_as_all_products(spark, monkeypatch):
    df = spark.createDataFrame(vectors(), SCHEMA).repartition(3)
    for block, seeds, size in ((4096, 8192, 1 << 24), (50, 60, 1 << 24), (50, 5, 100)):
        monkeypatch.setattr(K, "BLOCK", block)
        monkeypatch.setattr(K, "SEEDS", seeds)
        monkeypatch.setattr(K, "QUERY_BYTES", size)
        assert {tuple(r) for r in K.exact_top_k(df).collect()} == expected(vectors())


def test_few_and_none(spark):
    one = [(0, [1.0, 2.0], 1, 1, 1), (1, [0.5], 1, 1, 1)]
    assert [tuple(r) for r in K.exact_top_k(spark.createDataFrame(one, SCHEMA)).collect()] == [(0, 1, 1, 1024 * 512)]
    assert K.exact_top_k(spark.createDataFrame([], SCHEMA)).collect() == []


def test_walk_stops_early():
    rng = np.random.default_rng(1)
    v = rng.integers(-5, 5, (5000, 4)).astype(np.int64)
    v[:20] *= 100
    lists = K.Lists(np.arange(5000), v)
    q = np.array([3, -2, 1, 0])
    s, i = lists.top(q, -1, 5)
    full = sorted(zip((-(v @ q)).tolist(), range(5000), strict=True))[:5]
    assert [(-a, b) for a, b in full] == list(zip(s.tolist(), i.tolist(), strict=True))


def test_bounds_pass_from_block_to_block():
    """With the kth score known, blocks of other directions are not walked at all, and the result is that of all products."""
    rng = np.random.default_rng(8)
    ways = rng.normal(0, 1, (16, 12))
    v = np.concatenate([np.floor(400 * w + rng.normal(0, 25, (256, 12))) for w in ways]).astype(np.int64)
    blocks = [K.Lists(np.arange(a, a + 256), v[a : a + 256], np.float64) for a in range(0, len(v), 256)]
    queries = v[::64]
    alone = together = 0
    for j, q in enumerate(queries):
        own, best, least = 64 * j, None, None
        for b in blocks:
            b.walked = 0
            b.top(q, own, 10)
            alone += b.walked
        first = blocks[own // 256].top(q, own, 10)
        least = int(first[0][-1])
        for b in blocks:
            b.walked = 0
            if b.bounds(q[None])[0] >= (least if best is None or len(best[0]) < 10 else max(least, best[0][-1])):
                best = b.top(q, own, 10, best, least)
            together += b.walked
        want = sorted((-int(s), i) for i, s in enumerate(v @ q) if i != own)[:10]
        assert [(-s, i) for s, i in zip(*(x.tolist() for x in best), strict=True)] == want
    assert alone == len(queries) * len(blocks) and together < 0.35 * alone


def test_large_components_stay_exact(spark):
    big = [(100 * k, [float(2**30 + k), 1.0]) for k in range(30)]
    got = K.exact_top_k(spark.createDataFrame([(i, v, 1, 1, 1) for i, v in big], "vec_id long, embedding array<double>, rank int, score long, label int"), scale=1).collect()
    want = {}
    for i, v in big:
        scores = sorted(((-int(v[0]) * int(w[0]) - 1, j) for j, w in big if j != i))[:10]
        want |= {(i, r + 1): (j, -s) for r, (s, j) in enumerate(scores)}
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in got} == want


def test_ragged_lists():
    import pyarrow as pa

    assert K.matrix(pa.array([[1, 2, 3], [4], []]), 3).tolist() == [[1, 2, 3], [4, 0, 0], [0, 0, 0]]
