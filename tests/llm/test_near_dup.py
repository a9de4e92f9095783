from collections import defaultdict

import numpy as np
import pytest

from stylomill.llm import near_dup as N

from llm_rows import SCHEMA, prose, rows_of


def expected(texts, width, percent):
    """Components by comparing all sets; nodes are ids."""
    sets = []
    for i, t in texts:
        w = N.words((t or "").encode())
        k = min(width, len(w))
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()))
    root = {i: i for i, _ in sets if i is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if s and u and i is not None and j is not None and 100 * len(s & u) >= percent * len(s | u):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else top(i)) for i, s in sets), key=str)


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_same_as_all_pairs(docs, texts, width, percent):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicates(docs, width, percent).collect()), key=str)
    # A null id takes the class of its text only by name; it has no component.
    assert got == expected(texts, width, percent)


def test_kept_and_first(spark, docs):
    kept = {r.doc_id: r.kept for r in N.near_duplicates(docs, 3, 85).where("doc_id < 4").collect()}
    assert kept == {1: True, 2: False, 3: False}
    first = N.keep_first(docs, 3, 85)
    assert first.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in first.where("doc_id < 4 OR doc_id IS NULL").collect()), key=str) == [(1, prose(1, 120)), (None, None)]
    assert first.where("doc_id = 17").count() == 1  # a row that repeats


def test_empty(no_docs):
    assert N.near_duplicates(no_docs).collect() == []


@pytest.mark.parametrize(("members", "rows", "hubs"), [(4096, 7, 16), (9, 7, 3), (9, 1024, 0)])
def test_family_over_several_blocks(spark, monkeypatch, members, rows, hubs):
    monkeypatch.setattr(N, "BLOCK_ROWS", rows)
    monkeypatch.setattr(N, "BLOCK_MEMBERS", members)
    monkeypatch.setattr(N, "HUBS", hubs)
    base = prose(9, 150).split()
    texts = []
    for k in range(60):
        w = list(base)
        for j in range(k % 6):
            w[(17 * k + 31 * j) % len(w)] = f"edit{k}x{j}"
        texts.append((k, " ".join(w)))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicates(spark.createDataFrame(rows_of(texts), SCHEMA), 3, 85).collect()), key=str)
    assert got == expected(texts, 3, 85)


def test_pairs_around_the_threshold(spark, monkeypatch):
    """Many sets whose similarities lie on both sides of the threshold, so that estimates pass and checks fail."""
    import random

    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    r = random.Random(4)
    base = [f"w{k}" for k in range(90)]
    texts = []
    for k in range(70):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = f"x{r.randrange(40)}"
        texts.append((r.randrange(10**6), " ".join(w)))
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in N.near_duplicates(spark.createDataFrame(rows_of(texts), SCHEMA), 3, 85).collect()), key=str)
    assert got == expected(texts, 3, 85) and 1 < len({x[2] for x in got}) < 70


def test_an_id_joins_its_texts(spark):
    a, b, c = prose(21, 60), prose(22, 60), prose(23, 60)
    texts = [(5, a), (5, b), (2, a), (9, b + " more"), (3, b), (7, c), (7, a), (8, c)]
    rows = N.near_duplicates(spark.createDataFrame(rows_of(texts), SCHEMA), 3, 85).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == {(i, 2) for i in (2, 3, 5, 7, 8, 9)} and len(rows) == len(texts)
    first = N.keep_first(spark.createDataFrame(rows_of(texts), SCHEMA), 3, 85).collect()
    assert [(r.doc_id, r.text) for r in first] == [(2, a)]


def test_first_of_rows_without_an_id(spark):
    a, b = prose(31, 60), prose(32, 60)
    texts = [(None, a), (4, a), (None, b), (None, b), (None, ""), (None, ""), (6, None), (6, None)]
    first = N.keep_first(spark.createDataFrame(rows_of(texts), SCHEMA), 3, 85).collect()
    assert sorted(((r.doc_id, r.text) for r in first), key=str) == sorted([(4, a), (None, b), (None, ""), (None, ""), (6, None), (6, None)], key=str)


def test_texts_shipped_grow_with_the_documents(spark, monkeypatch):
    """A family of near copies: checked pairs are as many as documents, however many pairs it has."""
    sizes = []
    own = N.saved
    monkeypatch.setattr(N, "saved", lambda df, name: sizes.append((name, (t := own(df, name)).count())) or t)
    base = prose(9, 150).split()
    texts = [(k, " ".join([*base[:40], f"edit{k}", *base[41:]])) for k in range(300)]
    rows = N.near_duplicates(spark.createDataFrame(rows_of(texts), SCHEMA), 3, 85).collect()
    assert {r.component_id for r in rows} == {0}
    said = dict(sizes)
    assert said["texts"] <= 300 and said["first"] <= 300 and said.get("second", 0) <= 30 and "settled" not in said


def test_forest_spans_what_passes():
    rng = np.random.default_rng(3)
    pool = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    sets = []
    for k in range(60):
        own = pool[(k % 6) * 500 : (k % 6) * 500 + 300].copy()
        own[rng.choice(300, rng.integers(0, 25), replace=False)] = pool[3000 + rng.integers(0, 900)]
        sets.append(np.unique(own))
    sketches = N.Sketches([N.registers_small(h).astype("<u2").tobytes() for h in sets], np.array([len(h) for h in sets]), 85)
    everything = sketches.forest(np.zeros(60, bool), np.zeros(60, int), 0.85)
    parts = []
    for low in range(3):
        for high in range(low, 3):
            rows = np.array([k for k in range(60) if k < 4 or k % 3 in (low, high)])
            some = N.Sketches([sketches.regs[k].tobytes() for k in rows], sketches.sizes[rows], 85)
            parts += [(rows[i], rows[j]) for i, j, _ in some.forest(rows < 4, np.where(rows < 4, -1, rows % 3), 0.85)]

    def trees(edges):
        root = list(range(60))
        for _ in range(60):
            for i, j in edges:
                root[i] = root[j] = min(root[i], root[j])
        return root

    assert len(everything) < 60 and trees([e[:2] for e in everything]) == trees(parts) and 6 <= len(set(trees(parts))) < 20


def test_segments_cross_batches():
    import pyarrow as pa

    key = np.repeat([3, 3, 5, 7, 9], [2, 1, 4, 1, 3])
    batches = [pa.RecordBatch.from_arrays([pa.array(key[a:b]), pa.array(np.arange(a, b))], names=["k", "v"]) for a, b in ((0, 1), (1, 1), (1, 6), (6, 11))]
    assert [t.column("v").to_pylist() for t in N.segments(iter(batches), ["k"])] == [[0, 1, 2], [3, 4, 5, 6], [7], [8, 9, 10]]
    assert list(N.segments(iter([]), ["k"])) == []


def test_registers_estimate_and_band():
    rng = np.random.default_rng(1)
    for n in (300, 3000):
        pool = np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2))
        a, b = pool[: n], np.sort(np.concatenate([pool[n // 10 : n], pool[n : n + n // 10]]))
        truth = 0.9 / 1.1
        for make in ([N.registers_small] if n < 1024 else [N.registers_large]):
            assert abs(N.estimated(make(a), make(b)[None], len(a), np.array([len(b)]))[0] - truth) < 0.12
    r, bands = N.banding(0.85)
    assert r * bands <= N.REGISTERS and (1 - 0.85**r) ** bands <= N.MISS
    assert N.least_estimate(0.85) < 0.85
    assert N.schemes(0, 0.85) == [] and N.schemes(1000, 0.85) == ["small", "large"]


@pytest.mark.parametrize("at_once", [1 << 18, 2])
def test_components(spark, monkeypatch, at_once):
    from stylomill.llm import common

    monkeypatch.setattr(common, "CONTRACTED", at_once)
    edges = [(1, 2), (2, 3), (3, 4), (10, 9), (9, 8), (8, 7), (7, 20), (5, 5), (4, 1), (1, 2), (None, 1)] + [(100 + k, 101 + k) for k in range(40)]
    got = defaultdict(set)
    for r in common.components(spark.createDataFrame(edges, "a long, b long").repartition(5), "t").collect():
        got[r.component].add(r.node)
    assert dict(got) == {1: {1, 2, 3, 4}, 7: {7, 8, 9, 10, 20}, 100: set(range(100, 141))}
    assert common.components(spark.createDataFrame([], "a long, b long"), "t").collect() == []


def test_parted(spark):
    from stylomill.llm.common import parted

    rows = spark.createDataFrame([(k if k % 7 else None, f"t{k}") for k in range(500)], "id long, text string")
    keys = spark.createDataFrame([(k,) for k in range(0, 500, 9)], "other long")
    some, none = parted(rows, ["id"], keys, ["other"])
    got, rest = ({r.text for r in x.collect()} for x in (some, none))
    assert {f"t{k}" for k in range(0, 500, 9) if k % 7} <= got and len(got) < 120 and not got & rest and len(got | rest) == 500
    assert some.columns == rows.columns and parted(rows, ["id"], keys.limit(0), ["other"])[0].count() == 0
