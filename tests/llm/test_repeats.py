import hashlib
from collections import Counter

import numpy as np
import pytest

from stylomill.llm import repeats as R

from llm_rows import SCHEMA, prose, rows_of


def expected(texts, n):
    data = [(i, (t or "").encode()) for i, t in texts]
    seen = Counter(x[k : k + n] for _, x in data for k in range(len(x) - n + 1))
    out = []
    for i, x in data:
        mask = np.zeros(len(x) + 1, bool)
        for k in range(len(x) - n + 1):
            if seen[x[k : k + n]] > 1:
                mask[k : k + n] = True
        spans = int((mask[:-1] & ~np.r_[False, mask[:-2]]).sum()) if len(x) else 0
        out.append((i, len(x), int(mask.sum()), spans, hashlib.sha256(bytes(b for b, m in zip(x, mask, strict=False) if not m)).hexdigest()))
    return sorted(out, key=str)


def short(texts):
    return [(i, t) for i, t in texts if t is None or len(t) < 20_000]


def test_same_as_all_windows(spark, texts):
    docs = spark.createDataFrame(rows_of(short(texts)), SCHEMA).repartition(3)
    assert sorted((tuple(r) for r in R.repeat_digest(docs, 200).collect()), key=str) == expected(short(texts), 200)


def test_many_surroundings_of_one_passage(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_CONTEXTS", 3)
    monkeypatch.setattr(R, "BUCKET_CONTEXTS", 8)
    passage = prose(77, 45)
    texts = [(k, prose(200 + k, 12) + " " + passage[k % 5 :] + " " + prose(300 + k, 12)) for k in range(30)] + [(99, "ab" * 300), (98, "q" * 199), (97, "q" * 200)]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    assert sorted((tuple(r) for r in R.repeat_digest(docs, 200).collect()), key=str) == expected(texts, 200)


def test_pieces_of_a_long_text(monkeypatch):
    text = prose(8, 3000).encode()
    whole = [np.concatenate(x) for x in zip(*(tuple(f.values()) for f in R.anchors([text, b"x" * 500], 200)), strict=True)]
    monkeypatch.setattr(R, "PIECE", 700)
    cut = [np.concatenate(x) for x in zip(*(tuple(f.values()) for f in R.anchors([text, b"x" * 500], 200)), strict=True)]
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))


def test_empty(no_docs):
    assert R.repeat_digest(no_docs).collect() == []


def test_spans_and_kept(spark):
    p = prose(5, 80)
    rows = {r.doc_id: r for r in R.cut_repeats(spark.createDataFrame(rows_of([(1, "A " + p), (2, "B " + p), (3, None)]), SCHEMA), 200).collect()}
    assert bytes(rows[1].kept) == b"A" and [(s.start, s.end) for s in rows[1].spans] == [(1, 2 + len(p))]
    assert rows[3].n_bytes == 0 and rows[3].spans == []


@pytest.mark.parametrize("width", [1, 3, 7])
def test_least_of(width):
    v = np.random.default_rng(width).integers(0, 50, 40).astype(np.uint64)
    assert R.least_of(v, width).tolist() == [int(v[i : i + width].min()) for i in range(40 - width + 1)]


def repetitive(seed, n):
    """Strings that are made of few parts, with small edits."""
    rng = np.random.default_rng(seed)
    parts = [rng.integers(97, 100, 40).astype(np.uint8).tobytes() for _ in range(4)] + [b"a" * 50, b"ab" * 30, bytes(range(256))]
    out = []
    for _ in range(n):
        s = bytearray(b"".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(0, 7))))
        for _ in range(rng.integers(0, 3)):
            if s:
                s[rng.integers(0, len(s))] = rng.integers(0, 256)
        out.append(bytes(s))
    return out


@pytest.mark.parametrize(("seed", "mark", "spacing"), [(1, 8, 32), (2, 4, 8), (3, 2, 4), (4, 8, 10**9), (5, 8, 1)])
def test_order_is_that_of_a_plain_suffix_array(seed, mark, spacing):
    strings = repetitive(seed, 25)
    p = R.Parsed(strings, mark, spacing)
    suffix = {int(p.begin[k]) + i: x[i:] for k, x in enumerate(strings) for i in range(len(x))}
    want = sorted(suffix, key=lambda at: (suffix[at], at))
    assert p.order(np.arange(len(p.data))).tolist() == want
    # The dictionary holds every phrase once, and the parse gives the strings back.
    phrases = {}
    for k, (a, last) in enumerate(zip(p.start.tolist(), p.last.tolist(), strict=True)):
        b = min((int(e) for e in p.end if e > a), default=len(p.data)) if last else int(p.start[k + 1]) + mark
        assert phrases.setdefault(int(p.phrase[k]), p.data[a:b]) == p.data[a:b]
    if spacing == 32:
        assert len(phrases) < 0.7 * len(p.phrase)


def test_refined_ranks():
    rng = np.random.default_rng(9)
    for _ in range(20):
        sizes = rng.integers(1, 9, 6)
        symbols, end = rng.integers(0, 2, sizes.sum()), np.repeat(np.cumsum(sizes), sizes)
        suffixes = [symbols[i : end[i]].tolist() for i in range(len(symbols))]
        assert R.refined(R.ranked(symbols), end, 1).tolist() == [sum(x < y for x in suffixes) for y in suffixes]


def test_repeated_places_against_all_windows():
    strings = repetitive(7, 30) + [b"", b"xyz"]
    row, offset = (np.array(x) for x in zip(*((k, i) for k, x in enumerate(strings) for i in range(len(x) - 20 + 1)), strict=True))
    seen = Counter(strings[k][i : i + 20] for k, i in zip(row, offset, strict=True))
    assert R.repeated_places(strings, row, offset, 20).tolist() == [seen[strings[k][i : i + 20]] > 1 for k, i in zip(row, offset, strict=True)]


def test_rows_that_repeat_and_rows_without_an_id(spark):
    p = prose(41, 60)
    texts = [(None, p), (None, p), (0, p + " x"), (0, prose(42, 50)), (3, prose(43, 50)), (3, prose(43, 50))]
    assert sorted((tuple(r) for r in R.repeat_digest(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()), key=str) == expected(texts, 200)
