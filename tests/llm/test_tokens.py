import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from stylomill.llm import packing, token_file
from stylomill.llm.tokens import Encoder, default_path


@pytest.fixture(scope="module")
def ids_of():
    t = Tokenizer.from_file(default_path())
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_encoder_is_the_tokenizer(texts):
    e = Encoder(default_path())
    some = [t or "" for _, t in texts] + ["'s 'S it's x's' ''", "a b c", "½²³ ª", "İI", "Å ﬁ", "</w>x</w>"]
    assert e.encode(some) == e.whole(some)
    assert e.encode(some) == e.whole(some)
    assert e.encode([]) == []


def test_encoder_forgets_without_a_trace(texts):
    e = Encoder(default_path())
    e.remembered = 300
    some = [t or "" for _, t in texts]
    for _ in range(2):
        for k in range(0, len(some), 3):
            assert e.encode(some[k : k + 3]) == e.whole(some[k : k + 3])


def test_file_round_trip(docs, texts, ids_of):
    rows = token_file.token_digest(docs).collect()
    got = sorted((r.start, r.n_tokens, r.ids_crc32) for r in rows)
    order = sorted(((i is not None, i or 0, ids_of(t).astype("<u2").tobytes(), t) for i, t in texts), key=lambda x: x[:3])
    at, want = 0, []
    for *_, t in order:
        x = ids_of(t)
        want.append((at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert got == want
    assert sorted(r.doc_id for r in rows if r.doc_id) == sorted(i for i, _ in texts if i)


def test_ids_come_back(spark, docs, texts, ids_of):
    from stylomill.llm.common import scratch

    path = scratch(spark, "tokens-test")
    token_file.write_tokens(docs, path)
    by = {r.doc_id: bytes(r.ids) for r in token_file.read_tokens(spark, path).collect()}
    assert all(by[i] == ids_of(t).tobytes() for i, t in texts if i not in (None, 18))


def test_file_of_nothing(no_docs):
    assert token_file.token_digest(no_docs).collect() == []


@pytest.mark.parametrize("n", [0, 1, 5, 2048, 2049, 700_000])
def test_block(n):
    rng = np.random.default_rng(n)
    ids = rng.geometric(0.01, n).astype(np.uint32) % 4000
    t = token_file.Table(np.bincount(ids, minlength=4000))
    data = token_file.encode_block(ids, np.array([(7, 0, n)], token_file.DOC), t)
    b = token_file.Block(data)
    assert (b.decode(t) == ids).all() and b.docs["id"][0] == 7
    assert len(b.marks) == (2 if n > token_file.LANES * token_file.CHECKPOINT_STEPS else 1)
    if len(b.marks) > 1:  # a later part alone
        assert (b.part(1, t) == ids[b.marks[1][0] * token_file.LANES :]).all()
    with pytest.raises(ValueError):
        token_file.Block(data[:60] + bytes([data[60] ^ 1]) + data[61:])


def test_table_of_extremes():
    t = token_file.Table(np.array([10**12, 1, 0, 1] + [1] * 60_000))
    assert int(t.freq.sum()) == 1 << token_file.SCALE_BITS and t.freq[2] == 0 and t.freq[[0, 1, 3]].min() >= 1


def test_pack(docs, texts, ids_of):
    rows = packing.pack(docs, lot_ids=5000, with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and 4 * r.length == len(r.ids)
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= packing.SLACK * len(by_seq)
    once = [i for i, _ in texts if i is not None and sum(j == i for j, _ in texts) == 1]
    whole = dict(texts)
    for i in once:
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in pieces) == ids_of(whole[i]).tobytes()
        assert {r.doc_tokens for r in pieces} == {len(ids_of(whole[i]))}
    assert sum(r.length for r in rows) == sum(len(ids_of(t)) for _, t in texts)


def test_pack_nothing(no_docs):
    assert packing.pack(no_docs).collect() == []


def costs_of(pieces):
    fill, spent = {}, {}
    for _, _, n, s, offset in pieces:
        assert fill.get(s, 0) == offset
        fill[s] = offset + n
        spent[s] = spent.get(s, 0) + packing.cost(n)
    return fill, spent


def test_assign_takes_all_and_nothing_twice():
    lengths = [900, 800, 700, 600, 500, 400, 300, 200, 3000]
    pieces, rest = packing.assign(lengths, 2048)
    fill, _ = costs_of(pieces)
    assert rest == [] and sum(fill.values()) == 7400 and all(v <= 2048 for v in fill.values())
    for k, n in enumerate(lengths):
        assert sorted(x for d, at, m, *_ in pieces if d == k for x in range(at, at + m)) == list(range(n))


def test_no_document_is_cut_that_finds_room_whole():
    rng = np.random.default_rng(4)
    lengths = np.minimum(1 + rng.lognormal(5.5, 1.1, 4000).astype(int), 2047).tolist()
    pieces, rest = packing.assign(lengths, 2048, last=False)
    assert sum(n for n, *_ in rest) < 2048
    fill, spent = costs_of(pieces)
    left = {k for _, k, _ in rest}
    cut = {k for k in range(len(lengths)) if sum(p[0] == k for p in pieces) > 1}
    # By length, a greedy pass of its own: what it places whole must be whole here too.
    room, own, whole = np.full(sum(lengths) // 2048, 2048), np.zeros(sum(lengths) // 2048), set()
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        able = [s for s in range(len(room)) if room[s] >= lengths[k]]
        if able:
            s = min(able, key=lambda s: (own[s], s))
            room[s] -= lengths[k]
            own[s] += packing.cost(lengths[k])
            whole.add(k)
    assert not cut & whole and not left & whole and len(whole) > 0.9 * len(lengths)
    full = [s for s, n in fill.items() if n >= 2048 - packing.SLACK]
    assert len(full) >= len(fill) - 1 and sum(2048 - fill[s] for s in full) <= 0.005 * sum(lengths)
    # Costs are balanced: placing each document where it fits best spreads them further.
    room, own = np.full(len(fill) + 100, 2048), np.zeros(len(fill) + 100)
    for n in sorted(lengths, reverse=True):
        able = np.flatnonzero(room >= n)
        s = able[room[able].argmin()]
        room[s] -= n
        own[s] += packing.cost(n)
    ours, theirs = np.array([spent[s] for s in full]), own[room <= packing.SLACK]
    assert ours.std() < 0.9 * theirs.std() and ours.min() > 1.2 * theirs.min()


def test_many_tiny_documents():
    pieces, rest = packing.assign([1] * 5000, 2048)
    assert rest == [] and sorted(costs_of(pieces)[0].values()) == [8, 128, 256, 512, 2048, 2048]
