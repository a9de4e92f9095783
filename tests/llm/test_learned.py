import zlib
from collections import Counter

import numpy as np
import pytest
from llm_rows import SCHEMA, edge_texts, prose, rows_of

from stylomill.llm import langid, quality

STEMS = {"en": ("the", "ing", "and", "th", "er", "ion"), "de": ("sch", "ung", "der", "ein", "keit", "ü"), "fr": ("eau", "que", "é", "ou", "ment", "aux")}


def corpus():
    rows, lang = [], {}
    for k in range(240):
        name = list(STEMS)[k % 3]
        rows.append((1000 + k, prose(k, 60, STEMS[name])))
        lang[1000 + k] = name
    return rows, lang


@pytest.fixture(scope="module")
def spoken(spark):
    rows, lang = corpus()
    return spark.createDataFrame(rows_of(rows + edge_texts(), lang=lambda i: lang.get(i)), SCHEMA).repartition(3)


def held_out(i):
    return zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 0


def test_language(spoken):
    _, lang = corpus()
    rows = langid.identify(spoken).collect()
    assert len(rows) == len(lang) + len(edge_texts())
    known = [r for r in rows if r.doc_id in lang]
    assert all(r.held_out == held_out(r.doc_id) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in known if r.held_out) >= 0.98 * sum(r.held_out for r in known)
    assert all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (4, 5, 6, 19))


def test_language_without_labels(spark, no_docs):
    assert langid.identify(no_docs).collect() == []
    rows = langid.identify(spark.createDataFrame(rows_of([(1, "abc"), (2, None)], lang=lambda i: None), SCHEMA)).collect()
    assert [r.lang_pred for r in rows] == ["und", "und"]


def test_texts_without_a_letter_are_undetermined(spark, spoken):
    odd = [(1, "½ ² ¼"), (2, "①② Ⅷ"), (3, "٣ ४ 5"), (4, "\u0301 … 🙂"), (5, "½a"), (6, "ª")]
    taught = spoken.where("doc_id >= 1000").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(i, t, None) for i, t in odd], "doc_id long, text string, lang string")
    rows = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(taught.unionByName(more)).where("doc_id < 10").collect()}
    assert all(rows[i] == ("und", 0) for i in (1, 2, 3, 4)) and all(rows[i][0] in STEMS for i in (5, 6))
    assert langid.words("x½y ⅧZ ①") == ["x", "y", "z"]


def test_ties_go_to_the_language_that_sorts_first(spark):
    rows = [(k, "wort haus", "zz" if k % 2 else "aa") for k in range(40)]
    found = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in found} == {"aa"} and len(found) == 40


def plain_kneser_ney(counts, order=5):
    """The textbook recursion, on tuples: a function (letter, letters before) -> probability, for one language."""
    grams = [Counter() for _ in range(order + 1)]
    for word, n in counts.items():
        letters = ["<"] * (order - 1) + list(word) + [">"]
        for i in range(order - 1, len(letters)):
            grams[order][tuple(letters[i - order + 1 : i + 1])] += n
    for n in range(order - 1, 0, -1):
        for g in grams[n + 1]:
            grams[n][g[1:]] += 1
    return grams


def plain_score(grams, uniform, word, order=5):
    letters, total = ["<"] * (order - 1) + list(word) + [">"], 0.0

    def p(letter, before):
        n = len(before) + 1
        if n == 0 or not grams[n]:
            return uniform
        ones, twos = (sum(c == k for c in grams[n].values()) for k in (1, 2))
        d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.75
        below = p(letter, before[1:]) if n > 1 else uniform
        same = {g: c for g, c in grams[n].items() if g[:-1] == before}
        if not same:
            return below
        whole = sum(same.values())
        return max(same.get((*before, letter), 0) - d, 0) / whole + d * len(same) / whole * below

    for i in range(order - 1, len(letters)):
        total += np.log(p(letters[i], tuple(letters[i - order + 1 : i])))
    return total


def test_same_as_plain_kneser_ney():
    own = {"a": Counter(prose(1, 120).lower().replace(".", "").split()), "b": Counter(prose(2, 90, STEMS["de"]).lower().replace(".", "").split())}
    m = langid.Models(own)
    letters = {c for x in own.values() for w in x for c in w}
    asked = ["marlo", "schung", "q", "x" * 12, *list(own["a"])[:10], *list(own["b"])[:10]]
    got = m.score(asked)
    for k, lang in enumerate(sorted(own)):
        grams = plain_kneser_ney(own[lang])
        assert np.allclose(got[:, k], [plain_score(grams, 1 / (len(letters) + 2), w) for w in asked], atol=1e-3)


def test_sample_is_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 3000)
    rows, lang = corpus()
    docs = spark.createDataFrame(rows_of([*rows, (5000, "wort " * 2000)], lang=lambda i: lang.get(i, "de")), SCHEMA)
    m = langid.learn(docs.select("doc_id", "text", "lang"))
    assert m.languages == ["de", "en", "fr"] and all(np.isfinite(m.score(["wort"])).ravel())


def test_kneser_ney_sums_to_one():
    m = langid.Models({"a": {"abab": 3, "ba": 1, "c": 2}, "b": {"xyz": 4, "yx": 1}})
    letters = ["a", "b", "c", "x", "y", "z"]
    for prefix in ("", "a", "ab", "ba", "q"):
        # A letter after the prefix, the word's end after it, or a letter unknown to all.
        before = m.score([prefix])[0] if prefix else np.zeros(2)
        end = m.score([prefix])[0] - (m.score([prefix])[0] - before)
        total = np.zeros(2)
        for c in letters:
            with_c = _prefix(m, prefix + c) - _prefix(m, prefix)
            total += np.exp(with_c)
        total += np.exp(m.score([prefix])[0] - _prefix(m, prefix)) if prefix else np.exp(_end(m))
        assert np.allclose(total + m.uniform * _miss(m, prefix), 1, atol=1e-4), end


def _prefix(m, prefix):
    """Log probability of the letters alone, without the end."""
    if not prefix:
        return np.zeros(2)
    codes, lengths = langid.coded([prefix])
    out = np.zeros(2)
    for at in range(langid.ORDER, langid.ORDER + len(prefix)):
        out += _step(m, codes, at)
    return out


def _end(m):
    return _step(m, np.array([langid.START] * (langid.ORDER - 1) + [langid.END], np.uint64), langid.ORDER)


def _step(m, codes, at):
    out = np.zeros(2)
    for n in range(langid.ORDER, 0, -1):
        grams, logs, contexts, backs = m.tables[n - 1]
        h = langid.hashed(codes, np.array([at]), n)[0]
        i = np.searchsorted(grams, h)
        if i < len(grams) and grams[i] == h:
            return out + logs[i]
        h = langid.hashed(codes, np.array([at - 1]), n - 1)[0]
        i = np.searchsorted(contexts, h)
        if i < len(contexts) and contexts[i] == h:
            out = out + backs[i]
    return out + np.log(m.uniform)


def _miss(m, prefix):
    """The back-off mass of a letter unknown to all, in units of the uniform share."""
    codes = np.array([langid.START] * (langid.ORDER - 1) + [ord(c) for c in prefix] + [7], np.uint64)
    return np.exp(_step(m, codes, len(codes)) - np.log(m.uniform))


@pytest.fixture(scope="module")
def marked(spark):
    rows = [(k, prose(k, 150)) for k in range(300)]
    junk = [(k, " ".join(w.upper() + "!!" if k % 2 else w + "$$$" for w in t.split())) for k, t in [(400 + j, prose(400 + j, 100)) for j in range(150)]]
    labels = [(i, 1, 0, "x") for i, _ in rows] + [(i, 0, 0, "x") for i, _ in junk] + [(0, None, 0, "x"), (None, 1, 0, "x"), (9999, 1, 0, "x"), (1, 1, 1, "x")]
    return spark.createDataFrame(rows_of(rows + junk + [(2000 + k, t) for k, (_, t) in enumerate(edge_texts())]), SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_quality(marked):
    docs, labels = marked
    rows = {r.doc_id: r for r in quality.assess(docs, labels).collect()}
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    out = [r for r in rows.values() if r.held_out and (r.doc_id or 0) < 600]
    assert sum((r.predicted == 1) == (r.doc_id < 400) for r in out) >= 0.97 * len(out)
    good = quality.keep_good(docs, labels)
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    assert kept == {i for i, r in rows.items() if r.predicted == 1}


def test_quality_without_labels(marked, no_docs):
    docs, labels = marked
    assert {r.score for r in quality.assess(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.count()
    assert quality.assess(no_docs, labels).collect() == []
    only = labels.where("quality = 0").limit(6)
    assert len({r.score for r in quality.assess(docs, only).collect()}) == 1 and quality.keep_good(docs, only).count() == 0
    assert quality.keep_good(docs, labels.where("quality = 1")).count() == docs.count()


def shuffled_letters(text, rng):
    """The same bytes, words of the same lengths, letters of each word in another order."""
    return " ".join("".join(rng.permutation(list(w))) for w in text.split())


def test_quality_of_passages_that_byte_counts_cannot_tell_apart(spark):
    rng = np.random.default_rng(5)
    texts = {k: prose(k, 200) for k in range(700)}
    junk = {1000 + k: shuffled_letters(prose(1000 + k, 200), rng) for k in range(500)}
    mixed = {2000 + k: prose(2000 + k, 200) + " " + shuffled_letters(prose(3000 + k, 130), rng) for k in range(200)}  # good passages beside bad ones
    truth = dict.fromkeys(texts, 1) | dict.fromkeys(junk, 0) | dict.fromkeys(mixed, 0)
    noise = {i for i in truth if rng.random() < 0.08}  # labels that are wrong
    docs = spark.createDataFrame(rows_of((texts | junk | mixed).items()), SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, 1 - y if i in noise else y) for i, y in truth.items()], "doc_id long, quality int")
    rows = [r for r in quality.assess(docs, labels).collect() if r.held_out]
    right = {kind: np.mean([(r.predicted == 1) == (truth[r.doc_id] == 1) for r in rows if r.doc_id in kind]) for kind in map(frozenset, (texts, junk, mixed))}
    assert min(right.values()) >= 0.9, right.values()


def test_word_features():
    feature, n = quality.word_features([b"ab", b"x" * 300, b"ab", "é".encode()])
    assert n.tolist() == [3, 301, 3, 3] and len(feature) == n.sum() and feature[:3].tolist() == feature[304:307].tolist()
    assert 0 <= feature.min() and feature.max() < quality.BUCKETS and len(set(feature[:3].tolist())) == 3
    assert quality.word_features([])[0].tolist() == []


def test_scores_do_not_depend_on_what_is_remembered(monkeypatch):
    texts = [prose(k, 150).encode() for k in range(30)] + [b"", b"x" * 3000]
    net = quality.fit(texts, np.arange(len(texts)) % 2 * 1.0)
    whole = quality.Scorer(net).score(texts)
    monkeypatch.setattr(quality, "REMEMBERED", 10)
    one = quality.Scorer(net)
    assert np.allclose(whole, [one.score([t])[0] for t in texts], atol=1e-5)


def test_gradients():
    rng = np.random.default_rng(2)
    texts, y = [prose(k, 100 + 50 * k).encode() for k in range(4)] + [b""], np.array([1.0, 0, 1, 0, 1])
    net = quality.fit(texts, np.array([0.0, 1, 0, 1, 1]))
    known = quality.Numbered()
    b = quality.bags(texts, known)
    words = known.new
    feature, n = quality.word_features(words)

    def loss():
        p = net.forward(net.vectors(words), b)["y"]
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    net.p = {k: rng.normal(0, 0.3, v.shape) for k, v in net.p.items()}
    g = net.gradients(feature, n, b, y)
    for k, v in net.p.items():
        at = (feature[7], 3) if k == "W" else tuple(rng.integers(0, s) for s in v.shape)
        v[at] += 1e-5
        up = loss()
        v[at] -= 2e-5
        down = loss()
        v[at] += 1e-5
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-5
    assert g["W"][feature[7]].any() and g["f"].any()
