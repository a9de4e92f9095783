import pytest

from stylomill.operators import keys, ngrams
from stylomill.plans import catalogue
from stylomill.plans.inline import rows

TEXTS = [("a", ["x", "y", "z", "x", "y"]), ("b", ["x", "y"]), ("b", ["z"]), (None, ["x", "y", "z"]), ("a", []), ("c", None), ("a", ["y", "x", "y", "z", "w"]), ("d", ["x", None, "y", "z"])]


def grams():
    for subject, tokens in TEXTS:
        for n in (2, 3):
            for i in range(len(tokens or []) - n + 1):
                if None not in tokens[i : i + n]:
                    yield subject, n, " ".join(tokens[i : i + n])


@pytest.fixture
def texts(spark):
    return rows(spark, "subject string, tokens array<string>", TEXTS)


def test_unique(texts, monkeypatch):
    monkeypatch.setattr(keys, "HELD", 3)
    want = sorted((n, len({g for _, m, g in grams() if m == n}), sum(m == n for _, m, _ in grams())) for n in (2, 3))
    assert sorted(map(tuple, keys.unique(texts).collect())) == want


def test_unique_exchanges_no_strings(spark):
    """The exchange of all n-grams as strings took most of the time and of the disk."""
    plan = catalogue.QUERIES["unique_ngrams"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan


@pytest.mark.parametrize("bits", [1 << 13, 1 << 29])
def test_spread(texts, monkeypatch, bits):
    """Whatever a crowded map lets through by chance, counts are of strings."""
    monkeypatch.setattr(keys, "MAP_BITS", bits)
    want = []
    for n, g in {(n, g) for _, n, g in grams()}:
        subjects = [s for s, m, x in grams() if (m, x) == (n, g)]
        if len(subjects) >= 2 and "z" not in g.split():
            want.append((n, g, len(subjects), len({s for s in subjects if s is not None})))
    assert sorted(map(tuple, ngrams.spread(texts, "subject", ["z"], 2).collect())) == sorted(want)


def test_spread_makes_strings_of_frequent_ngrams_only(texts):
    plan = ngrams.spread(texts, "subject", [], 2)._jdf.queryExecution()
    assert "Generate explode" not in plan.optimizedPlan().toString()
    assert plan.executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_likely_top_holds_the_top(spark, monkeypatch):
    monkeypatch.setattr(keys, "SPARE", 1)
    monkeypatch.setattr(keys, "HELD", 50)
    own = rows(spark, "grp string, weight long, tokens array<string>", [(g, w, [f"t{(i * j) % 7}" for j in range(i % 9)]) for i in range(60) for g, w in (("p", i % 4), (None, 2))])
    for by, weight in ((None, None), ("grp", None), (None, "weight"), ("grp", "weight")):
        group = [by] if by else []
        want = ngrams.counted(ngrams.exploded(own, [*group, *([weight] if weight else [])]), group, weight)
        got = ngrams.likely_top(own, 3, by, weight=weight)
        found, some = (sorted(map(str, ngrams.top(x, 3, [*group, "n"]).select(*group, "n", "ngram", "frequency", "rank").collect())) for x in (want, got))
        assert found == some
        assert got.count() <= want.count()
