import pytest
from pyspark.sql import functions as F

from stylomill.functions import constants as C
from stylomill.operators import corpus, discriminate, evaluate, judge, ngrams, phrases, prompts, structure
from stylomill.plans.inline import rows


def test_band(spark):
    df = rows(spark, "register string, perplexity double", [("web", p) for p in (None, 49.9, 50.0, 1500.0, 1500.1)] + [("cultural", 1.0)])
    assert [r.ok for r in df.select(corpus.in_band().alias("ok")).collect()] == [True, False, True, True, False, True]


@pytest.mark.parametrize(("n", "most", "want"), [(99, 50, False), (100, 8, False), (100, 9, True), (200, 16, False), (200, 17, True)])
def test_degenerate_guard(spark, n, most, want):
    ts = ["x"] * most + [f"w{i}" for i in range(n - most)]
    assert rows(spark, "t array<string>", [(ts,)]).select(corpus.degenerate(F.col("t")).alias("d")).first().d is want


def test_budget_crosses_stretches(spark, monkeypatch):
    monkeypatch.setattr(corpus, "STRETCH", 3)
    df = rows(spark, "doc_id long, source string, n_tokens long", [(i, "a", 4) for i in range(10)] + [(i, "b", 100) for i in range(3)] + [(i, None, 1) for i in range(2)])
    kept = corpus.within_budget(df, 10).collect()
    assert sorted((r.source or "", r.doc_id, r.before) for r in kept) == [("", 0, 0), ("", 1, 1), ("a", 0, 0), ("a", 1, 4), ("a", 2, 8), ("b", 0, 0)]


def test_budgets():
    own = corpus.budgets({"cultural": ["x", "y"], "web": ["z"]}, C.REGISTER_WEIGHTS, 8900)
    assert own == {"x": 1600, "y": 1600, "z": 2300}
    assert corpus.budgets({"web": ["z"]}, C.REGISTER_WEIGHTS, 0) == {"z": 1}


def test_subtitle_scale(spark):
    sentences = rows(spark, "sentence string, count long", [("große freude heute", 3), ("netflix zeigt", 9), ("gute", 5), ("guter morgen", 5000)])
    for chars, scale in ((10**9, 4.0), (0, 0.0)):
        got = {r.sentence: r.weight for r in corpus.scaled_sentences(sentences, rows(spark, "total_chars long", [(chars,)])).collect()}
        assert got == {"große freude heute": max(1, round(3 * scale)), "guter morgen": max(1, round(1000 * scale))}


def test_profile_and_export(spark):
    docs = rows(spark, "doc_id long, register string, source string, text string, perplexity double", [(1, "web", "a", "haus baum haus baum", None), (2, "web", "a", "haus baum see", 9999.0), (3, "x", "b", None, None), (4, "x", "b", "wald see", None)])
    ranked = corpus.profile(docs, 100, rows(spark, "sentence string, count long", [("haus baum", 2)]), k=2)
    got = {(r.n, r.rank): (r.ngram, r.frequency) for r in ranked.collect()}
    assert got[2, 1][0] == "haus baum" and got[2, 2] == ("baum haus", 1) and (2, 3) not in got
    out = corpus.nested_profile(ranked, "m", 7).first()
    assert out.top_bigrams[0].ngram == "haus baum" and len(out.top_trigrams) == 2 and out.total_chars == 7


def test_candidates_bounds(spark):
    samples, profile = [], []
    for spread in (2, 3, 4, 5):
        for k in range(20):
            samples.append((f"s{k % spread}", [f"gram{spread}", "tail"]))
    samples += [("s1", ["nineteen", "tail"])] * 19 + [("s1", ["common", "tail"])] * 20 + [("s2", ["known", "tail"])] * 20 + [("s1", ["faq", "tail", "after"])] * 20
    profile = [(2, "common tail", 300), (2, "known tail", 299)]
    got = {r.ngram: (r.keep, r["count"], r.spread, r.baseline) for r in discriminate.candidates(rows(spark, "subject_id string, tokens array<string>", samples), rows(spark, "n int, ngram string, frequency long", profile), list(C.ECHO_WORDS)).collect()}
    assert got == {
        "gram2 tail": ("strike", 20, 2, 0), "gram3 tail": ("review", 20, 3, 0), "gram4 tail": ("review", 20, 4, 0), "gram5 tail": ("slop?", 20, 5, 0), "known tail": ("strike", 20, 1, 299), "tail after": ("strike", 20, 1, 0),
    }


def test_lookup(spark):
    profile = rows(spark, "n int, ngram string, frequency long", [(2, "gute idee", 5000), (2, "idee heute", 99), (3, "gute idee heute", 99), (2, "guten tag", 100)])
    asked = rows(spark, "phrase string", [("gute idee heute",), ("guten tag",), ("insbesondere bei",), ("in der",), ("ganzheitlicher ansatz",), ("guten tag",)])
    got = {r.phrase: (r.ngram, r.frequency, r.verdict) for r in discriminate.lookup(asked, profile).collect()}
    assert got == {
        "gute idee heute": ("idee heute", 99, "very rare"), "guten tag": ("guten tag", 100, "borderline"), "insbesondere bei": ("insbesondere", -1, "unigram"), "in der": ("", -1, "n/a"),
        "ganzheitlicher ansatz": ("ganzheitlicher ansatz", 0, "absent"),
    }


def test_word_hints(spark):
    got = discriminate.word_hints(rows(spark, "word string", [("Zudem",), ("x",)]), rows(spark, "word string, count long", [("zudem", 500)]), rows(spark, "word string, zipf double", [("x", 3.5)])).collect()
    assert sorted((r.word, r["count"], r.zipf, r.hint) for r in got) == [("Zudem", 500, 0.0, "common in dialogue"), ("x", 0, 3.5, "rarely spoken")]


def test_phrases(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_PHRASES", 1)
    texts = rows(spark, "id int, text string", [(1, "AAAA Basta"), (2, None), (3, "")])
    listed = rows(spark, "phrase string", [("aa",), ("Basta",), ("",), (None,), ("aa",)])
    assert sorted((r.id, r.phrase, r.hits) for r in phrases.phrase_hits(texts, listed).collect()) == [(1, "Basta", 1), (1, "aa", 2), (1, "aa", 2)]
    assert {r.id: r.hits for r in phrases.highlight_hits(texts, ["basta", "aaaa", "aa", "bast"]).collect()} == {1: 2, 2: 0, 3: 0}
    assert phrases.alternation(["abcd", "abcde", "abc", "a.cd"]) == r"abcde|a\.cd|abcd"
    tics = {r.tic: r.hits for r in phrases.tic_counts(texts.withColumn("arm", F.lit("a"))).collect()}
    assert tics["basta"] == 1 and len(tics) == len(C.TICS)


def tok(text, pos, form=None, depth=1, space=False, punct=False):
    return (text, pos, form, depth, space, punct)


def test_structure_of_annotated_rows(spark):
    sents = [
        (0, [tok("Die", "DET"), tok("Leistung", "NOUN"), tok("wird", "AUX", "Fin"), tok("geprüft", "VERB", "Part", 150), tok(".", "PUNCT", punct=True)]),
        (1, [tok("Ja", "X"), tok("!", "PUNCT", punct=True), tok(" ", "SPACE", space=True), tok("so", "X")]),
        (2, [tok("Anna", "PROPN"), tok("wird", "AUX", "Fin"), tok("gehen", "VERB", "Inf")]),
    ]
    df = rows(spark, f"id int, sents {structure.SENTENCES}", [(1, sents), (2, [])]).select("id", structure.counters(F.col("sents")).alias("m")).select("id", "m.*")
    got = {r.id: r for r in structure.ratios(df).collect()}
    assert [got[1][c] for c in structure.COUNTERS] == [2, 7, 2, 4, 1, 2, 107, 7, 1]
    assert got[1].passive_ratio == 0.5 and got[1].noun_verb_ratio == 0.5 and got[2].mean_sentence_len is None


def test_scores_of_the_reference(spark):
    ref = structure.reference(spark)
    got = {r.register: round(r.slop_score, 1) for r in structure.scored(ref, ref).collect()}
    assert {k.split(" (")[0]: v for k, v in got.items()} == {"dialog/literary": 0.0, "forum": 67.8, "forum-AT": 105.4, "encyclopedic": 173.7, "academic": 144.2, "speech": 89.6}


def test_tagger_slot(spark):
    df = structure.annotated(rows(spark, "id int, text string", [(1, "a b"), (2, None)]), lambda texts: [[{"sent_id": 0, "tokens": [{"text": w, "pos": "X", "verbform": None, "depth": 0, "is_space": False, "is_punct": False} for w in t.split()]}] for t in texts])
    assert {r.id: len(r.sents[0].tokens) for r in df.collect()} == {1: 2, 2: 0}


def test_report(spark):
    texts = rows(spark, "id string, arm string, text string", [("1", "a", "Das Haus wird gebaut heute. gilt gilt gilt gilt gilt"), ("2", "a", "Wir gehen in den Wald heute."), ("3", "a", ""), ("1", "b", "basta basta")])
    got = {r.arm: r for r in evaluate.report(texts, rows(spark, "phrase string", [("wald",)]), structure.reference(spark)).collect()}
    assert (got["a"].n_texts, got["a"].n_degenerate, got["a"].ban_hits) == (2, 1, 1) and got["b"].tic_hits == 2 and got["b"].ban_per_1k is None
    assert [r.x for r in rows(spark, "b double, o double", [(1.0, 0.5), (None, 1.0), (1.0, None), (1.0, 1.0)]).select(evaluate.compared(F.col("b"), F.col("o")).alias("x")).collect()] == ["win", "loss", "loss", "loss"]
    wide = rows(spark, "id string, baseline string, tuned string", [("1", "x", "y")])
    assert sorted((r.arm, r.text) for r in evaluate.arms_of(wide, ["baseline", "tuned"]).collect()) == [("baseline", "x"), ("tuned", "y")]
    assert [(x.tic, x.hits) for x in got["b"].top_tics] == [("basta", 2), ("inklusive", 0), ("smart", 0), ("blitz", 0), ("easy peasy", 0)]


def test_metrics_as_published(spark):
    pairs = [(107, 40, 2), (1, 8, 2), (3, 8, 2), (5, 2, 0), (7, 2, 0), (1, 3, 3), (0, 7, 2), (10**12, 3, 2)]
    got = [rows(spark, "a long, b long", [(a, b)]).select(structure.rounded(F.col("a"), F.col("b"), d).alias("x")).first().x for a, b, d in pairs]
    assert got == [2.68, 0.12, 0.38, 2.0, 4.0, 0.333, 0.0, 333333333333.33]
    assert rows(spark, "a long, b long", [(1, 0)]).select(structure.rounded(F.col("a"), F.col("b"), 2).alias("x")).first().x is None
    values = {"two": [1.05, 1.06], "odd": [0.3, 0.1, 0.2], "three": [0.125, 0.125], "four": [0.12345, 0.1235]}
    for name, digits, want in (("two", 2, 1.06), ("odd", 1, 0.2), ("three", 3, 0.12), ("four", 4, 0.12)):
        assert rows(spark, "x double", [(v,) for v in values[name]]).select(evaluate.median(F.col("x"), digits).alias("m")).first().m == want


def test_depths(spark):
    def plain(heads):
        out = []
        for at in range(len(heads)):
            d = 0
            while heads[at] != at:
                at, d = heads[at], d + 1
                if d > 100:
                    break
            out.append(d)
        return out

    cases = [[0], [1, 1], [1, 2, 3, 3], [2, 2, 2], [*range(1, 130), 129], [1, 0], []]
    got = rows(spark, "i int, heads array<int>", list(enumerate(cases))).select("i", structure.depths(F.col("heads")).alias("d")).collect()
    assert {r.i: r.d for r in got} == {i: plain(h) for i, h in enumerate(cases)}
    tokens = rows(spark, "text string", [("Wir gehen in den alten Wald.",)]).select(structure.rule_annotation(F.col("text")).alias("s")).first().s[0].tokens
    assert [(t.text, t.pos, t.depth) for t in tokens] == [("Wir", "X", 1), ("gehen", "VERB", 0), ("in", "X", 3), ("den", "X", 2), ("alten", "VERB", 1), ("Wald", "NOUN", 1), (".", "PUNCT", 1)]


def test_arms_by_id(spark):
    prompts_ = rows(spark, "id string, prompt string", [("1", "p"), ("2", "q")])
    base, other = rows(spark, "id string, text string", [("2", "b2"), ("1", "b1"), ("3", "x")]), rows(spark, "id string, text string", [("1", None), ("2", "o2")])
    got = sorted(map(tuple, evaluate.paired(prompts_, {"baseline": base, "tuned": other}).collect()))
    assert got == [("1", "p", "b1", None), ("2", "q", "b2", "o2")]
    with pytest.raises(Exception, match="tuned has no text for 2"):
        evaluate.paired(prompts_, {"tuned": other.where("id = '1'")}).collect()
    with pytest.raises(Exception, match="promptonly has no text for 2"):
        judge.with_arm(prompts_, rows(spark, "id string, promptonly string", [("1", "x")]), "promptonly").collect()


def test_phrases_by_inner_word(spark, monkeypatch):
    """Long phrases by a word inside, short ones in blocks that are broadcast in parts."""
    monkeypatch.setattr(phrases, "BROADCAST_BYTES", 40)
    monkeypatch.setattr(phrases, "BLOCK_PHRASES", 2)
    texts = ["im laufe der zeit und so", "laufe der", "ximlaufe der zeit", "das im laufe der zeitung", "a  b c", "a b", None, "", "der der der"]
    listed = ["im laufe der zeit", "laufe der", "der", "e d", "a  b", " b", "nicht da", "der der der", "im laufe der zeit"]
    df, ps = rows(spark, "id int, text string", list(enumerate(texts))), rows(spark, "key int, text string", list(enumerate(listed)))
    got = {(r.id, r.key) for r in phrases.containment(df, ps, "key").collect()}
    assert got == {(i, k) for i, t in enumerate(texts) for k, p in enumerate(listed) if t and p in t}
    hits = phrases.phrase_hits(df, rows(spark, "phrase string", [(p,) for p in listed])).collect()
    assert sorted((r.id, r.phrase, r.hits) for r in hits) == sorted((i, p, t.count(p)) for i, t in enumerate(texts) for p in listed if t and p in t)
    plan = phrases.containment(df, ps.where("key = 0"), "key")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_semi_join_goes_below_the_count(spark):
    talk = rows(spark, "tokens array<string>", [(["b", "c"],), (["a", "b"],)])
    profile = ngrams.counted(ngrams.exploded(rows(spark, "tokens array<string>", [(["a", "b", "c"],)]), []), [])
    asked = rows(spark, "phrase string", [("gute idee heute",)])
    for df in (discriminate.emergent(talk, profile, [], k=1), discriminate.lookup(asked, profile)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        lines = [x.strip(" :+-") for x in plan.splitlines()]
        semi = next(k for k, x in enumerate(lines) if x.startswith("Join LeftSemi"))
        assert any(x.startswith("Aggregate [n") and "count(1)" in x for x in lines[:semi]) and not any(x.startswith("Aggregate [n") for x in lines[semi + 1 : semi + 6])


def test_many_asked_ngrams_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(discriminate, "BROADCAST_BYTES", 10)
    profile = rows(spark, "n int, ngram string, frequency long", [(2, "gute idee", 5000), (2, "idee heute", 99)])
    got = discriminate.lookup(rows(spark, "phrase string", [("gute idee heute",)]), profile).first()
    assert (got.ngram, got.frequency) == ("gute idee heute", 0)


def test_stratified_takes_the_flagship_first(spark):
    own = rows(spark, "id string, copy_type string, subject string", [(f"{t}{s}{k}", t, s) for t in "abc" for s in "xyz" for k in range(4)])
    some = prompts.stratified(own, 4, "copy_type", first=F.col("subject") == "y").collect()
    assert len(some) == 4 and sum(r.subject == "y" for r in some) >= 1 and {r.copy_type for r in some} == set("abc")
    assert prompts.stratified(own, 1, "copy_type", first=F.col("subject") == "y").first().subject == "y"
    assert prompts.stratified(own, 3, "copy_type", first=F.col("subject") == "none").select("copy_type").distinct().count() == 3


def test_budget_over_hashed_ids(spark, monkeypatch):
    monkeypatch.setattr(corpus, "STRETCH", 4)
    import random

    r = random.Random(1)
    ids = sorted(r.randrange(-(2**63), 2**63) for _ in range(60))
    df = rows(spark, "doc_id long, source string, n_tokens long", [(i, "s", k) for k, i in enumerate(ids)])
    got = {x.doc_id: x.before for x in corpus.running_before(df, "source", "doc_id", "n_tokens").collect()}
    assert got == {i: sum(range(k)) for k, i in enumerate(ids)}
    assert corpus.running_before(df.limit(0), "source", "doc_id", "n_tokens").collect() == []


def test_grid_size(spark):
    subjects = rows(spark, "id string, name string, branche string, fakten array<string>, profiling boolean", [(f"s{k}", "N", "B", [], False if k == 0 else None) for k in range(16)])
    types = rows(spark, "id string, label string, template string, ord int", [(f"t{k}", "", "{name} {tone_hint}" + (" {length_hint}" if k else ""), k) for k in range(12)])
    tones, lengths = rows(spark, "id string, hint string", [(f"o{k}", "") for k in range(4)]), rows(spark, "id string, hint string", [("kurz", "k"), ("lang", "l")])
    grid = prompts.grid(subjects, types, tones, lengths)
    assert grid.count() == 1380 and grid.where("copy_type = 't0'").count() == 60 and grid.where("copy_type = 't1'").count() == 120
    broad = prompts.broad_selection(types, ["o0", "o1", "o2"], ["kurz", "lang"])
    assert prompts.selected(broad, prompts.looked_up(subjects, "s0"), types, tones, lengths).count() == 36
    with pytest.raises(Exception, match="unknown"):
        prompts.selected(rows(spark, "copy_type string, tone string, length string", [("t1", "no", "kurz")]), prompts.looked_up(subjects, "s0"), types, tones, lengths).collect()
    with pytest.raises(Exception, match="no row"):
        prompts.looked_up(subjects, "zzz").collect()
    some = prompts.stratified(grid, 20, "copy_type")
    assert some.count() == 20 and some.select("copy_type").distinct().count() == 12
    assert {r.id for r in some.collect()} == {r.id for r in prompts.stratified(grid, 20, "copy_type").collect()}
    assert prompts.suffix(0.7) == "_t0.7" and prompts.suffix(1.0, 1.1, 0.5) == "_t1_rp1.1_ls0.5"


def test_judge(spark):
    ids = rows(spark, "id string", [(f"p{k}",) for k in range(20)])
    key = judge.blinded(ids, ["x", "y", "z"])
    assert key.groupBy("id").agg(F.count_distinct("arm").alias("n"), F.count_distinct("label").alias("m")).where("n = 3 AND m = 3").count() == 20
    verdicts = ids.select("id", F.lit("A").alias("best"), F.lit("C").alias("worst"))
    got = judge.tally(verdicts, key, rows(spark, "arm string", [("x",), ("y",), ("z",), ("none",)])).collect()
    assert sum(r.wins for r in got) == 20 and sum(r.losses for r in got) == 20 and {r.arm: (r.wins, r.losses) for r in got}["none"] == (0, 0)


def test_emergent_and_top_ties(spark):
    talk = rows(spark, "tokens array<string>", [(["b", "c"],), (["a", "b"],)])
    got = discriminate.emergent(talk, rows(spark, "n int, ngram string, frequency long", [(2, "a b", 1000)]), [], k=1).collect()
    assert [(r.ngram, r["count"], r.baseline, r.flag) for r in got] == [("a b", 1, 1000, "natural")]
    grams = ngrams.counted(ngrams.exploded(talk, []), [])
    assert [r.ngram for r in ngrams.top(grams, 1, ["n"]).collect()] == ["a b"]


def test_top_by_least_frequency(spark, monkeypatch):
    grams = rows(spark, "n int, ngram string, frequency long", [(2, f"g{i:03d}", i % 7) for i in range(60)] + [(3, f"h{i}", 5) for i in range(9)])
    want = sorted(map(tuple, ngrams.top(grams, 11, ["n"]).select("n", "ngram", "rank").collect()))
    monkeypatch.setattr(ngrams, "RANKED_EARLY", 5)
    monkeypatch.setattr(ngrams, "TIE_CHARS", 2)
    assert sorted(map(tuple, ngrams.top(grams, 11, ["n"]).select("n", "ngram", "rank").collect())) == want
    assert len(want) == 20


def test_dealt_budget_cuts_each_source_of_each_register(spark):
    rows = [(k, r, s, 10) for k, (r, s) in enumerate([("en", "x"), ("en", "x"), ("en", "x"), ("en", "y"), ("en", "y"), ("fr", "x"), ("fr", "x"), ("fr", "x"), ("fr", "x"), ("fr", None)])]
    own = corpus.dealt(spark.createDataFrame(rows, "doc_id long, register string, source string, n_tokens long"), 60)
    assert {(r.register, r.source): r.budget for r in own.collect()} == {("en", "x"): 15, ("en", "y"): 15, ("fr", "x"): 15, ("fr", None): 15}
    got = corpus.within_budget(own, F.col("budget"), key="pair")
    assert sorted(r.doc_id for r in got.collect()) == [0, 1, 3, 4, 5, 6, 9]
    weighted = corpus.dealt(own.select("register", "source"), 100, {"en": 3, "fr": 1})
    assert {r.register: r.budget for r in weighted.collect()} == {"en": 37, "fr": 12}


def test_queries_with_the_budget_of_the_reference():
    from stylomill.plans import catalogue

    assert {"ngram_profile_full", "budget_cut_full", "reference_documents_full"} <= set(catalogue.QUERIES)


def test_queries_normalise(spark, tmp_path):
    """Decomposed, wide and joined letters give the tokens of the plain text."""
    import unicodedata

    from stylomill.plans import catalogue as Q

    plain = "Größere Wälder blühen über ruhigen Dörfern; finstere Grafen müssen flüchten"
    forms = {"plain": plain, "odd": unicodedata.normalize("NFD", plain).replace("fi", "ﬁ").replace("fl", "ﬂ").replace("Grafen", "Ｇｒａｆｅｎ")}
    got = {}
    for name, text in forms.items():
        d = str(tmp_path / name)
        spark.createDataFrame([(k, "de", "s", text) for k in range(3)], "doc_id long, lang string, source string, text string").write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, f"<p>{text}</p>")], "page_id long, html string").write.parquet(f"{d}/pages.parquet")
        spark.createDataFrame([(1, 1, "assistant", text)], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
        spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        spark.createDataFrame([], "doc_id long, quality long").write.parquet(f"{d}/labels.parquet")
        same = "norm_tokens html_strip_tokens bigram_topk_by_register trigram_topk subtitle_scaled_ngrams budget_cut degenerate_docs spread_candidates emergent_diff ngram_ban_hits unique_ngrams".split()
        got[name] = {q: sorted(map(tuple, Q.QUERIES[q](spark, d).collect())) for q in same}
        got[name]["register_report"] = [r.tokens for r in Q.register_report(spark, d).collect()]
        got[name]["phrase_lookup"] = sorted((r.ngram, r.frequency, r.verdict) for r in Q.phrase_lookup(spark, d).collect())
    assert got["odd"] == got["plain"]
    assert all(got["plain"][q] for q in got["plain"] if q not in ("spread_candidates",))
