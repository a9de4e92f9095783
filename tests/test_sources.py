import json

import pytest

from stylomill.functions import text as T
from stylomill.operators import ngrams as N
from stylomill.plans.inline import rows
from stylomill.sources import readers as R
from stylomill.sources import writers as W
from stylomill.streaming import incremental as I


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv(spark, tmp_path):
    assert [tuple(r) for r in R.weighted_sentences(spark, put(tmp_path / "s.csv", 'sentence,count\n"a, b",3\n"say ""x"", \\y ",4\n')).collect()] == [("a, b", 3), ('say "x", \\y ', 4)]
    assert sorted(tuple(r) for r in R.word_counts(spark, put(tmp_path / "w.csv", "word,count\nDas,3\ndas,5\nx,1\n")).collect()) == [("das", 5), ("x", 1)]
    assert R.word_counts(spark, str(tmp_path / "none.csv")).collect() == []


def test_json_lines(spark, tmp_path):
    p = put(tmp_path / "t.jsonl", '{"text":"","output":"o"}\n{bad\n{"text":"t"}\n{"x":1}\n')
    assert sorted(r.text for r in R.texts(spark, p).collect()) == ["", "o", "t"]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|alformed"):
        R.samples(spark, p, "text string").collect()
    assert [r.prompt for r in R.prompts(spark, put(tmp_path / "p.jsonl", '{"prompt":"a"}\n\n{"prompt":"b"}\n')).collect()] == ["a", "b"]


def test_blocks(spark, tmp_path):
    assert sorted(r.text.strip() for r in R.blocks(spark, put(tmp_path / "b.txt", "eins\nzwei\n\n  \n\ndrei\n")).collect()) == ["drei", "eins\nzwei"]


def test_ban_lists(spark, tmp_path):
    mixed = json.dumps(["a b", ["c", 3], {"phrase": "d"}, {"ngram": "e"}, {"z": "f"}, "", 7, "a b"])
    got = sorted(r.phrase for r in R.ban_list(spark, put(tmp_path / "l.json", mixed)).collect())
    assert [x for x in got if x != "7"] == ["a b", "a b", "c", "d", "e", "f"]
    assert sorted(r.phrase for r in R.ban_list(spark, put(tmp_path / "d.json", '{"x y": 1, "z": 2}')).collect()) == ["x y", "z"]


def test_grouped_bans(spark, tmp_path):
    groups = json.dumps({"_comment": "[no list]", "a": ["x y", "z", ""], "b": [], "n": 3, "c": ["ä"]}, ensure_ascii=False)
    assert sorted(tuple(r) for r in R.grouped_bans(spark, put(tmp_path / "g.json", groups)).collect()) == [("a", "x y"), ("a", "z"), ("c", "ä")]


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from stylomill.sources import scratch as H

    def fake(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *a: folder, set=lambda *a: None), sparkContext=SimpleNamespace(master=master))

    assert H.shared_dir(fake("spark://x:7077", "hdfs://y")) == "hdfs://y"
    for master in ("spark://x:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            H.shared_dir(fake(master, None))
    assert H.shared_dir(fake("local[4]", None))


def test_configuration(spark, tmp_path):
    tones, lengths, types = R.copy_config(spark, put(tmp_path / "c.json", json.dumps({"tones": [{"id": "t", "hint": "h"}], "lengths": [], "copy_types": [{"id": "a", "label": "l", "template": "x"}, {"id": "b", "label": "l", "template": "y"}]}, indent=1)))
    assert tones.count() == 1 and lengths.count() == 0 and [(r.id, r.ord) for r in types.orderBy("ord").collect()] == [("a", 0), ("b", 1)]
    assert R.subjects(spark, put(tmp_path / "s.json", json.dumps({"subjects": [{"id": "x", "name": "N", "branche": "B", "fakten": ["f"]}]}))).first().profiling is None


def test_profile_round_trip(spark, tmp_path):
    from stylomill.operators.corpus import nested_profile

    ranked = rows(spark, "n int, ngram string, frequency long, rank int", [(2, "ä b", 3, 1), (3, "ä b c", 1, 1)])
    W.profile_json(nested_profile(ranked, "m", 9), str(tmp_path / "p"))
    assert sorted(tuple(r) for r in R.profile(spark, str(tmp_path / "p")).collect()) == [(2, "ä b", 3), (3, "ä b c", 1)]
    raw = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "p").glob("part-*"))
    assert "ä b" in raw and raw.startswith('{"human-authored":')


def test_tables(spark, tmp_path):
    W.candidate_tsv(rows(spark, "keep string, ngram string, count long, spread long, baseline long", [("strike", "a b", 30, 1, 0), ("slop?", "c d", 20, 6, 5)]), str(tmp_path / "c"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("part-*"))).splitlines()
    assert lines[0] == "keep\tngram\tcount\tbranchen\tbaseline" and lines[1].startswith("slop?")
    W.review_tsv(rows(spark, "phrase string, hits long", [("p", 3)]), rows(spark, "ngram string, count long, baseline long", [("x y", 9, 0)]), str(tmp_path / "r"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*"))).splitlines()
    assert [x.split("\t")[-1] for x in lines[1:] if not x.startswith("keep")] == ["seed", "emergent"]
    W.pairs(rows(spark, "id string", [("1",)]), str(tmp_path / "pairs"), "_t0.7")
    assert (tmp_path / "pairs_t0.7").exists()
    W.report_json(rows(spark, "register string, chars long, tokens long, char_pct double", [("web", 10, 2, 33.345)]), str(tmp_path / "rep"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "rep").glob("part-*")))["register_chars"] == {"web": 10}


def test_corpus_and_answers(spark, tmp_path):
    rows(spark, "register string, source string, text string", [("web", "a", "x"), ("political", "b", "y")]).write.partitionBy("register", "source").parquet(str(tmp_path / "corpus"))
    assert [r.text for r in R.corpus(spark, str(tmp_path / "corpus"), ["web"]).collect()] == ["x"]
    assert R.answers(spark, str(tmp_path / "corpus"), "number", 1).collect() == R.answers(spark, str(tmp_path / "corpus"), "number", 1).collect()


def test_stream(spark, tmp_path):
    for k, text in enumerate(("haus baum see", "haus baum")):
        rows(spark, "register string, text string", [("de", text)]).write.parquet(str(tmp_path / f"in/{k}"))
    schema = "register string, text string"
    stream = I.arriving(spark, str(tmp_path / "in/*"), schema)
    I.into_parts(stream, ["register"], str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    whole = spark.read.schema(schema).parquet(str(tmp_path / "in/*")).withColumn("tokens", T.content_tokens(T.F.col("text")))
    assert sorted(map(tuple, I.parts_summed(spark, str(tmp_path / "out"), ["register"]).collect())) == sorted(map(tuple, N.counted(N.exploded(whole, ["register"]), ["register"]).collect()))
    q = I.ngram_counts(I.arriving(spark, str(tmp_path / "in/*"), schema), ["register"]).writeStream.outputMode("complete").format("memory").queryName("grams").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("grams").where("ngram = 'haus baum'").first().frequency == 2
