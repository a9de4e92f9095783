import corpus_pipeline as P
from llm_rows import SCHEMA, edge_texts, prose, rows_of

from stylomill.llm.common import saved


def test_stages(spark, tmp_path):
    item = prose(70, 40)
    token = "token = a1b2c3d4e5f60718a1b2c3d4e5f60718"
    texts = edge_texts() + [(500, prose(71, 60) + " " + item), (501, prose(72, 60) + " " + token)] + [(600 + k, prose(600 + k, 80)) for k in range(120)]
    junk = [(900 + k, " ".join(w + "$$$" for w in prose(900 + k, 90).split())) for k in range(60)]
    docs = spark.createDataFrame(rows_of(texts + junk), SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in texts] + [(i, 0, 0) for i, _ in junk], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    kept, sets = docs, []
    for name, stage in P.STAGES[:-1]:
        kept = saved(stage(spark, kept, d), name)
        assert kept.columns == docs.columns
        sets.append({r.doc_id: r.text for r in kept.collect()})
    quality, first, clean, redacted = sets
    assert not any(i in quality for i, _ in junk) and 500 in quality and 600 in quality
    assert 1 in first and 2 not in first and 3 not in first
    assert set(first) - set(clean) == {500}
    assert redacted[501].endswith("token = [SECRET]") and redacted[600] == clean[600] and set(redacted) == set(clean)
    packed = P.STAGES[-1][1](spark, kept, d).collect()
    assert {r.doc_id for r in packed} == set(redacted)
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in P.run(spark, d).where("doc_id IS NOT NULL").collect()) == sorted((r.doc_id, r.start, r.ids_crc32) for r in packed if r.doc_id is not None)


def test_empty(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert P.run(spark, d).collect() == []


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, repeats, ties, long texts and clashing names go through every stage."""
    item = prose(70, 40)
    texts = [*edge_texts(), (None, item), (None, prose(71, 60)), (None, prose(71, 60)), (700, prose(72, 60)), (700, prose(72, 60)), (701, prose(5, 30000) + " " + prose(6, 40000))]
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None, "x", k) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string, kept int").repartition(3)
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    kept = docs
    for name, stage in P.STAGES[:-1]:
        kept = saved(stage(spark, kept, d), name)
        assert kept.columns == docs.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert not any(t and item in t for _, t in found)
    assert sum(t == prose(71, 60) for _, t in found) == 1 and sum(i == 700 for i, _ in found) == 1
    assert {(4, None), (5, ""), (6, "   \n\t ")} <= set(found)
    packed = P.packed(spark, kept, d).collect()
    assert sum(r.start == 0 for r in packed) == len(found)


def test_without_optional_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "token = a1b2c3d4e5f60718a1b2c3d4e5f60718"), (2, "nothing here"), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in P.without_secrets(spark, docs, str(tmp_path)).collect()}
    assert out == {1: "token = [SECRET]", 2: "nothing here", 3: None}
    assert P.without_secrets(spark, docs, str(tmp_path)).columns == ["doc_id", "text"]
