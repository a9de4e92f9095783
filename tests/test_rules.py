import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stylomill.operators import evaluate, rules, structure
from stylomill.plans import catalogue
from stylomill.plans import oracle as O
from stylomill.plans.inline import rows

WORDS = [
    *structure.AUXILIARIES, "Leistung", "leistung", "geprüft", "Gebaut", "Gesagten", "gegen", "Wird", "WURDE", "wurdeΩ", "binΩ", "wordenes", "Nation", "Natıon", "Verhältniſ", "TUM", "Altertum", "Ab_ung",
    "Ab1heit", "ung", "Ung", "te", "en", "ite", "xen", "tten", "İst", "das", "Wald", "Äö", "Ét́e", "__", "_", "22", "a1", "ßt", "中文", "Ωμέγα", "ΣΑΣ", "QualitÄT", "𐐀bung", "Ⅷ", "gehen", "ge12t", "gestt",
]
GAPS = [" ", ". ", "! ", "?\n", "\t", "\x0b", ".\x0b ", "\x0c", "...  ", "? ! ", "\x01", ". \x01", "\xa0", ". \xa0", "\x85", "\r\n", "", "-", ", ", "́", " ", "“"]


def odd_texts(n):
    r = random.Random(7)
    own = ["".join(r.choice(WORDS) + (" " if r.random() < 0.6 else r.choice(GAPS)) for _ in range(r.randrange(40))) for _ in range(n)]
    return [None, "", " ", ".", "a", "\x01", *own, "das " * 130 + "gehen " + "x " * 120]


def by_sql(texts):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": range(len(texts)), "text": pa.array(texts, pa.string())}))
    found = con.execute(f"WITH {O.structure('m', 'doc_id', 'documents')} SELECT doc_id, {', '.join(O.COUNTERS)} FROM m").fetchall()
    got = {k: tuple(map(int, v)) for k, *v in found}
    return [got.get(k, (0,) * len(O.COUNTERS)) for k in range(len(texts))]


@pytest.mark.parametrize("piece", [1 << 20, 100, 1])
def test_same_as_sql_on_odd_texts(monkeypatch, piece):
    """Also where a piece ends inside a text, or holds one text of many."""
    monkeypatch.setattr(rules, "PIECE", piece)
    texts = odd_texts(400)
    assert [tuple(x.values()) for x in rules.counted(pa.array(texts, pa.string())).to_pylist()] == by_sql(texts)
    assert rules.counted(pa.array([], pa.string())).to_pylist() == []


def test_same_as_the_annotation(spark):
    texts = ["Das Haus wird heute gebaut. Die Leistung der Prüfung ist gewesen!", "Ja. So!", None, "Wir gehen in den alten Wald. 1 2 3. __ x y z", "x " * 300 + "gehen"]
    df = rows(spark, "id int, text string", list(enumerate(texts)))
    own = df.select("id", rules.counters(F.col("text")).alias("a"), structure.counters(structure.rule_annotation(F.col("text"))).alias("b")).collect()
    assert len(own) == len(texts) and all(r.a == r.b for r in own)
    assert own[0].a.n_sentences == 2 and own[0].a.n_passive == 1


def test_no_row_is_built_of_a_token(spark, tmp_path):
    """Odd white space and letters as in the SQL, and no lambda runs a token at a time."""
    texts = odd_texts(200)
    spark.createDataFrame([(k, "de", "s", t) for k, t in enumerate(texts)], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    own = catalogue.QUERIES["structural_counters"](spark, str(tmp_path))
    assert tuple(own.select(*structure.COUNTERS).first()) == tuple(map(sum, zip(*by_sql(texts), strict=True)))
    of_text = evaluate.per_text(rows(spark, "id string, arm string, text string", [("1", "a", "b")]), structure.reference(spark)).select(*structure.COUNTERS)
    for df in (own, of_text):
        assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
