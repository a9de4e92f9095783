"""Small tables that queries carry with them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..functions import constants as C


def rows(spark: SparkSession, schema: str, values: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame(list(values), schema)


WORDS = (*(p for k, p in C.CANDIDATES if k == "slop_words"), "the", "Und", "que", "nowhere")
PHRASES = [*(p for k, p in C.CANDIDATES if k == "slop_phrases"), "the in", "in the", "the", "de la", "que ", "und die", "that that", "all rights reserved"]

SUBJECTS = [
    ("almhof", "Hotel Almhof", "Gastgewerbe", ["zwölf Zimmer am See", "Frühstück bis elf Uhr"], False),
    ("werft", "Bootswerft Nord & Söhne", "Handwerk", ["Holzboote nach Maß", "Winterlager in der Halle", "Reparatur binnen einer Woche"], None),
    ("imkerei", "Imkerei Lindental", "Landwirtschaft", [], True),
    ("praxis", "Hörpraxis am Markt", "Gesundheit", ["Hausbesuche"], None),
    ("verlag", "Kartenverlag  Weitblick", "Medien", ["Wanderkarten 1:25 000"], True),
]
TONES = [("sachlich", "Ton: sachlich."), ("emotional", "Ton: warm."), ("modern", "Ton: frisch."), ("premium", "Ton: gehoben.")]
LENGTHS = [("kurz", "Bitte kurz."), ("ausfuehrlich", "Gern ausführlich.")]
COPY_TYPES = [
    ("hero", "Kopfbereich", "Schreib den Kopfbereich der Startseite von {name} ({branche}). {fakten_block} {tone_hint} {length_hint}"),
    ("ueber_uns", "Über uns", "Stell {name} in einem Absatz vor. {fakten_block} {tone_hint} {length_hint}"),
    ("cta", "Aufruf", "Lade zum Schluss zu {name} ein. {tone_hint} {length_hint}"),
    ("faq", "Fragen", "Schreib drei Fragen und Antworten zu {name} ({branche}). {fakten_block} {tone_hint} {length_hint}"),
    ("taglines", "Leitsätze", "Schlag fünf Leitsätze für {name} vor. {fakten_block} {tone_hint}"),
]
SELECTION = [("hero", "modern", "kurz"), ("ueber_uns", "sachlich", "ausfuehrlich"), ("faq", "sachlich", "ausfuehrlich"), ("taglines", "premium", "na")]
ANSWERS = [
    ("number", "base", "2 + 2 is 4, so\n#### 4", "so it is #### 4"),
    ("number", "base", "1,234.5 pieces", "#### 1234.5"),
    ("number", "base", "none", "#### 7"),
    ("number", "tuned", "#### -3.0005", "-3"),
    ("number", "tuned", "#### 12 or 13", "12"),
    ("choice", "base", "the answer is b", "A"),
    ("choice", "base", "(c)", "C"),
    ("choice", "tuned", "d", "D"),
    ("choice", "tuned", "", "A"),
]
ARMS = ["baseline", "prompted", "tuned", "unused"]
VERDICTS = [("p1", "A", "C"), ("p2", "B", "A"), ("p3", "A", "B"), ("p4", "C", "A")]
BLIND = [(f"p{i}", label, ARMS[(i * j + j) % 3]) for i in range(1, 5) for j, label in enumerate("ABC")]
