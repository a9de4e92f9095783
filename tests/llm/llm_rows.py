"""Rows that the tests of these operators share."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, key string, kept string"


def prose(seed: int, n: int, stems=("mar", "lo", "ti", "ven", "sal", "un", "dor", "qui", "ba", "rel")) -> str:
    r = random.Random(seed)
    out = []
    for k in range(n):
        w = "".join(r.choice(stems) for _ in range(r.randint(1, 4)))
        out.append(w.capitalize() if k % 11 == 0 else w + ("." if k % 11 == 10 else ""))
    return " ".join(out)


def edge_texts() -> list[tuple[int | None, str | None]]:
    base = prose(1, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    passage = prose(2, 60)
    rows: list[tuple[int | None, str | None]] = [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, "   \n\t "), (7, "one"), (8, "one two"), (9, "One TWO"), (10, "one two three"),
        (11, prose(3, 80) + " " + passage), (12, passage + " " + prose(4, 90)), (13, "ab" * 400), (14, prose(5, 30000)), (15, "naïve café Ünïcode ÀÉÎ — “x” 中文 🙂 \x1c ﬁ İ Σ"),
        (16, "<|endoftext|> ### Assistant: </turn> \\h \\\\ "), (17, "é" * 300), (17, "é" * 300), (18, prose(6, 50)), (18, prose(7, 50)), (None, base), (None, None),
        (19, "1234 !!! ??? ..."), (20, "x" * 5000), (21, prose(5, 1500)),
    ]
    return rows + [(100 + k, prose(1000 + k, 20 + 3 * k)) for k in range(25)]


def rows_of(texts, lang=lambda i: "en", source=lambda i: f"s{i % 5}"):
    return [(i, t, lang(i or 0), source(i or 0), -1 if t is None else len(t), 99, "clash", "clash") for i, t in texts]
