import random
import re

import numpy as np
from llm_rows import SCHEMA, prose, rows_of

from stylomill.llm import decontam as D

ITEMS = [
    (1, "In the year 1999 the farmer Anna bought 12 kg of apples from Bert and sold 7 kg of them to Carla for money again."),
    (2, prose(50, 40)), (3, "Too few"), (4, None), (5, ""), (6, "1 2 3 4 5 6 7 8 9 10 11 12"), (7, prose(50, 40)), (8, "exactly six plain words stand here"),
]
CASES = {
    1: ("So. In the year 2004 the farmer Olga bought 31 kg of apples from Piet and sold 9 kg of them to Lena for money again. End.", {1}),
    2: ("In the year 2004 the farmer Olga bought 31 kg of apples from Olga and sold 31 kg of them to Olga for money again.", set()),
    3: (ITEMS[0][1].upper(), {1}),
    4: ("x! " + ITEMS[1][1].upper() + " y", {2, 7}),
    5: (" ".join(ITEMS[1][1].split()[:20]), {2, 7}),
    6: (" ".join(ITEMS[1][1].split()[:10]), set()),
    7: ("1 2 3 4 5 6 7 8 9 10 11 12 and 5 6 7 8", set()),
    8: ("here exactly six plain words stand here too", {8}),
    9: (None, set()), 10: ("", set()), 11: (prose(51, 400), set()),
    12: (prose(60, 9000) + " " + ITEMS[1][1], {2, 7}),
}


def tables(spark):
    docs = [(i, t) for i, (t, _) in CASES.items()] + [(4, CASES[4][0]), (None, CASES[3][0])]
    return spark.createDataFrame(rows_of(docs), SCHEMA).repartition(3), spark.createDataFrame([(*x, "clash", 3) for x in ITEMS], "item_id long, text string, source string, n_matched long")


def want():
    return sorted([(i, k) for i, (_, found) in CASES.items() for k in found] + [(4, 2), (4, 7), (None, 1)], key=str)


def test_pairs(spark, monkeypatch):
    docs, items = tables(spark)
    for chars in (D.BLOCK_CHARS, 150):  # also in several blocks
        monkeypatch.setattr(D, "BLOCK_CHARS", chars)
        rows = D.contaminated(docs, items).collect()
        assert sorted(((r.doc_id, r.item_id) for r in rows), key=str) == want()
        assert all(r.n_plain <= r.n_windows and r.n_template <= r.n_templates and max(r.n_plain, r.n_template) >= 1 for r in rows)
        clean = D.keep_clean(docs, items)
        assert clean.columns == docs.columns
        assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, (_, f) in CASES.items() if not f)


def test_empty(spark, no_docs):
    docs, items = tables(spark)
    assert D.contaminated(no_docs, items).collect() == []
    assert D.contaminated(docs, items.limit(0)).collect() == []
    assert D.keep_clean(docs, items.limit(0)).count() == docs.count()


def test_canonical_kinds():
    t = D.Reader().read(["The man Bert ran 5 km. Then 1,000.5 kg fell; km alone", "", "Bert"])
    assert t.kind.tolist() == [0, 0, D.TITLE, 0, D.NUMBER, D.UNIT, 0, D.NUMBER, D.UNIT, 0, 0, 0, 0]
    assert t.edges.tolist() == [0, 12, 12, 13] and len(t.hash) == 13
    m = t.merged()
    assert m.kind.tolist() == [0, 0, D.TITLE, 0, D.NUMBER, 0, D.NUMBER, 0, 0, 0, 0] and m.edges.tolist() == [0, 10, 10, 11]


def test_reader_forgets_without_a_trace(monkeypatch):
    texts = [prose(k, 60) + f" So {k} km. Anna Bert {k}kg" for k in range(30)]
    whole = D.Reader().read(texts)
    monkeypatch.setattr(D, "REMEMBERED", 40)
    reader = D.Reader()
    for k in range(0, 30, 2):
        part = reader.read(texts[k : k + 2])
        mine = slice(whole.edges[k], whole.edges[k + 2])
        assert all((getattr(part, c) == getattr(whole, c)[mine]).all() for c in ("hash", "kind", "either", "joined"))


def merged_kinds(text):
    return D.Reader().read([text]).merged().kind.tolist()


def test_names_of_several_words_and_units_are_one_slot():
    N, T = D.NUMBER, D.TITLE
    assert merged_kinds("so John Smith gives Anna-Maria 5 km, 12kg and 7 - km") == [0, T, 0, T, N, N, 0, N, 0]
    assert merged_kinds("so Anna, Bert and Carl\nDora came") == [0, T, T, 0, T, 0, 0]
    assert merged_kinds("John Smith came. The Smith came.") == [T, 0, 0, T, 0]
    assert merged_kinds("") == [] and merged_kinds("Smith John. John Smith Doe") == [T, T]
    a, b = (D.Reader().read([x]).merged().hash.tolist() for x in ("so John Smith ran", "so Smith John ran"))
    assert a[0] == b[0] and a[2] == b[2] and a[1] != b[1]


def found(items, texts):
    """(text, item) of what an index of the items finds."""
    return {(t, k) for t, k, *_ in D.Index(list(enumerate(items))).matches(D.Reader().read(texts))}


def test_names_that_open_sentences():
    items = [
        "Natalia sold clips to 48 of her friends. Natalia sold half as many in May. How many clips did Natalia sell?",
        "Tom has 12 red apples. Anna has 7 green pears. Bert buys 5 of them all. How many are left?",
    ]
    texts = [
        "Marta sold clips to 52 of her friends. Marta sold half as many in June. How many clips did Marta sell?",
        "Eva has 31 red apples. Olga has 9 green pears. Piet buys 4 of them all. How many are left?",
        "Here, tom has 31 red apples. Olga has 9 green pears. Piet buys 4 of them all. so how many are left?",
        "Eva has 31 red apples. Eva has 31 green pears. Eva buys 31 of them all. How many are left?",  # one name for three
    ]
    assert found(items, texts) == {(0, 0), (1, 1), (2, 1)}
    long = ["In the year 1999 the farmer bought 12 kg of apples and then sold 7 kg of them again."]
    assert found(long, ["And in the year 2004 the farmer bought 31 kg of apples and then sold 9 kg of them again."]) == {(0, 0)}  # a word in small letters


def test_items_of_few_plain_words_count_word_for_word():
    items = [
        "Solve 3 + 5 + 7 + 9 + 11 + 13 + 15 + 17 = ?", "Berlin, Paris, Rome, Madrid, Vienna, Prague, Oslo, Bern, Lisbon, Athens, Dublin, Riga, Sofia, Warsaw",
        "Exactly Six Title Words Stand Here", "Der Hund Jagt Katzen Und Maus Durch Garten Haus Hof Wald", "Oslo Bern", "Solve 3 + 5", "1 2 3 4 5 6 7 8 9",
    ]
    assert found(items, ["well, " + x.lower() + " and so on" for x in items]) == {(k, k) for k in range(4)}
    assert found(items[:1], ["Solve 4 + 5 + 7 + 9 + 11 + 13 + 15 + 17 = ?", "3 + 5 + 7 + 9 + 11 + 13 + 15 + 17"]) == set()


def test_short_items_with_windows_of_few_words():
    items = ["What is the sum of 3, 4, 5, 6, 7, 8 and 9?", "What is the sum of 31 and 44 then?", "List of the values for x: 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16"]
    texts = [
        "What is the sum of 13, 4, 25, 36, 47, 58 and 69?", "Exercise\nWhat is the sum of 7 and 9 then?", "Exercise: “What is the sum of 7 and 9 then?”", "see (what is the sum of 7 and 9 then)",
        "Exercise\nExercise:\nwhat is the sum of 7 and 7 then", "List of the values for x: 21 22 23 24 25 26 27 28 29 30 31 32 33 34", "3 4 5 6 7 8 9 10 30 31 32 33 34 35 36 37", "What is the sum of 13, 4 and nothing else?",
    ]
    assert found(items, texts) == {(0, 0), (1, 1), (2, 1), (3, 1), (4, 1), (5, 2)}  # numbers may become equal


def test_sentences_open_after_lines_colons_and_quotes():
    t = D.Reader().read(["so\nZebra a: Dog “Horse is” the . Man of Iron"])
    assert t.kind.tolist() == [0] * 9 + [D.TITLE] and np.flatnonzero(t.either).tolist() == [1, 3, 4, 7]
    assert not D.Reader().read(["What is it? How so. The end"]).either.any()


def test_other_names_numbers_and_units():
    items = [
        "John gives 12 apples to Mary and keeps 7 apples for the rest of the week at home.",
        "Add 3 and 4 and 5 then 6 7 8",
        "Anna walked 5 km on the first day and 12 km on the second day of the long trip.",
        "Wie viele Kilometer fährt ein Zug in 3 Stunden, wenn er in jeder Stunde 80 Kilometer fährt und nicht hält?",
    ]
    texts = [
        "John Smith gives 31 apples to Mary Jane Watson and keeps 9 apples for the rest of the week at home.",
        "When asked, Mary Ann gives 5 apples to Bob and keeps 5 apples for the rest of the week at home.",  # numbers that become equal
        "so add 13 and 14 and 25 then 16 17 18 ok",
        "Add 3 and 4 and 5 then 6 7 8",
        "Olga walked 3.5 miles on the first day and 40 miles on the second day of the long trip.",
        "Also: wie viele Kilometer fährt ein Zug in 7 Stunden, wenn er in jeder Stunde 120 Kilometer fährt und nicht hält?",
        "John gives 12 apples to Mary and keeps 12 apples for the rest of her life, which is long.",  # goes on in another way after six windows
        "Subtract 3 and 4 and 5 then 6 7 8",
    ]
    assert found(items, texts) == {(0, 0), (1, 0), (2, 1), (3, 1), (4, 2), (5, 3), (6, 0)}


def test_one_value_never_stands_for_two():
    items = ["Tom has 12 apples and Tom gives 12 apples to the farmer, so that Tom has no apples and the farmer has 12 apples."]
    same = "Eva has 31 apples and Eva gives 31 apples to the farmer, so that Eva has no apples and the farmer has 31 apples."
    assert found(items, [same]) == {(0, 0)}
    mixed = "Eva has 31 apples and Bob gives 7 apples to the farmer, so that Ann has no apples and the farmer has 5 apples."
    assert found(items, [mixed]) == set()


def test_many_items_of_one_template(monkeypatch):
    """A template that very many items share is searched once, and every one of them is reported."""
    items = [f"The farmer has {k} apples and sells {k + 1} of them on the market in the next town." for k in range(3, 900)] + ["Quite another item stands here, with words of its own that nobody else has."]
    index = D.Index(list(enumerate(items)))
    assert len(index.templates) == 2 and len(index.plain) == len(items)
    seen = []
    monkeypatch.setattr(D.Index, "aligned", lambda self, *a, own=D.Index.aligned: seen.append(1) or own(self, *a))
    got = index.matches(D.Reader().read(["The farmer has 5000 apples and sells 70 of them on the market in the next town.", "the farmer has 7 apples and sells 8 of them on the market in the next town"]))
    assert len(got) == 2 * (len(items) - 1) and len(seen) <= 4
    assert {k for t, k, plain, _ in got if t == 1 and plain} == {4}
    monkeypatch.setattr(D, "PAIRS", 5)  # a window of more classes than are looked at in one go
    assert D.Index(list(enumerate(items))).matches(D.Reader().read(["the farmer has 7 apples and sells 8 of them on the market in the next town"])) == [(0, *x[1:]) for x in got if x[0] == 1]


# A matcher of its own: no hashes, no index, every alignment of an item with a document.
STARTS = set(D.OPENERS)


def canonical(text):
    """(kind, value, may be a name) of a text's tokens, names and quantities joined."""
    out = []
    for line in text.splitlines():
        last, opens = None, True
        for m in re.finditer(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+", line):
            gap = line[last.end() : m.start()] if last else ""
            opens = opens or any(c in D.MARKS for c in gap)
            near = last is not None and (gap.strip() == "" or gap == "-")
            w, low = m.group(), m.group().lower()
            title = len(w) > 1 and w[0].isupper() and w[1:].islower()
            before = out[-1] if out and last else None
            if w[0].isdigit():
                out.append(["number", low, False])
            elif low in D.UNITS and not title and near and before and before[0] == "number" and " " not in before[1]:
                before[1] += " " + low
            elif title and not opens:
                if near and before and (before[0] == "name" or before[2]):
                    before[:] = ["name", before[1] + " " + low, False]
                else:
                    out.append(["name", low, False])
            else:
                out.append(["word", low, title and opens and low not in STARTS])
            last, opens = m, False
    return [tuple(x) for x in out]


def judged(item, doc):
    """(whether the item must be found, whether it may be): with slots that agree everywhere along an alignment, and with
    windows that fit, whatever their slots."""
    i, d = canonical(item), canonical(doc)
    width = min(8, len(i))
    need, must, fitting = min(6, len(i) - width + 1), False, set()
    for shift in range(-len(i), len(d)):
        fits, words = {}, {}
        for q, (kind, value, maybe) in enumerate(i):
            if 0 <= q + shift < len(d):
                k, v, m = d[q + shift]
                words[q] = kind == k == "word" and value == v
                fits[q] = words[q] or (kind == k != "word") or ((kind == "name" or maybe) and (k == "name" or m))
        good = [q for q in range(len(i) - width + 1) if all(fits.get(q + j) for j in range(width)) and sum(words[q + j] for j in range(width)) >= min(4, width)]
        fitting |= set(good)
        slots = {(i[p][0] == "number", i[p][1], d[p + shift][1]) for q in good for p in range(q, q + width) if not words[p]}
        forward, back = {x[:2] for x in slots}, {x[2] for x in slots if not x[0]}
        if len(good) >= need and len(forward) == len(slots) and len(back) == sum(not x[0] for x in slots):
            must = True
    return must, len(fitting) >= need


NAMES = ["Anna", "Bert Brown", "Carla", "Dan", "Eva Maria Stone", "Finn", "Gus", "Hana"]
SHAPES = [
    "{a} has {x} apples and buys {y} more from {b}. How many apples does {a} have now?",
    "A train covers {x} km in {y} hours before it stops at the old station. How far does it go in {z} hours?",
    "If {a} reads {x} pages every day and the book has {y} pages, after how many days is the book read?",
    "In the town of {a} there are {x} houses with {y} rooms each, and {b} wants to paint all of these rooms with {z} liters of paint.",
    "Solve for the unknown: {x} plus {y} equals the sum of {z} and what other number, please?",
    "{a} and {b} share {x} dollars so that {a} gets {y} dollars more. What does each of them get in the end?",
]


def asked(r, shape, names=None):
    a, b = names or r.sample(NAMES, 2)
    return shape.format(a=a, b=b, x=r.randint(2, 99), y=r.randint(100, 999), z=f"{r.randint(1, 9)}.{r.randint(1, 9)}")


def test_recall_of_questions_with_other_values():
    r = random.Random(6)
    items = [asked(r, s) for s in SHAPES]
    texts, truth = [], set()
    for k in range(300):
        shape = r.randrange(len(SHAPES))
        texts.append(prose(k, 30) + r.choice([". ", "\n", ": "]) + asked(r, SHAPES[shape]) + " " + prose(1000 + k, 20))
        truth.add((k, shape))
    clean = [prose(5000 + k, 120) for k in range(100)] + [asked(r, SHAPES[k % 6])[:40] + " " + prose(k, 30) for k in range(60)]
    got = found(items, texts + clean)
    assert len(got & truth) >= 0.97 * len(truth) and not {x for x in got if x[0] >= len(texts)}


def test_against_every_alignment():
    r = random.Random(7)
    items = [asked(r, s) for s in SHAPES] + [prose(70, 12), "Add 3 kg and 4 kg"]
    texts = []
    for k in range(160):
        t = asked(r, r.choice(SHAPES)).split()
        for _ in range(r.choice([0, 0, 1, 2])):
            j = r.randrange(len(t))
            t[j : j + 1] = r.choice([[], ["really"], [t[j], "Bob"], ["17"], [t[j].lower()], [t[j].capitalize()]])
        texts.append(r.choice(["", "Well: ", "so "]) + " ".join(t))
    got, must = found(items, texts), set()
    for t, text in enumerate(texts):
        for k, item in enumerate(items):
            sure, maybe = judged(item, text)
            must |= {(t, k)} if sure else set()
            assert (t, k) not in got or maybe or shared_words(item, text), (item, text)
    assert must <= got and len(must) > 80


def shared_words(item, text):
    """Whether six windows of eight words, or all, stand in the text as they are."""
    i, d = (re.findall(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+", x.lower()) for x in (item, text))
    width = min(8, len(i))
    there = {tuple(d[j : j + width]) for j in range(len(d))}
    mine = [tuple(i[j : j + width]) in there for j in range(len(i) - width + 1)]
    return sum(mine) >= min(6, len(mine))
