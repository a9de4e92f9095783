"""Benchmark decontamination by template canonicalisation.

Texts become tokens.  In a template numbers, with the unit that follows, and names are typed slots, one for a name of several
words.  Windows of WINDOW tokens of the benchmark's items, both as templates and as plain lower-case words, are hash-joined
with the windows of every whole document.  A template match counts only if its slots are consistent: along one alignment of
item and document, a slot value of the item always stands for the same value of the document; two names never stand for
one, while numbers that differ may become equal.  Where slots disagree, what a value stands for most often holds, of equals
the larger hash.  A document is reported for an item if it holds NEED of the item's windows of one kind (all, if there are fewer).

A number is a run of digits with inner marks, a unit a unit word next to a number, a name a run of capitalised words inside a
sentence.  A capitalised word that opens a sentence is a word if it is one of OPENERS, part of the name if capitalised words
follow, and else may be a word or a name, so templates have it in both forms.  A sentence may open at the start of a text or
line and after any of MARKS.

Items of fewer than WINDOW tokens are one window; template windows of fewer than PLAIN_WORDS plain words are never reported by
themselves: in an item with fewer than NEED others they count where all the others hold along the same alignment.  Word for
word every item counts but bare rows of numbers, and items of fewer than WINDOW tokens that have fewer than PLAIN_WORDS words
of any kind.

Items whose templates are the same, with equal values at the same places, are one class: it is searched once, and its items
are named when the slots have been checked.  The benchmark is taken in blocks of BLOCK_CHARS characters, each broadcast on
its own, with a pass over the documents for each.

Null texts are empty and match nothing; null ids are carried.  Rows that repeat an id, on either side, are reported each.
Long texts are read whole.  Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_SLICE_BYTES, slices
from .tokens import Grown, Numbered

WINDOW = 8
NEED = 6
PLAIN_WORDS = 4
BLOCK_CHARS = 8_000_000
REMEMBERED = 100_000
TABLE_BITS = 22
#: Forms of windows that are hashed in one go, and pairs of windows that are looked at in one go.
FORMS = 1 << 17
PAIRS = 1 << 21
#: Marks after which a sentence may open, as it may after a line break.
MARKS = ".!?:\"'“”„«»‘’"
TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+|[" + MARKS + "]+")
#: Words that measure what the number before them counts.
UNITS = frozenset(
    "mm cm m km mg g kg t ml cl l s sec min h hr hrs ms hz khz mhz ghz w kw mw v a kwh j kj kcal pa bar c f k inch inches foot feet yard yards mile miles ounce ounces pound pounds ton tons "
    "second seconds minute minutes hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters gram grams kilogram kilograms "
    "liter liters litre litres degree degrees percent dollar dollars euro euros cent cents usd eur gbp byte bytes kb mb gb tb".split()
)
#: Words that often open a sentence and are no names.
OPENERS = frozenset(
    "the a an this that these those each every some any many most all both no if when while after before since as at in on of for from to with by during "
    "how what which who whose where why is are was were do does did can could will would should may let there here it he she they we you i my his her their our and but or so then now one two three "
    "der die das ein eine wenn als nach vor in im auf aus bei mit von zu für wie was welche wer wo warum ist sind war es er sie wir ihr ich und aber dann jeder jede "
    "le la les un une des si quand après avant dans sur pour avec de du comment quel quelle qui où pourquoi est il elle ils elles nous vous je et mais chaque "
    "el los las unos si cuando después antes en por con del cómo qué cuál quién dónde es son y pero cada".split()
)
PLAIN, NUMBER, TITLE, UNIT = range(4)
_PLACEHOLDER = np.array([0, *(xxhash.xxh64_intdigest(x, 1) for x in ("number", "name"))], np.uint64)
_STEPS = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OPENERS = np.array(sorted(map(xxhash.xxh64_intdigest, OPENERS)), np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Tokens:
    """Tokens of some texts: hash (of the lower-cased token), kind, either (whether a PLAIN one may be a name as well), joined
    (whether nothing but a space or hyphen parts it from the one before), and each text's first token with the end."""

    def __init__(self, hash_: np.ndarray, kind: np.ndarray, either: np.ndarray, joined: np.ndarray, edges: np.ndarray):
        self.hash, self.kind, self.either, self.joined, self.edges = hash_, kind, either, joined, edges

    def merged(self) -> Tokens:
        """With a number and its unit as one token, and a run of capitalised words."""
        kind, before = self.kind, np.r_[np.uint8(UNIT), self.kind[:-1]][: len(self.kind)]
        named = (before == TITLE) | np.r_[False, self.either[:-1]][: len(kind)]
        on = self.joined & ((kind == UNIT) & (before == NUMBER) | (kind == TITLE) & named)
        first = np.flatnonzero(~on)
        size = np.diff(np.r_[first, len(kind)])
        place = np.arange(len(kind)) - np.repeat(first, size)
        value = np.add.reduceat(self.hash * _STEPS[place % len(_STEPS)], first) if len(first) else self.hash
        own = np.where((size > 1) & (kind[first] != NUMBER), TITLE, kind[first]).astype(np.uint8)
        own[own == UNIT] = PLAIN
        return Tokens(np.where(size > 1, value, self.hash[first]), own, self.either[first] & (size == 1), np.zeros(len(first), bool), np.searchsorted(first, self.edges))

    def template(self) -> np.ndarray:
        return np.where(self.kind == PLAIN, self.hash, _PLACEHOLDER[np.minimum(self.kind, TITLE)])


class Reader:
    """Turns texts into tokens; a bounded memory of pieces between white space saves work."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.known = Numbered()
        self.start, self.length, self.ends, self.closed = Grown("int64"), Grown("int64"), Grown("bool"), Grown("bool")
        self.hash, self.kind, self.opens, self.glued = Grown("uint64"), Grown("uint8"), Grown("bool"), Grown("bool")

    def shrink(self) -> None:
        """Forgets all but the first half of what is remembered; frequent pieces were met early."""
        n = min(len(self.known), REMEMBERED // 2)
        first, self.known = self.known, Numbered()
        self.known.update(islice(first.items(), n))
        tokens = int(self.start.data[n - 1] + self.length.data[n - 1]) if n else 0
        for grown in (self.start, self.length, self.ends, self.closed):
            grown.n = n
        for grown in (self.hash, self.kind, self.opens, self.glued):
            grown.n = tokens

    def learn(self) -> None:
        lengths, hashes, kinds, opens, ends, glued, closed = [], [], [], [], [], [], []
        for piece in self.known.new:
            n, marked, upto = 0, False, 0
            for found in TOKEN.finditer(piece):
                token = found.group()
                if token[0] in MARKS:
                    marked = True
                    continue
                low = token.lower()
                hashes.append(xxhash.xxh64_intdigest(low))
                title = len(token) > 1 and token[0].isupper() and token[1:].islower()
                kinds.append(NUMBER if token[0].isdigit() else UNIT if low in UNITS and not title else TITLE if title else PLAIN)
                opens.append(marked)
                glued.append(piece[upto : found.start()] in (("", "-") if n else ("",)))
                n, marked, upto = n + 1, False, found.end()
            lengths.append(n)
            ends.append(marked)
            closed.append(n > 0 and upto == len(piece))
        length = np.array(lengths, np.int64)
        self.start.add(self.hash.n + np.cumsum(length) - length)
        self.length.add(length)
        self.hash.add(np.array(hashes, np.uint64))
        self.kind.add(np.array(kinds, np.uint8))
        for grown, values in ((self.opens, opens), (self.ends, ends), (self.glued, glued), (self.closed, closed)):
            grown.add(np.array(values, bool))
        self.known.new = []

    def read(self, texts: list[str]) -> Tokens:
        if len(self.known) > REMEMBERED:
            self.shrink()
        number, numbers = self.known.__getitem__, []
        for text in texts:
            pieces = " . ".join(text.splitlines()).split()
            numbers.append(np.fromiter(map(number, pieces), np.int64, len(pieces)))
        if self.known.new:
            self.learn()
        at = np.concatenate([np.empty(0, np.int64), *numbers])
        length = self.length.data[at]
        before = np.cumsum(length) - length
        place = np.repeat(self.start.data[at] - before, length) + np.arange(length.sum())
        edges = np.r_[before, length.sum()][np.cumsum([0, *map(len, numbers)])]
        hashes, kind, opens, joined = self.hash.data[place], self.kind.data[place].copy(), self.opens.data[place].copy(), self.glued.data[place].copy()
        # A piece without tokens stands before the next one that has some.
        first = np.concatenate([edges[:-1], (before + length)[self.ends.data[at]]])
        opens[first[first < len(kind)]] = True
        open_end = np.concatenate([edges[:-1], (before + length)[~self.closed.data[at]]])
        joined[open_end[open_end < len(kind)]] = False
        either = (kind == TITLE) & opens
        kind[either] = PLAIN
        either &= ~np.isin(hashes, _OPENERS)
        counted = np.zeros(len(kind), bool)
        counted[1:] = (kind[:-1] == NUMBER) & joined[1:]
        kind[(kind == UNIT) & ~counted] = PLAIN
        return Tokens(hashes, kind, either, joined, edges)


def windows(tokens: np.ndarray, width: int, kind: int) -> np.ndarray:
    n = max(0, len(tokens) - width + 1)
    h = np.full(n, width * 2 + kind, np.uint64)
    for j in range(width):
        h = (h ^ tokens[j : j + n]) * _MIX
        h ^= h >> np.uint64(32)
    return h


def named(template: np.ndarray, kinds: np.ndarray, either: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Further forms of template windows, hashes and places: with every choice of the tokens that may be names as names,
    as long as PLAIN_WORDS plain words (or all, of a narrower window) are left."""
    n = max(0, len(template) - width + 1)
    at = np.flatnonzero(either)
    if not n or not len(at):
        return
    first = np.searchsorted(at, np.arange(n))
    count = np.searchsorted(at, np.arange(n) + width) - first
    plain = np.r_[0, np.cumsum(kinds == PLAIN)]
    spare = plain[width : width + n] - plain[:n] - min(PLAIN_WORDS, width)
    # All of them as names: one more stream.
    rows = np.flatnonzero((count > 0) & (spare >= count))
    yield windows(np.where(either, _PLACEHOLDER[TITLE], template), width, 0)[rows], rows
    for c in range(2, count.max() + 1):
        chosen = np.array([x for x in range(1, (1 << c) - 1) if x.bit_count() <= width - min(PLAIN_WORDS, width)], np.int64)
        bits = np.array([x.bit_count() for x in chosen.tolist()])
        rows = np.flatnonzero((count == c) & (spare > 0))
        for lot in np.array_split(rows, -(-len(rows) * len(chosen) // FORMS)) if len(rows) and len(chosen) else []:
            spot = lot[:, None] + np.arange(width)
            nth = np.cumsum(either[spot], axis=1) - 1
            as_name = either[spot] & (chosen[:, None, None] >> nth.clip(0) & 1).astype(bool)
            own = np.where(as_name, _PLACEHOLDER[TITLE], template[spot])
            h = np.full(own.shape[:2], width * 2, np.uint64)
            for j in range(width):
                h = (h ^ own[:, :, j]) * _MIX
                h ^= h >> np.uint64(32)
            keep = bits[:, None] <= spare[lot]
            yield h[keep], np.broadcast_to(lot, keep.shape)[keep]


class Table:
    """Sorted hashes of windows, each with the class that it is of and its place there."""

    def __init__(self, parts: list[tuple[np.ndarray, int, np.ndarray]]):
        h = np.concatenate([np.empty(0, np.uint64), *(x for x, _, _ in parts)])
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.owner = np.concatenate([np.empty(0, np.int64), *(np.full(len(x), k) for x, k, _ in parts)])[order]
        self.place = np.concatenate([np.empty(0, np.int64), *(p for _, _, p in parts)])[order]
        self.some = np.zeros(1 << TABLE_BITS, bool)
        self.some[(self.hash & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)] = True

    def meet(self, h: np.ndarray, at: np.ndarray, edges: np.ndarray, width: int) -> Iterator[np.ndarray]:
        """Rows (text, class, place in the class, token of the texts) of equal windows, PAIRS of them at a time; h: hashes of
        the windows that begin at the tokens `at`."""
        if not len(self.hash):
            return
        own = np.flatnonzero(self.some[(h & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)])
        own = own[self.hash[np.searchsorted(self.hash, h[own]).clip(0, len(self.hash) - 1)] == h[own]]
        text = np.searchsorted(edges, at[own], side="right") - 1
        inside = at[own] + width <= edges[text + 1]
        own, text = own[inside], text[inside]
        low, high = np.searchsorted(self.hash, h[own]), np.searchsorted(self.hash, h[own], side="right")
        total = np.cumsum(high - low)
        begin = 0
        while begin < len(own):  # a window that many classes share is met on its own
            done = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, done + PAIRS, side="right")))
            n = (high - low)[begin:end]
            entry = np.repeat(low[begin:end] - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield np.stack([np.repeat(text[begin:end], n), self.owner[entry], self.place[entry], np.repeat(at[own[begin:end]], n)], axis=1)
            begin = end


class Index:
    """The windows of a block of items, as plain words and as templates."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids = [i for i, _ in items]
        #: Classes of equal items and of equal templates: their tokens, and the items that they stand for.
        self.plain: list[np.ndarray] = []
        self.plain_items: list[list[int]] = []
        self.templates: list[Tokens] = []
        self.template_items: list[list[int]] = []
        self.n_plain, self.n_template = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
        same: dict[bytes, int] = {}
        alike: dict[tuple[bytes, ...], int] = {}
        reader = Reader()
        for k, (_, text) in enumerate(items):
            tokens = reader.read([text])
            words = (tokens.kind != NUMBER).sum()
            if not len(tokens.hash) or words < PLAIN_WORDS and (len(tokens.hash) < WINDOW or not words):
                continue
            template = tokens.merged()
            self.n_plain[k], self.n_template[k] = (len(x.hash) - min(WINDOW, len(x.hash)) + 1 for x in (tokens, template))
            c = same.setdefault(tokens.hash.tobytes(), len(same))
            if c == len(self.plain):
                self.plain.append(tokens.hash)
                self.plain_items.append([])
            self.plain_items[c].append(k)
            values: dict[tuple[int, int], int] = {}
            slots = np.array([values.setdefault(x, len(values)) for x in zip(template.kind.tolist(), template.hash.tolist(), strict=True)])
            c = alike.setdefault((template.template().tobytes(), template.kind.tobytes(), template.either.tobytes(), slots.tobytes()), len(alike))
            if c == len(self.templates):
                self.templates.append(template)
                self.template_items.append([])
            self.template_items[c].append(k)
        parts: list[list] = [[], []]
        for c, stream in enumerate(self.plain):
            h = windows(stream, min(WINDOW, len(stream)), 1)
            parts[0].append((h, c, np.arange(len(h))))
        for c, t in enumerate(self.templates):
            width = min(WINDOW, len(t.hash))
            wordy = np.flatnonzero(np.convolve(t.kind == PLAIN, np.ones(width, int), "valid") >= min(PLAIN_WORDS, width))
            stream = t.template()
            parts[1].append((windows(stream, width, 0)[wordy], c, wordy))
            parts[1] += [(h, c, at) for h, at in named(stream, t.kind, t.either, width)]
        self.plain_table, self.template_table = map(Table, parts)
        self.plain_widths, self.template_widths = (sorted({min(WINDOW, len(x)) for x in own}) for own in (self.plain, [t.hash for t in self.templates]))
        self.plain_need = np.array([min(NEED, len(x) - min(WINDOW, len(x)) + 1) for x in self.plain], np.int64)
        self.template_need = np.array([min(NEED, len(t.hash) - min(WINDOW, len(t.hash)) + 1) for t in self.templates], np.int64)
        #: Of each template, the windows that are indexed in every form, where these are too few to reach what is needed.
        self.firm = [self._firm(c) for c in range(len(self.templates))]
        self.search_need = np.array([n if f is None else 1 for n, f in zip(self.template_need, self.firm, strict=True)], np.int64)

    def _firm(self, c: int) -> np.ndarray | None:
        t = self.templates[c]
        width = min(WINDOW, len(t.hash))
        firm = np.flatnonzero(np.convolve((t.kind == PLAIN) & ~t.either, np.ones(width, int), "valid") >= min(PLAIN_WORDS, width))
        return firm if len(firm) < self.template_need[c] else None

    def matches(self, tokens: Tokens) -> list[tuple[int, int, int, int]]:
        """(text, item, windows matched as plain words, as templates) of those that match enough."""
        held: dict[tuple[int, int], list[int]] = defaultdict(lambda: [0, 0])
        found = [np.empty((0, 3), np.int64)]
        for width in self.plain_widths:
            h = windows(tokens.hash, width, 1)
            found += [np.unique(x[:, :3], axis=0) for x in self.plain_table.meet(h, np.arange(len(h)), tokens.edges, width)]
        pairs, n = np.unique(np.unique(np.concatenate(found), axis=0)[:, :2], axis=0, return_counts=True)
        for (t, c), count in zip(pairs.tolist(), n.tolist(), strict=True):
            if count >= self.plain_need[c]:
                for k in self.plain_items[c]:
                    held[t, k][0] = count
        merged = tokens.merged()
        stream, found = merged.template(), [np.empty((0, 4), np.int64)]
        for width in self.template_widths:
            forms = [(windows(stream, width, 0), None), *named(stream, merged.kind, merged.either, width)]
            found += [np.unique(x, axis=0) for h, at in forms for x in self.template_table.meet(h, np.arange(len(h)) if at is None else at, merged.edges, width)]
        whole = np.unique(np.concatenate(found), axis=0)
        # Whether enough windows were met at all, before any slot is looked at.
        pairs, back, n = np.unique(np.unique(whole[:, :3], axis=0)[:, :2], axis=0, return_inverse=True, return_counts=True)
        enough = {(t, c) for (t, c), count in zip(pairs.tolist(), n.tolist(), strict=True) if count >= self.search_need[c]}
        windows_of: dict[tuple[int, int], set[int]] = defaultdict(set)
        shifts = np.unique(np.stack([whole[:, 0], whole[:, 1], whole[:, 3] - whole[:, 2]], axis=1), axis=0)
        for t, c, shift in shifts.tolist() if enough else []:
            if (t, c) in enough:
                windows_of[t, c] |= self.aligned(c, shift, merged, int(merged.edges[t]), int(merged.edges[t + 1]))
        for (t, c), matched in windows_of.items():
            if len(matched) >= self.template_need[c]:
                for k in self.template_items[c]:
                    held[t, k][1] = len(matched)
        return [(t, k, *counts) for (t, k), counts in sorted(held.items())]

    def aligned(self, c: int, shift: int, tokens: Tokens, low: int, high: int) -> set[int]:
        """The template's windows that hold where its token q stands at q + shift of a text's tokens, low to high."""
        own = self.templates[c]
        width = min(WINDOW, len(own.hash))
        start, end = max(0, low - shift), min(len(own.hash), high - shift)
        mine, there = slice(start, end), slice(start + shift, end + shift)
        if end - start < width:
            return set()
        slot = np.where(own.either[mine], TITLE, own.kind[mine])
        word = (own.hash[mine] == tokens.hash[there]) & (own.kind[mine] == PLAIN) & (tokens.kind[there] == PLAIN)
        fits = word | (slot != PLAIN) & (slot == np.where(tokens.either[there], TITLE, tokens.kind[there]))

        def summed(x: np.ndarray) -> np.ndarray:
            before = np.r_[0, np.cumsum(x)]
            return before[width:] - before[:-width]

        whole = summed(fits) == width
        wordy = whole & (summed(word) >= min(PLAIN_WORDS, width))
        pairs = [None if w else (int(s), int(a), int(b)) for w, s, a, b in zip(word, slot, own.hash[mine], tokens.hash[there], strict=True)]
        # First with words alone where a sentence opens, as a name there that differs must not unsettle the other slots.
        chosen = [wordy & (summed(own.either[mine] & ~word) == 0), wordy]
        # Windows of few words, which are not found by themselves, count where those that are all hold.
        if self.firm[c] is not None and wordy.any() and np.isin(self.firm[c], start + np.flatnonzero(whole)).all():
            chosen.append(whole)
        return {start + q for held in chosen for q in self.consistent(np.flatnonzero(held).tolist(), width, pairs)}

    @staticmethod
    def consistent(places: list[int], width: int, pairs: list[tuple[int, int, int] | None]) -> list[int]:
        """Of the windows at these places, those whose slots agree with what the slots stand for most often.

        pairs: kind, value and the value there of each token that fills a slot."""
        there, back = defaultdict(Counter), defaultdict(Counter)
        for q in {q + j for q in places for j in range(width)}:
            if pairs[q]:
                kind, a, b = pairs[q]
                there[kind, a][b] += 1
                back[kind, b][a] += 1
        most = {x: max(c.items(), key=lambda y: (y[1], y[0]))[0] for x, c in there.items()}
        least = {x: max(c.items(), key=lambda y: (y[1], y[0]))[0] for x, c in back.items()}
        agrees = [p is None or most.get(p[:2]) == p[2] and (p[0] == NUMBER or least.get((p[0], p[2])) == p[1]) for p in pairs]
        return [q for q in places if all(agrees[q : q + width])]


def indexes(benchmark: DataFrame) -> Iterator[Broadcast]:
    """The benchmark's index, block by block."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    chars = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-chars // BLOCK_CHARS))
    for k in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).orderBy("item_id", "text").toArrow()
        yield benchmark.sparkSession.sparkContext.broadcast(Index(list(zip(block.column("item_id").to_pylist(), block.column("text").to_pylist(), strict=True))))


def texts_of(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in batch.column("text").to_pylist()]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_plain, n_windows (windows that match word for word, and all of the item), n_template, n_templates (the
    same of its template) of each row of docs(doc_id, text) with each item of benchmark(item_id, text) that it holds."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = ("doc_id", "item_id", "n_plain", "n_windows", "n_template", "n_templates")

    def passed(shared: Broadcast) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, reader = shared.value, Reader()
            for batch in slices(batches, most=SMALL_SLICE_BYTES):
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[t], index.ids[k], plain, int(index.n_plain[k]), n, int(index.n_template[k])) for t, k, plain, n in index.matches(reader.read(texts_of(batch)))]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(len(names))], names=list(names))

        return own.mapInArrow(search, ", ".join(f"{c} long" for c in names))

    return reduce(DataFrame.unionByName, map(passed, indexes(benchmark)))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item of the benchmark."""

    def passed(rest: DataFrame, shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, reader = shared.value, Reader()
            for batch in slices(batches, most=SMALL_SLICE_BYTES):
                clean = np.ones(batch.num_rows, bool)
                clean[[t for t, *_ in index.matches(reader.read(texts_of(batch)))]] = False
                yield batch.filter(pa.array(clean))

        return rest.mapInArrow(run, rest.schema)

    return reduce(passed, indexes(benchmark), docs)
