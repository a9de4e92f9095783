"""The counters of structure.rule_annotation(), of whole arrays of characters: no token becomes a string or a row.

Texts are joined, and taken a piece at a time; a piece ends with a text, or else with a sentence.  Classes and lower case are
those of single characters.  A word's first and last characters stand in 64-bit numbers, so that lists of words and endings
are compared as numbers; characters beyond U+00FF, which no list has, are OTHER there."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import constants as C
from .structure import AUXILIARIES, COUNTERS, DEEPEST, INFINITIVES, PARTICIPLES

#: Bytes of text that are looked at in one go; one sentence may be more.
PIECE = 1 << 18

LETTER, DIGIT, LINE, UPPER, LOWER, BLANK, STOP, BREAK = (1 << k for k in range(8))
#: Ends a sentence, as in the SQL; stands between texts.
MARK = "\x01"
END = re.compile(rb"[.!?][ \t\n\f\r]|\x01")
#: No character of a higher plane is a letter or a number.
PLANES = 0x40000
#: Stands for characters that no list has; never a word's.
OTHER = ord(MARK)


@lru_cache(maxsize=1)
def _tables():
    """Kinds of all characters, and their lower case if that is below U+0100, else OTHER."""
    import numpy as np

    kinds, lower = np.zeros(0x110000, np.uint8), np.full(0x110000, OTHER, np.uint8)
    for c in range(PLANES):
        of = unicodedata.category(x := chr(c))
        if of[0] in "LN":
            kinds[c] = (LETTER if of[0] == "L" else DIGIT) | {"Lu": UPPER, "Ll": LOWER}.get(of, 0)
        low = ord(x.lower()[0])
        lower[c] = low if low < 0x100 else OTHER
    for chars, kind in (("_", LINE), (" \t\n\f\r", BLANK), (".!?", STOP), (MARK, BREAK)):
        kinds[[ord(x) for x in chars]] = kind
    return kinds, lower


def _head(word: str) -> int:
    return int.from_bytes(word.encode("latin-1"), "little")


def _eights(low):
    """The eight characters from each place on, as a number."""
    import numpy as np

    return np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))


def _among(heads, words: Iterable[str]):
    import numpy as np

    own = np.array(sorted(map(_head, words)), np.uint64)
    return own[np.minimum(np.searchsorted(own, heads), len(own) - 1)] == heads


def _ends(tails, ending: str):
    import numpy as np

    return tails >> np.uint64(64 - 8 * len(ending)) == np.uint64(_head(ending))


def _counted(joined: str, first, n_texts: int):
    """The counters, a row each, of texts that are joined by MARK; first: where each one begins."""
    import numpy as np

    kinds, lower = _tables()
    # eight characters before and after, so that eight can be read at any place
    c = np.frombuffer((MARK * 8 + joined + MARK * 8).encode("utf-32-le"), np.uint32)
    k, low = kinds[c], lower[c]
    word = (k & (LETTER | DIGIT | LINE)) != 0
    cut = (k & BREAK) != 0
    cut[1:] |= ((k[1:] & BLANK) != 0) & ((k[:-1] & STOP) != 0)
    starts = (k & (LETTER | DIGIT | LINE | BLANK | BREAK)) == 0
    starts[1:] |= word[1:] & ~word[:-1]
    s = np.flatnonzero(starts)
    if not len(s):
        return np.zeros((len(COUNTERS), n_texts), np.int64)
    long = word[s]
    e = s + 1
    e[long] = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    size = e - s

    def inside(kind: int):
        sums = np.cumsum((k & kind) != 0, dtype=np.int32)
        return sums[e - 1] - sums[s - 1]

    n_letters = inside(LETTER)
    letters = n_letters == size
    real = long if not ((k & LINE) != 0).any() else long & (inside(LINE) < size)

    eights = _eights(low)
    masks = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
    heads, tails = eights[s] & masks[np.minimum(size, 8)], eights[e - 8]

    # what follows from the word alone
    t_, te, en = (_ends(tails, x) for x in ("t", "te", "en"))
    listed = np.flatnonzero(letters & (size < 8))
    listed = listed[_among(heads[listed], AUXILIARIES)]

    def marked(places):
        own = np.zeros(len(s), bool)
        own[places] = True
        return own

    aux, infinitive, participle = marked(listed), *(marked(listed[_among(heads[listed], x)]) for x in (INFINITIVES, PARTICIPLES))
    named = ((k[s] & UPPER) != 0) & ((k[s + 1] & LOWER) != 0)
    verbal = letters & (t_ & (size >= 3) | (te | en) & (size >= 4))
    part = letters & (heads & masks[2] == _head("ge")) & (t_ & (size >= 5) | en & (size >= 6)) | participle
    werden = marked(listed[np.any([heads[listed] & masks[len(p)] == _head(p) for p in C.PASSIVE_PREFIXES], axis=0)])

    # sentences
    of_cut = np.cumsum(cut, dtype=np.int32)[s]
    opens = np.concatenate(([True], of_cut[1:] != of_cut[:-1]))
    at = np.flatnonzero(opens)
    of = np.cumsum(opens, dtype=np.int32) - 1

    noun = named & ~aux & ~opens
    verb = aux | verbal & ~noun
    finite = verb & ~part & np.where(aux, ~infinitive, t_ | te)
    nominal = np.flatnonzero(noun)
    nominal = marked(nominal[_nominal(c, low, e[nominal], size[nominal])])

    root = at.copy()
    v = np.flatnonzero(verb)
    v = v[np.concatenate(([True], of[v][1:] != of[v][:-1]))] if len(v) else v
    root[of[v]] = v

    # hops: up to the next token that hangs on the root, or the last, and from there
    place = np.arange(len(s))
    held = verb | noun
    held[root] = True
    after = np.append(np.flatnonzero(held), len(s))[np.cumsum(held, dtype=np.int32)]
    ends = np.append(at[1:], len(s))[of]
    depth = np.where(held, 1, np.where(after < ends, after - place + (after != root[of]), ends - place))
    depth[root] = 0
    depth = np.minimum(depth, DEEPEST) * real

    def total(values):
        return np.add.reduceat(values, at, dtype=np.int64)

    tokens = total(real)
    kept = (tokens >= C.MIN_SENTENCE_TOKENS) & (total(n_letters) > 0)
    passive = np.logical_or.reduceat(werden, at) & np.logical_or.reduceat(part & (verb | noun), at)
    row = np.searchsorted(first, s[at] - 8, side="right") - 1
    sums = (np.ones(len(at), np.int64), tokens, total(noun), total(verb), total(nominal), total(finite), total(depth), tokens, passive)
    return np.array([np.bincount(row[kept], x[kept], n_texts) for x in sums]).astype(np.int64)


def _nominal(c, low, e, size):
    """Whether words end as nominalisations; here a long s is an s, and a dotted capital i is none."""
    import numpy as np

    if int(c.max()) >= 0x130:
        low = np.where(c == 0x17F, np.uint8(ord("s")), np.where(c == 0x130, np.uint8(OTHER), low))
    tails = _eights(low)[e - 8]
    return np.any([_ends(tails, x) & (size >= len(x)) for x in C.NOMINAL_SUFFIXES if not any(x != y and x.endswith(y) for y in C.NOMINAL_SUFFIXES)], axis=0)


def _pieces(text: bytes) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE and (end := END.search(text, at + PIECE)):
        yield text[at : end.end()].decode(errors="replace")
        at = end.end()
    yield text[at:].decode(errors="replace")


def counted(texts: pa.Array) -> pa.StructArray:
    """The counters of each text of an array; null counts as empty."""
    import numpy as np

    out, rows, held, size = np.zeros((len(COUNTERS), len(texts)), np.int64), [], [], 0

    def add() -> None:
        first = np.cumsum([0] + [len(x) + 1 for x in held[:-1]])
        np.add.at(out, (slice(None), np.array(rows)), _counted(MARK.join(held), first, len(held)))
        rows.clear(), held.clear()

    for row, text in enumerate(texts.cast(pa.binary())):
        for piece in _pieces(text.as_py() or b""):
            if held and size + len(piece) > PIECE:
                add()
                size = 0
            rows.append(row), held.append(piece)
            size += len(piece)
    if held:
        add()
    return pa.StructArray.from_arrays([pa.array(x) for x in out], names=list(COUNTERS))


@F.arrow_udf(StructType([StructField(c, LongType()) for c in COUNTERS]))
def _counters(texts: pa.Array) -> pa.Array:
    return counted(texts)


def counters(text: Column) -> Column:
    """structure.counters() of structure.rule_annotation() of a text, but for what Java and the SQL take differently: here, as in
    the SQL, U+000B is no white space, U+0001 ends a sentence, and a dotted or dotless i is in lower case what Unicode says
    of single characters."""
    return _counters(text)
