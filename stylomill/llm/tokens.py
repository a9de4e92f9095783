"""Token ids of whole texts by a public tokenizer file.

Most texts are encoded by their white-space separated pieces, which a bounded memory of pieces met before serves; the
tokenizer itself encodes every new word.  That holds for tokenizers that drop white space, lower-case each character by
itself and encode words apart, and for texts of the characters named in PLAIN; any other text goes to the tokenizer whole.
"""

from __future__ import annotations

import json
import os
import re
from itertools import islice

import numpy as np
import regex

#: Characters that normalisation leaves alone (but for case) and that no two versions of Unicode class differently.
ODD = bytes(x for x in range(256) if x not in (9, 10, 13, *range(32, 127), *range(161, 173), *range(174, 256)))
PLAIN = re.compile("[\t\n\r -~¡-¬®-įı-ɏ‐-‧]*")
#: Marks that make a token of their own after a word.
ENDS = frozenset(".,;:!?")
#: Pieces that a worker remembers, and words as a share of them.
REMEMBERED = 500_000
WORD_SHARE = 1.4
DEFAULT = "word_bpe_49k.json"

_encoders: dict[str, Encoder] = {}


def plain(text: str) -> bool:
    """Whether the text holds only characters of PLAIN; most texts are found out by their Latin-1 bytes."""
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return PLAIN.fullmatch(text) is not None
    return len(data.translate(None, ODD)) == len(data)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT)


class Grown:
    """An array that grows by doubling."""

    def __init__(self, kind: str):
        self.data, self.n = np.empty(1 << 16, kind), 0

    def add(self, more: np.ndarray) -> None:
        while self.n + len(more) > len(self.data):
            self.data = np.concatenate([self.data, np.empty_like(self.data)])
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)


class Numbered(dict):
    """Pieces by number; a new one gets the next number and waits in `new`."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.pattern = self.word_pattern()
        said = json.loads(self.tokenizer.to_str())
        suffix = said["model"].get("end_of_word_suffix")
        if self.pattern:  # the same model for words that are normal already
            self.bare = Tokenizer.from_str(json.dumps(said | {"normalizer": None, "added_tokens": [], "pre_tokenizer": said["pre_tokenizer"]["pretokenizers"][1]}))
        self.ends = np.zeros(self.size, bool)
        if suffix:
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.remembered = REMEMBERED
        self.forget()

    def word_pattern(self) -> regex.Pattern | None:
        """The pattern of words, where the file says that white space falls away, case is folded and words stand alone."""
        said = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (said["normalizer"] or {}).get("normalizers", [])]
        split = (said["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        if steps != ["NFC", "Replace", "Lowercase"] or split.get("behavior") != "Removed" or not split.get("invert") or not said["model"].get("end_of_word_suffix"):
            return None
        return regex.compile(split["pattern"]["Regex"])

    def forget(self) -> None:
        self.known = Numbered()
        self.words: dict[str, bytes] = {}
        self.flat, self.start, self.length = Grown("<u4"), Grown("int64"), Grown("int64")

    def shrink(self) -> None:
        """Forgets all but the first half of what is remembered; frequent pieces were met early."""
        n = min(len(self.known), self.remembered // 2)
        first, self.known = self.known, Numbered()
        self.known.update(islice(first.items(), n))
        self.start.n = self.length.n = n
        self.flat.n = int(self.start.data[n - 1] + self.length.data[n - 1]) if n else 0

    @classmethod
    def of(cls, path: str, remembered: int = REMEMBERED) -> Encoder:
        """The worker's encoder, which is to remember so many pieces."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        _encoders[path].remembered = remembered
        return _encoders[path]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[str]) -> None:
        """Encodes new pieces: their words go through the model in one call and part at the ids that end a word."""
        parts = [[x] if x.isalpha() else [x[:-1], x[-1]] if x[-1] in ENDS and x[:-1].isalpha() else self.pattern.findall(x) for x in pieces]
        if len(self.words) > WORD_SHARE * self.remembered:
            self.words = dict(islice(self.words.items(), int(WORD_SHARE * self.remembered / 2)))
        order = list(set().union(*parts).difference(self.words))
        for at in range(0, len(order), 4096):
            words = order[at : at + 4096]
            ids = np.array(self.bare.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(words) and cut[-1] == len(ids):
                data, edges = ids.tobytes(), [0, *(4 * cut).tolist()]
                self.words.update((w, data[i:j]) for w, i, j in zip(words, edges, edges[1:], strict=False))
            else:
                self.words.update(zip(words, self.whole(words), strict=True))
        encoded = [b"".join(map(self.words.__getitem__, x)) for x in parts]
        length = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        self.start.add(self.flat.n + np.cumsum(length) - length)
        self.length.add(length)
        self.flat.add(np.frombuffer(b"".join(encoded), "<u4"))

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        if not self.pattern:
            return self.whole(texts)
        if len(self.known) > self.remembered:
            self.shrink()
        numbers, number = [], self.known.__getitem__
        for t in texts:
            if plain(t) and not any(s in t for s in self.special):
                pieces = t.lower().split()
                numbers.append(np.fromiter(map(number, pieces), np.int64, len(pieces)))
            else:
                numbers.append(None)
        if self.known.new:
            self.learn(self.known.new)
            self.known.new = []
        at = np.concatenate([np.empty(0, np.int64), *(x for x in numbers if x is not None)])
        length = self.length.data[at]
        before = np.cumsum(length) - length
        data = self.flat.data[np.repeat(self.start.data[at] - before, length) + np.arange(length.sum())].tobytes()
        edges = iter((np.r_[before, length.sum()][np.cumsum([0, *(len(x) for x in numbers if x is not None)])] * 4).tolist())
        begin, out = next(edges), []
        for t, x in zip(texts, numbers, strict=True):
            if x is None:
                out += self.whole([t])
            else:
                end = next(edges)
                out.append(data[begin:end])
                begin = end
        return out
