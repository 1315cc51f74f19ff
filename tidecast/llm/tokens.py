"""Token ids of whole texts by a public tokenizer, each distinct stretch between white space encoded once.

A text's ids are those that the library gives with add_special_tokens=False and no other setting: the string of a special token
in a text is that token.  They are the ids of its stretches between white space, one after the other, as the tokenizer never
joins them; a text with a control separator, on which libraries disagree, or with the string of a special token is encoded whole.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np

from tidecast.llm.textscan import ranges

#: Distinct stretches that an encoder remembers before it starts anew.
REMEMBERED = 1_000_000
#: The id that ends a document.
END = 2


def _classes() -> bytes:
    """For each byte of Latin-1 whether it is of a word, white space or another sign, as which the tokenizer counts "_"."""
    return bytes(32 if chr(c).isspace() else 97 if chr(c) != "_" and re.match(r"\w", chr(c)) else 33 for c in range(256))


#: Encoded runs of texts after which the most frequent words get a dictionary of their own, small enough for a cache.
WARM, FREQUENT = 20, 20_000
_CLASS = _classes()


def _latin(text: str) -> bytes | None:
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return None


class Encoder:
    """The word-level vocabulary, which folds case and drops white space."""

    def __init__(self, name: str = "word_bpe_49k.json"):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.separators = re.compile("[\x1c-\x1f\x85]")
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.begins = sorted({t[0] for t in added})
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)", re.IGNORECASE)
        self.model = self.tokenizer.model
        #: Letters of Latin-1 as the pre-tokenizer writes their bytes; words of these need no other step of the pipeline.
        self.written = {c: self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(c))[0][0] for c in range(256) if chr(c).isalpha() and chr(c).islower()}
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.frequent: dict[str, int] = {}
        self.uses, self.runs = np.zeros(0, np.int64), 0

    def _find(self, pieces: list[str]) -> np.ndarray:
        """The numbers of pieces, -1 for those that are not remembered."""
        if not self.frequent:
            at = np.fromiter(map(self.index.get, pieces, repeat(-1)), np.int64, len(pieces))
            used = np.bincount(at[at >= 0], minlength=len(self.uses))
            used[: len(self.uses)] += self.uses
            self.uses, self.runs = used, self.runs + 1
            if self.runs >= WARM:
                names = list(self.index)
                self.frequent = {names[k]: k for k in np.argsort(-used, kind="stable")[:FREQUENT].tolist()}
            return at
        at = np.fromiter(map(self.frequent.get, pieces, repeat(-1)), np.int64, len(pieces))
        rare = np.flatnonzero(at < 0).tolist()
        at[rare] = np.fromiter(map(self.index.get, [pieces[k] for k in rare], repeat(-1)), np.int64, len(rare))
        return at

    def _add(self, pieces: list[str]) -> None:
        found: list[list[int]] = []
        tokenize, other = self.model.tokenize, []
        for piece in pieces:
            if piece.isalpha() and piece.islower() and (piece.isascii() or _latin(piece) is not None):
                found.append([t.id for t in tokenize(piece if piece.isascii() else piece.translate(self.written))])
            else:
                other.append(len(found))
                found.append([])
        whole = self.tokenizer.encode_batch_fast([pieces[k] for k in other], add_special_tokens=False)
        for k, e in zip(other, whole, strict=True):
            found[k] = e.ids
        size = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))
        k, to = len(self.index), len(self.index) + len(pieces)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while to > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.pool[self.used : self.used + len(ids)] = ids
        self.start[k:to], self.size[k:to] = self.used + np.cumsum(size) - size, size
        self.used += len(ids)
        self.index.update(zip(pieces, range(k, to), strict=True))

    def _whole(self, text: str) -> bool:
        """Whether the library must see the whole text: control separators, or an added token's string."""
        return bool(self.separators.search(text)) or (any(c in text for c in self.begins) and bool(self.added.search(text)))

    def _pieces(self, text: str) -> list[str]:
        if self._whole(text):
            return [text]
        signs = _latin(text)
        if signs is not None:
            text = text.lower()
            if "'" not in text and b"!!" not in signs.translate(_CLASS):
                text = text.replace(".", " . ").replace(",", " , ")
        return text.split()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids side by side, with END after each text, and where each text's ids begin (one more entry than texts)."""
        collects = gc.isenabled()
        gc.disable()  # many lists, no cycles: looking through them for garbage finds none
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces: list[str] = []
        until = [0]
        for text in texts:
            pieces += self._pieces(text)
            until.append(len(pieces))
        if len(self.index) > REMEMBERED:
            self.forget()
        at = self._find(pieces)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            self._add(list(dict.fromkeys([pieces[k] for k in missing.tolist()])))
            at[missing] = [self.index[pieces[k]] for k in missing.tolist()]
        size = self.size[at]
        total = np.concatenate([[0], np.cumsum(size)])[until] + np.arange(len(until))
        ids = np.full(int(total[-1]), END, np.uint32)
        keep = np.ones(len(ids), bool)
        keep[total[1:] - 1] = False
        ids[keep] = self.pool[ranges(self.start[at], size)]
        return ids, total


class ByteEncoder(Encoder):
    """The byte-level vocabulary; texts of ASCII and Latin letters are encoded from the same vocabulary's ranks, which is
    several times as fast and gives the same ids.  All other texts go to the tokenizer itself."""

    def __init__(self, name: str = "byte_bpe_50k.json"):
        import base64

        import public_tokenizers
        import tiktoken

        super().__init__(name)
        with open(public_tokenizers.path(name.replace(".json", ".tiktoken"))) as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.rare = re.compile("[^\t\n\r -~\u00a1-\u024f]")

    def _ids(self, text: str) -> list[int]:
        whole = self.rare.search(text) or self._whole(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids if whole else self.fast.encode_ordinary(text)

    def count(self, text: str) -> int:
        """The tokens of a text, without END."""
        return len(self._ids(text))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self._ids(t) for t in texts]
        size = np.array([len(f) + 1 for f in found], np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        ids = np.empty(int(total[-1]), np.uint32)
        for f, at in zip(found, total.tolist(), strict=False):
            ids[at : at + len(f)] = f
        ids[total[1:] - 1] = END
        return ids, total


def batches(texts: list[str], limit: int = 1 << 19) -> Iterator[slice]:
    """Runs of texts of about limit characters."""
    at = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield slice(at, k + 1)
            at, size = k + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))
