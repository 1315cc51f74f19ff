"""Substring dedup over words by recompression.

Every text is rewritten in rounds: first each maximal run of one word becomes a single symbol, then rounds name adjacent
pairs whose left symbol falls in the one half and whose right symbol in the other half of a random split of all symbols.
A name is the 64-bit hash of what it stands for, so that names are global without a dictionary that would have to be
gathered, and the rounds need no exchange between texts.  Whether two neighbours are joined depends on the two alone, so equal
word sequences get equal symbols except near their ends: with pair symbols of at most MOST_WORDS words, after ROUNDS rounds all
that lies LOST words from either end.  A last round names each symbol together with the LOST words on either side of it.

Each window of the asked length selects the smallest of these high-level names in its interior, which equal windows share; Spark
finds the names that several documents select.  All other windows cannot repeat.  Stretches of windows that select one name
are verified as a whole by the names of their first and last window, and where that does not settle them by their very words,
numbered and refined by doubling (module repeats).  A window whose interior has no whole symbol (long runs) is always verified.

Defined cases: null and empty texts have no words and nothing is removed; texts shorter than the window keep all their words;
repeated rows of a doc_id count as one document each, neither removes from the other; rows without a doc_id take no part, strip_repeats
leaves them as they are; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm import textscan
from tidecast.llm.repeats import covered, int_lists, repeated, same_runs
from tidecast.llm.shared import IDS, texts_of

#: Rounds of pair naming, the words a named pair may have, and the words at either end whose symbols may differ.
ROUNDS, MOST_WORDS = 4, 9
LOST = 1 + sum(2**k for k in range(ROUNDS))
_RUN, _LEFT = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9FB21C651E98DF25)
#: The symbol of windows whose interior holds no whole symbol.
ANY = np.uint64(0)


def recompress(hashes: np.ndarray, first: np.ndarray, rounds: int = ROUNDS, most: int = MOST_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts side by side (first: the first word of each), and the word at which each symbol starts."""
    head = np.zeros(len(hashes) + 1, bool)
    head[first] = True
    head = head[:-1]
    fresh = head.copy()
    fresh[1:] |= hashes[1:] != hashes[:-1]
    at = np.flatnonzero(fresh)
    size = np.diff(np.append(at, len(hashes)))
    fixed = size > 1
    symbol = np.where(fixed, textscan.mix(hashes[at] ^ _RUN), hashes[at])
    for k in range(rounds):
        right = (textscan.mix(symbol + np.uint64(k + 1)) & np.uint64(1)).astype(bool)
        join = np.zeros(len(symbol), bool)
        join[:-1] = ~right[:-1] & right[1:] & ~fixed[:-1] & ~fixed[1:] & ~head[at[1:]] & (size[:-1] + size[1:] <= most)
        i = np.flatnonzero(join)
        symbol = symbol.copy()
        symbol[i] = textscan.mix(symbol[i] * _LEFT + textscan.mix(symbol[i + 1]))
        size = size.copy()
        size[i] += size[i + 1]
        keep = np.ones(len(symbol), bool)
        keep[i + 1] = False
        symbol, size, fixed, at = symbol[keep], size[keep], fixed[keep], at[keep]
    return np.maximum(symbol, np.uint64(1)), at


def selected(hashes: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The word at which each window starts, and the symbol that it selects."""
    counts = np.maximum(np.diff(first) - window + 1, 0)
    start = textscan.ranges(first[:-1], counts)
    if not len(start):
        return start, np.zeros(0, np.uint64)
    symbol, at = recompress(hashes, first)
    end = np.append(at[1:], len(hashes))
    # the last round: a window holds LOST words on either side of the symbols of its interior, and names with these are rarer
    beside = textscan.run_names(hashes, LOST)
    inside = np.flatnonzero((at >= LOST) & (end + LOST <= len(hashes)))
    symbol[inside] = np.maximum(textscan.join(textscan.join(beside[at[inside] - LOST], symbol[inside]), beside[end[inside]]), np.uint64(1))
    word = np.arange(len(hashes) + 1)
    low = np.searchsorted(at, word)[start + LOST]  # the first symbol that starts there or later
    high = np.searchsorted(end, word, side="right")[start + window - LOST]  # one past the last symbol that ends there or sooner
    width = np.maximum(high - low, 0)
    levels = [symbol]
    while (1 << len(levels)) <= int(width.max(initial=1)):
        half, top = 1 << (len(levels) - 1), levels[-1]
        level = top.copy()
        level[:-half] = np.minimum(top[:-half], top[half:])
        levels.append(level)
    got = np.full(len(start), ANY, np.uint64)
    level = np.zeros(int(width.max(initial=1)) + 1, np.int64)
    for k in range(1, len(level)):
        level[k] = k.bit_length() - 1
    of = level[width]
    for k in range(len(levels)):
        w = np.flatnonzero((of == k) & (width > 0))
        got[w] = np.minimum(levels[k][low[w]], levels[k][high[w] - (1 << k)])
    return start, got


def _stretches(docs: DataFrame, window: int) -> DataFrame:
    """(symbol, key, doc_id, at, n, again): the runs of windows of a document that select one symbol."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in textscan.texts(batch):
                starts, ends, first = part.words()
                hashes = part.word_hashes(starts, ends)
                start, symbol = selected(hashes, first, window)
                if not len(start):
                    continue
                doc = np.searchsorted(first, start, side="right") - 1
                head = np.flatnonzero(np.concatenate([[True], (symbol[1:] != symbol[:-1]) | (doc[1:] != doc[:-1])]))
                n = np.diff(np.append(head, len(start)))
                parts = -(-n // window)  # of a longer stretch the first and last window would not tell all
                head = textscan.ranges(head // window, parts) * window + np.repeat(head % window, parts)
                n = np.diff(np.append(head, len(start)))
                at, doc = start[head], doc[head]
                covers = textscan.run_names(hashes, window)
                key = textscan.join(textscan.join(covers[at], covers[at + n - 1]), n.astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(symbol[head].view(np.int64)), pa.array(key.view(np.int64)), pa.array(part.ids[doc]), pa.array((at - first[doc]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(np.zeros(len(at), bool))], ["symbol", "key", "doc_id", "at", "n", "again"])
            textscan.give_back()

    return docs.mapInArrow(scan, "symbol long, key long, doc_id long, at int, n int, again boolean")


def _contents(docs: DataFrame, window: int) -> DataFrame:
    """(symbol, keys, doc_id, at, content): the bytes from the first to the last word that the windows of each stretch cover."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbol, cut = int_lists(batch.column(2))
            at, n, keys = (int_lists(batch.column(k))[0] for k in (3, 4, 5))
            for rows, part in textscan.texts(batch):
                starts, ends, first = part.words()
                mine = slice(cut[rows.start], cut[rows.stop])
                doc = np.repeat(np.arange(len(part)), np.diff(cut[rows.start : rows.stop + 1]))
                begin = first[doc] + at[mine]
                end = begin + n[mine] + window - 1
                inside = end <= first[doc + 1]  # rows that repeat a doc_id with another text
                content = textscan.slices(part.data, starts[begin[inside]], ends[end[inside] - 1])
                yield pa.RecordBatch.from_arrays([pa.array(symbol[mine][inside]), pa.array(keys[mine][inside]), pa.array(part.ids[doc[inside]]), pa.array(at[mine][inside]), content], ["symbol", "keys", "doc_id", "at", "content"])
            textscan.give_back()

    return docs.mapInArrow(scan, "symbol long, keys long, doc_id long, at int, content binary")


def _words(contents: pa.Array) -> tuple[textscan.Texts, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = textscan.column_bytes(contents)
    part = textscan.Texts(offsets[:-1], data, offsets)
    return part, *part.words()


def _classes(contents: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray]:
    part, starts, ends, first = _words(contents)
    raw, numbers = part.data.tobytes(), {}
    codes = np.fromiter((numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(starts))
    return same_runs(codes, np.diff(first), window), np.diff(first) - window + 1


def _names(contents: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray]:
    part, starts, ends, first = _words(contents)
    n = np.diff(first) - window + 1
    return textscan.run_names(part.word_hashes(starts, ends), window)[textscan.ranges(first[:-1], n)], n


def _kept(part: textscan.Texts, rows: slice, marks: tuple[np.ndarray, ...], window: int) -> Iterator[tuple[int, int, bytes]]:
    """n_words, n_removed and the words that stay, joined by one space, of each text."""
    at, many, cut = marks
    starts, ends, first = part.words()
    raw = part.data.tobytes()
    for k in range(len(part)):
        s, e = starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]]
        mine = slice(cut[rows.start + k], cut[rows.start + k + 1])
        if mine.stop > mine.start:
            stay = ~covered(at[mine], many[mine] + window - 1, len(s))
            s, e = s[stay], e[stay]
        n = int(first[k + 1] - first[k])
        yield n, n - len(s), b" ".join([raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)])


def _marks(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, ...]:
    starts, cut = int_lists(batch.column(at))
    return starts, int_lists(batch.column(at + 1))[0], cut


def find_repeats(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, at, n): the starts and numbers of consecutive windows to remove."""
    return repeated(docs, lambda d: _stretches(d, window), lambda d: _contents(d, window), lambda c: _classes(c, window), lambda c: _names(c, window), within=False, always=int(ANY))


def remove_repeats(documents: DataFrame, window: int = 50, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row."""
    docs = texts_of(documents, id_column, text_column)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = _marks(batch, 2)
            for rows, part in textscan.texts(batch):
                out = [(n, gone, hashlib.sha256(kept).hexdigest()) for n, gone, kept in _kept(part, rows, marks, window)]
                yield pa.RecordBatch.from_arrays([pa.array(part.ids), *(pa.array(c) for c in zip(*out, strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    marked = docs.join(find_repeats(docs, window), "doc_id", "left").select("doc_id", "text", "at", "n")
    return marked.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def strip_repeats(documents: DataFrame, window: int = 50, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """documents with all their columns; texts that lose words become the words that stay, joined by one space."""
    docs = texts_of(documents, id_column, text_column)
    names = [f"c{k}" for k in range(len(documents.columns))]
    marks = find_repeats(docs, window).select(F.col("doc_id").alias("marked"), F.col("at").alias("m0"), F.col("n").alias("m1"))
    plain = documents.toDF(*names)
    key, text = names[documents.columns.index(id_column)], documents.columns.index(text_column)
    own, arrays = plain[key].cast("long"), {"m0": F.lit(None).cast("array<int>"), "m1": F.lit(None).cast("array<int>")}
    if marks.count() <= IDS:  # only texts that lose words are shuffled to meet their marks
        ids = F.broadcast(marks.select(F.col("marked").alias("chosen")))
        whole = plain.join(ids, own == F.col("chosen"), "left_anti").withColumns(arrays)
        joined = plain.join(ids, own == F.col("chosen"), "left_semi").join(marks, own == F.col("marked")).select(*names, "m0", "m1").unionByName(whole)
    else:
        joined = plain.join(marks, own == F.col("marked"), "left").select(*names, "m0", "m1")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, texts = _marks(batch, len(names)), batch.column(text).to_pylist()
            pair = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(text)], ["k", "text"])
            for rows, part in textscan.texts(pair):
                for k, (_, gone, kept) in zip(part.ids, _kept(part, rows, marks, window), strict=True):
                    if gone:
                        texts[k] = kept.decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == text else batch.column(k) for k in range(len(names))], names)
            del marks, texts, pair
            textscan.give_back()

    return joined.mapInArrow(strip, plain.schema).toDF(*documents.columns)
