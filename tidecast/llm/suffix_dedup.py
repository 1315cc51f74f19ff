"""Dedup over bytes by bucket-pointer refinement of suffixes, as far as the length asked for.

Suffixes need to be sorted by their first LENGTH bytes only.  Their initial buckets are q-grams of eight bytes; a bucket is
refined by the buckets of the places as far on as its suffixes agree so far, 8, 16, 32, ... bytes, and each refinement is what
the next one sorts on.  This runs twice.  The first time it runs over each whole text, where sorted numbers of buckets are not
known across tasks and names (hashes of the two buckets that refine) stand for them: a window's anchor is the Q-byte bucket of
smallest name that starts in it, which equal windows share.  Windows of one anchor are brought together; a stretch of
consecutive windows that all repeats is told by the names of its first and last window's buckets.  The second time, for the
stretches that differ, it runs over their bytes, with buckets sorted and numbered exactly (repeats.same_runs); an anchor with
more than repeats.HOT different stretches is dealt out window by window, by the names of the windows' buckets.

Defined cases: null and empty texts have no bytes; texts shorter than the length keep theirs; the first of several equal
windows stays, by doc_id and then by its start; rows that repeat a doc_id are one document; rows without one
take no part; other columns are ignored.
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
from tidecast.llm.shared import texts_of

#: Bytes of the buckets that anchor windows.
Q = 32


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values."""
    got, have = values, 1
    while 2 * have <= width:
        got, have = np.minimum(got[:-have], got[have:]), 2 * have
    return np.minimum(got[: len(got) - (width - have)], got[width - have :]) if width > have else got


def _stretches(docs: DataFrame, length: int) -> DataFrame:
    """(symbol, key, doc_id, at, n, again): the runs of windows that share a smallest initial bucket."""
    q = min(Q, length)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in textscan.texts(batch):
                size = np.diff(part.offsets)
                if not len(part.data) or size.max() < length:
                    continue
                bucket = textscan.byte_names(part.data, q)
                window = textscan.run_names(bucket, length, q)
                least = sliding_least(bucket, length - q + 1)
                head = np.zeros(len(least) + 1, bool)
                head[0] = True
                head[1:-1] = (least[1:] != least[:-1]) | (bucket[: len(least) - 1] == least[:-1])  # the first of equal starts counts
                inside = size >= length
                head[part.offsets[:-1][inside]] = True
                head[part.offsets[1:][inside] - length + 1] = True  # windows that would cross into the next text
                at = np.flatnonzero(head[:-1])
                n = np.diff(np.append(at, len(least)))
                doc = np.searchsorted(part.offsets, at, side="right") - 1
                own = at + length <= part.offsets[doc + 1]
                at, n, doc = at[own], n[own], doc[own]
                symbol = least[at]
                key = textscan.join(textscan.join(window[at], window[at + n - 1]), n.astype(np.uint64))
                order = np.lexsort((at, key, doc))  # periodic texts hold one stretch very often
                again = np.zeros(len(at), bool)
                again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(symbol.view(np.int64)), pa.array(key.view(np.int64)), pa.array(part.ids[doc]), pa.array((at - part.offsets[doc]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(again)], ["symbol", "key", "doc_id", "at", "n", "again"])

    return docs.mapInArrow(scan, "symbol long, key long, doc_id long, at int, n int, again boolean")


def _contents(docs: DataFrame, length: int) -> DataFrame:
    """(symbol, keys, doc_id, at, content): the bytes that the windows of each stretch cover."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbol, cut = int_lists(batch.column(2))
            at, n, keys = (int_lists(batch.column(k))[0] for k in (3, 4, 5))
            for rows, part in textscan.texts(batch):
                mine = slice(cut[rows.start], cut[rows.stop])
                doc = np.repeat(np.arange(len(part)), np.diff(cut[rows.start : rows.stop + 1]))
                begin = part.offsets[doc] + at[mine]
                end = begin + n[mine] + length - 1
                inside = end <= part.offsets[doc + 1]  # rows that repeat a doc_id with another text
                content = textscan.slices(part.data, begin[inside], end[inside])
                yield pa.RecordBatch.from_arrays([pa.array(symbol[mine][inside]), pa.array(keys[mine][inside]), pa.array(part.ids[doc[inside]]), pa.array(at[mine][inside]), content], ["symbol", "keys", "doc_id", "at", "content"])

    return docs.mapInArrow(scan, "symbol long, keys long, doc_id long, at int, content binary")


def _classes(contents: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = textscan.column_bytes(contents)
    size, q = np.diff(offsets), min(length, 8)
    return same_runs(textscan.eights(data)[: len(data)] & textscan.MASK[q], size, length, q), size - length + 1


def _names(contents: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = textscan.column_bytes(contents)
    n = np.diff(offsets) - length + 1
    return textscan.byte_names(data, length)[textscan.ranges(offsets[:-1], n)], n


def _cut(docs: DataFrame, length: int, with_bytes: bool) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, lists = int_lists(batch.column(2))
            many, _ = int_lists(batch.column(3))
            for rows, part in textscan.texts(batch):
                out = []
                for k in range(len(part)):
                    own = part.data[part.offsets[k] : part.offsets[k + 1]]
                    mine = slice(lists[rows.start + k], lists[rows.start + k + 1])
                    n, removed, spans = len(own), 0, 0
                    if mine.stop > mine.start:
                        gone = covered(at[mine], many[mine] + length - 1, n)
                        removed, spans = int(gone.sum()), int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
                        own = own[~gone]
                    kept = own.tobytes()
                    out.append((int(part.ids[k]), n, removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    found = docs.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return found if with_bytes else found.drop("kept")


def remove_repeats(documents: DataFrame, length: int = 100, with_bytes: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256 [, kept]) for every row."""
    docs = texts_of(documents, id_column, text_column)
    marks = repeated(docs, lambda d: _stretches(d, length), lambda d: _contents(d, length), lambda c: _classes(c, length), lambda c: _names(c, length), within=True)
    return _cut(docs.join(marks, "doc_id", "left").select("doc_id", "text", "at", "n"), length, with_bytes)
