"""Token ids in files, compressed by Re-Pair grammars.

Documents go to shards by ranges of doc_id; a shard's file holds its documents in ascending order in blocks of BLOCK ids or
little more.  Each block has a grammar of its own: rounds count the pairs of adjacent symbols, name the most frequent ones as
nonterminals and replace them, until no pair is frequent enough.  Pairs never cross documents, so that a document is a run
of symbols.  A block stores the rules, each rule's expansion length, the symbols, and for each
document its id, the place of its first symbol and its number of ids: a document, or any range of it, is decoded from its own
symbols alone by their expansion lengths.

The files are rows of a Parquet table (path/*.parquet; one row is one block, `payload` its bytes, with its shard, its number in
the shard and the ids of the shard before it): Spark commits them, so that a lost executor's files are written again, and any
store that Spark can write to can hold them.  Reading needs the ids of each shard only to place its blocks, and no payload moves.

Defined cases: null and empty texts are their end id; rows without a doc_id take no part; rows that repeat a doc_id are all kept, by
their texts; an empty table gives no blocks; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast.llm.shared import durable, folder, texts_of
from tidecast.llm.textscan import ranges
from tidecast.llm.tokens import Encoder, batches

BLOCK = 400_000
#: Names of a round, and how often a pair must occur to be named.
NAMES, LEAST = 8192, 16
MAGIC, VOCABULARY = b"TGRM", 49_408
#: Shards (some 20 bytes each) up to which their first ids are broadcast to the blocks.
SHARDS = 1_000_000
_BINS = 18
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
_encoders: dict[str, Encoder] = {}


def _encoder() -> Encoder:
    if "word" not in _encoders:
        _encoders["word"] = Encoder()
    return _encoders["word"]


def _frequent(symbols: np.ndarray, cross: np.ndarray, names: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules of the most frequent pairs, the places of these pairs, and the number of the pair at each of them; cross are the
    places of pairs of two documents, which count for nothing.

    Pairs are counted by bins of their hash; a bin stands for the pair that it holds at its last place, and other pairs that
    share a bin with a frequent one wait for a later round.
    """
    bins = symbols[:-1] * np.uint32(0x9E3779B1)
    bins ^= symbols[1:] * np.uint32(0x85EBCA77)
    bins >>= np.uint32(32 - _BINS)
    bins = bins.astype(np.int64)
    bins[cross] = 1 << _BINS
    count = np.bincount(bins, minlength=(1 << _BINS) + 1)[:-1]
    top = np.flatnonzero(count >= least)
    if len(top) > names:
        top = top[count[top] >= np.partition(count[top], -names)[-names]][: 2 * names]
    if not len(top):
        return np.zeros((0, 2), np.uint32), top, top
    rank = np.full((1 << _BINS) + 1, -1, np.int32)
    rank[top] = np.arange(len(top))
    number = rank[bins]
    place = np.flatnonzero(number >= 0)
    number = number[place]
    pair = (symbols[place].astype(np.uint64) << np.uint64(32)) | symbols[place + 1]
    rules = np.zeros(len(top), np.uint64)
    rules[number] = pair
    own = rules[number] == pair
    return np.stack([rules >> np.uint64(32), rules & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32), place[own], number[own]


def compress(ids: np.ndarray, first: np.ndarray, names: int = NAMES, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (two symbols each; rule k is symbol VOCABULARY + k), symbols, and the first symbol of each document."""
    symbols, at, rules = ids.astype(np.uint32), first.astype(np.int64), []
    made = 0
    while len(symbols) > 1:  # every round but the last one takes a symbol away at least
        found, place, number = _frequent(symbols, at[(at > 0) & (at < len(symbols))] - 1, names, least)
        if not len(place):
            break
        near = place[1:] == place[:-1] + 1
        if near.any():
            begin = np.concatenate([[True], ~near])
            since = np.arange(len(place)) - np.maximum.accumulate(np.where(begin, np.arange(len(place)), 0))
            free = since % 2 == 0  # of overlapping places every other one
            place, number = place[free], number[free]
        keep = np.ones(len(symbols), bool)
        keep[place + 1] = False
        symbols[place] = (VOCABULARY + made + number).astype(np.uint32)
        at = at - np.searchsorted(place, at - 1)
        symbols = symbols[keep]
        rules.append(found)
        made += len(found)
    return np.concatenate([*rules, np.zeros((0, 2), np.uint32)]), symbols, at


def levels(rules: np.ndarray) -> np.ndarray:
    """Where runs of rules begin whose symbols all stand before their run; the last entry is the number of rules."""
    last, cuts, at = rules.astype(np.int64).max(axis=1, initial=0) - VOCABULARY, [0], 0
    while at < len(rules):
        late = np.flatnonzero(last[at:] >= at)
        at = at + int(late[0]) if len(late) else len(rules)
        cuts.append(at)
    return np.array(cuts)


def expansions(rules: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All symbols' ids side by side, where each symbol's begin, and their number."""
    pool, start, size = [np.arange(VOCABULARY, dtype=np.uint32)], np.arange(VOCABULARY), np.ones(VOCABULARY, np.int64)
    for a, b in zip(levels(rules)[:-1], levels(rules)[1:], strict=True):
        both = rules[a:b].astype(np.int64).ravel()
        pool.append(np.concatenate(pool)[ranges(start[both], size[both])])
        made = size[both].reshape(-1, 2).sum(axis=1)
        start = np.concatenate([start, start[-1] + size[-1] + np.cumsum(made) - made])
        size = np.concatenate([size, made])
        pool = [np.concatenate(pool)]
    return np.concatenate(pool), start, size


def write_block(docs: np.ndarray, ids: np.ndarray, first: np.ndarray) -> bytes:
    """The bytes of a block: docs and the beginnings of their ids (one more entry than docs)."""
    rules, symbols, at = compress(ids, first)
    size = expansions(rules)[2][VOCABULARY:]
    wide = VOCABULARY + len(rules) > 1 << 16
    head = MAGIC + struct.pack("<BIII", wide, len(docs), len(rules), len(symbols))
    return b"".join([head, docs.astype("<i8").tobytes(), np.diff(first).astype("<u4").tobytes(), at.astype("<u4").tobytes(), rules.astype("<u4").tobytes(), size.astype("<u4").tobytes(), symbols.astype("<u4" if wide else "<u2").tobytes()])


class Block:
    """A block, read: documents are decoded one by one or all together."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        wide, n, rules, symbols = struct.unpack_from("<BIII", payload, 4)
        place = 4 + struct.calcsize("<BIII")

        def read(kind: str, count: int) -> np.ndarray:
            nonlocal place
            got = np.frombuffer(payload, kind, count, place)
            place += got.nbytes
            return got

        self.docs, self.size, self.at = read("<i8", n), read("<u4", n).astype(np.int64), read("<u4", n + 1).astype(np.int64)
        self.rules, self.lengths = read("<u4", 2 * rules).reshape(-1, 2), read("<u4", rules).astype(np.int64)
        self.symbols = read("<u4" if wide else "<u2", symbols).astype(np.int64)
        self.pool, self.start, self.length = expansions(self.rules)
        self.length[VOCABULARY:] = self.lengths

    def ids(self) -> np.ndarray:
        return self.pool[ranges(self.start[self.symbols], self.length[self.symbols])]

    def document(self, k: int, begin: int = 0, end: int | None = None) -> np.ndarray:
        """The ids [begin, end) of the k-th document, from no more symbols than cover them."""
        own = self.symbols[self.at[k] : self.at[k + 1]]
        until = np.cumsum(self.length[own])
        end = int(self.size[k]) if end is None else min(end, int(self.size[k]))
        low, high = int(np.searchsorted(until, begin, side="right")), int(np.searchsorted(until, end)) + 1
        some = own[low:high]
        skipped = int(until[low - 1]) if low else 0
        return self.pool[ranges(self.start[some], self.length[some])][begin - skipped : max(end, begin) - skipped]


def write(documents: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Writes the ids of all documents, in ascending order of doc_id, to the files of path."""
    docs = texts_of(documents, id_column, text_column).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def fill(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = _encoder(), TaskContext.get().partitionId()
        made = before = 0
        names: list[np.ndarray] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            nonlocal made, before
            docs, ids = np.concatenate(names), np.concatenate(held)
            payload = write_block(docs, ids, np.concatenate([[0], np.cumsum(np.concatenate(sizes))]))
            for kept in (names, held, sizes):
                kept.clear()
            row = (shard, made, int(docs[0]), before, len(ids), payload)
            made, before = made + 1, before + len(ids)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _KINDS, strict=True)], ["shard", "block", "first_doc", "before", "n_ids", "payload"])

        for batch in found:
            texts, docs = batch.column(1).to_pylist(), batch.column(0).to_numpy()
            for some in batches(texts):
                ids, total = encoder.encode(texts[some])
                names.append(docs[some])
                held.append(ids)
                sizes.append(np.diff(total))
                if sum(map(len, held)) >= BLOCK:
                    yield block()
        if names:
            yield block()

    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(fill, "shard int, block int, first_doc long, before long, n_ids long, payload binary").write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; start counts the ids of all before it."""
    blocks = spark.read.parquet(path)
    shards = durable(blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")))  # a row for each writing task, which the files' order tells
    first = shards.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    first = F.broadcast(first) if shards.count() <= SHARDS else first
    found = blocks.join(first, "shard").select("payload", (F.col("first") + F.col("before")).alias("before"))

    def digest(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for payload, before in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                block = Block(payload.as_py())
                until = np.concatenate([[0], np.cumsum(block.size)])
                ids = block.ids().astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(until[:-1].tolist(), until[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(block.docs), pa.array(before + until[:-1]), pa.array(block.size), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return found.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_and_read(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the files (to the shared folder, if no path is given) and reads them back."""
    spark = documents.sparkSession
    path = path or f"{folder(spark)}/token-ids-{uuid.uuid4().hex}"
    write(documents, path)
    return read(spark, path)
