"""Best-fit packing by sum of squares.

Documents become token ids; only documents longer than a sequence are cut, so that their first piece takes what is left over.
Pieces are dealt at random to shards of about SHARD pieces, and each shard places its pieces from the longest to the
shortest: of the open bins with room, a piece goes to the residual gap that leaves the sum of the squared counts of open bins
per gap smallest (the smaller gap if equal); it opens a bin only if no open one has room.  Bins with one gap are alike, so
that a shard needs a count per gap and not a search over bins.

Defined cases: a null or empty text is its end id alone; a document of exactly the length is one whole piece; equal pieces
are placed by doc_id and piece number; rows that repeat a doc_id are pieces like any other; rows without one take no part;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.shared import durable, shards, texts_of
from tidecast.llm.tokens import ByteEncoder, batches

LENGTH, SHARD = 1024, 50_000
_encoders: dict[str, ByteEncoder] = {}


def _encoder() -> ByteEncoder:
    if "byte" not in _encoders:
        _encoders["byte"] = ByteEncoder()
    return _encoders["byte"]


def pieces(documents: DataFrame, length: int = LENGTH, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32 [, ids]) for each piece of each document."""

    def cut(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder()
        for batch in found:
            docs = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for some in batches(texts):
                ids, total = encoder.encode(texts[some])
                out = []
                for doc, a, b in zip(docs[some], total[:-1].tolist(), total[1:].tolist(), strict=True):
                    ends = [*range(a + ((b - a - 1) % length + 1), b, length), b]
                    for k, (x, y) in enumerate(zip([a, *ends], ends, strict=False)):
                        raw = ids[x:y].tobytes()
                        out.append((doc, k, x - a, y - x, zlib.crc32(raw), raw if with_ids else None))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    docs = texts_of(documents, id_column, text_column)
    cut_up = docs.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    return cut_up if with_ids else cut_up.drop("ids")


def place(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each size and its offset there, for sizes from the longest to the shortest."""
    count = np.zeros(length + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(length + 1)]
    bins, offsets, used = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    never = np.iinfo(np.int64).max
    for k, size in enumerate(sizes.tolist()):
        have = count[size:]
        after = 2 * count[: length + 1 - size] + 1
        after[0] = 0  # a full bin has no gap
        cost = np.where(have > 0, after - 2 * have + 1, never)
        left = int(cost.argmin())
        if have[left] > 0:
            count[size + left] -= 1
            bins[k] = open_bins[size + left].pop()
        else:
            left, bins[k], used = length - size, used, used + 1
        offsets[k] = length - left - size
        if left:
            count[left] += 1
            open_bins[left].append(int(bins[k]))
    return bins, offsets


def pack(found: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """found with sequence_id and offset for each piece."""
    n = shards(found.count(), shard)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = place(table.column("length").to_numpy(), length)
        table = table.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return table.append_column("sequence_id", pa.array(bins * n + key[0].as_py())).append_column("offset", pa.array(offsets))

    dealt = found.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n).cast("long")))
    return dealt.groupBy("shard").applyInArrow(fill, schema)


def pack_documents(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of all documents."""
    return pack(durable(pieces(documents, length)), length)
