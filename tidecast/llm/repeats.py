"""Which windows of a fixed length start earlier as well: the distributed part that byte and word dedup share.

Each document is cut into stretches of consecutive windows that select one and the same content-defined symbol.  A stretch
has a key, the name of all that its windows cover.  Equal windows select equal symbols, so a symbol that one place alone
selects is done with.  Of the stretches with one symbol and key all but the first repeat whole; what is left is the first
stretch of each key, and only where its symbol has other keys as well are its single windows compared: within one task for
the stretches of a symbol, by refining buckets of their very content (same_runs), or, if these are more than HOT, by their
names across all tasks.  Every step aggregates before it joins, and copies, however many, meet as one key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.shared import discard, durable, few, release, shards
from tidecast.llm.textscan import give_back, ranges


def int_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column side by side, and where each row's begin (one more entry than rows); null counts as empty."""
    column = column.fill_null([]) if column.null_count else column
    offsets = np.asarray(column.offsets)
    return column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def covered(at: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n items lie in one of the runs [at, at + length)."""
    step = np.bincount(np.minimum(at, n), minlength=n + 1) - np.bincount(np.minimum(at + length, n), minlength=n + 1)
    return np.cumsum(step[:n]) > 0


#: Stretches that one symbol may have to be compared in one task; beyond it its windows are dealt out one by one.
HOT = 3_000
#: Bytes of stretches that one task compares.
SHARD = 500_000


def same_runs(codes: np.ndarray, sizes: np.ndarray, length: int, have: int = 1) -> np.ndarray:
    """A number for each run of length items within one content, equal for equal runs alone.

    codes has, for each place of contents side by side, an integer that stands for the have items from there on; sizes are
    the items of each content.  Buckets of places are refined by sorting them on their bucket and the bucket of the place as
    far on as the two agree so far, which doubles the depth; a bucket of a single place is left as it is, and the refined
    buckets are what the next step sorts on.
    """
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    bucket, depth = np.unique(codes, return_inverse=True)[1].astype(np.uint64), have
    used = len(codes)
    while depth < length:
        step = min(depth, length - depth)
        within = np.flatnonzero(left >= depth)
        others = np.bincount(bucket[within].astype(np.int64), minlength=used) > 1
        place = within[left[within] >= depth + step]
        place = place[others[bucket[place].astype(np.int64)]]
        finer, number = np.unique(bucket[place] << np.uint64(32) | bucket[place + step], return_inverse=True)
        bucket[place] = number.astype(np.uint64) + np.uint64(used)
        used += len(finer)
        depth += step
    return bucket[left >= length]


def _shared(numbers: np.ndarray, doc: np.ndarray, at: np.ndarray, within: bool) -> np.ndarray:
    """Which windows, in the order given, repeat an earlier one."""
    order = np.lexsort((at, doc, numbers))
    h, d = numbers[order], doc[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    out = np.zeros(len(order), bool)
    out[order] = ~new if within else d > d[head]
    return out


Windows = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def repeated(docs: DataFrame, stretches: Callable[[DataFrame], DataFrame], contents: Callable[[DataFrame], DataFrame], classes: Windows, names: Windows, within: bool, always: int | None = None) -> DataFrame:
    """(doc_id, at, n): arrays of the starts and numbers of consecutive windows that repeat an earlier one.

    stretches(docs) gives (symbol, key, doc_id, at, n, again), again for those that an earlier stretch of the same text is
    known to equal and that need no comparison; contents((doc_id, text, symbol, at, n)), with arrays, gives (symbol,
    doc_id, at, content) for each stretch.  Of a column of contents, classes() numbers all windows side by side, equal ones
    alike, and names() hashes them; both also give their number in each content.  within: an earlier start in the same
    document counts as well.  always: a symbol that is compared even if one document alone selects it.
    """
    spark = docs.sparkSession
    order: Column = F.struct("doc_id", "at") if within else F.col("doc_id")
    found = durable(stretches(docs))
    several = F.count("*") > 1 if within else F.min("doc_id") < F.max("doc_id")
    seen = found.where("not again").groupBy("symbol").agg(several.alias("s")).where("s" if always is None else f"s or symbol = {always}")
    seen = durable(seen.select("symbol"))  # a table of its own, so that the join can split a symbol of many rows
    some = durable(found.where("not again").drop("again").join(seen, "symbol"))
    within_text = durable(found.where("again").select("doc_id", "at", "n"))
    discard(found)
    discard(seen)
    release(spark)
    firsts = some.groupBy("symbol", "key").agg(F.min(order).alias("first"))
    keys = firsts.groupBy("symbol").agg(F.count("*").alias("keys")).where("keys > 1")
    firsts = durable(firsts.join(keys, "symbol", "left").select("symbol", "key", "first", F.coalesce("keys", F.lit(1)).alias("keys")))
    told = durable(some.join(firsts, ["symbol", "key"]).select("symbol", "doc_id", "at", "n", (order > F.col("first")).alias("whole"), "keys").where("whole or keys > 1"))
    discard(some)
    discard(firsts)
    release(spark)
    ask = told.where("not whole").groupBy("doc_id").agg(F.collect_list(F.struct("symbol", "at", "n", "keys")).alias("s"))
    asked = durable(told.where("not whole").select("doc_id").distinct())  # told apart first, so that only their texts are shuffled
    ask = docs.join(few(asked), "doc_id", "left_semi").join(ask, "doc_id").select("doc_id", "text", F.col("s.symbol").alias("symbol"), F.col("s.at").alias("at"), F.col("s.n").alias("n"), F.col("s.keys").alias("keys"))
    each = durable(contents(ask))
    discard(asked)
    release(spark)

    def compare(table: pa.Table) -> pa.Table:
        got, n = classes(table.column("content").combine_chunks())
        doc = np.repeat(table.column("doc_id").to_numpy(), n)
        at = ranges(table.column("at").to_numpy().astype(np.int64), n)
        again = _shared(got, doc, at, within)
        doc, at = doc[again], at[again]
        order = np.lexsort((at, doc))
        doc, at = doc[order], at[order]
        head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)])) if len(doc) else np.zeros(0, np.int64)
        runs = np.diff(np.append(head, len(doc)))
        give_back()
        return pa.table({"doc_id": doc[head], "at": at[head].astype(np.int32), "n": runs.astype(np.int32)})

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got, n = names(batch.column(3))
            at = ranges(batch.column(2).to_numpy().astype(np.int64), n)
            symbol, doc = (np.repeat(batch.column(k).to_numpy(), n) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(symbol), pa.array(got.view(np.int64)), pa.array(doc), pa.array(at.astype(np.int32))], ["symbol", "name", "doc_id", "at"])
            give_back()

    size = each.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("symbol"), F.lit(shards(size, SHARD)).cast("long")).alias("shard")
    near = each.where(F.col("keys") <= HOT).groupBy(shard).applyInArrow(compare, "doc_id long, at int, n int")
    whole = told.where("whole").select("doc_id", "at", "n").unionByName(within_text).unionByName(near)
    if not each.where(F.col("keys") > HOT).isEmpty():
        apart = durable(each.where(F.col("keys") > HOT).select("symbol", "doc_id", "at", "content").mapInArrow(explode, "symbol long, name long, doc_id long, at int"))
        first = apart.groupBy("symbol", "name").agg(F.min(order).alias("first"), F.count("*").alias("many")).where("many > 1").drop("many")
        whole = whole.unionByName(apart.join(first, ["symbol", "name"]).where(order > F.col("first")).select("doc_id", "at", F.lit(1).alias("n")))
    out = durable(whole.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("s")).select("doc_id", F.col("s.at").alias("at"), F.col("s.n").alias("n")))
    for table in (each, told, within_text):
        discard(table)
    release(spark)
    return out
