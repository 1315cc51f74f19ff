"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions alone.

An item's windows are its runs of WINDOW consecutive words (a shorter item is one window).  Windows and documents are sets
of shingles of three words with their positions.  As a window must be contained whole, one shingle is a sufficient prefix:
the one that is rarest over all documents.  Documents meet windows on that shingle; the positional bound keeps starts that
leave room before and after, the length bound needs as many matched shingles as the window has, and what is left is verified
by the shingles at each of its positions, which are joined words and not hashes.

The shingles of all items are broadcast only while their count is below BROADCAST; beyond it the join shuffles.

Defined cases: null and empty texts have no words, no hits and no items; items without words occur nowhere; equal items each
count; repeated rows of a doc_id or item_id count once for hits and items; rows
without a doc_id take no part; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.shared import discard, durable, release, texts_of

WINDOW, SHINGLE = 10, 3
#: Distinct item shingles (some 40 bytes each) up to which they are broadcast.
BROADCAST = 200_000
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A-Z folded; null for a null text."""
    parts = F.split(F.translate(text, _UPPER, _LOWER), _GAPS)
    return F.filter(parts, lambda w: w != "")


def _shingle(size: int) -> Column:
    """The shingle of size words at the row's pos, from the row's words; null where too few are left."""
    parts = [F.get("words", F.col("pos") + k) for k in range(size)]
    return F.when(F.size("words") >= F.col("pos") + size, F.concat_ws(" ", *parts) if size > 1 else parts[0])


def item_windows(items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(win, len, size, k, shingle) for each shingle of each distinct window, and (item_id, win)."""
    found = items.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    found = found.select("item_id", "words", F.explode(starts).alias("at"))
    found = found.select("item_id", F.slice("words", F.col("at") + 1, F.lit(window)).alias("words"))
    found = found.select("item_id", F.concat_ws(" ", "words").alias("win"), "words").distinct()
    once = found.select("win", "words").distinct().withColumn("len", F.size("words"))
    once = once.withColumn("size", F.least("len", F.lit(SHINGLE)))
    shingles = once.select("win", "len", "size", "words", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("size"))).alias("k"))
    return shingles.select("win", "len", "size", "k", F.expr("array_join(slice(words, k + 1, size), ' ')").alias("shingle")), found.select("item_id", "win").distinct()


def matched(docs: DataFrame, shingles: DataFrame) -> DataFrame:
    """(doc_id, pos, shingle): where the shingles of any window stand in the documents, which are cut into words once."""
    wanted = shingles.select("size", "shingle").distinct()
    counts = {r["size"]: r["n"] for r in wanted.groupBy("size").agg(F.count("*").alias("n")).collect()}
    placed = docs.select("doc_id", words(F.col("text")).alias("words")).select("doc_id", "words", F.posexplode("words").alias("pos", "word"))
    if not counts:
        return placed.where("false").select("doc_id", "pos", F.col("word").alias("shingle"))
    each = F.array(*[F.struct(F.lit(size).alias("size"), _shingle(size).alias("shingle")) for size in sorted(counts)])
    found = placed.select("doc_id", "pos", F.explode(each).alias("e")).select("doc_id", "pos", "e.size", "e.shingle").where("shingle is not null")
    side = F.broadcast(wanted) if sum(counts.values()) <= BROADCAST else wanted
    return found.join(side, ["size", "shingle"]).select("doc_id", "pos", "shingle").distinct()


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(doc_id, start, len, win): every occurrence of a window in a document, and (item_id, win)."""
    shingles, owners = item_windows(items, window)
    shingles, owners = durable(shingles), durable(owners)
    hits = durable(matched(docs, shingles))
    counts = hits.groupBy("shingle").agg(F.count("*").alias("df"))
    rare = shingles.join(counts, "shingle").groupBy("win", "len", "size").agg(F.min(F.struct("df", "k", "shingle")).alias("r"), F.count("*").alias("found"))
    rare = rare.where("found = len - size + 1").select("win", "len", "size", F.col("r.k").alias("k"), F.col("r.shingle").alias("shingle"))
    begun = hits.join(rare, "shingle").select("doc_id", (F.col("pos") - F.col("k")).alias("start"), "win", "len", "size").where("start >= 0")
    needed = begun.join(shingles.select("win", "k", "shingle"), "win").select("doc_id", "start", "win", "len", "size", (F.col("start") + F.col("k")).alias("pos"), "shingle")
    whole = needed.join(hits, ["doc_id", "pos", "shingle"], "left_semi").groupBy("doc_id", "start", "win", "len", "size").agg(F.count("*").alias("n"))
    found = durable(whole.where("n = len - size + 1").select("doc_id", "start", "len", "win"))
    discard(hits)
    release(docs.sparkSession)
    return found, owners


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row."""
    docs = texts_of(documents, id_column, text_column)
    found, owners = occurrences(docs, benchmark.select("item_id", "text"), window)
    hit = found.select("doc_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("pos")).distinct().groupBy("doc_id").agg(F.count("*").alias("n_hit"))
    named = found.select("doc_id", "win").distinct().join(owners, "win").select("doc_id", F.col("item_id").cast("string").alias("item")).distinct()
    named = named.groupBy("doc_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    marks = hit.join(named, "doc_id")
    out = docs.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words")).join(marks, "doc_id", "left")
    return out.select(
        "doc_id",
        F.greatest(F.coalesce("n_words", F.lit(0)), F.lit(0)).cast("long").alias("n_words"),  # size of null is -1 or null
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
