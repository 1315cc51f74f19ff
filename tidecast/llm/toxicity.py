"""Toxicity by subword bags: a word is the mean of its character n-gram vectors, a text the mean of its words, and a linear
softmax over that mean tells the classes.  Each distinct word weighs the root of its count, so that a word said a hundred
times does not speak for the text.  Vectors and softmax are trained together in numpy (minibatches, Adagrad).

n-grams are runs of bytes of the folded word with a mark at either end, hashed into BUCKETS vectors, so that misspelt and
unseen words share vectors with the words that they resemble.  The model is fitted in one task on a bounded sample: at most
SAMPLE labelled rows of each class, the first by the hash of their id; buckets of few texts take no part.  Scoring reads
every whole text; as the model is linear, a text's logit is the weighted mean of its words' scalar scores, and each distinct
word of a run of texts is scored once.

Defined cases: null and empty texts (or without a word) get the score of the bias alone; rows whose label is null are not
learned from; ids with several labels take the larger; without rows of both classes the score is that of the only class (0
without any); repeated rows are each scored; rows without a doc_id are not learned from, and have no score of
their own, but keep_clean decides on them like on any text; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm import textscan
from tidecast.llm.shared import texts_of

#: Labelled rows that the fit reads at most: of class 0, of class 1.
SAMPLE = (12_000, 3000)
BUCKETS, DIMENSION, GRAMS = 1 << 17, 8, (3, 4, 5)
EPOCHS, LEAST_STEPS, BATCH, RATE, GAIN, SEED = 6, 1000, 32, 0.5, 30.0, 7
#: Texts of the sample in which a bucket must occur, and neutral words that each text counts besides its own.
LEAST_TEXTS, NEUTRAL = 5, 20

#: Words are runs of anything but ASCII characters that are neither letters nor digits.
SEPARATORS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _distinct_words(part: textscan.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word of each text, and for the distinct words their starts, ends, the number of each word among them, hashes."""
    starts, ends, first = part.words(SEPARATORS)
    hashes = part.word_hashes(starts, ends, fold=True)
    unique, at, number = np.unique(hashes, return_index=True, return_inverse=True)
    return first, starts[at], ends[at], number, unique


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each word's n-grams side by side, and their number for each word."""
    size = ends - starts
    at = np.cumsum(size + 2) - (size + 2)
    marked = np.empty(int((size + 2).sum()), np.uint8)
    marked[at], marked[at + size + 1] = 60, 62
    marked[textscan.ranges(at + 1, size)] = textscan.FOLD[data[textscan.ranges(starts, size)]]
    total = textscan.Texts(at, marked, at).byte_sums()
    counts = [np.maximum(size + 2 - n + 1, 0) for n in GRAMS]
    counts[0] = np.maximum(counts[0], 1)  # a word of no bytes does not occur; one byte with its marks is one 3-gram
    begin, words, length = [], [], []
    for n, c in zip(GRAMS, counts, strict=True):
        begin.append(textscan.ranges(at, c))
        words.append(np.repeat(np.arange(len(size)), c))
        length.append(np.full(int(c.sum()), n))
    begin, words, length = np.concatenate(begin), np.concatenate(words), np.concatenate(length)
    order = np.argsort(words, kind="stable")
    begin, length = begin[order], length[order]
    return (textscan.span_hashes(total, begin, begin + length) >> np.uint64(64 - 17)).astype(np.int64), sum(counts)


def bags(texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each text the buckets that occur in it and the share of each in the mean of the text's words."""
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts))), texts], ["k", "text"])
    buckets, weights = [], []
    for _, part in textscan.texts(batch):
        first, starts, ends, number, _ = _distinct_words(part)
        grams, count = subwords(part.data, starts, ends) if len(starts) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        from_ = np.cumsum(count) - count
        for k in range(len(part)):
            word, n = np.unique(number[first[k] : first[k + 1]], return_counts=True)
            n = np.sqrt(n)
            each = grams[textscan.ranges(from_[word], count[word])]
            share = np.repeat(n / (NEUTRAL + n.sum()) / np.maximum(count[word], 1), count[word])
            bucket, back = np.unique(each, return_inverse=True)
            buckets.append(bucket.astype(np.int32))
            weights.append(np.bincount(back, share, len(bucket)).astype(np.float32))
    return buckets, weights


def fit(texts: pa.Array, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """A scalar for each bucket, and the bias: what vectors and softmax come to for a text's logit."""
    table = np.zeros(BUCKETS, np.float32)
    if not len(labels):
        return table, -np.inf
    if labels.min() == labels.max():
        return table, np.inf if labels[0] else -np.inf
    buckets, weights = bags(texts)
    texts_of = np.zeros(BUCKETS, np.int64)
    for bucket in buckets:
        texts_of[bucket] += 1
    known = texts_of >= min(LEAST_TEXTS, len(labels))
    for k, bucket in enumerate(buckets):
        keep = known[bucket]
        buckets[k], weights[k] = bucket[keep], weights[k][keep] * np.float32(GAIN)
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (BUCKETS, DIMENSION)).astype(np.float32)
    softmax, bias = rng.normal(0, 0.5, (DIMENSION, 2)).astype(np.float32), np.zeros(2, np.float32)
    seen, seen_softmax, seen_bias = np.full(BUCKETS, 1e-6, np.float32), np.full(softmax.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    goal = np.eye(2, dtype=np.float32)[labels]
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(labels)))):
        for rows in np.array_split(rng.permutation(len(labels)), -(-len(labels) // BATCH)):
            size = np.array([len(buckets[k]) for k in rows])
            row = np.repeat(np.arange(len(rows)), size)
            b, w = np.concatenate([buckets[k] for k in rows]), np.concatenate([weights[k] for k in rows])
            mean = np.zeros((len(rows), DIMENSION), np.float32)
            full = size > 0
            if len(b):
                mean[full] = np.add.reduceat(vectors[b] * w[:, None], (np.cumsum(size) - size)[full])
            logits = mean @ softmax + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = (p - goal[rows]) / len(rows)
            g_softmax, g_bias, g_mean = mean.T @ error, error.sum(0), error @ softmax.T
            seen_softmax += g_softmax**2
            seen_bias += g_bias**2
            softmax -= RATE * g_softmax / np.sqrt(seen_softmax)
            bias -= RATE * g_bias / np.sqrt(seen_bias)
            if len(b):
                order = np.argsort(b, kind="stable")
                cuts = np.flatnonzero(np.concatenate([[True], np.diff(b[order]) > 0]))
                g = np.add.reduceat(g_mean[row[order]] * w[order][:, None], cuts)
                hit = b[order][cuts]
                seen[hit] += (g**2).mean(1)
                vectors[hit] -= RATE * g / np.sqrt(seen[hit])[:, None]
    vectors[~known] = 0
    lean = softmax[:, 1] - softmax[:, 0]
    return (vectors @ lean * GAIN).astype(np.float32), float(bias[1] - bias[0])


def train(documents: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> tuple[np.ndarray, float]:
    """Fits on at most sample[k] rows of class k, from rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    some = None
    for kind in (0, 1):
        part = known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample[kind])
        some = part if some is None else some.unionByName(part)
    rows = documents.select("doc_id", "text").join(F.broadcast(some), "doc_id").withColumn("one", F.lit(1))

    def learn(table: pa.Table) -> pa.Table:
        found = table.to_pandas().sort_values(["doc_id", "text"], kind="stable").drop_duplicates("doc_id")
        scalars, bias = fit(pa.array(found["text"], pa.string()), found["toxic"].to_numpy(np.int64))
        textscan.give_back()
        return pa.Table.from_pandas(pd.DataFrame({"scalars": [scalars.tobytes()], "bias": [bias]}))

    got = rows.groupBy("one").applyInArrow(learn, "scalars binary, bias double").collect()
    return (np.frombuffer(got[0].scalars, np.float32), got[0].bias) if got else (np.zeros(BUCKETS, np.float32), -np.inf)


def _scores(part: textscan.Texts, model: tuple[np.ndarray, float]) -> np.ndarray:
    scalars, bias = model
    first, starts, ends, number, _ = _distinct_words(part)
    mean = np.zeros(len(part))
    if len(starts):
        grams, count = subwords(part.data, starts, ends)
        each = np.add.reduceat(scalars[grams].astype(np.float64), np.cumsum(count) - count) / count
        text = np.repeat(np.arange(len(part)), np.diff(first))
        pair, n = np.unique(text * len(each) + number, return_counts=True)
        text, n = pair // len(each), np.sqrt(n)
        mean = np.bincount(text, each[pair % len(each)] * n, len(part)) / (NEUTRAL + np.bincount(text, n, len(part)))
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-(mean + bias)))


def score(documents: DataFrame, model: tuple[np.ndarray, float], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in textscan.texts(batch):
                yield pa.RecordBatch.from_arrays([pa.array(part.ids), pa.array(_scores(part, shared.value))], ["doc_id", "score"])

    docs = texts_of(documents, id_column, text_column)
    return docs.mapInArrow(scan, "doc_id long, score double")


def keep_clean(documents: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of documents, with all their columns, that score below the threshold."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(id_column), documents.columns.index(text_column)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_scores(part, shared.value) for _, part in textscan.texts(batch, id_column=at[0], text_column=at[1])]
            yield batch.filter(pa.array(np.concatenate([*found, np.zeros(0)]) < threshold))
        textscan.give_back()

    return documents.mapInArrow(scan, documents.schema)


def toxicity(documents: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    out = score(documents, train(documents, labels, sample))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
