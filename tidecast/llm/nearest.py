"""Approximate nearest neighbours by inner product over balanced posting lists.

One more component makes all vectors as long as the longest; queries are scaled to that length and have 0 there, which keeps
their order of inner products, so that the largest inner product is the smallest distance.
Centroids are fitted on a bounded sample, the first SAMPLE vectors by the hash of their id, and clusters of more than twice
the mean size are split.  Every vector goes to the list of its nearest centroid and, if it lies near a boundary, to the lists
of up to REPLICAS - 1 others whose centroids are at most 1 + CLOSE times as far.  A query finds its nearest centroids by beam
search over their in-memory neighbour graph and reads the lists whose centroids are at most 1 + WIDE times as far as its
nearest, LEAST_LISTS of them and LEAST_VECTORS vectors at least.  Scores are inner products of the original vectors.

Equal vectors are one entry with the k + 1 smallest of their ids, which is all that any query can return of them, and equal
queries are asked once.  Lists longer than LIST_MOST are split into parts that each of their queries reads, and the queries of a
list, if more than QUERY_MOST, are dealt to several tasks.  Centroids and a row for each list are all that is broadcast.

Defined cases: vectors that are null, empty, zero, or hold a null or a non-finite component take no part, nor do those of
another length than most have; repeated ids count once (by their smallest vector); with k candidates or fewer all are
returned; ties go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast.llm.shared import durable, shards
from tidecast.llm.textscan import ranges

#: Bounds of the fit: vectors that it reads, and lists.
SAMPLE, MOST_LISTS, PER_LIST, ROUNDS, SEED = 20_000, 4096, 128, 8, 3
REPLICAS, CLOSE, WIDE, LEAST_LISTS, MOST_BEAM, LEAST_VECTORS, LIST_MOST = 4, 0.1, 0.35, 12, 64, 400, 2000
#: Queries of a list that one task answers.
QUERY_MOST = 5000
NEIGHBOURS = 16


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1), 0)


def _extended(vectors: np.ndarray, longest: float) -> np.ndarray:
    return np.concatenate([vectors, np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))[:, None]], axis=1)


def _asked(queries: np.ndarray, longest: float) -> np.ndarray:
    queries = queries / np.abs(queries).max(axis=1, keepdims=True)  # else squares of small components may vanish
    queries *= longest / np.sqrt((queries**2).sum(1))[:, None]
    return np.concatenate([queries, np.zeros((len(queries), 1))], axis=1)


def fit_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """k-means whose clusters of more than twice the mean size are split in two."""
    rng = np.random.default_rng(SEED)
    sample = np.unique(sample, axis=0)
    lists = max(1, min(lists, len(sample)))
    centroids = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(ROUNDS):
        nearest = _distances(sample, centroids).argmin(1)
        size = np.bincount(nearest, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, nearest, sample)
        centroids = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centroids)
        small = np.argsort(size, kind="stable")
        for k, big in enumerate(np.flatnonzero(size > 2 * len(sample) / len(centroids))[: len(centroids) // 4]):
            if size[small[k]] * 2 < size[big]:  # the smallest cluster's centroid moves into the large one
                centroids[small[k]] = sample[rng.choice(np.flatnonzero(nearest == big))]
    return centroids


def neighbour_graph(centroids: np.ndarray, degree: int = NEIGHBOURS) -> np.ndarray:
    """Each centroid's nearest others, and some at random, which keep the graph connected."""
    n = len(centroids)
    apart = _distances(centroids, centroids)
    np.fill_diagonal(apart, np.inf)
    near = np.argsort(apart, axis=1, kind="stable")[:, : min(degree, max(n - 1, 1))]
    far = np.random.default_rng(SEED).integers(0, n, (n, 4))
    ring = ((np.arange(n) + 1) % n)[:, None]
    return np.concatenate([near, far, ring], axis=1)


def search_graph(queries: np.ndarray, centroids: np.ndarray, graph: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The centroids that a beam search finds, nearest first, and their distances; all queries step together."""
    n, q = len(centroids), len(queries)
    beam = min(beam, n)
    if n <= 2 * beam:
        apart = _distances(queries, centroids)
        order = np.argsort(apart, axis=1, kind="stable")[:, :beam]
        return order, np.sqrt(np.take_along_axis(apart, order, 1))
    norms = (centroids**2).sum(1)
    start = np.unique(np.linspace(0, n - 1, beam).astype(np.int64))
    ids = np.broadcast_to(start, (q, len(start))).copy()
    apart = _distances(queries, centroids[start])
    done = np.zeros((q, n), bool)
    seen = np.zeros((q, n), bool)
    seen[:, start] = True
    rows = np.arange(q)
    while True:
        order = np.argsort(apart, axis=1, kind="stable")[:, :beam]
        ids, apart = np.take_along_axis(ids, order, 1), np.take_along_axis(apart, order, 1)
        fresh = ~np.take_along_axis(done, ids, 1)
        if not fresh.any():
            return ids, np.sqrt(apart)
        pick = ids[rows, np.where(fresh.any(1), fresh.argmax(1), 0)]
        done[rows, pick] = True
        step = graph[pick]
        far = (queries**2).sum(1)[:, None] - 2 * np.einsum("qd,qkd->qk", queries, centroids[step]) + norms[step]
        far = np.where(np.take_along_axis(seen, step, 1), np.inf, np.maximum(far, 0))
        ordered = np.sort(step, axis=1)
        if (ordered[:, 1:] == ordered[:, :-1]).any():  # a centroid twice among the neighbours counts once
            for c in range(1, step.shape[1]):
                far[:, c] = np.where((step[:, :c] == step[:, c : c + 1]).any(1), np.inf, far[:, c])
        np.put_along_axis(seen, step, True, 1)
        ids, apart = np.concatenate([ids, step], 1), np.concatenate([apart, far], 1)


def clean(embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part, as arrays of double; one for each id."""
    rows = embeddings.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    rows = rows.where("vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == sizes[0].n) if sizes else rows


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def search(embeddings: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, without the query's own row."""
    spark = embeddings.sparkSession
    rows = durable(clean(embeddings, id_column, vector_column))
    asked = durable(clean(queries, id_column, vector_column))
    schema = "query_id long, rank int, vec_id long, score double"
    if rows.isEmpty() or asked.isEmpty():
        return spark.createDataFrame([], schema)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = pd.DataFrame({"key": [x.tobytes() for x in _matrix(batch.column(1)) + 0.0], "vec_id": batch.column(0).to_numpy(), "at": range(batch.num_rows)})
            some = frame.sort_values("vec_id").groupby("key", sort=False).agg(ids=("vec_id", lambda x: list(x[: k + 1])), at=("at", "first"))
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(some["at"].to_numpy())), pa.array(some["ids"].tolist(), pa.list_(pa.int64()))], ["v", "ids"])

    firsts = salted.select("vec_id", "v").mapInArrow(least, "v array<double>, ids array<long>").withColumn("salt", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(64)))
    for keys in (["v", "salt"], ["v"]):
        firsts = firsts.groupBy(*keys).agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    entries = durable(firsts.select("v", "ids"))
    count = entries.count()
    longest = float(rows.select(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0])
    sample = entries.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).limit(SAMPLE).select("v").collect()
    centroids = fit_centroids(_extended(np.array([r.v for r in sample]), longest), min(MOST_LISTS, -(-count // PER_LIST)))
    shared = spark.sparkContext.broadcast((centroids, neighbour_graph(centroids)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, graph = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                found, apart = search_graph(_extended(_matrix(some.column(0)), longest), centroids, graph, 32)
                take = min(REPLICAS, found.shape[1])
                keep = apart[:, :take] <= (1 + CLOSE) * apart[:, :1] + 1e-12
                row, column = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(found[row, column]), *(c.take(pa.array(row)) for c in some.columns)], ["list", "v", "ids"])

    lists = durable(entries.mapInArrow(assign, "list long, v array<double>, ids array<long>"))
    sizes = {r["list"]: r["n"] for r in lists.groupBy("list").agg(F.count("*").alias("n")).collect()}
    size = np.array([sizes.get(i, 0) for i in range(len(centroids))])
    parts = np.maximum(-(-size // LIST_MOST), 1)
    table = spark.sparkContext.broadcast((size, parts))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (centroids, graph), (size, parts) = shared.value, table.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                found, apart = search_graph(_asked(_matrix(some.column(1)), longest), centroids, graph, MOST_BEAM)
                read = np.cumsum(size[found], axis=1) - size[found]
                keep = (apart <= (1 + WIDE) * apart[:, :1] + 1e-12) | (np.arange(found.shape[1]) < LEAST_LISTS) | (read < LEAST_VECTORS)
                row, column = np.nonzero(keep)
                to = found[row, column]
                again = parts[to]
                part = np.concatenate([np.arange(p) for p in again]) if len(again) else np.zeros(0, np.int64)
                row, to = np.repeat(row, again), np.repeat(to, again)
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(part.astype(np.int64)), *(c.take(pa.array(row)) for c in some.columns)], ["list", "part", "asker", "q"])

    # equal queries are asked once, by the smallest of their ids; a list of many queries is read by several tasks, each for some
    askers = durable(asked.groupBy("v").agg(F.min("vec_id").alias("asker")))
    twins = durable(asked.join(askers, "v").select(F.col("vec_id").alias("query_id"), "asker"))
    routed = durable(askers.select("asker", "v").mapInArrow(route, "list long, part long, asker long, q array<double>"))
    blocks = routed.where("part = 0").groupBy("list").agg(F.ceil(F.count("*") / QUERY_MOST).cast("long").alias("blocks"))
    known = blocks.join(spark.createDataFrame([(int(i), int(p)) for i, p in enumerate(parts)], "list long, parts long"), "list")  # a row for each list
    dealt = lists.join(F.broadcast(known), "list").withColumn("part", F.pmod(F.xxhash64("ids"), F.col("parts")))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))).drop("parts", "blocks")
    sent = routed.join(F.broadcast(blocks), "list").withColumn("block", F.pmod(F.xxhash64("asker"), F.col("blocks")).cast("int")).drop("blocks")
    n = shards(int(size.sum()), 20_000, least=8)
    shard = F.pmod(F.xxhash64("list", "part", "block"), F.lit(n).cast("long")).alias("shard")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        vectors, ids, asks, asker = _matrix(left.column("v")), left.column("ids").combine_chunks(), _matrix(right.column("q")), right.column("asker").to_numpy()
        cut = np.asarray(ids.offsets).astype(np.int64)
        flat = ids.flatten().to_numpy()
        cut = cut - cut[0]

        def rows_of(t: pa.Table) -> dict[tuple, np.ndarray]:
            if not t.num_rows:
                return {}
            key = np.stack([t.column(c).to_numpy() for c in ("list", "part", "block")], axis=1)
            order = np.lexsort(key.T)
            key = key[order]
            head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
            return {tuple(key[a].tolist()): rows for a, rows in zip(head, np.split(order, head[1:]), strict=True)}

        here, out = rows_of(left), []
        for key, q in rows_of(right).items():
            own = here.get(key)
            if own is None:
                continue
            for at in range(0, len(q), 500):
                some = q[at : at + 500]
                near = asks[some] @ vectors[own].T
                least = np.partition(near, max(len(own) - k - 1, 0), axis=1)[:, max(len(own) - k - 1, 0)]
                row, column = np.nonzero(near >= least[:, None] - 1e-9 * np.abs(near).max())  # sums in another order may differ by a little
                score = np.einsum("ij,ij->i", asks[some[row]], vectors[own[column]])
                entry = own[column]
                many = cut[entry + 1] - cut[entry]
                out.append((np.repeat(asker[some[row]], many), flat[ranges(cut[entry], many)], np.repeat(score, many)))
        got = [np.concatenate([o[c] for o in out]) if out else np.zeros(0) for c in range(3)]
        return pa.table({"asker": pa.array(got[0].astype(np.int64)), "vec_id": pa.array(got[1].astype(np.int64)), "score": pa.array(got[2].astype(np.float64))})

    best = dealt.withColumn("shard", shard).groupBy("shard").cogroup(sent.withColumn("shard", shard).groupBy("shard")).applyInArrow(meet, "asker long, vec_id long, score double")
    best = best.groupBy("asker", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(W.partitionBy("asker").orderBy(F.desc("score"), "vec_id"))
    best = best.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")
    each = twins.join(best, "asker").where("query_id <> vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
