"""N-gram Jaccard join by grouped prefixes.

Tokens are word shingles, ordered by rarity: shingles that stand out as frequent come last, by their counts, all others
come first, by how frequent their words are, then by their hash.  Any two sets that link share a token among their prefixes.  Documents with one and the same
set are a single entry; entries with the same prefix and size form a group.  An inverted index over prefix tokens pairs
groups, which the size and positional bounds filter; pairs that are left are expanded to members, which a bitmap bound
filters and the sets verify exactly (by 64-bit shingle hashes).

Tokens that have the same list, such as those of a passage, count as one list with a weight.  In short lists group pairs meet
without their members and are filtered by the number of tokens that their prefixes have in common; long lists go to shards
with the members' bitmaps, once for each shard.  Lists longer than BLOCK are dealt out as pairs of blocks.

For components, links between copies are never expanded to all pairs.  NEAR_ROUNDS rounds verify for each entry of a long list
its nearest, smallest and largest partner outside its component; a last round verifies every pair that is left between
different components, in long lists among the groups alone that had a partner within the bounds in the round before.  What is skipped joins documents of one component, so that components are exact.  For the join itself
(class_links, jaccard_links) one round verifies every pair of entries that the bounds leave, so that no link is missing; its
pairs grow with the square of a group of near copies, as the links do.

Defined cases: a null text, or one without words, has size 0 and links with nothing (not even its like); fewer words than
the shingle size are one shingle; repeated rows of a doc_id count as one document each with the same links; rows without a
doc_id take no part; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecast.llm import textscan
from tidecast.llm.shared import components, discard, durable, few, release, shards, texts_of

#: Frequent shingles, and frequent words, that the order knows (a bound on what the driver gathers; others count as rare).
FREQUENT = 1 << 17
#: Entries of an index list that meet in one block, and index rows of one shard.
BLOCK, SHARD = 1024, 2000
#: Pairs of groups, and pairs of members, that a shard expands at once, and pairs of members that wait to be merged.
AT_ONCE = 100_000
#: Rounds that verify the nearest, smallest and largest partner alone; groups of the longest list that goes by counts.
NEAR_ROUNDS, SHORT_LIST = 1, 3
#: Shingles or words counted together in a task, and the count among them from which one counts as frequent.
COUNTED, STANDS_OUT = 1_500_000, 6
#: Words of 64 bits of the narrowest parity bitmap; a set of n tokens has a bit for every two tokens at least.
NARROW = 4


def _shingles(batch: pa.RecordBatch, words: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, word hashes, each shingle's hash, first word and number of words, where each text's shingles begin) of runs of texts."""
    for _, part in textscan.texts(batch):
        starts, ends, first = part.words()
        hashes = part.word_hashes(starts, ends, fold=True)
        n = np.diff(first)
        counts = np.where(n >= words, n - words + 1, np.minimum(n, 1))
        begin = textscan.ranges(first[:-1], counts)
        shingles = np.zeros(len(begin), np.uint64)
        size = np.repeat(np.minimum(n, words), counts)
        for k in np.unique(size).tolist():
            of = np.flatnonzero(size == k)
            shingles[of] = textscan.run_names(hashes, k)[begin[of]]
        yield part.ids, hashes, shingles, begin, size, np.concatenate([[0], np.cumsum(counts)])


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, sorted distinct shingle hashes) for each text."""
    for ids, _, shingles, _, _, at in _shingles(batch, words):
        for k, doc in enumerate(ids):
            yield int(doc), np.unique(shingles[at[k] : at[k + 1]])


def frequent_tokens(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of at most FREQUENT shingles, from the least to the most frequent, and of at most FREQUENT words, sorted, with
    their counts; from all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(word: bool) -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held[word]), return_counts=True)
            held[word], size[word] = [], 0
            keep = n >= STANDS_OUT
            return pa.RecordBatch.from_arrays([pa.array(np.full(int(keep.sum()), word)), pa.array(token[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], ["word", "token", "n"])

        held, size = {False: [], True: []}, {False: 0, True: 0}
        for batch in batches:
            for ids, hashes, shingles, _, _, at in _shingles(batch, words):
                for word, found in [(True, hashes), *((False, np.unique(shingles[at[k] : at[k + 1]])) for k in range(len(ids)))]:
                    held[word].append(found)
                    size[word] += len(found)
                    if size[word] >= COUNTED:
                        yield flush(word)
        for word in held:
            if held[word]:
                yield flush(word)
        textscan.give_back()

    counts = durable(docs.mapInArrow(count, "word boolean, token long, n long").groupBy("word", "token").agg(F.sum("n").alias("n")))
    shingle, word = (counts.where(of).orderBy(F.desc("n"), "token").limit(FREQUENT).collect() for of in ("not word", "word"))
    discard(counts)
    word.sort(key=lambda r: r.token % (1 << 64))
    return *(np.array([r.token for r in top], np.int64).view(np.uint64) for top in (shingle[::-1], word)), np.array([r.n for r in word], np.int64)


def _levels(hashes: np.ndarray, known: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The level of each word; 0 for words that are not known as frequent."""
    if not len(known):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, level[at], 0)


def signatures(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray, np.ndarray], words: int, percent: int) -> DataFrame:
    """(doc_id, n, k1, k2, prefix, bits) for each text: size, a key of the set, its prefix in order, a parity bitmap.

    A shingle's level adds up logarithms of its words' counts: texts share shingles of frequent words by chance, so that
    those of rare words come first.
    """
    shingle, known, counts = frequent
    order = np.argsort(shingle, kind="stable")
    shared = docs.sparkSession.sparkContext.broadcast((shingle[order], order, known, np.round(8 * np.log2(1 + counts)).astype(np.int64)))

    def prefix(tokens: np.ndarray, levels: np.ndarray, by_hash: np.ndarray, rank: np.ndarray) -> np.ndarray:
        p = len(tokens) - -(-percent * len(tokens) // 100) + 1
        tokens = tokens[np.argsort(levels, kind="stable")]
        if not len(by_hash):
            return tokens[:p]
        for some in (tokens[: 2 * p], tokens):
            at = np.minimum(np.searchsorted(by_hash, some), len(by_hash) - 1)
            common = by_hash[at] == some
            rare = some[~common]
            if len(rare) >= p:
                return rare[:p]
        late = tokens[common]
        return np.concatenate([rare, late[np.argsort(rank[at[common]], kind="stable")]])[:p]

    def ranked(batch: pa.RecordBatch, known: np.ndarray, level: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for ids, hashes, shingles, begin, size, at in _shingles(batch, words):
            before = np.concatenate([[0], np.cumsum(_levels(hashes, known, level))])
            levels = np.minimum(before[begin + size] - before[begin], 32767).astype(np.int16)
            for k, doc in enumerate(ids):
                tokens, first = np.unique(shingles[at[k] : at[k + 1]], return_index=True)
                yield int(doc), tokens, levels[at[k] : at[k + 1]][first]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_hash, rank, known, level = shared.value
        for batch in batches:
            out = []
            for doc, tokens, levels in ranked(batch, known, level):
                if not len(tokens):
                    out.append((doc, 0, 0, 0, None, None))
                    continue
                k1, k2 = np.add.reduce(textscan.mix(tokens)), np.add.reduce(textscan.mix(tokens ^ np.uint64(0xA5A5A5A55A5A5A5A)))
                width = 64 * NARROW
                while 2 * width < len(tokens):
                    width *= 2
                bits = np.packbits((np.bincount((tokens % np.uint64(width)).astype(np.int64), minlength=width) & 1).astype(np.uint8))
                out.append((doc, len(tokens), int(k1.view(np.int64)), int(k2.view(np.int64)), prefix(tokens, levels, by_hash, rank).view(np.int64), bits.tobytes()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n", "k1", "k2", "prefix", "bits"])
            del out, columns
        textscan.give_back()

    return docs.mapInArrow(sign, "doc_id long, n long, k1 long, k2 long, prefix array<long>, bits binary")


def _lists(entries: DataFrame, percent: int) -> DataFrame:
    """(list, many, most, weight, gid, n): the index lists of the prefix tokens that two groups at least share.

    A token's groups, in the order of their sizes, are cut into several lists where a size is too small for the next one to
    link with it: no pair that the sizes allow is on both sides of a cut.  Groups that are left alone go, unless they have
    several members themselves.  Lists that have the same groups, such as those of a passage, are one list with their number
    as its weight; most is the largest number of members of a group in it.  Prefix tokens are shuffled once.
    """
    several = durable(entries.groupBy("gid").agg(F.count("*").alias("members"), F.min("doc_id").alias("head")).where("members > 1"))
    groups = entries.join(few(several), "gid", "left").where("members is null or doc_id = head")  # one entry of each group
    slim = groups.select("gid", F.col("n").cast("int").alias("n"), F.coalesce("members", F.lit(1)).cast("int").alias("members"), F.explode("prefix").alias("token"))
    order = Window.partitionBy("token").orderBy("n")
    near = slim.withColumns({"below": F.lag("n").over(order), "above": F.lead("n").over(order)})
    near = near.withColumns({"on": F.expr(f"coalesce(100L * below >= {percent}L * n, false)"), "up": F.expr(f"coalesce(100L * n >= {percent}L * above, false)")})
    near = near.withColumn("cut", F.sum(F.when(F.col("on"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    near = near.where("on or up or members > 1")
    found = durable(near.select(F.when(F.col("cut") == 1, F.col("token")).otherwise(F.xxhash64("token", "cut")).alias("list"), "gid", "n", "members"))
    release(entries.sparkSession)
    same = [F.bit_xor(F.xxhash64("gid", F.lit(k))).alias(f"k{k}") for k in (0, 1)]
    alike = found.groupBy("list").agg(*same, F.count("*").alias("many"), F.max("members").alias("most")).groupBy("k0", "k1", "many", "most").agg(F.min("list").alias("list"), F.count("*").alias("weight"))
    out = durable(found.join(alike.select("list", "many", "most", "weight"), "list").select("list", "many", "most", "weight", "gid", F.col("n").cast("long").alias("n")))
    discard(found)
    discard(several)
    return out


#: Lists of at most so many groups, of one member each, go by counts of common tokens; the others by bitmaps.
SHORT = f"many <= {SHORT_LIST} and most = 1"


def _of_several(lists: DataFrame, spans: DataFrame) -> DataFrame:
    """The lists whose members are of several components; spans has (gid, low, high) of each group."""
    placed = lists.join(spans, "gid")
    several = placed.groupBy("list").agg(F.min("low").alias("a"), F.max("high").alias("b")).where("a < b")
    return lists.join(several.select("list"), "list", "left_semi")


class _Bitmaps:
    """Parity bitmaps of any power-of-two width; halves of a wider one folded together are that of the narrower width."""

    def __init__(self, rows: list[bytes]):
        self.width = np.array([len(r) // 8 for r in rows], np.int64)
        self.level: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        carried, of = np.zeros((0, 0), np.uint64), np.zeros(0, np.int64)
        for w in sorted(set(self.width.tolist()), reverse=True):
            while carried.shape[1] > w:
                half = carried.shape[1] // 2
                carried = carried[:, :half] ^ carried[:, half:]
            own = np.flatnonzero(self.width == w)
            fresh = np.frombuffer(b"".join([rows[k] for k in own]), np.uint64).reshape(len(own), w)
            carried, of = np.concatenate([carried.reshape(-1, w), fresh]), np.concatenate([of, own])
            place = np.full(len(rows), -1, np.int64)
            place[of] = np.arange(len(of))
            self.level[w] = (carried, place)

    def apart(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Bits that differ: a lower bound of the symmetric difference."""
        out = np.zeros(len(u), np.int64)
        least = np.minimum(self.width[u], self.width[v])
        for w, (rows, place) in self.level.items():
            pairs = np.flatnonzero(least == w)
            step = max(1, (1 << 20) // w)
            for at in range(0, len(pairs), step):
                k = pairs[at : at + step]
                out[k] = np.bitwise_count(rows[place[u[k]]] ^ rows[place[v[k]]]).sum(axis=1)
        return out


def _merged(kept: tuple[np.ndarray, ...], got: list[tuple[np.ndarray, ...]], every: bool) -> tuple[np.ndarray, ...]:
    """The pairs (u, v, far) of kept and got, each once: all of them, or of all pairs seen so far (those of got in both
    directions) for each u the one with its nearest v and the ones with its smallest and largest v."""
    u, v, far = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in range(3))
    if not every:
        u, v, far = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([far, far])
    u, v, far = (np.concatenate(both) for both in zip(kept, (u, v, far), strict=True))
    order = np.lexsort((v, u))
    order = order[np.concatenate([[True], (u[order][1:] != u[order][:-1]) | (v[order][1:] != v[order][:-1])])] if len(order) else order
    u, v, far = u[order], v[order], far[order]
    if not every and len(u):
        new = np.concatenate([[True], u[1:] != u[:-1]])
        nearest = np.lexsort((v, far, u))  # a u's rows stand at the same places in either order
        pick = np.unique(np.concatenate([np.flatnonzero(new), np.flatnonzero(np.append(new[1:], True)), nearest[new]]))
        u, v, far = u[pick], v[pick], far[pick]
    return u, v, far


def _meet(lists: pa.Table, members: pa.Table, percent: int, every: bool) -> pa.Table:
    """Of the member pairs of one shard's lists that all bounds leave (u, v, far): all of them, or for each u the one with its
    nearest v and the ones with its smallest and largest v; far is an estimate of the symmetric difference."""
    members = members.sort_by([("group", "ascending"), ("doc", "ascending")])
    gid, doc, comp, size = (members.column(c).to_numpy() for c in ("group", "doc", "comp", "size"))
    bitmaps = _Bitmaps(members.column("bits").to_pylist())
    col = {name: lists.column(name).to_numpy() for name in ("list", "b1", "b2", "block", "gid", "n")}
    order = np.lexsort((col["b2"], col["b1"], col["list"]))
    col = {k: v[order] for k, v in col.items()}
    first, end = np.searchsorted(gid, col["gid"]), np.searchsorted(gid, col["gid"], side="right")
    key = np.flatnonzero(np.concatenate([[True], (col["list"][1:] != col["list"][:-1]) | (col["b1"][1:] != col["b1"][:-1]) | (col["b2"][1:] != col["b2"][:-1])]))
    length = np.diff(np.append(key, len(order)))
    partners = np.repeat(key + length, length) - np.arange(len(order))  # each row with itself and all later ones of its list
    none = np.zeros(0, np.int64)
    kept, got, waiting = (none, none, none), [], 0
    for rows in np.split(np.arange(len(order)), np.flatnonzero(np.diff(np.cumsum(partners) // AT_ONCE)) + 1):
        x = np.repeat(rows, partners[rows])
        y = textscan.ranges(rows, partners[rows])
        nx, ny = col["n"][x], col["n"][y]
        crossing = (col["b1"][x] == col["b2"][x]) | (col["block"][x] != col["block"][y])
        keep = (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)) & crossing
        x, y = x[keep], y[keep]
        wide = end[y] - first[y]
        upto = np.cumsum((end[x] - first[x]) * wide)  # group pairs come to so many member pairs
        for at in range(0, int(upto[-1]) if len(upto) else 0, AT_ONCE):
            step = np.arange(at, min(at + AT_ONCE, int(upto[-1])))
            of = np.searchsorted(upto, step, side="right")
            step -= np.where(of > 0, upto[of - 1], 0)
            u, v = first[x[of]] + step // wide[of], first[y[of]] + step % wide[of]
            keep = (comp[u] != comp[v]) & ((x[of] != y[of]) | (u < v))
            u, v = u[keep], v[keep]
            both = size[u] + size[v]
            far = bitmaps.apart(u, v)
            keep = far <= both - 2 * -(-percent * both // (100 + percent))
            got.append((np.minimum(doc[u], doc[v])[keep], np.maximum(doc[u], doc[v])[keep], far[keep]))
            waiting += len(got[-1][0])
            if waiting > max(AT_ONCE, len(kept[0])):  # copies of a pair, from many lists, do not wait for each other
                kept, got, waiting = _merged(kept, got, every), [], 0
    u, v, far = _merged(kept, got, every)
    del kept, got
    textscan.give_back()
    return pa.table({"u": u, "v": v, "far": far})


def _long(lists: DataFrame, members: DataFrame, rows: int, percent: int, every: bool) -> DataFrame:
    """(u, v), u < v: pairs of members of different components that meet in a long list and that the bounds leave; all, or for
    each member its nearest, smallest and largest partner.

    Lists with the same smallest group share a shard, or some if they are many, so that the members of near copies, which meet
    in many lists, go to few shards with their bitmaps, once to each.
    """
    heads = lists.groupBy("list").agg(F.min("gid").alias("head"))
    dealt = lists.join(heads, "list").withColumn("blocks", F.ceil(F.col("many") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("gid"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    table = durable(dealt.select("list", "head", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "gid", "n"))
    n = F.lit(shards(rows, SHARD)).cast("long")
    shares = durable(table.groupBy("head", "b1", "b2").agg(F.ceil(F.count("*") / (4 * SHARD)).cast("long").alias("shares")).where("shares > 1"))
    dealt = table.join(few(shares), ["head", "b1", "b2"], "left").withColumn("share", F.pmod(F.xxhash64("list"), F.coalesce("shares", F.lit(1))))
    dealt = durable(dealt.select(F.pmod(F.xxhash64("head", "b1", "b2", "share"), n).alias("shard"), "list", "b1", "b2", "block", "gid", "n"))
    discard(table)
    discard(shares)
    sent = dealt.select(F.col("shard").alias("to"), F.col("gid").alias("group")).distinct()
    sent = sent.join(members.select(F.col("gid").alias("group"), F.col("doc_id").alias("doc"), "comp", F.col("n").alias("size"), "bits"), "group")
    found = dealt.groupBy("shard").cogroup(sent.groupBy("to")).applyInArrow(lambda a, b: _meet(a, b, percent, every), "u long, v long, far long")
    if not every:
        found = found.groupBy("u").agg(F.min_by("v", F.struct("far", "v")).alias("a"), F.min("v").alias("b"), F.max("v").alias("c"))
        found = found.select("u", F.explode(F.array("a", "b", "c")).alias("v"))
    out = durable(found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    discard(dealt)
    return out


def _short(lists: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(u, v), u < v: every pair of members of different components that meets in short lists alone and that the bounds leave.

    Group pairs come first, without their members: of the tokens that two sets share, those up to where the first of the two
    prefixes ends stand in both prefixes, so that prefixes with m tokens in common leave at most m and what follows that
    prefix.  Only then do the pairs meet their members and bitmaps.
    """
    each = lists.groupBy("list", "weight").agg(F.sort_array(F.collect_list(F.struct("gid", "n"))).alias("g"))  # SHORT_LIST at most
    pairs = each.select("weight", F.explode(F.expr("flatten(transform(g, (x, i) -> transform(slice(g, i + 2, size(g)), y -> struct(x.gid as g, y.gid as h, x.n as nx, y.n as ny))))")).alias("p"))
    pairs = pairs.select("weight", "p.*").where(f"100 * least(nx, ny) >= {percent} * greatest(nx, ny)")
    common = pairs.groupBy("g", "h", "nx", "ny").agg(F.sum("weight").alias("m"))
    need, rest = F.expr(f"ceil({percent} * (nx + ny) / {100 + percent})"), F.expr(f"ceil({percent} * greatest(nx, ny) / 100) - 1")
    groups = common.where(F.col("m") + rest >= need).select("g", "h")
    one, two = ([F.col("gid").alias(g), F.col("doc_id").alias(u), F.col("comp").alias(f"c{u}"), F.col("n").alias(f"n{u}"), F.col("bits").alias(f"b{u}")] for g, u in (("g", "u"), ("h", "v")))
    both = groups.join(members.select(*one), "g").join(members.select(*two), "h").where("cu <> cv")

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            bitmaps = _Bitmaps([*batch.column(4).to_pylist(), *batch.column(5).to_pylist()])
            sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            keep = bitmaps.apart(np.arange(n), np.arange(n, 2 * n)) <= sizes - 2 * -(-percent * sizes // (100 + percent))
            yield batch.select([0, 1]).filter(pa.array(keep))

    return both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "nu", "nv", "bu", "bv").mapInArrow(apart, "u long, v long")


def set_table(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, tokens): the sorted shingle hashes of each text, as bytes."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_sets(batch, words))
            for at in range(0, len(found), 500):
                some = found[at : at + 500]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in some], pa.int64()), pa.array([t.tobytes() for _, t in some], pa.binary())], ["doc_id", "tokens"])
            del found
        textscan.give_back()

    return docs.mapInArrow(build, "doc_id long, tokens binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets link."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep[k] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select([0, 1]).filter(pa.array(keep))
        textscan.give_back()

    left = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("tokens").alias("tu")), "u")
    both = left.join(sets.select(F.col("doc_id").alias("v"), F.col("tokens").alias("tv")), "v").select("u", "v", "tu", "tv")
    return both.mapInArrow(check, "u long, v long")


def _classes(documents: DataFrame, words: int, percent: int, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts, (doc_id, n, k1, k2) of each, and a row for each set that is not empty, by its smallest doc_id, as an entry."""
    docs = texts_of(documents, id_column, text_column)
    signed = durable(signatures(docs, frequent_tokens(docs, words), words, percent))
    sets = signed.where("n > 0").groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "prefix", "bits")).alias("r")).select("n", "r.*")
    entries = durable(sets.select("doc_id", "n", "prefix", "bits", F.xxhash64("n", "prefix").alias("gid")))
    keys = durable(signed.select("doc_id", "n", "k1", "k2"))
    discard(signed)
    release(docs.sparkSession)
    return docs, keys, entries


def _class_ids(keys: DataFrame) -> DataFrame:
    """(k1, k2, n, class_id, same): the smallest doc_id of each set that is not empty, and the number of its documents."""
    return keys.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("class_id"), F.countDistinct("doc_id").alias("same"))


def _every_link(docs: DataFrame, entries: DataFrame, words: int, percent: int) -> DataFrame:
    """(u, v), u < v: all links between entries; every pair that the bounds leave is verified."""
    spark = docs.sparkSession
    lists = _lists(entries, percent)
    release(spark)
    members = entries.drop("prefix").withColumn("comp", F.col("doc_id"))
    long = lists.where(f"not ({SHORT})")
    pairs = durable(_long(long, members, long.count(), percent, True).unionByName(_short(lists.where(SHORT), members, percent)).distinct())
    links = _links(docs, pairs, words, percent)
    discard(lists)
    return links


def _links(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose sets link, as a table; the table of pairs is removed."""
    active = durable(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct())
    sets = durable(set_table(docs.join(few(active), "doc_id", "left_semi"), words))
    links = durable(_verified(pairs, sets, percent).distinct())
    for table in (pairs, active, sets):
        discard(table)
    return links


def class_links(documents: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(u, v), u < v: all pairs of classes, by their class_id, whose sets link."""
    docs, _, entries = _classes(documents, words, percent, id_column, text_column)
    return _every_link(docs, entries, words, percent)


def jaccard_links(documents: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, n_links) for every row: n_links counts the other documents that the document links
    with, those with the same set and those of all classes that link with its own; 0 where the set is empty."""
    docs, keys, entries = _classes(documents, words, percent, id_column, text_column)
    links = _every_link(docs, entries, words, percent)
    discard(entries)
    key = ["k1", "k2", "n"]
    sizes = durable(_class_ids(keys))
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.join(sizes.select(F.col("class_id").alias("v"), "same"), "v").groupBy(F.col("u").alias("class_id")).agg(F.sum("same").alias("near"))
    found = keys.join(sizes.join(near, "class_id", "left"), key, "left")
    n_links = F.coalesce(F.col("same") - 1 + F.coalesce("near", F.lit(0)), F.lit(0))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), n_links.alias("n_links"))


def jaccard_components(documents: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) for every row.

    class_id is the smallest doc_id with the same set (the document's own id where the set is empty); component_id is the
    smallest doc_id that links reach, where links are sets with 100 * intersection >= percent * union.
    """
    spark: SparkSession = documents.sparkSession
    docs, keys, entries = _classes(documents, words, percent, id_column, text_column)
    lists = _lists(entries, percent)
    near = durable(entries.drop("prefix").join(lists.select("gid").distinct(), "gid", "left_semi"))
    discard(entries)
    release(spark)
    long, short = lists.where(f"not ({SHORT})"), lists.where(SHORT)
    comps = links = met = None
    for every in (*[False] * NEAR_ROUNDS, True):
        members = near.withColumn("comp", F.col("doc_id"))
        if comps is not None:
            members = near.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component")
        members = durable(members)
        some = long
        if met is not None:
            spans = members.groupBy("gid").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
            some = durable(_of_several(long.join(few(met), "gid", "left_semi"), spans))
            discard(met)
        pairs = _long(some, members, some.count(), percent, every)
        if some is not long:
            discard(some)
        if every:
            pairs, near_pairs = durable(pairs.unionByName(_short(short, members, percent)).distinct()), pairs
            discard(near_pairs)
        else:  # a group whose members have no partner here has none in a later round: components only grow
            ends = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
            met = durable(members.join(few(ends), "doc_id", "left_semi").select("gid").distinct())
        discard(members)
        release(spark)
        fresh = _links(docs, pairs, words, percent)
        release(spark)
        links = fresh if links is None else links.unionByName(fresh)
        comps = durable(components(links.select(F.col("u").alias("a"), F.col("v").alias("b"))))
    discard(near)
    discard(lists)
    class_ids = _class_ids(keys).join(comps.withColumnRenamed("node", "class_id"), "class_id", "left")
    out = keys.join(class_ids, ["k1", "k2", "n"], "left")
    own = F.coalesce("component", "class_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))
