"""Language ID by hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  A letter trigram binds its letters' vectors, the first permuted twice (rolled by
two places) and the second once, by elementwise product; a text bundles (adds) the vectors of its trigrams, a language the
normalised vectors of its training texts, and a text gets the language of the nearest prototype by cosine.  Words stand
between blanks, which count as a letter.

The fit reads at most SAMPLE texts of each language, the first by the hash of their id; prediction reads every whole text.

Defined cases: a text that is null or has no letter is `und` with score 0; rows whose lang is null are not learned from; ties
go to the language that sorts first; without any learned language every text is `und`; repeated rows are each predicted, and learned from with the
lang that stands beside their own text; rows without a doc_id take no part;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast.llm.shared import texts_of

#: Texts of each language that the fit reads at most, and the length of the vectors.
SAMPLE, DIMENSION = 1500, 1024
SLOTS, SEED, RUN = 512, 11, 1 << 17
_NOT_LETTERS = np.array([not (chr(c).isalpha()) for c in range(0x10000)])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _letters() -> np.ndarray:
    """The vectors of all slots: a letter's slot is its code point modulo SLOTS - 1, plus 1; the blank's is 0."""
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SLOTS, DIMENSION))


_vectors: list[np.ndarray] = []


def _bound(codes: np.ndarray) -> np.ndarray:
    if not _vectors:
        one = _letters()
        _vectors.extend([np.roll(one, 2, axis=1), np.roll(one, 1, axis=1), one])
    a, b, c = codes // (SLOTS * SLOTS), codes // SLOTS % SLOTS, codes % SLOTS
    return _vectors[0][a] * _vectors[1][b] * _vectors[2][c]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: where each text's trigrams begin (one more entry), the distinct codes, the root of their counts."""
    points = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    size = np.array([len(p) + 2 for p in points], np.int64)
    first = np.cumsum(size) - size
    flat = np.zeros(int(size.sum()), np.int64)
    for p, at in zip(points, first.tolist(), strict=True):
        flat[at + 1 : at + 1 + len(p)] = p
    gap = _NOT_LETTERS[np.minimum(flat, len(_NOT_LETTERS) - 1)]
    for point in np.unique(flat[flat >= len(_NOT_LETTERS)]).tolist():  # beyond the first plane letters are few
        gap[flat == point] = not chr(point).isalpha()
    slot = np.where(gap, 0, flat % (SLOTS - 1) + 1)
    row = np.repeat(np.arange(len(texts)), size)
    keep = np.ones(len(slot), bool)
    keep[1:] = ~(gap[1:] & gap[:-1] & (row[1:] == row[:-1]))  # white space and signs are one blank
    slot, row = slot[keep], row[keep]
    code = (slot[:-2] * SLOTS + slot[1:-1]) * SLOTS + slot[2:]
    own = (row[:-2] == row[2:]) & (slot[1:-1] > 0)
    pair, n = np.unique(row[:-2][own] * SLOTS**3 + code[own], return_counts=True)
    return np.searchsorted(pair // SLOTS**3, np.arange(len(texts) + 1)), pair % SLOTS**3, np.sqrt(n).astype(np.float32)


def profiles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The normalised bundle of each text, and whether it has a letter."""
    cut, code, weight = trigrams(texts)
    out = np.zeros((len(texts), DIMENSION), np.float32)
    if len(code):
        unique, number = np.unique(code, return_inverse=True)
        bound = _bound(unique).astype(np.float32)
        for k in np.flatnonzero(np.diff(cut)):
            mine = slice(cut[k], cut[k + 1])
            out[k] = weight[mine] @ bound[number[mine]]
    length = np.linalg.norm(out, axis=1)
    return out / np.maximum(length, 1e-9)[:, None], np.diff(cut) > 0


def _runs(texts: list[str]) -> Iterator[slice]:
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= RUN:
            yield slice(at, k + 1)
            at, size = k + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def train(documents: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, from rows with a lang that are not held out."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("doc_id is not null")
    known = rows.select("doc_id", "lang").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    some = known.withColumn("place", place).where(F.col("place") <= sample).select("doc_id", "lang").distinct()
    langs = sorted(r.lang for r in some.select("lang").distinct().collect())
    if not langs:
        return [], np.zeros((0, DIMENSION), np.float32)
    picked = rows.join(F.broadcast(some), ["doc_id", "lang"]).select("doc_id", "text", "lang")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {lang: np.zeros(DIMENSION) for lang in langs}
        for batch in batches:
            texts, lang = [t or "" for t in batch.column(1).to_pylist()], batch.column(2).to_pylist()
            for run in _runs(texts):
                for name, vector in zip(lang[run], profiles(texts[run])[0], strict=True):
                    total[name] += vector
        yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["lang", "vector"])

    sums = {lang: np.zeros(DIMENSION) for lang in langs}
    for row in picked.coalesce(8).mapInArrow(bundle, "lang string, vector binary").collect():
        sums[row.lang] += np.frombuffer(row.vector)
    protos = np.stack([sums[lang] / max(np.linalg.norm(sums[lang]), 1e-9) for lang in langs])
    protos -= protos.mean(axis=0)  # what all languages share tells none of them
    return langs, (protos / np.maximum(np.linalg.norm(protos, axis=1), 1e-9)[:, None]).astype(np.float32)


def predict(documents: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score) for every row; score is the cosine, moved to 0 to 1."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, protos = shared.value
        names = np.array([*langs, "und"], object)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for run in _runs(texts):
                got, letters = profiles(texts[run])
                if langs:
                    near = got @ protos.T
                    best = np.where(letters, near.argmax(axis=1), len(langs))
                    score = np.where(letters, np.clip((near.max(axis=1) + 1) / 2, 0, 1), 0.0)
                else:
                    best, score = np.zeros(len(got), np.int64), np.zeros(len(got))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(run.start, len(got)), pa.array(names[best], pa.string()), pa.array(score.astype(np.float64))], ["doc_id", "lang_pred", "score"])

    return texts_of(documents).mapInArrow(scan, "doc_id long, lang_pred string, score double")


def language_id(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row."""
    out = predict(documents, train(documents, sample))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
