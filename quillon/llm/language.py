"""Operator 10. Language identification by string kernels.

A text's features are the hashed n-grams (1 to 3 characters, with word borders) present in it; the kernel of two texts is
the number of shared n-grams over the root of the product of their numbers. Landmark texts give a Nyström map of that
kernel, and one-versus-rest ridge regression is solved in it by normal equations that the executors add up. As the kernel
is linear in presence, landmarks, map and weights fold into one matrix, and documents are scored by products of batches of
presence rows with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import CACHED_LENGTH, ascii_words, bounded_batches, claim, materialize
from quillon.llm.toxicity import EDGE, held_out, sample_bits

NGRAMS = (1, 2, 3)
#: Texts of a batch whose presence rows are multiplied at once.
BATCH = 256
UNKNOWN = "und"


class Presence:
    """n-gram buckets of words, kept for the words seen; a full cache starts anew."""

    def __init__(self, buckets: int, limit: int = 250_000):
        self.buckets, self.limit = buckets, limit
        self.grams: dict[str, int] = {}
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        plain = word.strip(EDGE)
        if not any(map(str.isalpha, plain)):
            return b""
        text, grams, out = f" {plain} ", self.grams, set()
        for n in NGRAMS:
            for k in range(len(text) - n + 1):
                g = text[k : k + n]
                x = grams.get(g)
                if x is None:
                    if len(grams) > self.limit:
                        grams.clear()
                    x = grams[g] = xxhash.xxh3_64_intdigest(g.encode()) % self.buckets
                out.add(x)
        return np.fromiter(out, np.uint16, len(out)).tobytes()

    def rows(self, texts: list[str | None]) -> np.ndarray:
        """A presence row for each text, divided by the root of its number of n-grams."""
        out = np.zeros((len(texts), self.buckets), np.float32)
        words = self.words
        for k, text in enumerate(texts):
            if not text:
                continue
            own = set(ascii_words(text.lower()))
            if len(words) > self.limit:
                words.clear()
            new = own.difference(words)
            for w in new:
                words[w] = self._word(w)
            at = np.frombuffer(b"".join(map(words.__getitem__, own)), np.uint16)
            for w in new:
                if len(w) > CACHED_LENGTH:
                    del words[w]
            out[k, at] = 1
        n = np.sqrt(out.sum(axis=1, keepdims=True))
        return np.divide(out, n, out=out, where=n > 0)


_presence: dict[int, Presence] = {}


def presence(buckets: int) -> Presence:
    claim("language", _presence.clear)
    return _presence.setdefault(buckets, Presence(buckets))


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray

    @property
    def buckets(self) -> int:
        return len(self.weights)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", landmarks: int = 256, max_docs: int = 5_000, buckets: int = 1 << 14, ridge: float = 1e-2) -> LanguageModel | None:
    """Fit on labelled rows with a language and a text: at most about max_docs of each language, picked by a hash of the id,
    of which about `landmarks` in all, spread over the languages, are landmarks. None if there is no such row."""
    rows = labelled.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return None
    languages = sorted(sizes)
    each = max(1, landmarks // len(languages))
    limit = F.lit(0)
    first = F.lit(0)
    for x in languages:
        limit = F.when(F.col("lang") == x, int(1_000_000 * min(1.0, max_docs / sizes[x]))).otherwise(limit)
        first = F.when(F.col("lang") == x, int(1_000_000 * min(1.0, 2 * each / sizes[x])) + 1).otherwise(first)
    rows = rows.withColumn("bits", sample_bits("id"))
    sample = bounded_batches(materialize(rows.where(F.col("bits") < limit).withColumn("mark", F.col("bits") < first), "language-sample"))

    # Landmarks' presence rows: bits of `buckets`, at most about 2 * landmarks of them, whatever their texts' lengths.
    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, BATCH):
                batch = whole.slice(k, BATCH)
                x = presence(buckets).rows(batch.column(1).to_pylist()) > 0
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([np.packbits(r).tobytes() for r in x], pa.binary())], ["id", "lang", "bits"])

    marks = sorted(sample.where("mark").select("id", "text", "lang").mapInArrow(bits, "id string, lang string, bits binary").collect(), key=lambda r: (r[1], xxhash.xxh64_intdigest((r[0] or "").encode())))
    kept, count = [], {}
    for r in marks:
        if count.setdefault(r[1], 0) < each and any(r[2]):
            count[r[1]] += 1
            kept.append(r[2])
    if not kept:
        return None
    land = np.unpackbits(np.frombuffer(b"".join(kept), np.uint8)).reshape(len(kept), -1)[:, :buckets].astype(np.float32)
    land /= np.sqrt(land.sum(axis=1, keepdims=True))
    values, vectors = np.linalg.eigh((land @ land.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    nystrom = (land.T @ (vectors[:, good] / np.sqrt(values[good]))).astype(np.float32)  # buckets x rank
    at = {x: k for k, x in enumerate(languages)}

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for whole in batches:
            for k in range(0, whole.num_rows, BATCH):
                batch = whole.slice(k, BATCH)
                x = presence(buckets).rows(batch.column(0).to_pylist()) @ nystrom
                y = -np.ones((len(x), len(languages)))
                y[np.arange(len(x)), [at[v] for v in batch.column(1).to_pylist()]] = 1
                m = np.column_stack([x, np.ones(len(x)), y]).astype(np.float64)
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            yield pa.RecordBatch.from_pydict({"m": pa.array([total.ravel().tolist()], pa.list_(pa.float64()))})

    parts = sample.select("text", "lang").mapInArrow(normal, "m array<double>")
    sums = parts.select(F.posexplode("m").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()  # (rank + 1 + languages)^2 numbers
    m = np.zeros(len(sums))
    for k, x in sums:
        m[k] = x
    size = nystrom.shape[1] + 1 + len(languages)
    m = m.reshape(size, size)
    d = nystrom.shape[1] + 1
    penalty = np.full(d, ridge * m[d - 1, d - 1] / 100)
    penalty[-1] = 1e-9
    w = np.linalg.solve(m[:d, :d] + np.diag(penalty), m[:d, d:])
    return LanguageModel(languages, (nystrom @ w[:-1].astype(np.float32)), w[-1])


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (0 to 1) for each row of docs. Null texts and texts without a letter: `und`, 0; so are all without
    a model. Equal margins: the first language by code point. One pass, no shuffle."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, BATCH):
                batch = whole.slice(k, BATCH)
                texts = batch.column(1).to_pylist()
                known = [model is not None and x is not None and any(map(str.isalpha, x)) for x in texts]
                names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if any(known):
                    margin = presence(model.buckets).rows(texts) @ model.weights + model.bias
                    best = margin.argmax(axis=1)
                    for i in np.flatnonzero(known).tolist():
                        names[i] = model.languages[best[i]]
                        scores[i] = float(min(1.0, max(0.0, (margin[i, best[i]] + 1) / 2)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

    return bounded_batches(docs.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def op10_language(spark, sf_dir: str) -> DataFrame:
    """All documents, learnt from those outside the held-out quarter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(4, 2)))
    found = identify(docs, model)
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
