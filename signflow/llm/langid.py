"""Language identification by error-correcting output codes over byte n-grams.

Every language has a binary codeword. For each bit a naive Bayes classifier over hashed byte n-grams tells the
languages with a 1 from those with a 0; its n-gram log-odds are learned from a bounded, hashed sample of the
labelled rows. A text's bit values are summed over the whole text. Decoding takes the codeword with the least
logistic loss, each bit weighted by how well its classifier does on the sample; where the second codeword is
nearly as close the row is flagged ambiguous.

``und`` goes to null texts and texts without a letter, with score 0. Repeated rows get equal answers, a null
doc_id is kept (and in no fold), very long texts are read in pieces but as a whole, without labelled rows every
text is ``und``, an empty table gives no rows. Columns besides ``doc_id``, ``text`` and ``lang`` are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from signflow.llm.common import concat_bytes, fold, prepare, slices, texts_of

#: Lengths of the n-grams, and the bits of their hashes.
ORDERS, HASH_BITS = (2, 3, 4), 15
#: Labelled documents of one language to learn from, at most.
MAX_PER_LANG = 4000
#: The second codeword's share of the decoded probability from which a row is ambiguous.
AMBIGUOUS = 0.4


def ngram_hashes(data: np.ndarray, order: int) -> np.ndarray:
    """The hash of the n-gram that starts at each byte (n - 1 zero bytes follow the end)."""
    padded = np.concatenate([data, np.zeros(order - 1, np.uint8)]).astype(np.uint32)
    value = padded[: len(data)].copy()
    for k in range(1, order):
        value = (value << np.uint32(8)) | padded[k : k + len(data)]
    return ((value * np.uint32(2654435769)) >> np.uint32(32 - HASH_BITS)).astype(np.int64)


def codewords(n: int) -> np.ndarray:
    """Codewords of n languages, in rows: all splits in two for up to 5, else rows of a hashed random matrix."""
    if n <= 5:
        columns = [c for c in itertools.product((0, 1), repeat=n) if c[0] == 1 and 0 < sum(c) < n]
        return np.array(columns, np.int8).reshape(-1, n).T
    bits = max(15, int(np.ceil(10 * np.log2(n))))
    return np.random.default_rng(n).integers(0, 2, (n, bits)).astype(np.int8)


@dataclass
class Model:
    """langs; code (langs x bits); weights (orders x bits x hashes); trust and scale of each bit."""

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray
    scale: np.ndarray

    def bits(self, texts: list[str]) -> np.ndarray:
        """Each text's mean log-odds of each bit."""
        data, offsets = concat_bytes(texts)
        out = np.zeros((len(texts), self.code.shape[1]))
        full = np.flatnonzero(np.diff(offsets))
        if not len(full):
            return out
        for order, weights in zip(ORDERS, self.weights, strict=True):
            at = ngram_hashes(data, order)
            for j, w in enumerate(weights):
                out[full, j] += np.add.reduceat(w[at], offsets[full], dtype=np.float64)
        out[full] /= np.diff(offsets)[full, None]
        return out

    def decode(self, bits: np.ndarray, n_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The codeword of the least weighted loss, its probability, and whether the row is ambiguous."""
        margin = np.clip(bits * self.scale * np.sqrt(np.minimum(n_bytes, 400))[:, None], -30, 30)
        sign = 2 * self.code.astype(np.float64) - 1
        loss = (np.logaddexp(0, -margin[:, None, :] * sign[None]) * self.trust).sum(-1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        second = np.sort(p, 1)[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        return best, p[np.arange(len(p)), best], second >= AMBIGUOUS


def train(docs: DataFrame, learn: Column, per_lang: int = MAX_PER_LANG) -> Model | None:
    """Learn from the rows of ``docs`` where ``learn`` holds and lang is not null; None without any.

    The n-gram counts of each language are summed in the tasks; the driver gets one row of counts for each
    language and order, whatever the input.
    """
    prepare(docs.sparkSession)
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n_rows = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row for each language
    langs = sorted(n_rows)
    if not langs:
        return None
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, per_lang / n_rows[k])))])
    uniform = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.where(uniform < F.element_at(share, F.col("lang"))).select("lang", "text")
    index = {k: i for i, k in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), len(ORDERS), 1 << HASH_BITS), np.int64)
        for b in batches:
            at = np.array([index[x] for x in b.column("lang").to_pylist()])
            texts = texts_of(b)
            for s, e in slices(texts):
                data, offsets = concat_bytes(texts[s:e])
                owner = np.repeat(at[s:e], np.diff(offsets))
                for k, order in enumerate(ORDERS):
                    total[:, k] += np.bincount((owner << HASH_BITS) + ngram_hashes(data, order), minlength=len(langs) << HASH_BITS).reshape(len(langs), -1)
        for i, k in zip(*np.nonzero(total.any(-1)), strict=True):
            seen = np.flatnonzero(total[i, k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), i), pa.int32()), pa.array(np.full(len(seen), k), pa.int32()), pa.array(seen, pa.int32()), pa.array(total[i, k, seen], pa.int64())], ["lang", "k", "at", "n"])

    counted = sample.mapInArrow(count, "lang int, k int, at int, n bigint").groupBy("lang", "k", "at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(langs), len(ORDERS), 1 << HASH_BITS))
    counts[counted["lang"], counted["k"], counted["at"]] = counted["n"]
    code = codewords(len(langs))
    shares = (counts + 0.5) / (counts + 0.5).sum(-1, keepdims=True)
    weights = np.zeros((len(ORDERS), code.shape[1], 1 << HASH_BITS), np.float32)
    for j, column in enumerate(code.T):
        weights[:, j] = np.log(shares[column == 1].mean(0)) - np.log(shares[column == 0].mean(0))
    model = Model(langs, code, weights, np.ones(code.shape[1]), np.ones(code.shape[1]))
    return calibrate(model, sample, index)


def calibrate(model: Model, sample: DataFrame, index: dict[str, int]) -> Model:
    """Set each bit's scale from its spread, and its trust from its errors, over the sample."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b)
            for s, e in slices(texts):
                value = model.bits(texts[s:e])
                truth = model.code[[index[x] for x in b.column("lang").to_pylist()[s:e]]]
                for j in range(value.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([len(value)], pa.int64()), pa.array([int(((value[:, j] > 0) != truth[:, j]).sum())], pa.int64()), pa.array([float(np.abs(value[:, j]).sum())])], ["bit", "n", "wrong", "size"])

    found = sample.mapInArrow(measure, "bit int, n bigint, wrong bigint, size double").groupBy("bit").agg(F.sum("n").alias("n"), F.sum("wrong").alias("wrong"), F.sum("size").alias("size")).collect()
    for r in found:
        wrong = (r["wrong"] + 1) / (r["n"] + 2)
        model.trust[r["bit"]] = max(0.05, np.log((1 - wrong) / wrong)) / 4
        model.scale[r["bit"]] = 0.5 / max(r["size"] / r["n"], 1e-6)
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """The columns of ``docs`` with ``lang_pred``, ``score`` and ``ambiguous`` (which replace columns so named); ``docs`` needs a ``text``."""
    prepare(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "ambiguous", "has_letter_")
    if model is None or len(model.langs) < 2:
        only = model.langs[0] if model else "und"
        named = F.col("text").rlike(r"\p{L}")
        return docs.withColumns({"lang_pred": F.when(named, F.lit(only)).otherwise("und"), "score": F.when(named & F.lit(model is not None), 1.0).otherwise(0.0), "ambiguous": F.lit(False)})
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded: orders x bits x hashes
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            texts, letters = texts_of(b), np.array(b.column("has_letter_").to_pylist(), bool)
            langs, scores, doubts = [], [], []
            for s, e in slices(texts):
                value = m.bits(texts[s:e])
                best, score, doubt = m.decode(value, np.array([max(1, len(t)) for t in texts[s:e]]))
                langs += [m.langs[i] for i in best]
                scores.append(score)
                doubts.append(doubt)
            score = np.where(letters, np.concatenate(scores), 0.0)
            langs = [x if ok else "und" for x, ok in zip(langs, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(langs), pa.array(score), pa.array(np.concatenate(doubts) & letters)], [*names, "lang_pred", "score", "ambiguous"])

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("ambiguous", BooleanType())])
    marked = docs.withColumn("has_letter_", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return marked.mapInArrow(run, schema)


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2, per_lang: int = MAX_PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous; learns from the rows outside the held-out fold."""
    out = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False))
    model = train(docs, ~out, per_lang)
    found = predict(docs.select(F.col("doc_id").cast("bigint"), "text"), model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "ambiguous")
