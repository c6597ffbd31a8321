"""Quality rules, and an isolation forest over their statistics.

The base rules count words, symbols, repeated lines and repeated three-word windows of every whole text. The
forest is grown on rule statistics of good labelled documents (a bounded, hashed sample), with random splits over
the range of all labelled ones: documents that few splits part from the good ones are anomalous. The score from
which a document is dropped is set on all good labelled documents, so that at most ``LOSS`` of them go.

Null and empty texts have no words and fail the base rule. Repeated rows get equal verdicts, a null doc_id is
kept, very long texts count whole, without labels the base rule decides alone, an empty table gives no rows.
Columns besides those named are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from signflow.llm.common import prepare, texts_of
from signflow.session import discard, materialize

#: Labelled documents that the trees are grown on, at most.
MAX_LABELLED = 6000
#: Trees, and the documents each grows on.
TREES, GROWN_ON = 100, 256
#: Share of good labelled documents that may be dropped.
LOSS = 0.005

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Further statistics that only the forest uses: capital letters, exclamation marks, lines.
MORE = ["n_capitals", "n_marks", "n_lines"]


def rule_stats(text: str) -> tuple[int, ...]:
    """STATS and MORE of one text. Words are parted by ASCII white space."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    solid = len(raw.translate(None, b" \t\n\r\x0b\f"))
    lines = raw.split(b"\n")
    dup = 0
    if len(set(lines)) < len(lines):
        dup = sum(n - 1 for line, n in Counter(lines).items() if n > 1 and line.strip(b" \t\n\r\x0b\f"))
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeat = 0
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        covered = np.zeros(len(words), bool)
        at = np.array([i for i, w in enumerate(windows) if counts[w] > 1])
        for k in range(3):
            covered[at + k] = True
        repeat = int(covered.sum())
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    return len(words), len(text) - len(raw) + solid, without(b"#*$%&|<>"), dup, repeat, without(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), without(b"!"), len(lines)


def features(stats: np.ndarray) -> np.ndarray:
    """What the forest splits on: shares and means per word or line, and the length's logarithm."""
    n, chars, symbols, dup, repeat, capitals, marks, lines = stats.astype(np.float64).T
    per = np.maximum(n, 1)
    return np.stack([np.log1p(n), chars / per, symbols / per, dup / np.maximum(lines, 1), repeat / per, capitals / per, marks / per], 1)


def expected_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


@dataclass
class Forest:
    """Complete trees as arrays (trees x nodes): split feature, threshold, and at leaves the path length."""

    feature: np.ndarray
    threshold: np.ndarray
    path: np.ndarray
    norm: float
    cutoff: float = 2.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score from 0 to 1 of each row."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, threshold, path in zip(self.feature, self.threshold, self.path, strict=True):
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                right = x[rows, np.maximum(feature[at], 0)] >= threshold[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            total += path[at]
        return np.exp2(-total / len(self.feature) / self.norm)


def grow(x: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, size: int = GROWN_ON, seed: int = 0) -> Forest:
    """An isolation forest on rows ``x``; splits are random over the box ``low`` to ``high``, in which rows may be missing."""
    rng = np.random.default_rng(seed)
    size = min(size, len(x))
    depth = max(1, int(np.ceil(np.log2(max(size, 2)))) + 1)
    nodes = 2 ** (depth + 1) - 1
    out = Forest(np.full((trees, nodes), -1, np.int64), np.zeros((trees, nodes)), np.zeros((trees, nodes)), max(expected_path(size), 1.0))
    for t in range(trees):
        work = [(0, x[rng.choice(len(x), size, replace=False)], low, high, 0)]
        while work:
            at, rows, least, most, level = work.pop()
            free = np.flatnonzero(most > least)
            if level == depth or len(rows) <= 1 or not len(free):
                out.path[t, at] = level + expected_path(len(rows))
                continue
            f = rng.choice(free)
            cut = rng.uniform(least[f], most[f])
            cut = cut if cut > least[f] else most[f]
            out.feature[t, at], out.threshold[t, at] = f, cut
            right, below, above = rows[:, f] >= cut, most.copy(), least.copy()
            below[f] = above[f] = cut
            work += [(2 * at + 1, rows[~right], least, below, level + 1), (2 * at + 2, rows[right], above, most, level + 1)]
    return out


def with_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with STATS and MORE."""
    prepare(docs.sparkSession)
    names = [*STATS, *MORE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = np.array([rule_stats(t) for t in texts_of(b)], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(c) for c in stats.T)], [*keep, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}, {', '.join(f'{c} bigint' for c in names)}")


def with_anomaly(stats: DataFrame, forest: Forest) -> DataFrame:
    """A table with STATS and MORE, and ``anomaly``."""
    held = stats.sparkSession.sparkContext.broadcast(forest)  # bounded: trees x nodes
    names = stats.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in (*STATS, *MORE)], 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(held.value.score(features(x)))], [*names, "anomaly"])

    return stats.mapInArrow(run, StructType([*stats.schema.fields, StructField("anomaly", DoubleType())]))


def fit(stats: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, loss: float = LOSS) -> Forest | None:
    """Grow the forest on a sample of good labelled documents, over the range of all, and set its cutoff on all; None without good ones.

    ``stats``: doc_id, STATS and MORE of all documents; read several times, so give a written table. Texts never meet
    the labels: only the statistics are joined.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows, path = materialize(stats.join(known, "doc_id"), "labelled")
    try:
        columns = [*STATS, *MORE]
        n, chars, symbols, dup, repeat, capitals, marks, lines = map(F.col, columns)
        per = F.greatest(n, F.lit(1))
        box = [n, chars / per, symbols / per, dup / F.greatest(lines, F.lit(1)), repeat / per, capitals / per, marks / per]
        ends = rows.agg(*[f(c).cast("double").alias(f"{k}{i}") for i, c in enumerate(box) for k, f in (("low", F.min), ("high", F.max))]).first()
        good = rows.where((F.col("quality") == 1) & ~base_failed(F.col("n_words"), F.col("n_repeat_words")))
        sample = good.orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id", *columns).limit(most).select(*columns).toPandas()
        if not len(sample):
            return None
        low, high = (np.array([ends[f"{k}{i}"] for i in range(len(box))]) for k in ("low", "high"))
        low[0], high[0] = np.log1p(low[0]), np.log1p(high[0])
        x = features(sample.to_numpy())
        forest = grow(x[np.lexsort(x.T)], low, high)  # the same forest, however the rows arrive
        # Bins of a hundred-thousandth, rounded up so that no more than LOSS go: the aggregate's size is bounded
        scores = with_anomaly(good.select(*columns), forest)
        forest.cutoff = float(scores.agg(F.percentile(F.ceil(F.col("anomaly") * 1e5) / 1e5, F.lit(1 - loss))).first()[0])
        return forest
    finally:
        discard(stats.sparkSession, path)


def base_failed(n_words, n_repeat_words):
    """Too few words, or more than half of them repeated. Takes arrays or columns."""
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def judge(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, loss: float = LOSS) -> DataFrame:
    """doc_id, STATS, base_failed, kept and the anomaly score of every document. Texts are read once."""
    stats, _ = materialize(with_stats(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ["doc_id"]), "stats")
    forest = fit(stats, labels, most, loss)
    scored = with_anomaly(stats, forest) if forest else stats.withColumn("anomaly", F.lit(0.0))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return scored.select("doc_id", *STATS, failed.alias("base_failed"), (~failed & (F.col("anomaly") <= (forest.cutoff if forest else 1.0))).alias("kept"), "anomaly")
