"""Which filter removes what, for every order in which filters can be applied.

Each document gets a mask with a bit for each filter that it fails. All that an audit asks of a document depends on
its mask, so a part's documents are a histogram over the masks (all of them, those of good quality, toxic ones),
and every outcome at every step of every order is one column of an integer incidence matrix (masks x orders * steps):
histograms as rows times the matrices of kept, removed, redundant and unique outcomes are the whole result.

Copies are told by 128-bit hashes of whole texts; the texts themselves are read once and never shuffled. A text with
many copies is split off as hot, labels count once for an id (as 1 if any is), and the histograms are summed before
they are shuffled. The rows of a part are 3 x masks numbers, whatever its documents.

A null text is empty (and a copy of empty ones), a null part is the empty string. A row with a null doc_id is no
copy of another and has no labels, nor is another a copy of it. Rows of one doc_id are separate documents, and none
is a copy of the other by that id. Very long texts are read whole, an empty table gives no rows, columns besides
``doc_id``, ``text`` and ``lang`` are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signflow.functions.skew import join_hot
from signflow.llm.common import prepare
from signflow.session import discard, materialize

LETTERS = "ABCDE"
#: Failure limits: words; distinct words and capitals in a hundred.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
CAPITALS, SYMBOLS, CONTINUED = bytes(range(65, 91)), b"#$%&*|", bytes(range(128, 192))


def text_mask(raw: bytes) -> int:
    """Bits 0 to 3: whether a UTF-8 text fails A, B, C, D."""
    words = raw.split()  # of bytes: at ASCII white space alone
    size = len(raw)
    points = size - (0 if raw.isascii() else size - len(raw.translate(None, CONTINUED)))
    capitals = size - len(raw.translate(None, CAPITALS))
    return (len(words) < LEAST_WORDS) | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1 | (100 * capitals > MOST_CAPITALS * points) << 2 | (len(raw.translate(None, SYMBOLS)) < size) << 3


def masks(docs: DataFrame, labels: DataFrame, part: Column) -> tuple[DataFrame, list[str]]:
    """part, mask, good, toxic of each document; and the scratch tables it reads."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [t or b"" for t in b.column("raw").to_pylist()]
            hashes = [hashlib.blake2b(t, digest_size=16).digest() for t in raw]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array([text_mask(t) for t in raw], pa.int32()), pa.array(hashes, pa.binary())], ["doc_id", "part", "mask", "hash"])

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(part, F.lit("")).alias("part"), F.col("text").cast("binary").alias("raw")).mapInArrow(run, "doc_id bigint, part string, mask int, hash binary")
    slim, one = materialize(slim, "masks")
    copies = slim.groupBy("hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null")
    copies, two = materialize(copies, "copies")
    told = join_hot(slim, copies, ["hash"], "copies", slim.count(), "left")
    told = told.select("doc_id", "part", (F.col("mask") + F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)).alias("mask"))
    hit = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(hit("quality").alias("good"), hit("toxic").alias("toxic")).where("good + toxic > 0")
    few = told.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))  # the rows of one id are few by now: parts x masks
    named = few.where("doc_id is not null").join(known, "doc_id", "left")
    nameless = few.where("doc_id is null").withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    return named.unionByName(nameless).select("part", "mask", "n", *[(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("good", "toxic")]), [one, two]


def incidence(k: int) -> tuple[list[tuple[int, ...]], dict[str, np.ndarray]]:
    """All orders of k filters, and by outcome the matrix (masks x orders * steps) of 0 and 1; ``shapley``: removals by the step's filter in all orders together."""
    orders = list(itertools.permutations(range(k)))
    mask = np.arange(1 << k)[:, None]
    bit = np.array([1 << f for order in orders for f in order])
    before = np.array([sum(1 << f for f in order[:s]) for order in orders for s in range(k)])
    fails, gone = (mask & bit) > 0, (mask & before) > 0
    out = {"kept": ~gone & ~fails, "removed": ~gone & fails, "redundant": gone & fails, "unique_fails": mask == bit}
    out = {name: m.astype(np.int64) for name, m in out.items()}
    out["shapley"] = out["removed"] @ (bit[:, None] == bit).astype(np.int64)
    return orders, out


OUT = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def outcomes(found: DataFrame, letters: str = LETTERS) -> DataFrame:
    """The outcomes of every part, order and step from part, mask, n, good, toxic (numbers of documents, any number of rows for a mask)."""
    counted = found.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    by_part = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # as many as there are masks at most
    k = len(letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, matrix = incidence(k)
        names, steps = ["".join(letters[f] for f in order) for order in orders for _ in order], np.tile(np.arange(1, k + 1), len(orders))
        for b in batches:
            for part, cells in zip(b.column("part").to_pylist(), b.column("cells").to_pylist(), strict=True):
                rows = np.zeros((3, 1 << k), np.int64)
                for c in cells:
                    rows[:, c["mask"]] = c["n"], c["good"], c["toxic"]
                values = [rows[0] @ matrix[x] for x in ("kept", "removed", "redundant", "unique_fails")] + [rows[i] @ matrix["removed"] for i in (1, 2)] + [rows[0] @ matrix["shapley"]]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(steps), pa.string()), pa.array(names, pa.string()), pa.array(steps, pa.int32()), *map(pa.array, values)], [x.split()[0] for x in OUT.split(", ")])

    return by_part.mapInArrow(run, OUT)


def report(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The outcomes of filters A to E on ``docs``, by ``part``."""
    found, paths = masks(docs, labels, F.col(part).cast("string"))
    table, _ = materialize(found.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")]), "histograms")  # small; stays for whoever reads the result
    discard(docs.sparkSession, *paths)
    return outcomes(table)
