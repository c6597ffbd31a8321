"""Token ids on disk: canonical length-limited Huffman codes from global counts, in independent blocks.

The file format is a Parquet dataset with one row for each block (``part``, ``block``: ascending, and so are
the documents in them). A block holds whole documents: ``doc_ids``, ``doc_tokens``, ``first`` (ids in the part
before this block), ``n_tokens``, ``checkpoints`` (the bit offset of every ``CHECKPOINT``-th id, uint32) and
``payload`` (the code words, most significant bit first). Beside it stands ``code``, one row with the code
lengths of all ids; canonical codes follow from the lengths alone.

Decoding needs only the code and one block. All checkpoints of a block are decoded in step: at each step one
table lookup of the next ``limit`` bits gives each stretch its id and the bits it took.

Null texts are empty, a null doc_id is kept and comes first, repeated rows are separate documents (ties in
doc_id are ordered by their ids), an empty table gives no blocks. Columns besides ``doc_id`` and ``text`` are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signflow.llm.common import ByteBpe, encoder, joined, prepare, texts_of
from signflow.session import discard, materialize, scratch

#: Ids between two checkpoints, and about how many ids a block holds.
CHECKPOINT, BLOCK = 128, 1 << 18
BLOCKS = "part int, block int, doc_ids array<bigint>, doc_tokens array<bigint>, first bigint, n_tokens bigint, checkpoints binary, payload binary"


def encode_ids(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens, width, ids (compressed byte planes, ``width`` of each id): every whole text's ids and ``end_id``.

    Each task adds a row of its own, all null but ``tally``: how often each id occurs in its documents (compressed int64).
    """
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "n_tokens", "width", "ids", "tally"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, total = encoder(ByteBpe, path), np.zeros(0, np.int64)
        for b in joined(batches):
            n, wide, out = [], [], []
            held, size = [], 0
            for raw in encode.texts(texts_of(b)):
                ids = np.frombuffer(raw + end, "<u4")
                n.append(len(ids))
                wide.append(2 if ids.max() < 65536 else 4)
                planes = ids.view("u1").reshape(-1, 4).T[: wide[-1]]  # byte planes pack better
                out.append(pa.compress(planes.tobytes(), "zstd", asbytes=True))
                held.append(ids)
                size += len(ids)
                if size >= BLOCK:
                    total, held, size = added(total, held), [], 0
            total = added(total, held)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(wide, pa.int32()), pa.array(out, pa.binary()), pa.nulls(len(n), pa.binary())], names)
        if len(total):
            tally = pa.compress(total.astype("<i8").tobytes(), "zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.binary())), pa.array([len(total).to_bytes(4, "little") + tally], pa.binary())], names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, width int, ids binary, tally binary")


def added(total: np.ndarray, held: list[np.ndarray]) -> np.ndarray:
    """``total`` and the counts of the ids held: of many documents at once, as each count passes over the vocabulary."""
    if not held:
        return total
    c = np.bincount(np.concatenate(held), minlength=len(total))
    c[: len(total)] += total
    return c


def unpack_ids(data: bytes, n: int, width: int) -> np.ndarray:
    """The ids that ``encode_ids`` packed."""
    planes = np.frombuffer(pa.decompress(data, decompressed_size=width * n, codec="zstd"), np.uint8).reshape(width, n)
    out = planes[0].astype("<u4")
    for k in range(1, width):
        out |= planes[k].astype("<u4") << np.uint32(8 * k)
    return out


def id_counts(ids: DataFrame) -> DataFrame:
    """id, n: how often each id occurs in all documents, from the tasks' tallies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("tally").to_pylist():
                total = np.frombuffer(pa.decompress(data[4:], decompressed_size=8 * int.from_bytes(data[:4], "little"), codec="zstd"), "<i8")
                seen = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return ids.where("tally is not null").select("tally").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    is_leaf, packages = [], np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([leaves, packages])
        rank = np.argsort(merged, kind="stable")
        is_leaf.append(rank < len(leaves))
        merged = merged[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take, length = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for row in reversed(is_leaf):  # of each level's cheapest items, leaves get a bit and packages open two below
        n = int(row[:take].sum())
        length[:n] += 1
        take = 2 * (take - n)
    out[order] = length
    return out


class Code:
    """Canonical codes from lengths: shorter codes first, then smaller ids."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.limit = max(1, int(self.lengths.max(initial=0)))
        order = np.lexsort((np.arange(len(lengths)), self.lengths))
        order = order[self.lengths[order] > 0]
        span = np.int64(1) << (self.limit - self.lengths[order])
        first = np.cumsum(span) - span
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = first.astype(np.uint64) << np.uint64(64 - self.limit)  # at the upper end
        self.table = np.ones(1 << self.limit, np.uint32)  # id and, in the lowest 5 bits, the length of its code
        if len(order):
            self.table[: span.sum()] = np.repeat(order << 5 | self.lengths[order], span)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The code words of ``ids`` and the bit offsets of every ``CHECKPOINT``-th id."""
        bits = self.lengths.take(ids)
        at = np.cumsum(bits) - bits
        total = int(at[-1] + bits[-1])
        word = at >> 5
        piece = self.codes.take(ids) >> (at & 31).view(np.uint64)  # a code of up to 32 bits ends in the next word
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        both = np.bitwise_or.reduceat(piece, starts)
        out = np.zeros((total >> 5) + 2, np.uint32)
        out[word[starts]] = (both >> np.uint64(32)).astype(np.uint32)
        out[word[starts] + 1] |= (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return out.astype(">u4").tobytes()[: (total + 7) // 8], at[::CHECKPOINT].astype("<u4")

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` ids of a block, all its checkpoints in step."""
        raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.int64)
        ahead = raw[:-4] << 32  # 40 bits from each byte on
        for k in range(1, 5):
            ahead |= raw[k : len(raw) - 4 + k] << (32 - 8 * k)
        at = checkpoints.astype(np.int64)
        out = np.empty((CHECKPOINT, len(at)), np.uint32)
        mask, drop = (1 << self.limit) - 1, 40 - self.limit
        for row in out:
            got = ahead.take(at >> 3, mode="clip")  # the last stretch may run past the end
            got >>= drop - (at & 7)
            got &= mask
            self.table.take(got, mode="clip", out=row)
            at += row & 31
        return (out >> 5).T.ravel()[:n]


def write_blocks(ids: DataFrame, lengths: np.ndarray, path: str, block: int = BLOCK) -> None:
    """Write the blocks of all documents in ascending doc_id order."""
    data = lengths.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, k, first = Code(np.frombuffer(data, np.uint8)), TaskContext.get().partitionId(), 0, 0
        docs, sizes, held, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            stream = np.concatenate(held)
            payload, checkpoints = code.encode(stream)
            row = [[part], [k], [docs], [sizes], [first], [len(stream)], [checkpoints.tobytes()], [payload]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])

        for b in batches:
            for d, n, width, x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_tokens", "width", "ids")), strict=True):
                if held and size + n > block:
                    yield close()
                    k, first, docs, sizes, held, size = k + 1, first + size, [], [], [], 0
                docs.append(d)
                sizes.append(n)
                size += n
                held.append(unpack_ids(x, n, width))
        if held:
            yield close()

    # Rows of one doc_id (or of none) may be many: they are dealt by what else they hold
    keys = ["doc_id", "n_tokens", "hash_"]
    ids = ids if "hash_" in ids.columns else ids.withColumn("hash_", F.xxhash64("ids"))
    ordered = ids.repartitionByRange(*keys).sortWithinPartitions(*keys, "ids").drop("hash_")
    ordered.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    ids.sparkSession.createDataFrame([(bytes(data),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, limit: int = 20) -> None:
    """Encode every text of ``docs`` and write the token files to ``path``. ``limit``: most bits of a code."""
    prepare(docs.sparkSession)
    rows, temp = materialize(encode_ids(docs, tokenizer, end_id).withColumn("hash_", F.xxhash64("ids")), "ids")  # so that ranges are drawn without reading the ids
    ids = rows.where("tally is null").drop("tally")
    found = np.array([(r["id"], r["n"]) for r in id_counts(rows).collect()], np.int64).reshape(-1, 2)  # a row for each id of the vocabulary at most
    counts = np.zeros(int(found[:, 0].max(initial=0)) + 1, np.int64)
    counts[found[:, 0]] = found[:, 1]
    write_blocks(ids, code_lengths(counts, limit), path)
    discard(docs.sparkSession, temp)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, and ``ids`` if asked for."""
    prepare(spark)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    data = spark.read.parquet(f"{path}/code").first()["lengths"]
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # one row for each file
    before, at = {}, 0
    for r in sorted(totals, key=lambda r: r["part"]):
        before[r["part"]], at = at, at + r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(np.frombuffer(data, np.uint8))
        for b in batches:
            for r in b.to_pylist():
                ids = code.decode(r["payload"], np.frombuffer(r["checkpoints"], "<u4"), r["n_tokens"]).astype("<u4")
                ends = np.cumsum(r["doc_tokens"])
                starts = ends - r["doc_tokens"]
                crc = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts, ends, strict=True)]
                columns = [pa.array(r["doc_ids"], pa.int64()), pa.array(starts + before[r["part"]] + r["first"], pa.int64()), pa.array(r["doc_tokens"], pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array([ids[s:e].astype(np.int32) for s, e in zip(starts, ends, strict=True)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    return blocks.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def token_report(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the token files of ``docs`` to a shared folder and report each document from what is read back."""
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path)
