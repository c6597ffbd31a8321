"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Every text becomes the set of its five-word shingles (64-bit hashes; a shorter text is one shingle). Equal sets
are one class. Each class has a signature of ``DEPTH`` min-hashes in each of ``TREES`` trees. All signatures are
sorted by tree, and each row is told how long a prefix it shares with the row before it: that is the tree's
prefix trie, whose subtries are runs of rows. Matching begins at whole signatures. Prefixes are then shortened,
one tree at a time and the tree first that lets in the fewest further matches, until a pair as unlike as the least
similar link found so far is met with the target recall (without a link, a pair at the threshold); with the
links that shorter prefixes bring, that is asked again. A pair met at longer prefixes is not verified again.

Classes that share a prefix with a neighbour form components. A component that fits a block is checked by itself. A
larger one is checked in pairs of bounded blocks: by subtrie, each pair of classes in the first tree where they meet,
so that a chain of subtries never makes unrelated classes travel together; or, if its subtries are so large that this
would move more rows (many near copies of one text), as a whole. No task holds more than two blocks, and a class of a
group travels once for each of its group's blocks, which is quadratic in the distinct near copies over the block size. Tasks give back counts of links, their similarities in steps of a hundredth, and a spanning
forest, never all pairs. No subtrie is cut and no pair of one is lost.

Null texts and texts without words have no shingles: each is alone, without links. Copies count as links of each
other. Repeated rows of one doc_id are separate documents in the counts, whatever their texts; a null doc_id
takes no part. Very long texts are read whole. An empty table gives no rows. Columns besides ``doc_id`` and
``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signflow.functions.skew import join_hot, look_up
from signflow.llm.common import concat_bytes, prepare, slices, texts_of
from signflow.operators.graph import components
from signflow.session import discard, materialize

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.99999
#: Trees of the forest, min-hashes of a full signature.
TREES, DEPTH = 24, 6
#: Shingles in a block, and classes in it, at about most.
BLOCK_SHINGLES, BLOCK_CLASSES = 100_000, 256
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    up, down = np.full(n, _ODD), np.full(n, inverse)
    up[:1] = down[:1] = 1
    return np.cumprod(up), np.cumprod(down)


def shingles(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes. Words are parted by ASCII white space."""
    data, offsets = concat_bytes(texts)
    if not len(data):
        return [np.zeros(0, np.uint64)] * len(texts)
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    starts_of_texts = offsets[:-1][np.diff(offsets) > 0]
    first[starts_of_texts] = solid[starts_of_texts]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends_of_texts = offsets[1:][np.diff(offsets) > 0] - 1
    last[ends_of_texts] = solid[ends_of_texts]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    hashes = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    bounds = np.searchsorted(begin, offsets)
    chained = hashes.copy()
    for k in range(1, words):
        chained[: len(hashes) - k] += hashes[k:] * np.uint64(int(_ODD) ** (k + 1) & 0xFFFFFFFFFFFFFFFF)
    chained = mix(chained)
    out = []
    for s, e in zip(bounds, bounds[1:], strict=False):
        n = e - s
        if n >= words:
            out.append(np.unique(chained[s : e - words + 1]))
        elif n:
            own = int(n)
            for h in hashes[s:e].tolist():
                own = (own * int(_ODD) + h) & 0xFFFFFFFFFFFFFFFF
            out.append(mix(np.array([own], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def met(similarity: float, depths: list[int]) -> float:
    """How surely a pair of this similarity shares a prefix of its tree's length in some tree."""
    return 1 - float(np.prod([1 - similarity**d for d in depths]))


def floor_depth(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The length that no tree's prefix needs to go below: at it a pair at the threshold is met with the target recall."""
    while depth > 1 and met(threshold, [depth] * trees) < recall:
        depth -= 1
    return depth


def shortened(depths: list[int], similarity: float, recall: float, adds: dict[tuple[int, int], int], floor: int) -> list[int]:
    """Lengths at which pairs of ``similarity`` are met with ``recall``. ``adds``: rows of (tree, shared length) in the tries.

    One tree after the other gives up a min-hash: the one with the most gain for the matches it lets in.
    """
    depths = list(depths)
    while met(similarity, depths) < recall and max(depths) > floor:

        def worth(t: int) -> float:
            gain = np.log1p(-(similarity ** depths[t])) - np.log1p(-(similarity ** (depths[t] - 1)))
            return gain / (1 + adds.get((t, depths[t] - 1), 0))

        best = max((t for t in range(len(depths)) if depths[t] > floor), key=worth)
        depths[best] -= 1
    return depths


def signatures(sets: list[np.ndarray], trees: int, depth: int) -> np.ndarray:
    """Each set's min-hashes (sets x trees * depth), tree by tree."""
    rng = np.random.default_rng(20)
    factors = rng.integers(1, 1 << 31, trees * depth, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    added = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint64).astype(np.uint32)
    flat = np.concatenate(sets)
    low = (flat >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.zeros((len(sets), trees * depth), np.uint32)
    for k in range(trees * depth):
        h = low * factors[k] + added[k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        out[:, k] = np.minimum.reduceat(h, at)
    return out


def sketch(docs: DataFrame, trees: int, depth: int) -> DataFrame:
    """doc_id, text_hash, n (shingles), set hash (two halves), sig (the signatures' bytes) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b)
            for s, e in slices(texts, 1_000_000):
                sets = shingles(texts[s:e])
                full = [i for i, x in enumerate(sets) if len(x)]
                sig = [b""] * (e - s)
                if full:
                    for i, row in zip(full, signatures([sets[i] for i in full], trees, depth), strict=True):
                        sig[i] = row.tobytes()
                one = [int(np.bitwise_xor.reduce(x)) if len(x) else 0 for x in sets]
                two = [int(mix(x * _ODD).sum(dtype=np.uint64)) if len(x) else 0 for x in sets]
                columns = [*(b.column(c).slice(s, e - s) for c in ("doc_id", "text_hash")), pa.array([len(x) for x in sets], pa.int64()), pa.array(np.array(one, np.uint64).view(np.int64)), pa.array(np.array(two, np.uint64).view(np.int64)), pa.array(sig, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n", "one", "two", "sig"])

    return docs.mapInArrow(run, "doc_id bigint, text_hash bigint, n bigint, one bigint, two bigint, sig binary")


def tries(classes: DataFrame, trees: int, depth: int, floor: int) -> tuple[DataFrame, str]:
    """tree, cid, shared, heads: of each row of a tree's sorted signatures that shares at least ``floor`` min-hashes with the row before, how many, and the first class of its run at each length from ``floor`` on; and where they are written.

    Rows are sorted by ranges of (tree, signature, class), which are unique, so equal signatures never pile up. The
    driver gets the first and last row of each range, to compare them across the ranges' borders.
    """
    spark, width = classes.sparkSession, 4 * depth
    label = lambda t: F.substring("sig", t * width + 1, width)
    rows = classes.select("cid", F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), label(t).alias("label")) for t in range(trees)])).alias("x")).select("x.tree", "x.label", "cid")
    ordered = rows.repartitionByRange("tree", "label", "cid").sortWithinPartitions("tree", "label", "cid")

    def shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.cumprod(x == y, 1).sum(1)

    lengths = range(floor, depth + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, names = TaskContext.get().partitionId(), None, ["tree", "cid", "shared", "heads", "part", "label"]
        heads = [0] * len(lengths)  # of the runs that go on

        def border(row: tuple) -> pa.RecordBatch:
            tree, cid, bytes_ = row
            return pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([cid], pa.int64()), pa.array([-1], pa.int32()), pa.array([None], pa.list_(pa.int64())), pa.array([part], pa.int32()), pa.array([bytes_], pa.binary())], names)

        for b in batches:
            if not b.num_rows:
                continue
            tree, cid = np.asarray(b.column("tree")), np.asarray(b.column("cid"))
            labels = np.frombuffer(b"".join(b.column("label").to_pylist()), np.uint32).reshape(-1, depth)
            if last is None:
                yield border((tree[0], cid[0], labels[0].tobytes()))
                last = (-1, labels[0].tobytes())
            before_tree = np.concatenate([[last[0]], tree[:-1]])
            before = np.concatenate([np.frombuffer(last[1], np.uint32)[None], labels[:-1]])
            length = np.where(before_tree == tree, shared(before, labels), 0)
            own = np.zeros((len(cid), len(lengths)), np.int64)
            for j, d in enumerate(lengths):
                first = np.maximum.accumulate(np.where(length < d, np.arange(len(cid)), -1))
                own[:, j] = np.where(first < 0, heads[j], cid[first])
            heads = own[-1].tolist()
            at = np.flatnonzero(length >= floor)
            yield pa.RecordBatch.from_arrays([pa.array(tree[at], pa.int32()), pa.array(cid[at], pa.int64()), pa.array(length[at], pa.int32()), pa.array(list(own[at]), pa.list_(pa.int64())), pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.binary())], names)
            last, end = (tree[-1], labels[-1].tobytes()), (tree[-1], cid[-1], labels[-1].tobytes())
        if last is not None:
            yield border(end)

    found, path = materialize(ordered.mapInArrow(run, "tree int, cid bigint, shared int, heads array<bigint>, part int, label binary"), "tries")
    ends: dict[int, list] = {}
    for r in found.where("shared < 0").select("part", "tree", "cid", "label").orderBy("part", "tree", "label", "cid").collect():  # two rows for each range
        ends.setdefault(r["part"], []).append(r)
    joined, before = [], None
    for part in sorted(ends):
        first = ends[part][0]
        if before is not None and before["tree"] == first["tree"]:
            n = int(shared(*(np.frombuffer(bytes(x["label"]), np.uint32)[None] for x in (before, first)))[0])
            if n >= floor:  # the run goes on from the range before: its last row leads to that run's head
                joined.append((first["tree"], first["cid"], n, [before["cid"] if n >= d else first["cid"] for d in lengths]))
        before = ends[part][-1]
    within = found.where("shared >= 0").select("tree", "cid", "shared", "heads")
    return within.unionByName(spark.createDataFrame(joined, within.schema)), path


def verify(block: tuple, other: tuple | None, threshold: float, tree: int = -1) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]], np.ndarray]:
    """Links of a block with itself or another: each class' linked documents (own block, other block), a spanning forest, and the number of links by similarity (steps of 0.01).

    A block: ids, copies, sets (list of arrays), prefixes (classes x trees), prefixes of the round before (or no
    columns). Pairs that shared one then are left out. With ``tree`` only pairs that first meet in that tree count.
    """
    a, b = block, other or block
    na, nb = len(a[0]), len(b[0])
    found_a, found_b, joined, steps = np.zeros(na, np.int64), np.zeros(nb, np.int64), [], np.zeros(101, np.int64)
    sizes_a, sizes_b = np.array([len(x) for x in a[2]]), np.array([len(x) for x in b[2]])
    values = np.concatenate(b[2])
    owner = np.repeat(np.arange(nb), sizes_b)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    parent = np.arange(na + nb * bool(other))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    shift = na if other else 0
    for i in range(na):
        same = b[3] == a[3][i]
        ask = same.any(1) if tree < 0 else same[:, tree] & ~same[:, :tree].any(1)
        if b[4].shape[1]:
            ask &= ~(b[4] == a[4][i]).any(1)
        maybe = np.flatnonzero(ask)
        if not other:
            maybe = maybe[maybe > i]
        least = np.minimum(sizes_a[i], sizes_b[maybe])
        maybe = maybe[least >= threshold * np.maximum(sizes_a[i], sizes_b[maybe])]
        if not len(maybe):
            continue
        if len(maybe) <= 4:
            common = np.array([len(np.intersect1d(a[2][i], b[2][j], assume_unique=True)) for j in maybe])
        else:
            lo, hi = np.searchsorted(values, a[2][i]), np.searchsorted(values, a[2][i], "right")
            n = hi - lo
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            common = np.bincount(owner[at], minlength=nb)[maybe]
        union = sizes_a[i] + sizes_b[maybe] - common
        good = common >= threshold * union
        linked = maybe[good]
        steps += np.bincount(100 * common[good] // union[good], minlength=101)
        found_a[i] += b[1][linked].sum()
        found_b[linked] += a[1][i]
        for j in linked:
            x, y = root(i), root(shift + j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                joined.append((int(a[0][i]), int(b[0][j])))
    return found_a, found_b, joined, steps


def links(payload: DataFrame, threshold: float) -> DataFrame:
    """a, b, n: a link between two classes; for b null, n linked documents of class a; for a null, n links of similarity b / 100.

    ``payload``: (part, tree, left, right) of a block pair, side, cid, copies, now, done, text; sorted within its
    partitions, so that a task holds one block pair at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        out: list[tuple] = []
        counted = np.zeros(101, np.int64)

        def block(x: list[int], sets: list[np.ndarray]) -> tuple:
            column = lambda k: np.array([rows[i][k] for i in x], np.int64)
            return column(2), column(3), [sets[i] for i in x], column(4), column(5).reshape(len(x), -1)

        def done() -> None:
            sets = shingles([r[6] or "" for r in rows])
            _, tree, left, right = rows[0][0]
            blocks = [block(x, sets) for side in (0, 1) if (x := [i for i, r in enumerate(rows) if r[1] == side])]
            if len(blocks) == 2 or left == right:
                first, second, joined, steps = verify(blocks[0], blocks[1] if len(blocks) == 2 else None, threshold, tree)
                counted[:] += steps
                if len(blocks) == 1:
                    first, second = first + second, second[:0]
                for b, n in zip(blocks, (first, second), strict=False):
                    out.extend((int(k), None, int(v)) for k, v in zip(b[0], n, strict=True) if v)
                out.extend((x, y, 0) for x, y in joined)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[], [], []]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "n"])

        for b in batches:
            c = {n: b.column(n).to_pylist() for n in ("part", "tree", "left", "right", "side", "cid", "copies", "now", "done", "text")}
            for row in zip(zip(c["part"], c["tree"], c["left"], c["right"], strict=True), c["side"], c["cid"], c["copies"], c["now"], c["done"], c["text"], strict=True):
                if rows and rows[0][0] != row[0]:
                    done()
                    rows = []
                rows.append(row)
            if len(out) > 5000:
                yield flush()
        if rows:
            done()
        out.extend((None, k, int(n)) for k, n in enumerate(counted) if n)
        yield flush()

    return payload.mapInArrow(run, "a bigint, b bigint, n bigint")


def prefixes(depths: list[int], depth: int) -> Column:
    """A class' hashed prefix in every tree."""
    return F.array(*[F.xxhash64(F.lit(t), F.substring("sig", 4 * depth * t + 1, 4 * d)) for t, d in enumerate(depths)])


def _shared(columns: list[str]) -> Column:
    """Whether the rows of a group all have one value in some of these columns."""
    return F.greatest(F.lit(False), F.lit(False), *[F.min(c) == F.max(c) for c in columns])


def match(tried: DataFrame, classes: DataFrame, texts: DataFrame, depths: list[int], before: list[int] | None, depth: int, floor: int, threshold: float, temporary: list[str]) -> DataFrame:
    """``links`` of all pairs that share a prefix at ``depths`` and shared none at ``before``. Written; adds the paths of what it writes to ``temporary``."""

    def kept(df: DataFrame, name: str) -> DataFrame:
        df, path = materialize(df, name)
        temporary.append(path)
        return df

    trees = len(depths)
    # Runs of many trees overlap: a class is linked to the smallest of its runs' heads, and those heads to that one
    head = F.element_at("heads", F.element_at(F.array(*map(F.lit, depths)), F.col("tree") + 1) - floor + 1)
    own_runs = tried.select("cid", head.alias("head")).where("head <> cid").groupBy("cid").agg(F.min("head").alias("b"), F.collect_set("head").alias("heads"))
    edges = own_runs.select(F.col("cid").alias("a"), "b").unionByName(own_runs.select(F.explode("heads").alias("a"), "b")).where("a <> b").distinct()
    near = components(edges)
    done = prefixes(before, depth) if before else F.array().cast("array<bigint>")
    member = kept(near.withColumnRenamed("node", "cid").join(classes, "cid").select("component", "cid", "n", "copies", prefixes(depths, depth).alias("now"), done.alias("done")), "members")
    n_members = member.count()
    old = [F.col("done")[t].alias(f"d{t}") for t in range(trees if before else 0)]
    names = [f"d{t}" for t in range(len(old))]
    blocks = F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / BLOCK_CLASSES)).cast("int").alias("blocks")
    sized = kept(member.select("component", "n", *old).groupBy("component").agg(blocks, F.count("*").alias("size"), _shared(names).alias("old")), "components")
    placed = kept(join_hot(member, sized, ["component"], "size", n_members).where("not old or blocks > 1"), "placed")  # what shared a prefix before was verified then
    spread = placed.where("blocks > 1").select("component", "cid", "n", "copies", "now", "done", F.posexplode("now").alias("tree", "part"))
    told = [F.col("now")[t].alias(f"k{t}") for t in range(trees)]
    earlier = [F.when(F.col("tree") > t, F.col(f"k{t}")).otherwise(F.col("cid")).alias(f"e{t}") for t in range(trees - 1)]  # of one value in all rows only if of an earlier tree
    subtries = spread.select("*", *told, *old).select("tree", "part", "component", "n", *names, *earlier).groupBy("tree", "part").agg(blocks, F.count("*").alias("size"), F.min("component").alias("component"), _shared([*names, *(f"e{t}" for t in range(trees - 1))]).alias("old"))
    subtries = kept(subtries.where("size > 1 and not old").drop("old"), "subtries")
    # A component whose subtries overlap so much that they would hold its classes more often than all its blocks in pairs goes as a whole
    by_tries = subtries.groupBy("component").agg(F.sum(F.col("size") * F.col("blocks")).alias("rows"))
    ways = kept(sized.where("blocks > 1").join(by_tries, "component").select("component", (F.col("size") * F.col("blocks") <= F.col("rows")).alias("whole")), "ways")
    chosen = kept(look_up(placed, ways, "component", "left").where("blocks = 1 or whole is not null"), "chosen")
    own = chosen.where("blocks = 1 or whole").select(F.col("component").alias("part"), F.lit(-1).alias("tree"), "blocks", "cid", "copies", "now", "done")
    spread = kept(chosen.where("blocks > 1 and not whole").select("cid", "copies", "now", "done", F.posexplode("now").alias("tree", "part")), "spread")
    subtries = kept(look_up(subtries, ways.where("not whole").select("component"), "component").drop("component"), "dealt")
    dealt = join_hot(spread, subtries, ["tree", "part"], "size", spread.count()).select("part", "tree", "blocks", "cid", "copies", "now", "done")
    block = F.pmod(F.xxhash64(F.lit("block"), "cid"), F.col("blocks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, block).alias("left"), F.greatest(k, block).alias("right"), (k < block).cast("int").alias("side")))
    payload = own.unionByName(dealt).join(texts, "cid").select("part", "tree", "cid", "copies", "now", "done", "text", F.inline(pair))
    keys = ["part", "tree", "left", "right"]
    return kept(links(payload.repartition(*keys).sortWithinPartitions(*keys, "side", "cid"), threshold), "links")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of all that links connect), n_links (other documents at the threshold or above), text_hash (xxhash64 of the row's text), first (whether the row has its group's class_id as doc_id, and of such rows' texts the one of the smallest hash).

    Shuffles hold hashes and signatures; texts move once, and only those of classes that share a prefix travel on.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null").withColumn("text_hash", F.xxhash64("text"))
    temporary: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        df, path = materialize(df, name)
        temporary.append(path)
        return df

    sketches = kept(sketch(docs, trees, depth), "sketches")
    classes = sketches.where("n > 0").groupBy("n", "one", "two").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    classes = kept(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    floor = floor_depth(threshold, recall, trees, depth)
    tried, path = tries(classes, trees, depth, floor)
    temporary.append(path)
    able = tried.select(F.explode(F.array_append("heads", F.col("cid"))).alias("cid")).distinct().join(classes.select("cid", "rep"), "cid")
    texts = kept(docs.join(able.select("cid", "rep.*"), ["doc_id", "text_hash"]).select("cid", "text").dropDuplicates(["cid"]), "texts")
    adds = {(r["tree"], r["shared"]): r["n"] for r in tried.groupBy("tree", "shared").agg(F.count("*").alias("n")).collect()}  # trees x depth

    depths, before, found, least = [depth] * trees, None, [], 1.01
    while True:
        found.append(match(tried, classes, texts, depths, before, depth, floor, threshold, temporary))
        seen = found[-1].where("a is null").agg(F.min("b")).first()[0]
        least = least if seen is None else min(least, max(threshold, seen / 100))
        longer = shortened(depths, least if least <= 1 else threshold, recall, adds, floor)
        if not any(adds.get((t, k)) for t in range(trees) for k in range(longer[t], depths[t])):
            break  # no pair shares a prefix of such a length but no longer one
        before, depths = depths, longer
    links_ = found[0]
    for f in found[1:]:
        links_ = links_.unionByName(f)

    groups = components(links_.where("a is not null and b is not null").select("a", "b")).withColumnRenamed("node", "cid")
    counts = links_.where("a is not null and b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("linked"))
    grouped = kept(classes.select("cid", "n", "one", "two", "rep", "copies").join(groups, "cid", "left").join(counts, "cid", "left").withColumn("component", F.coalesce("component", "cid")), "grouped")
    several = grouped.where("linked > 0 or copies > 1")
    tops = several.groupBy("component").agg(F.min("rep").alias("top"), F.count("*").alias("size"))
    known = join_hot(several, tops, ["component"], "size", grouped.count()).select("n", "one", "two", "copies", "top", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    known = kept(known, "known")
    rows = sketches.select("doc_id", "text_hash", "n", "one", "two")
    out = join_hot(rows, known, ["n", "one", "two"], "copies", rows.count(), "left")
    own = F.struct("doc_id", "text_hash")
    out = out.select("doc_id", F.coalesce("top.doc_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "text_hash", (F.col("top").isNull() | (F.col("top") == own)).alias("first"))
    out, _ = materialize(out, "near")
    discard(spark, *temporary)
    return out
