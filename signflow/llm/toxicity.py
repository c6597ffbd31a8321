"""Toxicity behind a noisy channel: restore disguised words, then score the restored text.

What tells toxic documents is learned from labelled ones (a bounded, hashed sample): whole words, and stems that go
on (the first letters of longer words). A feature's weight is the logarithm of how much more often toxic documents
have it, by Wilson's lower bound; a stem counts if no one word makes up half of it; near copies (documents with most shingles in common) count once. A character
trigram model is counted over the words of all documents to learn from, in Spark, and mixed with one of the
features: whoever disguises a word has reason to.

Every token (or run of spaced letters) that is not plain letters becomes a lattice. A look-alike may be each of its
letters or, between letters, a separator; a separator (or space of a run) may be dropped or part two words; a letter
that is repeated may be meant once or twice; a star may be any letter. The channel charges for each disguise, the
language model for each letter, and Viterbi decoding takes the cheapest reading. What was decoded stands in the
restored text, and only whole words of it are scored; a token may well be restored to nothing known. A doubled
letter in a token of letters is ordinary spelling and is left; disguise by repetition starts at three.

A document's evidence is the sum over its restored text's distinct words of the weight of each one's best feature;
a logistic curve, fitted to the sample at the shares of all labelled rows, makes it a score.

Null and empty texts have no evidence and get the score of that. Repeated rows get equal scores, a null doc_id is
kept (and in no fold), very long texts and tokens are read whole, without labels of both classes every score is 0,
without any telling feature (few toxic documents) every score is about the toxic share of the labelled rows, an empty table gives no rows. Columns besides those named are ignored; one named ``score`` is replaced.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from signflow.llm import near_dup
from signflow.llm.common import fold, prepare, texts_of
from signflow.session import discard, materialize

#: Labelled documents of either class to learn from, at most.
MAX_PER_CLASS = 6000
#: Keys by which copies are told, each of three min-hashes.
COPY_KEYS = 8
#: Distinct tokens that a task counts before it passes on their trigrams.
TOKENS_HELD = 200_000
#: How much more often toxic documents must have a feature, and in how many of them it is to be found.
LIFT, SUPPORT = 4.0, 9
#: Lengths of stems. Evidence beyond MOST counts as MOST.
STEMS, MOST = range(3, 8), 40.0
#: What a character may stand for. Fixed values.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„’‘…–—¿¡"
PLAIN_EDGE = "".join(c for c in EDGE if c not in LEET)
MARKS = EDGE + "0123456789"
#: Three or more single characters (or repetitions of one) with anything but letters, digits and look-alikes between each two.
SPACED_RUN = re.compile(r"(?<![^\W_])(?:([^\W_]|[@$!|+(€£*])\1*(?:[^\w@$!|+(€£*]|_)+){2,}([^\W_]|[@$!|+(€£*])\2*(?![^\W_])")
#: What makes a token of letters a lattice, and what any other needs to be one: a letter three times; a letter or look-alike sign.
THRICE, ABLE = re.compile(r"(.)\1\1"), re.compile(r"[^\W\d_]|[@$!|+(€£]")
RUN = re.compile(r"(.)\1*", re.S)
#: Logarithms of what the channel does: a look-alike, a separator within a word, a separator between words, a repeated letter meant once, a star as a letter, a character that is no letter at all.
LEETED, DROPPED, PARTED, REPEATED, STARRED, NOISE = -1.0, -2.5, -0.7, -0.7, -1.5, -9.0
#: The toxic words' share of what the disguised are taken from.
MEANT = 0.5
#: Letters that a star may be: those that follow in the model, the likeliest first.
STAR_LETTERS = 6
#: Stands in the model for all letters that neither a toxic word nor a look-alike has, which bounds the model.
OTHER = "\0"


def features(word: str) -> list[str]:
    """The whole word, and its stems (which go on)."""
    return ["=" + word, *(word[:k] + "+" for k in STEMS if k < len(word))]


@dataclass
class Model:
    """weights: feature to weight; curve: of the score over the evidence; log: trigram model, of ``letters``."""

    weights: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, float] | None = None
    log: dict[str, float] = field(default_factory=dict)
    floor: float = -12.0
    letters: frozenset[str] = frozenset()

    def __post_init__(self):
        follow = defaultdict(list)
        for g, p in self.log.items():
            if g[2] not in (OTHER, "$"):
                follow[g[:2]].append((p, g[2]))
        self.follow = {s: "".join(c for _, c in sorted(x, key=lambda v: (-v[0], v[1]))[:STAR_LETTERS]) for s, x in follow.items()}
        self.seen: dict[str, tuple[tuple[str, float], ...]] = {}

    def decode(self, token: str) -> list[str]:
        return self.reading(token)[1]

    def reading(self, token: str) -> tuple[float, list[str]]:
        """The cheapest reading of a token or spaced run, by Viterbi over its lattice: its log-probability and its words."""
        get, floor, letters = self.log.get, self.floor, self.letters
        best: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}  # by the last two letters: log-probability, and what was read, from the last back
        for m in RUN.finditer(token):
            c, n = m[1], m.end() - m.start()
            letter = c.isalpha()
            may, own = (c, 0.0) if letter else (LEET.get(c, ""), LEETED) if c != "*" else (None, STARRED)
            after: dict[str, tuple[float, tuple | None]] = {}
            for s, (cost, read) in best.items():
                for x in self.follow.get(s, "") if may is None else may:
                    k = x if x in letters else OTHER
                    one = cost + own + get(s + k, floor)
                    t = s[1] + k
                    v = one + REPEATED if n > 1 else one
                    if t not in after or v > after[t][0]:
                        after[t] = (v, (read, x))
                    if n > 1:  # meant twice
                        v = one + get(t + k, floor) + (REPEATED if n > 2 else 0.0)
                        t = k + k
                        if t not in after or v > after[t][0]:
                            after[t] = (v, (read, x + x))
                if not letter:
                    digit = c.isdigit()
                    v = cost + (NOISE if digit else DROPPED)  # no letter: nothing, or the end of a word
                    if s not in after or v > after[s][0]:
                        after[s] = (v, read)
                    if s != "^^":
                        v = cost + get(s + "$", floor) + (NOISE if digit else PARTED)
                        if "^^" not in after or v > after["^^"][0]:
                            after["^^"] = (v, (read, " "))
            best = after
        total, _, read = max(((cost + (get(s + "$", floor) if s != "^^" else 0.0), s, read) for s, (cost, read) in best.items()), key=lambda x: x[:2])
        parts = []
        while read:
            read, x = read
            parts.append(x)
        return total, "".join(reversed(parts)).split()

    def token(self, token: str) -> tuple[str, ...]:
        """The words that a lower-case token is restored to."""
        bare = token.strip(PLAIN_EDGE)
        if bare.isalpha():
            return (*self.decode(bare), bare) if THRICE.search(bare) else (bare,)
        if not ABLE.search(bare):
            return ()
        core = bare.strip(MARKS)
        return (*self.decode(bare), core) if core.isalpha() else tuple(self.decode(bare))  # a word with marks or digits beside it, if they are no letters

    def telling(self, words: list[str] | tuple[str, ...]) -> tuple[tuple[str, float], ...]:
        """The words that have a weight, with it."""
        get = self.weights.get
        return tuple((w, v) for w in words if (v := max(get(f, 0.0) for f in features(w))))

    def evidence(self, text: str) -> dict[str, float]:
        """The distinct words of the restored text that have a weight."""
        if not self.weights:
            return {}
        low = text.lower()
        tokens = set(low.split())
        new = tokens.difference(self.seen)
        if len(self.seen) + len(new) > 400_000:
            self.seen.clear()
            new = tokens
        for t in new:
            self.seen[t] = self.telling(self.token(t))
        found = dict(x for t in tokens for x in self.seen[t])
        for m in SPACED_RUN.finditer(low):
            if ABLE.search(m[0]):
                found.update(self.telling(self.decode(m[0])))
        return found

    def total(self, text: str) -> float:
        return min(MOST, sum(sorted(self.evidence(text).values())))

    def score(self, text: str) -> float:
        if self.curve is None:
            return 0.0
        at, steep = self.curve
        return float(1 / (1 + np.exp(-(at + steep * self.total(text)))))


def lower_bound(hits: float, n: float, z: float = 1.96) -> float:
    """Wilson's lower bound of a share."""
    p = hits / n
    return (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def fit_curve(e: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Where and how steeply a logistic curve rises over the evidence: most likely for ``n`` rows of label ``y``, with one more of either label at the ends and a slope that is kept near 1."""
    x = np.stack([np.ones(len(e) + 2), [*e, 0.0, max(e.max(), 1.0)]], 1)
    y, n = np.array([*y, 0.0, 1.0]), np.array([*n, 1.0, 1.0])
    loss = lambda w: (n * np.logaddexp(0, (1 - 2 * y) * (x @ w))).sum() + (w[1] - 1) ** 2 / 2
    w = np.array([0.0, 1.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        bend = (x.T * (n * p * (1 - p))) @ x + np.diag([1e-6, 1.0])
        step = np.linalg.solve(bend, x.T @ (n * (y - p)) - [0.0, w[1] - 1])
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step /= 2
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 0.0))


def families(keys: np.ndarray) -> np.ndarray:
    """Which rows (documents x keys) are copies of each other: those that share a key, and theirs. The smallest row stands for a family."""
    parent = list(range(len(keys)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first: dict[int, int] = {}
    for i, row in enumerate(keys.tolist()):
        for k in row:
            a, b = root(first.setdefault(k, i)), root(i)
            parent[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(len(keys))], np.int64)


def copy_keys(texts: list[str]) -> np.ndarray:
    """Keys (texts x COPY_KEYS) that texts with most five-word shingles in common share; texts without words share none."""
    sets = near_dup.shingles(texts)
    full = [i for i, x in enumerate(sets) if len(x)]
    out = np.random.default_rng(len(texts)).integers(-(1 << 63), 1 << 63, (len(texts), COPY_KEYS))
    if full:
        sig = near_dup.signatures([sets[i] for i in full], COPY_KEYS, 3).reshape(len(full), COPY_KEYS, 3).astype(np.uint64)
        hashed = near_dup.mix(near_dup.mix((sig[..., 0] << np.uint64(32)) + sig[..., 1]) + sig[..., 2] + np.arange(COPY_KEYS, dtype=np.uint64) * np.uint64(7919))
        out[full] = hashed.view(np.int64)
    return out


def trigrams(docs: DataFrame, letters: frozenset[str]) -> DataFrame:
    """g, n: character trigrams of the words of all ``docs``, each word once for a document that has it; other letters count as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spread() -> pa.RecordBatch:
            words, out = Counter(), Counter()
            for x, n in tokens.items():
                if (w := x.strip(EDGE)).isalpha():
                    words["".join(c if c in letters else OTHER for c in w)] += n
            tokens.clear()
            for w, n in words.items():
                padded = f"^^{w}$"
                for i in range(len(padded) - 2):
                    out[padded[i : i + 3]] += n
            return pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], ["g", "n"])

        tokens = Counter()
        for b in batches:
            for t in texts_of(b):
                tokens.update(set(t.lower().split()))
            if len(tokens) > TOKENS_HELD:
                yield spread()
        yield spread()

    return docs.select("text").mapInArrow(run, "g string, n bigint").groupBy("g").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame, weights: dict[str, float]) -> tuple[dict[str, float], float, frozenset[str]]:
    """Logarithms of trigram probabilities (of all words, mixed with those of the features), that of an unseen one, and the model's letters.

    The counts cover all of ``docs``; the driver gets one row for each trigram of the model's letters.
    """
    told = ["^^" + (f[1:] + "$" if f[0] == "=" else f[:-1]) for f in weights]
    letters = frozenset("".join([*told, *LEET.values()])) - {"^", "$"}
    counts = {r["g"]: r["n"] for r in trigrams(docs, letters).collect()}
    meant = Counter(p[i : i + 3] for p in told for i in range(len(p) - 2))
    every, of_toxic = Counter(), Counter()
    for total, table in ((every, counts), (of_toxic, meant)):
        for g, n in table.items():
            total[g[:2]] += n
    kinds = len(letters) + 2
    share = lambda g: (1 - MEANT) * (counts.get(g, 0) + 0.1) / (every[g[:2]] + 0.1 * kinds) + (MEANT * meant[g] / of_toxic[g[:2]] if g in meant else 0.0)
    log = {g: float(np.log(share(g))) for g in {*counts, *meant}}
    return log, min(log.values(), default=-12.0) - 1, letters


def train(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = MAX_PER_CLASS) -> Model:
    """Learn from the labelled rows of ``docs`` where ``learn`` holds.

    The sample has at most ``per_class`` documents of either class; the driver gets the counts of the candidates
    and each sampled document's candidates, by number. The character model is counted over all rows where
    ``learn`` holds, labelled or not.
    """
    spark = docs.sparkSession
    prepare(spark)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [known.where(F.col("toxic") == k).orderBy(F.xxhash64(F.lit("toxic"), "doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    sample = picked[0].unionByName(picked[1])  # so small that it can be broadcast
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rows = docs.where(learn & F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    rows, path = materialize(rows, "sample")
    try:
        sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
        if not n_pos or not n_neg:
            return Model()

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = (Counter(), Counter())
            for b in batches:
                for t, y in zip(texts_of(b), b.column("toxic").to_pylist(), strict=True):
                    seen[y].update({f for x in t.lower().split() if (w := x.strip(EDGE)).isalpha() for f in features(w)})
            found = [f for f in seen[1] | seen[0]]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([seen[1][f] for f in found], pa.int64()), pa.array([seen[0][f] for f in found], pa.int64())], ["feature", "pos", "neg"])

        counts = rows.mapInArrow(count, "feature string, pos bigint, neg bigint").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        often = (F.col("pos") >= SUPPORT) & (F.col("pos") / n_pos >= LIFT * (F.col("neg") + 0.5) / (n_neg + 1)) & (F.length("feature") >= 4)
        names = sorted(r["feature"] for r in counts.where(often).select("feature").collect())
        number = {f: i for i, f in enumerate(names)}

        def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = texts_of(b)
                own = [np.array(sorted({k for x in set(t.lower().split()) for f in features(x.strip(EDGE)) if (k := number.get(f)) is not None}), np.int32).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(own, pa.binary()), pa.array([k.tobytes() for k in copy_keys(texts)], pa.binary())], ["toxic", "found", "keys"])

        held = rows.mapInArrow(hold, "toxic int, found binary, keys binary").where(F.length("found") > 0).collect()
        family = families(np.array([np.frombuffer(bytes(r["keys"]), np.int64) for r in held]).reshape(len(held), COPY_KEYS))
        seen = {(f, r["toxic"], k) for f, r in zip(family.tolist(), held, strict=True) for k in np.frombuffer(bytes(r["found"]), np.int32).tolist()}
        pos, neg = Counter(k for _, y, k in seen if y), Counter(k for _, y, k in seen if not y)
        lift = {names[k]: lower_bound(n, n_pos) / ((neg[k] + 0.5) / (n_neg + 1)) for k, n in pos.items() if n >= SUPPORT}
        top: dict[str, int] = {}  # of the words that a stem begins, the commonest one's documents
        for k, n in pos.items():
            for f in features(names[k][1:])[1:] if names[k][0] == "=" else ():
                top[f] = max(top.get(f, 0), n)
        weights = {f: float(np.log(x)) for f, x in sorted(lift.items()) if x >= LIFT and (f[0] == "=" or 2 * top.get(f, 0) < pos[number[f]])}
        learned = docs.where(learn & F.col("text").isNotNull())
        model = Model(weights, None, *(language_model(learned, weights) if weights else ()))

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([round(4 * model.total(t)) for t in texts_of(b)], pa.int32())], ["toxic", "step"])

        cells = rows.mapInArrow(tally, "toxic int, step int").groupBy("toxic", "step").agg(F.count("*").alias("n")).collect()  # by class and step of evidence
        up = (totals[0] / n_neg, totals[1] / n_pos)  # back to the labelled rows' shares
        model.curve = fit_curve(np.array([r["step"] / 4 for r in cells]), np.array([r["toxic"] for r in cells], float), np.array([r["n"] * up[r["toxic"]] for r in cells]))
        return model
    finally:
        discard(spark, path)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` with ``score`` (which replaces a column so named); ``docs`` needs a ``text``."""
    prepare(docs.sparkSession)
    docs = docs.drop("score")
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded: toxic words and trigrams
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array([m.score(t) for t in texts_of(b)], pa.float64())], [*names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def judge(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, threshold: float = 0.7, per_class: int = MAX_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from the rows outside the held-out fold."""
    out = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False))
    model = train(docs, labels, ~out, per_class)
    return score(docs.select(F.col("doc_id").cast("bigint"), "text"), model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
