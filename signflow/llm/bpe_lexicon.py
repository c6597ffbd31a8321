"""BPE encoding and decoding with a minimal acyclic transducer for frequent words.

The corpus' most frequent pretokens are compiled, with their ids, into an acyclic automaton with shared
suffixes: each state knows how many words end below it, so a walk gives the word's rank, and the rank its ids.
The automaton is one file that Spark hands to every executor (``addFile``), where the workers memory-map it.
Other pretokens are merged exactly, by the ranks of the tokenizer's merges. Decoding joins the ids' bytes and
reads them as UTF-8, with the replacement character for what is not.

Null texts are empty (no ids, empty text), special tokens inside a text get their ids as in the library, very
long texts and pretokens are encoded whole, repeated rows get equal results, a null doc_id is kept, an empty
table gives no rows. Columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import re
import struct
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signflow.llm.common import PlainTexts, distinct_pretokens, joined, prepare, slices, texts_of
from signflow.session import discard, materialize

#: Pretokens of the lexicon, at most.
LEXICON = 50_000
#: Characters of a word of the lexicon, at most.
LONGEST = 64
#: The byte-level pretokens: contractions; letters, numbers or others with a space before them; white space. Fixed by the tokenizer.
PRETOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def pretokens(text: str) -> list[str]:
    """The pretokens of a text. Outside of plain letters and digits ``re`` and Unicode's classes differ, so such texts use ``regex``."""
    if text.isascii() or not _ODD.search(text):
        return PRETOKENS.findall(text)
    import regex

    return regex.findall(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", text)


#: What a plain text lacks: control characters, and what neither ASCII nor a Latin letter is.
_UNPLAIN = re.compile("[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ɏ]")
#: What neither ASCII nor a Latin letter is.
_ODD = re.compile("[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ɏ]")


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


#: Bytes of a word that is merged together with others, at most.
WIDEST = 36
#: Where the rank of a merge is asked for: the pair does not merge.
_NONE = 1 << 25
#: A place without a pair that merges.
_FREE = (1 << 31) - 1


class Merges:
    """Exact BPE: merge the pair of the lowest rank, leftmost first, until none is left."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.first = [vocab[c] for c in letters]
        self.pairs = {}
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.pairs[vocab[a] << 20 | vocab[b]] = k << 20 | vocab[a + b]
        keys = np.array(sorted(self.pairs), np.int64)
        values = np.array([self.pairs[k] for k in keys.tolist()], np.int64)
        self.keys, self.values = np.append(keys, 1 << 62), np.append(values >> 20, _NONE).astype(np.int32)
        self.merged = np.zeros(len(spec["model"]["merges"]), np.int32)
        self.merged[values >> 20] = values & 0xFFFFF
        of_byte = np.array(self.first, np.int32)
        self.of_byte, self.of_bytes = of_byte, self.ranks(np.repeat(of_byte, 256), np.tile(of_byte, 256)).reshape(256, 256)
        back = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, _NONE for those that don't merge."""
        key = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], np.int32(_NONE))

    def many(self, words: list[bytes]) -> list[list[int]]:
        """The same for many words."""
        return [np.frombuffer(x, "<u4").tolist() for x in self.packed(words)]

    def packed(self, words: list[bytes]) -> list[bytes]:
        """The ids (little-endian uint32) of many words at once: in each round every word merges its best pair."""
        out = [b""] * len(words)
        alone = [i for i, w in enumerate(words) if len(w) > WIDEST]
        for rows, raw, sizes in by_width(words, WIDEST):
            if len(rows) < 20:
                alone += rows.tolist()
                continue
            ids = self.rounds(raw, sizes).T
            kept = ids >= 0
            ends = (4 * np.cumsum(kept.sum(1))).tolist()
            flat = ids[kept].astype("<u4").tobytes()
            for i, start, end in zip(rows.tolist(), [0, *ends], ends, strict=False):
                out[i] = flat[start:end]
        for i in alone:
            out[i] = np.array(self(words[i]), "<u4").tobytes()
        return out

    def rounds(self, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids of words given as columns of bytes, at the places of their first bytes; -1 elsewhere.

        Each column has a row before and behind it that merges with nothing; ``key`` holds rank and place of the
        pair that starts at a place, ``after`` and ``before`` link the places that are left.
        """
        width, n = raw.shape
        place = np.arange(width)[:, None]
        ids = np.full((width + 2, n), 0xFFFFF, np.int32)
        ids[1:-1] = np.where(place < sizes, self.of_byte[raw], -1)
        key = np.full((width + 2, n), _FREE, np.int32)
        pair = self.of_bytes[raw[:-1], raw[1:]]
        key[1:-2] = np.where((pair != _NONE) & (place[1:] < sizes), pair << 6 | place[1:], _FREE)
        after = np.repeat(np.arange(1, width + 3, dtype=np.int8)[:, None], n, 1)
        after[sizes, np.arange(n)] = width + 1
        before = after - np.int8(2)
        out, todo = np.empty((width, n), np.int32), np.arange(n)
        while True:
            best = key.min(0)
            at = np.flatnonzero(best != _FREE)
            if 2 * len(at) < len(todo):  # the columns that are done are put away
                out[:, todo] = ids[1:-1]
                if not len(at):
                    return out
                todo, best = todo[at], best[at]
                ids, key, after, before = (x.take(at, 1) for x in (ids, key, after, before))
                at = np.arange(len(todo))
            else:
                best = best[at]
            new, place = self.merged[best >> 6], best & 63
            n = len(todo)
            i, k, f, p = ids.reshape(-1), key.reshape(-1), after.reshape(-1), before.reshape(-1)
            own = place * np.int64(n) + at
            gone = f[own] * np.int64(n) + at
            right = f[gone]
            i[own], i[gone], k[gone], f[own] = new, -1, _FREE, right
            right = right * np.int64(n) + at
            p[right] = place
            left = p[own]
            rank = self.ranks(new, i[right])
            k[own] = np.where(rank == _NONE, _FREE, rank << 6 | place)
            own = left * np.int64(n) + at
            rank = self.ranks(i[own], new)
            k[own] = np.where(rank == _NONE, _FREE, rank << 6 | left)

    def __call__(self, word: bytes) -> list[int]:
        ids, get, none = [self.first[b] for b in word], self.pairs.get, 1 << 60
        ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) != none:
            if len(ranks) > 300:
                return self.long(ids)
            i, new = ranks.index(best), best & 0xFFFFF
            ids[i : i + 2] = [new]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | new, none)
            if i < len(ranks):
                ranks[i] = get(new << 20 | ids[i + 1], none)
        return ids

    def long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for words of many bytes."""
        import heapq

        n = len(ids)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := self.pairs.get(ids[i] << 20 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or self.pairs.get(ids[i] << 20 | ids[j]) != rank:
                continue
            ids[i], ids[j], after[i] = rank & 0xFFFFF, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if r := self.pairs.get(ids[i] << 20 | ids[after[i]]):
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := self.pairs.get(ids[before[i]] << 20 | ids[i])):
                heapq.heappush(heap, (r, before[i]))
        return [x for x in ids if x >= 0]


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The automaton's file: a header, then per arc its key (source state and label), target and the words skipped, per state whether it ends a word, per word its ids.

    Words are added in order; states that can get no more arcs are merged with equal ones at once, so suffixes
    are shared and the automaton stays minimal throughout.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    path: list[list] = [[False, []]]  # of the word added last: whether it ends here, arcs (label, state)
    previous = b""

    def close(down_to: int) -> None:
        while len(path) > down_to + 1:
            final, arcs = path.pop()
            key = (final, tuple(arcs))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            path[-1][1][-1] = (path[-1][1][-1][0], register[key])

    ordered = sorted(words)
    for word in ordered:
        same = len(os.path.commonprefix([previous, word]))
        close(same)
        for b in word[same:]:
            path[-1][1].append((b, -1))
            path.append([False, []])
        path[-1][0] = True
        previous = word
    close(0)
    states.append((path[0][0], tuple(path[0][1])))
    below = []
    for final, arcs in states:  # targets come before their sources
        below.append(final + sum(below[t] for _, t in arcs))
    keys, targets, skipped = [], [], []
    for state, (final, arcs) in enumerate(states):
        passed = int(final)
        for label, t in arcs:
            keys.append(state << 8 | label)
            targets.append(t)
            skipped.append(passed)
            passed += below[t]
    ids = [words[w] for w in ordered]
    ends = np.cumsum([0, *map(len, ids)])
    flat = np.array([i for x in ids for i in x], "<u4")
    parts = [np.array(keys, "<u4"), np.array(targets, "<u4"), np.array(skipped, "<u4"), np.array([f for f, _ in states], "<u4"), ends.astype("<u4"), flat]
    return struct.pack("<6I", *map(len, parts)) + b"".join(p.tobytes() for p in parts)


def by_width(words: list[bytes], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words of up to ``most`` bytes in groups of near widths: their rows, bytes (a column each, with what follows it) and sizes."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join(words) + bytes(most), np.uint8)
    widths = -(-sizes // 6) * 6
    for width in np.unique(widths[(widths > 0) & (widths <= most)]).tolist():
        rows = np.flatnonzero(widths == width)
        yield rows, raw[starts[rows] + np.arange(width)[:, None]], sizes[rows]


class Lexicon:
    """A compiled automaton, memory-mapped."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.file = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        at, parts = 24, []
        for n in struct.unpack_from("<6I", self.file):
            parts.append(np.frombuffer(self.file, "<u4", n, at))
            at += 4 * n
        self.keys, self.targets, self.skipped, self.final, self.ends, self.ids = parts

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Each word's rank, -1 for those that the lexicon lacks. All words of a width walk the automaton in step."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys):
            return out
        for rows, raw, sizes in by_width(words, LONGEST * 4):
            state, rank = np.full(len(rows), len(self.final) - 1, np.uint32), np.zeros(len(rows), np.int64)
            known, at = np.ones(len(rows), bool), np.arange(len(rows))
            for k in range(len(raw)):
                at = at[sizes[at] > k]
                key = state[at] << np.uint32(8) | raw[k, at]
                arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found = self.keys[arc] == key
                known[at[~found]] = False
                at, arc = at[found], arc[found]
                if not len(at):
                    break
                rank[at] += self.skipped[arc]
                state[at] = self.targets[arc]
            out[rows] = np.where(known & (self.final[state] > 0), rank, -1)
        return out

    def packed(self, words: list[bytes]) -> list[bytes | None]:
        """The ids (little-endian uint32) of each word; None for words that the lexicon lacks."""
        ids, ends = self.ids.tobytes(), (4 * self.ends.astype(np.int64)).tolist()
        return [ids[ends[r] : ends[r + 1]] if r >= 0 else None for r in self.ranks(words).tolist()]

    def get(self, word: bytes) -> list[int] | None:
        ids = self.packed([word])[0]
        return None if ids is None else np.frombuffer(ids, "<u4").tolist()


class Encoder(PlainTexts):
    """Texts to ids by the lexicon and exact merges, and back.

    Other texts than plain ones (other scripts, control characters, special tokens) go by chunks between spaces; a
    bounded memo of two generations keeps what the chunks came to.
    """

    def __init__(self, tokenizer: str, lexicon: str, most: int = 500_000):
        super().__init__(most)
        self.merges, self.lexicon = Merges(tokenizer), Lexicon(lexicon)
        self.special = re.compile("(" + "|".join(map(re.escape, self.merges.special)) + ")") if self.merges.special else None
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.bytes = pa.array(self.merges.bytes, pa.large_binary())
        self.decimals = pa.array([b"%d," % i for i in range(len(self.merges.bytes))], pa.large_binary())

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words: the lexicon's, and all others merged together."""
        found = self.lexicon.packed(words)
        rest = [i for i, x in enumerate(found) if x is None]
        for i, ids in zip(rest, self.merges.packed([words[i] for i in rest]), strict=True):
            found[i] = ids
        return found

    def parts(self, text: str) -> list[str | int]:
        """The pretokens of a text; special tokens as their ids."""
        out: list[str | int] = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            out += [self.merges.special[part]] if k % 2 else pretokens(part)
        return out

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, one after the other, and where each text's end."""
        odd = [_UNPLAIN.search(t) is not None or any(s in t for s in self.merges.special) for t in texts]
        plain = [t for t, o in zip(texts, odd, strict=True) if not o]
        flat, ends = self.plain_ids(plain) if plain else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        if not any(odd):
            return flat, ends
        other = iter(self.chunks([t for t, o in zip(texts, odd, strict=True) if o]))
        spans = iter(zip([0, *ends.tolist()], ends.tolist(), strict=False))
        out = [np.frombuffer(next(other), "<u4") if o else flat[slice(*next(spans))] for o in odd]
        return np.concatenate(out), np.cumsum([len(x) for x in out])

    def some(self, texts: list[str]) -> list[bytes]:
        ids, ends = self.ids(texts)
        return [ids[s:e].tobytes() for s, e in zip([0, *ends.tolist()], ends.tolist(), strict=False)]

    def written(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[memoryview]:
        """Each text's ids in decimal, with commas between them."""
        return (x[:-1] for x in spelled(self.decimals, ids, ends))

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[str]:
        """What each text's ids decode to."""
        return (str(x, "utf-8", "replace") for x in spelled(self.bytes, ids, ends))

    def chunks(self, texts: list[str]) -> list[bytes]:
        """The ids of any texts, by chunks."""
        lists = [[] if "  " in t else t.split(" ") for t in texts]  # runs of spaces are pretokens of their own
        wanted = set().union(*(x[1:] for x in lists))
        new = wanted.difference(self.memo)
        if len(self.memo) + len(new) > self.most // 2:
            self.memo, self.older, new = {}, self.memo, wanted
        memo, older = self.memo, self.older
        if older:
            memo.update((c, older[c]) for c in new.intersection(older))
            new = new.difference(memo)
        plain = [c for c in new if c and "<" not in c]
        split = {t: self.parts(t) for t in {x[0] if x else t for x, t in zip(lists, texts, strict=True)}.union(" " + c for c in new if not c or "<" in c)}
        words = pretokens(" " + " ".join(plain)) if plain else []
        starts = [i for i, w in enumerate(words) if w[0] == " "]
        if len(starts) != len(plain):  # not each chunk begins with its space
            split.update((" " + c, self.parts(" " + c)) for c in plain)
            plain, words, starts = [], [], []
        named = list(set(words).union(w for x in split.values() for w in x if isinstance(w, str)))
        own = dict(zip(named, self.words([w.encode("utf-8", "surrogatepass") for w in named]), strict=True))
        whole = {t: b"".join([own[w] if isinstance(w, str) else struct.pack("<I", w) for w in x]) for t, x in split.items()}
        for c, s, e in zip(plain, starts, [*starts[1:], len(words)], strict=False):  # there may be none
            memo[c] = own[words[s]] if e == s + 1 else b"".join([own[w] for w in words[s:e]])
        memo.update((c, whole[" " + c]) for c in new if c not in memo)
        get = memo.__getitem__
        return [whole[x[0]] + b"".join(map(get, x[1:])) if x else whole[t] for x, t in zip(lists, texts, strict=True)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.merges.bytes.__getitem__, ids)).decode("utf-8", "replace")


def spelled(of: pa.LargeBinaryArray, ids: np.ndarray, ends: np.ndarray) -> Iterator[memoryview]:
    """The bytes of all ids of each text, joined, by what each id stands for."""
    taken = of.take(pa.array(ids))
    at = np.frombuffer(taken.buffers()[1], np.int64)[ends].tolist() if len(ids) else [0] * len(ends)
    data = memoryview(taken.buffers()[2] or b"")
    return (data[s:e] for s, e in zip([0, *at], at, strict=False))


_encoders: dict[tuple[str, str], Encoder] = {}


def _encoder(tokenizer: str, lexicon: str) -> Encoder:
    if (tokenizer, lexicon) not in _encoders:
        _encoders.clear()
        _encoders[tokenizer, lexicon] = Encoder(tokenizer, SparkFiles.get(lexicon))
    return _encoders[tokenizer, lexicon]


def frequent_words(docs: DataFrame, most: int = LEXICON) -> list[str]:
    """The ``most`` pretokens that occur most often in all documents; a tie goes to the smaller one."""
    prepare(docs.sparkSession)
    names = ["word", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in joined(batches):
            texts, others = [], Counter()
            for t in texts_of(b):
                if _UNPLAIN.search(t):
                    others.update(pretokens(t))
                else:
                    texts.append(t)
            for s, e in slices(texts):
                found, zero = distinct_pretokens(texts[s:e])
                n = np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary))
                n[zero] = 0
                yield pa.RecordBatch.from_arrays([found.dictionary.cast(pa.large_string()).cast(pa.string()), pa.array(n, pa.int64())], names)
            yield pa.RecordBatch.from_arrays([pa.array(list(others), pa.string()), pa.array(list(others.values()), pa.int64())], names)

    counted = docs.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    known, path = materialize(counted.where(F.length("word").between(1, LONGEST) & (F.col("n") > 1)), "words")
    level = F.floor(F.log2("n") * 16)  # a few hundred levels, whatever the counts
    above, lowest = 0, 0
    for r in sorted(known.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r["level"]):
        above, lowest = above + r["words"], r["level"]
        if above >= most:
            break
    kept = [r["word"] for r in known.where(level >= lowest).orderBy(F.desc("n"), "word").limit(most).collect()]
    discard(docs.sparkSession, path)
    return kept


def share_lexicon(docs: DataFrame, tokenizer: str, most: int = LEXICON) -> str:
    """Compile the corpus' lexicon and hand it to all executors; gives the name under which they find it."""
    merges = Merges(tokenizer)
    words = {w.encode("utf-8", "surrogatepass"): None for w in frequent_words(docs, most)}
    data = compile_lexicon({w: merges(w) for w in words})
    name = f"lexicon-{uuid.uuid4().hex[:12]}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), name)
    with open(path, "wb") as f:
        f.write(data)
    docs.sparkSession.sparkContext.addFile(path)
    return name


def encode_decode(docs: DataFrame, tokenizer: str, most: int = LEXICON) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text's ids, and what they decode to."""
    name = share_lexicon(docs, tokenizer, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(tokenizer, name)
        for b in joined(batches):
            n, of_ids, of_text = [], [], []
            texts = texts_of(b)
            for s, e in slices(texts):
                ids, ends = coder.ids(texts[s:e])
                n += np.diff(ends, prepend=0).tolist()
                of_ids += [hashlib.sha256(x).hexdigest() for x in coder.written(ids, ends)]
                of_text += [hashlib.sha256(x.encode()).hexdigest() for x in coder.decoded(ids, ends)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, tokenizer: str, most: int = LEXICON) -> DataFrame:
    """doc_id, ids: the general form, with the ids themselves."""
    name = share_lexicon(docs, tokenizer, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(tokenizer, name)
        for b in batches:
            ids = [memoryview(x).cast("I").tolist() if x else [] for x in coder.some(texts_of(b))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, ids array<int>")
