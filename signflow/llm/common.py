"""Helpers that several operators of this package share."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signflow.session import ship

#: Rows in an Arrow batch: with texts of some kilobytes a batch stays at a few megabytes.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Send the package to the executors and keep Arrow batches small, unless the session sets its own size."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def concat_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and the n + 1 offsets of the texts in it."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return np.frombuffer(b"".join(parts), np.uint8), offsets


def slices(texts: list[str], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``most`` characters each; a longer text has a run of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def joined(batches: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches, put together up to about ``most`` bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def tokenizer_path(name: str) -> str:
    """The default place of a public tokenizer's file; operators take any path instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Whole texts to little-endian uint32 ids, by the chunks between spaces.

    A tokenizer whose pretokens never run from a non-space across a space gives a text the ids of its chunks.
    Chunks seen before come from a memo (emptied when it holds ``most``); all new chunks of some texts go to
    the tokenizers library as one text, whose ids are then cut at the chunks.
    """

    #: Characters encoded together, about.
    RUN = 2_000_000

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def whole(self, text: str) -> bytes:
        return self.ids(text).tobytes()

    def known(self, lists: list[list[str]]) -> None:
        """Have all chunks of ``lists`` in the memo."""
        wanted = set().union(*lists)
        new = wanted.difference(self.memo)
        if len(self.memo) + len(new) > self.most:
            self.memo.clear()
            new = wanted
        if new:
            self.learn(list(new))

    def learn(self, new: list[str]) -> None:
        raise NotImplementedError

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        for s, e in slices(texts, self.RUN):
            yield from self.some(texts[s:e])

    def some(self, texts: list[str]) -> list[bytes]:
        raise NotImplementedError


#: What byte-level pretokens are made of, by byte: the 0 between texts, letters (and bytes of Latin ones), digits, other signs, white space.
_KINDS = np.full(256, 3, np.uint8)
for _k, _of in enumerate((b"\0", bytes(c for c in range(256) if c > 127 or chr(c).isalpha()), b"0123456789", b"", b" \t\n\r")):
    _KINDS[list(_of)] = _k


def pretoken_starts(raw: bytes) -> np.ndarray:
    """Offsets of the byte-level pretokens of plain texts, each with a byte 0 behind it (which is one by itself).

    They are contractions; letters, digits or other signs with a space before them; white space, whose last
    character before something else is left to itself. Fixed by the tokenizer.
    """
    b = np.frombuffer(raw, np.uint8)
    kind = _KINDS[b]
    start = np.ones(len(b), bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[kind == 0] = True
    last = np.flatnonzero((kind[:-1] == 4) & (kind[1:] > 0) & (kind[1:] < 4))
    start[last] = True
    start[last[b[last] == 32] + 1] = False
    mark = np.flatnonzero(b == 39)
    mark = mark[start[mark]]
    one, two = b[mark + 1], b[np.minimum(mark + 2, len(b) - 1)]
    for at, n in ((np.isin(one, [*b"stmd"]), 2), ((two == 101) & ((one == 114) | (one == 118)) | (one == 108) & (two == 108), 3)):  # re, ve, ll
        start[mark[at] + 1] = False
        start[mark[at] + n] = True
    return np.flatnonzero(start)


def distinct_pretokens(texts: list[str]) -> tuple[pa.DictionaryArray, int]:
    """The byte-level pretokens of plain texts, a byte 0 behind each text, and that byte's code."""
    raw = "\0".join([*texts, ""]).encode()
    at = pretoken_starts(raw)
    found = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(raw))), pa.py_buffer(raw)]).dictionary_encode()
    return found, found.dictionary.index(pa.scalar(b"\0", pa.large_binary())).as_py()


class PlainTexts:
    """Byte-level BPE of plain texts: all pretokens of some texts are found at once, and each distinct one is looked up once.

    The memo is two dicts: once the newer one holds half of ``most`` it replaces the older, so that what is met
    again stays. ``merge`` gives the ids of pretokens that it lacks.
    """

    def __init__(self, most: int):
        self.most = most
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def merge(self, words: list[bytes]) -> list[bytes]:
        raise NotImplementedError

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct pretokens, from the memo or merged."""
        out = list(map(self.new.get, words))
        missing = [w for w, x in zip(words, out, strict=True) if x is None]
        if missing:
            found = list(map(self.old.get, missing))
            unknown = [w for w, x in zip(missing, found, strict=True) if x is None]
            if unknown:
                merged = iter(self.merge(unknown))
                found = [next(merged) if x is None else x for x in found]
            if len(self.new) + len(missing) > self.most // 2:
                self.old, self.new = self.new, {}
            self.new.update(zip(missing, found, strict=True))
            rest = iter(found)
            out = [next(rest) if x is None else x for x in out]
        return out

    def plain_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts without odd characters and special tokens, one after the other, and where each text's end."""
        found, zero = distinct_pretokens(texts)
        codes, words = found.indices.to_numpy(), found.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = self.words(words[:zero] + words[zero + 1 :])
        ids.insert(zero, b"")
        flat, n = np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) for x in ids]) // 4
        first, n = (np.cumsum(n) - n)[codes], n[codes]
        to = np.cumsum(n)
        return flat[np.repeat(first - (to - n), n) + np.arange(to[-1])], to[codes == zero]


class ByteBpe(PlainTexts, ChunkEncoder):
    """For a byte-level BPE.

    New pretokens of plain texts go to the library's model as one text in the letters of its vocabulary, whose ids
    are then cut by the bytes they stand for. Other texts (other scripts, control characters, special tokens) go by
    chunks with the space before them.
    """

    RUN = 4_000_000

    def __init__(self, path: str):
        ChunkEncoder.__init__(self, path)
        PlainTexts.__init__(self, self.most)
        from tokenizers import Tokenizer, pre_tokenizers

        t = self.tokenizer
        names = [t.id_to_token(i) or "" for i in range(t.get_vocab_size())]
        self.leads = np.array([x.startswith("\u0120") for x in names])
        self.n_bytes = np.array([len(x) for x in names])
        self.special = [x.content for x in t.get_added_tokens_decoder().values()]
        pre = t.pre_tokenizer
        self.usual = t.normalizer is None and isinstance(pre, pre_tokenizers.ByteLevel) and pre.use_regex and not pre.add_prefix_space
        self.model = Tokenizer(t.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.letters = {b: b if b in shown else next(rest) for b in range(256)} | {0: 32}

    def learn(self, new: list[str]) -> None:
        named = [c for c in new if c]
        ids = self.ids(" " + " ".join(named)) if named else np.zeros(0, "<u4")
        starts = np.flatnonzero(self.leads[ids]) if named else ids
        if len(starts) == len(named):
            raw, at = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
            self.memo.update(zip(named, [raw[s:e] for s, e in zip(at, at[1:], strict=False)], strict=True))
        else:
            self.memo.update((c, self.whole(" " + c)) for c in named)
        self.memo[""] = self.whole(" ")

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of pretokens, by the library's model."""
        text = b"\0".join(words).decode("latin-1").translate(self.letters)
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        to = np.cumsum(self.n_bytes[ids])
        ends = np.cumsum([len(w) for w in words])
        cut = np.searchsorted(to, ends)
        if not len(to) or to[-1] != ends[-1] or (to[cut] != ends).any():  # a vocabulary without some bytes
            return [self.whole(w.decode()) for w in words]
        raw, at = ids.tobytes(), (4 * cut + 4).tolist()
        return [raw[s:e] for s, e in zip([0, *at], at, strict=False)]

    def plain(self, texts: list[str]) -> list[bytes]:
        """The ids of texts without odd characters and special tokens."""
        ids, ends = self.plain_ids(texts)
        raw, ends = ids.tobytes(), (4 * ends).tolist()
        return [raw[s:e] for s, e in zip([0, *ends], ends, strict=False)]

    def chunks(self, texts: list[str]) -> list[bytes]:
        """The ids of any texts, by chunks."""
        lists = [[] if "  " in t else t.split(" ") for t in texts]  # runs of spaces are pretokens of their own
        self.known([x[1:] for x in lists])
        get = self.memo.__getitem__
        return [self.whole(x[0]) + b"".join(map(get, x[1:])) if x else self.whole(t) for x, t in zip(lists, texts, strict=True)]

    def some(self, texts: list[str]) -> list[bytes]:
        odd = [not self.usual or _ODD.search(t) is not None or any(s in t for s in self.special) for t in texts]
        parts = [iter(way(some) if (some := [t for t, o in zip(texts, odd, strict=True) if o == k]) else []) for k, way in ((False, self.plain), (True, self.chunks))]
        return [next(parts[o]) for o in odd]


#: Neither plain ASCII nor a Latin letter.
_ODD = re.compile("[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ɏ]")


class WordBpe(ChunkEncoder):
    """For a tokenizer that drops white space: each chunk stands alone."""

    #: A control character, one id by itself, that parts the chunks given to the library.
    MARK = "\x1f"

    def __init__(self, path: str):
        super().__init__(path)
        (self.mark,) = self.ids(self.MARK)
        self.closing = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(self.tokenizer.get_vocab_size())])

    def learn(self, new: list[str]) -> None:
        ended = [c for c in new if c[-1:] in (".", ",") and c[:-1].isalpha() and not _CASED.search(c)]  # a word and a mark are pretokens of their own
        memo, plain = self.memo, set(new).difference(ended, ("",))
        plain.update([c[:-1] for c in ended if c[:-1] not in memo], ".,")
        odd = [c for c in plain if self.MARK in c]
        words = [c for c in plain if c.isalpha() and not _CASED.search(c)]  # one pretoken each, closed by its last id
        plain = list(plain.difference(odd, words))
        ids = self.ids(" ".join(words))
        ends = 4 * np.flatnonzero(self.closing[ids]) + 4
        if len(ends) == len(words):
            raw, e = ids.tobytes(), ends.tolist()
            memo.update(zip(words, [raw[s:t] for s, t in zip([0, *e], e, strict=False)], strict=True))
        else:
            memo.update((c, self.whole(c)) for c in words)
        ids = self.ids(f" {self.MARK} ".join([*plain, ""]))
        ends = np.flatnonzero(ids == self.mark)
        if len(ends) == len(plain):
            raw, e = ids.tobytes(), (4 * ends).tolist()
            memo.update(zip(plain, [raw[s:t] for s, t in zip([0, *(4 * ends + 4).tolist()], e, strict=False)], strict=True))
        else:
            memo.update((c, self.whole(c)) for c in plain)
        memo.update((c, self.whole(c)) for c in odd)
        memo.update([(c, memo[c[:-1]] + memo[c[-1]]) for c in ended])
        memo[""] = b""

    def some(self, texts: list[str]) -> list[bytes]:
        low = [t if "<|" in t or not t.isascii() and _CASED.search(t) else t.lower() for t in texts]  # the tokenizer does so itself
        lists = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in low]
        self.known(lists)
        get = self.memo.__getitem__
        return [b"".join(map(get, x)) for x in lists]


#: What is neither ASCII nor a Latin-1 letter: there, lower case may depend on neighbours.
_CASED = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ÿ]")


_encoders: dict[tuple, object] = {}


def encoder(kind: type, path: str):
    """The worker's encoder; its memo lasts from task to task."""
    if (kind, path) not in _encoders:
        _encoders[kind, path] = kind(path)
    return _encoders[kind, path]
