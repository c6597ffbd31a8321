"""Token files, packing and the BPE lexicon against the tokenizers library."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from signflow.llm import bpe_lexicon, packing, token_codec
from signflow.llm.common import ByteBpe, WordBpe, tokenizer_path

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
TEXTS = ["", " ", "  a  b \n c", "a\n b<|endoftext|> c d<|endoftext|>", "<|ENDOFTEXT|> A, b. C.,", "日本語 テキスト ½ x²", "é Ǆ ΣΑΣ, İ.", "a" * 1500, "naïve_id 12ab's I'LL", "tail  ", "\x1c a\x1d \x1f x", "Word word, WORD. word.", "it's, 'S.", "x\ty\r\nz", "lots of words " * 700, "Ünïcode Straße, ÀÉ."]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(7 * i % 17, t, "x") for i, t in enumerate(TEXTS)] + [(3, None, "x"), (3, "again", "x"), (None, "no id", "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string")


@pytest.mark.parametrize(("kind", "path"), [(ByteBpe, BYTE), (WordBpe, WORD)])
def test_chunks_encode_as_the_library(kind, path):
    t, own = Tokenizer.from_file(path), kind(path)
    for _ in range(2):
        for text, raw in zip(TEXTS, own.texts(TEXTS), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text[:40]


def test_plain_texts_encode_as_the_library():
    rng, t, own = np.random.default_rng(4), Tokenizer.from_file(BYTE), ByteBpe(BYTE)
    own.most = 60  # the memo turns over all the time
    parts = [" ", " ", "  ", "\n", "\t", "\r\n", "'", "'s", "'re", "'ll", "'store", "''s", "ve", "l", "word", "Straße", "ɏé", "12", "3", ",", ".", "!?", "_", "é", "×", "²", "\0", "\x0b", "’", "<|endoftext|>", "語"]
    weights = np.array([6] * 24 + [0.02] * 7)
    texts = ["".join(rng.choice(parts, rng.integers(0, 30), p=weights / weights.sum())) for _ in range(4000)]
    for text, raw in zip(texts, own.texts(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_words_in_new_company_are_not_encoded_again():
    own, sent = ByteBpe(BYTE), []

    class Counting:
        def __init__(self, library):
            self.library = library

        def encode_batch_fast(self, texts, **more):
            sent.extend(map(len, texts))
            return self.library.encode_batch_fast(texts, **more)

    for name in ("tokenizer", "model"):
        if hasattr(own, name):
            setattr(own, name, Counting(getattr(own, name)))
    words = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(500)]
    list(own.texts([" " + " ".join(words)]))
    sent.clear()
    list(own.texts([f" {w}," for w in words] + [f" {w}.\n{words[0]}'s" for w in words]))
    assert sum(sent) < 100  # only the marks and the word without a space before it are new


def test_code_lengths_are_limited_and_complete():
    rng = np.random.default_rng(1)
    counts = (rng.pareto(0.4, 900) * 3).astype(np.int64)
    for limit in (10, 12, 20):
        n = token_codec.code_lengths(counts, limit).astype(int)
        assert n.max() <= limit and ((n > 0) == (counts > 0)).all()
        assert abs(sum(2.0 ** -x for x in n if x) - 1) < 1e-9
    assert token_codec.code_lengths(np.array([0, 5, 0]), 8).tolist() == [0, 1, 0]


def test_code_round_trip():
    rng = np.random.default_rng(2)
    ids = (rng.zipf(1.3, 5000) % 4000).astype(np.uint32)
    code = token_codec.Code(token_codec.code_lengths(np.bincount(ids), 13))
    payload, checkpoints = code.encode(ids)
    assert (code.decode(payload, checkpoints, len(ids)) == ids).all()


def test_token_files(spark, docs, tmp_path):
    token_codec.write_tokens(docs, f"file://{tmp_path}/t", BYTE)
    got = sorted((r for r in token_codec.read_tokens(spark, f"file://{tmp_path}/t", with_ids=True).collect()), key=lambda r: r["start"])
    t, at = Tokenizer.from_file(BYTE), 0
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in docs.collect()), key=lambda d: (d is not None, d))
    want = sorted((str(r["doc_id"]), [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]) for r in docs.collect())
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == want
    for r in got:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes()))
        at += r["n_tokens"]


def test_ids_are_counted_over_many_documents(spark, monkeypatch):
    monkeypatch.setattr(token_codec, "BLOCK", 50)
    texts = [f"word {k % 7} of {k}" for k in range(300)]
    t, want = Tokenizer.from_file(BYTE), {0: len(texts)}
    for x in texts:
        for i in t.encode(x, add_special_tokens=False).ids:
            want[i] = want.get(i, 0) + 1
    ids = token_codec.encode_ids(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3), BYTE, 0)
    assert {r["id"]: r["n"] for r in token_codec.id_counts(ids).collect()} == want
    tallies = ids.where("n_tokens is null")  # counting needs no ids
    assert tallies.count() == 3 and {r["id"]: r["n"] for r in token_codec.id_counts(tallies).collect()} == want


def test_token_files_of_nothing(spark, docs):
    assert token_codec.token_report(docs.limit(0), BYTE).count() == 0


def test_packing_covers_all_without_padding(spark, docs):
    t = Tokenizer.from_file(WORD)
    one = docs.coalesce(1)
    got = packing.pack(one, WORD, window=64).collect()
    pieces, fills = {}, {}
    for r in got:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], r["ids_crc32"]))
        fills.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in fills.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at == 64 or at & (at - 1) == 0
    total = sum(len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(n for x in fills.values() for _, n in x) == total
    long = [*t.encode(TEXTS[14], add_special_tokens=False).ids, 2]
    at = 0
    for start, n, crc in sorted(pieces[7 * 14 % 17, len(long)]):
        assert start == at and crc == zlib.crc32(np.array(long[start : start + n], "<u4").tobytes())
        at += n
    assert at == len(long)
    assert packing.pack(docs.limit(0), WORD).count() == 0


def test_lexicon_is_exact_and_minimal(tmp_path):
    merges = bpe_lexicon.Merges(BYTE)
    words = [b" walking", b" talking", b"walk", b" walk", b"a", " é".encode()]
    path = tmp_path / "lexicon"
    path.write_bytes(bpe_lexicon.compile_lexicon({w: merges(w) for w in words}))
    lexicon = bpe_lexicon.Lexicon(str(path))
    assert all(lexicon.get(w) == merges(w) for w in words)
    assert [lexicon.get(w) for w in (b"", b" wal", b" walks", b"talking")] == [None] * 4
    assert len(lexicon.final) < sum(map(len, words)) - 10  # suffixes are shared
    coder, t = bpe_lexicon.Encoder(BYTE, str(path)), Tokenizer.from_file(BYTE)
    for text, raw in zip(TEXTS, coder.some(TEXTS), strict=True):
        ids = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(raw, "<u4").tolist() == ids, text[:40]
        assert coder.decode(ids) == t.decode(ids, skip_special_tokens=False)


def test_lexicon_words_in_new_company_are_not_merged_again(tmp_path):
    path, sent = tmp_path / "lexicon", []
    path.write_bytes(bpe_lexicon.compile_lexicon({b" the": bpe_lexicon.Merges(BYTE)(b" the")}))
    coder = bpe_lexicon.Encoder(BYTE, str(path))
    for name in ("many", "packed"):
        if method := getattr(coder.merges, name, None):
            setattr(coder.merges, name, lambda words, method=method: sent.extend(words) or method(words))
    words = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(500)]
    coder.some([" " + " ".join(words)])
    assert len(set(sent)) == len(words)
    sent.clear()
    coder.some([f" {w}," for w in words] + [f" {w}.\n{words[0]}'s" for w in words])
    assert len(sent) < 10  # only the marks and the word without a space before it are new


def test_lexicon_encodes_mixed_texts_as_the_library(tmp_path):
    merges, rng, t = bpe_lexicon.Merges(BYTE), np.random.default_rng(5), Tokenizer.from_file(BYTE)
    path = tmp_path / "lexicon"
    path.write_bytes(bpe_lexicon.compile_lexicon({w: merges(w) for w in (b" word", b"word", b" ", b",")}))
    coder = bpe_lexicon.Encoder(BYTE, str(path), most=60)  # the memo turns over all the time
    parts = [" ", " ", "  ", "\n", "\t", "\r\n", "'", "'s", "'re", "'ll", "'store", "''s", "ve", "l", "word", "Straße", "ɏé", "12", "3", ",", ".", "!?", "_", "é", "×", "²", "\0", "\x0b", "’", "<|endoftext|>", "語"]
    weights = np.array([6] * 24 + [0.2] * 7)
    texts = ["".join(rng.choice(parts, rng.integers(0, 30), p=weights / weights.sum())) for _ in range(2000)]
    for some in (texts, ["語"] * 3, ["", ""], []):
        ids, ends = coder.ids(some)
        want = [t.encode(x, add_special_tokens=False).ids for x in some]
        assert [x.tolist() for x in np.split(ids, ends)[: len(some)]] == want
        assert [x.tobytes().decode() for x in coder.written(ids, ends)] == [",".join(map(str, x)) for x in want]
        assert list(coder.decoded(ids, ends)) == [t.decode(x, skip_special_tokens=False) for x in want]


def test_batches_without_new_chunks(spark):
    rows = spark.range(1500).selectExpr("id as doc_id", "if(id < 1200, 'hello', 'a b') as text").coalesce(1)
    t = Tokenizer.from_file(BYTE)
    want = {len(t.encode(x, add_special_tokens=False).ids): n for x, n in (("hello", 1200), ("a b", 300))}
    assert {r["n_tokens"]: r["count"] for r in bpe_lexicon.encode_decode(rows, BYTE).groupBy("n_tokens").count().collect()} == want


def test_broken_utf8_is_decoded_as_the_library(tmp_path):
    merges, t = bpe_lexicon.Merges(BYTE), Tokenizer.from_file(BYTE)
    path = tmp_path / "lexicon"
    path.write_bytes(bpe_lexicon.compile_lexicon({}))
    coder = bpe_lexicon.Encoder(BYTE, str(path))
    lists = [[i for x in raw for i in merges(bytes([x]))] for raw in (b"a\xe6\x97b", b"\xff\xc3\xa9", b"\xc3", b"\xf0\x9f\x98", b"")]
    got = coder.decoded(np.array([i for x in lists for i in x], "<u4"), np.cumsum([len(x) for x in lists]))
    assert list(got) == [t.decode(x, skip_special_tokens=False) for x in lists]


def test_frequent_words_are_counted_exactly(spark, docs):
    counts = Counter(w for r in docs.collect() for w in bpe_lexicon.pretokens(r["text"] or ""))
    known = sorted((w for w, n in counts.items() if n > 1 and len(w) <= bpe_lexicon.LONGEST), key=lambda w: (-counts[w], w.encode()))
    assert bpe_lexicon.frequent_words(docs) == known
    assert bpe_lexicon.frequent_words(docs, 7) == known[:7]


def test_bpe_report(spark, docs):
    t = Tokenizer.from_file(BYTE)
    got = sorted(tuple(map(str, r)) for r in bpe_lexicon.encode_decode(docs, BYTE, most=50).collect())
    want = []
    for r in docs.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((str(r["doc_id"]), str(len(ids)), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe_lexicon.encode_decode(docs.limit(0), BYTE).count() == 0


def test_merging_many_words_at_once():
    merges, rng = bpe_lexicon.Merges(BYTE), np.random.default_rng(3)
    words = [bytes(rng.choice(list(b" thesaninger\xc3\xa9\xff.01"), rng.integers(1, 45)).tolist()) for _ in range(3000)]
    assert merges.many(words) == [merges(w) for w in words]
    assert merges.many([]) == []


def test_placement_makes_the_sum_of_squares_least():
    rng = np.random.default_rng(3)
    for window in (8, 32):
        packer, counts = packing.SumOfSquares(window), [0] * (window + 1)
        for k in range(400):
            n = int(rng.integers(1, window))

            def after(level):
                c = list(counts)
                c[level] -= level > 0
                c[level + n] += level + n < window
                return sum(x * x for x in c[1:window])

            able = [level for level in range(window + 1 - n) if level == 0 or counts[level]]
            least = min(map(after, able))
            at = max(level for level in able if after(level) == least)
            full = packer.place((k, 0, np.zeros(n, "<u4"), n))
            counts[at] -= at > 0
            counts[at + n] += at + n < window
            assert (full is not None) == (at + n == window) and packer.level[1:window].tolist() == counts[1:window]
