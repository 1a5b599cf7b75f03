"""Byte-level BPE against the library, and its scans against plain steps of the automaton."""

import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from plexweave.llm import byte_bpe
from plexweave.llm.queries import QUERIES
from tests.conftest import DATA

ALPHABET = "ab'stmdrevlSTRE 12 \n\t!?'’ é中　 \x1ć'Ⅷ"
CASES = ["", " ", "  ", "a'", "'", "'s", "'r", "'re", " 's", "''s", "a 's", "\n's", "  's", "'ll'll've's", "a  b", "a \n", "\0'\0s", "don't DON'T", "x" * 300 + " " * 90, "'" * 70]


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.tokenizer()


@pytest.fixture(scope="module")
def library(bpe):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def drawn(n, longest=60, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_texts_against_the_library(bpe, library):
    texts = [*CASES, *drawn(4000)]
    for text, ids in zip(texts, bpe.encode_all(texts)):
        assert ids.tolist() == library.encode_ordinary(text), text
        assert bpe.decode(ids, bpe.offsets(ids)) == text.encode()


def test_every_code_point_has_the_library_s_class(bpe, library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"x{c}x1{c}1!{c}! {c} " for c in points[k : k + 2000]) for k in range(0, len(points), 2000)]
    assert [i.tolist() for i in bpe.encode_all(texts)] == library.encode_ordinary_batch(texts)


@pytest.mark.parametrize("stretch", [1, 2, 3, 7, 64, 1000])
def test_stretches_give_the_same_starts(stretch):
    texts = [*CASES, *drawn(200, seed=2)]
    codes = np.frombuffer("\0".join(texts).encode("utf-32-le"), "<u4")
    ends = np.cumsum([len(t) + 1 for t in texts])[:-1] - 1
    assert (byte_bpe.starts(codes, ends, stretch) == byte_bpe.starts(codes, ends)).all()
    pieces, at = [], 0
    for t in texts:
        pieces += [m.start() + at for m in regex.finditer(public_tokenizers.PATTERN, t)] + [at + len(t)]
        at += len(t) + 1
    assert byte_bpe.starts(codes, ends).tolist() == pieces[:-1]


@pytest.mark.parametrize("n", [0, 1, 64, 65, 2048, 5000])
def test_scan_against_single_steps(n):
    follows, _ = byte_bpe._automaton()
    functions = byte_bpe._Functions(follows)
    symbols = np.random.default_rng(n).integers(0, 9, n)
    before, state = functions.states(functions.of_symbol.take(symbols), byte_bpe.FRESH)
    plain = [byte_bpe.FRESH]
    for s in symbols:
        plain.append(int(follows[plain[-1], s]))
    assert [*before.tolist(), state] == plain


def test_both_ways_of_merging(bpe, library, monkeypatch):
    rng = random.Random(4)
    for _ in range(300):
        piece = "".join(rng.choice("aabcéthe") for _ in range(rng.randint(2, 150))).encode()
        assert bpe._merged_by_heap(piece) == library._core_bpe.encode_single_piece(piece)
    monkeypatch.setattr(byte_bpe, "CACHE_PIECES", 10)
    fresh = byte_bpe.ByteBpe(public_tokenizers.path(byte_bpe.RANKS))
    texts = drawn(300, seed=5)
    assert [i.tolist() for i in fresh.encode_all(texts)] == library.encode_ordinary_batch(texts) and len(fresh.pieces) <= 10


def test_query_against_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = QUERIES["op11_byte_bpe"](spark, DATA).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == sha256(library.decode_bytes(ids)).hexdigest()


def test_odd_rows_and_the_way_back(spark, library):
    rows = [(None, None, "x"), (1, "", None), (1, "a b", None), (2, "<|endoftext|>", None), (2, "<|endoftext|>", None), (3, "long " * 60_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = byte_bpe.byte_encoded(docs)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in found.collect()) == sorted((str(i), library.encode_ordinary(t or "")) for i, t, _ in rows)
    back = sorted((str(r["doc_id"]), bytes(r["data"])) for r in byte_bpe.byte_decoded(found).collect())
    assert back == sorted((str(i), (t or "").encode()) for i, t, _ in rows)
    loose = spark.createDataFrame([(1, None, None), (2, [64, 65], None)], "doc_id long, ids array<int>, offsets array<long>")
    assert {r["doc_id"]: bytes(r["data"]) for r in byte_bpe.byte_decoded(loose).collect()} == {1: b"", 2: library.decode_bytes([64, 65])}
    assert byte_bpe.byte_encoded(docs.limit(0)).count() == 0
