import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from canonframe.llm import huffman as H, pieces as P

from .helpers import documents, no_docs, odd_docs

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
LIB, HF = sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(BYTES)
ODD = st.text(alphabet=st.sampled_from(list("ab thenio\n\t\r 　\x1c▁éß語😀<s>|end'l.,!0")), max_size=40)


def piece_ids(text):
    return np.frombuffer(P.pieces(PIECES).encode(text), "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.one_of(ODD, st.text(max_size=30)))
def test_pieces_equal_the_library(text):
    want = LIB.encode(text, add_bos=True, add_eos=True)
    assert piece_ids(text) == want
    assert P.pieces(PIECES).decode(want) == LIB.decode(want)


def test_joined_pieces_equal_the_library():
    rng = random.Random(6)
    vocabulary = [LIB.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    for _ in range(3000):
        text = "".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 6)))
        assert piece_ids(text) == LIB.encode(text, add_bos=True, add_eos=True)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=10))
def test_decoding_any_ids(ids):
    assert P.pieces(PIECES).decode(ids) == LIB.decode(ids)


def test_piece_digests_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = {(r["doc_id"], r["ids_sha256"], r["n_tokens"], r["decoded_sha256"]) for r in P.digests(docs, PIECES).collect()}
    want = set()
    for r in docs.collect():
        ids = LIB.encode(r["text"] or "", add_bos=True, add_eos=True)
        want.add((r["doc_id"], hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), len(ids), hashlib.sha256(LIB.decode(ids).encode()).hexdigest()))
    assert got == want and P.digests(docs, PIECES).count() == docs.count()
    assert P.digests(no_docs(spark), PIECES).count() == 0
    back = P.decode(P.encode(documents(spark), PIECES), PIECES).toPandas().set_index("doc_id")["text"]
    assert all(back[r["doc_id"]] == r["text"] for r in documents(spark).collect())


def test_memo_generations(monkeypatch):
    monkeypatch.setattr(P, "MEMO", 3)
    table = P.Pieces(PIECES)
    text = "the cat and the dog and the bird saw the cat again " * 3
    assert np.frombuffer(table.encode(text), "<u4").tolist() == LIB.encode(text, add_bos=True, add_eos=True)


@settings(max_examples=400, deadline=None)
@given(st.one_of(ODD, st.text(max_size=30), st.just("a<|endoftext|> b")))
def test_byte_level_equals_the_library(text):
    got = np.frombuffer(H.byte_level(BYTES).encode(text), np.uint16).tolist()
    assert got == HF.encode(text, add_special_tokens=False).ids + [H.END]


@pytest.mark.parametrize("n", [1, 2, 3, 100, 50257])
def test_codes_round_trip_and_are_complete(n):
    rng = np.random.default_rng(n)
    counts = (rng.pareto(0.4, n) * 5 + 1).clip(max=1e12).astype(np.int64)
    lengths = H.code_lengths(counts)
    assert lengths.max() <= H.LIMIT and (n == 1 or (0.5 ** lengths).sum() == 1)
    code = H.Code(np.arange(n) * 1, lengths)
    ids = rng.choice(n, 5000, p=counts / counts.sum())
    data, marks = code.encode(ids)
    blocks = np.array([H.BLOCK] * (len(marks) - 1) + [5000 - H.BLOCK * (len(marks) - 1)])
    assert (code.decode(np.frombuffer(data, np.uint8), marks, blocks) == ids).all()
    k = len(marks) - 2                                                   # a block decodes on its own
    assert (code.decode(np.frombuffer(data, np.uint8), marks[k:k + 1], blocks[k:k + 1]) == ids[k * H.BLOCK:(k + 1) * H.BLOCK]).all()


def test_documents_coded_together_are_coded_alone():
    rng = np.random.default_rng(3)
    code = H.Code(np.arange(300), H.code_lengths(rng.integers(1, 10_000, 300)))
    counts = rng.integers(1, 4000, 50)
    ids = rng.integers(0, 300, counts.sum())
    at = 0
    for n, (data, marks) in zip(counts.tolist(), code.encode_all(ids, counts)):
        alone, alone_marks = code.encode(ids[at:at + n])
        assert data == alone and (marks == alone_marks).all()
        at += n


def test_code_lengths_are_optimal_without_a_limit():
    import heapq
    counts = np.random.default_rng(7).integers(1, 1000, 60)
    heap, total = sorted(counts.tolist()), 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total += a + b
        heapq.heappush(heap, a + b)
    assert (H.code_lengths(counts) * counts).sum() == total
    assert H.code_lengths(2 ** np.arange(12), 5).max() <= 5


@pytest.mark.parametrize("make", [documents, odd_docs])
def test_token_files_round_trip(spark, make):
    docs = make(spark)
    path = H.write_tokens(docs, BYTES)
    got = H.read_tokens(spark, path).orderBy("start").collect()
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in rows]
    start = 0
    for g, r in zip(got, rows):
        ids = HF.encode(r["text"] or "", add_special_tokens=False).ids + [H.END]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert g["ids"] == ids
        start += len(ids)


def test_no_token_files(spark):
    assert H.read_tokens(spark, H.write_tokens(no_docs(spark), BYTES)).count() == 0
