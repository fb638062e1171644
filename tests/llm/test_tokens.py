"""Operators 2, 9 and 10: exact against their libraries, laws and round trips."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from sampleyard.llm import byte_bpe, queries, sharding, token_files

from . import odd

RANKS = P.path("byte_bpe_50k.tiktoken")
HARD = ["a" * 5000, " " * 3000 + "x", "it's we'll I'm\n\n\n  done", "é中\U0001f600 " * 700, "<|endoftext|> plain", "x\r\n\t y" * 900, "1234567890" * 400, "don't" * 1000]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digest(ids):
    return hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_byte_bpe_is_the_librarys(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, odd.SMALL, "documents").collect()}
    got = {r["doc_id"]: r for r in queries.op2_byte_bpe(spark, odd.SMALL).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        ids = library.encode_ordinary(t)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), digest(ids), hashlib.sha256(t.encode()).hexdigest())


@pytest.mark.parametrize("chunk, overlap", [(64, 16), (1000, 40), (16384, 256)])
def test_chunks_are_stitched_without_a_trace(spark, library, chunk, overlap):
    long = "".join(r["text"] or "" for r in queries.table(spark, odd.SMALL, "documents").limit(12).collect())
    texts = [*HARD, long, long, ""]
    docs = odd.documents(spark, [(i, t, None) for i, t in enumerate(texts)])
    encoded = byte_bpe.encode(docs, RANKS, P.PATTERN, chunk_chars=chunk, overlap_chars=overlap)
    got = {r["doc_id"]: (r["ids"], bytes(r["decoded"])) for r in byte_bpe.decode(encoded, RANKS).collect()}
    assert got == {i: (library.encode_ordinary(t), t.encode()) for i, t in enumerate(texts)}


def test_byte_bpe_of_odd_rows(spark, library):
    docs = odd.odd_documents(spark)
    rows = byte_bpe.encode(docs, RANKS, P.PATTERN).collect()
    key = lambda x: (str(x[0]), x[1])
    assert sorted(((r["doc_id"], r["ids"]) for r in rows), key=key) == sorted(((r["doc_id"], library.encode_ordinary(r["text"] or "")) for r in docs.collect()), key=key)
    assert byte_bpe.encode(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_feistel_is_a_permutation_with_an_inverse():
    for total in (1, 2, 3, 16, 17, 1000, 4097):
        numbers = np.arange(total)
        moved = sharding.permute(numbers, total, seed=9)
        assert sorted(moved) == list(range(total))
        assert (sharding.permute(moved, total, seed=9, back=True) == numbers).all()
        shard, slot = sharding.place(numbers, total, 16, seed=9)
        assert (sharding.row_at(shard, slot, total, 16, seed=9) == numbers).all()


def test_shards_obey_their_law(spark):
    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, odd.SMALL, "documents").collect()}
    rows = queries.op9_feistel_shards(spark, odd.SMALL).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs.items()}
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
    slots = [sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(16)]
    assert all(s == list(range(len(s))) for s in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.assign(queries.table(spark, odd.SMALL, "documents").repartition(3)).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}


def test_shards_of_odd_rows(spark):
    docs = odd.odd_documents(spark)
    rows = sharding.assign(docs, shards=5).collect()
    assert sorted(r["row_number"] for r in rows) == list(range(docs.count()))
    raw = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]  # repeats, ties of ids and null texts included
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    want = sorted(((i, len(t) + 1, zlib.crc32(t)) for i, t in raw), key=key)
    assert [(r["doc_id"], r["size"], r["text_crc32"]) for r in sorted(rows, key=lambda r: r["row_number"])] == want
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows if r["size"] == 1} == {(None, 1, 0), (3, 1, 0), (4, 1, 0)}
    shard, slot = sharding.place(np.arange(len(rows)), len(rows), 5, seed=42)
    assert {r["row_number"]: (r["shard"], r["slot"]) for r in rows} == {k: (int(a), int(b)) for k, (a, b) in enumerate(zip(shard, slot, strict=True))}
    assert sharding.assign(docs.limit(0)).count() == 0


def test_token_files_hold_the_librarys_ids(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    docs = sorted((r["doc_id"], r["text"] or "") for r in queries.table(spark, odd.SMALL, "documents").collect())
    start, wanted = 0, []
    for i, text in docs:
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        wanted.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in queries.op10_token_files(spark, odd.SMALL).collect())
    assert got == wanted


def test_strings_of_special_tokens_are_their_ids(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = ["<|endoftext|>", "one <|endoftext|> two<|startoftext|>three", "<|EndOfText|> <| endoftext|> <|", "a" * 300 + "<|endoftext|>\n<|endoftext|>"]
    index = token_files.write_token_files(odd.documents(spark, [(i, x, None) for i, x in enumerate(texts)]), P.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r["ids"] for r in token_files.read_documents(index).collect()}
    assert got[0] == [49407, 1] and got == {i: [*t.encode(x, add_special_tokens=False).ids, 1] for i, x in enumerate(texts)}


def test_token_files_of_odd_rows_and_random_access(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    docs = odd.odd_documents(spark).union(odd.documents(spark, [(50 + i, x, None) for i, x in enumerate(HARD)]))
    index = token_files.write_token_files(docs, P.path("word_bpe_49k.json"), seq_len=32, batch_rows=4)
    got = token_files.read_documents(index).collect()
    key = lambda x: (str(x[0]), x[1])
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=key) == sorted(((r["doc_id"], [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in docs.collect()), key=key)
    file, tokens = token_files.files_of(spark, index).orderBy("file").first()
    opened = token_files.TokenFile(file)
    masks = [opened.sequence(k)[1].sum() for k in range(-(-tokens // 32))]
    assert sum(masks) == tokens and all(m == 32 for m in masks[:-1])
    opened.close()
    assert token_files.read_digests(token_files.write_token_files(docs.limit(0), P.path("word_bpe_49k.json"))).count() == 0
