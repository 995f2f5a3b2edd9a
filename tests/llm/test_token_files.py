import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerpulse.llm import token_files as t
from ledgerpulse.llm.queries import QUERIES, table

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def brute(tokenizer, pairs):
    """Rows by doc_id, missing first; only for pairs whose order is told by the doc_id."""
    out, start = [], 0
    for i, text in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])


@given(st.lists(st.integers(0, 1 << 40), max_size=700).map(sorted), st.integers(0, 60))
@settings(max_examples=60, deadline=None)
def test_elias_fano_round_trip(values, shift):
    values = [v >> min(shift, 40) for v in values]
    data = t.EliasFano.encode(np.array(values, dtype=np.uint64))
    coded = t.EliasFano(data)
    assert coded.values().tolist() == values and [coded[i] for i in range(len(coded))] == values


def test_elias_fano_space():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000))
    assert len(t.EliasFano.encode(values)) * 8 / len(values) < 2 + np.log2(1000) + 1.2  # bits a value, against 64


def test_ids_of_odd_texts(tokenizer):
    rng = random.Random(2)
    pieces = [" ", "  ", "\n", " \n", "\t", "a", "Word", "don't", "12", "é", "漢字", "🙂", "　", "\xa0", "\x1c", "\x85", "_", "...", "<|endoftext|>", "\x00", "'s", " ’s"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 30))) for _ in range(3000)] + ["", None, " ", "   ", "a ", " a"]
    found = t.ByteTokenizer(PATH).ids(pa.array(texts))
    for text, ids in zip(texts, found, strict=True):
        assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("shard_ids", [t.SHARD_IDS, 50])
def test_against_brute_force(spark, documents, tokenizer, shard_ids):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["Some", "words,", "é\n", "and", "  more"]) for _ in range(n))
    pairs = [(rng.randrange(-(1 << 62), 1 << 62), text(rng.randrange(40))) for _ in range(200)] + [(-5, None), (7, ""), (None, "no id"), (8, "long " * 500_000)]
    pairs += [(9, "the same")] * 40  # repeated rows
    docs = documents(pairs).selectExpr("*", "1 as shard", "2 as n_ids", "3 as start")
    assert rows(t.token_table(docs, PATH, 2, shard_ids)) == brute(tokenizer, pairs)


def test_rows_of_one_id_are_all_kept(spark, documents, tokenizer):
    pairs = [(1, f"text {i % 7}") for i in range(50)] + [(None, "x"), (None, None)]
    found = t.token_table(documents(pairs), PATH, 2).collect()
    want = [np.array([*tokenizer.encode(x or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes() for _, x in pairs]
    assert sorted(bytes(r.ids) for r in found) == sorted(want)
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_empty_table(spark, documents):
    assert t.token_table(documents([]), PATH, 2).count() == 0


def test_a_shard_gives_documents_by_number():
    documents = [np.arange(n, dtype="<u4") for n in (3, 1, 500, 2)]
    shard = t.TokenShard(t.TokenShard.pack([None, -4, 9, 9], documents, 4) + b"\n")
    assert [shard[i].tolist() for i in range(4)] == [d.tolist() for d in documents]
    assert [shard.doc_id(i) for i in range(4)] == [None, -4, 9, 9]
    with pytest.raises(ValueError):
        t.TokenShard(b"x" * 100)


def test_query_against_brute_force(spark, data, tokenizer):
    pairs = [(r.doc_id, r.text) for r in table(spark, data, "documents").collect()]
    assert rows(QUERIES["op12_token_files"](spark, data)) == brute(tokenizer, pairs)
