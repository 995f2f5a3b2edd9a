import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from ledgerpulse.llm import packing as p
from ledgerpulse.llm.queries import QUERIES, table

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute_pieces(docs, capacity=2048):
    tokenizer = Tokenizer.from_file(PATH)
    out = []
    for i, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out.append((i, k, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    return sorted(out, key=str)


def check(packed, capacity=2048):
    """Gapless sequences within the capacity; returns how many there are."""
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_best_fit_is_within_capacity():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 101, 2000)
    bins = p.best_fit(sizes, 100)
    filled = np.bincount(bins, weights=sizes)
    assert filled.max() <= 100
    assert len(filled) <= 1.03 * -(-sizes.sum() // 100)


def test_untidy_rows(spark, documents):
    odd = "Ünïcode's <|endoftext|> don't 12345  x　y\x1cz ́é \t\v\f end " + "w" * 300
    pairs = [(1, odd), (1, odd), (2, None), (3, ""), (None, "lost"), (2**62 + 1, "large id"), (4, "word " * 5000), (5, "a  b\n\nc")]
    docs = documents(pairs).withColumn("sequence_id", F.lit("x")).withColumn("piece", F.lit("y"))
    rows = p.pack_documents(docs, PATH).collect()
    assert sorted((tuple(r)[:5] for r in rows), key=str) == brute_pieces(pairs)
    check(rows)
    assert p.pack_documents(docs.limit(0), PATH).count() == 0


def test_tree_of_rounds(spark):
    rng = random.Random(2)
    rows = [(str(i), 0, 0, rng.choice([1, 30, 400, 700, 1100, 1500, 2040, 2048]), 7) for i in range(3000)]
    pieces = spark.createDataFrame(rows, p.PIECES)
    packed = p.pack(pieces, task_pieces=200).collect()
    assert sorted((r.doc_id, r.length) for r in packed) == [(int(r[0]), r[3]) for r in rows]
    one = check(p.pack(pieces).collect())
    assert one <= check(packed) <= 1.02 * one
    halves = spark.createDataFrame([(str(i), 0, 0, 1100, 7) for i in range(500)], p.PIECES)  # nothing fits together
    assert check(p.pack(halves, task_pieces=20).collect()) == 500


def test_query_against_brute_force(spark, data):
    docs = [(r.doc_id, r.text) for r in table(spark, data, "documents").collect()]
    rows = QUERIES["op3_best_fit_packing"](spark, data).collect()
    want = brute_pieces(docs)
    assert sorted((tuple(r)[:5] for r in rows), key=str) == want
    assert check(rows) <= 1.02 * -(-sum(w[3] for w in want) // 2048) + 1


def test_words_are_remembered_as_arrays_up_to_a_bound(monkeypatch):
    kept = {}
    monkeypatch.setattr(p, "worker_memory", lambda name: kept.setdefault(name, {}))
    monkeypatch.setattr(p, "REMEMBERED", 3000)
    monkeypatch.setattr(p, "CALL", 700)
    tokenizer, plain = p.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    texts = [" ".join(f"{'w' * (n % 90)}{n}" for n in range(at, at + 2000)) for at in (0, 1000, 5000, 0)]
    for text in (*texts, "", None, "w0"):
        want = np.array(plain.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert tokenizer.ids(pa.array([text, text], pa.string())) == [want, want]
        (memory,) = kept.values()
        words = memory["words"].to_pylist()
        assert len(words) == len(set(words)) == len(memory["sizes"]) <= 3000 and max(map(len, words)) <= 64
        assert sum(memory["sizes"]) == len(memory["ids"])
        assert sum(x.nbytes for x in memory.values()) < 300 * len(words)
    assert words[0] == "w0"  # the words of the last texts come first


def test_batches_are_joined_up_to_a_size():
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(["x" * 10] * n, pa.string())}) for n in (1, 2, 0, 50, 3, 3)]
    joined = list(p._together(iter(batches), 100))
    assert [b.num_rows for b in joined] == [3, 50, 6]
    assert list(p._together(iter([]), 100)) == []


def odd_words():
    for c in map(chr, [*range(1, 0x250), 0x301, 0x331, 0x3A3, 0x1E9E, 0x2019, 0x2028, 0x212A, 0x4E2D, 0xAC00, 0x1F600]):
        yield from (c, f"{c}{c}", f"a{c}", f"{c}a", f"H{c}É", f"É{c}1{c}", f"'{c}", f"{c}'s", f"é'{c}e.")
    yield from "DON'T don''t ''s 'S's we'VE'll'd're'M A\u0300b h\u0331 H\u0331 J\u030c 12ab3, x--y!? STRASSE straße".split()
    yield from ("<|endoftext|>", "<|ENDOFTEXT|>", "é<|startoftext|>a'S", "<|", "|>", "<|endoftext|", "x" * 3000, "Àé" * 500)


def tokenizer_without_memory(monkeypatch, path):
    kept = {}
    monkeypatch.setattr(p, "worker_memory", lambda name: kept.setdefault(name, {}))
    return p.WordTokenizer(path)


def test_words_by_pieces_against_the_tokenizer(monkeypatch):
    tokenizer, plain = tokenizer_without_memory(monkeypatch, PATH), Tokenizer.from_file(PATH)
    words = list(odd_words())
    want = [np.array(plain.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes() for w in words]
    assert tokenizer.ids(pa.array(words, pa.string())) == want
    assert tokenizer_without_memory(monkeypatch, PATH).ids(pa.array(words[::-1], pa.string())) == want[::-1]


def test_plain_words_are_not_left_to_the_whole_tokenizer(monkeypatch):
    whole = []
    run = p.WordTokenizer._tokenised
    monkeypatch.setattr(p.WordTokenizer, "_tokenised", lambda self, words: (whole.extend(words), run(self, words))[1])
    tokenizer = tokenizer_without_memory(monkeypatch, PATH)
    tokenizer.ids(pa.array(["It's plain, \"Été\" (1999)!", "ẽ plain h\u0331 <|endoftext|> x\u00a0y", "it's Ünlü"], pa.string()))
    assert sorted(whole) == sorted(["ẽ", "h\u0331", "<|endoftext|>", "x\u00a0y"])


def test_other_rules_leave_all_words_to_the_tokenizer(monkeypatch, tmp_path):
    words = ["DON'T", "l'été", "a-b", "12", "<|endoftext|>", "Plain", "<end>x"]
    for k, change in enumerate(("normalizer", "pre_tokenizer", "added")):
        other = Tokenizer.from_file(PATH)
        if change == "normalizer":
            other.normalizer = normalizers.NFC()
        elif change == "pre_tokenizer":
            other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
        else:
            other.add_special_tokens(["<end>"])
        other.save(str(tmp_path / f"{k}.json"))
        want = [np.array(other.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes() for w in words]
        assert tokenizer_without_memory(monkeypatch, str(tmp_path / f"{k}.json")).ids(pa.array(words, pa.string())) == want
