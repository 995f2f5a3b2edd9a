import random
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F

from ledgerpulse.llm import wordpiece as w
from ledgerpulse.llm.queries import QUERIES, table

PATH = public_tokenizers.path("piece_bpe_32k.model")


def greedy(word, vocabulary, longest):
    """Pieces of the greedy longest match, tried from the longest; None if it gets stuck."""
    word, at, n = w.MARK + word, 0, 0
    while at < len(word):
        for size in range(min(longest, len(word) - at), 0, -1):
            piece = word[at : at + size]
            if piece in vocabulary and piece.startswith(w.MARK) == (at == 0):
                break
        else:
            return None
        at, n = at + size, n + 1
    return n


def brute(text, vocabulary, longest):
    counts = [greedy(x, vocabulary, longest) for x in (text or "").split()]
    return len(counts), sum(1 if c is None else c for c in counts), sum(c is None for c in counts)


def test_small_vocabularies():
    rng = random.Random(4)
    for _ in range(150):
        letters = "ab" if rng.random() < 0.5 else "abc"
        vocabulary = {rng.choice([w.MARK, ""]) + "".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(2, 14))}
        vocabulary |= {w.MARK} if rng.random() < 0.5 else set()
        automaton = w.Automaton(sorted(vocabulary))
        for _ in range(60):
            word = "".join(rng.choice(letters + "d" * (rng.random() < 0.05)) for _ in range(rng.randrange(1, 14)))
            assert automaton.count(word) == greedy(word, vocabulary, 6), (word, vocabulary)


def test_long_words_are_read_once():
    pieces = w.pieces_of(PATH)
    automaton = w.Automaton(pieces)
    assert automaton.count("a" * 300_000) == greedy("a" * 300_000, set(pieces), 20)
    for word in ("", "hello", "antidisestablishmentarianism", "ß" * 50, "x\U0001f600y", "▁", "12,345.67"):
        assert automaton.count(word) == greedy(word, set(pieces), max(map(len, pieces)))


def test_very_long_texts(spark, documents):
    rng = random.Random(6)
    pieces = w.pieces_of(PATH)
    found = set(pieces)
    texts = [" ".join(rng.choices(["hello", "Übergröße", "12,345", "x" * 40, "naïve"], k=300_000)), "a" * 2_000_000]
    rows = w.count_tokens(documents(list(enumerate(texts))), pieces).collect()
    want = {0: sum((greedy(x, found, 20) or 1) * n for x, n in Counter(texts[0].split()).items()), 1: greedy(texts[1], found, 20) or 1}
    assert {r.doc_id: r.n_tokens for r in rows} == want and {r.n_words for r in rows} == {300_000, 1}


def test_untidy_rows(spark, documents):
    docs = documents([(1, "the cat"), (1, "the cat"), (None, "a"), (2, None), (3, " \n "), (4, "\U0001f9ff\U0001f9ff ok")]).withColumn("n_words", F.lit("x"))
    counted = w.count_tokens(docs, ["▁the", "▁", "c", "at", "▁a", "▁ok"])
    assert sorted((str(r.doc_id), r.n_words, r.n_tokens, r.n_unknown) for r in counted.collect()) == [
        ("1", 2, 4, 0), ("1", 2, 4, 0), ("2", 0, 0, 0), ("3", 0, 0, 0), ("4", 2, 2, 1), ("None", 1, 1, 0),
    ]
    assert set(counted.columns) == set(docs.columns) | {"n_tokens", "n_unknown"}
    assert w.count_tokens(docs.limit(0), ["▁a"]).count() == 0


def test_query_against_brute_force(spark, data):
    pieces = set(w.pieces_of(PATH))
    longest = max(map(len, pieces))
    want = {r.doc_id: brute(r.text, pieces, longest) for r in table(spark, data, "documents").collect()}
    assert {r[0]: tuple(r[1:]) for r in QUERIES["op2_token_counts"](spark, data).collect()} == want
