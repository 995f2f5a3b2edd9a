import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerpulse.llm import ranked_search as s
from ledgerpulse.llm.queries import QUERIES, table

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(pairs, items, top=10):
    bags = [(i, Counter(terms(t))) for i, t in pairs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    held = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, bag in bags:
            n, score = sum(bag.values()), 0
            for t in set(terms(text)) & set(bag):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1)))
                score += weight * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * (10 + 90 * n * n_docs // n_terms)))
            if score > 0:
                scores.append((-score, i is None, i))
        for rank, (score, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1):
            out.append((item, rank, i, -score))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"shard": 40}, {"chunk_bytes": 60, "shard": 1}])
def test_against_brute_force(spark, documents, options):
    rng = random.Random(5)
    vocabulary = ["Alpha", "béta", "c3", "D", "ê", "zeta", "Ömega", "x_y"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ".", ",\n", "-"]) for _ in range(n))
    pairs = [(i, text(rng.choice([1, 3, 10, 50]))) for i in range(120)] + [(200, None), (201, ""), (202, " ,.;"), (None, "zeta c3")]
    pairs += [(i + 300, pairs[0][1]) for i in range(15)] + pairs[:3]  # ties, repeated rows
    items = [(1, text(3)), (2, text(8)), (3, None), (4, "nowhere"), (None, "zeta"), (1, "ê ê D"), (2, ""), (5, pairs[0][1]), (5, pairs[0][1])]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as rank", "2 as score")
    docs = documents(pairs).selectExpr("*", "3 as item", "4 as n")
    assert rows(s.rank_documents(docs, benchmark, **options)) == brute(pairs, items)


def test_long_text(spark, documents):
    pairs = [(1, "one two " * 400_000), (2, "two three"), (3, "four")]
    items = spark.createDataFrame([("a", "one three")], "item_id string, text string")
    assert rows(s.rank_documents(documents(pairs), items)) == brute(pairs, [("a", "one three")])


def test_empty_tables(spark, documents):
    items = spark.createDataFrame([(1, "one")], "item_id bigint, text string")
    assert rows(s.rank_documents(documents([]), items)) == []
    assert rows(s.rank_documents(documents([(1, None)]), items)) == []
    assert rows(s.rank_documents(documents([(1, "one two")]), items.limit(0))) == []


def test_reading_stops_early_and_strictly_below():
    n = 100_000
    docs, terms_ = np.tile(np.arange(n), 2), np.repeat([0, 1], n)
    falling = np.arange(n, 0, -1)
    lists = s.ImpactLists(terms_, docs, np.concatenate((falling, falling)))
    found, scores, looked_up = lists.best(np.array([0, 1]), 10)
    assert found.tolist() == list(range(10)) and scores[0] == 2 * n
    assert looked_up == s.FIRST_READ  # one round of reading
    flat = s.ImpactLists(terms_, np.tile(np.arange(n)[::-1], 2), np.ones(2 * n, dtype=np.int64))
    found, _, looked_up = flat.best(np.array([0, 1, 7]), 10)
    assert found.tolist() == list(range(10))  # a tie at the threshold does not stop


def test_best_position_runs_ahead_of_reading():
    """Documents that another list leads to mark the places below those read, and the threshold falls with them."""
    n = 4 * s.FIRST_READ
    first = np.arange(n)
    second = np.concatenate((np.arange(s.FIRST_READ, 2 * s.FIRST_READ), np.arange(s.FIRST_READ), np.arange(2 * s.FIRST_READ, n)))
    impacts = np.concatenate((np.where(first < 2 * s.FIRST_READ, 50, 1), np.where(np.arange(n) < 2 * s.FIRST_READ, 50, 1)))
    # below the 2 * FIRST_READ places that direct access has marked in both lists, impacts are 1; by the places read they are 50
    lists = s.ImpactLists(np.repeat([0, 1], n), np.concatenate((first, second)), impacts)
    found, scores, looked_up = lists.best(np.array([0, 1]), 10)
    assert found.tolist() == list(range(10)) and set(scores.tolist()) == {100}
    assert looked_up >= 2 * s.FIRST_READ


def test_query_against_brute_force(spark, data):
    pairs = [(r.doc_id, r.text) for r in table(spark, data, "documents").collect()]
    items = [tuple(r) for r in table(spark, data, "benchmark").select("item_id", "text").collect()]
    assert rows(QUERIES["op13_ranked_search"](spark, data)) == brute(pairs, items)
