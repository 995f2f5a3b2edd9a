import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerpulse.llm import simhash as s
from ledgerpulse.llm.components import connected_components
from ledgerpulse.llm.queries import QUERIES, table


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints, radius=2):
    """The smallest index reachable of each fingerprint."""
    root = list(range(len(prints)))
    changed = True
    near = [[j for j in range(len(prints)) if (prints[i] ^ prints[j]).bit_count() <= radius] for i in range(len(prints))]
    while changed:
        changed = False
        for i, js in enumerate(near):
            least = min(root[j] for j in js)
            for j in js:
                if root[j] != least:
                    root[j], changed = least, True
    return root


@pytest.mark.parametrize("text", [None, "", " \n", "one", "One two", "a b c", "a B c d e f g a b c d", "é \x0b è\x1cx ü ß Ä Ö z"])
def test_fingerprint(text):
    assert s.simhash(text) == brute_print(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_links(radius):
    rng = random.Random(radius)
    centres = [rng.getrandbits(64) for _ in range(12)]
    values, group = [], []
    for g, size in enumerate([1, 2, 3, 7, 40, 48, 49, 130, 300]):
        mine = set()
        while len(mine) < size:
            v = rng.choice(centres)
            for _ in range(rng.randrange(6)):
                v ^= 1 << rng.randrange(64)
            mine.add(v)
        values += sorted(mine)
        group += [g] * size
    bits, group = np.array(values, dtype=np.uint64), np.array(group)
    found = s.spanning_links(bits, group, radius)
    assert all(group[i] == group[j] and (values[i] ^ values[j]).bit_count() <= radius for i, j in found)
    for g in set(group.tolist()):
        at = np.flatnonzero(group == g)
        root = {i: i for i in at.tolist()}

        def top(i):
            while root[i] != i:
                i = root[i]
            return i

        for i, j in found:
            if group[i] == g:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
        want = brute_classes([values[i] for i in at], radius)
        assert [top(i) for i in at.tolist()] == [int(at[w]) for w in want]


@pytest.mark.parametrize("tile", [16, 2048])
def test_links_of_a_hot_key(spark, tile):
    rng = random.Random(5)
    centre = rng.getrandbits(63)
    values = {centre}
    while len(values) < 200:
        v = centre
        for _ in range(rng.randrange(1, 7)):
            v ^= 1 << rng.randrange(64)
        values.add(v - (v >> 63 << 64))
    values = sorted(values)
    prints = spark.createDataFrame([(v,) for v in values], "fp bigint")
    links = s.near_links(prints, tile=tile)
    roots = {r.node: r.root for r in connected_components(links).collect()}
    want = brute_classes([v & (1 << 64) - 1 for v in values])
    assert {v: roots.get(v, v) for v in values} == {v: values[w] for v, w in zip(values, want)}


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 60)] + [(60, 59), (5, 5)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert found == {**{i: 100 for i in range(100, 141)}, **{i: 1 for i in range(1, 61)}}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_untidy_rows(spark, documents):
    text = "the quick brown fox jumps over the lazy dog " * 5
    docs = documents([(3, text), (2, text), (2, text), (None, text), (7, None), (8, ""), (9, "other words entirely"), (None, "lost text here")])
    docs = docs.withColumns({"fp": F.lit(1), "root": F.lit("r"), "text_key": F.lit("k")})
    rows = s.simhash_components(docs).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in rows) == [(-1, -1), (-1, 2), (2, 2), (2, 2), (3, 2), (7, 7), (8, 7), (9, 9)]
    assert {r.fingerprint for r in rows if r.doc_id in (7, 8)} == {"0" * 16}
    kept = s.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "lost text here"), (2, text), (7, None), (9, "other words entirely")]
    assert s.simhash_components(docs.limit(0)).count() == 0
    assert s.keep_one_of_each(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark, data):
    docs = sorted((r.doc_id, r.text) for r in table(spark, data, "documents").collect())
    prints = [brute_print(t) for _, t in docs]
    root = brute_classes(prints)
    want = {(i, f"{p:016x}", docs[w][0]) for (i, _), p, w in zip(docs, prints, root)}
    assert {tuple(r) for r in QUERIES["op10_simhash"](spark, data).select("doc_id", "fingerprint", "component_id").collect()} == want
    assert len(set(root)) < len(docs)
