import hashlib
import re
import struct

from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ledgerpulse.llm import order_minhash as o
from ledgerpulse.llm.queries import QUERIES, table

M64 = (1 << 64) - 1
HASHES = (1 << 33) - 1  # a value holds 31 bits of the place beside it


def chained(values):
    """XXH64 of several values, the hash of one being the seed of the next, from 42 on."""
    h = 42
    for v in values:
        if v is not None:
            h = xxh64_intdigest(v, h)
    return h


def brute_print(text, kmer=3, bins=64, size=2):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text or "") if w]
    seen, rows = {}, []
    for i in range(max(len(words) - kmer + 1, min(1, len(words)))):
        h = chained([w.encode() for w in words[i : i + kmer]]) & HASHES
        occurrence = seen[h] = seen.get(h, -1) + 1
        rows.append((chained([struct.pack("<q", h), struct.pack("<i", occurrence)]) & HASHES, i))
    out = []
    for b in range(bins):
        least = sorted(r for r in rows if r[0] >> 27 == b)[:size]
        digits = chained([struct.pack("<q", v) for v, _ in sorted(least, key=lambda r: r[1])]) & 0xFFFF
        out.append(f"{digits:04x}" if least else "----")
    return "".join(out)


def brute_like(a, b):
    pairs = [(a[i : i + 4], b[i : i + 4]) for i in range(0, 256, 4)]
    either = sum(p != ("----", "----") for p in pairs)
    both = sum(x == y != "----" for x, y in pairs)
    j = (both / max(1, either)) ** 0.5
    return 1.0 if a == b else 2 * j / (1 + j)


def brute(docs):
    order = sorted(docs, reverse=True)
    out = {}
    for k, (i, text) in enumerate(order):
        text, follower = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + follower[:half]
        a, b, c = brute_print(text), brute_print(edited), brute_print(follower)
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(brute_like(a, b), 9), round(brute_like(a, c), 9))
    return out


def result(df):
    return {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()}


def test_query_against_brute_force(spark, data):
    docs = [(r.doc_id, r.text) for r in table(spark, data, "documents").collect()]
    df = QUERIES["op4_order_minhash"](spark, data)
    assert result(df) == brute(docs)
    assert "Python" not in df._jdf.queryExecution().toString()


def test_odd_texts_and_sparse_ids(spark, documents):
    long = " ".join(f"w{i % 7} x{i % 11}" for i in range(9000))
    docs = [(10**15, "a b c d e f"), (-5, None), (3, ""), (4, "one"), (7, " \n two  words\t"), (8, "é\U0001f600" * 9), (900, long), (901, "same " * 50)]
    assert result(o.edited_fingerprints(documents(docs))) == brute(docs)
    assert result(o.edited_fingerprints(documents(docs[:1]))) == brute(docs[:1])
    assert o.edited_fingerprints(documents([])).count() == 0


def test_neighbours_across_ranges(spark, documents):
    docs = documents([(i * i, "x") for i in range(500)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = o.following(docs).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ids = sorted(r.doc_id for r in rows)
    assert {r.doc_id: r.next_id for r in rows} == {a: b for a, b in zip(ids, [ids[-1], *ids[:-1]])}
    assert {r.doc_id: r.prev_id for r in rows} == {a: b for a, b in zip(ids, [*ids[1:], ids[0]])}


def test_repeated_and_missing_ids(spark, documents):
    docs = documents([(1, "a b c d"), (1, "a b c d"), (2, "e f g h"), (2, "i j k l"), (None, "m n o p")]).withColumn("part", F.lit("x")).withColumn("rows", F.lit(1))
    rows = o.edited_fingerprints(docs).collect()
    assert len(rows) == 5
    ones = {tuple(r) for r in rows if r.doc_id == 1}
    assert len(ones) == 1  # one text stands for id 2
    assert next(r for r in rows if r.doc_id is None).edited_sha256 == hashlib.sha256(b"m n ").hexdigest()


def test_order_matters_and_likeness_follows_edits(spark, documents):
    words = [f"w{i}" for i in range(4000)]
    swapped = words[2000:] + words[:2000]
    tenth = [w if i % 100 else "new" for i, w in enumerate(words)]
    texts = [(1, " ".join(words)), (2, " ".join(swapped)), (3, " ".join(tenth)), (4, " ".join(f"v{i}" for i in range(4000)))]
    prints = documents(texts).select("doc_id", o.fingerprint(F.col("text")).alias("p"))
    first = prints.where("doc_id = 1").select(F.col("p").alias("q"))
    near = {r.doc_id: r.near for r in prints.crossJoin(first).select("doc_id", o.likeness(F.col("p"), F.col("q")).alias("near")).collect()}
    assert near[1] == 1 and near[4] < 0.2 and near[3] > 0.9
    assert near[2] < 0.95 < near[3] + 0.05


def test_places_of_the_longest_array():
    assert o._PLACES == 2**31 - 1  # no array is longer, so that no text loses its order
