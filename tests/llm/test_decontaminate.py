import hashlib
import random
import re

from pyspark.sql import functions as F

from ledgerpulse.llm import decontaminate as d
from ledgerpulse.llm.queries import QUERIES, table

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    own, hit, found = words(text), set(), set()
    for item, item_text in items:
        theirs = words(item_text)
        size = min(13, len(theirs))
        windows = {tuple(theirs[i : i + size]) for i in range(len(theirs) - size + 1)} if size else set()
        for i in range(len(own) - size + 1 if size else 0):
            if tuple(own[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found.add(item)
    ids = ",".join(sorted(str(i) for i in found if i is not None))
    n_items = len([i for i in found if i is not None])
    return len(own), len(hit), n_items, hashlib.sha256(ids.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(own)


def _rows(df):
    return {r[0]: tuple(r[1:]) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()}


def test_against_brute_force(spark, documents):
    rng = random.Random(3)
    vocabulary = ["Alpha", "béta", "c3", "D", "ê", "zeta"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ".", ",\n"]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 13, 14, 30, 40, 0])] + [(10, "Unseen word"), (11, None), (2, "Alpha béta c3"), (None, "zeta zeta")]
    long = text(60)
    pairs = [(i, text(n)) for i, n in enumerate([0, 1, 5, 13, 60, 400])] + [(6, None), (7, f"{items[4][1]} {long}"), (8, items[5][1]), (9, "  ,.;")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    want = {i: brute(t, items) for i, t in pairs}
    docs = documents(pairs + pairs[:2]).withColumn("hits", F.lit(1)).withColumn("decontamination", F.lit("x"))
    assert _rows(d.contamination(docs, benchmark)) == want
    assert _rows(d.contamination(docs, benchmark, chunk_bytes=100)) == want  # several passes
    assert d.contamination(docs, benchmark).count() == len(pairs) + 2


def test_empty_tables(spark, documents):
    benchmark = spark.createDataFrame([(1, "one two")], "item_id bigint, text string")
    assert d.contamination(documents([]), benchmark).count() == 0
    found = d.contamination(documents([(1, "one two")]), benchmark.limit(0)).first()
    assert (found.n_words, found.n_hit, found.contaminated) == (2, 0, False)


def test_removal(spark, documents):
    item = "a b c d e f g h i j k l m n"
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    clean = "x " * 300
    docs = documents([(1, f"See: {item.upper()}! {clean}"), (2, item), (3, clean), (4, None)])
    assert {r.doc_id for r in d.drop_contaminated(docs, benchmark).collect()} == {1, 3, 4}
    assert d.drop_contaminated(docs, benchmark).columns == docs.columns
    cut = {r.doc_id: r.text for r in d.remove_spans(docs, benchmark).collect()}
    assert cut == {1: f"See: ! {clean}", 2: "", 3: clean, 4: None}


def test_query_against_brute_force(spark, data):
    items = [tuple(r) for r in table(spark, data, "benchmark").collect()]
    want = {r.doc_id: brute(r.text, items) for r in table(spark, data, "documents").collect()}
    assert _rows(QUERIES["op7_decontamination"](spark, data)) == want
    assert any(v[4] for v in want.values())


def test_a_large_benchmark_is_indexed_once():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(20_000)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage = text(40)  # in a third of all items
    items = [(str(i), text(rng.randint(1, 400)) + (f" {passage} " if i % 3 == 0 else " ") + text(20)) for i in range(10_000)]
    assert sum(len(t) for _, t in items) > 12_000_000
    arrays = d.window_arrays(items)
    held = sum(a.nbytes for known in arrays["windows"].values() for a in known.values() if hasattr(a, "nbytes"))
    assert held + arrays["flat"].nbytes + arrays["codes"].nbytes + len(arrays["words"]) < 100_000_000
    index = d.WindowIndex(arrays)
    assert arrays["numbers"] is d.WindowIndex(arrays).arrays["numbers"]  # the next task of a worker finds it built
    assert sum(len(known["bitmap"]) for known in arrays["windows"].values()) < 130_000_000
    hits, found = index.scan(d.words(f"{text(50)} unseen {passage} unseen {text(30)}"))
    assert hits == [(51, 91)] and found == {str(i) for i in range(0, 10_000, 3)}
    assert index.scan(d.words(text(200_000)))[0] == []
    assert index.scan(d.words(items[77][1]))[1] >= {"77"}


def test_items_of_every_length_and_hot_windows():
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choices("ab", k=n))
    items = [(str(i), text(rng.randint(0, 30))) for i in range(60)] + [("x", "b " * 50), ("x", "a " * 20)]
    index = d.WindowIndex(d.window_arrays(items))
    for n in [0, 1, 2, 12, 13, 14, 200] * 5:
        own = text(n)
        hits, found = index.scan(d.words(own))
        ids = ",".join(sorted(found))
        want = brute(own, items)
        assert sum(b - a for a, b in hits) == want[1] and hashlib.sha256(ids.encode()).hexdigest() == want[3]
    assert d.WindowIndex(d.window_arrays([])).scan([b"a"]) == ([], set())
    long = " ".join(rng.choices("abcde", k=1_000_000))
    assert sum(b - a for a, b in index.scan(d.words(long))[0]) > 0


def test_unlike_windows_share_no_hash(monkeypatch):
    """Codes under which unlike windows share a hash are drawn anew."""
    real, seeds = d.np.random.default_rng, []

    class Bad:
        def integers(self, low, high, n, dtype):
            return d.np.ones(n, dtype=dtype)

    def rng(seed):
        seeds.append(seed)
        return real(seed) if seed else Bad()

    monkeypatch.setattr(d.np.random, "default_rng", rng)
    index = d.WindowIndex(d.window_arrays([("1", "one"), ("2", "two")]))
    assert seeds == [0, 1] and index.scan([b"two", b"three"]) == ([(0, 1)], {"2"})
