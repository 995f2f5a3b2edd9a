import hashlib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from ledgerpulse.llm import secret_scan as s
from ledgerpulse.llm.queries import QUERIES, table

RUN = re.compile("[A-Za-z0-9+/_-][A-Za-z0-9+/_.-]{10,}[A-Za-z0-9+/_-]={0,2}")
CREDENTIAL = re.compile("(?i)token|secret|passw|pwd|passphrase|api_?-?key|access_?-?key|private_?-?key|auth|credential|bearer")
ASSIGNS = re.compile(f"(?i)({CREDENTIAL.pattern[4:]})[A-Za-z0-9_-]{{0,40}}[\"'`]?\\]?(:=|=>|[=:])")


def brute(docs):
    """(doc_id, place, nth, value) of every candidate."""
    out = []
    for i, text in docs:
        words = re.split(r"[ \t\n\x0b\f\r]+", text or "")
        for place, word in enumerate(words):
            before, earlier = ([""] * 2 + words)[place : place + 2][::-1]
            follows = re.search("([=:]|=>)$", before) and CREDENTIAL.search(before + " " + earlier)
            mark = None if follows else ASSIGNS.search(word)
            head, rest = ("", word) if follows else (word[: mark.start()], word[mark.end() :]) if mark else (word, "")
            values = [v for v in RUN.findall(head) if re.search("[0-9]", v) or len(v) >= 20]
            quoted = re.match("([\"'`])(.+)\\1", rest)
            rest = quoted[2] if quoted else re.sub("[\"'`,;)>}\\]]+$", "", re.sub("^[\"'`(<{\\[]+", "", rest))
            values += [rest] if re.search("[^\"'`=:>]", rest) else []
            out += [(i, place, k, v) for k, v in enumerate(values)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    """Documents with real and stand-in secrets, digests, numbers and paths."""
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    docs, labels = [], []
    for i in range(240):
        kind = rng.randrange(5)
        value = [text(40), f"ghp_{text(36)}", "example" + text(20), f"{rng.getrandbits(160):040x}", "some_long_identifier_of_words_" + str(rng.randrange(99))][kind]
        before = ["password =", "key:", "password =", "commit", "call"][kind]
        docs.append((i, f"the words of a plain text and {before} \"{value}\" and more words"))
        labels.append((i, 9 if kind in (0, 2) else 8, 0, int(kind < 2)))
    return docs, labels


def test_candidates_against_brute_force(spark, documents, corpus):
    odd = [(900, None), (901, ""), (902, "x" * 5000), (903, "é9" * 20 + " a,bb=abc123def456ghi,c=" + "Z9" * 30 + "=="), (None, "tail 0123456789abc"), (904, "   12345678901234  \n q")]
    docs = corpus[0][:20] + odd + odd[-1:]
    frame = documents(docs).withColumns({"place": F.lit(1), "value": F.lit("v"), "word": F.lit("w")})
    found = s.find_candidates(frame)
    assert sorted(((r.doc_id, r.place, r.nth, r.value) for r in found.collect()), key=str) == brute(docs)
    named = {r.value: (r.before, r.earlier, r.after) for r in found.where("doc_id = 903").collect()}
    assert named["abc123def456ghi"][0] == "bb"


def test_values_of_credentials(spark, documents):
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
    docs = [
        (1, 'password = "Tr0ub4dor&3" and so on'),
        (2, "pwd: p@ss!w0rd#24, then"),
        (3, f"Authorization: Bearer: {jwt}\nx {jwt}"),
        (4, "the DB_PASSWORD='a' export API_KEY=x.y%z$w:v; secret: []"),
        (5, "user=0123456789abcdef&password=pä$$&key=abc token ="),
        (6, "the secret of the passwords was told"),
    ]
    rows = s.find_candidates(documents(docs)).collect()
    found = {i: [r.value for r in sorted(rows, key=lambda r: (r.place, r.nth)) if r.doc_id == i] for i, _ in docs}
    assert found == {
        1: ["Tr0ub4dor&3"], 2: ["p@ss!w0rd#24"], 3: ["Bearer:", jwt, jwt], 4: ["a", "x.y%z$w:v"], 5: ["0123456789abcdef", "pä$$&key=abc"], 6: []
    }
    assert sorted(((r.doc_id, r.place, r.nth, r.value) for r in rows), key=str) == brute(docs)


def test_features_against_brute_force(spark, documents, corpus):
    entries = ["the", "word", "words", "ide", "identifier", "some", "long", "son", "ngi"]
    docs = documents([*corpus[0][:60], (901, "pwd: p@ss!w0rd#24 token=wordsomelongidentifier.éWORDSé")])
    frame = s.with_features(s.find_candidates(docs), spark.createDataFrame([(e,) for e in entries], "entry string"))

    def kind(c):
        return next((k for k, pattern in enumerate(("[a-z]", "[A-Z]", "[0-9]")) if re.match(pattern, c)), 3)

    for r in frame.collect():
        v, n = r.value, len(r.value)
        steps = [(kind(a), kind(b)) for a, b in zip(v, v[1:])]
        covered = {k for e in entries for m in re.finditer(f"(?={e})", v.lower()) for k in range(m.start(), m.start() + len(e))}
        assert r.coverage == pytest.approx(len(covered) / n)
        assert [r.lowers, r.uppers, r.digits, r.signs] == pytest.approx([sum(kind(c) == k for c in v) / n for k in range(4)])
        assert r.letter_digit == pytest.approx(sum(a < 2 and b == 2 for a, b in steps) / n)
        assert r.digit_letter == pytest.approx(sum(a == 2 and b < 2 for a, b in steps) / n)
        assert r.same_class == pytest.approx(sum(a == b < 3 for a, b in steps) / n)
        shares = [v.count(c) / n for c in set(v)]
        assert r.entropy == pytest.approx(-sum(p * math.log2(p) for p in shares)) and r.distinct == len(shares) / n


def test_long_value(spark, documents):
    rng = random.Random(5)
    blob = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=1_000_000))
    docs = documents([(1, "data: " + blob), (2, "letters " + "theword" * 60_000)])
    start = time.monotonic()
    frame = s.with_features(s.find_candidates(docs), spark.createDataFrame([("the",), ("word",)], "entry string"))
    rows = {r.doc_id: r for r in frame.select("doc_id", "length", "coverage").collect()}
    assert (rows[1].length, rows[2].length, rows[2].coverage) == (1_000_000, 420_000, 1)
    assert time.monotonic() - start < 120


def test_forest_on_labelled_findings(spark, documents, corpus):
    docs, labels = corpus
    labelled = spark.createDataFrame(labels + labels[:5], "doc_id bigint, place int, nth int, secret int")
    want = {x[:3]: x[3] for x in labels}
    rows = s.scan(documents(docs), labelled, training=F.col("doc_id") % 3 > 0).collect()
    held = [r for r in rows if r.doc_id % 3 == 0]
    assert sum(r.secret == bool(want[r.doc_id, r.place, r.nth]) for r in held) / len(held) > 0.95
    assert all(0 <= r.probability <= 1 for r in rows)


def test_features(spark, documents):
    docs = documents([(1, "token = \"abcABC123456+/\" the words"), (2, "thewordsthewords9 the words the words xyz")])
    entries = spark.createDataFrame([("the",), ("words",), ("dsthe",)], "entry string")
    rows = {r.doc_id: r for r in s.with_features(s.find_candidates(docs), entries).collect()}
    one, two = rows[1], rows[2]
    assert (one.length, one.quoted, one.before) == (14, 1, "=")
    assert (one.lower_upper, one.letter_digit, one.upper_lower) == (1 / 14, 1 / 14, 0)
    assert two.coverage == 16 / 17 and one.coverage == 0
    assert not {"provider", "stand_in", "credential_before", "assigned"} & set(s.NUMBERS)  # what tells the derived labels
    assert one.entropy == pytest.approx(3.807354922) and one.distinct == 1


def test_untidy_tables(spark, documents, corpus):
    docs, labels = corpus
    empty = documents([])
    assert s.scan(empty).count() == 0
    labelled = spark.createDataFrame(labels, "doc_id bigint, place int, nth int, secret int")
    assert {r.probability for r in s.scan(documents(docs[:4]), labelled.limit(0)).collect()} == {0.5}
    one = s.scan(documents([*docs[:4], (None, docs[0][1])]).drop("source"), labelled.withColumn("secret", F.lit(1))).collect()
    assert {r.probability for r in one} == {1.0} and len(one) == 5
    many = s.train(s.with_features(s.find_candidates(documents(docs)), spark.createDataFrame([("the",)], "entry string")), labelled, rows=50)
    assert not isinstance(many, float)


def test_dictionary_counts_all_words(spark, documents):
    docs = documents([(1, "B b a-a cat Cat dog cat4cat the"), (2, None), (3, "dog cow cow owl")])
    assert [r.entry for r in s.dictionary(docs, 3).collect()] == ["cat", "cow", "dog"]


def test_query(spark):
    data = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in table(spark, data, "documents").collect()]
    df = QUERIES["op8_secret_scan"](spark, data)
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
    rows = df.collect()
    digest = lambda v: hashlib.sha256(v.encode()).hexdigest()
    assert sorted((r.doc_id, r.place, r.nth, r.value_sha256) for r in rows) == sorted((i, p, k, digest(v)) for i, p, k, v in brute(docs))
    tokens = {(i, digest(m)) for i, t in docs for m in re.findall(r'(?i)token\S* \S*=\S* "([0-9a-f]{40})"', t or "")}
    found = {(r.doc_id, r.value_sha256) for r in rows if r.secret}
    assert tokens and tokens <= found and len(found) < 1.2 * len(tokens) + 2
