import hashlib
import itertools
import random
import re
import zlib

import pytest

from ledgerpulse.llm import conversations as c
from ledgerpulse.llm.queries import QUERIES, table

NOT_BLANK = re.compile("[^\x20\x09-\x0d]")
LEGAL = re.compile("(s?(ua)+)?")


def faults(rows):
    """Rows (turn, role, text) in order to their faults, as the contract tells."""
    seen, out = set(), []
    for _, role, text in rows:
        marks = NOT_BLANK.findall(text)
        if not marks:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if marks[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """By trying the ways over all rows, state by state, with whole edit texts: no pruning, no order of survivors."""
    best = {"": {(0, "", ())}}  # by the initials that matter
    def add(table, initials, way):
        key = initials[-1:]
        table.setdefault(key, set()).add(way)
    def inserts(table):
        out = {k: set(v) for k, v in table.items()}
        for _ in range(3):
            for key in list(out):
                for cost, edits, lines in list(out[key]):
                    if edits.endswith("III"):
                        continue
                    role = "assistant" if key == "u" else "user"
                    out.setdefault(role[0], set()).add((cost + 5, edits + "I", (*lines, f"{role}:")))
            out = {k: {min(v)} | {w for w in v if w[0] <= min(v)[0]} for k, v in out.items()}
        return out
    for (_, role, text), fault in zip(rows, found):
        new = {}
        for key, ways in inserts(best).items():
            for cost, edits, lines in ways:
                new.setdefault(key, set()).add((cost + 2, edits + "D", lines))
                if fault in ("blank", "duplicate"):
                    continue
                extra = 5 * (fault == "truncated")
                legal = {"s": key == "", "u": key != "u", "a": key == "u"}.get(role[:1], False)
                if legal:
                    new.setdefault(role[0], set()).add((cost + extra, edits + "K", (*lines, f"{role}:{text}")))
                other = "assistant" if key == "u" else "user"
                new.setdefault(other[0], set()).add((cost + 1 + extra, edits + "R", (*lines, f"{other}:{text}")))
        best = {k: {w for w in v if w[0] == min(v)[0]} for k, v in new.items()}
        best = {k: {min(v)} for k, v in best.items()}
    return min(w for k, v in inserts(best).items() if k in ("", "a") for w in v)


def answer(rows):
    """Rows (turn, role, text) of one conversation in order."""
    found = faults(rows)
    cost, audit, lines = cheapest(rows, found)
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *(found.count(x) for x in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()))


def damaged(table_rows):
    out = {}
    for conv, turn, role, text in table_rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        fault, rows = zlib.crc32(key.encode()) % 20, out.setdefault(conv, [])
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        rows += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return {conv: in_order(rows) for conv, rows in out.items()}


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.select("conv_id", *c.RESULTS, "audit", "repaired_sha256").collect()}


def test_brute_force_against_all_edit_sequences():
    """The brute force itself against every sequence of edits with up to two inserts in a row."""
    rng = random.Random(1)
    for _ in range(60):
        rows = [(i, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["a.", "b", "c!", ""])) for i in range(rng.randrange(4))]
        found, ways = faults(rows), []
        gaps = ["", "I", "II"]
        for inserted in itertools.product(gaps, repeat=len(rows) + 1):
            for edits in itertools.product("KRD", repeat=len(rows)):
                for chosen in itertools.product("ua", repeat=edits.count("R") + sum(map(len, inserted))):
                    cost, roles, picks, bad = 0, "", list(chosen), False
                    audit = inserted[0] + "".join(e + i for e, i in zip(edits, inserted[1:]))
                    at = 0
                    for e in audit:
                        if e == "I":
                            cost, roles = cost + 5, roles + picks.pop(0)
                            continue
                        (_, role, _), fault = rows[at], found[at]
                        at += 1
                        cost += {"K": 0, "R": 1, "D": 2}[e] + 5 * (fault == "truncated" and e != "D")
                        bad |= fault in ("blank", "duplicate") and e != "D"
                        roles += {"K": role[0], "R": picks.pop(0) if e == "R" else "", "D": ""}[e]
                    if not bad and LEGAL.fullmatch(roles):
                        ways.append((cost, audit))
        assert cheapest(rows, found)[:2] == min(ways)


@pytest.mark.parametrize("held", [c.HELD, 0, 150])
def test_against_brute_force(spark, held):
    rng = random.Random(7)
    roles = ["system", "user", "assistant", "assistant", "user", "tool", "", "User", None]
    texts = ["Yes.", "No!", "and so", " ", "", "Well? ", None, "ok.\n", "é", "a. \x85"]
    rows = []
    for conv in [*range(60), None]:
        for turn in rng.sample(range(40), rng.randrange(1, 25)):
            rows += [(conv, rng.choice([turn, turn, turn, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}.")] * rng.choice([1, 1, 1, 2])
    rows += [(1000, t, rng.choice(["user", "assistant"]), rng.choice(["x", "y."]) + str(rng.randrange(200)) + rng.choice([".", ""])) for t in range(3000)]
    rows += [(1001, t, "assistant", f"{t}.") for t in range(2000)]  # survivors that do not meet
    rows += [(1002, 1, "user", "one.")] * 500 + [(1003, t, "user", "same.") for t in range(700)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as kind", "2 as copies_", "3 as uid")
    want = {conv: answer(found) for conv, found in damaged(rows).items()}
    result = got(c.repair_conversations(c.damage(df), held))
    assert set(result) == set(want)
    for conv in want:
        assert result[conv] == want[conv], conv


def test_conversation_over_several_tasks(spark):
    """A conversation with nearly all rows is cut into segments and put together again."""
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), f"{t % 900}" + rng.choice([".", ".", ""])) for t in range(6000)] + [(2, 0, "user", "a.")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        result = got(c.repair_conversations(c.damage(df)))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert result == {conv: answer(found) for conv, found in damaged(rows).items()}


def test_edits_leave_when_survivors_meet():
    search, gone = c.Survivors(), 0
    for n in range(20_000):
        gone += len(search.step("ua"[n % 2]))
        assert search.held <= 8
    assert gone > 19_990
    search = c.Survivors()
    for _ in range(1000):
        search.step("d")
    assert search.held <= 8


def test_nothing_left_and_empty_table(spark):
    schema = "conv_id string, turn bigint, role string, text string"
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(str(dropped), 0, "user", "Hello.")], schema)
    nothing = hashlib.sha256(b"").hexdigest()
    assert got(c.repair_conversations(c.damage(df))) == {str(dropped): (0, 0, 0, 0, 0, 0, "", nothing)}
    assert got(c.repair_conversations(c.damage(df.limit(0)))) == {}
    plain = spark.createDataFrame([("a", 0, "user", "x" * 3_000_000 + "."), ("a", 1, "assistant", "y.")], schema)
    assert got(c.repair_conversations(plain))["a"][5:7] == (0, "KK")


def test_query_against_brute_force(spark, data):
    rows = [tuple(r) for r in table(spark, data, "conversations").select("conv_id", "turn", "role", "text").collect()]
    want = {conv: answer(found) for conv, found in damaged(rows).items()}
    assert got(QUERIES["op11_conversation_repair"](spark, data)) == want
