"""Repair of the turn structure of conversations by a survivor-coalescence Viterbi search.

The rows of a conversation pass through a trellis of four states: nothing kept yet, or a system, user or assistant row kept
last. A state's survivor is its cheapest way so far, equal costs by the ASCII order of their edits. Survivors are the leaves
of a tree of backpointers with reference counts: a survivor that is given up frees its nodes up to the next fork, and
as soon as all survivors share an ancestor the edits up to it are final and leave. What is held are the rows after that.
The survivors are kept in the order of their complete unresolved edits, so a tie compares these whole, in constant time:
the edits of two survivors end in the same row and differ, so neither begins with the other.

Rows are dealt out by ranges of conversation and turn, not by conversation, so a conversation with very many rows lies in
several tasks. Short conversations inside a task are repaired there. What may go on in another task, or is long, becomes
a segment: costs and order of the ways from each state to each state. A small search over its segments tells in which
state each is entered and left, and the segments are then repaired side by side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerpulse.session import stage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Characters of a conversation that a task holds before it makes a segment of it, and of a block of repaired text.
HELD = 1_000_000

# White space as the contract has it.
BLANKS = " \t\n\x0b\f\r"
NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)
FORCED = "d"
_NONE = 1 << 60

#: Inserts before a row, by the state before them: how many, and the state after.
_BEFORE = {NOTHING: (NOTHING, USER, ASSISTANT), SYSTEM: (SYSTEM, USER, ASSISTANT), USER: (USER, ASSISTANT), ASSISTANT: (ASSISTANT, USER)}
#: Inserts that complete a conversation left in a state.
_CLOSING = {NOTHING: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
#: By how much the rest of a way from the first state can cost more than the rest of one from the second.
_LEAD = {
    (NOTHING, SYSTEM): 0, (NOTHING, USER): 5, (NOTHING, ASSISTANT): 0,
    (SYSTEM, NOTHING): 12, (SYSTEM, USER): 5, (SYSTEM, ASSISTANT): 10,
    (USER, NOTHING): 7, (USER, SYSTEM): 5, (USER, ASSISTANT): 5,
    (ASSISTANT, NOTHING): 2, (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): 5,
}


def after_role(state: int) -> int:
    """The state after a row whose role was chosen: a user's, or an assistant's after a user's."""
    return ASSISTANT if state == USER else USER


def after_keep(state: int, initial: str) -> int | None:
    """The state after a row that was kept, None where its role may not stand."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial == "u":
        return None if state == USER else USER
    return ASSISTANT if initial == "a" and state == USER else None


def _moves(letter: str) -> list[list[tuple[int, str, int]]]:
    """From each state: cost, edits and new state of the ways over a row; of equal ones the cheapest, ASCII-least."""
    table = []
    for state in STATES:
        best: dict[int, tuple[int, str]] = {}
        for inserts, at in enumerate(_BEFORE[state]):
            cost, edits = INSERT * inserts, "I" * inserts
            ways = [(cost + DELETE, edits + "D", at)]
            if letter != FORCED:
                extra = TRUNCATED if letter.isupper() else 0
                ways.append((cost + REROLE + extra, edits + "R", after_role(at)))
                if (kept := after_keep(at, letter.lower())) is not None:
                    ways.append((cost + KEEP + extra, edits + "K", kept))
            for way, text, to in ways:
                best[to] = min(best.get(to, (_NONE, "")), (way, text))
        table.append([(cost, text, to) for to, (cost, text) in best.items()])
    return table


#: A row is a letter: its role's initial or x, upper case if truncated, or d if it has to go.
MOVES = {letter: _moves(letter) for letter in "suaxSUAXd"}


class _Node:
    """A row's edits on a survivor's way; ``after`` are the nodes that point back to it."""

    __slots__ = ("after", "before", "edits")

    def __init__(self, before: _Node | None, edits: str):
        self.before, self.edits, self.after = before, edits, []
        if before is not None:
            before.after.append(self)


class Survivors:
    """The search from ``entry`` on; ``step`` gives the edits, a text for each row, that have become final."""

    def __init__(self, entry: int = NOTHING):
        self.root = _Node(None, "")
        self.live = {entry: (0, 0, self.root)}  # cost, place in the order of the edits, leaf
        self.held = 0

    def step(self, letter: str) -> list[str]:
        moves, best = MOVES[letter], {}
        for state, (cost, place, leaf) in self.live.items():
            for more, edits, to in moves[state]:
                way = (cost + more, place, edits, leaf)
                if to not in best or way[:3] < best[to][:3]:
                    best[to] = way
        costs = {to: way[0] for to, way in best.items()}
        kept = [to for to in best if not any(costs[y] + _LEAD[y, to] < costs[to] for y in costs if y != to)]
        kept.sort(key=lambda to: best[to][1:3])
        old = [leaf for _, _, leaf in self.live.values()]
        self.live = {to: (costs[to], place, _Node(best[to][3], best[to][2])) for place, to in enumerate(kept)}
        for node in old:
            while not node.after and node is not self.root:
                before, node.before = node.before, None
                before.after.remove(node)
                node = before
        self.held += 1
        final = []
        leaves = {id(leaf) for _, _, leaf in self.live.values()}
        while len(self.root.after) == 1 and id(self.root) not in leaves:
            self.root = self.root.after[0]
            self.root.before = None
            final.append(self.root.edits)
        self.held -= len(final)
        return final

    def ways(self) -> dict[int, tuple[int, int]]:
        return {state: (cost, place) for state, (cost, place, _) in self.live.items()}

    def rest(self, state: int) -> list[str]:
        """The edits that are not final yet on the way to ``state``."""
        out, node = [], self.live[state][2]
        while node is not self.root:
            out.append(node.edits)
            node = node.before
        return out[::-1]


def best_end(ways: dict[int, tuple[int, int]]) -> tuple[int, int, int]:
    """Cost, closing inserts and last state of the cheapest whole way."""
    cost, _, state = min((cost + INSERT * _CLOSING[s], place, s) for s, (cost, place) in ways.items())
    return cost, _CLOSING[state], state


class Ways:
    """Costs and order of the best ways from every state to every state, without their edits."""

    def __init__(self):
        self.table = {entry: {entry: (0, 0)} for entry in STATES}

    def step(self, letter: str) -> None:
        moves = MOVES[letter]
        for entry, ways in self.table.items():
            best: dict[int, tuple[int, int, str]] = {}
            for state, (cost, place) in ways.items():
                for more, edits, to in moves[state]:
                    best[to] = min(best.get(to, (_NONE, 0, "")), (cost + more, place, edits))
            order = sorted(best, key=lambda to: best[to][1:])
            self.table[entry] = {to: (best[to][0], place) for place, to in enumerate(order)}

    def numbers(self) -> list[int]:
        """Cost and place for each entry and exit, cost -1 where there is no way."""
        return [n for e in STATES for x in STATES for n in self.table[e].get(x, (-1, 0))]


def through(before: dict[int, tuple[int, int]], numbers: list[int]) -> dict[int, tuple[int, int, int]]:
    """Cost, place and entry of the best way to each state after a segment."""
    best: dict[int, tuple[int, int, int, int]] = {}
    for entry, (cost, place) in before.items():
        for to in STATES:
            more, inner = numbers[2 * (4 * entry + to) :][:2]
            if more >= 0:
                best[to] = min(best.get(to, (_NONE, 0, 0, 0)), (cost + more, place, inner, entry))
    order = sorted(best, key=lambda to: best[to][1:3])
    return {to: (best[to][0], place, best[to][3]) for place, to in enumerate(order)}


class Repair:
    """Applies edits to rows in order: the audit, and the repaired rows as ``role:text`` lines."""

    def __init__(self, state: int = NOTHING):
        self.state, self.audit, self.lines, self.size = state, [], [], 0

    def _add(self, role: str, text: str) -> None:
        self.lines.append(f"{role}:{text}")
        self.size += len(text)

    def insert(self) -> None:
        self.state = after_role(self.state)
        self._add("assistant" if self.state == ASSISTANT else "user", "")
        self.audit.append("I")

    def apply(self, edits: str, role: str, text: str) -> None:
        for edit in edits:
            if edit == "I":
                self.insert()
                continue
            self.audit.append(edit)
            if edit == "K":
                self.state = after_keep(self.state, role[:1])
                self._add(role, text)
            elif edit == "R":
                self.state = after_role(self.state)
                self._add("assistant" if self.state == ASSISTANT else "user", text)

    def block(self) -> tuple[str, str | None]:
        """Audit and lines since the last block, which are forgotten."""
        out = "".join(self.audit), "\n".join(self.lines) if self.lines else None
        self.audit, self.lines, self.size = [], [], 0
        return out


class _Counts:
    """What is counted of rows in order, so that neighbouring stretches can be added."""

    def __init__(self):
        self.least = self.most = self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def row(self, turn: int | None, initial: str) -> None:
        if turn is not None and turn != self.most:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = turn
        if self.first is None:
            self.first = initial
        elif self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial

    def pack(self) -> list[int | None]:
        ends = [None if x is None else ord(x) if x else 0 for x in (self.first, self.last)]
        return [self.least, self.most, self.turns, self.blank, self.duplicate, self.truncated, self.illegal, *ends]

    def add(self, packed: list[int | None]) -> None:
        least, most, turns, blank, duplicate, truncated, illegal, first, last = packed
        if turns:
            self.turns += turns - (self.most == least)
            self.least = least if self.least is None else self.least
            self.most = most
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        self.illegal += illegal
        if first is not None:
            first, last = (chr(x) if x else "" for x in (first, last))
            self.illegal += self.last is not None and self.last + first not in ("su", "ua", "au")
            self.first = first if self.first is None else self.first
            self.last = last

    def result(self, cost: int) -> list[int]:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost]


_SCANNED = "kind string, conv string, segment bigint, nr bigint, letter string, role string, text string, numbers array<bigint>, audit string, sha string"
_BLOCKS = "conversation bigint, segment bigint, nr bigint, audit string, text string"
_DECIDED = "conv string, segment bigint, conversation bigint, entry int, leave int, closing int, numbers array<bigint>"
RESULTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Run:
    """The rows of one conversation in one task, in order."""

    def __init__(self, conv: str | None, is_open: bool):
        self.conv, self.counts, self.rows, self.size = conv, _Counts(), [], 0
        self.is_open, self.ways, self.nr = is_open, Ways(), 0

    def add(self, turn, role, text, blank, truncated, first, copies) -> None:
        for copy in range(copies):
            duplicate = not blank and (copy > 0 or not first)
            cut = not blank and not duplicate and truncated
            self.counts.row(turn, role[:1])
            self.counts.blank += blank
            self.counts.duplicate += duplicate
            self.counts.truncated += cut
            initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
            letter = FORCED if blank or duplicate else initial.upper() if cut else initial
            # a row that has to go needs no text
            self.rows.append((letter, role, "" if letter == FORCED else text))
            self.size += len(self.rows[-1][2]) + 64

    def flush(self, segment: int) -> list[tuple]:
        """The held rows of an open stretch."""
        out = []
        for letter, role, text in self.rows:
            self.ways.step(letter)
            out.append(("row", None, segment, self.nr, letter, role, text, None, None, None))
            self.nr += 1
        self.rows, self.size = [], 0
        return out

    def close(self, segment: int) -> list[tuple]:
        if self.is_open:
            out = self.flush(segment)
            return [*out, ("segment", self.conv, segment, None, None, None, None, self.counts.pack() + self.ways.numbers(), None, None)]
        search, repair, at = Survivors(), Repair(), 0
        final: list[str] = []
        for letter, _, _ in self.rows:
            final += search.step(letter)
        cost, closing, state = best_end(search.ways())
        for edits in final + search.rest(state):
            repair.apply(edits, *self.rows[at][1:])
            at += 1
        for _ in range(closing):
            repair.insert()
        audit, text = repair.block()
        sha = hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).hexdigest()
        return [("whole", self.conv, None, None, None, None, None, self.counts.result(cost), audit, sha)]


def _batches(rows: Iterator[list[tuple]], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    size = 0
    for part in rows:
        held += part
        size += sum(64 + len(x) for row in part for x in row if isinstance(x, str))
        if size > HELD:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _arrow(schema: str) -> tuple[list[str], list[pa.DataType]]:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64())}
    columns = [c.split(" ") for c in schema.split(", ")]
    return [c for c, _ in columns], [kinds[t] for _, t in columns]


def _scan(held: int):
    """Rows in order to repaired conversations, and to segments with their rows."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        part, run, marked, nr = TaskContext.get().partitionId(), None, False, 0
        for batch in batches:
            names = ("conv", "kind", "turn", "role", "text", "alive", "blank", "truncated", "copies")
            for conv, kind, turn, role, text, alive, blank, truncated, copies in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if run is None or conv != run.conv:
                    if run is not None:
                        yield run.close((part << 32) + nr)
                        nr += 1
                    run = _Run(conv, is_open=run is None)
                if kind == 0:
                    marked = True
                    continue
                if alive:
                    run.add(turn, role, text, blank, truncated, marked, copies)
                    if run.is_open or run.size > held:
                        run.is_open = True
                        if run.size > held:
                            yield run.flush((part << 32) + nr)
                marked = False
        if run is not None:
            run.is_open = True
            yield run.close((part << 32) + nr)

    return lambda batches: _batches(runs(batches), *_arrow(_SCANNED))


def _decide(segments: pd.DataFrame) -> pd.DataFrame:
    """The segments of one conversation, at most one a task, with the states in which they are entered and left."""
    segments = segments.sort_values("segment")
    before, counts, steps = {NOTHING: (0, 0)}, _Counts(), []
    for numbers in segments["numbers"]:
        numbers = [None if pd.isna(n) else int(n) for n in numbers]
        counts.add(numbers[:9])
        steps.append(through(before, numbers[9:]))
        before = {to: (cost, place) for to, (cost, place, _) in steps[-1].items()}
    cost, closing, state = best_end(before)
    out, ids = [], segments["segment"].tolist()
    for nr in reversed(range(len(steps))):
        entry, last = steps[nr][state][2], nr == len(steps) - 1
        numbers = counts.result(cost) if last else None
        out.append((segments["conv"].iloc[nr], ids[nr], ids[0], entry, state, closing if last else 0, numbers))
        state = entry
    return pd.DataFrame(out, columns=["conv", "segment", "conversation", "entry", "leave", "closing", "numbers"])


def _resolve(held: int):
    """Segments, each a row with its states and then its rows, to blocks of edits and repaired lines."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        head = search = repair = None
        waiting: list[tuple[str, str]] = []
        at = nr = 0

        def give(final: list[str]) -> None:
            nonlocal at
            for edits in final:
                repair.apply(edits, *waiting[at])
                waiting[at] = None
                at += 1
            if at > len(waiting) // 2:
                del waiting[:at]
                at = 0

        def done() -> list[tuple]:
            give(search.rest(head["leave"]))
            for _ in range(head["closing"]):
                repair.insert()
            return [(head["conversation"], head["segment"], nr, *repair.block())]

        for batch in batches:
            for row in batch.to_pylist():
                if row["letter"] is None:
                    if head is not None:
                        yield done()
                    head, search, repair = row, Survivors(row["entry"]), Repair(row["entry"])
                    waiting, at, nr = [], 0, 0
                    continue
                waiting.append((row["role"], row["text"]))
                give(search.step(row["letter"]))
                if repair.size > held:
                    yield [(head["conversation"], head["segment"], nr, *repair.block())]
                    nr += 1
        if head is not None:
            yield done()

    return lambda batches: _batches(blocks(batches), *_arrow(_BLOCKS))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of a conversation in order to its audit and the hash of its lines; one block is held."""

    def conversations() -> Iterator[list[tuple]]:
        known, audit, sha, lines = None, [], None, False
        for batch in batches:
            for conversation, part, text in zip(*(batch.column(c).to_pylist() for c in ("conversation", "audit", "text")), strict=True):
                if conversation != known:
                    if known is not None:
                        yield [(known, "".join(audit), sha.hexdigest())]
                    known, audit, sha, lines = conversation, [], hashlib.sha256(), False
                audit.append(part)
                if text is not None:
                    sha.update(("\n" * lines + text).encode("utf-8", "surrogatepass"))
                    lines = True
        if known is not None:
            yield [(known, "".join(audit), sha.hexdigest())]

    yield from _batches(conversations(), *_arrow("conversation bigint, audit string, sha string"))


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of ``rows`` with faults by crc32 of ``conv_id:turn`` modulo 20, and beside them ``alive``
    (false for a row that is dropped, which stays so that its conversation is known) and ``copies``.

    Nulls count as one space, but a null conv_id or turn stays one.
    """
    known: list[Column] = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fault = F.crc32(F.concat(known[0], F.lit(":"), known[1]).cast("binary")) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    plain = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), known[2].alias("role"), known[3].alias("text"), fault.alias("fault"))
    return plain.select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        (F.col("fault") != 0).alias("alive"),
        F.when(F.col("fault") == 3, 2).otherwise(1).alias("copies"),
    )


def repair_conversations(rows: DataFrame, held: int = HELD) -> DataFrame:
    """One row a conversation of ``rows`` (conv_id, turn, role, text, and perhaps alive and copies as ``damage`` gives them):
    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256, as in the contract.

    Rows are ordered by turn, a missing one first, rows of one turn by role and the SHA-256 of their text. Null roles and
    texts count as one space; a null conv_id is a conversation. An empty role may not stand anywhere. Repeated rows are
    duplicates. A conversation none of whose rows is alive has zeros, an empty audit and the hash of nothing. An empty table
    gives no rows. Other columns are left out.
    """
    spaces = rows.withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")})
    alive = F.col("alive") if "alive" in rows.columns else F.lit(True)
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    trimmed = F.col("trimmed")
    known = spaces.select(F.col("conv_id").cast("string").alias("conv"), "turn", "role", "text", alive.alias("alive"), copies.alias("copies"))
    known = known.withColumns({"trimmed": F.rtrim("text", F.lit(BLANKS)), "uid": F.monotonically_increasing_id()})
    known = known.select(
        "conv",
        "turn",
        "role",
        F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"), 256)).alias("hash"),
        "uid",
        F.lit(1).alias("kind"),
        F.when(F.col("alive"), F.col("text")).otherwise("").alias("text"),
        "alive",
        (trimmed == "").alias("blank"),
        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
        "copies",
    )
    # written once, so that both readers below see the same running numbers
    known = stage(known, "turns")
    # the first row of each role and text of a conversation is announced by a row of the same place in the order
    told = known.where(F.col("alive") & ~F.col("blank")).groupBy("conv", "hash").agg(F.min(F.struct("turn", "role", "uid")).alias("first"))
    told = told.select("conv", "first.turn", "first.role", "hash", "first.uid", F.lit(0).alias("kind"))
    order = ["conv", "turn", "role", "hash", "uid"]
    dealt = known.unionByName(told, allowMissingColumns=True).repartitionByRange(*order).sortWithinPartitions(*order, "kind")
    read = dealt.select("conv", "kind", "turn", "role", "text", "alive", "blank", "truncated", "copies")
    scanned = stage(read.mapInArrow(_scan(held), _SCANNED), "scanned")

    segments = scanned.where("kind = 'segment'").select("conv", "segment", "numbers")
    decided = stage(segments.groupBy("conv").applyInPandas(_decide, _DECIDED), "decided")
    rows_of = scanned.where("kind = 'row'").select("segment", "nr", "letter", "role", "text")
    heads = decided.select("segment", F.lit(-1).cast("bigint").alias("nr"), "conversation", "entry", "leave", "closing")
    dealt = rows_of.unionByName(heads, allowMissingColumns=True).repartition("segment").sortWithinPartitions("segment", "nr")
    blocks = dealt.mapInArrow(_resolve(held), _BLOCKS)
    joined = blocks.repartition("conversation").sortWithinPartitions("conversation", "segment", "nr")
    digests = joined.mapInArrow(_digest, "conversation bigint, audit string, sha string")
    long = decided.where("numbers is not null").select("conv", "conversation", "numbers").join(digests, "conversation")

    columns = ["conv", "numbers", "audit", "sha"]
    found = scanned.where("kind = 'whole'").select(*columns).unionByName(long.select(*columns))
    numbers = [F.col("numbers")[i].alias(name) for i, name in enumerate(RESULTS)]
    conv = F.col("conv").cast(rows.schema["conv_id"].dataType).alias("conv_id")
    return found.select(conv, *numbers, "audit", F.col("sha").alias("repaired_sha256"))
