"""SimHash near-duplicates: 64-bit fingerprints, compared bit-sliced within blocks that share key bits.

Fingerprints within ``radius`` bits of each other agree on at least three of
five parts of their bits (radius 2), so each distinct fingerprint goes to ten
tables keyed by three parts. Rows of one key are compared by bit planes: the
planes are stored vertically, one bit of every row in a word, distances of many
pairs are counted at once by carry-save adders, and a block is left as soon as
all its pairs are beyond the radius. A key with many fingerprints is split into
tiles, every pair of which meets in one task; only links that connect something
new within a task are returned, which loses no link between components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerpulse.llm.components import connected_components
from ledgerpulse.llm.frames import TEXTS_AT_ONCE, unused
from ledgerpulse.session import stage

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Rows of one key that meet in a task; more are split into tiles.
TILE = 2048
#: Groups up to this size are compared together, by shifts.
SMALL = 48
#: Bit planes between two looks at what is still within the radius.
LOOK = 8

_BYTE_BITS = np.array([[v >> b & 1 for b in range(8)] for v in range(256)], dtype=np.int64)


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint: a bit is 1 if it is set in over half of the shingles' XXH64.

    Words are what ASCII white space separates, A-Z lower-cased; a text of fewer
    words than a shingle is one shingle, one without words has fingerprint 0.
    """
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    size = min(shingle, len(words))
    shingles = map(b" ".join, zip(*[words[i:] for i in range(size)]))
    n = len(words) - size + 1
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=n)
    # counts of byte values at each of eight places give the counts of all bits
    places = hashes.view(np.uint8).reshape(n, 8) + (np.arange(8, dtype=np.int64) << 8)
    counts = np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int.from_bytes(np.packbits(2 * counts.ravel() > n, bitorder="little").tobytes(), "little")


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint of a text as a BIGINT with the same bits."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([simhash(t, shingle) for t in texts], dtype=np.uint64).astype(np.int64)

    return F.pandas_udf(run, "long").asNondeterministic()(text)


def part_masks(radius: int) -> list[int]:
    """Masks of the bits that a table's key holds: all choices of three parts out of ``radius`` + 3."""
    parts = np.array_split(np.arange(64), radius + 3)
    masks = [sum(1 << int(b) for b in part) for part in parts]
    return [sum(chosen) for chosen in combinations(masks, 3)]


def _planes(bits: np.ndarray) -> np.ndarray:
    """64 rows of words: row b holds bit b of every fingerprint."""
    n = len(bits)
    wide = np.zeros(-(-n // 64) * 64, dtype="<u8")
    wide[:n] = bits
    columns = np.unpackbits(wide.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(columns.T.copy(), axis=1, bitorder="little").view("<u8")


class _Counter:
    """Counts set bits of many lanes at once, up to ``limit``; lanes beyond it are over."""

    def __init__(self, shape: tuple[int, ...], limit: int):
        self.limit = limit
        self.digits = [np.zeros(shape, dtype="<u8") for _ in range(max(1, limit.bit_length()))]
        self.over = np.zeros(shape, dtype="<u8")

    def add(self, lanes: np.ndarray) -> None:
        carry = lanes
        for digit in self.digits:
            carry, digit[...] = carry & digit, digit ^ carry
        self.over |= carry

    def within(self) -> np.ndarray:
        """Lanes whose count is not above the limit."""
        above, equal = self.over.copy(), ~self.over
        for place in reversed(range(len(self.digits))):
            if self.limit >> place & 1:
                equal &= self.digits[place]
            else:
                above |= equal & self.digits[place]
                equal &= ~self.digits[place]
        return ~above

    def keep(self, chosen: np.ndarray) -> None:
        self.digits = [d[chosen] for d in self.digits]
        self.over = self.over[chosen]


def _set(words: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")[:n])


def links_by_shift(bits: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group within the radius, for sorted groups: row i is compared with row i + s for all i at once."""
    rows = np.arange(len(bits))
    shift = 0
    while len(rows) > 1:
        shift += 1
        same = np.zeros(len(rows), dtype=bool)
        same[:-shift] = group[rows[:-shift]] == group[rows[shift:]]
        if not same.any():
            return
        left = np.flatnonzero(same)
        a, b = _planes(bits[rows[left]]), _planes(bits[rows[left + shift]])
        counter, live = _Counter((a.shape[1],), radius), np.arange(a.shape[1])
        for plane in range(64):
            counter.add((a[plane] ^ b[plane])[live])
            if plane % LOOK == LOOK - 1:
                still = counter.within() != 0
                if not still.all():
                    live = live[still]
                    counter.keep(still)
                if not len(live):
                    break
        if len(live):
            near = np.zeros(a.shape[1], dtype="<u8")
            near[live] = counter.within()
            hit = _set(near, len(left))
            yield rows[left[hit]], rows[left[hit] + shift]
        if shift % 8 == 0:  # rows of groups that have no pairs at larger shifts
            size = np.bincount(group[rows], minlength=int(group.max()) + 1)
            keep = size[group[rows]] > shift
            rows = rows[keep]


def links_by_planes(bits: np.ndarray, radius: int, chunk: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of one group, the rows within the radius: a chunk of rows against the planes of all."""
    planes, n = _planes(bits), len(bits)
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    for at in range(0, n, chunk):
        mine = bits[at : at + chunk].astype("<u8")
        counter = _Counter((len(mine), planes.shape[1]), radius)
        live = np.arange(len(mine))
        for plane in range(64):
            flip = np.where(mine[live] >> np.uint64(plane) & np.uint64(1), ones, np.uint64(0))
            counter.add(planes[plane][None, :] ^ flip[:, None])
            if plane % LOOK == LOOK - 1:
                still = counter.within().any(axis=1)
                if not still.all():
                    live = live[still]
                    counter.keep(still)
                if not len(live):
                    break
        for k, words in zip(live.tolist(), counter.within() if len(live) else [], strict=True):
            yield at + k, _set(words, n)


def spanning_links(bits: np.ndarray, group: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (rows i, j) that connect each group's rows as all links within the radius do. Groups are sorted."""
    root, out = list(range(len(bits))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(bits)])))
    small = np.repeat(sizes <= SMALL, sizes) & (np.repeat(sizes, sizes) > 1)
    if small.any():
        places = np.flatnonzero(small)
        dense = np.unique(group[places], return_inverse=True)[1]
        for i, j in links_by_shift(bits[places], dense, radius):
            for a, b in zip(places[i].tolist(), places[j].tolist(), strict=True):
                ra, rb = find(a), find(b)
                if ra != rb:
                    root[max(ra, rb)] = min(ra, rb)
                    out.append((a, b))
    for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        label = np.arange(size)
        for k, near in links_by_planes(bits[start : start + size], radius):
            labels, first = np.unique(label[near], return_index=True)
            if len(labels) > 1:
                out += [(start + k, start + int(near[j])) for j in first if near[j] != k]
                label[np.isin(label, labels)] = labels[0]
    return out


def near_links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between the distinct BIGINT values ``fp`` of ``prints`` that connect all within the radius."""
    tables = F.array(*[F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(m - (m >> 63 << 64))).alias("bits")) for t, m in enumerate(part_masks(radius))])
    keyed = prints.select("fp", F.explode(tables).alias("key")).select("fp", F.xxhash64("key.table", "key.bits").alias("key"))
    sizes = stage(keyed.groupBy("key").count().where("count > 1"), "keys")
    dealt = keyed.join(sizes, "key").withColumn("tiles", F.ceil(F.col("count") / tile).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, own).alias("i"), F.greatest(t, own).alias("j")))
    dealt = dealt.withColumn("meet", F.explode(met)).select("fp", F.xxhash64("key", "meet.i", "meet.j").alias("key"))
    return (
        dealt.repartition("key").sortWithinPartitions("key", "fp").mapInPandas(_compare(radius), "a bigint, b bigint").distinct()
    )


def _compare(radius: int):
    def links(rows: pd.DataFrame) -> pd.DataFrame:
        bits = rows["fp"].to_numpy().astype(np.int64).view(np.uint64)
        found = np.array(spanning_links(bits, rows["key"].to_numpy(), radius), dtype=np.int64).reshape(-1, 2)
        values = rows["fp"].to_numpy()
        return pd.DataFrame({"a": values[found[:, 0]], "b": values[found[:, 1]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            part = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if len(part):
                last = int(np.searchsorted(part["key"].to_numpy(), part["key"].iloc[-1]))  # its key may go on
                yield links(part.iloc[:last])
                rest = part.iloc[last:]
        if rest is not None and len(rest):
            yield links(rest)

    return run


def near_duplicate_classes(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, text_key, root) of each row of ``docs``: rows with one root are linked by fingerprints within the radius.

    A null text is empty; empty texts share fingerprint 0, which links like any other. Nothing is dropped: a null
    doc_id keeps its row, repeated rows share a root, and an empty table gives an empty one.
    """
    prints = stage(docs.select("doc_id", fingerprint(F.col("text"), shingle).alias("fp"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_key")), "fingerprints", TEXTS_AT_ONCE)
    distinct = prints.select("fp").distinct()
    classes = stage(connected_components(near_links(distinct, radius)), "classes")
    roots = stage(distinct.join(classes, distinct["fp"] == classes["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")), "roots")
    return prints.join(roots, "fp")


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row: 16 hex digits, the smallest doc_id reachable by links."""
    rows = stage(near_duplicate_classes(docs, shingle, radius), "members")
    smallest = stage(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest")
    return rows.join(smallest, "root").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each class: of the smallest doc_id, and of the smallest text digest among equal ids.

    A row without a doc_id stays only where its class has no row with one. Fully repeated rows count once.
    """
    rows = stage(near_duplicate_classes(docs, shingle, radius), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    kept = stage(rows.groupBy("root").agg(first.alias("first")).select("first.doc_id", "first.text_key"), "kept")
    key, other = unused(docs, "kept_text_key", "kept_doc_id")
    marked = docs.withColumn(key, F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    renamed = kept.withColumnsRenamed({"text_key": key, "doc_id": other})
    found = marked.join(renamed, (marked[key] == renamed[key]) & marked["doc_id"].eqNullSafe(renamed[other])).drop(renamed[key], renamed[other])
    matched = rows.join(kept, (rows["text_key"] == kept["text_key"]) & rows["doc_id"].eqNullSafe(kept["doc_id"])).count()
    if matched > kept.count():  # some kept row is repeated
        found = found.dropDuplicates(["doc_id", key])
    return found.drop(key)
