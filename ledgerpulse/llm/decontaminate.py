"""Benchmark decontamination: word windows of test items, looked up in every text.

The set of item windows goes to every task. It is cut into chunks of at most
``CHUNK_BYTES`` of item text, so that what is broadcast has a fixed bound; a
larger benchmark takes more passes over the documents, each of which adds to
what the passes before have found. The index of a chunk is built once, as
arrays: word numbers of the items, and the distinct windows sorted by hash, each
with its items. Within a task, a rolling polynomial hash is computed for a whole
text at once, filtered through a bitmap that has the size of the index, looked
up, and verified word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerpulse.llm.frames import unused
from ledgerpulse.session import stage

WINDOW = 13
# A text is contaminated when a word in this many, or more, is hit.
SHARE = 20
CHUNK_BYTES = 16_000_000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
# Places of the bitmap for each window: about one window in so many passes it by chance.
_SPARSE = 16
_BASE = np.uint64(0x9E3779B97F4A7C15)

_FOUND = "n_words long, hits array<struct<start: long, stop: long>>, items array<string>"


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and any other characters beyond ASCII."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def _hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A polynomial hash of every run of ``size`` words."""
    n = len(codes) - size + 1
    h = codes[:n].copy()
    for j in range(1, size):
        h *= _BASE
        h += codes[j : j + n]
    return h


def _index(flat: np.ndarray, codes: np.ndarray, places: np.ndarray, owners: np.ndarray, size: int) -> dict[str, Any] | None:
    """The windows of one size that start at ``places``; None if two unlike ones have the same hash."""
    h = codes[flat[places]]
    for j in range(1, size):
        h *= _BASE
        h += codes[flat[places + j]]
    order = np.lexsort((owners, h))
    h, places, owners = h[order], places[order], owners[order]
    same = np.concatenate(([False], h[1:] == h[:-1]))
    copies = np.flatnonzero(same)
    if any((flat[places[copies] + j] != flat[places[copies - 1] + j]).any() for j in range(size)):
        return None
    kept = ~same | np.concatenate(([True], owners[1:] != owners[:-1]))
    heads = np.flatnonzero(~same[kept])
    bits = max(10, int(len(heads) * _SPARSE - 1).bit_length())
    return {
        "bits": bits, "hashes": h[~same], "places": places[~same], "owners": owners[kept], "starts": np.append(heads, kept.sum()).astype(np.int32),
    }


def window_arrays(items: Iterable[tuple[str | None, str | None]], window: int = WINDOW) -> dict[str, Any]:
    """The index of (item id, text) pairs: vocabulary, item word numbers, and per window size its distinct windows and their items."""
    numbers: dict[bytes, int] = {}
    names, runs = [], []
    for item, text in items:
        ids = np.fromiter((numbers.setdefault(w, len(numbers) + 1) for w in words(text)), dtype=np.int32)
        if len(ids):
            names.append(item)
            runs.append(ids)
    lengths = np.array([len(r) for r in runs], dtype=np.int64)
    first = np.cumsum(lengths) - lengths
    flat = np.concatenate(runs) if runs else np.zeros(0, dtype=np.int32)
    sizes, seed = np.minimum(lengths, window), 0
    while True:  # codes under which unlike windows have unlike hashes: in all likelihood the first ones
        codes = np.random.default_rng(seed).integers(1, 1 << 63, len(numbers) + 1, dtype=np.uint64)
        found = {}
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            counts = lengths[own] - size + 1
            within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            places = (np.repeat(first[own], counts) + within).astype(np.int32)
            found[size] = _index(flat, codes, places, np.repeat(own, counts).astype(np.int32), size)
        if None not in found.values():
            return {"words": b" ".join(numbers), "names": names, "flat": flat, "codes": codes, "windows": found}
        seed += 1


class WindowIndex:
    """Looks up the windows of texts in ``window_arrays``. The dictionary and the bitmaps stay with these, for the next task of a worker."""

    def __init__(self, arrays: dict[str, Any]):
        if "numbers" not in arrays:
            for known in arrays["windows"].values():
                known["bitmap"] = np.zeros(1 << known["bits"], dtype=bool)
                known["bitmap"][known["hashes"] >> np.uint64(64 - known["bits"])] = True
            arrays["numbers"] = {w: i for i, w in enumerate(arrays["words"].split(b" "), 1)} if arrays["words"] else {}
        self.arrays = arrays

    def scan(self, text_words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Maximal runs of hit words, as (start, stop), and the items with a window in the text."""
        n, windows, flat = len(text_words), self.arrays["windows"], self.arrays["flat"]
        if not n or not windows:
            return [], set()
        ids = np.fromiter(map(self.arrays["numbers"].get, text_words, repeat(0)), dtype=np.int32, count=n)
        if not ids.any():
            return [], set()
        codes, edges, owners = self.arrays["codes"][ids], np.zeros(n + 1, dtype=np.int64), []
        for size, known in windows.items():
            if size > n:
                continue
            h = _hashes(codes, size)
            at = np.flatnonzero(known["bitmap"][h >> np.uint64(64 - known["bits"])])
            entry = np.minimum(np.searchsorted(known["hashes"], h[at]), len(known["hashes"]) - 1)
            true = known["hashes"][entry] == h[at]
            for j in range(size if true.any() else 0):
                true &= flat[known["places"][entry] + j] == ids[at + j]
            at = at[true]
            np.add.at(edges, at, 1)
            np.add.at(edges, at + size, -1)
            owners += [known["owners"][known["starts"][e] : known["starts"][e + 1]] for e in np.unique(entry[true])]
        hit = np.cumsum(edges[:n]) > 0
        turns = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
        items = {self.arrays["names"][i] for i in np.unique(np.concatenate(owners)).tolist()} if owners else set()
        return list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)), items


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of two lists of runs, as maximal runs."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted([*a, *b]):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _chunks(benchmark: DataFrame, chunk_bytes: int) -> Iterator[Iterator[tuple[str | None, str | None]]]:
    """The items in chunks of about ``chunk_bytes``, at least one; of a chunk, the driver holds the index."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // chunk_bytes))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield ((r.item, r.text) for r in part.toLocalIterator())


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` with a struct column ``decontamination``: n_words, hits (runs of hit words) and items.

    A null or empty text has no words and no hits. Repeated items and rows
    change nothing; items without an id hit words but are in no list of items.
    A column of that name in ``docs`` is replaced. An empty table of documents
    gives an empty result, an empty benchmark no hits.
    """
    name = "decontamination"
    found = docs.select(*[c for c in docs.columns if c != name])
    for k, items in enumerate(_chunks(benchmark, chunk_bytes)):
        scan = _scan(docs.sparkSession.sparkContext.broadcast(window_arrays(items, window)))
        if k:
            found = stage(found, f"pass{k}")
        found = found.withColumn(name, scan(F.col("text"), *[F.col(name)] * (k > 0)))
    return found


def _scan(shared):
    def row(index, text, known=None):
        found = words(text)
        hits, items = index.scan(found)
        if known is not None:
            hits = _merged(hits, [(r["start"], r["stop"]) for r in known["hits"]])
            items = items.union(known["items"])
        return len(found), [{"start": a, "stop": b} for a, b in hits], sorted(i for i in items if i is not None)

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        index = WindowIndex(shared.value)
        for batch in batches:
            texts, *before = batch if isinstance(batch, tuple) else (batch,)
            known = before[0].to_dict("records") if before else repeat(None)
            out = [row(index, t, k) for t, k in zip(texts, known)]
            yield pd.DataFrame(out, columns=["n_words", "hits", "items"])

    return F.pandas_udf(run, _FOUND).asNondeterministic()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, **options) -> DataFrame:
    """``find_hits`` with n_words, n_hit, n_items, items_sha256 and contaminated beside it; columns of these names in ``docs`` are replaced."""
    found = find_hits(docs, benchmark, window, **options)
    d = F.col("decontamination")
    n_hit = F.aggregate(d["hits"], F.lit(0).cast("long"), lambda a, r: a + r["stop"] - r["start"])
    own = {
        "n_words": d["n_words"],
        "n_hit": n_hit,
        "n_items": F.size(d["items"]).cast("long"),
        "items_sha256": F.sha2(F.concat_ws(",", d["items"]).cast("binary"), 256),
    }
    return found.withColumns(own).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated documents, all columns as they were.

    A null or empty text has no words and stays, repeated rows are judged alike; an empty benchmark drops nothing.
    """
    kept, (flag,) = docs.columns, unused(docs, "contaminated_text")
    plain = docs.select("text", F.struct(*kept).alias(flag))
    return contamination(plain, benchmark, **options).where(~F.col("contaminated")).select(f"{flag}.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` with every run of hit words cut out of the text, from its first word to its last.

    A null text stays null; repeated rows are cut alike; an empty benchmark cuts nothing.
    """
    found = find_hits(docs, benchmark, **options)

    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, hits in batches:
            yield pd.Series([_cut(t, h) for t, h in zip(texts, hits, strict=True)], dtype="object")

    return found.withColumn("text", cut(F.col("text"), F.col("decontamination.hits"))).select(*docs.columns)


def _cut(text: str | None, hits) -> str | None:
    if text is None or not len(hits):
        return text
    data = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in WORD.finditer(data.lower())]
    out, at = [], 0
    for run in hits:
        out.append(data[at : places[run["start"]][0]])
        at = places[run["stop"] - 1][1]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")
