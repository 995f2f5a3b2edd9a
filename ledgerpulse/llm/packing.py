"""Best-fit packing of tokenised texts into sequences of fixed length, by hierarchical residual packing.

Pieces are dealt to partitions and packed best-fit in each. Nearly full
sequences are done; the others travel up a tree: fewer and fewer partitions
receive them, whole sequences being the items of the next best-fit round, until
a round on one partition is done or rounds no longer save sequences. Each round
is written to the shared folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerpulse.llm.frames import TEXTS_AT_ONCE, rows, worker_memory
from ledgerpulse.session import stage

CAPACITY = 2048
#: A sequence with fewer free tokens than this is done.
SLACK = 16
#: Pieces that one packing task holds.
TASK_PIECES = 100_000
#: A round that saves a smaller share of the open sequences is the last.
LEAST_GAIN = 0.005
#: Distinct words whose ids a worker remembers, those of the last texts first, and the longest of them in bytes.
REMEMBERED, LONGEST = 600_000, 64
#: Bytes of text whose words are looked up together, and words that one call tokenises: an encoding takes many times its ids.
TOGETHER, CALL = 1 << 22, 1 << 14

#: The rules under which a plain word falls into pieces that the model gets as they are, and added tokens that hold this mark.
RULES = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
MARK = "<|"
#: Plain words: visible ASCII and the Latin-1 letters with accents, which NFC leaves alone; and their pieces in lower case.
PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"
PIECE = "'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+"

# Ids are text on their way through pandas, where a missing one would make all of them floating-point numbers.
PIECES = "doc_id string, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = f"{PIECES}, sequence_id bigint, offset bigint"


class WordTokenizer:
    """Token ids, as little-endian bytes, of texts under a tokenizer that never joins what white space separates.

    Texts are split and their distinct words numbered by Arrow; each distinct word of a group of texts is looked up once,
    those not remembered are tokenised, and the ids of the texts are gathered from those of the words. Words and ids are
    remembered as arrays: a worker keeps them after its task, beside what the tasks of later stages take, and as Python
    objects they were five times as large.

    Plain words under ``RULES`` are lower-cased and split by Arrow, and the tokenizer's model gets each distinct piece once:
    the tokenizer's own normalizer, splitter and encodings take most of its time. All other words are left to it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.ruled = _follows_rules(self.tokenizer)
        self.as_bytes = {c: _byte_level(chr(c)) for c in range(0xDF, 0x100)}
        self.memory = worker_memory(f"words of {path}")
        if not self.memory:
            self.memory.update(words=pa.array([], pa.large_string()), ids=np.zeros(0, dtype="<u4"), sizes=np.zeros(0, dtype=np.int64))

    def ids(self, texts: pa.Array) -> list[bytes]:
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        numbered = split.flatten().dictionary_encode()
        place, ids, sizes = self._looked_up(numbered.dictionary)
        ids, stops = _joined(split, place[numbered.indices.to_numpy()], ids, sizes)
        ids, cuts = ids.tobytes(), (4 * stops).tolist()
        return [ids[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def _looked_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct words their places among runs of ids: the ids, and the size of each run."""
        known = self.memory["words"]
        place = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy().astype(np.int64)
        unknown = np.flatnonzero(place < 0)
        plain = self._plain(words.take(pa.array(unknown)))
        unknown, n = np.concatenate([unknown[plain], unknown[~plain]]), int(plain.sum())
        place[unknown] = len(known) + np.arange(len(unknown))
        new = words.take(pa.array(unknown))
        parts = [self._by_pieces(new[:n])]
        parts += [self._tokenised(new[i : i + CALL].to_pylist()) for i in range(n, len(new), CALL)]
        ids = np.concatenate([self.memory["ids"], *[part[0] for part in parts]])
        sizes = np.concatenate([self.memory["sizes"], *[part[1] for part in parts]])
        self._remember(pa.concat_arrays([known, new]), ids, sizes, place)
        return place, ids, sizes

    def _remember(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray, place: np.ndarray) -> None:
        """Keep the words at ``place``, and of the others the last ones, as many as there is room for."""
        other = np.ones(len(words), dtype=bool)
        other[place] = False
        order = np.concatenate([place, np.flatnonzero(other)])
        order = order[(pc.binary_length(words).to_numpy() <= LONGEST)[order]][:REMEMBERED]
        starts = np.cumsum(sizes) - sizes
        self.memory.update(words=words.take(pa.array(order)), ids=ids[_runs(starts[order], sizes[order])], sizes=sizes[order])

    def _plain(self, words: pa.Array) -> np.ndarray:
        """Whether the words can be split by Arrow."""
        if not self.ruled:
            return np.zeros(len(words), dtype=bool)
        plain = pc.and_not(pc.match_substring_regex(words, PLAIN), pc.match_substring(words, MARK))
        return plain.to_numpy(zero_copy_only=False)

    def _by_pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain words one after the other, and the number of each."""
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(words), PIECE, r"\0 "))
        numbered = split.flatten().dictionary_encode()
        ids, sizes = [np.zeros(0, dtype="<u4")], [np.zeros(0, dtype=np.int64)]
        for i in range(0, len(numbered.dictionary), CALL):
            found = [[token.id for token in self.model.tokenize(p.translate(self.as_bytes))] for p in numbered.dictionary[i : i + CALL].to_pylist()]
            ids.append(np.fromiter(chain.from_iterable(found), dtype="<u4"))
            sizes.append(np.fromiter(map(len, found), dtype=np.int64))
        ids, stops = _joined(split, numbered.indices.to_numpy(), np.concatenate(ids), np.concatenate(sizes))
        return ids, np.diff(stops)

    def _tokenised(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after the other, and the number of each."""
        encoded = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        return np.array(encoded.ids, dtype="<u4"), np.bincount(np.array(encoded.word_ids, dtype=np.int64), minlength=len(words))


def _follows_rules(tokenizer) -> bool:
    """Whether a tokenizer treats words by ``RULES``."""
    normalizer, pre_tokenizer = (json.loads(part.__getstate__()) if part else {} for part in (tokenizer.normalizer, tokenizer.pre_tokenizer))
    rules = {"normalizer": normalizer.get("normalizers"), "pretokenizers": pre_tokenizer.get("pretokenizers")}
    return rules == RULES and all(MARK in t.content and not t.normalized for t in tokenizer.get_added_tokens_decoder().values())


def _byte_level(text: str) -> str:
    """The characters that stand for the UTF-8 bytes of ``text`` in a byte-level vocabulary."""
    from tokenizers.pre_tokenizers import ByteLevel

    return ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(text)[0][0]


def _joined(split: pa.Array, which: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of lists one after the other, and where each list stops, from 0 on; ``which`` run of ids each element has."""
    ends = split.offsets.to_numpy() - split.offsets[0].as_py()
    stops = np.concatenate(([0], np.cumsum(sizes[which])))[ends]
    return ids[_runs((np.cumsum(sizes) - sizes)[which], sizes[which])], stops


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs, one run after the other."""
    places = np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    places += np.arange(len(places))
    return places


def _together(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of about ``size`` bytes, larger ones as they are."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.nbytes for b in held) + batch.nbytes > size:
            yield pa.concat_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def _groups(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes of text."""
    before = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(before, (before[start - 1] if start else 0) + size, side="right")))
        yield start, stop
        start = stop


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: the ids of each text and a closing 0, cut every ``capacity`` ids.

    A null text is empty and yields the piece (0). Repeated rows yield their pieces again; a null doc_id stays null; an empty
    table yields none.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(tokenizer_path)
        step = 4 * capacity
        for batch in _together(batches, TOGETHER):
            docs, texts = batch.column("doc_id"), batch.column("text")
            for first, stop in _groups(texts, TOGETHER):
                out: list[tuple[int, int, int, int, int]] = []
                for row, ids in enumerate(tokenizer.ids(texts[first:stop]), first):
                    ids += b"\0\0\0\0"
                    for piece, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        out.append((row, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                row, piece, at, length, crc = (np.array(c) for c in zip(*out, strict=True))
                columns = [docs.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(at), pa.array(length), pa.array(crc)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])
                pa.default_memory_pool().release_unused()  # workers live on, and Arrow keeps what it has freed

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: items by falling size, each to the fullest bin that has room."""
    bins = np.empty(len(sizes), dtype=np.int64)
    with_room: dict[int, list[int]] = {}  # bins by free space
    free = 0  # bit k: some bin has k free
    n = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = free >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            found = with_room[room].pop()
            if not with_room[room]:
                free &= ~(1 << room)
        else:
            room, found, n = capacity, n, n + 1
        bins[i] = found
        if left := room - size:
            with_room.setdefault(left, []).append(found)
            free |= 1 << left
    return bins


def _round(level: int, capacity: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Packs the open sequences of a partition, and gives the new sequences' ids, offsets and fill."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = rows(batches)
        if part is None:
            return
        part = part.sort_values(["sequence_id", "offset", "doc_id", "piece", "start", "ids_crc32"], kind="stable", ignore_index=True)
        ids = part["sequence_id"].to_numpy()
        item = np.concatenate(([0], np.cumsum(ids[1:] != ids[:-1])))
        sizes = np.bincount(item, weights=part["length"]).astype(np.int64)
        bins = best_fit(sizes, capacity)
        part["item"], part["bin"] = item, bins[item]
        part = part.sort_values(["bin", "item", "offset"], kind="stable", ignore_index=True)
        before = part["length"].cumsum() - part["length"]
        part["offset"] = before - before.groupby(part["bin"]).transform("first")
        part["filled"] = part.groupby("bin")["length"].transform("sum")
        part["sequence_id"] = (level << 52) + (TaskContext.get().partitionId() << 28) + part["bin"]
        yield part.drop(columns=["item", "bin"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, task_pieces: int = TASK_PIECES) -> DataFrame:
    """``pieces`` with a BIGINT doc_id, sequence_id and offset: gapless sequences of at most ``capacity``, as few as best-fit finds.

    Pieces need the columns of ``token_pieces``; a piece of full length is a sequence of its own.
    """
    schema = f"{PACKED}, filled bigint"
    pieces = stage(pieces, "pieces", TEXTS_AT_ONCE)
    # at first every piece is a sequence; the running number is only a key that tells repeated pieces apart
    alone = pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint"), "filled": F.col("length")})
    done = [alone.where(F.col("filled") > capacity - slack).withColumn("sequence_id", -1 - F.col("sequence_id"))]
    pending = stage(alone.where(F.col("filled") <= capacity - slack), "pending")
    count = pending.count()
    tasks, sequences, level = -(-count // task_pieces), count, 0
    while count:
        level += 1
        dealt = pending.repartition(tasks, F.xxhash64("sequence_id", F.lit(level)))
        packed = stage(dealt.mapInPandas(_round(level, capacity), schema), f"round{level}")
        pending = packed.where(F.col("filled") <= capacity - slack)
        size = pending.agg(F.count("*").alias("n"), F.count_if(F.col("offset") == 0).alias("open")).first()
        last = tasks == 1 or (level > 1 and sequences - size["open"] < LEAST_GAIN * sequences)
        done.append(packed if last else packed.where(F.col("filled") > capacity - slack))
        if last:
            break
        count, sequences = size["n"], size["open"]
        tasks = min(max(1, tasks // 2), max(1, -(-count // task_pieces)))
        tasks = max(tasks, -(-count // (4 * task_pieces)))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint")).drop("filled")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, **options) -> DataFrame:
    """The pieces of ``docs``, packed. A null text is empty: one piece of the end id; repeated rows are packed each; an empty table gives none."""
    return pack(token_pieces(docs, tokenizer_path, capacity), capacity, **options)
