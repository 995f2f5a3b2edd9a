"""Token ids in binary files: one array of ids a shard, with Elias-Fano coded document boundaries.

A file (little-endian) is a header of 64 bytes, the ids of the shard's documents one after the other as 16- or 32-bit
numbers, and two Elias-Fano sequences: where each document ends, and the documents' ids. Either takes about
2 + log2(range / count) bits a document and answers "the i-th value" from the file's bytes through samples of its select
structure, so that no table of 64-bit offsets is needed, neither in the file nor in memory. Spark's own writer commits
the files, so a lost executor leaves none half written. Documents are in ascending order over the shards in the order of
their names; the name of a shard's folder carries the number of its ids, so that the listing gives where a shard begins.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerpulse.llm.frames import worker_memory
from ledgerpulse.session import scratch_dir

#: Ids of a shard; a document is never cut, so a longer one is a shard by itself.
SHARD_IDS = 2_000_000
#: Bytes of text that are tokenised together.
TOGETHER = 1 << 22
#: Parts of words that a worker remembers, twice; bytes of the longest ids among them.
REMEMBERED, LONGEST = 300_000, 64
#: Values between two samples of a select structure.
SAMPLE = 256

MAGIC = b"LPTOKEF1"
#: magic, bytes of an id, documents, documents without an id, ids, bytes of the boundaries, bytes of the documents' ids
_HEADER, _HEADER_SIZE = "<8sQQQQQQ8x", 64

# The pattern by which the byte-level tokenizer cuts a text before it merges.
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A space before white space of any kind or at the end: such a text is not cut at every space.
_UNEVEN = r"[ ]([\x00-\x20\x7f-\xa0]|\x{1680}|[\x{2000}-\x{200a}]|\x{2028}|\x{2029}|\x{202f}|\x{205f}|\x{3000}|$)"


class EliasFano:
    """Non-decreasing numbers from 0 on, read from ``data``."""

    _HEAD, _HEAD_SIZE = "<QQQ", 24  # values, low bits of a value, 64-bit words of the high part

    def __init__(self, data: bytes | memoryview):
        self.n, self.low_bits, words = struct.unpack_from(self._HEAD, data)
        at = self._HEAD_SIZE
        self.high = np.frombuffer(data, dtype="<u8", count=words, offset=at)
        at += 8 * words
        self.samples = np.frombuffer(data, dtype="<u4", count=-(-self.n // SAMPLE), offset=at)
        at += 4 * len(self.samples)
        self.low = np.frombuffer(data, dtype=np.uint8, count=-(-self.n * self.low_bits // 8), offset=at)

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        """A value's low bits are stored as they are; its high part h is the bit h + i of the high bits, i its place."""
        values = np.asarray(values, dtype=np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        words = int(ones[-1]) // 64 + 1 if n else 0
        high = np.zeros(64 * words, dtype=np.uint8)
        high[ones] = 1
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)).astype(np.uint8) & 1
        parts = [struct.pack(cls._HEAD, n, low_bits, words), np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u4")]
        parts.append(np.packbits(bits.reshape(-1), bitorder="little"))
        return b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)

    def _low(self, i: int) -> int:
        first, last = i * self.low_bits, (i + 1) * self.low_bits
        part = int.from_bytes(self.low[first // 8 : -(-last // 8)].tobytes(), "little")
        return part >> first % 8 & (1 << self.low_bits) - 1

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """The i-th value: from the sample before it, words are skipped by their number of ones."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        at = start // 64
        word = int(self.high[at]) >> start % 64 << start % 64
        while (ones := word.bit_count()) <= left:
            left -= ones
            at += 1
            word = int(self.high[at])
        for _ in range(left):
            word &= word - 1
        one = 64 * at + (word & -word).bit_length() - 1
        return (one - i) << self.low_bits | self._low(i)

    def values(self) -> np.ndarray:
        """All values."""
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))
        out = (ones - np.arange(self.n)) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
            out |= bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits))
        return out


class TokenShard:
    """One file: ``shard[i]`` are the ids of its i-th document, ``shard.doc_id(i)`` is its id."""

    def __init__(self, data: bytes | memoryview):
        magic, self.width, self.n_docs, self.n_missing, self.n_ids, ends, _ = struct.unpack_from(_HEADER, data)
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        at = _HEADER_SIZE
        self.ids = np.frombuffer(data, dtype=f"<u{self.width}", count=self.n_ids, offset=at)
        at += self.width * self.n_ids
        data = memoryview(data)
        self.ends = EliasFano(data[at:])
        (self.least,) = struct.unpack_from("<q", data, at + ends)
        self.doc_ids = EliasFano(data[at + ends + 8 :])

    @staticmethod
    def pack(doc_ids: list[int | None], documents: list[np.ndarray], width: int) -> bytes:
        """The bytes of a file; documents without an id come first, the others by ascending id."""
        missing = sum(i is None for i in doc_ids)
        known = doc_ids[missing:]
        least = known[0] if known else 0
        ids = np.concatenate(documents) if documents else np.empty(0)
        ends = EliasFano.encode(np.cumsum([len(d) for d in documents]))
        named = struct.pack("<q", least) + EliasFano.encode(np.array([i - least for i in known], dtype=np.uint64))
        header = struct.pack(_HEADER, MAGIC, width, len(documents), missing, len(ids), len(ends), len(named))
        return b"".join((header, ids.astype(f"<u{width}").tobytes(), ends, named))

    def __len__(self) -> int:
        return self.n_docs

    def span(self, i: int) -> tuple[int, int]:
        return self.ends[i - 1] if i else 0, self.ends[i]

    def __getitem__(self, i: int) -> np.ndarray:
        start, stop = self.span(i)
        return self.ids[start:stop]

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_missing else self.least + self.doc_ids[i - self.n_missing]


class ByteTokenizer:
    """Token ids of texts under a byte-level BPE tokenizer.

    No token crosses from a text's word to the space of the next one, so texts are cut before every space that white space
    does not follow, distinct words are numbered by Arrow and tokenised by their parts, which the worker remembers. A text with
    a special token in it is left to the tokenizer as a whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts_of = regex.compile(_PARTS).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memory = worker_memory(f"parts of words of {path}")
        if not self.memory:
            self.memory.update(newer={}, older={})
        # a byte is written as the printable character of its code, or as one of those from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}

    def width(self) -> int:
        """Bytes of an id in a file."""
        return 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4

    def _part(self, part: str) -> bytes:
        """The ids of a part, remembered in two generations: when the newer one is full, it becomes the older."""
        ids = self.memory["newer"].get(part)
        if ids is None:
            ids = self.memory["older"].get(part)
            if ids is None:
                letters = "".join(map(self.letters.__getitem__, part.encode()))
                ids = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
            if len(ids) <= LONGEST:
                if len(self.memory["newer"]) >= REMEMBERED:
                    self.memory["older"], self.memory["newer"] = self.memory["newer"], {}
                self.memory["newer"][part] = ids
        return ids

    def _words(self, words: list[str], lead: str) -> list[bytes]:
        known, part, found = self.memory["newer"].get, self._part, []
        for w in words:
            ids = known(lead + w)
            if ids is None:
                if w.isalpha():  # what the pattern takes as one part
                    ids = part(lead + w)
                elif w[:-1].isalpha() and w[-1] in ".,;:!?":
                    ids = (known(lead + w[:-1]) or part(lead + w[:-1])) + part(w[-1])
                else:
                    ids = b"".join(map(part, self.parts_of(lead + w)))
            found.append(ids)
        return found

    def _whole(self, text: str) -> np.ndarray:
        """A text that is not cut at every space."""
        if any(mark in text for mark in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.frombuffer(b"".join(self._words(re.split(r"(?= \S)", text), "")), dtype="<u4")

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, of none for a null one."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        apart = pc.match_substring_regex(texts, _UNEVEN)
        for mark in self.special:
            apart = pc.or_(apart, pc.match_substring(texts, mark))
        apart = pc.or_(apart, pc.equal(pc.binary_length(texts), 0))
        even = texts.filter(pc.invert(apart))
        cut = self._even(even) if len(even) else iter(())
        return [self._whole(text.as_py()) if odd else next(cut) for text, odd in zip(texts, apart.to_pylist(), strict=True)]

    def _even(self, texts: pa.Array) -> Iterator[np.ndarray]:
        split = pc.split_pattern(texts, " ")
        ends = split.offsets.to_numpy()
        ends = ends - ends[0]
        numbered = split.flatten().dictionary_encode()
        which = numbered.indices.to_numpy().copy()
        # the first word of a text has no space in front
        starts = split.flatten().take(pa.array(ends[:-1])).dictionary_encode()
        which[ends[:-1]] = starts.indices.to_numpy() + len(numbered.dictionary)
        found = self._words(numbered.dictionary.to_pylist(), " ") + self._words(starts.dictionary.to_pylist(), "")
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        begins = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        counts = sizes[which]
        stops = np.cumsum(counts)
        ids = flat[np.arange(stops[-1], dtype=np.int32) + np.repeat((begins[which] - stops + counts).astype(np.int32), counts)]
        cuts = np.concatenate(([0], stops))[ends].tolist()
        return (ids[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True))


def _groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``TOGETHER`` bytes of text."""
    before = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(before, (before[start - 1] if start else 0) + TOGETHER, side="right")))
        yield start, stop
        start = stop


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, shard_ids: int = SHARD_IDS) -> None:
    """The ids of every text, ``end_id`` after each, as files below ``path``, in ascending order of doc_id.

    A null or empty text is ``end_id`` alone. Documents without a doc_id come first; rows that share one follow each other in
    the order of a hash of their texts, so that repeated rows are all kept and can be split over shards. An empty table
    leaves a folder without shards. Other columns are left out.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = ByteTokenizer(tokenizer_path)
        part, nr = TaskContext.get().partitionId(), 0
        closing = np.array([end_id], dtype="<u4")
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def shard() -> pa.RecordBatch:
            name = f"{part:08d}-{nr:06d}"
            data = TokenShard.pack(doc_ids, held, tokenizer.width())
            return pa.RecordBatch.from_pydict({"data": pa.array([data], pa.binary()), "shard": [name], "n_ids": pa.array([size], pa.int64())})

        for batch in batches:
            for first, stop in _groups(batch.column("text")):
                ids_of = tokenizer.ids(batch.column("text")[first:stop])
                for doc_id, ids in zip(batch.column("doc_id")[first:stop].to_pylist(), ids_of, strict=True):
                    if held and size + len(ids) + 1 > shard_ids:
                        yield shard()
                        doc_ids, held, size, nr = [], [], 0, nr + 1
                    doc_ids.append(doc_id)
                    held.append(np.concatenate((ids, closing)).astype(f"<u{tokenizer.width()}"))
                    size += len(ids) + 1
        if held:
            yield shard()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    order = ["doc_id", F.xxhash64("text")]
    # copies of one row have one place in the order; the running number lets a range end between them
    ranges = rows.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    shards = ranges.mapInArrow(build, "data binary, shard string, n_ids bigint")
    # the text writer writes bytes as they are; the line end after them is beyond what the header counts
    shards.select(F.col("data").cast("string").alias("data"), "shard", "n_ids").write.partitionBy("shard", "n_ids").text(path)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """shard, n_ids and start (ids of all shards before it) of the files below ``path``: one row a file, read from the listing."""
    listed = _files(spark, path).select("shard", F.col("n_ids").cast("bigint").alias("n_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return listed.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("bigint")))


def _files(spark: SparkSession, path: str) -> DataFrame:
    names = F.regexp_extract("path", "shard=([0-9-]+)/n_ids=([0-9]+)/", 1), F.regexp_extract("path", "shard=([0-9-]+)/n_ids=([0-9]+)/", 2)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select(names[0].alias("shard"), names[1].alias("n_ids"), "content")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids and ids_crc32 of every document in the files below ``path``.

    ``start`` counts the ids of all documents before it, ``ids`` holds little-endian 32-bit numbers, of which ids_crc32 is taken.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["shard"], batch["content"], strict=True):
                shard = TokenShard(content)
                out = []
                for i in range(len(shard)):
                    start, stop = shard.span(i)
                    ids = shard.ids[start:stop].astype("<u4").tobytes()
                    doc_id = shard.doc_id(i)
                    out.append((name, None if doc_id is None else str(doc_id), start, stop - start, ids, zlib.crc32(ids)))
                    if len(out) == 10_000:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
                yield pd.DataFrame(out, columns=columns)

    columns = ["shard", "doc_id", "start_in_shard", "n_tokens", "ids", "ids_crc32"]
    schema = "shard string, doc_id string, start_in_shard bigint, n_tokens bigint, ids binary, ids_crc32 bigint"
    found = _files(spark, path).select("shard", "content").mapInPandas(read, schema)
    joined = found.join(shard_starts(spark, path).select("shard", "start"), "shard")
    return joined.select(F.col("doc_id").cast("bigint"), (F.col("start") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids", "ids_crc32")


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int, shard_ids: int = SHARD_IDS) -> DataFrame:
    """``write_token_files`` to a new shared folder, and what ``read_token_files`` finds there."""
    path = f"{scratch_dir(docs.sparkSession)}/tokens"
    write_token_files(docs, path, tokenizer_path, end_id, shard_ids)
    return read_token_files(docs.sparkSession, path)
