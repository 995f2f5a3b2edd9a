"""Order MinHash fingerprints: signatures that follow edit distance, by DataFrame functions alone.

A text is the sequence of its words, its k-mers are runs of words. Each k-mer is
numbered by its earlier occurrences, so repeats are told apart, and hashed with
that number. The hashes fall into bins; of each bin the smallest few are
selected, put back into the order they have in the text, and hashed as a tuple.
Two texts agree in a bin if they share these k-mers in this order.

All steps work on arrays within a row, so nothing is exploded or shuffled; the
large sorts are of BIGINT arrays, which hold hash and place in one value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerpulse.session import stage

KMER = 3
BINS = 64
#: k-mers in a tuple.
TUPLE = 2
#: Bits of a value that hold the place of a k-mer, enough for the longest array there is; the others hold its hash.
#: Of two unlike k-mers with one hash the later is numbered as a repeat, in every copy of the text alike.
_PLACE = 31
_PLACES = (1 << _PLACE) - 1
_HASHES = (1 << 64 - _PLACE) - 1
#: Hexadecimal digits of a bin in a fingerprint, and what stands for an empty bin.
DIGITS = 4
_EMPTY = "-" * DIGITS


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _starts(values: Column, shift: int) -> Column:
    """Indices where a sorted array's values, without the lowest ``shift`` bits, differ from the value before."""
    head = lambda i: F.shiftrightunsigned(F.get(values, i), shift)
    return F.filter(F.sequence(F.lit(0), F.size(values) - 1), lambda i: (i == 0) | (head(i) != head(i - 1)))


def selected_tuples(text: Column, kmer: int = KMER, bins: int = BINS, size: int = TUPLE) -> Column:
    """An array of (bin, BIGINT hash) for the bins that hold k-mers; empty for a text without words.

    A text of fewer words than a k-mer is one k-mer; a null text is empty. ``bins`` is a power of 2.
    """
    bin_shift = 64 - (bins.bit_length() - 1)

    def packed(words: Column) -> Column:
        n = F.size(words)
        hashed = lambda i: F.shiftleft(F.xxhash64(*[F.get(words, i + j) for j in range(kmer)]), _PLACE)
        last = F.greatest(n - kmer, F.lit(0))
        return F.sort_array(F.transform(F.sequence(F.lit(0), last), lambda i: hashed(i).bitwiseOR(i.bitwiseAND(F.lit(_PLACES)).cast("bigint"))))

    def numbered(values: Column) -> Column:
        def run(first: Column, stop: Column) -> Column:
            def one(i: Column) -> Column:
                value = F.get(values, i)
                hashed = F.xxhash64(F.shiftrightunsigned(value, _PLACE), i - first)
                return F.shiftleft(hashed, _PLACE).bitwiseOR(value.bitwiseAND(F.lit(_PLACES)))

            return F.transform(F.sequence(first, stop - 1), one)

        runs = lambda s: F.transform(s, lambda first, k: run(first, F.coalesce(F.get(s, k + 1), F.size(values))))
        return F.sort_array(F.flatten(_let(_starts(values, _PLACE), runs)))

    def chosen(values: Column) -> Column:
        def bin_of(value: Column) -> Column:
            return F.shiftrightunsigned(value, bin_shift)

        def one(start: Column) -> Column:
            own = bin_of(F.get(values, start))
            least = F.filter(F.slice(values, start + 1, F.lit(size)), lambda v: bin_of(v) == own)
            by_place = F.sort_array(F.transform(least, lambda v: F.shiftleft(v, 64 - _PLACE).bitwiseOR(F.shiftrightunsigned(v, _PLACE))))
            return F.struct(own.cast("int").alias("bin"), F.xxhash64(F.transform(by_place, lambda v: v.bitwiseAND(F.lit(_HASHES)))).alias("hash"))

        return F.transform(_starts(values, bin_shift), one)

    none = F.array().cast("array<struct<bin: int, hash: bigint>>")
    steps = lambda words: _let(_let(packed(words), numbered), chosen)
    return _let(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), ""), lambda w: F.when(F.size(w) == 0, none).otherwise(steps(w)))


def fingerprint(text: Column, kmer: int = KMER, bins: int = BINS, size: int = TUPLE) -> Column:
    """The signature as text: for every bin four hexadecimal digits of its tuple's hash, or dashes if it is empty."""

    def written(tuples: Column) -> Column:
        def digits(b: Column) -> Column:
            found = F.try_element_at(tuples, b)
            return F.coalesce(F.lpad(F.hex(found.bitwiseAND(F.lit(16**DIGITS - 1))), DIGITS, "0"), F.lit(_EMPTY))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), digits), "")

    return F.lower(_let(F.map_from_entries(selected_tuples(text, kmer, bins, size)), written))


def likeness(a: Column, b: Column, bins: int = BINS, size: int = TUPLE) -> Column:
    """The share of two texts that is common and in order, 0 to 1, as their fingerprints tell it.

    Of the bins that either fingerprint has, the share m that agree estimates the
    share j of common k-mers to the power of the tuple's size; 2j / (1 + j) is then
    the common part's share of the texts. Equal fingerprints give 1.
    """

    def part(x: Column, i: Column) -> Column:
        return F.substr(x, i * DIGITS + 1, F.lit(DIGITS))

    places = F.sequence(F.lit(0), F.lit(bins - 1))
    either = F.size(F.filter(places, lambda i: (part(a, i) != _EMPTY) | (part(b, i) != _EMPTY)))
    both = F.size(F.filter(places, lambda i: (part(a, i) == part(b, i)) & (part(a, i) != _EMPTY)))
    j = F.pow(both / F.greatest(either, F.lit(1)), F.lit(1 / size))
    return F.when(a == b, F.lit(1.0)).otherwise(2 * j / (1 + j))


def following(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id, prev_id, prev_chars, rows, pick) of each id: its neighbours in descending order, as a ring.

    Ids are dealt out by range, so that all but the ends of a range find their
    neighbour next to them; the ends are matched through one row per range.
    ``rows`` counts the rows of the id and ``pick`` is the digest of the text that stands for them.
    """
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n"),
        F.count("*").alias("rows"),
        F.min(F.xxhash64(F.coalesce(F.col("text"), F.lit("")))).alias("pick"),
    )
    ranged = stage(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ids")
    within = Window.partitionBy("part").orderBy(F.desc("doc_id"))
    ends = ranged.groupBy("part").agg(F.max("doc_id").alias("top"), F.min("doc_id").alias("bottom"), F.max_by("n", -F.col("doc_id")).alias("bottom_n"))
    ends = stage(ends, "ends")
    over = Window.orderBy(F.desc("part"))  # one row per range
    whole = ends.agg(F.max("top").alias("first"), F.min("bottom").alias("last"), F.max_by("bottom_n", -F.col("bottom")).alias("last_n"))
    ring = ends.select(
        "part",
        F.coalesce(F.lead("top").over(over), whole.select("first").scalar()).alias("below"),
        F.coalesce(F.lag("bottom").over(over), whole.select("last").scalar()).alias("above"),
        F.coalesce(F.lag("bottom_n").over(over), whole.select("last_n").scalar()).alias("above_n"),
    )
    beside = ranged.select(
        "doc_id", "rows", "pick", "part",
        F.lead("doc_id").over(within).alias("next"), F.lag("doc_id").over(within).alias("prev"), F.lag("n").over(within).alias("prev_n"),
    )
    return beside.join(ring, "part").select(
        "doc_id",
        F.coalesce("next", "below").alias("next_id"),
        F.coalesce("prev", "above").alias("prev_id"),
        F.coalesce("prev_n", "above_n").alias("prev_chars"),
        "rows",
        "pick",
    )


def edited_fingerprints(docs: DataFrame, kmer: int = KMER, bins: int = BINS, size: int = TUPLE) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row of ``docs``.

    The edited text has its last half (rounded down) replaced by as much of the
    next document in descending order of ids; after the last comes the first. A
    null text is empty. Of several rows with the next id the one with the smallest
    digest is it. A row without an id has no next document: its last half is cut
    off and near_next is 0. Repeated rows are each returned; an empty table gives
    an empty one.
    """
    ring = stage(following(docs), "ring")
    filled = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    texts = filled.where("doc_id is not null")
    # what each document gives to the one before it; one exchange of the texts by id serves both sides of the join
    given = texts.join(ring.select(F.col("doc_id").alias("id"), "prev_id", "prev_chars", "pick"), F.col("doc_id") == F.col("id"))
    # a condition on the text would become a key of the join; as a value it leaves the exchange as it is
    head = F.substr("text", F.lit(1), F.floor(F.col("prev_chars") / 2).cast("int"))
    given = given.select("prev_id", F.when(F.xxhash64("text") == F.col("pick"), head).alias("tail"))
    if not ring.where("rows > 1").isEmpty():
        given = given.groupBy("prev_id").agg(F.min("tail").alias("tail"))
    without_id = filled.where("doc_id is null").withColumn("tail", F.lit(""))
    pairs = texts.join(given, F.col("doc_id") == F.col("prev_id"), "left").drop("prev_id").unionByName(without_id)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = pairs.select(
        "doc_id",
        "text",
        n.cast("bigint").alias("n_chars"),
        F.concat(F.substr("text", F.lit(1), n - half), F.substr(F.coalesce("tail", F.lit("")), F.lit(1), half)).alias("edited"),
    )
    prints = edited.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("text"), kmer, bins, size).alias("fingerprint"),
        fingerprint(F.col("edited"), kmer, bins, size).alias("edited_fingerprint"),
        F.xxhash64("text").alias("digest"),
    )
    prints = stage(prints, "fingerprints")
    nexts = ring.select(F.col("doc_id").alias("next_doc"), "prev_id", "pick")
    nexts = prints.join(nexts, (F.col("doc_id") == F.col("next_doc")) & (F.col("digest") == F.col("pick")))
    nexts = nexts.select("prev_id", F.col("fingerprint").alias("next_fingerprint")).distinct()
    return prints.join(nexts, F.col("doc_id") == F.col("prev_id"), "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), bins, size).alias("near_edited"),
        F.coalesce(likeness(F.col("fingerprint"), F.col("next_fingerprint"), bins, size), F.lit(0.0)).alias("near_next"),
    )
