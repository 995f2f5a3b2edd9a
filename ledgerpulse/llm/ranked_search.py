"""Ranked lexical search by the Best Position Algorithm.

Every text is counted once: the postings of the terms that some query holds are
written to the shared folder, and the statistics of the corpus are sums over
them. Each task then cuts its postings into shards of bounded size. A shard has
one impact list a term, highest impact first. A query reads its lists from the
top in step; a document met for the first time is looked up in the other lists
by direct access, which gives its whole score and marks its place there. The
best position of a list is the end of the places that are marked without a gap
from the top, so it can lie beyond what was read. The impacts at the best
positions bound the score of every document not met yet: reading stops when
their sum is strictly below the k-th score, as a document that ties with it may
still have the smaller id. The k best of each shard are merged by one window
over the queries; k rows a query and shard are all that travels.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerpulse.session import stage

TOP = 10
#: Bytes of query text that are broadcast at a time; more take further passes over the documents.
CHUNK_BYTES = 16_000_000
#: Postings of a shard, which bound the memory of a task.
SHARD_POSTINGS = 2_000_000
#: Places of each list that the first round of reading takes; every further round takes twice as many.
FIRST_READ = 32
#: Constants of the score: impact scale, weight scale, and the saturation 8 * (10 + 90 * n / mean length) / 1000.
SCALE, WEIGHT, DAMP, FLAT, SLOPE = 1_000_000_000, 1000, 8, 10, 90

_POSTINGS = "doc_id bigint, n bigint, terms array<int>, counts array<int>"
_FOUND = "item int, doc_id bigint, score bigint"

# ASCII letters and digits and everything beyond ASCII belong to terms; only A-Z is lower-cased.
_TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, in UTF-8; none of a null text."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split() if text else []


class ImpactLists:
    """The impact lists of one shard: per term its documents, their impacts, and the order of falling impact."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray):
        """``docs`` are numbers of documents; postings may come in any order."""
        by_doc = np.lexsort((docs, terms))
        terms, docs, impacts = terms[by_doc], docs[by_doc], impacts[by_doc]
        self.known, starts = np.unique(terms, return_index=True)
        self.docs = np.split(docs, starts[1:])
        self.impacts = np.split(impacts, starts[1:])
        self.size = int(docs.max()) + 1 if len(docs) else 0
        self.order: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def lists(self, terms: np.ndarray) -> list[int]:
        """The lists of those of the terms that occur in the shard."""
        at = np.searchsorted(self.known, terms)
        inside = at < len(self.known)
        return at[inside][self.known[at[inside]] == terms[inside]].tolist()

    def ranked(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of list ``k``: the entries from the highest impact on, and the place of each entry."""
        if k not in self.order:
            order = np.argsort(-self.impacts[k], kind="stable")
            places = np.empty_like(order)
            places[order] = np.arange(len(order))
            self.order[k] = order, places
        return self.order[k]

    def best(self, terms: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores of the ``top`` best above 0, equal scores by number, and how many documents were looked up."""
        lists = self.lists(terms)
        met = np.zeros(self.size, dtype=bool)
        marked = [np.zeros(len(self.docs[k]), dtype=bool) for k in lists]
        position = [0] * len(lists)  # the best position: places before it are all marked
        docs, scores = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        read, step, looked_up = 0, FIRST_READ, 0
        while True:
            fresh = [self.docs[k][self.ranked(k)[0][read : read + step]] for k in lists]
            new = np.unique(np.concatenate(fresh)) if fresh else docs[:0]
            new = new[~met[new]]
            met[new] = True
            looked_up += len(new)
            total = np.zeros(len(new), dtype=np.int64)
            threshold = 0
            for nr, k in enumerate(lists):
                places = self.ranked(k)[1]
                at = np.searchsorted(self.docs[k], new)  # direct access
                at[at == len(places)] = 0
                hit = self.docs[k][at] == new
                total[hit] += self.impacts[k][at[hit]]
                marked[nr][places[at[hit]]] = True
                rest = marked[nr][position[nr] :]
                position[nr] += len(rest) if rest.all() else int(rest.argmin())
                if position[nr] < len(places):
                    threshold += int(self.impacts[k][self.ranked(k)[0][position[nr] - 1]])
            docs, scores = np.concatenate((docs, new)), np.concatenate((scores, total))
            order = np.lexsort((docs, -scores))[:top]
            docs, scores = docs[order], scores[order]  # what falls out of the best never comes back
            if threshold == 0 or (len(scores) == top and threshold < scores[-1]):
                return docs[scores > 0], scores[scores > 0], looked_up
            read, step = read + step, 2 * step


def _chunks(items: DataFrame, chunk_bytes: int) -> Iterator[list]:
    """The queries with a text in chunks of about ``chunk_bytes``, at least one; a chunk at a time is on the driver."""
    known = items.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null").distinct()
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // chunk_bytes))
    for k in range(n):
        part = known if n == 1 else known.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r.item, sorted(set(terms_of(r.text)))) for r in part.toLocalIterator()]


def _postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """Of each text: the number of its terms, and which of ``terms`` it holds how often."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = {term: nr for nr, term in enumerate(shared.value)}
        for batch in batches:
            lengths, ends, which, counts = [], [0], [], []
            for text in batch.column("text").to_pylist():
                found = terms_of(text)
                lengths.append(len(found))
                held = Counter(filter(numbers.__contains__, found))
                which.extend(map(numbers.__getitem__, held))
                counts.extend(held.values())
                ends.append(len(which))
            ends = pa.array(ends, pa.int32())
            columns = [batch.column("doc_id"), pa.array(lengths, pa.int64())]
            columns += [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (which, counts)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(count, _POSTINGS)


def _best_of_shards(postings: DataFrame, queries: list[list[int]], weights: list[int], n_docs: int, n_terms: int, top: int, shard: int) -> DataFrame:
    """The best documents of every shard for every query."""
    shared = postings.sparkSession.sparkContext.broadcast((queries, weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered = [np.array(terms, dtype=np.int64) for terms in shared.value[0]]
        weight = np.array(shared.value[1], dtype=np.int64)

        def answer(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            part = pa.Table.from_batches(held).combine_chunks()
            part = part.sort_by([("doc_id", "ascending")])  # ids rise with the number of a document, nulls come last
            sizes = part.column("terms").combine_chunks().value_lengths().to_numpy()
            terms = part.column("terms").combine_chunks().flatten().to_numpy()
            counts = part.column("counts").combine_chunks().flatten().to_numpy().astype(np.int64)
            flat = np.array([FLAT + SLOPE * n * n_docs // n_terms for n in part.column("n").to_pylist()], dtype=np.int64)
            docs = np.repeat(np.arange(len(sizes)), sizes)
            impacts = weight[terms] * (SCALE * counts // (1000 * counts + DAMP * flat[docs]))
            counted = impacts > 0
            lists = ImpactLists(terms[counted], docs[counted], impacts[counted])
            found = [lists.best(query, top)[:2] for query in numbered]
            item = np.repeat(np.arange(len(found)), [len(d) for d, _ in found])
            best = np.concatenate([d for d, _ in found])
            columns = [pa.array(item, pa.int32()), part.column("doc_id").combine_chunks().take(pa.array(best)), pa.array(np.concatenate([s for _, s in found]))]
            return pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column("terms").flatten())
            if size >= shard:
                yield answer(held)
                held, size = [], 0
        if held:
            yield answer(held)

    return postings.where(F.size("terms") > 0).mapInArrow(search, _FOUND)


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, chunk_bytes: int = CHUNK_BYTES, shard: int = SHARD_POSTINGS) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` documents of each item; the score is described in ``SCALE`` and the contract.

    A null text has no terms: as a document it counts nowhere, as an item it finds nothing, like an item whose terms no
    document holds. Repeated rows of ``items`` are one item; two texts under one item_id are two items, both ranked under
    it. Repeated documents are documents of their own. Equal scores are ordered by doc_id, a missing one last. Empty
    tables give no rows. Other columns of either table are left alone.
    """
    item_type = items.schema["item_id"].dataType
    results = None
    for chunk, queries in enumerate(_chunks(items, chunk_bytes)):
        terms = sorted(set().union(*(found for _, found in queries)))
        postings = stage(_postings(docs, terms), f"postings{chunk}")
        n_docs, n_terms = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        # one row a term of the chunk, so bounded by it
        held = dict(postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
        weights = [math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * held.get(nr, 0) + 1))) for nr in range(len(terms))]
        numbers = {term: nr for nr, term in enumerate(terms)}
        found = _best_of_shards(postings, [[numbers[t] for t in q] for _, q in queries], weights, n_docs, n_terms, top, shard)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = docs.sparkSession.createDataFrame([(nr, item) for nr, (item, _) in enumerate(queries)], "item int, item_id string")
        best = best.join(names, "item").select(F.col("item_id").cast(item_type).alias("item_id"), "rank", "doc_id", "score")
        results = best if results is None else results.unionByName(best)
    return results
