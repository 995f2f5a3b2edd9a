"""Secret scans: candidate strings, judged by a random forest that learns from labelled findings which are no secrets.

Candidates are long runs of key characters in the words of a text and, whatever
their length and signs, values assigned to the name of a credential. The forest
sees their length, character classes and transitions, how far dictionary words
cover them, the path of the document and the words beside them; what derived
labels rest on (formats, stand-ins, credential words as such) is no input of its
own. Everything is DataFrame functions and Spark's own forest. The dictionary
holds the most frequent words of all documents, a number that is fixed, so it
may be broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerpulse.session import stage

#: Words in the dictionary, and their shortest length.
DICTIONARY = 5000
SHORTEST = 3
LONGEST = 20
#: Neighbouring words of more characters are replaced by a digest.
NEIGHBOUR = 100
#: Labelled findings that the forest is trained on; of more, those with the smallest hashes.
TRAINING_ROWS = 200_000
TREES, DEPTH, HASHED, SEED = 40, 8, 64, 42
THRESHOLD = 0.5

# What a candidate looks like, and words and formats that tell of secrets or of stand-ins for them.
RUN = r"[A-Za-z0-9+/_-][A-Za-z0-9+/_.-]{10,}[A-Za-z0-9+/_-]={0,2}"
CREDENTIAL = r"(?i)(token|secret|passw|pwd|passphrase|api_?-?key|access_?-?key|private_?-?key|auth|credential|bearer)"
#: An assignment to a credential's name within a word, up to its value; a word that assigns to what stands before or in it.
ASSIGNS = CREDENTIAL + r"[A-Za-z0-9_-]{0,40}[\"'`]?\]?(:=|=>|[=:])"
ASSIGNED = r"([=:]|=>)$"
PROVIDER = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,})"
STAND_IN = r"(?i)(example|sample|placeholder|changeme|your_?-?|dummy|xxxx|0000000|1234567|abcdef)"

NUMBERS = (
    "length", "digits", "lowers", "uppers", "signs", "hexadecimal", "distinct", "entropy", "letter_digit", "digit_letter", "lower_upper",
    "upper_lower", "same_class", "coverage", "quoted", "path_depth",
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _whole(text: Column) -> Column:
    """An assigned value without what wraps it: the inside of quotes, else without brackets and closing punctuation."""
    inside = F.regexp_extract(text, "^([\"'`])(.+)\\1", 2)
    return F.when(inside != "", inside).otherwise(F.regexp_replace(F.regexp_replace(text, "^[\"'`(<{\\[]+", ""), "[\"'`,;)>}\\]]+$", ""))


def find_candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """(doc_id, path, place, before, earlier, after, quoted, credential, assigned, nth, value): the nth value in the word at place.

    Words are what white space separates. A run of key characters, dots inside it, counts if it has 12 characters and a
    digit or 20 characters. Of a word that assigns to a credential's name, or follows such an assignment, the whole rest
    counts instead, of any length and signs: the inside of quotes, up to white space. ``before`` is the name that the word
    assigns to, else the word before; a long neighbour is told by its digest. ``credential``: before or earlier is the name of
    one; ``assigned``: the value is assigned to something. A null or empty text and an empty table have none; a missing path column or value is
    empty; repeated rows repeat their candidates.
    """
    credential = lambda c: c.rlike(CREDENTIAL)

    def around(words: Column) -> Column:
        at = lambda i: F.coalesce(F.get(words, i), F.lit(""))
        follows = lambda i: at(i - 1).rlike(ASSIGNED) & (credential(at(i - 1)) | credential(at(i - 2)))
        kept = F.filter(
            F.sequence(F.lit(0), F.size(words) - 1),
            lambda i: (at(i) != "") & (((F.length(at(i)) >= 12) & at(i).rlike(RUN)) | (at(i).rlike("[=:]") & at(i).rlike(ASSIGNS)) | follows(i)),
        )
        return F.transform(
            kept,
            lambda i: F.struct(
                i.alias("place"), at(i).alias("word"), at(i - 1).alias("before"), at(i - 2).alias("earlier"), at(i + 1).alias("after"), follows(i).alias("follows")
            ),
        )

    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    words = _let(F.split(F.coalesce("text", F.lit("")), r"\s+"), around)
    found = docs.select("doc_id", where.alias("path"), F.explode(words).alias("w")).select("doc_id", "path", "w.*")
    # the word up to the value that it assigns to a credential, and that value
    head = F.when(F.col("follows"), F.lit("")).otherwise(_let(F.split("word", ASSIGNS, 2), lambda parts: F.get(parts, 0)))
    mark = F.when(F.col("follows"), F.lit("")).otherwise(F.regexp_extract("word", ASSIGNS, 0))
    named = F.regexp_extract("word", r"([A-Za-z_-]{2,40})[\"']?[=:]", 1)
    found = found.withColumns({"head": head, "mark": mark, "before": F.when(named != "", named).otherwise(F.col("before"))})
    rest = F.when(F.col("follows") | (F.col("mark") != ""), _whole(F.substr("word", F.length("head") + F.length("mark") + 1))).otherwise("")
    runs = F.filter(F.regexp_extract_all("head", F.lit(RUN), F.lit(0)), lambda v: v.rlike("[0-9]") | (F.length(v) >= 20))
    # after "name=" without a value the next word may hold it; a separator between name and value is no value
    values = F.array_compact(F.array_append(runs, F.when(rest.rlike("[^\"'`=:>]"), rest)))
    # what a word tells is settled before its values are split, so that no value carries the whole of a long word
    beside = lambda c: F.when(F.length(c) > NEIGHBOUR, F.md5(F.col(c).cast("binary"))).otherwise(F.col(c)).alias(c)
    settled = found.select(
        "doc_id", "path", "place", beside("before"), beside("earlier"), beside("after"),
        F.col("word").rlike("[\"'`]").alias("quoted"),
        (credential(F.col("before")) | credential(F.col("earlier"))).alias("credential"),
        (F.col("word").rlike("[=:]") | F.col("before").rlike("[=:]$")).alias("assigned"),
        values.alias("values"),
    )
    return settled.select(*[c for c in settled.columns if c != "values"], F.posexplode("values").alias("nth", "value"))


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> DataFrame:
    """The ``size`` most frequent words (a to z, 3 to 20 letters) of all documents; ties by the alphabet."""
    words = docs.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^a-z]+")).alias("entry"))
    counts = words.where(F.length("entry").between(SHORTEST, LONGEST)).groupBy("entry").count()
    return counts.orderBy(F.desc("count"), "entry").limit(size).select("entry")


def _coverage(values: DataFrame, entries: DataFrame) -> DataFrame:
    """(value_md5, covered): how many characters of a value lie inside dictionary words.

    Words lie within runs of letters, so each distinct run is looked at once. The rows per letter hold a digest of the run
    and a part of a word's length, not the run itself: the work is linear in the length of a value.
    """
    # the digest is made below the explode, once per value
    keyed = values.select(F.md5(F.col("value").cast("binary")).alias("value_md5"), F.split(F.lower("value"), "[^a-z]+").alias("runs"))
    runs = keyed.select("value_md5", F.explode("runs").alias("run")).where(F.length("run") >= SHORTEST)
    runs = stage(runs.withColumn("run_md5", F.md5(F.col("run").cast("binary"))), "runs")
    letters = F.split("run", "")

    def windows(chars: Column) -> Column:
        part = lambda i: F.concat_ws("", *[F.get(chars, i + j) for j in range(LONGEST)])
        return F.transform(F.sequence(F.lit(0), F.size(chars) - SHORTEST), part)

    distinct = runs.groupBy("run_md5").agg(F.first("run").alias("run"))
    starts = distinct.select("run_md5", F.posexplode(_let(letters, windows)).alias("at", "window"))
    sizes = F.explode(F.sequence(F.lit(SHORTEST), F.length("window"))).alias("size")
    parts = starts.select("run_md5", "at", "window", sizes).select("run_md5", "at", "size", F.substr("window", F.lit(1), F.col("size")).alias("entry"))
    # the dictionary has a fixed number of short words
    hits = parts.join(F.broadcast(entries), "entry").groupBy("run_md5", "at").agg(F.max("size").alias("size"))
    spans = F.array_sort(F.collect_list(F.struct("at", (F.col("at") + F.col("size")).alias("stop"))))
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop"))
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(s["stop"] - F.greatest(s["at"], a["stop"]), F.lit(0))).alias("n"), F.greatest(a["stop"], s["stop"]).alias("stop")
    )
    covered = hits.groupBy("run_md5").agg(F.aggregate(spans, state, step)["n"].alias("n"))
    return runs.select("value_md5", "run_md5").join(covered, "run_md5").groupBy("value_md5").agg(F.sum("n").alias("covered"))


def with_features(candidates: DataFrame, entries: DataFrame) -> DataFrame:
    """``candidates`` with the columns NUMBERS. Repeated rows stay; an empty table gives an empty one."""
    coverage = stage(_coverage(candidates.select("value").distinct(), entries), "coverage")
    n = F.length("value")
    share = lambda pattern: F.regexp_count("value", F.lit(pattern)) / n

    def spread(letters: Column) -> Column:
        """The entropy, from the lengths of the runs of equal characters in order."""
        total = F.size(letters)
        changes = F.filter(F.sequence(F.lit(0), total - 1), lambda i: (i == 0) | (F.get(letters, i) != F.get(letters, i - 1)))
        count = lambda starts: F.transform(starts, lambda at, k: (F.coalesce(F.get(starts, k + 1), total) - at) / total)
        return F.aggregate(_let(changes, count), F.lit(0.0), lambda a, p: a - p * F.log2(p))

    joined = candidates.withColumn("value_md5", F.md5(F.col("value").cast("binary"))).join(coverage, "value_md5", "left")
    return joined.withColumns(
        {
            "length": n.cast("double"),
            "digits": share("[0-9]"),
            "lowers": share("[a-z]"),
            "uppers": share("[A-Z]"),
            "signs": share("[^A-Za-z0-9]"),
            "hexadecimal": share("[0-9a-fA-F]"),
            "distinct": F.size(F.array_distinct(F.split("value", ""))) / n,
            "entropy": _let(F.sort_array(F.split("value", "")), spread),
            "letter_digit": share("[A-Za-z](?=[0-9])"),
            "digit_letter": share("[0-9](?=[A-Za-z])"),
            "lower_upper": share("[a-z](?=[A-Z])"),
            "upper_lower": share("[A-Z](?=[a-z])"),
            "same_class": share("[a-z](?=[a-z])|[A-Z](?=[A-Z])|[0-9](?=[0-9])"),
            "coverage": F.coalesce("covered", F.lit(0)) / n,
            "quoted": F.col("quoted").cast("double"),
            "path_depth": F.regexp_count("path", F.lit("/")).cast("double"),
        }
    ).drop("value_md5", "covered")


def derived_labels(candidates: DataFrame) -> DataFrame:
    """Labelled findings (doc_id, place, nth, secret) where the text itself tells.

    Secrets: values in a provider's format, or assigned to the name of a credential, unless they are stand-ins. No secrets:
    stand-ins, and values with no credential word before them. What is left over has no label.
    """
    named, assigned = F.col("credential"), F.col("assigned")
    provider, stand_in = F.col("value").rlike(PROVIDER), F.col("value").rlike(STAND_IN)
    label = F.when(stand_in | ~(named | provider), 0).when(provider | (named & assigned), 1)
    return candidates.select("doc_id", "place", "nth", label.alias("secret")).where("secret is not null")


def train(features: DataFrame, labelled: DataFrame, rows: int = TRAINING_ROWS) -> PipelineModel | float:
    """A forest from the labelled findings (doc_id, place, nth, secret); the share of secrets where there are not two classes.

    Of repeated labels of a finding the largest counts.
    """
    labels = labelled.where("secret in (0, 1)").groupBy("doc_id", "place", "nth").agg(F.max("secret").cast("double").alias("secret"))
    known = stage(features.join(labels, ["doc_id", "place", "nth"]).withColumn("order", F.xxhash64("doc_id", "place", "nth")), "labelled")
    count, classes, mean = known.agg(F.count("*"), F.count_distinct("secret"), F.avg("secret")).first()
    if classes < 2:
        return float(mean) if count else 0.5
    if count > rows:
        cut = known.agg(F.percentile_approx("order", rows / count, 10_000)).first()[0]
        known = known.where(F.col("order") <= cut)
    steps = [
        FeatureHasher(inputCols=["before", "after", "path"], outputCol="hashed", numFeatures=HASHED),
        VectorAssembler(inputCols=[*NUMBERS, "hashed"], outputCol="features"),
        RandomForestClassifier(labelCol="secret", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED),
    ]
    return Pipeline(stages=steps).fit(known)


def scan(docs: DataFrame, labelled: DataFrame | None = None, path: str = "source", threshold: float = THRESHOLD, training: Column | None = None) -> DataFrame:
    """Every candidate of ``docs`` with its probability and the decision ``secret``; beside them value and context.

    ``labelled`` holds findings by doc_id, place and nth; without it labels are derived from the text. ``training`` is a
    condition on doc_id that says which of them the forest may see. Without any label the probability is 0.5. Repeated
    rows of a document repeat its findings.
    """
    found = stage(find_candidates(docs, path), "candidates")
    entries = stage(dictionary(docs), "dictionary")
    features = stage(with_features(found, entries), "features")
    labels = derived_labels(found) if labelled is None else labelled
    model = train(features, labels if training is None else labels.where(training))
    if isinstance(model, float):
        judged = features.withColumn("probability", F.lit(model))
    else:
        judged = model.transform(features).withColumn("probability", vector_to_array("probability")[1])
    return judged.select("doc_id", "path", "place", "nth", "value", "before", "after", "probability", (F.col("probability") >= threshold).alias("secret"))
