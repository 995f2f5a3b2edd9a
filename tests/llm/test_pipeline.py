import corpus_pipeline
from pyspark.sql import functions as F

from ledgerpulse.llm import surrogates
from ledgerpulse.llm.queries import QUERIES, table
from test_decontaminate import brute as brute_contamination
from test_packing import brute_pieces, check
from test_simhash import brute_classes, brute_print


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "pii", "best_fit_packing"]


def test_run_against_brute_force(spark, data):
    docs = {r.doc_id: r.text for r in table(spark, data, "documents").collect()}
    good = sorted(r.doc_id for r in QUERIES["op5_quality"](spark, data).where("predicted = 1").collect())
    root = brute_classes([brute_print(docs[i]) for i in good])
    unique = [i for k, i in enumerate(good) if root[k] == k]
    items = [tuple(r) for r in table(spark, data, "benchmark").collect()]
    clean = [i for i in unique if not brute_contamination(docs[i], items)[4]]
    assert len(docs) > len(good) > len(unique) > len(clean) > 50

    rows = corpus_pipeline.run(spark, data).collect()
    assert {r.doc_id for r in rows} == set(clean)
    check(rows)
    plain = [i for i in clean if not surrogates.entities(docs[i])]
    assert len(plain) < len(clean)
    assert sorted((tuple(r)[:5] for r in rows if r.doc_id in set(plain)), key=str) == brute_pieces([(i, docs[i]) for i in plain])


def test_stages_keep_the_columns(spark, data):
    docs = table(spark, data, "documents").limit(40).withColumn("score", F.lit("own column"))
    for name, function in corpus_pipeline.STAGES[:-1]:
        assert function(spark, docs, data).columns == docs.columns, name


def test_stages_take_an_empty_table(spark, data):
    docs = table(spark, data, "documents").limit(0)
    for name, function in corpus_pipeline.STAGES:
        assert function(spark, docs, data).count() == 0, name
