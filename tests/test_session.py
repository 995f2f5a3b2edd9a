import pandas as pd
from pyspark.sql import functions as F

from ledgerpulse.session import BATCH_ROWS, stage


def test_batch_rows_bound_what_a_worker_gets_at_once(spark):
    together = F.pandas_udf(lambda ids: pd.Series([len(ids)] * len(ids)), "long")
    before = spark.conf.get(BATCH_ROWS)
    rows = stage(spark.range(0, 95, 1, 1).select("id", together("id").alias("n")), "batches", batch_rows=10).collect()
    assert sorted(r.id for r in rows) == list(range(95)) and max(r.n for r in rows) == 10
    assert spark.conf.get(BATCH_ROWS) == before
