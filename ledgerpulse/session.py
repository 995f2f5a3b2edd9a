"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}

# Spark deletes the shuffle files of a query when it ends, not only when the driver collects garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Rows that a Python worker gets at once.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def build_session(app_name: str = "ledgerpulse", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; ``conf`` wins over them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the shared ``spark.checkpoint.dir``, which every executor must see.

    All folders of an application lie in one, which Hadoop deletes when the application ends.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    own = f"{shared.rstrip('/')}/ledgerpulse-{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{own}/{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage: a table that several jobs read is computed once, and a
    lost executor costs a re-read of parquet files instead of a re-computation.
    The shuffle files of the job are deleted when it is done, as nothing reads
    them again. ``batch_rows`` are sent to a Python worker at once, for whole
    texts, of which Spark's default number takes much memory on both sides.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}"
    wanted = {FREE_SHUFFLES: "true"} | ({BATCH_ROWS: str(batch_rows)} if batch_rows else {})
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)
