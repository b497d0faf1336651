"""Session settings and table access shared by the whole library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Every table of the driver's data folders.
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def build_session(app: str = "quillon", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, ANSI errors and adaptive execution; ``conf`` wins over these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder (any path that Spark's readers open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Temp views over the folder's tables, for the SQL entry points."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
