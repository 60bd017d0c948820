"""Session settings that the engine relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Set on a running session; what only a new session can take is left to whoever builds it.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timeType.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.cteRecursionLevelLimit": "1000",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build(app: str = "pelorus", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return configure(builder.config(map=conf).getOrCreate())


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that ``spark.checkpoint.dir`` names; a
    local session without the setting, as in tests, gets a temporary one."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(where or tempfile.mkdtemp(prefix="pelorus-"))
    return df.checkpoint()
