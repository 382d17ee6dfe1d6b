"""Session factory with the settings that the library's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    settings = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
    } | conf
    return SparkSession.builder.master(master).appName("ontoweave").config(map=settings).getOrCreate()
