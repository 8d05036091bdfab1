"""Session factory with the settings every query relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "adweave", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session in UTC with ANSI mode and adaptive execution on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
