"""Session settings the library is written for; a cluster may override any of them."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Splits the hot partitions of sort-merge joins (a hot url, a hot conversation).
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "talkloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; keyword names use ``__`` for the dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession, root: Path, packages: list[str]) -> None:
    """Give the Python workers these packages, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    archive = Path(tempfile.mkdtemp(prefix="talkloom-code-")) / "code.zip"
    with zipfile.ZipFile(archive, "w") as code:
        for package in packages:
            for source in sorted((root / package).rglob("*.py")):
                code.write(source, source.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)
