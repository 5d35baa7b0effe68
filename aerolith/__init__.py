"""A PySpark engine for aerial geolocation and for preparing training data."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: By application the folder of what was shipped; it goes when the driver ends.
_shipped: dict[str, tempfile.TemporaryDirectory] = {}
#: Rows of one Arrow batch, where the session doesn't say: documents are far longer than the rows Spark's 10,000 are meant for.
BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor, once for each application, whatever their working folders; bound Arrow batches."""
    context = spark.sparkContext
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.TemporaryDirectory(prefix="aerolith-", ignore_cleanup_errors=True)
    path = Path(folder.name) / "aerolith_package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("aerolith") / p.relative_to(root))
    context.addPyFile(str(path))
    _shipped[context.applicationId] = folder
