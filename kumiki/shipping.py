"""Sending this package's code to Python workers that do not have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Bytes of an Arrow batch, unless the application says otherwise: texts may be long, and several workers share an executor's memory.
_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def ship(spark: SparkSession) -> SparkSession:
    """Add the package as a zip to the application, once, and bound Arrow batches; the session is returned."""
    context = spark.sparkContext
    if not context.getConf().contains(_BATCH[0]):
        spark.conf.set(*_BATCH)
    if context.applicationId not in _SHIPPED:
        here = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="kumiki-code-"), "kumiki_code.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(here):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.join("kumiki", os.path.relpath(path, here)))
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
    return spark
