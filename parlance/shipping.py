"""Gets the package to Python workers that do not share the driver's import path."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.abspath(__file__))


@functools.cache
def archive() -> str:
    """The package's modules as one archive on the driver; Spark's own file service hands it on."""
    path = os.path.join(tempfile.mkdtemp(prefix="parlance-"), "parlance.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(_ROOT):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(_ROOT)))
    return path


def ship(spark: SparkSession) -> None:
    """Let the workers of ``spark`` import the package; done once per application."""
    context = spark.sparkContext
    if getattr(context, "_parlance_shipped", None) != context.applicationId:
        context.addPyFile(archive())
        context._parlance_shipped = context.applicationId


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query`` that first ships the package."""

    @functools.wraps(query)
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return call
