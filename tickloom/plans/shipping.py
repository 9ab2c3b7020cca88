"""Making the package known to Python workers that would not find it by themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers of a session, once, unless PYTHONPATH or the working directory lead to it."""
    context = spark.sparkContext
    known = [Path(p).resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p]
    if ROOT in known or getattr(context, "_tickloom_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="tickloom-")) / "tickloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted((ROOT / "tickloom").rglob("*.py")):
            z.write(path, path.relative_to(ROOT))
    context.addPyFile(str(archive))
    context._tickloom_shipped = True
