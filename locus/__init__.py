"""locus: a PySpark-native analytics engine for coordinate-partitioned data."""

from __future__ import annotations

__version__ = "0.1.0"


def ship(spark) -> None:
    """Sends this package to the session's executors, whose Python workers import it; not needed where it is installed, or on PYTHONPATH, on every machine."""
    import os
    import shutil
    import tempfile

    here = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="locus-ship-"), "locus"), "zip", os.path.dirname(here), "locus")
    spark.sparkContext.addPyFile(archive)
