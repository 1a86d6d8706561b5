"""Makes this package importable for Python workers, wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ensure_importable(spark: SparkSession) -> None:
    """Send the package's source to the workers once, unless their path has it already."""
    sc = spark.sparkContext
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if sc.applicationId in _shipped or _ROOT in paths or sc.master.startswith("local[") and Path.cwd() == _ROOT:
        return
    target = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((_ROOT / "tessera").rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
