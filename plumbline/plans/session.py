"""Makes the package importable by the Python workers of a session."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from plumbline.plans.staging import shared_folder

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[1]
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*")):
                if p.is_file() and "__pycache__" not in p.parts:
                    z.write(p, p.relative_to(root.parent))
        # in the shared folder, like everything the executors read
        out = f"{shared_folder(spark)}/code-{uuid.uuid4().hex}/{root.name}.zip"
        at = spark._jvm.org.apache.hadoop.fs.Path(out)
        stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
        stream.write(data.getvalue())
        stream.close()
        spark.sparkContext.addPyFile(out)
        _shipped.add(app)
    return spark
