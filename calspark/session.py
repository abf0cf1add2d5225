"""Makes the package importable in the Python workers of a session, wherever they run."""

from __future__ import annotations

import logging
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def log_to(folder: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """The package's logger on the driver: to the console and, with a folder, to run.log in it. Called again, it replaces its handlers."""
    log = logging.getLogger("calspark")
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if folder:
        os.makedirs(folder, exist_ok=True)
        handlers.append(logging.FileHandler(os.path.join(folder, "run.log"), mode="w"))
    for h in handlers:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(h)
    log.setLevel(level)
    log.propagate = False
    return log


def ship(spark: SparkSession) -> None:
    """Hands a zip of this package to the executors, once an application.

    Functions of the package are sent to workers by name; workers that start in
    another folder, or on another machine, find them in the zip.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="calspark-"), "calspark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
