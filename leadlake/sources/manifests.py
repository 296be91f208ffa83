"""Commits of tables: a small JSON file per commit names the data folders that count.

Data goes to fresh folders first; a commit is one atomic rename of its manifest. A crash in between leaves
folders that no manifest names, which no reader sees.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class CommitConflict(RuntimeError):
    """Somebody else published this manifest first."""


def _hadoop(spark: SparkSession, path: str) -> tuple[Any, Any, Any]:
    """(JVM view, path, its file system)."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return jvm, files.makeQualified(target), files


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in ``folder`` in order, hidden ones left out; none where it does not exist."""
    _, target, files = _hadoop(spark, folder)
    if not files.exists(target):
        return []
    return sorted(n for n in (f.getPath().getName() for f in files.listStatus(target)) if not n.startswith((".", "_")))


def load(spark: SparkSession, folder: str, name: str) -> dict[str, Any]:
    jvm, target, files = _hadoop(spark, f"{folder}/{name}")
    stream = files.open(target)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, folder: str, name: str, content: dict[str, Any], replace: bool = False) -> None:
    """Make ``content`` visible as ``folder/name`` at once. Without ``replace`` an existing one is a :class:`CommitConflict`."""
    jvm, aside, files = _hadoop(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    stream = files.create(aside, False)
    try:
        stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    finally:
        stream.close()
    kinds = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
    options = spark.sparkContext._gateway.new_array(kinds, 1)
    options[0] = kinds.OVERWRITE if replace else kinds.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(aside, jvm.org.apache.hadoop.fs.Path(aside.getParent(), name), options)
    except Py4JJavaError as error:
        files.delete(aside, False)
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            raise CommitConflict(f"{folder}/{name}") from None
        raise


def remove(spark: SparkSession, path: str) -> None:
    _, target, files = _hadoop(spark, path)
    files.delete(target, True)
