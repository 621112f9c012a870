"""Tables that several writers add to a folder: each claims a number that no one else gets, and appears at once."""

from __future__ import annotations

import threading

from pyspark.sql import SparkSession

#: A claim this old without a table is from a writer that broke off.
ABANDONED_MS = 10 * 60 * 1000
#: For writers of one process, on file systems whose exclusive creation is a look and a creation.
_LOCK = threading.Lock()


def _system(spark: SparkSession, path: str):
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def claim(spark: SparkSession, path: str, kind: str, least: int) -> int:
    """The first number from ``least`` on that no writer has claimed for ``kind``. It is ours from now on."""
    number = least
    while not try_claim(spark, path, f"{kind}{number}"):
        number += 1
    return number


def try_claim(spark: SparkSession, path: str, name: str) -> bool:
    system, at = _system(spark, path)
    with _LOCK:
        try:
            return system.createNewFile(at(f"{path}/claims/{name}"))
        except Exception:
            if system.exists(at(f"{path}/claims/{name}")):
                return False
            raise


def claims(spark: SparkSession, path: str, kind: str) -> dict[int, int]:
    """Number of each claim and when it was made, in milliseconds."""
    system, at = _system(spark, path)
    root = at(f"{path}/claims")
    found = [(s.getPath().getName(), s.getModificationTime()) for s in system.listStatus(root)] if system.exists(root) else []
    return {int(n[len(kind) :]): t for n, t in found if n.startswith(kind) and n[len(kind) :].isdigit()}


def listed(spark: SparkSession, path: str, mark: str | None = None) -> list[str]:
    """Names in a folder; with ``mark``, those that have this file in them."""
    system, at = _system(spark, path)
    if not system.exists(at(path)):
        return []
    names = [s.getPath().getName() for s in system.listStatus(at(path))]
    return [n for n in names if mark is None or system.exists(at(f"{path}/{n}/{mark}"))]


def move(spark: SparkSession, source: str, target: str) -> None:
    system, at = _system(spark, source)
    if system.exists(at(target)) or not system.rename(at(source), at(target)):
        raise OSError(f"{source} can't become {target}")
