"""Publishing several tables at once (K3, K8, Z8): folders that never change, and versions that name them.

A version is a small JSON file, `version-<number>.json`, written whole under another name and then renamed; the rename fails where the number is
taken, so of two writers one loses and says so. Readers take the greatest number, so they see all tables of a version or none of it. A crash
before the rename leaves folders that no version names. Older versions stay readable until `removed_before` deletes them.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import SparkSession

NAME = re.compile(r"version-(\d{10})\.json$")


class Conflict(RuntimeError):
    """Another writer has published this version."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The published versions, in order."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(int(m.group(1)) for s in fs.listStatus(p) if (m := NAME.search(s.getPath().getName())))


def read(spark: SparkSession, path: str, number: int | None = None) -> tuple[int, dict]:
    """(number, content) of a version, the last one if none is named; (0, {}) where nothing is published."""
    known = numbers(spark, path)
    number = (known[-1] if known else 0) if number is None else number
    if not number:
        return 0, {}
    if number not in known:
        raise FileNotFoundError(f"{path} has no version {number}")
    fs, p = _fs(spark, f"{path}/version-{number:010d}.json")
    stream = fs.open(p)
    try:
        content = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return number, json.loads(content)


def publish(spark: SparkSession, path: str, content: dict, after: int) -> int:
    """Makes content the version that follows `after`; raises Conflict where there is one already."""
    fs, to = _fs(spark, f"{path}/version-{after + 1:010d}.json")
    _, staged = _fs(spark, f"{path}/.staged-{uuid.uuid4().hex}.json")
    stream = fs.create(staged, True)
    try:
        stream.write(json.dumps(content, sort_keys=True).encode())
    finally:
        stream.close()
    if fs.exists(to) or not fs.rename(staged, to):
        fs.delete(staged, False)
        raise Conflict(f"version {after + 1} of {path} is there already")
    return after + 1


def folder(path: str, what: str) -> str:
    """A new folder below path."""
    return f"{path}/{what}-{uuid.uuid4().hex}"


def removed_before(spark: SparkSession, path: str, number: int) -> None:
    """Deletes the versions before a number, and the folders below path that no later version names. Not while another writer is at work."""
    known = numbers(spark, path)
    kept = json.dumps([read(spark, path, n)[1] for n in known if n >= number])
    fs, p = _fs(spark, path)
    for n in known:
        if n < number:
            fs.delete(_fs(spark, f"{path}/version-{n:010d}.json")[1], False)
    for status in fs.listStatus(p):
        if status.isDirectory() and status.getPath().getName() not in kept:
            fs.delete(status.getPath(), True)
