"""The log: redaction, batches that come again, writers that meet, compaction, days that are pruned."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.sources import versions as V
from tessera.sources.journal import SCHEMA, Journal, accesses, lines

ROW = SCHEMA.replace(", day date", "")


def rows(spark, *items):
    return spark.createDataFrame([(datetime(2024, 1, d), level, "C", f"m{i}", data) if d else (None, level, "C", f"m{i}", data) for i, d, level, data in items], ROW)


def messages(log, *days):
    return sorted(r.message for r in log.read(*days).collect())


def test_batches_come_once_and_secrets_never(spark, tmp_path):
    log = Journal(spark, str(tmp_path / "log"))
    assert log.read().count() == 0
    one = rows(spark, (1, 3, "INFO", {"Password": "p", "user": "u"}), (2, 4, "DEBUG", {"token": "t"}), (3, None, "WARN", None))
    assert log.append(one, "w", 1) and not log.append(one, "w", 1)
    assert log.append(rows(spark, (4, 4, "INFO", {})), "v", 7) and not log.append(one, "v", 6)
    assert messages(Journal(spark, log.path)) == ["m1", "m2", "m3", "m4"]
    data = {r.message: r.data for r in log.read().collect()}
    assert data == {"m1": {"Password": "[REDACTED]", "user": "u"}, "m2": None, "m3": None, "m4": {}}
    assert messages(log, "2024-01-04") == ["m2", "m4"] and messages(log, "2024-01-01", "2024-01-03") == ["m1"]


def test_compaction_keeps_rows_and_what_was_applied(spark, tmp_path):
    log = Journal(spark, str(tmp_path / "log"))
    for b in range(4):
        log.append(rows(spark, (b, 3 + b % 2, "INFO", None)), "w", b)
    log.compact()
    assert len(log._now()[1]["folders"]) == 1 and messages(log) == ["m0", "m1", "m2", "m3"]
    assert not log.append(rows(spark, (9, 3, "INFO", None)), "w", 3) and log.append(rows(spark, (9, 3, "INFO", None)), "w", 4)
    assert messages(log) == ["m0", "m1", "m2", "m3", "m9"]
    assert len([p for p in (tmp_path / "log").iterdir() if p.is_dir()]) == 2


def test_writers_that_meet_both_stay(spark, tmp_path, monkeypatch):
    log = Journal(spark, str(tmp_path / "log"))
    real, met = V.publish, []

    def late(sp, path, content, after):
        if not met:
            met.append(1)
            Journal(spark, path).append(rows(spark, (5, 3, "INFO", None)), "other", 1)
        return real(sp, path, content, after)

    monkeypatch.setattr(V, "publish", late)
    assert log.append(rows(spark, (6, 3, "INFO", None)), "w", 1)
    assert messages(log) == ["m5", "m6"]


def test_a_crash_before_the_version_leaves_nothing(spark, tmp_path, monkeypatch):
    log = Journal(spark, str(tmp_path / "log"))
    log.append(rows(spark, (1, 3, "INFO", None)), "w", 1)
    with monkeypatch.context() as m:
        m.setattr(V, "publish", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            log.append(rows(spark, (2, 3, "INFO", None)), "w", 2)
    assert messages(log) == ["m1"] and log.append(rows(spark, (2, 3, "INFO", None)), "w", 2) and messages(log) == ["m1", "m2"]


def test_days_reach_the_scan_and_lines(spark, tmp_path):
    log = Journal(spark, str(tmp_path / "log"))
    log.append(rows(spark, (1, 3, "INFO", {"a": "b"}), (2, 5, "WARN", {})), "w", 1)
    plan = log.read("2024-01-05")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    got = sorted(r.line for r in log.read().select(lines().alias("line")).collect())
    assert got == ['[2024-01-03T00:00:00.000Z] [INFO] [C] m1 {"a":"b"}', "[2024-01-05T00:00:00.000Z] [WARN] [C] m2"]
    a = accesses(log.read(), F.col("category")).first()
    assert (a.key, a.accesses, a.last_at) == ("C", 2, datetime(2024, 1, 5))
