"""The store of versions and the log: failed writes, two writers, repeated updates."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyworks.operators import ledger
from tallyworks.sources import documents, store

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture()
def kept(spark, tmp_path):
    return store.Store(spark, str(tmp_path / "s"), SCHEMA)


def of(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def test_versions(spark, kept):
    assert kept.version() == 0 and rows(kept.read()) == []
    assert kept.publish(of(spark, (1, "a")), 0) == 1
    assert kept.publish(of(spark, (1, "b"), (2, "c")), 1) == 2
    assert rows(kept.read()) == [(1, "b"), (2, "c")] and rows(kept.read(1)) == [(1, "a")]
    kept.publish(of(spark), 2)
    assert kept.version() == 3 and rows(kept.read()) == []
    kept.prune(keep=2)
    assert rows(kept.read(2)) == [(1, "b"), (2, "c")] and kept.version() == 3
    with pytest.raises(KeyError):
        kept.read(1)


def test_a_write_that_fails_half_way_changes_nothing(spark, kept, monkeypatch):
    kept.publish(of(spark, (1, "a")), 0)
    broken = spark.range(100).select("id", F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise("x").alias("name"))
    with pytest.raises(Exception, match="lost"):
        kept.publish(broken, 1)
    assert kept.version() == 1 and rows(kept.read()) == [(1, "a")]
    monkeypatch.setattr(kept, "_publish", lambda *a, **k: (_ for _ in ()).throw(OSError("no marker")))
    with pytest.raises(OSError, match="no marker"):
        kept.publish(of(spark, (2, "b")), 1)
    monkeypatch.undo()
    assert rows(kept.read()) == [(1, "a")]
    kept.publish(of(spark, (3, "c")), 1)
    assert rows(kept.read()) == [(3, "c")]


def test_of_two_writers_the_second_is_told(spark, kept):
    other = store.Store(spark, kept.path, SCHEMA)
    seen = kept.version()
    kept.publish(of(spark, (1, "a")), seen)
    with pytest.raises(store.Conflict):
        other.publish(of(spark, (1, "z")), seen)
    with pytest.raises(store.Conflict):  # both had looked before either published
        other._publish(seen + 1, other._written(of(spark, (1, "z"))))
    assert rows(other.read()) == [(1, "a")]


def test_updates_start_over_after_a_conflict(spark, kept):
    kept.publish(of(spark, (1, "a")), 0)
    other, tried = store.Store(spark, kept.path, SCHEMA), []

    def change(df):
        if not tried:  # someone publishes between the read and the write
            other.publish(of(spark, (1, "a"), (5, "other")), 1)
        tried.append(1)
        return df.unionByName(of(spark, (9, "mine")))

    assert rows(kept.update(change)) == [(1, "a"), (5, "other"), (9, "mine")] and len(tried) == 2 and kept.version() == 3


def test_candidates_are_upserted_into_the_store(spark, kept):
    updates = spark.createDataFrame([(1, "b", True, 1), (1, "c", True, 2), (2, "d", True, 1)], "id long, name string, has_name boolean, at int")
    kept.publish(of(spark, (1, "a"), (3, "e")), 0)
    assert rows(kept.update(lambda df: ledger.upserted(df, updates, "id", ["name"], order=[F.col("at")]))) == [(1, "c"), (2, "d"), (3, "e")]


def test_saved_entries_survive_a_failed_save(spark, tmp_path):
    path = str(tmp_path / "e")
    assert rows(documents.save_entries(of(spark, (1, "a")), path)) == [(1, "a")]
    broken = of(spark, (1, "a")).withColumn("name", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        documents.save_entries(broken, path)
    assert rows(store.Store(spark, path, SCHEMA).read()) == [(1, "a")]
    assert rows(documents.save_entries(of(spark, (2, "b")), path)) == [(2, "b")]


REPORT = T.StructType([T.StructField("id", T.LongType()), *documents.REPORT.fields])


def test_reports_are_a_log(spark, tmp_path):
    log = store.Log(spark, str(tmp_path / "log"), REPORT)
    assert log.read().count() == 0
    first = spark.range(50_000).select(F.lit(1).cast("long").alias("id"), F.format_string("t%06d", "id").alias("at"), F.format_string("x%d", "id").alias("text"), F.lit("").alias("note"))
    assert log.append(first) == 1
    assert log.append(spark.createDataFrame([(2, "t1", "y", ""), (1, "t000001", "late", "")], REPORT)) == 2
    records = spark.createDataFrame([(1, None), (2, "before"), (3, "kept")], "id long, latest string")
    now = lambda: rows(ledger.latest(records, log.read(), "id").select("id", "latest", "n_reports"))
    want = [(1, "x49999", 50_001), (2, "y", 1), (3, "kept", 0)]
    assert now() == want
    plan = ledger.latest(records, log.read(), "id")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    log.compact()
    assert now() == want and len(log._live()) == 1
    log.append(spark.createDataFrame([(3, "t", "z", "")], REPORT))
    assert (3, "z", 1) in now()


def test_a_failed_append_or_compaction_changes_nothing(spark, tmp_path, monkeypatch):
    log = store.Log(spark, str(tmp_path / "log"), SCHEMA)
    log.append(of(spark, (1, "a")))
    log.append(of(spark, (2, "b")))
    with pytest.raises(Exception, match="lost"):
        log.append(of(spark, (3, "c")).withColumn("name", F.raise_error(F.lit("lost")).cast("string")))
    monkeypatch.setattr(log, "_publish", lambda *a, **k: (_ for _ in ()).throw(OSError("no marker")))
    with pytest.raises(OSError):
        log.compact()
    monkeypatch.undo()
    assert rows(log.read()) == [(1, "a"), (2, "b")]
