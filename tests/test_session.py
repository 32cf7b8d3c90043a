import os

import pytest

from sparktap import session


def folder(t):
    return t.table_path.removeprefix("file://")


def test_tables_are_deleted_when_released(spark):
    before = session.materialise(spark.range(3), "before")
    with session.temporary_tables(spark) as keep:
        gone = session.materialise(spark.range(4), "gone")
        kept = keep(session.materialise(spark.range(5), "kept"))
        early = session.materialise(spark.range(6), "early")
        session.release(early, spark.range(1), None)
        assert not os.path.exists(folder(early)) and gone.count() == 4
    assert not os.path.exists(folder(gone)) and kept.count() == 5 and before.count() == 3
    session.release(before, kept)
    assert not os.path.exists(folder(kept)) and not os.path.exists(folder(before))


def test_no_local_folder_on_a_cluster():
    class Spark:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("S", (), {"master": "local-cluster[3,2,1024]"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Spark)


def test_settings_of_the_caller_stay(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.getAll.get(key)
    spark.conf.set(key, "32m")
    session.ship(spark)
    assert spark.conf.get(key) in ("32m", "33554432b")
    spark.conf.set(key, before) if before else spark.conf.unset(key)
