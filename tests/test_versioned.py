"""Tables changed by key: what each version holds, what a change writes, and failures."""

import pytest
from pyspark.sql import functions as F

from quirelake.sources.versioned import VersionedTable

SCHEMA = "id long, name string, year int"


def rows(table):
    return sorted(tuple(r) for r in table.read().collect())


def test_changes_are_versions(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.createDataFrame([(i, f"n{i}", 1500 + i) for i in range(50)], SCHEMA)
    want = {i: (i, f"n{i}", 1500 + i) for i in range(50)}
    first = VersionedTable.create(df, path, ["id"], 8)
    assert rows(first) == sorted(want.values())
    second = first.put(spark.createDataFrame([(3, "new", None), (99, "more", 1)], SCHEMA))
    now = want | {3: (3, "new", None), 99: (99, "more", 1)}
    assert rows(second) == sorted(now.values()) and rows(VersionedTable(spark, path, 1)) == sorted(want.values())
    changed = [b for b in range(8) if first.folders.get(b) != second.folders.get(b)]
    assert 0 < len(changed) <= 2 and [tuple(r) for r in second.get(99).collect()] == [(99, "more", 1)] and first.get(99).count() == 0
    third = second.remove(spark.createDataFrame([(99,), (4,), (1000,)], "id long"))
    third = third.correct(F.col("name") == "n7", {"year": F.lit(7)})
    del now[99], now[4]
    now[7] = (7, "n7", 7)
    assert rows(VersionedTable(spark, path)) == sorted(now.values()) and third.version == 4  # as after a restart
    with pytest.raises(ValueError):
        third.correct(F.lit(True), {"id": F.lit(1)})
    with pytest.raises(ValueError):
        VersionedTable(spark, path, 9)


def test_a_failed_change_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    table = VersionedTable.create(spark.createDataFrame([(i, "x", i) for i in range(9)], SCHEMA), path, ["id"], 4)
    broken = spark.createDataFrame([(i, "y", 0) for i in range(9)], SCHEMA).withColumn("year", F.expr("case when id = 8 then raise_error('no') else 1 end").cast("int"))
    with pytest.raises(Exception, match="no"):
        table.put(broken)
    assert rows(VersionedTable(spark, path)) == [(i, "x", i) for i in range(9)]
    other = VersionedTable(spark, path).put(spark.createDataFrame([(0, "z", 0)], SCHEMA))
    with pytest.raises(Exception, match="(?i)exist"):  # from the version before
        table.put(spark.createDataFrame([(1, "late", 0)], SCHEMA))
    assert rows(VersionedTable(spark, path)) == rows(other) == [(0, "z", 0), *((i, "x", i) for i in range(1, 9))]


def test_emptied_tables(spark, tmp_path):
    table = VersionedTable.create(spark.createDataFrame([], SCHEMA), str(tmp_path / "t"), ["id"], 4)
    assert rows(table) == [] and table.get(1).count() == 0
    table = table.put(spark.createDataFrame([(1, None, None)], SCHEMA))
    assert rows(table) == [(1, None, None)] and rows(table.remove(spark.createDataFrame([(1,)], "id long"))) == []
