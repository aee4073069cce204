import os

from rimward import components
from rimward.storage import dropped, stored, tables_dir


def files(spark):
    top = tables_dir(spark)
    return {name for name in os.listdir(top) if os.path.isdir(os.path.join(top, name))}


def test_a_table_that_is_replaced_is_deleted(spark):
    first = stored(spark.range(5), "first")
    before = files(spark)
    second = stored(first.selectExpr("id + 1 AS id"), "second", replaces=first)
    assert sorted(r["id"] for r in second.collect()) == [1, 2, 3, 4, 5]
    assert len(files(spark)) == len(before)
    dropped(second)
    dropped(second.where("id > 1"))  # no stored table: left alone
    assert len(files(spark)) == len(before) - 1


def test_components_keep_one_table(spark):
    before = files(spark)
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert len(files(spark) - before) == 1
