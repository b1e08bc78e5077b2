"""Tables between steps give their disk back."""

import os

from linewatch.llm import common


def test_emptied_tables_give_back_their_disk(spark):
    kept = common.stored(spark.range(1000).selectExpr("id", "repeat('x', 20) AS x"), "kept")
    gone = common.stored(kept.where("id < 900"), "gone")
    last = common.stored(gone.groupBy().count(), "last")
    folder = gone.inputFiles()[0].rsplit("/", 1)[0]
    common.emptied(gone)
    assert spark.read.parquet(folder).count() == 0
    assert sum(os.path.getsize(os.path.join(folder.removeprefix("file://"), f)) for f in os.listdir(folder.removeprefix("file://"))) < 2000
    assert kept.count() == 1000 and last.first()[0] == 900


def test_emptied_takes_tables_without_rows(spark):
    none = common.stored(spark.range(0), "none")
    folders = {f.rsplit("/", 1)[0] for f in none.inputFiles()}
    common.emptied(none, none)
    assert all(spark.read.schema("id long").parquet(f).count() == 0 for f in folders)
