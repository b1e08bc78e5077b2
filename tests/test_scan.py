"""Chunked scans give what one unbounded window gives, whatever the chunk size."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from linewatch.operators import signals as sg
from linewatch.operators.scan import (Following, LastBefore, LastKnown, NextKnown, Previous, Rises, Run,
                                      Since, Total, scan)


@pytest.fixture(scope="module")
def history(spark):
    """One line holds most of the rows; runs and silences are longer than a chunk."""
    rnd = random.Random(7)
    rows, seq = [], 0
    for line, n in ((1, 400), (2, 40), (3, 1)):
        t, v = 0, False
        for _ in range(n):
            t += rnd.choice([0, 1, 5, 90, 700])
            v = v if rnd.random() < 0.85 else not v
            rows.append((line, t, seq, v, rnd.choice([None, None, rnd.randint(0, 9)])))
            seq += 1
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "line_id long, t_ms long, seq long, on boolean, x int").cache()


@pytest.mark.parametrize("chunk_ms", [1, 50, 1000, 10**9])
def test_same_as_one_window(history, chunk_ms):
    specs = {"prev": Previous("on"), "next": Following("x"), "total": Total(F.coalesce("x", F.lit(0)).cast("long")),
             "last": LastKnown("x"), "before": LastBefore("x"), "ahead": NextKnown("x"),
             "since": Since("on"), "run": Run("on"), "rises": Rises("on")}
    got = scan(history, specs, chunk_ms=chunk_ms).withColumns(
        {"pos": F.col("run.pos"), "start": F.col("run.start.seq")}).drop("run")
    w = Window.partitionBy("line_id").orderBy("t_ms", "seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rest = w.rowsBetween(0, Window.unboundedFollowing)
    plain = history.withColumns({
        "prev": F.lag("on").over(w), "next": F.lead("x").over(w),
        "total": F.sum(F.coalesce("x", F.lit(0)).cast("long")).over(upto),
        "last": F.last("x", True).over(upto), "before": F.last("x", True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "ahead": F.first("x", True).over(rest), "_n": F.row_number().over(w)})
    plain = plain.withColumn("since", (F.col("_n") - F.coalesce(F.last(F.when(F.col("on"), F.col("_n")), True).over(upto), F.lit(0))).cast("long"))
    plain = plain.withColumn("_new", F.when(F.col("prev").isNull() | (F.col("prev") != F.col("on")), F.struct("_n", "seq")))
    plain = plain.withColumn("_from", F.last("_new", True).over(upto)).withColumns(
        {"pos": (F.col("_n") - F.col("_from._n") + 1).cast("long"), "start": F.col("_from.seq")})
    plain = plain.withColumn("rises", F.coalesce(F.count_if(F.col("on") & ~F.col("prev")).over(upto), F.lit(0)))
    columns = ["rises", "line_id", "seq", "prev", "next", "total", "last", "before", "ahead", "since", "pos", "start"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, plain.select(columns).collect()))


def naive_latch(rows, n, m):
    out, state = [], {}
    for r in sorted(rows, key=lambda r: (r["line_id"], r["t_ms"], r["seq"])):
        armed, count = state.get(r["line_id"], (True, 0))
        count = count + 1 if r["on"] == armed else 0
        if count >= (n if armed else m):
            if armed:
                out.append((r["line_id"], r["seq"]))
            armed, count = not armed, 0
        state[r["line_id"]] = (armed, count)
    return sorted(out)


@pytest.mark.parametrize("n,m", [(1, 1), (2, 3), (3, 2)])
def test_latch_over_chunks(history, n, m):
    small = history.withColumn("t_ms", F.col("t_ms") * 1_000_000)  # many day chunks
    got = sorted((r["line_id"], r["seq"]) for r in sg.latch(small, F.col("on"), n, m).collect())
    assert got == naive_latch(history.collect(), n, m)


def test_invariant_to_partitioning(history):
    one = sg.debounce(history.coalesce(1), F.col("on"), 3)
    many = sg.debounce(history.repartition(13), F.col("on"), 3)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_gap_exactly_at_limit_is_no_gap(spark):
    rows = [(1, t, i, r) for i, (t, r) in enumerate([(0, True), (150, True), (301, True), (900, False), (2000, True), (2100, True)])]
    df = spark.createDataFrame(rows, "line_id long, t_ms long, seq long, running boolean")
    assert [(r["t_ms"], r["gap_ms"]) for r in sg.frame_gaps(df).collect()] == [(301, 151)]


def test_empty_input(spark):
    df = spark.createDataFrame([], "line_id long, t_ms long, seq long, running boolean")
    assert sg.edges(df).count() == 0


def test_replay_survives_adaptive_skew_handling(spark):
    """One chunk holds nearly all rows, joins are shuffled, and skew splitting is provoked."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
                "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    rnd = random.Random(2)
    rows = [(1 if i % 50 else i, i, i, rnd.random() < 0.5) for i in range(40_000)]
    df = spark.createDataFrame(rows, "line_id long, t_ms long, seq long, on boolean").repartition(20)
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = sorted((r["line_id"], r["seq"]) for r in sg.latch(df, F.col("on"), 3, 3).collect())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    as_rows = [{"line_id": a, "t_ms": b, "seq": c, "on": o} for a, b, c, o in rows]
    assert got == naive_latch(as_rows, 3, 3)
