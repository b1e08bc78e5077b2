"""Machines over chunks of history: what they are given, and how often rows are worked out."""

import pytest

from linewatch.sources import shared
from linewatch.streaming import run

ROWS = [(1, t, [float(t), 0.5]) for t in range(12)]


class Kinds:
    """Emits the type of the numbers in its array, and forgets everything or nothing."""
    columns = ("t_ms", "edges")
    schema = "t_ms long, kind string, seen int"

    def __init__(self, forgets: bool):
        self.forgets = forgets

    def start(self) -> dict:
        return {"seen": 0}

    def step(self, s: dict, t_ms, edges) -> list[tuple]:
        s["seen"] = 0 if self.forgets else s["seen"] + 1
        return [(t_ms, type(edges[0]).__name__, s["seen"])]


@pytest.mark.parametrize("forgets, stored", [(True, ["chunk-runs", "chunk-starts"]), (False, None)])
def test_chunks_run_once_on_plain_numbers(spark, monkeypatch, forgets, stored):
    labels, scratch = [], shared.scratch
    monkeypatch.setattr(shared, "scratch", lambda spark, label: labels.append(label) or scratch(spark, label))
    df = spark.createDataFrame(ROWS, "line_id long, t_ms long, edges array<double>")
    out = run.fold_chained(df, Kinds(forgets), ["line_id"], ["t_ms"], chunk_ms=4)
    assert out.columns == ["line_id", "t_ms", "kind", "seen"]
    got = sorted((r["t_ms"], r["kind"], r["seen"]) for r in out.collect())
    assert got == [(t, "float", 0 if forgets else t + 1) for t in range(12)]
    if stored:  # all settled at once: nothing ran a second time
        assert labels == stored
    else:
        assert labels.count("chunk-runs") == labels.count("chunk-rows") == 1


def test_fold_gives_plain_numbers(spark):
    df = spark.createDataFrame(ROWS, "line_id long, t_ms long, edges array<double>")
    got = run.fold(df, Kinds(False), ["line_id"], ["t_ms"]).collect()
    assert {r["kind"] for r in got} == {"float"} and len(got) == 12
