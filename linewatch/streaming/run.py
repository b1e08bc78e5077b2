"""Run a machine over a sorted table; ``keyed`` has the streaming form."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from linewatch.operators.scan import CHUNK, DAY_MS, chunked
from linewatch.sources import shared


def frame_of(rows: list[tuple], names: list[str], dtypes: dict[str, str]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=names)
    return df.astype({c: d for c, d in dtypes.items() if c in df.columns})


def _plain(column: pd.Series) -> list:
    """Values of a column for a machine; arrays as lists of plain numbers, with which Python counts several times as fast."""
    return [v.tolist() if isinstance(v, np.ndarray) else v for v in column.tolist()] if column.dtype == object else column.tolist()


_NULLABLE = {"bigint": "Int64", "int": "Int32", "double": "Float64", "boolean": "boolean"}


def nullable_types(schema: str) -> dict[str, str]:
    return {f.name: _NULLABLE[f.dataType.simpleString()] for f in StructType.fromDDL(schema).fields
            if f.dataType.simpleString() in _NULLABLE}


def fold(df: DataFrame, machine, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Batch form: rows of a key in order, state carried from row to row.

    Rows stream through the task; a group is never held in memory. The keys name
    the stretch after which the operator starts afresh (a cycle, or a production
    day of a line), so the longest group is bounded by that stretch.
    """
    keys, order = list(keys), list(order)
    key_types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{key_types}, {machine.schema}"
    names = [f.name for f in StructType.fromDDL(schema).fields]
    dtypes = nullable_types(schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            out = []
            key_rows = zip(*[batch[k].tolist() for k in keys])
            rows = zip(*[_plain(batch[c]) for c in machine.columns])
            for key, row in zip(key_rows, rows):
                if key != current:
                    current, state = key, machine.start()
                out.extend((*key, *r) for r in machine.step(state, *row))
            if out:
                yield frame_of(out, names, dtypes)

    wanted = list(dict.fromkeys([*keys, *order, *machine.columns]))
    return (df.select(*wanted).repartition(*keys).sortWithinPartitions(*keys, *order)
            .mapInPandas(run, schema))


def fold_chained(df: DataFrame, machine, keys: Sequence[str], order: Sequence[str], chunk_ms: int = DAY_MS) -> DataFrame:
    """Batch form over any length of history, with the rows of a key replayed in parallel.

    Histories are cut into time chunks (by the first order column). Every chunk first
    runs from a fresh state, and what it emits is stored beside its end; then those whose chunk before ends otherwise than they
    assumed run again from that state, until none is left. In the end only chunks that did not start afresh emit once more. A machine that comes
    back to the same state (a full reset) settles in few rounds, and a round reads only
    the chunks it runs again; at worst there is a round per chunk, so the result is that of
    one pass whatever the length of a chunk. Between rounds one small row per chunk, its
    state as JSON, is written to the shared folder. The rows themselves are worked out once for the first run and, only if
    a chunk runs again, once more to be stored.
    """
    keys, order = list(keys), list(order)
    chunk_keys = [*keys, CHUNK]
    key_types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    wanted = list(dict.fromkeys([*keys, *order, *machine.columns]))
    base = chunked(df.select(*wanted), order[0], chunk_ms)
    schema = f"{key_types}, {machine.schema}"
    names = [f.name for f in StructType.fromDDL(schema).fields]
    dtypes = nullable_types(schema)

    def dump(state) -> str:
        return json.dumps(state, sort_keys=True, default=lambda o: o.item())  # numpy scalars

    def replay(rows: DataFrame, starts: DataFrame | None = None, emits: bool = True, ends: bool = False) -> DataFrame:
        """``starts`` gives each chunk its first state, as a row sorted before its others; without it chunks start afresh.
        Rows that the machine ``emits``, and per chunk a row with the state in which it ``ends``."""
        started = starts is not None

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            current, state = None, None
            blank = (None,) * (len(names) - len(keys))
            for batch in batches:
                out = []
                key_rows = zip(*[batch[k].tolist() for k in chunk_keys])
                first = batch["_start"].tolist() if started else [None] * len(batch)
                for key, start, row in zip(key_rows, first, zip(*[_plain(batch[c]) for c in machine.columns])):
                    if key != current:
                        if ends and current is not None:
                            out.append((*current[:-1], *blank, current[-1], dump(state)))
                        current, state = key, json.loads(start) if isinstance(start, str) else machine.start()
                    if isinstance(start, str):
                        continue
                    made = machine.step(state, *row)
                    if emits:
                        out.extend((*key[:-1], *r, key[-1], None) for r in made)
                if out:
                    yield frame_of(out, [*names, CHUNK, "end"], {**dtypes, CHUNK: "Int64"})
            if ends and current is not None:
                yield frame_of([(*current[:-1], *blank, current[-1], dump(state))], [*names, CHUNK, "end"], {**dtypes, CHUNK: "Int64"})

        if started:
            rows = rows.withColumn("_start", F.lit(None).cast("string")).unionByName(
                starts.select(*chunk_keys, F.col("start").alias("_start")), allowMissingColumns=True)
        first = [F.col("_start").isNull(), *order] if started else order
        return (rows.repartition(*chunk_keys).sortWithinPartitions(*chunk_keys, *first)
                .mapInPandas(run, f"{schema}, {CHUNK} long, end string"))

    def stored(rows: DataFrame, label: str = "chunk-states") -> DataFrame:
        path = shared.scratch(df.sparkSession, label)
        rows.write.parquet(path)
        return df.sparkSession.read.schema(rows.schema).parquet(path)

    fresh = F.lit(dump(machine.start()))
    first = stored(replay(base, ends=True), "chunk-runs")
    states = first.where("end IS NOT NULL").select(*chunk_keys, "end").withColumn("start", fresh)
    emitted = first.where("end IS NULL")
    before = F.lag("end").over(Window.partitionBy(*keys).orderBy(CHUNK))
    rounds = 0
    while True:
        due = states.withColumn("due", F.coalesce(before, fresh))
        wrong = stored(due.where("due <> start").select(*chunk_keys, F.col("due").alias("start")), "chunk-starts")
        if wrong.isEmpty():
            break
        base = base if rounds else stored(base, "chunk-rows")
        rounds += 1
        again = replay(base.join(wrong.select(*chunk_keys), chunk_keys, "left_semi"), wrong, emits=False, ends=True)
        again = again.join(wrong, chunk_keys).select(*chunk_keys, F.col("end").alias("_end"), F.col("start").alias("_begin"))
        states = stored(states.join(again, chunk_keys, "left").select(
            *chunk_keys, F.coalesce("_end", "end").alias("end"), F.coalesce("_begin", "start").alias("start")))
    if rounds:
        later = states.where(F.col("start") != fresh)
        moved = later.select(*chunk_keys)
        emitted = emitted.join(moved, chunk_keys, "left_anti").select(*emitted.columns).unionByName(
            replay(base.join(moved, chunk_keys, "left_semi"), later))
    return emitted.select(*names)


# --- automata with few states: exact over any history length -----------------

def build_table(step: Callable, start, symbols: Sequence) -> tuple[list, list[list[int]]]:
    """Reachable states and ``table[state][symbol] -> state``."""
    states, table = [start], []
    for s in states:
        row = []
        for sym in symbols:
            nxt = step(s, sym)
            if nxt not in states:
                states.append(nxt)
            row.append(states.index(nxt))
        table.append(row)
    return states, table


def _by_key(batches: Iterator[pd.DataFrame], keys: list[str], columns: list[str]):
    for batch in batches:
        yield zip(zip(*[batch[k].tolist() for k in keys]), *[batch[c].tolist() for c in columns])


def finite_scan(df: DataFrame, table: list[list[int]], symbol: str = "symbol", keys: Sequence[str] = ("line_id",),
                order: Sequence[str] = ("t_ms", "seq"), chunk_ms: int = DAY_MS) -> DataFrame:
    """State numbers before and after each row, exact over the whole history.

    A chunk of rows acts on the small state set as one map (start state to end
    state). Chunks are mapped in parallel, the maps of a line are chained (one
    row per chunk), and the chunks are then replayed from their known start.

    The replay needs each chunk whole in one task. The explicit repartition sees
    to that: adaptive execution may merge its partitions but does not split them,
    not even below a skewed join.
    """
    keys, order = list(keys), list(order)
    n = len(table)
    spread = chunked(df, order[0], chunk_ms).repartition(*keys, CHUNK)
    group, key_sql = [*keys, CHUNK], ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    columns = [np.array([row[c] for row in table]) for c in range(len(table[0]))]

    def to_maps(batches):
        current, ends = None, None
        for rows in _by_key(batches, group, [symbol]):
            out = []
            for key, sym in rows:
                if key != current:
                    if current is not None:
                        out.append((*current, ends))
                    current, ends = key, np.arange(n)
                ends = columns[sym][ends]  # all start states at once
            yield pd.DataFrame(out, columns=[*group, "ends"])
        if current is not None:
            yield pd.DataFrame([(*current, ends)], columns=[*group, "ends"])

    def chain(batches):
        current, at = None, 0
        for rows in _by_key(batches, keys, [CHUNK, "ends"]):
            out = []
            for key, chunk, ends in rows:
                if key != current:
                    current, at = key, 0
                out.append((*key, chunk, at))
                at = int(ends[at])
            yield pd.DataFrame(out, columns=[*keys, CHUNK, "entry"])

    names = [*df.columns, "state_before", "state_after"]

    def replay(batches):
        current, at = None, 0
        for batch in batches:
            before, after = [], []
            for key, sym, entry in zip(zip(*[batch[k].tolist() for k in group]), batch[symbol].tolist(), batch["entry"].tolist()):
                if key != current:
                    current, at = key, entry
                before.append(at)
                at = table[at][sym]
                after.append(at)
            yield batch.assign(state_before=before, state_after=after)[names]

    thin = spread.select(*group, *order, symbol).sortWithinPartitions(*group, *order)
    maps = thin.mapInPandas(to_maps, f"{key_sql}, {CHUNK} long, ends array<int>")
    entries = (maps.repartition(*keys).sortWithinPartitions(*keys, CHUNK)
               .mapInPandas(chain, f"{key_sql}, {CHUNK} long, entry int"))
    out_sql = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return (spread.join(entries, group).sortWithinPartitions(*group, *order)
            .mapInPandas(replay, f"{out_sql}, state_before int, state_after int"))
