"""Ordered scans over long per-line histories.

A window partitioned by ``line_id`` alone puts the whole history of a line in
one task. These scans cut each history into time chunks, run the window inside
``(line, chunk)``, reduce each chunk to one row, run a second window over those
few rows and join the carried value back.

Cost of one scan: one exchange of the rows on ``(line, chunk)``; the reduction
reads only the columns it needs and is partial on the map side, so what it
shuffles is one row per chunk. A scan on top of a scan repeats the lower one for
its reduction, so operators put all they need into one call and the specs below
cover the compound cases (runs, rows since a mark) in a single level.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000
CHUNK = "_chunk"


@dataclass(frozen=True)
class Previous:
    """Value of the row before."""
    value: Column | str


@dataclass(frozen=True)
class Following:
    """Value of the row after."""
    value: Column | str


@dataclass(frozen=True)
class Total:
    """Running sum up to and including the row."""
    value: Column | str


@dataclass(frozen=True)
class LastKnown:
    """Latest non-null value at or before the row."""
    value: Column | str


@dataclass(frozen=True)
class LastBefore:
    """Latest non-null value strictly before the row."""
    value: Column | str


@dataclass(frozen=True)
class Since:
    """Rows since the last row with a true flag (0 on it); counts from the start if none."""
    value: Column | str


@dataclass(frozen=True)
class Run:
    """Struct ``pos, start``: how many rows in a row hold the present value, and
    the order columns of the row that began that run."""
    value: Column | str


@dataclass(frozen=True)
class Rises:
    """How often a boolean has risen so far; the first row of a history is no rise."""
    value: Column | str


@dataclass(frozen=True)
class Highest:
    """Greatest non-null value at or before the row."""
    value: Column | str


@dataclass(frozen=True)
class NextKnown:
    """Earliest non-null value at or after the row."""
    value: Column | str


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def chunked(df: DataFrame, t: str = "t_ms", chunk_ms: int = DAY_MS) -> DataFrame:
    """Add the time chunk that bounds a window partition."""
    return df.withColumn(CHUNK, F.floor(F.col(t) / F.lit(chunk_ms)).cast("long"))


class _Parts:
    """Column expressions of one scan, by stage."""

    def __init__(self) -> None:
        self.prepare: dict[str, Column] = {}    # row level, windows inside the chunk
        self.local: dict[str, Column] = {}      # row level, on top of ``prepare``
        self.reduced: dict[str, Column] = {}    # one row per chunk
        self.carried: list[dict[str, Column]] = [{}, {}, {}]  # windows over the chunks of a line
        self.combined: dict[str, Column] = {}   # row level, after the join
        self.carry_names: list[str] = []


def scan(df: DataFrame, specs: Mapping[str, object], keys: Sequence[str] = ("line_id",),
         order: Sequence[str] = ("t_ms", "seq"), chunk_ms: int = DAY_MS) -> DataFrame:
    """Add one column per entry of ``specs``, exact over the whole history."""
    keys, order = list(keys), list(order)
    base = chunked(df.drop(CHUNK), order[0], chunk_ms)
    parts = _Parts()
    windows = _Windows(keys, order)
    for name, spec in specs.items():
        _plan(parts, windows, name, spec)

    needs_rows = bool(parts.prepare)
    spread = base.repartition(*keys, CHUNK)
    # Compound specs reduce over window results; plain ones reduce the raw rows.
    prepared = spread.withColumns(parts.prepare) if needs_rows else spread
    carry = (prepared if needs_rows else base).groupBy(*keys, CHUNK).agg(*[e.alias(n) for n, e in parts.reduced.items()])
    for stage in parts.carried:
        carry = carry.withColumns(stage) if stage else carry
    carry = carry.select(*keys, CHUNK, *parts.carry_names)
    joined = prepared.withColumns(parts.local).join(carry, [*keys, CHUNK])
    kept = [c for c in df.columns if c not in parts.combined and c != CHUNK]
    return joined.select(*kept, *[e.alias(n) for n, e in parts.combined.items()])


class _Windows:
    def __init__(self, keys: list[str], order: list[str]) -> None:
        self.rank = F.struct(*order)
        self.ahead = Window.partitionBy(*keys, CHUNK).orderBy(*order)
        self.back = Window.partitionBy(*keys, CHUNK).orderBy(*[F.col(c).desc() for c in order])
        self.up = Window.partitionBy(*keys).orderBy(CHUNK)
        self.down = Window.partitionBy(*keys).orderBy(F.col(CHUNK).desc())
        self.running = (Window.unboundedPreceding, Window.currentRow)
        self.before = (Window.unboundedPreceding, -1)


def _plan(parts: _Parts, w: _Windows, name: str, spec) -> None:
    v, loc, red, car = _col(spec.value), f"_l_{name}", f"_r_{name}", f"_c_{name}"
    parts.carry_names.append(car)
    boxed = F.struct(v.alias("v"))
    if isinstance(spec, Total):
        parts.local[loc] = F.sum(v).over(w.ahead.rowsBetween(*w.running))
        parts.reduced[red] = F.sum(v)
        parts.carried[0][car] = F.sum(red).over(w.up.rowsBetween(*w.before))
        parts.combined[name] = F.coalesce(F.col(loc), F.lit(0)) + F.coalesce(F.col(car), F.lit(0))
    elif isinstance(spec, Previous):
        parts.local[loc] = F.lag(boxed).over(w.ahead)
        parts.reduced[red] = F.max_by(boxed, w.rank)
        parts.carried[0][car] = F.lag(red).over(w.up)
        parts.combined[name] = F.coalesce(F.col(loc), F.col(car))["v"]
    elif isinstance(spec, Following):
        parts.local[loc] = F.lead(boxed).over(w.ahead)
        parts.reduced[red] = F.min_by(boxed, w.rank)
        parts.carried[0][car] = F.lag(red).over(w.down)
        parts.combined[name] = F.coalesce(F.col(loc), F.col(car))["v"]
    elif isinstance(spec, (LastKnown, LastBefore)):
        frame = w.running if isinstance(spec, LastKnown) else w.before
        parts.local[loc] = F.last(v, ignorenulls=True).over(w.ahead.rowsBetween(*frame))
        parts.reduced[red] = F.max_by(v, F.when(v.isNotNull(), w.rank))
        parts.carried[0][car] = F.last(red, ignorenulls=True).over(w.up.rowsBetween(*w.before))
        parts.combined[name] = F.coalesce(F.col(loc), F.col(car))
    elif isinstance(spec, Highest):
        parts.local[loc] = F.max(v).over(w.ahead.rowsBetween(*w.running))
        parts.reduced[red] = F.max(v)
        parts.carried[0][car] = F.max(red).over(w.up.rowsBetween(*w.before))
        parts.combined[name] = F.greatest(F.col(loc), F.col(car))
    elif isinstance(spec, NextKnown):
        parts.local[loc] = F.last(v, ignorenulls=True).over(w.back.rowsBetween(*w.running))
        parts.reduced[red] = F.min_by(v, F.when(v.isNotNull(), w.rank))
        parts.carried[0][car] = F.last(red, ignorenulls=True).over(w.down.rowsBetween(*w.before))
        parts.combined[name] = F.coalesce(F.col(loc), F.col(car))
    elif isinstance(spec, Since):
        _plan_since(parts, w, name, v)
    elif isinstance(spec, Rises):
        _plan_rises(parts, w, name, v)
    elif isinstance(spec, Run):
        _plan_run(parts, w, name, v)
    else:
        raise TypeError(f"unknown scan {spec!r}")


def _plan_since(parts: _Parts, w: _Windows, name: str, v: Column) -> None:
    """Row numbers inside the chunk, plus what the chunks before left over."""
    n, at, car = f"_n_{name}", f"_p_{name}", f"_c_{name}"
    parts.prepare[n] = F.row_number().over(w.ahead)
    flagged = F.coalesce(v, F.lit(False))
    parts.prepare[f"_f_{name}"] = flagged
    parts.local[at] = F.last(F.when(F.col(f"_f_{name}"), F.col(n)), ignorenulls=True).over(w.ahead.rowsBetween(*w.running))
    size, last = f"_s_{name}", f"_t_{name}"
    parts.reduced[size] = F.max(n).cast("long")
    parts.reduced[last] = F.max(F.when(F.col(f"_f_{name}"), F.col(n)))
    upto, mark = f"_u_{name}", f"_m_{name}"
    parts.carried[0][upto] = F.coalesce(F.sum(size).over(w.up.rowsBetween(*w.before)), F.lit(0))
    parts.carried[1][mark] = F.when(F.col(last).isNotNull(), F.col(upto) + F.col(last))
    parts.carried[2][car] = F.col(upto) - F.coalesce(
        F.last(mark, ignorenulls=True).over(w.up.rowsBetween(*w.before)), F.lit(0))
    parts.combined[name] = F.when(F.col(at).isNotNull(), F.col(n) - F.col(at)).otherwise(
        F.col(n) + F.col(car)).cast("long")


def _plan_rises(parts: _Parts, w: _Windows, name: str, v: Column) -> None:
    """Rises inside the chunk, plus those before it and one at its own start."""
    val, up, loc, car = f"_v_{name}", f"_f_{name}", f"_l_{name}", f"_c_{name}"
    parts.prepare[val] = v
    parts.prepare[up] = F.when(v & ~F.lag(v).over(w.ahead), 1).otherwise(0)
    parts.local[loc] = F.sum(up).over(w.ahead.rowsBetween(*w.running))
    first, last, count, start = (f"_{x}_{name}" for x in ("a", "z", "s", "t"))
    parts.reduced[first] = F.min_by(val, w.rank)
    parts.reduced[last] = F.max_by(val, w.rank)
    parts.reduced[count] = F.sum(up)
    parts.carried[0][start] = F.when(F.col(first) & ~F.lag(last).over(w.up), 1).otherwise(0)
    parts.carried[1][car] = F.sum(F.col(count) + F.col(start)).over(w.up.rowsBetween(*w.running)) - F.col(count)
    parts.combined[name] = (F.col(loc) + F.col(car)).cast("long")


def _plan_run(parts: _Parts, w: _Windows, name: str, v: Column) -> None:
    """Runs inside the chunk; the first run goes on from the chunk before if the
    value is the same there."""
    n, val, new, at, car = f"_n_{name}", f"_v_{name}", f"_f_{name}", f"_p_{name}", f"_c_{name}"
    parts.prepare[n] = F.row_number().over(w.ahead)
    parts.prepare[val] = v
    parts.prepare[new] = F.coalesce(v != F.lag(v).over(w.ahead), F.lit(False))
    began = F.struct(F.col(n).alias("n"), w.rank.alias("t"))
    parts.local[at] = F.last(F.when(F.col(new), began), ignorenulls=True).over(w.ahead.rowsBetween(*w.running))
    first, last, size, inner, t0 = (f"_{x}_{name}" for x in ("a", "z", "s", "t", "o"))
    parts.reduced[first] = F.min_by(val, w.rank)
    parts.reduced[last] = F.max_by(val, w.rank)
    parts.reduced[size] = F.max(n).cast("long")
    parts.reduced[inner] = F.max(F.when(F.col(new), began))
    parts.reduced[t0] = F.min(w.rank)
    upto, same, mark = f"_u_{name}", f"_e_{name}", f"_m_{name}"
    parts.carried[0][upto] = F.coalesce(F.sum(size).over(w.up.rowsBetween(*w.before)), F.lit(0))
    parts.carried[0][same] = F.coalesce(F.col(first) == F.lag(last).over(w.up), F.lit(False))
    # Where the last run of the chunk began: row number in the history, and its order columns.
    own = F.struct((F.col(upto) + F.col(inner)["n"]).alias("n"), F.col(inner)["t"].alias("t"))
    whole = F.struct((F.col(upto) + 1).alias("n"), F.col(t0).alias("t"))
    parts.carried[1][mark] = F.when(F.col(inner).isNotNull(), own).when(~F.col(same), whole)
    # ... and where the run that enters the chunk began: own first row, or an earlier chunk.
    entering = F.last(mark, ignorenulls=True).over(w.up.rowsBetween(*w.before))
    parts.carried[2][car] = F.struct(
        F.when(F.col(same), F.col(upto) + 1 - entering["n"]).otherwise(F.lit(0)).alias("rows"),
        F.when(F.col(same), entering["t"]).otherwise(F.col(t0)).alias("t"))
    inside = F.col(at).isNotNull()
    parts.combined[name] = F.struct(
        F.when(inside, F.col(n) - F.col(at)["n"] + 1).otherwise(F.col(n) + F.col(car)["rows"]).cast("long").alias("pos"),
        F.when(inside, F.col(at)["t"]).otherwise(F.col(car)["t"]).alias("start"))
