"""Recipe tables: checks, lookup, edits, layering and calibration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewatch import fixed
from linewatch.functions import geometry as g
from linewatch.sources.tables import FRAME

# Recipe bounds (field, lower, lower is allowed, upper, upper is allowed)
BOUNDS = [
    ("expected_area_px", 0, False, None, False),
    ("expected_width_px", 0, False, None, False),
    ("expected_height_px", 0, False, None, False),
    ("fused_threshold", 1.0, False, None, False),
    ("noise_threshold", 0.0, False, 1.0, False),
    ("single_min_ratio", 0.0, False, 1.0, False),
    ("unknown_max_ratio", 1.0, False, None, False),
    ("belt_adaptive_block", 0, True, None, False),
    ("camera_exposure_us", 10, True, 1_000_000, True),
    ("camera_gain", 0.0, True, 48.0, True),
    ("roi_split_x", 0, False, None, False),
    ("transfer_line_x", 0, False, None, False),
    ("belt_min_solidity", 0.0, True, 1.0, True),
    ("belt_max_aspect_ratio", 1.0, True, None, False),
    ("ref_circularity_mean", 0.0, True, 1.0, True),
    ("ref_circularity_min", 0.0, True, 1.0, True),
    ("ref_solidity_mean", 0.0, True, 1.0, True),
    ("ref_solidity_min", 0.0, True, 1.0, True),
    ("circularity_tolerance", 0.0, False, 1.0, True),
    ("solidity_tolerance", 0.0, False, 1.0, True),
    ("fused_merge_distance_factor", 0.0, False, None, False),
    ("dilation_kernel_size", 0, True, None, False),
    ("transfer_bridge_width_px", 1, True, None, False),
    ("tripwire_half_width_px", 1, True, None, False),
    ("tripwire_occupancy_threshold", 0.0, False, 1.0, False),
    ("tripwire_debounce_frames", 1, True, None, False),
]
CROPS = ("belt_crop", "feed_crop")
CROP_SIDES = ("top", "bottom", "left", "right")
NAME_LENGTH = 64


def _outside(field: Column, low, low_ok, high, high_ok) -> Column:
    bad = (field < F.lit(low)) if low_ok else (field <= F.lit(low))
    if high is not None:
        bad = bad | ((field > F.lit(high)) if high_ok else (field >= F.lit(high)))
    return bad


def violations(df: DataFrame) -> DataFrame:
    """One row per broken rule: ``(name, field)``. Absent fields are defaults."""
    rules = [(f, _outside(F.col(f), *b)) for f, *b in BOUNDS if f in df.columns]
    rules += [(f"{crop}.{side}", F.col(crop)[side] < 0)
              for crop in CROPS if crop in df.columns for side in CROP_SIDES]
    name = F.col("name")
    rules.append(("name.slash", name.rlike(r"[/\\]")))
    rules.append(("name.length", ~F.length(name).between(1, NAME_LENGTH)))
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(f)) for f, bad in rules]))
    return df.select("name", F.explode(broken).alias("field"))


def trimmed(df: DataFrame) -> DataFrame:
    return df.withColumn("name", F.trim("name"))


def with_profile(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """Put its recipe on every row; unknown and missing names get the first recipe in
    name order, as in ``resolve_active``: ``profile_name`` is then its name and
    ``fell_back`` is set. Catalyst broadcasts ``profiles`` while it is below the
    broadcast threshold and falls back to a shuffle join above it."""
    fields = [c for c in profiles.columns if c != "name"]
    known = profiles.select(F.struct("name", *fields).alias("_recipe"), F.col("name").alias("profile_name"))
    first = profiles.agg(F.min_by(F.struct("name", *fields), "name")).scalar()
    out = df.join(known, "profile_name", "left").withColumn("_used", F.coalesce("_recipe", first))
    rest = [c for c in df.columns if c not in ("profile_name", "fell_back", *fields)]
    return out.select(F.col("_used.name").alias("profile_name"), *rest, *[F.col(f"_used.{c}").alias(c) for c in fields],
                      F.col("_recipe").isNull().alias("fell_back"))


def resolve_active(wanted: DataFrame, profiles: DataFrame) -> DataFrame:
    """Unknown names fall back to the first profile in name order."""
    known = profiles.select(F.col("name").alias("profile_name"), F.lit(True).alias("_known"))
    first = profiles.agg(F.min("name")).scalar()
    return (wanted.join(known, "profile_name", "left")
            .withColumns({"active_profile": F.when(F.col("_known"), F.col("profile_name")).otherwise(first),
                          "fell_back": F.col("_known").isNull()})
            .drop("_known"))


def upsert(base: DataFrame, updates: DataFrame, order: str | None = None) -> DataFrame:
    """Updates replace or join the base rows. Of several for one name the last by the
    column ``order`` wins (without one, and on ties, the greatest row); it is no part
    of the result unless the base has it."""
    row = F.struct(*base.columns)
    rank = row if order is None else F.struct(F.col(order).alias("_at"), row.alias("_row"))
    last = updates.groupBy("name").agg(F.max_by(row, rank).alias("_last")).select("_last.*")
    return base.join(last.select("name"), "name", "left_anti").unionByName(last)


def remove(base: DataFrame, names: DataFrame) -> DataFrame:
    """Remove by name; asking for an unknown name is an error."""
    marked = names.select("name").distinct().withColumn("_gone", F.lit(True))
    checked = base.withColumn("_here", F.lit(True)).join(marked, "name", "full_outer")
    ok = F.when(F.col("_here").isNull(), F.raise_error(
        F.concat(F.lit("unknown profile: "), F.col("name"))).cast("boolean")).otherwise(F.lit(True))
    return checked.where(ok & F.col("_gone").isNull()).drop("_here", "_gone")


def rename(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Rename only if the old name exists and the new one is free; of several
    requests for one free name the first old name gets it."""
    taken = base.select(F.col("name").alias("new_name"), F.lit(True).alias("_taken"))
    free = (changes.join(taken, "new_name", "left_anti")
            .join(base.select(F.col("name").alias("old_name")), "old_name", "left_semi")
            .groupBy("new_name").agg(F.min("old_name").alias("name")))
    return (base.join(free, "name", "left")
            .withColumn("name", F.coalesce("new_name", "name")).drop("new_name"))


def overlay_config(base: DataFrame, local: DataFrame) -> DataFrame:
    """Layered settings by ``(name, key)``: a local value wins, everything else stays."""
    b = base.withColumnRenamed("value", "_base")
    o = local.withColumnRenamed("value", "_local")
    return (b.join(o, ["name", "key"], "full_outer")
            .select("name", "key", F.coalesce("_local", "_base").alias("value"),
                    F.col("_local").isNotNull().alias("overridden")))


def learn_reference(df: DataFrame, keys: list[str], min_samples: int = 3) -> DataFrame:
    """Reference geometry from single pieces. Too few samples come out as an error row.

    Medians are exact. The input is read once: sizes are counted per value, partially
    before the shuffle, with the shape sums of their pieces beside them, so a hot key is
    reduced to its distinct sizes before anything is sorted. Means are sums of decimals (12 places), so they are
    exact in any order and halves round up; a shape that is no finite number is not counted in its mean.
    """
    sizes, shapes = ("width_px", "height_px", "area_px"), ("circularity", "solidity")
    known = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("long").alias("value")) for c in sizes])
    none = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("long").alias("value")))
    each = df.select(*keys, *shapes, F.explode(F.when(F.col("label") == fixed.SINGLE, known).otherwise(none)).alias("m"))
    exact = {c: F.col(c).try_cast("decimal(24, 12)") for c in shapes}
    sums = [m for c in shapes for m in (F.sum(exact[c]).alias(f"_{c}_sum"), F.count(exact[c]).alias(f"_{c}_n"), F.min(c).alias(f"_{c}_min"))]
    counts = (each.groupBy(*keys, "m.field", "m.value").agg(F.count(F.lit(1)).alias("_rows"), *sums)
              .withColumn("_n", F.when(F.col("value").isNotNull(), F.col("_rows")).otherwise(0)))
    first = F.col("field") == sizes[0]  # every single is counted once under each field

    def of(how: Callable[[Column], Column], name: str) -> Column:
        return how(F.when(first, F.col(name)))

    means = [c for s in shapes for c in (
        F.round(F.try_divide(of(F.sum, f"_{s}_sum"), of(F.sum, f"_{s}_n")), 4).cast("double").alias(f"ref_{s}_mean"),
        F.round(of(F.min, f"_{s}_min"), 4).alias(f"ref_{s}_min"))]
    out = _placed(counts, [*keys, "field"], "value").groupBy(*keys).agg(
        F.coalesce(of(F.sum, "_rows"), F.lit(0).cast("long")).alias("samples"), *means,
        *[_middle("value", F.col("field") == c).alias(c) for c in sizes])
    enough = F.col("samples") >= min_samples
    learned = {f"expected_{c}": F.when(enough, F.bround(F.col(c)).cast("long")) for c in sizes}
    shapes = {c: F.when(enough, F.col(c)) for c in (
        "ref_circularity_mean", "ref_circularity_min", "ref_solidity_mean", "ref_solidity_min")}
    return (out.withColumns({**learned, **shapes})
            .withColumn("error", F.when(~enough, F.concat(
                F.lit("nothing learnt: "), F.col("samples").cast("string"), F.lit(f" of {min_samples} singles"))))
            .drop(*sizes))


def exact_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact median from counts per distinct value.

    ``F.median`` buffers each group whole; counting first is partial on the map
    side, and the cumulative window then runs over distinct values only.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return _placed(counts, keys, value).groupBy(*keys).agg(_middle(value).alias("median"))


def _placed(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counted values with the number of rows up to them and in all."""
    up = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumns({"_upto": F.sum("_n").over(up), "_all": F.sum("_n").over(Window.partitionBy(*keys))})


def _middle(value: str, where: Column | None = None) -> Column:
    """Aggregate of placed values: the median of those for which ``where`` holds."""
    def at(rank: Column) -> Column:
        holds = (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank)
        return F.max(F.when(holds if where is None else holds & where, F.col(value)))

    return (at(F.floor((F.col("_all") + 1) / 2)) + at(F.floor((F.col("_all") + 2) / 2))) / 2.0


# --- calibration -----------------------------------------------------------

def calibrate(base: DataFrame, detections: DataFrame, keys: list[str], name: Column) -> DataFrame:
    """Put learned sizes and shape limits into the recipe ``name``, which keeps all its
    other columns; a new recipe takes those from the first one in name order."""
    learned = learn_reference(detections, keys).where(F.col("error").isNull())
    sizes = ["expected_width_px", "expected_height_px", "expected_area_px"]
    shapes = ["ref_circularity_mean", "ref_circularity_min", "ref_solidity_mean", "ref_solidity_min"]
    updates = learned.select(name.alias("name"), F.struct(
        *[F.col(f).cast("int").alias(f) for f in sizes], *shapes).alias("_new"))
    old = F.struct(*[c for c in base.columns if c != "name"])
    first = base.agg(F.min_by(old, "name")).scalar()
    joined = (base.select("name", old.alias("_old")).join(updates, "name", "full_outer")
              .withColumn("_kept", F.coalesce("_old", first)))
    kept = [F.coalesce(F.col(f"_new.{c}"), F.col(f"_old.{c}")).alias(c) if c in sizes + shapes else F.col(f"_kept.{c}").alias(c)
            for c in base.columns if c != "name"]
    return joined.select("name", *kept, *[F.col(f"_new.{c}").alias(c) for c in sizes + shapes if c not in base.columns])


def calibration_events(learned: DataFrame, name: Column) -> DataFrame:
    extra = F.to_json(F.struct(
        F.col("samples"), F.col("expected_width_px").alias("width_px"),
        F.col("expected_height_px").alias("height_px"), F.col("expected_area_px").alias("area_px"),
        F.col("ref_circularity_mean").alias("circularity_mean"),
        F.col("ref_circularity_min").alias("circularity_min"),
        F.col("ref_solidity_mean").alias("solidity_mean"), F.col("ref_solidity_min").alias("solidity_min")))
    return (learned.where(F.col("error").isNull())
            .select(F.lit("calibration_done").alias("event_type"), name.alias("profile_name"),
                    extra.alias("extra_json")))


def default_bands(df: DataFrame, keys: list[str], height: Column, n: int) -> DataFrame:
    """``n`` equal bands per row of ``df``; height and n are at least 1."""
    n = max(1, n)
    step = F.greatest(height.cast("double"), F.lit(1.0)) / n
    return (df.select(*keys, step.alias("_step"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("col"))
            .select(*keys, "col", (F.col("col") * F.col("_step")).alias("y_min"),
                    ((F.col("col") + 1) * F.col("_step")).alias("y_max")))


def bands_from_centres(df: DataFrame, keys: list[str], y: str, height: Column, n: int) -> DataFrame:
    """Borders halfway between sorted centres; a wrong count gives no bands."""
    order = Window.partitionBy(*keys).orderBy(y)
    whole = Window.partitionBy(*keys)
    return (df.withColumns({"_n": F.count(F.lit(1)).over(whole),
                            "col": F.row_number().over(order) - 1,
                            "_prev": F.lag(y).over(order), "_next": F.lead(y).over(order)})
            .where(F.col("_n") == n)
            .select(*keys, "col",
                    F.coalesce((F.col("_prev") + F.col(y)) / 2.0, F.lit(0.0)).alias("y_min"),
                    F.coalesce((F.col(y) + F.col("_next")) / 2.0, height.cast("double")).alias("y_max")))


def label_pieces(df: DataFrame, p) -> DataFrame:
    return df.withColumn("label", g.classify(F.col("width_px"), F.col("height_px"), p))


__all__ = ["FRAME", "violations", "trimmed", "with_profile", "resolve_active", "upsert", "remove",
           "rename", "overlay_config", "learn_reference", "exact_median", "calibrate",
           "calibration_events", "default_bands", "bands_from_centres", "label_pieces"]
