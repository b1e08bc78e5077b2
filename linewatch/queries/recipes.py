"""Recipe tables, configuration layers and calibration."""

from pyspark.sql import functions as F

from linewatch.functions.recipe import recipe
from linewatch.operators import profiles as pr
from linewatch.queries import query
from linewatch.queries.sql import label, label_from_profile, with_views
from linewatch.sources import tables as t

_RULES = [("expected_width_px", "expected_width_px <= 0"), ("expected_height_px", "expected_height_px <= 0"),
          ("expected_area_px", "expected_area_px <= 0"), ("fused_threshold", "fused_threshold <= 1.0"),
          ("noise_threshold", "noise_threshold <= 0 OR noise_threshold >= 1"),
          ("single_min_ratio", "single_min_ratio <= 0 OR single_min_ratio >= 1"),
          ("unknown_max_ratio", "unknown_max_ratio <= 1.0"), ("roi_split_x", "roi_split_x <= 0"),
          ("camera_gain", "camera_gain < 0 OR camera_gain > 48"),
          ("belt_crop.top", "crop_top < 0"), ("belt_crop.left", "crop_left < 0"),
          ("name.slash", r"name LIKE '%/%' OR name LIKE '%\%'"), ("name.length", "LENGTH(name) NOT BETWEEN 1 AND 64")]


@query("p22_validate_profiles", with_views("recipes", body=" UNION ALL ".join(
    f"SELECT name, '{f}' AS field FROM recipes WHERE {c}" for f, c in _RULES)))
def p22(spark, d):
    return pr.violations(t.recipes(spark, d))


#: Recipe name of a row as SQL; the second form asks for names that do not exist.
ASKED = "CONCAT('P', CAST(line_id % 7 AS VARCHAR))"
ASKED_UNKNOWN = "CONCAT('P', CAST(line_id + 3 AS VARCHAR))"


def join_recipe(asked: str) -> str:
    """Condition that joins ``profiles`` by name or, if there is none, its first one."""
    return f"name = CASE WHEN {asked} IN (SELECT name FROM profiles) THEN {asked} ELSE (SELECT MIN(name) FROM profiles) END"


def unknown_recipes(df):
    return df.withColumn("profile_name", F.concat(F.lit("P"), (F.col("line_id") + 3).cast("string")))


def line_recipes(df):
    return df.withColumn("profile_name", F.concat(F.lit("P"), (F.col("line_id") % 7).cast("string")))


@query("j1_with_profile", with_views("detections", "profiles", body=f"""
SELECT line_id, frame_id, cx, cy, name AS profile_name, expected_width_px, {label_from_profile()} AS label
FROM detections JOIN profiles ON name = CONCAT('P', CAST(line_id % 7 AS VARCHAR))"""))
def j1(spark, d):
    from linewatch.functions import geometry as g
    from linewatch.functions.recipe import recipe_from
    joined = pr.with_profile(line_recipes(t.pieces(spark, d)), t.profiles(spark))
    lab = g.classify(F.col("width_px"), F.col("height_px"), recipe_from(joined))
    return joined.select("line_id", "frame_id", "cx", "cy", "profile_name", "expected_width_px", lab.alias("label"))


@query("j1_with_profile_fallback", with_views("detections", "profiles", body=f"""
SELECT line_id, frame_id, det_id, name AS profile_name, expected_width_px, name <> {ASKED_UNKNOWN} AS fell_back
FROM detections JOIN profiles ON {join_recipe(ASKED_UNKNOWN)}"""))
def j1_fallback(spark, d):
    joined = pr.with_profile(unknown_recipes(t.detections(spark, d)), t.profiles(spark))
    return joined.select("line_id", "frame_id", "det_id", "profile_name", "expected_width_px", "fell_back")


@query("j2_resolve_active_profile", with_views("event_log", "profiles", body="""
SELECT line_id, seq, profile_name, COALESCE(name, (SELECT MIN(name) FROM profiles)) AS active_profile,
       name IS NULL AS fell_back
FROM event_log LEFT JOIN profiles ON name = profile_name"""))
def j2(spark, d):
    wanted = t.event_log(spark, d).select("line_id", "seq", "profile_name")
    return pr.resolve_active(wanted, t.profiles(spark)).select("line_id", "seq", "profile_name", "active_profile", "fell_back")


FIELDS = ["expected_width_px", "expected_height_px", "expected_area_px", "fused_threshold"]


def base_and_updates(spark, d):
    """Every recipe, and a second delivery that changes some and adds others."""
    all_ = t.recipes(spark, d).select("name", *FIELDS, "camera_gain")
    base = all_.where(F.col("camera_gain") < 40)
    updates = (all_.where(F.col("camera_gain") >= 30)
               .withColumn("expected_width_px", F.col("expected_width_px") + 1))
    return base.drop("camera_gain"), updates.drop("camera_gain")


_B = "SELECT name, expected_width_px, expected_height_px, expected_area_px, fused_threshold FROM recipes WHERE camera_gain < 40"
_U = "SELECT name, expected_width_px + 1 AS expected_width_px, expected_height_px, expected_area_px, fused_threshold FROM recipes WHERE camera_gain >= 30"


@query("j11_upsert_profiles", with_views("recipes", ctes={"b": _B, "u": _U}, body="""
SELECT * FROM b WHERE name NOT IN (SELECT name FROM u) UNION ALL SELECT * FROM u"""))
def j11(spark, d):
    return pr.upsert(*base_and_updates(spark, d))


@query("j11_upsert_last_wins", with_views("recipes", ctes={"b": _B, "u": """
SELECT CONCAT(name, '+') AS name, expected_width_px, expected_height_px, expected_area_px, fused_threshold, camera_gain AS asked_at FROM recipes
UNION ALL SELECT name, expected_width_px + 2, expected_height_px, expected_area_px, fused_threshold, 50 - camera_gain FROM recipes WHERE camera_gain >= 10
UNION ALL SELECT name, expected_width_px + 1, expected_height_px, expected_area_px, fused_threshold, camera_gain FROM recipes WHERE camera_gain >= 20""",
    "l": "SELECT * FROM u QUALIFY ROW_NUMBER() OVER (PARTITION BY name ORDER BY asked_at DESC, expected_width_px DESC) = 1"}, body="""
SELECT * FROM b WHERE name NOT IN (SELECT name FROM l) UNION ALL SELECT * EXCLUDE (asked_at) FROM l"""))
def j11_last_wins(spark, d):
    every = t.recipes(spark, d).select("name", *FIELDS, "camera_gain")
    wider = every.where("camera_gain >= 10").withColumns({
        "expected_width_px": F.col("expected_width_px") + 2, "camera_gain": 50 - F.col("camera_gain")})
    wide = every.where("camera_gain >= 20").withColumn("expected_width_px", F.col("expected_width_px") + 1)
    updates = every.withColumn("name", F.concat("name", F.lit("+"))).unionByName(wider).unionByName(wide)
    return pr.upsert(every.where("camera_gain < 40").drop("camera_gain"), updates, "camera_gain")


@query("j11_remove_profiles", with_views("recipes", ctes={"b": _B}, body="""
SELECT * FROM b WHERE expected_width_px > 0"""))
def j11_remove(spark, d):
    base, _ = base_and_updates(spark, d)
    return pr.remove(base, base.where(F.col("expected_width_px") <= 0).select("name"))


@query("j11_rename_profiles", with_views("recipes", ctes={"b": _B, "c": """
SELECT name AS old_name, CASE WHEN expected_width_px > 300 THEN CONCAT('N', name) ELSE 'R-1' END AS new_name FROM b WHERE expected_width_px > 200"""}, body="""
SELECT COALESCE(new_name, b.name) AS name, expected_width_px FROM b
LEFT JOIN (SELECT * FROM c WHERE new_name NOT IN (SELECT name FROM b)) k ON k.old_name = b.name"""))
def j11_rename(spark, d):
    base, _ = base_and_updates(spark, d)
    wide = F.col("expected_width_px")
    changes = base.where(wide > 200).select(
        F.col("name").alias("old_name"),
        F.when(wide > 300, F.concat(F.lit("N"), "name")).otherwise("R-1").alias("new_name"))
    return pr.rename(base, changes).select("name", "expected_width_px")


def as_settings(df):
    pairs = [F.struct(F.lit(f).alias("key"), F.col(f).cast("double").alias("value")) for f in FIELDS]
    return df.select("name", F.explode(F.array(*pairs)).alias("s")).select("name", "s.key", "s.value")


def _settings_sql(src: str, where: str = "TRUE") -> str:
    return " UNION ALL ".join(f"SELECT name, '{f}' AS key, CAST({f} AS DOUBLE) AS value FROM {src} WHERE {where}" for f in FIELDS)


@query("j12_overlay_config", with_views("recipes", ctes={
    "b": _B, "u": _U, "bs": _settings_sql("b"), "us": _settings_sql("u"),
    "loc": "SELECT * FROM us WHERE key LIKE '%px'"}, body="""
SELECT COALESCE(bs.name, loc.name) AS name, COALESCE(bs.key, loc.key) AS key,
       COALESCE(loc.value, bs.value) AS value, loc.value IS NOT NULL AS overridden
FROM bs FULL JOIN loc ON bs.name = loc.name AND bs.key = loc.key"""))
def j12(spark, d):
    base, updates = base_and_updates(spark, d)
    return pr.overlay_config(as_settings(base), as_settings(updates).where(F.col("key").like("%px")))


@query("o4_profiles_by_name", with_views("recipes", body="SELECT name, expected_width_px FROM recipes ORDER BY name"))
def o4(spark, d):
    return t.recipes(spark, d).select("name", "expected_width_px").orderBy("name")


@query("o6_profiles_only_in_base", with_views("recipes", ctes={"b": _B, "u": _U}, body="""
SELECT name FROM b EXCEPT ALL SELECT name FROM u"""))
def o6_only(spark, d):
    base, updates = base_and_updates(spark, d)
    return base.select("name").exceptAll(updates.select("name"))


@query("o6_profiles_in_both", with_views("recipes", ctes={"b": _B, "u": _U}, body="""
SELECT name FROM b INTERSECT SELECT name FROM u"""))
def o6_both(spark, d):
    base, updates = base_and_updates(spark, d)
    return base.select("name").intersect(updates.select("name"))


_LEARN = """
SELECT line_id, CASE WHEN n >= {m} THEN w END AS expected_width_px, CASE WHEN n >= {m} THEN h END AS expected_height_px,
  CASE WHEN n >= {m} THEN a END AS expected_area_px, n AS samples,
  CASE WHEN n >= {m} THEN cm END AS ref_circularity_mean, CASE WHEN n >= {m} THEN cn END AS ref_circularity_min,
  CASE WHEN n >= {m} THEN sm END AS ref_solidity_mean, CASE WHEN n >= {m} THEN sn END AS ref_solidity_min,
  CASE WHEN n < {m} THEN CONCAT('nothing learnt: ', CAST(n AS VARCHAR), ' of {m} singles') END AS error
FROM (SELECT {k} AS line_id, COUNT(*) FILTER (WHERE s) AS n,
  CAST(ROUND_EVEN(MEDIAN(width_px) FILTER (WHERE s), 0) AS BIGINT) AS w,
  CAST(ROUND_EVEN(MEDIAN(height_px) FILTER (WHERE s), 0) AS BIGINT) AS h,
  CAST(ROUND_EVEN(MEDIAN(area_px) FILTER (WHERE s), 0) AS BIGINT) AS a,
  ROUND(AVG(circularity) FILTER (WHERE s), 4) AS cm, ROUND(MIN(circularity) FILTER (WHERE s), 4) AS cn,
  ROUND(AVG(solidity) FILTER (WHERE s), 4) AS sm, ROUND(MIN(solidity) FILTER (WHERE s), 4) AS sn
FROM (SELECT *, {label} = 'single' AS s FROM detections) GROUP BY {k})"""


@query("d1_learn_reference", with_views("detections", body=_LEARN.format(k="line_id", m=3, label=label())))
def d1(spark, d):
    return pr.learn_reference(pr.label_pieces(t.pieces(spark, d), recipe()), ["line_id"])


@query("d1_learn_reference_per_frame", with_views("detections", body=_LEARN.format(k="frame_id", m=9, label=label())))
def d1_frame(spark, d):
    pieces = pr.label_pieces(t.pieces(spark, d), recipe())
    return pr.learn_reference(pieces, ["frame_id"], 9).withColumnRenamed("frame_id", "line_id")


@query("c1_calibrate_profile", with_views("detections", "profiles", ctes={
    "learned": _LEARN.format(k="line_id", m=3, label=label()),
    "upd": "SELECT CONCAT('L', CAST(line_id AS VARCHAR)) AS name, CAST(expected_width_px AS INT) AS expected_width_px, CAST(expected_height_px AS INT) AS expected_height_px, CAST(expected_area_px AS INT) AS expected_area_px FROM learned WHERE error IS NULL"}, body="""
SELECT name, expected_width_px, expected_height_px, expected_area_px FROM profiles WHERE name NOT IN (SELECT name FROM upd)
UNION ALL SELECT * FROM upd"""))
def c1(spark, d):
    pieces = pr.label_pieces(t.pieces(spark, d), recipe())
    out = pr.calibrate(t.profiles(spark), pieces, ["line_id"], F.concat(F.lit("L"), F.col("line_id").cast("string")))
    return out.select("name", "expected_width_px", "expected_height_px", "expected_area_px")


@query("c1_calibrate_whole_profile", with_views("detections", "profiles", ctes={
    "learned": _LEARN.format(k="line_id", m=3, label=label()),
    "upd": "SELECT CONCAT('P', CAST(line_id + 4 AS VARCHAR)) AS name, * FROM learned WHERE error IS NULL",
    "old": "SELECT * FROM profiles UNION ALL SELECT u.new_name, p.* EXCLUDE (name) FROM profiles p CROSS JOIN (SELECT name AS new_name FROM upd WHERE name NOT IN (SELECT name FROM profiles)) u WHERE p.name = (SELECT MIN(name) FROM profiles)"}, body="""
SELECT name, CAST(COALESCE(u.expected_width_px, o.expected_width_px) AS INT) AS expected_width_px,
  CAST(COALESCE(u.expected_area_px, o.expected_area_px) AS INT) AS expected_area_px, fused_threshold, noise_threshold,
  ref_circularity_min, ref_solidity_mean FROM old o LEFT JOIN upd u USING (name)"""))
def c1_whole(spark, d):
    pieces = pr.label_pieces(t.pieces(spark, d), recipe())
    out = pr.calibrate(t.profiles(spark), pieces, ["line_id"], F.concat(F.lit("P"), (F.col("line_id") + 4).cast("string")))
    return out.select("name", "expected_width_px", "expected_area_px", "fused_threshold", "noise_threshold",
                      "ref_circularity_min", "ref_solidity_mean")


@query("c1_calibration_events", with_views("detections", ctes={"learned": _LEARN.format(k="line_id", m=3, label=label())}, body="""
SELECT 'calibration_done' AS event_type, CONCAT('L', CAST(line_id AS VARCHAR)) AS profile_name, samples,
       expected_width_px AS width_px, expected_area_px AS area_px, ref_circularity_min AS circularity_min
FROM learned WHERE error IS NULL"""))
def c1_events(spark, d):
    learned = pr.learn_reference(pr.label_pieces(t.pieces(spark, d), recipe()), ["line_id"])
    rows = pr.calibration_events(learned, F.concat(F.lit("L"), F.col("line_id").cast("string")))
    x = F.from_json("extra_json", "samples long, width_px long, area_px long, circularity_min double")
    return rows.select("event_type", "profile_name", x.alias("x")).select(
        "event_type", "profile_name", "x.samples", "x.width_px", "x.area_px", "x.circularity_min")


@query("c2_default_bands", with_views("recipes", ctes={"h": "SELECT name, expected_height_px AS height FROM recipes"}, body="""
SELECT name, CAST(i AS INT) AS col, i*(GREATEST(height::DOUBLE, 1)/8) AS y_min, (i+1)*(GREATEST(height::DOUBLE, 1)/8) AS y_max
FROM h, RANGE(8) r(i)"""))
def c2(spark, d):
    return pr.default_bands(t.recipes(spark, d), ["name"], F.col("expected_height_px"), 8)


@query("c3_bands_from_centres", with_views("detections", ctes={
    "c": "SELECT line_id, frame_id, cy FROM detections GROUP BY ALL", "o": """
SELECT *, COUNT(*) OVER (PARTITION BY line_id, frame_id) AS n,
  ROW_NUMBER() OVER (PARTITION BY line_id, frame_id ORDER BY cy) - 1 AS i,
  LAG(cy) OVER (PARTITION BY line_id, frame_id ORDER BY cy) AS pv, LEAD(cy) OVER (PARTITION BY line_id, frame_id ORDER BY cy) AS nx FROM c"""}, body="""
SELECT line_id, frame_id, CAST(i AS INT) AS col, COALESCE((pv+cy)/2, 0) AS y_min, COALESCE((cy+nx)/2, 2200) AS y_max FROM o WHERE n = 12"""))
def c3(spark, d):
    centres = t.pieces(spark, d).select("line_id", "frame_id", "cy").distinct()
    return pr.bands_from_centres(centres, ["line_id", "frame_id"], "cy", F.lit(2200), 12)
