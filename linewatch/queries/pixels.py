"""Pixel tables: statistics, filters, morphology, blobs."""

from pyspark.sql import functions as F

from linewatch.functions.recipe import recipe
from linewatch.operators import pixels as px
from linewatch.queries import query
from linewatch.queries.sql import label, with_views
from linewatch.sources import images as im
from linewatch.sources import tables as t

ROWX = "OVER (PARTITION BY line_id, frame_id, y ORDER BY x {})"
ROWY = "OVER (PARTITION BY line_id, frame_id, x ORDER BY y {})"


def pixel_sql(body: str, recursive: bool = False, **ctes: str) -> str:
    return with_views("pixels", ctes=ctes, body=body, recursive=recursive)


def grid(spark, d):
    return px.by_frame(t.pixels(spark, d))


@query("d9_histogram_64", pixel_sql("""SELECT f.line_id, f.frame_id, CAST(b AS INT) AS bin, COALESCE(n, 0) AS n,
  COALESCE(n, 0)/CAST(MAX(COALESCE(n, 0)) OVER (PARTITION BY f.line_id, f.frame_id) AS DOUBLE) AS height
  FROM (SELECT DISTINCT line_id, frame_id FROM pixels) f CROSS JOIN RANGE(64) r(b)
  LEFT JOIN (SELECT line_id, frame_id, v*64//256 AS b, COUNT(*) AS n FROM pixels GROUP BY ALL) h USING (line_id, frame_id, b)"""))
def d9(spark, d):
    return px.histogram(t.pixels(spark, d), 64)


_OTSU = {"hist": "SELECT line_id, frame_id, v, COUNT(*) AS n FROM {src} GROUP BY ALL",
         "cum": """SELECT *, CAST(SUM(n) OVER w AS DOUBLE) AS n0, CAST(SUM(n*v) OVER w AS DOUBLE) AS s0,
   CAST(SUM(n) OVER f AS DOUBLE) AS nn, CAST(SUM(n*v) OVER f AS DOUBLE) AS ss FROM hist
   WINDOW w AS (PARTITION BY line_id, frame_id ORDER BY v), f AS (PARTITION BY line_id, frame_id)""",
         "bv": """SELECT *, CASE WHEN n0 < nn THEN ROUND((n0/nn)*((nn-n0)/nn)*(s0/n0-(ss-s0)/(nn-n0))*(s0/n0-(ss-s0)/(nn-n0)), 6) END AS b FROM cum""",
         "ot": """SELECT line_id, frame_id, CAST(COALESCE(MIN(v) FILTER (WHERE b = m), 0) AS INT) AS threshold FROM
   (SELECT *, MAX(b) OVER (PARTITION BY line_id, frame_id) AS m FROM bv) GROUP BY line_id, frame_id"""}


def otsu_ctes(src: str) -> dict[str, str]:
    return {k: v.replace("{src}", src) for k, v in _OTSU.items()}


LIFTED = "SELECT * REPLACE (CASE WHEN v < 40 THEN 255 ELSE v END AS v) FROM pixels"


@query("d10_otsu", pixel_sql("SELECT * FROM ot", **otsu_ctes("pixels")))
def d10(spark, d):
    return px.otsu(t.pixels(spark, d))


@query("d10_otsu_dark", pixel_sql("SELECT * FROM ot", lifted=LIFTED, **otsu_ctes("lifted")))
def d10_dark(spark, d):
    return px.otsu(t.pixels(spark, d), dark=True)


@query("d11_contrast", pixel_sql("SELECT line_id, frame_id, ROUND(STDDEV_POP(v), 6) AS contrast FROM pixels GROUP BY ALL"))
def d11(spark, d):
    return px.contrast(t.pixels(spark, d)).withColumn("contrast", F.round("contrast", 6))


@query("d12_strip_occupancy", pixel_sql("""SELECT line_id, frame_id, AVG(CASE WHEN v > 140 THEN 1.0 ELSE 0.0 END) AS occupancy,
  AVG(CASE WHEN v > 140 THEN 1.0 ELSE 0.0 END) >= CAST(0.12 AS DOUBLE) AS occupied FROM pixels WHERE x BETWEEN 1 AND 3 GROUP BY ALL"""))
def d12(spark, d):
    return px.strip_occupancy(px.threshold(t.pixels(spark, d), F.lit(140)), 2, 1)


@query("d13_column_profile", pixel_sql("SELECT line_id, frame_id, x, COUNT(*) FILTER (WHERE v > 128) AS set_pixels FROM pixels GROUP BY ALL"))
def d13(spark, d):
    return px.column_profile(px.threshold(t.pixels(spark, d), F.lit(128)))


@query("c4_capture_background", pixel_sql("SELECT line_id, x, y, MEDIAN(v) AS ref FROM pixels GROUP BY ALL"))
def c4(spark, d):
    return px.capture_background(t.pixels(spark, d))


@query("j5_bg_difference", pixel_sql("""SELECT p.line_id, frame_id, p.x, p.y, v, ABS(v - ref) AS diff FROM pixels p JOIN bg ON
  p.line_id = bg.line_id AND p.x = bg.x AND p.y = bg.y WHERE ABS(v - ref) > 30""", bg="SELECT line_id, x, y, MEDIAN(v) AS ref FROM pixels GROUP BY ALL"))
def j5(spark, d):
    pixels = t.pixels(spark, d)
    return px.bg_difference(pixels, px.capture_background(pixels))


def _smooth_sql(axis: str, src: str, value: str) -> str:
    w = (ROWX if axis == "x" else ROWY).format("")
    return f"""SELECT * EXCLUDE (l1, l2, r1, r2), COALESCE(l2, CASE WHEN l1 IS NOT NULL THEN {value} END, r2) + 4*COALESCE(l1, r1) + 6*{value}
      + 4*COALESCE(r1, l1) + COALESCE(r2, CASE WHEN r1 IS NOT NULL THEN {value} END, l2) AS s{axis}
      FROM (SELECT *, LAG({value}, 1) {w} AS l1, LAG({value}, 2) {w} AS l2, LEAD({value}, 1) {w} AS r1, LEAD({value}, 2) {w} AS r2 FROM {src})"""


BLUR = {"bx": _smooth_sql("x", "pixels", "v"), "by_": _smooth_sql("y", "bx", "sx"),
        "blur": "SELECT line_id, frame_id, x, y, CAST((sy + 128)//256 AS INT) AS v FROM by_"}


@query("x1_blur5", pixel_sql("SELECT * FROM blur", **BLUR))
def x1(spark, d):
    return px.blur5(grid(spark, d))


@query("x2_threshold", pixel_sql("SELECT line_id, frame_id, x, y, CASE WHEN v > 120 THEN 0 ELSE 255 END AS v FROM pixels"))
def x2(spark, d):
    return px.threshold(t.pixels(spark, d), F.lit(120), invert=True)


def mean_ctes(src: str, r: int) -> dict[str, str]:
    """Local mean by joining every pixel with its clamped neighbours."""
    n = (2 * r + 1) ** 2
    return {"lm": f"""SELECT a.line_id, a.frame_id, a.x, a.y, a.v, CAST(ROUND(SUM(b.v)/CAST({n} AS DOUBLE)) AS INT) AS mean
      FROM {src} a, RANGE(-{r}, {r + 1}) dx(i), RANGE(-{r}, {r + 1}) dy(j), {src} b
      WHERE b.line_id = a.line_id AND b.frame_id = a.frame_id AND b.x = LEAST(7, GREATEST(0, a.x + i)) AND b.y = LEAST(7, GREATEST(0, a.y + j)) GROUP BY ALL"""}


@query("x3_adaptive_threshold", pixel_sql("SELECT line_id, frame_id, x, y, CASE WHEN v > mean + 10 THEN 255 ELSE 0 END AS v FROM lm", **mean_ctes("pixels", 2)))
def x3(spark, d):
    return px.adaptive_threshold(grid(spark, d), 5, -10)


@query("x3_adaptive_threshold_dark", pixel_sql("SELECT line_id, frame_id, x, y, CASE WHEN v <= mean - 10 THEN 255 ELSE 0 END AS v FROM lm", **mean_ctes("pixels", 2)))
def x3_dark(spark, d):
    return px.adaptive_threshold(grid(spark, d), 5, 10, invert=True)


@query("x4_auto_threshold", pixel_sql("SELECT line_id, frame_id, x, y, CASE WHEN v > threshold THEN 255 ELSE 0 END AS v FROM pixels JOIN ot USING (line_id, frame_id)", **otsu_ctes("pixels")))
def x4(spark, d):
    return px.auto_threshold(grid(spark, d))


@query("x4_auto_threshold_dark", pixel_sql("""SELECT line_id, frame_id, x, y, CASE WHEN v >= 40 AND v <= threshold THEN 255 ELSE 0 END AS v
  FROM pixels JOIN ot USING (line_id, frame_id)""", lifted=LIFTED, **otsu_ctes("lifted")))
def x4_dark(spark, d):
    return px.auto_threshold(grid(spark, d), dark=True)


# Low-contrast frames: grey levels squeezed so that the local path is taken.
FLAT = "SELECT * REPLACE (CAST(120 + v//64 AS INT) AS v) FROM pixels"


@query("x4_auto_threshold_flat", pixel_sql("SELECT line_id, frame_id, x, y, CASE WHEN v > mean + 1 THEN 255 ELSE 0 END AS v FROM lm", flat=FLAT, **mean_ctes("flat", 2)))
def x4_flat(spark, d):
    flat = grid(spark, d).withColumn("v", (F.lit(120) + F.expr("v div 64")).cast("int"))
    return px.auto_threshold(flat, block=5, c=-1)


BINARY = "SELECT line_id, frame_id, x, y, CASE WHEN v > 110 THEN 255 ELSE 0 END AS v FROM pixels"


def rect_sql(src: str, r: int, agg: str) -> str:
    frame = f"ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING"
    return f"""SELECT line_id, frame_id, x, y, CAST({agg}(h) {ROWY.format(frame)} AS INT) AS v FROM
      (SELECT *, {agg}(v) {ROWX.format(frame)} AS h FROM {src})"""


def ellipse_sql(src: str, k: int, agg: str) -> str:
    r = k // 2
    spots = " OR ".join(f"(b.y = a.y + {dy} AND ABS(b.x - a.x) <= {w})" for dy, w in zip(range(-r, r + 1), px.ellipse_widths(k)))
    return f"""SELECT a.line_id, a.frame_id, a.x, a.y, {agg}(b.v) AS v FROM {src} a JOIN {src} b ON a.line_id = b.line_id AND a.frame_id = b.frame_id
      AND ({spots}) GROUP BY ALL"""


def binary(spark, d, t_=110):
    return px.threshold(grid(spark, d), F.lit(t_))


@query("x5_erode_rect", pixel_sql(rect_sql("b", 1, "MIN"), b=BINARY))
def x5_erode(spark, d):
    return px.erode(binary(spark, d), 3, "rect")


@query("x5_dilate_ellipse", pixel_sql(ellipse_sql("b", 5, "MAX"), b=BINARY))
def x5_dilate(spark, d):
    return px.dilate(binary(spark, d), 5)


OPEN3 = {"b": BINARY, "e": ellipse_sql("b", 3, "MIN"), "o": ellipse_sql("e", 3, "MAX")}


@query("x5_open_ellipse", pixel_sql("SELECT * FROM o", **OPEN3))
def x5_open(spark, d):
    return px.opened(binary(spark, d), 3)


@query("x5_close_ellipse", pixel_sql("SELECT * FROM c", b=BINARY, e=ellipse_sql("b", 3, "MAX"), c=ellipse_sql("e", 3, "MIN")))
def x5_close(spark, d):
    return px.closed(binary(spark, d), 3)


@query("x6_feed_mask", pixel_sql("SELECT line_id, frame_id, x, y, CASE WHEN v > 120 THEN 255 ELSE 0 END AS v FROM c2", c1=rect_sql("pixels", 7, "MAX"), c2=rect_sql("c1", 7, "MIN")))
def x6(spark, d):
    return px.feed_mask(grid(spark, d), 120, 2.0)


def reach_ctes(src: str, near: str) -> dict[str, str]:
    """Transitive closure over touching pixels of ``src``."""
    return {"reach": f"""SELECT line_id, frame_id, x, y, x AS ax, y AS ay FROM {src}
      UNION SELECT r.line_id, r.frame_id, r.x, r.y, p.x, p.y FROM reach r JOIN {src} p ON p.line_id = r.line_id AND p.frame_id = r.frame_id AND {near}"""}


NEAR8 = "ABS(p.x - r.ax) <= 1 AND ABS(p.y - r.ay) <= 1"
NEAR4 = "ABS(p.x - r.ax) + ABS(p.y - r.ay) <= 1"
BLOBS = {"b": BINARY.replace("110", "150"), "fg": "SELECT * FROM b WHERE v > 0", **reach_ctes("fg", NEAR8),
         "lab": "SELECT line_id, frame_id, x, y, CAST(MIN(ay*8 + ax) AS BIGINT) AS label FROM reach GROUP BY line_id, frame_id, x, y"}


def blobs(spark, d):
    return px.with_label(px.label_blobs(binary(spark, d, 150)), 8)


@query("x7_label_blobs", pixel_sql("SELECT line_id, frame_id, x, y, label FROM lab", recursive=True, **BLOBS))
def x7(spark, d):
    return blobs(spark, d).select("line_id", "frame_id", "x", "y", "label")


SMALL = {"expected_width_px": 3, "expected_height_px": 3, "expected_area_px": 6}


@query("d17_blob_measures", pixel_sql(f"""SELECT *, LEAST(1.0::DOUBLE, area_px/6.0::DOUBLE) AS confidence, {label(ew='3', eh='3')} AS piece FROM (
  SELECT line_id, frame_id, label, MIN(x) AS bbox_x, MIN(y) AS bbox_y, MAX(x)-MIN(x)+1 AS width_px, MAX(y)-MIN(y)+1 AS height_px,
  COUNT(*) AS area_px, AVG(x) AS cx, AVG(y) AS cy FROM lab GROUP BY line_id, frame_id, label)""", recursive=True, **BLOBS))
def d17(spark, d):
    return px.blob_measures(blobs(spark, d), recipe(**SMALL), ["label"])


@query("x8_fill_holes", pixel_sql("""SELECT c.line_id, c.frame_id, c.x, c.y, CASE WHEN c.v > 0 OR o.open IS NULL OR NOT o.open THEN 255 ELSE 0 END AS v
  FROM c LEFT JOIN o ON o.line_id = c.line_id AND o.frame_id = c.frame_id AND o.x = c.x AND o.y = c.y""", recursive=True,
  b=BINARY, e=ellipse_sql("b", 3, "MAX"), c=ellipse_sql("e", 3, "MIN"), bgp="SELECT * FROM c WHERE v = 0", **reach_ctes("bgp", NEAR4),
  o="SELECT line_id, frame_id, x, y, BOOL_OR(ax IN (0, 7) OR ay IN (0, 7)) AS open FROM reach GROUP BY line_id, frame_id, x, y"))
def x8(spark, d):
    return px.fill_holes(binary(spark, d), 3)


EXTRACT = {**BLUR, **otsu_ctes("blur"), "m": "SELECT line_id, frame_id, x, y, CASE WHEN v > threshold THEN 255 ELSE 0 END AS v FROM blur JOIN ot USING (line_id, frame_id)",
           "me": ellipse_sql("m", 3, "MIN"), "mo": ellipse_sql("me", 3, "MAX"), "fg": "SELECT * FROM mo WHERE v > 0", **reach_ctes("fg", NEAR8),
           "lab": "SELECT line_id, frame_id, x, y, CAST(MIN(ay*8 + ax) AS BIGINT) AS label FROM reach GROUP BY line_id, frame_id, x, y"}


@query("x9_extract", pixel_sql(f"""SELECT *, {label(ew='3', eh='3')} AS piece FROM (
  SELECT line_id, frame_id, MIN(x) AS bbox_x, MIN(y) AS bbox_y, MAX(x)-MIN(x)+1 AS width_px, MAX(y)-MIN(y)+1 AS height_px,
  COUNT(*) AS area_px, ROUND(AVG(x), 6) AS cx, ROUND(AVG(y), 6) AS cy FROM lab GROUP BY line_id, frame_id, label) WHERE area_px >= 3""", recursive=True, **EXTRACT))
def x9(spark, d):
    out = px.extract(t.pixels(spark, d), recipe(**SMALL), open_k=3, dilate_k=0)
    return out.select("line_id", "frame_id", "bbox_x", "bbox_y", "width_px", "height_px", "area_px",
                      F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), "piece")


def small_sql(w: int) -> str:
    """8 x 8 frames in w x w: every pixel weighs by its share of each small one."""
    part = f"GREATEST(0, LEAST((x + 1)*{w}, (i + 1)*8) - GREATEST(x*{w}, i*8))"
    up = "2*r > 64 OR (2*r = 64 AND q % 2 = 1)"
    return f"""SELECT line_id, frame_id, x, y, CAST(q + CASE WHEN {up} THEN 1 ELSE 0 END AS INT) AS v FROM (
      SELECT line_id, frame_id, CAST(i AS INT) AS x, CAST(j AS INT) AS y, SUM(v*wx*wy)//64 AS q, SUM(v*wx*wy) % 64 AS r FROM (
        SELECT *, {part} AS wx, {part.replace('x', 'y').replace('i', 'j')} AS wy FROM pixels, RANGE({w}) a(i), RANGE({w}) b(j)) GROUP BY ALL)"""


@query("x9_downscale", pixel_sql(small_sql(6)))
def x9_downscale(spark, d):
    return px.downscale(t.pixels(spark, d), 6)


_BACK = "(1/CAST(0.75 AS DOUBLE))"

# Small frames can be flat; a block of 51 covers 6 x 6 whole, so only the border repeats.
_EDGE = "(CASE b.{0} WHEN 0 THEN 26 - a.{0} WHEN 5 THEN 21 + a.{0} ELSE 1 END)"
FLAT_MEANS = {"flat": "SELECT line_id, frame_id FROM blur GROUP BY ALL HAVING STDDEV_POP(v) < 3",
              "fm": f"""SELECT a.line_id, a.frame_id, a.x, a.y, CAST(ROUND(SUM(b.v*{_EDGE.format('x')}*{_EDGE.format('y')})/CAST(2601 AS DOUBLE)) AS INT) AS mean
   FROM blur a JOIN flat USING (line_id, frame_id) JOIN blur b ON a.line_id = b.line_id AND a.frame_id = b.frame_id GROUP BY ALL"""}
EXTRACT_SMALL = {k: q for k, q in EXTRACT.items() if k not in BLUR} | {
    "m": """SELECT line_id, frame_id, x, y, CASE WHEN v > COALESCE(mean + 10, threshold) THEN 255 ELSE 0 END AS v
   FROM blur JOIN ot USING (line_id, frame_id) LEFT JOIN fm USING (line_id, frame_id, x, y)"""}


@query("x9_extract_downscaled", pixel_sql(f"""SELECT line_id, frame_id, CAST(FLOOR(bbox_x*{_BACK}) AS INT) AS bbox_x, CAST(FLOOR(bbox_y*{_BACK}) AS INT) AS bbox_y,
  CAST(FLOOR(width_px*{_BACK}) AS INT) AS width_px, CAST(FLOOR(height_px*{_BACK}) AS INT) AS height_px, CAST(FLOOR(area_px*{_BACK}*{_BACK}) AS BIGINT) AS area_px,
  ROUND(cx*{_BACK}, 6) AS cx, ROUND(cy*{_BACK}, 6) AS cy, piece FROM (SELECT *, {label(ew='2', eh='2')} AS piece FROM (
  SELECT line_id, frame_id, MIN(x) AS bbox_x, MIN(y) AS bbox_y, MAX(x)-MIN(x)+1 AS width_px, MAX(y)-MIN(y)+1 AS height_px,
  COUNT(*) AS area_px, AVG(x) AS cx, AVG(y) AS cy FROM lab GROUP BY line_id, frame_id, label) WHERE area_px >= 1.5)""", recursive=True,
  **{"small": small_sql(6), **BLUR, "bx": _smooth_sql("x", "small", "v"), **FLAT_MEANS, **EXTRACT_SMALL}))
def x9_extract_downscaled(spark, d):
    out = px.extract(t.pixels(spark, d), recipe(**SMALL), open_k=3, dilate_k=0, max_width=6)
    return out.select("line_id", "frame_id", "bbox_x", "bbox_y", "width_px", "height_px", "area_px",
                      F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), "piece")


@query("x10_mask_stats", pixel_sql("""SELECT line_id, frame_id, threshold, ROUND(STDDEV_POP(v), 6) AS contrast,
  COUNT(*) FILTER (WHERE v > threshold) AS set_pixels, COUNT(*) AS pixels FROM pixels p JOIN ot USING (line_id, frame_id) GROUP BY ALL""", **otsu_ctes("pixels")))
def x10(spark, d):
    return px.mask_stats(t.pixels(spark, d)).withColumn("contrast", F.round("contrast", 6))


_LEVEL = "CAST(LEAST(255, GREATEST(0, FLOOR(128 + CAST({} AS DOUBLE)*240))) AS INT)"


@query("a12_frames_to_pixels", with_views(body=f"""SELECT line_id, frame_id, CAST(p % 4 AS INT) AS x, CAST(p//4 AS INT) AS y,
  CAST(ROUND(r*CAST(0.299 AS DOUBLE) + g*CAST(0.587 AS DOUBLE) + b*CAST(0.114 AS DOUBLE)) AS INT) AS v FROM (
  SELECT vec_id % 4 AS line_id, vec_id AS frame_id, p, {_LEVEL.format('embedding[p*4+1]')} AS b, {_LEVEL.format('embedding[p*4+2]')} AS g,
  {_LEVEL.format('embedding[p*4+3]')} AS r FROM embeddings, RANGE(16) q(p))"""))
def a12(spark, d):
    """Planes of 16 BGRA pixels out of all 64 values."""
    level = F.transform("embedding", lambda e: F.least(F.lit(255), F.greatest(
        F.lit(0), F.floor(F.lit(128) + e.cast("double") * 240))).cast("int"))
    planes = t.table(spark, d, "embeddings").select(
        (F.col("vec_id") % 4).alias("line_id"), F.col("vec_id").alias("frame_id"), level.alias("plane"))
    return im.array_to_pixels(planes, "plane", 4, channels=4)
