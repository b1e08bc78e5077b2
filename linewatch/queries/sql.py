"""SQL text of the derived tables, used as CTEs by the SQL twins (DuckDB)."""

VIEWS = {
    "frames": """
SELECT DISTINCT CAST(FLOOR(o_orderkey*10/38) AS BIGINT) AS frame_id,
       CAST(FLOOR(o_orderkey*10/38) AS BIGINT) % 4 AS line_id,
       CAST(FLOOR(o_orderkey*10/38) AS BIGINT) * 100 AS t_ms,
       3200 AS width_px, 2200 AS height_px
FROM orders""",
    "detections": """
SELECT CAST(FLOOR(l_orderkey/4) AS BIGINT) AS frame_id,
       CAST(FLOOR(l_orderkey/4) AS BIGINT) % 4 AS line_id,
       l_orderkey*1000 + ROW_NUMBER() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS det_id,
       CAST(l_partkey*37 % 1432 AS DOUBLE) AS cx,
       CAST(l_suppkey*131 % 2200 AS DOUBLE) AS cy,
       CAST(120 + FLOOR(l_quantity*l_quantity/4) AS INT) AS width_px,
       CAST(240 + ROUND(l_discount*100)*25 AS INT) AS height_px,
       CAST(FLOOR((120 + FLOOR(l_quantity*l_quantity/4)) * (240 + ROUND(l_discount*100)*25) * 785/1000) AS BIGINT) AS area_px,
       ROUND(CAST(0.5 AS DOUBLE) + l_tax*6, 4) AS circularity,
       ROUND(CAST(0.69 AS DOUBLE) + (l_partkey % 31)/CAST(100 AS DOUBLE), 4) AS solidity
FROM lineitem""",
    "edges0": """
SELECT *, cx - (width_px + height_px)/CAST(4 AS DOUBLE) AS edge,
       (width_px + height_px)/CAST(2 AS DOUBLE) AS diam
FROM detections""",
    "signals": """
SELECT user_id AS line_id, epoch_us(ts)//1000 AS t_ms, event_id AS seq,
       event_type IN ('click','view','purchase') AS running,
       event_type = 'error' AS fault,
       event_type = 'signup' AS ack,
       event_type IN ('view','error') AS belt_running,
       value/CAST(500 AS DOUBLE) AS occupancy
FROM events""",
    "event_log": """
SELECT user_id AS line_id, epoch_us(ts)//1000 AS t_ms, CAST(ts AS DATE) AS event_date, event_id AS seq,
       CASE event_type WHEN 'signup' THEN CASE WHEN value > 30 THEN 'startup' ELSE 'shutdown' END
            WHEN 'error' THEN 'fault_raised' WHEN 'purchase' THEN 'fault_cleared'
            WHEN 'click' THEN 'calibration_done' ELSE 'profile_change' END AS event_type,
       CONCAT('P', CAST(user_id % 7 AS VARCHAR)) AS profile_name,
       CASE WHEN event_type <> 'error' THEN '' WHEN value > 30 THEN 'FAULT_ROW_FUSED' ELSE 'FAULT_UNKNOWN' END AS fault_reason,
       CASE WHEN event_type = 'error' THEN CONCAT('img-', CAST(event_id AS VARCHAR), '.jpg') ELSE '' END AS image_filename,
       props AS extra_json
FROM events""",
    "defect_images": """
SELECT CONCAT('img-', CAST(event_id AS VARCHAR), '.jpg') AS filename, epoch_us(ts)//1000 AS t_ms, user_id AS line_id
FROM events
WHERE (event_type = 'error' AND event_id % 5 <> 0) OR (event_type = 'view' AND event_id % 50 = 0)""",
    "profiles": """
SELECT name, width_px AS expected_width_px, width_px AS expected_height_px, area_px AS expected_area_px,
       CAST(fused AS DOUBLE) AS fused_threshold, CAST(noise AS DOUBLE) AS noise_threshold,
       CAST(0.5 AS DOUBLE) AS single_min_ratio, CAST(2.5 AS DOUBLE) AS unknown_max_ratio
FROM (VALUES ('Default',290,60000,1.5,0.5), ('P0',290,60000,1.5,0.5), ('P1',260,50000,1.4,0.5),
             ('P2',320,75000,1.5,0.4), ('P3',240,42000,1.6,0.3), ('P4',300,66000,1.5,0.5),
             ('P5',280,58000,1.4,0.4)) AS t(name, width_px, area_px, fused, noise)""",
    "bands": """
SELECT col, CAST(col*275 AS DOUBLE) AS y_min, CAST((col+1)*275 AS DOUBLE) AS y_max
FROM (VALUES (0),(1),(2),(3),(4),(5),(6),(7)) AS t(col)""",
    "recipes": """
SELECT CONCAT(CASE WHEN p_partkey % 11 = 0 THEN 'R/' ELSE 'R-' END, CAST(p_partkey AS VARCHAR),
              CASE WHEN p_partkey % 13 = 0 THEN ' ' ELSE '' END) AS name,
       CAST(p_size*10 - 20 AS INT) AS expected_width_px, CAST(p_size*9 - 9 AS INT) AS expected_height_px,
       CAST(p_size*p_size*60 AS INT) AS expected_area_px,
       ROUND(CAST(0.98 AS DOUBLE) + p_size/CAST(50 AS DOUBLE), 4) AS fused_threshold,
       ROUND((p_partkey % 100)/CAST(95 AS DOUBLE), 4) AS noise_threshold,
       CAST(0.5 AS DOUBLE) AS single_min_ratio,
       ROUND(CAST(0.99 AS DOUBLE) + (p_partkey % 7)/CAST(2 AS DOUBLE), 4) AS unknown_max_ratio,
       CAST(1800 - p_size*36 AS INT) AS roi_split_x, 2400 AS transfer_line_x,
       CAST(p_partkey % 50 AS INT) AS camera_gain, p_size - 2 AS crop_top, p_size - 1 AS crop_left
FROM part""",
    "pixels": """
SELECT vec_id AS frame_id, vec_id % 4 AS line_id, CAST(p % 8 AS INT) AS x, CAST(FLOOR(p/8) AS INT) AS y,
       CAST(LEAST(255, GREATEST(0, FLOOR(128 + CAST(e AS DOUBLE)*240))) AS INT) AS v
FROM (SELECT vec_id, UNNEST(embedding) AS e, UNNEST(RANGE(len(embedding))) AS p FROM embeddings)""",
}

LABEL = """CASE WHEN GREATEST({w}/CAST({ew} AS DOUBLE), {h}/CAST({eh} AS DOUBLE)) > {cap} THEN 'unknown'
     WHEN {w}/CAST({ew} AS DOUBLE) >= {fused} AND {h}/CAST({eh} AS DOUBLE) >= {fused} THEN 'unknown'
     WHEN {w}/CAST({ew} AS DOUBLE) >= {fused} THEN 'row_fused'
     WHEN {h}/CAST({eh} AS DOUBLE) >= {fused} THEN 'column_fused'
     WHEN LEAST({w}/CAST({ew} AS DOUBLE), {h}/CAST({eh} AS DOUBLE)) < {low} THEN 'unknown'
     ELSE 'single' END"""


def label(w="width_px", h="height_px", ew="290", eh="290", fused="1.5", low="0.5", cap="2.5") -> str:
    return LABEL.format(w=w, h=h, ew=ew, eh=eh, fused=fused, low=low, cap=cap)


def label_from_profile(w="width_px", h="height_px") -> str:
    return label(w, h, "expected_width_px", "expected_height_px", "fused_threshold",
                 "single_min_ratio", "unknown_max_ratio")


def with_views(*names: str, body: str, ctes: dict[str, str] | None = None, recursive: bool = False) -> str:
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in names]
    parts += [f"{n} AS ({q.strip()})" for n, q in (ctes or {}).items()]
    if not parts:
        return body.strip()
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body.strip()
