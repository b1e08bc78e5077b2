"""Names, codes and defaults that results depend on."""

# Piece labels
SINGLE = "single"
ROW_FUSED = "row_fused"
COLUMN_FUSED = "column_fused"
UNKNOWN = "unknown"
LABELS = (SINGLE, ROW_FUSED, COLUMN_FUSED, UNKNOWN)
FAULT_LABELS = (ROW_FUSED, UNKNOWN)

# Frame verdicts
OK = "OK"
FAULT_ROW_FUSED = "FAULT_ROW_FUSED"
FAULT_UNKNOWN = "FAULT_UNKNOWN"
INFO_COLUMN_FUSED = "INFO_COLUMN_FUSED"
INFO_INCOMPLETE_ROW = "INFO_INCOMPLETE_ROW"
INFO_UNKNOWN_NONFAULT = "INFO_UNKNOWN_NONFAULT"
VERDICTS = (OK, FAULT_ROW_FUSED, FAULT_UNKNOWN, INFO_COLUMN_FUSED,
            INFO_INCOMPLETE_ROW, INFO_UNKNOWN_NONFAULT)
FAULT_VERDICTS = (FAULT_ROW_FUSED, FAULT_UNKNOWN)

# Line states
WAITING = "WAITING"
TRACKING = "TRACKING"
INSPECTING = "INSPECTING"
READY = "READY"
FAULT = "FAULT"
SERVICE = "SERVICE"
STATES = (WAITING, TRACKING, INSPECTING, READY, FAULT, SERVICE)

# Event log columns and types
EVENT_COLUMNS = ("timestamp_iso", "event_type", "profile_name", "fault_reason",
                 "image_filename", "state_before", "state_after", "extra_json")
EVENT_TYPES = ("startup", "shutdown", "fault_raised", "fault_cleared",
               "pulse_complete", "profile_change", "calibration_done",
               "mode_change", "wizard_complete", "camera_disconnected",
               "camera_reconnected")

# Image file suffixes
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff")

# Recipe defaults
RECIPE_DEFAULTS = {
    "expected_area_px": 60_000,
    "expected_width_px": 290,
    "expected_height_px": 290,
    "fused_threshold": 1.5,
    "noise_threshold": 0.5,
    "single_min_ratio": 0.5,
    "unknown_max_ratio": 2.5,
    "belt_adaptive_block": 0,
    "roi_split_x": 1768,
    "transfer_line_x": 2400,
    "belt_min_solidity": 0.80,
    "belt_max_aspect_ratio": 3.0,
    "ref_circularity_mean": 0.0,
    "ref_circularity_min": 0.0,
    "ref_solidity_mean": 0.0,
    "ref_solidity_min": 0.0,
    "circularity_tolerance": 0.7,
    "solidity_tolerance": 0.85,
    "fused_merge_distance_factor": 1.15,
    "transfer_bridge_width_px": 40,
    "tripwire_half_width_px": 15,
    "tripwire_occupancy_threshold": 0.12,
    "tripwire_debounce_frames": 2,
}

# Thresholds outside the recipe
MIN_GAP_PX = 0.001            # smallest row gap / match distance
ROW_GAP_DIAMETERS = 0.6       # row gap in piece diameters
OUTLIER_DISTANCE_PX = 100.0   # leave-one-out limit inside a row
NEWEST_ROW_BAND = 0.7         # of expected width
MATCH_TOLERANCE = 0.4         # of median row spacing
FRAME_GAP_MS = 150
MAX_AREA_FRACTION = 0.15
RELAXED_SOLIDITY = 0.35
SHADOW_FLOOR = 40
HIGH_OVERSHOOT_PX = 40
FAR_PAST_PX = 60
STOP_HOLD_MS = 10_000
