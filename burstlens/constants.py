"""Vocabulary, thresholds and weights that define the results.

They are part of the data contract, so they are stated once, as plain text, and
every operator reads them from here.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: keypoint order of detections and labels -------------------
KEYPOINT_NAMES = ("beak", "left_eye", "right_eye", "head_top", "left_shoulder", "right_shoulder")
KEYPOINT_INDEX = {name: i for i, name in enumerate(KEYPOINT_NAMES)}
EYE_SIDES = ("left", "right")

# --- fixed values: enumerations of the result document -----------------------
VISIBILITIES = ("visible", "partially_visible", "hidden", "turned_away", "too_small", "occluded")
NOT_SCORED_VISIBILITIES = ("hidden", "too_small", "turned_away")
COUNTED_VISIBILITIES = ("visible", "partially_visible", "occluded")
FAILURE_TYPES = (
    "none",
    "defocus",
    "motion_blur",
    "subject_motion",
    "noise",
    "low_contrast",
    "overexposed",
    "hidden_eye",
    "turned_away",
    "subject_too_small",
)
NOTE_NO_DETECTION = "no_pose_detection"
NOTE_NO_EYES = "no_visible_eyes"
NOTE_SKIPPED = "skipped"
ERROR_MISSING = "file_not_found"
ERROR_DECODE = "decode_error"
ERROR_NOT_SCORED = "not_scored"

# --- fixed values: tags written into every result ----------------------------
SUMMARY_FIELD = "eye_quality"
SCORE_NAME = "eye_quality"
MODEL_NAME = "eye_quality_heuristic"
MODEL_VERSION = "0.1.0"

# --- fixed values: files and tags --------------------------------------------
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp")
SUBJECT_KEYWORDS = ("wildlife", "birds", "animals")


# --- fixed values: localisation gates ----------------------------------------
@dataclass(frozen=True)
class Gates:
    """Confidence and size gates of the localisation stage."""

    keypoint_confidence: float = 0.25
    box_confidence: float = 0.25
    box_area_share: float = 0.002
    eye_crop_px: int = 12
    clear_confidence: float = 0.45


DEFAULT_GATES = Gates()

# --- fixed values: eye geometry (pixels and shares of the head width) --------
EYE_SHARE_OF_HEAD = 0.12
EYE_BOX_FLOOR_PX = 8.0
CROP_RADIUS_FLOOR_PX = 12.0
HEAD_WIDTH_FLOOR_PX = 16.0
SHOULDER_TO_HEAD = 0.35
BOX_TO_HEAD = 0.4
BEAK_RISE_PX = 5.0
OUT_OF_FRAME_FACTOR = 0.7
TOO_SMALL_FACTOR = 0.5
SUBJECT_PAD_SHARE = 0.10

# --- fixed values: scoring ----------------------------------------------------
FOCUS_WEIGHTS = {"sharpness_score": 0.45, "clarity_score": 0.35, "edge_energy": 0.20}
LAPLACIAN_CAP = 500.0
CLARITY_CAP = 64.0
EDGE_CAP = 80.0
NOISE_CAP = 25.0
NOISE_SIGMA = 1.2
FULL_SIZE_PX = 48.0
USABLE_CROP_PX = 24
CONFIDENCE_GATE = 0.45
SMALL_CROP_FACTOR = 0.5
CAPPED_GRADE = 2
GRADE_CUTS = ((4, 0.85), (3, 0.65), (2, 0.45), (1, 0.20))
BRIGHT_MEAN, BRIGHT_SHARE, BRIGHT_LEVEL = 220.0, 0.15, 250
DARK_MEAN, DARK_SHARE, DARK_LEVEL = 35.0, 0.25, 5
SMALL_SUBJECT_FACTOR = 0.4
DEFOCUS_SHARPNESS, DEFOCUS_FOCUS = 0.15, 0.25
MOTION_FOCUS = 0.20
NOISE_LIMIT = 0.6

# --- fixed values: fusion with a base score -----------------------------------
BASE_WEIGHT, FOCUS_WEIGHT = 0.75, 0.25

# --- fixed values: 8-bit luma weights (BT.601 in 1/32768) ---------------------
LUMA_RED, LUMA_GREEN, LUMA_BLUE, LUMA_SHIFT = 9798, 19235, 3735, 15

# --- fixed values: landmark inference of the label builder --------------------
LANDMARK_PARTS = (
    "beak",
    "left_eye",
    "right_eye",
    "crown",
    "forehead",
    "left_wing",
    "right_wing",
    "nape",
)
MIRROR_SHARE, ANCHOR_SHARE, OFFSET_FLOOR_PX = 0.12, 0.10, 8.0
EYE_LINE_SHARE, SHOULDER_LINE_SHARE = 0.25, 0.45
NAPE_WEIGHT, WING_WEIGHT = 0.55, 0.45
LEFT_SHOULDER_SHARE, RIGHT_SHOULDER_SHARE = 0.28, 0.72
CATEGORY_ID, CATEGORY_NAME = 1, "bird"
VAL_RATIO, SPLIT_SEED = 0.15, 42
