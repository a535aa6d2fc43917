"""Fixed values that decide results.  Operators take them as default parameters."""

from __future__ import annotations

# --- fixed values: label vocabulary -------------------------------------------------------
CLASS_PROMPTS = {
    "bed": "bed",
    "chair": "chair",
    "table": "table",
    "door": "door",
    "tv": "television",
    "wardrobe": "wardrobe",
    "cabinet": "cabinet",
    "drawer": "drawer",
    "shelf": "shelf",
    "mirror": "mirror",
    "desk": "desk",
    "sofa": "sofa",
    "lamp": "lamp",
    "fan": "ceiling fan",
    "light": "light fixture",
    "curtain": "fabric curtain hanging over a window",
    "window": "window",
    "rug": "rug",
    "pillow": "pillow",
    "blanket": "loose blanket on top of a bed",
    "bag": "bag",
    "shoe": "shoe",
    "bottle": "bottle",
    "book": "book",
    "plant": "indoor plant",
    "picture_frame": "picture frame",
    "miscellaneous": "miscellaneous room object",
}
CLASS_PROMPT_ALIASES = {
    "bed": ["mattress"],
    "chair": ["armchair", "stool"],
    "table": ["bedside table", "nightstand"],
    "door": ["room door"],
    "tv": ["computer monitor", "television screen"],
    "wardrobe": ["closet"],
    "cabinet": ["cupboard"],
    "desk": ["writing desk", "work desk"],
    "sofa": ["couch"],
    "lamp": ["table lamp", "floor lamp"],
    "fan": ["standing fan", "electric fan"],
    "light": ["ceiling light"],
    "curtain": ["window drape"],
    "window": ["window pane"],
    "pillow": ["cushion", "bed pillow"],
    "blanket": ["folded blanket", "folded duvet", "folded quilt"],
    "bag": ["backpack", "handbag", "suitcase", "duffel bag"],
    "rug": ["carpet", "floor rug", "mat"],
    "shoe": ["footwear", "slipper"],
    "bottle": ["water bottle"],
    "plant": ["potted plant"],
    "picture_frame": ["photo frame", "wall art"],
    "miscellaneous": [
        "headboard", "switchboard", "electrical panel", "power outlet", "wall socket",
        "wall switch", "extension board", "remote control", "wall clock", "smoke detector",
    ],
}
CORE_LABELS = [
    "bed", "chair", "table", "door", "tv", "wardrobe", "cabinet", "desk", "sofa", "curtain",
    "window",
]
PROMPT_PROFILES = {
    "room_details": {
        "trigger_labels": [],
        "labels": [
            "drawer", "shelf", "mirror", "lamp", "fan", "light", "rug", "plant", "picture_frame",
        ],
    },
    "bedroom": {
        "trigger_labels": ["bed", "wardrobe"],
        "labels": ["pillow", "blanket", "bag", "shoe"],
    },
    "workspace": {
        "trigger_labels": ["desk", "table"],
        "labels": ["book", "bottle", "bag"],
    },
    "living_room": {
        "trigger_labels": ["sofa", "tv"],
        "labels": ["pillow", "blanket", "book", "bottle", "bag"],
    },
}
CORE_PROMPT_ALIASES = {
    "table": ["nightstand"],
    "tv": ["computer monitor"],
    "wardrobe": ["closet"],
    "sofa": ["couch"],
}
PROFILE_PROMPT_ALIASES = {
    "room_details": {
        "rug": ["carpet"], "plant": ["potted plant"], "picture_frame": ["wall art"],
    },
    "bedroom": {
        "pillow": ["cushion", "bed pillow"],
        "blanket": ["folded blanket", "folded duvet"],
        "bag": ["backpack", "suitcase"],
    },
    "workspace": {"bag": ["backpack"], "bottle": ["water bottle"]},
    "living_room": {"pillow": ["cushion"], "blanket": ["folded duvet"], "bag": ["backpack"]},
}
MISC_PROMPT_PROFILES = {
    "room_details": [
        "switchboard", "electrical panel", "power outlet", "wall socket", "wall switch",
        "extension board", "wall clock", "smoke detector",
    ],
    "bedroom": ["headboard", "remote control"],
    "workspace": ["remote control"],
    "living_room": ["remote control"],
}
ALWAYS_ACTIVE_PROFILES = ["room_details"]
GENERIC_PROMPTS = [
    "small unidentified room object", "small household object", "wall-mounted object",
]

# --- fixed values: detection gates --------------------------------------------------------
DETECTION_THRESHOLDS = {
    "bed": 0.40, "chair": 0.34, "table": 0.36, "door": 0.36, "tv": 0.34, "wardrobe": 0.38,
    "cabinet": 0.36, "drawer": 0.34, "shelf": 0.34, "mirror": 0.36, "desk": 0.38, "sofa": 0.38,
    "lamp": 0.32, "fan": 0.34, "light": 0.34, "curtain": 0.48, "window": 0.36, "rug": 0.34,
    "pillow": 0.28, "blanket": 0.46, "bag": 0.28, "shoe": 0.30, "bottle": 0.30, "book": 0.30,
    "plant": 0.32, "picture_frame": 0.34, "miscellaneous": 0.34,
}
MAX_BOX_FRACTION = {
    "bed": 0.70, "curtain": 0.55, "door": 0.60, "window": 0.60, "rug": 0.50, "wardrobe": 0.65,
    "sofa": 0.65, "chair": 0.45, "desk": 0.50, "pillow": 0.30, "blanket": 0.35, "bag": 0.35,
    "miscellaneous": 0.60, "book": 0.18, "bottle": 0.15, "shoe": 0.18,
}
MAX_MASK_FRACTION = {
    "bed": 0.70, "curtain": 0.60, "door": 0.60, "window": 0.60, "rug": 0.55, "wardrobe": 0.70,
    "sofa": 0.70, "chair": 0.45, "desk": 0.55, "pillow": 0.30, "blanket": 0.38, "bag": 0.40,
    "miscellaneous": 0.60, "book": 0.18, "bottle": 0.15, "shoe": 0.18,
}
DEFAULT_MAX_FRACTION = 0.70
MIN_BOX_FRACTION = 0.00015
GENERIC_THRESHOLD = 0.42
GENERIC_MAX_FRACTION = 0.20
NMS_IOU = 0.50
GENERIC_OVERLAP_IOU = 0.20
GENERIC_CONTAINMENT = 0.65
PROMPT_KIND_RANK = {"named_fallback": 3, "canonical": 2, "alias": 2, "generic_fallback": 1}
CURTAIN_WINDOW_IOS = 0.08
CURTAIN_WINDOW_DISTANCE = 0.20
CURTAIN_ALONE_CONFIDENCE = 0.86
BLANKET_OVERLAP = 0.80
BLANKET_AREA_RATIO = 0.55

# --- fixed values: tracks and masks -------------------------------------------------------
ANCHOR_STRIDE = 8
MAX_ANCHOR_GAP = 24
TRACK_IOU = 0.10
TRACK_DISTANCE = 0.28
TRACK_AREA_RATIO = 0.25
TRACK_MIN_ANCHORS = 2
TRACK_STRONG_SINGLE = 0.52
MAX_INSTANCES = {
    "bed": 2, "desk": 3, "table": 4, "door": 4, "tv": 3, "wardrobe": 3, "cabinet": 5, "sofa": 2,
    "chair": 8, "pillow": 10, "bag": 8, "miscellaneous": 12,
}
DEFAULT_MAX_INSTANCES = 6
MIN_MASK_FRACTION = 0.00010
MIN_STABILITY = 0.80
MIN_QUALITY = 0.55
MIN_LARGEST_COMPONENT = 0.50
MIN_BIDIRECTIONAL_IOU = 0.20
DEFAULT_AGREEMENT = 0.55
VISIBILITY_MARGIN = 12
MIN_ANCHOR_BOX_IOU = 0.10
MAX_AREA_JUMP = 5.0
MIN_VISIBLE_FRAMES = 3
MIN_REMAINING = 0.35
MAX_COMPONENTS = 2
MIN_COMPONENT_RATIO = 0.02
MIN_COMPONENT_PIXELS = 4
MAX_HOLE_PIXELS = 64
OVERLAP_PRIORITY = {
    "pillow": 1.35, "blanket": 1.20, "bag": 1.35, "book": 1.25, "bottle": 1.25, "shoe": 1.20,
    "lamp": 1.15, "fan": 1.15, "light": 1.15, "picture_frame": 1.15, "miscellaneous": 1.15,
    "window": 1.05, "rug": 1.10, "bed": 1.00, "desk": 1.05, "chair": 1.05, "curtain": 0.90,
}
STRUCTURE_LABELS = ["wall", "floor", "ceiling"]
STRUCTURE_MIN_PROBABILITY = {"wall": 0.50, "floor": 0.45, "ceiling": 0.45}
STRUCTURE_MIN_AREA = {"wall": 0.01, "floor": 0.01, "ceiling": 0.003}
STRUCTURE_CUTOUT_CONFIDENCE = 0.55
STRUCTURE_CLOSE = 9
STRUCTURE_OPEN = 3
AGREEMENT_SCORE = 0.50

# --- fixed values: label voting -----------------------------------------------------------
NEAR_M = 0.05
FAR_M = 20.0
FOOTPRINT_SIGMA = 2.0
FOOTPRINT_FALLBACK_RADIUS = 0.015
FOOTPRINT_MIN_PX = 1.0
FOOTPRINT_MAX_PX = 18.0
FOOTPRINT_MIN_COVERAGE = 0.20
# dx, dy (fractions of the radius) and weight
FOOTPRINT_OFFSETS = [
    (0.0, 0.0, 1.0),
    (0.50, 0.0, 0.70), (-0.50, 0.0, 0.70), (0.0, 0.50, 0.70), (0.0, -0.50, 0.70),
    (0.45, 0.45, 0.50), (-0.45, 0.45, 0.50), (0.45, -0.45, 0.50), (-0.45, -0.45, 0.50),
]
DEPTH_ABS = 0.18
DEPTH_REL = 0.08
ZBUFFER_ABS = 0.25
ZBUFFER_REL = 0.10
ZBUFFER_RADIUS = 2
WEIGHT_RENDERED = 1.0
WEIGHT_ZBUFFER = 0.65
WEIGHT_NO_DEPTH = 0.35
SURFACE_LABELS = ["wall", "floor", "ceiling"]
SURFACE_WEIGHTS = {"wall": 0.05, "floor": 0.85, "ceiling": 0.85}
OBJECT_WEIGHT = 1.50
OBJECT_DILATION = 2
SUPPRESSION_DILATION = 4
FREQUENCY_POWER = 0.5
AREA_REFERENCE = 0.04
WEIGHT_MIN = 0.20
WEIGHT_MAX = 3.00
MIN_MASK_SCORE = 0.05
FOREGROUND_DELTA = 0.15
FOREGROUND_PERCENTILE = 0.35
FOREGROUND_RING = 10
FOREGROUND_MIN_PIXELS = 80
FOREGROUND_EXEMPT = [
    "door", "window", "fan", "light", "mirror", "picture", "wall", "floor", "ceiling",
]
HEIGHT_LOW, HEIGHT_HIGH, HEIGHT_MARGIN = 0.12, 0.88, 0.35
MIN_TOTAL_VOTE = 1.0
MIN_SUPPORT_VIEWS = 1
MIN_MARGIN = 0.10

# --- fixed values: objects ----------------------------------------------------------------
MIN_OBJECT_POINTS = 80
STRUCTURAL_OBJECT_LABELS = ["wall", "floor", "ceiling", "door", "window"]
DBSCAN_EPS = 0.35
DBSCAN_MIN_SAMPLES = 30

# --- fixed values: video frame selection --------------------------------------------------
CONTINUITY_MIN_GAP = 6
CONTINUITY_MAX_GAP = 28
CONTINUITY_MIN_DIFF = 6.5
CONTINUITY_MAX_DIFF = 45.0
CONTINUITY_RECENT = 5
ANCHOR_MIN_GAP, ANCHOR_MIN_DIFF, ANCHOR_MAX = 40, 10.0, 25
LOOP_MIN_GAP, LOOP_MIN_DIFF, LOOP_MAX = 35, 8.0, 60
LOOP_PAIR_GAP, LOOP_PAIR_HAMMING, LOOP_PAIR_MATCHES, LOOP_PAIR_MAX = 120, 50, 30, 20
TOTAL_FRAMES = 180
