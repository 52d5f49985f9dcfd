"""Fixed values of the data formats and of the recognition rules."""

# Gas channels, their bus addresses and display names.
CHANNELS = ("ch4", "o2", "co", "h2s")
SLAVE_IDS = {"ch4": 1, "o2": 2, "co": 3, "h2s": 4}
DISPLAY_NAMES = {"ch4": "CH4", "o2": "O2", "co": "CO", "h2s": "H2S"}

# Register codes of the gas module.
UNIT_CODES = {0: "ppm", 2: "%LEL", 4: "%VOL", 6: "mg/m3", 8: "ppb"}
DECIMAL_CODES = {0: 0, 4: 1, 8: 2, 12: 3}
STATUS_CODES = {
    0: "warming", 1: "normal", 2: "data_error", 3: "sensor_fault",
    4: "warning", 5: "low_alarm", 6: "high_alarm", 7: "access_fault",
    8: "over_range", 9: "calibration_required", 10: "timeout", 11: "stel_alarm",
    12: "twa_alarm", 13: "reserved", 14: "reserved", 15: "communication_fault",
}

# The two accepted gas file headers.
GAS_HEADER_EN = (
    "timestamp", "sample_id",
    "ch4_value", "ch4_unit", "ch4_status",
    "o2_value", "o2_unit", "o2_status",
    "co_value", "co_unit", "co_status",
    "h2s_value", "h2s_unit", "h2s_status",
    "error",
)
GAS_HEADER_ZH = ("时间", "编号", "CH4(%LEL)", "O2(%VOL)", "CO(ppm)", "H2S(ppm)", "状态")
GAS_UNITS_ZH = {"ch4": "%LEL", "o2": "%VOL", "co": "ppm", "h2s": "ppm"}
STATUS_OK_ZH = "正常"
STATUS_SEPARATOR = "；"

# Names in an export batch.
BATCH_ID_PATTERN = r"^inspection-export-[A-Za-z0-9][A-Za-z0-9_.-]{0,119}$"
THERMAL_NAME_PATTERN = r"(?i)^thermal_(\d{8})_(\d{6})_(\d{6})\.png$"
PHOTO_NAME_PATTERN = r"(?i)^color_(\d{8})_(\d{6})_(\d{6})\.(?:jpg|jpeg)$"
REQUIRED_FOLDERS = ("gas", "thermal", "visible")
PHOTO_CAMERA = "raspberry_pi_usb"
PHOTO_OFFSET = "+08:00"
DEFAULT_CAMERA = "go2_front"
CAPTURE_ID_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}$"
CAPTURE_STATUSES = ("received", "processed", "failed")
ITEM_STATUSES = ("pending", "running", "succeeded", "failed")
SPLITS = ("train", "val", "test")
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp")
IGNORED_FOLDERS = ("labels", "processed", "evidence", "__pycache__")
MAX_IMAGE_BYTES = 20 * 1024 * 1024

# Thermal display rules.
THERMAL_WIDTH, THERMAL_HEIGHT = 32, 24
FRAMES_PER_READING = 3
DISPLAY_LOW, DISPLAY_HIGH = 0.02, 0.98
DISPLAY_ALPHA = 0.25
DISPLAY_MIN_SPAN = 2.0

# Recognition rules.
FUSION_IOU = 0.45
METER_MIN_CONFIDENCE = 0.55
STATION_MIN_CONFIDENCE = 0.46
POINTER_MIN_CONFIDENCE = 0.55
ALLOWED_STATIONS = tuple(range(1, 11))
SEGMENT_DIGITS = {
    "abcdef": "0", "bc": "1", "abdeg": "2", "abcdg": "3", "bcfg": "4",
    "acdfg": "5", "acdefg": "6", "abc": "7", "abcdefg": "8", "abcdfg": "9",
}
MODULE_NAMES = {
    "tool_and_safety_sign": "工具 / 安全标牌",
    "coal_presence": "煤堆检测",
    "station_number": "工位编号",
    "digital_meter": "数字表",
    "analog_meter": "指针表",
}
PRIMARY_PRIORITY = {
    "station_number": 0, "digital_meter": 1, "analog_meter": 2,
    "coal_presence": 3, "tool_and_safety_sign": 4, "manual_review": 5,
    "yolo": 6, "json_replay": 7, "detector": 8,
}
OTHER_PRIORITY = 99
DETECTOR_NAMES = {
    "manual_review": "人工复核", "yolo": "YOLO 目标检测",
    "json_replay": "回放目标检测", "detector": "目标检测",
}
NOT_RECOGNIZED = "未识别成功"

# Dataset quality rules.
QC = {
    "min_width": 320, "min_height": 240,
    "dark_mean": 35.0, "bright_mean": 225.0,
    "dark_fraction": 0.55, "bright_fraction": 0.55,
    "edge_variance": 80.0,
}
SPLIT_RATIOS = {"train": 0.70, "val": 0.15, "test": 0.15}
SPLIT_SEED = "seamwatch-split"
NEAR_DUPLICATE_BITS = 4
MARKER_PADDING, CROP_PADDING = 0.04, 0.08

# Mask shifts (y, x) tried by the template matchers.
DIGIT_SHIFTS = ((0, 0), (-2, 0), (2, 0), (0, -2), (0, 2), (-1, -1), (1, 1))
STATION_SHIFTS = (
    (0, 0), (-3, 0), (3, 0), (0, -3), (0, 3), (-2, -2), (2, 2), (-2, 2), (2, -2),
)
DIGIT_SHAPE = (96, 64)
STATION_SHAPE = (96, 96)
STATION_NEAREST = 4
