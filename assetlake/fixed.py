"""Fixed values of the data model: names, word lists, limits and formats that results depend on."""

# ---- fixed values: asset classes, report order -------------------------------------------
CLASS_ORDER = [
    "maintex", "normal", "mask", "height", "emission", "reflection", "matcap", "highcolor", "other",
]

# ---- fixed values: keywords that put a property into a class, highest priority first ---------
CLASS_KEYWORDS = [
    ("mask", ["mask"]),
    ("normal", ["normal", "bump"]),
    ("height", ["parallax", "height"]),
    ("maintex", ["maintex", "main_tex"]),
    ("emission", ["emission", "emitt"]),
    ("reflection", ["reflection", "reflective"]),
    ("matcap", ["matcap"]),
    ("highcolor", ["highcolor", "high_color"]),
]

# ---- fixed values: classes whose pixels are data, not colour -----------------------------------
DATA_CLASSES = ["normal", "mask", "height"]

# ---- fixed values: case-sensitive property words that rule out a lossy format under "auto" -------
RISKY_WORDS = ["Bump", "Mask", "Normal"]

# ---- fixed values: owner key layout -----------------------------------------------------------
OBJ_CLOTHES, OBJ_ACCESSORY, OBJ_BODY = 1, 2, 3
ACCESSORY_BASE, BODY_BASE, GROUP_BASE = 1000, 2000, 100000
BODY_GROUP = 0
MAX_MASK_GROUP = 30

# ---- fixed values: clothes slots 0..8, machine token and display name --------------------------
SLOT_TOKENS = ["top", "bot", "bra", "shorts", "gloves", "panst", "socks", "shoes_inner", "shoes_outer"]
SLOT_NAMES = [
    "上衣 top", "下衣 bot", "胸罩 bra", "内裤 shorts", "手套 gloves",
    "连裤袜 panst", "袜子 socks", "鞋(内层) shoes_inner", "鞋(外层) shoes_outer",
]
BODY_NAME = "身体/脸/头发/眼睛"
CLOTHES_SLOT_PREFIX = "服装槽 "
ACCESSORY_SLOT_PREFIX = "饰品槽 "

# ---- fixed values: groups; 0 is the body, 1..7 the outfits ---------------------------------------
BODY_GROUP_NAME = "角色本体"
GROUP_NAMES = [
    "换装1 School01", "换装2 School02", "换装3 Gym", "换装4 Swim", "换装5 Club", "换装6 Plain", "换装7 Pajamas",
]
GROUP_PREFIX = "换装"
GROUP_SLOT_SEPARATOR = " · "

# ---- fixed values: return codes -------------------------------------------------------------------
RC_TEXT = {
    0: "ok",
    2: "not a container (no image end)",
    3: "no assets inside",
    4: "broken asset dictionary",
    5: "cancelled",
    6: "does not match the preset, skipped",
}
RC_UNKNOWN_PREFIX = "unknown code "

# ---- fixed values: how conservative a format is, lower wins a merge ------------------------------------
FORMAT_RANK = {"keep": 0, "png": 1, "auto": 2, "jpeg": 3, "jpg": 3}
UNKNOWN_FORMAT_RANK = 2

# ---- fixed values: format and size words accepted in free text -----------------------------------------
FORMAT_WORDS = {"自动": "auto", "原样不动": "keep", "原样": "keep", "jpg": "jpeg"}
NO_SCALING_WORDS = ["不缩放", "原尺寸", "无"]
BODY_WORDS = ["body", "本体"]

# ---- fixed values: limits ---------------------------------------------------------------------------------
OWN_MAX = 4096
UP_CEILING = 4096
HEAD_BYTES = 1 << 20
HDR_HEADER_LINES = 64
REPORT_PROPERTY_CHARS = 56

# ---- fixed values: built-in plans, (format, size) for maintex and for every other class -------------------
BUILTIN_PLANS = {
    "default": (("auto", 1024), ("keep", 0)),
    "optimise": (("auto", 0), ("auto", 0)),
    "quality": (("auto", 2048), ("auto", 1024)),
    "performance": (("auto", 1024), ("auto", 512)),
    "aggressive": (("auto", 1024), ("auto", 512)),
}

# ---- fixed values: luminance weights (r, g, b) and shift -------------------------------------------------------
LUMA = (77, 151, 28)

# ---- fixed values: container bytes -------------------------------------------------------------------------------
PNG_MAGIC_HEX = "89504E470D0A1A0A"
KEY_ASSETS = "TextureDictionary"
KEY_BINDINGS = "MaterialTexturePropertyList"
KEY_SHADERS = "MaterialShaderList"
TAG_WORD, TAG_CHARA, TAG_CLOTHES = "KoiKatu", "Chara", "Clothes"
