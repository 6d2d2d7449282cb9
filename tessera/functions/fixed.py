"""Word lists, lookup tables and patterns that results depend on. Order matters where a comment says so."""

from __future__ import annotations

# Materials, matched as substrings of lower-cased lines.
MATERIAL_WORDS = (
    "LED", "acrylic", "wood", "bamboo", "cotton", "foam", "PVC",
    "silicone", "fabric", "metal", "glass", "plastic", "paper",
    "screen printing", "silk", "polyurethane", "TPU", "ink",
    "fiberglass", "resin", "steel", "aluminum", "ceramic",
    "neon", "rubber", "vinyl", "linen", "canvas", "concrete",
    "sponge", "roller", "hair", "clothing", "seat", "monitor",
    "computer", "projector", "speaker", "cable", "wire", "light",
    "mirror", "stone", "marble", "granite", "copper", "bronze",
    "iron", "chrome", "titanium", "carbon", "fiber",
    "epoxy", "lacquer", "paint", "pigment", "dye", "thread",
    "rope", "string", "chain", "mesh", "net", "film", "tape",
    "printing", "print", "spray", "laser", "CNC", "3D",
    "丝网印刷", "亚克力", "硅胶", "竹", "棉", "泡沫", "金属",
    "玻璃", "塑料", "纸", "油墨", "树脂", "钢", "铝", "陶瓷",
    "霓虹", "橡胶", "帆布", "混凝土", "聚氨酯", "海绵", "滚轮",
    "显示器", "投影", "音箱", "电缆", "线", "灯", "镜", "石",
    "大理石", "花岗岩", "铜", "青铜", "铁", "铬", "钛", "碳纤维",
    "环氧", "漆", "颜料", "染料", "绳", "链", "网", "膜",
)

# Lines of credits, matched at the start of lower-cased text without regard to case.
CREDIT_PATTERNS = (
    r"^Photo(?:\s+by)?\s*:\s*.+", r"^concept\s*:\s*.+", r"^sound\s*:\s*.+", r"^software\s*:\s*.+", r"^hardware\s*:\s*.+",
    r"^computer graphics\s*:\s*.+", r"^video editing\s*:\s*.+", r"^technical support\s*:\s*.+", r"^architecture\s*:\s*.+",
    r"^interactive\s*:\s*.+", r"^dancer\s*:\s*.+", r"^actress\s*:\s*.+", r"^curated by\s+.+", r"^team\s*:\s*.+", r"^director\s*:\s*.+",
    r"^producer\s*:\s*.+", r"^editor\s*:\s*.+", r"^music\s*:\s*.+", r"^animation\s*:\s*.+", r"^design\s*:\s*.+", r"^programming\s*:\s*.+",
    r"^code\s*:\s*.+", r"^venue\s*:\s*.+", r"^location\s*:\s*.+",
    r".+:\s*[a-zA-Z]+(?:,\s*[a-zA-Z]+)*(?:;\s*[a-zA-Z\s]+:\s*[a-zA-Z]+(?:,\s*[a-zA-Z]+)*)+",
    r"made possible (?:with|by)\s+.+", r"collaboration (?:of|with)\s+.+", r"Copyright\s+(?:of|by)\s+.+",
)

# Words of type lines.
TYPE_WORDS = (
    "Video", "Installation", "Website", "Software", "Print", "Data", "Performance", "Sculpture", "Media", "Photography",
    "Painting", "Drawing", "Animation", "Game", "Application", "Sound", "Interactive", "Single channel", "Multi-channel",
    "装置", "录像", "雕塑", "摄影", "绘画", "动画", "游戏", "声音", "互动", "单频", "多频",
)

# Type spellings and their canonical names. Order matters: the first key found wins.
CANONICAL_TYPES = (
    ("installation", "Installation"), ("装置", "Installation"), ("video installation", "Video Installation"), ("视频装置", "Video Installation"),
    ("media installation", "Media Installation"), ("sound installation", "Sound Installation"), ("mixed media installation", "Mixed Media Installation"),
    ("video", "Video"), ("录像", "Video"), ("single channel video", "Single Channel Video"), ("单频录像", "Single Channel Video"),
    ("单频彩色录像", "Single Channel Video"), ("multi-channel video", "Multi-Channel Video"), ("多频录像", "Multi-Channel Video"), ("film", "Film"),
    ("document video", "Documentary Video"), ("website", "Website"), ("网站", "Website"), ("software", "Software"), ("application", "Application"),
    ("app", "Application"), ("game", "Game"), ("游戏", "Game"), ("nft", "NFT"), ("crypto", "Crypto Art"), ("print", "Print"), ("版画", "Print"),
    ("digital printing", "Digital Print"), ("数码打印", "Digital Print"), ("screen printing", "Screen Print"), ("丝网印刷", "Screen Print"),
    ("photography", "Photography"), ("摄影", "Photography"), ("painting", "Painting"), ("绘画", "Painting"), ("drawing", "Drawing"),
    ("sculpture", "Sculpture"), ("雕塑", "Sculpture"), ("media sculpture", "Media Sculpture"), ("performance", "Performance"),
    ("live performance", "Live Performance"), ("video or live performance", "Video/Performance"), ("data", "Data Art"), ("sound", "Sound Art"),
    ("声音", "Sound Art"), ("interactive", "Interactive"), ("互动", "Interactive"), ("animation", "Animation"), ("动画", "Animation"),
    ("projection mapping", "Projection Mapping"), ("projection-mapping", "Projection Mapping"), ("投影映射", "Projection Mapping"),
    ("media art", "Media Art"), ("new media", "New Media Art"), ("新媒体", "New Media Art"), ("object", "Object"), ("物件", "Object"),
)

# Tags and types of pages that are no works.
EXCLUDED_TAGS = (
    "exhibition", "solo exhibition", "group exhibition", "展览", "个展", "群展", "catalog", "catalogue", "book", "publication", "图录", "书籍", "出版物",
    "event", "talk", "lecture", "workshop", "活动", "讲座", "工作坊",
)
EXCLUDED_TYPES = ("exhibition", "solo exhibition", "group exhibition", "catalog", "catalogue", "book", "publication", "event", "talk", "lecture", "workshop")

# Equipment, materials and formats that don't belong in a type.
TYPE_POLLUTANTS = (
    "projector", "player", "screen", "monitor", "computer", "cable", "speaker", "microphone", "sensor", "raspberry", "arduino",
    "投影", "播放器", "显示器", "电脑", "音箱", "麦克风", "acrylic", "wood", "metal", "glass", "led", "pvc", "silicone", "亚克力", "金属", "玻璃",
    "chevron board", "metal frame", "linen", "canvas", "color", "彩色", "sound", "有声",
)
FORMAT_WORDS = ("color", "colour", "彩色", "sound", "有声", "silent", "无声")
EQUIPMENT_WORDS = ("projector", "player", "screen", "monitor", "computer", "投影", "播放器", "显示器", "电脑")
PHYSICAL_TYPES = ("installation", "sculpture", "print", "object")

# Sizes and durations in texts. Order matters: the first pattern that a line matches wins.
SIZE_PATTERNS = (
    r"[Ss]ize\s+(\d+\s*[×xX]\s*\d+(?:\s*[×xX]\s*\d+)?\s*(?:cm|mm|m)?)", r"(\d+\s*[×xX]\s*\d+\s*[×xX]\s*\d+\s*(?:cm|mm|m)?)",
    r"(\d+\s*[×xX]\s*\d+\s*(?:cm|mm|m)?)", r"(Dimension[s]?\s+variable\s*/\s*尺寸可变)", r"(Dimension[s]?\s+variable)", r"^(尺寸可变)$",
)
DURATION_PATTERNS = (
    "(\\d+['‘’′]\\d+['‘’′\"]+)", "(\\d+['‘’′\"]+)", "video\\s+(\\d+['‘’′\"]+)",
    r"(\d+:\d+(?::\d+)?)", r"(\d+\s*(?:min|minutes?|sec|seconds?))",
)

# Placeholders that mean nothing is known.
PLACEHOLDERS = ("null", "none", "n/a", "not specified", "unknown")
WIDE_PLACEHOLDERS = ("none", "n/a", "not specified", "none specified", "not available", "unknown", "na", "-", "", "null")

# Marks of credits, sentences, quotes and Chinese descriptions.
CREDIT_MARKS = (
    "concept:", "sound:", "software:", "hardware:", "photo:", "video editing:", "team:", "director:", "collaboration", "made possible", "curated by",
    "this piece was done", "venue", "© ",
)
SENTENCE_MARKS = (" is ", " are ", " was ", " were ", " build ", " builds ", " through ", "invit", " the ", " this ", " for ")
QUOTE_MARKS = ("\"", "“", "”", "「", "『", "'", "‘", "《")
CHINESE_MARKS = ("生于", "工作涉及", "展览", "概念", "探索", "邀请", "创作")
VIDEO_DOMAINS = ("vimeo.com", "youtube.com", "youtu.be", "bilibili.com")

# Short paths that are navigation.
NAVIGATION_PATHS = ("/rss", "/feed", "/filter", "/contact", "/cv", "/about", "/index", "/sitemap")

# Known types that can't be titles, as compared texts.
KNOWN_TYPES = (
    "installation", "video", "video installation", "performance", "sculpture", "painting", "drawing", "photography", "sound installation", "mixed media",
    "single channel video", "multi channel video",
)

# Marks by which repairs tell credits and descriptions from materials.
REPAIR_CREDIT_PATTERNS = (
    r"^Photo(?:\s+by)?:\s*.+", r"^concept:\s*.+", r"^sound:\s*.+", r"^software:\s*.+", r"^hardware:\s*.+", r"^computer graphics:\s*.+",
    r"^video editing:\s*.+", r"^technical support:\s*.+", r"^architecture:\s*.+", r"^interactive:\s*.+", r"^dancer:\s*.+", r"^actress:\s*.+",
    r"^curated by\s+.+", r"^Copyright\s+(?:of|by)\s+.+",
    r".+:\s*[a-zA-Z]+(?:,\s*[a-zA-Z]+)*(?:;\s*[a-zA-Z\s]+:\s*[a-zA-Z]+(?:,\s*[a-zA-Z]+)*)+",
    r"made possible (?:with|by)\s+.+", r"collaboration (?:of|with)\s+.+", r"Web software:\s*.+",
)
REPAIR_CREDIT_MARKS = (
    "collaboration", "made possible", "curated by", "this piece was done", "team:", "concept:", "sound:", "photo:", "director:", "venue", "copyright",
    "born in", "work involves",
)
REPAIR_SENTENCE_MARKS = (" is ", " are ", " was ", " were ", " build ", " builds ", " through ", "invit", " explore", " examine", " the ")
REPAIR_QUOTE_MARKS = ("\"", "“", "”", "「", "」", "『", "'", "‘", "《")

# Sizes and durations within materials. Order matters.
PURE_SIZE_PATTERNS = (r"^Dimension[s]?\s+variable\s*/?\s*尺寸可变$", r"^Dimension[s]?\s+variable$", r"^尺寸可变$", r"^Variable\s+dimensions?$")
EMBEDDED_DURATIONS = (
    ("video\\s+(\\d+['′\"]+)", "video\\s+\\d+['′\"]+"), ("(\\d+['′]\\s*\\d+['′\"]+)", "\\d+['′]\\s*\\d+['′\"]+"),
    (r"(\d+:\d+(?::\d+)?)", r"\d+:\d+(?::\d+)?"), (r"(\d+\s*min(?:utes?)?)", r"\d+\s*min(?:utes?)?"),
)
EMBEDDED_SIZES = (
    (r"Dimension[s]?\s+variable\s*/\s*尺寸可变", "Dimension variable / 尺寸可变"), (r"Dimension[s]?\s+variable", "Dimension variable"), ("尺寸可变", "尺寸可变"),
    (r"[,;]?\s*size\s+(\d+\s*[×xX]\s*\d+(?:\s*[×xX]\s*\d+)?\s*(?:cm|mm|m)?)", None), (r"[,;]?\s*(\d+\s*[×xX]\s*\d+(?:\s*[×xX]\s*\d+)?\s*(?:cm|mm)?)\s*[,;]?", None),
)
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"

# Lines of pages that are no content, matched from their start without regard to case.
INTERFERENCE_LINES = (
    r"^Previous$", r"^Next", r"^\(?(\d+)\s+of\s+(\d+)\)?$", r"^Fullscreen$", r"^\.vimeo$", r"^\.youku$", r"^\.pdf$", r"^\.video$", r"^https?://", r"^\d{5}\s+\w+",
    r"^Schöneberger|^Berlin|^Tiergarten",
)

# Words by which lines of pages are no types or no materials.
SIZE_MARKS = ("variable size", "尺寸可变", "dimension variable", "dimensions variable", "variable media")
TYPE_STARTERS = ("weigh", "the ", "invite", "prep", "准备", "每周", "使用", "神秘")
LINE_SENTENCE_WORDS = (" is ", " are ", " was ", " were ", " can ", " will ", " should ", " the ", " this ", " that ", " with ")
BLOCK_SENTENCE_WORDS = (" is ", " are ", " was ", " were ", " can ", " will ", " should ", " the ", " this ", " with ")
LINE_CREDIT_MARKS = ("collaboration", "made possible", "curated by", "this piece was done", "team:", "concept:", "sound:", "photo:", "director:", "venue", "© ", "copyright")
LINE_VERBS = (" build ", " builds ", " through ", " invit", " explore", " examine", " question", " reflect", " represent", " create")
LINE_STARTERS = ("the", "for", "in", "a", "an", "this", "it", "was", "is", "are")
LINE_QUOTES = ("\"", "「")
ADDRESS_WORDS = ("venue", "unit", "no.", "road", "street", "avenue", "building", "floor", "museum", "gallery", "center", "centre")
PART_STARTERS = ("the", "a", "an", "is", "are", "was", "were", "has", "have", "and")

# Lines of events and addresses, which describe no work.
EVENT_LINE = r"\b(Opening|Exhibition|Gallery|Museum)\b.*\d{4}"
ADDRESS_LINE = r"\d+\s+\w+\s+(Street|Road|Ave|Blvd|路|街|号)"

# Durations, sizes and years within a type.
TYPE_DURATION = "\\d+['‘’′\"]{1,2}\\d*['‘’′\"]*"
TYPE_MINUTES = r"\d+\s*(?:min(?:utes?)?|seconds?)[^,]*"
TYPE_SIZE = r"\d+\s*(?:cm|mm|m)?\s*[×xX]\s*\d+\s*(?:cm|mm|m)?(?:\s*[×xX]\s*\d+\s*(?:cm|mm|m)?)?"
TYPE_YEARS = r",?\s*20\d{2}\s*[-–]\s*20\d{2}\s*,?"

# Sizes and durations in the lines of a page. Order matters.
LINE_SIZES = (
    r"(Dimension[s]?\s+variable\s*/?\s*尺寸可变)", r"(Dimension[s]?\s+variable)", r"(尺寸可变)", r"(Variable\s+size)", r"(各种尺寸)",
    r"(\d+\s*(?:cm|mm|m)?\s*[×xX\*]\s*\d+\s*(?:cm|mm|m)?(?:\s*[×xX\*]\s*\d+\s*(?:cm|mm|m)?)?)",
)
LINE_DURATIONS = (
    "(\\d+['‘’′]\\d+['‘’′\"]{1,2})", "^(\\d+['‘’′\"]+)$", r"(\d+:\d+(?::\d+)?)", r"(\d+\s*(?:min|minutes?|sec|seconds?))",
)

# Images that are no works, and extensions of images.
SKIPPED_IMAGES = ("thumbnail", "thumb_", "favicon", "/icons/", "logo", "avatar", "placeholder", "loading", "spinner", "/assets/", "1x1.gif", "blank.gif")
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".avif")

# How small-letter descriptions introduce a work.
QUOTED_WORK = r'(?U)^["“”]([^"“”]+)["“”]\s+is\s+(?:a|an)\s+'
NAMED_WORK = r"(?U)^(\w[\w\s,\.]{1,30})\s+is\s+(?:a|an)\s+(?:\w+\s+){0,3}(?:artwork|installation|video|performance|piece|work|project)"

# Works whose texts are known to leak into other pages.
LEAKING_WORKS = ("guard", "one ritual", "two rituals", "absurd reality check")

# Lines and line starts of Markdown that name a page's type.
EXHIBITION_LINES = ("exhibition", "solo exhibition", "group exhibition")
CATALOG_LINES = ("catalog", "catalogue")
MARKDOWN_TYPES = r"video\s*installation|installation|video|performance|website|software|media\s*sculpture"

# Types by which a work's missing fields are told.
VIDEO_TYPES = ("video", "film", "animation")
MADE_TYPES = ("installation", "sculpture", "object", "print", "painting", "media")
DIGITAL_TYPES = ("website", "software", "app", "game", "nft", "crypto")
