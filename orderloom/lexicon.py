"""Words, patterns and numbers of the domain.

Fixed values: results depend on them exactly, so they stand here as they are
defined for the application whose answers this engine reproduces.
"""

from __future__ import annotations

# --- fixed values: language ---------------------------------------------------------------
VI_DIACRITICS = "[àáảãạăằắẳẵặâầấẩẫậđèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵ]"
ENGLISH_WORDS = r"\b(hello|hi|order|coffee|tea|recommend|what|which|where)\b"
VI_MARKERS = ["anh", "chị", "em", "cho", "món", "quán", "cà phê", "trà", "sữa", "đá", "nóng", "ngon", "giá", "wifi", "mấy giờ"]
EN_MARKERS = ["hello", "hi", "order", "coffee", "tea", "recommend", "wifi", "open", "close", "price", "menu", "pay"]
ANY_VI_MARKERS = [
    "à", "á", "ạ", "ả", "ã", "ă", "ắ", "ằ", "ẳ", "ẵ", "ặ", "â", "ấ", "ầ", "ẩ", "ẫ", "ậ", "đ", "ê", "ế", "ề", "ể", "ễ", "ệ",
    "ô", "ố", "ồ", "ổ", "ỗ", "ộ", "ơ", "ớ", "ờ", "ở", "ỡ", "ợ", "ư", "ứ", "ừ", "ử", "ữ", "ự", "quán", "món", "cho", "anh", "chị", "em", "mình",
]
EXTRACTOR_VI_MARKERS = ["đ", "ă", "â", "ê", "ô", "ơ", "ư", "anh", "chị", "em", "mình", "quán", "món", "giá", "ngon", "mật khẩu", "gợi ý", "đóng cửa", "mở cửa"]

# --- fixed values: rule router --------------------------------------------------------------
ROUTER_KEYWORDS = {
    "order": ["cho anh", "cho chị", "cho em", "cho tôi", "cho mình", "lấy anh", "lấy chị", "lấy em", "lấy tôi", "lấy mình", "gọi", "đặt", "order", "thêm", "bớt", "bỏ", "tính tiền", "thanh toán", "mua", "một ly", "1 ly", "hai ly", "2 ly", "size s", "size m", "size l", "i want", "i'd like", "can i get", "give me", "add", "remove", "checkout", "pay", "one cup", "two cups"],
    "consultant": ["gợi ý", "tư vấn", "có gì ngon", "món nào ngon", "ngon không", "nên uống", "nên chọn", "ít ngọt", "ngọt ít", "ít béo", "không đắng", "trời nóng", "trời mưa", "rẻ không", "dưới", "phù hợp", "recommend", "suggest", "what is good", "what's good", "less sweet", "not too sweet", "cheap", "budget", "best drink", "what should i drink", "mát lạnh", "đồ lạnh", "uống lạnh", "giải nhiệt", "rẻ hơn", "ngọt hơn", "đậm hơn", "dễ uống", "món nào", "uống gì"],
    "faq": ["wifi", "mật khẩu", "password", "mấy giờ", "giờ mở cửa", "giờ đóng cửa", "đóng cửa", "mở cửa", "địa chỉ", "ở đâu", "nhà vệ sinh", "toilet", "gửi xe", "giữ xe", "thanh toán momo", "momo", "visa", "chuyển khoản", "vat", "hóa đơn", "xuất hóa đơn", "khuyến mãi", "voucher", "giao hàng", "delivery", "chính sách", "opening hours", "close time", "open time", "where is", "address", "parking", "invoice", "promotion", "policy"],
    "ignore": ["ừm", "ờ", "alo", "hello", "haha", "hehe", "test", "noise", "..."],
}
QUESTION_MARKERS = ["?", "không", "ko", "hông", "à", "hả", "chưa", "what", "which", "where", "when", "how"]
MENU_HINTS = ["cà phê", "cafe", "coffee", "bạc xỉu", "latte", "trà", "tea", "trà sen", "trà đào", "freeze", "sinh tố", "bánh"]
PREFERENCE_WORDS = ["ngon", "ít ngọt", "rẻ", "recommend", "suggest", "good"]
QUANTITY = r"\b(1|2|3|4|5|một|hai|ba|bốn|năm)\b"
BASE_SCORES = {"order": 0.70, "consultant": 0.65, "faq": 0.75, "ignore": 0.45}
EXTRA_MATCH_BONUS, MAX_EXTRA_BONUS = 0.05, 0.25
QUANTITY_MENU_BONUS, MENU_ITEM_ALONE, PREFERENCE_BONUS = 0.20, 0.55, 0.15
SHORT_NOISE_CHARS, SHORT_NOISE_BONUS = 8, 0.25
ORDER_PRIORITY, NO_MATCH_SCORE, MAX_CONFIDENCE = 0.70, 0.50, 0.99
INTENTS = ["order", "consultant", "faq", "ignore"]

# --- fixed values: retrieval ----------------------------------------------------------------
STOPWORDS = ["cho", "anh", "chị", "em", "tôi", "mình", "một", "ly", "cốc", "giúp", "với", "nhé", "ạ", "ơi", "có", "gì", "không", "ko", "là", "vậy", "tên", "nào", "món", "xin", "hỏi", "quán", "những", "bên", "đây", "muốn", "gọi", "lấy", "đặt", "bán", "order", "thêm", "nữa"]
ALIASES = {
    "wifi": ["wifi", "mật khẩu", "password"],
    "mở cửa": ["mở cửa", "giờ mở cửa", "mấy giờ"],
    "đóng cửa": ["đóng cửa", "giờ đóng cửa", "mấy giờ"],
    "bạc xỉu": ["bạc xỉu", "bac xiu"],
    "cà phê": ["cà phê", "cafe", "coffee"],
    "trà": ["trà", "tea"],
    "ít ngọt": ["ít ngọt", "less sweet"],
}
FAQ_BOOST = {
    "wifi": ["wifi", "wi-fi", "internet", "mạng", "mat khau", "mật khẩu", "password"],
    "opening_hours": ["giờ", "mấy giờ", "đóng cửa", "mở cửa", "open", "close"],
    "delivery": ["ship", "giao hàng", "delivery", "mang đi", "take away"],
    "size": ["size", "kích cỡ", "cỡ ly", "s m l"],
}
LEXICAL_STOPWORDS = ["là", "gì", "của", "quán", "cho", "anh", "chị", "em", "tôi", "một", "ly", "có", "không", "the", "a", "an", "is", "are", "what"]
MAX_TERMS, MIN_TOKEN = 6, 2
TOP_K, POOL, LIMIT_PER_TERM = 5, 20, 20
MENU_NAME_SCORE, MENU_OTHER_SCORE, FAQ_SCORE, DOC_SCORE = 0.95, 0.85, 0.95, 0.70
COVERAGE_BASE, COVERAGE_WEIGHT = 0.6, 0.4
MIN_COSINE = 0.05
FUSION = {"default": (0.65, 0.35), "faq": (0.45, 0.55)}
FAQ_DOMAIN_BOOST = 0.35
EXPANSION_WEIGHT, ENTITY_FACTOR, CATEGORY_FACTOR = 0.75, 0.85, 0.65
NEIGHBOR_LIMIT, ENTITY_LIMIT, CATEGORY_LIMIT = 4, 10, 5
OVERLAP_WEIGHT, EXPANSION_PENALTY = 0.15, 0.85
ORDER_MENU_BOOST, FAQ_FAQ_BOOST, CONSULTANT_BOOST = 1.10, 1.10, 1.05
RERANK_THRESHOLD = 0.01
EMBEDDING_DIM = 1024

# --- fixed values: answer caches -------------------------------------------------------------
DOMAIN_TAGS = {
    "wifi": [r"\bwifi\b", "wi fi", "internet", "mạng", "pass", "password", "mật khẩu"],
    "opening_hours": ["mấy giờ", "giờ mở cửa", "giờ đóng cửa", "đóng cửa", "mở cửa", "open", "close", "closing"],
    "payment": ["thanh toán", "momo", "chuyển khoản", "tiền mặt", "visa", "bank", "payment", "pay"],
    "delivery": ["giao hàng", "ship", "delivery", "mang đi", "take away", "takeaway"],
    "budget": ["rẻ", "giá mềm", "tiết kiệm", "ngon rẻ", "không quá mắc", "budget", "cheap", "affordable"],
    "recommendation": ["gợi ý", "recommend", "tư vấn", "món nào", "có gì ngon", "nên uống", "dễ uống", "best"],
    "coffee": ["cà phê", "coffee", "bạc xỉu", "latte", "americano"],
    "tea": ["trà", "tea", "sen", "đào", "vải"],
}
FAQ_ALIAS_TAGS = ["wifi", "opening_hours", "payment", "delivery"]
CACHEABLE = ["faq", "consultant", "ignore"]
CACHE_TTL, CACHE_SIZE = 1800, 1000
SEMANTIC_THRESHOLDS = {"faq": 0.92, "consultant": 0.92, "ignore": 0.95}
SEMANTIC_DEFAULT = 0.92

# --- fixed values: intent extraction ----------------------------------------------------------
SUBJECT_PATTERNS = [
    r"\bcho\s+(anh|chị|em|mình|tôi|tui|bọn em|tụi em)\b",
    r"\b(anh|chị|em|mình|tôi|tui)\s+(muốn|cần|hỏi|xin|đặt|gọi|lấy|order)\b",
    r"\b(can i|could i|may i|i want|i need|i would like)\b",
]
ENGLISH_SUBJECT = r"\b(i|me|my)\b"
CONTEXT_PATTERNS = [
    r"\b(hôm nay|ngày mai|mai|tối nay|sáng nay|chiều nay|trưa nay)\b",
    r"\b(\d{1,2}h|\d{1,2}\s*giờ|\d{1,2}:\d{2})\b",
    r"\b(sinh nhật|họp|đi làm|đi học|mang đi|take away|takeaway|delivery|ship)\b",
    r"\b(\d+\s*(người|ly|cốc|phần|bạn))\b",
    r"\b(ít ngọt|không đường|nhiều đá|ít đá|nóng|đá|size\s*[sml]|size\s*[SML])\b",
    r"\b(giá mềm|giá rẻ|rẻ|budget|affordable|cheap|dễ uống)\b",
]
FILLER_EDGES = [r"^(dạ|ạ|nha|nhé|với|giúp|giúp em|cho em|cho anh|cho chị)\s+", r"\s+(nha|nhé|ạ|với|giúp em|giúp anh|được không|được hông)\s*$"]
FILLER_WORDS = r"\b(dạ|ạ|nha|nhé|với|giúp|em hỏi xíu|hỏi xíu|cho hỏi|xin hỏi)\b"
#: pattern, only for this intent, confidence, (vi action, key), (en action, key)
FAQ_RULES = [
    (r"\b(wifi|wi fi|internet|mạng|pass|password|mật khẩu)\b", None, 0.98, ("hỏi mật khẩu wifi", "mật khẩu wifi"), ("ask wifi password", "wifi password")),
    ("(mấy giờ|giờ mở cửa|giờ đóng cửa|đóng cửa|mở cửa|open|close|closing)", None, 0.96, ("hỏi giờ mở cửa đóng cửa", "giờ mở cửa đóng cửa"), ("ask opening hours", "opening hours")),
    ("(thanh toán|momo|chuyển khoản|tiền mặt|visa|bank|payment|pay)", None, 0.95, ("hỏi phương thức thanh toán", "phương thức thanh toán"), ("ask payment methods", "payment methods")),
    ("(giao hàng|ship|delivery|mang đi|take away|takeaway)", "faq", 0.94, ("hỏi chính sách giao hàng mang đi", "giao hàng mang đi"), ("ask delivery takeaway policy", "delivery takeaway policy")),
]
RECOMMEND = "(gợi ý|recommend|tư vấn|món nào|có gì ngon|nên uống|dễ uống|best)"
BUDGET = "(rẻ|giá mềm|tiết kiệm|ngon rẻ|không quá mắc|budget|cheap|affordable)"
BUDGET_PREFERENCE = "giá rẻ"
PREFERENCES = [
    ("cà phê", "(cà phê|cafe|coffee|bạc xỉu|latte|americano|cappuccino)"),
    ("trà", r"(trà|\btea\b)"),
    ("freeze", "(freeze|đá xay|blended)"),
    ("bánh", "(bánh|cake|food|ăn kèm)"),
    ("không cà phê", "(không uống cà phê|không cà phê|no coffee)"),
    ("ít ngọt", "(ít ngọt|ngọt ít|không quá ngọt|không ngọt|không đường|less sweet|not too sweet)"),
    ("ngọt", r"(?<!ít )(?<!quá )\bngọt\b(?! ít)|\bsweet\b"),
    ("đậm vị", "(đậm|mạnh|strong|tỉnh táo|tỉnh ngủ)"),
    ("giải nhiệt", "(trời nóng|giải nhiệt|mát|hot weather|refreshing)"),
    ("nóng", r"(uống nóng|đồ nóng|trời lạnh|trời mưa|\bhot drink\b)"),
    ("đồ lạnh", r"((?<!trời )lạnh|\biced\b|\bcold\b)"),
    ("béo", "(béo|sữa nhiều|creamy)"),
    ("dễ uống", "(dễ uống|nhẹ nhẹ|easy to drink|light)"),
]
PREFERENCE_OVERRIDES = {"cà phê": "không cà phê", "ngọt": "ít ngọt"}
GENERIC_ADVICE = {"vi": "gợi ý món ngon", "en": "recommend menu item"}
ADVICE_PREFIX = {"vi": "gợi ý", "en": "recommend"}
ORDER_STRIP = r"\b(cho|anh|chị|em|mình|tôi|tui|lấy|gọi|order|đặt|mua)\b"
EXTRACTION_CONFIDENCE = {"consultant_generic": 0.90, "consultant_with_preferences": 0.92, "order": 0.80, "ignore": 0.75, "fallback": 0.70}

# --- fixed values: conversations ---------------------------------------------------------------
FOLLOWUP_MARKERS = [r"^(còn|thế còn|vậy còn|vậy|thế|rồi|thêm|với lại|nhưng)\b", r"\bthì sao\b", r"\bhơn\b", r"\b(what|how) about\b", r"^(and|also)\b"]
GREETINGS = ["hello", "hi", "alo", "chào", "xin chào", "haha", "hehe", "test", "cảm ơn", "cám ơn", "thanks", "thank you", "ok", "oke"]
FOLLOWUP_INTENTS = ["consultant", "order", "faq"]
REFINE_INTENTS = ["consultant"]
FOLLOWUP_MAX_WORDS, FOLLOWUP_MAX_GAP, MAX_SEGMENTS = 8, 3, 3
SESSION_TTL, HISTORY_WINDOW, CONTEXT_TOKENS, SUMMARY_RATIO = 1800, 5, 4096, 0.7
CHARS_PER_TOKEN, SUMMARY_CHARS, TRIM_MIN, TRIM_FACTOR = 4, 200, 10, 4
RATE_LIMIT, RATE_WINDOW = 60, 60
CLAUSE_MARKS, CLAUSE_MIN = "[,.?!;:。！？؛،]+", 12

# --- fixed values: orders ------------------------------------------------------------------------
SIZE_PATTERNS = {
    "S": [r"\bsize\s*s\b", r"\bcỡ\s*s\b", r"\b(ly|size|cỡ)\s*nhỏ\b", r"\bsmall\b"],
    "M": [r"\bsize\s*m\b", r"\bcỡ\s*m\b", r"\b(ly|size|cỡ)\s*vừa\b", r"\bmedium\b"],
    "L": [r"\bsize\s*l\b", r"\bcỡ\s*l\b", r"\b(ly|size|cỡ)\s*(lớn|to)\b", r"\blarge\b"],
}
TRAILING_PARTICLES = ["ạ", "nhé", "nha", "nhe", "thôi", "đi", "luôn", "please", "đó", "nhá"]
BARE_SIZES = {"S": ["s", "nhỏ"], "M": ["m", "vừa"], "L": ["l", "lớn", "to"]}
QUANTITY_DIGITS = r"(?<![\w.,])(\d{1,2})(?![\w.,])"
QUANTITY_WITH_UNIT = r"(?<!\w)(một|hai|ba|bốn|năm|sáu|bảy|tám|chín|mười)\s+(ly|cốc|phần|cái|chiếc|suất)\b"
QUANTITY_WORDS = {"một": 1, "hai": 2, "ba": 3, "bốn": 4, "năm": 5, "sáu": 6, "bảy": 7, "tám": 8, "chín": 9, "mười": 10}
GENERIC_SIZE = r"\b(?:size|cỡ)\s*([a-z]{1,3})\b"
GENERIC_ITEM_WORDS = ["trà", "cà", "phê", "cafe", "coffee", "tea", "bánh", "freeze", "ly", "món"]
MAX_ITEM_CHOICES = 6
AVAILABILITY = [
    r"\b(có|còn)\s+bán\s+.+\s+(không|ko|k|hông|chưa)\b",
    r"\bbán\s+.+\s+(không|ko|k|hông)\b",
    r"\b(có|còn)\s+món\s+(?!nào\b).+\s+(không|ko|k|hông)\b",
    r"\b(do you (have|sell|serve))\b",
]
GENERIC_AVAILABILITY = r"^(quán\s+|bên\s+(em|mình)\s+)?(có|còn)\s+.+\s+(không|ko|k|hông|chưa)(\s+(ạ|nhỉ|vậy|thế|nha|nhé|em|anh|chị|bạn))*\s*\??$"
NON_ITEM_WORDS = ["size", "cỡ", "ly", "cốc", "phần", "cái", "chiếc", "suất", "một", "hai", "ba", "bốn", "năm", "sáu", "bảy", "tám", "chín", "mười", "đá", "nóng", "ít", "nhiều", "không", "đường", "sữa", "à", "ơi", "nhé", "nha", "ạ", "với", "và", "thôi", "luôn", "đi", "được", "dc", "k", "ko", "bạn", "anh", "chị", "em", "mình", "tôi", "tui"]
UNIT_WORDS = ["size", "cỡ", "ly", "cốc", "phần", "cái", "chiếc", "suất"]
SIZE_ORDER = {"S": 0, "M": 1, "L": 2}
PARTICLES = ["ạ", "nhé", "nha", "nhe", "nhá", "em", "anh", "chị", "bạn", "ơi", "à", "đó", "luôn", "đi", "please", "nhé em", "vậy"]
AFFIRM = ["ok", "oke", "okay", "oki", "okie", "ừ", "ừm", "uh", "uhm", "vâng", "dạ", "dạ vâng", "đúng", "đúng rồi", "chuẩn", "chuẩn rồi", "chốt", "xác nhận", "được", "được rồi", "đồng ý", "lấy", "lấy luôn", "có", "yes", "yep", "sure", "correct"]
NEGATE = ["không", "ko", "k", "hông", "thôi", "sai", "sai rồi", "không phải", "không lấy", "không đúng", "no", "nope"]
CHECKOUT = ["chốt đơn", "tính tiền", "thanh toán", "thanh toán đi", "vậy thôi", "vậy là đủ", "đủ rồi", "hết rồi", "xong rồi", "hết", "vậy đủ rồi", "checkout", "that's all", "không cần thêm", "không thêm gì", "không thêm"]
VIEW_CART = ["xem đơn", "xem lại đơn", "đơn của tôi", "đơn của mình", "đơn hiện tại", "giỏ hàng", "tôi đã gọi gì", "mình đã gọi gì", "đã gọi những gì", "kiểm tra đơn"]
CANCEL = ["hủy đơn", "huỷ đơn", "hủy hết", "huỷ hết", "bỏ hết", "xóa đơn", "xoá đơn", "không đặt nữa", "cancel order"]
REMOVE = r"^(bỏ|xóa|xoá|hủy|huỷ|không lấy|bớt|remove)\s+(?:món\s+)?(.+?)(?:\s+(?:đi|nữa|ra|nhé|nha|ạ))*$"
ORDER_QUESTIONS = ["ask_item", "ask_size", "size_unavailable"]
