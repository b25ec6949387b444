"""Parameters, word lists and patterns that results depend on."""

# Retrieval parameters.
TOP_K = 5
VECTOR_TOP_N, BM25_TOP_N, TOP_SCENES = 20, 20, 3
BEFORE, AFTER = 2, 1
ROUTE_BOOKS, BOOK_CAP = 5, 3
BM25_K1, BM25_B = 1.5, 0.75
VECTOR_WEIGHT, BM25_WEIGHT = 0.8, 0.2
RESCUE_RANK, RESCUE_MIN_BM25, RESCUE_MIN_RARE, RESCUE_MIN_SCORE, RESCUE_MARGIN = 5, 0.35, 0.2, 0.45, 0.08
RESCUE_BM25, RESCUE_RARE, RESCUE_VECTOR = 0.7, 0.2, 0.1
RERANK_CANDIDATES, WIDE_TOP_N = 30, 100
EVAL_SAMPLE, EVAL_SEED, RECALL_AT = 50, 42, (1, 3, 5)
REWRITE_LIMIT, DAILY_QUOTA, PREVIEW_CHARS = 3, 5, 220

# Chunking parameters.
CHUNK_TARGET, CHUNK_MAX, CHUNK_OVERLAP = 800, 1000, 3

# Labels and sentinels.
NO_SCENE, SCENE_SEPARATOR = "scene-000", "★★★"
UNKNOWN_BOOK, UNKNOWN_BOOK_EVAL = "未知书籍", "unknown"

# Code-point ranges whose runs are cut into grams of 2, 3 and 4.
CJK_RANGES = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF))
GRAMS = (2, 3, 4)

# Words that never count as rare.
RESCUE_STOP_TERMS = ("什么", "哪些", "多少", "如何", "为何", "为什么", "是谁", "根据", "原文", "小说", "片段", "主角", "他们", "她们", "这个", "那个", "时候")
# Marks of an answer without evidence.
INSUFFICIENT_MARKS = ("没有足够信息", "没有足够的信息", "信息不足", "无法确认", "无法回答", "原文未提供", "原文中未提供", "不能确定")

# Five shapes of a chapter title.
CHAPTER_TITLE = (
    r"^第.+?(?:卷|章)\s+.+?(?:第[一二三四五六七八九十百千万零〇\d]+[话話]|[闲閒][话話]).*$"
    r"|^第[一二三四五六七八九十百千万零〇\d]+[话話]\s*.*$"
    r"|^(?:.+\s+)?(?:序章|终章|終章)$"
    r"|^[闲閒][话話].*$"
    r"|^外[传傳].*$"
)
STAR_LINE = r"^★(?:\s*★){2,}$"
TOC_HEADINGS = ("CONTENTS", "目录", "目錄")
SENTENCE_ENDS = "。！？!?"

# Beginnings of credit lines.
CREDIT_PREFIXES = (
    "作者", "插画", "插畫", "台版", "网译版", "转自", "图源", "扫图", "录入", "錄入", "修图", "校对", "翻译",
    "译者", "譯者", "轻之国度", "輕之國度", "购书人", "深夜读书会", "读书群", "仅供", "僅供", "下载", "下載", "请尊重", "請尊重",
)
# E-book members that are no body text, by a part of the name or by the stem.
SKIPPED_PARTS = ("backcover", "cover", "illustration", "introduction", "logo", "message", "title")
SKIPPED_STEMS = ("chapter00",)
# HTML tags that end a paragraph, and those whose content is left out.
BLOCK_TAGS = {
    "address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "figcaption", "footer", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul",
}
IGNORED_TAGS = {"head", "script", "style", "svg"}
