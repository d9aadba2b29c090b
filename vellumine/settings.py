"""Fixed values shared by the operators.

Every table here is a default for a parameter: callers with text in another language or
domain pass their own.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from html.entities import name2codepoint

# --- character classes -------------------------------------------------------------------

# Unicode spaces normalised to an ASCII space (code points).
_WIDE_POINTS = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WIDE_SPACES = "".join(chr(p) for p in _WIDE_POINTS)

# The characters a Unicode-aware strip removes, newline listed apart.
_NARROW_POINTS = [0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85]
INLINE_SPACE = "".join(chr(p) for p in _NARROW_POINTS) + WIDE_SPACES
ANY_SPACE = "\n" + INLINE_SPACE

CJK_BASIC = "一-鿿"
CJK_NARROW = "一-龥"

# Curly quotes and their straight forms.
CURLY_QUOTES = "“”‘’"
STRAIGHT_QUOTES = "\"\"''"

# Full-width digits and letters sit at a fixed distance from ASCII.
_WIDE_ALNUM = [c for c in range(0x21, 0x7F) if chr(c).isalnum()]
# Full-width punctuation and its half-width forms.
WIDE_MARKS = "，。；：？！（）【】｛｝"
HALF_MARKS = ",.;:?!()[]{}"
FULL_WIDTH = "".join(chr(c + 0xFEE0) for c in _WIDE_ALNUM) + WIDE_MARKS
HALF_WIDTH = "".join(chr(c) for c in _WIDE_ALNUM) + HALF_MARKS

# Punctuation removed by the two punctuation steps.
CHINESE_MARKS = "，。！？；：“”‘’（）【】《》〈〉「」『』｛｝、·…—"
ENGLISH_MARKS = ".,!?;:\"'()[]{}-"

# Patterns of the cleaning steps, in the common subset of Java and RE2.
TAG_PATTERN = "<[^>]+>"
URL_PATTERN = "https?://[a-zA-Z0-9$-_@.&+!*\\\\(),%]+"
EMAIL_PATTERN = "\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z|]{2,}\\b"
SPECIAL_PATTERN = "[^" + CJK_NARROW + "a-zA-Z0-9" + ANY_SPACE + ".,!?;:()\\[\\]{}\"'-]"
CONTROL_CHARS = "[\\x00-\\x08\\x0b-\\x0c\\x0e-\\x1f]"
ZERO_WIDTH = "[" + "".join(chr(p) for p in [*range(0x200B, 0x2010), 0xFEFF]) + "]"

# Page furniture.
PAGE_FURNITURE = (
    "[0-9]+[" + ANY_SPACE + "]*/[" + ANY_SPACE + "]*[0-9]+[" + ANY_SPACE + "]*页",
    "第[" + ANY_SPACE + "]*[0-9]+[" + ANY_SPACE + "]*页",
    "(?i)page[" + ANY_SPACE + "]*[0-9]+[" + ANY_SPACE + "]*(of|/)[" + ANY_SPACE + "]*[0-9]+",
)
LIGHT_FURNITURE = ("[0-9]+/[0-9]+页", PAGE_FURNITURE[1])
# Header phrases and junk phrases dropped from the text.
HEADER_PHRASES = ("WORD格式可编辑", "专业知识整理分享", "Word文档", "可编辑")
JUNK_PHRASES = (
    "单纯的课本内容，并不能满足",
    "儿童画",
    "狐狸和鸡",
    "小鸭子学游泳",
    "后悔也来不及",
    "摘草莓的小姑娘",
    "学生的需要，通过补充",
    "儿童意愿画",
    "儿童扩散性思维",
    "情节，都是一则有趣的小故事",
)

# Named entities come from the standard library's HTML 4 table.
NAMED_ENTITIES = {name: chr(code) for name, code in name2codepoint.items()}
NAMED_ENTITIES["apos"] = "'"

# --- cleaning presets ---------------------------------------------------------------------


@dataclass(frozen=True)
class CleaningConfig:
    remove_html_tags: bool = False
    remove_whitespace: bool = True
    normalize_whitespace: bool = True
    normalize_quotes: bool = True
    convert_full_to_half: bool = True
    remove_special_chars: bool = False
    remove_urls: bool = False
    remove_emails: bool = False
    remove_numbers: bool = False
    remove_chinese_punctuation: bool = False
    remove_english_punctuation: bool = False
    trim_lines: bool = True
    remove_empty_lines: bool = True
    remove_duplicate_lines: bool = False
    custom_regex: tuple[tuple[str, str], ...] = field(default_factory=tuple)


_STRICT = dict(
    remove_special_chars=True,
    remove_html_tags=True,
    remove_urls=True,
    remove_emails=True,
    remove_duplicate_lines=True,
)
CLEANING_PRESETS = {
    "minimal": CleaningConfig(),
    "aggressive": CleaningConfig(**_STRICT),
    "text_only": CleaningConfig(remove_numbers=True, **_STRICT),
    "html_clean": CleaningConfig(remove_html_tags=True),
}

# --- stop words ---------------------------------------------------------------------------

# Stop words of the answer checker; the retrieval tokenizer adds four.
CHECK_STOP_WORDS = [
    "的", "了", "是", "在", "有", "和", "我", "你", "他", "她", "它", "这", "那", "并", "或", "但", "如果", "因为", "所以",
]
SEARCH_STOP_WORDS = CHECK_STOP_WORDS + ["如何", "什么", "为什么", "怎样"]
# Stop words of the quality gate; rewriting adds one, dialogue adds the rest.
GATE_STOP_WORDS = [
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看", "好", "自己", "这",
]
REWRITE_STOP_WORDS = GATE_STOP_WORDS + ["一个"]
DIALOGUE_STOP_WORDS = GATE_STOP_WORDS + [
    "中", "为", "来", "个", "能", "以", "可", "而", "及", "与", "或", "但", "如果", "因为", "所以", "使用", "进行", "通过", "根据", "关于", "需要", "可以", "表示", "用于",
]
# Punctuation that separates retrieval tokens.
ASCII_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SEARCH_MARKS = ASCII_MARKS + "。，、；：？！（）【】《》"
# Stop words and punctuation of the display keywords.
DISPLAY_STOP_WORDS = [
    "的", "是", "什么", "哪些", "有", "如何", "怎么", "为", "与", "和", "及", "在", "于",
]
DISPLAY_MARKS = "，。！？、；：“”‘’（）【】"
# Marks counted by the first token estimate.
ESTIMATE_MARKS = ".,;:!?，。；！？、\"'()[]{}<>"

# --- document categories ------------------------------------------------------------------

# Fixed values: (keyword, weight) per category, then title patterns, then filename keywords.
CATEGORY_KEYWORDS = {
    "financial": [
        ("报销", 3), ("差旅费", 3), ("发票", 2), ("借款", 2), ("审批", 2), ("费用", 2), ("预算", 2), ("成本", 2), ("财务", 2), ("会计", 2), ("付款", 1), ("收款", 1), ("账务", 1),
        ("审计", 1), ("票据", 1),
    ],
    "product": [
        ("产品", 2), ("功能", 2), ("用户", 2), ("使用", 1), ("介绍", 1), ("特性", 2), ("模块", 1), ("界面", 1), ("操作", 1), ("配置", 1), ("部署", 1), ("安装", 1), ("系统", 1),
        ("平台", 1), ("版本", 1), ("手册", 2), ("指南", 2), ("说明书", 2), ("白皮书", 2),
    ],
    "technical": [
        ("API", 3), ("接口", 2), ("规范", 2), ("设计", 1), ("架构", 2), ("代码", 2), ("开发", 2), ("测试", 1), ("数据库", 2), ("配置", 1), ("协议", 2), ("标准", 2), ("约定", 1),
        ("命名", 1), ("格式", 1), ("RESTful", 3), ("HTTP", 2), ("JSON", 1), ("SQL", 2), ("微服务", 2), ("DevOps", 2), ("CI/CD", 2),
    ],
    "compliance": [
        ("隐私", 3), ("政策", 2), ("安全", 2), ("合规", 3), ("法律", 2), ("制度", 2), ("规定", 2), ("条款", 2), ("同意", 1), ("授权", 1), ("数据保护", 3), ("信息安全", 3), ("保密", 2),
        ("协议", 1), ("许可", 2), ("版权", 2), ("知识产权", 2), ("免责", 1),
    ],
    "hr": [
        ("员工", 3), ("绩效", 3), ("考核", 2), ("薪酬", 2), ("福利", 2), ("入职", 2), ("离职", 2), ("请假", 1), ("考勤", 2), ("培训", 1), ("晋升", 2), ("调薪", 2), ("招聘", 1),
        ("面试", 1), ("劳动合同", 2), ("手册", 2), ("制度", 1), ("规定", 1), ("管理", 1),
    ],
    "project": [
        ("项目", 2), ("流程", 2), ("管理", 1), ("开发", 1), ("发布", 2), ("版本", 2), ("迭代", 2), ("Sprint", 2), ("需求", 1), ("测试", 1), ("部署", 2), ("上线", 2), ("回滚", 2),
        ("灰度", 2), ("评审", 1), ("里程碑", 1), ("进度", 1), ("风险", 1), ("质量", 1),
    ],
}
CATEGORY_TITLES = {
    "financial": ["报销.*管理", "费用.*管理", "差旅", "预算.*管理"],
    "product": ["产品", "手册", "指南", "说明书", "介绍", "白皮书"],
    "technical": ["规范", "标准", "API", "接口", "设计", "架构", "开发", "数据库"],
    "compliance": ["隐私", "政策", "安全", "制度", "合规", "协议"],
    "hr": ["员工", "绩效", "考核", "手册", "薪酬", "HR"],
    "project": ["流程", "管理", "开发", "发布", "版本", "项目"],
}
CATEGORY_FILENAMES = {
    "financial": ["报销", "差旅", "费用", "预算", "成本", "财务"],
    "product": ["产品", "手册", "指南", "介绍", "白皮书", "说明书"],
    "technical": ["规范", "api", "接口", "设计", "架构", "技术", "开发"],
    "compliance": ["隐私", "政策", "安全", "合规", "制度", "协议"],
    "hr": ["员工", "绩效", "考核", "手册", "薪酬", "hr"],
    "project": ["流程", "管理", "开发", "发布", "版本", "项目"],
}
POLICY_PATTERNS = ["报销", "审批", "第一章", "第.*章", "差旅费", "发票", "借款", "违规处理"]


# --- labels of expense policies -----------------------------------------------------------

# Job levels and expense types with the words that reveal them.
LEVEL_WORDS = {
    "8-9级": ["8-9级", "普通员工"],
    "10-11级": ["10-11级", "经理"],
    "12级及以上": ["12级及以上", "总监", "专家"],
}
EXPENSE_WORDS = {
    "差旅费": ["差旅", "出差", "交通工具", "住宿", "补贴"],
    "业务招待费": ["招待", "宴请", "客户", "礼品"],
    "通讯费": ["通讯", "电话", "手机"],
    "办公费": ["办公", "文具", "书籍", "软件"],
    "培训会议费": ["培训", "会议"],
}
LEGACY_LEVEL_WORDS = {
    "8-9级": ["8-9级", "普通员工", "软件研发工程师", "机械研发工程师", "工艺工程师", "实施工程师"],
    "10-11级": ["10-11级", "经理级", "经理"],
    "12级及以上": ["12级及以上", "总监", "专家级", "专家"],
}
LEGACY_EXPENSE_WORDS = {**EXPENSE_WORDS, "借款": ["借款", "备用金"]}
LEVEL_TABLE_WORDS = ["8-9级", "10-11级", "12级及以上", "普通员工", "经理", "总监", "专家"]
LEVEL_TABLE_ROWS = {
    "普通员工/8-9级": ["8-9级", "普通员工"],
    "经理/10-11级": ["10-11级", "经理"],
    "总监及以上/12级": ["12级及以上", "总监", "专家"],
}

# --- query intents and scenes ---------------------------------------------------------------

# Ordered intent rules as (intent, confidence, any-of patterns).
INTENT_RULES = [
    ("greeting", 0.95, ["^(你好|您好|嗨|hello|hi|hey|早上好|下午好|晚上好)", "^(在吗|在不在|有人吗)"]),
    ("summary", 0.9, ["总结|概括|概述|汇总|归纳"]),
    ("comparison", 0.9, ["对比|比较|区别|差异|不同|vs|versus|哪个更"]),
    ("procedure", 0.85, ["怎么|如何|步骤|流程|怎样|方法|教程|指南"]),
    ("definition", 0.85, ["是什么|什么是|定义|概念|意思|含义"]),
    ("search", 0.8, ["搜索|查找|找|查询|列出|有哪些|有什么"]),
    ("question", 0.7, ["[？?]$", "^(请问|我想知道|能否)"]),
]
INTENT_DEFAULT = ("other", 0.5)
# Hits per intent; one similarity threshold serves all.
INTENT_TOP_K = {
    "question": 5, "search": 10, "summary": 15, "comparison": 8,
    "procedure": 5, "definition": 5, "greeting": 3, "other": 5,
}
INTENT_THRESHOLD = 0.2

# Dialogue intents; a later match wins.
DIALOGUE_INTENTS = [
    ("question", ["什么", "如何", "为什么", "哪里", "什么时候", "谁", "多少"]),
    ("request", ["请", "帮我", "给我", "需要", "想要"]),
    ("feedback", ["好的", "不错", "很好", "谢谢", "感谢"]),
    ("clarification", ["什么意思", "请解释", "再说一遍", "不太明白"]),
]

# Scene patterns, written as the alternations they intend.
SCENE_HISTORY = "(?:它|这|那|此|其)个?|[该上]述的?|之?前(?:提到|说)?的?|刚才(?:提到|说)?的?"
SCENE_COMPARE = "对比|比较|区别|差异|不同|vs|versus|pk|哪个.*?更好|哪些.*?更好"
SCENE_TEMPORAL = (
    "最新|最近|今年|去年|本月|本周|今天|昨天|202[0-9]|[上下这]个?(?:月|周|季度|年)|当前|现在|目前|时下|现今"
)
SCENE_SMALL_TALK = "^(?:你好|您好|嗨|哈喽|hi|hello|谢谢|感谢|再见|拜拜|你(?:是|叫)?什么名字|你(?:能|可以)?做什么|帮助|help)"
SCENE_QUESTION_WORDS = ["什么", "怎么", "如何", "为什么", "多少", "几", "哪", "谁", "何时", "哪里"]
SCENE_CONNECTORS = [
    "并且", "而且", "同时", "另外", "还有", "以及", "首先", "其次", "最后", "第一", "第二",
]
SCENE_INTENT_WORDS = [
    "是什么", "为什么", "怎么做", "多少钱", "在哪里", "对比", "区别", "推荐", "评价", "分析",
]
SENTENCE_MARKS = "。！？；\n"
# Ambiguous words and their readings, the likeliest first.
AMBIGUOUS_WORDS = {
    "苹果": ["苹果公司", "苹果水果"],
    "java": ["Java编程语言", "爪哇岛"],
    "python": ["Python编程语言", "蟒蛇"],
    "aurora": ["极光现象", "欧若拉(罗马女神)"],
}
ROUTES = [
    ("NonRetrieval", "direct_generation"),
    ("MultiQuestion", "multi_question_decomposition"),
    ("Comparative", "comparative_analysis"),
    ("Ambiguous", "hyde_multi_hypothesis"),
    ("HistoryRef", "contextual_rewrite"),
    ("Temporal", "temporal_boost"),
]
ROUTE_DEFAULT = "standard_rag"

# Query expansion synonyms, decomposition words, reference words.
SYNONYMS = {
    "问题": ["故障", "错误", "异常"],
    "方法": ["方式", "步骤", "流程"],
    "如何": ["怎样", "怎么", "如何才能"],
    "什么": ["哪些", "什么是", "何谓"],
    "为什么": ["为何", "原因", "为何会"],
}
SPLIT_CONNECTORS = ["并且", "而且", "同时", "另外", "还有", "以及"]
BACK_REFERENCES = ["上述", "前面提到", "之前", "上面"]
COREFERENCE_WORDS = ["它", "这", "那", "此", "该", "上述", "之前"]
CONTEXT_WORDS = ["它", "这", "那", "该", "此", "其", "对方", "他们"]
HYPOTHESIS_TEMPLATES = [
    "关于'{q}'，相关信息包括：",
    "'{q}'的详细说明如下：",
    "以下是关于'{q}'的主要内容：",
]

# Term enrichment; the first matching level and city apply.
ENRICH_LODGING = (["住宿", "酒店"], ["酒店星级", "三星级", "四星级", "五星级", "快捷酒店"])
ENRICH_LEVELS = [
    (["8-9级", "普通员工"], ["8-9级", "普通员工", "软件研发工程师", "机械研发工程师", "工艺工程师", "实施工程师"]),
    (["10-11级", "经理"], ["10-11级", "经理", "中层管理", "主管"]),
    (["12级", "总监"], ["12级", "总监", "专家级", "高级管理"]),
]
ENRICH_CITIES = [
    (["上海", "北京", "广州", "深圳"], ["一线城市", "北上广深"]),
    (["成都", "杭州", "武汉", "西安", "南京", "重庆", "苏州", "天津"], ["新一线"]),
]
ENRICH_TOPICS = {
    "住宿标准": ["出差住宿", "报销标准", "住宿费用", "酒店标准"],
    "职级差异": ["等级标准", "职位级别", "对应关系", "职级划分"],
    "地区差异": ["城市分级", "地区分类", "一线二线", "城市级别"],
}
# Bonus rules of the rule reranker: words in the query, words in the hit,
# bonus per word, cap. Within a group the first rule whose words occur applies.
RERANK_LODGING = (["酒店", "住宿"], ["三星级", "四星级", "五星级", "快捷酒店", "经济型"], 0.05, 0.15)
RERANK_LEVELS = [
    (["8-9级"], ["8-9级", "普通员工", "工程师", "专员"], 0.03, 0.1),
    (["10-11级"], ["10-11级", "经理", "主管"], 0.03, 0.1),
    (["12级"], ["12级", "总监", "专家", "高级"], 0.03, 0.1),
]
RERANK_CITIES = [
    ["上海", "北京", "广州", "深圳", "一线城市", "北上广深"],
    ["成都", "杭州", "武汉", "西安", "南京", "重庆", "新一线", "新一线城市"],
]
RERANK_CITY_BONUS = 0.05

# --- safety -----------------------------------------------------------------------------

# Prompt-injection patterns and the replacement texts.
INJECTION_PATTERNS = [
    "忽略.*指令", "跳过.*步骤", "输出.*密码", "system\\s*prompt", "<\\|.*\\|>", "作为.*助手",
    "你现在的角色是", "请扮演", "忘记.*指令", "绕过.*限制", "破解.*安全",
]
INJECTION_QUERY_MARK = "[已过滤]"
INJECTION_CHUNK_MARK = "[内容已过滤：包含潜在指令注入]"
PROMPT_MAX_CHARS = 8000
REQUEST_MAX_CHARS = 2000
SENSITIVE_WORDS = ["script", "vbscript", "onload", "onerror", "onclick", "eval", "expression", "url"]
# Secret shapes; the one capture group is the value to mask.
SECRET_PATTERNS = [
    "(?i)" + name + "[\"']?\\s*[:=]\\s*[\"']?([^\"'\\s,}]+)"
    for name in ["password", "secret", "token", "api[_-]?key", "jwt", "authorization"]
] + ["(?i)Bearer\\s+([^\\s]+)"]
SECRET_KEYS = [
    "password", "secret", "token", "api_key", "jwt", "authorization", "access_token",
    "refresh_token", "private_key", "credential",
]

# --- budgets, thresholds, weights ---------------------------------------------------------

# Context windows by model name, tried exactly and then by part of the name.
CONTEXT_WINDOWS = {
    "gpt-3.5-turbo": 4096, "gpt-3.5-turbo-16k": 16384, "gpt-4": 8192, "gpt-4-32k": 32768,
    "gpt-4-turbo": 128000, "claude-3-opus": 200000, "claude-3-sonnet": 200000,
    "claude-3-haiku": 200000, "Qwen2.5-7B-Instruct": 32768, "Qwen2.5-0.5B-Instruct": 32768,
    "chatglm3-6b": 8192, "baichuan2-7b": 4096,
}
DEFAULT_WINDOW = 4096
RESERVED_TOKENS = 1150
OUTPUT_TOKENS = 500
CHUNK_LABEL_TOKENS = 20

# Quality gate weights and tiers.
GATE_WEIGHTS = {"relevance": 0.35, "diversity": 0.20, "confidence": 0.25, "recency": 0.10, "consistency": 0.10}

# Score card bands as (metric, [(at least, points)]).
SCORE_BANDS = [
    ("precision_at_1", [(0.7, 20), (0.5, 15), (0.3, 8)]),
    ("ndcg_at_5", [(0.7, 20), (0.5, 15), (0.3, 8)]),
    ("f1_at_5", [(0.7, 20), (0.5, 15), (0.3, 8)]),
    ("hit_rate", [(0.8, 15), (0.6, 10), (0.4, 5)]),
    ("topic_coverage", [(0.8, 10), (0.6, 7), (0.4, 3)]),
    ("semantic_similarity", [(0.8, 5), (0.6, 3)]),
    ("mrr", [(0.5, 5)]),
]
SCORE_TIME_BANDS = [(100, 5), (500, 3)]
SCORE_GRADES = [(85, "优秀"), (70, "良好"), (55, "一般")]
SCORE_GRADE_LOW = "需改进"

# Alert limits of the health monitor.
ALERT_LIMITS = {"cpu": 80.0, "memory": 85.0, "disk": 90.0, "response_time": 5.0, "error_rate": 5.0}
UPLOAD_EXTENSIONS = ["txt", "pdf", "docx", "md", "html", "doc"]
UPLOAD_MAX_BYTES = 50 * 1024 * 1024
