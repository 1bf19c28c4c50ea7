"""Word lists, maps and weights that results depend on."""

# Types as they are written, and the canonical type (construction).
TYPE_ALIASES = {
    "paper": "论文", "author": "作者", "organization": "机构", "institution": "机构", "journal": "期刊", "technology": "技术",
    "technique": "技术", "method": "研究方法", "framework": "研究方法", "topic": "研究主题", "theme": "研究主题", "scenario": "教学场景",
    "field": "教育领域", "教学模式": "研究方法", "人才培养模式": "研究方法", "研究理论": "研究主题", "教育理念": "研究主题",
}
GENERIC_NAMES = ("教学模式", "研究理论", "教育理念", "人才培养模式")
AUTHOR_BLACKLIST = ("编辑部", "本刊", "记者", "评论员", "导读", "选题", "活动", "指南")
# In this order, the first that occurs anywhere cuts the name.
ORGANISATION_SUFFIXES = ("大学", "学院", "中学", "小学", "学校", "研究院", "研究所", "图书馆", "出版社", "医院", "中心", "实验室")
RELATION_SYNONYMS = {"提出了": "提出", "提出的": "提出", "发表于于": "发表于", "发布于": "发表于", "应用于": "应用于", "用于": "应用于", "基于": "基于"}
FACT_INTENT = ("谁", "作者", "撰写", "提出", "框架", "方法", "期刊", "发表于", "是什么", "who", "author", "framework", "method")
WEAK_RELATIONS = ("member_of", "keyword_of", "describes", "represented_by", "kw_filter_by")
KEY_FACT_RELATIONS = ("撰写", "提出", "定义", "应用于", "聚焦")
RELATION_BOOST = {"撰写": 0.15, "提出": 0.12, "定义": 0.10, "发表于": 0.08, "应用于": 0.06, "聚焦": 0.04}
EXACT_MATCH_RELATIONS = ("撰写", "提出", "发表于", "采用", "聚焦")
WEAK_PENALTY = 0.2
STRUCTURED_RELATIONS = ("撰写", "隶属", "发表于")
STRUCTURED_ATTRIBUTES = ("年份:", "关键词:", "来源:")
REFUSAL_MARKERS = ("无法回答", "不能回答", "现有资料不足", "insufficient", "cannot answer", "not enough information")
MOJIBAKE_MARKERS = ("鏂", "鍏", "馃", "浼", "璁", "锛", "锟", "烘", "缁", "骞")
ENTITY_ALIASES = {
    "技术": {
        "生成式人工智能": [
            "AIGC", "GenAI", "生成式AI", "人工智能生成内容", "生成式人工智能(AIGC)", "生成式人工智能（AIGC）", "人工智能生成内容(AIGC)", "人工智能生成内容（AIGC）",
        ]
    }
}
LENGTH_BINS = ("<=200", "201-400", "401-800", ">800")
JUDGE_WEIGHTS = (0.30, 0.20, 0.20, 0.15, 0.15)
