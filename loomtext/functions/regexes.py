"""Patterns, spelled for Java (Spark). Whitespace is Unicode white space, spelled out, since Java's ``\\s`` is ASCII."""

#: Unicode white space as one class body.
WS_BODY = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{WS_BODY}]"
NON_WS = f"[^{WS_BODY}]"
DIGIT = r"\p{Nd}"
COLON = "[:：]"
HTML = "(?d)</?[a-zA-Z][^>]*>"
URL = f"(?d)https?://{NON_WS}+"
QA_URL = f"(?d)https?://{NON_WS}+|www\\.{NON_WS}+"
ZH = r"[\u4e00-\u9fff]"
# Rows that any of these hits are advertisements, or junk of encyclopedia dumps.
AD = [
    f"咨询.*[热线电].*{COLON}?{WS}*{DIGIT}{{3,}}",
    f"(?:活动|加盟|招商|订[购车]).*[热线电].*{COLON}?{WS}*{DIGIT}{{3,}}",
    f"[热线电话]{COLON}{WS}*{DIGIT}{{3,}}",
    f"[Qq]{{2}}{COLON}{WS}*{DIGIT}{{5,}}",
    f"(?:微信|加微信|V信|vx){COLON}{WS}*{NON_WS}+",
    "扫码|扫一扫|关注公众号|添加客服",
    "点击.*链接|立即.*下载|限时.*抢购|免费.*领取",
    f"{DIGIT}{{3,}}[-—]{DIGIT}{{3,}}[-—]{DIGIT}{{3,}}",
    "(?:直营店|加盟店|连锁店|分店).*(?:覆盖|遍布|全国)",
    "(?:特价|优惠|折扣|促销|限时|团购).*(?:活动|进行|开启)",
    "史上最低|年终大促|亏本甩卖|跳楼价",
    "名额有限|先到先得|抢购|火爆.*中",
]
WIKI = ["镇区人口有", "涵盖总面积为", "(?:美国|United States).*人口普查", "座标为", "非建制地区", "海拔高度为.*(?:米|英尺)"]
# Question and answer forms, tried in this order. The fourth may stand anywhere.
QA = [
    f"(?d)^问题：(.+?){WS}*回答：(.+)",
    f"(?dis)^Q{WS}*{COLON}{WS}*([^\\n]+?){WS}+A{WS}*{COLON}{WS}*([^\\n]+)",
    f"(?d)^问{WS}*{COLON}{WS}*(.+?){WS}*答{WS}*{COLON}{WS}*(.+)",
    f'(?d)"question"{WS}*:{WS}*"(.+?)".*?"answer"{WS}*:{WS}*"(.+?)"',
    "(?d)^(.+?)\\t(.+)",
]
# Sentence ends; the classes of single characters, in ranges.
SENTENCE = "[^。！？；\\n]+|[。！？；\\n]+"
CJK = r"[\u4e00-\u9fff\u3400-\u4dbf\uf900-\ufaff]|[\u3000-\u303f\uff00-\uffef]|[^\u4e00-\u9fff\u3400-\u4dbf\uf900-\ufaff\u3000-\u303f\uff00-\uffef]+"


def re2(pattern: str) -> str:
    """The same pattern for DuckDB: code points as ``\\x{...}``, no ``(?d)``."""
    import re

    return re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", re.sub(r"\\x([0-9a-f]{2})", r"\\x{\1}", pattern.replace("(?d)", "").replace("(?dis)", "(?is)").replace("(?dm)", "(?m)")))
