"""Text functions, Column to Column. All stay in the JVM."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import regexes as R
from .numeric import let


def strip_ws(x: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(x, f"^{R.WS}+|{R.WS}+\\z", "")


def rstrip_ws(x: Column) -> Column:
    return F.regexp_replace(x, f"{R.WS}+\\z", "")


def strip_html(x: Column) -> Column:
    """C1. Tags go; script and style bodies and entities stay."""
    return F.regexp_replace(x, R.HTML, "")


def strip_urls(x: Column) -> Column:
    """C2."""
    return F.regexp_replace(x, R.URL, "")


def collapse(x: Column) -> Column:
    """C3. Runs of Unicode white space become a space; none at the ends."""
    return F.btrim(F.regexp_replace(x, f"{R.WS}+", " "))


def traditional(x: Column, source: str = "", target: str = "") -> Column:
    """C9. Characters by a table (``source[i]`` to ``target[i]``); the identity without one."""
    return F.translate(x, source, target) if source else x


def conversion_table(lines: list[str]) -> tuple[str, str]:
    """C9. The table for ``traditional`` from lines that hold a character and, behind a tab, what it becomes; empty lines
    and comments (#) are passed over. Of a character that stands twice the first line counts."""
    pairs: dict[str, str] = {}
    for line in lines:
        if line.strip() and not line.startswith("#"):
            a, _, b = line.rstrip("\r\n").partition("\t")
            if len(a) != 1 or len(b) != 1:
                raise ValueError(f"not a character and its counterpart: {line!r}")
            pairs.setdefault(a, b)
    return "".join(pairs), "".join(pairs.values())


def is_ad(x: Column) -> Column:
    """C7. Any advertisement pattern."""
    return _any(x, R.AD)


def is_wiki_junk(x: Column) -> Column:
    """C8."""
    return _any(x, R.WIKI)


def _any(x: Column, patterns: list[str]) -> Column:
    return x.rlike("(?d)" + "|".join(f"(?:{p})" for p in patterns))


def cleaned(text: Column, table: tuple[str, str] = ("", "")) -> Column:
    """The text that the filters of ``reject_reason`` look at."""
    return collapse(strip_urls(strip_html(traditional(text, *table))))


def reject_reason(clean: Column, raw: Column, min_len: int = 10, max_len: int = 2000, zh: float = 0.0, ads: bool = False, wiki: bool = False) -> Column:
    """C10. Why a cleaned text is dropped, null if it is kept: the first of empty, length, zh_ratio, letters, ad, wiki."""
    n = F.length(clean)
    chinese, letters = F.regexp_count(clean, F.lit(R.ZH)), F.regexp_count(clean, F.lit("[a-zA-Z]"))
    out = F.when(raw.isNull() | (raw == ""), "empty").when((n < min_len) | (n > max_len), "length")
    if zh > 0:
        out = out.when(chinese < zh * n, "zh_ratio")
    out = out.when(chinese + letters < 0.3 * n, "letters")
    if ads:
        out = out.when(is_ad(clean), "ad")
    if wiki:
        out = out.when(is_wiki_junk(clean), "wiki")
    return out


def clean_prefix(x: Column) -> Column:
    """C12. Stray option letters before Chinese or capitals, then runs of spaces. The text; it changed if it differs."""
    bare = F.regexp_replace(x, f"(?<![a-zA-Z])[A-F]:{R.WS}?(?=[\\u4e00-\\u9fffA-Z])", "")
    return strip_ws(F.regexp_replace(bare, " {2,}", " "))


MARKDOWN = [
    ("bold", r"(?d)\*\*(.+?)\*\*", "$1"),
    ("italic", r"(?d)(?<!\*)\*(.+?)\*(?!\*)", "$1"),
    ("heading", f"(?dm)^#{{1,6}}{R.WS}+", ""),
    ("list", f"(?dm)^(?:\\p{{Nd}}+[.)]{R.WS}*|[-*]{R.WS}+)", ""),
]


def clean_markdown(x: Column) -> tuple[Column, dict[str, Column]]:
    """C13. The text without marks, and whether each kind of mark changed it."""
    flags, at = {}, x
    for name, pattern, to in MARKDOWN:
        after = F.regexp_replace(at, pattern, to)
        flags[name] = after != at
        at = after
    return strip_ws(F.regexp_replace(at, "\\n{3,}", "\n\n")), flags


def parse_qa(line: Column) -> Column:
    """C15. struct(q, a), both null unless the first form that matches has both. Groups are taken of that form only."""
    none = F.lit(None).cast("struct<q:string,a:string>")

    def first(text: Column) -> Column:
        out = None
        for k, p in enumerate(R.QA):
            both = F.struct(*[F.regexp_extract(text, p, i).alias(n) for i, n in ((1, "q"), (2, "a"))])
            hit = text.rlike(p)
            if k == 4:
                hit = hit & let(both, lambda g: (F.length(g["q"]) > 2) & (F.length(g["a"]) > 5))
            out = F.when(hit, both) if out is None else out.when(hit, both)
        return out

    bare = lambda g: F.struct(strip_ws(g["q"]).alias("q"), strip_ws(g["a"]).alias("a"))
    full = lambda g: F.when((g["q"] != "") & (g["a"] != ""), g).otherwise(none)
    found = let(let(let(strip_ws(line), first), bare), full)
    return F.struct(found["q"].alias("q"), found["a"].alias("a"))


def qa_has_url(q: Column, a: Column) -> Column:
    """C17."""
    return a.rlike(R.QA_URL) | q.rlike(R.QA_URL)


def variant_lines(answer: Column, seed: Column, n: int) -> Column:
    """C18. Lines of an answer without numbering: unlike the seed, 5 characters or more, first seen, at most n."""
    bare = F.transform(F.split(strip_ws(answer), "\n"), lambda x: strip_ws(F.regexp_replace(strip_ws(x), f"^[\\p{{Nd}}{R.WS_BODY}.\\-、)）*#]+{R.WS}*", "")))
    return F.slice(F.array_distinct(F.filter(bare, lambda x: (x != seed) & (F.length(x) >= 5))), 1, n)


FOLLOW_UPS = "array<struct<user:string,assistant:string>>"


def follow_ups(answer: Column) -> Column:
    """C19. Follow-up turns of a JSON answer, which may be fenced; empty if it holds none."""
    bare = strip_ws(F.regexp_replace(F.regexp_replace(strip_ws(answer), "^```(?:json)?", ""), "```\\z", ""))
    inside = F.from_json(bare, f"follow_ups {FOLLOW_UPS}")["follow_ups"]
    turns = F.coalesce(inside, F.when(bare.startswith("["), F.from_json(bare, FOLLOW_UPS)), F.array().cast(FOLLOW_UPS))
    return F.filter(turns, lambda t: t["user"].isNotNull() & t["assistant"].isNotNull())


@lru_cache
def _digits() -> tuple[str, str, str]:
    """Decimal digits of all scripts, their values as 0-9, and digits that are no decimals (superscripts and such)."""
    every = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isdigit()]
    decimal = [c for c in every if c.isdecimal()]
    return "".join(decimal), "".join(str(unicodedata.decimal(c)) for c in decimal), "".join(c for c in every if not c.isdecimal())


def parse_score(reply: Column) -> Column:
    """C20. All digits of a reply together as a score of 1 to 5, else null. Digits of any script count; one that is no
    decimal, such as a superscript, makes the reply invalid."""
    decimal, value, other = _digits()
    digits = F.translate(F.regexp_replace(reply, f"[^\\p{{Nd}}{other}]", ""), decimal, value)
    return F.when(digits.rlike("^0*[1-5]$"), digits.cast("int"))


def map_score(score: Column) -> Column:
    """C21. 1, 2: 0; 3: 1; more: 2."""
    return F.when(score <= 2, 0).when(score == 3, 1).otherwise(2)


def label_line(label: Column, text: Column) -> Column:
    """C22."""
    return F.concat(F.lit("__label__"), label.cast("string"), F.lit(" "), F.replace(text, F.lit("\n"), F.lit(" ")))


START, END = "<|im_start|>", "<|im_end|>"


def chatml(messages: Column, prompt: bool = False) -> Column:
    """C23. Turns (role, content) as text, with the head of an answer if ``prompt``. A null role or content is empty; the
    turn stays."""
    said = lambda x: F.coalesce(x, F.lit(""))
    turns = F.transform(messages, lambda m: F.concat(F.lit(START), said(m["role"]), F.lit("\n"), said(m["content"]), F.lit(END + "\n")))
    return F.concat(F.array_join(turns, ""), F.lit(f"{START}assistant\n" if prompt else ""))


def wrap(text: Column) -> Column:
    """C24."""
    return F.concat(F.lit(START), text, F.lit(END))


def choice_prompt(question: Column, options: Column) -> Column:
    """C25. A question with its present options, lettered by their place among these."""
    present = F.filter(options, lambda x: x.isNotNull())
    lettered = F.transform(present, lambda x, i: F.concat(F.chr(i + 65), F.lit(". "), x))
    return F.concat_ws("\n", F.array(question), lettered, F.array(F.lit("答案：")))


def check_answer(generated: Column, expected: Column, keywords: Column) -> Column:
    """C26. CORRECT, HALLUCINATION or WRONG."""
    said = F.replace(F.lower(generated), F.lit(" "), F.lit(""))
    right = F.exists(F.split(F.lower(expected), ","), lambda e: said.contains(F.btrim(e)))
    return F.when(right, "CORRECT").when(F.exists(keywords, lambda k: said.contains(F.lower(k))), "HALLUCINATION").otherwise("WRONG")


def entity_hit(generated: Column, entity: Column, any_case: bool = True) -> Column:
    """C27."""
    return F.lower(generated).contains(F.lower(entity)) if any_case else generated.contains(entity)


def prefix(x: Column, n: int) -> Column:
    """C28. The first n characters."""
    return F.substring(x, 1, n)


def uniform(seed: int, key: Column) -> Column:
    """A number in [0, 1) that depends on seed and key only, the same in any plan and partitioning."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
