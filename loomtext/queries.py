"""Queries over the driver's tables, one or more per operator, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import numeric as N
from loomtext.functions import regexes as R
from loomtext.functions import text as T
from loomtext.operators import chunk, clean, dedup, evaluate, mix, qa, tokenizer, tuning
from loomtext.plans.session import spread
from loomtext.sources import readers
from loomtext.streaming.dedup import stream_clean_dedup

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spread(spark, f"{d}/{name}.parquet")


def docs_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


# --- pieces of SQL ---------------------------------------------------------------------------------------------------
WS, NON_WS = R.re2(R.WS), R.re2(R.NON_WS)


def norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def bare(x: str) -> str:
    return norm(f"regexp_replace(regexp_replace({x}, '</?[a-zA-Z][^>]*>', '', 'g'), 'https?://{NON_WS}+', '', 'g')")


def u(seed: int, key: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::ubigint / 4294967296.0)"


def clean_sql(lo: int, hi: int, of: str = "documents", more: str = "") -> str:
    letters = "len(regexp_extract_all(c, '[a-zA-Z]')) + len(regexp_extract_all(c, '[\\x{4e00}-\\x{9fff}]'))"
    return f"""SELECT *, CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN length(c) < {lo} OR length(c) > {hi} THEN 'length' WHEN {letters} < 0.3 * length(c) THEN 'letters' {more} END AS reason FROM (SELECT *, {bare("text")} AS c FROM {of})"""


DIGEST = "md5(array_to_string({0}, ','))"


def digest(ids) -> F.Column:
    return F.md5(F.array_join(F.transform(ids, lambda x: x.cast("string")), ","))


BYTES = "list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda x: ('0x' || x)::int + 13)"


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


# --- cleaning --------------------------------------------------------------------------------------------------------


@query("clean_default", f"SELECT doc_id, c AS clean FROM ({clean_sql(10, 2000)}) WHERE reason IS NULL")
def clean_default(spark, d):
    return clean.clean(docs_of(spark, d)).where("reason is null").select("doc_id", "clean")


@query("clean_pipeline", f"SELECT doc_id, md5(c) AS digest, reason FROM ({clean_sql(30, 3000)})")
def clean_pipeline(spark, d):
    return clean.clean(docs_of(spark, d), min_len=30, max_len=3000).select("doc_id", F.md5("clean").alias("digest"), "reason")


@query("clean_reject_reasons", f"SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM ({clean_sql(10, 2000)}) GROUP BY ALL")
def clean_reject_reasons(spark, d):
    return clean.clean(docs_of(spark, d)).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("clean_stats_by_source", f"SELECT source, count(*) AS total, count(*) FILTER (reason IS NULL) AS kept, round(100 * count(*) FILTER (reason IS NULL) / count(*), 2) AS percent FROM ({clean_sql(10, 2000)}) GROUP BY source")
def clean_stats_by_source(spark, d):
    return clean.clean_stats(clean.clean(docs_of(spark, d)), "source")


@query("clean_zh_ratio", "SELECT doc_id, length(c) AS n, zh, zh < 0.15 * length(c) AS dropped FROM (SELECT doc_id, c, len(regexp_extract_all(c, '[\\x{4e00}-\\x{9fff}]')) AS zh FROM (SELECT doc_id, " + bare("repeat('中文', (length(text) * (doc_id % 5) // 20)::int) || text") + " AS c FROM documents))")
def clean_zh_ratio(spark, d):
    mixed = docs_of(spark, d).withColumn("text", F.expr("concat(repeat('中文', cast(length(text) * (doc_id % 5) div 20 as int)), text)"))
    c = mixed.select("doc_id", T.cleaned(F.col("text")).alias("c"))
    zh = F.regexp_count("c", F.lit(R.ZH))
    return c.select("doc_id", F.length("c").alias("n"), zh.alias("zh"), (zh < 0.15 * F.length("c")).alias("dropped"))


@query("html_strip_pages", f"SELECT page_id, {bare('html')} AS clean FROM pages")
def html_strip_pages(spark, d):
    return table(spark, d, "pages").select("page_id", T.cleaned(F.col("html")).alias("clean"))


@query("traditional_to_simplified", "SELECT doc_id, translate(text || '漢語書寫', '漢語書寫', '汉语书写') AS text FROM documents")
def traditional_to_simplified(spark, d):
    return docs_of(spark, d).select("doc_id", T.traditional(F.concat(F.col("text"), F.lit("漢語書寫")), "漢語書寫", "汉语书写").alias("text"))


# One hit or near miss per pattern.
AD_LINES = ["咨询热线：400123", "加盟电话 12345", "电：123", "QQ：12345", "微信：abc", "请扫码", "点击此链接", "010-12345678", "010-1234-5678", "直营店遍布全国", "优惠活动", "年终大促", "名额有限", "QQ：1234", "普通新闻"]
WIKI_LINES = ["镇区人口有", "涵盖总面积为", "美国2000年人口普查", "United States 人口普查", "座标为", "非建制地区", "海拔高度为5米", "海拔高度为"]


def _injected(lines: list[str]) -> F.Column:
    return F.concat(F.col("text"), F.element_at(F.array(*map(F.lit, lines)), (F.col("doc_id") % len(lines) + 1).cast("int")))


def _injected_sql(lines: list[str]) -> str:
    return f"text || ([{', '.join(repr(x) for x in lines)}])[(doc_id % {len(lines)} + 1)::int]"


def _hit_sql(lines: list[str], patterns: list[str]) -> str:
    return f"SELECT doc_id, regexp_matches({_injected_sql(lines)}, '{R.re2('|'.join(f'(?:{p})' for p in patterns))}') AS hit FROM documents"


@query("ad_filter", _hit_sql(AD_LINES, R.AD))
def ad_filter(spark, d):
    return docs_of(spark, d).select("doc_id", T.is_ad(_injected(AD_LINES)).alias("hit"))


@query("wiki_junk", _hit_sql(WIKI_LINES, R.WIKI))
def wiki_junk(spark, d):
    return docs_of(spark, d).select("doc_id", T.is_wiki_junk(_injected(WIKI_LINES)).alias("hit"))


def _letters_sql(x: str) -> str:
    """clean_prefix over the characters one by one, since RE2 has no lookaround."""
    start = f"c[i] BETWEEN 'A' AND 'F' AND c[i + 1] = ':' AND (i = 1 OR NOT regexp_matches(c[i - 1], '[a-zA-Z]'))"
    near, far = (f"coalesce(regexp_matches(c[i + {k}], '[\\x{{4e00}}-\\x{{9fff}}A-Z]'), false)" for k in (2, 3))
    width = f"CASE WHEN {start} THEN CASE WHEN {near} THEN 2 WHEN regexp_matches(c[i + 2], '{WS}') AND {far} THEN 3 ELSE 0 END ELSE 0 END"
    kept = f"list_filter(c, lambda x, i: {{0}}[i] = 0 AND NOT (i > 1 AND {{0}}[i - 1] > 1) AND NOT (i > 2 AND {{0}}[i - 2] > 2))".format("w")
    out = f"(SELECT array_to_string({kept}, '') FROM (SELECT c, list_transform(range(1, len(c) + 1), lambda i: {width}) AS w FROM (SELECT regexp_extract_all({x}, '(?s).') AS c)))"
    return stripped(f"regexp_replace({out}, ' {{2,}}', ' ', 'g')")


PREFIXED = "'A: 中文 B:Text  ' || text || ' C: B: D:中 xE: F:y'"


@query("clean_prefix", f"SELECT doc_id, {_letters_sql(PREFIXED)} AS output FROM documents")
def clean_prefix(spark, d):
    return docs_of(spark, d).select("doc_id", T.clean_prefix(F.expr(PREFIXED)).alias("output"))


# the asterisks of the texts are taken out, since RE2 has no lookaround for single ones; unit tests cover these
_T = "replace(text, '*', '')"
MARKED = f"'## ' || {_T} || '\n- **bold** and *slanted* x\n\n\n\n1. ' || lang || '\n# B: Title'"
_MARKS = [("bold", "\\*\\*(.+?)\\*\\*", "\\1"), ("italic", "\\*(.+?)\\*", "\\1"), ("heading", f"(?m)^#{{1,6}}{WS}+", ""), ("list", f"(?m)^(?:\\p{{Nd}}+[.)]{WS}*|[-*]{WS}+)", "")]


def _md(x: str) -> str:
    for _, pattern, to in _MARKS:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return stripped(f"regexp_replace({x}, '\n{{3,}}', '\n\n', 'g')")


@query("clean_markdown", f"SELECT doc_id, {_md('x')} AS output FROM (SELECT doc_id, {MARKED} AS x FROM documents)")
def clean_markdown(spark, d):
    return docs_of(spark, d).select("doc_id", T.clean_markdown(F.expr(MARKED.replace("\n", "\\n")))[0].alias("output"))


def _answers_sql() -> str:
    steps, flags = f"(SELECT doc_id, x, {_letters_sql('x')} AS x0 FROM (SELECT doc_id, CASE WHEN doc_id % 10 > 0 THEN {MARKED} END AS x FROM documents))", ["CASE WHEN x0 <> x THEN 'prefix' END"]
    for k, (name, pattern, to) in enumerate(_MARKS):
        steps = f"(SELECT *, regexp_replace(x{k}, '{pattern}', '{to}', 'g') AS x{k + 1} FROM {steps})"
        flags.append(f"CASE WHEN x{k + 1} <> x{k} THEN '{name}' END")
    last = stripped(f"regexp_replace(x{len(_MARKS)}, '\n{{3,}}', '\n\n', 'g')")
    return f"SELECT doc_id, CASE WHEN x IS NOT NULL THEN {last} END AS output, concat_ws(',', {', '.join(flags)}) AS changed FROM {steps}"


@query("clean_answers", _answers_sql())
def clean_answers(spark, d):
    rows = docs_of(spark, d).select("doc_id", F.when(F.col("doc_id") % 10 > 0, F.expr(MARKED.replace("\n", "\\n"))).alias("output"))
    return clean.clean_answers(rows).select("doc_id", "output", F.array_join("changed", ",").alias("changed"))


@query("score_prompt", "SELECT doc_id, left(text, 3000) AS prompt FROM documents")
def score_prompt(spark, d):
    return docs_of(spark, d).select("doc_id", T.prefix(F.col("text"), 3000).alias("prompt"))


@query("score_parse", "SELECT doc_id, CASE WHEN ok THEN k::int END AS score, CASE WHEN ok THEN CASE WHEN k <= 2 THEN 0 WHEN k = 3 THEN 1 ELSE 2 END END AS label FROM (SELECT doc_id, k, k BETWEEN 1 AND 5 AND (doc_id % 3 = 0 OR doc_id % 11 > 0) AS ok FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 8 * 10 + 5 ELSE doc_id % 8 END AS k FROM documents))")
def score_parse(spark, d):
    wide = F.expr("substring('０１２３４５６７', cast(doc_id % 8 as int) + 1, 1)")
    digit = F.when(F.col("doc_id") % 5 == 0, wide).otherwise((F.col("doc_id") % 8).cast("string"))
    reply = F.concat(F.lit("Score: "), digit, F.when(F.col("doc_id") % 3 == 0, "/5").when(F.col("doc_id") % 11 == 0, "²").otherwise("."))
    s = T.parse_score(reply)
    return docs_of(spark, d).select("doc_id", s.alias("score"), F.when(s.isNotNull(), T.map_score(s)).alias("label"))


@query("label_lines", "SELECT doc_id, '__label__' || quality || ' ' || replace(text, '\n', ' ') AS line FROM documents JOIN labels USING (doc_id)")
def label_lines(spark, d):
    return docs_of(spark, d).join(table(spark, d, "labels"), "doc_id").select("doc_id", T.label_line(F.col("quality"), F.col("text")).alias("line"))


_VARIANT = f"list_filter(list_transform(string_split({stripped('numbered')}, chr(10)), lambda x: {stripped('regexp_replace(' + stripped('x') + f", '^[\\p{{Nd}}{R.re2(R.WS_BODY)}.\\-、)）*#]+{WS}*', '')")}), lambda x: x <> 'seed' AND length(x) >= 5)"


@query("variant_lines", f"SELECT doc_id, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i)[:5], '|') AS variants FROM (SELECT doc_id, {_VARIANT} AS v FROM (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: i || '. ' || x), chr(10)) AS numbered FROM documents))")
def variant_lines(spark, d):
    numbered = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    return docs_of(spark, d).select("doc_id", F.array_join(T.variant_lines(numbered, F.lit("seed"), 5), "|").alias("variants"))


@query("follow_ups", "SELECT conv_id, count(*) FILTER (role = 'user') AS n_turns, coalesce(string_agg(text || '>' || turn, '|' ORDER BY turn) FILTER (role = 'user'), '') AS turns FROM conversations GROUP BY conv_id")
def follow_ups(spark, d):
    own = F.struct("turn", F.col("text").alias("user"), F.col("turn").cast("string").alias("assistant"))
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("role") == "user", own))).alias("f"))
    bare = F.transform("f", lambda t: F.struct(t["user"].alias("user"), t["assistant"].alias("assistant")))
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct(bare.alias("follow_ups"))), F.lit("\n```"))
    got = turns.select("conv_id", T.follow_ups(reply).alias("t"))
    return got.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda x: F.concat(x["user"], F.lit(">"), x["assistant"])), "|").alias("turns"))


# --- extraction ------------------------------------------------------------------------------------------------------


def _records(spark, d, fields: dict[str, str], schema: str) -> DataFrame:
    lines = docs_of(spark, d).select("doc_id", F.to_json(F.struct(*[F.expr(v).alias(k) for k, v in fields.items()])).alias("line"))
    return readers.json_lines(lines, schema).where("valid")


def _part(x: str) -> str:
    return f"nullif(regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g'), '')"


_FIRST = "split_part(text, chr(10), 1)"


@query("extract_news", f"SELECT doc_id, t AS text FROM (SELECT doc_id, concat_ws('。', {_part(_FIRST)}, {_part('source')}, {_part('text')}) AS t FROM documents) WHERE length(t) > 30")
def extract_news(spark, d):
    r = _records(spark, d, {"title": _FIRST, "desc": "source", "content": "text"}, readers.RECORDS["news"])
    return readers.extract_news(r).select("doc_id", "text")


@query("extract_baike", f"SELECT doc_id, t AS text FROM (SELECT doc_id, replace(concat_ws('。', {_part('source')}, {_part('lang')} || '。', {_part('text')}), '。。', '。') AS t FROM documents) WHERE length(t) > 20")
def extract_baike(spark, d):
    r = _records(spark, d, {"title": "source", "summary": "lang || '。'", "text": "text"}, readers.RECORDS["baike"])
    return readers.extract_baike(r).select("doc_id", "text")


@query("extract_qa", f"SELECT doc_id, '问题：' || {_FIRST} || ' 回答：' || text AS text FROM documents WHERE NOT (doc_id % 2 = 0 AND length(text) < 20) AND length({_FIRST}) > 3 AND length(text) > 10")
def extract_qa(spark, d):
    r = _records(spark, d, {"qid": "cast(doc_id as string)", "title": _FIRST, "content": "text", "star": "cast(doc_id % 2 as int)"}, readers.RECORDS["qa"])
    return readers.extract_qa(r).select("doc_id", "text")


@query("extract_wiki", f"SELECT doc_id, t AS text FROM (SELECT doc_id, regexp_replace(text, '{WS}+$', '', 'g') AS t FROM documents) WHERE length(t) > 30")
def extract_wiki(spark, d):
    return readers.extract_wiki(_records(spark, d, {"text": "text || ' \\n'"}, readers.RECORDS["wiki"])).select("doc_id", "text")


@query("extract_edu", f"SELECT doc_id, regexp_replace(text, '{WS}+$', '', 'g') AS text FROM documents WHERE text <> ''")
def extract_edu(spark, d):
    return readers.extract_edu(docs_of(spark, d)).select("doc_id", "text")


@query("topics", f"SELECT * FROM (SELECT doc_id, {stripped('line')} AS topic FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE topic <> ''")
def topics(spark, d):
    lines = docs_of(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return readers.topics(lines).select("doc_id", "topic")


@query("line_granularity", "SELECT doc_id, count(*) AS n_lines FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) FROM documents) GROUP BY doc_id")
def line_granularity(spark, d):
    return readers.granular(docs_of(spark, d), "line").groupBy("doc_id").agg(F.count("*").alias("n_lines"))


# --- dedup -----------------------------------------------------------------------------------------------------------
NORM = f"(SELECT doc_id, source, {norm('text')} AS t FROM documents)"


@query("dedup_exact", f"SELECT doc_id, t AS text FROM {NORM} WHERE t <> '' QUALIFY row_number() OVER (PARTITION BY md5(t) ORDER BY doc_id) = 1")
def dedup_exact(spark, d):
    return dedup.dedup_exact(docs_of(spark, d)).select("doc_id", "text")


@query("dedup_prefix100", f"SELECT doc_id, t AS text FROM {NORM} WHERE t <> '' QUALIFY row_number() OVER (PARTITION BY md5(substr(t, 1, 100)) ORDER BY doc_id) = 1")
def dedup_prefix100(spark, d):
    return dedup.dedup_prefix(docs_of(spark, d)).select("doc_id", "text")


@query("dedup_stats", f"SELECT count(*) AS total, count(DISTINCT t) FILTER (t <> '') AS kept, count(*) FILTER (t <> '') - count(DISTINCT t) FILTER (t <> '') AS deduped FROM {NORM}")
def dedup_stats(spark, d):
    return dedup.dedup_stats(docs_of(spark, d), dedup.dedup_exact(docs_of(spark, d)))


_SUMS = ", ".join(f"sum(CASE WHEN (h >> {b}) & 1 = 1 THEN m ELSE -m END) AS s{b}" for b in range(64))
_BITS = " + ".join(f"(CASE WHEN s{b} > 0 THEN {1 << b}::hugeint ELSE 0::hugeint END)" for b in range(64))
FP = f"""n AS MATERIALIZED (SELECT doc_id, source, t FROM {NORM} WHERE t <> ''),
g AS (SELECT t, unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS gram FROM (SELECT DISTINCT t FROM n) WHERE length(t) >= 3),
c AS (SELECT t, gram, count(*) AS m FROM g GROUP BY ALL),
h AS (SELECT gram, ('0x' || substr(md5(gram), 1, 16))::ubigint AS h FROM (SELECT DISTINCT gram FROM c)),
s AS (SELECT t, {_SUMS} FROM c JOIN h USING (gram) GROUP BY t),
v AS (SELECT t, {_BITS} AS f FROM s UNION ALL SELECT DISTINCT t, ('0x' || substr(md5(t), 1, 16))::ubigint::hugeint FROM n WHERE length(t) < 3),
fp AS MATERIALIZED (SELECT doc_id, source, (CASE WHEN f >= 9223372036854775808 THEN f - 18446744073709551616 ELSE f END)::bigint AS fp FROM n JOIN v USING (t))"""


@query("simhash_fp", f"WITH {FP} SELECT doc_id, fp FROM fp")
def simhash_fp(spark, d):
    return dedup.fingerprints(docs_of(spark, d)).select("doc_id", "fp")


@query("fingerprint_set", f"WITH {FP} SELECT DISTINCT fp FROM fp")
def fingerprint_set(spark, d):
    return dedup.fingerprint_set(docs_of(spark, d))


PAIRS = "p AS MATERIALIZED (SELECT a.fp AS fp_a, b.fp AS fp_b FROM (SELECT DISTINCT fp FROM fp) a, (SELECT DISTINCT fp FROM fp) b WHERE a.fp < b.fp AND bit_count(xor(a.fp, b.fp)) <= 3)"


@query("near_dup_pairs", f"WITH {FP}, {PAIRS} SELECT * FROM p")
def near_dup_pairs(spark, d):
    return dedup.near_pairs(dedup.fingerprints(docs_of(spark, d)))


def _greedy(rounds: int = 10, given: str = "f AS MATERIALIZED (SELECT fp, min(doc_id) AS pos FROM fp GROUP BY fp)") -> str:
    out = [FP, PAIRS, given, "e AS MATERIALIZED (SELECT CASE WHEN a.pos < b.pos THEN fp_a ELSE fp_b END AS early, CASE WHEN a.pos < b.pos THEN fp_b ELSE fp_a END AS late FROM p JOIN f a ON a.fp = fp_a JOIN f b ON b.fp = fp_b)", "u0 AS (SELECT fp FROM f)"]
    for k in range(rounds):
        out.append(f"k{k} AS MATERIALIZED (SELECT fp FROM u{k} WHERE fp NOT IN (SELECT late FROM e WHERE early IN (SELECT fp FROM u{k})))")
        out.append(f"u{k + 1} AS MATERIALIZED (SELECT fp FROM u{k} WHERE fp NOT IN (SELECT fp FROM k{k}) AND fp NOT IN (SELECT late FROM e WHERE early IN (SELECT fp FROM k{k})))")
    return f"WITH {', '.join(out)} SELECT pos AS doc_id FROM f WHERE fp IN ({' UNION ALL '.join(f'SELECT fp FROM k{k}' for k in range(rounds))})"


@query("dedup_simhash", _greedy())
def dedup_simhash(spark, d):
    return dedup.dedup_simhash(docs_of(spark, d)).select("doc_id")


_UNSEEDED = "s0 AS MATERIALIZED (SELECT DISTINCT fp FROM fp WHERE source = 'src0'), f AS MATERIALIZED (SELECT fp, min(doc_id) AS pos FROM fp r WHERE source <> 'src0' AND NOT EXISTS (SELECT 1 FROM s0 WHERE bit_count(xor(s0.fp, r.fp)) <= 3) GROUP BY fp)"


@query("dedup_seeded", _greedy(given=_UNSEEDED))
def dedup_seeded(spark, d):
    docs = docs_of(spark, d)
    return dedup.dedup_simhash(docs.where("source <> 'src0'"), seed=dedup.fingerprint_set(docs.where("source = 'src0'"))).select("doc_id")


@query("cross_source_dedup", f"WITH {FP} SELECT doc_id FROM fp a WHERE source = 'src1' OR NOT EXISTS (SELECT 1 FROM fp b WHERE b.source <> 'src1' AND b.source <> a.source AND bit_count(xor(a.fp, b.fp)) <= 3)")
def cross_source_dedup(spark, d):
    return dedup.dedup_cross(docs_of(spark, d), exempt=("src1",)).select("doc_id")


@query("label_exclude", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def label_exclude(spark, d):
    return dedup.exclude(docs_of(spark, d), table(spark, d, "labels"), "doc_id").select("doc_id")


# --- questions and answers -------------------------------------------------------------------------------------------
_FORMS = ["'问题：' || q || ' 回答：' || a", "'Q: ' || q || ' A: ' || a", "'问：' || q || '答：' || a", "'{\"question\": \"' || q || '\", \"answer\": \"' || a || '\"}'", "q || chr(9) || a", "q || a || ' www.example.com'"]
_FLAT = "replace(replace(text, chr(10), ' '), '\"', ' ')"
_QA = f"(SELECT doc_id, split_part({_FLAT}, '. ', 1) AS q, CASE WHEN doc_id % 7 = 0 THEN source ELSE {_FLAT} || CASE WHEN doc_id % 11 = 0 THEN ' http://x.y' ELSE '' END END AS a FROM documents)"
_CASE = "CASE doc_id % 6 " + " ".join(f"WHEN {k} THEN {f}" for k, f in enumerate(_FORMS)) + " END"


def _qa_lines(spark, d):
    case = _CASE.replace("chr(9)", "'\\t'").replace("{", "{{").replace("}", "}}")
    return spark.sql(f"SELECT doc_id, {case} AS text FROM {_QA.replace('FROM documents', 'FROM {docs}')}", docs=docs_of(spark, d))


def _qa_sql() -> str:
    trim = lambda x: f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"
    line = f"(SELECT doc_id, {trim('line')} AS t FROM (SELECT doc_id, {_CASE} AS line FROM {_QA}))"
    case = {"q": "", "a": ""}
    for k, p in enumerate(R.QA):
        p = R.re2(p).replace("'", "''")
        q, a = f"regexp_extract(t, '{p}', 1)", f"regexp_extract(t, '{p}', 2)"
        hit = f"regexp_matches(t, '{p}')" + (f" AND length({q}) > 2 AND length({a}) > 5" if k == 4 else "")
        for c, x in (("q", q), ("a", a)):
            case[c] += f" WHEN {hit} THEN CASE WHEN {trim(q)} <> '' AND {trim(a)} <> '' THEN {trim(x)} END"
    return f"SELECT doc_id, CASE {case['q']} END AS q, CASE {case['a']} END AS a FROM {line}"


_URL = R.re2(R.QA_URL)
_STATUS = f"(SELECT *, CASE WHEN s IS NOT NULL THEN s WHEN row_number() OVER (PARTITION BY s IS NULL, md5(q) ORDER BY doc_id) = 1 THEN 'kept' ELSE 'duplicate' END AS status FROM (SELECT *, CASE WHEN q IS NULL THEN 'unparsed' WHEN length(a) < 20 THEN 'short' WHEN regexp_matches(a, '{_URL}') OR regexp_matches(q, '{_URL}') THEN 'url' END AS s FROM ({_qa_sql()})))"


@query("parse_qa", _qa_sql())
def parse_qa(spark, d):
    return _qa_lines(spark, d).withColumn("p", T.parse_qa(F.col("text"))).select("doc_id", "p.q", "p.a")


@query("filter_qa", f"SELECT doc_id, status FROM {_STATUS}")
def filter_qa(spark, d):
    return qa.judged_qa(_qa_lines(spark, d), "doc_id").select("doc_id", "status")


@query("filter_qa_stats", f"SELECT count(*) AS total, count(*) FILTER (status = 'kept') AS kept, count(*) FILTER (status = 'short') AS short, count(*) FILTER (status = 'url') AS url, count(*) FILTER (status = 'duplicate') AS dup FROM {_STATUS}")
def filter_qa_stats(spark, d):
    return qa.qa_stats(qa.judged_qa(_qa_lines(spark, d), "doc_id"))


@query("dedup_questions", f"SELECT doc_id FROM (SELECT doc_id, {stripped('split_part(text, chr(10), 1)')} AS q FROM documents) WHERE q <> '' QUALIFY row_number() OVER (PARTITION BY md5(q) ORDER BY doc_id) = 1")
def dedup_questions(spark, d):
    rows = docs_of(spark, d).withColumn("q", T.strip_ws(F.expr("split_part(text, '\\n', 1)")))
    return qa.dedup_questions(rows, "doc_id").select("doc_id")


# --- mixing ----------------------------------------------------------------------------------------------------------
_MIX = "(SELECT source, (1 + ascii(right(source, 1)) % 4) / 40.0::double AS ratio FROM (SELECT DISTINCT source FROM documents)) AS mix"


def mix_of(spark, d) -> DataFrame:
    """A share for every source of the table; one row each."""
    return docs_of(spark, d).select("source").distinct().select("source", ((1 + F.ascii(F.right("source", F.lit(1))) % 4) / 40.0).alias("ratio"))


@query("source_sizes", "SELECT source, count(*) AS lines, sum(length(text))::bigint AS chars, round(avg(length(text) + 1), 6) AS mean_chars FROM documents GROUP BY source")
def source_sizes(spark, d):
    return mix.source_sizes(docs_of(spark, d)).withColumn("mean_chars", F.round("mean_chars", 6))


@query("char_weights", f"WITH w AS (SELECT source, ratio / avg(length(text) + 1) AS w FROM documents JOIN {_MIX} USING (source) GROUP BY source, ratio) SELECT source, round(w / (SELECT sum(w) FROM w), 9) AS weight FROM w")
def char_weights(spark, d):
    return mix.char_weights(mix.source_sizes(docs_of(spark, d)), mix_of(spark, d)).withColumn("weight", F.round("weight", 9))


@query("bernoulli_sample", f"WITH r AS (SELECT source, 200000 * ratio / sum(length(text)) AS p FROM documents JOIN {_MIX} USING (source) GROUP BY source, ratio) SELECT doc_id FROM documents JOIN r USING (source) WHERE p >= 0.95 OR {u(42, 'doc_id')} < p")
def bernoulli_sample(spark, d):
    return mix.bernoulli(docs_of(spark, d), mix_of(spark, d), 200_000).select("doc_id")


@query("interleave_order", f"WITH o AS (SELECT source, greatest(1, floor(50 * ratio / (SELECT max(ratio) FROM {_MIX})))::bigint AS burst, row_number() OVER (ORDER BY source) AS source_no FROM {_MIX}) SELECT doc_id, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // burst)::bigint AS round, source_no, round({u(42, 'doc_id')}, 9) AS draw FROM documents JOIN o USING (source)")
def interleave_order(spark, d):
    return mix.interleave(docs_of(spark, d), mix_of(spark, d), buffer=50).select("doc_id", F.col("round").cast("long").alias("round"), F.col("source_no").cast("long").alias("source_no"), F.round("draw", 9).alias("draw"))


_SPLIT = f"CASE WHEN {u(42, 'doc_id')} < 0.9 THEN 'train' WHEN {u(42, 'doc_id')} < 0.9 + 0.05 THEN 'valid' ELSE 'test' END"


@query("split_assign", f"SELECT doc_id, {_SPLIT} AS split FROM documents WHERE {stripped('text')} <> ''")
def split_assign(spark, d):
    return mix.assign_splits(docs_of(spark, d)).select("doc_id", "split")


@query("split_stats", f"SELECT {_SPLIT} AS split, source, count(*) AS n, sum(length(t))::bigint AS chars FROM (SELECT doc_id, source, {stripped('text')} AS t FROM documents) WHERE t <> '' GROUP BY ALL")
def split_stats(spark, d):
    return mix.split_stats(mix.assign_splits(docs_of(spark, d)))


@query("sample_topk", f"SELECT doc_id FROM documents WHERE length(text) >= 20 AND doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY {u(42, 'doc_id')}, doc_id LIMIT 50")
def sample_topk(spark, d):
    return mix.sample_k(dedup.exclude(docs_of(spark, d), table(spark, d, "labels"), "doc_id"), 50).select("doc_id")


@query("head_limit", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25")
def head_limit(spark, d):
    return mix.head(docs_of(spark, d), 25, "doc_id").select("doc_id")


@query("max_chars_prefix", "SELECT doc_id, substr(text, 1, least(length(text), 100000 - b)) AS text FROM (SELECT doc_id, text, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS b FROM documents) WHERE b < 100000")
def max_chars_prefix(spark, d):
    return mix.max_chars(docs_of(spark, d), 100_000).select("doc_id", "text")


_CATEGORY = "ascii(right(source, 1)) % 3"
_BUILT = " UNION ALL ".join(f"(SELECT key, source, '{c}' AS category FROM (SELECT doc_id AS key, source, unnest(range(1, ceil({n} / (SELECT count(*) FROM documents WHERE {_CATEGORY} = {k}))::int + 1)) AS copy FROM documents WHERE {_CATEGORY} = {k}) ORDER BY copy, {u(42, 'key')}, key LIMIT {n})" for k, (c, n) in enumerate({"A": 800, "B": 600, "C": 600}.items()))


@query("category_build", _BUILT)
def category_build(spark, d):
    docs = docs_of(spark, d).select(F.col("doc_id").alias("key"), "source")
    parts = {c: docs.where(F.ascii(F.right("source", F.lit(1))) % 3 == k) for k, c in enumerate("ABC")}
    return mix.category_build(parts, {"A": 0.4, "B": 0.3, "C": 0.3}, 2000)


# --- chunking --------------------------------------------------------------------------------------------------------
_PIECES = "regexp_extract_all(replace(text, '. ', '。'), '[^。！？；\\n]+|[。！？；\\n]+')"


@query("sentence_split", f"SELECT doc_id, len(p) AS n, md5(array_to_string(p, '|')) AS digest FROM (SELECT doc_id, {_PIECES} AS p FROM documents)")
def sentence_split(spark, d):
    p = chunk.sentences(F.replace(F.col("text"), F.lit(". "), F.lit("。")))
    return docs_of(spark, d).select("doc_id", F.size(p).cast("long").alias("n"), F.md5(F.array_join(p, "|")).alias("digest"))


# the chunks so far as one string, each but the last closed by chr(1)
_LAST = "regexp_extract(a, '[^\\x01]*$')"
_CUTS = "array_to_string(list_transform(range(0, (length(x) - 1) // 400 + 1), lambda k: substr(x, k * 400 + 1, 400)), chr(1)) || chr(1)"
_FLUSH = f"CASE WHEN {_LAST} <> '' AND length({_LAST}) + length(x) > 400 THEN a || chr(1) ELSE a END"
_FOLD = f"list_reduce({_PIECES}, lambda a, x: {_FLUSH} || CASE WHEN length(x) > 400 THEN {_CUTS} ELSE x END, '')"


@query("greedy_pack", f"SELECT doc_id, len(p) AS n, list_max(list_transform(p, lambda x: length(x))) AS longest, md5(array_to_string(p, '|')) AS digest FROM (SELECT doc_id, list_filter(string_split({_FOLD}, chr(1)), lambda x: x <> '') AS p FROM documents)")
def greedy_pack(spark, d):
    p = chunk.pack(F.replace(F.col("text"), F.lit(". "), F.lit("。")), 400)
    packed = docs_of(spark, d).select("doc_id", p.alias("p"))
    return packed.select("doc_id", F.size("p").cast("long").alias("n"), F.array_max(F.transform("p", lambda x: F.length(x))).cast("long").alias("longest"), F.md5(F.array_join("p", "|")).alias("digest"))


# a fold over the sizes of all sentences of a source: how full the chunk is, and where chunks start (2: longer, 3: blank)
_FULL = "CASE WHEN x.size < 0 OR x.size > 400 THEN 0 WHEN a.size > 0 AND a.size + x.size > 400 THEN x.size ELSE a.size + x.size END"
_START = "CASE WHEN x.size < 0 THEN 3 WHEN x.size > 400 THEN 2 WHEN a.size = 0 OR a.size + x.size > 400 THEN 1 ELSE 0 END"
_STREAM = f"""WITH l AS (SELECT source, doc_id, unnest(range(0, len(a))) AS line_no, unnest(a) AS t FROM (SELECT source, doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS a FROM documents)),
s AS (SELECT source, doc_id, line_no, {stripped('t')} AS t FROM l),
p AS (SELECT source, doc_id, line_no, unnest(range(0, len(x))) AS piece, unnest(x) AS s FROM (SELECT *, CASE WHEN t = '' THEN [''] ELSE regexp_extract_all(t, '[^。！？；\\n]+|[。！？；\\n]+') END AS x FROM s)),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, line_no, piece) AS k FROM p),
f AS (SELECT source, list_reduce(list({{'size': CASE WHEN s = '' THEN -1 ELSE length(s) END, 'starts': []::int[]}} ORDER BY k), lambda a, x: {{'size': {_FULL}, 'starts': list_append(a.starts, {_START})}}, {{'size': 0::bigint, 'starts': []::int[]}}).starts AS starts FROM n GROUP BY source),
c AS (SELECT n.*, starts[k] AS kind, sum((starts[k] > 0)::int) OVER (PARTITION BY source ORDER BY k) AS chunk FROM n JOIN f USING (source)),
g AS (SELECT source, arg_min(doc_id, k) AS doc_id, arg_min(line_no, k) AS line_no, arg_min(piece, k) AS piece, string_agg(s, '' ORDER BY k) AS t, max(kind) AS kind FROM c GROUP BY source, chunk)
SELECT source, doc_id, line_no::int AS line_no, piece::int AS piece, i::int AS slice, length(substr(t, i * 400 + 1, 400)) AS n, md5(substr(t, i * 400 + 1, 400)) AS digest FROM (SELECT *, unnest(range(0, CASE WHEN kind = 2 THEN (length(t) - 1) // 400 + 1 ELSE 1 END)) AS i FROM g)"""


@query("pack_stream", _STREAM)
def pack_stream(spark, d):
    lines = readers.granular(docs_of(spark, d), "line").select("source", F.struct("doc_id", "line_no").alias("at"), "text")
    packed = chunk.pack_stream(lines, "at", 400, "source")
    return packed.select("source", "at.doc_id", "at.line_no", "piece", "slice", F.length("chunk").alias("n"), F.md5("chunk").alias("digest"))


_IDS = BYTES.format("text")


@query("sliding_windows", f"SELECT doc_id, i::int AS i, {DIGEST.format('ids[i * 48 + 1 : i * 48 + 65]')} AS digest FROM (SELECT doc_id, ids, unnest(range(0, CASE WHEN len(ids) < 65 THEN 0 ELSE (len(ids) - 65) // 48 + 1 END)) AS i FROM (SELECT doc_id, {_IDS} AS ids FROM documents))")
def sliding_windows(spark, d):
    ids = docs_of(spark, d).select("doc_id", tokenizer.byte_ids(F.col("text")).alias("ids"))
    return ids.select("doc_id", F.posexplode(chunk.windows(F.col("ids"), 64)).alias("i", "w")).select("doc_id", "i", digest(F.col("w")).alias("digest"))


@query("pad_shift", f"WITH b AS (SELECT doc_id, doc_id // 8 AS batch, {_IDS} AS ids FROM documents), m AS (SELECT batch, max(len(ids)) AS n FROM b GROUP BY batch), f AS (SELECT doc_id, ids || list_transform(range(0, n - len(ids)), lambda x: 0) AS ids FROM b JOIN m USING (batch)) SELECT doc_id, {DIGEST.format('ids[:-2]')} AS input, {DIGEST.format('ids[2:]')} AS target FROM f")
def pad_shift(spark, d):
    rows = docs_of(spark, d).select("doc_id", F.floor(F.col("doc_id") / 8).alias("batch"), tokenizer.byte_ids(F.col("text")).alias("ids"))
    return chunk.collate(rows, "batch").select("doc_id", digest(F.col("input")).alias("input"), digest(F.col("target")).alias("target"))


@query("random_cut", f"SELECT doc_id, n, CASE WHEN {u(42, 'doc_id')} < 0.1 THEN least(n, floor(n / 2) + floor({u(43, 'doc_id')} * (n - floor(n / 2) + 1)))::bigint ELSE n END AS n_cut FROM (SELECT doc_id, strlen(text) AS n FROM documents)")
def random_cut(spark, d):
    rows = docs_of(spark, d).select("doc_id", tokenizer.byte_ids(F.col("text")).alias("ids"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n"), F.size(chunk.random_cut(F.col("ids"), F.col("doc_id"))).cast("long").alias("n_cut"))


# --- tokenizer -------------------------------------------------------------------------------------------------------
_PRE = "regexp_extract_all(left(text, 50) || '中文，' || substr(text, 51), '" + R.re2(R.CJK) + "')"


@query("pretokenize_counts", f"SELECT w AS word, count(*) AS n FROM (SELECT unnest({_PRE}) AS w FROM documents) GROUP BY w")
def pretokenize_counts(spark, d):
    mixed = docs_of(spark, d).withColumn("text", F.concat(F.substring("text", 1, 50), F.lit("中文，"), F.expr("substring(text, 51)")))
    return tokenizer.word_counts(mixed)


@query("byte_ids", f"SELECT doc_id, len(ids) AS n, {DIGEST.format('ids')} AS digest FROM (SELECT doc_id, {BYTES.format('text')} AS ids FROM documents)")
def byte_ids(spark, d):
    ids = docs_of(spark, d).select("doc_id", tokenizer.byte_ids(F.col("text")).alias("ids"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n"), digest(F.col("ids")).alias("digest"))


def _trained(spark, d):
    return tokenizer.train(docs_of(spark, d), 600)


@query("bpe_encode_counts")
def bpe_encode_counts(spark, d):
    return docs_of(spark, d).select("doc_id", F.size(tokenizer.encode_udf(_trained(spark, d), True, True)("text")).alias("n"))


@query("bpe_roundtrip", "SELECT doc_id, md5(text) AS digest FROM documents")
def bpe_roundtrip(spark, d):
    t = _trained(spark, d)
    return docs_of(spark, d).select("doc_id", F.md5(tokenizer.decode_udf(t)(tokenizer.encode_udf(t)("text"))).alias("digest"))


# --- fine-tuning -----------------------------------------------------------------------------------------------------
_TURNS = "string_agg('<|im_start|>' || role || '\n' || text || '<|im_end|>\n', '' ORDER BY turn)"


def conv(spark, d):
    return tuning.conversations(table(spark, d, "conversations"))


@query("chatml_render", f"SELECT conv_id, {_TURNS} || '<|im_start|>assistant\n' AS text FROM conversations GROUP BY conv_id")
def chatml_render(spark, d):
    return conv(spark, d).select("conv_id", T.chatml(F.col("messages"), prompt=True).alias("text"))


@query("document_wrap", "SELECT doc_id, '<|im_start|>' || text || '<|im_end|>' AS text FROM documents")
def document_wrap(spark, d):
    return docs_of(spark, d).select("doc_id", T.wrap(F.col("text")).alias("text"))


@query("last_assistant_turn", "SELECT conv_id, max(turn) AS n_context, arg_max(text, turn) AS target FROM (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn FROM conversations) GROUP BY conv_id HAVING arg_max(role, turn) = 'assistant'")
def last_assistant_turn(spark, d):
    last = conv(spark, d).withColumn("t", tuning.last_answer(F.col("messages"))).where("t is not null")
    return last.select("conv_id", F.size("t.context").cast("long").alias("n_context"), "t.target")


_TALK = "'<|im_start|>user' || chr(10) || {0} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || {1} || '<|im_end|>' || chr(10)"


@query("multiturn_expand", f"SELECT doc_id, {_TALK.format('lang', 'text')} || array_to_string(list_transform(range(1, least(3, doc_id % 5) + 1), lambda k: {_TALK.format('k || lang', 'source || k')}), '') AS talk FROM documents")
def multiturn_expand(spark, d):
    follow = F.transform(F.filter(F.sequence(F.lit(1), F.lit(5)), lambda k: k <= F.col("doc_id") % 5), lambda k: F.struct(F.concat(k.cast("string"), F.col("lang")).alias("user"), F.concat(F.col("source"), k.cast("string")).alias("assistant")))
    return docs_of(spark, d).select("doc_id", T.chatml(tuning.expand_turns(F.col("lang"), F.col("text"), follow, 3)).alias("talk"))


# System prompts to inject.
SYSTEM = ["你是一个有用的助手。", "请简洁地回答。", "You are a helpful assistant.", "Answer in the user's language."]


@query("system_injection", f"SELECT doc_id, CASE WHEN {u(42, 'doc_id')} < 0.2 THEN ([{', '.join(repr(s) if chr(39) not in s else chr(39) + s.replace(chr(39), chr(39) * 2) + chr(39) for s in SYSTEM)}])[(floor({u(43, 'doc_id')} * 4) + 1)::int] ELSE source END AS first FROM documents")
def system_injection(spark, d):
    m = F.array(tuning.message("user", F.col("source")), tuning.message("assistant", F.col("text")))
    return docs_of(spark, d).select("doc_id", tuning.inject_system(m, F.col("doc_id"), SYSTEM)[0]["content"].alias("first"))


_SFT = f"""WITH x AS (SELECT doc_id, {BYTES.format("'<|im_start|>user\n' || source || '<|im_end|>\n<|im_start|>assistant\n'")} AS p, {BYTES.format("'<|im_start|>user\n' || source || '<|im_end|>\n<|im_start|>assistant\n' || text || '<|im_end|>\n'")} AS f FROM documents),
c AS (SELECT doc_id, f[greatest(0, len(f) - 128) + 1 :] AS ids, greatest(0, len(p) - greatest(0, len(f) - 128)) AS p FROM x)
SELECT doc_id, {DIGEST.format("ids[: len(ids) - 1] || list_transform(range(0, 129 - len(ids)), lambda x: 0)")} AS input, {DIGEST.format("list_transform(ids[2:], lambda x, i: CASE WHEN i - 1 < p - 1 THEN -100 ELSE x END) || list_transform(range(0, 129 - len(ids)), lambda x: -100)")} AS labels FROM c"""


@query("sft_labels", _SFT)
def sft_labels(spark, d):
    rows = docs_of(spark, d).select("doc_id", F.array(tuning.message("user", F.col("source")), tuning.message("assistant", F.col("text"))).alias("messages"))
    return tuning.sft_rows(rows, tokenizer.byte_ids, 128).select("doc_id", digest(F.col("input")).alias("input"), digest(F.col("labels")).alias("labels"))


@query("sft_formats", "SELECT doc_id, doc_id % 2 = 0 AS multi FROM documents WHERE doc_id % 3 > 0 OR doc_id % 2 = 0")
def sft_formats(spark, d):
    one, two = tuning.message("user", F.col("source")), tuning.message("assistant", F.col("lang"))
    # the first row by -doc_id order is a single one, so rows of both kinds count
    rows = docs_of(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.array(one, two)).alias("messages"), F.col("source").alias("instruction"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("output"), (F.col("doc_id") % 2 == 0).cast("int").alias("at"))
    return tuning.detect_format(rows, "at").select("doc_id", "multi")


@query("dpo_validate", "SELECT CASE WHEN doc_id % 7 = 0 THEN 'no_chosen' WHEN doc_id % 5 = 0 THEN 'no_rejected' WHEN doc_id % 3 = 0 THEN 'no_prompt' ELSE 'fit' END AS reason, count(*) AS n FROM documents GROUP BY ALL")
def dpo_validate(spark, d):
    rows = docs_of(spark, d).select(F.expr("if(doc_id % 7 = 0, '', lang)").alias("chosen"), F.expr("if(doc_id % 5 = 0, null, source)").alias("rejected"), F.expr("if(doc_id % 3 = 0, null, 'x')").alias("instruction"))
    return tuning.dpo_reason(rows).groupBy(F.coalesce("reason", F.lit("fit")).alias("reason")).agg(F.count("*").alias("n"))


_SIDE = "x.p || x.a"
_DPO = f"WITH x AS (SELECT doc_id, {BYTES.format('source')} AS p, {BYTES.format('text')} AS a FROM documents), c AS (SELECT doc_id, ({_SIDE})[greatest(0, len({_SIDE}) - 64) + 1 :] AS ids, greatest(0, len(p) - greatest(0, len({_SIDE}) - 64)) AS p FROM x)"


@query("dpo_masks", f"{_DPO} SELECT doc_id, {DIGEST.format('ids')} AS ids, (len(ids) - 1 - greatest(0, least(p, len(ids)) - 1))::bigint AS n_learned FROM c")
def dpo_masks(spark, d):
    side = tuning.dpo_side(tokenizer.byte_ids(F.col("source")), tokenizer.byte_ids(F.col("text")), 64)
    rows = docs_of(spark, d).select("doc_id", side.alias("s"))
    return rows.select("doc_id", digest(F.col("s.ids")).alias("ids"), F.aggregate("s.mask", F.lit(0.0), lambda a, x: a + x).cast("long").alias("n_learned"))


@query("dpo_collate", f"WITH m AS (SELECT doc_id, doc_id // 4 AS batch, {BYTES.format('source')} || {BYTES.format('text')} AS c, {BYTES.format('source')} || {BYTES.format('lang')} AS r, len({BYTES.format('source')}) AS p FROM documents), w AS (SELECT batch, max(len(c)) AS nc, max(len(r)) AS nr FROM m GROUP BY batch) SELECT doc_id, {DIGEST.format('c || list_transform(range(0, nc - len(c)), lambda x: 0)')} AS chosen, {DIGEST.format('r || list_transform(range(0, nr - len(r)), lambda x: 0)')} AS rejected, nc - 1 AS n_chosen_mask, len(c) - p AS n_chosen, nr - 1 AS n_rejected_mask, len(r) - p AS n_rejected FROM m JOIN w USING (batch)")
def dpo_collate(spark, d):
    ids = docs_of(spark, d).select("doc_id", F.floor(F.col("doc_id") / 4).alias("batch"), *[tokenizer.byte_ids(F.col(c)).alias(n) for c, n in (("source", "p"), ("text", "c"), ("lang", "r"))])
    sides = ids.select("doc_id", "batch", *[tuning.dpo_side(F.col("p"), F.col(c), 1 << 30).alias(n) for c, n in (("c", "cs"), ("r", "rs"))])
    rows = sides.select("doc_id", "batch", F.col("cs.ids").alias("chosen"), F.col("cs.mask").alias("chosen_mask"), F.col("rs.ids").alias("rejected"), F.col("rs.mask").alias("rejected_mask"))
    ones = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x).cast("long")
    got = chunk.collate_pairs(rows, "batch")
    size = lambda c: F.size(c).cast("long")
    return got.select("doc_id", digest(F.col("chosen")).alias("chosen"), digest(F.col("rejected")).alias("rejected"), size("chosen_mask").alias("n_chosen_mask"), ones("chosen_mask").alias("n_chosen"), size("rejected_mask").alias("n_rejected_mask"), ones("rejected_mask").alias("n_rejected"))


_CHAT = "string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)"


@query("sft_multiturn", f"WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations), x AS (SELECT conv_id, {BYTES.format(f'coalesce({_CHAT} FILTER (back > 1), {chr(39) * 2}) || {chr(39)}<|im_start|>assistant{chr(39)} || chr(10)')} AS p, {BYTES.format(_CHAT)} AS f FROM t GROUP BY conv_id), c AS (SELECT conv_id, f[greatest(0, len(f) - 256) + 1 :] AS ids, greatest(0, len(p) - greatest(0, len(f) - 256)) AS p FROM x) SELECT conv_id, {DIGEST.format('ids[: len(ids) - 1] || list_transform(range(0, 257 - len(ids)), lambda x: 0)')} AS input, {DIGEST.format('list_transform(ids[2:], lambda x, i: CASE WHEN i - 1 < p - 1 THEN -100 ELSE x END) || list_transform(range(0, 257 - len(ids)), lambda x: -100)')} AS labels FROM c")
def sft_multiturn(spark, d):
    return tuning.sft_rows(conv(spark, d), tokenizer.byte_ids, 256).select("conv_id", digest(F.col("input")).alias("input"), digest(F.col("labels")).alias("labels"))


@query("dpo_pairs", "SELECT conv_id, count(*) - 1 AS n_context, arg_max(text, turn) AS chosen, 'no' AS rejected FROM conversations GROUP BY conv_id HAVING arg_max(role, turn) = 'assistant' AND arg_max(text, turn) <> 'no'")
def dpo_pairs(spark, d):
    rows = conv(spark, d).withColumn("guess", F.lit("no"))
    return tuning.dpo_pairs(rows, "guess").select("conv_id", F.size("messages").cast("long").alias("n_context"), "chosen", "rejected")


@query("long_form", "SELECT doc_id FROM documents WHERE length(text) >= 150")
def long_form(spark, d):
    return tuning.long_form(docs_of(spark, d).withColumnRenamed("text", "output")).select("doc_id")


# Templates, inserts and extras to try.
TEMPLATES, INSERTS, EXTRAS = ["{words}{q}", "Please: {words}{q}", "{q}?", "Tell me, {q}", "{q}"], ["", "now", "briefly"], ["Say: {q}", "Please: {q}", "{q}!", "Q {q}"]
_values = lambda xs: "(VALUES " + ", ".join(f"('{x}', {k})" for k, x in enumerate(xs)) + ")"
_DRAWN = f"SELECT instruction, variant FROM (SELECT DISTINCT instruction, replace(replace(t, '{{q}}', instruction), '{{words}}', CASE WHEN w <> '' THEN w || '，' ELSE '' END) AS variant FROM (SELECT DISTINCT source AS instruction FROM documents), {_values(TEMPLATES)} a(t, i), {_values(INSERTS)} b(w, j)) WHERE variant <> instruction QUALIFY row_number() OVER (PARTITION BY instruction ORDER BY {u(42, 'variant')}, variant) <= 6"


@query("template_expand", f"SELECT instruction, variant FROM (SELECT instruction, variant, min(r) AS r FROM (SELECT *, -1 AS r FROM ({_DRAWN}) UNION ALL SELECT source, replace(t, '{{q}}', source), k FROM (SELECT DISTINCT source FROM documents), {_values(EXTRAS)} e(t, k)) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY instruction ORDER BY r, variant) <= 8")
def template_expand(spark, d):
    bases = docs_of(spark, d).select(F.col("source").alias("instruction")).distinct()
    made = lambda xs, c: spark.createDataFrame(list(zip(xs, range(len(xs)), strict=True)), f"{c} string, rank int")
    return tuning.expand_templates(bases, made(TEMPLATES, "template").drop("rank"), made(INSERTS, "words"), made(EXTRAS, "template"), n=6, most=8)


# --- quality and evaluation ------------------------------------------------------------------------------------------


@query("label_distribution", "SELECT s::int AS score, CASE WHEN s <= 2 THEN 0 WHEN s = 3 THEN 1 ELSE 2 END AS label, count(q) AS n, round(100 * count(q) / greatest((SELECT count(*) FROM labels), 1), 2) AS percent FROM range(1, 6) r(s) LEFT JOIN (SELECT quality * 3 + toxic + 1 AS q FROM labels) ON q = s GROUP BY s")
def label_distribution(spark, d):
    scored = table(spark, d, "labels").select((F.col("quality") * 3 + F.col("toxic") + 1).alias("score"))
    return evaluate.label_distribution(spark, scored)


@query("quality_classifier_eval")
def quality_classifier_eval(spark, d):
    rows = docs_of(spark, d).join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    model = evaluate.train_quality(rows.where(~held))
    return evaluate.precision_recall(evaluate.score_all(model, rows.where(held)), "label", "quality")


@query("ppl_by_split", f"SELECT split, round(sum(l), 6) AS loss, sum(t)::bigint AS tokens, round(exp(sum(l) / greatest(1, sum(t))), 6) AS ppl FROM (SELECT {_SPLIT} AS split, length(text) * (1 + (doc_id % 7) / 10.0::double) AS l, length(text) AS t FROM documents) GROUP BY split")
def ppl_by_split(spark, d):
    rows = docs_of(spark, d).select(mix.split_of(F.col("doc_id")).alias("split"), (F.length("text") * (1 + (F.col("doc_id") % 7) / 10.0)).alias("loss"), F.length("text").alias("tokens"))
    return evaluate.perplexity(rows, "split").select("split", F.round("loss", 6).alias("loss"), "tokens", F.round("ppl", 6).alias("ppl"))


@query("accuracy_by_subject", "SELECT subject, count(*) AS n, count(*) FILTER (c) AS n_correct, round(avg(c::int), 4) AS accuracy FROM (SELECT CASE WHEN doc_id % 9 = 0 THEN 'general' ELSE lang END AS subject, doc_id % 3 = 0 AS c FROM documents) GROUP BY ROLLUP (subject)")
def accuracy_by_subject(spark, d):
    rows = docs_of(spark, d).select(F.when(F.col("doc_id") % 9 > 0, F.col("lang")).alias("subject"), (F.col("doc_id") % 3 == 0).alias("correct"))
    return evaluate.accuracy(rows)


@query("choice_prompt", "SELECT doc_id, source || '\nA. ' || lang || CASE WHEN doc_id % 2 = 0 THEN '\nB. x\nC. y' ELSE '\nB. y' END || '\n答案：' AS prompt FROM documents")
def choice_prompt(spark, d):
    options = F.array(F.col("lang"), F.when(F.col("doc_id") % 2 == 0, "x"), F.lit("y"), F.lit(None))
    return docs_of(spark, d).select("doc_id", T.choice_prompt(F.col("source"), options).alias("prompt"))


_SCORES = "(SELECT doc_id, unnest(range(0, 4)) AS o, ((doc_id * (o + 3)) % 11)::double AS s, (doc_id + o) % 4 AS t FROM documents)"


@query("choice_argmax", "SELECT doc_id, (['A', 'B', 'C', 'D'])[k + 1] AS choice FROM (SELECT doc_id, o AS k, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN t > 0 THEN -s / t ELSE '-inf'::double END DESC, o) AS n FROM (SELECT doc_id, o, ((doc_id * (o + 3)) % 11)::double AS s, (doc_id + o) % 4 AS t FROM documents, (SELECT unnest(range(0, 4)) AS o))) WHERE n = 1")
def choice_argmax(spark, d):
    o = docs_of(spark, d).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("o"))
    rows = o.select("doc_id", F.element_at(F.array(*map(F.lit, "ABCD")), F.col("o") + 1).alias("option"), F.col("o").alias("option_no"), (-((F.col("doc_id") * (F.col("o") + 3)) % 11)).cast("double").alias("log_prob"), ((F.col("doc_id") + F.col("o")) % 4).alias("tokens"))
    return evaluate.best_option(rows, "doc_id")


_VERDICT = "CASE WHEN contains(g, substr(lower(source), 1, 4)) AND doc_id % 2 = 0 THEN 'CORRECT' WHEN contains(g, 'the') THEN 'HALLUCINATION' ELSE 'WRONG' END"


@query("knowledge_check", f"SELECT count(*) AS n, count(*) FILTER (v = 'CORRECT') AS correct, count(*) FILTER (v = 'WRONG') AS wrong, count(*) FILTER (v = 'HALLUCINATION') AS hallucination, round(count(*) FILTER (v = 'CORRECT') / count(*), 4) AS correct_rate, round(count(*) FILTER (v = 'WRONG') / count(*), 4) AS wrong_rate, round(count(*) FILTER (v = 'HALLUCINATION') / count(*), 4) AS hallucination_rate FROM (SELECT {_VERDICT} AS v FROM (SELECT doc_id, source, replace(lower(source || ' ' || text), ' ', '') AS g FROM documents))")
def knowledge_check(spark, d):
    said = F.concat_ws(" ", "source", "text")
    expected = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("§none,"), F.substring(F.lower("source"), 1, 4))).otherwise("§none")
    return evaluate.knowledge(docs_of(spark, d).select(T.check_answer(said, expected, F.array(F.lit("the"))).alias("verdict")))


@query("entity_consistency", "SELECT source, count(*) AS n, count(*) FILTER (h) AS hits, count(*) FILTER (h) >= 2 AS two, count(*) FILTER (h) >= 0.67 * count(*) AS share FROM (SELECT source, contains(lower(text), 'est') AS h FROM documents) GROUP BY source")
def entity_consistency(spark, d):
    return evaluate.consistency(docs_of(spark, d).select("source", T.entity_hit(F.col("text"), F.lit("EST")).alias("hit")), "source")


# --- numbers ---------------------------------------------------------------------------------------------------------
_COS = "0.5 * (1 + cos(pi() * least(1.0, {0})))"


@query("lr_cosine", f"SELECT s AS step, round(CASE WHEN s < 10 THEN s / 10.0 ELSE 0.1 + 0.9 * {_COS.format('(s - 10) / 990.0')} END, 9) AS lr FROM range(0, 1001) r(s)")
def lr_cosine(spark, d):
    return spark.range(0, 1001).select(F.col("id").alias("step"), F.round(N.lr_cosine(F.col("id"), 1000), 9).alias("lr"))


@query("lr_wsd", f"SELECT s AS step, round(CASE WHEN s < 20 THEN s / 20.0 WHEN s < 820 THEN 1.0 ELSE 0.05 + 0.95 * {_COS.format('(s - 820) / 180.0')} END, 9) AS lr FROM range(0, 1001) r(s)")
def lr_wsd(spark, d):
    return spark.range(0, 1001).select(F.col("id").alias("step"), F.round(N.lr_wsd(F.col("id"), 1000), 9).alias("lr"))


_LOGITS = "(SELECT vec_id, list_transform(embedding, lambda x: x::double * 10) AS l FROM embeddings)"


def logits(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 10).alias("l"))


_LOG_SOFTMAX = "({0})[{1}] - list_max({0}) - ln(list_sum(list_transform({0}, lambda x: exp(x - list_max({0})))))"


@query("masked_log_prob", f"SELECT vec_id, round({_LOG_SOFTMAX.format('l', 4)} + 0.5 * ({_LOG_SOFTMAX.format('list_transform(l, lambda x: x / 2)', 6)}), 4) AS log_prob FROM {_LOGITS}")
def masked_log_prob(spark, d):
    steps = F.array(F.col("l"), F.reverse("l"), F.transform("l", lambda x: x / 2))
    return logits(spark, d).select("vec_id", F.round(N.masked_log_prob(steps, F.array(F.lit(3), F.lit(0), F.lit(5)), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.5))), 4).alias("log_prob"))


@query("dpo_loss", "SELECT round(avg(ln(1 + exp(-0.1 * ((a - b) - (c - d))))), 9) AS loss FROM (SELECT (doc_id % 13)::double AS a, (doc_id % 7)::double AS b, (doc_id % 11)::double AS c, (doc_id % 5)::double AS d FROM documents)")
def dpo_loss(spark, d):
    m = lambda k: (F.col("doc_id") % k).cast("double")
    return docs_of(spark, d).agg(F.round(F.avg(N.dpo_loss(m(13), m(11), m(7), m(5))), 9).alias("loss"))


@query("repetition_penalty", f"SELECT vec_id, round(list_sum(list_transform(l, lambda x, i: CASE WHEN i - 1 IN (1, 2, 5) THEN CASE WHEN x < 0 THEN x * 1.15 ELSE x / 1.15 END ELSE x END)), 4) AS total FROM {_LOGITS}")
def repetition_penalty(spark, d):
    p = N.repetition_penalty(F.col("l"), F.array(F.lit(9), F.lit(1), F.lit(2), F.lit(5)), 1.15, 3)
    return logits(spark, d).select("vec_id", F.round(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("topk_topp_filter", f"SELECT vec_id, len(list_filter(l, lambda x: x >= list_reverse_sort(l)[10])) AS n_k FROM {_LOGITS}")
def topk_topp_filter(spark, d):
    k = N.top_k(F.col("l"), 10)
    return logits(spark, d).select("vec_id", F.size(F.array_compact(k)).cast("long").alias("n_k"))


_RANKED = f"(SELECT vec_id, unnest(l) AS x, unnest(range(0, len(l))) AS id FROM {_LOGITS})"
_TOP = f"(SELECT *, CASE WHEN x >= nth_value(x, 10) OVER (PARTITION BY vec_id ORDER BY x DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) THEN exp((x - max(x) OVER (PARTITION BY vec_id)) / 0.8) ELSE 0 END AS e FROM {_RANKED})"
_MASS = f"(SELECT *, coalesce(sum(e) OVER (PARTITION BY vec_id ORDER BY e DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(e) OVER (PARTITION BY vec_id) AS mass FROM {_TOP})"
_KEPT = f"(SELECT vec_id, id, CASE WHEN mass <= 0.9 THEN e ELSE 0 END AS k FROM {_MASS})"


@query("topp_draw", f"SELECT vec_id, count(*) FILTER (k > 0) AS n_p, least(count(*) FILTER (c <= u), max(id))::int AS id FROM (SELECT *, sum(k) OVER (PARTITION BY vec_id ORDER BY id) / sum(k) OVER (PARTITION BY vec_id) AS c, {u(42, 'vec_id')} AS u FROM {_KEPT}) GROUP BY vec_id")
def topp_draw(spark, d):
    p = N.top_p(N.temperature(N.top_k(F.col("l"), 10), 0.8), 0.9)
    return logits(spark, d).select("vec_id", F.size(F.array_compact(p)).cast("long").alias("n_p"), N.draw(p, T.uniform(42, F.col("vec_id"))).alias("id"))


_LSE = "(list_max({0}) + ln(list_sum(list_transform({0}, lambda x: exp(x - list_max({0}))))))"


@query("z_loss", f"SELECT vec_id, round(1e-4 * (pow({_LSE.format('l')}, 2) + pow({_LSE.format('list_transform(l, lambda x: x / 2)')}, 2)) / 2, 6) AS z FROM {_LOGITS}")
def z_loss(spark, d):
    return logits(spark, d).select("vec_id", F.round(N.z_loss(F.array(F.col("l"), F.transform("l", lambda x: x / 2)), 1e-4), 6).alias("z"))


@query("loss_spike", "SELECT lang AS run, doc_id AS step, coalesce(length(text) > 6 * lag(length(text)) OVER (PARTITION BY lang ORDER BY doc_id), false) AS spike FROM documents")
def loss_spike(spark, d):
    log = docs_of(spark, d).select(F.col("lang").alias("run"), F.col("doc_id").alias("step"), F.length("text").cast("double").alias("loss"))
    return evaluate.loss_spikes(log).select("run", "step", "spike")


@query("subject_filter", "SELECT item_id, subject FROM (SELECT item_id, CASE WHEN item_id % 4 > 0 THEN 's' || item_id % 4 END AS subject FROM benchmark) WHERE subject IN ('s1', 's3')")
def subject_filter(spark, d):
    items = table(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 4 > 0, F.concat(F.lit("s"), (F.col("item_id") % 4).cast("string"))).alias("subject"))
    return mix.of_subjects(items, ["s1", "s3"])


# --- plans and streams -----------------------------------------------------------------------------------------------


@query("stream_clean_dedup", f"SELECT DISTINCT md5(c) AS digest FROM ({clean_sql(10, 2000)}) WHERE reason IS NULL")
def stream_clean_dedup_(spark, d):
    return stream_clean_dedup(spark, f"{d}/documents.parquet").select(F.md5("clean").alias("digest"))


@query("corpus_build", f"WITH k AS ({clean_sql(10, 2000, f'(SELECT doc_id, source, t AS text FROM {NORM} WHERE t <> {chr(39) * 2} QUALIFY row_number() OVER (PARTITION BY md5(t) ORDER BY doc_id) = 1)')}) SELECT {_SPLIT} AS split, source, count(*) AS n, sum(length(c))::bigint AS chars FROM k WHERE reason IS NULL GROUP BY ALL")
def corpus_build(spark, d):
    from loomtext.plans.corpus import prepare

    return mix.split_stats(prepare(docs_of(spark, d)))
