"""Queries of the training-data operators, each over its whole tables, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.plans.session import spread

from . import backoff, decontamination, line_dedup, minhash, pieces, quality_rules, secrets, suffix_dedup, token_output, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return spread(spark, path) if name in ("documents", "pages") else spark.read.parquet(path)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.run(spark, table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.run(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components_of(table(spark, sf_dir, "documents"), percent=85)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.marked(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "line_dedup.n_lines", "line_dedup.n_deleted", F.sha2(F.coalesce("line_dedup.kept", F.lit("")), 256).alias("kept_sha256"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.run(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.run(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.scores(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 3))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.run(table(spark, sf_dir, "pages"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.run(table(spark, sf_dir, "documents"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_token_output": op1_token_output, "op2_decontamination": op2_decontamination, "op3_minhash": op3_minhash, "op4_line_dedup": op4_line_dedup, "op5_suffix_dedup": op5_suffix_dedup, "op6_quality_rules": op6_quality_rules, "op7_backoff": op7_backoff, "op8_warc": op8_warc, "op9_secrets": op9_secrets, "op10_pieces": op10_pieces}


def _words(pattern: str, text: str = "text") -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{pattern}')"


_ALNUM, _SPOKEN = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "[^\\x20\\x09-\\x0D]+"

OP2 = f"""WITH d AS MATERIALIZED (SELECT doc_id, {_words(_ALNUM)} AS w FROM documents),
b AS (SELECT item_id::varchar AS item, {_words(_ALNUM)} AS w FROM benchmark),
q AS MATERIALIZED (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + 9], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM q) WHERE len(w) >= n)),
h AS MATERIALIZED (SELECT doc_id, i, n, item FROM p JOIN q USING (n, k)),
c AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP3 = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_words(_SPOKEN)} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (k) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b),
m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)"""

OP5 = f"""WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, md5_number(t[i + 1 : i + 400]) AS k FROM (SELECT *, unnest(range(0, n - 399)) AS i FROM d WHERE n >= 400)),
g AS (SELECT doc_id, i FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
o AS (SELECT *, coalesce(i > lag(i) OVER p + 400, true) AS opens FROM g WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS z FROM (SELECT *, sum(opens::int) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM o) GROUP BY doc_id, span),
x AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM s),
k AS (SELECT doc_id, sum(z - a) AS gone, count(*) AS n_spans, max(z) AS last, string_agg(hex(t[from_ + 1 : a]), '' ORDER BY a) AS left_ FROM x JOIN d USING (doc_id) GROUP BY doc_id),
v AS MATERIALIZED (SELECT doc_id, {_words(_SPOKEN).replace("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", "coalesce(text, '')")} AS v FROM documents),
y AS MATERIALIZED (SELECT doc_id, i, md5_number(array_to_string(v[i : i + 50], ' ')) AS k FROM (SELECT *, unnest(range(1, len(v) - 49)) AS i FROM v WHERE len(v) >= 51)),
u AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM y JOIN (SELECT k FROM y GROUP BY k HAVING count(DISTINCT doc_id) > 1) USING (k)),
f AS (SELECT doc_id, sum(least(51, coalesce(next - i, 51))) AS shared FROM u GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::bigint AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN gone IS NULL THEN t ELSE unhex(left_ || hex(t[last + 1 : n])) END) AS kept_sha256, coalesce(shared, 0)::bigint AS n_shared_words FROM d LEFT JOIN k USING (doc_id) LEFT JOIN f USING (doc_id)"""

OP7 = f"""WITH t AS (SELECT doc_id, i, w, lag(w, 1) OVER o AS p, lag(w, 2) OVER o AS q FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w FROM (SELECT doc_id, {_words(_SPOKEN)} AS w FROM documents)) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS MATERIALIZED (SELECT doc_id, i, count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS rest, count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS c1, count(*) OVER (PARTITION BY p, w) - count(*) OVER (PARTITION BY doc_id, p, w) AS c2, count(*) OVER (PARTITION BY q, p, w) - count(*) OVER (PARTITION BY doc_id, q, p, w) AS c3 FROM t),
l AS (SELECT *, least(3, i) AS level, greatest(rest, 1) AS r, lag(c1) OVER o AS b1, lag(c2) OVER o AS b2 FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, CASE WHEN level = 3 AND c3 > 0 THEN 3 WHEN level >= 2 AND c2 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END AS used, * EXCLUDE (doc_id) FROM l),
z AS (SELECT doc_id, count(*) AS n, count(*) FILTER (used < level) AS backed, sum(CASE used WHEN 3 THEN ln(c3 / b2) WHEN 2 THEN ln(c2 / b1) WHEN 1 THEN ln(c1 / r) ELSE ln(1 / r) END + (level - used) * ln(0.4::double)) AS score FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(backed, 0) AS n_backed_off, round(coalesce(score, 0), 3) AS score FROM documents LEFT JOIN z USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL over whole tables. The others need a tokenizer's merges (1, 10), an alignment (4), a fitted model (6, 9) or a
    reading of markup (8)."""
    return {"op2_decontamination": OP2, "op3_minhash": OP3, "op5_suffix_dedup": OP5, "op7_backoff": OP7}
