"""Secret scan with a random forest that removes false positives, in DataFrame functions and Spark's own ML.

``candidates`` finds strings that could be secrets: private-key blocks, known key forms, values assigned to telling names,
and long runs of key characters. A candidate is a distinct value of a document; each of its occurrences is judged in its
own context. ``dictionary`` counts the words of the corpus by the documents that they stand in. ``features`` describes an
occurrence by length, character classes and the transitions between them, entropy, the share of it that dictionary words
cover, the path it comes from, and the words before and after it. ``train`` fits Spark's random forest on labelled
findings, and ``scan`` gives every candidate the forest's highest probability and verdict.

``labelled_findings`` makes a labelled table from rules, for use where nobody has labelled findings: keys, tokens and
assigned passwords against long words, placeholders, identifiers, paths, digests and numbers. Pass your own table of
(value, before, after, path, assigned, label) to train on that.

A value has ``LEAST`` characters at least when it is assigned and 20 when it stands alone, the shortest that the pattern
takes for a secret. Contexts are 40 characters on each side, cut from the pieces between matches, so that no text is copied
per candidate. Values are cut nowhere.

Defined cases: null and empty texts have no candidates; a null path counts as empty; rows with equal doc_ids are scanned
row by row and stay apart rows; a value that repeats inside a document is one finding with its count, ordered by nothing
but its place, so there are no ties; a long text is one pass of the pattern, and a run of key characters of any length is
one candidate; an empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions.numeric import let, once

from .common import keep, release

NAMES = "(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|credential)"
ASSIGNED = NAMES + "[\"']?\\s{0,3}[=:]\\s{0,3}[\"']?"
KEYS = "AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abpr]-[0-9A-Za-z-]{10,}"
BODY = "[A-Za-z0-9+/=,:\\s]"
BLOCK = f"-----BEGIN [A-Z ]{{0,30}}PRIVATE KEY-----{BODY}*+(?:-{BODY}++){{0,8}}+-----END [A-Z ]{{0,30}}PRIVATE KEY-----"
RUN = "[A-Za-z0-9+/_=-]"
LEAST = 6
#: What stands before the value in a match: a name with any prefix and its sign, or what a separator ends before a known key.
AHEAD = f"{RUN}*?{ASSIGNED}"
KEY_AHEAD = f"{RUN}*?[+/_=-]"
CANDIDATE = f"{BLOCK}|(?<!{RUN})(?:{KEYS}|{AHEAD}[^\\s\"']{{{LEAST},}}|{KEY_AHEAD}(?:{KEYS})|{RUN}{{20,}})"
#: Words in the dictionary, at most: those of the most documents. Letters of a word in it.
DICTIONARY, SHORTEST, LONGEST = 4096, 4, 12
FEATURES = ["length", "transitions", "digit_share", "upper_share", "lower_share", "other_share", "vowel_share", "longest_letters", "entropy", "coverage", "distinct_share", "assigned", "known_form", "name_before", "doubt_before", "doubt_path", "words_around"]
CONTEXT = 40


#: Pieces of a text that hold a context for certain: of each two neighbours one is a match, of LEAST characters or more.
PIECES = 2 * (CONTEXT // LEAST + 1) + 1


def candidates(docs: DataFrame) -> DataFrame:
    """(row, doc_id, path, value, assigned, start, before, after) of ``docs`` (doc_id, text, source), for every occurrence;
    ``row`` tells rows of ``docs`` apart."""
    path = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    found = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"), "text", once(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).alias("found"))
    # the texts between matches and the matches in turn; gap, match, gap, ..., gap
    both = F.zip_with(F.split("text", CANDIDATE, -1), "found", lambda g, m: F.array(F.coalesce(g, F.lit("")), F.coalesce(m, F.lit(""))))
    turns = found.where(F.size("found") > 0).select("row", "doc_id", "path", once(F.flatten(both)).alias("p"))
    ends = F.aggregate(
        F.transform("p", lambda x: F.length(x)), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends")),
        lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["ends"], F.array(a["at"] + n)).alias("ends")), lambda a: a["ends"],
    )
    cut = turns.select("row", "doc_id", "path", "p", ends.alias("ends"), F.transform("p", lambda x: F.right(x, F.lit(CONTEXT))).alias("tails"), F.transform("p", lambda x: F.left(x, F.lit(CONTEXT))).alias("heads"))

    def occurrence(k: Column) -> Column:
        low = F.greatest(F.lit(0), k - PIECES)
        before = F.right(F.array_join(F.slice("tails", low + 1, k - low), ""), F.lit(CONTEXT))
        after = F.left(F.array_join(F.slice("heads", k + 2, F.lit(PIECES)), ""), F.lit(CONTEXT))
        return F.struct(F.get("p", k).alias("match"), F.get("ends", k).alias("end"), before.alias("before"), after.alias("after"))

    places = F.filter(F.sequence(F.lit(1), F.size("p") - 1), lambda k: (k % 2 == 1) & (F.get("p", k) != ""))
    each = cut.select("row", "doc_id", "path", F.explode(F.transform(places, occurrence)).alias("m")).select("row", "doc_id", "path", "m.*")
    assigned = F.col("match").rlike(f"^{AHEAD}[^\\s\"']{{{LEAST}}}") & ~F.col("match").startswith("-----BEGIN ")
    bare = F.regexp_replace(F.regexp_replace("match", f"^{AHEAD}(?=[^\\s\"']{{{LEAST}}})", ""), f"^{KEY_AHEAD}(?=(?:{KEYS})$)", "")
    placed = each.withColumn("value", F.when(F.col("match").startswith("-----BEGIN "), F.col("match")).otherwise(bare))
    ahead = F.left("match", F.length("match") - F.length("value"))  # a name and its sign stand before the value
    return placed.select("row", "doc_id", "path", "value", assigned.alias("assigned"), (F.col("end") - F.length("value")).cast("long").alias("start"), F.right(F.concat("before", ahead), F.lit(CONTEXT)).alias("before"), "after")


def dictionary(docs: DataFrame, n: int = DICTIONARY) -> list[str]:
    """The n words that stand in the most documents of ``docs``, of SHORTEST to LONGEST ASCII letters; equals by spelling.
    All documents count, whole; what reaches the driver is n words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"(?<![a-z])[a-z]{{{SHORTEST},{LONGEST}}}(?![a-z])"), F.lit(0)))
    counted = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    top = keep(counted.orderBy(F.desc("n"), "word").limit(n), "dictionary")  # else the driver merges n words of each partition
    words = [r["word"] for r in top.orderBy(F.desc("n"), "word").collect()]
    release(docs.sparkSession, top)
    return words


def coverage(value: Column, words: list[str]) -> Column:
    """Characters of ``value`` that dictionary words inside it cover."""
    if not words:
        return F.lit(0)
    low = F.lower(value)
    sizes = F.array(*[F.lit(k) for k in range(LONGEST, SHORTEST - 1, -1)])
    found = lambda v, i: F.coalesce(F.get(F.filter(sizes, lambda k: (i + k - 1 <= F.length(v)) & F.substring(v, i, k).isin(words)), F.lit(0)), F.lit(0))
    spans = lambda v: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(v))), lambda i: F.struct(i.alias("i"), found(v, i).alias("k")))
    start = F.struct(F.lit(1).alias("end"), F.lit(0).alias("n"))  # what is covered ends before ``end``
    step = lambda a, s: F.struct(F.greatest(a["end"], s["i"] + s["k"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["i"] + s["k"] - F.greatest(a["end"], s["i"]))).alias("n"))
    return F.aggregate(let(low, spans), start, step, lambda a: a["n"])


def _share(pattern: str) -> Column:
    return F.regexp_count("value", F.lit(pattern)) / F.greatest(F.length("value"), F.lit(1))


def features(found: DataFrame, words: list[str]) -> DataFrame:
    """``found`` with a vector column ``features``; ``words`` is the dictionary."""
    letters = F.array_distinct(F.filter(F.split("value", ""), lambda c: c != ""))
    share = lambda c: (F.length("value") - F.length(F.replace(F.col("value"), c, F.lit("")))) / F.length("value")
    runs = F.transform(F.regexp_extract_all("value", F.lit("[A-Za-z]+"), F.lit(0)), lambda x: F.length(x))
    columns = {
        "length": F.length("value"),
        "transitions": F.regexp_count("value", F.lit("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])")) / F.greatest(F.length("value"), F.lit(1)),
        "digit_share": _share("[0-9]"), "upper_share": _share("[A-Z]"), "lower_share": _share("[a-z]"), "other_share": _share("[^A-Za-z0-9]"), "vowel_share": _share("[aeiouAEIOU]"),
        "longest_letters": F.coalesce(F.array_max(runs), F.lit(0)),
        "entropy": F.aggregate(letters, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c))),
        "coverage": coverage(F.col("value"), words) / F.greatest(F.length("value"), F.lit(1)),
        "distinct_share": F.size(letters) / F.greatest(F.length("value"), F.lit(1)),
        "assigned": F.col("assigned"), "known_form": F.col("value").rlike(f"^(?:{KEYS}|{BLOCK})$"),
        "name_before": F.col("before").rlike(NAMES + "|(?i:auth|private|bearer)"),
        "doubt_before": F.concat("before", "value").rlike("(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|sha\\d|md5|integrity|checksum|commit|uuid|guid|https?:"),
        "doubt_path": F.col("path").rlike("(?i)test|example|sample|mock|fixture|vendor|lock$|\\.min\\."),
        "words_around": F.size(F.regexp_extract_all(F.concat_ws(" ", "before", "after"), F.lit("(?<![\\p{L}\\d])\\p{L}{2,}(?![\\p{L}\\d])"), F.lit(0))),
    }
    wide = found.withColumns({f"f_{k}": F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in columns.items()})
    return VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features").transform(wide).drop(*[f"f_{k}" for k in FEATURES])


def labelled_findings(spark: SparkSession, words: list[str] | None = None, n: int = 3000) -> DataFrame:
    """(value, before, after, path, assigned, label): n made findings, the label known by how each was made. ``words``, of
    the corpus, are what long words, identifiers and paths are made of; without them syllables are."""
    hexes = lambda k, m: F.substring(F.concat(F.sha2(F.concat(F.lit(k), F.col("id").cast("string")), 256), F.md5(F.concat(F.lit(k + "'"), F.col("id").cast("string")))), 1, m)
    base = lambda k, m: F.substring(F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit(k), F.col("id").cast("string")), 512))), "\\s", ""), 1, m)
    draw = lambda k, m: F.pmod(F.xxhash64(F.lit(k), F.col("id")), F.lit(m)).cast("int")
    syllables = F.array(*map(F.lit, "an the er in th en on re ion ing ed es or ti ha st nd ea ou wh ly ent ter ver ung ich sch que ment ado ara osa ier eau tion per com pro".split()))
    if words:
        syllables = F.array(*map(F.lit, words[:200]))
    word = lambda k, parts: F.array_join(F.transform(F.sequence(F.lit(1), parts), lambda j: F.get(syllables, F.pmod(F.xxhash64(F.lit(k), F.col("id"), j), F.size(syllables)).cast("int"))), "")
    phrase = lambda k: F.concat_ws(" ", *[word(f"{k}{j}", F.lit(2)) for j in range(3)])
    plain, end = F.concat(phrase("b"), F.lit(" ")), F.concat(F.lit(" "), phrase("a"))
    assigned = lambda name: F.concat(phrase("b"), F.lit(f" {name}"))
    some = lambda k, values: F.element_at(F.array(*map(F.lit, values)), draw(k, len(values)) + 1)
    kinds = [
        (F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), base("pk1", 64), F.lit("\n"), base("pk2", 64), F.lit("\n-----END RSA PRIVATE KEY-----")), plain, False, 1),
        (F.concat(F.lit("AKIA"), F.upper(F.regexp_replace(base("k", 40), "[+/=]", ""))).substr(1, 20), plain, False, 1),
        (F.concat(F.lit("ghp_"), F.regexp_replace(base("g", 60), "[+/=]", "")).substr(1, 40), plain, False, 1),
        (hexes("t", 40), assigned('token = "'), True, 1),
        (F.substring(hexes("p", 40), F.lit(1), F.lit(12) + draw("p", 20)), assigned("password="), True, 1),
        (base("s", 40), assigned("secret: "), True, 1),
        (F.substring(base("w", 40), F.lit(1), F.lit(8) + draw("w", 12)), assigned("pwd = "), True, 1),
        (word("long", F.lit(8) + draw("l", 4)), plain, False, 0),
        (F.concat(F.initcap(word("c1", F.lit(3))), F.initcap(word("c2", F.lit(3))), F.initcap(word("c3", F.lit(3)))), plain, False, 0),
        (some("d", ["changeme", "your_password_here", "xxxxxxxxxxxx", "example", "password", "********", "<password>", "your-api-key", "dummy_token", "placeholder_value"]), assigned("password="), True, 0),
        (F.concat_ws("/", F.lit("usr"), word("f1", F.lit(2)), word("f2", F.lit(2)), word("f3", F.lit(3))), plain, False, 0),
        (F.concat_ws("_", word("i1", F.lit(2)), word("i2", F.lit(2)), word("i3", F.lit(2)), word("i4", F.lit(2))), plain, False, 0),
        (hexes("c", 40), F.concat(phrase("b"), some("cc", [" commit ", " sha1 ", " checksum: ", " md5 ", " integrity sha256-"])), False, 0),
        (F.concat(F.lit("20"), F.rpad(F.col("id").cast("string"), 20, "0123456789")), plain, False, 0),
        (F.repeat(some("r", ["=", "-", "_", "ab", "xo", "na", "ha"]), 14), plain, False, 0),
        (word("v", F.lit(4)), assigned("token: "), True, 0),
    ]
    pick = F.col("id") % len(kinds)
    value, before, put, label = (F.lit(None), F.lit(None), F.lit(None), F.lit(None))
    for k, (v, b, a, y) in enumerate(kinds):
        value, before, put, label = F.when(pick == k, v).otherwise(value), F.when(pick == k, b).otherwise(before), F.when(pick == k, a).otherwise(put), F.when(pick == k, y).otherwise(label)
    path = F.when(draw("path", 10) == 0, F.lit("tests/fixtures")).otherwise(F.concat(F.lit("src"), draw("src", 20).cast("string")))
    return spark.range(0, n, 1, 4).select(value.alias("value"), before.alias("before"), end.alias("after"), path.alias("path"), put.alias("assigned"), label.cast("double").alias("label"))


def train(findings: DataFrame, words: list[str], trees: int = 30, depth: int = 8, seed: int = 7) -> RandomForestClassificationModel:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label", featuresCol="features").fit(features(findings, words))


def scan(docs: DataFrame, model: RandomForestClassificationModel, words: list[str], threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, n_times, value_sha256, probability, is_secret, starts) for every candidate of ``docs``: its first
    start, the highest probability of its occurrences, and all their starts. ``words`` is the dictionary of the training."""
    judged = model.transform(features(candidates(docs), words)).withColumn("sure", vector_to_array("probability")[1])
    each = judged.groupBy("row", "doc_id", F.sha2("value", 256).alias("value_sha256")).agg(F.min("start").alias("start"), F.count("*").alias("n_times"), F.max("sure").alias("sure"), F.sort_array(F.collect_list("start")).alias("starts"))
    return each.select("doc_id", "start", "n_times", "value_sha256", F.round("sure", 6).alias("probability"), (F.col("sure") >= threshold).alias("is_secret"), "starts")


def run(docs: DataFrame) -> DataFrame:
    words = dictionary(docs)
    return scan(docs, train(labelled_findings(docs.sparkSession, words), words), words)
