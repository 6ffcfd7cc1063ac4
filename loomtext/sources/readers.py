"""Sources: text lines, tolerant JSON lines, archives, benchmark files, and the extractors of five corpora."""

from __future__ import annotations

import gzip
import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions.text import rstrip_ws, strip_ws

RECORDS = {"news": "title string, desc string, content string", "baike": "title string, summary string, text string", "qa": "qid string, title string, content string, star int", "wiki": "text string"}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """E11. Text lines (universal newlines) with the file they are from."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("file"))


def granular(docs: DataFrame, granularity: str = "document") -> DataFrame:
    """Rows as they are, or a row per line: line_no counts inside the document."""
    if granularity == "document":
        return docs
    return docs.select("*", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("line_no", "line")).drop("text").withColumnRenamed("line", "text")


def json_lines(rows: DataFrame, schema: str, column: str = "line") -> DataFrame:
    """E7, E12. Lines of JSON objects as struct ``record``; ``valid`` is false for lines that hold none, blank ones go."""
    read = F.from_json(F.col(column), schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    full = rows.where(strip_ws(F.col(column)) != "").withColumn("record", read)
    whole = strip_ws(F.col(column)).rlike("(?s)^\\{.*\\}$") & F.col("record._bad").isNull()
    return full.withColumn("valid", whole)


def json_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """E7, E8. A JSON array, an object whose ``root`` or longest list holds the records, or JSON lines: told apart by the
    first characters of the file."""
    head = spark.read.text(path).limit(1).first()
    first = (head[0] if head else "").lstrip()
    if first.startswith("[") or (first.startswith("{") and '"qid"' not in first[:1024] and not _is_object(spark, first)):
        whole = spark.read.text(path, wholetext=True)
        if first.startswith("["):
            return whole.select(F.inline(F.from_json("value", f"array<struct<{_struct(schema)}>>")))
        lists = F.map_values(F.from_json("value", f"map<string,array<struct<{_struct(schema)}>>>"))
        longest = F.array_sort(lists, lambda a, b: F.size(b) - F.size(a))[0]
        root = F.from_json("value", f"map<string,array<struct<{_struct(schema)}>>>")["root"]
        return whole.select(F.inline(F.coalesce(root, longest)))
    return json_lines(lines(spark, path), schema).where("valid").select("record.*").drop("_bad")


def _is_object(spark: SparkSession, line: str) -> bool:
    """Whether a first line is a whole JSON object, so that the file is JSON lines."""
    import json

    try:
        value = json.loads(line)
    except ValueError:
        return False
    return not any(isinstance(x, list) for x in value.values()) if isinstance(value, dict) else False


def _struct(schema: str) -> str:
    return ",".join(":".join(f.strip().split(" ")) for f in schema.split(","))


def archive_lines(spark: SparkSession, path: str) -> DataFrame:
    """E6. Lines of .gz, .zip and plain files. Of a .zip the .json member with "train" in its name, else the largest."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                for part in _lines(name, raw):
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.string())], ["line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(over, "line string")


def _lines(name: str, raw: bytes, n: int = 10_000) -> Iterator[list[str]]:
    if name.endswith(".zip"):
        z = zipfile.ZipFile(io.BytesIO(raw))
        fit = [i for i in z.infolist() if i.filename.endswith(".json") and "train" in i.filename]
        stream = z.open(fit[0] if fit else max(z.infolist(), key=lambda i: i.file_size))
    else:
        stream = gzip.open(io.BytesIO(raw)) if name.endswith(".gz") else io.BytesIO(raw)
    held: list[str] = []
    for line in io.TextIOWrapper(stream, "utf-8", errors="replace"):
        held.append(line.rstrip("\r\n"))
        if len(held) == n:
            yield held
            held = []
    if held:
        yield held


def benchmark_items(spark: SparkSession, folder: str) -> DataFrame:
    """E13. Items of ``ceval.json`` if the folder has it, else of all its JSON array files; then the file's stem is the
    subject of items without one."""
    schema = "question string, A string, B string, C string, D string, answer string, subject string"
    one = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/ceval.json")
    if one.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(one):
        return spark.read.schema(schema).json(str(one), multiLine=True)
    stem = F.regexp_extract(F.input_file_name(), "([^/]*)\\.json$", 1)
    rows = spark.read.schema(schema).option("pathGlobFilter", "*.json").json(folder, multiLine=True)
    return rows.withColumn("subject", F.coalesce("subject", stem))


def topics(rows: DataFrame) -> DataFrame:
    """E14. Lines without their outer white space, blank ones left out, and the other columns."""
    return rows.select(*[c for c in rows.columns if c != "line"], strip_ws(F.col("line")).alias("topic")).where("topic <> ''")


def first_stage(spark: SparkSession, folder: str, name: str) -> str | None:
    """E15. The first of a source's _dedup, _trunc and _clean outputs that has data."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for stage in ("_dedup", "_trunc", "_clean"):
        for end in (".txt", ".parquet", ""):
            p = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}{stage}{end}")
            fs = p.getFileSystem(conf)
            if fs.exists(p) and fs.getContentSummary(p).getLength() > 0:
                return str(p)
    return None


def _joined(*parts: Column) -> Column:
    bare = F.filter(F.array(*[strip_ws(F.coalesce(p, F.lit(""))) for p in parts]), lambda x: x != "")
    return F.array_join(bare, "。")


def extract_news(rows: DataFrame) -> DataFrame:
    """E1. title, desc, content of struct ``record``, joined; more than 30 characters."""
    return rows.withColumn("text", _joined(*(F.col(f"record.{c}") for c in ("title", "desc", "content")))).where(F.length("text") > 30)


def extract_baike(rows: DataFrame) -> DataFrame:
    """E2. title, summary, text; doubled full stops become one; more than 20 characters."""
    text = F.replace(_joined(*(F.col(f"record.{c}") for c in ("title", "summary", "text"))), F.lit("。。"), F.lit("。"))
    return rows.withColumn("text", text).where(F.length("text") > 20)


def extract_qa(rows: DataFrame) -> DataFrame:
    """E3. Questions with answers; short answers without a star go."""
    title, content = (F.coalesce(F.col(f"record.{c}"), F.lit("")) for c in ("title", "content"))
    poor = (F.coalesce(F.col("record.star"), F.lit(1)) == 0) & (F.length(content) < 20)
    return rows.where(~poor & (F.length(title) > 3) & (F.length(content) > 10)).withColumn("text", F.concat(F.lit("问题："), title, F.lit(" 回答："), content))


def extract_wiki(rows: DataFrame) -> DataFrame:
    """E4. text without white space at its end; more than 30 characters."""
    return rows.withColumn("text", rstrip_ws(F.coalesce(F.col("record.text"), F.lit("")))).where(F.length("text") > 30)


def extract_edu(rows: DataFrame) -> DataFrame:
    """E5. The text column of Parquet files, non-empty, without white space at its end."""
    return rows.where("text is not null and text <> ''").withColumn("text", rstrip_ws(F.col("text")))


#: E10.
EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {"news": extract_news, "baike": extract_baike, "qa": extract_qa, "wiki": extract_wiki, "edu": extract_edu}
