"""Files, JSON lines, tool output and documents of findings as DataFrames."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.text import basename, normal_path

#: Endings of C and C++ sources and headers.
SOURCE_ENDINGS = ("c", "cc", "cpp", "cxx", "c++", "h", "hh", "hpp", "hxx", "inl", "ipp", "tpp", "tcc")
FINDING = "file string, start_line int, end_line int, score double, issue string, cwe string, severity string, rule string, tool string, match_lines array<int>, is_vulnerable boolean"


@F.pandas_udf(T.StringType())
def decode_dropping(content: pd.Series) -> pd.Series:
    """UTF-8 without the bytes that do not decode."""
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def _is_file(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(hadoop) and files.getFileStatus(hadoop).isFile()


def list_sources(spark: SparkSession, path: str, endings: tuple[str, ...] = SOURCE_ENDINGS, exclude: str | None = None) -> DataFrame:
    """(path, text) of a tree's source files by ending, in any case, sorted by path; a single file is taken whatever its ending. What is not
    wanted is not read: endings are tested when the tree is listed, and the glob to ``exclude``, on the relative path, against a listing without
    contents, whose names the driver holds as it holds any listing."""
    if _is_file(spark, path):
        return spark.read.format("binaryFile").load(path).select("path", decode_dropping("content").alias("text"))
    any_case = lambda e: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(map(any_case, endings)) + "}")
    files = reader.load(path)
    if exclude:
        relative = F.regexp_replace("path", "^.*?" + re.escape(path.split(":", 1)[-1].rstrip("/")) + "/", "")
        names = [r.path for r in files.select("path").where(~relative.rlike(glob_pattern(exclude))).toLocalIterator()]
        if not names:
            return files.limit(0).select("path", F.lit("").alias("text"))
        files = spark.read.format("binaryFile").load(names)
    return files.select("path", decode_dropping("content").alias("text")).orderBy("path")


def glob_pattern(glob: str) -> str:
    """A pattern for a file glob whose * also crosses /."""
    special = {"*": ".*", "?": "."}
    return "(?s)^" + "".join(special.get(c) or ("\\" + c if c in r".+()|^$\{}" else c) for c in glob) + "$"


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Rows of JSON lines. Blank and malformed lines are skipped, or a malformed one fails the read if ``strict``."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def read_shards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON-lines shards with the file's name, the split that it declares, and seq, by which rows stand in the order of files and of lines in them."""
    from sievework.operators.dataset import split_of_file

    place = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    rows = spark.read.schema(schema).json(path, mode="DROPMALFORMED").select("*", F.col("_metadata.file_name").alias("file"), place.alias("seq"))
    return rows.withColumn("split", split_of_file(F.col("file")))


def read_kb(spark: SparkSession, path: str) -> DataFrame:
    """(id, triggers, note) of a knowledge base, a JSON document with `entries`; no rows where it is missing or malformed."""
    from pyspark.errors import AnalysisException

    kind = "array<struct<id:string, triggers:array<string>, note:string>>"
    try:
        doc = spark.read.schema(f"entries {kind}").json(path, multiLine=True)
    except AnalysisException:  # no such file
        doc = spark.createDataFrame([], f"entries {kind}")
    return doc.select(F.inline(F.coalesce("entries", F.array().cast(kind))))


def match_kb(texts: DataFrame, kb: DataFrame, text: str = "text", most: int = 10_000) -> DataFrame:
    """``texts`` with ids: the sorted ids of the entries any of whose triggers stands in the text, case aside. A curated base is small: its triggers become
    constants of one expression; over ``most`` triggers it is refused."""
    rows = kb.select("id", F.explode("triggers").alias("t")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} triggers")
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = [F.when(low.contains(F.lit(r.t.lower())), F.lit(r.id)) for r in rows if r.t is not None]
    ids = F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")
    return texts.withColumn("ids", F.array_sort(F.array_distinct(ids)))


def read_settings(spark: SparkSession, path: str, defaults: dict[str, float | int | str]) -> dict[str, float | int | str]:
    """The settings of a JSON document, by the names of ``defaults``; what is missing, null or of another kind, and all where there is no readable
    document, stays at its default."""
    from pyspark.errors import PySparkException

    names = {str: "string", int: "bigint", float: "double", bool: "boolean"}
    schema = ", ".join(f"`{k}` {names[type(v)]}" for k, v in defaults.items())
    try:
        row = spark.read.schema(schema).json(path, multiLine=True).first()
    except PySparkException:
        row = None
    return {k: v if row is None or row[k] is None else row[k] for k, v in defaults.items()}


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings of documents that hold them under `explanations` or else `findings`; an empty list counts as none."""
    doc = spark.read.schema(f"explanations array<struct<{_fields()}>>, findings array<struct<{_fields()}>>").json(path, multiLine=True)
    chosen = F.when(F.size(F.coalesce("explanations", F.array())) > 0, F.col("explanations")).otherwise(F.col("findings"))
    return doc.select(F.inline(chosen))


def _fields() -> str:
    return ", ".join(f.replace(" ", ":", 1) for f in FINDING.split(", "))


def parse_tab_output(lines: DataFrame, tool: str) -> DataFrame:
    """Findings of tab-separated lines file, line, severity, rule, message; other lines are noise."""
    p = F.split("line", "\t")
    rows = lines.select(p.alias("p")).where((F.size("p") == 5) & F.col("p")[1].try_cast("int").isNotNull())
    return rows.select(F.lit(tool).alias("tool"), F.col("p")[0].alias("file"), F.col("p")[1].cast("int").alias("start_line"), F.col("p")[1].cast("int").alias("end_line"), F.col("p")[3].alias("rule"), F.lower(F.col("p")[2]).alias("severity"), F.col("p")[4].alias("issue"))


def read_csv_findings(spark: SparkSession, path: str, tool: str) -> DataFrame:
    """Findings of a CSV report with the columns File, Line, Level, Name and Warning; level 4 and up is high, 2 and up medium."""
    rows = spark.read.csv(path, header=True)
    level = F.coalesce(F.col("Level").try_cast("int"), F.lit(0))
    line = F.coalesce(F.col("Line").try_cast("int"), F.lit(0))
    return rows.select(F.lit(tool).alias("tool"), F.col("File").alias("file"), line.alias("start_line"), line.alias("end_line"), F.col("Name").alias("rule"), F.when(level >= 4, "high").when(level >= 2, "medium").otherwise("low").alias("severity"), F.col("Warning").alias("issue"))


LOG_LINE = r"^(.+?):([0-9]+):([0-9]+): (warning|error): (.*?)(?: \[([^\]]+)\])?$"


def parse_log_lines(lines: DataFrame, tool: str) -> DataFrame:
    """Findings of `file:line:column: severity: message [check]` lines; an error is high, a warning medium."""
    g = lambda i: F.regexp_extract("line", LOG_LINE, i)
    rows = lines.where(F.col("line").rlike(LOG_LINE))
    return rows.select(F.lit(tool).alias("tool"), g(1).alias("file"), g(2).cast("int").alias("start_line"), g(2).cast("int").alias("end_line"), F.coalesce(F.nullif(g(6), F.lit("")), F.lit(tool)).alias("rule"), F.when(g(4) == "error", "high").otherwise("medium").alias("severity"), g(5).alias("issue"))


def by_language(files: DataFrame) -> DataFrame:
    from sievework.functions.text import language_of_path

    return files.groupBy(language_of_path(F.col("path")).alias("lang")).agg(F.array_sort(F.collect_list("path")).alias("paths"))


def resolve_sources(asked: DataFrame, sources: DataFrame) -> DataFrame:
    """``asked`` (file) with the path of the source it names: exactly, after normalising, or by base name, in this order."""
    sources = sources.select("path", F.explode(F.array(F.struct(F.lit(0).alias("prio"), F.col("path").alias("alias")), F.struct(F.lit(1).alias("prio"), normal_path(F.col("path")).alias("alias")), F.struct(F.lit(2).alias("prio"), basename(F.col("path")).alias("alias")))).alias("s")).select("path", "s.*")
    names = asked.select("file", F.explode(F.array(F.struct(F.lit(0).alias("prio"), F.col("file").alias("alias")), F.struct(F.lit(1).alias("prio"), normal_path(F.col("file")).alias("alias")), F.struct(F.lit(2).alias("prio"), basename(F.col("file")).alias("alias")))).alias("s")).select("file", "s.*")
    best = names.join(sources, ["prio", "alias"]).groupBy("file").agg(F.min_by("path", F.struct("prio", "path")).alias("path"))
    return asked.join(best, "file", "left")


def manifest(spark: SparkSession, path: str, exclude: str = "checkpoint-") -> DataFrame:
    """(path, sha256, bytes) of the files of a tree without checkpoints."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(~F.col("path").contains(exclude)).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes")).orderBy("path")


def file_provenance(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, rows) of JSON-lines files: a last line without a line break counts; an empty file has no row."""
    files = spark.read.format("binaryFile").load(path)
    text = F.decode("content", "ISO-8859-1")
    ends = F.octet_length("content") > 0
    rows = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return files.select("path", F.sha2("content", 256).alias("sha256"), (rows + F.when(ends & ~text.endswith("\n"), 1).otherwise(0)).cast("long").alias("rows"))


def verify_manifest(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(path, status): missing, extra, changed or ok."""
    a, b = listed.select("path", F.col("sha256").alias("a")), found.select("path", F.col("sha256").alias("b"))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "changed").otherwise("ok")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def unsafe_entries(entries: DataFrame, path: str = "path", link: Column | None = None) -> DataFrame:
    """Archive entries that must not be unpacked: absolute, with a .. component, or links."""
    bad = F.col(path).rlike(r"^(?:/|[A-Za-z]:|\\)") | F.col(path).rlike(r"(?:^|[/\\])\.\.(?:[/\\]|$)")
    return entries.where(bad | link if link is not None else bad)


def merge_documents(docs: DataFrame, most: int = 200_000) -> DataFrame:
    """One document of several (ord, meta, findings): all findings in order, and the first readable document's metadata. A document is one row, so over
    ``most`` findings it is refused; as a table, findings of any number are a union."""
    rows = docs.select("ord", F.posexplode("findings").alias("place", "finding")).orderBy("ord", "place").limit(most + 1)
    listed = rows.agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "place", "finding"))), lambda x: x["finding"]).alias("findings"))
    listed = listed.select(F.when(F.col("n") > most, F.raise_error(F.lit(f"more than {most} findings in one document")).cast(docs.schema["findings"].dataType)).otherwise(F.col("findings")).alias("findings"))
    meta = docs.agg(F.min_by("meta", F.when(F.col("meta").isNotNull(), F.col("ord"))).alias("meta"))
    return meta.crossJoin(listed)  # one row by one row
