"""HTTP requests and evaluation files as rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.features import is_valid
from ..schema import EVALUATION, MAX_BODY, REQUEST


def parse_http(raw: Column) -> dict[str, Column]:
    """Method, path, content_length, keep_alive and body of a request; content_length is null if the header is absent."""
    head = F.substring_index(raw, "\r\n\r\n", 1)
    return {
        "method": F.regexp_extract(head, "^([A-Z]+) ", 1),
        "path": F.regexp_extract(head, "^[A-Z]+ ([^ ?]*)", 1),
        "content_length": F.regexp_extract(head, "(?im)^Content-Length:[ \\t]*(\\d+)", 1).try_cast("long"),
        "keep_alive": ~head.rlike("(?im)^Connection:[ \\t]*close"),
        "body": F.when(F.instr(raw, "\r\n\r\n") > 0, F.substr(raw, F.instr(raw, "\r\n\r\n") + 4)).otherwise(F.lit("")),
    }


def parse_body(body: Column) -> Column:
    return F.from_json(body, REQUEST)


def status(method: Column, path: Column, size: Column, parsed_ok: Column) -> Column:
    """413 beyond MAX_BODY bytes, 200 for GET /ready and a valid POST /fraud-score, 400 for an invalid one, else 404."""
    return (
        F.when(size > MAX_BODY, 413)
        .when((method == "GET") & (path == "/ready"), 200)
        .when((method == "POST") & (path == "/fraud-score"), F.when(parsed_ok, 200).otherwise(400))
        .otherwise(404)
    )


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use refers to it, also in a filter that Spark pushes below the columns it is made of."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def route(requests: DataFrame, raw: str = "raw") -> DataFrame:
    """Each request with its parts, the parsed body and a status."""

    def routed(text: Column) -> Column:
        parts = parse_http(text)
        told = F.struct(*(c.alias(name) for name, c in parts.items()), parse_body(parts["body"]).alias("request"))
        names = [*parts, "request"]
        return once(told, lambda p: F.struct(*(p[c].alias(c) for c in names), status(p["method"], p["path"], F.octet_length(text), is_valid(p["request"])).alias("status")))

    return requests.withColumn("__routed", once(F.col(raw), routed)).select(*requests.columns, "__routed.*")


def route_all(requests: DataFrame, raw: str = "raw") -> DataFrame:
    """The columns of route() by plain expressions, for a reader of every request: a filter on them would parse requests twice, but what once() holds is not compiled, and takes twice as long."""
    parts = parse_http(F.col(raw))
    told = requests.select(*requests.columns, *(c.alias(name) for name, c in parts.items())).withColumn("request", parse_body(F.col("body")))
    return told.withColumn("status", status(F.col("method"), F.col("path"), F.octet_length(raw), is_valid(F.col("request"))))


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """(file, entry, entry_id, request, expected_approved) of evaluation files: one object each, over any lines, or one object a line.

    file and entry tell an entry's file and its place there, over all the file's objects; entry_id,
    a hash of both, joins answers to it. A file that holds more than JSON can be read as, an object
    without entries included, fails.
    """
    # a line each is an object, or a file is one, which alone is read as a whole
    def texts(start: Column, line: Column, **options) -> DataFrame:
        read = spark.read.text(path, **options)
        return read.select(F.col("_metadata.file_path").alias("file"), F.struct(start.alias("start"), line.alias("line")).alias("object"), F.trim(F.regexp_replace("value", "\\r$", "")).alias("text")).where("text != ''")

    lines = texts(F.col("_metadata.file_block_start"), F.monotonically_increasing_id(), lineSep="\n")
    whole = [r["file"] for r in lines.where(F.get_json_object("text", "$.entries").isNull()).select("file").distinct().collect()]
    if whole:
        zero = F.lit(0).cast("long")
        lines = lines.where(~F.col("file").isin(whole)).union(texts(zero, zero, wholetext=True).where(F.col("file").isin(whole)))
    parsed = lines.select("file", "object", F.from_json("text", EVALUATION, {"mode": "FAILFAST"}).alias("o"))
    checked = parsed.select("file", "object", F.when(F.col("o.entries").isNotNull(), F.col("o.entries")).otherwise(F.raise_error(F.lit("an evaluation object needs entries"))).alias("entries"))
    before = F.coalesce(F.sum(F.size("entries")).over(Window.partitionBy("file").orderBy("object").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = checked.withColumn("before", before).select("file", "before", F.posexplode("entries").alias("at", "e"))
    place = (F.col("before") + F.col("at")).cast("long")
    return numbered.select("file", place.alias("entry"), F.xxhash64("file", place).alias("entry_id"), "e.request", "e.expected_approved")
