"""Response records from tables, NDJSON lines and JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The record's fields in the wire format.
KNOWN = ("input", "position", "status", "length", "words", "lines", "content-type", "redirectlocation", "scraper", "duration", "resultfile", "url", "host")
WIRE = "input map<string,string>, position string, status string, length string, words string, lines string, `content-type` string, redirectlocation string, duration string, resultfile string, url string, host string"


def event_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table read as responses: (seq, url, host, word, status, length, words, lines, content_type, redirect_location, duration_ms)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    cents = F.floor(F.col("value") * 100)
    code = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 301).when(F.col("event_type") == "purchase", 403).when(F.col("event_type") == "click", 404).otherwise(200)
    kind = F.when(F.col("k") % 4 == 0, "application/json").when(F.col("k") % 4 == 1, "text/plain").when(F.col("k") % 4 == 2, "").otherwise("text/html")
    host, word = F.concat(F.lit("h"), F.col("user_id").cast("string"), F.lit(".example.com")), F.concat(F.lit("k"), F.col("k").cast("string"))
    return e.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("http://"), host, F.lit("/"), word).alias("url"), host.alias("host"), word.alias("word"), code.alias("status"), cents.cast("long").alias("length"),
        (F.floor(F.col("value") * 100 / 11) + 1).cast("long").alias("words"), (F.floor(F.col("value") * 100 / 70) + 1).cast("long").alias("lines"), kind.alias("content_type"),
        F.when(F.col("event_type") == "signup", "/login").otherwise("").alias("redirect_location"), F.col("value").alias("duration_ms"),
    )


def page_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page table read as responses."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    turn = F.col("page_id") % 20
    return p.select(
        F.col("page_id").alias("seq"), "url", F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "([^/?#]*)/?([?#].*)?$", 1).alias("word"),
        F.when(turn < 11, 404).when(turn < 16, 301).when(turn < 18, 403).otherwise(200).alias("status"), F.octet_length("html").cast("long").alias("length"),
        (F.length("html") - F.length(F.replace("html", F.lit(" "), F.lit(""))) + 1).cast("long").alias("words"), (F.length("html") - F.length(F.replace("html", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("lines"),
        F.when(turn.isin(16, 17), "application/json").otherwise("text/html; charset=utf-8").alias("content_type"), F.when((turn >= 11) & (turn < 16), "/en/login").otherwise("").alias("redirect_location"),
        ((F.col("page_id") * 37) % 101 + 1).cast("double").alias("duration_ms"),
    )


def decoded(value, strict: str = "^[A-Za-z0-9+/]*={0,2}$"):
    """Base64 as text, strictly: what isn't base64 stays as it is."""
    fits = value.rlike(strict) & (F.length(value) % 4 == 0)
    return F.when(fits, F.expr("1")).isNotNull(), F.when(fits, F.make_valid_utf8(F.try_to_binary(value, F.lit("base64")).cast("string"))).otherwise(value)


def integer(column, default: int = 0):
    """A whole number from text or number; the default where it isn't one."""
    return F.coalesce(F.expr(f"try_cast({column} as bigint)"), F.lit(default))


def parse_lines(lines: DataFrame, column: str = "value", base64: bool = True) -> DataFrame:
    """One row for each line: its class (ok, malformed, empty), and the record's fields with defaults; never fails on a line."""
    r = F.from_json(F.col(column), WIRE, {"mode": "PERMISSIVE"})
    is_object = F.col(column).rlike(r"^\s*\{") & F.try_parse_json(F.col(column)).isNotNull()
    kind = F.when(F.trim(column) == "", "empty").when(is_object, "ok").otherwise("malformed")
    rows = lines.withColumn("kind", kind).withColumn("r", F.when(F.col("kind") == "ok", r))
    word = F.coalesce(F.try_element_at("r.input", F.lit("FUZZ")), F.lit(""))
    return rows.select(
        *lines.columns, "kind", F.coalesce("r.url", F.lit("")).alias("url"), F.coalesce("r.host", F.lit("")).alias("host"), (decoded(word)[1] if base64 else word).alias("word"),
        *(integer(f"r.{c}").alias(c) for c in ("position", "status", "length", "words", "lines")), F.coalesce("r.content-type", F.lit("")).alias("content_type"), F.coalesce("r.redirectlocation", F.lit("")).alias("redirect_location"),
        F.coalesce(F.expr("try_cast(r.duration as double)") / 1e6, F.lit(0.0)).alias("duration_ms"), F.coalesce("r.resultfile", F.lit("")).alias("result_file"),
        *((F.get_json_object(column, f"$['{c}']").isNotNull() & F.expr(f"try_cast(r.{c} as bigint)").isNull()).alias(f"failed_{c}") for c in ("status", "length")),
        F.when(F.col("kind") == "ok", F.array_sort(F.array_except(F.json_object_keys(column), F.array(*map(F.lit, KNOWN))))).alias("unknown"),
    )


def wire_lines(responses: DataFrame) -> DataFrame:
    """Responses as NDJSON lines (seq, value), inputs in base64; every 97th line is broken, every 101st blank, every 89th has a field that isn't known."""
    record = F.struct(
        F.create_map(F.lit("FFUFHASH"), F.base64(F.lit("abc")), F.lit("FUZZ"), F.base64("word")).alias("input"), F.col("seq").alias("position"), F.when(F.col("seq") % 83 == 0, "none").otherwise(F.col("status").cast("string")).alias("status"),
        "length", "words", "lines", F.col("content_type").alias("content-type"), F.col("redirect_location").alias("redirectlocation"), F.round(F.col("duration_ms") * 1e6).cast("long").alias("duration"), "url", "host", F.when(F.col("seq") % 89 == 0, "x").alias("tls"),
    )
    line = F.when(F.col("seq") % 97 == 0, "{\"url\": ").when(F.col("seq") % 101 == 0, "  ").when(F.col("seq") % 103 == 0, "[1, 2]").otherwise(F.to_json(record))
    return responses.select("seq", line.alias("value"))


def document_rows(spark: SparkSession, path: str) -> DataFrame:
    """Records (text) of whole JSON files: the wrapper's results, a bare array, one object, or lines; a bare scalar gives none."""
    texts = spark.read.text(path, wholetext=True)
    v = F.try_parse_json("value")
    kind = F.schema_of_variant(v)
    wrapped = F.try_variant_get(v, "$.results", "array<variant>")
    items = F.when(kind.startswith("OBJECT") & wrapped.isNotNull(), F.transform(wrapped, lambda x: F.to_json(x))).when(kind.startswith("ARRAY"), F.transform(v.cast("array<variant>"), lambda x: F.to_json(x))).when(kind.startswith("OBJECT"), F.array("value")).when(v.isNull(), F.split("value", "\n")).otherwise(F.array().cast("array<string>"))
    return texts.select(F.posexplode(items).alias("position", "value"))
