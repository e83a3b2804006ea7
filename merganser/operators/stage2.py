"""What to fetch again and what pages look like: candidates, scope rules, body features, program scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from merganser.functions.expressions import netloc, refusal


def candidates(ranked: DataFrame, most: int = 25) -> DataFrame:
    """(url, place): addresses in order of their first place in the ranking, up to `most`."""
    return ranked.filter("url <> ''").groupBy("url").agg(F.min("place").alias("place")).orderBy("place").limit(most)


def checked(patterns: DataFrame, column: str = "pattern") -> DataFrame:
    """Adds `reason`: why a scope pattern is refused, or the empty text."""
    return patterns.withColumn("p", F.lower(F.trim(column))).withColumn("reason", F.expr(refusal())).drop("p")


def decided(urls: DataFrame, scope: DataFrame) -> DataFrame:
    """Adds `allowed` and `pattern` (the first that matches): http and https only; `*.d` covers subdomains alone; a pattern with a port only that port.

    `scope` is (pattern, place), a file an operator writes; it is joined by the host, by host and port, and by each parent domain, so no pair is compared in vain.
    """
    address = F.lower(F.expr(netloc("url")))
    bare = F.regexp_replace(address, ":[0-9]+$", "")
    labels = F.split(bare, "[.]")
    parents = F.transform(F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))), lambda i: F.concat(F.lit("*."), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    names = F.when(F.col("url").rlike("^(?i)https?://") & (bare != ""), F.array_distinct(F.concat(F.array(address, bare), F.when(F.size(labels) > 1, parents).otherwise(F.array().cast("array<string>")))))
    hits = urls.select("url", F.explode(names).alias("pattern")).distinct().join(scope, "pattern").groupBy("url").agg(F.min_by("pattern", "place").alias("pattern"))
    return urls.join(hits, "url", "left").withColumn("allowed", F.col("pattern").isNotNull()).withColumn("pattern", F.coalesce("pattern", F.lit("")))


def rate_schedule(ranked: DataFrame, rate: float = 5.0) -> DataFrame:
    """Adds `start`, in seconds: evenly spaced, no bursts, at most 5 a second."""
    if rate <= 0:
        raise ValueError("the rate must be positive")
    return ranked.withColumn("start", F.round((F.row_number().over(Window.orderBy("place")) - 1) / min(rate, 5.0), 6))


#: A tag begins with a letter, a slash or an exclamation mark.
TAG = "<[a-zA-Z/!][^>]*>"


def body_features(pages: DataFrame, body: str = "html") -> DataFrame:
    """Structure of a body, in bytes: length, tags, shares of tags and of text (white space collapsed), lines, longest line, title, and whether it is binary (a NUL in the first KiB)."""
    b = F.coalesce(F.col(body), F.lit(""))
    tags = F.regexp_extract_all(b, F.lit(TAG), F.lit(0))
    names = F.transform(tags, lambda t: F.regexp_replace(F.lower(F.regexp_extract(t, "^([^ \t\r\n\f\x0B]*)", 1)), ">+$", ""))
    markup = F.aggregate(tags, F.lit(0), lambda a, t: a + F.octet_length(t))
    blank = "[ \t\r\n\f\x0B]+"
    text = F.trim(F.regexp_replace(F.regexp_replace(b, TAG, " "), blank, " "))
    lines = F.split(b, "\n")
    size = F.octet_length(b)
    share = lambda part: F.round(F.when(size > 0, part / size).otherwise(0.0), 6)
    return pages.select(
        *(c for c in pages.columns if c != body), size.alias("length"), F.size(tags).alias("tag_count"), F.size(F.array_distinct(names)).alias("tag_distinct"),
        share(markup).alias("tag_ratio"), share(F.octet_length(text)).alias("text_ratio"),
        F.when(size > 0, F.size(lines)).otherwise(0).alias("line_count"), F.aggregate(lines, F.lit(0), lambda a, x: F.greatest(a, F.octet_length(x))).alias("max_line_length"),
        F.left(F.trim(F.regexp_replace(F.regexp_extract(b, "(?is)<title[^>]*>(.*?)</title>", 1), f"^{blank}|{blank}$", "")), F.lit(120)).alias("title"),
        F.contains(F.left(b, F.lit(1024)), F.lit("\0")).alias("is_binary"),
    )


def scraper_features(rows: DataFrame, scraper: str = "scraper") -> DataFrame:
    """Features of records that weren't fetched again: only the names of what scrapers found, in order."""
    return rows.withColumn("scraper_keys", F.array_sort(F.coalesce(F.map_keys(scraper), F.array().cast("array<string>"))))


def declared_length(fetched: DataFrame, column: str = "headers") -> DataFrame:
    """Adds `declared`: the length that a header states, whatever the case of its name; null if there is none or it isn't a whole number."""
    of = F.get(F.filter(F.map_entries(column), lambda e: F.lower(e["key"]) == "content-length"), F.lit(0))["value"]
    return fetched.withColumn("declared", of.try_cast("bigint"))


def byte_entropy(pages: DataFrame, id_col: str, body: str = "html", most: int = 65536) -> DataFrame:
    """(id, entropy) in bits of the first bytes: a row for each byte value that occurs, summed on the way."""
    raw = F.hex(F.substring(F.encode(F.coalesce(F.col(body), F.lit("")), "UTF-8"), 1, most))
    each = pages.select(id_col, F.explode(F.regexp_extract_all(raw, F.lit("(..)"), F.lit(1))).alias("b")).groupBy(id_col, "b").agg(F.count("*").alias("c"))
    total = each.groupBy(id_col).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return total.select(id_col, F.round(F.log2("n") - F.col("s") / F.col("n"), 5).alias("entropy"))


def shared_titles(features: DataFrame) -> DataFrame:
    return features.filter("title <> ''").groupBy("title").agg(F.count("*").alias("n")).filter("n > 1")


def converted(assets: DataFrame) -> DataFrame:
    """Program assets (place, identifier, asset_type, eligible) with `outcome`: pattern, blank, ineligible, non-web, or why the pattern is refused."""
    rows = checked(assets, "identifier")
    web = F.col("asset_type").isin("URL", "WILDCARD", "OTHER", "API", "IP_ADDRESS")
    return rows.withColumn("outcome", F.when(F.trim("identifier") == "", "blank").when(~F.lower("eligible").isin("true", "yes", "1"), "ineligible").when(~web, "non-web").when(F.col("reason") != "", F.col("reason")).otherwise("pattern")).drop("reason")


def uncovered_apexes(patterns: DataFrame) -> DataFrame:
    """Domains `x` of patterns `*.x` that no pattern covers."""
    apexes = patterns.filter("left(pattern, 2) = '*.'").select(F.expr("substring(pattern, 3)").alias("pattern")).distinct()
    return apexes.join(patterns, "pattern", "left_anti").withColumnRenamed("pattern", "apex")
