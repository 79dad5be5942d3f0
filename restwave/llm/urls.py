"""URL filters as a sort-merge range join, made of DataFrame functions.

A host's canonical key is its labels in reverse order, each ended by \\x01, so a rule's host and all its
subdomains are one interval of keys, and intervals are nested or apart. The rules become boundary rows: at the
start of a host's interval the stack of rules of that host and the hosts above it, at its end the stack without
it. Boundaries and URLs are sorted together by key, and a running window carries the stack to the URLs; of its
rules the longest that fits is chosen.

URLs are dealt evenly, whatever their hosts, to `slices`; each gets all boundaries, two rows for each host of
a rule. A host may own any share of the URLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from restwave.llm.common import row_struct, with_outputs

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OUTPUTS = ["host", "path", "rule", "verdict"]


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), "^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + F.lit(3), F.length(url)))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\x01"), F.lit("\x01"))


def boundaries(rules: DataFrame) -> DataFrame:
    """key, stack: the rules in force from the key on. rules: host, path, verdict."""
    clean = rules.where("host is not null and path is not null").select(
        F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    by_host = clean.groupBy("host").agg(F.collect_list(F.struct("host", "path", "verdict")).alias("own"))
    labels = F.split("host", r"\.")
    above = by_host.select("host", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("above"))
    held = above.join(by_host.select(F.col("host").alias("above"), "own"), "above")
    stacks = held.groupBy("host").agg(
        F.flatten(F.collect_list("own")).alias("inside"),
        F.flatten(F.collect_list(F.when(F.col("above") != F.col("host"), F.col("own")))).alias("outside"))
    end = F.concat(F.regexp_replace(host_key(F.col("host")), "\x01$", ""), F.lit("\x02"))
    return stacks.select(host_key(F.col("host")).alias("key"), F.col("inside").alias("stack")).unionByName(
        stacks.select(end.alias("key"), F.col("outside").alias("stack")))


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", keep: list[str] | None = None,
                default: str = "allow", slices: int | None = None) -> DataFrame:
    """The columns `keep` of pages (all, if None) and host, path, rule (host + path, or null), verdict.

    A rule fits its host and all subdomains if the URL's path starts with the rule's. Of fitting rules the one
    with the longest host + path wins, then the longer host; of rules with one host and path "block" wins over
    "allow". Without a fitting rule: `default`. A null URL or one without "://" has an empty host and path and
    meets no rule, unless a rule has an empty host. Rules with a null host or path count for nothing. Empty
    tables are fine. Input columns named like an output give way to it.
    """
    spark = pages.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    url = F.col(url_col).cast("string")
    own = row_struct(pages, keep)
    rows = pages.select(own.alias("row"), url_host(url).alias("host"), url_path(url).alias("path"),
                        F.pmod(F.monotonically_increasing_id(), F.lit(slices)).alias("slice"))
    marks = boundaries(rules).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<long>")))
    swept = (rows.withColumn("key", host_key(F.col("host"))).withColumn("is_url", F.lit(1))
             .unionByName(marks.withColumn("is_url", F.lit(0)), allowMissingColumns=True))
    sweep = Window.partitionBy("slice").orderBy("key", "is_url").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stacked = swept.withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("is_url = 1")
    fits = F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"])
                    & ((F.col("host") == r["host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["host"]))))
    best = F.array_max(F.transform(fits, lambda r: F.struct(
        (F.length(r["host"]) + F.length(r["path"])).alias("n"), F.length(r["host"]).alias("h"), F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict"))))
    judged = stacked.select("row", "host", "path", best.alias("best")).select(
        "row", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    return with_outputs(judged, "row", OUTPUTS)
