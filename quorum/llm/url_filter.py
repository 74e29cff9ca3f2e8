"""URL filter: host-suffix / path-prefix expressions joined on hash prefixes.

A rule is a host and the start of a path.  It fits the host itself and every
subdomain, where the URL's path starts with the rule's path; of the rules that
fit, the longest decides.  Every URL is expanded into the expressions that a
rule of some known shape (number of host labels, length of path) could equal.
Expressions meet rules by an equi-join on the first ``PREFIX_HEX`` hex digits
of their SHA-256; the full digest then confirms the match.

Everything is DataFrame expressions.  The rule table is broadcast only while
its size estimate is small; beyond that the join shuffles expressions.

Defined cases: a null URL or one without ``://`` has empty host and path and
gets the default verdict; so does an empty host.  Repeated rows and repeated
or null page ids are judged row by row.  A rule listed twice with different
verdicts blocks; a rule's path need not begin with ``/``.  A very long URL has no
more expressions than the rules have shapes.  Empty tables give empty results;
other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum.llm.common import ascii_lower
from quorum.operators.joins import bounded_broadcast

PREFIX_HEX = 8  # 32 bits of SHA-256


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows as a DataFrame."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def url_host(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))).otherwise("")


def url_path(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _digest(rules: DataFrame) -> DataFrame:
    """One row per rule: its digest and prefix, shape, verdict.  A ``/`` parts host
    and path in the expression: no URL's host holds one, and a rule whose host does
    fits nothing."""
    host, path = ascii_lower(F.col("host")), F.coalesce("path", F.lit(""))
    return (rules.filter((F.col("host") != "") & ~F.contains("host", F.lit("/")))
            .groupBy(F.concat(host, F.lit("/"), path).alias("expression"), F.concat(host, path).alias("rule"))
            .agg(F.max("verdict").alias("rule_verdict"),  # 'block' > 'allow'
                 F.max(F.size(F.split("host", r"\."))).alias("labels"),
                 F.max(F.length(F.coalesce("path", F.lit("")))).alias("path_chars"))
            .withColumn("rule_digest", F.sha2("expression", 256)).drop("expression")
            .withColumn("hash_prefix", F.substring("rule_digest", 1, PREFIX_HEX)))


def _expressions(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The expressions of a URL that a rule of one of ``shapes`` may equal."""
    if not shapes:
        return F.array().cast("array<string>")
    labels = F.split(host, r"\.")
    known = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(c).alias("c")) for n, c in shapes])
    fits = F.filter(known, lambda s: (s.n <= F.size(labels)) & (s.c <= F.length(path)))
    return F.transform(fits, lambda s: F.concat(
        F.array_join(F.slice(labels, -s.n, s.n), "."), F.lit("/"), F.substr(path, F.lit(1), s.c)))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``."""
    rules = _digest(rules)
    # the distinct (labels, path length) of the rules: bounded by the longest host and path
    shapes = sorted((r.labels, r.path_chars) for r in rules.select("labels", "path_chars").distinct().collect())
    urls = (pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
            .withColumn("row", F.monotonically_increasing_id()))
    expanded = (urls.withColumn("expr", F.explode_outer(
                    F.when(F.col("host") != "", _expressions(F.col("host"), F.col("path"), shapes))))
                .withColumn("digest", F.sha2("expr", 256))
                .withColumn("hash_prefix", F.substring("digest", 1, PREFIX_HEX)))
    hits = expanded.join(bounded_broadcast(rules), "hash_prefix", "left")
    confirmed = F.when(F.col("digest") == F.col("rule_digest"), F.struct(
        F.length("rule").alias("chars"), F.col("labels"), F.col("rule"), F.col("rule_verdict").alias("verdict")))
    return (hits.groupBy("row")
            .agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"),
                 F.max(confirmed).alias("best"))
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
