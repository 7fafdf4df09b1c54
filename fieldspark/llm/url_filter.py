"""URL filters by hashed host-suffix and path-prefix expressions.

A rule is a host and a path. It fits a URL whose host is the rule's or a subdomain of it and whose path begins with the
rule's. Each distinct (host, path) is expanded into the expressions that a rule could be: its last n labels with the first
m characters of its path, for the shapes (n, m) that occur among the rules. Expressions and rules meet by an equi-join on
the first 32 bits of their SHA-256; full digests then confirm. The longest rule decides.

Copies of a URL are one row until the verdicts are joined back, so a host or page with a third of all rows costs no more
than another. The rules are broadcast only while their number, which is counted, is at most ``BROADCAST_RULES``;
beyond it they are shuffled, with the expressions spread over ``SALTS`` parts, as one expression may be in most URLs.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
BROADCAST_RULES = 100_000
#: Distinct shapes of rules up to which every URL is expanded by all of them at once.
MOST_SHAPES = 4096
SALTS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host: after the first :// up to /, ?, # or the end, A-Z lower-cased; the path: from there up to ?, # or the
    end. Both are empty for a null URL or one without ://."""
    found = F.instr(url, "://")
    rest = F.when(found > 0, F.substring(url, found + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rules_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """rule_host, rule_path, verdict from (verdict, host, path) triples; a path begins with a slash or is empty."""
    rows = [(host, path, verdict) for verdict, host, path in rules]
    for host, path, verdict in rows:
        if not host or host != host.translate(str.maketrans(_UPPER, _LOWER)) or verdict not in (ALLOW, BLOCK):
            raise ValueError(f"not a rule: {verdict} {host}{path}")
    return spark.createDataFrame(rows, "rule_host string, rule_path string, verdict string")


def _digest(expression: Column) -> tuple[Column, Column]:
    whole = F.sha2(expression, 256)
    return whole, F.conv(F.substring(whole, 1, 8), 16, 10).cast("long")


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``.

    ``rules`` has rule_host, rule_path and verdict, as rules_table makes it; of rules with the same host and path a
    block counts. The longest of the rules that fit decides, the one with the longer host of two of one length (they
    then differ in host: both fit one URL); rule is its host and path, null where none fits, and the verdict is then
    ``default``. Rows may repeat, ids and URLs may be null; other columns of ``pages`` are not read.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))

    joined = F.concat("rule_host", F.lit("\0"), "rule_path")
    digest, short = _digest(joined)
    known = rules.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))  # "block" is the later word
    known = known.select(
        digest.alias("rule_digest"), short.alias("short"), "verdict", F.concat("rule_host", "rule_path").alias("rule"),
        F.length("rule_host").alias("host_length"), _labels(F.col("rule_host")).alias("labels"), F.length("rule_path").alias("chars"),
    )
    shapes = known.groupBy("labels", "chars").count().limit(MOST_SHAPES + 1).collect()
    if len(shapes) > MOST_SHAPES:
        raise ValueError(f"the rules have over {MOST_SHAPES} combinations of host labels and path lengths")
    n_rules = sum(r["count"] for r in shapes)

    urls = rows.where("host <> ''").select("host", "path").distinct()
    parts = F.split(F.col("host"), r"\.")
    labels = _labels(F.col("host"))
    offered = F.array(*[F.struct(F.lit(r.labels).alias("labels"), F.lit(r.chars).alias("chars")) for r in shapes]) if shapes else F.array().cast("array<struct<labels:int,chars:int>>")
    fitting = F.filter(offered, lambda s: (s.labels <= labels) & (s.chars <= F.length("path")))
    spread = urls.select("host", "path", F.explode(fitting).alias("shape"))
    suffix = F.array_join(F.slice(parts, -F.col("shape.labels"), F.col("shape.labels")), ".")
    digest, short = _digest(F.concat(suffix, F.lit("\0"), F.substring(F.col("path"), F.lit(1), F.col("shape.chars"))))
    expressions = spread.select("host", "path", digest.alias("digest"), short.alias("short"))
    if n_rules <= BROADCAST_RULES:
        met = expressions.join(F.broadcast(known), "short")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = expressions.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")).join(salted, ["short", "salt"])
    hits = met.where("digest = rule_digest")
    order = F.struct(F.length("rule").alias("n"), "host_length", "verdict", "rule")
    best = hits.groupBy("host", "path").agg(F.max(order).alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    return rows.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
