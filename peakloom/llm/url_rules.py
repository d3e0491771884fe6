"""URL verdicts by pattern rules that are indexed by their rarest literal token.

A rule is a pattern over the text `host + path`:

- a leading `||` ties the pattern to the host or any subdomain of it,
- a leading `|` to the very start, and a trailing `|` to the very end,
- `*` stands for any characters; everything else is literal.

Every rule is filed under one of its literal tokens, the one that is rarest
among the URLs at hand. A URL fetches only the rules filed under its own
tokens, and only those are run as regular expressions. All of it is built from
DataFrame functions; rules reach the URLs by a join.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.functions.binding import exploded

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = re.compile(r"[a-z0-9]+")
#: Rules up to this many are broadcast to the URLs; more are joined by a shuffle on the token.
BROADCAST_RULES = 100_000
RULE_SCHEMA = "rank long, label string, site boolean, verdict string, regex string, tokens array<string>"


@dataclass(frozen=True)
class UrlRule:
    """`site` rules go before all others; within a kind the longer pattern wins, then the later one listed."""

    pattern: str
    verdict: str
    label: str
    site: bool = False


def site_rule(host: str, path: str, verdict: str) -> UrlRule:
    """A rule for a host with its subdomains and a path prefix."""
    return UrlRule(f"||{host}{path}", verdict, host + path, True)


def to_regex(pattern: str) -> str:
    """The Java regular expression of a rule's pattern."""
    body, head, tail = pattern, "", ""
    if body.startswith("||"):
        body, head = body[2:], r"^(?:[^/]*\.)?"
    elif body.startswith("|"):
        body, head = body[1:], "^"
    if body.endswith("|"):
        body, tail = body[:-1], "$"
    return "(?s)" + head + ".*".join(re.sub(r"([\\.\[\]{}()+?^$|])", r"\\\1", part) for part in body.split("*")) + tail


def literal_tokens(pattern: str) -> list[str]:
    """Tokens that are whole tokens of every URL that the pattern fits.

    A run of letters and digits counts if the pattern fixes both its ends:
    by a literal separator or by an anchor.
    """
    start, body = 0, pattern
    anchored = body.startswith("|")
    body = body.lstrip("|") if anchored else body
    closed = body.endswith("|")
    body = body[:-1] if closed else body
    found = []
    for m in re.finditer(r"[A-Za-z0-9]+", body):
        opened = anchored if m.start() == start else body[m.start() - 1] != "*"
        ended = closed if m.end() == len(body) else body[m.end()] != "*"
        if opened and ended and TOKEN.fullmatch(m.group()):
            found.append(m.group())
    return sorted(set(found))


def rule_table(spark: SparkSession, rules: Sequence[UrlRule]) -> DataFrame:
    """Rules as a table; a higher rank wins."""
    ordered = sorted(enumerate(rules), key=lambda r: (r[1].site, len(r[1].pattern.strip("|")), r[0]))
    rows = [
        (rank, r.label, r.site, r.verdict, to_regex(r.pattern), literal_tokens(r.pattern))
        for rank, (_, r) in enumerate(ordered)
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null URL or one without `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct literal tokens of a URL, and the empty token that every URL has once.

    Path tokens keep their case, as patterns do; only runs of lower-case
    letters and digits between other characters are looked up.
    """
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.concat(host, path), r"[^A-Za-z0-9]+", -1)))


def rarest_token(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """`rank, token`: for each rule its literal token with the fewest occurrences in `tokens`.

    Ties go to the first token in order; a rule without a literal token is
    filed under the empty token, which every URL fetches.
    """
    options = rules.select("rank", F.explode("tokens").alias("token"))
    counts = tokens.join(small(options.select("token").distinct(), rules), "token").groupBy("token").count()
    best = (
        options.join(counts, "token", "left")
        .groupBy("rank")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)), F.col("token"))).alias("best"))
        .select("rank", F.col("best.token").alias("token"))
    )
    return rules.select("rank").join(best, "rank", "left").select("rank", F.coalesce("token", F.lit("")).alias("token"))


def small(table: DataFrame, rules: DataFrame, limit: int = BROADCAST_RULES) -> DataFrame:
    """`table` marked for broadcast if the rules behind it are known to be few."""
    return F.broadcast(table) if rules.limit(limit + 1).count() <= limit else table


def judge(
    pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url"
) -> DataFrame:
    """`key, host, path, rule, verdict, pattern` for each row of `pages`.

    `rule` is the label of the winning site rule, else null; `pattern` the
    label of whatever rule decided. Without a fitting rule the verdict is
    `default`. A null or malformed URL has empty host and path and is judged
    like any other. Equal rows give equal results, as many as there are;
    other columns are not read. One shuffle moves key and URL, after rows of
    equal key and URL have been reduced in their tasks.
    """
    host, path = host_and_path(F.col(url))
    read = pages.select(F.col(key).alias("_key"), host.alias("_host"), path.alias("_path")).withColumn(
        "_tokens", url_tokens(F.col("_host"), F.col("_path"))
    )
    tokens = exploded(read, "_key", "_host", "_path", items="_tokens", name="token")
    index = rarest_token(rules, tokens.select("token")).join(rules, "rank").select("token", "rank", "regex")
    hit = F.rlike(F.concat("_host", "_path"), F.col("regex"))
    best = (
        tokens.join(small(index, rules), "token", "left")
        .groupBy("_key", "_host", "_path")
        .agg(
            F.max(F.when(hit, F.col("rank"))).alias("rank"),
            # several rules may be filed under the empty token: each row has it once per such rule
            F.sum(F.when(F.col("token") == "", 1).otherwise(0)).alias("_copies"),
        )
    )
    everywhere = rules.filter(F.size("tokens") == 0).count()
    labels = small(rules.select("rank", "label", "site", F.col("verdict").alias("_verdict")), rules)
    return (
        best.join(labels, "rank", "left")
        .select(
            F.col("_key").alias(key),
            F.col("_host").alias("host"),
            F.col("_path").alias("path"),
            F.when(F.col("site"), F.col("label")).alias("rule"),
            F.coalesce("_verdict", F.lit(default)).alias("verdict"),
            F.col("label").alias("pattern"),
            F.explode(F.sequence(F.lit(1), (F.col("_copies") / max(1, everywhere)).cast("int"))).alias("_copy"),
        )
        .drop("_copy")
    )
