"""Indicator matching as equi-joins.

Every lookup first reduces the log side to its distinct indicators, so a value
that fills a third of the rows is looked up once, and joins the answers back.
Neither side is ever forced into a broadcast; feeds run to millions of rows and
AQE decides from their measured size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from watchloom.functions.columns import explode_once
from watchloom.functions.network import cidr_bounds, ipv4_long, prefix_mask
from watchloom.functions.text import (
    extract_domains, extract_emails, extract_hashes, extract_ips, extract_urls,
)

FEED_COLUMNS = ["type", "value", "severity", "feed_source", "description", "mitre_id", "tags", "load_order"]
_ANSWER = ["ioc_type", "ioc_value", "severity", "feed_source", "mitre_id", "description", "tags"]


def _answer_columns(feed: DataFrame) -> DataFrame:
    """Feed rows under the names of a match; optional feed columns default to ''."""
    have = set(feed.columns)
    optional = {c: (F.col(c) if c in have else F.lit("")) for c in ["description", "mitre_id", "tags"]}
    order = F.col("load_order") if "load_order" in have else F.lit(0)
    return feed.select(
        F.col("type").alias("ioc_type"), F.col("value").alias("ioc_value"), "severity", "feed_source",
        optional["mitre_id"].alias("mitre_id"), optional["description"].alias("description"),
        optional["tags"].alias("tags"), order.alias("_order"),
    )


def report_indicators(
    reports: DataFrame, keep: Sequence[str] = ("device_id", "timestamp_ms"), text: str = "raw_log", ip: str = "machine_ip"
) -> DataFrame:
    """One row per indicator of a report: (type, value, matched_in)."""
    def entries(kind: str, where: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(
            F.lit(kind).alias("type"), F.lower(v).alias("value"), F.lit(where).alias("matched_in")))

    log = F.coalesce(F.col(text), F.lit(""))
    found = F.concat(
        entries("ip", "client_ip", F.filter(F.array(F.col(ip)), lambda v: v.isNotNull())),
        entries("ip", "log_chunk_ip", extract_ips(log)),
        entries("domain", "log_chunk_domain", extract_domains(log)),
        entries("hash", "log_chunk_hash", extract_hashes(log)),
        entries("url", "log_chunk_url", extract_urls(log)),
        entries("email", "log_chunk_email", extract_emails(log)),
    )
    return explode_once(reports, keep, found, "_i").select(*keep, "_i.*")


def match_exact(indicators: DataFrame, feed: DataFrame) -> DataFrame:
    """Equality on (type, value) for ips, hashes, urls, emails and domains."""
    answers = _answer_columns(feed.filter(F.col("type").isin("ip", "hash", "url", "email", "domain"))).drop("_order")
    answers = answers.withColumns({"type": F.col("ioc_type"), "value": F.col("ioc_value")})
    return indicators.join(answers, ["type", "value"])


def match_cidr(indicators: DataFrame, feed: DataFrame) -> DataFrame:
    """First range, in load order, that holds an address no exact entry matches.

    An address falls in a range of prefix p exactly when its first p bits are
    the range's network, so each distinct address is tried with every prefix
    length and joined on (prefix, network).
    """
    exact = feed.filter("type = 'ip'").select("value")
    ips = (
        indicators.filter("type = 'ip'").select("value").distinct()
        .join(exact, "value", "left_anti")
        .withColumn("_ip", ipv4_long("value")).filter("_ip <> 0")
    )
    ranges = _answer_columns(feed.filter("type = 'cidr'")).withColumn("_b", cidr_bounds("ioc_value"))
    # Two ranges of one network: the earlier loaded wins before the join.
    ranges = (
        ranges.groupBy(F.col("_b.prefix").alias("_prefix"), F.col("_b.lo").alias("_net"))
        .agg(F.min(F.struct("_order", *_ANSWER)).alias("_r"))
    )
    networks = F.transform(F.sequence(F.lit(0), F.lit(32)), lambda p: F.struct(
        p.alias("_prefix"), F.col("_ip").bitwiseAND(prefix_mask(p)).alias("_net")))
    found = (
        ips.select("value", F.explode(networks).alias("_k")).select("value", "_k.*")
        .join(ranges, ["_prefix", "_net"])
        .groupBy("value").agg(F.min("_r").alias("_r"))
    )
    return indicators.filter("type = 'ip'").join(found, "value").select(
        *indicators.columns, *[F.col(f"_r.{c}").alias(c) for c in _ANSWER]
    )


def match_domain(indicators: DataFrame, feed: DataFrame) -> DataFrame:
    """Exact domain, else the longest feed domain the name is a sub-domain of; of equal entries the earlier loaded."""
    labels = F.split("value", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    names = indicators.filter("type = 'domain'").select("value").distinct()
    answers = _answer_columns(feed.filter("type = 'domain'"))
    found = (
        names.select("value", F.explode(suffixes).alias("_suffix"))
        .join(answers, F.col("_suffix") == F.col("ioc_value"))
        .groupBy("value")
        .agg(F.min(F.struct((-F.length("ioc_value")).alias("_rank"), "_order", *_ANSWER)).alias("_r"))
    )
    return indicators.filter("type = 'domain'").join(found, "value").select(
        *indicators.columns, *[F.col(f"_r.{c}").alias(c) for c in _ANSWER]
    )


def match_indicators(indicators: DataFrame, feed: DataFrame) -> DataFrame:
    """All matches of a report's indicators, each under its own lookup rule, in one join.

    Every distinct indicator is expanded to the keys it may be filed under -
    itself, the networks that hold an address, the suffixes of a name - and the
    best answer per indicator is kept: exact before range, earlier range before
    later, longer domain before shorter.
    """
    value, kind = F.col("value"), F.col("type")
    entry = lambda k, v, rank: F.struct(k.alias("_kind"), v.alias("_key"), rank.cast("long").alias("_rank"))
    ip = ipv4_long(value)
    labels = F.split(value, r"\.")
    own = F.array(entry(kind, value, F.lit(0)))
    networks = F.transform(F.sequence(F.lit(0), F.lit(32)), lambda p: entry(
        F.concat(F.lit("net"), p.cast("string")), ip.bitwiseAND(prefix_mask(p)).cast("string"), F.lit(1)))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: entry(
        kind, F.array_join(F.slice(labels, i, F.size(labels)), "."), i))
    keys = F.when((kind == "ip") & (ip != 0), F.concat(own, networks)).when(kind == "domain", suffixes).otherwise(own)

    answers = _answer_columns(feed.filter("type <> 'useragent'"))
    bounds = cidr_bounds("ioc_value")
    ranged = F.col("ioc_type") == "cidr"
    filed = answers.withColumns({
        "_kind": F.when(ranged, F.concat(F.lit("net"), bounds["prefix"].cast("string"))).otherwise(F.col("ioc_type")),
        "_key": F.when(ranged, bounds["lo"].cast("string")).otherwise(F.col("ioc_value")),
    })
    found = (
        explode_once(indicators.select("type", "value").distinct(), ["type", "value"], keys, "_k")
        .select("type", "value", "_k.*")
        .join(filed, ["_kind", "_key"])
        .groupBy("type", "value").agg(F.min(F.struct("_rank", "_order", *_ANSWER)).alias("_r"))
    )
    return indicators.join(found, ["type", "value"]).select(
        *indicators.columns, *[F.col(f"_r.{c}").alias(c) for c in _ANSWER]
    )


def _grams(text: Column, n: int) -> Column:
    count = F.length(text) - n + 1
    return F.when(
        count >= 1,
        F.array_distinct(F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(text, i, F.lit(n)))),
    ).otherwise(F.array().cast("array<string>"))


def match_user_agent(df: DataFrame, feed: DataFrame, column: str = "user_agent") -> DataFrame:
    """Longest feed value contained in the lower-cased user agent.

    Containment is turned into an equi-join: a feed value is filed under its
    rarest run of three characters (or under itself when shorter), and an
    agent is looked up under every run it holds; ``contains`` then decides.
    """
    answers = _answer_columns(feed.filter("type = 'useragent'"))
    value = F.col("ioc_value")
    keyed = answers.select("*", F.explode(
        F.when(F.length(value) >= 3, _grams(value, 3)).otherwise(F.array(value))).alias("_gram"))
    rarity = keyed.groupBy("_gram").agg(F.count("*").alias("_uses"))
    filed = (
        keyed.join(rarity, "_gram")
        .groupBy(*_ANSWER, "_order").agg(F.min(F.struct("_uses", "_gram")).alias("_g"))
        .select(*_ANSWER, F.col("_g._gram").alias("_gram"))
    )
    agent = F.lower(F.col(column))
    agents = df.select(agent.alias("_agent")).filter(F.col("_agent").isNotNull()).distinct()
    lookups = agents.select("_agent", F.explode(F.concat(
        _grams(F.col("_agent"), 1), _grams(F.col("_agent"), 2), _grams(F.col("_agent"), 3))).alias("_gram"))
    found = (
        lookups.join(filed, "_gram").filter(F.col("_agent").contains(F.col("ioc_value")))
        .groupBy("_agent")
        .agg(F.max_by(F.struct(*_ANSWER), F.struct(F.length("ioc_value"), "ioc_value")).alias("_r"))
    )
    return df.withColumn("_agent", agent).join(found, "_agent").select(
        *df.columns, *[F.col(f"_r.{c}").alias(c) for c in _ANSWER]
    )


def ioc_stats(feed: DataFrame) -> DataFrame:
    """Entries by type (ranges count as ips), by feed and in total."""
    kind = F.when(F.col("type") == "cidr", "ip").otherwise(F.col("type"))
    rows = feed.select(F.explode(F.array(
        F.struct(F.lit("type").alias("scope"), kind.alias("name")),
        F.struct(F.lit("feed").alias("scope"), F.col("feed_source").alias("name")),
        F.struct(F.lit("total").alias("scope"), F.lit("all").alias("name")),
    )).alias("_s")).select("_s.*")
    return rows.groupBy("scope", "name").agg(F.count("*").alias("entries"))


def latest_entries(feed: DataFrame, order: Sequence[str] = ("feed_source", "line_no")) -> DataFrame:
    """Of equal (type, value) pairs the last loaded one stays; ranges are all kept."""
    others = [c for c in feed.columns if c not in ("type", "value")]
    singles = (
        feed.filter("type <> 'cidr'").groupBy("type", "value")
        .agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_last"))
        .select("type", "value", "_last.*")
    )
    return singles.select(*feed.columns).unionByName(feed.filter("type = 'cidr'"))
