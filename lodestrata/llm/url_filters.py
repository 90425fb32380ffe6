"""Temporal list join: dated list entries become validity intervals, and captures are judged by the entries active at fetch time.

An entry (rule, action, listed_at) opens an interval with ``add`` and closes it with ``remove``; a rule is a host and covers its subdomains.
A capture is matched to the rules on its host's suffixes. Hosts are counted before anything else, and the rules of each distinct host are found
first; captures then meet one row per listed host, carrying its intervals, and the as-of step looks for the intervals that hold the fetch time.

Captures of a host that has a thousandth of all captures or more are dealt over salts in proportion to their number, and that host's row is repeated for each
salt; there are a thousand such hosts at most, so their salts are broadcast. Captures without a listed host's key, those without a host among
them, are spread by the same means. A host's row holds the history of the rules on its suffixes, which is small beside its captures.

Defined cases: a null or malformed URL has no host and is not blocked; a null fetch time is in no interval; of equal-dated entries of a rule
``remove`` counts last; repeated entries count once; entries without rule or date are ignored; an empty list blocks nothing, and of no captures come no
rows; columns of captures named host, blocked or rule are replaced, others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, partitions, unused

HEAVY = 1000  # hosts with one in so many captures are salted


def host_of(url: Column) -> Column:
    """The lower-case host, without user, port and a trailing dot; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def intervals(entries: DataFrame) -> DataFrame:
    """rule, valid_from, valid_to (exclusive; null: still open) from the dated entries. An add while listed changes nothing."""
    rule = F.lower("rule")
    last = entries.filter("rule is not null and listed_at is not null and action in ('add', 'remove')").groupBy(rule.alias("rule"), "listed_at").agg(F.max("action").alias("action"))
    w = W.partitionBy("rule").orderBy("listed_at")
    turns = last.withColumn("was", F.lag("action").over(w)).filter(F.col("was").isNull() | (F.col("was") != F.col("action")))
    spans = turns.withColumn("valid_to", F.lead("listed_at").over(w))
    return spans.filter("action = 'add'").select("rule", F.col("listed_at").alias("valid_from"), "valid_to")


def suffixes(host: Column) -> Column:
    """The host and its parent domains."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def evaluate(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """The captures with ``host``, ``blocked`` and ``rule``, the most specific rule active at fetch time (null if none)."""
    spark = captures.sparkSession
    kept = [c for c in captures.columns if c.lower() not in ("host", "blocked", "rule")]
    h, s, spans, salts = (unused(f"__{c}", captures.columns) for c in ("host", "salt", "spans", "salts"))
    taken = captures.select(*[F.col(f"`{c}`") for c in kept], host_of(F.col(url_col)).alias(h))
    counts = Scratch(spark, "hosts").save(taken.groupBy(h).agg(F.count("*").alias("n")), "counts")
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    many = F.ceil(F.col("n") * (2 * partitions(spark)) / max(1, total))
    heavy = counts.filter((F.col("n") * HEAVY >= total) & F.col(h).isNotNull() & (many > 1)).select(F.col(h), many.cast("int").alias(salts))  # HEAVY rows at most
    met = counts.filter(F.col(h).isNotNull()).select(h, F.explode(suffixes(F.col(h))).alias("rule")).join(intervals(entries), "rule")
    listed = met.groupBy(h).agg(F.collect_list(F.struct("rule", "valid_from", "valid_to")).alias(spans))
    listed = listed.join(F.broadcast(heavy), h, "left").withColumn(s, F.explode(F.sequence(F.lit(0), F.coalesce(salts, F.lit(1)) - 1))).drop(salts)
    row = F.xxhash64(F.col(url_col), F.col(time_col), F.monotonically_increasing_id())
    dealt = taken.join(F.broadcast(heavy), h, "left").withColumn(s, F.when(F.col(h).isNull(), F.pmod(row, F.lit(1 << 20))).otherwise(F.pmod(row, F.coalesce(salts, F.lit(1)))).cast("int")).drop(salts)
    dealt = dealt.withColumn(h, F.coalesce(F.col(h), F.lit("")))  # no host is named so, and its salts spread it
    at = F.col(time_col)
    active = F.filter(spans, lambda x: (x["valid_from"] <= at) & (x["valid_to"].isNull() | (at < x["valid_to"])))
    best = F.array_max(F.transform(active, lambda x: F.struct(F.length(x["rule"]).alias("n"), x["rule"].alias("rule"))))
    judged = dealt.join(listed, [h, s], "left")
    return judged.select(*[F.col(f"`{c}`") for c in kept], F.nullif(F.col(h), F.lit("")).alias("host"), F.coalesce(best["rule"].isNotNull(), F.lit(False)).alias("blocked"), best["rule"].alias("rule"))
