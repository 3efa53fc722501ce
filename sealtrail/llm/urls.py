"""URL filters: prefix rules, then a listed-URL check behind a blocked Bloom filter, all native.

A rule is a host and the beginning of a path; it fits the host and its subdomains, and the
longest fitting rule decides.  A URL that no rule fits is blocked if its canonical form is
listed.  Rules and list are looked up the same way: each URL gives a few keys (one per host
suffix and rule path length, and its canonical form), a blocked Bloom filter of bounded size
passes the keys that may be known, and an exact hash join removes its false positives.  Only
those few keys are ever shuffled, whatever the size of the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sealtrail.llm import bloom
from sealtrail.plans.joins import broadcast_if_small

#: The rules of the registered query: (host, path, action).
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

#: Rules may have paths of this many different lengths; each costs a key per host suffix.
MOST_LENGTHS = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host and path without ``www.`` or ``m.``, ``.html`` and final slashes, plus the query
    without tracking parameters; null if there is no host."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(\.html)?/*$", "")
    asked = F.regexp_extract(url, r"(?s)^[^#?]*\?([^#]*)", 1)
    kept = F.filter(F.split(asked, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref)="))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise("")
    return F.when(host != "", F.concat(host, path, query))


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, action string")


def _keys(host: Column, path: Column, canonical_url: Column, lengths: list[int]) -> Column:
    """All keys under which a URL may be known: ``r<host suffix>\\n<path prefix>``, ``u<canonical>``."""
    none = F.expr("cast(array() as array<string>)")
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    prefixes = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    prefixes = F.filter(F.array(*prefixes), lambda p: p.isNotNull()) if prefixes else none
    rules = F.flatten(F.transform(
        suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(F.lit("r"), s, F.lit("\n"), p))
    ))
    url = F.when(canonical_url.isNotNull(), F.array(F.concat(F.lit("u"), canonical_url))).otherwise(none)
    return F.concat(rules, url)


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    listed: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    blocks: int = bloom.BLOCKS,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, canonical_url, listed) for every row of ``pages``.

    ``rules`` has ``host, path, action``; ``listed`` a column ``canonical_url``.  ``rule`` is
    host and path of the longest fitting rule (by its whole length; of equally long ones the
    longer host), null if none fits; equal rules with unequal actions block.  ``verdict`` is
    that rule's action, else ``block`` for listed URLs and ``allow`` for the rest.  A null or
    hostless URL has empty host and path, fits no rule, is on no list and is allowed.  Rows
    that repeat give repeated results; null ids stay; null rules and list entries are ignored.
    """
    parts = pages.select(
        F.col(page_id).alias("page"),
        host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"),
        canonical(F.col(url)).alias("canonical_url"),
    )
    exact = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .groupBy("host", "path")
        .agg(F.max(F.col("action") == "block").alias("blocks"))
        .select(
            F.concat(F.lit("r"), "host", F.lit("\n"), "path").alias("key"),
            F.concat("host", "path").alias("rule"),
            F.length("host").alias("host_length"),
            "blocks",
        )
    )
    entries = (
        listed.where(F.col("canonical_url").isNotNull())
        .select(F.concat(F.lit("u"), "canonical_url").alias("key"))
        .distinct()
    )
    known = bloom.build(exact.select("key").unionByName(entries), "key", blocks)

    found = rules.where(F.col("path").isNotNull()).select(F.length("path")).distinct().limit(MOST_LENGTHS + 1).collect()
    if len(found) > MOST_LENGTHS:
        raise ValueError(f"rule paths have more than {MOST_LENGTHS} different lengths")
    keys = _keys(F.col("host"), F.col("path"), F.col("canonical_url"), sorted(r[0] for r in found))

    # copies of one address are judged once, so that a hot one is no hot key below
    addresses = parts.where("host <> ''").select("host", "path", "canonical_url").distinct()
    hits = bloom.possible(addresses.withColumn("key", F.explode(keys)), "key", known, blocks)
    best = F.max(F.struct(F.length("rule").alias("n"), "host_length", "blocks", "rule")).alias("best")
    fits = hits.join(broadcast_if_small(exact), "key").groupBy("host", "path").agg(best)
    on_list = hits.join(entries, "key", "left_semi").select("canonical_url", F.lit(True).alias("on_list")).distinct()
    judged = (
        addresses.join(fits, ["host", "path"], "left")
        .join(on_list, "canonical_url", "left")
        .select(
            "host", "path", "canonical_url", F.col("best.rule").alias("rule"), F.col("best.blocks").alias("by_rule"),
            F.coalesce("on_list", F.lit(False)).alias("listed"),
        )
    )
    blocked = F.coalesce("by_rule", "listed", F.lit(False))
    return parts.join(judged, ["host", "path", "canonical_url"], "left").select(
        F.col("page").alias(page_id), "host", "path", "rule",
        F.when(blocked, "block").otherwise("allow").alias("verdict"),
        "canonical_url", F.coalesce("listed", F.lit(False)).alias("listed"),
    )


#: Words in host labels from which the registered query's list is made.
LISTED_WORDS = ("spam", "casino", "pills", "bets", "adult", "ads")


def listed_by_words(pages: DataFrame, url: str = "url") -> DataFrame:
    """A list like published ones: canonical URLs on hosts with a label part of ``LISTED_WORDS``."""
    spam = host_of(F.col(url)).rlike(r"(^|[.-])(" + "|".join(LISTED_WORDS) + r")([.-]|$)")
    return pages.where(spam).select(canonical(F.col(url)).alias("canonical_url"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, rule_table(spark), listed_by_words(pages))


ORACLE = f"""
WITH p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '(?s)^[^#?]*\\?([^#]*)', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref)='))) AS asked
  FROM pages
), c AS (
  SELECT page_id, host, path,
    CASE WHEN regexp_replace(host, '^(www|m)\\.', '') <> '' THEN
      regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(\\.html)?/*$', '')
      || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END END AS canonical_url
  FROM p
), l AS (
  SELECT DISTINCT canonical_url FROM c
  WHERE regexp_matches(host, '(^|[.-])({"|".join(LISTED_WORDS)})([.-]|$)') AND canonical_url IS NOT NULL
), r AS (
  SELECT * FROM (VALUES {", ".join(map(str, RULES))}) AS t (rule_host, rule_path, action)
), b AS (
  SELECT page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    max_by(action, length(rule_host || rule_path)) AS action
  FROM c JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT c.page_id, host, path, rule, coalesce(action, CASE WHEN l.canonical_url IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
  c.canonical_url, l.canonical_url IS NOT NULL AS listed
FROM c LEFT JOIN b USING (page_id) LEFT JOIN l ON l.canonical_url = c.canonical_url
"""
