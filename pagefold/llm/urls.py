"""URL filters: a temporal list join.

A list is a table of dated entries (pattern, category, day, action), action
``add`` or ``remove``.  Entries become validity intervals: each ``add`` holds
from its day up to the day before the next entry of its pattern and category.
A capture is judged by what was active on its own day: its host and all parent
domains are looked up, as of that day; an IPv4 address has no parents.

The verdict depends on host and day only, so captures are first reduced to
distinct (host, day) pairs, and what is asked of the list to distinct (pattern,
day) pairs of listed patterns: a suffix with a third of all captures costs one
row a day.  Interval bounds and days asked are then merged in one order of days
and the last bound is carried forward, so a pattern that is toggled daily costs
the sum of its entries and days, not their product; the active ones go back to
hosts by equality of pattern and day.  Sides are joined by shuffle, and Spark
splits skewed partitions; nothing is broadcast by hand.

Defined results: a null or unusual URL has host null and is not blocked; a null
day is never inside an interval; on one day ``remove`` wins over ``add``;
repeated list entries count once; repeated captures are judged alike and all
returned; empty tables give empty results or no blocking; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import table

ADDRESS = r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#@]+)"


def host_of(url) -> F.Column:
    host = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(host != "", F.rtrim(host, F.lit(".")))


def validity(entries: DataFrame) -> DataFrame:
    """pattern, category, valid_from, valid_to (exclusive, null: open) of every ``add``."""
    days = entries.filter("pattern IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')").groupBy("pattern", "category", "day").agg(F.max("action").alias("action"))
    w = Window.partitionBy("pattern", "category").orderBy("day")
    return days.withColumn("valid_to", F.lead("day").over(w)).filter("action = 'add'").select("pattern", "category", F.col("day").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures(page_id, url, day) with host, blocked and ``entries``: the active pattern:category pairs, sorted."""
    seen = captures.select("page_id", "url", "day", host_of("url").alias("host"))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    suffixes = F.when(F.col("host").rlike(ADDRESS), F.array("host")).otherwise(parents)
    intervals = validity(entries)
    listed = intervals.select("pattern", "category").distinct()
    asked = seen.filter("host IS NOT NULL AND day IS NOT NULL").select("host", "day").distinct().withColumn("pattern", F.explode(suffixes))
    held = as_of(asked.select("pattern", "day").distinct().join(listed, "pattern"), intervals)
    active = (
        asked.join(held, ["pattern", "day"])
        .groupBy(F.col("host").alias("h"), F.col("day").alias("d"))
        .agg(F.array_join(F.array_sort(F.collect_set(F.concat("pattern", F.lit(":"), F.coalesce("category", F.lit(""))))), ",").alias("entries"))
    )
    return seen.join(active, (F.col("host") == F.col("h")) & (F.col("day") == F.col("d")), "left").select("page_id", "host", "day", F.col("entries").isNotNull().alias("blocked"), F.coalesce("entries", F.lit("")).alias("entries"))


def as_of(asked: DataFrame, intervals: DataFrame) -> DataFrame:
    """The rows of ``asked`` (pattern, category, day) that lie in an interval: bounds carried forward along the days."""
    bound = lambda day, on: intervals.select("pattern", "category", F.col(day).alias("day"), F.lit(on).alias("on"))
    # an interval may begin on the day that another ends: True is the larger of the two
    bounds = bound("valid_from", True).union(bound("valid_to", False).filter("day IS NOT NULL")).groupBy("pattern", "category", "day").agg(F.max("on").alias("on"))
    both = bounds.withColumn("ask", F.lit(False)).union(asked.select("pattern", "category", "day", F.lit(None).cast("boolean").alias("on"), F.lit(True).alias("ask")))
    upto = Window.partitionBy("pattern", "category").orderBy("day", "ask").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("on", F.last("on", ignorenulls=True).over(upto)).filter("ask AND on").select("pattern", "category", "day")


def page_captures(spark, sf_dir: str) -> DataFrame:
    """The pages as captures; the table has no fetch time, so the day is derived from page_id."""
    return table(spark, sf_dir, "pages").select("page_id", "url", F.expr("date_add(DATE'2022-01-01', CAST(pmod(page_id * 37, 1000) AS INT))").alias("day"))


def page_list(spark, sf_dir: str) -> DataFrame:
    """A dated list over the hosts of ``pages`` and their parent domains: added, removed and added again on days drawn from md5."""
    hosts = table(spark, sf_dir, "pages").select(host_of("url").alias("host")).filter("host IS NOT NULL").distinct()
    named = hosts.select(F.explode(F.array("host", F.expr("substring_index(host, '.', -3)"))).alias("pattern")).distinct().withColumn("m", F.md5("pattern"))
    part = lambda at: F.conv(F.substring("m", at, 3), 16, 10).cast("int")
    first, gap = part(2) % 700, part(5) % 200 + 1
    events = F.array(*(F.struct(day.alias("n"), F.lit(action).alias("action")) for day, action in ((first, "add"), (first + gap, "remove"), (first + 2 * gap, "add"))))
    return (
        named.filter("conv(substring(m, 1, 1), 16, 10) < 5")
        .withColumn("e", F.explode(events))
        .select("pattern", F.element_at(F.array(*map(F.lit, ("malware", "adult", "spam"))), part(8) % 3 + 1).alias("category"), F.expr("date_add(DATE'2022-01-01', e.n)").alias("day"), "e.action")
    )


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(page_captures(spark, sf_dir), page_list(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


QUERIES = {"op7_url_filter": op7_url_filter}

ORACLES = {
    "op7_url_filter": r"""
WITH c AS (
  SELECT page_id, DATE '2022-01-01' + CAST(((page_id * 37) % 1000 + 1000) % 1000 AS INTEGER) AS day,
         nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#@]+)', 1)), '.'), '') AS host
  FROM pages
), p AS (
  SELECT DISTINCT unnest([host, array_to_string(list_slice(string_split(host, '.'), -3, -1), '.')]) AS pattern FROM c WHERE host IS NOT NULL
), k AS (
  SELECT pattern, md5(pattern) AS m FROM p
), n AS (
  SELECT pattern, CAST('0x' || substr(m, 2, 3) AS INTEGER) % 700 AS f, CAST('0x' || substr(m, 5, 3) AS INTEGER) % 200 + 1 AS gap,
         (['malware', 'adult', 'spam'])[CAST('0x' || substr(m, 8, 3) AS INTEGER) % 3 + 1] AS category
  FROM k WHERE CAST('0x' || substr(m, 1, 1) AS INTEGER) < 5
), e AS (
  SELECT pattern, category, DATE '2022-01-01' + unnest([f, f + gap, f + 2 * gap]) AS day, unnest(['add', 'remove', 'add']) AS action FROM n
), v AS (
  SELECT c.page_id, c.host, c.day, k2.pattern || ':' || k2.category AS entry
  FROM c JOIN (SELECT DISTINCT pattern, category FROM e) k2 ON c.host = k2.pattern OR (suffix(c.host, '.' || k2.pattern) AND NOT regexp_matches(c.host, '^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$'))
  WHERE (SELECT arg_max(action, day) FROM e WHERE e.pattern = k2.pattern AND e.category = k2.category AND e.day <= c.day) = 'add'
), a AS (
  SELECT page_id, string_agg(DISTINCT entry, ',' ORDER BY entry) AS entries FROM v GROUP BY page_id
)
SELECT page_id, host, CAST(day AS VARCHAR) AS day, entries IS NOT NULL AS blocked, coalesce(entries, '') AS entries FROM c LEFT JOIN a USING (page_id)
""",
}
