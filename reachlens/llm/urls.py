"""URL filters: host and path rules, and a blocked Bloom filter before an exact join with a list of URLs.

All DataFrame functions. The filter holds a row of four 64-bit words for each block; a listed URL sets a bit in each
word of its block, by one hash. URLs that hit all four bits go to a hash join on the canonical URL itself, which
removes the false positives; the others never meet the list. The filter's size follows the list's: it is broadcast while
its rows are proven few (BROADCAST_BLOCKS), else joined by block, whose hash spreads evenly. The pages' URLs are read twice, once for
those that go on to the join and once for the others, which so are never shuffled.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule, has no canonical URL and
is allowed; of rules of equal length the one with the longer host wins; repeated rows are judged alike; long URLs are read whole;
no further columns are read, so they can't clash; of an empty list nothing is blocked; an empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host labels and query parameters that don't tell pages apart.
ALIASES, TRACKING = r"^(www|m)\.", r"^(utm_[a-z]+|ref|fbclid|gclid)="
#: Listed URLs a block (256 bits a block: 16 bits a URL); blocks up to which the filter is broadcast (40 bytes each).
PER_BLOCK, BROADCAST_BLOCKS = 16, 100_000


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to ``? #`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """host without aliases, path without closing slashes, and the query parameters that tell pages apart, sorted; null without ``://``."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    own = F.array_sort(F.filter(F.split(query, "&", -1), lambda x: (x != "") & ~F.rlike(x, F.lit(TRACKING))))
    text = F.concat(F.regexp_replace(host(url), ALIASES, ""), F.regexp_replace(path(url), "/+$", ""), F.lit("?"), F.array_join(own, "&"))
    return F.when(F.contains(url, F.lit("://")), text)


def rule_text(rules: list[tuple[str, str, str]], host_col: Column, path_col: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host, path) that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):  # the last that fits, the longest, wins
        fits = ((host_col == h) | F.endswith(host_col, F.lit("." + h))) & F.startswith(path_col, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(word)).otherwise(verdict)
    return rule, verdict


def bits(hashed: Column) -> list[Column]:
    """A mask for each of the four words of a block: six bits of the hash choose its bit."""
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed, 6 * k).bitwiseAND(63).cast("int")) for k in range(4)]


def block(hashed: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(hashed, 24), F.lit(blocks).cast("long"))


def bloom(listed: DataFrame, url_col: str, blocks: int) -> DataFrame:
    """_block, _w0 .. _w3 of the distinct URLs in ``url_col``."""
    h = F.xxhash64(url_col)
    masks = listed.select(block(h, blocks).alias("_block"), *(m.alias(f"_w{k}") for k, m in enumerate(bits(h))))
    return masks.groupBy("_block").agg(*(F.bit_or(f"_w{k}").alias(f"_w{k}") for k in range(4)))


def url_filter(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col``, host, path, rule, verdict, canonical and possible (hit in the filter) of every URL.

    listed: URLs in any spelling, in its first column.
    """
    names = listed.select(canonical(F.col(listed.columns[0])).alias("_listed")).filter("_listed is not null").distinct()
    blocks = max(1, math.ceil(names.count() / PER_BLOCK))
    words = bloom(names, "_listed", blocks)
    if blocks <= BROADCAST_BLOCKS:
        words = F.broadcast(words)
    url = F.col(url_col)
    rule, verdict = rule_text(rules, F.col("host"), F.col("path"))
    judged = pages.select(F.col(id_col), host(url).alias("host"), path(url).alias("path"), canonical(url).alias("canonical")).withColumns({"rule": rule, "_said": verdict})
    h = F.xxhash64("canonical")
    open_ = judged.withColumn("_block", F.when(F.col("_said").isNull() & F.col("canonical").isNotNull(), block(h, blocks)).otherwise(-1 - F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20))))  # no block of the filter: spread by the page
    met = open_.join(words, "_block", "left")
    hit = F.lit(True)
    for k, m in enumerate(bits(h)):
        hit = hit & (F.col(f"_w{k}").bitwiseAND(m) == m)
    met = met.withColumn("possible", F.coalesce(hit, F.lit(False)) & F.col("_said").isNull()).drop("_block", *(f"_w{k}" for k in range(4)))
    passed = met.filter("possible").join(names.withColumn("_is", F.lit(True)), F.col("canonical") == F.col("_listed"), "left").drop("_listed")
    both = met.filter("not possible").withColumn("_is", F.lit(None).cast("boolean")).unionByName(passed)
    said = F.coalesce("_said", F.when(F.col("_is"), F.lit("block")), F.lit("allow"))
    return both.select(id_col, "host", "path", "rule", said.alias("verdict"), "canonical", "possible")


#: (verdict, host, path) of the production query.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def crawled_twice(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The production list: URLs that the crawl reached more than once, in any spelling."""
    seen = pages.select(canonical(F.col(url_col)).alias("_c"), F.col(url_col).alias("url")).filter("_c is not null")
    return seen.groupBy("_c").agg(F.min("url").alias("url"), F.count("*").alias("_n")).filter("_n > 1").select("url")


SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
         regexp_extract(url, '^.*?://[^?#]*\?([^#]*)', 1, 's') AS query, contains(url, '://') AS whole
  FROM pages),
c AS (
  SELECT *, CASE WHEN whole THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '') || '?' || coalesce(array_to_string(
           list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)='))), '&'), '') END AS canonical
  FROM p),
listed AS (SELECT canonical FROM c WHERE canonical IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
r AS (
  SELECT c.*, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM c)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
