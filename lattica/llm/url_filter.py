"""Operator 5: URL rules and a list of URLs behind a blocked Bloom filter, with DataFrame functions alone.

The filter has blocks of eight 64-bit words; a URL sets one bit in each word of one block. It is built by a
partial aggregation (bit_or by block) and sized from the list: BITS_PER_URL for each URL. Up to BROADCAST_BYTES
(80 bytes a block) it is broadcast; beyond that it is joined by its blocks with a shuffle. URLs that pass it go
on to an exact hash join with the list, which removes false positives; the others don't shuffle again.

Cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and no listed URL, and
is allowed. Repeated rows stay. Nulls in the list are ignored; an empty list blocks nothing. An empty table gives an
empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, shuffle_partitions

#: (rule, verdict): host and path prefix; the longest that fits wins.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: Query parameters that don't change what a URL names.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "ref", "fbclid", "gclid"]
BITS_PER_URL, BLOCK_BITS, BLOCK_BYTES, BROADCAST_BYTES = 16, 512, 80, 64 << 20
#: The list that the query takes, stated by a rule and not by the pages: all combinations of these, with every LISTED_STEP-th number below LISTED_PAGES.
LISTED_SUBDOMAINS, LISTED_NAMES, LISTED_ENDS = ["", "m.", "blog."], ["spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track", "adult-x"], ["com", "net", "org"]
LISTED_FOLDERS, LISTED_PAGES, LISTED_STEP = ["de", "en", "es", "fr"], 10_000, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased. Path: then up to ``?``, ``#`` or end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def canonical(url: Column) -> Column:
    """Host without a leading ``www.``, path without trailing ``/``, and the query without tracking parameters, in order; null if there is no host."""
    host, path = host_and_path(url)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(TRACKING)))
    text = F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
    return F.when(host != "", text)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _bit(url: Column, word: int) -> Column:
    """The bit of one word: six bits of a second hash."""
    return F.shiftright(F.xxhash64(url, F.lit("bits")), 6 * word).bitwiseAND(F.lit(63)).cast("int")


def _block(url: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(n_blocks)).cast("int")


def blocks_for(n_urls: int) -> int:
    return max(1, -(-n_urls * BITS_PER_URL // BLOCK_BITS))


def bloom_filter(listed: DataFrame, url_col: str, n_blocks: int) -> DataFrame:
    """(block, w0 .. w7): at most n_blocks rows."""
    one = F.lit(1).cast("long")
    u = F.col(url_col)
    words = [F.bit_or(F.call_function("shiftleft", one, _bit(u, k))).alias(f"w{k}") for k in range(8)]
    return listed.groupBy(_block(u, n_blocks).alias("block")).agg(*words)


def passes(url: Column) -> Column:
    """Whether all eight bits of a URL are set in its block's words, which stand in the same row (null: the block is empty)."""
    out = F.col("w0").isNotNull()
    for k in range(8):
        out = out & (F.call_function("shiftright", F.col(f"w{k}"), _bit(url, k)).bitwiseAND(F.lit(1).cast("long")) == 1)
    return out


def listed_urls(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Distinct canonical URLs of a list (column ``u``), without nulls."""
    return urls.select(canonical(urls[url_col]).alias("u")).where("u is not null").distinct()


def stated_list(spark: SparkSession) -> DataFrame:
    """The URLs (column url) that the rule states."""
    parts = [LISTED_SUBDOMAINS, LISTED_NAMES, LISTED_ENDS, LISTED_FOLDERS]
    rest, picked = F.col("id"), []
    for values in parts:
        picked.append(F.element_at(F.array(*map(F.lit, values)), (F.pmod(rest, F.lit(len(values))) + 1).cast("int")))
        rest = F.floor(rest / len(values))
    sub, name, end, folder = picked
    n = LISTED_PAGES // LISTED_STEP
    for values in parts:
        n *= len(values)
    return spark.range(n).select(F.concat(F.lit("http://"), sub, name, F.lit(".example."), end, F.lit("/"), folder, F.lit("/"), (rest * LISTED_STEP).cast("string")).alias("url"))


def url_filter(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str]] | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Host, path, fitting rule and verdict of each URL; without a rule, ``block`` if its canonical form is listed, else ``allow``.

    listed: column ``u`` of distinct canonical URLs (see :func:`listed_urls`). broadcast_bytes bounds what is broadcast.
    """
    listed = durable(listed.select("u"))
    n_blocks = blocks_for(listed.count())
    bloom = bloom_filter(listed, "u", n_blocks)
    if n_blocks * BLOCK_BYTES <= broadcast_bytes:
        bloom = F.broadcast(bloom)
    host, path = host_and_path(pages[url_col])
    rule, verdict = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    p = pages.select(pages[id_col].alias("id"), canonical(pages[url_col]).alias("u"), host.alias("host"), path.alias("path"))
    # URLs without a host have no block: numbers below 0, many, so that they don't meet in one task.
    p = p.withColumn("rule", rule).withColumn("said", verdict).withColumn("block", F.coalesce(_block(F.col("u"), n_blocks), -1 - F.pmod(F.xxhash64("id"), F.lit(4096)).cast("int")))
    tested = p.join(bloom, "block", "left").select("id", "host", "path", "rule", "said", "u", (F.col("said").isNull() & F.col("u").isNotNull() & passes(F.col("u"))).alias("hit"))
    rest = tested.where(~F.coalesce("hit", F.lit(False))).select("id", "host", "path", "rule", F.coalesce("said", F.lit("allow")).alias("verdict"))
    # A listed URL may be a large share of all pages: hits are spread over salts, and the list's rows that were hit go to each salt.
    salts = max(1, shuffle_partitions(pages.sparkSession) // 2)
    hits = tested.where("hit").withColumn("salt", F.pmod(F.xxhash64("id", "host", "path"), F.lit(salts)).cast("int"))
    met = hits.groupBy("u", "salt").count().select("u", "salt")
    true_hits = met.join(listed.select("u", F.lit(True).alias("is_listed")), "u", "left")
    exact = hits.join(true_hits, ["u", "salt"]).select("id", "host", "path", "rule", F.when(F.col("is_listed"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))
    return rest.union(exact).withColumnRenamed("id", id_col)


ORACLE = r"""
WITH a AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, url, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM a
), c AS (
  SELECT page_id, coalesce(translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(substr(rest, length(h) + 1), '^[^?#]*'), '') AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
      lambda p: p <> '' AND NOT list_contains(['utm_source', 'utm_medium', 'utm_campaign', 'ref', 'fbclid', 'gclid'], split_part(p, '=', 1)))) AS q
  FROM b
), d AS (
  SELECT page_id, host, path, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS u,
    CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM c
), listed AS (
  SELECT s || n || '.example.' || e || '/' || f || '/' || k AS u FROM (SELECT unnest(['', 'm.', 'blog.']) AS s), (SELECT unnest(['com', 'net', 'org']) AS e),
    (SELECT unnest(['spam-farm', 'cheap-pills', 'casino-win', 'free-bets', 'ads-track', 'adult-x']) AS n), (SELECT unnest(['de', 'en', 'es', 'fr']) AS f), range(0, 10000, 4) AS r(k)
)
SELECT page_id, host, path, rule,
  CASE rule WHEN 'org/' THEN 'allow' WHEN 'com/fr/' THEN 'allow' WHEN 'example.org/es/' THEN 'block' WHEN 'example.org/en/1' THEN 'block'
    WHEN 'com/de/' THEN 'block' ELSE CASE WHEN listed.u IS NOT NULL THEN 'block' ELSE 'allow' END END AS verdict
FROM d LEFT JOIN listed ON d.u = listed.u
"""
