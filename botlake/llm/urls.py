"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A listed entry is a host and a path prefix (`example.net/en/`); it covers the host, its
subdomains and every path that starts with the prefix. A page's URL is canonicalised to
(host, path) and expanded to the entries that could cover it: its host suffixes with
as many labels as some entry has, times its path prefixes as long as some entry's path.
Each expansion looks up one block of the Bloom filter (64 bits, chosen by one hash; five
bits by another). Only expansions whose bits are all set reach the exact join on the
listed strings, which removes the false positives. The longest entry found is the rule.

Everything is DataFrame expressions. The filter is broadcast only while its size, known
from the number of listed entries, is below BROADCAST_BYTES; beyond that the lookup is a
shuffled equi-join on the block number. Pages are never joined to themselves: rules
come back to them by (host, path), of which only those with a rule are sent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_BLOCK, BITS_PER_ENTRY, PROBES = 64, 16, 5
BROADCAST_BYTES = 32 << 20
#: The rules of the packaged query: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def block_of(entry: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(entry, F.lit(1)), F.lit(blocks))


def bits_of(entry: Column) -> Column:
    """PROBES bits of a 64-bit block."""
    h, out = F.xxhash64(entry, F.lit(2)), None
    for i in range(PROBES):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        out = bit if out is None else out.bitwiseOR(bit)
    return out


def bloom(entries: DataFrame, blocks: int) -> DataFrame:
    """(block, bits) of the listed entries (column entry)."""
    return entries.groupBy(block_of(F.col("entry"), blocks).alias("block")).agg(F.bit_or(bits_of(F.col("entry"))).alias("bits"))


def listed(rules: DataFrame) -> DataFrame:
    """Entries of a list (verdict, host, path): lower-cased hosts, one row an entry.

    Rows with a null or empty host are left out, a null path is empty; of entries
    listed twice with different verdicts `block` counts.
    """
    host = F.translate(F.col("host"), UPPER, LOWER)
    path = F.coalesce(F.col("path"), F.lit(""))
    clean = rules.where(F.col("host") != "").select(host.alias("h"), path.alias("p"), "verdict")
    return (
        clean.groupBy("h", "p")
        .agg(F.max("verdict").alias("verdict"))
        .select(F.concat("h", "p").alias("entry"), F.size(F.split("h", r"\.")).alias("labels"), F.length("p").alias("prefix"), F.length("h").alias("host_size"), "verdict")
    )


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Columns of pages, then host, path, rule and verdict (columns of these names are replaced).

    Pages that no entry covers get `default` and a null rule.
    """
    entries = listed(rules)
    shapes = entries.groupBy("labels", "prefix").agg(F.count("*").alias("n")).collect()  # as many rows as distinct shapes
    pages = pages.drop("host", "path", "rule", "verdict")
    out = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    total = sum(r["n"] for r in shapes)
    if not total:
        return out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    blocks = max(8, -(-total * BITS_PER_ENTRY // BITS_PER_BLOCK))
    light = F.broadcast if blocks * 16 <= BROADCAST_BYTES else lambda df: df

    labels = F.split("host", r"\.")
    tried = [
        F.when(
            (F.size(labels) >= r["labels"]) & (F.length("path") >= r["prefix"]) & (F.col("host") != ""),
            F.concat(F.array_join(F.slice(labels, -r["labels"], r["labels"]), "."), F.substring("path", 1, r["prefix"])),
        )
        for r in sorted(shapes, key=lambda r: (r["labels"], r["prefix"]))
    ]
    probes = out.select("host", "path", F.explode(F.array_compact(F.array(*tried))).alias("entry"))
    possible = probes.withColumn("block", block_of(F.col("entry"), blocks)).join(light(bloom(entries, blocks)), "block")
    possible = possible.where(F.col("bits").bitwiseAND(bits_of(F.col("entry"))) == bits_of(F.col("entry"))).select("host", "path", "entry")
    # The same string can be split into host and path in one way only: a host has no slash, and a path starts with one or is empty.
    best = F.max_by(F.struct("entry", "verdict"), F.struct(F.length("entry"), F.col("host_size"), F.col("entry")))
    found = possible.join(entries, "entry").groupBy("host", "path").agg(best.alias("best"))
    back = out.join(found, ["host", "path"], "left").select(*[out[c] for c in pages.columns], "host", "path", F.col("best.entry").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))
    return back


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page by RULES; a URL that isn't listed is allowed.

    A null URL or one without `://` has an empty host and path, no rule and is allowed.
    Repeated rows are judged one by one; an empty table gives no rows.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = """
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
