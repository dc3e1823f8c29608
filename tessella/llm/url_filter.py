"""URL filtering: host and path rules first, then a list of canonical URLs.

Listed URLs are set in a blocked Bloom filter: a URL's hash picks one 64-bit
block and ``BITS`` bits inside it. The filter's blocks are the only broadcast
data; their number is a parameter with an upper bound (``MAX_BLOCKS`` rows of
two longs), so the filter cannot grow with the list; a longer list only lets
more false positives through. URLs that pass go to an exact hash join with the
list, which removes them, so the verdict never depends on the filter's size.

Defined results: null URLs and URLs without ``://`` have an empty host and
path and the verdict ``allow``; repeated rows are judged one by one; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BLOCKS = 1 << 17
BITS = 6
#: (action, host, path prefix) as the contract gives them.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.``, path without trailing slashes and ``.html``; scheme, query and fragment go."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"(\.html)?/*$", ""))


def on_listed_host(host: Column, names) -> Column:
    """True where a label of the host, ``www.`` dropped as in ``canonical``, is one of the names: the host itself or any subdomain of it."""
    return F.arrays_overlap(F.split(F.regexp_replace(host, r"^www\.", ""), r"\."), F.array(*map(F.lit, names)))


def mask_of(url: Column) -> Column:
    bits = F.xxhash64(url, F.lit(2))
    mask = F.lit(0).cast("long")
    for k in range(BITS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(bits, 8 * k), F.lit(64)).cast("int")))
    return mask


def block_of(value: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(value, F.lit(1)), F.lit(blocks)).cast("int")


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, word) rows of the blocked Bloom filter of ``listed.canonical``."""
    return listed.select(block_of(F.col("canonical"), blocks).alias("block"), mask_of(F.col("canonical")).alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("word"))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, or nulls."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule, action = F.when(fits, F.lit(name + prefix)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, blocks: int = MAX_BLOCKS) -> DataFrame:
    """page_id, host, path, rule, verdict and listed for each page; ``listed`` has a column ``canonical``."""
    blocks = min(blocks, MAX_BLOCKS)
    listed = listed.select("canonical").where("canonical <> ''").distinct()
    base = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, action = rule_for(F.col("host"), F.col("path"), rules)
    base = base.select("*", rule.alias("rule"), action.alias("action"), canonical(F.col("host"), F.col("path")).alias("canonical"))
    base = base.withColumn("block", block_of(F.col("canonical"), blocks)).withColumn("mask", mask_of(F.col("canonical")))
    probed = base.join(F.broadcast(bloom_filter(listed, blocks)), "block", "left").withColumn("possible", F.coalesce(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False)) & F.col("action").isNull())
    # A URL that cannot be listed gets a null key, which no join partner has.
    keyed = probed.withColumn("key", F.when(F.col("possible"), F.col("canonical")))
    sure = keyed.where("key is null").withColumn("listed", F.lit(False))
    hits = keyed.where("key is not null").join(listed.select(F.col("canonical").alias("key"), F.lit(True).alias("found")), "key", "left").withColumn("listed", F.coalesce("found", F.lit(False)))
    both = sure.select("page_id", "host", "path", "rule", "action", "listed").unionByName(hits.select("page_id", "host", "path", "rule", "action", "listed"))
    return both.select("page_id", "host", "path", "rule", F.coalesce("action", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
