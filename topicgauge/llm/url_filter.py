"""URL rules behind a blocked Bloom filter, confirmed by an exact hash join.

The list holds canonical URLs (host and path); an entry covers its host with all subdomains, and
every path that starts with its own. So a URL is covered when one of its canonical prefixes, a
suffix of its host's labels with a leading stretch of its path, is listed. These prefixes probe a
blocked Bloom filter: one equi-join on the block fetches eight 64-bit words, in each of which the
prefix must find its bit. What passes meets the list itself in an exact join, which removes false
positives; of several entries the longest decides (of equally long ones, that of the longer host).

Distinct URLs are judged once and the verdicts joined back, so a URL or host that fills a third of
the table is no hot key of the filter. The filter takes BITS_PER_ENTRY bits per listed URL and is a
stored table: Spark broadcasts it below its threshold and shuffles the probes beyond it.

Defined results: a null URL or one without ``://`` has an empty host and path and no rule; a null
or empty path in the list covers all paths; entries with a null or empty host cover nothing; an
entry listed twice with both verdicts blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicgauge.llm.common import ascii_lower
from topicgauge.sources.storage import materialize

BITS_PER_ENTRY = 16
WORDS = 8
BLOCK_BITS = 64 * WORDS


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listing(entries: DataFrame) -> DataFrame:
    """Canonical entries ``key, rule, n_host, verdict`` of a table ``host, path, verdict``."""
    path = F.coalesce("path", F.lit(""))
    host = ascii_lower(F.col("host"))
    return (
        entries.filter(F.length("host") > 0)
        .select(F.concat(host, F.lit(" "), path).alias("key"), F.concat(host, path).alias("rule"), F.length(host).alias("n_host"), "verdict")
        .groupBy("key", "rule", "n_host").agg(F.max("verdict").alias("verdict"))
    )


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    """One bit in each word of the block."""
    return [F.expr("shiftleft(1L, cast(pmod({}, 64) as int))".format(f"xxhash64({key}, {k})")) for k in range(1, WORDS + 1)]


def bloom_filter(keys: DataFrame, entries: int) -> tuple[DataFrame, int]:
    """``block, w0..w7`` for the column ``key``, and the number of blocks."""
    blocks = max(1, -(-entries * BITS_PER_ENTRY // BLOCK_BITS))
    words = [F.bit_or(bit).alias(f"w{k}") for k, bit in enumerate(_bits("key"))]
    return keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(*words), blocks


def prefixes(urls: DataFrame, path_lengths: list[int]) -> DataFrame:
    """``host, path, key``: every host suffix with every leading stretch of the path that has a listed length."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*map(F.lit, path_lengths)), lambda n: n <= F.length("path"))
    keys = F.flatten(
        F.transform(suffixes, lambda h: F.transform(fitting, lambda n: F.concat(h, F.lit(" "), F.substring(F.col("path"), F.lit(1), n))))
    )
    return urls.filter(F.length("host") > 0).select("host", "path", F.explode(keys).alias("key"))


def judge(pages: DataFrame, entries: DataFrame, default: str = "allow", id_column: str = "page_id") -> DataFrame:
    """``id, host, path, rule, verdict`` for every row; URLs that no entry covers get ``default``."""
    listed = materialize(listing(entries))
    blocks_table, blocks = bloom_filter(listed.select("key"), listed.count())
    stored = materialize(blocks_table)
    # the lengths of listed paths: at most as many as a URL has characters
    lengths = sorted(r[0] for r in listed.select((F.length("rule") - F.col("n_host")).alias("n")).distinct().collect())
    rows = pages.select(F.col(id_column), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = rows.select("host", "path").distinct()
    probes = prefixes(urls, lengths or [0]).withColumn("block", _block(F.col("key"), blocks))
    hit = None
    for k, bit in enumerate(_bits("key")):
        found = F.col(f"w{k}").bitwiseAND(bit) != 0
        hit = found if hit is None else hit & found
    possible = probes.join(stored, "block").filter(hit).select("host", "path", "key")
    longest = F.max(F.struct(F.length("rule").alias("n"), "n_host", "rule", "verdict")).alias("best")
    verdicts = (
        possible.join(listed, "key").groupBy("host", "path").agg(longest)
        .select(F.col("host").alias("_host"), F.col("path").alias("_path"), "best.rule", "best.verdict")
    )
    return rows.join(verdicts, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left").select(
        id_column, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
