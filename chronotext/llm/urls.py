"""URL filter: a blocked Bloom filter before an exact hash join with the listed URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chronotext.session import fits_broadcast, materialize

#: Words of 64 bits in a block; each key sets BITS bits in each word of one block.
WORDS, BITS = 4, 2
BITS_PER_KEY = 32
#: A filter of 2**20 blocks takes 32 MB. Longer lists share them: more false hits, the same result.
MAX_BLOCKS = 1 << 20


def host(url: Column | str) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column | str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*(/[^?#]*)", 1)


def _after_scheme(url):
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _bits(key: Column) -> list[Column]:
    """The bits that a key sets in each word of its block."""
    h = F.xxhash64(key, F.lit("bits"))
    words = []
    for w in range(WORDS):
        word = F.lit(0).cast("long")
        for b in range(BITS):
            place = F.shiftrightunsigned(h, 6 * (w * BITS + b)).bitwiseAND(F.lit(63)).cast("int")
            word = word.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
        words.append(word)
    return words


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def bloom_blocks(keys: DataFrame, column: str) -> tuple[DataFrame, int]:
    """A blocked Bloom filter as a table (block, w0 ... w3), and the number of blocks.

    It has at most MAX_BLOCKS rows, whatever the number of keys.
    """
    blocks = 1
    n = keys.count()
    while blocks < MAX_BLOCKS and blocks * 64 * WORDS < n * BITS_PER_KEY:
        blocks *= 2
    named = keys.select(_block(F.col(column), blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col(column)))])
    return named.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), blocks


def filter_urls(pages: DataFrame, listed: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url).

    ``listed`` has (host, path, verdict): it fits its host and all subdomains where the page's
    path begins with its own. The longest host + path wins, among equals the longer host, and of a
    rule listed twice ``block``. Pages that nothing fits get ``default`` and a null rule.

    Each page looks up every ending of its host at a dot with every beginning of its path whose
    length occurs in the list. The Bloom filter, broadcast because its size is bounded, keeps the
    keys that can be listed; the exact join drops the false hits. The list is broadcast if its
    measured size allows; beyond that the join is shuffled and hot keys are split at run time. The
    hits of a page are reduced in the task that found them.

    Null urls and urls without ``://`` have an empty host and path and get the default, and so does every
    page if the list is empty; listed rows with a null host or path count for nothing. Repeated
    pages give one row each. Other columns are not read.
    """
    rules = listed.where(F.col("host").isNotNull() & F.col("path").isNotNull()).select(
        F.concat("host", "path").alias("rule"), "host", "path", "verdict"
    )
    rules = rules.groupBy("rule", "host").agg(F.max(F.struct((F.col("verdict") == "block").alias("b"), "verdict"))["verdict"].alias("verdict"), F.length(F.first("path")).alias("n"))
    rules = materialize(rules.withColumn("key", F.concat(F.length("host").cast("string"), F.lit(":"), "rule")))
    lengths = [r[0] for r in rules.select("n").distinct().orderBy("n").collect()]  # no more than a url has characters
    blocks, n = bloom_blocks(rules, "key")
    rows = pages.select("page_id", host("url").alias("host"), path("url").alias("path")).withColumn("row", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    known = F.array(*[F.lit(x) for x in lengths]) if lengths else F.expr("cast(array() as array<int>)")
    beginnings = F.transform(F.filter(known, lambda x: x <= F.length("path")), lambda x: F.substring(F.col("path"), F.lit(1), x))
    keys = F.flatten(F.transform(endings, lambda e: F.transform(beginnings, lambda b: F.concat(F.length(e).cast("string"), F.lit(":"), e, b))))
    probes = rows.select("row", "page_id", "host", "path", F.posexplode_outer(keys).alias("place", "key"))
    probes = probes.withColumn("block", _block(F.col("key"), n))
    seen = probes.join(F.broadcast(blocks), "block", "left")
    hit = F.lit(True)
    for i, bits in enumerate(_bits(F.col("key"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(bits) == bits)
    hit = F.coalesce(hit, F.lit(False))
    # Each page keeps its first key, so that it stays in the result without a hit.
    possible = seen.select("row", "page_id", "host", "path", F.when(hit, F.col("key")).alias("key"), "place").where(
        F.col("key").isNotNull() | (F.coalesce("place", F.lit(0)) == 0)
    )
    exact = rules.select("key", "rule", F.col("verdict").alias("said"), F.length("host").alias("host_length"))
    found = possible.join(F.broadcast(exact) if fits_broadcast(exact) else exact, "key", "left")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "host_length", "rule", "said")))
    judged = found.groupBy("row").agg(*[F.first(c).alias(c) for c in ("page_id", "host", "path")], best.alias("best"))
    return judged.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.said", F.lit(default)).alias("verdict")
    )
