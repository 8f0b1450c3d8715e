"""Phrase collocations by stripes: each prefix keys an associative counter of the words after it.

Stripes of longer prefixes are counted level by level. A phrase can only be frequent if the phrases
without its first and without its last word are, so a task counts a word after a prefix only where
both of these pass a filter of the frequent phrases of the level before; everything else after
that prefix is counted together as ``REST``. So a merged stripe holds all frequent extensions of its
prefix, its sum is the number of times the prefix occurs, and its largest counter says whether an
extension subsumes the prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from chronotext.llm.common import join_small, small_batches
from chronotext.llm.hashing import mix
from chronotext.session import materialize

LONGEST, LEAST, TOP = 5, 100, 2000
#: Counts a stripe's words other than those that can begin a frequent phrase, and ends of pieces. No word is empty.
REST = ""
#: Bytes of text that a task counts at once; a longer piece is counted alone.
CHUNK_BYTES = 8 << 20
#: Bits of the filter for each frequent phrase, and the most bytes it takes. Beyond them it lets more through, which
#: only costs time: what it lets through is counted exactly.
FILTER_BITS, FILTER_BYTES = 16, 32 << 20
#: A prefix with this share of all words or more, which at most so many prefixes can have, is cut into parts by its next words.
HEAVY, PARTS = 1024, 64

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\v\f\r"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_STRIPE = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("part", pa.int32()),
                     ("next", pa.list_(pa.string())), ("count", pa.list_(pa.int64()))])
_STRIPE_DDL = "lang string, prefix string, part int, next array<string>, count array<long>"


# --- in the tasks ------------------------------------------------------------------------------


def chunks(data: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[np.ndarray]:
    """``data`` cut between pieces, each part of about ``limit`` bytes or one piece."""
    low = 0
    while low < len(data):
        high = min(len(data), low + limit)
        if high < len(data):
            ends = np.flatnonzero(_KIND[data[low:high]] == 2)
            if len(ends):
                high = low + int(ends[-1]) + 1
            else:
                ends = np.flatnonzero(_KIND[data[high:]] == 2)
                high = high + int(ends[0]) + 1 if len(ends) else len(data)
        yield data[low:high]
        low = high


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(words, pieces, vocabulary): the number of each word and of its piece, and the texts of the words."""
    data = _LOWER[data]
    kind = _KIND[data]
    inside = kind == 0
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    finish[:-1] &= ~inside[1:]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    pieces = np.cumsum(kind == 2, dtype=np.int32)[starts]
    bounds = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=bounds[1:])
    texts = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])])
    coded = texts.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), pieces, coded.dictionary


def _salt(lang: str | None) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest("\n" if lang is None else lang, seed=5))


def _word_numbers(vocabulary: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in vocabulary.to_pylist()), np.uint64, len(vocabulary))


def _extend(hashes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The number of a phrase that goes on with a word, from those of both."""
    return mix(hashes * np.uint64(0x9E3779B97F4A7C15) + numbers)


def _phrase_number(lang: str | None, phrase: str) -> int:
    out = np.array([_salt(lang)])
    for word in phrase.split(" "):
        out = _extend(out, np.array([xxhash.xxh64_intdigest(word)], np.uint64))
    return int(out[0])


def _bits(numbers: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each number in a filter of ``size`` bits, a power of two."""
    last = np.uint64(size - 1)
    return (numbers & last).astype(np.int64), (numbers >> np.uint64(32) & last).astype(np.int64)


def _passes(numbers: np.ndarray, field: np.ndarray) -> np.ndarray:
    out = np.ones(len(numbers), bool)
    for at in _bits(numbers, len(field) * 8):
        out &= (field[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return out


def _runs_of(words: np.ndarray, pieces: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Which places have ``k`` words in their piece."""
    out = at + k <= len(words)
    out[out] = pieces[at[out]] == pieces[at[out] + k - 1]
    return out


def stripes(lang: str | None, data: np.ndarray, k: int, field: np.ndarray | None, heavy: frozenset[int]) -> pa.RecordBatch | None:
    """The stripes of all prefixes of ``k`` words in some text, with the frequent phrases of ``k`` words in ``field``."""
    words, pieces, vocabulary = words_of(data)
    if not len(words):
        return None
    size, numbers = len(vocabulary), _word_numbers(vocabulary)
    if k == 0:
        prefix, follow, first, of = np.zeros(len(words), np.int64), words, np.zeros(1, np.int64), np.full(len(words), _salt(lang))
    else:
        hashes = np.full(len(words), _salt(lang))
        for j in range(k):
            hashes = _extend(hashes[: len(words) - j], numbers[words[j:]])
        at = np.arange(len(hashes))
        at = at[_runs_of(words, pieces, at, k)]
        alive = np.zeros(len(words) + 1, bool)
        alive[at] = _passes(hashes[at], field)
        at = np.flatnonzero(alive)
        if not len(at):
            return None
        # Exact numbers of the prefixes: pairs of numbers are counted out, never hashed.
        prefix = words[at]
        for j in range(1, k):
            prefix = pd.factorize(prefix * size + words[at + j])[0]
        if k == 1:
            prefix = pd.factorize(prefix)[0]
        first = at[np.unique(prefix, return_index=True)[1]]
        goes_on = _runs_of(words, pieces, at, k + 1) & alive[at + 1]
        follow = np.where(goes_on, words[np.minimum(at + k, len(words) - 1)], size)
        of = hashes[at]
    part = np.zeros(len(prefix), np.int64)
    if k == 0 or heavy:
        cut = np.ones(len(prefix), bool) if k == 0 else np.isin(of, np.fromiter(heavy, np.uint64, len(heavy)))
        part[cut] = (np.append(numbers, np.uint64(0))[follow[cut]] >> np.uint64(40)).astype(np.int64) % PARTS
    stripe, cells = pd.factorize(((prefix * PARTS + part) * (size + 1)) + follow)
    count = np.bincount(stripe, minlength=len(cells))
    order = np.argsort(cells)
    cells, count = cells[order], count[order]
    key, follow = cells // (size + 1), cells % (size + 1)
    edges = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)).astype(np.int32)
    key = key[edges[:-1]]
    names = [vocabulary.take(pa.array(words[first[key // PARTS] + j])) for j in range(k)]
    prefixes = pc.binary_join_element_wise(*names, " ") if k else pa.array([""] * len(key), pa.string())
    follows = pa.concat_arrays([vocabulary, pa.array([REST])]).take(pa.array(follow))
    return pa.record_batch(
        [pa.array([lang] * len(key), pa.string()), prefixes, pa.array((key % PARTS).astype(np.int32)),
         pa.ListArray.from_arrays(pa.array(edges), follows), pa.ListArray.from_arrays(pa.array(edges), pa.array(count.astype(np.int64)))],
        schema=_STRIPE,
    )


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, np.ndarray]]:
    """Texts of one language, joined by line breaks, which end pieces as the ends of texts do."""
    held: dict[str | None, list[bytes]] = {}
    size: dict[str | None, int] = {}

    def take(lang):
        size.pop(lang)
        return lang, np.frombuffer(b"\n".join(held.pop(lang)), np.uint8)

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()):
            if text:
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text)
                if size[lang] >= CHUNK_BYTES:
                    yield take(lang)
        if sum(size.values()) >= 4 * CHUNK_BYTES:
            for lang in list(held):
                yield take(lang)
    for lang in list(held):
        yield take(lang)


# --- over all tasks ----------------------------------------------------------------------------


def merged_stripes(docs: DataFrame, k: int, least: int, field: np.ndarray | None, heavy: frozenset[int]) -> DataFrame:
    """(lang, prefix, part, next, n): the merged stripes of prefixes of ``k`` words, counters below ``least`` in ``REST``.

    Stripes are dealt by prefix, and the cells of those that meet are added up where they are: one
    shuffle, which carries a prefix once for all its words. No stripe is ever in memory as a whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast((field, heavy))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, heavy = shared.value
        for lang, data in _by_lang(batches):
            for part in chunks(data):
                found = stripes(lang, part, k, field, heavy)
                if found is not None:
                    yield found

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.mapInArrow(run, _STRIPE_DDL).repartition(tasks, "lang", "prefix", "part")
    cells = dealt.select("lang", "prefix", "part", F.inline(F.arrays_zip("next", "count")))
    merged = cells.groupBy("lang", "prefix", "part", "next").agg(F.sum("count").alias("n"))
    counted = F.when(F.col("n") >= least, F.col("next")).otherwise(REST)
    return merged.groupBy("lang", "prefix", "part", counted.alias("next")).agg(F.sum("n").alias("n"))


def phrase_filter(frequent: DataFrame) -> tuple[np.ndarray, frozenset[int]]:
    """Of materialised (lang, phrase, n): the filter of the phrases, and the numbers of those that are heavy.

    The filter is put together from pieces of 4 KB, its size is bounded. At most ``HEAVY`` phrases
    are heavy, those with that share of all occurrences in ``frequent``.
    """
    total, occurrences = frequent.agg(F.count(F.lit(1)), F.sum("n")).first()
    bits = min(FILTER_BYTES * 8, 1 << max(15, (total * FILTER_BITS).bit_length()))

    @F.pandas_udf("struct<a:long,b:long,number:long>")
    def places(lang: pd.Series, phrase: pd.Series) -> pd.DataFrame:
        numbers = np.array([_phrase_number(x, p) for x, p in zip(lang, phrase)], np.uint64).reshape(-1)
        a, b = _bits(numbers, bits)
        return pd.DataFrame({"a": a, "b": b, "number": numbers.view(np.int64)})

    # Spark counts the places of a bitmap from 1.
    at = frequent.select(places("lang", "phrase").alias("at")).select(F.explode(F.array(F.col("at.a") + 1, F.col("at.b") + 1)).alias("at"))
    pieces = at.groupBy(F.expr("bitmap_bucket_number(at)").alias("piece")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits"))
    field = np.zeros(bits // 8, np.uint8)
    for row in pieces.collect():
        low = (row["piece"] - 1) * 4096
        field[low : low + 4096] = np.frombuffer(bytes(row["bits"]), np.uint8)
    heavy = frequent.where(F.col("n") * HEAVY >= F.lit(occurrences or 0)).select(places("lang", "phrase")["number"].alias("x"))
    return field, frozenset(int(r["x"]) & (1 << 64) - 1 for r in heavy.collect())


def count_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(extensions, prefixes): what the merged stripes of ``docs`` (lang, text) hold.

    ``extensions`` (lang, words, prefix, next, phrase, n) are the phrases of 1 to ``longest`` words that
    occur ``least`` times or more. ``prefixes`` (lang, prefix, total, most) are the empty prefix, whose
    total is the number of words, and all of them with fewer words: how often a prefix occurs, and
    the largest counter of its stripe. Every level is written to the shared folder.
    """
    docs = small_batches(docs).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    levels, prefixes = [], []
    field, heavy = None, frozenset()
    for k in range(longest):
        cells = materialize(merged_stripes(docs, k, least, field, heavy))
        phrase = F.concat_ws(" ", F.when(F.col("prefix") != "", F.col("prefix")), "next")
        found = cells.where(F.col("next") != REST).select("lang", F.lit(k + 1).alias("words"), "prefix", "next", phrase.alias("phrase"), "n")
        most = F.max(F.when(F.col("next") != REST, F.col("n")))
        sums = cells.groupBy("lang", "prefix").agg(F.sum("n").alias("total"), most.alias("most"))
        prefixes.append(sums.where((F.col("total") >= least) | (F.col("prefix") == "")))
        levels.append(found)
        if k < longest - 1:
            field, heavy = phrase_filter(found)
    return _union(levels), _union(prefixes)


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    Of ``docs``, any table with ``lang`` and ``text``, every whole text counts, with or without an id and
    also when rows repeat. A null language is ``und``, a null text an empty one. A phrase has 2 to
    ``longest`` words and occurs ``a >= least`` times; ``l`` and ``r`` are the occurrences of its parts
    at the cut with the least score floor(1000 a n / (l r)), of equal ones the first. Phrases inside
    a longer one that occurs as often are left out. Ties go by ``a`` and then by the phrase's bytes.
    """
    found, prefixes = count_phrases(docs, longest, least)
    prefixes = materialize(prefixes)
    sizes = prefixes.where("prefix = ''").select("lang", F.col("total").alias("n"))
    totals = prefixes.where("prefix != ''")
    # What the phrase is without its first word: the largest phrase that goes on to the left.
    tail = F.array_join(F.slice(F.split("phrase", " "), 2, longest), " ")
    left = found.where("words > 2").groupBy("lang", tail.alias("phrase")).agg(F.max("n").alias("left_most"))
    right = totals.select("lang", F.col("prefix").alias("phrase"), F.col("most").alias("right_most"))
    phrases = found.where("words > 1").select("lang", "phrase", F.col("n").alias("a"))
    phrases = phrases.join(left, ["lang", "phrase"], "left").join(right, ["lang", "phrase"], "left")
    subsumed = F.coalesce(F.greatest("left_most", "right_most"), F.lit(0)) >= F.col("a")
    kept = materialize(phrases.where(~subsumed).select("lang", "phrase", "a"))
    parts = F.split("phrase", " ")
    cuts = kept.select("lang", "phrase", "a", parts.alias("w"), F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.expr("slice(w, 1, k)"), " ").alias("first"),
        F.array_join(F.expr("slice(w, k + 1, size(w))"), " ").alias("rest"),
    )
    cuts = join_small(cuts, totals.select("lang", F.col("prefix").alias("first"), F.col("total").alias("l")), ["lang", "first"])
    cuts = join_small(cuts, totals.select("lang", F.col("prefix").alias("rest"), F.col("total").alias("r")), ["lang", "rest"])
    cuts = join_small(cuts, sizes, "lang")
    # Counts below 10**17 multiply exactly in 38 digits; the score itself is at most 10 n.
    exact = {name: f"cast({name} as decimal(17, 0))" for name in "anlr"}
    score = F.expr(f"(cast(1000 as decimal(4, 0)) * {exact['a']} * {exact['n']}) div ({exact['l']} * {exact['r']})")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r", "n", "a")).alias("best")
    scored = cuts.groupBy("lang", "phrase").agg(best).select("lang", "phrase", "best.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
