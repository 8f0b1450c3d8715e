"""MinHash near-duplicates: an inverted join of signature coordinates, confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronotext.llm.common import binaries, join_small, lists, slices, texts
from chronotext.llm.components import connected_components
from chronotext.llm.hashing import inside, mix, runs, sequences, word_hashes, word_places
from chronotext.session import materialize

WORDS = 5
#: Linked are sets with 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Coordinates that are posted, and of the longer sketch, a byte each, that lists of many members compare.
COORDINATES, SKETCH = 40, 768
#: Members of a list that one task compares with as many others.
LIST_ROWS = 4096
_RANDOM = np.random.default_rng(7)
_FACTORS = _RANDOM.integers(0, 2**63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 2**63, SKETCH, dtype=np.uint64)
_SALTS = mix(np.arange(1, SKETCH + 1, dtype=np.uint64))


def least_matches(coordinates: int, percent: int) -> int:
    """How many coordinates a linked pair shares but for a chance of about 1 in 50,000 at the threshold.

    A pair shares each with the chance of its similarity; this is 4.1 standard deviations below.
    """
    share = percent / 100
    return max(1, int(coordinates * share - 4.1 * (coordinates * share * (1 - share)) ** 0.5))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, bounds): the sorted distinct k-word shingles of each text, A-Z as a-z.

    A text of fewer words is one shingle of all of them; a text without words has none.
    """
    starts, ends, first = word_places(data, offsets)
    words = word_hashes(data, starts, ends, lower=True)
    n = np.diff(first)
    whole = sequences(words, k)[inside(first, k)]
    short = np.flatnonzero((n > 0) & (n < k))
    sizes = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    shingles = np.empty(bounds[-1], np.uint64)
    is_short = np.zeros(bounds[-1], bool)
    is_short[bounds[short]] = True
    shingles[is_short] = runs(words, first[short], first[short + 1])
    shingles[~is_short] = whole
    for low, high in zip(bounds[:-1], bounds[1:]):
        shingles[low:high].sort()
    keep = np.ones(len(shingles), bool)
    keep[1:] = shingles[1:] != shingles[:-1]
    keep[bounds[:-1][sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return shingles[keep], kept[bounds]


def signatures(shingles: np.ndarray, bounds: np.ndarray, coordinates: int = COORDINATES, kind=np.uint64) -> np.ndarray:
    """Coordinates of each non-empty set: least values, scattered so that a number names its coordinate too."""
    out = np.empty((len(bounds) - 1, coordinates), kind)
    if len(out):
        for c in range(coordinates):
            values = np.minimum.reduceat(shingles * _FACTORS[c] + _SHIFTS[c], bounds[:-1])
            out[:, c] = mix(values ^ _SALTS[c]).astype(kind)
    return out


def _sums(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two sums over each set, which tell it from others, in any order; 0 for an empty one."""
    some = np.diff(bounds) > 0
    sums = np.zeros((2, len(some)), np.uint64)
    if some.any():
        for i, salt in enumerate((0, 0x5851F42D4C957F2D)):
            sums[i, some] = np.add.reduceat(mix(shingles ^ np.uint64(salt)), bounds[:-1][some])
    return sums


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in slices(batch.column(1)):
            shingles, bounds = shingle_sets(data, offsets)
            n = np.diff(bounds)
            some = n > 0
            edges = np.concatenate([bounds[:-1][some], bounds[-1:]])
            sums = _sums(shingles, bounds)
            signed = signatures(shingles, edges)
            places = np.concatenate([[0], np.cumsum(some)]) * COORDINATES
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(low, high - low),
                    pa.array(n),
                    *[pa.array(s.view(np.int64)) for s in sums],
                    lists(signed.reshape(-1).view(np.int64), places),
                ],
                ["doc_id", "n_shingles", "sum1", "sum2", "signature"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in slices(batch.column(1)):
            shingles, bounds = shingle_sets(data, offsets)
            n, sums = np.diff(bounds), _sums(shingles, bounds)
            some = n > 0
            bounds = np.append(bounds[:-1][some], bounds[-1])
            sketch = signatures(shingles, bounds, SKETCH, np.uint8)
            rows = binaries(sketch.reshape(-1), np.arange(len(bounds)) * SKETCH)
            yield pa.RecordBatch.from_arrays(
                [pa.array(n[some]), *[pa.array(s[some].view(np.int64)) for s in sums], binaries(shingles, bounds), rows],
                ["n_shingles", "sum1", "sum2", "shingles", "sketch"],
            )


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach ``percent`` of their union."""
    place = np.searchsorted(b, a)
    shared = int((b[np.minimum(place, len(b) - 1)] == a).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _compare(percent: int):
    def run(group: pa.Table) -> pa.Table:
        """Links (a, b) between a list's members (left: apart from its hub, right: all) that join their components.

        Skipped are members of one component, also of one that links found here have made, sizes too
        different, and pairs that a list of a smaller token they share gives already. Sketches choose
        the pairs whose full sets are compared. So a group gives fewer rows than it has members.
        """
        ids, parts, sizes = (group[c].to_numpy() for c in ("id", "part", "n_shingles"))
        is_left, is_right, apart = (group[c].to_numpy(zero_copy_only=False) for c in ("is_left", "is_right", "apart"))
        sketch = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH)
        token, prefixes, least = group["token"][0].as_py(), group["prefix"].to_pylist(), least_matches(SKETCH, percent)
        sets, right = group["shingles"], np.flatnonzero(is_right)
        part = np.unique(parts, return_inverse=True)[1]
        found_a, found_b = [], []
        for x in np.flatnonzero(is_left):
            small, large = np.minimum(sizes[x], sizes[right]), np.maximum(sizes[x], sizes[right])
            y = right[(part[right] != part[x]) & (100 * small >= percent * large) & ~(apart[right] & (ids[right] <= ids[x]))]
            y = y[(sketch[y] == sketch[x]).sum(1) >= least]
            own = set(prefixes[x]) if len(y) else None
            mine = np.frombuffer(sets[int(x)].as_buffer(), np.uint64) if len(y) else None
            for i in y:
                if part[i] != part[x] and min(own.intersection(prefixes[i])) == token:
                    if _linked(mine, np.frombuffer(sets[int(i)].as_buffer(), np.uint64), percent):
                        part[part == part[i]] = part[x]
                        found_a.append(ids[x])
                        found_b.append(ids[i])
        a, b = np.array(found_a, np.int64), np.array(found_b, np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(batch.column(2), batch.column(3))
            keep = [_linked(*(np.frombuffer(x.as_buffer(), np.uint64) for x in both), percent) for both in sets]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text) with an id.

    Documents whose sets of 5-word shingles reach ``percent`` of their union are linked;
    ``component_id`` is the smallest doc_id that links lead to. Works in these steps:

    1. One scan gives each document its set's size, two sums over the set and its signature. Documents
       with equal sets are one class from here on, whatever their number.
    2. Each class is posted under its coordinate-value pairs. A pair that only one class has joins
       nothing. As a match shares ``least_matches`` coordinates, a class with fewer shared ones drops out,
       and of the others only the prefix is posted, all but the most frequent ones by that number less one;
       what a passage in many documents makes frequent is left out first.
    3. In each posting list the smallest class is the hub, and all others are paired with it. Pairs are
       kept if enough coordinates collide, then confirmed on the full sets.
    4. Classes that are now connected need not be compared with each other. Of each list, those
       that are not connected with its hub are compared with all members of other components, in
       blocks of bounded size, by a longer sketch; the pairs that reach its threshold are confirmed there
       on the full sets, and a link makes one component of two, whose members are not compared any more.

    Lists of copies thus give one pair per member, and a block gives fewer links than it has members.

    Null, empty and wordless texts have 0 shingles, their own component, and no link. Repeated rows
    give one row each; rows of one id with different texts are judged each by its own text. Rows with a null id are left out; other columns are not read.
    """
    docs = texts(docs)
    signed = materialize(docs.mapInArrow(_sign, "doc_id long, n_shingles long, sum1 long, sum2 long, signature array<long>"))
    key = ["n_shingles", "sum1", "sum2"]
    class_id = F.xxhash64(*key).alias("id")
    classes = materialize(signed.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("least")).select("*", class_id))
    ids = classes.select(F.col("least").alias("doc_id"))
    first = signed.join(ids, "doc_id", "left_semi").where("n_shingles > 0")
    # Rows of one class have equal signatures, so it does not matter which is taken.
    first = materialize(first.groupBy(class_id).agg(F.max(F.struct("n_shingles", "signature")).alias("s")).select("id", "s.*"))
    tokens = first.select("id", F.explode("signature").alias("token"))
    frequent = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    listed = tokens.join(frequent, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "token")))["token"].alias("tokens"))
    matches = least_matches(COORDINATES, percent)
    prefix = F.slice("tokens", F.lit(1), F.size("tokens") - F.lit(matches - 1))
    prefixes = materialize(listed.where(F.size("tokens") >= matches).select("id", prefix.alias("prefix")))
    posts = prefixes.select("id", F.explode("prefix").alias("token"))
    members = materialize(classes.join(prefixes, "id", "left_semi").select(F.col("least").alias("doc_id")))
    sets = join_small(docs, members, "doc_id", "left_semi").mapInArrow(_sets, "n_shingles long, sum1 long, sum2 long, shingles binary, sketch binary")
    # A repeated id brings other texts along; of those with one set any will do.
    sets = materialize(sets.select(class_id, "shingles", "sketch")).dropDuplicates(["id"])
    hubs = posts.groupBy("token").agg(F.min("id").alias("a"))
    pairs = posts.join(hubs, "token").where(F.col("a") < F.col("id")).select("a", F.col("id").alias("b")).distinct()
    links = materialize(_verify(pairs, first, sets, percent))
    roots = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    joined = posts.join(roots, F.col("id") == F.col("node"), "left").select("token", "id", F.coalesce("component", "id").alias("part"))
    joined = materialize(joined)
    hub = F.min(F.struct("id", "part"))
    split = joined.groupBy("token").agg(hub.alias("hub"), F.count(F.lit(1)).alias("n"), F.min("part").alias("low"), F.max("part").alias("high"))
    blocks = F.ceil(F.col("n") / LIST_ROWS).cast("int")
    split = materialize(split.where(F.col("low") < F.col("high")).select("token", F.col("hub.id").alias("hub"), F.col("hub.part").alias("hub_part"), blocks.alias("blocks")))
    facts = prefixes.join(first.select("id", "n_shingles"), "id").join(sets, "id")
    open_ = joined.join(split, "token").where(F.col("id") != F.col("hub")).withColumn("apart", F.col("part") != F.col("hub_part"))
    own, every = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    columns = ["token", "id", "part", "apart"]
    # A member is a row of its own block once, whichever sides it is on, and of the other blocks of its row and column.
    right = open_.select(*columns, own.alias("j"), every.alias("i")).select(*columns, "i", "j", (F.col("apart") & (F.col("i") == F.col("j"))).alias("is_left"), F.lit(True).alias("is_right"))
    left = open_.where("apart").select(*columns, own.alias("i"), every.alias("j")).where("i != j").select(*columns, "i", "j", F.lit(True).alias("is_left"), F.lit(False).alias("is_right"))
    dealt = left.unionByName(right).join(facts, "id")
    more = materialize(dealt.groupBy("token", "i", "j").applyInArrow(_compare(percent), "a long, b long").distinct())
    roots = connected_components(links.unionByName(more).select(F.col("a").alias("u"), F.col("b").alias("v")))
    classes = materialize(classes.join(roots, F.col("id") == F.col("node"), "left").select(*key, "least", F.coalesce("component", "id").alias("part")))
    lows = classes.groupBy("part").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    classes = materialize(join_small(classes, materialize(lows), "part", "left").select(*key, F.coalesce("component", "least").alias("component")))
    out = signed.select("doc_id", *key).join(classes, key, "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def _verify(pairs: DataFrame, first: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold; only those with enough collisions are tried."""
    side = lambda name: first.select(
        F.col("id").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("signature").alias(f"s_{name}")
    )
    tried = pairs.join(side("a"), "a").join(side("b"), "b")
    alike = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (F.size(F.array_intersect("s_a", "s_b")) >= least_matches(COORDINATES, percent))
    return _confirmed(materialize(tried.where(alike).select("a", "b")), sets, percent)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    full = full.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return full.select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long")
