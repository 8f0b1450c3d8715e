"""Substring dedup: passages that occur earlier, found in compressed FM-indexes, one per shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronotext.llm.common import join_small, slices, small_batches, texts, unused, with_text
from chronotext.llm.fmindex import FMIndex, repeated_windows
from chronotext.llm.hashing import inside, runs, sequences, word_hashes, word_places
from chronotext.session import materialize

#: Words of a window, and of the anchors that name its shard.
WINDOW, ANCHOR = 20, 8
#: Windows whose least anchor is the same, in a row, are one snippet of at most this many windows.
RUN = WINDOW - ANCHOR + 1
#: Snippets of a shard, about 256,000 words; an anchor with more different ones is cut into windows.
SHARD_SNIPPETS, HOT_SNIPPETS = 8192, 4096


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, by doubling."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    over = width - span
    return np.minimum(x[: len(x) - over], x[over:]) if over else x


def snippets(words: np.ndarray, first: np.ndarray):
    """(text, anchor, start, windows, digest, times) of the runs of windows with one least anchor.

    The anchor of a window is the least number of its 8-word sequences, so equal windows have equal
    anchors wherever they stand. ``start`` is the first word in the text, ``times`` how often the anchor
    stands in the run: only where it stands twice can two windows of one run be equal.
    """
    at = np.flatnonzero(inside(first, WINDOW))
    if not len(at):
        return (np.zeros(0, np.int64),) * 6
    named = sequences(words, ANCHOR)
    least = _least(named, RUN)[at]
    text = np.searchsorted(first, at, side="right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    # A sequence that repeats itself can be the least for long: such a run is cut.
    begins = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
    begins = np.flatnonzero(place % RUN == 0)
    windows = np.diff(np.append(begins, len(at)))
    low, anchor = at[begins], least[begins]
    times = np.zeros(len(low), np.int64)
    for step in range(2 * RUN - 1):
        covered = step < windows + RUN - 1
        times += covered & (named[np.where(covered, low + step, 0)] == anchor)
    return text[begins], anchor, low - first[text[begins]], windows, runs(words, low, low + windows + WINDOW - 1), times


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in slices(batch.column(1)):
            starts, ends, first = word_places(data, offsets)
            _, anchor, _, _, _, times = snippets(word_hashes(data, starts, ends), first)
            names, number = np.unique(anchor, return_inverse=True)
            counts = np.bincount(number, times, len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.uint64).view(np.int64)), pa.array(counts)], ["anchor", "n"])


def _snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in slices(batch.column(1)):
            starts, ends, first = word_places(data, offsets)
            text, anchor, start, windows, digest, times = snippets(word_hashes(data, starts, ends), first)
            ids = batch.column(0).slice(low, high - low).take(pa.array(text))
            columns = [anchor.astype(np.uint64).view(np.int64), digest.astype(np.uint64).view(np.int64), start.astype(np.int32), windows.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns), pa.array(times > 1)], ["doc_id", "anchor", "digest", "start", "windows", "twice"])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words, as numbers, of the snippets listed beside each text."""
    for batch in batches:
        for low, high, data, offsets in slices(batch.column(1)):
            starts, ends, first = word_places(data, offsets)
            words = word_hashes(data, starts, ends)
            listed = batch.column(2).slice(low, high - low)
            number = np.diff(listed.offsets.to_numpy())
            text = np.repeat(np.arange(high - low), number)
            anchor, start, windows = (listed.flatten().field(i).to_numpy() for i in range(3))
            hot = listed.flatten().field(3).to_numpy(zero_copy_only=False).astype(bool)
            # A snippet of a hot anchor becomes its single windows.
            copies = np.where(hot, windows, 1)
            row = np.repeat(np.arange(len(text)), copies)
            step = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
            text, anchor, hot = text[row], anchor[row], hot[row]
            start = start[row].astype(np.int64) + step
            length = np.where(hot, WINDOW, windows[row] + WINDOW - 1)
            begin = first[text] + start
            digest = runs(words, begin, begin + length).view(np.int64)
            place = np.concatenate([[0], np.cumsum(length)])
            flat = np.repeat(begin - place[:-1], length) + np.arange(place[-1])
            content = pa.Array.from_buffers(
                pa.binary(), len(row), [None, pa.py_buffer((place * 8).astype(np.int32).tobytes()), pa.py_buffer(words[flat].tobytes())]
            )
            ids = batch.column(0).slice(low, high - low).take(pa.array(text))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(anchor), pa.array(digest), pa.array(start.astype(np.int32)), pa.array(hot), content],
                ["doc_id", "anchor", "digest", "start", "hot", "content"],
            )


def _search(group: pa.Table) -> pa.Table:
    """Spans (doc_id, start, words) of a shard's windows that occur in it earlier."""
    group = group.sort_by([("doc_id", "ascending"), ("start", "ascending")])
    contents = group["content"].to_pylist()
    lengths = np.array([len(c) // 8 for c in contents])
    ids, starts = group["doc_id"].to_numpy(), group["start"].to_numpy()
    numbers = np.unique(np.frombuffer(b"".join(contents), np.uint64), return_inverse=True)[1] + 1
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    joined = np.zeros(begins[-1], np.int64)
    inner = np.ones(len(joined), bool)
    inner[begins[1:] - 1] = False
    joined[inner] = numbers
    windows = lengths - WINDOW + 1
    owner = np.repeat(np.arange(len(lengths)), windows)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    ends = begins[owner] + step + WINDOW
    found, interval = repeated_windows(FMIndex(joined, WINDOW), joined, ends, WINDOW)
    # Windows stand in the order of documents and places: the first of an interval is the earliest.
    earliest = np.zeros(len(found), bool)
    earliest[np.unique(interval, return_index=True)[1]] = True
    late = found[~earliest]
    owner, step = owner[late], step[late]
    new = np.ones(len(late), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (step[1:] != step[:-1] + 1)
    at = np.flatnonzero(new)
    number = np.diff(np.append(at, len(late)))
    return pa.table(
        {"doc_id": pa.array(ids[owner[at]], pa.int64()), "start": (starts[owner[at]] + step[at]).astype(np.int32), "words": (number + WINDOW - 1).astype(np.int32)}
    )


def merged(coded: np.ndarray) -> np.ndarray:
    """Spans, coded as start << 32 | words, as few (start, end) rows."""
    coded = np.sort(coded)
    start = coded >> 32
    reach = np.maximum.accumulate(start + (coded & 0xFFFFFFFF))
    new = np.ones(len(coded), bool)
    new[1:] = start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return np.stack([start[at], reach[np.append(at[1:], len(coded)) - 1]], 1)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [merged(np.asarray(x.values)).astype(np.int32).tobytes() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.binary())], ["doc_id", "spans"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): the words to remove of each text, as pairs of 32-bit numbers (start, end)."""
    docs = texts(docs)
    anchors = docs.mapInArrow(_anchors, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    anchors = materialize(anchors.where("n > 1").select("anchor"))
    found = docs.mapInArrow(_snippets, "doc_id long, anchor long, digest long, start int, windows int, twice boolean")
    found = materialize(join_small(found, anchors, "anchor", "left_semi"))
    # Equal snippets are all but the first removed whole; the first goes on.
    place = F.struct("doc_id", "start", "windows", "twice")
    once = found.groupBy("anchor", "digest").agg(F.min(place).alias("p")).select("anchor", "digest", "p.*")
    once = materialize(once)
    again = found.join(once.select("doc_id", "start"), ["doc_id", "start"], "left_anti")
    spans = again.select("doc_id", "start", (F.col("windows") + (WINDOW - 1)).alias("words"))
    kinds = once.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.bool_or("twice").alias("twice"))
    kinds = materialize(kinds.where("kinds > 1 or twice"))
    open_ = join_small(once, kinds.select("anchor", (F.col("kinds") > HOT_SNIPPETS).alias("hot")), "anchor")
    listed = materialize(open_.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "start", "windows", "hot")).alias("listed")))
    contents = join_small(docs, listed, "doc_id").select("doc_id", "text", "listed")
    contents = contents.mapInArrow(_contents, "doc_id long, anchor long, digest long, start int, hot boolean, content binary")
    contents = materialize(contents)
    plain = contents.where("not hot").drop("hot")
    windows = contents.where("hot")
    firsts = windows.groupBy("anchor", "digest").agg(F.min(F.struct("doc_id", "start", "content")).alias("p")).select("p.*", "anchor", "digest")
    later = windows.join(firsts.select("doc_id", "start"), ["doc_id", "start"], "left_anti")
    shards = max(1, -(-contents.count() // SHARD_SNIPPETS))
    shard = lambda *key: F.pmod(F.xxhash64(*key), F.lit(shards)).cast("int").alias("shard")
    fields = ["doc_id", "start", "content"]
    members = plain.select(shard("anchor"), *fields).unionByName(firsts.select(shard("anchor", "digest"), *fields))
    searched = members.groupBy("shard").applyInArrow(_search, "doc_id long, start int, words int")
    late = later.select("doc_id", "start", F.lit(WINDOW).alias("words"))
    coded = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("words").cast("long"))
    all_ = spans.unionByName(searched).unionByName(late).groupBy("doc_id").agg(F.collect_list(coded).alias("coded"))
    return all_.mapInArrow(_merge, "doc_id long, spans binary")


def kept_words(text: str, spans: bytes | None) -> tuple[int, list[bytes]]:
    """The number of words of a text, and the words outside the spans."""
    words = text.encode("utf-8", "surrogatepass").split()
    total = len(words)
    if spans:
        kept, at = [], 0
        for start, end in np.frombuffer(spans, np.int32).reshape(-1, 2).tolist():
            kept += words[at:start]
            at = end
        words = kept + words[at:]
    return total, words


def _report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, text, spans in zip(batch["doc_id"], batch["text"], batch["spans"]):
            total, words = kept_words(text, spans)
            rows.append((doc_id, total, total - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
        yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words of the spans in the last column, which goes."""
    for batch in batches:
        last = batch.num_columns - 1
        spans, batch = batch.column(last).to_pylist(), batch.select(list(range(last)))
        texts_ = batch.column("text").to_pylist()
        yield with_text(batch, [t if s is None or t is None else b" ".join(kept_words(t, s)[1]).decode() for t, s in zip(texts_, spans)])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of ``docs`` (doc_id, text) with an id.

    A word is removed if a window of 20 words that covers it also starts earlier: in a smaller
    doc_id, or before in the same text. Windows are judged on the input.

    1. Each window is named by its least 8-word sequence, its anchor, so equal windows meet.
       Anchors that stand once in the corpus are dropped; they are counted, not collected.
    2. Windows in a row with one anchor form a snippet. Of equal snippets all but the first are
       removed, by an aggregation that a passage in a third of the documents does not slow.
    3. The first ones of anchors with several different snippets, or with one that holds it twice, are dealt into shards by anchor; an
       anchor with more than HOT_SNIPPETS is cut into windows, reduced once more, and dealt by window.
    4. Each shard builds an FM-index of its snippets over a wavelet tree, streams them through it
       by backward search and reports the windows whose matching statistic reaches 20 words and
       that an earlier one equals.

    Each document is compared with the shards of its own anchors only, so the work grows with the
    text. Null and empty texts have no words. Two rows with one doc_id are expected not to occur; spans
    of both are applied to each. Rows with a null id are left out, other columns are not read.
    """
    spans = materialize(repeated_spans(docs))
    joined = join_small(texts(docs), spans, "doc_id", "left").select("doc_id", "text", "spans")
    return joined.mapInPandas(_report, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeated(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated words; texts that lose none, all rows and other columns stay as they are."""
    name = unused("_spans", docs.columns)
    spans = materialize(repeated_spans(docs)).withColumnRenamed("spans", name)
    joined = join_small(docs, spans, "doc_id", "left").select(*docs.columns, name)
    return small_batches(joined).mapInArrow(_cut, docs.schema)
