"""Documents counted in blocks of bounded size, whose words are looked up once for each block.

A word of a large corpus is in most documents of a block, so the pairs of a block and one of its words are
far fewer than those of a document and one of its words, and no word is asked for more often than there are
blocks. What a lookup gives meets the documents of the block in one group, where numpy does the rest.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from chronotext.session import materialize

# The functions below travel with the tasks, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words of the documents of one block, and cells that are worked on at once. One document is never divided.
BLOCK_WORDS, CELLS_AT_ONCE = 1 << 22, 1 << 18
#: Words of a block whose lookups are packed into one row.
PACKED_WORDS = 1 << 16


class WordBlocks:
    """``documents`` (block, doc, doc_id, keys, word, n), ``doc`` their number in the block, and ``words`` (block, at, token, n), where ``word`` are places ``at``.

    ``found`` is what a lookup gave for the words, packed, where the same is asked for again and again.
    """

    def __init__(self, documents: DataFrame, words: DataFrame, with_words: bool = True, found: DataFrame | None = None):
        self.documents, self.words, self.with_words, self.found = documents, words, with_words, found

    def count(self) -> int:
        return self.documents.count()

    def only(self, docs: DataFrame) -> WordBlocks:
        """The blocks with those documents only that ``docs`` (block, doc) names, written anew; their words stay."""
        left = self.documents.join(docs.select("block", "doc"), ["block", "doc"], "left_semi")
        return WordBlocks(materialize(left), self.words, self.with_words, self.found)


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table[name]
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with about as many words as a block holds."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(batch.column(batch.num_columns - 1)), 0)))
    low = 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + BLOCK_WORDS, side="right")))
        yield batch.slice(low, high - low)
        low = high


def _documents(table: pa.Table, number: int, doc_id: str, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of one block: one for each document, and one with the block's words."""
    opens, texts = np.asarray(_column(table, "_opens")), _column(table, "_words")
    first, row_doc = np.flatnonzero(opens), np.cumsum(opens) - 1
    n_docs = len(first)
    doc = np.repeat(row_doc, np.asarray(pc.fill_null(pc.list_value_length(texts), 0)))
    vocabulary = pc.list_flatten(texts).dictionary_encode()
    size = len(vocabulary.dictionary)
    cell, n = np.unique(doc * max(size, 1) + vocabulary.indices.to_numpy(), return_counts=True)
    doc, word = np.divmod(cell, max(size, 1))
    bounds = pa.array(np.searchsorted(doc, np.arange(n_docs + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (word, n)]
    own = [_column(table, name).take(pa.array(first)) for name in (doc_id, *keys)]
    names = ["block", "doc", doc_id, *keys, "word", "n", "token", "total"]
    none = [pa.nulls(n_docs, pa.list_(pa.string())), pa.nulls(n_docs, pa.list_(pa.int64()))]
    yield pa.record_batch([pa.array(np.full(n_docs, number)), pa.array(np.arange(n_docs, dtype=np.int32)), *own, *lists, *none], names=names)
    ends = pa.array([0, size], pa.int32())
    total = np.bincount(word, weights=n, minlength=size).astype(np.int64)
    yield pa.record_batch(
        [pa.array([number]), pa.nulls(1, pa.int32()), *(pa.nulls(1, table[name].type) for name in (doc_id, *keys)), *[pa.nulls(1, pa.list_(pa.int32()))] * 2,
         pa.ListArray.from_arrays(ends, vocabulary.dictionary.cast(pa.string())), pa.ListArray.from_arrays(ends, pa.array(total))],
        names=names,
    )


_LETTERS = np.zeros(256, bool)
_LETTERS[ord("a") : ord("z") + 1] = True


def _initials(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each letter begins a token of ``letter_tokens`` in each lower-case text, 26 numbers for each."""
    within = _LETTERS[data] | (data == ord("'"))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = within.copy()
    begin[1:] &= ~within[:-1] | edge[1:-1]
    # A run of letters and apostrophes is one token, without the apostrophes it begins with.
    at = np.flatnonzero(begin)
    text = np.searchsorted(offsets, at, side="right") - 1
    first, text, left = [], [text], at
    while len(left):
        letter = _LETTERS[data[left]]
        first.append(left[letter])
        owner = text.pop()
        text += [owner[letter], owner[~letter]]
        left = left[~letter] + 1
        inside = left < offsets[text[-1] + 1]
        left, text[-1] = left[inside], text[-1][inside]
        inside = within[left]
        left, text[-1] = left[inside], text[-1][inside]
    at, text = np.concatenate([*first, left]), np.concatenate(text)
    n = len(offsets) - 1
    return np.bincount(text * 26 + data[at].astype(np.int64) - ord("a"), minlength=26 * n).reshape(n, 26)


def initial_counts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, counts): how many letter tokens of each row begin with a ... z. Rows without any go, as they do where tokens are exploded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            low = 0
            while low < len(texts):
                # Texts of about a megabyte at a time.
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + (1 << 20), side="right")) - 1)
                counts = _initials(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                some = np.flatnonzero(counts.any(axis=1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * 26), pa.array(counts[some].ravel()))
                yield pa.record_batch([batch.column(0).slice(low, high - low).take(pa.array(some)), lists], names=["id", "counts"])
                low = high

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, F.lower(text).alias("text")).mapInArrow(run, f"id {kind}, counts array<long>")


def word_blocks(docs: DataFrame, tokens: Column, doc_id: str, keys: list[str] = [], with_words: bool = True) -> WordBlocks:
    """The tokens of ``docs`` counted by document, in blocks; rows of one id are one document, and its ``keys`` the largest.

    The texts are shuffled once, by id; nothing is shuffled for each word.
    """
    whole = docs.repartition(doc_id).sortWithinPartitions(doc_id)
    most = Window.partitionBy(doc_id)
    opens = F.row_number().over(most.orderBy(doc_id)) == 1
    whole = whole.select(doc_id, *[F.max(key).over(most).alias(key) for key in keys], opens.alias("_opens"), tokens.alias("_words"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in (piece for batch in batches for piece in _pieces(batch)):
            held, size = [*held, batch], size + len(batch.column(batch.num_columns - 1).flatten())
            if size >= BLOCK_WORDS:
                table = pa.Table.from_batches(held)
                last = int(np.flatnonzero(np.asarray(_column(table, "_opens")))[-1])  # this document may go on
                if last:
                    yield from _documents(table.slice(0, last), number, doc_id, keys)
                    number, held = number + 1, table.slice(last).to_batches()
                    size = sum(len(b.column(b.num_columns - 1).flatten()) for b in held)
        if size or any(len(batch) for batch in held):
            yield from _documents(pa.Table.from_batches(held), number, doc_id, keys)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema.fields[:-2])
    schema = f"block long, doc int, {kinds}, word array<int>, n array<int>, token array<string>, total array<long>"
    rows = materialize(whole.mapInArrow(pack, schema))
    documents = rows.where("token IS NULL").select("block", "doc", doc_id, *keys, "word", "n")
    words = rows.where("token IS NOT NULL").select("block", F.posexplode(F.arrays_zip("token", "total")).alias("at", "w"))
    return WordBlocks(documents, words.select("block", "at", "w.token", F.col("w.total").alias("n")), with_words)


def packed(found: DataFrame) -> DataFrame:
    """(block, packed): the rows (block, at, ...) that a lookup found for each block, some thousands in one."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.drop_columns(["block"])
        out = []
        for low in range(0, len(rows), PACKED_WORDS):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as writer:
                writer.write_table(rows.slice(low, PACKED_WORDS).combine_chunks())
            out.append(sink.getvalue())
        return pa.table({"block": group["block"].slice(0, len(out)), "packed": pa.array([x.to_pybytes() for x in out], pa.binary())})

    return materialize(found.groupBy("block").applyInArrow(run, "block long, packed binary"))


def in_blocks(documents: DataFrame, found: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``work`` makes of the documents of each block and of what was found for it."""
    # Both come from one table; other names for one side's columns tell them apart.
    found = found.select(*[F.col(name).alias(name) for name in found.columns])
    return documents.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(work, schema)


def cells(documents: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, word, n) of the documents of a block, by document."""
    word, n = _column(documents, "word"), _column(documents, "n")
    doc = np.repeat(np.arange(len(word)), np.asarray(pc.list_value_length(word)))
    return doc, np.asarray(pc.list_flatten(word)), np.asarray(pc.list_flatten(n)).astype(np.int64)


def place(found: pa.Table, words: np.ndarray) -> np.ndarray:
    """For each number of a word in the block, its row of ``found``, or -1."""
    row = np.full(int(words.max()) + 1 if len(words) else 0, -1)
    at = np.asarray(_column(found, "at"))
    inside = at < len(row)
    row[at[inside]] = np.flatnonzero(inside)
    return row


def sparse(doc_id: str, keys: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Terms (idx, n) of each document by idx."""

    def work(documents: pa.Table, found: pa.Table) -> pa.Table:
        doc, word, n = cells(documents)
        row = place(found, word)[word]
        doc, n, row = doc[row >= 0], n[row >= 0], row[row >= 0]
        idx = np.asarray(_column(found, "idx"))[row]
        order = np.lexsort((idx, doc))
        bounds = np.searchsorted(doc, np.arange(len(documents) + 1)).astype(np.int32)
        terms = pa.StructArray.from_arrays([pa.array(idx[order].astype(np.int64)), pa.array(n[order])], ["idx", "n"])
        columns = {name: documents[name] for name in (doc_id, *keys)}
        return pa.table({**columns, "terms": pa.ListArray.from_arrays(pa.array(bounds), terms)})

    return work


def scored(doc_id: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """(doc_id, topic, score): the weights of the topics of a document's words, times how often they occur."""

    def work(documents: pa.Table, found: pa.Table) -> pa.Table:
        doc, word, n = cells(documents)
        row = place(found, word)[word]
        doc, n, row = doc[row >= 0], n[row >= 0], row[row >= 0]
        lists = _column(found, "topics")
        size, entries = np.asarray(pc.list_value_length(lists)), pc.list_flatten(lists)
        topic = entries.field("topic").dictionary_encode(null_encoding="encode")
        number, weight = topic.indices.to_numpy(), np.asarray(entries.field("weight"))
        begin, n_topics, ids = np.cumsum(size) - size, max(1, len(topic.dictionary)), _column(documents, doc_id)
        out = []
        reached = np.cumsum(size[row])
        low = 0
        while low < len(doc):
            # Whole documents, whose entries are no more than some at once.
            high = int(np.searchsorted(reached, (reached[low - 1] if low else 0) + CELLS_AT_ONCE, side="right"))
            high = int(np.searchsorted(doc, doc[min(max(high, low), len(doc) - 1)]))
            high = high if high > low else int(np.searchsorted(doc, doc[low], side="right"))
            own = size[row[low:high]]
            entry = np.repeat(begin[row[low:high]] - np.cumsum(own) + own, own) + np.arange(own.sum())
            key, of = np.unique(np.repeat(doc[low:high], own) * n_topics + number[entry], return_inverse=True)
            score = np.bincount(of, weights=weight[entry] * np.repeat(n[low:high], own), minlength=len(key))
            out.append(pa.table([ids.take(pa.array(key // n_topics)), topic.dictionary.take(pa.array(key % n_topics)), pa.array(score)], [doc_id, "topic", "score"]))
            low = high
        none = pa.table([ids[:0], topic.dictionary[:0], pa.array([], pa.float64())], [doc_id, "topic", "score"])
        return pa.concat_tables([none, *out])

    return work


def dealt(doc_id: str, k: int, with_words: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Each count dealt out over the topics by the shares of its document and its word, summed up by document and by word.

    ``found`` has the shares of words (at, idx, share), or these ``packed``, and, but for the first pass, of documents (doc, theta, ``at`` null).
    Documents without any word that was found give no row, nor do those without a theta, where there are any.
    """

    def work(documents: pa.Table, found: pa.Table) -> pa.Table:
        if "packed" in found.column_names:
            pieces = [pa.ipc.open_stream(piece.as_buffer()).read_all() for piece in found["packed"] if piece.is_valid]
            none = pa.table({"at": pa.array([], pa.int32()), "idx": pa.array([], pa.int64()), "share": pa.array([], pa.list_(pa.float64()))})
            known, thetas = pa.concat_tables(pieces) if pieces else none, found.filter(pc.is_null(found["packed"]))
        else:
            known, thetas = found.filter(pc.is_valid(found["at"])), found.filter(pc.is_null(found["at"]))
        doc, word, n = cells(documents)
        share = np.asarray(pc.list_flatten(_column(known, "share"))).reshape(-1, k)
        row = place(known, word)[word]
        theta, usable = np.full((len(documents), k), 1.0 / k), np.ones(len(documents), bool)
        if "has_theta" in found.column_names:
            numbers, of = np.asarray(_column(documents, "doc")), np.asarray(_column(thetas, "doc"))
            at = np.full(int(max(numbers.max(initial=0), of.max(initial=0))) + 1, -1)
            at[of] = np.arange(len(of))
            at = at[numbers]
            usable = at >= 0
            theta[usable] = np.asarray(pc.list_flatten(_column(thetas, "theta"))).reshape(-1, k)[at[usable]]
        keep = (row >= 0) & usable[doc]
        doc, n, row = doc[keep], n[keep].astype(float), row[keep]
        by_doc, by_word = np.zeros((len(documents), k)), np.zeros((len(share), k))
        for low in range(0, len(doc), CELLS_AT_ONCE):
            part = slice(low, low + CELLS_AT_ONCE)
            mass = theta[doc[part]] * share[row[part]]
            mass *= (n[part] / mass.sum(axis=1))[:, None]
            first = doc[low]
            for i in range(k):
                sums = np.bincount(doc[part] - first, weights=mass[:, i])
                by_doc[first : first + len(sums), i] += sums
                if with_words:
                    by_word[:, i] += np.bincount(row[part], weights=mass[:, i], minlength=len(share))
        some = np.flatnonzero(np.bincount(doc, minlength=len(documents)))
        used = np.flatnonzero(np.bincount(row, minlength=len(share))) if with_words else np.zeros(0, np.int64)
        ids = _column(documents, doc_id)
        masses = np.concatenate([by_doc[some], by_word[used]])
        block = documents["block"][0].as_py() if len(documents) else 0
        return pa.table({
            "block": pa.array(np.full(len(masses), block)),
            "doc": pa.concat_arrays([_column(documents, "doc").cast(pa.int32()).take(pa.array(some)), pa.nulls(len(used), pa.int32())]),
            doc_id: pa.concat_arrays([ids.take(pa.array(some)), pa.nulls(len(used), ids.type)]),
            "idx": pa.concat_arrays([pa.nulls(len(some), pa.int64()), _column(known, "idx").cast(pa.int64()).take(pa.array(used))]),
            "mass": pa.ListArray.from_arrays(pa.array(np.arange(len(masses) + 1, dtype=np.int32) * k), pa.array(masses.ravel())),
        })

    return work
