"""Scores of texts by logistic context mixing over the bits of their words.

A text is its words in lower case, each spelled as its bytes and a space, and an end, a line break.
The bits of a word are predicted one by one from counts under several contexts: the bits so far
after a word of the same kind (start of a text, end of a sentence, other), the bits so far after any
word, and the last one to four bytes, hashed. All count every occurrence in the training texts. The predictions are mixed in the logistic domain by
weights that a gate chooses, learned online while the training words pass, and refined by
an adaptive map of the mixed probability. In front of a word's bits stands one more where its text may go
on as an earlier training text did: after any five words that both have, the
earlier text's next words are expected one after the other, with a probability
that follows how often this came true in the text so far.

Apart from that, no context reaches further back than the kind of the word before, so a word has one probability for
each kind. It is worked out once in the sorted table of words, which grows with the corpus, and
texts look their words up there. Words are dealt out by ranges; the words that begin
with the same bits stand together, so their counts are sums within a range, to which those
of the neighbouring ranges are added where a range begins or ends amid them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from chronotext.llm.common import slices, texts, utf8
from chronotext.llm.hashing import mix, word_hashes
from chronotext.session import materialize

#: Kinds of the word before: none, one that ends a sentence, any other.
KINDS = 3
#: Bytes of context of the hashed predictors, and slots of each of their tables: their size is fixed, contexts share slots.
ORDERS, SLOTS = (1, 2, 3, 4), 1 << 19
FEATURES = 2 + len(ORDERS)
#: Gates: powers of two of the count of the bits so far, times how well the kind of the word before is known there.
GATES = 12 * 3
#: The adaptive map: bits of a byte, and knots of the mixed prediction.
MAP = (8, 25)
#: Bytes and rows of the texts of a block, which look up their words together; words of one range.
BLOCK_BYTES, BLOCK_ROWS, RANGE_ROWS = 4 << 20, 1 << 18, 30_000
#: Blocks for each part of the word table: a block asks every part, and a part hears all blocks.
BLOCKS_PER_PART = 8
#: Rows of counts of some blocks that are added up before they are sent, and rows of texts that reach Python at once.
COUNTED_ROWS, TEXT_ROWS = 500_000, 512
#: How hard texts are compressed: they are written and shuffled whole.
TEXT_LEVEL = 5
#: Bits that are learned from between two changes of the weights, and bits that are scored at once.
STEP_BITS, SCORED_BITS = 1 << 17, 1 << 16
#: Words of a context that an earlier text is found by, bits of its number, and words expected after it.
CONTEXT, CONTEXT_BITS, EXPECTED = 5, 56, 20
#: Contexts of a part that are compared at once, and contexts that other blocks ask for of one copy of a block.
COMPARED_ROWS, ASKED_ROWS = 1 << 20, 1 << 22
#: Hits and misses that each state starts with: nothing expected before, a miss, and 1, 4 or 16 hits or more in a row.
TRIALS = np.array([[3, 1], [1, 1.5], [5, 1], [20, 1], [100, 1]], float)
_ADD = np.float32(0.4)
_LIMIT = np.float32(14)
_END, _SPACE = 0x0A, 0x20


# --- blocks ------------------------------------------------------------------------------------


def pack(table: pa.Table, level: int = 1) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", level))) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of numbers from 0 on, compressed: first bytes stand together, as do second ones and so on."""
    columns = [np.ascontiguousarray(column).astype("<u8") for column in columns]
    widths = bytes((int(column.max(initial=0)).bit_length() + 7) // 8 for column in columns)
    body = b"".join(column.view(np.uint8)[i::8].tobytes() for column, width in zip(columns, widths) for i in range(width))
    return len(columns[0]).to_bytes(4, "little") + widths + pa.Codec("zstd", 1).compress(body, asbytes=True)


def unsqueeze(data: bytes, n_columns: int) -> list[np.ndarray]:
    """The columns of ``squeeze``."""
    rows, widths = int.from_bytes(data[:4], "little"), data[4 : 4 + n_columns]
    body = np.frombuffer(pa.Codec("zstd").decompress(data[4 + n_columns :], rows * sum(widths)), np.uint8) if rows * sum(widths) else np.zeros(0, np.uint8)
    out, low = [], 0
    for width in widths:
        out.append(np.zeros(rows, "<i8"))
        for i in range(width):
            out[-1].view(np.uint8)[i::8] = body[low : low + rows]
            low += rows
    return out


def _order(values: np.ndarray) -> np.ndarray:
    """The stable order of numbers of up to ``CONTEXT_BITS`` bits, by sorting their first bits with their places, which is far faster."""
    place = max(1, (len(values) - 1).bit_length())
    spare = np.uint64(max(0, int(values.max(initial=0)).bit_length() + place - 64))
    order = np.sort(values >> spare << np.uint64(place) | np.arange(len(values), dtype=np.uint64))
    order = (order & np.uint64((1 << place) - 1)).astype(np.int64)
    sorted_ = values[order]
    return order if (sorted_[1:] >= sorted_[:-1]).all() else np.argsort(values, kind="stable")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table. What was shuffled only to write it goes once it is written."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return materialize(df)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table[name]
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def block_table(rows: DataFrame) -> DataFrame:
    """(block, packed): ``rows`` in compressed pieces of bounded size, written once, so that every row keeps its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size, count = TaskContext.get().partitionId() << 16, [], 0, 0
        for batch in batches:
            # A batch may be larger than a block.
            for low, high, data, _ in slices(batch["text"], BLOCK_BYTES // 4):
                held.append(batch.slice(low, high - low))
                size, count = size + len(data), count + high - low
                if size >= BLOCK_BYTES or count >= BLOCK_ROWS:
                    yield pa.record_batch([pa.array([number]), pa.array([pack(pa.Table.from_batches(held), TEXT_LEVEL)])], names=["block", "packed"])
                    number, held, size, count = number + 1, [], 0, 0
        if count:
            yield pa.record_batch([pa.array([number]), pa.array([pack(pa.Table.from_batches(held), TEXT_LEVEL)])], names=["block", "packed"])

    conf, name = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    # Unset it is 10,000 rows: both sides would hold tens of MB of texts for each task, besides the block.
    before = conf.get(name, None)
    if before is not None:
        return materialize(rows.mapInArrow(run, "block long, packed binary"))
    conf.set(name, str(TEXT_ROWS))
    try:
        return materialize(rows.mapInArrow(run, "block long, packed binary"))
    finally:
        conf.unset(name)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    for batch in batches:
        for block, packed in zip(batch["block"].to_pylist(), batch["packed"]):
            yield block, unpack(packed.as_buffer())
            # A worker stays for the next tasks, and what it holds adds to its neighbour's.
            pa.default_memory_pool().release_unused()


# --- words of texts ----------------------------------------------------------------------------

#: The bytes between words, and what bytes become: A-Z a-z, and what is between words a space.
_GAPS = b" \t\n\v\f\r"
_CLEAN = bytes.maketrans(bytes(range(0x41, 0x5B)) + _GAPS, bytes(range(0x61, 0x7B)) + b" " * len(_GAPS))
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?"]] = True


def _words(column: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(raw, data, starts, ends, offsets): the bytes of some texts, the same as the words have them, where these start and end, and where texts do."""
    data, offsets = utf8(column)
    raw = data.tobytes()
    data = np.frombuffer(raw.translate(_CLEAN), np.uint8)
    inside = data != _SPACE
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    finish[:-1] &= ~inside[1:] | edge[1:-1]
    return raw, data, np.flatnonzero(begin), np.flatnonzero(finish) + 1, offsets


def _with_ends(starts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(at, first): each word's place among the words and ends, and each text's first one."""
    first = np.searchsorted(starts, offsets)
    at = np.arange(len(starts)) + np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return at, first + np.arange(len(first))


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(word, kind, first, vocabulary, n_bytes) of the words and ends of some texts.

    Token ``i`` is word ``word[i]`` of the vocabulary, in which the empty word, the last, is the end.
    Text ``j`` has the tokens from ``first[j]`` to ``first[j + 1]``.
    """
    raw, data, starts, ends, offsets = _words(column)
    bounds = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=bounds[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw.translate(_CLEAN, _GAPS))]).dictionary_encode()
    at, first = _with_ends(starts, offsets)
    word = np.full(int(first[-1]), len(words.dictionary), np.int64)
    word[at] = words.indices.to_numpy(zero_copy_only=False)
    stop = np.zeros(len(word), bool)
    stop[at] = _STOPS[data[ends - 1]]
    kind = np.full(len(word), 2, np.int8)
    kind[1:][stop[:-1]] = 1
    kind[first[:-1]] = 0
    # Without the ends a text's words begin that many places earlier.
    n_bytes = np.diff(bounds[first - np.arange(len(first))].astype(np.int64)) + np.diff(first)
    return word, kind, first, pa.concat_arrays([words.dictionary, pa.array([b""])]), n_bytes


def _keys(vocabulary: pa.Array) -> pa.Array:
    """The words as they are spelled: with a space, the empty one as a line break."""
    spelled = pc.binary_join_element_wise(vocabulary, pa.scalar(b" ", pa.binary()), pa.scalar(b"", pa.binary()))
    return pc.if_else(pc.equal(pc.binary_length(vocabulary), 0), pa.scalar(b"\n", pa.binary()), spelled)


def _numbers(vocabulary: pa.Array) -> np.ndarray:
    """A 64-bit number for each word."""
    data, offsets = utf8(vocabulary)
    return word_hashes(np.append(data, np.uint8(0)), offsets[:-1], offsets[1:])


def _part_of(keys: pa.Array, parts: int) -> np.ndarray:
    """The part of the word table that has each of some words as they are spelled: it goes by the word's number."""
    data, offsets = utf8(keys)
    return _parts(word_hashes(np.append(data, np.uint8(0)), offsets[:-1], offsets[1:] - 1), parts)


def _parts(numbers: np.ndarray, parts: int) -> np.ndarray:
    part = numbers % np.uint64(parts)
    # Short numbers are sorted far faster.
    return part.astype(np.uint16 if parts <= 1 << 16 else np.int64)


def numbered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number, first) of the tokens of some texts, as ``tokens`` and ``_numbers`` have them, without their vocabulary."""
    _, data, starts, ends, offsets = _words(column)
    at, first = _with_ends(starts, offsets)
    numbers = np.full(int(first[-1]), _numbers(pa.array([b""]))[0])
    numbers[at] = word_hashes(data, starts, ends)
    return numbers, first


def contexts(numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, context): every token that follows ``CONTEXT`` others in its text, and the number of those."""
    follows = np.ones(len(numbers), bool)
    for back in range(CONTEXT):
        at = first[:-1] + back
        follows[at[at < len(numbers)]] = False
    place, n = np.flatnonzero(follows), max(0, len(numbers) - CONTEXT + 1)
    context = numbers[:n]
    for back in range(1, CONTEXT):
        context = context * np.uint64(0x9E3779B97F4A7C15) + numbers[back : back + n]
    return place, mix(context)[place - CONTEXT] >> np.uint64(64 - CONTEXT_BITS)


class Contexts:
    """The contexts of a block: ``place`` of each, ``of`` its number among the distinct ``values``, in order, how often these are ``used`` and, in training texts, ``seen``, and where first there (-1: none)."""

    def __init__(self, numbers: np.ndarray, first: np.ndarray, held_out: np.ndarray):
        self.place, context = contexts(numbers, first)
        order = _order(context)
        context = context[order]
        head = np.append(True, context[1:] != context[:-1])[: len(context)]
        self.values, self.of = context[head], np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(head) - 1
        learned = np.repeat(~held_out, np.diff(first))[self.place[order]]
        starts, at = np.flatnonzero(head), np.flatnonzero(learned)
        self.used = np.diff(starts, append=len(order))
        # Equal contexts stand together, in order of their places.
        sums = np.append(0, np.cumsum(learned))
        before = sums[starts]
        self.seen = np.append(before[1:], sums[-1])[: len(starts)] - before
        self.origin = np.full(len(self.values), -1)
        some = np.flatnonzero(self.seen)
        self.origin[some] = self.place[order[at[before[some]]]]


def word_table(blocks: DataFrame, parts: int) -> DataFrame:
    """(key, kind, seen, used, fresh, block): how often each word follows each kind, in the training texts and in all.

    ``fresh`` is 1 once for each word of the training texts. Counts travel
    in compressed pieces, one for each of ``parts`` and some blocks, as millions of short rows fill the executors' heaps.

    Every context travels with them, in pieces for each of ``parts`` and each block. Rows of kind ``KINDS`` tell a block which
    of its contexts another block's training text has first: ``key`` is (number of the context in the block, that other
    block, its number there), squeezed, ``seen`` and ``used`` are how often these contexts occur.
    """
    names = ["key", "kind", "seen", "used"]
    sent = ["part", "block", "low", "packed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for block, table in _blocks(batches):
            counts, own = _block_counts(table)
            # Contexts are dealt out by ranges of their numbers.
            part = (own.values >> np.uint64(CONTEXT_BITS - 32)) * np.uint64(parts) >> np.uint64(32)
            edges = np.searchsorted(part, np.arange(parts + 1))
            for i in np.flatnonzero(np.diff(edges)):
                low, high = edges[i], edges[i + 1]
                piece = squeeze(np.diff(own.values[low:high], prepend=np.uint64(0)), own.seen[low:high], own.used[low:high])
                yield pa.record_batch([pa.array([int(i)]), pa.array([block]), pa.array([int(low)]), pa.array([piece])], names=sent)
            held.append(counts)
            size += len(held[-1])
            if size >= COUNTED_ROWS:
                yield from deal(held)
                held, size = [], 0
        if size:
            yield from deal(held)

    def deal(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        counts = _summed(held)
        part = _part_of(_column(counts, "key"), parts)
        order = np.argsort(part, kind="stable")
        counts, edges = counts.take(pa.array(order)), np.searchsorted(part[order], np.arange(parts + 1))
        for own in np.flatnonzero(np.diff(edges)):
            piece = counts.slice(edges[own], edges[own + 1] - edges[own])
            yield pa.record_batch([pa.array([int(own)]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([pack(piece)])], names=sent)

    def merge(group: pa.Table) -> pa.Table:
        of_words = pc.is_null(group["block"])
        told = _told(group.filter(pc.invert(of_words)).sort_by("block"))
        pieces = [unpack(packed.as_buffer()) for packed in group.filter(of_words)["packed"]]
        if not pieces:
            return told
        counts = _summed(pieces)
        kind, seen = (np.asarray(_column(counts, name)) for name in names[1:3])
        # All rows of a key are in one part.
        key = np.asarray(_column(counts, "key").dictionary_encode().indices)
        fresh, learned = np.zeros(len(key), np.int64), np.flatnonzero(seen > 0)
        one = np.full(int(key.max(initial=0)) + 1, -1)
        one[key[learned]] = learned
        fresh[one[one >= 0]] = 1
        counts = counts.append_column("fresh", pa.array(fresh)).append_column("block", pa.nulls(len(key), pa.int64()))
        return pa.concat_tables([counts, told])

    pieces = blocks.mapInArrow(run, "part long, block long, low long, packed binary")
    return pieces.groupBy("part").applyInArrow(merge, "key binary, kind byte, seen long, used long, fresh long, block long")


def _block_counts(table: pa.Table) -> tuple[pa.Table, Contexts]:
    """(key, kind, seen, used) of the words of one block, and its contexts."""
    word, kind, first, vocabulary, _ = tokens(_column(table, "text").cast(pa.large_string()))
    held_out = np.asarray(_column(table, "held_out"))
    pair = word * KINDS + kind
    used = np.bincount(pair, minlength=len(vocabulary) * KINDS)
    seen = np.bincount(pair[np.repeat(~held_out, np.diff(first))], minlength=len(used))
    pair = np.flatnonzero(used)
    keys = _keys(vocabulary).cast(pa.binary()).take(pa.array(pair // KINDS))
    counts = pa.table({"key": keys, "kind": (pair % KINDS).astype(np.int8), "seen": seen[pair], "used": used[pair]})
    return counts, Contexts(_numbers(vocabulary)[word], first, held_out)


def _told(pieces: pa.Table) -> pa.Table:
    """What each block hears of its contexts in one part, from the blocks' pieces in order of the blocks."""
    blocks, lows = (np.asarray(_column(pieces, name)).astype(np.int64) for name in ("block", "low"))
    values, counts = [], []
    for packed in pieces["packed"]:
        step, *count = unsqueeze(packed.as_py(), 3)
        values.append(np.cumsum(step.view(np.uint64)))
        counts.append([each.astype(np.uint32) for each in count])
    total = sum(map(len, values))
    out = {number: [[], 0, 0] for number in range(len(blocks))}
    begin, least, most = [0] * len(values), min((int(v[0]) for v in values), default=0), max((int(v[-1]) for v in values), default=0)
    cuts = -(-total // COMPARED_ROWS)
    for cut in range(1, cuts + 1):
        # Contexts are compared some at a time, by ranges of their numbers.
        bound = most + 1 if cut == cuts else least + (most - least) * cut // cuts
        end = [int(np.searchsorted(v, np.uint64(bound))) for v in values]
        own = [slice(a, b) for a, b in zip(begin, end)]
        value = np.concatenate([v[s] for v, s in zip(values, own)])
        number = np.repeat(np.arange(len(values)), [b - a for a, b in zip(begin, end)])
        at = np.concatenate([np.arange(a + low, b + low) for a, b, low in zip(begin, end, lows)])
        seen, used = (np.concatenate([c[i][s] for c, s in zip(counts, own)]).astype(np.int64) for i in range(2))
        begin = end
        order = _order(value)
        value, number, at, seen, used = value[order], number[order], at[order], seen[order], used[order]
        head = np.append(True, value[1:] != value[:-1])[: len(value)]
        group, start = np.cumsum(head) - 1, np.flatnonzero(head)
        source, learned = np.full(len(start), -1), np.flatnonzero(seen)
        source[group[learned][::-1]] = learned[::-1]
        from_ = source[group]
        asks = np.flatnonzero((from_ >= 0) & (number != number[from_]))
        asks = asks[_order(number[asks].astype(np.uint64))]
        if not len(asks):
            continue
        seen, used = (np.add.reduceat(x, start)[group[asks]] for x in (seen, used))
        from_, edges = from_[asks], np.searchsorted(number[asks], np.arange(len(values) + 1))
        for i in np.flatnonzero(np.diff(edges)):
            some = slice(edges[i], edges[i + 1])
            out[i][0].append((at[asks[some]], blocks[number[from_[some]]], at[from_[some]]))
            out[i][1] += int(seen[some].sum())
            out[i][2] += int(used[some].sum())
    found = [(int(blocks[i]), [np.concatenate(x) for x in zip(*each)], seen, used) for i, (each, seen, used) in out.items() if each]
    return pa.table({
        "key": pa.array([squeeze(np.diff(at, prepend=0), *source) for _, (at, *source), _, _ in found], pa.binary()),
        "kind": pa.array([KINDS] * len(found), pa.int8()), "seen": pa.array([f[2] for f in found], pa.int64()), "used": pa.array([f[3] for f in found], pa.int64()),
        "fresh": pa.array([0] * len(found), pa.int64()), "block": pa.array([f[0] for f in found], pa.int64()),
    })


def _summed(counts: list[pa.Table]) -> pa.Table:
    """Tables of (key, kind, seen, used) added up by key and kind."""
    sums = pa.concat_tables(counts).group_by(["key", "kind"], use_threads=False).aggregate([("seen", "sum"), ("used", "sum")])
    return sums.select(["key", "kind", "seen_sum", "used_sum"]).rename_columns(["key", "kind", "seen", "used"])


def asked(word: np.ndarray, kind: np.ndarray, numbers: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(pair, edges): the words, of these ``numbers``, and kinds of some tokens by the part of the word table that has them.

    Part ``i`` has those from ``edges[i]`` to ``edges[i + 1]``. Both asking and hearing the answers go by this order.
    """
    pair = np.flatnonzero(np.bincount(word * KINDS + kind))
    part = _parts(numbers, parts)[pair // KINDS]
    order = np.argsort(part, kind="stable")
    return pair[order], np.searchsorted(part[order], np.arange(parts + 1))


def _named(keys: pa.Array, kinds: np.ndarray) -> pa.Array:
    marks = pa.array([bytes([k]) for k in range(KINDS)], pa.binary()).take(pa.array(kinds))
    return pc.binary_join_element_wise(keys.cast(pa.binary()), marks, pa.scalar(b"", pa.binary()))


# --- words of a range --------------------------------------------------------------------------


class Range:
    """The sorted rows (key, kind, seen) of a range of words, and their bits."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("key", "ascending"), ("kind", "ascending")])
        keys = _column(table, "key").cast(pa.large_binary())
        self.table, self.keys = table, keys
        self.data, offsets = utf8(keys)
        self.start, self.size = offsets[:-1], np.diff(offsets)
        self.kind = np.asarray(_column(table, "kind")).astype(np.int64)
        self.seen = np.asarray(_column(table, "seen")).astype(np.float64)
        n = len(keys)
        self.shared = np.zeros(n, np.int64)  # bits that a key has in common with the one before
        pair, depth = np.arange(1, n), 0
        while len(pair):
            a, b = self.start[pair - 1] + depth, self.start[pair] + depth
            done = (depth >= self.size[pair - 1]) | (depth >= self.size[pair])
            self.shared[pair[done]] = 8 * depth
            pair, a, b = pair[~done], a[~done], b[~done]
            other = self.data[a] ^ self.data[b]
            differ = other > 0
            self.shared[pair[differ]] = 8 * depth + 7 - np.log2(other[differ]).astype(np.int64)
            pair, depth = pair[~differ], depth + 1
        same = self.shared == 8 * self.size
        same[:1] = False
        self.word = np.cumsum(~same) - 1  # rows of one key are one word
        self.word_seen = np.bincount(self.word, weights=self.seen, minlength=int(self.word[-1]) + 1 if n else 0)[self.word]

    def _weights(self) -> np.ndarray:
        return np.stack([self.seen, *(np.where(self.kind == k, self.seen, 0) for k in range(KINDS))])

    def ends(self, head: int, tail: int) -> tuple[np.ndarray, np.ndarray]:
        """What this range adds to the counts of its neighbours: of the first ``head`` bits of the first key and ``tail`` of the last.

        (all, kind 0, kind 1, ...) by number of bits, from 0.
        """
        weights = self._weights()
        total = np.concatenate([np.zeros((1 + KINDS, 1)), np.cumsum(weights, axis=1)], axis=1)
        low = np.minimum.accumulate(np.append(np.iinfo(np.int64).max, self.shared[1:]))
        high = np.minimum.accumulate(np.append(np.iinfo(np.int64).max, self.shared[1:][::-1]))
        first = np.array([np.searchsorted(-low, -d, side="right") for d in range(head + 1)])
        last = np.array([np.searchsorted(-high, -d, side="right") for d in range(tail + 1)])
        n = len(self.seen)
        return total[:, first], total[:, n : n + 1] - total[:, n - last]

    def counts(self, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(at, all, same kind): for each row, training words that begin with its first 0, 1, ... bits.

        Row ``i`` has its counts from ``at[i]`` on, one more than bits. ``before`` and ``after`` are
        the sums of the ranges on both sides, by bits shared with the first and last key.
        """
        n, bits = len(self.size), 8 * self.size
        at = np.zeros(n + 1, np.int64)
        np.cumsum(bits + 1, out=at[1:])
        every, kind = np.repeat(self.seen, bits + 1), np.repeat(self.seen, bits + 1)
        deep = np.maximum(self.shared, np.append(self.shared[1:], 0))
        # Rows at the ends of the range may share bits with rows beyond it.
        deep[:1] = np.maximum(deep[:1], before.shape[1] - 1)
        deep[-1:] = np.maximum(deep[-1:], after.shape[1] - 1)
        deep = np.minimum(deep + 7 & ~7, bits)  # rows are left out byte by byte
        # Rows with the same first bits stand together, so their sums are differences of running totals.
        total = np.zeros((1 + KINDS, n + 1))
        np.cumsum(self._weights(), axis=1, out=total[:, 1:])
        active, shared, place, kinds, d = np.arange(n), self.shared, at[:-1], 1 + self.kind, 0
        while len(active):
            head = shared < d
            head[0] = True
            starts = np.flatnonzero(head)
            size = np.diff(starts, append=len(active))
            sums = total[:, active[starts + size - 1] + 1] - total[:, active[starts]]
            if active[0] == 0 and d < before.shape[1]:
                sums[:, 0] += before[:, d]
            if active[-1] == n - 1 and d < after.shape[1]:
                sums[:, -1] += after[:, d]
            every[place + d] = np.repeat(sums[0], size)
            kind[place + d] = sums.ravel()[kinds * len(size) + np.repeat(np.arange(len(size)), size)]
            d += 1
            if d % 8 == 1:
                kept = np.flatnonzero(deep[active] >= d)
                active, shared, place, kinds = active[kept], shared[kept], place[kept], kinds[kept]
        return at[:-1], every, kind


def _smaller(values: np.ndarray, or_equal: bool = False) -> np.ndarray:
    """For each place the nearest before it with a smaller value (or an equal one), the number of places if there is none."""
    n = len(values)
    values, at, left = np.append(values, -1), np.append(np.arange(-1, n - 1), n), np.arange(n)
    at[:1] = n
    while len(left):
        left = left[values[at[left]] > values[left] if or_equal else values[at[left]] >= values[left]]
        at[left] = at[at[left]]
    return at[:-1]


class Branches:
    """Some rows of a range by kind and key, each with its bits from the byte on in which it leaves the row before of its kind.

    Words of one kind that begin with the same bits have the same predictions there, so these are worked out once, in the first of
    the rows. Row ``i`` has its bits from ``at[i]`` on, the first of them bit ``begin[i]`` of its key; those below ``fresh[i]`` only fill the byte.
    """

    def __init__(self, words: Range, rows: np.ndarray):
        self.rows = rows = rows[np.argsort(words.kind[rows], kind="stable")]
        self.seen = words.seen[rows]
        self.fresh = np.zeros(len(rows), np.int64)
        if len(rows):
            least = np.minimum.reduceat(np.append(words.shared, 0), rows + 1)[:-1]
            self.fresh[1:] = np.where(words.kind[rows[1:]] == words.kind[rows[:-1]], least, 0)
        self.begin = self.fresh & ~7
        self.at = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(8 * words.size[rows] - self.begin, out=self.at[1:])
        self.owner = _smaller(self.fresh)  # the row that has a row's last bits before its own

    def _own(self, values: np.ndarray) -> np.ndarray:
        """``values`` of bits with 0 for those that only fill a byte."""
        fill = self.fresh - self.begin
        for i in range(7):
            values[self.at[:-1][fill > i] + i] = 0
        return values

    def mass(self) -> np.ndarray:
        """For each bit, how many words of this range were seen after the kind that begin with the bits up to it."""
        n = len(self.rows)
        if not n:
            return np.zeros(0)
        end = n - 1 - _smaller(self.fresh[::-1], or_equal=True)[::-1]
        total = np.append(0, np.cumsum(self.seen))
        below = total[np.where(end < 0, n, end)] - total[:-1]
        child = np.flatnonzero(self.owner < n)
        owner = self.owner[child]
        joined = np.bincount(self.at[owner] + self.fresh[child] - 1 - self.begin[owner], weights=below[child], minlength=self.at[-1])
        sums = np.cumsum(joined)
        return self._own(np.repeat(self.seen + sums[self.at[1:] - 1], np.diff(self.at)) - sums + joined)

    def along(self, values: np.ndarray) -> np.ndarray:
        """The sums of ``values`` over all bits of each row, those included that an earlier row has."""
        n = len(self.rows)
        sums = np.append(0, np.cumsum(self._own(values)))
        own = sums[self.at[1:]] - sums[self.at[:-1]]
        child = np.flatnonzero(self.owner < n)
        owner, inherited = np.append(self.owner, n), np.zeros(n + 1)
        inherited[child] = sums[self.at[owner[child]] + self.fresh[child] - self.begin[owner[child]]] - sums[self.at[owner[child]]]
        while (owner < n).any():
            inherited, owner = inherited + inherited[owner], owner[owner]
        return own + inherited[:-1]

    def some(self, most: int) -> Iterator[np.ndarray]:
        """The rows by their place here, some of about ``most`` bits at a time."""
        low = 0
        while low < len(self.rows):
            high = max(low + 1, int(np.searchsorted(self.at, self.at[low] + most, side="right")) - 1)
            yield np.arange(low, high)
            low = high


def _slots(data: np.ndarray, byte: np.ndarray, left: np.ndarray, order: int) -> np.ndarray:
    """For each byte of a key, ``left`` bytes into it, the number of the ``order`` bytes before it."""
    context = np.full(len(byte), order, np.uint64)
    for back in range(1, order + 1):
        there = left >= back
        context = context * np.uint64(0x9E3779B97F4A7C15) + np.where(there, data[np.maximum(byte - back, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return mix(context)


#: For each order what the bits before one in its byte, with a 1 in front, add to a slot.
_NODES = {order: (mix(np.arange(256, dtype=np.uint64) + np.uint64(order << 20)) & np.uint64(SLOTS - 1)).astype(np.int64) for order in ORDERS}


class Bits:
    """The bits that some rows of ``branches`` have there, with the counts under their contexts."""

    def __init__(self, words: Range, branches: Branches, some: np.ndarray, at: np.ndarray, every: np.ndarray, kind: np.ndarray, orders=ORDERS):
        rows, skipped = branches.rows[some], branches.begin[some] >> 3
        size = words.size[rows] - skipped
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        left = step + np.repeat(skipped, size)
        byte = np.repeat(words.start[rows], size) + left
        eight = np.arange(8)[None, :]
        self.at = ((np.repeat(branches.at[some], size) + 8 * step)[:, None] + eight).reshape(-1)
        value = words.data[byte]
        self.bit = np.unpackbits(value)
        self.place = np.tile(np.arange(8, dtype=np.int64), len(byte))
        node = (value[:, None].astype(np.int64) + 256) >> (8 - eight)
        self.slot = []
        for order in orders:
            nodes = _NODES[order]
            context = (_slots(words.data, byte, left, order) & np.uint64(SLOTS - 1)).astype(np.int64)
            self.slot.append((context[:, None] ^ nodes[node]).reshape(-1))
        if at is not None:
            place = ((np.repeat(at[rows], size) + 8 * left)[:, None] + eight).reshape(-1)
            self.parent = every[place], kind[place]
            place += 1
            self.child = every[place], kind[place]

    def inputs(self, predicted: np.ndarray, once: int) -> tuple[np.ndarray, np.ndarray]:
        """(features, gate): the predictions for a 1 in the logistic domain, and the gate.

        ``predicted`` is what the slots say, as ``slot_predictions`` has it. ``once`` occurrences
        of the word itself are taken out of the other counts.
        """
        x = np.empty((FEATURES, len(self.bit)), np.float32)
        for i in range(2):
            yes, no = self.child[i] + (float(_ADD) - once), self.parent[i] - self.child[i] + float(_ADD)
            np.log((yes / no).astype(np.float32), out=x[i])
        np.negative(x[:2], where=self.bit[None, :] == 0, out=x[:2])
        for i, slot in enumerate(self.slot):
            np.take(predicted[i], 2 * slot + self.bit if once else slot, out=x[2 + i], mode="clip")
        np.clip(x, -_LIMIT, _LIMIT, out=x)
        known = np.minimum(np.frexp(self.parent[0] + (1 - once))[1] - 1, 11)
        kind = self.parent[1] - once
        return x, known.astype(np.int64) * 3 + (kind >= 1) + (kind >= 8)


def slot_predictions(tables: np.ndarray, once: int) -> np.ndarray:
    """What each slot predicts for a 1 in the logistic domain, one row for each order.

    With ``once`` a slot has two: the prediction for a bit that is 0 and for one that is 1, each without this bit in the counts.
    """
    one, zero = tables[:, 0], tables[:, 1]
    if not once:
        return np.log((one + _ADD) / (zero + _ADD))
    fewer_ones, fewer_zeros = np.maximum(one - once, 0), np.maximum(zero - once, 0)
    both = np.stack([(one + _ADD) / (fewer_zeros + _ADD), (fewer_ones + _ADD) / (zero + _ADD)], axis=-1)
    return np.log(both).reshape(len(tables), -1)


#: The tables whose predictions were asked last in this process, and the predictions: a worker has many ranges of one model.
_KEPT: list = [None, None, None]


def kept_predictions(tables: np.ndarray, once: int) -> np.ndarray:
    """``slot_predictions`` of tables that stay as they are, worked out once in a row."""
    if _KEPT[0] is not tables or _KEPT[1] != once:
        _KEPT[:] = [None, None, None]
        _KEPT[:] = [tables, once, slot_predictions(tables, once)]
    return _KEPT[2]


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _steps(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The knot of the adaptive map below each mixed prediction, and the share of the way to the next."""
    x = np.clip(x.astype(np.float64) + MAP[1] // 2, 0, MAP[1] - 1.001)
    low = x.astype(np.int64)
    return low, x - low


def _mixed(x: np.ndarray, gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    total = np.zeros(len(gate), np.float32)
    for feature, weight in zip(x, weights.T.astype(np.float32)):
        total += feature * weight[gate]
    return np.clip(total, -_LIMIT, _LIMIT)


START = np.tile([0.4, 0.4, 0.0, 0.0, 0.1, 0.3], (GATES, 1))
#: How much data the start values count as.
TRUST = 20.0


def _training_bits(words: Range, groups: Iterator[np.ndarray], at, every, kind, tables) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Bits]]:
    """(features, gate, mass, bits) of groups of training words of a range.

    Each word is predicted as if its own occurrence were not among the counts. Bits that words of a group share come once, with the mass of all.
    """
    predicted = kept_predictions(tables, 1)
    for rows in groups:
        branches = Branches(words, rows)
        mass = branches.mass()
        for some in branches.some(STEP_BITS):
            bits = Bits(words, branches, some, at, every, kind)
            x, gate = bits.inputs(predicted, 1)
            yield x, gate, mass[bits.at], bits


def _scattered(words: Range) -> Iterator[np.ndarray]:
    """The training words of a range, about ``STEP_BITS`` bits at a time, in scattered order."""
    rows = np.flatnonzero(words.seen > 0)
    rows = rows[np.argsort(mix((words.start[rows] * KINDS + words.kind[rows]).astype(np.uint64)), kind="stable")]
    bounds, low = np.cumsum(8 * words.size[rows]), 0
    while low < len(rows):
        high = max(low + 1, int(np.searchsorted(bounds, (bounds[low - 1] if low else 0) + STEP_BITS)))
        yield np.sort(rows[low:high])
        low = high


def learn_range(words: Range, at, every, kind, tables) -> np.ndarray:
    """One pass over the training words of a range: [precision, precision x weights] in one row.

    The bits of some words are predicted with the weights so far; then the weights move by
    Newton's step with all the curvature seen so far.
    """
    precision = np.tile(np.eye(FEATURES) * TRUST, (GATES, 1, 1))
    weights = START.copy()
    for x, gate, mass, bits in _training_bits(words, _scattered(words), at, every, kind, tables):
        p = _squash(_mixed(x, gate, weights).astype(np.float64))
        error, curve = mass * (bits.bit - p), mass * np.maximum(p * (1 - p), 1e-4)
        order = np.argsort(gate.astype(np.uint8), kind="stable")
        edges = np.searchsorted(gate[order], np.arange(GATES + 1))
        x = np.ascontiguousarray(x.T)[order].astype(np.float64)
        error, curve = error[order], curve[order]
        for g in np.flatnonzero(np.diff(edges)):
            own = slice(edges[g], edges[g + 1])
            precision[g] += (x[own].T * curve[own]) @ x[own]
            weights[g] += np.clip(np.linalg.solve(precision[g], error[own] @ x[own]), -0.5, 0.5)
    return np.concatenate([precision.ravel(), np.einsum("gij,gj->gi", precision, weights).ravel()])


class Mixer:
    """Weights by gate, from the sums over all ranges, and the adaptive map once ``refine`` had its sums."""

    def __init__(self, sums: np.ndarray):
        size = GATES * FEATURES * FEATURES
        precision = sums[:size].reshape(GATES, FEATURES, FEATURES) + np.eye(FEATURES) * 1e-9
        self.weights = np.linalg.solve(precision, sums[size:].reshape(GATES, FEATURES, 1))[..., 0]
        self.map = np.zeros(MAP)

    def map_range(self, words: Range, at, every, kind, tables) -> np.ndarray:
        """[zeros, ones, expected ones] of the training words of a range at each knot of the map, in one row."""
        seen, expected = np.zeros((*MAP, 2)), np.zeros(MAP)
        for x, gate, mass, bits in _training_bits(words, [np.flatnonzero(words.seen > 0)], at, every, kind, tables):
            mixed = _mixed(x, gate, self.weights)
            p = _squash(mixed.astype(np.float64))
            knot, share = _steps(mixed)
            for step, of in ((knot, 1 - share), (knot + 1, share)):
                place = (bits.place * MAP[1] + step) * 2
                seen += np.bincount(place + bits.bit, weights=mass * of, minlength=seen.size).reshape(seen.shape)
                expected += np.bincount(place, weights=mass * of * p, minlength=seen.size).reshape(seen.shape)[..., 0]
        return np.concatenate([seen.ravel(), expected.ravel()])

    def refine(self, sums: np.ndarray) -> None:
        """Where ones were seen more or less often than expected, predictions move by the difference."""
        seen, expected = np.split(sums, [2 * MAP[0] * MAP[1]])
        seen, expected = seen.reshape(*MAP, 2), expected.reshape(MAP)
        yes, no = (seen[..., 1] + 8) / (expected + 8), (seen[..., 0] + 8) / (seen.sum(axis=-1) - expected + 8)
        self.map = np.log(yes / no)

    def log10(self, words: Range, at, every, kind, tables) -> np.ndarray:
        """The logarithm of the probability of each row's word after its kind."""
        branches, predicted = Branches(words, np.arange(len(words.size))), kept_predictions(tables, 0)
        cost, out = np.zeros(branches.at[-1]), np.zeros(len(words.size))
        for some in branches.some(SCORED_BITS):
            bits = Bits(words, branches, some, at, every, kind)
            x, gate = bits.inputs(predicted, 0)
            mixed = _mixed(x, gate, self.weights)
            knot, share = _steps(mixed)
            knot += bits.place * MAP[1]
            moved = (1 - share) * self.map.ravel()[knot] + share * self.map.ravel()[knot + 1]
            final = np.clip(mixed + moved, -float(_LIMIT), float(_LIMIT))
            np.negative(final, where=bits.bit == 1, out=final)
            cost[bits.at] = np.log1p(np.exp(final))
        out[branches.rows] = -branches.along(cost) / math.log(10)
        return out


# --- over all ranges ---------------------------------------------------------------------------


def _bits_shared(a: bytes, b: bytes) -> int:
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return 8 * i + 7 - int(math.log2(x ^ y))
    return 8 * min(len(a), len(b))


def _neighbours(edges: list, sums: dict[int, tuple]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each range, what the ranges before and after add, by bits shared with its first and last key."""
    out = {}
    for way in (1, -1):
        order = edges if way == 1 else edges[::-1]
        carried, key = np.zeros((1 + KINDS, 1)), b""
        for number, first, last in order:
            near, far = (first, last) if way == 1 else (last, first)
            carried = carried[:, : _bits_shared(key, near) + 1]
            out.setdefault(number, [None, None])[0 if way == 1 else 1] = carried
            # Ranges further on share with this one's far end; those before it count where all of it shares.
            own = sums[number][1 if way == 1 else 0]
            through = min(_bits_shared(first, last), carried.shape[1] - 1)
            carried = np.pad(carried[:, : through + 1], ((0, 0), (0, max(0, own.shape[1] - through - 1))))[:, : own.shape[1]] + own
            key = far
    return {number: tuple(both) for number, both in out.items()}


class LanguageModel:
    """The word table in parts (part, packed (name, seen, score)), ``tokens`` and ``distinct`` of the training texts."""

    def __init__(self, words: DataFrame, training_tokens: int, distinct: int):
        self.words, self.tokens, self.distinct = words, training_tokens, distinct


def _asks(left: pa.Table, right: pa.Table, parts: int) -> pa.Table:
    """(source, part, block, asks, packed): what a block asks of the blocks that have its contexts first, itself among them, and of the parts of the word table.

    To a ``source`` ``packed`` is (place, number of the context in the source, mark) in order of the places, squeezed. A mark is twice the
    number of tokens to the next known context, ``EXPECTED`` at most, and one more if that is the next token's and in the same source.
    To a ``part`` it is the names of the block's words there.
    """
    pa.default_memory_pool().release_unused()
    block, table = left["block"][0].as_py(), unpack(left["packed"][0].as_buffer())
    word, kind, first, vocabulary, _ = tokens(_column(table, "text").cast(pa.large_string()))
    keys, numbers = _keys(vocabulary), _numbers(vocabulary)
    pair, edges = asked(word, kind, numbers, parts)
    names = _named(keys.take(pa.array(pair // KINDS)), pair % KINDS)
    numbers = numbers[word]
    own = Contexts(numbers, first, np.asarray(_column(table, "held_out")))
    source, index = np.full(len(own.values), -1), np.zeros(len(own.values), np.int64)
    for packed in right["packed"]:
        step, of, there = unsqueeze(packed.as_py(), 3)
        at = np.cumsum(step)
        source[at], index[at] = of, there
    # What no other block has first this one may have in an earlier text, or earlier in the text.
    here = np.flatnonzero((source < 0) & (own.origin >= 0))
    source[here], index[here] = block, here
    known = np.flatnonzero((source[own.of] >= 0) & ((source[own.of] != block) | (own.origin[own.of] != own.place)))
    place, of = own.place[known], own.of[known]
    source, index = source[of], index[of]
    end = np.repeat(first[1:], np.diff(first))[place]
    following = np.append(place[1:], len(numbers))[: len(place)]
    joined = (following == place + 1) & (following < end) & (source == np.append(source[1:], -1)[: len(place)])
    mark = 2 * np.minimum(np.minimum(following, end) - place, EXPECTED) + joined
    order = _order(source.astype(np.uint64))
    place, index, mark = place[order], index[order], mark[order]
    sources, low = np.unique(source[order], return_index=True)
    pieces = [slice(a, b) for a, b in zip(low, np.append(low[1:], len(order)))]
    of_parts = [int(part) for part in np.flatnonzero(np.diff(edges))]
    packed = [squeeze(np.diff(place[p], prepend=0), index[p], mark[p]) for p in pieces]
    packed += [pack(pa.table({"name": names.slice(edges[part], edges[part + 1] - edges[part])})) for part in of_parts]
    return pa.table({
        "source": pa.array([*sources.tolist(), *[None] * len(of_parts)], pa.int64()), "part": pa.array([None] * len(pieces) + of_parts, pa.int64()),
        "block": pa.array([block] * len(packed), pa.int64()), "asks": pa.array([p.stop - p.start for p in pieces] + [0] * len(of_parts), pa.int64()),
        "packed": pa.array(packed, pa.binary()),
    })


def _replies(left: pa.Table, right: pa.Table) -> pa.Table:
    """(block, places, next): for what other blocks ask of one, how many words to expect at their places, and these words' numbers.

    None are sent where the next token's context follows in the source too: the word expected is then the one that is there.
    """
    pa.default_memory_pool().release_unused()
    out = {"block": [], "places": [], "next": []}
    if len(left) and len(right):
        table = unpack(left["packed"][0].as_buffer())
        numbers, first = numbered(_column(table, "text").cast(pa.large_string()))
        own = Contexts(numbers, first, np.asarray(_column(table, "held_out")))
    for block, packed in zip(right["block"].to_pylist(), right["packed"]):
        step, index, mark = unsqueeze(packed.as_py(), 3)
        at = own.origin[index]
        end = first[np.searchsorted(first, at, side="right")]
        implied = (mark & 1 > 0) & (np.append(at[1:], -1)[: len(at)] == at + 1)
        size = np.where(implied, 0, np.minimum(mark >> 1, end - at))
        bounds = np.append(0, np.cumsum(size))
        words = numbers[np.arange(bounds[-1]) + np.repeat(at - bounds[:-1], size)]
        for name, value in zip(out, (block, squeeze(step, size), squeeze(words.astype(np.uint32)))):
            out[name].append(value)
    return pa.table({"block": pa.array(out["block"], pa.int64()), "places": pa.array(out["places"], pa.binary()), "next": pa.array(out["next"], pa.binary())})


def block_asks(blocks: DataFrame, counted: DataFrame, parts: int) -> DataFrame:
    """(source, part, block, asks, packed): what all blocks ask of each other, and of the parts of the word table."""
    told = counted.where(F.col("kind") == KINDS).select("block", F.col("key").alias("packed"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _asks(left, right, parts)

    asks = blocks.groupBy("block").cogroup(told.groupBy("block"))
    return written(asks.applyInArrow(run, "source long, part long, block long, asks long, packed binary"))


def expectations(blocks: DataFrame, asks: DataFrame) -> DataFrame:
    """(block, places, next): for every context of a block that a training text has too, the words that follow in the first that has it."""
    asks = asks.where("source IS NOT NULL")
    # A block that very many contexts are asked of is copied, so that no task gets all of them. One row per block.
    copies = F.ceil(F.sum("asks") / ASKED_ROWS).cast("int").alias("copies")
    copies = F.broadcast(written(asks.groupBy("source").agg(copies)))
    asked = asks.join(copies, "source").select("source", F.pmod(F.xxhash64("block"), "copies").cast("int").alias("copy"), "block", "packed")
    sources = blocks.withColumnRenamed("block", "source").join(copies, "source")
    sources = sources.select("source", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "packed")
    replies = sources.groupBy("source", "copy").cogroup(asked.groupBy("source", "copy"))
    return written(replies.applyInArrow(_replies, "block long, places binary, next binary"))


def expected_words(numbers: np.ndarray, told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(expected, there) for each token: the number of the word expected, and whether one is."""
    expected, there = np.zeros(len(numbers), np.int32), np.zeros(len(numbers), bool)
    for places, words in zip(told["places"], told["next"]):
        step, size = unsqueeze(places.as_py(), 2)
        place, words = np.cumsum(step), unsqueeze(words.as_py(), 1)[0].astype(np.uint32).view(np.int32)
        same = place[size == 0]
        expected[same], there[same] = numbers[same].astype(np.int32), True
        # From a known context to the next: the nearest before a token counts.
        at = np.arange(len(words)) + np.repeat(place - np.cumsum(size) + size, size)
        expected[at], there[at] = words, True
    return expected, there


def follow(numbers: np.ndarray, first: np.ndarray, told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(chance, hit) for each token: the probability that it is the word expected, 0 where none is, and whether it is."""
    expected, there = expected_words(numbers, told)
    hit = there & (expected == numbers.astype(np.int32))
    token = np.arange(len(numbers))
    start = np.repeat(first[:-1], np.diff(first))
    last_break = np.maximum.accumulate(np.where(hit, -1, token))
    before = np.append(-1, last_break[:-1])
    streak = token - 1 - np.maximum(before, start - 1)
    expected_before = np.append(False, there[:-1]) & (token > start)
    state = np.where(streak > 0, 2 + (streak >= 4) + (streak >= 16), expected_before.astype(np.int64))
    # Hits and misses of the same state earlier in the text.
    which = np.flatnonzero(there)
    key = start[which] * len(TRIALS) + state[which]
    order = _order(key.astype(np.uint64))
    hits = hit[which][order].astype(np.float64)
    head = np.append(True, key[order][1:] != key[order][:-1]) if len(order) else np.zeros(0, bool)
    group = np.cumsum(head) - 1
    begin = np.flatnonzero(head)[group] if len(order) else group
    sums = np.cumsum(hits) - hits
    came, tried = sums - sums[begin], np.arange(len(order)) - begin
    prior = TRIALS[state[which][order]]
    chance = np.zeros(len(numbers))
    chance[which[order]] = (came + prior[:, 0]) / (tried + prior.sum(axis=1))
    return chance, hit


def learn(counted: DataFrame, parts: int) -> LanguageModel:
    """Learn and score the words of a word table, of which those not seen are only scored.

    The words are dealt out once by ranges of about ``RANGE_ROWS``; each range is written as one row. The
    driver gets the first and last word of each range with the counts of the bits that ranges
    share, the hashed tables, whose size is fixed, and the sums that give the weights.
    """
    spark, table = counted.sparkSession, counted.where(F.col("kind") < KINDS)
    total, train, distinct = table.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(c), F.lit(0)) for c in ("seen", "fresh")]).first()

    def pack_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if len(batch)]
        if held:
            words = Range(pa.Table.from_batches(held))
            cells = _by_order(*_slot_counts(words, np.flatnonzero(words.seen > 0)))
            ends = [words.keys[i].as_py() for i in (0, len(words.keys) - 1)]
            yield pa.record_batch(
                [pa.array([TaskContext.get().partitionId()]), pa.array([ends[0]]), pa.array([ends[1]]), pa.array([pack(words.table)]),
                 pa.array([cells], pa.list_(pa.binary()))],
                names=["number", "first", "last", "packed", "cells"],
            )

    ranges = table.select("key", "kind", "seen").repartitionByRange(max(1, -(-total // RANGE_ROWS)), "key")
    schema = "number long, first binary, last binary, packed binary, cells array<binary>"
    ranges = written(ranges.mapInArrow(pack_range, schema))
    edges = sorted((r["number"], bytes(r["first"]), bytes(r["last"])) for r in ranges.select("number", "first", "last").collect())
    depth = {number: [0, 0] for number, _, _ in edges}
    for (a, _, last), (b, first, _) in zip(edges, edges[1:]):
        depth[a][1] = depth[b][0] = _bits_shared(last, first)

    def over_ranges(work, schema: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, packed in zip(batch["number"].to_pylist(), batch["packed"]):
                    yield from work(number, Range(unpack(packed.as_buffer())))

        # Each range is a file of its own, and Spark deals files out over all cores: ranges need no shuffle for each pass.
        return ranges.select("number", "packed").mapInArrow(run, schema)

    def meet(number: int, words: Range) -> Iterator[pa.RecordBatch]:
        head, tail = words.ends(*depth[number])
        yield pa.record_batch([pa.array([number]), pa.array([head.ravel()], pa.list_(pa.float64())), pa.array([tail.ravel()], pa.list_(pa.float64()))], names=["number", "head", "tail"])

    met = over_ranges(meet, "number long, head array<double>, tail array<double>").collect()
    beside = _neighbours(edges, {r["number"]: tuple(np.array(r[x]).reshape(1 + KINDS, -1) for x in ("head", "tail")) for r in met})
    tables = np.zeros((len(ORDERS), 2, SLOTS), np.float32)
    groups = F.pmod("number", F.lit(math.isqrt(len(edges)) + 1))
    # The tables of ranges are added up in groups, those of the groups once more.
    cells = ranges.select("number", F.posexplode("cells").alias("order", "cells"))
    cells = cells.groupBy("order", groups).applyInArrow(_total_cells, "order int, cells binary")
    for row in cells.groupBy("order").applyInArrow(_total_cells, "order int, cells binary").collect():
        slot, one, zero = unpack(bytes(row["cells"])).columns
        tables[row["order"], 0, slot], tables[row["order"], 1, slot] = one, zero
    shared = spark.sparkContext.broadcast((beside, tables))

    def summed(work, size: int) -> np.ndarray:
        """The sums that ``work`` gives for all ranges, one row for each; they are added up in groups, and the groups here."""

        def run(number: int, words: Range) -> Iterator[pa.RecordBatch]:
            beside, tables = shared.value
            out = work(words, *words.counts(*beside[number]), tables)
            yield pa.record_batch([pa.array([number]), pa.array([out], pa.list_(pa.float64()))], names=["number", "x"])

        def total(group: pa.Table) -> pa.Table:
            return pa.table({"x": pa.array([sum(np.asarray(x.values) for x in group["x"])], pa.list_(pa.float64()))})

        sums = over_ranges(run, "number long, x array<double>").groupBy(groups).applyInArrow(total, "x array<double>").collect()
        return sum((np.array(r["x"]) for r in sums), np.zeros(size))

    mixer = Mixer(summed(learn_range, GATES * FEATURES * (FEATURES + 1)))
    mixer.refine(summed(mixer.map_range, MAP[0] * MAP[1] * 3))

    def score(number: int, words: Range) -> Iterator[pa.RecordBatch]:
        beside, tables = shared.value
        found = mixer.log10(words, *words.counts(*beside[number]), tables)
        keys = words.keys.cast(pa.binary())
        scored = pa.table({"name": _named(keys, words.kind), "seen": words.word_seen.astype(np.int64), "score": found.astype(np.float32)})
        part = _part_of(keys, parts).astype(np.int64)
        scored, part = scored.take(pa.array(np.argsort(part, kind="stable"))), np.sort(part)
        for own in np.unique(part):
            low, high = np.searchsorted(part, [own, own + 1])
            yield pa.record_batch([pa.array([int(own)]), pa.array([pack(scored.slice(low, high - low))])], names=["part", "packed"])

    return LanguageModel(materialize(over_ranges(score, "part long, packed binary")), train, distinct)


def _slot_counts(words: Range, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, ones, zeros) of the hashed tables, each row of ``rows`` counted as often as it was seen."""
    branches, found = Branches(words, rows), []
    mass = branches.mass()
    for i, order in enumerate(ORDERS):
        counts = np.zeros(2 * SLOTS)
        for some in branches.some(4 * STEP_BITS):
            bits = Bits(words, branches, some, None, None, None, [order])
            counts += np.bincount(2 * bits.slot[0] + bits.bit, weights=mass[bits.at], minlength=2 * SLOTS)
        zeros, ones = counts.reshape(SLOTS, 2).T
        slot = np.flatnonzero(zeros + ones)
        found.append((i * SLOTS + slot, ones[slot].astype(np.int64), zeros[slot].astype(np.int64)))
    return tuple(np.concatenate(column) for column in zip(*found))


def _by_order(slot: np.ndarray, one: np.ndarray, zero: np.ndarray) -> list[bytes]:
    """For each order its part of the hashed tables, packed."""
    edges = np.searchsorted(slot, np.arange(len(ORDERS) + 1) * SLOTS)
    # Steps from one slot to the next are small and take less space than slots.
    step = lambda a, b: np.diff(slot[a:b] % SLOTS, prepend=0).astype(np.int32)
    return [pack(pa.table({"step": step(a, b), "one": one[a:b], "zero": zero[a:b]})) for a, b in zip(edges, edges[1:])]


def _total_cells(group: pa.Table) -> pa.Table:
    """The packed tables of one order, those of ranges or sums of them, added up."""
    sums = np.zeros((2, SLOTS), np.int64)
    for packed in group["cells"]:
        cells = unpack(packed.as_buffer())
        slot, *counts = (np.asarray(column) for column in cells.columns)
        sums[:, np.cumsum(slot) if "step" in cells.column_names else slot] += counts
    slot = np.flatnonzero(sums.any(axis=0))
    cells = pa.table({"slot": slot.astype(np.int32), "one": sums[0, slot], "zero": sums[1, slot]})
    return pa.table({"order": group["order"][:1], "cells": pa.array([pack(cells)], pa.binary())})


def score_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every row with an id.

    Of ``docs`` (doc_id, text), the texts whose crc32(doc_id as text) mod 7 is not 2 are learned from,
    all are scored, whole. Tokens are the words, A-Z as a-z, and one end. ``score`` is the model's log10
    probability of the text, ``base_score`` that of its tokens by their counts alone, one added to
    each: log10((c + 1) / (N + V + 1)).

    Texts are written once in blocks, where each has its place, so that repeated rows and ids are scored one
    by one. A null text is an empty one, an end only. Rows with a null id are left out. Without training texts
    all counts are 0. Other columns are not read.
    """
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    blocks = block_table(texts(docs).select("doc_id", "text", held_out.alias("held_out")))
    parts = max(1, -(-blocks.count() // BLOCKS_PER_PART))
    counted = written(word_table(blocks, parts))
    asks = block_asks(blocks, counted, parts)
    told = expectations(blocks, asks)
    model = learn(counted, parts)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return pa.table({"block": left["block"], "part": left["part"], "packed": left["packed"]})
        words = pa.concat_tables([unpack(packed.as_buffer()) for packed in right["packed"]])
        # All asks are looked up at once, as the table of names is built for each call.
        names = _column(words, "name")
        asks = [_column(unpack(packed.as_buffer()), "name") for packed in left["packed"]]
        at, out, low = pc.index_in(pa.concat_arrays(asks), value_set=names), [], 0
        for ask in asks:
            out.append(pack(words.select(["seen", "score"]).take(at.slice(low, len(ask)))))
            low += len(ask)
        return pa.table({"block": left["block"], "part": left["part"], "packed": pa.array(out, pa.binary())})

    asks = asks.where("part IS NOT NULL").select("part", "block", "packed")
    answers = asks.groupBy("part").cogroup(model.words.groupBy("part")).applyInArrow(answer, "block long, part long, packed binary")
    told = answers.unionByName(told, allowMissingColumns=True)
    train, every = model.tokens, model.tokens + model.distinct + 1

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        table = unpack(left["packed"][0].as_buffer())
        word, kind, first, vocabulary, n_bytes = tokens(_column(table, "text").cast(pa.large_string()))
        expected, answers = right.filter(pc.is_valid(right["places"])), right.filter(pc.is_valid(right["part"])).sort_by("part")
        numbers = _numbers(vocabulary)
        pair, _ = asked(word, kind, numbers, parts)
        heard = pa.concat_tables([unpack(packed.as_buffer()) for packed in answers["packed"]])
        seen, of = np.asarray(heard["seen"]), np.zeros(len(vocabulary) * KINDS, np.int64)
        of[pair] = np.arange(len(pair))
        of = of[word * KINDS + kind]
        alone, mixed = np.log10((seen + 1) / every)[of], np.asarray(heard["score"]).astype(np.float64)[of]
        chance, hit = follow(numbers[word], first, expected)
        some = np.flatnonzero(chance)
        chance, hit, spelled = chance[some], hit[some], mixed[some]
        mixed[some] = np.where(hit, np.log10(chance + (1 - chance) * 10.0 ** np.maximum(spelled, -300)), spelled + np.log10(1 - chance))
        each = [alone, mixed, (seen > 0).astype(float)[of]]
        base, scores, known = (np.add.reduceat(x, first[:-1]) for x in each)
        return pa.table({
            "doc_id": _column(table, "doc_id"), "held_out": _column(table, "held_out"), "n_tokens": pa.array(np.diff(first).astype(np.int64)),
            "n_known": pa.array(known.astype(np.int64)), "train_tokens": pa.array(np.full(len(n_bytes), train)),
            "base_score": pa.array(base), "score": pa.array(scores), "n_bytes": pa.array(n_bytes),
            "bits_per_byte": pa.array(-scores * math.log2(10) / n_bytes),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(add, schema)
