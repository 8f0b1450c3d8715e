"""Periodic runs of words, by recompression.

The words of some texts become a run-length grammar: rounds of block compression (a stretch of one
symbol becomes a symbol) and of pair compression (symbols are parted in two sides, and a left one
followed by a right one becomes a symbol) alternate, so that equal stretches of text get equal
symbols but for few at their ends. Longest common extensions are read off the grammar: equal
symbols are skipped whole, from the lowest level up and, past the first difference, down again.
A run of period q and of 2 q words or more holds two neighbours of the grid 0, q, 2 q, ...; all
grids of a text have about n log n places, and the extensions of a place to both sides give its run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronotext.llm.common import slices, texts
from chronotext.llm.hashing import mix, word_places

#: A run has this many words at least, and twice its period.
LEAST_WORDS = 12
#: Places of the grids that are looked at together.
GRID_ROWS = 1 << 20
_ROUNDS = 64

RUN = "array<struct<start:long,length:long,period:long>>"
_RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


# --- the grammar -------------------------------------------------------------------------------


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Equal keys as equal numbers from 0."""
    return pd.factorize(keys)[0].astype(np.int64)


class Grammar:
    """The levels of a sequence of symbols, looked up by the places where symbols begin or end.

    A place where a symbol of some level begins is one where symbols of all lower levels begin, so
    the symbols of a place are stored in a row: their numbers, lengths and how often each
    is repeated from there on.
    """

    def __init__(self, symbols: np.ndarray, least: int = 1):
        """Compress until ``least`` symbols are left, or nothing is left to compress."""
        n = len(symbols)
        levels, starts, now = [], np.arange(n), _ranks(symbols)
        for number in range(2 * _ROUNDS):
            head = np.flatnonzero(np.append(True, now[1:] != now[:-1])) if number % 2 == 0 else None
            levels.append((starts, now, head))
            if len(now) <= least:
                break
            if head is not None:
                count = np.diff(np.append(head, len(now)))
                starts, now = starts[head], _ranks(now[head] * (int(count.max()) + 1) + count)
            else:
                # No symbol is followed by itself here, so pairs of a left and a right one do not overlap.
                left = (mix(now.astype(np.uint64) + np.uint64(number * 0x9E3779B9)) >> np.uint64(17) & np.uint64(1)).astype(bool)
                pair = np.flatnonzero(left[:-1] & ~left[1:])
                second = np.zeros(len(now), bool)
                second[pair + 1] = True
                follow = np.full(len(now), -1)
                follow[pair] = now[pair + 1]
                starts, now = starts[~second], _ranks((now * (int(now.max()) + 2) + follow + 1)[~second])
        self.ahead = _Side(n, levels, False)
        self.behind = _Side(n, levels, True)

    def extend(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The words that the sequence has in common from ``i`` and from ``j`` on."""
        return self.ahead.common(i, j, 1)

    def extend_back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The words that the sequence has in common up to ``i`` and up to ``j``, these left out."""
        return self.behind.common(i, j, -1)


class _Side:
    """The symbols of all levels by where they begin, or by where they end."""

    def __init__(self, n: int, levels: list, back: bool):
        self.top = np.full(n + 1, -1, np.int16)
        for t, (starts, _, _) in enumerate(levels):
            # A place in between two symbols is the end of one and the start of the other.
            self.top[starts if not back else np.append(starts[1:], n)] = t
        self.base = np.cumsum(self.top + 1, dtype=np.int64) - (self.top + 1)
        size = int((self.top.astype(np.int64) + 1).sum())
        self.symbol = np.empty(size, np.int64)
        self.length = np.empty(size, np.int32)
        self.repeats = np.ones(size, np.int32)
        for t, (starts, symbols, head) in enumerate(levels):
            ends = np.append(starts[1:], n)
            at = self.base[ends if back else starts] + t
            self.symbol[at] = symbols
            self.length[at] = ends - starts
            if head is not None:
                count = np.diff(np.append(head, len(symbols)))
                since = np.arange(len(symbols)) - np.repeat(head, count)
                self.repeats[at] = since + 1 if back else np.repeat(count, count) - since

    def common(self, i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        who = np.arange(len(i))
        level = np.zeros(len(i), np.int64)
        cap = np.full(len(i), np.iinfo(np.int16).max, np.int64)
        a, b = i.astype(np.int64), j.astype(np.int64)
        while len(who):
            # A place without a symbol is an end of the sequence.
            inside = np.minimum(self.top[a], self.top[b]) >= 0
            if not inside.all():
                who, level, cap, a, b = (x[inside] for x in (who, level, cap, a, b))
            x, y = self.base[a] + level, self.base[b] + level
            same = self.symbol[x] == self.symbol[y]
            step = np.where(same, np.minimum(self.repeats[x], self.repeats[y]).astype(np.int64) * self.length[x], 0)
            out[who] += step
            a, b = a + way * step, b + way * step
            cap = np.where(same, cap, level - 1)
            top = np.minimum(self.top[a], self.top[b])
            level = np.where(same, np.maximum(np.minimum(np.minimum(level + 1, cap), top), 0), level - 1)
            going = cap >= 0
            if not going.all():
                who, level, cap, a, b = (x[going] for x in (who, level, cap, a, b))
        return out


# --- runs --------------------------------------------------------------------------------------


def _grid(first: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the grids of texts that begin at ``first`` and have ``sizes`` words, in portions."""
    periods = sizes // 2
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    places = (sizes[text] - 1) // period
    total = np.cumsum(places)
    low = 0
    while low < len(text):
        done = total[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(total, done + GRID_ROWS, side="right")))
        count = places[low:high]
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        q = np.repeat(period[low:high], count)
        yield np.repeat(first[text[low:high]], count) + step * q, q
        low = high


def runs_of(words: np.ndarray, first: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of texts, by start and period, as places in ``words``.

    ``words`` are the numbers of the words of all texts, one after the other; text ``i`` has those from
    ``first[i]`` to ``first[i + 1]``.
    """
    sizes = np.diff(first)
    symbols, begin = _marked(words, first)
    long_enough = sizes >= least
    places, periods = [], []
    for i, q in _grid(begin[long_enough], sizes[long_enough]):
        same = symbols[i] == symbols[i + q]
        i, q = i[same], q[same]
        if least >= 6:
            # As many words as the period, and 3 at least, equal those a period on: the place is one of three such in a row.
            near = [symbols[i + d] == symbols[i + q + d] for d in (-2, -1, 1, 2)]
            same = near[1] & (near[0] | near[2]) | near[2] & near[3]
            i, q = i[same], q[same]
        places.append(i)
        periods.append(q)
    i, q = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, periods))
    if not len(i):
        return (np.zeros(0, np.int64),) * 3
    # The grammar is that of the texts with such places.
    text = np.searchsorted(begin, i, side="right") - 1
    chosen = np.unique(text)
    begin_of, ends = first[chosen], np.cumsum(sizes[chosen])
    part = words[np.arange(int(ends[-1])) + np.repeat(begin_of - (ends - sizes[chosen]), sizes[chosen])]
    part, at = _marked(part, np.append(0, ends))
    which = np.searchsorted(chosen, text)
    i = i - begin[text] + at[which]
    grammar = Grammar(part, len(chosen))
    ahead, behind = grammar.extend(i, i + q), grammar.extend_back(i, i + q)
    run = ahead + behind + q >= np.maximum(least, 2 * q)
    shift = (first[text] - at[which])[run]
    start, end, q = (i - behind)[run] + shift, (i + q + ahead)[run] + shift, q[run]
    # Periods that one run has are multiples of its smallest.
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    once = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])) if len(start) else np.zeros(0, bool)
    start, end, q = start[once], end[once], q[once]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def _marked(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with a mark that occurs nowhere else before them all and after each text, two at the end; where texts begin."""
    sizes = np.diff(first)
    number = np.arange(len(sizes))
    marks = np.concatenate([[0], first[1:] + number + 1, [len(words) + len(sizes) + 1]])
    symbols = np.empty(len(words) + len(marks), np.int64)
    symbols[np.arange(len(words)) + np.repeat(number, sizes) + 1] = words
    symbols[marks] = int(words.max(initial=0)) + 1 + np.arange(len(marks))
    return symbols, first[:-1] + number + 1


def _collapsed(data: np.ndarray, lengths: np.ndarray, first: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space; ``data`` are the bytes of all words."""
    data = data[np.repeat(kept, lengths)]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[kept]
    lengths = lengths[kept]
    spaced = np.append(False, text[1:] == text[:-1]) if len(text) else np.zeros(0, bool)
    spaces = np.cumsum(spaced)
    out = np.full(len(data) + int(spaced.sum()), 0x20, np.uint8)
    out[np.arange(len(data)) + np.repeat(spaces, lengths)] = data
    bounds = np.zeros(len(first), np.int64)
    np.cumsum(np.bincount(text, weights=lengths + spaced, minlength=len(first) - 1), out=bounds[1:])
    return pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(out)]).cast(pa.string())


def _slice_runs(data: np.ndarray, offsets: np.ndarray, least: int) -> list[pa.Array]:
    """n_words, runs and collapsed text of some texts, given as bytes."""
    starts, ends, first = word_places(data, offsets)
    lengths = ends - starts
    bounds = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=bounds[1:])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    bytes_ = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(bytes_)])
    words = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    start, end, q = runs_of(words, first, least)
    text = np.searchsorted(first, start, side="right") - 1
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + q, 1)
    np.add.at(change, end, -1)
    kept = np.cumsum(change[:-1]) == 0
    runs = pa.StructArray.from_arrays([pa.array(start - first[text]), pa.array(end - start), pa.array(q)], fields=list(_RUN_TYPE))
    edges = np.searchsorted(text, np.arange(len(first))).astype(np.int32)
    return [pa.array(np.diff(first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(edges), runs), _collapsed(bytes_, lengths, first, kept)]


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of ``docs`` (doc_id, text) with an id.

    A word is a run of bytes other than space and 0x09 to 0x0D. ``runs`` are all stretches of words
    with a smallest period q (words q apart are equal), of at least ``least`` and 2 q words, that
    cannot be made longer, as (start, length, period) by start and period. ``collapsed`` is the
    text without the words that follow the first q of a run, the others joined by one space.

    Each whole text is worked on where it is read, without a shuffle, in memory in proportion to it.
    A null text is an empty one: no words, no runs, empty. Repeated rows give one row each; rows with a
    null id are left out; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"]
            for low, high, data, offsets in slices(batch["text"]):
                yield pa.record_batch([ids[low:high], *_slice_runs(data, offsets, least)], names=["doc_id", "n_words", "runs", "collapsed"])

    return texts(docs).mapInArrow(run, f"doc_id long, n_words long, runs {RUN}, collapsed string")


def longest_run(runs) -> F.Column:
    """Of an array of runs the longest; of equal ones the first, then that of the smallest period."""
    least = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.when(least.isNotNull(), F.struct(least["start"].alias("start"), (-least["n"]).alias("length"), least["period"].alias("period")))
