"""Context mixing: counts and base scores against plain counting, probabilities, held-out texts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from chronotext.llm import mixing

DOC = "doc_id long, text string, row string, seen int, score string, block string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], DOC)


def words_of(text):
    lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return [w for w in re.split("[ \t-\r]+", lowered) if w] + [""]


def held_out(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def corpus(seed, size):
    rng = random.Random(seed)
    syllables = "ba be bi do du ka ko ré mi na".split()
    vocabulary = ["".join(rng.choices(syllables, k=rng.choice([1, 1, 2, 2, 3, 4]))) for _ in range(400)]
    weights = [1 / (i + 1) for i in range(400)]

    def sentence():
        words = rng.choices(vocabulary, weights, k=rng.randint(3, 12))
        words[-1] += rng.choice([".", ".", "!", ","])
        return " ".join(words).capitalize()

    rows = [(i, " ".join(sentence() for _ in range(rng.randint(1, 8)))) for i in range(size)]
    return rows + [(size + i, t) for i, (_, t) in enumerate(rng.choices(rows, k=size // 8))]


def test_tokens_counts_and_base_scores(spark):
    rows = corpus(1, 200) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "ÉA éa"), (1003, "ÉA éa"), (1003, "other words"), (2**53 + 1, "x"), (None, "gone")]
    kept = [(i, words_of(t)) for i, t in rows if i is not None]
    seen = Counter(w for i, words in kept if not held_out(i) for w in words)
    total, distinct = sum(seen.values()), len(seen)
    want = sorted(
        (i, held_out(i), len(words), sum(seen[w] > 0 for w in words), total, round(sum(math.log10((seen[w] + 1) / (total + distinct + 1)) for w in words), 6))
        for i, words in kept
    )
    got = mixing.score_texts(documents(spark, rows)).collect()
    assert sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    for r in got:
        assert r["score"] < 0 and math.isclose(r["bits_per_byte"], -r["score"] * math.log2(10) / r["n_bytes"])
        assert r["n_bytes"] >= r["n_tokens"]
    same = [r["score"] for r in got if r["doc_id"] == 1003]
    assert len(same) == 3 and len(set(same)) == 2


def test_held_out_texts_are_likelier_than_by_their_words_alone(spark):
    got = mixing.score_texts(documents(spark, corpus(2, 1500))).where("held_out").collect()
    assert len(got) > 100 and sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    noise = mixing.score_texts(documents(spark, corpus(2, 300) + [(9002, "xqz wvj qqq zxv")])).where("doc_id = 9002").first()
    assert noise["bits_per_byte"] > 1.5 * np.median([r["bits_per_byte"] for r in got])


def test_empty_tables_and_no_training_texts(spark):
    assert mixing.score_texts(documents(spark, [])).collect() == []
    only = next(i for i in range(100) if held_out(i))
    row = mixing.score_texts(documents(spark, [(only, "a b")])).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0) and row["score"] < -1


def ranges(table, cuts):
    """The ranges of a sorted table, their edges and what their neighbours add, as the job passes it on."""
    parts = [mixing.Range(table.slice(a, b - a)) for a, b in zip([0, *cuts], [*cuts, len(table)])]
    edges = [(i, p.keys[0].as_py(), p.keys[len(p.keys) - 1].as_py()) for i, p in enumerate(parts)]
    depth = {i: [0, 0] for i in range(len(parts))}
    for (a, _, last), (b, first, _) in zip(edges, edges[1:]):
        depth[a][1] = depth[b][0] = mixing._bits_shared(last, first)
    return parts, mixing._neighbours(edges, {i: p.ends(*depth[i]) for i, p in enumerate(parts)})


@pytest.mark.parametrize("seed", range(8))
def test_counts_of_ranges_equal_counts_of_all_words(seed):
    rng = random.Random(seed)
    keys = {"".join(rng.choices("ab\x01é", k=rng.randint(1, 6))).encode() + b" " for _ in range(60)} | {b"\n", b"aaaaaaaaaaaaaaa "}
    rows = sorted({(k, rng.randrange(3)): rng.randrange(4) for k in keys for _ in range(2)}.items())
    table = pa.table({"key": [k for (k, _), _ in rows], "kind": pa.array([k for (_, k), _ in rows], pa.int8()), "seen": [n for _, n in rows]})
    bits = ["".join(f"{b:08b}" for b in k) for (k, _), _ in rows]
    # Rows of one key stay in one range.
    places = [i for i in range(1, len(rows)) if rows[i][0][0] != rows[i - 1][0][0]]
    parts, beside = ranges(table, sorted(rng.sample(places, rng.choice([0, 1, 3, 12]))))
    low = 0
    for number, part in enumerate(parts):
        at, every, kind = part.counts(*beside[number])
        for j in range(len(part.size)):
            own = bits[low + j]
            for d in range(len(own) + 1):
                like = [(k, n) for b, ((_, k), n) in zip(bits, rows) if b.startswith(own[:d])]
                assert every[at[j] + d] == sum(n for _, n in like)
                assert kind[at[j] + d] == sum(n for k, n in like if k == rows[low + j][0][1])
        low += len(part.size)


def test_probabilities_of_all_words_sum_to_no_more_than_one():
    """The words of one and two letters of a small alphabet, and the end, after each kind."""
    rng = random.Random(4)
    letters = "abcdefgh"
    words = sorted([a + b for a in letters for b in ["", *letters]])
    table = pa.table({
        "key": [w.encode() + b" " for w in words for _ in range(3)] + [b"\n"] * 3, "kind": pa.array([0, 1, 2] * (len(words) + 1), pa.int8()),
        "seen": [rng.choice([0, 0, 1, 5, 200]) for _ in range(3 * len(words) + 3)],
    })
    part = mixing.Range(table)
    counts = part.counts(np.zeros((4, 1)), np.zeros((4, 1)))
    tables = np.zeros((len(mixing.ORDERS), 2, mixing.SLOTS), np.float32)
    slot, one, zero = mixing._slot_counts(part, np.flatnonzero(part.word_seen > 0))
    order, slot = np.divmod(slot, mixing.SLOTS)
    tables[order, 0, slot], tables[order, 1, slot] = one, zero
    mixer = mixing.Mixer(mixing.learn_range(part, *counts, tables))
    mixer.refine(mixer.map_range(part, *counts, tables))
    p = 10 ** mixer.log10(part, *counts, tables)
    sums = [p[part.kind == k].sum() for k in range(3)]
    assert max(sums) <= 1 + 1e-9 and min(sums) > 0.7


def test_copies_are_expected_word_by_word(spark):
    """A held-out copy of a training text costs less than half of what its words cost alone."""
    rng = random.Random(6)
    train = [i for i in range(400) if not held_out(i)][:60]
    copy = next(i for i in range(400, 500) if held_out(i))
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(200))) for i in train]
    got = {r["doc_id"]: r for r in mixing.score_texts(documents(spark, rows + [(copy, rows[7][1])])).collect()}
    assert got[copy]["score"] > 0.5 * got[copy]["base_score"]
    # The first of the two was not foretold by the second.
    assert got[rows[7][0]]["score"] < 0.8 * got[rows[7][0]]["base_score"]


def test_hashed_tables_count_every_occurrence():
    """A slot holds how often its bits came in the training words, not in how many different words."""
    part = mixing.Range(pa.table({"key": [b"a ", b"a ", b"ab ", b"c "], "kind": pa.array([0, 2, 1, 2], pa.int8()), "seen": [3, 40, 5, 0]}))
    slot, one, zero = mixing._slot_counts(part, np.flatnonzero(part.seen > 0))
    counts = Counter()
    for key, n in ((b"a ", 43), (b"ab ", 5)):
        for i, byte in enumerate(key):
            for j, bit in enumerate(f"{byte:08b}"):
                for order in mixing.ORDERS:
                    counts[order, key[max(0, i - order) : i], i < order and i, f"{byte:08b}"[:j], bit] += n
    bits = lambda value: sorted(n for key, n in counts.items() if key[-1] == value)
    assert sorted(one[one > 0]) == bits("1") and sorted(zero[zero > 0]) == bits("0")
    assert one.sum() + zero.sum() == len(mixing.ORDERS) * 8 * (2 * 43 + 3 * 5)


def test_tables_of_ranges_add_up():
    rng = np.random.default_rng(5)
    slots = [np.sort(rng.choice(4 * mixing.SLOTS, 500, replace=False)) for _ in range(3)]
    counts = [(slot, rng.integers(0, 9, 500), rng.integers(1, 2**40, 500)) for slot in slots]
    packed = [mixing._by_order(*each) for each in counts]
    for order in range(4):
        group = pa.table({"order": pa.array([order] * 3, pa.int32()), "cells": [p[order] for p in packed]})
        got = mixing.unpack(mixing._total_cells(group)["cells"][0].as_py()).to_pylist()
        want = {}
        for slot, one, zero in counts:
            for s, a, b in zip(slot, one, zero):
                if s // mixing.SLOTS == order:
                    before = want.get(s % mixing.SLOTS, (0, 0))
                    want[s % mixing.SLOTS] = (before[0] + a, before[1] + b)
        assert {r["slot"]: (r["one"], r["zero"]) for r in got} == want


def test_blocks_are_cut_inside_large_batches(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_BYTES", 4000)
    rows = [(i, "word " * 40) for i in range(500)]
    frame = documents(spark, rows).coalesce(1).selectExpr("doc_id", "text", "false as held_out")
    tables = [mixing.unpack(bytes(r["packed"])) for r in mixing.block_table(frame).collect()]
    assert max(t.num_rows for t in tables) <= 30 and sorted(i for t in tables for i in t["doc_id"].to_pylist()) == list(range(500))


def test_counts_travel_in_pieces_and_add_up(spark, monkeypatch):
    """Millions of short rows filled the executors' heaps: the counts of some blocks are few rows, which add up to plain counts."""
    monkeypatch.setattr(mixing, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(mixing, "COUNTED_ROWS", 300)
    rows = [(i, t, held_out(i)) for i, t in corpus(7, 300) + [(900, ""), (901, "a b c d e f g h i j k l")]]
    blocks = mixing.block_table(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean"))
    got = mixing.word_table(blocks, 3).toPandas()
    words = got[got["kind"] < mixing.KINDS]
    seen, used = Counter(), Counter()
    for _, text, held in rows:
        before = None
        for word in words_of(text):
            kind = 0 if before is None else 1 if before[-1] in ".!?" else 2
            key = (word.encode() + b" " if word else b"\n", kind)
            used[key] += 1
            seen[key] += not held
            before = word
    want = {key: (seen[key], n) for key, n in used.items()}
    assert len(words) == len(want)
    assert {(bytes(r.key), r.kind): (r.seen, r.used) for r in words.itertuples()} == want
    assert words["fresh"].sum() == len({key for (key, _), n in seen.items() if n})
    contexts = got[got["kind"] == mixing.KINDS]
    assert len(contexts) and (contexts["used"] > 1).all() and (contexts["seen"] > 0).all() and contexts["fresh"].sum() == 0


def test_texts_reach_python_in_small_batches(spark, monkeypatch):
    """Without a setting of the session a batch had up to 10,000 texts; the session's own setting is left as it is."""
    name, sizes = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name, None)
    frame = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "'some words' as text", "false as held_out")
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 1)  # a block then ends with the batch
    try:
        for setting in (None, "200"):
            spark.conf.unset(name) if setting is None else spark.conf.set(name, setting)
            sizes.append(max(mixing.unpack(bytes(r["packed"])).num_rows for r in mixing.block_table(frame).collect()))
            assert spark.conf.get(name, None) == setting
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    assert sizes == [mixing.TEXT_ROWS, 200]


def test_predictions_of_kept_tables_are_worked_out_once(monkeypatch):
    """A worker has many ranges of one model; other tables and other uses of them get their own predictions."""
    asked, plain = [], mixing.slot_predictions
    monkeypatch.setattr(mixing, "slot_predictions", lambda tables, once: asked.append(once) or plain(tables, once))
    one = np.arange(len(mixing.ORDERS) * 2 * mixing.SLOTS, dtype=np.float32).reshape(len(mixing.ORDERS), 2, mixing.SLOTS)
    for tables, once in ((one, 1), (one, 1), (one, 0), (one, 0), (one.copy(), 0), (one, 1)):
        assert np.array_equal(mixing.kept_predictions(tables, once), plain(tables, once))
    assert asked == [1, 0, 0, 1]


def syllable_range(seed, size):
    """A range of words that share many first bits, some held out only."""
    rng = random.Random(seed)
    keys = {"".join(rng.choices(["ka", "kab", "o", "é", "x"], k=rng.randint(1, 6))).encode() + b" " for _ in range(size)} | {b"\n"}
    rows = sorted({(k, rng.randrange(3)): rng.choice([0, 1, 1, 3, 50]) for k in keys for _ in range(2)}.items())
    return mixing.Range(pa.table({"key": [k for (k, _), _ in rows], "kind": pa.array([k for (_, k), _ in rows], pa.int8()), "seen": [n for _, n in rows]}))


@pytest.mark.parametrize("seed", range(4))
def test_shared_bits_come_once_with_the_mass_of_all(seed):
    """Each bit of a word was worked out anew, though words of a kind share theirs; once each, they add up to the same, by word and by bit."""
    part = syllable_range(seed, 150)
    rows = np.array(sorted(random.Random(seed).sample(range(len(part.size)), len(part.size) * 3 // 4)))
    branches = mixing.Branches(part, rows)
    mass, plain, found = branches.mass(), Counter(), Counter()
    bits = {r: "".join(f"{b:08b}" for b in part.keys[int(r)].as_py()) for r in rows}
    for r in rows:
        for d in range(len(bits[r])):
            plain[part.kind[r], bits[r][: d + 1]] += part.seen[r]
    cost = np.zeros(len(mass))
    for i, r in enumerate(branches.rows):
        for place in range(branches.at[i], branches.at[i + 1]):
            d = branches.begin[i] + place - branches.at[i]
            cost[place] = zlib.crc32(bits[r][: d + 1].encode())
            if d < branches.fresh[i]:
                assert mass[place] == 0
            else:
                assert (part.kind[r], bits[r][: d + 1]) not in found
                found[part.kind[r], bits[r][: d + 1]] = mass[place]
    assert found == plain and branches.at[-1] < 0.75 * sum(map(len, bits.values()))
    want = [sum(zlib.crc32(bits[r][: d + 1].encode()) for d in range(len(bits[r]))) for r in branches.rows]
    assert np.allclose(branches.along(cost), want, rtol=1e-12)
    assert sorted(np.concatenate(list(branches.some(300)))) == list(range(len(rows)))


def test_nearest_smaller_values_before():
    rng = random.Random(3)
    for n in (0, 1, 2, 60):
        values = np.array([rng.randrange(8) for _ in range(n)], np.int64)
        for or_equal in (False, True):
            want = [max([j for j in range(i) if values[j] < values[i] + or_equal], default=n) for i in range(n)]
            assert list(mixing._smaller(values, or_equal)) == want


def test_ranges_are_not_shuffled_for_each_pass(spark, monkeypatch):
    """Four passes each sent all ranges to other tasks; each is a file that is read where it lies."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 100)
    dealt, plain = [], mixing.DataFrame.repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda self, *a: dealt.append(a) or plain(self, *a))
    got = mixing.score_texts(documents(spark, corpus(8, 200))).collect()
    assert len(got) == 225 and all(r["score"] < 0 for r in got) and not dealt


def test_slots_of_ranges_travel_as_steps():
    """Slots took four bytes of little order each; steps between them pack better."""
    rng = np.random.default_rng(9)
    slot = np.sort(rng.choice(4 * mixing.SLOTS, 200_000, replace=False))
    one = np.ones(len(slot), np.int64)
    cells = pa.table({"slot": (slot % mixing.SLOTS).astype(np.int32), "one": one, "zero": one})
    assert sum(map(len, mixing._by_order(slot, one, one))) < 0.75 * len(mixing.pack(cells))


def plainly_expected(rows):
    """For each text, by place of a token, the word expected: all contexts of the training texts, looked up one by one."""
    texts = [words_of(t) for _, t, _ in rows]
    where = {}
    for i, (words, (_, _, held)) in enumerate(zip(texts, rows)):
        for p in range(mixing.CONTEXT, len(words)):
            if not held:
                where.setdefault(tuple(words[p - mixing.CONTEXT : p]), (i, p))
    for i, words in enumerate(texts):
        out = {}
        for p in range(mixing.CONTEXT, len(words)):
            row, at = where.get(tuple(words[p - mixing.CONTEXT : p]), (i, p))
            if (row, at) != (i, p):
                out = {q: word for q, word in out.items() if q < p}
                out |= {p + j: word for j, word in enumerate(texts[row][at : at + mixing.EXPECTED]) if p + j < len(words)}
        yield out


@pytest.mark.parametrize("parts, asked", [(1, 1 << 22), (5, 40)])
def test_every_context_of_the_training_texts_counts(spark, monkeypatch, parts, asked):
    """Only contexts whose number was a multiple of 16 were looked up, so most passages of six to twenty words were never expected."""
    monkeypatch.setattr(mixing, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(mixing, "COMPARED_ROWS", 100)
    monkeypatch.setattr(mixing, "ASKED_ROWS", asked)
    rng = random.Random(11)
    lines = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(4, 30))) for _ in range(60)]
    texts = [". ".join(rng.choices(lines, k=rng.randint(0, 3)) + [f"w{rng.randrange(9)}" for _ in range(rng.randint(0, 6))]) for _ in range(150)]
    texts += ["", "a b c d e", "a b c d e f", "a b c d e g h", "x x x x x x x x x x", "x x x x x x x"]
    rows = [(i, t, held_out(i)) for i, t in enumerate(texts)]
    blocks = mixing.block_table(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").coalesce(1))
    assert blocks.count() > 5
    told = mixing.expectations(blocks, mixing.block_asks(blocks, mixing.written(mixing.word_table(blocks, parts)), parts)).toPandas()
    want = dict(zip(range(len(rows)), plainly_expected(rows)))
    n_expected = 0
    for row in blocks.collect():
        table = mixing.unpack(bytes(row["packed"]))
        word, _, first, vocabulary, _ = mixing.tokens(table["text"].combine_chunks().cast(pa.large_string()))
        numbers, names = mixing._numbers(vocabulary), [v.decode() for v in vocabulary.to_pylist()]
        by_number = {n: name for n, name in zip(numbers.astype(np.int32), names)}
        own = told[told["block"] == row["block"]]
        expected, there = mixing.expected_words(numbers[word], pa.table({c: pa.array([bytes(x) for x in own[c]], pa.binary()) for c in ("places", "next")}))
        for i, low, high in zip(table["doc_id"].to_pylist(), first, first[1:]):
            assert sorted(np.flatnonzero(there[low:high])) == sorted(want[i])
            n_expected += len(want[i])
            for p, name in want[i].items():
                # A word that the block does not have is one that does not come.
                assert by_number.get(expected[low + p], "") == (name if name in names else "")
    assert n_expected > 1000


def test_numbers_are_squeezed_and_come_back():
    rng = np.random.default_rng(2)
    for n in (0, 1, 1000):
        columns = [np.zeros(n, np.int64), rng.integers(0, 2**62, n), rng.integers(0, 300, n)]
        for got, column in zip(mixing.unsqueeze(mixing.squeeze(*columns), 3), columns):
            assert np.array_equal(got, column)


def test_what_was_shuffled_to_write_a_table_goes_with_the_write(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    assert mixing.written(spark.range(100).repartition(3)).count() == 100
    assert spark.conf.get(name, None) == before
