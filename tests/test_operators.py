"""Operators against hand cases and plain models, also on their paths for large inputs."""

import math
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronotext.functions import text as tx
from chronotext.operators import blocks, gaps, nearest, overlap, topics, words, years
from chronotext.operators.arcs import arcs, parse_year_pairs
from chronotext.session import fits_broadcast, materialize


def lines(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "line_id long, value string")


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def pairs(df):
    return sorted(tuple(row) for row in df.collect())


# --- words -------------------------------------------------------------------------------------


def test_word_count(spark):
    counts = words.count_tokens(texts(spark, "this is a test . this test is short ."), tx.word_tokens("text"))
    assert pairs(counts) == [("a", 1), ("is", 2), ("short", 1), ("test", 2), ("this", 2)]


def test_vocabulary_and_sparse_documents(spark):
    docs = spark.createDataFrame(
        [(0, "1900", "the cat sat"), (1, "1901", "cat's cat 3rd"), (2, "1902", "!!")],
        "doc_id long, year string, text string",
    )
    vocab = materialize(words.vocabulary(docs))
    assert pairs(vocab.select("idx", "token")) == [(0, "cat"), (1, "cat's"), (2, "rd"), (3, "sat")]
    for options in ({}, {"limit": 60, "head": 1}, {"limit": -1, "head": 1, "salts": 3}, {"limit": -1, "head": 0}):
        sparse = words.sparse_documents(docs, vocab, ["doc_id", "year"], **options)
        line = F.concat("year", F.lit("\t"), tx.sparse_line("terms"))
        got = [row[0] for row in sparse.orderBy("doc_id").select(line).collect()]
        assert got == ["1900\t2 0:1 3:1", "1901\t3 0:1 1:1 2:1", "1902\t0 "]


@pytest.mark.parametrize("partitions", ["1", "7", "40"])
def test_frequency_rank_is_the_full_sort_over_any_number_of_partitions(spark, partitions):
    rng = random.Random(3)
    counts = [(f"t{i:04d}", rng.choice([1, 1, 1, 1, 2, 3, 9])) for i in range(500)]
    rng.shuffle(counts)
    df = spark.createDataFrame(counts, "token string, n long").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = words.frequency_rank(df).orderBy("idx").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [(r.token, r.n) for r in got] == sorted(counts, key=lambda c: (-c[1], c[0]))
    assert [r.idx for r in got] == list(range(500))
    assert words.frequency_rank(df.limit(0)).collect() == []


def test_sparse_counts_add_up_with_a_hot_word(spark):
    rng = random.Random(5)
    docs = texts(spark, *(" ".join(rng.choices(["hot"] * 9 + [f"w{c}" for c in "abcdef"], k=30)) for _ in range(60)))
    vocab = materialize(words.vocabulary(docs))
    total = vocab.agg(F.sum("n")).first()[0]
    for options in ({}, {"limit": 100, "head": 2}, {"limit": -1, "head": 2, "salts": 5}):
        sparse = words.sparse_documents(docs, vocab, ["doc_id"], **options)
        assert sparse.select(F.explode("terms").alias("t")).agg(F.sum("t.n")).first()[0] == total


def test_documents_per_time(spark):
    docs = spark.createDataFrame([("1901",), ("1900",), ("1901",)], "year string")
    assert [tuple(r) for r in words.documents_per_time(docs).collect()] == [("1900", 1), ("1901", 2)]


@pytest.mark.parametrize("options", [{}, {"limit": 150}, {"limit": -1}, {"limit": -1, "salts": 2}])
def test_score_topics(spark, options):
    weights = materialize(
        spark.createDataFrame(
            [("a", [(1, 0.5), (2, 0.25)], 3), ("b", [(3, 1.0)], 1)],
            "token string, topics array<struct<topic:int,weight:double>>, n long",
        )
    )
    docs = texts(spark, "a a b z", "z")
    got = words.score_topics(docs, weights, tx.word_tokens("text"), F.col("n") > 2, k=2, **options)
    assert pairs(got.select("doc_id", "topic", "score", "place")) == [(0, 1, 1.0, 1), (0, 3, 1.0, 2)]


# --- overlap -----------------------------------------------------------------------------------


@pytest.mark.parametrize("options", [{}, {"limit": -1, "salts": 3}])
def test_match_titles(spark, options):
    titles = spark.createDataFrame([("A b",), ("a-B",)], "title string")
    rows = [(1, "Ab!", "x\n\ty"), (2, "AB", "z"), (3, "C", "w")]
    pages = spark.createDataFrame(rows, "page_id long, title string, content string")
    got = overlap.match_titles(pages, titles, **options)
    assert pairs(got) == [(1, "ab", "Ab!", "x y"), (2, "ab", "AB", "z")]


def test_empty_slugs_match_each_other(spark):
    titles = spark.createDataFrame([("¿?",)], "title string")
    pages = spark.createDataFrame([(1, "!!", "x"), (2, "a", "y")], "page_id long, title string, content string")
    assert pairs(overlap.match_titles(pages, titles).select("page_id")) == [(1,)]


@pytest.mark.parametrize("options", [{}, {"limit": -1}])
def test_match_lines_keeps_copies_and_skips_bare_tabs(spark, options):
    corpus = lines(spark, "a\tA\tx", "a\tA\tx", "b\tB", "\t\t", "c")
    got = overlap.match_lines(corpus, lines(spark, "a\tq", "c", "a", "\t"), "line_id", **options)
    assert sorted(row.value for row in got.select("value").collect()) == ["a\tA\tx", "a\tA\tx", "c"]


def test_page_by_id(spark):
    pages = spark.createDataFrame([(1, "x"), (2, "y")], "page_id long, html string")
    assert pairs(overlap.page_by_id(pages, 2)) == [(2, "y")]


def test_fits_broadcast_counts_bytes(spark):
    df = spark.createDataFrame([("x" * 100,)] * 10, "s string")
    assert fits_broadcast(df, 1320) and not fits_broadcast(df, 1319)


# --- years -------------------------------------------------------------------------------------


def test_parse_articles(spark):
    got = years.parse_articles(lines(spark, "a\tb\tc\t\t", "a\tb\t", "a\tb\tc\td"), "line_id")
    assert pairs(got) == [(0, "a", "b", "c")]


def test_year_documents(spark):
    rows = [("1699",), ("1700",), ("1911",), ("1912",), ("xxxx",), ("c.1800",), ("0999",)]
    docs = spark.createDataFrame([(y, "t") for (y,) in rows], "year string, text string")
    assert pairs(years.year_documents(docs)) == [(1700, "t"), (1911, "t")]


def test_concat_by_year(spark):
    docs = spark.createDataFrame([(2, "b 1900 1901"), (1, "a 1900"), (3, "c")], "doc_id long, text string")
    assert pairs(years.concat_by_year(docs)) == [("1900", 0, 2, "a 1900 b 1900 1901")]


def test_a_hot_year_is_cut_by_the_length_before(spark):
    docs = texts(spark, *(f"doc{i} 1800" for i in range(200)), "x 1801")
    ids = {r.text: r.doc_id for r in docs.collect()}
    expected, length = {}, 0
    for text in sorted((t for t in ids if t.endswith("1800")), key=ids.get):
        expected.setdefault(length // 300, []).append(text)
        length += len(text) + 1
    got = {(r.year, r.part): r.text for r in years.concat_by_year(docs, part_chars=300).collect()}
    assert got.pop(("1801", 0)) == "x 1801"
    assert got == {("1800", part): " ".join(texts_) for part, texts_ in expected.items()} and len(got) > 3


@pytest.mark.parametrize(
    "text, window",
    [
        ("a b 1911 c d e", "a b c"),
        ("a b (1911) c d e", "b (1911) d"),
        ("a b (1911)", "a b (1911)"),
    ],
)
def test_year_windows_hand_cases(spark, text, window):
    got = years.year_windows(texts(spark, text), ["doc_id"], margin=2).collect()
    assert [(r.year, r.text) for r in got] == [("1911", window)]


def expected_windows(text, margin):
    """Words left and right of each year, where a year inside a word leaves the word on the left."""
    found = []
    for year in re.finditer(r"(?<!\w)[0-9]{4}(?!\w)", text):
        cut = year.start()
        if cut and not re.match(r"[ \t\n\x0b\f\r]", text[cut - 1]):
            cut += len(re.match(r"[^ \t\n\x0b\f\r]+", text[cut:]).group())
        left, right = (re.findall(r"[^ \t\n\x0b\f\r]+", side) for side in (text[:cut], text[cut:]))
        words_ = left[-margin:] + right[1:margin] if right else left[-2 * margin :]
        found.append((year.group(), " ".join(words_)))
    return found


@pytest.mark.parametrize("margin", [1, 2, 5])
def test_year_windows_against_a_model(spark, margin):
    rng = random.Random(margin)
    pieces = ["a", "bé", "1911", "(1850)", "1914-1915", "x1913", "19166", "'0450,", "1800.", "-1801", "é1702", " ", "\n", "\t"]
    samples = [
        "".join(rng.choice(pieces) + rng.choice([" ", " ", "\n", ""]) for _ in range(rng.randrange(0, 25)))
        for _ in range(150)
    ]
    got = {}
    for row in years.year_windows(texts(spark, *samples), ["doc_id"], margin=margin).orderBy("doc_id", "position").collect():
        got.setdefault(row.doc_id, []).append((row.year, row.text))
    for i, sample in enumerate(samples):
        assert got.get(i, []) == expected_windows(sample, margin), sample


def test_first_year_against_a_model(spark):
    rng = random.Random(11)
    pieces = ["é", "_", "0500", "0501", "2199", "2200", "1800", "12", "x", " ", "-", "٣"]
    samples = ["".join(rng.choices(pieces, k=8)) for _ in range(300)]
    got = texts(spark, *samples).orderBy("doc_id").select(tx.first_year("text").alias("y")).collect()
    for sample, row in zip(samples, got):
        runs = [r for r in re.findall(r"\w+", sample) if re.fullmatch("[0-9]{4}", r) and 500 < int(r) < 2200]
        assert row.y == (runs[0] if runs else None), sample


# --- divergence over documents -----------------------------------------------------------------


def js_model(p, q):
    total = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        total += (a * math.log(a / m) if a else 0) / 2 + (b * math.log(b / m) if b else 0) / 2
    return total


def random_thetas(rng, n, k=6):
    rows = []
    for _ in range(n):
        w = [rng.random() ** 3 if rng.random() > 0.3 else 0.0 for _ in range(k)]
        w[rng.randrange(k)] += 0.1
        rows.append([x / sum(w) for x in w])
    return rows


THETAS = "id long, year int, theta array<double>"


def nearest_model(queries, training):
    return {
        qid: min((js_model(q, t), tid, year) for tid, year, t in training) for qid, q in queries
    }


def check_nearest(spark, queries, training):
    got = nearest.nearest_document(
        spark.createDataFrame(queries, "id long, theta array<double>"), spark.createDataFrame(training, THETAS)
    ).collect()
    want = nearest_model(queries, training)
    assert len(got) == len(queries)
    for row in got:
        js, train_id, year = want[row.id]
        assert row.js == pytest.approx(js, abs=1e-9)
        assert js_model(dict(queries)[row.id], training_theta(training, row.train_id)) == pytest.approx(js, abs=1e-12)
        if row.train_id != train_id:
            assert js_model(dict(queries)[row.id], training_theta(training, train_id)) == pytest.approx(row.js, abs=1e-14)


def training_theta(training, wanted):
    return next(t for tid, _, t in training if tid == wanted)


def test_nearest_document_with_many_areas(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 8)
    monkeypatch.setattr(nearest, "CHUNK_ROWS", 4)
    monkeypatch.setattr(nearest, "CHUNKS_PER_COPY", 2)
    monkeypatch.setattr(nearest, "PIVOTS", 5)
    rng = random.Random(7)
    training = [(i, 1700 + i % 200, t) for i, t in enumerate(random_thetas(rng, 400))]
    queries = list(enumerate(random_thetas(rng, 90)))
    check_nearest(spark, queries, training)


def test_nearest_document_with_hot_copies(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 8)
    monkeypatch.setattr(nearest, "CHUNK_ROWS", 4)
    rng = random.Random(8)
    hot = [0.25, 0.25, 0.5, 0.0, 0.0, 0.0]
    thetas = random_thetas(rng, 60) + [hot] * 60
    training = [(i, 1700 + i, t) for i, t in enumerate(thetas)]
    queries = list(enumerate(random_thetas(rng, 20) + [hot] * 40))
    check_nearest(spark, queries, training)


def test_the_divergence_lies_between_the_bounds_of_the_hellinger_distance():
    rng = np.random.default_rng(3)
    p, q = rng.random((200, 6)) ** 4, rng.random((300, 6)) ** 4
    p[rng.random(p.shape) < 0.3] = 0
    q[rng.random(q.shape) < 0.3] = 0
    js, apart = nearest.all_divergences(p, q), nearest.hellinger(p, q)
    assert (js <= apart + 1e-12).all() and (js >= np.log(2) * apart - 1e-12).all()


def test_few_pairs_need_their_divergence_and_the_share_falls():
    rng = np.random.default_rng(4)
    queries, train = rng.dirichlet(np.ones(26), 200), rng.dirichlet(np.ones(26), 8000)
    shares = []
    for n in (500, 2000, 8000):
        row, column = nearest.possible_pairs(queries, train[:n], np.full(len(queries), np.inf))
        js = nearest.all_divergences(queries, train[:n])
        assert set(zip(range(len(queries)), js.argmin(axis=1))) <= set(zip(row, column))
        shares.append(len(row) / js.size)
    assert shares[0] < 0.2 and shares[0] > shares[1] > shares[2]


def test_nearest_document_of_texts_almost_alike(spark, monkeypatch):
    monkeypatch.setattr(nearest, "PAIRS_AT_ONCE", 7)
    training = [(i, 1800, [0.5 + i * 1e-13, 0.5 - i * 1e-13]) for i in range(40)]
    check_nearest(spark, [(0, [0.5, 0.5]), (1, [0.5 + 1e-12, 0.5 - 1e-12])], training)


def test_nearest_document_sends_a_query_once_to_each_group(spark, monkeypatch):
    """However many areas the documents fill, a query goes to a bounded number of groups."""
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 8)
    monkeypatch.setattr(nearest, "PIVOTS", 20)
    monkeypatch.setattr(nearest, "GROUPS", 3)
    frames, write = [], nearest.materialize
    monkeypatch.setattr(nearest, "materialize", lambda df: frames.append(write(df)) or frames[-1])
    rng = random.Random(9)
    training = [(i, 1700 + i % 200, t) for i, t in enumerate(random_thetas(rng, 300))]
    check_nearest(spark, list(enumerate(random_thetas(rng, 50))), training)
    asked = next(df for df in frames if "groups" in df.columns)
    assert max(len(r["groups"]) for r in asked.collect()) <= 3
    areas = next(df for df in frames if "area" in df.columns)
    assert areas.select("area").distinct().count() > 3


def test_a_query_meets_only_the_leaves_it_can_reach(monkeypatch):
    """Every query met every document of its areas; now it meets those of leaves within its limit, and the result stays exact."""
    monkeypatch.setattr(nearest, "LEAF_ROWS", 16)
    monkeypatch.setattr(nearest, "CHUNK_ROWS", 8)
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(5)
    middles = rng.dirichlet(np.ones(12), 30)
    near = lambda n: np.stack([rng.dirichlet(middles[i % 30] * 3000 + 1e-3) for i in range(n)])
    train, queries = near(3000), near(200)
    train[7], train[11], queries[3] = train[5], train[5], train[5]  # ties
    boxes, plain = [], nearest._to_boxes
    monkeypatch.setattr(nearest, "_to_boxes", lambda q, low, high: boxes.append(len(q) * len(low)) or plain(q, low, high))
    limit = nearest.nearest_bound(queries, train[:300])
    ids = rng.permutation(3000)
    got = nearest.search_group(
        pa.table({"id": range(200), "theta": queries.tolist(), "limit": limit}), pa.table({"id": ids, "year": np.arange(3000, dtype=np.int32), "theta": train.tolist()})
    ).to_pylist()
    js = nearest.all_divergences(queries, train)
    assert [r["id"] for r in got] == list(range(200))
    for r in got:
        assert r["js"] == pytest.approx(js[r["id"]].min(), abs=1e-11) and js[r["id"], r["year"]] == pytest.approx(r["js"], abs=1e-11) and ids[r["year"]] == r["train_id"]
    assert got[3]["train_id"] == min(ids[[5, 7, 11]]) and got[3]["js"] == 0
    assert sum(boxes) < 0.3 * 200 * 3000 / 16


def test_boxes_are_no_farther_than_what_they_hold():
    rng = np.random.default_rng(6)
    train, queries = rng.random((500, 5)).astype(np.float32), rng.random((60, 5)).astype(np.float32) * 2
    leaves, order = nearest._leaves(train, queries)
    assert sorted(np.concatenate(leaves)) == list(range(500)) and sorted(order) == list(range(60)) and max(map(len, leaves)) <= nearest.LEAF_ROWS
    to_box = nearest._to_boxes(queries, np.stack([train[r].min(axis=0) for r in leaves]), np.stack([train[r].max(axis=0) for r in leaves]))
    for i, rows in enumerate(leaves):
        assert (to_box[:, i] <= ((queries[:, None] - train[rows]) ** 2).sum(axis=2).min(axis=1) + 1e-6).all()


def test_initials_are_counted_without_a_row_for_each_word(spark):
    """A row for each word was made and counted; the letters that tokens begin with are counted in each text."""
    rng = random.Random(12)
    rows = [(i, "".join(rng.choices(["a", "b", "z", "'", "''", " ", "É", "A", "İ", "K", "3", "\n"], k=rng.randrange(12)))) for i in range(400)]
    rows += [(3, "'tis don't 'em"), (None, "x y"), (None, "y"), (900, None), (901, ""), (902, "'" * 4), (903, "'"), (904, "'a"), (905, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    initial = F.left(F.col("token"), F.lit(1))
    want = docs.select("doc_id", F.explode(tx.letter_tokens("text")).alias("token")).groupBy("doc_id", initial.alias("c")).count().collect()
    sums = Counter()
    for r in blocks.initial_counts(docs, "doc_id", "text").collect():
        assert sum(r["counts"]) > 0
        sums.update({(r["id"], c): n for c, n in zip("abcdefghijklmnopqrstuvwxyz", r["counts"]) if n})
    assert sums == {(r["doc_id"], r["c"]): r["count"] for r in want} and (3, "d") in sums and (None, "y") in sums


def test_nearest_document_ties_and_zero_vectors(spark):
    training = [(7, 1807, [0.5, 0.5]), (3, 1803, [0.5, 0.5]), (1, 1801, [0.0, 0.0])]
    queries = spark.createDataFrame([(0, [0.6, 0.4]), (1, [0.0, 0.0])], "id long, theta array<double>")
    got = nearest.nearest_document(queries, spark.createDataFrame(training, THETAS)).collect()
    assert [(r.id, r.train_id, r.year) for r in got] == [(0, 3, 1803)]


def test_nearest_document_without_queries(spark):
    training = spark.createDataFrame([(7, 1807, [0.5, 0.5])], THETAS)
    assert nearest.nearest_document(training.select("id", "theta").limit(0), training).collect() == []


def test_nearest_document_without_training(spark):
    queries = spark.createDataFrame([(0, [0.6, 0.4])], "id long, theta array<double>")
    assert nearest.nearest_document(queries, spark.createDataFrame([], THETAS)).collect() == []


def gap_model(docs, first):
    result = {}
    for d in gaps.YEAR_GAPS:
        found = [(a, b) for a, b in combinations(docs, 2) if abs(a[1] - b[1]) == d][:first]
        result[d] = [(a[0], b[0]) for a, b in found]
    return result


@pytest.mark.parametrize("first, spread_", [(1000, 12), (10, 4), (10, 60), (3, 1)])
def test_first_pairs_are_exact(spark, first, spread_):
    rng = random.Random(first + spread_)
    docs = [(i, 1800 if rng.random() < 0.4 else 1800 + rng.randrange(spread_), [1.0]) for i in range(80)]
    got = gaps.first_pairs(spark.createDataFrame(docs, THETAS), first=first).collect()
    found = {d: sorted((r.i, r.j) for r in got if r.d == d) for d in gaps.YEAR_GAPS}
    assert found == gap_model(docs, first)


@pytest.mark.parametrize("cut, most", [(1, 0), (7, 20), (100_000, 1_000_000)])
def test_a_scan_task_keeps_the_smallest_ids_of_each_key(cut, most, monkeypatch):
    monkeypatch.setattr(gaps, "CUT_ROWS", cut)
    monkeypatch.setattr(gaps, "KEPT_ROWS", most)
    rng = random.Random(cut)
    rows = [(rng.randrange(5), 2**53 + i) for i in rng.sample(range(400), 120)]
    batches = [
        pa.RecordBatch.from_pydict({"year": [y for y, _ in rows[i : i + 10]], "id": [j for _, j in rows[i : i + 10]]})
        for i in range(0, len(rows), 10)
    ]
    kept = [(r["year"], r["id"]) for b in gaps._cut_in_task("year", 3)(iter(batches)) for r in b.to_pylist()]
    want = {(y, i) for y in range(5) for i in sorted(i for z, i in rows if z == y)[:3]}
    assert want <= set(kept) and len(kept) == len(set(kept)) and set(kept) <= set(rows)
    if most > 20:
        assert set(kept) == want
    assert list(gaps._cut_in_task("year", 3)(iter([]))) == []


def test_first_rows_are_cut_before_any_exchange(spark, capsys):
    docs = spark.createDataFrame([(i, 1800 if i % 3 else None) for i in range(5000)], "id long, year int")
    cut = gaps.first_by_id(docs, "year", 2000)
    assert sorted(r.id for r in cut.collect()) == [i for i in range(5000) if i % 3][:2000]
    cut.explain("simple")
    plan = capsys.readouterr().out
    # A plan prints its last step first.
    assert plan.rindex("MapInArrow") > plan.rindex("Exchange")


def test_mean_by_year_gap(spark):
    docs = [(0, 1800, [0.5, 0.5]), (1, 1800, [0.9, 0.1]), (2, 1802, [0.5, 0.5])]
    got = {r.d: (r.pairs, r.mean_js) for r in gaps.mean_by_year_gap(spark.createDataFrame(docs, THETAS)).collect()}
    assert set(got) == {0, 1, 2, 5, 10, 25, 50}
    assert got[0] == (1, pytest.approx(0.101749, abs=1e-6))
    assert got[2] == (2, pytest.approx(0.101749 / 2, abs=1e-6))
    assert all(got[d] == (0, None) for d in (1, 5, 10, 25, 50))


# --- topics ------------------------------------------------------------------------------------


def test_ranked_terms(spark):
    cells = spark.createDataFrame(
        [(0, 5, 0, -1.0), (0, 5, 1, -3.0), (0, 5, 2, -2.0)], "topic int, time_idx int, term int, logp double"
    )
    lowest = topics.ranked_terms(cells, 2).orderBy("place").collect()
    assert [(r.year, r.term) for r in lowest] == [(1805, 1), (1805, 2)]
    largest = topics.ranked_terms(cells, 2, largest=True).orderBy("place").collect()
    assert [r.term for r in largest] == [0, 2]
    assert [r.value for r in topics.term_lines(topics.ranked_terms(cells, 2)).collect()] == ["0\t1805\t1 2"]


def test_unpack_counts_stops_at_the_first_non_positive(spark):
    packed = spark.createDataFrame([("x", [37, 9, 0, 13]), ("y", [5]), ("z", [-1, 5])], "type string, values array<int>")
    got = topics.unpack_counts(packed, mask=3, bits=2)
    assert pairs(got) == [("x", 1, 2), ("x", 1, 9), ("y", 1, 1)]


def test_topic_listing_is_cut_like_the_whole_line(spark):
    rng = random.Random(2)
    counts = [(i, i % 2, rng.randrange(1, 9)) for i in range(700)]
    df = spark.createDataFrame(counts, "type int, topic int, n int")
    for row in topics.topic_listing(df).collect():
        mine = [(t, n) for t, topic, n in counts if topic == row.topic]
        assert (row.types, row.total) == (len(mine), sum(n for _, n in mine))
        assert row.line == " ".join(f"{t}:{n}" for t, n in mine)[:500]


def test_topic_totals_match_the_counter(spark):
    counts = [("a", 0, 2), ("b", 0, 3), ("a", 1, 1)]
    got = topics.topic_listing(spark.createDataFrame(counts, "type string, topic int, n int")).collect()
    assert Counter({r.topic: r.total for r in got}) == Counter({0: 5, 1: 1})
    assert {r.topic: r.line for r in got} == {0: "a:2 b:3", 1: "a:1"}


# --- arcs --------------------------------------------------------------------------------------


def test_arcs(spark):
    df = lines(spark, "1800-1810,1.0", "1800-1850,2.718281828459045", "bad", "1800-1801,0", "x1800-1801,1").select("value")
    got = arcs(parse_year_pairs(df)).orderBy("year2").collect()
    assert [(r.cx, r.r) for r in got] == [(30.0, 30.0), (150.0, 150.0)]
    assert [(r.stroke_width, r.opacity) for r in got] == [
        (pytest.approx(3.0), pytest.approx(0.5)),
        (pytest.approx(0.01), pytest.approx(0.01)),
    ]


def test_arcs_of_equal_distances_have_no_scale(spark):
    got = arcs(parse_year_pairs(lines(spark, "1800-1810,2.0", "1810-1820,2.0").select("value"))).collect()
    assert [r.stroke_width for r in got] == [None, None]
