"""Periodic runs against a search of all periods and places."""

import random

import numpy as np
import pytest

from chronotext.llm import periodic
from chronotext.llm.queries import plant_periods

DOC = "doc_id long, text string, runs string, n_words int, period long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOC)


def words_of(text):
    return (text or "").encode().split()


def model(words, least=periodic.LEAST_WORDS):
    """{(start, length): smallest period} as (start, length, period) by start and period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone).decode()


def random_words(rng):
    words = [rng.choice("ab cd é 日 Ab".split()[: rng.randint(1, 5)]) for _ in range(rng.choice([0, 1, 11, 12, 13, 60, 200]))]
    if words and rng.random() < 0.6:
        a = rng.randrange(len(words))
        p = rng.randint(1, max(1, (len(words) - a) // 3))
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    return words


def test_equals_all_periods_and_places(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([" ", "\n", "\t \x0b"]).join(random_words(rng))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "a " * 12), (303, "a " * 12), (303, "b " * 40), (2**53 + 1, "x y " * 6), (None, "a " * 20)]
    got = periodic.periodic_runs(documents(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got) == sorted(
        (i, len(words_of(t)), model(words_of(t)), kept(words_of(t), model(words_of(t)))) for i, t in rows if i is not None
    )


def test_empty_table_and_other_lengths(spark):
    assert periodic.periodic_runs(documents(spark, [])).collect() == []
    row = periodic.periodic_runs(documents(spark, [(1, "a b a b c c c")]), least=3).first()
    assert [tuple(x) for x in row["runs"]] == [(0, 4, 2), (4, 3, 1)] and row["collapsed"] == "a b c"


@pytest.mark.parametrize("seed", range(20))
def test_extensions_of_the_grammar(seed):
    rng = random.Random(seed)
    symbols = np.array(rng.choices(range(rng.choice([1, 2, 5])), k=rng.randint(2, 300)))
    symbols = np.concatenate([symbols, symbols[: len(symbols) // 2], [0] * 20])
    grammar = periodic.Grammar(symbols, least=rng.choice([1, 8]))
    i, j = np.array([sorted(rng.sample(range(len(symbols) + 1), 2)) for _ in range(200)]).T
    for a, b, ahead, behind in zip(i, j, grammar.extend(i, j), grammar.extend_back(i, j)):
        k = 0
        while b + k < len(symbols) and symbols[a + k] == symbols[b + k]:
            k += 1
        assert ahead == k
        k = 0
        while a - k > 0 and symbols[a - k - 1] == symbols[b - k - 1]:
            k += 1
        assert behind == k


def test_long_texts(spark, monkeypatch):
    """A square of 30,000 words, one word 50,000 times, and no run in as many different words."""
    monkeypatch.setattr(periodic, "GRID_ROWS", 5000)
    half = [f"w{i}" for i in range(15000)]
    rows = [(1, " ".join(half * 2)), (2, "same " * 50000), (3, " ".join(f"u{i}" for i in range(50000)))]
    got = {r["doc_id"]: r for r in periodic.periodic_runs(documents(spark, rows)).collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(0, 30000, 15000)] and got[1]["collapsed"] == " ".join(half)
    assert [tuple(x) for x in got[2]["runs"]] == [(0, 50000, 1)] and got[2]["collapsed"] == "same"
    assert got[3]["runs"] == [] and len(got[3]["collapsed"]) == len(rows[2][1])


def test_longest_run_and_planted_periods(spark):
    import zlib

    rows = [(i, " ".join(f"w{j}" for j in range(1 + i % 70))) for i in range(400)] + [(7, None), (None, "a b")]
    planted = {r["doc_id"]: r["text"] for r in plant_periods(documents(spark, rows[:400])).collect()}
    for i, text in rows[:400]:
        words, h = text.split(" "), zlib.crc32(str(i).encode())
        if h % 10 == 0:
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            words = [words[a + (k - a) % p] if k >= a else w for k, w in enumerate(words)]
        assert planted[i] == " ".join(words)
    assert plant_periods(documents(spark, rows[400:])).count() == 2
    df = periodic.periodic_runs(documents(spark, [(1, "a " * 12 + "x " + "b c " * 6), (2, "a")]))
    best = {r["doc_id"]: r["best"] for r in df.select("doc_id", periodic.longest_run("runs").alias("best")).collect()}
    assert tuple(best[1]) == (0, 12, 1) and best[2] is None
