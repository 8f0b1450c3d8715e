"""Phrase collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from chronotext.llm import collocations

DOC = "doc_id long, text string, lang string, n long, prefix string, phrase string"


def documents(spark, rows):
    """(text, lang) rows with further columns named as those that the operator uses inside."""
    return spark.createDataFrame([(i, t, lang, 1, "x", "y") for i, (t, lang) in enumerate(rows)], DOC)


def model(rows, longest, least, top):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lowered):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if a >= least}
        scored = []
        for p, a in frequent.items():
            if len(p) < 2:
                continue
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in frequent.items()):
                continue
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        scored.sort()
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(scored[:top])]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed, size=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Éa", "éa", "B", "b", "x y", "日本"]
    rows = [(None, "en"), ("", "en"), (" .,\t;", None), ("one", "fr")]
    for _ in range(size):
        picked = rng.choices(words, weights=[40, 20, *[3] * 16], k=rng.randint(1, 40))
        if rng.random() < 0.4:
            at = rng.randrange(len(picked))
            picked[at:at] = ["new", "york", "city", "hall", "of", "fame"][: rng.randint(2, 6)]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", "\n", ". "]) for w in picked)
        rows.append((text, rng.choice(["en", "en", "fr", None])))
    return rows + rows[10:20]


@pytest.mark.parametrize(("seed", "longest", "least", "top"), [(1, 5, 4, 2000), (2, 5, 9, 6), (3, 3, 2, 2000), (4, 2, 5, 10)])
def test_equals_a_plain_count(spark, seed, longest, least, top):
    rows = corpus(seed)
    got = found(collocations.collocations(documents(spark, rows), longest, least, top))
    assert got and got == model(rows, longest, least, top)


def test_heavy_prefixes_small_chunks_and_a_full_filter(spark, monkeypatch):
    """Results do not depend on how stripes are cut, on where text is cut, or on what the filter lets through."""
    rows = corpus(5)
    monkeypatch.setattr(collocations, "HEAVY", 10**6)
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 200)
    monkeypatch.setattr(collocations, "FILTER_BYTES", 4096)
    assert found(collocations.collocations(documents(spark, rows), 5, 3)) == model(rows, 5, 3, 2000)
    full = np.full(4096, 255, np.uint8)
    monkeypatch.setattr(collocations, "phrase_filter", lambda frequent: (full, frozenset()))
    assert found(collocations.collocations(documents(spark, rows), 4, 3)) == model(rows, 4, 3, 2000)


def test_empty_and_wordless_tables(spark):
    assert found(collocations.collocations(documents(spark, []), 5, 1)) == []
    assert found(collocations.collocations(documents(spark, [(None, None), ("..", "en")]), 5, 1)) == []


def test_a_long_text_without_pieces(spark):
    rows = [("a b c " * 30000, "en")]
    got = found(collocations.collocations(documents(spark, rows)))
    assert [(r[2], r[3]) for r in got] == [("a b c", 30000), ("a b c a b", 29999), ("b c a b c", 29999), ("c a b c a", 29998)]


def test_prefix_totals_and_largest_extensions(spark):
    extensions, prefixes = collocations.count_phrases(documents(spark, [("a b a b a c", "en")]), 3, 1)
    totals = {(r["prefix"], r["total"], r["most"]) for r in prefixes.collect()}
    assert {("", 6, 3), ("a", 3, 2), ("b", 2, 2), ("c", 1, None), ("a b", 2, 2), ("b a", 2, 1), ("a c", 1, None)} == totals
    assert {(r["phrase"], r["n"]) for r in extensions.where("words = 3").collect()} == {("a b a", 2), ("b a b", 1), ("b a c", 1)}
