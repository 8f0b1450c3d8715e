"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows and other columns."""

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronotext.llm import embeddings, fmindex, licenses, minhash, packing, secrets, substrings, topk, toxicity, urls
from chronotext.llm.common import inline

DOC = "doc_id long, text string, n_tokens string, id string, token int"


def documents(spark, rows):
    """Documents with columns that clash with the names that operators use inside."""
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], DOC)


def words_of(text):
    return (text or "").encode().split()


# --- near-duplicates ---------------------------------------------------------------------------


def roots(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def minhash_model(rows):
    sets = {}
    for i, text in rows:
        w = [x.lower() for x in words_of(text)]
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    linked = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = roots(ids, linked)
    return {(i, len(sets[i]), root[i], root[i] == i) for i in ids}


def test_minhash_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, passage = [], " ".join(rng.choices(vocabulary, k=40))
    for group in range(12):
        base = rng.choices(vocabulary, k=rng.randint(30, 120))
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    rows += [passage + " " + " ".join(rng.choices(vocabulary, k=30)) for _ in range(20)]
    rows += [None, "", " \n\t", "One two", "one  TWO", "a b c d", "a b c d", "a b c d e", "é É", "long " * 30000, "long " * 20000]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = minhash.near_duplicates(documents(spark, rows + [(None, "one two")])).collect()
    assert {tuple(r) for r in got} == minhash_model(rows) and len(got) == len(rows)


def test_minhash_lists_apart_from_hub(spark, monkeypatch):
    """Members that a list's hub does not link are compared among themselves, in several blocks."""
    monkeypatch.setattr(minhash, "LIST_ROWS", 4)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 8)):
            copy[rng.randrange(100)] = f"x{rng.randrange(9)}"
        rows.append(" ".join(copy))
    rows = list(enumerate(rows))
    got = {tuple(r) for r in minhash.near_duplicates(documents(spark, rows)).collect()}
    assert got == minhash_model(rows) and 1 < len({r[2] for r in got}) < len(got)


def test_minhash_rows_of_a_list_grow_with_its_members_not_with_their_pairs():
    rng, n = np.random.default_rng(3), 60
    common = rng.integers(0, 2**63, 200, dtype=np.uint64)
    # Near copies, apart from the hub and from each other, and as many that are like none.
    sets = [np.unique(np.concatenate([common, rng.integers(0, 2**63, 10, dtype=np.uint64)])) for _ in range(n)]
    sets += [np.unique(rng.integers(0, 2**63, 210, dtype=np.uint64)) for _ in range(n)]
    bounds = np.cumsum([0, *map(len, sets)])
    sketch = minhash.signatures(np.concatenate(sets), bounds, minhash.SKETCH, np.uint8)
    ids = np.arange(2 * n)
    group = pa.table({
        "token": np.full(2 * n, 7), "id": ids, "part": ids, "apart": ids > 0, "is_left": ids > 0, "is_right": np.ones(2 * n, bool),
        "n_shingles": [len(s) for s in sets], "prefix": [[7]] * (2 * n), "sketch": [s.tobytes() for s in sketch], "shingles": [s.tobytes() for s in sets],
    })
    links = minhash._compare(75)(group)
    assert links.num_rows == n - 1 and set(links["a"].to_pylist() + links["b"].to_pylist()) == set(range(n))


def test_minhash_of_nothing(spark):
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
    repeated = minhash.near_duplicates(documents(spark, [(5, "a b"), (5, "a b"), (6, None)])).collect()
    assert sorted(map(tuple, repeated)) == [(5, 1, 5, True), (5, 1, 5, True), (6, 0, 6, True)]


# --- vectors -----------------------------------------------------------------------------------

VECTOR = "vec_id long, embedding array<float>, label int, score string, id string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "s", "i") for i, v, label in rows], VECTOR)


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "DATA_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 6)).round(2).astype(np.float32)
    x[50:60] = x[0]  # ties
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    units = {i: np.floor(1024 * v.astype(np.float64)).astype(np.int64) for i, v in enumerate(x)}
    rows += [(400, None, 1), (401, [1.0, None], 1), (402, [float("nan")] * 6, 1), (403, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), rows[7]]
    got = topk.exact_top_k(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=10)
    want = set()
    for q in range(0, 300, 20):
        best = sorted((-int(units[q] @ units[i]), i) for i in units if i != q)[:10]
        want |= {(q, rank + 1, i, -score) for rank, (score, i) in enumerate(best)}
    assert {tuple(r) for r in got.collect()} == want
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}


def test_top_k_small(spark):
    got = topk.exact_top_k(vectors(spark, [(0, [1.0], 1), (1, [], 1), (2, [2.0, 9.0], 1)]), F.col("vec_id") == 0)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 2, 2 * 1024 * 1024), (0, 2, 1, 0)]
    assert topk.exact_top_k(vectors(spark, []), F.lit(True)).count() == 0
    assert topk.exact_top_k(vectors(spark, [(3, [1.0], 1)]), F.lit(True)).count() == 0


def test_dual_tree_prunes():
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((20, 8)) * 3000
    x = np.floor(centers[rng.integers(0, 20, 3000)] + rng.standard_normal((3000, 8)) * 20)
    ids = np.arange(3000)
    scores, found, scored = topk.dual_tree_search(x[:60], ids[:60], x, ids, 10, leaves=(8, 48))
    exact = x[:60] @ x.T
    exact[np.arange(60), np.arange(60)] = -np.inf
    assert (scores == -np.sort(-exact, 1)[:, :10]).all()
    assert scored < 0.5 * 60 * 3000


def embedding_model(rows, similarity=0.93):
    able = {}
    for i, v, label in rows:
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = np.array(v, np.float32).astype(float)
            able[i] = (label, v / np.linalg.norm(v))
    ids = sorted({r[0] for r in rows})
    linked = [(a, b) for a in able for b in able if a < b and able[a][0] == able[b][0] and able[a][1] @ able[b][1] >= similarity]
    root = roots(ids, linked)
    return {(i, sum(i in pair for pair in linked), root[i], root[i] == i) for i in ids}


def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(2)
    rows = []
    for group in range(30):
        center = rng.standard_normal(16)
        for _ in range(rng.integers(1, 30)):
            x = center + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.2])
            rows.append((len(rows), x.tolist(), int(rng.integers(0, 2))))
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [None] * 16, 1), (n + 3, [float("nan")] * 16, 1), (n + 4, rows[0][1], None), (n + 5, [], 1)]
    got = embeddings.near_duplicates(vectors(spark, [*rows, rows[3], (None, [1.0], 1)]))
    assert {tuple(r) for r in got.collect()} == embedding_model(rows)
    assert got.count() == len(rows)


def test_embeddings_recall_at_the_threshold():
    """Pairs turned to just above the threshold in any direction are found."""
    rng = np.random.default_rng(6)
    x = embeddings._directions(rng.standard_normal((2000, 64)))
    index = embeddings.MultiIndex(x, 0.93)
    turn = rng.standard_normal(x.shape)
    turn = embeddings._directions(turn - (turn * x).sum(1)[:, None] * x)
    y = 0.931 * x + np.sqrt(1 - 0.931**2) * turn
    rows, cells = index.visits(x)
    home = index.cell(y)
    found = np.unique(rows[cells == home[rows]])
    assert len(found) / len(x) >= 0.99
    assert len(rows) < 0.7 * len(x) * len(index.books[0]) * len(index.books[1])


def flat_vectors(rng, n, within):
    """Clustered vectors of 64 dimensions that lie near ``within`` of them."""
    plane = rng.standard_normal((within, 64))
    return embeddings._directions(rng.standard_normal((n, within)) @ plane + 0.02 * rng.standard_normal((n, 64)))


@pytest.mark.parametrize("within", [2, 3, 6])
def test_embeddings_recall_of_real_neighbours(within):
    x = flat_vectors(np.random.default_rng(within), 1500, within)
    index = embeddings.MultiIndex(x, 0.93)
    visited = np.zeros((len(x), len(index.books[0]) * len(index.books[1])), dtype=bool)
    visited[index.visits(x)] = True
    met = visited[:, index.cell(x)]
    assert (met | met.T)[x @ x.T >= 0.93].all()


@pytest.mark.parametrize("block", [16, 1024])
def test_flat_embeddings_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(flat_vectors(np.random.default_rng(8), 400, 6))]
    assert {tuple(r) for r in embeddings.near_duplicates(vectors(spark, rows)).collect()} == embedding_model(rows)


def test_embeddings_of_nothing(spark):
    assert embeddings.near_duplicates(vectors(spark, [])).count() == 0
    assert [tuple(r) for r in embeddings.near_duplicates(vectors(spark, [(4, [1.0, 2.0], 1)])).collect()] == [(4, 0, 4, True)]


# --- licences and urls -------------------------------------------------------------------------


def test_licenses(spark):
    mit = dict(map(reversed, licenses.KNOWN))
    body = next(b for b, name in mit.items() if name == "MIT" and b.startswith("Permission"))
    rows = [
        (1, "Copyright (c) 2020 A. Nobody\n" + body.upper().replace("SUBLICENSE", "sublicence")),
        (2, "x\nreleased under the   MIT licence\nLicensed under CC BY-NC 4.0!\ny"),
        (3, None), (4, ""), (4, ""), (None, "plain"), (6, "word " * 50000),
    ]
    got = licenses.scan_licenses(documents(spark, rows), licenses.known_digests(spark))
    found = {r["doc_id"]: (r["license"], r["notices"]) for r in got.collect()}
    assert found == {1: ("MIT", ""), 2: (None, "CC-BY-NC-4.0,MIT"), 3: (None, ""), 4: (None, ""), None: (None, ""), 6: (None, "")}
    assert got.count() == len(rows)
    assert licenses.scan_licenses(documents(spark, []), licenses.known_digests(spark)).count() == 0


def test_only_copyright_statements_are_left_out(spark):
    cases = [
        ("Copyright 2020 Ann. Licensed under the Apache License, Version 2.0.", "licensed under the apache license version 2 0"),
        ("Copyright 2020. Released under the MIT License.", "released under the mit license"),
        ("(c) 2019-2020 J. R. Doe, Foo Inc. and others. Plain text.", "plain text"),
        ("Copyright (c) A. Nobody, 2020\nAll rights reserved.\n\nRedistribution", "redistribution"),
        ("© 2020 Foo Inc. All rights reserved. Use it.", "use it"),
        ("x\n * Copyright 2020 Foo\ny", "x y"),
        ("the copyright notice. " + "word " * 9000 + "1999 end.", "the copyright notice " + "word " * 9000 + "1999 end"),
        ("Copyright 2020 Ann. " + "a.b. " * 9000 + "end", ("a b " * 9000 + "end")),
        ("MIT License\n\nCopyright (c) Ann Lee\n\nPermission", "mit license permission"),
        ("(c) <year> <holder>\nUse", "use"),
        ("Copyright (C) [yyyy] [name of copyright owner]\nUse", "use"),
        ("© Ann Lee. Use it.", "use it"),
        ("(c) You must keep the copyright notice", "c you must keep the copyright notice"),
        ("Copyright by J.R. Doe (c) 2020. Use it.", "use it"),
    ]
    docs = documents(spark, [(i, text) for i, (text, _) in enumerate(cases)])
    got = dict(docs.select("doc_id", licenses.canonical(F.col("text"))).collect())
    for i, (text, want) in enumerate(cases):
        assert got[i] == want, text[:60]
    found = licenses.scan_licenses(docs, licenses.known_digests(spark)).where("doc_id < 2").collect()
    assert {r["doc_id"]: r["license"] for r in found} == {0: "Apache-2.0", 1: "MIT"}


def test_long_lines_of_marks_take_time_in_proportion(spark):
    unit = "(c) a.b.c.d. x (c) y "
    docs = documents(spark, [(1, unit * 50_000), (2, "copyright " * 100_000), (3, "(c) " + "a." * 500_000), (4, "copyright inc. " * 70_000)])
    start = time.perf_counter()
    got = dict(docs.select("doc_id", F.length(licenses.canonical(F.col("text")))).collect())
    # Four texts of about 1 MB; a pattern that reads a line once for each mark takes hours.
    assert time.perf_counter() - start < 120
    assert got == {1: len("c a b c d x c y ") * 50_000 - 1, 2: 999_999, 3: 2 + 1_000_000 - 1, 4: len("copyright inc ") * 70_000 - 1}


def test_holders_and_items_of_bsd_licences(spark):
    bsd = licenses._BODIES["BSD-3-Clause"]
    named = bsd.replace("the copyright holder nor", "Foo Labs, Inc. nor").replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")
    named = named.replace("BY THE COPYRIGHT HOLDERS AND", "BY THE REGENTS AND").replace("THE COPYRIGHT HOLDER OR", "THE REGENTS OR")
    docs = documents(spark, [(1, "BSD 3-Clause License\n\nCopyright (c) Foo Labs, Inc.\n\n" + named), (2, named.replace("DAMAGE", "LOSS"))])
    found = dict(licenses.scan_licenses(docs, licenses.known_digests(spark)).select("doc_id", "license").collect())
    assert found == {1: "BSD-3-Clause", 2: None}


def test_digests_of_canonical_texts(spark):
    """Digests of canonical texts written by hand, apart from the patterns of the module."""
    cases = {
        "Copyright 2020 Ann.\nLICENCED under  the Apache License, v2!": "licensed under the apache license version 2",
        "Neither the name of Foo nor the names of its contributors": "neither the name of the copyright holder nor the names of its contributors",
        "": "",
    }
    docs = documents(spark, list(enumerate(cases)))
    got = dict(docs.select("doc_id", licenses.digest(F.col("text"))).collect())
    assert got == {i: hashlib.sha256(want.encode()).hexdigest() for i, want in enumerate(cases.values())}


def test_whole_licences_with_and_without_title(spark):
    mit = next(b for name, b in licenses.KNOWN if name == "MIT" and b.startswith("Permission"))
    bsd = licenses._BODIES["BSD-3-Clause"]
    folder = licenses.Path(licenses.__file__).parent / "known_licenses"
    files = {name: (folder / f"{file}.txt").read_text() for name, file in licenses._FILES.items()}
    cases = [
        ("MIT", "MIT License\n\nCopyright (c) 2021 A. Nobody\n\n" + mit), ("MIT", mit),
        ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2021, Foo Inc.\nAll rights reserved.\n\n" + bsd),
        ("ISC", "ISC License\n\nCopyright 2020 Foo\n\n" + licenses._BODIES["ISC"]),
        *files.items(),
        ("GPL-3.0", files["GPL-3.0"].split("Version 3, 29 June 2007", 1)[1]),
        ("Apache-2.0", files["Apache-2.0"].split("APPENDIX:")[0]),
        (None, files["GPL-3.0"][:5000]),
    ]
    docs = documents(spark, [(i, text) for i, (_, text) in enumerate(cases)])
    found = dict(licenses.scan_licenses(docs, licenses.known_digests(spark)).select("doc_id", "license").collect())
    assert [found[i] for i in range(len(cases))] == [name for name, _ in cases]


def test_urls(spark):
    listed = inline(spark, ["host", "path", "verdict"], [("org", "/", "allow"), ("a.org", "/x", "block"), ("a.org", "/xy", "allow"), ("com", "", "block")])
    cases = {
        "http://A.ORG/xz?q=/x": ("a.org", "/xz", "a.org/x", "block"), "https://b.a.org/xyz#f": ("b.a.org", "/xyz", "a.org/xy", "allow"),
        "ftp://ba.org/x": ("ba.org", "/x", "org/", "allow"), "http://org": ("org", "", None, "allow"), "x.com/y": ("", "", None, "allow"),
        "http://x.com?y": ("x.com", "", "com", "block"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "://": ("", "", None, "allow"),
        "http://n.net/" + "p" * 5000: ("n.net", "/" + "p" * 5000, None, "allow"), "http://a.org/x\ny": ("a.org", "/x\ny", "a.org/x", "block"),
    }
    rows = [(i, u, "h", "r") for i, u in enumerate(cases)] + [(0, next(iter(cases)), "h", "r")]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string, rule string"), listed).collect()
    assert len(got) == len(rows)
    want = list(cases.values())
    assert {tuple(r) for r in got} == {(i, *w) for i, w in enumerate(want)}
    nothing = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string, rule string"), listed.limit(0), "block")
    assert {r["verdict"] for r in nothing.collect()} == {"block"}


def test_url_filter_has_no_python(spark):
    listed = inline(spark, ["host", "path", "verdict"], [("org", "/", "allow")])
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string").cache()
    plan = urls.filter_urls(pages, listed)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# --- packing -----------------------------------------------------------------------------------


def least_padding(lengths, buckets):
    distinct = sorted(set(lengths))
    n = len(distinct)
    best = {(0, 0): 0}
    for b in range(1, buckets + 1):
        for j in range(1, n + 1):
            options = [best[i, b - 1] + sum(distinct[j - 1] - x for x in lengths if distinct[i] <= x <= distinct[j - 1]) for i in range(j) if (i, b - 1) in best]
            if options:
                best[j, b] = min(options)
    return min(v for (j, _), v in best.items() if j == n)


def test_packing(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.choice([1, 2, 3, 8, 9, 20, 21, 22, 50]))) for i in range(120)]
    rows = [(i, t) for i, t in rows] + [(200, None), (201, ""), (202, "a " * 5000), (7, rows[7][1]), (None, "a")]
    got = packing.pack(documents(spark, rows), buckets=4, budget=60).collect()
    named = [r for r in rows if r[0] is not None]
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == sorted((i, len(words_of(t))) for i, t in named)
    lengths = [len(words_of(t)) for _, t in named]
    assert sum(r["bucket"] - r["n_tokens"] for r in got) == least_padding(lengths, 4)
    batches = {}
    for r in got:
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for (bucket, batch), members in batches.items():
        assert len(members) * bucket <= 60 or len(members) == 1
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
        full = max(1, 60 // max(bucket, 1))
        assert len(members) == full or (bucket, batch + 1) not in batches
    assert packing.pack(documents(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_bucket_bounds(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(60), rng.randint(1, 12)))
    counts = [rng.randint(1, 5) for _ in lengths]
    buckets = rng.randint(1, 5)
    bounds = packing.bucket_bounds(np.array(lengths), np.array(counts), buckets)
    spread = [x for x, n in zip(lengths, counts) for _ in range(n)]
    assert sum(min(b for b in bounds if b >= x) - x for x in spread) == least_padding(spread, buckets)
    assert len(bounds) <= buckets


# --- passages ----------------------------------------------------------------------------------


def passages_model(rows):
    seen, out = set(), set()
    for i, text in sorted(rows):
        words = words_of(text)
        gone = set()
        for start in range(len(words) - 19):
            window = tuple(words[start : start + 20])
            if window in seen:
                gone.update(range(start, start + 20))
            seen.add(window)
        kept = b" ".join(w for place, w in enumerate(words) if place not in gone)
        out.add((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_passages_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "SHARD_SNIPPETS", 64)
    monkeypatch.setattr(substrings, "HOT_SNIPPETS", 2 if hot else 4096)
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(300)]
    passages = [rng.choices(vocabulary, k=k) for k in (19, 20, 21, 35, 60, 200)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choices(vocabulary, k=rng.randint(0, 30))
            if rng.random() < 0.6:
                words += rng.choice(passages)
        rows.append((i * 3, " ".join(words)))
    rows += [(500, "ha " * 70), (501, "x ha ha " * 40), (502, None), (503, ""), (504, "a b " * 30000), (505, rows[3][1]), (506, rows[3][1]), (507, "é b " * 25)]
    got = substrings.repeated_passages(documents(spark, rows + [(None, "x")]))
    assert {tuple(r) for r in got.collect()} == passages_model(rows)


def test_passages_cut_text(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = documents(spark, [(1, passage), (2, f"keep\n\nthis  {passage} end"), (3, "two  blanks"), (None, passage), (4, None)])
    cut = substrings.remove_repeated(docs)
    assert cut.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {1: passage, 2: "keep this end", 3: "two  blanks", None: passage, 4: None}
    assert substrings.remove_repeated(documents(spark, [])).count() == 0
    assert substrings.repeated_passages(documents(spark, [])).count() == 0


def test_fm_index_counts():
    rng = np.random.default_rng(3)
    text = np.concatenate([np.append(rng.integers(1, 5, 30), 0) for _ in range(20)])
    index = fmindex.FMIndex(text, 6)
    for _ in range(200):
        start, k = int(rng.integers(0, len(text) - 6)), int(rng.integers(1, 7))
        pattern = text[start : start + k]
        if (pattern == 0).any():
            continue
        low, high = np.array([0]), np.array([index.size])
        for symbol in pattern[::-1]:
            low, high = index.extend(np.array([symbol]), low, high)
        count = sum((text[i : i + k] == pattern).all() for i in range(len(text) - k + 1))
        assert high[0] - low[0] == count


# --- secrets -----------------------------------------------------------------------------------


def test_secret_base(spark):
    key = "AKIA" + "ABCDEFGHIJKLMNOP"
    cases = {
        "": "", None: "", "password=abc": "", "PassWord = 'abcdef' x": "assign:0:18", "api_key:\"a+/=_.-b\"": "assign:0:17",
        f"é {key} AKIAshort": f"access:2:{2 + len(key)}", "0123456789abcdef01234567": "hex:0:24", "g0123456789abcdef0123456": "",
        "token=" + "a" * 24: "assign:0:30,hex:6:30", "passwordpassword=abcdef": "assign:8:23", "secret: secret=abcdefg": "assign:0:22",
    }
    rows = list(enumerate(cases)) + [(0, ""), (None, key), (50, "plain words " * 20000)]
    got = secrets.scan_secrets(documents(spark, rows)).collect()
    assert len(got) == len(rows) - 1
    for row in got:
        want = list(cases.values())[row["doc_id"]] if row["doc_id"] < 50 else ""
        base = ",".join(s for s in row["spans"].split(",") if s.split(":")[0] in ("assign", "access", "hex"))
        assert base == want and row["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert row["n_assign"] == want.count("assign") and row["n_hex"] == want.count("hex") and row["n_access"] == want.count("access")
    assert secrets.scan_secrets(documents(spark, [])).count() == 0


def spans_model(text):
    """Every pair of parts is tried."""
    base = secrets.base_spans(text)
    weak = [(m.start(), k, m.end()) for k, p in ((3, secrets.IDENTIFIER), (4, secrets.WEAK_SECRET), (5, secrets.ENDPOINT)) for m in p.finditer(text)]
    weak = [w for w in weak if not any(s < w[2] and e > w[0] for s, _, e in base)]
    scopes = secrets._scopes(text) + [len(text) + 1]
    role = {0: "secret", 1: "identifier", 2: "secret", 3: "identifier", 4: "secret", 5: "endpoint"}
    partners = {3: {"secret"}, 4: {"identifier", "endpoint"}, 5: {"secret"}}
    out = list(base)
    for s, k, e in weak:
        low = max(x for x in scopes if x <= s)
        high = min(min(x for x in scopes if x > s), len(text))
        low, high = max(low, s - secrets.SCOPE_CHARS), min(high, e + secrets.SCOPE_CHARS)
        if any(role[k2] in partners[k] and s2 < high and e2 > low for s2, k2, e2 in base + weak if (s2, k2, e2) != (s, k, e)):
            out.append((s, k, e))
    return sorted(out)


def test_weak_parts_need_a_partner():
    secret = "Ab3dEf6hIj9lMn2pQr5tUv"
    assert secrets.written(secrets.spans_of(f"user=bob then {secret} ok")[1]) == "identifier:0:8,secret:14:36"
    assert secrets.spans_of(f"only {secret} here")[1] == [] == secrets.spans_of("user=bob")[1]
    assert secrets.spans_of(f"user=bob\n\n{secret}")[1] == []
    rng = random.Random(9)
    parts = ["user=bob", secret, "https://db.example.org/x", "\n\n", "word " * 30, "password=hunter22", "AKIA" + "Z" * 16, "host: db1"]
    for _ in range(300):
        text = " ".join(rng.choices(parts, k=rng.randint(1, 9)))
        assert secrets.spans_of(text)[1] == spans_model(text)


def test_secrets_directly_after_names_with_a_prefix():
    key, secret = "AKIA" + "ABCDEFGHIJKLMNOP", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzEXAMPLEKEY"
    cases = {
        f"AWS_ACCESS_KEY_ID={key}\nAWS_SECRET_ACCESS_KEY={secret}": "access:18:38,secret:61:102",
        f"DB_USER=bob\nX={secret}": "identifier:3:11,secret:14:55",
        f"MYSQL_USER: bob {secret}": "identifier:6:15,secret:16:57",
        f"AZURE_CLIENT_ID=abc-1\nK={secret}==": "identifier:6:21,secret:24:67",
        f"DB_HOST=db1.local\nK='{secret}'": "endpoint:3:17,secret:21:62",
        f"AWS_SECRET_ACCESS_KEY={secret}": "", f"K={secret}": "", "DB_USER=bob": "", f"user=bob {secret}=1": "", "superuser=bob " + secret: "",
    }
    for text, want in cases.items():
        assert secrets.written(secrets.spans_of(text)[1]) == want, text
    assert secrets.redact(next(iter(cases))) == "AWS_ACCESS_KEY_ID=[SECRET]\nAWS_SECRET_ACCESS_KEY=[SECRET]"


def test_secret_parts_of_any_length_and_distance():
    secret = "Ab3dEf6hIj9lMn2pQr5tUv"
    far = "user=bob" + " word" * 2000 + "\n" + secret
    assert secrets.written(secrets.spans_of(far)[1]) == "identifier:0:8,secret:10009:10031"
    assert secrets.spans_of(far.replace("\n", "\n\n"))[1] == []
    for n in (128, 129, 130, 5000):
        assert secrets.written(secrets.spans_of("user=bob " + (secret * n)[:n] + " x")[1]) == f"identifier:0:8,secret:9:{9 + n}"
    url = "https://host.example.org/" + "path/" * 60 + "?sig=" + secret + "%2F" + secret + "%3D"
    assert secrets.redact(f"see {url} there") == "see [SECRET] there"
    assert secrets.redact(f"login={'ab.' * 40}c {secret} x") == "[SECRET] [SECRET] x"
    # A certain span inside a URL does not keep the rest of it.
    assert secrets.redact(f"{url}&token=abcdef {secret}") == "[SECRET] [SECRET]"
    assert secrets.redact("https://" + "a" * 300 + "/?k=" + "0123456789abcdef" * 2 + "&s=x%2Fy .") == "[SECRET] ."


def test_redaction(spark):
    docs = documents(spark, [(1, "a password=hunter22 b"), (2, None), (None, "token=" + "a" * 24), (3, "")])
    got = secrets.redact_secrets(docs)
    assert got.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: "a [SECRET] b", 2: None, None: "[SECRET]", 3: ""}


# --- toxicity ----------------------------------------------------------------------------------


def test_grammar_reads_clauses():
    lexicon = {"fool": 2.0, "cret*": 1.0}
    name = lambda text: {k for k, v in zip(toxicity.FEATURES, toxicity.features(text, lexicon)) if v}
    assert name("what a fool") == {"insult"} and name("You utter cretin!") == {"targeted"}
    assert name("he is not a fool") == {"negated"} and name("not now. a fool") == {"insult"}
    assert name("not one two three four fool") == {"insult"}
    assert name("she said that he is a fool") == {"reported"}
    assert name("i will kill you") == {"threat"} and name("kill the process") == set() and name("") == set()


def toxic_table(spark, n=400):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        words = rng.choices([f"w{j}" for j in range(200)], k=30)
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(30), rng.choice(["gork", "blim" + rng.choice("abcdef")]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_table(spark)
    rows += [(1000, None), (1001, ""), (1001, ""), (None, "gork"), (1002, "w1 " * 30000 + "gork blimz gork")]
    docs = documents(spark, rows)
    known = spark.createDataFrame([*labels, (1000, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, known)
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == len(rows) - 1
    truth = dict(labels)
    tested = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(tested) > 50 and sum(r["predicted"] == truth[r["doc_id"]] for r in tested) >= 0.97 * len(tested)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    long = next(r for r in got if r["doc_id"] == 1002)
    assert long["predicted"] == 1
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == {r["doc_id"] for r in got if not r["predicted"]}


def test_toxicity_labels_held_out_are_not_read(spark):
    rows, labels = toxic_table(spark)
    docs = documents(spark, rows)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    flipped = known.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.learn(docs, known) == toxicity.learn(docs, flipped)


def test_toxicity_without_labels(spark):
    docs = documents(spark, [(1, "i will kill you"), (2, "fine")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_toxicity(docs, toxicity.learn(docs, none)).count() == 2
    assert toxicity.score_toxicity(documents(spark, []), toxicity.learn(documents(spark, []), none)).count() == 0
