"""The whole pipeline against the same five steps by brute force on one machine."""

import random
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from chronotext.llm import packing, toxicity
from chronotext.llm.common import table

sys.path.insert(0, str(Path(__file__).parent))
from test_llm_operators import minhash_model, spans_model, words_of  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
KEY = "AKIA" + "ABCDEFGHIJKLMNOP"


def corpus():
    """Documents with toxic words, copies, shared passages, secrets and empty texts, and some labels."""
    rng = random.Random(17)
    vocabulary = [f"w{i}" for i in range(600)]
    passages = [rng.choices(vocabulary, k=k) for k in (19, 20, 45)]
    rows, labels = [], []
    for i in range(300):
        words = rng.choices(vocabulary, k=rng.randint(1, 90))
        toxic = rng.random() < 0.25
        for _ in range(2 * toxic):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["gork", "blim" + rng.choice("abcdef")]))
        if rng.random() < 0.3:
            words += rng.choice(passages)
        if rng.random() < 0.2:
            words.insert(len(words) // 2, rng.choice(["password=hunter22", KEY, "user=bob Ab3dEf6hIj9lMn2pQr5tUv"]))
        rows.append((i * 2, " ".join(words)))
        labels.append((i * 2, int(toxic)))
    for i, (_, text) in enumerate(rng.choices(rows, k=60)):
        near = text.split(" ")
        if len(near) > 60 and rng.random() < 0.5:
            near[-1] = "changed"
        rows.append((700 + i, " ".join(near)))
    rows += [(900, None), (901, ""), (902, "long " * 30000 + KEY)]
    return rows, labels


def after_minhash(rows):
    kept = {i for i, _, _, first in minhash_model(rows) if first}
    return [(i, t) for i, t in rows if i in kept]


def after_passages(rows):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda row: row[0]):
        words, gone = words_of(text), set()
        for start in range(len(words) - 19):
            window = tuple(words[start : start + 20])
            if window in seen:
                gone.update(range(start, start + 20))
            seen.add(window)
        out.append((i, b" ".join(w for p, w in enumerate(words) if p not in gone).decode() if gone else text))
    return out


def without_secrets(text):
    if text is None:
        return None
    inside = np.zeros(len(text) + 1, dtype=bool)
    first = set()
    for start, _, end in spans_model(text):
        if not inside[start]:
            first.add(start)
        inside[start:end] = True
    return "".join("[SECRET]" if p in first else "" if inside[p] else c for p, c in enumerate(text))


def packed(rows):
    lengths = sorted((len(words_of(t)), i) for i, t in rows)
    distinct, counts = np.unique([n for n, _ in lengths], return_counts=True)
    bounds = packing.bucket_bounds(distinct, counts, packing.BUCKETS)
    out, placed = set(), dict.fromkeys(bounds, 0)
    for n, i in lengths:
        bucket = min(b for b in bounds if b >= n)
        batch, slot = divmod(placed[bucket], max(1, packing.TOKEN_BUDGET // max(bucket, 1)))
        out.add((i, n, bucket, batch, slot))
        placed[bucket] += 1
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, labels = corpus()
    docs = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    known = spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int")
    known.write.parquet(f"{tmp_path}/labels.parquet")

    model = toxicity.learn(table(spark, tmp_path, "documents"), table(spark, tmp_path, "labels"))
    clean = [(i, t) for i, t in rows if model.score(t or "") < toxicity.THRESHOLD]
    assert 0 < len(rows) - len(clean) < len(rows) // 2
    single = after_minhash(clean)
    assert len(single) < len(clean)
    cut = after_passages(single)
    assert cut != sorted(single, key=lambda row: row[0])
    hidden = [(i, without_secrets(t)) for i, t in cut]
    assert hidden != cut

    got = corpus_pipeline.run(spark, str(tmp_path))
    columns = ["doc_id", "n_tokens", "bucket", "batch", "slot"]
    assert got.columns == columns
    assert {tuple(r) for r in got.select(*columns).collect()} == packed(hidden)
    assert got.count() == len(hidden)


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    empty = spark.createDataFrame([], DOCS)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (empty, empty.unionByName(spark.createDataFrame([(None, None, None, None, None)], DOCS))):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, str(tmp_path))
            assert out.dtypes == rows.dtypes and out.where(F.lit(True)).count() == rows.count()
