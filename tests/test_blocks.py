"""Counts in blocks: every document whole and once, words asked for once a block, results as by plain counting."""

import random
from collections import Counter

from pyspark.sql import functions as F

from chronotext.functions import text as tx
from chronotext.operators import blocks, words
from chronotext.session import materialize


def test_words_are_asked_for_once_a_block_and_documents_are_whole(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_WORDS", 60)
    rng = random.Random(5)
    rows = [(i % 50, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 40)))) for i in range(55)] + [(None, "a b"), (None, "a c"), (60, None)]
    counted = blocks.word_blocks(spark.createDataFrame(rows, "doc_id long, text string"), tx.word_tokens("text"), "doc_id")
    want = {}
    for i, text in rows:
        want.setdefault(i, Counter()).update((text or "").split())
    names = {(r["block"], r["at"]): r["token"] for r in counted.words.collect()}
    docs = counted.documents.collect()
    assert len(docs) == len(want) and len({r["block"] for r in docs}) > 4
    assert {r["doc_id"]: {names[r["block"], w]: n for w, n in zip(r["word"], r["n"])} for r in docs} == want
    asked = Counter((r["block"], r["token"]) for r in counted.words.collect())
    assert set(asked.values()) == {1} and len(asked) < sum(map(len, want.values())) / 2
    totals = {r["token"]: r["n"] for r in counted.words.groupBy("token").agg(F.sum("n").alias("n")).collect()}
    assert totals == sum(want.values(), Counter())


def test_scores_are_summed_in_pieces_of_whole_documents(spark, monkeypatch):
    monkeypatch.setattr(blocks, "CELLS_AT_ONCE", 3)
    rng = random.Random(6)
    weights = {w: [(t, float(rng.randint(1, 9))) for t in rng.sample([None, 1, 2, 3, 4], rng.randint(1, 5))] for w in "abcdef"}
    rows = [(i, " ".join(rng.choices("abcdefxyz", k=rng.randint(0, 12)))) for i in range(40)]
    table = materialize(spark.createDataFrame(list(weights.items()), "token string, topics array<struct<topic:int,weight:double>>"))
    got = words.score_topics(spark.createDataFrame(rows, "doc_id long, text string"), table, tx.word_tokens("text"), F.lit(True), k=9)
    want = Counter()
    for i, text in rows:
        for word in text.split():
            for topic, weight in weights.get(word, []):
                want[i, topic] += weight
    assert {(r["doc_id"], r["topic"]): r["score"] for r in got.collect()} == want
