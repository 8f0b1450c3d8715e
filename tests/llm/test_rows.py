"""Rows that stages pass on: large ids beside nulls, repeated ids, other columns of any type."""

from datetime import date

import pytest

from chronotext.llm import minhash, secrets, substrings, toxicity

WORDS = " ".join(f"word{i}" for i in range(40))
DOC = "doc_id long, text string, _spans string, day date, tags array<string>"
LARGE = 2**53 + 1


@pytest.fixture
def docs(spark):
    rows = [(LARGE, WORDS), (None, "x y"), (LARGE + 2, "z " + WORDS), (3, None), (4, "password=hunter22 and more")]
    return spark.createDataFrame([(i, t, "s", date(2020, 1, 2), ["a", None]) for i, t in rows], DOC).coalesce(1)


def rest(df):
    return sorted((r["doc_id"] or 0, r["_spans"], r["day"], tuple(r["tags"])) for r in df.collect())


def test_stages_leave_other_columns_alone(docs):
    model = toxicity.Model({}, [1.0, 1.0, 0.3, 0.3, 1.0], -3.0)
    for stage in (lambda d: toxicity.drop_toxic(d, model), substrings.remove_repeated, secrets.redact_secrets):
        out = stage(docs)
        assert out.schema == docs.schema and rest(out) == rest(docs)
    texts = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(docs).collect()}
    assert texts[4] == "[SECRET] and more" or "hunter22" not in texts[4]
    texts = {r["doc_id"]: r["text"] for r in substrings.remove_repeated(docs).collect()}
    assert texts[LARGE] == WORDS and texts[LARGE + 2] == "z" and texts[3] is None


def test_one_id_with_several_texts(spark):
    """Each row is judged by its own text: the empty one is alone, the others are linked with what is like them."""
    other = " ".join(f"other{i}" for i in range(40))
    rows = [(1, WORDS), (2, WORDS + " end"), (1, ""), (5, other), (1, other + " end"), (7, None), (None, WORDS), (LARGE, WORDS)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(
        [(1, 36, 1), (2, 37, 1), (1, 0, 1), (5, 36, 1), (1, 37, 1), (7, 0, 7), (LARGE, 36, 1)]
    )
