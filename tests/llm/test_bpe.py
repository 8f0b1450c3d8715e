"""Encoding and decoding against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chronotext.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(1)
    out = ["", " ", "Hello WORLD", "it's I'LL they've", "a<|endoftext|>B <|startoftext|>", "<|endoftext", "ΑΣ ΟΔΟΣ ς İ ß ẞ", "é é \x85\xa0x",
           "漢字かな \U0001f600‍ ﬁ 1２³½", "x" * 5000, "ab" * 4000, "..!!?? a_b 's't're", "\x00\x1c\x1f tail", "line\r\n\tnext"]
    alphabet = "abcdefghijklmnopqrstuvwxyzABCÉéñßöü 0123456789'.,!?\n"
    return out + ["".join(rng.choices(alphabet, k=rng.randint(1, 200))) for _ in range(300)]


def test_equals_the_library(library):
    vocabulary = bpe.load(PATH)
    for text in texts():
        want = library.encode(text, add_special_tokens=False).ids
        assert vocabulary.encode(text) == want, text[:50]
        assert vocabulary.decode(want) == library.decode(want, skip_special_tokens=False)


def test_pair_tree_finds_leftmost_least():
    rng = random.Random(2)
    for _ in range(50):
        ranks = [rng.choice([bpe.NONE, *range(5)]) for _ in range(rng.randint(1, 20))]
        tree = bpe.PairTree(ranks)
        for _ in range(20):
            i = rng.randrange(len(ranks))
            ranks[i] = rng.choice([bpe.NONE, *range(5)])
            tree.set(i, ranks[i])
            assert tree.top() == (ranks.index(min(ranks)) if min(ranks) < bpe.NONE else -1)


def test_round_trip_query(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(1000, None, "x"), (0, "", "x"), (None, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.round_trip_digests(docs, PATH).collect()
    assert len(got) == len(rows) - 1
    by_id = {r["doc_id"]: r for r in got}
    for i, text, _ in rows[:-1]:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert by_id[i]["n_tokens"] == len(ids)
        assert by_id[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert by_id[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    encoded = bpe.encode_texts(docs, PATH)
    decoded = {r["doc_id"]: r["text"] for r in bpe.decode_ids(encoded, PATH).collect()}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in decoded.items()} == {i: r["decoded_sha256"] for i, r in by_id.items()}
    assert bpe.encode_texts(docs.limit(0), PATH).count() == 0
