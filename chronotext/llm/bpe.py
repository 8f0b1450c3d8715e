"""BPE encoding and decoding: merges chosen by a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from chronotext.llm.common import texts

NONE = 1 << 60
#: Words whose ids a worker keeps; the others are encoded anew, so memory stays bounded.
CACHED_WORDS = 200_000
# The white space of the vocabulary's patterns (Unicode White_Space).
_SPACE = r"\t-\r\x20\x85\xa0  -     　"


class PairTree:
    """Segment tree over the ranks of adjacent pairs, with the least rank and its leftmost place on top.

    A leaf holds rank * size + place, so that the minimum of two nodes is the lower rank, and the place
    further left of equal ranks. A change of one leaf is a walk to the root.
    """

    def __init__(self, ranks: list[int]):
        self.size = 1 << max(len(ranks) - 1, 0).bit_length()
        self.nodes = [NONE] * (2 * self.size)
        for i, rank in enumerate(ranks):
            if rank < NONE:
                self.nodes[self.size + i] = rank * self.size + i
        for i in range(self.size - 1, 0, -1):
            left, right = self.nodes[2 * i], self.nodes[2 * i + 1]
            self.nodes[i] = left if left < right else right

    def set(self, place: int, rank: int) -> None:
        nodes, i = self.nodes, self.size + place
        nodes[i] = NONE if rank >= NONE else rank * self.size + place
        i >>= 1
        while i:
            left, right = nodes[2 * i], nodes[2 * i + 1]
            least = left if left < right else right
            if nodes[i] == least:
                break
            nodes[i] = least
            i >>= 1

    def top(self) -> int:
        """The place of the leftmost pair of the least rank, -1 without a pair to merge."""
        return -1 if self.nodes[1] >= NONE else self.nodes[1] % self.size


class Vocabulary:
    """A tokenizer file of kind BPE with word ends: symbols, merges by pair, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model = described["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        # (left id, right id) -> (rank, id of both joined)
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.ids[left], self.ids[right]] = (rank, self.ids[left + right])
        self.bytes = _byte_symbols()
        pattern = next(p["pattern"]["Regex"] for p in described["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", _SPACE), regex.V0)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.word_ids = lru_cache(CACHED_WORDS)(self._word_ids)

    def _word_ids(self, word: str) -> tuple[int, ...]:
        symbols = [self.bytes[b] for b in word.encode()]
        symbols[-1] += self.end
        return tuple(self.merge([self.ids[s] for s in symbols if s in self.ids]))

    def merge(self, ids: list[int]) -> list[int]:
        """Merge the leftmost pair of the lowest rank until none can be merged: n log n steps."""
        n = len(ids)
        if n < 2:
            return ids
        whole = NONE, -1
        merges = self.merges
        tree = PairTree([merges.get(pair, whole)[0] for pair in zip(ids, ids[1:])])
        # Symbols keep their first place; links skip what has been merged away.
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        while (i := tree.top()) >= 0:
            j = following[i]
            ids[i] = merges[ids[i], ids[j]][1]
            ids[j] = -1
            after, before = following[j], previous[i]
            following[i] = after
            if j < n - 1 or after < n:
                tree.set(j, NONE)
            if after < n:
                previous[after] = i
                tree.set(i, merges.get((ids[i], ids[after]), whole)[0])
            else:
                tree.set(i, NONE)
            if before >= 0:
                tree.set(before, merges.get((ids[before], ids[i]), whole)[0])
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text; special tokens written in it become their own ids."""
        out: list[int] = []
        at = 0
        if self.specials is not None and "<" in text:
            for match in self.specials.finditer(text):
                self._encode(text[at : match.start()], out)
                out.append(self.special[match[0]])
                at = match.end()
        self._encode(text[at:] if at else text, out)
        return out

    def _encode(self, text: str, out: list[int]) -> None:
        word_ids = self.word_ids
        for word in self.words.findall(lowered(text)):
            out += word_ids(word)

    def decode(self, ids) -> str:
        """The tokens as they are written in the vocabulary, with spaces between; unknown ids are left out."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids if i in tokens])


def lowered(text: str) -> str:
    """Composed characters (NFC) in lower case, each by itself: sigma has one small form."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def _byte_symbols() -> list[str]:
    """A printable character for each byte: itself if it is printable Latin-1, else from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    symbols = {b: chr(b) for b in printable}
    for b in range(256):
        symbols.setdefault(b, chr(256 + len(symbols) - len(printable)))
    return [symbols[b] for b in range(256)]


@lru_cache(2)
def load(path: str) -> Vocabulary:
    """The vocabulary, read once per worker."""
    return Vocabulary(path)


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) for every row of ``docs`` (doc_id, text) with an id: the token ids of whole texts.

    ``path`` is a vocabulary file that every executor has at this place. Texts are encoded where they are
    read, without a shuffle. Null and empty texts have no ids; repeated rows give one row each; other columns
    are not read. A single word of any length is merged in n log n steps.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = load(path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [vocabulary.encode(t) for t in batch["text"]]})

    return texts(docs).mapInPandas(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) for every row of ``encoded`` (doc_id, ids); null ids give a null text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = load(path)
        for batch in batches:
            decoded = [None if ids is None else vocabulary.decode(ids.tolist()) for ids in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": decoded})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what ``encode_texts`` and ``decode_ids`` give.

    Encoding, decoding and digests are one pass over the texts, so the ids never leave the task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = load(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = vocabulary.encode(text)
                written = np.array(ids, dtype="<u4").tobytes()
                decoded = vocabulary.decode(ids).encode()
                rows.append((doc_id, len(ids), hashlib.sha256(written).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
