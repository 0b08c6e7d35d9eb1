"""Whole-corpus encoding with a public byte-level BPE vocabulary.

Speculate and verify: a word is first cut greedily into the longest tokens.
The cut is the true one exactly if no merge could have crossed any boundary
between two neighbours, which is tested for all pairs of a batch at once with
array operations; only words with a failing pair are merged step by step.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public tokenizer files, and the vocabulary used unless another is named.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.json"
# Fixed value: the published pattern that cuts a text into words for this vocabulary.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Letters of the words kept with their ids in a worker; the memory this takes is bounded, the ids are the same without it.
CACHE_LETTERS = 4_000_000
_NEVER = 1 << 30


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(spare)}


class Bpe:
    """Tables of one vocabulary and the encoding of words."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters = byte_letters()
        ids = {name: i for name, i in model["vocab"].items() if all(c in letters for c in name)}
        self.ids = {bytes(letters[c] for c in name): i for name, i in ids.items()}
        self.longest = max(map(len, self.ids))
        n = max(self.ids.values()) + 1
        self.rank, self.left, self.right = np.full(n, -1), np.arange(n), np.arange(n)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for k, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            x, y, z = ids[a], ids[b], ids[a + b]
            self.merges.setdefault((x, y), (k, z))
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = k, x, y
        pairs = np.array([(x << 32) | y for x, y in self.merges], dtype=np.int64)
        order = np.argsort(pairs)
        self._pairs, self._pair_rank = pairs[order], np.array([k for k, _ in self.merges.values()])[order]
        whole = self.rank >= 0
        self.stable = ~whole
        self.stable[whole] = self._compatible(self.left[whole], self.right[whole], self.rank[whole])
        self.cache: dict[str, list[int]] = {}
        self.cached = 0

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self._pairs, keys), len(self._pairs) - 1)
        return np.where(self._pairs[at] == keys, self._pair_rank[at], _NEVER)

    def _compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether merging leaves each pair of neighbours apart until ``limit``.

        The history of a pair is walked back: of the two tokens at the boundary
        the one formed last is undone.  Neighbours that could have merged before
        one of them was used up are incompatible; of equal ranks the left merge
        happens first.
        """
        x, y, limit = a.copy(), b.copy(), limit.copy()
        apart, live = np.ones(len(x), bool), np.arange(len(x))
        while len(live):
            lx, ly = x[live], y[live]
            crossing = self.pair_rank(lx, ly) < limit[live]
            apart[live[crossing]] = False
            rx, ry = self.rank[lx], self.rank[ly]
            go = ~crossing & ((rx >= 0) | (ry >= 0))
            live, lx, ly, rx, ry = live[go], lx[go], ly[go], rx[go], ry[go]
            undo_x = rx > ry
            x[live] = np.where(undo_x, self.right[lx], lx)
            y[live] = np.where(undo_x, ly, self.left[ly])
            limit[live] = np.where(undo_x, rx, ry + 1)
        return apart

    def greedy(self, word: bytes) -> list[int]:
        """Longest tokens from the left."""
        if (whole := self.ids.get(word)) is not None:
            return [whole]
        out, k, n = [], 0, len(word)
        while k < n:
            end = min(n, k + self.longest)
            while (token := self.ids.get(word[k:end])) is None:
                end -= 1
            out.append(token)
            k = end
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the pair of lowest rank, the leftmost of equal ones; n log n in the length of the word."""
        parts = [self.ids[word[k : k + 1]] for k in range(len(word))]
        n = len(parts)
        behind, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        waiting = [(*found, k, parts[k], parts[k + 1]) for k in range(n - 1) if (found := self.merges.get((parts[k], parts[k + 1])))]
        heapq.heapify(waiting)
        while waiting:
            _, token, k, x, y = heapq.heappop(waiting)
            j = behind[k]
            if not alive[k] or j >= n or parts[k] != x or parts[j] != y:
                continue  # one of the two was merged with another neighbour meanwhile
            parts[k], alive[j], behind[k] = token, False, behind[j]
            if behind[k] < n:
                before[behind[k]] = k
            for left in (before[k], k):
                if left >= 0 and behind[left] < n and (found := self.merges.get((parts[left], parts[behind[left]]))):
                    heapq.heappush(waiting, (found[0], found[1], left, parts[left], parts[behind[left]]))
        return [t for t, here in zip(parts, alive) if here]

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of distinct words."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        cuts = [self.greedy(w) for w in raw]
        flat = np.fromiter((t for c in cuts for t in c), np.int64)
        ends = np.cumsum([len(c) for c in cuts])
        wrong = np.zeros(len(words), bool)
        if len(flat):
            owner = np.repeat(np.arange(len(words)), [len(c) for c in cuts])
            np.logical_or.at(wrong, owner, ~self.stable[flat])
            inside = np.setdiff1d(np.arange(len(flat) - 1), ends - 1)
            apart = self._compatible(flat[inside], flat[inside + 1], np.full(len(inside), _NEVER))
            np.logical_or.at(wrong, owner[inside], ~apart)
        return {w: self.merge(raw[k]) if wrong[k] else cuts[k] for k, w in enumerate(words)}

    def encode_batch(self, texts: list[str | None]) -> list[list[str]]:
        """Words of each text; their ids are in ``cache`` afterwards."""
        if self.cached > CACHE_LETTERS:
            self.cache.clear()
            self.cached = 0
        cut = [WORDS.findall(t) if t else [] for t in texts]
        new = list({w for words in cut for w in words if w not in self.cache})
        self.cached += sum(map(len, new))
        self.cache.update(self.encode_words(new))
        return cut


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def _texts(batch: pa.RecordBatch, text: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(text)).to_pylist()


def encode_corpus(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids ARRAY<INT>) of every document, without special tokens.

    Null and empty texts give an empty list.  Texts of any length are encoded
    whole; strings of special tokens are ordinary text; repeated documents each
    give a row; other columns are not read.
    """
    path = f"{tokenizers}/{vocabulary}"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            cut = bpe.encode_batch(_texts(batch, "text"))
            ids = [[i for w in words for i in bpe.cache[w]] for words in cut]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = documents.select(F.col(doc_id).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, f"doc_id {kind}, ids array<int>")


def count_tokens(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens BIGINT) of every document; 0 for null and empty texts."""
    path = f"{tokenizers}/{vocabulary}"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            cut = bpe.encode_batch(_texts(batch, "text"))
            sizes = [sum(len(bpe.cache[w]) for w in words) for words in cut]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])

    kind = documents.select(F.col(doc_id).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(count, f"doc_id {kind}, n_tokens bigint")
