"""Operator 8, token counts: byte-pair merging with a heap and a linked list.

The tokenizer's file gives the normaliser, the word pattern and the ranked merges; no identifiers are made. Every
word starts as one symbol for each byte (the last with the word-end mark). A heap holds the adjacent pairs by rank
and place; the lowest is popped again and again, its two symbols merge and the neighbours, kept in a doubly linked
list, form new pairs. A word's count is its initial symbols minus its merges. Words are cached in the worker.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows each get a row; special strings
inside a text count as one token each and cut it; extra columns are dropped. Texts are taken whole, at any length.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_or_null
from .tokens import byte_alphabet, chunks, tokenizer_path, worker_cached

CACHE_WORDS = 400_000


class PairMerger:
    """Counts the tokens of words and texts under a BPE file with word-end marks."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        ids = {s: i for i, s in enumerate(model["vocab"])}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: pair of symbols -> rank and the merged symbol
        self.rank = {(ids[a], ids[b]): (r, ids[a + b]) for r, (a, b) in enumerate(merges) if a in ids and b in ids and a + b in ids}
        alphabet = byte_alphabet()
        self.inner = [ids[alphabet[b]] for b in range(256)]
        self.last = [ids[alphabet[b] + self.suffix] for b in range(256)]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")").split
        self.blank = regex.compile(r"\s+").split
        self.limit = cache_words
        count = self.count_piece

        class Pieces(dict):
            def __missing__(self, piece: str) -> int:
                n = self[piece] = count(piece)
                return n

        self.pieces = Pieces()

    def count_word(self, word: bytes) -> int:
        """Initial symbols minus merges."""
        n = len(word)
        if n < 2:
            return n
        inner, rank = self.inner, self.rank
        symbol = [inner[b] for b in word[:-1]]
        symbol.append(self.last[word[-1]])
        heap = []
        for i in range(n - 1):
            found = rank.get((symbol[i], symbol[i + 1]))
            if found:
                heap.append((found[0], i, found[1], symbol[i], symbol[i + 1]))
        heapq.heapify(heap)
        after, before, merged = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, new, left, right = pop(heap)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue  # one of the two has merged meanwhile
            merged += 1
            symbol[i], symbol[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = rank.get((new, symbol[k]))
                if found:
                    push(heap, (found[0], i, found[1], new, symbol[k]))
            h = before[i]
            if h >= 0:
                found = rank.get((symbol[h], new))
                if found:
                    push(heap, (found[0], h, found[1], symbol[h], new))
        return n - merged

    def count_piece(self, piece: str) -> int:
        """Tokens of text without white space and special strings."""
        if not piece:
            return 0
        if not piece.isascii():
            piece = "".join(map(str.lower, unicodedata.normalize("NFC", piece)))
        else:
            piece = piece.lower()
        if piece.isalpha():
            return self.count_word(piece.encode())
        head = piece[:-1]
        if head.isalpha() and piece[-1] in ",.":
            return self.pieces[head] + self.count_word(piece[-1].encode())
        return sum(self.count_word(w.encode()) for w in self.find(piece))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self.pieces) > self.limit:
            self.pieces.clear()
        if any(s in text for s in self.specials):
            parts = self.cut(text)
            return len(parts) // 2 + sum(self.count(t) for t in parts[::2])
        pieces = text.split() if not any(c in text for c in "\x1c\x1d\x1e\x1f") else self.blank(text)
        return sum(map(self.pieces.__getitem__, pieces))


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 2048) -> DataFrame:
    """Rows doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row of docs (doc_id, text)."""
    path = tokenizer or tokenizer_path("word_bpe_49k.json")

    def count(batches):
        merger = worker_cached(("merger", path), lambda: PairMerger(path))
        for b in chunks(batches):
            texts = b.column("text").to_pylist()
            n = [merger.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = columns_or_null(docs, {"doc_id": "bigint", "text": "string"}).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"))
    return rows.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
