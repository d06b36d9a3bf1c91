"""Token ids of whole texts with a public byte-level tokenizer, and what is built on them.

The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``. A byte-level pre-tokenizer attaches a
single blank to the word behind it and never looks past it, so a text without runs of blanks is encoded as its
blank-separated pieces; the library's model runs once for every distinct word that a task keeps in its cache.
Texts that hold special strings are given to the library whole.
"""

from __future__ import annotations

import array
import gc
from collections.abc import Callable, Iterator

#: Distinct pieces that a worker keeps; beyond it the cache starts anew. Only speed depends on it.
CACHE_PIECES = 360_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the others follow from U+0100."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceEncoder:
    """Encodes texts to unsigned 32-bit ids in native (little-endian) order."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.limit = cache_pieces
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        tokenize, alphabet, pack = self.tok.model.tokenize, byte_alphabet(), array.array
        words: dict[str, bytes] = {}
        self.words = words

        def word(w: str) -> bytes:
            out = words.get(w)
            if out is None:
                out = words[w] = pack("I", [t.id for t in tokenize(w.encode().decode("latin-1").translate(alphabet))]).tobytes()
            return out

        split, blank = self.split, alphabet[ord(" ")]

        class Pieces(dict):
            """The ids of a blank and the piece behind it."""

            def __missing__(self, piece: str) -> bytes:
                if piece.isalpha():
                    shown = blank + piece if piece.isascii() else (" " + piece).encode().decode("latin-1").translate(alphabet)
                    out = pack("I", [t.id for t in tokenize(shown)]).tobytes()
                elif piece[:-1].isalpha():
                    out = self[piece[:-1]] + word(piece[-1])
                else:
                    out = b"".join(map(word, split(" " + piece)))
                self[piece] = out
                return out

        self.word, self.pieces = word, Pieces()

    def whole(self, text: str) -> bytes:
        """As the library gives it, without any cache of ours."""
        return array.array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def payload(self, text: str | None) -> bytes:
        """The ids of a text as bytes, 4 for each id; null counts as empty."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.whole(text)
        if len(self.pieces) > self.limit:
            self.pieces.clear()
        if len(self.words) > self.limit // 3:
            self.words.clear()
        if "  " in text:
            return b"".join(map(self.word, self.split(text)))
        first, *rest = text.split(" ")
        return b"".join(map(self.word, self.split(first))) + b"".join(map(self.pieces.__getitem__, rest))


_CACHED: dict[tuple, object] = {}


def forget() -> None:
    """Give back what earlier tasks of this Python worker have left: cached objects and freed but kept memory."""
    import ctypes

    import pyarrow as pa

    _CACHED.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def worker_cached(key: tuple, make: Callable):
    """One object for each Python worker (workers are reused over tasks); another key takes its place."""
    if key not in _CACHED:
        forget()
        _CACHED[key] = make()
    return _CACHED[key]


def encoder(path: str) -> PieceEncoder:
    return worker_cached(("pieces", path), lambda: PieceEncoder(path))


def chunks(batches: Iterator, most: int = 4 << 20) -> Iterator:
    """Slices of Arrow batches with at most about `most` bytes each (one row at least), so that a task's memory is bounded."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        step = max(1, min(batch.num_rows, int(batch.num_rows * most / max(batch.nbytes, 1))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
