"""Token ids of whole texts, by the tokenizers library behind a bounded cache of chunks.

Texts are cut where a tokenizer of this kind always has a boundary, and each
distinct chunk is encoded once per worker while it stays in use. The cache has two
generations of at most ``limit`` / 2 chunks: when the young one is full it becomes
the old one, and what is used again moves to the young one. Results equal an
uncached encode of the whole text.
"""

from __future__ import annotations

import os
import sys
from array import array

import numpy as np

#: Marks that are a stretch of their own after a word.
MARKS = ".,;:!?#*$%&|"


def byte_letters() -> list[str]:
    """The letter by which byte-level tokenizers spell each byte: itself where visible in Latin-1, else from U+0100 on."""
    out, extra = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class ChunkEncoder:
    """Cuts texts by ``_cut`` and joins the ids of their chunks, kept as little-endian bytes."""

    def __init__(self, path: str, limit: int = 1_000_000) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.dtype == "<u2" else "I"
        self.model = self.tok.model
        self.letters = byte_letters()
        self.marks: dict[str, bytes] = {}
        self.half = limit // 2
        self.young: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}

    def _pack(self, ids: list[int]) -> bytes:
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def whole(self, text: str) -> bytes:
        return self._pack(self.tok.encode(text, add_special_tokens=False).ids)

    def _plain(self, word: str) -> bytes:
        """Ids of one stretch of letters (a blank before it included): the model alone, as nothing else would change it."""
        if word.isascii():
            spelled = word.replace(" ", self.letters[32])
        else:
            spelled = "".join([self.letters[b] for b in word.encode()])
        return self._pack([t.id for t in self.model.tokenize(spelled)])

    def _mark(self, marks: str) -> bytes:
        """Ids of a run of marks after a word."""
        if marks and marks not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[marks] = self.whole(marks)
        return self.marks[marks] if marks else b""

    @staticmethod
    def _latin(word: str) -> bool:
        """Letters that normal forms leave alone and whose lower case is one letter."""
        return word.isalpha() and (word.isascii() or (max(word) < "ɐ" and "İ" not in word))

    def _cut(self, text: str) -> list[str]:
        raise NotImplementedError

    def _encode(self, chunks: list[str]) -> list[bytes | None]:
        """None for a chunk that can't be encoded apart from its neighbours."""
        raise NotImplementedError

    def _learn(self, chunks: list[str]) -> dict[str, bytes | None]:
        """The young generation, with all of these chunks."""
        if len(self.young) > self.half:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new = []
        for c in dict.fromkeys(c for c in chunks if c not in young):
            if c in old:
                young[c] = old[c]
            else:
                new.append(c)
        if new:
            young.update(zip(new, self._encode(new), strict=True))
        return young

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            chunks = self._cut(text) if text else []
            known = self.young
            try:
                raw = b"".join([known[c] for c in chunks])
            except KeyError:
                known = self._learn(chunks)
                try:
                    raw = b"".join([known[c] for c in chunks])
                except TypeError:
                    raw = self.whole(text)
            except TypeError:
                raw = self.whole(text)
            out.append(np.frombuffer(raw, self.dtype))
        return out


class WordEncoder(ChunkEncoder):
    """For tokenizers that drop white space and case: chunks are what stands between blanks and newlines."""

    def _cut(self, text: str) -> list[str]:
        return text.replace("\n", " ").split(" ")

    def _encode(self, chunks: list[str]) -> list[bytes | None]:
        out: list[bytes | None] = []
        rest: list[str] = []
        for c in chunks:
            body = c.rstrip(MARKS)
            if self._latin(body):
                low = body.lower()
                raw = self.young.get(low) or self.old.get(low)
                if raw is None:
                    raw = self.young[low] = self._plain(low)
                out.append(raw + self._mark(c[len(body) :]))
            else:
                out.append(None)
                rest.append(c)
        more = iter(self.tok.encode_batch_fast(rest, add_special_tokens=False)) if rest else iter(())
        return [self._pack(next(more).ids) if x is None else x for x in out]


class ByteEncoder(ChunkEncoder):
    """For byte-level tokenizers, in which a blank belongs to the word after it.

    A blank or newline between two other characters that aren't white space is
    always a boundary. Chunks follow a blank, which they are encoded with, or begin
    with a newline; a text's first chunk is marked by a leading blank of its own. A
    chunk that is empty or begins or ends with other white space has a neighbour that
    it could merge with: such a text is encoded whole.
    """

    def __init__(self, path: str, limit: int = 1_000_000) -> None:
        super().__init__(path, limit)
        self.newline = self.whole("\n")

    def _cut(self, text: str) -> list[str]:
        chunks = text.replace("\n", " \n").split(" ")
        chunks[0] = " " + chunks[0]
        return chunks

    def _encode(self, chunks: list[str]) -> list[bytes | None]:
        out: list[bytes | None] = []
        rest: list[str] = []
        for c in chunks:
            mark = c[:1] if c[:1] in (" ", "\n") else ""  # a text's first chunk, one after a newline, or one after a blank
            full = c[1:] if mark else c
            if not full or full[0].isspace() or full[-1].isspace():
                out.append(None)
                continue
            body = full.rstrip(MARKS)
            if not self._latin(body):
                out.append(b"")
                rest.append(full if mark == " " else mark + full if mark else " " + full)
            elif mark:
                out.append((self.newline if mark == "\n" else b"") + self._plain(body) + self._mark(full[len(body) :]))
            else:
                raw = self.young.get(body) or self.old.get(body)
                if raw is None:
                    raw = self.young[body] = self._plain(" " + body)
                out.append(raw + self._mark(full[len(body) :]))
        more = iter(self.tok.encode_batch_fast(rest, add_special_tokens=False)) if rest else iter(())
        return [self._pack(next(more).ids) if x == b"" else x for x in out]
