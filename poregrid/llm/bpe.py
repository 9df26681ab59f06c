"""Exact byte-level BPE by backtracking over longest matches.

A text is cut into pieces by the tokenizer's own pattern, and each distinct piece is encoded once
per task. Within a piece an Aho-Corasick automaton over the vocabulary gives the longest token that
starts at each byte. The encoder goes from left to right, takes the longest token that is compatible
with the one before, and on a dead end drops back to the next shorter token; a byte position found
to lead nowhere is never tried again, so the work is linear in the piece. Two neighbouring tokens
are compatible if BPE, given their joined bytes, would yield just these two; a sequence in which all
neighbours are compatible is the BPE result. Decoding gathers bytes by a table of token offsets.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np

TOKENIZER_DIR = "/opt/tokenizers"

# Fixed value: the public pre-tokenization pattern of the byte_bpe_50k vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same pattern over ASCII text, with the commonest cases first.
ASCII_PATTERN = r" ?[A-Za-z]+| ?[0-9]+|'(?:[sdmt]|ll|ve|re)| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
# Fixed value: the characters that ``\s`` stands for in it (Unicode White_Space; Python's own \s has more).
BLANKS = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Pieces or chunks whose tokens a task remembers; beyond it the memory starts afresh.
REMEMBERED_TEXTS = 400_000
#: Longer texts are cut up before a blank that follows a non-blank, where the pattern always ends a piece.
BLOCK_CHARS = 1_000_000


class Memo(dict):
    """Text to packed ids (little-endian int32), filled on demand by ``make``."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, text: str) -> bytes:
        packed = self.make(text)
        if len(text) <= 64:
            if len(self) >= REMEMBERED_TEXTS:
                self.clear()
            self[text] = packed
        return packed


class BytePairEncoder:
    """Encoder and decoder for a ``.tiktoken`` file: a base64 token and its rank on each line."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.size = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, int] = {}
        self.pieces = regex.compile(PATTERN).findall
        self.ascii_pieces = re.compile(ASCII_PATTERN, re.ASCII).findall
        # A piece never goes on from a non-blank to a blank, and never looks beyond the blanks after it,
        # so a chunk (blanks, then non-blanks) has the same pieces wherever it stands.
        self.chunks = re.compile(f"[{BLANKS}]*[^{BLANKS}]+|[{BLANKS}]+").findall
        self.uneven = re.compile(f" [{BLANKS}]").search
        self.by_piece = Memo(lambda p: np.array(self.encode_piece(p.encode("utf-8", "surrogatepass")), dtype="<i4").tobytes())
        self.by_chunk = Memo(lambda c: b"".join(map(self.by_piece.__getitem__, self.pieces(c))))
        self.after_blank = Memo(lambda c: b"".join(map(self.by_piece.__getitem__, self.pieces(" " + c))))

    def halves_of(self, token: int) -> tuple[int, int]:
        """The two tokens that BPE joins last to make ``token``; of a byte, itself twice."""
        got = self.halves.get(token)
        if got is None:
            raw = self.tokens[token]
            if len(raw) == 1:
                got = (token, token)
            else:
                parts = [raw[i : i + 1] for i in range(len(raw))]
                while len(parts) > 2:
                    rank, at = min((self.ranks.get(parts[i] + parts[i + 1], self.size), i) for i in range(len(parts) - 1))
                    if rank >= token:
                        raise ValueError(f"token {token} is not made by merges")
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
                got = (self.ranks[parts[0]], self.ranks[parts[1]])
            self.halves[token] = got
        return got

    def shorter_of(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``, or -1."""
        got = self.shorter.get(token)
        if got is None:
            raw, got = self.tokens[token], -1
            for n in range(len(raw) - 1, 0, -1):
                if (rank := self.ranks.get(raw[:n])) is not None:
                    got = rank
                    break
            self.shorter[token] = got
        return got

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE keeps the border between these two tokens.

        The merges inside both are undone from the latest on; if at any point the two tokens that
        touch the border could be merged earlier than the merge undone last, BPE would have crossed it.
        """
        key = (left, right)
        got = self.compatible.get(key)
        if got is not None:
            return got
        bound = self.size
        a, b = left, right
        while True:
            joined = self.ranks.get(self.tokens[a] + self.tokens[b])
            if joined is not None and joined < bound:
                got = False
                break
            a_inner, b_inner = self.halves_of(a)[1], self.halves_of(b)[0]
            if a_inner == a and b_inner == b:
                got = True
                break
            # the later of the two merges is undone; with equal ranks the right one, as BPE merges leftmost first
            if b_inner == b or (a_inner != a and a > b):
                bound, a = a, a_inner
            else:
                bound, b = b + 1, b_inner
        if len(self.compatible) > 2_000_000:
            self.compatible.clear()
        self.compatible[key] = got
        return got

    def encode_piece(self, raw: bytes) -> list[int]:
        """The BPE tokens of the bytes of one piece."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        n = len(raw)
        longest = [0] * n
        for end, rank in self.automaton.iter(raw.decode("latin-1")):
            longest[end - len(self.tokens[rank]) + 1] = rank  # ends rise, so the last is the longest
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                end = at + len(self.tokens[token])
                if not dead[end] and (not out or self.fits(out[-1], token)):
                    break
                token = self.shorter_of(token)
            if token >= 0:
                out.append(token)
                at += len(self.tokens[token])
                token = longest[at] if at < n else 0
            else:
                dead[at] = 1
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                last = out.pop()
                at -= len(self.tokens[last])
                token = self.shorter_of(last)
        return out

    def blocks(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > BLOCK_CHARS:
            cut = start + BLOCK_CHARS
            while (cut := text.find(" ", cut)) >= 0 and text[cut - 1].isspace():
                cut += 1
            if cut < 0:
                break
            yield text[start:cut]
            start = cut
        yield text[start:] if start else text

    def encode_block(self, text: str) -> bytes:
        if text[-1:] == " " or self.uneven(text):
            if text.isascii():  # mostly code, whose chunks hardly come twice
                return b"".join(map(self.by_piece.__getitem__, self.ascii_pieces(text)))
            return b"".join(map(self.by_chunk.__getitem__, self.chunks(text)))
        first, *rest = text.split(" ")  # single blanks only: each later part is a chunk with its blank
        return b"".join([self.by_chunk[first] if first else b"", *map(self.after_blank.__getitem__, rest)])

    def encode_packed(self, text: str | None) -> bytes:
        """The ids as little-endian int32; empty for an empty or null text."""
        if not text:
            return b""
        if len(text) <= BLOCK_CHARS:
            return self.encode_block(text)
        return b"".join(map(self.encode_block, self.blocks(text)))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<i4").tolist()

    def decode_bytes(self, ids) -> bytes:
        """The bytes of a list of ids; of an empty or null list none."""
        ids = np.asarray(ids if ids is not None else [], dtype=np.int64)
        if not len(ids):
            return b""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        source = np.repeat(self.offsets[ids] - (ends - size), size) + np.arange(ends[-1])
        return self.bytes[source].tobytes()

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load_encoder(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> BytePairEncoder:
    """The encoder of a public vocabulary, loaded once per Python process."""
    return BytePairEncoder(os.path.join(folder, f"{name}.tiktoken"))
