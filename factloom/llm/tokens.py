"""Token ids of whole texts by a word-level tokenizer file (lower case, white
space dropped, BPE with word ends).

A text's ids are the ids of its white-space-free chunks, one after the other:
neither the normaliser nor the pre-tokenizer looks across white space (texts that
hold an added token's string go to the tokenizer whole).  Texts of
Latin-1 characters are split further by the pre-tokenizer's pattern with its
categories spelled out, and every distinct piece is encoded once per task.

Merging a piece is the costly part.  A file whose merges are numbered in the
order of its vocabulary is also a rank table (a word's end written as NUL), and
the rank-based library merges it about ten times faster; the tests hold the two
libraries against each other over the whole vocabulary.
"""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np

#: Distinct pieces remembered by a task before it starts afresh.
MAX_PIECES = 1_000_000

# Latin-1 characters by Unicode category, in lower case.
_LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = "\t-\r \x85\xa0"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
#: The pattern that the fast form stands for.
_EXPECTED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class _Pieces(dict):
    """Piece -> its ids as little-endian 32-bit integers."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MAX_PIECES:
            self.clear()
        self[piece] = ids = np.asarray(self.encode(piece), "<u4").tobytes()
        return ids


def rank_form(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary as bytes -> rank, a word's end as NUL; None where ids do
    not follow the merges."""
    model = spec["model"]
    vocab, end = model["vocab"], model.get("end_of_word_suffix")
    if not end or any(vocab.get("".join(m if isinstance(m, list) else m.split(" "))) != 512 + i
                      for i, m in enumerate(model["merges"])):
        return None
    # Byte-level alphabet: printable bytes stand for themselves, the others for
    # the characters from 256 on, in order.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    added = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {}
    for token, i in vocab.items():
        if token in added:
            continue
        body = token.removesuffix(end) if token != end else token
        ranks[bytes(byte_of[c] for c in body) + (b"\0" if body != token else b"")] = i
    return ranks


class WordTokenizer:
    """``ids(text)``: the text's ids as little-endian 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        # The library finds these in a text before anything else.
        self.added = [t["content"].lower() for t in spec.get("added_tokens", [])]
        patterns = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.fast = patterns == [_EXPECTED]
        self.ranked = None
        if self.fast and (ranks := rank_form(spec)):
            import tiktoken

            self.ranked = tiktoken.Encoding("word", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})
        self.pieces = _Pieces(self._merge)
        self.chunks = _Pieces(self._whole)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _merge(self, piece: str) -> list[int]:
        """Ids of one piece of the pre-tokenizer, in lower case."""
        return self._whole(piece) if self.ranked is None or "\0" in piece else self.ranked.encode_ordinary(piece + "\0")

    def ids(self, text: str) -> bytes:
        if self.fast and not any(map(text.lower().__contains__, self.added)):
            try:
                text.encode("latin-1")
                return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text.lower())))
            except UnicodeEncodeError:
                return b"".join([self.chunks[c.decode()] for c in text.encode().split()])
        return np.asarray(self._whole(text), "<u4").tobytes()


@cache
def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per worker process and file."""
    return WordTokenizer(path)
