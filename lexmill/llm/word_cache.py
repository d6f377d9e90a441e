"""Encoding of texts piece by piece, each distinct piece once.

A tokenizer's pre-tokenizer never joins characters across certain cuts, so a text's ids are the ids
of its pieces in a row. The library encodes each distinct piece; a bounded table in each Python
worker remembers what it gave.
"""

from __future__ import annotations

import os
import re
from collections.abc import Collection
from functools import lru_cache
from string import ascii_letters

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries that a worker's table holds. Beyond it, pieces are forgotten that the current batch does not use and that
#: no batch has met again; those met again stay, up to half the table.
TABLE_ENTRIES = 600_000
#: Runs of signs behind words that a table remembers; all are forgotten beyond it.
SIGN_ENTRIES = 50_000


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


#: Signs behind a word that make one pre-token of their own.
_TRAIL = b".,;:!?#*$%&|>"
#: UTF-8 of a word of Latin-1 letters with such signs behind it.
_WORD = rb"^(?P<core>(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)(?P<trail>[.,;:!?#*$%&|>]*)$"


def byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: itself if it prints in Latin-1, else the next from U+0100 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class PieceTable:
    """ids (little-endian bytes of ``dtype``) and decoded text of pieces.

    spaced: the tokenizer is byte-level and each piece follows a space that its first token takes
    along. Otherwise it normalises pieces, drops white space and marks the end of pre-tokens.
    """

    def __init__(self, path: str, dtype: str, spaced: bool = False, decode: bool = False):
        self.path, self.dtype, self.spaced, self.decode = path, np.dtype(dtype), spaced, decode
        self.ids: dict[bytes, bytes] = {}
        self.words: dict[bytes, str] = {}
        self.blank: set[bytes] = set()
        self.again: set[bytes] = set()
        self.trails: dict[bytes, list[int]] = {b"": []}
        tokenizer = load_tokenizer(path)
        self.tokenizer, self.model, self.normalizer = tokenizer, tokenizer.model, tokenizer.normalizer
        self.lowers = self.normalizer is not None and self.normalizer.normalize_str(ascii_letters) == ascii_letters.lower()
        self.tokens = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
        self.letters = dict(enumerate(byte_letters()))
        self.lead = self.letters[32] if spaced else ""

    def word(self, piece: bytes) -> list[int] | None:
        """ids of Latin letters and signs behind them, whose pre-tokens are plain to see; None: another kind of piece."""
        core = piece.rstrip(_TRAIL)
        text = core.decode("utf-8", "replace")
        if self.normalizer and text:
            text = text.lower() if self.lowers and core.isascii() else self.normalizer.normalize_str(text)
        if not text.isalpha() or not (text.isascii() or max(text) <= "\u024f"):
            return None
        mapped = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(self.lead + mapped)]
        return ids if len(core) == len(piece) else ids + self.signs(piece[len(core) :])

    def signs(self, trail: bytes) -> list[int]:
        if trail not in self.trails:
            if len(self.trails) >= SIGN_ENTRIES:
                self.trails = {b"": []}
            self.trails[trail] = [t.id for t in self.model.tokenize(trail.decode())]
        return self.trails[trail]

    def encode(self, pieces: pa.Array) -> pa.Array:
        """Packed ids of each piece. Arrow finds the distinct pieces and splits words from the signs behind them, so that a word is learnt once, whatever signs follow it."""
        coded = pieces.dictionary_encode()
        whole = coded.dictionary
        parts = pc.extract_regex(whole, _WORD)
        split = pc.and_(parts.is_valid(), self.normalizer is None)  # a normaliser might change what the signs join
        cores = pc.if_else(split, parts.field("core"), whole).dictionary_encode()
        trails = pc.if_else(split, parts.field("trail"), pa.scalar(b"", whole.type)).dictionary_encode()
        words = byte_list(cores.dictionary)
        self.learn(words)
        ids = pa.array([self.ids[x] for x in words], pa.large_binary()).take(cores.indices)
        ends = pa.array([np.array(self.signs(x), self.dtype).tobytes() for x in byte_list(trails.dictionary)], pa.large_binary()).take(trails.indices)
        return pc.binary_join_element_wise(ids, ends, pa.scalar(b"", pa.large_binary())).take(coded.indices)

    def learn(self, pieces: Collection[bytes]) -> None:
        """Enter the ids of distinct pieces."""
        new, known = [], []
        for piece in pieces:  # set operators would go through the whole table
            (known if piece in self.ids else new).append(piece)
        self.again.update(known)
        if len(self.ids) + len(new) > TABLE_ENTRIES:
            if len(self.again) > TABLE_ENTRIES // 2:
                self.again = set(known)
            self.ids = {p: self.ids[p] for p in self.again}
            self.words = {p: self.words[p] for p in self.ids if p in self.words}
            self.blank &= self.ids.keys()
            self.trails = {b"": []}
        got = [self.word(p) for p in new]
        rest = [i for i, x in enumerate(got) if x is None]
        lead = " " if self.spaced else ""
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([lead + new[i].decode("utf-8", "replace") for i in rest], add_special_tokens=False), strict=True):
            got[i] = e.ids
        flat, width, at = np.fromiter((i for x in got for i in x), self.dtype).tobytes(), self.dtype.itemsize, 0
        for piece, x in zip(new, got, strict=True):
            end = at + width * len(x)
            self.ids[piece] = flat[at:end]
            at = end
            if not x:
                self.blank.add(piece)
        if self.decode:  # this kind of tokenizer decodes to its tokens, joined by a space
            tokens = self.tokens
            self.words.update((p, " ".join([tokens[i] for i in x])) for p, x in zip(new, got, strict=True))


@lru_cache(maxsize=8)
def piece_table(path: str, dtype: str, spaced: bool = False, decode: bool = False) -> PieceTable:
    return PieceTable(path, dtype, spaced, decode)


#: A space before which a byte-level pre-tokenizer may not cut: white space or the end follows. First bytes of
#: two- and three-byte white space count as white space.
_NO_CUT = rb" (?:[\x09-\x0d\x1c-\x20\xc2\xe1\xe2\xe3]|\z)"
_CUT = re.compile(rb" (?![\x09-\x0d\x1c-\x20\xc2\xe1\xe2\xe3]|\Z)")


def byte_list(array: pa.Array) -> list[bytes]:
    return array.to_numpy(zero_copy_only=False).tolist()


def space_pieces(texts: pa.Array) -> pa.Array:
    """Lists of the pieces of UTF-8 texts between single spaces that the next piece's first token takes along; null is empty."""
    data = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).fill_null(b"")
    lists = pc.split_pattern(data, b" ")
    held = pc.match_substring_regex(data, _NO_CUT)
    if some := byte_list(data.filter(held)):
        place = np.arange(len(lists))
        place[held.to_numpy(zero_copy_only=False)] = len(lists) + np.arange(len(some))
        lists = pa.concat_arrays([lists, pa.array([_CUT.split(x) for x in some], lists.type)]).take(pa.array(place))
    return lists
