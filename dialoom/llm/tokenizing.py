"""Whole texts to ids with the ``tokenizers`` library, a cached chunk at a time.

Both vocabularies used here never join characters across a single space, or a line feed, that
stands between characters other than white space, so a text may be encoded in chunks cut there.
A chunk's ids are kept, as little-endian unsigned 32-bit bytes; chunks that touch other
white space send the whole text to the library in one piece.  New chunks of plain letters,
digits and marks go to the library's model directly, split as its pre-tokenizer does: a word of
letters is one piece, a word and the marks behind it are the word's chunk and the marks' piece,
and other chunks are split by expression.  Any other chunk goes through the library's whole
encoder.  Texts of an Arrow batch are cut, and their chunks told apart, in Arrow; numpy lays
the ids of the chunks end to end.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: chunks whose ids are kept at most; later ones are encoded anew each time
CACHED = 600_000
#: bytes of text that are laid out at once; a longer text is one piece
SLICE_BYTES = 8 << 20

# How the two kinds of vocabulary cut a chunk of text.
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: marks that may end a word; a run of them behind letters is a piece of its own
MARKS = "!#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def public_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """Printable stand-ins of the 256 bytes, as byte-level vocabularies have them: printable
    Latin-1 stands for itself, the others follow from code point 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


class _Chunks(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, chunk: str) -> bytes | None:
        ids = self.make(chunk)
        if len(self) < CACHED:
            self[chunk] = ids
        return ids


class Encoder:
    """Encodes texts by one vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        with open(path) as f:
            spec = json.load(f)
        self.lower = spec["normalizer"] is not None
        self.split = regex.compile(WORD_SPLIT if self.lower else BYTE_SPLIT)
        self.table = byte_letters()
        self.first = _Chunks(lambda chunk: self.chunk_ids(chunk, True))
        self.later = _Chunks(lambda chunk: self.chunk_ids(chunk, False))
        self.marks = _Chunks(lambda marks: self.piece_ids([marks]))

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece_ids(self, pieces: list[str]) -> bytes:
        tokenize, table = self.model.tokenize, self.table
        return array("I", [t.id for piece in pieces for t in tokenize(piece.encode().decode("latin-1").translate(table))]).tobytes()

    def chunk_ids(self, chunk: str, first: bool) -> bytes | None:
        """The chunk's ids, or None where its text can't be encoded in chunks."""
        if not chunk:
            return b"" if first else None
        bare = chunk[1:] if chunk[0] == "\n" and not first else chunk
        if not bare or bare[0].isspace() or bare[-1].isspace():
            return None
        text = chunk if first or chunk[0] == "\n" else " " + chunk
        plain = bare.isascii() and bare.isprintable() or all(c < "ɐ" and (c.isalnum() or c in "!?.,;:-") for c in bare)
        if not plain:
            return self.whole(text)
        if bare is chunk:
            word = bare.rstrip(MARKS)
            if word and len(word) < len(bare) and word.isalpha() and (not self.lower or word.lower().isalpha()):
                return (self.first if first else self.later)[word] + self.marks[bare[len(word) :]]
        if self.lower:
            bare = unicodedata.normalize("NFC", bare).lower()
            if bare.isalpha():  # white space before a word is dropped
                return self.piece_ids([bare])
            text = unicodedata.normalize("NFC", text).lower()
        elif text[0] != "\n" and bare.isalpha():
            return self.piece_ids([text])
        return self.piece_ids(self.split.findall(text))

    def encode_rows(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end as unsigned 32-bit integers, ``end`` behind each text's;
        the places where each text's ids begin, and the last ends)."""
        cut = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " \n"), " ")
        begin = cut.offsets.to_numpy().astype(np.int64)
        told = cut.flatten().dictionary_encode()
        # No chunk holds a space, so one string of all of them splits into them again.
        distinct = pa.ListArray.from_arrays([0, len(told.dictionary)], told.dictionary.cast(pa.string()))
        codes, chunks = told.indices.to_numpy().astype(np.int64), pc.binary_join(distinct, " ")[0].as_py().split(" ")
        ids = list(map(self.later.__getitem__, chunks))
        heads, which = np.unique(codes[begin[:-1]], return_inverse=True)
        codes[begin[:-1]] = len(ids) + which
        ids += [self.first[chunks[c]] for c in heads]
        lost = [k for k, x in enumerate(ids) if x is None]
        rows = np.unique(np.searchsorted(begin, np.flatnonzero(np.isin(codes, lost)), "right") - 1) if lost else ()
        for k in lost:
            ids[k] = b""
        stop, none = len(ids), len(ids) + 1
        ids += [array("I", [end]).tobytes(), b""]
        for r in rows:  # one whole text in the place of its first chunk
            codes[begin[r] : begin[r + 1]] = none
            codes[begin[r]] = len(ids)
            ids.append(self.whole(texts[r].as_py()))
        codes = np.insert(codes, begin[1:], stop)
        counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        own = counts[codes]
        ends = np.cumsum(own)
        at = np.arange(ends[-1]) + np.repeat(starts[codes] - ends + own, own)
        return np.frombuffer(b"".join(ids), "<u4")[at], np.concatenate(([0], ends[begin[1:] + np.arange(len(begin) - 1)]))

    def encode_batch(self, texts: pa.Array, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, places) of slices of the batch's rows."""
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        first = 0
        while first < len(texts):
            before = size[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(size, before + SLICE_BYTES, "right")))
            yield first, *self.encode_rows(texts.slice(first, last - first), end)
            first = last

    def encode(self, text: str) -> bytes:
        """Ids of one whole text as little-endian unsigned 32-bit integers."""
        return self.encode_rows(pa.array([text]), 0)[0][:-1].tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
