"""Encoding of a whole corpus with a public byte-level tokenizer, by forced boundaries.

A byte pair that never occurs inside any vocabulary token can never be crossed by a token, so a text may
be cut between the two bytes and the fragments encoded one by one. The cuts used lie between a character
that is no white space and one of the ASCII white space characters: there the pre-splitting pattern
(whose only look-ahead concerns white space) splits as well, so its pieces are the same on both sides of
the cut. ``ForcedEncoder`` verifies from the vocabulary which such pairs are forced, encodes each distinct
fragment once and joins the results; fragments are mostly words, so nearly all of them are known.

Edge cases: a null or empty text gives an empty list; a text of white space is one fragment; a text of
any length is handled whole. Repeated rows give repeated rows; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default place of the public vocabularies; a parameter of every operator.
VOCABULARIES = "/opt/tokenizers"
#: Fixed value: the pattern that splits text before merging, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fragments kept per worker before the store is emptied (memory bound, no effect on results).
KNOWN_LIMIT = 400_000

_BLANKS = " \t\n\r\x0b\x0c"


class _Known(dict):
    """Fragment -> bytes of its int32 ids; filled on demand."""

    def __init__(self, encode, prefix: str = ""):
        super().__init__()
        self.encode, self.prefix = encode, prefix

    def __missing__(self, fragment: str) -> bytes:
        if len(self) >= KNOWN_LIMIT:
            self.clear()
        out = self.encode(self.prefix + fragment)
        if len(fragment) <= 64:
            self[fragment] = out
        return out


class ForcedEncoder:
    """Encodes texts to int32 ids with the ranks in ``path``."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self._bpe = tiktoken.Encoding("forced", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pairs = np.zeros((256, 256), dtype=bool)
        for token in ranks:
            if len(token) > 1:
                b = np.frombuffer(token, dtype=np.uint8)
                self.pairs[b[:-1], b[1:]] = True
        # for each blank, the last bytes of characters after which a cut before it is not forced
        self.exempt = {c: frozenset(np.flatnonzero(self.pairs[:, ord(c)]).tolist()) - frozenset(map(ord, _BLANKS)) for c in _BLANKS}
        usable = "".join(c for c in _BLANKS if all(b >= 128 for b in self.exempt[c]))
        self.by_space = " " in usable
        # a cut stands before each usable blank that follows a character which is no white space of any kind
        self._cuts = re.compile(rf"(?<=\S)(?=[{re.escape(usable)}])") if usable else None
        spaced = b"".join(re.escape(bytes([b])) for b in sorted(self.exempt[" "]))
        self._exempt_space = re.compile(b"[" + spaced + b"] ") if spaced else None
        self._after_blank = re.compile(r"\s ")
        self._first = _Known(self._inner)
        self._rest = _Known(self._inner, " ")
        self._word = _Known(self._plain)

    def _plain(self, text: str) -> bytes:
        return np.array(self._bpe.encode_ordinary(text), dtype=np.int32).tobytes()

    def _inner(self, text: str) -> bytes:
        if self._cuts is None:
            return self._plain(text)
        parts = self._cuts.split(text)
        if len(parts) == 1:
            return self._plain(text)
        if not text.isascii():
            parts = self._joined(parts)
        return b"".join(map(self._word.__getitem__, parts))

    def _joined(self, parts: list[str]) -> list[str]:
        """``parts`` without the cuts after a character whose last byte may be followed by the blank in a token."""
        out = [parts[0]]
        for part in parts[1:]:
            last = ord(out[-1][-1])
            if last >= 128 and 0x80 | (last & 0x3F) in self.exempt[part[0]]:
                out[-1] += part
            else:
                out.append(part)
        return out

    def _plainly_spaced(self, text: str) -> bool:
        """Whether every space follows a character after which the cut is forced."""
        if "  " in text or "\n " in text or text[0] == " " or self._after_blank.search(text):
            return False
        return text.isascii() or self._exempt_space is None or not self._exempt_space.search(text.encode())

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids of ``text`` as native int32 bytes."""
        if not text:
            return b""
        if not self.by_space or not self._plainly_spaced(text):
            return self._inner(text)
        head, *rest = text.split(" ")
        return self._first[head] + b"".join(map(self._rest.__getitem__, rest))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype=np.int32).tolist()

    def count(self, text: str | None) -> int:
        return len(self.encode_bytes(text)) // 4


@lru_cache(maxsize=4)
def encoder(path: str) -> ForcedEncoder:
    """One encoder per worker and vocabulary."""
    return ForcedEncoder(path)


def vocabulary_path(name: str, folder: str = VOCABULARIES) -> str:
    return os.path.join(folder, f"{name}.tiktoken")


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``key`` and ``ids`` (ARRAY<INT>) of every row; no shuffle, one pass over the text column."""
    path = vocabulary_path(vocabulary, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            coded = [enc.encode_bytes(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, coded)]) // 4
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(coded))])
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``key``, the columns ``keep`` and ``n_tokens`` (BIGINT) of every row, by the same encoder."""
    path = vocabulary_path(vocabulary, folder)
    names = [key, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            counts = pa.array([enc.count(t) for t in batch.column(len(names)).to_pylist()], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), counts], names=[*names, "n_tokens"])

    schema = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
    return docs.select(*names, F.col(text)).mapInArrow(run, schema + ", n_tokens bigint")
