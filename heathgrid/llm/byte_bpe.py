"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is exactly one token that can end the prefix's encoding. The encoder
stores that token for each prefix: a token t may end prefix s[:i] if t is s[j:i] and the token stored
for s[:j] and t are what BPE makes of their joined bytes. Walking back from the whole piece gives its
encoding. Prefixes never change when bytes are appended, so appending is exact and costs only the new
bytes; after an edit, only prefixes from the edit on are computed, up to where they agree with the old
ones over the length of the longest token.

Whether two tokens may stand side by side is decided by undoing their merges from the last one back:
if at some point a pair across the border could have merged earlier than what was just undone, BPE
would have merged it.

Defined cases: null and empty texts have no tokens; a byte string that is itself a token with no merge
leading to it is used only where it is a whole piece, as the tiktoken library does.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from heathgrid.llm.common import slices, texts_of

NONE = -1
#: Pieces and token pairs remembered by a worker, to bound its memory; a full memory starts anew.
REMEMBERED = 400_000


def load(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pieces = regex.compile(pattern).findall
        self.pattern = pattern
        self.spelt: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for text, token in ranks.items():
            self.spelt[token] = text
        self.longest = max(map(len, ranks), default=1)
        self.parts: list[tuple[int, int]] = [(t, t) for t in range(len(self.spelt))]
        self.merged: dict[tuple[int, int], int] = {}
        self.made: dict[bytes, int] = {}  # tokens that merging can make
        for token, text in enumerate(self.spelt):
            if len(text) == 1:
                self.made[text] = token
                continue
            for k in range(len(text) - 1, 0, -1):
                a, b = self.made.get(text[:k], NONE), self.made.get(text[k:], NONE)
                if a != NONE and b != NONE and self.beside(a, b):
                    self.parts[token] = a, b
                    self.merged[a, b] = token
                    self.made[text] = token
                    break
        self.reach: dict[bytes, int] = {}  # the longest token that ends in two such bytes
        for text in self.made:
            if len(text) > 1:
                self.reach[text[-2:]] = max(len(text), self.reach.get(text[-2:], 1))
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def beside(self, a: int, b: int) -> bool:
        """Whether BPE leaves a and b as they are when b's bytes follow a's."""
        before = 1 << 62
        merged, parts = self.merged.get, self.parts
        while True:
            if merged((a, b), before) < before:
                return False
            if a > b:
                before, (_, a) = a, parts[a]
                if a == before:
                    before, (b, _) = b + 1, parts[b]
                    if b + 1 == before:
                        return True
            else:
                before, (b, _) = b + 1, parts[b]
                if b + 1 == before:
                    before, (_, a) = a, parts[a]
                    if a == before:
                        return True

    def extend(self, text: bytes, last: list[int], upto: int | None = None) -> None:
        """Append to last, which has the tokens of text's prefixes so far, those of the further prefixes up to `upto`."""
        made, pairs, reach = self.made.get, self.pairs, self.reach.get
        for end in range(len(last) + 1, (len(text) if upto is None else upto) + 1):
            start = end - reach(text[end - 2 : end], 1) if end > 1 else 0
            found = NONE
            if start <= 0:
                start = 1
                token = made(text[:end])
                if token is not None:
                    last.append(token)
                    continue
            for start in range(start, end):
                token = made(text[start:end])
                if token is None:
                    continue
                pair = last[start - 1] << 32 | token
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) >= REMEMBERED:
                        pairs.clear()
                    fits = pairs[pair] = self.beside(last[start - 1], token)
                if fits:
                    found = token
                    break
            if found == NONE:
                raise ValueError("the vocabulary lacks a single byte")
            last.append(found)

    def walk(self, last: list[int]) -> list[int]:
        """The encoding of the whole piece that `last` belongs to."""
        tokens, end = [], len(last)
        while end:
            tokens.append(last[end - 1])
            end -= len(self.spelt[tokens[-1]])
        return tokens[::-1]

    def piece(self, text: bytes) -> list[int]:
        whole = self.ranks.get(text)
        if whole is not None:
            return [whole]
        last: list[int] = []
        self.extend(text, last)
        return self.walk(last)

    def learn(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of sorted pieces; each starts from the stored prefixes that it shares with the piece before it."""
        out, last, before = [], [], b""
        for text in pieces:
            whole = self.ranks.get(text)
            if whole is not None:
                out.append(whole.to_bytes(4, "little"))
                continue
            shared, most = 0, min(len(text), len(before))
            while shared < most and text[shared] == before[shared]:
                shared += 1
            del last[shared:]
            self.extend(text, last)
            before = text
            out.append(b"".join([x.to_bytes(4, "little") for x in self.walk(last)]))
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Each text's token ids as little-endian unsigned 32-bit numbers."""
        split = [self.pieces(x) for x in texts]
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        known = self.known
        new = {y.encode(): y for y in set().union(*split) if y not in known}
        order = sorted(new)
        known.update(zip(map(new.__getitem__, order), self.learn(order), strict=True))
        get = known.__getitem__
        out = [b"".join(map(get, x)) for x in split]
        for x in (y for y in order if len(y) > 256):  # too long to be remembered
            del known[new[x]]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.spelt.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


class Piece:
    """A piece of bytes under edit, with the tokens of its prefixes. Its tokens are always those of a fresh encoding by merging."""

    def __init__(self, encoder: Encoder, text: bytes = b""):
        self.encoder, self.text, self.last = encoder, b"", []
        self.append(text)

    def append(self, more: bytes) -> None:
        self.text += more
        self.encoder.extend(self.text, self.last)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put new in the place of text[start:stop]; returns how many prefixes were computed."""
        old, shift = self.last, start + len(new) - stop
        self.text = self.text[:start] + new + self.text[stop:]
        self.last = old[:start]
        agreed = computed = 0
        while len(self.last) < len(self.text):
            self.encoder.extend(self.text, self.last, len(self.last) + 1)
            computed += 1
            end = len(self.last)
            same = end > start + len(new) and self.last[-1] == old[end - shift - 1]
            agreed = agreed + 1 if same else 0
            # only the stored tokens of so many prefixes bear on a later one; near the start, the start itself does
            if agreed >= self.encoder.longest and min(end, end - shift) >= self.encoder.longest:
                self.last += old[end - shift :]
        return computed

    def tokens(self) -> list[int]:
        return self.encoder.walk(self.last)


_held: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each vocabulary in a worker process."""
    if (path, pattern) not in _held:
        _held[path, pattern] = Encoder(load(path), pattern)
    return _held[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str]) -> DataFrame:
    """keep and ids (binary, little-endian unsigned 32-bit) of every row's text. The vocabulary file is read where the work runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in slices(batches):
            ids = pa.array(own.encode_all(texts_of(batch)), type=pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), ids], names=[*keep, "ids"])

    kinds = dict(docs.dtypes)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", ids binary")


def decode(coded: DataFrame, path: str, pattern: str, keep: list[str]) -> DataFrame:
    """keep and decoded (binary) of every row's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in slices(batches, "ids"):
            texts = pa.array([own.decode(x or b"") for x in batch.column("ids").to_pylist()], type=pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), texts], names=[*keep, "decoded"])

    kinds = dict(coded.dtypes)
    return coded.select(*dict.fromkeys([*keep, "ids"])).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests of both directions, made without moving the texts out of their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        digest = lambda x: hashlib.sha256(x).hexdigest()
        for batch in slices(batches):
            ids = own.encode_all(texts_of(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], type=pa.int64()), pa.array(map(digest, ids), type=pa.string()), pa.array((digest(own.decode(x)) for x in ids), type=pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_and_check(docs: DataFrame, path: str, pattern: str, keep: list[str]) -> DataFrame:
    """keep, ids and round_trip: whether the ids decode to the bytes of the row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in slices(batches):
            texts = texts_of(batch)
            ids = own.encode_all(texts)
            same = [own.decode(x) == y.encode() for x, y in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(ids, pa.binary()), pa.array(same, pa.bool_())], names=[*keep, "ids", "round_trip"])

    kinds = dict(docs.dtypes)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", ids binary, round_trip boolean")
