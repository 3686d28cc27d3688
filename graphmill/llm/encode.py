"""Encoding with a public byte-pair tokenizer by forced boundaries.

A byte pair that occurs inside no vocabulary token can never be joined by a
merge, so a text may be cut there.  The fragments are encoded independently,
each distinct one once per worker, and their ids are concatenated.

The tokenizer first splits a text by a pattern that looks ahead in one case
only: a run of blanks leaves its last one to what follows.  So no cut is made
behind a blank.  Nor is one made before an apostrophe, which may begin a
contraction only where it doesn't belong to the signs before it.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import SparkFiles
from pyspark.sql import DataFrame

#: Where the vocabulary files are; a parameter of every function here.
VOCABULARIES = os.environ.get("GRAPHMILL_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern of the vocabulary's published pre-tokenizer.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WIDE_BLANK = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class _Fragments(dict):
    """Ids of fragments; long ones aren't kept, and the table is emptied when full."""

    def __init__(self, encode, longest: int = 48, most: int = 400_000):
        super().__init__()
        self.encode, self.longest, self.most = encode, longest, most

    def __missing__(self, fragment: bytes) -> list[int]:
        ids = self.encode(fragment.decode("utf-8"))
        if len(fragment) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[fragment] = ids
        return ids


class Encoder:
    """A vocabulary of ranks with the table of its certain cuts."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        # no special tokens: their strings are ordinary text
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        joined = np.zeros(65536, bool)
        for t in ranks:
            if len(t) > 1:
                b = np.frombuffer(t, np.uint8).astype(np.int64)
                joined[b[:-1] * 256 + b[1:]] = True
        cut = ~joined.reshape(256, 256)
        cut[:33, :] = False  # behind blanks and control characters
        cut[127, :] = False
        cut[:, 0x80:0xC0] = False  # inside a character
        cut[:, 0x27] = False  # before an apostrophe
        self.cut = cut.ravel()
        narrow = cut.copy()
        narrow[0x80:, :] = False  # where a wide blank may end
        self.narrow = narrow.ravel()
        self.fragments = _Fragments(self.encoding.encode_ordinary)

    def encode_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the offsets of each text's ids; null and empty texts have none."""
        raw = [t.encode("utf-8") if t else b"" for t in texts]
        wide = [bool(t) and not t.isascii() and _WIDE_BLANK.search(t) is not None for t in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(sizes)
        data = b"".join(raw)
        buf = np.frombuffer(data, np.uint8)
        marks = []
        for a in range(0, max(len(buf) - 1, 0), 1 << 22):
            part = buf[a : a + (1 << 22) + 1].astype(np.int32)
            marks.append(np.flatnonzero(self.cut[part[:-1] * 256 + part[1:]]) + a + 1)
        cuts = np.concatenate(marks) if marks else np.zeros(0, np.int64)
        if any(wide):
            of = np.searchsorted(ends, cuts - 1, side="right")
            pair = buf[cuts - 1].astype(np.int32) * 256 + buf[np.minimum(cuts, len(buf) - 1)]
            cuts = cuts[~np.array(wide)[of] | self.narrow[pair]]
        edges = np.union1d(cuts, np.concatenate([[0], ends]))
        known = self.fragments
        pieces = [known[data[a:b]] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        counts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))])
        offsets = np.concatenate([[0], counts[np.searchsorted(edges, ends)]])
        ids = np.fromiter(chain.from_iterable(pieces), np.int32, int(counts[-1]))
        return ids, offsets


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


_SENT: set[tuple[str, str]] = set()


def _shipped(df: DataFrame, path: str) -> str:
    """The path of a vocabulary, which is sent to the workers once per application."""
    sc = df.sparkSession.sparkContext
    if (sc.applicationId, path) not in _SENT:
        sc.addFile(path)
        _SENT.add((sc.applicationId, path))
    return path


def _here(path: str) -> str:
    """The vocabulary on this worker: where the driver has it, or the copy that was sent."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def _chunks(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text at most, one row at least."""
    size, start = 0, 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    for k, n in enumerate(lengths):
        if size and size + n > most:
            yield batch.slice(start, k - start)
            size, start = 0, k
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def encode(docs: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(id, ids) of each row: the token ids of its text, without special tokens.

    Empty and null texts both give the empty list; strings of special tokens
    are ordinary text; repeated rows give repeated results.  No shuffle.
    """
    path = _shipped(docs, os.path.join(folder or VOCABULARIES, f"{vocabulary}.tiktoken"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(_here(path))
        for whole in batches:
            for b in _chunks(whole, 1):
                ids, offsets = e.encode_texts(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], names=[id_column, "ids"])

    return docs.select(id_column, text).mapInArrow(run, f"{id_column} {docs.schema[id_column].dataType.simpleString()}, ids array<int>")


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """The kept columns and n_tokens of each row's text, 0 for empty and null texts."""
    path = _shipped(docs, os.path.join(folder or VOCABULARIES, f"{vocabulary}.tiktoken"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(_here(path))
        for whole in batches:
            for b in _chunks(whole, len(keep)):
                _, offsets = e.encode_texts(b.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(np.diff(offsets), pa.int64())], names=[*keep, "n_tokens"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, text).mapInArrow(run, f"{fields}, n_tokens long")
