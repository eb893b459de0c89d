"""Byte-level BPE by monoid tree reduction (operator 6).

The text is cut into matches of a pattern, and each match is encoded for
itself.  A match is encoded by halves: each half recursively, then the two
token lists are joined.  A join re-encodes the bytes of a window of tokens
around the seam and widens it until the tokens outside provably stay:

    A list of tokens is *the* encoding of its bytes exactly when every two
    neighbours are the encoding of their own bytes.  (Merging in rank order,
    the first merge across a boundary would also be made between these two
    neighbours alone.)

So once the window's first and last tokens pass that test with the tokens
beside the window, the joined list is the encoding.  Joining is associative,
and decoding concatenates bytes up the same tree.

The ranks are read on the driver from the path that is given and sent with
the tasks (a fixed vocabulary of about a megabyte).  Workers keep encodings of
recent matches in a table of bounded size, which changes speed only.

Defined cases: a null text is an empty one (no tokens); a null doc_id is kept;
repeated rows are each encoded; an empty table gives an empty result; long
texts are encoded whole, in blocks of matches; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from upkeep.llm.common import map_arrow, slices

LEAF = 16               # bytes that are merged directly
SMALL = 48              # up to here merging scans a list, above it uses a heap
KEPT = 600_000          # matches whose encodings a worker keeps
LONG = 1 << 20          # characters; longer texts are cut into blocks of matches
DECODE_LEAF = 1024      # ids


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.stable: dict[tuple[bytes, bytes], bool] = {}

    def merge(self, data: bytes) -> list[bytes]:
        """Merge neighbours of lowest rank, leftmost first, until none is a token."""
        if len(data) > SMALL:
            return self._merge_heap(data)
        parts, get = [data[i:i + 1] for i in range(len(data))], self.ranks.get
        pair = [get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            low = min((r for r in pair if r is not None), default=None)
            if low is None:
                return parts
            i = pair.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i:
                pair[i - 1] = get(parts[i - 1] + parts[i])
            if i < len(pair):
                pair[i] = get(parts[i] + parts[i + 1])

    def _merge_heap(self, data: bytes) -> list[bytes]:
        n, get = len(data), self.ranks.get
        end = list(range(1, n + 1))             # end of the part that starts here; 0 if none does
        before = list(range(-1, n - 1))         # start of the part before
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(data[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:       # a part of this pair has changed
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := get(data[i:end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if i and (r := get(data[before[i]:stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(data[i:end[i]])
            i = end[i]
        return out

    def stays(self, a: bytes, b: bytes) -> bool:
        """Whether ``a`` and ``b`` side by side are the encoding of their bytes."""
        known = self.stable.get((a, b))
        if known is None:
            if len(self.stable) > KEPT:
                self.stable.clear()
            known = self.stable[a, b] = self.merge(a + b) == [a, b]
        return known

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The encoding of two encoded byte strings put together."""
        if not left or not right:
            return left or right
        a = b = 1
        while True:
            window = self.merge(b"".join(left[len(left) - a:] + right[:b]))
            left_done = a == len(left) or self.stays(left[len(left) - a - 1], window[0])
            right_done = b == len(right) or self.stays(window[-1], right[b])
            if left_done and right_done:
                return left[:len(left) - a] + window + right[b:]
            if not left_done:
                a = min(len(left), 2 * a)
            if not right_done:
                b = min(len(right), 2 * b)

    def tree(self, data: bytes) -> list[bytes]:
        if len(data) <= LEAF:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def encode_match(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern; a match that is a token is that token."""
        if (rank := self.ranks.get(data)) is not None:
            return [rank]
        return [self.ranks[t] for t in self.tree(data)]


class _Recent(dict):
    """Match (text) to the bytes of its ids; emptied when it is full."""

    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec = codec

    def __missing__(self, match: str) -> bytes:
        ids = np.array(self.codec.encode_match(match.encode()), "<u4").tobytes()
        if len(self) >= KEPT:
            self.clear()
        if len(match) <= 64:
            self[match] = ids
        return ids


def encode_text(text: str, pattern: regex.Pattern, recent: _Recent) -> bytes:
    """Ids of a whole text as little-endian unsigned 32-bit integers."""
    if len(text) <= LONG:
        return b"".join(map(recent.__getitem__, pattern.findall(text)))
    matches, blocks = pattern.finditer(text), []
    while block := [m[0] for m in islice(matches, 65536)]:
        blocks.append(b"".join(map(recent.__getitem__, block)))
    return b"".join(blocks)


def decode_ids(ids: list[int], vocabulary: list[bytes]) -> bytes:
    """Bytes of a token list: halves concatenated up the tree."""
    if len(ids) <= DECODE_LEAF:
        return b"".join([vocabulary[i] for i in ids])
    half = len(ids) // 2
    return decode_ids(ids[:half], vocabulary) + decode_ids(ids[half:], vocabulary)


_WORKER: dict[tuple, tuple] = {}


def _worker(path_key: str, pattern: str, ranks: dict[bytes, int]):
    """The codec of this worker process, built once for a vocabulary."""
    key = (path_key, pattern)
    if key not in _WORKER:
        _WORKER.clear()
        vocabulary = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            vocabulary[rank] = token
        _WORKER[key] = (regex.compile(pattern), _Recent(Codec(ranks)), vocabulary)
    return _WORKER[key]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` (binary, little-endian unsigned 32-bit) for every row of
    ``docs`` (``doc_id, text``)."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, recent, _ = _worker(path, pattern, shared.value)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for lo, hi in slices([len(x) for x in texts]):
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo).cast(pa.int64()),
                    pa.array([encode_text(x, compiled, recent) for x in texts[lo:hi]], pa.binary())],
                    ["doc_id", "ids"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id bigint, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, data`` (the decoded bytes) for every row of ``encoded``."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, vocabulary = _worker(path, pattern, shared.value)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            for lo, hi in slices([len(x or b"") for x in ids]):
                data = [decode_ids(np.frombuffer(x or b"", "<u4").tolist(), vocabulary) for x in ids[lo:hi]]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                    pa.array(data, pa.binary())], ["doc_id", "ids", "data"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id bigint, ids binary, data binary")
