"""Byte-level BPE encoding and decoding by a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list. Every adjacent pair whose joined bytes have a merge rank stands in the bucket
of that rank; three levels of 64-bit words say which buckets hold anything, so the next rank is found by three
find-first-set steps, whatever the length of the pre-token. A merge leaves entries of its neighbours behind in other
buckets; these are stale and skipped when they come up. An encode is O(n log n) at worst in the length of a pre-token,
against O(n^2) for a scan of all pairs, which is what makes pre-tokens of megabytes (no white space at all) feasible.

Defined results: null text encodes as the empty text (no ids, empty bytes); repeated rows give repeated rows; an empty
table gives an empty table; further columns of the input are ignored, whatever their names; texts are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import with_found

DEFAULT_RANKS = "byte_bpe_multi_50k.tiktoken"
#: Recent pre-tokens kept with their ids in each Python worker, in two generations of this size (about 270 MB
#: together), and the longest one worth keeping.
CACHE_ENTRIES, CACHE_CHARS = 600_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class RankQueue:
    """Positions by merge rank; pop() gives a position of the lowest rank, leftmost first."""

    def __init__(self, n_ranks: int) -> None:
        self.low = [0] * (n_ranks // 64 + 1)
        self.mid = [0] * (len(self.low) // 64 + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, entries: list[tuple[int, int]]) -> None:
        """Add (rank, position) entries."""
        buckets, low = self.buckets, self.low
        for rank, position in entries:
            if rank in buckets:
                heappush(buckets[rank], position)
            else:
                buckets[rank] = [position]
                word = rank >> 6
                if not low[word]:
                    group = word >> 6
                    self.mid[group] |= 1 << (word & 63)
                    self.top |= 1 << group
                low[word] |= 1 << (rank & 63)

    def pop(self) -> tuple[int, int] | None:
        top = self.top
        if not top:
            return None
        group = (top & -top).bit_length() - 1
        bits = self.mid[group]
        word = (group << 6) + (bits & -bits).bit_length() - 1
        bits = self.low[word]
        rank = (word << 6) + (bits & -bits).bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            position = heappop(bucket)
        else:
            position = bucket[0]
            del self.buckets[rank]
            self.low[word] &= self.low[word] - 1
            if not self.low[word]:
                self.mid[group] &= self.mid[group] - 1
                if not self.mid[group]:
                    self.top &= self.top - 1
        return rank, position


class Codec:
    """Encoder and decoder over one rank table and one pre-token pattern."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        self.ranks = read_ranks(path)
        self.find = regex.compile(pattern).findall
        size = max(self.ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.decimal = [str(i) for i in range(size)]
        self.single = [self.ranks[bytes([i])] for i in range(256)]
        self.queue = RankQueue(size)
        self.seen = _Seen(self)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n, push, pop, get = len(piece), self.queue.push, self.queue.pop, ranks.get
        after, before = list(range(1, n + 2)), list(range(-1, n))
        ids = [self.single[x] for x in piece]
        pair = [get(piece[i : i + 2]) for i in range(n - 1)] + [None, None]
        push([(rank, i) for i, rank in enumerate(pair) if rank is not None])
        while (least := pop()) is not None:
            rank, i = least
            if pair[i] != rank:
                continue  # stale: a neighbour has changed since
            j = after[i]
            k = after[j]
            ids[i], after[i], before[k], pair[j] = rank, k, i, None
            h, new = before[i], []
            if k < n:
                pair[i] = rank = get(piece[i : after[k]])
                if rank is not None:
                    new.append((rank, i))
            else:
                pair[i] = None
            if h >= 0:
                pair[h] = rank = get(piece[h:k])
                if rank is not None:
                    new.append((rank, h))
            if new:
                push(new)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def encode_packed(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.seen.__getitem__, self.find(text))) if text else b""

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class _Seen(dict):
    """Packed ids of recent pre-tokens. A full generation becomes the old one, and what is asked for again comes back
    from there, so memory is bounded and frequent pre-tokens stay."""

    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec, self.old = codec, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            ids = self.codec.merge(piece.encode("utf-8", "surrogatepass"))
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[piece] = packed
        return packed


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each Python worker."""
    return Codec(path)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every whole text."""

    def compute():
        c = codec(path)
        return lambda texts: [pa.array([c.encode(t) for t in texts], pa.list_(pa.int32()))]

    return with_found(docs.select(F.col(key), F.col(text)), text, "ids array<int>", compute).select(F.col(key), "__found.ids")


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded binary) of every list of ids; null decodes as the empty one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for b in batches:
            yield pd.DataFrame({key: b[key], "decoded": [c.decode(() if x is None else x) for x in b["__ids"]]})

    source = encoded.select(F.col(key), F.col(ids).alias("__ids"))
    return source.mapInPandas(run, f"`{key}` {encoded.schema[key].dataType.simpleString()}, decoded binary")


def round_trip_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): each text encoded, its ids decoded again, in one pass over the
    documents, so that the ids (some four bytes for every three of text) never travel between processes."""

    def compute():
        c = codec(path)

        def of(texts: list[str]) -> list:
            n, left, right = [], [], []
            for t in texts:
                ids = c.encode(t)
                n.append(len(ids))
                left.append(hashlib.sha256(",".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
                right.append(hashlib.sha256(c.decode(ids)).hexdigest())
            return [n, left, right]

        return of

    out = with_found(docs.select(F.col(key), F.col(text)), text, "n_tokens long, ids_sha256 string, decoded_sha256 string", compute)
    return out.select(F.col(key), "__found.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip_digests(docs, public_tokenizers.path(DEFAULT_RANKS))
