"""MinHash near-deduplication of documents by BagMinHash.

A document is the multiset of its five-word shingles. Each shingle carries independent Poisson processes, one for every
unit of its weight; a register of the signature keeps the earliest point that falls to it, so two registers agree with
the probability of the weighted Jaccard similarity, sum of minima over sum of maxima. The units of a weight are
discretised in octaves, [1, 2), [2, 4), ..., each a process that is split in halves, and halves of halves, down to the
unit where its next point lies: a shingle of weight w costs about log w, not w. Only points below a time by which all
registers are filled are ever made, so a document of n shingles costs n first points and some m log m further ones.

Bands of the signature give candidates, which are verified by the exact overlap of the multisets: the k-th occurrence of
a shingle counts as an element of its own, which makes the weighted Jaccard similarity one of sets.

Words are what str.split() gives of the text in lower case. A text of one to four words has one shingle, itself.
Defined results: null counts as the empty text; texts without a word are alike only if identical; identical texts are
always in one class; repeated rows are members of their class each; an empty table gives an empty table; further columns
are ignored, whatever their names. Of a class, the document with the least identifier stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import small_side, text_or_empty, written
from tidemark.llm.lsh import as_lists, link, overlap, spread

SHINGLE, THRESHOLD = 5, 0.8
#: 24 bands of 4 registers find a pair of similarity 0.8 but for 3 in a million.
BANDS, ROWS = 24, 4
CACHE_WORDS = 200_000
#: Documents whose processes run together.
CHUNK = 512

_GOLDEN, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x + _GOLDEN
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def exponential(x: np.ndarray) -> np.ndarray:
    """Exponential times from 64-bit numbers."""
    return -np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingles(text: str | None, hashes: _WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of a text's shingles, repeats included."""
    words = (text or "").lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    if not len(h):
        return h
    size = min(size, len(h))
    out = np.zeros(len(h) - size + 1, dtype=np.uint64)
    for k in range(size):
        out = mix(out ^ h[k : k + len(out)])
    out.sort()
    return out


def multiset_keys(sorted_hashes: np.ndarray) -> np.ndarray:
    """Distinct keys: the k-th occurrence of a shingle is an element of its own."""
    n = len(sorted_hashes)
    if not n:
        return sorted_hashes
    first = np.ones(n, dtype=bool)
    first[1:] = sorted_hashes[1:] != sorted_hashes[:-1]
    starts = np.flatnonzero(first)
    occurrence = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    return np.where(occurrence == 0, sorted_hashes, mix(sorted_hashes ^ mix(occurrence.astype(np.uint64))))


def bag_signatures(bags: list[np.ndarray], registers: int) -> np.ndarray:
    """[bag, register] earliest points of bags of sorted shingle hashes; infinite for an empty bag."""
    total = np.array([len(b) for b in bags], dtype=np.float64)
    signature = np.full((len(bags), registers), np.inf)
    waiting = np.flatnonzero(total)
    until = registers * (np.log(registers) + 8) / np.maximum(total, 1)
    while len(waiting):
        element, bag, weight = [], [], []
        for i in waiting.tolist():
            b = bags[i]
            first = np.ones(len(b), dtype=bool)
            first[1:] = b[1:] != b[:-1]
            at = np.flatnonzero(first)
            element.append(b[at])
            bag.append(np.full(len(at), i))
            weight.append(np.diff(np.append(at, len(b))))
        _run(np.concatenate(element), np.concatenate(bag), np.concatenate(weight), until, signature)
        waiting = waiting[np.isinf(signature[waiting]).any(axis=1)]
        until[waiting] *= 2
    return signature


def _run(element: np.ndarray, bag: np.ndarray, weight: np.ndarray, until: np.ndarray, signature: np.ndarray) -> None:
    """Put all points before the bags' times into the signatures. A process is (random state, bag, weight of its
    shingle, first unit, units, time of its next point)."""
    flat, registers = signature.reshape(-1), np.uint64(signature.shape[1])
    parts = []
    octave = 1
    while True:  # units [octave, 2 * octave), counted from 1
        held = weight >= octave
        if not held.any():
            break
        state = mix(element[held] ^ mix(np.array([octave], dtype=np.uint64)))
        time = exponential(state) / octave
        soon = time < until[bag[held]]
        parts.append((state[soon], bag[held][soon], weight[held][soon], np.full(soon.sum(), octave), np.full(soon.sum(), octave), time[soon]))
        octave *= 2
    state, bag, weight, first, units, time = (np.concatenate(x) for x in zip(*parts, strict=True))
    while len(state):
        leaf = units == 1
        # A unit's point is emitted, and its next one follows.
        s = mix(state[leaf] ^ _MIX1)
        np.minimum.at(flat, bag[leaf] * int(registers) + (s % registers).astype(np.int64), time[leaf])
        s = mix(s ^ _MIX2)
        again = (s, bag[leaf], weight[leaf], first[leaf], units[leaf], time[leaf] + exponential(s))
        # A longer process is split: its point lies in one half, the other half gets a point of its own after it.
        node = ~leaf
        half = units[node] // 2
        s = mix(state[node] ^ _MIX2)
        right = (s & np.uint64(1)).astype(bool)
        low, high = mix(s ^ _MIX1), mix(s ^ _GOLDEN)
        t = time[node]
        common = bag[node], weight[node]
        lower = (low, *common, first[node], half, np.where(right, t + exponential(low) / np.maximum(half, 1), t))
        upper = (high, *common, first[node] + half, half, np.where(right, t, t + exponential(high) / np.maximum(half, 1)))
        state, bag, weight, first, units, time = (np.concatenate(x) for x in zip(again, lower, upper, strict=True))
        live = (time < until[bag]) & (first <= weight)
        state, bag, weight, first, units, time = (x[live] for x in (state, bag, weight, first, units, time))


def bands_of(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """[bag, band] 64-bit hashes."""
    values = signature[:, : bands * rows].reshape(len(signature), bands, rows).view(np.uint64)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), values.shape[:2]).copy()
    for k in range(rows):
        out = mix(out ^ values[:, :, k])
    return out.view(np.int64)


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = text_or_empty(text)
    return docs.select(
        F.col(key).alias("id"), F.xxhash64(body).alias("node"), F.unhex(F.md5(body)).alias("digest"), body.alias("body")
    )


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, node, digest, n, bands): n is the number of shingles; texts without a word have no bands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for b in batches:
            for at in range(0, len(b), CHUNK):
                part = b.iloc[at : at + CHUNK]
                bags = [shingles(t, hashes) for t in part["body"]]
                found = bands_of(bag_signatures(bags, bands * rows), bands, rows)
                yield pd.DataFrame(
                    {
                        "id": part["id"].to_numpy(),
                        "node": part["node"].to_numpy(),
                        "digest": part["digest"].to_numpy(),
                        "n": [len(x) for x in bags],
                        "bands": [found[i] if len(x) else [] for i, x in enumerate(bags)],
                    }
                )

    kind = docs.schema[key].dataType.simpleString()
    return _keyed(docs, key, text).mapInPandas(run, f"id {kind}, node long, digest binary, n long, bands array<long>")


def keys(rows: DataFrame) -> DataFrame:
    """(node, digest, item) of (node, digest, body); the item is the multiset's distinct keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for b in batches:
            for at in range(0, len(b), CHUNK):
                part = b.iloc[at : at + CHUNK]
                found = [multiset_keys(shingles(t, hashes)).view(np.int64) for t in part["body"]]
                yield pd.DataFrame({"node": part["node"].to_numpy(), "digest": part["digest"].to_numpy(), "item": found})

    return rows.select("node", "digest", "body").mapInPandas(run, "node long, digest binary, item array<long>")


def classes(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, class_size, kept) of every document; class_id is the least identifier of the class."""
    signed = written(signatures(docs, key, text), "signatures")
    distinct = signed.groupBy("digest").agg(
        F.min("id").alias("id"), F.first("node").alias("node"), F.first("bands").alias("bands"),
        F.count(F.lit(1)).alias("copies"),
    )
    distinct = written(distinct, "distinct")
    texts = _keyed(docs, key, text)

    def fetch(wanted: DataFrame) -> DataFrame:
        """One row of each wanted text, by the identifier of its first copy."""
        chosen = distinct.join(wanted, "node").select(F.col("id").alias("of"), F.col("digest").alias("wanted"))
        chosen = small_side(written(chosen, "wanted"))
        same = F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("wanted"))
        return keys(texts.join(chosen, same)).dropDuplicates(["digest"])

    linked = link(spread(distinct), fetch, overlap(threshold), as_lists, threshold)
    rooted = distinct.join(linked, "digest", "left").select("digest", "id", "copies", F.coalesce("root", "digest").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_size"))
    of_digest = rooted.select("digest", "root").join(groups, "root").select("digest", "class_id", "class_size")
    return signed.select("id", "digest").join(of_digest, "digest").select(
        F.col("id").alias(key), "class_id", "class_size", F.col("id").eqNullSafe(F.col("class_id")).alias("kept")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
