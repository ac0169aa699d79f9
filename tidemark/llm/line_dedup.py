"""Fuzzy line deduplication by MinHash.

A line is the set of its five-character shingles, in lower case. Identical lines are made one by digest. The others get
MinHash signatures: long lines by one permutation, whose shingles are dealt over the registers, empty registers
borrowing from others; short lines, where most registers would be empty, by a function for each register. Lines between
the two kinds get both. Bands of the signatures give candidates, their exact Jaccard similarity is computed from the
lines, and linked lines form components by distributed union-find. One line of each component stays: the first, by
document and number of the line, in the whole corpus.

Lines are what a split at \\n gives; lines of white space only are neither compared nor dropped. Lines of fewer than
five characters are dropped only as exact copies. Defined results: null texts have no lines and stay null; a document
that loses every line keeps an empty text; rows that repeat both identifier and text are one document that was read
twice, and get the same result, since which row of a document stays is not a question of its lines; an empty table gives
an empty table; further columns pass through, whatever their names; lines of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import free_name, freed, slices, small_side, written
from tidemark.llm.lsh import BLOCKS, Dealer, link, n_parts, sketches
from tidemark.llm.near_dedup import mix

SHINGLE, THRESHOLD = 5, 0.8
#: 18 bands of 6 registers find a pair of similarity 0.8 with a probability of 0.9958 (10 bands of 4: 0.9949), one of 0.85
#: with 0.9998, and bring a fourteenth of the unlike lines together that 10 bands of 4 do.
BANDS, ROWS = 18, 6
#: Lines of fewer distinct shingles get a function for each register, those of as many or more one permutation, and those
#: between the two both kinds: similar lines differ in the number of distinct shingles by a fifth at most.
FULL_BELOW, SPARSE_FROM = 100, 80
#: Characters that are hashed together; lines a task remembers; cells in which
#: different shingles are counted.
CHUNK, SEEN, CELLS = 1 << 18, 500_000, 512
#: Pairs that are compared together (4,096 at most); how close to the threshold hashes are not enough.
PAIRS, SLACK = 250, 4.0
_BASE = np.uint64(0x100000001B3)
_BLANK = " \t\n\x0b\x0c\r"


def shingle_hashes(lines: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, line after line, and how many each line has."""
    lengths = np.array([len(x) for x in lines], dtype=np.int64)
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(codes) - size + 1
    counts = np.maximum(lengths - size + 1, 0)
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), counts
    h = codes[:n] * _BASE
    for k in range(1, size - 1):
        h += codes[k : k + n]
        h *= _BASE
    h += codes[size - 1 :]
    # No shingle starts in the last size - 1 characters of a line.
    inside, ends = np.ones(len(codes), dtype=bool), np.cumsum(lengths)
    for k in range(1, size):
        inside[(ends - k)[lengths >= k]] = False
    return mix(h[inside[:n]]), counts


@lru_cache(maxsize=4)
def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(n, dtype=np.uint64) ^ np.uint64(0x5EED)) | np.uint64(1)


def full_signatures(hashes: np.ndarray, counts: np.ndarray, registers: int) -> np.ndarray:
    """[line, register]: the least value of each function."""
    starts = np.cumsum(counts) - counts
    out = np.empty((registers, len(counts)), dtype=np.uint32)
    values = np.empty_like(hashes)
    for k, a in enumerate(_multipliers(registers)):
        np.multiply(hashes, a, out=values)
        out[k] = np.minimum.reduceat(values, starts) >> np.uint64(32)
    return np.ascontiguousarray(out.T)


def sparse_signatures(hashes: np.ndarray, counts: np.ndarray, registers: int) -> np.ndarray:
    """[line, register]: the least value among the shingles dealt to a register; empty ones borrow."""
    empty = np.uint32(0xFFFFFFFF)
    line = np.repeat(np.arange(len(counts), dtype=np.int64) * registers, counts)
    register = ((hashes >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
    out = np.full(len(counts) * registers, empty, dtype=np.uint32)
    np.minimum.at(out, line + register, hashes.astype(np.uint32))
    out = out.reshape(len(counts), registers)
    own = out != empty
    rows = np.flatnonzero(~own.all(axis=1) & own.any(axis=1))
    places = np.arange(registers, dtype=np.uint64)
    attempt = 0
    row, place = np.nonzero(~own[rows])
    row = rows[row]
    while len(row):
        attempt += 1
        lender = (mix(places ^ mix(np.array([attempt], dtype=np.uint64))) % np.uint64(registers)).astype(np.int64)[place]
        take = own[row, lender]
        out[row[take], place[take]] = out[row[take], lender[take]]
        row, place = row[~take], place[~take]
    return out


def bands_of(signature: np.ndarray, kind: int, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """[line, band] hashes."""
    values = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1000 * kind), values.shape[:2]).copy()
    for k in range(rows):
        out = mix(out ^ values[:, :, k])
    return out.view(np.int64)


def _some(hashes: np.ndarray, counts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (hashes, counts) if chosen.all() else (hashes[np.repeat(chosen, counts)], counts[chosen])


def distinct_counts(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many different shingles each line has. They are told apart by as many bits as a line's number leaves of 64."""
    bits = np.uint64(len(counts).bit_length())
    packed = np.repeat(np.arange(len(counts), dtype=np.uint64), counts) << (np.uint64(64) - bits) | hashes >> bits
    packed.sort()
    first = np.ones(len(packed), dtype=bool)
    first[1:] = packed[1:] != packed[:-1]
    return np.bincount((packed[first] >> (np.uint64(64) - bits)).astype(np.int64), minlength=len(counts))


def at_least_distinct(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A lower bound of the same: how many of CELLS cells the shingles of a line fall into."""
    held = np.zeros(len(counts) * CELLS, dtype=bool)
    held[np.repeat(np.arange(len(counts), dtype=np.int64) * CELLS, counts) + (hashes >> np.uint64(64 - 9)).astype(np.int64)] = True
    return np.count_nonzero(held.reshape(len(counts), CELLS), axis=1)


def line_bands(
    lines: list[str], nodes: np.ndarray, bands: int = BANDS, rows: int = ROWS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, [line, band], sketches) of lines with a shingle; a line between the two kinds stands twice."""
    hashes, counts = shingle_hashes(lines)
    distinct = counts.copy()
    unsure = counts >= SPARSE_FROM
    if unsure.any():
        distinct[unsure] = at_least_distinct(*_some(hashes, counts, unsure))
        unsure[distinct >= FULL_BELOW] = False  # surely that many
    if unsure.any():
        distinct[unsure] = distinct_counts(*_some(hashes, counts, unsure))
    out_nodes, out_bands, out_sketches = [np.zeros(0, np.int64)], [np.zeros((0, bands), np.int64)], [np.zeros(0, np.int64)]
    for kind, chosen, make in (
        (0, (distinct > 0) & (distinct < FULL_BELOW), full_signatures),
        (1, distinct >= SPARSE_FROM, sparse_signatures),
    ):
        if chosen.any():
            signature = make(*_some(hashes, counts, chosen), bands * rows)
            out_nodes.append(nodes[chosen])
            out_bands.append(bands_of(signature, kind, bands, rows))
            out_sketches.append(sketches(signature, kind))
    return np.concatenate(out_nodes), np.concatenate(out_bands), np.concatenate(out_sketches)


def banded(docs: DataFrame, text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Blocks of the rows of lines; lines that repeat in a task mostly stand once."""
    parts = n_parts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        waiting: dict[int, str] = {}
        chars, dealer = 0, Dealer(parts)

        def deal() -> Iterator[pa.RecordBatch]:
            yield from dealer.add(*line_bands(list(waiting.values()), np.array(list(waiting), dtype=np.int64), bands, rows))

        for batch in batches:
            for b in slices(batch, 0):
                for t in b.column(0).to_pylist():
                    for line in (t or "").split("\n"):
                        if len(line) < SHINGLE or not line.strip(_BLANK):
                            continue
                        node = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)
                        node -= (node >> 63) << 64
                        if node not in seen:
                            seen.add(node)
                            waiting[node] = line.lower()
                            chars += len(line)
                    if chars >= CHUNK:
                        yield from deal()
                        waiting, chars = {}, 0
                if len(seen) > SEEN:
                    seen.clear()
        yield from deal()
        yield from dealer.flush()

    return docs.select(F.col(text).alias("__text")).mapInArrow(run, BLOCKS)


def _split(docs: DataFrame, key: str, text: str) -> DataFrame:
    # Beside the generator, a text would be hashed for each of its lines.
    hashed = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("of"), F.col(text).alias("text"))
    return hashed.select("id", "of", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(F.col("line").rlike(r"[^ \t-\r]"))


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(at, digest) of every line with a word; at is (id, text hash, line number from 0)."""
    return _split(docs, key, text).select(F.struct("id", "of", "line_no").alias("at"), F.unhex(F.md5("line")).alias("digest"))


def _shingle_set(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(len(line) - SHINGLE + 1)}


def are_alike(left: list[str], right: list[str], threshold: float) -> np.ndarray:
    """Whether the exact Jaccard similarity of the shingles of two lines reaches the threshold, for many pairs of lines.

    Shingles are counted by 51 bits of their hashes, for up to PAIRS pairs in one sort. Only a collision could make such a
    count differ from the exact one, so pairs within SLACK elements of the threshold are compared by the shingles
    themselves."""
    out = np.zeros(len(left), dtype=bool)
    for at in range(0, len(left), PAIRS):
        a, b = [x.lower() for x in left[at : at + PAIRS]], [x.lower() for x in right[at : at + PAIRS]]
        n = len(a)
        hashes, counts = shingle_hashes(a + b)
        places = np.arange(2 * n, dtype=np.uint64)
        # From the top: 12 bits of the pair, 51 of the hash, one of the side.
        packed = hashes >> np.uint64(13) << np.uint64(1)
        packed |= np.repeat((places % np.uint64(n) << np.uint64(52)) | (places // np.uint64(n)), counts)
        packed.sort()
        fresh = np.ones(len(packed), dtype=bool)
        fresh[1:] = packed[1:] != packed[:-1]
        packed = packed[fresh]
        pair = (packed >> np.uint64(52)).astype(np.int64)
        sizes = np.bincount(pair, minlength=n)
        shared = np.bincount(pair[1:][packed[1:] ^ packed[:-1] == 1], minlength=n)
        room = shared * (1 + threshold) - threshold * sizes
        found = room >= 0
        for i in np.flatnonzero(np.abs(room) <= SLACK):
            x, y = _shingle_set(a[i]), _shingle_set(b[i])
            k = len(x & y)
            found[i] = k > 0 and k >= threshold * (len(x) + len(y) - k)
        out[at : at + n] = found & (shared > 0)
    return out


def alike(threshold: float):
    """The same as a condition on two columns."""

    @F.pandas_udf("boolean")
    def test(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(are_alike(left.tolist(), right.tolist(), threshold))

    return lambda a, b: test(a, b)


def lines_told(threshold: float):
    """The same for the bytes of lines, within a task."""
    return lambda left, right: are_alike([x.decode() for x in left], [x.decode() for x in right], threshold)


def line_elements(line: str) -> np.ndarray:
    """The hashes of a line's different shingles."""
    return np.unique(shingle_hashes([line.lower()])[0])


def lines_elements(column: pa.Array) -> list[np.ndarray]:
    """The same for each line of a column, for lines of up to CHUNK characters together (a longer one comes alone)."""
    lines, out, at = [t.lower() for t in column.to_pylist()], [], 0
    while at < len(lines):
        end, chars = at + 1, len(lines[at])
        while end < len(lines) and chars + len(lines[end]) <= CHUNK:
            chars += len(lines[end])
            end += 1
        hashes, counts = shingle_hashes(lines[at:end])
        of = np.repeat(np.arange(end - at), counts)
        order = np.lexsort((hashes, of))
        hashes, of = hashes[order], of[order]
        fresh = np.ones(len(of), dtype=bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
        out += np.split(hashes[fresh], np.searchsorted(of[fresh], np.arange(1, end - at)))
        at = end
    return out


def line_classes(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(digest, rep, class_size) of the distinct lines with a word that are not alone in their class: the place of the line
    that stays for them."""

    def fetch(wanted: DataFrame) -> DataFrame:
        found = _split(docs, key, text).select(F.xxhash64("line").alias("node"), F.col("line").alias("item"))
        found = found.join(small_side(written(wanted, "wanted")), "node")
        return found.select("node", F.unhex(F.md5("item")).alias("digest"), "item").dropDuplicates(["digest"])

    linked = link(banded(docs, text), fetch, alike(threshold), lines_elements, threshold, lines_told(threshold))
    distinct = lines(docs, key, text).groupBy("digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    # Only lines that are repeated or linked are grouped further; all others stand for themselves.
    several = written(
        distinct.join(linked, "digest", "left")
        .filter("n > 1 OR root IS NOT NULL")
        .select("digest", F.coalesce("root", "digest").alias("root"), "first", "n"),
        "several",
    )
    groups = several.groupBy("root").agg(F.min("first").alias("rep"), F.sum("n").alias("class_size"))
    classes = written(several.join(groups, "root").select("digest", "rep", "class_size"), "line-classes")
    freed(several)
    return classes


def judged_lines(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(at, rep, class_size, kept) of every line with a word."""
    classes = line_classes(docs, threshold, key, text)
    return (
        lines(docs, key, text)
        .join(classes, "digest", "left")
        .select(
            "at",
            F.coalesce("rep", "at").alias("rep"),
            F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
            F.coalesce(F.col("at") == F.col("rep"), F.lit(True)).alias("kept"),
        )
    )


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, gone: pd.Series) -> pd.Series:
    """Texts without the lines of these numbers; null where there are none."""
    out = []
    for t, numbers in zip(texts, gone, strict=True):
        if numbers is None:
            out.append(None)
        else:
            drop = set(numbers.tolist())
            out.append("\n".join(line for i, line in enumerate(t.split("\n")) if i not in drop))
    return pd.Series(out, dtype=object)


def without_repeats(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, each text without the lines that another one stands for; all columns stay."""
    of_id, of_text, numbers = (free_name(docs, n) for n in ("__id", "__of", "__gone"))
    gone = (
        judged_lines(docs, threshold, key, text)
        .filter("not kept")
        .groupBy(F.col("at.id").alias(of_id), F.col("at.of").alias(of_text))
        .agg(F.collect_set("at.line_no").alias(numbers))
    )
    # Only texts that lose a line go through Python.
    left = _without(F.when(F.col(numbers).isNotNull(), F.col(text)), F.col(numbers))
    rebuilt: Column = F.when(F.col(numbers).isNull(), F.col(text)).otherwise(left)
    joined = docs.join(gone, F.col(key).eqNullSafe(F.col(of_id)) & (F.xxhash64(text) == F.col(of_text)), "left")
    return joined.select(*[(rebuilt.alias(text) if c == text else F.col(f"`{c}`")) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judged_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select(
        F.col("at.id").alias("doc_id"),
        F.col("at.line_no").alias("line_no"),
        F.col("rep.id").alias("rep_doc_id"),
        F.col("rep.line_no").alias("rep_line_no"),
        "class_size",
        "kept",
    )
