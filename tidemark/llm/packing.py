"""Packing of tokenised documents into fixed-length sequences by cutting-stock column generation.

Every document is tokenised and cut into whole sequences and one remainder. The remainders are the items of a cutting
stock problem. Their lengths, rounded up to a multiple of GRAIN, make a histogram of at most sequence_length / GRAIN
counts, the only thing that reaches the driver. A linear program over patterns (how many pieces of each length class
share a sequence) is solved by column generation: a knapsack dynamic program over the duals prices the next column. The
solution is rounded down, what it leaves over (a few pieces for each class) is placed by first fit, and the result is a
plan: for each class, which ranks of its pieces go to which sequences. Pieces are ranked within their class, and the
plan, whose size depends on the number of classes alone, is broadcast to them.

Rounding up leaves a sequence at most GRAIN - 1 unused tokens for each of its pieces, beyond what the pattern itself does
not fill; a smaller grain packs closer and takes longer. Where the program stops before its optimum is proven, which the
number of rounds allows for, a warning says how far from it the packing may be.

Ranks are found in two steps (rank in a salted bucket, plus the bucket's offset), so a class that holds most pieces,
such as that of whole sequences or of a large group of copies, is dealt over all tasks.

Defined results: null text is the empty text, and an empty text is the end token alone; repeated rows are packed each;
ties in length are ranked by identifier and content; an empty table gives an empty table; further columns are ignored,
whatever their names; very long texts are cut into as many sequences as they fill.
"""

from __future__ import annotations

import re
import warnings
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.bpe import Codec, read_ranks
from tidemark.llm.common import parallelism, text_or_empty, written

SEQUENCE_LENGTH, GRAIN, END_ID = 2048, 8, 1
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Characters whose classes are the same in every version of Unicode that a pre-token pattern may be built on.
_UNUSUAL = re.compile("[^\x00-ɏ‐-‧‰-⁞€™]")
#: A run of white space of this length can exhaust the fast pattern matcher.
_LONG_SPACE = re.compile(r"\s{2000}")


class Ids:
    """Ids of a text by the tokenizer file, packed as little-endian unsigned 32-bit integers.

    The same vocabulary as ranks is some four times faster; it is used for texts of ordinary Latin characters, for
    which both give the same ids, and the tokenizer file itself for all others."""

    def __init__(self, tokenizer: str, ranks: str) -> None:
        self.file = tokenizer
        self.fast = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(ranks), special_tokens={}
        )
        self.queue: Codec | None = None
        self.ranks = ranks

    @cached_property
    def tokenizer(self) -> Tokenizer:
        out = Tokenizer.from_file(self.file)
        out.encode_special_tokens = True
        return out

    def packed(self, text: str) -> bytes:
        if _UNUSUAL.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _LONG_SPACE.search(text):
            self.queue = self.queue or Codec(self.ranks)
            return self.queue.encode_packed(text)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


@lru_cache(maxsize=1)
def _ids(tokenizer: str, ranks: str) -> Ids:
    return Ids(tokenizer, ranks)


def pieces(
    docs: DataFrame,
    tokenizer: str,
    ranks: str,
    sequence_length: int = SEQUENCE_LENGTH,
    end_id: int = END_ID,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, ids binary): each document, with its end token, in pieces of
    sequence_length ids and one shorter last piece."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, end, step = _ids(tokenizer, ranks), np.array([end_id], "<u4").tobytes(), 4 * sequence_length
        for b in batches:
            rows = []
            for k, t in zip(b[key], b["__text"], strict=True):
                packed = ids.packed(t) + end
                for at in range(0, len(packed), step):
                    piece = packed[at : at + step]
                    rows.append((k, at // 4, len(piece) // 4, zlib.crc32(piece), len(packed) // 4, piece))
            yield pd.DataFrame(rows, columns=[key, "start", "length", "ids_crc32", "doc_tokens", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key), text_or_empty(text).alias("__text"))
    return source.mapInPandas(run, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits the capacity: value and how many of each size."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    by_size, by_value = sizes[order], values[order]
    for c in range(1, capacity + 1):
        fits = np.searchsorted(by_size, c, "right")
        best[c] = best[c - 1]
        if fits:
            gains = by_value[:fits] + best[c - by_size[:fits]]
            i = int(gains.argmax())
            if gains[i] > best[c] + 1e-12:
                best[c], taken[c] = gains[i], i
    pattern, c = np.zeros(len(sizes), dtype=np.int64), capacity
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            pattern[order[taken[c]]] += 1
            c -= by_size[taken[c]]
    return float(best[capacity]), pattern


def column_generation(
    sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 20_000
) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used in an optimal fractional packing (revised simplex). A stop after the given
    number of rounds leaves a packing that is feasible, and warns: the optimum is at least the total of the uses over the
    value of the best pattern (Farley's bound)."""
    m = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / (capacity // sizes))
    used = inverse @ counts
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        value, pattern = best_pattern(sizes, np.maximum(duals, 0), capacity)
        if value <= 1 + 1e-9:
            break
        step = inverse @ pattern
        rises = step > 1e-11
        ratios = np.where(rises, used / np.where(rises, step, 1), np.inf)
        out = int(ratios.argmin())
        if not np.isfinite(ratios[out]):
            break
        theta = ratios[out]
        used = np.maximum(used - theta * step, 0)
        used[out] = theta
        columns[:, out] = pattern
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    else:
        warnings.warn(f"column generation stopped after {rounds} rounds, at most {value - 1:.3%} above the least number of sequences", stacklevel=2)
    return [(columns[:, i].round().astype(np.int64), float(used[i])) for i in range(m)]


def sequence_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns {class: pieces} and how many sequences follow each, so that all pieces of the histogram are placed."""
    if not histogram:
        return []
    sizes = np.array(sorted(histogram), dtype=np.int64)
    left = np.array([histogram[s] for s in sizes], dtype=np.int64)
    out: list[tuple[dict[int, int], int]] = []
    for pattern, share in sorted(column_generation(sizes, left.astype(float), capacity), key=lambda x: -x[1]):
        held = pattern > 0
        times = int(min(np.floor(share + 1e-9), (left[held] // pattern[held]).min())) if held.any() else 0
        if times > 0:
            left = left - times * pattern
            out.append(({int(s): int(n) for s, n in zip(sizes, pattern, strict=True) if n}, times))
    bins: list[tuple[int, Counter]] = []
    for size, n in sorted(zip(sizes.tolist(), left.tolist(), strict=True), reverse=True):
        for _ in range(n):
            for i, (room, held) in enumerate(bins):
                if room >= size:
                    held[size] += 1
                    bins[i] = (room - size, held)
                    break
            else:
                bins.append((capacity - size, Counter({size: 1})))
    alike = Counter(tuple(sorted(held.items())) for _, held in bins)
    return out + [(dict(pattern), n) for pattern, n in alike.items()]


def _plan_rows(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first rank, end rank, pieces a sequence, first sequence, first slot) for each pattern and class."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for pattern, times in patterns:
        slot = 0
        for size in sorted(pattern, reverse=True):
            n = pattern[size]
            rows.append((size, taken[size], taken[size] + n * times, n, sequence, slot))
            taken[size] += n * times
            slot += n
        sequence += times
    return rows


def ranked(df: DataFrame, group: str, order: list[str], buckets: int) -> DataFrame:
    """df with rank: 0, 1, ... within each group. Rows are ranked in salted buckets, whose offsets are sums of counts,
    so no group is ever in one task."""
    salted = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    offsets = (
        salted.groupBy(group, "__bucket")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn(
            "__offset",
            F.coalesce(
                F.sum("__n").over(Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .drop("__n")
    )
    local = salted.withColumn("__local", F.row_number().over(Window.partitionBy(group, "__bucket").orderBy(*order)) - 1)
    return local.join(offsets, [group, "__bucket"]).withColumn("rank", F.col("__local") + F.col("__offset")).drop(
        "__bucket", "__local", "__offset"
    )


def assign(cut: DataFrame, sequence_length: int = SEQUENCE_LENGTH, grain: int = GRAIN, key: str = "doc_id") -> DataFrame:
    """Pieces (key, start, length, ...) with sequence_id and offset. cut is read several times: pass a written table."""
    spark = cut.sparkSession
    capacity = sequence_length // grain
    classed = cut.withColumn("__class", F.ceil(F.col("length") / F.lit(grain)).cast("int"))
    # At most `capacity` rows.
    histogram = {r[0]: r[1] for r in classed.groupBy("__class").count().collect()}
    plan = spark.createDataFrame(
        _plan_rows(sequence_patterns(histogram, capacity)),
        "__plan_class int, __from long, __to long, __each long, __sequence long, __slot long",
    )
    order = [key, "start", "length", "ids_crc32", "doc_tokens"]
    placed = ranked(classed, "__class", order, 8 * parallelism(spark)).join(
        F.broadcast(plan),
        (F.col("__class") == F.col("__plan_class")) & (F.col("rank") >= F.col("__from")) & (F.col("rank") < F.col("__to")),
    )
    within = F.col("rank") - F.col("__from")
    slots = placed.withColumn("sequence_id", F.col("__sequence") + F.floor(within / F.col("__each"))).withColumn(
        "__at", F.col("__slot") + F.pmod(within, F.col("__each"))
    )
    before = Window.partitionBy("sequence_id").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    return slots.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))).select(
        *cut.columns, "sequence_id", "offset"
    )


def pack(
    docs: DataFrame,
    tokenizer: str,
    ranks: str,
    sequence_length: int = SEQUENCE_LENGTH,
    grain: int = GRAIN,
    end_id: int = END_ID,
    key: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Documents to placed pieces; with_ids keeps each piece's token ids (packed 32-bit integers)."""
    cut = pieces(docs, tokenizer, ranks, sequence_length, end_id, key, text)
    return assign(written(cut if with_ids else cut.drop("ids"), "pieces"), sequence_length, grain, key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS))
