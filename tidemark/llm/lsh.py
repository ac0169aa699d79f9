"""Linking of similar items from banded signatures: candidates, exact verification, components.

Items are distinct texts, each with a 64-bit node and a 128-bit digest (the node may, at very large scale, stand for two
texts; links are between digests).

Rows (band, node, sketch) are dealt out by band in blocks: a task sorts what it has, cuts it where the part of the band
space changes, and hands on each cut as one binary value, so that the exchange moves some hundred thousand blocks and not
some hundred million rows. A task that reads a part finds each bucket (the items that share a band) in one run. There are
several parts to a partition, so that what is held at a time is a fraction of a partition. A bucket of a few items gives
all its pairs. A larger one is crowded, and gives pairs with its most central item, the one that stands in most crowded
buckets: its candidates are linear in its size. A band that many items of one task share does not meet in one part at all:
what is over a few of them goes to the crowded members directly.

A sketch is a bit of each of SKETCH_BITS registers; pairs whose sketches differ in more than APART bits are no candidates.
Two registers differ in that bit with half the probability that they differ at all, so a pair of similarity 0.8 is lost so
with a probability of some 1 in 10,000, while pairs that share a band by chance, whose number grows with the square of the
input, nearly all go. Items without a sketch (0) are all near.

What the central item may miss is a link between two items neither of which is similar to it. So crowded buckets that
still hold items of several components are taken up again, exactly. Pairs inside a component are never needed, so of a pair
one item at least is a stray, outside the component that most items of its bucket belong to: strays are compared with all
items of their bucket, by their lengths, sketches and parities, which bound from below in how many elements two items
differ. A row is an item in a bucket, however long the item. Items of which a pair leaves room for the threshold are then
brought to their bucket whole, and compared there, the closest first. Only pairs that bring two components together leave
the task, fewer than the bucket has items: pairs of a bucket, whose number grows with the square of its size, are never rows.

Scanning a bucket takes its strays times its items, so one of more than SCANNED items is not scanned. Its items' elements are
put in order of rarity: two items that are similar enough share one of their rarest elements (the prefix of a length that
the threshold fixes, shorter for the smaller item), and pairs of different components that meet there, with the same room
for the threshold, are verified. The order of rarity comes from a histogram of hashed elements, whose size is fixed; any
order gives the same links, a good one fewer pairs.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import freed, parallelism, written
from tidemark.llm.graph import components

#: Given a table of (node), the (node, digest, item) of those nodes, item being what is compared.
Fetch = Callable[[DataFrame], DataFrame]
#: Whether two items are similar, as a boolean column of their columns.
Similar = Callable[[Column, Column], Column]
#: The sorted distinct elements (64-bit hashes) of each item of a column.
Elements = Callable[[pa.Array], list[np.ndarray]]
#: The same as Similar within a task, for pairs of the bytes of items: their text in UTF-8, or their sorted distinct keys.
Told = Callable[[list[bytes], list[bytes]], np.ndarray]

#: Items of a bucket that gives all its pairs, at most; of one whose strays are compared with all its items; pairs that are
#: compared together. Elements are counted in 2 ** SLOT_BITS slots.
FEW, SCANNED, COMPARED, SLOT_BITS = 40, 1 << 16, 1 << 18, 20
#: Parts that the counts of slots are dealt out by.
SLOT_PARTS = 64
SKETCH_BITS, APART = 48, 15
#: An item's parities: 2 ** PARITY_BITS bits, in words, or 2 ** FINE_BITS where items are whole; what spreads elements over them.
PARITY_BITS, FINE_BITS, _SPREAD = 9, 12, np.uint64(0x9E3779B97F4A7C15)
WORDS = [f"w{i}" for i in range((1 << PARITY_BITS) // 64)]
#: Bytes of items that are read and compared at a time (a longer pair comes whole).
READ_BYTES = 8 << 20
#: The bit of a sketch that marks a row whose bucket is crowded for sure.
OVER = 1 << 62
BLOCKS = "part int, block binary"
#: Parts of the band space for each partition of a shuffle; rows of a part in a block, about; rows that a task gathers.
PARTS, BLOCK_ROWS, GATHERED = 8, 64, 1 << 20


class Dealer:
    """Gathers rows (band, node, sketch) and hands them on in blocks, one for each part of the band space."""

    def __init__(self, parts: int) -> None:
        self.parts, self.rows, self.n = parts, [], 0

    def add(self, nodes: np.ndarray, bands: np.ndarray, sketches: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """Rows of nodes, their [node, band] hashes and their sketches."""
        rows = np.zeros((bands.size, 3), dtype=np.int64)
        rows[:, 0], rows[:, 1] = bands.reshape(-1), np.repeat(nodes, bands.shape[1])
        if sketches is not None:
            rows[:, 2] = np.repeat(sketches, bands.shape[1])
        self.rows.append(rows)
        self.n += len(rows)
        if self.n >= min(GATHERED, BLOCK_ROWS * self.parts):
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        rows = np.concatenate(self.rows)
        self.rows, self.n = [], 0
        rows = rows[np.argsort(rows[:, 0].view(np.uint64))]
        over = self._over(rows)
        if over.any():  # a row that is here twice must not make a bucket look crowded
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0].view(np.uint64)))]
            rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))]
            over = self._over(rows)
        yield self._blocks(rows[~over], 0)
        if over.any():  # those of a crowded bucket go anywhere
            rows = rows[over]
            rows[:, 2] |= OVER
            yield self._blocks(rows[np.argsort(rows[:, 1].view(np.uint64))], 1)

    @staticmethod
    def _over(rows: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
        return np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows)))) > FEW

    def _blocks(self, rows: np.ndarray, by: int) -> pa.RecordBatch:
        part = ((rows[:, by].view(np.uint64) >> np.uint64(32)) * np.uint64(self.parts) >> np.uint64(32)).astype(np.int32)
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        ends = (np.append(starts, len(rows)) * rows.strides[0]).astype(np.int32)
        block = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])
        return pa.RecordBatch.from_arrays([pa.array(part[starts]), block], ["part", "block"])


def n_parts(df: DataFrame) -> int:
    return PARTS * parallelism(df.sparkSession)


def sketches(signature: np.ndarray, kind: int = 0) -> np.ndarray:
    """The lowest bits of the first registers of [node, register]; above them, the kind (0 or 1) of the signature."""
    bits = (signature[:, :SKETCH_BITS] & 1).astype(np.int64)
    return bits @ (np.int64(1) << np.arange(bits.shape[1], dtype=np.int64)) | np.int64(kind << SKETCH_BITS)


def spread(banded: DataFrame) -> DataFrame:
    """Blocks of rows of (node, bands array<long>)."""
    parts = n_parts(banded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(parts)
        for b in batches:
            bands = b.column(1)
            counts = np.diff(np.asarray(bands.offsets))
            held = counts > 0
            if held.any():
                yield from dealer.add(b.column(0).to_numpy()[held], bands.flatten().to_numpy().reshape(-1, int(counts[held][0])))
        yield from dealer.flush()

    return banded.select("node", "bands").mapInArrow(run, BLOCKS)


def of_part(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """From all rows (band, node, sketch) of a part: (crowded, x, y, sketch), a pair of nodes, or a band and its member."""

    def batch(crowded: bool, x: np.ndarray, y: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(np.full(len(x), crowded)), pa.array(x), pa.array(y), pa.array(sketch)]
        return pa.RecordBatch.from_arrays(columns, ["crowded", "x", "y", "sketch"])

    over = rows[:, 2] & OVER != 0
    if over.any():
        yield batch(True, rows[over, 0], rows[over, 1], rows[over, 2] ^ OVER)
        rows = rows[~over]
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    band, node, sketch = rows.T.copy()
    fresh = np.ones(len(rows), dtype=bool)
    fresh[1:] = (band[1:] != band[:-1]) | (node[1:] != node[:-1])
    band, node, sketch = band[fresh], node[fresh], sketch[fresh]
    starts = np.flatnonzero(np.append(True, band[1:] != band[:-1])[: len(band)])
    sizes = np.diff(np.append(starts, len(band)))
    x, y = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for n in np.unique(sizes[(sizes > 1) & (sizes <= FEW)]).tolist():
        at = starts[sizes == n][:, None] + np.arange(n)
        left, right = (at[:, side].reshape(-1) for side in np.triu_indices(n, 1))
        near = np.bitwise_count(sketch[left] ^ sketch[right]) <= APART
        x.append(node[left[near]])
        y.append(node[right[near]])
    x, y = np.concatenate(x), np.concatenate(y)
    yield batch(False, x, y, np.zeros(len(x), dtype=np.int64))
    many = np.repeat(sizes > FEW, sizes)
    if many.any():
        yield batch(True, band[many], node[many], sketch[many])


def _of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same from blocks in order of their parts."""
    part, held = None, []
    for b in batches:
        for now, block in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if now != part and held:
                yield from of_part(np.concatenate(held))
                held = []
            part = now
            held.append(np.frombuffer(block.as_buffer(), dtype=np.int64).reshape(-1, 3))
    if held:
        yield from of_part(np.concatenate(held))


def met(blocks: DataFrame) -> DataFrame:
    """(crowded, x, y, sketch): pairs of nodes of the buckets of a few, and (band, node) of the crowded ones, from blocks."""
    dealt = blocks.repartition(parallelism(blocks.sparkSession), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(_of_parts, "crowded boolean, x long, y long, sketch long")


def crowds(found: DataFrame) -> DataFrame:
    """(node, bands, sketch) of the nodes of crowded buckets, a row each; a node has some tens of bands at most."""
    return found.filter("crowded").groupBy(F.col("y").alias("node")).agg(F.collect_set("x").alias("bands"), F.min("sketch").alias("sketch"))


def central_pairs(members: DataFrame) -> DataFrame:
    """(x, y), x < y: each node of the crowded (node, bands) with the most central node of each of its bands."""
    of_band = members.select(F.explode("bands").alias("band"), "node", F.size("bands").alias("score"))
    hubs = of_band.groupBy("band").agg(F.max(F.struct("score", "node")).alias("hub"))
    hub = F.col("hub.node")
    return of_band.join(hubs, "band").filter(hub != F.col("node")).select(F.least(hub, "node").alias("x"), F.greatest(hub, "node").alias("y"))


def overlap(threshold: float) -> Similar:
    """Jaccard similarity of arrays of distinct keys reaches the threshold."""

    def test(left: Column, right: Column) -> Column:
        both = F.size(F.array_intersect(left, right))
        return both >= F.lit(threshold) * (F.size(left) + F.size(right) - both)

    return test


def verified(pairs: DataFrame, items: DataFrame, alike: Similar) -> DataFrame:
    """Links (a, b) of digests among pairs (x, y) of nodes whose items are similar."""
    left = items.select(F.col("node").alias("x"), F.col("digest").alias("a"), F.col("item").alias("left_item"))
    right = items.select(F.col("node").alias("y"), F.col("digest").alias("b"), F.col("item").alias("right_item"))
    return pairs.join(right, "y").join(left, "x").withColumn("alike", alike(F.col("left_item"), F.col("right_item"))).filter("alike").select("a", "b")


def histogram(items: DataFrame, elements: Elements) -> np.ndarray:
    """How often elements of each slot occur, in an array of fixed size. Counts travel as blocks, one for each part of the
    slots that a task has met; a part's blocks are summed one by one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        for b in batches:
            for e in elements(b.column(0)):
                np.add.at(counts, (e >> np.uint64(64 - SLOT_BITS)).astype(np.int64), 1)
        for part, own in enumerate(counts.reshape(SLOT_PARTS, -1)):
            at = np.flatnonzero(own)
            if len(at):
                yield _counted(part, np.stack([at, own[at]]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, block in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                at, n = np.frombuffer(block.as_buffer(), dtype=np.int64).reshape(2, -1)
                sums.setdefault(part, np.zeros((1 << SLOT_BITS) // SLOT_PARTS, dtype=np.int64))[at] += n
        for part, own in sums.items():
            at = np.flatnonzero(own)
            yield _counted(part, np.stack([at, own[at]]))

    blocks = items.select("item").mapInArrow(count, BLOCKS)
    found = blocks.repartition(min(SLOT_PARTS, parallelism(items.sparkSession)), "part").mapInArrow(add, BLOCKS).toArrow()
    out = np.zeros((SLOT_PARTS, (1 << SLOT_BITS) // SLOT_PARTS), dtype=np.float32)
    for part, block in zip(found.column("part").to_pylist(), found.column("block"), strict=True):
        at, n = np.frombuffer(block.as_buffer(), dtype=np.int64).reshape(2, -1)
        out[part, at] = n
    return out.reshape(-1)


def _counted(part: int, slots_and_counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([slots_and_counts.tobytes()], pa.binary())], ["part", "block"])


def parities(elements: np.ndarray, bits: int = PARITY_BITS) -> np.ndarray:
    """Whether an odd number of an item's distinct elements falls to each of 2 ** bits bits. Those of two items differ
    in at most as many bits as the items differ in elements, since what they share cancels out."""
    slots = (elements * _SPREAD >> np.uint64(64 - bits)).astype(np.int64)
    return np.packbits((np.bincount(slots, minlength=1 << bits) & 1).astype(np.uint8)).view(np.int64)


def prefixes(items: DataFrame, elements: Elements, threshold: float) -> DataFrame:
    """(key, node, root, sketch, n, at, least, w0, ...): a row for each of the rarest elements of an item (node, root,
    sketch, item), as many as the threshold asks for, but for those that no other item has; with the item's number of
    elements, the element's place among them, whether it is one of the fewer that suffice for the smaller item of a pair,
    and the item's parities. The order is that of slot counts, then of hashes."""
    counts = items.sparkSession.sparkContext.broadcast(histogram(items, elements))
    share = 2 * threshold / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        for b in batches:
            key, place, size, words = [], [], [], []
            for e in elements(b.column(3)):
                seen = often[(e >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
                order = np.lexsort((e, seen))[: len(e) - int(np.ceil(threshold * len(e) - 1e-9)) + 1]
                at = np.flatnonzero(seen[order] > 1)
                key.append(e[order[at]])
                place.append(at)
                size.append(len(e))
                words.append(parities(e))
            repeats = np.array([len(k) for k in key])
            of = np.repeat(np.arange(len(key)), repeats)
            n, at = np.array(size)[of], np.concatenate(place)
            least = at <= n - np.ceil(share * n - 1e-9)
            columns = [
                pa.array(np.concatenate(key).view(np.int64)), *(b.column(i).take(pa.array(of)) for i in range(3)),
                pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(least), *map(pa.array, np.array(words)[of].T.copy()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "node", "root", "sketch", "n", "at", "least", *WORDS])

    made = "key long, node long, root long, sketch long, n int, at int, least boolean, " + ", ".join(f"{w} long" for w in WORDS)
    return items.select("node", "root", "sketch", "item").mapInArrow(run, made)


def across(rare: DataFrame, threshold: float) -> DataFrame:
    """(x, y): pairs of different components that share a rare element and may reach the threshold. x is the smaller item,
    for which its very rarest elements suffice: what it has to share is a share of both sizes."""
    x, y = (rare.select(*[F.col(c).alias(f"{side}_{c}") for c in rare.columns]) for side in "xy")
    apart = F.col("x_sketch").bitwiseXOR(F.col("y_sketch"))
    both = F.col("x_n") + F.col("y_n")
    needed = both * F.lit(threshold / (1 + threshold)) - 1e-6
    differ = reduce(add, (F.bit_count(F.col(f"x_{w}").bitwiseXOR(F.col(f"y_{w}"))) for w in WORDS))
    may = (
        (F.col("x_key") == F.col("y_key"))
        & ((F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_node") < F.col("y_node"))))
        & (F.col("x_root") != F.col("y_root"))
        # At the first element that two items share, all that they share is still to come.
        & (F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at")) >= needed)
        # Sketches of different kinds say nothing.
        & ((F.bit_count(apart) <= APART) | (apart >= 1 << SKETCH_BITS))
        & (differ <= both - 2 * needed)
    )
    return x.filter("x_least").join(y, may).select(F.least("x_node", "y_node").alias("x"), F.greatest("x_node", "y_node").alias("y")).distinct()


def _room(rows: np.ndarray, root: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, room): pairs of the rows (band, node, root, sketch, number of elements, parities...) of a bucket that are of
    different components and may reach the threshold, and in how many more elements they might differ by their parities.
    root is the rows' component; it may be changed between two turns, as components are joined."""
    sketch, n = rows[:, 3:5].T.copy()
    words = rows[:, 5:].view(np.uint64)
    _, at, sizes = np.unique(root, return_inverse=True, return_counts=True)
    stray = at != sizes.argmax()
    turn = np.where(stray, np.arange(len(rows)), len(rows))  # of two strays, the earlier one meets the later one
    strays = np.flatnonzero(stray)
    step = max(1, COMPARED // len(rows))
    for i in range(0, len(strays), step):
        own = strays[i : i + step, None]
        apart = sketch[own] ^ sketch
        # Sketches of different kinds say nothing.
        near = (np.bitwise_count(apart) <= APART) | (apart >= 1 << SKETCH_BITS)
        x, y = np.nonzero(near & (root[own] != root) & (own < turn))
        x = own[x, 0]
        both = n[x] + n[y]
        needed = both * (threshold / (1 + threshold)) - 1e-6
        may = np.minimum(n[x], n[y]) >= needed
        x, y, room = x[may], y[may], (both - 2 * needed)[may]
        for w in words.T:
            room -= np.bitwise_count(w[x] ^ w[y])
        yield x[room >= 0], y[room >= 0], room[room >= 0]


def strays_met(rows: np.ndarray, threshold: float) -> Iterator[np.ndarray]:
    """[pair, 2] nodes of different components that may reach the threshold, from the rows (band, node, root, sketch, number
    of elements, parities...) of a bucket."""
    node = rows[:, 1]
    for x, y, _ in _room(rows, rows[:, 2], threshold):
        yield np.sort(np.stack([node[x], node[y]], axis=1), axis=1)


def as_bytes(column: pa.Array) -> list[bytes]:
    """Items of a column as Told takes them."""
    if pa.types.is_list(column.type):
        return [e.tobytes() for e in as_lists(column)]
    return column.cast(pa.binary()).to_pylist()


def lists_told(threshold: float) -> Told:
    """Whether the Jaccard similarity of sorted distinct keys reaches the threshold."""

    def test(left: list[bytes], right: list[bytes]) -> np.ndarray:
        out = np.zeros(len(left), dtype=bool)
        for i, (a, b) in enumerate(zip(left, right, strict=True)):
            both = np.sort(np.concatenate([np.frombuffer(a, dtype=np.int64), np.frombuffer(b, dtype=np.int64)]), kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            out[i] = shared >= threshold * (len(both) - shared)
        return out

    return test


class Bucket:
    """The rows of a bucket, and the bytes of its items in a file of the task's own, so that memory does not follow them."""

    def __init__(self, file) -> None:
        self.file, self.band, self.rows, self.sizes = file, None, [], []

    def start(self, band: int) -> None:
        self.band, self.rows, self.sizes = band, [], []
        self.file.seek(0)
        self.file.truncate()

    def add(self, rows: np.ndarray, items: list[bytes]) -> None:
        self.rows.append(rows)
        self.sizes += map(len, items)
        self.file.write(b"".join(items))

    def links(self, told: Told, threshold: float) -> Iterator[np.ndarray]:
        """[pair, 2] nodes of similar items that bring together two components each, so fewer than there are components."""
        if len(self.sizes) < 2:
            return
        self.file.flush()
        rows, sizes = np.concatenate(self.rows), np.array(self.sizes)
        starts = np.cumsum(sizes) - sizes
        read = lambda at: [os.pread(self.file.fileno(), sizes[i], starts[i]) for i in at.tolist()]
        root = np.unique(rows[:, 2], return_inverse=True)[1].reshape(-1)
        for x, y, room in _room(rows, root, threshold):
            order = np.argsort(-room, kind="stable")
            x, y, tries, out = x[order], y[order], 1, []
            while len(x):
                # Of each two components the closest pairs that were not compared yet, twice as many at every turn.
                key = np.minimum(root[x], root[y]) * len(rows) + np.maximum(root[x], root[y])
                by = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.append(True, key[by][1:] != key[by][:-1]))
                place = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
                now = np.zeros(len(x), dtype=bool)
                now[by[place < tries]] = True
                for turn in _in_runs(np.flatnonzero(now), sizes[x] + sizes[y]):
                    turn = turn[root[x[turn]] != root[y[turn]]]
                    found = turn[told(read(x[turn]), read(y[turn]))] if len(turn) else turn
                    for i, j in zip(x[found].tolist(), y[found].tolist(), strict=True):
                        if root[i] != root[j]:
                            root[root == root[j]] = root[i]
                            out.append((i, j))
                left = ~now & (root[x] != root[y])
                x, y, tries = x[left], y[left], 2 * tries
            if out:
                yield np.sort(rows[np.array(out), 1], axis=1)


def _in_runs(at: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """at in runs of no more than READ_BYTES of the sizes, about."""
    run = np.cumsum(sizes[at]) // READ_BYTES
    yield from np.split(at, np.flatnonzero(run[1:] != run[:-1]) + 1)


#: What rows of buckets hold.
OPENED = "band long, node long, root long, sketch long, digest binary"


def scanned(opened: DataFrame, items: DataFrame, elements: Elements, threshold: float, told: Told | None = None) -> DataFrame:
    """(x, y): pairs of nodes of similar items that join all components which similar items of any one bucket of the rows
    (band, node, root, sketch, digest) belong to."""
    told = told or lists_told(threshold)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = elements(b.column(2))
            n, marks = pa.array([len(e) for e in found], pa.int64()), pa.array([parities(e).tobytes() for e in found], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n, marks], ["node", "digest", "n", "marks"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of items that any pair of their bucket leaves room for."""
        held = np.zeros((0, 7 + len(WORDS)), dtype=np.int64)

        def kept(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            for bucket in np.split(rows, np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1):
                some = np.zeros(len(bucket), dtype=bool)
                for x, y, _ in _room(bucket[:, :-2], bucket[:, 2], threshold) if len(bucket) else ():
                    some[x] = some[y] = True
                if some.any():
                    digests = pa.array([d.tobytes() for d in bucket[some, -2:]], pa.binary())
                    yield pa.RecordBatch.from_arrays([*map(pa.array, bucket[some, :4].T.copy()), digests], ["band", "node", "root", "sketch", "digest"])

        for b in batches:
            wide = [np.frombuffer(b"".join(b.column(i).to_pylist()), dtype=np.int64).reshape(b.num_rows, -1) for i in (5, 6)]
            held = np.concatenate([held, np.column_stack([*(b.column(i).to_numpy() for i in range(5)), *wide])])
            if len(held):
                whole = np.searchsorted(held[:, 0], held[-1, 0])  # the last bucket may go on
                yield from kept(held[:whole])
                held = held[whole:]
        yield from kept(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[pa.RecordBatch]:
            for pairs in bucket.links(told, threshold):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in pairs.T.copy()], ["x", "y"])

        with tempfile.TemporaryFile() as file:
            bucket = Bucket(file)
            for b in batches:
                band = b.column(0).to_numpy()
                starts = np.flatnonzero(np.append(True, band[1:] != band[:-1])[: len(band)]).tolist()
                for i, j in zip(starts, [*starts[1:], len(band)], strict=True):
                    if band[i] != bucket.band:
                        yield from found()
                        bucket.start(band[i])
                    part = b.slice(i, j - i)
                    own = elements(part.column(4))
                    ids = [part.column(k).to_numpy() for k in range(4)]
                    bucket.add(np.column_stack([*ids, [len(e) for e in own], [parities(e, FINE_BITS) for e in own]]), as_bytes(part.column(4)))
            yield from found()

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(parallelism(items.sparkSession), "band").sortWithinPartitions("band")

    which = ["node", "digest"]
    marked = items.join(opened.select(*which).distinct(), which).select(*which, "item").mapInArrow(mark, "node long, digest binary, n long, marks binary")
    rows = opened.join(marked, which).select("band", "node", "root", "sketch", "n", "marks", "digest")
    some = dealt(rows).mapInArrow(near, OPENED)
    whole = some.join(items, which).select("band", "node", "root", "sketch", "item")
    return dealt(whole).mapInArrow(run, "x long, y long").distinct()


def _open_rows(members: DataFrame, items: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, node, root, sketch, digest, size) of the crowded buckets that hold several components; size is the bucket's."""
    of_node = items.select("node", "digest").join(roots, "digest", "left").select("node", "digest", F.xxhash64(F.coalesce("root", "digest")).alias("root"))
    held = members.join(of_node, "node")
    of_band = held.select(F.explode("bands").alias("band"), "node", "root", "sketch", "digest")
    buckets = of_band.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size"))
    return of_band.join(buckets.filter("low != high").select("band", "size"), "band")


def link(blocks: DataFrame, fetch: Fetch, alike: Similar, elements: Elements, threshold: float, told: Told | None = None) -> DataFrame:
    """(digest, root) for every digest that is linked to another; root is the least digest of its component. blocks
    are a Dealer's; told is alike within a task, by default that of lists of keys."""
    found = written(met(blocks), "met")
    few = found.filter("not crowded").select("x", "y")
    is_crowded = found.filter("crowded").limit(1).count() > 0
    if is_crowded:
        members = written(crowds(found), "members")
        few = few.union(central_pairs(members))
    pairs = written(few.distinct(), "pairs")
    items = written(fetch(pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()), "items")
    links = written(verified(pairs, items, alike), "links")
    roots = _named(components(links))
    if is_crowded:
        roots = written(roots, "roots")
        still = written(_open_rows(members, items, roots), "open")
        largest = still.agg(F.max("size")).first()[0] or 0
        if largest:
            again = scanned(still.filter(F.col("size") <= SCANNED).drop("size"), items, elements, threshold, told)
            rare = None
            if largest > SCANNED:
                nodes = still.filter(F.col("size") > SCANNED).select("node", "root", "sketch").distinct()
                rare = written(prefixes(items.join(nodes, "node"), elements, threshold), "rare")
                again = again.union(across(rare, threshold)).distinct()
            more = written(verified(again, items, alike), "more")
            roots = _merged(roots, more)
            freed(rare)
        freed(still, members)
    freed(found, pairs, items, links)
    return roots


def _named(components: DataFrame) -> DataFrame:
    return components.withColumnRenamed("node", "digest")


def _merged(roots: DataFrame, more: DataFrame) -> DataFrame:
    """roots after more links: components of the components."""
    ends = more.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    alone = ends.join(roots, "digest", "left_anti").select("digest", F.col("digest").alias("root"))
    known = written(roots.unionByName(alone), "known")
    a, b = (known.select(F.col("digest").alias(side), F.col("root").alias(f"root_{side}")) for side in "ab")
    edges = more.join(a, "a").join(b, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    over = components(edges).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return known.join(over, "root", "left").select("digest", F.coalesce("top", "root").alias("root"))


def as_lists(column: pa.Array) -> list[np.ndarray]:
    """Elements of items that are lists of sorted distinct 64-bit keys already."""
    flat, at = column.flatten().to_numpy().view(np.uint64), np.asarray(column.offsets)
    at = at - at[0]
    return [flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def by_text(elements: Callable[[str], np.ndarray]) -> Elements:
    return lambda column: [elements(t) for t in column.to_pylist()]


