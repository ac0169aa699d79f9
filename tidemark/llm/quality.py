"""Quality rules: an isolation forest over rule statistics.

Every document gets the counts that quality rules use. Fixed base rules fail documents that are too short or mostly
repeated. The others are judged by an isolation forest: trees of random splits, grown on statistics of documents that
are labelled good, isolate a document of another kind after few splits. The threshold on the mean path length is
calibrated on labelled rows. Splits reach a margin beyond the range of a node's rows, so that a statistic which hardly
varies among good documents still tells them from others.

Every labelled row is learnt from: scales, the forest and the threshold come from all of them. The good rows are dealt over
the trees by a hash of the key; a tree is grown in one task on the rows dealt to it, a small part of all of them, of which
only statistics are held. Where there are few rows each is dealt to several trees. Scores are rounded to GRADES steps, so
that the threshold is found from the counts of good and other rows at each of them. Every whole text is counted and judged.

Defined results: null text has no words (and so fails the base rules); repeated rows give repeated rows; an empty table
gives an empty table; without any labelled row the forest keeps all that pass the base rules; further columns are
ignored, whatever their names. A document that is labelled more than once counts with its lowest quality.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_ROWS, freed, with_found, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Trees; rows of a tree, at least if there are as many, which also fix its depth; how far splits reach beyond a node's rows,
#: in standard deviations of the labelled rows; seed; steps of a score.
TREES, TREE_ROWS, MARGIN, SEED, GRADES = 120, 256, 1.5, 17, 1 << 18
#: How many junk documents kept weigh as much as one clean document lost, when the threshold is chosen.
CLEAN_WEIGHT = 8.0

_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
#: White space to str.split() that is no separator here.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]").search
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]").findall
#: Numbers of words that fit a key of three; words whose numbers a task keeps from text to text.
_NUMBERED, KEPT_WORDS = 1 << 21, 300_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("word_length", "symbols", "repeats", "upper", "marks")


def words_of(text: str) -> list[str]:
    return _WORDS(text) if _OTHER_SPACE(text) else text.split()


class Counter:
    """Rule statistics of texts; words are numbered so that three neighbours make one 63-bit key."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}

    def repeats(self, words: list[str]) -> int:
        """Words inside three-word windows that occur twice or more."""
        n = len(words)
        if len(self.numbers) + n >= min(_NUMBERED, KEPT_WORDS):
            self.numbers = {}
        numbers = self.numbers
        if n >= _NUMBERED:
            numbers = {}
        give = numbers.setdefault
        ids = np.fromiter((give(w, len(numbers)) for w in words), dtype=np.int64, count=n)
        if n < 3:
            return 0
        if len(numbers) >= _NUMBERED:  # a single text of millions of words: exact, by two rounds of ranks
            pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]
            keys = pairs[:-1] * len(numbers) + ids[2:]
        else:
            keys = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        same = ordered[1:] == ordered[:-1]
        twice = np.zeros(n - 2, dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        inside = np.zeros(n, dtype=bool)
        for k in range(3):
            inside[k : n - 2 + k] |= twice
        return int(inside.sum())

    def count(self, text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
        """COUNTS and FEATURES of a text."""
        text = text or ""
        words = words_of(text)
        n, chars = len(words), sum(map(len, words))
        symbols = sum(map(text.count, SYMBOLS))
        seen: set[str] = set()
        dup = 0
        for line in text.split("\n"):
            if line.strip(" \t\n\x0b\x0c\r"):
                dup += line in seen
                seen.add(line)
        repeat = self.repeats(words)
        least, some = max(n, 1), max(chars, 1)
        features = (
            chars / least,
            symbols / some,
            repeat / least,
            len(_UPPER(text)) / some,
            (text.count("!") + text.count("?")) / least,
        )
        return (n, chars, symbols, dup, repeat), features


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: at a node, rows whose feature is below the cut go left; leaves hold a path length."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    depth: int
    scale: np.ndarray
    expected: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores between 0 and 1: 2 to the minus mean path length over the expected one."""
        z = x / self.scale
        total = np.zeros(len(z))
        rows = np.arange(len(z))
        for t in range(len(self.feature)):
            at = np.zeros(len(z), dtype=np.int64)
            for _ in range(self.depth):
                f = self.feature[t, at]
                at = np.where(f < 0, at, np.where(z[rows, np.maximum(f, 0)] < self.cut[t, at], self.left[t, at], self.right[t, at]))
            total += self.path[t, at]
        return 2.0 ** (-total / len(self.feature) / self.expected)


def expected_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(
    x: np.ndarray, scale: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, margin: float = MARGIN, seed: int = SEED
) -> Forest:
    rng = np.random.default_rng(seed)
    z = x / scale
    rows = min(rows, len(z))
    depth = int(np.ceil(np.log2(max(min(rows, TREE_ROWS), 2)))) + 2
    size = 2 ** (depth + 1)
    feature, cut = np.full((trees, size), -1), np.zeros((trees, size))
    left, right, path = np.zeros((trees, size), int), np.zeros((trees, size), int), np.zeros((trees, size))
    for t in range(trees):
        waiting, used = [(0, z[rng.choice(len(z), rows, replace=False)], 0)], 1
        while waiting:
            node, part, d = waiting.pop()
            if d == depth or len(part) <= 1:
                path[t, node] = d + expected_path(len(part))
                continue
            f = int(rng.integers(z.shape[1]))
            low, high = part[:, f].min() - margin, part[:, f].max() + margin
            feature[t, node], cut[t, node] = f, rng.uniform(low, high)
            below = part[:, f] < cut[t, node]
            left[t, node], right[t, node] = used, used + 1
            waiting += [(used, part[below], d + 1), (used + 1, part[~below], d + 1)]
            used += 2
    return Forest(feature, cut, left, right, path, depth, scale, max(expected_path(rows), 1.0))


@dataclass(frozen=True)
class Rules:
    forest: Forest | None
    threshold: float


def calibrate(scores: np.ndarray, good: np.ndarray, clean_weight: float = CLEAN_WEIGHT) -> float:
    """The score above which documents are dropped: the least weighted number of errors, in the middle of the gap."""
    order = np.argsort(scores)
    return _threshold(scores[order], good[order].astype(np.int64), (~good[order]).astype(np.int64), clean_weight)


def _threshold(s: np.ndarray, good: np.ndarray, others: np.ndarray, clean_weight: float = CLEAN_WEIGHT) -> float:
    """The same from rising scores and how many rows have each."""
    lost = clean_weight * (good.sum() - np.concatenate([[0], np.cumsum(good)]))
    kept = np.concatenate([[0], np.cumsum(others)])
    cost = lost + kept
    best = len(cost) - 1 - int(np.argmin(cost[::-1]))
    if best == len(s):
        return 1.0
    return float(s[0] - 1e-9 if best == 0 else (s[best - 1] + s[best]) / 2)


def graded(scores: np.ndarray) -> np.ndarray:
    return np.round(scores * GRADES) / GRADES


def base_failed(counts: np.ndarray) -> np.ndarray:
    n, repeat = counts[:, 0], counts[:, 4]
    return (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __found (COUNTS, features array<double>) of every whole text."""

    def compute():
        counter = Counter()

        def of(texts: list[str]) -> list:
            found = [counter.count(t) for t in texts]
            return [*zip(*(c for c, _ in found), strict=True), [list(f) for _, f in found]]

        return of

    return with_found(docs, text, f"{', '.join(f'{c} long' for c in COUNTS)}, features array<double>", compute)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Rules:
    """Forest and threshold from all labelled documents."""
    marked = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__of")).agg((F.min(label) == 1).alias("good"))
    marked = written(marked, "marked")
    texts = docs.select(F.col(key).alias("__key"), F.col(text).alias("text"))
    same = F.col("__key") == F.col("__of")
    # Beside many labels all texts are counted where they are read, and only their statistics are shuffled.
    if marked.count() <= BROADCAST_ROWS:
        found = statistics(texts.join(F.broadcast(marked), same)).select("__key", "good", "__found.*")
    else:
        found = statistics(texts).select("__key", "__found.*").join(marked, same)
    passed = (F.col("n_words") >= MIN_WORDS) & (100 * F.col("n_repeat_words") <= MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = written(found.filter(passed).select("__key", "good", "features"), "statistics")
    rules = _learnt(rows)
    freed(marked, rows)
    return rules


def _learnt(rows: DataFrame) -> Rules:
    """Rules from (__key, good, features) of the labelled rows that pass the base rules."""
    spreads = [F.stddev_pop(F.col("features")[i]).alias(f) for i, f in enumerate(FEATURES)]
    n, *scale = rows.agg(F.count_if("good"), *spreads).first()
    if not n:
        return Rules(None, 1.0)
    # Sums of doubles differ in their last digits from run to run; the rules must not.
    scale = np.maximum([float(f"{v:.9g}") for v in scale], 1e-6)
    forest = _grown(rows.filter("good").select("__key", "features"), scale, n)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            grade = np.round(forest.scores(x) * GRADES).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(grade), b.column(0)], ["grade", "good"])

    graded_rows = rows.select("good", "features").mapInArrow(score, "grade long, good boolean")
    counts = graded_rows.groupBy("grade").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("others")).toPandas().sort_values("grade")
    grade, good, others = (counts[c].to_numpy() for c in ("grade", "good", "others"))
    return Rules(forest, _threshold(grade / GRADES, good, others))


def _grown(good: DataFrame, scale: np.ndarray, n: int) -> Forest:
    """The forest of n good rows (__key, features): each goes to one tree at least, and to as many more as fill the trees."""
    more = max(0, int(min(1.0, (TREE_ROWS * TREES / n - 1) / (TREES - 1)) * 2**20))
    home = F.pmod(F.xxhash64("__key"), F.lit(TREES))
    also = lambda t: F.pmod(F.xxhash64("__key", t), F.lit(2**20)) < F.lit(more)
    trees = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(TREES - 1).cast("long")), lambda t: (t == home) | also(t))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        x = np.array(rows["features"].tolist())
        f = grow(x, scale, 1, len(x), seed=SEED + tree)
        arrays = (f.feature[0].astype(float), f.cut[0], f.left[0].astype(float), f.right[0].astype(float), f.path[0])
        return pd.DataFrame({"tree": [tree], "depth": [f.depth], "expected": [f.expected], "nodes": [np.concatenate(arrays)]})

    dealt = good.select(F.explode(trees).alias("tree"), "features")
    grown = dealt.groupBy("tree").applyInPandas(one, "tree long, depth int, expected double, nodes array<double>").toPandas().sort_values("tree")
    size, depth = max(map(len, grown["nodes"])) // 5, int(grown["depth"].max())
    arrays = np.zeros((len(grown), 5, size))
    arrays[:, 0] = -1
    for i, nodes in enumerate(grown["nodes"]):
        own = np.asarray(nodes).reshape(5, -1)
        arrays[i, :, : own.shape[1]] = own
    feature, cut, left, right, path = (arrays[:, k] for k in range(5))
    ints = feature.astype(int), cut.copy(), left.astype(int), right.astype(int), path.copy()
    return Forest(*ints, depth, scale, float(grown["expected"].mean()))


def judged(docs: DataFrame, rules: Rules, text: str = "text", name: str = "__found") -> DataFrame:
    """docs with __found (COUNTS, base_failed, kept, anomaly) of every whole text."""

    def compute():
        counter = Counter()

        def of(texts: list[str]) -> list:
            found = [counter.count(t) for t in texts]
            counts = np.array([c for c, _ in found], dtype=np.int64).reshape(len(texts), len(COUNTS))
            failed, anomaly = base_failed(counts), np.zeros(len(texts))
            if rules.forest is not None and len(texts):
                anomaly = graded(rules.forest.scores(np.array([f for _, f in found])))
            return [*counts.T.copy(), failed, ~failed & (anomaly <= rules.threshold), anomaly]

        return of

    fields = f"{', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, anomaly double"
    return with_found(docs, text, fields, compute, name)


def judge(docs: DataFrame, rules: Rules, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, COUNTS, base_failed, kept, anomaly) of every whole text."""
    return judged(docs.select(F.col(key), F.col(text)), rules, text).select(F.col(key), "__found.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judge(docs, fit(docs, labels))
