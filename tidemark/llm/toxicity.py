"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on toxic text. Every window of a text is compressed
with each; a window that the toxic dictionary makes shorter resembles toxic text. The gains over all windows of a text,
with the number of windows, go through a logistic curve that is calibrated on labelled documents held back from the
dictionaries.

Toxic documents are mostly ordinary text, so the toxic dictionary is trained on their distinctive passages: runs of
character 5-grams found in several toxic documents, in several contexts (a group of near copies has one), and far more
often than in ordinary ones. Its size follows what is found. Its content is put after that of the ordinary dictionary, and
filler of the same length after the ordinary one, so that both compress ordinary text alike and the difference comes from
the toxic passages; the entropy tables that training puts first are left out for the same reason.

Labels, language, source and identifiers are no inputs of a score. The dictionaries and the curve come from a sample of
labelled documents that is bounded in number (FIT_DOCS; of ordinary ones, ORDINARY_DOCS make a dictionary) and read whole,
in one task; scoring reads every whole text.

Defined results: null and empty texts have no window and get the score of a text without any gain; repeated rows give
repeated rows; an empty table gives an empty table; without labelled documents of both kinds, in the part that the
dictionaries come from and in the other, every score is the share of toxic ones among the labelled (0 without any); further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import crc_remainder, with_found

WINDOW, STEP, LEVEL = 64, 32, 7
#: Size of the ordinary dictionary, and the least of the toxic one.
ORDINARY_BYTES, LEAST_TOXIC_BYTES = 16_384, 1_024
#: Labelled documents that are learnt from, about, and how many of the ordinary ones make a dictionary.
FIT_DOCS, ORDINARY_DOCS, SEED = 9_000, 800, 3
#: Least share of toxic documents (and least number) with a distinctive 5-gram, and least log-odds against others.
GRAM, LEAST_SHARE, LEAST_DOCS, LEAST_ODDS = 5, 0.012, 4, 2.0
#: How far a passage reaches beyond a 5-gram to the ends of its word.
REACH, SEGMENT = 12, 16
THRESHOLD = 0.3


def windows(text: str | None) -> list[bytes]:
    """Overlapping windows over the whole text, in lower case."""
    data = (text or "").lower().encode("utf-8", "surrogatepass")
    if len(data) <= WINDOW:
        return [data] if data else []
    return [data[i : i + WINDOW] for i in range(0, len(data) - WINDOW + STEP, STEP)]


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    mean: tuple[float, ...]
    spread: tuple[float, ...]
    weights: tuple[float, ...]


@lru_cache(maxsize=8)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    shape = zstandard.ZstdCompressionParameters.from_level(
        LEVEL,
        source_size=WINDOW,
        dict_size=len(content),
        write_content_size=0,
        write_checksum=0,
        write_dict_id=0,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    dictionary.precompute_compress(compression_params=shape)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=shape)


N_FEATURES = 7


def features(text: str | None, ordinary: bytes, toxic: bytes) -> np.ndarray:
    """What the gains (bytes saved by the toxic dictionary) of a text's windows look like."""
    found = windows(text)
    if not found:
        return np.zeros(N_FEATURES)
    plain, marked = _compressor(ordinary).compress, _compressor(toxic).compress
    gains = np.array([len(plain(w)) - len(marked(w)) for w in found])
    top = np.sort(gains)[::-1][:4]
    n = len(gains)
    return np.array(
        [
            top[0],
            top[min(1, n - 1)],
            top[min(3, n - 1)],
            gains.mean(),
            np.log(n),
            np.count_nonzero(gains >= 3) / n,
            np.log1p(np.count_nonzero(gains >= 6)),
        ]
    )


def _grams(data: bytes) -> np.ndarray:
    """Every 5-gram as a number."""
    raw = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        out |= raw[k : k + n] << np.uint64(8 * k)
    return out


def _contexts(grams: np.ndarray) -> np.ndarray:
    """A hash of what stands before and after every 5-gram."""
    around = np.zeros(len(grams), dtype=np.uint64)
    around[GRAM:] = grams[:-GRAM] * np.uint64(0x9E3779B97F4A7C15)
    around[:-GRAM] += grams[GRAM:] * np.uint64(0xC2B2AE3D27D4EB4F)
    return around ^ (around >> np.uint64(31))


def _distinct_by_gram(grams: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values of other for each different gram."""
    pairs = np.unique(np.rec.fromarrays([grams, other], names="g,o"))
    return np.unique(pairs["g"], return_counts=True)


def distinctive(toxic: list[bytes], ordinary: list[bytes]) -> np.ndarray:
    """Sorted 5-grams that mark toxic documents."""
    by_doc = [_grams(d) for d in toxic]
    if not any(len(g) for g in by_doc):
        return np.zeros(0, dtype=np.uint64)
    grams = np.concatenate(by_doc)
    docs = np.concatenate([np.full(len(g), i, dtype=np.uint64) for i, g in enumerate(by_doc)])
    around = np.concatenate([_contexts(g) if len(g) > GRAM else np.zeros(len(g), np.uint64) for g in by_doc])
    names, in_docs = _distinct_by_gram(grams, docs)
    _, in_contexts = _distinct_by_gram(grams, around)
    n = np.minimum(in_docs, in_contexts)
    enough = n >= max(LEAST_DOCS, LEAST_SHARE * len(toxic))
    names, n = names[enough], n[enough]
    elsewhere = np.zeros(len(names))
    if len(names):
        for d in ordinary:
            g = np.unique(_grams(d))
            at = np.minimum(np.searchsorted(names, g), len(names) - 1)
            elsewhere[at[names[at] == g]] += 1
    odds = np.log(n / len(toxic)) - np.log((elsewhere + 0.5) / max(len(ordinary), 1))
    return names[odds > LEAST_ODDS]


def passages(data: bytes, marks: np.ndarray) -> list[bytes]:
    """The words of a text that hold distinctive 5-grams, neighbours joined."""
    if not len(marks):
        return []
    grams = _grams(data)
    at = np.minimum(np.searchsorted(marks, grams), len(marks) - 1)
    found = np.flatnonzero(marks[at] == grams)
    out: list[list[int]] = []
    for i in found.tolist():
        start = max(data.rfind(b" ", 0, i + 1), i - REACH, 0)
        end = data.find(b" ", i + GRAM - 1, i + GRAM + REACH)
        end = min(i + GRAM + REACH, len(data)) if end < 0 else end + 1
        if out and start <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([start, end])
    return [data[a:b] for a, b in out]


def _content(size: int, samples: list[bytes], segment: int) -> bytes:
    """The content of a dictionary trained on samples: what follows its tables of entropies."""
    trained = zstandard.train_dictionary(size, samples, d=6, k=segment, level=LEVEL).as_bytes()
    return trained[-(size - size // 16 - 192) :]


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionary contents, from texts of which each kind has a window."""
    lower = lambda texts: [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    toxic, ordinary = sorted(set(toxic)), sorted(set(ordinary))
    toxic_data, ordinary_data = lower(toxic), lower(ordinary)
    marks = distinctive(toxic_data, ordinary_data)
    found = [p for d in toxic_data for p in passages(d, marks)]
    if not found:  # too few documents to compare: their whole windows
        found = [w for t in toxic for w in windows(t)]
    chosen = np.random.default_rng(SEED).permutation(len(ordinary))[:ORDINARY_DOCS]
    plain = [w for i in sorted(chosen.tolist()) for w in windows(ordinary[i])]
    joined = [b"".join(found[i : i + 4]) for i in range(0, len(found), 4)]
    joined *= max(1, 2000 // len(joined))
    base = _content(ORDINARY_BYTES, plain * max(1, 3000 // len(plain)), 32)
    often = [p for p, n in Counter(found).items() if n >= LEAST_DOCS]
    mark = _content(max(LEAST_TOXIC_BYTES, 256 + 2 * sum(map(len, often))), joined, SEGMENT)
    filler = (b"".join(plain) * (1 + len(mark) // max(1, sum(map(len, plain)))))[: len(mark)]
    return base + filler, base + mark


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, spread and weights of a logistic regression (Newton steps, slightly damped)."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + 0.05 * w
        bend = (z * (p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(len(w))
        w = w - np.linalg.solve(bend, slope)
    return mean, spread, w


def learned(texts: list[str], toxic: np.ndarray) -> Model:
    """Dictionaries and curve from labelled texts."""
    first = {t: i for i, t in reversed(list(enumerate(texts))) if t}
    texts = sorted(first, key=lambda t: (zlib.crc32(t.encode("utf-8", "surrogatepass")), t))
    y = np.array([toxic[first[t]] for t in texts], dtype=float)
    held = np.arange(len(texts)) % 3 == 0
    if y[held].sum() < 5 or y[~held].sum() < 5:
        held[:] = True
        learn = held
    else:
        learn = ~held
    if any(not part.any() or part.all() for part in (y[learn], y[held])):
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
        flat = (0.0,) * N_FEATURES
        return Model(b"", b"", flat, (1.0,) * N_FEATURES, (*flat, float(np.log(share / (1 - share)))))
    of = lambda kind: [t for t, use, k in zip(texts, learn, y, strict=True) if use and k == kind]
    ordinary, marked = train_dictionaries(of(1), of(0))
    x = np.array([features(t, ordinary, marked) for t, use in zip(texts, held, strict=True) if use])
    mean, spread, weights = fit_curve(x, y[held])
    return Model(ordinary, marked, tuple(mean.tolist()), tuple(spread.tolist()), tuple(weights.tolist()))


def fit(
    docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, key: str = "doc_id", text: str = "text", label: str = "toxic"
) -> Model:
    """Dictionaries and curve from about fit_docs labelled documents, chosen by a hash of the key."""
    marked = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
    below = max(1, int(min(1.0, fit_docs / max(marked.count(), 1)) * 2**20))
    chosen = (
        marked.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(2**20)) < F.lit(below))
        .groupBy(F.col(key).alias("__of"))
        .agg(F.max(label).alias("__toxic"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, toxic = [], []
        for b in batches:
            texts += b["body"].tolist()
            toxic += b["toxic"].tolist()
        m = learned(texts, np.array(toxic))
        yield pd.DataFrame([(m.ordinary, m.toxic, list(m.mean), list(m.spread), list(m.weights))], columns=["o", "t", "m", "s", "w"])

    # The sample is bounded by fit_docs, so its side may be broadcast, and one task learns from it.
    texts = docs.select(F.col(key).alias("__key"), F.col(text).alias("body"))
    rows = texts.join(F.broadcast(chosen), F.col("__key") == F.col("__of")).select("body", F.col("__toxic").alias("toxic"))
    made = "o binary, t binary, m array<double>, s array<double>, w array<double>"
    r = rows.filter("body IS NOT NULL").repartition(1).mapInPandas(run, made).first()
    return Model(bytes(r.o), bytes(r.t), tuple(r.m), tuple(r.s), tuple(r.w)) if r else learned([], np.zeros(0))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every whole text."""

    def compute():
        mean, spread, w = np.array(model.mean), np.array(model.spread), np.array(model.weights)

        def of(texts: list[str]) -> list:
            x = np.zeros((len(texts), N_FEATURES))
            if model.toxic:
                for i, t in enumerate(texts):
                    x[i] = features(t, model.ordinary, model.toxic)
            return [1 / (1 + np.exp(-np.clip(((x - mean) / spread) @ w[:-1] + w[-1], -30, 30)))]

        return of

    return with_found(docs.select(F.col(key), F.col(text)), text, "score double", compute).select(F.col(key), "__found.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = crc_remainder(F.col("doc_id"), 4) == 2
    model = fit(docs, labels.filter(~out))
    return score(docs, model).select(
        "doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )
