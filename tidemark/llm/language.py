"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of one fixed public vocabulary. A text scores, under a language, the
probability of its letters summed over all the ways to cut them into pieces: the forward algorithm over each run's
lattice of pieces, rescaled every SPAN letters, so that a run of any length is summed whole without underflow. The piece
probabilities are fitted by expectation maximisation (forward-backward over the same lattices) on all word counts of a
bounded sample of labelled documents, in one task; scoring covers every whole text.

A run's score does not depend on its neighbours, so each Python worker keeps the scores of recent words, and new words
of a batch go through the forward algorithm together, vectorised over runs of like length and languages.

A word is what stands between white space. Its characters that are neither letters (str.isalpha) nor marks that belong to
a letter (category M) act as breaks between runs, joiners (U+200C, U+200D) are left out, the rest is lower-cased. A letter
outside the vocabulary counts as the pieces of all its UTF-8 bytes.

Defined results: null texts and texts without a letter give 'und' and score 0; ties go to the language whose name sorts
first; repeated rows give repeated rows; an empty table gives an empty table; if there is nothing to learn from, every
text is 'und'; further columns pass through, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import crc_remainder, text_or_empty, with_found

VOCABULARY = "piece_bpe_32k.model"
UNDETERMINED = "und"
#: Letters between two rescalings; no piece is longer.
SPAN = 16
#: Labelled documents to learn from, about, and rounds of expectation maximisation.
FIT_DOCS, FIT_ROUNDS = 2000, 4
#: Positions (of all runs together) that go through the lattices at a time.
CELLS = 150_000
#: Words, and characters in them, whose scores a Python worker keeps within a task (some 60 MB).
CACHE_WORDS, CACHE_CHARS = 250_000, 16_000_000
#: Stands for a byte of a letter that is outside the vocabulary: this code point and the 255 after it are no letters.
BYTE_LETTERS = 0xF0000


def read_vocabulary(path: str) -> dict[str, int]:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {model.id_to_piece(i): i for i in range(model.get_piece_size())}


class Lattice:
    """All ways to cut runs into vocabulary pieces."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        self.ids = {p: i for p, i in vocabulary.items() if len(p) <= SPAN}
        self.letters = {p for p in self.ids if len(p) == 1}
        self.ids |= {chr(BYTE_LETTERS + b): vocabulary[f"<0x{b:02X}>"] for b in range(256)}
        self.size = len(vocabulary)
        # A tree of the pieces' letters: state << 21 | letter, sorted, and the state that follows; 0 is the root.
        prefixes = sorted({p[:k] for p in self.ids for k in range(1, len(p) + 1)})
        state = {"": 0} | {p: i + 1 for i, p in enumerate(prefixes)}
        steps = np.array([state[p[:-1]] << 21 | ord(p[-1]) for p in prefixes], dtype=np.int64)
        order = np.argsort(steps)
        self.steps, self.follows = steps[order], np.arange(1, len(prefixes) + 1)[order]
        self.piece = np.array([-1] + [self.ids.get(p, -1) for p in prefixes], dtype=np.int32)

    def spelled(self, run: str) -> str:
        """The run, with a letter outside the vocabulary as its bytes."""
        if self.letters.issuperset(run):
            return run
        as_bytes = lambda c: "".join(chr(BYTE_LETTERS + b) for b in c.encode("utf-8", "surrogatepass"))
        return "".join(c if c in self.letters else as_bytes(c) for c in run)

    def edges(self, runs: list[str]) -> tuple[np.ndarray, ...]:
        """(run, start, end, piece) of every piece that occurs, sorted by (end, start). All places of all runs go down the
        tree together, a letter at a time, until none has a piece left to reach."""
        lengths = np.array([len(r) for r in runs], dtype=np.int64)
        codes = np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        run = np.repeat(np.arange(len(runs), dtype=np.int32), lengths)
        start = (np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        left = np.repeat(lengths, lengths) - start
        at, state = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int64)
        found: list[tuple[np.ndarray, ...]] = []
        for k in range(SPAN):
            open_ = left[at] > k
            at, state = at[open_], state[open_]
            step = state << 21 | codes[at + k]
            place = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
            hit = self.steps[place] == step
            at, state = at[hit], self.follows[place[hit]]
            if not len(at):
                break
            piece = self.piece[state]
            here = piece >= 0
            whole = at[here]
            found.append((run[whole], start[whole], start[whole] + np.int32(k + 1), piece[here]))
        if not found:
            return tuple(np.zeros(0, dtype=np.int32) for _ in range(4))
        parts = [np.concatenate(x) for x in zip(*found, strict=True)]
        order = np.argsort(parts[2].astype(np.int64) << 32 | parts[1], kind="stable")
        return tuple(x[order] for x in parts)


def _groups(first: np.ndarray, second: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the stretches in which both arrays are constant."""
    if not len(first):
        return []
    cuts = np.flatnonzero((np.diff(first) != 0) | (np.diff(second) != 0)) + 1
    bounds = [0, *cuts.tolist(), len(first)]
    return list(zip(bounds[:-1], bounds[1:], strict=True))


def _block(position: int) -> int:
    """Positions 1 to SPAN are block 1, and so on; 0 is block 0. A piece joins positions of one block or of neighbours."""
    return (position + SPAN - 1) // SPAN


def _rescale(values: np.ndarray, scale: np.ndarray, block: int, before: int) -> np.ndarray:
    """What values of the block before are multiplied by in this one; the scale of this block is set."""
    low, high = max(0, (before - 1) * SPAN + 1), before * SPAN + 1
    most = values[:, low:high].max(axis=1)
    most[most <= 0] = 1.0
    scale[:, block] = scale[:, before] + np.log(most)
    return 1.0 / most


def scaled_forward(n_runs: int, longest: int, edges: tuple[np.ndarray, ...], p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """alpha[run, position, language] and scale[run, block, language]: the logarithm of the first times e to the second is
    the probability of the first letters, summed over their segmentations."""
    of, start, end, piece = edges
    alpha = np.zeros((n_runs, longest + 1, p.shape[1]))
    alpha[:, 0] = 1
    scale = np.zeros((n_runs, _block(longest) + 1, p.shape[1]))
    now, factor = 0, None
    for a, b in _groups(end, start):
        block, from_block = _block(int(end[a])), _block(int(start[a]))
        while now < block:
            now += 1
            factor = _rescale(alpha, scale, now, now - 1)
        w = of[a:b]
        add = alpha[w, start[a]] * p[piece[a:b]]
        alpha[w, end[a]] += add if from_block == block else add * factor[w]
    while now < _block(longest):
        now += 1
        _rescale(alpha, scale, now, now - 1)
    return alpha, scale


def forward(n_runs: int, longest: int, edges: tuple[np.ndarray, ...], p: np.ndarray) -> np.ndarray:
    """log alpha[run, position, language]: the probability of the first letters, summed over their segmentations."""
    alpha, scale = scaled_forward(n_runs, longest, edges, p)
    with np.errstate(divide="ignore"):
        return np.log(alpha) + scale[:, [_block(i) for i in range(longest + 1)]]


def ends(lengths: np.ndarray, alpha: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """log probability [run, language] of whole runs."""
    rows = np.arange(len(lengths))
    with np.errstate(divide="ignore"):
        return np.log(alpha[rows, lengths]) + scale[rows, (lengths + SPAN - 1) // SPAN]


def scaled_backward(lengths: np.ndarray, longest: int, edges: tuple[np.ndarray, ...], p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of the letters after each position."""
    of, start, end, piece = edges
    beta = np.zeros((len(lengths), longest + 1, p.shape[1]))
    beta[np.arange(len(lengths)), lengths] = 1
    now = _block(longest)
    scale = np.zeros((len(lengths), now + 1, p.shape[1]))
    order = np.lexsort((-end, -start))
    of, start, end, piece = of[order], start[order], end[order], piece[order]
    factor = None
    for a, b in _groups(start, end):
        block, from_block = _block(int(start[a])), _block(int(end[a]))
        while now > block:
            now -= 1
            factor = _rescale(beta, scale, now, now + 1)
        w = of[a:b]
        add = beta[w, end[a]] * p[piece[a:b]]
        beta[w, start[a]] += add if from_block == block else add * factor[w]
    return beta, scale


def chunks(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of runs of like length, as many at a time as CELLS positions hold (one, if it is longer)."""
    order, at = np.argsort(lengths, kind="stable"), 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * (int(lengths[order[end]]) + 1) <= CELLS:
            end += 1
        yield order[at:end]
        at = end


def fit_pieces(lattice: Lattice, runs: list[str], counts: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Piece probabilities [piece, language] from counts [run, language]."""
    runs = [lattice.spelled(r) for r in runs]
    lengths = np.array([len(r) for r in runs], dtype=np.int64)
    parts = [(part, lattice.edges([runs[i] for i in part])) for part in chunks(lengths)] if runs else []
    p = np.full((lattice.size, counts.shape[1]), 1.0 / lattice.size)
    for _ in range(rounds):
        seen = np.zeros_like(p)
        for part, edges in parts:
            of, start, end, piece = edges
            n, longest = lengths[part], int(lengths[part].max())
            alpha, up = scaled_forward(len(part), longest, edges, p)
            beta, down = scaled_backward(n, longest, edges, p)
            total = ends(n, alpha, up)
            log = up[of, (start + SPAN - 1) // SPAN] + down[of, (end + SPAN - 1) // SPAN] - total[of]
            held = alpha[of, start] * p[piece] * beta[of, end] * np.exp(np.minimum(log, 700)) * counts[part][of]
            for k in range(p.shape[1]):
                seen[:, k] += np.bincount(piece, held[:, k], minlength=lattice.size)
        p = (seen + 0.02) / (seen.sum(axis=0) + 0.02 * lattice.size)
    return p


_JOINERS = dict.fromkeys((0x200C, 0x200D))
_ASCII = re.compile("[A-Za-z]+").findall


def _is_mark(c: str) -> bool:
    return unicodedata.category(c)[0] == "M"


def runs_of(raw: str) -> list[str]:
    """The lower-case letter runs of a word, each after a word mark."""
    if raw.isalpha():
        return ["▁" + raw.lower()]
    if raw.isascii():
        return ["▁" + run.lower() for run in _ASCII(raw)]
    out = []
    for run in "".join(c if c.isalpha() or _is_mark(c) else " " for c in raw.translate(_JOINERS)).split():
        at = 0
        while at < len(run) and not run[at].isalpha():  # marks without a letter
            at += 1
        if at < len(run):
            out.append("▁" + run[at:].lower())
    return out


@dataclass(frozen=True)
class Model:
    vocabulary: str
    languages: tuple[str, ...]
    prior: np.ndarray
    pieces: np.ndarray

    @property
    def name(self) -> tuple:
        return self.vocabulary, self.languages, float(self.pieces.sum()), float((self.pieces**2).sum())


class Scorer:
    """Scores of words, computed in batches and kept while they are in use."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.lattice = Lattice(read_vocabulary(model.vocabulary))
        self.width = len(model.languages)
        self.clear()

    def clear(self) -> None:
        self.known, self.chars = _Numbers(), 0
        self.scores = np.zeros((1024, self.width + 1), dtype=np.float64)

    def _compute(self, words: list[str], first: int) -> None:
        """Log scores and letter counts of words numbered from first on."""
        need = first + len(words)
        if need > len(self.scores):
            grown = np.zeros((max(need, 2 * len(self.scores)), self.width + 1))
            grown[: len(self.scores)] = self.scores
            self.scores = grown
        runs, of = [], []
        for k, raw in enumerate(words):
            found = runs_of(raw)
            runs += found
            of += [k] * len(found)
        self.chars += sum(map(len, words))
        self.scores[first:need] = 0
        if not runs:
            return
        runs, of = [self.lattice.spelled(r) for r in runs], np.array(of) + first
        lengths = np.array([len(r) for r in runs])
        for part in chunks(lengths):
            n = lengths[part]
            found = scaled_forward(len(part), int(n.max()), self.lattice.edges([runs[i] for i in part]), self.model.pieces)
            np.add.at(self.scores, of[part], np.column_stack([ends(n, *found), n]))

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and posterior probability of each text."""
        if not self.width:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if len(self.known) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.clear()
        known, before = self.known, len(self.known)
        numbers = [np.fromiter(map(known.__getitem__, (t or "").split()), dtype=np.int64) for t in texts]
        if len(known.new):
            self._compute(known.new, before)
            known.new = []
        names, values = [], []
        prior = np.log(np.maximum(self.model.prior, 1e-12))
        for ids in numbers:
            total = self.scores[ids].sum(axis=0) if len(ids) else np.zeros(self.width + 1)
            if not total[-1]:
                names.append(UNDETERMINED)
                values.append(0.0)
                continue
            logs = total[:-1] + prior
            best = int(logs.argmax())
            names.append(self.model.languages[best])
            values.append(float(1 / np.exp(logs - logs[best]).sum()))
        return names, values


class _Numbers(dict):
    """Numbers words as they come up; new ones wait in a list for their scores."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


_SCORERS: dict[tuple, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    if model.name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.name] = Scorer(model)
    return _SCORERS[model.name]


def word_counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    words = docs.select(F.col(lang).alias("lang"), F.explode(F.split(text_or_empty(text), r"\s+")).alias("word"))
    return words.filter(F.col("word") != "").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


def fit(
    labelled: DataFrame, vocabulary: str, fit_docs: int = FIT_DOCS, key: str = "doc_id", lang: str = "lang", text: str = "text"
) -> Model:
    """A model from the rows of labelled that have a language. It learns from a sample of about fit_docs documents
    (chosen by a hash of the key, as many from each language as there are), whatever the size of the table, and from all
    words in them. Two passes over the table: counts of the languages, then the sample's words."""
    spark = labelled.sparkSession
    rows = labelled.filter(F.col(lang).isNotNull()).select(F.col(key).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("body"))
    # A row for each language.
    shares = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = tuple(sorted(shares))
    if not languages:
        return Model(vocabulary, (), np.zeros(0), np.zeros((1, 0)))
    each = max(1, fit_docs // len(languages))
    below = spark.createDataFrame([(x, max(1, int(min(1.0, each / n) * 2**20))) for x, n in shares.items()], "name string, below long")
    dealt = F.pmod(F.xxhash64("id"), F.lit(2**20))
    sample = rows.join(F.broadcast(below), (F.col("lang") == F.col("name")) & (dealt < F.col("below")))
    at = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, np.ndarray] = {}
        for b in batches:
            for name, word, n in zip(b["lang"], b["word"], b["n"], strict=True):
                for r in runs_of(word):
                    if (held := found.get(r)) is None:
                        held = found[r] = np.zeros(len(languages))
                    held[at[name]] += n
        runs = sorted(found)
        counts = np.array([found[r] for r in runs]).reshape(len(runs), len(languages))
        pieces = fit_pieces(Lattice(read_vocabulary(vocabulary)), runs, counts)
        yield pd.DataFrame({"place": range(len(languages)), "pieces": [np.ascontiguousarray(x).tobytes() for x in pieces.T]})

    # One task, since the sample is bounded; what comes back is a number for each piece and language.
    fitted = word_counts(sample, "lang", "body").repartition(1).mapInPandas(run, "place int, pieces binary").collect()
    if fitted:
        pieces = np.column_stack([np.frombuffer(r["pieces"]) for r in sorted(fitted, key=lambda r: r["place"])])
    else:  # no word in the sample
        pieces = fit_pieces(Lattice(read_vocabulary(vocabulary)), [], np.zeros((0, len(languages))))
    total = sum(shares.values())
    return Model(vocabulary, languages, np.array([shares[x] / total for x in languages]), pieces)


def found_languages(docs: DataFrame, model: Model, text: str = "text", name: str = "__found") -> DataFrame:
    """docs with __found (lang_pred, score) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def compute():
        scorer = _scorer(sent.value)

        def of(texts: list[str]) -> tuple[list[str], list[float]]:
            return scorer.score(texts)

        of.done = scorer.clear
        return of

    return with_found(docs, text, "lang_pred string, score double", compute, name)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every whole text."""
    out = found_languages(docs.select(F.col(key), F.col(text)), model, text)
    return out.select(F.col(key), "__found.lang_pred", "__found.score")


def learnable(docs: DataFrame) -> DataFrame:
    """The documents to learn from: crc32 of the identifier modulo 3 is not 1."""
    return docs.filter(crc_remainder(F.col("doc_id"), 3) != 1)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(learnable(docs), public_tokenizers.path(VOCABULARY))
    return predict(docs, model).select(
        "doc_id", (crc_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score"
    )
