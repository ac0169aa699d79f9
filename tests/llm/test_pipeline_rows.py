"""Every stage of the corpus pipeline against plain Python, and on awkward rows."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import language, packing, quality

SF_L = SF.replace("sf0.001", "sf0.01")
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def source(spark):
    return spark.read.parquet(f"{SF_L}/documents.parquet")


@pytest.fixture(scope="module")
def some(spark, source):
    """Rows of the table, some of them twice, with nulls, an empty and a very long text, and columns of clashing names."""
    few = source.filter("doc_id < 70")
    long = " ".join(r.text for r in source.filter("doc_id BETWEEN 100 AND 400 AND text IS NOT NULL").orderBy("doc_id").collect())
    rows = [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "!!! ??? " * 90, "en", "s", 1), (None, "short one", "en", "s", 1), (903, long, "en", None, 7)]
    docs = few.unionByName(few.filter("doc_id % 7 = 0")).unionByName(spark.createDataFrame(rows, few.schema))
    return docs.withColumns({n: F.lit(n) for n in ("at", "__id", "__of", "__found", "kept", "score", "digest", "node", "n", "body", "id", "line_no")})


def _rows(df):
    return Counter(tuple(r) for r in df.select("doc_id", "text").collect())


def test_language_stage(spark, some, source):
    out = STAGES["language_id"](spark, some, SF_L)
    assert out.columns == some.columns
    model = language.fit(language.learnable(some), public_tokenizers.path(language.VOCABULARY))
    scorer, want = language.Scorer(model), Counter()
    for k, t in ((r.doc_id, r.text) for r in some.collect()):
        name, score = (x[0] for x in scorer.score([t]))
        want[(k, t)] += name != "und" and score >= 0.5
    assert _rows(out) == +want and len(want) > len(+want)


def test_quality_stage(spark, some):
    out = STAGES["quality_rules"](spark, some, SF_L)
    assert out.columns == some.columns
    rules, want = quality.fit(some, spark.read.parquet(f"{SF_L}/labels.parquet")), Counter()
    for k, t in ((r.doc_id, r.text) for r in some.collect()):
        counts, features = quality.Counter().count(t)
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        want[(k, t)] += not failed and rules.forest.scores(np.array([features]))[0] <= rules.threshold
    assert _rows(out) == +want and len(want) > len(+want)


def _classes(names, sets, threshold=0.8):
    """Union of all pairs of multisets that are alike."""
    parent, where = {k: k for k in names}, defaultdict(list)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k in names:
        for e in sets[k]:
            where[e].append(k)
    for a, b in {(a, b) for held in where.values() if len(held) < 400 for i, a in enumerate(held) for b in held[i + 1 :]}:
        if root(a) != root(b) and sum((sets[a] & sets[b]).values()) >= threshold * sum((sets[a] | sets[b]).values()):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {k: root(k) for k in names}


def test_line_stage(spark, some):
    docs = some.filter("doc_id < 30 OR doc_id > 800 OR doc_id IS NULL").filter("doc_id IS NULL OR doc_id <> 903")
    out = STAGES["line_dedup"](spark, docs, SF_L)
    assert out.columns == docs.columns
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("of")).collect()
    places = defaultdict(set)
    for r in rows:
        for i, line in enumerate((r.text or "").split("\n")):
            if re.search(r"[^ \t-\r]", line):
                places[line].add(((r.doc_id is not None, r.doc_id or 0), r.of, i))
    shingles = {x: Counter({x.lower()[i : i + 5] for i in range(len(x) - 4)}) for x in places}
    roots, firsts = _classes(sorted(places), shingles), {}
    for line, at in places.items():
        firsts[roots[line]] = min(min(at), firsts.get(roots[line], min(at)))
    want = Counter()
    for r in rows:
        kept = [x for i, x in enumerate((r.text or "").split("\n")) if not re.search(r"[^ \t-\r]", x) or firsts[roots[x]] == ((r.doc_id is not None, r.doc_id or 0), r.of, i)]
        want[(r.doc_id, None if r.text is None else "\n".join(kept))] += 1
    assert _rows(out) == want
    assert {(r.doc_id, r.n_chars) for r in out.filter("text IS NOT NULL").collect()} == {(k, len(t)) for k, t in want if t is not None}


def test_near_dedup_stage(spark, some):
    out = STAGES["near_dedup"](spark, some, SF_L)
    assert out.columns == some.columns
    rows = some.select("doc_id", "text", F.xxhash64("text").alias("of")).collect()
    bags = {}
    for r in rows:
        w = (r.text or "").lower().split()
        bags[r.text or ""] = Counter(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    roots, best = _classes(sorted(bags), bags), {}
    for r in rows:
        at = ((r.doc_id is not None, r.doc_id or 0), r.of)
        if (c := roots[r.text or ""]) not in best or at < best[c][0]:
            best[c] = (at, r)
    assert _rows(out) == Counter((r.doc_id, r.text) for _, r in best.values()) and len(best) < len(rows)


def test_packing_stage(spark, some):
    out = STAGES["packing"](spark, some, SF_L)
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    tokenizer.encode_special_tokens = True
    want = Counter((r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in some.select("doc_id", "text").collect())
    got, total = Counter(), Counter()
    for r in out.collect():
        total[(r.doc_id, r.doc_tokens)] += r.length
        got[(r.doc_id, r.doc_tokens)] += r.start == 0
    assert got == want and total == Counter({k: k[1] * n for k, n in want.items()})


def test_empty_table(spark, source):
    docs = source.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_L)
        assert out.count() == 0, name
        if name != "packing":
            assert out.columns == docs.columns, name
