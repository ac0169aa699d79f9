"""Each operator on awkward rows, on an empty table, with clashing columns, and against brute force on real ones."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import SF
from llm.conftest import BASE, ROWS
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from compare import same
from tidemark.llm import bpe, exact_dedup, html, language, licenses, line_dedup, near_dedup, packing, quality, toxicity
from tidemark.llm.common import crc_remainder, scratch_path
from tidemark.llm.graph import components

RANKS = public_tokenizers.path(bpe.DEFAULT_RANKS)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(real):
    return {r.doc_id: r.text for r in real.select("doc_id", "text").collect()}


# --- components ------------------------------------------------------------------------------------------------------


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    out = components(spark.createDataFrame(path + star + [(200, 200)], "a long, b long")).collect()
    assert {r.node: r.root for r in out} == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- 2: byte-level BPE -----------------------------------------------------------------------------------------------


def test_bpe_equals_the_public_encoder():
    c = bpe.Codec(RANKS)
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    rng = random.Random(0)
    odd = ["", "a" * 3001, "aab" * 777, " \n\n\t x" * 40, "日本語" * 99, "<|endoftext|> it's", "".join(chr(rng.randint(1, 0x2FFF)) for _ in range(4000))]
    for t in odd:
        assert c.encode(t) == e.encode_ordinary(t)
        assert c.decode(c.encode(t)) == t.encode()


def test_rank_queue_pops_ranks_in_order_leftmost_first():
    q, rng = bpe.RankQueue(50_000), random.Random(1)
    entries = [(rng.randrange(50_000), i) for i in range(500)] + [(7, 9), (7, 3)]
    q.push(entries)
    assert [q.pop() for _ in entries] == sorted(entries) and q.pop() is None


def test_bpe_rows(docs, clashing, empty):
    out = bpe.round_trip_digests(clashing, RANKS).collect()
    assert len(out) == len(ROWS)
    for r in out:
        if r.doc_id in (3, 4):
            assert r.n_tokens == 0 and r.ids_sha256 == hashlib.sha256(b"").hexdigest() == r.decoded_sha256
    assert bpe.round_trip_digests(empty, RANKS).count() == 0
    back = {bytes(r.decoded).decode() for r in bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()}
    assert back == {r[1] or "" for r in ROWS}


# --- 4: packing ------------------------------------------------------------------------------------------------------


def _check_packed(out, rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    tokenizer.encode_special_tokens = True
    want, got = Counter(), Counter()
    for k, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for at in range(0, len(ids), 2048):
            piece = ids[at : at + 2048]
            want[(k, at, len(piece), zlib.crc32(piece.tobytes()), len(ids))] += 1
    by_sequence = defaultdict(list)
    for r in out:
        got[(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)] += 1
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    return sum(n for _, held in by_sequence.items() for _, n in held) / (2048 * len(by_sequence))


def test_packing(spark, clashing, empty, real, texts):
    args = public_tokenizers.path(packing.TOKENIZER), public_tokenizers.path(packing.RANKS)
    _check_packed(packing.pack(clashing, *args).collect(), [(r[0], r[1]) for r in ROWS])
    assert packing.pack(empty, *args).count() == 0
    assert _check_packed(packing.pack(real, *args).collect(), texts.items()) > 0.97


def test_packing_plan_places_every_piece_close_to_the_bound():
    rng = np.random.default_rng(0)
    histogram = Counter(rng.integers(1, 257, 20_000).tolist())
    plan = packing.sequence_patterns(histogram, 256)
    placed = Counter()
    for pattern, n in plan:
        assert sum(s * k for s, k in pattern.items()) <= 256
        for s, k in pattern.items():
            placed[s] += k * n
    assert placed == histogram
    assert sum(n for _, n in plan) <= 1.02 * sum(s * n for s, n in histogram.items()) / 256
    assert packing.sequence_patterns({}, 256) == []


def test_ids_of_unusual_texts_are_the_tokenizers_own():
    ids = packing.Ids(public_tokenizers.path(packing.TOKENIZER), public_tokenizers.path(packing.RANKS))
    for t in ("x" + " " * 5000 + "y", "Ελληνικά עברית 👩‍👧", "<|endoftext|>"):
        assert ids.packed(t) == np.array(ids.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


# --- 5: licenses -----------------------------------------------------------------------------------------------------


def test_licenses(spark, duck, clashing, empty):
    known = licenses.known_digests(spark)
    rows = [
        (1, "Copyright (c) 2020 Someone\n\nPermission is hereby granted" + licenses._MIT[len("Permission is hereby granted") :].replace("sublicense", "sub-license")),
        (2, "intro\nReleased  under the “MIT” licence!\nLicensed under CC BY-NC 4.0"),
        (3, "This MIT License is not a known text."),
        (4, None),
    ]
    out = {r.doc_id: tuple(r)[1:] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    assert out == {1: ("MIT", 1, True), 2: ("CC-BY-NC-4.0,MIT", 2, False), 3: ("", 0, False), 4: ("", 0, False)}
    assert licenses.scan(clashing, known).count() == len(ROWS) and licenses.scan(empty, known).count() == 0
    same(licenses.query(spark, SF), duck.sql(licenses.ORACLE))


# --- 6: streaming exact dedup ----------------------------------------------------------------------------------------


def _stream(spark, docs, tmp_path, digest=exact_dedup.sha256):
    path = str(tmp_path / "docs")
    docs.write.mode("append").parquet(path)
    stream, table = spark.readStream.schema(docs.schema).parquet(path), spark.read.schema(docs.schema).parquet(path)
    return exact_dedup.deduplicate(stream, table, scratch_path(spark, "state"), digest)


def test_exact_dedup(spark, duck, clashing, empty, tmp_path):
    out = _stream(spark, clashing, tmp_path / "a").collect()
    size = Counter(r[1] or "" for r in ROWS)
    keep = defaultdict(list)
    for r in ROWS:
        keep[r[1] or ""].append(r[0])
    want = Counter()
    for k, t, *_ in ROWS:
        last = max(x for x in keep[t or ""] if x is not None) if any(x is not None for x in keep[t or ""]) else None
        want[(k, last, size[t or ""], k == last, hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, out)) == want
    assert _stream(spark, empty, tmp_path / "b").count() == 0
    same(exact_dedup.query(spark, SF), duck.sql(exact_dedup.ORACLE))


def test_digest_collisions_are_told_apart_by_bytes(spark, docs, tmp_path):
    weak = lambda text: F.unhex(F.hex(F.length(text) % 2))
    strong = sorted(map(repr, _stream(spark, docs, tmp_path / "a").collect()))
    assert sorted(map(repr, _stream(spark, docs, tmp_path / "b", weak).collect())) == strong


def test_state_goes_on_from_its_checkpoint(spark, tmp_path):
    path, state = str(tmp_path / "d"), scratch_path(spark, "state")
    for k in (5, 9):
        spark.createDataFrame([(k, "same")], "doc_id long, text string").write.mode("append").parquet(path)
        exact_dedup.update_state(spark.readStream.schema("doc_id long, text string").parquet(path), state)
    row = exact_dedup.read_state(spark, state).first()
    assert (row.keep_id, row.n) == (9, 2) and "/d/" in row.file


# --- 7: BagMinHash ---------------------------------------------------------------------------------------------------


def _bag(text):
    w = (text or "").lower().split()
    return Counter(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def _jaccard(a, b):
    top = sum((a & b).values())
    return top / max(1, sum(a.values()) + sum(b.values()) - top)


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(0)
    base = np.repeat(rng.integers(0, 1 << 63, 150, dtype=np.uint64), rng.integers(1, 40, 150))
    a, b = (np.sort(rng.choice(base, int(len(base) * f), replace=False)) for f in (0.9, 0.8))
    s = near_dedup.bag_signatures([a, b, a[:0]], 4096)
    want = _jaccard(Counter(a.tolist()), Counter(b.tolist()))
    assert abs((s[0] == s[1]).mean() - want) < 0.03 and np.isinf(s[2]).all()


def test_near_dedup_classes_equal_brute_force(spark, real, texts):
    rng, rows = random.Random(2), dict(texts)
    for i, k in enumerate(list(texts)[:40]):  # more near copies, some of them at the threshold
        w = (texts[k] or "").split()
        for _ in range(1 + i % 4):
            if w:
                w[rng.randrange(len(w))] = f"new{i}"
        rows[10_000 + i] = " ".join(w)
    parent = {k: k for k in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = {k: _bag(t) for k, t in rows.items()}
    where = defaultdict(list)
    for k, b in bags.items():
        for s in b:
            where[s].append(k)
    for a, b in {(a, b) for v in where.values() for i, a in enumerate(v) for b in v[i + 1 :]}:
        if _jaccard(bags[a], bags[b]) >= 0.8:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    first = {}
    for k, t in rows.items():
        x, y = sorted((root(k), root(first.setdefault(t or "", k))))
        parent[y] = x
    out = near_dedup.classes(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in out} == {k: root(k) for k in rows}


def test_near_dedup_rows(clashing, empty):
    out = near_dedup.classes(clashing).collect()
    assert len(out) == len(ROWS)
    assert {r.class_id for r in out if r.doc_id in (1, 2)} == {1}
    assert {r.class_size for r in out if r.doc_id in (3, 4)} == {2}
    assert near_dedup.classes(empty).count() == 0


def test_near_copies_without_an_identifier_are_linked(spark):
    rows = [(None, BASE), (2, BASE.replace("word59", "other")), (3, "quite another text of some more words")]
    out = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id, r.class_size, r.kept) for r in out} == {(None, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)}


# --- 1: lines --------------------------------------------------------------------------------------------------------


def _shingles(line):
    line = line.lower()
    return {line[i : i + line_dedup.SHINGLE] for i in range(len(line) - line_dedup.SHINGLE + 1)}


def test_line_classes_equal_brute_force(spark, texts):
    rows = {k: texts[k] for k in sorted(texts)[:60]}
    rng = random.Random(3)
    for i, k in enumerate(sorted(rows)[:30]):
        rows[5000 + i] = "\n".join(x[: len(x) // 2] + rng.choice(["q", "", "zz"]) + x[len(x) // 2 :] for x in (rows[k] or "").split("\n"))
    places, counts = {}, Counter()
    for k in sorted(rows):
        for i, line in enumerate((rows[k] or "").split("\n")):
            if re.search(r"[^ \t-\r]", line):
                counts[line] += 1
                places.setdefault(line, (k, i))
    names = list(places)
    sets, parent = [_shingles(x) for x in names], list(range(len(names)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(names)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(names)):
        groups[root(i)].append(i)
    want = {names[i]: (min(places[names[j]] for j in g), sum(counts[names[j]] for j in g)) for g in groups.values() for i in g}
    out = line_dedup.judged_lines(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()
    assert len(out) == sum(counts.values())
    for r in out:
        line = rows[r["at"].id].split("\n")[r["at"].line_no]
        assert ((r.rep.id, r.rep.line_no), r.class_size) == want[line]
        assert r.kept == ((r["at"].id, r["at"].line_no) == want[line][0])


def _kept_lines(spark, lines):
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    return {r["at"].line_no for r in line_dedup.judged_lines(docs).filter("kept").collect()}


def test_lines_are_compared_by_five_characters(spark):
    rng = random.Random(5)
    lines = []
    for n, changed in ((56, (28,)), (60, (30,)), (110, (30, 75)), (120, (40, 80))):
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n - 2))
        lines.append(f"<{line}>")
        lines.append("".join("#" if i in changed else c for i, c in enumerate(lines[-1])))
    lines += ["Alpha", "alphA", "Golden", "goLden"]
    assert _kept_lines(spark, lines) == set(range(0, len(lines), 2))


def test_lines_that_repeat_a_phrase_meet_whatever_their_length(spark):
    rng = random.Random(7)
    sentence = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(68))
    lines = ["-" * 50, "-" * 300, "buy now! " * 6, "buy now! " * 30, f"<{sentence}>", f"<{sentence}>" * 2]
    shingles = [{x[i : i + 5] for i in range(len(x) - 4)} for x in lines]
    for a, b in zip(shingles[::2], shingles[1::2], strict=True):
        assert len(a & b) >= 0.8 * len(a | b)
    assert _kept_lines(spark, lines) == {0, 2, 4}
    hashes, counts = line_dedup.shingle_hashes(lines)
    assert line_dedup.distinct_counts(hashes, counts).tolist() == [len(x) for x in shingles]


def test_lines_of_awkward_rows(clashing, empty, docs):
    out = line_dedup.without_repeats(clashing)
    assert out.columns == clashing.columns
    kept = {}
    for r in out.collect():
        kept.setdefault(r.doc_id, []).append(r.text)
    assert kept[3] == [None] and kept[4] == [""] and kept[5] == ["   \n \t"] and kept[1] == [BASE, BASE]
    assert kept[2] == [""] and kept[8] == ["été à l'École"]
    assert line_dedup.without_repeats(empty).count() == 0


# --- 3, 9, 10: learned classifiers -----------------------------------------------------------------------------------

SF_L = SF.replace("sf0.001", "sf0.01")


def test_toxicity_held_out(spark, clashing, empty):
    out = toxicity.query(spark, SF_L).toPandas()
    labels = spark.read.parquet(f"{SF_L}/labels.parquet").toPandas()
    held = out[out.held_out].merge(labels, on="doc_id")
    assert len(held) > 50 and (held.predicted == held.toxic).mean() > 0.8
    assert (out.held_out == [zlib.crc32(str(k).encode()) % 4 == 2 for k in out.doc_id]).all()
    assert ((out.score >= 0.3) == (out.predicted == 1)).all() and out.score.between(0, 1).all()
    docs, marks = spark.read.parquet(f"{SF_L}/documents.parquet"), spark.read.parquet(f"{SF_L}/labels.parquet")
    model = toxicity.fit(docs, marks)
    assert toxicity.score(clashing, model).count() == len(ROWS) and toxicity.score(empty, model).count() == 0
    none = toxicity.fit(docs, marks.limit(0))
    assert toxicity.score(clashing, none).agg(F.max("score")).first()[0] < 0.01


def test_language_held_out(spark, clashing, empty):
    out = language.query(spark, SF_L).toPandas()
    docs = spark.read.parquet(f"{SF_L}/documents.parquet").select("doc_id", "lang").toPandas()
    held = out[out.held_out].merge(docs, on="doc_id")
    assert (held.lang == held.lang_pred).mean() > 0.97
    model = language.fit(spark.read.parquet(f"{SF_L}/documents.parquet"), public_tokenizers.path(language.VOCABULARY))
    rows = language.predict(clashing, model).collect()
    assert len(rows) == len(ROWS) and {(r.lang_pred, r.score) for r in rows if r.doc_id in (3, 4, 5)} == {("und", 0.0)}
    assert language.predict(empty, model).count() == 0
    nothing = language.fit(empty, public_tokenizers.path(language.VOCABULARY))
    assert {r.lang_pred for r in language.predict(clashing, nothing).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    vocabulary = {p: i for i, p in enumerate(["a", "b", "ab", "ba", "aba"])} | {f"<0x{i:02X}>": 5 + i for i in range(256)}
    lattice = language.Lattice(vocabulary)
    p = np.full((261, 1), 0.0)
    p[:5, 0] = [0.1, 0.2, 0.3, 0.4, 0.5]

    def brute(w):
        return 1.0 if not w else sum(p[vocabulary[w[:k]], 0] * brute(w[k:]) for k in range(1, len(w) + 1) if w[:k] in vocabulary)

    words = ["a", "abab", "babaab"]
    alpha = np.exp(language.forward(3, 6, lattice.edges(words), p))
    assert np.allclose([alpha[i, len(w), 0] for i, w in enumerate(words)], [brute(w) for w in words])


def test_quality_counts_and_verdicts(spark, clashing, empty, real, texts):
    docs, labels = spark.read.parquet(f"{SF_L}/documents.parquet"), spark.read.parquet(f"{SF_L}/labels.parquet")
    rules = quality.fit(docs, labels)
    for r in quality.judge(real, rules).collect():
        t = texts[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        n = Counter(zip(w, w[1:], w[2:], strict=False))
        inside = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        counts = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w)) and not (r.base_failed and r.kept)
    out = quality.judge(docs, rules).toPandas().merge(labels.toPandas(), on="doc_id")
    passed = out[~out.base_failed]
    assert passed[passed.quality == 1].kept.mean() > 0.99 and passed[passed.quality == 0].kept.mean() < 0.5
    assert quality.judge(clashing, rules).count() == len(ROWS) and quality.judge(empty, rules).count() == 0
    assert quality.judge(docs, quality.fit(docs, labels.limit(0))).filter("not kept and not base_failed").count() == 0


# --- 8: html ---------------------------------------------------------------------------------------------------------


def test_blocks():
    page = "<p>a <b>b</b>&amp;\n c<br>d<p>e<script>x='</p>'</script><ul><li>f<li><a href=#>g</a></ul><!-- h --><p title=\"a>b\">i"
    found = html.blocks(page)
    assert [b.text for b in found] == ["a b& c d", "e", "f", "g", "i"] and found[3].linked == 1
    assert html.blocks(None) == [] and html.blocks("<p> &nbsp; </p>") == []


def test_silent_elements_hide_no_more_than_their_own():
    texts = lambda page: [b.text for b in html.blocks(page)]
    article = "<article><p>one</p><p>two</p></article>"
    assert texts(f"<header><button>Menu</header>{article}") == ["one", "two"]
    assert texts(f"<header><button>Menu</header>{article}<form><button>Send</button></form>") == ["one", "two"]
    assert texts(f"<div><button>Menu{article}<form><button>Send</button>name</form></div>") == ["one", "two", "name"]
    for name in ("button", "select", "datalist"):
        assert texts(f"<div><{name}><i>x</i></div>{article}") == ["one", "two"], name
        assert texts(f"<body><{name}>x{article}tail") == ["one", "two", "tail"], name
        assert texts(f"<{name}>x<p>y</p>z</{name}>{article}") == ["one", "two"], name
    for name in ("svg", "math", "object", "canvas", "video", "audio", "noscript", "template", "iframe", "map", "output"):
        assert "".join(texts(f"<p>Let <{name}>x</{name}> be.</p>{article}")).replace(" ", "") == "Letxbe.onetwo", name
    assert texts("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p>") == ["Let x=1 be."]
    assert texts("<p>a<object data=x><b>b</b></object>c</p>") == ["abc"]
    assert texts("<title>x<p>y</title><p>one<textarea>z<p></textarea>") == ["one"]


def test_paths_are_read_whole():
    block = html.blocks('<div class="d-none d-md-block col-md-4 col-lg-3 sidebar"><p>links')[0]
    assert html.declared(block) is False
    deep = html.blocks("<div>" * 10 + '<div class="sidebar">' + "<div>" * 30 + "<p>links")[0]
    assert html.declared(deep) is False
    assert len(html.blocks("".join(f'<div class="c{i}">a' for i in range(20_000)))) == 20_000


def test_html_extraction(spark, empty):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    net = html.fit(pages)
    out = {r.page_id: r.text for r in html.extract(pages, net).collect()}
    wrong = 0
    for r in pages.collect():
        article = r.html[r.html.index("<article>") : r.html.index("</article>")]
        parts = (" ".join(html.entities.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split("</?(?:p|h1)>", article))
        wrong += out[r.page_id] != "\n".join(p for p in parts if p)
    assert wrong <= 1
    held = html.training_pages([], 150, seed=77)
    errors = sum(((net.forward(x[None], np.array([len(x)]))[0][0] > 0.5) != y).sum() for x, y in held)
    assert errors < 0.04 * sum(len(y) for _, y in held)
    odd = spark.createDataFrame([(1, "u", None, 0), (2, None, "", 0), (3, "v", "<nav><a>menu</a></nav>", 0)], "page_id long, url string, html string, text int")
    assert [(r.page_id, r.text, r.n_chars) for r in html.extract(odd, net).orderBy("page_id").collect()] == [(1, "", 0), (2, "", 0), (3, "", 0)]
    assert html.extract(odd.limit(0), net).count() == 0


def test_crc_rule(spark):
    got = [r[0] for r in spark.range(50).select(crc_remainder(F.col("id"), 3)).collect()]
    assert got == [zlib.crc32(str(k).encode()) % 3 for k in range(50)]


def test_duckdb_oracle_of_every_query_that_has_one():
    from tidemark.llm import queries

    assert set(queries.oracle_sql()) <= set(queries.queries()) and duckdb is not None
