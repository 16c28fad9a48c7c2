"""Relative Lempel-Ziv passages, Merkle proofs and lexical search against plain Python and SQL."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from perfloom.llm import lexical, merkle, queries, rlz

WORD = [f"w{i}" for i in range(300)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, spans string, `key` string, part string, place string"


def _rows():
    draw = np.random.default_rng(7)
    own = lambda n: " ".join(draw.choice(WORD, n))
    shared, phrase = own(45), own(21)
    texts = [own(60), own(60), f"{own(30)} {shared} {own(30)}", f"{shared} {own(9)}\n{shared}", f"\t{own(7)}  {shared}", None, "", "   ", "one two", "Äé wé Ünd"]
    texts += [f"{i} {phrase} {i}" for i in range(9)] + [texts[0], texts[0], own(19), own(20), "same " * 70, "x" * 3000]
    rows = [(i, t, ["de", "en", None, ""][i % 4], "ab"[i % 2] if i % 3 else None, None if i % 5 == 0 else i, "r", "s", "k", "p", "q") for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (3, own(40), "en", "a", 0, *"rskpq"), (None, texts[3], None, None, None, *"rskpq"), (None, None, None, None, None, *[None] * 5)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), DOCS)


def _kept(rows, window):
    """Words left of each row, by one pass in order of doc_id; rows alike in doc_id and text are one document."""
    seen, kept = set(), {}
    digest = lambda t: hashlib.sha256((t or "").encode()).digest()
    for doc_id, text in sorted({r[:2] for r in rows}, key=lambda r: (r[0] is None, r[0] or 0, digest(r[1]))):
        words = (text or "").encode().split()
        stays = [True] * len(words)
        for i in range(len(words) - window + 1):
            content = tuple(words[i : i + window])
            if content in seen:
                stays[i : i + window] = [False] * window
            seen.add(content)
        kept[doc_id, text] = " ".join(w.decode() for w, s in zip(words, stays, strict=True) if s)
    return Counter((r[0], r[1], kept[r[:2]]) for r in rows)


@pytest.mark.parametrize(("window", "crowd", "piece"), [(20, 2048, 1 << 20), (20, 3, 1 << 20), (8, 2, 64), (8, 10**9, 64)])
def test_repeated_words(docs, monkeypatch, window, crowd, piece):
    monkeypatch.setattr(rlz, "CROWD", crowd)
    monkeypatch.setattr(rlz, "SLICE", piece)
    found = rlz.repeated_words(docs, window).withColumn("words", rlz.words_of(F.col("row.text")))
    rows = found.select("row.*", F.array_join(rlz.kept_words(F.col("words"), F.col("spans")), " ").alias("kept"), F.col("spans").alias("own")).collect()
    assert Counter((r.doc_id, r.text, r.kept) for r in rows) == _kept(_rows(), window)
    assert all(a.end < b.start for r in rows for a, b in zip(r.own, r.own[1:]))
    assert rlz.repeated_words(docs.limit(0), window).count() == 0


def test_factors_are_the_longest_and_borders_are_checked():
    index = rlz.Reference(3)
    assert index.factors(b"a b c d e") == [] and index.factors(b"a b c d e") == [(0, 5)]
    assert index.factors(b"c d e f") == [(0, 3)] and index.factors(b"x d e f") == [(1, 4)]
    assert index.factors(b"a b c dd") == [(0, 3)]
    assert index.factors(b"b c d e f") == [(0, 4), (2, 5)]  # a window over the border of two sources
    assert index.factors(b"z z z z z") == [(1, 5)]


def test_anchors_agree_wherever_a_window_stands():
    draw = np.random.default_rng(3)
    hashed = draw.integers(0, 50, 400).astype(np.uint64)
    anchors = {}
    for at in (0, 3, 17):
        grams, first, last = rlz.anchored(hashed[at:], 20)
        assert first[0] == 0 and last[-1] == 400 - at - 20 and (first[1:] == last[:-1] + 1).all()
        for g, a, b in zip(grams, first, last, strict=True):
            for s in range(a, b + 1):
                assert anchors.setdefault(s + at, g) == g


def _tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([hashlib.sha256("".join(row[i : i + 2]).encode()).hexdigest() for i in range(0, len(row), 2)])
    return levels


def _proof(levels, place):
    out = []
    for row in levels[:-1]:
        other = place ^ 1
        out.append((0 if other >= len(row) else 1 if place & 1 else 2, row[other] if other < len(row) else "00" * 32))
        place >>= 1
    return out


@pytest.mark.parametrize(("sizes", "sent"), [([1], 1 << 25), ([2, 1, 5], 1 << 25), ([300, 17, 1, 64], 0), ([33], 1 << 25)])
def test_proofs(spark, monkeypatch, sizes, sent):
    monkeypatch.setattr(merkle, "LEVELS", 3)
    monkeypatch.setattr(merkle, "SENT_BYTES", sent)
    groups = [None, "a", "b", "é"][: len(sizes)]
    rows = [(g, i, hashlib.sha256(f"{g} {i}".encode()).hexdigest()) for g, n in zip(groups, sizes, strict=True) for i in range(n)]
    found = {(r.lang, r.doc_id): r for r in merkle.manifest(spark.createDataFrame(rows, "lang string, doc_id long, leaf string").repartition(5), keep=("lang",)).collect()}
    trees = [_tree([x for h, _, x in rows if h == g]) for g in groups]
    top = _tree([t[-1][0] for t in trees])
    assert len(found) == len(rows)
    for g, place, leaf in rows:
        r, tree = found[g, place], trees[groups.index(g)]
        assert (r.leaf, r.subroot, r.root) == (leaf, tree[-1][0], top[-1][0])
        assert merkle.steps(r.proof) == _proof(tree, place) + _proof(top, groups.index(g)) and merkle.folded(leaf, r.proof) == r.root


def test_alike_rows_are_leaves_of_their_own(spark):
    x, y, z = ("ab" * 32, "cd" * 32, "ef" * 32)
    rows = [("a", 1, x)] * 9 + [("a", None, y), (None, None, z)]
    found = merkle.manifest(spark.createDataFrame(rows, "lang string, doc_id long, leaf string")).collect()
    assert Counter((r.doc_id, r.leaf) for r in found) == {(1, x): 9, (None, y): 1, (None, z): 1}
    assert all(merkle.folded(r.leaf, r.proof) == r.root for r in found)


def test_leaf_tells_null_from_empty(spark):
    rows = [(None, None), (1, ""), (1, "é")]
    out = spark.createDataFrame(rows, "a long, b string").select(merkle.leaf_digest([F.col("a"), F.col("b")])).collect()
    assert [r[0] for r in out] == [hashlib.sha256(x.encode()).hexdigest() for x in ("--", "1:10:", "1:12:é")]


def _ranked(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    total = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for item, text in items:
        scores = []
        for d, c in held:
            m = 25 + 75 * sum(c.values()) * len(held) // total
            s = sum(n * math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, n in Counter(terms(text)).items() if t in c)
            if s:
                scores.append((-s, d is None, d or 0))
        out.update((item, i + 1, None if no else d, -s) for i, (s, no, d) in enumerate(sorted(scores)[:k]))
    return out


ITEMS = [(1, "W1 w2, w3! w4 w1"), (2, "unknown"), (3, None), (None, "w5 Äé"), (4, "äé same"), (1, "w7 w8 w9 " * 30), (5, "")]


@pytest.mark.parametrize(("block", "short", "part", "items"), [(2048, 64, 1 << 20, 1 << 22), (4, 1, 64, 1 << 22), (3, 2, 64, 64), (5, 10**9, 64, 1 << 22)])
def test_search(spark, docs, monkeypatch, block, short, part, items):
    for name, value in (("BLOCK", block), ("SHORT", short), ("SLICE", part), ("ITEM_BYTES", items)):
        monkeypatch.setattr(lexical, name, value)
    asked = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, score string")
    for k in (1, 3, 10):
        got = Counter(tuple(r) for r in lexical.search(docs, asked, k).collect())
        assert got == _ranked([r[:2] for r in _rows()], ITEMS, k)
    assert lexical.search(docs.limit(0), asked).count() == 0 and lexical.search(docs, asked.limit(0)).count() == 0
    assert lexical.search(docs, asked.filter("item_id = 2")).count() == 0


def test_skipping_visits_only_what_can_reach_the_floor():
    draw = np.random.default_rng(9)
    for _ in range(200):
        lists = []
        for size in draw.integers(1, 60, 4):
            places = np.sort(draw.choice(64, size, replace=False))
            parts = draw.integers(1, 50, size)
            lists.append((places, parts, int(parts.max()), int(draw.integers(1, 5))))
        whole = np.zeros(64, np.int64)
        for places, parts, _, factor in lists:
            whole[places] += parts * factor
        floor = int(draw.integers(1, 300))
        places, scores = lexical.visited(lists, 64, floor)
        assert list(places) == list(np.flatnonzero(whole >= floor)) and (whole[places] == scores).all()


def test_queries_equal_their_sql(spark, docs, tmp_path):
    """Whole queries on rows with nulls, copies and odd texts; equal ids and null ids aside, whose order SQL leaves open."""
    plain = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([i for i in ITEMS if i[0] in (2, 3, 4, 5)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("op11_relative_lz", "op12_merkle", "op13_lexical"):
        got = queries.QUERIES[name](spark, str(tmp_path))
        columns = sorted(got.columns)
        want = con.execute(f"select {', '.join(columns)} from ({queries.SQL[name]})").fetchall()
        assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(want), name
    altered = {r.doc_id for r in queries.op12_merkle(spark, str(tmp_path)).filter("not verified").collect()}
    assert altered == {r.doc_id for r in plain.collect() if r.n_chars is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0}


def test_slices_cut_between_words(monkeypatch):
    monkeypatch.setattr(rlz, "SLICE", 16)
    monkeypatch.setattr(lexical, "SLICE", 16)
    text = " lead, Some-words and\na_very_long_word_of_more_than_a_slice  x y\t" * 9
    assert [w for part in rlz.slices(text.encode()) for w in part] == text.encode().split()
    assert [t.decode() for part in lexical.term_lists(text) for t in part] == re.findall("[0-9a-z]+", text.lower())


def test_texts_longer_than_a_slice(spark):
    draw = np.random.default_rng(4)
    first = [f"{x:x}" for x in draw.integers(0, 1 << 40, 130_000)]
    second = [f"{x:x}" for x in draw.integers(0, 1 << 40, 40_000)]
    long = [*first, *second, *first[50_000:120_000]]
    assert len(" ".join(first)) > rlz.SLICE
    rows = [(1, " ".join(long)), (2, " ".join(second[3:])), (3, "z " + " ".join(first[:25]))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.row.doc_id: [(s.start, s.end) for s in r.spans] for r in rlz.repeated_words(table).collect()}
    assert found == {1: [(170_000, 240_000)], 2: [(0, 39_997)], 3: [(1, 26)]}
    items = spark.createDataFrame([(1, f"{first[7]} {long[200_000]}"), (2, second[9])], "item_id long, text string")
    got = Counter(tuple(r) for r in lexical.search(table, items, 5).collect())
    assert got == _ranked(rows, [(1, f"{first[7]} {long[200_000]}"), (2, second[9])], 5)
    proven = merkle.manifest(table.select("doc_id", F.lit("x").alias("lang"), merkle.leaf_digest([F.col("text")]).alias("leaf"))).collect()
    assert {r.leaf for r in proven} == {hashlib.sha256(f"{len(t)}:{t}".encode()).hexdigest() for _, t in rows}
