"""The operators against plain Python on small tables with nulls, empty texts, ties and repeated rows."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from perfloom.llm import chat, components, forest, language, minhash, mixing, packing, records, suffixes, topk, warc
from perfloom.llm.queries import BYTES, WORDS, op7_suffixes, vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _spans string"
WORD = [f"w{i}" for i in range(400)]


def _texts():
    draw = np.random.default_rng(3)
    base = [" ".join(draw.choice(WORD, 120)) for _ in range(6)]
    near = [" ".join([*b.split()[:115], "a", "b"]) for b in base[:3]]
    return [*base, *near, base[0], base[1].upper(), None, "", "   ", "one two", "one  two", "one two", "Äé\n\n x\t y", base[2] + " " + base[3]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "de", ["a", "b", None][i % 3], 0, "x") for i, t in enumerate(_texts())]
    rows += [rows[0], (None, "one two three four five six", None, "a", 0, "x"), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def _shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_documents(spark, docs):
    rows = [r for r in docs.collect()]
    sets = [_shingles(r.text) for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min((r.doc_id for r, h in zip(rows, group, strict=True) if h == g and r.doc_id is not None), default=None) for g in group}
    want = Counter((r.doc_id, len(s), least[g], r.doc_id == least[g]) for r, s, g in zip(rows, sets, group, strict=True))
    assert Counter(tuple(r) for r in minhash.near_documents(docs).collect()) == want
    assert minhash.survivors(docs).count() == len(set(group))
    assert minhash.near_documents(docs.limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 1), (7, 7), (8, 9)], "a long, b long")
    assert {tuple(r) for r in components.components(edges).collect()} == {(1, 1), (3, 1), (4, 1), (5, 1), (8, 8), (9, 8)}


def test_language(spark):
    draw = np.random.default_rng(1)
    words = {"aa": ["kol", "mira", "tesk", "dun"], "bb": ["pavo", "lixe", "grum", "osti"]}
    rows = [(i, " ".join(draw.choice(words[k], 30)), k, "mine") for i, k in enumerate(["aa", "bb"] * 40)]
    rows += [(90, None, None, "x"), (91, "12 34 !?", None, "x"), (92, "q", None, "x"), (93, "Mira KOL tesk", None, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    found = {r.doc_id: r for r in language.identified(table, F.col("lang").isNotNull()).collect()}
    assert all(r._language.lang == r.lang for r in found.values() if r.lang)
    assert [found[i]._language.lang for i in (90, 91, 93)] == ["und", "und", "aa"] and found[92]._language.lang in words
    assert found[0].score == "mine" and all(0 <= r._language.score <= 1 for r in found.values())
    assert language.identified(table, F.lit(False)).filter("_language.lang <> 'und'").count() == 0


def test_top_k_and_forest(spark):
    draw = np.random.default_rng(2)
    data = draw.standard_normal((120, 8))
    data[60:80] = data[0] + draw.standard_normal((20, 8)) * 0.05
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)] + [(500, None), (501, [float("nan")] * 8), (502, [0.0] * 8), (503, [None] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = np.floor(64 * np.array([r[1] for r in [*rows[:120], rows[122]]])).astype(int)
    ids = [*range(120), 502]
    want = set()
    for q in range(0, 120, 20):
        best = sorted((-int(s), i) for s, i in zip(whole @ whole[q], ids, strict=True) if i != q)[:7]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in topk.top_k(table, F.col("vec_id") % 20 == 0, 7).collect()} == want
    assert topk.top_k(table.limit(0), F.lit(True), 7).count() == 0
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9).sum(1) - 1
    found = {r.vec_id: r for r in forest.near_vectors(table).collect()}
    assert [found[i].n_links for i in range(120)] == list(links) and len(found) == len(rows)
    assert found[79].component_id == 0 and not found[79].kept and found[502].kept and found[502].n_links == 0


def test_warc(spark):
    page = "<p>" + "x" * 200
    rows = [(3, "http://a b\n", page), (1, None, page), (2, "u", page), (4, "u", None), (5, "u", "é"), (6, "u", "é"), (None, "u", page)]
    found = {r.page_id: r for r in warc.read_archives(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in found.items()} == {1: ("response", None), 2: ("revisit", 1), 3: ("revisit", 1), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("response", None)}
    assert found[2].payload_bytes == len(page) and found[2].payload_digest == hashlib.sha256(page.encode()).hexdigest()
    assert bytes(found[5].payload) == "é".encode() and found[3].url == "http://a%20b%0A"


def test_chat(spark):
    said = ["</s>[INST] ok [/INST]", "a\\<|end|>\\", "<", None, "é<|turn|>"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(said)] + [(None, None, None, None)]
    out = chat.formatted(chat.turn_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    found = {r.conv_id: r for r in out.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()}
    assert [(t.role, t.text) for t in found[1].t] == [(r[2], r[3] or "") for r in rows[:5]] and found[1].l == "a\\<|end|>\\"
    assert [(t.role, t.text) for t in found[None].t] == [("", "")]
    lines = ['{"messages":[{"role":"human","content":"q"},{"role":"gpt","content":"a"}],"id":1}', '{"instruction":"i","input":"x","output":"o"}', '{"prompt":"p","completion":"c"}', '{"z":1}', "no json", None]
    got = [r.turns for r in chat.canonical_turns(spark.createDataFrame([(x,) for x in lines], "record string").coalesce(1)).collect()]
    assert [[tuple(t) for t in x] if x else x for x in got] == [[("user", "q"), ("assistant", "a")], [("user", "i\n\nx"), ("assistant", "o")], [("user", "p"), ("assistant", "c")], None, None, None]


def test_lists_of_mixed_messages_lose_no_text(spark):
    lines = [
        '{"messages":[{"role":"user","content":"q"},{"role":"assistant","text":"a"},{"from":"gpt","value":"b"}]}',
        '{"messages":[{"role":"user","content":"q","text":"r"},"bare",{"role":"user"},{"role":null,"content":null}]}',
        '{"conversation":[{"role":"user","content":"x"}],"other":[{"role":"y"}]}', '{"messages":[]}', '{"messages":[{"role":"user"}]}', '{"messages":"text"}',
    ]
    got = [[tuple(t) for t in r.turns] if r.turns is not None else None for r in chat.canonical_turns(spark.createDataFrame([(x,) for x in lines], "record string").coalesce(1)).collect()]
    assert got[0] == [("user", "q"), ("assistant", "a"), ("assistant", "b")]
    assert got[1] == [("user", "q\n\nr"), ("", "bare"), ("user", ""), ("", "")]
    assert got[2:] == [[("user", "x")], None, None, None]


def test_typed_records_select_mappings_row_by_row(spark):
    rows = [("p", None, None, [("user", "t", None)]), ("p", "c", None, None), ("p", None, "r", None), (None, None, None, [("human", None, "v"), ("gpt", "t", "v")]), (None, None, None, None)]
    table = spark.createDataFrame(rows, "prompt string, completion string, response string, turns array<struct<role:string,text:string,value:string>>").coalesce(1)
    found = chat.structured_turns(table).collect()
    got = [[tuple(t) for t in r.canonical] if r.canonical is not None else None for r in found]
    assert got == [None, [("user", "p"), ("assistant", "c")], [("user", "p"), ("assistant", "r")], [("user", "v"), ("assistant", "t\n\nv")], None]
    assert len({r.fingerprint for r in found}) == 5
    assert chat.structured_turns(table.select("prompt").limit(0)).count() == 0


def test_dictionary_from_many_copies(spark):
    table = spark.range(4000).selectExpr("id % 7 page_id", "concat('<p>', repeat(sha2(string(id % 7), 256), 9)) html").union(spark.range(900).selectExpr("100 + id", "concat('<q>', repeat(sha2(string(id), 512), 3))"))
    words = warc.build_dictionary(table)
    assert 0 < len(words) <= warc.DICTIONARY_BYTES
    assert warc.build_dictionary(table.limit(0)) == b""


def _repeated(data: list[bytes], window: int):
    seen = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        hit = np.zeros(len(d), bool)
        for i in range(len(d) - window + 1):
            if seen[d[i : i + window]] > 1:
                hit[i : i + window] = True
        out.append(hit)
    return out


def test_suffixes(spark, docs):
    data = [(r.text or "").encode() for r in docs.collect()]
    rows = suffixes.repeated_spans(docs, 60).select("row.text", suffixes.kept_bytes(F.col("row.text"), F.col("spans")).alias("kept")).collect()
    want = Counter((d, bytes(np.frombuffer(d, np.uint8)[~h])) for d, h in zip(data, _repeated(data, 60), strict=True))
    assert Counter(((r.text or "").encode(), bytes(r.kept)) for r in rows) == want
    draw = np.random.default_rng(5)
    for n in range(1, 80):
        s = draw.integers(1, 4, n)
        assert list(suffixes.suffix_array(s, 4, 10**9)) == sorted(range(n), key=lambda i: tuple(s[i:]))


def test_op7_query_equals_brute_force_and_gives_the_cleaned_text(spark, tmp_path):
    draw = np.random.default_rng(17)
    own = lambda k: " ".join(f"{k}own{draw.integers(10**9)}" for _ in range(20))
    long, short = (" ".join(f"{k}{draw.integers(10**n)}" for _ in range(55)) for k, n in (("passage", 5), ("q", 3)))
    assert len(long) > 400 > len(short)
    rows = [(i, f"{own(i)} {part}{end} {own(-i)}") for i, (part, end) in enumerate([(long, "é"), (long, "è"), (short, "é"), (short, "è"), (long + long, ""), (long[:399], "")])]
    rows += [(6, long), (7, long), (7, long), (None, own(7) * 3), (8, None), (9, ""), (10, short), (11, own(8) * 3), (12, "ab" * 300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, data = [], [(t or "").encode() for _, t in rows]
    for (doc, text), d, hit in zip(rows, data, _repeated(data, 400), strict=True):
        kept = np.frombuffer(d, np.uint8)[~hit].tobytes()
        starts = int((np.diff(np.r_[0, hit.astype(int)]) == 1).sum())
        want.append((doc, len(d), int(hit.sum()), starts, hashlib.sha256(kept).hexdigest(), kept.decode(errors="replace")))
    assert "\ufffd" in want[0][-1] and long not in want[0][-1] and want[2][-1] == rows[2][1] and want[14][2] == 600
    found = op7_suffixes(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text").collect()
    assert Counter(tuple(r) for r in found) == Counter(want)


def test_mixing(spark, docs):
    own = mixing.written(mixing.narrow(docs.withColumn("row", F.monotonically_increasing_id()), 0))
    rows = mixing.plan(own).collect()
    texts = [r.text or "" for r in docs.collect()]
    assert sum(r.size for r in rows) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts)
    goals = {r.key: (r.source_size, r.target) for r in rows}
    assert abs(sum(t for _, t in goals.values()) - sum(s for s, _ in goals.values())) < 1e-6 and all(t <= 3 * s + 1e-9 for s, t in goals.values())
    largest = max(r.size for r in rows)
    for key, (_, target) in goals.items():
        assert abs(sum(r.size * r.times for r in rows if r.key == key) - target) <= largest / 2
    mixed = mixing.mix(docs)
    assert mixed.count() == sum(r.times for r in rows) and set(docs.columns) <= set(mixed.columns)
    quotas = np.array([30, 5, 0, 65])
    parts = [mixing.leaf_range(quotas, i, 7, 1) for i in range(7)]
    assert (sum(n for _, n in parts) == quotas).all() and all((parts[i][0] + parts[i][1] == parts[i + 1][0]).all() for i in range(6))


def test_packing_and_records(spark, docs):
    texts = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text")
    tokenizer = Tokenizer.from_file(vocabulary(WORDS))
    ids = {r.doc_id: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in texts.collect()}
    pieces = packing.pack(texts, vocabulary(WORDS), 2).toPandas()
    for doc, part in pieces.sort_values("start").groupby("doc_id"):
        assert b"".join(part["ids"]) == ids[doc].tobytes() and set(part["doc_tokens"]) == {len(ids[doc])}
    for _, part in pieces.sort_values("offset").groupby("sequence_id"):
        n = part["length"].sum()
        assert list(part["offset"]) == [0, *part["length"].cumsum()[:-1]] and n <= 4096 and n & (n - 1) == 0
    tokenizer = Tokenizer.from_file(vocabulary(BYTES))
    manifest = records.write_records(texts, vocabulary(BYTES), 0)
    before = 0
    for r in records.read_records(manifest).orderBy("doc_id").collect():
        text = texts.filter(F.col("doc_id") == r.doc_id).first().text
        assert r.before == before and zlib.crc32(r.ids) == zlib.crc32(np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
        before += len(r.ids) // 4
    again = records.read_shuffled(manifest, 5)
    assert sorted(r.doc_id for r in again.collect()) == sorted(ids)


def test_pipeline_cuts_passages_of_over_fifty_words(spark):
    draw = np.random.default_rng(8)
    own = lambda: " ".join(f"own{draw.integers(10**9)}" for _ in range(40))
    long, short, tiny = (" ".join(f"{k}{i}" for i in range(n)) for k, n in (("p", 51), ("q", 50), ("r", 30)))
    han = "".join(chr(0x4E00 + i) for i in range(60))
    rows = [(i, f"{own()} {part} {own()}") for i, part in enumerate([long, long, short, short, tiny, tiny, han, han])]
    rows += [(8, long.replace("p", "s")), (9, long.replace("p", "s")), (10, None)]
    table = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, table, "").collect()}
    assert not any(f"{part[1:-1]}" in found[i] for i, part in ((0, long), (1, long), (6, han), (7, han)))
    assert all(found[i] == dict(rows)[i] for i in (2, 3, 4, 5, 10)) and 8 not in found and 9 not in found


def test_crowded_grams(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CROWD", 4)
    draw = np.random.default_rng(11)
    own = lambda n: " ".join(draw.choice(WORD, n))
    passage, phrase = own(40), own(9)
    rows = [(i, f"{own(15)}{i} {passage if i % 3 else phrase} {own(15)}") for i in range(40)]
    rows += [(100 + i, f"{i}{passage[:58 + i]}{'xyz'[i % 3]}") for i in range(12)] + [(200, passage), (None, passage), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffixes.repeated_spans(table, 60).select("row.text", suffixes.kept_bytes(F.col("row.text"), F.col("spans")).alias("kept")).collect()
    data = [(t or "").encode() for _, t in rows]
    want = Counter((d, bytes(np.frombuffer(d, np.uint8)[~h])) for d, h in zip(data, _repeated(data, 60), strict=True))
    assert Counter(((r.text or "").encode(), bytes(r.kept)) for r in found) == want


def test_no_bucket_grows_with_a_hot_passage(spark, monkeypatch):
    """The bytes that meet in one task stay bounded when ever more documents share a passage."""
    seen = []
    dealt = type(spark.range(1).groupBy("id")).applyInPandas

    def watched(group, function, schema):
        seen.append(group._df.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0)
        return dealt(group, function, schema)

    monkeypatch.setattr(type(spark.range(1).groupBy("id")), "applyInPandas", watched)
    monkeypatch.setattr(suffixes, "CROWD", 16)
    passage = " ".join(WORD[:60])
    table = spark.range(300).select("id", F.concat(F.sha2(F.col("id").cast("string"), 512), F.lit(passage), F.sha2((-F.col("id")).cast("string"), 512)).alias("text")).withColumnRenamed("id", "doc_id")
    out = suffixes.repeated_spans(table, 60).select(F.explode("spans").alias("s")).groupBy(F.col("s.end") - F.col("s.start")).count().collect()
    assert sum(r["count"] for r in out) == 300 and seen and max(seen) < 300


def test_reading_records_gives_the_encoder_back(spark, tmp_path):
    import pyarrow as pa

    from perfloom.llm import storage, text_ids

    text_ids.text_ids(vocabulary(BYTES), True, 0, 2)
    (tmp_path / "a.rec").write_bytes(records.framed(struct.pack(records.OWNER, True, 4, 5) + b"\1\0\0\0"))
    row = {"shard": 0, "file": str(tmp_path / "a.rec"), "base": 0, "records": 1}
    (batch,) = records._whole_files([pa.RecordBatch.from_pylist([row])])
    assert batch.to_pylist() == [{"shard": 0, "ordinal": 0, "doc_id": 5, "before": 0, "ids": b"\1\0\0\0"}]
    assert list(storage._HELD) == ["records"]
