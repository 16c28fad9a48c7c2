"""Stages of the pipeline on overlapping passages, nulls, empty tables and columns with clashing names."""

from __future__ import annotations

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from perfloom.llm import text_ids as text_ids_module
from perfloom.llm.queries import BYTES, WORDS, vocabulary
from perfloom.llm.text_ids import text_ids

PLAIN = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ", _language string, _row string, _shard string, _place string, _doc string, kept_doc string, spans string, singles string, doc_key string, text_hash string"


def test_repeats_that_only_touch_are_no_passage(spark):
    words = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    whole = words("x", 60).split()
    rows = [(1, " ".join(whole)), (2, f"{words('b', 9)} {' '.join(whole[:36])} {words('c', 9)}"), (3, f"{words('d', 9)} {' '.join(whole[-36:])} {words('e', 9)}")]
    long = words("p", 51)
    rows += [(4, f"{words('f', 9)} {long} {words('g', 9)}"), (5, f"{words('h', 9)} {long} {words('i', 9)}"), (6, long)]
    table = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], PLAIN)
    found = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, table, "").collect()}
    assert all(found[i].text == dict(rows)[i] for i in (1, 2, 3)) and 6 not in found
    assert found[4].text.split() == [*words("f", 9).split(), *words("g", 9).split()] and found[4].n_chars == len(found[4].text)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_odd_rows_and_columns(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    prose = [" ".join(f"w{(i * 7 + k * k) % 91}" for k in range(60)) for i in range(12)]
    rows = [(i, t, "en" if i % 2 else "de", "ab"[i % 2], len(t)) for i, t in enumerate(prose)]
    rows += [rows[0], (20, "", "en", None, 0), (21, None, None, "a", None), (None, prose[1], None, None, None), (None, None, None, None, None)]
    table = spark.createDataFrame([(*r, *["own"] * 10) for r in rows], PLAIN + CLASH)
    out = stage(spark, table, "")
    kept = out.collect()
    assert kept or name == "language_id"
    if name != "packing":
        assert out.columns == table.columns and all(r["_row"] == r["spans"] == r["kept_doc"] == "own" for r in kept)
    assert stage(spark, table.limit(0), "").count() == 0


@pytest.mark.parametrize(("file", "blanks"), [(WORDS, False), (BYTES, True)])
def test_added_tokens_in_texts_get_the_plain_call_s_ids(file, blanks):
    texts = ["a <|endoftext|> b", "x<|endoftext|><|startoftext|>", "a <|ENDOFTEXT|> b", "plain words here.", None, "<|"]
    plain = Tokenizer.from_file(vocabulary(file))
    want = [b"".join(i.to_bytes(4, "little") for i in [*plain.encode(t or "", add_special_tokens=False).ids, 7]) for t in texts]
    assert text_ids(vocabulary(file), blanks, 7).encode(texts) == want


@pytest.mark.parametrize(("file", "blanks"), [(WORDS, False), (BYTES, True)])
def test_few_words_remembered_give_the_plain_call_s_ids(file, blanks, monkeypatch):
    monkeypatch.setattr(text_ids_module, "REMEMBERED", 60)
    monkeypatch.setattr(text_ids_module, "CHARS", 200)
    odd = ["é.", "Straße, straße", "ends.\nNext: line", "", "x" * 300, "tab\there", "two  blanks", "\n", "mark %%% 12.5", "İi ßS ǅ", "Ωmega Ας ΑΣ.", None]
    texts = [f"{odd[i % 12] or ''}word{i} the of common, w{i % 7}." for i in range(90)] + odd
    plain = Tokenizer.from_file(vocabulary(file))
    want = [b"".join(i.to_bytes(2, "little") for i in [*plain.encode(t or "", add_special_tokens=False).ids, 7]) for t in texts]
    encoder = text_ids_module.TextIds(vocabulary(file), blanks, 7, 2)
    assert encoder.encode(texts) + encoder.encode(reversed(texts)) == want + want[::-1]
    assert 0 < len(encoder.words) <= 60 and "x" * 300 not in encoder.words.to_pylist()
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    parts = [(part.column("doc_id").to_pylist(), ids) for part, ids in encoder.parts(batch, 10)]
    assert [x for _, ids in parts for x in ids] == want and [x for docs, _ in parts for x in docs] == list(range(len(texts)))
    assert all(len(docs) == len(ids) <= 10 for docs, ids in parts) and not list(encoder.parts(batch.slice(0, 0)))


def test_a_remembered_word_takes_few_bytes():
    encoder = text_ids_module.TextIds(vocabulary(WORDS), False, 2)
    encoder.encode([" ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(10_000))])
    held = (encoder.words, encoder.ids, encoder.sizes, encoder.met)
    assert len(encoder.words) == 10_000 and sum(x.nbytes for x in held) < 64 * 10_000
