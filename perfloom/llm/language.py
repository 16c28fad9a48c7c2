"""Language of whole texts by bit-sliced Bloom filters of n-grams.

The filter is one table of slots; a slot is a row of bits, one per language, so looking up an n-gram's slots
and joining them by AND gives all languages that (seem to) contain it. A text's n-grams are counted per
language by those bits; the expected number of false positives of each language's filter is taken off,
and the largest count decides.

Training uses labelled rows: about `SAMPLE` of each language (all, if fewer), drawn by a hash. An n-gram is put into a
language's filter if it occurs there at least twice, at a rate of at least `SHARE` of its highest rate. The
table has a fixed size, so what is collected and broadcast does not grow with the data.

An n-gram is `GRAM` characters of the lower-cased text, where each run of characters other than letters is one
blank. Texts are read whole, in slices that overlap.

Cases: a null text, or one without letters, is `und` with score 0; a text with letters but no known n-gram is of
the language most frequent in training, with score 0; ties go to the first language by name; without
labelled rows everything is `und`; an empty table gives no rows. Other columns are kept, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

UNKNOWN = "und"
SAMPLE = 2000
GRAM = 4
SLOTS = 1 << 20
PROBES = 3
SHARE = 0.2
PAGE = 4096
SLICE = 1 << 20


@dataclass
class Model:
    """``slots``: (words of 64 languages, SLOTS) bits; ``false``: chance that a filter says yes by accident."""

    languages: list[str]
    slots: object
    false: object
    usual: int


def grams(texts: list[str]):
    """Text number and hash of every n-gram, and for each text whether it has letters."""
    import numpy as np

    table = _letters()
    parts, owner = [], []
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text)), SLICE):
            parts.append(text[max(0, at - GRAM + 1) : at + SLICE].lower())
            owner.append(k)
    codes = np.frombuffer((" " + " ".join(parts) + " ").encode("utf-32-le", "replace"), np.uint32)
    part = np.repeat(np.arange(len(parts)), np.array([len(p) + 1 for p in parts]))
    part = np.append(part, part[-1:])
    letter = table[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    own = np.array(owner, np.int64)
    has = np.bincount(own[part[letter]], minlength=len(texts)) > 0
    code, part = np.where(letter, codes, 32)[keep].astype(np.uint64), part[keep]
    n = len(code) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64), has
    hashed = code[:n].copy()
    for i in range(1, GRAM):
        hashed *= np.uint64(0x9E3779B97F4A7C15)
        hashed += code[i : i + n]
    hashed ^= hashed >> np.uint64(31)
    hashed *= np.uint64(0xD6E8FEB86659FD93)
    hashed ^= hashed >> np.uint64(29)
    inside = part[1 : n + 1] == part[GRAM - 1 :] if GRAM > 1 else slice(None)
    return own[part[GRAM - 1 :]][inside], hashed[inside], has


@lru_cache(maxsize=1)
def _letters():
    import numpy as np

    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def slots_of(hashed, probe: int):
    import numpy as np

    step = (hashed >> np.uint64(20)) | np.uint64(1)
    return ((hashed + np.uint64(probe) * step) & np.uint64(SLOTS - 1)).astype(np.int64)


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """``labelled``: text and lang."""
    import numpy as np

    rows = labelled.filter("text is not null and lang is not null").select("text", "lang")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    names = sorted(sizes)
    if not names:
        return Model([], np.zeros((1, SLOTS), np.uint64), np.zeros(0), 0)
    number = F.element_at(F.create_map(*[x for i, lang in enumerate(names) for x in (F.lit(lang), F.struct(F.lit(i).alias("i"), F.lit(min(1.0, sample / sizes[lang])).alias("share")))]), F.col("lang"))
    drawn = rows.withColumn("of", number).filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.col("of.share") * (1 << 30))

    def count(batches):
        import numpy as np

        for batch in batches:
            for lang, texts in batch.groupby("i")["text"]:
                texts = texts.tolist()
                for at in range(0, len(texts), 256):
                    found, n = np.unique(grams(texts[at : at + 256])[1].view(np.int64), return_counts=True)
                    yield pd.DataFrame({"gram": found, "lang": lang, "n": n})

    counted = drawn.select("text", "of.i").mapInPandas(count, "gram long, lang int, n long")
    counted = written(counted.groupBy("gram", "lang").agg(F.sum("n").alias("n")))
    totals = {r.lang: r.n for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return Model([], np.zeros((1, SLOTS), np.uint64), np.zeros(0), 0)
    rate = F.col("n") / F.element_at(F.create_map(*[F.lit(x) for kv in totals.items() for x in kv]), F.col("lang"))
    rated = counted.withColumn("rate", rate)
    best = rated.groupBy("gram").agg(F.max("rate").alias("best"))
    members = rated.join(best, "gram").filter((F.col("n") > 1) & (F.col("rate") >= SHARE * F.col("best"))).select("gram", "lang")

    def set_bits(batches):
        import numpy as np

        for batch in batches:
            gram = batch["gram"].to_numpy().view(np.uint64)
            bit = (np.uint64(1) << (batch["lang"].to_numpy() % 64).astype(np.uint64)).view(np.int64)
            for k in range(PROBES):
                yield pd.DataFrame({"word": batch["lang"] // 64, "slot": slots_of(gram, k), "bits": bit})

    def page(key, frame):
        import numpy as np

        out = np.zeros(PAGE, np.int64)
        out[frame["slot"].to_numpy() % PAGE] = frame["bits"]
        return pd.DataFrame({"word": [key[0]], "page": [key[1]], "data": [out.tobytes()]})

    filled = members.mapInPandas(set_bits, "word int, slot long, bits long").groupBy("word", "slot").agg(F.bit_or("bits").alias("bits"))
    pages = filled.groupBy("word", F.floor(F.col("slot") / PAGE).alias("page")).applyInPandas(page, "word int, page long, data binary")
    slots = np.zeros((-(-len(names) // 64), SLOTS), np.uint64)
    for r in pages.toLocalIterator():  # SLOTS * 8 bytes for 64 languages
        slots[r.word, r.page * PAGE : (r.page + 1) * PAGE] = np.frombuffer(r.data, np.uint64)
    fill = np.array([((slots[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(names))])
    usual = max(range(len(names)), key=lambda i: (sizes[names[i]], -i))
    return Model(names, slots, fill**PROBES, usual)


def decide(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score (share of its n-grams that the language has, corrected) of each text."""
    import numpy as np

    owner, hashed, has = grams([t or "" for t in texts])
    if not model.languages:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    total = np.bincount(owner, minlength=len(texts))
    counts = np.zeros((len(model.languages), len(texts)))
    for word in range(len(model.slots)):
        found = model.slots[word][slots_of(hashed, 0)]
        for k in range(1, PROBES):
            found &= model.slots[word][slots_of(hashed, k)]
        for i in range(64 * word, min(len(model.languages), 64 * word + 64)):
            counts[i] = np.bincount(owner[(found >> np.uint64(i % 64)) & np.uint64(1) == 1], minlength=len(texts))
    false = np.minimum(model.false, 0.999)[:, None]
    counts = np.maximum(0, (counts - total * false) / (1 - false))
    best = counts.argmax(axis=0)
    top = counts[best, np.arange(len(texts))]
    best[top == 0] = model.usual
    score = np.clip(top / np.maximum(total, 1), 0, 1) * has
    return [model.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], score.tolist()


def predictor(docs: DataFrame, model: Model):
    """A function from a text column to a struct of lang and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS * 8 bytes for 64 languages

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        values, lang, score = texts.tolist(), [], []
        some, weight = [], 0
        for text in [*values, None]:
            some.append(text)
            weight += len(text or "")
            if weight > SLICE:
                for out, part in zip((lang, score), decide(shared.value, some), strict=True):
                    out += part
                some, weight = [], 0
        for out, part in zip((lang, score), decide(shared.value, some), strict=True):
            out += part
        return pd.DataFrame({"lang": lang[: len(values)], "score": score[: len(values)]})

    return predict.asNondeterministic()  # else a filter on its result would run it once more


def identified(docs: DataFrame, training: Column, name: str = "_language") -> DataFrame:
    """``docs`` with a struct column of the predicted lang and its score; trained on the rows of ``training``."""
    labelled = docs.filter(training).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return docs.withColumn(name, predictor(docs, train(labelled))(F.col("text").cast("string")))
