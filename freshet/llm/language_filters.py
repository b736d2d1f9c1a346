"""Language identification with bit-sliced Bloom filters of character n-grams.

All languages share one table of slots; each slot holds a mask with a bit per language, so that the filter of language L
is the slice of bit L. The masks at an n-gram's slots, combined by AND, name every language that contains it, in one
lookup for all of them. A text's n-grams give each language a count of bits; the hits a language's slice would show by
chance, known from its fill, are taken off, and the largest corrected count decides.

A language's filter holds the n-grams that make up at least ``MIN_SHARE`` of all its n-grams in the training rows: at
most 1/MIN_SHARE of them, however large the corpus. The table is therefore of fixed size and is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.common import Batches, map_texts
from freshet.session import drop_staged, stage

MIN_SHARE = 1e-5
SLOTS = 1 << 20
HASHES = 3
#: Distinct n-grams that a training task holds before it hands its counts on.
HELD_GRAMS = 2_000_000

_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 4-grams of all texts, with each one's text number. Anything but letters is a blank; a 4-gram counts
    if its second character is a letter, so that even a one-letter word has one."""
    joined = "".join(f" {t.lower()}   " for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    codes = np.where(letter, codes, 32).astype(np.uint64)
    at = np.flatnonzero(letter[1:-2])
    h = codes[at] * _MIX[0]
    for k in (1, 2, 3):
        h = (h ^ (h >> np.uint64(29))) * _MIX[k] + codes[at + k] * _MIX[0]
    h = (h ^ (h >> np.uint64(32))) * _MIX[1]
    ends = np.cumsum([len(t.lower()) + 4 for t in texts])
    return h ^ (h >> np.uint64(29)), np.searchsorted(ends, at + 1, side="right")


def slots(hashes: np.ndarray) -> list[np.ndarray]:
    step = (hashes >> np.uint64(40)) | np.uint64(1)
    return [((hashes + np.uint64(k) * step) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]


def _count(languages: list[str]) -> Callable[[Batches], Batches]:
    def work(batches: Batches) -> Batches:
        number = {name: k for k, name in enumerate(languages)}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            lang, gram, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((gram, lang))
            lang, gram, n = lang[order], gram[order], n[order]
            first = np.flatnonzero(np.r_[True, (lang[1:] != lang[:-1]) | (gram[1:] != gram[:-1])])
            return lang[first], gram[first], np.add.reduceat(n, first)

        def handed(x: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1].view(np.int64)), pa.array(x[2])], names=["lang", "gram", "n"])

        for batch in batches:
            langs = np.array([number[x] for x in batch.column(1).to_pylist()], np.int32)
            texts = batch.column(0).to_pylist()
            for code in np.unique(langs):
                found, _ = grams([t for t, k in zip(texts, langs, strict=True) if k == code])
                gram, n = np.unique(found, return_counts=True)
                if len(gram):
                    held.append((np.full(len(gram), code), gram, n))
                    size += len(gram)
            if size > HELD_GRAMS:
                held = [summed()]
                size = len(held[0][0])
                if size > HELD_GRAMS // 2:
                    yield handed(held[0])
                    held, size = [], 0
        if held:
            yield handed(summed())

    return work


@dataclass(frozen=True)
class Filters:
    """``masks[w]``: for each slot the bits of languages 64w to 64w+63; ``chance``: what a slice answers by chance."""

    languages: list[str]
    masks: np.ndarray
    chance: np.ndarray


def train(rows: DataFrame, text: str = "text", lang: str = "lang") -> Filters:
    """Filters of all languages in ``rows`` (all of them count; null text or lang is left out)."""
    spark = rows.sparkSession
    rows = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null")
    languages = sorted(r.lang for r in rows.select("lang").distinct().collect())
    counts = map_texts(rows, _count(languages), "lang int, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Sums by language need all counts once more; they are summed before they are dealt.
    counts, folder = stage(counts, "gram-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = counts.join(F.broadcast(totals), "lang").filter(F.col("n") >= F.col("total") * MIN_SHARE).select("lang", "gram")
    frequent = frequent.withColumn("word", F.floor(F.col("lang") / 64).cast("int")).withColumn("bit", F.expr("shiftleft(1L, lang % 64)"))
    # At most SLOTS rows for each 64 languages come back.
    filled = map_texts(frequent.select("word", "gram", "bit"), _to_slots, "word int, slot int, bit bigint").groupBy("word", "slot").agg(F.bit_or("bit").alias("mask")).toArrow()
    drop_staged(spark, folder)
    masks = np.zeros((max(1, -(-len(languages) // 64)), SLOTS), np.uint64)
    masks[filled["word"].to_numpy(), filled["slot"].to_numpy()] = filled["mask"].to_numpy().view(np.uint64)
    fill = np.array([np.count_nonzero(masks[k // 64] >> np.uint64(k % 64) & np.uint64(1)) / SLOTS for k in range(len(languages))])
    return Filters(languages, masks, fill**HASHES)


def _to_slots(batches: Batches) -> Batches:
    for batch in batches:
        word, gram, bit = (batch.column(k).to_numpy() for k in range(3))
        found = slots(gram.view(np.uint64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.tile(word, HASHES)), pa.array(np.concatenate(found).astype(np.int32)), pa.array(np.tile(bit, HASHES))], names=["word", "slot", "bit"]
        )


def decide(filters: Filters, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score (the winner's share of all corrected counts) of each text; ``und`` without a letter. Ties, and
    texts of unknown n-grams, go to the first language by name."""
    found, owner = grams([t or "" for t in texts])
    total = np.bincount(owner, minlength=len(texts)).astype(float)
    at = slots(found)
    corrected = np.zeros((len(texts), len(filters.languages)))
    for word, table in enumerate(filters.masks):
        mask = table[at[0]] & table[at[1]] & table[at[2]]
        for k in range(64 * word, min(64 * word + 64, len(filters.languages))):
            hits = np.bincount(owner[(mask >> np.uint64(k % 64) & np.uint64(1)).astype(bool)], minlength=len(texts))
            corrected[:, k] = np.maximum(0, (hits - total * filters.chance[k]) / max(1e-9, 1 - filters.chance[k]))
    if not filters.languages:
        return ["und"] * len(texts), np.zeros(len(texts))
    best, whole = corrected.argmax(axis=1), corrected.sum(axis=1)
    score = np.where(whole > 0, corrected.max(axis=1) / np.maximum(whole, 1e-9), 0.0)
    und = total == 0
    return ["und" if u else filters.languages[k] for u, k in zip(und, best, strict=True)], np.where(und, 0.0, np.clip(score, 0, 1))


def predict(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``lang_pred`` and ``score``. Nothing but the text decides."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((filters.languages, filters.masks, filters.chance))
    kept = [c for c in docs.columns if c != text]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema

    def work(batches: Batches) -> Batches:
        own = Filters(*shared.value)
        for batch in batches:
            langs, score = decide(own, batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(langs, pa.string()), pa.array(score)], names=[*batch.schema.names[1:], "lang_pred", "score"])

    out = schema.add("lang_pred", "string").add("score", "double")
    return map_texts(docs.select(F.col(f"`{text}`"), *[F.col(f"`{c}`") for c in kept]), work, out)


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on three quarters of the labelled documents, predict all. A null id is not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    filters = train(docs.filter(~held_out))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), filters)
