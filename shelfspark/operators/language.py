"""Languages of texts: profiles of character triples, scores, samples and a vote of three."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.operators.catalogue import spread_sample
from shelfspark.shared import stored

#: Characters of a sample, letters it must hold, and their least part.
SAMPLE, LETTERS, LETTER_PART = 1600, 500, 0.5
CHUNK, CHUNK_LETTERS = 400, 180
GAP, CHUNK_GAP = 0.35, 0.55


#: Triples of so many characters are counted at once.
PIECE = 1 << 20


def triple_codes(text: str) -> np.ndarray:
    """The character triples of a text, as numbers: 21 bits a character."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:] if len(c) > 2 else np.empty(0, np.int64)


def spelled(code: int) -> str:
    return chr(code >> 42) + chr(code >> 21 & 0x1FFFFF) + chr(code & 0x1FFFFF)


def triple_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each character triple, in lower case, occurs in the texts of rows (lang, text).

    Counted in pieces of the Arrow batches, so that only a language's triples of a piece are moved, not their occurrences.
    """

    def counts(lang: str | None, held: list[np.ndarray]) -> pd.DataFrame:
        codes, n = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"lang": pd.Series([lang] * len(codes), dtype=object), "gram": [spelled(c) for c in codes.tolist()], "n": n})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str | None, list[np.ndarray]] = {}
        size: dict[str | None, int] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                if text is not None and len(text) > 2:
                    held.setdefault(lang, []).append(triple_codes(text))
                    size[lang] = size.get(lang, 0) + len(text)
                    if size[lang] >= PIECE:
                        yield counts(lang, held.pop(lang))
                        del size[lang]
        for lang, codes in held.items():
            yield counts(lang, codes)

    made = rows.select("lang", F.lower("text").alias("text")).mapInPandas(count, "lang string, gram string, n long")
    return made.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(labelled: DataFrame, most: int = 300) -> DataFrame:
    """(lang, gram, weight) of labelled texts (lang, text): each language's most frequent triples (ties by spelling) by their part of all its triples."""
    # one row a language and triple: of bounded alphabets; its window is over types, not occurrences
    w = Window.partitionBy("lang")
    ranked = triple_counts(labelled).withColumns({"all": F.sum("n").over(w), "r": F.row_number().over(w.orderBy(F.desc("n"), "gram"))})
    return ranked.where(F.col("r") <= most).select("lang", "gram", (F.col("n") / F.col("all")).alias("weight"))


def detect(texts: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """(id, lang, score, second, gap) of texts (id, text) by profiles: parts that sum to one over the languages; a text without a known triple has no row.

    A text is scored where it lies: the profiles (a few hundred triples a language) are sent to the tasks, no triple is moved.
    """
    taught = [(r["lang"], r["gram"], r["weight"]) for r in known.where("length(gram) = 3").collect()]
    last = lambda lang: (lang is None, lang or "")
    langs = sorted({lang for lang, _, _ in taught}, key=last)
    grams, place = np.unique(np.array([triple_codes(gram)[0] for _, gram, _ in taught], np.int64), return_inverse=True)
    weights = np.zeros((len(grams), len(langs)))
    for row, (lang, _, weight) in zip(place, taught, strict=True):
        weights[row, langs.index(lang)] += weight

    def best(text: str | None) -> tuple | None:
        codes = triple_codes(text or "")
        at = np.searchsorted(grams, codes)
        at = at[grams[np.minimum(at, len(grams) - 1)] == codes] if len(grams) else at[:0]
        if not len(at):
            return None
        tf = np.bincount(at, minlength=len(grams))
        sums = tf @ weights
        # a language of which the text holds no triple takes no place
        held = sorted(((-s, lang) for s, lang, n in zip(sums.tolist(), langs, tf @ (weights > 0), strict=True) if n), key=lambda x: (x[0], last(x[1])))
        whole = -sum(s for s, _ in held)
        return held[0][1], -held[0][0] / whole, -held[1][0] / whole if len(held) > 1 else 0.0

    @F.pandas_udf("lang string, score double, second double")
    def scored(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best(t) or (None, None, None) for t in texts], columns=["lang", "score", "second"])

    made = texts.select(key, scored(F.lower("text")).alias("__s")).select(key, "__s.*").where("score is not null")
    return made.withColumn("gap", F.col("score") - F.col("second"))


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def samples(units: DataFrame, n: int = 3) -> DataFrame:
    """(id, sample, place, start, text): at most n evenly spread samples of each document's units (id, place, text).

    A unit offers its first, middle and last SAMPLE characters, where they do not overlap one taken
    before; a sample needs LETTERS letters and more letters than other characters. Of samples with
    equal letters and digits a document keeps the first.
    """
    size = F.length("text")
    starts = F.array_distinct(F.array_sort(F.array(F.lit(0), F.greatest(F.lit(0), F.floor(size / 2).cast("int") - SAMPLE // 2), F.greatest(F.lit(0), size - SAMPLE))))
    windows = F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring("text", s + 1, F.lit(SAMPLE)).alias("text")))
    ok = lambda x: (letters(x["text"]) >= LETTERS) & (letters(x["text"]) >= LETTER_PART * F.length(x["text"]))
    # A unit's windows stay in its row.
    lists = units.where("text is not null").select("id", "place", F.filter(windows, ok).alias("w"))
    free = F.aggregate("w", F.array().cast("array<struct<start:int,text:string>>"), lambda acc, x: F.when((F.size(acc) == 0) | (x["start"] >= F.element_at(F.concat(acc, F.array(x)), F.size(acc))["start"] + SAMPLE), F.array_append(acc, x)).otherwise(acc))
    taken = lists.select("id", "place", F.explode(free).alias("x")).select("id", "place", "x.*")
    first = taken.groupBy("id", F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}_]", "")).alias("same")).agg(F.min(F.struct("place", "start", "text")).alias("x")).select("id", "x.*")
    spread = spread_sample(first, ["id"], [F.col("place"), F.col("start")], n)
    return spread.withColumn("sample", F.row_number().over(Window.partitionBy("id").orderBy("place", "start")))


def vote(taken: DataFrame, known: DataFrame, allowed: tuple[str, ...], gap: float = GAP, chunk_gap: float = CHUNK_GAP, need: int = 3) -> DataFrame:
    """(id, language, reason, clear, multilingual) of samples: the language that `need` clear samples agree on.

    A sample is clear if its best language is allowed and leads by the gap; multilingual if one of
    its chunks of CHUNK characters leads by chunk_gap with another language. Reason: null, too_few, multilingual,
    unclear or disagree.
    """
    taken = stored(taken.withColumn("key", F.struct("id", "sample")), "samples")
    top = detect(taken.select("key", "text"), known, "key")
    at = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / CHUNK).cast("int"))
    chunks = taken.where("text <> ''").select("key", F.posexplode(F.transform(at, lambda i: F.substring("text", i * CHUNK + 1, F.lit(CHUNK)))).alias("c", "text")).where(letters(F.col("text")) >= CHUNK_LETTERS)
    parts = detect(chunks.select(F.struct("key", "c").alias("ck"), "text"), known, "ck").where(F.col("gap") >= chunk_gap).select(F.col("ck.key").alias("key"), F.col("lang").alias("part"))
    other = parts.join(top.select("key", "lang"), "key").where("part <> lang").select("key").distinct().withColumn("mixed", F.lit(True))
    judged = taken.select("key").join(top, "key", "left").join(other, "key", "left")
    mixed = F.coalesce("mixed", F.lit(False))
    judged = judged.withColumns({"clear": ~mixed & F.coalesce(F.col("lang").isin(*allowed) & (F.col("gap") >= gap), F.lit(False)), "mixed": mixed})
    per = judged.groupBy(F.col("key.id").alias("id")).agg(F.count("*").alias("n"), F.count_if("clear").alias("clear"), F.count_if("mixed").alias("multilingual"), F.collect_set(F.when(F.col("clear"), F.col("lang"))).alias("langs"))
    agreed = (F.col("n") == need) & (F.col("clear") == need) & (F.size("langs") == 1)
    reason = F.when(agreed, None).when(F.col("n") < need, "too_few").when(F.col("multilingual") > 0, "multilingual").when(F.col("clear") < need, "unclear").otherwise("disagree")
    return per.select("id", F.when(agreed, F.get("langs", F.lit(0))).alias("language"), reason.alias("reason"), "clear", "multilingual")
