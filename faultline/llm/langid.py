"""Language identification with a word-first backoff.

Known words count by their log frequency in each language; an unseen word falls back to character n-grams, at each
place the longest known one of at most ``GRAMS`` letters, then shorter ones, and moves on behind it. A text's scores
are the sums over its words; its score is the posterior of the best language.

The model is fitted on a bounded sample: at most about ``train_docs`` documents, shared equally by the languages and
chosen by a hash of doc_id, whose whole texts are counted. It keeps every word and n-gram of the sample.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is everything if there is nothing
to learn from; ties between languages go to the first in alphabetical order; repeated rows give repeated results;
further columns of the input are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import Memo, map_text, narrow

GRAMS = 5
WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether crc32(doc_id as text) mod 5 is 0; a null id is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def letters(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Model:
    """Languages and, for each known word and n-gram, its log frequencies."""

    def __init__(self, langs: list[str], rows: list[tuple[int, str, str, int]]):
        self.langs = langs
        at = {x: i for i, x in enumerate(langs)}
        #: for each length (0: words) the place of each n-gram in a matrix
        self.places: dict[int, dict[str, int]] = {}
        for n, gram, _, _ in rows:
            known = self.places.setdefault(n, {})
            known.setdefault(gram, len(known))
        counts = {n: np.zeros((len(known), len(langs))) for n, known in self.places.items()}
        for n, gram, lang, c in rows:
            counts[n][self.places[n][gram], at[lang]] += c
        self.logs = {n: np.log((c + 0.5) / (c.sum(axis=0) + 0.5 * (len(c) + 1))) for n, c in counts.items()}

    def word(self, word: str) -> np.ndarray:
        """0 is the table of words; n that of n-grams."""
        place = self.places.get(0, {}).get(word)
        if place is not None:
            return self.logs[0][place]
        padded, total, i = f"^{word}$", np.zeros(len(self.langs)), 0
        while i < len(padded):
            for n in range(min(GRAMS, len(padded) - i), 0, -1):
                place = self.places.get(n, {}).get(padded[i : i + n])
                if place is not None:
                    total = total + self.logs[n][place]
                    break
            i += n
        return total

    def packed(self, word: str) -> bytes:
        return self.word(word).tobytes()

    def predict(self, text: str | None, memo) -> tuple[str, float]:
        words = letters(text or "")
        if not words or not self.langs:
            return "und", 0.0
        total = np.zeros(len(self.langs))
        for i in range(0, len(words), 100_000):
            total += np.frombuffer(b"".join(map(memo, words[i : i + 100_000]))).reshape(-1, len(self.langs)).sum(axis=0)
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(np.maximum(total - total[best], -700)).sum())


def fit(df: DataFrame, train_docs: int = 6000) -> Model:
    """Learn from the rows of (doc_id, text, lang) that are not held out."""
    rows = narrow(df, "doc_id", "text", "lang").filter(F.col("lang").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], [])
    langs = sorted(sizes)
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, train_docs / len(langs) / sizes[lang]))).otherwise(share)
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)).select("lang", "text")

    def words(b: pa.RecordBatch) -> pa.RecordBatch:
        seen: dict[str, Counter] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            seen.setdefault(lang, Counter()).update(letters(text or ""))
        rows = [(lang, word, c) for lang, found in seen.items() for word, c in found.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "c"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for lang, word, c in zip(*[b.column(i).to_pylist() for i in range(3)]):
                seen[0, word, lang] += c
                padded = f"^{word}$"
                for n in range(1, GRAMS + 1):
                    for i in range(len(padded) - n + 1):
                        seen[n, padded[i : i + n], lang] += c
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(seen.values()), pa.int64())], ["n", "gram", "lang", "c"])

    # each language's words are counted first, so that a word's n-grams are made once
    counted = map_text(sample, words, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c"))
    found = counted.mapInArrow(grams, "n int, gram string, lang string, c long").groupBy("n", "gram", "lang").agg(F.sum("c").alias("c")).toArrow()
    return Model(langs, sorted(zip(*[found.column(i).to_pylist() for i in range(4)])))


def identify(df: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    memos: dict[str, Memo] = {}

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        memo = memos.setdefault("memo", Memo(m.packed)).__getitem__
        found = [m.predict(text, memo) for text in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = narrow(df, "doc_id", "text").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)))
    return map_text(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")
