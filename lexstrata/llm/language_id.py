"""Language ID by rank-order profiles.

A profile is the list of the most frequent letter n-grams (1 to 3 letters, words
padded by a blank), most frequent first. A text's profile is compared with each
language's by the out-of-place distance: the sum, over the text's n-grams, of how
far each is from its place in the language's list, with the list's length for
those not in it.

Profiles are learned from a bounded sample (``train_docs`` documents of each
language, chosen by a hash of the id); prediction reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
#: More values than there are languages with a code.
MOST_LANGS = 10_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else 0."""
    found = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return np.where(found, np.arange(0x110000), 0).astype(np.int64)


def ngram_keys(text: str) -> np.ndarray:
    """The n-grams of the lower-cased text as sorted numbers, 21 bits a letter; empty without letters."""
    points = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    letter = points != 0
    if not letter.any():
        return np.zeros(0, np.int64)
    points = points[letter | np.append(True, letter[:-1])]  # one blank between words
    points = np.concatenate(([0] if points[0] else [], points, [0] if points[-1] else [])).astype(np.int64)
    one = points[points != 0]
    two = points[:-1] << 21 | points[1:]
    three = (two[:-1] << 21 | points[2:])[points[1:-1] != 0]
    keys = np.concatenate((one, two + (1 << 42), three))  # the shift keeps pairs apart from triples that start with a blank
    keys.sort()
    return keys


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of sorted keys and how often each occurs."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def profile(keys: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams, most frequent first; ties by the n-gram's number."""
    values, n = counted(keys)
    order = np.argsort((n.max() - n) * len(n) + np.arange(len(n)))[:size] if len(n) else np.zeros(0, np.int64)
    return values[order]


class Profiles:
    """All learned profiles as one table of places: a row per n-gram, a column per language."""

    def __init__(self, by_lang: dict[str, list[int]], size: int):
        self.langs, self.size = sorted(by_lang), size
        self.keys = np.unique(np.array([k for v in by_lang.values() for k in v], np.int64))
        self.place = np.full((len(self.keys), len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            self.place[np.searchsorted(self.keys, by_lang[lang]), j] = np.arange(len(by_lang[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language (of equal ones the first by name) and 1 - its distance as a share of the largest possible."""
        own = profile(ngram_keys(text), self.size) if text else ()
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        place = np.where((self.keys[at] == own)[:, None], self.place[at], -1)
        gap = np.where(place < 0, self.size, np.abs(place - np.arange(len(own))[:, None]))
        total = gap.sum(axis=0)
        best = int(total.argmin())
        return self.langs[best], float(1 - total[best] / (len(own) * self.size))


def held_out(id_column: Column) -> Column:
    """Whether crc32 of the id as text leaves the remainder 2 by 4; false for a null id."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = 3000, size: int = 400
) -> Profiles:
    """Profiles of the languages of the labelled rows that are not held out.

    ``train_docs`` bounds the expected sample of each language. A row is in it by a
    hash of its id and its place in the table, so null and repeated ids are sampled
    like others. Every language is learned; a label column of more than ``MOST_LANGS``
    values is no list of languages and raises an error.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGS + 1).collect()}
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not sizes:
        return Profiles({}, size)
    bound = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1_000_000, -(-train_docs * 1_000_000 // n))))))
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(1_000_000)) < F.coalesce(F.try_element_at(bound, F.col("lang")), F.lit(0)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list] = {}

        def merged(lang):
            keys, n = (np.concatenate(x) for x in zip(*parts[lang]))
            values, at = np.unique(keys, return_inverse=True)
            return values, np.bincount(at, n).astype(np.int64)

        for batch in batches:
            pa.default_memory_pool().release_unused()
            for i in range(0, batch.num_rows, 256):
                for text, lang in zip(batch.column(0).slice(i, 256).to_pylist(), batch.column(1).slice(i, 256).to_pylist()):
                    if text:
                        parts.setdefault(lang, []).append(counted(ngram_keys(text)))
                        if len(parts[lang]) > 200:
                            parts[lang] = [merged(lang)]
        for lang in sorted(parts):
            keys, n = merged(lang)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], names=["lang", "key", "n"])

    counts = sample.select("text", "lang").mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))
    top = counts.withColumn("rank", rank).filter(F.col("rank") <= size).collect()
    by_lang: dict[str, list[tuple[int, int]]] = {}
    for r in top:
        by_lang.setdefault(r["lang"], []).append((r["rank"], r["key"]))
    return Profiles({lang: [k for _, k in sorted(v)] for lang, v in by_lang.items()}, size)


def identify(df: DataFrame, model: Profiles, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` of ``df`` with the predicted language and a score from 0 to 1.

    Edge cases: a null text, or one without a letter, is ``und`` with score 0, as
    is every text if no language was learned; equal distances go to the first
    language by name; repeated rows are judged each; an empty table gives an empty
    result. Only the text is an input of the prediction.
    """
    names = [*keep, lang_name, score_name]
    rows = df.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, text_col])))
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), f"`{lang_name}` string", f"`{score_name}` double"])
    at = rows.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pa.default_memory_pool().release_unused()
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [model.predict(t) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=names
                )

    return rows.mapInArrow(predict, schema)


def least_scores(scored: DataFrame, lang_name: str, score_name: str, id_col: str = "doc_id", lang_col: str = "lang", quantile: float = 0.01, slack: float = 0.75) -> dict[str, float]:
    """For each language a score that its texts hardly go below: ``slack`` times the ``quantile`` of its held-out labelled rows.

    Exact on scores in steps of 0.001, so at most a thousand numbers of a language
    reach the driver. A language without such rows has no entry.
    """
    own = scored.filter(held_out(F.col(id_col)) & (F.col(lang_col) == F.col(lang_name)))
    bins = own.groupBy(F.col(lang_name).alias("lang"), F.floor(F.col(score_name) * 1000).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    out = {}
    for lang in {r["lang"] for r in bins}:
        mine = sorted((r["bin"], r["n"]) for r in bins if r["lang"] == lang)
        total, upto = sum(n for _, n in mine), 0
        for at, n in mine:
            upto += n
            if upto >= total * quantile:
                out[lang] = slack * at / 1000
                break
    return out
