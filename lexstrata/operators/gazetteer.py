"""Target mentions: patterns by language with vetoes, and stance and salience built on them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexstrata.functions.arrays import let, match_spans

#: Fixed value: the dateline of Chinese wire services, which names a place and no target.
ZH_DATELINE = "(?:新华社|中新社|新华网|人民网|央视新闻|总台记者)[^，。（(]{0,12}?\\d{1,2}月\\d{1,2}日(?:电|讯)"
DATELINES = {"zh": ZH_DATELINE}
#: A veto counts within so many characters around a match.
REACH = 30


@dataclass(frozen=True)
class Pattern:
    """A case-sensitive pattern of a target in a language; a match that overlaps a veto's doesn't count."""

    target: str
    lang: str
    regex: str
    veto: str | None = None
    country: str | None = None


#: Patterns of five states that a gazetteer may lack, by language.
SUPPLEMENT = (
    Pattern("CANADA", "en", r"\bCanad(?:a|ian|ians)\b|\bOttawa\b"), Pattern("CANADA", "zh", "加拿大|渥太华"),
    Pattern("GERMANY", "en", r"\bGerman(?:y|s)?\b|\bBerlin\b"), Pattern("GERMANY", "zh", "德国|柏林"),
    Pattern("FRANCE", "en", r"\bFrance\b|\bFrench\b|\bParis\b"), Pattern("FRANCE", "zh", "法国|巴黎"),
    Pattern("NETHERLANDS", "en", r"\bNetherlands\b|\bDutch\b|\bThe Hague\b"), Pattern("NETHERLANDS", "zh", "荷兰|海牙"),
    Pattern("NEW_ZEALAND", "en", r"\bNew Zealand\b|\bWellington\b"), Pattern("NEW_ZEALAND", "zh", "新西兰|惠灵顿"),
)


def spread(pattern: str) -> str:
    """The pattern with Unicode classes for the JVM."""
    return "(?U)" + pattern


def readable(pattern: str, boilerplate: Iterable[str] = ()) -> str:
    """A pattern's source without the given parts, longest first: its name in audits."""
    for part in sorted(boilerplate, key=len, reverse=True):
        pattern = pattern.replace(part, "")
    return pattern


def holds(text: Column, p: Pattern) -> Column:
    """Whether the text has a match that no veto near it overlaps."""
    found = text.rlike(spread(p.regex))
    if p.veto is None:
        return found
    apart = lambda m, v: (v["e"] <= m["s"]) | (v["s"] >= m["e"]) | (v["s"] < m["s"] - REACH) | (v["e"] > m["e"] + REACH)
    free = let(match_spans(text, spread(p.veto)), lambda vs: F.exists(match_spans(text, spread(p.regex)), lambda m: F.forall(vs, lambda v: apart(m, v))))
    return found & F.when(text.rlike(spread(p.veto)), free).otherwise(F.lit(True))


def mentions(sents: DataFrame, patterns: Iterable[Pattern], text: str = "sent", default_lang: str = "en", datelines: Mapping[str, str] = DATELINES) -> DataFrame:
    """Adds a row per pattern that a sentence matches: ``target, pat, self`` (own country).

    A sentence is tried with the patterns of its language (unknown ones with those of
    ``default_lang``), and only if their union matches. Datelines are blanked first.
    """
    patterns = list(patterns)
    by_lang: dict[str, list[tuple[int, Pattern]]] = {}
    for i, p in enumerate(patterns):
        by_lang.setdefault(p.lang, []).append((i, p))
    none = F.array().cast("array<struct<target:string,pat:int,self:boolean>>")
    lang = F.when(F.col("lang").isin(sorted(by_lang)), F.col("lang")).otherwise(default_lang)

    def matcher(own: list[tuple[int, Pattern]]):
        """The marks of a language's patterns that a text matches."""
        union = spread("|".join(f"(?:{p.regex})" for _, p in own))
        mark = lambda i, p: F.struct(F.lit(p.target).alias("target"), F.lit(i).alias("pat"), (F.coalesce("country", F.lit("")) == F.lit(p.country or "")).alias("self"))
        return lambda t: F.when(t.rlike(union), F.array_compact(F.array(*(F.when(holds(t, p), mark(i, p)) for i, p in own)))).otherwise(none)

    found = none
    for code, own in by_lang.items():
        masked = F.regexp_replace(text, spread(datelines[code]), " ") if code in datelines else F.col(text)
        found = F.when(lang == code, let(F.coalesce(masked, F.lit("")), matcher(own))).otherwise(found)
    return sents.withColumn("__m", F.explode(found)).select(*sents.columns, "__m.*")


def stance(found: DataFrame, scores: DataFrame, dims: Iterable[str]) -> DataFrame:
    """Mean scores of a document's sentences that mention a target (own targets left out): ``doc_id, target, n`` and the dims from 0 to 1.

    A sentence counts once for a target, whichever patterns hit it.
    """
    pairs = found.filter(~F.col("self")).select("doc_id", "idx", "target").distinct()
    rows = pairs.join(scores, ["doc_id", "idx"])
    return rows.groupBy("doc_id", "target").agg(F.count(F.lit(1)).alias("n"), *((F.avg(d) / 1000).alias(d) for d in dims))


def pattern_audit(found: DataFrame, n_patterns: int) -> DataFrame:
    """Per pattern: sentences, documents, share of own mentions, and the up to 6 commonest countries."""
    rows = found.groupBy("pat", "country").agg(F.count_distinct("doc_id", "idx").alias("s"), F.count_distinct("doc_id").alias("d"), F.count_if("self").alias("o"))
    top = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("k"), "country"))), 1, 6), lambda x: x["country"])
    return rows.groupBy("pat").agg(F.sum("s").alias("sentences"), F.sum("d").alias("docs"), (F.sum("o") / F.sum("s")).alias("self_share"), F.array_join(top, ",").alias("countries")).filter(F.col("pat") < n_patterns)


def in_scope(idx: Column, text: Column, mentioned: Column, lang: Column) -> Column:
    """Sentences to be scored: the first 80 or mentioning ones, of the first 400, at least 15 characters (6 in CJK)."""
    least = F.when(lang.isin("zh", "ko", "ja"), 6).otherwise(15)
    return ((idx < 80) | mentioned) & (idx < 400) & (F.length(text) >= least)


def stance_and_salience(found: DataFrame, scores: DataFrame, dims: Iterable[str], ids: DataFrame | None = None) -> DataFrame:
    """Each document's targets with their mean scores (null if no scored sentence mentions them) and ``k`` = 1; only documents of ``ids`` if given."""
    own = found.filter(~F.col("self")) if ids is None else found.filter(~F.col("self")).join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    salience = own.select("doc_id", "target").distinct().withColumn("k", F.lit(1))
    return stance(own, scores, dims).join(salience, ["doc_id", "target"], "full_outer")


def mention_counts(found: DataFrame, keys: Iterable[str]) -> DataFrame:
    """``keys, docs, first, last``: distinct documents and dates of each combination, as term scans report them."""
    return found.groupBy(*keys).agg(F.count_distinct("doc_id").alias("docs"), F.min("date").alias("first"), F.max("date").alias("last"))
