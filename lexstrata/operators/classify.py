"""Rule ladders: kinds, speakers, signals and tags by ordered regular expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ladder(text: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first pattern that is found; case-insensitive, Unicode."""
    out = None
    for regex, label in rules:
        hit = F.coalesce(text, F.lit("")).rlike("(?iU)" + regex)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def tags(text: Column, rules: Sequence[tuple[str, str]], other: str = "Other / General") -> Column:
    """All labels whose pattern is found, joined in order; ``other`` if none is."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(text, F.lit("")).rlike("(?iU)" + r), label) for r, label in rules)))
    return F.coalesce(F.nullif(F.array_join(F.array_distinct(found), "; "), F.lit("")), F.lit(other))


def phrases_in(text: Column, phrases: Sequence[str]) -> Column:
    """Which fixed phrases a text has."""
    return F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(F.lower(text), F.lower(p)))


def signal(sentence: Column, lang: Column, warn: dict[str, str], allude: dict[str, str], question: dict[str, str]) -> Column:
    """``W`` if the language's warning pattern is found, else ``A`` for an allusion; questions give none."""
    of = lambda rules: _any([(lang == k) & sentence.rlike("(?iU)" + r) for k, r in rules.items()])
    asks = of(question) | F.trim(sentence).rlike("[?？؟][\"'”»)]*$")
    return F.when(asks, F.lit(None)).when(of(warn), "W").when(of(allude), "A")


def _any(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out |= c
    return out


def priority_group(text: Column, groups: Sequence[tuple[str, str]]) -> Column:
    """Name of the first group with a hit; null without one."""
    return ladder(text, [(r, n) for n, r in groups])


def first_context(text: Column, regex: str, width: int = 80) -> Column:
    """The surroundings of the first hit; null without one."""
    at = F.regexp_instr(text, F.lit("(?iU)" + regex))
    return F.when(at > 0, F.substr(text, F.greatest(at - width, F.lit(1)), F.lit(2 * width)))


def two_steps(rows: DataFrame, text: str, cheap: Sequence[str], exact: Column) -> DataFrame:
    """Rows that meet ``exact``, tried only where one of some plain words occurs."""
    return rows.filter(_any([F.contains(F.lower(F.col(text)), F.lit(w.lower())) for w in cheap]) & exact)


def strip_tails(text: Column, tails: Sequence[str], notices: Sequence[str] = ()) -> tuple[Column, Column]:
    """The text up to the first boilerplate tail, and whether a paywall notice cut it."""
    cut = text
    for t in [*notices, *tails]:
        cut = F.split(cut, "(?iU)" + t, 2)[0]
    return F.rtrim(cut), _any([F.coalesce(text, F.lit("")).rlike("(?iU)" + n) for n in notices])


def labelled_paragraphs(paras: DataFrame, key: str, order: str, text: str, label: str) -> DataFrame:
    """Paragraphs with the speaker label that holds for them: a label stays in force until the next."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = F.nullif(F.regexp_extract(text, label, 1), F.lit(""))
    return paras.withColumn("speaker", F.last(own, True).over(w)).withColumn(text, F.regexp_replace(text, label, ""))


def own_words(labelled: DataFrame, key: str, order: str, text: str, speaker: str) -> DataFrame:
    """One speaker's paragraphs of each key, joined."""
    rows = labelled.filter(F.col("speaker") == speaker)
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n").alias("own_text"))
