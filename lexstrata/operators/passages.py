"""Passages: sentences grouped up to a number of tokens, with the title as the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexstrata.functions.text import is_junk


def chunk(sents: Column, most_tokens: int = 200, most_chunks: int = 4) -> Column:
    """``array<struct<pidx, s0, s1, text>>`` of an ``array<struct<idx, text, ntok>>``: greedy, a chunk ends before it would exceed ``most_tokens``."""
    none = F.array().cast("array<struct<s0:int,s1:int,text:string,ntok:int>>")

    def step(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        fits = (F.size(acc) > 0) & (last["ntok"] + s["ntok"] <= most_tokens)
        alone = F.struct(s["idx"].cast("int").alias("s0"), s["idx"].cast("int").alias("s1"), s["text"].alias("text"), s["ntok"].cast("int").alias("ntok"))
        joined = F.struct(last["s0"].alias("s0"), s["idx"].cast("int").alias("s1"), F.concat_ws(" ", last["text"], s["text"]).alias("text"), (last["ntok"] + s["ntok"]).cast("int").alias("ntok"))
        head = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(fits, F.concat(head, F.array(joined))).otherwise(F.concat(acc, F.array(alone)))

    done = F.slice(F.aggregate(sents, none, step), 1, most_chunks)
    return F.transform(done, lambda x, i: F.struct((i + 1).alias("pidx"), x["s0"].alias("s0"), x["s1"].alias("s1"), x["text"].alias("text")))


def passages(docs: DataFrame, sents: Column, most_tokens: int = 200, most_chunks: int = 4) -> DataFrame:
    """``doc_id, pidx, s0, s1, text, nchars, junk``; the title is pidx 0 with s0 = s1 = -1."""
    title = F.struct(F.lit(0).alias("pidx"), F.lit(-1).alias("s0"), F.lit(-1).alias("s1"), F.coalesce("title", F.lit("")).alias("text"))
    every = F.filter(F.concat(F.array(title), chunk(sents, most_tokens, most_chunks)), lambda x: x["text"] != "")
    rows = docs.select("doc_id", "lang", F.explode(every).alias("p")).select("doc_id", "lang", "p.*")
    cjk = F.coalesce(F.col("lang").isin("zh", "ko", "ja"), F.lit(False))
    return rows.select("doc_id", "pidx", "s0", "s1", "text", F.length("text").alias("nchars"), is_junk(F.col("text"), cjk).alias("junk"))
