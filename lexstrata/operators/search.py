"""The search language: grammar, compilation to Columns, the token index, hits, context, facets and ranking.

Queries are words, "phrases", prefix*, AND (or nothing), OR, NOT, NEAR/n and
parentheses. A query without any operator is one phrase. The driver turns it into
a tree; a tree becomes a boolean Column, so Catalyst sees an ordinary filter, and
an upper bound over the token index, so that only candidates are read in full.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexstrata.functions.arrays import let, match_spans, running
from lexstrata.functions.text import CJK, NORM_FROM, NORM_TO, fold_text, index_terms, norm
from lexstrata.sources.shared import saved, small

Stem = Callable[[str], str]

#: How tightly the operators bind. Two operands side by side are joined by AND.
BINDING = {"OR": 1, "AND": 2, "NOT": 3, "NEAR": 4}
#: Words between terms where NEAR gives no number, and how many word starts more it allows.
NEAR_WORDS, NEAR_SLACK = 10, 4
WORD = "[\\p{L}\\p{N}\\p{M}_]"
GAP = "[^\\p{L}\\p{N}\\p{M}_]"
_LEXEME = re.compile(r'\s*(?:(?P<paren>[()])|"(?P<quoted>[^"]*)"(?P<open>\*?)|(?P<op>AND|OR|NOT|NEAR(?:/(?P<n>\d+))?)(?=[\s()"]|$)|(?P<word>[^\s()"]+))')
_CJK = re.compile(f"[{CJK}]".encode().decode("unicode_escape"))
_TO_NORM = str.maketrans(NORM_FROM, NORM_TO)


@dataclass(frozen=True)
class Term:
    """A word or phrase; ``stems`` has a word's stem where a stemmer shortened it, else the word."""

    text: str
    prefix: bool = False
    stems: tuple[str, ...] = field(default=(), compare=False)

    @property
    def words(self) -> tuple[str, ...]:
        return tuple(re.findall(r"\w+", self.text.lower()))

    @property
    def cjk(self) -> bool:
        return bool(_CJK.search(self.text))

    @property
    def parts(self) -> list[tuple[str, bool]]:
        """Each word (or its stem) in lower case and whether more letters may follow."""
        own = [(s, s != w) for w, s in zip(self.words, self.stems or self.words)]
        return [(w, longer or (self.prefix and i == len(own) - 1)) for i, (w, longer) in enumerate(own)]

    @property
    def pattern(self) -> str:
        """For normalised texts in lower case: whole words in sequence, but CJK letters anywhere."""
        words = [re.escape(w) + (WORD + "*" if longer else "") for w, longer in self.parts]
        if self.cjk:
            return (GAP + "*").join(words)
        last = "" if self.parts and self.parts[-1][1] else f"(?!{WORD})"
        return f"(?<!{WORD})" + (GAP + "+").join(words) + last

    @property
    def regex(self) -> str:
        """The pattern for normalised texts in any case."""
        return "(?iu)" + self.pattern


@dataclass(frozen=True)
class Node:
    """``kind`` is term, and, or, not, near; ``n`` the distance of near."""

    kind: str
    items: tuple
    n: int = 0


#: Common endings of Russian words; the longest that fits comes off.
ENDINGS = "иями ями ами ого ему ому ыми ими ией иях ов ев ей ой ий ый ая яя ое ее ые ие ам ям ах ях ом ем ую юю а я о е ы и у ю ь".split()


def suffix_stem(word: str) -> str:
    """A small stemmer for Russian words: an ending off, at least 4 letters left. Any callable can take its place."""
    ends = [e for e in ENDINGS if word.endswith(e) and len(word) - len(e) >= 4]
    return word[: -len(max(ends, key=len))] if ends else word


@dataclass(frozen=True)
class Forms:
    """Expansion of a word by a table of its forms: forms that share their first letters become a prefix, others keep the stem of the stemmer."""

    table: dict[str, tuple[str, ...]]
    otherwise: Stem = suffix_stem
    least: int = 4

    def __call__(self, word: str) -> str:
        forms = self.table.get(word)
        if not forms:
            return self.otherwise(word)
        shared = word
        for form in forms:
            shared = shared[: next((i for i, (a, b) in enumerate(zip(shared, form)) if a != b), min(len(shared), len(form)))]
        return shared if len(shared) >= self.least else word


def term(text: str, prefix: bool = False, stem: Stem | None = None) -> Term:
    """A term; with ``stem``, its Cyrillic words of 4 letters or more also match by their stem."""
    plain = Term(text.translate(_TO_NORM).strip(), prefix)
    if stem is None:
        return plain
    return Term(plain.text, prefix, tuple(stem(w) if len(w) >= 4 and re.search("[а-я]", w) else w for w in plain.words))


def _lexemes(query: str) -> list[tuple[str, object]]:
    """Kind and value: ``term`` (text, prefix), an operator (its number for NEAR) or a parenthesis."""
    out, at, query = [], 0, query.strip()
    while at < len(query):
        m = _LEXEME.match(query, at)
        if m is None:
            raise ValueError(f"a quotation mark at {query[at:]!r} is not closed")
        at = m.end()
        if m["paren"]:
            out.append((m["paren"], None))
        elif m["op"]:
            out.append((m["op"].partition("/")[0], int(m["n"] or NEAR_WORDS)))
        elif m["quoted"] is not None:
            out.append(("term", (m["quoted"], bool(m["open"]))))
        else:
            out.append(("term", (m["word"].rstrip("*"), m["word"].endswith("*"))))
    return out


def _joined(kind: str, n: int, left: Node, right: Node) -> Node:
    """One tree of two; AND and OR of the same kind become one node with more items."""
    if kind == "NEAR":
        if left.kind not in ("term", "near") or right.kind != "term":
            raise ValueError("NEAR joins terms only")
        return Node("near", (*left.items, *right.items), n)
    if kind == "NOT":
        return Node("not", (left, right))
    kind = kind.lower()
    spread = lambda x: x.items if x.kind == kind else (x,)
    return Node(kind, (*spread(left), *spread(right)))


def parse(query: str, stem: Stem | None = None) -> Node:
    """The query's tree by operator precedence, with a stack of operands and one of operators; ValueError if it cannot be read."""
    lexemes = _lexemes(query)
    if not lexemes:
        raise ValueError("the query is empty")
    if '"' not in query and all(kind == "term" and not value[1] for kind, value in lexemes):
        return Node("term", (term(" ".join(value[0] for _, value in lexemes), stem=stem),))
    operands: list[Node] = []
    waiting: list[tuple[str, int]] = []

    def settle(binding: int) -> None:
        """Join what waits for an operator that binds less tightly."""
        while waiting and BINDING.get(waiting[-1][0], 0) >= binding:
            kind, n = waiting.pop()
            right, left = operands.pop(), operands.pop()
            operands.append(_joined(kind, n, left, right))

    after_operand = False
    for kind, value in lexemes:
        if after_operand and kind in ("term", "("):
            settle(BINDING["AND"])
            waiting.append(("AND", 0))
            after_operand = False
        if kind == "term" and not after_operand:
            operands.append(Node("term", (term(*value, stem),)))
            after_operand = True
        elif kind == "(":
            waiting.append((kind, 0))
        elif kind == ")" and after_operand:
            settle(1)
            if not waiting:
                raise ValueError("a ) has no (")
            waiting.pop()
        elif kind in BINDING and after_operand:
            settle(BINDING[kind])
            waiting.append((kind, value))
            after_operand = False
        else:
            raise ValueError(f"{kind} stands where a term is due")
    if not after_operand:
        raise ValueError("a term is due at the end")
    settle(1)
    if waiting:
        raise ValueError("a ( has no )")
    return operands[0]


def terms_of(node: Node, positive: bool = False) -> list[Term]:
    """The query's terms from left to right; with ``positive``, without what NOT takes away."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, Term):
            out.append(x)
        else:
            todo += reversed(x.items[:1] if positive and x.kind == "not" else x.items)
    return out


def word_starts(text: Column, pattern: str) -> Column:
    """For each match, how many words start at or before it (NEAR counts in words)."""
    words = lambda s: F.regexp_count(s, F.lit(f"(?<!{WORD}){WORD}+")).cast("long")

    def places(hits: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), words)
        own = F.transform(hits, words)
        return let(gaps, lambda g: F.zip_with(g, running(F.zip_with(g, own, lambda a, b: a + b)), lambda a, before: before + a + 1))

    return let(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), places)


def _term_holds(t: Term, text: Column) -> Column:
    """The longest word is looked for first, which is cheap; the pattern runs on texts that have it."""
    longest = max((w for w, _ in t.parts), key=len, default="")
    return text.contains(longest) & text.rlike(t.pattern)


def compile_query(node: Node, text: Column) -> Column:
    """The tree as a condition on a normalised text (any case)."""

    def holds(x: Node, low: Column) -> Column:
        if x.kind == "term":
            return _term_holds(x.items[0], low)
        if x.kind == "near":
            return _all([_term_holds(t, low) for t in x.items]) & let(F.array(*(word_starts(low, t.pattern) for t in x.items)), lambda at: F.exists(at[0], lambda p: _all([F.exists(at[i], lambda q: F.abs(p - q) <= x.n + NEAR_SLACK) for i in range(1, len(x.items))])))
        parts = [holds(y, low) for y in x.items]
        if x.kind == "not":
            return parts[0] & ~parts[1]
        return _all(parts) if x.kind == "and" else ~_all([~p for p in parts])

    return let(F.lower(text), lambda low: holds(node, low))


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0] if conditions else F.lit(True)
    for c in conditions[1:]:
        out = out & c
    return out


def searchable(title: Column, text: Column) -> Column:
    """What conditions are evaluated on."""
    return norm(F.concat_ws("\n", title, text))


def filters(country: Sequence[str] = (), source: Sequence[str] = (), lang: Sequence[str] = (), date_from: str = "", date_to: str = "", not_source: Sequence[str] = ()) -> Column:
    """Metadata conditions that reach the scan; countries are upper-cased, empty ones hold always, dates are inclusive."""
    out = F.lit(True)
    for name, values in (("country", [c.upper() for c in country]), ("source", source), ("lang", lang)):
        if any(values):
            out &= F.col(name).isin([v for v in values if v])
    if any(not_source):
        out &= ~F.col("source").isin(list(not_source))
    if date_from:
        out &= F.col("date") >= F.lit(date_from).cast("date")
    if date_to:
        out &= F.col("date") <= F.lit(date_to).cast("date")
    return out


@dataclass(frozen=True)
class Plan:
    """How a query is answered: by words, by CJK characters, by a scan, or by a union of branches."""

    route: str
    tree: Node
    branches: tuple[Node, ...] = ()


def plan_query(query: str, stem: Stem | None = None) -> Plan:
    """Words go to the word condition; short CJK terms to a scan of CJK languages; an OR of both kinds to a union."""
    tree = parse(query, stem)

    def route(node: Node) -> str:
        kinds = {"scan" if t.cjk and len(t.text) < 3 else "cjk" if t.cjk else "words" for t in terms_of(node)}
        return "scan" if "scan" in kinds else kinds.pop() if len(kinds) == 1 else "scan"

    if tree.kind == "or" and len({route(x) for x in tree.items}) > 1:
        return Plan("union", tree, tree.items)
    return Plan(route(tree), tree)


def token_index(docs: DataFrame, key: str = "doc_id", tokens: Sequence[str] | None = None) -> DataFrame:
    """The index over titles and texts, written to the shared folder: ``token, doc, tf`` and, under the empty token, each document's length.

    One pass over the texts. A document's terms are combined by the task that reads
    it; (token, document) deals the rest, so frequent tokens are spread. Files hold
    sorted tokens, so a query's tokens prune pages by their statistics. With
    ``tokens``, only rows of these and the lengths leave the pass: what one query
    needs, without a shuffle of every token.
    """
    wanted = F.col("t") if tokens is None else F.filter("t", lambda x: x.isin(list(tokens)))
    one = F.transform(wanted, lambda x: F.struct(x.alias("token"), F.lit(1).cast("long").alias("k")))
    size = F.array(F.struct(F.lit("").alias("token"), F.size("t").cast("long").alias("k")))
    rows = docs.select(F.col(key).alias("doc"), index_terms(F.concat_ws("\n", "title", "text")).alias("t")).select("doc", F.inline(F.concat(size, one)))
    counts = rows.groupBy("token", "doc").agg(F.sum("k").alias("tf"))
    return saved(counts.sortWithinPartitions("token", "doc"), "token-index")


def index_words(t: Term) -> list[tuple[str, bool]]:
    """A term's tokens in the index and whether longer ones count too; empty if the index cannot say anything about it."""
    out = []
    for word, longer in t.parts:
        for run in re.findall(f"[{_CJK.pattern[1:-1]}]+|[^\\W_{_CJK.pattern[1:-1]}]+", fold_text(word)):
            if _CJK.match(run):
                out += [(run[i : i + 2], False) for i in range(len(run) - 1)] or [(run, False)]
            elif not re.fullmatch(r"\d{5,}", run) and not t.cjk:
                out.append((run, longer))
    return list(dict.fromkeys(out))


def candidates(index: DataFrame, node: Node) -> DataFrame | None:
    """``doc`` of every document that can match, by one filtered scan of the index and one grouping; None if the index can't tell.

    What NOT takes away is left to the exact condition, as are word order and distance.
    """
    wanted: dict[tuple[str, bool], int] = {}

    def bound(x: Node | Term) -> Column | None:
        if isinstance(x, Term):
            flags = [F.col(f"f{wanted.setdefault(w, len(wanted))}") for w in index_words(x)]
            return _all(flags) if flags else None
        parts = [bound(y) for y in (x.items[:1] if x.kind == "not" else x.items)]
        if x.kind == "or":
            return None if any(p is None for p in parts) else ~_all([~p for p in parts])
        known = [p for p in parts if p is not None]
        return _all(known) if known else None

    condition = bound(node)
    if condition is None:
        return None
    token = F.col("token")
    is_one = {w: token.startswith(w[0]) if w[1] else token == w[0] for w in wanted}
    rows = index.filter(~_all([~c for c in is_one.values()]) & (token != ""))
    flagged = rows.groupBy("doc").agg(*(F.bool_or(is_one[w]).alias(f"f{i}") for w, i in wanted.items()))
    return flagged.filter(condition).select("doc")


def search(docs: DataFrame, query: str, where: Column | None = None, stem: Stem | None = None, index: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Matching documents; each branch of a union runs on its own and the first copy of an id stays.

    With ``index`` (of ``token_index``), only documents that can match are read in
    full; the exact condition then decides. Without it every text is read.
    """
    plan = plan_query(query, stem)
    rows = docs if where is None else docs.filter(where)

    def run(node: Node) -> DataFrame:
        own, found = rows, candidates(index, node) if index is not None else None
        if any(t.cjk for t in terms_of(node, True)):
            own = own.filter(F.col("lang").isin("zh", "ko", "ja"))
        if found is not None:
            own = own.join(small(found.withColumnRenamed("doc", key)), key, "left_semi")
        return own.filter(compile_query(node, searchable(F.col("title"), F.col("text"))))

    if plan.route != "union":
        return run(plan.tree)
    out = run(plan.branches[0])
    for b in plan.branches[1:]:
        out = out.unionByName(run(b))
    return out.dropDuplicates(["id"])


def _any_term(node: Node) -> str:
    """One pattern of all positive terms; of those that start at the same place the one of fewer words is tried first."""
    terms = sorted(set(terms_of(node, True)), key=lambda t: (len(t.words), len(t.text), t.text))
    return "(?iu)" + "|".join(t.pattern for t in terms)


def hit_spans(text: Column, node: Node) -> Column:
    """Spans ``struct<s, e>`` (in characters) of the positive terms in start order; one that starts inside the one before is left out."""
    return match_spans(norm(text), _any_term(node))


def hits(node: Node, *texts: Column) -> Column:
    """How many spans the texts have."""
    counts = [F.regexp_count(norm(t), F.lit(_any_term(node))) for t in texts]
    out = counts[0]
    for c in counts[1:]:
        out = out + c
    return out


def hit_rows(docs: DataFrame, node: Node, keep: Sequence[str] = ("doc_id", "date", "country", "source"), width: int = 110) -> DataFrame:
    """One row per hit for export: the ``keep`` columns, ``field`` (title or text), ``no`` from 1, and the hit with its context."""
    parts = []
    for name in ("title", "text"):
        spans = docs.select(*keep, F.coalesce(name, F.lit("")).alias("__t")).select("*", F.posexplode(hit_spans(F.col("__t"), node)).alias("no", "x"))
        parts.append(spans.select(*keep, F.lit(name).alias("field"), (F.col("no") + 1).alias("no"), kwic(F.col("__t"), F.col("x.s"), F.col("x.e"), width).alias("k")).select(*keep, "field", "no", "k.*"))
    return parts[0].unionByName(parts[1])


def with_hits(found: DataFrame, node: Node, most: int = 5000) -> DataFrame:
    """Adds ``hits``; null for every row if more than ``most`` documents were found."""
    few = found.limit(most + 1).count() <= most
    return found.withColumn("hits", hits(node, F.col("title"), F.col("text")) if few else F.lit(None).cast("int"))


def kwic(text: Column, start: Column, end: Column, width: int = 110) -> Column:
    """``struct<left, hit, right>`` around a span (0-based), trimmed to words, white space flattened."""
    flat = lambda x: F.regexp_replace(x, "\\s+", " ")
    a, b = F.greatest(start - width, F.lit(0)), F.least(end + width, F.length(text))
    left, right = F.substr(text, a + 1, start - a), F.substr(text, end + 1, b - end)
    sp = F.instr(left, " ")
    left = F.when(a > 0, F.concat(F.lit("…"), F.when(sp.between(1, 25), F.substr(left, sp + 1)).otherwise(left))).otherwise(left)
    back = F.instr(F.reverse(right), " ")
    right = F.when(b < F.length(text), F.concat(F.when(back.between(1, 24), F.substr(right, F.lit(1), F.length(right) - back)).otherwise(right), F.lit("…"))).otherwise(right)
    return F.struct(flat(left).alias("left"), flat(F.substr(text, start + 1, end - start)).alias("hit"), flat(right).alias("right"))


def snippets(docs: DataFrame, node: Node, most: int = 3) -> DataFrame:
    """Adds ``snips``: context of the first hits in the text, or in the title if the text has none."""
    rows = docs.withColumn("__t", hit_spans(F.col("text"), node)).withColumn("__h", hit_spans(F.col("title"), node))
    cut = lambda text, spans: F.transform(F.slice(spans, 1, most), lambda x: kwic(F.col(text), x["s"], x["e"]))
    return rows.withColumn("snips", F.when(F.size("__t") > 0, cut("text", "__t")).otherwise(cut("title", "__h"))).drop("__t", "__h")


def bucket(by: str) -> Column:
    """The key of ``count_by``."""
    if by in ("week", "month", "year"):
        return F.date_format(F.date_trunc(by, "date"), {"week": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[by])
    return F.col(by)


def count_by(found: DataFrame, by: str, hits_col: str = "hits") -> DataFrame:
    """``bucket, docs, hits`` of matching documents."""
    return found.groupBy(bucket(by).alias("bucket")).agg(F.count(F.lit(1)).alias("docs"), F.sum(hits_col).alias("hits"))


def facets(docs: DataFrame) -> DataFrame:
    """``facet, value, n, first, last`` for country, source, lang and all, in one pass."""
    sets = F.explode(F.array(*(F.struct(F.lit(k).alias("facet"), F.col(k).alias("value")) for k in ("country", "source", "lang")), F.struct(F.lit("all").alias("facet"), F.lit("").alias("value"))))
    return docs.select("date", sets.alias("x")).groupBy("x.facet", "x.value").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


def page(found: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Newest first; ties by the larger id."""
    return found.orderBy(F.desc("date"), F.desc("doc_id")).offset(offset).limit(limit)


def match_all(posts: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Documents that hold every token: a filtered group-by instead of a chain of joins."""
    wanted = list(dict.fromkeys(tokens))
    return posts.filter(F.col("token").isin(wanted)).groupBy("doc").agg(F.count_distinct("token").alias("k")).filter(F.col("k") == len(wanted)).select("doc")


def bm25(index: DataFrame, tokens: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``doc, score`` of documents that hold any of the tokens, from the token index; the usual constants.

    The lengths (rows of the empty token) and the query's tokens are all that is read.
    """
    wanted = list(dict.fromkeys(tokens))
    lengths = index.filter(F.col("token") == "").select("doc", F.col("tf").alias("len"))
    whole = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean_len")).first()
    tf = index.filter(F.col("token").isin(wanted) & (F.col("token") != ""))
    df = {r["token"]: r["df"] for r in tf.groupBy("token").agg(F.count(F.lit(1)).alias("df")).collect()}  # a row per query token
    if not df:
        return tf.select("doc", F.lit(0.0).alias("score"))
    of = F.create_map(*(x for t, n in sorted(df.items()) for x in (F.lit(t), F.lit(n))))[F.col("token")]
    idf = F.log(1 + (F.lit(whole["n"]) - of + 0.5) / (of + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(whole["mean_len"])))
    return tf.join(lengths, "doc").groupBy("doc").agg(F.sum(part).alias("score"))


def term_report(docs: DataFrame, terms: Sequence[tuple[str, str]]) -> tuple[DataFrame | None, dict[str, str]]:
    """``label, doc_id, date, country, hits`` of each labelled query in one scan, and the queries that cannot be read."""
    good, bad = [], {}
    for label, q in terms:
        try:
            good.append((label, parse(q, suffix_stem if re.search("[А-Яа-яЁё]", q) else None)))
        except ValueError as e:
            bad[label] = str(e)
    if not good:
        return None, bad
    text = searchable(F.col("title"), F.col("text"))
    found = F.explode(F.array_compact(F.array(*(F.when(compile_query(n, text), F.struct(F.lit(label).alias("label"), hits(n, F.col("title"), F.col("text")).cast("long").alias("hits"))) for label, n in good))))
    return docs.select("doc_id", "date", "country", "source", found.alias("x")).select("x.label", "doc_id", "date", "country", "source", "x.hits"), bad


def report_totals(found: DataFrame) -> DataFrame:
    """``label, docs, hits, first, last`` of a term report, and under the label null those of all distinct documents."""
    by_label = found.groupBy("label").agg(F.count_distinct("doc_id").alias("docs"), F.sum("hits").alias("hits"), F.min("date").alias("first"), F.max("date").alias("last"))
    whole = found.agg(F.count_distinct("doc_id").alias("docs"), F.sum("hits").alias("hits"), F.min("date").alias("first"), F.max("date").alias("last"))
    return by_label.unionByName(whole.withColumn("label", F.lit(None).cast("string")))


def read_terms(lines: Sequence[str]) -> list[tuple[str, str, str]]:
    """``(group, label, query)`` of a term file: ``## group`` lines, ``label | query`` lines, # comments."""
    out, group = [], ""
    for line in (x.strip() for x in lines):
        if line.startswith("##"):
            group = line[2:].strip()
        elif line and not line.startswith("#"):
            label, _, q = line.partition("|")
            out.append((group, label.strip(), (q or label).strip()))
    return out


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each group."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("__rank") <= k).drop("__rank")


def verbatim(docs: DataFrame, phrases: DataFrame, key: str = "doc_id", item: str = "item_id", needle: str = "needle", broadcast_rows: int = 1_000_000) -> DataFrame:
    """``key, item`` where a document's text contains a phrase, for tables of any size.

    A phrase's inner words (all but the first and last) are whole words of a text that
    contains it; the longest is the join key, so only texts with that word are
    searched. Phrases without an inner word (few words) are searched in every text.
    """
    words = lambda c: F.split(c, "\\s+")
    inner = F.slice(words(F.col(needle)), F.lit(2), F.greatest(F.size(words(F.col(needle))) - 2, F.lit(0)))
    longest = F.element_at(F.array_sort(F.transform(inner, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)
    rows = phrases.filter(F.coalesce(F.col(needle), F.lit("")) != "").select(item, needle, F.when(F.size(inner) > 0, longest["w"]).alias("anchor"))
    long, short = rows.filter("anchor IS NOT NULL"), rows.filter("anchor IS NULL")
    n = rows.groupBy(F.col("anchor").isNull().alias("short")).agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = {r["short"]: r["n"] for r in n}
    side = F.broadcast(long) if sizes.get(False, 0) <= broadcast_rows else long.hint("merge")
    texts = docs.select(key, "text", F.explode(F.array_distinct(words(F.col("text")))).alias("anchor"))
    found = texts.join(side, "anchor").filter(F.contains("text", needle)).select(key, item)
    if sizes.get(True, 0):
        found = found.unionByName(docs.select(key, "text").join(F.broadcast(short) if sizes[True] <= 10_000 else short, F.contains("text", needle)).select(key, item))
    return found
