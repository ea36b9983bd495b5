"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexstrata.functions.arrays import let

#: Letters and digits that count as one (always one character to one).
NORM_FROM = "ёЁيىكۀة" + "٠١٢٣٤٥٦٧٨٩" + "۰۱۲۳۴۵۶۷۸۹"
NORM_TO = "еЕییکهه" + "0123456789" + "0123456789"

#: Character ranges of Chinese, Japanese and Korean.
CJK = "\\u1100-\\u11ff\\u3040-\\u30ff\\u3130-\\u318f\\u3400-\\u4dbf\\u4e00-\\u9fff\\uac00-\\ud7af\\uf900-\\ufaff"

#: A sentence ends after .!?… (closing marks belong to the gap) before a capital, digit, Arabic or CJK letter, or after a CJK end mark.
SENTENCE_END = (
    "(?<=[.!?…])[\"'”»)\\]]*\\s+(?=[\"'“«(\\[¿¡]?[A-ZÀ-ÖØ-ÞĞİŞА-ЯЁ0-9\\u0600-\\u06ff\\u3400-\\u9fff\\uac00-\\ud7af])|(?<=[。！？；])"
)

#: Latin letters with marks and their base letters, made from Unicode decompositions.
def _marks() -> tuple[str, str]:
    import unicodedata

    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)))]
    pairs = [(a, b) for a, b in pairs if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def norm(text: Column) -> Column:
    """Variant letters and digits folded; the length never changes, so offsets stay valid. Null gives empty."""
    return F.translate(F.coalesce(text, F.lit("")), NORM_FROM, NORM_TO)


def fold(text: Column) -> Column:
    """``norm``, lower case and base letters of marked ones; Hangul syllables stay whole. ASCII texts are only lower-cased."""
    a, b = _marks()
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) > F.length(t), F.translate(F.lower(norm(t)), a, b)).otherwise(F.lower(t))


def fold_text(text: str) -> str:
    """``fold`` of a driver's string."""
    a, b = _marks()
    return text.translate(str.maketrans(NORM_FROM, NORM_TO)).lower().translate(str.maketrans(a, b))


def has_cjk(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(f"[{CJK}]")


def _rfind(text: Column, mark: str) -> Column:
    """0-based last place of ``mark``, -1 if none."""
    at = F.instr(F.reverse(text), F.lit(mark[::-1]))
    return F.when(at == 0, -1).otherwise(F.length(text) - at - len(mark) + 1)


def cut_long(piece: Column, limit: int) -> Column:
    """Parts of at most ``limit`` characters: cut after the last comma-like mark, else at the last space, unless that is in the first 40 %."""

    def step(acc: Column, _: Column) -> Column:
        rest = acc["rest"]
        window = F.substring(rest, 1, limit)
        mark = F.greatest(*(_rfind(window, m) for m in ("，", "、", ", ", "; ", "؛", "،")))
        space = _rfind(window, " ")
        at = F.when(mark >= limit * 0.4, mark).when(space >= limit * 0.4, space).otherwise(F.lit(limit - 1))
        head, tail = F.trim(F.substr(rest, F.lit(1), at + 1)), F.trim(F.substr(rest, at + 2))
        cut = F.length(rest) > limit
        return F.struct(F.when(cut, tail).otherwise(rest).alias("rest"), F.when(cut, F.concat(acc["done"], F.array(head))).otherwise(acc["done"]).alias("done"))

    start = F.struct(piece.alias("rest"), F.array().cast("array<string>").alias("done"))
    steps = F.sequence(F.lit(0), F.ceil(F.length(piece) / (limit * 0.4)).cast("int"))
    done = F.aggregate(steps, start, step, lambda acc: F.concat(acc["done"], F.array(acc["rest"])))
    return F.when(F.length(piece) <= limit, F.array(piece)).otherwise(done)


def sentences(text: Column, limit: int = 300) -> Column:
    """Sentences of at most ``limit`` characters, line by line; those of one character are dropped."""
    paras = F.transform(F.split(F.coalesce(text, F.lit("")), "\n+"), lambda p: F.trim(F.regexp_replace(p, "\\s+", " ")))
    parts = F.flatten(F.transform(F.filter(paras, lambda p: p != ""), lambda p: F.split(p, SENTENCE_END)))
    parts = F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")
    return F.filter(F.flatten(F.transform(parts, lambda s: cut_long(s, limit))), lambda s: F.length(s) >= 2)


def _spread(run: Column) -> Column:
    """A run's own terms: of CJK letters each one and each pair, of others the run."""
    n = F.length(run)
    chars = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(run, i, F.lit(1)))
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.when(run.rlike(f"^[{CJK}]"), F.concat(chars, pairs)).otherwise(F.array(run))


def index_terms(text: Column) -> Column:
    """Index terms with repeats: folded words; of CJK runs each character and pair; digits over 4 long are left out."""
    runs = f"([{CJK}]+|[\\p{{L}}\\p{{N}}&&[^{CJK}]]+)"

    def terms(folded: Column, words: str, digit: str) -> Column:
        # one look at the whole text for long numbers saves one at each word
        every = F.regexp_extract_all(folded, F.lit(words), F.lit(1))
        return let(every, lambda w: F.when(folded.rlike(f"{digit}{{5}}"), F.filter(w, lambda x: ~x.rlike(f"^{digit}{{5,}}$"))).otherwise(w))

    def other(folded: Column) -> Column:
        cjk = F.flatten(F.transform(terms(folded, runs, "\\p{Nd}"), _spread))
        return F.when(folded.rlike(f"[{CJK}]"), cjk).otherwise(terms(folded, "([\\p{L}\\p{N}]+)", "\\p{Nd}"))

    ascii_only = lambda t: F.octet_length(t) == F.length(t)
    return let(F.coalesce(text, F.lit("")), lambda t: F.when(ascii_only(t), let(F.lower(t), lambda f: terms(f, "([a-z0-9]+)", "[0-9]"))).otherwise(let(fold(t), other)))


def index_tokens(text: Column) -> Column:
    """Distinct index terms."""
    return F.array_distinct(index_terms(text))


def bucket_of(token: Column, n: int) -> Column:
    """FNV-1a of 32 bits over the first two characters' code points, modulo ``n``."""
    step = lambda h, c: ((h.bitwiseXOR(F.ascii(c).cast("long"))) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF))
    one = step(F.lit(0x811C9DC5).cast("long"), F.substring(token, 1, 1))
    two = step(one, F.substring(token, 2, 1))
    return F.when(F.length(token) == 0, F.lit(0x811C9DC5)).when(F.length(token) == 1, one).otherwise(two) % n


def n_words(text: Column) -> Column:
    """CJK characters plus runs of other word characters."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_count(t, F.lit(f"[{CJK}]")) + F.regexp_count(F.regexp_replace(t, f"[{CJK}]", " "), F.lit("[\\p{L}\\p{M}\\p{N}_]+"))


def cjk_share(text: Column) -> Column:
    """Share of CJK characters among word characters; null without any."""
    return F.regexp_count(text, F.lit(f"[{CJK}]")) / F.nullif(F.regexp_count(text, F.lit("[\\p{L}\\p{N}_]")), F.lit(0))


def text_scope(given: Column, kind: Column, title: Column, text: Column, truncated: Column) -> Column:
    """How much of the original a text has."""
    t, h = F.trim(F.coalesce(text, F.lit(""))), F.trim(F.coalesce(title, F.lit("")))
    return F.when(F.coalesce(given, F.lit("")) != "", given).when((F.coalesce(kind, F.lit("")) == "headline") | ((h != "") & (t == h)), "headline").when(F.coalesce(truncated, F.lit("")) != "", F.concat(F.lit("lead_"), truncated)).otherwise("full")


def is_junk(text: Column, cjk: Column) -> Column:
    """A passage of few letters, or of less than half letters."""
    letters = F.length(F.regexp_replace(text, "[^\\p{L}]", ""))
    solid = F.length(F.regexp_replace(text, "\\s", ""))
    return (letters < F.when(cjk, 8).otherwise(20)) | (letters * 2 < solid)


def clean(text: Column) -> Column:
    """Without URLs, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "https?://\\S+", " "), "\\s+", " "))


def title_template(title: Column) -> Column:
    """Lower case, digits and punctuation as one blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^\\p{L}]+", " "))


def norm_title(title: Column) -> Column:
    """A title's word characters, lower case, the first 80."""
    return F.substring(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^\\p{L}\\p{N}_]+", ""), 1, 80)


def first_sentence(text: Column, limit: int = 140) -> Column:
    """The first sentence, cut at a word."""
    s = F.split(F.trim(F.coalesce(text, F.lit(""))), "(?<=[.!?。！？])\\s*", 2)[0]
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.regexp_replace(F.substring(s, 1, limit), "\\s+\\S*$", ""), F.lit("…")))


def md_escape(text: Column) -> Column:
    """Text for a cell of a Markdown table."""
    return F.regexp_replace(F.regexp_replace(text, "\\|", "\\\\|"), "\\s*\\n\\s*", " ")


def crc31(text: Column) -> Column:
    """CRC-32 of the UTF-8 bytes without the top bit."""
    return F.crc32(text.cast("binary")).bitwiseAND(F.lit(0x7FFFFFFF))


def make_id(source: Column, url: Column) -> Column:
    """``source:`` and 16 hex digits of the URL's SHA-1."""
    return F.concat(source, F.lit(":"), F.substring(F.sha1(url.cast("binary")), 1, 16))


def wayback_stamp(value: Column) -> Column:
    """The first number of exactly 14 digits; null without one."""
    return F.nullif(F.regexp_extract(F.coalesce(value, F.lit("")), "(?<!\\d)(\\d{14})(?!\\d)", 1), F.lit(""))


def speaker_prefix_removed(text: Column) -> Column:
    """Without a leading ``Name:`` of up to 40 characters."""
    return F.regexp_replace(text, "^[^:：\\n]{1,40}[:：]\\s*", "")


def eligible(text: Column, lang: Column) -> Column:
    """Whether a sentence is long enough to be labelled: 25 characters, 10 in CJK languages."""
    return F.length(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n"))) >= F.when(lang.isin("zh", "ko", "ja"), 10).otherwise(25)


def ascii_digits(text: Column) -> Column:
    """Persian and Arabic digits as ASCII ones."""
    return F.translate(text, "٠١٢٣٤٥٦٧٨٩" + "۰۱۲۳۴۵۶۷۸۹", "0123456789" * 2)


def fa_norm(text: Column) -> Column:
    """Persian text with Arabic letters and digits folded and zero-width joiners as blanks."""
    return F.trim(F.regexp_replace(F.translate(ascii_digits(F.coalesce(text, F.lit(""))), "يىكۀة", "ییکهه"), "[\\u200c\\u200d\\s]+", " "))


def archive_link(url: Column, stored: Column) -> Column:
    """A readable link to an archived page: from a stored link, a time stamp, or else the latest capture; empty without any."""
    w, base = F.trim(F.coalesce(stored, F.lit(""))), "https://web.archive.org/web/"
    link = F.when(w.rlike("^https?://"), F.regexp_replace(w, "(/web/\\d+)id_/", "$1/"))
    link = link.when(w.rlike("^\\d{4,14}$"), F.concat(F.lit(base), w, F.lit("/"), F.coalesce(url, F.lit(""))))
    return link.when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit(base), url)).otherwise("")
