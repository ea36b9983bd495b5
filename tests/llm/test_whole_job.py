"""Cases in which an operator did less than its whole job."""

import textwrap

import numpy as np

from pyspark.sql import functions as F

from lexstrata.llm import queries as q
from lexstrata.llm.exact_dedup import exact_dedup, sha256_of
from lexstrata.llm.license_scan import SPAN, TEMPLATES, Index, license_scan, words_of
from lexstrata.llm.near_dedup import compared, left_apart
from lexstrata.llm.packing import pack_documents


def test_wrapped_license_notices(spark):
    """Every notice of several words is found however its lines are broken, in comments and between other text; scattered words are none."""
    texts = ["Some code.\n\n" + "\n".join(f" * {x}" for x in textwrap.wrap(t, width, break_long_words=False, break_on_hyphens=False)) + "\nint main;" for _, t in TEMPLATES for width in (12, 40, 72)]
    far = "\n".join(w.decode() + " and so on" * 60 for w in words_of(TEMPLATES[1][1]))
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame([*enumerate(texts), (-1, far)], "doc_id long, text string")).collect()}
    for i in range(len(texts)):
        assert TEMPLATES[i // 3][0] in got[i].labels.split(",") and got[i].score == 1, texts[i]
    assert (got[-1].labels, got[-1].score, got[-1].blocks) == ("", 0, [])


def test_runs_across_lines_are_exact():
    """The best share of each template against all runs of words."""
    rng = np.random.default_rng(8)
    index = Index.build(TEMPLATES, {}, 0.8)
    found = 0
    for k in range(150):
        words = words_of(TEMPLATES[k % len(TEMPLATES)][1])
        for _ in range(int(rng.integers(0, 1 + len(words)))):
            words.insert(int(rng.integers(0, len(words) + 1)), [b"other", words[0]][int(rng.integers(0, 2))])
        if k % 3:
            del words[int(rng.integers(0, len(words)))]
        cuts = sorted(rng.integers(0, len(words) + 1, 3))
        lines = [words[a:b] for a, b in zip([0, *cuts], [*cuts, len(words)])]
        flat = [(no, w) for no, line in enumerate(lines) for w in line]
        got = {}
        for t, common in [m for line in lines for m in index.matches(set(line))] + [(t, c) for t, c, _, _ in index.runs(lines)]:
            got[t] = max(common, got.get(t, 0))
        want = {}
        for t, (_, x) in enumerate(TEMPLATES):
            own, size = set(words_of(x)), SPAN * len(words_of(x))
            runs = [{w for _, w in flat[a : a + size]} for a in range(len(flat))] + [set(line) for line in lines]
            common = max(len(own & r) for r in runs)
            if 10 * common >= 8 * len(own):
                want[t] = common
        assert got == want
        found += len(want)
    assert found > 100


def test_packed_special_tokens(spark):
    """The ids of texts that hold the added token's string are those of ``tokenizers``."""
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["end <|endoftext|> of", "<|endoftext|>", "a<|endoftext|><|endoftext|>  \n b", "<|<|endoftext|>|>", "<|ENDOFTEXT|> <|endoftext|", "word <|endoftext|>'s\n" * 500]
    pieces = pack_documents(spark.createDataFrame(enumerate(texts), "doc_id long, text string"), *q.tokenizer()).collect()
    for i, text in enumerate(texts):
        ids = b"".join(bytes(r.ids) for r in sorted((r for r in pieces if r.doc_id == i), key=lambda r: r.piece))
        assert np.frombuffer(ids, "<u4").tolist() == [*coder.encode(text, add_special_tokens=False).ids, 2]


def test_second_round_with_repeated_rows(spark):
    """Repeated rows of a document do not hide its shared shingles behind its own edits."""
    base = [f"r{i}" for i in range(120)]
    both = base[:60] + [f"c{i}" for i in range(60)]
    edited = lambda k: " ".join([*both, *(f"edit{k}_{i}" for i in range(6))])
    rows = [(0, " ".join(base)), (1, edited(1)), (2, edited(2))]
    pairs = spark.createDataFrame([(1, 0), (2, 0)], "a long, b long")
    apart = spark.createDataFrame([], "node long, component long")
    for times in (1, 2, 4):
        docs = spark.createDataFrame(rows * times, "doc_id long, text string")
        first = compared(docs, pairs)
        assert first.filter("100 * common >= 80 * (n_a + n_b - common)").count() == 0
        assert [tuple(r) for r in left_apart(docs, first, apart, 80).collect()] == [(2, 1)], times


def test_second_round_of_a_large_group(spark):
    """Long mates of one document that share what it has changed are not all paired; those that are similar are."""
    rng = np.random.default_rng(11)
    base = np.array([f"w{i}" for i in range(2000)], object)

    def edited(of, name, n):
        out = of.copy()
        out[rng.choice(2000, n, replace=False)] = [f"{name}_{i}" for i in range(n)]
        return out

    own = {k: edited(base, f"e{k}", 109 if k else 100) for k in range(41)}
    own |= {100 + k: edited(own[k], f"n{k}", 20) for k in (7, 23)}
    docs = spark.createDataFrame([(k, " ".join(words)) for k, words in own.items()], "doc_id long, text string")
    pairs = spark.createDataFrame([(k, 0) for k in own if k], "a long, b long")
    first = compared(docs, pairs)
    assert first.filter("100 * common >= 80 * (n_a + n_b - common)").count() == 0
    made = {tuple(r) for r in left_apart(docs, first, spark.createDataFrame([], "node long, component long"), 80).collect()}
    assert {(107, 7), (123, 23)} <= made and len(made) <= 2 * len(own)  # of 903 pairs


def test_exact_dedup_spreads_null_ids(spark):
    """A hot text whose rows all have null ids is dealt over the salts; colliding digests too."""
    df = spark.createDataFrame([(None, "hot")] * 300 + [(7, "hot"), (8, "x"), (None, "y"), (None, "y")], "doc_id long, text string")
    for digest in (sha256_of, lambda c: F.lit("same")):
        out = exact_dedup(df, digest=digest).collect()
        assert len(out) == 304 and sum(r.kept for r in out) == 4
        assert {(r.keep_id, r.group_size) for r in out} == {(7, 301), (8, 1), (None, 2)}


def test_ids_are_those_of_tokenizers(spark):
    """Random texts of every script, controls, blanks, surrogate-like code points, emoji and the added token."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = np.random.default_rng(5)
    pools = ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "\r\n", "\t", "\x00", "\x7f", "\u00a0", "\u2028", "\u3000", "\ufeff", "'s", "'LL", "don't", "12345", "é", "ß", "ﬁ", "近日", "한국", "العربية", "हिन्दी", "ไทย", "😀", "👩‍👩‍👧", "\U0001f1e6\U0001f1f9", "\ufffd", "\ud7ff", "\ue000", "word", "Word", "WORD", "_x", "--", "...", "https://a.b/c?d=1#e"]
    texts = ["".join(rng.choice(pools, size=int(rng.integers(1, 60)))) for _ in range(400)] + ["".join(chr(int(c)) for c in rng.integers(1, 0xD800, 200)) for _ in range(100)] + ["<|endoftext|>", "a<|endoftext|>b", "", None, "x" * 5000, " " * 3000]
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in pack_documents(df, *q.tokenizer()).orderBy("doc_id", "piece").collect():
        got[r.doc_id] = got.get(r.doc_id, []) + np.frombuffer(r.ids, "<u4").tolist()
    for i, t in enumerate(texts):
        assert got[i] == [*coder.encode(t or "", add_special_tokens=False).ids, 2], repr(t)
