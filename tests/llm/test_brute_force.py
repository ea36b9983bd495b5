"""Operators that SQL cannot express, against plain versions on small inputs."""

import collections
import math
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from lexstrata.llm import decontaminate, language_id, packing, quality
from lexstrata.llm import queries as q
from lexstrata.llm.near_dedup import TensorHash, near_dedup, shingle_sets

SF = "/root/testdata/sf0.001"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def shingles(text, n=2):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(sets, percent=80):
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in sets}


def varied(n=60):
    """A base text with ever more edits: links between neighbours, none between ends."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(150)]
    out = []
    for i in range(n):
        own = list(words)
        for j in rng.choice(150, size=int(rng.integers(0, 24)), replace=False):
            own[j] = f"v{rng.integers(0, 6)}"
        out.append((i + 1, " ".join(own)))
    return out + [(1000 + i, f"alone {i} " + " ".join(f"z{i}_{k}" for k in range(20))) for i in range(20)]


def check_near(df):
    got = {r.doc_id: r for r in near_dedup(df).collect()}
    sets = {r.doc_id: shingles(r.text) for r in df.collect()}
    want = components(sets)
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(r.n_shingles == len(sets[d]) and r.kept == (want[d] == d) for d, r in got.items())


def test_near_dedup_documents(docs):
    check_near(docs)


def test_near_dedup_graded_group(spark):
    check_near(spark.createDataFrame(varied(), "doc_id long, text string"))


def test_shingle_sets_are_exact():
    texts = ["a b c a b", "", "one", "A\tb\x0bC\x0c d", "é ß é ß", " x  y "]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    assert [len(s) for s in shingle_sets(offsets, np.frombuffer(b"".join(data), np.uint8))] == [len(shingles(t)) for t in texts]


def test_tensor_recall():
    """Pairs at 0.8 share a table nearly always, and only few unrelated ones do."""
    rng, h, hits = np.random.default_rng(1), TensorHash(), 0
    for _ in range(300):
        base = rng.integers(0, 1 << 63, 180).astype(np.uint64)
        a, b = np.sort(base[:162]), np.sort(np.concatenate((base[:144], base[162:])))  # 144 of 180
        ka, kb = h.keys(a).reshape(2, -1), h.keys(b).reshape(2, -1)
        hits += bool((ka[0] == kb[0]).any() and (ka[1] == kb[1]).any())
    assert hits >= 298


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = q.op8_packing(docs.sparkSession, SF).collect()
    want = {}
    for r in docs.collect():
        ids = np.array([*coder.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        size, at, piece = (len(ids) - 1) % 1024 + 1, 0, 0
        while at < len(ids):
            want[r.doc_id, piece] = (at, size, zlib.crc32(ids[at : at + size].tobytes()))
            at, piece, size = at + size, piece + 1, 1024
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024
    total = sum(r.length for r in got)
    assert len(bins) <= math.ceil(total / 1024) * 1.02 + 1


def test_sequences_round_trip(docs):
    packed = packing.pack_documents(docs, *q.tokenizer())
    seqs = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert seqs[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)


def test_fullest_is_optimal():
    rng = np.random.default_rng(5)
    for _ in range(60):
        counts = collections.Counter({int(x): int(rng.integers(1, 4)) for x in rng.integers(1, 40, 6)})
        capacity = int(rng.integers(1, 90))
        combo = packing.fullest(counts, capacity)
        assert all(counts[k] >= n for k, n in combo.items()) and sum(k * n for k, n in combo.items()) <= capacity
        sums = {0}
        for k, n in counts.items():
            sums |= {s + k * i for s in sums for i in range(n + 1) if s + k * i <= capacity}
        assert sum(k * n for k, n in combo.items()) == max(sums)


def windows(docs, bench):
    words = lambda t: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
    bag = lambda w: collections.Counter(tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4)))
    items, out = {i: words(t) for i, t in bench}, {}
    for d, t in docs:
        w = words(t)
        for i, own in items.items():
            if not own or not w:
                continue
            b, k = bag(own), min(5, len(own))
            for s in range(max(1, len(w) - len(own) + 1)):
                win = w[s : s + len(own)]
                c = collections.Counter(tuple(win[j : j + k]) for j in range(len(win) - k + 1))
                lo, hi = sum((b & c).values()), sum((b | c).values())
                if 100 * lo >= 80 * hi:
                    x = out.setdefault((d, i), [0, 0.0, s])
                    x[0], x[1] = x[0] + 1, max(x[1], lo / hi)
    return out


def test_decontamination(spark):
    rng = np.random.default_rng(9)
    vocabulary = [f"t{i}" for i in range(400)]
    bench = [(i, " ".join(rng.choice(vocabulary, size=n))) for i, n in enumerate([3, 5, 8, 20, 20, 40, 57])] + [(90, "echo echo echo echo echo echo echo echo echo")]
    docs = []
    for d in range(100):
        w = list(rng.choice(vocabulary, size=int(rng.integers(1, 160))))
        item = bench[int(rng.integers(0, len(bench)))][1].split()
        if d % 2:
            for _ in range(int(rng.integers(0, 3))):  # edited copies too
                item[int(rng.integers(0, len(item)))] = "edit"
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = item
        docs.append((d, ", ".join(w).upper() if d % 3 else " ".join(w)))
    docs += [(200, " ".join(bench[5][1].split()[1:])), (201, bench[6][1] + "!")]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    want = windows(docs, bench)
    assert {(r.doc_id, r.item_id): [r.n_windows, pytest.approx(r.similarity), r.first_word] for r in got} == want
    assert len(want) > 25


def test_index_finds_all_within_radius(spark):
    """Fingerprints at each distance up to the radius agree with the index in a block up to 2 bits."""
    rng = np.random.default_rng(2)
    for distance in range(decontaminate.RADIUS + 1):
        for _ in range(40):
            x = int(rng.integers(0, 1 << 62))
            y = x
            for b in rng.choice(63, size=distance, replace=False):
                y ^= 1 << int(b)
            assert any(bin((x ^ y) >> (9 * j) & 511).count("1") <= decontaminate.NEAR for j in range(7))


def test_simhash(spark):
    rng = np.random.default_rng(4)
    hashes = [[int(x) for x in rng.integers(-(1 << 63), 1 << 63, n)] for n in (1, 2, 7, 50)]
    got = spark.createDataFrame([(i, h) for i, h in enumerate(hashes)], "i int, h array<long>").select("i", decontaminate.simhash(F.col("h")).alias("fp")).collect()
    for r in got:
        h = hashes[r.i]
        assert r.fp == sum(1 << b for b in range(63) if 2 * sum((x >> b) & 1 for x in h) > len(h))


def test_language_profiles(spark, docs):
    model = language_id.learn(docs)
    for r in docs.limit(20).collect():
        own = collections.Counter()
        words = "".join(c if c.isalpha() else " " for c in r.text.lower()).split()
        for w in words:
            p = f" {w} "
            own.update(w)
            own.update(p[i : i + 2] for i in range(len(p) - 1))
            own.update(p[i : i + 3] for i in range(len(p) - 2))
        assert sum(own.values()) == len(language_id.ngram_keys(r.text))
        assert len(own) == len(set(language_id.ngram_keys(r.text).tolist()))
    got = q.op4_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) > 10
    assert len(model.langs) == 4


def test_kneser_ney(spark, docs):
    """Probabilities against a direct computation, and they add up to 1."""
    train = docs.limit(30)
    texts = [r.text for r in train.collect()]
    symbols = language_symbols = quality._symbols()
    grams = collections.Counter()
    for t in texts:
        s = [2, 2, 2, *(int(symbols[ord(c)]) for c in t)]
        grams.update(tuple(s[i : i + 4]) for i in range(len(s) - 3))
    counts = {4: grams}
    for k in (3, 2, 1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    cuts, contexts = {}, {}
    for k, c in counts.items():
        n = [0, *(sum(v == i for v in c.values()) for i in (1, 2, 3, 4))]
        y = n[1] / (n[1] + 2 * n[2])
        cuts[k] = [0.0, *(min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i) for i in (1, 2, 3))]
        for g, v in c.items():
            x = contexts.setdefault((k, g[:-1]), [0, 0.0])
            x[0] += v
            x[1] += cuts[k][min(v, 3)]

    def p(g):
        k = len(g)
        if not k:
            return 1 / 4096
        total, left = contexts.get((k, g[:-1]), (0, 0))
        if not total:
            return p(g[1:])
        v = counts[k].get(g, 0)
        return max(v - cuts[k][min(v, 3)], 0) / total + left / total * p(g[1:])

    model = quality.train(train)
    got = {r.doc_id: r for r in quality.score(docs, model, ("doc_id",), shards=3).collect()}
    assert len(got) == docs.count()
    for r in docs.limit(45).collect():
        s = [2, 2, 2, *(int(symbols[ord(c)]) for c in r.text)]
        want = sum(math.log(p(tuple(s[i : i + 4]))) for i in range(len(s) - 3))
        assert got[r.doc_id].n == len(r.text) and math.isclose(got[r.doc_id].log_p, want, rel_tol=1e-9)
    context = tuple(int(language_symbols[ord(c)]) for c in "the")
    assert math.isclose(sum(p((*context, w)) for w in range(4096)), 1, rel_tol=1e-9)


def test_quality_finds_junk(spark):
    got = q.op1_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    clean = [r.kept for r in got if r.quality == 1 and r.toxic == 0]
    junk = [r.kept for r in got if r.quality == 0]
    assert sum(clean) >= 0.98 * len(clean) and sum(junk) <= 0.2 * len(junk)


def test_pipeline(spark):
    """All stages against plain ones; packing is checked by what it packs."""
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = [d for d in docs if any(c.isalpha() for c in d["text"])]
    texts = {(d["source"], d["text"]) for d in docs}
    pages, lines = collections.Counter(s for s, _ in texts), collections.Counter()
    for source, text in texts:
        lines.update({(source, x.strip(" \t\r")) for x in text.split("\n")} - {(source, "")})
    bad = {k for k, n in lines.items() if n >= 5 and n > pages[k[0]] * 0.01}
    for d in docs:
        d["text"] = "\n".join(x for x in d["text"].split("\n") if (d["source"], x.strip(" \t\r")) not in bad)
    roots = components({d["doc_id"]: shingles(d["text"], 5) for d in docs})
    docs = [d for d in docs if roots[d["doc_id"]] == d["doc_id"]]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {d for d, _ in windows([(d["doc_id"], d["text"]) for d in docs], bench)}
    want = {d["doc_id"]: d["text"] for d in docs if d["doc_id"] not in gone}
    got = collections.Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id] += r.length
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert got == {d: len(coder.encode(t, add_special_tokens=False).ids) + 1 for d, t in want.items()}


def test_stages_keep_clean_rows_of_any_id(spark, tmp_path):
    """Null and repeated ids lose no clean row; near copies lose all but one row; a language not learned is rejected."""
    rng = np.random.default_rng(1)
    prose = lambda k, n=40: " ".join(f"w{k}x{rng.integers(0, 10**6)}" for _ in range(n))
    a, b, c, d, item = (prose(k) for k in "abcde")
    rows = [(None, a), (None, f"{item} {b}"), (None, b), (7, c), (7, d), (7, c), (8, d), (9, prose("f"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [r.text for r in corpus_pipeline.drop_contaminated(spark, df, str(tmp_path)).collect()]
    assert sorted(left) == sorted(t for _, t in rows if not t.startswith(item))
    left = [r.text for r in corpus_pipeline.drop_near_copies(spark, df, str(tmp_path)).collect()]
    assert sorted(left) == sorted({t for _, t in rows})
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150)
    other = ["Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.", "zq xkvj wqzx pfgh bvkw zzxq jjkq wvvz xqzj kkvw"]
    more = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(other)], "doc_id long, text string").selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "'s' AS source", "1L AS n_chars")
    kept = {r.doc_id for r in corpus_pipeline.keep_languages(spark, docs.unionByName(more), "").collect()}
    real = {r.doc_id for r in docs.collect() if any(x.isalpha() for x in r.text)}
    assert real <= kept and not kept & {10**6, 10**6 + 1}


def test_language_distances(spark, docs):
    """Predictions and scores against rank lists and distances computed one by one."""
    model = language_id.learn(docs)
    lists = {lang: {int(model.keys[k]): int(model.place[k, j]) for k in np.flatnonzero(model.place[:, j] >= 0)} for j, lang in enumerate(model.langs)}
    got = {r.doc_id: r for r in language_id.identify(docs, model, keep=("doc_id",)).collect()}
    for r in docs.limit(60).collect():
        own = collections.Counter(language_id.ngram_keys(r.text or "").tolist())
        ranked = sorted(own, key=lambda k: (-own[k], k))[: model.size]
        if not ranked:
            assert got[r.doc_id].lang_pred == "und"
            continue
        far = {lang: sum(abs(at[k] - i) if k in at else model.size for i, k in enumerate(ranked)) for lang, at in lists.items()}
        best = min(sorted(far), key=far.get)
        assert got[r.doc_id].lang_pred == best and math.isclose(got[r.doc_id].score, 1 - far[best] / (len(ranked) * model.size))


def test_quality_thresholds(spark):
    """Quantiles, their pull to the whole and the verdicts, from the perplexities that the query returns."""
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1 AND toxic = 0").collect()}
    got = q.op1_quality(spark, sf).withColumn("held", quality.calibration(F.col("doc_id"))).collect()
    held = [(r.lang or "", math.ceil(math.log(r.perplexity) * 1000 - 1e-9)) for r in got if r.doc_id in labels and r.held and r.n_symbols]
    cut = lambda xs: sorted(xs)[math.ceil(len(xs) * 0.995 - 1e-9) - 1] / 1000
    pooled = cut([x for _, x in held])
    for r in got:
        own = [x for lang, x in held if lang == (r.lang or "")]
        want = math.exp((cut(own) * len(own) + pooled * 50) / (len(own) + 50)) if own else math.exp(pooled)
        assert math.isclose(r.threshold, want, rel_tol=2e-3)
        assert r.kept == (r.n_symbols > 0 and r.perplexity <= r.threshold)
        assert r.in_training == (r.doc_id in labels and not r.held)
