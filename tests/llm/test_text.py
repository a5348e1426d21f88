"""Statistics, models and scores of single texts against plain versions."""

import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelweave.llm import _encode, _text, maxent, quality, queries, toxicity

WORD = re.compile(_text.WORD)


def statistics(x):
    x = x or ""
    w, seen, dup = WORD.findall(x), set(), 0
    for line in x.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    count = Counter(windows)
    covered = {j for k, y in enumerate(windows) if count[y] > 1 for j in range(k, k + 5)}
    return len(w), sum(map(len, w)), sum(x.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_statistics_and_verdicts(odd, docs):
    for df in (odd.select("doc_id", "text", "lang"), docs):
        got = quality.verdicts(quality.judge(df)).collect()
        assert len(got) == df.count()
        for r in got:
            n, *_, rep = want = statistics(r.text)
            q = r.quality
            assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == want
            assert q.base_failed == (n < 10 or 100 * rep > 20 * n)
            assert (q.log10_ppl is None) == (n == 0)
            assert not (q.kept and q.base_failed)


def test_quality_keeps_columns_and_drops_junk(spark, odd, none, docs):
    kept = quality.keep(odd)
    assert kept.columns == odd.columns
    assert quality.keep(none).count() == 0
    rng = np.random.default_rng(0)
    junk = "".join(rng.choice(list("qxzjkvw0123456789#@~^"), 400)).replace("z", " ")
    junk = spark.createDataFrame([(-1, " ".join(junk[i : i + 9] for i in range(0, 390, 9)), "en", "s", 400)], docs.schema)
    ids = {r.doc_id for r in quality.keep(docs.unionByName(junk)).collect()}
    assert -1 not in ids
    assert len(ids) > 0.8 * docs.count()


def test_each_language_has_its_own_band(spark):
    # de and pl, zh and he were in one bucket of 64 each
    langs = ["de", "pl", "zh", "he", None, "(none)", *[f"x{k}" for k in range(70)]]
    rng = np.random.default_rng(4)
    rows = []
    for k, lang in enumerate(langs):
        letters = list("abcdefghijklm" if k % 2 else "nopqrstuvwxyz")
        words = ["".join(rng.choice(letters, 4)) for _ in range(5)]
        rows += [(100 * k + j, " ".join(rng.choice(words, 20)), lang) for j in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    judged = quality.judge(df)
    assert judged.select("quality_bucket").distinct().count() == len(langs)
    assert judged.select("lang", "quality_bucket").distinct().count() == len(langs)
    scored = judged.select("doc_id", "quality", "quality_bucket").cache()
    assert quality.bands(scored, "quality", "quality_bucket").count() == scored.where(~quality.base_failed("quality")).select("quality_bucket").distinct().count()


def test_noise_is_rejected(spark, data):
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text", "lang")
    rng = np.random.default_rng(0)
    good = [r.text for r in docs.where("lang = 'en' AND length(text) BETWEEN 800 AND 3000").orderBy("doc_id").limit(5).collect()]
    letters = list("abcdefghijklmnopqrstuvwxyz")
    noisy = ["".join(rng.choice(letters) if c != " " and rng.random() < share else c for c in t) for share in (0.3, 1.0) for t in good]
    judged = quality.verdicts(quality.judge(docs.unionByName(spark.createDataFrame([(-1 - k, t, "en") for k, t in enumerate(noisy)], docs.schema))))
    assert not judged.where("doc_id < 0 AND quality.kept").count()
    prose = judged.where("doc_id >= 0 AND lang = 'en' AND NOT quality.base_failed").agg(F.max_by("quality.log10_ppl", "quality.n_words"), F.avg(F.col("quality.kept").cast("int"))).first()
    noise = judged.where("doc_id < 0").agg(F.min("quality.log10_ppl")).first()[0]
    assert noise > prose[0] and prose[1] > 0.85


def plain_kneser_ney(texts, order):
    """p(symbol | context) of a modified Kneser-Ney model, by its recursive definition."""
    counts = {order: Counter()}
    for t in texts:
        s = "\0" * (order - 1) + t + "\0"
        counts[order].update(s[k : k + order] for k in range(len(s) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def discounts(c):
        of = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        y = of[0] / (of[0] + 2 * of[1]) if of[0] and of[1] else 0.5
        return [min(max(k - (k + 1) * y * of[k] / of[k - 1], 0.05), k - 0.05) if of[k - 1] and of[k] else 0.5 for k in (1, 2, 3)]

    d = {n: discounts(c) for n, c in counts.items()}

    def p(context, x):
        n = len(context) + 1
        shorter = p(context[1:], x) if context else 1 / 256
        after = {g: v for g, v in counts[n].items() if g[:-1] == context}
        total = sum(after.values())
        if not total:
            return shorter
        own = after.get(context + x, 0)
        left = sum(d[n][min(v, 3) - 1] for v in after.values())
        return ((own - d[n][min(own, 3) - 1] if own else 0) + left * shorter) / total

    return p


def test_kneser_ney_equals_its_definition(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("aabcd ", k=rng.randint(1, 40))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    for order in (1, 2, 4):
        model, p = quality.train(df, F.lit(5), order), plain_kneser_ney(texts, order)
        for context in ["".join(rng.choices("abcd \0z", k=order - 1)) for _ in range(25)] + [texts[0][: order - 1]]:
            for x in "abcz\0":
                key = np.array([int.from_bytes((context + x).encode("latin1"), "big") | 5 << 8 * order], np.uint64)
                assert abs(10 ** model.log10(key)[0] - p(context, x)) < 1e-6


@pytest.mark.parametrize("most", [1 << 21, 3000, 40])
def test_kneser_ney_is_a_distribution(docs, most, monkeypatch):
    monkeypatch.setattr(quality, "MOST", most)
    model = quality.train(docs.where("lang = 'en'"), F.lit(7))
    assert all(len(k) <= most for k, _ in model.grams.values())
    rng = np.random.default_rng(1)
    block = next(_text.blocks(pa.array(["the house and then some, für zq9"])))
    keys, _ = quality._keys(block, np.array([7]), model.order)
    for key in [*rng.choice(keys, 12), *(keys[:5] ^ np.uint64(0x5500))]:
        every = (key & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
        assert abs((10 ** model.log10(every)).sum() - 1) < 1e-6


def test_encoder_tables_are_small_and_give_all_ids():
    # they took 44 MB of a worker before the first chunk, 104 and more when full
    def encode(texts):
        return np.array([ord(c) for t in texts for c in t], np.uint32), np.array([len(t) for t in texts], np.int64)

    enc = _encode.Encoder(encode, True)
    assert sum(x.nbytes for x in (enc.keys, enc.at, enc.size, enc.pool)) < 32 << 20
    rng = random.Random(5)
    texts = ["".join(rng.choices("abc é", k=rng.randint(0, 300))) for _ in range(40)]
    long = "x" * (_encode.LONGEST + 1)
    texts += [f"a {long} b", "", "wide \U0001f600\uffff end", f"{long} {'y' * 3_000_000}", *texts[:20]]
    for bits in (4, 21):
        enc = _encode.Encoder(encode, True, bits)
        for _ in range(2):
            for block in _text.blocks(pa.array(texts), max_bytes=1 << 12):
                ids, size, doc, *_ = enc.encode(block)
                assert ids.dtype == np.uint32
                assert "".join(map(chr, ids)) == "".join(texts[block.first : block.first + block.n])
                assert size.sum() == len(ids)


@pytest.mark.parametrize("most", [300, 0])
def test_large_models_leave_nothing_out(odd, docs, most, monkeypatch):
    # n-grams beyond MOST were dropped from the model, so perplexities depended on it
    for df in (odd.select("doc_id", "text", "lang"), docs.select("doc_id", "text", "lang").limit(60)):
        found = {}
        for at in (1 << 21, most):
            monkeypatch.setattr(quality, "MOST", at)
            rows = quality.verdicts(quality.judge(df)).collect()
            found[at] = sorted(((r.doc_id, r.text, r.lang, *r.quality) for r in rows), key=str)
        whole, large = found.values()
        assert len(whole) == df.count() == len(large)
        assert [(*a[:8], *a[9:]) for a in whole] == [(*b[:8], *b[9:]) for b in large]
        for a, b in zip(whole, large, strict=True):
            assert a[8] == b[8] or abs(a[8] - b[8]) < 1e-9


def test_large_models_equal_the_definition(spark, monkeypatch):
    monkeypatch.setattr(quality, "MOST", 5)
    texts = ["abba cab", "abba dab", "a", "cab cab"]
    model, p = quality.train(spark.createDataFrame([(t,) for t in texts], "text string"), F.lit(5), 3), plain_kneser_ney(texts, 3)
    asked = [(c, x) for c in ("ab", "zz", "b ", "\0\0") for x in "abz\0"]
    keys = np.array([int.from_bytes((c + x).encode("latin1"), "big") | 5 << 24 for c, x in asked], np.uint64)
    assert np.abs(10 ** model.log10(keys) - [p(c, x) for c, x in asked]).max() < 1e-6


def test_ngram_counts(spark):
    got = {r.key & 0xFFFFFFFFFF: r.n for r in quality.count_ngrams(spark.createDataFrame([("aab",), ("aab",)], "text string"), F.lit(1), 3).collect()}
    pack = lambda s: int.from_bytes(s.encode("latin1"), "big")
    assert {k & 0xFFFFFF: n for k, n in got.items()} == {pack("\0\0a"): 2, pack("\0aa"): 2, pack("aab"): 2, pack("ab\0"): 2}


def test_marginals():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = int(rng.integers(1, 150))
        score, first, moves = rng.normal(0, 3, n), rng.random(n) < 0.2, rng.normal(0, 1, 4)
        first[0] = True
        got = toxicity.marginals(score, first, moves)
        bounds = [*np.flatnonzero(first).tolist(), n]
        for a, b in zip(bounds, bounds[1:], strict=False):
            t, e = np.exp(moves).reshape(2, 2), np.stack([np.ones(b - a), np.exp(score[a:b])], 1)
            ahead, back = [e[0]], [np.ones(2)]
            for k in range(1, b - a):
                x = (ahead[-1] @ t) * e[k]
                ahead.append(x / x.sum())
            for k in range(b - a - 1, 0, -1):
                x = t @ (e[k] * back[0])
                back.insert(0, x / x.sum())
            p = np.array(ahead) * np.array(back)
            assert np.allclose(p[:, 1] / p.sum(1), got[a:b])


def test_toxicity(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op4_toxicity"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().merge(got, on="doc_id")
    assert len(docs) == 1000 and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out, strict=True))
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().merge(got, on="doc_id")
    held = labels[labels.held_out]
    assert ((held.predicted == 1) == (held.toxic == 1)).mean() > 0.9
    hit = docs[docs.spans != ""].iloc[0]
    assert all(hit.text[slice(*map(int, s.split(":")))].strip() == hit.text[slice(*map(int, s.split(":")))] for s in hit.spans.split(","))
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)] + [(None, 1), (3, None), (999, 1)], "doc_id long, toxic int")
    assert toxicity.reject(odd, labels).columns == odd.columns
    assert toxicity.reject(none, labels).count() == 0
    assert toxicity.reject(odd, labels.limit(0)).count() == odd.count()


@pytest.mark.parametrize("head", [1 << 20, 50])
def test_language_model(odd, none, head, monkeypatch):
    monkeypatch.setattr(maxent, "HEAD", head)
    df = odd.select("doc_id", "text", (F.coalesce("doc_id", F.lit(0)) % 7 != 2).alias("trained"), "score")
    got = maxent.score(df, "trained").collect()
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = lambda x: [*WORD.findall((x or "").translate(fold)), None]
    c = Counter(t for r in df.where("trained").collect() for t in tokens(r.text))
    n, v = sum(c.values()), len(c)
    want = sorted((len(t), sum(c[w] > 0 for w in t), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for t in (tokens(r.text) for r in df.collect()))
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    assert maxent.score(none.withColumn("trained", F.lit(True)), "trained").count() == 0


def plain_scores(rows):
    """Scores of (text, trained) rows by the definitions, token by token, with dictionaries."""
    mix = lambda x: int(_text.mix(np.array([x % 2**64], np.uint64))[0])
    end = maxent.END_LEAF

    def walk(text):
        h, leaf, n = maxent.tokens(next(_text.blocks(pa.array([text]), fold=True)))
        h, leaf = [int(x) for x in h], [int(x) for x in leaf]
        for k in range(int(n[0])):
            one, two = h[k - 1] if k > 0 else 0, h[k - 2] if k > 1 else 0
            f = [("last", leaf[k - 1] if k > 0 else 256), ("skip", leaf[k - 2] if k > 1 else 256), ("word", mix(one) >> (64 - maxent.LEAST_BITS)), ("pair", mix(one * 3 + mix(two)) >> (64 - maxent.LEAST_BITS))]
            c = leaf[k] // 16
            g = [(f"part {name}", x * 16 + c if name in ("last", "skip") else mix(x * 16 + c) >> (63 - maxent.LEAST_BITS)) for name, x in f]
            yield h[k], leaf[k], f, g

    w: dict = {}

    def softmax(f):
        x = np.sum([w.get(k, np.zeros(16)) for k in f], axis=0)
        x = np.exp(x - x.max())
        return x / x.sum()

    rounds = spark_rounds([t for t, _ in rows])
    for k in range(maxent.ROUNDS):
        seen, expected = {}, {}
        for (text, trained), r in zip(rows, rounds, strict=True):
            for _, leaf, f, g in walk(text) if trained and r == k else ():
                for fs, y in ((f, leaf // 16), (g, leaf % 16)) if leaf != end else ((f, leaf // 16),):
                    p = softmax(fs)
                    for x in fs:
                        seen.setdefault(x, np.zeros(16))[y] += 1
                        expected[x] = expected.get(x, 0) + p
        for x, s in seen.items():
            w[x] = w.get(x, np.zeros(16)) + maxent.RATE * np.log((s + maxent.PRIOR) / (expected[x] + maxent.PRIOR))
    count = Counter((h, leaf) for text, trained in rows if trained for h, leaf, *_ in walk(text))
    total, kinds = Counter(), Counter()
    for (_, leaf), c in count.items():
        total[leaf] += c
        kinds[leaf] += 1
    out = []
    for text, _ in rows:
        s = 0.0
        for h, leaf, f, g in walk(text):
            s += math.log10(softmax(f)[leaf // 16]) + (math.log10(softmax(g)[leaf % 16]) if leaf != end else 0)
            s += math.log10((count[h, leaf] + 1) / (total[leaf] + kinds[leaf] + 1)) if total[leaf] else 0.0
        out.append(s)
    return out


def spark_rounds(texts):
    from pyspark.sql import SparkSession

    df = SparkSession.active().createDataFrame(list(enumerate(texts)), "k int, text string")
    return [r[0] for r in df.orderBy("k").select(F.pmod(F.xxhash64("text"), F.lit(maxent.ROUNDS))).collect()]


def test_scores_equal_their_definition(spark, monkeypatch):
    monkeypatch.setattr(maxent, "HEAD", 30)
    rng = random.Random(8)
    words = ["the", "The", "house", "stands", "on", "a", "hill", "für", "x9", "over.", "it,", "again"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 30))), k % 4 != 1) for k in range(60)]
    df = spark.createDataFrame([(k, t, b) for k, (t, b) in enumerate(rows)], "doc_id long, text string, b boolean").repartition(5)
    got = {r.doc_id: r.score for r in maxent.score(df, "b").collect()}
    for k, want in enumerate(plain_scores(rows)):
        assert abs(got[k] - want) < 1e-4 * max(1, abs(want))


def test_training_sums_at_less_than_one_scatter_of_all_outcomes():
    """The sums of ``add`` equal those of one scatter over (row, outcome), and take clearly less time."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 400) % 5000) for _ in range(300)]
    model = maxent.Model(13)
    model.w[:] = rng.normal(0, 0.3, model.w.shape)
    h, leaf, n = maxent.tokens(next(_text.blocks(pa.array(texts), fold=True)))
    rows, leaf = maxent.features(h, leaf, n, model.bits)[:, : maxent.BATCH], leaf[: maxent.BATCH]
    inner = leaf != maxent.END_LEAF

    def scattered():
        seen, expected = np.zeros(model.w.size), np.zeros(model.w.size)
        for first, r, y in ((0, rows[:4], leaf // 16), (4, rows[4:, inner], leaf[inner] % 16)):
            x = np.exp(model.w[r].sum(0))
            p = (x / x.sum(1, keepdims=True)).ravel()
            for k, row in enumerate(r, first):
                a, b = model.starts[k] * 16, model.starts[k + 1] * 16
                seen[a:b] += np.bincount(row * 16 + y - a, minlength=b - a)
                expected[a:b] += np.bincount((row[:, None] * 16 + np.arange(16)).ravel() - a, p, b - a)
        return seen.reshape(-1, 16).T, expected.reshape(-1, 16).T

    def added():
        sums = np.zeros((16, len(model.w))), np.zeros((16, len(model.w)))
        model.add(rows, leaf, *sums)
        return sums

    def cost(f):
        times = []
        for _ in range(5):
            began = time.thread_time()
            f()
            times.append(time.thread_time() - began)
        return min(times)

    for got, want in zip(added(), scattered(), strict=True):
        assert np.allclose(got, want, rtol=1e-4, atol=1e-4)
    assert cost(added) < 0.75 * cost(scattered)


def test_model_beats_unigrams_however_it_is_partitioned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2).alias("trained"))
    found = []
    for n in (1, 4, 64):
        got = maxent.score(docs.repartition(n), "trained").cache()
        s = got.where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
        assert (s[0] - s[1]) / s[2] > 0.05  # log10 a token
        found.append({r.doc_id: r.score for r in got.select("doc_id", "score").collect()})
    assert all(abs(found[0][k] - x[k]) < 1e-3 + 1e-6 * abs(x[k]) for x in found[1:] for k in x)


def test_expected_counts_and_gradient(monkeypatch):
    # all labellings of short documents, one by one
    rng = np.random.default_rng(11)
    sizes, moves = [1, 4, 3, 1, 5], rng.normal(0, 1, 4)
    score = rng.normal(0, 2, sum(sizes))
    first = np.zeros(len(score), bool)
    first[np.cumsum([0, *sizes[:-1]])] = True
    want_p, want_pair, total = np.zeros(len(score)), np.zeros(4), 0.0

    def weigh(s, y):
        return sum(v for v, k in zip(s, y, strict=True) if k) + sum(moves[2 * a + b] for a, b in itertools.pairwise(y))

    for at, n in zip(np.flatnonzero(first), sizes, strict=True):
        every = list(itertools.product((0, 1), repeat=n))
        mass = np.exp([weigh(score[at : at + n], y) for y in every])
        total += np.log(mass.sum())
        for y, m in zip(every, mass / mass.sum(), strict=True):
            want_p[at : at + n] += m * np.array(y)
            for a, b in itertools.pairwise(y):
                want_pair[2 * a + b] += m
    p, pair = toxicity.expected(score, first, moves)
    assert np.allclose(p, want_p) and np.allclose(pair, want_pair)
    for part in (1, 3, 100):
        monkeypatch.setattr(toxicity, "PART", part)
        q, counts = toxicity._by_parts(score, first, moves)
        assert np.allclose(q, want_p) and np.allclose(counts, want_pair)
    # marginals are the gradient of the log of the sum over all labellings
    def whole(s):
        out = 0.0
        for at, n in zip(np.flatnonzero(first), sizes, strict=True):
            out += np.log(sum(np.exp(weigh(s[at : at + n], y)) for y in itertools.product((0, 1), repeat=n)))
        return out

    assert np.isclose(whole(score), total)
    step = np.eye(len(score)) * 1e-5
    assert np.allclose([(whole(score + e) - whole(score - e)) / 2e-5 for e in step], want_p, atol=1e-6)


def test_toxic_documents_of_any_length_are_learnt_from(spark):
    # the only toxic examples are long: a bound on length would leave nothing to learn
    rng = random.Random(3)
    plain = [f"w{k}" for k in range(300)]
    prose = lambda n, bad: " ".join(rng.choice(plain) if not bad or rng.random() > 0.02 else rng.choice(["vile", "nasty"]) for _ in range(n))
    docs = spark.createDataFrame([(k, prose(6000 if k % 2 else 60, k % 2 == 1)) for k in range(120)] + [(1000, prose(80, False) + " vile nasty"), (1001, prose(80, False))], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: (r.s.score, [r.text[x.start : x.end] for x in r.s.spans]) for r in docs.where("doc_id >= 1000").select("doc_id", "text", toxicity.score(F.col("text"), model, spark).alias("s")).collect()}
    assert got[1000][0] > 2 * got[1001][0] and got[1000][1][-2:] == ["vile", "nasty"] and not {"vile", "nasty"} & set(got[1001][1])
