"""URL filters, resampling and divergence against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from reelweave.llm import divergence, queries, resample, url_rules

URL = re.compile(r"(?s)^.*?://([^/?#]*)([^?#]*)")
LABELS, SEGMENTS = ["com", "net", "a", "b", "www", ""], ["", "en", "e", "fr", "x y"]


def fold(x):
    return x.translate({k: k + 32 for k in range(65, 91)})


def longest(url, rules):
    m = URL.match(url or "")
    h, p = (fold(m[1]), m[2]) if m else ("", "")
    fits = [(len(rh.split(".")) if rh else 0, len(rp), v == "block", rh + rp, v) for rh, rp, v in ((fold(a), b, c) for a, b, c in rules) if (rh == "" or h == rh or h.endswith("." + rh)) and p.startswith(rp)]
    return (h, p, *(max(fits)[3:] if fits else (None, url_rules.DEFAULT)))


def url_cases():
    rng = random.Random(5)
    host = lambda: ".".join(rng.choice(LABELS) for _ in range(rng.randint(1, 4)))
    path = lambda: "/".join(["", *(rng.choice(SEGMENTS) for _ in range(rng.randint(0, 4)))])
    rules = [(host(), path(), rng.choice(["allow", "block"])) for _ in range(150)] + [("COM", "/", "allow"), ("com", "/e", "block"), ("a.com", "", "block"), ("a.com", "", "allow"), ("b.net", "/x", "keep")]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{host()}{path()}{rng.choice(['', '?q=/en/', '#://x/en'])}" for _ in range(600)]
    urls += [None, "", "://", "no scheme/en", "x://A.COM", "x://a.com?y", "x\ny://a.com/\n/en", "http://a://b/en/", "x://" + "a." * 20000 + "com/en/", "x://com/" + "en/" * 20000]
    return rules, urls + urls[:20]


def test_longest_entry_wins(spark):
    rules, urls = url_cases()
    pages = spark.createDataFrame([(k % 300, u, "h", "r") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string").repartition(3)
    want = sorted((k % 300, *longest(u, rules)) for k, u in enumerate(urls))
    key = lambda r: tuple("" if x is None else x for x in r)
    for most in (url_rules.MOST, 3):
        found = url_rules.judge(pages, rules, most=most)
        got = found.select("page_id", F.col("url_rule.host"), "url_rule.path", "url_rule.rule", "url_rule.verdict").collect()
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
        assert found.columns == [*pages.columns, "url_rule"]
    kept = url_rules.allowed(pages, rules)
    assert kept.columns == pages.columns and kept.count() == sum(w[4] != "block" for w in want)


def test_url_filter_of_empty_tables(spark):
    rules, urls = url_cases()
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    for most in (100, 0):
        assert url_rules.judge(pages.limit(0), rules, most=most).count() == 0
    got = url_rules.judge(pages, [(None, "/", "block")]).select("url_rule.rule", "url_rule.verdict").distinct().collect()
    assert [tuple(r) for r in got] == [(None, url_rules.DEFAULT)]


def features(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", fold(text or ""))
    return w, w + [f"{a} {b}" for a, b in itertools.pairwise(w)]


def drawn(docs, target, least_words, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, features(x)[1]))
    for x in target:
        t.update(map(bucket, features(x)[1]))
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + 10000.0) / ((s[b] + 1.0) * (t.total() + 10000.0)))) for b in range(10000)]
    rows = []
    for k, x in docs:
        w, f = features(x)
        weight = sum(gain[bucket(y)] for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append((k, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((r for r in rows if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    place = defaultdict(list)
    for n, r in enumerate(enough[: percent * len(enough) // 100]):
        place[r].append(n + 1)
    return sorted(((*r, place[r].pop(0) if place[r] else None) for r in rows), key=str)


@pytest.mark.parametrize("least_words, percent", [(20, 25), (1, 60), (5, 100), (10**6, 25)])
def test_resampling(spark, odd, docs, least_words, percent):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("text").unionByName(spark.createDataFrame([(None,), ("",)], "text string"))
    target = [r.text for r in benchmark.collect()]
    for df in (odd, docs):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        got = resample.resample(df, benchmark, least_words, percent)
        assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, got.collect()), key=str) == drawn(rows, target, least_words, percent)


def test_resampling_of_empty_tables(spark, none, docs):
    empty = spark.createDataFrame([], "text string")
    assert resample.resample(none, empty).count() == 0
    assert sorted(map(tuple, resample.resample(docs, empty).collect()), key=str) == drawn([(r.doc_id, r.text) for r in docs.collect()], [], 20, 25)


def audited(rows, least, top):
    texts = [(lang or "", source or "", Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", fold(x or "")))) for lang, source, x in rows]
    groups = sorted({(a, b) for a, b, _ in texts})
    df, n, total = Counter(), Counter(), Counter()
    for lang, source, c in texts:
        df.update((lang, t) for t in c)
        for t, k in c.items():
            n[lang, source, t] += k
            n[lang, t] += k
    kept = defaultdict(list)
    for (lang, t), k in df.items():
        if k >= least:
            kept[lang].append(t)
    for lang, source in groups:
        total[lang, source] = sum(n[lang, source, t] for t in kept[lang])
        total[lang] = sum(n[lang, t] for t in kept[lang])
    share = lambda c, total, v: 1 + 10**9 * (c + 2) // (total + 2 * v)
    apart = lambda p, q: (p - q) * (p - q) // (p + q)
    out = []
    for lang, source in groups:
        v = len(kept[lang])
        own = {t: share(n[lang, source, t], total[lang, source], v) for t in kept[lang]}
        pair = [(sum(apart(own[t], share(n[lang, o, t], total[lang, o], v)) for t in kept[lang]), o) for x, o in groups if x == lang and o != source]
        term = [(apart(own[t], q), t) for t in kept[lang] if n[lang, source, t] > 0 and own[t] > (q := share(n[lang, t], total[lang], v))]
        for part, found, most in (("pair", pair, len(pair)), ("term", term, top)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


ODD_AUDIT = [("en", "a", "One TWO zwölf x1y"), ("en", "a", None), ("en", "b", "two two"), ("en", None, "ONE two Zwölf"), (None, None, "one"), (None, "a", ""), ("fr", "a", "un deux"), ("fr", "b", "un"), ("fr", "c", "--"), ("en", "a", "One TWO zwölf x1y"), ("xx", "only", "alone"), ("en", "d", "word " * 30000), ("en", "b", "é\U0001f600\u200b one")]


@pytest.mark.parametrize("least, top", [(1, 10), (2, 2), (3, 10), (100, 10)])
def test_divergence(spark, docs, least, top):
    odd = spark.createDataFrame([(*r, 1, "v") for r in ODD_AUDIT], "lang string, source string, text string, p long, value string").repartition(4)
    for df in (odd, docs):
        rows = [(r.lang, r.source, r.text) for r in df.collect()]
        assert sorted(map(tuple, divergence.audit(df, least, top).collect())) == audited(rows, least, top)
    assert divergence.audit(odd.limit(0)).count() == 0


def test_sketch_never_underestimates_and_a_full_one_changes_nothing(spark, docs, monkeypatch):
    counts = defaultdict(Counter)
    for r in docs.collect():
        counts[r.lang].update(set(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", fold(r.text or ""))))
    rare = {}
    for bits in (16, 20):
        held = divergence.sketch(docs, 3, bits)
        df = spark.createDataFrame([(lang, "", t) for lang in counts for t in counts[lang]], "lang string, source string, text string").coalesce(1)
        passed = {(r.lang, r.term) for r in divergence.count_terms(df, held, bits).collect()}
        assert passed >= {(lang, t) for lang in counts for t, n in counts[lang].items() if n >= 3}
        rare[bits] = sum(counts[lang][t] < 3 for lang, t in passed)
    assert rare[20] <= rare[16] and rare[20] < 0.05 * sum(n < 3 for c in counts.values() for n in c.values())
    want = sorted(map(tuple, divergence.audit(docs, 3).collect()))
    monkeypatch.setattr(divergence, "plan_bits", lambda n: 16)
    monkeypatch.setattr(divergence, "possible", lambda held, key, bits: np.ones(len(key), bool))
    assert sorted(map(tuple, divergence.audit(docs, 3).collect())) == want


def test_resampling_cuts_each_text_once(docs, monkeypatch):
    # counting and scoring each cut and hashed all texts
    plans = []
    collect = resample.totals
    monkeypatch.setattr(resample, "totals", lambda t: plans.append(t) or collect(t))
    resample.resample(docs, docs.limit(5))
    corpus = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert corpus.count("FileScan") == 1 and "regexp_extract_all" not in corpus and "text" not in corpus.split("ReadSchema")[1]
    assert corpus.count("buckets") and plans[0].columns == ["doc_id", "n_words", "buckets"]


@pytest.mark.parametrize("name", ["op11_url_filter", "op12_resample", "op13_divergence"])
def test_same_rows_as_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = queries.QUERIES[name](spark, data)
    found = con.execute(queries.ORACLES[name])
    assert sorted(x[0] for x in found.description) == sorted(df.columns)
    at = [[x[0] for x in found.description].index(c) for c in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[k] for k in at)) for r in found.fetchall())
