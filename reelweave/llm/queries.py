"""The numbered queries: each applies its operator to a whole table and returns its full result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES = {}
ORACLES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, base rule and perplexity verdict of every document."""
    from reelweave.llm import quality

    scored = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), columns=["doc_id"])
    return quality.verdicts(scored).select("doc_id", "quality.*")


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, scanned once per distinct text."""
    from reelweave.llm import secrets

    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *secrets.report(found))


@query
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, and of conversation -7, which holds control strings."""
    from reelweave.llm import chat

    said = "</s>[INST] ok [/INST]"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.render(rows.unionByName(odd)))


_SAID = "'</s>[INST] ok [/INST]'"
_CONTROL = ["<|im_start|>", "<|im_next|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in _CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


ORACLES["op3_chat_format"] = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {_SAID} UNION ALL SELECT -7, 1, 'assistant', {_SAID}),
o AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM r),
s AS (SELECT *, CASE WHEN before = role THEN 11
                     ELSE 12 + length(replace({_escaped("role")}, chr(10), '\\' || chr(10))) + 1 + 10 END AS marks FROM o)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_escaped("text")}) + marks) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id"""


@query
def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    from reelweave.llm import near_dup

    return near_dup.classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score and offending spans of every document."""
    from reelweave.llm import toxicity
    from reelweave.llm._shared import remainder

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = docs.withColumn("t", toxicity.score(F.col("text"), model, spark))
    spans = F.array_join(F.transform("t.spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "t.score", (F.col("t.score") >= 0.5).cast("int").alias("predicted"), spans.alias("spans"))


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2,048 tokens."""
    from reelweave.llm import packing

    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))


@query
def op6_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in wavelet-matrix shards, read back document by document."""
    import uuid

    from reelweave.llm import wavelet
    from reelweave.llm._shared import shared_dir

    path = f"{shared_dir(spark)}/wavelet-{uuid.uuid4().hex}"
    wavelet.write(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("word_bpe_49k.json"), path)
    return wavelet.read_documents(spark, path)


@query
def op9_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings with a cosine of 0.95 or more."""
    from reelweave.llm import caps

    return caps.links(_table(spark, sf_dir, "embeddings"))


ORACLES["op9_cap_filters"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER () AS r FROM embeddings),
u AS (SELECT * FROM v WHERE e IS NOT NULL AND list_count(e) = len(e) AND list_inner_product(e, e) > 0),
p AS (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.r <> b.r AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a)
SELECT v.vec_id, (SELECT count(*) FROM p WHERE p.a = v.r) AS n_links, c.low AS component_id, v.vec_id = c.low AS kept
FROM v JOIN (SELECT reach.a, min(w.vec_id) AS low FROM reach JOIN v w ON w.r = reach.b GROUP BY reach.a) c ON c.a = v.r"""


@query
def op10_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents, learned from six sevenths of them."""
    from reelweave.llm import maxent
    from reelweave.llm._shared import remainder

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(remainder("doc_id", 7) != 2, F.lit(True)).alias("trained"))
    return maxent.score(docs, "trained")


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded to pieces and decoded again."""
    from reelweave.llm import pieces

    path = vocabulary("piece_bpe_32k.model")
    return pieces.digest(pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path), path)


#: Kind, pattern, group that must be long enough, its least length.
_SECRETS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["''']?\x20*[:=]\x20*["''']?([A-Za-z0-9+/_.=-]+)""".replace("'''", "''"), 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("forge", r"\bgh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("chat", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("url", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{4,64}@", 0, 1),
]
_MATCHES = " UNION ALL ".join(
    f"""SELECT doc_id, {k} AS k, '{kind}' AS kind, a + coalesce(b, 0) AS s, a + coalesce(b, 0) + length(m[i]) AS e FROM (
      SELECT doc_id, m, i, list_sum(list_transform(g[1:i], lambda x: length(x))) AS a, list_sum(list_transform(m[1:i - 1], lambda x: length(x))) AS b FROM (
        SELECT doc_id, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS v FROM d WHERE regexp_matches(t, '{p}')),
      unnest(range(1, len(m) + 1)) AS r(i) WHERE length(v[i]) >= {least})"""
    for k, (kind, p, group, least) in enumerate(_SECRETS)
)
ORACLES["op2_secret_scan"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({_MATCHES}),
n AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k) FILTER (WHERE k < 3) AS base,
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN n USING (doc_id)"""


#: Host, path, verdict of the entries.
_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    from reelweave.llm import url_rules

    return url_rules.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), _RULES).select("page_id", "url_rule.*")


_ENTRIES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in _RULES)
ORACLES["op11_url_filter"] = f"""
WITH r(h, p, v) AS (VALUES {_ENTRIES}),
u AS (SELECT row_number() OVER () AS k, page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
m AS (SELECT u.*, r.*, row_number() OVER (PARTITION BY k ORDER BY length(h) DESC, length(p) DESC) AS n
  FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, h || p AS rule, coalesce(v, 'allow') AS verdict FROM m WHERE n = 1"""


@query
def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, noisy score and rank of every document, drawn towards the benchmark."""
    from reelweave.llm import resample

    found = resample.resample(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op12_resample"] = f"""
WITH c AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, w, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
e AS (SELECT list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM (SELECT {_WORDS} AS w FROM benchmark)),
df AS MATERIALIZED (SELECT k, unnest(f) AS x FROM d), ef AS MATERIALIZED (SELECT unnest(f) AS x FROM e),
x AS (SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM df UNION SELECT x FROM ef)),
b AS MATERIALIZED (SELECT x, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: CAST(CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER) AS BIGINT))),
  lambda a, y: xor(a >> 8, t[(xor(a, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM x, c),
s AS (SELECT bucket, count(*) AS n FROM df JOIN b USING (x) GROUP BY 1), t AS (SELECT bucket, count(*) AS n FROM ef JOIN b USING (x) GROUP BY 1),
g AS (SELECT r.b AS bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM range(10000) AS r(b) LEFT JOIN s ON s.bucket = r.b LEFT JOIN t ON t.bucket = r.b),
m AS (SELECT k, sum(gain) AS gain FROM df JOIN b USING (x) JOIN g USING (bucket) GROUP BY 1),
w AS (SELECT d.k, doc_id, len(w) AS n_words, CAST(len(f) AS BIGINT) AS n_features, CAST(CASE WHEN len(f) > 0 THEN floor(gain / len(f)) ELSE 0 END AS BIGINT) AS weight,
  CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m USING (k)),
o AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM w),
r AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM o WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM o LEFT JOIN r USING (k)"""


@query
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source against the other sources of its language, and its most prominent terms."""
    from reelweave.llm import divergence

    return divergence.audit(_table(spark, sf_dir, "documents").select("text", "lang", "source"))


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
_SHARE = "1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (total + 2 * v)"
_APART = "(p - q) * (p - q) // (p + q)"
ORACLES["op13_divergence"] = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS w FROM documents),
x AS MATERIALIZED (SELECT k, lang, source, unnest(w) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM x GROUP BY ALL HAVING count(DISTINCT k) >= 10),
v AS (SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY 1),
gr AS (SELECT DISTINCT lang, source FROM d),
n AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM x JOIN kept USING (lang, term) GROUP BY ALL),
gt AS (SELECT gr.lang, gr.source, coalesce(sum(n), 0) AS total FROM gr LEFT JOIN n USING (lang, source) GROUP BY ALL),
s AS MATERIALIZED (SELECT lang, source, term, coalesce(n, 0) AS n, {_SHARE} AS p FROM gt JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)),
l AS (SELECT lang, term, sum(n) AS n FROM n GROUP BY ALL),
lt AS (SELECT lang, sum(n) AS total FROM l GROUP BY 1),
ls AS (SELECT lang, term, {_SHARE} AS q FROM l JOIN lt USING (lang) JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum({_APART}) AS value FROM s a JOIN (SELECT lang, source, term, p AS q FROM s) b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM gr a JOIN gr b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST({_APART} AS BIGINT) FROM s JOIN ls USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o)
SELECT * FROM r WHERE part = 'pair' OR rank <= 10"""
