"""Secret scans over an incremental ledger of blobs, with DataFrame expressions only.

Every historical version of a file is addressed by the SHA-256 of its text (its blob).  The ledger is
a Parquet table of (rule_version, blob, findings) in a folder the caller names.  A scan takes the
distinct blobs of the versions at hand, drops the (blob, rule version) pairs that the ledger has,
scans each remaining text once and appends; ``findings`` then joins the ledger back to every path and
version that holds the blob.

A finding is a span in code points, end exclusive.  Positions come from the gaps between matches, so
one pass of a pattern over a text gives them all.

A finding names the place of a secret; what ``redact`` masks is the secret itself, by ``MASKED``: a
private key from its first line over its body to its last one, or to the end of the body where that is
missing, and passwords of any length in addresses.

Defined cases: a null text is empty, an empty text has no finding; equal texts share one scan however
many rows hold them; repeated rows are reported one by one; other columns are carried along by
``scan`` and ``redact``, whose own columns take names that the input does not have; an empty table gives
an empty result and leaves the ledger as it is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelweave.functions.text import bound
from reelweave.llm._lists import running, substrings
from reelweave.llm._shared import shared_dir

#: Kinds in their order, their patterns, the group that must be long enough, its least length.
RULES = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("forge", r"\bgh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("chat", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("url", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{4,64}@", 0, 1),
]
#: Rules of what is masked: as RULES, but a key has its body and an address a password of any length.
_KEY_HEADERS = r"(?:\s*+[A-Za-z][A-Za-z0-9-]*+:\x20[^\n]*+)*+"
_KEY_BODY = r"""(?:(?:[\s>|*#"',]|\\[nrt])*+(?:[A-Za-z0-9+/]{16,}+={0,2}+|[A-Za-z0-9+/]++={1,2}+))*+(?:\s*\n[\s>|*#]*[A-Za-z0-9+/]{1,15}+(?=\s*(?:\n|$)))?"""
_WIDER = {
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----(?:[^-]*+(?:-{1,4}+(?!-)[^-]*+)*+-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----|" + _KEY_HEADERS + _KEY_BODY + ")",
    "url": r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@]*+:[^\s:/@]{4,}+@",
}
MASKED = [(kind, _WIDER.get(kind, pattern), group, least) for kind, pattern, group, least in RULES]
#: A text without a match of this one can't have a match of that kind: shorter patterns than the rules'.
_SIEVE = {"hex": r"[0-9a-f]{32}", "access": "AKIA", "pem": "PRIVATE KEY", "jwt": r"eyJ[A-Za-z0-9_-]{8}", "forge": "gh[pousr]_", "chat": "xox[abprs]-", "url": "://"}
BASE = ("assign", "access", "hex")
RULE_VERSION = "2024.1"
MASK_VERSION = "2024.1-mask.1"
LEDGER_SCHEMA = "rule_version string, blob string, spans array<struct<start:int,kind:int,end:int>>"
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def spans(text: Column, rule: int, rules: list = RULES) -> Column:
    """All spans of one rule in a text that is not null."""
    kind, pattern, group, least = rules[rule]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    found = F.arrays_zip(F.transform(whole, F.char_length).alias("n"), F.transform(value, F.char_length).alias("v"), gaps.alias("g"))
    # gaps has one more item than there are matches; its row has no length
    def placed(all_):
        before = running(F.transform(all_, lambda x: (x["g"] + F.coalesce(x["n"], F.lit(0))).cast("int")))
        span = lambda x, at: F.when(x["v"] >= least, F.struct((at + x["g"]).cast("int").alias("start"), F.lit(rule).alias("kind"), (at + x["g"] + x["n"]).cast("int").alias("end")))
        return F.filter(F.zip_with(all_, before, span), lambda s: s.isNotNull())

    sieve = text.rlike(_SIEVE.get(kind, pattern))
    return F.when(sieve, bound(found, placed).cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def find(text: Column, rules: list = RULES) -> Column:
    """Spans of all rules, ordered by start, then kind."""
    return F.array_sort(F.concat(*[spans(text, k, rules) for k in range(len(rules))]))


def blob_of(text: Column) -> Column:
    """Content address: SHA-256 of the text's UTF-8 bytes; null as empty."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def ledger_at(spark, path: str) -> DataFrame:
    """The ledger in a folder; an empty one where the folder has none yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        spark.createDataFrame([], LEDGER_SCHEMA).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def update(versions: DataFrame, ledger: str, rule_version: str = RULE_VERSION, text: str = "text", rules: list = RULES) -> DataFrame:
    """Scan the blobs of ``versions`` that the ledger lacks under this rule version; returns the ledger.

    One text per blob reaches the patterns: copies are combined before the shuffle, and known blobs
    are dropped by an anti-join on the address alone.
    """
    spark = versions.sparkSession
    known = ledger_at(spark, ledger).where(F.col("rule_version") == rule_version).select("blob")
    held = F.coalesce(F.col(text).cast("string"), F.lit(""))
    blobs = versions.select(blob_of(F.col(text)).alias("blob"), held.alias("text")).where(F.length("text") > 0)
    unseen = blobs.join(known, "blob", "left_anti").groupBy("blob").agg(F.first("text").alias("text"))
    scanned = unseen.select(F.lit(rule_version).alias("rule_version"), "blob", find(F.col("text"), rules).alias("spans"))
    scanned.write.mode("append").parquet(ledger)
    return spark.read.schema(LEDGER_SCHEMA).parquet(ledger).where(F.col("rule_version") == rule_version)


def scan(versions: DataFrame, ledger: str | None = None, rule_version: str = RULE_VERSION, text: str = "text", out: str = "spans", rules: list = RULES) -> DataFrame:
    """Every row of versions with the spans of its text.

    Blobs without findings stay in the ledger as seen, but only those with findings are joined, so
    the join's small side is as small as the secrets are rare; hot blobs are many rows of the other
    side, which adaptive execution splits.  Empty texts get keys of their own that match nothing.  A
    pair that two scans at once, or a scan run again, put into the ledger twice counts once.
    """
    ledger = ledger or f"{shared_dir(versions.sparkSession)}/ledger-{uuid.uuid4().hex}"
    seen = update(versions, ledger, rule_version, text, rules)
    key = "_blob"
    while key in versions.columns:
        key = f"_{key}"
    hits = seen.where(F.size("spans") > 0).select(F.col("blob").alias(key), F.col("spans").alias(out)).dropDuplicates([key])
    nothing = F.concat(F.lit("-"), F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("string"))
    rows = versions.withColumn(key, F.when(F.length(F.col(text).cast("string")) > 0, blob_of(F.col(text))).otherwise(nothing))
    return rows.join(hits, key, "left").withColumn(out, F.coalesce(out, F.array().cast(_SPAN))).drop(key)


def _named(x: Column) -> Column:
    kind = F.element_at(F.array(*[F.lit(k) for k, *_ in RULES]), x["kind"] + 1)
    return F.concat_ws(":", kind, x["start"].cast("string"), x["end"].cast("string"))


def report(scanned: DataFrame, spans_col: str = "spans") -> list[Column]:
    """Counts of the base kinds, digest of the base spans and all spans as text."""
    s = F.col(spans_col)
    base = F.filter(s, lambda x: x["kind"] < len(BASE))
    count = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    listed = F.array_join(F.transform(base, _named), ",")
    return [*counts, F.sha2(listed.cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform(s, _named), ",").alias("spans")]


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with every span of ``MASKED`` in ``text`` replaced by ``mask``, and ``n_chars`` set where that is a column.

    Overlapping spans become one.  A null text stays null.
    """
    name = "spans"
    while name in docs.columns:
        name = f"_{name}"
    found = scan(docs, rule_version=MASK_VERSION, out=name, rules=MASKED)
    text = F.col("text")

    def masked(spans_):
        # a span that starts inside an earlier one adds nothing; the others have the text since the furthest end before them
        before = running(F.transform(spans_, lambda x: x["end"]), lambda a, v: F.greatest(a, v))
        apart = F.filter(F.zip_with(spans_, before, lambda x, at: F.struct(at.alias("start"), x["start"].alias("end"))), lambda p: p["start"] <= p["end"])
        kept = F.transform(substrings(text, apart), lambda p: F.concat(p, F.lit(mask)))
        return F.concat(F.array_join(kept, ""), F.substring(text, F.array_max(F.transform(spans_, lambda x: x["end"])) + 1, F.char_length(text)))

    parts = bound(F.col(name), masked)
    changed = F.size(name) > 0
    out = found.withColumn("text", F.when(changed, parts).otherwise(text))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
