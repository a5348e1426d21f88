"""Source divergence audit: how each source's terms differ from its language's and from other sources'.

Terms are runs of letters (ASCII ones lower-cased); a language keeps the terms in at least ``least`` of its
documents.  A term's share in a group is a whole number, p = 1 + floor(10^9 (count + 2) / (N + 2 V)), and two shares
diverge by floor((p - q)^2 / (p + q)); all arithmetic is on integers and decimals.

Three steps:

* Sketch: each task keeps a count-min sketch of document frequencies, DEPTH rows of 2^bits cells that
  stop at ``least``; the cells of all tasks are added, shard by shard.  A sum never underestimates, so a term with a
  cell below ``least`` is in too few documents.  Of the merged cells one bit each is broadcast: 2 x 2^26 bits
  (16 MB) at most, by the number of documents; a fuller sketch lets more terms through and changes no result.
* Exact counts: terms that the sketch can't rule out are counted by (language, source, term) in each block, in
  each task and over all; document frequencies then say which are kept.
* Sparse joins: for two sources of a language only terms that both have are joined.  Terms that one lacks have
  one of few shares, so they are summed by distinct counts; terms that neither has are a product.

Defined cases: null text, language and source are empty strings; a group without terms still counts; repeated
rows are documents of their own; a language without kept terms has pairs of value 0; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelweave.llm import _text
from reelweave.llm._shared import bound_batches, written

LEAST, TOP = 10, 10
DEPTH, SHARD = 2, 1 << 16
LEAST_BITS, MOST_BITS = 18, 26
#: Texts are counted in blocks of so many bytes.
BLOCK = 4 << 20
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_BETWEEN = np.ones(256, bool)
_BETWEEN[0x41:0x5B] = _BETWEEN[0x61:0x7B] = _BETWEEN[0x80:] = False


def _salts(names: pa.Array) -> np.ndarray:
    """A 64-bit hash of each row's name; equal names are hashed once."""
    d = names.dictionary_encode()
    held = np.array([int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little") for v in d.dictionary.to_pylist()], np.uint64)
    return held[d.indices.to_numpy()]


class _Terms:
    """The distinct terms of each document of a block: key by language and term, place, document, count."""

    def __init__(self, block: _text.Block, langs: np.ndarray):
        start, end = block.words(_BETWEEN)
        doc = block.doc_of(start)
        key = _text.mix(block.hashes(start, end) ^ langs[block.first + doc])
        own = _text.mix(key + _text.mix(doc.astype(np.uint64)))
        _, at, self.count = np.unique(own, return_index=True, return_counts=True)
        self.key, self.doc, self.start, self.end = key[at], doc[at], start[at], end[at]


def _cells(key: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each key in each row of the sketch."""
    return [(key * odd >> np.uint64(64 - bits)).astype(np.int64) + (row << bits) for row, odd in enumerate(_ODD)]


def plan_bits(documents: int) -> int:
    """Cells of a row: about 32 to 64 for each document, within bounds."""
    return min(max((32 * documents).bit_length(), LEAST_BITS), MOST_BITS)


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def sketch(docs: DataFrame, least: int = LEAST, bits: int = LEAST_BITS) -> np.ndarray:
    """One bit for each cell: whether its sum over all documents reaches ``least`` (at most 255)."""
    shards = DEPTH << bits >> 16

    def count(batches):
        cells = np.zeros(DEPTH << bits, np.uint8)
        for batch in batches:
            langs = _salts(batch.column(0))
            for block in _text.blocks(batch.column(1), fold=True, max_bytes=BLOCK):
                key, n = np.unique(_Terms(block, langs).key, return_counts=True)
                for at in _cells(key, bits):
                    at, of = np.unique(at, return_inverse=True)
                    cells[at] = np.minimum(cells[at] + np.bincount(of, n), least)
        rows = cells.reshape(shards, SHARD)
        for shard in np.flatnonzero(rows.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([pa.compress(rows[shard].tobytes(), "zstd", asbytes=True)], pa.binary())], ["shard", "cells"])

    def merge(batches):
        last, total = None, np.zeros(SHARD, np.uint8)

        def told():
            if last is not None:
                yield pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["shard", "bits"])

        for batch in batches:
            for shard, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if shard != last:
                    yield from told()
                    last, total = shard, np.zeros(SHARD, np.uint8)
                more = np.frombuffer(pa.decompress(cells.as_buffer(), SHARD, "zstd"), np.uint8)
                total = np.minimum(total.astype(np.uint16) + more, least).astype(np.uint8)
        yield from told()

    bound_batches(docs.sparkSession)
    counted = docs.select(_blank("lang"), _blank("text")).mapInArrow(count, "shard int, cells binary")
    # a shard is merged in one pass over its rows, one for each task that had some of its terms
    merged = counted.repartition("shard").sortWithinPartitions("shard").mapInArrow(merge, "shard int, bits binary")
    held = np.zeros((shards, SHARD // 8), np.uint8)
    for r in merged.toLocalIterator():
        held[r["shard"]] = np.frombuffer(r["bits"], np.uint8)
    return held.ravel()


def possible(bits_held: np.ndarray, key: np.ndarray, bits: int) -> np.ndarray:
    """Whether the sketch allows each key the least document frequency."""
    ok = np.ones(len(key), bool)
    for at in _cells(key, bits):
        ok &= bits_held[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1
    return ok


def count_terms(docs: DataFrame, held: np.ndarray, bits: int) -> DataFrame:
    """(lang, source, term, n, docs) of all terms that the sketch allows, counted exactly."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(held)

    def run(batches):
        for batch in batches:
            langs, group = _salts(batch.column(0)), _salts(batch.column(1))
            for block in _text.blocks(batch.column(2), fold=True, max_bytes=BLOCK):
                t = _Terms(block, langs)
                ok = np.flatnonzero(possible(shared.value, t.key, bits))
                row = block.first + t.doc[ok]
                _, at, of = np.unique(_text.mix(t.key[ok] + _text.mix(group[row])), return_index=True, return_inverse=True)
                start, size = t.start[ok][at], (t.end - t.start)[ok][at]
                ends = np.append(0, np.cumsum(size)).astype(np.int32)
                terms = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(block.data[_text.ragged(start, size)])])
                row = pa.array(row[at])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row), terms, pa.array(np.bincount(of, t.count[ok], len(at)).astype(np.int64)), pa.array(np.bincount(of, minlength=len(at)).astype(np.int64))],
                    ["lang", "source", "term", "n", "docs"],
                )

    bound_batches(spark)
    rows = docs.select(_blank("lang"), _blank("source"), _blank("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 kept)); decimals, as 10^9 n may pass 64 bits; null where nothing is kept."""
    return F.expr(f"CASE WHEN {kept} > 0 THEN 1 + (CAST(1000000000 AS DECIMAL(10, 0)) * CAST({n} + 2 AS DECIMAL(20, 0))) div CAST({total} + 2 * {kept} AS DECIMAL(20, 0)) END")


def apart(p: str, q: str) -> str:
    """floor((p - q)^2 / (p + q)) as SQL: shares are at most 10^9 + 1, so it fits 64 bits."""
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources, and each source's ``top`` terms above its language's share."""
    bits = plan_bits(docs.count())
    counts = count_terms(docs, sketch(docs, least, bits), bits)
    over = Window.partitionBy("lang", "term")
    first = (F.row_number().over(over.orderBy("source")) == 1).cast("long")
    known = counts.select("*", F.sum("docs").over(over).alias("in_docs"), F.sum("n").over(over).alias("lang_n"), first.alias("first")).where(F.col("in_docs") >= least)
    kept = written(known.select("lang", "source", "term", "n", "lang_n", "first"), "terms")

    langs = kept.groupBy("lang").agg(F.sum("first").alias("v"), F.sum("n").alias("lang_total"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    groups = docs.select(_blank("lang"), _blank("source")).distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["total", "held", "v", "lang_total"]).withColumn("z", share("0", "total", "v"))
    groups = written(groups, "groups")

    shares = kept.join(groups.select("lang", "source", "total", "v", "lang_total", "z"), ["lang", "source"])
    shares = written(shares.select("lang", "source", "term", "z", share("n", "total", "v").alias("p"), share("lang_n", "lang_total", "v").alias("q")), "shares")

    ranked = lambda value: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc(value), "item"))
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(apart("p", "q")).alias("value"))
    terms = terms.withColumn("rank", ranked("value")).where(F.col("rank") <= top)

    # a's terms against a share that b has not: by a's distinct shares
    other = groups.select("lang", F.col("source").alias("other"), F.col("z").alias("y"))
    levels = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("c"))
    alone = levels.join(other, "lang").where("source <> other").groupBy("lang", "source", "other").agg(F.sum(F.expr(f"c * ({apart('p', 'y')})")).alias("alone"))
    # terms that both have: what they add to, less what was counted for each alone
    right = shares.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("o"), F.col("z").alias("y"))
    met = shares.select("lang", "term", "source", "p", "z").join(right, ["lang", "term"]).where("source < other")
    both = met.groupBy("lang", "source", "other").agg(F.count("*").alias("c"), F.sum(F.expr(f"{apart('p', 'o')} - {apart('p', 'y')} - {apart('z', 'o')}")).alias("both"))

    a = groups.select("lang", "source", "z", "held", "v")
    b = groups.select("lang", F.col("source").alias("other"), F.col("z").alias("y"), F.col("held").alias("other_held"))
    pairs = a.join(b, "lang").where("source < other").join(both, ["lang", "source", "other"], "left")
    pairs = pairs.join(alone, ["lang", "source", "other"], "left").join(alone.select("lang", F.col("source").alias("other"), F.col("other").alias("source"), F.col("alone").alias("other_alone")), ["lang", "source", "other"], "left")
    pairs = pairs.na.fill(0, ["c", "both", "alone", "other_alone"])
    value = F.expr(f"CASE WHEN v > 0 THEN alone + other_alone + both + (v - held - other_held + c) * ({apart('z', 'y')}) ELSE 0L END").alias("value")
    half = written(pairs.select("lang", "source", "other", value), "pairs")
    whole = half.select("lang", "source", F.col("other").alias("item"), "value").unionByName(half.select("lang", F.col("other").alias("source"), F.col("source").alias("item"), "value"))
    whole = whole.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", ranked("value"))
    return whole.unionByName(terms)
