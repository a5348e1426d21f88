"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is its lower-cased (A to Z) words; its k-mers are its windows of five words, labelled with
their occurrence number, so each labelled k-mer is unique in its text.  A text of one to four words
is one k-mer.  Each of ``SKETCHES`` hash functions picks the ``PICKS`` smallest labelled k-mers and
joins them in text order: two texts agree on a sketch only if they share those k-mers in that order,
which follows edit similarity rather than set overlap.

Texts with equal words are one class from the start (a 128-bit digest of the words), so copies cost
one aggregation.  Within a sketch bucket each class is paired with the bucket's two leaders, never
with every other one, and those links are verified and closed.  What shares a bucket but no component then
is verified as well: in small buckets every such pair, in large ones (a passage that many texts hold)
every such pair that passes an exact prefix filter, so no pair at the threshold is lost.

Verification aligns the two k-mer sequences: the longest chain of shared labelled k-mers that rises in
both texts and stays within the band that the threshold allows.  With chain length L and lengths m, n
the similarity is L / (m + n - L), the ordered form of Jaccard, and a link needs ``THRESHOLD``.

Defined cases: a null text is empty; a text without words links with nothing, not even another one;
rows that repeat an id and text are one document; extra columns are ignored by ``classes`` and
carried by ``deduplicate``; an empty table gives an empty result; ids may be null or repeat.  Rows are
told apart by id and text, so an id of several texts belongs to several classes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from reelweave.llm import _encode, _text
from reelweave.llm._shared import stars, written

WORDS = 5
THRESHOLD = 0.8
SKETCHES = 14
PICKS = 3
#: Buckets of so many classes are compared in full; the classes of larger ones go through the prefix filter.
SMALL = 8
#: Pairs of one leader that are verified together.
GROUP = 256
#: Most k-mers whose numbers of texts are broadcast for the prefix filter.
MOST_COMMON = 1 << 19
#: Hash classes in which k-mers are counted to bound what two texts can share.
ROOMS = 48
_MAX = ~np.uint64(0)
_ODD = np.random.default_rng(77).integers(1, 2**62, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def kmers(block: _text.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labelled k-mers in text order, their number in each document, word starts and word ends."""
    start, end = block.words()
    words = np.diff(np.searchsorted(start, block.end), prepend=0)
    h = block.hashes(start, end)
    count = np.where(words > 0, np.maximum(words - WORDS + 1, 1), 0)
    first = ragged_first(words, count)
    doc = np.repeat(np.arange(block.n), count)
    last = (np.cumsum(words))[doc]
    out = np.zeros(len(first), np.uint64)
    for k in range(WORDS):
        at = first + k
        inside = at < last
        out = (out + np.where(inside, h[np.minimum(at, len(h) - 1)] if len(h) else np.uint64(0), np.uint64(k + 1))) * np.uint64(0xD6E8FEB86659FD93)
    out = _text.mix(out)
    before, _ = _text.repeats(doc, out)
    return _text.mix(out + before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), count, start, end


def ragged_first(words: np.ndarray, count: np.ndarray) -> np.ndarray:
    """First word of each k-mer, as an index into all words."""
    return _text.ragged(np.cumsum(words) - words, count)


def sketches(labelled: np.ndarray, count: np.ndarray, n: int = SKETCHES, picks: int = PICKS) -> np.ndarray:
    """(documents with k-mers) x n sketch keys."""
    full = count[count > 0]
    starts = np.cumsum(full) - full
    out = np.empty((len(full), n), np.uint64)
    for j in range(n):
        g = (labelled ^ _ODD[0, j]) * _ODD[1, j]
        g ^= g >> np.uint64(32)
        places = np.full((picks, len(full)), len(labelled), np.int64)
        for p in range(picks):
            low = np.minimum.reduceat(g, starts)
            at = np.flatnonzero(g == np.repeat(low, full))
            at = at[g[at] != _MAX]
            doc = np.searchsorted(starts, at, side="right") - 1
            places[p, doc] = at
            g[at] = _MAX
        places.sort(axis=0)
        key = np.full(len(full), np.uint64(j + 1))
        for p in range(picks):
            inside = places[p] < len(labelled)
            key = _text.mix(key * np.uint64(3) + np.where(inside, labelled[np.minimum(places[p], len(labelled) - 1)], np.uint64(0)))
        out[:, j] = key
    return out


def digests(block: _text.Block, start: np.ndarray, end: np.ndarray) -> list[bytes | None]:
    """128-bit digest of each document's words; None without words."""
    keep = ~_text._SPACE[block.data]
    keep[end] = True  # one separator after each word
    data = np.where(_text._SPACE[block.data], np.uint8(32), block.data)[keep].tobytes()
    at = np.concatenate([[0], np.cumsum(keep)])
    bounds = zip(at[block.start].tolist(), at[block.end + 1].tolist(), strict=True)
    return [hashlib.blake2b(data[a:b].strip(), digest_size=16).digest() if b > a and data[a:b].strip() else None for a, b in bounds]


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, keys) of every row; digest and keys are null for texts without words."""

    @arrow_udf("struct<digest:binary,keys:array<long>>")
    def sign(texts: pa.Array) -> pa.Array:
        _encode.release()
        found, keys, sizes = [], [], []
        for block in _text.blocks(texts, fold=True, max_bytes=_text.SMALL_BYTES):
            labelled, count, start, end = kmers(block)
            found += digests(block, start, end)
            if len(labelled):
                keys.append(sketches(labelled, count).view(np.int64).ravel())
            sizes.append(np.where(count > 0, SKETCHES, 0))
        ends = np.concatenate([[0], *[np.cumsum(np.concatenate(sizes))]]) if sizes else np.zeros(1, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
        return pa.StructArray.from_arrays([pa.array(found, pa.binary()), lists], ["digest", "keys"])

    return docs.select("doc_id", sign(F.col("text").cast("string")).alias("s")).select("doc_id", "s.digest", "s.keys")


def alignment(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Similarity of two sequences of labelled k-mers by banded alignment; 0 where the threshold is out of reach."""
    m, n = len(a), len(b)
    need = threshold * (m + n) / (1 + threshold)  # least chain that can meet the threshold
    if min(m, n) < need - 1e-9:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(i) < need - 1e-9:
        return 0.0
    band = m + n - 2 * need + 1  # what the chain leaves out shifts it by no more
    inside = np.abs(i - j) <= band
    i, j = i[inside], j[inside]
    j = j[np.argsort(i)]
    if (j[1:] > j[:-1]).all():
        chain = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            at = bisect_left(tails, x)
            tails[at : at + 1] = [x]
        chain = len(tails)
    return chain / (m + n - chain)


def _sequences(texts: pa.Array) -> list[np.ndarray]:
    out = []
    for block in _text.blocks(texts, fold=True, max_bytes=_text.SMALL_BYTES):
        labelled, count, *_ = kmers(block)
        out += np.split(labelled, np.cumsum(count)[:-1])
    return out


def similarities(a: pa.Array, b: pa.Array) -> pa.Array:
    """Alignment similarity of two texts, row by row."""
    _encode.release()
    out = np.zeros(len(a))
    step = 64  # pairs at a time, so that memory follows a few texts
    for s in range(0, len(a), step):
        once = b.slice(s, step).fill_null("").dictionary_encode()  # a leader's text comes in many pairs of a group
        right = _sequences(once.dictionary)
        for k, (x, at) in enumerate(zip(_sequences(a.slice(s, step)), once.indices.to_pylist(), strict=True)):
            out[s + k] = alignment(x, right[at]) if len(x) and len(right[at]) else 0.0
    return pa.array(out)


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b) of digests those whose texts align well enough.

    b is a leader, if one of the two is: its pairs are dealt into groups of about ``GROUP``, each with a
    copy of its text, so a leader's partners are not aligned in one task.
    """

    @arrow_udf("double")
    def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
        return similarities(a, b)

    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    # leaders of several groups, at most one for GROUP pairs: a merge would bring all pairs of one together
    dealt = pairs.join(F.broadcast(parts.where("parts > 1")), "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), F.col("parts")), F.lit(0)).cast("int").alias("part"))
    left = texts.select(F.col("digest").alias("a"), F.col("text").alias("at"))
    right = texts.select(F.col("digest").alias("b"), F.col("text").alias("bt")).join(parts, "b").select("b", "bt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    both = dealt.join(left, "a").join(right, ["b", "part"])
    return both.withColumn("sim", similarity("at", "bt")).where(F.col("sim") >= threshold).select("a", "b")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, kept) of every row: class_id the smallest id of its component."""
    signed, verdict = _classified(docs, threshold)
    out = signed.select("doc_id", "digest").join(verdict, "digest", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def _classified(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, keys) of every row, and (digest, class_id, class_c) of every digest; class_c names the component."""
    signed = written(signatures(docs), "signatures")
    exact = written(signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("low"), F.first("keys").alias("keys")), "exact")
    postings = exact.select("digest", F.explode("keys").alias("key"))
    sizes = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # two leaders for each bucket: the class whose buckets are the fullest, so the middle of a group of
    # near copies, and one drawn by a hash that differs by bucket
    hub = postings.join(sizes, "key").groupBy("digest").agg(F.sum("n").alias("reach"), F.collect_list("key").alias("keys"))
    shared = hub.select("digest", "reach", F.explode("keys").alias("key"))
    lead = shared.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("reach", "digest")).alias("m"), F.min(F.struct(F.xxhash64("digest", "key").alias("h"), F.col("digest").alias("d"))).alias("r"))
    buckets = written(shared.join(lead.select("key", "n", F.array_distinct(F.array("m.digest", "r.d")).alias("leads")), "key").select("key", "n", "digest", "leads"), "buckets")
    led = buckets.select("digest", F.explode("leads").alias("lead")).where(F.col("digest") != F.col("lead"))
    # two leaders may be led by each other: such a pair counts once
    once = led.groupBy(F.least("digest", "lead"), F.greatest("digest", "lead")).agg(F.max("lead").alias("b"), F.min("digest").alias("x"), F.max("digest").alias("y"))
    first = written(once.select(F.when(F.col("x") == F.col("b"), F.col("y")).otherwise(F.col("x")).alias("a"), "b"), "pairs")
    # one text of each digest: tasks draw theirs first, which spreads copies
    rows = docs.select(F.col("text").cast("string").alias("text")).select("text", digest_of(F.col("text")).alias("digest"))
    near = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.first("text").alias("text"))
    texts = written(near.join(buckets.select("digest").distinct(), "digest", "left_semi"), "texts")
    links = written(_verified(first, texts, threshold), "links")
    joined = stars(links)
    # candidates that share a bucket but no component yet: all of them in small buckets
    member = written(buckets.join(_named(joined), "digest", "left").select("key", "n", "digest", F.coalesce("c", "digest").alias("c")), "members")
    rest = _small_pairs(member.where(F.col("n") <= SMALL))
    # and, of those whose bucket is large, all that can reach the threshold, by a prefix filter
    open_keys = member.where(F.col("n") > SMALL).groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    large = written(member.join(open_keys, "key", "left_semi").select("digest", "c").distinct(), "large")
    if not large.isEmpty():
        # written by itself: the driver holds the plan of one of them at a time
        rest = rest.unionByName(written(_apart_pairs(prefixes(large.join(texts, "digest"), threshold), threshold), "apart"))
    rest = written(rest.distinct().join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        more = written(_verified(rest, texts, threshold), "links")
        if not more.isEmpty():
            joined = stars(joined.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(more))
    named = exact.select("digest", "low").join(_named(joined), "digest", "left").select("digest", "low", F.coalesce("c", "digest").alias("c"))
    lows = named.groupBy("c").agg(F.min("low").alias("class_id"))
    verdict = written(named.join(lows, "c").select("digest", "class_id", F.col("c").alias("class_c")), "classes")
    return signed, verdict


def _named(joined: DataFrame) -> DataFrame:
    """(digest, c) of the stars of components."""
    return joined.select(F.col("u").alias("digest"), F.col("v").alias("c"))


def _small_pairs(member: DataFrame) -> DataFrame:
    """Pairs (a, b) of digests with a key in common that lie in different components c, of keys with ``SMALL`` members at most; pairs may repeat."""
    keyed = member.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.collect_list(F.struct("digest", "c")).alias("of")).where("lo <> hi")
    both = keyed.select("of", F.explode("of").alias("x")).select("x", F.explode("of").alias("y"))
    return both.where((F.col("x.digest") < F.col("y.digest")) & (F.col("x.c") != F.col("y.c"))).select(F.col("x.digest").alias("a"), F.col("y.digest").alias("b"))


def _apart_pairs(member: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b) of digests with a key in common that lie in different components c.

    Components are paired first, so members of one component are never paired with each other.  Pairs
    whose counts of k-mers by hash class (``shared``) leave no room for the threshold
    are left out as they are joined: first pairs of components, by the largest counts and the least
    sizes of their members, then a member and a component, then two members.
    """
    share = threshold / (1 + threshold) - 1e-9
    room = lambda s, t: F.aggregate(F.zip_with(s, t, lambda p, q: F.least(p, q)), F.lit(0), lambda a, x: a + x)
    fits = lambda s, t, m, n: room(F.col(s), F.col(t)) >= share * (F.col(m) + F.col(n))
    most = F.array(*[F.max(F.get("shared", F.lit(k))) for k in range(ROOMS)])
    sides = member.groupBy("key", "c").agg(F.min("size").alias("m"), most.alias("s"))
    one = sides.select("key", F.col("c").alias("ca"), F.col("m").alias("ma"), F.col("s").alias("sa"))
    two = sides.select(F.col("key").alias("k"), F.col("c").alias("cb"), F.col("m").alias("mb"), F.col("s").alias("sb"))
    apart = one.join(two, (F.col("key") == F.col("k")) & (F.col("ca") < F.col("cb")) & fits("sa", "sb", "ma", "mb")).select("key", "ca", "cb", "mb", "sb")
    left = member.select(F.col("key").alias("k"), F.col("c").alias("d"), F.col("digest").alias("x"), F.col("size").alias("m"), F.col("shared").alias("s"))
    half = apart.join(left, (F.col("key") == F.col("k")) & (F.col("ca") == F.col("d")) & fits("s", "sb", "m", "mb")).select("key", "cb", "x", "m", "s")
    right = member.select(F.col("key").alias("k"), F.col("c").alias("d"), F.col("digest").alias("y"), F.col("size").alias("n"), F.col("shared").alias("t"))
    both = half.join(right, (F.col("key") == F.col("k")) & (F.col("cb") == F.col("d")) & fits("s", "t", "m", "n"))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def prefixes(rows: DataFrame, threshold: float) -> DataFrame:
    """(key, digest, c, size, shared): of each text the k-mers that a partner at the threshold must share one of.

    ``size`` is the number of the text's k-mers; ``shared`` counts those that other texts may hold, by
    hash class.

    With k-mers in any fixed order, two texts of similarity ``threshold`` share one among the first
    n - ceil(threshold * n) + 1 of each.  The order used puts the rarest first, so a text that is not
    nearly all shared has only k-mers of its own there.  Numbers of texts are known for the
    ``MOST_COMMON`` most frequent k-mers at most; that bound decides the cost, never the result.
    """
    spark = rows.sparkSession

    def each(batches):
        for batch in batches:
            every = np.concatenate([np.zeros(0, np.uint64), *_sequences(batch.column(0))])
            yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64))], ["k"])

    counted = written(rows.select("text").mapInArrow(each, "k long").groupBy("k").agg(F.count("*").alias("n")).where("n > 1"), "kmers")
    # the lowest number of texts at which no more than MOST_COMMON k-mers are left
    level = F.least("n", F.lit(10_000)).alias("l")
    least, total = 2, 0
    for at, size in sorted(counted.groupBy(level).count().collect(), reverse=True):
        total += size
        if total > MOST_COMMON:
            least = at + 1
            break
    common = counted.where(F.col("n") >= least).toArrow()
    order = np.argsort(common.column(0).to_numpy().view(np.uint64))
    held = spark.sparkContext.broadcast((common.column(0).to_numpy().view(np.uint64)[order], common.column(1).to_numpy()[order]))

    whole = least <= 2  # every k-mer of two texts or more is known

    @arrow_udf("struct<keys:array<long>,size:int,shared:array<int>>")
    def prefix(texts: pa.Array) -> pa.Array:
        (known, texts_of), out, sizes, counts, others = held.value, [], [], [], []
        for x in _sequences(texts):
            n = len(x) - int(np.ceil(threshold * len(x) - 1e-9)) + 1 if len(x) else 0
            often = np.zeros(len(x), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                often = np.where(known[at] == x, texts_of[at], 0)
            out.append(x[np.lexsort([x, often])[:n]].view(np.int64))
            sizes.append(n)
            counts.append(len(x))
            kept = x[often > 0] if whole else x
            others.append(np.bincount((kept % np.uint64(ROOMS)).astype(np.int64), minlength=ROOMS).astype(np.int32))
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))
        return pa.StructArray.from_arrays([lists, pa.array(counts, pa.int32()), pa.array(others, pa.list_(pa.int32()))], ["keys", "size", "shared"])

    found = rows.select("digest", "c", prefix("text").alias("p")).where(F.aggregate("p.shared", F.lit(0), lambda a, x: a + x) >= threshold * F.col("p.size") - 1e-9)
    return written(found.select("digest", "c", "p.size", "p.shared", F.explode("p.keys").alias("key")), "prefixes")


def digest_of(text: Column) -> Column:
    """Digest of a text's words, null without words."""

    @arrow_udf("binary")
    def own(texts: pa.Array) -> pa.Array:
        _encode.release()
        found = []
        for block in _text.blocks(texts, fold=True, max_bytes=_text.SMALL_BYTES):
            found += digests(block, *block.words())
        return pa.array(found, pa.binary())

    return own(text.cast("string"))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class, columns as they were; texts without words stay.

    The row that stays has the class's smallest id, and of several texts with that id the one with the
    smallest digest; of rows equal in both any one.  A class whose ids are all null keeps one row.
    """
    signed, verdict = _classified(docs.select("doc_id", "text"), threshold)
    named = signed.join(verdict, "digest", "left")
    gone = named.where(~F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("digest").isNotNull()).select("doc_id").distinct()
    # ids of several rows, and null, are decided row by row
    repeated = written(signed.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    apart = docs.join(gone.unionByName(repeated).where("doc_id IS NOT NULL").distinct(), "doc_id", "left_anti").where("doc_id IS NOT NULL").select(*docs.columns)
    key, chosen = "_digest", "_chosen"
    while key in docs.columns or chosen in docs.columns:
        key, chosen = f"_{key}", f"_{chosen}"
    several = docs.join(repeated.where("doc_id IS NOT NULL"), "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
    least = signed.where("digest IS NOT NULL").select("doc_id", "digest").distinct().join(verdict, "digest").where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    least = least.groupBy("class_c").agg(F.min("digest").alias(key)).select(key, F.lit(True).alias(chosen))
    ids = verdict.select(F.col("digest").alias(key), F.col("class_id").alias(f"{chosen}_id"))
    rows = several.withColumn(key, digest_of(F.col("text"))).join(least, key, "left").join(ids, key, "left")
    right = F.col(chosen) & F.col("doc_id").eqNullSafe(F.col(f"{chosen}_id"))
    return apart.unionByName(rows.where(right).dropDuplicates([key]).select(*docs.columns)).unionByName(rows.where(F.col(key).isNull()).select(*docs.columns))
