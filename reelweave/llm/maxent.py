"""A hashed maximum-entropy language model with a class-factored softmax.

Tokens are lower-cased (A to Z) words and one end for each text.  A word belongs to one of
``CLASSES`` classes by its ending and to one of ``PARTS`` parts of the class by its beginning, so an
unseen word has its place too; the end has a class of its own.  With history h

    P(w | h) = P(class | h) * P(part | class, h) * (c + 1) / (N_leaf + V_leaf + 1)

where both softmaxes are maximum-entropy models over hashed features of the history: the leaf (class
and part) of the last word, as a skip the leaf of the word before it, the last word, and the last two
words, the last two hashed; c, N and V are the training counts of the word, of its leaf's tokens and of its leaf's words,
the 1 being the leaf's unseen word.

Training takes ``ROUNDS`` rounds over parts of the training texts, dealt by a hash of the text.  In each
round every task sums, for each feature row and outcome, how often the outcome followed and how often
the weights at hand expect it; Spark adds these sums, and each weight moves by ``RATE`` times the
logarithm of their ratio (iterative scaling, smoothed by ``PRIOR``).  Nothing is learnt inside a task,
so the model does not depend on how the texts are partitioned.  The tables of hashed features grow with
the training tokens, about one row for 6,000 tokens, up to 2**MOST_BITS rows for a family; these
weights are all that reaches the driver.

Word counts are exact for all words.  The ``HEAD`` most frequent words at most are broadcast; tokens of
other words leave the scoring pass as (word hash, number) and meet their counts in a join.  Words are
identified by 64-bit hashes.

Defined cases: a null or empty text is the end alone; repeated rows are scored one by one; without
training texts all counts are 0 and the weights are 0; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelweave.llm import _encode, _text
from reelweave.llm._shared import written

CLASSES = PARTS = 16
LEAVES = CLASSES * PARTS
HEAD = 1 << 20
LEAST_BITS, MOST_BITS = 8, 16
ROUNDS, RATE, PRIOR = 4, 0.6, 4.0
BATCH = 1 << 16
END = np.uint64(0x5851F42D4C957F2D)
END_LEAF = LEAVES - PARTS  # the last class, of which the end is the only member


def tokens(block: _text.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and leaf of each token, ends included, and the number of tokens of each document."""
    start, end = block.words()
    n = np.diff(np.searchsorted(start, block.end), prepend=0) + 1
    at = np.ones(len(start) + block.n, bool)
    at[np.cumsum(n) - 1] = False
    h, leaf = np.full(len(at), END), np.full(len(at), END_LEAF, np.int64)
    h[at] = block.hashes(start, end)
    tail = block.hashes(np.maximum(start, end - 2), end) % np.uint64(CLASSES - 1)
    head = block.hashes(start, np.minimum(end, start + 2)) % np.uint64(PARTS)
    leaf[at] = (tail * np.uint64(PARTS) + head).astype(np.int64)
    return h, leaf, n


def bits_for(tokens_: int) -> int:
    """Bits of a hashed feature for so many training tokens."""
    return min(max(int(math.log2(max(tokens_, 1)) - 12.5), LEAST_BITS), MOST_BITS)


def starts(bits: int) -> list[int]:
    """First rows of the families of the class softmax, then of the part softmax, whose rows are of a feature and a class; all rows."""
    sizes = [LEAVES + 1, LEAVES + 1, 1 << bits, 1 << bits]
    return np.concatenate([[0], np.cumsum([*sizes, sizes[0] * CLASSES, sizes[1] * CLASSES, 2 << bits, 2 << bits])]).tolist()


def features(h: np.ndarray, leaf: np.ndarray, n: np.ndarray, bits: int) -> np.ndarray:
    """Row of each token's history in each family, for both softmaxes (8 x tokens)."""
    place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    one, two = np.zeros_like(h), np.zeros_like(h)
    one[1:], two[2:] = h[:-1], h[:-2]
    one[place < 1], two[place < 2] = 0, 0
    out = np.empty((8, len(h)), np.int64)
    out[:2] = LEAVES
    out[0, 1:], out[1, 2:] = leaf[:-1], leaf[:-2]
    out[0, place < 1], out[1, place < 2] = LEAVES, LEAVES
    short = np.uint64(64 - bits)
    out[2] = (_text.mix(one) >> short).astype(np.int64)
    out[3] = (_text.mix(one * np.uint64(3) + _text.mix(two)) >> short).astype(np.int64)
    out[4:] = out[:4] * CLASSES + leaf // PARTS
    out[6:] = (_text.mix(out[6:].astype(np.uint64)) >> (short - np.uint64(1))).astype(np.int64)
    return out + np.array(starts(bits)[:8])[:, None]


def _softmax(w: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Probabilities of the outcomes (16 x tokens: each step of numpy then runs over all tokens, not over 16 numbers)."""
    x = w.take(rows[0], 0)
    more = np.empty_like(x)
    for r in rows[1:]:
        x += w.take(r, 0, more, "clip")
    x = np.ascontiguousarray(x.T)
    x -= x.max(0)
    np.exp(x, out=x)
    x /= x.sum(0)
    return x


class Model:
    """Weights of both softmaxes and, once counted, the leaves' log10 totals."""

    def __init__(self, bits: int):
        self.bits, self.starts = bits, starts(bits)
        self.w = np.zeros((self.starts[-1], 16), np.float32)
        self.leaf_log = np.zeros(LEAVES)

    def log10(self, h: np.ndarray, leaf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 of P(class | h) P(part | class, h) / (N_leaf + V_leaf + 1) for each token."""
        rows, out = features(h, leaf, n, self.bits), np.empty(len(h))
        for s in range(0, len(h), BATCH):
            r, f = rows[:, s : s + BATCH], leaf[s : s + BATCH]
            at = np.arange(len(f))
            p = _softmax(self.w, r[:4])[f // PARTS, at].astype(np.float64)
            # the end is the only leaf of its class
            q = np.where(f == END_LEAF, 1.0, _softmax(self.w, r[4:])[f % PARTS, at])
            out[s : s + BATCH] = np.log10(p * q) - self.leaf_log[f]
        return out

    def add(self, rows: np.ndarray, leaf: np.ndarray, seen: np.ndarray, expected: np.ndarray) -> None:
        """Add outcomes and expected outcomes of some tokens to the sums of each row (16 x rows)."""
        inner = leaf != END_LEAF
        for first, r, y in ((0, rows[:4], leaf // PARTS), (4, rows[4:, inner], leaf[inner] % PARTS)):
            p = _softmax(self.w, r).astype(np.float64)
            for family, row in enumerate(r, first):
                a, b = self.starts[family], self.starts[family + 1]
                row = row - a
                seen[:, a:b] += np.bincount(y * (b - a) + row, minlength=16 * (b - a)).reshape(16, -1)
                for c in range(16):  # one outcome's sums of a family stay in the processor's cache
                    expected[c, a:b] += np.bincount(row, p[c], b - a)

    def move(self, row: np.ndarray, seen: np.ndarray, expected: np.ndarray) -> None:
        """One step of iterative scaling on some rows."""
        self.w[row] += (RATE * np.log((seen + PRIOR) / (expected + PRIOR))).astype(np.float32)


def train(docs: DataFrame, tokens_: int) -> Model:
    """Weights from all texts of docs, which have so many tokens: see the module."""
    spark, model = docs.sparkSession, Model(bits_for(tokens_))
    names = [f"{k}{c}" for k in "se" for c in range(16)]
    schema = "row int, " + ", ".join(f"{x} float" for x in names)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(text.alias("text"), F.pmod(F.xxhash64(text), F.lit(ROUNDS)).alias("round"))
    tasks = rows.rdd.getNumPartitions()
    # a round has its share of the tasks, so that what they return does not grow with the rounds
    tasks = max(min(tasks, 2 * spark.sparkContext.defaultParallelism), tasks // ROUNDS)
    for k in range(ROUNDS):
        held = spark.sparkContext.broadcast(model)

        def run(batches, held=held):
            _encode.release()
            m = held.value
            seen, expected = np.zeros(m.w.shape[::-1]), np.zeros(m.w.shape[::-1])
            for batch in batches:
                for block in _text.blocks(batch.column(0), fold=True):
                    h, leaf, n = tokens(block)
                    rows = features(h, leaf, n, m.bits)
                    for s in range(0, len(h), BATCH):
                        m.add(rows[:, s : s + BATCH], leaf[s : s + BATCH], seen, expected)
            at = np.flatnonzero(expected.any(0))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(x[c, at].astype(np.float32)) for x in (seen, expected) for c in range(16)]], ["row", *names])

        got = rows.where(F.col("round") == k).select("text").coalesce(tasks).mapInArrow(run, schema).groupBy("row").agg(*[F.sum(x).alias(x) for x in names]).toArrow()
        if got.num_rows:
            table = np.stack([got.column(x).to_numpy() for x in names], 1)
            model.move(got.column("row").to_numpy(), table[:, :16], table[:, 16:])
        held.unpersist()
    return model


def count(docs: DataFrame) -> DataFrame:
    """(word, leaf, c): the count of every token of docs, by hash."""
    from reelweave.llm.quality import Memo

    def rows(h, leaf, c):
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(leaf.astype(np.int32)), pa.array(c.astype(np.int64))], ["word", "leaf", "c"])

    def run(batches):
        _encode.release()
        memo = Memo(20)
        total, leaves = np.zeros(1 << 20, np.int64), np.zeros(1 << 20, np.int16)
        held: list = []
        for batch in batches:
            for block in _text.blocks(batch.column(0), fold=True):
                h, leaf, _ = tokens(block)
                at, hit, _ = memo.slots(h)
                total += np.bincount(at[hit], minlength=len(total))
                leaves[at[hit]] = leaf[hit]
                u, first, c = np.unique(h[~hit], return_index=True, return_counts=True)
                held.append((u, leaf[~hit][first], c))
                if sum(len(x[0]) for x in held) > 1 << 20:
                    for x in held:
                        yield rows(*x)
                    held = []
        for x in held:
            yield rows(*x)
        used = np.flatnonzero(total)
        yield rows(memo.keys[used], leaves[used], total[used])

    got = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word long, leaf int, c long")
    return got.groupBy("word").agg(F.first("leaf").alias("leaf"), F.sum("c").alias("c"))


def score(docs: DataFrame, trained: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``trained`` is a boolean column of docs that marks the training rows.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string").alias("text")
    vocab = written(count(docs.where(trained).select("text")), "vocabulary")
    n, v = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    model = train(docs.where(trained).select("text"), n)
    model.leaf_log[:] = 0.0
    for leaf, ln, lv in vocab.groupBy("leaf").agg(F.sum("c"), F.count("*")).collect():  # LEAVES rows
        model.leaf_log[leaf] = math.log10(ln + lv + 1)
    # the head: words at or above the lowest count level at which they are no more than HEAD
    level = F.floor(F.log2("c") * 16).cast("int")
    below, least = 0, None
    for at, size in sorted(vocab.groupBy(level.alias("l")).count().collect(), reverse=True):  # 16 levels for each bit
        if below + size > HEAD:
            break
        below, least = below + size, at
    top = vocab.where(level >= least).select("word", "c").toArrow() if least is not None else None
    whole = below == v
    words, counts = (top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()) if top else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    order = np.argsort(words)
    held = spark.sparkContext.broadcast((model, words[order], np.log10(counts[order] + 1.0)))

    def run(batches):
        _encode.release()
        m, known, logs = held.value
        part, row = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            names = batch.column(0)
            for block in _text.blocks(batch.column(2), fold=True):
                h, leaf, size = tokens(block)
                doc = np.repeat(np.arange(block.n), size)
                u, of = np.unique(h, return_inverse=True)
                at = np.minimum(np.searchsorted(known, u), max(len(known) - 1, 0))
                hit = known[at] == u if len(known) else np.zeros(len(u), bool)
                value = np.where(hit, logs[at], 0.0) if len(known) else np.zeros(len(u))
                inside = hit[of]
                head = np.bincount(doc, value[of], block.n)
                seen = np.bincount(doc[inside], minlength=block.n)
                context = np.bincount(doc, m.log10(h, leaf, size), block.n)
                rest = np.flatnonzero(~inside) if not whole else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[rest], minlength=block.n))]).astype(np.int32)), pa.array(h[rest].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part + row + np.arange(block.n)), names.slice(block.first, block.n), batch.column(1).slice(block.first, block.n), pa.array(size), pa.array(seen), pa.array(head), pa.array(context), lists],
                    ["row", "doc_id", "held_out", "n_tokens", "seen", "head", "context", "rest"],
                )
                row += block.n

    first = docs.select("doc_id", (~F.col(trained)).alias("held_out"), text)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = written(first.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, seen long, head double, context double, rest array<long>"), "scored")
    out = scored.drop("rest")
    if not whole:
        uses = scored.select("row", F.explode("rest").alias("word"))
        found = uses.join(vocab.select("word", "c"), "word").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("tail"))
        out = out.join(found, "row", "left")
    else:
        out = out.withColumns({"more": F.lit(0), "tail": F.lit(0.0)})
    logs = F.col("head") + F.coalesce("tail", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("seen") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
        (logs + F.col("context")).alias("score"),
    )
