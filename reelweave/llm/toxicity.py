"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are per document, so token labels come first: in a bounded sample of labelled documents
(``SAMPLE`` per label, drawn by a hash of the id whatever the texts' length, near copies dropped; where texts
pass ``MOST_CHARS`` in all the sample ends with fewer rows) a token is marked toxic if it stands in a toxic document and its word, or the word's beginning, is far likelier there than in clean
ones.  The field learns
these marks from hashed features (the word, its ends, its neighbours) and a 2 x 2 transition table;
training and scoring use exact forward-backward marginals.  A document's score is a logistic function
of its largest marginal and of the expected number of toxic tokens.

Tokens are maximal runs of ASCII letters and digits and of non-ASCII characters, A to Z lower-cased.
Forward-backward runs as a scan of 2 x 2 products over all tokens of a block of documents, documents
being kept apart by their first token, so a text of any length is scored whole.

Defined cases: a null text is empty; a text without tokens gets the score of no evidence; repeated
rows are scored one by one; labels of absent documents are ignored, of several labels of an id the
largest counts; without labels of both kinds every score is 0; an empty table gives an empty result;
other columns are ignored by ``score`` and carried by ``reject``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from reelweave.llm import _encode, _text
from reelweave.llm._shared import bound_batches, remainder

SAMPLE = {1: 600, 0: 1000}
#: The driver holds the sample, so it ends, in the order it was drawn in, where its texts pass so many characters.
MOST_CHARS = 16 << 20
BITS = 18
BLOCK = 1 << 18
#: Training goes through the sample in parts of so many tokens.
PART = 1 << 16
FEATURES = 6
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CONT = (np.arange(256) & 0xC0) == 0x80


def tokens(block: _text.Block) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end byte of each token."""
    full = _TOKEN[block.data]
    edge = np.flatnonzero(full[1:] != full[:-1]) + 1
    if len(full) and full[0]:
        edge = np.concatenate([[0], edge])
    return edge[::2], edge[1::2]


def features(block: _text.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature slots (FEATURES x tokens), documents, starts, ends, and hashes of words and of their first five bytes."""
    start, end = tokens(block)
    doc = block.doc_of(start)
    word = block.hashes(start, end)
    before, after = np.zeros_like(word), np.zeros_like(word)
    if len(word) > 1:
        same = doc[1:] == doc[:-1]
        before[1:] = np.where(same, word[:-1], np.uint64(0))
        after[:-1] = np.where(same, word[1:], np.uint64(0))
    head = block.hashes(start, np.minimum(end, start + 4))
    stem = block.hashes(start, np.minimum(end, start + 6))
    tail = block.hashes(np.maximum(start, end - 4), end)
    slots = np.empty((FEATURES, len(word)), np.int64)
    for k, h in enumerate((word, before, after, head, stem, tail)):
        slots[k] = (_text.mix(h + np.uint64(k + 1)) >> np.uint64(64 - BITS)).astype(np.int64) + (k << BITS)
    return slots, doc, start, end, np.stack([word, block.hashes(start, np.minimum(end, start + 5))])


def _times(a, b):
    """Products of 2 x 2 matrices held as four arrays, scaled so that the largest entry is 1."""
    p = a[0] * b[0] + a[1] * b[2]
    q = a[0] * b[1] + a[1] * b[3]
    r = a[2] * b[0] + a[3] * b[2]
    s = a[2] * b[1] + a[3] * b[3]
    top = np.maximum(np.maximum(p, q), np.maximum(r, s))
    return p / top, q / top, r / top, s / top


def scan(m: tuple, width: int = 32) -> tuple:
    """Running products m[0] m[1] ... m[t] of a sequence of 2 x 2 matrices, up to scale."""
    n = len(m[0])
    if n <= 1:
        return m
    rows = -(-n // width)
    grid = []
    for k, x in enumerate(m):
        full = np.full(rows * width, float(k in (0, 3)))
        full[:n] = x
        grid.append(full.reshape(rows, width).copy())
    for j in range(1, width):
        for g, v in zip(grid, _times(tuple(g[:, j - 1] for g in grid), tuple(g[:, j] for g in grid)), strict=True):
            g[:, j] = v
    if rows > 1:
        carry = scan(tuple(g[:, -1].copy() for g in grid), width)
        moved = _times(tuple(c[:-1, None] for c in carry), tuple(g[1:] for g in grid))
        for g, v in zip(grid, moved, strict=True):
            g[1:] = v
    return tuple(g.ravel()[:n] for g in grid)


def marginals(score: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """P(label 1) of each token; score is label 1's lead over label 0, first marks documents' first tokens.

    moves holds the logs of the transition table (from, to) by rows.
    """
    if not len(score):
        return score
    _, ahead, b0, b1 = _scans(score, first, moves)
    one, none = ahead[1] * b1, ahead[0] * b0
    return one / (one + none)


def expected(score: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals, and the expected number of each transition."""
    a, ahead, b0, b1 = _scans(score, first, moves)
    one, none = ahead[1] * b1, ahead[0] * b0
    cells = np.stack([ahead[i][:-1] * a[2 * i + j][1:] * (b0, b1)[j][1:] for i in (0, 1) for j in (0, 1)])[:, ~first[1:]]
    return one / (one + none), (cells / cells.sum(0)).sum(1)


def _by_parts(score: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``expected`` over some whole documents at a time, about PART tokens: the chain is cut between them anyway."""
    p, pair, starts = np.empty(len(score)), np.zeros(4), np.flatnonzero(first)
    cuts = np.unique(starts[np.searchsorted(starts, np.arange(0, starts[-1] + 1, PART))]) if len(starts) else starts
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(score)], strict=True):
        p[a:b], more = expected(score[a:b], first[a:b], moves)
        pair += more
    return p, pair


def _scans(score: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple:
    """Steps of the chain, forward products and backward vectors (scaled), by token."""
    r = np.exp(np.clip(score, -30, 30))
    t = np.exp(moves)
    # a document's first token is the same from either state, which cuts the chain
    a = np.where(first, 1.0, t[0]), np.where(first, 1.0, t[1]) * r, np.where(first, 1.0, t[2]), np.where(first, 1.0, t[3]) * r
    ahead = scan(a)
    # behind a token: the product of all later matrices times (1, 1)
    later = scan((a[0][::-1], a[2][::-1], a[1][::-1], a[3][::-1]))
    back = (later[0] + later[2])[::-1], (later[1] + later[3])[::-1]
    b0, b1 = np.append(back[0][1:], 1.0), np.append(back[1][1:], 1.0)
    scale = np.maximum(b0, b1)
    return a, ahead, b0 / scale, b1 / scale


@dataclass
class Tagger:
    """Feature weights, logs of the transitions, and the coefficients of the document score."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES << BITS, np.float32))
    moves: np.ndarray = field(default_factory=lambda: np.zeros(4))
    outer: np.ndarray | None = None

    def tag(self, block: _text.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        slots, doc, start, end, _ = features(block)
        score = self.weights[slots].sum(0, dtype=np.float64)
        first = np.ones(len(doc), bool)
        first[1:] = doc[1:] != doc[:-1]
        return marginals(score, first, self.moves), doc, start, end

    def evidence(self, p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Per document: 1, log odds of the largest marginal, log of the expected number of toxic tokens."""
        most = np.full(n, 1e-6)
        np.maximum.at(most, doc, np.clip(p, 1e-6, 1 - 1e-6))
        return np.stack([np.ones(n), np.log(most / (1 - most)) / 6, np.log1p(np.bincount(doc, p, n))], 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(x)) if self.outer is None else 1 / (1 + np.exp(-x @ self.outer))


def fit(texts: list[str], labels: np.ndarray, rates: tuple[float, float], steps: int = 40) -> Tagger:
    """Train on labelled texts; rates are the weights of a clean and of a toxic document of the sample."""
    model = Tagger()
    if len(set(labels.tolist())) < 2:
        return model
    parts, base = [], 0
    for block in _text.blocks(pa.array(texts), fold=True):
        slots, doc, _, _, word = features(block)
        parts.append((slots.astype(np.int32), doc + base, word))
        base += block.n
    slots, doc, word = np.concatenate([p[0] for p in parts], 1), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts], 1)
    marks = labels[doc] * (suspicious(word[0], doc, labels) | suspicious(word[1], doc, labels))
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    # Adam on the negative log-likelihood a token, with weight decay
    w, moves = np.zeros(FEATURES << BITS), np.zeros(4)
    used = np.unique(slots)
    at = np.stack([np.searchsorted(used, row).astype(np.int32) for row in slots])
    del parts, slots
    lead = lambda: sum(theta[row] for row in at)  # noqa: E731  a feature at a time: the driver holds a few arrays of the tokens
    theta, m, v = np.zeros(len(used) + 4), np.zeros(len(used) + 4), np.zeros(len(used) + 4)
    want = np.array([np.sum(~first[1:] & (marks[:-1] == a) & (marks[1:] == b)) for a in (0, 1) for b in (0, 1)])
    n = len(doc)
    for k in range(1, steps + 1):
        p, pair = _by_parts(lead(), first, theta[-4:])
        gap = sum(np.bincount(row, p - marks, len(used)) for row in at)
        g = np.concatenate([gap + 0.02 * theta[:-4], pair - want + 0.02 * theta[-4:]])
        m, v = 0.8 * m + 0.2 * g, 0.95 * v + 0.05 * g * g
        theta -= 0.5 * (m / (1 - 0.8**k)) / (np.sqrt(v / (1 - 0.95**k)) + 1e-3 * n**0.5 / 100)
    w[used] = theta[:-4]
    model.weights, model.moves = w.astype(np.float32), theta[-4:].copy()
    x = model.evidence(_by_parts(lead(), first, theta[-4:])[0], doc, len(labels))
    beta, weight = np.zeros(x.shape[1]), np.where(labels == 1, rates[1], rates[0])
    for _ in range(30):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-x @ beta))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(beta))
        beta += np.linalg.solve(h, x.T @ (weight * (labels - p)) - 0.1 * beta)
    model.outer = beta
    return model


def suspicious(word: np.ndarray, doc: np.ndarray, labels: np.ndarray, least: int = 5, lead: float = 3.0) -> np.ndarray:
    """Tokens whose word occurs in ``least`` toxic documents or more and is e**lead times likelier there."""
    u, of = np.unique(word, return_inverse=True)
    pair = np.unique(of.astype(np.int64) * len(labels) + doc)
    toxic = labels[pair % len(labels)] == 1
    t, c = (np.bincount(pair[x] // len(labels), minlength=len(u)) for x in (toxic, ~toxic))
    nt, nc = labels.sum(), (1 - labels).sum()
    ratio = np.log((t + 0.5) / (nt + 1)) - np.log((c + 0.5) / (nc + 1))
    return ((t >= least) & (ratio >= lead))[of]


def _apart(texts: list[str]) -> np.ndarray:
    """Which texts share no order-sensitive sketch with an earlier one: near copies would count a word twice."""
    from reelweave.llm import near_dup

    keep, seen = np.ones(len(texts), bool), set()
    for block in _text.blocks(pa.array(texts), fold=True):
        labelled, count, *_ = near_dup.kmers(block)
        if len(labelled):
            for i, keys in zip(np.flatnonzero(count), near_dup.sketches(labelled, count, 6).tolist(), strict=True):
                keep[block.first + i] = not seen.intersection(keys)
                seen.update(keys)
    return keep


def train(docs: DataFrame, labels: DataFrame) -> Tagger:
    """Fit on labelled documents whose crc32(doc_id) mod 5 is not 0."""
    marked = labels.where((remainder("doc_id", 5) != 0) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = dict(marked.groupBy("toxic").count().collect())
    drawn = [marked.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in SAMPLE.items()]
    chosen = drawn[0].unionByName(drawn[1])  # 1,600 rows at most
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("text")]
    before = F.sum(F.char_length("text")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.char_length("text")
    rows = rows.withColumn("before", before).where(F.col("before") < MOST_CHARS).orderBy("before", *order).select("text", "toxic").toArrow()
    texts, y = rows.column("text").to_pylist(), np.array(rows.column("toxic").to_pylist(), np.int64)
    if not texts:
        return Tagger()
    keep = _apart(texts)
    texts, y = [t for t, k in zip(texts, keep, strict=True) if k], y[keep]
    rates = tuple(total.get(k, 0) / max(1, (y == k).sum()) / max(1, sum(total.values())) * len(y) for k in (0, 1))
    model = fit(texts, y, rates)
    _text.trim()
    return model


def score(text: Column, model: Tagger, spark) -> Column:
    """Struct of the text's score and its toxic spans in code points, end exclusive."""
    bound_batches(spark)
    held = spark.sparkContext.broadcast(model)

    @arrow_udf("struct<score:double,spans:array<struct<start:int,end:int>>>")
    def run(texts: pa.Array) -> pa.Array:
        _encode.release()
        tagger, scores, starts, ends, sizes = held.value, [], [], [], []
        for block in _text.blocks(texts, fold=True, max_bytes=BLOCK):
            p, doc, start, end = tagger.tag(block)
            scores.append(tagger.scores(tagger.evidence(p, doc, block.n)))
            hit = np.flatnonzero(p >= 0.5)
            places = np.concatenate([[0], np.cumsum(~_CONT[block.data], dtype=np.int32)])
            zero = places[block.start[doc[hit]]]
            starts.append(places[start[hit]] - zero)
            ends.append(places[end[hit]] - zero)
            sizes.append(np.bincount(doc[hit], minlength=block.n))
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        offsets = np.concatenate([[0], np.cumsum(join(sizes, np.int64))]).astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array(join(starts, np.int32)), pa.array(join(ends, np.int32))], ["start", "end"])
        return pa.StructArray.from_arrays([pa.array(join(scores, np.float64)), pa.ListArray.from_arrays(pa.array(offsets), spans)], ["score", "spans"])

    return run(text.cast("string"))


def reject(docs: DataFrame, labels: DataFrame, most: float = 0.5) -> DataFrame:
    """The rows of docs that score below ``most``, columns as they were."""
    model = train(docs, labels)
    name = "toxicity"
    while name in docs.columns:
        name = f"_{name}"
    return docs.withColumn(name, score(F.col("text"), model, docs.sparkSession)).where(F.col(name)["score"] < most).drop(name)
