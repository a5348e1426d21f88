"""Quality rules: text statistics and n-gram perplexity under a modified Kneser-Ney model.

The model is over characters (order 5 by default), one per language: open vocabularies, as in a web
corpus, make word n-grams mostly singletons, while character n-grams are shared by all words.  A
symbol is an ASCII character or one of 128 hash classes of all others.  Spark counts the n-grams;
continuation counts, discounts, context totals and back-off weights are aggregations of that table.
Each distinct language has a number of its own, which stands in the 64-bit key of an n-gram beside
its symbols, so the keys of the sorted arrays that hold the model are exact and compared as a whole.

A model of ``MOST`` n-grams at most goes to the tasks as arrays.  A larger one stays in tables, no
n-gram of it is left out: joins over them give the logarithm of each distinct n-gram that the texts
hold, the ``MOST`` most frequent of these go to the tasks, and what a text has of the others is
joined with the rest and summed for each row.  Both ways give the same perplexities.

A document is scored by a model that has not seen it: texts are dealt into two folds by their hash, so
that copies stay together, each fold has its own n-grams, and each text meets those of the other fold.

Per language, documents outside [low, high] perplexity are rejected.  The band lies ``spread``
interquartile ranges beyond the quartiles of the documents' log-perplexity, read from a histogram
with bins of BIN, which is an aggregation over all documents.

Defined cases: a null text is empty; a null language is a language of its own; a text without words
has no perplexity (null) and fails the base rule; repeated rows are judged one by one; an empty table
gives an empty result; other columns are ignored or carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from reelweave.llm import _encode, _text
from reelweave.llm._shared import written

ORDER = 5
MOST = 1 << 21
SPREAD = 2.0
BIN = 0.005
MOST_LANGS = 1 << 22  # with the fold's bit, 63 bits of a key
_SYMBOLS = b"#*$%&|<>"

#: One byte for each code point: ASCII lower-cased, digits alike, white space alike; others hashed into 128 to 255.
_ASCII = np.arange(128, dtype=np.uint8)
_ASCII[65:91] += 32
_ASCII[48:58] = 48
_ASCII[[9, 10, 11, 12, 13]] = 32
_ASCII[0] = 1
_CONT = (np.arange(256) & 0xC0) == 0x80


def _keys(block: _text.Block, lang: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams ending at each symbol, in text order, and the number of them in each document.

    A key has the number of the language, then ``order`` symbols of a byte each; 0 stands before a text and
    is its end mark as well.
    """
    data = block.data
    lead = ~_CONT[data]
    sym = _ASCII[data & 127]
    wide = np.flatnonzero(data >= 0xC0)
    if len(wide):
        size = 2 + (data[wide] >= 0xE0) + (data[wide] >= 0xF0)
        sym[wide] = (block.hashes(wide, wide + size) >> np.uint64(57)).astype(np.uint8) | 128
    sym[block.end] = 0
    # order - 1 zeros before each document keep its n-grams apart from the one before
    count = np.add.reduceat(lead, block.start, dtype=np.int64)
    pad = order - 1
    out = np.zeros(int(count.sum()) + pad * block.n, np.uint8)
    real = np.ones(len(out), bool)
    first = np.cumsum(count + pad) - count
    real[(first[:, None] - np.arange(1, pad + 1)).ravel()] = False
    out[real] = sym[lead]
    key = out.astype(np.uint64)
    for k in range(1, order):
        key[k:] |= out[:-k].astype(np.uint64) << np.uint64(8 * k)
    key = key[real]
    key |= np.repeat(lang.astype(np.uint64) << np.uint64(8 * order), count)
    return key, count


class Memo:
    """A direct-mapped table of keys: equal keys get the same slot, a key whose slot is taken gets none."""

    def __init__(self, bits: int = 20):
        self.bits = bits
        self.keys = np.full(1 << bits, ~np.uint64(0))

    def slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slot of each key, whether the key holds it, and the slots that were filled just now."""
        at = (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
        hit = self.keys[at] == keys
        out = np.flatnonzero(~hit)
        free = out[self.keys[at[out]] == ~np.uint64(0)]
        self.keys[at[free]] = keys[free]
        hit[out] = self.keys[at[out]] == keys[out]
        return at, hit, np.unique(at[free])


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def languages(docs: DataFrame) -> DataFrame:
    """(lang, bucket): a number below MOST_LANGS for each distinct language, null included."""
    distinct = docs.select(F.col("lang").cast("string").alias("lang")).distinct()
    found = written(distinct.withColumn("bucket", F.row_number().over(Window.orderBy("lang")) - 1), "languages")
    if found.count() > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    return found


def count_ngrams(docs: DataFrame, bucket: Column, order: int = ORDER) -> DataFrame:
    """(key, count) over all texts: n-grams are combined in each block and partition, then by key."""

    def run(batches):
        _encode.release()
        memo = Memo()
        counts = np.zeros(1 << memo.bits, np.int64)
        held: list = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for batch in batches:
            lang = batch.column(1).to_numpy(zero_copy_only=False)
            for block in _text.blocks(batch.column(0), max_bytes=_text.SMALL_BYTES):
                keys, _ = _keys(block, lang[block.first : block.first + block.n], order)
                at, hit, _ = memo.slots(keys)
                np.add.at(counts, at[hit], 1)
                held.append(_distinct(keys[~hit]))
                if sum(len(k) for k, _ in held) > 1 << 20:
                    yield _counts(*_merge(held))
                    held = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        used = np.flatnonzero(counts)
        yield _counts(*_merge([*held, (memo.keys[used], counts[used])]))

    rows = docs.select(F.col("text").cast("string").alias("text"), bucket.alias("lang"))
    return rows.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    k, at = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
    return k, np.bincount(at, np.concatenate([x[1] for x in parts]), len(k)).astype(np.int64)


def _counts(k: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(c.astype(np.int64))], ["key", "n"])


class KneserNey:
    """Interpolated modified Kneser-Ney over all n-grams of its texts, in sorted arrays or in tables.

    ``grams[n]``: keys and discounted relative frequencies of n-grams; ``contexts[n]``: keys of
    contexts of n - 1 symbols and the mass they leave to the shorter context, all of it where a
    context is absent.  Arrays are sorted by key; a model that is too large for them has none, but
    ``tables[n]``: the same two as DataFrames, with columns key and p.
    """

    def __init__(self, order: int, grams: dict, contexts: dict, tables: dict | None = None):
        self.order, self.grams, self.contexts, self.tables = order, grams, contexts, tables

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, default: float) -> np.ndarray:
        known, value = table
        if not len(known):
            return np.full(len(keys), default)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, value[at], default)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each n-gram's last symbol given the others; with tables, by a job."""
        if self.tables:
            spark = self.tables[1][0].sparkSession
            got = self.logs(spark.createDataFrame([(k,) for k in np.unique(keys).astype(np.int64).tolist()], "key long"))
            return self._look(_sorted(got.select("key", "log")), keys, np.nan)
        lang = keys >> np.uint64(8 * self.order) << np.uint64(8 * self.order)
        p = np.full(len(keys), 1 / 256)
        for n in range(1, self.order + 1):
            gram = lang | (keys & np.uint64((1 << 8 * n) - 1))
            context = lang | (gram & np.uint64((1 << 8 * n) - 1)) >> np.uint64(8)
            p = self._look(self.grams[n], gram, 0.0) + self._look(self.contexts[n], context, 1.0) * p
        return np.log10(p)

    def logs(self, wanted: DataFrame) -> DataFrame:
        """(key, log) of the distinct keys of ``wanted``, from the tables of a model: each order is joined with the one below."""
        low, shorter = (1 << 8 * self.order) - 1, None
        lang = F.col("key").bitwiseAND(F.lit(~low))
        for n in range(1, self.order + 1):
            own = F.col("key").bitwiseAND(F.lit((1 << 8 * n) - 1))
            grams, contexts = self.tables[n]
            found = wanted.select(lang.bitwiseOR(own).alias("key")).distinct().join(grams, "key", "left").withColumnRenamed("p", "own")
            context = contexts.select(F.col("key").alias("context"), F.col("p").alias("left"))
            found = found.withColumn("context", lang.bitwiseOR(F.shiftright(own, 8))).join(context, "context", "left")
            if n == 1:
                found = found.withColumn("below", F.lit(1 / 256))
            else:
                found = found.withColumn("shorter", lang.bitwiseOR(F.col("key").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1)))).join(shorter, "shorter")
            p = F.coalesce(F.col("own").cast("double"), F.lit(0.0)) + F.coalesce(F.col("left").cast("double"), F.lit(1.0)) * F.col("below")
            shorter = found.select(F.col("key").alias("shorter"), p.alias("below"))
        return shorter.select(F.col("shorter").alias("key"), F.log10("below").alias("log"))


def _levels(counts: DataFrame) -> tuple[Column, dict[int, int]]:
    """The level of a row's count, eight for each doubling, and how many rows are on each; counts below 4 have levels of their own."""
    level = F.floor(F.log2("n") * 8).cast("int")
    return level, dict(counts.groupBy(level.alias("l")).agg(F.count("*")).collect())


def train(docs: DataFrame, bucket: Column, order: int = ORDER) -> KneserNey:
    """Fit the model on all texts of docs; bucket is the number of a text's language."""
    return fit(written(count_ngrams(docs, bucket, order), "ngrams"), order)


def fit(counts: DataFrame, order: int = ORDER) -> KneserNey:
    """The model of a written table (key, n) of n-grams of the highest order."""
    low = (1 << 8 * order) - 1
    tables, most = {}, 0
    for n in range(order, 0, -1):
        mask = (1 << 8 * n) - 1
        lang = F.col("key").bitwiseAND(F.lit(~low))
        context = lang.bitwiseOR(F.shiftright(F.col("key").bitwiseAND(F.lit(mask)), 8)) if n > 1 else lang
        _, known = _levels(counts)
        most = max(most, sum(known.values()))
        of = [known.get(k, 0) for k in (0, 8, 12, 16)]  # how many occur once, twice, three and four times
        y = of[0] / (of[0] + 2 * of[1]) if of[0] and of[1] else 0.5
        d = [min(max(k - (k + 1) * y * of[k] / of[k - 1], 0.05), k - 0.05) if of[k - 1] and of[k] else 0.5 for k in (1, 2, 3)]
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        table = counts.select("key", "n", context.alias("context"), off.cast("double").alias("off"))
        totals = table.groupBy("context").agg(F.sum("n").alias("total"), F.sum("off").alias("left"))
        grams = table.join(totals, "context").select("key", ((F.col("n") - F.col("off")) / F.col("total")).cast("float").alias("p"))
        tables[n] = grams, totals.select(F.col("context").alias("key"), (F.col("left") / F.col("total")).cast("float").alias("p"))
        shorter = lang.bitwiseOR(F.col("key").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1)))
        if n > 1:
            counts = written(counts.groupBy(shorter.alias("key")).agg(F.count("*").alias("n")), "ngrams")
    if most > MOST:
        return KneserNey(order, {}, {}, {n: (written(g, "grams"), written(c, "contexts")) for n, (g, c) in tables.items()})
    return KneserNey(order, {n: _sorted(g) for n, (g, _) in tables.items()}, {n: _sorted(c) for n, (_, c) in tables.items()})


def _sorted(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and one value each; for tables of MOST rows at most."""
    got = table.toArrow()
    key, p = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()
    order = np.argsort(key)
    return key[order], p[order]


class Logs:
    """Logarithms of the most frequent n-grams in arrays of MOST at most; ``rest``: a table (key, log) of all others."""

    def __init__(self, order: int, held: tuple[np.ndarray, np.ndarray], rest: DataFrame):
        self.order, self.held, self.rest = order, held, rest

    @classmethod
    def of(cls, model: KneserNey, wanted: DataFrame) -> Logs:
        """wanted: a written table (key, n) of the distinct n-grams to be scored and how often each occurs."""
        logs = written(model.logs(wanted).join(wanted, "key"), "logs")
        level, sizes = _levels(wanted)
        total, least = 0, 1 << 30
        for at in sorted(sizes, reverse=True):
            total += sizes[at]
            if total > MOST:
                break
            least = at
        return cls(model.order, _sorted(logs.where(level >= least).select("key", "log")), logs.where(level < least).select("key", "log"))


_FIELDS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "log10_ppl": pa.float64()}
_TYPE = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,log10_ppl:double>"
_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(_SYMBOLS, np.uint8))
_IN_WORD = ~_text._SPACE & ~_CONT


def _statistics(block: _text.Block, lang: np.ndarray, score) -> list[np.ndarray]:
    n = block.n
    start, end = block.words()
    n_words = np.diff(np.searchsorted(start, block.end), prepend=0)
    doc = np.repeat(np.arange(n), n_words)
    # code points in words: bytes that are neither white space nor a continuation
    chars = np.add.reduceat(_IN_WORD[block.data], block.start, dtype=np.int64)
    symbols = np.add.reduceat(_IS_SYMBOL[block.data], block.start, dtype=np.int64)
    # lines that hold a word and repeat an earlier one
    ls, le = block.lines()
    full = np.searchsorted(start, le) > np.searchsorted(start, ls)
    ls, le = ls[full], le[full]
    ldoc = block.doc_of(ls)
    earlier, _ = _text.repeats(ldoc, block.hashes(ls, le))
    dup_lines = _text.per_doc(n, ldoc[earlier > 0])
    # words covered by five-word windows that the text holds twice or more
    h = block.hashes(start, end)
    covered = np.zeros(len(h) + 1, np.int64)
    if len(h) >= 5:
        at = np.flatnonzero(doc[4:] == doc[:-4])
        w = np.zeros(len(h) - 4, np.uint64)
        for k in range(5):
            w = (w + h[k : len(h) - 4 + k]) * np.uint64(0xD6E8FEB86659FD93)
        key = _text.mix(w[at] ^ _text.mix(doc[at].astype(np.uint64)))
        ordered = np.sort(key)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            at = at[twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key]
            covered += np.bincount(at, minlength=len(covered)) - np.bincount(at + 5, minlength=len(covered))
    repeat = _text.per_doc(n, doc[np.cumsum(covered)[:-1] > 0])
    out = [n_words, chars, symbols, dup_lines, repeat]
    if score is None:
        return [*out, np.full(n, np.nan)]
    keys, count = _keys(block, lang, score.order)
    logs = score(keys)
    first = np.cumsum(count) - count
    if not isinstance(score, _HeldLogs):
        return [*out, np.where(n_words > 0, -np.add.reduceat(logs, first) / count, np.nan)]
    open_ = np.isnan(logs)
    logs[open_] = 0.0
    rest = np.concatenate([[0], np.cumsum(np.add.reduceat(open_, first, dtype=np.int64))])
    return [*out, np.where(n_words > 0, -np.add.reduceat(logs, first) / count, np.nan), count, (rest, keys[open_])]


class _HeldLogs:
    """Log-probabilities of n-grams that arrays hold, NaN for others."""

    def __init__(self, order: int, held: tuple[np.ndarray, np.ndarray]):
        self.order, self.held = order, held

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        return KneserNey._look(self.held, keys, np.nan)


class _Scorer:
    """Log-probabilities of n-grams, kept for those that hold a slot of the memo."""

    def __init__(self, model: KneserNey):
        self.model, self.order, self.memo = model, model.order, Memo()
        self.logs = np.zeros(1 << self.memo.bits)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at, hit, new = self.memo.slots(keys)
        if len(new):
            self.logs[new] = self.model.log10(self.memo.keys[new])
        out = self.logs[at]
        if not hit.all():
            u, of = np.unique(keys[~hit], return_inverse=True)
            out[~hit] = self.model.log10(u)[of]
        return out


def statistics(text: Column, bucket: Column, model: KneserNey | Logs | None, spark) -> Column:
    """Struct of the text's statistics and log10 perplexity per character under its language's model.

    With ``Logs`` the perplexity counts the held n-grams only; ``n_grams`` and the keys of the others, ``rest``, come beside it.
    """
    partial = isinstance(model, Logs)
    held = spark.sparkContext.broadcast((model.order, model.held) if partial else model)
    lists = pa.list_(pa.int64())

    @arrow_udf(_TYPE[:-1] + ",n_grams:long,rest:array<long>>" if partial else _TYPE)
    def stats(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        _encode.release()
        score = _HeldLogs(*held.value) if partial else _Scorer(held.value) if held.value is not None else None
        for texts, langs in batches:
            lang = langs.to_numpy(zero_copy_only=False)
            # block by block: keys take eight times the space of a text
            for b in _text.blocks(texts, max_bytes=_text.SMALL_BYTES):
                cols = _statistics(b, lang[b.first : b.first + b.n], score)
                arrays = [pa.array(c, t, from_pandas=True) for c, t in zip(cols, _FIELDS.values(), strict=False)]
                if partial:
                    at, keys = cols[-1]
                    arrays += [pa.array(cols[-2], pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys.view(np.int64)), type=lists)]
                yield pa.StructArray.from_arrays(arrays, [*_FIELDS, *(("n_grams", "rest") if partial else ())])

    return stats(text.cast("string"), bucket)


def base_failed(s: str) -> Column:
    """Under ten words, or over a fifth of the words in repeated five-word windows."""
    return (F.col(f"{s}.n_words") < 10) | (100 * F.col(f"{s}.n_repeat_words") > 20 * F.col(f"{s}.n_words"))


def bands(scored: DataFrame, s: str, bucket: str, spread: float = SPREAD) -> DataFrame:
    """(bucket, low, high): log10 perplexity of each language, from a histogram of all documents that pass the base rule."""
    bins = scored.where(~base_failed(s)).select(F.col(bucket).alias(bucket), F.floor(F.col(f"{s}.log10_ppl") / BIN).cast("int").alias("bin")).groupBy(bucket, "bin").agg(F.count("*").alias("n"))
    every = Window.partitionBy(bucket)
    upto = bins.select(bucket, "bin", F.sum("n").over(every.orderBy("bin")).alias("upto"), F.sum("n").over(every).alias("total"))
    quartile = lambda q: F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("bin"))) * BIN
    found = upto.groupBy(bucket).agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))
    reach = spread * F.greatest(F.col("q3") - F.col("q1"), F.lit(4 * BIN))
    return found.select(bucket, (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))


def judge(docs: DataFrame, order: int = ORDER, out: str = "quality", columns: list[str] | None = None) -> DataFrame:
    """docs with a struct column ``out`` of statistics, the perplexity held out, and the number of its language, ``out``_bucket.

    One pass over the texts counts n-grams, one scores them.  ``verdicts`` writes what the caller
    selects of this to the shared folder, reads the bands from its histogram and adds the verdict.
    Of docs, ``columns`` come along, all by default: with a model in tables they are written here.
    """
    bucket, lang = f"{out}_bucket", f"{out}_lang"
    columns = docs.columns if columns is None else columns
    known = languages(docs).select(F.col("lang").alias(lang), F.col("bucket").alias(bucket))
    docs = docs.join(known, F.col("lang").cast("string").eqNullSafe(F.col(lang)), "left").drop(lang)
    fold = F.pmod(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(2))
    counts = written(count_ngrams(docs, (2 * F.col(bucket) + fold).cast("int"), order), "ngrams")
    model, other = fit(counts, order), (2 * F.col(bucket) + 1 - fold).cast("int")
    if not model.tables:
        return docs.select(*columns, bucket, statistics(F.col("text"), other, model, docs.sparkSession).alias(out))
    # an n-gram of one fold is scored by the number that the language has in the other
    logs = Logs.of(model, written(counts.select(F.col("key").bitwiseXOR(F.lit(1 << 8 * order)).alias("key"), "n"), "wanted"))
    row, sums = f"{out}_row", f"{out}_sum"
    # a written row keeps its number
    part = docs.select(*columns, bucket, F.monotonically_increasing_id().alias(row), statistics(F.col("text"), other, logs, docs.sparkSession).alias(out))
    part = written(part, "partial")
    rest = part.select(row, F.explode(f"{out}.rest").alias("key")).join(logs.rest, "key").groupBy(row).agg(F.sum("log").alias(sums))
    exact = F.col(f"{out}.log10_ppl") - F.coalesce(F.col(sums), F.lit(0.0)) / F.col(f"{out}.n_grams")
    found = F.struct(*[F.col(f"{out}.{c}") for c in _FIELDS if c != "log10_ppl"], exact.alias("log10_ppl"))
    return part.join(rest, row, "left").select(*columns, bucket, found.alias(out))


def verdicts(scored: DataFrame, spread: float = SPREAD, out: str = "quality") -> DataFrame:
    """scored (some columns of what ``judge`` gives, written) with the verdict in its struct."""
    scored = written(scored, "scored")
    bucket = f"{out}_bucket"
    marks = written(bands(scored, out, bucket, spread).select(bucket, F.struct("low", "high").alias(f"{out}_band")), "bands")
    inside = F.coalesce(F.col(f"{out}.log10_ppl").between(F.col(f"{out}_band.low"), F.col(f"{out}_band.high")), F.lit(False))
    failed = base_failed(out)
    judged = scored.join(marks, bucket, "left").withColumn(out, F.struct(f"{out}.*", failed.alias("base_failed"), (~failed & inside).alias("kept")))
    return judged.select(*[c for c in scored.columns if c != bucket])


def keep(docs: DataFrame, spread: float = SPREAD) -> DataFrame:
    """The rows of docs that pass base rule and perplexity band, columns as they were."""
    name = "quality"
    while any(f"{name}{x}" in docs.columns for x in ("", "_bucket", "_lang", "_band", "_row", "_sum")):
        name = f"_{name}"
    return verdicts(judge(docs, out=name), spread, name).where(f"{name}.kept").select(*docs.columns)
