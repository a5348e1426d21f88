"""SentencePiece encoding and decoding with a max-plus scan over the chunks of giant documents.

Pieces and scores come from a SentencePiece model file; a text's encoding is the segmentation with the
highest sum of scores (Viterbi, as in a unigram model); of equal sums the one with the longest last
piece, then the longest one before it, and so on; characters without a piece cost more than any piece
and become byte pieces.  A text is given a leading space and spaces become U+2581, as the file's
normaliser asks.

A text of over ``CHUNK`` characters is split into chunks that lie on different tasks.  A piece may
straddle a boundary, so a boundary has a state: how many characters of the next chunk are covered.
Each chunk yields its transfer matrix, the best score from each entry state to each exit state, in
max-plus algebra.  Products of up to ``FAN`` consecutive matrices are taken level by level (the product
is associative), and going down again each level tells its children their best entry and exit
states.  With these known, each chunk is segmented by itself.

No piece joins another character to a following space, so every path is cut there.  Texts are
segmented part by part, equal parts are found by hash and segmented once for each worker, and a matrix
with such a cut in it is the outer sum of its two ends.  An entry of a matrix holds the cuts of its
path as the bits of a number beside its score (only those of the ends, where paths differ); the
smaller number is the path with the longer last pieces, so the scan breaks ties as a whole text does.

Defined cases: a null or empty text has no piece; repeated rows are encoded one by one; other columns
are ignored; an empty table gives an empty result.  Decoding gives the text back, but for U+2581 in
the text itself, which becomes a space.
"""

from __future__ import annotations

import pickle
import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from reelweave.llm import _encode, _text
from reelweave.llm._shared import written

CHUNK = 1 << 13
#: Scores from here down mark pieces that the file's own merges never make (runs of spaces); they rank last.
BARRED = -(10**8)
FAN = 64
NEVER = -(1 << 60)
#: Parts of more characters are segmented one by one: steps over many parts at once would be short.
WIDE = 96
_CUT = re.compile("[^▁]▁")
#: A path that does not exist: (score, cuts).
NONE = (NEVER, 0)


class Trie:
    """Pieces as a trie in arrays, walked from many places at once."""

    def __init__(self, pieces: dict[str, tuple[int, int]]):
        letters = sorted({c for p in pieces for c in p})
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        nodes, ids, costs, keys = {"": 0}, [-1], [0], []
        for p in sorted(pieces):
            for k in range(1, len(p) + 1):
                if p[:k] not in nodes:
                    nodes[p[:k]] = len(nodes)
                    ids.append(-1)
                    costs.append(0)
                    keys.append(nodes[p[: k - 1]] * self.width + int(self.letter[ord(p[k - 1])]))
            ids[nodes[p]], costs[nodes[p]] = pieces[p]
        self.ids, self.costs = np.array(ids), np.array(costs, np.int64)
        # a hash table of (node, letter); what finds its slot taken lies in a sorted list
        keys, to = np.array(keys, np.int64), np.arange(1, len(nodes))
        self.bits = int(len(keys)).bit_length() + 3
        self.keys, self.to = np.full(1 << self.bits, -1), np.zeros(1 << self.bits, np.int32)
        slot = self._slot(keys)
        _, first = np.unique(slot, return_index=True)
        self.keys[slot[first]], self.to[slot[first]] = keys[first], to[first]
        late = np.setdiff1d(np.arange(len(keys)), first)
        late = late[np.argsort(keys[late])]
        self.late_keys, self.late_to = np.append(keys[late], np.iinfo(np.int64).max), np.append(to[late], 0).astype(np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Children of nodes by letters, 0 where there is none."""
        key = node * self.width + letter
        slot = self._slot(key)
        found = np.where(self.keys[slot] == key, self.to[slot], 0)
        lost = np.flatnonzero((found == 0) & (self.keys[slot] >= 0))
        if len(lost):
            at = np.searchsorted(self.late_keys, key[lost])
            found[lost] = np.where(self.late_keys[at] == key[lost], self.late_to[at], 0)
        return found


class Lexicon:
    """Pieces, scores and byte pieces of a model file; segments strings."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(n)]
        raw = {model.id_to_piece(i): (i, int(model.get_score(i))) for i in range(n) if not special[i]}
        least = min(s for _, s in raw.values() if s > BARRED)
        self.score = {p: (i, s if s > BARRED else least - 1) for p, (i, s) in raw.items()}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.longest = max(map(len, self.score))
        self.unknown = min(s for _, s in self.score.values()) - 10
        if any("▁" in p.lstrip("▁") for p in self.score):
            raise ValueError("a piece joins a character to a following space")
        self.table = [b"" if s else model.id_to_piece(i).replace("▁", " ").encode() for i, s in enumerate(special)]
        for byte, i in self.bytes.items():
            self.table[i] = bytes([byte])
        self.cost = {p: c for p, (_, c) in self.score.items()}
        #: Of each two characters that begin a piece, the lengths of such pieces.
        lengths: dict = {}
        for p in self.score:
            if len(p) > 1:
                lengths.setdefault(p[:2], set()).add(len(p))
        self.lengths = {c: sorted(x) for c, x in lengths.items()}
        self.trie = Trie(self.score)
        self.byte_ids = np.array([self.bytes.get(b, 0) for b in range(256)])

    def _walk(self, s: str, starts: list[int], stop: int) -> tuple[list, list]:
        """Best scores and the start of the last piece at all places, from any of ``starts`` and with pieces that begin before ``stop``."""
        n, cost, lengths, unknown = len(s), self.cost.get, self.lengths.get, self.unknown
        best, back = [NEVER] * (n + 1), [-1] * (n + 1)
        for at in starts:
            best[at] = 0
        for at in range(min(n, stop)):
            here = best[at]
            if here == NEVER:
                continue
            value = here + cost(s[at], unknown)
            if value > best[at + 1]:
                best[at + 1], back[at + 1] = value, at
            for size in lengths(s[at : at + 2], ()):
                end = at + size
                if end > n:
                    break
                found = cost(s[at:end])
                if found is not None and here + found > best[end]:
                    best[end], back[end] = here + found, at
        return best, back

    def segment(self, text: str) -> list[int]:
        """ids of the best segmentation of a string, spaces read as U+2581."""
        s = text.replace(" ", "▁")
        _, back = self._walk(s, [0], len(s))
        out, end = [], len(s)
        while end:
            p = s[back[end] : end]
            found = self.score.get(p)
            out += [found[0]] if found else [self.bytes[b] for b in reversed(p.encode())]
            end = back[end]
        return out[::-1]

    def segment_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of many strings, joined, and their numbers: all places of all strings at once, then step by step from their starts."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        long = np.flatnonzero(size > WIDE).tolist()
        if long:
            short = np.flatnonzero(size <= WIDE)
            ids, count = self.segment_all([texts[i] for i in short.tolist()])
            own = [np.array(self.segment(texts[i]), np.int64) for i in long]
            total = np.zeros(len(texts), np.int64)
            total[short], total[long] = count, [len(x) for x in own]
            out, at = np.empty(total.sum(), np.int64), np.cumsum(total) - total
            out[_text.ragged(at[short], count)] = ids
            for i, x in zip(long, own, strict=True):
                out[at[i] : at[i] + len(x)] = x
            return out, total
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        points[points == 32] = 0x2581
        letter = self.trie.letter[points]
        n = len(points)
        left = _text.ragged(np.zeros(len(size), np.int64), size)  # characters before each one in its string
        offset = left.astype(np.int16)
        left = np.repeat(size, size) - left
        # a place of the path is a character or a string's end, so strings are one place apart
        place = np.arange(n) + np.repeat(np.arange(len(size)), size)
        node, live = self.trie.step(np.zeros(n, np.int64), letter), np.arange(n)
        known = self.trie.ids[node] >= 0
        starts, lengths, costs, ids = [live], [np.ones(n, np.int8)], [np.where(known, self.trie.costs[node], self.unknown)], [np.where(known, self.trie.ids[node], -1 - live)]
        for k in range(1, self.longest):
            keep = (node > 0) & (left[live] > k)
            live, node = live[keep], node[keep]
            node = self.trie.step(node.astype(np.int64), letter[live + k])
            hit = self.trie.ids[node] >= 0
            starts.append(live[hit])
            lengths.append(np.full(len(starts[-1]), k + 1, np.int8))
            costs.append(self.trie.costs[node[hit]])
            ids.append(self.trie.ids[node[hit]])
        start, length, cost, piece = (np.concatenate(x) for x in (starts, lengths, costs, ids))
        order = np.argsort(offset[start], kind="stable")
        start, length, cost, piece = start[order], length[order].astype(np.int64), cost[order], piece[order]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(offset[start], minlength=1))])
        begin = place[start]
        best, back, by = np.full(n + len(size), NEVER, np.int64), np.zeros(n + len(size), np.int64), np.zeros(n + len(size), np.int64)
        first = np.cumsum(size + 1) - size - 1
        best[first] = 0
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            # of one offset no two pieces of a string end at one place; earlier offsets came first and win ties
            value, end = best[begin[a:b]] + cost[a:b], begin[a:b] + length[a:b]
            better = np.flatnonzero(value > best[end])
            end = end[better]
            best[end], back[end], by[end] = value[better], begin[a:b][better], piece[a:b][better]
        # back from the ends; a string's last piece comes first
        which, at, steps, found = np.flatnonzero(size > 0), first + size, [], []
        at = at[which]
        while len(at):
            steps.append(which)
            found.append(by[at])
            at = back[at]
            more = at > first[which]
            which, at = which[more], at[more]
        if not steps:
            return np.zeros(0, np.int64), np.zeros(len(size), np.int64)
        step, which, found = np.repeat(np.arange(len(steps)), [len(x) for x in steps]), np.concatenate(steps), np.concatenate(found)
        count = np.bincount(which, minlength=len(size))
        out = np.empty_like(found)
        out[np.cumsum(count)[which] - 1 - step] = found
        return self._with_bytes(np.repeat(np.arange(len(size)), count), out, points, len(size))

    def _with_bytes(self, which: np.ndarray, found: np.ndarray, points: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Replace -1 - place by the byte pieces of the character there."""
        odd = np.flatnonzero(found < 0)
        if len(odd):
            raw = [chr(c).encode() for c in points[-1 - found[odd]].tolist()]
            width = np.ones(len(found), np.int64)
            width[odd] = [len(b) for b in raw]
            at = np.cumsum(width) - width
            found, which = np.repeat(found, width), np.repeat(which, width)
            found[_text.ragged(at[odd], width[odd])] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return found, np.bincount(which, minlength=n)

    def _paths(self, s: str, begin: int, ends: list[int], stop: int, top: int) -> list[tuple[int, int]]:
        """(score, cuts) of the best paths from a place to each of some ends; cuts below ``top`` as bits."""
        best, back = self._walk(s, [begin], stop)
        out = []
        for end in ends:
            if end > len(s) or best[end] == NEVER:
                out.append(NONE)
                continue
            cuts, at = 0, end
            while at >= 0:
                if at < top:
                    cuts |= 1 << at
                at = back[at]
            out.append((best[end], cuts))
        return out

    def transfer(self, text: str, n: int) -> Transfer:
        """Matrix of a chunk of n characters followed by what is known of the next one.

        Entry (i, j): the best path over the chunk from its character i to j characters behind it; cuts
        are those inside the chunk.
        """
        s, width = text.replace(" ", "▁"), self.longest
        ends = [n + j for j in range(width)]
        first = _CUT.search(s, width - 1, n)
        if first is None:
            full = [self._paths(s, i, ends, n, n) if i < n else [(0, 0) if i == e else NONE for e in ends] for i in range(width)]
            return Transfer(n, n, None, None, full)
        first = first.start() + 1
        # a place behind which all paths go on alike: the last one before the end
        last = first
        for at in range(n - 1, first, -1):
            if s[at] == "▁" and s[at - 1] != "▁":
                last = at
                break
        head = [self._paths(s[:first], i, [first], first, first)[0] for i in range(width)]
        tail = self._paths(s[last:], 0, [e - last for e in ends], n - last, n - last)
        return Transfer(n, n - last, head, tail, None)


class Transfer(NamedTuple):
    """A chunk's matrix: ``head`` by entry and ``tail`` by exit where all paths meet, else ``full``; items are (score, cuts).

    Cuts are bits from the chunk's start, in ``tail`` bits from the place ``reach`` characters before its end.
    """

    n: int
    reach: int
    head: list | None
    tail: list | None
    full: list | None


def _best(pairs, shift: int) -> tuple[tuple[int, int], int]:
    """Best of (before, after) pairs of items and its index: highest score, then smallest cuts, the later ones first."""
    top, at = NONE, 0
    for k, ((a, x), (b, y)) in enumerate(pairs):
        if a > NEVER and b > NEVER:
            item = (a + b, x | y << shift)
            if top[0] == NEVER or item[0] > top[0] or item[0] == top[0] and item[1] < top[1]:
                top, at = item, k
    return top, at


def times(a: Transfer, b: Transfer) -> Transfer:
    """Max-plus product."""
    n = a.n + b.n
    if a.full is None and b.full is None:
        return Transfer(n, b.reach, a.head, b.tail, None)
    if a.full is None:
        return Transfer(n, a.reach + b.n, a.head, [_best(zip(a.tail, c, strict=True), a.reach)[0] for c in zip(*b.full, strict=True)], None)
    if b.full is None:
        return Transfer(n, b.reach, [_best(zip(r, b.head, strict=True), a.n)[0] for r in a.full], b.tail, None)
    columns = list(zip(*b.full, strict=True))
    return Transfer(n, n, None, None, [[_best(zip(r, c, strict=True), a.n)[0] for c in columns] for r in a.full])


def states(matrices: list[Transfer], enter: int, leave: int) -> list[int]:
    """Boundary states along the best path through consecutive matrices, both ends included."""
    width = len(matrices[0].full or matrices[0].head)
    v, reach = [(0, 0) if k == enter else NONE for k in range(width)], 0
    ahead = []
    for m in matrices:
        ahead.append((v, reach))
        if m.full is None:
            v, reach = m.tail, m.reach  # what came before is the same for all exits
        else:
            v, reach = [_best(zip(v, c, strict=True), reach)[0] for c in zip(*m.full, strict=True)], reach + m.n
    out = [leave]
    for (v, reach), m in zip(ahead[::-1], matrices[::-1], strict=True):
        after = m.head if m.full is None else [r[out[-1]] for r in m.full]
        out.append(_best(zip(v, after, strict=True), reach)[1])
    return out[::-1]


_held: dict = {}
_encode.releases.append(_held.clear)


def _encoder(path: str) -> _encode.Encoder:
    if path not in _held:
        _encode.release()
        _held[path] = _encode.Encoder(Lexicon(path).segment_all, True)
    return _held[path]


def _ids(enc: _encode.Encoder, texts: pa.Array, kind: str = "<u4") -> pa.Array:
    """ids of each text as the bytes of little-endian numbers."""
    parts, sizes = [np.zeros(0, kind)], [np.zeros(1, np.int64)]
    for block in _text.blocks(texts):
        ids, size, doc, _, _ = enc.encode(block)
        parts.append(ids.astype(kind))
        sizes.append(np.bincount(doc, size, block.n).astype(np.int64))
    ends = np.cumsum(np.concatenate(sizes)) * np.dtype(kind).itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.concatenate(parts).tobytes())]).cast(pa.binary())


def boundaries(chunks: DataFrame) -> DataFrame:
    """(row, chunk, enter, leave) from (row, chunk, m): up by products of FAN matrices, then down."""
    levels = [chunks.select("row", F.col("chunk").alias("at"), "m")]
    most = chunks.agg(F.max("chunk")).first()[0] or 0
    while most >= FAN:

        def product(key, table):
            order = np.argsort(table.column("at").to_numpy())
            m = [Transfer(*pickle.loads(x)) for x in table.column("m").take(pa.array(order)).to_pylist()]
            out = m[0]
            for x in m[1:]:
                out = times(out, x)
            return pa.table({"row": [key[0].as_py()], "at": [key[1].as_py()], "m": [pickle.dumps(tuple(out))]})

        up = levels[-1].withColumn("g", F.expr(f"at div {FAN}")).groupBy("row", "g").applyInArrow(product, "row long, at long, m binary")
        levels.append(written(up, "products"))
        most //= FAN
    known = None
    for level in reversed(levels):
        grouped = level.withColumn("g", F.expr(f"at div {FAN}"))
        if known is None:
            given = grouped.withColumns({"enter": F.lit(0), "leave": F.lit(0)})
        else:
            given = grouped.join(known.select("row", F.col("at").alias("g"), "enter", "leave"), ["row", "g"])

        def down(key, table):
            order = np.argsort(table.column("at").to_numpy())
            m = [Transfer(*pickle.loads(x)) for x in table.column("m").take(pa.array(order)).to_pylist()]
            path = states(m, table.column("enter")[0].as_py(), table.column("leave")[0].as_py())
            return pa.table({"row": pa.array([key[0].as_py()] * len(m)), "at": table.column("at").take(pa.array(order)), "enter": pa.array(path[:-1], pa.int32()), "leave": pa.array(path[1:], pa.int32())})

        known = given.groupBy("row", "g").applyInArrow(down, "row long, at long, enter int, leave int")
        if level is not levels[0]:
            known = written(known, "states")
    return known.withColumnRenamed("at", "chunk")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text_sha256) of every row; ids are little-endian 32-bit numbers in a binary.

    Of a giant document only its chunks are shuffled, once, and then the ids of its pieces.
    """
    held = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    length, sha = F.char_length("text"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")

    @arrow_udf("binary")
    def whole(texts: pa.Array) -> pa.Array:
        spaced = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
        return _ids(_encoder(path), spaced)

    short = held.where(length <= CHUNK).select("doc_id", whole("text").alias("ids"), sha)

    def split(batches):
        _encode.release()
        lexicon, row = Lexicon(path), TaskContext.get().partitionId() << 33
        for batch in batches:
            for doc_id, text, digest in zip(*(batch.column(k) for k in range(3)), strict=True):
                s, rows = " " + text.as_py(), []
                for k, at in enumerate(range(0, len(s), CHUNK)):
                    part, n = s[at : at + CHUNK + lexicon.longest], min(CHUNK, len(s) - at)
                    rows.append((row, k, n, part, pickle.dumps(tuple(lexicon.transfer(part, n)))))
                row += 1
                cols = [pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.binary()), strict=True)]
                ids = pa.array([doc_id.as_py()] * len(rows), batch.column(0).type)
                shas = pa.array([digest.as_py()] * len(rows), pa.string())
                yield pa.RecordBatch.from_arrays([ids, shas, *cols], ["doc_id", "text_sha256", "row", "chunk", "n", "part", "m"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    giants = held.where(length > CHUNK).select("doc_id", "text", sha)
    chunks = written(giants.mapInArrow(split, f"doc_id {kind}, text_sha256 string, row long, chunk long, n int, part string, m binary"), "chunks")

    narrow = "<u2" if len(_pieces(path)) <= 1 << 16 else "<u4"

    @arrow_udf("binary")
    def chunk_ids(parts: pa.Array) -> pa.Array:
        return _ids(_encoder(path), parts, narrow)

    @arrow_udf("binary")
    def joined(column: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(b"".join(x.as_py()), narrow).astype("<u4").tobytes() for x in column], pa.binary())

    own = chunks.drop("m").join(boundaries(chunks), ["row", "chunk"])
    # a chunk from its entry state to its exit state
    span = F.substring("part", F.col("enter") + 1, F.greatest(F.col("n") + F.col("leave") - F.col("enter"), F.lit(0)))
    coded = own.select("doc_id", "text_sha256", "row", "chunk", chunk_ids(span).alias("ids"))
    # a document is a row of the result, so its chunks meet there
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])
    long = coded.groupBy("row").agg(F.first("doc_id").alias("doc_id"), parts.alias("ids"), F.first("text_sha256").alias("text_sha256"))
    return short.unionByName(long.select("doc_id", joined("ids").alias("ids"), "text_sha256"))


def decode(ids: Column, path: str) -> Column:
    """The text of encoded ids."""

    @arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        table = _pieces(path)
        size = np.array([len(t) for t in table])
        at, data = np.cumsum(size) - size, np.frombuffer(b"".join(table), np.uint8)
        out = []
        for x in column:
            i = np.frombuffer(x.as_py(), "<u4").astype(np.int64)
            out.append(data[_text.ragged(at[i], size[i])].tobytes()[1:].decode("utf-8", "replace") if len(i) else "")
        return pa.array(out, pa.string())

    return run(ids)


_tables: dict = {}


def _pieces(path: str) -> list[bytes]:
    """Bytes of each piece, those of special ones empty."""
    if path not in _tables:
        _tables[path] = Lexicon(path).table
    return _tables[path]


def digest(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, restored): restored tells whether decoding gives the text back, byte for byte."""

    @arrow_udf("long")
    def crc(column: pa.Array) -> pa.Array:
        return pa.array([zlib.crc32(x.as_buffer()) for x in column], pa.int64())

    same = F.sha2(decode(F.col("ids"), path).cast("binary"), 256) == F.col("text_sha256")
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), crc("ids").alias("ids_crc32"), same.alias("restored"))
