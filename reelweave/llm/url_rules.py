"""URL filters: allow and block entries in a trie over reversed host labels and path segments.

An entry (host, path) fits a url whose host is the entry's or a subdomain of it and whose path starts with
the entry's path.  Of the entries that fit, the one with the most host labels wins, of these the one with
the longest path, and block wins over allow at the same place.  A url that no entry fits gets DEFAULT.

The trie's edges are the host labels from the last to the first, then the path's segments; what stands
behind an entry's last slash is a tail at its node.  So a url is walked label by label and segment by
segment, and the work of a url doesn't grow with the list.  Up to ``most`` entries the trie is
broadcast; a longer list is joined instead: each distinct (host, path) meets the entries at its
host suffixes and path prefixes, salted, and both ways give the same rows.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z lower-cased; path: then up to
``?``, ``#`` or the end.  Defined cases: a null url or one without ``://`` has an empty host and path; an entry
with an empty host fits every url (also those), one with a null part is no entry; repeated rows and ids that
tie are judged one by one; an empty table gives an empty result, an empty list DEFAULT for all; other
columns are carried along, and a column named like the result is replaced.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

DEFAULT = "allow"
#: Entries of a broadcast trie: about 300 bytes each, so 300 MB of Python objects at most.
MOST = 1_000_000
SALTS = 16
RULES = "host string, path string, verdict string"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


class Trie:
    """Nodes are numbers, edges a dictionary of (node, label); the root is 0."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.edges: dict[tuple[int, str], int] = {}
        self.ends: dict[int, list[tuple[str, str, str]]] = {}
        for h, p, verdict in rules:
            *segments, tail = p.split("/")
            node = 0
            for label in [*self.labels(h), *("/" + s for s in segments)]:
                node = self.edges.setdefault((node, label), len(self.edges) + 1)
            self.ends.setdefault(node, []).append((tail, verdict, h + p))
        for at in self.ends.values():
            at.sort(key=lambda e: (-len(e[0]), e[1] != "block"))

    @staticmethod
    def labels(h: str) -> list[str]:
        return h.split(".")[::-1] if h else []

    def _along(self, node: int, p: str) -> tuple[str, str] | None:
        """The entry with the longest path at or below a host's node."""
        best, at = None, 0
        while node is not None:
            for tail, verdict, text in self.ends.get(node, ()):
                if p.startswith(tail, at):
                    best = text, verdict
                    break
            slash = p.find("/", at)
            if slash < 0:
                break
            node = self.edges.get((node, "/" + p[at:slash]))
            at = slash + 1
        return best

    def find(self, h: str, p: str) -> tuple[str, str] | None:
        """(entry, verdict) of the longest entry that fits."""
        nodes, node = [0], 0
        for label in self.labels(h):
            node = self.edges.get((node, label))
            if node is None:
                break
            nodes.append(node)
        return next((found for node in reversed(nodes) if (found := self._along(node, p))), None)


def _entries(spark: SparkSession, rules) -> DataFrame:
    rules = rules if isinstance(rules, DataFrame) else spark.createDataFrame(rules, RULES)
    parts = [F.translate(F.col("host").cast("string"), _UPPER, _LOWER).alias("host"), *[F.col(c).cast("string").alias(c) for c in ("path", "verdict")]]
    return rules.select(*parts).dropna().distinct()


def _walked(pages: DataFrame, entries: list, name: str) -> DataFrame:
    trie = pages.sparkSession.sparkContext.broadcast(Trie(entries))

    @arrow_udf("struct<host: string, path: string, rule: string, verdict: string>")
    def walk(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        find = trie.value.find
        got = [find(h, p) or (None, DEFAULT) for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([hosts, paths, *[pa.array([g[k] for g in got], pa.string()) for k in (0, 1)]], ["host", "path", "rule", "verdict"])

    return pages.withColumn(name, walk(f"{name}.host", f"{name}.path"))


def _longest(h: str, p: str, verdict: str) -> Column:
    """What orders entries: labels, length of the path, block before allow."""
    labels = F.when(F.col(h) == "", 0).otherwise(F.size(F.split(h, r"\.")))
    return F.struct(labels.alias("labels"), F.length(p).alias("length"), (F.col(verdict) == "block").cast("int").alias("block"), F.concat(h, p).alias("rule"), F.col(verdict).alias("verdict"))


def _joined(pages: DataFrame, entries: DataFrame, name: str, key: str) -> DataFrame:
    """The same by joins: no side is broadcast for its number of rows, hot hosts are salted."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    # an entry stands at its host and its path up to the last slash
    held = entries.select("host", "path", "verdict", F.regexp_extract("path", "(?s)^(.*/)?", 0).alias("stem"))
    depth = held.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.max(F.length("stem")).alias("length")).first()
    urls = pages.select(F.col(name)["host"].alias("h"), F.col(name)["path"].alias("p")).distinct()
    labels = F.split("h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(depth["labels"]))), lambda k: F.concat_ws(".", F.slice(labels, F.size(labels) - k + 1, k)))
    # a path's segments as far as the longest stem reaches; the last piece has no slash behind it
    segments = F.split(F.substring("p", 1, depth["length"]), "/")
    stems = F.transform(F.sequence(F.lit(0), F.size(segments) - 1), lambda k: F.concat(F.array_join(F.slice(segments, F.lit(1), k), "/"), F.when(k > 0, "/").otherwise("")))
    spread = urls.select("h", "p", F.pmod(F.xxhash64("h", "p"), F.lit(SALTS)).alias("salt"), F.explode(F.array_distinct(F.array_append(suffixes, F.lit("")))).alias("host"), stems.alias("stems"))
    spread = spread.select("h", "p", "salt", "host", F.explode("stems").alias("stem"))
    met = spread.join(held.select("*", salts.alias("salt")), ["host", "stem", "salt"]).where(F.col("p").startswith(F.col("path")))
    best = met.groupBy("h", "p").agg(F.max(_longest("host", "path", "verdict")).alias("best")).select("h", "p", "best.rule", "best.verdict")
    # a url with many rows is dealt to SALTS tasks by the rows' key
    dealt = pages.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS))).alias("a")
    on = (F.col(f"a.{name}.host") == F.col("b.h")) & (F.col(f"a.{name}.path") == F.col("b.p")) & (F.col("a._salt") == F.col("b.salt"))
    both = dealt.join(best.select("*", salts.alias("salt")).alias("b"), on, "left")
    told = F.struct(F.col(f"a.{name}.host").alias("host"), F.col(f"a.{name}.path").alias("path"), F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(DEFAULT)).alias("verdict"))
    return both.select(*[F.col(f"a.`{c}`") for c in pages.columns if c != name], told.alias(name))


def judge(pages: DataFrame, rules, url: str = "url", key: str = "page_id", name: str = "url_rule", most: int = MOST) -> DataFrame:
    """pages with a struct (host, path, rule, verdict): rules are rows (host, path, verdict) or a DataFrame of them.

    ``key`` deals the rows of a hot url to several tasks where the list is joined.
    """
    entries = _entries(pages.sparkSession, rules)
    parts = pages.withColumn(name, F.struct(host(F.col(url)).alias("host"), path(F.col(url)).alias("path")))
    some = entries.limit(most + 1).collect()
    return _walked(parts, [tuple(r) for r in some], name) if len(some) <= most else _joined(parts, entries, name, key)


def allowed(pages: DataFrame, rules, url: str = "url", key: str = "page_id") -> DataFrame:
    """The pages whose verdict is not block, their columns as they were."""
    return judge(pages, rules, url, key, "_judged").where("_judged.verdict <> 'block'").drop("_judged")
