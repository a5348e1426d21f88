"""Running folds and substrings, and that what uses them grows in proportion."""

import hashlib
import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from reelweave.llm import _lists, chat, secrets


def test_running_folds(spark):
    rng = random.Random(1)
    held = [[rng.randint(0, 99) for _ in range(n)] for n in (0, 1, 2, 127, 128, 129, 1000, 4096)]
    df = spark.createDataFrame([(x,) for x in held], "v array<int>")
    got = df.select("v", _lists.running(F.col("v")).alias("s"), _lists.running(F.col("v"), lambda a, b: F.greatest(a, b)).alias("m")).collect()
    for r in got:
        assert r.s == list(itertools.accumulate(r.v, initial=0))[: len(r.v)]
        assert r.m == list(itertools.accumulate(r.v, max, initial=0))[: len(r.v)]
    assert df.limit(0).select(_lists.running(F.col("v"))).count() == 0


def test_substrings(spark):
    rng = random.Random(2)
    rows = []
    for n in (0, 1, 4095, 4096, 4097, 20000):
        text = "".join(rng.choice("aé\U0001f600z ") for _ in range(n))
        cuts = [sorted((rng.randint(0, n), rng.randint(0, n))) for _ in range(60)] + [[0, n], [n, n], [0, 0]]
        rows.append((text, [tuple(c) for c in cuts]))
    df = spark.createDataFrame([*rows, (None, [(0, 1)])], "t string, s array<struct<start:int,end:int>>")
    for r in df.select("t", "s", _lists.substrings(F.col("t"), F.col("s")).alias("v")).collect():
        assert r.v == [None if r.t is None else r.t[a:b] for a, b in r.s]


def findings(n):
    return "\n".join(f"token: abcdefgh{k:06d} and é AKIA{'Q' * 12}{k % 10} or" for k in range(n))


def talk(n):
    return [(1, k, ["user", "assistant", "assistant"][k % 3], f"é turn {k} </s>") for k in range(n)]


def timed(f):
    began = time.perf_counter()
    out = f()
    return time.perf_counter() - began, out


def test_many_findings_in_one_text(spark):
    def run(n):
        df = spark.createDataFrame([(1, findings(n))], "doc_id long, text string")
        return df, secrets.scan(df).select(F.size("spans").alias("n"), *secrets.report(secrets.scan(df))[:1]).first(), secrets.redact(df).first().text

    run(100)
    took = {}
    for n in (8000, 32000):
        took[n], (_, found, masked) = timed(lambda n=n: run(n))
        assert found.n == 2 * n and found.n_assign == n
        assert masked == "\n".join("[secret] and é [secret] or" for _ in range(n))
    assert took[32000] < 6 * took[8000] + 2  # four times the work


def test_long_conversations(spark):
    def run(n):
        df = spark.createDataFrame(talk(n), "conv_id long, turn long, role string, text string")
        return chat.digest(chat.render(df)).first()

    run(100)
    took = {}
    for n in (4000, 16000):
        took[n], got = timed(lambda n=n: run(n))
        said = [x for _, _, role, x in talk(n) if role == "assistant"]
        assert got.n_turns == n and got.loss_chars == sum(map(len, said))
        assert got.loss_sha256 == hashlib.sha256("".join(said).encode()).hexdigest()
        assert got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in talk(n)).encode()).hexdigest()
    assert took[16000] < 6 * took[4000] + 2


@pytest.mark.parametrize("role", [None, "", "a\n\\b", "<s>", "x" * 5000])
def test_odd_roles(spark, role):
    df = spark.createDataFrame([(1, 0, role, "a"), (1, 1, role, None), (1, 2, "assistant", ""), (1, 3, "assistant", "b</s>\\")], "conv_id long, turn long, role string, text string")
    r = chat.render(df)
    got = r.select(chat.read_back(F.col("formatted")).alias("t"), F.transform(_lists.substrings(F.col("formatted"), F.col("loss")), chat.unescape).alias("l")).first()
    assert [tuple(t) for t in got.t] == [(role or "", "a"), (role or "", ""), ("assistant", ""), ("assistant", "b</s>\\")] and got.l == ["", "b</s>\\"]
