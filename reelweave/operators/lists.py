"""Ordered lists as rows (list_id, pos, value), pos dense from 0, and the ways to align two of them.

All alignments are joins on the position within a list, so they shuffle on (list_id, pos); nothing
is collected, and a list of any length is spread over the cluster.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

KEYS = ["list_id", "pos"]


def counts(side: DataFrame, name: str) -> DataFrame:
    return side.groupBy("list_id").agg(F.count("*").alias(name))


def zip_longest(a: DataFrame, b: DataFrame) -> DataFrame:
    """(list_id, pos, a, b): every position of either side, null where one has ended."""
    return a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), KEYS, "full_outer")


def merge_lists(a: DataFrame, b: DataFrame, separator: str) -> DataFrame:
    """Items of two lists joined by position; an item without a partner stays without separator."""
    return zip_longest(a, b).select(*KEYS, F.concat_ws(separator, "a", "b").alias("value"))


#: An item that many positions of the other list meet stands in so many places.
SALTS = 64


def _last_repeated(at: DataFrame, side: DataFrame, size: DataFrame, own: str, other: str, name: str) -> DataFrame:
    """Positions with the side's items as ``name``; beyond its end its last item, in SALTS places so that no task gets all the rest."""
    beyond = F.greatest(F.col("pos").cast("long") - F.col(own) + 1, F.lit(0))
    at = at.withColumns({"_at": F.least(F.col("pos").cast("long"), F.col(own) - 1), "_salt": (beyond % SALTS).cast("int")})
    items = side.select("list_id", F.col("pos").cast("long").alias("_at"), F.col("value").alias(name)).join(size, "list_id")
    copies = F.when(F.col("_at") == F.col(own) - 1, F.least(F.greatest(F.col(other) - F.col(own), F.lit(0)), F.lit(SALTS - 1))).otherwise(F.lit(0)).cast("int")
    items = items.select("list_id", "_at", name, F.explode(F.sequence(F.lit(0), copies)).alias("_salt"))
    return at.join(items, ["list_id", "_at", "_salt"]).drop("_at", "_salt")


def zip_repeat_last(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positions up to the longer side; the shorter side's last item is repeated. Lists need both sides."""
    size = counts(a, "na").join(counts(b, "nb"), "list_id")
    grid = size.select("list_id", "na", "nb", F.explode(F.sequence(F.lit(0), (F.greatest("na", "nb") - 1).cast("int"))).alias("pos"))
    both = _last_repeated(_last_repeated(grid, a, size, "na", "nb", "a"), b, size, "nb", "na", "b")
    return both.select(*KEYS, "a", "b")


def zip_modulo(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every item of a with the item of b at its position modulo b's length; an item of b that is used again stands in up to SALTS places."""
    size = counts(a, "na").join(counts(b, "nb"), "list_id")
    pos = F.col("pos").cast("long")
    turn = F.floor(pos / F.col("nb")).cast("long")
    at = a.join(size, "list_id").select("list_id", "pos", F.col("value").alias("a"), F.pmod(pos, "nb").alias("pb"), (turn % SALTS).cast("int").alias("_salt"))
    copies = F.least(F.floor((F.col("na") - 1) / F.col("nb")), F.lit(SALTS - 1)).cast("int")
    right = b.join(size, "list_id").select("list_id", pos.alias("pb"), F.col("value").alias("b"), F.explode(F.sequence(F.lit(0), copies)).alias("_salt"))
    return at.join(right, ["list_id", "pb", "_salt"]).select(*KEYS, "a", "b")


def zip_strict(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positions of lists of equal length; a mismatch is an error when the rows are computed."""
    both = zip_longest(a.withColumn("ina", F.lit(True)), b.withColumn("inb", F.lit(True)))
    same = F.col("ina").isNotNull() & F.col("inb").isNotNull()
    return both.select(F.when(same, F.col("list_id")).otherwise(F.raise_error(F.lit("lists differ in length")).cast("bigint")).alias("list_id"), "pos", "a", "b")


def broadcast_one_or_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Lists whose reference side has one item for all positions, or one for each."""
    size = counts(a, "na").join(counts(b, "nb"), "list_id")
    fits = (F.col("nb") == 1) | (F.col("nb") == F.col("na"))
    at = a.join(size, "list_id").withColumn("pb", F.when(~fits, F.raise_error(F.lit("one reference or as many as items")).cast("bigint")).when(F.col("nb") == 1, F.lit(0)).otherwise(F.col("pos")))
    right = b.select("list_id", F.col("pos").cast("long").alias("pb"), F.col("value").alias("b"))
    return at.join(right, ["list_id", "pb"]).select(*KEYS, F.col("value").alias("a"), "b")


def compare_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): 'both', 'left' or 'right' for each key of two key sets."""
    left, right = a.select(key).distinct().withColumn("l", F.lit(1)), b.select(key).distinct().withColumn("r", F.lit(1))
    side = F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("both")
    return left.join(right, key, "full_outer").select(key, side.alias("side"))


def repeat(values: DataFrame, times: int) -> DataFrame:
    """Each value as a list of 1 to 100 equal items."""
    if not 1 <= times <= 100:
        raise ValueError("times must be 1 to 100")
    return values.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def pick(items: DataFrame, index: int) -> DataFrame:
    """The item at an index of each list, or all with -1."""
    return items if index < 0 else items.where(F.col("pos") == index)


#: Drawn items leave a task in Arrow batches of so many.
PART = 1 << 14


def _drawn(rows: DataFrame, given: list[Column], draw: Callable[..., Iterable[str]], name: str) -> DataFrame:
    """rows with (pos, ``name``): the texts that draw(*given) yields for each row, in order, PART at a time."""
    carried = [c for c in rows.columns if c not in ("pos", name)]
    width, mark = len(carried), "_given"
    while any(c.startswith(mark) for c in rows.columns):
        mark = f"_{mark}"

    def part(batch: pa.RecordBatch, row: list, pos: list, items: list) -> pa.RecordBatch:
        kept = [batch.column(k).take(pa.array(row, pa.int64())) for k in range(width)]
        return pa.RecordBatch.from_arrays([*kept, pa.array(pos, pa.int32()), pa.array(items, pa.string())], [*carried, "pos", name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pos, items = [], [], []
            for k, args in enumerate(zip(*(batch.column(i).to_pylist() for i in range(width, batch.num_columns)), strict=True)):
                for at, item in enumerate(draw(*args)):
                    row.append(k)
                    pos.append(at)
                    items.append(item)
                    if len(row) == PART:
                        yield part(batch, row, pos, items)
                        row, pos, items = [], [], []
            yield part(batch, row, pos, items)

    schema = StructType([rows.schema[c] for c in carried]).add("pos", IntegerType()).add(name, StringType())
    return rows.select(*carried, *[g.alias(f"{mark}{k}") for k, g in enumerate(given)]).mapInArrow(run, schema)


def _seeds_of(low: str, high: str, total: int, seed: str) -> Iterator[str]:
    draw = random.Random(int(seed))
    return (str(draw.randint(int(low), int(high))) for _ in range(total))


def seed_lists(rows: DataFrame, low: Column, high: Column, method: str, total: Column, seed: Column | None = None) -> DataFrame:
    """rows with (pos, seed DECIMAL(20,0)): a list of ``total`` unsigned 64-bit seeds for each row.

    Rising or falling lists are held at their bound; "random" ones come from a generator of the row's own,
    started with its ``seed`` (null or none: 0), so they do not depend on how rows are dealt to tasks.
    Bounds may come in either order.  A row with a null bound or a total that is null or below 1 has no
    list; columns named pos or seed are replaced.
    """
    wide = lambda c: c.cast("decimal(38,0)")
    a, b, n = wide(low), wide(high), total.cast("int")
    rows = rows.where(a.isNotNull() & b.isNotNull() & (n >= 1))
    least, most = F.least(a, b), F.greatest(a, b)
    if method == "random":
        start = F.lit(0) if seed is None else F.coalesce(wide(seed), wide(F.lit(0)))
        drawn = _drawn(rows, [least.cast("string"), most.cast("string"), n, start.cast("string")], _seeds_of, "seed")
        return drawn.withColumn("seed", F.col("seed").cast("decimal(20,0)"))
    step = {"increment": lambda i: F.least(least + wide(i), most), "decrement": lambda i: F.greatest(most - wide(i), least)}[method]
    listed = F.transform(F.sequence(F.lit(0), n - 1), lambda i: step(i).cast("decimal(20,0)"))
    return rows.select(*[c for c in rows.columns if c not in ("pos", "seed")], F.posexplode(listed).alias("pos", "seed"))


def seeds(spark: SparkSession, low: int, high: int, method: str, total: int, seed: int = 0) -> DataFrame:
    """(pos, seed DECIMAL(20,0)): one list of seeds, as ``seed_lists`` makes for each row."""
    whole = lambda v: F.lit(str(v))
    return seed_lists(spark.range(1), whole(low), whole(high), method, F.lit(total), whole(seed)).select("pos", "seed")


def step_seeds(pos: Column, seed: Column, policy: str) -> Column:
    """Seed of each item under a fixed, rising or falling policy, without bounds."""
    wide = seed.cast("decimal(38,0)")
    return {"fixed": wide, "increment": wide + pos, "decrement": wide - pos}[policy].cast("decimal(38,0)")


def _prompts_of(template: str, n: int, seed: str) -> Iterable[str]:
    if not template.strip():
        return [""]
    # literals and the insides of closed blocks take turns; a block's blank choices don't count
    parts: list = re.split(r"\[([^\]]*)\]", template)
    parts[1::2] = [[c.strip() for c in block.split("|") if c.strip()] for block in parts[1::2]]
    draw = random.Random(int(seed))
    return ("".join(draw.choice(p) if isinstance(p, list) else p for p in parts if p).strip() for _ in range(n))


def prompt_lists(rows: DataFrame, template: Column, n: Column, seed: Column) -> DataFrame:
    """rows with (pos, prompt): ``n`` prompts of each row's template, its [a|b|c] blocks drawn in sequence.

    Each row has a generator of its own, started with its ``seed`` (null: 0), and each block draws, also
    one of a single choice.  A block without choices is empty, one that isn't closed is literal; a null or
    blank template gives one empty prompt; a null ``n`` gives none; columns named pos or prompt are replaced.
    """
    start = F.coalesce(seed.cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).cast("string")
    return _drawn(rows.where(n.isNotNull()), [F.coalesce(template, F.lit("")), n.cast("int"), start], _prompts_of, "prompt")


def joined_prompts(prompts: DataFrame, *keys: str) -> DataFrame:
    """(keys, prompts): the prompts of each row in order, joined by " | "."""
    return prompts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "prompt"))).alias("l")).select(*keys, F.array_join(F.transform("l", lambda x: x["prompt"]), " | ").alias("prompts"))


def random_prompts(spark: SparkSession, template: str, n: int, seed: int) -> DataFrame:
    """(pos, prompt): the prompts of one template, as ``prompt_lists`` makes for each row."""
    return prompt_lists(spark.range(1), F.lit(template), F.lit(n), F.lit(str(seed))).select("pos", "prompt")
