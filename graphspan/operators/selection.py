"""Selection: offset, limit, sampling, balancing, batches and chunks over an ordered source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import code
from ..plans.storage import cut


def check_limit(limit) -> None:
    if limit is None:
        return
    if isinstance(limit, bool) or not isinstance(limit, int | float):
        raise ValueError("limit is a whole number or a share")
    if isinstance(limit, int) and limit < 0 or isinstance(limit, float) and not 0 < limit < 1:
        raise ValueError("limit is 0 or more, or a share between 0 and 1")


def check_count(name: str, n, least: int = 0) -> None:
    if isinstance(n, bool) or not isinstance(n, int) or n < least:
        raise ValueError(f"{name} is a whole number, {least} at least")


def numbered(df: DataFrame, seq: str, out: str = "pos") -> DataFrame:
    """df with each row's place (from 0) in the order of seq."""
    return ranked(df, [], [seq], out)


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str = "pos") -> DataFrame:
    """df with each row's place (from 0) among the rows of its keys, by order; neither all
    rows nor those of one key need fit one task. Rows are dealt by range, once: the dealing
    is kept, as its bounds are sampled anew each time it is computed. Ranges are counted,
    and places start at the counts of the ranges before."""
    parts = cut(df.repartitionByRange(*keys, *order).withColumn("__p", F.spark_partition_id()))
    by = [*keys, "__p"]
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__p").alias("__q"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    on = F.col("__p") == F.col("__q")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    own = Window.partitionBy(*by).orderBy(*order)
    return parts.join(starts, on).withColumn(out, F.col("__before") + F.row_number().over(own) - 1).drop("__p", "__q", "__before", *[f"__{k}" for k in keys])


def offset_limit(df: DataFrame, seq: str, start_after: int = 0, limit: int | float | None = None, seed: int = 0) -> DataFrame:
    """Without the first start_after rows; then the first `limit`, or each with that share."""
    check_limit(limit)
    check_count("start_after_instance", start_after)
    if start_after and not isinstance(limit, int):  # no global order: places are counted by ranges
        df = numbered(df, seq, "__pos").filter(F.col("__pos") >= start_after).drop("__pos")
    if isinstance(limit, float):
        return bernoulli(df, seq, limit, seed)
    # a first number of rows is kept by each task, so what meets in one is at most that number
    return df if limit is None else df.orderBy(seq).offset(start_after).limit(limit)


def running_sums(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """df with before_<c> for each column: its sum over the rows before in a distinct order.
    As in `ranked`, ranges are dealt once and start at the sums of the ranges before."""
    parts = cut(df.repartitionByRange(order).withColumn("__p", F.spark_partition_id()))
    before = Window.orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sums = parts.groupBy(F.col("__p").alias("__q")).agg(*[F.sum(c).alias(f"__s_{c}") for c in columns])
    starts = sums.select("__q", *[F.coalesce(F.sum(f"__s_{c}").over(before), F.lit(0)).alias(f"__b_{c}") for c in columns])
    own = Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.join(F.broadcast(starts), F.col("__p") == F.col("__q"))
    return out.select(*df.columns, *[(F.col(f"__b_{c}") + F.coalesce(F.sum(c).over(own), F.lit(0))).alias(f"before_{c}") for c in columns])


def draw(seq: Column, seed: int, purpose: str) -> Column:
    """A repeatable draw for each row, the same wherever it is computed."""
    return code(F.concat(F.lit(f"{purpose}:{seed}:"), seq.cast("string")))


def bernoulli(df: DataFrame, seq: str, share: float, seed: int = 0) -> DataFrame:
    if not 0 < share < 1:
        raise ValueError("the share lies between 0 and 1")
    return df.filter(F.pmod(draw(F.col(seq), seed, "sample"), F.lit(1_000_000)) < round(share * 1_000_000))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): weight is rows / (classes * n)."""
    n = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("k"))
    return n.join(F.broadcast(total)).select("label", "n", (F.col("all_n") / (F.col("k") * F.col("n"))).alias("weight"))


def balanced(df: DataFrame, seq: str, label: str, target: int | None = None, seed: int = 0) -> DataFrame:
    """As many rows of each class as the smallest has or target // classes; rows of any class
    fill the rest of target. Fewer than two classes are an error."""
    counts = df.groupBy(label).count().agg(F.count(F.lit(1)), F.min("count"), F.sum("count")).first()
    k, least, total = counts
    if k < 2:
        raise ValueError("balancing needs two classes at least")
    if target is not None:
        check_count("limit", target)
    per_class = least if target is None else min(least, target // k)
    placed = ranked(df.withColumn("__draw", draw(F.col(seq), seed, "balance")), [label], ["__draw", seq], "__rank")
    chosen = placed.filter(F.col("__rank") < per_class)
    rest = (per_class * k if target is None else min(target, total)) - per_class * k
    if rest > 0:
        left = numbered(placed.filter(F.col("__rank") >= per_class).withColumn("__order", F.struct("__draw", seq)), "__order", "__pos")
        chosen = chosen.unionByName(left.filter(F.col("__pos") < rest).drop("__order", "__pos"))
    return chosen.drop("__draw", "__rank")


def batches(df: DataFrame, seq: str, size: int) -> DataFrame:
    """df with batch_id: batches of `size` rows in order, the last one shorter."""
    check_count("batch_size", size, 1)
    return numbered(df, seq, "__pos").withColumn("batch_id", F.floor(F.col("__pos") / size)).drop("__pos")


def chunks(df: DataFrame, seq: str, n: int) -> DataFrame:
    """df with chunk (from 0): n contiguous parts whose sizes differ by one at most."""
    check_count("chunks", n, 1)
    total = df.count()
    big, size = total % n, total // n
    pos = F.col("__pos")
    cut = big * (size + 1)
    chunk = F.when(pos < cut, F.floor(pos / (size + 1))).otherwise(big + F.floor((pos - cut) / max(1, size)))
    return numbered(df, seq, "__pos").withColumn("chunk", chunk).drop("__pos")


def stratified_split(df: DataFrame, seq: str, label: str, share: float = 0.7, seed: int = 0) -> DataFrame:
    """df with in_train: of each class, the share (rounded down) that a repeatable draw puts first."""
    if not 0 < share < 1:
        raise ValueError("the share lies between 0 and 1")
    n = df.groupBy(F.col(label).alias("__label")).agg(F.floor(F.count(F.lit(1)) * share).alias("__take"))
    placed = ranked(df.withColumn("__draw", draw(F.col(seq), seed, "split")), [label], ["__draw", seq], "__rank")
    return placed.join(n, F.col(label).eqNullSafe(F.col("__label"))).withColumn("in_train", F.col("__rank") < F.col("__take")).drop("__draw", "__rank", "__label", "__take")


def learning_prefixes(df: DataFrame, seq: str, least: int = 100) -> DataFrame:
    """(size, *columns): nested prefixes in the order of seq, of all rows, half of them and so
    on down to `least`. Each row is repeated as often as it lies in a prefix."""
    check_count("least", least, 1)
    sizes, n = [], df.count()
    while n >= least:
        sizes.append(n)
        n //= 2
    fits = F.filter(F.array(*[F.lit(s).cast("long") for s in sizes]).cast("array<bigint>"), lambda s: s > F.col("__pos"))
    return numbered(df, seq, "__pos").withColumn("size", F.explode(fits)).drop("__pos")
