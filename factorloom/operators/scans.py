"""Running values over whole histories, from block summaries, so that no history is held by one task.

A running value such as a fill, a product or a maximum needs everything before a row. Where one key may hold a large share of all
rows, its history is cut into blocks by a non-decreasing function of the order (a month, a range of row numbers). Each block is
scanned on its own and leaves one summary; a second scan over the summaries, a few per key, finds what each block starts
from; and the two are merged per row. Summaries merge associatively, so results equal those of one unsplit window.

Rows are shuffled once, by key and block. Keys and blocks may be null; nulls are a key, or a first block, of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from math import ceil, log

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from factorloom.functions.frames import so_far
from factorloom.functions.numeric import div

#: Largest exponent by which values inside a block of a decayed mean are scaled; doubles reach 709.
SCALE = 500.0
#: Decay, as an exponent, below which a value does not change a double.
NEGLIGIBLE = 45.0


@dataclass(frozen=True)
class Scan:
    """A running value: inside a block, the block's summary, the merge of earlier summaries, and of both per row."""

    inside: Callable[[WindowSpec], Column]
    summary: Column
    earlier: Callable[[Column], Column]
    merged: Callable[[Column, Column], Column]


def last_known(value: str, order: str) -> Scan:
    """The latest value that is not null, up to and including the row."""
    v = F.col(value)
    return Scan(
        lambda spec: F.last(v, ignorenulls=True).over(so_far(spec)),
        F.max_by(v, F.when(v.isNotNull(), F.col(order))),
        lambda s: F.last(s, ignorenulls=True),
        lambda before, here: F.coalesce(here, before),
    )


def _folding(aggregate: Callable[[Column], Column], merge: Callable[[Column, Column], Column]) -> Callable[[Column], Scan]:
    def scan(value: Column) -> Scan:
        return Scan(
            lambda spec: aggregate(value).over(so_far(spec)),
            aggregate(value),
            aggregate,
            lambda before, here: F.when(before.isNull(), here).when(here.isNull(), before).otherwise(merge(before, here)),
        )

    return scan


#: Running product, maximum and sum of the values that are not null; null before the first of them.
product = _folding(F.product, lambda a, b: a * b)
maximum = _folding(F.max, F.greatest)
total = _folding(F.sum, lambda a, b: a + b)


def previous(value: Column, order: str) -> Scan:
    """The value of the row before, whether null or not; null in the first row."""
    held = F.struct(value.alias("v"))
    return Scan(
        lambda spec: F.lag(held).over(spec),
        F.max_by(held, order),
        F.last,
        lambda before, here: F.coalesce(here, before)["v"],
    )


def running(df: DataFrame, scans: Mapping[str, Scan], keys: Sequence[str], order: str, block: Column) -> DataFrame:
    """``df`` with one column per scan, over each key's rows in ``order``; ``block`` never decreases along it.

    ``order`` must be unique within a key. A column of the same name is replaced.
    """
    keys = list(keys)
    rows = df.withColumn("_block", block)
    spec = Window.partitionBy(*keys, "_block").orderBy(order)
    local = rows.withColumns({f"_here_{n}": s.inside(spec) for n, s in scans.items()})
    sums = rows.groupBy(*keys, "_block").agg(*[s.summary.alias(f"_sum_{n}") for n, s in scans.items()])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.col("_block").alias("_key_block"),
        *[s.earlier(F.col(f"_sum_{n}")).over(before).alias(f"_before_{n}") for n, s in scans.items()],
    )
    same = F.col("_block").eqNullSafe(F.col("_key_block"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    found = local.join(starts, same, "left")
    merged = {n: s.merged(F.col(f"_before_{n}"), F.col(f"_here_{n}")) for n, s in scans.items()}
    kept = [c for c in df.columns if c not in merged]
    out = found.select(*kept, *[c.alias(n) for n, c in merged.items()])
    return out.select(*df.columns, *[n for n in merged if n not in df.columns])


def decayed_means(df: DataFrame, means: Mapping[str, tuple[str, int]], keys: Sequence[str], index: str = "t") -> DataFrame:
    """``df`` with exponential means, ``{name: (value, span)}``, over each key's whole history.

    The weight of a value falls by ``1 - 2 / (span + 1)`` with each later row, missing ones included, and weights are normalised over
    the values known. ``index`` numbers a key's rows from 0. Inside a block the running sums of value and weight are scaled
    by the decay to the row's place, which blocks keep within the range of doubles; a block's summary is its weighted sum and
    its weight at its end, and summaries merge by the decay between their ends. Blocks so old that they weigh less than the last digit
    of a double are left out, unless all in between are empty: then the mean of the latest one is all that is known.
    """
    keys = list(keys)
    rates = {name: -log(1 - 2 / (span + 1)) for name, (_, span) in means.items()}
    length = max(int(SCALE / max(rates.values())), 1)
    row, block = F.col(index), F.col("_block")
    rows = df.withColumn("_block", F.floor(row / length).cast("long"))
    place = row - block * length
    spec = so_far(Window.partitionBy(*keys, "_block").orderBy(index))
    ordered = Window.partitionBy(*keys).orderBy("_block")

    def decayed(part: Column, what: str, rate: float, end: Column) -> Column:
        """What is left of a block's summary at the end of a later block."""
        return part[what] * F.exp((part["at"] - end) * (length * rate))

    scaled, sums, ends, starts, out = {}, [], {}, [], {}
    for name, (value, _) in means.items():
        rate, x = rates[name], F.col(value).cast("double")
        grown, to_end = F.exp(place * rate), F.exp((place - (length - 1)) * rate)
        scaled[f"_num_{name}"] = F.sum(x * grown).over(spec)
        scaled[f"_den_{name}"] = F.sum(F.when(x.isNotNull(), grown)).over(spec)
        summary = F.struct(F.sum(x * to_end).alias("num"), F.sum(F.when(x.isNotNull(), to_end)).alias("den"), F.first("_block").alias("at"))
        sums.append(F.when(F.count(x) > 0, summary).alias(f"_sum_{name}"))

        reach = ceil(NEGLIGIBLE / (length * rate))
        near = F.collect_list(f"_sum_{name}").over(ordered.rowsBetween(-reach, 0))
        folded = {}
        for what in ("num", "den"):
            parts = F.transform(near, lambda part: decayed(part, what, rate, block))  # noqa: B023 - called at once
            folded[what] = F.aggregate(parts, F.lit(0.0), lambda acc, part: acc + part).alias(what)
        # What the rows up to a block's end come to; after a block without values the latest one holds, further decayed.
        ends[f"_end_{name}"] = F.when(F.col(f"_sum_{name}").isNotNull(), F.struct(*folded.values(), block.alias("at")))
        last = F.last(f"_end_{name}", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
        left = [decayed(last, what, rate, block - 1).alias(what) for what in ("num", "den")]
        starts.append(F.struct(*left, div(last["num"], last["den"]).alias("mean")).alias(f"_from_{name}"))
        start, shrink, gap = F.col(f"_from_{name}"), F.exp(-place * rate), F.exp(-(place + 1) * rate)
        num, den = F.col(f"_num_{name}") * shrink, F.col(f"_den_{name}") * shrink
        merged = div(num + start["num"] * gap, den + start["den"] * gap)
        out[name] = F.when(den.isNull(), start["mean"]).when(start["mean"].isNull(), div(num, den)).otherwise(merged)
    local = rows.withColumns(scaled)
    same = block == F.col("_key_block")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    blocks = rows.groupBy(*keys, "_block").agg(*sums).withColumns(ends)
    carried = blocks.select(*[F.col(k).alias(f"_key_{k}") for k in keys], block.alias("_key_block"), *starts)
    return local.join(carried, same, "left").select(*df.columns, *[c.alias(n) for n, c in out.items()])
