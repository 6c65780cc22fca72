"""Measures of whole cells in numpy: the rows of a group, for a few columns of a wide table at a time.

Spark deals the cells over tasks in one shuffle. Rows are packed before it: a task collects some thousands, sorts them by group, and sends
each group's values as blocks of up to ``BLOCK`` columns, with like bytes side by side and compressed; the columns of a cell share one copy
of their rows' key and label. So the shuffle carries few rows, and less than the values themselves. A long table would carry key
and label with each value, and a window per rank would shuffle and sort it again. A task holds one cell packed and unpacks a block at
a time; larger groups are dealt with fewer columns, and a group too large for a single column has to take the way by slices in ``ranks``.

What a shuffle leaves on the disks goes when its result is stored. So tables of more than ``PASS_VALUES`` values are dealt in passes over
some of the columns each, and the disks hold one pass at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from factorloom.functions.numeric import finite
from factorloom.sources.shared import stored

# Most columns of a cell and of a block that is unpacked at once, and most values in a cell.
COLUMNS = 32
BLOCK = 8
CELL_VALUES = 64_000_000
# Values that a task collects before it packs them, values dealt in one pass, and values of a partition.
BATCH_VALUES = 8_000_000
PASS_VALUES = 3 << 30
PARTITION_VALUES = 25_000_000

PART, CUT = "_part", "_cut"
CODEC = "zstd"

#: Of the number of the grouping, the key as a table of one row, the kept columns, and pairs of a column's name and its values.
Measure = Callable[[int, pa.Table, pa.Table, Iterator[tuple[str, np.ndarray]]], pa.Table]


def columns_per_cell(table: DataFrame, by: Sequence[str], most: int | None = None) -> int:
    """How many columns, beside the label, of the largest group a task may hold, up to ``most``; zero if that group is too large for any."""
    return sizes(table, by, most)[0]


def sizes(table: DataFrame, by: Sequence[str], most: int | None = None) -> tuple[int, int]:
    """``columns_per_cell``, and the number of rows."""
    largest, rows = table.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    return max(min(COLUMNS if most is None else most, CELL_VALUES // max(largest or 0, 1) - 1), 0), rows or 0


def passes(columns: Iterable[str], rows: int) -> list[list[str]]:
    """Columns by passes. Those whose names differ in a trailing number are neighbours: such factors share their statistics."""
    columns = list(columns)
    stems = [re.sub(r"\d+$", "", c) for c in columns]
    first = {s: i for i, s in reversed([*enumerate(stems)])}
    ordered = [c for _, c in sorted(zip(stems, columns), key=lambda x: first[x[0]])]
    count = min(max(-(-rows * len(columns) // PASS_VALUES), 1), max(len(columns), 1))
    if count == 1:
        return [columns]
    each = -(-len(columns) // count)
    return [ordered[i : i + each] for i in range(0, len(columns), each)]


def pack(values: np.ndarray) -> bytes:
    """Doubles compressed, the first bytes of all of them before the second ones."""
    planes = np.ascontiguousarray(values).reshape(-1).view(np.uint8).reshape(-1, 8).T
    return pa.compress(np.ascontiguousarray(planes), codec=CODEC, asbytes=True)


def unpack(packed: pa.Buffer, columns: int, rows: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, columns * rows * 8, codec=CODEC), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(np.float64).reshape(columns, rows)


def per_cell(
    table: DataFrame, by: Sequence[str], columns: Iterable[str], keep: Sequence[str], each: int, measure: Measure, schema: str, rows: int = 0, once: bool = False
) -> DataFrame:
    """``measure`` of every group, given the ``keep`` columns and by name the values of ``each`` columns, NaN where they are missing or not finite.

    With the number of ``rows``, a large table is dealt in passes, unless at ``once``, and what they find is stored.
    """
    return per_cells(table, [(by, each)], columns, keep, measure, schema, rows, once, keyless=True)


def per_cells(
    table: DataFrame, cuts: Sequence[tuple[Sequence[str], int]], columns: Iterable[str], keep: Sequence[str], measure: Measure, schema: str, rows: int = 0, once: bool = False, keyless: bool = False
) -> DataFrame:
    """``per_cell`` of several groupings ``(by, each)`` of the same rows, which are read once; unless ``keyless``, rows that lack a key are in no cell."""
    columns = list(columns)
    dealt = [_dealt(table, cuts, some, keep, measure, schema, rows, keyless) for some in ([columns] if once else passes(columns, rows * len(cuts)))]
    return dealt[0] if len(dealt) == 1 else reduce(DataFrame.unionAll, [stored(d, "cells") for d in dealt])


def _dealt(table: DataFrame, cuts: Sequence[tuple[Sequence[str], int]], columns: list[str], keep: Sequence[str], measure: Measure, schema: str, rows: int, keyless: bool) -> DataFrame:
    keep, keys = list(keep), list(dict.fromkeys(k for by, _ in cuts for k in by))
    parts = [[columns[i : i + each] for i in range(0, len(columns), each)] for _, each in cuts]
    # The fewer columns a cell has, the longer they are.
    block = [max(min(BLOCK, each // 4), 1) for _, each in cuts]
    blocks = max(-(-each // b) for (_, each), b in zip(cuts, block))
    source = table.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)], *[finite(F.col(c)).alias(f"_v{i}") for i, c in enumerate(columns)]
    )
    kept = pa.schema([pa.field(c, f.type) for c, f in zip(keep, to_arrow_schema(table.select(*keep).schema))])
    key_types = [f.type for f in to_arrow_schema(table.select(*keys).schema)]
    fields = [CUT, PART, "_n", "_kept", *[f"_b{i}" for i in range(blocks)], *[f"_k{i}" for i in range(len(keys))]]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), *[pa.binary()] * blocks, *key_types]
    dealt = f"{CUT} int, {PART} int, _n long, _kept binary, {', '.join(f'_b{i} binary' for i in range(blocks))}, " + ", ".join(
        f"_k{i} {dict(table.dtypes)[k]}" for i, k in enumerate(keys)
    )

    def grouped(rows: pa.Table, by: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows in the order of their groups, and where a group starts and ends."""
        code, known = np.zeros(rows.num_rows, np.int64), np.ones(rows.num_rows, bool)
        for key in by:
            column = rows.column(f"_k{keys.index(key)}").combine_chunks()
            known &= column.is_valid().to_numpy(zero_copy_only=False)
            at = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
            code = np.unique(code * (at.max() + 1) + at, return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        if not keyless:
            order = order[known[order]]
        starts = np.flatnonzero(np.diff(code[order], prepend=-1))
        return order, starts, np.append(starts[1:], len(order))

    def packed(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        values = [rows.column(f"_v{i}").to_numpy() for i in range(len(columns))]
        own = pa.RecordBatch.from_arrays([rows.column(f"_c{i}").combine_chunks().cast(t) for i, t in enumerate(kept.types)], schema=kept)
        for cut, (by, _) in enumerate(cuts):
            order, starts, ends = grouped(rows, by)
            if not len(order):
                continue
            label, first = own.take(pa.array(order)), rows.take(pa.array(order[starts]))
            shown = [first.column(f"_k{i}").combine_chunks().cast(t) if k in by else pa.nulls(len(starts), t) for i, (k, t) in enumerate(zip(keys, key_types))]
            shared = [label.slice(lo, hi - lo).serialize().to_pybytes() for lo, hi in zip(starts, ends)]
            at = 0
            for part, names in enumerate(parts[cut]):
                found = []
                for j in range(blocks):
                    size = min(max(len(names) - j * block[cut], 0), block[cut])
                    some = np.stack([values[at + i][order] for i in range(size)]) if size else None
                    at += size
                    found.append(pa.array([None if some is None else pack(some[:, lo:hi]) for lo, hi in zip(starts, ends)], pa.binary()))
                n = len(starts)
                fixed = [pa.array([cut] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(ends - starts, pa.int64()), pa.array(shared, pa.binary())]
                yield pa.RecordBatch.from_arrays([*fixed, *found, *shown], schema=pa.schema([*zip(fields, types)]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n * max(len(columns), 1) >= BATCH_VALUES:
                yield from packed(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from packed(pa.Table.from_batches(held))

    def run(cell: pa.Table) -> pa.Table:
        cut = cell.column(CUT)[0].as_py()
        by, names, counts = cuts[cut][0], parts[cut][cell.column(PART)[0].as_py()], cell.column("_n").to_pylist()
        key = pa.table({k: cell.column(f"_k{keys.index(k)}").slice(0, 1) for k in by})
        own = pa.Table.from_batches([pa.ipc.read_record_batch(b.as_buffer(), kept) for b in cell.column("_kept")], kept)

        def unpacked() -> Iterator[tuple[str, np.ndarray]]:
            for j, start in enumerate(range(0, len(names), block[cut])):
                some, at = names[start : start + block[cut]], 0
                values = np.empty((len(some), sum(counts)))
                for b, n in zip(cell.column(f"_b{j}"), counts):
                    values[:, at : at + n] = unpack(b.as_buffer(), len(some), n)
                    at += n
                yield from zip(some, values)

        return measure(cut, key, own, unpacked())

    cell, out = [CUT, PART, *[f"_k{i}" for i in range(len(keys))]], source.mapInArrow(deal, dealt)
    partitions = rows * len(cuts) * len(columns) // PARTITION_VALUES
    if partitions > int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        # So many that a task can sort its cells without spilling.
        out = out.repartition(partitions, *cell)
    return out.groupBy(*cell).applyInArrow(run, schema)


def known(column: pa.ChunkedArray) -> np.ndarray:
    return column.is_valid().to_numpy()


def doubled_ranks(values: np.ndarray) -> np.ndarray:
    """Twice the average 1-based rank, as whole numbers."""
    _, at, n = np.unique(values, return_inverse=True, return_counts=True)
    return (2 * np.cumsum(n) - n + 1)[at]


def rank_moment(a: np.ndarray, b: np.ndarray) -> int:
    """Product moment about the mean of two doubled average ranks, without rounding."""
    n, product = len(a), a * b
    return (int((product >> 32).sum()) << 32) + int((product & 0xFFFFFFFF).sum()) - n * (n + 1) ** 2


def rank_product_moment(a: np.ndarray, b: np.ndarray, min_count: int = 2) -> float | None:
    """As ``numeric.rank_product_moment``, of the doubled ranks of one cell."""
    spread = np.sqrt(float(rank_moment(a, a))) * np.sqrt(float(rank_moment(b, b)))
    if len(a) < min_count or not spread > 0:
        return None
    return float(max(min(rank_moment(a, b) / spread, 1.0), -1.0))


class LabelRanks:
    """Doubled ranks of the label among the rows of a condition, found once for columns that lack the same rows."""

    def __init__(self, label: np.ndarray) -> None:
        self.label, self.among, self.ranks = label, None, None

    def __call__(self, among: np.ndarray) -> np.ndarray:
        if self.among is None or not np.array_equal(self.among, among):
            self.among, self.ranks = among, doubled_ranks(self.label[among])
        return self.ranks


def winsorised_ranks(values: np.ndarray, lower: float, upper: float) -> np.ndarray | None:
    """Doubled ranks of one cell as ``xsection.preprocess`` finds them, clipped to its quantiles and missing values at its median; none without a value."""
    ordered = np.sort(values[~np.isnan(values)])
    n = len(ordered)
    if not n:
        return None

    def quantile(p: float) -> float:
        at = (n - 1) * p
        low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
        return low + (high - low) * (at - np.floor(at))

    low, high = quantile(lower), quantile(upper)
    middle = low + (high - low) * 0.5 if n == 2 else quantile(0.5)
    return doubled_ranks(np.where(np.isnan(values), middle, np.maximum(np.minimum(values, high), low)))
