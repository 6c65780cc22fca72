"""Fill-in-the-middle by displacement scatter: bytes move by shifts that are summed up from a few differences per document.

Texts of an Arrow batch lie one after another in one byte buffer. Line ends are found in the whole buffer at once, and two cuts per
document follow from its hash. A difference array then says, at the first byte of every prefix, middle and suffix, how far output places
leave input places; its cumulative sum is the output place of every byte, and one scatter writes all outputs of the batch. The markers go to
the places left free. Restoring finds the markers in an output, sums up the same kind of differences, and gathers the bytes back.

Defined cases: a null text is an empty one, and an empty text or one that holds a marker of its own stays plain; a null ``doc_id`` hashes
as an empty string; a text may be of any length, it is a slice of its own then; repeated rows are transformed one by one, and equally;
an empty table gives an empty table; other columns are kept, except those named as results, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

# Fixed values of the format.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK = 3
PLAIN, PSM, SPM = "plain", "psm", "spm"

#: Texts of one scatter, in bytes; a longer text is a slice of its own. Places take four bytes per byte of text.
SLICE_BYTES = 4_000_000

RESULTS = StructType(
    [
        StructField("n", LongType()),
        StructField("form", StringType()),
        StructField("prefix_chars", LongType()),
        StructField("middle_chars", LongType()),
        StructField("output", StringType()),
    ]
)


def hash_numbers(seed: int) -> list[Column]:
    """The first four groups of eight hexadecimal digits of ``sha256(seed:doc_id)``, as numbers."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    digest = F.sha2(key.cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text starts in them; nulls are empty."""
    column = column.cast(pa.string()).fill_null("")
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[places[0] : places[-1]], places - places[0]


def strings(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def marks(data: np.ndarray) -> np.ndarray:
    """Places of all markers in the buffer."""
    if len(data) < MARK:
        return np.zeros(0, np.int64)
    return np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")) & np.isin(data[1:-1], np.frombuffer(b"PSM", np.uint8)))


def documents_of(places: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.searchsorted(starts, places, side="right") - 1


def destinations(length: int, at: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Place of every byte, from shifts that hold from the places ``at`` (ascending) on.

    Several segments may start at one place where all but the last are empty; their differences add up.
    """
    step = np.ones(length + 1, np.int64 if length > 2**30 else np.int32)
    step[0] = 0
    np.add.at(step, at, np.diff(shifts, prepend=0))
    return np.cumsum(step[:length], dtype=step.dtype)


def transform(data: np.ndarray, starts: np.ndarray, numbers: list[np.ndarray], rate: int, spm: int) -> tuple[list, np.ndarray, np.ndarray]:
    """``n``, form, prefix and middle characters of each text, and the bytes and starts of the outputs."""
    first, last, count = starts[:-1], starts[1:], len(starts) - 1
    line_ends = np.flatnonzero(data == ord("\n")) + 1
    before, after = np.searchsorted(line_ends, first, side="right"), np.searchsorted(line_ends, last, side="right")
    closed = after - before
    # Text behind the last line end is a line too.
    open_end = (last > first) & ((closed == 0) | (line_ends[np.maximum(after - 1, 0)] != last if len(line_ends) else True))
    n = closed + open_end
    found = marks(data)
    owner = documents_of(found, starts)
    marked = np.zeros(count, bool)
    marked[owner[found + MARK <= last[owner]]] = True
    plain = (last == first) | marked | (numbers[2] % 100 >= rate)
    spm_form = ~plain & (numbers[3] % 100 < spm)

    def cut(units: np.ndarray) -> np.ndarray:
        ends = line_ends[np.clip(before + units - 1, 0, max(len(line_ends) - 1, 0))] if len(line_ends) else last
        return np.where(units == 0, first, np.where(units > closed, last, ends))

    one, two = numbers[0] % (n + 1), numbers[1] % (n + 1)
    a, b = np.where(plain, first, cut(np.minimum(one, two))), np.where(plain, last, cut(np.maximum(one, two)))
    sizes = last - first + np.where(plain, 0, 3 * MARK)
    out = np.concatenate([[0], np.cumsum(sizes)])
    base, suffix = out[:-1], last - b
    # Where prefix, middle and suffix go, marker by marker.
    to_prefix = np.where(plain, base, np.where(spm_form, base + 2 * MARK + suffix, base + MARK))
    to_suffix = np.where(spm_form, base + MARK, base + 2 * MARK + (a - first))
    to_middle = np.where(plain, base, out[1:] - (b - a))
    at = np.stack([first, a, b], 1).ravel()
    shifts = np.stack([to_prefix - first, to_middle - a, np.where(plain, to_middle - a, to_suffix - b)], 1).ravel()
    result = np.empty(out[-1], np.uint8)
    result[destinations(len(data), at, shifts)] = data
    for places, mark in ((to_prefix, PREFIX), (to_suffix, SUFFIX), (to_middle, MIDDLE)):
        for i, byte in enumerate(mark.encode()):
            result[places[~plain] - MARK + i] = byte
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    form = pa.array(np.where(plain, PLAIN, np.where(spm_form, SPM, PSM)).tolist(), pa.string())
    prefix = pa.array(points[a] - points[first], pa.int64(), mask=plain)
    middle = pa.array(points[b] - points[a], pa.int64(), mask=plain)
    return [pa.array(n, pa.int64()), form, prefix, middle], result, out


def restore(data: np.ndarray, starts: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and starts of the texts, from the outputs and their forms alone."""
    first, last = starts[:-1], starts[1:]
    plain, spm_form = forms == PLAIN, forms == SPM
    found = marks(data)
    owner = documents_of(found, starts)
    inside = ~plain[owner] & (found + MARK <= last[owner])
    found = found[inside].reshape(-1, 3)
    # Three markers of every transformed text, in the order of its form.
    bounds = np.stack([first, first, first], 1)
    bounds[~plain] = found
    p, s, m = np.where(spm_form, bounds[:, 1], bounds[:, 0]), np.where(spm_form, bounds[:, 0], bounds[:, 1]), bounds[:, 2]
    sizes = last - first - np.where(plain, 0, 3 * MARK)
    out = np.concatenate([[0], np.cumsum(sizes)])
    prefix = np.where(spm_form, m, s) - p - MARK
    middle = last - m - MARK
    # Segments of the text in its own order, each with the place in the output that it is gathered from.
    at = np.stack([out[:-1], out[:-1] + np.where(plain, 0, prefix), out[:-1] + np.where(plain, 0, prefix + middle)], 1).ravel()
    source = np.stack([np.where(plain, first, p + MARK), np.where(plain, first, m + MARK), np.where(plain, first, s + MARK)], 1).ravel()
    return data[destinations(out[-1], at, source - at)], out


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about ``SLICE_BYTES``."""
    _, starts = text_bytes(batch.column(column))
    cuts = [0, *(np.flatnonzero(np.diff(starts[:-1] // SLICE_BYTES)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:]):
        if end > start:
            yield batch.slice(start, end - start)


def fill_in_middle(docs: DataFrame, rate_percent: int = 100, spm_percent: int = 50, seed: int = 7) -> DataFrame:
    """All columns of ``docs`` but ``text``, with ``n`` lines, the form, prefix and middle characters, and the output text."""
    keep = [c for c in docs.columns if c.lower() not in {"text", *(f.name for f in RESULTS)}]
    row = docs.select(F.struct(*keep).alias("row"), "text", *(h.alias(f"h{i}") for i, h in enumerate(hash_numbers(seed))))
    schema = StructType([row.schema["row"], *RESULTS])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text") if batch.num_rows else ():
                data, starts = text_bytes(part.column("text"))
                numbers = [part.column(f"h{i}").to_numpy() for i in range(4)]
                measures, output, places = transform(data, starts, numbers, rate_percent, spm_percent)
                yield pa.RecordBatch.from_arrays([part.column("row"), *measures, strings(output, places)], schema=arrow)

    return row.mapInArrow(run, schema).select("row.*", *(f.name for f in RESULTS))


def restored(transformed: DataFrame) -> DataFrame:
    """``transformed`` with the exact ``restored`` text, built from ``output`` and ``form`` alone."""
    row = transformed.drop("restored").select(F.struct("*").alias("row"), "output", "form")
    schema = StructType([row.schema["row"], StructField("restored", StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "output") if batch.num_rows else ():
                forms = np.array(part.column("form").to_pylist(), dtype=object)
                texts = strings(*restore(*text_bytes(part.column("output")), forms))
                yield pa.RecordBatch.from_arrays([part.column("row"), texts], schema=arrow)

    return row.mapInArrow(run, schema).select("row.*", "restored")
