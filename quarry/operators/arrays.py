"""N-dimensional arrays as tables of cells: selections, chunks, unpacking, encodings."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Hyperslab:
    """start, stride, count and block for each dimension; stride is at least block."""

    start: tuple[int, ...]
    stride: tuple[int, ...]
    count: tuple[int, ...]
    block: tuple[int, ...]

    def __post_init__(self):
        if any(s < b or b < 1 or s < 1 for s, b in zip(self.stride, self.block, strict=True)):
            raise ValueError("stride must be at least block, and both positive")

    @classmethod
    def ranges(cls, *bounds: tuple[int, int]) -> Hyperslab:
        one = (1,) * len(bounds)
        return cls(tuple(a for a, _ in bounds), one, tuple(b - a for a, b in bounds), one)

    def shape(self) -> tuple[int, ...]:
        return tuple(c * b for c, b in zip(self.count, self.block, strict=True))

    def size(self) -> int:
        return math.prod(self.shape())

    def contains(self, *index: Column) -> Column:
        """Whether a cell is selected; the bounding range comes first, so that it reaches the scan."""
        parts = []
        for i, s, t, c, b in zip(index, self.start, self.stride, self.count, self.block, strict=True):
            parts += [i >= s, i < s + (c - 1) * t + b]
            if t != b:
                parts.append(F.pmod(i - s, F.lit(t)) < b)
        return reduce(lambda x, y: x & y, parts)

    def touches(self, chunk: tuple[int, ...], *coordinates: Column) -> Column:
        """Whether a chunk of that shape may hold selected cells, by bounding ranges."""
        parts = []
        for k, s, t, c, b, n in zip(coordinates, self.start, self.stride, self.count, self.block, chunk, strict=True):
            parts += [k * n < s + (c - 1) * t + b, (k + 1) * n > s]
        return reduce(lambda x, y: x & y, parts)


def local_ranges(slab: Hyperslab, chunk: tuple[int, ...], *coordinates: Column) -> list[tuple[Column, Column]]:
    """For each dimension the range within a chunk (of that shape, at its coordinates) that holds its selected cells: first and past the last."""
    out = []
    for k, n, s, t, c, b in zip(coordinates, chunk, slab.start, slab.stride, slab.count, slab.block, strict=True):
        low, high = F.greatest(F.lit(s).cast("long"), k * n), F.least(F.lit(s + (c - 1) * t + b).cast("long"), (k + 1) * n) - 1
        over, under = F.pmod(low - s, F.lit(t)), F.pmod(high - s, F.lit(t))
        first = F.when(over < b, low).otherwise(low + (t - over))
        last = F.when(under < b, high).otherwise(high - under + (b - 1))
        out.append((first - k * n, last + 1 - k * n))
    return out


def decoded_selection(data: bytes) -> tuple[str, Hyperslab | None, int]:
    """(all, none or hyperslab, the hyperslab, bytes read) of a serialized selection; regular hyperslabs of version 3 only, else ValueError."""
    if len(data) < 8:
        raise ValueError("cut short")
    kind, version = struct.unpack_from("<II", data)
    if kind in (0, 3):
        if len(data) < 16:
            raise ValueError("cut short")
        return ("all" if kind == 3 else "none"), None, 16
    if kind != 2 or version != 3 or len(data) < 14:
        raise ValueError("only whole, empty and regular selections of version 3 are known")
    regular, width, rank = struct.unpack_from("<BBI", data, 8)
    if not regular & 1 or width not in (2, 4, 8) or rank > 32:
        raise ValueError("an irregular selection, or one of unknown width or rank")
    end = 14 + 4 * rank * width
    if len(data) < end:
        raise ValueError("cut short")
    numbers = [int.from_bytes(data[k : k + width], "little") for k in range(14, end, width)]
    return "hyperslab", Hyperslab(*(tuple(numbers[k::4]) for k in range(4))), end


def encoded_selection(selection: Hyperslab | None, everything: bool = True) -> bytes:
    """The serialized form that ``decoded_selection`` reads, with coordinates of 8 bytes."""
    if selection is None:
        return struct.pack("<IIII", 3 if everything else 0, 1, 0, 0)
    each = zip(selection.start, selection.stride, selection.count, selection.block, strict=True)
    return struct.pack("<IIBBI", 2, 3, 1, 8, len(selection.start)) + b"".join(struct.pack("<QQQQ", *x) for x in each)


def points(cells: DataFrame, wanted: list[tuple[int, ...]], columns: list[str]) -> DataFrame:
    """Cells at a list of points, through a join."""
    spark = cells.sparkSession
    table = spark.createDataFrame(wanted, ", ".join(f"{c} long" for c in columns))
    return cells.join(F.broadcast(table) if len(wanted) <= 100_000 else table, columns, "left_semi")


def row_major(shape: tuple[int, ...], *index: Column) -> Column:
    """The place of a cell in row-major order."""
    return reduce(lambda acc, x: acc * x[1] + x[0], zip(index[1:], shape[1:], strict=True), index[0])


def morton(bits: int, *index: Column) -> Column:
    """The Z-order index: bit k of dimension d becomes bit k * dimensions + d."""
    n = len(index)
    parts = [F.shiftleft(F.shiftright(x.cast("long"), k).bitwiseAND(F.lit(1).cast("long")), k * n + d) for d, x in enumerate(index) for k in range(bits)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def chunked(cells: DataFrame, index: list[str], chunk: tuple[int, ...], value: str) -> DataFrame:
    """One row for each chunk: its coordinates and its cells' values in row-major order."""
    coords = [F.floor(F.col(c) / n).alias(f"chunk_{c}") for c, n in zip(index, chunk, strict=True)]
    place = row_major(chunk, *(F.pmod(F.col(c), F.lit(n)) for c, n in zip(index, chunk, strict=True)))
    cells = cells.withColumn("__cell", F.struct(place.alias("place"), F.col(value).alias("value")))
    return cells.groupBy(*coords).agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list("__cell")), lambda x: x["value"]).alias("payload"))


def updated(cells: DataFrame, new: DataFrame, index: list[str]) -> DataFrame:
    """Cells with the values of ``new`` where it has some."""
    return cells.join(new.withColumnRenamed("value", "__new"), index, "left").withColumn("value", F.coalesce("__new", "value")).drop("__new")


def is_missing(value: Column, fill: float | None = None, missing: float | None = None) -> Column:
    """Whether a value is the fill or missing value, or NaN where that is NaN."""
    out = F.lit(False)
    for mark in (fill, missing):
        if mark is not None:
            out = out | (F.isnan(value) if math.isnan(mark) else (F.abs(value - mark) < 2.220446049250313e-16))
    return out


def unpacked(value: Column, scale: float | None = None, offset: float | None = None, fill: float | None = None, missing: float | None = None) -> Column:
    """value x scale + offset, NaN for missing ones; values stay as they are where neither scale nor offset is given."""
    if scale is None and offset is None:
        return value
    return F.when(is_missing(value, fill, missing), F.lit(float("nan"))).otherwise(value * (1.0 if scale is None else scale) + (0.0 if offset is None else offset))


def dictionary(rows: DataFrame, value: str, order: str) -> DataFrame:
    """code, value: distinct values by first appearance. The dictionary is small beside the rows; it is numbered in one task after aggregation."""
    first = rows.groupBy(F.col(value).alias("value")).agg(F.min(order).alias("first"))
    return first.select((F.row_number().over(Window.orderBy("first")) - 1).cast("long").alias("code"), "value")


def dictionary_encoded(rows: DataFrame, value: str, order: str) -> DataFrame:
    """The rows with ``code`` in place of the value."""
    codes = dictionary(rows, value, order)
    return rows.join(codes, rows[value].eqNullSafe(codes["value"])).drop("value", value)


def dictionary_pays(rows: DataFrame, value: str) -> DataFrame:
    """n, distinct and whether a dictionary pays: under 75 % distinct and at least 4 rows."""
    return rows.agg(F.count("*").alias("n"), F.countDistinct(value).alias("distinct_values")).withColumn("pays", (F.col("n") >= 4) & (F.col("distinct_values") < 0.75 * F.col("n")))


def decoded_enum(code: Column, names: dict[int, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, name in names.items():
        out = F.when(code == k, name).otherwise(out)
    return out


def conversion_cost(source: str, target: str) -> str:
    """none, widening, narrowing or lossy, of numeric types like i32, u8, f64."""
    if source == target:
        return "none"
    kind, size, to_kind, to_size = source[0], int(source[1:]), target[0], int(target[1:])
    exact = {16: 11, 32: 24, 64: 53}
    if kind == to_kind:
        return "widening" if to_size > size else "narrowing"
    if to_kind == "f":
        return "widening" if size <= exact[to_size] else "lossy"
    if kind == "f":
        return "lossy"
    return "widening" if kind == "u" and to_size > size else "narrowing"


def striped(offset: Column, stripe: int, files: int) -> tuple[Column, Column]:
    """(file, offset in it) of a byte offset striped over files."""
    k = F.floor(offset / stripe)
    return F.pmod(k, F.lit(files)), F.floor(k / files) * stripe + F.pmod(offset, F.lit(stripe))


def lanes(rows: DataFrame, key: str, n: int) -> DataFrame:
    """lane, n: how rows fall on ``n`` lanes by key."""
    return rows.groupBy(F.pmod(F.col(key), F.lit(n)).alias("lane")).agg(F.count("*").alias("n"))


def dimension_names(variables: DataFrame, dimensions: DataFrame) -> DataFrame:
    """name, axis, dim: each axis' dimension, found by size: the first of that size that the variable hasn't used, else dim_<size>.

    ``variables``: name, axis, size. ``dimensions``: dim, size, place.
    """
    nth = F.row_number().over(Window.partitionBy("name", "size").orderBy("axis"))
    kth = F.row_number().over(Window.partitionBy("size").orderBy("place"))
    v, d = variables.withColumn("n", nth), dimensions.withColumn("n", kth).select("dim", "size", "n")
    return v.join(d, ["size", "n"], "left").select("name", "axis", F.coalesce("dim", F.concat(F.lit("dim_"), F.col("size"))).alias("dim"))


def verification_grid(shape: tuple[int, ...], element: int, target: int) -> tuple[int, ...] | None:
    """The extents of a leaf of about ``target`` bytes that is one run of bytes; None where the whole, at most target times the root of two, is one leaf.

    Dimensions are whole from the fastest on, as long as their run stays under target over the root of two; the one that exceeds it is cut into even parts, slower ones have extent 1.
    """
    if not shape or not target or not element or (math.prod(shape) * element) ** 2 <= 2 * target**2:
        return None
    run = element
    for axis in range(len(shape) - 1, -1, -1):
        whole = run * shape[axis]
        if 2 * whole**2 > target**2:
            return (*(1,) * axis, -(-shape[axis] // -(-whole // target)), *shape[axis + 1 :])
        run = whole
    return None


def leaf_bytes(leaf: Column, shape: tuple[int, ...], grid: tuple[int, ...], element: int) -> tuple[Column, Column]:
    """(first byte, bytes) of a leaf of a verification grid, leaves numbered in row-major order."""
    start, size, rest, inner = F.lit(0).cast("long"), F.lit(element).cast("long"), leaf.cast("long"), element
    for n, tile in zip(reversed(shape), reversed(grid), strict=True):
        tiles = -(-n // tile)
        at = F.pmod(rest, F.lit(tiles)) * tile
        start, size = start + at * inner, size * F.least(F.lit(tile).cast("long"), n - at)
        rest, inner = F.floor(rest / tiles), inner * n
    return start, size
