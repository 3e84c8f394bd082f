"""Bytes and numbers: decoding, checksums, byte order tricks, encryption."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, ByteType, DateType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructType, TimestampType

#: Spark's type for each numeric type; unsigned ones take the next wider, 64-bit unsigned a decimal.
SPARK_TYPES = {"i1": "byte", "i2": "short", "i4": "int", "i8": "long", "u1": "short", "u2": "int", "u4": "long", "u8": "decimal(20,0)", "f2": "float", "f4": "float", "f8": "double"}


def numbers(column: Column, kind: str, big_endian: bool = False):
    """An array of numbers out of a binary column; ``kind`` as in SPARK_TYPES. Bytes that fill no number go."""
    dtype = np.dtype((">" if big_endian else "<") + kind)
    wide = kind == "u8"

    @F.pandas_udf("array<string>" if wide else f"array<{SPARK_TYPES[kind]}>")
    def parsed(s: pd.Series) -> pd.Series:
        def one(b):
            if b is None:
                return None
            values = np.frombuffer(b[: len(b) // dtype.itemsize * dtype.itemsize], dtype)
            return [str(int(x)) for x in values] if wide else values.astype(values.dtype.newbyteorder("=")).astype({"u1": "i2", "u2": "i4", "u4": "i8", "f2": "f4"}.get(kind, kind))

        return s.map(one)

    out = parsed(column)
    return out.cast("array<decimal(20,0)>") if wide else out


def bits(value: Column, offset: int, precision: int) -> Column:
    """``precision`` bits of an integer from bit ``offset`` on."""
    return F.shiftrightunsigned(value.cast("long"), offset).bitwiseAND(F.lit((1 << precision) - 1).cast("long"))


def fixed_string(value: Column, padding: str) -> Column:
    """A fixed-length string without its padding: null-term (to the first zero), null-pad or space-pad."""
    return {"null-term": F.regexp_replace(value, "\x00[\\s\\S]*$", ""), "null-pad": F.regexp_replace(value, "\x00+$", ""), "space-pad": F.regexp_replace(value, " +$", "")}[padding]


def fletcher32(column: Column) -> Column:
    """The Fletcher checksum of 16-bit big-endian words, both sums modulo 65535; an odd last byte is the high one."""

    @F.pandas_udf("long")
    def summed(s: pd.Series) -> pd.Series:
        def one(b):
            if b is None:
                return None
            words = np.frombuffer(b + b"\x00" * (len(b) % 2), ">u2").astype(np.uint64)
            first = second = 0
            for at in range(0, len(words), 360):
                part = words[at : at + 360]
                run = first + np.cumsum(part)
                second = int((second + run.sum()) % 65535)
                first = int(run[-1] % 65535)
            return second << 16 | first

        return s.map(one)

    return summed(column)


def byte_shuffled(column: Column, width: int, back: bool = False) -> Column:
    """Bytes of ``width``-byte elements regrouped by their place in the element, or put back; a rest stays at the end."""

    @F.pandas_udf("binary")
    def shuffled(s: pd.Series) -> pd.Series:
        def one(b):
            if b is None:
                return None
            n = len(b) // width * width
            grid = np.frombuffer(b[:n], np.uint8).reshape((width, -1) if back else (-1, width))
            return grid.T.tobytes() + b[n:]

        return s.map(one)

    return shuffled(column)


def half(column: Column) -> Column:
    """A float array rounded to half precision."""

    @F.pandas_udf("array<float>")
    def rounded(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.asarray(x, np.float16).astype(np.float32))

    return rounded(column)


def encrypted(data: Column, key: Column, about: Column) -> Column:
    """AES-GCM; ``about`` (chunk and version) is authenticated with it."""
    return F.aes_encrypt(data, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), about)


def decrypted(data: Column, key: Column, about: Column) -> Column:
    """What was encrypted; null where key or ``about`` is another."""
    return F.try_aes_decrypt(data, key, F.lit("GCM"), F.lit("DEFAULT"), about)


def type_size(kind: str) -> int:
    """Bytes of a number of a type in SPARK_TYPES."""
    return int(kind[1:])


def described(schema: StructType) -> str:
    """A table's type as text, from which ``undescribed`` makes it again."""
    return schema.json()


def undescribed(text: str) -> StructType:
    return StructType.fromJson(json.loads(text))


def row_size(schema: StructType) -> int | None:
    """Bytes of a row of fixed-size columns; None where a column has no fixed size."""
    sizes = {ByteType: 1, BooleanType: 1, ShortType: 2, IntegerType: 4, FloatType: 4, DateType: 4, LongType: 8, DoubleType: 8, TimestampType: 8}
    total = 0
    for f in schema.fields:
        size = row_size(f.dataType) if isinstance(f.dataType, StructType) else sizes.get(type(f.dataType))
        if size is None:
            return None
        total += size
    return total
