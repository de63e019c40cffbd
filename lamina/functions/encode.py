"""Integer codecs as Column expressions, and the byte codecs as numpy and pandas UDFs.

Arithmetic wraps in 64 bits whatever the session's ANSI mode: halves of 32 bits
are added, which cannot overflow, and put together by shifts.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BinaryError

_LOW = 0xFFFFFFFF


def _halves(x: Column) -> tuple[Column, Column]:
    return F.shiftright(x, 32), x.bitwiseAND(F.lit(_LOW))


def _whole(high: Column, low: Column) -> Column:
    """The long of two halves, a carry or borrow in the low one going up."""
    return F.shiftleft(high + F.shiftright(low, 32), 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))


def minus(a: Column, b: Column) -> Column:
    (p, q), (r, s) = _halves(a), _halves(b)
    return _whole(p - r, q - s)


def plus(a: Column, b: Column) -> Column:
    (p, q), (r, s) = _halves(a), _halves(b)
    return _whole(p + r, q + s)


def zigzag(x: Column) -> Column:
    """Unsigned result in a signed long's bits."""
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-z.bitwiseAND(F.lit(1).cast("long")))


def width(z: Column) -> Column:
    """Bits of an unsigned value, one at least."""
    return F.length(F.bin(z)).cast("long")


def encoded_size(n: Column, bits: Column) -> Column:
    """Bytes of the integer codec: midpoint, packed length, width byte, packed bits; nothing for no values."""
    packed = F.when(bits >= 32, 8 * n).otherwise(F.floor((n * bits + 7) / 8))
    return F.when(n == 0, 0).otherwise(13 + packed).cast("long")


def _middle(a: Column, b: Column) -> Column:
    """The left middle plus half the wrapped gap, towards zero."""
    return plus(a, F.call_function("div", minus(b, a), F.lit(2).cast("long")))


def midpoints(df: DataFrame, frame: list[str], col: str) -> DataFrame:
    """(frame, n, mid): the middle value of each frame, of an even number the left middle plus half the wrapped gap, towards zero.

    Ranks come from a sort inside the frame, so a frame may be larger than a task's memory.
    """
    return _ranked(df.select(*frame, col), frame, col).groupBy(*frame).agg(F.max("_n").alias("n"), F.max("_a").alias("a"), F.max("_b").alias("b")).select(*frame, "n", _middle(F.col("a"), F.col("b")).alias("mid"))


def _ranked(df: DataFrame, frame: list[str], col: str) -> DataFrame:
    """The rows with their frame's number of rows ``_n``, and with its middles ``_a`` and ``_b`` on the rows where they stand."""
    every = Window.partitionBy(*frame)
    x = F.col(col).cast("long")
    ranked = df.withColumn("_r", F.row_number().over(every.orderBy(col))).withColumn("_n", F.count("*").over(every))
    at = lambda place: F.when(F.col("_r") == place, x)
    return ranked.withColumn("_a", at(F.expr("(_n + 1) div 2"))).withColumn("_b", at(F.expr("_n div 2 + 1")))


def deltas(df: DataFrame, frame: list[str], col: str) -> DataFrame:
    """The rows of df with ``n``, ``mid`` of their frame and the wrapped ``delta``; one shuffle, and no second read."""
    every = Window.partitionBy(*frame)
    ranked = _ranked(df, frame, col)
    whole = ranked.select(*df.columns, F.col("_n").alias("n"), _middle(F.max("_a").over(every), F.max("_b").over(every)).alias("mid"))
    return whole.withColumn("delta", minus(F.col(col).cast("long"), F.col("mid")))


# The byte codec.


def pack(z: np.ndarray) -> bytes:
    """A width byte, then values of that many bits, least significant first; eight bytes each from 32 bits on."""
    z = np.asarray(z, np.uint64)
    bits = max(1, int(z.max()).bit_length()) if len(z) else 1
    if bits >= 32:
        return bytes([bits]) + z.astype("<u8").tobytes()
    planes = (z[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return bytes([bits]) + np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, count: int) -> np.ndarray:
    if not count:
        return np.empty(0, np.uint64)
    if not data:
        raise BinaryError("Decompression failed: no width")
    bits, body = data[0], data[1:]
    need = 8 * count if bits >= 32 else -(-count * bits // 8)
    if not 1 <= bits <= 64 or len(body) < need:
        raise BinaryError(f"Decompression failed: {need} bytes needed, {len(body)} there")
    if bits >= 32:
        return np.frombuffer(body, "<u8", count).astype(np.uint64)
    planes = np.unpackbits(np.frombuffer(body, np.uint8, need), bitorder="little")[: count * bits].reshape(count, bits)
    return (planes.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def midpoint(x: np.ndarray) -> np.int64:
    s = np.sort(x)
    a, b = int(s[(len(s) - 1) // 2]), int(s[len(s) // 2])
    gap = (b - a + (1 << 63)) % (1 << 64) - (1 << 63)
    half = abs(gap) // 2 * (1 if gap >= 0 else -1)
    return np.int64((a + half + (1 << 63)) % (1 << 64) - (1 << 63))


def compress_ints(values) -> bytes:
    x = np.asarray(values, np.int64)
    if not len(x):
        return b""
    mid = midpoint(x)
    with np.errstate(over="ignore"):
        d = x - mid
    packed = pack(((d << 1) ^ (d >> 63)).view(np.uint64))
    return struct.pack("<qI", int(mid), len(packed)) + packed


def decompress_ints(data: bytes, count: int) -> np.ndarray:
    if not count:
        return np.empty(0, np.int64)
    if len(data) < 12:
        raise BinaryError("Decompression failed: no header")
    mid, size = struct.unpack_from("<qI", data)
    if len(data) < 12 + size:
        raise BinaryError("Decompression failed: packed data is short")
    z = unpack(data[12 : 12 + size], count)
    d = (z >> np.uint64(1)).view(np.int64) ^ -(z & np.uint64(1)).view(np.int64)
    with np.errstate(over="ignore"):
        return d + np.int64(mid)


def compress_bytes(data: bytes, level: int | None = 3) -> bytes:
    if level is None:
        return bytes(data)
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(data)


def decompress_bytes(data: bytes, size: int, level: int | None = 3) -> bytes:
    """The stored size says how much room the result needs, whatever the ratio."""
    if level is None:
        out = bytes(data)
    else:
        import zstandard

        try:
            out = zstandard.ZstdDecompressor().decompress(data, max_output_size=size) if size else b""
        except zstandard.ZstdError as e:
            raise BinaryError(f"Decompression failed: {e}") from e
    if len(out) != size:
        raise BinaryError(f"Decompression failed: {size} bytes expected, {len(out)} found")
    return out


def each(f):
    """A function of the values of columns, as one of their series; a null among them gives null."""

    def run(*columns):
        return pd.Series([None if any(x is None for x in row) else f(*row) for row in zip(*columns, strict=True)], dtype=object)

    return run


@F.pandas_udf(T.BinaryType())
def compressed(values: pd.Series) -> pd.Series:
    """The integer codec's bytes of an array<long> column."""
    return each(compress_ints)(values)


@F.pandas_udf(T.ArrayType(T.LongType()))
def decompressed(data: pd.Series, count: pd.Series) -> pd.Series:
    return each(lambda d, n: decompress_ints(bytes(d), int(n)))(data, count)


@F.pandas_udf(T.BinaryType())
def zstd(data: pd.Series) -> pd.Series:
    """The bytes of a binary column, each value compressed with the default level."""
    return each(lambda d: compress_bytes(bytes(d)))(data)


@F.pandas_udf(T.BinaryType())
def unzstd(data: pd.Series, size: pd.Series) -> pd.Series:
    """The bytes again; ``size`` is their number before."""
    return each(lambda d, n: decompress_bytes(bytes(d), int(n)))(data, size)


@F.arrow_udf(T.LongType())
def double_bits(x: pa.Array) -> pa.Array:
    return x.view(pa.int64())


@F.arrow_udf(T.DoubleType())
def bits_double(x: pa.Array) -> pa.Array:
    return x.view(pa.float64())
