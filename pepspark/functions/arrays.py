"""Binary and numeric arrays of spectra: base64, zlib, MS-Numpress, delta and linear prediction, masks."""

from __future__ import annotations

import base64
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DTYPES = {"f32": "<f4", "f64": "<f8", "i32": "<i4", "i64": "<i8", "u8": "u1", "f32be": ">f4", "f64be": ">f8"}


def _nibbles(data: bytes, start: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)[start:]
    return np.stack([raw >> 4, raw & 15], axis=1).ravel().astype(np.int64)


def _numpress_ints(nibbles: np.ndarray | list[int]) -> list[int]:
    """Variable-length signed integers of nibbles: a head tells how many leading nibbles are 0 or F."""
    nib = np.asarray(nibbles, np.int64)
    size = np.where(nib <= 8, 8 - nib, 16 - nib)
    jump, heads, i, n = (np.arange(len(nib)) + 1 + size).tolist(), [], 0, len(nib)
    while i < n and jump[i] <= n:
        heads.append(i)
        i = jump[i]
    at = np.array(heads, np.int64)
    count = size[at]
    value = np.where(nib[at] <= 8, 0, (0xFFFFFFFF << (4 * count)) & 0xFFFFFFFF)
    for k in range(8):
        more = count > k
        value[more] |= nib[at[more] + 1 + k] << (4 * k)
    return np.where(value >= 1 << 31, value - (1 << 32), value).tolist()


def numpress_linear(data: bytes) -> np.ndarray:
    """Linear prediction with a fixed point: 8 bytes of scale (big endian), two 4-byte values, then differences."""
    if len(data) < 12:
        return np.zeros(0)
    scale = struct.unpack(">d", data[:8])[0]
    values = np.frombuffer(data[8:16][: (len(data[8:16]) // 4) * 4], "<i4").astype(np.int64)
    if len(values) == 2:  # second differences: summed up twice
        steps = np.cumsum(np.r_[values[1] - values[0], np.array(_numpress_ints(_nibbles(data, 16)), np.int64)])
        values = np.cumsum(np.r_[values[0], steps])
    return values / scale


def numpress_pic(data: bytes) -> np.ndarray:
    """Positive integers."""
    return np.array(_numpress_ints(_nibbles(data, 0)), float)


def numpress_slof(data: bytes) -> np.ndarray:
    """Short logged floats: exp(x / scale) - 1 of 2-byte values."""
    if len(data) < 8:
        return np.zeros(0)
    scale = struct.unpack(">d", data[:8])[0]
    return np.exp(np.frombuffer(data[8:], "<u2").astype(float) / scale) - 1


def decode_array(text: str | None, compression: str | None = "none", dtype: str = "f64") -> np.ndarray | None:
    """One array: base64 text, optionally compressed ('zlib', 'linear', 'pic', 'slof', or these with 'zlib-' before)."""
    if text is None:
        return None
    data = base64.b64decode(text)
    kind = compression or "none"
    if kind.startswith("zlib"):
        data = zlib.decompress(data) if data else b""
        kind = kind[5:] or "none"
    if kind == "none":
        return np.frombuffer(data, DTYPES.get(dtype, dtype)).astype(float)
    return {"linear": numpress_linear, "pic": numpress_pic, "slof": numpress_slof}[kind](data)


def decode_binary(text: Column | str, compression: Column | str | None = None, dtype: Column | str | None = None) -> Column:
    """array<double> of base64 text; compression and dtype are columns or null. Undecodable text gives null."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        out = []
        for x, y, z in zip(s, c, d):
            try:
                out.append(decode_array(x, y or "none", z or "f64"))
            except Exception:  # noqa: BLE001 - a broken array is a null, not a failed job
                out.append(None)
        return pd.Series(out, dtype="object")

    as_col = lambda v: F.lit(None).cast("string") if v is None else (F.col(v) if isinstance(v, str) else v)
    return run(as_col(text), as_col(compression), as_col(dtype))


def decode_arrays(texts: Column, compressions: Column, dtypes: Column) -> Column:
    """array<array<double>> of parallel arrays of base64 texts, compressions and types: all arrays of a row in one call. Undecodable text gives a null array."""

    @F.pandas_udf("array<array<double>>")
    def run(s: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        def one(x, y, z):
            try:
                return decode_array(x, y or "none", z or "f64")
            except Exception:  # noqa: BLE001 - a broken array is a null, not a failed job
                return None

        return pd.Series([None if x is None else [one(*t) for t in zip(x, y, z)] for x, y, z in zip(s, c, d)], dtype="object")

    return run(texts, compressions, dtypes)


def encode_binary(values: Column | str, compress: bool = False, dtype: str = "f64") -> Column:
    """base64 text of an array<double>."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            raw = np.asarray(x, DTYPES[dtype]).tobytes()
            return base64.b64encode(zlib.compress(raw) if compress else raw).decode()

        return pd.Series([one(x) for x in s], dtype="object")

    return run(values)


def decode_peaks(text: Column | str, precision: int = 32, compressed: bool = False) -> Column:
    """struct(mz, intensity) of interleaved big-endian pairs."""
    kind = "f32be" if precision == 32 else "f64be"

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([decode_array(x, "zlib" if compressed else "none", kind) for x in s], dtype="object")

    flat = run(text)
    return F.struct(F.filter(flat, lambda _, i: i % 2 == 0).alias("mz"), F.filter(flat, lambda _, i: i % 2 == 1).alias("intensity"))


def mask_zero(values: Column | str) -> Column:
    """Zeros (missing charges) become nulls."""
    c = F.col(values) if isinstance(values, str) else values
    return F.transform(c, lambda x: F.when(x != 0, x))


def _array_udf(one):
    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else one(np.asarray(x, float)) for x in s], dtype="object")

    return run


def undo_delta(x: np.ndarray) -> np.ndarray:
    """Values of which all after the second were stored as difference to the one before, plus the first value."""
    return np.concatenate([x[:1], np.cumsum(np.concatenate([x[1:2], x[2:] - x[:1]]))]) if len(x) > 2 else x


def undo_linear(x: np.ndarray) -> np.ndarray:
    """Values of which all after the second were stored as residual of a straight line through the two before, plus the second value."""
    if len(x) <= 2:
        return x
    slopes = np.cumsum(np.concatenate([[x[1] - x[0]], x[2:] - x[1]]))
    return np.concatenate([x[:1], x[0] + np.cumsum(slopes)])


def delta_predict(values: Column | str) -> Column:
    """array<double> with the delta prediction undone."""
    return _array_udf(undo_delta)(values)


def linear_predict(values: Column | str) -> Column:
    """array<double> with the linear prediction undone."""
    return _array_udf(undo_linear)(values)
