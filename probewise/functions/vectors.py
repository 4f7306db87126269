"""Vector columns: wire form, normalisation, products, deterministic ids."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values of the stored payload format
PAYLOAD_PREFIX = b"ENC1"
NONCE_BYTES = 12
VECTOR_AAD = "embedding-vector"

VALID = "ok"


def as_column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_encrypted(payload: Column | str) -> Column:
    return F.substring(as_column(payload), 1, len(PAYLOAD_PREFIX)) == F.lit(PAYLOAD_PREFIX)


def decrypt_payload(payload: Column | str, key_hex: str, aad: str = VECTOR_AAD) -> Column:
    """Plain bytes of a stored payload; null where it cannot be decrypted.

    After the prefix comes nonce, cipher text and tag, which is the layout of
    Spark's own GCM mode.
    """
    payload = as_column(payload)
    body = F.substring(payload, len(PAYLOAD_PREFIX) + 1, 1 << 30)
    plain = F.try_aes_decrypt(body, F.unhex(F.lit(key_hex)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(aad))
    return F.when(is_encrypted(payload), plain).otherwise(payload)


def encrypt_payload(plain: Column | str, key_hex: str, aad: str = VECTOR_AAD) -> Column:
    """Stored form of ``plain`` under a fresh random nonce."""
    nonce = F.unhex(F.substring(F.sha2(F.uuid().cast("binary"), 256), 1, 2 * NONCE_BYTES))
    sealed = F.aes_encrypt(
        as_column(plain), F.unhex(F.lit(key_hex)), F.lit("GCM"), F.lit("DEFAULT"), nonce, F.lit(aad)
    )
    return F.concat(F.lit(PAYLOAD_PREFIX), sealed)


def _places(missing: np.ndarray) -> pa.Array:
    """For every row of a batch its place among the rows that are not null."""
    return pa.array(np.cumsum(~missing) - 1, mask=missing)


def _missing(column: pa.Array) -> np.ndarray:
    return column.is_null().to_numpy(zero_copy_only=False)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _from_bytes(payloads: pa.Array) -> pa.Array:
    # the bytes of a batch lie one after the other: one view reads them all
    missing, full = _missing(payloads), payloads.cast(pa.binary()).drop_null()
    if not len(full):
        return pa.nulls(len(payloads), pa.list_(pa.float32()))
    starts = np.frombuffer(full.buffers()[1], np.int32)[full.offset : full.offset + len(full) + 1]
    raw = np.frombuffer(full.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
    lists = pa.ListArray.from_arrays(
        pa.array((starts - starts[0]) // 4, pa.int32()), pa.array(np.frombuffer(raw.tobytes(), "<f4"))
    )
    return lists.take(_places(missing))


@F.arrow_udf(T.BinaryType())
def _to_bytes(vectors: pa.Array) -> pa.Array:
    missing, full = _missing(vectors), vectors.drop_null()
    values = full.flatten().to_numpy(zero_copy_only=False).astype("<f4")
    ends = np.cumsum(full.value_lengths().to_numpy(zero_copy_only=False))
    starts = np.concatenate([[0], 4 * ends]).astype(np.int32)
    raw = pa.Array.from_buffers(
        pa.binary(), len(full), [None, pa.py_buffer(starts.tobytes()), pa.py_buffer(values.tobytes())]
    )
    return raw.take(_places(missing))


def decode_vector(payload: Column | str, dim: int) -> Column:
    """Little-endian float32 bytes as an array; null on any other byte length."""
    payload = as_column(payload)
    return _from_bytes(F.when(F.octet_length(payload) == 4 * dim, payload))


def encode_vector(vector: Column | str) -> Column:
    return _to_bytes(as_column(vector))


def doubles(vector: Column | str) -> Column:
    return as_column(vector).cast("array<double>")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    A column expression named inside a lambda is computed again for every
    element; a lambda argument is not.
    """
    return F.transform(F.array(value), use)[0]


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column | str) -> Column:
    return F.sqrt(dot(vector, vector))


def l2_normalize(vector: Column | str, on_zero: str = "null") -> Column:
    """Unit vector; a zero vector is kept (``keep``) or becomes null (``null``)."""
    vector = doubles(vector)
    zero = F.lit(None) if on_zero == "null" else None

    def scale(r: Column) -> Column:
        unit = F.transform(r["v"], lambda x: x / r["n"])
        return F.when(r["n"] > 0, unit).otherwise(r["v"] if zero is None else zero)

    return bind(F.struct(vector.alias("v"), norm(vector).alias("n")), scale)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine; null where a vector is zero or the lengths differ."""
    comparable = F.size(as_column(a)) == F.size(as_column(b))
    parts = F.struct(dot(a, b).alias("d"), (norm(a) * norm(b)).alias("n"))
    return F.when(comparable, bind(parts, lambda r: F.when(r["n"] > 0, r["d"] / r["n"])))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    return 1 - cosine(a, b)


def l2_distance(a: Column | str, b: Column | str) -> Column:
    squares = F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def max_abs_difference(a: Column | str, b: Column | str) -> Column:
    return F.array_max(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)))


def is_usable(vector: Column | str) -> Column:
    """True for a vector with finite elements that are not all zero.

    Filters use this and not a null score: a filter on a score would make
    Spark compute the score twice.
    """
    vector = doubles(vector)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vector_problem(vector: Column | str, dim: int) -> Column:
    """First reason a vector is unusable, else ``ok``."""
    vector = doubles(vector)
    not_finite = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (
        F.when(vector.isNull(), "undecodable")
        .when(F.size(vector) != dim, "dim_mismatch")
        .when(not_finite, "non_finite")
        .when(F.forall(vector, lambda x: x == 0), "zero_norm")
        .otherwise(VALID)
    )


def uuid5(*parts: Column | str) -> Column:
    """Name-based id (version 5, URL namespace) of the parts joined by ``:``."""
    name = F.concat_ws(":", *[as_column(part).cast("string") for part in parts])
    digest = F.sha1(F.concat(F.lit(uuid.NAMESPACE_URL.bytes), name.cast("binary")))
    variant = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    marked = F.lower(F.hex(variant.bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(marked, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )
