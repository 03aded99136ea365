"""Element types of tensor files: bits per element and numpy decoding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Element types and their bits.
BITS = {
    "F64": 64, "F32": 32, "F16": 16, "BF16": 16, "I64": 64, "I32": 32, "I16": 16, "I8": 8, "U64": 64, "U32": 32, "U16": 16,
    "U8": 8, "BOOL": 8, "F8_E4M3": 8, "F8_E5M2": 8,
}
NUMPY = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U64": "<u8", "U32": "<u4", "U16": "<u2", "U8": "u1", "BOOL": "?"}


def bits(dtype: Column) -> Column:
    """Bits per element; null for an unknown type."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in BITS.items() for x in kv]), dtype)


def decode(raw: bytes, dtype: str) -> np.ndarray:
    """Elements of a payload; bfloat16 widens to float32."""
    if dtype == "BF16":
        return (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32)
    return np.frombuffer(raw, NUMPY[dtype])
