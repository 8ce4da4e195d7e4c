"""Functions without a Spark built-in, over Arrow batches."""

from __future__ import annotations

import ipaddress
import struct
import zlib

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, BooleanType, StringType


@pandas_udf(BinaryType())
def compress(text: pd.Series) -> pd.Series:
    """Four length bytes, little-endian, and the zlib stream; the empty string stays empty."""

    def one(value: str | None) -> bytes | None:
        if value is None:
            return None
        data = value.encode()
        return struct.pack("<I", len(data)) + zlib.compress(data) if data else b""

    return text.map(one, na_action="ignore")


@pandas_udf(StringType())
def uncompress(data: pd.Series) -> pd.Series:
    """The inverse of compress; NULL for anything else."""

    def one(value: bytes) -> str | None:
        try:
            return zlib.decompress(value[4:]).decode() if value else ""
        except (zlib.error, UnicodeDecodeError):
            return None

    return data.map(one, na_action="ignore")


@pandas_udf(BooleanType())
def is_ipv6(text: pd.Series) -> pd.Series:
    def one(value: str | None) -> bool | None:
        if value is None:
            return None
        try:
            return bool(ipaddress.IPv6Address(value))
        except ValueError:
            return False

    return text.map(one)


FUNCTIONS = {"mysql_compress": compress, "mysql_uncompress": uncompress, "mysql_is_ipv6": is_ipv6}
