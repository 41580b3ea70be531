"""Data URIs as Spark columns and on the driver."""

from __future__ import annotations

import base64
import binascii

from pyspark.sql import Column
from pyspark.sql import functions as F


class DataUriError(ValueError):
    """A string that is no base64 data URI."""


def encode(mime: Column, data: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(data))


def parse(uri: Column) -> Column:
    """struct(mime, data, error): data decoded, or what is wrong."""
    rest = F.substring(uri, 6, 1 << 30)
    at = F.instr(rest, ";base64,")
    mime = F.substr(rest, F.lit(1), at - 1)
    data = F.try_to_binary(F.substr(rest, at + 8), F.lit("base64"))
    error = F.when(~uri.startswith("data:"), "missing prefix").when(at == 0, "missing separator").when(mime == "", "empty mime").when(data.isNull(), "invalid base64")
    return F.struct(F.when(error.isNull(), mime).alias("mime"), F.when(error.isNull(), data).alias("data"), error.alias("error"))


def parse_one(uri: str) -> tuple[str, bytes]:
    if not uri.startswith("data:"):
        raise DataUriError("missing prefix")
    mime, mark, data = uri[5:].partition(";base64,")
    if not mark:
        raise DataUriError("missing separator")
    if not mime:
        raise DataUriError("empty mime")
    try:
        return mime, base64.b64decode(data, validate=True)
    except binascii.Error as e:
        raise DataUriError("invalid base64") from e
