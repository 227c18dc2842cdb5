"""Encodings of values: vectors as bytes, images in text, and text in XML."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def floats_of(blob: Column) -> Column:
    """Little-endian 32-bit floats of a binary column; bytes short of a float at the end are dropped."""

    @F.pandas_udf("array<float>")
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: np.frombuffer(b[: len(b) // 4 * 4], "<f4"), na_action="ignore")

    return run(blob)


def blob_of(floats: Column) -> Column:
    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda v: np.asarray(v, "<f4").tobytes(), na_action="ignore")

    return run(floats)


def data_url(c: Column) -> Column:
    """(kind, content) of an image in a data URL; null if it is none or its base64 is broken."""
    kind = F.regexp_extract(c, r"^data:image/([A-Za-z0-9.+-]+);base64,", 1)
    content = F.try_to_binary(F.regexp_replace(c, r"^[^,]*,", ""), F.lit("base64"))
    return F.when((kind != "") & content.isNotNull(), F.struct(kind.alias("kind"), content.alias("content")))


def unquoted(c: Column) -> Column:
    """Without one pair of quotes around it, and trimmed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.trim(c), r'^"(.*)"$', "$1")), F.lit(""))


#: Characters that XML reserves, the ampersand first.
ENTITIES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&apos;"}


def xml_escape(c: Column) -> Column:
    for sign, entity in ENTITIES.items():
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
