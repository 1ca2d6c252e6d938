"""Routing of images: text or picture, resize geometry, tokens. Recognised text and its confidence are columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import metrics as M

# Confidences that decide, and the width that pictures are resized to.
TEXT_ABOVE, LOW_BELOW, MAX_WIDTH = 70, 30, 512


def intent(confidence: Column) -> Column:
    return F.when(confidence > TEXT_ABOVE, "text").otherwise("visual")


def note(confidence: Column) -> Column:
    return F.when(confidence > TEXT_ABOVE, "text recognised").when(confidence < LOW_BELOW, "no text").otherwise("mixed, kept as a picture")


def resized(width: Column, height: Column) -> Column:
    """struct(width, height): at most MAX_WIDTH wide, never enlarged."""
    w = F.least(width, F.lit(MAX_WIDTH))
    h = F.when(width > MAX_WIDTH, M.half_up(F.lit(MAX_WIDTH) * height / width)).otherwise(height.cast("long"))
    return F.struct(w.cast("long").alias("width"), h.alias("height"))


def routed_tokens(width: Column, height: Column, confidence: Column, text: Column) -> Column:
    """Tokens after routing: those of the text, or of the resized picture at low detail."""
    small = resized(width, height)
    return F.when(intent(confidence) == "text", M.tokens(text)).otherwise(M.image_tokens(small["width"], small["height"], "low"))


def png_size(content: Column) -> Column:
    """struct(width, height) from a PNG header; null for other files."""
    is_png = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    at = lambda i: F.conv(F.hex(F.substring(content, i, 4)), 16, 10).cast("long")
    return F.when(is_png, F.struct(at(17).alias("width"), at(21).alias("height")))


def _header(content: bytes | None) -> tuple[int, int] | None:
    """(width, height) by the header of a PNG, GIF, JPEG or WebP file."""
    b = content or b""
    if b[:8] == b"\x89PNG\r\n\x1a\n" and len(b) >= 24:
        return int.from_bytes(b[16:20], "big"), int.from_bytes(b[20:24], "big")
    if b[:6] in (b"GIF87a", b"GIF89a") and len(b) >= 10:
        return int.from_bytes(b[6:8], "little"), int.from_bytes(b[8:10], "little")
    if b[:4] == b"RIFF" and b[8:12] == b"WEBP" and len(b) >= 30:
        if b[12:16] == b"VP8 ":
            return int.from_bytes(b[26:28], "little") & 0x3FFF, int.from_bytes(b[28:30], "little") & 0x3FFF
        if b[12:16] == b"VP8L":
            bits = int.from_bytes(b[21:25], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        if b[12:16] == b"VP8X":
            return int.from_bytes(b[24:27], "little") + 1, int.from_bytes(b[27:30], "little") + 1
    at = 2 if b[:2] == b"\xff\xd8" else len(b)
    while at + 9 <= len(b) and b[at] == 0xFF:  # segments up to the frame's
        kind = b[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(b[at + 7 : at + 9], "big"), int.from_bytes(b[at + 5 : at + 7], "big")
        at += 2 if kind == 0xFF or 0xD0 <= kind <= 0xD8 else 2 + int.from_bytes(b[at + 2 : at + 4], "big")
    return None


@F.pandas_udf(StructType([StructField("width", LongType()), StructField("height", LongType())]))
def image_size(contents: pd.Series) -> pd.DataFrame:
    """struct(width, height) of PNG, GIF, JPEG and WebP files; nulls for others."""
    return pd.DataFrame([_header(c) or (None, None) for c in contents], columns=["width", "height"]).astype("Int64")


def answered(images: DataFrame) -> DataFrame:
    """images(id, width, height, confidence, text): intent, the text or the smaller picture's size, tokens, savings, note."""
    w, h, c = F.col("width"), F.col("height"), F.col("confidence")
    small = resized(w, h)
    d = images.select("id", intent(c).alias("intent"), F.when(intent(c) == "text", F.col("text")).alias("text"), F.when(intent(c) == "visual", small["width"]).alias("new_width"), F.when(intent(c) == "visual", small["height"]).alias("new_height"), M.savings(M.image_tokens(w, h), routed_tokens(w, h, c, F.col("text"))).alias("m"), note(c).alias("why"))
    return d.select("id", "intent", "text", "new_width", "new_height", "m.*", M.savings_note(F.col("m"), "Image:").alias("saved"), "why")
