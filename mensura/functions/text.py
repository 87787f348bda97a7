"""Names, ids, dates and documents as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words in a room's name and the type they mean, the first that fits.
ROOM_WORDS = (("bath", "bathroom"), ("toilet", "bathroom"), ("wc", "bathroom"), ("kitchen", "kitchen"), ("laundry", "laundry"), ("bed", "bedroom"), ("living", "living_room"), ("hall", "hallway"), ("corridor", "hallway"))


def room_type(name: Column) -> Column:
    low, out = F.lower(name), F.lit("room")
    for word, kind in reversed(ROOM_WORDS):
        out = F.when(F.contains(low, F.lit(word)), kind).otherwise(out)
    return out


def without_ordinal(name: Column) -> Column:
    """`01_Kitchen` or `2 - Hall` without the number in front."""
    return F.regexp_replace(name, r"^[0-9]+[\s_.-]*", "")


def relabelled(document: Column, old: str, new: Column) -> Column:
    """A room's id replaced in a JSON document, alone and as the first part of other ids."""
    return F.regexp_replace(document, F.lit(f'"{old}(?=["-])'), F.concat(F.lit('"'), new))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\f\r\x0b]+", " "))


def escaped_html(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def encoded_base64(text: Column) -> Column:
    """The base64 of a text's UTF-8 in one line; F.base64 breaks it after every 76 characters."""
    return F.translate(F.base64(F.encode(text, "UTF-8")), "\r\n", "")


def exif_time(text: Column) -> Column:
    """`2023:05:06 07:08:09` as a timestamp without zone; null if it isn't one."""
    return F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz")


def cache_key(model: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws("|", model, content), 256)


def pass_text(passed: Column) -> Column:
    return F.when(passed, "pass").when(~passed, "fail").otherwise("n/a")


def extent_text(value: Column, lo: Column, hi: Column) -> Column:
    """`3.42 m ±1.2 cm` for narrow intervals, else the interval itself."""
    half = (hi - lo) / 2
    return F.when(half < 0.1, F.format_string("%.2f m ±%.1f cm", value, half * 100)).otherwise(F.format_string("%.2f m [%.2f, %.2f]", value, lo, hi))
