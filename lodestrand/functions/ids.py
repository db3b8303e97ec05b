"""Identifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The longest collection name, and the hash digits at its end.
MOST_NAME = 255
HASH_DIGITS = 16


def chunk_id(path: Column, start_line: Column, content: Column) -> Column:
    """SHA-256 of path, start line as 4 little-endian bytes, and content."""
    digits = F.lpad(F.hex(start_line.cast("long")), 8, "0")
    swapped = F.concat(*(F.substr(digits, F.lit(k), F.lit(2)) for k in (7, 5, 3, 1)))
    return F.sha2(F.concat(F.encode(path, "utf-8"), F.unhex(swapped), F.encode(content, "utf-8")), 256)


def vector_id(text: Column) -> Column:
    """The first 8 bytes of the text's SHA-256 as a number, without its highest bit."""
    number = F.conv(F.substr(F.sha2(text, 256), F.lit(1), F.lit(16)), 16, 10).cast("decimal(20,0)")
    return (number % F.lit("9223372036854775808").cast("decimal(20,0)")).cast("bigint")


def collection_name(path: Column) -> Column:
    """The last component, in letters, digits and "_", and a hash of the whole path."""
    last = F.try_element_at(F.filter(F.split(path, "/"), lambda x: (x != "") & (x != ".")), F.lit(-1))
    last = F.when((last == "..") | last.isNull(), "collection").otherwise(last)
    clean = F.regexp_replace(last, "[^A-Za-z0-9]", "_")
    clean = F.when(clean.rlike("^[0-9]") | (clean == ""), F.concat(F.lit("_"), clean)).otherwise(clean)
    digits = F.substr(F.sha2(path, 256), F.lit(1), F.lit(HASH_DIGITS))
    return F.concat(F.substr(clean, F.lit(1), F.lit(MOST_NAME - 1 - HASH_DIGITS)), F.lit("_"), digits)


def hit_key(chunk_id: Column, path: Column, start_line: Column, end_line: Column, language: Column) -> Column:
    """A hit's id, or else its place."""
    return F.coalesce(F.nullif(chunk_id, F.lit("")), F.concat_ws(":", path, start_line, end_line, language))
