"""Text, path and language expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrand.config import EXTENSION_LANGUAGE, EXTENSIONLESS_FILES, FALLBACK_LANGUAGE, MARKDOWN_EXTENSIONS, MOST_TOKEN_BYTES, SUPPORTED_EXTENSIONS

_EMPTY = "array<string>"


def lines(text: Column) -> Column:
    """The lines of a text: "\\n" or "\\r\\n" ends one; the end of the last is optional."""
    parts = F.split(text, "\r?\n", -1)
    return F.when(text == "", F.array().cast(_EMPTY)).when(text.endswith("\n"), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def is_blank(text: Column) -> Column:
    """Nothing but Unicode white space."""
    return ~text.rlike(r"(?U)\S")


def is_heading(line: Column) -> Column:
    return line.rlike("^#+ ")


def relative_path(path: Column, root: str) -> Column:
    """path below root; the whole path where it lies elsewhere."""
    head = root.rstrip("/") + "/"
    return F.when(path.startswith(head), F.substr(path, F.lit(len(head) + 1))).otherwise(path)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file's name, "" without one; a leading dot alone begins no extension."""
    name = file_name(path)
    return F.when(name.rlike(r"(?s)^.+\."), F.element_at(F.split(name, r"\."), -1)).otherwise(F.lit(""))


def is_indexed(path: Column, extensions: Iterable[str] = SUPPORTED_EXTENSIONS) -> Column:
    """Files of the listed extensions, as they are written, and a few names without any."""
    name = file_name(path)
    bare = F.lower(name).isin(EXTENSIONLESS_FILES) & ~name.rlike(r"(?s)^.+\.")
    return extension(path).isin(list(extensions)) & (extension(path) != "") | bare


def _mapped(key: Column, table: dict[str, str], default: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, key), default)


def ast_language(ext: Column) -> Column:
    """The language of an extension in any case; null where none has a syntax splitter."""
    return _mapped(F.lower(ext), EXTENSION_LANGUAGE, F.lit(None).cast("string"))


def language_of(ext: Column) -> Column:
    """The language that chunks of such a file carry."""
    low = F.lower(ext)
    return F.coalesce(ast_language(ext), _mapped(low, FALLBACK_LANGUAGE, low))


def has_line_splitter(ext: Column) -> Column:
    """Supported, but without a syntax splitter."""
    return F.lower(ext).isin(SUPPORTED_EXTENSIONS) & ast_language(ext).isNull()


def is_markdown(ext: Column) -> Column:
    return F.lower(ext).isin(MARKDOWN_EXTENSIONS)


def matches_extension(path: Column, wanted: Iterable[str]) -> Column:
    """Whether the text behind a path's last dot is wanted, in any case and with or without leading
    dots; a path without a dot is not. An empty list wants all."""
    names = [x.lstrip(".").lower() for x in wanted]
    if not names:
        return F.lit(True)
    return F.contains(path, F.lit(".")) & F.lower(F.substring_index(path, ".", -1)).isin(names)


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits, without those of 40 bytes or more."""
    found = F.regexp_extract_all(text, F.lit(r"[\p{IsAlphabetic}\p{N}]+"), F.lit(0))
    return F.transform(F.filter(found, lambda x: F.octet_length(x) < MOST_TOKEN_BYTES), F.lower)


def token_estimate(text: Column) -> Column:
    """A fourth of the bytes, rounded down, is taken for a text's tokens."""
    return F.floor(F.octet_length(text) / 4).cast("long")


def metadata_field(metadata: Column, name: str) -> Column:
    """A field of a row's JSON metadata: line numbers as numbers, 0 where they lack or are none, all others as text, empty where they lack."""
    found = F.get_json_object(metadata, f"$.{name}")
    return F.coalesce(found.try_cast("long"), F.lit(0)) if name.endswith("_line") else F.coalesce(found, F.lit(""))
