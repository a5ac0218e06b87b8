"""File-name, extension and table-name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted image extensions and embedding modes.
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "gif", "bmp", "webp", "tiff"]
MODES = ["openclip", "llamacpp", "ollama"]


def file_name(path: Column) -> Column:
    """Last path component; a path without one raises."""
    bare = F.regexp_replace(path, r"(/\.?)+$", "")
    name = F.element_at(F.split(bare, "/"), -1)
    bad = F.raise_error(F.concat(F.lit("path has no file name: "), path)).cast("string")
    return F.when(name.isin("", ".", ".."), bad).otherwise(name)


def is_image(name: Column) -> Column:
    """True when the last extension is an image extension, in any case."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]+)$", 1)).isin(IMAGE_EXTENSIONS)


def table_name(mode: str, model: Column) -> Column:
    """``results_{mode}_{model}``, the model lower-cased with ``_`` for non-alphanumerics."""
    if mode not in MODES:
        raise ValueError(f"unknown embedding mode {mode!r}")
    plain = F.lower(F.regexp_replace(model, r"[^\p{IsAlphabetic}\p{N}]", "_"))
    return F.concat(F.lit(f"results_{mode}_"), plain)


def table_name_of(mode: str, model: str) -> str:
    """``table_name`` for one model name, as a string."""
    if mode not in MODES:
        raise ValueError(f"unknown embedding mode {mode!r}")
    return f"results_{mode}_" + "".join(c if c.isalnum() else "_" for c in model).lower()
