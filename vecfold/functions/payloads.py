"""Request and reply documents of the two remote embedding services."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VECTORS = "array<array<float>>"
SHAPES = ("content", "model")
# The texts sent along with each item.
CONTENT_PROMPT = "Image: [img-1]"
MODEL_PROMPT = "describe this image"


def base64_line(data: Column) -> Column:
    """Base64 on one line, whether or not the session breaks it into lines of 76."""
    return F.translate(F.base64(data), "\r\n", "")


def content_request(data: Column) -> Column:
    """``{content, image_data: [{id, data}]}`` with the bytes in base64."""
    item = F.struct(F.lit(1).alias("id"), base64_line(data).alias("data"))
    return F.to_json(
        F.struct(F.lit(CONTENT_PROMPT).alias("content"), F.array(item).alias("image_data"))
    )


def model_request(data: Column, model: str) -> Column:
    """``{model, input, images: [...]}`` with the bytes in base64."""
    return F.to_json(
        F.struct(
            F.lit(model).alias("model"),
            F.lit(MODEL_PROMPT).alias("input"),
            F.array(base64_line(data)).alias("images"),
        )
    )


def reply_vectors(reply: Column, shape: str) -> Column:
    """Vectors of a reply as ``array<array<float>>``; a reply that does not parse raises."""
    strict = {"mode": "FAILFAST"}
    if shape == "content":
        docs = F.from_json(reply, f"array<struct<embedding: {VECTORS}>>", strict)
        vectors = F.element_at(docs, 1)["embedding"]
    elif shape == "model":
        vectors = F.from_json(reply, f"struct<embeddings: {VECTORS}>", strict)["embeddings"]
    else:
        raise ValueError(f"unknown reply shape {shape!r}, expected one of {SHAPES}")
    missing = F.raise_error(F.lit("reply holds no vectors")).cast(VECTORS)
    return F.coalesce(vectors, missing)
