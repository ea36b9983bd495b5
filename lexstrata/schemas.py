"""Schemas of the document model."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

_TEXT = ("id", "country", "source", "outlet", "org", "lang", "date", "url", "title", "speaker", "kind", "via", "text", "fetched", "sample", "wayback", "truncated", "text_scope")

#: A line of an active buffer or a sealed part; other keys go to ``extra``.
DOCUMENT = StructType([*(StructField(c, StringType()) for c in _TEXT), StructField("tags", ArrayType(StringType())), StructField("forwarded", BooleanType()), StructField("labelled", BooleanType())])
