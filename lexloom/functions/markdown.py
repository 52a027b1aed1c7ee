"""Fenced code blocks of Markdown, as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.langtag import language_tag
from lexloom.functions.text import js_trim

#: Fixed value: three backticks or tildes at the start of a line, up to the same mark at the start and end of a line.
FENCE = "(?s)(?:^|\\n)(```|~~~)([^\\n]*)\\n(.*?)\\n\\1(?=\\n|$)"


def code_blocks(text: Column) -> Column:
    """Array of (block_id, block_index, language, content), blocks without content left out."""
    info, content = (F.regexp_extract_all(text, F.lit(FENCE), F.lit(k)) for k in (2, 3))
    found = F.filter(F.transform(F.arrays_zip(info.alias("info"), content.alias("content")), lambda b: F.struct(language_tag(b["info"]).alias("language"), js_trim(b["content"]).alias("content"))), lambda b: b["content"] != "")
    return F.transform(found, lambda b, i: F.struct(F.concat(F.lit("block-"), i.cast("string")).alias("block_id"), i.alias("block_index"), b["language"].alias("language"), b["content"].alias("content")))
