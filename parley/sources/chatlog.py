"""Chat-log text source (S2): lines of ``user (timestamp): content``.

Rule: strip the whole text, split on newlines; keep a line iff it has a ``(`` and, after that first
``(``, a ``)``. Author = stripped text before the first ``(``; timestamp = stripped text up to the
next ``)``; content = the rest without one leading ``:``, stripped. Later parentheses stay in the
content. The id is the 0-based line index. Other lines (continuations, a ``)`` only before the first
``(``) are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.schemas import ATTACHMENT_ARRAY

# Python's str.strip() whitespace set, as a Java character class
_WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LINE = r"(?s)^([^(]*)\(([^)]*)\)(.*)$"


def py_strip(col: Column) -> Column:
    return F.regexp_replace(col, f"^{_WS}+|{_WS}+$", "")


def parse_chat_log(df: DataFrame, text_col: str = "text", keep_cols: tuple[str, ...] = ()) -> DataFrame:
    """One row per parsed message; ``keep_cols`` of the input are carried along."""
    lines = F.split(py_strip(F.col(text_col)), "\n")
    exploded = df.select(*keep_cols, F.posexplode(lines).alias("_i", "_line"))
    line = F.col("_line")
    kept = exploded.filter(line.rlike(_LINE))
    rest = F.regexp_extract(line, _LINE, 3)
    content = F.when(rest.startswith(":"), py_strip(F.substring(rest, 2, 1 << 30))).otherwise(py_strip(rest))
    return kept.select(
        *keep_cols,
        F.col("_i").cast("string").alias("id"),
        content.alias("content"),
        py_strip(F.regexp_extract(line, _LINE, 1)).alias("author"),
        py_strip(F.regexp_extract(line, _LINE, 2)).alias("timestamp"),
        F.lit("").alias("channel_id"),
        F.array().cast(ATTACHMENT_ARRAY).alias("attachments"),
        F.array().cast("array<struct<emoji:string,count:bigint>>").alias("reactions"),
        F.array().cast("array<string>").alias("mentions"),
    )


def read_chat_logs(spark, path: str, glob: str | None = None) -> DataFrame:
    """S2 over files: each file is one chat-log text (``wholetext``); rows carry their ``file``."""
    r = spark.read
    if glob:
        r = r.option("pathGlobFilter", glob)
    texts = r.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return parse_chat_log(texts, "text", keep_cols=("file",))
