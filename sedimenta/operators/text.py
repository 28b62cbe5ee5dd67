"""Register lines, tokens with offsets, counts and assembly."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What counts as white space: the listed characters, and no others.
SPACE = "\\u0009-\\u000D\\u001C-\\u0020\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
#: The same for SQL engines whose patterns write code points as \\x{...}.
SQL_SPACE = re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", SPACE)


def register_lines(lineitem: DataFrame, parts: int | None = None) -> DataFrame:
    """The synthetic register: one line of text for each order line. One shuffle by document (into ``parts``) serves all that follows;
    it moves numbers alone, texts are made behind it."""
    part, supp, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("int")
    s = lambda c: c.cast("string")
    unit = F.concat(F.lit("Unit T"), s(part % 5 + 1))
    texts = (
        F.concat(unit, F.lit(" rated "), s(q), F.lit(" kVA")),
        F.concat(F.lit("Block -Q"), s(supp % 20), F.lit(" +E0"), s(supp % 5)),
        F.concat(F.lit("Cable C"), s(part % 9), F.lit(" section "), s(q), F.lit(" mm2, at 400 V")),
        F.concat(F.lit("Terminal +E0"), s(supp % 5), F.lit("-QA"), s(part % 6)),
        F.concat(F.lit("Units T1 and T2 at "), s(q), F.lit(",5 kV")),
        F.concat(F.lit("Rating 1."), F.lpad(s(q), 3, "0"), F.lit(" kVA")),
        F.lit("General note, nothing to record."),
        F.concat(F.lit("Relay (T"), s(part % 5 + 1), F.lit("), "), s(q), F.lit("kA;")),
    )
    text = F.when(part % 8 == 0, texts[0])
    for k, t in enumerate(texts[1:], 1):
        text = text.when(part % 8 == k, t)
    rows = lineitem.select((F.col("l_orderkey") + 1).alias("document_id"), (F.col("l_orderkey") % 7 + 1).alias("project_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    if parts:
        rows = rows.repartition(parts, "document_id")
    order = Window.partitionBy("document_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return rows.withColumn("line_index", (F.row_number().over(order) - 1).cast("long")).select("document_id", "project_id", "line_index", text.alias("line_text"))


def text_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks (split at blank lines) and lines of whole texts, with 0-based reading orders. Null text has no lines."""
    blocks = docs.select(F.col(key).alias("document_id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n[ \t]*\n")).alias("block", "block_text"))
    return blocks.select("document_id", "block", F.posexplode(F.split("block_text", "\n")).alias("line_index", "line_text")).where("line_text <> ''")


def settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with more columns, each worked out once a row: they pass a generator, so that the optimizer does not write their
    expressions into every place that reads them."""
    made = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("made")
    return rows.select("*", made).select("*", "made.*").drop("made")


def tokenised(lines: DataFrame, *by: str) -> DataFrame:
    """One row per token: position, text, char_start, char_end in code points of its line, and the texts and offsets of the
    tokens before and after it. All comes from the line's own array, so that no row moves."""
    shape = F.lit(f"([{SPACE}]*)([^{SPACE}]+)")
    gaps, words = F.regexp_extract_all("line_text", shape, F.lit(1)), F.regexp_extract_all("line_text", shape, F.lit(2))
    rows = settled(lines.select(*by, "line_text"), w=F.arrays_zip(gaps.alias("gap"), words.alias("token")))
    # the end of each token: a running sum within the array
    ends = F.aggregate("w", F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + F.length(x["gap"]) + F.length(x["token"]))))
    rows = rows.select(*by, F.col("w.token").alias("w"), ends.alias("e")).select(*by, "w", "e", F.posexplode("w").alias("k", "token"))
    at = lambda step: F.get(F.col("w"), F.col("k") + step)
    end = lambda step: F.get(F.col("e"), F.col("k") + step)
    return rows.select(
        *by, F.col("k").cast("long").alias("position"), F.col("token").alias("text"), (end(0) - F.length("token")).alias("char_start"), end(0).alias("char_end"), at(-1).alias("text_before"), at(1).alias("text_after"), end(1).alias("end_after")
    )


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t).strip(), na_action="ignore")


def normalised(tokens: DataFrame) -> DataFrame:
    """NFKC and strip in one pass; ASCII tokens stay in generated code, the Python function gets a null for them. Empty tokens go."""
    plain = ~F.col("text").rlike("[^\\x00-\\x7F]")
    # what goes by Python is queued whole: settled first, so that tokens do not bring the arrays of their line along
    kept = [c for c in tokens.columns if c not in ("text_before", "text_after", "end_after")]
    rows = tokens.select(F.explode(F.array(F.struct(*kept, F.when(~plain, F.col("text")).alias("odd")))).alias("t")).select("t.*")
    rows = rows.withColumn("normalized_text", F.coalesce(F.when(F.col("odd").isNull(), F.trim("text")), _nfkc("odd"))).drop("odd")
    return rows.where("normalized_text <> ''")


def line_sizes(lines: DataFrame) -> DataFrame:
    """document_id, line_index, tokens: how many tokens there are in each line that has any."""
    return lines.select("document_id", "line_index", F.regexp_count("line_text", F.lit(f"[^{SPACE}]+")).cast("long").alias("tokens")).where("tokens > 0")


def token_counts(tokens: DataFrame) -> DataFrame:
    """Tokens of every line, document and all documents in one pass."""
    return tokens.rollup("document_id", "line_index").agg(F.count("*").alias("token_count"), F.grouping_id().alias("level"))


def assembled(tokens: DataFrame) -> DataFrame:
    """Tokens joined by a space, lines by a newline, in order. One document's tokens meet, never more."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["s"])
    lines = tokens.groupBy("document_id", "line_index").agg(F.array_join(ordered(F.struct(F.col("position").alias("k"), F.col("text").alias("s"))), " ").alias("line"))
    return lines.groupBy("document_id").agg(F.array_join(ordered(F.struct(F.col("line_index").alias("k"), F.col("line").alias("s"))), "\n").alias("assembled_text"))


def fold(text: Column) -> Column:
    """Collapsed white space, lower case."""
    return F.lower(F.regexp_replace(F.trim(text), "\\s+", " "))


def alphanumeric(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "[^\\p{L}\\p{N}]", ""))
