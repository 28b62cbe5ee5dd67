"""Pages and spans: sections, lines made of spans, provenance of what two tokens show, stages that an upload reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import NUMBER, unit_of
from .evidence import bare
from .text import SPACE

LINE = ("document_id", "page", "block", "line_index")


def sections(pages: DataFrame) -> DataFrame:
    """document_id, page, section: pages with text are sections, numbered from 0 in page order; the page number stays."""
    rows = pages.select("document_id", "page").distinct()
    return rows.withColumn("section", (F.dense_rank().over(Window.partitionBy("document_id").orderBy("page")) - 1).cast("long"))


def span_tokens(spans: DataFrame) -> DataFrame:
    """One row per token of the spans (document_id, page, block, line, span, text): lines of a block are numbered in the order in
    which they are first seen, and all spans of a line share one sequence of positions. Offsets are those in the span."""
    block = Window.partitionBy("document_id", "page", "block")
    first = spans.withColumn("seen", F.min("span").over(Window.partitionBy("document_id", "page", "block", "line")))
    rows = first.withColumn("line_index", (F.dense_rank().over(block.orderBy("seen")) - 1).cast("long"))
    shape = F.lit(f"([{SPACE}]*)([^{SPACE}]+)")
    parts = F.arrays_zip(F.regexp_extract_all("text", shape, F.lit(1)).alias("gap"), F.regexp_extract_all("text", shape, F.lit(2)).alias("token"))
    rows = rows.select(*LINE, "span", parts.alias("w"))
    ends = F.aggregate("w", F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + F.length(x["gap"]) + F.length(x["token"]))))
    rows = rows.select(*LINE, "span", "w", ends.alias("e")).select(*LINE, "span", "e", F.posexplode("w").alias("k", "t"))
    end = F.get("e", F.col("k"))
    rows = rows.select(*LINE, "span", F.col("t.token").alias("text"), (end - F.length("t.token")).alias("char_start"), end.alias("char_end"))
    return rows.withColumn("position", (F.row_number().over(Window.partitionBy(*LINE).orderBy("span", "char_start")) - 1).cast("long"))


def provenance(tokens: DataFrame) -> DataFrame:
    """Quantities written as two tokens of a line, with where they stand: one trimmed range if both are in one span, else two;
    ``source_text`` is the trimmed texts joined by a space."""
    line = Window.partitionBy(*LINE).orderBy("position")
    left = lambda: F.col("char_start") + F.length("text") - F.length(bare(F.col("text"), "LEADING"))
    right = lambda: F.col("char_end") - F.length("text") + F.length(bare(F.col("text"), "TRAILING"))
    rows = tokens.withColumns({"trimmed": bare(F.col("text")), "a": left(), "b": right()})
    nxt = lambda c: F.lead(c).over(line)
    rows = rows.withColumns({"next_text": nxt("trimmed"), "next_span": nxt("span"), "next_a": nxt("a"), "next_b": nxt("b")})
    rows = rows.where(F.col("trimmed").rlike(NUMBER) & unit_of(F.col("next_text")).isNotNull())
    part = lambda s, a, b: F.concat(F.col(s).cast("string"), F.lit(":"), F.col(a).cast("string"), F.lit("-"), F.col(b).cast("string"))
    one = F.col("span") == F.col("next_span")
    return rows.select(*LINE, "position", F.concat_ws(" ", "trimmed", "next_text").alias("source_text"), F.when(one, 1).otherwise(2).cast("long").alias("n_ranges"), F.when(one, part("span", "a", "next_b")).otherwise(F.concat_ws(",", part("span", "a", "b"), part("next_span", "next_a", "next_b"))).alias("ranges"))


def upload_outcomes(docs: DataFrame, held: DataFrame, text: str = "text") -> DataFrame:
    """document_id, stage, outcome, characters, reused: the last stage that each upload reaches, and what came of it.

    ``held``: document_id of representations that were made before, which are used again."""
    blank = F.col(text).rlike(f"^[{SPACE}]*$")
    stage = F.when(F.col(text).isNull(), "ingestion").when(F.length(text) == 0, "canonical_representation").when(blank, "text_assembly").otherwise("downstream_consumer")
    outcome = F.when(F.col(text).isNull(), "content_failure").when(F.length(text) == 0, "empty_representation").when(blank, "no_extractable_text").otherwise("completed")
    rows = docs.join(held.select("document_id").distinct().withColumn("held", F.lit(True)), "document_id", "left")
    size: Column = F.when(outcome == "completed", F.length(text)).otherwise(0).cast("long")
    return rows.select("document_id", stage.alias("stage"), outcome.alias("outcome"), size.alias("characters"), (F.col("held").isNotNull() & F.col(text).isNotNull()).alias("reused"))


def stripped(html: Column) -> Column:
    """Text of a page: scripts and styles go, every tag becomes a line end."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), "(?s)<script[^>]*>.*?</script>", ""), "(?s)<style[^>]*>.*?</style>", "")
    return F.regexp_replace(plain, "<[^>]*>", "\n")


def representation_faults(spans: DataFrame) -> DataFrame:
    """document_id, code, n: what is wrong with the spans (document_id, page, reading_order, x0, x1, width, kind) of a representation."""
    order = F.row_number().over(Window.partitionBy("document_id", "page").orderBy("reading_order")) - 1
    codes = F.array_compact(F.array(
        F.when(F.col("x0") > F.col("x1"), "reversed_box"), F.when(F.least("x0", "x1") < 0, "position"), F.when(F.col("width") < 0, "size"), F.when(F.col("kind") == "image", "image_with_spans"), F.when(F.col("reading_order") != F.col("k"), "reading_order"),
    ))
    rows = spans.withColumn("k", order).select("document_id", F.explode(codes).alias("code")).groupBy("document_id", "code").agg(F.count("*").alias("n"))
    pages = spans.groupBy("document_id").agg(F.min("page").alias("lo"), F.max("page").alias("hi"), F.countDistinct("page").alias("n")).where("lo <> 1 or hi <> n")
    return rows.unionByName(pages.select("document_id", F.lit("page_numbers").alias("code"), F.lit(1).cast("long").alias("n")))


def assembled_pages(tokens: DataFrame) -> DataFrame:
    """document_id, page, text: tokens joined by a space, lines by a newline, paragraphs (blocks) by a blank line. One page's tokens meet."""
    ordered = lambda k, c: F.transform(F.array_sort(F.collect_list(F.struct(F.col(k).alias("k"), F.col(c).alias("s")))), lambda x: x["s"])
    lines = tokens.groupBy(*LINE).agg(F.array_join(ordered("position", "text"), " ").alias("line"))
    blocks = lines.groupBy("document_id", "page", "block").agg(F.array_join(ordered("line_index", "line"), "\n").alias("paragraph"))
    return blocks.groupBy("document_id", "page").agg(F.array_join(ordered("block", "paragraph"), "\n\n").alias("text"))


def assembled_documents(tokens: DataFrame) -> DataFrame:
    """document_id, text: pages by a blank line, each under a line with its number."""
    pages = assembled_pages(tokens).withColumn("marked", F.concat(F.lit("[page "), F.col("page").cast("string"), F.lit("]\n"), F.col("text")))
    return pages.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "marked"))), lambda x: x["marked"]), "\n\n").alias("text"))
