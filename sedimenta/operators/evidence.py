"""Evidence: designations, locations and quantities observed in tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import checksum, key
from ..functions.rules import BOUNDARY, NUMBER, NUMBER_WITH_UNIT, RULE_VERSIONS, is_designation, location_of, unit_of
from ..sources.stages import staged
from .text import settled, tokenised

LINE = ("document_id", "project_id", "line_index")


def bare(text: Column, side: str = "BOTH") -> Column:
    chars = BOUNDARY.replace("'", "''")
    return F.call_function({"BOTH": "btrim", "LEADING": "ltrim", "TRAILING": "rtrim"}[side], *((text, F.lit(chars.replace("''", "'"))) if side == "BOTH" else (F.lit(chars.replace("''", "'")), text)))


def trimmed(tokens: DataFrame) -> DataFrame:
    """``trimmed`` text and how many characters went on either side; all punctuation leaves nothing, 0 and 0."""
    text = F.col("text")
    gone = lambda side: F.when(bare(text) == "", 0).otherwise(F.length(text) - F.length(bare(text, side))).cast("long")
    return tokens.withColumns({"trimmed": bare(text), "trim_left": gone("LEADING"), "trim_right": gone("TRAILING")})


def number_status(number: Column) -> Column:
    """``exact``, or ``ambiguous`` for more than one separator or three digits and more behind the only one."""
    several = F.regexp_count(number, F.lit("[.,]")) > 1
    return F.when(several | (F.length(F.regexp_extract(number, "[.,]([0-9]+)$", 1)) >= 3), "ambiguous").otherwise("observed")


#: Other texts than these are not sent to all tasks: each line is read by itself then.
REPEATED, REPEATED_BYTES = 100_000, 32 << 20


def extract(tokens: DataFrame) -> DataFrame:
    """All evidence of all lines, with its keys."""
    return keyed(observed(tokens))


def keyed(rows: DataFrame) -> DataFrame:
    """``rule_version``, ``checksum`` and ``evidence_key`` from an observation's own columns: tables need not hold them."""
    versions = F.create_map(*(F.lit(x) for pair in RULE_VERSIONS.items() for x in pair))
    rows = rows.withColumns({"rule_version": versions[F.col("rule_id")], "checksum": checksum()})
    return rows.withColumn("evidence_key", key("document_id", "checksum", "rule_id", "rule_version", "kind", F.lit(1), F.lit(0), "line_index", "token_start", "token_end"))


def shown_in(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """One row for each line that shows something, with ``found``: its observations, without keys. What a line shows hangs on its text alone: where texts
    repeat, each is read once and its observations go to the lines by their text. The distinct texts (``texts``: the same lines in any order) are counted
    first; too many or too long ones are read line by line, where nothing is sent."""
    texts = staged(texts.select("line_text").where("line_text is not null").distinct(), "line-texts")
    n, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("line_text")), F.lit(0))).first()
    listed = lambda seen, *by: seen.groupBy(*by).agg(F.collect_list(F.struct(*(c for c in seen.columns if c not in {*LINE, *by}))).alias("found"))  # noqa: E731  of one line
    if n > REPEATED or size > REPEATED_BYTES:
        return listed(observed(tokenised(lines, *LINE)), *LINE)
    alone = texts.select(F.lit(0).cast("long").alias("document_id"), F.lit(0).cast("long").alias("project_id"), F.lit(0).cast("long").alias("line_index"), "line_text")
    return lines.join(F.broadcast(listed(observed(tokenised(alone, *LINE, "line_text"), "line_text"), "line_text")), "line_text").select(*LINE, "found")


def counted_in(lines: DataFrame) -> DataFrame:
    """The observations of each distinct text, with how many lines (``n``) have it: enough where documents do not matter."""
    texts = lines.where("line_text is not null").groupBy("line_text").agg(F.count("*").alias("n"))
    none = F.lit(None).cast("long")
    return observed(tokenised(texts.select(*(none.alias(c) for c in LINE), "n", "line_text"), *LINE, "n"), "n").drop(*LINE)


def observed_in(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """``observed`` of whole lines, by way of ``shown_in``."""
    return spread(shown_in(lines, texts))


def spread(shown: DataFrame) -> DataFrame:
    """A row for each observation of lines."""
    return shown.select(*LINE, F.explode("found").alias("e")).select(*LINE, "e.*")


def with_failing(shown: DataFrame) -> DataFrame:
    """``failing``: whether the line's document has a quantity without a value, so that its whole set fails."""
    empty = F.exists("found", lambda x: ~x["kind"].isin("designation", "location") & x["value"].isNull())
    return shown.withColumn("failing", F.max(empty).over(Window.partitionBy("document_id")))


def observed(tokens: DataFrame, *beside: str) -> DataFrame:
    """All evidence of all lines in one pass, without keys: each token becomes an array of what it shows, which is exploded.

    A number followed by a unit takes the unit token too: it is not offered to the other rules. Since numbers are
    never units, the token before tells, and no running state is needed.
    """
    after = F.col("text_after")
    rows = settled(tokens, trimmed=bare(F.col("text")), next_text=bare(after), before=bare(F.col("text_before")))
    cut = lambda text, whole, side: F.when(F.col(text) == "", 0).otherwise(F.length(whole) - F.length(bare(F.col(whole), side)))
    rows = settled(
        rows, number=F.col("trimmed").rlike(NUMBER), start=F.col("char_start") + cut("trimmed", "text", "LEADING"), end=F.col("char_end") - cut("trimmed", "text", "TRAILING"), next_end=F.col("end_after") - cut("next_text", "text_after", "TRAILING"),
        written=F.regexp_extract("trimmed", NUMBER_WITH_UNIT, 1), taken=F.coalesce(F.col("before").rlike(NUMBER) & unit_of(F.col("trimmed")).isNotNull(), F.lit(False)),
        u=unit_of(F.when(F.col("trimmed").rlike(NUMBER), F.col("next_text")).otherwise(F.regexp_extract("trimmed", NUMBER_WITH_UNIT, 2))),
    )
    two = F.col("number") & F.col("u").isNotNull()
    rows = settled(rows, two=two, number_as_written=F.when(two, F.col("trimmed")).otherwise(F.col("written")), location=location_of(F.col("trimmed")), named=is_designation(F.col("trimmed")))
    rows = settled(rows, status=number_status(F.col("number_as_written")))
    rows = settled(rows, value=F.when(F.col("u").isNotNull() & (F.col("status") == "observed"), F.regexp_replace("number_as_written", ",", ".").cast("decimal(28,6)")))
    rows = rows.select("*", "u.unit", "u.quantity_type", "u.base_unit", "u.scale", (F.col("position") + 1).alias("next_position"))
    start, end, number, status, value, location = (F.col(c) for c in ("start", "end", "number_as_written", "status", "value", "location"))

    def shown(when: Column, **values: Column) -> Column:
        names = {"kind": "string", "rule_id": "string", "observed_text": "string", "status": "string", "token_end": "long", "char_start": "long", "char_end": "long", "number_text": "string", "value": "decimal(28,6)", "unit": "string", "base_value": "decimal(38,6)", "base_unit": "string", "designation": "string"}
        return F.when(when, F.struct(*((values[n] if n in values else F.lit(None)).cast(t).alias(n) for n, t in names.items())))

    designation = shown(~F.col("taken") & F.col("named"), kind=F.lit("designation"), rule_id=F.lit("designation_generic"), observed_text=F.col("trimmed"), status=F.lit("observed"), token_end=F.col("position"), char_start=start, char_end=end, designation=F.col("trimmed"))
    place = shown(~F.col("taken") & location.isNotNull(), kind=F.lit("location"), rule_id=F.lit("location_aspect_iec_81346"), observed_text=location, status=F.lit("observed"), token_end=F.col("position"), char_start=start, char_end=start + F.length(location), designation=location)
    quantity = shown(
        F.col("unit").isNotNull(), kind=F.col("quantity_type"), rule_id=F.col("quantity_type"), observed_text=F.when(F.col("two"), F.concat_ws(" ", "trimmed", "next_text")).otherwise(F.col("trimmed")), status=status, token_end=F.when(F.col("two"), F.col("next_position")).otherwise(F.col("position")),
        char_start=start, char_end=F.when(F.col("two"), F.col("next_end")).otherwise(end), number_text=F.regexp_replace(number, ",", "."), value=value, unit=F.col("unit"), base_value=value * F.col("scale"), base_unit=F.when(value.isNotNull(), F.col("base_unit")),
    )
    found = rows.select(*LINE, *beside, F.col("position").alias("token_start"), F.explode(F.array_compact(F.array(quantity, designation, place))).alias("e"))
    return found.select(*LINE, *beside, "token_start", "e.*")


def evidence_violations(evidence: DataFrame, tokens: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """First failed check of each faulty row: unknown rule, unknown line, token range outside it, missing value. Lines are given by their ``tokens`` or by
    how many each has (``sizes``, see ``text.line_sizes``)."""
    if sizes is None:
        sizes = tokens.groupBy("document_id", "line_index").agg(F.count("*").alias("tokens"))
    rows = evidence.join(sizes, ["document_id", "line_index"], "left")
    quantity = F.col("kind").endswith("_value")
    code = (
        F.when(~F.col("rule_id").isin(*RULE_VERSIONS), "unknown_rule").when(F.col("tokens").isNull(), "unknown_line").when((F.col("token_end") >= F.col("tokens")) | (F.col("token_start") > F.col("token_end")), "token_range")
        .when(quantity & (F.col("status") == "observed") & F.col("value").isNull(), "value_missing").when(~quantity & F.col("designation").isNull(), "designation_missing")
    )
    return rows.withColumn("code", code).where("code is not null").select("document_id", "evidence_key", "code")


def quantities_by_unit(evidence: DataFrame) -> DataFrame:
    """How much is written, by unit: counts and sums in the base unit where there is one."""
    rows = evidence.where(F.col("kind").endswith("_value"))
    return rows.groupBy("unit").agg(F.count("*").alias("n"), F.count("value").alias("n_exact"), F.sum(F.coalesce("base_value", "value")).cast("double").alias("total"), F.countDistinct("document_id").alias("documents"))
