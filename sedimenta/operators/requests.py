"""Request classification, reference normalisation and retrieval plans."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .phrases import first_of_each
from .text import SPACE

# Results depend on them.
PUNCTUATION = ".,;:!?()[]{}<>\"'`|/\\@#$%^&*+=~_-–—‘’“”¿¡"
REFERENCE_TYPES = (
    ("CABLE", "C", ("cable", "c")),
    ("TRANSFORMER", "TR", ("transformer", "tr")),
    ("BREAKER", "CB", ("breaker", "cb")),
    ("RELAY", "RELAY", ("relay",)),
    ("CABINET", "CAB", ("cabinet", "frame", "cab")),
    ("SWITCH", "SW", ("switch", "sw")),
    ("BUSBAR", "BUS", ("busbar", "bus")),
)
PRECEDENCE = ("drawing", "verification", "comparison", "navigation", "document", "explanation", "knowledge", "general", "unsupported")
CONFLICTING = ("drawing", "verification", "comparison", "navigation")
#: Phrases of this package's own; a table of the same columns can be passed instead.
RULES = (
    ("draw.request", "drawing", "strong", ("sketch", "draw", "draw up", "make a schematic", "make a diagram", "render the layout", "redraw")),
    ("verify.request", "verification", "strong", ("verify", "double check", "is it correct", "audit", "confirm that")),
    ("verify.wording", "verification", "weak", ("mismatch", "in line with", "deviates", "meets the standard")),
    ("place.shared", "structural", "strong", ("in one place", "next to each other", "in the same cabinet")),
    ("compare.request", "comparison", "strong", ("compare", "set side by side", "weigh against")),
    ("compare.wording", "comparison", "weak", ("versus", "against", "unlike", "contrast")),
    ("go.request", "navigation", "strong", ("open", "jump to", "bring up", "take me to")),
    ("look.request", "document", "strong", ("find", "look up", "where is", "search for")),
    ("look.wording", "document", "weak", ("document", "sheet", "drawing set", "manual", "attachment")),
    ("explain.request", "explanation", "strong", ("explain", "walk me through", "why does", "tell me about")),
    ("know.question", "knowledge", "weak", ("what", "which", "how many", "how much")),
    ("know.wording", "knowledge", "weak", ("value", "setting", "rating", "installed")),
    ("domain.words", "general", "domain", ("voltage", "current", "transformer", "relay", "cable", "breaker", "busbar", "feeder")),
    ("draw.request.it", "drawing", "strong", ("schizza", "fammi un disegno", "tracciami lo schema unifilare", "prepara una bozza grafica del quadro")),
    ("verify.request.it", "verification", "strong", ("ricontrolla", "convalida", "è corretto che", "torna con il progetto")),
    ("compare.request.it", "comparison", "strong", ("paragona", "metti a fianco", "che differenza passa tra")),
    ("go.request.it", "navigation", "strong", ("portami a", "salta alla pagina", "fammi vedere il foglio")),
    ("look.request.it", "document", "strong", ("cercami", "in quale foglio", "recupera il fascicolo")),
    ("look.wording.it", "document", "weak", ("fascicolo", "foglio", "allegato")),
    ("explain.request.it", "explanation", "strong", ("raccontami", "come mai", "a che cosa serve")),
    ("know.question.it", "knowledge", "weak", ("quanti", "quante", "che valore ha")),
    ("domain.words.it", "general", "domain", ("tensione", "corrente", "trasformatore", "interruttore", "cavo", "sbarra")),
)


@F.pandas_udf(StringType())
def _folded(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


def folded(text: Column) -> Column:
    """NFKC and case folding; ASCII texts stay in generated code, the Python function gets a null for them."""
    plain = ~text.rlike("[^\\x00-\\x7F]")
    return F.coalesce(F.when(plain, F.lower(text)), _folded(F.when(~plain, text)))


def request_tokens(text: Column) -> Column:
    """Normalised text, listed punctuation to spaces, split."""
    return F.filter(F.split(F.translate(folded(text), PUNCTUATION, " " * len(PUNCTUATION)), f"[{SPACE}]+"), lambda t: t != "")


def rule_matches(requests: DataFrame, rules: tuple[tuple[str, str, str, tuple[str, ...]], ...] = RULES) -> DataFrame:
    """Each rule at most once a request: its earliest phrase of several words, else its earliest word; phrases of any length."""
    found = first_of_each(request_tokens(F.col("text")), [(phrase.split(), k) for k, (_, _, _, phrases) in enumerate(rules) for phrase in phrases], len(rules))
    named = F.array(*(F.struct(F.lit(r).alias("rule_id"), F.lit(i).alias("intent"), F.lit(s).alias("strength")) for r, i, s, _ in rules))
    hits = requests.select("request_id", F.explode(found).alias("m")).select("request_id", F.get(named, F.col("m.grp")).alias("r"), "m.at", "m.phrase")
    return hits.select("request_id", "r.rule_id", "r.intent", "r.strength", "at", "phrase")


def match_evidence(matches: DataFrame) -> DataFrame:
    """The matches of each request in the order of the text, numbered from 1, with counts by strength and of distinct intents."""
    request = Window.partitionBy("request_id")
    n = lambda strength: F.count_if(F.col("strength") == strength).over(request)
    rows = matches.withColumns({"sequence": F.row_number().over(request.orderBy("at", "rule_id")).cast("long"), "n_strong": n("strong"), "n_weak": n("weak"), "n_domain": n("domain"), "n_intents": F.size(F.collect_set("intent").over(request)).cast("long")})
    return rows.select("request_id", "sequence", "rule_id", "intent", "strength", "phrase", "n_strong", "n_weak", "n_domain", "n_intents")


def classified(requests: DataFrame, matches: DataFrame) -> DataFrame:
    """Intent and confidence of each request."""
    rank = F.create_map(*(F.lit(x) for k, p in enumerate(PRECEDENCE) for x in (p, k)))
    rows = matches.withColumn("rank", F.coalesce(rank[F.col("intent")], F.lit(len(PRECEDENCE))))
    plain = F.col("strength") != "domain"
    sums = rows.groupBy("request_id").agg(
        F.count_if(plain).alias("n_plain"), F.countDistinct(F.when((F.col("strength") == "strong") & F.col("intent").isin(*CONFLICTING), F.col("intent"))).alias("n_conflicting"), F.countDistinct(F.when(F.col("strength") == "strong", F.col("intent"))).alias("n_strong"),
        F.min(F.when(F.col("strength") == "strong", F.col("intent"))).alias("strong"), F.min_by("intent", F.when(plain, F.col("rank"))).alias("best"),
    )
    all_rows = requests.select("request_id").join(sums, "request_id", "left")
    intent = F.when(F.col("n_plain").isNull(), "unsupported").when(F.col("n_plain") == 0, "general").when(F.col("n_conflicting") > 1, "ambiguous").otherwise(F.col("best"))
    rows = all_rows.withColumn("intent", intent)
    confidence = F.when(F.col("intent").isin("ambiguous", "unsupported"), "unresolved").when(F.col("intent") == "general", "low").when((F.col("n_strong") == 1) & (F.col("strong") == F.col("intent")), "high").otherwise("medium")
    return rows.select("request_id", "intent", confidence.alias("confidence"))


def normalised_reference(rows: DataFrame, column: str) -> DataFrame:
    """``reference_type`` and ``reference_id`` (CODE-NN) of references like "cable 7"; null for what has no known type."""
    spark = rows.sparkSession
    known = spark.createDataFrame([(s, t, c) for t, c, synonyms in REFERENCE_TYPES for s in synonyms], "synonym string, reference_type string, code string")
    shape = "^([A-Za-z]+)[\\s-]*([0-9]+)$"
    found = rows.withColumns({"synonym": F.lower(F.regexp_extract(F.trim(column), shape, 1)), "digits": F.regexp_extract(F.trim(column), shape, 2)}).join(F.broadcast(known), "synonym", "left")
    number = F.when(F.length("digits") < 2, F.lpad("digits", 2, "0")).otherwise(F.col("digits"))
    return found.withColumn("reference_id", F.when(F.col("code").isNotNull(), F.concat_ws("-", "code", number))).drop("synonym", "digits", "code")


def normalised_claim(rows: DataFrame, synonyms: dict[str, str]) -> DataFrame:
    """claim_id, predicate (a synonym's canonical word), attribute (without synonyms) and value of claims (claim_id, term, value)."""
    clean = F.lower(F.regexp_replace(F.trim("term"), "[ -]+", "_"))
    canonical = F.create_map(*(F.lit(x) for pair in synonyms.items() for x in pair))[clean]
    return rows.select("claim_id", F.coalesce(canonical, clean).alias("predicate"), clean.alias("attribute"), F.trim("value").alias("value"))


def request_designations(requests: DataFrame) -> DataFrame:
    """Words with a letter and a digit, stripped at the edges, each once a request."""
    words = requests.select("request_id", F.posexplode(F.split("text", "[ \\t-\\r]+")).alias("at", "w")).withColumn("designation", F.regexp_replace("w", "^[^A-Za-z0-9+-]+|[^A-Za-z0-9]+$", ""))
    words = words.where(F.col("designation").rlike("[A-Za-z]") & F.col("designation").rlike("[0-9]"))
    k = F.row_number().over(Window.partitionBy("request_id", F.lower("designation")).orderBy("at"))
    return words.withColumn("k", k).where("k = 1").select("request_id", "designation", F.col("at").cast("long").alias("at"))


def retrieval_plans(intents: DataFrame, designations: DataFrame) -> DataFrame:
    """insufficient, conflicting, entity lookup or lexical search for each request."""
    refs = normalised_reference(designations, "designation")
    sums = refs.groupBy("request_id").agg(F.count("*").alias("n_terms"), F.countDistinct("reference_id").alias("n_references"), F.min("reference_id").alias("reference_id"))
    rows = intents.join(sums, "request_id", "left").withColumn("n_terms", F.coalesce("n_terms", F.lit(0)))
    plan = F.when(F.col("n_terms") == 0, "insufficient").when(F.col("n_references") > 1, "conflicting").when(F.col("n_references") == 1, "entity_lookup").otherwise("lexical")
    return rows.select("request_id", "intent", plan.alias("plan"), F.when(plan == "entity_lookup", F.col("reference_id")).alias("reference_id"), F.least("n_terms", F.lit(8)).alias("n_terms"), F.when(F.col("intent") == "explanation", 1).otherwise(0).alias("neighbourhood"))


def comparison_plans(designations: DataFrame) -> DataFrame:
    """Exactly two designations make a comparison, left and right in the order written."""
    sides = designations.groupBy("request_id").agg(F.count("*").alias("n"), F.min_by("designation", "at").alias("first"), F.max_by("designation", "at").alias("last"))
    return sides.select("request_id", F.when(F.col("n") == 2, "ready").when(F.col("n") < 2, "insufficient").otherwise("conflicting").alias("plan"), F.when(F.col("n") == 2, F.col("first")).alias("left_term"), F.when(F.col("n") == 2, F.col("last")).alias("right_term"))
