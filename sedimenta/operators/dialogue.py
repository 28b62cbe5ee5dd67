"""Conversation and response tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def conversation_statistics(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.countDistinct("turn").alias("turns"), F.count("*").alias("messages"), F.count_if(F.col("role") == "assistant").alias("responses"), F.max("turn").alias("last_turn"))


def turn_statistics(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id", "turn").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "assistant").alias("responses"))


def gaps(messages: DataFrame) -> DataFrame:
    """Turns that don't follow the one before by one (or don't begin at the first)."""
    turns = messages.select("conv_id", "turn").distinct()
    rows = turns.withColumn("expected", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1 + F.min("turn").over(Window.partitionBy("conv_id")))
    return rows.where("turn <> expected").select("conv_id", "turn", F.col("expected").cast("long").alias("expected"))


def numbered(messages: DataFrame) -> DataFrame:
    """0-based numbers of messages in their turn and of events in their conversation."""
    order = ("turn", "role", "text")
    rows = messages.withColumn("sequence", (F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")) - 1).cast("long"))
    rows = rows.withColumn("event_sequence", (F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)) - 1).cast("long"))
    return rows.select("conv_id", "turn", "role", F.concat_ws(":", "turn", "sequence").alias("message_id"), "event_sequence")


def open_questions(messages: DataFrame) -> DataFrame:
    """Conversations whose last message is from the user."""
    last = messages.groupBy("conv_id").agg(F.max(F.struct("turn", "role", "text")).alias("m"))
    return last.where("m.role = 'user'").select("conv_id", F.col("m.turn").alias("turn"), F.col("m.text").alias("question"))


def recent_responses(messages: DataFrame, most: int = 5) -> DataFrame:
    """Distinct answers of a conversation, the newest first."""
    rows = messages.where("role = 'assistant'").groupBy("conv_id", "text").agg(F.max("turn").alias("turn"))
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), "text"))
    return rows.withColumn("place", k.cast("long")).where(F.col("place") <= most)


def prompt_records(messages: DataFrame) -> DataFrame:
    """Sections of a prompt by conversation, with the estimate of tokens: 0 for nothing, else a quarter of the characters."""
    sections = messages.groupBy("conv_id", "role").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("lines"))
    return sections.withColumn("tokens", F.when(F.col("chars") == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.col("chars") / 4)))).withColumn("enabled", F.col("lines") > 0)


def session_states(activity: DataFrame, idle: str = "2 hours", life: str = "12 hours") -> DataFrame:
    """State of a session at each of its events (session, event_id, ts, ends): revoked once an event ended it, else expired ``life`` after
    its start, else idle ``idle`` after the event before, else active."""
    order = Window.partitionBy("session").orderBy("ts", "event_id")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = activity.withColumns({"created": F.min("ts").over(Window.partitionBy("session")), "seen": F.lag("ts").over(order), "ended": F.coalesce(F.max(F.col("ends").cast("int")).over(past), F.lit(0)) > 0})
    last = F.coalesce("seen", "created")
    state = F.when(F.col("ended"), "revoked").when(F.col("ts") >= F.col("created") + F.expr(f"interval {life}"), "expired").when(F.col("ts") >= last + F.expr(f"interval {idle}"), "idle").otherwise("active")
    return rows.select("session", "event_id", state.alias("state"))


def response_status(blocks: DataFrame) -> DataFrame:
    """Status of each response from its blocks (response_id, kind, text, finish; no kind: no content): empty, unsupported without a text, partial
    with a block of another kind or if it was cut short, else complete."""
    text = (F.col("kind") == "text") & (F.coalesce(F.trim("text"), F.lit("")) != "")
    sums = blocks.groupBy("response_id").agg(F.count("kind").alias("blocks"), F.count_if(text).alias("texts"), F.count_if(F.col("kind") != "text").alias("others"), F.max(F.col("finish").isin("maximum_output_reached", "stop_sequence")).alias("cut"))
    status = F.when(F.col("blocks") == 0, "empty").when(F.col("texts") == 0, "unsupported").when((F.col("others") > 0) | F.col("cut"), "partial").otherwise("complete")
    return sums.select("response_id", status.alias("status"))


def prompts(messages: DataFrame, order: dict[str, int]) -> DataFrame:
    """conv_id, prompt, tokens, sections: the sections of a conversation's prompt in order, each under its name, with an estimate of tokens."""
    rank = F.create_map(*(F.lit(x) for pair in order.items() for x in pair))[F.col("role")]
    lines = messages.where("text is not null").groupBy("conv_id", "role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("body"))
    tokens = F.when(F.length("body") == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length("body") / 4)))
    section = F.struct(rank.alias("k"), F.concat(F.lit("## "), "role", F.lit("\n"), "body").alias("s"))
    return lines.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(section)), lambda x: x["s"]), "\n").alias("prompt"), F.sum(tokens).cast("long").alias("tokens"), F.count("*").alias("sections"))


# Ranks of uncertainty, words of a verdict, priority and lifetime of memory entries.
RANKS = (("low", 0), ("medium", 1), ("unknown", 2), ("high", 3))
VERDICTS = ("SUPPORTED", "NOT_SUPPORTED", "INSUFFICIENT_EVIDENCE", "CONFLICTING_EVIDENCE")
MEMORY = (("open_question", "high", "turn"), ("recent_engineering_response", "low", "conversation"), ("active_reference", "medium", "conversation"), ("assumption", "medium", "conversation"), ("constraint", "high", "conversation"))


def uncertainty(rows: DataFrame) -> DataFrame:
    """Worst level and the reasons of each response (status, ambiguous, retrieved, completeness)."""
    part, c = F.col("status"), F.col("completeness")
    why = lambda rank, reason: F.struct(F.lit(rank).alias("rank"), F.lit(reason).alias("reason"))
    said = F.array_compact(F.array(
        F.when(part == "empty", why(2, "no_content")), F.when(F.col("ambiguous"), why(3, "ambiguous_query")), F.when(F.col("retrieved") == 0, why(3, "nothing_retrieved")).when(c < 0.5, why(3, "low_completeness")).when(c < 1, why(1, "part_left_out")),
        F.when(part == "unsupported", why(3, "no_usable_text")).when(part == "partial", why(1, "not_in_full")),
    ))
    rows = rows.withColumn("said", said)
    worst = F.coalesce(F.array_max(F.transform("said", lambda x: x["rank"])), F.lit(0))
    level = F.create_map(*(F.lit(x) for name, rank in RANKS for x in (rank, name)))[worst]
    return rows.select("request_id", level.alias("level"), F.array_join(F.transform("said", lambda x: x["reason"]), ",").alias("reasons"))


def declared_verdict(answers: DataFrame) -> DataFrame:
    """response_id, outcome, stated: the first line of an answer if it is one of the four words (a colon or full stop may follow); without
    evidence the outcome is insufficient whatever it says."""
    line = F.trim(F.regexp_extract("text", "^\\s*([^\\n]*)", 1))
    word = F.upper(F.trim(F.rtrim(line, F.lit(":."))))
    said = F.when(word.isin(*VERDICTS), F.lower(word))
    return answers.select("response_id", F.when(F.col("evidence") == 0, "insufficient_evidence").otherwise(said).alias("outcome"), said.isNotNull().alias("stated"))


def memory_entries(messages: DataFrame, most: int = 5) -> DataFrame:
    """What a conversation remembers, in order: its open question, its newest answers, their distinct references (first words, in the order
    first seen), and what the newest answer assumes (its length) and is bound by (its turn)."""
    kinds = {k: n for n, (k, _, _) in enumerate(MEMORY)}
    entry = lambda df, kind, rank, content: df.select("conv_id", F.lit(kinds[kind]).alias("place"), F.lit(kind).alias("entry_type"), rank.cast("long").alias("rank"), content.alias("content"))
    recent = recent_responses(messages, most)
    question = entry(open_questions(messages), "open_question", F.lit(0), F.col("question"))
    answers = entry(recent, "recent_engineering_response", F.col("place"), F.col("text"))
    first = recent.select("conv_id", F.regexp_extract("text", "^\\s*(\\S*)", 1).alias("reference"), "place").where("reference <> ''").groupBy("conv_id", "reference").agg(F.min("place").alias("place"))
    references = entry(first, "active_reference", F.col("place"), F.col("reference"))
    newest = recent.where("place = 1")
    assumed = entry(newest, "assumption", F.lit(0), F.concat(F.lit("length:"), F.length("text").cast("string")))
    bound = entry(newest, "constraint", F.lit(0), F.concat(F.lit("turn:"), F.col("turn").cast("string")))
    rows = question.unionByName(answers).unionByName(references).unionByName(assumed).unionByName(bound)
    policy = F.broadcast(messages.sparkSession.createDataFrame(list(MEMORY), "entry_type string, priority string, lifetime string"))  # five rows
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("place", "rank", "content")) - 1
    return rows.withColumn("sequence", k.cast("long")).join(policy, "entry_type").select("conv_id", "sequence", "entry_type", "content", "priority", "lifetime")


def reasoning_report(results: DataFrame) -> DataFrame:
    """Message and number of supports of each reasoning result: conflict, ambiguity, insufficiency or agreement."""
    v = F.col("verdict")
    kind = F.when(v.isin("inconsistent", "unsupported_comparison"), "conflict").when(v == "ambiguous", "ambiguity").when(v.isin("no_subject", "no_required_quantity", "unparsable_value"), "insufficient").otherwise("agreement")
    supports = F.size("contributors").cast("long")
    return results.select("result_id", kind.alias("message_kind"), supports.alias("n_supports"), F.concat_ws(" ", "designation", F.regexp_replace(v, "_", " ")).alias("message"))


def working_memory(messages: DataFrame, responses: DataFrame, most: int = 5) -> DataFrame:
    """What a conversation remembers, in order: its open question, the status of its newest ``most`` responses, the references of these (each once, in the
    order first seen), and of the newest the reasons of its uncertainties as assumptions and its warnings as constraints.

    ``responses``: response_id, conv_id, at, status and arrays of references, reasons and warnings. Of responses of one time the higher id is newer."""
    kinds = {k: n for n, (k, _, _) in enumerate(MEMORY)}
    order = Window.partitionBy("conv_id").orderBy(F.desc("at"), F.desc("response_id"))
    recent = responses.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    no_response = F.lit(None).cast("long")
    entry = lambda df, kind, rank, content, response: df.select("conv_id", F.lit(kinds[kind]).alias("kind"), F.lit(kind).alias("entry_type"), rank.cast("long").alias("rank"), content.alias("content"), response.alias("response_id"))
    question = entry(open_questions(messages), "open_question", F.lit(0), F.col("question"), no_response)
    answers = entry(recent, "recent_engineering_response", F.col("place"), F.concat(F.lit("status="), "status"), F.col("response_id"))
    seen = recent.select("conv_id", "place", F.posexplode("references").alias("k", "item")).groupBy("conv_id", "item").agg(F.min(F.col("place") * 1_000_000 + F.col("k")).alias("first"))
    references = entry(seen, "active_reference", F.col("first"), F.col("item"), no_response)
    newest = recent.where("place = 1")
    said = lambda kind, column: entry(newest.select("conv_id", F.posexplode(column).alias("k", "item")), kind, F.col("k"), F.col("item"), no_response)
    rows = question.unionByName(answers).unionByName(references).unionByName(said("assumption", "reasons")).unionByName(said("constraint", "warnings"))
    policy = F.broadcast(messages.sparkSession.createDataFrame(list(MEMORY), "entry_type string, priority string, lifetime string"))  # five rows
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("kind", "rank", "content")) - 1
    return rows.withColumn("sequence", k.cast("long")).join(policy, "entry_type").select("conv_id", "sequence", "entry_type", "content", "response_id", "priority", "lifetime")


def memory_statistics(entries: DataFrame) -> DataFrame:
    """conv_id, entries, and how many of each type."""
    return entries.groupBy("conv_id").agg(F.count("*").alias("entries"), *(F.count_if(F.col("entry_type") == k).alias(k) for k, _, _ in MEMORY))


def session_statistics(timeline: DataFrame) -> DataFrame:
    """session_id, timeline_events, responses, created_at, last_activity_at and seconds of sessions (session_id, ts, response: whether an event attached one)."""
    span = F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))
    return timeline.groupBy("session_id").agg(F.count("*").alias("timeline_events"), F.count_if("response").alias("responses"), F.min("ts").alias("created_at"), F.max("ts").alias("last_activity_at"), span.alias("seconds"))
