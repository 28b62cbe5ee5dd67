"""Batch retrieval over the graph, context selection, reasoning and the mention index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import UNIT_SEPARATOR
from .text import alphanumeric, fold

# Caps and weights.
KIND_CAPS = {"engineering_asset": 50, "engineering_quantity": 50, "structural_location": 20, "relationship": 50}
EXACT, PARTIAL, REPEAT, SEVERAL = 100.0, 40.0, 2.0, 10.0


# Designation strategies by precedence.
STRATEGIES = ((1, "exact_designation"), (2, "normalized_designation"), (3, "normalized_value"), (4, "canonical_designation"))


def asset_matches(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, node_id, precedence: the first strategy by which a designation finds an asset of its project.

    Each strategy is an equality of a derived key, so that all are shuffle joins and none a comparison of all pairs.
    """
    keyed = lambda *keys: F.explode(F.array(*(F.struct(F.lit(k).alias("precedence"), c.alias("match_key")) for (k, _), c in zip(STRATEGIES, keys, strict=True)))).alias("k")
    name, label, value = F.col("designation"), F.col("label"), F.col("normalized_value")
    q = queries.select("query_id", "project_id", keyed(name, fold(name), fold(name), alphanumeric(name))).select("query_id", "project_id", "k.*")
    n = nodes.where("node_kind = 'engineering_asset'").select("node_id", "project_id", "label", keyed(label, fold(label), fold(value), alphanumeric(label))).select("node_id", "project_id", "label", "k.*").where("match_key <> ''")
    return q.join(n, ["project_id", "precedence", "match_key"]).groupBy("query_id", "project_id", "node_id", "label").agg(F.min("precedence").alias("precedence"))


def ranked(matches: DataFrame, limit: int = 20) -> DataFrame:
    """Results in order, cut to the limit, with the total before the cut."""
    query = Window.partitionBy("query_id")
    order = query.orderBy("precedence", fold(F.col("label")), "node_id")
    return matches.withColumns({"place": F.row_number().over(order).cast("long"), "total": F.count("*").over(query)}).where(F.col("place") <= limit)


def outcomes(queries: DataFrame, matches: DataFrame) -> DataFrame:
    n = matches.groupBy("query_id").agg(F.count("*").alias("total"))
    rows = queries.join(n, "query_id", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    return rows.select("query_id", "total", F.when(F.col("total") == 0, "no_match").when(F.col("total") == 1, "unique_match").otherwise("multiple_matches").alias("outcome"))


def in_scope(rows: DataFrame, scope: str) -> DataFrame:
    """``current``: active rows; ``current_and_historical``: historical ones too."""
    return rows.where(F.col("state").isin(*(("active",) if scope == "current" else ("active", "historical"))))


def result_ids(matches: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """All results of each query with their ids - ``kind:node``, ``relationship:edge``, ``kind:edge:node`` - the first occurrence of each kept."""
    assets = matches.select("query_id", "precedence", F.concat_ws(":", F.lit("engineering_asset"), "node_id").alias("result_id"), F.lit(0).alias("source"))
    at = matches.join(edges.select(F.col("subject_id").alias("node_id"), "edge_id", "object_id"), "node_id")
    relations = at.select("query_id", F.lit(5).alias("precedence"), F.concat_ws(":", F.lit("relationship"), "edge_id").alias("result_id"), F.lit(1).alias("source"))
    ends = at.join(nodes.select(F.col("node_id").alias("object_id"), "node_kind"), "object_id")
    objects = ends.select("query_id", F.lit(5).alias("precedence"), F.concat_ws(":", "node_kind", "edge_id", "object_id").alias("result_id"), F.lit(2).alias("source"))
    rows = assets.unionByName(relations).unionByName(objects)
    return rows.groupBy("query_id", "result_id").agg(F.min(F.struct("precedence", "source")).alias("first")).select("query_id", "result_id", F.col("first.precedence").cast("long").alias("precedence"))


def first_entries(entries: DataFrame, natural: list[str]) -> DataFrame:
    """Index entries once each: by id, then by natural key; the oldest stays."""
    k = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("recorded_at", "entry_id"))
    once = entries.withColumn("k", k("entry_id")).where("k = 1").drop("k")
    return once.withColumn("k", k(*natural)).where("k = 1").drop("k")


def with_metadata(ranked: DataFrame, metadata: DataFrame, total: DataFrame) -> DataFrame:
    """Of each request: how many of its documents lack metadata, and the warnings that its result carries."""
    rows = ranked.join(metadata.select("document_id", F.lit(True).alias("held")), "document_id", "left")
    sums = rows.groupBy("request_id").agg(F.count("*").alias("returned"), F.count_if(F.col("held").isNull()).alias("missing"))
    rows = total.join(sums, "request_id", "left").fillna(0, ["matched", "returned", "missing"])
    warnings = F.array_compact(F.array(F.when(F.col("matched") == 0, "no_match"), F.when(F.col("matched") > F.col("returned"), "truncated"), F.when(F.col("missing") > 0, "missing_metadata")))
    return rows.select("request_id", "matched", "returned", "missing", F.array_join(warnings, ",").alias("warnings"))


def related_objects(matches: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Objects that the found assets' edges lead to, each result once."""
    ends = nodes.select(F.col("node_id").alias("object_id"), F.col("label").alias("object_label"), "node_kind")
    rows = matches.join(edges.select(F.col("subject_id").alias("node_id"), "edge_id", "edge_kind", "object_id"), "node_id").join(ends, "object_id")
    return rows.select("query_id", "project_id", F.concat_ws(":", "node_kind", "edge_id", "object_id").alias("result_id"), "node_kind", "edge_kind", "label", "object_label", "precedence").distinct()


def select_items(items: DataFrame, total: int = 100, caps: dict[str, int] | None = None) -> DataFrame:
    """Which items of a request fit the budget: within their kind's cap and then the total, in order; and why not.

    The window over a whole request sees only what the caps of its kinds let through, a bounded number of rows. Of the others,
    the last place that the total still reaches tells the reason."""
    caps = KIND_CAPS if caps is None else caps
    cap = F.lit(total)
    for kind, n in caps.items():
        cap = F.when(F.col("kind") == kind, n).otherwise(cap)
    order = ("order_key", "item_id")
    rows = items.withColumn("eligible", F.row_number().over(Window.partitionBy("request_id", "kind").orderBy(*order)) <= cap)
    # the total-th eligible item: what comes after it finds the budget used up
    few = rows.where("eligible").select("request_id", F.struct(*order).alias("last"), F.row_number().over(Window.partitionBy("request_id").orderBy(*order)).alias("k"))
    full = few.where(F.col("k") == total).select("request_id", "last")
    rows = rows.join(full, "request_id", "left").withColumn("late", F.coalesce(F.struct(*order) > F.col("last"), F.lit(total <= 0)))
    rows = rows.withColumn("selected", F.col("eligible") & ~F.col("late"))
    return rows.withColumn("discard_reason", F.when(F.col("selected"), None).when(F.col("late"), "items").otherwise(F.col("kind"))).drop("eligible", "late", "last")


def consumption(chosen: DataFrame, total: int = 100, caps: dict[str, int] | None = None) -> DataFrame:
    """Requested, accepted and discarded, the limit and how much of it is used, by kind and in all (kind null)."""
    caps = KIND_CAPS if caps is None else caps
    limit = F.lit(total)
    for kind, n in caps.items():
        limit = F.when(F.col("kind") == kind, n).otherwise(limit)
    rows = chosen.groupingSets([["request_id", "kind"], ["request_id"]], "request_id", "kind").agg(F.count("*").alias("requested"), F.count_if("selected").alias("accepted"))
    rows = rows.withColumn("discarded", F.col("requested") - F.col("accepted")).withColumn("exceeded", F.col("discarded") > 0)
    return rows.withColumn("cap", limit.cast("long")).withColumn("utilisation", F.when(F.col("cap") > 0, F.col("accepted") / F.col("cap")))


def package_faults(held: DataFrame, chosen: DataFrame) -> DataFrame:
    """request_id, errors of the packages whose recorded counts or flag (requested, accepted, exceeded) are not those of their items."""
    now = consumption(chosen).where("kind is null").select("request_id", *(F.col(c).alias(f"{c}_now") for c in ("requested", "accepted", "exceeded")))
    unlike = lambda c: ~F.col(c).eqNullSafe(F.col(f"{c}_now"))
    errors = F.concat_ws(",", F.when(unlike("accepted"), "accepted_count"), F.when(unlike("requested"), "requested_count"), F.when(unlike("exceeded"), "exceeded_flag"))
    return held.join(now, "request_id", "left").select("request_id", errors.alias("errors")).where("errors <> ''")


def query_faults(queries: DataFrame) -> DataFrame:
    """query_id, codes of the retrieval queries (wanted, designation, project, subjects) that may not run."""
    name = F.coalesce(F.trim("designation"), F.lit(""))
    broken = {"limit": (F.col("wanted") < 1) | (F.col("wanted") > 200), "designation": (name == "") | (F.length("designation") > 120), "scope": F.col("project") < 1, "subject": F.col("subjects") != 1}
    return queries.select("query_id", F.concat_ws(",", *(F.when(c, n) for n, c in broken.items())).alias("codes")).where("codes <> ''")


def mention_faults(mentions: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """mention_id, codes of the mentions (identifier, kind, page, locator) that may not enter the index."""
    broken = {"blank_identifier": F.coalesce(F.trim("identifier"), F.lit("")) == "", "unknown_kind": ~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)), "page": F.coalesce(F.col("page") < 1, F.lit(True)), "locator": F.col("locator").isNotNull() & ~F.col("locator").rlike("^[0-9]+$")}
    codes = F.concat_ws(",", *(F.when(c, name) for name, c in broken.items()))
    return mentions.select("mention_id", codes.alias("codes")).where("codes <> ''")


def claim_faults(claims: DataFrame, evidence: DataFrame, several_documents: bool = False) -> DataFrame:
    """claim_id, codes of the claims (kind, subject, predicate, object) that break a rule, with their evidence (claim_id, evidence_id, document_id, project_id)."""
    of = evidence.groupBy("claim_id", "evidence_id").agg(F.count("*").alias("times"), F.min("document_id").alias("d0"), F.max("document_id").alias("d1"), F.min("project_id").alias("p0"), F.max("project_id").alias("p1"))
    sums = of.groupBy("claim_id").agg(F.max("times").alias("times"), F.min("d0").alias("d0"), F.max("d1").alias("d1"), F.min("p0").alias("p0"), F.max("p1").alias("p1"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    whole = F.col("kind").isin("relationship", "attribute")
    broken = {
        "subject": blank("subject"), "predicate": whole & blank("predicate"), "object": whole & blank("object"), "no_evidence": F.col("times").isNull(), "repeated_evidence": F.col("times") > 1, "several_projects": F.col("p0") < F.col("p1"),
        **({} if several_documents else {"several_documents": F.col("d0") < F.col("d1")}),
    }
    return claims.join(sums, "claim_id", "left").select("claim_id", F.concat_ws(",", *(F.when(c, name) for name, c in broken.items())).alias("codes")).where("codes <> ''")


def coverage(chosen: DataFrame) -> DataFrame:
    """Share of each kind that was selected (1 where there is none), and their mean."""
    kinds = (("assets", "engineering_asset"), ("quantities", "engineering_quantity"), ("relationships", "relationship"))
    counts = chosen.groupBy("request_id").agg(F.count("*").alias("n"), F.count_if("selected").alias("s"), *(F.count_if(F.col("kind") == k).alias(f"n_{c}") for c, k in kinds), *(F.count_if((F.col("kind") == k) & F.col("selected")).alias(f"s_{c}") for c, k in kinds))
    share = lambda s, n: F.when(F.col(n) == 0, 1.0).otherwise(F.col(s) / F.col(n))
    rows = counts.select("request_id", share("s", "n").alias("items"), *(share(f"s_{c}", f"n_{c}").alias(c) for c, _ in kinds))
    return rows.withColumn("completeness", (F.col("items") + F.col("assets") + F.col("quantities") + F.col("relationships")) / 4)


def quantity_consistency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Whether the approved quantities of each asset agree, over all documents of a project."""
    assets = nodes.where("node_kind = 'engineering_asset'").select(F.col("node_id").alias("subject_id"), F.col("label").alias("asset"), "project_id")
    values = nodes.where("node_kind = 'engineering_quantity'").select(F.col("node_id").alias("object_id"), "value", "unit")
    rows = assets.join(edges.where("edge_kind = 'has_rated_power'").select("subject_id", "object_id"), "subject_id", "left").join(values, "object_id", "left")
    sums = rows.groupBy("project_id", "asset").agg(F.count("object_id").alias("n"), F.count("value").alias("parsed"), F.countDistinct("value").alias("n_values"), F.countDistinct("unit").alias("n_units"))
    verdict = F.when(F.col("n") == 0, "no_required_quantity").when(F.col("parsed") == 0, "unparsable_value").when(F.col("n_units") > 1, "unsupported_comparison").when(F.col("n_values") > 1, "inconsistent").when(F.col("n") == 1, "single_value").otherwise("values_equal")
    return sums.withColumn("verdict", verdict)


# What an id of a reasoning result is made of, before the question, the project and the sorted contributors.
REASONING = ("reasoning/result/1", "quantity_consistency", "1.0")


def package_consistency(asked: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Verdict of each question (document_id, designation) over the package of its document: whether the asset's approved quantities agree.

    ``contributors`` holds the quantities that were read, by label and id, each with its value, unit and the statement that it comes from. The id of a result
    follows from rule, question, project and the contributors' ids in order of these, and from nothing else: the same knowledge gives the same id.
    A document's nodes meet, never more."""
    assets = nodes.where("node_kind = 'engineering_asset'").select("document_id", alphanumeric(F.col("label")).alias("name"), F.col("node_id").alias("subject_id"))
    values = nodes.where("node_kind = 'engineering_quantity'").select("document_id", F.col("node_id").alias("object_id"), F.col("label").alias("quantity"), "value", "unit", F.col("statement_key").alias("source"))
    held = edges.where("edge_kind = 'has_rated_power'").select("document_id", "subject_id", "object_id", "edge_id").join(values, ["document_id", "object_id"])
    project = nodes.groupBy("document_id").agg(F.min("project_id").alias("project_id"))
    rows = asked.join(project, "document_id", "left").withColumn("name", alphanumeric(F.col("designation"))).join(assets, ["document_id", "name"], "left").join(held, ["document_id", "subject_id"], "left")
    item = F.concat_ws(":", F.lit("engineering_quantity"), "edge_id", "object_id")
    one = F.struct(F.col("quantity").alias("order_key"), item.alias("id"), F.col("value").cast("double").alias("value"), "unit", F.col("source"))
    comparable = F.col("value").isNotNull() & F.col("unit").isNotNull()
    distinct = lambda c: F.count_distinct(F.when(comparable, F.col(c)))
    sums = rows.groupBy("document_id", "project_id", "designation").agg(
        F.count_distinct("subject_id").alias("subjects"), F.count_distinct("edge_id").alias("n"), F.count_distinct(F.when(comparable, F.col("edge_id"))).alias("parsed"), distinct("value").alias("n_values"), distinct("unit").alias("n_units"), F.array_sort(F.collect_set(F.when(F.col("object_id").isNotNull(), one))).alias("c")
    )
    verdict = (
        F.when(F.col("subjects") > 1, "ambiguous").when(F.col("subjects") == 0, "no_subject").when(F.col("n") == 0, "no_required_quantity").when(F.col("parsed") == 0, "unparsable_value")
        .when(F.col("n_units") > 1, "unsupported_comparison").when(F.col("n_values") > 1, "inconsistent").when(F.col("parsed") == 1, "single_value").otherwise("values_equal")
    )
    read = F.when(F.col("subjects") == 1, F.col("c")).otherwise(F.array().cast(sums.schema["c"].dataType))
    sums = sums.withColumns({"verdict": verdict, "contributors": read})
    question = F.concat_ws(":", "document_id", "designation")
    parts = F.concat_ws(UNIT_SEPARATOR, *map(F.lit, REASONING), question, F.coalesce(F.col("project_id").cast("string"), F.lit("")), F.array_sort(F.transform("contributors", lambda x: x["id"])))
    return sums.select("document_id", "project_id", "designation", "subjects", F.size("contributors").cast("long").alias("n"), "verdict", "contributors", F.sha2(parts, 256).alias("result_id"))


def shared_locations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of each location and project: its assets, in order, as one row; pairs are read off it and never multiplied out."""
    assets = nodes.where("node_kind = 'engineering_asset'").select(F.col("node_id").alias("subject_id"), F.col("label").alias("asset"), "project_id")
    places = nodes.where("node_kind = 'structural_location'").select(F.col("node_id").alias("object_id"), F.col("label").alias("location"))
    rows = edges.where("edge_kind = 'is_located_in'").join(assets, "subject_id").join(places, "object_id")
    return rows.groupBy("project_id", "location").agg(F.countDistinct("asset").alias("n_assets"), F.min("asset").alias("first_asset"), F.max("asset").alias("last_asset"))


def same_location(pairs: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Verdict for requested pairs of assets (project_id, left_asset, right_asset)."""
    assets = nodes.where("node_kind = 'engineering_asset'").select(F.col("node_id").alias("subject_id"), F.col("label").alias("asset"), "project_id")
    places = nodes.where("node_kind = 'structural_location'").select(F.col("node_id").alias("object_id"), F.col("label").alias("location"))
    own = edges.where("edge_kind = 'is_located_in'").join(assets, "subject_id").join(places, "object_id").groupBy("project_id", "asset").agg(F.countDistinct("location").alias("n"), F.min("location").alias("location"))
    rows = pairs
    for side in ("left", "right"):
        rows = rows.join(own.select("project_id", F.col("asset").alias(f"{side}_asset"), F.col("n").alias(f"{side}_n"), F.col("location").alias(f"{side}_location")), ["project_id", f"{side}_asset"], "left")
    verdict = (
        F.when(F.col("left_n").isNull() & F.col("right_n").isNull(), "missing_both").when(F.col("left_n").isNull(), "missing_left").when(F.col("right_n").isNull(), "missing_right")
        .when((F.col("left_n") > 1) | (F.col("right_n") > 1), "several_locations").when(F.col("left_location") != F.col("right_location"), "different").otherwise("established")
    )
    return rows.select("project_id", "left_asset", "right_asset", verdict.alias("verdict"), F.when(verdict == "established", F.concat_ws(UNIT_SEPARATOR, F.least("left_asset", "right_asset"), "left_location", F.greatest("left_asset", "right_asset"))).alias("path"))


def grams(text: Column) -> Column:
    """Distinct runs of one to three characters."""
    runs = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n)))
    return F.array_distinct(F.flatten(F.array_compact(F.array(*map(runs, (1, 2, 3))))))


def containing(terms: DataFrame, identifiers: DataFrame) -> DataFrame:
    """project_id, term, identifier for each identifier that contains a term of its project, from distinct rows of both.

    A term is filed under the rarest of its runs of three characters (of all its characters if it is shorter); an
    identifier's own runs fetch the terms, and only those are compared."""
    longest = F.least(F.length("term"), F.lit(3))
    own = terms.where("term <> ''").select("project_id", "term", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("term") - longest + 1), lambda i: F.substring(F.col("term"), i, longest)))).alias("gram"))
    held = identifiers.select("project_id", "identifier", F.explode(grams(F.col("identifier"))).alias("gram"))
    counts = held.groupBy("project_id", "gram").agg(F.count("*").alias("n"))
    filed = own.join(counts, ["project_id", "gram"]).groupBy("project_id", "term").agg(F.min(F.struct("n", "gram")).alias("rarest")).select("project_id", "term", F.col("rarest.gram").alias("gram"))
    return filed.join(held, ["project_id", "gram"]).where(F.contains("identifier", "term")).select("project_id", "term", "identifier")


def ranked_documents(terms: DataFrame, entries: DataFrame, limit: int = 20) -> DataFrame:
    """Documents by relevance for each request: distinct terms meet distinct identifiers first, requests and entries come after. An entry has one
    identifier, so that the mentions of a document are summed over the different identifiers that a request's terms meet; no list is gathered."""
    t = terms.select("request_id", "project_id", F.upper("term").alias("term")).distinct()
    e = entries.select("entry_id", "project_id", "document_id", F.upper("identifier").alias("identifier"))
    met = containing(t.select("project_id", "term").distinct(), e.select("project_id", "identifier").distinct())
    held = e.groupBy("project_id", "identifier", "document_id").agg(F.count_distinct("entry_id").alias("n"))
    points = F.when(F.col("term") == F.col("identifier"), EXACT).otherwise(PARTIAL)
    # what a term brings a document does not depend on who asks
    brought = met.withColumn("points", points).join(held, ["project_id", "identifier"]).groupBy("project_id", "term", "document_id").agg(F.max("points").alias("points"))
    score = t.join(brought, ["project_id", "term"]).groupBy("request_id", "document_id").agg(F.sum("points").alias("points"), F.count("*").alias("n_terms"))
    asked = t.join(met, ["project_id", "term"]).select("request_id", "project_id", "identifier").distinct()
    mentions = asked.join(held, ["project_id", "identifier"]).groupBy("request_id", "document_id").agg(F.sum("n").alias("mentions"))
    score = score.join(mentions, ["request_id", "document_id"])
    score = score.withColumn("score", F.col("points") + REPEAT * (F.col("mentions") - 1) + SEVERAL * (F.col("n_terms") - 1))
    order = Window.partitionBy("request_id").orderBy(F.desc("score"), F.desc("mentions"), "document_id")
    return score.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= limit).select("request_id", "document_id", "mentions", "n_terms", "score", "place")


def package_metadata(results: DataFrame, by: str, versions: tuple[str, ...], most: int = 20) -> DataFrame:
    """Of each package the versions that all of its results agree in (null where they differ), and how many entries fit."""
    agreed = [F.when(F.count_distinct(v) == 1, F.max(v)).alias(v) for v in versions]
    rows = results.groupBy(by).agg(*agreed, F.count("*").alias("requested")).withColumn("accepted", F.least("requested", F.lit(most)))
    return rows.withColumn("discarded", F.col("requested") - F.col("accepted")).withColumn("utilisation", F.col("accepted") / most)


def two_packages(items: DataFrame) -> DataFrame:
    """question, evidence selected and found on the left and on the right, and whether both sides have any: each side (question, side, item_id, kind,
    order_key) is a package of its own, with a budget of its own."""
    chosen = select_items(items.withColumn("request_id", F.struct("question", "side")))
    count = lambda side, which: F.count_if((F.col("side") == side) & which)
    rows = chosen.groupBy("question").agg(*(count(s, F.col("selected")).alias(f"{s}_evidence") for s in ("left", "right")), *(count(s, F.lit(True)).alias(f"{s}_found") for s in ("left", "right")))
    return rows.withColumn("both_sides", (F.col("left_evidence") > 0) & (F.col("right_evidence") > 0))


def diagnostics(queries: DataFrame, nodes: DataFrame, matches: DataFrame, generation: int, limit: int = 20) -> DataFrame:
    """Of each query: what was asked, the strategies tried and the one that decided, how many assets were examined, matched and returned, and of which
    generation the graph was."""
    of_project = nodes.where("node_kind = 'engineering_asset' and state = 'active'").groupBy("project_id").agg(F.count("*").alias("examined"))
    matched = matches.groupBy("query_id").agg(F.count("*").alias("matched"), F.min("precedence").alias("first"))
    names = F.create_map(*(F.lit(x) for pair in STRATEGIES for x in pair))
    rows = queries.join(of_project, "project_id", "left").join(matched, "query_id", "left").fillna(0, ["examined", "matched"])
    return rows.select(
        "query_id", fold(F.col("designation")).alias("normalised"), F.lit(",".join(n for _, n in STRATEGIES)).alias("strategies"), names[F.col("first")].alias("decided_by"), "examined", "matched", F.least("matched", F.lit(limit)).alias("returned"), F.lit(generation).cast("long").alias("generation")
    )
