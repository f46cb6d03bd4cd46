"""Context items: classes and what they admit, derived requirements, the writer's pack, bills of materials and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import claims as C
from claimloom.functions import rules as R


def dimension(spark: SparkSession) -> DataFrame:
    """The eleven context classes with their attributes."""
    return spark.createDataFrame(R.CONTEXT_DIMENSION, "context_type string, ledger_bucket string, can_influence_output boolean, can_appear_in_final_prose boolean, allowed_transformation string, audit_status string, writer_admitted boolean")


def agent_name(name: Column) -> Column:
    """P20: lower case, runs of hyphens, underscores and spaces as one hyphen."""
    return F.regexp_replace(F.lower(F.trim(name)), r"(?U)[-_\s]+", "-")


def is_review_output(text: Column, agent: Column) -> Column:
    """by a registered review agent, or with two of four signals in the text."""
    signals = sum((C.matches(text, r).cast("int") for r in R.REVIEW_SIGNALS[1:]), C.matches(text, R.REVIEW_SIGNALS[0]).cast("int"))
    return F.coalesce(agent_name(agent).isin(list(R.REVIEW_ROLES)), F.lit(False)) | (signals >= 2)


def context_type(text: Column, agent: Column) -> Column:
    """the class of a context item; the first test that holds decides."""
    return F.when(is_review_output(text, agent), "review_finding").otherwise(C.first_of(text, R.CONTEXT_CLASSES, "synthesised_judgement"))


def classify(items: DataFrame) -> DataFrame:
    """Items (context_id, text, source_agent) with class and attributes."""
    kind = context_type(F.coalesce(F.col("text"), F.lit("")), F.col("source_agent"))
    return items.withColumn("context_type", kind).join(F.broadcast(dimension(items.sparkSession)), "context_type")


def reclassify(classified: DataFrame, overrides: DataFrame) -> DataFrame:
    """items with the class of a valid override (context_id, override_id, target_class), and what is wrong with others.

    Of several overrides of one item the valid one of the largest id counts, or, if none is valid, the one of the largest id.
    """
    targets = ("private_reasoning", "synthesised_judgement", "review_finding", "operational_trace")
    named = overrides.select("context_id", "override_id", "target_class")
    problem = F.when(F.trim(F.coalesce("override_id", F.lit(""))) == "", "override id is empty").when(~F.coalesce(F.col("target_class").isin(list(targets)), F.lit(False)), "target class is not allowed")
    each = F.struct(problem.isNull().alias("valid"), F.col("override_id"), F.col("target_class"))
    named = named.groupBy("context_id").agg(F.max(each).alias("_o")).select("context_id", "_o.override_id", "_o.target_class", F.lit(True).alias("_said"))
    known = dimension(classified.sparkSession)
    base = classified.drop(*[c for c in known.columns if c != "context_type"])
    joined = base.join(named, "context_id", "left").withColumn("override_error", F.when(F.col("_said"), problem)).drop("_said")
    kind = F.when(F.col("target_class").isNotNull() & F.col("override_error").isNull(), F.col("target_class")).otherwise(F.col("context_type"))
    return joined.withColumn("context_type", kind).join(F.broadcast(known), "context_type")


def requirement(text: Column, transformation: Column, influences: Column) -> Column:
    """The instruction that an item becomes."""
    lower = F.lower(text)
    commercial = F.when(F.contains(lower, F.lit("commercial")), R.REQUIREMENT_COMMERCIAL)
    prior = F.contains(lower, F.lit("previous version")) | F.contains(lower, F.lit("prior version")) | F.contains(lower, F.lit("previous draft"))
    parts = F.concat_ws("; ", commercial, F.when(prior, R.REQUIREMENT_STANDALONE))
    feedback = F.concat(F.when(parts == "", F.lit(R.REQUIREMENT_OTHER)).otherwise(parts), F.lit("."))
    out = None
    for kind, said in R.REQUIREMENTS.items():
        out = F.when(transformation == kind, said) if out is None else out.when(transformation == kind, said)
    return out.when(~influences, R.REQUIREMENT_EXCLUDED).otherwise(feedback)


def requirements(classified: DataFrame) -> DataFrame:
    """context_id, kind and text of each item's requirement."""
    return classified.select("context_id", F.col("allowed_transformation").alias("kind"), requirement(F.col("text"), F.col("allowed_transformation"), F.col("can_influence_output")).alias("requirement"))


#: Sections of the writer's pack by context class.
PACK_SECTIONS = {
    "empirical_evidence": "evidence",
    "style_signal": "style",
    "instruction": "instructions",
    "validation_rule": "banned",
    "user_feedback": "requirements",
    "review_finding": "requirements",
    "prior_artefact": "requirements",
    "process_history": "requirements",
    "synthesised_judgement": "requirements",
}


def writer_pack(classified: DataFrame, key: str, acceptance: tuple[str, ...] = (), banned: tuple[str, ...] = ()) -> DataFrame:
    """Per key the texts of admitted items by section, in the order of context_id, and the number of others.

    ``brief`` has instructions and requirements together. Validation rules become banned expressions, after those that are
    always banned; ``acceptance`` and ``banned`` add to what is always asked for and banned.
    """
    section = F.create_map(*[F.lit(x) for pair in PACK_SECTIONS.items() for x in pair])[F.col("context_type")]
    rows = classified.withColumn("section", F.when(F.col("writer_admitted"), section))
    said = requirement(F.col("text"), F.col("allowed_transformation"), F.col("can_influence_output"))
    said = F.when(F.col("section") == "evidence", F.col("text")).when(F.col("context_type") == "instruction", F.trim("text")).otherwise(said)
    texts = lambda *s: F.transform(F.array_sort(F.collect_list(F.when(F.col("section").isin(*s), F.struct("context_id", said.alias("text"))))), lambda x: x["text"])
    fixed = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    return rows.groupBy(key).agg(
        texts("evidence").alias("evidence"), texts("style").alias("style"), texts("instructions").alias("instructions"), texts("requirements").alias("requirements"),
        texts("instructions", "requirements").alias("brief"), F.concat(fixed(R.BANNED_RESIDUE), texts("banned"), fixed(banned)).alias("banned"),
        fixed((*R.ACCEPTANCE_TESTS, *acceptance)).alias("acceptance"), F.count_if(F.col("section").isNull()).alias("excluded"),
    )


def bill_summary(classified: DataFrame, claims: DataFrame, key: str) -> DataFrame:
    """Per key the counters of a bill of materials over items and claims (key, citation)."""
    items = classified.groupBy(key).agg(F.count(F.lit(1)).alias("inputs"), F.count_if("writer_admitted").alias("admitted"), F.count_if(F.col("ledger_bucket") == "excluded").alias("blocked"))
    cited = claims.groupBy(key).agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("citation").isNotNull()).alias("supported"))
    zero = ["inputs", "admitted", "blocked", "claims", "supported"]
    return items.join(cited, key, "full").fillna(0, zero)


def reference_errors(inputs: DataFrame, references: DataFrame) -> DataFrame:
    """References (owner, kind, context_id) to unknown inputs, or as support to inputs that aren't admitted."""
    known = inputs.groupBy("context_id").agg(F.bool_or(F.coalesce("writer_admitted", F.lit(False))).alias("admitted"))  # an id may occur twice
    joined = references.join(known, "context_id", "left")
    error = F.when(F.col("admitted").isNull(), F.concat(F.lit("unknown_"), F.col("kind"))).when((F.col("kind") == "support") & ~F.col("admitted"), "blocked_support")
    return joined.withColumn("error", error).where("error is not null").select("owner", "kind", "context_id", "error")


def bill_inputs(classified: DataFrame) -> DataFrame:
    """Items as inputs of a bill of materials: admitted if they may appear or are to be transformed; why they aren't free."""
    appears = F.col("can_appear_in_final_prose")
    status = F.col("audit_status")
    reason = F.when(status == "audit_only", R.INPUT_REASONS["audit_only"]).when(status == "excluded", R.INPUT_REASONS["excluded"]).when(~appears, R.INPUT_REASONS["process"]).otherwise("")
    return classified.select("context_id", (appears | (F.col("allowed_transformation") != "none")).alias("admitted"), reason.alias("reason"))


def identity_problems(actors: DataFrame) -> DataFrame:
    """F16: rows (key, roles map<string,string>) with the missing, unknown and empty roles of each, sorted."""
    names = F.map_keys("roles")
    required = F.array(*[F.lit(r) for r in R.ACTOR_ROLES])
    return actors.select(
        "key",
        F.array_sort(F.array_except(required, names)).alias("missing"),
        F.array_sort(F.array_except(names, required)).alias("unknown"),
        F.array_sort(F.map_keys(F.map_filter("roles", lambda k, v: F.trim(F.coalesce(v, F.lit(""))) == ""))).alias("empty"),
    )
