"""Bills of materials: their stable id, their counters, and what is wrong with the references that they hold."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.operators.context import requirement

#: Digits of a stable id.
DIGITS = 16


def stable_ids(items: DataFrame, finals: DataFrame, key: str, order: str = "context_id") -> DataFrame:
    """Per key the id of its bill: SHA-256 over the id and text of each item in order, then the final text; 16 digits.

    ``items`` has key, context_id and text, ``finals`` key and text. Each id and each item's text ends with a zero byte. Null ids
    and texts count as empty; a key without items or without a final text has an id all the same; of several final texts of a
    key the last in order counts; equal places are ordered by id and text. Keys that are null form one group.

    Rows of a key come to one task in order, which feeds them to a running digest and keeps none: a digest can't be taken in
    parts, but a key may be of any size.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    name = F.coalesce(F.col("context_id").cast("string"), F.lit(""))
    listed = items.select(F.col(key), F.lit(False).alias("_final"), F.col(order).alias("_place"), name.alias("_name"), text.alias("_text"))
    last = finals.groupBy(key).agg(F.max(text).alias("_text")).select(key, F.lit(True).alias("_final"), F.lit(None).cast(listed.schema["_place"].dataType).alias("_place"), F.lit("").alias("_name"), "_text")
    # the key as text, for it to survive a trip through pandas with nulls
    rows = listed.unionByName(last).withColumn("_key", F.to_json(F.struct(key), {"ignoreNullFields": "false"}))
    rows = rows.repartition("_key").sortWithinPartitions("_key", "_final", "_place", "_name", "_text").select("_key", "_final", "_name", "_text")

    def digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, digest = None, None
        for frame in frames:
            done = []
            for k, final, own, said in zip(frame["_key"], frame["_final"], frame["_name"], frame["_text"]):
                if k != open_key:
                    if digest is not None:
                        done.append((open_key, digest.hexdigest()[:DIGITS]))
                    open_key, digest = k, hashlib.sha256()
                digest.update(said.encode("utf-8", "replace") if final else b"%b\0%b\0" % (own.encode("utf-8", "replace"), said.encode("utf-8", "replace")))
            yield pd.DataFrame(done, columns=["_key", "bill_id"])
        if digest is not None:
            yield pd.DataFrame([(open_key, digest.hexdigest()[:DIGITS])], columns=["_key", "bill_id"])

    found = rows.mapInPandas(digests, "_key string, bill_id string")
    kind = items.schema[key].dataType.simpleString()
    return found.select(F.from_json("_key", f"`{key}` {kind}")[key].alias(key), "bill_id")


def headers(classified: DataFrame, finals: DataFrame, violations: DataFrame, key: str) -> DataFrame:
    """Per key the head of a compiled bill: its id, five counters over its items, and the boundary verdict of its final text.

    ``violations`` has a row with the key for each violation in the final text. The items, their requirements and the
    violations themselves stay rows (``context.classify``, ``transforms``, ``scan``), as a bill may have any number of them.
    """
    counted = classified.groupBy(F.col(key).alias("_counted")).agg(
        F.count(F.lit(1)).alias("total_context_items"), F.count_if("can_influence_output").alias("can_influence_output"), F.count_if("can_appear_in_final_prose").alias("can_appear_in_final_prose"),
        F.count_if(F.col("audit_status") == "audit_only").alias("audit_only"), F.count_if(F.col("audit_status") == "excluded").alias("excluded"),
    )
    found = violations.groupBy(F.col(key).alias("_found")).agg(F.count(F.lit(1)).alias("violations"))
    ids = stable_ids(classified, finals, key)
    # null keys are a group, too
    whole = ids.join(counted, ids[key].eqNullSafe(counted["_counted"]), "left").join(found, ids[key].eqNullSafe(found["_found"]), "left")
    numbers = [*counted.columns[1:], "violations"]
    whole = whole.fillna(0, numbers)
    return whole.select(key, "bill_id", *numbers, F.when(F.col("violations") > 0, "blocked").otherwise("pass").alias("verdict"))


def transforms(classified: DataFrame, key: str) -> DataFrame:
    """The requirement of each item that may influence the output."""
    said = requirement(F.col("text"), F.col("allowed_transformation"), F.col("can_influence_output"))
    return classified.where("can_influence_output").select(key, "context_id", F.col("allowed_transformation").alias("kind"), said.alias("text"))


def _listed(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ", ")


def problems(inputs: DataFrame, transformations: DataFrame, claims: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """what is wrong with the references of each bill: key, stage, owner, error.

    ``inputs`` (key, context_id, admitted), ``transformations`` (key, transform_id, input_ids), ``claims`` (key, claim_id,
    support_ids), ``overrides`` (key, override_id, context_id). References of a transformation (stage 0) and of a claim (1) must
    be known inputs of their bill; a claim's must be admitted as well, and only where all of them are known the blocked ones are
    named. An override (2) names a known input and has an id. An id that a bill has several times is admitted if one of them is.
    A null reference is unknown; null lists are empty; rows with a null key belong to one bill.
    """
    known = inputs.groupBy(F.col(key).alias("_bill"), F.col("context_id").alias("_ref")).agg(F.bool_or(F.coalesce("admitted", F.lit(False))).alias("_admitted"))

    def owned(rows: DataFrame, stage: int, owner: str, refs: Column) -> DataFrame:
        return rows.select(F.col(key), F.lit(stage).alias("stage"), F.col(owner).cast("string").alias("owner"), refs.alias("_refs"))

    lists = owned(transformations, 0, "transform_id", F.col("input_ids")).unionByName(owned(claims, 1, "claim_id", F.col("support_ids")))
    each = lists.distinct().select("*", F.posexplode("_refs").alias("_at", "_ref"))  # repeated rows say the same
    by = lambda rows: rows[key].eqNullSafe(known["_bill"]) & (rows["_ref"] == known["_ref"])
    judged = each.join(known, by(each), "left").select(key, "stage", "owner", "_refs", "_at", each["_ref"], "_admitted")
    wrong = judged.where(F.col("_admitted").isNull() | (F.col("stage") == 1) & ~F.col("_admitted"))
    named = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("_at", F.coalesce(F.col("_ref").cast("string"), F.lit("null")).alias("r"))))), lambda x: x["r"])
    lines = wrong.groupBy(key, "stage", "owner", "_refs").agg(named(F.col("_admitted").isNull()).alias("unknown"), named(F.col("_admitted").isNotNull()).alias("blocked"))
    who = F.coalesce(F.col("owner"), F.lit(""))
    said = F.when(F.col("stage") == 0, F.concat(F.lit("transformation "), who, F.lit(" references unknown context input(s): "), _listed(F.col("unknown"))))
    said = said.when(F.size("unknown") > 0, F.concat(F.lit("claim "), who, F.lit(" references unknown support input(s): "), _listed(F.col("unknown"))))
    said = said.otherwise(F.concat(F.lit("claim "), who, F.lit(" references blocked support input(s): "), _listed(F.col("blocked"))))
    listed = lines.select(key, "stage", "owner", said.alias("error"))

    named_by = overrides.select(F.col(key), F.coalesce(F.col("override_id").cast("string"), F.lit("")).alias("owner"), F.col("context_id").alias("_ref")).distinct()
    met = named_by.join(known, by(named_by), "left").select(key, "owner", named_by["_ref"], "_admitted")
    place = F.coalesce(F.col("_ref").cast("string"), F.lit("null"))
    fault = F.when(F.col("_admitted").isNull(), F.concat(F.lit("classification override "), F.col("owner"), F.lit(" references unknown context_id: "), place))
    fault = fault.when(F.col("owner") == "", F.concat(F.lit("classification override for context_id "), place, F.lit(" has empty override_id")))
    return listed.unionByName(met.select(key, F.lit(2).alias("stage"), "owner", fault.alias("error")).where("error is not null"))


def built(inputs: DataFrame, transformations: DataFrame, claims: DataFrame, findings: DataFrame, overrides: DataFrame, override_refs: DataFrame, key: str) -> DataFrame:
    """Per key the eight counters of a built bill, its number of errors, and the first of them, by stage, owner and text.

    A bill with an error isn't valid; who wants to stop at the first one raises ``error``.
    """
    counters = {
        "context_inputs": inputs.select(key, F.lit(1).alias("n")), "admitted_material": inputs.select(key, F.coalesce("admitted", F.lit(False)).cast("int").alias("n")),
        "blocked_material": inputs.select(key, (~F.coalesce("admitted", F.lit(False))).cast("int").alias("n")), "transformations": transformations.select(key, F.lit(1).alias("n")),
        "claims": claims.select(key, F.lit(1).alias("n")), "review_findings": findings.select(key, F.lit(1).alias("n")),
        "classification_overrides": overrides.select(key, F.lit(1).alias("n")), "override_ledger_refs": override_refs.select(key, F.lit(1).alias("n")),
    }
    wrong = problems(inputs, transformations, claims, overrides, key)
    none = F.lit(None).cast("struct<stage:int,owner:string,error:string>")
    rows = None
    for i, (_, part) in enumerate(counters.items()):
        part = part.select(key, F.lit(i).alias("_which"), "n", none.alias("_e"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.unionByName(wrong.select(key, F.lit(len(counters)).alias("_which"), F.lit(1).alias("n"), F.struct("stage", "owner", "error").alias("_e")))
    total = lambda i: F.coalesce(F.sum(F.when(F.col("_which") == i, F.col("n").cast("long"))), F.lit(0).cast("long"))
    return rows.groupBy(key).agg(*[total(i).alias(n) for i, n in enumerate(counters)], total(len(counters)).alias("errors"), F.min("_e")["error"].alias("error"))
