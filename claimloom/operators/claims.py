"""Claims of documents: a row per sentence, per claim, or per document."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.functions import claims as C
from claimloom.functions.tables import join_left, once_a_batch
from claimloom.functions.text import sentences, truncate


def sentence_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Key, pos, sentence and the next sentence ("" after the last).

    The next sentence comes from the array before it is exploded, so no shuffle is needed.
    """
    found = docs.select(key, sentences(F.coalesce(F.col("text"), F.lit(""))).alias("_s"))
    pairs = F.transform("_s", lambda s, i: F.struct(s.alias("sentence"), F.coalesce(F.get("_s", i + 1), F.lit("")).alias("following")))
    return found.select(key, F.posexplode(pairs).alias("pos", "_p")).select(key, "pos", "_p.sentence", "_p.following")


def claims_with(rows: DataFrame, **columns: Column) -> DataFrame:
    """The claims among sentences, with columns made of the sentence alone: made once for all that are equal in a batch."""
    found = once_a_batch(rows, "sentence").where(C.any_of(F.col("sentence"), C.R.CLAIM_TRIGGERS))
    made = found.select("sentence", "places", *[c.alias(n) for n, c in columns.items()])
    return made.select("sentence", *columns, F.explode("places").alias("_p")).select("_p.*", "sentence", *columns)


def claim_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row per claim: key, pos, trigger, status and snippet."""
    s = F.col("sentence")
    rows = sentence_rows(docs, key).select(key, "pos", "sentence", C.leads_citation(F.col("following")).alias("_led"))
    found = claims_with(rows, trigger=C.first_trigger(s), status=C.claim_status(s, F.lit("")), snippet=truncate(s, 220))
    return found.select(key, "pos", "trigger", F.when(F.col("_led"), "supported").otherwise(F.col("status")).alias("status"), "snippet")


def status_totals(claims: DataFrame, key: str = "doc_id") -> DataFrame:
    """A1: claims per key by status."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return claims.groupBy(key).agg(F.count(F.lit(1)).alias("total"), count("supported"), count("tagged"), count("unsupported"))


def pipeline_claims(docs: DataFrame, key: str = "doc_id", **more: Column) -> DataFrame:
    """A row per claim: sentence, triggers, citation, salience and load_bearing, and ``more`` made of the sentence."""
    s = F.col("sentence")
    rows = claims_with(sentence_rows(docs, key).select(key, "pos", "sentence"), triggers=C.triggers(s), citation=C.citation(s), salience=C.salience(s), **more)
    return rows.select(key, "pos", "sentence", "triggers", "citation", "salience", (F.col("salience") >= C.R.LOAD_BEARING).alias("load_bearing"), *more)


def claims_in(text: Column) -> Column:
    """The claims of a text in order, in place: an array of (pos, sentence, citation, salience, load_bearing).

    What ``pipeline_claims`` gives as rows, for work that needs no row per claim.
    """
    found = F.transform(sentences(F.coalesce(text, F.lit(""))), lambda s, i: F.when(C.any_of(s, C.R.CLAIM_TRIGGERS), F.struct(i.alias("pos"), s.alias("sentence"))))
    rated = F.transform(F.array_compact(found), lambda x: x.withField("citation", C.citation(x["sentence"])).withField("salience", C.salience(x["sentence"])))
    return F.transform(rated, lambda x: x.withField("load_bearing", x["salience"] >= C.R.LOAD_BEARING))


def select_claims(rows: DataFrame, mode: str, keep: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """sentences kept by a filter relation: ``off`` rules only, ``on`` rules and filter, ``only`` filter only."""
    if mode not in ("on", "only") or keep is None:
        return rows.where(F.size("triggers") > 0)
    kept = rows.join(keep.select(key, "pos").distinct(), [key, "pos"], "left_semi")
    if mode == "on":
        return kept.where(F.size("triggers") > 0)
    return kept.withColumn("triggers", F.when(F.size("triggers") == 0, F.array(F.lit("llm"))).otherwise(F.col("triggers")))


def budgeted(claims: DataFrame, salience_min: float, max_claims: int, key: str = "doc_id") -> DataFrame:
    """Per document the most salient claims, ties in order of place; ``max_claims`` 0 keeps all."""
    fit = claims.where(F.col("salience") >= salience_min)
    if not max_claims:
        return fit
    ranked = fit.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("salience"), "pos")))
    return ranked.where(F.col("rank") <= max_claims)


def skipped_summary(claims: DataFrame, salience_min: float, max_claims: int, key: str = "doc_id", docs: DataFrame | None = None) -> DataFrame:
    """Per document how many claims ``budgeted`` leaves out, why, and the first three below the salience asked for.

    Documents (``docs``) without a claim get a row that says so.
    """
    low = F.col("salience") < salience_min
    counts = claims.groupBy(key).agg(F.count_if(low).alias("_low"), F.count_if(~low).alias("_fit"), F.array_sort(F.collect_list(F.when(low, F.struct("pos", F.substring("sentence", 1, 80).alias("s"))))).alias("_e"))
    over = F.greatest(F.lit(0), F.col("_fit") - F.lit(max_claims)) if max_claims else F.lit(0)
    reason = F.concat_ws(
        "; ", F.when(F.col("_low") > 0, F.format_string(f"salience_min={salience_min:.2f} (%d skipped)", "_low")), F.when(over > 0, F.format_string(f"max_verify_claims={max_claims} (%d skipped)", over))
    )
    examples = F.transform(F.slice("_e", 1, 3), lambda x: x["s"])
    found = counts.select(key, F.when(reason == "", "no_caps_applied").otherwise(reason).alias("reason"), (F.col("_low") + over).cast("long").alias("count"), examples.alias("examples"))
    if docs is None:
        return found
    none = {"reason": F.lit("no_claims_detected"), "count": F.lit(0).cast("long"), "examples": F.array().cast("array<string>")}
    return join_left(docs.select(key).distinct(), found, key).select(key, *[F.coalesce(c, v).alias(c) for c, v in none.items()])


def worst(rows: DataFrame, limit: int = 10) -> DataFrame:
    """The worst verdicts (id, verdict): contradicted, unverifiable, not addressed, then the others, by place."""
    rank = F.coalesce(*[F.when(F.col("verdict") == v, i) for i, v in enumerate(C.R.WORST_ORDER)], F.lit(len(C.R.WORST_ORDER)))
    return rows.select("id", "verdict", rank.alias("rank")).orderBy("rank", "id").limit(limit)


def listed(rows: DataFrame, most: int = C.R.MOST_LISTED, key: str = "doc_id") -> DataFrame:
    """The places of a document's first claims, and how many more there are."""
    found = rows.groupBy(key).agg(F.array_sort(F.collect_list("pos")).alias("p"))
    first = F.array_join(F.transform(F.slice("p", 1, most), lambda x: x.cast("string")), ",")
    more = F.size("p") - most
    return found.select(key, F.concat(first, F.when(more > 0, F.concat(F.lit(" ... and "), more, F.lit(" more."))).otherwise("")).alias("listed"))


def graded(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Each claim with the text of the source that it cites (columns url, source_text) and its grade.

    A url that several rows have stands for the longest of their texts, the last in order of equally long ones.
    """
    one = sources.where("url is not null").groupBy("url").agg(F.max_by("source_text", F.struct(F.length("source_text"), "source_text")).alias("source_text"))
    joined = claims.join(one, claims["citation"] == one["url"], "left")
    grade = C.heuristic_grade(F.col("sentence"), F.col("source_text"), F.col("citation"))
    return joined.select(*claims.columns, grade.alias("verdict"), F.when(grade == "not_addressed", C.missing_tokens(F.col("sentence"), F.col("source_text"))).alias("missing"))


def graded_by(claims: DataFrame, grader, schema: str = "doc_id long, pos long, verdict string, confidence double, rationale string") -> DataFrame:
    """Grade with a callable of one pandas frame of claims; batches go to it as they are, on the executors."""

    def run(frames):
        for frame in frames:
            yield grader(frame)

    return claims.mapInPandas(run, schema)


# fixed values: names that a grader may be asked for by
GRADER_NAMES = {"heuristic": "heuristic", "local": "local", "local-llm": "local", "llm": "llm", "anthropic": "llm", "claude": "claude-cli", "claude-cli": "claude-cli", "codex": "codex"}


def grader_choice(wanted: str | None = None, local_url: str | None = None, local_answers: bool = False, api_key: str | None = None, has_cli: bool = False) -> str:
    """The grader to begin with: the one that was asked for by a known name, else a local one, one with a key, one of the
    command line, and else the heuristic; ``codex`` only if asked for."""
    asked = GRADER_NAMES.get((wanted or "").strip().lower())
    offered = (("local", local_url), ("local", local_answers), ("llm", api_key), ("claude-cli", has_cli))
    return asked or next((name for name, there in offered if there), "heuristic")


def graded_in_turn(claims: DataFrame, graders: Sequence[tuple[str, Callable]], text: str = "sentence", source: str = "source_text", citation: str = "citation") -> DataFrame:
    """Claims with verdict, confidence, rationale and the name of the grader that gave them.

    A grader is a callable of a pandas frame of claims with their ``_row``; it answers with ``_row``, verdict, confidence and
    rationale. A batch goes to the first grader; what it leaves out, answers without a verdict, or all of the batch if it fails,
    goes to the next one, and what no grader answers gets the heuristic grade, made by Spark beforehand. So no claim is lost
    and none comes twice, whatever a grader answers; of several answers for a row the first counts. All in one pass, without a shuffle.
    """
    taken = {"_row", "_own", "verdict", "confidence", "rationale", "grader"} & set(claims.columns)
    if taken:
        raise ValueError(f"columns that grading adds are there already: {', '.join(sorted(taken))}")
    own = C.heuristic_grade(F.col(text), F.col(source), F.col(citation))
    answer = ["verdict", "confidence", "rationale"]

    def asked(frame, name, grader):
        """Rows that a grader has an answer for, by their places."""
        said = grader(frame.drop(columns="_own"))[["_row", *answer]]
        said = said[said["verdict"].notna() & said["_row"].isin(frame["_row"])].drop_duplicates("_row").set_index("_row")
        return said.assign(grader=name)

    def run(frames):
        for frame in frames:
            frame = frame.reset_index(drop=True)
            frame["_row"] = frame.index
            found = frame[["_own"]].rename(columns={"_own": "verdict"}).assign(confidence=None, rationale=None, grader="heuristic").astype(object)
            left = frame
            for name, grader in graders:
                if left.empty:
                    break
                try:
                    said = asked(left.copy(), name, grader)
                except Exception:  # noqa: BLE001  a grader may fail in any way; the next one has its turn
                    continue
                found.loc[said.index, [*answer, "grader"]] = said.astype(object)
                left = left[~left["_row"].isin(said.index)]
            yield frame.drop(columns=["_row", "_own"]).join(found)

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in claims.schema.fields)
    return cleaned_grades(claims.withColumn("_own", own).mapInPandas(run, fields + "verdict string, confidence double, rationale string, grader string"))


def cleaned_grades(raw: DataFrame) -> DataFrame:
    """What a grader answered: unknown verdicts are errors, confidence is clamped, the rationale cut."""
    verdict = F.when(F.col("verdict").isin(list(C.R.GRADES)), F.col("verdict")).otherwise("error")
    return raw.withColumns({"verdict": verdict, "confidence": F.when(F.col("confidence").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))), "rationale": F.substring("rationale", 1, 200)})


def axis1_of(verdict: Column) -> Column:
    """A grade as supported, tagged or unsupported."""
    return F.when(verdict == "verified", "supported").when(verdict == "skipped", "tagged").otherwise("unsupported")
