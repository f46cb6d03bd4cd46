"""The ledger of runs, claims, verifications, overrides and tombstones: append-only tables and what is read from them."""

from __future__ import annotations

import uuid
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.functions import claims as C
from claimloom.functions import rules as R
from claimloom.functions.text import canonical_json, parse_timestamp
from claimloom.operators.commits import CommitLog

#: The tables of a ledger.
SCHEMAS = {
    "runs": "id long, ts string, session_id string, source_event string, file_path string, mode string, total int, supported int, tagged int, unsupported int, retention_window_days int, prev_run_hash string, run_content_hash string",
    "claims": "id long, run_id long, ts string, session_id string, status string, trigger string, claim_text string",
    "verifications": "id long, claim_id long, ts string, citation string, verdict string, confidence double, rationale string, grader string",
    "context_items": "id long, ts string, context_id string, context_type string, ledger_bucket string, can_influence_output boolean, can_appear_in_final_prose boolean, allowed_transformation string, audit_status string, raw_text string",
    "context_transforms": "id long, context_row_id long, ts string, run_id string, kind string, transform_text string",
    "cbom_runs": "id long, ts string, cbom_id string, artefact string, artefact_role string, summary_json string",
    "review_findings": "id long, ts string, review_pack_id string, reviewer string, angle string, finding_id string, severity string, confidence string, evidence string, recommended_action string, status string",
    "boundary_violations": "id long, ts string, artefact string, rule_id string, severity string, matched_text string",
    "overrides": "id long, ts string, run_id string, reviewer string, gate_id string, failure_class string, risk_accepted string, compensating_control string, escalation_path_taken string, single_actor boolean",
    "tombstones": "id long, ts string, run_id long, reason string, retention_window_days int, expired_after string",
    "retention_windows": "id long, ts string, run_id long, retention_window_days int",
}
# fixed values: escalation paths that are taken as they are; any other is marked as custom
ESCALATION_PATHS = (
    "none recorded",
    "peer_review",
    "director_signoff",
    "executive_signoff",
    "cabinet_office",
    "legal_review",
    "second_coder_review",
    "external_auditor",
)


# fixed value: the reason of a tombstone that gives none
ELAPSED = "retention_window_elapsed"

#: Counts of a run, 0 where they aren't given.
COUNTED = ("total", "supported", "tagged", "unsupported")


def fields_of(name: str) -> list[str]:
    """A table's columns after its id."""
    return [c.split()[0] for c in SCHEMAS[name].split(", ")][1:]


class Ledger:
    """A folder with a Parquet table per name and a log of commits. Rows are only ever appended.

    A commit's rows are written first, with their places in the commit; its version in the log then says from which id they
    count on, which hash the first run of it follows, and which runs its claims belong to. All that a reader sees is read through
    the log: a commit's tables appear together, one that fails leaves nothing, and of two writers that meet the second
    takes the ids after the first one's without writing its rows again.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.log = CommitLog(spark, f"{self.folder}/_log")

    @staticmethod
    def tables() -> list[str]:
        """K3: the tables, all of which are append-only."""
        return list(SCHEMAS)

    def read(self, name: str, entries: list[dict] | None = None) -> DataFrame:
        """A table as of the last commit (or of the given ones); one that was never written is empty."""
        parts = [(e["tables"][name], e["version"]) for e in (self.log.entries() if entries is None else entries) if name in e["tables"]]
        if not parts:
            return self.spark.createDataFrame([], SCHEMAS[name])
        fields = [f for f in self.spark.createDataFrame([], SCHEMAS[name]).schema if f.name != "id"]
        stored = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), "_part int, _row long, commit string"])
        rows = self.spark.read.schema(stored).option("basePath", f"{self.folder}/{name}").parquet(*[f"{self.folder}/{name}/commit={t['commit']}" for t, _ in parts])
        places = [(t["commit"], part, t["base"] + before, t.get("run_base", 0), bool(t.get("chained")) and before == 0, t.get("before")) for t, _ in parts for part, before in t["parts"]]
        joined = rows.join(self.spark.createDataFrame(places, "commit string, _part int, _base long, _run_base long, _begins boolean, _hash string"), ["commit", "_part"])
        out = joined.withColumn("id", F.col("_base") + F.col("_row") + 1)
        if name == "claims":
            out = out.withColumn("run_id", F.col("run_id") + F.col("_run_base"))
        if name == "runs":
            out = out.withColumn("prev_run_hash", F.when(F.col("_begins") & (F.col("_row") == 0), F.col("_hash")).otherwise(F.col("prev_run_hash")))
        return out.select("id", *[f.name for f in fields])

    def batches(self) -> DataFrame:
        """The commits that came from streams: version, stream, batch, and what was noted of each (events, malformed, logged)."""
        rows = [(e["version"], *e["stream"], {k: int(v) for k, v in e.get("notes", {}).items()}) for e in self.log.entries() if e.get("stream")]
        return self.spark.createDataFrame(rows, "version long, stream string, batch long, notes map<string,long>")

    def has_batch(self, stream: tuple[str, int] | None, entries: list[dict] | None = None) -> bool:
        """Whether a stream's batch, or a later one, has been committed."""
        found = self.log.entries() if entries is None else entries
        return stream is not None and any(e.get("stream") and e["stream"][0] == stream[0] and e["stream"][1] >= stream[1] for e in found)

    def commit(self, staged: dict[str, dict], stream: tuple[str, int] | None = None, notes: dict | None = None) -> int | None:
        """Make staged rows part of the ledger: the version, or None if the stream's batch is there already."""
        while True:
            entries = self.log.entries()
            if self.has_batch(stream, entries):
                return None
            tables = {}
            for name, rows in staged.items():
                before = [e["tables"][name] for e in entries if name in e["tables"]]
                tables[name] = {**rows, "base": sum(t["count"] for t in before)}
                if rows.get("chained"):
                    tables[name]["before"] = next((t["last"] for t in reversed(before) if t["count"]), None)
            if "runs" in tables and "claims" in tables:
                tables["claims"]["run_base"] = tables["runs"]["base"]
            version = len(entries) + 1
            if self.log.put({"version": version, "tables": tables, "stream": list(stream) if stream else None, "notes": notes or {}}):
                return version

    def _placed(self, rows: DataFrame) -> DataFrame:
        at = F.monotonically_increasing_id()
        return rows.withColumn("_at", at).withColumns({"_part": F.shiftright("_at", 33).cast("int"), "_row": F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_at")

    def _sizes(self, path: str) -> list[tuple[int, int]]:
        """Of a staged folder, each range's number and the rows before it (a row per range)."""
        sizes = self.spark.read.parquet(path).groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
        ends = list(accumulate((r["n"] for r in sizes), initial=0))
        return [(r["_part"], before) for r, before in zip(sizes, ends)] + [(-1, ends[-1])]

    def _stage(self, name: str, rows: DataFrame) -> dict:
        """Write rows (in order, or with their places) for a commit to come."""
        commit = uuid.uuid4().hex
        path = f"{self.folder}/{name}/commit={commit}"
        (rows if "_row" in rows.columns else self._placed(rows)).write.parquet(path)
        *parts, (_, count) = self._sizes(path)
        return {"commit": commit, "parts": parts, "count": count}

    def _filled(self, name: str, rows: DataFrame, zero: tuple[str, ...] = ()) -> DataFrame:
        """The table's columns, those that are missing null (or 0), and the others after them."""
        fields = [f for f in self.spark.createDataFrame([], SCHEMAS[name]).schema if f.name != "id"]
        more = [c for c in rows.columns if c not in {"id", *(f.name for f in fields)}]
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(0 if f.name in zero else None)).cast(f.dataType).alias(f.name) for f in fields], *more)

    def _rows(self, name: str, rows: DataFrame, order: list[str] | None) -> DataFrame:
        filled = self._filled(name, rows)
        return (filled.orderBy(*order) if order else filled).select(*fields_of(name))

    def append(self, name: str, rows: DataFrame, order: list[str] | None = None) -> int:
        """K5: append rows in one commit; ids follow the largest there is, in the order of ``order``. Columns that are missing become null."""
        return self.commit({name: self._stage(name, self._rows(name, rows, order))})

    def _chain(self, rows: DataFrame, order: list[str]) -> tuple[dict, DataFrame, str]:
        """Staged runs, each with the hash of the one before it; the runs with their places (``_n``); and the folder that these are read from."""
        filled = self._filled("runs", rows, COUNTED).withColumn("mode", F.coalesce("mode", F.lit("default"))).withColumn("run_content_hash", content_hash())
        path = f"{self.folder}/_staged/{uuid.uuid4().hex}"
        self._placed(filled.orderBy(*order)).write.parquet(path)
        *parts, (_, count) = self._sizes(path)
        before = self.spark.createDataFrame(parts, "_part int, _before long")
        numbered = self.spark.read.parquet(path).join(before, "_part").withColumn("_n", F.col("_before") + F.col("_row") + 1).drop("_part", "_row", "_before")
        linked = previous(numbered, "_n", "run_content_hash").withColumn("prev_run_hash", F.col("_before"))
        staged = self._stage("runs", linked.select(*fields_of("runs"), F.lit(0).alias("_part"), (F.col("_n") - 1).alias("_row")))
        last = numbered.agg(F.max_by("run_content_hash", "_n").alias("hash")).first()["hash"]
        return {**staged, "chained": True, "last": last}, numbered, path

    def drop_staged(self, path: str) -> None:
        """Remove what was staged for a commit that is done."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def append_runs(self, rows: DataFrame, order: list[str]) -> int:
        """K4: append runs, each linked to the one before it by that one's content hash, the first to the ledger's last run."""
        staged, _, path = self._chain(rows, order)
        self.drop_staged(path)
        return self.commit({"runs": staged})

    def log_runs(self, runs: DataFrame, claims: DataFrame, key: str, order: list[str], stream: tuple[str, int] | None = None, notes: dict | None = None) -> int | None:
        """K1: append runs and their claims, which name their run by ``key``, in one commit; a batch that is there already is left out."""
        if self.has_batch(stream):
            return None
        staged, numbered, path = self._chain(runs, order)
        own = numbered.select(key, F.col("_n").alias("run_id"), F.col("ts"), F.col("session_id"))
        said = claims.drop("run_id", "ts", "session_id").join(own, key)
        rows = self._stage("claims", self._rows("claims", said, ["run_id", *(c for c in ("pos",) if c in said.columns)]))
        self.drop_staged(path)
        return self.commit({"runs": staged, "claims": rows}, stream, notes)

    def append_overrides(self, rows: DataFrame) -> int:
        """K6: overrides with every text filled in, one with an empty text fails the commit; unknown escalation paths are marked."""
        path = F.coalesce("escalation_path_taken", F.lit("none recorded"))
        marked = checked_overrides(rows).withColumn("escalation_path_taken", F.when(path.isin(list(ESCALATION_PATHS)), path).otherwise(F.concat(F.lit("custom:"), path)))
        return self.append("overrides", marked, ["ts", "run_id"])

    def append_windows(self, rows: DataFrame) -> int:
        """K7: set the retention windows of runs (ts, run_id, retention_window_days), null to keep a run; negative ones fail."""
        days = F.col("retention_window_days")
        kept = F.when(days < 0, F.raise_error(F.lit("a retention window is negative")).cast("int")).otherwise(days)
        return self.append("retention_windows", rows.withColumn("retention_window_days", kept), ["ts", "run_id"])

    def append_tombstones(self, rows: DataFrame) -> int:
        """K7: mark runs (ts, run_id, reason) as expired; window and end come from the run where the rows have none.

        Without a reason it is that the window is over; an empty one fails. Nothing is deleted, and a run may have several.
        """
        has = lambda c, kind: F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind)
        reason = F.trim(F.coalesce(has("reason", "string"), F.lit(ELAPSED)))
        given = rows.select(
            "ts", F.col("run_id").cast("long").alias("run_id"), has("retention_window_days", "int").alias("_days"), has("expired_after", "string").alias("_after"),
            F.when(reason == "", F.raise_error(F.lit("a tombstone has no reason")).cast("string")).otherwise(reason).alias("reason"),
        )
        own = effective_windows(self.read("runs"), self.read("retention_windows")).select(F.col("id").alias("run_id"), F.col("ts").alias("_ts"), "window_days")
        filled = given.join(own, "run_id", "left").withColumn("retention_window_days", F.coalesce("_days", "window_days"))
        after = F.coalesce(F.col("_after"), window_end(F.col("_ts"), F.col("retention_window_days")))
        return self.append("tombstones", filled.withColumn("expired_after", after), ["ts", "run_id"])


def window_end(ts: Column, days: Column) -> Column:
    """When a window of days that began at a time of ISO form is over, in that form."""
    return F.date_format(F.timestamp_add("DAY", days, parse_timestamp(ts)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def checked_overrides(rows: DataFrame) -> DataFrame:
    """Override rows as they are; the first with an empty text raises an error that names the column."""
    def filled(c: str) -> Column:
        return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.raise_error(F.lit(f"an override's {c} is empty")).cast("string")).otherwise(F.col(c))

    return rows.withColumns({c: filled(c) for c in ("run_id", "reviewer", "gate_id", "failure_class", "risk_accepted", "compensating_control")})


def debt_totals(runs: DataFrame, claims: DataFrame) -> DataFrame:
    """A2, A4: one row: runs, claims by status, load-bearing unsupported ones, and those per thousand claims."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    heavy = F.count_if((F.col("status") == "unsupported") & C.load_bearing(F.coalesce("claim_text", F.lit("")))).alias("load_bearing_unsupported")
    totals = claims.agg(F.count(F.lit(1)).alias("claims"), count("supported"), count("tagged"), count("unsupported"), heavy)
    both = runs.agg(F.count(F.lit(1)).alias("runs")).crossJoin(totals)  # two single rows
    debt = F.when(F.col("claims") > 0, F.col("load_bearing_unsupported") / F.col("claims") * 1000.0).otherwise(F.lit(0.0))
    return both.withColumn("debt_per_1000", debt)


def verification_counts(verifications: DataFrame) -> DataFrame:
    """A3: one row with the number of each known verdict; others don't count."""
    return verifications.agg(*[F.count_if(F.col("verdict") == g).alias(g) for g in R.GRADES])


def debt_trend(runs: DataFrame, last: int = 5) -> DataFrame:
    """One row: the direction of the unsupported share over the last runs, flat with fewer than two."""
    recent = runs.orderBy(F.desc("id")).limit(last)
    rate = F.when(F.col("total") > 0, F.col("unsupported") / F.col("total")).otherwise(F.lit(0.0))
    ends = recent.agg(F.count(F.lit(1)).alias("n_runs"), F.min_by(rate, "id").alias("first_rate"), F.max_by(rate, "id").alias("last_rate"))
    up, down = F.col("last_rate") > F.col("first_rate"), F.col("last_rate") < F.col("first_rate")
    return ends.withColumn("direction", F.when(F.col("n_runs") < 2, "flat").when(up, "up").when(down, "down").otherwise("flat"))


def latest(rows: DataFrame, key: str) -> DataFrame:
    """Of each key the row with the largest id."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "id").alias("_r")).select(key, "_r.*")


def evidence_matrix(claims: DataFrame, verifications: DataFrame) -> DataFrame:
    """Each claim with its latest verification, and its salience with two digits."""
    last = latest(verifications.where("claim_id is not null"), "claim_id").select(F.col("claim_id").alias("id"), "citation", "verdict", "grader")
    return claims.select("id", "run_id", "status", "trigger", "claim_text").join(last, "id", "left").withColumn("salience", F.format_number(C.salience(F.coalesce("claim_text", F.lit(""))), 2))


def effective_windows(runs: DataFrame, windows: DataFrame) -> DataFrame:
    """The retention window of each run: of its latest override, even if that is null, else its own."""
    last = latest(windows, "run_id").select(F.col("run_id").alias("id"), F.lit(True).alias("_set"), F.col("retention_window_days").alias("_days"))
    joined = runs.select("id", "ts", "retention_window_days").join(last, "id", "left")
    return joined.select("id", "ts", F.when(F.col("_set"), F.col("_days")).otherwise(F.col("retention_window_days")).alias("window_days"))


def expired_runs(runs: DataFrame, windows: DataFrame, tombstones: DataFrame, now: Column) -> DataFrame:
    """Runs without a tombstone whose window is over at ``now``, and since when."""
    live = effective_windows(runs, windows).join(tombstones.select(F.col("run_id").alias("id")).distinct(), "id", "left_anti")
    end = F.timestamp_add("DAY", F.col("window_days"), parse_timestamp(F.col("ts")))
    return live.where(F.col("window_days").isNotNull()).withColumn("_end", end).where(now > F.col("_end")).select("id", "ts", "window_days", window_end(F.col("ts"), F.col("window_days")).alias("expired_after"))


def overrides_by_run(overrides: DataFrame) -> DataFrame:
    """Per run the number of overrides, whether any had a single actor, and reviewers in order."""
    return overrides.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_overrides"), F.bool_or("single_actor").alias("single_actor"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "reviewer"))), lambda x: x["reviewer"]), ",").alias("reviewers"))


def single_actor_role(reviewer: Column, writer: Column, role: Column) -> Column:
    """The role ``draft`` for final prose whose reviewer is its writer."""
    same = F.lower(F.trim(reviewer)) == F.lower(F.trim(writer))
    return F.when(F.coalesce(same, F.lit(False)) & (role == "final-prose"), "draft").otherwise(role)


def override_footer(overrides: DataFrame, heading: str = R.OVERRIDE_HEADING) -> DataFrame:
    """Per run the Markdown footer on its overrides in the order of id, white space squashed; none without overrides."""
    one = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    head = F.concat(F.lit("- **Override ovr_"), "id", F.lit("** on gate **"), "gate_id", F.lit("** (failure: "), "failure_class", F.lit(")"), F.when(F.col("single_actor"), " (single-actor; artefact role downgraded)").otherwise(""))
    rows = (("Risk accepted", "risk_accepted"), ("Compensating control", "compensating_control"), ("Escalation", "escalation_path_taken"), ("Reviewer", "reviewer"), ("Recorded", "ts"))
    entry = F.concat_ws("\n", head, *[F.concat(F.lit(f"  - {label}: "), one(c)) for label, c in rows])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", entry.alias("entry")))), lambda x: x["entry"]), "\n\n")
    return overrides.groupBy("run_id").agg(F.concat(F.lit(f"\n## {heading.strip()}\n\n{R.OVERRIDE_LEAD}\n\n"), body, F.lit("\n\n")).alias("footer"))


#: Fields whose canonical JSON a run's hash covers, in alphabetical order.
HASHED = ("file_path", "mode", "session_id", "source_event", "supported", "tagged", "total", "ts", "unsupported")


def content_hash(**changed: Column) -> Column:
    """SHA-256 of a run's canonical JSON."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(F.struct(*[changed.get(c, F.col(c)).alias(c) for c in HASHED])), 256))


def previous(rows: DataFrame, place: str, value: str, span: int = 1 << 20) -> DataFrame:
    """Rows with the value of the row before each in the order of ``place``, and whether a row is the first of all.

    Rows are ordered within spans of places, each by itself; a row per span says what the next one begins after.
    """
    spanned = rows.withColumn("_span", F.floor(F.col(place) / span))
    within = Window.partitionBy("_span").orderBy(place)
    seen = spanned.withColumns({"_lag": F.lag(value).over(within), "_nth": F.row_number().over(within)})
    ends = spanned.groupBy("_span").agg(F.max_by(value, place).alias("_last"))
    over = Window.orderBy("_span")
    carried = ends.select("_span", F.lag("_last").over(over).alias("_carry"), (F.row_number().over(over) == 1).alias("_initial"))
    joined = seen.join(carried, "_span")
    begins = F.col("_nth") == 1
    out = joined.withColumns({"_before": F.when(begins, F.col("_carry")).otherwise(F.col("_lag")), "_first": begins & F.col("_initial")})
    return out.drop("_span", "_lag", "_nth", "_carry", "_initial")


def chain_errors(runs: DataFrame) -> DataFrame:
    """Every break of the hash chain: id and kind."""
    hashed = runs.select("id", "prev_run_hash", "run_content_hash", content_hash().alias("_again"))
    seen = previous(hashed, "id", "run_content_hash")
    kinds = F.array_compact(F.array(
        F.when(F.col("_first") & F.col("prev_run_hash").isNotNull(), "first_has_predecessor"),
        F.when(~F.col("_first") & ~F.col("prev_run_hash").eqNullSafe(F.col("_before")), "broken_link"),
        F.when(~F.col("run_content_hash").eqNullSafe(F.col("_again")), "content_changed"),
    ))
    return seen.select("id", F.explode(kinds).alias("kind"))
