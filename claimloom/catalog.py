"""The registered queries and their SQL twins for DuckDB.

Each query reads whole driver tables or relations derived from them (``plans.fixtures``). The SQL is put together from the
same rule tables, in RE2's dialect, whose ``\\b`` and ``\\s`` know ASCII only; it is exact on the relations that it runs on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import claims as C
from claimloom.functions import rules as R
from claimloom.functions import urls
from claimloom.functions.tables import spread
from claimloom.functions.text import density_score, fence_mask, html_to_text, lines, sentences
from claimloom.operators import bills, claims, context, evaluate, holds, integrity, ledger, monitor, review, scan
from claimloom.plans import conformance as probes
from claimloom.plans import fixtures as X
from claimloom.plans import verdict
from claimloom.sources import corpora, readers, sinks
from claimloom.streaming import events as hook_events

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query of (spark, sf_dir) under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


# --- SQL pieces -----------------------------------------------------------------------------------------------------------

#: RE2 forms of the rules with lookaround, and the group that holds the match; exact where a word or a space follows.
RE2 = {
    "delivery_meta_commentary": (r"^\s*(?:below is a|here'?s a breakdown\b|here is the complete\b|the following (?:code|document|section) (?:provides|shows)\b)", 0),
    "dash_en_spaced": (r"\s(–)\s", 1),
}


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pattern(rule: R.Rule) -> str:
    flags = f"(?{rule.flags})" if rule.flags else ""
    return lit(flags + RE2.get(rule.name, (rule.pattern, 0))[0])


def hit(text: str, rule: R.Rule) -> str:
    return f"regexp_matches({text}, {pattern(rule)})"


def hits(text: str, rules) -> str:
    return "(" + " or ".join(hit(text, r) for r in rules) + ")"


def names(text: str, rules) -> str:
    return "list_filter([" + ", ".join(f"case when {hit(text, r)} then {lit(r.name)} end" for r in rules) + "], lambda x: x is not null)"


def first(text: str, rules, otherwise: str = "null") -> str:
    return "case " + " ".join(f"when {hit(text, r)} then {lit(r.name)}" for r in rules) + f" else {otherwise} end"


def rel(relation: str) -> str:
    return X.sql(relation, "duckdb")


def sentence_sql(source: str) -> str:
    """CTEs up to ``s`` (doc_id, pos, sentence, following) of a source of (doc_id, text)."""
    return rf"""
        with d as ({source}), parts as (
            select doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\x01|\n+|(?:^|\s)[-*]\s+'),
                lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as l from d
        ), e as (select doc_id, unnest(l) as sentence, generate_subscripts(l, 1) - 1 as pos, l from parts),
        s as (select doc_id, pos, sentence, coalesce(l[pos + 2], '') as following from e)"""


def line_sql(source: str, fences: bool = True) -> str:
    """CTEs up to ``l`` (doc_id, line, content) of a source of (doc_id, text) whose only line end is a line feed."""
    inside = "" if fences else "where not fence and fences % 2 = 0"
    return rf"""
        with d as ({source}), parts as (select doc_id, string_split(text, chr(10)) as a from d),
        e as (select doc_id, unnest(a) as content, generate_subscripts(a, 1) as line from parts),
        f as (select *, regexp_matches(content, '^ {{0,3}}(```|~~~)') as fence,
              sum(cast(regexp_matches(content, '^ {{0,3}}(```|~~~)') as int)) over (partition by doc_id order by line) as fences from e),
        l as (select doc_id, line, content from f {inside})"""


def findings_sql(source: str, rules, fences: bool = True, tag: str = "tag", cut: int | None = None) -> str:
    shown = "match" if not cut else f"case when length(match) > {cut} then substr(match, 1, {cut - 3}) || '...' else match end"
    each = " union all ".join(
        f"select doc_id, line, {lit(r.name)} as rule, {lit(R.RESIDUE_CATEGORIES.get(r.name, 'scaffold') if tag == 'category' and r in R.RESIDUE else r.tag)} as {tag}, unnest(regexp_extract_all(content, {pattern(r)}, {RE2.get(r.name, ('', 0))[1]})) as match from l"
        for r in rules
    )
    return f"{line_sql(source, fences)}, m as ({each}) select doc_id, line, rule, {tag}, {shown} as match from m"


def salience_sql(text: str) -> str:
    decision = hit(text, R.SALIENCE[1][0])
    terms = ["0.0::DOUBLE"]
    for rule, weight in R.SALIENCE:
        extra = f" and not {decision}" if rule.name == "descriptive" else ""
        terms.append(f"case when {hit(text, rule)}{extra} then ({weight})::DOUBLE else 0.0::DOUBLE end")
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {' + '.join(terms)}))"


CITATION_SQL = f"coalesce(nullif(regexp_extract(sentence, {pattern(R.URL)}, 0), ''), nullif(regexp_extract(sentence, {pattern(R.APA)}, 0), ''))"
STATUS_SQL = f"case when {hits('sentence', R.CITATION_MARKERS)} or {hit('following', R.CITATION_LEAD)} then 'supported' when {hit('sentence', R.CITE_NEEDED)} then 'tagged' else 'unsupported' end"
CLAIMS_SQL = sentence_sql(rel(X.DRAFTS)) + f", c as (select doc_id, pos, sentence, {first('sentence', R.CLAIM_TRIGGERS)} as trigger, {STATUS_SQL} as status from s where {hits('sentence', R.CLAIM_TRIGGERS)})"
PIPELINE_SQL = sentence_sql(rel(X.DRAFTS)) + f", p as (select doc_id, pos, sentence, {CITATION_SQL} as citation, {salience_sql('sentence')} as salience from s where {hits('sentence', R.CLAIM_TRIGGERS)})"
DOCUMENT_SQL = "select doc_id, coalesce(text, '') as text from documents"
#: Word boundaries that know letters of any language, for natural text.
SUPERLATIVE_SQL = r"(?i)(^|[^\p{L}\p{N}_])(?:largest|smallest|highest|lowest|fastest|slowest|best|worst|first|only|unprecedented|most|least)([^\p{L}\p{N}_]|$)"


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.load(spark, sf_dir, X.DRAFTS)


# --- sentences and claims -------------------------------------------------------------------------------------------------


@query(sentence_sql(DOCUMENT_SQL) + "select d.doc_id, count(s.pos) as n_sentences, coalesce(sum(length(s.sentence)), 0) as n_chars from d left join s on s.doc_id = d.doc_id group by d.doc_id")
def sentence_counts(spark, sf_dir):
    s = sentences(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", s.alias("s")).select("doc_id", F.size("s").alias("n_sentences"), F.aggregate("s", F.lit(0), lambda a, x: a + F.length(x)).alias("n_chars"))


@query(sentence_sql(DOCUMENT_SQL) + f"select doc_id, count(*) as n from s where regexp_matches(sentence, {lit(SUPERLATIVE_SQL)}) group by doc_id")
def document_superlatives(spark, sf_dir):
    rule = next(r for r in R.CLAIM_TRIGGERS if r.name == "superlative")
    rows = claims.sentence_rows(table(spark, sf_dir, "documents"))
    return rows.where(C.matches(F.col("sentence"), rule)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query()
def document_claims(spark, sf_dir):
    return claims.status_totals(claims.claim_rows(table(spark, sf_dir, "documents")))


@query(sentence_sql(rel(X.DRAFTS)) + f"select doc_id, pos, array_to_string({names('sentence', R.CLAIM_TRIGGERS)}, ',') as triggers from s where {hits('sentence', R.CLAIM_TRIGGERS)}")
def claim_triggers(spark, sf_dir):
    rows = claims.sentence_rows(drafts(spark, sf_dir)).select("doc_id", "pos", "sentence")
    return claims.claims_with(rows, triggers=F.array_join(C.triggers(F.col("sentence")), ",")).drop("sentence")


@query(CLAIMS_SQL + "select doc_id, pos, trigger from c")
def first_trigger(spark, sf_dir):
    return claims.claim_rows(drafts(spark, sf_dir)).select("doc_id", "pos", "trigger")


@query(CLAIMS_SQL + "select doc_id, pos, status, case when length(sentence) > 220 then substr(sentence, 1, 217) || '...' else sentence end as snippet from c")
def claim_status(spark, sf_dir):
    return claims.claim_rows(drafts(spark, sf_dir)).select("doc_id", "pos", "status", "snippet")


@query(CLAIMS_SQL + "select doc_id, count(*) as total, count(*) filter (status = 'supported') as supported, count(*) filter (status = 'tagged') as tagged, count(*) filter (status = 'unsupported') as unsupported from c group by doc_id")
def run_totals(spark, sf_dir):
    return claims.status_totals(claims.claim_rows(drafts(spark, sf_dir)))


@query(CLAIMS_SQL + "select trigger, status, count(*) as n from c group by all")
def trigger_distribution(spark, sf_dir):
    return claims.claim_rows(drafts(spark, sf_dir)).groupBy("trigger", "status").agg(F.count(F.lit(1)).alias("n"))


@query(PIPELINE_SQL + "select doc_id, pos, citation from p where citation is not null")
def citation_extract(spark, sf_dir):
    return claims.pipeline_claims(drafts(spark, sf_dir)).where("citation is not null").select("doc_id", "pos", "citation")


@query(PIPELINE_SQL + "select doc_id, pos, salience from p")
def salience_scores(spark, sf_dir):
    return claims.pipeline_claims(drafts(spark, sf_dir)).select("doc_id", "pos", "salience")


@query(PIPELINE_SQL + "select doc_id, count(*) as claims, count(*) filter (salience >= 0.5) as load_bearing from p group by doc_id")
def load_bearing(spark, sf_dir):
    return claims.pipeline_claims(drafts(spark, sf_dir)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if("load_bearing").alias("load_bearing"))


@query(PIPELINE_SQL + "select doc_id, count(*) filter (citation is not null) as supported, count(*) filter (citation is null) as unsupported from p group by doc_id")
def pipeline_supported(spark, sf_dir):
    return claims.pipeline_claims(drafts(spark, sf_dir)).groupBy("doc_id").agg(F.count_if(F.col("citation").isNotNull()).alias("supported"), F.count_if(F.col("citation").isNull()).alias("unsupported"))


@query(PIPELINE_SQL + ", k as (select *, row_number() over (partition by doc_id order by salience desc, pos) as rank from p where salience >= 0.3) select doc_id, pos, rank, salience from k where rank <= 2")
def verifier_topk(spark, sf_dir):
    return claims.budgeted(claims.pipeline_claims(drafts(spark, sf_dir)), 0.3, 2).select("doc_id", "pos", "rank", "salience")


TOKENS_SQL = (
    f"list_concat(list_transform(regexp_extract_all(bare, {pattern(R.NUMBER_TOKEN)}, 0), lambda x: lower(x)), list_transform(regexp_extract_all(bare, {pattern(R.PERCENT_TOKEN)}, 0), lambda x: lower(x)),"
    f" list_filter(list_transform(regexp_extract_all(bare, {pattern(R.WORD_TOKEN)}, 0), lambda x: lower(x)), lambda x: not list_contains([{', '.join(map(lit, R.SALIENT_STOPS))}], x)))"
)
BARE_SQL = f"regexp_replace(sentence, {pattern(R.URL)}, '', 'g')"


@query(PIPELINE_SQL + f", b as (select *, {BARE_SQL} as bare from p), t as (select doc_id, pos, {TOKENS_SQL} as tokens from b) select doc_id, pos, array_to_string(list_sort(list_distinct(tokens)), ',') as tokens from t")
def salient_tokens(spark, sf_dir):
    tokens = F.array_join(F.array_sort(C.salient_tokens(F.col("sentence"))), ",")
    return claims.pipeline_claims(drafts(spark, sf_dir), tokens=tokens).select("doc_id", "pos", "tokens")


@query(
    PIPELINE_SQL + f", src as ({rel(X.SOURCES)}), b as (select p.*, {BARE_SQL} as bare, source_text from p left join src on citation = url), t as (select *, {TOKENS_SQL} as tokens from b)"
    " select doc_id, pos, case when source_text <> '' and len(tokens) > 0 and len(list_filter(tokens, lambda x: not contains(lower(source_text), x))) = 0 then 'verified'"
    " when source_text <> '' then 'not_addressed' when citation <> '' then 'unverifiable' else 'skipped' end as verdict from t"
)
def heuristic_grade(spark, sf_dir):
    return claims.graded(claims.pipeline_claims(drafts(spark, sf_dir)), X.load(spark, sf_dir, X.SOURCES)).select("doc_id", "pos", "verdict")


FAMILY_SQL = lambda c: first(f"trim({c})", R.FAMILIES, "'unknown'")


@query(
    f"with p as ({rel(X.PAIRS)}) select id, {FAMILY_SQL('writer')} as family, case when trim(verifier) = '' then 'ok' when lower(trim(writer)) = lower(trim(verifier)) then 'requires_external_grounding'"
    f" when {FAMILY_SQL('writer')} <> 'unknown' and {FAMILY_SQL('writer')} = {FAMILY_SQL('verifier')} then 'family_match' else 'ok' end as verdict from p"
)
def self_grounding(spark, sf_dir):
    pairs = X.load(spark, sf_dir, X.PAIRS)
    return pairs.select("id", C.family(F.col("writer")).alias("family"), C.self_grounding(F.col("writer"), F.col("verifier")).alias("verdict"))


# --- line scans -----------------------------------------------------------------------------------------------------------


@query("select doc_id, len(a) - cast(a[len(a)] = '' as int) as n_lines from (select doc_id, string_split(coalesce(text, ''), chr(10)) as a from documents)")
def line_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(lines(F.coalesce("text", F.lit("")))).alias("n_lines"))


@query(line_sql(rel(X.DRAFTS), False) + "select doc_id, count(*) as outside from l group by doc_id")
def fence_lines(spark, sf_dir):
    found = drafts(spark, sf_dir).select("doc_id", fence_mask(lines(F.col("text"))).alias("m"))
    return found.select("doc_id", F.size(F.filter("m", lambda x: x)).alias("outside"))


@query(findings_sql(rel(X.DRAFTS), R.BOUNDARY_PROFILES["final-prose"], tag="severity"))
def boundary_violations(spark, sf_dir):
    return scan.boundary(drafts(spark, sf_dir)).select("doc_id", "line", "rule", F.col("tag").alias("severity"), "match")


@query(
    " union all ".join(
        f"select {lit(p)} as profile, count(*) as n from ({findings_sql(rel(X.DRAFTS), rules)})" if rules else f"select {lit(p)} as profile, 0 as n" for p, rules in R.BOUNDARY_PROFILES.items()
    )
)
def boundary_by_profile(spark, sf_dir):
    """All profiles' rules are scanned for once; a profile counts the matches of its own."""
    every = scan.findings(drafts(spark, sf_dir), R.BOUNDARY_PROFILES["final"]).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    pairs = spark.createDataFrame([(p, r.name) for p, rules in R.BOUNDARY_PROFILES.items() for r in rules], "profile string, rule string")
    dim = spark.createDataFrame([(p,) for p in R.BOUNDARY_PROFILES], "profile string")
    return dim.join(pairs, "profile", "left").join(every, "rule", "left").groupBy("profile").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query()
def document_boundary(spark, sf_dir):
    """Whole natural texts, with whatever line ends they have."""
    return scan.boundary(table(spark, sf_dir, "documents")).select("doc_id", "line", "rule", F.col("tag").alias("severity"), "match")


@query()
def document_residue(spark, sf_dir):
    return scan.residue(table(spark, sf_dir, "documents")).select("doc_id", "line", "rule", "category", "match")


@query()
def document_contamination(spark, sf_dir):
    return scan.contamination_verdict(table(spark, sf_dir, "documents"))


RESIDUE_SQL = findings_sql(rel(X.DRAFTS), R.RESIDUE, False, "category", 60)
TELLS_SQL = findings_sql(rel(X.DRAFTS), R.TELLS, False, "category", 60)


@query(RESIDUE_SQL)
def residue_findings(spark, sf_dir):
    return scan.residue(drafts(spark, sf_dir)).select("doc_id", "line", "rule", "category", "match")


def score_sql(found: str) -> str:
    return f"select n as files, f as findings, cast(printf('%.1f', 10.0::DOUBLE * (f / n) / ((f / n) + 1.0::DOUBLE)) as double) as score from (select count(*)::DOUBLE as n from orders), (select count(*)::DOUBLE as f from ({found}))"


@query(f"select files::BIGINT as files, findings::BIGINT as findings, score from ({score_sql(RESIDUE_SQL)})")
def residue_score(spark, sf_dir):
    docs = drafts(spark, sf_dir)
    return scan.score(docs, scan.residue(docs))


@query(f"select files::BIGINT as files, findings::BIGINT as findings, score from ({score_sql(TELLS_SQL)})")
def tell_score(spark, sf_dir):
    docs = drafts(spark, sf_dir)
    return scan.score(docs, scan.tells(docs))


@query(TELLS_SQL)
def tells_line(spark, sf_dir):
    return scan.tells(drafts(spark, sf_dir)).select("doc_id", "line", "rule", "category", "match")


TELL_SENTENCES_SQL = rf"""
    with d as ({rel(X.DRAFTS)}), a as (select doc_id, regexp_replace(text, '(?s)```.*?```', chr(10) || chr(10), 'g') as t from d),
    e as (select doc_id, regexp_extract_all(t, '[^.!?]*[.!?]|[^.!?]+$', 0) as l from a),
    s as (select doc_id, unnest(l) as raw, generate_subscripts(l, 1) as pos, l from e),
    n as (select doc_id, pos, regexp_replace(raw, '^\s+|\s+$', '', 'g') as sentence,
          1 + length(regexp_replace(array_to_string(l[:pos - 1], '') || regexp_extract(raw, '^\s*', 0), '[^\n]', '', 'g')) as line from s)"""


@query(TELL_SENTENCES_SQL + f"select doc_id, line, case when length(sentence) > 60 then substr(sentence, 1, 57) || '...' else sentence end as match from n where len(regexp_extract_all(sentence, {pattern(R.HEDGES)}, 0)) >= 2")
def tells_hedge(spark, sf_dir):
    return scan.hedge_stacking(drafts(spark, sf_dir))


FORMULAIC_SQL = "case " + " ".join(f"when starts_with(sentence, {lit(m)}) then {lit(n)}" for n, m in R.FORMULAIC) + " end"


@query(TELL_SENTENCES_SQL + f", o as (select doc_id, line, {FORMULAIC_SQL} as rule, pos from n), k as (select *, row_number() over (partition by doc_id order by pos) as nth from o where rule is not null) select doc_id, line, rule, nth from k where nth >= 2")
def tells_formulaic(spark, sf_dir):
    return scan.formulaic(drafts(spark, sf_dir))


CONTAMINATION_SQL = findings_sql(rel(X.DRAFTS), R.CONTAMINATION)


@query(f"select doc_id, line, rule, substr(match, 1, 120) as match from ({CONTAMINATION_SQL})")
def contamination(spark, sf_dir):
    return scan.contamination(drafts(spark, sf_dir)).select("doc_id", "line", "rule", "match")


@query(f"select o.o_orderkey as doc_id, count(m.rule) as n_matches, case when count(m.rule) > 0 then 'blocked' else 'pass' end as verdict from orders o left join ({CONTAMINATION_SQL}) m on m.doc_id = o.o_orderkey group by o.o_orderkey")
def contamination_verdict(spark, sf_dir):
    return scan.contamination_verdict(drafts(spark, sf_dir))


SENSITIVITY_SQL = f"select doc_id, array_to_string({names('text', R.SENSITIVITY)}, ',') as rules, greatest(1, {', '.join(f'case when {hit("text", r)} then {R.TIERS[r.tag]} else 0 end' for r in R.SENSITIVITY)}) as rank from ({rel(X.DRAFTS)})"


@query(f"select doc_id, rules, rank, ['public', 'official', 'sensitive', 'credentials'][rank + 1] as tier, rank >= 2 as blocks from ({SENSITIVITY_SQL})")
def sensitivity_tier(spark, sf_dir):
    return scan.sensitivity(drafts(spark, sf_dir)).withColumn("rules", F.array_join("rules", ","))


@query(f"select doc_id from ({SENSITIVITY_SQL}) where rank < 2")
def sensitivity_gate(spark, sf_dir):
    return scan.gate(drafts(spark, sf_dir)).select("doc_id")


# --- context --------------------------------------------------------------------------------------------------------------

AGENT_SQL = r"regexp_replace(lower(trim(source_agent)), '[-_\s]+', '-', 'g')"
REVIEW_SQL = f"({AGENT_SQL} in ({', '.join(map(lit, R.REVIEW_ROLES))}) or {' + '.join(f'cast({hit("text", r)} as int)' for r in R.REVIEW_SIGNALS)} >= 2)"
CLASS_SQL = f"select *, case when {REVIEW_SQL} then 'review_finding' else {first('text', R.CONTEXT_CLASSES, lit('synthesised_judgement'))} end as context_type from ({rel(X.CONTEXT_ITEMS)})"
DIMENSION_SQL = "select * from (values " + ", ".join("(" + ", ".join(str(v).lower() if isinstance(v, bool) else lit(v) for v in row) + ")" for row in R.CONTEXT_DIMENSION) + f") as dim({', '.join(R.CONTEXT_COLUMNS)})"
CLASSIFIED_SQL = f"select * from ({CLASS_SQL}) join ({DIMENSION_SQL}) using (context_type)"


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.classify(X.load(spark, sf_dir, X.CONTEXT_ITEMS))


@query(f"select context_id, {REVIEW_SQL} as review from ({rel(X.CONTEXT_ITEMS)})")
def review_role(spark, sf_dir):
    return X.load(spark, sf_dir, X.CONTEXT_ITEMS).select("context_id", context.is_review_output(F.col("text"), F.col("source_agent")).alias("review"))


@query(f"select context_id, {', '.join(R.CONTEXT_COLUMNS)} from ({CLASSIFIED_SQL})")
def context_class(spark, sf_dir):
    return classified(spark, sf_dir).select("context_id", *R.CONTEXT_COLUMNS)


REQUIREMENT_SQL = (
    "case " + " ".join(f"when allowed_transformation = {lit(k)} then {lit(v)}" for k, v in R.REQUIREMENTS.items()) + f" when not can_influence_output then {lit(R.REQUIREMENT_EXCLUDED)}"
    f" else coalesce(nullif(concat_ws('; ', case when contains(lower(text), 'commercial') then {lit(R.REQUIREMENT_COMMERCIAL)} end, case when contains(lower(text), 'previous version') or contains(lower(text), 'prior version') or contains(lower(text), 'previous draft') then {lit(R.REQUIREMENT_STANDALONE)} end), ''), {lit(R.REQUIREMENT_OTHER)}) || '.' end"
)


@query(f"select context_id, allowed_transformation as kind, {REQUIREMENT_SQL} as requirement from ({CLASSIFIED_SQL})")
def derived_requirement(spark, sf_dir):
    return context.requirements(classified(spark, sf_dir))


@query(f"select context_type, count(*) filter (writer_admitted) as admitted, count(*) filter (not writer_admitted) as refused from ({CLASSIFIED_SQL}) group by context_type")
def writer_admissible(spark, sf_dir):
    return classified(spark, sf_dir).groupBy("context_type").agg(F.count_if("writer_admitted").alias("admitted"), F.count_if(~F.col("writer_admitted")).alias("refused"))


def pack_sql(shown: str, *kinds: str) -> str:
    return f"coalesce(string_agg({shown}, ' / ' order by context_id) filter (writer_admitted and context_type in ({', '.join(map(lit, kinds))})), '')"


PROCESS = ("user_feedback", "review_finding", "prior_artefact", "process_history", "synthesised_judgement")


@query(
    f"select run_id, {pack_sql('text', 'empirical_evidence')} as evidence, {pack_sql(REQUIREMENT_SQL, 'style_signal')} as style, {pack_sql('trim(text)', 'instruction')} as instructions, {pack_sql(REQUIREMENT_SQL, *PROCESS)} as requirements,"
    f" {pack_sql(f'case context_type when {lit("instruction")} then trim(text) else {REQUIREMENT_SQL} end', 'instruction', *PROCESS)} as brief, concat_ws(' / ', {lit(' / '.join(R.BANNED_RESIDUE))}, nullif({pack_sql(REQUIREMENT_SQL, 'validation_rule')}, '')) as banned,"
    f" {lit(' / '.join(R.ACCEPTANCE_TESTS))} as acceptance, count(*) - count(*) filter (writer_admitted and context_type in ({', '.join(map(lit, ('empirical_evidence', 'style_signal', 'instruction', 'validation_rule', *PROCESS)))})) as excluded from ({CLASSIFIED_SQL}) group by run_id"
)
def writer_pack(spark, sf_dir):
    packs = context.writer_pack(classified(spark, sf_dir), "run_id")
    return packs.select("run_id", *[F.array_join(c, " / ").alias(c) for c in ("evidence", "style", "instructions", "requirements", "brief", "banned", "acceptance")], "excluded")


@query(
    f"with i as (select run_id, count(*) as inputs, count(*) filter (writer_admitted) as admitted, count(*) filter (ledger_bucket = 'excluded') as blocked from ({CLASSIFIED_SQL}) group by run_id),"
    f" c as (select doc_id % 400 as run_id, count(*) as claims, count(citation) as supported from ({PIPELINE_SQL} select * from p) group by doc_id % 400)"
    " select coalesce(i.run_id, c.run_id) as run_id, coalesce(inputs, 0) as inputs, coalesce(admitted, 0) as admitted, coalesce(blocked, 0) as blocked, coalesce(claims, 0) as claims, coalesce(supported, 0) as supported from i full join c on i.run_id = c.run_id"
)
def cbom_summary(spark, sf_dir):
    rows = claims.pipeline_claims(drafts(spark, sf_dir)).select((F.col("doc_id") % 400).alias("run_id"), "citation")
    return context.bill_summary(classified(spark, sf_dir), rows, "run_id")


REFERENCES = "select l_orderkey as owner, (case when l_linenumber % 2 = 0 then 'input' else 'support' end) as kind, l_partkey + (case when l_suppkey % 10 = 0 then 1000000 else 0 end) as context_id from {lineitem}"


@query(
    f"select owner, kind, r.context_id, case when writer_admitted is null then 'unknown_' || kind else 'blocked_support' end as error from ({rel(REFERENCES)}) r"
    f" left join ({CLASSIFIED_SQL}) i on i.context_id = r.context_id where writer_admitted is null or (kind = 'support' and not writer_admitted)"
)
def cbom_reference_errors(spark, sf_dir):
    return context.reference_errors(classified(spark, sf_dir), X.load(spark, sf_dir, REFERENCES))


FINALS = f"select doc_id as run_id, text from ({X.DRAFTS}) d where doc_id < 400"
BOUNDARY_SQL = findings_sql(f"select run_id as doc_id, text from ({rel(FINALS)})", R.BOUNDARY_PROFILES["final-prose"])


@query(
    f"with i as (select run_id, string_agg(context_id || chr(0) || text || chr(0), '' order by context_id) as t, count(*) as total_context_items, count(*) filter (can_influence_output) as can_influence_output,"
    f" count(*) filter (can_appear_in_final_prose) as can_appear_in_final_prose, count(*) filter (audit_status = 'audit_only') as audit_only, count(*) filter (audit_status = 'excluded') as excluded from ({CLASSIFIED_SQL}) group by run_id),"
    f" f as ({rel(FINALS)}), v as (select doc_id, count(*) as violations from ({BOUNDARY_SQL}) group by doc_id)"
    " select coalesce(i.run_id, f.run_id) as run_id, substr(sha256(coalesce(t, '') || coalesce(f.text, '')), 1, 16) as bill_id, coalesce(total_context_items, 0) as total_context_items, coalesce(can_influence_output, 0) as can_influence_output,"
    " coalesce(can_appear_in_final_prose, 0) as can_appear_in_final_prose, coalesce(audit_only, 0) as audit_only, coalesce(excluded, 0) as excluded, coalesce(violations, 0) as violations, case when violations > 0 then 'blocked' else 'pass' end as verdict"
    " from i full join f on i.run_id = f.run_id left join v on v.doc_id = coalesce(i.run_id, f.run_id)"
)
def cbom_headers(spark, sf_dir):
    finals = X.load(spark, sf_dir, FINALS)
    found = scan.boundary(finals.withColumnRenamed("run_id", "doc_id")).select(F.col("doc_id").alias("run_id"))
    return bills.headers(classified(spark, sf_dir), finals, found, "run_id")


#: Claims of a bill by order, each with two supports, some of them unknown; bills are runs of the context items.
SUPPORTED = "select l_partkey % 400 as run_id, l_orderkey * 10 + l_linenumber as claim_id, l_partkey as one, case when l_suppkey % 9 = 0 then 100000000 + l_suppkey else l_partkey end as two from {lineitem}"


@query(
    f"with k as (select run_id, context_id, bool_or(writer_admitted) as ok from ({CLASSIFIED_SQL}) group by all), s as (select distinct * from ({rel(SUPPORTED)})),"
    " e as (select s.*, a.ok as a, b.ok as b from s left join k a on a.run_id = s.run_id and a.context_id = one left join k b on b.run_id = s.run_id and b.context_id = two)"
    " select run_id, 1 as stage, claim_id::VARCHAR as owner, case when a is null or b is null then 'claim ' || claim_id || ' references unknown support input(s): ' || concat_ws(', ', case when a is null then one end, case when b is null then two end)"
    " else 'claim ' || claim_id || ' references blocked support input(s): ' || concat_ws(', ', case when not a then one end, case when not b then two end) end as error from e where a is null or b is null or not a or not b"
)
def cbom_problems(spark, sf_dir):
    inputs = classified(spark, sf_dir).select("run_id", "context_id", F.col("writer_admitted").alias("admitted"))
    claimed = X.load(spark, sf_dir, SUPPORTED).select("run_id", "claim_id", F.array("one", "two").alias("support_ids"))
    none = lambda schema: spark.createDataFrame([], schema)
    return bills.problems(inputs, none("run_id long, transform_id string, input_ids array<long>"), claimed, none("run_id long, override_id string, context_id long"), "run_id")


URLS = (
    f"select c_custkey as id, {X.choose('c_custkey', 'http', 'https', 'HTTP', 'ftp')} || '://' || {X.choose('c_custkey div0 4', '', 'user@', 'a:b@')} || (c_custkey * 7 % 256) || '.' || (c_custkey div0 256 % 256) || '.'"
    f" || (c_custkey * 3 % 256) || '.' || (c_custkey * 11 % 256) || {X.choose('c_custkey div0 5', '', ':8080', '/a/b?c=d', '#x', '?q')} as url from {{customer}}"
)
WITHIN_SQL = " or ".join(f"n between {int(a, 16)} and {int(b, 16)}" for a, b in urls.intervals(urls.IPV4_BLOCKS, urls.IPV4_GLOBAL))


@query(
    f"with u as (select id, url, string_split(regexp_extract(url, '^[A-Za-z]+://([^/?#@]*@)?([0-9.]+)', 2), '.') as p from ({rel(URLS)})),"
    " k as (select id, url, p[1]::BIGINT * 16777216 + p[2]::BIGINT * 65536 + p[3]::BIGINT * 256 + p[4]::BIGINT as n from u)"
    f" select id, lower(url[1:4]) = 'http' and not ({WITHIN_SQL}) as safe from k"
)
def safe_urls(spark, sf_dir):
    return X.load(spark, sf_dir, URLS).select("id", urls.safe_url(F.col("url")).alias("safe"))


ACTORS = "select s_suppkey as key, (case s_suppkey % 4 when 0 then 'context_classifier,auditor' when 1 then 'context_classifier,insight_compiler,source_curator,clean_room_writer,reviewer_qa,auditor' when 2 then 'auditor,ghost' else '' end) as names, (case s_suppkey % 3 when 0 then ' ' else 'someone' end) as who from {supplier}"
ROLE_LIST_SQL = "[" + ", ".join(map(lit, R.ACTOR_ROLES)) + "]"


@query(
    f"with a as (select key, who, list_filter(string_split(names, ','), lambda x: x <> '') as n from ({rel(ACTORS)})) select key, array_to_string(list_sort(list_filter({ROLE_LIST_SQL}, lambda x: not list_contains(n, x))), ',') as missing,"
    f" array_to_string(list_sort(list_filter(n, lambda x: not list_contains({ROLE_LIST_SQL}, x))), ',') as unknown, case when trim(who) = '' then array_to_string(list_sort(n), ',') else '' end as empty from a"
)
def actor_identity_problems(spark, sf_dir):
    rows = X.load(spark, sf_dir, ACTORS)
    roles = F.map_from_entries(F.transform(F.filter(F.split("names", ","), lambda x: x != ""), lambda x: F.struct(x, F.col("who"))))
    found = context.identity_problems(rows.select("key", roles.alias("roles")))
    return found.select("key", *[F.array_join(c, ",").alias(c) for c in ("missing", "unknown", "empty")])


OVERRIDDEN = "select p_partkey as context_id, (case when p_partkey % 5 = 0 then ' ' else 'o1' end) as override_id, (case p_partkey % 3 when 0 then 'review_finding' when 1 then 'operational_trace' else 'instruction' end) as target_class from {part} where p_size > 25"


@query(
    f"with j as (select c.context_id, c.context_type, case when o.context_id is null then null when trim(override_id) = '' then 'override id is empty' when target_class not in ('private_reasoning', 'synthesised_judgement', 'review_finding', 'operational_trace') then 'target class is not allowed' end as override_error, target_class from ({CLASS_SQL}) c left join ({rel(OVERRIDDEN)}) o using (context_id)),"
    " k as (select context_id, case when target_class is not null and override_error is null then target_class else context_type end as context_type, override_error from j)"
    f" select context_id, context_type, ledger_bucket, override_error from k join ({DIMENSION_SQL}) using (context_type)"
)
def context_override(spark, sf_dir):
    found = context.reclassify(classified(spark, sf_dir), X.load(spark, sf_dir, OVERRIDDEN))
    return found.select("context_id", "context_type", "ledger_bucket", "override_error")


CORPUS = (
    f"select cast({X.LINE_ID} as bigint) as line, {X.choose('l_partkey', X.Sql('JSON_LINE'), X.Sql('JSON_LINE'), X.Sql('JSON_LINE'), 'no JSON', '[1, 2]', '3')} as value from {{lineitem}}"
)
JSON_LINE = (
    "(chr(123) || case when l_suppkey % 11 = 0 then '' else '\"id\": ' || (l_orderkey * 100 + l_linenumber - l_linenumber % 2) || ', ' end || case when l_suppkey % 13 = 0 then '' else '\"claim\": \"' || 'Costs rose ' || l_partkey || '%.\", ' end"
    " || '\"gold\": ' || (case l_suppkey % 7 when 0 then '\"unknown\"' when 1 then '7' when 2 then 'null' when 3 then '\"skipped\"' else '\"verified\"' end)"
    " || (case l_suppkey % 5 when 0 then ', \"source\": 5' when 1 then ', \"source\": null, \"citation\": \"a\"' when 2 then ', \"citation\": [1]' else '' end) || chr(125))"
)
CORPUS = CORPUS.replace("JSON_LINE", JSON_LINE)
BAD_SQL = (
    "case when not json_valid(value) then 'not JSON' when json_type(j) <> 'OBJECT' then 'not an object' when not json_exists(j, '$.id') then 'missing field id' when not json_exists(j, '$.claim') then 'missing field claim'"
    f" when not json_exists(j, '$.gold') then 'missing field gold' when json_type(j, '$.gold') <> 'VARCHAR' or json_extract_string(j, '$.gold') not in ({', '.join(map(lit, corpora.GOLD))}) then 'gold label' end"
)


@query(
    f"with v as (select line, value, case when json_valid(value) then value else '[]' end as j from ({rel(CORPUS)})), r as (select line, j, {BAD_SQL} as e from v), i as (select *, json_extract_string(j, '$.id') as id from r),"
    " f as (select id, min(line) as first from i where e is null group by id) select line, coalesce(e, case when line <> first then 'duplicate id' end,"
    " case when coalesce(json_type(j, '$.citation'), 'NULL') not in ('NULL', 'VARCHAR') then 'citation is no string' when coalesce(json_type(j, '$.source'), 'NULL') not in ('NULL', 'VARCHAR') then 'source is no string' end) as reason"
    " from i left join f using (id) where reason is not null"
)
def corpus_rejects(spark, sf_dir):
    return corpora.rejects(corpora.checked(X.load(spark, sf_dir, CORPUS), corpora.GRADES, corpora.LATE)).select("line", "reason")


# --- verdicts -------------------------------------------------------------------------------------------------------------

THRESHOLD_SQL = lambda p: f"case {p} " + " ".join(f"when {lit(k)} then {v}::DOUBLE" for k, v in R.UNSUPPORTED_THRESHOLDS.items()) + " else 1.0::DOUBLE end"
VERDICT_ACTORS = "select o_orderkey as doc_id, o_custkey % 4 = 0 as single_actor, o_custkey % 3 <> 0 as has_identity from {orders}"


def verdict_sql(profile: str) -> str:
    strict, final = profile in R.STRICT_ARTEFACTS, profile in R.FINAL_ARTEFACTS
    return (
        PIPELINE_SQL + f", c as (select doc_id, count(*) as claims, count(*) filter (citation is null) as unsupported, count(*) filter (citation is null and salience >= 0.5) as heavy from p group by doc_id),"
        f" b as (select doc_id, count(*) as violations from ({findings_sql(rel(X.DRAFTS), R.BOUNDARY_PROFILES[profile])}) group by doc_id),"
        f" j as (select a.*, coalesce(violations, 0) as violations, coalesce(claims, 0) as claims, coalesce(unsupported, 0) as unsupported, coalesce(heavy, 0) as heavy from ({rel(VERDICT_ACTORS)}) a left join c using (doc_id) left join b using (doc_id))"
        f" select doc_id, violations, claims, unsupported, case when violations > 0 or (single_actor and {str(strict).lower()}) then 'BLOCK'"
        f" when heavy > 0 or (claims > 0 and unsupported::DOUBLE / claims > {THRESHOLD_SQL(lit(profile))}) or (single_actor and {str(final).lower()}) then 'HOLD'"
        f" when {str(profile == 'final-prose').lower()} and not has_identity then 'NOT_ASSESSABLE' else 'PASS' end as verdict from j"
    )


def _verdict(spark, sf_dir, profile):
    found = verdict.check(drafts(spark, sf_dir), profile, actors=X.load(spark, sf_dir, VERDICT_ACTORS))
    return found.select("doc_id", "violations", "claims", "unsupported", "verdict")


@query(verdict_sql("final-prose"))
def verdict_final_prose(spark, sf_dir):
    return _verdict(spark, sf_dir, "final-prose")


@query(verdict_sql("paper-full"))
def verdict_paper(spark, sf_dir):
    return _verdict(spark, sf_dir, "paper-full")


def said_sql(profile: str) -> str:
    """Reasons of a profile without verification, each sorted, one below the other."""
    single, share = profile in R.STRICT_ARTEFACTS, f"unsupported::DOUBLE / claims > {THRESHOLD_SQL(lit(profile))}"
    fraction = f"'HOLD: unsupported fraction ' || unsupported || '/' || claims || ' (' || printf('%.0f', unsupported::DOUBLE / claims * 100) || '%) exceeds the ''{profile}'' profile threshold of {R.UNSUPPORTED_THRESHOLDS[profile] * 100:.0f}%; verify the uncited claims or add sources.'"
    return (
        PIPELINE_SQL + f", c as (select doc_id, count(*) as claims, count(*) filter (citation is null) as unsupported, list('HOLD: unsupported load-bearing claim (salience=' || printf('%.2f', salience) || '): ' || substr(sentence, 1, 80)) filter (citation is null and salience >= 0.5) as heavy from p group by doc_id),"
        f" b as (select doc_id, list('BLOCK: boundary violation [' || rule || ' severity=' || tag || '] line ' || line || ': ' || substr(match, 1, 60)) as violations from ({findings_sql(rel(X.DRAFTS), R.BOUNDARY_PROFILES[profile])}) group by doc_id),"
        f" j as (select a.doc_id, single_actor, claims, unsupported, list_concat(coalesce(violations, []), case when single_actor and {str(single).lower()} then ['x'] else [] end) as block,"
        f" list_concat(coalesce(heavy, []), case when claims > 0 and {share} then [{fraction}] else [] end, case when single_actor then [{lit(R.REASONS['single_actor_hold'])}] else [] end) as hold from ({rel(VERDICT_ACTORS)}) a left join c using (doc_id) left join b using (doc_id))"
        f" select doc_id, array_to_string(list_sort(case when len(block) > 0 then block else hold end), chr(10)) as reasons, case when len(block) = 0 and claims > 0 and {share} then unsupported || '/' || claims || ' ' || printf('%.4f', unsupported::DOUBLE / claims) end as fired from j"
    )


@query(said_sql("paper-full"))
def verdict_reasons(spark, sf_dir):
    """What is said of each claim and violation, sorted, and the rule that fired."""
    found = verdict.check(drafts(spark, sf_dir), "paper-full", actors=X.load(spark, sf_dir, VERDICT_ACTORS))
    rule = F.col("fired_rule")
    fired = F.when(rule.isNotNull(), F.concat(rule["unsupported"], F.lit("/"), rule["total"], F.lit(" "), F.format_number(rule["unsupported_fraction"], 4)))
    return found.select("doc_id", F.array_join(F.array_sort("reasons"), "\n").alias("reasons"), fired.alias("fired"))


@query()
def verdict_verified(spark, sf_dir):
    """Verdicts with claims graded against the sources that they cite."""
    found = verdict.check(drafts(spark, sf_dir), "methodology", X.load(spark, sf_dir, X.SOURCES), X.load(spark, sf_dir, VERDICT_ACTORS))
    return found.select("doc_id", "verdict", F.array_join("reasons", "; ").alias("reasons"))


# --- ledger ---------------------------------------------------------------------------------------------------------------


@query(
    f"with c as (select *, {salience_sql('claim_text')} as salience from ({rel(X.CLAIM_ROWS)})) select (select count(*) from ({rel(X.RUNS)})) as runs, count(*) as claims, count(*) filter (status = 'supported') as supported, count(*) filter (status = 'tagged') as tagged,"
    " count(*) filter (status = 'unsupported') as unsupported, count(*) filter (status = 'unsupported' and salience >= 0.5) as load_bearing_unsupported, count(*) filter (status = 'unsupported' and salience >= 0.5)::DOUBLE / count(*) * 1000.0::DOUBLE as debt_per_1000 from c"
)
def debt_totals(spark, sf_dir):
    return ledger.debt_totals(X.load(spark, sf_dir, X.RUNS), X.load(spark, sf_dir, X.CLAIM_ROWS))


@query(f"select {', '.join(f'count(*) filter (verdict = {lit(g)}) as {g}' for g in R.GRADES)} from ({rel(X.VERIFICATIONS)})")
def debt_verification(spark, sf_dir):
    return ledger.verification_counts(X.load(spark, sf_dir, X.VERIFICATIONS))


@query(
    f"with r as (select * from ({rel(X.RUNS)}) order by id desc limit 5), e as (select count(*) as n_runs, arg_min(unsupported::DOUBLE / total, id) as first_rate, arg_max(unsupported::DOUBLE / total, id) as last_rate from r)"
    " select *, case when n_runs < 2 then 'flat' when last_rate > first_rate then 'up' when last_rate < first_rate then 'down' else 'flat' end as direction from e"
)
def debt_trend(spark, sf_dir):
    return ledger.debt_trend(X.load(spark, sf_dir, X.RUNS))


LATEST_SQL = f"select claim_id, verdict from (select *, row_number() over (partition by claim_id order by id desc) as k from ({rel(X.VERIFICATIONS)})) where k = 1"


@query(f"select c.id, run_id, status, verdict, printf('%.2f', {salience_sql('claim_text')}) as salience from ({rel(X.CLAIM_ROWS)}) c left join ({LATEST_SQL}) v on v.claim_id = c.id")
def evidence_matrix(spark, sf_dir):
    rows = X.load(spark, sf_dir, X.CLAIM_ROWS).withColumn("trigger", F.lit(""))
    checks = X.load(spark, sf_dir, X.VERIFICATIONS).withColumns({"citation": F.lit(""), "grader": F.lit("")})
    return ledger.evidence_matrix(rows, checks).select("id", "run_id", "status", "verdict", "salience")


WINDOW_SQL = f"select r.id, r.ts, case when w.run_id is not null then w.retention_window_days else r.retention_window_days end as window_days from ({rel(X.RUNS)}) r left join (select * from (select *, row_number() over (partition by run_id order by id desc) as k from ({rel(X.WINDOWS)})) where k = 1) w on w.run_id = r.id"


@query(WINDOW_SQL)
def effective_window(spark, sf_dir):
    return ledger.effective_windows(X.load(spark, sf_dir, X.RUNS), X.load(spark, sf_dir, X.WINDOWS))


@query(
    f"with w as ({WINDOW_SQL}), t as (select *, cast(left(ts, 10) as timestamp) + to_hours(case when length(ts) > 10 then 10 else 0 end) + to_days(window_days) as over from w where window_days is not null and id not in (select run_id from ({rel(X.TOMBSTONES)})))"
    " select id, ts, window_days, strftime(over, '%Y-%m-%dT%H:%M:%SZ') as expired_after from t where timestamp '2024-07-01 00:00:00' > over"
)
def expired_runs(spark, sf_dir):
    now = F.to_timestamp(F.lit("2024-07-01T00:00:00+00:00"))
    return ledger.expired_runs(X.load(spark, sf_dir, X.RUNS), X.load(spark, sf_dir, X.WINDOWS), X.load(spark, sf_dir, X.TOMBSTONES), now)


@query(f"select run_id, count(*) as n_overrides, bool_or(single_actor) as single_actor, string_agg(reviewer, ',' order by id) as reviewers from ({rel(X.OVERRIDES)}) group by run_id")
def overrides_by_run(spark, sf_dir):
    return ledger.overrides_by_run(X.load(spark, sf_dir, X.OVERRIDES))


CHAIN = (
    "select o_orderkey as id, 'file ' || (o_custkey % 50) as file_path, 'default' as mode, 's' || (o_custkey % 9) as session_id, 'event' as source_event, o_orderkey % 3 as supported, o_orderkey % 2 as tagged, o_orderkey % 3 + o_orderkey % 2 as total, '2024-01-01T00:00:00Z' as ts, 0 as unsupported, o_custkey from {orders}"
)
HASH_SQL = "'sha256:' || sha256('{\"file_path\":\"' || file_path || '\",\"mode\":\"' || mode || '\",\"session_id\":\"' || session_id || '\",\"source_event\":\"' || source_event || '\",\"supported\":' || supported || ',\"tagged\":' || tagged || ',\"total\":' || total || ',\"ts\":\"' || ts || '\",\"unsupported\":' || unsupported || '}')"


@query(
    f"with r as ({rel(CHAIN)}), h as (select *, {HASH_SQL} as hash from r), c as (select *, lag(hash) over (order by id) as before, row_number() over (order by id) as n from h)"
    " select id, 'content_changed' as kind from c where o_custkey % 101 = 7 union all select id, 'broken_link' as kind from c where o_custkey % 103 = 9 and n > 1 union all select id, 'first_has_predecessor' from c where n = 1 and o_custkey % 103 = 9"
)
def hash_chain_verify(spark, sf_dir):
    """A chain in which some rows were changed after hashing and some links were cut."""
    rows = X.load(spark, sf_dir, CHAIN).withColumn("run_content_hash", ledger.content_hash())
    linked = ledger.previous(rows, "id", "run_content_hash").withColumnRenamed("_before", "prev_run_hash").drop("_first")
    spoilt = linked.withColumn("prev_run_hash", F.when(F.col("o_custkey") % 103 == 9, "cut").otherwise(F.col("prev_run_hash")))
    return ledger.chain_errors(spoilt.withColumn("total", F.when(F.col("o_custkey") % 101 == 7, F.col("total") + 1).otherwise(F.col("total"))))


# --- integrity ------------------------------------------------------------------------------------------------------------

#: Of the SQL only, which has a fixed number of levels; the operators take theirs from the data.
MOST_ENTRIES = 32


def merkle_sql() -> str:
    text = f"with l0 as (select key, idx, unhex(sha256(unhex('00') || encode(entry))) as hash from ({rel(X.ENTRIES)}))"
    for k in range(1, MOST_ENTRIES.bit_length()):
        text += f", l{k} as (select key, idx // 2 as idx, case when count(*) = 1 then arg_min(hash, l{k - 1}.idx) else unhex(sha256(unhex('01') || arg_min(hash, l{k - 1}.idx) || arg_max(hash, l{k - 1}.idx))) end as hash from l{k - 1} group by key, l{k - 1}.idx // 2)"
    return text + f" select key, lower(hex(hash)) as root from l{MOST_ENTRIES.bit_length() - 1}"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.load(spark, sf_dir, X.ENTRIES).withColumn("data", F.encode("entry", "UTF-8"))


@query(merkle_sql())
def merkle_root(spark, sf_dir):
    return integrity.roots(entries(spark, sf_dir), "key")


@query(f"select key, idx, key % 3 <> 1 as holds from ({rel(X.ENTRIES)})")
def inclusion_proof(spark, sf_dir):
    """Proofs of all entries; those of every third key are used for the place beside their own, where they can't hold."""
    most = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").count().agg(F.max("count").alias("n")).first()["n"] or 1
    proven = integrity.proven(entries(spark, sf_dir), "key", most)
    place = F.when(F.col("key") % 3 == 1, F.col("idx") + 1).otherwise(F.col("idx"))
    return proven.select("key", "idx", integrity.proof_holds(F.col("data"), place, F.col("size"), F.col("steps"), F.col("root")).alias("holds"))


@query(f"with r as ({merkle_sql()}) select key, true as prose_ok, key % 5 <> 0 as root_ok, case when key % 5 = 0 then 'INVALID' when key % 3 = 0 then 'UNSIGNED' else 'UNVERIFIED' end as status from r")
def bundle_verify(spark, sf_dir):
    rows = integrity.checkpoints(entries(spark, sf_dir), "key")
    prose = F.concat(F.lit("prose "), F.col("key"))
    bundles = rows.select("key", prose.alias("prose"), F.concat(F.lit("sha256:"), F.sha2(prose, 256)).alias("prose_sha256"), F.when(F.col("key") % 5 == 0, "0").otherwise(F.col("root")).alias("root"), F.when(F.col("key") % 3 != 0, "signed").alias("signature"))
    return integrity.bundle_status(bundles, rows)


# --- review, monitoring, evaluation ---------------------------------------------------------------------------------------


@query(
    f"with f as (select *, coalesce(nullif(issue_key, ''), finding_id) as g, case when deferred or issue_key = '' then finding_id end as own, case severity when 'P0' then 0 when 'P1' then 1 when 'P2' then 2 when 'P3' then 3 else 99 end as rank from ({rel(X.FINDINGS)})),"
    " u as (select g, own, deferred, string_agg(location, ',' order by m) as locations from (select g, own, deferred, location, min(seq) as m from f group by all) group by g, own, deferred),"
    " a as (select g, own, deferred, min(seq) as first_seq, count(*) as n_findings, arg_min(title, seq) as title, arg_min(detail, seq) as detail, arg_min(severity, rank::DOUBLE * 1e17 + seq) as severity, string_agg(finding_id, ',' order by seq) as finding_ids from f group by g, own, deferred)"
    " select a.g as issue_key, case when a.deferred then 'deferred' when n_findings > 1 then 'convergent' else 'distinct' end as kind, first_seq, n_findings, title, detail, severity, locations, finding_ids from a join u on a.g = u.g and a.own is not distinct from u.own and a.deferred = u.deferred"
)
def review_consolidation(spark, sf_dir):
    return review.consolidate(X.load(spark, sf_dir, X.FINDINGS))


SHADOW_OK = "not malformed and shadow_status = 'observed'"
COUNTED = f"{SHADOW_OK} and claims_supported <= claims_detected"


@query(
    f"with s as ({rel(X.SHADOW)}), m as (select count(*) as total_lines, count(*) filter (malformed) as malformed_lines, count(*) filter ({SHADOW_OK}) as observed, count(*) filter (not malformed and shadow_status <> 'observed') as non_observed, min(ts) filter ({SHADOW_OK}) as window_start, max(ts) filter ({SHADOW_OK}) as window_end,"
    f" sum(claims_detected) filter ({COUNTED}) as detected, sum(claims_supported) filter ({COUNTED}) as supported from s) select *, cast(printf('%.4f', (detected - supported)::DOUBLE / detected) as double) as unsupported_rate from m"
)
def shadow_metrics(spark, sf_dir):
    return monitor.shadow_metrics(X.load(spark, sf_dir, X.SHADOW))


@query(f"select verdict, count(*) as n from ({rel(X.SHADOW)}) where {SHADOW_OK} group by verdict")
def shadow_verdicts(spark, sf_dir):
    return monitor.verdict_distribution(X.load(spark, sf_dir, X.SHADOW))


@query(f"select shadow_status as status, count(*) as n from ({rel(X.SHADOW)}) where not malformed and shadow_status <> 'observed' group by shadow_status")
def shadow_statuses(spark, sf_dir):
    return monitor.status_distribution(X.load(spark, sf_dir, X.SHADOW))


@query(
    f"with r as (select *, row_number() over (order by coalesce(ts, ''), seq) - 1 as k, count(*) over () // 2 as mid from ({rel(X.SHADOW)}) where {COUNTED}),"
    " m as (select count(*) as rows, cast(printf('%.4f', sum(claims_detected - claims_supported) filter (k < mid)::DOUBLE / sum(claims_detected) filter (k < mid)) as double) as earlier, cast(printf('%.4f', sum(claims_detected - claims_supported) filter (k >= mid)::DOUBLE / sum(claims_detected) filter (k >= mid)) as double) as later from r)"
    " select *, case when later - earlier > 0.05 then 'worsening' when later - earlier < -0.05 then 'improving' else 'stable' end as trend from m"
)
def shadow_trend(spark, sf_dir):
    return monitor.shadow_trend(X.load(spark, sf_dir, X.SHADOW))


@query(
    f"with v as (select *, verdict in ('verified', 'contradicted') as typed from ({rel(X.VERIFICATIONS)})) select count(*) as total, count(*) filter (typed) as typed, count(*) filter (typed and confidence is not null) as with_confidence,"
    " avg(pow(confidence - case when verdict = 'verified' then 1.0 else 0.0 end, 2)) filter (typed and confidence is not null) as brier, count(*) filter (typed and confidence is not null)::DOUBLE / count(*) as coverage from v"
)
def calibration_brier(spark, sf_dir):
    return monitor.calibration(X.load(spark, sf_dir, X.VERIFICATIONS))


def prf_sql(counts: str, keep: str) -> str:
    return f"with c as ({counts}), q as (select *, case when tp + fp > 0 then tp::DOUBLE / (tp + fp) else 0 end as precision, case when tp + fn > 0 then tp::DOUBLE / (tp + fn) else 0 end as recall from c) select {keep}, precision, recall, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from q"


LABELLED = "select doc_id, (case when quality = 1 then 'kept' else 'unsupported' end) as gold, (case when (doc_id + toxic) % 3 = 0 then 'unsupported' else 'kept' end) as pred from {labels}"


@query(prf_sql(f"select count(*) filter (gold = 'unsupported' and pred = 'unsupported') as tp, count(*) filter (gold <> 'unsupported' and pred = 'unsupported') as fp, count(*) filter (gold = 'unsupported' and pred <> 'unsupported') as fn from ({rel(LABELLED)})", "tp, fp, fn"))
def prf_unsupported(spark, sf_dir):
    return evaluate.positive_class(X.load(spark, sf_dir, LABELLED), "unsupported")


@query(f"select gold, pred, count(*) as n from ({rel(X.GRADED)}) group by all")
def confusion(spark, sf_dir):
    return evaluate.confusion(X.load(spark, sf_dir, X.GRADED))


PER_CLASS_SQL = prf_sql(
    f"select class, count(*) filter (gold = class and pred = class) as tp, count(*) filter (gold <> class and pred = class) as fp, count(*) filter (gold = class and pred <> class) as fn, count(*) filter (gold = class) as support from ({rel(X.GRADED)}), (select unnest([{', '.join(map(lit, R.GRADES))}]) as class) group by class",
    "class, tp, fp, fn, support",
)


@query(PER_CLASS_SQL)
def per_class_prf(spark, sf_dir):
    return evaluate.per_class(X.load(spark, sf_dir, X.GRADED))


@query(f"select round(avg(precision), 9) as precision, round(avg(recall), 9) as recall, round(avg(f1), 9) as f1 from ({PER_CLASS_SQL})")
def macro_prf(spark, sf_dir):
    return evaluate.macro(evaluate.per_class(X.load(spark, sf_dir, X.GRADED))).select(*[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"select gold, count(*) as n, count(*) filter (gold = pred) as right, count(*) filter (gold = pred)::DOUBLE / count(*) as accuracy from ({rel(X.GRADED)}) group by gold")
def classifier_accuracy(spark, sf_dir):
    return evaluate.accuracy(X.load(spark, sf_dir, X.GRADED))


GOLD = "select o_orderkey as item_id, 'The OECD stated' as claim, 'unsupported' as gold from {orders} union all select o_orderkey as item_id, 'REVENUE rose 12%' as claim, 'supported' as gold from {orders}"


@query(
    CLAIMS_SQL + f", g as ({rel(GOLD)}), j as (select g.*, c.status, c.pos from g left join c on c.doc_id = g.item_id and (contains(lower(c.sentence), lower(g.claim)) or contains(lower(g.claim), lower(c.sentence))))"
    " select item_id, claim, gold, arg_min(status, pos) as pred from j group by item_id, claim, gold"
)
def gold_alignment(spark, sf_dir):
    rows = claims.claim_rows(drafts(spark, sf_dir)).select(F.col("doc_id").alias("item_id"), "pos", "snippet", "status")
    return evaluate.align(X.load(spark, sf_dir, GOLD), rows)


# --- sources and sinks ----------------------------------------------------------------------------------------------------


@query("select conv_id, max(turn) as turn, arg_max(text, turn) as text from conversations where role = 'assistant' and coalesce(text, '') <> '' group by conv_id")
def last_assistant(spark, sf_dir):
    return readers.last_assistant(table(spark, sf_dir, "conversations"))


@query()
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html_to_text(F.coalesce("html", F.lit(""))).alias("text"))


EVENTS = """select event_id, (case event_id % 3 when 0 then '{{"tool_input":{{"content":"c' || event_id || '"}}}}' when 1 then '{{"tool_input":{{"new_string":"n' || event_id || '"}}}}' else '{{"tool_input":{{"edits":[{{"new_string":"a"}},{{"new_string":"b' || event_id || '"}}]}}}}' end) as event from {events}"""


@query("select event_id, case event_id % 3 when 0 then 'c' || event_id when 1 then 'n' || event_id else 'a' || chr(10) || 'b' || event_id end as text from events")
def written_text(spark, sf_dir):
    rows = spark.sql(EVENTS, events=table(spark, sf_dir, "events"))
    return rows.select("event_id", readers.written_text(F.col("event")).alias("text"))


@query(
    f"select 2 as part, id, '| ' || concat_ws(' | ', id, status, '', printf('%.2f', {salience_sql('claim_text')}), coalesce(verdict, ''), '', replace(claim_text, '|', '\\|')) || ' |' as line from ({rel(X.CLAIM_ROWS)}) c left join ({LATEST_SQL}) v on v.claim_id = c.id"
    " union all select 0, null, '| claim_id | status | trigger | salience | verdict | citation | claim_text |' union all select 1, null, '| --- | --- | --- | --- | --- | --- | --- |'"
)
def matrix_markdown(spark, sf_dir):
    rows = X.load(spark, sf_dir, X.CLAIM_ROWS).withColumn("trigger", F.lit(""))
    checks = X.load(spark, sf_dir, X.VERIFICATIONS).withColumns({"citation": F.lit(""), "grader": F.lit("")})
    return sinks.matrix_markdown(ledger.evidence_matrix(rows, checks))


@query("select s_suppkey as id, case when s_suppkey % 4 = 0 then 0.0::DOUBLE else cast(printf('%.1f', 10.0::DOUBLE * (s_suppkey::DOUBLE / 3) / (s_suppkey::DOUBLE / 3 + 1)) as double) end as score from supplier")
def density(spark, sf_dir):
    findings = F.when(F.col("s_suppkey") % 4 == 0, F.lit(0)).otherwise(F.col("s_suppkey"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), density_score(findings.cast("double"), F.lit(3.0)).alias("score"))


# --- small reports on verdicts and runs ------------------------------------------------------------------------------------


@query(PIPELINE_SQL + f", h as (select p.doc_id, count(*) as holds from p where citation is null and salience >= 0.5 group by p.doc_id) select doc_id, holds from h join ({verdict_sql('paper-full')}) v using (doc_id) where v.verdict = 'HOLD'")
def hold_claims(spark, sf_dir):
    """of drafts on hold, the load-bearing claims without citation."""
    docs = drafts(spark, sf_dir)
    held = _verdict(spark, sf_dir, "paper-full").select("doc_id", "verdict")
    return holds.hold_claims(claims.pipeline_claims(docs), held).groupBy("doc_id").agg(F.count(F.lit(1)).alias("holds"))


@query(
    PIPELINE_SQL + f", h as (select p.doc_id, count(*) as hold_count, list(printf('[salience=%.2f] ', salience) || sentence order by pos) as l from p where citation is null and salience >= 0.5 group by p.doc_id)"
    " select doc_id, hold_count, 'CLAIMLOOM: ' || hold_count || ' unverified load-bearing claim(s) in run ' || doc_id || '.' || chr(10) || chr(10) || 'Please verify each claim below. For each one, either:' || chr(10)"
    " || '  (a) Add a citation to the draft (URL or APA-style reference), OR' || chr(10) || '  (b) Provide a short verification rationale based on your own knowledge,' || chr(10) || '      explicitly flagging if you cannot verify it.' || chr(10) || chr(10)"
    " || 'Unverified load-bearing claims:' || chr(10) || array_to_string(list_transform(l, lambda x, i: '  ' || i || '. ' || x), chr(10)) || chr(10) || chr(10)"
    f" || 'After verifying, re-run `claimloom check` over the updated draft to confirm the HOLD has cleared.' as message from h join ({verdict_sql('paper-full')}) v using (doc_id) where v.verdict = 'HOLD'"
)
def handback_messages(spark, sf_dir):
    """What the writers of drafts on hold read."""
    held = _verdict(spark, sf_dir, "paper-full").select("doc_id", "verdict")
    return holds.hold_messages(holds.hold_claims(claims.pipeline_claims(drafts(spark, sf_dir)), held))


@query(
    "with h as (select o_orderkey as id, o_custkey as run_id, o_orderkey % 3 as hold_count, o_orderdate::timestamp as held from orders where o_orderkey % 3 > 0),"
    " b as (select *, lag(hold_count) over (partition by run_id order by held, id) as c, lag(held) over (partition by run_id order by held, id) as seen from h)"
    " select id, run_id, hold_count from b where c is null or c <> hold_count or held > seen + interval 90 day"
)
def handbacks(spark, sf_dir):
    """Orders as holds of their customers' runs: those that are handed back, quiet runs anew after 90 days."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("run_id"), (F.col("o_orderkey") % 3).alias("hold_count"), F.col("o_orderdate").cast("timestamp").alias("at"))
    return holds.handed_back(rows, "90 days", ("at", "id")).select("id", "run_id", "hold_count")


@query("select conv_id::varchar as session_id, 'Stop' as source_event, sha256(t) as text_sha256, false as malformed from (select conv_id, arg_max(coalesce(text, ''), (turn, coalesce(text, ''))) filter (role = 'assistant') as t from conversations group by conv_id) where t is not null")
def hook_texts(spark, sf_dir):
    """A stop event for each conversation, whose turns are the lines of its transcript: the texts that such events show."""
    turns = table(spark, sf_dir, "conversations")
    line = F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.coalesce("text", F.lit("")).alias("content")).alias("message")))
    lines_ = turns.select(F.col("conv_id").cast("string").alias("path"), F.struct("turn", F.coalesce("text", F.lit(""))).alias("line"), line.alias("value"))
    stops = turns.select("conv_id").distinct().select(F.to_json(F.struct(F.lit("Stop").alias("hook_event_name"), F.col("conv_id").cast("string").alias("session_id"), F.col("conv_id").cast("string").alias("transcript_path"))).alias("value"))
    found = hook_events.read_events(stops, lines_).where("text is not null")
    return found.select("session_id", "source_event", F.sha2("text", 256).alias("text_sha256"), "malformed")


@query("select s_suppkey as id, case when s_suppkey % 4 = 0 then 'https://img.shields.io/badge/slop-free-brightgreen' else 'https://img.shields.io/badge/slop-' || printf('%.1f', 10.0::DOUBLE * (s_suppkey::DOUBLE / 3) / (s_suppkey::DOUBLE / 3 + 1)) || '%2F10-red' end as url from supplier")
def badges(spark, sf_dir):
    """Badges of suppliers with so many findings in three files."""
    count = F.when(F.col("s_suppkey") % 4 == 0, F.lit(0)).otherwise(F.col("s_suppkey"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), sinks.badge_url("slop", "free", density_score(count.cast("double"), F.lit(3.0)), count).alias("url"))


@query(f"with c as (select run_id, count(*) filter (status = 'unsupported') as unsupported, count(*) filter (verdict = 'contradicted') as contradicted from ({rel(X.CLAIM_ROWS)}) c left join ({LATEST_SQL}) v on v.claim_id = c.id group by run_id) select *, contradicted > 0 or unsupported > 0 as fails from c")
def ci_failures(spark, sf_dir):
    """per run whether a contradicted or an unsupported claim fails it."""
    last = ledger.latest(X.load(spark, sf_dir, X.VERIFICATIONS), "claim_id").select(F.col("claim_id").alias("id"), "verdict")
    rows = X.load(spark, sf_dir, X.CLAIM_ROWS).join(last, "id", "left").groupBy("run_id")
    counts = rows.agg(F.count_if(F.col("status") == "unsupported").alias("unsupported"), F.count_if(F.col("verdict") == "contradicted").alias("contradicted"))
    return counts.withColumn("fails", (F.col("contradicted") > 0) | (F.col("unsupported") > 0))


@query(f"select id, verdict, case verdict when 'contradicted' then 0 when 'unverifiable' then 1 when 'not_addressed' then 2 else 3 end as rank from ({rel(X.VERIFICATIONS)}) order by rank, id limit 10")
def worst_verdicts(spark, sf_dir):
    """The ten worst verdicts, by severity and place; the limit is the report's."""
    return claims.worst(X.load(spark, sf_dir, X.VERIFICATIONS))


@query(
    CLAIMS_SQL + "select doc_id, array_to_string(list_transform(list_sort(list(pos))[:8], lambda x: cast(x as string)), ',') || case when count(*) > 8 then ' ... and ' || (count(*) - 8) || ' more.' else '' end as listed"
    " from (select doc_id % 500 as doc_id, pos * 100000 + doc_id // 500 as pos from c) group by doc_id"
)
def capped_lists(spark, sf_dir):
    """The places of the first eight claims of every five hundredth draft together, and how many more there are."""
    rows = claims.claim_rows(drafts(spark, sf_dir))
    return claims.listed(rows.select((F.col("doc_id") % 500).alias("doc_id"), (F.col("pos") * 100000 + F.expr("doc_id div 500")).alias("pos")))


@query(
    PIPELINE_SQL + ", k as (select doc_id, count(*) filter (salience < 0.3) as low, greatest(0, count(*) filter (salience >= 0.3) - 2) as over, list(substr(sentence, 1, 80) order by pos) filter (salience < 0.3) as e from p group by doc_id)"
    " select doc_id, coalesce(nullif(concat_ws('; ', case when low > 0 then 'salience_min=0.30 (' || low || ' skipped)' end, case when over > 0 then 'max_verify_claims=2 (' || over || ' skipped)' end), ''), 'no_caps_applied') as reason,"
    f" low + over as count, coalesce(array_to_string(e[:3], ' / '), '') as examples from k union all select doc_id, 'no_claims_detected', 0, '' from ({rel(X.DRAFTS)}) where doc_id not in (select doc_id from k)"
)
def verifier_skipped(spark, sf_dir):
    """What the verifier's budget leaves out."""
    docs = drafts(spark, sf_dir)
    found = claims.skipped_summary(claims.pipeline_claims(docs), 0.3, 2, docs=docs)
    return found.withColumn("examples", F.array_join("examples", " / "))


@query("select o_orderkey as id, regexp_matches(case o_orderkey % 3 when 0 then 'run-' || o_orderkey when 1 then 'run/' || o_orderkey else repeat('x', cast(o_custkey % 90 as int)) end, '^[A-Za-z0-9_-]{1,64}$') as valid from orders")
def run_id_valid(spark, sf_dir):
    """Run identifiers of allowed characters and length."""
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("run-"), F.col("o_orderkey"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("run/"), F.col("o_orderkey"))).otherwise(F.expr("repeat('x', cast(o_custkey % 90 as int))"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), name.rlike(r"(?d)^[A-Za-z0-9_-]{1,64}$").alias("valid"))


def profiles(spark, sf_dir):
    """What each profile asks for. It reads no table, so it isn't registered."""
    rows = [(p, len(rules), R.UNSUPPORTED_THRESHOLDS.get(p, 1.0), "BLOCK" if p in R.STRICT_ARTEFACTS else "HOLD" if p in R.FINAL_ARTEFACTS else "") for p, rules in R.BOUNDARY_PROFILES.items()]
    return spark.createDataFrame(rows, "profile string, rules int, threshold double, single_actor string")


@query(f"select id, case when lower(trim(reviewer)) = lower('REVIEWER ' || (id % 7)) and id % 2 = 0 then 'draft' when id % 2 = 0 then 'final-prose' else 'audit' end as role from ({rel(X.OVERRIDES)})")
def single_actor_role(spark, sf_dir):
    """G7."""
    role = F.when(F.col("id") % 2 == 0, "final-prose").otherwise("audit")
    writer = F.concat(F.lit("REVIEWER "), F.col("id") % 7)
    return X.load(spark, sf_dir, X.OVERRIDES).select("id", ledger.single_actor_role(F.col("reviewer"), writer, role).alias("role"))


FOOTER_SQL = (
    "'- **Override ovr_' || id || '** on gate **G' || (id % 4) || '** (failure: boundary)' || case when single_actor then ' (single-actor; artefact role downgraded)' else '' end || chr(10) || '  - Risk accepted: some risk' || chr(10)"
    " || '  - Compensating control: a second look' || chr(10) || '  - Escalation: peer_review' || chr(10) || '  - Reviewer: ' || reviewer || chr(10) || '  - Recorded: 2024-01-01T00:00:00Z'"
)


@query(f"select run_id, chr(10) || '## Overrides applied' || chr(10) || chr(10) || {lit(R.OVERRIDE_LEAD)} || chr(10) || chr(10) || string_agg({FOOTER_SQL}, chr(10) || chr(10) order by id) || chr(10) || chr(10) as footer from ({rel(X.OVERRIDES)}) group by run_id")
def override_footer(spark, sf_dir):
    """K14."""
    said = {"gate_id": F.concat(F.lit("G"), F.col("id") % 4), "failure_class": F.lit("boundary"), "risk_accepted": F.lit("some\n  risk"), "compensating_control": F.lit("a second look "), "escalation_path_taken": F.lit("peer_review"), "ts": F.lit("2024-01-01T00:00:00Z")}
    return ledger.override_footer(X.load(spark, sf_dir, X.OVERRIDES).withColumns(said))


@query(
    f"select coalesce(r.id, o.run_id) as run_id, r.total, coalesce(claims, 0) as claims, coalesce(overrides, 0) as overrides from ({rel(X.RUNS)}) r left join (select run_id, count(*) as claims from ({rel(X.CLAIM_ROWS)}) group by run_id) c on c.run_id = r.id"
    f" left join (select run_id, count(*) as overrides from ({rel(X.OVERRIDES)}) group by run_id) o on o.run_id = r.id"
)
def run_artefacts(spark, sf_dir):
    """Each run with what the other tables hold of it."""
    count = lambda r, name: X.load(spark, sf_dir, r).groupBy("run_id").agg(F.count(F.lit(1)).alias(name))
    joined = X.load(spark, sf_dir, X.RUNS).select(F.col("id").alias("run_id"), "total").join(count(X.CLAIM_ROWS, "claims"), "run_id", "left").join(count(X.OVERRIDES, "overrides"), "run_id", "left")
    return joined.fillna(0, ["claims", "overrides"])


@query(
    "select context_id, can_appear_in_final_prose or allowed_transformation <> 'none' as admitted, case when audit_status = 'audit_only' then 'audit-only material' when audit_status = 'excluded' then 'excluded class; cannot influence output'"
    f" when not can_appear_in_final_prose then 'process material; cannot appear in final prose' else '' end as reason from ({CLASSIFIED_SQL})"
)
def cbom_inputs(spark, sf_dir):
    """Items as inputs of a bill of materials, with why one isn't free."""
    return context.bill_inputs(classified(spark, sf_dir))


def conformance(spark, sf_dir):
    """Self-checks by status. It reads no table, so it isn't registered."""
    return probes.run(spark).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
