"""Rule scans over lines: boundary, residue, style tells, contamination; and sensitivity of whole texts.

A scan searches each line once, by one pattern made of all rules. Only in lines where that finds something, each rule is
searched for, and only the rules that match are extracted. Equal lines of a batch are searched once for all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.functions import claims as C
from claimloom.functions import rules as R
from claimloom.functions.tables import join_left, once_a_batch
from claimloom.functions.text import density_score, fence_mask, lines, once, strip, truncate


def matches_of(content: Column, rules: Sequence[R.Rule]) -> Column:
    """All matches of all rules in a line, as (rule, tag, match), in the order of rules and places."""
    none = F.array().cast("array<struct<rule:string,tag:string,match:string>>")

    def of(rule: R.Rule) -> Column:
        every = F.transform(C.all_of(content, rule), lambda m: F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.tag).alias("tag"), m.alias("match")))
        return F.when(C.matches(content, rule), every).otherwise(none)

    return F.concat(none, *[of(r) for r in rules])


def shown_lines(text: Column, fences: bool = True) -> Column:
    """A text's lines; without ``fences``, those of fenced code are null. A null text has one empty line."""
    found = lines(F.coalesce(text, F.lit("")))
    if fences:
        return found
    fenced = lambda x: F.contains(x, F.lit("```")) | F.contains(x, F.lit("~~~"))
    outside = lambda a: F.zip_with(a, fence_mask(a), lambda x, out: F.when(out, x))
    return once(found, lambda a: F.when(F.exists(a, fenced), outside(a)).otherwise(a))


def findings(docs: DataFrame, rules: Sequence[R.Rule], key: str = "doc_id", fences: bool = True, cut: int | None = None) -> DataFrame:
    """A row per match, by line and place: key, line, seq, rule, tag, match.

    Without ``fences``, lines of fenced code are left out; ``cut`` shortens the match, with dots if they are. Lines are searched
    one by one, as in a whole text anchors and lookaheads would see other lines; equal ones of a batch once.
    """
    content = F.col("content")
    rows = docs.select(key, F.posexplode(shown_lines(F.col("text"), fences)).alias("_i", "content")).where("content is not null")
    hits = once_a_batch(rows.select(key, (F.col("_i") + 1).alias("line"), "content"), "content").where(C.any_of(content, rules) if rules else F.lit(False))
    shortened = lambda m: m if not cut else F.substring(m, 1, cut) if fences else truncate(m, cut)
    found = hits.select("places", F.posexplode(matches_of(content, rules)).alias("seq", "_m"))
    each = found.select(F.explode("places").alias("_p"), "seq", "_m.rule", "_m.tag", shortened(F.col("_m.match")).alias("match"))
    return each.select(f"_p.{key}", "_p.line", "seq", "rule", "tag", "match")


def boundary_rules(profile: str) -> Sequence[R.Rule]:
    """The boundary rules of a profile; those of final texts if it has none of its own."""
    return R.BOUNDARY_PROFILES.get(profile, R.BOUNDARY_PROFILES["final"])


def boundary(docs: DataFrame, profile: str = "final-prose", key: str = "doc_id") -> DataFrame:
    """violations of a profile's boundary rules; the tag is the severity."""
    return findings(docs, boundary_rules(profile), key)


def residue(docs: DataFrame, key: str = "doc_id", fences: bool = False) -> DataFrame:
    """residue outside fenced code, with categories, matches of at most 60 characters."""
    found = findings(docs, R.RESIDUE, key, fences, 60)
    category = F.create_map(*[F.lit(x) for pair in R.RESIDUE_CATEGORIES.items() for x in pair])
    return found.withColumn("tag", F.coalesce(category[F.col("rule")], F.lit("scaffold"))).withColumnRenamed("tag", "category")


def tells(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """style tells by line, outside fenced code."""
    return findings(docs, R.TELLS, key, False, 60).withColumnRenamed("tag", "category")


def told_in(text: Column, kind: str, said: Callable[[Column], Column]) -> Column:
    """Of a text with fenced lines blanked, cut after each ``.!?``, the sentences that ``said`` (of type ``kind``) isn't null of.

    An array of (pos, line, said), made in one pass over the sentences: neither they nor their line ends become rows.
    """
    item = f"struct<pos:int,line:int,said:{kind}>"
    ends = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    fenced = lambda found: F.exists(found, lambda x: F.contains(x, F.lit("```")) | F.contains(x, F.lit("~~~")))
    blank = lambda found: F.zip_with(found, fence_mask(found), lambda x, out: F.when(out, x).otherwise(F.lit("")))
    shown = once(lines(F.coalesce(text, F.lit(""))), lambda found: F.array_join(F.when(fenced(found), blank(found)).otherwise(found), "\n"))
    parts = F.regexp_extract_all(shown, F.lit(r"(?d)[^.!?]*[.!?]|[^.!?]+\z"), F.lit(0))

    def step(a: Column, raw: Column) -> Column:
        line = lambda: (F.lit(1) + a["ends"] + ends(F.regexp_extract(raw, r"(?U)^\s*", 0))).cast("int")
        found = once(said(strip(raw)), lambda v: F.when(v.isNull(), a["found"]).otherwise(F.array_append(a["found"], F.struct(a["pos"].alias("pos"), line().alias("line"), v.alias("said")).cast(item))))
        return F.struct((a["pos"] + 1).alias("pos"), (a["ends"] + ends(raw)).alias("ends"), found.alias("found"))

    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("ends"), F.array().cast(f"array<{item}>").alias("found"))
    return F.aggregate(parts, start, step, lambda a: a["found"])


def hedge_stacking(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """sentences with two or more hedges."""
    stacked = lambda s: F.when(C.matches(s, R.HEDGES) & (F.size(C.all_of(s, R.HEDGES)) >= 2), truncate(s, 60))
    return docs.select(key, F.explode(told_in(F.col("text"), "string", stacked)).alias("_t")).select(key, "_t.line", F.col("_t.said").alias("match"))


def formulaic(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sentences with a formulaic opener, from the second of a document on."""

    def opener(s: Column) -> Column:
        return F.coalesce(*[F.when(F.startswith(s, F.lit(marker)), F.lit(name)) for name, marker in R.FORMULAIC])

    some = F.coalesce(*[F.when(F.contains("text", F.lit(marker)), F.lit(True)) for _, marker in R.FORMULAIC])
    rows = docs.where(some).select(key, F.explode(told_in(F.col("text"), "string", opener)).alias("_t")).select(key, "_t.*")
    nth = F.row_number().over(Window.partitionBy(key).orderBy("pos", "line"))
    return rows.withColumn("nth", nth).where("nth >= 2").select(key, "line", F.col("said").alias("rule"), "nth")


def in_order(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """T4: findings as reports list them, by document, line, rule and match."""
    return found.orderBy(key, "line", "rule", "match")


def contamination(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """prompt-like text, matches of at most 120 characters."""
    return findings(docs, R.CONTAMINATION, key, True, 120).drop("tag")


def contamination_verdict(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """blocked or pass, per document; rows that share a key, or have none, are judged together."""
    found = contamination(docs, key).groupBy(key).agg(F.count(F.lit(1)).alias("n_matches"))
    joined = join_left(docs.select(key), found, key)
    return joined.select(key, F.coalesce("n_matches", F.lit(0)).alias("n_matches"), F.when(F.col("n_matches") > 0, "blocked").otherwise("pass").alias("verdict"))


def score(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: files scanned, findings and density score."""
    both = docs.agg(F.count(F.lit(1)).alias("files")).crossJoin(found.agg(F.count(F.lit(1)).alias("findings")))  # two single rows
    return both.select("files", "findings", density_score(F.col("findings"), F.col("files")).alias("score"))


def sensitivity(docs: DataFrame, key: str = "doc_id", floor: str = "official") -> DataFrame:
    """Per document the rules that match and the highest tier, at least ``floor``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    alike = reduce(or_, [F.contains(text, F.lit(c)) for c in R.ASCII_ALIKE])  # such letters may stand for those of a hint
    hinted = lambda x, r: reduce(or_, [F.contains(x["low"], F.lit(h)) for h in R.SENSITIVITY_HINTS[r.name]], x["alike"])
    named = lambda x: F.array_compact(F.array(*[F.when(hinted(x, r) & C.matches(text, r), F.lit(r.name)) for r in R.SENSITIVITY]))
    names = once(F.struct(F.lower(text).alias("low"), alike.alias("alike")), named)
    of_rule = F.create_map(*[F.lit(x) for r in R.SENSITIVITY for x in (r.name, R.TIERS[r.tag])])
    ranked = lambda n: F.struct(n.alias("rules"), F.aggregate(n, F.lit(R.TIERS[floor]), lambda a, x: F.greatest(a, of_rule[x])).alias("rank"))
    found = docs.select(key, once(names, ranked).alias("_f"))  # each rule is searched for once, and only where a hint of it is
    rank = F.col("_f.rank")
    tier = F.element_at(F.array(*[F.lit(t) for t in sorted(R.TIERS, key=R.TIERS.get)]), rank + 1)
    return found.select(key, "_f.rules", rank.alias("rank"), tier.alias("tier"), (rank >= R.TIERS["sensitive"]).alias("blocks"))


def gate(docs: DataFrame, strict: bool = False) -> DataFrame:
    """F8: documents of tiers that don't block; ``strict`` fails the job instead."""
    text = F.coalesce(F.col("text"), F.lit(""))
    blocks = C.any_of(text, [r for r in R.SENSITIVITY if R.TIERS[r.tag] >= R.TIERS["sensitive"]])
    if strict:
        return docs.where(F.assert_true(~blocks, F.lit("a document is of a tier that blocks")).isNull())
    return docs.where(~blocks)
