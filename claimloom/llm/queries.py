"""The registered queries over the training-data operators, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.tables import spread
from claimloom.llm import chat, codes, exact_dedup, html_text, mixing, near_dedup, packing, quality, repeats, resampling, sstable, token_counts, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return sstable.read_shards(sstable.write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_pages(warc.write_pages(_table(spark, sf_dir, "pages")), payload=False)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return chat.digest(chat.format_turns(turns, vocabulary), vocabulary)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed, (turn, place, within, weight) = mixing.mix_sources(docs, vocabulary=public_tokenizers.path("word_bpe_49k.json"))
    return mixed.select("doc_id", "source", F.col(turn).alias("pass"), F.col(place).alias("block"), F.col(within).alias("place"), F.col(weight).alias("weight"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found, m, bad = quality.judge(docs)
    m = F.col(m)
    base_failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    digest = [m[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return found.select("doc_id", *digest, base_failed.alias("base_failed"), (~base_failed & (F.size(bad) == 0)).alias("kept"), F.array_join(bad, ",").alias("failed_rules"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, text = html_text.extract(_table(spark, sf_dir, "pages").select("page_id", "html"))
    return found.select("page_id", F.col(text).alias("text"), F.length(text).cast("long").alias("text_chars"), F.sha2(text, 256).alias("text_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.group(_table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.group(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.find(_table(spark, sf_dir, "documents"), length=100).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resampling.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return resampling.draw(rows, percent=5, least=20).select("doc_id", "n_features", "weight", "score", "rank")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.encode(_table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES = {
    "op1_sstable": op1_sstable,
    "op2_warc": op2_warc,
    "op3_token_counts": op3_token_counts,
    "op4_chat": op4_chat,
    "op5_packing": op5_packing,
    "op6_mixing": op6_mixing,
    "op7_quality": op7_quality,
    "op8_html_text": op8_html_text,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_near_dedup": op10_near_dedup,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_target_resampling": op12_target_resampling,
    "op13_vector_codes": op13_vector_codes,
}

def _quality_sql() -> str:
    """The base counts by lists and windows, and the rule table as conditions."""
    stops = sorted({form for w in quality.STOP_WORDS for form in (w, w.capitalize(), w.upper())})
    fails = []
    for rule in quality.RULES:
        tests = [f"{rule.measure} {op} {bound}::DOUBLE" for op, bound in (("<", rule.low), (">", rule.high)) if bound is not None]
        fails.append(f"(({' or '.join(tests)}) and n_words >= {rule.from_words})")
    names = ", ".join(f"case when {x} then '{r.name}' end" for x, r in zip(fails, quality.RULES))
    of = lambda part, whole: f"case when {whole} > 0 then {part}::DOUBLE / {whole} else 0 end"
    return rf"""
        with d as (
            select doc_id, coalesce(text, '') as t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
            from documents
        ), starts as (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d where len(w) > 7),
        win as (select doc_id, i, count(*) over (partition by doc_id, array_to_string(w[i : i + 7], ' ')) as n from starts),
        cover as (select doc_id, count(distinct i + o) as n_repeat_words from win, (select unnest(range(8)) as o) where n > 1 group by doc_id),
        c as (
            select d.doc_id, len(w) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
                len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, len(l) as n_lines, length(t) - length(replace(t, '!', '')) as n_exclamations,
                len(list_filter(w, lambda x: list_contains([{", ".join(repr(x) for x in stops)}], x))) as n_stop_words,
                len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\t]*[-*•‣]'))) as n_bullets, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\t\r]*$'))) as n_ellipses
            from d left join cover using (doc_id)
        ), m as (
            select *, {of("word_chars", "n_words")} as mean_word_chars, {of("n_symbols", "n_words")} as symbols_a_word, {of("n_exclamations", "n_words")} as exclamations_a_word, {of("n_stop_words", "n_words")} as stop_words_a_word,
                {of("n_dup_lines", "n_lines")} as repeated_line_share, {of("n_repeat_words", "n_words")} as repeated_word_share, {of("n_bullets", "n_lines")} as bullet_line_share, {of("n_ellipses", "n_lines")} as ellipsis_line_share from c
        ), v as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, list_filter([{names}], lambda x: x is not null) as failed_rules from m)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and len(failed_rules) = 0 as kept, array_to_string(failed_rules, ',') as failed_rules from v
    """


#: Escapes, and what a turn's marks add, as in ``chat.render``.
_ESCAPES = r"length(regexp_replace({0}, '[^\\<>]', '', 'g'))"
_CHAT_SQL = rf"""
    with t as (
        select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
        union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
    )
    select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
        coalesce(sum(length(text)) filter (role = 'assistant'), 0) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
        sum(17 + length(role) + {_ESCAPES.format('role')} + length(role) - length(replace(role, chr(10), '')) + length(text) + {_ESCAPES.format('text')}) as formatted_chars
    from t group by conv_id
"""
#: All pairs that share a shingle, and what can be reached over links.
_NEAR_SQL = r"""
    with recursive d as (
        select doc_id, list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda x: x <> '') as w from documents
    ), p as (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) as i from d where len(w) > 0),
    s as (select distinct doc_id, case when len(w) < 4 then array_to_string(w, ' ') || chr(10) else array_to_string(w[i : i + 3], ' ') end as g from p),
    n as (select doc_id, count(*) as n from s group by doc_id),
    links as (
        select x.doc_id as a, y.doc_id as b from s x join s y on x.g = y.g and x.doc_id <> y.doc_id join n as nx on nx.doc_id = x.doc_id join n as ny on ny.doc_id = y.doc_id
        group by x.doc_id, y.doc_id, nx.n, ny.n having 100 * count(*) >= 80 * (nx.n + ny.n - count(*))
    ), reach as (select doc_id as a, doc_id as b from d union select reach.a, links.b from reach join links on reach.b = links.a)
    select d.doc_id, coalesce(n, 0) as n_shingles, c as component_id, d.doc_id = c as kept from d left join n on n.doc_id = d.doc_id join (select a, min(b) as c from reach group by a) on a = d.doc_id
"""

#: Every string of 100 bytes, the spans of those that start earlier, and the gaps between them; bytes as two hex digits.
_REPEATS_SQL = """
    with d as materialized (select doc_id, octet_length(encode(coalesce(text, ''))) as n, hex(encode(coalesce(text, ''))) as hx from documents),
    s as (select doc_id, unnest(range(0, greatest(n - 99, 0))) as i, hx from d),
    w as (select doc_id, i, substr(hx, 2 * i + 1, 200) as g from s),
    hit as (select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) as k from w) where k > 1),
    mark as (select doc_id, i, coalesce(i > lag(i) over (partition by doc_id order by i) + 100, true) as fresh from hit),
    island as (select doc_id, i, sum(fresh::int) over (partition by doc_id order by i) as k from mark),
    span as (select doc_id, k, min(i) as a, max(i) + 100 as b from island group by doc_id, k),
    gap as (
        select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as p, a as q from span
        union all select d.doc_id, coalesce(max(b), 0), max(n) from d left join span using (doc_id) group by d.doc_id
    ), kept as (select doc_id, coalesce(string_agg(substr(hx, 2 * p + 1, 2 * (q - p)), '' order by p), '') as hx from gap join d using (doc_id) group by doc_id),
    lost as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans from span group by doc_id)
    select d.doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(kept.hx)) as kept_sha256
    from d join kept on kept.doc_id = d.doc_id left join lost on lost.doc_id = d.doc_id
"""


def _codes_sql() -> str:
    """Six rounds and a last assignment, all distances taken."""
    near = """a{0} as (
        select id, p, x, e, d from (
            select v.id, v.p, x, e, d, row_number() over (partition by v.id, v.p order by d, e) as k
            from (select v.id, v.p, x, e, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) as d from v join b{0} using (p)) as v
        ) where k = 1)"""
    mean = """s{0} as (select p, e, i, sum(x[i]) as s, count(*) as n from (select p, e, x, unnest(range(1, len(x) + 1)) as i from a{0}) group by p, e, i),
        m{0} as (select p, e, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as c from s{0} group by p, e),
        b{1} as (select b{0}.p, b{0}.e, coalesce(m{0}.c, b{0}.c) as c from b{0} left join m{0} on m{0}.p = b{0}.p and m{0}.e = b{0}.e)"""
    rounds = ", ".join(f"{near.format(r)}, {mean.format(r, r + 1)}" for r in range(codes.ROUNDS))
    return f"""
        with kept as (
            select vec_id, label, list_transform(embedding, lambda x: floor({codes.SCALE} * x::double)::bigint) as q, row_number() over (order by vec_id) as id from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
        ), v as (select id, p, list_slice(q, p * len(q) // {codes.PARTS} + 1, (p + 1) * len(q) // {codes.PARTS}) as x from (select id, q, unnest(range(0, {codes.PARTS})) as p from kept)),
        b0 as (select p, id - 1 as e, x as c from v where id <= {codes.ENTRIES}), {rounds}, {near.format(codes.ROUNDS)},
        digest as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from b{codes.ROUNDS}),
        coded as (select id, string_agg(lpad(to_hex(e), 2, '0'), '' order by p) as code, sum(d)::bigint as error from a{codes.ROUNDS} group by id)
        select vec_id, lower(code) as code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from coded join kept using (id) cross join digest
    """


ORACLE_SQL: dict[str, str] = {
    "op4_chat": _CHAT_SQL,
    "op7_quality": _quality_sql(),
    "op10_near_dedup": _NEAR_SQL,
    "op11_suffix_dedup": _REPEATS_SQL,
    "op13_vector_codes": _codes_sql(),
    "op9_exact_dedup": r"""
        with n as (
            select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents
        ), g as (
            select norm, min(doc_id) as keep_id, count(*) as group_size from n group by norm
        )
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256
        from n join g using (norm)
    """,
}
