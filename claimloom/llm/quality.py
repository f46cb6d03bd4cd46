"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

A rule is a named measure with a lowest and a highest value; ``RULES`` is the production table. ``judge`` adds a column per
measure and, from the compiled table, whether a text is kept. Words are the runs of ``[^\\x20\\x09-\\x0D]``; lines are cut at
``\\n``.

Defined results: a null or empty text has no words, measures 0 and isn't kept; ratios over nothing are 0; repeated rows are
judged alike, each by itself; columns of the input stay as they are, and measures go to one struct column whose name is
made distinct from theirs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.shared import WHITE, WHITE_CLASS, fresh, text_column

SYMBOLS = "#*$%&|<>"
#: Common function words of the corpus's languages: English, French, German, Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not are this or an at from which have has had but "
    "le la les de des du un une et en est que qui dans pour sur au aux par il elle ne pas se ce avec plus "
    "der die das und in den von zu mit sich ist im dem nicht ein eine auf für als auch es an werden aus er hat "
    "el los las y a que del por con una su para al lo como más o pero sus le ya este"
).split()


@dataclass(frozen=True)
class Rule:
    """A text fails where ``measure`` is below ``low`` or above ``high``, if it has at least ``from_words`` words."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: Lengths, then symbols, stop words and lines; ratios are per word or per line.
RULES = (
    Rule("too_few_words", "n_words", low=20),
    Rule("word_too_short", "mean_word_chars", low=2.0),
    Rule("word_too_long", "mean_word_chars", high=14.0),
    Rule("symbols", "symbols_a_word", high=0.25),
    Rule("shouting", "exclamations_a_word", high=0.4),
    Rule("stop_words", "stop_words_a_word", low=0.01, from_words=50),
    Rule("repeated_lines", "repeated_line_share", high=0.5),
    Rule("repeated_words", "repeated_word_share", high=0.30),
    Rule("bullets", "bullet_line_share", high=0.9),
    Rule("ellipses", "ellipsis_line_share", high=0.5),
)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_words(words: Column, n: int = 8) -> Column:
    """Words that lie in an ``n``-word window found twice or more, each counted once.

    A text all of whose windows hash differently has none. In the others, windows are sorted as strings with their places;
    those equal to a neighbour are found twice, and the union of their places is summed in order.
    """
    last = F.size(words) - n + 1  # number of windows
    hashes = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, n)))

    def covered(s: Column) -> Column:
        same_as_next = F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.coalesce(a["k"] == b["k"], F.lit(False)))

        def places(e: Column) -> Column:
            either = F.zip_with(e, F.concat(F.array(F.lit(False)), e), lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)))
            marked = F.filter(F.zip_with(s, either, lambda x, y: F.when(y, x["i"])), lambda i: i.isNotNull())
            return F.array_sort(marked)

        def total(p: Column) -> Column:
            steps = F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.least(F.lit(n), F.coalesce(b - a, F.lit(n))))
            return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

        return _let(_let(same_as_next, places), total)

    windows = F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(F.array_join(F.slice(words, i, n), " ").alias("k"), i.alias("i")))
    exact = _let(F.array_sort(windows), covered)
    twice = _let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(last > 1, F.when(twice, exact).otherwise(F.lit(0))).otherwise(F.lit(0)).cast("long")


def base_measures(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Counts by name; ``words`` and ``lines`` (those with a word) are arrays."""
    stops = sorted({form for w in STOP_WORDS for form in (w, w.capitalize(), w.upper())})
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(_without(text, WHITE)).cast("long"),
        "n_symbols": (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_words(words),
        "n_lines": F.size(lines).cast("long"),
        "n_exclamations": F.length(text) - F.length(_without(text, "!")),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(stops))),
        "n_bullets": F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\t]*[-*•‣]"))),
        "n_ellipses": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\t\r]*$"))),
    }


def ratios(base: dict[str, Column]) -> dict[str, Column]:
    """Ratios by name."""
    words, lines = base["n_words"], base["n_lines"]
    return {
        "mean_word_chars": _share(base["word_chars"], words),
        "symbols_a_word": _share(base["n_symbols"], words),
        "exclamations_a_word": _share(base["n_exclamations"], words),
        "stop_words_a_word": _share(base["n_stop_words"], words),
        "repeated_line_share": _share(base["n_dup_lines"], lines),
        "repeated_word_share": _share(base["n_repeat_words"], words),
        "bullet_line_share": _share(base["n_bullets"], lines),
        "ellipsis_line_share": _share(base["n_ellipses"], lines),
    }


def measured(text: Column) -> Column:
    """All counts and ratios of a text as a struct.

    Words and lines, and then the counts, are bound as variables of the expression. However the optimizer moves or repeats
    references to the struct, within it each is computed once.
    """
    parts = F.struct(
        F.array_remove(F.split(text, WHITE_CLASS + "+"), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: _without(x, WHITE) != "").alias("lines"),
    )
    base = _let(parts, lambda p: F.struct(*[c.alias(k) for k, c in base_measures(text, p["words"], p["lines"]).items()]))
    names = base_measures(text, F.array(F.lit("")), F.array(F.lit(""))).keys()

    def every(b: Column) -> Column:
        counts = {k: b[k] for k in names}
        return F.struct(*[c.alias(k) for k, c in (counts | ratios(counts)).items()])

    return _let(base, every)


def failed(rules: Sequence[Rule], measures: Column) -> Column:
    """The names of the rules that a text's measures (a struct) fail: the table as one expression."""

    def fails(rule: Rule, m: Column) -> Column:
        value, out = m[rule.measure], F.lit(False)
        if rule.low is not None:
            out = out | (value < rule.low)
        if rule.high is not None:
            out = out | (value > rule.high)
        return out & (m["n_words"] >= rule.from_words)

    return _let(measures, lambda m: F.array_compact(F.array(*[F.when(fails(rule, m), F.lit(rule.name)) for rule in rules])))


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES) -> tuple[DataFrame, str, str]:
    """``docs`` with a struct of measures and an array of failed rules; the names of these two columns."""
    m, bad = fresh(docs.columns, "_measures"), fresh(docs.columns, "_failed")
    return docs.withColumn(m, measured(text_column())).withColumn(bad, failed(rules, F.col(m))), m, bad


def keep(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents that fail no rule, with their own columns."""
    return docs.where(F.size(failed(rules, measured(text_column()))) == 0)
