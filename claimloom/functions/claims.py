"""Claim expressions: triggers, citations, salience, salient tokens and heuristic grades of a sentence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions import rules as R
from claimloom.functions.text import by_letters


def matches(text: Column, rule: R.Rule) -> Column:
    return by_letters(text, rule.java, text.rlike, by_initials([rule]))


def all_of(text: Column, rule: R.Rule) -> Column:
    """All matches of a rule, in order."""
    return by_letters(text, rule.java, lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0)))


def alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern, outside of all groups and classes."""
    out, start, depth, i, in_class = [], 0, 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]]


def combined(rules: Sequence[R.Rule]) -> str:
    """One pattern that finds something where any rule does.

    Alternatives that begin at a word boundary share one test for it, so that most places of a text are passed at once.
    """
    at_words: dict[str, list[str]] = {}
    others: dict[str, list[str]] = {}
    for r in rules:
        flags = "".join(sorted(set(r.flags)))
        for part in alternatives(r.pattern):
            if part.startswith(r"\b"):
                at_words.setdefault(flags, []).append(part[2:])
            elif part.startswith(r"(?i:\b"):
                at_words.setdefault(flags, []).append("(?i:" + part[6:])
            else:
                others.setdefault(flags, []).append(part)
    joined = lambda groups: "|".join(f"(?{flags}:{'|'.join(parts)})" for flags, parts in groups.items())
    words = [rf"\b(?:{joined(at_words)})"] if at_words else []
    return "(?Ud)" + "|".join([*words, *([joined(others)] if others else [])])


def group_end(pattern: str) -> int:
    """Where the group or class that a pattern begins with ends; 0 if it begins with none."""
    if pattern[:1] not in ("(", "["):
        return 0
    depth, in_class, i = 0, False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        if not depth and not in_class:
            return i + 1
        i += 1
    return 0


def pieces(pattern: str) -> list[tuple[str, str, str]]:
    """A pattern's alternatives as (initial, head, rest): those of a leading group one by one, with what follows it.

    The initial is a lower-case letter, ``0`` for any digit, or empty where it isn't told.
    """
    found = []
    for part in alternatives(pattern):
        end = group_end(part) if part.startswith("(?:") or (part.startswith("(") and not part.startswith("(?")) else 0
        if end and part[end : end + 1] not in ("?", "*", "+", "{"):
            found += [(initial, head + rest, part[end:]) for initial, head, rest in pieces(part[3 if part.startswith("(?:") else 1 : end - 1])]
        else:
            one = part[:2] if part.startswith("\\") else part[:1]
            told = part[len(one) : len(one) + 1] not in ("?", "*", "{")
            initial = "0" if one == "\\d" or one.isdigit() else one.lower() if one.isascii() and one.isalpha() else ""
            found.append((initial if told else "", part, ""))
    return found


def by_initials(rules: Sequence[R.Rule]) -> str:
    """What ``combined`` finds something in, for texts of ASCII only: at a word only alternatives with its initial are tried.

    Where something is found first, and by which alternative, isn't told; so this is for tests, not for extraction.
    """
    at_words: dict[str, dict[tuple[str, str], list[str]]] = {}
    others: list[str] = []
    for r in rules:
        for part in alternatives(r.pattern):
            flags, end = "".join(sorted(set(r.flags))), group_end(part)
            if part.startswith("(?i:\\b") and end == len(part):
                flags, part = "".join(sorted({*flags, "i"})), part[4:-1]
            if not part.startswith("\\b") or len(alternatives(part)) > 1:
                others.append(f"(?{flags}:{part})")
                continue
            for initial, head, rest in pieces(part[2:]):
                at_words.setdefault(initial, {}).setdefault((flags, rest), []).append(head)
    merged = lambda groups: "|".join(f"(?{flags}:(?:{'|'.join(dict.fromkeys(heads))}){rest})" for (flags, rest), heads in groups.items())
    known = {"[0-9]" if i == "0" else f"[{i}{i.upper()}]": merged(groups) for i, groups in at_words.items() if i}
    words = [f"(?={''.join(c[1:-1] for c in known).join('[]')})(?:{'|'.join(f'(?={c})(?:{p})' for c, p in known.items())})"] if known else []
    words += [merged(at_words[""])] if "" in at_words else []
    return "(?d)" + "|".join([*([rf"\b(?:{'|'.join(words)})"] if words else []), *others])


def any_of(text: Column, rules: Sequence[R.Rule]) -> Column:
    """Whether any rule matches: one search for all of them, so that the text is computed once."""
    return by_letters(text, combined(rules), text.rlike, by_initials(rules))


def names_of(text: Column, rules: Sequence[R.Rule]) -> Column:
    """The names of the rules that match, in their order."""
    return F.array_compact(F.array(*[F.when(matches(text, r), F.lit(r.name)) for r in rules]))


def first_of(text: Column, rules: Sequence[R.Rule], otherwise: str | None = None) -> Column:
    """The name of the first rule that matches; later ones aren't tried."""
    found = None
    for r in rules:
        found = F.when(matches(text, r), r.name) if found is None else found.when(matches(text, r), r.name)
    return found.otherwise(F.lit(otherwise))


def triggers(sentence: Column) -> Column:
    """All claim triggers of a sentence."""
    return names_of(sentence, R.CLAIM_TRIGGERS)


def first_trigger(sentence: Column) -> Column:
    """P8."""
    return first_of(sentence, R.CLAIM_TRIGGERS)


def has_citation(sentence: Column) -> Column:
    """P10: any of five citation markers."""
    return any_of(sentence, R.CITATION_MARKERS)


def citation(sentence: Column) -> Column:
    """The first URL, else the first author and year in parentheses, else null."""
    first = lambda rule: F.get(all_of(sentence, rule), F.lit(0))
    return F.when(F.contains(sentence, F.lit("(")) | F.contains(sentence, F.lit("://")), F.coalesce(first(R.URL), first(R.APA)))


def leads_citation(sentence: Column) -> Column:
    """Whether a sentence is a citation, of the one before it."""
    return F.coalesce(matches(sentence, R.CITATION_LEAD), F.lit(False))


def claim_status(sentence: Column, following: Column) -> Column:
    """Supported by a citation in the sentence or by a next sentence that is one; else tagged; else unsupported."""
    supported = has_citation(sentence) | leads_citation(following)
    return F.when(supported, "supported").when(matches(sentence, R.CITE_NEEDED), "tagged").otherwise("unsupported")


def salience(sentence: Column) -> Column:
    """signals' weights added as doubles in their order, clamped to [0, 1].

    Descriptive attribution counts only where no decision signal does.
    """
    score = F.lit(0.0)
    decision = matches(sentence, dict((r.name, r) for r, _ in R.SALIENCE)["decision"])
    for rule, weight in R.SALIENCE:
        hit = matches(sentence, rule)
        if rule.name == "descriptive":
            hit = hit & ~decision
        score = score + F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def load_bearing(sentence: Column) -> Column:
    """P14."""
    return salience(sentence) >= R.LOAD_BEARING


def salient_tokens(claim: Column) -> Column:
    """Numbers, percentages and longer words, lower-cased, distinct, in the order of kind and place."""
    bare = by_letters(claim, R.URL.java, lambda p: F.regexp_replace(claim, p, ""))
    words = F.filter(F.transform(all_of(bare, R.WORD_TOKEN), F.lower), lambda w: ~w.isin(R.SALIENT_STOPS))
    numbers = F.transform(all_of(bare, R.NUMBER_TOKEN), F.lower)
    percents = F.transform(all_of(bare, R.PERCENT_TOKEN), F.lower)
    return F.array_distinct(F.concat(numbers, percents, words))


def heuristic_grade(claim: Column, source: Column, cited: Column) -> Column:
    """G1: verified if the source has every token of the claim, not_addressed if not; unverifiable with a citation only; else skipped."""
    text, tokens = F.lower(source), salient_tokens(claim)
    held = (F.size(tokens) > 0) & F.forall(tokens, lambda t: F.contains(text, t))
    has_source, has_citation_ = F.coalesce(source != "", F.lit(False)), F.coalesce(cited != "", F.lit(False))
    return F.when(has_source & held, "verified").when(has_source, "not_addressed").when(has_citation_, "unverifiable").otherwise("skipped")


def missing_tokens(claim: Column, source: Column, most: int = 3) -> Column:
    """The first tokens of a claim that its source lacks."""
    return F.slice(F.filter(salient_tokens(claim), lambda t: ~F.contains(F.lower(source), t)), 1, most)


def family(model: Column) -> Column:
    """A model identifier's family."""
    return F.coalesce(first_of(F.trim(model), R.FAMILIES), F.lit("unknown"))


def self_grounding(writer: Column, verifier: Column) -> Column:
    """Verdict on a writer and a verifier."""
    w, v = F.trim(F.coalesce(writer, F.lit(""))), F.trim(F.coalesce(verifier, F.lit("")))
    same_family = (family(w) != "unknown") & (family(w) == family(v))
    return F.when(v == "", "ok").when(F.lower(w) == F.lower(v), "requires_external_grounding").when(same_family, "family_match").otherwise("ok")
