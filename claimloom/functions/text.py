"""Text as arrays of sentences and lines, and small text functions, all as Spark expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from html.parser import HTMLParser
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a line besides a line feed; a carriage return takes the line feed after it along.
LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
#: White space after ``.!?``, line feeds, or a bullet with a space before it. White space is looked for first, as most places have none.
SENTENCE_END = r"(?Ud)\s(?:(?<=[.!?]\s)\s*|(?<=\n)\n*|[-*]\s+)"


#: White space as Unicode has it, what ``(?U)\\s`` finds.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def by_letters(text: Column, pattern: str, made: Callable[[str], Column], plain: str | None = None) -> Column:
    """``made`` of a pattern that begins with ``(?Ud``, or for texts of ASCII only of the same without Unicode classes, or of ``plain``.

    Unicode classes and word boundaries take longer, and in ASCII find the same.
    """
    return F.when(F.octet_length(text) == F.length(text), made(plain or pattern.replace("(?Ud", "(?d", 1))).otherwise(made(pattern))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(SPACE))


def sentences(text: Column) -> Column:
    """Sentences in order; cut after ``.!?``, at line ends and at bullets.

    What is between sentences becomes a line feed, which no sentence has, as ``split`` by a pattern compiles it for each text.
    """
    led = F.concat(F.lit(" "), text)  # a bullet at the very beginning has none
    cut = by_letters(text, SENTENCE_END, lambda p: F.regexp_replace(led, p, "\n"))
    return F.filter(F.transform(F.split(cut, "\n", -1), strip), lambda s: s != "")


def once(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def lines(text: Column) -> Column:
    """Lines in order; a line end at the very end begins no line."""
    other = reduce(or_, [F.contains(text, F.lit(c)) for c in LINE_ENDS])
    fed = F.when(other, F.regexp_replace(text, f"\r\n?|[{LINE_ENDS}]", "\n")).otherwise(text)
    return once(F.split(fed, "\n", -1), lambda found: F.when(F.element_at(found, -1) == "", F.slice(found, F.lit(1), F.size(found) - 1)).otherwise(found))


def truncate(text: Column, most: int) -> Column:
    """Cut to ``most`` characters, the last three being dots."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def fence_mask(found: Column) -> Column:
    """For each line, whether it lies outside fenced code.

    A fence is opened by three backticks or tildes, indented by at most three spaces, and closed by the same mark; the fence
    lines count as inside, and a fence that isn't closed runs on to the end.
    """
    mark = lambda line: F.when(F.contains(line, F.lit("```")) | F.contains(line, F.lit("~~~")), F.regexp_extract(line, r"^ {0,3}(```|~~~)", 1))
    letters = F.array_join(F.transform(found, lambda line: F.when(mark(line) == "```", "b").when(mark(line) == "~~~", "t").otherwise("-")), "")  # one for each line
    blocks = F.regexp_extract_all(letters, F.lit("b[^b]*(?:b|$)|t[^t]*(?:t|$)|-+"), F.lit(0))
    outside = F.array_join(F.transform(blocks, lambda x: F.repeat(F.when(F.startswith(x, F.lit("-")), "1").otherwise("0"), F.length(x))), "")
    return F.transform(F.slice(F.split(outside, ""), F.lit(1), F.size(found)), lambda x: x == "1")


def rounded(value: Column, digits: int) -> Column:
    """Half-even rounding of the exact binary value, as printing does it."""
    return F.regexp_replace(F.format_number(value, digits), ",", "").cast("double")


def density_score(findings: Column, scanned: Column) -> Column:
    """round(10 d / (d + 1), 1) of the findings per scanned file, 0 without any."""
    d = findings / scanned
    return F.when((findings <= 0) | (scanned <= 0), F.lit(0.0)).otherwise(rounded(10.0 * d / (d + 1.0), 1))


def parse_timestamp(text: Column) -> Column:
    """A timestamp in UTC from ISO forms with ``Z``, an offset or none, a space, or a date only; else null."""
    clean = F.regexp_replace(F.trim(text), "Z$", "+00:00")
    valid = clean.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?([+-]\d{2}:?\d{2})?)?$")
    return F.when(valid, F.try_to_timestamp(F.regexp_replace(clean, ",", ".")))


def squash(text: Column) -> Column:
    """P25: lower case, each run of white space one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def base64url(data: Column) -> Column:
    """URL-safe base64 without padding."""
    return F.rtrim(F.translate(F.base64(data), "+/", "-_"), F.lit("="))


def canonical_json(struct: Column) -> Column:
    """JSON of a struct whose fields are in alphabetical order, nulls kept, everything but ASCII as ``\\uXXXX``."""
    text = F.to_json(struct, {"ignoreNullFields": "false"})

    def escaped(c: Column) -> Column:
        units = F.lower(F.hex(F.encode(c, "UTF-16BE")))  # one or two of four digits
        return F.when((F.octet_length(c) == 1) & (c != "\x7f"), c).otherwise(F.regexp_replace(units, "(.{4})", r"\\u$1"))

    low = text  # control characters come out of Spark with upper-case digits; a backslash of the text's own is doubled
    for digit in "ABCDEF":
        low = F.regexp_replace(low, rf"(?<!\\)((?:\\\\)*)\\u00([01]){digit}", rf"$1\\u00$2{digit.lower()}")
    text = F.when(text.rlike(r"\\u00[01][A-F]"), low).otherwise(text)
    whole = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), escaped), "")
    return F.when(text.rlike(r"[^\x00-\x7e]"), whole).otherwise(text)


class _Text(HTMLParser):
    """The data of a page outside of scripts and styles."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.unseen = False

    def handle_starttag(self, tag, attrs):
        self.unseen = self.unseen or tag in ("script", "style")

    def handle_endtag(self, tag):
        self.unseen = self.unseen and tag not in ("script", "style")

    def handle_data(self, data):
        if not self.unseen and data.strip():
            self.parts.append(data)


def _page_text(html: str) -> str:
    page = _Text()
    page.feed(html)
    page.close()
    return " ".join(" ".join(page.parts).split())


def html_to_text(html: Column) -> Column:
    """Text of a page: scripts and styles dropped, tags as spaces, all entities decoded, white space collapsed.

    Names of entities and malformed markup are beyond SQL functions, so this is an Arrow-batched function.
    """

    @F.pandas_udf("string")
    def read(pages: pd.Series) -> pd.Series:
        return pages.map(_page_text, na_action="ignore")

    return read(html)
