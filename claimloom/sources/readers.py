"""Readers: document trees, JSON and JSONL inputs, transcripts and tool events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.text import html_to_text, lines, strip

# fixed values: suffixes that count as documents, folders that are passed over
SUFFIXES = ("md", "rst", "txt")
SKIPPED = (".git", "node_modules", "__pycache__", ".venv", "venv", "dist")


def documents(spark: SparkSession, *paths: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Path and text of the documents below the paths, each once; bytes that are no UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(list(paths))
    skipped = "/(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/"
    return files.where(~F.col("path").rlike(skipped)).dropDuplicates(["path"]).select("path", "modificationTime", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def display_path(path: Column, *folders: str) -> Column:
    """S3: a file's path below the first of the folders that holds it (the working folder, then the one read), else in full."""
    plain = F.regexp_replace(path, "^file:(//)?(?=/)", "")
    below = []
    for folder in folders:
        head = folder.removeprefix("file://").rstrip("/") + "/"
        below.append(F.when(F.startswith(plain, F.lit(head)), F.substr(plain, F.lit(len(head) + 1))))
    return F.coalesce(*[F.nullif(b, F.lit("")) for b in below], plain)


def latest_document(files: DataFrame) -> DataFrame:
    """The path that was modified last."""
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def context_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of a JSON array, of an object's ``items``, or of a text's lines, with ids by place where they have none.

    An element that is no object is an item whose text it is. An object without ``items`` has none; JSON of any other form, and what
    begins like JSON and is none, fail.
    """
    raw = spark.read.text(path, wholetext=True).select(strip(F.col("value")).alias("v"))
    whole = F.parse_json("v")
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    listed = F.when(F.startswith(F.col("v"), F.lit("[")), whole).otherwise(F.variant_get(whole, "$.items", "variant"))
    none = F.array().cast("array<variant>")
    wrong = F.raise_error(F.lit("context JSON must be a list or an object with an items list")).cast("array<variant>")
    there = F.when(listed.isNull(), none).when(F.startswith(kind(listed), F.lit("ARRAY")), F.variant_get(listed, "$", "array<variant>")).otherwise(wrong)
    is_json = F.startswith(F.col("v"), F.lit("[")) | F.startswith(F.col("v"), F.lit("{"))

    def given(v: Column, *names: str) -> Column:
        """The first field that holds something."""
        found = []
        for name in names:
            field = F.try_variant_get(v, f"$.{name}", "variant")
            text = F.try_variant_get(v, f"$.{name}", "string")
            empty = (text == "") | (kind(field) != "STRING") & text.isin("0", "0.0", "false")
            found.append(F.when(~empty, text))
        return F.coalesce(*found)

    def item(v: Column) -> Column:
        own = F.startswith(kind(v), F.lit("OBJECT"))
        plain = F.when(kind(v) == "VOID", "None").when(kind(v) == "BOOLEAN", F.initcap(v.cast("string"))).when(kind(v) == "STRING", v.cast("string")).otherwise(F.to_json(v))
        fields = {"context_id": given(v, "id", "context_id"), "text": given(v, "text", "raw_text"), "source": given(v, "source"), "source_agent": given(v, "source_agent")}
        return F.struct(*[F.when(own, c).otherwise(plain if name == "text" else None).alias(name) for name, c in fields.items()])

    text_lines = F.filter(F.transform(lines(F.col("v")), strip), lambda x: x != "")
    line = lambda x: F.struct(F.lit(None).cast("string").alias("context_id"), x.alias("text"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("source_agent"))
    rows = raw.where(is_json).select(F.posexplode(F.transform(there, item)).alias("pos", "i")).union(raw.where(~is_json).select(F.posexplode(F.transform(text_lines, line)).alias("pos", "i")))
    return rows.select(F.coalesce("i.context_id", F.format_string("context_%03d", F.col("pos") + 1)).alias("context_id"), F.coalesce("i.text", F.lit("")).alias("text"), "i.source", "i.source_agent")


def string_map(text: Column) -> Column:
    """A JSON object as a map of strings."""
    return F.from_json(text, "map<string,string>")


SHADOW = "ts string, brief string, profile string, shadow_status string, verdict string, boundary_verdict string, boundary_violations int, claims_detected int, claims_supported int, context_items int"


def shadow_log(lines: DataFrame) -> DataFrame:
    """Rows of JSON lines (value); blank ones are passed over, those that are no object are marked malformed."""
    rows = lines.where(F.trim("value") != "").withColumn("_r", F.from_json("value", SHADOW + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    bad = ~F.startswith(F.ltrim("value"), F.lit("{")) | F.col("_r._bad").isNotNull() | F.col("_r").isNull()
    names = [f.split()[0] for f in SHADOW.split(", ")]
    return rows.select(*[F.when(~bad, F.col(f"_r.{n}")).alias(n) for n in names], bad.alias("malformed"))


def last_assistant(turns: DataFrame) -> DataFrame:
    """Per conversation the last assistant turn that has a text."""
    said = turns.where((F.col("role") == "assistant") & (F.coalesce("text", F.lit("")) != ""))
    return said.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


def written_text(event: Column) -> Column:
    """The text of a tool event: its content, its new string, or its edits' new strings by line."""
    at = lambda path: F.get_json_object(event, f"$.tool_input.{path}")
    edits = F.from_json(at("edits"), "array<struct<new_string:string>>")
    joined = F.array_join(F.transform(edits, lambda e: e["new_string"]), "\n")
    return F.coalesce(at("content"), at("new_string"), F.nullif(joined, F.lit("")))


def source_texts(pages: DataFrame) -> DataFrame:
    """Url and text of fetched pages; fetching itself is left to whoever fills the table."""
    return pages.select("url", html_to_text(F.coalesce("html", F.lit(""))).alias("source_text"))
