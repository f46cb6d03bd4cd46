"""Documents as a data source, a row per file with its text or what kept it from being read; and run artefacts as a data sink.

Both work with plain paths and with URIs that Arrow's file systems know.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from claimloom.sources.readers import SKIPPED, SUFFIXES

#: fixed values: the files of a run's artefacts
PARTS = ("verdict", "cbom", "context_items", "boundary", "claims", "verifier")
FOOTER = "footer.md"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), os.path.abspath(uri.removeprefix("file:"))


def listed(uri: str, suffixes: tuple[str, ...]) -> list[str]:
    """The files that a path names, resolved: itself whatever its suffix, or the documents below it outside of skipped folders."""
    files, path = file_system(uri)
    kind = files.get_file_info(path).type
    if kind == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    prefix = "" if isinstance(files, fs.LocalFileSystem) else uri.split("://", 1)[0] + "://"
    resolve = os.path.realpath if not prefix else lambda p: prefix + p
    if kind == fs.FileType.File:
        return [resolve(path)]
    wanted = lambda name: name.rsplit(".", 1)[-1] in suffixes and "." in name
    out = []
    if not prefix:  # a link that leads nowhere is a file that can't be read
        for folder, below, names in os.walk(path):
            below[:] = sorted(d for d in below if d not in SKIPPED)
            out += [resolve(os.path.join(folder, n)) for n in sorted(names) if wanted(n)]
        return out
    for info in sorted(files.get_file_info(fs.FileSelector(path, recursive=True)), key=lambda i: i.path):
        inner = info.path[len(path) :].split("/")
        if info.type == fs.FileType.File and wanted(inner[-1]) and not set(inner[:-1]) & set(SKIPPED):
            out.append(resolve(info.path))
    return out


@dataclass
class Files(InputPartition):
    paths: list[str]


class DocumentReader(DataSourceReader):
    def __init__(self, options):
        self.paths, self.suffixes = json.loads(options["paths"]), tuple(json.loads(options["suffixes"]))
        self.strict, self.each = options.get("strict", "false") == "true", int(options.get("files", "256"))

    def partitions(self):
        found = list(dict.fromkeys(f for p in self.paths for f in listed(p, self.suffixes)))  # each file once
        return [Files(found[i : i + self.each]) for i in range(0, len(found), self.each)] or [Files([])]

    def read(self, partition):
        for path in partition.paths:
            text = error = None
            try:
                files, name = file_system(path)
                with files.open_input_stream(name) as stream:
                    data = stream.read()
                text = data.decode("utf-8", "strict" if self.strict else "replace")
            except UnicodeDecodeError as e:
                error = f"not UTF-8 at byte {e.start}"
            except OSError as e:
                error = f"{type(e).__name__}: {e}"
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (path, text, error)], names=["path", "text", "error"])


class DocumentSource(DataSource):
    @classmethod
    def name(cls):
        return "documents"

    def schema(self):
        return "path string, text string, error string"

    def reader(self, schema):
        return DocumentReader(self.options)


def document_files(spark: SparkSession, *paths: str, suffixes: tuple[str, ...] = SUFFIXES, strict: bool = False, files: int = 256) -> DataFrame:
    """Path, text and error of each document, once: files that are named, whatever their suffix, and those below folders.

    A file that can't be read has an error and no text. Bytes that are no UTF-8 are replaced, or, if ``strict``, are an error. A path
    that isn't there raises when the rows are asked for.
    """
    spark.dataSource.register(DocumentSource)
    options = {"paths": json.dumps(paths), "suffixes": json.dumps(suffixes), "strict": str(strict).lower(), "files": str(files)}
    return spark.read.format("documents").options(**options).load()


@dataclass
class Written(WriterCommitMessage):
    folder: str
    runs: list[str]


class ArtefactWriter(DataSourceWriter):
    """Tasks write the folders of their runs below a folder of their own; only those of tasks that Spark commits are moved to their place.

    What isn't committed lies in a folder that readers pass over. An abort removes it; a task that goes on after that finds the job
    closed and removes what it has written.
    """

    def __init__(self, options, schema):
        self.path, self.names, self.job = options["path"], [f.name for f in schema.fields], uuid.uuid4().hex
        files, staged = file_system(f"{self._staged()}/open")
        files.create_dir(staged)

    def _staged(self) -> str:
        return f"{self.path.rstrip('/')}/_staged-{self.job}"

    def write(self, rows):
        folder = f"{self._staged()}/{uuid.uuid4().hex}"
        files, base = file_system(folder)
        try:
            runs = self._write(folder, rows)
            if files.get_file_info(file_system(f"{self._staged()}/open")[1]).type == fs.FileType.NotFound:
                raise RuntimeError("the write was given up")
        except BaseException:
            if files.get_file_info(base).type != fs.FileType.NotFound:
                files.delete_dir(base)
            raise
        return Written(folder, runs)

    def _write(self, folder, rows):
        runs = []
        for row in rows:
            values = dict(zip(self.names, row))
            run = values["run_id"]
            if not run or "/" in run or run in (".", "..") or run.startswith("_"):
                raise ValueError(f"{run!r} is no name of a run")
            files, base = file_system(f"{folder}/{run}")
            files.create_dir(base)
            for name in PARTS:
                if values.get(name) is not None:
                    text = json.dumps(json.loads(values[name]), indent=2, sort_keys=True)
                    with files.open_output_stream(f"{base}/{name}.json") as out:
                        out.write(text.encode())
            if values.get("footer_md"):
                with files.open_output_stream(f"{base}/{FOOTER}") as out:
                    out.write(values["footer_md"].encode())
            runs.append(run)
        return runs

    def commit(self, messages):
        files, base = file_system(self.path)
        for message in messages:
            for run in message.runs if message else []:
                if files.get_file_info(f"{base}/{run}").type != fs.FileType.NotFound:
                    files.delete_dir(f"{base}/{run}")  # a run that is written again is replaced as a whole
                files.move(f"{file_system(message.folder)[1]}/{run}", f"{base}/{run}")
        self.abort(messages)

    def abort(self, messages):
        files, staged = file_system(self._staged())
        if files.get_file_info(staged).type != fs.FileType.NotFound:
            files.delete_dir(staged)


class ArtefactSink(DataSource):
    @classmethod
    def name(cls):
        return "run_artefacts"

    def writer(self, schema, overwrite):
        return ArtefactWriter(self.options, schema)


def write_artefacts(runs: DataFrame, path: str) -> None:
    """A folder per run (run_id) with a JSON file for each part that isn't null, and the footer if it isn't empty.

    Runs whose tasks are committed appear, each as a whole; what a failed task leaves is removed. One run is one row.
    """
    runs.sparkSession.dataSource.register(ArtefactSink)
    columns = [F.col(c).cast("string").alias(c) for c in ("run_id", *PARTS, "footer_md") if c in runs.columns]
    runs.select(*columns).write.format("run_artefacts").mode("append").option("path", path).save()


def read_artefacts(spark: SparkSession, path: str) -> DataFrame:
    """A row per run (run_id) below ``path``: each part as JSON, null if missing, an object with ``error`` if it is none; and the footer."""
    glob = f"{path.rstrip('/')}/[!_]*/*.{{json,md}}"
    text = spark.read.text(glob, wholetext=True).select("value", F.split(F.col("_metadata.file_path"), "/").alias("_p"))
    rows = text.select(F.url_decode(F.element_at("_p", -2)).alias("run_id"), F.element_at("_p", -1).alias("_file"), "value")
    parsed = F.try_parse_json("value")
    wrong = F.to_json(F.struct(F.lit("json decode failed").alias("error")))
    part = lambda name: F.max(F.when(F.col("_file") == f"{name}.json", F.coalesce(F.to_json(parsed), wrong))).alias(name)
    return rows.groupBy("run_id").agg(*map(part, PARTS), F.max(F.when(F.col("_file") == FOOTER, F.col("value"))).alias("footer_md"))


def assembled(verdicts: DataFrame, claims: DataFrame, violations: DataFrame | None = None, items: DataFrame | None = None, verifications: DataFrame | None = None, footers: DataFrame | None = None, key: str = "run_id") -> DataFrame:
    """K8: a row per run of ``verdicts`` (key, verdict, reasons, ts) with its parts as JSON, lists in the order of their rows' ``pos``.

    ``claims``, ``violations``, ``items`` and ``verifications`` have the key, ``pos``, and the fields of their objects; a run without rows has an empty list.
    """
    def lists(rows: DataFrame | None, name: str) -> DataFrame | None:
        if rows is None:
            return None
        fields = F.struct(*sorted(c for c in rows.columns if c not in (key, "pos")))
        held = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.to_json(fields, {"ignoreNullFields": "false"}).alias("j")))), lambda x: x["j"])
        return rows.groupBy(key).agg(F.concat(F.lit("["), F.array_join(held, ","), F.lit("]")).alias(name))

    out = verdicts
    for rows, name in ((claims, "claims"), (violations, "_violations"), (items, "context_items"), (verifications, "verifier")):
        held = lists(rows, name)
        out = out.withColumn(name, F.lit("[]")) if held is None else out.join(held, key, "left").withColumn(name, F.coalesce(name, F.lit("[]")))
    if footers is not None:
        out = out.join(footers.select(key, F.col("footer").alias("footer_md")), key, "left")
    whole = {"ignoreNullFields": "false"}
    verdict = F.to_json(F.struct(F.col("reasons"), F.col(key).cast("string").alias("run_id"), F.col("ts"), F.col("verdict")), whole)
    boundary = F.concat(F.lit('{"verdict":"'), F.when(F.col("_violations") == "[]", "pass").otherwise("fail"), F.lit('","violations":'), F.col("_violations"), F.lit("}"))
    kept = [c for c in ("cbom", "footer_md") if c in out.columns]
    return out.select(F.col(key).cast("string").alias("run_id"), verdict.alias("verdict"), boundary.alias("boundary"), "claims", "context_items", "verifier", *kept)
