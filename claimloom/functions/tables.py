"""Joins of tables by keys that may be null, small inputs on many cores, and equal texts of a batch taken together."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows a task where each of them takes a scan of a text that is made of it.
ROWS = 50_000


def join_left(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join by a key whose nulls equal each other, so that what is known of a row without a key isn't lost."""
    own = f"_{key}_right"
    renamed = right.withColumnRenamed(key, own)
    return left.join(renamed, left[key].eqNullSafe(renamed[own]), "left").drop(own)


def spread(df: DataFrame) -> DataFrame:
    """An input of fewer partitions than there are cores, as small files are, dealt to all of them; any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, most: int = ROWS) -> DataFrame:
    """An input of few bytes and much work, dealt to tasks of at most ``most`` rows wherever one of its partitions has more.

    Neither bytes nor the number of partitions tell: a file is cut by bytes, but a row group is read whole by one task, and
    the other tasks get nothing. Counting reads no column.
    """
    sizes = df.groupBy(F.spark_partition_id()).count()
    found = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"), F.coalesce(F.max("count"), F.lit(0)).alias("largest")).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-found["rows"] // most))) if found["largest"] > min(most, -(-found["rows"] // cores)) else df


def once_a_batch(rows: DataFrame, content: str) -> DataFrame:
    """Rows by a text, where they are: in each Arrow batch one row per distinct ``content``, with all other columns of its rows in ``places``.

    What depends on the text only is worked out once for all of them, and exploding ``places`` gives the rows back. Nothing is
    shuffled, and a batch bounds what is held; texts that never repeat only pass through.
    """
    others = [f.name for f in rows.schema.fields if f.name != content]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    fields = ", ".join(f"`{c}`: {types[c]}" for c in others)

    def group(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            numbered = pa.table({"text": batch.column(content), "n": pa.array(range(batch.num_rows), pa.int32())})
            found = numbered.group_by("text", use_threads=False).aggregate([("n", "list")]).combine_chunks()
            lists = found["n_list"].combine_chunks()
            same = batch.select(others).take(lists.flatten())
            places = pa.ListArray.from_arrays(lists.offsets, pa.StructArray.from_arrays(same.columns, names=others))
            yield pa.RecordBatch.from_arrays([found["text"].combine_chunks(), places], names=[content, "places"])

    return rows.mapInArrow(group, f"`{content}` {types[content]}, places array<struct<{fields}>>")
