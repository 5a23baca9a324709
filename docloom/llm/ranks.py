"""Exact ranks within groups of any size, without a task that sees a whole group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.session import materialized


def _number_runs(key: str):
    def run(batches):
        part = TaskContext.get().partitionId()
        last, seen = None, 0  # key of the run that reaches into this batch, and its rows so far
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(batch.schema.get_field_index(key)).dictionary_encode()
            codes = keys.indices.to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])
            local = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
            if last is not None and keys[0].as_py() == last:
                local[: starts[1] if len(starts) > 1 else n] += seen
            last, seen = keys[n - 1].as_py(), int(local[-1]) + 1
            columns = [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(local.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_part", "_local"])

    return run


def ranked(df: DataFrame, key: str, order: list[str], name: str, out: str = "pos") -> DataFrame:
    """``df`` and the rank from 0 (``out``, long) of each row within its ``key`` (not null) by ``order``, nulls first.

    Rows are sorted into ranges of (key, order), so a large group spreads over ranges; rows that are equal
    in all of it are told apart by where they were read. A range numbers its own rows of a key as a stream.
    Only a key that reaches over a boundary of ranges needs the rows before it: at most two entries per
    range, which is what is broadcast.
    """
    plain = df.withColumn("_tie", F.monotonically_increasing_id())
    by = [key, *order, "_tie"]
    runs = plain.repartitionByRange(*by).sortWithinPartitions(*by)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema)
    runs = materialized(runs.mapInArrow(_number_runs(key), f"{kinds}, _part int, _local long"), f"{name}-runs")
    ends = runs.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    broken = ends.groupBy(key).agg(F.min("_part").alias("_low"), F.max("_part").alias("_high")).where("_low < _high")
    pieces = ends.join(broken.select(key), key)
    before = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    skip = pieces.select(key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    skip = materialized(skip, f"{name}-skip")
    whole = runs.join(F.broadcast(skip), [key, "_part"], "left")
    return whole.select(*df.columns, (F.col("_local") + F.coalesce("_skip", F.lit(0))).alias(out))
