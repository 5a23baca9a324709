"""Training sequences of several permitted lengths, packed best-fit.

Pieces go in falling length, each into the open bin that it leaves least room in. If none fits, a bin of the size with
the least cost per token it can still be filled with is opened: cost(c) = c + ``per_bin`` + c * c / ``span``, where the
terms stand for the tokens, what any sequence costs, and attention. At the end each bin shrinks to the smallest
permitted size that holds its contents.

Texts longer than the largest size are cut into pieces of that size, none is dropped. Pieces are dealt
by hash to packing groups of about ``group_rows``, whose number grows with the data; a group is packed in one task with
memory for its pieces only, and loses at most a few half-full bins against packing all at once.

A null or empty text has one token, the separator, which every text ends in. Repeated rows and repeated or null ids
are packed as rows of their own; ties in length go by id and piece. Other columns are not looked at.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.base import space_words, table
from docloom.llm.registry import register
from docloom.session import materialized

SIZES = (512, 1024, 2048, 4096)


def best_fit(lengths: list[int], sizes: tuple[int, ...], per_bin: float, span: float) -> tuple[list[int], list[int], list[int]]:
    """Of falling ``lengths``: the bin of each, its offset in the bin, and at last the size of each bin."""
    left = sum(lengths)
    room: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]  # open bins by the room they have
    some = 0  # bit r: there is a bin with room r
    bins, offsets, used, opened = [], [], [], []
    cost = {c: c + per_bin + c * c / span for c in sizes}
    for n in lengths:
        fit = some >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some &= ~(1 << r)
        else:
            c = min((c for c in sizes if c >= n), key=lambda c: (cost[c] / min(c, left), c))
            b, r = len(used), c
            used.append(0)
            opened.append(c)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        left -= n
        r -= n
        if r:
            room[r].append(b)
            some |= 1 << r
    return bins, offsets, [min(c for c in sizes if c >= u) for u in used]


def packed(
    docs: DataFrame,
    tokens: Column,
    sizes: tuple[int, ...] = SIZES,
    per_bin: float = 64.0,
    span: float = 32_768.0,
    group_rows: int = 20_000,
    id_col: str = "doc_id",
) -> DataFrame:
    """doc_id, piece, start, length, bin, offset, bin_size, bin_used: a row per piece of every text.

    ``tokens`` gives the length of a text without its separator.
    """
    sizes = tuple(sorted(sizes))
    most = sizes[-1]
    lengths = docs.select(F.col(id_col).alias("doc_id"), (tokens + 1).cast("long").alias("n"), F.monotonically_increasing_id().alias("row"))
    lengths = materialized(lengths, "packing-lengths")
    total = lengths.agg(F.sum(F.ceil(F.col("n") / most))).first()[0] or 0
    groups = max(1, -(-int(total) // group_rows))
    pieces = lengths.select("doc_id", "row", "n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / most) - 1)).alias("piece"))
    start = F.col("piece") * most
    pieces = pieces.select(
        "doc_id",
        F.col("piece").cast("int").alias("piece"),
        start.cast("long").alias("start"),
        F.least(F.col("n") - start, F.lit(most)).cast("int").alias("length"),
        F.pmod(F.xxhash64("row", "piece"), F.lit(groups)).alias("grp"),
    )
    id_type = pieces.schema["doc_id"].dataType.simpleString()

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets, size = best_fit(rows.column("length").to_pylist(), sizes, per_bin, span)
        used = [0] * len(size)
        for b, n in zip(bins, rows.column("length").to_pylist()):
            used[b] += n
        grp = rows.column("grp")[0].as_py()
        return (
            rows.drop_columns(["grp"])
            .append_column("bin", pa.array([f"{grp}-{b}" for b in bins]))
            .append_column("offset", pa.array(offsets, pa.int32()))
            .append_column("bin_size", pa.array([size[b] for b in bins], pa.int32()))
            .append_column("bin_used", pa.array([used[b] for b in bins], pa.int32()))
        )

    schema = f"doc_id {id_type}, piece int, start long, length int, bin string, offset int, bin_size int, bin_used int"
    return pieces.groupBy("grp").applyInArrow(pack, schema)


@register("op9_packing")
def op9(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"), F.size(space_words(F.col("text"))))
