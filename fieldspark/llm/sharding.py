"""Sharding along a Hilbert curve, with DataFrame functions only.

Each of several metadata columns is quantised into 2^BITS ranges of about equal numbers of rows. A row's cell is a point
of that grid, its curve index the cell's place on the Hilbert curve, along which neighbours in all dimensions stay close.
Rows are ordered by curve index and cut into runs whose counts differ by one at most; a file of a run spans a narrow
range of every dimension, so readers can skip files by any of them.

The order is global but no task sees more than a bounded part of it: cells are counted (2^MAX_CELL_BITS at most), a cell
is dealt into sub-cells of about ``SUBCELL_ROWS`` rows by a hash of the id and the row's place in the input, sub-cells are
counted, and rows are numbered within their sub-cell only. Running sums of the counts give each sub-cell its first rank. So
a cell or an id with a third of all rows is spread like any other, and only ids, metadata and counts are shuffled, never
texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.llm.common import checkpointed

BITS = 4
SUBCELL_ROWS = 10_000
#: Bits of all dimensions together: cells are ordered in one task and broadcast, so their number is bounded.
MAX_CELL_BITS = 16


def order_code(column: Column, kind: str) -> Column:
    """What a dimension is ordered by: texts by their bytes, other types as numbers with NaN last; null first."""
    if kind == "string":
        return column
    return F.coalesce(F.nanvl(column.cast("double"), F.lit(float("inf"))), F.lit(float("-inf")))


def text_cuts(rows: DataFrame, code: str, ranges: int) -> list[str]:
    """Whole values that part the rows into about equal numbers, at most ranges - 1 of them: the first values whose running
    count reaches i / ranges of all rows. Values are counted, sorted in ranges and counted by range, so that no task holds
    more than a range of different values."""
    counted = rows.where(F.col(code).isNotNull()).groupBy(code).agg(F.count("*").alias("n"))
    placed = checkpointed(counted.repartitionByRange(code).withColumn("part", F.spark_partition_id()))
    before, starts = 0, []
    for part, n in sorted(map(tuple, placed.groupBy("part").agg(F.sum("n")).collect())):
        starts.append((part, before))
        before += n
    if not starts:
        return []
    start = F.broadcast(rows.sparkSession.createDataFrame(starts, "part int, start long"))
    until = F.col("start") + F.sum("n").over(Window.partitionBy("part").orderBy(code))
    running = placed.join(start, "part").select(code, until.alias("until"), "n")
    steps = lambda count: F.floor(count * ranges / F.lit(float(before)) + 1e-9)
    reached = running.where((steps(F.col("until")) > steps(F.col("until") - F.col("n"))) & (F.col("until") < before))
    return sorted((r[0] for r in reached.select(code).collect()), key=str.encode)


def quantised(rows: DataFrame, codes: Sequence[str], bits: int = BITS) -> DataFrame:
    """rows with q0, q1, ...: the range, from 0 to 2^bits - 1, that each code falls in. Ranges of numbers end at approximate
    quantiles over all rows, those of texts at exact ones; equal values share a range, null is in the first."""
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    kinds = dict(rows.dtypes)
    numbers = [c for c in codes if kinds[c] != "string"]
    found = rows.agg(*[F.percentile_approx(c, steps, 10_000).alias(c) for c in numbers]).first() if numbers else {}
    for k, code in enumerate(codes):
        cuts = sorted(set(found[code] or [])) if code in numbers else text_cuts(rows, code, 1 << bits)
        bucket = F.lit(0)
        for i, cut in enumerate(cuts):
            bucket = F.when(F.col(code) > F.lit(cut), F.lit(i + 1)).otherwise(bucket)
        rows = rows.withColumn(f"q{k}", bucket)
    return rows


def hilbert_index(point: Sequence[Column], bits: int = BITS) -> Column:
    """The place on the Hilbert curve of a point with coordinates of ``bits`` bits, by the transposed Gray code: undo the
    excess of each coarser level, then Gray-encode and interleave the bits."""
    n = len(point)
    x = F.array(*[p.cast("int") for p in point])

    def undo(x: Column, level: Column, i: int) -> Column:
        set_ = F.get(x, F.lit(i)).bitwiseAND(level) != 0
        low = level - 1
        swapped = F.get(x, F.lit(0)).bitwiseXOR(F.get(x, F.lit(i))).bitwiseAND(low)
        return F.transform(
            x,
            lambda v, k: F.when(set_, F.when(k == 0, v.bitwiseXOR(low)).otherwise(v)).when((k == 0) | (k == i), v.bitwiseXOR(swapped)).otherwise(v),
        )

    levels = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<int>")
    steps = F.flatten(F.transform(levels, lambda level: F.transform(F.array(*[F.lit(i) for i in range(n)]), lambda i: F.struct(level.alias("level"), i.alias("i")))))

    def step(x: Column, s: Column) -> Column:
        chosen = undo(x, s.level, 0)
        for i in range(1, n):
            chosen = F.when(s.i == i, undo(x, s.level, i)).otherwise(chosen)
        return chosen

    x = F.aggregate(steps, x, step)
    gray = F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), x, lambda x, i: F.transform(x, lambda v, k: F.when(k == i, v.bitwiseXOR(F.get(x, i - 1))).otherwise(v))) if n > 1 else x
    last = lambda g: F.get(g, F.lit(n - 1))
    mask = lambda g: F.aggregate(levels, F.lit(0), lambda t, level: F.when(last(g).bitwiseAND(level) != 0, t.bitwiseXOR(level - 1)).otherwise(t))
    done = F.transform(F.array(gray), lambda g: F.transform(g, lambda v: v.bitwiseXOR(mask(g))))
    order = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
    return F.get(F.transform(done, lambda g: F.aggregate(order, F.lit(0).cast("long"), lambda h, o: h * 2 + F.get(g, o.i).bitwiseAND(F.call_function("shiftleft", F.lit(1), o.b)).cast("boolean").cast("long"))), 0)


def hilbert_shards(rows: DataFrame, id_col: str, dims: Sequence[str], shards: int, bits: int = BITS) -> DataFrame:
    """The columns of ``rows``, and hilbert, rank, shard and slot (longs, shard an int).

    Ranks run from 0 along the curve; shard s has the rows with floor(rank * shards / rows) = s and slots count from 0
    within it, so shards differ by one row at most. Rows of one cell are ordered by a hash, the id, and then their place in
    the input: rows that repeat an id get slots of their own. Nulls of a dimension come first in it, texts count whole,
    a null id is ordered like any other. An empty table gives no rows; columns of any other names are kept. ``rows`` should
    be narrow: all its columns are shuffled and kept in the checkpoint folder once.
    """
    if not 0 < bits * len(dims) <= MAX_CELL_BITS:
        raise ValueError(f"{len(dims)} dimensions of {bits} bits; {MAX_CELL_BITS} bits at most")
    kinds = dict(rows.dtypes)
    inner = [f"__code{k}" for k in range(len(dims))]
    coded = rows.select(F.struct("*").alias("__row"), F.col(id_col).alias("__id"), *[order_code(F.col(d), kinds[d]).alias(c) for d, c in zip(dims, inner)])
    placed = quantised(coded.withColumn("__place", F.monotonically_increasing_id()), inner, bits)
    cell_of = sum((F.col(f"q{k}").cast("long") * (1 << bits * k) for k in range(len(dims))), F.lit(0).cast("long"))
    placed = checkpointed(placed.select("__row", "__id", "__place", cell_of.alias("cell")))  # places stay as they are

    # One row for each cell that occurs: 2^MAX_CELL_BITS at most, whatever the number of rows.
    coordinates = [F.call_function("shiftright", F.col("cell"), F.lit(bits * k)).bitwiseAND(F.lit((1 << bits) - 1).cast("long")) for k in range(len(dims))]
    cells = placed.groupBy("cell").agg(F.count("*").alias("n")).withColumn("hilbert", hilbert_index(coordinates, bits))
    cells = cells.select("cell", "hilbert", F.greatest(F.lit(1), F.ceil(F.col("n") / SUBCELL_ROWS)).cast("long").alias("parts"), F.sum("n").over(Window.orderBy("hilbert")).alias("until"), "n")
    cells = checkpointed(cells.withColumn("first", F.col("until") - F.col("n")))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]

    mixed = F.xxhash64(F.col("__id"), F.col("__place"))
    dealt = placed.join(F.broadcast(cells.select("cell", "hilbert", "parts", "first")), "cell")
    dealt = dealt.withColumn("part", F.pmod(mixed, F.col("parts")))
    counts = dealt.groupBy("hilbert", "part", "first").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("hilbert").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("hilbert", "part", (F.col("first") + before).alias("start"))
    inside = F.row_number().over(Window.partitionBy("hilbert", "part").orderBy(mixed, "__id", "__place")) - 1
    ranked = dealt.select("__row", "hilbert", "part", inside.alias("inside")).join(starts, ["hilbert", "part"])
    rank = (F.col("start") + F.col("inside")).cast("long")
    ranked = ranked.select("__row", "hilbert", rank.alias("rank"))
    if total * shards >= 1 << 63:
        raise ValueError("too many rows for this number of shards")
    shard = F.expr(f"rank * {shards}L div {max(total, 1)}L").cast("int")
    ranked = ranked.withColumn("shard", shard)
    begins = F.expr(f"(cast(shard as long) * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return ranked.select("__row.*", "hilbert", "rank", "shard", (F.col("rank") - begins).alias("slot"))


def write_shards(df: DataFrame, id_col: str, dims: Sequence[str], shards: int, path: str, bits: int = BITS) -> None:
    """Writes ``df``, all columns and their shard and slot, as files of Hilbert runs: one folder a shard, rows in curve
    order. Rows are matched by id, which must not repeat or be null."""
    placed = hilbert_shards(df.select(id_col, *[d for d in dims if d != id_col]), id_col, dims, shards, bits)
    whole = df.join(placed.select(F.col(id_col).alias("__key"), "shard", "slot"), df[id_col] == F.col("__key")).drop("__key")
    whole.repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
