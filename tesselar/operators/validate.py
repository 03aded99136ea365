"""Integrity rules of a topology as relational checks; each gives the violators, `validate` raises the first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar.functions.boxes import ends, overlap, product
from tesselar.plans.model import Topology, TopologyError


def chunk_counts(chunks: DataFrame, world_size: int) -> DataFrame:
    """Distributed tensors whose number of chunks isn't the world size: (name, got)."""
    return chunks.where("kind = 'Distributed'").groupBy("name").agg(F.count("*").alias("got")).where(F.col("got") != world_size)


def file_indices(chunks: DataFrame, n_files: int) -> DataFrame:
    """Chunks in a file that isn't listed: (name, file_idx)."""
    return chunks.where((F.col("file_idx") >= n_files) | (F.col("file_idx") < 0)).select("name", "file_idx")


def duplicate_files(chunks: DataFrame) -> DataFrame:
    """Tensors with two chunks or replicas in one file: (name, n, n_files)."""
    return chunks.groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("file_idx").alias("n_files")).where("n != n_files")


def ranks(chunks: DataFrame) -> DataFrame:
    """Chunks whose offsets or shape differ in length from the tensor's shape: (name, expected, got_offsets, got_shape)."""
    n, o, s = F.size("tensor_shape"), F.size("offsets"), F.size("shape")
    return chunks.where((o != n) | (s != n)).select("name", n.alias("expected"), o.alias("got_offsets"), s.alias("got_shape"))


def out_of_bounds(chunks: DataFrame) -> DataFrame:
    """(name, chunk_idx, dim) of each dimension in which a chunk leaves its tensor."""
    beyond = F.zip_with(ends(F.col("offsets"), F.col("shape")), F.col("tensor_shape"), lambda e, n: e > n)
    below = F.transform("offsets", lambda o: o < 0)
    bad = F.filter(F.transform(F.zip_with(beyond, below, lambda a, b: a | b), lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    return chunks.select("name", "chunk_idx", F.explode(bad).alias("dim"))


def untiled(chunks: DataFrame) -> DataFrame:
    """Names of tensors that their chunks, in bounds, don't cover exactly once: (name).

    Boxes tile a box if and only if their corners, signed by parity, add up to its corners.  So this is one grouping of
    2^rank rows a chunk and as many for its tensor, however many chunks a tensor has; no shuffle if chunks come dealt by name.
    """
    zeros = F.transform("tensor_shape", lambda _: F.lit(0).cast("bigint"))
    filled = lambda shape: F.forall(shape, lambda s: s > 0)
    own = F.struct("offsets", "shape", F.lit(True).alias("own"))
    whole = F.struct(zeros.alias("offsets"), F.col("tensor_shape").alias("shape"), F.lit(False).alias("own"))
    boxes = chunks.select("name", F.explode(F.filter(F.array(own, whole), lambda b: filled(b["shape"]))).alias("b")).select("name", "b.*")
    signs = F.explode(F.sequence(F.lit(0), F.expr("int(pow(2, size(shape)))") - 1)).alias("corner")
    up = lambda i: F.pmod(F.floor(F.col("corner") / F.pow(F.lit(2), i)), F.lit(2)).cast("bigint")
    at = F.when(F.size("shape") > 0, F.transform("shape", lambda s, i: F.get("offsets", i) + s * up(i))).otherwise(F.array().cast("array<bigint>"))
    parity = F.aggregate(F.transform("shape", lambda s, i: up(i)), F.lit(0).cast("bigint"), lambda x, y: x + y)
    corners = boxes.select("name", "offsets", "shape", "own", signs).select("name", "own", at.alias("at"), (1 - 2 * (parity % 2)).alias("sign"))
    sums = corners.groupBy("name", "at").agg(
        F.sum(F.when(F.col("own"), F.col("sign")).otherwise(0)).alias("sum"), F.coalesce(F.max(F.when(~F.col("own"), F.col("sign"))), F.lit(0)).alias("due")
    )
    return sums.where("sum != due").select("name").distinct()


def overlapping_pairs(chunks: DataFrame) -> DataFrame:
    """(name, a, b) of chunks of a tensor that share a cell, a < b.

    A tensor's finest dimension is cut into bins of its chunks' mean extent.  A pair meets in the bin in which the later
    of its two chunks starts there, so chunks are compared with neighbours only, and each pair once.
    """
    sides = chunks.where(F.size("shape") > 0).select("name", "tensor_shape", F.posexplode("shape").alias("dim", "extent"))
    mean = sides.groupBy("name", "dim", F.get("tensor_shape", F.col("dim")).alias("whole")).agg(F.avg("extent").alias("mean"))
    finest = mean.groupBy("name").agg(F.min(F.struct(F.col("mean") / F.greatest("whole", F.lit(1)), "dim", "mean")).alias("f"))
    finest = finest.select("name", "f.dim", F.greatest(F.lit(1.0), "f.mean").alias("width"))
    rows = chunks.where(F.forall("shape", lambda s: s > 0)).join(finest, "name", "left")  # rank 0: one bin
    start, extent = (F.coalesce(F.get(c, F.col("dim")), F.lit(0)) for c in ("offsets", "shape"))
    bin_ = lambda x: F.floor(x / F.coalesce("width", F.lit(1.0)))
    rows = rows.select("name", "chunk_idx", "offsets", "shape", start.alias("start"), bin_(start).alias("first"), bin_(start + F.greatest(extent, F.lit(1)) - 1).alias("last"))
    a = rows.select("name", F.col("first").alias("bin"), F.col("chunk_idx").alias("a"), F.col("start").alias("start_a"), F.col("offsets").alias("oa"), F.col("shape").alias("sa"))
    b = rows.select("name", F.explode(F.sequence("first", "last")).alias("bin"), F.col("chunk_idx").alias("b"), F.col("start").alias("start_b"), F.col("offsets").alias("ob"), F.col("shape").alias("sb"))
    later = F.struct("start_a", "a") > F.struct(F.col("start_b").alias("start_a"), F.col("b").alias("a"))
    pairs = a.join(b, ["name", "bin"]).where(later & overlap(F.col("oa"), F.col("sa"), F.col("ob"), F.col("sb")))
    return pairs.select("name", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def uncovered_volume(chunks: DataFrame) -> DataFrame:
    """(name, missing) of tensors whose chunks, in bounds and disjoint, don't add up to their volume."""
    sums = chunks.groupBy("name").agg(F.sum(product(F.col("shape"))).alias("covered"), F.first(product(F.col("tensor_shape"))).alias("volume"))
    return sums.where("covered != volume").select("name", (F.col("volume") - F.col("covered")).alias("missing"))


def grid_gaps(chunks: DataFrame) -> DataFrame:
    """Uncovered grid cells (name, dim-wise lo and hi arrays) of tensors of any ranks; explains what uncovered_volume only
    counts.  Cells lie between neighbouring boundaries of the tensor's chunks in each dimension."""
    from pyspark.sql import Window as W

    chunks = chunks.where(F.forall("tensor_shape", lambda s: s > 0))
    rank = chunks.select(F.max(F.size("tensor_shape"))).first()[0] or 0
    zero = F.lit(0).cast("bigint")
    dims = chunks.select("name", F.posexplode(F.arrays_zip("tensor_shape", "offsets", "shape")).alias("dim", "x"))
    points = dims.select("name", "dim", F.explode(F.array(zero, "x.tensor_shape", "x.offsets", F.col("x.offsets") + F.col("x.shape"))).alias("lo")).distinct()
    sides = points.withColumn("hi", F.lead("lo").over(W.partitionBy("name", "dim").orderBy("lo"))).where("hi IS NOT NULL")
    none = F.array().cast("array<bigint>")
    cells = chunks.select("name", F.size("tensor_shape").alias("rank"), none.alias("lo"), none.alias("hi")).distinct()
    for d in range(rank):  # tensors of lower rank are complete and keep their cells
        side = sides.where(F.col("dim") == d).select("name", F.array("lo").alias("l"), F.array("hi").alias("h"))
        longer = cells.where(F.col("rank") > d).join(side, "name").select("name", "rank", F.concat("lo", "l").alias("lo"), F.concat("hi", "h").alias("hi"))
        cells = longer.unionByName(cells.where(F.col("rank") <= d))
    box = chunks.select(F.col("name").alias("n2"), "offsets", ends(F.col("offsets"), F.col("shape")).alias("stop"))
    inside = F.forall(F.zip_with("lo", "offsets", lambda c, o: c >= o), lambda x: x) & F.forall(F.zip_with("hi", "stop", lambda c, s: c <= s), lambda x: x)
    return cells.drop("rank").join(box, (F.col("name") == F.col("n2")) & inside, "left_anti")


def sweep(chunks: DataFrame) -> DataFrame:
    """Gaps along dimension 0: (name, lo, hi) where no chunk is active, by a running sum of start and end events."""
    from pyspark.sql import Window as W

    start, size = F.get("offsets", F.lit(0)), F.get("shape", F.lit(0))
    steps = ((start, 1), (start + size, -1), (F.lit(0), 0), (F.get("tensor_shape", F.lit(0)), 0))  # the tensor's ends are events of no step
    events = F.inline(F.array(*[F.struct(at.cast("bigint").alias("pos"), F.lit(step).alias("step")) for at, step in steps]))
    events = chunks.select("name", events).groupBy("name", "pos").agg(F.sum("step").alias("step"))
    w = W.partitionBy("name").orderBy("pos")
    events = events.withColumn("active", F.sum("step").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("hi", F.lead("pos").over(w))
    return events.where("active = 0 AND hi IS NOT NULL").select("name", F.col("pos").alias("lo"), "hi")


def validate(topology: Topology) -> Topology:
    """topology itself, or TopologyError for the first rule that is violated, with its first tensor by name."""
    shapes = topology.tensors.select("name", F.col("shape").alias("tensor_shape"))
    chunks = topology.chunks.join(shapes, "name")
    n_files = topology.files.count()
    bare = topology.tensors.join(topology.chunks, "name", "left_anti")
    boxes = chunks.where("kind = 'Distributed'")
    boxes = boxes.join(untiled(boxes), "name", "left_semi")  # only these are worth a closer look
    rules = [
        ("InvalidChunkCount", chunk_counts(chunks, topology.world_size).unionByName(bare.select("name"), allowMissingColumns=True)),
        ("InvalidFilenameIndex", file_indices(chunks, n_files)),
        ("DuplicateIndices", duplicate_files(chunks)),
        ("InvalidChunkDimensions", ranks(chunks)),
        ("ChunkOutOfBounds", out_of_bounds(chunks)),
        ("OverlappingChunks", overlapping_pairs(boxes)),
        ("NonCoveringChunks", uncovered_volume(boxes)),
    ]
    found = None  # one job for all rules
    for k, (code, violators) in enumerate(rules):
        detail = F.to_json(F.struct(*violators.columns)).alias("detail")
        part = violators.select(F.lit(k).alias("rule"), F.lit(code).alias("code"), "name", detail)
        found = part if found is None else found.unionByName(part)
    if (row := found.orderBy("rule", "name").first()) is not None:
        raise TopologyError(row["code"], row["detail"])
    return topology
