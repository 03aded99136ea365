"""The driver's queries on the synthetic tables, with their SQL counterparts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.functions.boxes import ends, flat, overlap, product, strides
from tesselar.operators import validate as v
from tesselar.operators.slices import bounds, slice_elements
from tesselar.plans import layout
from tesselar.plans.copy_plan import byte_runs, copy_runs, missing_tensors, mismatches
from tesselar.plans.fixtures import SQL_E, SQL_T2, SQL_T2R, SQL_T3, WIDTH, boxes, catalog, elements, micro, n_rows, order_chunks, rule_catalog, shifted, table, thinned

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WORLD = 4


def query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def get(column: str, i: int) -> Column:
    return F.get(column, F.lit(i))


def row_shards(spark: SparkSession, n: int, k: int) -> DataFrame:
    return boxes(spark, [([n * i // k, 0], [n * (i + 1) // k - n * i // k, WIDTH], i) for i in range(k)])


def column_shards(spark: SparkSession, n: int, k: int) -> DataFrame:
    return boxes(spark, [([0, WIDTH * i // k], [n, WIDTH // k], i) for i in range(k)])


def moved(cells: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """cells (name, row, col, v) of every overlap of a source and a target box, with src, tgt and the place in the
    target box.  The boxes are a manifest: the join is an equi-join on the name with ranges as residual."""
    s = source.select("name", F.col("file_idx").alias("src"), F.col("offsets").alias("so"), F.col("shape").alias("ss"))
    t = target.select("name", F.col("file_idx").alias("tgt"), F.col("offsets").alias("to"), F.col("shape").alias("ts"))
    pairs = s.join(t, "name").where(overlap(F.col("so"), F.col("ss"), F.col("to"), F.col("ts")))
    for d in (0, 1):
        lo = F.greatest(get("so", d), get("to", d))
        pairs = pairs.withColumns({f"lo{d}": lo, f"hi{d}": F.least(get("so", d) + get("ss", d), get("to", d) + get("ts", d)), f"t{d}": get("to", d), f"w{d}": get("ts", d)})
    pairs = F.broadcast(pairs.drop("so", "ss", "to", "ts"))  # one row per overlap of a few boxes
    near = (cells["name"] == pairs["name"]) & (F.col("row") >= F.col("lo0")) & (F.col("row") < F.col("hi0")) & (F.col("col") >= F.col("lo1")) & (F.col("col") < F.col("hi1"))
    return cells.join(pairs, near).select("src", "tgt", ((F.col("row") - F.col("t0")) * F.col("w1") + F.col("col") - F.col("t1")).alias("place"), "v")


def checked(df: DataFrame, *keys: str) -> DataFrame:
    """Count, order-sensitive checksum, least and largest place per key."""
    sums = (micro(F.col("v")) * (F.col("place") % 1009 + 1)).cast("bigint")
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(sums).alias("checksum"), F.min("place").alias("first"), F.max("place").alias("last"))


def sql_checked(key: str, place: str, where: str = "TRUE") -> str:
    return f"WITH {SQL_E}, x AS (SELECT *, {key} AS k, ({place})::BIGINT AS place FROM m, n WHERE {where}) SELECT k::BIGINT AS tgt, count(*)::BIGINT AS n, sum(u * (place % 1009 + 1))::BIGINT AS checksum, min(place)::BIGINT AS first, max(place)::BIGINT AS last FROM x GROUP BY k"


@query(sql_checked("c // 32", "r * 32 + c % 32"))
def reshard_rows_to_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = n_rows(spark, sf_dir)
    return checked(moved(elements(spark, sf_dir), row_shards(spark, n, 4), column_shards(spark, n, 2)), "tgt")


@query(sql_checked("2 * (r >= n // 2)::INT + c // 32", "(r - CASE WHEN r >= n // 2 THEN n // 2 ELSE 0 END) * 32 + c % 32"))
def reshard_quadrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = n_rows(spark, sf_dir)
    h = n // 2
    quadrants = boxes(spark, [([h * (i // 2), 32 * (i % 2)], [n - h if i > 1 else h, 32], i) for i in range(4)])
    return checked(moved(elements(spark, sf_dir), row_shards(spark, n, 4), quadrants), "tgt")


@query(sql_checked("(r * 64 + c) // 4096", "r * 64 + c"))
def fuse_to_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = n_rows(spark, sf_dir)
    whole = boxes(spark, [([0, 0], [n, WIDTH], 0)])
    return checked(moved(elements(spark, sf_dir), column_shards(spark, n, 2), whole).withColumn("tgt", F.floor(F.col("place") / 4096)), "tgt")


@query(sql_checked("((r + 1) * 4 - 1) // n", "(r - n * (((r + 1) * 4 - 1) // n) // 4) * 64 + c"))
def shard_from_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = n_rows(spark, sf_dir)
    return checked(moved(elements(spark, sf_dir), boxes(spark, [([0, 0], [n, WIDTH], 0)]), row_shards(spark, n, 4)), "tgt")


@query(
    "WITH n AS (SELECT count(*)::BIGINT AS n FROM embeddings), r AS (SELECT vec_id AS r, n, ((vec_id + 1) * 4 - 1) // n AS src, unnest([0, 1]) AS tgt FROM embeddings, n)"
    ", x AS (SELECT src, tgt, 1024 + ((r - n * src // 4) * 64 + tgt * 32) * 4 AS start, r * 32 * 4 AS place FROM r)"
    " SELECT src::BIGINT AS src, tgt::BIGINT AS tgt, count(*)::BIGINT AS runs, (count(*) * 128)::BIGINT AS n_bytes, min(start)::BIGINT AS first, max(start)::BIGINT AS last, max(place)::BIGINT AS last_place FROM x GROUP BY 1, 2"
)
def plan_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte ranges that take T1 from four row shards to two column shards (files with headers of 1024 bytes)."""
    n = n_rows(spark, sf_dir)
    runs = byte_runs(copy_runs(row_shards(spark, n, 4), column_shards(spark, n, 2)), F.lit(4), F.lit(1024), F.lit(0))
    per = runs.groupBy(F.col("src_file").alias("src"), F.col("tgt_file").alias("tgt"))
    return per.agg(F.count("*").alias("runs"), F.sum(F.col("src_end") - F.col("src_start")).alias("n_bytes"), F.min("src_start").alias("first"), F.max("src_start").alias("last"), F.max("tgt_off").alias("last_place"))


@query(sql_checked("0", "r", "c = 7"))
def narrow_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = n_rows(spark, sf_dir)
    return checked(moved(elements(spark, sf_dir), row_shards(spark, n, 4), boxes(spark, [([0, 7], [n, 1], 0)])), "tgt")


def full_boxes(tensors: DataFrame) -> DataFrame:
    return tensors.select("name", F.transform("shape", lambda _: F.lit(0).cast("bigint")).alias("offsets"), "shape", F.lit(0).cast("bigint").alias("file_idx"))


@query(f"WITH {SQL_T2} SELECT name, 0::BIGINT AS src_elem, 0::BIGINT AS tgt_elem, (s0 * s1)::BIGINT AS run_len FROM t2")
def copy_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = full_boxes(catalog(spark, sf_dir))
    return copy_runs(t, t).select("name", "src_elem", "tgt_elem", "run_len")


SLICE = "WITH " + SQL_E + " SELECT {} FROM m, n WHERE {}"


def sliced(spark: SparkSession, sf_dir: str, index: object) -> DataFrame:
    box = bounds(index, [n_rows(spark, sf_dir), WIDTH])
    return slice_elements(elements(spark, sf_dir), box, ["row", "col"]).withColumn("u", micro(F.col("v"))).drop("name", "v")


@query(SLICE.format("(r - 10)::BIGINT AS row, c::BIGINT AS col, u", "r >= 10 AND r < 20 AND c < 8"))
def slice_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliced(spark, sf_dir, (slice(10, 20), slice(None, 8)))


@query(SLICE.format("c::BIGINT AS col, u", "r = 3"))
def slice_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliced(spark, sf_dir, 3)


@query(SLICE.format("c::BIGINT AS col, u", "r = n - 1"))
def slice_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliced(spark, sf_dir, -1)


@query(f"WITH {SQL_E} SELECT 'a' AS slice, (r - 5)::BIGINT AS row, c::BIGINT AS col, u FROM m WHERE r BETWEEN 5 AND 8 UNION ALL SELECT 'b', r::BIGINT, (c - 60)::BIGINT, u FROM m WHERE r < 3 AND c >= 60")
def plan_multi_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = n_rows(spark, sf_dir)
    asked = {"a": bounds((slice(5, 9),), [n, WIDTH]), "b": bounds((slice(0, 3), slice(60, None)), [n, WIDTH])}
    rows = [(k, b[0][0], b[0][1], b[1][0], b[1][1]) for k, b in asked.items()]
    wanted = F.broadcast(spark.createDataFrame(rows, "slice string, lo0 bigint, hi0 bigint, lo1 bigint, hi1 bigint"))  # the slices asked for
    e = elements(spark, sf_dir)
    e = e.join(wanted, (e["row"] >= F.col("lo0")) & (e["row"] < F.col("hi0")) & (e["col"] >= F.col("lo1")) & (e["col"] < F.col("hi1")))
    return e.select("slice", (F.col("row") - F.col("lo0")).alias("row"), (F.col("col") - F.col("lo1")).alias("col"), micro(F.col("v")).alias("u"))


def sized(tensors: DataFrame) -> DataFrame:
    return tensors.withColumn("n_bytes", layout.byte_size(F.col("shape"), F.col("dtype")))


@query(f"WITH {SQL_T2} SELECT name, n_bytes FROM t2")
def tensor_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sized(catalog(spark, sf_dir)).select("name", "n_bytes")


@query(f"WITH {SQL_T2}, x AS (SELECT name, n_bytes // s0 AS per_row, s0, i FROM t2, (SELECT unnest([0, 1]) AS i)) SELECT name, i::BIGINT AS chunk_idx, ((CASE i WHEN 0 THEN s0 // 2 ELSE s0 - s0 // 2 END) * per_row)::BIGINT AS n_bytes FROM x")
def chunk_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = catalog(spark, sf_dir).withColumn("chunk_idx", F.explode(F.sequence(F.lit(0), F.lit(1))))
    half = F.floor(get("shape", 0) / 2)
    t = t.withColumn("shape", F.array(F.when(F.col("chunk_idx") == 0, half).otherwise(get("shape", 0) - half), get("shape", 1)))
    return sized(t).select("name", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "n_bytes")


@query(f"WITH {SQL_E} SELECT count(*)::BIGINT AS n, sum(r * 64 + c)::BIGINT AS total, 0::BIGINT AS wrong FROM m")
def strides_flat_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = F.array(F.lit(n_rows(spark, sf_dir)).cast("bigint"), F.lit(WIDTH).cast("bigint"))
    e = elements(spark, sf_dir).select("row", "col", flat(F.array("row", "col"), shape).alias("at"), strides(shape).alias("st"))
    back = (F.floor(F.col("at") / get("st", 0)) != F.col("row")) | (F.col("at") % get("st", 0) != F.col("col"))
    return e.agg(F.count("*").alias("n"), F.sum("at").alias("total"), F.sum(back.cast("bigint")).alias("wrong"))


def box_grid(spark: SparkSession, n: int, cut: int, by_row: bool) -> DataFrame:
    """Boxes of a 40 x 40 tensor, n of them, cut apart along a dimension with overlaps of cut."""
    i, size = F.col("id"), 40 // n
    lo, long = F.greatest(i * size - cut, F.lit(0)).cast("bigint"), F.lit(size + cut).cast("bigint")
    zero, whole = F.lit(0).cast("bigint"), F.lit(40).cast("bigint")
    pair = (lambda a, b: F.array(a, b)) if by_row else (lambda a, b: F.array(b, a))
    return spark.range(n).select(F.lit("t").alias("name"), i.cast("bigint").alias("file_idx"), pair(lo, zero).alias("offsets"), pair(F.least(long, whole - lo), whole).alias("shape"))


GRID = "a AS (SELECT i AS s, greatest(i * 5 - 1, 0) AS lo, least(greatest(i * 5 - 1, 0) + 6, 40) AS hi FROM range(8) t(i)), b AS (SELECT i AS t, greatest(i * 8 - 2, 0) AS lo, least(greatest(i * 8 - 2, 0) + 10, 40) AS hi FROM range(5) t(i))"


@query(f"WITH {GRID} SELECT s::BIGINT AS src_file, t::BIGINT AS tgt_file, a.lo::BIGINT AS lo0, b.lo::BIGINT AS lo1, ((a.hi - a.lo) * (b.hi - b.lo))::BIGINT AS volume FROM a, b")
def box_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = box_grid(spark, 8, 1, True).select("name", F.col("file_idx").alias("src_file"), F.col("offsets").alias("oa"), F.col("shape").alias("sa"))
    b = box_grid(spark, 5, 2, False).select("name", F.col("file_idx").alias("tgt_file"), F.col("offsets").alias("ob"), F.col("shape").alias("sb"))
    x = a.join(b, "name").where(overlap(F.col("oa"), F.col("sa"), F.col("ob"), F.col("sb")))
    lo = F.zip_with("oa", "ob", lambda p, q: F.greatest(p, q))
    hi = F.zip_with(ends(F.col("oa"), F.col("sa")), ends(F.col("ob"), F.col("sb")), lambda p, q: F.least(p, q))
    x = x.withColumn("lo", lo).withColumn("len", F.zip_with(hi, "lo", lambda p, q: p - q))
    return x.select("src_file", "tgt_file", get("lo", 0).alias("lo0"), get("lo", 1).alias("lo1"), product(F.col("len")).alias("volume"))


RUNS = f"{GRID}, runs AS (SELECT s, t, unnest(generate_series(a.lo, a.hi - 1)) AS r, a.lo AS alo, b.lo AS blo, b.hi AS bhi FROM a, b), byt AS (SELECT s::BIGINT AS src_file, t::BIGINT AS tgt_file, (8 + 16 + ((r - alo) * 40 + blo) * 4)::BIGINT AS src_start, (8 + 16 + ((r - alo) * 40 + bhi) * 4)::BIGINT AS src_end, (r * (bhi - blo) * 4)::BIGINT AS tgt_off FROM runs)"


def grid_runs(spark: SparkSession) -> DataFrame:
    runs = copy_runs(box_grid(spark, 8, 1, True), box_grid(spark, 5, 2, False))
    return byte_runs(runs, F.lit(4), F.lit(8), F.lit(16)).select("src_file", "tgt_file", *[F.col(c).cast("bigint").alias(c) for c in ("src_start", "src_end", "tgt_off")])


@query(f"WITH {RUNS} SELECT * FROM byt")
def contiguous_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_runs(spark)


@query(f"WITH {RUNS} SELECT src_file, tgt_file, count(*)::BIGINT AS n_runs, sum(src_end - src_start)::BIGINT AS n_bytes FROM byt GROUP BY 1, 2")
def range_totals_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_runs(spark).groupBy("src_file", "tgt_file").agg(F.count("*").alias("n_runs"), F.sum(F.col("src_end") - F.col("src_start")).alias("n_bytes"))


def in_files(tensors: DataFrame) -> DataFrame:
    return sized(tensors).withColumn("file_idx", F.col("p_partkey") % WORLD)


LAID = f"{SQL_T2}, laid AS (SELECT p_partkey % 4 AS file_idx, name, n_bytes, (sum(n_bytes) OVER (PARTITION BY p_partkey % 4 ORDER BY name) - n_bytes)::BIGINT AS begin FROM t2)"


@query(f'WITH {LAID} SELECT file_idx::BIGINT AS file_idx, name, begin, (begin + n_bytes)::BIGINT AS "end", (begin + (8 - begin % 8) % 8)::BIGINT AS aligned FROM laid')
def header_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.header_offsets(in_files(catalog(spark, sf_dir))).select("file_idx", "name", "begin", "end", layout.padded(F.col("begin")).cast("bigint").alias("aligned"))


@query(
    f"""WITH {LAID}, x AS (SELECT file_idx, max(begin + n_bytes) AS stop, sum(len(name) + 2 + 1 + len('{{"dtype":"' || dtype || '","shape":[' || s0 || ',' || s1 || '],"data_offsets":[' || begin || ',' || (begin + n_bytes) || ']}}')) + count(*) - 1 + 2 AS head
    FROM (SELECT * FROM laid JOIN t2 USING (name, n_bytes)) GROUP BY 1)
    SELECT count(*)::BIGINT AS files, sum(stop + 8 + head + (8 - head % 8) % 8)::BIGINT AS total FROM x"""
)
def estimated_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the files of T2 with the headers that they get."""
    from tesselar.operators.reshard import file_headers
    from tesselar.plans.model import Topology

    placed = in_files(catalog(spark, sf_dir))
    chunks = full_boxes(placed).drop("file_idx").join(placed.select("name", "file_idx"), "name")
    files = spark.range(WORLD).select(F.col("id").alias("file_idx"), F.format_string("f%d", "id").alias("filename"))
    head = file_headers(Topology(placed.select("name", F.lit("Shared").alias("kind"), "shape", "dtype"), chunks, files, WORLD))
    data = layout.header_offsets(placed).groupBy("file_idx").agg(F.max("end").alias("stop"))
    sizes = head.join(data, "file_idx").select((F.col("stop") + 8 + F.octet_length("header")).alias("n_bytes"))
    return sizes.agg(F.count("*").alias("files"), F.sum("n_bytes").alias("total"))


RANKED = f"{SQL_T2}, r AS (SELECT p_partkey % 4 AS rank, name, n_bytes, (sum(n_bytes) OVER (PARTITION BY p_partkey % 4 ORDER BY name) - n_bytes)::BIGINT AS before FROM t2), s AS (SELECT *, (dense_rank() OVER (PARTITION BY rank ORDER BY before // 65536) - 1) AS shard FROM r), f AS (SELECT rank, max(shard) + 1 AS n_files FROM s GROUP BY 1), b AS (SELECT rank, n_files, coalesce(sum(n_files) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM f)"


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.shard_files(sized(catalog(spark, sf_dir)).select((F.col("p_partkey") % WORLD).alias("rank"), "name", "n_bytes"), 64 << 10)


@query(f"WITH {RANKED} SELECT rank::BIGINT AS rank, name, shard::BIGINT AS shard, n_files::BIGINT AS n_files, (base + shard)::BIGINT AS file_idx FROM s JOIN b USING (rank)")
def shard_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir).select("rank", "name", F.col("shard").cast("bigint").alias("shard"), F.col("n_files").cast("bigint").alias("n_files"), "file_idx")


@query(f"WITH {RANKED} SELECT DISTINCT (base + shard)::BIGINT AS file_idx, 'model_rank_' || rank || '_chunk_' || shard || '.safetensors' AS filename FROM s JOIN b USING (rank)")
def file_name_gen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir).select("file_idx", layout.file_name(F.col("rank"), F.col("shard")).alias("filename")).distinct()


@query(f"WITH {LAID}, f AS (SELECT file_idx, sum(n_bytes) AS b FROM laid GROUP BY 1), g AS (SELECT file_idx, coalesce(sum(b) OVER (ORDER BY file_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, sum(b) OVER () AS total FROM f) SELECT name, (base + begin)::BIGINT AS start, least(7, (base + begin) * 8 // total)::BIGINT AS worker FROM laid JOIN g USING (file_idx)")
def worker_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.worker_buckets(in_files(catalog(spark, sf_dir)), 8).select("name", F.col("start").cast("bigint").alias("start"), F.col("worker").cast("bigint").alias("worker"))


DIM = "CASE WHEN p_partkey % 8 IN (0, 1, 7) THEN 1 WHEN p_partkey % 8 IN (2, 3, 6) THEN 0 END"


@query(f"WITH {SQL_T2R} SELECT coalesce({DIM}, -1)::BIGINT AS dim, count(*)::BIGINT AS n, min(name) AS first FROM t2r GROUP BY 1")
def split_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rule_catalog(spark, sf_dir)
    return t.groupBy(F.coalesce(layout.split_dim(F.col("name")), F.lit(-1)).cast("bigint").alias("dim")).agg(F.count("*").alias("n"), F.min("name").alias("first"))


@query(f"WITH {SQL_T2R}, x AS (SELECT *, {DIM} AS dim FROM t2r), y AS (SELECT *, coalesce(dim = 1 OR (dim = 0 AND s0 % 4 = 0), FALSE) AS d FROM x), z AS (SELECT *, unnest([0, 1, 2, 3]) AS rank FROM y) SELECT name, rank::BIGINT AS rank, CASE WHEN d THEN 'Distributed' ELSE 'Shared' END AS kind, (CASE WHEN d AND dim = 0 THEN s0 // 4 * rank ELSE 0 END)::BIGINT AS o0, (CASE WHEN d AND dim = 1 THEN 2 * rank ELSE 0 END)::BIGINT AS o1, (CASE WHEN d AND dim = 0 THEN s0 // 4 ELSE s0 END)::BIGINT AS s0, (CASE WHEN d AND dim = 1 THEN 2 ELSE 8 END)::BIGINT AS s1 FROM z")
def split_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = layout.split_chunks(rule_catalog(spark, sf_dir), WORLD)
    return c.select("name", "rank", "kind", get("offsets", 0).alias("o0"), get("offsets", 1).alias("o1"), get("chunk_shape", 0).alias("s0"), get("chunk_shape", 1).alias("s1"))


@query(f"WITH {SQL_T3} SELECT o::VARCHAR AS name, count(*)::BIGINT AS got FROM t3 GROUP BY o HAVING count(*) != 4")
def validate_chunk_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.chunk_counts(order_chunks(spark, sf_dir), WORLD)


@query(f"WITH {SQL_T3} SELECT o::VARCHAR AS name, supp AS file_idx FROM t3 WHERE supp >= (SELECT count(*) - 3 FROM supplier)")
def validate_file_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.file_indices(order_chunks(spark, sf_dir), table(spark, sf_dir, "supplier").count() - 3)


@query(f"WITH {SQL_T3} SELECT o::VARCHAR AS name, count(*)::BIGINT AS n, count(DISTINCT supp % 8)::BIGINT AS n_files FROM t3 GROUP BY o HAVING count(*) != count(DISTINCT supp % 8)")
def validate_duplicate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.duplicate_files(order_chunks(spark, sf_dir).withColumn("file_idx", F.col("file_idx") % 8))


@query(f"WITH {SQL_T3} SELECT o::VARCHAR AS name, 1::BIGINT AS expected, 2::BIGINT AS got_offsets, 1::BIGINT AS got_shape FROM t3 WHERE (o + l) % 7 = 0")
def validate_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = order_chunks(spark, sf_dir)
    c = c.withColumn("offsets", F.when((F.col("order") + F.col("line")) % 7 == 0, F.concat("offsets", F.array(F.lit(0).cast("bigint")))).otherwise(F.col("offsets")))
    return v.ranks(c).select("name", *[F.col(x).cast("bigint").alias(x) for x in ("expected", "got_offsets", "got_shape")])


@query(f"WITH {SQL_T3} SELECT o::VARCHAR AS name, l AS chunk_idx, 0::BIGINT AS dim FROM t3 WHERE (o + l) % 5 = 0 AND off + size + 3 > total")
def validate_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = order_chunks(spark, sf_dir)
    c = c.withColumn("shape", F.when((F.col("order") + F.col("line")) % 5 == 0, F.transform("shape", lambda s: s + 3)).otherwise(F.col("shape")))
    return v.out_of_bounds(c).select("name", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), F.col("dim").cast("bigint").alias("dim"))


@query(f"WITH {SQL_T3}, s AS (SELECT o, l, CASE WHEN (o + l) % 7 = 0 THEN greatest(off - 1, 0) ELSE off END AS lo, size FROM t3) SELECT x.o::VARCHAR AS name, x.l AS a, y.l AS b FROM s x JOIN s y ON x.o = y.o AND x.l < y.l AND greatest(x.lo, y.lo) < least(x.lo + x.size, y.lo + y.size)")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.overlapping_pairs(shifted(order_chunks(spark, sf_dir))).select("name", F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))


THIN = f"{SQL_T3}, k AS (SELECT * FROM t3 WHERE (o + l) % 5 != 0)"


@query(f"WITH {THIN} SELECT o::VARCHAR AS name, (max(total) - sum(size))::BIGINT AS missing FROM k GROUP BY o HAVING sum(size) != max(total)")
def coverage_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.uncovered_volume(thinned(order_chunks(spark, sf_dir)))


POINTS = f"{THIN}, p AS (SELECT o, off AS x FROM k UNION SELECT o, off + size FROM k UNION SELECT o, 0 FROM k UNION SELECT o, total FROM k), c AS (SELECT o, x AS lo, lead(x) OVER (PARTITION BY o ORDER BY x) AS hi FROM p)"


@query(f"WITH {POINTS} SELECT o::VARCHAR AS name, lo::BIGINT AS lo, hi::BIGINT AS hi FROM c WHERE hi IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k WHERE k.o = c.o AND k.off <= c.lo AND k.off + k.size >= c.hi)")
def coverage_gap_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.grid_gaps(thinned(order_chunks(spark, sf_dir))).select("name", get("lo", 0).alias("lo"), get("hi", 0).alias("hi"))


@query(f"WITH {THIN}, ev AS (SELECT o, off AS pos, 1 AS step FROM k UNION ALL SELECT o, off + size, -1 FROM k UNION ALL SELECT DISTINCT o, 0, 0 FROM k UNION ALL SELECT DISTINCT o, total, 0 FROM k), g2 AS (SELECT o, pos, sum(step) AS step FROM ev GROUP BY 1, 2), w AS (SELECT o, pos, sum(step) OVER (PARTITION BY o ORDER BY pos) AS active, lead(pos) OVER (PARTITION BY o ORDER BY pos) AS hi FROM g2) SELECT o::VARCHAR AS name, pos::BIGINT AS lo, hi::BIGINT AS hi FROM w WHERE active = 0 AND hi IS NOT NULL")
def sweep_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.sweep(thinned(order_chunks(spark, sf_dir)))


def mixed_ranks(chunks: DataFrame) -> DataFrame:
    """T3 with a second dimension of extent 2 for odd orders, of which chunks of odd lines cover one half only."""
    odd = F.col("order") % 2 == 1
    more = lambda c, x: F.when(odd, F.concat(c, F.array(x.cast("bigint")))).otherwise(F.col(c))
    half = F.when(F.col("line") % 2 == 1, 1).otherwise(2)
    return chunks.withColumns({"offsets": more("offsets", F.lit(0)), "shape": more("shape", half), "tensor_shape": more("tensor_shape", F.lit(2))})


@query(
    f"{'WITH ' + THIN}, h AS (SELECT *, CASE WHEN o % 2 = 0 THEN NULL WHEN l % 2 = 1 THEN 1 ELSE 2 END AS half FROM k)"
    ", p AS (SELECT o, off AS x FROM k UNION SELECT o, off + size FROM k UNION SELECT o, 0 FROM k UNION SELECT o, total FROM k), c AS (SELECT o, x AS lo, lead(x) OVER (PARTITION BY o ORDER BY x) AS hi FROM p)"
    ", q AS (SELECT o, half AS y FROM h WHERE o % 2 = 1 UNION SELECT o, 0 FROM k WHERE o % 2 = 1 UNION SELECT o, 2 FROM k WHERE o % 2 = 1), d AS (SELECT o, y AS lo1, lead(y) OVER (PARTITION BY o ORDER BY y) AS hi1 FROM q)"
    ", cells AS (SELECT c.o, lo, hi, lo1, hi1 FROM c LEFT JOIN d ON c.o = d.o WHERE hi IS NOT NULL AND (d.o IS NULL OR hi1 IS NOT NULL))"
    " SELECT o::VARCHAR AS name, lo::BIGINT AS lo0, hi::BIGINT AS hi0, coalesce(lo1, -1)::BIGINT AS lo1, coalesce(hi1, -1)::BIGINT AS hi1 FROM cells WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.o = cells.o AND h.off <= lo AND h.off + h.size >= hi AND (hi1 IS NULL OR h.half >= hi1))"
)
def mixed_rank_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncovered cells of tensors of ranks one and two together; -1 for the dimension that a tensor lacks."""
    gaps = v.grid_gaps(mixed_ranks(thinned(order_chunks(spark, sf_dir))))
    return gaps.select("name", get("lo", 0).alias("lo0"), get("hi", 0).alias("hi0"), *(F.coalesce(get(c, 1), F.lit(-1).cast("bigint")).alias(f"{c}1") for c in ("lo", "hi")))


@query(f"WITH {SQL_T3} SELECT o::VARCHAR AS name FROM t3 GROUP BY o HAVING bool_or((o + l) % 7 = 0 AND off > 0)")
def untiled_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensors whose chunks, moved here and there, don't cover them exactly once."""
    return v.untiled(shifted(order_chunks(spark, sf_dir)))


@query("WITH k AS (SELECT p_partkey::BIGINT AS p FROM part) SELECT 'big' AS name, (k.p - 1)::BIGINT AS a, k.p AS b FROM k JOIN k AS before ON before.p = k.p - 1 WHERE k.p % 97 = 0")
def big_tensor_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tensor with a chunk per part, of which some begin in the chunk before."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("p"))
    zero, start = F.lit(0).cast("bigint"), F.col("p") * 8 - F.when(F.col("p") % 97 == 0, 1).otherwise(0)
    chunks = p.select(F.lit("big").alias("name"), F.col("p").alias("chunk_idx"), F.array(start, zero).alias("offsets"), F.array(F.lit(8), F.lit(4)).cast("array<bigint>").alias("shape"), F.array(F.lit(1 << 40), F.lit(4).cast("bigint")).alias("tensor_shape"))
    return v.overlapping_pairs(chunks)


@query(f"WITH {POINTS} SELECT o::VARCHAR AS name, count(*)::BIGINT AS n_points, max(x)::BIGINT AS last FROM p GROUP BY o")
def split_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = thinned(order_chunks(spark, sf_dir))
    stops = ends(F.col("offsets"), F.col("shape"))
    points = c.groupBy("name").agg(F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("bigint"), F.max(get("tensor_shape", 0))), F.flatten(F.collect_list(F.concat("offsets", stops)))))).alias("x"))
    return points.select("name", F.size("x").cast("bigint").alias("n_points"), F.element_at("x", -1).alias("last"))


@query(f"WITH {SQL_T2} SELECT name || '.new' AS name FROM t2 WHERE p_partkey % 11 = 0")
def missing_in_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = catalog(spark, sf_dir)
    return missing_tensors(t.withColumn("name", F.when(F.col("p_partkey") % 11 == 0, F.concat("name", F.lit(".new"))).otherwise(F.col("name"))), t)


@query(f"WITH {SQL_T2} SELECT name, (p_partkey % 7 = 0) AS shape_differs, (p_partkey % 5 = 0 AND dtype != 'F32') AS dtype_differs FROM t2 WHERE p_partkey % 7 = 0 OR (p_partkey % 5 = 0 AND dtype != 'F32')")
def shape_dtype_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = catalog(spark, sf_dir)
    other = t.withColumn("shape", F.when(F.col("p_partkey") % 7 == 0, F.reverse(F.transform("shape", lambda s: s + 50))).otherwise(F.col("shape")))
    other = other.withColumn("dtype", F.when(F.col("p_partkey") % 5 == 0, "F32").otherwise(F.col("dtype")))
    return mismatches(other, t).select("name", (F.col("shape") != F.col("src_shape")).alias("shape_differs"), (F.col("dtype") != F.col("src_dtype")).alias("dtype_differs"))


@query(f"WITH {SQL_T2} SELECT name, (p_partkey % 4)::BIGINT AS file_idx FROM t2")
def replica_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselar.plans.copy_plan import first_replica

    t = catalog(spark, sf_dir).withColumn("kind", F.lit("Shared"))
    replicas = t.select("name", "kind", F.posexplode(F.array(F.col("p_partkey") % 4, F.col("p_partkey") % 4 + 1, F.col("p_partkey") % 4 + 2)).alias("chunk_idx", "file_idx"))
    return first_replica(replicas).select("name", "file_idx")


@query(f"WITH {SQL_T2}, w AS (SELECT name, n_bytes, 'part-' || (p_partkey % 10) || '.safetensors' AS filename FROM t2), f AS (SELECT filename, row_number() OVER (ORDER BY filename) - 1 AS file_idx FROM (SELECT DISTINCT filename FROM w)) SELECT file_idx::BIGINT AS file_idx, filename, count(*)::BIGINT AS n, sum(n_bytes)::BIGINT AS n_bytes FROM w JOIN f USING (filename) GROUP BY 1, 2")
def weight_map_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselar.plans.catalog import weight_map_files

    t = sized(catalog(spark, sf_dir)).withColumn("filename", F.format_string("part-%d.safetensors", F.col("p_partkey") % 10))
    files = weight_map_files(t.select("name", "filename"))
    return t.join(F.broadcast(files), "filename").groupBy("file_idx", "filename").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("n_bytes"))  # one row per file


@query(f"WITH {SQL_T2R} SELECT name, 'Shared' AS kind, s0, s1, dtype, (p_partkey % 4)::BIGINT AS file_idx FROM t2r")
def manifest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest written by SQL in rows of some tensors each, and parsed, validated and flattened again."""
    from tesselar.plans.catalog import parse_manifest

    t = rule_catalog(spark, sf_dir)
    entry = F.struct(F.lit("Shared").alias("type"), "shape", "dtype", F.array(F.col("p_partkey") % WORLD).alias("filename_indices"))
    n = t.count()
    block = F.pmod(F.xxhash64("name"), F.lit(n // 256 + 1)).alias("block")  # some 256 tensors a row
    listed = t.select(block, F.struct("name", entry.alias("entry")).alias("e")).repartition(n // (1 << 14) + 1, "block").groupBy("block").agg(F.collect_list("e").alias("e"))
    listed = listed.select(F.to_json(F.struct(F.map_from_entries("e").alias("tensors"))).alias("value"))
    text = listed.unionByName(spark.range(1).select(F.lit('{"tensors":{},"filenames":["a","b","c","d"],"world_size":4}').alias("value")))
    topology = parse_manifest(text)
    c = topology.chunks.select("name", "kind", "file_idx").join(topology.tensors.select("name", "shape", "dtype"), "name")
    return c.select("name", "kind", get("shape", 0).alias("s0"), get("shape", 1).alias("s1"), "dtype", "file_idx")


def _checkpoint_folder(spark: SparkSession) -> str:
    import tempfile

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{shared or 'file://' + tempfile.gettempdir()}/tesselar-files/{uuid.uuid4().hex}"


#: Rows of a source file of the whole-table checkpoint (16 MB); tables of few rows make WORLD files.
FILE_ROWS = 65536
SQL_K = "n AS (SELECT count(*)::BIGINT AS n FROM embeddings), k AS (SELECT n, greatest(4, (n + 65535) // 65536)::BIGINT AS k FROM n)"


def _write_table(spark: SparkSession, sf_dir: str, folder: str, weight_map: bool = False) -> tuple[int, int]:
    """All of T1 as a checkpoint of k files, each written by one task with a tensor up.I of the rows from n * I // k; (n, k).

    Beside the files stands a manifest or, with weight_map, an index of names and files.
    """
    from tesselar.plans.catalog import manifest_json
    from tesselar.plans.model import Topology
    from tesselar.sources.headers import open_fs

    t = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("row"), "embedding")
    n, ids, least, most = t.agg(F.count("*"), F.count_distinct("row"), F.min("row"), F.max("row")).first()
    if n and (ids, least, most) != (n, 0, n - 1):
        raise ValueError("vec_id doesn't number the rows of embeddings")
    k = max(WORLD, -(-n // FILE_ROWS))
    name = lambda i: f"part-{i:05d}.safetensors"

    def write(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        fs, path = open_fs(folder)
        current = out = temporary = None

        def ended() -> None:
            if out is not None:
                out.close()
                fs.move(temporary, f"{path}/{name(current)}")

        for b in batches:
            files, values = b.column(0).to_numpy(), b.column(1)
            flat = values.flatten()
            if values.null_count or flat.null_count or len(flat) != len(values) * WIDTH:
                raise ValueError("an embedding isn't whole")
            flat = flat.to_numpy().astype("<f4").reshape(-1, WIDTH)
            for i in np.unique(files).tolist():
                if i != current:
                    ended()
                    rows = n * (i + 1) // k - n * i // k
                    header = json.dumps({"__metadata__": {"table": "embeddings"}, f"up.{i}": {"dtype": "F32", "shape": [rows, WIDTH], "data_offsets": [0, rows * WIDTH * 4]}}).encode()
                    current, temporary = i, f"{path}/.{name(i)}.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(temporary)
                    out.write(len(header).to_bytes(8, "little") + header)
                out.write(flat[files == i].tobytes())
        ended()
        yield pa.RecordBatch.from_arrays([pa.array([] if current is None else [current], pa.int64())], ["file_idx"])

    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)
    idx = F.expr(f"((row + 1) * {k} - 1) div {max(n, 1)}").alias("file_idx")
    dealt = t.select(idx, "row", "embedding").repartition("file_idx").sortWithinPartitions("file_idx", "row")
    dealt.select("file_idx", "embedding").mapInArrow(write, "file_idx long").count()
    if weight_map:
        with fs.open_output_stream(path + "/model.safetensors.index.json") as f:
            f.write(json.dumps({"weight_map": {f"up.{i}": name(i) for i in range(k)}}).encode())
        return n, k
    files = spark.range(k).select(F.col("id").alias("file_idx"), F.format_string("part-%05d.safetensors", "id").alias("filename"))
    lo, hi = (F.expr(f"({n} * (id + {j})) div {k}") for j in (0, 1))
    tensors = spark.range(k).select(F.concat(F.lit("up."), F.col("id").cast("string")).alias("name"), F.lit("Shared").alias("kind"), F.array(hi - lo, F.lit(WIDTH).cast("bigint")).alias("shape"), F.lit("F32").alias("dtype"), F.col("id").alias("file_idx"))
    zeros = F.transform("shape", lambda _: F.lit(0).cast("bigint"))
    chunks = tensors.select("name", "kind", F.lit(0).alias("chunk_idx"), zeros.alias("offsets"), "shape", "file_idx")
    with fs.open_output_stream(path + "/topology.json") as f:
        f.write(manifest_json(Topology(tensors.drop("file_idx"), chunks, files, k)).encode())
    return n, k


@query(f"WITH {SQL_K}, i AS (SELECT n, k, unnest(range(k)) AS i FROM k) SELECT i::BIGINT AS file_idx, 'up.' || i AS name, 'F32' AS dtype, (n * (i + 1) // k - n * i // k)::BIGINT AS s0, 64::BIGINT AS s1, 0::BIGINT AS begin, ((n * (i + 1) // k - n * i // k) * 256)::BIGINT AS \"end\" FROM i")
def checkpoint_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headers of all files of the embeddings table's checkpoint."""
    from tesselar.plans.catalog import load_topology, with_paths
    from tesselar.sources.headers import headers

    folder = _checkpoint_folder(spark)
    _write_table(spark, sf_dir, folder)
    files = with_paths(load_topology(spark, folder).files, folder)
    return headers(spark, files).select("file_idx", "name", "dtype", get("shape", 0).alias("s0"), get("shape", 1).alias("s1"), "begin", "end")


SQL_UP = f"{SQL_K}, i AS (SELECT n, k, unnest(range(k)) AS i FROM k), up AS (SELECT i, 'up.' || i AS name, n * (i + 1) // k - n * i // k AS s0 FROM i)"


@query(f"WITH {SQL_UP} SELECT i::BIGINT AS file_idx, name, 'Shared' AS kind, 'F32' AS dtype, s0::BIGINT AS s0, 64::BIGINT AS s1 FROM up")
def weight_map_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topology of the embeddings table's checkpoint, from its index of names and files and the files' headers."""
    from tesselar.plans.catalog import load_topology

    folder = _checkpoint_folder(spark)
    _write_table(spark, sf_dir, folder, weight_map=True)
    t = load_topology(spark, folder)
    return t.chunks.select("name", "file_idx").join(t.tensors, "name").select("file_idx", "name", "kind", "dtype", get("shape", 0).alias("s0"), get("shape", 1).alias("s1"))


@query(
    f"WITH {SQL_UP}, x AS (SELECT unnest(range(4)) AS f, name, s0, sum(s0 * 64) OVER (ORDER BY name) AS stop FROM up)"
    " SELECT f::BIGINT AS file_idx, name, 'F32' AS dtype, s0::BIGINT AS s0, 16::BIGINT AS s1, (stop - s0 * 64)::BIGINT AS begin, stop::BIGINT AS \"end\" FROM x"
)
def header_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headers of the embeddings table's checkpoint after it was split over four ranks, a file each."""
    from tesselar.operators.reshard import reshard
    from tesselar.plans.catalog import load_topology, with_paths
    from tesselar.sources.headers import headers

    folder = _checkpoint_folder(spark)
    _write_table(spark, sf_dir, folder + "/rows", weight_map=True)
    reshard(spark, folder + "/rows", folder + "/four", WORLD)
    files = with_paths(load_topology(spark, folder + "/four").files, folder + "/four")
    return headers(spark, files).select("file_idx", "name", "dtype", get("shape", 0).alias("s0"), get("shape", 1).alias("s1"), "begin", "end")


def _elements(spark: SparkSession, folder: str, n: int, k: int) -> DataFrame:
    """(row, col, u) of T1, read by a plan over all tensors of its checkpoint."""
    from tesselar.operators.slices import Loader, Plan
    from tesselar.sources.headers import read_ranges

    loader, plan = Loader(spark, folder), Plan()
    for i in range(k):
        plan.add_slice(loader.get_slice(f"up.{i}")[:])

    def decoded(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for b in batches:
            for name, off, raw in zip(*(c.to_pylist() for c in b.columns)):
                values, first = np.frombuffer(raw, "<f4"), n * int(name[3:]) // k * WIDTH
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)) + off // 4 + first, pa.int64()), pa.array(values, pa.float32())], ["at", "v"])

    cells = read_ranges(plan.ranges(loader)).select("name", "tgt_off", "payload").mapInArrow(decoded, "at long, v float")
    return cells.select(F.floor(F.col("at") / WIDTH).alias("row"), (F.col("at") % WIDTH).alias("col"), micro(F.col("v")).alias("u"))


@query(f"WITH {SQL_E} SELECT r::BIGINT AS row, c::BIGINT AS col, u FROM m")
def write_read_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole embeddings table: files with an index -> one fused file without a manifest -> elements."""
    from tesselar.operators.reshard import fuse

    folder = _checkpoint_folder(spark)
    n, k = _write_table(spark, sf_dir, folder + "/rows", weight_map=True)
    fuse(spark, folder + "/rows", folder + "/one")
    return _elements(spark, folder + "/one", n, k)


@query(f"WITH {SQL_E} SELECT r::BIGINT AS row, c::BIGINT AS col, u FROM m")
def checkpoint_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole embeddings table: files by rows -> four ranks by columns in size-capped shards -> fused file -> elements."""
    from tesselar.operators.reshard import fuse, reshard

    folder = _checkpoint_folder(spark)
    n, k = _write_table(spark, sf_dir, folder + "/rows")
    reshard(spark, folder + "/rows", folder + "/four", WORLD, max_shard_bytes=max(1, 2 * -(-n // k) * WIDTH * 4 // WORLD))
    fuse(spark, folder + "/four", folder + "/back")
    return _elements(spark, folder + "/back", n, k)
