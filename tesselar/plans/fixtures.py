"""The synthetic tables seen as tensor checkpoints.

T1: one F32 tensor emb of N x 64 from embeddings.  T2: one tensor per part.  T3: one 1-D tensor per order, with a
chunk per line number.  T4: suppliers as the list of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

WIDTH = 64
#: Rows that a task gets when lines are dealt by order: the first where that makes up to FEW_PARTS parts, which Spark deals
#: without sorting them in memory (spark.shuffle.sort.bypassMergeThreshold), else up to the second.
TASK_ROWS, MOST_TASK_ROWS, FEW_PARTS = 1 << 17, 5 << 18, 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 as rows (name, row, col, v)."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "v"))
    return e.select(F.lit("emb").alias("name"), "row", F.col("col").cast("bigint").alias("col"), "v")


def n_rows(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "embeddings").count()


def boxes(spark: SparkSession, rows: list[tuple[list[int], list[int], int]]) -> DataFrame:
    """Boxes (offsets, shape, file_idx) of T1; a manifest of a few rows."""
    return spark.createDataFrame([("emb", i, *r) for i, r in enumerate(rows)], "name string, chunk_idx int, offsets array<bigint>, shape array<bigint>, file_idx bigint")


def micro(v: Column) -> Column:
    """A value in millionths as a long, so that sums don't depend on their order."""
    return F.floor(v.cast("double") * 1e6 + 0.5).cast("bigint")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2: (p_partkey, name, shape, dtype)."""
    p = table(spark, sf_dir, "part")
    dtype = F.element_at(F.array(F.lit("F32"), F.lit("BF16"), F.lit("I64")), (F.col("p_partkey") % 3 + 1).cast("int"))
    shape = F.array(F.col("p_size").cast("bigint"), F.lit(8).cast("bigint"))
    return p.select(F.col("p_partkey").cast("bigint").alias("p_partkey"), F.concat_ws(".", "p_name", F.col("p_partkey").cast("string")).alias("name"), shape.alias("shape"), dtype.alias("dtype"))


RULE_NAMES = ("up_proj", "q_proj", "c_proj", "down_proj", "layernorm", "q_proj.bias", "embed", "gate")


def rule_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 with names that the split rules know."""
    kind = F.element_at(F.array(*map(F.lit, RULE_NAMES)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return catalog(spark, sf_dir).withColumn("name", F.concat_ws(".", kind, F.col("p_partkey").cast("string")))


def order_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3: (name, kind, chunk_idx, offsets, shape, tensor_shape, file_idx, order, line); 1-D boxes."""
    lines = table(spark, sf_dir, "lineitem")
    order = F.col("l_orderkey").cast("bigint")
    lines = lines.select(order.cast("string").alias("name"), order.alias("order"), F.col("l_linenumber").cast("bigint").alias("line"), "l_quantity", "l_suppkey")
    n = lines.count()
    parts = min(n // TASK_ROWS + 1, max(FEW_PARTS, n // MOST_TASK_ROWS))
    lines = lines.repartition(parts, "name")  # all that follows is by name, so rows move once
    g = lines.groupBy("name", "order", "line").agg(F.sum("l_quantity").cast("bigint").alias("size"), F.min("l_suppkey").cast("bigint").alias("supp"))
    w = W.partitionBy("name").orderBy("line")
    off = F.coalesce(F.sum("size").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    g = g.withColumn("off", off).withColumn("total", F.sum("size").over(W.partitionBy("name")))
    return g.select(
        "name", F.lit("Distributed").alias("kind"), F.col("line").cast("int").alias("chunk_idx"),
        F.array("off").alias("offsets"), F.array("size").alias("shape"), F.array("total").alias("tensor_shape"), F.col("supp").alias("file_idx"), "order", "line",
    )


def shifted(chunks: DataFrame) -> DataFrame:
    """T3 with some chunks moved down by one."""
    moved = F.array(F.greatest(F.get("offsets", F.lit(0)) - 1, F.lit(0).cast("bigint")))
    return chunks.withColumn("offsets", F.when((F.col("order") + F.col("line")) % 7 == 0, moved).otherwise(F.col("offsets")))


def thinned(chunks: DataFrame) -> DataFrame:
    """T3 without some chunks."""
    return chunks.where((F.col("order") + F.col("line")) % 5 != 0)


# The same as SQL text.
SQL_E = "e AS (SELECT vec_id AS r, unnest(generate_series(0, 63)) AS c, unnest(embedding)::DOUBLE AS v FROM embeddings), n AS (SELECT count(*)::BIGINT AS n FROM embeddings), m AS (SELECT r, c, floor(v * 1e6 + 0.5)::BIGINT AS u FROM e)"
SQL_T2 = "t2 AS (SELECT p_partkey::BIGINT AS p_partkey, p_name || '.' || p_partkey AS name, p_size::BIGINT AS s0, 8::BIGINT AS s1, CASE p_partkey % 3 WHEN 0 THEN 'F32' WHEN 1 THEN 'BF16' ELSE 'I64' END AS dtype, (p_size * 8 * CASE p_partkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 8 END)::BIGINT AS n_bytes FROM part)"
SQL_T2R = SQL_T2 + ", t2r AS (SELECT p_partkey, ['up_proj','q_proj','c_proj','down_proj','layernorm','q_proj.bias','embed','gate'][(p_partkey % 8 + 1)::INT] || '.' || p_partkey AS name, s0, s1, dtype, n_bytes FROM t2)"
SQL_T3 = "g AS (SELECT l_orderkey::BIGINT AS o, l_linenumber::BIGINT AS l, sum(l_quantity)::BIGINT AS size, min(l_suppkey)::BIGINT AS supp FROM lineitem GROUP BY 1, 2), t3 AS (SELECT o, l, size, supp, (sum(size) OVER (PARTITION BY o ORDER BY l) - size)::BIGINT AS off, (sum(size) OVER (PARTITION BY o))::BIGINT AS total FROM g)"
