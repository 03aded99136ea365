"""Every core query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tesselar import queries

SF = "/root/testdata/sf0.001"
TABLES = "part lineitem supplier embeddings".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return list(df.columns), sorted(tuple(map(str, r)) for r in df.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the synthetic tables")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, con, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(queries.ORACLES[name]).df())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the synthetic tables")
def test_whole_table_passes_through_files(spark, con, monkeypatch, tmp_path):
    """All rows of embeddings go through several source files, several shards a rank and the fused file."""
    monkeypatch.setattr(queries, "_checkpoint_folder", lambda _: f"file://{tmp_path}")
    monkeypatch.setattr(queries, "FILE_ROWS", 100)
    n = con.sql("SELECT count(*) FROM embeddings").fetchall()[0][0]
    assert queries.checkpoint_roundtrip(spark, SF).count() == n * queries.WIDTH
    k = max(queries.WORLD, -(-n // 100))
    sources, shards = (list((tmp_path / d).glob("*.safetensors")) for d in ("rows", "four"))
    assert len(sources) == k and len(shards) > queries.WORLD
    assert sum(f.stat().st_size for f in sources) > n * queries.WIDTH * 4 and (tmp_path / "back" / "model.safetensors").stat().st_size > n * queries.WIDTH * 4
