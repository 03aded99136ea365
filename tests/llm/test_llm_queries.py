"""The queries' SQL, and the pipeline on the smallest tables."""

import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytest.importorskip("public_tokenizers")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the synthetic tables")


@pytest.mark.parametrize("name", ["op2_warc", "op4_exact_dedup", "op9_quality_rules"])
def test_sql(spark, name):
    from tesselar.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    theirs = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted([tuple(r) for r in df.select(columns).collect()], key=str) == sorted(theirs, key=str)


def test_pipeline(spark):
    import corpus_pipeline
    from tesselar.llm.common import stored, table

    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns and 0 < docs.count() <= before.count()
    assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()}
    for name, stage in corpus_pipeline.STAGES:
        assert stored(stage(spark, table(spark, SF, "documents").limit(0), SF), name).count() == 0


def test_near_stage_against_brute_force(spark):
    """No row goes without a similar row with a smaller id that is linked to it, and clear copies go."""
    import corpus_pipeline

    words = [f"w{k}" for k in range(400)]
    text = lambda s: " ".join(words[(s * 7 + k * (s + 3)) % 400] for k in range(200))
    rows = [(k, text(k)) for k in range(20)] + [(100 + k, text(k) + " tail") for k in range(5)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.near(spark, docs, SF).collect()}
    shingles = {i: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)} for i, t in rows}
    near = {i for i, a in shingles.items() for j, b in shingles.items() if j < i and len(a & b) >= 0.8 * len(a | b)}
    assert kept == {i for i, _ in rows} - near and near == {100, 101, 102, 103, 104}


def test_stages_with_awkward_rows(spark):
    """Null ids and texts, repeated ids and rows, and extra columns of clashing names: each stage keeps what it should."""
    import corpus_pipeline

    words = "the of and to in that is was for on house river stone light cloud tree".split()
    text = lambda s: " ".join(words[(s * 5 + k * k * (s + 1)) % len(words)] + ("" if k % 3 else str((s * 31 + k) % 97)) for k in range(80))
    base = [(1, text(1)), (2, text(2)), (2, text(3)), (2, text(3)), (None, text(4)), (None, text(4)), (None, text(5)), (3, None), (4, ""), (5, text(1)), (6, text(2) + " end"), (7, "call Mr Smith")]
    clash = ["id", "h", "row", "whole", "norm", "digest", "gone_id", "copies", "n_entities_", "tries", "t", "w"]
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t or ""), *clash) for i, t in base], "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} string" for c in clash)).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    key = lambda r: (str(r["doc_id"]), r["text"])
    kept = {name: sorted(map(key, stages[name](spark, docs, SF).collect()), key=str) for name in stages if name != "packing"}
    for name in kept:
        assert stages[name](spark, docs, SF).columns == docs.columns, name
    long = [(str(i), t) for i, t in base if t and len(t.split()) >= 50]
    assert set(kept["quality_rules"]) <= set(long)
    distinct = {}
    for i, t in base:
        distinct.setdefault(t or "", []).append(i)
    assert [t or "" for _, t in kept["exact_dedup"]].__len__() == len(distinct)
    assert {(i, t or "") for i, t in kept["exact_dedup"]} == {(str(min((x for x in ids if x is not None), default=None)), t) for t, ids in distinct.items()}
    near = [(i, t) for i, t in kept["simhash"]]
    assert sorted(near, key=str) == sorted([("1", text(1)), ("2", text(2)), ("2", text(3)), ("None", text(4)), ("None", text(5)), ("3", None), ("7", "call Mr Smith")], key=str)
    assert len(kept["pii"]) == len(base) and not any("Smith" in (t or "") for _, t in kept["pii"])
    pieces = stages["packing"](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == 8 and pieces.count() == len(base)
