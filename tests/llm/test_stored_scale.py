"""Steps of the operators that must not do or keep work more than once."""

import os

from pyspark.sql import functions as F


def shuffle_bytes(folder):
    return sum(os.path.getsize(os.path.join(r, f)) for r, _, files in os.walk(folder) for f in files if f.startswith("shuffle_"))


def test_nodes_of_a_host_are_told_once(spark, monkeypatch):
    """A host's style nodes come with its first page in a task or ahead of its pages, not with every page; results are the same."""
    from tesselar.llm import site_style

    page = "<body><nav>{0}</nav><div class=m>same</div><div><p>own text {1} of {0} " + "word " * 30 + "</p></div></body>"
    rows = [(i, f"http://h{i % 3}.org/{i}", page.format(i % 3, i)) for i in range(60)] + [(100, None, None), (101, "http://one.org", page.format(9, 9))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    plan = site_style.extract(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert "first#" in plan and "told#" in plan
    hot = {r["page_id"]: r["text"] for r in site_style.extract(pages).collect()}
    monkeypatch.setattr(site_style, "HOT_SHARE", 0)
    assert {r["page_id"]: r["text"] for r in site_style.extract(pages).collect()} == hot  # no host is broadcast
    assert len(hot) == 62 and hot[100] == "" and all(f"own text {i} of {i % 3}" in hot[i] for i in range(60))


def test_known_nodes():
    import pyarrow as pa

    from tesselar.llm.site_style import Known

    low = [{"node": n, "importance": n / 7, "styles": 3} for n in (5, -2, 1 << 62, -(1 << 62))]
    known = Known(pa.array(low, pa.struct([("node", pa.int64()), ("importance", pa.float64()), ("styles", pa.int64())])))
    assert all(known.get(x["node"], None) == (x["importance"], 3) for x in low) and known.get(6, (1.0, 1)) == (1.0, 1) and known.get((1 << 63) - 1, None) is None


def test_stored_tables_leave_no_shuffle_files(spark):
    """What a table was shuffled by goes when it is written: the files of several writes don't add up."""
    import time

    from tesselar.llm.common import CLEAN_SHUFFLES, stored

    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    size = lambda: sum(map(shuffle_bytes, folders))
    before = size()
    spark.conf.unset(CLEAN_SHUFFLES)
    one = stored(spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).repartition(4, "id"), "some")
    for _ in range(50):
        if size() - before < 1_000_000:
            break
        time.sleep(0.1)
    assert size() - before < 1_000_000 and one.count() == 200_000 and spark.conf.get(CLEAN_SHUFFLES, None) != "true"
