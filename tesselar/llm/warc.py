"""Web archives: writing WARC records, reading them back, and a globally ordered capture index.

Writing is a compressed text sink: a record is a string of headers and block, and the line separator is the
CRLF CRLF that ends a WARC record, so Spark's committer makes the files on any file system.  Every file gives one
locally sorted capture run, which is stored.  Splitters sampled from the runs cut every run into blocks, each a stretch of
one run within one range of (URL key, timestamp, page, place): a hot URL is cut by time.  Blocks are moved whole, so they
keep the order of their run, and a loser tree merges the blocks of a range, MERGED at a time, into capture histories.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_schema

from tesselar.llm.common import join_stats, new_path, shuffle_partitions, stored

CRLF = "\r\n"
END = CRLF + CRLF
#: Payloads below this size are never revisits.
MIN_REVISIT_BYTES = 1000
#: Archives are cut into files of about this many bytes.
FILE_BYTES = 16 << 20
#: Runs that one pass of a merge takes in; a range of more runs is merged in passes.
MERGED = 64
#: Sampled captures per splitter, and splitters at most.
PER_SPLITTER, SPLITTERS = 20, 50_000
INDEX = "url_key string, timestamp string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, target string, file string, position long, size long"
NAMES = [c.split()[0] for c in INDEX.split(", ")]
#: The order of captures; a null page id comes first, and file and position tell repeated rows apart.
ORDER = ["url_key", "timestamp", "page_id", "file", "position"]


def url_key(url: Column) -> Column:
    """A sort-friendly key: host labels reversed, then the path, without scheme, www, port 80/443 and fragment."""
    rest = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"(^www\d*\.)|(:(80|443)$)", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1), r"/+$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)


def _one_line(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n]+", "%0A")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one WARC record per row of pages under path.

    A null html is an empty payload; a null URL is an empty target; a row with a null id has a record id of its own, is
    never revisited, but revisits an equal payload that has an id.  Of equal payloads of at least MIN_REVISIT_BYTES the
    one with the largest id is the response (rows repeated with that id too) and the others revisit it.  Payloads count
    as equal if their SHA-256 and length are; the SHA-1 in the records doesn't decide.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    rows = rows.withColumn("payload", F.unhex(F.sha2(F.col("html").cast("binary"), 256))).withColumn("bytes", F.octet_length("html").cast("long"))
    sizes = stored(rows.select("payload", "bytes", "page_id"), "payloads")  # payloads are hashed and read once for all that follows
    groups = sizes.where(F.col("bytes") >= MIN_REVISIT_BYTES).groupBy("payload", "bytes").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
    groups = stored(groups.where("n > 1"), "payload-groups")
    total, weight = sizes.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    # which rows revisit is settled on ids; payloads aren't shuffled for it
    revisits = join_stats(sizes, groups, ["payload", "bytes"], "n", total).where("page_id IS NULL OR page_id < kept").where("kept IS NOT NULL")
    revisits = revisits.select(F.col("page_id").alias("r_page"), F.col("payload").alias("r_payload"), "kept").distinct()
    rows = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("payload") == F.col("r_payload")), "left")
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    again = F.col("kept").isNotNull()
    record_id = F.when(F.col("page_id").isNull(), F.concat(F.lit("<urn:uuid:"), F.uuid())).otherwise(F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string")))
    when = F.date_format(F.timestamp_seconds(F.lit(1_500_000_000) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(again, "").otherwise(F.col("html")))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF + "WARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit(CRLF + "WARC-Record-ID: "), record_id,
        F.lit(">" + CRLF + "WARC-Date: "), when,
        F.lit(CRLF + "WARC-Target-URI: "), _one_line(F.col("url")),
        F.lit(CRLF + "WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(again, F.concat(F.lit(CRLF + "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF + "WARC-Refers-To: <urn:page:"), F.col("kept").cast("string"), F.lit(">"))).otherwise(""),
        F.lit(CRLF + "Content-Type: application/http; msgtype=response" + CRLF + "Content-Length: "), F.octet_length(block).cast("string"),
        F.lit(END),
    )
    per_file = max(1, FILE_BYTES * max(total, 1) // max(weight, 1))
    text = rows.select(F.concat(header, block).alias("value"))
    text.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, block, position, size) of each record of an archive file."""
    at, end = 0, len(data)
    while at < end:
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = head + 4
        stop = start + int(headers["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} isn't ended")
        yield headers, data[start:stop], at, stop + 4 - at
        at = stop + 4


def _page(urn: str) -> int | None:
    kind, _, value = urn.strip("<>").rpartition(":")
    return int(value) if kind == "urn:page" else None


def capture_runs(path: str, spark) -> DataFrame:
    """One sorted run per archive file, the columns of INDEX, with payloads checked against their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                rows = []
                for h, block, at, size in parse(gzip.decompress(data.as_buffer())):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    n_bytes = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                    if h["warc-type"] == "response" and (len(payload) != n_bytes or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"the payload at {at} of {name} isn't what its headers say")
                    refers = _page(h["warc-refers-to"]) if "warc-refers-to" in h else None
                    rows.append((name, h["warc-target-uri"], h["warc-date"], _page(h["warc-record-id"]), h["warc-type"], n_bytes, digest, refers, at, size))
                types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                cols = list(zip(*rows)) if rows else [()] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["file", "target", "timestamp", "page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "position", "size"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = "file string, target string, timestamp string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, position long, size long"
    found = files.mapInArrow(run, schema).withColumn("url_key", url_key(F.col("target")))
    return found.select(*NAMES).sortWithinPartitions("file", *ORDER)


class LoserTree:
    """k-way merge of sorted lists: inner nodes keep the loser of their match, the winner is at the top."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs, self.k, self.at = runs, len(runs), [0] * len(runs)
        self.losers = [-1] * max(self.k, 1)
        for run in range(self.k - 1, -1, -1):
            self._play(run)

    def _head(self, run: int) -> tuple | None:
        return self.runs[run][self.at[run]] if self.at[run] < len(self.runs[run]) else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, run: int) -> None:
        node = (run + self.k) // 2
        while node:
            if self.losers[node] < 0:  # still empty while building: wait here for the other side
                self.losers[node] = run
                return
            if self._beats(self.losers[node], run):
                self.losers[node], run = run, self.losers[node]
            node //= 2
        self.losers[0] = run

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (head := self._head(run := self.losers[0])) is not None:
            yield head
            self.at[run] += 1
            self._play(run)


def merged(runs: list[list[tuple]]) -> list[tuple]:
    """The runs in one, by passes that merge MERGED at a time."""
    while len(runs) > 1:
        runs = [list(LoserTree(runs[lo : lo + MERGED])) for lo in range(0, len(runs), MERGED)]
    return runs[0] if runs else []


def _keys(columns: dict[str, list]) -> list[tuple]:
    return list(zip(columns["url_key"], columns["timestamp"], ((-1 if p is None else 0, p or 0) for p in columns["page_id"]), columns["file"], columns["position"]))


def merged_index(runs: DataFrame, rows_per_range: int = 100_000) -> DataFrame:
    """The runs' captures in global order: ranges in order, each sorted.

    runs: the columns of INDEX, each file's rows in ORDER and together.  A range holds about rows_per_range captures
    (more beyond SPLITTERS ranges), which is what a task merges in memory.
    """
    spark = runs.sparkSession
    runs = stored(runs, "capture-runs")
    total = runs.count()
    n = min(SPLITTERS, max(shuffle_partitions(spark), -(-total // rows_per_range)))
    fraction = min(1.0, PER_SPLITTER * n / max(1, total))
    sample = runs.select(*ORDER).sample(fraction, seed=1).limit(2 * PER_SPLITTER * n).collect()  # bounded by SPLITTERS
    sample = sorted(_keys({c: [r[c] for r in sample] for c in ORDER}))
    cuts = spark.sparkContext.broadcast([sample[k * len(sample) // n] for k in range(1, n)] if sample else [])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for b in batches:
            columns = {c: b.column(c).to_pylist() for c in ORDER}
            place = [bisect.bisect_right(cuts.value, k) for k in _keys(columns)]
            file = columns["file"]
            first = [0, *(k for k in range(1, b.num_rows) if place[k] != place[k - 1] or file[k] != file[k - 1])] if b.num_rows else []
            rows = pa.ListArray.from_arrays(pa.array([*first, b.num_rows], pa.int32()), pa.StructArray.from_arrays(b.columns, fields=list(arrow)))
            seqs = pa.array(range(seq, seq + len(first)), pa.int64())
            seq += len(first)
            yield pa.RecordBatch.from_arrays([pa.array([place[k] for k in first], pa.int32()), pa.array([file[k] for k in first], pa.string()), seqs, rows], ["place", "run", "seq", "rows"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches([pa.RecordBatch.from_struct_array(x) for x in held])
            keys = _keys({c: table.column(c).to_pylist() for c in ORDER})
            starts = [0, *(k for k in range(1, len(keys)) if keys[k] < keys[k - 1])]  # a stored run may have been read in parts
            order = [item[-1] for item in merged([[(*keys[k], k) for k in range(lo, hi)] for lo, hi in zip(starts, [*starts[1:], len(keys)])])]
            for lo in range(0, len(order), 10_000):
                yield from table.take(pa.array(order[lo : lo + 10_000])).cast(arrow).combine_chunks().to_batches()

        at, held = None, []
        for b in batches:
            for place, rows in zip(b.column(0).to_pylist(), b.column(3)):
                if place != at and held:
                    yield from ended()
                    held = []
                at = place
                held.append(rows.values)
        if held:
            yield from ended()

    arrow = to_arrow_schema(runs.schema)
    cut = runs.mapInArrow(blocks, f"place int, run string, seq long, rows array<struct<{', '.join(c.replace(' ', ':') for c in INDEX.split(', '))}>>")
    dealt = cut.repartitionByRange(n, "place").sortWithinPartitions("place", "run", "seq")
    return dealt.mapInArrow(merge, runs.schema)


def archive(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages as WARC under path (a new shared folder by default), read the files back, merge their index.

    One row per page with the columns of INDEX.  An empty table gives no rows; repeated rows give a record each;
    other columns are ignored.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write(pages, path, id_col, url_col, html_col)
    return merged_index(capture_runs(path, spark))
