"""WARC archives of pages, and a merged index of their captures.

Writing: records are strings that Spark's text writer ends with the two line ends of the format, so
tasks, retries and commits are Spark's own. An equal payload of REVISIT_BYTES or more is stored once,
as the response of the largest page_id; the others are revisit records that refer to it.

Index: each archive is read record by record by Content-Length and gives one run of captures, sorted
by URL key and time. Runs are dealt out by ranges of (key, time, page_id); within a range a loser
tree merges the runs, so the output is in global order: all captures of a URL in a row, by time.
Ranges include the page_id, so one URL with very many captures is spread over many tasks.

Archives are cut by number of records in classes of size (SIZES), each written on its own, so an archive
stays below 128 MB or holds one record; a page may be as long as a row can be.

The pages carry no time of capture, so it is derived: the page id modulo SPAN seconds after EPOCH, in UTC
whatever zone the session has. Any BIGINT, negative ones too, is a page id.

Null html is an empty payload; a null url has no target and the empty key, which comes first.
Repeated rows give repeated records; two rows with the largest page_id are both responses. A null
page_id is kept. Payloads are equal when SHA-1 and length are. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parkpulse.llm.shared import partitions, read_table, shared_folder, written

REVISIT_BYTES = 1000
#: (payload bytes below which, records of one archive); a task reads an archive as a whole.
SIZES = ((1 << 16, 2000), (1 << 21, 64), (None, 1))
#: Captures that a task merges.
RANGE_CAPTURES = 200_000
#: Time of the capture of page 0, and the seconds over which captures are spread.
EPOCH, SPAN = "2024-01-01 00:00:00", 1_000_000_000

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = (
    "url_key string, captured string, page_id bigint, payload_bytes bigint, payload_digest string,"
    " record_type string, refers_to bigint, url string, archive string, at bigint"
)
_FIELDS = [x.split()[0] for x in _INDEX.split(",")]
_ARROW = pa.schema([(n, pa.int64() if k == "bigint" else pa.string()) for n, k in (x.split() for x in _INDEX.split(","))])


def with_record_types(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to."""
    html = F.coalesce("html", F.lit(""))
    pages = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        "url",
        html.alias("html"),
        F.octet_length(html).cast("bigint").alias("payload_bytes"),
        F.sha1(html).alias("payload_digest"),
    )
    key = ["payload_digest", "payload_bytes"]
    # Only repeated payloads; hashes, not payloads, are shuffled, after adding up in each task.
    repeated = written(
        pages.where(F.col("payload_bytes") >= REVISIT_BYTES)
        .groupBy(*key)
        .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return pages.join(repeated, key, "left").select(
        "page_id", "url", "html", *key,
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def _record():
    def line(name, value):
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    def record_id(column):
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(">"))

    nothing = F.lit("")
    revisit = F.col("record_type") == "revisit"
    seconds = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(SPAN))
    nought = F.lit(0)
    # Without a zone from end to end: a zone would shift times, or skip an hour in spring.
    time = F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(nought, nought, nought, seconds.cast("decimal(18,6)"))
    date = F.concat(F.replace(time.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", record_id("page_id")),
        line("WARC-Date", date),
        F.coalesce(line("WARC-Target-URI", url), nothing),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(_PROFILE)), line("WARC-Refers-To", record_id("refers_to")))).otherwise(nothing),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_archives(pages: DataFrame, folder: str) -> None:
    """Write a record per page into gzipped archives, of as many records as SIZES gives for their size."""
    typed = with_record_types(pages)
    least = 0
    for below, count in SIZES:
        of_size = F.col("payload_bytes") >= least
        if below is not None:
            of_size &= F.col("payload_bytes") < below
            least = below
        (
            typed.where(of_size)
            .select(_record().alias("value"))
            .write.mode("append")
            .option("lineSep", "\r\n\r\n")
            .option("maxRecordsPerFile", count)
            .option("compression", "gzip")
            .text(folder)
        )


def url_key(url: str | None) -> str:
    """Sortable form: host labels from the right, path, query; without scheme, `www.` and fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    host = host.removeprefix("www.")
    place = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    return f"{place}){(parts.path or '/').lower()}" + (f"?{parts.query.lower()}" if parts.query else "")


def records(data: bytes):
    """(offset, headers, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        begin, size = end + 4, int(headers["Content-Length"])
        yield at, headers, data[begin : begin + size]
        at = begin + size
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where it says")
        at += 4


def _page(value: str) -> int | None:
    value = value[len("<urn:page:") : -1]
    return int(value) if value else None


def _capture(at: int, headers: dict, block: bytes, archive: str) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = headers["WARC-Type"]
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(http.rpartition(b"Content-Length: ")[2])
    if kind == "response":
        size, found = len(payload), hashlib.sha1(payload).hexdigest()
        if found != digest:
            raise ValueError(f"payload of {headers['WARC-Record-ID']} does not have its digest")
    url = headers.get("WARC-Target-URI")
    refers = _page(headers["WARC-Refers-To"]) if kind == "revisit" else None
    return url_key(url), headers["WARC-Date"], _page(headers["WARC-Record-ID"]), size, digest, kind, refers, url, archive, at


def _order(capture: tuple) -> tuple:
    page = capture[2]
    return capture[0].encode(), capture[1], page is not None, page or 0


def capture_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of each archive below `folder`, as one sorted run per archive."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = zlib.decompressobj(31).decompress(content.as_buffer())
                found = sorted((_capture(*record, path) for record in records(data)), key=_order)
                columns = list(zip(*found, strict=True)) or [()] * len(_FIELDS)
                yield pa.RecordBatch.from_pydict(dict(zip(_FIELDS, columns, strict=True)), _ARROW)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(run, _INDEX)


class LoserTree:
    """Merges sorted runs of keys: inner nodes hold the loser of their match, the winner moves up."""

    def __init__(self, keys: list, runs: list[tuple[int, int]]):
        self.keys, self.at, self.end = keys, [a for a, _ in runs], [z for _, z in runs]
        k = self.k = len(runs)
        self.losers = [-1] * k
        for leaf in range(k - 1, -1, -1):
            self._play(leaf)

    def _before(self, x: int, y: int) -> bool:
        if x < 0 or y < 0:
            return x < 0  # an empty place wins until every run has entered
        if self.at[x] >= self.end[x] or self.at[y] >= self.end[y]:
            return self.at[x] < self.end[x]
        a, b = self.keys[self.at[x]], self.keys[self.at[y]]
        return a < b or (a == b and x < y)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            if self._before(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def merged(self):
        """Positions of all keys in order."""
        while self.k and self.at[best := self.losers[0]] < self.end[best]:
            yield self.at[best]
            self.at[best] += 1
            self._play(best)


def natural_runs(keys: list) -> list[tuple[int, int]]:
    """Maximal stretches in ascending order."""
    cuts = [0, *(i for i in range(1, len(keys)) if keys[i] < keys[i - 1]), len(keys)]
    return [(a, z) for a, z in zip(cuts, cuts[1:]) if a < z]


def merge_runs(captures: DataFrame, ranges: int | None = None) -> DataFrame:
    """All captures in global order of (url_key, captured, page_id).

    Every shuffled block is a piece of one sorted run. A range finds the runs it was sent where the
    order breaks, so it relies on nothing about how they arrive, and merges them. Without `ranges`
    there are as many as keep a range near RANGE_CAPTURES.
    """

    def run(batches):
        table = pa.Table.from_batches(list(batches), _ARROW).combine_chunks()
        keys = [_order(c) for c in zip(*(table[n].to_pylist() for n in ("url_key", "captured", "page_id")), strict=True)]
        order = list(LoserTree(keys, natural_runs(keys)).merged())
        yield from table.take(pa.array(order, pa.int64())).to_batches(max_chunksize=10_000)

    n = ranges or max(partitions(captures.sparkSession), -(-captures.count() // RANGE_CAPTURES))
    return captures.repartitionByRange(n, "url_key", "captured", "page_id").mapInArrow(run, _INDEX)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    write_archives(read_table(spark, sf_dir, "pages"), folder)
    captures = written(capture_runs(spark, folder))
    return merge_runs(captures).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), q AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes)
            ELSE page_id END AS first
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM q
"""
