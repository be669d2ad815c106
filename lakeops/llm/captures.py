"""WARC archives of pages, and their capture index merged from sorted runs.

``write`` puts one record per page into gzipped WARC 1.1 files of bounded size in a shared folder
(positions are those in the unpacked file).  Of
pages with equal payloads of ``least`` bytes or more, the one of the largest id is a response and
the others are revisits that refer to it; all smaller ones are responses.  ``read`` parses the
archives back by the records' lengths, one archive per row, and gives each archive's index as a
run sorted by URL key, time and id.  ``history`` merges the runs into one global order: the rows
are dealt to ranges of that order, and each range merges its part of every run with a loser
tree.  A URL with any number of captures is split over ranges by time and id.

Defined results: a null html is an empty payload; a null URL has an empty target; line breaks in
URLs become %0D and %0A.  A row is told by its id and payload, so rows of one id with unlike html are
judged each by its own; rows with the largest id of their payload are responses even where
repeated; a row without an id is a response.  Rows of equal key, time and id are in the order of
archive and position.  An archive is one value when it is read, so the longest html has to fit
into a task's memory a few times.  An empty table gives no archives and no rows.  Other
columns of the input are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.session import scratch_path, settle

END = "\r\n"
FIELDS = (
    "url_key string, captured string, page_id long, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, archive string, position long, length long"
)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def revisits(marks: DataFrame, least: int) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload a page of a larger id has, too."""
    large = marks.where(F.col("bytes") >= least)
    kept = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return large.join(kept, "digest").where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, path: str, least: int = 1000, archive_bytes: int = 16 << 20, captured: Column | None = None) -> None:
    """Write the archives.  ``captured`` is the time of capture; by default it follows the id."""
    html = F.coalesce("html", F.lit(""))
    if captured is None:
        captured = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(31_536_000)))
    page = F.col("page_id").cast("long").alias("page_id")
    rows = pages.select(page, F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), captured.alias("captured"), F.sha1(html).alias("digest"))
    marks = settle(rows.select("page_id", F.octet_length("html").cast("long").alias("bytes"), "digest"), "warc-marks")
    total = marks.agg(F.coalesce(F.sum(F.col("bytes") + 600), F.lit(0))).first()[0]
    # Rows without an id are dealt by a number of their own, and match no revisit.
    rows = rows.withColumn("deal", F.when(F.col("page_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0).cast("long")))
    keys = ["page_id", "digest", "deal"]
    # Always 0, but no literal: one would be taken out of the join's keys, and the rows dealt twice.
    again = revisits(marks, least).withColumn("deal", F.col("page_id") % F.lit(1).cast("long"))
    dealt = rows.repartition(-(-total // archive_bytes) or 1, *keys).join(again, keys, "left")
    again = F.col("refers_to").isNotNull()
    size = F.octet_length("html").cast("long")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), size.cast("string"), F.lit(END * 2))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    refers = F.concat(F.lit(f"WARC-Profile: {PROFILE}{END}WARC-Refers-To: "), urn(F.col("refers_to")), F.lit(END))
    length = F.octet_length(http) + F.when(again, 0).otherwise(size)
    head = F.concat(
        F.lit(f"WARC/1.1{END}WARC-Type: "),
        F.when(again, "revisit").otherwise("response"),
        F.lit(f"{END}WARC-Record-ID: "),
        urn(F.col("page_id")),
        F.lit(f"{END}WARC-Date: "),
        F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit(f"{END}WARC-Target-URI: "),
        url,
        F.lit(f"{END}WARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit(END),
        F.when(again, refers).otherwise(""),
        F.lit(f"Content-Type: application/http; msgtype=response{END}Content-Length: "),
        length.cast("string"),
        F.lit(END * 2),
    )
    record = F.concat(head, http, F.when(again, "").otherwise(F.col("html")))
    # Two line ends close a record, so they are the writer's line end.
    dealt.select(record.alias("value")).write.option("lineSep", END * 2).option("compression", "gzip").text(path)


def url_key(url: str) -> str:
    """Host labels from the last to the first, then the rest: ``org,example)/a``."""
    rest = url.partition("://")[2] or url
    cut = re.search(r"[/?#]|$", rest).start()
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:].partition("#")[0]


def number(urn_text: str | None) -> int | None:
    digits = (urn_text or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(position, length, headers, payload) of every record of an archive."""
    at = 0
    while at < len(content):
        begin = content.index(b"\r\n\r\n", at) + 4
        first, *lines = content[at : begin - 4].decode().split(END)
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        end = begin + int(headers["Content-Length"])
        payload = content[content.index(b"\r\n\r\n", begin, end) + 4 : end]
        yield at, end + 4 - at, headers, payload
        at = end + 4


def entries(archive: str, content: bytes) -> list[tuple]:
    """The archive's index, sorted.  A response's digest is made anew and must be the one stated."""
    out = []
    for at, length, headers, payload in records(content):
        kind, stated = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and hashlib.sha1(payload).hexdigest() != stated:
            raise ValueError(f"{archive}: payload at {at} is not what its digest says")
        captured = re.sub(r"\D", "", headers["WARC-Date"])
        page, refers = number(headers["WARC-Record-ID"]), number(headers.get("WARC-Refers-To"))
        size = len(payload) if kind == "response" else None
        out.append((url_key(headers["WARC-Target-URI"]), captured, page, kind, refers, size, stated, archive, at, length))
    return sorted(out, key=rank)


def rank(row: tuple) -> tuple:
    return row[0].encode(), row[1], row[2] is not None, row[2] or 0, row[7], row[8]


def batch_of(rows: list[tuple], extra: tuple[str, pa.DataType] | None = None) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    names, types = zip(*[(f.split()[0], kinds[f.split()[1]]) for f in FIELDS.split(", ")])
    if extra:
        names, types = (*names, extra[0]), (*types, extra[1])
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=list(names))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The archives' runs, one row per record, each archive's rows in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                yield batch_of(entries(name.as_py().rpartition("/")[2], gzip.decompress(content.as_py())))

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInArrow(run, FIELDS)


def merge(runs: list[list]) -> Iterator:
    """K-way merge by a loser tree: each inner node keeps the loser of its match, so the next
    winner costs one path to the root."""
    k = len(runs)
    if not k:
        return
    heads = [iter(r) for r in runs]
    last = object()
    keys: list = [next(h, last) for h in heads]

    def less(a: int, b: int) -> bool:
        if keys[a] is last or keys[b] is last:
            return keys[b] is last and keys[a] is not last
        return keys[a][0] < keys[b][0]

    losers = [0] * k
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        a, b = (b, a) if less(b, a) else (a, b)
        winners[node], losers[node] = a, b
    best = winners[1]
    while keys[best] is not last:
        yield keys[best][1]
        keys[best] = next(heads[best], last)
        node = (best + k) // 2
        while node:
            if less(losers[node], best):
                best, losers[node] = losers[node], best
            node //= 2


def history(found: DataFrame, range_rows: int = 50_000) -> DataFrame:
    """The runs in one global order: rows of ``found`` with ``place``, which rises with it."""
    ranges = -(-found.count() // range_rows) or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        runs: dict[str, list] = {}
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns[:10]]):
                runs.setdefault(row[7], []).append((rank(row), row))
        for rows in runs.values():
            rows.sort(key=lambda r: r[0])  # the run's own order, should the shuffle have turned it
        first = TaskContext.get().partitionId() << 40
        merged = [(*row, first + i) for i, row in enumerate(merge(list(runs.values())))]
        for at in range(0, len(merged), 10_000):
            yield batch_of(merged[at : at + 10_000], ("place", pa.int64()))

    dealt = found.repartitionByRange(ranges, "url_key", "captured", "page_id", "archive", "position")
    return dealt.mapInArrow(run, f"{FIELDS}, place long")


def resolved(index: DataFrame) -> DataFrame:
    """The index with every revisit's payload size taken from the record it refers to."""
    whole = index.where("record_type = 'response'").groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("size"))
    whole = whole.select(F.col("page_id").alias("refers_to"), "payload_digest", "size")
    both = index.join(whole, ["refers_to", "payload_digest"], "left")
    return both.withColumn("payload_bytes", F.coalesce("payload_bytes", "size")).select(*index.columns)


def archive_history(pages: DataFrame, least: int = 1000, path: str | None = None) -> DataFrame:
    """Write the pages' archives, read them back, and give the resolved history of all captures."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write(pages, path, least)
    return resolved(history(settle(read(spark, path), "warc-runs")))
