"""WARC archives: writing with revisit records, reading back, and a merged index.

Writing: pages with equal payloads get one response record, the other captures a
revisit record that refers to it. Each archive is a run of captures sorted by
URL key, timestamp and id; a run ends at a bound of bytes. Records are made as columns and written by Spark's text
writer, whose separator is the blank line that ends a WARC record, so archives
go wherever Spark can write. Reading: every archive is parsed by its records'
lengths, payload digests are checked, and its index entries are a sorted run.
Merging: the runs' entries are dealt out by ranges of (URL key, timestamp), and
each task merges its slices of all runs with a loser tree, so that the tasks'
outputs, one after the other, are the ordered histories of all captures.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from factloom.llm.common import join_counted, materialize, new_path

BLANK = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Equal payloads of at least so many bytes are written once.
MIN_BYTES = 0
#: Where the payloads of an archive end: it has less than so many bytes of them and one record more.
ARCHIVE_BYTES = 16_000_000
#: About what a record's headers take.
RECORD_BYTES = 700
#: The day (UTC) of the first capture.
FIRST_DAY = "2024-01-01"


def base32_digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, five hex digits to four letters."""
    hex_ = F.sha1(payload)
    letters = []
    for k in range(8):
        bits = F.conv(F.substring(hex_, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(bits, by).bitwiseAND(31) + 1, F.lit(1)) for by in (15, 10, 5, 0)]
    return F.concat(*letters)


def url_key(url: Column) -> Column:
    """Host labels from the right, then path and query, in small letters."""
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)"
    host = F.regexp_replace(F.lower(F.regexp_extract(url, pattern, 1)), r"^www\d*\.", "")
    path = F.lower(F.regexp_extract(url, pattern, 2))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", F.lit("/")).otherwise(path))
    return F.when(host != "", key).otherwise(F.lower(F.coalesce(url, F.lit(""))))


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def capture_date(seconds: Column) -> Column:
    """The time so many seconds after the first capture's day began, in UTC whatever the
    session's zone is."""
    part = lambda unit, size: F.lpad(F.pmod(F.call_function("div", seconds, F.lit(unit)), F.lit(size)).cast("string"), 2, "0")
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), F.call_function("div", seconds, F.lit(86_400)).cast("int")).cast("string")
    return F.concat(day, F.lit("T"), part(3600, 24), F.lit(":"), part(60, 60), F.lit(":"), part(1, 60), F.lit("Z"))


def _dealt(bound: int):
    """Number of the run that each record of a partition belongs to, by bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            size = np.asarray(batch.column(batch.schema.get_field_index("bytes"))) + RECORD_BYTES
            ends = done + np.cumsum(size, dtype=np.int64)
            done = int(ends[-1]) if len(ends) else done
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((ends - size) // bound, pa.int64())], names=[*batch.schema.names, "run"])

    return run


#: One order of captures throughout: null ids come last.
CAPTURE_ORDER = [F.asc, F.asc, F.asc_nulls_last]


def _in_order(*columns: str) -> list[Column]:
    return [by(c) for by, c in zip(CAPTURE_ORDER, columns, strict=True)]


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """One record for each row, into archives under ``path``.

    A null payload is empty. Of equal payloads the rows with the smallest id (a
    null id comes last) are responses, more than one if that id is repeated. A
    null URL leaves the header out; line ends in a URL are percent-encoded.
    """
    html = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    page = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.replace(F.replace(F.col(url_col).cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"),
        html.alias("payload"),
    ).withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")})
    narrow = materialize(page.select("page_id", "digest", "bytes"), "payloads")
    groups = narrow.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    # only narrow rows meet by payload; whole pages are joined by their own id, where
    # they stay as they are as long as the copies are few enough for Spark to broadcast
    groups = materialize(groups, "groups")
    copies = join_counted(narrow, groups, ["digest"], "n", narrow.count()).where(~F.col("page_id").eqNullSafe(F.col("first")))
    copies = materialize(copies.select("page_id", "digest", F.col("first").alias("refers_to")).distinct(), "copies")
    if copies.take(1):
        same = page["page_id"].eqNullSafe(copies["page_id"]) & (page["digest"] == copies["digest"])
        page = page.join(copies, same, "left").select(page["*"], copies["refers_to"])
    else:
        page = page.withColumn("refers_to", F.lit(None).cast("long"))

    first = F.col("refers_to").isNull()
    digest = base32_digest(F.col("payload"))
    seconds = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(100_000_000))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(BLANK))
    block = F.when(first, F.concat(http, F.col("payload").cast("string"))).otherwise(http)
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(first, F.lit("response")).otherwise(F.lit("revisit")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        line("WARC-Date", capture_date(seconds)),
        F.coalesce(line("WARC-Target-URI", F.col("url")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.coalesce(line("X-Page-ID", F.col("page_id").cast("string")), F.lit("")),
        F.when(first, F.lit("")).otherwise(
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("digest"))),
                line("X-Refers-To-Page", F.col("refers_to").cast("string")),
            )
        ),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
    )
    # pages stay in the partitions that they come in: a run needs to be sorted only in itself
    schema = StructType([*page.schema.fields, StructField("run", LongType())])
    dealt = page.mapInArrow(_dealt(max(archive_bytes, 1)), schema)
    records = dealt.select("run", url_key(F.col("url")).alias("key"), seconds.alias("at"), "page_id", F.concat(header, F.lit(BLANK), block).alias("value"))
    runs = records.sortWithinPartitions("run", *_in_order("key", "at", "page_id")).select("run", "value")
    runs.write.option("lineSep", BLANK).partitionBy("run").text(path)


def parse_archive(data: bytes) -> Iterator[dict]:
    """Records of an archive in order. Lengths alone tell where a record ends, so
    payloads may hold anything; a payload that doesn't match its digest is an error."""
    at, blank = 0, BLANK.encode()
    while at < len(data):
        end = data.index(blank, at)
        first, *lines = data[at:end].split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(b": ", 1) for x in lines)
        start = end + len(blank)
        stop = start + int(headers[b"Content-Length"])
        if data[stop : stop + len(blank)] != blank:
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        http_end = data.index(blank, start)
        http = dict(x.split(b": ", 1) for x in data[start:http_end].split(b"\r\n")[1:])
        kind = headers[b"WARC-Type"].decode()
        digest = headers[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
        payload = data[http_end + len(blank) : stop]
        if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"the payload at byte {at} doesn't match its digest")
        page, refers = headers.get(b"X-Page-ID"), headers.get(b"X-Refers-To-Page")
        yield {
            "page_id": int(page) if page is not None else None,
            "payload_bytes": len(payload) if kind == "response" else int(http[b"Content-Length"]),
            "payload_digest": digest,
            "record_type": kind,
            "refers_to": int(refers) if refers is not None else None,
            "url": headers[b"WARC-Target-URI"].decode() if b"WARC-Target-URI" in headers else None,
            "captured_at": headers[b"WARC-Date"].decode(),
            "offset": at,
            "length": stop + len(blank) - at,
            "payload": payload if kind == "response" else None,
        }
        at = stop + len(blank)


_ENTRY = [
    ("page_id", pa.int64()),
    ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()),
    ("record_type", pa.string()),
    ("refers_to", pa.int64()),
    ("url", pa.string()),
    ("captured_at", pa.string()),
    ("offset", pa.int64()),
    ("length", pa.int64()),
]
ENTRY_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, captured_at string, offset long, length long, archive string, number long"


def _reader(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _ENTRY + [("archive", pa.string()), ("number", pa.int64())] + ([("payload", pa.binary())] if with_payload else [])
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, archive = [], "/".join(name.as_py().split("/")[-2:])
                for number, entry in enumerate(parse_archive(content.as_py())):
                    rows.append(entry | {"archive": archive, "number": number})
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in kinds], names=[c for c, _ in kinds])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in kinds], names=[c for c, _ in kinds])

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row for each record of the archives under ``path``; an archive is named by
    its run and its file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(_reader(with_payload), ENTRY_SCHEMA + ", payload binary" * with_payload)


def merge_runs(runs: Sequence[Sequence]) -> Iterator[tuple[int, int]]:
    """(run, position) of all entries in order, by a loser tree over the runs'
    heads; each run is sorted, and equal entries come in the order of runs."""
    k = len(runs)
    if not k:
        return
    at = [0] * k

    def beats(a: int, b: int) -> bool:
        """Does the head of run a go before that of run b? A spent run loses."""
        if a < 0 or b < 0:
            return b < 0 <= a
        x, y = (runs[a][at[a]] if at[a] < len(runs[a]) else None), (runs[b][at[b]] if at[b] < len(runs[b]) else None)
        if x is None or y is None:
            return y is None and x is not None
        return x < y or (x == y and a < b)

    # leaves k .. 2k-1 are the runs; an inner node keeps the loser of its match
    winner = [0] * k + list(range(k))
    loser = [-1] * k
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], loser[node] = (a, b) if beats(a, b) else (b, a)
    top = winner[1] if k > 1 else 0
    while at[top] < len(runs[top]):
        yield top, at[top]
        at[top] += 1
        node = (top + k) // 2
        while node:
            if beats(loser[node], top):
                top, loser[node] = loser[node], top
            node //= 2


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge of one range's slices of all runs. The slice sizes are the range
    partitioning's to bound: entries are a few hundred bytes, pages stay behind."""
    held = list(batches)
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    archive = np.asarray(rows["archive"].combine_chunks().dictionary_encode().indices)
    order = np.lexsort((rows["number"].to_numpy(), archive))
    keys = list(zip(*(rows[c].to_pylist() for c in ("url_key", "captured_at")), [(x is None, x or 0) for x in rows["page_id"].to_pylist()], strict=True))
    starts = np.flatnonzero(np.concatenate([[True], archive[order][1:] != archive[order][:-1]]))
    runs = [[keys[i] for i in order[a:b]] for a, b in zip(starts, [*starts[1:], len(order)], strict=True)]
    merged = rows.take(pa.array([order[starts[r] + i] for r, i in merge_runs(runs)]))
    yield from merged.to_batches(max_chunksize=10_000)


def capture_histories(entries: DataFrame) -> DataFrame:
    """All index entries in order of (url_key, captured_at, page_id), null ids
    last: each partition is merged, and partitions follow one another."""
    keyed = materialize(entries.withColumn("url_key", url_key(F.col("url"))), "index")
    # rows of one hot URL are split by time and id
    ranged = keyed.repartitionByRange(*_in_order("url_key", "captured_at", "page_id"))
    return ranged.mapInArrow(_merge, keyed.schema)


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages to archives, read them back and merge the index.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to,
    url_key, captured_at, archive, offset and length of every record, in order of
    URL key and timestamp. Null ids and payloads, repeated rows and empty tables
    are as ``write_archives`` says; other columns are not read.
    """
    spark = pages.sparkSession
    path = new_path(spark, "archives")
    write_archives(pages, path, id_col, url_col, payload_col, min_bytes, archive_bytes)
    found = capture_histories(read_archives(spark, path))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "archive", "offset", "length")
