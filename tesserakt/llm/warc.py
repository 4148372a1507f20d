"""WARC archives and their capture index.

Writing is done by Spark's text writer, so that archives go to any file system
Spark can write: a record's lines and its payload are UTF-8 text, and the line
separator is the two line ends that close a record. Records of equal payloads
(length and SHA-1) of at least `min_bytes` become one response, that of the
largest id, and revisits that refer to it; smaller ones are all responses.

Reading parses whole archive files by their Content-Length, checks digests, and
gives each file's captures as a run sorted by (URL key, time, id). Runs are
merged by a loser tree: a few sampled keys cut the key space into ranges, every
range takes its stretch of every run in the run's order, and merges them k ways.
Ranges are cut at (URL key, time, id), so a host or a URL with many captures is
spread too.

The time of a capture is a column of the pages (a timestamp), or one time for all. A
null html is empty, a null url reads ``-``, a null time the one time; repeated ids give
a record each; a row without an id is always a response; offsets count from the start
of the unpacked archive; extra columns are ignored; an empty table gives no archive and
no rows. A URL that can't stand in a header line is form-encoded there. A file holds
FILE_RECORDS records at most, fewer where the longest payload would take it beyond
FILE_BYTES, so that no reader holds more; a longer payload is a file of its own.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from urllib.parse import unquote_plus, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserakt.llm.common import materialise, new_path, portion

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
#: Records and unpacked bytes of one archive file, at most; captures of a range of the index, about; keys sampled to cut them, about.
FILE_RECORDS, FILE_BYTES, RANGE_CAPTURES, SAMPLED = 1_000, 256 << 20, 20_000, 50_000
TIME = "2024-01-01T00:00:00Z"


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hexadecimal: 20 bits at a time."""
    out = []
    for i in range(8):
        bits = F.conv(F.substring(hex_digest, 1 + 5 * i, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(ALPHABET), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, time_col: str | None = None) -> DataFrame:
    """id, url, html, time, bytes, digest and refers_to (the id of the response, for revisits)."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    time = F.coalesce(F.date_format(F.to_utc_timestamp(F.col(time_col).cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(TIME)) if time_col else F.lit(TIME)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("-")).alias("url"), html.alias("html"), time.alias("time"))
    rows = rows.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("sha1", F.sha1(F.encode("html", "utf-8")))
    # one small row for each payload that occurs twice or more, before any text is moved
    shared = pages.select(F.col(id_col).cast("long").alias("id"), F.sha1(F.encode(html, "utf-8")).alias("sha1"), F.octet_length(html).cast("long").alias("bytes"))
    shared = shared.filter(F.col("bytes") >= min_bytes).groupBy("sha1").agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha1", "response")
    # ids of revisits only, so that the join moves no payload when copies are few
    revisits = rows.select("id", "sha1", "bytes").join(shared, "sha1").filter((F.col("bytes") >= min_bytes) & (F.col("id") != F.col("response")))
    revisits = revisits.select(F.col("id").alias("_id"), F.col("sha1").alias("_sha1"), "response").distinct()
    out = rows.join(revisits, (rows["id"] == revisits["_id"]) & (rows["sha1"] == revisits["_sha1"]), "left")
    return out.select("id", "url", "html", "time", "bytes", base32(F.col("sha1")).alias("digest"), F.col("response").alias("refers_to"))


def record_text(r: DataFrame) -> Column:
    """A whole record but for the two line ends that close it."""
    plain = F.col("url").rlike(r"^[\x21-\x7e]+$")
    url = F.when(plain, F.col("url")).otherwise(F.concat(F.url_encode("url"), F.lit("\r\nX-Target-Encoding: form")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    revisit = F.col("refers_to").isNotNull()
    uri = lambda c: F.concat(F.lit("<urn:capture:"), c.cast("string"), F.lit(">"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    profile = F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), uri(F.col("refers_to")), F.lit("\r\n"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), uri(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit("\r\nWARC-Date: "), F.col("time"), F.lit("\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("bytes").cast("string"), F.lit("\r\n"), F.when(revisit, profile).otherwise(F.lit("")),
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block,
    )


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, time_col: str | None = None) -> str:
    """Write archives into the folder `path`."""
    rows = records(pages, id_col, url_col, html_col, min_bytes, time_col)
    longest = pages.agg(F.max(F.octet_length(html_col))).first()[0] or 0
    most = max(1, min(FILE_RECORDS, FILE_BYTES // (longest + 2_000)))
    rows.select(record_text(rows).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", most).option("compression", "gzip").text(path)
    return path


def parse(data: bytes) -> Iterator[tuple[dict[str, str], int, int, bytes]]:
    """Headers, offset, length and block of every record of an archive."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:stop].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
        n = int(headers["content-length"])
        end = stop + 4 + n
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end as it says")
        yield headers, at, end + 4 - at, data[stop + 4 : end]
        at = end + 4


def url_key(url: str) -> str:
    """Host labels from the right, then path and query: ``com,example)/path?query``."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/").lower() + ("?" + parts.query.lower() if parts.query else "")


CAPTURE = "url_key string, time string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"


def captures(spark: SparkSession, path: str) -> DataFrame:
    """The captures of each archive file, sorted: a run a file, with each capture's place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                name, data = file.as_py(), content.as_py()
                yield _run(name, gzip.decompress(data) if name.endswith(".gz") else data)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, CAPTURE + ", run_place long")


def _run(file: str, content: bytes) -> pa.RecordBatch:
    rows = []
    for headers, offset, length, block in parse(content):
        body = block[block.index(b"\r\n\r\n") + 4 :]
        digest = headers["warc-payload-digest"].removeprefix("sha1:")
        number = lambda key: int(headers[key][len("<urn:capture:") : -1]) if headers[key] != "<urn:capture:>" else None
        revisit = headers["warc-type"] == "revisit"
        size = int(headers["x-payload-length"])
        if not revisit and (len(body) != size or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
            raise ValueError(f"{file}: the payload at byte {offset} isn't the one written")
        url = headers["warc-target-uri"]
        url = unquote_plus(url) if "x-target-encoding" in headers else url
        rows.append((url_key(url), headers["warc-date"], number("warc-record-id"), url, size, digest, headers["warc-type"], number("warc-refers-to") if revisit else None, file, offset, length))
    rows.sort(key=rank)
    names = [x.split()[0] for x in CAPTURE.split(", ")]
    kinds = [pa.int64() if x.endswith(" long") else pa.string() for x in CAPTURE.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(range(len(rows)), pa.int64())], names=[*names, "run_place"])


def rank(row: tuple) -> tuple:
    """Order of captures: URL key, time, id (none first), then where they are stored."""
    return row[0], row[1], row[2] is not None, row[2] or 0, *row[8:10]


def merge(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Merge sorted iterators by a loser tree: one comparison a level for each item taken.

    Inner node i keeps the loser of the match played there; the winner goes up.
    """
    k = len(runs)
    if not k:
        return
    heads: list[tuple | None] = [next(r, None) for r in runs]

    def beats(a: int, b: int) -> bool:
        x, y = heads[a], heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    losers = [-1] * k
    winner = [0] * (2 * k)
    winner[k:] = range(k)
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    best = winner[1] if k > 1 else 0
    while heads[best] is not None:
        yield heads[best]
        heads[best] = next(runs[best], None)
        node = (best + k) // 2
        while node:
            if beats(losers[node], best):
                losers[node], best = best, losers[node]
            node //= 2


def histories(runs: DataFrame) -> DataFrame:
    """All captures in one global order: `range` and within it `place` count upwards along (url_key, time, page_id)."""
    key = F.struct("url_key", "time", "page_id")
    total = runs.count()
    sample = (runs if total <= SAMPLED else runs.withColumn("_k", F.xxhash64("page_id", "url_key")).filter(portion("_k", SAMPLED, total))).select(key.alias("k"))
    keys = sorted(rank(tuple(r["k"])) for r in sample.limit(2 * SAMPLED).collect())
    ranges = min(max(24, total // RANGE_CAPTURES), len(keys) or 1)
    shared = runs.sparkSession.sparkContext.broadcast([keys[len(keys) * i // ranges] for i in range(1, ranges)])  # fewer than 2 * SAMPLED keys

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        for batch in batches:
            found = [bisect_right(shared.value, rank(k)) for k in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=[*batch.schema.names, "range"])

    def merged(table: pa.Table) -> pa.Table:
        """Merge the stretches that runs have in a range; rows come file by file, each in its run's order."""
        names = [x.split()[0] for x in CAPTURE.split(", ")]
        by_file: dict[str, list[tuple]] = {}
        for row in zip(*(table.column(c).to_pylist() for c in names), strict=True):
            by_file.setdefault(row[8], []).append(row)
        runs = [iter([(rank(x), x) for x in stretch]) for stretch in by_file.values()]
        rows = [r for _, r in merge(runs)]
        part = table.column("range")[0].as_py() if len(rows) else 0
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        arrays = [pa.array(c, table.schema.field(n).type) for c, n in zip(columns, names, strict=True)]
        return pa.Table.from_arrays([*arrays, pa.array([part] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int64())], names=[*names, "range", "place"])

    placed = runs.mapInArrow(place, CAPTURE + ", run_place long, range int")
    ordered = placed.repartition("range").sortWithinPartitions("range", "file", "run_place")
    return ordered.groupBy("range").applyInArrow(merged, CAPTURE + ", range int, place long")


def capture_index(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, path: str | None = None, time_col: str | None = None) -> DataFrame:
    """Write archives of the pages, read them back, and merge their captures into histories."""
    spark = pages.sparkSession
    path = write(pages, path or new_path(spark, "warc"), id_col, url_col, html_col, min_bytes, time_col)
    return histories(materialise(captures(spark, path), "captures"))


def numbered(index: DataFrame) -> DataFrame:
    """The index with each capture's `position` in the whole order, from 0."""
    index = materialise(index, "histories")
    counts = index.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # fewer rows than sampled keys
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return index.join(counts.select("range", before.alias("_before")), "range").withColumn("position", F.col("_before") + F.col("place")).drop("_before")
