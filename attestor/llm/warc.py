"""WARC archives: segmented, chunked records written by Spark, and reassembled.

Writing. A page becomes an HTTP response whose body is sent in chunks. A
response longer than ``SEGMENT_BYTES`` is cut into a first record and
continuation records, which name the first one as their origin and count from 2;
the last carries the total length. Of pages with equal payloads of at least
``MIN_REVISIT`` bytes, the one with the largest page_id is archived, the others
are revisit records that refer to it. The files are written by Spark's text
writer, whose rows may be any bytes and whose line end is the two empty lines
that end a record; so they lie wherever Spark can write.

Reading. Whole files are parsed by the lengths that the records state, never by
what their contents look like. Segments are grouped by the identifier of their
origin, ordered by number, checked for gaps and for the total length, joined and
freed of their chunk framing. A group is one record: its size is that of one
payload, and records in one piece are not shuffled. Revisits get length and
digest of what they refer to by a join.

Defined results: a null or empty html has payload b"" and is a response; a
page_id that repeats with the same payload counts once in choosing the response
(all its rows are responses if it is the largest), and each of its rows is
archived and returned; a null page_id is a response; a missing or further
segment, a wrong total and broken framing stop the job with the record's
identifier; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, shared_dir, table

MIN_REVISIT = 1000
SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
ARCHIVE_BYTES = 8 << 20
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def record_id(page_id: str | None, payload: bytes) -> str:
    """A fixed identifier for the record of a page and its payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{hashlib.sha1(payload).hexdigest()}')}>"


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """A body in chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for c in (body[k : k + size] for k in range(0, len(body), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """The body of chunked transfer framing; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk without a size line")
        size = int(framed[at:end].split(b";")[0].strip(), 16)
        if size == 0:
            return b"".join(out)
        if framed[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("chunk does not end where its size says")
        out.append(framed[end + 2 : end + 2 + size])
        at = end + 4 + size


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def records_of(page_id: str | None, url: str | None, html: str | None, refers_to: str | None) -> Iterator[bytes]:
    """The records of one page: a revisit, or a response in one or more segments."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    rid, target = record_id(page_id, payload), re.sub(r"[\r\n]", " ", url or f"page:{page_id}")
    common = [("WARC-Target-URI", target), ("WARC-Date", "2020-01-01T00:00:00Z"), *([("X-Page-Id", page_id)] if page_id is not None else [])]
    if refers_to is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", rid), *common, ("WARC-Refers-To", record_id(refers_to, payload)), ("WARC-Profile", PROFILE)], HTTP_HEAD)
        return
    block = HTTP_HEAD + chunked(payload)
    parts = [block[k : k + SEGMENT_BYTES] for k in range(0, len(block), SEGMENT_BYTES)]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", rid), *common, ("Content-Type", "application/http; msgtype=response")]
    yield _record(first + [("WARC-Segment-Number", 1)] * (len(parts) > 1), parts[0])
    for n, part in enumerate(parts[1:], 2):
        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{rid}#{n}')}>"
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", own), *common[:2], ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", n)]
        yield _record(more + [("WARC-Segment-Total-Length", len(block))] * (n == len(parts)), part)


def with_revisits(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with refers_to: the largest page_id of equal payloads, where that is another one.

    Copies meet only as one count and one maximum for each digest and task.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("key"), (F.length(payload) >= MIN_REVISIT).alias("large"))
    copies = keyed.where("large").groupBy("key").agg(F.max("page_id").alias("last"), F.min("page_id").alias("one")).where("last > one").select(F.col("key").alias("copy_key"), "last")
    # few payloads have copies: while they are, pages don't move
    copies = bounded(cut(copies, "copies"))
    joined = keyed.join(copies, keyed["key"] == copies["copy_key"], "left")
    return joined.select("page_id", "url", "html", F.when(F.col("large") & (F.col("last") != F.col("page_id")), F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes pages(page_id, url, html, refers_to) as WARC files of about ``archive_bytes`` each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 256):
                part = b.iloc[k : k + 256]
                made = (r for row in zip(part["page_id"], part["url"], part["html"], part["refers_to"], strict=True) for r in records_of(*row))
                yield pd.DataFrame({"record": list(made)})

    ids = pages.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})  # long with nulls would be float in pandas
    made = ids.select("page_id", "url", "html", "refers_to").mapInPandas(run, "record binary").select(F.col("record").cast("string").alias("value"))
    # a record goes to a file by its digest, so equal inputs give equal files; their number follows the size of what is written
    size = pages.agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + 600)).first()[0] or 0
    made.repartition(max(1, -(-size // archive_bytes)), F.xxhash64("value")).write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


FIELDS = "record_id string, type string, page_id string, refers_to string, origin string, segment int, total long, block binary"


def parse_archive(data: bytes) -> Iterator[tuple]:
    """The records of one file, by the lengths they state."""
    at = 0
    while at < len(data):
        end = data.index(END, at)
        head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        if len(data) < end + 4 + size:
            raise ValueError(f"{head.get('WARC-Record-ID')} ends before its length")
        block = data[end + 4 : end + 4 + size]
        page, number, total = head.get("X-Page-Id"), head.get("WARC-Segment-Number"), head.get("WARC-Segment-Total-Length")
        yield head["WARC-Record-ID"], head["WARC-Type"], page, head.get("WARC-Refers-To"), head.get("WARC-Segment-Origin-ID"), number and int(number), total and int(total), block
        at = end + 4 + size + len(END)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below ``path``. A file is one task's work at a time; files have a bounded size."""
    import gzip

    names = [f.strip() for f in FIELDS.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else bytes(content)
                rows = []
                for r in parse_archive(data):
                    rows.append(r)
                    if len(rows) == 512:
                        yield frame(rows)
                        rows = []
                yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[n.split()[0] for n in names])
        return out.astype({"segment": "Int32", "total": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(run, FIELDS).withColumn("page_id", F.col("page_id").cast("long"))


def body_of(block: bytes) -> bytes:
    """The payload of an HTTP response, freed of chunk framing if its head says so."""
    head, _, rest = block.partition(END)
    return unchunked(rest) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head) else rest


def reassemble(records: DataFrame) -> DataFrame:
    """Responses and revisits in one piece: record_id, type, page_id, refers_to, payload (null for revisits).

    Segments of one record are joined once, by the task that frees them of their framing.
    """
    segmented = records.where("segment IS NOT NULL")
    whole = records.where("segment IS NULL").select("record_id", "type", "page_id", "refers_to", F.array("block").alias("parts"))
    rid = F.coalesce("origin", "record_id").alias("record_id")
    # rows that repeat make records that repeat: one of each goes on, with its number
    each = segmented.groupBy(rid, "segment", F.sha1("block").alias("digest"), "type", "page_id", "total").agg(F.first("block").alias("block"), F.count("*").alias("n"))
    groups = each.groupBy("record_id").agg(F.max(F.when(F.col("segment") == 1, F.col("type"))).alias("type"), F.max("page_id").alias("page_id"), F.max("total").alias("total"), F.sum(F.length("block")).alias("size"), F.min("n").alias("least"), F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"))
    numbers = F.transform("parts", lambda p: p["segment"])
    good = (F.coalesce(F.col("total"), F.lit(-1)) == F.col("size")) & (numbers == F.sequence(F.lit(1), F.size("parts"))) & (F.col("least") == F.col("n"))
    wrong = F.raise_error(F.concat(F.lit("segments do not fit: "), F.col("record_id")))
    groups = groups.withColumn("parts", F.when(good, F.transform("parts", lambda p: p["block"])).otherwise(wrong))
    groups = groups.select("record_id", "type", "page_id", F.lit(None).cast("string").alias("refers_to"), "parts", F.explode(F.sequence(F.lit(1), "n")).alias("copy")).drop("copy")

    @F.pandas_udf("binary")
    def payload(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: body_of(b"".join(p)))

    both = whole.unionByName(groups)
    responses = both.where("type = 'response'").withColumn("payload", payload("parts")).drop("parts")
    return responses.unionByName(both.where("type = 'revisit'").withColumn("payload", F.lit(None).cast("binary")).drop("parts"))


def digests(whole: DataFrame) -> DataFrame:
    """page_id, length and SHA-1 of the full payload, kind of record, and the page a revisit refers to."""
    measured = whole.select("record_id", "type", "page_id", "refers_to", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    measured = cut(measured, "measures")  # read three times; without it archives would be parsed as often
    visits = measured.where("type = 'revisit'").select("page_id", "refers_to")
    responses = measured.where("type = 'response'").drop("refers_to", "type")
    # a page_id that repeats gives equal records, so one row for each identifier
    known = responses.groupBy("record_id").agg(*(F.max(c).alias(c) for c in ("page_id", "payload_bytes", "payload_digest")))
    of = known.select("record_id", F.col("page_id").alias("refers_page"), "payload_bytes", "payload_digest")
    found = visits.join(of, visits["refers_to"] == of["record_id"]).select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("refers_page").alias("refers_to"))
    return responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(found)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(with_revisits(table(spark, sf_dir, "pages")), path)
    return digests(reassemble(read_records(spark, path)))


WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, lower(sha1(b)) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN last END AS refers_to
FROM m"""

QUERIES = {"op3_warc": op3_warc}
ORACLES = {"op3_warc": WARC_SQL}
