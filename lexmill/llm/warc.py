"""WARC archives of pages: records compressed one by one with a Zstandard dictionary.

A file is: a skippable frame (magic 0x184D2A5D) that holds the dictionary, a frame with the warcinfo
record, a frame for each record, and a closing skippable frame whose content ends in a line feed.
Any reader of dictionary-compressed WARC takes it: skippable frames carry no data.

Of the pages with equal payloads, found by their SHA-1 over the whole table, the one with the largest
page_id is archived in full; the others are revisit records that refer to it.
"""

from __future__ import annotations

import hashlib
import io
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import fresh_path, prepare, temporary, written
from . import bloom
from .blobs import read_blobs, write_blobs
from .tokens import slices

DICTIONARY_MAGIC, CLOSING_MAGIC = 0x184D2A5D, 0x184D2A50
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in [*headers, ("Content-Length", str(len(block)))])]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(page: int | None) -> str:
    return f"<urn:lexmill:page:{'' if page is None else page}>"


def page_record(page: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers: int | None, revisit: bool, date: str) -> bytes:
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in url or "\n" in url else url))
        if "\r" in url or "\n" in url:
            head.append(("X-Target-URI-Escaped", "yes"))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return record(head, http if revisit else http + payload)


def skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def sample(rows: DataFrame, records: int, longest: int, date: str) -> list[bytes]:
    """At most records pages' records, as if each were archived in full, payloads cut after longest bytes; chosen by the hash of the page's id."""
    n = rows.count()
    if not n:
        return []
    place = F.pmod(F.xxhash64("page_id"), F.lit(1 << 30))
    taken = rows.where(place < int(min(1.0, 1.5 * records / n) * (1 << 30))).select(place.alias("place"), "page_id", "url", F.substring("payload", 1, longest).alias("payload"), "size", "digest")
    found = sorted(taken.limit(2 * records).collect(), key=lambda r: (r.place, r.payload, r.url or ""))[:records]
    return [page_record(r.page_id, r.url, bytes(r.payload), r["size"], r.digest, None, False, date) for r in found]


def train(samples: list[bytes], size: int) -> bytes:
    """A dictionary of about size bytes; of samples too few or too alike to train on, their own bytes; b"" of none."""
    import zstandard

    whole = b"".join(samples)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return whole[-size:] if len(whole) >= 8 else b""


def dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def write_warc(pages: DataFrame, path: str, min_revisit: int = 1000, date: str = "1970-01-01T00:00:00Z", level: int = 6, dict_size: int = 65_536, dict_records: int = 2_000, dict_longest: int = 16_384, file_bytes: int = 32 << 20) -> None:
    """Archive pages (page_id, url, html) under path, one record a row.

    Payloads of at least min_revisit bytes that are equal are stored once (rows that repeat the
    largest page_id are stored each). The dictionary is built from at most dict_records pages' records, with
    dict_longest bytes of each payload at most. file_bytes: a file is closed when its records take so much.
    Null html is an empty payload, a null url has no target URI, a null page_id an empty record id; a
    group whose ids are all null is stored in full each. An empty table writes no file.
    """
    prepare(pages.sparkSession)
    with temporary(pages.sparkSession):
        _write(pages, path, min_revisit, date, level, dict_size, dict_records, dict_longest, file_bytes)


def _write(pages: DataFrame, path: str, min_revisit: int, date: str, level: int, dict_size: int, dict_records: int, dict_longest: int, file_bytes: int) -> None:
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    trained = train(sample(rows, dict_records, dict_longest, date), dict_size)
    # Which pages are revisits is found out without their payloads.
    light = written(rows.select("page_id", "url", "size", "digest"), "digests")
    groups = light.where(F.col("size") >= min_revisit).groupBy("digest", "size").agg(F.max("page_id").alias("refers"), F.count("*").alias("n")).where("n > 1 and refers is not null")
    # Written before it is joined: Spark can split a frequent payload's rows only in a join of plain shuffles.
    groups = written(groups.select("digest", "size", "refers"), "payload-groups")
    revisits = written(light.join(groups, ["digest", "size"]).where(~F.col("page_id").eqNullSafe(F.col("refers"))).select("page_id", "url", "size", "digest", "refers"), "revisits")
    # Payloads stay where they are read.
    none = F.lit(None).cast("long")
    full = bloom.without(rows, light, revisits, ["digest", "page_id"])
    marked = full.select("page_id", "url", "payload", "size", "digest", none.alias("refers"), F.lit(False).alias("revisit"))
    marked = marked.unionByName(revisits.select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "size", "digest", "refers", F.lit(True).alias("revisit")))

    def run(batches):
        import pyarrow as pa
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=level, write_checksum=True, **({"dict_data": dictionary(trained)} if trained else {})).compress
        head = skippable(DICTIONARY_MAGIC, trained) if trained else b""
        frames: list[bytes] = []
        held = 0

        def out():
            made = pa.RecordBatch.from_arrays([pa.array([b"".join((head, *frames, skippable(CLOSING_MAGIC, b"end\n")))], type=pa.binary())], names=["body"])
            frames.clear()
            return made

        for batch in batches:
            for part in slices(batch):
                for row in zip(*(c.to_pylist() for c in part.columns)):
                    if not frames:
                        frames.append(squeeze(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:lexmill:info>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"software: lexmill\r\nformat: WARC File Format 1.1\r\n")))
                    frames.append(squeeze(page_record(*row, date)))
                    held += len(frames[-1])
                    if held >= file_bytes:
                        held = 0
                        yield out()
        if frames:
            yield out()

    write_blobs(marked.mapInArrow(run, "body binary"), "body", path)


def records(data: bytes):
    """Header dictionary and block of each record of a file; a file cut short or damaged raises."""
    import zstandard

    if not data.endswith(skippable(CLOSING_MAGIC, b"end\n")):
        raise ValueError("the archive was cut short")

    magic, size = struct.unpack_from("<II", data)
    own = dictionary(data[8 : 8 + size]) if magic == DICTIONARY_MAGIC else None
    unpack = zstandard.ZstdDecompressor(dict_data=own) if own else zstandard.ZstdDecompressor()
    stream = io.BufferedReader(unpack.stream_reader(data, read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError("not a WARC record")
        head = {}
        while (line := stream.readline()) != b"\r\n":
            if not line:
                raise ValueError("the archive ends within a record")
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            head[k] = v
        block = stream.read(int(head["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("the archive ends within a record")
        yield head, block


def page_of(urn: str) -> int | None:
    digits = urn.removeprefix("<urn:lexmill:page:").removesuffix(">")
    return int(digits) if digits else None


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row a record but for warcinfo: page_id, url, payload_bytes, payload_digest (bare hex), record_type, refers_to, payload (null for revisits).

    A response whose payload doesn't match its digest raises.
    """
    prepare(spark)

    def run(batches):
        import pyarrow as pa

        kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
        rows: list[tuple] = []

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))
            rows.clear()
            return made

        for batch in batches:
            for k in range(batch.num_rows):
                for head, block in records(batch.column("content")[k].as_py()):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    revisit, digest = head["WARC-Type"] == "revisit", head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"damaged payload of {head['WARC-Record-ID']}")
                    url = head.get("WARC-Target-URI")
                    if "X-Target-URI-Escaped" in head:
                        url = url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    rows.append((page_of(head["WARC-Record-ID"]), url, size, digest, head["WARC-Type"], page_of(head["WARC-Refers-To"]) if revisit else None, None if revisit else payload))
                    if len(rows) >= 500:
                        yield out()
        if rows:
            yield out()

    return read_blobs(spark, path).select("content").mapInArrow(run, READ)


def new_path(spark: SparkSession) -> str:
    return fresh_path(spark, "warc")
