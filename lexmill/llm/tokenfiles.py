"""Token ids of whole texts in compressed binary files.

Two passes: texts are encoded once into the shared folder and their ids counted over all documents;
then ids are dealt by ranges of doc_id and written as files of independent blocks, each coded with
the one shared frequency table (see rans). A file, numbers big-endian in headers:

    LXTOKEN1, ordinal u64, blocks u32, documents u64, tokens u64, crc32 of the table u32
    checkpoints, one a block: byte offset u64, tokens before it u64, documents before it u64
    blocks: lanes u32, documents u32, tokens u64, words u64, crc32 of the ids u32, crc32 of the rest u32,
            then states, doc ids, whether each is null, lengths, words
    a line feed

Ordinals ascend with doc_id. A file lies in the folder ordinal=N/tokens=M, so the places of all files are known
from their folders' names. A checkpoint lets a reader start at any block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import fresh_path, prepare, remove, written
from . import rans
from .blobs import read_blobs, write_blobs
from .tokens import encoder, slices

FILE, CHECKPOINT, BLOCK = struct.Struct(">8sQIQQI"), struct.Struct(">QQQ"), struct.Struct(">IIQQII")
BLOCK_TOKENS = 1 << 20


def pack_block(docs: list[int | None], lengths: list[int], tokens: np.ndarray, table: rans.Table) -> bytes:
    states, words = rans.encode(tokens, table)
    ids = np.array([0 if d is None else d for d in docs], dtype="<i8")
    rest = b"".join((states.astype("<u8").tobytes(), ids.tobytes(), bytes(d is None for d in docs), np.array(lengths, dtype="<u8").tobytes(), words.astype("<u4").tobytes()))
    return BLOCK.pack(len(states), len(docs), len(tokens), len(words), zlib.crc32(tokens.astype("<u4").tobytes()), zlib.crc32(rest)) + rest


def unpack_block(data: memoryview, at: int, table: rans.Table) -> list[tuple[int | None, bytes]]:
    lanes, docs, n, words, crc, crc_rest = BLOCK.unpack_from(data, at)
    at += BLOCK.size
    if zlib.crc32(data[at : at + 8 * lanes + 17 * docs + 4 * words]) != crc_rest:
        raise ValueError("damaged block")

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        part = np.frombuffer(data, kind, count, at)
        at += part.nbytes
        return part

    states, ids, nulls, lengths = take("<u8", lanes), take("<i8", docs), take("u1", docs), take("<u8", docs)
    raw = rans.decode(n, states, take("<u4", words), table).astype("<u4").tobytes()
    if zlib.crc32(raw) != crc:
        raise ValueError("damaged block")
    ends = np.cumsum(lengths).tolist()
    return [(None if null else doc, raw[4 * (end - size) : 4 * end]) for doc, null, size, end in zip(ids.tolist(), nulls.tolist(), lengths.tolist(), ends)]


def pack_file(ordinal: int, blocks: list[tuple[int, int, bytes]], table_crc: int) -> bytes:
    """blocks: documents, tokens, bytes."""
    at = FILE.size + CHECKPOINT.size * len(blocks)
    tokens = docs = 0
    marks = []
    for d, n, body in blocks:
        marks.append(CHECKPOINT.pack(at, tokens, docs))
        at, tokens, docs = at + len(body), tokens + n, docs + d
    return b"".join((FILE.pack(b"LXTOKEN1", ordinal, len(blocks), docs, tokens, table_crc), *marks, *(b[2] for b in blocks), b"\n"))


def ordinal_of(data: bytes) -> int:
    return FILE.unpack_from(data)[1]


def unpack_file(data: bytes, table: rans.Table, table_crc: int, first: int = 0, last: int | None = None):
    """doc, tokens of the file before it, ids, of the documents that have any of the file's tokens from first to last (not included); blocks without any are passed over."""
    magic, _, blocks, _, tokens, crc = FILE.unpack_from(data)
    if magic != b"LXTOKEN1" or crc != table_crc:
        raise ValueError("not a token file of this table")
    view = memoryview(data)
    marks = [CHECKPOINT.unpack_from(data, FILE.size + k * CHECKPOINT.size) for k in range(blocks)]
    ends = [m[1] for m in marks[1:]] + [tokens]
    for (at, start, _), end in zip(marks, ends):
        # A document without ids lies where it begins.
        if last is not None and (start >= last or end < first):
            continue
        for doc, ids in unpack_block(view, at, table):
            n = len(ids) // 4
            if last is None or start < last and max(start + n, start + 1) > first:
                yield doc, start, ids
            start += n


def write_tokens(docs: DataFrame, path: str, tokenizer: str, kind: str = "byte", end_id: int | None = 0, vocab: int = 65_536, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = 1 << 23) -> None:
    """Write the ids of every text, end_id after each, to path/table and path/files in ascending doc_id order (null first).

    vocab: no id is as large (a larger one raises); up to 65,536 the ids wait in 16 bits each. file_tokens: about so many
    ids a file. Null text: as empty, end_id alone. Repeated doc ids stay separate documents, next to each other, in an order that their ids tell.
    An empty table writes a table without symbols and no file. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    small = vocab <= 65_536
    narrow = "<u2" if small else "<u4"
    width = int(narrow[2])
    end = b"" if end_id is None else int(end_id).to_bytes(width, "little")

    def to_ids(batches):
        """A row for each document, and a last one with the counts of all ids of the partition."""
        import pyarrow as pa

        encode = encoder(tokenizer, kind, small).encode
        total = np.zeros(vocab, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, text="text"):
                ids = [x + end for x in encode(part.column("text").to_pylist())]
                total += np.bincount(np.frombuffer(b"".join(ids), narrow), minlength=vocab)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, type=pa.binary()), pa.nulls(len(ids), pa.binary())], names=["doc_id", "ids", "counts"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["doc_id", "ids", "counts"])

    def split(batches):
        import pyarrow as pa

        for batch in batches:
            for x in batch.column("counts").to_pylist():
                own = np.frombuffer(x, np.int64)
                seen = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array(seen, type=pa.int64()), pa.array(own[seen], type=pa.int64())], names=["token", "n"])

    whole = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(to_ids, "doc_id long, ids binary, counts binary"), "token-ids")
    # One row for each symbol of the vocabulary at most.
    counts = {r.token: r.n for r in whole.where("counts is not null").select("counts").mapInArrow(split, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()}
    ids = whole.where("ids is not null").select("doc_id", "ids")
    table = rans.Table.of_counts(counts)
    body = table.to_bytes()
    write_blobs(docs.sparkSession.createDataFrame([(bytearray(body),)], "body binary").coalesce(1), "body", f"{path}/table")
    crc = zlib.crc32(body)

    def to_files(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        ordinal = TaskContext.get().partitionId() << 32
        blocks: list[tuple[int, int, bytes]] = []
        owners: list[int | None] = []
        parts: list[bytes] = []
        table = rans.Table.from_bytes(body)
        held = in_file = 0

        def close():
            tokens = np.frombuffer(b"".join(parts), narrow).astype(np.uint32)
            blocks.append((len(owners), len(tokens), pack_block(owners, [len(p) // width for p in parts], tokens, table)))
            owners.clear()
            parts.clear()

        def out():
            made = pa.RecordBatch.from_arrays([pa.array([ordinal], pa.int64()), pa.array([sum(b[1] for b in blocks)], pa.int64()), pa.array([pack_file(ordinal, blocks, crc)], type=pa.binary())], names=["ordinal", "tokens", "body"])
            blocks.clear()
            return made

        for batch in batches:
            for part in slices(batch):
                for doc, x in zip(part.column("doc_id").to_pylist(), part.column("ids").to_pylist()):
                    owners.append(doc)
                    parts.append(x)
                    held += len(x) // width
                    if held >= BLOCK_TOKENS:
                        in_file, held = in_file + held, 0
                        close()
                        if in_file >= 2 * file_tokens:
                            yield out()
                            ordinal, in_file = ordinal + 1, 0
        if owners:
            close()
        if blocks:
            yield out()

    files = max(1, round(sum(counts.values()) / file_tokens))
    order = (F.col("doc_id").asc_nulls_first(), "mark", "ids")
    dealt = ids.withColumn("mark", F.xxhash64("ids")).repartitionByRange(files, *order[:2]).sortWithinPartitions(*order).drop("mark")
    write_blobs(dealt.mapInArrow(to_files, "ordinal long, tokens long, body binary"), "body", f"{path}/files", ("ordinal", "tokens"))
    remove(docs.sparkSession, whole._lexmill_path)


def read_tokens(spark: SparkSession, path: str, first: int = 0, last: int | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32-bit) from files of write_tokens.

    first, last: only the documents that have any of the ids from first to last (not included) of all; other files aren't
    opened and other blocks aren't decoded. The driver gathers two numbers a file, from the folders' names, and the table. A damaged
    block or a table that isn't the files' own raises.
    """
    prepare(spark)
    body = bytes(read_blobs(spark, f"{path}/table").collect()[0].content)
    crc = zlib.crc32(body)
    shape = "doc_id long, start long, n_tokens long, ids binary"
    files = read_blobs(spark, f"{path}/files", ("ordinal", "tokens")).withColumns({c: F.col(c).cast("long") for c in ("ordinal", "tokens")})
    heads = files.select("ordinal", "tokens").toArrow().sort_by("ordinal")
    ordinals, sizes = heads["ordinal"].to_numpy(), heads["tokens"].to_numpy()
    starts = np.cumsum(sizes) - sizes
    if last is not None:
        wanted = ordinals[(starts < last) & (starts + np.maximum(sizes, 1) > first)]
        files = files.where(F.col("ordinal").between(int(wanted[0]), int(wanted[-1]))) if len(wanted) else files.where("false")
    known = spark.sparkContext.broadcast((ordinals, starts))

    def run(batches):
        import pyarrow as pa

        table = rans.Table.from_bytes(body)
        ordinals, starts = known.value
        for batch in batches:
            for ordinal, content in zip(batch.column("ordinal").to_pylist(), batch.column("content")):
                data = content.as_py()
                if ordinal != ordinal_of(data):
                    raise ValueError("a file lies in another one's folder")
                before = int(starts[np.searchsorted(ordinals, ordinal)])
                rows: list[tuple] = []
                for doc, start, ids in unpack_file(data, table, crc, max(0, first - before), None if last is None else last - before):
                    rows.append((doc, before + start, len(ids) // 4, ids))
                    if len(rows) >= 1000:
                        yield _rows(pa, rows)
                        rows = []
                if rows:
                    yield _rows(pa, rows)

    return files.select("ordinal", "content").mapInArrow(run, shape)


def _rows(pa, rows):
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))


def new_path(spark: SparkSession) -> str:
    return fresh_path(spark, "token-files")
