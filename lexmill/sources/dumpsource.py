"""Wiki dumps as a format of Spark's, for reads, streams and SQL: spark.read.format("wikidump").load(path).

A file is cut into ranges of bytes, each of which a task reads with a pull parser from the first page that begins in it to the end of
the last one. Elements are told by their local names, so any namespace or prefix goes, and a page is every
element whose name ends in page. Paths are local or of a file system that Arrow knows; other ones are read by wiki.read_pages.
"""

from __future__ import annotations

import bz2
import re
from collections.abc import Iterator
from dataclasses import dataclass
from xml.parsers import expat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..runtime import prepare, temporary, written

FORMAT = "wikidump"
SCHEMA = "title string, ns string, text string, split int, pos long"
SPLIT_BYTES = 64 << 20
CHUNK = 1 << 20
#: Where a page begins: what a range is entered by, and where reading goes on behind a page that can't be read.
BEGIN = re.compile(rb"<(?:[A-Za-z_][\w.-]*:)?[\w.-]*page(?=[\s/>])")
#: Of a tag's name so much at most may lie at a chunk's end. What a parser reads first: pages have a root then.
LONGEST_TAG, ROOT = 256, b"<pages>"


def local(name: str) -> str:
    return name.rsplit(":", 1)[-1]


class PullParser:
    """Pages (title, ns, text) of what is fed, from where a page begins; each takes the first title, ns and text within it, null where there is none."""

    def __init__(self):
        self.parser = expat.ParserCreate()
        self.parser.buffer_text = True
        # Newer parsers else keep back what came last, which at a dump's end is the last page.
        if hasattr(self.parser, "SetReparseDeferralEnabled"):
            self.parser.SetReparseDeferralEnabled(False)
        self.parser.StartElementHandler, self.parser.EndElementHandler, self.parser.CharacterDataHandler = self.start, self.end, self.data
        self.found: list[tuple[int, tuple]] = []
        self.depth = 0
        self.page: dict | None = None
        self.field: tuple[str, int] | None = None
        self.parser.Parse(ROOT, False)

    def start(self, name, _):
        self.depth += 1
        name = local(name)
        if self.page is None:
            if self.depth > 1 and name.endswith("page"):
                self.page = {"depth": self.depth, "at": self.parser.CurrentByteIndex - len(ROOT)}
        elif name in ("title", "ns", "text") and name not in self.page:
            self.page[name] = []
            self.field = (name, self.depth)

    def end(self, _):
        if self.field and self.field[1] == self.depth:
            self.field = None
        if self.page and self.page["depth"] == self.depth:
            text = lambda k: "".join(self.page[k]) if k in self.page else None
            self.found.append((self.page["at"], (text("title"), text("ns"), text("text"))))
            self.page = self.field = None
        self.depth -= 1

    def data(self, text):
        # Text of a field's own, not of elements within it.
        if self.field and self.field[1] == self.depth:
            self.page[self.field[0]].append(text)

    def feed(self, chunk: bytes) -> bool:
        """Whether it could be read."""
        try:
            self.parser.Parse(chunk, False)
            return True
        except expat.ExpatError:
            return False

    def failed(self) -> int:
        return self.parser.ErrorByteIndex - len(ROOT)

    def taken(self) -> list[tuple[int, tuple]]:
        """The pages that have ended since, each with the place where it begins, from the first byte fed."""
        out, self.found = self.found, []
        return out


def pages(chunks: Iterator[bytes], end: int | None) -> Iterator[tuple]:
    """The pages that begin in the first end bytes of what chunks go through (all: None). A page that can't be read is left out; reading goes on at the next one."""
    held, base, fed = b"", 0, 0  # bytes from the page that is open on, where they begin, how many of them the parser has
    parser, origin = None, 0
    for chunk in chunks:
        held += chunk
        while fed < len(held):
            if parser is None:
                m = BEGIN.search(held)
                at = m.start() if m else max(0, len(held) - LONGEST_TAG)
                held, base = held[at:], base + at
                if end is not None and base >= end:
                    return
                if m is None:
                    break
                parser, origin = PullParser(), base
            broken = not parser.feed(held[fed:])
            for at, page in parser.taken():
                if end is not None and origin + at >= end:
                    return
                yield page
            fed = len(held)
            # A tag may have begun in a chunk that is gone.
            if broken:
                at = max(0, (parser.page["at"] if parser.page else parser.failed()) + origin - base + 1)
                parser, fed = None, 0
            else:
                at = max(0, parser.page["at"] + origin - base) if parser.page else len(held)
                fed -= at
            held, base = held[at:], base + at
            if parser and parser.page is None and end is not None and base >= end:
                return


def located(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int, int]]:
    """Name, size and time of the files that path is or holds, by name; hidden ones and those that writers mark with _ don't count."""
    from pyarrow import fs

    system, place = located(path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [i for i in system.get_file_info(fs.FileSelector(place, recursive=True)) if i.type == fs.FileType.File]
    shown = lambda name: not any(part[0] in "._" for part in name.removeprefix(info.path).split("/") if part)
    return sorted((i.path, i.size, i.mtime_ns or 0) for i in found if shown(i.path))


@dataclass
class Range(InputPartition):
    """Bytes start to end of a file, and the place of this range among all."""

    path: str
    name: str
    start: int
    end: int | None
    split: int


def ranges(path: str, files: list[tuple[str, int, int]], split_bytes: int) -> list[Range]:
    """In the order of the dump. A file of bz2 is one range: its streams can't be entered everywhere."""
    out: list[Range] = []
    for name, size, _ in files:
        starts = [0] if name.endswith(".bz2") else range(0, max(1, size), split_bytes)
        for start in starts:
            out.append(Range(path, name, start, None if name.endswith(".bz2") else min(size, start + split_bytes), len(out)))
    return out


def chunks_of(own: Range) -> Iterator[bytes]:
    system, _ = located(own.path)
    with system.open_input_file(own.name) as f:
        f.seek(own.start)
        unpack = bz2.BZ2Decompressor() if own.name.endswith(".bz2") else None
        while chunk := f.read(CHUNK):
            while unpack and chunk:
                yield unpack.decompress(chunk)
                chunk = b""
                if unpack.eof:
                    chunk, unpack = unpack.unused_data, bz2.BZ2Decompressor()
            if chunk:
                yield chunk


def read(own: Range):
    import pyarrow as pa

    rows: list[tuple] = []
    size = 0

    def out():
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64()))], names=["title", "ns", "text", "split", "pos"])
        rows.clear()
        return made

    for pos, (title, ns, text) in enumerate(pages(chunks_of(own), None if own.end is None else own.end - own.start)):
        rows.append((title, ns, text, own.split, pos))
        size += len(text or "")
        if size > 1 << 20 or len(rows) >= 1_000:
            yield out()
            size = 0
    if rows:
        yield out()


class DumpReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split_bytes = options["path"], int(options.get("splitBytes", SPLIT_BYTES))
        self.first, self.last = int(options.get("fromSplit", 0)), int(options.get("toSplit", 1 << 31))

    def partitions(self):
        own = ranges(self.path, files_of(self.path), self.split_bytes)
        return own[self.first : self.last]

    def read(self, partition):
        return read(partition) if partition else iter(())


class DumpStream(DataSourceStreamReader):
    """Files as they come, by time and name; each batch reads those that came since the last."""

    def __init__(self, options):
        self.path, self.split_bytes = options["path"], int(options.get("splitBytes", SPLIT_BYTES))

    def initialOffset(self):
        return {"time": -1, "name": ""}

    def latestOffset(self):
        time, name = max(((t, n) for n, _, t in files_of(self.path)), default=(-1, ""))
        return {"time": time, "name": name}

    def partitions(self, start, end):
        key = lambda o: (o["time"], o["name"])
        return ranges(self.path, [f for f in files_of(self.path) if key(start) < (f[2], f[0]) <= key(end)], self.split_bytes)

    def read(self, partition):
        return read(partition)

    def commit(self, end):
        pass


class WikiDump(DataSource):
    """Options: path (a file or a folder), splitBytes (bytes of a range), fromSplit and toSplit (only these of the ranges, in the dump's order).

    Columns: title, ns, text (null where a page has none), split and pos: the place of the page in the dump.
    """

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return DumpReader(self.options)

    def streamReader(self, schema):
        return DumpStream(self.options)


def register(spark: SparkSession) -> None:
    """Let the session know the format by its name."""
    prepare(spark)
    spark.dataSource.register(WikiDump)


def read_pages(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, first: int = 0, last: int = 1 << 31) -> DataFrame:
    """title, ns, text, split, pos of the pages of the dump's ranges first to last (not included)."""
    register(spark)
    return spark.read.format(FORMAT).option("splitBytes", split_bytes).option("fromSplit", first).option("toSplit", last).load(path)


def first_articles(spark: SparkSession, path: str, n: int, split_bytes: int = SPLIT_BYTES, **options) -> DataFrame:
    """split, pos, title, text of the first n articles in the order of the dump (see wiki.articles for options), whatever the ranges.

    Ranges are read a few at a time, twice as many each time: what they keep is counted by range, and none is read once the counts
    add up to n. The driver gathers a count a range.
    """
    from . import wiki

    prepare(spark)
    total = len(ranges(path, files_of(path), split_bytes))
    frames: list[DataFrame] = []
    at, step, kept = 0, 1, 0
    with temporary(spark) as scope:
        while at < total and kept < n:
            own = written(wiki.articles(read_pages(spark, path, split_bytes, at, at + step), keep=("split", "pos"), **options), "articles")
            counts = sorted((r.split, r["count"]) for r in own.groupBy("split").count().collect())
            frames.append(own)
            for split, count in counts:
                if kept < n <= kept + count:
                    # The last range that is needed.
                    frames[-1] = own.where(F.col("split") <= split)
                kept += count
            at, step = at + step, 2 * step
        out = frames[0] if frames else wiki.articles(read_pages(spark, path, split_bytes, 0, 0), keep=("split", "pos"), **options)
        for f in frames[1:]:
            out = out.unionByName(f)
        out = written(out.orderBy("split", "pos").limit(n), "first-articles")
        scope.keep(out)
    return out
