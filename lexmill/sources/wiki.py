"""Pages of wiki dumps, plain or bz2, split into many partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import wikitext
from ..functions.text import preprocess, strip

#: What a title holds that names no article.
SKIPPED_TITLES = ("disambiguation", "list of", "index of")
TEXT = T.StructType([T.StructField("_VALUE", T.StringType())])
REVISION = T.StructType([T.StructField("text", TEXT)])
PAGE = T.StructType([T.StructField("title", T.StringType()), T.StructField("ns", T.StringType()), T.StructField("revision", REVISION)])


#: Between pages: what every page's end tag ends in, whatever its prefix, as a separator of rows; the end of a page's row; its start, if it has attributes; a tag's prefix.
BETWEEN, ENDED, STARTED, PREFIX = "page>", r"</(?:[A-Za-z_][\w.-]*:)?[\w.-]*$", r"(?s)^.*<(?:[A-Za-z_][\w.-]*:)?[\w.-]*page\s[^<>]*>", r"<(/?)[A-Za-z_][\w.-]*:"


def parse_pages(chunks: DataFrame, column: str = "value") -> DataFrame:
    """title, ns, text of each page that ends at a row's end; rows were cut at BETWEEN. Tags may have any prefix; page is every name that ends so."""
    inner = F.regexp_replace(F.regexp_replace(column, ENDED, ""), STARTED, "")
    prefixed = F.col(column).rlike(r"</[A-Za-z_][\w.-]*:[\w.-]*$")
    inner = F.when(prefixed, F.regexp_replace(inner, PREFIX, "<$1")).otherwise(inner)
    parsed = F.from_xml(F.concat(F.lit("<page>"), inner, F.lit("</page>")), PAGE, {"ignoreSurroundingSpaces": "false", "rowTag": "page"})
    # The text element may carry attributes or none: its own text is read either way.
    # Made as rows of a generator, pages are parsed once: a filter on their fields isn't moved below it, which would parse for each field anew.
    return chunks.where(F.col(column).rlike(ENDED)).select(F.explode(F.array(parsed)).alias("p")).select("p.title", "p.ns", F.col("p.revision.text._VALUE").alias("text"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """title, ns, text of a dump's pages, from any file system of Spark's, bz2 in many parts. In a dump > is &gt; in texts, so files split at page>."""
    return parse_pages(spark.read.text(path, lineSep=BETWEEN))


def is_article(ns, title, text):
    """Main namespace (a missing or unreadable one counts), no list or disambiguation title, text there and no redirect."""
    own = F.coalesce(ns.try_cast("int") == 0, F.lit(True))
    listed = F.lit(False)
    for name in SKIPPED_TITLES:
        listed = listed | F.coalesce(F.contains(F.lower(title), F.lit(name)), F.lit(False))
    return own & ~listed & text.isNotNull() & (text != "") & ~F.startswith(F.lower(text), F.lit("#redirect"))


def unreadable(pages: DataFrame) -> DataFrame:
    """title of the pages that are articles but whose markup can't be read: articles() leaves them out."""
    return pages.where(is_article(strip("ns"), F.col("title"), F.col("text"))).where(wikitext.plain_column("text").isNull()).select("title")


def articles(pages: DataFrame, min_length: int = 500, max_articles: int | None = None, unicode_form: str | None = "NFC", keep: tuple[str, ...] = (), observation: Observation | str | None = None, **options) -> DataFrame:
    """title, text (clean) of the pages that are articles of min_length characters at least.

    Cheap filters come before the scanner. Pages whose markup can't be read are left out (see unreadable). max_articles
    counts after all filters, in no set order (see dumpsource.first_articles); 0 or None is no limit. keep: columns of pages to keep.

    observation (a name for streams) gets, from the same pass, the number of pages, of not_articles, of those
    unreadable, of those that are short and of those kept. It doesn't go with max_articles, which would end the pass early.
    """
    own = is_article(strip("ns"), F.col("title"), F.col("text"))

    def cleaned(rows: DataFrame) -> DataFrame:
        # Each text goes through the workers and the passes once: the filter on its length isn't moved below a generator, and no branch repeats what was before.
        rows = rows.withColumn("text", wikitext.plain_column("text", once=True)).withColumn("text", wikitext.markup_passes("text"))
        return rows.select(*(c for c in rows.columns if c != "text"), F.explode(F.array(preprocess("text", unicode_form, once=True, **options))).alias("text"))

    if observation is None:
        out = cleaned(pages.where(own).select(*keep, "title", "text")).where(F.length("text") >= min_length)
        return out.limit(max_articles) if max_articles else out
    if max_articles:
        raise ValueError("pages are counted in a whole pass: no max_articles")
    # Only articles' texts go to the scanner, as above.
    rows = cleaned(pages.select(*keep, "title", own.alias("__own"), F.when(own, F.col("text")).alias("text")))
    read, long = F.col("text").isNotNull(), F.length("text") >= min_length
    counts = {"pages": F.lit(True), "not_articles": ~F.col("__own"), "unreadable": F.col("__own") & ~read, "short": F.col("__own") & ~long, "kept": F.col("__own") & long}
    return rows.observe(observation, *(F.count_if(c).alias(name) for name, c in counts.items())).where(F.col("__own") & long).drop("__own")


def read_articles(spark: SparkSession, path: str, **options) -> DataFrame:
    return articles(read_pages(spark, path), **options)


def download(spark: SparkSession, url: str, folder: str) -> str:
    """The place in folder of a copy of the file at url, under its last part's name; a file that is there already is not fetched again.

    url is anything that Spark's file systems read, http and https among them. A copy cut short leaves no file of that name.
    """
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    hadoop = jvm.org.apache.hadoop.fs
    source, name = hadoop.Path(url), url.split("?")[0].rstrip("/").rsplit("/", 1)[-1]
    place, part = hadoop.Path(f"{folder}/{name}"), hadoop.Path(f"{folder}/.{name}.part")
    system = place.getFileSystem(conf)
    if not system.exists(place):
        system.mkdirs(hadoop.Path(folder))
        hadoop.FileUtil.copy(source.getFileSystem(conf), source, system, part, False, True, conf)
        system.rename(part, place)
    return place.toString()
