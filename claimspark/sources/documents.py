"""Documents of several media types as spans, and a store of snapshots that admits them again.

Files are read by Spark's own binary source, so they may be wherever Spark can read. What a document is decides how it is read: pages by `html`, plain text by
its blank lines; other types have no spans and a flag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.functions import text as X
from claimspark.sources import html

#: The number of the rules by which spans are made; older spans are replaced when their document is admitted again.
PARSER = "spans-v1"
HTML, PLAIN, UNREAD = "text/html", "text/plain", "unread media type"
MEDIA = {"html": HTML, "htm": HTML, "xhtml": HTML, "txt": PLAIN, "text": PLAIN, "md": PLAIN, "pdf": "application/pdf"}
#: Bytes at the beginning of a page in which it may declare its characters.
DECLARED_WITHIN = 2048


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, content, media_type of the files under root whose names fit; the type is that of the name's ending, unknown ones are null."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    media = F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair])
    return read.select("path", "content", F.try_element_at(media, ending).alias("media_type"))


@F.pandas_udf(T.StringType())
def otherwise_decoded(content, charset):
    """Bytes that aren't UTF-8, by what they declare, else as Windows text; what fits neither is replaced."""
    import pandas as pd

    def one(data: bytes | None, name: str | None) -> str | None:
        if data is None:
            return None
        try:
            return bytes(data).decode(name or "cp1252")
        except (LookupError, UnicodeDecodeError):
            return bytes(data).decode("cp1252", "replace")

    return pd.Series([one(d, c) for d, c in zip(content, charset)], dtype=object)


def decoded(content: Column, media_type: Column) -> Column:
    """The text of bytes: as UTF-8 if they are, else by the charset that the media type or the page declares. Only the others leave the JVM."""
    plain = F.try_validate_utf8(content.cast("string"))
    names = r"(?i)charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)"
    head = F.decode(F.substring(content, 1, DECLARED_WITHIN), "ISO-8859-1")
    charset = F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), names, 1), F.lit("")) for c in (media_type, head)])
    text = F.coalesce(plain, otherwise_decoded(F.when(plain.isNull(), content), F.when(plain.isNull(), charset)))
    return F.regexp_replace(text, "^﻿", "")


def kind_of(media_type: Column) -> Column:
    """The media type without its parameters."""
    return F.lower(F.trim(F.substring_index(media_type, ";", 1)))


def spans(documents: DataFrame) -> DataFrame:
    """document, i, kind, text, start, end of (document, content, media_type): spans in order with offsets into the document's text, in which blank lines part them.

    A null content, and one of a media type that isn't read (see `flags`), has no spans.
    """
    kind = kind_of(F.col("media_type"))
    read = documents.where(kind.isin(HTML, PLAIN) & F.col("content").isNotNull()).select("document", kind.alias("kind"), decoded(F.col("content"), F.col("media_type")).alias("text"))
    pages = html.spans(read.where(F.col("kind") == HTML), "document", "text").withColumnRenamed("doc", "document")
    passages = read.where(F.col("kind") == PLAIN).select("document", F.posexplode(X.passages("text")).alias("i", "text"))
    end = F.sum(F.length("text") + 2).over(W.partitionBy("document").orderBy("i")) - 2
    plain = passages.select("document", "i", F.lit("paragraph").alias("kind"), "text", (end - F.length("text")).cast("int").alias("start"), end.cast("int").alias("end"))
    return pages.select(*plain.columns).unionByName(plain)


def flags(media_type: Column) -> Column:
    """What keeps a document from having spans, or null."""
    return F.when(F.coalesce(kind_of(media_type).isin(HTML, PLAIN), F.lit(False)), None).otherwise(UNREAD)


def document_id(content: Column) -> Column:
    return F.concat(F.lit("doc-"), F.substring(F.sha2(content, 256), 1, 16))


KEPT = ("media_type", "url", "published", "admissible")


def admitted(arriving: DataFrame, stored: DataFrame, parser: str = PARSER) -> DataFrame:
    """The store after the arriving (content, media_type, url, published, admissible, retrieved): document, sha256, media_type, url, published, admissible, retrieved, parser, stale.

    A document is its bytes. One that is admitted again keeps what is stored of it, fills in what was missing from the arrivals in the order of retrieval, and gets
    their last time of retrieval and this parser; stale says that its stored spans are of another parser and have to go. One without a time from which it counts
    counts from its publication. Stored rows (the same columns but stale) that nothing arrives for stay as they are. Arrivals of no content are none.
    """
    new = arriving.where("content is not null").select(document_id(F.col("content")).alias("document"), F.sha2("content", 256).alias("sha256"), *KEPT, "retrieved")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("retrieved"))).alias(f"new_{c}")  # noqa: E731  the first arrival that has it
    new = new.groupBy("document").agg(F.first("sha256").alias("new_sha256"), *[first(c) for c in KEPT], F.max("retrieved").alias("new_retrieved"))
    both = stored.join(new, "document", "full")
    again, known = F.col("new_sha256").isNotNull(), F.col("sha256").isNotNull()
    value = {c: F.coalesce(c, f"new_{c}") for c in ("sha256", *KEPT)}
    value["admissible"] = F.when(again, F.coalesce(value["admissible"], value["published"])).otherwise(F.col("admissible"))
    return both.select(
        "document", *[v.alias(c) for c, v in value.items()], F.coalesce("new_retrieved", "retrieved").alias("retrieved"),
        F.when(again, F.lit(parser)).otherwise(F.col("parser")).alias("parser"), (again & known & ~F.col("parser").eqNullSafe(F.lit(parser))).alias("stale"),
    )


def merged_spans(stored: DataFrame, fresh: DataFrame, documents: DataFrame) -> DataFrame:
    """The stored spans (document, i, …) without those of stale documents and those that a fresh one replaces, and the fresh ones."""
    stale = documents.where("stale").select("document")
    left = stored.join(stale, "document", "left_anti").join(fresh.select("document", "i"), ["document", "i"], "left_anti")
    return left.select(*fresh.columns).unionByName(fresh)
