"""WARC archives: written by Spark's text writer, read by a Python data source.

A record whose payload is text is text itself, so Spark writes records as lines that end in the WARC
record end (two CR LF), to any file system that it knows, with its own commit.

The reader plans partitions of whole files, takes equality, set, null and prefix predicates on header
columns, parses a record's header first, and passes over the block of a record that the predicates
refuse or whose payload is not asked for.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, Not, StringStartsWith
from pyspark.sql.types import BinaryType, StructType

from plantpulse.llm.shared import new_folder, written

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 1000
#: Bytes of files that one partition reads, by default.
PARTITION_BYTES = 32 << 20

END = "\r\n"
#: Header fields of WARC 1.1, by column; page_id is an extension field.
FIELDS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "content_type": "Content-Type",
    "content_length": "Content-Length",
    "page_id": "X-Page-ID",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, content_type string, content_length bigint, page_id string, payload binary"


def record_id(kind: str, page: Column, digest: Column) -> Column:
    """An id made from the kind of record, the page's id and the payload's digest."""
    h = F.md5(F.concat(F.lit(f"{kind}/"), F.coalesce(page.cast("string"), F.lit("")), F.lit("/"), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``pages`` (page_id, url, html) with payload, digest and first_id.

    first_id is the largest page_id with an equal payload of at least ``least`` bytes where that is another
    page, else null. Rows that repeat this page_id, and rows without an id whose equals have none, have null.
    """
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    long = F.octet_length("payload") >= least
    first = own.where(long).groupBy("digest", F.octet_length("payload").alias("length")).agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = (F.col("o.digest") == F.col("f.digest")) & (F.octet_length("o.payload") == F.col("f.length"))
    other = ~F.col("first_id").eqNullSafe(F.col("page_id"))
    return own.alias("o").join(first.alias("f"), same, "left").select("o.*", F.when(other, F.col("first_id")).alias("first_id"))


def records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One column, value: the WARC record of every row of with_revisits(), without its end."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(END + END))
    revisit, page, digest = F.col("first_id").isNotNull(), F.col("page_id"), F.col("digest")
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    # a control character would end the header field, and white space does not belong in a URI
    uri = F.regexp_replace(F.regexp_replace("url", r"[\x00-\x1F\x7F]", ""), " ", "%20")

    def field(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))

    head = F.concat(
        F.lit(f"WARC/1.1{END}"),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", F.when(revisit, record_id("revisit", page, digest)).otherwise(record_id("response", page, digest))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", uri),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        field("WARC-Profile", F.when(revisit, PROFILE)),
        field("WARC-Refers-To", F.when(revisit, record_id("response", F.col("first_id"), digest))),
        field("X-Page-ID", F.col("page_id").cast("string")),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", F.octet_length(block).cast("string")),
    )
    return pages.select(F.concat(head, F.lit(END), block).alias("value"))


def write_archives(pages: DataFrame, folder: str, compression: str = "gzip") -> None:
    """Write every row of ``pages`` as a record to files below ``folder``; each file is one (gzip) stream of records."""
    records(with_revisits(pages)).write.option("lineSep", END * 2).option("compression", compression).text(folder)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)


class WarcSource(DataSource):
    """``format("warc")``, option path: a folder or file; also partition_bytes. Columns: any of SCHEMA, or header names in lower case."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options, schema)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path = options["path"]
        self.most = int(options.get("partition_bytes", PARTITION_BYTES))
        self.columns = [(f.name, FIELDS.get(f.name, f.name).lower(), f.dataType) for f in schema.fields]
        self.payload = [n for n, _, kind in self.columns if isinstance(kind, BinaryType)]
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keep what a header can answer; the rest goes back to Spark."""
        text = {n: header for n, header, kind in self.columns if kind.simpleString() == "string"}
        kinds = {EqualTo: "in", EqualNullSafe: "in", In: "in", StringStartsWith: "prefix", IsNull: "null", IsNotNull: "some"}
        for given in filters:
            inner = given.child if isinstance(given, Not) and isinstance(given.child, (EqualTo, In)) else given
            name = getattr(inner, "attribute", ())
            kind = kinds.get(type(inner))
            value = getattr(inner, "value", None)
            if kind is None or len(name) != 1 or name[0] not in text or kind == "in" and value is None:
                yield given
                continue
            if kind == "in":
                value = tuple(value) if isinstance(inner, In) else (value,)
            self.tests.append((text[name[0]], "not in" if inner is not given else kind, value))

    def partitions(self) -> Sequence[InputPartition]:
        store, base = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(base)
        found = store.get_file_info(fs.FileSelector(base, recursive=True)) if found.type == fs.FileType.Directory else [found]
        files = sorted((x for x in found if x.type == fs.FileType.File and x.size and not x.base_name.startswith(("_", "."))), key=lambda x: -x.size)
        bins: list[tuple[int, list[str]]] = []
        for x in files:  # largest first; a file joins the last bin that still has room
            if bins and bins[-1][0] + x.size <= self.most:
                bins[-1] = (bins[-1][0] + x.size, [*bins[-1][1], x.path])
            else:
                bins.append((x.size, [x.path]))
        return [Files(paths) for _, paths in bins] or [Files([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        names = [n for n, _, _ in self.columns]
        types = [pa.binary() if n in self.payload else pa.int64() if kind.simpleString() == "bigint" else pa.string() for n, _, kind in self.columns]
        schema = pa.schema(list(zip(names, types, strict=True)))
        rows: list[list] = [[] for _ in names]
        size = 0
        for path in partition.value:
            stream = io.BufferedReader(store.open_input_file(path), 1 << 20)
            if path.endswith(".gz"):
                stream = gzip.GzipFile(fileobj=stream)
            while (head := next_header(stream)) is not None:
                length = int(head["content-length"])
                payload = None
                if not self.passes(head):
                    stream.seek(length, io.SEEK_CUR)
                    continue
                if self.payload:
                    payload = payload_of(head, stream.read(length))
                    size += length
                else:
                    stream.seek(length, io.SEEK_CUR)
                for column, (name, header, kind) in zip(rows, self.columns, strict=True):
                    value = payload if name in self.payload else head.get(header)
                    column.append(int(value) if value is not None and kind.simpleString() == "bigint" else value)
                if len(rows[0]) >= 10_000 or size >= 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], schema=schema)
                    rows, size = [[] for _ in names], 0
        if rows and rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], schema=schema)

    def passes(self, head: dict[str, str]) -> bool:
        for header, kind, wanted in self.tests:
            value = head.get(header)
            if kind == "null":
                good = value is None
            elif kind == "some":
                good = value is not None
            else:
                good = value is not None and (value.startswith(wanted) if kind == "prefix" else (value in wanted) == (kind == "in"))
            if not good:
                return False
        return True


def next_header(stream: io.BufferedIOBase) -> dict[str, str] | None:
    """The fields, by lower-case name, of the record at the stream's place; it ends at the record's block. None: no more."""
    while (line := stream.readline()) in (b"\r\n", b"\n"):
        pass
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record starts with {line[:40]!r}")
    head: dict[str, str] = {}
    name = ""
    while (line := stream.readline().rstrip(b"\r\n")) != b"":
        if line[:1] in b" \t" and name:
            head[name] += " " + line.strip().decode()
        else:
            left, _, right = line.decode().partition(":")
            name = left.strip().lower()
            head[name] = right.strip()
    return head


def payload_of(head: dict[str, str], block: bytes) -> bytes:
    """The body of an HTTP message, else the block."""
    if head.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def read_archives(spark: SparkSession, folder: str, columns: str = SCHEMA) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").schema(columns).option("path", folder).load()


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to a new shared folder, read them back, one row for each row.

    page_id, payload_bytes, payload_digest (bare lower-case hex SHA-1), record_type (response or revisit)
    and refers_to (the response's page_id). Sizes and digests of responses come from the payloads read;
    those of revisits from the response that they refer to. A null html is empty, a null url leaves its
    field out; see with_revisits() for null and repeated ids. No pages: no rows.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    write_archives(pages, folder)
    kind = pages.schema["page_id"].dataType
    responses = read_archives(spark, folder, "record_type string, record_id string, page_id string, payload binary").where("record_type = 'response'")
    read = written(
        responses.select("record_id", F.col("page_id").cast(kind).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest")),
        "warc-responses",
    )
    revisits = read_archives(spark, folder, "record_type string, page_id string, refers_to string").where("record_type = 'revisit'")
    # rows that repeat a page and its payload have one record id
    named = read.groupBy("record_id").agg(*[F.first(c).alias(c) for c in ("page_id", "payload_bytes", "payload_digest")])
    back = revisits.withColumnRenamed("page_id", "own_id").join(named, F.col("refers_to") == F.col("record_id")).select(
        F.col("own_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("page_id").alias("refers_to")
    )
    return read.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast(kind).alias("refers_to")).union(back)
