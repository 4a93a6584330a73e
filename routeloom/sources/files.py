"""Readers of the public feeds' files; explicit schemas, nothing inferred.

Text files go through Spark's readers. Zip archives and workbooks are not splittable: each is one
binary row of bounded size, read in a Python function on an executor, one file at a time.
"""

from __future__ import annotations

import html.parser
import io
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the static stop and route lists and what they are called here.
STOP_COLUMNS = {"정류장번호": "node_id", "정류장명": "node_name", "위도": "latitude", "경도": "longitude", "정보수집일": "collected_date", "모바일단축번호": "mobile_short_no", "도시코드": "city_code", "도시명": "city_name", "관리도시명": "managing_city_name"}
ROUTE_COLUMNS = {"노선 아이디": "route_id", "노선명": "route_no", "기점노드 아이디": "start_node_id", "종점노드 아이디": "end_node_id", "기점정류장": "start_stop_name", "종점정류장": "end_stop_name", "지자체코드": "city_code", "지자체명": "municipality_name"}

#: Files of a schedule feed with their columns.
FEED = {
    "stops": "stop_id string, stop_name string, stop_lat double, stop_lon double",
    "routes": "route_id string, route_short_name string, route_long_name string, route_type int",
    "calendar": "service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int, start_date string, end_date string",
    "calendar_dates": "service_id string, date string, exception_type int",
    "trips": "route_id string, service_id string, trip_id string, direction_id int, trip_headsign string",
    "stop_times": "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence int, pickup_type int, drop_off_type int",
}
REQUIRED = ("stops", "routes", "calendar", "trips", "stop_times")


class FormatError(ValueError):
    """A file is not what its profile says."""


def decoded_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of small text files in UTF-8 (with or without mark), else in code page 949."""
    files = spark.read.format("binaryFile").load(path).select("path", _decoded("content").alias("text"))
    return files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line")).where("trim(line) <> ''")


@F.pandas_udf(T.StringType())
def _decoded(contents: pd.Series) -> pd.Series:
    """Spark's own decode() has no code page 949."""

    def one(b):
        try:
            return bytes(b).decode("utf-8-sig")
        except UnicodeDecodeError:
            return bytes(b).decode("cp949")

    return contents.map(one)


def csv(spark: SparkSession, path: str, columns: dict[str, str], exact: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """A CSV with a header that holds (or is exactly) the given columns, renamed, all strings."""
    head = spark.read.option("encoding", encoding).option("header", True).csv(path)
    names = [c.lstrip("﻿") for c in head.columns]
    missing = [c for c in columns if c not in names]
    if missing or len(set(names)) < len(names) or exact and names != list(columns):
        raise FormatError(f"header {names}: missing {missing}" if missing else f"header {names} differs from the profile")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names] + [T.StructField("_bad", T.StringType())])
    df = spark.read.option("encoding", encoding).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema(schema).csv(path)
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in columns.items()], "_bad")


def feed_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of an unpacked schedule feed."""
    return spark.read.option("header", True).option("enforceSchema", False).schema(FEED[name]).csv(f"{folder}/{name}.txt")


def unpack_feed(spark: SparkSession, archive: str, folder: str, most_bytes: int = 4 << 30, most_ratio: int = 200) -> None:
    """Unpack a feed archive to a folder that all executors see, member by member, by Hadoop's streams."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    content = spark.read.format("binaryFile").load(archive).select("content").first()[0]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = {}
        for i in z.infolist():
            base = i.filename.rsplit("/", 1)[-1]
            if i.filename.startswith("/") or ".." in i.filename.split("/"):
                raise FormatError(f"unsafe member {i.filename}")
            if i.file_size > most_bytes or i.file_size > most_ratio * max(i.compress_size, 1) + (1 << 20):
                raise FormatError(f"member {i.filename} is too large")
            if base.endswith(".txt"):
                if base[:-4] in names:
                    raise FormatError(f"member {base} occurs twice")
                names[base[:-4]] = i
        if lost := [n for n in REQUIRED if n not in names]:
            raise FormatError(f"missing {lost}")
        for n, i in names.items():
            if n in FEED:
                p = jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}.txt")
                out = p.getFileSystem(conf).create(p, True)
                with z.open(i) as f:
                    while block := f.read(1 << 20):
                        out.write(block)
                out.close()


def feed_times(times: DataFrame) -> DataFrame:
    """Adds seconds; a missing flag is 0, boarding and alighting need flag 0."""
    from ..functions.clock import clock_seconds

    return times.withColumns({"arrival_seconds": clock_seconds(F.col("arrival_time")), "departure_seconds": clock_seconds(F.col("departure_time")), "can_board": F.coalesce("pickup_type", F.lit(0)) == 0, "can_alight": F.coalesce("drop_off_type", F.lit(0)) == 0})


def bus_routes(routes: DataFrame) -> DataFrame:
    return routes.where((F.col("route_type") == 3) | F.col("route_type").between(700, 799))


# --- workbooks -----------------------------------------------------------------------------------

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def column_index(label: str) -> int:
    n = 0
    for c in label:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def workbook_rows(content: bytes, width: int) -> list[list[str | None]]:
    """Rows of a workbook's first sheet as text; each must have ``width`` cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{_NS}t")))
        sheet = min(n for n in z.namelist() if n.startswith("xl/worksheets/") and n.endswith(".xml"))
        out = []
        for row in ET.fromstring(z.read(sheet)).iter(f"{_NS}row"):
            cells: list[str | None] = [None] * width
            for c in row.iter(f"{_NS}c"):
                i = column_index(c.get("r", "A"))
                if i >= width:
                    raise FormatError(f"row {row.get('r')} has more than {width} cells")
                v = c.find(f"{_NS}v")
                text = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if c.get("t") == "inlineStr" else None if v is None else v.text
                cells[i] = shared[int(text)] if c.get("t") == "s" and text is not None else text
            out.append(cells)
    return out


def workbook(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """path, row and the columns, as strings; the header row must name the columns."""

    def go(frames):
        for pdf in frames:
            for p, content in zip(pdf["path"], pdf["content"]):
                rows = workbook_rows(content, len(columns))
                if not rows or rows[0] != columns:
                    raise FormatError(f"{p}: header {rows[:1]}")
                body = pd.DataFrame(rows[1:], columns=columns, dtype=object)
                body.insert(0, "row", range(2, len(body) + 2))
                body.insert(0, "path", p)
                yield body

    schema = "path string, row long, " + ", ".join(f"`{c}` string" for c in columns)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(go, schema)


# --- JSON and HTML ---------------------------------------------------------------------------------


def api_pages(spark: SparkSession, path: str, item: str) -> DataFrame:
    """Items of saved API answers: path, result_code, page_no, total_count, n, item.*; one object stands for a list of one."""
    text = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    body = F.get_json_object("value", "$.response.body.items.item")
    items = F.coalesce(F.from_json(body, f"array<{item}>"), F.filter(F.array(F.from_json(body, item)), lambda x: x.isNotNull()), F.array())
    head = [F.get_json_object("value", p).alias(n) for n, p in (("result_code", "$.response.header.resultCode"), ("page_no", "$.response.body.pageNo"), ("total_count", "$.response.body.totalCount"))]
    return text.select("path", *head, F.posexplode_outer(items).alias("n", "x")).select("path", "result_code", F.col("page_no").cast("int"), F.col("total_count").cast("int"), "n", "x.*")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a registry document, by tier and id."""
    source = "struct<id:string,name:string,municipality:string,priority_tier:string,origin_status:string,ingestion_status:string,schedule_granularity:string,collection_policy:string,formats:array<string>,license:string>"
    doc = spark.read.option("multiLine", True).schema(f"schema_version int, sources array<{source}>").json(path)
    return doc.select("schema_version", F.explode("sources").alias("s")).select("schema_version", "s.*")


def links(html_col):
    """href and text of all plain links, by built-in functions."""
    found = F.regexp_extract_all(html_col, F.lit(r'<a href="([^"]*)">([^<]*)</a>'), F.lit(0))
    return F.transform(found, lambda a: F.struct(F.regexp_extract(a, r'<a href="([^"]*)">', 1).alias("href"), F.regexp_extract(a, r">([^<]*)</a>", 1).alias("title")))


class _Attachments(html.parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.open, self.found = None, []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.open = [dict(attrs).get("href") or "", ""]

    def handle_data(self, data):
        if self.open:
            self.open[1] += data

    def handle_endtag(self, tag):
        if tag == "a" and self.open:
            self.found.append((self.open[0], " ".join(self.open[1].split())))
            self.open = None


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("title", T.StringType())])))
def attachments(pages: pd.Series) -> pd.Series:
    """Links of HTML that regular expressions can't read: nested markup, entities."""

    def one(s):
        p = _Attachments()
        p.feed(s or "")
        return [{"href": h, "title": t} for h, t in p.found]

    return pages.map(one)


@F.udf(T.StringType())
def _sniff(content):
    if content is None:
        return None
    b = bytes(content[:4096])
    if b[:4] == b"PK\x03\x04":
        names = bytes(content)
        return "xlsx" if b"xl/workbook.xml" in names else "hwpx" if b"Contents/content.hpf" in names else "zip"
    head = b.split(b"\n")[0]
    return "csv" if b"," in head and b"\0" not in b else "unknown"


def kinds(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 and kind (csv, xlsx, hwpx, zip, unknown) of files; a few files, one call each."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), _sniff("content").alias("kind"))


def region_codes(spark: SparkSession, path: str) -> DataFrame:
    """Current second-level regions of a tab-separated list of ten-digit codes."""
    df = spark.read.option("sep", "\t").option("header", True).schema("code string, name string, state string").csv(path)
    return df.where(F.col("code").endswith("00000") & (F.substring("code", 3, 8) != "00000000") & (F.col("state") == "존재")).select(F.substring("code", 1, 5).alias("region"), "name")
