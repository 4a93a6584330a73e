import io
import zipfile

import pytest
from pyspark.sql import functions as F

from routeloom.functions.text import name_key
from routeloom.operators.observations import object_or_list
from routeloom.shipping import ship
from routeloom.sources import files

HEAD = ",".join(files.STOP_COLUMNS)
LINE = "P9001,물레방아 삼거리,35.8125,128.6250,2025-01-17,77,990,가람,가람군"


def test_csv_profile(spark, tmp_path):
    (tmp_path / "stops.csv").write_text(f"﻿{HEAD}\n{LINE}\n", encoding="utf-8")
    df = files.csv(spark, f"{tmp_path}/stops.csv", files.STOP_COLUMNS)
    assert df.first().node_id == "P9001" and df.first().city_name == "가람"
    with pytest.raises(files.FormatError):
        files.csv(spark, f"{tmp_path}/stops.csv", {**files.STOP_COLUMNS, "없음": "x"})


def test_code_page_949(spark, tmp_path):
    ship(spark)
    (tmp_path / "a.csv").write_bytes(f"{HEAD}\r\n{LINE}\r\n".encode("cp949"))
    (tmp_path / "b.csv").write_text(f"{HEAD}\n{LINE}\n", encoding="utf-8-sig")
    rows = files.decoded_lines(spark, f"{tmp_path}/*.csv").where("line_no = 1").collect()
    assert {r.line for r in rows} == {LINE}
    assert {r.line for r in files.decoded_lines(spark, f"{tmp_path}/*.csv").where("line_no = 0").collect()} == {HEAD}


FEED = {
    "stops.txt": "stop_id,stop_name,stop_lat,stop_lon\nM1,mill,35.2,128.4\nM2,ford,35.3,128.5\nM3,inn,,\n",
    "routes.txt": "route_id,route_short_name,route_long_name,route_type\nB7,7,,3\nF2,2,,2\nC9,9,,715\n",
    "calendar.txt": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nwk,1,1,1,1,1,0,0,20250106,20250328\n",
    "trips.txt": "route_id,service_id,trip_id,direction_id,trip_headsign\nB7,wk,B7-1,0,east\n",
    "stop_times.txt": "trip_id,arrival_time,departure_time,stop_id,stop_sequence,pickup_type,drop_off_type\nB7-1,23:41:00,23:41:00,M1,1,,\nB7-1,24:13:30,24:13:30,M2,2,1,0\n",
}


def archive(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for n, t in members.items():
            z.writestr(n, t)


def test_feed(spark, tmp_path):
    archive(tmp_path / "feed.zip", FEED)
    files.unpack_feed(spark, f"{tmp_path}/feed.zip", f"{tmp_path}/feed")
    times = files.feed_times(files.feed_table(spark, f"{tmp_path}/feed", "stop_times")).orderBy("stop_sequence").collect()
    assert [(r.departure_seconds, r.can_board, r.can_alight) for r in times] == [(85260, True, True), (87210, False, True)]
    assert {r.route_id for r in files.bus_routes(files.feed_table(spark, f"{tmp_path}/feed", "routes")).collect()} == {"B7", "C9"}
    archive(tmp_path / "short.zip", {k: v for k, v in FEED.items() if k != "trips.txt"})
    archive(tmp_path / "unsafe.zip", {**FEED, "../x.txt": "a"})
    for bad in ("short", "unsafe"):
        with pytest.raises(files.FormatError):
            files.unpack_feed(spark, f"{tmp_path}/{bad}.zip", f"{tmp_path}/{bad}")


def workbook(rows):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    strings = sorted({c for r in rows for c in r if isinstance(c, str)})
    cell = lambda c, i, n: f'<c r="{chr(65 + i)}{n}" t="s"><v>{strings.index(c)}</v></c>' if isinstance(c, str) else f'<c r="{chr(65 + i)}{n}"><v>{c}</v></c>'
    body = "".join(f'<row r="{n}">' + "".join(cell(c, i, n) for i, c in enumerate(r) if c is not None) + "</row>" for n, r in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", "<workbook/>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_workbook(spark, tmp_path):
    ship(spark)
    (tmp_path / "a.xlsx").write_bytes(workbook([["ROUTE_ID", "순번"], ["R1", 3], ["R2", None]]))
    rows = files.workbook(spark, f"{tmp_path}/a.xlsx", ["ROUTE_ID", "순번"]).collect()
    assert [(r.row, r.ROUTE_ID, r["순번"]) for r in rows] == [(2, "R1", "3"), (3, "R2", None)]
    assert files.kinds(spark, f"{tmp_path}/a.xlsx").first().kind == "xlsx"
    assert files.column_index("AA10") == 26


def test_api_pages(spark, tmp_path):
    page = '{"response":{"header":{"resultCode":"00"},"body":{"items":{"item":%s},"pageNo":1,"totalCount":2}}}'
    (tmp_path / "1.json").write_text(page % '[{"STTN_ID":"a","STTN_SEQ":1},{"STTN_ID":"b","STTN_SEQ":2}]')
    (tmp_path / "2.json").write_text(page % '{"STTN_ID":"c","STTN_SEQ":3}')
    (tmp_path / "3.json").write_text(page % '""')
    rows = files.api_pages(spark, f"{tmp_path}/*.json", "struct<STTN_ID:string,STTN_SEQ:int>").orderBy("path", "n").collect()
    assert [(r.STTN_ID, r.n) for r in rows] == [("a", 0), ("b", 1), ("c", 0), (None, None)]


def test_object_or_list(spark):
    df = spark.createDataFrame([('[{"k":1},{"k":2}]',), ('{"k":3}',), ("",), (None,)], "j string")
    assert [[x.k for x in r[0]] for r in df.select(object_or_list(F.col("j"), "struct<k:int>")).collect()] == [[1, 2], [3], [], []]


def test_html(spark):
    ship(spark)
    df = spark.createDataFrame([('<a href="/x">one</a><p><a href="/y">two</a>',), ("none",), ('<a class="c" href="/z">a <b>b</b> &amp; c</a>',)], "h string")
    assert [[(a.href, a.title) for a in r[0]] for r in df.select(files.links(F.col("h"))).collect()][:2] == [[("/x", "one"), ("/y", "two")], []]
    assert [(a.href, a.title) for a in df.select(files.attachments("h")).collect()[2][0]] == [("/z", "a b & c")]


def test_name_key(spark):
    ship(spark)
    df = spark.createDataFrame([("Ｃity  Hall",), ("city hall",), (None,)], "n string")
    assert [r[0] for r in df.select(name_key("n")).collect()] == ["cityhall", "cityhall", None]


def test_region_codes(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("code\tname\tstate\n1111000000\t종로구\t존재\n1100000000\t서울\t존재\n1111010100\t청운동\t존재\n2611000000\t중구\t폐지\n")
    assert [r.region for r in files.region_codes(spark, f"{tmp_path}/r.tsv").collect()] == ["11110"]
