"""File sources and sinks."""

import datetime as dt
import gzip
import hashlib
import json
import random

from pyspark.sql import functions as F

from keelson.operators import drift
from keelson.plans import intake, views
from keelson.sources import facts as sfacts
from keelson.sources import filings as sfil
from keelson.sources import manifest as sman
from keelson.sources import series as sser


def block(accns, forms, **extra):
    n = len(accns)
    return {"accessionNumber": accns, "filingDate": ["2024-02-01"] * n, "form": forms, "primaryDocument": ["d.htm"] * n, **extra}


def test_scan_submissions(spark, tmp_path):
    docs = {
        "CIK0000000001.json": {"cik": "1", "name": "Acme", "tickers": ["ACM", ""], "exchanges": [""], "sic": "", "filings": {"recent": block(
            ["a", "b", "c"], ["10-K", "4", "8-K"], items=["", "", "1.03,9.01"], reportDate=["2023-12-31", "", ""])}},
        "CIK0000000001-submissions-001.json": block(["a", "d"], ["10-K", "10-Q/A"]),
        "CIK0000000002.json": {"cik": "2", "name": "Fund", "filings": {"recent": block(["x"], ["8-K"])}},
        "notes.json": {"cik": "3"}}
    for name, doc in docs.items():
        (tmp_path / name).write_text(json.dumps(doc))
    companies, filings = sfil.scan_submissions(spark, str(tmp_path))
    c = companies.collect()
    assert [(r["cik"], r["tickers"], r["exchanges"], r["sic"]) for r in c] == [(1, ["ACM"], [], None)]
    got = {r["accn"]: r for r in filings.collect()}
    assert set(got) == {"a", "c", "d"} and got["c"]["items"] == "1.03,9.01" and got["d"]["items"] == "" and got["d"]["report_date"] is None


def test_read_facts_keeps_first_filing_and_drops_bad_rows(spark):
    row = lambda **k: {"end": "2023-12-31", "val": 5, "fy": 2023, "fp": "FY", "form": "10-K", "filed": "2024-02-01", "accn": "a", **k}
    doc = {"facts": {"us-gaap": {"Assets": {"units": {"USD": [row(), row(filed="2025-02-01"), row(val=6, filed="2025-02-01"), row(form="8-K"), row(end="0201-01-01")], "EUR": [row(val=9)]}},
                                 "Unmapped": {"units": {"USD": [row()]}}}}}
    df = sfacts.read_facts(spark.createDataFrame([(1, json.dumps(doc))], "cik bigint, value string"))
    assert sorted((r["item"], r["val"], r["filed"].isoformat()) for r in df.collect()) == [("TotalAssets", 5.0, "2024-02-01"), ("TotalAssets", 6.0, "2025-02-01")]


def test_weekly_prices_and_labelled_lines(spark, tmp_path):
    (tmp_path / "IBM_weekly.csv").write_text("Date, Open ,High,Low,Close,Adjusted_Close,Volume\n2024-01-05,1,2,1,2,1.5,10\n")
    (tmp_path / "IBM.csv").write_text("date,open,high,low,close,volume\n2024-01-05,1,2,1,2,10\n")
    w = sser.read_prices(spark, str(tmp_path), "weekly").collect()
    assert [(r["ticker"], r["close"], r["raw_close"]) for r in w] == [("IBM", 1.5, 2.0)]
    assert [r["ticker"] for r in sser.read_prices(spark, str(tmp_path)).collect()] == ["IBM"]
    lines = tmp_path / "phrases.txt"
    lines.write_bytes("Caf\xe9 sales rose @ 5%@positive\n".encode("latin-1"))
    got = sser.read_labelled_lines(spark, str(lines)).first()
    assert got["text"] == "Caf\xe9 sales rose @ 5%" and got["label"] == "positive"


def test_inference_log_append_and_window(spark, tmp_path):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, d), "m", {"a": 1.0}) for d in (1, 20, 30)], "logged_at timestamp, model string, features map<string,double>")
    path = str(tmp_path / "log")
    drift.append_log(rows.limit(1), path)
    drift.append_log(rows.where(F.dayofmonth("logged_at") > 1), path)
    assert drift.read_log(spark, path, "2024-01-31 00:00:00", 30).count() == 3
    assert drift.read_log(spark, path, "2024-01-31 00:00:00", 5).count() == 1


def test_manifest_hash_changes_with_content(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one")
    first = sman.manifest_hash(sman.manifest(spark, str(tmp_path))).first()[0]
    (tmp_path / "b.bin").write_bytes(b"two")
    assert sman.manifest_hash(sman.manifest(spark, str(tmp_path))).first()[0] != first


def test_manifest_reads_files_in_pieces(spark, tmp_path):
    """Whatever a file holds, its digest is that of its bytes; only files that the text reader would decompress are read whole."""
    mark = b"\xef\xbb\xbf"
    files = {"a.bin": b"x\n", "b.bin": b"\n\n", "c.bin": b"a\r\nb\r", "d.bin": mark + b"abc\n", "e.bin": mark, "f.bin": mark + mark + b"q", "g.bin": b"\x00\xff\n\x80", "h.bin": random.Random(1).randbytes(200_000),
             "i.gz": gzip.compress(b"hello\n" * 50), "j k%.bin": b"one"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    found = sman.manifest(spark, str(tmp_path))
    assert {r["file"]: (r["bytes"], r["sha256"]) for r in found.collect()} == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in files.items()}
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")          # a file above this is not read whole, as none above 2 GB
    try:
        assert sman.manifest(spark, str(tmp_path)).where("file = 'h.bin'").first()["sha256"] == hashlib.sha256(files["h.bin"]).hexdigest()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_documents_are_made_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    n = 2000
    spark.range(n).selectExpr("id AS l_orderkey", "id % 40 AS l_suppkey", "CAST(id % 90 + 10 AS DOUBLE) AS l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(n).selectExpr("id AS o_orderkey", "date_add(DATE'1996-01-01', CAST(id % 1000 AS INT)) AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    assert intake.DOCUMENT_LINES < views.LINES_PER_TASK
    rows = sorted(map(str, intake.facts_from_documents(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(intake, "DOCUMENT_LINES", n // 10)
    small = intake.facts_from_documents(spark, str(tmp_path))
    assert small.rdd.getNumPartitions() == 10
    assert rows and sorted(map(str, small.collect())) == rows
