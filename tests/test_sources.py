"""Readers, manifests and sinks on small hand-made files."""

import gzip
import io
import json
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidyscan.sources import archives, demo, files, manifest, records, sinks, tables


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_csv_short_and_long_lines(spark, tmp_path):
    p = tmp_path / "semi.csv"
    p.write_bytes("﻿a;b\n1;2\n3\n4;5;6\n7;8\n".encode())
    df = files.read_any(spark, str(p))
    assert df.columns == ["a", "b"]
    assert rows(df) == [(1, 2), (3, None), (7, 8)]
    # the same rows whichever columns are read
    assert rows(df.select("a")) == [(1,), (3,), (7,)]
    assert df.count() == 3


def test_csv_types_and_missing_words(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text(
        'i,x,w,t,b,q\n1,1.5,1.0,2024-01-01,True,"a,b"\nNA,2e3,2.0,x,False,"say ""hi"""\n3,,,null,True,"two\nlines"\n'
    )
    df = files.read_csv(spark, str(p))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double", "bigint", "string", "boolean", "string"]
    got = {r["q"]: r for r in df.collect()}
    assert set(got) == {"a,b", 'say "hi"', "two\nlines"}
    assert got['say "hi"']["i"] is None and got["two\nlines"]["x"] is None and got["two\nlines"]["t"] is None


@pytest.mark.parametrize("name,sep", [("tabs.tsv", "\t"), ("pipe.txt", "|"), ("x.csv.gz", ",")])
def test_csv_delimiters_and_gzip(spark, tmp_path, name, sep):
    text = "\n".join(sep.join(r) for r in (["name", "n"], ["ann", "1"], ["bob", "2"])) + "\n"
    data = text.encode()
    (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith(".gz") else data)
    assert rows(files.read_any(spark, str(tmp_path / name))) == [("ann", 1), ("bob", 2)]


def test_csv_latin1(spark, tmp_path):
    p = tmp_path / "latin.txt"
    p.write_bytes("name,n\nJosé,1\nZoë,2\n".encode("latin1"))
    assert rows(files.read_any(spark, str(p))) == [("José", 1), ("Zoë", 2)]


def test_jsonl(spark, tmp_path):
    p = tmp_path / "lines.jsonl"
    p.write_text('{"a":1,"n":{"x":"u","l":[1,2]}}\n\n{bad\n{"a":2,"n":{"x":"v","l":[]}}\n')
    df = files.read_any(spark, str(p))
    assert sorted(df.columns) == ["a", "n__l", "n__x"]
    assert rows(df.select("a", "n__x")) == [(1, "u"), (2, "v")]
    p2 = tmp_path / "mixed.ndjson"
    p2.write_text('1\n{"a":2}\n"three"\n')
    assert files.read_any(spark, str(p2)).columns == ["value"]
    assert files.read_any(spark, str(p2)).count() == 3
    bad = tmp_path / "bad.jsonl"
    bad.write_text("nope\n{}\n")
    with pytest.raises(ValueError):
        files.read_jsonl(spark, str(bad))


def test_json_documents(spark, tmp_path):
    write = lambda name, value: (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value, indent=1))
    write("nested.json", {"meta": 1, "d": {"rows": [{"k": 1, "s": {"z": 2}}, {"k": 3, "s": {"z": 4}}], "few": [{"k": 9}]}})
    write("array.json", [{"a": 1, "b": {"c": 2}}, {"a": 3, "b": {"c": 4}}])
    write("scalars.json", "[1,\n2]")
    write("single.json", {"a": 1, "b": {"c": "x"}})
    read = lambda name: files.read_any(spark, str(tmp_path / name))
    assert rows(read("nested.json").select("k", "s__z")) == [(1, 2), (3, 4)]
    assert rows(read("array.json").select("a", "b__c")) == [(1, 2), (3, 4)]
    assert rows(read("scalars.json")) == [("1",), ("2",)]
    assert rows(read("single.json").select("a", "b__c")) == [(1, "x")]
    raw = spark.read.option("multiLine", True).json(str(tmp_path / "nested.json"))
    assert records.best_record_path(raw) == ("d", "rows")


def test_content_decides_without_extension(spark, tmp_path):
    (tmp_path / "blob").write_text('\n  [{"a": 1},\n {"a": 2}]')
    (tmp_path / "plain").write_text("a,b\n1,2\n")
    assert rows(files.read_any(spark, str(tmp_path / "blob"))) == [(1,), (2,)]
    assert rows(files.read_any(spark, str(tmp_path / "plain"))) == [(1, 2)]


def test_parquet_limit_and_preview(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(50).write.parquet(path)
    assert files.read_any(spark, path).count() == 50
    assert files.read_any(spark, path, 7).count() == 7
    assert files.read_preview(spark, path).count() == 50


def test_supported(spark):
    df = spark.createDataFrame([("a.CSV",), ("b.pdf",), ("c.ndjson",), ("d.parquet",), ("e.csv.bak",)], "p string")
    assert rows(df.filter(files.is_supported(F.col("p")))) == [("a.CSV",), ("c.ndjson",), ("d.parquet",)]


def test_archive(spark, tmp_path):
    p = tmp_path / "bundle.zip"
    table = io.BytesIO()
    pd.DataFrame({"k": [1, 2], "v": ["x", "y"]}).to_parquet(table)
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("one.csv", "a,b\n1,2\n3\n4,5,6\n")
        z.writestr("folder/", "")
        z.writestr("folder/two.json", '[{"a": 1, "n": {"m": 2}}]')
        z.writestr("three.csv.gz", gzip.compress(b"c\n5\n"))
        z.writestr("doc.pdf", b"%PDF")
        z.writestr("empty.csv", "")
        z.writestr("lines.jsonl", '{"a":1}\n{"a":2}\n')
        z.writestr("t.parquet", table.getvalue())
        z.writestr("other/one.csv", "z\n9\n")
    got = archives.archive_tables(spark, str(p))
    assert list(got) == ["one.csv", "two.json", "three.csv.gz", "lines.jsonl", "t.parquet", "one.csv_2"]
    assert rows(got["one.csv"]) == [(1, 2), (3, None)]
    assert rows(got["two.json"]) == [(1, 2)]
    assert rows(got["three.csv.gz"]) == [(5,)]
    assert rows(got["lines.jsonl"]) == [(1,), (2,)]
    assert rows(got["t.parquet"]) == [(1, "x"), (2, "y")]
    assert rows(files.read_any(spark, str(p))) == [(1, 2), (3, None)]


def test_manifest_and_names(spark, tmp_path):
    for name, data in (("a.csv", b"x\n1\n"), ("b.csv", b"x\n1\n"), ("c.csv", b"x\n2\n")):
        (tmp_path / name).write_bytes(data)
    first = manifest.ingest_manifest(spark, str(tmp_path / "*.csv"))
    assert sorted(r["base"] for r in first.collect()) == ["a.csv", "c.csv"]
    seen = first.filter("base = 'c.csv'")
    assert [r["base"] for r in manifest.ingest_manifest(spark, str(tmp_path / "*.csv"), seen).collect()] == ["a.csv"]


@pytest.mark.parametrize("block", [3, None])
def test_unique_names(spark, block):
    names = ["a", "a", "b", "a", "a_2", "a_4", "a", "b", "a_2", "c_7", "a_3x"]
    df = spark.createDataFrame(list(enumerate(names)), "i long, name string")
    got = {r["i"]: r["unique_name"] for r in manifest.unique_names(df, "name", ["i"], rows_per_block=block).collect()}
    assert got == {0: "a", 1: "a_3", 2: "b", 3: "a_5", 4: "a_2", 5: "a_4", 6: "a_6", 7: "b_2", 8: "a_2_2", 9: "c_7", 10: "a_3x"}


def test_tables(spark):
    assert tables.quote_ident('we"ird') == '"we""ird"'
    assert tables.table_query("cat", "sch", "t", 1000) == 'SELECT * FROM "cat"."sch"."t" LIMIT 1000'
    assert tables.table_query(None, None, "t") == 'SELECT * FROM "t"'
    spark.range(30).createOrReplaceTempView("some_numbers")
    assert tables.read_table(spark, None, None, "some_numbers", limit=10).count() == 10
    assert tables.read_table(spark, None, None, "some_numbers").count() == 30


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", cell', [1, 2]), (2, None, None)], "i long, s string, l array<int>")
    sinks.write_csv(df, str(tmp_path / "out"))
    back = files.read_csv(spark, str(tmp_path / "out"))
    assert rows(back) == [(1, 'a "quoted", cell', "[1,2]"), (2, None, None)]


def test_demo_data(spark):
    df = demo.demo_data(spark, 2000).cache()
    assert len(df.columns) == 22 and df.count() == 2020
    assert df.distinct().count() == 2000
    facts = df.agg(
        F.count_if(F.abs(F.col("amount") + F.col("tax_amount") - F.col("amount_plus_tax")) > 0.006).alias("off"),
        F.avg(F.col("discount_rate").isNull().cast("int")).alias("none"),
        F.min("quantity").alias("q0"), F.max("quantity").alias("q1"),
        F.count_distinct("device").alias("devices"), F.avg("promo_used").alias("promo"),
        F.max("discount_rate").alias("most"),
    ).first()
    assert facts["off"] == 0 and (facts["q0"], facts["q1"]) == (1, 5) and facts["devices"] == 3
    assert 0.6 < facts["none"] < 0.7 and 0.3 < facts["promo"] < 0.4 and facts["most"] <= 0.6
    assert rows(df) == rows(demo.demo_data(spark, 2000))
