"""CSV truth: records with too many or too few fields are rejected and counted, title rows go by position, names and fields may be quoted."""

import pytest

from linepulse.sources import csv_layout as L

HEAD = "Product_id,Flavor,Size,Min batch time\n"


def put(at, name, text):
    (at / name).write_text(text, encoding="utf-8")
    return str(at / name)


def test_extra_and_missing_fields_are_rejected(spark, tmp_path):
    path = put(tmp_path, "p.csv", HEAD + 'A,Cola,600 ml,60\nB,Diet, Cola,2 L,60\nC\nD,"Lime, sour",2 L,70\n')
    assert [tuple(r) for r in L.read_products(spark, path).orderBy("product_id").collect()] == [("A", "Cola", "600 ml", 60), ("D", "Lime, sour", "2 L", 70)]
    assert L.read_products(spark, path).count() == 2
    bad = L.rejected(spark, path).orderBy("record").collect()
    assert [(r["record"], r["n_fields"], r["reason"]) for r in bad] == [("B,Diet, Cola,2 L,60", 5, "too many fields"), ("C", 1, "too few fields")]
    assert all(r["file"].endswith("p.csv") for r in bad) and L.rejected(spark, path).count() == 2


def test_title_and_header_go_by_position(spark, tmp_path):
    for name, row in (("a.csv", "5,7"), ("b.csv", "6,8")):
        put(tmp_path, name, f'5,7\nbatch_id,"f_1"\n{row}\n5,7\nbatch_id,f_1\n')
    raw = L.read_text(spark, str(tmp_path), banner=True)
    assert sorted(tuple(r) for r in raw.collect()) == [("5", "7"), ("5", "7"), ("5", "7"), ("6", "8"), ("batch_id", "f_1"), ("batch_id", "f_1")]
    wide = L.read_wide_downtime(spark, str(tmp_path), banner=True)
    assert wide.columns == ["batch_id", "f_1"] and wide.where("batch_id IS NOT NULL").count() == 4


def test_quoted_names_and_line_breaks_below_a_title(spark, tmp_path):
    path = put(tmp_path, "p.csv", '﻿Products of the line\n"Product_id","Flavor, English",Size\nA,"two\nlines",1\nB,x\n')
    got = L.read_text(spark, path, banner=True, multiline=True)
    assert got.columns == ["Product_id", "Flavor, English", "Size"]
    assert [tuple(r) for r in got.collect()] == [("A", "two\nlines", "1")]
    assert [r["reason"] for r in L.rejected(spark, path, banner=True, multiline=True).collect()] == ["too few fields"]
    with pytest.raises(ValueError, match="no header"):
        L.read_text(spark, put(tmp_path, "q.csv", "title\n"), banner=True)


def test_rows_of_many_blocks_stay(spark, tmp_path):
    text = "title\n" + HEAD + "".join(f"p{i},Cola,2 L,{i}\n" for i in range(5000))
    path = put(tmp_path, "big.csv", text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = L.read_products(spark, path, banner=True)
        assert got.rdd.getNumPartitions() > 3 and got.agg({"min_batch_time": "sum"}).first()[0] == sum(range(5000)) and got.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
