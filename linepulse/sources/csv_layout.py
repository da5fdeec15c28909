"""The line system's text (CSV) layout: writers, schema-first readers and the wide downtime matrix.

Layout of the four exports (header row, comma separated, UTF-8; a byte-order mark and CRLF line
ends are accepted by the reader):

    products   Product_id, Flavor, Size, Min batch time
    batches    Batch, Date (M/d/yyyy), Product_id, Operator_Name, Start Time (h:mm:ss AM),
               End Time, Production Duration (a duration printed as a clock time), Shift,
               Production_status (On Time / Delayed)
    incidents  Downtime_id, Batch, Fact_id, DownTime_MIn
    factors    Factor_ID, Description, Operator Error

Readers never infer types: every column is found by its header name and read as text, then converted in one
typed step (``parse_*``) whose failures become NULL and can be counted.
"""

from __future__ import annotations

import csv

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linepulse.functions.expr import c

# Export column names and status labels of the line system.
PRODUCT_HEADERS = ["Product_id", "Flavor", "Size", "Min batch time"]
BATCH_HEADERS = ["Batch", "Date", "Product_id", "Operator_Name", "Start Time", "End Time", "Production Duration",
                 "Shift", "Production_status"]
INCIDENT_HEADERS = ["Downtime_id", "Batch", "Fact_id", "DownTime_MIn"]
FACTOR_HEADERS = ["Factor_ID", "Description", "Operator Error"]
STATUS_TEXT = {"ON TIME": "On Time", "DELAY": "Delayed"}
DATE_FORMAT = "M/d/yyyy"
N_FACTORS = 12
MAX_FACTORS = 1000
FEW_FACTORS = 100        # columns that one aggregate sums side by side


def clock_text(minutes) -> Column:
    """Minutes of the day printed as 'h:mm:ss AM'."""
    m = c(minutes)
    h = F.floor(m / 60).cast("int") % 24
    return F.format_string("%d:%02d:00 %s", ((h + 11) % 12 + 1), (m % 60).cast("int"),
                           F.when(h < 12, F.lit("AM")).otherwise(F.lit("PM")))


def clock_minutes(text) -> Column:
    """'h:mm:ss AM' -> minutes after midnight (NULL when unparseable)."""
    ts = F.try_to_timestamp(F.concat(F.lit("1970-01-01 "), F.trim(c(text))), F.lit("yyyy-MM-dd h:mm:ss a"))
    return (F.hour(ts) * 60 + F.minute(ts)).cast("int")


def duration_text(minutes) -> Column:
    """A duration printed as a clock time, as the line does; from 24 hours on as 'h:mm:ss' without AM or PM."""
    m = c(minutes)
    return F.when(m < 24 * 60, clock_text(m)).otherwise(F.format_string("%d:%02d:00", F.floor(m / 60).cast("long"), (m % 60).cast("int")))


def duration_minutes(text) -> Column:
    """The minutes of ``duration_text`` (NULL when unparseable)."""
    t = F.trim(c(text))
    hours, minutes = (F.regexp_extract(t, r"^(\d+):(\d\d):\d\d$", k).try_cast("int") for k in (1, 2))
    return F.coalesce(clock_minutes(t), hours * 60 + minutes)


def parse_date(text, fmt: str = DATE_FORMAT) -> Column:
    return F.try_to_timestamp(F.trim(c(text)), F.lit(fmt)).cast("date")


# --- writers (canonical -> text layout) -----------------------------------------------------

def products_text(p: DataFrame) -> DataFrame:
    return p.select(F.col("product_id").cast("string"), "flavor", "size", F.col("min_batch_time").cast("string")) \
            .toDF(*PRODUCT_HEADERS)


def batches_text(b: DataFrame) -> DataFrame:
    status = F.create_map(*[F.lit(x) for kv in STATUS_TEXT.items() for x in kv])[F.col("status")]
    return b.select(F.col("batch_id").cast("string"), F.date_format("prod_date", DATE_FORMAT),
                    F.col("product_id").cast("string"), "operator_name", clock_text("start_min"),
                    clock_text("end_min"), duration_text("duration_min"), "shift", status).toDF(*BATCH_HEADERS)


def incidents_text(i: DataFrame) -> DataFrame:
    return i.select(*[F.col(x).cast("string") for x in ("downtime_id", "batch_id", "factor_id", "downtime_min")]) \
            .toDF(*INCIDENT_HEADERS)


def factors_text(f: DataFrame) -> DataFrame:
    return f.select(F.col("factor_id").cast("string"), "description", "operator_error").toDF(*FACTOR_HEADERS)


def wide_downtime(i: DataFrame, factors: DataFrame) -> DataFrame:
    """batch x factor matrix of downtime minutes (NULL where a batch had none).

    One column ``f_<id>`` for each factor of the sheet (1..12), of the factor table and of the incidents, so that no
    minute is left out.  The ids are the columns of a sheet: more than MAX_FACTORS raise an error.
    """
    found = factors.select("factor_id").unionByName(i.select("factor_id")).where("factor_id IS NOT NULL").distinct().limit(MAX_FACTORS + 1).collect()
    ids = sorted({*range(1, N_FACTORS + 1), *(r[0] for r in found)})
    if len(ids) > MAX_FACTORS:
        raise ValueError(f"more than {MAX_FACTORS} factors do not fit a wide sheet")
    if len(ids) <= FEW_FACTORS:     # one aggregate of one row a batch; a pivot also holds one of a row for every batch and factor in the same task
        return i.groupBy("batch_id").agg(*[F.sum(F.when(F.col("factor_id") == k, F.col("downtime_min"))).cast("long").alias(f"f_{k}") for k in ids])
    w = i.groupBy("batch_id").pivot("factor_id", ids).agg(F.sum("downtime_min"))
    return w.select("batch_id", *[F.col(str(k)).cast("long").alias(f"f_{k}") for k in ids])


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_lines(lines: DataFrame, header: list[str], path: str) -> str:
    """Records that are text already, one a line as they stand (column ``value``), below the header row in every file."""
    plain = {"header": True, "sep": "\u0001", "comment": "\u0002", "quote": "", "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    lines.select(F.col("value").alias(",".join(header))).write.mode("overwrite").options(**plain).csv(path)
    return path


# --- readers (text layout -> canonical) -----------------------------------------------------

def read_text(spark: SparkSession, path: str, headers: list[str] | None = None, banner: bool = False, multiline: bool = False) -> DataFrame:
    """The file's columns as text, found by the names in its header row (in any order); only records with a field for every column.

    A byte-order mark and blanks around names are ignored.  A column that is missing, or a name that stands
    twice, raises an error; with ``headers`` only these columns come out.  ``banner``: a title row stands above the header of each file.
    ``multiline``: quoted fields may hold line breaks (each file is then read by one task).  Records with too many or too few
    fields are in ``rejected``.
    """
    names, raw = _records(spark, path, banner, multiline)
    # the second test is never true: it keeps a data column among those read, which the reader asks for
    good = raw.where(F.when(F.col("_bad").isNull(), F.lit(True)).otherwise(F.length("_c0") < 0))
    return _by_name(good, names, headers, path)


def rejected(spark: SparkSession, path: str, banner: bool = False, multiline: bool = False) -> DataFrame:
    """file, record, n_fields, reason of every record that ``read_text`` leaves out."""
    names, raw = _records(spark, path, banner, multiline)
    fields = F.size(F.split(F.regexp_replace("_bad", '"([^"]|"")*"', ""), ","))
    reason = F.when(F.col("n_fields") > len(names), "too many fields").when(F.col("n_fields") < len(names), "too few fields").otherwise("malformed")
    bad = raw.where(F.col("_bad").isNotNull() & (F.length(F.coalesce("_c0", F.lit(""))) >= 0))
    return bad.select(F.col("_file").alias("file"), F.col("_bad").alias("record"), fields.alias("n_fields")).withColumn("reason", reason)


def _records(spark: SparkSession, path: str, banner: bool, multiline: bool) -> tuple[list[str], DataFrame]:
    """The names of the header row, and the records as columns _c0, _c1, ..., _bad (the text of a record with another number of fields), _file."""
    reader = spark.read.option("inferSchema", False).option("encoding", "UTF-8").option("mode", "PERMISSIVE").option("multiLine", multiline)
    if banner:
        top = [r[0].lstrip("\ufeff").rstrip("\r") for r in spark.read.option("encoding", "UTF-8").text(path).limit(2).collect()]
        if len(top) < 2:
            raise ValueError(f"{path}: no header below the title row")
        names = next(csv.reader([top[1]]))
    else:
        names = reader.option("header", True).csv(path).columns
    names = [x.lstrip("\ufeff").strip() for x in names]
    columns = ", ".join(f"_c{k} STRING" for k in range(len(names)))
    raw = (reader.option("header", not banner).option("columnNameOfCorruptRecord", "_bad").option("columnPruning", False)
           .schema(f"{columns}, _bad STRING").csv(path))
    if not banner:
        return names, raw.select("*", F.col("_metadata.file_path").alias("_file"))
    return names, _below_top(raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")), 2)


def _by_name(raw: DataFrame, names: list[str], headers: list[str] | None, path: str) -> DataFrame:
    wanted = names if headers is None else headers
    for h in wanted:
        if names.count(h) != 1:
            raise ValueError(f"{path}: column {h!r} stands {names.count(h)} times in the header {names}")
    return raw.select(*[F.col(f"_c{names.index(h)}").alias(h) for h in wanted])


def _below_top(raw: DataFrame, top: int) -> DataFrame:
    """``raw`` without the first records of each file, by position: rows of a file's first block come in the file's order."""
    def run(batches):
        last, seen = None, 0
        for batch in batches:
            of = batch.column(batch.num_columns - 2).dictionary_encode()
            files, code, start = of.dictionary.to_pylist(), of.indices.to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            keep = np.ones(batch.num_rows, dtype=bool)
            edges = [*np.flatnonzero(np.diff(code, prepend=-1) | np.diff(start, prepend=-1)), batch.num_rows] if batch.num_rows else []
            for b, e in zip(edges[:-1], edges[1:]):
                here = (files[code[b]], int(start[b]))
                if here != last:
                    last, seen = here, 0
                if here[1] == 0:
                    keep[b:min(e, b + max(top - seen, 0))] = False
                seen += int(e - b)
            yield batch.filter(pa.array(keep)).select(batch.schema.names[:-1])

    return raw.mapInArrow(run, raw.drop("_start").schema)


def parse_products(raw: DataFrame) -> DataFrame:
    return raw.select(F.trim("Product_id").alias("product_id"), F.col("Flavor").alias("flavor"),
                      F.col("Size").alias("size"), F.col("Min batch time").try_cast("int").alias("min_batch_time"))


def parse_batches(raw: DataFrame) -> DataFrame:
    status = (F.when(F.upper(F.trim("Production_status")).isin("ON TIME"), F.lit("ON TIME"))
              .when(F.upper(F.trim("Production_status")).isin("DELAYED", "DELAY"), F.lit("DELAY")))
    return raw.select(F.col("Batch").try_cast("long").alias("batch_id"), parse_date("Date").alias("prod_date"),
                      F.trim("Product_id").alias("product_id"), F.col("Operator_Name").alias("operator_name"),
                      clock_minutes("Start Time").alias("start_min"), clock_minutes("End Time").alias("end_min"),
                      duration_minutes("Production Duration").alias("duration_min"), F.col("Shift").alias("shift"),
                      status.alias("status"))


def parse_incidents(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("Downtime_id").try_cast("long").alias("downtime_id"),
                      F.col("Batch").try_cast("long").alias("batch_id"),
                      F.col("Fact_id").try_cast("int").alias("factor_id"),
                      F.col("DownTime_MIn").try_cast("int").alias("downtime_min"))


def parse_factors(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("Factor_ID").try_cast("int").alias("factor_id"), F.col("Description").alias("description"),
                      F.col("Operator Error").alias("operator_error"))


def read_products(spark, path, banner: bool = False) -> DataFrame:
    return parse_products(read_text(spark, path, PRODUCT_HEADERS, banner))


def read_batches(spark, path, banner: bool = False) -> DataFrame:
    return parse_batches(read_text(spark, path, BATCH_HEADERS, banner))


def read_incidents(spark, path, banner: bool = False) -> DataFrame:
    return parse_incidents(read_text(spark, path, INCIDENT_HEADERS, banner))


def read_factors(spark, path, banner: bool = False) -> DataFrame:
    return parse_factors(read_text(spark, path, FACTOR_HEADERS, banner))


def read_wide_downtime(spark, path, banner: bool = False) -> DataFrame:
    """batch_id and every factor column that the header names."""
    raw = read_text(spark, path, banner=banner)
    if "batch_id" not in raw.columns:
        raise ValueError(f"{path}: no column 'batch_id' in the header {raw.columns}")
    return raw.select(*[F.col(x).try_cast("long").alias(x) for x in raw.columns if x == "batch_id" or x.startswith("f_")])


def unpivot_downtime(wide: DataFrame) -> DataFrame:
    """Wide matrix -> long incidents (batch_id, factor_id, downtime_min), empty cells dropped."""
    cols = [x for x in wide.columns if x.startswith("f_")]
    long = wide.unpivot(["batch_id"], cols, "factor_col", "downtime_min").filter(F.col("downtime_min").isNotNull())
    return long.select("batch_id", F.substring("factor_col", 3, 20).cast("int").alias("factor_id"),
                       F.col("downtime_min").cast("int").alias("downtime_min"))
