"""Canonical line tables derived from the shared test tables.

The test tables (``events``, ``lineitem``, ``part``) stand in for a line's batches, downtime
incidents and products; the mapping is deterministic and is written twice: once as Spark
DataFrame code (``build``), once as independent SQL for the oracle engine (``ORACLE_CTES``).

Canonical schema
    batches   batch_id, prod_date, product_id, operator_name, start_min, end_min, duration_min,
              shift, status
    products  product_id, flavor, size, size_l, min_batch_time
    incidents downtime_id, batch_id, factor_id, downtime_min
    factors   factor_id, description, operator_error (the factors of the suppliers table)

``load`` gives tables that are built on first use, each by itself, and written to the shared folder as Parquet.  Two derived
tables remove the fact-to-fact join from every report: per-batch downtime totals on the batches (which also carry
their product's attributes, joined once), and the incident detail (each incident with its batch's attributes).  Only
the incidents' dense ids need a sort of the incidents, and only reports that read incidents or their detail wait for it.  The facts are
deliberately not bucketed on ``batch_id``: a batch holding a third of all incidents would make one bucket (and
one task) hold a third of the data.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linepulse.functions.expr import minute_of_day, shift_of, status_of
from linepulse.functions.scale import apply_offsets, partition_offsets, range_tag
from linepulse.session import shared_dir

# The line's downtime factor list (id, description, operator error flag).
FACTORS = [
    (1, "Emergency stop", "No"),
    (2, "Batch change", "Yes"),
    (3, "Labeling error", "No"),
    (4, "Inventory shortage", "No"),
    (5, "Product spill", "Yes"),
    (6, "Machine adjustment", "Yes"),
    (7, "Machine failure", "No"),
    (8, "Batch coding error", "Yes"),
    (9, "Conveyor belt jam", "No"),
    (10, "Calibration error", "Yes"),
    (11, "Label switch", "Yes"),
    (12, "Other", "No"),
]

# Test-table mapping parameters.
PRODUCT_MODULUS = 200        # batches.product_id = event_id % 200
OPERATOR_MODULUS = 8         # operator = op_<user_id % 8>
LARGE_SIZE_FROM = 36         # p_size > 35 -> 2 L bottles
INCIDENT_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                  "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
# Every column of an incident is made of these first ones: line items alike in them are the same incident, whatever their order, so
# the columns behind them change nothing but which of two equal rows gets which id, and stay out of the sort.
INCIDENT_KEY = INCIDENT_ORDER[:5]


BATCH_COLS = ["batch_id", "prod_date", "product_id", "operator_name", "start_min", "end_min", "duration_min",
              "shift", "status"]
LINE = "line_id"      # optional: the line that made a batch, where one plant has several


def line_of(b: DataFrame) -> list[str]:
    """The line key of batches that carry one: it then leads every sequence and is part of its report."""
    return [LINE] if LINE in b.columns else []


INCIDENT_COLS = ["downtime_id", "factor_id", "downtime_min"]
ROW_COLS = ["incident", "factor_id", "downtime_min"]     # of an incident without its id: ``incident`` is true
PRODUCT_ATTRS = ["flavor", "size", "size_l", "min_batch_time"]
FACTOR_ATTRS = ["description", "operator_error"]


@dataclass
class Tables:
    b: DataFrame   # batches
    p: DataFrame   # products
    i: DataFrame   # incidents
    f: DataFrame   # factors
    sf_dir: str = ""
    bt: DataFrame | None = None   # wide batches: + downtime totals and product attributes
    d: DataFrame | None = None    # incident detail: every incident with batch/product/factor attributes

    @property
    def spark(self) -> SparkSession:
        return self.b.sparkSession

    def state(self, *sources: str) -> str:
        """Frames of the caller: a state of their own for each value."""
        return f"frames-{id(self)}"

    def kept(self, name: str, sources: list[str], make) -> DataFrame:
        """A derived table; frames of the caller keep nothing."""
        return make()

    @property
    def ir(self) -> DataFrame:
        """Incidents for counts and sums."""
        return self.i

    @property
    def dr(self) -> DataFrame | None:
        """Incident detail for counts and sums."""
        return None if self.d is None else self.d.withColumn("incident", F.when(F.col("downtime_id").isNotNull(), True)).drop("downtime_id")


def factors_from_supplier(supplier: DataFrame) -> DataFrame:
    """The factors that the suppliers stand for, labelled by the line's list (an id beyond it is 'Factor <id>')."""
    ids = supplier.select((F.col("s_suppkey") % 12 + 1).cast("int").alias("factor_id")).distinct()
    return label_factors(ids)


def label_factors(ids: DataFrame) -> DataFrame:
    def of(k: int):
        out = F.when(F.col("factor_id") == FACTORS[0][0], FACTORS[0][k])
        for row in FACTORS[1:]:
            out = out.when(F.col("factor_id") == row[0], row[k])
        return out
    return ids.select("factor_id", of(1).otherwise(F.concat(F.lit("Factor "), F.col("factor_id").cast("string"))).alias("description"),
                      of(2).otherwise(F.lit("No")).alias("operator_error"))


def products_from_part(part: DataFrame) -> DataFrame:
    big = F.col("p_size") >= LARGE_SIZE_FROM
    return part.select(
        F.col("p_partkey").alias("product_id"),
        F.when(F.col("p_type") == "ECONOMY", "Cola").when(F.col("p_type") == "LARGE", "Diet Cola")
         .otherwise(F.col("p_type")).alias("flavor"),
        F.when(big, "2 L").otherwise("600 ml").alias("size"),
        F.when(big, F.lit(2.0)).otherwise(F.lit(0.6)).alias("size_l"),
        (F.lit(20) + F.col("p_size")).cast("int").alias("min_batch_time"),
    )


def batches_with_product(events: DataFrame, products: DataFrame) -> DataFrame:
    """Batches with their product's attributes (NULL where the product is unknown); the one join with products."""
    raw = events.select(
        F.col("event_id").alias("batch_id"),
        F.col("ts").cast("date").alias("prod_date"),
        (F.col("event_id") % PRODUCT_MODULUS).alias("product_id"),
        F.concat(F.lit("op_"), (F.col("user_id") % OPERATOR_MODULUS).cast("string")).alias("operator_name"),
        minute_of_day("ts").cast("int").alias("start_min"),
        F.floor("value").cast("int").alias("duration_min"),
    )
    prod = products.select("product_id", *PRODUCT_ATTRS).withColumn("has_product", F.lit(True))
    return (raw.join(prod, "product_id", "left")
               .select("batch_id", "prod_date", "product_id", "operator_name", "start_min",
                       ((F.col("start_min") + F.col("duration_min")) % 1440).cast("int").alias("end_min"),
                       "duration_min",
                       shift_of("start_min").alias("shift"),
                       status_of("duration_min", "min_batch_time").alias("status"),
                       *PRODUCT_ATTRS, F.coalesce(F.col("has_product"), F.lit(False)).alias("has_product")))


def batches_from_events(events: DataFrame, products: DataFrame) -> DataFrame:
    return batches_with_product(events, products).select(*BATCH_COLS)


def _incident_columns() -> list:
    return [F.col("l_orderkey").alias("batch_id"),
            (F.col("l_suppkey") % 12 + 1).cast("int").alias("factor_id"),
            F.floor(F.col("l_quantity") * (F.lit(1) + F.col("l_suppkey") % 4) / 2).cast("int").alias("downtime_min")]


def incidents_tagged(lineitem: DataFrame) -> DataFrame:
    """Incident columns range-sorted in the line-item order and tagged for numbering (lazy)."""
    tagged = range_tag(lineitem.select(*INCIDENT_KEY), INCIDENT_KEY)
    return tagged.select("_lp_pid", "_lp_pos", *_incident_columns())


def incidents_numbered(tagged: DataFrame, offsets: DataFrame) -> DataFrame:
    return apply_offsets(tagged, offsets, "downtime_id").select(
        F.col("downtime_id").cast("long"), "batch_id", "factor_id", "downtime_min")


def with_totals(bp: DataFrame, i: DataFrame, f: DataFrame) -> DataFrame:
    """Batches with their downtime totals (NULL / 0 when none) and the part of operator errors in them.

    Incidents are aggregated per batch first (partial aggregation: a batch holding a third of all
    incidents is combined map-side), so the join is one row per batch on both sides."""
    human = F.col("operator_error") == "Yes"
    per = (i.join(f.select("factor_id", "operator_error"), "factor_id", "left").groupBy("batch_id").agg(
        F.sum("downtime_min").alias("total_downtime"), F.count(F.lit(1)).alias("incident_count"),
        F.count(F.when(human, 1)).alias("human_error_count")))
    return (bp.join(per, "batch_id", "left")
              .select(*BATCH_COLS, *line_of(bp), "total_downtime",
                      *[F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x) for x in ("incident_count", "human_error_count")],
                      *PRODUCT_ATTRS, "has_product"))


def wide_batches(b: DataFrame, i: DataFrame, p: DataFrame, f: DataFrame) -> DataFrame:
    """``with_totals`` for batches that carry no product attributes yet."""
    prod = p.select("product_id", *PRODUCT_ATTRS).withColumn("has_product", F.lit(True))
    bp = b.join(prod, "product_id", "left").select(
        *BATCH_COLS, *line_of(b), *PRODUCT_ATTRS, F.coalesce(F.col("has_product"), F.lit(False)).alias("has_product"))
    return with_totals(bp, i, f)


def incident_detail(i: DataFrame, bp: DataFrame, f: DataFrame, cols: list[str] = INCIDENT_COLS) -> DataFrame:
    """Every incident with its batch's attributes, its product's and its factor's (NULL where unknown).

    The one fact-to-fact join of the model, run once when the tables are built.  Incidents are the
    preserved (left) side, which AQE may split when one batch holds a large share of incidents.  Factors
    that are known to be few come with a broadcast hint: dealt by factor, whole rows would meet in a dozen tasks.
    """
    attrs = bp.select(*BATCH_COLS, *PRODUCT_ATTRS, "has_product").withColumn("matched", F.lit(True))
    fac = f.select("factor_id", *FACTOR_ATTRS).withColumn("has_factor", F.lit(True))
    return (i.select("batch_id", *cols).join(attrs, "batch_id", "left")
             .join(fac, "factor_id", "left")
             .select("batch_id", *cols, *[c for c in BATCH_COLS if c != "batch_id"], *PRODUCT_ATTRS,
                     *FACTOR_ATTRS,
                     *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("matched", "has_product", "has_factor")]))


class StoredTables:
    """Canonical tables of a data folder, each built and written to the shared folder on first use.

    A table is built again when the files that it comes from have changed (path, size, time).
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        tag = hashlib.sha1(sf_dir.encode()).hexdigest()[:10]
        self.root = f"{shared_dir(spark).rstrip('/')}/linepulse/{tag}"
        self._made: dict[str, tuple[str, DataFrame]] = {}

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def state(self, *sources: str) -> str:
        """A digest of the files that these test tables consist of now."""
        return hashlib.sha1("".join(listing(self.spark, self.path(x)) for x in sources).encode()).hexdigest()[:12]

    def _stored(self, name: str, sources: list[str], make) -> DataFrame:
        state = self.state(*sources)
        if self._made.get(name, ("", None))[0] != state:
            at = f"{self.root}/{name}-{state}"
            make().write.mode("overwrite").parquet(at)
            self._made[name] = (state, self.spark.read.parquet(at))
        return self._made[name][1]

    def kept(self, name: str, sources: list[str], make) -> DataFrame:
        """A derived table, written on first use and again when its files have changed."""
        return self._stored(name, sources, make)

    @property
    def ir(self) -> DataFrame:
        """Incidents without their ids, for counts and sums: nothing is sorted or written."""
        return self._read("lineitem").select(*_incident_columns())

    def location(self, name: str) -> str:
        """Folder of a table that has been built."""
        return f"{self.root}/{name}-{self._made[name][0]}"

    @property
    def built(self) -> list[str]:
        return sorted(self._made)

    @property
    def p(self) -> DataFrame:
        return self._stored("products", ["part"], lambda: products_from_part(self._read("part")))

    @property
    def f(self) -> DataFrame:
        return self._stored("factors", ["supplier"], lambda: factors_from_supplier(self._read("supplier")).coalesce(1))

    @property
    def _few_factors(self) -> DataFrame:
        """The factors for a join with incidents: ids are remainders by 12, so there are at most 24 rows, which go to all tasks."""
        return F.broadcast(self.f)

    @property
    def _bp(self) -> DataFrame:
        return self._stored("batches", ["events", "part"], lambda: batches_with_product(self._read("events"), self.p))

    @property
    def b(self) -> DataFrame:
        return self._bp.select(*BATCH_COLS)

    @property
    def bt(self) -> DataFrame:
        return self._stored("batches_wide", ["events", "part", "lineitem", "supplier"],
                            lambda: with_totals(self._bp, self._read("lineitem").select(*_incident_columns()), self._few_factors))

    @property
    def i(self) -> DataFrame:
        # written once, tagged by the range sort; the dense id is the tag plus the offset of its
        # partition (a table of one row per partition)
        tagged = self._stored("incidents_tagged", ["lineitem"], lambda: incidents_tagged(self._read("lineitem")))
        offsets = self._stored("incident_offsets", ["lineitem"], lambda: partition_offsets(tagged))
        return incidents_numbered(tagged, offsets)

    @property
    def d(self) -> DataFrame:
        return self._stored("incident_detail", ["events", "part", "lineitem", "supplier"],
                            lambda: incident_detail(self.i, self._bp, self._few_factors))

    @property
    def dr(self) -> DataFrame:
        """The incident detail without ids, for counts and sums: one join, and nothing is sorted for numbers that nobody reads."""
        return self._stored("incident_rows", ["events", "part", "lineitem", "supplier"],
                            lambda: incident_detail(self.ir, self._bp, self._few_factors, ROW_COLS[1:]).withColumn(ROW_COLS[0], F.lit(True)))

    def release(self) -> None:
        """Delete what was written for this data folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self._made.clear()


def listing(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files at a path, in any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return ";".join(sorted(f"{x.getPath()},{x.getLen()},{x.getModificationTime()}" for x in files))


_TABLES: dict[tuple, StoredTables] = {}


def load(spark: SparkSession, sf_dir: str) -> StoredTables:
    """The canonical tables of a data folder; nothing is built before it is used."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _TABLES:
        _TABLES[key] = StoredTables(spark, sf_dir.rstrip("/"))
    return _TABLES[key]


def incidents_location(t: StoredTables) -> str:
    """Folder of the written incident records (the incident detail keeps every incident)."""
    _ = t.d
    return t.location("incident_detail")


def batches_location(t: StoredTables) -> str:
    _ = t.bt
    return t.location("batches_wide")


def _factor_sql() -> str:
    def of(k: int, other: str) -> str:
        return "CASE factor_id " + " ".join(f"WHEN {row[0]} THEN '{row[k]}'" for row in FACTORS) + f" ELSE {other} END"
    return (f"SELECT factor_id, {of(1, chr(39) + 'Factor ' + chr(39) + ' || factor_id')} AS description, {of(2, chr(39) + 'No' + chr(39))} AS operator_error "
            "FROM (SELECT DISTINCT CAST(s_suppkey % 12 + 1 AS INTEGER) AS factor_id FROM supplier) s")


# The same mapping and the shared marts in plain SQL for the oracle engine.  Every oracle
# query is this WITH-list followed by its own SELECT.
ORACLE_CTES = f"""
products AS (
  SELECT p_partkey AS product_id,
         CASE p_type WHEN 'ECONOMY' THEN 'Cola' WHEN 'LARGE' THEN 'Diet Cola' ELSE p_type END AS flavor,
         CASE WHEN p_size > 35 THEN '2 L' ELSE '600 ml' END AS size,
         CASE WHEN p_size > 35 THEN 2.0E0 ELSE 0.6E0 END AS size_l,
         CAST(20 + p_size AS INTEGER) AS min_batch_time
  FROM part),
ev AS (
  SELECT event_id AS batch_id, CAST(ts AS DATE) AS prod_date, event_id % 200 AS product_id,
         CONCAT('op_', CAST(user_id % 8 AS VARCHAR)) AS operator_name,
         CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS start_min,
         CAST(FLOOR(value) AS INTEGER) AS duration_min
  FROM events),
batches AS (
  SELECT ev.batch_id, ev.prod_date, ev.product_id, ev.operator_name, ev.start_min,
         CAST((ev.start_min + ev.duration_min) % 1440 AS INTEGER) AS end_min, ev.duration_min,
         CASE WHEN ev.start_min BETWEEN 360 AND 839 THEN 'Morning'
              WHEN ev.start_min BETWEEN 840 AND 1319 THEN 'Afternoon' ELSE 'Night' END AS shift,
         CASE WHEN ev.duration_min <= p.min_batch_time THEN 'ON TIME' ELSE 'DELAY' END AS status
  FROM ev LEFT JOIN products p ON ev.product_id = p.product_id),
incidents AS (
  SELECT CAST(ROW_NUMBER() OVER (ORDER BY {', '.join(INCIDENT_ORDER)}) AS BIGINT) AS downtime_id,
         l_orderkey AS batch_id,
         CAST(l_suppkey % 12 + 1 AS INTEGER) AS factor_id,
         CAST(FLOOR(l_quantity * (1 + l_suppkey % 4) / 2) AS INTEGER) AS downtime_min
  FROM lineitem),
factors AS ({_factor_sql()}),
bp AS (
  SELECT b.*, p.flavor, p.size, p.size_l, p.min_batch_time, b.duration_min - p.min_batch_time AS delay
  FROM batches b JOIN products p ON b.product_id = p.product_id),
bd AS (SELECT batch_id, CAST(SUM(downtime_min) AS BIGINT) AS total_downtime FROM incidents GROUP BY batch_id),
idf AS (SELECT i.*, f.description, f.operator_error FROM incidents i JOIN factors f ON i.factor_id = f.factor_id),
idfl AS (SELECT i.*, f.description, f.operator_error FROM incidents i LEFT JOIN factors f ON i.factor_id = f.factor_id),
bi AS (
  SELECT b.*, i.downtime_id, i.factor_id, i.downtime_min
  FROM batches b JOIN incidents i ON b.batch_id = i.batch_id),
bif AS (
  SELECT b.*, i.downtime_id, i.factor_id, i.downtime_min, i.description, i.operator_error
  FROM batches b JOIN idf i ON b.batch_id = i.batch_id),
j01 AS (
  SELECT b.*, p.flavor, p.size, p.size_l, p.min_batch_time,
         CASE WHEN b.duration_min > p.min_batch_time THEN 'Delay' ELSE 'On_time' END AS batch_status
  FROM batches b LEFT JOIN products p ON b.product_id = p.product_id),
cp AS (
  SELECT b.batch_id, b.prod_date, b.product_id, b.operator_name, b.start_min, b.end_min, b.duration_min,
         b.shift, b.status, p.flavor, p.size, p.size_l, p.min_batch_time,
         i.downtime_id, i.factor_id, i.downtime_min, f.description, f.operator_error,
         CASE WHEN b.duration_min > p.min_batch_time THEN 'Delay' ELSE 'On_time' END AS batch_status
  FROM batches b LEFT JOIN products p ON b.product_id = p.product_id
  LEFT JOIN incidents i ON b.batch_id = i.batch_id
  LEFT JOIN factors f ON i.factor_id = f.factor_id)
"""


def with_oracle_ctes(sql: str) -> str:
    """Prefix a query with the canonical WITH-list (merging a leading WITH of its own)."""
    from linepulse.sources.dirty import DIRTY_CTES
    ctes = ORACLE_CTES.strip() + ",\n" + DIRTY_CTES.strip()
    body = sql.strip().rstrip(";")
    if body[:5].upper() == "WITH ":
        return "WITH " + ctes + ",\n" + body[5:]
    return "WITH " + ctes + "\n" + body
