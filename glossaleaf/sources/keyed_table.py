"""A keyed table whose changes write only what they touch.

Rows lie in buckets by a hash of their key. A state of the table is a list of one folder per bucket,
the manifest; manifests are numbered. A change reads the buckets of the changed keys, writes each
anew into a folder that did not exist, and then writes the next manifest, one small file whose
appearance is the change. Until then readers see the state before; folders written by a change that
never got so far belong to no state. There must be one writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossaleaf.session import fresh_path, materialize

MANIFEST = T.StructType(
    [T.StructField("bucket", T.IntegerType()), T.StructField("folder", T.StringType()), T.StructField("buckets", T.IntegerType()), T.StructField("key", T.StringType())]
)


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    numbered = T.StructType([*MANIFEST.fields, T.StructField("state", T.IntegerType())])
    return spark.read.schema(numbered).parquet(f"{path}/manifests")


def state(spark: SparkSession, path: str) -> int:
    """The number of the latest state."""
    return _manifests(spark, path).agg(F.max("state")).first()[0]


def manifest(spark: SparkSession, path: str, number: int | None = None) -> dict[int, str]:
    """The folder of each bucket that has rows; as many entries as buckets at most."""
    number = state(spark, path) if number is None else number
    rows = _manifests(spark, path).filter((F.col("state") == number) & (F.col("bucket") >= 0)).collect()
    return {r.bucket: r.folder for r in rows}


def _layout(spark: SparkSession, path: str) -> tuple[str, int]:
    row = _manifests(spark, path).filter("bucket = -1").first()
    return row.key, row.buckets


def _commit(spark: SparkSession, path: str, number: int, folders: dict[int, str], key: str, buckets: int) -> None:
    # the row of bucket -1 makes an empty table a state as well
    rows = [(-1, "", buckets, key), *[(b, f, buckets, key) for b, f in sorted(folders.items())]]
    # one file: it is there whole or not at all, and a number is never written twice
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifests/state={number}")


def _write(rows: DataFrame, path: str, key: str, buckets: int) -> dict[int, str]:
    """Writes each bucket into a new folder; a bucket is one file, or several if it is large."""
    spark = rows.sparkSession
    folder = fresh_path(spark, "part").rsplit("/", 1)[1]
    placed = rows.withColumn("_bucket", _bucket(F.col(key), buckets))
    placed.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/rows/{folder}")
    try:
        written = spark.read.parquet(f"{path}/rows/{folder}").select("_bucket").distinct().collect()
    except AnalysisException as problem:
        # a folder without a file has no schema: no row was left
        if problem.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        written = []
    return {r["_bucket"]: f"{folder}/_bucket={r['_bucket']}" for r in written}


def create(rows: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """A new table of rows with distinct keys; the folder must not hold one yet. Give so many buckets that
    one is a fit piece of work for a task."""
    spark = rows.sparkSession
    rows.limit(0).write.mode("errorifexists").parquet(f"{path}/schema")
    _commit(spark, path, 0, _write(rows, path, key, buckets), key, buckets)


def _schema(spark: SparkSession, path: str) -> T.StructType:
    return spark.read.parquet(f"{path}/schema").schema


def _rows(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    schema = _schema(spark, path)
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/rows/{f}" for f in folders])


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The latest state, or an earlier one."""
    return _rows(spark, path, list(manifest(spark, path, number).values()))


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The rows of the given keys; only their buckets are read."""
    key, buckets = _layout(spark, path)
    wanted = keys.select(key).distinct()
    # at most one number per bucket
    asked = {r.b for r in wanted.select(_bucket(F.col(key), buckets).alias("b")).distinct().collect()}
    rows = _rows(spark, path, [f for b, f in manifest(spark, path).items() if b in asked])
    return rows.join(wanted, key, "left_semi").select(*rows.columns)


def change(
    path: str,
    upserts: DataFrame | None = None,
    deletes: DataFrame | None = None,
    order: list[str] | None = None,
    insert: bool = False,
    number: int | None = None,
) -> int:
    """Applies changes and gives the number of the new state.

    ``upserts`` has the key, the ``order`` columns and those of the table's columns to set: the latest
    non-null value of each wins, by order. A key that the table lacks is added with ``insert``, its
    other columns null, else ignored. ``deletes`` names keys that go; one both changed and deleted goes.
    Null keys are ignored. ``number`` is the state the caller has seen: if another came since, nothing is changed.
    """
    given = upserts if upserts is not None else deletes
    if given is None:
        raise ValueError("nothing to change")
    spark = given.sparkSession
    now = state(spark, path)
    if number is not None and number != now:
        raise ValueError(f"the table is at state {now}, not {number}")
    key, buckets = _layout(spark, path)
    schema, order = _schema(spark, path), order or []
    columns = [c for c in schema.fieldNames() if upserts is not None and c in upserts.columns and c != key]
    rows = []
    if upserts is not None:
        at = F.struct(*order) if order else F.lit(0)
        latest = [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_new_{c}") for c in columns]
        rows.append(upserts.groupBy(F.col(key).alias("_key")).agg(*latest, F.lit(False).alias("_gone")))
    if deletes is not None:
        gone = deletes.select(F.col(key).alias("_key")).distinct().withColumn("_gone", F.lit(True))
        rows.append(gone if not rows else gone.select("_key", *[F.lit(None).cast(schema[c].dataType).alias(f"_new_{c}") for c in columns], "_gone"))
    changes = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    changes = changes.filter("_key IS NOT NULL")
    if len(rows) > 1:
        changes = changes.groupBy("_key").agg(*[F.max_by(f"_new_{c}", ~F.col("_gone")).alias(f"_new_{c}") for c in columns], F.max("_gone").alias("_gone"))
    changes = materialize(changes, "keyed-changes")

    folders = manifest(spark, path, now)
    touched = {r.b for r in changes.select(_bucket(F.col("_key"), buckets).alias("b")).distinct().collect()}
    before = _rows(spark, path, [f for b, f in folders.items() if b in touched])
    # the stored rows are read once; a changed key without one is new
    joined = before.withColumn("_old", F.lit(True)).join(changes, before[key] == changes["_key"], "full" if insert else "left")
    joined = joined.filter(~F.coalesce("_gone", F.lit(False)))
    after = joined.select(
        *[
            F.coalesce(F.col(key), F.col("_key")).alias(key) if f.name == key
            else F.coalesce(F.col(f"_new_{f.name}"), F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in columns
            else F.col(f.name)
            for f in schema.fields
        ]
    )
    written = _write(after, path, key, buckets) if touched else {}
    kept = {b: f for b, f in folders.items() if b not in touched}
    _commit(spark, path, now + 1, kept | written, key, buckets)
    return now + 1
