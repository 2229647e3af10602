"""Reading, normalising and resuming loads."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pitspark.functions.scalar import blank, parse_day


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str,
               dates: Sequence[str] = (), kind: str = "csv") -> DataFrame:
    """Typed CSV or Parquet (``kind``) with explicit columns; NaN becomes null, dates are parsed by name."""
    if kind not in ("csv", "parquet"):
        raise ValueError("kind must be 'csv' or 'parquet'")
    if kind == "parquet":
        df = spark.read.parquet(path)
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])
    else:
        df = spark.read.schema(schema).csv(path, header=True, enforceSchema=False)
    df = df.withColumns({c: parse_day(c) for c in dates if dict(df.dtypes)[c] != "date"}) if dates else df
    nan = {c: F.when(~F.isnan(c), F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")}
    return df.withColumns(nan) if nan else df


def read_optional(spark: SparkSession, path: str, schema: T.StructType | str,
                  dates: Sequence[str] = (), kind: str = "csv") -> DataFrame | None:
    """None when the table is absent, which switches its features off at plan time."""
    return read_table(spark, path, schema, dates, kind) if path_exists(spark, path) else None


def first_present(df: DataFrame, names: Sequence[str]) -> str:
    for n in names:
        if n in df.columns:
            return n
    raise ValueError(f"none of {list(names)} in {df.columns}")


def normalise_series(df: DataFrame, date_names: Sequence[str], value_names: Sequence[str],
                     out: str = "v") -> DataFrame:
    """(date, value) from the first of the named columns that are there; rows that do not parse are
    dropped."""
    d, v = first_present(df, date_names), first_present(df, value_names)
    value = F.expr(f"try_cast(`{v}` as double)")
    return df.select(parse_day(d).alias("date"), value.alias(out)).where(
        F.col("date").isNotNull() & F.col(out).isNotNull() & ~F.isnan(out))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Member, class, home from a commented CSV; rows without a class are ignored."""
    raw = spark.read.csv(path, header=True, comment="#", inferSchema=False)
    raw = raw.toDF(*["member", "class", "home", "source"][:len(raw.columns)])
    return raw.where(~blank("class")).withColumn("class", F.lower(F.trim("class")))


def new_rows(source: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """Source rows whose key is not loaded yet."""
    return source if done is None else source.join(done.select(key).distinct(), key, "left_anti")


def append_new(source: DataFrame, path: str, key: str) -> None:
    """Resume a load; running it again adds nothing."""
    spark = source.sparkSession
    done = spark.read.parquet(path) if path_exists(spark, path) else None
    new_rows(source, done, key).write.mode("append").parquet(path)


def with_failures(df: DataFrame, reasons: dict[str, str]) -> DataFrame:
    """``reason``, the first condition (SQL text) a row fails, null when it is good."""
    conds = [F.when(F.expr(cond), why) for why, cond in reasons.items()]
    return df.withColumn("reason", F.coalesce(*conds))


def split_failures(df: DataFrame, reasons: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(good rows, failed rows with their reason)."""
    got = with_failures(df, reasons)
    return got.where("reason is null").drop("reason"), got.where("reason is not null")


def stack_series(frames: dict[str, DataFrame], group: str = "grp") -> DataFrame:
    """Per-group series on top of each other; columns missing from one are null."""
    out = None
    for name, df in frames.items():
        part = df.withColumn(group, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def align_series(frames: dict[str, DataFrame], on: str = "date") -> DataFrame:
    """(date, value) series side by side over the union of their dates."""
    out = None
    for name, df in frames.items():
        value = next(c for c in df.columns if c != on)
        part = df.groupBy(on).agg(F.max(value).alias(name))
        out = part if out is None else out.join(part, on, "full")
    return out


def fill_from_reference(df: DataFrame, ref: DataFrame, key: str, target: str,
                        fields: Sequence[str]) -> DataFrame:
    """Blank targets take the first non-blank reference field; ``filled`` and ``still_blank`` say
    what happened."""
    one = ref.groupBy(key).agg(*[F.max(f).alias(f) for f in fields])

    def text(c):
        return F.when(~blank(c), F.trim(c))

    found = F.coalesce(*[text(f) for f in fields])
    got = df.join(one, key, "left")
    value = F.coalesce(text(target), found)
    return got.withColumns({"_v": value, "filled": (blank(target) & found.isNotNull()).cast("int")}).select(
        *[F.col("_v").alias(target) if c == target else F.col(c) for c in df.columns], "filled",
        F.col("_v").isNull().cast("int").alias("still_blank"))
