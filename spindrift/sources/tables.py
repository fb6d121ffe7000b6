"""Tables: typed CSV, Parquet, literal rows; their filtered forms, kept by predicate; sinks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import Predicate

TYPES = {"int32": T.IntegerType(), "int64": T.LongType(), "fp64": T.DoubleType(), "varchar": T.StringType()}
#: Parquet tables, or only their schemas, by session, path and time of change; the oldest go first.
_TABLES: dict[tuple, tuple[SparkSession, DataFrame | T.StructType]] = {}
KEPT_TABLES = 1000


def schema(columns: Iterable[tuple[str, str]]) -> T.StructType:
    """A schema from names and type names (int32, int64, fp64, varchar)."""
    return T.StructType([T.StructField(n, TYPES[t]) for n, t in columns])


def read_csv(spark: SparkSession, path: str, columns: T.StructType, where: Predicate | None = None, header: bool = False, escape: str = "\\", sep: str = ",", trailing_separator: bool = False, quotes: str = "whole") -> DataFrame:
    """Fields may hold separators and newlines in double quotes; an empty field is null, whatever its type; a bad number
    or a wrong number of fields stops the query. trailing_separator: each record ends with one more separator.

    quotes: "whole" for fields that are quoted from end to end (Spark's own reader); "anywhere" if quotes may open and
    close inside a field and only say what is literal, as in ab"c,d"e for abc,de. Each file is then one row at first.
    """
    if quotes == "anywhere":
        df = _toggled(spark, path, columns, header, escape, sep, trailing_separator)
    else:
        full = T.StructType([*columns.fields, T.StructField("_end", T.StringType())]) if trailing_separator else columns
        df = spark.read.csv(path, schema=full, header=header, sep=sep, quote='"', escape=escape, multiLine=True, mode="FAILFAST", emptyValue=None, nullValue="")
        df = df.drop("_end") if trailing_separator else df
    return df if where is None else df.where(where.column())


def _literal(c: str) -> str:
    """A character in a pattern's class."""
    return "\\" + c


def _toggled(spark: SparkSession, path: str, columns: T.StructType, header: bool, escape: str, sep: str, trailing_separator: bool) -> DataFrame:
    """Records, then fields, then parts of fields inside and outside of quotes, by patterns that never go back."""
    esc, comma = _literal(escape), _literal(sep)
    quoted = '"[^"]*+"' if escape == '"' else rf'"(?:[^"{esc}]++|{esc}[\s\S])*+"'
    record = rf'(?:[^"\r\n]++|{quoted})*+(?:\r\n|\r|\n|\z)'
    field = rf'(?:[^"{comma}]++|{quoted})*+{comma}'
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract_all("value", F.lit(record), F.lit(0)).alias("records"), F.length("value").alias("length"))
    read = F.aggregate("records", F.lit(0), lambda a, r: a + F.length(r))
    files = files.select(F.when(read == F.col("length"), F.filter("records", lambda r: r != "")).otherwise(F.raise_error(F.lit("a quote isn't closed"))).alias("records"))
    rows = files.select(F.posexplode("records").alias("at", "record")).where("at > 0" if header else "true")
    line = F.regexp_replace("record", r"(?:\r\n|\r|\n)\z", "")
    line = line if trailing_separator else F.concat(line, F.lit(sep))
    rows = rows.select(F.regexp_extract_all(line, F.lit(field), F.lit(0)).alias("fields"), line.alias("line"))
    whole = F.aggregate("fields", F.lit(0), lambda a, r: a + F.length(r)) == F.length("line")
    rows = rows.select(F.when(whole & (F.size("fields") == len(columns)), F.transform("fields", lambda x: F.substr(x, F.lit(1), F.length(x) - 1))).otherwise(F.raise_error(F.concat(F.lit("wrong number of fields: "), "line"))).alias("fields"))

    def plain(x: Column) -> Column:
        parts = F.regexp_extract_all(x, F.lit(rf'[^"]++|{quoted}'), F.lit(0))
        inner = lambda p: F.substr(p, F.lit(2), F.length(p) - 2)
        if escape == '"':  # a quote that closes and opens at once stands for itself
            return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, '""', "\x01"), '"', ""), "\x01", '"')
        return F.array_join(F.transform(parts, lambda p: F.when(p.startswith('"'), F.regexp_replace(inner(p), rf'{esc}(["{esc}])', "$1")).otherwise(p)), "")

    out = []
    for i, f in enumerate(columns):
        text = F.nullif(plain(F.col("fields")[i]), F.lit(""))
        if not isinstance(f.dataType, T.StringType):
            made = text.try_cast(f.dataType)
            text = F.when(text.isNotNull() & made.isNull(), F.raise_error(F.concat(F.lit(f"malformed {f.name}: "), text))).otherwise(made)
        out.append(text.cast(f.dataType).alias(f.name))
    return rows.select(*out)


def read_parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Its footers are read and its files listed once a session, and again when the file, or the folder of files,
    has changed; a table with folders inside is listed each time."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    status = files.getFileStatus(where)
    key = id(spark._jsparkSession), spark.sparkContext.applicationId, path, status.getModificationTime(), status.getLen()
    if key not in _TABLES:
        while len(_TABLES) >= KEPT_TABLES:
            _TABLES.pop(next(iter(_TABLES)))
        df = spark.read.parquet(path)
        deep = any(f.isDirectory() for f in files.listStatus(where))
        _TABLES[key] = spark, df.schema if deep else df
    _, kept = _TABLES[key]
    return kept if isinstance(kept, DataFrame) else spark.read.schema(kept).parquet(path)


class Folder(Mapping):
    """The named Parquet tables of a folder, opened when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, names: Iterable[str]):
        self._spark, self._dir, self._names, self._open = spark, sf_dir, tuple(names), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._names:
            raise KeyError(name)
        if name not in self._open:
            self._open[name] = read_parquet(self._spark, self._dir, name)
        return self._open[name]

    def __contains__(self, name: object) -> bool:
        return name in self._names

    def __iter__(self) -> Iterator[str]:
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)


def literal(spark: SparkSession, rows: list[tuple], types: list[str]) -> DataFrame:
    """Columns c0, c1 ... of these type names."""
    return spark.createDataFrame(rows, schema((f"c{i}", t) for i, t in enumerate(types)))


class Tables:
    """Named tables, and their filtered forms persisted by predicate text. `most` of them are kept; the oldest goes first."""

    def __init__(self, named: Mapping[str, DataFrame], most: int = 64):
        self.named, self.most, self._kept = named, most, {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str, *names: str) -> Tables:
        return cls(Folder(spark, sf_dir, names))

    def get(self, name: str, where: Predicate | None = None, keep: bool = False) -> DataFrame:
        key = name, str(where)
        if key in self._kept:
            return self._kept[key]
        df = self.named[name] if where is None else self.named[name].where(where.column())
        if keep:
            if len(self._kept) >= self.most:
                self._kept.pop(next(iter(self._kept))).unpersist()
            df = self._kept[key] = df.persist()
        return df

    def release(self) -> None:
        for df in self._kept.values():
            df.unpersist()
        self._kept.clear()


def rows(df: DataFrame) -> list[Row]:
    """A result's rows on the driver."""
    return df.collect()


def csv_to_parquet(spark: SparkSession, files: dict[str, tuple[str, T.StructType]], out_dir: str, **options) -> None:
    """Converts each named (path, schema) to a Parquet table."""
    for name, (path, columns) in files.items():
        read_csv(spark, path, columns, **options).write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/{name}.parquet")


def printed(df: DataFrame, limit: int = 20) -> str:
    """Up to `limit` rows: fields between bars, strings quoted, NULL for null."""
    show = lambda v: "NULL" if v is None else '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"' if isinstance(v, str) else str(v)
    return "\n".join("|".join(map(show, r)) for r in df.limit(limit).collect())
