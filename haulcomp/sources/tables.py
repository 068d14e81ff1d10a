"""Survey tables: scan, filter, normalise.

``scan`` reads a file; the ``*_from`` functions normalise a raw frame (UPPER-CASE
columns), whatever it was read from; the ``read_*`` functions do both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from haulcomp.functions.rules import required
from haulcomp.sources.schemas import CPUE, CPUE_RAW, LFREQ, SPECIMEN, STRATA


def scan(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Raw columns by name. CSV fields stay text here and are cast by ``typed``; nothing is inferred.

    All CSV files of a folder must have the same header: one that differs is an error, not shifted values.
    """
    reader = spark.read.options(header=True, enforceSchema=False) if fmt == "csv" else spark.read
    return reader.format(fmt).load(path)


# What ``scan_kept`` adds: the line of a record that does not fit the header, and the file of every row.
CORRUPT, FILE = "_corrupt", "_file"


def scan_kept(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """``scan`` with ``_file``, and for CSV with ``_corrupt``: the whole line where it has more or fewer fields than the header."""
    if fmt == "csv":
        names = scan(spark, path, fmt).columns
        fields = [StructField(n, StringType()) for n in [*names, CORRUPT]]
        # All columns are parsed whatever is selected, so that a line is judged as a whole.
        reader = spark.read.schema(StructType(fields)).options(
            header=True, enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, columnPruning=False
        )
        raw = reader.csv(path)
    else:
        raw = scan(spark, path, fmt).withColumn(CORRUPT, F.lit(None).cast("string"))
    return raw.withColumn(FILE, F.col("_metadata.file_path"))


def split_rejects(raw: DataFrame, schema: dict[str, str], needed: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows) of a raw frame by whether every declared field casts; nothing is lost between the two.

    Rejected rows keep their columns and have ``reasons``, one text per field at fault: its column and value, a missing
    field of ``needed``, or that the line does not fit the header.
    """
    types = dict(raw.dtypes)
    by_lower = {c.lower(): c for c in raw.columns}
    gone = [c for c in schema if c not in by_lower]
    if gone:
        raise ValueError(f"missing columns {gone}; found {raw.columns}")
    reasons = []
    for name, kind in schema.items():
        col = F.col(by_lower[name])
        text = F.trim(col) if types[by_lower[name]] == "string" else col.cast("string")
        missing = text.isNull() | text.isin("", "NA")
        fault = F.when(~missing & text.try_cast(kind).isNull(), F.concat(F.lit(f"{name}: "), text))
        reasons.append(fault.when(missing, F.lit(f"{name}: missing")) if name in needed else fault)
    if CORRUPT in raw.columns:
        # Its fields may stand in the wrong columns, so they are not judged.
        broken = F.col(CORRUPT).isNotNull()
        reasons = [F.when(~broken, r) for r in reasons] + [F.when(broken, F.lit("line: not as many fields as the header"))]
    judged = raw.withColumn("reasons", F.filter(F.array(*reasons), lambda r: r.isNotNull()))
    good, bad = F.size("reasons") == 0, F.size("reasons") > 0
    return judged.filter(good).drop("reasons", CORRUPT, FILE), judged.filter(bad)


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def typed(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Select and cast the declared columns; a column that is not there is an error."""
    gone = [c for c in schema if c not in df.columns]
    if gone:
        raise ValueError(f"missing columns {gone}; found {df.columns}")
    types = dict(df.dtypes)

    def value(name: str):
        col = F.col(name)
        if types[name] == "string" and schema[name] != "string":
            text = F.trim(col)
            col = F.when(~text.isin("", "NA"), text)
        return col.cast(schema[name]).alias(name)

    return df.select([value(c) for c in schema])


def strata_from(raw: DataFrame, survey: str) -> DataFrame:
    return typed(lower_names(raw.filter(F.col("SURVEY") == survey)), STRATA)


def lfreq_from(raw: DataFrame, survey: str, strata: DataFrame) -> DataFrame:
    rows = typed(lower_names(raw.filter(F.col("SURVEY") == survey)), LFREQ)
    rows = rows.withColumn("length", required("length"))
    return rows.join(strata.select("stratum"), "stratum", "left_semi").select(*LFREQ)


def cpue_from(raw: DataFrame, survey: str, strata: DataFrame) -> DataFrame:
    """Catch rates with the stratum area; a stratum that is not listed keeps its rows with no area."""
    rows = typed(lower_names(raw.filter(F.col("SURVEY") == survey)), CPUE_RAW)
    return rows.join(strata.select("stratum", "area"), "stratum", "left").select(*CPUE)


def sizepop_from(raw: DataFrame, survey: str) -> DataFrame:
    rows = lower_names(raw.filter(F.col("SURVEY") == survey))
    return rows.select(rows.columns[1:])


def specimen_from(raw: DataFrame, region: str, strata: DataFrame) -> DataFrame:
    rows = typed(lower_names(raw.filter(F.col("REGION") == region)), SPECIMEN)
    known = rows.join(strata.select("stratum"), "stratum", "left_semi")
    return known.filter(F.col("age").isNotNull()).select(*SPECIMEN)


def read_strata(spark: SparkSession, path: str, survey: str, fmt: str = "csv") -> DataFrame:
    return strata_from(scan(spark, path, fmt), survey)


def read_lfreq(spark: SparkSession, path: str, survey: str, strata: DataFrame, fmt: str = "csv") -> DataFrame:
    return lfreq_from(scan(spark, path, fmt), survey, strata)


def read_cpue(spark: SparkSession, path: str, survey: str, strata: DataFrame, fmt: str = "csv") -> DataFrame:
    return cpue_from(scan(spark, path, fmt), survey, strata)


def read_sizepop(spark: SparkSession, path: str, survey: str, fmt: str = "csv") -> DataFrame:
    return sizepop_from(scan(spark, path, fmt), survey)


def read_specimen(spark: SparkSession, path: str, region: str, strata: DataFrame, fmt: str = "csv") -> DataFrame:
    return specimen_from(scan(spark, path, fmt), region, strata)


# By table, its columns, those that may not be missing, and the column that names the survey.
CHECKS = {
    "strata": (STRATA, (), "SURVEY"),
    "lfreq": (LFREQ, ("length", "frequency"), "SURVEY"),
    "cpue": (CPUE_RAW, (), "SURVEY"),
    "specimen": (SPECIMEN, (), "REGION"),
}


def read_checked(
    spark: SparkSession, table: str, path: str, survey: str, strata: DataFrame | None = None, fmt: str = "csv"
) -> tuple[DataFrame, DataFrame]:
    """(the survey's table as its ``read_*`` gives it, rows that do not fit) of a file or folder.

    Rejected rows are those of the survey, and broken lines, whose survey is not known; they have the raw columns, ``_file``,
    ``_corrupt`` and ``reasons``.
    """
    schema, needed, where = CHECKS[table]
    raw = scan_kept(spark, path, fmt)
    mine = raw.filter((F.col(where) == survey) | F.col(CORRUPT).isNotNull())
    good, rejects = split_rejects(mine, schema, needed)
    build = {"strata": strata_from, "lfreq": lfreq_from, "cpue": cpue_from, "specimen": specimen_from}[table]
    return build(good, survey, *([] if table == "strata" else [strata])), rejects


def normalise_ebs(length: DataFrame, haul: DataFrame) -> DataFrame:
    """Length rows with their haul's columns; the year is the first four characters of CRUISE.

    A non-key column that both inputs have is kept twice, with the endings _x and _y.
    """
    dated = length.withColumn("year", F.substring(F.col("CRUISE").cast("string"), 1, 4).cast("int"))
    both = (set(dated.columns) & set(haul.columns)) - {"HAULJOIN"}
    left = dated.withColumnsRenamed({c: f"{c}_x" for c in both})
    right = haul.withColumnsRenamed({c: f"{c}_y" for c in both})
    return lower_names(left.join(right, "HAULJOIN", "inner"))


def normalise_ebs_cpue(haul_summary: DataFrame) -> DataFrame:
    """Haul summary with numcpue and area added from nCPUE and EFFORT."""
    named = haul_summary.withColumns({"numcpue": F.col("nCPUE"), "area": F.col("EFFORT")})
    return lower_names(named)
