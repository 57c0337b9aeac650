"""Reading the shared test tables, and the registry of named queries."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Read one table with only the named columns."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def query(name: str, sql: str | None = None):
    """Register a query, and the SQL that must give the same rows."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# The text rules once more, in the dialect of the checking engine.
SQL_WORD = r"[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*"
SQL_WS = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def sql_words(text: str) -> str:
    return f"regexp_extract_all({text}, '{SQL_WORD}')"
