"""Registration of queries and their SQL twins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewright.plans.fixtures import Fixtures
from candlewright.plans.sqlparts import statement
from candlewright.session import prepare

QUERIES, SQL = {}, {}


def flat(df: DataFrame) -> DataFrame:
    """Comparable output: doubles with six digits, zone-less times, 64-bit integers."""
    def plain(field):
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DecimalType, T.DoubleType, T.FloatType)):
            column = F.round(column.cast("double"), 6)
        elif isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        return column.alias(field.name)

    return df.select(*[plain(f) for f in df.schema.fields])


def query(name: str, sql: str = None, parts=()):
    """Register a function of :class:`Fixtures` under ``name``.

    ``sql`` is the final SELECT of the twin, ``parts`` the shared sub-queries it
    starts from.
    """
    def register(function):
        def run(spark, folder):
            return flat(function(Fixtures(prepare(spark), folder)))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = statement(sql, parts)
        return function

    return register
