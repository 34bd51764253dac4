"""Grand totals that exist even for empty input."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_empty_row(base: DataFrame) -> DataFrame:
    """``base`` and one all-NULL row.

    Grouping sets give no grand total without input rows. The extra row adds
    nothing to sums and counts of non-NULL values; the groups it opens have no
    rows of their own and are filtered by their count.
    """
    blank = base.sparkSession.range(1).select(*[
        F.lit(None).cast(f.dataType).alias(f.name) for f in base.schema.fields])
    return base.unionByName(blank)
