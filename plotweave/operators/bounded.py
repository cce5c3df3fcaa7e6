"""Small tables, whose size is checked before they are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are broadcast at most.
MAX_ROWS = 50_000


def small(table: DataFrame, most: int = MAX_ROWS) -> DataFrame:
    """``table`` as broadcast local rows if it has at most ``most``, else as it is, for a shuffled join.

    At most ``most + 1`` rows come to the driver; the table isn't computed again.
    """
    rows = table.limit(most + 1).collect()
    return table if len(rows) > most else F.broadcast(table.sparkSession.createDataFrame(rows, table.schema))
