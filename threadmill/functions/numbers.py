"""Rounding."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column, digits: int) -> Column:
    """Rounded as the double that it is: Spark's own functions round the printed decimal, so that 0.575, which is less, would become 0.58."""
    return F.rint(c * 10.0**digits) / 10.0**digits
