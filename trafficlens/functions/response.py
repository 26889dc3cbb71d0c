"""Column expressions on the status code."""

from pyspark.sql import Column, functions as F

from trafficlens import fixed_values as V
from trafficlens.functions.host import choose


def first_digit(code: Column) -> Column:
    return F.left(code.cast("int").cast("string"), F.lit(1))


def response_class(code: Column, unknown: str | None = "unknown") -> Column:
    """Class by the first digit of the number; ``unknown=None`` leaves a null."""
    return choose(first_digit(code), V.RESPONSE_CLASSES, F.lit(unknown).cast("string"))


def response_status(code: Column, unknown: str | None = V.UNKNOWN_STATUS_PHRASE) -> Column:
    """Standard phrase of the code; codes outside the standard share one phrase."""
    return choose(code.cast("int"), V.STATUS_PHRASES, F.lit(unknown).cast("string"))


def response_result(code: Column) -> Column:
    good = first_digit(code).isin("1", "2", "3")
    return F.when(good, F.lit("success")).otherwise(F.lit("fail"))
