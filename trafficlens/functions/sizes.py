"""Column expressions on the response size."""

from pyspark.sql import Column, functions as F

from trafficlens.functions.host import flag


def parse_size(text: Column) -> Column:
    """Whole bytes; ``-`` and anything that is no 64-bit number are null."""
    return text.try_cast("bigint")


def to_kilobytes(size: Column) -> Column:
    return size.cast("double") / F.lit(1000.0)


def bytes_missing(size: Column) -> Column:
    return flag(size.isNull())


def fillable(code: Column) -> Column:
    """Codes whose missing sizes take the median of their code."""
    return code.between(200, 299) | code.between(400, 599)


def imputed(size: Column, code: Column, median: Column, keep_null: bool = False) -> Column:
    """Known size, else the code's median, else 0.

    With ``keep_null`` only redirections and fillable codes are filled; sizes
    missing elsewhere stay null.
    """
    guess = F.when(fillable(code), F.coalesce(median, F.lit(0.0)))
    if keep_null:
        digit = F.left(code.cast("int").cast("string"), F.lit(1))
        return F.coalesce(size, F.when(digit == "3", F.lit(0.0)).otherwise(guess))
    return F.coalesce(size, guess, F.lit(0.0))


def bytes_action(size: Column, fence: Column) -> Column:
    """A null size is for observation, like one above the fence."""
    return F.when(size <= fence, F.lit("normal")).otherwise(F.lit("for observation"))
