"""Column expressions for forecasts and server counts."""

from pyspark.sql import Column, functions as F

from trafficlens import fixed_values as V


def to_log(y: Column) -> Column:
    return F.log1p(y)


def from_log(y: Column) -> Column:
    """Back to the target's scale, never below zero."""
    return F.greatest(F.expm1(y), F.lit(0.0))


def required_servers(
    requests: Column, size: Column, cap_requests: Column, cap_bytes: Column,
    utilisation: float = V.POLICY_UTILISATION,
) -> Column:
    """A load without capacity (a peak of 0) asks for no server; one runs at least."""
    by_requests = F.ceil(F.try_divide(requests, cap_requests * F.lit(utilisation)))
    by_bytes = F.ceil(F.try_divide(size, cap_bytes * F.lit(utilisation)))
    return F.greatest(by_requests, by_bytes, F.lit(1).cast("long"))


def overload(
    requests: Column, size: Column, servers: Column, cap_requests: Column, cap_bytes: Column
) -> Column:
    return (requests > servers * cap_requests) | (size > servers * cap_bytes)
