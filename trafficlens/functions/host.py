"""Column expressions on the visitor's host name."""

from pyspark.sql import Column, functions as F

from trafficlens import fixed_values as V


def choose(key: Column, table: dict, default: Column) -> Column:
    """Look a key up in a small fixed table.

    The key is named once: filters on the result are pushed to the scan with their
    expressions written out, and a key named per entry would multiply there.
    """
    def literal(v):
        return "'" + v.replace("'", "\\'") + "'" if isinstance(v, str) else str(v)

    entries = ", ".join(f"{literal(k)}, {literal(v)}" for k, v in table.items())
    return F.coalesce(F.try_element_at(F.expr(f"map({entries})"), key), default)


def _last_label(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def tld(host: Column) -> Column:
    """Last label in lower case; null for addresses, numbers and plain names."""
    label = F.lower(_last_label(host))
    nothing = (
        (F.instr(host, ".") == 0) | host.rlike(V.IPV4_PATTERN) | label.rlike("^[0-9]+$")
    )
    return F.when(~nothing, label)


def domain(host: Column) -> Column:
    """The variant that keeps letter case and writes a missing label as ``None``."""
    label = _last_label(host)
    found = (F.instr(host, ".") > 0) & ~label.rlike("^[0-9]+$")
    return F.when(found, label).otherwise(F.lit("None"))


def visitor_category(label: Column) -> Column:
    """Country for two letters, a known kind for three, unknown for the rest."""
    known = choose(label, V.TLD_CATEGORIES, F.lit("unknown"))
    return (
        F.when(F.length(label) == 2, F.lit("country"))
        .when(F.length(label) == 3, known)
        .otherwise(F.lit("unknown"))
    )


def visitor_country(category: Column, label: Column, other: str = V.OTHER_COUNTRY) -> Column:
    return F.when(category == "country", label).otherwise(F.lit(other))


def visitor_type(category: Column) -> Column:
    return F.when(category.isin(V.MAIN_VISITOR_TYPES), category).otherwise(F.lit("other"))


def flag(condition: Column) -> Column:
    """0/1 with null counted as 0."""
    return F.coalesce(condition, F.lit(False)).cast("byte")
