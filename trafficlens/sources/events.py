"""Access-log lines from an ``events`` table.

A fixed rule turns each event into one log line, so that the text parser and
everything after it run on data that grows with the table.
"""

from pyspark.sql import Column, DataFrame, functions as F

TEST_FROM = "2024-01-22 00:00:00"
DAMAGED_LINE = "truncated line"

# Fixed values of the rule.
DOMAINS = {
    1: ".example.com", 2: ".example.COM", 3: ".edu", 4: ".net", 8: ".info",
}
# Users of the other kinds come from these in turn.
COUNTRIES = (
    "uk", "ca", "de", "fr", "jp", "au", "nl", "se", "it", "fi",
    "no", "es", "br", "za", "ch", "at", "dk", "nz", "be", "kr",
)
COUNTRY_KINDS = (5, 6, 7)
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
EXTENSIONS = {0: ".gif", 1: ".html", 2: ".pl", 3: ".mpg", 4: ".txt", 5: ".xyz", 7: ".JPG"}


def _pick(key: Column, table: dict, default: Column) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(key == k, v)
    return out.otherwise(default)


def _text(c: Column) -> Column:
    return c.cast("string")


def requests_from_events(events: DataFrame, *keep: str) -> DataFrame:
    """``event_id``, ``split``, the log line ``value`` and further kept columns."""
    event, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    named = F.concat(F.lit("u"), _text(user))
    hosts = {0: F.concat(F.lit("10.0."), _text(user), F.lit(".1"))}
    hosts |= {k: F.concat(named, F.lit(v)) for k, v in DOMAINS.items()}
    # Counted by the square of the number, so that countries differ in size.
    turn = (F.floor(user / 10) * F.floor(user / 10) + user % 10) % len(COUNTRIES)
    country = F.element_at(F.array(*map(F.lit, COUNTRIES)), turn.cast("int") + 1)
    hosts |= {k: F.concat(named, F.lit("."), country) for k in COUNTRY_KINDS}
    host = _pick(user % 10, hosts, F.concat(F.lit("localhost"), _text(user)))
    method = _pick(
        kind, {"purchase": F.lit("POST"), "signup": F.lit("PUT"), "error": F.lit("BREW")},
        F.lit("GET"),
    )
    ext = _pick(event % 8, {k: F.lit(v) for k, v in EXTENSIONS.items()}, F.lit(""))
    url = F.concat(
        F.lit("/"), kind, F.repeat(F.lit("/s"), (event % 4).cast("int")), F.lit("/d"), _text(event % 7), F.lit("/r"), _text(event % 13), ext
    )
    failed = _pick(event % 3, {0: F.lit("404"), 1: F.lit("500")}, F.lit("403"))
    status = (
        F.when(kind == "error", failed)
        .when(event % 9 == 0, F.lit("304"))
        .when(event % 9 == 1, F.lit("302"))
        .otherwise(F.lit("200"))
    )
    size = F.when((event % 11 == 0) | (event % 9 == 0), F.lit("-")).otherwise(
        _text(F.floor(F.col("value") * 1000))
    )
    # Cut from the text of the time, so that no time zone takes part.
    iso = F.col("ts").cast("string")
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.substring(iso, 6, 2).cast("int"))
    stamp = F.concat(
        F.substring(iso, 9, 2), F.lit("/"), month, F.lit("/"), F.substring(iso, 1, 4), F.lit(":"), F.substring(iso, 12, 8))
    line = F.concat(
        host, F.lit(" - - ["), stamp, F.lit(" -0400] \""),
        method, F.lit(" "), url, F.lit(" HTTP/1.0\" "), status, F.lit(" "), size,
    )
    return events.select(
        "event_id",
        F.when(F.col("ts") < F.lit(TEST_FROM).cast("timestamp_ntz"), F.lit("train"))
        .otherwise(F.lit("test")).alias("split"),
        F.when(event % 101 == 0, F.lit(DAMAGED_LINE)).otherwise(line).alias("value"),
        *keep,
    )
