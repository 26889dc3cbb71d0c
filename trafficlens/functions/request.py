"""Column expressions on the request text. Plain string functions, no regex."""

from pyspark.sql import Column, functions as F

from trafficlens import fixed_values as V
from trafficlens.functions.host import choose, flag

# Everything Python and DuckDB users would call white space.
BLANKS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def request_method(request: Column) -> Column:
    word = F.substring_index(request, " ", 1)
    return F.when(word.isin(V.HTTP_METHODS), word).otherwise(F.lit(V.UNKNOWN))


def request_url(request: Column) -> Column:
    """Second space-separated piece; two spaces in a row give an empty one."""
    second = F.substring_index(F.substring_index(request, " ", 2), " ", -1)
    return F.when(F.instr(request, " ") > 0, second).otherwise(F.lit(V.UNKNOWN))


def _clean(url: Column) -> Column:
    return F.btrim(F.replace(url, F.lit(V.PROTOCOL_TEXT), F.lit("")), F.lit(BLANKS))


def url_resource(url: Column) -> Column:
    """Text after the last slash; empty without a slash."""
    return F.regexp_extract(_clean(url), "/([^/]*)\\z", 1)


def url_directory(url: Column) -> Column:
    """Text up to and with the last slash; the raw url without a slash."""
    clean = _clean(url)
    tail = F.length(F.substring_index(clean, "/", -1))
    head = F.left(clean, F.length(clean) - tail)
    return F.when(F.instr(clean, "/") > 0, head).otherwise(url)


# Extension to kind of resource.
RESOURCE_TYPES = {
    ext: kind
    for kind, exts in (
        ("Image", V.IMAGE_TYPES), ("Audio/Video", V.AV_TYPES),
        ("File", V.FILE_TYPES), ("Page", V.PAGE_TYPES),
    )
    for ext in exts
}


def resource_type(resource: Column) -> Column:
    ext = F.lower(F.substring_index(resource, ".", -1))
    kind = choose(ext, RESOURCE_TYPES, F.lit(V.UNKNOWN))
    return F.when(F.instr(resource, ".") == 0, F.lit("Directory")).otherwise(kind)


def path_depth(directory: Column) -> Column:
    slashes = F.length(directory) - F.length(F.replace(directory, F.lit("/"), F.lit("")))
    return F.when(directory == V.UNKNOWN, F.lit(-1)).otherwise(slashes)


def is_dynamic(resource: Column) -> Column:
    return flag(F.lower(resource).rlike(f"({'|'.join(V.DYNAMIC_ENDINGS)})\\z"))


def url_length(url: Column) -> Column:
    return F.length(url)


def is_heavy(kind: Column) -> Column:
    return flag(kind.isin("Audio/Video", "File"))


def is_image(kind: Column) -> Column:
    return flag(kind == "Image")
