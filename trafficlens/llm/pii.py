"""Personal data by weak supervision: several labelers vote on every candidate span.

Candidates of each kind are the matches of its base pattern, whether or not they pass its
checks, and of wider patterns (masked addresses, numbers without a country code, ...).
Five labelers vote for, against, or not at all: the base rule, a check of the digits, a
gazetteer (domain ends, issuer digits, country codes), the words before the span, and
the characters around it. Expectation-maximisation estimates, per kind, how reliable
each labeler is and how likely each pattern of votes is personal data; a naive Bayes
classifier learns from these soft labels on the votes and the shape of the span. A span
counts if it is a valid match of a base pattern or the classifier accepts it.

All work on texts is done by DataFrame expressions. EM and classifier see only how often
each combination of votes and shape occurs: at most 4 * 3^5 * 12 numbers, whatever the
number of documents.

Base patterns are written with possessive repeats and a look behind each start, which
finds the same matches without going back over a run of characters again and again.

Defined results: null is the empty text and has no spans; positions are code points, the
end exclusive; spans of one kind do not overlap; a text that is nothing but digits or
punctuation is handled in one pass; columns of the input with the names of the new ones
are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from trafficlens.llm.tables import text_of

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("rule", "check", "gazetteer", "context", "edge")
SHAPES = 12

#: A match starts where the last one ended or where a run of its characters begins.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the base pattern to match at all.
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[] ?(?i:at) ?[)\]] ?[A-Za-z0-9-]++"
             r"(?:(?:\.| ?[(\[] ?(?i:dot) ?[)\]] ?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[._/]|  )[0-9]{4}(?:[._/]|  )[0-9]{4}(?:[._/]|  )[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+.(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_IP = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
#: Gazetteers.
DOMAIN_ENDS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "it", "nl", "eu", "ch", "at", "co")
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47",
                 "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81",
                 "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
#: Words before a span that speak for its kind, and for none.
CUES = {
    "email": r"(?:e-?mail|mailto|contact|write|reach|correo|courriel)",
    "ip": r"(?:\bip\b|host|server|address|from|client|adresse)",
    "card": r"(?:card|visa|master|amex|pay|credit|tarjeta|karte|carte)",
    "phone": r"(?:phone|tel|call|mobile|fax|cell|whatsapp|anruf|appel)",
}
AGAINST = r"(?:version|release|isbn|invoice|order|serial|figure|table|section|chapter|build|token|hash)"

_FOUND = "array<struct<start:int,end:int,match:string,before:string,after:string>>"
_CANDIDATE = "array<struct<kind:int,start:int,end:int,base:boolean,votes:int,shape:int>>"


def _found(text: Column, pattern: str) -> Column:
    """All matches with their places and what stands around them. The pieces between
    the matches and the matches themselves add up to the places."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    n = F.size(matches)
    parts = F.arrays_zip(
        matches.alias("match"), F.slice(pieces, F.lit(1), n).alias("left"), F.slice(pieces, F.lit(2), n).alias("right"))

    def add(state, x):
        start = state["at"] + F.length(x["left"])
        one = F.struct(
            start.alias("start"), (start + F.length(x["match"])).alias("end"), x["match"].alias("match"),
            F.right(x["left"], F.lit(24)).alias("before"), F.left(x["right"], F.lit(1)).alias("after"))
        return F.struct((start + F.length(x["match"])).alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("out"))
    return F.when(n > 0, F.aggregate(parts, start, add, lambda s: s["out"])).otherwise(F.array().cast(_FOUND))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass Luhn's check."""
    each = F.transform(
        F.split(F.reverse(number), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d >= "5", 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda s, d: s + d) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    n = F.length(digits(match))
    if kind == "ip":
        return match.rlike(_IP)
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _check(kind: str, match: Column) -> Column:
    """A vote on the digits: 2 for, 0 against, 1 none."""
    n, number = F.length(digits(match)), digits(match)
    if kind == "email":
        return F.when(match.rlike(r"(?i)[@)\]].*[a-z]$"), 2).otherwise(0)
    if kind == "ip":
        return F.when(match.contains(":"), 1).when(match.rlike(_IP), 2).otherwise(0)
    if kind == "card":
        return F.when(n.between(13, 19) & number.rlike(r"^([0-9])(?!\1*$)"), F.when(luhn(number), 2).otherwise(0)).otherwise(0)
    return F.when(n.between(10, 15), 2).when(n == 9, 1).otherwise(0)


def _gazetteer(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.when(F.lower(F.regexp_extract(match, "([A-Za-z0-9-]+)$", 1)).isin(*DOMAIN_ENDS), 2).otherwise(0)
    if kind == "ip":
        first = F.regexp_extract(match, r"^0*([0-9]{1,3})\.", 1)
        return F.when(first == "", 1).when(first.cast("int").between(1, 239), 2).otherwise(0)
    if kind == "card":
        return F.when(digits(match).rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), 2).otherwise(1)
    code = F.regexp_extract(match, r"^\+([0-9]{1,2})", 1)
    return F.when(code == "", 1).when(code.isin(*COUNTRY_CODES) | F.left(code, F.lit(1)).isin("1", "7"), 2).otherwise(0)


def _candidates(text: Column, kind: str, wider: bool) -> Column:
    found = _found(text, (WIDER if wider else BASE)[kind])

    def voted(x):
        match, before, after = x["match"], F.lower(x["before"]), x["after"]
        good = F.lit(False) if wider else valid(kind, match)
        context = F.when(before.rlike(CUES[kind]), 2).when(before.rlike(AGAINST), 0).otherwise(1)
        edge = F.when(before.rlike(r"[\p{L}\p{N}]$") | after.rlike(r"^[\p{L}\p{N}]"), 0).otherwise(2)
        # The base rule has nothing to say on wider matches.
        rule = F.lit(1) if wider else F.when(good, 2).otherwise(0)
        votes = [rule, _check(kind, match), _gazetteer(kind, match), context, edge]
        number = F.lit(0)
        for vote in votes:
            number = number * 3 + vote
        share = F.length(digits(match)) * 4 / F.length(match)
        shape = F.least(F.floor(F.length(match) / 8), F.lit(2)) * 4 + F.least(F.floor(share), F.lit(3))
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), good.alias("base"),
            number.cast("int").alias("votes"), shape.cast("int").alias("shape"))

    made = F.transform(found, voted).cast(_CANDIDATE)
    if wider:
        needed = text.rlike(r"(?i)[(\[] ?at ?[)\]]") if kind == "email" else text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]") if kind == "ip" else text.rlike("[0-9]{4}")
    else:
        needed = text.contains(NEEDED[kind]) if NEEDED[kind] else text.rlike("[0-9]")
    return F.when(needed, made).otherwise(F.array().cast(_CANDIDATE))


def candidates(docs: DataFrame, name: str = "__candidates") -> DataFrame:
    """The documents with all candidate spans; a wider one gives way to any base match
    of its kind that it touches."""
    text = text_of()
    columns = {f"__base_{kind}": _candidates(text, kind, False) for kind in KINDS}
    columns |= {f"__wide_{kind}": _candidates(text, kind, True) for kind in KINDS}
    out = docs.withColumns(columns)
    parts = []
    for kind in KINDS:
        base, wide = F.col(f"__base_{kind}"), F.col(f"__wide_{kind}")
        free = F.filter(wide, lambda w: ~F.exists(base, lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
        parts += [base, F.when(F.size(wide) > 0, free).otherwise(wide)]
    return out.withColumn(name, F.concat(*parts)).drop(*columns)


# --- learning -----------------------------------------------------------------

def votes_of(number: int) -> tuple[int, ...]:
    """The labelers' votes in a number: 2 for, 0 against, 1 none."""
    return tuple(number // 3 ** i % 3 for i in reversed(range(len(LABELERS))))


def reliabilities(counts: dict[tuple[int, ...], float], rounds: int = 50) -> tuple[float, list[dict[bool, list[float]]], dict]:
    """Expectation-maximisation over patterns of votes.

    Returns the share of personal data, per labeler the chance of each vote given the
    truth, and the chance of being personal data for each pattern. No vote says nothing.
    """
    belief = {v: min(max((sum(v) - len(v)) / (2 * len(v)) + 0.5, 0.05), 0.95) for v in counts}
    share, tables = 0.5, []
    for _ in range(rounds):
        true = sum(n * belief[v] for v, n in counts.items())
        total = sum(counts.values())
        share = (true + 1) / (total + 2)
        tables = []
        for i in range(len(LABELERS)):
            table = {}
            for truth in (True, False):
                # One vote of each sort, and one more that the labeler is right.
                sums = [1.0, 0.0, 1.0]
                sums[2 if truth else 0] += 1
                for v, n in counts.items():
                    if v[i] != 1:
                        sums[v[i]] += n * (belief[v] if truth else 1 - belief[v])
                table[truth] = [x / sum(sums) for x in sums]
            tables.append(table)
        for v in belief:
            odds = math.log(share / (1 - share)) + sum(
                math.log(t[True][vote] / t[False][vote]) for t, vote in zip(tables, v) if vote != 1)
            belief[v] = 1 / (1 + math.exp(-min(max(odds, -50), 50)))
    return share, tables, belief


def _known(votes: tuple[int, ...], shape: int) -> list[tuple[int, int]]:
    """What the classifier looks at: the number of a feature and its value."""
    return [(i, v) for i, v in enumerate(votes) if v != 1] + [(len(votes), shape)]


def learn(docs: DataFrame) -> dict[int, list[int]]:
    """Per kind, the numbers ``votes * SHAPES + shape`` that the classifier accepts."""
    each = candidates(docs.select("text")).select(F.explode("__candidates").alias("c"))
    rows = each.groupBy("c.kind", "c.votes", "c.shape").count().collect()
    accepted: dict[int, list[int]] = {}
    for kind in range(len(KINDS)):
        own = [(votes_of(r["votes"]), r["shape"], r["votes"], r["count"]) for r in rows if r["kind"] == kind]
        if not own:
            continue
        patterns: dict[tuple[int, ...], float] = {}
        for votes, _, _, n in own:
            patterns[votes] = patterns.get(votes, 0) + n
        share, _, belief = reliabilities(patterns)
        # Naive Bayes on votes and shape, from the soft labels.
        sums = {truth: [[1.0, 0.0, 1.0] for _ in LABELERS] + [[1.0] * SHAPES] for truth in (True, False)}
        for votes, shape, _, n in own:
            for truth in (True, False):
                weight = n * (belief[votes] if truth else 1 - belief[votes])
                for i, value in _known(votes, shape):
                    sums[truth][i][value] += weight
        for votes, shape, number, _ in own:
            odds = math.log(share / (1 - share))
            for i, value in _known(votes, shape):
                odds += math.log(sums[True][i][value] / sum(sums[True][i])) - math.log(sums[False][i][value] / sum(sums[False][i]))
            if odds > 0:
                accepted.setdefault(kind, []).append(number * SHAPES + shape)
    return accepted


def find(docs: DataFrame, accepted: dict[int, list[int]] | None = None) -> DataFrame:
    """The documents with base_spans and spans: arrays of (kind, start, end), by kind as
    in KINDS and then by start."""
    accepted = learn(docs) if accepted is None else accepted
    kept = [c for c in docs.columns if c not in ("base_spans", "spans")]

    def good(c):
        test = c["base"]
        for kind, numbers in accepted.items():
            test = test | ((c["kind"] == kind) & (c["votes"] * SHAPES + c["shape"]).isin(*numbers))
        return test

    def short(array):
        return F.sort_array(F.transform(array, lambda c: F.struct(c["kind"], c["start"], c["end"])))

    found = candidates(docs)
    return found.select(
        *kept, short(F.filter("__candidates", lambda c: c["base"])).alias("base_spans"),
        short(F.filter("__candidates", good)).alias("spans"))


def written_form(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redact(docs: DataFrame, accepted: dict[int, list[int]] | None = None) -> DataFrame:
    """The documents with <EMAIL>, <IP>, <CARD> or <PHONE> in place of each span, and
    n_chars after that. Of spans that overlap the first gives its name to all."""
    clash = {c: f"__own_{c}" for c in docs.columns if c in ("spans", "base_spans")}
    found = find(docs.withColumnsRenamed(clash), accepted)
    tags = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    ordered = F.sort_array(F.transform(F.col("spans"), lambda s: F.struct(s["start"], s["end"], s["kind"])))

    def replace(state, s):
        return F.when(s["start"] >= state["at"], F.struct(
            s["end"].alias("at"),
            F.concat(state["out"], F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"]), F.get(tags, s["kind"])).alias("out"),
        )).otherwise(F.struct(F.greatest(s["end"], state["at"]).alias("at"), state["out"].alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cleaned = F.aggregate(ordered, start, replace, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    text = F.when(F.size("spans") > 0, cleaned).otherwise(F.col("text"))
    out = found.withColumn("text", text).drop("spans", "base_spans")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.withColumnsRenamed({v: k for k, v in clash.items()}).select(*docs.columns)
