"""Identity of citations: ECLI forms, numbers, codes and the keys built from them. All JVM-side expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespaces, document types and venue codes of Italian courts.
SUPPORTED_NAMESPACES = ("CASS", "MER", "ADM", "COST", "CONT", "TAX", "ABF", "COVIP")
OUTSIDE_NAMESPACES = ("CEDU", "CGUE")
DOC_TYPES = {"SENTENZA": "SENT", "SENT": "SENT", "ORDINANZA": "ORD", "ORD": "ORD", "DECRETO": "DEC", "DEC": "DEC"}
VENUES = {
    "AGRIGENTO": "AG", "ANCONA": "AN", "AOSTA": "AO", "BARI": "BA", "BOLOGNA": "BO", "BRESCIA": "BS",
    "CAGLIARI": "CA", "CALTANISSETTA": "CL", "CAMPOBASSO": "CB", "CATANIA": "CT", "CATANZARO": "CZ",
    "FIRENZE": "FI", "GENOVA": "GE", "L AQUILA": "AQ", "AQUILA": "AQ", "LECCE": "LE", "MESSINA": "ME",
    "MILANO": "MI", "NAPOLI": "NA", "PALERMO": "PA", "PERUGIA": "PG", "POTENZA": "PZ",
    "REGGIO CALABRIA": "RC", "ROMA": "RM", "SALERNO": "SA", "TORINO": "TO", "TRENTO": "TN",
    "TRIESTE": "TS", "VENEZIA": "VE",
}

ECLI_TOKEN = r"ECLI[:_][A-Z]{2}[:_][A-Z0-9]+[:_][0-9]{4}[:_][A-Z0-9.-]+"


def strip(text: Column) -> Column:
    """Trim every kind of Unicode white space, not blanks alone."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def nonempty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _loose(raw: Column) -> Column:
    parts = F.split(F.translate(raw, "_", ":"), ":")
    return F.when((F.size(parts) >= 5) & (F.get(parts, F.lit(0)) == "ECLI"), F.concat_ws(":", F.slice(parts, 1, 4), F.array_join(F.slice(parts, 5, 1000), "")))


def canonical(text: Column) -> Column:
    """Canonical colon form of an ECLI found in text; null when there is none."""
    raw = F.upper(strip(text))
    return F.coalesce(nonempty(F.translate(F.regexp_extract(raw, f"({ECLI_TOKEN})", 1), "_", ":")), let(raw, _loose))


def part(ecli: Column, index: int) -> Column:
    """Colon-separated part of a canonical ECLI; null past its end."""
    return F.get(F.split(ecli, ":"), F.lit(index))


def year(value: Column) -> Column:
    return nonempty(F.regexp_extract(strip(value.cast("string")), "^([1-9][0-9]{3})$", 1)).cast("int")


def number(value: Column) -> Column:
    """Digits without leading zeros; '0' stays."""
    return nonempty(F.regexp_extract(strip(value.cast("string")), "^0*([0-9]+)$", 1))


def docket(value: Column) -> Column:
    return nonempty(F.regexp_extract(strip(value.cast("string")), "^([0-9]+)$", 1))


def padded_number(value: Column) -> Column:
    """Zero-filled to eight digits, never cut."""
    plain = number(value)
    return F.when(F.length(plain) >= 8, plain).otherwise(F.lpad(plain, 8, "0"))


def doc_type(value: Column) -> Column:
    text = F.rtrim(F.upper(strip(value)), F.lit("."))
    return F.create_map(*[F.lit(x) for kv in DOC_TYPES.items() for x in kv])[text]


def code(value: Column) -> Column:
    return nonempty(F.regexp_replace(F.upper(strip(value)), "[^A-Z0-9]", ""))


def legal_area(value: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in {"CIV": "CIV", "CIVILE": "CIV", "PEN": "PEN", "PENALE": "PEN"}.items() for x in kv])
    return known[F.rtrim(F.upper(strip(value)), F.lit("."))]


def namespace_of(ecli: Column, italian_only: bool = True) -> Column:
    """Namespace that the court part of a canonical ECLI stands for."""
    court = part(F.upper(ecli), 2)
    ok = (F.size(F.split(ecli, ":")) >= 5) & (part(F.upper(ecli), 0) == "ECLI")
    if italian_only:
        ok = ok & (part(F.upper(ecli), 1) == "IT")
    space = (
        F.when(court.isin("CASS", "COST", "CONT", "ABF", "COVIP"), court)
        .when((court == "CDS") | court.startswith("TAR"), "ADM")
        .when(court.startswith("CG1") | court.startswith("CG2"), "TAX")
        .when(court.startswith("CA") | court.startswith("TR"), "MER")
    )
    return F.when(ok, space)


def namespace_for(ecli: Column, suggested: Column) -> Column:
    own = F.upper(strip(suggested))
    return F.coalesce(namespace_of(ecli), F.when(own.isin(*SUPPORTED_NAMESPACES), own))


def venue(words: Column) -> Column:
    """Venue code for upper-case ASCII words: the whole text, else the longest place name within it."""
    whole = F.create_map(*[F.lit(x) for kv in VENUES.items() for x in kv])[words]
    names = sorted(VENUES, key=len, reverse=True)
    return F.coalesce(whole, *[F.when(F.contains(words, F.lit(n)), VENUES[n]) for n in names])


def authority_court(words: Column, namespace: Column) -> Column:
    """Court code derived from the name of an authority."""
    place = venue(words)
    tribunal = F.contains(words, F.lit("TRIBUNALE"))
    appeal = words.rlike("CORTE D APPELLO|CORTE DI APPELLO")
    merit = (F.coalesce(F.upper(namespace), F.lit("")) == "MER") | tribunal | appeal
    return F.when(
        merit & (place.isNull() | tribunal | appeal),
        F.when(place.isNull(), None).when(tribunal, F.concat(F.lit("TR"), place)).otherwise(F.concat(F.lit("CA"), place)),
    ).when(words.rlike("CONSIGLIO DI STATO|CONS STATO"), "CDS").when(
        words.rlike("TAR|T A R"), F.concat(F.lit("TAR"), place)
    )


def exact(namespace: Column, y: Column, n: Column, area: Column, court: Column, place: Column, kind: Column, nrg: Column) -> Column:
    """The one ECLI that complete metadata determine; null when a needed field is missing."""
    return build_exact(F.upper(namespace), year(y), number(n), legal_area(area), code(court), code(place), doc_type(kind), docket(nrg))


def build_exact(ns: Column, y: Column, n: Column, area: Column, court: Column, place: Column, kind: Column, nrg: Column) -> Column:
    """exact for fields that are normalised already."""
    last = F.when(ns == "CASS", area).when(ns.isin("COST", "ABF"), "").when(ns == "MER", F.concat(F.lit("."), nrg)).when(ns.isin("ADM", "TAX"), kind).when(ns == "CONT", place)
    seat = F.when(ns.isin("CASS", "COST", "ABF", "CONT"), ns).when(ns.isin("ADM", "MER"), court).when(ns == "TAX", F.concat(court, place))
    return F.concat(F.lit("ECLI:IT:"), seat, F.lit(":"), y.cast("string"), F.lit(":"), n, last)


def prefix(namespace: Column, y: Column, n: Column, area: Column, court: Column, place: Column, kind: Column, nrg: Column) -> Column:
    """The start that all ECLIs of incomplete metadata share; null when the metadata are complete or too poor."""
    return build_prefix(F.upper(namespace), year(y), number(n), legal_area(area), code(court), code(place), doc_type(kind), docket(nrg))


def build_prefix(ns: Column, y: Column, n: Column, area: Column, court: Column, place: Column, kind: Column, nrg: Column) -> Column:
    """prefix for fields that are normalised already."""
    seat = (
        F.when((ns == "CASS") & area.isNull(), ns).when(ns == "MER", court).when((ns == "ADM") & kind.isNull(), court)
        .when((ns == "TAX") & kind.isNull(), F.concat(court, place)).when((ns == "CONT") & place.isNull(), ns)
    )
    last = F.when(ns == "MER", F.concat(F.lit("."), F.coalesce(nrg, F.lit("")))).otherwise("")
    return F.concat(F.lit("ECLI:IT:"), seat, F.lit(":"), y.cast("string"), F.lit(":"), n, last)


def cass_candidates(y: Column, n: Column, kind: Column) -> tuple[Column, Column]:
    """(requested, homonymous) ECLIs of a Cassation citation, as arrays; from normalised fields."""
    base = F.concat(F.lit("ECLI:IT:CASS:"), y.cast("string"), F.lit(":"), n)
    both = lambda *areas: F.array_compact(F.array(*[F.concat(base, F.lit(x)) for x in areas]))
    none = F.array().cast("array<string>")
    requested = F.when(kind == "CIV", both("CIV")).when(kind == "PEN", both("PEN")).otherwise(both("CIV", "PEN"))
    return requested, F.when(kind == "CIV", both("PEN")).when(kind == "PEN", both("CIV")).otherwise(none)
