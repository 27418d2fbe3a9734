"""Citations in free text: identifiers, court references, sources outside the index, links; and their merging."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from giurispark.functions import ecli
from giurispark.session import spread

#: The identifier as it stands in text.
ECLI_JVM = r"(?i)\b(ECLI:IT:[A-Z0-9]+:[0-9]{4}:[A-Z0-9.]*[A-Z0-9])\b"
#: How courts, kinds of decision, numbers, areas and outside sources are written, word by word; a court that takes a name or place is followed by any words but no comma, semicolon or line end.
COURTS = {
    "CASS": ("casssu", "casslav", "cass.", "cassazione", "corte di cassazione"),
    "MER": ("tribunale di", "corte d'appello di", "corte di appello di"),
    "ADM": ("cons. stato", "consiglio di stato", "tar", "t.a.r.", "t.a.r"),
    "COST": ("corte cost.", "corte costituzionale"),
    "CONT": ("corte dei conti",),
    "TAX": ("corte di giustizia tributaria", "commissione tributaria"),
}
PLACED = ("tribunale di", "corte d'appello di", "corte di appello di", "tar", "t.a.r.", "t.a.r", "corte dei conti", "corte di giustizia tributaria", "commissione tributaria")
KINDS = ("sentenza", "sent", "sent.", "ordinanza", "ord", "ord.", "decreto", "dec", "dec.")
NUMBERS = ("n.", "num.", "numero")
SECTIONS = ("sez.", "sezione")
AREAS = ("civ.", "civile", "pen.", "penale")
JUDICIAL = {"CEDU": ("cedu", "corte edu", "corte europea dei diritti dell'uomo"), "CGUE": ("cgue", "corte di giustizia ue", "corte di giustizia dell'unione europea")}
ARTICLES, CODES, DOCTRINE = ("art.", "articolo"), ("c.p.c.", "c.p.p.", "c.c.", "c.p.", "cost.", "costituzione"), "dottrina"
#: Letters after the name of a European court that belong to its mention, unless a sentence, clause or line ends.
TAIL = 80
_PLAIN = re.compile(r"\bECLI:IT:[A-Z0-9]+:\d{4}:[A-Z0-9.]*[A-Z0-9]\b", re.I)
_LINK = re.compile(r"\[[^\]\n]*\]\((https?://[^\s()<>]+)\)|(https?://[^\s<>\"')\]]+)")
_SLUG = re.compile(r"ECLI[:_]IT[:_][A-Z0-9]+[:_]\d{4}[:_][A-Z0-9.]+", re.I)
#: Words (with one point at their end, joined by apostrophes), runs of digits, line ends, single marks.
_PIECE = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*\.?|\d+|\n|[^\s]")


def _phrases(names: Iterable[str]) -> dict[str, list[tuple[str, ...]]]:
    """Phrases by their first piece, the longest first."""
    out: dict[str, list[tuple[str, ...]]] = {}
    for name in names:
        pieces = tuple(m.group() for m in _PIECE.finditer(name))
        out.setdefault(pieces[0], []).append(pieces)
    return {k: sorted(v, key=len, reverse=True) for k, v in out.items()}


_COURT_OF = {tuple(m.group() for m in _PIECE.finditer(n)): (ns, n in PLACED) for ns, names in COURTS.items() for n in names}
_COURT_PHRASES = _phrases(n for names in COURTS.values() for n in names)
_OUTSIDE_OF = {tuple(m.group() for m in _PIECE.finditer(n)): ns for ns, names in JUDICIAL.items() for n in names}
_OUTSIDE_PHRASES = _phrases(n for names in JUDICIAL.values() for n in names)
_CODE_PHRASES = _phrases(CODES)


@dataclass
class Pieces:
    """A text as a row of pieces with their places."""

    text: str
    key: list[str]
    start: list[int]
    end: list[int]

    @classmethod
    def of(cls, text: str) -> Pieces:
        found = [(m.group().lower().replace("’", "'"), m.start(), m.end()) for m in _PIECE.finditer(text)]
        return cls(text, *(list(x) for x in zip(*found))) if found else cls(text, [], [], [])

    def phrase(self, i: int, table: dict[str, list[tuple[str, ...]]]) -> tuple[str, ...] | None:
        """The longest phrase of the table that begins at piece i; a sentence may end with its last word."""
        for first in (self.key[i], self.key[i].rstrip(".")):
            for pieces in table.get(first, ()):
                got = tuple(self.key[i : i + len(pieces)])
                if got == pieces or got[:-1] == pieces[:-1] and len(got) == len(pieces) and got[-1].rstrip(".") == pieces[-1]:
                    return pieces
        return None

    def number(self, i: int) -> tuple[int, int, str, int] | None:
        """(first piece, piece after, number, year) of "[kind] n. 12/2020" or "n. 12 del 2020" whose kind or number word is piece i."""
        k, at = self.key, i + (self.key[i] in KINDS)
        if at + 3 < len(k) and k[at] in NUMBERS and k[at + 1].isdecimal() and k[at + 2] in ("/", "del") and k[at + 3].isdecimal() and self.end[at + 3] - self.start[at + 3] >= 4:
            return i, at + 4, k[at + 1], int(k[at + 3][:4])
        return None


def courts(p: Pieces) -> list[dict]:
    """References with a court: states are court, area, section, and the number that ends them."""
    found, i = [], 0
    while i < len(p.key):
        name = p.phrase(i, _COURT_PHRASES)
        if name is None:
            i += 1
            continue
        namespace, placed = _COURT_OF[name]
        at, area, section = i + len(name), None, None
        authority_end = at
        if namespace == "CASS":
            if at < len(p.key) and p.key[at] in AREAS:
                area, at = p.text[p.start[at] : p.end[at]], at + 1
            at += at < len(p.key) and p.key[at] == ","
            if at < len(p.key) and p.key[at] in SECTIONS:
                first = at = at + 1
                while at < len(p.key) and p.key[at] not in (",", ";", "\n") and p.number(at) is None:
                    at += 1
                section = p.text[p.start[first] : p.end[at - 1]] if at > first else None
                at += at < len(p.key) and p.key[at] == ","
        else:
            while placed and at < len(p.key) and p.key[at] not in (",", ";", "\n") and p.number(at) is None:
                if p.phrase(at, _COURT_PHRASES):  # a nearer court takes the number
                    break
                at += 1
            authority_end = at
            at += at < len(p.key) and p.key[at] == ","
        if at < len(p.key) and (number := p.number(at)):
            kind = p.key[at] if p.key[at] in KINDS else None
            found.append({
                "channel": "court", "namespace": namespace, "authority": p.text[p.start[i] : p.end[authority_end - 1]], "area": area, "section": section, "kind": kind,
                "number": number[2], "year": number[3], "start": p.start[i], "end": p.start[number[1] - 1] + 4, "text": p.text[p.start[i] : p.start[number[1] - 1] + 4], "next": number[1],
            })
            i = number[1]
        else:
            i += 1
    return found


def followers(p: Pieces, full: list[dict]) -> list[dict]:
    """Short references take court, area, section and kind from the reference they follow, until the text breaks off."""
    out = []
    for c in full:
        last, at = c, c["next"]
        while at < len(p.key) and p.key[at] in ("e", "ed", "nonché", ",", ";"):
            first = at + 1
            if first < len(p.key) and p.key[first] == "la":
                first += 1
            if first >= len(p.key) or not (number := p.number(first)):
                break
            kind = p.key[first] if p.key[first] in KINDS else last["kind"]
            end = p.start[number[1] - 1] + 4
            last = last | {"channel": "inherited", "kind": kind, "number": number[2], "year": number[3], "start": p.start[at], "end": end, "text": p.text[p.start[at] : end]}
            out.append(last)
            at = number[1]
    return out


def outside(p: Pieces) -> list[dict]:
    """European courts with the clause they stand in, articles of codes, doctrine."""
    found = []
    for i, key in enumerate(p.key):
        if name := p.phrase(i, _OUTSIDE_PHRASES):
            stop = p.start[i + len(name) - 1] + len(name[-1])
            tail = re.match(rf"[^.;\n]{{0,{TAIL}}}", p.text[stop:]).end()
            found.append({"channel": "outside", "namespace": _OUTSIDE_OF[name], "authority": p.text[p.start[i] : stop], "start": p.start[i], "end": stop + tail, "text": p.text[p.start[i] : stop + tail].strip()})
        elif key in ARTICLES and i + 2 < len(p.key) and p.key[i + 1].isdecimal():
            at = i + 2
            if p.start[at] == p.end[i + 1] and p.key[at].isalpha():  # 2043bis
                at += 1
            if at < len(p.key) and (code := p.phrase(at, _CODE_PHRASES)):
                end = p.start[at + len(code) - 1] + len(code[-1])
                found.append({"channel": "outside", "namespace": "CODE", "authority": p.text[p.start[i] : p.end[i]], "number": p.text[p.start[i + 1] : p.end[at - 1]], "start": p.start[i], "end": end, "text": p.text[p.start[i] : end]})
        elif key.rstrip(".") == DOCTRINE:
            end = p.start[i] + len(DOCTRINE)
            found.append({"channel": "outside", "namespace": "DOCTRINE", "authority": p.text[p.start[i] : end], "start": p.start[i], "end": end, "text": p.text[p.start[i] : end]})
    return found


FIELDS = ["id", "channel", "namespace", "authority", "area", "section", "kind", "number", "year", "ecli", "start", "end", "text"]
OUT = T.StructType([T.StructField(f, {"id": T.LongType(), "year": T.IntegerType(), "start": T.IntegerType(), "end": T.IntegerType()}.get(f, T.StringType())) for f in FIELDS])


def find(text: str) -> list[dict]:
    """All references of a text with their spans in code points, in order; links and identifiers hide what stands in them."""
    found, taken = [], []
    free = lambda m: not any(a < m.end() and m.start() < b for a, b in taken)
    for m in _LINK.finditer(text):
        url = (m.group(1) or m.group(2)).rstrip(".,;:!?")
        taken.append(m.span())
        if slug := _SLUG.search(url):
            parts = slug.group().upper().replace("_", ":").rstrip(".").split(":")
            if 1900 <= int(parts[3]) <= 2100:
                found.append({"channel": "url", "ecli": ":".join(parts), "start": m.start(), "end": m.start() + len(m.group().rstrip(".,;:!?")), "text": url})
    for m in _PLAIN.finditer(text):
        if free(m):
            found.append({"channel": "ecli", "ecli": m.group().upper(), "start": m.start(), "end": m.end(), "text": m.group()})
    pieces = Pieces.of(text)
    taken = [(c["start"], c["end"]) for c in found] + [s for s in taken]
    clear = lambda c: not any(a < c["end"] and c["start"] < b for a, b in taken)
    full = [c for c in courts(pieces) if clear(c)]
    found += full + followers(pieces, full) + [c for c in outside(pieces) if clear(c)]
    return sorted(found, key=lambda c: (c["start"], c["end"], c["channel"]))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"id": pa.int64(), "year": pa.int32(), "start": pa.int32(), "end": pa.int32()}
    schema = pa.schema([(f, kinds.get(f, pa.string())) for f in FIELDS])
    for batch in batches:
        rows = [{"id": k} | c for k, t in zip(batch["id"].to_pylist(), batch["text"].to_pylist()) for c in find(t)]
        yield pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in rows], schema.field(f).type) for f in FIELDS], schema=schema)


def extract(texts: DataFrame) -> DataFrame:
    """References of (id, text), every channel."""
    return spread(texts.where("text IS NOT NULL").select(F.col("id").cast("long").alias("id"), "text")).mapInArrow(_batches, OUT)


def identifiers(text: Column) -> Column:
    """All plain identifiers of a text, JVM-side."""
    return F.transform(F.regexp_extract_all(text, F.lit(ECLI_JVM), F.lit(1)), F.upper)


def numbered(text: Column) -> Column:
    """Every number/year of a composite reference as text 'number/year'."""
    pairs = F.regexp_extract_all(text, F.lit(r"(?i)(?:n\.|num\.|numero)\s*([0-9]+\s*(?:/|\s+del\s+)\s*[0-9]{4})"), F.lit(1))
    return F.transform(pairs, lambda p: F.regexp_replace(p, r"\s*(/|\s+del\s+)\s*", "/"))


def key(citation_ecli: Column, namespace: Column, number: Column, year: Column, area: Column, text: Column) -> Column:
    """What makes two references one: the identifier, else court, number, year and area, else the text itself."""
    parts = F.when(number.isNotNull() & year.isNotNull(), F.concat_ws("|", F.coalesce(namespace, F.lit("")), year.cast("string"), number, F.coalesce(area, F.lit(""))))
    return F.coalesce(citation_ecli, parts, F.lower(F.trim(text)))


def merge(citations: DataFrame, group: list[str], fields: list[str], order: list[str], method: str) -> DataFrame:
    """One row per group: of every field the first value in span order, all spans, and 'merged' where methods differ.

    A group's references are those of one text and key, so what is gathered is bounded by the text.
    """
    rows = F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order], method)))
    first = lambda f: F.get(F.filter(F.transform("rows", lambda r: r[f]), lambda v: v.isNotNull()), F.lit(0)).alias(f)
    merged = citations.groupBy(*group).agg(rows.alias("rows"))
    methods = F.array_distinct(F.transform("rows", lambda r: r[method]))
    return merged.select(
        *group, *[first(f) for f in fields], F.array_distinct(F.transform("rows", lambda r: F.struct(*[r[o].alias(o) for o in order]))).alias("spans"),
        F.when(F.size(methods) > 1, "merged").otherwise(F.get(methods, F.lit(0))).alias(method), F.size("rows").alias("mentions"),
    )


def linked(plain: DataFrame, urls: DataFrame) -> DataFrame:
    """Cassation references without identifier, each with the first link of its text of equal year and number and no contrary area."""
    u = urls.select(F.col("id").alias("u_id"), F.col("year").alias("u_year"), F.col("number").alias("u_number"), F.col("area").alias("u_area"), F.col("ecli").alias("u_ecli"), F.col("start").alias("u_start"))
    fits = F.col("area").isNull() | F.col("u_area").isNull() | (F.col("area") == F.col("u_area"))
    joined = plain.join(u, (F.col("id") == F.col("u_id")) & (F.col("year") == F.col("u_year")) & (F.col("number") == F.col("u_number")) & fits)
    return joined.groupBy("citation_id").agg(F.min_by("u_ecli", F.struct("u_start", "u_ecli")).alias("linked_ecli"))


def recovered(items: DataFrame, parsed: DataFrame) -> DataFrame:
    """Items traced to the one span of their text with equal number and year; several spans leave them open."""
    joined = items.join(parsed.select("id", "number", "year", "start", "end"), ["id", "number", "year"])
    return joined.groupBy("citation_id").agg(F.countDistinct("start", "end").alias("spans"), F.min(F.struct("start", "end")).alias("span")).select("citation_id", "spans", F.when(F.col("spans") == 1, F.col("span.start")).alias("start"), F.when(F.col("spans") == 1, F.col("span.end")).alias("end"))


#: What of a text is covered by links that name an identifier, by plain identifiers, and by European courts with their clause. Java and RE2 read them alike.
COVERED = (
    r"(?i)\[[^\]\n]*\]\(https?://[^\s()<>]*ECLI[:_]IT[:_][A-Z0-9]+[:_](?:19|20)[0-9]{2}[:_][A-Z0-9.]+[^\s()<>]*\)",
    r"(?i)https?://[^\s()<>\"'\]]*ECLI[:_]IT[:_][A-Z0-9]+[:_](?:19|20)[0-9]{2}[:_][A-Z0-9.]+[^\s()<>\"'\]]*",
    r"(?i)\bECLI:IT:[A-Z0-9]+:[0-9]{4}:[A-Z0-9.]*[A-Z0-9]\b",
    rf"(?i)\b(?:CEDU\b|Corte\s+EDU\b|Corte\s+europea\s+dei\s+diritti\s+dell['’]uomo|CGUE|Corte\s+di\s+giustizia\s+(?:UE|dell['’]Unione\s+europea))[^.;\n]{{0,{TAIL}}}",
)
#: Words that hint at a reference which none of those covers.
LOOSE = r"(?i)\b(?:Cass\.?|Cassazione|Corte\s+cost\.?|Consiglio\s+di\s+Stato|Tribunale|T\.?\s*A\.?\s*R\.?|sentenza|ordinanza|decreto)\b"


def settled(text: Column) -> Column:
    """No model call is needed: a link, identifier or European court was found (each is complete in itself) and no hint stands outside them. JVM-side."""
    found, rest = F.lit(False), text
    for pattern in COVERED:
        found = found | text.rlike(pattern)
        rest = F.regexp_replace(rest, pattern, " ")
    return F.coalesce(found & ~rest.rlike(LOOSE), F.lit(False))


def fast_path(texts: DataFrame) -> DataFrame:
    """(id, settled) for (id, text)."""
    return texts.select(F.col("id").cast("long").alias("id"), settled(F.col("text")).alias("settled"))


# ---- validation of proposed references ------------------------------------------------------

#: Typographic characters that a proposal may have plain.
PLAIN_FORMS = ("‘’“”–—\u00a0", "''\"\"-- ")
#: What became of a proposed text, in the order the steps are tried.
LADDER = ("raw_text_missing", "raw_text_exact", "raw_text_normalized_match", "raw_text_ambiguous_in_source", "raw_text_identifier_not_in_source", "raw_text_recovered_by_unique_identifier", "raw_text_not_verbatim")


def plain_form(text: Column) -> Column:
    """Typographic characters plain, white space collapsed."""
    return F.trim(F.regexp_replace(F.translate(text, *PLAIN_FORMS), r"(?U)\s+", " "))


def _occurrences(text: Column, part: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def ladder(items: DataFrame, parsed: DataFrame) -> DataFrame:
    """items with category and reason: where a proposed text (raw) stands in its source (source).

    Steps: verbatim; the same but for typography, once; the number and year it names, if the parser found them in one
    span of a compatible court. items: item (unique), id, source, raw, number, year, namespace; parsed: id, number, year,
    namespace, outside, start, end. A missing proposal, source or number gives its own reason; spans are looked up by
    (id, number, year), so a hot source is spread by its numbers.
    """
    named = F.regexp_extract("raw", r"(?i)(?:n\.|num\.|numero)\s*([0-9]+)\s*(?:/|\s+del\s+)\s*[0-9]{4}", 1), F.regexp_extract("raw", r"(?i)(?:n\.|num\.|numero)\s*[0-9]+\s*(?:/|\s+del\s+)\s*([0-9]{4})", 1)
    either = F.regexp_extract("raw", r"([0-9]+)\s*/\s*[0-9]{4}", 1), F.regexp_extract("raw", r"[0-9]+\s*/\s*([0-9]{4})", 1)
    want = items.withColumns({
        "number": F.coalesce(ecli.number(F.col("number")), ecli.number(ecli.nonempty(named[0])), ecli.number(ecli.nonempty(either[0]))), "year": F.coalesce(ecli.year(F.col("year")), ecli.year(ecli.nonempty(named[1])), ecli.year(ecli.nonempty(either[1]))),
        "raw": ecli.nonempty(ecli.strip(F.col("raw"))), "namespace": F.upper(ecli.strip(F.col("namespace"))),
    })
    p = parsed.select(F.col("id").alias("p_id"), F.col("number").alias("p_number"), F.col("year").alias("p_year"), F.upper("namespace").alias("p_namespace"), F.coalesce("outside", F.lit(False)).alias("p_outside"), F.struct("start", "end").alias("span"))
    fits = F.col("namespace").isNull() | F.when(F.col("namespace").isin(*ecli.OUTSIDE_NAMESPACES), F.col("p_outside")).otherwise(F.coalesce("p_namespace", F.lit("")) == F.col("namespace"))
    keys = want.select("item", "id", "number", "year", "namespace").where("number IS NOT NULL AND year IS NOT NULL")
    spans = keys.join(p, (F.col("id") == F.col("p_id")) & (F.col("number") == F.col("p_number")) & (F.col("year") == F.col("p_year")) & fits).groupBy("item").agg(F.countDistinct("span").alias("spans"), F.min("span").alias("span"))
    joined = want.join(spans, "item", "left")
    flat, flat_raw = plain_form(F.col("source")), plain_form(F.col("raw"))
    in_source = F.expr("source RLIKE concat('(^|[^0-9])0*', number, '([^0-9]|$)') AND source RLIKE concat('(^|[^0-9])', year, '([^0-9]|$)')")
    places = _occurrences(F.col("flat"), F.col("flat_raw"))
    joined = joined.withColumns({"flat": F.coalesce(flat, F.lit("")), "flat_raw": flat_raw})
    category = (
        F.when(F.col("raw").isNull(), "raw_text_missing").when(F.contains("source", F.col("raw")), "raw_text_exact").when(places == 1, "raw_text_normalized_match").when(places > 1, "raw_text_ambiguous_in_source")
        .when(F.col("number").isNull() | F.col("year").isNull(), "raw_text_not_verbatim").when(~F.coalesce(in_source, F.lit(False)), "raw_text_identifier_not_in_source")
        .when(F.col("spans") == 1, "raw_text_recovered_by_unique_identifier").when(F.col("spans") > 1, "raw_text_ambiguous_in_source").otherwise("raw_text_not_verbatim")
    )
    reason = (
        F.when(F.col("category") == "raw_text_missing", "raw_text_missing").when(F.col("category").isin("raw_text_exact", "raw_text_normalized_match", "raw_text_recovered_by_unique_identifier"), None)
        .when((F.col("category") == "raw_text_ambiguous_in_source") & (places > 1), "multiple_typographic_matches").when(F.col("category") == "raw_text_ambiguous_in_source", "multiple_identifier_matches")
        .when(F.col("category") == "raw_text_identifier_not_in_source", "number_or_year_absent").when(F.col("number").isNull() | F.col("year").isNull(), "missing_number_or_year").otherwise("no_compatible_span")
    )
    out = joined.withColumn("category", category).withColumn("reason", reason)
    recovered_span = F.when(F.col("category") == "raw_text_recovered_by_unique_identifier", F.col("span"))
    return out.select(*[c for c in items.columns], "category", "reason", recovered_span["start"].alias("start"), recovered_span["end"].alias("end"))


def item_warnings(raw: Column, namespace: Column, identifier: Column, number: Column, year: Column, area: Column, category: Column) -> Column:
    """What is wrong with an accepted proposal, in fixed order: a field counts only if the text itself says so.

    A court of unknown name, an identifier that is not in the text or not well formed, a year or number that is none, an
    area that the text does not name, and no supported court at all.
    """
    space, own = F.upper(ecli.strip(namespace)), F.upper(ecli.strip(identifier))
    known = space.isin(*ecli.SUPPORTED_NAMESPACES, *ecli.OUTSIDE_NAMESPACES)
    inside = F.contains(F.upper(raw), own)
    formed = own.rlike(r"^ECLI:IT:[A-Z0-9]+:[0-9]{4}:[A-Z0-9.]+$")
    good = own.isNotNull() & inside & formed
    named = F.when(ecli.legal_area(area) == "CIV", raw.rlike(r"(?i)\bciv")).when(ecli.legal_area(area) == "PEN", raw.rlike(r"(?i)\bpen"))
    return F.array_compact(F.array(
        F.when(~category.isin("raw_text_exact"), F.concat(F.lit("raw_text_recovery="), category)),
        F.when(space.isNotNull() & ~known, F.concat(F.lit("invalid_jurisdiction_type="), space)),
        F.when(own.isNotNull() & ~inside, "explicit_ecli_not_in_raw_text").when(own.isNotNull() & ~formed, "invalid_explicit_ecli"),
        F.when(year.isNotNull() & ecli.year(year).isNull(), F.concat(F.lit("invalid_year="), year.cast("string"))),
        F.when(number.isNotNull() & ecli.number(number).isNull(), F.concat(F.lit("invalid_number="), number)),
        F.when(area.isNotNull() & ~F.coalesce(named, F.lit(False)), "legal_area_not_explicit"),
        F.when(~F.coalesce(good & ecli.namespace_of(own).isNotNull(), F.lit(False)) & ~F.coalesce(known, F.lit(False)), "missing_supported_namespace"),
    ))


def validation_counts(validated: DataFrame, *keys: str) -> DataFrame:
    """Accepted and discarded proposals with each category; validated has category."""
    accepted = F.col("category").isin("raw_text_exact", "raw_text_normalized_match", "raw_text_recovered_by_unique_identifier")
    return validated.groupBy(*keys).agg(
        F.count("*").alias("proposed"), F.count_if(accepted).alias("accepted"), F.count_if(~accepted).alias("discarded"),
        *[F.count_if(F.col("category") == c).alias(c) for c in LADDER],
        F.when(F.count_if(accepted) == 0, "all_discarded").alias("empty_result"),
    )


def fields_of(identifier: Column) -> dict[str, Column]:
    """Year, number and area that a canonical identifier spells out."""
    last = ecli.part(identifier, 4)
    return {"year": ecli.year(ecli.part(identifier, 3)), "number": ecli.nonempty(F.regexp_extract(last, "^0*([0-9]+)", 1)), "area": ecli.nonempty(F.regexp_extract(last, "(CIV|PEN)$", 1))}
