"""Text normalisation, keys, formats and tolerant parsing, as JVM-side expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from giurispark.functions.ecli import let, nonempty, strip

#: The seven areas and the spellings that stand for them (keys as area_key gives them).
AREAS = {
    "diritto_civile": "civile_generale responsabilita_civile proprieta_successioni proprieta_e_successioni famiglia successioni condominio immobiliare contratti credito "
    "danno_risarcimento sinistri_stradali assicurazioni_private bancario privacy sanitario civile_contrattuale privacy_e_procedura_civile privacy_procedura_civile",
    "diritto_tributario": "tributario",
    "diritto_commerciale": "societario commerciale fallimentare concorsuale crisi_d_impresa crisi_di_impresa crisi_impresa",
    "diritto_penale": "penale penale_colposo penale_cautelare",
    "diritto_lavoro": "lavoro diritto_del_lavoro previdenza previdenziale diritto_previdenziale",
    "diritto_amministrativo": "amministrativo immigrazione",
    "diritto_processuale": "processuale procedura_civile processuale_civile diritto_processuale_civile procedura_penale processuale_penale diritto_processuale_penale "
    "procedura_amministrativa processuale_amministrativo diritto_processuale_amministrativo procedura_tributaria processuale_tributario diritto_processuale_tributario",
}
ALIASES = {key: area for area, keys in AREAS.items() for key in [area, *keys.split()]}


@cache
def _accents() -> tuple[str, str]:
    """Letters below U+0250 and Latin extensions with the plain letter they decompose to; by decomposition, not by list."""
    pairs = [(chr(p), unicodedata.normalize("NFKD", chr(p))) for p in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(c, "".join(x for x in d if not unicodedata.combining(x))) for c, d in pairs if d != c]
    return "".join(c for c, d in pairs if len(d) == 1), "".join(d for _, d in pairs if len(d) == 1)


def unaccented(text: Column) -> Column:
    """Without accents, composed or not."""
    return F.regexp_replace(F.translate(text, *_accents()), r"\p{M}", "")


def folded(text: Column) -> Column:
    """Case-folded: lower case, sharp s as ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def collapsed(text: Column) -> Column:
    """White space of every kind collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def area_key(text: Column) -> Column:
    key = F.replace(folded(unaccented(F.coalesce(strip(text), F.lit("")))), F.lit("&"), F.lit(" e "))
    return F.regexp_replace(F.regexp_replace(key, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def area(text: Column, strict: bool = False) -> Column:
    """Canonical area; an unknown value gives its key, or an error where strict."""
    known = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])

    def of(key: Column) -> Column:
        return F.coalesce(
            F.when(F.contains(key, F.lit("privacy")) & F.contains(key, F.lit("procedura_civile")), "diritto_civile"), known[key],
            F.when(key.rlike("^(penale_|diritto_penale_)|_penale$"), "diritto_penale"), F.raise_error(F.concat(F.lit("unknown area: "), key)) if strict else key,
        )

    return let(area_key(text), of)


def cassation_area(legal_area: Column, division: Column) -> Column:
    """Area of a Cassation ruling by its legal area and division; null for the seventh division and unknown pairs."""
    kind, div = F.upper(F.trim(F.coalesce(legal_area, F.lit("")))), F.trim(F.coalesce(division, F.lit("")))
    return (
        F.when(div == "Sez. 7", None)
        .when((kind == "PEN") & div.isin(*[f"Sez. {x}" for x in "123456U"]), "diritto_penale")
        .when((kind == "CIV") & div.isin(*[f"Sez. {x}" for x in "123U"]), "diritto_civile")
        .when((kind == "CIV") & (div == "Sez. 5"), "diritto_tributario")
        .when((kind == "CIV") & (div == "Sez. L"), "diritto_lavoro")
    )


def ascii_words(text: Column) -> Column:
    """Upper-case ASCII words, one blank apart."""
    plain = F.regexp_replace(F.translate(unaccented(text), "’‘`", "'''"), r"[^\x00-\x7F]", "")
    return F.upper(F.trim(F.regexp_replace(plain, "[^A-Za-z0-9]+", " ")))


def question_key(text: Column) -> Column:
    """Questions compare without case and spacing."""
    return folded(collapsed(text))


#: Typographic characters and their plain forms.
TYPOGRAPHIC = {"’": "'", "‘": "'", "‛": "'", "ʼ": "'", "`": "'", "´": "'", "“": '"', "”": '"', "„": '"', "«": '"', "»": '"', "–": "-", "—": "-", " ": " "}


def sheet_key(text: Column) -> Column:
    """Question key for spreadsheet exports: typographic characters plain."""
    return question_key(F.translate(F.replace(text, F.lit("…"), F.lit("...")), "".join(TYPOGRAPHIC), "".join(TYPOGRAPHIC.values())))


def without_export_header(text: Column) -> Column:
    """An answer without the date line that an export put before it."""
    return strip(F.regexp_replace(text, r"^\s*\[?\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}[,\s]+\d{1,2}:\d{2}(:\d{2})?\]?\s*[-–]?\s*", ""))


def preview(text: Column, length: int = 180) -> Column:
    flat = collapsed(F.coalesce(text, F.lit("")))
    return F.when(F.length(flat) > length, F.concat(F.substring(flat, 1, length), F.lit("..."))).otherwise(flat)


def ecli_suffix(text: Column) -> Column:
    return F.regexp_extract(text, "(CIV|PEN)$", 1)


def slug(text: Column, lower: bool = False) -> Column:
    out = F.regexp_replace(F.translate(text, "/:", "--"), "[^A-Za-z0-9._-]+", "-")
    return F.lower(out) if lower else out


def path_parts(path: Column) -> tuple[Column, Column, Column]:
    """(family, model, timestamp) of a relative path .../[bullshit/]<model>/<timestamp>/file."""
    parts = F.split(path, "/")
    special = (F.size(parts) >= 4) & (F.get(parts, F.lit(0)) == "bullshit")
    model = F.when(special, F.get(parts, F.lit(1))).when(F.size(parts) >= 3, F.get(parts, F.lit(0))).otherwise(F.try_element_at(parts, F.lit(-3)))
    return F.when(special, "bullshit").otherwise("standard"), model, F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))


def run_id(model: Column, timestamp: Column) -> Column:
    return F.when(F.length(timestamp) > 0, F.concat_ws("/", model, timestamp)).otherwise(model)


def series_label(model: Column, timestamp: Column) -> Column:
    return F.when(F.length(timestamp) > 0, F.concat(model, F.lit(" · "), timestamp)).otherwise(model)


def area_of_task(task_id: Column) -> Column:
    """Canonical area from the prefix of a task id."""
    return area(F.when(F.contains(task_id, F.lit("/")), F.substring_index(task_id, "/", 1)).otherwise(F.lit("unknown")))


def task_kind(task_type: Column, task_id: Column) -> Column:
    special = (F.coalesce(task_type, F.lit("")) == "bullshit") | F.translate(F.coalesce(task_id, F.lit("")), "\\", "/").startswith("bullshit/")
    return F.when(special, "bullshit").otherwise(F.coalesce(nonempty(task_type), F.lit("standard")))


def tristate(value: Column) -> Column:
    """True, false, or null for anything else."""
    text = F.lower(strip(value.cast("string")))
    return F.when(text.isin("true", "1", "yes", "y"), True).when(text.isin("false", "0", "no", "n"), False)


def count_value(value: Column) -> Column:
    """An integer; 0 for null and for what is no number."""
    return F.coalesce(value.cast("string").try_cast("int"), F.lit(0))


def percent(value: Column, comma: bool = False) -> Column:
    """12.3%, or 12,3% and n.d. for null."""
    text = F.format_string("%.1f%%", value * 100)
    return F.when(value.isNull(), "n.d.").otherwise(F.translate(text, ".", ",")) if comma else F.when(value.isNotNull(), text)


def redacted(text: Column, limit: int = 240) -> Column:
    """One line without keys of services, cut to a limit."""
    flat = collapsed(text)
    return F.substring(F.regexp_replace(flat, r"(sk-ant-|sk_ant_|sk-|AIza)[A-Za-z0-9_-]+", "[redacted]"), 1, limit)


def word_count(text: Column) -> Column:
    flat = collapsed(text)
    return F.when(F.length(flat) == 0, 0).otherwise(F.size(F.split(flat, " ")))


def json_object(text: Column) -> Column:
    """The first JSON object in a reply, code fences aside; null where none parses."""
    bare = F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.when(F.try_parse_json(bare).isNotNull() & bare.rlike(r"(?s)^\s*\{"), bare), F.when(F.try_parse_json(inner).isNotNull(), nonempty(inner)))
