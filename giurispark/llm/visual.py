"""Text that looks the same but differs in its characters (problem 4).

One SQL statement does the work, run by DuckDB inside every Arrow batch: translate for
the forms with one plain character, replace for ligatures, regular expressions for
invisible characters, nfc_normalize for decomposed accents, and a word-wise translate
for letters of another script in a Latin word. The tables in the statement are generated
from Unicode properties. No row leaves its partition.

Cases: null values are dropped (nothing to compare); empty text is unchanged; composed
accents, typographic quotes and dashes, ordinals, superscripts, fractions, accents
written as apostrophes and whole words of another script stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from giurispark.llm.forms import LOOKALIKES, SOLO, compatible, invisible, spaces
from giurispark.session import spread


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _class(chars: str) -> str:
    """A regular-expression class of code-point ranges."""
    points, out = sorted(map(ord, chars)), []
    for p in points:
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in out)


@cache
def statement(source: str) -> str:
    """SQL over source(src, id, text): src, id, form, and whether the text had to change."""
    one = {c: p for c, p in compatible().items() if len(p) == 1}
    many = {c: p for c, p in compatible().items() if len(p) > 1}
    singles = one | {c: " " for c in spaces()}
    form = f"regexp_replace(text, '[{_class(invisible())}]', '', 'g')"
    form = f"translate({form}, {_quote(''.join(singles))}, {_quote(''.join(singles.values()))})"
    chain = "x"
    for c, p in many.items():
        chain = f"replace({chain}, {_quote(c)}, {_quote(p)})" if c in _LIGATURES else chain
    rest = {c: p for c, p in many.items() if c not in _LIGATURES}
    lookup = "MAP {" + ", ".join(f"{_quote(c)}: {_quote(p)}" for c, p in rest.items()) + "}"
    spelled = (
        f"CASE WHEN regexp_matches(y, '[{_class(''.join(rest))}]') "
        f"THEN array_to_string(list_transform(string_split(y, ''), lambda c: coalesce({lookup}[c], c)), '') ELSE y END"
    )
    alike, plain = "".join(LOOKALIKES), "".join(LOOKALIKES.values())
    latin = "[A-Za-z\\x{C0}-\\x{24F}]"
    worded = (
        f"CASE WHEN regexp_matches(z, '{latin}[\\p{{L}}]*[{_class(alike)}]|[{_class(alike)}][\\p{{L}}]*{latin}|(^|[^\\p{{L}}])[{_class(SOLO)}]{{1,2}}([^\\p{{L}}]|$)') "
        f"THEN array_to_string(list_transform(regexp_extract_all(z, '[\\p{{L}}]+|[^\\p{{L}}]+'), "
        f"lambda w: CASE WHEN regexp_matches(w, '[{_class(alike)}]') AND (regexp_matches(w, '{latin}') OR regexp_full_match(w, '[{_class(SOLO)}]{{1,2}}')) THEN translate(w, {_quote(alike)}, {_quote(plain)}) ELSE w END), '') ELSE z END"
    )
    return (
        f"SELECT src, id, form, form <> text AS changed FROM (SELECT src, id, text, nfc_normalize({worded}) AS form FROM ("
        f"SELECT src, id, text, nfc_normalize({spelled}) AS z FROM (SELECT src, id, text, {chain} AS y FROM ("
        f"SELECT src, id, text, {form} AS x FROM {source}))))"
    )


_LIGATURES = "ﬀﬁﬂﬃﬄﬅﬆĲĳ"
#: A text of ASCII alone cannot be a case and needs no SQL.
SUSPECT = r"(?=[^\x00-\x7F])[^\x00-\x7FàèéìòùÀÈÉÌÒÙäöüÄÖÜß’“”«»–—]"
OUT = T.StructType([T.StructField("src_table", T.StringType()), T.StructField("record_key", T.StringType()), T.StructField("form", T.StringType()), T.StructField("changed", T.BooleanType())])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
    sql = statement("batch")
    schema = pa.schema([("src_table", pa.string()), ("record_key", pa.string()), ("form", pa.string()), ("changed", pa.bool_())])
    for part in batches:
        batch = pa.Table.from_batches([part])
        con.register("batch", batch)
        got = con.sql(sql).to_arrow_table().rename_columns(schema.names).cast(schema)
        con.unregister("batch")
        yield from got.to_batches()


def consistent_forms(texts: DataFrame) -> DataFrame:
    """(src_table, record_key, form, changed) for rows (src_table, record_key, text).

    Only texts with a character outside the plain repertoire go through DuckDB; for all others the text is its own form.
    """
    rows = texts.where("text is not null").select(F.col("src_table").alias("src"), F.col("record_key").cast("string").alias("id"), "text")
    odd = F.col("text").rlike(SUSPECT)
    plain = rows.where(~odd).select(F.col("src").alias("src_table"), F.col("id").alias("record_key"), F.col("text").alias("form"), F.lit(False).alias("changed"))
    return spread(rows.where(odd)).mapInArrow(_batches, OUT).unionByName(plain)
