"""Answers that stop before they are finished (problem 1), in SQL only.

Texts are cut into words at blanks, with their marks; line ends are words of their own and
runs of digits one digit. Word trigrams are counted inside all different texts and at
their ends. The final trigram of each text is joined to those counts, and the counts decide:

* ``word``: its last word is seen more often as the start of longer words than as a word (once
  more, where words of its shape are what texts end with);
* ``structure``: a bracket, quotation, fence, markup, JSON object, list item or heading is left open
  of a kind that texts open and mostly close again (openings against those left open at ends);
* ``sentence``: in that place texts go on and almost never end. The share of ends is taken
  from the trigram, from its last two words, or from the last word, whichever is the first
  that chance alone would let end a text ``support`` times; each is smoothed by the shape of
  the last word (letters and digits as one each), for words that are rare or new. A share
  clearly under what chance would give (ends to words over all texts) is a cut. A place that chance
  alone would not let end a text, and that no other text ends at, tells nothing.

There are no lists of abbreviations, endings or closing lines: "Cass." is a cut and
"Cordiali saluti" is none because of how often texts go on after them. A text's own end
never counts for itself, and equal texts count once, so a table of repeated answers is
judged like one of different answers.

Cases: null, empty and blank texts are not cut; marks of a cut at the end (dots, "<cut>",
"[segue]") are taken off before; text with extra columns keeps only the id and the group;
ties do not arise; an empty table gives no rows; words of any length are compared whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from giurispark.session import cut, spread

#: White space, invisible characters and omission points that may follow the last word.
BLANK = "' \\n\\t\\r   ​‌‍  ⁠﻿­…'"
#: Marks of a cut: points, a single word in brackets (but not an omission mark), a lone tag.
MARK = r"""'(?U)(\\s|…|\\.\\.\\.|<\\p{L}+>|\\[\\s*(?!(?i)omissis)(\\p{L}+|…|\\.\\.\\.)\\s*\\]|\\(\\s*(continua|segue|…|\\.\\.\\.)\\s*\\))+$'"""
PLAIN = f"""
SELECT id, grp, s, xxhash64(s) AS h FROM (
  SELECT id, grp, CASE WHEN right(s, 3) = '...' OR right(s, 1) IN ('>', ']', ')') THEN rtrim({BLANK}, regexp_replace(s, {MARK}, '')) ELSE s END AS s
  FROM (SELECT id, grp, rtrim({BLANK}, text) AS s FROM texts WHERE text IS NOT NULL)) WHERE s <> ''
"""


def words(text: str, lead: int) -> str:
    """SQL array of the words of a text after so many empty ones."""
    form = f"translate(lower({text}), '123456789\\t\\r', '000000000  ')"
    for old, new in (("00000000", "0"), ("0000", "0"), ("00", "0"), ("00", "0"), ("\\n", " ¶ ")):
        form = f"replace({form}, '{old}', '{new}')"
    return f"concat(array_repeat('', {lead}), filter(split({form}, ' '), x -> x <> ''))"


NEWLINE = "\\n"


def _times(mark: str, text: str) -> str:
    return f"CAST((length({text}) - length(replace({text}, '{mark}', ''))) / length('{mark}') AS INT)"


#: Kinds of structure: how often a text opens one, and whether it is open at the end. Brackets, quotations and emphasis hold within a paragraph (p).
STRUCTURES = {
    "round": (_times("(", "p"), f"{_times('(', 'p')} > {_times(')', 'p')}"),
    "square": (_times("[", "p"), f"{_times('[', 'p')} > {_times(']', 'p')}"),
    "quote": (_times("“", "p"), f"{_times('“', 'p')} > {_times('”', 'p')} AND NOT contains(p, '„')"),
    "angle": (_times("«", "p"), f"{_times('«', 'p')} > {_times('»', 'p')}"),
    "bold": (_times("**", "p"), f"{_times('**', 'p')} % 2 = 1"),
    "paragraph": (_times("<p>", "p"), f"{_times('<p>', 'p')} > {_times('</p>', 'p')}"),
    "fence": (_times("```", "s"), f"{_times('```', 's')} % 2 = 1"),
    "object": ("CAST(head LIKE '{%' AS INT)", "head LIKE '{%' AND NOT rtrim(' `]', s) LIKE '%}'"),
    "item": (f"{_times(NEWLINE, 's')} + 1", "substring_index(s, '\\n', -1) RLIKE '^ *([-*•]|[0-9]+[.)])$'"),
    "heading": ("CAST((length(s) - length(replace(s, '\\n#', ''))) / 2 + CAST(s LIKE '#%' AS INT) AS INT)", "substring_index(s, '\\n', -1) LIKE '#%'"),
}
ENDS = f"""
SELECT id, grp, h, try_element_at(w, -3) AS a, try_element_at(w, -2) AS b, element_at(w, -1) AS c,
       {", ".join(f"{n} AS n_{k}, coalesce({o}, false) AS o_{k}" for k, (n, o) in STRUCTURES.items())}
FROM (SELECT *, {words("substring_index(s, ' ', -4)", 3)} AS w, substring_index(s, '\\n\\n', -1) AS p, ltrim(' \\n`[', CASE WHEN s LIKE '```json%' THEN substr(s, 8) ELSE s END) AS head FROM plain)
"""
#: Trigrams of different texts, without their last one.
INNER = f"""
SELECT t.`0` AS a, t.`1` AS b, t.`2` AS c, count(*) AS n FROM (
  SELECT explode(arrays_zip(slice(w, 1, size(w) - 3), slice(w, 2, size(w) - 3), slice(w, 3, size(w) - 3))) AS t
  FROM (SELECT {words("s", 2)} AS w FROM (SELECT DISTINCT s FROM plain)) WHERE size(w) > 3)
GROUP BY t.`0`, t.`1`, t.`2`
"""
#: Every trigram: how often inside, and how many different texts end with it.
GRAMS = f"""
SELECT a, b, c, sum(n) AS n, sum(e) AS e FROM (
  SELECT a, b, c, n, 0 AS e FROM ({INNER}) UNION ALL SELECT a, b, c, 0, 1 FROM (SELECT DISTINCT h, a, b, c FROM ends))
GROUP BY a, b, c
"""
#: Letters of a prefix that is a join key; longer ones meet by these and are then compared whole.
KEY = 64
LONGER = f"""
SELECT c, sum(n) AS longer FROM (
  SELECT f.c, v.n FROM (SELECT core, n, explode(sequence(1, least({KEY}, length(core)))) AS l FROM (SELECT regexp_replace(c, '[^\\\\p{{L}}\\\\p{{M}}\\\\p{{N}}]+$', '') AS core, n + e AS n FROM k1) WHERE core <> '') v
  JOIN (SELECT c, length(c) AS l FROM k1 WHERE e > 0) f ON least({KEY}, f.l) = v.l AND left(f.c, {KEY}) = left(v.core, v.l) AND length(v.core) > f.l AND startswith(v.core, f.c))
GROUP BY c
"""
SHAPE = f"left(regexp_replace(c, '[\\\\p{{L}}\\\\p{{M}}]+', 'a'), {KEY})"
#: Leave-one-out shares of ends, from the shape of the last word to the trigram; base is what chance gives.
def _share(n: str, e: str, below: str) -> str:
    """Smoothed share of ends (e, without the text's own) at a place seen n times inside; where both tell nothing, that of the level below."""
    return f"({e} + WEIGHT / base * {below}) / ({e} + if(({n} + {e}) * base >= SUPPORT OR {e} > 0, {n}, 0) + WEIGHT / base)"


EVIDENCE = f"""
SELECT a, b, c, n, e, coalesce(longer, 0) AS longer, coalesce(longer, 0) > n1 + e1 + CAST(rough > 2 * base AS INT) AS unfinished, {_share("n", "e", "rough")} / base AS lift
FROM (SELECT *, {_share("ns", "es", _share("n0", "e0", "base"))} AS rough,
             CASE WHEN (n3 + e3) * base >= SUPPORT THEN n3 WHEN (n2 + e2) * base >= SUPPORT THEN n2 ELSE n1 END AS n,
             CASE WHEN (n3 + e3) * base >= SUPPORT THEN e3 WHEN (n2 + e2) * base >= SUPPORT THEN e2 ELSE e1 END AS e
      FROM (SELECT g.a, g.b, g.c, g.n AS n3, g.e - 1 AS e3, k2.n AS n2, k2.e - 1 AS e2, k1.n AS n1, k1.e - 1 AS e1, ks.n AS ns, ks.e - 1 AS es, k0.n AS n0, k0.e - 1 AS e0, longer, base
            FROM grams g JOIN k2 ON g.b = k2.b AND g.c = k2.c JOIN (SELECT *, {SHAPE} AS shape FROM k1) k1 ON g.c = k1.c JOIN ks ON k1.shape = ks.shape JOIN k0 ON right(k1.shape, 2) = k0.shape
            LEFT JOIN longer l ON g.c = l.c CROSS JOIN (SELECT sum(e) / greatest(sum(n), 1) AS base FROM k0) WHERE g.e > 0))
"""
#: Which kinds of structure are a sign: fewer are left open, other texts considered, than half of what is opened. One row.
SIGNS = "SELECT " + ", ".join(f"count_if(o_{k}) - 1 <= 0.5 * (sum(n_{k}) - 1) AS s_{k}" for k in STRUCTURES) + " FROM (SELECT DISTINCT h, " + ", ".join(f"n_{k}, o_{k}" for k in STRUCTURES) + " FROM ends)"
DECIDE = f"""
SELECT id, grp, CASE WHEN {" OR ".join(f"o_{k} AND s_{k}" for k in STRUCTURES)} THEN 'structure' WHEN unfinished THEN 'word' WHEN lift < SHARE THEN 'sentence' END AS cut,
       round(lift, 6) AS lift, n AS n_inside, e AS n_end
FROM (SELECT e.id, e.grp, v.*, s.*, {", ".join(f"e.o_{k}" for k in STRUCTURES)}
      FROM ends e JOIN evidence v ON e.a = v.a AND e.b = v.b AND e.c = v.c CROSS JOIN signs s)
"""


def truncated(texts: DataFrame, key: str, text: str, group: str, support: float = 1.0, weight: float = 0.25, share: float = 0.8) -> DataFrame:
    """(id, grp, cut, lift, n_inside, n_end) of every text with something to judge; cut is null for finished ones.

    support: ends that chance would give a place before its own counts are used; weight: of the shape against those counts;
    share: of what chance gives, below which a place is never terminal.
    """
    spark, name = texts.sparkSession, uuid.uuid4().hex
    views = {k: f"{k}_{name}" for k in ("texts", "ends", "grams")}
    spread(texts.selectExpr(f"`{key}` AS id", f"`{group}` AS grp", f"CAST(`{text}` AS STRING) AS text")).createOrReplaceTempView(views["texts"])
    ask = lambda have, query, *more: spark.sql("WITH " + ", ".join([*[f"{k} AS (SELECT * FROM {views[k]})" for k in have], *more]) + query)
    try:  # plans are resolved here; the names are not needed any longer
        cut(ask(["texts"], ENDS, f"plain AS ({PLAIN})")).createOrReplaceTempView(views["ends"])  # read four times: small rows, written once
        cut(ask(["texts", "ends"], GRAMS, f"plain AS ({PLAIN})")).createOrReplaceTempView(views["grams"])
        evidence = EVIDENCE.replace("SUPPORT", str(float(support))).replace("WEIGHT", str(float(weight)))
        return ask(
            ["ends", "grams"], DECIDE.replace("SHARE", str(float(share))),
            "k2 AS (SELECT b, c, sum(n) AS n, sum(e) AS e FROM grams GROUP BY b, c HAVING sum(e) > 0)", "k1 AS (SELECT c, sum(n) AS n, sum(e) AS e FROM grams GROUP BY c)",
            f"ks AS (SELECT {SHAPE} AS shape, sum(n) AS n, sum(e) AS e FROM k1 GROUP BY {SHAPE})", "k0 AS (SELECT right(shape, 2) AS shape, sum(n) AS n, sum(e) AS e FROM ks GROUP BY right(shape, 2))",
            f"longer AS ({LONGER})", f"evidence AS ({evidence})", f"signs AS ({SIGNS})",
        )
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
