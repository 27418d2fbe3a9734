"""Text garbled by a wrong character decoding (problem 9).

Multi-byte damage: the characters of a text are mapped back to the bytes of a legacy
code page, a byte automaton finds the maximal well-formed multi-byte UTF-8 spans among
them, and only those spans are decoded. This repeats until nothing changes, so text that
was damaged twice is restored too.

Single-byte damage leaves no byte structure. Characters are mapped back to the bytes of
the code page they were read in and forward through the one they were written in; a
character counts only where the reading is impossible as it stands (a foreign letter or
sign within a Latin word, a capital with accent after a small letter, a lone accented
capital or foreign letter for "e'" and the like, an opening quote's stand-in at a word's
start) and the pair of code pages that explains most spots of the text is taken.

Remaining evidence that cannot be restored: U+FFFD and C1 control characters.

Cases: null and empty texts are no cases; whole words in Greek or Cyrillic, single rare
letters and signs (section, plus-minus, fractions, Nordic or Portuguese names) stay.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from giurispark.session import spread

#: Code pages in which UTF-8 bytes may have been read.
MULTI = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "iso8859_2", "cp1250", "koi8_r", "iso8859_5", "iso8859_15")
#: Pairs (written in, read in) of single-byte code pages.
WRITTEN, READ = ("cp1252", "mac_roman", "cp850"), ("mac_roman", "cp850", "cp437", "cp1251", "iso8859_5", "koi8_r", "mac_cyrillic", "cp1250", "cp1253", "iso8859_7", "latin_1", "cp1252")
#: Letters and signs a restored text may hold.
LETTERS = "àáâäãåæçèéêëìíîïñòóôöõøùúûüýßœÀÁÂÄÃÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÖÕØÙÚÛÜÝŒÿŸşžŽšŠłŁ"
SIGNS = "’‘“”„‚«»–—…€£§°©®™•·ªº¹²³¼½¾±×÷¿¡´¨¸¶µ †‡‰‹›"


def _to_bytes(codec: str) -> dict[str, int]:
    """Characters of a code page with a high byte; bytes it leaves open stand for themselves, as lenient readers have it."""
    table = {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
        if codec in ("cp1252", "iso8859_15") and b < 160:
            table.setdefault(chr(b), b)
    return table


TABLES = {codec: _to_bytes(codec) for codec in MULTI}
UTF8 = re.compile(rb"(?:[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2})+")
RUNS = {codec: re.compile("[" + "".join(map(re.escape, table)) + "]{2,}") for codec, table in TABLES.items()}
#: What a decoded span may hold: these, or an intermediate stage of a text damaged twice (any character of the Western code page).
GOOD = set(LETTERS + SIGNS) | set(TABLES["cp1252"]) | {chr(b) for b in range(0x80, 0x100)}
#: Signs and capitals that open a well-formed sequence of each code page, for a quick refusal.
LEADS = {codec: re.compile("[" + "".join(re.escape(c) for c, b in t.items() if 0xC2 <= b <= 0xF4) + "]") for codec, t in TABLES.items()}


def _decode_runs(text: str, codec: str) -> tuple[str, int]:
    table, spans = TABLES[codec], 0

    def fix(match: re.Match) -> str:
        nonlocal spans
        raw, out, at = match.group(), [], 0
        data = bytes(table[c] for c in raw)  # one byte for each character, so offsets agree
        for span in UTF8.finditer(data):
            got = span.group().decode("utf-8")
            if all(c in GOOD for c in got):
                out += [raw[at : span.start()], got]
                at, spans = span.end(), spans + 1
        return "".join(out) + raw[at:]

    return RUNS[codec].sub(fix, text), spans


#: Characters that undamaged texts hold often; the rest weighs against a reading.
USUAL = set("àáâäçèéêëìíîïñòóôöùúûüßœÀÁÄÈÉÌÒÓÖÙÚÜÑ’“”«»–—…€°§")
_HIGH = re.compile("[^\x00-\x7f]")


def _odd(text: str) -> int:
    return sum(c not in USUAL for c in _HIGH.findall(text))


def decode_spans(text: str) -> tuple[str, int]:
    """Decode maximal well-formed spans until none is left, each time in the code page that leaves the fewest odd characters."""
    total = 0
    while True:  # every round makes the text shorter
        tries = [(_odd(got), -spans, rank, got) for rank, codec in enumerate(MULTI) if LEADS[codec].search(text) for got, spans in [_decode_runs(text, codec)] if spans]
        if not tries or (best := min(tries))[0] > _odd(text):
            break
        text, total = best[3], total - best[1]
    # a no-break space that was made a plain one after the damage
    text, n = re.subn(r"(?<=[a-zß-ÿ])Ã (?= |$|[.,;:])|(?<= )Ã (?= )", "à", text)
    text, m = re.subn(r"(?<=[\w.,;:!?»])Â (?=[\s\w«(])", " ", text)
    return text, total + n + m


#: Letters by how much a reading that yields them counts.
WEIGHT = {c: 1.0 for c in "àèéìòùÀÈÉÌÒÙ’“”äöüÄÖÜßáíóúñç€ê"} | {c: 0.6 for c in "âîôûëïæœÁÓÚÍÑÇÊ«»–—…‘°"}


def _pairs() -> dict[tuple[str, str], dict[str, str]]:
    out, want = {}, set(WEIGHT)
    for written in WRITTEN:
        for read in READ:
            if written == read:
                continue
            table = {}
            for b in range(128, 256):
                try:
                    a = bytes([b]).decode(written)
                except UnicodeDecodeError:
                    continue
                try:
                    c = bytes([b]).decode(read)
                except UnicodeDecodeError:
                    continue
                if a != c and a in want:
                    table[c] = a
            out[written, read] = table
    return out


PAIRS = _pairs()
LATIN = "A-Za-zÀ-ÖØ-öø-ÿœŒšŠžŽŸ"
_COMMON = "àáâäçèéêëìíîïñòóôöùúûüßœÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜæ"
#: Characters that no Latin word of these languages holds.
FOREIGN = "".join(sorted({c for t in PAIRS.values() for c in t if c not in _COMMON and not unicodedata.name(c, "").startswith("LATIN ") and c not in "«»“”‘’–—…„‚€£§©®°ªº¹²³¼½¾±¿¡·µ " and not 0x80 <= ord(c) < 0xA0 and c not in "ÃåøØÅÆãõÕþÞðÐýÝÿ "}))
_F = re.escape(FOREIGN)
#: Where a character cannot stand as read. Group 1 holds it.
SPOTS = [
    re.compile(rf"(?<=[{LATIN}])([{_F}])"),
    re.compile(rf"([{_F}])(?=[{LATIN}])"),
    re.compile(r"(?<=[A-Z])([Æ])(?=[a-zà-ÿ])"),
    re.compile(r"(?<=[a-zß-ÿ])([ﬁﬂ])(?=[a-zß-ÿ])"),
    re.compile(r"(?<=[a-zß-öø-ÿ])([À-ÖØ-Þ])(?![A-ZÀ-Þ]{2})"),
    re.compile(r"(?<=[a-z])([ýþðõ÷ý])"),
    re.compile(r"(?<![\w’'«“(-])([Ͱ-ӿËÞÚÌ╚Ωъ])(?= [a-zà-ÿ])"),
    re.compile(r"(?<=\. )([Ͱ-ӿ╚Þ])(?= [a-z])"),
    re.compile(r"^([Ͱ-ӿ╚])(?= [a-z])", re.M),
    re.compile(r"(?<![\w])([ÄÇЂА])(?= \d)"),
    re.compile(r"([\x80-\x9f])"),
    re.compile(r"(?:\b|(?<=\s))(?:[Ll]|[Dd]|[dDnNsS]e?ll|[aA]ll|[dDsS][aeu]ll|[Uu]n)([í])(?=[aeiouhàèéìòù][a-zàèéìòù])"),
    re.compile(r"(?<![\wÀ-ÿ'’])([ìô])(?=[a-zA-Z]{2})"),
    re.compile(r"(?<=[a-zà-ÿ]{2})([îö])(?![\wÀ-ÿ])"),
]
#: A gate in the JVM: only texts with one of these go to Python. It is wider than the rules above.
SUSPECT = (  # every rule is anchored on a character beyond ASCII, so plain letters are passed over at once
    r"(?=[^\x00-\x7F])(?:[^\x00-\x7FàáâäçèéêëìíîïñòóôöùúûüßœÀÁÄÈÉÌÒÓÖÙÚÜÑ«»“”‘’–—…€§°\x{00A0}]|â(?=€)|(?<=[a-zà-ÿ])[À-ÖØ-Þ]|[ÀÁÄÈÉÌÒÓÖÙÚÜ](?= \d)|(?<![A-ZÀ-Þa-zà-ÿ])[ÚÌ](?= [a-z])"
    r"|(?<=[ldLDnN])í(?=[aeiouàèéìòùh])|(?<![A-Za-zÀ-ÿ])[ìô](?=[A-Za-z]{2})|(?<=[a-z]{2})[îö](?![A-Za-zÀ-ÿ]))"
)
_ITALIAN_OR_MAC = re.compile(r"\b(?:il|che|della|non|per|una)\b")
_SPANISH = re.compile(r"\b(?:el|los|las|que la|había|según)\b")


def unswap(text: str) -> tuple[str, int, str]:
    """(text, changed spots, code pages) for single-byte damage."""
    spots = sorted({m.start(1) for rule in SPOTS for m in rule.finditer(text)})
    if not spots:
        return text, 0, ""
    _, table = max(((sum(WEIGHT[t[text[i]]] for i in spots if text[i] in t), -rank), name) for rank, (name, t) in enumerate(PAIRS.items()))
    mapping = PAIRS[table]
    weak = lambda i: text[i] in "íìôîö"  # noqa: E731  # common letters: only in company of sure spots, or in quotes and elisions that pair up
    sure = [i for i in spots if text[i] in mapping and not weak(i)]
    soft = [i for i in spots if text[i] in mapping and weak(i)]
    if not sure:
        elided = sum(text[i] == "í" for i in soft)
        opens, closes = sum(text[i] in "ìô" for i in soft), sum(text[i] in "îö" for i in soft)
        if not (elided and _ITALIAN_OR_MAC.search(text) and not _SPANISH.search(text)) and not (opens and closes):
            return text, 0, ""
        if not elided:
            soft = [i for i in soft if text[i] in "ìôîö"]
    chars, certain = list(text), {text[i] for i in sure if not text[i].islower() or text[i] in FOREIGN}
    changed = {*sure, *soft, *(i for i, c in enumerate(text) if c in certain)}
    if sure:  # the rest of a damaged word, and lone stand-ins for a letter
        for m in re.finditer(r"\S+", text):
            at = range(*m.span())
            lone = len(at) == 1 and not text[at[0]].islower()
            if lone or any(i in changed for i in at) and re.search("[A-Za-z]", m.group()):
                changed |= {i for i in at if text[i] in mapping and (lone or text[i] in FOREIGN)}
            elif len(at) == 1 and text[at[0]] in FOREIGN and text[at[0]] in mapping:
                changed.add(at[0])
    for i in changed:
        chars[i] = mapping[text[i]]
    return "".join(chars), len(changed), "/".join(table)


def repair(text: str) -> tuple[str, int, int, int]:
    """(restored text, decoded spans, exchanged characters, characters that cannot be restored)."""
    text, spans = decode_spans(text)
    text, swaps, _ = unswap(text)
    return text, spans, swaps, len(re.findall("[�\x80-\x9f]", text))


OUT = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("restored", T.StringType()), T.StructField("spans", T.IntegerType()),
    T.StructField("swaps", T.IntegerType()), T.StructField("lost", T.IntegerType()),
])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("restored", pa.string()), ("spans", pa.int32()), ("swaps", pa.int32()), ("lost", pa.int32())])
    for batch in batches:
        rows = []
        for key, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
            fixed, spans, swaps, lost = repair(text)
            if spans or swaps or lost:
                rows.append((key, fixed, spans, swaps, lost))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * 5, schema)], schema=schema)


def garbled(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Affected rows only: (id, restored, spans, swaps, lost). One pass, no shuffle on large inputs."""
    rows = texts.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("text").rlike(SUSPECT))
    return spread(rows).mapInArrow(_batches, OUT)
