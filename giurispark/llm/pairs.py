"""Broken question and answer pairs (problem 6).

Each answer is judged against its question, in one pass over the joined pairs:

* a pushdown parser reads fences, brackets, quotations, list items and markup and keeps
  what is still open at the end;
* greedy string tiling covers the answer with the longest runs it shares with the
  question; an answer of tiles and labels alone only repeats the question;
* a grammar of refusals (who, in what mood, does not do what act of answering, or what
  lies outside its scope) sorts sentences into refusing, courteous and substantial ones;
* script and letter trigrams tell the language of what the tiles leave.

Whether a text breaks off inside a word or sentence needs counts over all texts and is
taken from the truncation operator. Defects exclude each other, first one first: empty,
refusal, copied, truncated, other_language.

Cases: a null answer is empty; an answer whose question is missing or null cannot be
copied or in another language; repeated rows are judged one by one; an empty table gives
no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from giurispark.functions.text import folded, unaccented
from giurispark.llm.forms import LOOKALIKES, compatible, invisible, spaces, words

DEFECTS = ("empty", "refusal", "copied", "truncated", "other_language")

# ---- structure -------------------------------------------------------------------------

_OPENERS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»"}
_CLOSERS = {v: k for k, v in _OPENERS.items()}
_TOKEN = re.compile(r"```|\*\*|</?[A-Za-z][\w-]*>|\\.|[()\[\]{}“”«»\"\n]|^[ \t]*(?:[-*•]|\d+[.)])(?=[ \t]|$)", re.M)
_VOID = {"br", "hr", "img"}


@dataclass
class Parsed:
    """What a text leaves open, innermost last."""

    stack: list[str] = field(default_factory=list)
    dangling: bool = False  # the last list item has no content


def parse(text: str) -> Parsed:
    """A pushdown pass. In JSON, strings hide brackets; in prose, a paragraph's end closes stray brackets and quotations."""
    out, at_item = Parsed(), -1
    strict = bool(re.match(r"\s*[{\[]\s*[\"\]}\[{]", text))
    for m in _TOKEN.finditer(text):
        t, stack = m.group(), out.stack
        if stack and stack[-1] == "```":
            if t == "```":
                stack.pop()
            continue
        if strict and stack and stack[-1] == '"':
            if t == '"':
                stack.pop()
            continue
        if t == "```":
            stack.append(t)
        elif t == "**":
            stack.pop() if stack and stack[-1] == t else stack.append(t)
        elif t == '"':
            if strict:
                stack.append(t)
        elif t == "\n":
            if not strict and text[m.end() : m.end() + 1] == "\n":
                while stack and stack[-1] in "([{“«**":
                    stack.pop()
        elif t[0] == "<":
            name = t.strip("</>").lower()
            if t[1] == "/":
                if f"<{name}>" in stack:
                    while stack.pop() != f"<{name}>":
                        pass
            elif name not in _VOID and f"</{name}>" in ("</p>", "</div>", "</ul>", "</ol>", "</li>", "</table>", "</b>", "</i>", "</em>", "</strong>"):
                stack.append(f"<{name}>")
        elif t in _OPENERS:
            stack.append(t)
        elif t in _CLOSERS:
            if stack and stack[-1] == _CLOSERS[t]:
                stack.pop()
        elif t[0] != "\\":
            at_item = m.end()
    out.dangling = at_item >= 0 and not text[at_item:].strip()
    return out


# ---- emptiness -------------------------------------------------------------------------

#: Words that say nothing when they stand alone.
LABELS = frozenset(
    "risposta risposte domanda quesito antwort frage answer response question query reponse respuesta pregunta null none nan nd na n d a tbd todo vuoto empty "
    "p div span br html body output testo text json assistant assistente".split()
)


def is_empty(text: str | None, tokens: list[str] | None = None) -> bool:
    if text is None:
        return True
    got = tokens if tokens is not None and "<" not in text and "```" not in text else words(re.sub(r"</?[A-Za-z][^<>]*>|```\w*", " ", text))
    return not got or (len(got) <= 4 and all(w in LABELS for w in got))


# ---- refusals --------------------------------------------------------------------------

#: The parts of a refusing sentence by language, in bare form (no case, no accents).
#: unable: mood that denies ability, leave or will; act: what an answerer would do; declines: verbs that refuse by themselves;
#: denied: plain denials of an act in the first person; outside: scope and rules.
GRAMMAR = {
    "it": {
        "unable": r"non (?:posso|possiamo|potrei|riesco a|sono in grado|siamo in grado|intendo|voglio|me la sento|mi e (?:possibile|consentit\w+|permess\w+|dato|lecito)|e (?:possibile|consentito|permesso|abilitat\w+)|sono (?:autorizzat|abilitat|programmat|qualificat)\w+|(?:mi )?(?:consente|permette) di)|impossibilitat\w+",
        "act": r"rispond\w+|rispost\w+|forni\w+|trattar\w+|trattabil\w+|esprim\w+|esprimer\w+|aiutar\w+|commentar\w+|offri\w+|dare|darle|darti|assister\w+|consigliar\w+|valutar\w+|pronunciar\w+|discuter\w+|affrontar\w+|formular\w+|procedere|soddisfar\w+|evader\w+|prestare|rilasciar\w+|entrare|suggerir\w+",
        "declines": r"(?:devo|debbo|dobbiamo|sono costrett\w+ a|mi vedo costrett\w+ a) (?:declinare|rifiutar\w+|astener\w+|rinunciare|evitare)|declino|rifiuto di|mi rifiuto|mi astengo|evito di|preferisco (?:non|lasciare|astenermi|evitare)|meglio (?:che se ne occup\w+|rivolger\w+|affidar\w+)",
        "denied": r"non (?:fornisco|rispondo|tratto|esprimo|commento|rilascio|offro|do|presto|mi pronuncio|mi esprimo|dispongo)",
        "outside": r"esula|non e (?:abilitat|autorizzat|programmat|configurat|predispost|in grado)\w*|viola (?:le|la|i|il|gli)|fuorviant\w+|al di fuori (?:delle|dei|di)|fuori (?:dalle|dal|dai) mie\w*|non (?:disponibil\w+|trattabil\w+)",
    },
    "en": {
        "unable": r"(?:i|we) (?:can ?not|can t|could not|couldn t|am unable|are unable|am not able|are not able|am not in a position|won t|will not|would not|do not wish|am not (?:allowed|permitted|authori[sz]ed|qualified))|unable",
        "act": r"answer\w*|help|assist|provide|respond|give|offer|comment|discuss|advise|address|comply|fulfil+|do that|do this|share|express|weigh",
        "declines": r"(?:i|we) (?:must|have to) (?:decline|refuse|refrain)|(?:i|we) (?:decline|refuse|prefer not|would rather not|d rather not)|not something i (?:can|am)",
        "denied": r"(?:i|we) (?:do not|don t) (?:provide|give|offer|answer|comment)",
        "outside": r"(?:outside|beyond) (?:of )?(?:what|the scope|my|our)|violates? (?:the|our|my)",
    },
    "de": {
        "unable": r"(?:kann|darf|mochte|werde|konnen|durfen|mochten) (?:ich|wir)? ?(?:\w+ ){0,4}?(?:kein\w*|nicht|leider)|(?:ich|wir) (?:kann|darf|mochte|werde|konnen|durfen) (?:\w+ ){0,4}?(?:kein\w*|nicht|leider)|bin (?:ich )?(?:leider )?nicht (?:in der lage|befugt|berechtigt|befahigt)|ist (?:es )?mir (?:leider )?nicht (?:moglich|gestattet|erlaubt)",
        "act": r"beantwort\w+|antwort\w+|auskunft|auskunfte|rechtsberatung|helfen|weiterhelfen|geben|erteilen|aussern|stellung|bieten|beraten|behandeln|kommentieren|einschatz\w+|entsprechen|leisten|unterstutz\w+",
        "declines": r"muss ich (?:\w+ )?ablehnen|lehne ich|ich lehne|ich ziehe es vor|mochte ich (?:\w+ )?verzichten",
        "denied": r"nicht beantworten|keine (?:auskunft|rechtsberatung)",
        "outside": r"ausserhalb (?:meiner|meines|des|der)|verstosst gegen",
    },
    "fr": {
        "unable": r"je ne (?:peux|puis|suis pas|saurais|veux|souhaite)|nous ne (?:pouvons|sommes pas)|il (?:ne m est pas|m est im)\s?possible|il ne m est pas permis|ne (?:me )?permet pas",
        "act": r"repond\w+|repon\w+|aider|fournir|donner|traiter|commenter|exprimer|offrir|prononcer|conseiller|discuter|aborder|emettre|en mesure|autorise\w*|habilite\w*|possible",
        "declines": r"je (?:dois|prefere) (?:decliner|refuser|m abstenir|ne pas)|je decline|je refuse|je m abstiens",
        "denied": r"je ne (?:donne|fournis|reponds|commente|traite)",
        "outside": r"hors de (?:ma|mon|mes)|en dehors de (?:ma|mon|mes)|viole (?:les|la|nos)",
    },
    "es": {
        "unable": r"no (?:puedo|podemos|podria|me es posible|es posible|estoy (?:autorizad|en condiciones|capacitad|habilitad)\w*|me esta permitido|me permite)",
        "act": r"respond\w+|ayudar\w*|ofrecer\w*|proporcionar\w*|tratar|comentar|dar\w*|expresar\w*|pronunciar\w*|aconsejar\w*|emitir|abordar|condiciones|autorizad\w+|permitido|posible|hacerlo",
        "declines": r"debo (?:declinar|rechazar|abstenerme)|prefiero (?:no|dejar)|me abstengo|declino|rechazo",
        "denied": r"no (?:proporciono|ofrezco|respondo|comento|trato|doy)",
        "outside": r"fuera de (?:mi|mis|lo que)|viola (?:las|la|los)",
    },
}
#: Words that may stand between a mood and its act.
GAP = 8


def refusing() -> str:
    """The grammar as one pattern: unable … act, or a sentence part that refuses by itself. Java reads it as well."""
    rules = []
    for part in GRAMMAR.values():
        rules.append(rf"(?:{part['unable']})(?: \w+){{0,{GAP}}}? (?:{part['act']})\b")
        rules.append(rf"(?:{part['act']})(?: \w+){{0,{GAP}}}? (?:{part['unable']})\b")
        rules += [rf"(?:{part[k]})\b" for k in ("declines", "denied", "outside")]
    return r"\b(?:" + "|".join(rules) + ")"


REFUSES = re.compile(refusing())
#: Turns that look like a refusal and are none.
AFFIRMS = re.compile(r"\bnon (?:posso|possiamo|puo|si puo) che\b|\bcan ?not but\b|\bne (?:peux|puis|peut) que\b|\bno (?:puedo|puede) sino\b")
#: Sentences that only surround a refusal.
COURTEOUS_WORDS = (
    r"\b(?:grazie|mi dispiace|spiacente|spiace|chiedo scusa|mi scuso|purtroppo|ho letto|comprendo|capisco|si consiglia|consiglio di|la invito|si rivolga|rivolgersi|consultare|se desidera|posso aiutare|in quanto|cordiali saluti|sono un|"
    r"sorry|thank|unfortunately|as an ai|please|consult|however|i understand|es tut mir leid|leider|danke|bitte|entschuldigung|als ki|wenden sie|desole|merci|malheureusement|veuillez|consultez|lo siento|gracias|por favor|lamento|consulte)\b"
)
COURTEOUS = re.compile(COURTEOUS_WORDS)
#: Words of a sentence that can refuse or be courteous, what is beyond them is substance; words of substance any refusal may have, and their share in a long one.
REFUSAL_SENTENCE, SUBSTANCE, SUBSTANCE_SHARE = 40, 6, 0.1


_SENTENCE_END = re.compile(r"[.!?\n]+(?=\s|$)")


def is_refusal(text: str, size: int | None = None) -> bool:
    """Some sentence refuses and little of substance stands beside; size: words of the text, where known. Sentences are read until there is too much substance."""
    size = len(words(text)) if size is None else size
    long = size > 80  # a short text may be one sentence
    allowed, refusing_, substance = max(SUBSTANCE, SUBSTANCE_SHARE * size) if long else SUBSTANCE, False, 0
    for part in _sentences(text):
        if not (w := words(part)):
            continue
        s = " ".join(w)
        declines = bool(REFUSES.search(s)) and not AFFIRMS.search(s)
        refusing_ |= declines
        substance += (max(0, len(w) - REFUSAL_SENTENCE) if long else 0) if declines or COURTEOUS.search(s) else len(w)
        if substance > allowed:
            return False
    return refusing_


def _sentences(text: str) -> Iterator[str]:
    at = 0
    for m in _SENTENCE_END.finditer(text):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


# ---- copies ----------------------------------------------------------------------------

#: Least length of a tile, in letters and digits.
TILE = 12
#: Words that may introduce or surround a repeated question.
FRAME = frozenset(
    "la il lo e seguente domanda quesito risposta risposte ecco testo riporto ripeto riformulo mi chiede chiedi si hai ha chiesto di del della alla cito citazione richiesta utente oggetto "
    "question answer the is following you asked user query prompt frage antwort die lautet wie folgt sie fragten reponse suivante votre est pregunta respuesta siguiente su es json q a r d".split()
)


def tiles(answer: str, question: str, least: int = TILE) -> list[tuple[int, int]]:
    """Greedy string tiling: disjoint stretches (start, end) of answer that stand in question, longest first.

    The question may serve again and again, since a copy may repeat it.
    """
    if len(question) < least or len(answer) < least:
        return []
    at: dict[str, list[int]] = {}
    for j in range(len(question) - least + 1):
        at.setdefault(question[j : j + least], []).append(j)
    runs, i = [], 0
    while i <= len(answer) - least:
        best = 0
        for j in at.get(answer[i : i + least], ()):
            n = least
            while i + n < len(answer) and j + n < len(question) and answer[i + n] == question[j + n]:
                n += 1
            best = max(best, n)
        if best:
            runs.append((best, i))
            i += max(1, best - least + 1)
        else:
            i += 1
    taken, out = bytearray(len(answer)), []
    for n, i in sorted(runs, key=lambda r: (-r[0], r[1])):
        a, b = i, i + n
        while a < b and taken[a]:
            a += 1
        while b > a and taken[b - 1]:
            b -= 1
        if b - a >= least or (b - a and out):
            if not any(taken[a:b]):
                taken[a:b] = b"\x01" * (b - a)
                out.append((a, b))
    return sorted(out)


def grams(text: str, least: int = TILE) -> np.ndarray:
    """Rolling hashes of all stretches of so many letters."""
    a = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    m = len(a) - least + 1
    out = np.zeros(max(0, m), np.uint64)
    for k in range(least if m > 0 else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + a[k : k + m]
    return out


def covered(text: str, known: np.ndarray, least: int = TILE) -> np.ndarray:
    """Marks of the letters that greedy tiles of a text cover; known: sorted grams of the other text. As that may serve again and again, the tiles cover what its grams cover."""
    own, edges = grams(text, least), np.zeros(len(text) + 1, np.int32)
    if len(known) and len(own):
        hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own)
        edges[hit] += 1
        edges[hit + least] -= 1
    return np.cumsum(edges[:-1]) > 0


def leftover(answer: list[str], known: np.ndarray) -> list[str]:
    """Words of the answer that tiles cover by less than half, in order."""
    if not answer:
        return []
    marks = covered("".join(answer), known)
    if not marks.any():
        return answer
    run = np.concatenate([[0], np.cumsum(marks)])
    ends = np.cumsum([len(w) for w in answer])
    starts = np.concatenate([[0], ends[:-1]])
    return [answer[i] for i in np.flatnonzero((run[ends] - run[starts]) * 2 < ends - starts)]


def is_copy(answer: list[str], question: list[str]) -> bool:
    if not question or len(answer) * 2 < len(question):
        return False
    known = set(question)
    if sum(w in known for w in answer) < 0.5 * len(answer):
        return False
    rest = leftover(answer, np.unique(grams("".join(question))))
    substance = [w for w in rest if w not in FRAME]
    return len(rest) <= 0.25 * len(answer) + 4 and len(substance) <= max(1, 0.03 * len(answer))


# ---- language --------------------------------------------------------------------------

#: Frequent function words by language, in bare form. They label the texts that language models are fitted on.
FUNCTION_WORDS = {
    "it": "il lo la gli le di del della dei delle che un una per con non e ha nel nella sono alla dal si al da in come se quale quando ne i ai dalla era stato anche questo cui",
    "de": "der die das und ist nicht dass ein eine einer einen des dem den mit von zu hat wird im auf fur sich als auch bei nach aus oder wenn wie uber es an",
    "en": "the of and to that is was in not for has had on with by an be are this which it as at from or but were have would",
    "fr": "le les des du que une pour avec ne pas est et dans sur au aux qui par elle sont cette ce ou sans soit avait ont",
    "es": "el los las del que por con no y para en su es lo como de pero fue son esta este sin segun habia ya",
}
_SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_WEIGHT = Counter(w for s in _SETS.values() for w in s)
LANGUAGES = tuple(FUNCTION_WORDS)
#: Letters a trigram tells apart: a blank, a to z, anything else.
_RADIX = 28
_CODES = np.full(256, _RADIX - 1, np.int64)
_CODES[ord(" ")] = 0
_CODES[ord("a") : ord("z") + 1] = np.arange(1, 27)
#: Evidence, in nats, that another language takes; and weight of the function words in a model that no text has taught.
EVIDENCE, TAUGHT_BY_WORDS = 12.0, 3


def trigrams(tokens: list[str]) -> np.ndarray:
    """Letter trigrams across blanks; digits stand for nothing."""
    text = " ".join(["", *[w for w in tokens if not w.isdigit()], ""])
    c = _CODES[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]
    return (c[:-2] * _RADIX + c[1:-1]) * _RADIX + c[2:] if len(c) > 2 else np.zeros(0, np.int64)


def model(labelled: list[tuple[str, list[str]]] = ()) -> np.ndarray:
    """Log probabilities (language, trigram) from (language, words), on top of the function words."""
    counts = np.full((len(LANGUAGES), _RADIX**3), 0.05)
    for i, name in enumerate(LANGUAGES):
        own = [w for w in FUNCTION_WORDS[name].split()]
        np.add.at(counts[i], trigrams(own), TAUGHT_BY_WORDS)
    for name, tokens in labelled:
        np.add.at(counts[LANGUAGES.index(name)], trigrams(tokens), 1)
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


#: A model for single calls.
PLAIN_MODEL = model()


_FAR = re.compile("[^\x00-\u024f]")


def script(text: str) -> str:
    """The script most letters belong to."""
    if text.isascii():
        return "LATIN"
    far = [c for c in _FAR.findall(text) if c.isalpha()]
    if not far or 2 * len(far) < sum(map(str.isalpha, text)):
        return "LATIN"
    return Counter(unicodedata.name(c, "?").split()[0] for c in far).most_common(1)[0][0]


def language(tokens: list[str]) -> tuple[str, float]:
    """(language, share of evidence); function words of several languages count less."""
    score = dict.fromkeys(_SETS, 0.0)
    for w, n in Counter(tokens).items():
        if w in _WEIGHT:
            for k, s in _SETS.items():
                if w in s:
                    score[k] += n / _WEIGHT[w]
    best, total = max(score, key=score.get), sum(score.values())
    return (best, score[best] / total) if total >= 3 else ("", 0.0)


#: Rows and letters of each that teach the language model: a bounded sample of questions and of answers, the least digests.
SAMPLE_ROWS, SAMPLE_LETTERS = 2000, 4000


def taught(texts: DataFrame) -> np.ndarray:
    """The model fitted on at most SAMPLE_ROWS different texts (column text), labelled by function words where these leave no doubt."""
    hashed = texts.where("text IS NOT NULL").select(F.substring("text", 1, SAMPLE_LETTERS).alias("text"), F.xxhash64("text").alias("h"))
    edge = hashed.select("h").distinct().orderBy("h").limit(SAMPLE_ROWS).agg(F.max("h")).first()[0]  # digests alone are shuffled
    if edge is None:
        return model()
    rows = hashed.where(F.col("h") <= edge).groupBy("h").agg(F.first("text").alias("text")).orderBy("h")
    labelled = []
    for row in rows.collect():  # bounded by the two numbers above
        tokens = words(row.text)
        name, sure = language(tokens)
        if sure >= 0.7 and len(tokens) >= 8:
            labelled.append((name, tokens))
    return model(labelled)


@dataclass
class Asked:
    """A question as its answers need it."""

    words: list[str]
    script: str
    grams: np.ndarray
    trigrams: np.ndarray


@lru_cache(maxsize=4096)
def asked(text: str) -> Asked:
    own = words(text)
    return Asked(own, script(text), np.unique(grams("".join(own))), trigrams(own))


def other_language(answer: list[str], question: Asked, known: np.ndarray) -> bool:
    """The answer proper, without what it restates of the question, is in another language or script than the question."""
    if len(question.words) < 4 or len(answer) < 6:
        return False
    rest = leftover(answer, question.grams)
    if len(rest) < 6:
        return False
    if (a := script(" ".join(rest))) and question.script and a != question.script:
        return True
    if a != "LATIN":
        return False
    ours, theirs = np.take(known, trigrams(rest), axis=1).sum(axis=1), np.take(known, question.trigrams, axis=1).sum(axis=1)
    own = int(theirs.argmax())
    second = np.partition(theirs, -2)[-2]
    return bool(ours.argmax() != own and ours.max() - ours[own] >= EVIDENCE and theirs[own] - second >= EVIDENCE / 2)


def judge(text: str | None, question_text: str | None, known: np.ndarray = PLAIN_MODEL) -> str | None:
    """The defect of an answer as far as it shows in the pair itself; 'open' for a structure left open."""
    answer = words(text or "")
    if is_empty(text, answer):
        return "empty"
    if is_refusal(text, len(answer)):
        return "refusal"
    question = asked(question_text or "")
    if is_copy(answer, question.words):
        return "copied"
    parsed = parse(text)
    if parsed.stack or parsed.dangling:
        return "open"
    return "other_language" if other_language(answer, question, known) else None


OUT = T.StructType([T.StructField("id", T.LongType()), T.StructField("grp", T.StringType()), T.StructField("defect", T.StringType())])
_ARROW = pa.schema([("id", pa.int64()), ("grp", pa.string()), ("defect", pa.string())])


def _batches(known: np.ndarray):
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            defects = [judge(a, q, known) for a, q in zip(batch["answer"].to_pylist(), batch["question"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["id"].cast(pa.int64()), batch["grp"].cast(pa.string()), pa.array(defects, pa.string())], schema=_ARROW)

    return batches


def judged(answers: DataFrame, questions: DataFrame, known: np.ndarray = PLAIN_MODEL) -> DataFrame:
    """(id, grp, defect) of every pair, without what needs counts over all texts.

    answers: id, grp, task, answer, in partitions enough for the work; questions: task, question (one row for each task).
    """
    pairs = answers.join(questions, "task", "left").select("id", "grp", "answer", "question")
    return pairs.mapInArrow(_batches(known), OUT).select("id", "grp", "defect")


def broken(answers: DataFrame, questions: DataFrame, cuts: DataFrame) -> DataFrame:
    """(id, grp, defect) of the defective pairs; cuts: (id) of the answers that the truncation operator holds for unfinished."""
    cut = cuts.select("id", F.lit(True).alias("cut"))
    final = F.when(F.col("defect").isin("empty", "refusal", "copied"), F.col("defect")).when(F.col("cut") | (F.col("defect") == "open"), "truncated").otherwise(F.col("defect"))
    known = taught(answers.select(F.col("answer").alias("text")).unionByName(questions.select(F.col("question").alias("text"))))
    return judged(answers, questions, known).join(cut, "id", "left").select("id", "grp", final.alias("defect")).where("defect is not null")


def alike(text: Column) -> Column:
    """One letter for all that look like it, blanks for all spaces, nothing for what is invisible; for comparison only."""
    table = {c: p for c, p in compatible().items() if len(p) == 1} | {c: " " for c in spaces()} | LOOKALIKES
    for c, p in compatible().items():
        if 0xFB00 <= ord(c) <= 0xFB06:
            text = F.replace(text, F.lit(c), F.lit(p))
    return F.translate(text, "".join(table) + invisible(), "".join(table.values()))


def unfinished(cuts: DataFrame, answers: DataFrame, questions: DataFrame) -> DataFrame:
    """The cuts that are no other defect, in expressions alone: only these few answers meet their questions.

    What is empty, only refuses or only repeats its question (word pairs of the question and framing words) is taken out.
    """
    few = answers.join(cuts.select("id"), "id").join(questions, "task", "left").select("id", "answer", F.coalesce("question", F.lit("")).alias("question"))
    runs = lambda c: F.regexp_extract_all(folded(unaccented(alike(c))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    bare_words = lambda c: runs(F.coalesce(F.regexp_replace(c, r"</?[A-Za-z][^<>]*>|```\w*", " "), F.lit("")))
    once = lambda df, **new: df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in new.items()]))))  # noqa: E731  # computed once, however often it is named
    told = once(few, a=bare_words("answer"), q=bare_words("question"), said=F.transform(F.split(F.coalesce("answer", F.lit("")), r"[.!?\n]+(?=\s|$)"), lambda p: F.array_join(runs(p), " ")))
    pairs = lambda w: F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda x, y: F.when(y.isNotNull(), F.concat_ws(" ", x, y)))
    told = once(told, n=F.size("a"), joined=F.array_join("q", ""), qp=F.array_compact(pairs(F.col("q"))), ap=F.array_compact(pairs(F.col("a"))), frame=F.array(*[F.lit(w) for w in sorted(FRAME)]), labels=F.array(*[F.lit(w) for w in sorted(LABELS)]))
    empty = (F.col("n") <= 4) & F.forall("a", lambda w: F.array_contains("labels", w))
    strange = F.size(F.array_except(F.array_except("ap", "qp"), F.array_compact(pairs(F.array_union("frame", "labels"))))) - 2 * F.size(F.array_intersect("frame", "a"))
    copied = (F.size("q") > 0) & (2 * F.col("n") >= F.size("q")) & (strange <= F.greatest(F.lit(4), 0.15 * F.col("n"))) & (F.size(F.filter(F.array_except("a", "frame"), lambda w: ~F.contains("joined", w))) <= F.greatest(F.lit(1), 0.03 * F.col("n")))
    declines = lambda s: s.rlike(refusing()) & ~s.rlike(AFFIRMS.pattern)
    rest = F.aggregate(F.filter("said", lambda s: (s != "") & ~declines(s) & ~s.rlike(COURTEOUS_WORDS)), F.lit(0), lambda n, s: n + F.size(F.split(s, " ")))
    refusal = F.exists("said", declines) & (rest <= F.greatest(F.lit(float(SUBSTANCE)), F.when(F.col("n") > 80, SUBSTANCE_SHARE * F.col("n")).otherwise(0.0)))
    return cuts.join(told.where(empty | copied | refusal).select("id"), "id", "left_anti")
