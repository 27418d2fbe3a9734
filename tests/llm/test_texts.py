"""Character forms, garbled text, truncation and broken pairs on small fixtures."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from giurispark.llm import forms, garble, pairs, truncation, visual

BASE = "Poiché la società ricorrente ha già chiarito che l’istituto però non può, così il fatto è «nullo»."


# ---- forms -----------------------------------------------------------------------------


@pytest.mark.parametrize("raw, want", [
    ("ａbc １２", "abc 12"), ("deﬁnito", "definito"), ("𝗍𝖾𝗌𝗍", "test"), ("perché", "perché"), ("a­b​c﻿", "abc"), ("a b　c d", "a b c d"),
    ("sоciеtà", "società"), ("Ѕ.p.А. е poi", "S.p.A. e poi"), ("договор λόγος", "договор λόγος"), ("è “così” – 1ª 2² ½ perche'", "è “così” – 1ª 2² ½ perche'"), ("", ""),
])
def test_consistent(raw, want):
    assert forms.consistent(raw) == want


def test_sql_equals_python_and_flags_changes(spark):
    raws = [r for r, _ in [("ａbc", 0), ("deﬁnito", 0), ("plain", 0), ("perché", 0), ("sоcietà", 0), ("x​y", 0), ("", 0), ("契約 договор", 0), ("a" * 200_000 + "ﬁ", 0)]]
    df = spark.createDataFrame([("t", str(i), r) for i, r in enumerate(raws)] + [("t", "n", None)], "src_table string, record_key string, text string")
    got = {r.record_key: r for r in visual.consistent_forms(df).collect()}
    assert set(got) == {str(i) for i in range(len(raws))}
    for i, raw in enumerate(raws):
        assert got[str(i)].form == forms.consistent(raw)
        assert got[str(i)].changed == (forms.consistent(raw) != raw)


def test_forms_of_empty_table(spark):
    assert visual.consistent_forms(spark.createDataFrame([], "src_table string, record_key string, text string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abàéＡﬁ​ о е́", max_size=30))
def test_consistent_is_idempotent(text):
    once = forms.consistent(text)
    assert forms.consistent(once) == once and once == unicodedata.normalize("NFC", once)


# ---- garbled text ------------------------------------------------------------------------


def read_as(text, codec):
    return "".join(bytes([b]).decode(codec, "replace") if bytes([b]).decode(codec, "replace") != "�" else chr(b) for b in text.encode())


@pytest.mark.parametrize("codec", ["cp1252", "latin_1", "mac_roman", "cp437", "cp850"])
def test_multibyte_round_trip(codec):
    fixed, spans, _, lost = garble.repair(read_as(BASE, codec))
    assert fixed == BASE and spans > 0 and lost == 0


def test_twice_damaged():
    assert garble.repair(read_as(read_as(BASE, "cp1252"), "cp1252"))[0] == BASE


@pytest.mark.parametrize("codec", ["mac_roman", "cp850", "cp437", "cp1251", "iso8859_5"])
def test_single_byte_round_trip(codec):
    text = "Poiché la società ha già chiarito che la nullità non può, così il fatto non è più previsto."
    fixed, _, swaps, _ = garble.repair(text.encode("cp1252").decode(codec))
    assert fixed == text and swaps > 0


@pytest.mark.parametrize("text", ["", "plain", BASE, "La lettera Ã compare. CONCEIÇÃO, «São Bento», Øya, Þórsgata, çà et là, £ 300, ± 2 mm, ¼, Œuvre®, § 3, Âge d’or", "la parola договор e λόγος", "Señor, había más: el año según.", "Straße, über Größe"])
def test_genuine_text_stays(text):
    assert garble.repair(text) == (text, 0, 0, 0)


def test_lost_characters_and_nulls(spark):
    df = spark.createDataFrame([(1, "societ� x", "z"), (2, None, "z"), (3, "", "z"), (4, read_as(BASE, "cp1252") * 300, "z"), (5, "ok", "z")], "doc_id long, text string, restored string")
    got = {r.id: r for r in garble.garbled(df, "doc_id", "text").collect()}
    assert set(got) == {1, 4} and got[1].lost == 1 and got[4].restored == BASE * 300


# ---- truncation and pairs -----------------------------------------------------------------

END = "salvo il diritto di regresso"
FULL = [f"La parte {n} ha violato l'obbligo di fedeltà, {END}. Il giudice numero {n} ha accolto la domanda, {END}." for n in ("attrice", "convenuta", "civile", "ricorrente", "resistente", "lesa", "istante", "terza")]


def cut_of(spark, texts):
    df = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "score_id long, model_output string, model string")
    return {r.id: r.cut for r in truncation.truncated(df, "score_id", "model_output", "model").collect()}


def test_truncation(spark):
    broken = [
        "La parte attrice ha violato l'obbligo di fed", "La parte attrice ha violato l'obbligo di", f"{FULL[0]} Vedi (Cass. n.", f"{FULL[0]}\n2.", '{"risposta": "La parte attrice ha violato l\'obb', f"{FULL[0]}\n```sql\nSELECT 1",
        f"{FULL[0]} La parte civile ha…", f"{FULL[0]} La parte <troncato>", f"{FULL[0]}\n\nFonti: ECLI:IT:CASS:2011:93",
    ]
    whole = [*FULL, f"{FULL[1]}\n\nFonti: ECLI:IT:CASS:2011:937CIV", f"{FULL[2]}\n\nhttps://archivio.example/schede/123", f"{FULL[3]}\n\n**Esito: domanda fondata**", f"{FULL[4]}\n\n| a | b |\n|---|---|\n| c | d |", f"{FULL[5]} [omissis]", '{"risposta": "Sì.", "lingua": "it"}', *[f"{t}\n\nCordiali saluti" for t in FULL[:4]]]
    got = cut_of(spark, broken + whole)
    assert [i for i in range(len(broken)) if got[i] is None] == []
    assert [whole[i - len(broken)] for i in range(len(broken), len(broken) + len(whole)) if got[i] is not None] == []


def test_last_words_cut_after_one_or_two_letters(spark):
    broken = ["La parte attrice ha violato l'obbligo di fe", "La parte attrice ha violato l'obbligo di f", *[f"{t}\nIl giudice numero c" for t in FULL[:3]], *[f"{t}\n\nCordiali sa" for t in FULL[3:6]]]
    whole = [*FULL, *[f"{t}\n\nCordiali saluti" for t in FULL[:4]]]
    got = cut_of(spark, broken + whole)
    assert [got[i] for i in range(len(broken))] == ["word"] * len(broken)
    assert [got[i] for i in range(len(broken), len(broken) + len(whole))] == [None] * len(whole)


def test_a_repeated_answer_counts_once_inside(spark):
    whole = [f"{t}\n\nCordiali saluti" for t in FULL[:4]]
    hot = f"{FULL[4]}\n\nCordiali saluti\n\n{FULL[5]}"
    assert set(cut_of(spark, whole + [hot] * 300).values()) == {None}


def test_truncation_of_nothing(spark):
    assert cut_of(spark, ["", "  ", None]) == {}
    assert truncation.truncated(spark.createDataFrame([], "score_id long, model_output string, model string"), "score_id", "model_output", "model").count() == 0


QUESTION = "Su chi grava l'onere della prova qualora la società Navlina S.r.l. non abbia eseguito la prestazione pattuita entro il termine di 30 giorni?"
ANSWER = "La risposta è negativa, poiché il giudice di appello ha ritenuto che la parte civile non ha assolto l'onere della prova e che la domanda va respinta."


@pytest.mark.parametrize("answer, defect", [
    (None, "empty"), ("", "empty"), ("​  ", "empty"), ("{}", "empty"), ("```\n```", "empty"), ("**Risposta**\n", "empty"), ("<p></p>", "empty"), ("N/D", "empty"), ("Sì.", None),
    ("Mi dispiace, ma non posso rispondere a questa domanda.", "refusal"), ("I'm sorry, but I can't help with that request.", "refusal"), ("Es tut mir leid, aber dazu kann ich keine Auskunft geben.", "refusal"), ("Je ne peux pas répondre à cette question.", "refusal"), ("Lo siento, no puedo responder a esta pregunta.", "refusal"),
    ("Non posso che condividere la premessa. " + ANSWER, None), ("Non è possibile fornire un parere definitivo senza gli atti; tuttavia " + ANSWER * 3, None),
    (QUESTION, "copied"), (QUESTION.upper(), "copied"), (QUESTION.replace(" ", "  ") + "\n\nRisposta:", "copied"), ("La domanda è la seguente: «" + QUESTION + "»", "copied"), (QUESTION + "\n" + QUESTION, "copied"), (QUESTION.replace("S.r.l.", "Srl").rstrip("?"), "copied"),
    (QUESTION + " " + ANSWER, None), (ANSWER, None), ('{"risposta": "' + ANSWER, "open"),
    ("The court held that the plaintiff had failed to prove the claim and that the appeal must be dismissed for this reason.", "other_language"), ("Ecco la risposta: Der Kläger hat nicht bewiesen, dass der Vertrag erfüllt ist, und die Klage ist abzuweisen, weil der Anspruch verjährt ist.", "other_language"),
    (ANSWER + " Vale il brocardo iura novit curia. The contract says: “time is of the essence”.", None),
])
def test_judgement(answer, defect):
    assert pairs.judge(answer, QUESTION) == defect


def test_long_refusals():
    reasons = "Mi dispiace, ma non posso rispondere a questa domanda. Non sono in grado di valutare gli atti del giudizio, in quanto non dispongo del fascicolo. Preferisco non esprimere un parere su una causa pendente. "
    referral = "La invito a rivolgersi a un avvocato di fiducia. Si consiglia di consultare l'ordine forense del luogo. "
    assert len((reasons * 3 + referral * 3).split()) > 80 and pairs.is_refusal(reasons * 3 + referral * 3) and pairs.is_refusal((reasons + referral) * 10)
    assert not pairs.is_refusal(reasons + ANSWER * 4) and not pairs.is_refusal(" ".join([ANSWER.rstrip(".")] * 4) + ", ma non posso rispondere sul resto.")


def test_script_of_the_whole_answer():
    latin, greek = "Il giudice di appello ha respinto la domanda della parte civile. ", "Το δικαστήριο απέρριψε την αίτηση του ενάγοντος ως αβάσιμη. "
    assert pairs.judge(latin * 20 + greek * 60, QUESTION) == "other_language"
    assert pairs.judge(greek * 25 + latin * 80, QUESTION) is None


def test_missing_question_and_parser():
    assert pairs.judge(ANSWER, None) is None
    assert pairs.parse("a (b [c").stack == ["(", "["] and pairs.parse("```\n( \n```").stack == [] and pairs.parse("a\n2. ").dangling and pairs.parse("<div><p>x</p>").stack == ["<div>"]


def test_tiles_are_disjoint_and_cover():
    a = "xx" + "abcdefghijklmnop" + "yy" + "abcdefghijklmnop"
    got = pairs.tiles(a, "abcdefghijklmnop")
    assert got == [(2, 18), (20, 36)]


def test_broken_order(spark):
    answers = spark.createDataFrame([(1, "m", "t", None), (2, "m", "t", QUESTION), (3, "m", "t", ANSWER[:40]), (4, "m", "t", ANSWER), (5, "m", "gone", ANSWER)], "id long, grp string, task string, answer string")
    questions = spark.createDataFrame([("t", QUESTION)], "task string, question string")
    cuts = spark.createDataFrame([(3, "word"), (2, "sentence")], "id long, cut string")
    assert {r.id: r.defect for r in pairs.broken(answers, questions, cuts).collect()} == {1: "empty", 2: "copied", 3: "truncated"}
    assert [r.id for r in pairs.unfinished(cuts, answers, questions).collect()] == [3]


def test_defects_of_empty_tables(spark):
    answers = spark.createDataFrame([], "id long, grp string, task string, answer string")
    questions, cuts = spark.createDataFrame([], "task string, question string"), spark.createDataFrame([], "id long, cut string")
    assert pairs.broken(answers, questions, cuts).where(F.col("defect").isNotNull()).count() == 0


# ---- what caps once hid -------------------------------------------------------------------


def test_text_damaged_five_times_is_restored():
    text = "La società è già però così perché"
    bad = text
    for _ in range(5):
        bad = bad.encode("utf-8").decode("latin-1")
    assert garble.repair(bad)[0] == text


def test_restated_question_is_found_within_a_text():
    other = "The court held that the plaintiff had failed to prove the claim and that the appeal must be dismissed for this reason."
    middle = QUESTION[30:-30]
    assert pairs.judge(f"Ecco: {middle} {other}", QUESTION) == "other_language"
    assert pairs.judge(f"Ecco: {middle} {ANSWER}", QUESTION) is None


@pytest.mark.parametrize("answer", [
    "Chiedo scusa: per questo genere di domande il servizio non è abilitato.", "La mia configurazione non mi consente di aiutare con questo quesito.", "I would rather not comment on pending cases.", "Il m'est impossible de répondre à cette question.",
    "Das kann ich leider nicht beantworten.", "Debo declinar la solicitud de emitir un dictamen.",
])
def test_refusals_by_grammar(answer):
    assert pairs.is_refusal(answer)


def test_short_french_answers_with_few_function_words():
    known = pairs.model([("fr", forms.words("L'assureur a soutenu que l'administration fiscale n'a pas rapporté la preuve avant que le jugement ne soit définitif.")), ("it", forms.words(ANSWER * 2))])
    answer = "Malgré la mise en demeure de 2005, l'assureur a soutenu que l'acquéreur du terrain avait notifié l'acte hors délai."
    assert pairs.judge(answer, QUESTION, known) == "other_language" and pairs.judge(ANSWER, QUESTION, known) is None


def test_counts_decide_truncation(spark):
    # the same ending is whole where texts end with it, and a cut where they go on
    ends = [f"Il giudice numero {n} ha deciso secondo il prospetto allegato" for n in range(30)]
    goes_on = [f"Il giudice numero {n} ha deciso secondo il prospetto allegato alla memoria depositata in cancelleria." for n in range(30)]
    last = "Il giudice numero 77 ha deciso secondo il prospetto allegato"
    assert set(cut_of(spark, [*ends, last]).values()) == {None}
    assert cut_of(spark, [*goes_on, last])[30] is not None


def test_unfinished_in_expressions(spark):
    rows = [(1, "m", "t", "**Risposta**"), (2, "m", "t", QUESTION.rstrip("?")), (3, "m", "t", "Mi dispiace, ma non posso rispondere a questa domanda"), (4, "m", "t", ANSWER[:90]), (5, "m", "gone", ANSWER[:60]), (6, "m", "t", None), (7, "m", "t", QUESTION + "\n\nPoiché l'imputato non aveva")]
    answers = spark.createDataFrame(rows, "id long, grp string, task string, answer string")
    questions, cuts = spark.createDataFrame([("t", QUESTION)], "task string, question string"), spark.createDataFrame([(i, "word") for i in range(1, 8)], "id long, cut string")
    assert sorted(r.id for r in pairs.unfinished(cuts, answers, questions).collect()) == [4, 5, 7]
