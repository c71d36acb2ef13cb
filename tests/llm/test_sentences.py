import pytest

from millrace.llm.sentences import sentence_starts, unit_starts


def split(text):
    s = unit_starts(text)
    return [text[a:b].strip() for a, b in zip(s, [*s[1:], len(text)])]


CASES = [
    ["Dr. Lee met Mr. Ray at 9 a.m. sharp.", "They left."],
    ["The fee is $1.85 per visit, i.e. 7.6% less.", "See Sec. 8 of the U.S. schedule."],
    ['He said, "We will be there. Really." and left.', "Then it rained."],
    ['The memo reads: "All was lost. Start again."', "The panel met."],
    ["What?!", "No extension this time?", "Is it mandatory?"],
    ["(The meeting is optional.)", "Bids open at 2 p.m.", "The award went to Smith Corp.", "It was late."],
    ["Die Gebühr beträgt 5,98 Euro, d. h. ca. 4.2 Prozent weniger.", "Am 3. Mai öffnet Dr. med. Korn die Stelle."],
    ["Voir l'art. 22.7 et les p. 10 et suiv. du cahier.", "Hélas… le délai est dépassé !", "M. Dupont a signé."],
    ["¿Es obligatoria la visita?", "¡Atención, vence hoy!", "El Sr. Ruiz firmó a las 2 p. m. en punto."],
    ["Плата составляет 7.5 руб. за визит, т. е. меньше.", "См. п. 8.8 и стр. 44 договора.", "«Принимают ли?» — спросил г. Иванов."],
    ["他说：“样本都丢了。重新开始吧。”", "县政府安排了预算。", "“什么时候截止？”采购员问道。"],
    ["報告書（第48版。改訂済み）を参照してください。", "「締切はいつですか。」と担当者が尋ねた。", "現地見学は必須ですか？"],
    ["हर बोलीदाता सेवा देगा।", "क्या दौरा अनिवार्य है?", "शुल्क 43.5 रुपये है।"],
    ["قال د. Lee إن الموعد تغير.", "هل الزيارة إلزامية؟", "الرسم 16.73 دولار!"],
    ["คลินิกตั้งงบประมาณไว้ 752,137 บาทเหมือนปีก่อน", "คณะกรรมการจะให้บริการตรวจสุขภาพตามเอกสารแนบ"],
]


@pytest.mark.parametrize("parts", CASES)
def test_sentences(parts):
    cjk = ord(parts[0][0]) > 0x3000 and not "฀" <= parts[0][0] <= "๿"
    assert split(("" if cjk else " ").join(parts)) == parts


def test_lines_lists_and_wrapping():
    assert split("Contact person\nThe fee is due.\n\n1. Provide forms\n- Bring 3 copies\na) Sign page 2.") == ["Contact person", "The fee is due.", "1. Provide forms", "- Bring 3 copies", "a) Sign page 2."]
    wrapped = "The county will keep all of the records for ten years and the\nboard will meet again in May. The auditor asks for reports on the\nstate of things before the close of business.\nSite visit\nThe panel met."
    assert len(split(wrapped)) == 4
    assert split("rate.The auditor met.\r\nA.") == ["rate.", "The auditor met.", "A."]


def test_blank_and_null(spark):
    assert unit_starts(None) == unit_starts("") == unit_starts(" \n\t ") == []
    df = spark.createDataFrame([(1, None, 1), (2, " ", 1), (3, "  A b. C d.", 1)], "doc_id long, text string, start_char int")
    assert sorted((r.doc_id, r.start_char) for r in sentence_starts(df).collect()) == [(3, 2), (3, 7)]
    assert sentence_starts(df.limit(0)).count() == 0


def test_long_text_is_linear():
    assert len(unit_starts("A b c d. " * 20_000)) == 20_000
    assert unit_starts('"' * 50_000) and unit_starts("(" * 50_000) and unit_starts("." * 50_000)


def cut(text, lang=None):
    at = [*unit_starts(text, lang), len(text)]
    return [text[a:b].strip() for a, b in zip(at, at[1:])]


def test_long_quotations_hold_together():
    said = " ".join(f"The board met on day {i}." for i in range(60))
    assert len(said) > 1200 and len(cut(f"The clerk wrote “{said}” and left. All went home.")) == 2
    assert cut('Use 6" pipe here. Then a 4" pipe there.') == ['Use 6" pipe here.', 'Then a 4" pipe there.']


def test_terminators_of_all_scripts():
    assert len(cut("第一の文です．次の文です．")) == 2 and cut("値は３．５です。次です。") == ["値は３．５です。", "次です。"]
    assert len(cut("ᠮᠣᠩᠭᠣᠯ᠃ ᠪᠢᠴᠢᠭ᠃")) == 2 and len(cut("\U00011083\U00011084\U000110c0 \U00011083\U00011084\U000110c0")) == 2


def test_abbreviations_by_language_and_place():
    assert len(cut("I live on Main St. The house is old.", "en")) == 2 and len(cut("We went to St. Louis by train.", "en")) == 1
    assert len(cut("Er wohnt in Raum 5 al. Das ist gut.", "de")) == 2 and len(cut("Smith et al. Found the rest.", "en")) == 1
    assert len(cut("Sie prüft z. B. Proben.", "de")) == 1 and len(cut("Sie prüft z. B. Proben.", None)) == 1
