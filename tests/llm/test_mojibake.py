"""Wrongly decoded texts made from right ones come back; right ones are left alone."""

import html

import pytest

from changeprism.llm.mojibake import cost, garbled_texts, repair, undo

RIGHT = [
    "Während der Übergabe blieb der Schlüssel gesperrt, größer als 5 €.",
    "La vérification échoue dès que l'hôte a été arrêté après 17 échecs répétés.",
    "El tamaño pequeño del módulo todavía está dañado, ¿verdad?",
    "Não há solução até 285 execuções; a função já está disponível.",
    "Żądanie zostało odrzucone, ponieważ kolejka jest już zamknięta.",
    "После обновления служба перестала отвечать на запросы, посмотрите журнал.",
    "更新之后，请检查缓存。建议先回滚，等待十秒。",
    "先に設定を戻してから実行してください。",
    "A SEÇÃO DE AÇÕES NÃO ESTÁ NA VERSÃO 448: INFORMAÇÃO, GESTÃO, Â E Ã.",
    "AÑO 339, NIÑO, ÑANDÚ, ¿QUÉ? ÎLE, ÊTRE, DÉJÀ, ÇA, À 678 %",
    "ΔΩ √151 ≤ ∞ ∂x × ÷ ¬ ± § ¶ © ® £78 ¥78 · ½ cup ª º « 390 »",
    "╔════╗\n║ box ║\n╚════╝\n├── src\n│   └── a.py",
    "Þetta er ð-próf. Đường dẫn không hợp lệ, Ấn 7. ﷺ עברית العربية हिन्दी ไทย",
    "emoji 👩‍💻🚀 ❤️ 🇵🇱 Ġthe ▁a ‹Ändern›, „Öl“ und „ÄÖÜ“, «Ещё Её ВСЁ ПРОВЕРКА СЛУЖБЫ»",
    r"caf&eacute; &amp; na&iuml;ve &copy; été ✓ https://x.example/%E2%9C%93",
    "é versus é and ﬁ, Thｅ brｉｔｔlｅ dｅrrｉck, zero​width",
    "plain ASCII & nothing else",
]
WRONG = [("latin-1", "utf-8", range(7)), ("cp1252", "utf-8", (0, 1, 5)), ("cp437", "utf-8", range(5)), ("mac_roman", "utf-8", range(5)), ("cp1251", "utf-8", (0, 1, 2, 5))]


@pytest.mark.parametrize("text", RIGHT)
def test_right_text_is_left_alone(text):
    assert repair(text) == (False, text, True)


@pytest.mark.parametrize("read", ["latin-1", "cp437", "mac_roman"])
def test_round_trip(read):
    for text in RIGHT[:8]:
        wrong = text.encode("utf-8").decode(read)
        found, back, _ = repair(wrong)
        assert found and back == text


def test_layers_escapes_and_single_words():
    text = RIGHT[1]
    twice = text.encode().decode("latin-1").encode().decode("latin-1")
    assert repair(twice)[:2] == (True, text)
    assert repair("word cafÃ© word") == (True, "word café word", True)
    assert repair("w " + "".join(f"\\u{ord(c):04x}" if c > "\x7f" else c for c in "étÃ©".encode().decode("latin-1")))[0]
    entities = "".join(f"&{html.entities.codepoint2name[ord(c)]};" if c > "\x7f" else c for c in "café".encode().decode("latin-1"))
    assert repair(entities) == (True, "café", True)


def test_any_number_of_layers():
    text = "naïve café"
    for layers in (1, 3, 6, 9):
        wrong = text
        for _ in range(layers):
            wrong = wrong.encode().decode("latin-1")
        assert repair(wrong) == (True, text, True)


def test_the_cost_decides():
    for wrong, right in (("Ã©", "é"), ("âœ“", "✓"), ("├®", "é"), ("Ð¿Ñ€Ð¸", "при")):
        assert cost(wrong, "", "") > cost(right, "", "") and undo(wrong, "", "") == (right, True)
    for fine in ("É…", "Ã”", "Её", "¿¡", "──"):  # decodable or not, nothing is gained
        assert not undo(fine, "", "")[1], fine
    assert repair("l’été a étÊ long")[0] is False  # alone a capital proves nothing
    assert repair("le café est ouvert, a Ã©tÃ© et Ã”ter")[1] == "le café est ouvert, a été et Ôter"


def test_cyrillic_encodings_taken_for_each_other():
    text = RIGHT[5]
    for meant, read in (("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp1251", "cp1252"), ("cp1251", "latin-1")):
        assert repair(text.encode(meant).decode(read))[0], (meant, read)


def test_beyond_repair_is_found():
    found, _, whole = repair("W�hrend der �bergabe")
    assert found and not whole


def test_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " ", "c"), (4, "cafÃ©", "d"), (4, "cafÃ©", "d"), (5, "Ã©" * 300_000, "e"), (None, "naÃ¯ve", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, restored string")
    got = sorted((r.doc_id or 0, r.text[:5]) for r in garbled_texts(df).collect())
    assert got == [(0, "naïve"), (4, "café"), (4, "café"), (5, "ééééé")]
    assert garbled_texts(df.limit(0)).count() == 0
