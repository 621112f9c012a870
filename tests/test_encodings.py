"""The encoding of generated files, by language and encoding."""

import random

import pytest

from strataseek.functions.encodings import LEAST, decode, detect, with_text

# Other words than those the models are made from.
TEXTS = {
    "west": ["Das Öffnen der Datei schlägt fehl, wenn der Schlüssel ungültig ist.", "Le fichier a été créé avec succès par le contrôleur principal.", "La función devolvió un número inválido después del cálculo.", "A operação não será concluída até amanhã."],
    "central": ["Soubor nebyl nalezen, zkuste to později znovu, děkuji.", "Plik nie został znaleziony, spróbuj ponownie później, dziękuję.", "A fájl nem található, kérjük, próbálja újra később."],
    "cyrillic": ["Файл не найден, попробуйте позже ещё раз, спасибо.", "Счёт закрыт, остаток перенесён на новый месяц."],
    "japanese": ["ファイルが見つかりません。あとでもう一度試してください。", "この行は合計を計算して、表に書きます。"],
    "plain": ["MOVE WS-AMOUNT TO OUT-TOTAL.", "SUBROUTINE DGEMM(TRANSA, TRANSB)"],
}
ENCODINGS = {
    "iso-8859-1": "west", "cp1252": "west", "iso-8859-2": "central", "cp1250": "central", "cp1251": "cyrillic", "koi8-r": "cyrillic", "iso-8859-5": "cyrillic", "cp866": "cyrillic", "shift_jis": "japanese", "euc-jp": "japanese", "utf-8": "west",
    "utf-16-le": "west", "utf-16-be": "plain", "cp037": "plain", "cp273": "west", "cp500": "plain",
}


def program(rnd, sentences):
    out = []
    for i in range(rnd.randrange(8, 25)):
        comment = rnd.choice(sentences)
        out += [f"      * {comment}" if i % 3 else f"           DISPLAY '{comment}'.", f"           MOVE WS-{i} TO OUT-{i * 7 % 10}."]
    return "\n".join(out) + "\n"


@pytest.mark.parametrize("name", ENCODINGS)
def test_files_are_read_as_they_were_written(name):
    rnd = random.Random(name)
    good = confident = 0
    for _ in range(40):
        text = program(rnd, TEXTS[ENCODINGS[name]])
        found, confidence, read = decode(text.encode(name, "replace"))
        want = text.encode(name, "replace").decode(name)
        confident += confidence >= LEAST
        good += read == want
    assert good >= 38 and confident >= 38, (good, confident)


def test_what_is_no_text_is_skipped():
    rnd = random.Random(1)
    for _ in range(30):
        assert decode(bytes(rnd.randrange(256) for _ in range(400)))[0] is None
    assert decode(b"\x7fELF\x02\x01\x01\x00\x00\x00") == (None, 0.0, "") and decode(b"\x01\x02\x03\x04ab")[0] is None
    assert decode(b"\x00\x01" * 50)[0] is None and decode(b"\x00" * 64)[0] is None
    assert detect(b"") == ("utf-8", 1.0) and decode(None) == ("utf-8", 1.0, "") and detect(b"plain ascii 1+1") == ("utf-8", 1.0)
    assert decode(b"\xef\xbb\xbfabc")[2] == "abc" and decode("äx".encode("utf-16"))[2] == "äx" and detect(b"+AGE-")[0] == "utf-8"


def test_files_in_a_frame(spark):
    rows = [(1, "für".encode(), "x"), (2, "      * Das Öffnen schlägt fehl, müde Vögel".encode("cp273"), "y"), (3, None, "z"), (4, b"\x7fELF\x02\x01\x01\x00\x00\x00", "w")]
    got = {r["i"]: r for r in with_text(spark.createDataFrame([(i, bytearray(c) if c is not None else None, n) for i, c, n in rows], "i int, content binary, name string")).collect()}
    assert (got[1]["encoding"], got[1]["text"], got[2]["text"], got[3]["text"]) == ("utf-8", "für", "      * Das Öffnen schlägt fehl, müde Vögel", "")
    assert got[4]["encoding"] is None and got[4]["text"] == "" and got[2]["name"] == "y" and got[2]["confidence"] >= LEAST
