"""Which encoding a file has, with a confidence.

Multi-byte encodings are told by state machines (as patterns over bytes). For one-byte encodings there is a table of scores for pairs of bytes: how likely the two
characters that they stand for are side by side, by kinds of character, and how common each letter outside ASCII is where the encoding is used. Both come from the
sample sentences below. A file's histogram of byte pairs times the tables gives its likelihood under each encoding; encodings under which it reads the same share theirs.
The confidence is the winner's share of all. Files under ``LEAST`` are skipped by the callers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

LEAST = 0.7
#: Sample sentences by family of encodings.
SAMPLES = {
    "west": "Die Größe der Tür für müde Vögel überraschte schöne Bären. Où êtes-vous allé, garçon? Ça a été très près de la forêt à l'île, naïve élève, tôt déjà, cœur, août. "
    "El niño pidió más café mañana, ¿qué pasó allí? La acción así continuó según él. Não há razão, coração e pães à mão. Perché così è già più giù. På sjön går små fåglar över öar. Blåbærgrød æder ræven. £ § ° «mot»",
    "central": "Příliš žluťoučký kůň úpěl ďábelské ódy, řekl měšťan. Zażółć gęślą jaźń, książkę, że się, łódź, ćma, był, może. Árvíztűrő tükörfúrógép, időjárás, szükség, győr, hűség. Čeština, škola, ještě, když.",
    "cyrillic": "Съешь же ещё этих мягких французских булок да выпей чаю. Программа читает запись из файла и печатает сумму по каждому счёту. Это не было ошибкой, и она обновила все данные.",
}
CODE = "      MOVE WS-TOTAL TO OUT-REC.\n       IF A = B THEN (C + 1) * 2 PERFORM X-100 THRU X-199 'TEXT', \"text\"; call sub(x, y)\n      * the comment says what follows here: 3.14\n\t if (i == 0) then; end do\n"
#: One-byte encodings, and the family of their letters. Those of mainframes have other places for ASCII's characters too.
ONE_BYTE = {"iso-8859-1": "west", "cp1252": "west", "iso-8859-2": "central", "cp1250": "central", "cp1251": "cyrillic", "koi8-r": "cyrillic", "iso-8859-5": "cyrillic", "cp866": "cyrillic", "cp037": "west", "cp500": "west", "cp273": "west"}
MULTI_BYTE = {
    "shift_jis": re.compile(rb"(?:[\x00-\x7f\xa1-\xdf]|[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc])*+"),
    "euc-jp": re.compile(rb"(?:[\x00-\x7f]|\x8e[\xa1-\xdf]|[\xa1-\xfe][\xa1-\xfe])*+"),
}
KINDS = 10
#: The characters of kind 9.
CONTROLS = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
#: The log score of what no text has: a control character, or a byte without a character.
NEVER = -14.0


def kind(c: str) -> int:
    if c in "\n\r\t ":
        return 0
    if ord(c) < 32 or 0x7F <= ord(c) < 0xA0:
        return 9
    if ord(c) < 128:
        return 1 if c.isdigit() else 2 if c.islower() else 3 if c.isupper() else 4
    letter = 5 if c.islower() else 6 if c.isupper() else 8
    return letter if letter == 8 or ord(c) < 0x250 else 7 if letter == 5 else 8 if not c.isalpha() else 6


@cache
def _kinds_model() -> np.ndarray:
    """Log share of a kind behind a kind, over all samples and code."""
    n = np.full((KINDS, KINDS), 0.1)
    for text in (*SAMPLES.values(), CODE, CODE.lower()):
        of = [kind(c) for c in text]
        np.add.at(n, (of[:-1], of[1:]), 1)
    found = np.log(n / n.sum(axis=1, keepdims=True))
    found[9, :] = found[:, 9] = NEVER
    return found


@cache
def _letters(family: str) -> dict[str, float]:
    n = Counter(c for c in SAMPLES[family] + SAMPLES[family].upper() if ord(c) > 127)
    return {c: log(k / n.total()) for c, k in n.items()}


@cache
def _signs() -> dict[str, float]:
    """How common each sign of ASCII is in code: mainframes' encodings have national letters where others have rare signs."""
    signs = [chr(c) for c in range(32, 127) if kind(chr(c)) == 4]
    n = {c: (CODE + SAMPLES["west"]).count(c) + 0.1 for c in signs}
    return {c: log(k / sum(n.values())) for c, k in n.items()}


@cache
def _tables() -> tuple[list[str], np.ndarray, list[str]]:
    """Names, the scores of all byte pairs (encoding by 65536), and each encoding's 256 characters."""
    names, rows, characters = list(ONE_BYTE), [], []
    for name, family in ONE_BYTE.items():
        own = [bytes([b]).decode(name, "replace") for b in range(256)]
        characters.append("".join(own))
        of = np.array([9 if c == "�" else kind(c) for c in own])
        letters, rare, signs = _letters(family), log(1 / 2000), _signs()
        # Letters and digits of ASCII count the same wherever they are.
        single = np.array([0.0 if k in (0, 1, 2, 3, 9) else signs[c] if ord(c) < 128 else letters.get(c, rare) for c, k in zip(own, of, strict=True)])
        rows.append((_kinds_model()[of[:, None], of[None, :]] + single[None, :]).reshape(-1))
    return names, np.array(rows), characters


def _multi_byte_score(content: bytes, name: str) -> float | None:
    if not MULTI_BYTE[name].fullmatch(content):
        return None
    try:
        text = content.decode(name)
    except UnicodeDecodeError:
        return None
    wide = [c for c in text if ord(c) > 127]
    common = sum("぀" <= c <= "ヿ" or c in "。、「」" for c in wide)
    kanji = sum("一" <= c <= "鿿" for c in wide)
    # A character of two bytes is judged once: kana are as common as letters, kanji less, half-width forms and signs hardly.
    return -2.0 * (len(text) - len(wide)) - 3.5 * common - 6.5 * kanji - 12.0 * (len(wide) - common - kanji)


def detect(content: bytes) -> tuple[str | None, float]:
    """(encoding, confidence); (None, 0) if it is no text in any encoding that is known. Valid UTF-8, ASCII among it, is utf-8."""
    if not content:
        return "utf-8", 1.0
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return name, 1.0
    if b"\x00" in content:
        even, odd = content[0::2].count(0) / max(1, len(content[0::2])), content[1::2].count(0) / max(1, len(content[1::2]))
        name = "utf-16-be" if even > odd else "utf-16-le"
        if len(content) % 2 == 0 and abs(even - odd) > 0.4 and kind_share(content.decode(name, "replace")) < 0.25:
            return name, abs(even - odd)
        return None, 0.0
    try:
        if kind_share(content.decode("utf-8")) < 0.25:
            return "utf-8", 1.0
    except UnicodeDecodeError:
        pass
    names, table, characters = _tables()
    data = np.frombuffer(content, np.uint8).astype(np.int64)
    pairs = np.bincount(data[:-1] * 256 + data[1:], minlength=1 << 16) if len(data) > 1 else np.zeros(1 << 16, np.int64)
    seen = np.flatnonzero(pairs)
    scores = dict(zip(names, (table[:, seen] @ pairs[seen]).tolist(), strict=True))
    scores |= {n: s for n in MULTI_BYTE if (s := _multi_byte_score(content, n)) is not None}
    used = np.flatnonzero(np.bincount(data, minlength=256)).tolist()
    groups: dict[object, tuple[str, float]] = {}
    for name, score in scores.items():
        reads = "".join(characters[names.index(name)][b] for b in used) if name in ONE_BYTE else name
        first, best = groups.get(reads, (name, score))
        groups[reads] = (first, max(best, score))
    ranked = sorted(groups.values(), key=lambda x: -x[1])
    name, best = ranked[0]
    if best / max(1, len(data) - 1) < NEVER / 2:
        return None, 0.0
    return name, 1 / sum(exp(max(-60.0, s - best)) for _, s in ranked)


def kind_share(text: str) -> float:
    """The part of a text that is control characters."""
    return len(CONTROLS.findall(text)) / len(text)


def decode(content: bytes | None, least: float = LEAST) -> tuple[str | None, float, str]:
    """(encoding, confidence, text); without an encoding, and no text, if the confidence is below ``least``."""
    name, confidence = detect(content or b"")
    if name is None or confidence < least:
        return None, confidence, ""
    return name, confidence, (content or b"").decode(name, "replace")


def with_text(df: DataFrame, *, content_col: str = "content", least: float = LEAST) -> DataFrame:
    """``df`` with encoding, confidence and text in place of its binary column, in Arrow batches. A file that is skipped has no encoding and an empty text."""
    names = [c for c in df.columns if c not in (content_col, "encoding", "confidence", "text")]
    read = df.select(*names, content_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [decode(c, least) for c in batch.column(len(names)).to_pylist()]
            more = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.string()))]
            yield pa.record_batch([*batch.columns[:-1], *more], names=[*names, "encoding", "confidence", "text"])

    return read.mapInArrow(batches, StructType([*read.schema.fields[:-1], StructField("encoding", StringType()), StructField("confidence", DoubleType()), StructField("text", StringType())]))
