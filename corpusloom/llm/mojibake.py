"""Text that was decoded with the wrong character encoding.

Round-trip repair: a run of non-ASCII characters is re-encoded under a candidate
legacy encoding (the one it was wrongly read with) and strictly decoded as the
encoding that was meant.  The result is accepted when a garbling cost drops: the
cost of a text counts characters that do not occur in ordinary text (controls,
rare ideographs, symbols) and neighbours that do not go together (capital
accented letters inside words, two scripts in one word).  This is repeated for
nested layers.  Runs are repaired one by one, so a text may be garbled in parts.

A run with replacement characters has lost bytes: it is reported, and the pieces
between them are repaired as far as they decode.

Defined results: null and empty fields are no cases; a text that only quotes
garbled characters stays, as no round trip makes it cheaper; the work is per row,
so ties, repeated rows and skew have no effect.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import spread

#: Encodings a text is wrongly read with.  cp1252 stands for latin-1 too.
WRONG = ("cp1252", "gb18030", "cp1251", "cp437", "big5hkscs", "cp850", "koi8-r", "mac-roman", "shift_jis", "cp949", "cp1253")
_SINGLE_BYTE = ("cp1252", "cp1251", "cp437", "cp850", "koi8-r", "mac-roman")
#: Encodings that were meant besides UTF-8; tried where UTF-8 does not fit, on runs of some length.
MEANT_LEGACY = ("gbk", "big5", "shift_jis", "euc-kr")
MIN_LEGACY_RUN = 4
#: Cost per character of a run that looks garbled; words of one script are cheaper.
MIN_RUN_COST = 0.6
#: A repair must take away this much and this share of the cost.
MIN_DROP, MAX_SHARE = 0.6, 0.7

_CHEAP_LATIN1 = "«»·¿¡°§ª²³"
_LOSS = "�"


@lru_cache(maxsize=None)
def _ideograph_cost(ch: str) -> float:
    """Common ideographs stand in the first level of a national standard."""
    for codec, limit in (("gb2312", 0xD8), ("shift_jis", 0x98)):
        try:
            code = ch.encode(codec)
        except UnicodeEncodeError:
            continue
        if len(code) == 2 and code[0] < limit:
            return 0.2
    try:
        ch.encode("gb2312")
        return 0.8
    except UnicodeEncodeError:
        pass
    try:
        if ch.encode("big5")[0] < 0xC7:
            return 0.6
    except UnicodeEncodeError:
        pass
    return 1.5


@lru_cache(maxsize=None)
def _char(ch: str) -> tuple[float, str]:
    """Cost and kind of a character: a(scii letter), l(atin), y(symbol), c(yrillic), h(an), k, '-' other."""
    o = ord(ch)
    if o < 128:
        return 0.0, "a" if ch.isalpha() else "-"
    if ch == _LOSS or 0x80 <= o <= 0x9F:
        return 3.0, "y"
    if o <= 0xFF:
        if ch.isalpha() and ch not in "ªµº":
            return 0.5, "l"
        return (0.1, "-") if o == 0xA0 else (0.5 if ch in _CHEAP_LATIN1 else 1.0, "y")
    if 0x4E00 <= o <= 0x9FFF:
        return _ideograph_cost(ch), "h"
    if 0x3041 <= o <= 0x30FF or 0xAC00 <= o <= 0xD7A3:
        return 0.2, "k"
    if 0x410 <= o <= 0x44F or o in (0x401, 0x451):
        return 0.3, "c"
    if 0x400 <= o <= 0x52F:
        return 1.5, "c"
    if 0x100 <= o <= 0x17F:
        return 1.0, "l"
    if ch in "‘’“”„‚–—―…‐′″‹›":
        return 0.1, "-"
    if 0x3000 <= o <= 0x301F or 0xFF01 <= o <= 0xFF60 or 0x2010 <= o <= 0x2027:
        return (0.1 if o < 0xFF00 or not ch.isalpha() else 0.5), "-"
    if 0x2000 <= o <= 0x2BFF:
        return (2.0 if 0x2500 <= o <= 0x259F else 1.0), "y"
    if 0x370 <= o <= 0x3FF:
        return 1.0, "g"
    category = unicodedata.category(ch)
    if category in ("Co", "Cn", "Cs"):
        return 3.0, "y"
    return 1.5, "o"


def garbling_cost(text: str, before: str = "", after: str = "", most: float = float("inf")) -> float:
    """Cost of ``text`` between the characters before and after it; counting ends above ``most``."""
    total, padded = 0.0, f"{before[-1:] or ' '}{text}{after[:1] or ' '}"
    kinds = [_char(c) for c in padded]
    for i in range(1, len(padded) - 1):
        cost, kind = kinds[i]
        left, right = kinds[i - 1][1], kinds[i + 1][1]
        total += cost
        if total > most:
            return total
        if kind == "l":
            upper, prev_upper = padded[i].isupper(), padded[i - 1].isupper()
            if left in "lygco" and (left != "l" or upper != prev_upper):
                total += 0.7
            if upper and ((left in "al" and not prev_upper) or (left in "al" and right not in "al-") or (right in "al" and padded[i + 1].islower() and left in "al")):
                total += 1.0
        elif kind == "y":
            if left in "lygcoh" or right in "lygcoh":
                total += 0.7
        elif kind in "cg":
            total += 1.0 * ((left in "al") + (right in "al")) + 0.7 * (left == "y")
            if kind == "c" and padded[i].isupper() and right == "c" and padded[i + 1].isupper() is False and left == "c" and padded[i - 1].islower():
                total += 0.7
        elif kind in "hk":
            total += 0.5 * ((left in "al") + (right in "al")) + 0.4 * (left == "o")
            if left == "a" and right == "a" and padded[i - 1].islower() and padded[i + 1].islower():
                total += 1.0
        elif kind == "o":
            total += 0.7
    return total


def _encode(text: str, wrong: str) -> bytes | None:
    """Bytes that ``wrong`` reads as ``text``; its holes stand for themselves, as decoders leave them."""
    try:
        return text.encode(wrong)
    except UnicodeEncodeError:
        if wrong != "cp1252" and wrong != "cp1251":
            return None
    out = bytearray()
    for ch in text:
        try:
            out += ch.encode(wrong)
        except UnicodeEncodeError:
            if not 0x80 <= ord(ch) <= 0x9F:
                return None
            out.append(ord(ch))
    return bytes(out)


def _decode(raw: bytes, meant: str, lossy: bool) -> str | None:
    """Strict decoding; between lost bytes, characters cut at the ends are given up."""
    try:
        return raw.decode(meant)
    except UnicodeDecodeError:
        if not lossy:
            return None
    for start in range(3):
        for end in range(3):
            if end + start and len(raw) - start - end > 2:
                try:
                    return raw[start : len(raw) - end].decode(meant)
                except UnicodeDecodeError:
                    continue
    return None


def _repair_run(run: str, before: str, after: str, lossy: bool = False) -> tuple[str, int, float]:
    """The cheapest strict round trip of one run with its layers and cost, or the run itself.

    UTF-8 admits few byte sequences, so a reading as UTF-8 goes before all others."""
    cost = garbling_cost(run, before, after)
    if cost < MIN_DROP:
        return run, 0, cost
    best, layers, best_cost = run, 0, min(cost - MIN_DROP, cost * MAX_SHARE)
    raws = {}
    for wrong in WRONG:
        raw = _encode(run, wrong)
        if raw is None:
            continue
        raws[wrong] = raw
        text = _decode(raw, "utf-8", lossy)
        if text is None or text == run or _LOSS in text:
            continue
        deeper, more, new = _repair_run(text, before, after, lossy) if not text.isascii() else (text, 0, garbling_cost(text, before, after, best_cost))
        if new <= best_cost:
            best, layers, best_cost = deeper, more + 1, new
    if layers == 0 and len(run) >= MIN_LEGACY_RUN and cost >= MIN_RUN_COST * len(run):
        best_cost = min(best_cost, cost * 0.4)
        for wrong in _SINGLE_BYTE:
            if wrong in raws:
                for meant in MEANT_LEGACY:
                    text = _decode(raws[wrong], meant, lossy) if meant != wrong else None
                    if text is not None and _LOSS not in text and (new := garbling_cost(text, before, after, best_cost)) < best_cost:
                        best, layers, best_cost = text, 1, new
    return (best, layers, best_cost) if layers else (run, 0, cost)


_RUN = re.compile(r"[^\x00-\x7f]+")


#: Encodings meant by a whole field, besides UTF-8.
_MEANT_FIELD = ("gbk", "big5", "shift_jis", "euc-kr", "euc-jp", "cp1251", "koi8-r", "cp866", "cp1252")
#: A field's pair of encodings must take away this much of its cost, and leave at most this share.
FIELD_DROP, FIELD_SHARE = 1.5, 0.4
# Costs of Cyrillic letters by how common they are.
_CYRILLIC = {**dict.fromkeys("оеаинтсрвлк", 0.15), **dict.fromkeys("мдпуяыьгзбії", 0.3)}
_ACCENTED = re.compile("[À-ÖØ-öø-ÿ]{3,}")


def _field_cost(text: str, most: float = float("inf")) -> float:
    """Garbling cost of a field that also knows letter frequencies, case within words and symbols within words.

    What is known besides takes at most 0.15 for a common Cyrillic letter off."""
    total = garbling_cost(text, most=most + 0.15 * len(text)) + sum(len(m) for m in _ACCENTED.findall(text))
    if total > most + 0.15 * len(text):
        return total
    for i, ch in enumerate(text):
        kind = _char(ch)[1]
        if kind == "c" and 0x410 <= ord(ch) <= 0x451:
            total += _CYRILLIC.get(ch.lower(), 0.9) - 0.3
            if ch.isupper() and i and _char(text[i - 1])[1] == "c":
                total += 0.15 if text[i - 1].isupper() else 1.5
        elif kind in "y-" and ord(ch) > 127 and ch not in "’‐·" and 0 < i < len(text) - 1 and text[i - 1].isascii() and text[i - 1].isalpha() and text[i + 1].islower() and text[i + 1].isascii():
            total += 1.0
    return total


def _reread(text: str, wrong: str, meant: str) -> str | None:
    """The field read as ``meant`` instead of ``wrong``: as a whole, else in the runs that can be."""
    raw = _encode(text, wrong)
    if raw is not None and (whole := _decode(raw, meant, False)) is not None:
        return whole

    def one(match: re.Match[str]) -> str:
        run = _encode(match.group(), wrong)
        found = _decode(run, meant, False) if run is not None else None
        return found if found is not None and _field_cost(found, own := _field_cost(match.group())) <= own else match.group()

    return _RUN.sub(one, text)


def _is_lettered(text: str) -> bool:
    """Whether letters make up the text's non-ASCII part, and are some."""
    kinds = [_char(c)[1] for c in text if ord(c) > 127]
    letters = sum(k in "lchk" for k in kinds)
    return letters >= 3 and 2 * letters >= len(kinds)


def _field_pair(text: str) -> str | None:
    """The field under the pair of encodings that makes it cheapest, if UTF-8 fits none of its runs."""
    cost = _field_cost(text)
    if cost < FIELD_DROP or _LOSS in text:
        return None
    for run in _RUN.findall(text):
        for wrong in WRONG:
            raw = _encode(run, wrong)
            if raw is not None and (found := _decode(raw, "utf-8", False)) is not None and _field_cost(found) < _field_cost(run):
                return None
    best, least = None, min(cost - FIELD_DROP, cost * FIELD_SHARE)
    for wrong in WRONG:
        for meant in _MEANT_FIELD:
            found = _reread(text, wrong, meant) if meant != wrong else None
            if found is not None and found != text and _is_lettered(found) and (new := _field_cost(found, least)) < least:
                best, least = found, new
    return best


def repair(text: str) -> tuple[str, int, bool]:
    """The text repaired, the layers taken off, and whether bytes are lost.

    Pairs of legacy encodings are sought for the whole field, before and after its
    runs are repaired one by one, so runs too short to show theirs go with the others."""
    layers = 0
    if not _pattern().search(text) and not _CASE.search(text):
        return text, 0, _LOSS in text
    if (found := _field_pair(text)) is not None:
        text, layers = found, 1
    text, more, lost = _repair_runs(text)
    if more and (found := _field_pair(text)) is not None:
        text, more = found, more + 1
    return text, layers + more, lost


def _repair_runs(text: str) -> tuple[str, int, bool]:
    suspicious = _pattern().search
    out, at, layers = [], 0, 0
    for match in _RUN.finditer(text):
        run = match.group()
        before, after = text[max(0, match.start() - 1) : match.start()], text[match.end() : match.end() + 1]
        if not suspicious(f"{before}{run}{after}"):
            continue
        fixed = []
        for piece in re.split("(\ufffd+)", run):
            if piece and piece[0] != _LOSS:
                piece, n = _repair_piece(piece, before, after, piece != run)
                layers = max(layers, n)
            fixed.append(piece)
        out += [text[at : match.start()], "".join(fixed)]
        at = match.end()
    return "".join(out) + text[at:], layers, _LOSS in text


def _repair_piece(run: str, before: str, after: str, lossy: bool) -> tuple[str, int]:
    fixed, layers, cost = _repair_run(run, before, after, lossy)
    if layers or cost < 1.5 or len(run) < 2:
        return fixed, layers
    # sound and garbled text in one run: stretches that one wrong encoding can read
    for wrong in ("cp1252", "cp1251", "cp437"):
        out, at, most = [], 0, 0
        for i, j in _stretches(run, wrong):
            for start, end in ((i, j), (i + 1, j), (i, j - 1), (i + 1, j - 1), (i + 2, j), (i, j - 2), (i + 2, j - 1), (i + 1, j - 2), (i + 2, j - 2)):
                if end - start >= 2:
                    part, n, _ = _repair_run(run[start:end], run[start - 1 : start] or before, run[end : end + 1] or after, lossy)
                    if n:
                        out += [run[at:start], part]
                        at, most = end, max(most, n)
                        break
        if most:
            return "".join(out) + run[at:], most
    # within ideographs: stretches around the costly ones
    out, at, most, i = [], 0, 0, 0
    costly = [_char(c)[0] >= 0.8 for c in run]
    while i < len(run):
        if not costly[i]:
            i += 1
            continue
        j = i
        while j < len(run) and any(costly[j : j + 3]):
            j += 1
        for start, end in ((i, j), (i, j + 1), (i, j + 2), (i - 1, j), (i - 1, j + 1), (i - 2, j), (i - 1, j + 2), (i - 2, j + 1), (i, j - 1)):
            if at <= start < end <= len(run):
                part, n, _ = _repair_run(run[start:end], run[max(0, start - 1) : start] or before, run[end : end + 1] or after, True)
                if n:
                    out += [run[at:start], part]
                    at, most = end, max(most, n)
                    break
        i = max(j, i + 1)
    return "".join(out) + run[at:], most


def _stretches(run: str, wrong: str) -> list[tuple[int, int]]:
    """Stretches of a run that ``wrong`` can read."""
    fits = [_encode(c, wrong) is not None for c in run]
    spans, i = [], 0
    while i < len(run):
        if fits[i]:
            j = i
            while j < len(run) and fits[j]:
                j += 1
            spans.append((i, j))
            i = j
        i += 1
    return spans


def _suspects() -> re.Pattern[str]:
    """Anything a garbled text must hold: a costly character, or neighbours that cost."""
    costly = [chr(o) for o in range(0x80, 0x10000) if not 0xD800 <= o <= 0xDFFF and _char(chr(o))[0] >= 0.8]
    members = "".join(map(re.escape, costly))
    return re.compile(f"[{members}\U00010000-\U0010ffff]|[À-ÖØ-Þ][À-ÿ¡-¿\u0100-\uffff]|[À-ÿ¡-¿][¡-¿]|[ß-ÿ][À-Þ]|[a-zß-ÿ][À-Þ]|[a-z][一-鿿][a-z]|[A-Za-zÀ-ÿ][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-zÀ-ÿ]")


@lru_cache(maxsize=1)
def _pattern() -> re.Pattern[str]:
    return _suspects()


#: Cyrillic in the case of another Cyrillic encoding, or a symbol within a word: garbled at the level of the field only.
_CASE = re.compile("[а-яё][А-ЯЁ]{2}|[a-z][‰‹›†‡ˆ˜ŠŒŽ„][a-z]")


_SCHEMA = "id bigint, field string, repaired string, layers int, lost boolean"


def _scan(names: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _pattern().search
        for batch in batches:
            ids = batch.column(0)
            found: list[tuple] = []
            for k, name in enumerate(names):
                for i, text in enumerate(batch.column(k + 1).to_pylist()):
                    if text and not text.isascii() and (search(text) or _CASE.search(text)):
                        fixed, layers, lost = repair(text)
                        if layers or lost:
                            found.append((ids[i].as_py(), name, fixed, layers, lost))
            if found:
                cols = list(zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.bool_())],
                    names=["id", "field", "repaired", "layers", "lost"],
                )

    return scan


def garbled_fields(df: DataFrame, id_col: str, fields: dict[str, Column]) -> DataFrame:
    """``(id, field, repaired, layers, lost)`` of the fields that are garbled.

    ``layers`` counts the wrong decodings undone; with ``lost`` some characters
    cannot be recovered and remain as replacement characters."""
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), *[c.alias(n) for n, c in fields.items()])
    return spread(texts).mapInArrow(_scan(list(fields)), _SCHEMA)
