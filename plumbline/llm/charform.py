"""Character-level canonical forms shared by the text operators.

Three pure functions, each total on any string:

* :func:`visual_form` - one string for everything that looks the same on the
  screen: widths, letter styles, compositions, kinds of blank, invisible
  characters and look-alike letters of other scripts.
* :func:`same_keys` - what is left when only letters, digits and labelled
  fields count.
* :func:`words` - the runs of letters and digits, case folded.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter

# Letters of other scripts drawn like a Latin letter.
LATIN_TWINS = {
    "cyrillic": dict(zip("аеорсухіјѕһԁԛԝѵӏАВЕКМНОРСТУХІЈЅԚԜ", "aeopcyxijshdqwvlABEKMHOPCTYXIJSQW")),
    "greek": dict(zip("ορϲνϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "opcvjABEZHIKMNOPTYXCJ")),
    "armenian": dict(zip("օՕհս", "oOhu")),
    "latin": {"ɡ": "g", "ɑ": "a"},
}
# Compatibility kinds of the Unicode database that keep the look of a sign.
KEPT_LOOK = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<small>", "<initial>", "<medial>", "<final>", "<isolated>"}
# Format characters that do leave a mark.
VISIBLE_FORMAT = set(range(0x600, 0x606)) | {0x61C, 0x6DD, 0x70F, 0x8E2, 0x110BD, 0x110CD}

PIVOT = {c: p for s in ("cyrillic", "greek", "armenian") for c, p in LATIN_TWINS[s].items()}
_BACK = {s: {p: c for c, p in reversed(LATIN_TWINS[s].items())} for s in ("cyrillic", "greek", "armenian")}
#: Letters that say nothing about the script of a token, because another script has the same shape.
AMBIGUOUS = set(PIVOT) | set(PIVOT.values()) | set(LATIN_TWINS["latin"])

_FOREIGN = frozenset(map(chr, [*range(0x370, 0x590), *range(0x1F00, 0x2000), 0x251, 0x261]))
_TOKEN = re.compile("[^\\W_̀-ͯ][\\ẁ-ͯ҃-҇]*")
_CONTROL = re.compile("[\x00-\x08\x0e-\x1f\x7f]")
_JOINER = re.compile("(?<![←-⯿\U0001f000-\U0001faff])‍|‍(?![←-⯿\U0001f000-\U0001faff])")
_NOT_SIGN = re.compile("[^\\ẁ-ͯ҃-҇]+|_+")
_WORD = re.compile("[^\\W_][̀-ͯ҃-҇]*(?:[^\\W_][̀-ͯ҃-҇]*)*")
_PLAIN_WORD = re.compile("[^\\W_]+")
_MARK = re.compile("[\u0300-\u036f\u0483-\u0487]")
_ASCII_SPLIT = "".join(chr(i) if chr(i).isalnum() else " " for i in range(128))
_ASCII_DROP = {i: None for i in range(128) if not chr(i).isalnum()}


class _Looks(dict):
    """Translation table filled on demand from the Unicode database."""

    def __missing__(self, code: int):
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind == "Zs":
            to = ch if code in (0x20, 0x1680) else " "
        elif 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or code == 0x34F:
            to = None
        elif kind == "Cf" and code != 0x200D:
            to = ch if code in VISIBLE_FORMAT else None
        elif kind == "Cc" and ch not in "\t\n\v\f\r\x85":
            to = None
        else:
            tag, _, rest = unicodedata.decomposition(ch).partition(" ")
            if tag in KEPT_LOOK or (tag == "<compat>" and kind[0] in "LN" and ch not in "ſﬅ" and ch not in PIVOT):
                to = "".join(chr(int(x, 16)) for x in rest.split())
            else:
                to = ch
        self[code] = to
        return to


LOOKS = _Looks()
_same: set[str] = set()  # signs that LOOKS leaves as they are, among those met so far


def script(ch: str) -> str | None:
    """Script of a letter, as far as look-alikes concern it; None for other signs."""
    code = ord(ch)
    if code < 0x250 or 0x1E00 <= code < 0x1F00 or code in (0x251, 0x261):
        return "latin" if ch.isalpha() else None
    if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000:
        return "greek" if ch.isalpha() else None
    if 0x400 <= code < 0x530:
        return "cyrillic" if ch.isalpha() else None
    if 0x530 <= code < 0x590:
        return "armenian" if ch.isalpha() else None
    return None


def _leading(signs: str) -> str | None:
    """Script with most letters that only it has; None where no such letter is."""
    n = Counter(s for ch in signs if ch not in AMBIGUOUS and (s := script(ch)))
    if not n:
        return None
    most = max(n.values())
    top = sorted(s for s, k in n.items() if k == most)
    return top[0] if len(top) == 1 else "latin" if "latin" in top else top[0]


def _recast(token: str, to: str) -> str:
    """The token with every look-alike letter moved into script `to`."""
    out = []
    for ch in token:
        if ch in LATIN_TWINS["latin"]:
            ch = LATIN_TWINS["latin"][ch] if to == "latin" else ch
        elif ch in AMBIGUOUS and script(ch) != to:
            base = PIVOT.get(ch, ch)
            ch = base if to == "latin" else _BACK[to].get(base, ch)
        out.append(ch)
    return "".join(out)


def plain_look(text: str) -> str:
    """First step of the visual form: everything but look-alike letters. Decomposed where
    letters of other scripts occur, for the second step, else composed."""
    if text.isascii():
        return _CONTROL.sub("", text) if _CONTROL.search(text) else text
    odd = set(text) - _same
    if odd:
        if "\u200d" in odd:
            text = _JOINER.sub("", text.replace("\ufe0f", ""))
        for ch in odd:
            if ch != "\u200d" and LOOKS[ord(ch)] == ch:
                _same.add(ch)
        odd -= _same
        if len(odd) > 6:
            text = text.translate(LOOKS)
        else:
            for ch in odd:
                text = text.replace(ch, LOOKS[ord(ch)] or "")
    if text.isascii():
        return text
    return unicodedata.normalize("NFC" if _FOREIGN.isdisjoint(text) else "NFD", text)


_judged: dict[str, str] = {}  # tokens with their repair; "" where the whole text must tell


def repairs(looks: str) -> dict[str, str]:
    """Tokens of a `plain_look` text with look-alikes of a script that isn't the token's own,
    each with its proposed repair. A token's script is that of the letters only one script
    has; where it has none such, that of the whole text, or else Latin, if that script has all
    its letters."""
    if _FOREIGN.isdisjoint(looks):
        return {}
    whole, found = None, {}
    for m in _TOKEN.finditer(looks):
        token = m[0]
        if token in found or AMBIGUOUS.isdisjoint(token):
            continue
        better = _judged.get(token)
        if better is None:
            if len(_judged) > 200_000:
                _judged.clear()
            to = _leading(token)
            better = _judged[token] = _recast(token, to) if to else ""
        if not better:
            if whole is None:
                whole = _leading(looks) or Counter(s for ch in looks if (s := script(ch))).most_common(1)[0][0]
            better = next((b for b in (_recast(token, whole), _recast(token, "latin")) if len({script(ch) for ch in b if ch.isalpha()}) == 1), token)
        if better != token:
            found[token] = better
    return found


def apply_repairs(looks: str, found: dict[str, str]) -> str:
    """The composed text with the given tokens replaced."""
    if found:
        looks = _TOKEN.sub(lambda m: found.get(m[0], m[0]), looks)
    return looks if looks.isascii() else unicodedata.normalize("NFC", looks)


def visual_form(text: str) -> str:
    """The visual form with every proposed repair made. Two texts have equal forms exactly if
    they have equal forms under the vocabulary rule (see lookalike.py), so comparisons use this."""
    looks = plain_look(text)
    return looks if looks.isascii() else apply_repairs(looks, repairs(looks))


def signs(form: str) -> str:
    """Letters, digits and the marks upon them, case folded."""
    if form.isascii():
        return form.lower().translate(_ASCII_DROP)
    return unicodedata.normalize("NFC", _NOT_SIGN.sub("", unicodedata.normalize("NFC", form.casefold())))


def words(form: str) -> list[str]:
    """Runs of letters and digits, case folded."""
    if form.isascii():
        return form.lower().translate(_ASCII_SPLIT).split()
    form = unicodedata.normalize("NFC", form.casefold())
    return (_WORD if _MARK.search(form) else _PLAIN_WORD).findall(form)


def _western() -> tuple[bytes, bytes, bytes, bytes]:
    """Tables over the signs of code page 1252, as bytes: their look, those that have none, their
    case folded or a blank for those that are in no word, and those that the page doesn't tell. None of these signs
    combines with another or is a letter of another script, so each is judged alone."""
    look, drop, fold, rest = bytearray(range(256)), bytearray(), bytearray(b" " * 256), bytearray()
    for i in range(256):
        try:
            to = LOOKS[ord(bytes([i]).decode(PAGE))]
            if to is None:
                drop.append(i)
                continue
            (look[i],) = to.encode(PAGE)
            # the sharp s has two letters when folded, see `word_bytes`
            if to.isalnum():
                (fold[i],) = to.encode(PAGE) if to == "ß" else to.casefold().encode(PAGE)
        except (UnicodeError, ValueError):
            rest.append(i)
    return bytes(look), bytes(drop), bytes(fold), bytes(rest)


#: Code page of western texts, most of all texts.
PAGE = "cp1252"
_PAGE_LOOK, _PAGE_DROP, _PAGE_FOLD, _PAGE_REST = _western()


def word_bytes(text: str) -> tuple[str | bytes, bytes]:
    """The `visual_form`, as a string or in the bytes of code page 1252, and its `words` in UTF-8 with
    one or more blanks between them."""
    try:
        form = text.encode(PAGE)
    except UnicodeEncodeError:
        form = None
    if form is None or not form.isascii() and len(form.translate(None, _PAGE_REST)) < len(form):
        look = visual_form(text)
        return look, " ".join(words(look)).encode("utf-8", "surrogatepass")
    form = form.translate(_PAGE_LOOK, _PAGE_DROP)
    folded = form.translate(_PAGE_FOLD)
    return form, folded if folded.isascii() else folded.replace(b"\xdf", b"ss").decode(PAGE).encode()


def word_record(form: str | bytes) -> str | None:
    """`record_key` of a form as `word_bytes` has it."""
    if isinstance(form, str):
        return record_key(form)
    # no record is without one of these signs
    return record_key(form.decode(PAGE)) if b"\n" in form or b"|" in form or b";" in form or b"{" in form else None


_NAME = "[ \\t]*([^\\W\\d_][\\w\\-]*(?: [\\w\\-]+){0,2})[ \\t]*"
_START = re.compile(_NAME + "[:=]")
_LAYOUTS = [(sep, re.compile(_NAME + mark)) for sep in ("\n", "|", ";") for mark in (":", "=")]


def _flat(value) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def fields(form: str) -> list[tuple[str, str]] | None:
    """Names and values of a text made of two or more labelled fields, else None: a JSON object,
    or `name: value` / `name=value` divided by line breaks, bars or semicolons. A piece without
    a name goes on the value before it; the layout with most names counts."""
    bare = form.strip()
    if bare[:1] == "{" and bare[-1:] == "}":
        try:
            pairs = json.loads(bare, strict=False, object_pairs_hook=list)
        except (ValueError, RecursionError):
            pairs = None
        if isinstance(pairs, list) and pairs:
            return [(visual_form(k), visual_form(_flat(v))) for k, v in pairs]
    if ("\n" not in bare and "|" not in bare and ";" not in bare) or not _START.match(bare):
        return None
    best: list[list[str]] = []
    for sep, mark in _LAYOUTS:
        if sep not in bare:
            continue
        got: list[list[str]] = []
        for piece in bare.split(sep):
            m = mark.match(piece)
            if m:
                got.append([m[1], piece[m.end() :]])
            elif got:
                got[-1][1] += sep + piece
            elif piece.strip():
                break
        if len(got) > max(1, len(best)):
            best = got
    return [(k, v) for k, v in best] or None


def same_keys(form: str) -> tuple[str, str | None]:
    """The text's letters and digits, and for a record also its sorted fields."""
    plain = signs(form)
    return plain, record_key(form) if plain else None


def record_key(form: str) -> str | None:
    """The sorted fields of a record; None for other texts."""
    got = fields(form)
    if not got:
        return None
    return "\x1e".join(sorted(f"{signs(k)}\x1f{signs(v)}" for k, v in got))
