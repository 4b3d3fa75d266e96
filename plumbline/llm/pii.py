"""Problem 9: personal data in free text, by a semi-Markov conditional random field.

A segmentation cuts the text into entities and the gaps between them. Candidate entities are spans
of bounded length, proposed widely by shape: every stretch of digit groups, every chain of name
parts, every street with any part of its tail. A log-linear model over features of the whole span and
of the words beside it scores each candidate; dynamic programming over the span ends chooses
boundaries and types jointly. Weights are fitted by maximum likelihood, with the forward and
backward sums over all segmentations, on generated sentences whose entities are known; the number
of those sentences is a fixed parameter. Nothing but the list of names comes from outside.
"""

from __future__ import annotations

import bisect
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "address", "name")
#: Longest entity in characters; a longer match isn't proposed.
BOUND = 160
#: Names known to the model: a list beyond this size is refused, as each task holds it.
MOST_NAMES = 2_000_000
#: Parts of the longest name, initials among them.
MOST_PARTS = 8
TRAINING_SENTENCES = 8000
EPOCHS = 5
#: Share of the training texts whose neighbouring words are hidden, so that shapes and classes learn to do without.
HIDDEN = 0.4

# Words and abbreviations of streets, and those that end a house number or flat.
STREETS = "street road lane way avenue close court crescent drive boulevard place square terrace row gardens walk grove hill view park st rd ln ave ct cres dr blvd pl sq".split()
DOTTED_STREETS = {"st", "rd"}
ROMANCE_STREETS = "calle avenida paseo plaza camino rua travessa praça largo alameda rue avenue boulevard place chemin impasse allée quai via piazza viale corso".split()
FLATS = "flat apt apartment unit suite".split()
ARTICLES = {"the", "a", "an", "our", "your", "my", "this", "that", "his", "her", "their", "and", "of"}
DIGIT_WORDS = "zero oh one two three four five six seven eight nine".split()
TITLES = "mr ms mrs dr prof miss herr frau señor señora sr sra senhor senhora madame monsieur mme m".split()

# Kinds of words that stand beside entities, and beside what only resembles them.
_KINDS_OF_WORDS = {
    "identity": "passport passports ssn nin nino nie dni cpf rg social security insurance national identity identification id tax taxpayer licence license permit pasaporte documento passaporte cidadão passeport identité sociale reisepass personalausweis ausweis ausweisnummer sozialversicherungsnummer ausweisnr",
    "thing": "ticket tickets order orders invoice invoices run runs thread threads build builds version batch serial part model tracking parcel shipment case issue bug commit page pages row rows line lines room seat flight train bus route exit item article sku isbn ref reference booking reservation receipt job log step epoch seed port error pr chapter section request bestellung auftrag rechnung vorgang pedido factura expediente envío commande facture dossier colis encomenda fatura processo",
    "phone": "call calls called ring rang phone phoned telephone tel telefon cell mobile landline hotline dial dialled text sms whatsapp fax number reach extension handy handynummer ruf rufen móvil teléfono llámame llame liga ligue telefone telemóvel número numéro portable téléphone appelez appelle nummer",
    "mail": "mail mails email e-mail inbox write wrote contact reply-to reply from to cc address escribe schreib écris escreve",
    "lives": "live lives lived living moved moving address house flat home office ship deliver deliver located send post wohne wohnen adresse vivo vive dirección moro endereço habite habitons",
    "place": "town city village river lake county port valley bay flights trains road museum bridge station institute festival north south east west",
    "person": "name author patient customer applicant tenant driver owner user guest passenger holder speaker attendee regards wishes cheers sincerely thanks dear hello hi hey signed by grüßen grüße gruß hallo saludos abrazo atentamente hola cordialement bonjour salut abraços cumprimentos olá",
    "says": "said says wrote told claims thinks asked is was has had will would can did does agreed called came left knows and or",
    "where": "in near at around through towards outside inside into",
    "article": "the a an this that these those some any every no my our your his her their its der die das ein eine el la un una los las le les une des o um uma",
    "small": "of for with as but not so very then if when about on until",
}
_KIND_OF_WORD = {w: k for k, words in _KINDS_OF_WORDS.items() for w in words.split()}

ABBREVIATED = {"mr", "ms", "mrs", "dr", "prof", "sr", "sra", "mme"}

_AT = r"(?:\s?[@＠]\s?|\s?[\[(]\s?(?:at|arroba|chez)\s?[\])]\s?|\s(?:at|arroba|ät)\s)"
_DOT = r"(?:[.．]|\s?[\[(]\s?(?:dot|punto|punkt|ponto|point)\s?[\])]\s?|\s(?:dot|punto|punkt|ponto)\s)"
_EMAIL = re.compile(rf"(?<![\w.+\-])[\w][\w.+\-]*{_AT}\w[\w\-]*(?:{_DOT}\w[\w\-]*)+", re.I)
_GROUP = re.compile(r"\d+")
_RUN = re.compile(r"(?<![\w])[+(]{0,3}\d[\d\-./() ]{4,}\d")
_EXTENSION = re.compile(r",?\s?(?:ext\.?|extension|x|durchwahl|poste|ramal)\s?\d{1,6}(?!\w)", re.I)
_SPELT = re.compile(rf"(?<!\w)(?:{'|'.join(DIGIT_WORDS)})(?:[ ,\-]{{1,2}}(?:{'|'.join(DIGIT_WORDS)})){{5,14}}(?!\w)", re.I)
_ID = re.compile(
    r"(?<![\w.\-/+])(?:[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|[A-Z]{1,2}[ \-]?\d{3}[ \-]?\d{4}|[A-Z]{1,3}\d{6,9}|\d{8}[ \-]?[A-Z]|\d{7}[ \-]?[A-Z]|\d{3}[ \-.]?\d{2}[ \-.]?\d{4}|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{7,12})(?![\w]|[\-/.]\d)",
    re.I,
)
_WORD = r"[^\W\d_][^\W\d_'’\-]*(?:['’\-][^\W\d_]+)*"
_NUMBER = r"\d{1,4}(?:/\d{1,4})?[a-z]?"
_TOWN = re.compile(rf",[ \xa0](?:(?P<code>\d{{4,6}})[ \xa0])?(?P<town>{_WORD}(?:[ \xa0]{_WORD})?)(?P<after>[ \xa0]\d{{4,6}})?(?!\w)", re.I)
_FLAT = re.compile(rf",?[ \xa0](?:#[ \xa0]?\d+[a-z]?|(?:{'|'.join(FLATS)})\.?[ \xa0]\d+[a-z]?|\d{{1,2}}[ºª°](?:[ \xa0][a-z](?!\w))?)(?!\w)", re.I)
_ENGLISH = re.compile(rf"(?<![\w/.#\-]){_NUMBER}[ \xa0](?:{_WORD}[ \xa0]){{1,4}}?(?:{'|'.join(STREETS)})(?!\w)(?:[ \xa0](?:{'|'.join(STREETS)})(?!\w))?", re.I)
_GERMAN = re.compile(rf"(?<!\w)[^\W\d_]{{2,}}(?:straße|strasse|str\.|weg|allee|platz|gasse|ring|ufer|damm)[ \xa0]\d{{1,4}}[ \xa0]?[a-z]?(?!\w)", re.I)
_LINK = r"(?:(?:de|del|la|las|los|da|do|das|dos|des|du|le|les|el)[ \xa0]|[ld]['’])"
_ROMANCE = re.compile(rf"(?<!\w)(?:(?:{'|'.join(ROMANCE_STREETS)})|r\.|av\.|c/)[ \xa0]{_LINK}{{0,2}}{_WORD}(?:[ \xa0]{_WORD})?(?:,[ \xa0]?|[ \xa0])(?:n[º°.o]{{1,2}}[ \xa0]?|número[ \xa0])?{_NUMBER}(?!\w)", re.I)
_FRENCH = re.compile(rf"(?<![\w/.#\-])\d{{1,4}}(?:[ \xa0]?(?:bis|ter))?,?[ \xa0](?:{'|'.join(ROMANCE_STREETS)})[ \xa0]{_LINK}{{0,2}}{_WORD}(?:[ \xa0](?:{_LINK}{{0,2}}){_WORD})?(?!\w)", re.I)
_PART = re.compile(r"[^\W\d_][^\W\d_]*(?:['’][^\W\d_]{2,})*(?:-[^\W\d_]+)*")
_INITIAL = re.compile(r"[^\W\d_]\.")
# what must stand in a text for the longer patterns above to find anything
_AT_GATE = re.compile(r"[\[(]\s?(?:at|arroba|chez)\s?[\])]|\s(?:at|arroba|ät)\s\w[\w\-]*(?:[.．]\w|\s?[\[(]|\s(?:dot|punto|punkt|ponto)\s)", re.I)
_GERMAN_ENDS = ("straße", "strasse", "str.", "weg", "allee", "platz", "gasse", "ring", "ufer", "damm")
_DOT_WORDS = {"dot", "punto", "punkt", "ponto", "point"}
_INNER_DOT = re.compile(r"\w[.．]\w")
_AT_WORDS = {"at", "arroba", "ät", "chez"}
_STREET_WORDS = set(STREETS)
_ROMANCE_WORDS = {*ROMANCE_STREETS, "r", "av", "c"}
_DIGIT_SET = set(DIGIT_WORDS)
_TITLE_SET = set(TITLES)
_OFFSETS = {marks: sorted({k for m in marks for k in {"k": (0, -1, -2), "i": (0,), "t": (1,)}[m]}) for marks in ("k", "i", "t", "ki", "kt", "it", "kit")}


class Names:
    """The list of names: listed parts, endings and beginnings that several of them share, and how
    often each stands in lower case in the corpus."""

    def __init__(self, given: set[str], family: set[str], common: dict[str, float]):
        self.given, self.family = {g.casefold() for g in given}, {f.casefold() for f in family}
        self.common = common
        cuts = [(name[:k], name[k:]) for name in self.given | self.family for k in range(3, len(name) - 2)]
        heads, tails = Counter(h for h, _ in cuts), Counter(t for _, t in cuts)
        # a cut counts where both its sides occur in several names
        cuts = [(h, t) for h, t in cuts if heads[h] > 2 and tails[t] > 2]
        heads, tails = Counter(h for h, _ in cuts), Counter(t for _, t in cuts)
        self.heads = {h for h, n in heads.items() if n > 2}
        self.tails = {t for t, n in tails.items() if n > 2}
        self._memo: dict[str, str] = {}
        self._marks: dict[str, str] = {}

    def kind(self, part: str) -> str:
        """g, f: listed as given or family name; b: as both; c: made like listed names; u: unknown."""
        return self.kinds([part])[0]

    def marks(self, parts: list[str]) -> list[str]:
        """For each part "" if no name can begin near it, else what makes it one: k, i and t for a known
        part, an initial and a title."""
        memo = self._marks
        got = list(map(memo.get, parts))
        if None in got:
            if len(memo) > 200_000:
                memo.clear()
            for part, kind in zip(parts, self.kinds(parts)):
                memo[part] = ("k" if kind != "u" else "") + ("i" if len(part) == 1 else "") + ("t" if part.casefold() in _TITLE_SET else "")
            got = list(map(memo.get, parts))
        return got

    def kinds(self, parts: list[str]) -> list[str]:
        """The kind of each part."""
        memo = self._memo
        got = list(map(memo.get, parts))
        if None in got:
            if len(memo) > 200_000:
                memo.clear()
            for part in parts:
                if part not in memo:
                    memo[part] = self._kind(part.casefold())
            got = list(map(memo.get, parts))
        return got

    def _kind(self, part: str) -> str:
        parts = part.split("-")
        kinds = set()
        for p in parts:
            g, f = p in self.given, p in self.family
            if g or f:
                kinds.add("b" if g and f else "g" if g else "f")
            elif any(p[:k] in self.heads and p[k:] in self.tails for k in range(3, len(p) - 2)):
                kinds.add("c")
            else:
                kinds.add("u")
        for k in ("g", "f", "b", "c"):
            if k in kinds:
                return k
        return "u"

    def ordinary(self, part: str) -> bool:
        """Whether the word stands in lower case in the corpus more often than as a name."""
        return self.common.get(part.casefold(), 0.0) > 0.6


def _case(s: str) -> str:
    letters = [c for c in s if c.isalpha()]
    if not letters:
        return "none"
    if all(c.isupper() for c in letters) and len(letters) > 1:
        return "upper"
    return "title" if letters[0].isupper() else "lower"


def _next(text: str, b: int) -> str:
    """The kind of what follows a span: a word in lower or upper case, a digit, a sign, a new line, the end."""
    rest = text[b : b + 4].lstrip(" ")
    c = rest[:1]
    return "end" if not c else "line" if c == "\n" else "digit" if c.isdigit() else "upper" if c.isupper() else "lower" if c.isalpha() else c


def _shape(s: str) -> str:
    return re.sub(r"[^\W\d_]", "A", re.sub(r"\d", "9", re.sub(r"\s", " ", s)))


_TOKENS = re.compile(r"[^\W_]+(?:-[^\W\d_]+)*|[^\w\s]")
_FOLLOWS = re.compile(r"\s*([^\W_]+|[^\w\s]|$)")


def _beside(text: str, a: int, b: int) -> list[str]:
    """Features of what stands beside a span: the words before and after, their kinds, the signs. Words
    themselves are marked by a star."""
    tokens = [w.casefold() for w in _TOKENS.findall(text[max(0, a - 40) : a])]
    after = _FOLLOWS.match(text[b : b + 30])
    following = after[1].casefold() if after else ""
    last = tokens[-1] if tokens else "^"
    lasts = [w for w in tokens if w[0].isalnum()][-4:]
    tight = text[a - 1] if a else "^"
    word = lasts[-1] if lasts else "^"
    kinds = [_KIND_OF_WORD.get(w, "other") for w in lasts]
    out = [
        f"*p={last}", f"*n={following}", f"*w={word}",
        f"pk={_KIND_OF_WORD.get(last, 'word' if last[0].isalpha() else 'digit' if last[0].isdigit() else last)}",
        f"nk={_KIND_OF_WORD.get(following, 'word' if following[:1].isalpha() else 'digit' if following[:1].isdigit() else following)}",
        f"wk={' '.join(kinds[-2:]) if kinds else '^'}", f"t={tight if not tight.isalnum() else 'A'}",
    ]
    out += [f"near={k}" for k in set(kinds) if k not in ("other", "small")]
    return out


def candidates(text: str, names: Names) -> list[tuple[int, int, str, list[str]]]:
    """(start, end, kind, features) of every span that may be an entity."""
    found: dict[tuple[int, int, str], list[str]] = {}

    def add(a: int, b: int, kind: str, features: list[str]) -> None:
        if 0 < b - a <= BOUND and (a, b, kind) not in found:
            found[a, b, kind] = [f"{kind}:{f}" for f in ["one", *features, *_beside(text, a, b)]]

    shown = _PART.findall(text)
    words = set(map(str.casefold, shown))
    if "@" in text or "＠" in text or not _AT_WORDS.isdisjoint(words) and _written_out(text, words):
        for m in _EMAIL.finditer(text):
            plain = "@" in m[0] or "＠" in m[0]
            add(m.start(), m.end(), "email", ["sign" if plain else "word", f"dots={min(3, len(re.findall(_DOT, m[0], re.I)))}"])
    groups_at = [m.start() for m in _GROUP.finditer(text)]
    if groups_at:
        for m in _RUN.finditer(text):
            groups = list(_GROUP.finditer(m[0]))
            for i in range(len(groups)):
                digits = 0
                for j in range(i, len(groups)):
                    digits += len(groups[j][0])
                    if digits > 15:
                        break
                    if digits < 7 or (i == j and len(groups) > 1 and digits < 9):
                        continue
                    a, b = groups[i].start(), groups[j].end()
                    inner = m[0][a:b]
                    lead = m[0][max(0, a - 2) : a]
                    if lead[-1:] == "+":
                        a -= 1
                    elif lead[-1:] == "(" and inner.count(")") > inner.count("("):
                        a -= 2 if lead == "+(" else 1
                    span = m[0][a:b]
                    if span.count("(") != span.count(")") or ". " in span:
                        continue
                    features = [f"shape={_shape(span)}", f"digits={digits}", f"groups={j - i + 1}", f"from={i == 0}", f"to={j == len(groups) - 1}", f"lead={span[0] if span[0] in '+(' else span[:1] if span[0] in '01' else '9'}"]
                    s, e = m.start() + a, m.start() + b
                    if e < len(text) and text[e].isalnum() or s and text[s - 1].isalnum():
                        features.append("glued")
                    add(s, e, "phone", features)
                    x = _EXTENSION.match(text, e)
                    if x:
                        add(s, x.end(), "phone", [*features, "extension"])
        for m in _identities(text, groups_at):
            add(m.start(), m.end(), "id_number", [f"shape={_shape(m[0])}", f"digits={sum(c.isdigit() for c in m[0])}", f"letters={sum(c.isalpha() for c in m[0])}"])
        # a street needs one of its words, so most texts are never searched for one
        romance = not _ROMANCE_WORDS.isdisjoint(words)
        forms = [("en", _ENGLISH, not _STREET_WORDS.isdisjoint(words)), ("de", _GERMAN, any(text[max(0, g - 9) : g - 1].lower().endswith(_GERMAN_ENDS) for g in groups_at if g > 3)), ("ro", _ROMANCE, romance), ("fr", _FRENCH, romance)]
        for form, pattern in ((form, pattern) for form, pattern, possible in forms if possible):
            for m in pattern.finditer(text):
                b = m.end()
                last = re.search(r"[^\W\d_]+$", m[0])
                if last and last[0].casefold() in DOTTED_STREETS and text[b : b + 1] == ".":
                    b += 1
                base = [f"form={form}", f"case={_case(re.sub(r'^[0-9/]+[a-z]?', '', m[0], flags=re.I).strip() or 'a')}", f"words={len(m[0].split())}"]
                if form == "en":
                    middle = m[0].split()[1:-1]
                    base.append("kinds=" + "".join(sorted({_case(w)[0] for w in middle})))
                    if ARTICLES & {w.casefold() for w in middle}:
                        base.append("article")
                ends = [(b, "bare")]
                if form == "fr" or form == "en" and base[2] != "words=3":
                    # the last word may belong to what follows
                    short = m[0].rsplit(None, 1)[0]
                    if form == "fr" or re.search(rf"(?i)\s(?:{'|'.join(STREETS)})$", short):
                        ends.append((m.start() + len(short) + (short.split()[-1].casefold() in DOTTED_STREETS and text[m.start() + len(short)] == "."), f"short {_case(m[0].split()[-1])}"))
                x = _FLAT.match(text, b)
                if x:
                    ends.append((x.end(), "flat"))
                for e, tail in list(ends):
                    t = _TOWN.match(text, e)
                    if t:
                        town = t["town"].split()
                        kind = _case(town[0])
                        same = "same" if kind == base[1][5:] or kind == "title" else "other"
                        one = t.start("town") + len(town[0])
                        code = "code" if t["code"] or t["after"] else "nocode"
                        if len(town) == 1 and t["after"]:
                            ends.append((t.end(), f"{tail}+town+{code}+{kind}+{same}"))
                        if not t["after"] or len(town) > 1:
                            ends.append((one, f"{tail}+town+{'code' if t['code'] else 'nocode'}+{kind}+{same}"))
                        if len(town) == 2:
                            ends.append((t.end(), f"{tail}+town2+{code}+{_case(town[1])}"))
                for e, tail in ends:
                    add(m.start(), e, "address", [*base, f"tail={tail}", f"{form}/{tail.split('+')[0]}", f"{form}/{tail}/{_next(text, e)}"])
    for m in _SPELT.finditer(text) if not _DIGIT_SET.isdisjoint(words) else ():
        add(m.start(), m.end(), "phone", ["spelt", f"count={len(re.findall('[a-zA-Z]+', m[0]))}"])
    _name_candidates(text, shown, names, add)
    return sorted((a, b, kind, f) for (a, b, kind), f in found.items())


def _written_out(text: str, words: set[str]) -> bool:
    """Whether an address without its sign may stand in the text."""
    return ("[" in text or "(" in text or not _DOT_WORDS.isdisjoint(words) or _INNER_DOT.search(text) is not None) and _AT_GATE.search(text) is not None


def _identities(text: str, groups_at: list[int]) -> Iterator[re.Match]:
    """The matches of _ID. Its first digit stands among its first five signs, so only there, before each
    group of digits, is it tried."""
    upto = 0
    for g in groups_at:
        for at in range(max(upto, g - 4), g + 1) if g >= upto else ():
            m = _ID.match(text, at)
            if m:
                yield m
                upto = m.end()
                break


def _name_candidates(text: str, shown: list[str], names: Names, add) -> None:
    # where a name may begin: at a known part or up to two before it, after a title, at an initial
    starts: set[int] = set()
    for i, mark in enumerate(names.marks(shown)):
        if mark:
            starts.update((i + k for k in _OFFSETS[mark]))
    if not starts:
        return
    kinds = names.kinds(shown)
    parts = [(a, b, part) for (a, b), part in zip(map(re.Match.span, _PART.finditer(text)), shown)]
    n = len(parts)

    def joined(i: int, j: int) -> str | None:
        """How part j follows part i: by a blank, a comma and a blank, or not at all."""
        gap = text[parts[i][1] : parts[j][0]]
        return {" ": " ", ", ": ","}.get(gap)

    for i in sorted(starts):
        if not 0 <= i < n:
            continue
        titled = i > 0 and parts[i - 1][2].casefold() in TITLES and text[parts[i - 1][1] : parts[i][0]] in (" ", ". ")
        if titled:
            title, gap = parts[i - 1][2], text[parts[i - 1][1] : parts[i][0]]
            if len(title) == 1:  # "M. Dupont", but not "I'm late" or "5 m. The"
                titled = text[parts[i - 1][0] - 1 : parts[i][0]].lstrip() == "M. "
            else:  # only an abbreviation is followed by a point within a name
                titled = gap == " " or title.casefold() in ABBREVIATED
        initialled = len(parts[i][2]) == 1 and parts[i][2].isalpha() and i + 1 < n and len(parts[i + 1][2]) > 2 and text[parts[i][1] : parts[i + 1][0]] == ". "
        if kinds[i] == "u" and not titled and not (i + 1 < n and kinds[i + 1] != "u" and joined(i, i + 1)) and not (i + 2 < n and kinds[i + 2] != "u" and len(parts[i + 1][2]) == 1):
            # an unknown part begins a name only after a title, before a known part or as an initial
            if not initialled:
                continue
        j = i
        form, known = "", 0
        last_end = parts[i][0]
        while j < n and j - i < MOST_PARTS:
            a, b, part = parts[j]
            if j > i:
                gap = text[last_end:a]
                if gap not in (" ", ", "):
                    break
                if gap == ", ":
                    form += ","
            if len(part) == 1 and part.isalpha() and text[b : b + 1] == "." and part.isascii():
                form += "I"
                last_end = b + 1
                j += 1
                continue
            k = kinds[j]
            known += k != "u"
            form += k + ("-" if "-" in part else "")
            last_end = b
            j += 1
            if not known and not titled and not (initialled and form[-1:] == "u" and j - i == 2):
                continue
            if form.count(",") > 1:
                break
            words = [p for _, _, p in parts[i:j] if len(p) > 1]
            cases = "".join(sorted({_case(p)[0] for p in words}))
            ordinary = sum(names.ordinary(p) for p in words)
            start, end = parts[i][0], last_end
            features = [f"form={form}", f"case={cases}", f"form+case={form}/{cases}", f"ordinary={ordinary}/{len(words)}", f"form/next={form}/{_next(text, end)}", f"title={parts[i - 1][2].casefold() + '/' + _case(parts[i - 1][2]) + '/' + cases if titled else ''}", f"known={known}/{len(words)}", f"parts={j - i}/{known}"]
            if any(k == "u" and names.ordinary(p) for k, (_, _, p) in zip(kinds[i:j], parts[i:j])):
                features.append("unknown ordinary")
            left = text[start - 1] if start else "^"
            right = text[end : end + 1]
            if left in "@#_/+.-=" or left.isdigit() or right in ("@", "＠", "_", "+") or right.isdigit():
                features.append("handle")
            opens = not text[max(0, start - 2) : start].strip(" ") or text[:start].rstrip(" ")[-1:] in ".!?\n:"
            features.append(f"opens={opens}/{ordinary}/{len(words)}/{cases}")
            # what could still belong to the name beside the span
            if j < n and kinds[j] != "u" and text[end : parts[j][0]] in (" ", ", ", " "):
                features.append(f"more right={kinds[j]}/{text[end : parts[j][0]].strip() or '_'}")
            if i and kinds[i - 1] != "u" and text[parts[i - 1][1] : start] in (" ", ", "):
                features.append(f"more left={kinds[i - 1]}/{text[parts[i - 1][1] : start].strip() or '_'}")
            if i and len(parts[i - 1][2]) == 1 and text[parts[i - 1][1] : start] == ". ":
                features.append("initial left")
            add(start, end, "name", features)
            if _case(parts[j - 1][2]) == "lower" and kinds[j - 1] == "u":
                break


def _sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


class Model:
    """Weights of the segment features."""

    def __init__(self, names: Names):
        self.names = names
        self.weights: dict[str, float] = defaultdict(float)

    def score(self, features: list[str]) -> float:
        w = self.weights
        return sum(w[f] for f in features if f in w)

    def segments(self, text: str) -> list[tuple[int, int, str]]:
        """The best segmentation's entities: dynamic programming over candidate ends."""
        spans = candidates(text, self.names)
        if not spans:
            return []
        spans.sort(key=lambda s: s[1])
        ends = [s[1] for s in spans]
        best, back = [0.0], [-1]
        for k, (a, b, kind, features) in enumerate(spans):
            at = bisect.bisect_right(ends, a, 0, k)
            score = best[at] + self.score(features)
            if score > best[k]:
                best.append(score)
                back.append(at)
            else:
                best.append(best[k])
                back.append(-1)
        out, k = [], len(spans)
        while k > 0:
            if back[k] >= 0:
                out.append(spans[k - 1][:3])
                k = back[k]
            else:
                k -= 1
        return out[::-1]

    def fit(self, examples: list[tuple[str, set[tuple[int, int, str]]]], epochs: int = EPOCHS, seed: int = 7, rate: float = 0.4, decay: float = 1e-4) -> Model:
        """Stochastic gradient ascent on the log-likelihood with per-weight step sizes."""
        rng = random.Random(seed)
        prepared = []
        for text, truth in examples:
            spans = sorted(candidates(text, self.names), key=lambda s: s[1])
            if spans:
                if rng.random() < HIDDEN:
                    spans = [(a, b, k, [f for f in features if ":*" not in f]) for a, b, k, features in spans]
                prepared.append((spans, [(a, b, k) in truth for a, b, k, _ in spans]))
        squares: dict[str, float] = defaultdict(float)
        for _ in range(epochs):
            rng.shuffle(prepared)
            for spans, gold in prepared:
                grad: dict[str, float] = defaultdict(float)
                for (_, _, _, features), true, p in zip(spans, gold, self._marginals(spans)):
                    if abs(true - p) > 1e-3:
                        for f in features:
                            grad[f] += true - p
                for f, g in grad.items():
                    g -= decay * self.weights[f]
                    squares[f] += g * g
                    self.weights[f] += rate * g / (1e-6 + math.sqrt(squares[f]))
        return self

    def _marginals(self, spans: list[tuple[int, int, str, list[str]]]) -> list[float]:
        """Probability of each candidate over all segmentations, by forward and backward sums."""
        ends = [s[1] for s in spans]
        scores = [self.score(s[3]) for s in spans]
        before = [bisect.bisect_right(ends, s[0], 0, k) for k, s in enumerate(spans)]
        forward = [0.0]
        for k, s in enumerate(scores):
            forward.append(_sum([forward[k], forward[before[k]] + s]))
        outside = [-math.inf] * len(spans) + [0.0]
        inside = [0.0] * len(spans)
        for k in range(len(spans), 0, -1):
            # the state after the first k spans is left either by skipping span k or by taking it
            here = outside[k]
            outside[k - 1] = here if outside[k - 1] == -math.inf else _sum([outside[k - 1], here])
            inside[k - 1] = here + scores[k - 1]
            at = before[k - 1]
            outside[at] = inside[k - 1] if outside[at] == -math.inf else _sum([outside[at], inside[k - 1]])
        total = forward[-1]
        return [min(1.0, math.exp(forward[before[k]] + inside[k] - total)) for k in range(len(spans))]


def _lower_shares(texts: DataFrame, parts: list[str]) -> dict[str, float]:
    """How often each listed name stands in lower case, over all texts. As many rows come back as
    there are names on the list."""
    listed = {p.casefold() for p in parts}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for b in batches:
            for text in b.column("text").to_pylist():
                for word in re.findall(r"(?<![\w.@+\-])[^\W\d_]+(?![\w@+]|\.\w)", text or ""):
                    w = word.casefold()
                    if w in listed:
                        n[w][0] += word.islower()
                        n[w][1] += 1
        rows = list(n.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in rows], pa.string()), pa.array([x[0] for _, x in rows], pa.int64()), pa.array([x[1] for _, x in rows], pa.int64())],
            names=["word", "low", "n"],
        )

    got = texts.mapInArrow(run, "word string, low long, n long").groupBy("word").agg(F.sum("low").alias("low"), F.sum("n").alias("n"))
    return {r["word"]: r["low"] / r["n"] for r in got.collect()}


def fitted(documents: DataFrame, person_names: DataFrame, text_col: str = "text", sentences: int = TRAINING_SENTENCES) -> Model:
    """The model for a list of names and a corpus, whose lower-case counts cover all documents."""
    # a list of names, not a table of documents: its size is checked before it is read
    if person_names.limit(MOST_NAMES + 1).count() > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names")
    rows = [(r["name_part"].strip(), (r["part_kind"] or "").strip().lower()) for r in person_names.select("name_part", "part_kind").dropna(subset=["name_part"]).collect()]
    given, family = {n for n, k in rows if k != "family" and n}, {n for n, k in rows if k == "family" and n}
    texts = documents.select(F.col(text_col).cast("string").alias("text"))
    names = Names(given, family, _lower_shares(texts, sorted(given | family)))
    ordinary = [n.lower() for n in given | family if names.ordinary(n)]
    key = (frozenset(names.given), frozenset(names.family), frozenset(ordinary), sentences)
    if key not in _fitted:  # fitting again would give the same weights
        _fitted.clear()
        _fitted[key] = _fit(names, given, family, ordinary, sentences)
    model = Model(names)
    model.weights = _fitted[key]
    return model


_fitted: dict[tuple, dict[str, float]] = {}


def _fit(names: Names, given: set[str], family: set[str], ordinary: list[str], sentences: int) -> dict[str, float]:
    from plumbline.llm.pii_training import examples

    return Model(names).fit(examples(list(given), list(family), ordinary, list(names.heads), list(names.tails), sentences)).weights


def personal_data(documents: DataFrame, person_names: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, surface): each distinct piece of personal data of a document, exactly as it
    stands in the text. Null, empty and blank texts have none; an empty table gives no rows; of
    repeated documents with one id each piece counts once."""
    model = documents.sparkSession.sparkContext.broadcast(fitted(documents, person_names, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if text:
                    rows += sorted({(doc, kind, text[x:y]) for x, y, kind in model.value.segments(text)}, key=lambda r: r[1:])
            cols = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()))], names=["doc_id", "kind", "surface"])

    src = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, kind string, surface string").distinct()


def masked(documents: DataFrame, person_names: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): every text with its personal data replaced by placeholders such as [NAME]
    and the rest unchanged; null texts stay null. One row for each row of `documents`."""
    model = documents.sparkSession.sparkContext.broadcast(fitted(documents, person_names, text_col))

    def mask(text: str) -> str:
        out, at = [], 0
        for a, b, kind in model.value.segments(text):
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        return "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([mask(t) if t else t for t in b.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), texts], names=["doc_id", "text"])

    src = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, text string")
