"""Personal information in free text: found by a semi-Markov conditional random field, and replaced.

Whole spans are scored, not words: a generator proposes every span that has the form of an e-mail
address, phone number, identity number, postal address or name, with all ends it may have; features of
the span and of what stands around it are summed with trained weights; and a dynamic program over the
spans picks the set without overlaps, with their types, that scores best. A span left out scores 0, so
the threshold is the model's own. Spans are bounded in length, so texts of any length take linear time.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import NamedTuple

TYPES = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
#: Two spans closer than this are scored together; no span reaches further for its surroundings.
NEAR = 24

# Words of street names in five languages.
STREETS = (
    "street st road rd lane ln close avenue ave av drive dr way court ct square sq place pl terrace crescent hill row gardens boulevard blvd parade walk mews park highway "
    "strasse straße str gasse weg allee platz ring ufer damm steig chaussee rue chemin impasse quai cours route passage sentier ruelle voie allée "
    "calle avenida camino plaza paseo carrera ronda travesía glorieta carretera callejón straat laan gracht plein kade dijk steeg"
).split()
_STREET = re.compile(r"(?i)\b(?:" + "|".join(map(re.escape, sorted(STREETS, key=len, reverse=True))) + r")\b\.?|(?<=[a-zäöüß])(?:straße|strasse|str\.|gasse|weg|allee|platz|ring|ufer|damm|straat|laan|plein|gracht)\b")
# Words that close a letter; the name below them is no second half of theirs.
CLOSINGS = frozenset(
    "regards cheers thanks best sincerely yours thank grüße gruß grüssen gruss grüßen dank cordialement merci bien salutations amitiés saludos atentamente gracias abrazo groeten groet bedankt "
    "hello hi dear team hallo guten morgen tag liebe lieber bonjour salut hola buenos días buenas beste".split()
)
# What a text calls an identity number.
_ID_CUES = (
    ("ssn", r"(?:u\.?s\.? )?social security(?: (?:number|no\.?|nr\.?|#))?|ssn|sozialversicherungs(?:nummer|nr\.?)|num[ée]ro de s[ée]curit[ée] sociale|n[úu]mero de (?:la )?seguridad social|burgerservicenummer|bsn"),
    ("nino", r"national insurance(?: (?:number|no\.?|nr\.?))?|nino|ni (?:number|no\.?)"),
    ("passport", r"(?:passport|travel document)(?: (?:number|no\.?|nr\.?|#))?|reisepass(?:nummer|-?nr\.?)?|passnummer|reisedokument(?:ennummer)?|(?:num[ée]ro de )?passeport|document de voyage|(?:n[úu]mero de )?pasaporte|documento de viaje|paspoort(?:nummer)?|reisdocument"),
    ("card", r"(?:national )?(?:identity|id)(?: |-)card(?: (?:number|no\.?|nr\.?|#))?|identity (?:number|no\.?)|id (?:number|no\.?)|(?:personal)?ausweis(?:nummer|-?nr\.?)?|carte (?:nationale )?d['’]identit[ée]|documento (?:nacional )?de identidad|dni|cni|identiteitskaart(?:nummer)?"),
    ("personal", r"personal(?: identity| identification| id)? (?:number|no\.?|nr\.?|code)|pers(?:onal|onen)?\.?-?(?:no|nr|nummer|kennzahl)\.?|personnummer|num[ée]ro personnel|n[úu]mero personal"),
)
_ID = re.compile(r"(?i)(?<![\w-])(?:" + "|".join(f"(?P<{n}>{p})" for n, p in _ID_CUES) + r")(?:\s?(?:n\s?[°º]\.?|nº|num(?:ber)?\.?|no\.?|nr\.?|#))?(?:\s+(?:is|lautet|est|es|ist))?\s{0,2}[:=#]?\s{0,3}(?=[A-Z]{0,3}\s?\d)")
# Each cue above holds one of these.
_ID_ROOTS = ("ssn", "social", "sozial", "curit", "seguridad", "bsn", "burgerserv", "national", "nino", "ni n", "passp", "passnu", "reise", "reisd", "travel d", "voyage", "viaje", "pasap", "paspo", "ident", "id c", "id-c", "id n", "ausweis", "dni", "cni", "personal", "personn", "persono", "pers.", "pers-", "persn")
_SPACED_ROOTS = tuple(r for r in _ID_ROOTS if " " in r)
_HELD_PIECES = 500_000
_ID_VALUE = re.compile(r"(?i)(?:[a-z]{1,3}[ \n-]?)?\d+(?:[ \n./-]{1,2}\d+)*(?:[ \n-]?[a-z](?![\w]))?")

_AT = r"(?:\s?[\[({<]\s?(?i:at|ät|@|arroba|arobase)\s?[\])}>]\s?|[ \n](?:AT|at)[ \n]|\s?@\s?|\s?%40\s?|&#64;)"
_DOT = r"(?:\s?[\[({<]\s?(?i:dot|punkt|point|punto|\.)\s?[\])}>]\s?|[ \n](?:DOT|dot)[ \n]|\.)"
_BOXED_AT = re.compile(r"(?i)[\[({<]\s?(?:at|ät|arroba|arobase)\s?[\])}>]")
_PLAIN_AT = ("@", "%40", "&#64;", *(f"{a}{w}{b}" for w in ("at", "AT") for a in " \n" for b in " \n"))
_AROUND = re.compile(_AT)
_LOCAL = re.compile(r"[\w!#$%&'*+/=?^{}~-]+(?:\.[\w!#$%&'*+/=?^{}~-]+)*\Z")
_DOMAIN = re.compile(rf"[^\W_](?:[\w-]*\w)?(?:{_DOT}[^\W_](?:[\w-]*\w)?)+")
_DOTS = re.compile(_DOT)
#: Characters of the longest local part and domain there are; what is longer is no address, and not cut.
_LOCAL_LENGTH, _DOMAIN_LENGTH = 256, 300
_LOCAL_SIGNS = frozenset("_!#$%&'*+/=?^{}~.-")
_TOP_LEVEL = re.compile(r"[^\W\d_]{2,24}\Z")
_WORDY = re.compile(r"(?i)\sdot\s|[\[({]")
_NEW_SENTENCE = re.compile(r"\.[A-ZÄÖÜ]|\s")

_GAP = r"[ .()/\n-]{1,3}"
_NUMBER = re.compile(rf"[+(\d](?<![\w.:@#][+(\d])(?<!\d,[+(\d])(?:(?<=\d)\d*|[+(]?\d+)(?:{_GAP}\d+)*")
# Numbering plans, in the order in which they are tried.
_PHONE_PLANS = (
    ("intl", r"\+\s?\d{1,3}[\s().-]{0,3}(?:\(0\)[\s-]?)?\d[\d\s()./-]{5,}"),
    ("00", r"00[1-9]\d{0,2}[\s./-]+[\d(][\d\s()./-]{5,}|00[1-9]\d{8,12}"),
    ("nanp(", r"(?:1[\s.-]?)?\([2-9]\d\d\)\s?[2-9]\d\d[\s.-]?\d{4}"),
    ("nanp1", r"1[\s.-][2-9]\d\d[\s.-][2-9]\d\d[\s.-]\d{4}"),
    ("nanp", r"[2-9]\d\d(?P<a>[\s.-])[2-9]\d\d(?P=a)\d{4}"),
    ("slash", r"\(?0\d{1,4}\)?\s?/\s?\d{3,}[\s-]?\d*"),
    ("pairs", r"0[1-9](?:(?P<b>[\s.-])\d\d)(?:(?P=b)\d\d){3}"),
    ("trunk", r"\(?0[1-9]\d{1,4}\)?[\s-]\d{3,}(?:[\s-]\d{2,})*"),
    ("plain", r"0[1-9]\d{8,9}"),
)
_PLAN = re.compile("|".join(f"(?P<p{k}>(?:{p})\\Z)" for k, (_, p) in enumerate(_PHONE_PLANS)))
_PLAN_NAMES = {f"p{k}": n for k, (n, _) in enumerate(_PHONE_PLANS)}
# Some country codes; the usual number of digits differs by them.
_COUNTRY_CODES = ("1", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49")
# Five digits or ZIP+4; Dutch codes; the four digits of AT, BE, CH and DK.
_POSTCODE = re.compile(r"(?<![\w./-])(?<!\d,)(?:(?P<uk>[A-Z]{1,2}\d{1,2}[A-Z]?\s\d[A-Z]{2})|(?P<zip>\d{5}(?:-\d{4})?|[1-9]\d{3}\s?(?-i:[A-Z]{2}))|(?P<four>[1-9]\d{3}))(?![\w/]|[.,-]\d)", re.I)
_WORDS = r"[^\W\d_][^\W\d_'’.-]*(?:['’.-]+[^\W\d_]+)*\.?"
_NUMBER_FIRST = re.compile(rf"(?<![\w.,/:-])(\d{{1,4}}(?:\s?[a-zA-Z](?![\w]))?(?:\s(?:bis|ter|quater))?),?\s+({_WORDS}(?:,?\s+{_WORDS}){{0,8}}),?\s+\Z")
_HOUSE_LAST = re.compile(r"\s(\d{1,4}(?:\s?[a-zA-Z])?),?\s+\Z")
_STREET_WORD = re.compile(rf"{_WORDS}\Z")
_TOWN = re.compile(rf"\s+([^\W\d_][^\W\d_]*(?:['’-][^\W\d_]+)*(?:[ -](?:am|an|der|de|la|le|les|sur|sous|del|[A-ZÄÖÜ][^\W\d_]*)(?:['’-][^\W\d_]+)*){{0,3}})")
_STOP = re.compile(r"(?i)(?<!\bst)(?<!\brd)(?<!\bave)(?<!str)\.\s")
#: Characters before a postcode in which its address may begin: more than the longest house number and nine words.
_ADDRESS_BACK = 300

_STREET_STOP = re.compile(r"[,:;.!?]\s")
_OPENS, _STREET_PARTS = re.compile(r"(?<!\w)\d{1,4}(?!\d)"), re.compile(r"[^\s,]+")

_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_INITIAL = re.compile(r"\.(?<=(?<![\w.])[^\W\d_]\.)[ \n]{0,3}(?:[^\W\d_]\.[ \n]{0,3})?")
_AFTER_GIVEN = re.compile(r" {0,2}\n? {0,2}(?:[^\W\d_]\.[ \n]{0,3}){0,2}(?:(?:van|von|der|den|de|del|della|di|da|la|le|zu|zur|ter|ten|bin|al)[ \n]){0,2}([^\W\d_]+(?:['’-][^\W\d_]+)*)(?![\w@])")
_COMMA_GIVEN = re.compile(r",([ \n]{1,3})([^\W\d_]+(?:['’-][^\W\d_]+)*)((?:[ \n][^\W\d_]\.)?)(?![\w@])")
_BEFORE_COMMA = re.compile(r"(?<![\w@.'’-])([^\W\d_]+(?:['’-][^\W\d_]+)*),([ \n]{1,3})\Z")
_BEFORE_SURNAME = re.compile(r"(?<![\w@.'’-])([^\W\d_]{2,}(?:['’-][^\W\d_]+)*)([ \n]{1,3})\Z")
_MIDDLE = re.compile(r"[ \n]{1,3}[^\W\d_]\.(?!\w)")
_QUOTE = re.compile(r"^[ \t]*(?:[>|][ \t]?)+", re.M)
_WRAPPED_HYPHEN = re.compile(r"-(?<=\w-)[ \t]*\n[ \t]*(?=\w)")


@dataclass(frozen=True)
class Lexicons:
    """Lower-case words: given names, surnames, and other words that texts write in lower case."""

    given: frozenset[str] = frozenset()
    surnames: frozenset[str] = frozenset()
    common: frozenset[str] = frozenset()
    #: What is known of pieces of text between blanks, up to a bound: those that hold nothing, and of the others
    #: (names in it, whether it holds a root).
    dull: set[str] = field(default_factory=set, compare=False, repr=False)
    pieces: dict[str, tuple[tuple[str, ...], bool]] = field(default_factory=dict, compare=False, repr=False)

    def known(self, low: str) -> tuple[set[str], bool]:
        """Names that ``low`` holds as words, and whether it may hold what a text calls an identity number."""
        names, cue = set(), any(root in low for root in _SPACED_ROOTS)
        if len(self.dull) + len(self.pieces) > _HELD_PIECES:
            self.dull.clear(), self.pieces.clear()
        for piece in set(low.split()) - self.dull:
            got = self.pieces.get(piece)
            if got is None:
                got = (tuple(w for w in _TOKEN.findall(piece) if w in self.given or w in self.surnames), any(r in piece for r in _ID_ROOTS))
                if got[0] or got[1]:
                    self.pieces[piece] = got
                else:
                    self.dull.add(piece)
            names.update(got[0])
            cue = cue or got[1]
        return names, cue


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    key: str
    features: tuple[str, ...]


#: Blanks and hyphens that do not break, as plain ones; characters that show nothing are dropped.
_PLAIN = {**dict.fromkeys(map(ord, "\u00a0\u2007\u202f\u2009\u2002\u2003\t"), " "), **dict.fromkeys(map(ord, "\u2010\u2011\u2012"), "-"), **dict.fromkeys(map(ord, "\u00ad\u200b\u200c\u200d\u2060\ufeff"), None)}
_NOT_PLAIN = re.compile("[" + "".join(map(chr, _PLAIN)) + "]")


def unwrapped(text: str) -> str:
    """Text as it is searched: no quote marks before its lines, a word broken at its hyphen put
    together, blanks and hyphens plain."""
    if not text.isascii() or "\t" in text:
        text = _NOT_PLAIN.sub(lambda m: _PLAIN[ord(m[0])] or "", text)
    if ">" in text or "|" in text:
        text = _QUOTE.sub("", text)
    return _WRAPPED_HYPHEN.sub("-", text) if "-" in text else text


def _cue(text: str, start: int) -> str:
    """The last word before a place, at most four other characters away."""
    low, end = max(0, start - NEAR), start
    while end > low and end > start - 5 and not text[end - 1].isalpha():
        if text[end - 1].isdigit() or text[end - 1] == "_":
            return ""
        end -= 1
    at = end
    while at > low and text[at - 1].isalpha():
        at -= 1
    return text[at:end].lower() if start - end <= 4 else ""


def _local_start(text: str, end: int) -> int:
    """Where the characters of a local part that ends at ``end`` begin; -1 if they are too many."""
    low, at = max(-1, end - _LOCAL_LENGTH - 1), end
    while at > 0 and (text[at - 1].isalnum() or text[at - 1] in _LOCAL_SIGNS):
        at -= 1
        if at == low:
            return -1
    return at


def _marks(text: str) -> Iterable[int]:
    """Where something stands that may be the sign of an e-mail address, in order and without overlaps."""
    found = [(at, at + len(word)) for word in _PLAIN_AT for at in _positions(text, word)]
    found += [m.span() for m in _BOXED_AT.finditer(text)]
    done = 0
    for start, end in sorted(found):
        if start >= done:
            done = end
            yield start


def _emails(text: str) -> Iterable[Span]:
    for at in _marks(text):
        m = _AROUND.match(text, at - (1 if at and text[at - 1] in " \n" and text[at] not in " \n" else 0))
        first = _local_start(text, m.start()) if m else -1
        d = first >= 0 and _DOMAIN.match(text, m.end(), m.end() + _DOMAIN_LENGTH)
        local = d and _LOCAL.search(text, first, m.start())
        if not local or d.end() == m.end() + _DOMAIN_LENGTH and text[d.end() : d.end() + 1].isalnum():
            continue
        box = local[0].lstrip("'*=/{")
        mark = m[0].strip()
        plain, spaced, word = mark == "@", m[0] != mark, mark.lower() == "at"
        if not box:
            continue
        cuts = [(x.start(), x.end()) for x in _DOTS.finditer(d[0])]
        labels = [d[0][i:j] for i, j in zip([0, *(e for _, e in cuts)], [*(s for s, _ in cuts), len(d[0])], strict=True)]
        # Every domain of two or more labels may be the end: after a full stop a new sentence begins.
        for n in range(2, len(labels) + 1):
            if not _TOP_LEVEL.match(labels[n - 1]):
                continue
            whole = n == len(labels)
            end = len(d[0]) if whole else cuts[n - 1][0]
            f = [f"email:mark={'@' if plain else 'word' if word else 'bracket'}", f"email:spaced={spaced}", f"email:whole={whole}"]
            if word and d[0][: end].count(".") and not _WORDY.search(d[0][:end]):
                f.append("email:at-plain-domain")
            if not whole and _NEW_SENTENCE.match(d[0][end:]):
                f.append("email:stop-then-capital")
            yield Span(m.start() - len(box), d.start() + end, "email", f"{box}@{'.'.join(labels[:n])}".lower(), tuple(f))


_SPACES, _NO_DIGIT, _NO_CODE = re.compile(r"\s+"), re.compile(r"\D"), re.compile(r"\D|^00")
_EXTENSION, _X_DIGIT = re.compile(r"[ ,]{0,2}(?:ext\b|x ?\d|ext\.)", re.I), re.compile(r"x\d")
_DIGITS = re.compile(r"\d+")
#: Digits of the shortest and longest phone number.
_LEAST, _MOST = 7, 15


def _phones(text: str) -> Iterable[Span]:
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() < _LEAST:
            continue
        groups = [(g.start(), g.end()) for g in _DIGITS.finditer(text, m.start(), m.end())]
        if sum(e - s for s, e in groups) < _LEAST:
            continue
        last = len(groups) - 1
        ends_line = [k == last or "\n" in text[groups[k][1] : groups[k + 1][0]] for k in range(last + 1)]
        for i in range(last + 1):
            start = groups[i][0]
            while start > m.start() and text[start - 1] in "+(" and start - 1 >= (groups[i - 1][1] if i else m.start()):
                start -= 1
            digits = 0
            for j in range(i, last + 1):
                digits += groups[j][1] - groups[j][0]
                if digits < _LEAST:
                    continue
                if digits > _MOST:
                    break
                end = groups[j][1]
                body = _SPACES.sub(" ", text[start:end])
                plan = _PLAN_NAMES[known.lastgroup] if (known := _PLAN.match(body)) else "none"
                whole = i == 0 and j == last
                if plan == "none" and not whole:
                    continue
                after = text[end : end + 1]
                if after.isalnum() and not _X_DIGIT.match(text, end, end + 2) or text[end : end + 2].lstrip(".,:/-")[:1].isdigit() and after in ".,:/-":
                    continue
                code = next((c for c in _COUNTRY_CODES if _NO_CODE.sub("", body).startswith(c)), "?") if plan in ("intl", "00") else plan
                lines = text.count("\n", start, end)
                final = "line" if "\n" in text[groups[j - 1][1] : groups[j][0]] else "same" if j > i else "one"
                f = [f"phone:plan={plan}", f"phone:cue={_cue(text, start)}", f"phone:whole={whole}", f"phone:left={i == 0}", f"phone:plan+left={plan},{i == 0}"]
                f += [f"phone:code={code},{digits}", f"phone:lines={min(lines, 2)}", f"phone:last={final}"]
                if not whole and ends_line[j] and (i == 0 or ends_line[i - 1]):
                    # Beside numbers on neighbouring lines: all of its own lines.
                    f += ["phone:own-lines", f"phone:own-lines,{plan}", f"phone:own-lines,{code},{digits}", f"phone:own-lines,{min(lines, 2)}", f"phone:own-lines,left={i == 0}"]
                if _EXTENSION.match(text, end, end + 8):
                    f.append("phone:extension")
                yield Span(start, end, "phone", _NO_DIGIT.sub("", text[start:end]), tuple(f))


#: Characters an identity number of each kind may have, and where its letters stand.
_ID_FORMS = {
    "ssn": re.compile(r"\d{9,13}\Z"), "nino": re.compile(r"[A-Z]{2}\d{6}[A-D]?\Z"), "passport": re.compile(r"[A-Z]{0,2}\d{6,9}[A-Z]?\Z"),
    "card": re.compile(r"[A-Z]{0,3}\d{6,14}[A-Z]?\Z"), "personal": re.compile(r"[A-Z]{0,2}\d{6,13}[A-Z]?\Z"),
}
_ID_LENGTHS = {"ssn": (9, 13), "nino": (9,), "passport": (8, 9), "card": (9, 10, 11), "personal": (10, 11, 12)}


def _id_cues(text: str, low: str) -> Iterable[re.Match]:
    """Matches of the cue pattern, looked for only around a root of its words."""
    done = 0
    for at in sorted({i for root in _ID_ROOTS for i in _positions(low, root)}):
        if at >= done and (m := _ID.search(text, max(done, at - 24), at + 64)):
            done = m.end()
            yield m


def _positions(low: str, word: str) -> Iterable[int]:
    at = low.find(word)
    while at >= 0:
        yield at
        at = low.find(word, at + 1)


def _lower(text: str) -> str:
    """Lower case with the same positions."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


_NO_SIGN = re.compile(r"[\W_]")


def _identities(text: str, low: str) -> Iterable[Span]:
    for m in _id_cues(text, low):
        cue = m.lastgroup
        v = _ID_VALUE.match(text, m.end(), m.end() + 96)
        if not v or v.end() == m.end() + 96:  # more digits than any number has
            continue
        ends = sorted({v.end(), *(g.end() for g in _DIGITS.finditer(text, v.start(), v.end()))})
        for end in ends:
            key = _NO_SIGN.sub("", text[v.start() : end]).upper()
            if end < len(text) and text[end].isalnum() or not _ID_FORMS[cue].match(key):
                continue
            f = (f"id:cue={cue}", f"id:whole={end == v.end()}", f"id:usual={len(key) in _ID_LENGTHS[cue]}", f"id:gap={min(2, text[m.start() : m.end()].count(chr(10)))}")
            yield Span(v.start(), end, "id_number", key, f)


def _postcodes(text: str) -> Iterable[re.Match]:
    """Matches of the pattern, tried only where a run of digits is as long as a code needs."""
    done = 0
    for g in _DIGITS.finditer(text):
        start, end = g.span()
        n = end - start
        if start < done or n > 5 or n == 3:
            continue
        if n < 3:  # digits after one or two letters
            if not start or not text[start - 1].isalpha():
                continue
            start -= 2 if start > 1 and text[start - 2].isalpha() else 1
            if start < done:
                continue
        if m := _POSTCODE.match(text, start):
            done = m.end()
            yield m


def _addresses(text: str) -> Iterable[Span]:
    for p in _postcodes(text):
        kind = p.lastgroup
        low = max(0, p.start() - _ADDRESS_BACK)
        before = text[low : p.start()]
        town = _TOWN.match(text, p.end(), p.end() + 60) if kind != "uk" else None
        upper_town = bool(town) and town[1][:1].isupper()
        if kind == "four" and not upper_town:  # its form alone is that of any year or count
            continue
        code = _NO_DIGIT.sub("", p[0])
        shapes = []
        # Of several numbers that may open the span, each is a candidate.
        for x in _OPENS.finditer(before):
            if m := _NUMBER_FIRST.match(before, x.start()):
                shapes.append(("first", m.start(), m[2], m[1]))
        if h := _HOUSE_LAST.search(before, max(0, len(before) - 12)):
            # The street may begin at any of the words before the house number.
            words = list(_STREET_PARTS.finditer(before, 0, h.start()))[-8:]
            for w in reversed(words):
                if not _STREET_WORD.match(w[0]):
                    break
                shapes.append(("last", w.start(), before[w.start() : h.start()], h[1]))
                if w is not words[0] and _STREET_STOP.search(before[words[words.index(w) - 1].end() - 1 : w.start()]):
                    break
        for shape, start, words, house in shapes:
            own = _STREET.search(words)
            count = len(words.split())
            stops = len(_STOP.findall(words))
            lower = sum(w[:1].islower() for w in words.split()) / count
            end = town.end() if upper_town and (shape == "last" or before.rstrip(" ")[-1:] in (",", "\n")) else p.end()
            f = [f"address:{shape},{kind}", f"address:stops={min(stops, 2)}", f"address:{shape},street={bool(own)}", f"address:lower={lower > 0.5}", f"address:{kind},words={min(count, 9) // 3}", f"address:{shape},{kind},town={upper_town}"]
            if kind == "four":
                f.append(f"address:{shape},four,street={bool(own)}")
            if shape == "last":
                prior = before[:start].rstrip()[-1:]
                f += [f"address:start={words[:1].isupper()},{min(count, 4)}", f"address:prior={'word' if prior.isalnum() else 'mark'}", "address:own=" + ("no" if not own else "opens" if own.start() == 0 else "first" if " " not in words[: own.start()] and chr(10) not in words[: own.start()] else "later")]
            yield Span(low + start, end, "address", _NO_DIGIT.sub("", house) + code, tuple(f))


def _case(word: str) -> str:
    return "U" if word.isupper() and len(word) > 1 else "C" if word[:1].isupper() else "l"


def _named(shape: str, given: str, surname: str, gap: str, start: int, end: int, text: str, lex: Lexicons) -> Span:
    g, s = given.lower(), surname.lower()
    known = g in lex.given if len(g) > 1 else None
    parts = s.split("-")
    sur = s in lex.surnames or all(x in lex.surnames for x in parts)
    common = not sur and any(x in lex.common for x in parts)
    opens = text[end : end + 2].strip()[:1]
    f = (
        f"name:{shape}", f"name:case={_case(given) if len(given) > 1 else 'I'}{_case(surname)}", f"name:given={known},sur={sur}", f"name:common={common}", f"name:closing={s in CLOSINGS or g in CLOSINGS}",
        f"name:{shape},gap={'nl' if chr(10) in gap else 'sp'},sur={sur}", f"name:cue={_cue(text, start)}", f"name:opens={opens if opens in '<([,|' and opens else '-'}",
        f"name:short={len(surname) < 4}", f"name:surname-is-given={s in lex.given}",
    )
    return Span(start, end, "name", s, f)


def _whole_words(text: str, low: str, words: Iterable[str]) -> list[tuple[int, int]]:
    """Places of ``words`` where they stand as whole words (a hyphen joins words)."""
    out = []
    n = len(text)
    for word in words:
        for at in _positions(low, word):
            end = at + len(word)
            if not (at and (low[at - 1].isalnum() or low[at - 1] in "_@+" or low[at - 1] in "-'’." and at > 1 and low[at - 2].isalnum())) and not (end < n and (low[end].isalnum() or low[end] in "_@+" or low[end] in "-'’" and end + 1 < n and low[end + 1].isalpha())):
                out.append((at, end))
    return sorted(out)


def _names(text: str, low: str, lex: Lexicons, seen: set[str]) -> Iterable[Span]:
    """Spans around words that the lexicons know (those of ``seen``), and around initials."""
    given, surnames = lex.given, lex.surnames
    for start, end in _whole_words(text, low, seen & given):
        word = text[start:end]
        case = _case(word) == "l"
        if text[end : end + 1] in (" ", "\n") and (m := _AFTER_GIVEN.match(text, end, end + 60)) and len(m[1]) > 1 and (_case(m[1]) == "l") == case:
            yield _named("GS", word, m[1], text[end : m.start(1)], start, m.end(), text, lex)
        if start > 1 and text[start - 1] in " \n" and "," in text[max(0, start - 4) : start] and (m := _BEFORE_COMMA.search(text, max(0, start - 50), start)) and len(m[1]) > 2 and (_case(m[1]) == "l") == case:
            more = _MIDDLE.match(text, end)
            yield _named("SG", word, m[1], m[2], m.start(1), more.end() if more else end, text, lex)
    for start, end in _whole_words(text, low, seen & surnames):
        word = text[start:end]
        case = _case(word) == "l"
        if not case and start and text[start - 1] in " \n" and (m := _BEFORE_SURNAME.search(text, max(0, start - 40), start)) and m[1].lower() not in given and m[1][:1].isupper():
            yield _named("GS", m[1], word, m[2], m.start(1), end, text, lex)
        if text[end : end + 1] == "," and (m := _COMMA_GIVEN.match(text, end, end + 40)) and m[2].lower() not in given and (_case(m[2]) == "l") == case:
            yield _named("SG", m[2], word, m[1], start, m.end(), text, lex)
    for m in _INITIAL.finditer(text):
        t, initial = _TOKEN.match(text, m.end()), text[m.start() - 1]
        if t and len(t[0]) > 2 and initial.isupper() == t[0][:1].isupper() and (initial.isupper() or t[0].lower() in surnames):
            yield _named("IS", initial, t[0], m[0], m.start() - 1, t.end(), text, lex)


def spans(text: str, lex: Lexicons) -> list[Span]:
    """All candidate spans of ``text``, by start and end."""
    low = _lower(text)
    names, cue = lex.known(low)
    return sorted([*_emails(text), *_phones(text), *(_identities(text, low) if cue else ()), *_addresses(text), *_names(text, low, lex, names)], key=lambda s: (s.start, s.end))


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, span: Span) -> float:
        w = self.weights
        return w.get(span.kind, 0.0) + sum(w.get(f, 0.0) for f in span.features)

    def pair(self, a: Span, b: Span) -> float:
        return self.weights.get(f"{a.kind}>{b.kind}", 0.0) if b.start - a.end <= NEAR else 0.0

    def decode(self, found: list[Span]) -> list[Span]:
        """The set of spans without overlaps that scores best (Viterbi over spans).

        ``found`` is sorted by start. Only spans that end at most NEAR before the current one, or
        after its start, are kept singly; of those before, the best set counts.
        """
        best: list[float] = []
        back: list[int] = []
        top, last = 0.0, -1
        open_spans: list[int] = []
        for k, s in enumerate(found):
            still = []
            for j in open_spans:
                if found[j].end + NEAR >= s.start:
                    still.append(j)
                elif best[j] > top:
                    top, last = best[j], j
            open_spans = still
            most, before = top, last
            for j in open_spans:
                if found[j].end <= s.start and (v := best[j] + self.pair(found[j], s)) > most:
                    most, before = v, j
            best.append(most + self.score(s))
            back.append(before)
            open_spans.append(k)
        for j in open_spans:
            if best[j] > top:
                top, last = best[j], j
        chain = []
        while last >= 0:
            chain.append(found[last])
            last = back[last]
        return chain[::-1]

    def expected(self, spans: list[Span]) -> tuple[list[float], dict[tuple[int, int], float], float]:
        """Marginal of each span and of each pair of neighbours, and log Z (forward-backward)."""
        n = len(spans)
        scores = [self.score(s) for s in spans]
        pairs = {(j, k): self.pair(spans[j], spans[k]) for k in range(n) for j in range(k) if spans[j].end <= spans[k].start}
        fwd = [0.0] * n
        for k in range(n):
            fwd[k] = scores[k] + _logsum([0.0, *(fwd[j] + pairs[j, k] for j in range(k) if (j, k) in pairs)])
        bwd = [0.0] * n
        for k in reversed(range(n)):
            bwd[k] = _logsum([0.0, *(bwd[m] + scores[m] + pairs[k, m] for m in range(k + 1, n) if (k, m) in pairs)])
        z = _logsum([0.0, *fwd])
        single = [math.exp(fwd[k] + bwd[k] - z) for k in range(n)]
        both = {(j, k): math.exp(fwd[j] + v + scores[k] + bwd[k] - z) for (j, k), v in pairs.items()}
        return single, both, z


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


#: Spans of one cluster of the training; a longer one is cut where spans do not overlap, or at last within it.
MAX_CLUSTER = 64


def clusters(found: list[Span]) -> Iterable[list[Span]]:
    """Runs of spans that overlap or stand close, to train on; between runs nothing is shared."""
    run: list[Span] = []
    reach = -1
    for s in found:
        if run and (s.start > reach + NEAR or len(run) >= MAX_CLUSTER and s.start >= reach or len(run) >= 4 * MAX_CLUSTER):
            yield run
            run, reach = [], -1
        run.append(s)
        reach = max(reach, s.end)
    if run:
        yield run


def find(text: str, lex: Lexicons, model: Model) -> list[Span]:
    """Spans of personal information in ``text`` (as ``unwrapped`` gives it), in order."""
    return model.decode(spans(text, lex))


def redact(text: str, found: list[Span]) -> str:
    """``text`` with a typed placeholder in place of each span; all else is kept as it stands."""
    out, at = [], 0
    for s in found:
        out += [text[at : s.start], PLACEHOLDERS[s.kind]]
        at = s.end
    return "".join([*out, text[at:]])
