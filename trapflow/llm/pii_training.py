"""Training of the span model on labelled text that is made by rule.

No labelled rows exist, so sentences are composed here: slots of the five types filled with invented
values in the forms that public numbering plans and postal rules allow, among look-alikes that are
nothing personal. What is drawn depends on a seed alone, so the model is the same everywhere. Given
names and surnames of the sentences are known to the lexicon at random, as real ones are.
"""

from __future__ import annotations

import math
import random
from functools import lru_cache

from trapflow.llm.pii import Lexicons, Model, Span, clusters, spans, unwrapped

#: Sentences the model is trained on, and passes over them.
SENTENCES, PASSES = 900, 8

# Given names for made sentences.
_GIVEN = (
    "Anna Paul Maria Jan Laura Peter Julia Thomas Elena Marco Sofia David Clara Simon Nora Felix Ida Victor Alice Hugo Emma Louis Marta Diego Lucia Pablo Carmen Javier Ingrid Lars "
    "Astrid Sven Fiona Ewan Aisha Omar Leila Karim Mei Kenji Ana Tiago Petra Milos Katya Ivan Zofia Marek Helga Otto"
).split()
_SYLLABLES = "bar cor del fan gol har jen kol lam mor nov pel ras sel tor vel wen zan".split()
_ENDINGS = "berg sen by ton ez ier mann ard ley ova ini aud wick stad".split()
_TOWNS = "Eastbury,Long Marsh,Kirkton,Wald am See,Hohenau,Bad Lauten,Saint-Mard,Villebois,Pont-sur-Ain,Villaseca,Rio Blanco,Oudeberg,NORTH END,Upper Wick".split(",")
_FIRST_STREETS = "Mill,Church,Park,Bridge,Long,Station Hill".split(",")
_EN_TYPES = "Street,St.,Road,Rd,Lane,Close,Avenue,Ave,Drive,Court".split(",")


class _Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.known_given = {g.lower() for g in _GIVEN if self.r.random() < 0.9}
        self.known_sur: set[str] = set()

    def digits(self, pattern: str) -> str:
        return "".join(str(self.r.randint(2, 9)) if c == "%" else str(self.r.randint(0, 9)) if c == "#" else self.r.choice("ABCEGHJKLMNPRSTWXYZ") if c == "~" else c for c in pattern)

    def surname(self) -> str:
        one = lambda: (self.r.choice(_SYLLABLES) + self.r.choice(["", self.r.choice(_SYLLABLES)]) + self.r.choice(_ENDINGS)).capitalize()
        s = one() + ("-" + one() if self.r.random() < 0.1 else "")
        if self.r.random() < 0.7:
            self.known_sur |= {s.lower(), *s.lower().split("-")}
        return s

    def name(self) -> str:
        g, s = self.r.choice(_GIVEN), self.surname()
        k = self.r.random()
        if k < 0.1:
            return f"{g} {s.upper()}"
        if k < 0.18:
            return f"{g} {s}".lower()
        if k < 0.32:
            return f"{s}, {g}"
        if k < 0.48:
            return f"{g[0]}. {s}"
        if k < 0.56:
            return f"{g} {self.r.choice('ABDEHJKM')}. {s}"
        return f"{g} {s}"

    def email(self) -> str:
        local = self.r.choice([f"{self.r.choice(_GIVEN)}{self.r.randint(1, 99)}", f"{self.r.choice(_GIVEN)[0]}.{self.surname()}", f"{self.r.choice(_GIVEN)}_{self.surname()}+in", f"{self.surname()}-desk"]).lower()
        host = self.r.choice(["quarto.example", "mail.lumen.test", "north-bay.example", "k4.invalid", "post.vale.example.org"])
        at, dot = self.r.choice([("@", ".")] * 6 + [(" @ ", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), (" AT ", " DOT "), (" at ", " dot "), (" (at) ", ".")])
        got = local + at + host.replace(".", dot)
        return got.upper() if self.r.random() < 0.05 else got

    def phone(self) -> str:
        p = self.r.choice(
            "+1 %## %## ####|+1%##%######|(%##) %##-####|%##-%##-####|%##.%##.####|1-%##-%##-####|+44 7### ######|+44 (0)7### ### ###|07### ######|07###-###-###|07#########|0%########|0044 7### ######|+49 30 ##### ####|"
            "+49 (0)40 #####-###|0%% ##### ###|0%%/#####-###|0049 30 ##### ###|+33 % ## ## ## ##|+33 (0)% ## ## ## ##|0% ## ## ## ##|0%.##.##.##.##|+34 9## ### ###|020 #### ####|+31 20 ### ####|0%%#/#######".split("|")
        )
        return self.digits(p)

    def id_number(self) -> tuple[str, str]:
        cue, p = self.r.choice(
            [("SSN", "###-##-####"), ("social security number", "### ## ####"), ("SSN:", "#########"), ("NINO", "~~ ## ## ## C"), ("national insurance", "~~######B"), ("NI number", "~~######A"), ("passport no.", "~########"),
             ("passport", "~ ########"), ("Reisepassnummer", "C########"), ("travel document", "~## ### ###"), ("identity card no.", "###########"), ("carte d'identité n°", "## ### ### ###"), ("Ausweisnummer", "###########"),
             ("documento de identidad", "## ### ### ###"), ("personal no.", "######-####"), ("pers.-no.", "######-####"), ("personal identity number", "##########"), ("identity number", "##########"), ("Passport number:", "~#######")]
        )
        return cue, self.digits(p)

    def address(self) -> str:
        r, town = self.r, self.r.choice(_TOWNS)
        n, sep = r.randint(1, 250), r.choice([", ", ",\n", "\n", " "])
        k = r.random()
        if k < 0.45:
            street = f"{r.choice(_FIRST_STREETS)} {r.choice(_EN_TYPES)}"
            got = f"{n} {street}{sep}{town} {self.digits(r.choice(['~~# #~~', '~~## #~~', '#####']))}"
            return got.upper() if r.random() < 0.1 else got
        if k < 0.65:
            return f"{r.choice(['Waldstraße', 'Birkenweg', 'Ringallee', 'Am Markt', 'Alter Hof', 'Torgasse', 'Hauptstrasse'])} {n}{r.choice(['', '', 'a', 'b'])}{sep}{self.digits('#####')} {town}"
        if k < 0.82:
            return f"{n}{r.choice(['', '', ' bis', ' ter'])} {r.choice(['rue', 'avenue', 'chemin', 'impasse'])} {r.choice(['du Port', 'de la Gare', 'des Lilas'])}{sep}{self.digits('#####')} {town}"
        return f"{r.choice(['Calle', 'Avenida', 'Camino', 'Plaza'])} {r.choice(['del Sol', 'Mayor', 'de la Paz'])}{r.choice([', ', ' ', chr(10)])}{n}{sep}{self.digits('#####')} {town}"

    def decoy(self) -> str:
        return self.digits(
            self.r.choice(
                "Purchase order ####-###-#### left the depot|Bill no. ####-###-#### is settled|Article ###-0##-#### is sold out|Parcel ############ is late|Cable drum ####-##-## is empty|The gauge showed #### ## ## at six|File ######-## is closed|"
                "Slot 2031-0#-1# 22:00 is free|Router 10.##.###.## answers|Module ~~-####-## was replaced|Row ######: error 0x####|Item ##-##-#### fits|Object 1.3.6.1.4.1.#####.#.0.## was read|Uptime 99.### per cent, memo ####/##|Release 7.##@## is out|"
                "login root@node## fails|The Hill Road depot and the Park Court hall are shut|Machines anna and peter are new, paul# is old|Request ###.###.#### is closed|Shelf ##, box ##, tray ##|Pallet ##### Kirkton is ready|Adapter 02:00:5e:##:##:##|"
                "Room ## on floor # of Hall ##|Record ## ### ### ### was filed|Version #.#.## from 2031-0#-1#|Tally ### ## #### rose|eight cores @ 3.# GHz|Voucher ~######## expired|Lot 0#### ###### is sealed|It printed 1 ### ### ### pages|"
                "Between 198.51.###.# and 198.51.###.# all is well|Line pair 0##-#####-### is up|They moved 12 crates to Dock ##### Eastbury|prefix 2001:db8:##::/48|part ####-## of ###".split("|")
            )
        )


_FRAMES = (
    "Ring {name} at {phone} or mail {email}.|The engineer, {name}, is on {phone} today.|Questions go to {name} ({email}).|{name} keeps the spare set, mobile {phone}.|Speak to {name} on {phone}.|In doubt mail {email} and then try {phone}.|Office number is {phone}.|"
    "Ansprechpartner ist {name}, Telefon {phone}.|Sie erreichen {name} unter {phone}.|Paket für {name}, {address}, bitte abgeben.|Anschrift: {address}, Fragen an {email}.|Fragen beantwortet {name}, Tel. {phone}.|Joindre {name} au {phone}.|Envoyer le colis à {name}, {address}.|L'adresse est {address}.|"
    "Pregunte por {name}, teléfono {phone}.|Mande el paquete a {name}, {address}.|Puede llamar al {phone}.|Correo: {email}.|The parcel for {name}, {address}, is here.|Collect it at {address} and see {name}.|On the list: {name}, {id}.|The form says {id}.|We hold {id} and {address} for {name}.|"
    "Im Formular steht {name}, {id}.|Dossier : {name}, {id}.|Datos: {name}, {id}.|On Tue, 3 Feb 2031 at 10:12, {name} <{email}> wrote:|From: {name} [{email}]\nSent: 2031-01-02|Am 2031-01-02 schrieb {name} <{email}>:|Le 03.01.2031, {name} a écrit :|"
    "Regards,\n{name}\n{phone}\n{address}\n|{name}\nmob. {phone}\n{address}\n|Regards,\n{name}\nNetwork Desk\nT: {phone}\nE: {email}\n{address}\n|Grüße\n-- \n{name} | Field Team | Tel {phone} | {address}\n|Thanks,\n{given}\n|Cheers,\n{name}\n{phone}\n|Hello {given},\n\nthe line is up.|Hallo {given},\n\nDer Ring läuft.|Hi {given},\n\nStart it today.|mob. {phone} x12|Phone: {phone} ext. 31\n|"
    "who,mail,phone\n{name},{email},{phone}\n{name},{email},{phone}\n|Dear {given}, Thanks for the report.|Saludos,\n{given}\nBilling Desk\n|{given}\nShift Lead\nmob. {phone}\n|Merci,\n{given}\n\nThe ring is down.|{given} -\n\nOur link is down."
).split("|")
_FILL = "the ring went quiet since Monday|as agreed our link is back|Der Sammler läuft stabil|la liaison attend des pièces|el anillo ya no da alarmas|Network Desk and Field Team know|for the record all is well".split("|")
_COMMON = frozenset("network desk field team billing shift lead site road lane mill park street the and our ring link send order case host thanks hello hi dear ticket room hall rack batch part bundle".split())


def sentences(count: int, seed: int) -> tuple[list[tuple[str, list[tuple[int, int, str]]]], Lexicons]:
    """Texts with their labelled spans (start, end, type), and the lexicon to read them with."""
    make = _Maker(seed)
    out = []
    for _ in range(count):
        text, labels = "", []
        for piece in make.r.sample(["frame", "fill", "decoy", "frame"], make.r.randint(1, 4)):
            if piece != "frame":
                text += make.r.choice(_FILL) + ". " if piece == "fill" else make.decoy() + ". "
                continue
            for k, part in enumerate(make.r.choice(_FRAMES).replace("}", "{").split("{")):
                if k % 2 == 0:
                    text += part
                elif part == "given":
                    text += make.r.choice(_GIVEN)
                else:
                    value = make.id_number() if part == "id" else getattr(make, part)()
                    if part == "id":
                        text += value[0] + " "
                        value = value[1]
                    kind = "id_number" if part == "id" else part
                    if make.r.random() < 0.12 and " " in value:  # a line may end inside
                        value = value.replace(" ", "\n", 1)
                    labels.append((len(text), len(text) + len(value), kind))
                    text += value
            text += make.r.choice([" ", "\n", "\n\n"])
        out.append((text, labels))
    return out, Lexicons(frozenset(make.known_given), frozenset(make.known_sur), _COMMON)


# Parts of made addresses with four digits, Dutch codes and ZIP+4, and dates that look like them.
_MORE_STREETS = "Waldstraße,Birkenweg,Ringallee,Torgasse,Hauptstrasse,Kerkstraat,Molenlaan,Dorpsplein,Havenkade,Rue du Port,Avenue des Lilas,Chemin de la Gare".split(",")
_DAYS = "January,February,March,May,July,October,December,Jan,Aug,Monday,Tuesday,Friday,Januar,März,Mai,Oktober,Montag,Freitag,janvier,mars,mai,juin,lundi,enero,mayo,octubre,lunes,januari,maart,mei,maandag".split(",")


def postcode_sentences(count: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts with an address of those forms, labelled, or with a date or number that looks like one."""
    make = _Maker(seed)
    r = make.r
    out = []
    for _ in range(count):
        n, sep, town = r.randint(1, 250), r.choice([", ", ",\n", "\n", " "]), r.choice(_TOWNS)
        if r.random() < 0.5:
            before, after = r.choice(["Anschrift: {}, bitte abgeben.", "It is at {} now.", "Adres: {}.", "Envoyer le colis à {}.", "Regards,\nNetwork Desk\n{}\n", "Grüße\n-- \n{}\n"]).split("{}")
            if r.random() < 0.2:
                value = f"{n} {r.choice(_FIRST_STREETS)} {r.choice(_EN_TYPES)}{sep}{town} {make.digits('#####-####')}"
            else:
                value = f"{r.choice(_MORE_STREETS)} {n}{r.choice(['', '', 'a', 'b'])}{sep}{make.digits(r.choice(['%###', '%###', '%### ~~', '%###~~']))} {town}"
            out.append((before + value + after, [(len(before), len(before) + len(value), "address")]))
        else:
            day, year, next_word = r.randint(1, 31), make.digits(r.choice(["20##", "20##", "19##", "%###"])), r.choice([town, "Network Desk", "Subject", "The ring", "Hall", "We"])
            when = r.choice([f"{r.choice(_DAYS)} {day}, {year}", f"{day} {r.choice(_DAYS)} {year}", f"{day}. {r.choice(_DAYS)} {year}", f"{r.choice(_DAYS)} {day} {year}", f"{r.choice(['Rack', 'Room', 'Lot', 'Dock'])} {day}, {year}"])
            out.append((r.choice(["", "Down since ", "The ring was down on ", "Sent: ", "Am ", "Le ", "El "]) + when + r.choice([" ", "\n"]) + next_word + " is quiet.", []))
    return out


def line_sentences(count: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts with bare phone numbers on neighbouring lines, labelled, or one number over two lines, or columns
    of other numbers."""
    make = _Maker(seed)
    r = make.r
    out = []
    for _ in range(count):
        text, labels, k = r.choice(["Call ", "Tel ", "Tel. ", "mob. ", "Phone: ", "Regards,\n", "Rufen Sie an: ", "Joindre ", ""]), [], r.random()
        if k < 0.2:
            value = make.phone()
            at = [i for i, c in enumerate(value) if c == " "]
            value = value[: at[-1]] + "\n" + value[at[-1] + 1 :] if at else value
            labels.append((len(text), len(text) + len(value), "phone"))
            text += value
        elif k < 0.4:
            text = r.choice(["Lots:\n", "Counted:\n", "Rows\n", ""]) + "\n".join(make.digits(r.choice(["### ### ###", "#### ####", "## ### ##", "#######"])) for _ in range(r.randint(2, 4)))
        else:
            for n in range(r.randint(2, 4)):
                text += "\n" if n else ""
                value = make.phone()
                labels.append((len(text), len(text) + len(value), "phone"))
                text += value
        out.append((text + r.choice(["", "\n", "\n\nThe ring is down.", "\nNetwork Desk\n"]), labels))
    return out


def _gold(found: list[Span], labels: list[tuple[int, int, str]], text: str) -> set[int]:
    """Candidates that are labelled spans: of each label, the one of its type with the same characters that matter."""
    want = {(kind, s, "".join(c for c in text[s:e] if c.isalnum())) for s, e, kind in labels}
    got: dict[tuple[str, int], int] = {}
    for k, span in enumerate(found):
        for kind, s, chars in want:
            if span.kind == kind and span.start == s and (kind == "address" and span.end >= s or "".join(c for c in text[span.start : span.end] if c.isalnum()) == chars):
                best = got.get((kind, s))
                if kind != "address" or best is None or _fits(span, chars, text) > _fits(found[best], chars, text):
                    got[kind, s] = k
    return {k for (kind, _), k in got.items()}


def _fits(span: Span, chars: str, text: str) -> int:
    own = "".join(c for c in text[span.start : span.end] if c.isalnum())
    return -abs(len(own) - len(chars)) if own.startswith(chars) or chars.startswith(own) else -10_000


def train(count: int = SENTENCES, passes: int = PASSES, seed: int = 7, rate: float = 0.3, l2: float = 2e-4) -> Model:
    """Weights by gradient ascent on the conditional log-likelihood (AdaGrad), cluster by cluster.

    The features of postcodes of four digits, and then those of numbers on neighbouring lines, are trained
    after the others, which stay as they are.
    """
    texts, lex = sentences(count, seed)
    model = Model()
    rng = random.Random(seed)
    _ascend(model, _examples(texts, lex), passes, rng, rate, l2)
    _ascend(model, _examples(postcode_sentences(count // 2, seed), lex), passes, rng, rate, l2, ",four")
    _ascend(model, _examples(line_sentences(count // 2, seed), lex), passes, rng, rate, l2, "own-lines")
    return model


def _examples(texts: list[tuple[str, list[tuple[int, int, str]]]], lex: Lexicons) -> list[tuple[list[Span], set[int]]]:
    examples = []
    for text, labels in texts:
        found = spans(text, lex)
        gold = {id(found[k]) for k in _gold(found, labels, text)}
        for run in clusters(found):
            examples.append((run, {k for k, s in enumerate(run) if id(s) in gold}))
    return examples


def _ascend(model: Model, examples: list[tuple[list[Span], set[int]]], passes: int, rng: random.Random, rate: float, l2: float, only: str = "") -> None:
    """Train ``model``'s weights of the features whose names hold ``only``."""
    square: dict[str, float] = {}
    for _ in range(passes):
        rng.shuffle(examples)
        for run, gold in examples:
            single, both, _ = model.expected(run)
            grad: dict[str, float] = {}
            for k, s in enumerate(run):
                g = (k in gold) - single[k]
                if abs(g) > 1e-4:
                    for f in (s.kind, *s.features):
                        grad[f] = grad.get(f, 0.0) + g
            order = sorted(gold)
            chosen = {(a, b) for a, b in zip(order, order[1:], strict=False)}
            for (j, k), p in both.items():
                g = ((j, k) in chosen) - p
                if abs(g) > 1e-4 and run[k].start - run[j].end <= 24:
                    f = f"{run[j].kind}>{run[k].kind}"
                    grad[f] = grad.get(f, 0.0) + g
            w = model.weights
            for f, g in grad.items():
                if only not in f:
                    continue
                g -= l2 * w.get(f, 0.0)
                square[f] = square.get(f, 1e-2) + g * g
                w[f] = w.get(f, 0.0) + rate * g / math.sqrt(square[f])


@lru_cache(maxsize=1)
def trained() -> Model:
    return train()
