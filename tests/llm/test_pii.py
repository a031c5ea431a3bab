"""Personal information: forms, held-out accuracy, the dynamic program, tables."""

import itertools
import random
from collections import Counter

import pytest

from trapflow.llm.pii import PLACEHOLDERS, Lexicons, Model, Span, find, redact, spans, unwrapped
from trapflow.llm import pii_tables
from trapflow.llm.pii_tables import fit_lexicons, people, personal_information
from trapflow.llm.pii_training import _gold, sentences, trained

LEX = Lexicons(frozenset({"maria", "jan"}), frozenset({"torberg", "lindqvist"}), frozenset({"network"}))


def keys(text):
    return {(s.kind, s.key) for s in find(unwrapped(text), LEX, trained())}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Mail Maria.T+x@Mail.Quarto.example.", {("email", "maria.t+x@mail.quarto.example")}), ("write to jan (at) quarto (dot) example today", {("email", "jan@quarto.example")}), ("jan[AT]north-bay[DOT]example", {("email", "jan@north-bay.example")}),
        ("jan AT quarto DOT example", {("email", "jan@quarto.example")}), ("see desk @ quarto.example", {("email", "desk@quarto.example")}), ("mailto:desk@quarto.example", {("email", "desk@quarto.example")}), ("root@host12 and 4.3@72", set()),
        ("call +1 (415) 555-0123 now", {("phone", "14155550123")}), ("Tel. 030 23125 292", {("phone", "03023125292")}), ("T: +44 (0)7700 900 123 ext. 12", {("phone", "4407700900123")}), ("mob. 07700 900‑123", {("phone", "07700900123")}),
        ("Phone: +1 212 555\n0131\n", {("phone", "12125550131")}), ("Parcel 057467854270 is late", set()), ("10.20.30.40 and 1.3.6.1.4.1.9 and 2031-01-02 10:00", set()),
        ("On the list: SSN 123-45-6789.", {("id_number", "123456789")}), ("NINO qq 12 34 56 c.", {("id_number", "QQ123456C")}), ("passport no. X1234567.", {("id_number", "X1234567")}), ("carte d'identité n° 12 345 678 901.", {("id_number", "12345678901")}),
        ("personal no. 811218-9876.", {("id_number", "8112189876")}), ("voucher X12345678", set()),
        ("It is at 12 Mill Road, Eastbury AB1 2CD now", {("address", "1212")}), ("Adresse: Birkenweg 7a, 12345 Hohenau", {("address", "712345")}), ("12 bis rue du Port, 54321 Villebois", {("address", "1254321")}), ("Calle Mayor, 9, 28001 Villaseca", {("address", "928001")}),
        ("The Hill Road depot is shut", set()), ("Ask for Maria Torberg at once", {("name", "torberg")}), ("Lindqvist, Jan called", {("name", "lindqvist")}), ("M. Torberg called", {("name", "torberg")}), ("maria lindqvist-torberg <x@y.example>", {("name", "lindqvist-torberg"), ("email", "x@y.example")}),
        ("Hello Maria,\n\nThanks", set()), ("Cheers,\nMaria\n", set()), ("> Ask for Maria\n> Torberg at once", {("name", "torberg")}), ("", set()),
    ],
)
def test_forms(text, want):
    assert keys(text) == want


def test_held_out_accuracy():
    texts, lex = sentences(400, 4321)  # another seed than the training's
    count = Counter()
    for text, labels in texts:
        found = spans(text, lex)
        gold = {(found[k].kind, found[k].start) for k in _gold(found, labels, text)}
        got = {(s.kind, s.start) for s in trained().decode(found)}
        want = {(k, s) for s, _, k in labels}
        count["right"] += len(got & want)
        count["wrong"] += len(got - want)
        count["missed"] += len(want - got)
        count["left"] += len(gold - got)
    assert count["right"] / (count["right"] + count["wrong"]) > 0.97
    assert count["right"] / (count["right"] + count["missed"]) > 0.93


def test_decoding_is_the_best_set():
    r = random.Random(1)
    for _ in range(200):
        found = sorted((Span(s, s + r.randint(1, 12), r.choice(["email", "phone", "name"]), "k", (f"f{k}",)) for k, s in enumerate(r.sample(range(60), 9))), key=lambda s: (s.start, s.end))
        model = Model({f"f{k}": r.uniform(-2, 2) for k in range(9)} | {f"{a}>{b}": r.uniform(-1, 1) for a, b in itertools.product(("email", "phone", "name"), repeat=2)})

        def total(chosen):
            return sum(model.score(s) for s in chosen) + sum(model.pair(a, b) for a, b in zip(chosen, chosen[1:], strict=False))

        best = max((c for n in range(10) for c in itertools.combinations(found, n) if all(a.end <= b.start for a, b in zip(c, c[1:], strict=False))), key=total)
        assert abs(total(model.decode(found)) - total(best)) < 1e-9


def test_marginals_sum_over_all_sets():
    import math

    found = [Span(0, 5, "name", "a", ("x",)), Span(3, 9, "phone", "b", ("y",)), Span(9, 12, "email", "c", ("z",))]
    model = Model({"x": 0.7, "y": -0.2, "z": 1.1, "name>email": 0.4})
    sets = [c for n in range(4) for c in itertools.combinations(range(3), n) if not {0, 1} <= set(c)]
    weight = {c: math.exp(sum(model.score(found[k]) for k in c) + sum(model.pair(found[a], found[b]) for a, b in zip(c, c[1:], strict=False))) for c in sets}
    single, _, z = model.expected(found)
    assert math.isclose(z, math.log(sum(weight.values())))
    for k in range(3):
        assert math.isclose(single[k], sum(w for c, w in weight.items() if k in c) / sum(weight.values()))


def test_redaction_keeps_the_rest():
    text = "Ask for Maria Torberg at +1 415 555 0123, thanks."
    assert redact(text, find(text, LEX, trained())) == "Ask for [NAME] at [PHONE], thanks."
    assert set(PLACEHOLDERS) == {"email", "phone", "id_number", "address", "name"}


def test_people_of_headers():
    raw = 'From: "Torberg, Maria" <m@x.example>\nTo: Jan Lindqvist <j@x.example>,\n =?utf-8?q?J=C3=B6rg?= <k@x.example>, list@x.example\nSubject: No Body <n@x.example>\n\nFrom: Not Header <z@x.example>'
    assert people(raw) == [("maria", "torberg"), ("jan", "lindqvist"), ("jörg", "")]


def test_long_text_takes_linear_time():
    text = "Ask for Maria Torberg at +1 415 555 0123 or m@x.example. " * 4000
    assert len(find(text, LEX, trained())) == 12000
    assert isinstance(find("1 " * 50_000 + "a@" * 20_000 + "(0" * 20_000, LEX, trained()), list)


def test_tables(spark):
    mail = "From: Maria Torberg <m@x.example>\n\nJan Lindqvist, 12 Mill Road, Eastbury AB1 2CD, jan@x.example, jan@x.example"
    rows = [(k, mail) for k in range(20)] + [(90, None), (91, ""), (92, "From: Jan Lindqvist <j@x.example>\n\nMaria Torberg called")]
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], "id long, body string, finds string")
    lex = fit_lexicons(df, "id", "body")
    assert {"maria", "jan"} <= lex.given and {"torberg", "lindqvist"} <= lex.surnames
    got = {r.doc_id: r for r in personal_information(df, "id", "body", with_text=True).collect()}
    assert len(got) == len(rows) and got[90].finds == got[91].finds == []
    assert {(f.pii_type, f.pii_key) for f in got[3].finds} == {("name", "lindqvist"), ("address", "1212"), ("email", "jan@x.example")} and len(got[3].finds) == 3
    assert got[92].redacted == "[NAME] called"
    assert personal_information(df.where("false"), "id", "body").count() == 0


def test_lexicons_are_of_all_mails(spark):
    def word(k):
        return "".join("bdfgklmnpr"[int(c)] for c in f"{k:04}")

    rows = [(k, f"From: Maria Q{word(k)} <m@x.example>\n\nsaw v{word(k // 2)}") for k in range(9000)]
    lex = fit_lexicons(spark.createDataFrame(rows, "id long, body string"), "id", "body")
    assert lex == Lexicons(frozenset({"maria"}), frozenset(f"q{word(k)}" for k in range(9000)), frozenset({"saw", *(f"v{word(k)}" for k in range(4500))}))


def test_long_runs_of_overlaps_are_decoded_whole():
    r = random.Random(2)
    found = [Span(3 * k, 3 * k + r.randint(8, 30), "phone", "k", (f"f{k}",)) for k in range(900)]
    model = Model({f"f{k}": r.uniform(0.5, 2) for k in range(900)} | {"phone>phone": 0.3})
    got = model.decode(found)
    assert all(a.end <= b.start for a, b in zip(got, got[1:], strict=False))
    best = []
    for k, s in enumerate(found):
        best.append(model.score(s) + max([0.0, *(best[j] + model.pair(found[j], s) for j in range(k) if found[j].end <= s.start)]))
    total = sum(map(model.score, got)) + sum(model.pair(a, b) for a, b in zip(got, got[1:], strict=False))
    assert abs(total - max(best)) < 1e-9


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("It is at 12 Mill Road, Eastbury 12345-6789 now", {("address", "12123456789")}), ("Adres: Kerkstraat 12, 1234 AB Oudeberg", {("address", "121234")}), ("Adres: Kerkstraat 12\n1234AB Oudeberg", {("address", "121234")}),
        ("Adresse: Birkenweg 7a, 8001 Hohenau", {("address", "78001")}), ("Calls rose from 12 May 2031 to June", set()), ("The ring was down on Monday 12, 2031 Hall", set()), ("Sent: January 12, 2031 The ring", set()), ("Serial 12345-67890 and 12345-678", set()),
    ],
)
def test_forms_of_postcodes(text, want):
    assert keys(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Call 020 7946 0958\n020 7946 0961", {("phone", "02079460958"), ("phone", "02079460961")}), ("Tel 030 12345 6789\n040 55512-331", {("phone", "030123456789"), ("phone", "04055512331")}),
        ("(415) 555-0124\n(415) 555-0125\n(415) 555-0126", {("phone", "4155550124"), ("phone", "4155550125"), ("phone", "4155550126")}), ("Phone: +1 212 555\n0131\n", {("phone", "12125550131")}),
        ("call +1 2 1 2 5 5 5 0 1 3 1 now", {("phone", "12125550131")}), ("y" * 100 + "@mail.quarto.example", {("email", "y" * 100 + "@mail.quarto.example")}), ("y" * 300 + "@mail.quarto.example", set()),
        ("Adresse: Avenida de la Gran Paz de los Reyes 9, 28001 Villaseca", {("address", "928001")}),
    ],
)
def test_nothing_is_cut_off(text, want):
    assert keys(text) == want


def test_no_head_of_a_find_stays():
    long = "y" * 100 + "@mail.quarto.example"
    for text, want in ((f"to {long} now", "to [EMAIL] now"), ("Adresse: Avenida de la Gran Paz de los Reyes 9, 28001 Villaseca.", "Adresse: [ADDRESS].")):
        assert redact(text, find(unwrapped(text), LEX, trained())) == want


def test_a_larger_vocabulary_is_refused(spark, monkeypatch):
    df = spark.createDataFrame([(k, "From: Maria Torberg <m@x.example>\n\nsome words that are seen twice") for k in range(2)], "id long, body string")
    monkeypatch.setattr(pii_tables, "MAX_WORDS", 3)
    with pytest.raises(ValueError, match="support"):
        fit_lexicons(df, "id", "body")
    assert fit_lexicons(df, "id", "body", support=3).surnames == {"torberg"}
