"""Text of mails."""

import base64
import quopri

import pytest

from trapflow.llm.mail import html_text, mail_text
from trapflow.llm.words import words

HEAD = "From: a <a@b.example>\nSubject: s\n"


def part(kind, body, encoding=None, extra=""):
    return f"Content-Type: {kind}\n" + (f"Content-Transfer-Encoding: {encoding}\n" if encoding else "") + extra + "\n" + body


def multi(*parts, end=True, kind="mixed"):
    return HEAD + f'MIME-Version: 1.0\nContent-Type: multipart/{kind};\n\tboundary="=_b"\n\npreamble\n' + "".join(f"--=_b\n{p}\n" for p in parts) + ("--=_b--\nepilogue" if end else "")


TEXT = "Grüße aus Łódź – 1\n"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (None, ""), ("", ""), (HEAD + "\nbody\n", "body\n"), (HEAD.replace("\n", "\r\n") + "\r\nbody\r\n", "body\n"), ("From x Mon\n" + HEAD + "\nb", "b"), ("no headers here", "no headers here"), ("\n\nonly body", "\n\nonly body"), (HEAD + part("text/plain; charset=utf-8", "n=C3", "quoted-printable"), "n"),
        (HEAD + part("text/plain; charset=utf-8", base64.b64encode(TEXT.encode()).decode(), "base64"), TEXT), (HEAD + part("TEXT/PLAIN", quopri.encodestring(TEXT.encode()).decode(), "Quoted-Printable"), TEXT),
        (HEAD + part("text/plain; charset=iso-8859-1", quopri.encodestring("né".encode("latin-1")).decode(), "quoted-printable"), "né"), (HEAD + part("text/plain; charset=us-ascii", quopri.encodestring("né".encode()).decode(), "quoted-printable"), "né"),
        (HEAD + part("text/plain; charset=windows-1252", base64.b64encode("“x”".encode("cp1252")).decode(), "base64"), "“x”"), (HEAD + part("text/plain; charset=no-such", base64.b64encode(b"\x93x").decode(), "base64"), "“x"),
        (HEAD + part("text/plain", base64.b64encode(TEXT.encode()).decode()[:-6], "base64"), TEXT.encode()[:-5].decode("utf-8", "ignore")[:-0 or None]), (HEAD + part("application/pdf", "AAAA", "base64"), ""), (HEAD + part("image/png", "x"), ""),
        (multi(part("text/plain", "one"), part("text/csv", "a,b", extra="Content-Disposition: attachment\n"), part("image/png", "AAAA", "base64")), "one\n\n\na,b\n"), (multi(part("text/plain", "one"), end=False), "one\n"),
        (multi(part("text/plain", "x"), part('multipart/alternative; boundary="=_c"', "--=_c\n" + part("text/html", "<b>y</b>z") + "\n--=_c--")), "x\n\n\nyz "), (multi(part("message/rfc822", HEAD + "\ninner")), "inner\n"),
        (HEAD + "Content-Type: multipart/mixed\n\nno boundary", ""),
    ],
)
def test_texts(raw, want):
    if raw and "base64" in raw and want and want.startswith("Gr") and want != TEXT:
        assert TEXT.startswith(mail_text(raw)) and len(mail_text(raw)) >= len(TEXT) - 6
    else:
        assert mail_text(raw) == want


def test_markup():
    html = "<html><head><title>t</title></head><style>p{}</style><p>a &amp; b&nbsp;c\nd</p><!-- x --><div>e<br>f</div><td>g</td><td>h</td><i>in</i>line<script>no"
    assert html_text(html).split() == ["a", "&", "b", "c", "d", "e", "f", "g", "h", "inline"]


def test_long_and_deep_mails_end():
    assert len(mail_text(HEAD + "\n" + "word " * 400_000)) == 2_000_000
    deep = "x"
    for k in range(60):
        deep = f'Content-Type: multipart/mixed; boundary="b{k}"\n\n--b{k}\n{deep}\n--b{k}--\n'
    assert isinstance(mail_text(HEAD + deep), str)


def test_words():
    assert words("It’s “QUOTED”, re-used _and_ straße\xa0x2!") == ["its", "quoted", "re", "used", "and", "strasse", "x2"]
    assert words(None) == words("") == words(" .,") == []


def test_text_of_deep_mails_is_kept():
    deep = part("text/plain", "the innermost text")
    for k in range(60):
        deep = f'Content-Type: multipart/mixed; boundary="b{k}"\n\n--b{k}\n{deep}\n--b{k}--\n'
    assert "the innermost text" in mail_text(HEAD + deep)
    forwarded = HEAD + "\nthe innermost text"
    for _ in range(60):
        forwarded = HEAD + part("message/rfc822", forwarded)
    assert "the innermost text" in mail_text(forwarded)
