"""The text of a mail: all its text parts, with transfer encoding, charset and markup undone.

``mail_text`` reads one whole mail as it is stored. Parts may be nested, cut off or wrongly declared;
what can be read is read. Binary parts and all headers are left out.
"""

from __future__ import annotations

import binascii
import codecs
import re
from collections.abc import Iterator
from html import unescape

_HEAD_END = re.compile(r"\r?\n[ \t]*\r?\n")
_FIELD = re.compile(r"^(content-(?:type|transfer-encoding))[ \t]*:[ \t]*([^\r\n]*(?:\r?\n[ \t]+[^\r\n]*)*)", re.I | re.M)
_LOOKS_HEAD = re.compile(r"\A(?:>?From [^\n]*\n)?[!-9;-~]+[ \t]*:")
_BOUNDARY = re.compile(r"""boundary[ \t]*=[ \t]*(?:"([^"\r\n]+)"|([^\s;"]+))""", re.I)
_CHARSET = re.compile(r"""charset[ \t]*=[ \t]*["']?([\w.:-]+)""", re.I)
_SOFT = re.compile(r"=[ \t]*\r?\n")
_HEX = re.compile(r"=([0-9A-Fa-f]{2})")
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]")
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(style|script|head|title)\b.*?(?:</\1\s*>|\Z)", re.I | re.S)
_BLOCK = re.compile(r"</?(?:p|div|br|hr|tr|table|li|ul|ol|h[1-6]|blockquote|pre|body|html|dd|dt|section|article)\b[^<>]*>", re.I)
_BLANKS = re.compile(r"[ \t\r\n]+")
_CELL = re.compile(r"</?t[dh]\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z!?][^<>]*(?:>|\Z)")
_LINE_REST = re.compile(r"(--)?[ \t]*\r?(?:\n|\Z)")
#: Parts that one mail may nest; what lies deeper is read as plain text.
MAX_DEPTH = 20


def _decode(data: bytes, charset: str | None) -> str:
    """Bytes as text: UTF-8 if they are valid UTF-8, else as declared. A last character that is cut off
    is dropped, if UTF-8 is declared or other characters show that it is."""
    try:
        return data.decode()
    except UnicodeDecodeError as e:
        cut = e.end == len(data) and e.reason == "unexpected end of data"
        if cut and ((charset or "").lower().replace("_", "-") in ("utf-8", "utf8") or not data[: e.start].isascii()):
            return data[: e.start].decode()
    try:
        name = codecs.lookup(charset or "cp1252").name
    except (LookupError, ValueError):
        name = "cp1252"
    if name in ("utf-8", "ascii", "iso8859-1"):
        name = "cp1252"
    try:
        return data.decode(name, "replace")
    except (LookupError, ValueError):
        return data.decode("latin-1")


def _quoted(body: str, charset: str | None) -> str:
    body = _SOFT.sub("", body)
    if "=" not in body:
        return body
    if body.isascii():
        return _decode(_HEX.sub(lambda m: chr(int(m[1], 16)), body).encode("latin-1"), charset)
    return re.sub(r"(?:=[0-9A-Fa-f]{2})+", lambda m: _decode(bytes.fromhex(m[0].replace("=", "")), charset), body)


def _base64(body: str, charset: str | None) -> str:
    chars = _NOT_BASE64.sub("", body)
    chars = chars[: len(chars) - (len(chars) % 4 == 1)]
    return _decode(binascii.a2b_base64(chars + "=" * (-len(chars) % 4)), charset)


def html_text(html: str) -> str:
    """Text of markup: hidden elements dropped, block elements on their own line, entities resolved."""
    html = _BLOCK.sub("\n", _BLANKS.sub(" ", _HIDDEN.sub(" ", html)))
    html = _TAG.sub("", _CELL.sub(" ", html))
    return unescape(html).replace("\xa0", " ") if "&" in html else html.replace("\xa0", " ")


def _split(entity: str) -> tuple[str, str]:
    m = _HEAD_END.search(entity)
    first = entity[:1] in "\r\n" and re.match(r"\s*?\r?\n", entity)
    if first:
        return "", entity[first.end() :]
    return (entity, "") if m is None else (entity[: m.start()], entity[m.end() :])


def _boundary_lines(body: str, mark: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether it is the last) of the lines that are ``mark``, or ``mark`` and two hyphens."""
    at = body.find(mark)
    while at >= 0:
        m = (at == 0 or body[at - 1] == "\n") and _LINE_REST.match(body, at + len(mark))
        if m:
            yield at, m.end(), m[1] is not None
        at = body.find(mark, m.end() if m else at + 1)


def _parts(entity: str, out: list[str], depth: int, top: bool) -> None:
    head, body = _split(entity)
    if top and not _LOOKS_HEAD.match(entity):
        head, body = "", entity
    kind, encoding = "text/plain", ""
    for name, value in _FIELD.findall(head):
        if name[8] in "tT" and name[9] in "yY":
            kind = value
        else:
            encoding = value.strip().lower()
    low = kind.lstrip().lower()
    if low.startswith("multipart/") and depth < MAX_DEPTH and (b := _BOUNDARY.search(kind)):
        at = end = None
        for start, after, end in _boundary_lines(body, "--" + (b[1] or b[2])):
            if at is not None:
                _parts(body[at:start], out, depth + 1, False)
            at = after
            if end:
                break
        if at is None:
            out.append(body)
        elif not end:
            _parts(body[at:], out, depth + 1, False)
        return
    if low.startswith("message/rfc822") and depth < MAX_DEPTH:
        _parts(body, out, depth + 1, True)
        return
    if depth >= MAX_DEPTH and (low.startswith("message/rfc822") or low.startswith("multipart/") and _BOUNDARY.search(kind)):
        out.append(body)
        return
    if not (low.startswith("text/") or not low or "/" not in low):
        return
    charset = c[1] if (c := _CHARSET.search(kind)) else None
    if encoding.startswith("base64"):
        body = _base64(body, charset)
    elif encoding.startswith("quoted"):
        body = _quoted(body, charset)
    out.append(html_text(body) if low.startswith("text/html") else body)


def mail_text(raw: str | None) -> str:
    """All text parts of a mail, in order, one blank line between; empty for null and empty mails."""
    if not raw:
        return ""
    out: list[str] = []
    _parts(raw, out, 0, True)
    return "\n\n".join(out).replace("\r\n", "\n")
