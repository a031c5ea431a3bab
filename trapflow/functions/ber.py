"""Wire format of notifications: basic encoding rules, both ways, for protocol versions 1, 2c and 3.

A message that cannot be read raises WireError; nothing else leaves this module.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

from trapflow.functions.cipher import cfb_decrypt, cfb_encrypt

# Object identifiers and tags of the protocol.
TRAP_OID, UPTIME_OID = "1.3.6.1.6.3.1.1.4.1.0", "1.3.6.1.2.1.1.3.0"
V1_TRAP, V2_TRAP, INFORM = 0xA4, 0xA7, 0xA6
PDU_NAMES = {V1_TRAP: "Trap", V2_TRAP: "SNMPv2Trap", INFORM: "InformRequest"}
GENERIC_NAMES = ("coldStart", "warmStart", "linkDown", "linkUp", "authenticationFailure", "egpNeighborLoss", "enterpriseSpecific")
TAG_CLASSES = ("universal", "application", "context", "private")
#: Names of value types: (class, number) -> strict name, short name.
TYPE_NAMES = {
    (0, 2): ("INTEGER", "Integer"), (0, 3): ("BIT STRING", "BitString"), (0, 4): ("OCTET STRING", "OctetString"), (0, 5): ("NULL", "Null"), (0, 6): ("OBJECT IDENTIFIER", "ObjectIdentifier"),
    (0, 16): ("SEQUENCE", "Sequence"), (1, 0): ("IPADDRESS", "IPAddress"), (1, 1): ("COUNTER32", "Counter32"), (1, 2): ("GAUGE32", "Gauge32"), (1, 3): ("TIMETICKS", "TimeTicks"),
    (1, 4): ("OPAQUE", "Opaque"), (1, 6): ("COUNTER64", "Counter64"), (2, 0): ("noSuchObject", "NoSuchObject"), (2, 1): ("noSuchInstance", "NoSuchInstance"), (2, 2): ("endOfMibView", "EndOfMibView"),
}


def library_shape(message: Message) -> Message:
    """The message as the other decoder shows it: the kind by its name, no request and error numbers."""
    kind = int(message.pdu_type, 16)
    return replace(message, pdu_type=PDU_NAMES.get(kind, message.pdu_type), request_id=None, error_status=None, error_index=None)


class WireError(ValueError):
    """Bytes that are no message of the protocol."""


def elements(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int]]:
    """(tag, start, end) of the elements one after the other in ``data[at:end]``."""
    end = len(data) if end is None else end
    while at < end:
        if end - at < 2:
            raise WireError("truncated element")
        tag, length = data[at], data[at + 1]
        at += 2
        if length >= 0x80:
            octets = length & 0x7F
            if not 1 <= octets <= 4:
                raise WireError("indefinite length" if octets == 0 else "length too large")
            if end - at < octets:
                raise WireError("truncated length")
            length = int.from_bytes(data[at : at + octets])
            at += octets
        if end - at < length:
            raise WireError("truncated value")
        yield tag, at, at + length
        at += length


class _Fields:
    """The elements of one constructed value, taken in order."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None) -> None:
        self.data, self.each = data, elements(data, at, end)

    def take(self, what: str, tag: int | None = None) -> tuple[int, bytes]:
        for got, s, e in self.each:
            # The bit for constructed values does not tell the kind of value.
            if tag is not None and (got & 0xC0, got & 0x1F) != (tag & 0xC0, tag & 0x1F):
                raise WireError(f"expected {what}")
            return got, self.data[s:e]
        raise WireError(f"missing {what}")


def signed(octets: bytes) -> int:
    return int.from_bytes(octets, signed=True)


def oid_text(octets: bytes) -> str:
    """Dotted decimal; blank for no octets. Only a last part that is begun and not 0 is an error."""
    if not octets:
        return ""
    root = min(octets[0] // 40, 2)
    parts, value = [root, octets[0] - 40 * root], 0
    for b in octets[1:]:
        value = value << 7 | b & 0x7F
        if b < 0x80:
            parts.append(value)
            value = 0
    if value:
        raise WireError("truncated object identifier")
    return ".".join(map(str, parts))


def value_text(tag: int, octets: bytes, short_names: bool = False) -> tuple[str, str]:
    """(type name, text) of a value: numbers in decimal, octets as UTF-8 or else in hexadecimal."""
    kind = (tag >> 6, tag & 0x1F)
    names = TYPE_NAMES.get(kind)
    name = names[short_names] if names else f"{TAG_CLASSES[kind[0]]}[{kind[1]}]"
    if kind == (0, 2):
        return name, str(signed(octets))
    if kind in ((1, 1), (1, 2), (1, 3), (1, 6)):
        return name, str(int.from_bytes(octets))
    if kind == (0, 6):
        return name, oid_text(octets)
    if kind == (0, 5) or kind[0] == 2 and kind[1] < 3:
        return name, ""
    if kind == (0, 4):
        try:
            return name, octets.decode()
        except UnicodeDecodeError:
            pass
    if kind == (1, 0) and len(octets) in (4, 16):
        address = ipaddress.ip_address(octets)
        return name, str(getattr(address, "ipv4_mapped", None) or address)
    return name, "0x" + octets.hex()


@dataclass
class Message:
    """A notification as read from the wire. Numbers that the protocol version lacks are null."""

    version: int
    community: str
    pdu_type: str
    enterprise_oid: str = ""
    agent_address: str = ""
    generic_trap: str = ""
    generic_trap_name: str = ""
    specific_trap: str = ""
    uptime: str = ""
    request_id: int | None = None
    error_status: int | None = None
    error_index: int | None = None
    trap_oid: str = ""
    varbinds: list[tuple[str, str, str]] = field(default_factory=list)


def _varbinds(data: bytes, short_names: bool) -> list[tuple[str, str, str]]:
    out = []
    for tag, s, e in elements(data):
        if tag != 0x30:
            raise WireError("expected a variable binding")
        pair = _Fields(data, s, e)
        _, oid = pair.take("object identifier", 0x06)
        kind, value = pair.take("value")
        out.append((oid_text(oid), *value_text(kind, value, short_names)))
    return out


def _first(found: dict[str, str], oid: str) -> str:
    return (found.get(oid) or "").strip().removeprefix(".")


def _read_pdu(message: Message, tag: int, body: bytes, short_names: bool) -> Message:
    f = _Fields(body)
    if tag == V1_TRAP:
        message.enterprise_oid = oid_text(f.take("enterprise")[1])
        message.agent_address = value_text(*f.take("agent address"))[1]
        generic, specific, ticks = (f.take(what)[1] for what in ("generic trap", "specific trap", "uptime"))
        number = signed(generic)
        message.generic_trap, message.specific_trap, message.uptime = str(number), str(signed(specific)), str(int.from_bytes(ticks))
        message.generic_trap_name = GENERIC_NAMES[number] if 0 <= number < len(GENERIC_NAMES) else str(number)
        message.trap_oid = f"v1:{message.enterprise_oid}:{number}:{message.specific_trap}"
    elif tag in (V2_TRAP, INFORM):
        message.request_id, message.error_status, message.error_index = (signed(f.take(what)[1]) for what in ("request id", "error status", "error index"))
    else:
        raise WireError(f"unsupported kind of message 0x{tag:02x}")
    listed, body = f.take("variable bindings")
    if listed != 0x30:
        raise WireError("expected variable bindings")
    message.varbinds = _varbinds(body, short_names)
    if tag != V1_TRAP:
        found = {o: v for o, _, v in message.varbinds}
        message.trap_oid, message.uptime = _first(found, TRAP_OID), _first(found, UPTIME_OID)
    return message


def read_message(data: bytes, short_names: bool = False, users: dict[str, tuple[str, ...]] | None = None, informs: bool = False) -> Message:
    """The notification in a datagram; bytes after the message are not looked at.

    ``users``: name -> (authentication protocol, passphrase[, privacy protocol, passphrase]) for version 3.
    Messages encrypted with AES are read; with DES they raise WireError. ``informs``: take acknowledged
    notifications too.
    """
    tag, s, e = next(elements(data), (0, 0, 0))
    if tag != 0x30:
        raise WireError("not a message")
    f = _Fields(data, s, e)
    version = signed(f.take("version", 0x02)[1])
    if version == 3:
        return _read_v3(data, s, e, short_names, users or {}, informs)
    community = f.take("community", 0x04)[1].decode("utf-8", "replace")
    kind, body = f.take("message body")
    if kind == INFORM and not informs:
        raise WireError("unsupported kind of message 0xa6")
    return _read_pdu(Message(version, community, f"0x{kind:02x}"), kind, body, short_names)


# Hash and length of the signature, by authentication protocol.
_HASHES = {"md5": ("md5", 12), "sha": ("sha1", 12), "sha224": ("sha224", 16), "sha256": ("sha256", 24), "sha384": ("sha384", 32), "sha512": ("sha512", 48)}


# Bytes of the key, by privacy protocol, and whether a longer key is made by hashing the key again
# (False) or by treating it as a passphrase of its own (True).
_CIPHERS = {"aes": (16, False), "aes192": (24, False), "aes256": (32, False), "aes192c": (24, True), "aes256c": (32, True)}


@lru_cache(maxsize=4096)
def privacy_key(auth: str, privacy: str, passphrase: str, engine: bytes) -> bytes:
    """The key of a cipher at an engine: the localized key, made longer where the cipher needs more."""
    length, again = _CIPHERS[privacy]
    name, _ = _HASHES[auth]
    key = localized_key(auth, passphrase, engine)
    part = key
    while len(key) < length:
        part = _localized(name, part, engine) if again else hashlib.new(name, key).digest()
        key += part
    return key[:length]


def _localized(name: str, raw: bytes, engine: bytes) -> bytes:
    key = hashlib.new(name, (raw * (1_048_576 // len(raw) + 1))[:1_048_576]).digest()
    return hashlib.new(name, key + engine + key).digest()


@lru_cache(maxsize=4096)
def localized_key(protocol: str, passphrase: str, engine: bytes) -> bytes:
    """The user's key at an engine (RFC 3414): a hash of one million octets of the passphrase, then of the engine."""
    name, _ = _HASHES[protocol]
    if not passphrase:
        raise WireError("no passphrase")
    return _localized(name, passphrase.encode(), engine)


def _read_v3(data: bytes, s: int, e: int, short_names: bool, users: dict[str, tuple[str, ...]], informs: bool) -> Message:
    f = _Fields(data, s, e)
    f.take("version")
    header = _Fields(f.take("header", 0x30)[1])
    header.take("message id"), header.take("largest size")
    flags = header.take("flags")[1][:1] or b"\0"
    security = f.take("security parameters", 0x04)[1]
    inner = next(elements(security), None)
    if inner is None or inner[0] != 0x30:
        raise WireError("expected security parameters")
    p = _Fields(security, inner[1], inner[2])
    engine, boots, clock, user, signature, salt = (p.take(what)[1] for what in ("engine", "boots", "time", "user", "signature", "salt"))
    protocol, passphrase, privacy, secret = (*users.get(user.decode("utf-8", "replace"), ()), "", "", "", "")[:4]
    if flags[0] & 2 and not flags[0] & 1:
        raise WireError("an encrypted message must be signed")
    if flags[0] & 1:
        if protocol not in _HASHES:
            raise WireError("unknown user")
        at = data.find(signature, s) if signature else -1
        blank = data[:at] + bytes(len(signature)) + data[at + len(signature) :]
        name, length = _HASHES[protocol]
        if at < 0 or not hmac.compare_digest(hmac.new(localized_key(protocol, passphrase, engine), blank, name).digest()[:length], signature):
            raise WireError("wrong signature")
    if flags[0] & 2:
        if privacy not in _CIPHERS:
            raise WireError("no cipher for this user's messages")
        if len(salt) != 8:
            raise WireError("expected a salt of 8 bytes")
        start = b"".join((int.from_bytes(x) & 0xFFFFFFFF).to_bytes(4) for x in (boots, clock)) + salt
        plain = cfb_decrypt(f.take("encrypted message", 0x04)[1], privacy_key(protocol, privacy, secret, engine), start)
        inner = next(elements(plain), None)
        if inner is None or inner[0] != 0x30:
            raise WireError("wrong key")
        scoped = _Fields(plain, inner[1], inner[2])
    else:
        scoped = _Fields(f.take("scoped message", 0x30)[1])
    scoped.take("context engine"), scoped.take("context name")
    kind, body = scoped.take("message body")
    if kind == INFORM and not informs:
        raise WireError("unsupported kind of message 0xa6")
    return _read_pdu(Message(3, "", f"0x{kind:02x}"), kind, body, short_names)


# ---- encoding, for fixtures and load


def element(tag: int, value: bytes) -> bytes:
    if len(value) < 0x80:
        return bytes((tag, len(value))) + value
    size = len(value).to_bytes((len(value).bit_length() + 7) // 8)
    return bytes((tag, 0x80 | len(size))) + size + value


def integer(value: int, tag: int = 0x02) -> bytes:
    bits = value.bit_length() if value >= 0 else (value + 1).bit_length()
    return element(tag, value.to_bytes(bits // 8 + 1, signed=True))


def oid(text: str) -> bytes:
    parts = [int(x) for x in text.strip(".").split(".")]
    if len(parts) < 2:
        raise WireError("an object identifier needs two parts")
    out = bytearray((40 * parts[0] + parts[1],))
    for n in parts[2:]:
        out += bytes([*(n >> 7 * k & 0x7F | 0x80 for k in range(max(0, (n.bit_length() - 1) // 7), 0, -1)), n & 0x7F])
    return element(0x06, bytes(out))


def octets(value: str | bytes) -> bytes:
    return element(0x04, value.encode() if isinstance(value, str) else value)


def varbind_list(pairs: list[tuple[str, bytes]]) -> bytes:
    return element(0x30, b"".join(element(0x30, oid(o) + v) for o, v in pairs))


def v2_trap(trap: str, pairs: list[tuple[str, bytes]], community: str = "public", request_id: int = 1, uptime: int = 0, tag: int = V2_TRAP) -> bytes:
    bound = varbind_list([(UPTIME_OID, integer(uptime, 0x43)), (TRAP_OID, oid(trap)), *pairs])
    return element(0x30, integer(1) + octets(community) + element(tag, integer(request_id) + integer(0) + integer(0) + bound))


def v1_trap(enterprise: str, generic: int, specific: int, pairs: list[tuple[str, bytes]], agent: str = "0.0.0.0", community: str = "public", uptime: int = 0) -> bytes:
    body = oid(enterprise) + element(0x40, ipaddress.ip_address(agent).packed) + integer(generic) + integer(specific) + integer(uptime, 0x43) + varbind_list(pairs)
    return element(0x30, integer(0) + octets(community) + element(V1_TRAP, body))


def v3_trap(trap: str, pairs: list[tuple[str, bytes]], user: str = "", protocol: str = "", passphrase: str = "", engine: bytes = b"\x80\0\0\0\1", privacy: str = "", secret: str = "", salt: bytes = b"saltsalt") -> bytes:
    """A trap of version 3, signed if ``protocol`` is given, and encrypted if ``privacy`` is."""
    bound = varbind_list([(UPTIME_OID, integer(0, 0x43)), (TRAP_OID, oid(trap)), *pairs])
    length = _HASHES[protocol][1] if protocol else 0
    scoped = element(0x30, octets(engine) + octets(b"") + element(V2_TRAP, integer(1) + integer(0) + integer(0) + bound))
    if privacy:
        start = (1).to_bytes(4) * 2 + salt
        scoped = octets(cfb_encrypt(scoped, privacy_key(protocol, privacy, secret, engine), start))

    def whole(signature: bytes) -> bytes:
        header = element(0x30, integer(1) + integer(65507) + octets(bytes((bool(protocol) + 2 * bool(privacy),))) + integer(3))
        security = octets(element(0x30, octets(engine) + integer(1) + integer(1) + octets(user) + octets(signature) + octets(salt if privacy else b"")))
        return element(0x30, integer(3) + header + security + scoped)

    blank = whole(bytes(length))
    return whole(hmac.new(localized_key(protocol, passphrase, engine), blank, _HASHES[protocol][0]).digest()[:length]) if protocol else blank
