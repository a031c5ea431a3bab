"""Wire format, both ways, and the decoder."""

import ipaddress

import pytest
from hypothesis import given
from hypothesis import strategies as st

from trapflow.functions import ber
from trapflow.sources.decode import alias_table, decode_packets, events

OIDS = st.lists(st.integers(0, 2**32), min_size=1, max_size=8).map(lambda x: "1.3." + ".".join(map(str, x)))


@given(OIDS, st.lists(st.tuples(OIDS, st.integers(-(2**70), 2**70)), max_size=5), st.text(max_size=30), st.integers(-(2**31), 2**31 - 1))
def test_v2_round_trip(oid, pairs, text, request):
    data = ber.v2_trap(oid, [*((o, ber.integer(v)) for o, v in pairs), ("1.2.3", ber.octets(text))], community="c", request_id=request, uptime=7)
    m = ber.read_message(data + b"trailing")
    assert (m.version, m.community, m.pdu_type, m.trap_oid, m.uptime, m.request_id) == (1, "c", "0xa7", oid, "7", request)
    assert m.varbinds[2:] == [*((o, "INTEGER", str(v)) for o, v in pairs), ("1.2.3", "OCTET STRING", text)]


@given(st.integers(-3, 9), st.integers(0, 2**31 - 1))
def test_v1_round_trip(generic, specific):
    m = ber.read_message(ber.v1_trap("1.3.6.1.4.1.9", generic, specific, [], agent="10.1.2.3", uptime=5))
    assert (m.version, m.trap_oid, m.agent_address, m.uptime) == (0, f"v1:1.3.6.1.4.1.9:{generic}:{specific}", "10.1.2.3", "5")
    assert m.generic_trap_name == (ber.GENERIC_NAMES[generic] if 0 <= generic <= 6 else str(generic))


@given(st.binary(max_size=200))
def test_any_bytes_are_read_or_refused(data):
    try:
        ber.read_message(data)
    except ber.WireError:
        pass


@given(st.binary(max_size=3), st.integers(0, 120))
def test_damaged_messages_are_read_or_refused(junk, at):
    data = ber.v2_trap("1.3.6.1", [("1.3.6.2", ber.octets("x" * 40))])
    try:
        ber.read_message(data[:at] + junk + data[at + len(junk) :])
    except ber.WireError:
        pass


@pytest.mark.parametrize("data", [b"", b"\x30", b"\x30\x89" + b"\xff" * 9, b"\x30\x84\xff\xff\xff\xff", b"\x30\x80\0\0", b"\x31\0", ber.v2_trap("1.3", [], tag=0xA6), ber.v2_trap("1.3", [], tag=0xA2)])
def test_refused(data):
    with pytest.raises(ber.WireError):
        ber.read_message(data)


def test_informs_on_request():
    assert ber.read_message(ber.v2_trap("1.3.6", [], tag=0xA6), informs=True).trap_oid == "1.3.6"


@pytest.mark.parametrize(
    ("tag", "octets", "want"),
    [(0x02, b"", ("INTEGER", "0")), (0x02, b"\xff", ("INTEGER", "-1")), (0x04, b"\xff\x01", ("OCTET STRING", "0xff01")), (0x05, b"", ("NULL", "")), (0x06, b"\x2b\x06", ("OBJECT IDENTIFIER", "1.3.6")), (0x06, b"", ("OBJECT IDENTIFIER", "")),
     (0x06, b"\x78", ("OBJECT IDENTIFIER", "2.40")), (0x40, b"\x0a\0\0\1", ("IPADDRESS", "10.0.0.1")), (0x40, ipaddress.ip_address("2001:db8::1").packed, ("IPADDRESS", "2001:db8::1")), (0x40, b"\1", ("IPADDRESS", "0x01")),
     (0x41, b"\xff\xff\xff\xff", ("COUNTER32", "4294967295")), (0x46, b"\xff" * 8, ("COUNTER64", "18446744073709551615")), (0x43, b"\x80", ("TIMETICKS", "128")), (0x44, b"\1", ("OPAQUE", "0x01")), (0x80, b"", ("noSuchObject", "")),
     (0x82, b"", ("endOfMibView", "")), (0x47, b"\2", ("application[7]", "0x02")), (0x24, b"a", ("OCTET STRING", "a")), (0x30, b"\1", ("SEQUENCE", "0x01"))],
)
def test_value_types(tag, octets, want):
    assert ber.value_text(tag, octets) == want


def test_truncated_object_identifier():
    with pytest.raises(ber.WireError):
        ber.oid_text(b"\x2b\x81")
    assert ber.oid_text(b"\x2b\x80") == "1.3"


@pytest.mark.parametrize("protocol", ["md5", "sha", "sha256", "sha512"])
def test_signed_messages_of_version_3(protocol):
    data = ber.v3_trap("1.3.6.1.9", [("1.2.3", ber.integer(4))], "u", protocol, "long secret")
    assert ber.read_message(data, users={"u": (protocol, "long secret")}).trap_oid == "1.3.6.1.9"
    with pytest.raises(ber.WireError, match="signature"):
        ber.read_message(data, users={"u": (protocol, "other secret")})
    with pytest.raises(ber.WireError, match="user"):
        ber.read_message(data)


def test_unsigned_message_of_version_3():
    assert ber.read_message(ber.v3_trap("1.3.6", [])).version == 3


def test_a_key_of_rfc_3414():
    engine = bytes.fromhex("000000000000000000000002")
    assert ber.localized_key("md5", "maplesyrup", engine).hex() == "526f5eed9fcce26f8964c2930787d82b"
    assert ber.localized_key("sha", "maplesyrup", engine).hex() == "6695febc9288e36282235fc7151f128497b38f3f"


def test_decoded_events(spark):
    packets = [(1, ber.v2_trap("1.3.6.1.4.1.9.0.10", [("1.3.6.1.4.1.9.1.1", ber.integer(7)), ("1.3.6.1.4.1.9.1.1", ber.integer(8))])), (2, b"junk"), (3, None), (4, ber.v1_trap("1.3.6.1.4.1.9", 6, 3, []))]
    df = spark.createDataFrame([(q, "10.0.0.1", 162, bytearray(p) if p is not None else None, "clash") for q, p in packets], "seq long, source_ip string, source_port int, payload binary, error string")
    assert {r.seq: r.error is None for r in decode_packets(df).collect()} == {1: True, 2: False, 3: False, 4: True}
    got = {r.seq: r.asDict() for r in events(df, {".1.3.6.1.4.1.9.1.1": "ifIndex"}).collect()}
    assert set(got) == {1, 4}
    f = got[1]["fields"]
    assert (f["trap_oid"], f["varbind.1.3.6.1.4.1.9.1.1"], f["ifIndex"], f["fields.ifIndex"], f["pdu_type"], f["source_port"]) == ("1.3.6.1.4.1.9.0.10", "8", "8", "8", "0xa7", "162")
    assert "enterprise_oid" not in f and "error_status" not in f and got[1]["raw_varbind_map"]["1.3.6.1.4.1.9.1.1"] == "8"
    assert got[4]["fields"]["specific_trap"] == "3" and got[4]["fields"]["trap_oid"] == "v1:1.3.6.1.4.1.9:6:3"
    assert events(df.where("false")).count() == 0


def test_alias_covers_a_field_and_dotless_aliases_win(spark):
    assert alias_table({".1.2": "dotted", "1.2": "bare", "1.3": ""}) == {"1.2": "bare"}
    df = spark.createDataFrame([(1, "10.0.0.1", 162, bytearray(ber.v2_trap("1.3.6", [("1.2.3", ber.octets("other"))])))], "seq long, source_ip string, source_port int, payload binary")
    assert events(df, {"1.2.3": "source_ip"}).first().fields["source_ip"] == "other"


@pytest.mark.parametrize(
    ("size", "want"), [(16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (24, "dda97ca4864cdfe06eaf70a0ec0d7191"), (32, "8ea2b7ca516745bfeafc49904b496089")]
)  # the published examples of the cipher
def test_cipher(size, want):
    import numpy as np

    from trapflow.functions.cipher import cfb_decrypt, cfb_encrypt, encrypt_blocks

    block = np.frombuffer(bytes.fromhex("00112233445566778899aabbccddeeff"), dtype=np.uint8)[None, :]
    assert encrypt_blocks(block, bytes(range(size))).tobytes().hex() == want
    for n in (0, 1, 16, 31, 200):
        text = bytes(k * 7 % 251 for k in range(n))
        assert cfb_decrypt(cfb_encrypt(text, bytes(range(size)), b"s" * 16), bytes(range(size)), b"s" * 16) == text


def test_keys_of_a_passphrase():
    """The published examples of RFC 3414, A.3."""
    engine = bytes.fromhex("000000000000000000000002")
    assert ber.localized_key("md5", "maplesyrup", engine).hex() == "526f5eed9fcce26f8964c2930787d82b"
    assert ber.localized_key("sha", "maplesyrup", engine).hex() == "6695febc9288e36282235fc7151f128497b38f3f"
    assert ber.privacy_key("sha", "aes", "maplesyrup", engine).hex() == "6695febc9288e36282235fc7151f1284"
    assert len(ber.privacy_key("md5", "aes256", "maplesyrup", engine)) == len(ber.privacy_key("md5", "aes256c", "maplesyrup", engine)) == 32
    assert ber.privacy_key("md5", "aes192", "maplesyrup", engine) != ber.privacy_key("md5", "aes192c", "maplesyrup", engine)


@pytest.mark.parametrize("privacy", ["aes", "aes192", "aes256", "aes192c", "aes256c"])
def test_encrypted_messages(privacy):
    data = ber.v3_trap("1.3.6.1.9", [("1.2.3", ber.octets("long value " * 9))], "u", "sha256", "long secret", privacy=privacy, secret="other secret")
    users = {"u": ("sha256", "long secret", privacy, "other secret")}
    got = ber.read_message(data, users=users)
    assert (got.trap_oid, got.varbinds[-1][2]) == ("1.3.6.1.9", "long value " * 9)
    for wrong in ({"u": ("sha256", "long secret")}, {"u": ("sha256", "long secret", "des", "other secret")}, {"u": ("sha256", "long secret", privacy, "wrong secret")}, {}):
        with pytest.raises(ber.WireError):
            ber.read_message(data, users=wrong)
