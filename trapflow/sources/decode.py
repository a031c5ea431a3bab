"""Datagrams into events: an Arrow-batched decoder, then a projection that builds the field map."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trapflow.config import User
from trapflow.functions.ber import Message, WireError, library_shape, read_message
from trapflow.functions.oid import normalize

VARBIND = T.StructType([T.StructField(n, T.StringType()) for n in ("oid", "type_name", "value")])
_TEXTS = ("community", "pdu_type", "enterprise_oid", "agent_address", "generic_trap", "generic_trap_name", "specific_trap", "uptime", "trap_oid")
_NUMBERS = ("request_id", "error_status", "error_index")
#: What the decoder adds to a packet's row; ``error`` is null where the packet could be read.
DECODED = T.StructType(
    [T.StructField("error", T.StringType()), T.StructField("version", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in _TEXTS), *(T.StructField(n, T.LongType()) for n in _NUMBERS), T.StructField("varbinds", T.ArrayType(VARBIND))]
)


def _row(payload: bytes | None, short_names: bool, users: Mapping[str, tuple[str, ...]], informs: bool, library: bool) -> dict:
    try:
        if payload is None:
            raise WireError("no payload")
        m: Message = read_message(bytes(payload), short_names or library, dict(users), informs)
        m = library_shape(m) if library else m
    except WireError as e:
        return {f.name: None for f in DECODED.fields} | {"error": str(e)}
    limit = 2**63
    numbers = {n: v if (v := getattr(m, n)) is not None and -limit <= v < limit else None for n in _NUMBERS}
    return {"error": None, "version": m.version, **{n: getattr(m, n) for n in _TEXTS}, **numbers, "varbinds": [{"oid": o, "type_name": k, "value": v} for o, k, v in m.varbinds]}


def decoder(users: tuple[User, ...] = (), short_names: bool = False, informs: bool = False, library: bool = False):
    """Column function BINARY -> struct DECODED. A packet that cannot be read has only ``error``.

    ``short_names``: value types by their short names; ``library``: these, the kind of message by name and no
    request and error numbers.
    """
    known = {u.name: (u.auth_protocol, u.auth_passphrase, u.priv_protocol, u.priv_passphrase) for u in users}
    names = [f.name for f in DECODED.fields]

    @F.pandas_udf(DECODED)
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for payloads in batches:
            got = pd.DataFrame([_row(p, short_names, known, informs, library) for p in payloads], columns=names)
            for n in ("version", *_NUMBERS):
                got[n] = got[n].astype("Int64")
            yield got

    return decode


def decode_packets(packets: DataFrame, payload: str = "payload", **options) -> DataFrame:
    """Packets (seq, received_at, source_ip, source_port, payload) with the decoded columns beside them."""
    kept = [c for c in packets.columns if c not in {f.name for f in DECODED.fields}]
    rows = packets.select(*kept, decoder(**options)(F.col(payload)).alias("_decoded"))
    return rows.select(*(c for c in kept if c != payload), F.col(payload).alias("raw_bytes"), "_decoded.*")


def alias_table(aliases: Mapping[str, str]) -> dict[str, str]:
    """Aliases by dotless OID. Of two notations of one OID, the dotless one counts; blank aliases are none."""
    table: dict[str, str] = {}
    for oid, alias in sorted(aliases.items(), key=lambda kv: kv[0].strip().startswith(".")):
        table.setdefault(oid.strip().removeprefix("."), alias)
    return {o: a for o, a in table.items() if a}


def _entry(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def field_map(event: DataFrame, aliases: Mapping[str, str], numbers: bool = True) -> Column:
    """MAP of all fields that rules may name, from an event's columns.

    Address, port, version, community and kind always; the others where they are not blank or 0;
    ``varbind.<oid>`` for each binding and, for aliased OIDs, ``alias`` and ``fields.alias``. Later
    entries win, so an alias may cover a field of its name. ``numbers``: with request and error numbers.
    """
    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    always = [_entry(F.lit(c), text(c)) for c in ("source_ip", "source_port", "version", "community", "pdu_type")]
    some = [_entry(F.lit(c), text(c)) for c in ("enterprise_oid", "agent_address", "generic_trap", "generic_trap_name", "specific_trap", "uptime")]
    some += [_entry(F.lit(c), F.when(F.col(c) != 0, text(c)).otherwise("")) for c in _NUMBERS if numbers and c in event.columns]
    some.append(_entry(F.lit("trap_oid"), normalize(text("trap_oid"))))
    some.append(_entry(F.lit("snmp_version"), F.when(F.col("version") == 3, "v3").otherwise("")))
    bound = F.coalesce(F.col("varbinds"), F.array().cast(T.ArrayType(VARBIND)))
    table = alias_table(aliases)
    known = F.create_map(*(F.lit(x) for kv in table.items() for x in kv)) if table else None

    def of(vb: Column) -> Column:
        oid, value = normalize(F.coalesce(vb["oid"], F.lit(""))), F.coalesce(vb["value"], F.lit(""))
        own = [_entry(F.concat(F.lit("varbind."), oid), value)]
        if known is not None:
            alias = F.try_element_at(known, oid)
            own += [_entry(alias, value), _entry(F.concat(F.lit("fields."), alias), value)]
        return F.array(*own)

    entries = F.concat(F.array(*always), F.filter(F.array(*some), lambda e: e["value"] != ""), F.filter(F.flatten(F.transform(bound, of)), lambda e: e["key"].isNotNull()))
    return last_wins(entries)


def last_wins(entries: Column) -> Column:
    """MAP from ARRAY<STRUCT<key, value>> in which the last of equal keys counts, whatever the session says."""
    from trapflow.functions.expr import let

    def build(es: Column) -> Column:
        keys = F.transform(es, lambda e: e["key"])
        last = F.filter(es, lambda e, i: F.array_position(F.slice(keys, i + 2, F.greatest(F.size(keys), F.lit(1))), e["key"]) == 0)
        return F.map_from_entries(F.when(F.size(F.array_distinct(keys)) == F.size(keys), es).otherwise(last))

    return let(entries, build)


def raw_varbind_map() -> Column:
    """MAP of the bindings by dotless OID, the last of equal OIDs."""
    bound = F.coalesce(F.col("varbinds"), F.array().cast(T.ArrayType(VARBIND)))
    return last_wins(F.transform(bound, lambda vb: _entry(normalize(F.coalesce(vb["oid"], F.lit(""))), F.coalesce(vb["value"], F.lit("")))))


def events(packets: DataFrame, aliases: Mapping[str, str] | None = None, **options) -> DataFrame:
    """Events of the packets that can be read, with ``raw_varbind_map`` and ``fields``."""
    read = decode_packets(packets, **options).where("error is null").drop("error")
    return read.withColumn("raw_varbind_map", raw_varbind_map()).withColumn("fields", field_map(read, aliases or {}))
