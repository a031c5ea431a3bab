"""Deduplication keys: the JSON text of fields and values, and its hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trapflow.functions.matching import Event

# Characters with a short escape; other controls, <, >, & and U+2028/9 are \u00xx.
_SHORT = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", '"': '\\"'}
_LONG = [chr(c) for c in range(32) if chr(c) not in _SHORT] + ["<", ">", "&", "\u2028", "\u2029"]
_SPECIAL = '[\\x00-\\x1f"\\\\<>&\\u2028\\u2029]'


def escaped_text(text: str) -> str:
    """A constant as it stands inside a JSON string."""
    out = text.replace("\\", "\\\\")
    for c, e in [*_SHORT.items(), *((c, f"\\u{ord(c):04x}") for c in _LONG)]:
        out = out.replace(c, e)
    return out


def escaped(value: Column) -> Column:
    """A value as it stands inside a JSON string; plain values pass unchanged."""
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for c, e in [*_SHORT.items(), *((c, f"\\u{ord(c):04x}") for c in _LONG)]:
        out = F.replace(out, F.lit(c), F.lit(e))
    return F.when(value.rlike(_SPECIAL), out).otherwise(value)


def escaped_column(name: str) -> Column:
    """The same of a column, as one expression that is parsed at once."""
    out = rf"replace({name}, r'\', r'\\')"
    for c, e in [*_SHORT.items(), *((c, f"\\u{ord(c):04x}") for c in _LONG)]:
        out = f"replace({out}, char({ord(c)}), r'{e}')" if ord(c) < 128 else f"replace({out}, '{c}', r'{e}')"
    return F.when(F.col(name).rlike(_SPECIAL), F.expr(out)).otherwise(F.col(name))


def dedup_key(event: Event, names: tuple[str, ...]) -> Column:
    """STRUCT<hash, repr, missing>: hash and repr null if a field is blank or none is asked for.

    Values are taken as they are, not normalized; names and their order are part of the key.
    """
    values = [event.resolve(n) for n in names]
    blank = [v == "" for v in values]
    missing = F.filter(F.array(*(F.when(b, F.lit(n)) for n, b in zip(names, blank, strict=True))), lambda x: x.isNotNull()) if names else F.array().cast("array<string>")
    parts: list[Column] = []
    for k, (n, v) in enumerate(zip(names, values, strict=True)):
        slot = event.slot(n)
        parts += [F.lit(("[" if k == 0 else ",") + '{"field":"' + escaped_text(n) + '","value":"'), escaped(v) if slot is None else escaped_column(slot), F.lit('"}')]
    any_blank = F.lit(not names)
    for b in blank:
        any_blank = any_blank | b
    text = F.when(~any_blank, F.concat(*parts, F.lit("]"))) if parts else F.lit(None).cast("string")
    return F.struct(F.sha2(text, 256).alias("hash"), text.alias("repr"), missing.alias("missing"))


def key_text(names: list[str], values: list[str]) -> str:
    """The same text for constants."""
    return "[" + ",".join(f'{{"field":"{escaped_text(n)}","value":"{escaped_text(v)}"}}' for n, v in zip(names, values, strict=True)) + "]"


