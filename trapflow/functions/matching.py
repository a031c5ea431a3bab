"""Match rules compiled to column expressions.

A match is TRUE, FALSE or, where it cannot be decided, NULL (an error of the event). Conditions are
looked at in order and stop early, so an error after a condition that already decides is never seen.
Whether a condition is an error is known when it is compiled: only patterns and operators can be wrong.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from trapflow.config import text_of
from trapflow.functions.oid import normalize

_OID_FIELDS = ("trap_oid", "enterprise_oid")


def plain_oid(text: str) -> str:
    """The notation that rules compare, of a constant."""
    return text.strip().removeprefix(".")


def is_oid_field(name: str) -> bool:
    return name in _OID_FIELDS or name.startswith(("varbind.", "varbind:"))


def field_keys(name: str) -> list[str]:
    """Names under which a field may stand, in the order in which they are tried."""
    keys = [name]
    if name.startswith("fields."):
        keys.append(name.removeprefix("fields."))
    if name.startswith(("varbind.", "varbind:")):
        oid = plain_oid(name[len("varbind.") :])
        keys += [f"varbind.{v}" for v in dict.fromkeys((oid, oid.strip()))]
    return [k for k in dict.fromkeys(keys) if k]


@dataclass(frozen=True)
class Event:
    """Where an event's fields are. ``known`` has columns or constants that stand for fields."""

    fields: Column
    varbinds: Column
    known: Mapping[str, Column] = field(default_factory=dict)

    def replaced(self, **known: Column) -> Event:
        return Event(self.fields, self.varbinds, {**self.known, **known})

    def resolve(self, name: str) -> Column:
        """Value of a field, blank if there is none: the name itself, the alias, the variable binding."""
        found = [self.known[k] if k in self.known else F.try_element_at(self.fields, F.lit(k)) for k in field_keys(name)]
        return F.coalesce(*found, F.lit(""))

    def compared(self, name: str) -> Column:
        return normalize(self.resolve(name)) if is_oid_field(name) else self.resolve(name)

    def slot(self, name: str) -> str | None:
        """Name of the column that holds the field's value, if there is one."""
        return None


@dataclass(frozen=True)
class Slotted(Event):
    """An event whose fields are looked up once each: the columns ``made`` must be selected before what is
    built from the event, under their names."""

    made: dict[str, Column] = field(default_factory=dict)
    slots: dict[tuple[str, bool], str] = field(default_factory=dict)

    def replaced(self, **known: Column) -> Event:
        return Slotted(self.fields, self.varbinds, {**self.known, **known}, self.made, self.slots)

    def _slot(self, name: str, plain: bool) -> str | None:
        if any(k in self.known for k in field_keys(name)):
            return None
        slot = self.slots.setdefault((name, plain), f"_slot{len(self.slots)}")
        if slot not in self.made:
            value = Event.resolve(self, name)
            self.made[slot] = normalize(value) if plain else value
        return slot

    def slot(self, name: str) -> str | None:
        return self._slot(name, False)

    def resolve(self, name: str) -> Column:
        slot = self._slot(name, False)
        return Event.resolve(self, name) if slot is None else F.col(slot)

    def compared(self, name: str) -> Column:
        slot = self._slot(name, True) if is_oid_field(name) else None
        return Event.compared(self, name) if slot is None else F.col(slot)


@dataclass(frozen=True)
class Verdict:
    """A condition that may be NULL (``fails``) or never is."""

    value: Column
    fails: bool = False


def _failed() -> Verdict:
    return Verdict(F.lit(None).cast("boolean"), True)


#: Decimal and hexadecimal floating-point notation without outer blanks and suffixes; infinities and NaN.
FLOAT = r"^(?i)[+-]?(?:(?:[0-9](?:_?[0-9])*(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)(?:e[+-]?[0-9](?:_?[0-9])*)?|0x_?(?:[0-9a-f](?:_?[0-9a-f])*(?:\.(?:[0-9a-f](?:_?[0-9a-f])*)?)?|\.[0-9a-f](?:_?[0-9a-f])*)p[+-]?[0-9]+|inf(?:inity)?)\z"
_FINITE = r"(?i)[+-]?(?:[0-9.]|0x)"


def number(value: Column) -> Column:
    """``value`` as a double if it is one as written; null for other text, overflow and NaN."""
    parsed = F.replace(value, F.lit("_"), F.lit("")).try_cast("double")
    overflow = (F.abs(parsed) == float("inf")) & value.rlike("^" + _FINITE)
    return F.when(value.rlike(FLOAT) & ~overflow, parsed)


def constant_number(text: str) -> float | None:
    if not re.fullmatch(FLOAT.removeprefix("^(?i)").removesuffix(r"\z"), text, re.I):
        return None
    bare = text.replace("_", "")
    value = float.fromhex(bare) if "x" in bare.lower() else float(bare)
    return None if value in (float("inf"), float("-inf")) and re.match(_FINITE, text) else value


def java_pattern(pattern: str) -> str | None:
    """A linear-time pattern (RE2 syntax) in the dialect of the JVM; null if it is no such pattern.

    ``$`` without ``m`` is the end of the text, ``.`` leaves out only the line feed, case is folded for
    all letters, white space is ASCII; look-around, back-references and possessive repeats are refused.
    """
    out, i, n, in_class, multiline = ["(?d)"], 0, len(pattern), 0, [False]
    while i < n:
        c = pattern[i]
        if c == "\\":
            if i + 1 == n:
                return None
            d = pattern[i + 1]
            if d == "Q":
                end = pattern.find("\\E", i)
                end = n if end < 0 else end
                out.append(re.sub(r"([^\w\s])", r"\\\1", pattern[i + 2 : end]))
                i = min(n, end + 2)
                continue
            if d in "123456789kGZXRhHV" or (d.isalpha() and d not in "pPdDsSwWbBAzafnrtvxQE"):
                return None
            if d in "sS":
                space = r"\t\n\f\r "
                out.append((space if d == "s" else r"\S") if in_class else f"[{space}]" if d == "s" else f"[^{space}]")
            elif d == "v":
                out.append(r"\x0B")
            elif d in "pP" and (m := re.match(r"\\[pP](?:\{\^?(\w+)\}|(\w))", pattern[i:])):
                name = m[1] or m[2]
                negative = (d == "P") != ("^" in m[0])
                out.append(f"\\{'P' if negative else 'p'}{{{name if len(name) <= 2 else 'Is' + name}}}")
                i += len(m[0])
                continue
            elif d == "x" and pattern[i + 2 : i + 3] == "{":
                end = pattern.find("}", i)
                out.append(pattern[i : end + 1])
                i = end + 1
                continue
            else:
                out.append(c + d)
            i += 2
            continue
        if in_class:
            if c == "[" and (m := re.match(r"\[:(\^?)(\w+):\]", pattern[i:])):
                names = {"word": r"\w", "digit": r"\d"}
                name = names.get(m[2]) or {"xdigit": r"\p{XDigit}"}.get(m[2]) or f"\\p{{{m[2].capitalize()}}}"
                out.append(f"[^{name}]" if m[1] else name)
                i += len(m[0])
                continue
            if c == "]" and i > in_class:
                in_class = 0
            out.append("\\" + c if c in "[&" or c == "]" and in_class else c)
            i += 1
            continue
        if c == "[":
            in_class = i + 1 + (pattern[i + 1 : i + 2] == "^")
            out.append(pattern[i:in_class])
            i = in_class
            continue
        if c == "(":
            if pattern.startswith("(?", i):
                m = re.match(r"\(\?(?:P?<(\w+)>|([imsU]*)(?:-([imsU]+))?([:)]))", pattern[i:])
                if not m:
                    return None
                if m[1] is not None:
                    out.append(f"(?<{m[1].replace('_', '')}g>")
                    multiline.append(multiline[-1])
                else:
                    on, off = m[2].replace("U", ""), (m[3] or "").replace("U", "")
                    here = "m" in on or (multiline[-1] and "m" not in off)
                    flags = on.replace("i", "iu") + (f"-{off.replace('i', 'iu')}" if off else "")
                    out.append(f"(?{flags}{m[4]}" if flags or m[4] == ":" else "")
                    if m[4] == ")":
                        multiline[-1] = here
                    else:
                        multiline.append(here)
                i += len(m[0])
                continue
            multiline.append(multiline[-1])
        elif c == ")":
            if len(multiline) == 1:
                return None
            multiline.pop()
        elif c == "$" and not multiline[-1]:
            out.append(r"\z")
            i += 1
            continue
        elif c in "*+?":
            if i == 0 or pattern[i - 1 : i] in "(|" and pattern[max(0, i - 2) : i - 1] != "\\":
                return None
            if pattern[i - 1] in "*+?}" and pattern[max(0, i - 2) : i - 1] != "\\" and (c != "?" or pattern[i - 2 : i] in ("*?", "+?", "??")):
                return None
        elif c == "{" and (m := re.match(r"\{(\d+)(,(\d*))?\}", pattern[i:])):
            if i == 0 or int(m[1]) > 1000 or m[3] and (int(m[3]) > 1000 or int(m[3]) < int(m[1])):
                return None
            out.append(m[0])
            i += len(m[0])
            continue
        elif c == "{":
            out.append("\\")
        out.append(c)
        i += 1
    if in_class or len(multiline) != 1:
        return None
    return "".join(out)


def matches_pattern(value: Column, pattern: str) -> Verdict:
    java = java_pattern(pattern)
    if java is None or not compiles(java):
        return _failed()
    return Verdict(value.rlike(java))


def compiles(java: str) -> bool:
    """Whether the JVM takes the pattern (without a session, taken for granted)."""
    from pyspark.sql import SparkSession

    session = SparkSession.getActiveSession()
    if session is None:
        return True
    try:
        session._jvm.java.util.regex.Pattern.compile(java)
    except Exception:  # noqa: BLE001 - a Py4JJavaError of the pattern
        return False
    return True


def condition(event: Event, name: str, op: str, value: Any) -> Verdict:
    """One condition: field, operator, value."""
    oid = is_oid_field(name)
    actual, op = event.compared(name), op.lower()
    text = plain_oid(text_of(value)) if oid else text_of(value)
    want = F.lit(text)
    if op == "exists":
        return Verdict(actual != "")
    if op in ("eq", "ne"):
        return Verdict(actual == want if op == "eq" else actual != want)
    if op in ("contains", "prefix", "suffix"):
        return Verdict({"contains": actual.contains, "prefix": actual.startswith, "suffix": actual.endswith}[op](want))
    if op == "regex":
        return matches_pattern(actual, text)
    if op == "in":
        listed = [plain_oid(text_of(v)) if oid else text_of(v) for v in value] if isinstance(value, list) else []
        return Verdict(actual.isin(*listed) if listed else F.lit(False))
    if op in ("gt", "ge", "lt", "le"):
        bound = constant_number(text)
        if bound is None:
            return Verdict(F.lit(False))
        got = number(actual)
        return Verdict(F.coalesce({"gt": got > bound, "ge": got >= bound, "lt": got < bound, "le": got <= bound}[op], F.lit(False)))
    return _failed()


def _conditions(event: Event, items: Any) -> list[Verdict] | None:
    """Conditions of a list; null if it is no list of mappings."""
    if items is None:
        return []
    if not isinstance(items, list) or not all(isinstance(x, dict) for x in items):
        return None
    out = []
    for x in items:
        name, op = x.get("field"), x.get("op")
        out.append(condition(event, name if isinstance(name, str) else "", op if isinstance(op, str) and op else "eq", x.get("value")))
    return out


def _until_error(verdicts: Sequence[Verdict], decides: bool) -> Verdict:
    """AND (``decides`` False) or OR (True) in order: what stands before the first error may decide."""
    sound: list[Column] = []
    for v in verdicts:
        if v.fails:
            stop = F.lit(False)
            for c in sound:
                stop = stop | (c if decides else ~c)
            return Verdict(F.when(stop, F.lit(decides)), True)
        sound.append(v.value)
    total = F.lit(not decides)
    for c in sound:
        total = (total | c) if decides else (total & c)
    return Verdict(total)


def compile_match(event: Event, spec: Mapping[str, Any]) -> Verdict:
    """A whole match: nothing matches all; ``all``, ``any`` and ``not`` lists, else equal fields.

    Where one of the lists is given, fields beside it are not looked at; an empty ``any`` asks nothing.
    """
    if not spec:
        return Verdict(F.lit(True))
    if "all" in spec or spec.get("any") is not None or spec.get("not") is not None:
        every, some, none = (_conditions(event, spec.get(k)) for k in ("all", "any", "not"))
        if every is None or some is None or none is None:
            return _failed()
        steps = [*every]
        if some:
            steps.append(_until_error(some, True))
        steps += [Verdict(~v.value, v.fails) for v in none]
        return _in_order(steps)
    return Verdict(_until_error([condition(event, k, "eq", v) for k, v in spec.items()], False).value)


def _in_order(steps: Sequence[Verdict]) -> Verdict:
    """AND in order of conditions that may be NULL on some rows."""
    if not any(s.fails for s in steps):
        return _until_error(steps, False)
    out = F.lit(True)
    for s in reversed(steps):
        out = F.when(s.value.isNull(), None).when(~s.value, False).otherwise(out) if s.fails else F.when(~s.value, False).otherwise(out)
    return Verdict(out, True)


def first_match(verdicts: Sequence[Verdict]) -> Column:
    """Number of the first match; -1 if none matches, -2 if an error comes before."""
    if not verdicts:
        return F.lit(-1)
    chain = None
    for k, v in enumerate(verdicts):
        for test, result in (*(((v.value.isNull(), -2),) if v.fails else ()), (v.value, k)):
            chain = F.when(test, result) if chain is None else chain.when(test, result)
    return chain.otherwise(-1)


def static_value(spec: Mapping[str, Any], name: str) -> str | None:
    """The constant that a match asks of a field: beside the lists, or equal in ``all`` (if all agree)."""
    if name in spec:
        return text_of(spec[name])
    items = spec.get("all")
    if not isinstance(items, list):
        return None
    asked = {text_of(x.get("value")) for x in items if isinstance(x, dict) and x.get("field") == name and (x.get("op") or "eq") == "eq"}
    return asked.pop() if len(asked) == 1 else None
