"""Rule sets: YAML into dataclasses, with defaults and validation.

The YAML scalars of rules become strings the way the wire comparison needs them: ``text_of`` says how.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

import yaml


class ConfigError(ValueError):
    """A rule set that cannot be used."""


class _Loader(yaml.SafeLoader):
    """YAML 1.2 core scalars: only true and false are booleans, 1e3 is a float, 12:30 is text."""


_Loader.yaml_implicit_resolvers = {}
for _tag, _pattern, _first in (
    ("bool", r"true|True|TRUE|false|False|FALSE", "tTfF"),
    ("int", r"[-+]?(?:0b[01_]+|0o?[0-7_]+|0x[0-9a-fA-F_]+|[0-9][0-9_]*)", "-+0123456789"),
    ("float", r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)", "-+.0123456789"),
    ("null", r"~|null|Null|NULL|", ["~", "n", "N", ""]),
    ("merge", r"<<", "<"),
):
    _Loader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(f"(?:{_pattern})\\Z"), list(_first))


def _integer(loader: yaml.SafeLoader, node: yaml.ScalarNode) -> int:
    text = loader.construct_scalar(node).replace("_", "")
    sign, digits = (-1, text[1:]) if text[:1] == "-" else (1, text.lstrip("+"))
    if re.fullmatch(r"0[0-7]+", digits):
        return sign * int(digits, 8)
    return sign * int(digits, 0 if digits[:1] == "0" else 10)


def _floating(loader: yaml.SafeLoader, node: yaml.ScalarNode) -> float:
    text = loader.construct_scalar(node).lower()
    return float(text.replace(".inf", "inf").replace(".nan", "nan"))


_Loader.add_constructor("tag:yaml.org,2002:int", _integer)
_Loader.add_constructor("tag:yaml.org,2002:float", _floating)


def text_of(value: Any) -> str:
    """The text that a YAML value stands for in a comparison.

    Missing is ``<nil>``; floats have the shortest digits, with an exponent of two digits at least
    below 1e-4 and from 1e6 on; lists and maps are in brackets, parted by blanks.
    """
    if value is None:
        return "<nil>"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        if math.isnan(value) or math.isinf(value):
            return "NaN" if math.isnan(value) else "+Inf" if value > 0 else "-Inf"
        if value == 0:
            return "-0" if math.copysign(1, value) < 0 else "0"
        sign, digits, power = Decimal(repr(value)).normalize().as_tuple()
        point = len(digits) + int(power)  # digits before the decimal point
        text = "".join(map(str, digits))
        if -4 <= point - 1 < 6:
            text = (text[:point] + "0" * (point - len(digits)) if point > 0 else "0") + ("." + "0" * -min(point, 0) + text[max(point, 0) :] if len(digits) > max(point, 0) else "")
        else:
            text = text[0] + ("." + text[1:] if text[1:] else "") + f"e{point - 1:+03d}"
        return "-" * sign + text
    if isinstance(value, list):
        return "[" + " ".join(map(text_of, value)) + "]"
    if isinstance(value, dict):
        return "map[" + " ".join(f"{text_of(k)}:{text_of(v)}" for k, v in sorted(value.items(), key=lambda kv: text_of(kv[0]))) + "]"
    return str(value)


# Factors of the size units.
_UNITS = {"": 1, "B": 1, "KB": 1000, "MB": 1000**2, "GB": 1000**3, "TB": 1000**4, "KIB": 1024, "MIB": 1024**2, "GIB": 1024**3, "TIB": 1024**4}
LARGEST = 2**63 - 1


def byte_size(text: str) -> int:
    """Bytes of ``64MiB``, ``128 MB``, ``4096``; 0 for blank; the largest size for off, none, unlimited."""
    text = text.strip()
    if not text:
        return 0
    if text.upper() in ("OFF", "NONE", "UNLIMITED"):
        return LARGEST
    m = re.fullmatch(r"([0-9]+)\s*([A-Za-z]*)", text)
    if not m or m[2].upper() not in _UNITS:
        raise ConfigError(f"not a size: {text!r}")
    size = int(m[1]) * _UNITS[m[2].upper()]
    if not 0 < size <= LARGEST:
        raise ConfigError(f"size out of range: {text!r}")
    return size


@dataclass(frozen=True)
class ClearRule:
    match: dict[str, Any]
    key_fields: tuple[str, ...] = ()
    varbind_oid: str = ""
    regex: str = ""


@dataclass(frozen=True)
class AlarmRule:
    id: str
    match: dict[str, Any]
    key_fields: tuple[str, ...]
    ttl_seconds: int = 300
    hold_until_clear: bool = False
    clear: ClearRule | None = None


@dataclass(frozen=True)
class FilterRule:
    id: str
    action: str
    match: dict[str, Any]


@dataclass(frozen=True)
class Target:
    """Where forwarded packets go. A target is off unless it says ``enabled: true``."""

    name: str
    host: str
    port: int
    enabled: bool = False
    source_host: str = ""


@dataclass(frozen=True)
class User:
    """A user of the version 3 security model."""

    name: str
    auth_protocol: str = ""
    auth_passphrase: str = ""
    priv_protocol: str = ""
    priv_passphrase: str = ""


# Protocols of the version 3 security model.
AUTH_PROTOCOLS = ("", "noauth", "md5", "sha", "sha224", "sha256", "sha384", "sha512")
PRIV_PROTOCOLS = ("", "nopriv", "des", "aes", "aes192", "aes256", "aes192c", "aes256c")

# Defaults; a 0 or blank in the file means the default.
SERVER = {"host": "0.0.0.0", "port": 162, "max_datagram_size": 8192, "cleanup_interval_seconds": 30, "max_dedup_entries": 10000, "queue_size": 1024, "worker_count": 1, "stats_log_interval_seconds": 60}
METRICS = {"enabled": False, "host": "127.0.0.1", "port": 9163, "path": "/metrics"}
LOGGING = {"level": "INFO", "format": "text", "file": "", "alerts_file": ""}
TTL_SECONDS = 300


@dataclass(frozen=True)
class Rules:
    filters: tuple[FilterRule, ...] = ()
    default_action: str = "keep"
    alarms: tuple[AlarmRule, ...] = ()
    aliases: dict[str, str] = field(default_factory=dict)
    targets: tuple[Target, ...] = ()
    users: tuple[User, ...] = ()
    server: dict[str, Any] = field(default_factory=lambda: dict(SERVER))
    metrics: dict[str, Any] = field(default_factory=lambda: dict(METRICS))
    logging: dict[str, Any] = field(default_factory=lambda: dict(LOGGING))
    memory_limit: int = 0

    def warnings(self) -> list[str]:
        """Rules that can never work as they stand."""
        out = []
        for a in self.alarms:
            if a.clear and a.clear.key_fields and a.clear.key_fields != a.key_fields:
                out.append(f"alarm {a.id}: its clear has other key fields, so no clear key equals an alarm key")
        return out


def _section(raw: dict[str, Any], name: str) -> dict[str, Any]:
    value = raw.get(name)
    if value is None:
        return {}
    if not isinstance(value, dict):
        raise ConfigError(f"{name} must be a mapping")
    return value


def _entries(section: dict[str, Any], name: str) -> list[dict[str, Any]]:
    value = section.get(name) or []
    if not isinstance(value, list) or not all(isinstance(x, dict) for x in value):
        raise ConfigError(f"{name} must be a list of mappings")
    return value


def _defaults(raw: dict[str, Any], defaults: dict[str, Any]) -> dict[str, Any]:
    return {k: raw.get(k) or d for k, d in defaults.items()}


def _need(condition: bool, message: str) -> None:
    if not condition:
        raise ConfigError(message)


def _ids(rules: list[dict[str, Any]], what: str) -> list[str]:
    ids = [text_of(r["id"]) if r.get("id") is not None else "" for r in rules]
    _need(all(ids), f"every {what} rule needs an id")
    for i in ids:
        _need(ids.count(i) == 1, f"duplicate {what} rule id {i!r}")
    return ids


def _texts(values: Any) -> tuple[str, ...]:
    return tuple(text_of(v) for v in values or ())


def _alarm(rule: dict[str, Any], rule_id: str, ttl: int, keys: tuple[str, ...]) -> AlarmRule:
    dedup = _section(rule, "dedup")
    own = _texts(dedup.get("key_fields")) or keys
    _need(bool(own), f"alarm {rule_id!r} needs key fields")
    clear = None
    if dedup.get("clear") is not None:
        c = _section(dedup, "clear")
        _need(bool(c.get("match")), f"alarm {rule_id!r}: its clear needs a match")
        clear = ClearRule(c["match"], _texts(c.get("key_fields")), text_of(c.get("varbind_oid") or ""), text_of(c.get("regex") or ""))
    hold = bool(dedup.get("hold_until_clear"))
    _need(not hold or clear is not None, f"alarm {rule_id!r} is held until cleared but has no clear")
    return AlarmRule(rule_id, rule.get("match") or {}, own, int(dedup.get("ttl_seconds") or ttl), hold, clear)


def parse_rules(text: str) -> Rules:
    """Rules of a YAML text; raises ConfigError if they cannot be used, also for values of a wrong type."""
    try:
        return _parse(text)
    except ConfigError:
        raise
    except (TypeError, ValueError, AttributeError, OverflowError) as e:
        raise ConfigError(f"a value of a wrong type: {e}") from e


def _parse(text: str) -> Rules:
    try:
        raw = yaml.load(text, Loader=_Loader) or {}  # noqa: S506 - a safe loader
    except yaml.YAMLError as e:
        raise ConfigError(str(e)) from e
    _need(isinstance(raw, dict), "the file must be a mapping")
    server, metrics, logging = _defaults(_section(raw, "server"), SERVER), _defaults(_section(raw, "metrics"), METRICS), _defaults(_section(raw, "logging"), LOGGING)
    _need(0 <= server["port"] <= 65535, "server.port is out of range")
    for k in ("max_datagram_size", "cleanup_interval_seconds", "max_dedup_entries", "queue_size", "worker_count"):
        _need(server[k] > 0, f"server.{k} must be positive")
    _need(server["stats_log_interval_seconds"] >= 0, "server.stats_log_interval_seconds must not be negative")
    if metrics["enabled"]:
        _need(0 <= metrics["port"] <= 65535, "metrics.port is out of range")
        _need(str(metrics["path"]).startswith("/"), "metrics.path must begin with /")
    filters = _section(raw, "filters")
    action = str(filters.get("default_action") or "keep").lower()
    _need(action in ("keep", "drop"), "filters.default_action must be keep or drop")
    rules = _entries(filters, "rules")
    made = []
    for r, i in zip(rules, _ids(rules, "filter"), strict=True):
        a = str(r.get("action") or "drop").lower()
        _need(a in ("keep", "drop"), f"filter {i!r} has an unknown action {a!r}")
        made.append(FilterRule(i, a, r.get("match") or {}))
    shared = _section(raw, "dedup_defaults")
    ttl, keys = int(shared.get("ttl_seconds") or TTL_SECONDS), _texts(shared.get("key_fields"))
    alarms = _entries(raw, "alarms")
    users = []
    for u in _entries(_section(raw, "receiver"), "v3_users"):
        user = User(
            str(u.get("user_name") or "").strip(), str(u.get("authentication_protocol") or "").strip().lower(), str(u.get("authentication_passphrase") or ""),
            str(u.get("privacy_protocol") or "").strip().lower(), str(u.get("privacy_passphrase") or ""),
        )
        _need(bool(user.name), "a user needs a name")
        _need(user.auth_protocol in AUTH_PROTOCOLS, f"unknown authentication protocol {user.auth_protocol!r}")
        _need(user.priv_protocol in PRIV_PROTOCOLS, f"unknown privacy protocol {user.priv_protocol!r}")
        users.append(user)
    return Rules(
        tuple(made), action, tuple(_alarm(r, i, ttl, keys) for r, i in zip(alarms, _ids(alarms, "alarm"), strict=True)),
        {text_of(k): text_of(v) for k, v in _section(raw, "field_aliases").items()},
        tuple(Target(str(t.get("name") or ""), str(t.get("host") or ""), int(t.get("port") or 0), bool(t.get("enabled")), str(t.get("source_host") or "")) for t in _entries(raw, "forwarders")),
        tuple(users), server, metrics, logging, byte_size(text_of(_section(raw, "runtime").get("memory_limit") or "")),
    )


def load_rules(path: str) -> Rules:
    with open(path, encoding="utf-8") as f:
        return parse_rules(f.read())
