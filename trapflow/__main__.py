"""``python -m trapflow check RULES.yaml``: whether a rule set can be used, and what in it never works."""

from __future__ import annotations

import sys

from trapflow.config import ConfigError, load_rules


def main(args: list[str]) -> int:
    if len(args) != 2 or args[0] != "check":
        print(__doc__)
        return 2
    try:
        rules = load_rules(args[1])
    except (ConfigError, OSError) as e:
        print(f"not usable: {e}")
        return 1
    for w in rules.warnings():
        print(f"warning: {w}")
    print(f"usable: {len(rules.filters)} filters, {len(rules.alarms)} alarms, {len(rules.aliases)} aliases, {sum(t.enabled for t in rules.targets)} targets on")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
