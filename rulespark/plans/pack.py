"""Rule packs: validation, selectors, overlays, differences, publishing.  Plain configuration, handled before planning."""

from __future__ import annotations

import copy
import hashlib
import json
import re
from pathlib import Path
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulespark.operators.checks import CHECKS, PACKAGE_CHECKS

Pack = dict[str, Any]

RECORD_TYPES = {"matrix", "position_duty", "system_rule", "incompatible_position", "package"}
#: Operators that packs may name but that compute nothing; a rule that uses one can't be enabled.
UNAVAILABLE = {("system_rule_content", 1)}

SEVERITIES = ("violation", "review")
#: "review" and "report" both show what could not be read.
ON_UNAVAILABLE = {"report", "review", "skip", "fail"}


class PackError(ValueError):
    """A pack that can't be planned; the message lists every fault."""


def _faults(pack: Pack) -> list[str]:
    out: list[str] = []
    if not isinstance(pack.get("submission_scope"), dict):
        out.append("submission_scope is missing")
    seen: set[str] = set()
    for rule in pack.get("rules", []):
        name = rule.get("rule_id", "?")
        out += [f"{name}: {k} is missing" for k in ("rule_id", "display_code", "enabled", "scope", "checks") if k not in rule]
        if name in seen:
            out.append(f"{name}: given twice")
        seen.add(name)
        kind = rule.get("scope", {}).get("record_type")
        types = kind if isinstance(kind, list) else [kind]
        out += [f"{name}: unknown record type {t}" for t in types if t not in RECORD_TYPES]
        for check in rule.get("checks", []):
            at = f"{name}/{check.get('check_id', '?')}"
            key = (check.get("operator"), check.get("operator_version"))
            if key in UNAVAILABLE:
                out += [f"{at}: {key[0]}@{key[1]} is not available"] if rule.get("enabled") else []
            elif key not in CHECKS:
                out.append(f"{at}: no operator {key[0]}@{key[1]}")
            elif (key[0] in PACKAGE_CHECKS) != (types == ["package"]):
                out.append(f"{at}: {key[0]} and record type {kind} don't go together")
            out += [f"{at}: no message for {s}" for s in SEVERITIES if s not in check.get("message", {})]
            if check.get("on_unavailable", "report") not in ON_UNAVAILABLE:
                out.append(f"{at}: on_unavailable {check['on_unavailable']}")
            for k, v in check.get("params", {}).items():
                if k.endswith("patterns"):
                    for pattern in v:
                        try:
                            re.compile(pattern)
                        except re.error as e:
                            out.append(f"{at}: pattern {pattern!r}: {e}")
    for overlay in pack.get("overlays", []):
        rule_id, _, path = overlay.get("path", "").rpartition(".enabled") if overlay.get("path", "").endswith(".enabled") else (*overlay.get("path", "").split(":", 1), "")[:3]
        if rule_id not in seen:
            out.append(f"overlay {overlay.get('path')}: no such rule")
    return out


def validate(pack: Pack) -> Pack:
    """The pack itself, or PackError with all its faults."""
    if faults := _faults(pack):
        raise PackError("; ".join(faults))
    return pack


def load_pack(folder: str | Path) -> Pack:
    """``pack.json`` and the rules of ``rules/*.json`` in the order of their names."""
    folder = Path(folder)
    pack = json.loads((folder / "pack.json").read_text(encoding="utf-8"))
    pack["rules"] = [json.loads(p.read_text(encoding="utf-8")) for p in sorted((folder / "rules").glob("*.json"))]
    return validate(pack)


def content_hash(pack: Pack) -> str:
    """Of the canonical JSON: sorted keys, no blanks, other scripts as they are."""
    return hashlib.sha256(json.dumps(pack, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def publish(pack: Pack, store: str | Path, version: str) -> Path:
    """Write a validated pack as an immutable release and make it the active one."""
    target = Path(store) / "releases" / version
    if target.exists():
        raise PackError(f"release {version} exists")
    validate(pack)
    (target / "rules").mkdir(parents=True)
    for rule in pack["rules"]:
        (target / "rules" / f"{rule['display_code']}-{rule['rule_id']}.json").write_text(json.dumps(rule, ensure_ascii=False, indent=2), encoding="utf-8")
    rest = {k: v for k, v in pack.items() if k != "rules"}
    (target / "pack.json").write_text(json.dumps(rest, ensure_ascii=False, indent=2), encoding="utf-8")
    activate(store, version)
    return target


def activate(store: str | Path, version: str) -> None:
    """Point the store at a release: also the way back to an earlier one."""
    if not (Path(store) / "releases" / version).exists():
        raise PackError(f"no release {version}")
    (Path(store) / "active.json").write_text(json.dumps({"version": version}), encoding="utf-8")


def load_active(store: str | Path) -> Pack:
    version = json.loads((Path(store) / "active.json").read_text(encoding="utf-8"))["version"]
    return load_pack(Path(store) / "releases" / version)


def difference(one: Any, two: Any, path: str = "") -> list[dict[str, Any]]:
    """Where two configurations differ: (path, before, after)."""
    if isinstance(one, dict) and isinstance(two, dict):
        return [d for k in sorted({*one, *two}) for d in difference(one.get(k), two.get(k), f"{path}.{k}" if path else k)]
    if isinstance(one, list) and isinstance(two, list):
        size = max(len(one), len(two))
        return [d for i in range(size) for d in difference(one[i] if i < len(one) else None, two[i] if i < len(two) else None, f"{path}[{i}]")]
    return [] if one == two else [{"path": path, "before": one, "after": two}]


def select_rules(pack: Pack, disable: list[str] = (), enable: list[str] = ()) -> Pack:
    """A copy in which rules are switched by display code."""
    known = {r["display_code"] for r in pack["rules"]}
    if unknown := {*disable, *enable} - known:
        raise PackError(f"no rules {sorted(unknown)}")
    out = copy.deepcopy(pack)
    for r in out["rules"]:
        r["enabled"] = False if r["display_code"] in disable else True if r["display_code"] in enable else r["enabled"]
    return out


def selector(column: str, chosen: Any) -> Column:
    """A selector as a condition: '*', a list, or {include, exclude}."""
    if chosen in (None, "*", ["*"]):
        return F.lit(True)
    if isinstance(chosen, dict):
        return selector(column, chosen.get("include", "*")) & ~F.col(column).isin(list(chosen.get("exclude", [])))
    return F.col(column).isin(list(chosen))


def scope_condition(scope: dict[str, Any]) -> Column:
    types = scope.get("record_type")
    kind = F.lit(True) if types in (None, "package") else F.col("record_type").isin(types if isinstance(types, list) else [types])
    return kind & selector("entity_code", scope.get("entity_codes")) & selector("business_code", scope.get("business_codes")) & selector("variant_id", scope.get("variants"))


def _patched(rule: dict[str, Any], path: str, value: Any) -> dict[str, Any]:
    """``path``: 'RULE.enabled', or 'RULE:check_id.params.name'."""
    out = copy.deepcopy(rule)
    rest = path[len(rule["rule_id"]) :]
    if rest == ".enabled":
        out["enabled"] = value
        return out
    check_id, _, inner = rest.lstrip(":").partition(".")
    at = next(c for c in out["checks"] if c["check_id"] == check_id)
    *steps, last = inner.split(".")
    for s in steps:
        at = at[s]
    at[last] = value
    return out


def variants(pack: Pack, rule: dict[str, Any]) -> list[tuple[dict[str, Any], Column]]:
    """The rule as it reads in each scope: (rule, condition); the conditions exclude each other.

    Overlays apply in the order of their priority, later ones over earlier ones.
    """
    own = [o for o in pack.get("overlays", []) if o["path"].startswith((rule["rule_id"] + ".", rule["rule_id"] + ":"))]
    out: list[tuple[dict[str, Any], Column]] = [(rule, F.lit(True))]
    for o in sorted(own, key=lambda o: o.get("priority", 0)):
        inside = F.coalesce(scope_condition({**o.get("scope", {}), "record_type": None}), F.lit(False))
        out = [v for r, c in out for v in ((_patched(r, o["path"], o["value"]), c & inside), (r, c & ~inside))]
    return out
