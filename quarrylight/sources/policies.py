"""Architecture policies: JSON with layers, rules between them, forbidden patterns and a word on cycles."""

from __future__ import annotations

import json


def parsed(text: str, path: str = "architecture.json") -> dict:
    """The policy as a dictionary with path, layers, rules, forbidden and disallow_cycles; ValueError says what is wrong with it.

    A policy is a small file of one repository and is read on the driver.
    """
    try:
        data = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"the policy is no JSON: {e.msg} (line {e.lineno})") from e
    if not isinstance(data, dict):
        raise ValueError("the policy must be an object")
    if not isinstance(data.get("layers"), list):
        raise ValueError("the policy needs a list of layers")
    layers = []
    for i, layer in enumerate(data["layers"]):
        if not isinstance(layer, dict) or not layer.get("name"):
            raise ValueError(f"layer {i} has no name")
        patterns = layer.get("patterns", [])
        if not isinstance(patterns, list) or not all(isinstance(p, str) for p in patterns):
            raise ValueError(f"the patterns of layer {layer['name']} must be texts")
        layers.append({"name": str(layer["name"]).strip(), "patterns": patterns})
    names = {x["name"] for x in layers}
    if not isinstance(data.get("rules", []), list):
        raise ValueError("rules must be a list")
    rules = []
    for i, rule in enumerate(data.get("rules", [])):
        if not isinstance(rule, dict) or not rule.get("id"):
            raise ValueError(f"rule {i} has no id")
        of, to, allowed = str(rule.get("from_layer", "")).strip(), rule.get("forbidden_to_layer"), rule.get("allowed_to_layers")
        if of and of not in names:
            raise ValueError(f"rule {rule['id']} starts from the unknown layer {of}")
        if to and to not in names:
            raise ValueError(f"rule {rule['id']} forbids the unknown layer {to}")
        if allowed is not None and not isinstance(allowed, list):
            raise ValueError(f"rule {rule['id']}: allowed_to_layers must be a list")
        rules.append({"id": str(rule["id"]).strip(), "from_layer": of, "forbidden_to_layer": to, "allowed_to_layers": allowed, "severity": str(rule.get("severity", "HIGH")).upper()})
    forbidden = []
    listed = data.get("forbidden_dependencies", [])
    for i, pair in enumerate(listed if isinstance(listed, list) else []):
        if isinstance(pair, dict) and pair.get("from_pattern") and pair.get("to_pattern"):
            forbidden.append({"id": str(pair.get("rule_id", f"FORBIDDEN-{i + 1}")), "from_pattern": pair["from_pattern"], "to_pattern": pair["to_pattern"], "severity": str(pair.get("severity", "CRITICAL")).upper()})
    return {"path": path, "layers": layers, "rules": rules, "forbidden": forbidden, "disallow_cycles": bool(data.get("disallow_cycles") or data.get("enforce_no_cycles", False))}
