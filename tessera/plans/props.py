"""Property lines of plan nodes: label, value, kind and the fields that JSON output has."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from . import vocab

_PAIR = re.compile(r"([A-Za-z][A-Za-z ]*?)=(\S+)")
_ORIGINALLY = re.compile(r"^(\S+) \(originally (\S+)\)$")


@dataclass
class Prop:
    raw: str
    label: str = ""
    value: str = ""
    kind: str = "unknown"
    fields: dict[str, str] = field(default_factory=dict)

    @property
    def known(self) -> bool:
        return self.kind != "unknown" or self.label in vocab.COMPOSITES or self.label in vocab.SCOPED


def number(value: str) -> str:
    """The leading number of a value with a unit, else the value."""
    m = re.match(r"\s*(-?[\d.]+)\s*(?:kB|MB|ms|bytes|%)?\s*$", value)
    return m[1] if m else value.strip()


def _labelled(value: str, shape: dict) -> dict[str, str]:
    out: dict[str, str] = {}
    parts = [("", shape["first"], re.split(r"\s{2,}", value)[0])]
    for part in re.split(r"\s{2,}", value)[1:]:
        label, found, rest = part.partition(": ")
        if found and label in shape["labels"]:
            parts.append((label, shape["labels"][label], rest))
    for _, key, text in parts:
        if m := _ORIGINALLY.match(text.strip()):
            out[key], out[f"Original {key}"] = m[1], m[2]
        else:
            out[key] = number(text)
    return out


def _scoped(label: str, value: str) -> dict[str, str]:
    form, counters = vocab.SCOPED[label]
    out = {}
    for group in value.split(", "):
        scope, _, pairs = group.strip().partition(" ")
        if scope.capitalize() in vocab.SCOPES:
            for name, n in re.findall(r"(\w+)=(\S+)", pairs):
                if name in counters:
                    out[form.format(scope=scope.capitalize(), counter=name.capitalize())] = n.rstrip(",")
    return out


def _sort_groups(kind: str, value: str) -> dict[str, str]:
    """Full-sort Groups: 2  Sort Method: quicksort  Average Memory: 26kB  Peak Memory: 26kB"""
    out = {}
    for i, part in enumerate(re.split(r"\s{2,}", value.strip())):
        label, found, rest = part.partition(": ")
        if i == 0:
            out[f"{kind} Group Count"] = part
        elif found and label.startswith("Sort Method"):
            out[f"{kind} Sort Methods Used"] = rest
        elif found and label.split(" ")[0] in ("Average", "Peak"):
            out[f"{kind} {label.split(' ')[0]} Sort Space Used"] = number(rest)
            out[f"{kind} Sort Space Type"] = label.split(" ", 1)[1]
    return out


def parse_prop(line: str) -> Prop:
    raw = line.strip()
    label, found, value = raw.partition(": ")
    if not found:
        return Prop(raw, raw.removesuffix(":") if raw.endswith(":") else "", "", "unknown")
    prop = Prop(raw, label, value.strip(), vocab.KIND_OF.get(label, "unknown"))
    if label == "Sort Method":
        method, *rest = re.split(r"\s{2,}", value.strip(), maxsplit=1)
        prop.fields["Sort Method"] = method
        if rest and ": " in rest[0]:
            space, used = rest[0].split(": ", 1)
            prop.fields |= {"Sort Space Type": space, "Sort Space Used": number(used)}
    elif label in vocab.SCOPED:
        prop.fields = _scoped(label, value)
    elif shape := vocab.COMPOSITES.get(label):
        if "first" in shape:
            prop.fields = _labelled(value, shape)
        else:
            prop.fields = {shape["pairs"][k.strip()]: number(v) for k, v in _PAIR.findall(value) if k.strip() in shape["pairs"]}
    elif label.removesuffix(" Groups") in vocab.SORT_GROUPS:
        prop.fields = _sort_groups(label.removesuffix(" Groups"), value)
    else:
        prop.fields = {label: number(value) if label in vocab.UNIT_OF or prop.kind in ("integer", "float") else value.strip()}
    return prop
