"""Plan text narrowed to a width, for print."""

from __future__ import annotations

import re

#: A node line whose tail is one or two groups of numbers.
_NODE_LINE = re.compile(r"^(.*?\S)((?:\s+\((?:cost|actual|never)[^()]*\))+)\s*$")
_RULE = "═"


def reflow(text: str, width: int) -> str:
    """Lines over the width are broken: number groups go to lines of their own, others
    break behind commas. A header is centred over the result and its rule redrawn."""
    out: list[str] = []
    for line in text.split("\n"):
        if len(line) <= width:
            out.append(line)
            continue
        indent = re.match(r"[ \t]*", line)[0] + "    "
        if m := _NODE_LINE.match(line):
            out.append(m[1])
            out += [indent + g for g in re.findall(r"\([^()]*\)", m[2])]
        else:
            out += _by_commas(line, indent, width)
    return "\n".join(_centred(out))


def _by_commas(line: str, indent: str, width: int) -> list[str]:
    head, *rest = line.split(", ")
    out = [head]
    for part in rest:
        if len(out[-1]) + 2 + len(part) > width and out[-1]:
            out[-1] += ","
            out.append(indent + part)
        else:
            out[-1] += ", " + part
    return out


def _centred(lines: list[str]) -> list[str]:
    for i, (title, rule) in enumerate(zip(lines, lines[1:], strict=False)):
        if title.strip() == "QUERY PLAN" and rule and not rule.strip(_RULE):
            room = max(map(len, [title.strip(), *lines[i + 2 :]]))
            left = (room - len(title.strip())) // 2
            return [*lines[:i], (" " * left + title.strip()).ljust(room), _RULE * room, *lines[i + 2 :]]
    return lines
