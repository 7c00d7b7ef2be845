"""What a plan decides, without its costs: join order, methods, scans, parallelism."""

from __future__ import annotations

import re

from . import vocab
from .tree import Advice, Node, Plan, parse_advice_line, split_args

_SEEN_THROUGH = ("hash", "sort", "incremental-sort", "materialize", "memoize")
_SCANS = {
    "seq-scan": "SEQ_SCAN",
    "index-scan": "INDEX_SCAN",
    "index-only-scan": "INDEX_ONLY_SCAN",
    "bitmap-heap-scan": "BITMAP_HEAP_SCAN",
    "tid-scan": "TID_SCAN",
}
_WITH_INDEX = ("INDEX_SCAN", "INDEX_ONLY_SCAN")


def derive(plan: Plan) -> list[Advice]:
    """The plan's decisions, in a fixed order of kinds; none for an empty plan."""
    if plan.root is None:
        return []
    names = _names(plan.root)
    below = lambda n: [names[id(x)] for x in n.walk() if id(x) in names]
    everything = below(plan.root)
    out = []
    joins = [n for n in plan.root.walk() if n.type in vocab.JOINS]
    if everything:
        out.append(Advice("JOIN_ORDER", _order(joins[0], below, names) if joins else everything))
    out += _grouped(_methods(plan.root, below))
    out += _grouped(_scans(plan.root, names))
    gathers = _topmost(plan.root)
    if gathers:
        kind = "GATHER_MERGE" if any(g.type == "gather-merge" for g in gathers) else "GATHER"
        out.append(Advice(kind, [_together(below(g)) for g in gathers if below(g)]))
    elif everything:
        out.append(Advice("NO_GATHER", everything))
    return [a for a in out if a.args]


def _names(root: Node) -> dict[int, str]:
    """Names of base relations: alias or relation, the k-th of a name with #k."""
    seen: dict[str, int] = {}
    out = {}
    for n in root.walk():
        if n.relation and n.type != "bitmap-index-scan":
            name = n.alias or n.relation
            seen[name] = seen.get(name, 0) + 1
            out[id(n)] = name if seen[name] == 1 else f"{name}#{seen[name]}"
    return out


def _together(names: list[str]) -> str:
    return names[0] if len(names) == 1 else f"({' '.join(names)})"


def _inner(node: Node) -> Node:
    """A join's input as it is below nodes that only pass rows on."""
    while node.type in _SEEN_THROUGH and len(node.children) == 1:
        node = node.children[0]
    return node


def _sides(join: Node) -> list[Node]:
    return [c for c in join.children if not c.subplan][:2]


def _order(join: Node, below, names) -> list[str]:
    """Outer side flat, a join on the inner side in parentheses."""
    out: list[str] = []
    for k, side in enumerate(_sides(join)):
        side = _inner(side)
        if side.type in vocab.JOINS:
            inner = _order(side, below, names)
            out += inner if k == 0 else [f"({' '.join(inner)})"]
        else:
            out += below(side)
    return out


def _method(join: Node) -> str:
    inner = _sides(join)[1] if len(_sides(join)) > 1 else join
    if join.type == "hash-join":
        return "HASH_JOIN"
    if join.type == "merge-join":
        while inner.type in ("sort", "incremental-sort") and inner.children:
            inner = inner.children[0]
        return "MERGE_JOIN_MATERIALIZE" if inner.type == "materialize" else "MERGE_JOIN_PLAIN"
    return {"materialize": "NESTED_LOOP_MATERIALIZE", "memoize": "NESTED_LOOP_MEMOIZE"}.get(inner.type, "NESTED_LOOP_PLAIN")


def _methods(node: Node, below) -> list[tuple[str, list[str]]]:
    out = [x for c in node.children for x in _methods(c, below)]
    if node.type in vocab.JOINS and len(_sides(node)) == 2 and (inner := below(_sides(node)[1])):
        out.append((_method(node), [_together(inner)]))
    return out


def _scans(root: Node, names: dict[int, str]) -> list[tuple[str, list[str]]]:
    out = []
    for n in root.walk():
        kind = _SCANS.get(n.type)
        if kind and id(n) in names:
            out.append((kind, [names[id(n)], n.index] if kind in _WITH_INDEX and n.index else [names[id(n)]]))
    return out


def _grouped(found: list[tuple[str, list[str]]]) -> list[Advice]:
    out: dict[str, list[str]] = {}
    for kind, args in found:
        out.setdefault(kind, []).extend(args)
    return [Advice(k, v) for k, v in out.items()]


def _topmost(node: Node) -> list[Node]:
    if node.type in ("gather", "gather-merge"):
        return [node]
    return [g for c in node.children for g in _topmost(c)]


# Canonical form -----------------------------------------------------------------------------


def strip_schema(name: str) -> str:
    """A name without its schema; dots inside quotes stay."""
    return re.sub(r'^(?:"(?:[^"]|"")*"|[^".])*\.(?=[^.])', "", name) if "." in re.sub(r'"(?:[^"]|"")*"', "", name) else name


def _canonical_arg(arg: str, ordered: bool) -> str:
    if arg.startswith("(") and arg.endswith(")"):
        inner = [_canonical_arg(x, ordered) for x in split_args(arg[1:-1])]
        return f"({' '.join(inner if ordered else sorted(inner))})"
    return strip_schema(arg)


def canonical(a: Advice) -> Advice:
    """Equal for lines that mean the same: sets are sorted, schemas dropped; a join
    order keeps its order, scans stay paired with their index."""
    ordered = a.kind == "JOIN_ORDER"
    args = [_canonical_arg(x, ordered) for x in a.args]
    if a.kind in _WITH_INDEX:
        if len(args) % 2 == 0:
            args = [x for pair in sorted(zip(args[::2], args[1::2], strict=True)) for x in pair]
    elif not ordered:
        args = sorted(args)
    return Advice(a.kind, args)


def canonical_text(text: str) -> list[Advice]:
    """The canonical lines of a text of advice lines; others are passed over."""
    return [canonical(x) for x in map(parse_advice_line, text.split("\n")) if x]
