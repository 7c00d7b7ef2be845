"""Two plans' decisions side by side, as text. tables.plan_diff compares tables of plans."""

from __future__ import annotations

from .advice import canonical, derive
from .tree import Plan


def changes(before: Plan, after: Plan, canonically: bool = False) -> list[tuple[str, str, str]]:
    """(kind, before, after) of the decisions that differ, in order of first appearance."""
    sides: list[dict[str, str]] = []
    for plan in (before, after):
        found = derive(plan)
        sides.append({a.kind: str(a) for a in (map(canonical, found) if canonically else found)})
    kinds = dict.fromkeys([*sides[0], *sides[1]])
    return [(k, sides[0].get(k, ""), sides[1].get(k, "")) for k in kinds if sides[0].get(k) != sides[1].get(k)]


def delta(label: str, before: float | None, after: float | None) -> str:
    if before is None or after is None:
        return ""
    line = f"{label:<15} {before:9.3f} ms -> {after:9.3f} ms"
    return line + (f"   ({(after - before) / before * 100:+.1f}%)" if before > 0 else "")


def unified(before: Plan, after: Plan, before_name: str = "", after_name: str = "", canonically: bool = False) -> str:
    out = [f"--- {before_name or 'before'}", f"+++ {after_name or 'after'}", f"@@ plan structure{' (canonical)' if canonically else ''} @@"]
    found = changes(before, after, canonically)
    for _, was, now in found:
        out += ["-" + was] * bool(was) + ["+" + now] * bool(now)
    if not found:
        out.append(" structure unchanged - the planner made the same decisions")
    times = [delta("execution time", before.execution_ms, after.execution_ms), delta("planning time", before.planning_ms, after.planning_ms)]
    if any(times):
        out += ["", *(" " + t for t in times if t)]
    return "\n".join(out) + "\n"
