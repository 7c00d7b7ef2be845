"""Command line over single files: python -m tessera COMMAND ...

format [-l] [-d] [-w] [FILE | FOLDER ...]   laid-out text; -l lists files that layout changes, -d shows
                                       diffs, -w writes changed files
advice [-canonical] [FILE]             decisions of a plan
diff [-canonical] FILE FILE            unified diff of two plans' decisions: exit 0 same, 1 different
canonical [FILE]                       canonical decisions of a plan or of advice text
json [FILE]                            a plan as JSON
narrow WIDTH [FILE]                    plan text reflowed to a width
-V                                     version

Standard input stands in for files. Exit 2 on errors. Over many files use tessera.sources
and tessera.plans.tables, which run on a cluster.
"""

from __future__ import annotations

import difflib
import sys
from pathlib import Path

from . import __version__
from .functions.layout import format_sql
from .functions.lexer import LexError
from .plans import advice, jsonplan, tree
from .plans.diff import changes, unified
from .plans.reflow import reflow


def _scripts(names: list[str]):
    for name in names:
        path = Path(name)
        if path.is_dir():
            for p in sorted(path.rglob("*.sql")):
                if not any(x.startswith(".") for x in p.relative_to(path).parts[:-1]):
                    yield p
        else:
            yield path


def _read(names: list[str]) -> str:
    return Path(names[0]).read_text() if names else sys.stdin.read()


def _plan(text: str) -> tree.Plan:
    return jsonplan.parse_json(text) if text.lstrip()[:1] in ("[", "{") else tree.parse(text)


def _format(args: list[str]) -> int:
    names = [a for a in args if a not in ("-l", "-d", "-w")]
    if not names:
        if "-w" in args:
            print("-w needs files", file=sys.stderr)
            return 2
        sys.stdout.write(format_sql(sys.stdin.read()))
        return 0
    status = 0
    for path in _scripts(names):
        try:
            text = path.read_text()
            out = format_sql(text)
        except (OSError, LexError) as e:
            print(f"{path}: {e}", file=sys.stderr)
            status = 2
            continue
        if "-l" in args and out != text:
            print(path)
        if "-d" in args:
            sys.stdout.writelines(difflib.unified_diff(text.splitlines(True), out.splitlines(True), str(path), f"{path} (laid out)", n=3))
        if "-w" in args and out != text:
            path.write_text(out)
        if not {"-l", "-d", "-w"} & set(args):
            sys.stdout.write(out)
    return status


def main(args: list[str]) -> int:
    command, rest = (args[0], args[1:]) if args else ("", [])
    canonically = "-canonical" in rest
    rest = [a for a in rest if a != "-canonical"]
    try:
        if command in ("-V", "version"):
            print(f"tessera {__version__}")
            return 0
        if command == "format":
            return _format(rest)
        if command == "advice":
            found = advice.derive(_plan(_read(rest)))
            print(*(map(advice.canonical, found) if canonically else found), sep="\n")
        elif command == "diff" and len(rest) == 2:
            before, after = (_plan(Path(x).read_text()) for x in rest)
            sys.stdout.write(unified(before, after, *rest, canonically))
            return int(bool(changes(before, after, canonically)))
        elif command == "canonical":
            text = _read(rest)
            print(*(advice.canonical_text(text) or map(advice.canonical, advice.derive(_plan(text)))), sep="\n")
        elif command == "json":
            print(jsonplan.to_json(_plan(_read(rest))))
        elif command == "narrow" and rest:
            sys.stdout.write(reflow(_read(rest[1:]), int(rest[0])))
        else:
            print(__doc__, file=sys.stderr)
            return 2
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
