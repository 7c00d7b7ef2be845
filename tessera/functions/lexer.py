"""SQL text -> tokens, statements, attached comments. PostgreSQL's lexical rules.

Two forms: `lex`, exact, for use inside Arrow batches (nested comments are not
regular); and `native_tokens`, a Catalyst column for the regular part of the language,
which the catalogue's token statistics use and DuckDB can reproduce.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that count as keywords.
KEYWORDS = frozenset(
    """
    select from where group by having order insert into update set delete returning with recursive values union all intersect except
    join left right full inner outer cross on using and or not null is in between like ilike case when then else end as distinct
    limit offset asc desc nulls first last create table schema if exists alter drop primary key unique check references default
    begin commit rollback transaction over partition window rows range unbounded filter within preceding following current row
    grouping sets cube rollup cast language function returns true false lateral only of to for conflict do nothing constraint foreign
    materialized explain trigger procedure each after before execute index view statistics sequence include tablespace merge matched
    source target immutable stable volatile strict parallel security definer invoker concurrently unlogged inherits prepare deallocate
    attach detach validate rename add column privileges database encoding owner grant revoke template cascade restrict role usage tables
    sequences routines extension enable disable partitions split graph_table graph property properties match columns vertex edge
    relationship node destination
    groups exclude ties deferrable deferred initially immediate reset inherit cluster replica no force options
    """.split()
)

#: Operators of two and more characters.
OPERATORS = (
    "<->>> <<<-> !~~* #<=# #>=# <->> <<-> ~<=~ ~>=~ !~* !~~ #<# #># #>> %>> &<| *<= *<> *>= ->> -|- <#> <-> <<% <<= <<| <=> <@> >>= "
    "?-| ?<@ ?@> ?|| @-@ @@@ ^<@ ^@> |&> |>> ||/ ~<~ ~>~ ~~* !! != !~ ## #- #= #> %# %% %> && &< &> *< *= *> :: -> <% << <= <> <@ <^ "
    ">= >> >^ ?# ?& ?- ?@ ?| ?~ @> @? @@ ^? ^@ ^~ |/ || ~* ~= ~> ~~"
).split()

_OPERATOR = "|".join(re.escape(o) for o in sorted([*OPERATORS, ":=", "=>", ".."], key=len, reverse=True))
_IDENT = r"[A-Za-z_\x80-\U0010ffff][A-Za-z0-9_$\x80-\U0010ffff]*"
#: Alternatives in the order in which they are tried.
_TOKEN = re.compile(
    rf"""
    (?P<space>\s+)
  | (?P<line_comment>--[^\n]*)
  | (?P<block_comment>/\*)
  | (?P<string>(?:[Ee]'(?:[^'\\]|''|\\.)*' | (?:[BbXx]|[Uu]&)?'(?:[^']|'')*'))
  | (?P<quoted_ident>"(?:[^"]|"")*")
  | (?P<dollar_string>\$(?P<tag>(?:[A-Za-z_\x80-\U0010ffff][A-Za-z0-9_\x80-\U0010ffff]*)?)\$.*?\$(?P=tag)\$)
  | (?P<param>\$\d+ | :'[^'\n]*' | :"[^"\n]*" | :[A-Za-z_]\w*)
  | (?P<backslash_cmd>\\[^\n]*)
  | (?P<number>\d[\d_]*(?:\.\d*)?(?:[eE][+-]?\d+)?)
  | (?P<ident>{_IDENT})
  | (?P<operator>{_OPERATOR}|[+\-*/<>=~!@\#%^&|`?:])
  | (?P<punct>[(),;.\[\]])
  | (?P<other>.)
    """,
    re.X | re.S,
)
_OPEN = re.compile(r"""[Ee]?'|[BbXx]'|[Uu]&'|"|\$(?:[A-Za-z_]\w*)?\$""")


class LexError(ValueError):
    pass


@dataclass(slots=True, init=False)
class Token:
    kind: str
    text: str
    line: int
    col: int
    blank_before: bool
    comments: list[Token]
    trailing: Token | None
    as_is: bool  # shown as typed, even if it is a keyword
    ends: bool  # a ; stood behind it
    graph: bool  # inside GRAPH_TABLE, whose patterns are written without spaces
    lower: str
    word: str  # a keyword in lower case, or ''

    def __init__(self, kind: str, text: str, line: int = 1, col: int = 0, blank_before: bool = False, comments: list[Token] | None = None, trailing: Token | None = None) -> None:
        self.kind, self.line, self.col, self.blank_before, self.trailing = kind, line, col, blank_before, trailing
        self.comments = [] if comments is None else comments
        self.as_is = self.ends = self.graph = False
        self.text = text
        self.lower = low = text.lower()
        self.word = low if kind == "keyword" else ""

    def say(self, text: str) -> None:
        """Sets the text and what is read from it."""
        self.text, self.lower = text, text.lower()
        self.word = self.lower if self.kind == "keyword" else ""

    def __repr__(self) -> str:
        return f"{self.kind}:{self.text}"


def _block_end(text: str, start: int, line: int) -> int:
    """End of a block comment, nested ones included."""
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, start):
        depth += 1 if m[0] == "/*" else -1
        if depth == 0:
            return m.end()
    raise LexError(f"unterminated block comment at line {line}")


#: Kinds that can span lines.
_SPANNING = frozenset(("space", "block_comment", "string", "quoted_ident", "dollar_string"))


def lex(text: str) -> list[Token]:
    """All tokens, comments among them; col counts bytes from 0."""
    out: list[Token] = []
    at, line, line_start, blank = 0, 1, 0, False
    size, ascii_, match = len(text), text.isascii(), _TOKEN.match
    while at < size:
        first = text[at]
        if first == " " and "!" <= text[at + 1 : at + 2] <= "~":  # a single space, as most are
            at, blank = at + 1, False
            continue
        m = match(text, at)
        kind, end = m.lastgroup, m.end()
        if first == "$" and m["dollar_string"] is not None:
            kind = "dollar_string"
        if kind == "block_comment":
            end = _block_end(text, at, line)
        elif (first in "'\"$" or first in "EeBbXxUu" and text[end : end + 1] in ("'", "&")) and kind in ("operator", "other", "ident", "param") and (o := _OPEN.match(text, at)):
            what = {"'": "string literal", '"': "quoted identifier"}.get(o[0][-1], "dollar-quoted string")
            if not (what == "dollar-quoted string" and kind == "param"):
                raise LexError(f"unterminated {what} at line {line}")
        piece = text[at:end]
        spans = kind in _SPANNING and "\n" in piece
        if kind == "space":
            blank = spans and piece.count("\n") >= 2
        else:
            if kind == "ident":
                if piece.lower() in KEYWORDS:
                    kind = "keyword"
            elif kind == "quoted_ident":
                kind = "ident"
            elif kind == "other":
                kind = "operator"
            elif kind in ("line_comment", "backslash_cmd"):
                piece = piece.rstrip()
            out.append(Token(kind, piece, line, at - line_start if ascii_ else len(text[line_start:at].encode()), blank))
            blank = False
        if spans:
            line += piece.count("\n")
            line_start = at + piece.rindex("\n") + 1
        at = end
    return out


def pieces(text: str) -> list[tuple[str, str]]:
    """(kind, text) of what `lex` gives, words and keywords alike idents; LexError as there."""
    out: list[tuple[str, str]] = []
    at, size, match = 0, len(text), _TOKEN.match
    while at < size:
        first = text[at]
        if first == " ":
            at += 1
            continue
        m = match(text, at)
        kind, end = m.lastgroup, m.end()
        if kind == "block_comment":
            end = _block_end(text, at, text.count("\n", 0, at) + 1)
        elif (first in "'\"$" or first in "EeBbXxUu" and text[end : end + 1] in ("'", "&")) and kind in ("operator", "other", "ident", "param") and m["dollar_string"] is None:
            if (o := _OPEN.match(text, at)) and (kind != "param" or o[0][-1] != "$"):
                raise LexError(f"unterminated text at line {text.count(chr(10), 0, at) + 1}")
        if kind != "space":
            out.append((kind, text[at:end].rstrip() if kind in ("line_comment", "backslash_cmd") else text[at:end]))
        at = end
    return out


def attach(tokens: list[Token]) -> tuple[list[Token], list[Token]]:
    """(tokens without comments, comments after the last one). A comment on the line of
    the token before it trails that token, unless it is a block of several lines; others
    lead the next token."""
    out: list[Token] = []
    held: list[Token] = []
    for t in tokens:
        if t.kind not in ("line_comment", "block_comment"):
            if held:
                t.comments, held = held, []
            out.append(t)
        elif out and not held and out[-1].trailing is None and t.line == out[-1].line + out[-1].text.count("\n") and "\n" not in t.text:
            out[-1].trailing = t
        else:
            held.append(t)
    return out, held


def statements(tokens: list[Token]) -> list[list[Token]]:
    """Split at ; outside parentheses; a psql command is a statement of its own. The ; goes,
    its comments stay with the statement's last token."""
    out: list[list[Token]] = [[]]
    depth = 0
    for t in tokens:
        if t.kind == "punct":
            depth += (t.text == "(") - (t.text == ")")
        if t.text == ";" and t.kind == "punct" and depth <= 0:
            if out[-1]:
                last = out[-1][-1]
                last.trailing, last.ends = last.trailing or t.trailing, True
                out.append([])
            depth = 0
        elif t.kind == "backslash_cmd":
            out += [[t], []] if not out[-1] else [[t], []]
        else:
            out[-1].append(t)
    return [s for s in out if s]


def statement_kind(tokens: list[Token]) -> str:
    """What a statement is, by its first words."""
    words = [t.lower for t in tokens[:8]]
    if not words:
        return "empty"
    if tokens[0].kind == "backslash_cmd":
        return "psql"
    if words[0] == "(":
        return "query"
    if words[0] == "create":
        rest = [w for w in words[1:] if w not in ("or", "replace", "temp", "temporary", "unlogged", "unique", "materialized", "global", "local", "constraint", "recursive", "foreign", "event")]
        return f"create {rest[0]}" if rest else "create"
    if words[0] == "alter":
        return f"alter {words[1]}" if len(words) > 1 else "alter"
    return "query" if words[0] in ("select", "with", "values", "table") else words[0]


def split_dollar_quoted(text: str) -> tuple[str, str] | None:
    """(delimiter, body) of one complete dollar-quoted literal."""
    m = re.fullmatch(r"(\$(?:[A-Za-z_]\w*)?\$)(.*)\1", text, re.S)
    return (m[1], m[2]) if m and m[1] not in m[2] else None


# Native form --------------------------------------------------------------------------------

#: Words, numbers, strings, operators and punctuation of the regular part: no nested
#: comments, no dollar quotes, no back-references. Java and RE2 read it alike.
NATIVE_TOKEN = r"--[^\n]*|'[^']*'|\"[^\"]*\"|[0-9]+(?:\.[0-9]+)?|[A-Za-z_][A-Za-z0-9_$]*|::|<>|<=|>=|!=|\|\||[^\x09-\x0D\x20]"


def native_tokens(text: Column) -> Column:
    """array<string> of tokens, computed inside the JVM."""
    return F.regexp_extract_all(text, F.lit(NATIVE_TOKEN), F.lit(0))


def native_kind(token: Column) -> Column:
    case = F.when(token.startswith("--"), "line_comment").when(token.startswith("'"), "string").when(token.startswith('"'), "ident")
    case = case.when(token.rlike("^[0-9]"), "number").when(F.lower(token).isin(*sorted(KEYWORDS)), "keyword").when(token.rlike("^[A-Za-z_]"), "ident")
    return case.when(token.isin(*"(),;.[]"), "punct").otherwise("operator")
