"""Operator 9: quality rules as a short-circuit cascade, in DataFrame operations only.

A rule is a boolean column that is true where a text is rejected. Before a run each
rule is measured on a bounded sample: its cost (seconds over the sample, evaluated
several times a row, less what the same job takes without it) and, from the verdicts of
all rules together, the share it rejects of what the rules before it keep. The next rule
is always the one with the most such rejections per cost. The rules are nested in one
CASE expression, so a row that an early rule rejects is never shown to a later one. The
order decides only how much is computed; the verdict is the same in any order.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, documents, let, staged, text_of, without, word_count

#: Rows of the sample on which rules are measured, and how often a rule is evaluated on each
#: when it is timed. The verdicts don't depend on them.
SAMPLE_ROWS = 1000
REPEATS = 4

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Text:
    """A text column that is never null, and two counts that most rules divide by; they
    are columns of their own, so each is computed once a row."""

    text: Column
    n_words: Column
    word_chars: Column


@dataclass(frozen=True)
class Rule:
    """name, and what makes the rejecting column (never null) of a text."""

    name: str
    rejects: Callable[[Text], Column]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_chars_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def n_matching(text: Column, outside: str) -> Column:
    """Characters left once those that match the class `outside` are gone."""
    return F.length(F.regexp_replace(text, outside, "")).cast("long")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))


def n_dup_lines_of(text: Column) -> Column:
    return let(worded_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _window_hashes(words: Column) -> Column:
    at = F.sequence(F.lit(1), F.size(words) - 2)
    return F.transform(at, lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))


def _covered(pairs: Column) -> Column:
    """Of (hash, position) structs sorted by hash: positions within 3 of the start of
    a window that has an equal one."""
    last = F.size(pairs) - 1
    same = F.filter(pairs, lambda x, i: ((i > 0) & (F.get(pairs, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(pairs, i + 1)["h"] == x["h"])))
    starts = F.sort_array(F.transform(same, lambda x: x["i"]))
    swept = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(s.alias("at"), (acc["n"] + F.least(F.lit(3), s - acc["at"])).alias("n")),
    )
    return swept["n"]


def n_repeat_words_of(words: Column) -> Column:
    """Positions of words inside a 3-word window whose words, in order, stand in the
    text at least twice. Windows are told apart by 64-bit hashes. Texts without an
    equal pair of windows (found by array_distinct) end there; for the others the
    windows are sorted by hash, those with an equal neighbour are kept, and their
    starts, sorted, cover min(3, distance to the start before) words each."""
    zero = F.lit(0).cast("long")

    def sweep(h: Column) -> Column:
        return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), _covered)

    return let(words, lambda w: F.when(F.size(w) < 4, zero).otherwise(let(_window_hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), sweep(h)).otherwise(zero))))


def n_stutters_of(words: Column) -> Column:
    """Words equal to the word before them."""
    return let(words, lambda w: F.size(F.filter(w, lambda x, i: (i > 0) & (F.get(w, i - 1) == x))).cast("long"))


def _copied_lines(text: Column, percent: int) -> Column:
    lines = F.transform(F.array(worded_lines(text)), lambda x: 100 * (F.size(x) - F.size(F.array_distinct(x))) > percent * F.size(x))
    return F.get(lines, F.lit(0))


def rules() -> list[Rule]:
    """The production rules. Each one is total: no text makes it null."""
    return [
        Rule("few_words", lambda t: t.n_words < MIN_WORDS),
        Rule("repeats", lambda t: 100 * n_repeat_words_of(words_of(t.text)) > MAX_REPEAT_PERCENT * t.n_words),
        Rule("symbols", lambda t: 10 * n_chars_of(t.text, SYMBOLS) > t.n_words),
        Rule("exclamations", lambda t: 10 * n_chars_of(t.text, "!") > t.n_words),
        Rule("capitals", lambda t: 100 * n_matching(t.text, r"[^\p{Lu}]") > 40 * n_matching(t.text, r"[^\p{L}]")),
        Rule("copied_lines", lambda t: _copied_lines(t.text, 50)),
        Rule("word_length", lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 15 * t.n_words)),
        Rule("stutters", lambda t: 100 * n_stutters_of(words_of(t.text)) > 30 * t.n_words),
    ]


def fresh(docs: DataFrame, name: str) -> str:
    """The name, with _ behind it as often as a column of docs has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def counted(docs: DataFrame, text: Column) -> tuple[DataFrame, Text]:
    """docs with the two counts as further columns, and the text to judge."""
    words, chars = fresh(docs, "__q_words"), fresh(docs, "__q_chars")
    rows = docs.withColumns({words: word_count(text), chars: n_matching(text, SPACE)})
    return rows, Text(text, F.col(words), F.col(chars))


@dataclass(frozen=True)
class Measured:
    """rejected: share of the sample that the rule rejects of what those before it keep."""

    rule: Rule
    seconds: float
    rejected: float


def in_order(found: list[Rule], seconds: list[float], verdicts: list[tuple[int, int]]) -> list[Measured]:
    """Greedy order by rejections per cost among the rows still kept (ties by name).
    verdicts: (bits of the rules that reject, rows with these)."""
    total = max(sum(n for _, n in verdicts), 1)
    out: list[Measured] = []
    left = set(range(len(found)))
    seen = 0
    while left:
        share = {i: sum(n for bits, n in verdicts if not bits & seen and bits >> i & 1) / total for i in left}
        best = min(left, key=lambda i: (-share[i] / max(seconds[i], 1e-6), found[i].name))
        out.append(Measured(found[best], seconds[best], share[best]))
        left.remove(best)
        seen |= 1 << best
    return out


def measure(docs: DataFrame, found: list[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS, given: list[Rule] | None = None) -> list[Measured]:
    """The rules in the order to run them in, with cost and selectivity, on a sample of
    about sample_rows of the rows that the rules `given` don't reject. On an empty table
    all selectivities are 0."""
    n = docs.count()
    share = min(1.0, sample_rows / max(n, 1))
    sample, t = counted(docs.select(text_of(text).alias("t")).sample(share, seed=9), F.col("t"))
    for rule in given or []:
        sample = sample.filter(~rule.rejects(t))
    sample = staged(sample, "rules-sample")
    bits = sum((F.when(rule.rejects(t), F.lit(1 << i)).otherwise(0).cast("long") for i, rule in enumerate(found)), F.lit(0).cast("long"))
    # No more rows than the sample has, whatever the number of rules.
    verdicts = [(r["bits"], r["n"]) for r in sample.select(bits.alias("bits")).groupBy("bits").agg(F.count("*").alias("n")).collect()]
    again = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def seconds(condition: Column) -> float:
        """The faster of two runs: the first one compiles."""
        spent = []
        for _ in range(2):
            began = time.perf_counter()
            again.agg(F.count(F.when(condition, 1))).first()
            spent.append(time.perf_counter() - began)
        return min(spent)

    idle = seconds(F.length("t") < 0)
    return in_order(found, [max(seconds(rule.rejects(t)) - idle, 1e-6) for rule in found], verdicts)


def cascade(text: Text, ordered: list[Rule]) -> Column:
    """True where no rule rejects. CASE stops at the first branch that holds."""
    case = None
    for rule in ordered:
        case = F.when(rule.rejects(text), False) if case is None else case.when(rule.rejects(text), False)
    return F.lit(True) if case is None else case.otherwise(True)


def judge(docs: DataFrame, found: list[Rule] | None = None, text: str = "text", result: str = "kept") -> DataFrame:
    """docs plus a boolean column: does the text pass all rules?

    A null text counts as an empty one (and fails a rule on few words). Equal texts
    get equal verdicts; rows stay as often as they come; an empty table gives an
    empty result. A column of docs named like the result gives way to it.
    """
    docs = without(docs, [result])
    ordered = [m.rule for m in measure(docs, rules() if found is None else found, text)]
    rows, t = counted(docs, text_of(text))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], cascade(t, ordered).alias(result))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus the base measures of the quality query, for every whole text."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    t = text_of(text)
    docs = without(docs, names)
    words = fresh(docs, "__q_words")
    return docs.withColumn(words, words_of(t)).select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size(words).cast("long").alias("n_words"),
        n_matching(t, SPACE).alias("word_chars"),
        n_chars_of(t, SYMBOLS).alias("n_symbols"),
        n_dup_lines_of(t).alias("n_dup_lines"),
        n_repeat_words_of(F.col(words)).alias("n_repeat_words"),
    )


def op9_quality_cascade(spark, sf_dir: str) -> DataFrame:
    """Base measures and verdict. The two base rules are part of the cascade's rules;
    the query has their measures at hand anyway and shows the cascade the rest."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    base = [r for r in rules() if r.name in ("few_words", "repeats")]
    more = [m.rule for m in measure(docs, [r for r in rules() if r not in base], given=base)]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = measures(docs).withColumn("base_failed", failed)
    known = Text(text_of(), F.col("n_words"), F.col("word_chars"))
    rows = rows.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(cascade(known, more)))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select rid, unnest(range(1, len(w) - 1)) as i, w from d where len(w) >= 3),
g as (select rid, i, count(*) over (partition by rid, w[i], w[i + 1], w[i + 2]) as c from p),
s as (select rid, count(distinct i + o) as n from g, (values (0), (1), (2)) x(o) where c >= 2 group by rid),
l as (select rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
a as (select rid, count(*) filter (w[i] = w[i - 1]) as n from (select rid, w, unnest(range(2, len(w) + 1)) as i from d where len(w) >= 2) group by rid),
m as (
  select d.rid, d.doc_id, d.text, cast(len(d.w) as bigint) as n_words,
         cast(length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
         cast(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(len(l.ls) - len(list_distinct(l.ls)) as bigint) as n_dup_lines, len(l.ls) as n_lines,
         cast(coalesce(s.n, 0) as bigint) as n_repeat_words, coalesce(a.n, 0) as stutters
  from d join l using (rid) left join s using (rid) left join a using (rid)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       10 * n_symbols > n_words
       or 10 * length(regexp_replace(text, '[^!]', '', 'g')) > n_words
       or 100 * length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) > 40 * length(regexp_replace(text, '[^\p{L}]', '', 'g'))
       or 100 * n_dup_lines > 50 * n_lines
       or word_chars < 2 * n_words or word_chars > 15 * n_words
       or 100 * stutters > 30 * n_words as rejected from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not rejected as kept from b
"""
