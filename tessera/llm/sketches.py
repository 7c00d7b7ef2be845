"""Operator 6: document fingerprints as invertible Bloom lookup sketches, in
DataFrame operations only.

A text's paragraphs (its lines, long ones parted at sentence ends) are hashed to
60-bit keys. Each key is put into one cell of each of three subtables; a cell holds a
count, the xor of its keys and the xor of their check values. The cells of two
versions subtract; cells with a single key left peel, which takes that key out of its
other cells, until the keys of the differing paragraphs are recovered. Where peeling
stops early it is tried again with a larger sketch: keys are parted by their upper
bits into as many sub-sketches as the two texts' key counts ask for, and a sub-sketch
that fails doubles its cells.

All of it is one expression over a row: texts are shuffled once, to meet their
successor, and keys not at all.
"""

from __future__ import annotations

import json
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, let, partitions, text_of, without

#: From a character that isn't white space up to a line's end or a sentence mark.
PIECE = r"[^\x20\x09-\x0D][^.!?\n]*[.!?]*"

#: Cells of a subtable of the published sketch; there are three subtables.
CELLS = 8
#: Keys of a sub-sketch, on average, when a larger sketch is tried.
LOAD = 8
#: Cells of a subtable in the tries of a sub-sketch; after the last one the two key
#: sets are compared directly.
TRIES = (8, 16, 32, 64)
#: Peeling rounds; a round takes out all single keys at once.
ROUNDS = 12

CELL = "array<struct<n:int,x:bigint,y:bigint>>"
FOUND = "array<struct<k:bigint,s:int>>"


def keys_of(text: Column) -> Column:
    """Array of the pieces' keys, repeats included, in text order."""
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    return F.transform(pieces, lambda p: F.conv(F.substring(F.md5(p), 1, 15), 16, 10).cast("long"))


def check_of(key: Column) -> Column:
    """A value that the xor of several keys hardly ever has: 31 bits, not linear."""
    return (key % 2147483629) * 48271 % 2147483647


def place_of(key: Column, table: int, cells: int) -> Column:
    return F.shiftright(key, 12 * table) % cells


def cells_of(keys: Column, cells: int) -> Column:
    """The three subtables, one after the other, of an array of distinct keys."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))

    def add(acc: Column, k: Column) -> Column:
        return F.struct((acc["n"] + 1).alias("n"), acc["x"].bitwiseXOR(k).alias("x"), acc["y"].bitwiseXOR(check_of(k)).alias("y"))

    def table(t: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda i: F.aggregate(F.filter(keys, lambda k: place_of(k, t, cells) == i), empty, add))

    return F.concat(*[table(t) for t in range(3)])


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: F.struct((p["n"] - q["n"]).alias("n"), p["x"].bitwiseXOR(q["x"]).alias("x"), p["y"].bitwiseXOR(q["y"]).alias("y")))


def peel(diff: Column, cells: int) -> Column:
    """Struct of the cells that are left and the keys found, with their sign. A round
    that finds nothing ends it (later ones are passed over)."""

    def step(acc: Column, _: Column) -> Column:
        single = F.filter(acc["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["y"] == check_of(c["x"])))
        key = F.array_distinct(F.transform(single, lambda c: F.struct(c["x"].alias("k"), c["n"].alias("s"))))
        found = F.transform(
            key,
            lambda k: F.struct(k["k"].alias("k"), k["s"].alias("s"), check_of(k["k"]).alias("y"), *[(place_of(k["k"], t, cells) + t * cells).alias(f"p{t}") for t in range(3)]),
        )

        def without_found(f: Column) -> Column:
            def minus(acc2: Column, k: Column) -> Column:
                return F.struct((acc2["n"] - k["s"]).alias("n"), acc2["x"].bitwiseXOR(k["k"]).alias("x"), acc2["y"].bitwiseXOR(k["y"]).alias("y"))

            left = F.transform(acc["cells"], lambda c, i: F.aggregate(F.filter(f, lambda k: (k["p0"] == i) | (k["p1"] == i) | (k["p2"] == i)), c, minus))
            more = F.concat(acc["found"], F.transform(f, lambda k: F.struct(k["k"].alias("k"), k["s"].alias("s"))))
            return F.struct(left.cast(CELL).alias("cells"), more.cast(FOUND).alias("found"), F.lit(True).alias("go"))

        ended = F.struct(acc["cells"].alias("cells"), acc["found"].alias("found"), F.lit(False).alias("go"))
        return F.when(~acc["go"], acc).otherwise(let(found, lambda f: F.when(F.size(f) == 0, ended).otherwise(without_found(f))))

    begin = F.struct(diff.cast(CELL).alias("cells"), F.array().cast(FOUND).alias("found"), F.lit(True).alias("go"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, step)


def recovered(diff: Column, cells: int) -> Column:
    """The keys that a difference of sketches gives up, each with the sign of the side that
    has it (1: the first one), null if cells are left."""
    return let(peel(diff, cells), lambda p: F.when(~F.exists(p["cells"], lambda c: (c["n"] != 0) | (c["x"] != 0)), p["found"]))


def decoded(diff: Column, cells: int) -> Column:
    """Number of keys recovered, null if cells are left."""
    return let(recovered(diff, cells), lambda f: F.when(f.isNotNull(), F.size(f)))


def _tries(a: Column, b: Column) -> Column:
    """Differing keys of two small sets: by ever larger sketches, at last by comparing them."""

    def signed(keys: Column, sign: int) -> Column:
        return F.transform(keys, lambda k: F.struct(k.alias("k"), F.lit(sign).alias("s")))

    exact = F.concat(signed(F.array_except(a, b), 1), signed(F.array_except(b, a), -1)).cast(FOUND)
    return F.coalesce(*[recovered(subtract(cells_of(a, c), cells_of(b, c)), c) for c in TRIES], exact)


def _parted(a: Column, b: Column) -> Column:
    """Differing keys of two sets, by sub-sketches; keys are parted twice, by
    consecutive bits, so that the work stays near the number of keys."""
    parts = F.greatest(F.ceil((F.size(a) + F.size(b)) / F.lit(LOAD)), F.lit(1)).cast("int")
    zero = F.lit(0)

    def part(keys: Column, shift: int, n: Column, g: Column) -> Column:
        return F.filter(keys, lambda k: F.shiftright(k, shift) % n == g)

    def inner(x: Column, y: Column, n: Column) -> Column:
        return F.flatten(F.transform(F.sequence(zero, n - 1), lambda h: let(F.struct(part(x, 48, n, h).alias("a"), part(y, 48, n, h).alias("b")), lambda s: _tries(s["a"], s["b"]))))

    def outer(n: Column) -> Column:
        return F.flatten(F.transform(F.sequence(zero, n - 1), lambda g: let(F.struct(part(a, 36, n, g).alias("a"), part(b, 36, n, g).alias("b")), lambda s: inner(s["a"], s["b"], n))))

    return let(F.ceil(F.sqrt(parts)).cast("int"), outer)


def difference(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """Array of (k, s): the digests of the pieces that only one of two versions has, as their
    sketches give them up; s is 1 for the first one's, -1 for the second one's."""
    return F.coalesce(recovered(subtract(cells_a, cells_b), CELLS), _parted(a, b))


def likeness(a: Column, b: Column, differing: Column) -> Column:
    """Jaccard likeness of two texts' distinct pieces, from the number of keys that their
    sketches' difference gives; two texts without pieces are alike."""
    both = (F.size(a) + F.size(b)).cast("double")
    return F.when(both == 0, F.lit(1.0)).otherwise((both - F.size(differing)) / (both + F.size(differing)))


def as_string(n_pieces: Column, cells: Column) -> Column:
    """The published form: number of pieces, then count, key and check of each cell."""
    part = F.transform(cells, lambda c: F.lower(F.concat_ws("-", F.hex(c["n"]), F.hex(c["x"]), F.hex(c["y"]))))
    return F.concat_ws(".", F.lower(F.hex(n_pieces)), F.array_join(part, "."))


def fingerprint(text: Column) -> Column:
    """A text's published sketch as a string; null counts as empty."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return let(keys_of(t), lambda k: as_string(F.size(k), cells_of(F.array_distinct(k), CELLS)))


def _order_key(doc_id: Column, text: Column) -> Column:
    """A string that sorts as (doc_id, nulls last, digest of the text) does."""
    turned = F.lpad(F.hex(doc_id.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))), 16, "0")
    return F.concat(F.coalesce(F.concat(F.lit("0"), turned), F.lit("1")), F.md5(text))


def _range_of(key: Column, firsts: list[str]) -> Column:
    """Place of the last of the sorted keys `firsts` at or below a key, found in two steps."""
    step = max(int(len(firsts) ** 0.5), 1)
    chunks = [firsts[i : i + step] for i in range(0, len(firsts), step)]
    heads = F.from_json(F.lit(json.dumps([c[0] for c in chunks])), "array<string>")
    nested = F.from_json(F.lit(json.dumps(chunks)), "array<array<string>>")

    def within(c: Column) -> Column:
        return (c - 1) * step + F.size(F.filter(F.get(nested, c - 1), lambda x: x <= key)) - 1

    return let(F.size(F.filter(heads, lambda x: x <= key)), within)


def _bounds(keys: DataFrame, n: int) -> list[str]:
    """First keys of n ranges or fewer of about as many characters of text each. keys: (key,
    size). Spark samples the keys for finer ranges, of which only first key and size come
    to the driver (8 n rows); neighbours are joined there."""
    fine = keys.repartitionByRange(8 * n, "key").withColumn("part", F.spark_partition_id())
    rows = sorted((r["key"], r["size"]) for r in fine.groupBy("part").agg(F.min("key").alias("key"), F.sum("size").alias("size")).collect())
    share = sum(size for _, size in rows) / n
    out, held = [], share
    for key, size in rows:
        if held >= share:
            out.append(key)
            held = 0
        held += size
    return out


def with_next(docs: DataFrame, ranges: int | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text, *more) plus next_text and next_<more>: the row after it by
    doc_id (nulls last), ties by a digest of the text; after the last row the first.

    A global order without a global sort: ranges of the sort key, of like size however many
    rows share an id or have none, take the rows in one shuffle, and the first row of a range
    is also sent to the range before. Only the ranges' first keys come to the driver.
    """
    n = ranges or partitions(docs.sparkSession)
    key = _order_key(F.col("doc_id"), F.col("text"))
    firsts = _bounds(docs.select(key.alias("key"), (F.length("text") + 64).alias("size")), n)
    if not firsts:
        return docs.select("*", F.col("text").alias("next_text"), *[F.col(c).alias(f"next_{c}") for c in more])
    keyed = docs.withColumn("__k", key).withColumn("__r", _range_of(F.col("__k"), firsts))
    # A range's first row: of rows alike in key any one, they are alike in text.
    heads = keyed.filter(F.array_contains(F.from_json(F.lit(json.dumps(firsts)), "array<string>"), F.col("__k")))
    heads = heads.withColumn("__n", F.row_number().over(Window.partitionBy("__r").orderBy("__k"))).filter("__n = 1").drop("__n")
    heads = heads.withColumn("__r", F.pmod(F.col("__r") - 1, F.lit(len(firsts)))).withColumn("__head", F.lit(1))
    rows = keyed.withColumn("__head", F.lit(0)).unionByName(heads)
    w = Window.partitionBy("__r").orderBy("__head", "__k")
    rows = rows.select("*", F.lead("text").over(w).alias("next_text"), *[F.lead(c).over(w).alias(f"next_{c}") for c in more])
    return rows.filter("__head = 0").drop("__r", "__head", "__k")


def compare_versions(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """rows plus, for each pair of array<bigint> key columns, its likeness and, behind
    <name>_keys, the differing digests themselves (k, s; see `difference`). Null keys
    count as none; columns of rows named like the results give way to them."""
    out = without(rows, [*pairs, *(f"{n}_keys" for n in pairs)])
    blank = F.array().cast("array<bigint>")
    for a in sorted({x for p in pairs.values() for x in p}):
        out = out.withColumn(f"__d_{a}", F.array_distinct(F.coalesce(a, blank)))
    for a in sorted({x for p in pairs.values() for x in p}):
        out = out.withColumn(f"__c_{a}", cells_of(F.col(f"__d_{a}"), CELLS))
    for name, (a, b) in pairs.items():
        out = out.withColumn(f"{name}_keys", difference(F.col(f"__d_{a}"), F.col(f"__d_{b}"), F.col(f"__c_{a}"), F.col(f"__c_{b}")))
    for name, (a, b) in pairs.items():
        out = out.withColumn(name, likeness(F.col(f"__d_{a}"), F.col(f"__d_{b}"), F.col(f"{name}_keys")))
    return out


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited version.

    Null texts count as empty; an empty text has no pieces, an empty sketch, and is
    alike (1.0) to another without pieces. A lone document is its own successor.
    """
    docs = documents(spark, sf_dir).select("doc_id", text_of().alias("text"))
    rows = with_next(docs.withColumn("keys", keys_of(F.col("text"))), more=("keys",))
    n = F.length("text")
    cut = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "keys", "next_keys")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "keys", "next_keys", keys_of(F.col("edited")).alias("edited_keys"))
    rows = compare_versions(rows, {"near_edited": ("keys", "edited_keys"), "near_next": ("keys", "next_keys")})
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_string(F.size("keys"), F.col("__c_keys")).alias("fingerprint"),
        as_string(F.size("edited_keys"), F.col("__c_edited_keys")).alias("edited_fingerprint"), "near_edited", "near_next",
        F.size(F.filter("near_edited_keys", lambda x: x["s"] == 1)).cast("long").alias("n_removed"), F.size(F.filter("near_edited_keys", lambda x: x["s"] == -1)).cast("long").alias("n_added"),
    )


ORACLE = r"""
with d as (select row_number() over (order by doc_id nulls last, md5(coalesce(text, ''))) as r, doc_id, coalesce(text, '') as text, count(*) over () as n from documents),
e as (select a.r, a.doc_id, a.text, b.text as nt, length(a.text) as n_chars,
             left(a.text, length(a.text) - length(a.text) // 2) || left(b.text, length(a.text) // 2) as et
      from d a join d b on b.r = a.r % a.n + 1),
v as (select r, v, t from e, lateral (values (0, text), (1, et), (2, nt)) x(v, t)),
p as (select r, v, cast('0x' || substr(md5(p), 1, 15) as bigint) as k from (select r, v, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D][^.!?\n]*[.!?]*')) as p from v)),
u as (select distinct r, v, k from p),
g as (select r, v, t * 8 + (k >> (12 * t)) % 8 as cell, count(*) as n, bit_xor(k) as x, bit_xor((k % 2147483629) * 48271 % 2147483647) as y
      from u, (values (0), (1), (2)) z(t) where v < 2 group by all),
c as (select r, v, cell from e, (values (0), (1)) a(v), range(24) b(cell)),
f as (select r, v, string_agg(lower(printf('%x-%x-%x', coalesce(n, 0), coalesce(x, 0), coalesce(y, 0))), '.' order by cell) as s from c left join g using (r, v, cell) group by r, v),
h as (select e.r, f.v, lower(printf('%x', (select count(*) from p where p.r = e.r and p.v = f.v))) || '.' || f.s as s from e join f using (r)),
l as (select r, v, list(k) as ks from u group by r, v),
j as (select e.r, w.v, coalesce(a.ks, []::bigint[]) as a, coalesce(b.ks, []::bigint[]) as b from e cross join (values (1), (2)) w(v) left join l a on a.r = e.r and a.v = 0 left join l b on b.r = e.r and b.v = w.v),
q as (select r, v, case when len(a) + len(b) = 0 then 1.0::double else len(list_intersect(a, b))::double / (len(a) + len(b) - len(list_intersect(a, b))) end as near from j),
x as (select r, len(list_filter(a, lambda k: not list_contains(b, k))) as n_removed, len(list_filter(b, lambda k: not list_contains(a, k))) as n_added from j where v = 1)
select e.doc_id, cast(e.n_chars as bigint) as n_chars, sha256(e.et) as edited_sha256, h0.s as fingerprint, h1.s as edited_fingerprint, q1.near as near_edited, q2.near as near_next, cast(n_removed as bigint) as n_removed, cast(n_added as bigint) as n_added
from e join x using (r) join h h0 on h0.r = e.r and h0.v = 0 join h h1 on h1.r = e.r and h1.v = 1 join q q1 on q1.r = e.r and q1.v = 1 join q q2 on q2.r = e.r and q2.v = 2
"""
