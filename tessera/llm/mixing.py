"""Operator 2: mixing sources to target weights, in DataFrame operations only.

Every row gets a hash-random key. Within its source the rows are ordered by that
key; a running sum of sizes in that order says where the source's budget cuts.
The sum is a distributed prefix scan: the key space of a source is cut into as many
equal ranges as its row count asks for (the keys are uniform, so the ranges hold
about ROWS_PER_RANGE rows each, however hot the source is), each range is summed,
the range sums are scanned in two levels, and rows are scanned inside their range.
No task gathers a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, forget, partitions, small, staged, text_of, without, word_count

#: Rows of a key range, and ranges of a group of ranges, on average.
ROWS_PER_RANGE = 4096
RANGES_PER_GROUP = 4096

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"

#: Hash keys are below this.
KEY_SPACE = 2**60

RESULTS = ["size", "source_size", "target", "taken"]


def _before(rows: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """rows plus, for each column of sums, <name>_before: its sum over the rows before, in a
    global order. Rows are range-partitioned, summed in their range, and moved by the ranges
    before, of which there are as many as shuffle partitions."""
    spark = rows.sparkSession
    # Written, so that all that follows sees the same ranges.
    ranged = staged(rows.repartitionByRange(partitions(spark), *order).withColumn("__part", F.spark_partition_id()), "mix-ranges")
    up_to = (Window.unboundedPreceding, -1)
    inner, outer = Window.partitionBy("__part").orderBy(*order).rowsBetween(*up_to), Window.orderBy("__part").rowsBetween(*up_to)
    totals = ranged.groupBy("__part").agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    totals = totals.select("__part", *[F.coalesce(F.sum(f"__{c}").over(outer), F.lit(0)).alias(f"__{c}") for c in sums])
    out = ranged.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"{c}_before") for c in sums]).join(small(totals), "__part")
    return out.withColumns({f"{c}_before": F.col(f"{c}_before") + F.col(f"__{c}") for c in sums}).drop("__part", *[f"__{c}" for c in sums])


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS) -> DataFrame:
    """Targets of sources: (source, n, source_size) -> plus sid, target, budget.

    Sources in code point order, null last, take the weights in turn. They share
    `share` times all sizes by weight; no target exceeds max_epochs times the
    source's size, and what that leaves over is shared again by weight. With sources
    ordered by the factor at which they reach their cap, a source is capped exactly
    if the level that the uncapped ones still share lies at or above its own cap, so
    two passes of running sums over the sources solve it, however many there are.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    t = _before(sizes.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], ["one"]).withColumnRenamed("one_before", "sid").drop("one")
    t = t.withColumn("weight", F.element_at(w, (F.col("sid") % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("ratio", F.col("cap") / F.col("weight"))
    t = _before(t, [F.col("ratio").asc(), F.col("sid").asc()], ["cap", "weight"])
    whole = t.agg(F.sum("source_size"), F.sum("weight")).first()
    total, open_ = float(whole[0] or 0) * share, float(whole[1] or 0)
    t = t.withColumn("level", (F.lit(total) - F.col("cap_before")) / (F.lit(open_) - F.col("weight_before"))).withColumn("capped", F.col("ratio") <= F.col("level"))
    # The first uncapped source fixes the level for all after it; what the later ones see is lower.
    level = t.agg(F.max(F.when(~F.col("capped"), F.col("level")))).first()[0]
    t = t.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.lit(level).cast("double"))))
    return t.select("sid", "source", "n", "source_size", "target", F.round("target").cast("long").alias("budget"))


def mix_key(doc_id: Column, text: Column, seed: str) -> Column:
    """Of id and text, so that rows without an id, or with the same, have keys of their own."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(text)))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS, seed=SEED, whole=False, doc_id="doc_id", text="text", source="source") -> DataFrame:
    """docs plus size, source_size, target and taken (words of the row in the mix).

    A source's budget is its target, rounded. Rows are taken max(0, budget div size
    of source) times whole, then once more in key order until the rest of the budget
    is used. The row in which the budget ends gives the words that are missing (so
    that a source's sum is its budget exactly) or, with `whole`, all or none,
    whichever comes nearer.

    Null or empty texts have size 0 and are taken 0 words; a null source is a
    source, the last; a null doc_id counts as "". Repeated rows are rows of their
    own; of rows alike in id and text it is open which one the cut meets. An empty
    table gives an empty result. Columns of docs named like a result column give way
    to it.
    """
    rows = _mixed(without(docs, RESULTS), weights, share, max_epochs, seed, whole, doc_id, text, source)
    return rows.withColumnsRenamed({f"__mix_{c}": c for c in RESULTS})


def _mixed(docs: DataFrame, weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS, seed=SEED, whole=False, doc_id="doc_id", text="text", source="source") -> DataFrame:
    """docs plus the result columns, their names behind __mix_."""
    k, size, sid, span = "__mix_key", "__mix_size", "__mix_sid", "__mix_range"
    keyed = docs.withColumn(size, word_count(text_of(text))).withColumn(k, mix_key(F.col(doc_id), text_of(text), seed))

    slim = staged(keyed.select(F.col(source).alias("__mix_of"), size, k), "mix-sizes")
    sizes = slim.groupBy(F.col("__mix_of").alias("source")).agg(F.count("*").alias("n"), F.sum(size).alias("source_size"))
    targets = staged(source_targets(sizes, weights, share, max_epochs), "mix-targets")
    targets = small(targets)
    # Equal ranges of the key space, as many as the source's rows ask for.
    t = targets.select(
        F.col("source").alias("__mix_source"), F.col("sid").alias(sid), F.ceil(F.col("n") / ROWS_PER_RANGE).alias("__mix_n"), F.col("source_size").alias("__mix_source_size"), F.col("target").alias("__mix_target"),
        F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).alias("__mix_times"), F.col("budget").alias("__mix_budget"),
    )

    def ranged(rows: DataFrame, name: str) -> DataFrame:
        joined = rows.join(t, F.col(name).eqNullSafe(F.col("__mix_source")))
        return joined.withColumn(span, F.floor(F.col(k) / F.lit(float(KEY_SPACE)) * F.col("__mix_n")).cast("long"))

    sums = ranged(slim, "__mix_of").groupBy(sid, span).agg(F.sum(size).alias("__mix_sum"))
    sums = sums.withColumn("__mix_group", F.floor(F.col(span) / RANGES_PER_GROUP))
    groups = sums.groupBy(sid, "__mix_group").agg(F.sum("__mix_sum").alias("__mix_gsum"))
    up_to = (Window.unboundedPreceding, -1)
    groups = groups.withColumn("__mix_gbefore", F.coalesce(F.sum("__mix_gsum").over(Window.partitionBy(sid).orderBy("__mix_group").rowsBetween(*up_to)), F.lit(0)))
    inner = Window.partitionBy(sid, "__mix_group").orderBy(span).rowsBetween(*up_to)
    sums = sums.withColumn("__mix_sbefore", F.coalesce(F.sum("__mix_sum").over(inner), F.lit(0)))
    starts = sums.join(groups.drop("__mix_gsum"), [sid, "__mix_group"])
    starts = staged(starts.select(sid, span, (F.col("__mix_gbefore") + F.col("__mix_sbefore")).alias("__mix_start")), "mix-starts")
    forget(slim)

    rows = ranged(keyed, source).join(small(starts), [sid, span])
    order = Window.partitionBy(sid, span).orderBy(k, F.col(doc_id), size)
    before = F.coalesce(F.sum(size).over(order.rowsBetween(*up_to)), F.lit(0)) + F.col("__mix_start")
    rest = F.col("__mix_budget") - F.col("__mix_times") * F.col("__mix_source_size")
    part = F.least(F.greatest(rest - before, F.lit(0)), F.col(size))
    if whole:
        part = F.when((rest - before) * 2 >= F.col(size), F.col(size)).otherwise(F.lit(0))
    taken = (F.col("__mix_times") * F.col(size) + part).cast("long")
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*kept, F.col(size), F.col("__mix_source_size").cast("long"), F.col("__mix_target").cast("double"), taken.alias("__mix_taken"))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs with all their columns, each as often as the mix takes it (whole
    rows only). Nulls, ties and repeated rows count as in `mix`; no column gives way."""
    rows = _mixed(docs, whole=True, **how)
    times = F.when(F.col("__mix_size") > 0, F.floor(F.col("__mix_taken") / F.col("__mix_size"))).otherwise(0).cast("int")
    rows = rows.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(1), times)))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")


ORACLE = r"""
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         cast('0x' || substr(md5('mix-1:' || coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))), 1, 15) as bigint) as k
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
r as (select *, row_number() over (order by encode(source) nulls last) - 1 as sid from s),
w as (select *, case sid % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as weight,
             source_size * 2.0::double as cap, sum(source_size) over () * 1.5::double as total from r),
o as (select *, total - coalesce(sum(cap) over (order by cap / weight, sid rows between unbounded preceding and 1 preceding), 0) as rest,
             sum(weight) over (order by cap / weight, sid rows between current row and unbounded following) as open from w),
c as (select *, cap / weight <= rest / open as capped from o),
l as (select *, max(case when not capped then rest / open end) over () as level from c),
t as (select source, source_size, case when capped then cap else least(cap, weight * level) end as target from l),
p as (select d.doc_id, d.size, t.source_size, t.target, d.source, cast(round(t.target) as bigint) as budget,
             sum(d.size) over (partition by d.source order by d.k, d.doc_id, d.size rows between unbounded preceding and current row) - d.size as before
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       cast(case when source_size = 0 then 0 else (budget // source_size) * size + least(greatest(budget - (budget // source_size) * source_size - before, 0), size) end as bigint) as taken,
       source
from p
"""
