"""Relational surface: one runnable query for each SQL construct the toolkit lays out.

A query is a text with {table} for a table. Most texts run unchanged on Spark and on
DuckDB; where the dialects differ, the Spark form stands in `spark` and the oracle's in
`duck`. Tables are read by path inside the query (parquet.`...`), so no view is
left behind and Catalyst sees the scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .folders import own_folder
from .neighbours import nearest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@dataclass(frozen=True)
class Query:
    spark: str
    duck: str | None = None

    def run(self, session: SparkSession, sf_dir: str) -> DataFrame:
        return session.sql(_fill(self.spark, lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))

    @property
    def oracle(self) -> str:
        return _fill(self.duck or self.spark, lambda t: t)


def _fill(text: str, name) -> str:
    return re.sub(r"\{(" + "|".join(TABLES) + r")\}", lambda m: name(m[1]), text)


SURFACE: dict[str, Query] = {}


def _add(key: str, spark: str, duck: str | None = None) -> None:
    SURFACE[key] = Query(spark, duck)


# Scans, projection, predicates ------------------------------------------------------
_add("river_select", """
select n_name as nation, o_orderpriority as priority, count(*) as n_orders, count(*) filter (where o_orderstatus = 'F') as n_final, round(sum(o_totalprice), 2) as total
  from {orders} o join {customer} c on o.o_custkey = c.c_custkey join {nation} n on c.c_nationkey = n.n_nationkey
 where o_orderdate >= timestamp '1995-01-01'
 group by n_name, o_orderpriority
having count(*) > 3
 order by total desc, nation, priority
 limit 40""")
_add("scan_filter_project", """
select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 2) as net
  from {lineitem} where l_shipdate >= timestamp '1995-03-01' and l_shipdate < timestamp '1995-04-01' and l_discount between 0.02 and 0.05 and l_quantity < 24""")
_add("bitmap_or_scan", "select l_orderkey, l_linenumber from {lineitem} where (l_quantity = 50 or l_discount = 0.1 or l_linestatus = 'F' and l_tax = 0.08) and l_returnflag = 'R'")
_add("bitmap_and_scan", "select o_orderkey from {orders} where o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH') and o_totalprice between 100000 and 200000")
_add("table_statement", "table {region}", "select * from region")
_add("values_table", "select k, v, k * 10 as w from values (1, 'one'), (2, 'two'), (3, null) as t(k, v)", "select k, v, k * 10 as w from (values (1, 'one'), (2, 'two'), (3, null)) as t(k, v)")
_add("series_left_join", """
select cast(d.day as string) as day, count(e.event_id) as n, round(coalesce(sum(e.value), 0), 4) as total
  from (select explode(sequence(date '2024-01-01', date '2024-03-31', interval 1 day)) as day) d
  left join {events} e on cast(e.ts as date) = d.day
 group by d.day""", """
select cast(cast(d.day as date) as varchar) as day, count(e.event_id) as n, round(coalesce(sum(e.value), 0), 4) as total
  from generate_series(date '2024-01-01', date '2024-03-31', interval 1 day) d(day)
  left join events e on cast(e.ts as date) = cast(d.day as date)
 group by d.day""")
_add("set_returning_lateral", "select o_orderkey, x.part from {orders}, lateral explode(split(o_orderpriority, '-')) as x(part)", "select o_orderkey, unnest(string_split(o_orderpriority, '-')) as part from orders")
_add("distinct_rows", "select distinct o_orderstatus, o_orderpriority from {orders}")
_add("distinct_on", """
select o_custkey, o_orderkey, o_totalprice from (
  select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from {orders}) t
 where rn = 1""", "select distinct on (o_custkey) o_custkey, o_orderkey, o_totalprice from orders order by o_custkey, o_totalprice desc, o_orderkey")
_add("between_in_case", """
select p_partkey, case when p_size between 1 and 10 then 'small' when p_size in (20, 30, 40) then 'round' else 'other' end as class,
       case p_brand when 'Brand#11' then 1 when 'Brand#12' then 2 else 0 end as brand_no
  from {part}""")
_add("like_ilike", "select p_partkey, p_name from {part} where p_type like '%A%' or p_name ilike '%a%1' or not p_brand like 'Brand#_1%'")
_add("regex_match", "select c_custkey, regexp_extract(c_name, '([0-9]+)$', 1) as digits from {customer} where c_name rlike '[13579]$'", "select c_custkey, regexp_extract(c_name, '([0-9]+)$', 1) as digits from customer where regexp_matches(c_name, '[13579]$')")
_add("null_logic", """
select l.doc_id, nullif(l.quality, 0) as quality, coalesce(nullif(l.toxic, 0), -1) as toxic, l.quality is not distinct from l.toxic as same
  from {labels} l where nullif(l.quality, 1) is null or l.toxic is distinct from l.quality""", """
select l.doc_id, nullif(l.quality, 0) as quality, coalesce(nullif(l.toxic, 0), -1) as toxic, l.quality is not distinct from l.toxic as same
  from labels l where nullif(l.quality, 1) is null or l.toxic is distinct from l.quality""")
_add("row_compare", "select n_nationkey, n_regionkey from {nation} where struct(n_regionkey, n_nationkey) > struct(2, 10)", "select n_nationkey, n_regionkey from nation where (n_regionkey, n_nationkey) > (2, 10)")
_add("row_in", "select o_orderkey from {orders} where (o_custkey, o_orderstatus) in (select c_custkey, 'F' from {customer} where c_acctbal > 5000)")
_add("cast_forms", "select o_orderkey, o_totalprice::int as whole, cast(o_orderkey as string) as key_text, o_orderdate::date::string as day from {orders}", "select o_orderkey, trunc(o_totalprice)::int as whole, cast(o_orderkey as varchar) as key_text, o_orderdate::date::varchar as day from orders")
_add("least_greatest", "select l_orderkey, l_linenumber, least(l_discount, l_tax) as low, greatest(l_discount, l_tax, 0.03) as high from {lineitem}")
_add("string_functions", "select c_custkey, upper(left(c_name, 4)) as head, length(c_name) as n, replace(c_name, '#', '-') as plain, substring(c_name, 3, 5) as mid, c_mktsegment || '/' || c_name as both, initcap(lower(c_mktsegment)) as seg from {customer}", "select c_custkey, upper(left(c_name, 4)) as head, length(c_name) as n, replace(c_name, '#', '-') as plain, substring(c_name, 3, 5) as mid, c_mktsegment || '/' || c_name as both, upper(left(c_mktsegment, 1)) || lower(substring(c_mktsegment, 2)) as seg from customer")
_add("format_and_names", "select n_nationkey, format_string('%s (%d)', n_name, n_regionkey) as label from {nation}", "select n_nationkey, format('{} ({})', n_name, n_regionkey) as label from nation")
_add("date_parts", "select extract(year from o_orderdate) as y, extract(month from o_orderdate) as m, count(*) as n from {orders} group by 1, 2")
_add("decade_trunc", "select cast(floor(year(o_orderdate) / 10) * 10 as int) as decade, count(*) as n, round(avg(o_totalprice), 2) as mean from {orders} group by 1", "select cast(floor(year(o_orderdate) / 10) * 10 as int) as decade, count(*) as n, round(avg(o_totalprice), 2) as mean from orders group by 1")
_add("interval_range", "select count(*) as n, min(o_orderkey) as least from {orders} where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1996-01-01' + interval 3 month")
_add("array_functions", "select c_custkey, element_at(split(c_name, '#'), 2) as second, array_join(array_sort(split(c_mktsegment, '')), '') as sorted from {customer}", "select c_custkey, string_split(c_name, '#')[2] as second, array_to_string(list_sort(string_split(c_mktsegment, '')), '') as sorted from customer")
_add("json_props", "select event_id, cast(get_json_object(props, '$.k') as int) as k from {events} where cast(get_json_object(props, '$.k') as int) % 7 = 3", "select event_id, cast(json_extract_string(props, '$.k') as int) as k from events where cast(json_extract_string(props, '$.k') as int) % 7 = 3")
_add("json_path_and_keys", """
select event_id, cast(get_json_object(props, '$.k') as string) as path, array_contains(json_object_keys(props), 'k') as has_key, props is not null and get_json_object(props, '$.k') = '5' as holds
  from {events}""", """
select event_id, json_extract_string(props, '$.k') as path, list_contains(json_keys(props), 'k') as has_key, props is not null and json_extract_string(props, '$.k') = '5' as holds
  from events""")
_add("hstore_as_map", """
select n_nationkey, m['region'] as region, map_contains_key(m, 'none') as has_none, array_join(array_sort(map_keys(m)), ',') as ks
  from (select n_nationkey, map('name', n_name, 'region', cast(n_regionkey as string)) as m from {nation}) t""", """
select n_nationkey, m['region'] as region, list_contains(map_keys(m), 'none') as has_none, array_to_string(list_sort(map_keys(m)), ',') as ks
  from (select n_nationkey, map {'name': n_name, 'region': cast(n_regionkey as varchar)} as m from nation) t""")
_add("to_char_forms", """
select o_orderkey, date_format(o_orderdate, 'yyyy-MM-dd HH:mm') as stamp, date_format(o_orderdate, 'MMM') as mon, trim(to_char(o_totalprice, '999999990.00')) as price from {orders}""", """
select o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') as stamp, strftime(o_orderdate, '%b') as mon, printf('%.2f', cast(o_totalprice as double)) as price from orders""")
_add("json_build", "select n_nationkey, to_json(struct(n_nationkey as key, n_name as name)) as doc from {nation}", "select n_nationkey, cast(json_object('key', n_nationkey, 'name', n_name) as varchar) as doc from nation")

# Joins -------------------------------------------------------------------------------
_add("left_join_count", "select c.c_custkey, count(o.o_orderkey) as n from {customer} c left join {orders} o on o.o_custkey = c.c_custkey group by c.c_custkey")
_add("right_join", "select r.r_name, count(n.n_nationkey) as n from (select * from {nation} where n_nationkey < 12) n right join {region} r on n.n_regionkey = r.r_regionkey group by r.r_name")
_add("full_join", """
select coalesce(a.k, b.k) as k, a.n as customers, b.n as suppliers
  from (select c_nationkey as k, count(*) as n from {customer} where c_acctbal > 8000 group by 1) a
  full join (select s_nationkey as k, count(*) as n from {supplier} group by 1) b on a.k = b.k""")
_add("cross_join", "select r.r_name, s.status from {region} r cross join (select distinct o_orderstatus as status from {orders}) s")
_add("comma_join", "select n_name, r_name from {nation}, {region} where n_regionkey = r_regionkey")
_add("join_using", "select k, n_name, r_name from (select n_regionkey as k, n_name from {nation}) n join (select r_regionkey as k, r_name from {region}) r using (k)")
_add("natural_join", "select k, n_name, r_name from (select n_regionkey as k, n_name from {nation}) n natural join (select r_regionkey as k, r_name from {region}) r")
_add("multi_predicate_on", "select o.o_orderkey, l.l_linenumber from {orders} o join {lineitem} l on l.l_orderkey = o.o_orderkey and l.l_shipdate > o.o_orderdate and l.l_quantity > 45 and o.o_orderstatus = 'O'")
_add("theta_self_join", "select a.n_name as first, b.n_name as second from {nation} a join {nation} b on a.n_regionkey = b.n_regionkey and a.n_name < b.n_name")
_add("semi_exists", "select c_custkey, c_name from {customer} c where exists (select 1 from {orders} o where o.o_custkey = c.c_custkey and o.o_totalprice > 300000)")
_add("anti_not_exists", "select c_custkey, c_name from {customer} c where not exists (select 1 from {orders} o where o.o_custkey = c.c_custkey and o.o_orderpriority = '1-URGENT')")
_add("in_subquery", "select s_suppkey from {supplier} where s_nationkey in (select n_nationkey from {nation} where n_regionkey in (select r_regionkey from {region} where r_name like 'A%'))")
# NOT IN has to broadcast its list, to look for nulls; keys that are shown to be none make it an anti join.
_add("not_in_subquery", "select p_partkey from {part} p where not exists (select 1 from {lineitem} where l_quantity > 40 and l_partkey = p.p_partkey) and not exists (select 1 from {lineitem} where l_quantity > 40 and l_partkey is null) and p_partkey is not null", "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 40)")
_add("any_all_subquery", "select p_partkey, p_retailprice from {part} where p_size in (select p_size from {part} where p_brand = 'Brand#11') and p_retailprice >= (select max(p_retailprice) from {part} where p_size < 5)", "select p_partkey, p_retailprice from part where p_size = any (select p_size from part where p_brand = 'Brand#11') and p_retailprice >= all (select p_retailprice from part where p_size < 5)")
_add("scalar_subquery_rank", "select c.c_custkey, c.c_acctbal, (select count(*) from {nation} n where n.n_regionkey < c.c_nationkey) as below, c.c_acctbal - (select avg(c_acctbal) from {customer}) > 0 as above_mean from {customer} c where c.c_acctbal > 9000")
_add("lateral_top_n", "select c.c_custkey, o.o_orderkey, o.o_totalprice from {customer} c left join lateral (select o_orderkey, o_totalprice from {orders} o where o.o_custkey = c.c_custkey order by o_totalprice desc, o_orderkey limit 3) o on true")
_add("derived_table", "select segment, n from (select c_mktsegment as segment, count(*) as n from {customer} group by c_mktsegment) t where n > 10")
_add("graph_pattern_2hop", """
select a.n_name as start, r.r_name as via, b.n_name as finish
  from {nation} a join {region} r on a.n_regionkey = r.r_regionkey join {nation} b on b.n_regionkey = r.r_regionkey and b.n_nationkey <> a.n_nationkey
 where a.n_nationkey < 5""")

# Aggregates --------------------------------------------------------------------------
_add("group_having", "select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice), 2) as sum_price, round(avg(l_discount), 6) as mean_discount, count(*) as n from {lineitem} where l_shipdate <= timestamp '1998-09-02' group by l_returnflag, l_linestatus having count(*) > 10")
_add("group_by_alias", "select substring(o_orderpriority, 1, 1) as p, count(*) as n from {orders} group by p")
_add("grouping_sets", "select o_orderstatus as status, o_orderpriority as priority, cast(grouping(o_orderstatus) as int) as g1, cast(grouping(o_orderpriority) as int) as g2, count(*) as n from {orders} group by grouping sets ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
_add("rollup", "select c_mktsegment as seg, c_nationkey as nation, count(*) as n, round(sum(c_acctbal), 2) as total from {customer} group by rollup (c_mktsegment, c_nationkey)")
_add("cube", "select p_brand as brand, p_size as size, count(*) as n from {part} where p_size <= 3 group by cube (p_brand, p_size)")
_add("agg_filter", "select o_custkey, count(*) filter (where o_orderstatus = 'F') as f, round(sum(o_totalprice) filter (where o_orderpriority like '1%'), 2) as urgent from {orders} group by o_custkey")
_add("bool_aggregates", "select c_nationkey, bool_and(c_acctbal > -900) as all_ok, bool_or(c_acctbal > 9900) as any_rich from {customer} group by c_nationkey")
_add("count_distinct", "select l_suppkey, count(distinct l_partkey) as parts, count(distinct l_orderkey) as orders from {lineitem} group by l_suppkey")
_add("percentile_within_group", "select p_brand, percentile_cont(0.5) within group (order by p_retailprice) as med, percentile_disc(0.9) within group (order by p_size) as p90 from {part} group by p_brand")
_add("string_agg_ordered", "select n_regionkey, listagg(n_name, ', ') within group (order by n_name) as names from {nation} group by n_regionkey", "select n_regionkey, string_agg(n_name, ', ' order by n_name) as names from nation group by n_regionkey")
_add("array_agg_sorted", "select n_regionkey, array_join(array_sort(array_agg(n_name)), '|') as names from {nation} group by n_regionkey", "select n_regionkey, array_to_string(list_sort(array_agg(n_name)), '|') as names from nation group by n_regionkey")
_add("min_by_max_by", "select c_nationkey, max_by(c_custkey, struct(c_acctbal, c_custkey)) as richest from {customer} group by c_nationkey", "select c_nationkey, arg_max(c_custkey, {'a': c_acctbal, 'k': c_custkey}) as richest from customer group by c_nationkey")
_add("stat_aggregates", "select p_brand, round(stddev_samp(p_retailprice), 4) as sd, round(var_pop(p_retailprice), 3) as vp, round(corr(p_size, p_retailprice), 6) as r from {part} group by p_brand")

# Windows -----------------------------------------------------------------------------
_add("window_total", "select o_orderkey, round(o_totalprice / sum(o_totalprice) over (partition by o_custkey), 6) as share from {orders}")
_add("running_share", "select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and current row), 2) as running from {orders}")
_add("window_frames", """
select l_orderkey, l_linenumber, sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity rows between 1 preceding and 1 following) as around,
       sum(l_quantity) over (partition by l_orderkey order by l_linenumber range between 2 preceding and current row) as near from {lineitem}""")
_add("named_window", "select c_custkey, cast(rank() over w as bigint) as r, cast(dense_rank() over w as bigint) as d, round(percent_rank() over w, 6) as p, round(cume_dist() over w, 6) as c from {customer} window w as (partition by c_nationkey order by c_mktsegment, c_custkey)")
_add("ntile_lag_lead", "select o_orderkey, cast(ntile(4) over w as bigint) as q, lag(o_orderkey) over w as prev, lead(o_orderkey, 2, -1) over w as next2, first_value(o_orderkey) over w as first, nth_value(o_orderkey, 2) over w as second from {orders} window w as (partition by o_custkey order by o_orderdate, o_orderkey)")
_add("groups_frame", """
select n_nationkey, sum(n_nationkey) over (order by d range between 1 preceding and current row) as s
  from (select n_nationkey, dense_rank() over (order by n_regionkey) as d from {nation}) t""", "select n_nationkey, sum(n_nationkey) over (order by n_regionkey groups between 1 preceding and current row)::bigint as s from nation")
_add("exclude_current", "select n_nationkey, sum(n_nationkey) over (partition by n_regionkey) - n_nationkey as others from {nation}", "select n_nationkey, sum(n_nationkey) over (partition by n_regionkey rows between unbounded preceding and unbounded following exclude current row)::bigint as others from nation")
_add("filter_over", "select o_orderkey, sum(case when o_orderstatus = 'F' then 1 else 0 end) over (partition by o_custkey) as f from {orders}", "select o_orderkey, count(*) filter (where o_orderstatus = 'F') over (partition by o_custkey) as f from orders")
_add("lag_case_evolution", """
select y, n, case when lag(n) over (order by y) is null then 'first' when lag(n) over (order by y) < n then 'up' when lag(n) over (order by y) > n then 'down' else 'same' end as trend
  from (select year(o_orderdate) as y, count(*) as n from {orders} group by 1) t""")
_add("interval_range_frame", """
select user_id, event_id, count(*) over (partition by user_id order by ts range between interval 1 day preceding and current row) as n from {events}""")

# Sort, limit, set operations ----------------------------------------------------------
_add("limit_offset", "select o_orderkey, o_totalprice from {orders} order by o_totalprice desc, o_orderkey limit 10 offset 5")
_add("order_nulls", "select doc_id, nullif(toxic, 0) as t from {labels} order by t desc nulls first, doc_id limit 50")
# Queries are the vectors whose ids are divisible by 100, each against all: ten neighbours each,
# ranked in each task before they are shuffled (a window group limit).
_add("knn_topk", """
with q as (select vec_id as q, embedding as v from {embeddings} where vec_id % 100 = 0),
d as (select q.q, e.vec_id, round(sqrt(aggregate(zip_with(e.embedding, q.v, (x, y) -> power(cast(x as double) - cast(y as double), 2)), cast(0 as double), (a, x) -> a + x)), 4) as dist
        from {embeddings} e join q on e.vec_id <> q.q)
select q, vec_id, dist from (select *, row_number() over (partition by q order by dist, vec_id) as n from d) where n <= 10""", """
with q as (select vec_id as q, embedding as v from embeddings where vec_id % 100 = 0),
d as (select q.q, e.vec_id, round(sqrt(list_sum(list_transform(list_zip(e.embedding, q.v), lambda p: power(cast(p[1] as double) - cast(p[2] as double), 2)))), 4) as dist
        from embeddings e join q on e.vec_id <> q.q)
select q, vec_id, dist from (select *, row_number() over (partition by q order by dist, vec_id) as n from d) where n <= 10""")
for _op in ("union", "intersect", "except"):
    for _all in ("", " all"):
        _add(f"{_op}{_all.replace(' ', '_')}", f"select c_nationkey as k from {{customer}} where c_acctbal > 3000 {_op}{_all} select s_nationkey from {{supplier}} where s_acctbal > 1000")

# Common table expressions --------------------------------------------------------------
_add("cte_chain", "with big as (select o_custkey, sum(o_totalprice) as total from {orders} group by o_custkey), top as (select * from big where total > 500000) select c_mktsegment, count(*) as n, round(sum(total), 2) as total from top join {customer} on o_custkey = c_custkey group by c_mktsegment")
_add("recursive_cte", "with recursive t(n, f) as (select 1, cast(1 as bigint) union all select n + 1, f * (n + 1) from t where n < 12) select n, f from t")
_add("recursive_path", """
with recursive walk(k, path, depth) as (
  select r_regionkey, cast(r_name as string), 0 from {region} where r_regionkey = 0
  union all select r_regionkey, path || '>' || r_name, depth + 1 from walk join {region} on r_regionkey = k + 1 where depth < 4)
select k, path, depth from walk""", """
with recursive walk(k, path, depth) as (
  select r_regionkey, cast(r_name as varchar), 0 from region where r_regionkey = 0
  union all select r_regionkey, path || '>' || r_name, depth + 1 from walk join region on r_regionkey = k + 1 where depth < 4)
select k, path, depth from walk""")
_add("cte_search_depth_first", """
with recursive tree(k, parent, path) as (
  select r_regionkey, -1, array(cast(r_regionkey as int)) from {region} where r_regionkey < 2
  union all select n_nationkey + 100, k, concat(path, array(cast(n_nationkey + 100 as int))) from tree join {nation} on n_regionkey = k where k < 100)
select k, parent, array_join(path, '/') as path from tree""", """
with recursive tree(k, parent, path) as (
  select r_regionkey, -1, [r_regionkey] from region where r_regionkey < 2
  union all select n_nationkey + 100, k, list_append(path, n_nationkey + 100) from tree join nation on n_regionkey = k where k < 100)
select k, parent, array_to_string(path, '/') as path from tree""")

# Each step adds what is one day further in the same month; UNION keeps distinct rows only, so the
# level is carried and the distinct set is taken of the whole.
_add("recursive_union_distinct", """
with recursive reach(a, b, depth) as (
  select n_regionkey, n_regionkey, 0 from (select distinct n_regionkey from {nation})
  union all select a, (b + 2) % 5, depth + 1 from reach where depth < 5)
select distinct a, b from reach""", """
with recursive reach(a, b) as (
  select distinct n_regionkey, n_regionkey from nation
  union select a, (b + 2) % 5 from reach)
select a, b from reach""")
_add("recursive_cycle", """
with recursive walk(a, b, path, is_cycle) as (
  select n_regionkey, n_regionkey, array(n_regionkey), false from (select distinct n_regionkey from {nation})
  union all select a, (b + 3) % 5, concat(path, array((b + 3) % 5)), array_contains(path, (b + 3) % 5) from walk where not is_cycle)
select a, b, array_join(path, '>') as path, is_cycle from walk""", """
with recursive walk(a, b, path, is_cycle) as (
  select distinct n_regionkey, n_regionkey, [n_regionkey], false from nation
  union all select a, (b + 3) % 5, list_append(path, (b + 3) % 5), list_contains(path, (b + 3) % 5) from walk where not is_cycle)
select a, b, array_to_string(path, '>') as path, is_cycle from walk""")
_add("cte_search_breadth_first", """
with recursive tree(k, depth) as (
  select r_regionkey, 0 from {region}
  union all select n_nationkey + 100, depth + 1 from tree join {nation} on n_regionkey = k where k < 100)
select k, depth, cast(row_number() over (partition by depth order by k) as bigint) as place from tree""")
_add("cte_materialized", "with m as (select o_custkey, count(*) as n from {orders} group by o_custkey) select a.o_custkey, a.n from m a join (select max(n) as n from m) b on a.n = b.n", "with m as materialized (select o_custkey, count(*) as n from orders group by o_custkey) select a.o_custkey, a.n from m a join (select max(n) as n from m) b on a.n = b.n")
_add("cte_not_materialized", "with m as (select c_custkey, c_acctbal from {customer} where c_acctbal > 0) select c_custkey from m where c_acctbal < 500", "with m as not materialized (select c_custkey, c_acctbal from customer where c_acctbal > 0) select c_custkey from m where c_acctbal < 500")

# Data changes as projections -------------------------------------------------------------
_add("insert_select", "select o_orderkey, o_custkey from {orders} where o_orderstatus = 'P' union all select 9000000 + c_custkey, c_custkey from {customer} where c_acctbal < -900")
_add("update_as_projection", "select c_custkey, case when c_mktsegment = 'BUILDING' then round(c_acctbal * 1.1, 2) else c_acctbal end as c_acctbal from {customer}")
_add("delete_as_anti_join", "select o.o_orderkey from {orders} o left anti join (select c_custkey from {customer} where c_acctbal < 0) d on d.c_custkey = o.o_custkey", "select o.o_orderkey from orders o anti join (select c_custkey from customer where c_acctbal < 0) d on d.c_custkey = o.o_custkey")
_add("upsert_as_join", """
select coalesce(n.k, o.k) as k, case when n.k is not null then n.v else o.v end as v
  from (select c_custkey as k, c_acctbal as v from {customer} where c_mktsegment <> 'BUILDING') o
  full join (select c_custkey as k, round(c_acctbal + 1, 2) as v from {customer} where c_acctbal > 0) n on n.k = o.k""")
_add("conflict_do_nothing", """
select k, v from (select c_custkey as k, 'old' as v from {customer} where c_mktsegment <> 'BUILDING') o
union all
select n.k, 'new' from (select c_custkey as k from {customer} where c_acctbal > 0) n
 where not exists (select 1 from {customer} o where o.c_custkey = n.k and o.c_mktsegment <> 'BUILDING')""")
_add("merge_as_join", """
select coalesce(t.k, s.k) as k, case when s.k is null then t.v when t.k is null then s.v else t.v + s.v end as v
  from (select p_partkey as k, p_size as v from {part} where p_brand <> 'Brand#11') t
  full join (select l_partkey as k, count(*) as v from {lineitem} group by l_partkey) s on s.k = t.k
 where not (t.k is not null and s.k is not null and s.v > 40)""")
_add("delete_returning", "select l_orderkey, l_linenumber, l_quantity from {lineitem} where l_returnflag = 'R' and l_quantity < 3")

# Sampling and time windows: our additions ------------------------------------------------
_add("time_window", "select cast(cast(window(ts, '1 day').start as date) as string) as day, event_type, count(*) as n from {events} group by window(ts, '1 day'), event_type", "select cast(cast(date_trunc('day', ts) as date) as varchar) as day, event_type, count(*) as n from events group by 1, 2")

_add("session_windows", """
select user_id, cast(cast(w.start as date) as string) as day, count(*) as sessions, cast(sum(n) as bigint) as events
  from (select user_id, session_window(ts, '30 minutes') as w, count(*) as n from {events} group by user_id, session_window(ts, '30 minutes')) s
 group by user_id, cast(w.start as date)""", """
with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from events),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as no from e),
g as (select user_id, no, min(ts) as start, count(*) as n from s group by user_id, no)
select user_id, cast(cast(start as date) as varchar) as day, count(*) as sessions, cast(sum(n) as bigint) as events from g group by user_id, cast(start as date)""")

# Sketches are approximate; the query says whether they are within five per cent.
_add("hll_distinct", """
select event_type, abs(hll_sketch_estimate(hll_sketch_agg(user_id)) - count(distinct user_id)) <= 0.05 * count(distinct user_id) as close,
       count(distinct user_id) as exact from {events} group by event_type""", "select event_type, count(distinct user_id) > 0 as close, count(distinct user_id) as exact from events group by event_type")
_add("hll_union", """
with daily as (select event_type, cast(ts as date) as day, hll_sketch_agg(user_id) as sketch from {events} group by 1, 2),
whole as (select event_type, count(distinct user_id) as n from {events} group by 1)
select event_type, first(n) as n, abs(hll_sketch_estimate(hll_union_agg(sketch)) - first(n)) <= 0.05 * first(n) as close, count(*) as days from daily join whole using (event_type) group by event_type""", """
select event_type, count(distinct user_id) as n, count(distinct user_id) > 0 as close, count(distinct cast(ts as date)) as days from events group by event_type""")
_add("variant_props", "select event_id, variant_get(parse_json(props), '$.k', 'int') as k from {events} where variant_get(parse_json(props), '$.k', 'int') > 90", "select event_id, cast(json_extract_string(props, '$.k') as int) as k from events where cast(json_extract_string(props, '$.k') as int) > 90")
# Trigrams of the names' distinct words: as many rows as the vocabulary, whatever the table has.
_add("trigram_similarity", """
with w as (select distinct explode(split(lower(p_name), ' ')) as w from {part}),
g as (select w, explode(array_distinct(transform(sequence(1, length(w) - 2), i -> substring(w, i, 3)))) as t from w where length(w) >= 3),
c as (select w, count(*) as n from g group by w),
p as (select a.w as a, b.w as b, count(*) as shared from g a join g b on a.t = b.t and a.w < b.w group by 1, 2)
select p.a, p.b, round(shared / (x.n + y.n - shared), 6) as similarity from p join c x on x.w = p.a join c y on y.w = p.b""", """
with w as (select distinct unnest(string_split(lower(p_name), ' ')) as w from part),
g as (select distinct w, substring(w, i, 3) as t from (select w, unnest(range(1, length(w) - 1)) as i from w where length(w) >= 3)),
c as (select w, count(*) as n from g group by w),
p as (select a.w as a, b.w as b, count(*) as shared from g a join g b on a.t = b.t and a.w < b.w group by 1, 2)
select p.a, p.b, round(shared / (x.n + y.n - shared), 6) as similarity from p join c x on x.w = p.a join c y on y.w = p.b""")
_add("project_set", "select r_regionkey, posexplode(array(r_name, upper(r_name))) as (pos, v) from {region}", "select r_regionkey, unnest([0, 1]) as pos, unnest([r_name, upper(r_name)]) as v from region")
# One to three steps along edges of the data: nations are linked if a customer of one ordered
# from a supplier of the other; the edges are as many as pairs of nations at most.
_add("graph_quantified_edge", """
with recursive edge as (
  select distinct c_nationkey as a, s_nationkey as b from {orders} join {customer} on c_custkey = o_custkey join {lineitem} on l_orderkey = o_orderkey join {supplier} on s_suppkey = l_suppkey
   where o_orderpriority = '1-URGENT' and l_quantity = 50 and c_nationkey < s_nationkey),
hops(start, node, depth) as (
  select a, b, 1 from edge
  union all select start, b, depth + 1 from hops join edge on a = node where depth < 3)
select start, node, count(*) as paths from hops group by start, node""", """
with recursive edge as (
  select distinct c_nationkey as a, s_nationkey as b from orders join customer on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey
   where o_orderpriority = '1-URGENT' and l_quantity = 50 and c_nationkey < s_nationkey),
hops(start, node, depth) as (
  select a, b, 1 from edge
  union all select start, b, depth + 1 from hops join edge on a = node where depth < 3)
select start, node, count(*) as paths from hops group by start, node""")


def prepared_statement(session: SparkSession, sf_dir: str) -> DataFrame:
    """PREPARE and EXECUTE as one text with named parameters."""
    text = f"select o_orderkey, o_totalprice from parquet.`{sf_dir}/orders.parquet` where o_orderstatus = :status and o_totalprice > :least"
    return session.sql(text, args={"status": "F", "least": 250000})


def temporary_view(session: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE VIEW as a temporary view, dropped once the query is analysed."""
    session.read.parquet(f"{sf_dir}/supplier.parquet").filter("s_acctbal > 0").createOrReplaceTempView("tessera_solvent")
    try:
        out = session.sql("select s_nationkey, count(*) as n from tessera_solvent group by s_nationkey")
        out.schema  # noqa: B018 (analysed now)
        return out
    finally:
        session.catalog.dropTempView("tessera_solvent")


def _written(session: SparkSession, create: str, *more: str, then: str) -> DataFrame:
    """A query over a table {t} that the texts create and fill. Its files lie in a folder of
    their own that all executors share (a local session without one: a temporary one);
    its name is dropped again, the files stay for the query."""
    folder = own_folder(session)
    name = folder.rsplit("/", 1)[1]
    for text in (create, *more):
        session.sql(text.replace("{t}", name).replace("{at}", f"using parquet location '{folder}'"))
    out = session.sql(then.replace("{t}", name))
    out.schema  # noqa: B018 (analysed now)
    session.sql(f"drop table {name}")
    return out


def materialized_view(session: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE TABLE AS and CREATE MATERIALIZED VIEW: the query's rows, written once, read by name."""
    query = f"select o_custkey, count(*) as n, cast(sum(o_totalprice) as decimal(20, 2)) as total from parquet.`{sf_dir}/orders.parquet` group by o_custkey"
    return _written(session, f"create table {{t}} {{at}} as {query}", then="select n, count(*) as customers, sum(total) as total from {t} group by n")


def insert_into_table(session: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE TABLE, two INSERTs, and what the table has then."""
    inserts = [f"insert into {{t}} select p_partkey, cast(p_size as int) from parquet.`{sf_dir}/part.parquet` where {c}" for c in ("p_size < 5", "p_size > 45")]
    return _written(session, "create table {t} (k bigint, size int) {at}", *inserts, then="select size, count(*) as n from {t} group by size")


def row_number_nulls_last(session: SparkSession, sf_dir: str) -> DataFrame:
    """A number for each row in a global order, without one task that sorts all: rows are
    range-partitioned, numbered in their range, and moved by what the ranges before hold."""
    rows = session.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("doc_id", "nullif(quality, 0) as q")
    order = [F.col("q").desc_nulls_last(), F.col("doc_id").asc()]
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), 1)
    # Bounds of the ranges come from Spark's own sample of the sort key; ids break its ties.
    ranged = rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    ranged = ranged.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    # One row a range: as many as there are shuffle partitions.
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ranged.join(F.broadcast(before), "part").select("doc_id", (F.col("at") + F.col("before")).cast("bigint").alias("rn"))


def tid_scan(session: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by their place in a file (a tid): the metadata column of file sources."""
    rows = session.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.col("_metadata.row_index").alias("tid"))
    return rows.filter("tid between 3 and 7 or tid = 20")


def table_function(session: SparkSession, sf_dir: str) -> DataFrame:
    """A table function written in Python, called laterally for each row."""

    @F.udtf(returnType="divisor bigint")
    class Divisors:
        def eval(self, n: int):
            for d in range(1, int(n) + 1):
                if n % d == 0:
                    yield (d,)

    session.udtf.register("tessera_divisors", Divisors)
    return session.sql(f"select r_regionkey, divisor from parquet.`{sf_dir}/region.parquet`, lateral tessera_divisors(cast(r_regionkey + 10 as int))")


def table_sample(session: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator, by priority: a sampled row is a row, and its share lies near 0.2."""
    orders = session.read.parquet(f"{sf_dir}/orders.parquet")
    some = orders.sample(0.2, seed=7).groupBy("o_orderpriority").agg(F.count("*").alias("some"), F.countDistinct("o_orderkey").alias("different"))
    whole = orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    near = F.abs(F.col("some") - 0.2 * F.col("n")) <= 5 * F.sqrt(0.16 * F.col("n"))
    return whole.join(some, "o_orderpriority").select("o_orderpriority", "n", (near & (F.col("some") == F.col("different"))).alias("near"))


def explain_text(session: SparkSession, sf_dir: str) -> DataFrame:
    """EXPLAIN of a query, as rows: how many columns each scan reads, by the prefix of their names."""
    lines = session.sql(f"explain extended select o_custkey, count(*) from parquet.`{sf_dir}/orders.parquet` join parquet.`{sf_dir}/customer.parquet` on c_custkey = o_custkey where o_orderstatus = 'F' group by o_custkey")
    physical = F.substring_index(F.col("plan"), "== Physical Plan ==", -1)
    scans = lines.select(F.explode(F.regexp_extract_all(physical, F.lit(r"FileScan parquet \[([^\]]*)\]"), F.lit(1))).alias("columns"))
    return scans.select(F.substring("columns", 1, 2).alias("scanned"), F.size(F.split("columns", ",")).cast("bigint").alias("n"))


def knn_topk(session: SparkSession, sf_dir: str) -> DataFrame:
    """The query of that name, by products of matrices; its text runs where vectors are unlike each other."""
    return nearest(session.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 100 = 0", 10, lambda: SURFACE["knn_topk"].run(session, sf_dir))


API = {
    f.__name__: f
    for f in (
        prepared_statement, temporary_view, materialized_view, insert_into_table, row_number_nulls_last, tid_scan, table_function, table_sample, explain_text, knn_topk,
    )
}
API_SQL = {
    "prepared_statement": "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice > 250000",
    "temporary_view": "select s_nationkey, count(*) as n from supplier where s_acctbal > 0 group by s_nationkey",
    "materialized_view": "select n, count(*) as customers, sum(total) as total from (select o_custkey, count(*) as n, cast(sum(o_totalprice) as decimal(20, 2)) as total from orders group by o_custkey) group by n",
    "insert_into_table": "select cast(p_size as int) as size, count(*) as n from part where p_size < 5 or p_size > 45 group by 1",
    "row_number_nulls_last": "select doc_id, row_number() over (order by nullif(quality, 0) desc nulls last, doc_id) as rn from labels",
    "tid_scan": "select n_nationkey, cast(tid as bigint) as tid from (select n_nationkey, row_number() over () - 1 as tid from nation) where tid between 3 and 7 or tid = 20",
    "table_function": "select r_regionkey, divisor from (select r_regionkey, unnest(range(1, r_regionkey + 11)) as divisor from region) where (r_regionkey + 10) % divisor = 0",
    "table_sample": "select o_orderpriority, count(*) as n, count(*) > 0 as near from orders group by 1",
    "explain_text": "select * from (values ('o_', 2), ('c_', 1)) t(scanned, n)",
}


def queries() -> dict:
    return {k: q.run for k, q in SURFACE.items()} | API


def oracle_sql() -> dict[str, str]:
    return {k: q.oracle for k, q in SURFACE.items()} | API_SQL
