import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions import layout, lexer, sql
from tessera.sources import files
from tessera.streaming import text as streams


def kinds(text):
    return [(t.kind, t.text) for t in lexer.lex(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("'it''s'", [("string", "'it''s'")]),
        ("E'it\\'s'", [("string", "E'it\\'s'")]),
        ("U&'x' b'01'", [("string", "U&'x'"), ("string", "b'01'")]),
        ('"a""b"', [("ident", '"a""b"')]),
        ("$tag$ $$ 'x' $tag$", [("dollar_string", "$tag$ $$ 'x' $tag$")]),
        ("$1 :name :'name'", [("param", "$1"), ("param", ":name"), ("param", ":'name'")]),
        ("/* a /* b */ c */ 1", [("block_comment", "/* a /* b */ c */"), ("number", "1")]),
        ("a<->b", [("ident", "a"), ("operator", "<->"), ("ident", "b")]),
        ("x#>>y", [("ident", "x"), ("operator", "#>>"), ("ident", "y")]),
        ("1.5e-3 7e", [("number", "1.5e-3"), ("number", "7"), ("ident", "e")]),
        ("été$1", [("ident", "été$1")]),
        ("\\set x 1\nselect", [("backslash_cmd", "\\set x 1"), ("keyword", "select")]),
        ("a := 1", [("ident", "a"), ("operator", ":="), ("number", "1")]),
    ],
)
def test_tokens(text, want):
    assert kinds(text) == want


@pytest.mark.parametrize("text", ["'open", '"open', "$$ open", "/* open /* */", "select $a$ x $b$"])
def test_lex_errors(text):
    with pytest.raises(lexer.LexError, match="unterminated .* at line 1"):
        lexer.lex(text)


def test_places_and_blank_lines():
    tokens = lexer.lex("é a\n\n  b")
    assert [(t.line, t.col, t.blank_before) for t in tokens] == [(1, 0, False), (1, 3, False), (3, 2, True)]


def test_comments_hang_on_tokens():
    tokens, rest = lexer.attach(lexer.lex("-- lead\nselect 1 -- trail\n, 2; -- end\n-- last"))
    assert tokens[0].comments[0].text == "-- lead" and tokens[1].trailing.text == "-- trail"
    assert rest[-1].text == "-- last"


def test_statements_and_kinds():
    tokens, _ = lexer.attach(lexer.lex("select (1;2); create or replace function f() returns int; \\x\nalter table t add a int; (select 1)"))
    assert [lexer.statement_kind(s) for s in lexer.statements(tokens)] == ["query", "create function", "psql", "alter table", "query"]


def test_dollar_split():
    assert lexer.split_dollar_quoted("$f$ x $f$") == ("$f$", " x ")
    assert lexer.split_dollar_quoted("$f$ x $g$") is None


LAYOUTS = [
    ("select 1;", "select 1;\n"),
    ("SELECT * FROM races LIMIT 1;", "select * from races limit 1;\n"),
    ("select a, b from t;", "select a, b\n  from t;\n"),
    ("select a from t join u using (id) group by a;", "  select a\n    from t\n    join u using(id)\ngroup by a;\n"),
    ("select a from t left join u on u.x = t.x and u.y = 1;", "     select a\n       from t\n  left join u\n         on u.x = t.x\n        and u.y = 1;\n"),
    ("select a, b from t where x between 1 and 2 and y = 3 or z is null;", "select a, b\n  from t\n where x between 1 and 2\n   and y = 3\n    or z is null;\n"),
    ("with a as (select 1 as x) select x from a;", "with a as (\n  select 1 as x\n)\nselect x from a;\n"),
    ("select 1 union all select 2;", "select 1\nunion all\nselect 2;\n"),
    ("insert into t(a, b) values (1, 2) on conflict (a) do nothing returning a;", "insert into t(a, b) values (1, 2) on conflict (a) do nothing returning a;\n"),
    ("update t set a = 1, b = 2 where c = 3;", "update t set a = 1, b = 2 where c = 3;\n"),
    ("create table t (id int primary key, name text not null, unique (name));", "create table t\n (\n  id   int primary key,\n  name text not null,\n\n  unique (name)\n);\n"),
    ("select a::int, -1, b - -1, array[1,2], f(x) filter (where y);", "select a::int, -1, b - -1, array[1, 2], f(x) filter(where y);\n"),
    ("begin;\nselect 1;\ncommit;", "begin;\n\nselect 1;\n\ncommit;\n"),
    ("\\set x 1\nselect 1;", "\\set x 1\n\nselect 1;\n"),
    ("select a from t for update skip locked;", "select a from t for update skip locked;\n"),
    ("select d, count(*) over (partition by d) from t;", "select d, count(*) over(partition by d)\n  from t;\n"),
    ("", ""),
]


@pytest.mark.parametrize("text, want", LAYOUTS)
def test_layout(text, want):
    assert layout.format_sql(text) == want


LONG = [
    "select season, count(*) filter(where milliseconds is null and position is null) as dnfs, percentile_cont(array[0.5, 0.9, 0.95, 0.99]) within group (order by cts - ats) as parr from r",
    "grant select (invoice_id, customer_id, invoice_date, address, city, state, country, code) on invoices to reader, another_reader",
    "alter default privileges in schema chinook grant select, insert, update, delete on tables to chinook_rw, another_one",
    "create table p partition of some_schema.some_partitioned_table for values from (2022) to (2023) partition by hash (x)",
    "select a from t where exists (select 1 from some_long_table_name x where x.some_column = t.some_column and x.other > 5 and x.third < 9)",
    "select case when aaaaaaaaaaaaaaaaaaaaaa = 1 then 'bbbbbbbbbbbbbbbbbbbbbb' when ccccccccccccc then 'ddddddddddd' else 'e' end as f from t",
    "select row_number() over (partition by aaaaaaaaaaaaaaaaaaaaa, bbbbbbbbbbbbbbbbb order by cccccccccccccc desc nulls last rows between 1 preceding and current row) from t",
    "merge into t using s on t.id = s.id when matched and s.x > 1 then update set a = s.a when not matched then insert (id) values (s.id)",
    "create or replace function f(a int) returns int as $$ begin if a > 1 then return 1; else return 2; end if; end; $$ language plpgsql",
    "create trigger tr after insert or update on t for each row execute procedure f('x')",
    "select * from graph_table (g match (a is person)-[e is knows]->(b is person) columns (a.name as n, b.name as m))",
    "select a -- first\n, b /* second */ from t -- third\nwhere x = 1 -- fourth",
    "with recursive t(n) as (select 1 union all select n + 1 from t where n < 5) select n from t",
    "alter table some_schema.some_table add column first_column integer not null, drop column second_column cascade, rename to other",
    "explain (analyze, buffers) select a, b from t where c = 1",
    "prepare p as select a, b from t order by a",
    "select count(*) from a, lateral f(a.x) as y(z) left join lateral (select 1 from cccccccccccccccccccccccccccccccccccc where ddddddddd = a.x limit 3) q on true",
]


@pytest.mark.parametrize("text", LONG + [t for t, _ in LAYOUTS])
def test_layout_is_stable_and_keeps_words_and_comments(text):
    once = layout.format_sql(text)
    assert layout.format_sql(once) == once
    if "$$" not in text:
        assert sorted(layout.squash(text)) == sorted(layout.squash(once))
    n = lambda s: sum(t.kind.endswith("_comment") for t in lexer.lex(s))
    assert n(text) <= n(once)
    if "graph_table" not in text and "'" not in text:
        assert max(map(len, once.split("\n"))) <= 80


WORDS = st.sampled_from("select from where and or ( ) , ; a b.c 1 'x' = + - case when then else end join on using group by order union all with as insert into values set update over partition -- /*c*/ [ ] :: not in exists between limit".split())


@settings(max_examples=300, deadline=None)
@given(st.lists(WORDS, max_size=25))
def test_any_words_are_laid_out_without_loss(words):
    text = " ".join(w + "\n" if w == "--" else w for w in words)
    once = layout.format_sql(text)
    assert sorted(layout.squash(text)) == sorted(layout.squash(once))


def test_plpgsql_blocks():
    lines, ok = layout.plpgsql_lines("begin for i in 1..3 loop perform f(i); end loop; exception when others then null; end;")
    assert ok and lines == ["begin", "  for i in 1..3 loop", "    perform f(i);", "  end loop;", "exception", "  when others then", "    null;", "end;"]
    assert layout.plpgsql_lines("begin if x then")[1] is False


def test_columns_and_registered_functions(spark):
    rows = spark.createDataFrame([(1, "SELECT 1"), (2, "'open"), (3, None), (4, "select 1\n")], "path bigint, text string")
    got = {r.path: (r.output, r.error, r.changed) for r in sql.format_corpus(rows).collect()}
    assert got[1] == ("select 1\n", None, True) and got[2][1].startswith("unterminated") and got[3] == (None, None, None) and got[4][2] is False
    sql.register(spark)
    assert spark.sql("select format_sql('SELECT 2') s").first().s == "select 2\n"
    assert sql.sql_tokens(rows).filter("path = 1").count() == 2
    assert {(r.stmt_no, r.token) for r in sql.native_token_rows(spark.createDataFrame([(1, "a;b")], "path bigint, text string")).collect()} == {(0, "a"), (0, ";"), (1, "b")}


def test_native_lexer_equals_exact_one_on_regular_text(spark):
    text = "select a.b, 'x', \"Q\" from t where c >= 1.5 and d <> 2 -- note"
    rows = spark.createDataFrame([(text,)], "t string").select(lexer.native_tokens("t").alias("n")).first().n
    assert rows == [t.text for t in lexer.lex(text)]


def test_sources_and_stream(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / ".hidden").mkdir()
    (tmp_path / "in" / "a.sql").write_text("SELECT\n1;\n")
    (tmp_path / "in" / "sub" / "b.sql").write_text("select 1;\n")
    (tmp_path / "in" / ".hidden" / "c.sql").write_text("select 1;\n")
    (tmp_path / "in" / "d.txt").write_text("no")
    found = files.read_sql_files(spark, str(tmp_path / "in"))
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.sql", "b.sql"]
    changed = files.changed_files(found).collect()
    assert len(changed) == 1 and "-SELECT" in changed[0].diff
    files.write_formatted(found, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    stream = streams.format_stream(files.stream_sql_files(spark, str(tmp_path / "in")))
    streams.to_folder(stream, str(tmp_path / "s"), str(tmp_path / "c")).start().awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "s")).filter("error is null").count() >= 2
