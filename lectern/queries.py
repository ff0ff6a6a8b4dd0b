"""Registered audit queries over the driver's tables, each with its SQL counterpart.

Every query applies kernels that the rules use (see ``operators.kernels``) to whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import patterns
from .functions import text as tx
from .operators import kernels as k
from .sources.pages import page_facts
from .sources.shared import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LANG = patterns.LANGUAGE
EMAIL = r"([A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+)"
_WS = r"[ \t\r\n]+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


_BODY = r"regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g')"
_PLAIN = "trim(regexp_replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))"
_TITLE = _PLAIN.format(f"regexp_extract({_BODY}, '(?is)<title>(.*?)</title>', 1)")
_H1 = _PLAIN.format(f"regexp_extract({_BODY}, '(?is)<h1>(.*?)</h1>', 1)")


def _title_problem(title: Column) -> Column:
    low = F.lower(title)
    return (
        F.when(title == "", "missing")
        .when(low.rlike(patterns.FILE_ENDING), "file name")
        .when(~title.contains(" ") & title.contains("_"), "file name")
        .when(low.rlike(patterns.WINDOW_TITLE), "window title")
        .when(low.isin(*patterns.NO_TITLE), "placeholder")
        .when(title.rlike(patterns.DATE), "date")
        .when(title.rlike(r"^\p{Ll}") & title.rlike(patterns.FRAGMENT_END), "fragment")
        .when(F.length(title) > 200, "too long")
    )


_TITLE_CASE = rf"""case when title = '' then 'missing'
  when regexp_matches(lower(title), '{patterns.FILE_ENDING}') then 'file name'
  when not contains(title, ' ') and contains(title, '_') then 'file name'
  when regexp_matches(lower(title), '{patterns.WINDOW_TITLE}') then 'window title'
  when lower(title) in {patterns.NO_TITLE} then 'placeholder'
  when regexp_matches(title, '{patterns.DATE}') then 'date'
  when regexp_matches(title, '^\p{{Ll}}') and regexp_matches(title, '{patterns.FRAGMENT_END}') then 'fragment'
  when length(title) > 200 then 'too long' end"""


def page_findings(pages: DataFrame) -> DataFrame:
    """page_id, rule, severity, count of everything wrong with each page."""
    f = page_facts(pages)
    skipped = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.size("headings")), lambda i: F.when(i > 1, F.element_at("headings", i).cast("int") - F.element_at("headings", i - 1).cast("int") > 1).otherwise(F.lit(False))), lambda x: x))
    empty_links = F.size(F.filter("links", lambda x: x == ""))
    n = lambda c: F.when(c, 1).otherwise(0)
    rules = [
        ("DOC-013", "error", n(F.col("lang") == "")),
        ("DOC-014", "warning", n((F.col("lang") != "") & ~F.col("lang").rlike(LANG))),
        ("DOC-010", "error", n(F.col("title") == "")),
        ("DOC-015", "warning", n((F.col("title") != "") & (F.col("h1") != "") & (F.lower("title") != F.lower("h1")))),
        ("DOC-040", "warning", n((F.col("title") != "") & _title_problem(F.col("title")).isNotNull())),
        ("HDG-001", "error", F.when(F.size("headings") > 1, skipped).otherwise(0)),
        ("HDG-002", "error", n(F.coalesce(F.get("headings", F.lit(0)).cast("int") > 1, F.lit(False)))),
        ("LNK-003", "error", empty_links),
    ]
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), c.cast("long").alias("count")) for r, s, c in rules])
    return f.select("page_id", F.explode(F.filter(each, lambda x: x["count"] > 0)).alias("f")).select("page_id", "f.*")


@query(rf"""
with f as (select page_id, coalesce(regexp_extract(html, '<html[^>]* lang="([^"]*)"', 1), '') lang, {_TITLE} title, {_H1} h1,
       regexp_extract_all({_BODY}, '<h([1-6])[ >]', 1) hs,
       list_transform(regexp_extract_all({_BODY}, '(?is)<a\b[^>]*>(.*?)</a>', 1), lambda x: {_PLAIN.format('x')}) links from pages),
n as (select page_id,
       (lang = '')::int + (title = '')::int + coalesce((hs[1]::int > 1)::int, 0)
         + coalesce(len(list_filter(range(2, len(hs) + 1), lambda i: hs[i]::int - hs[i - 1]::int > 1)), 0) + len(list_filter(links, lambda x: x = '')) errors,
       (lang <> '' and not regexp_matches(lang, '{LANG}'))::int + (title <> '' and h1 <> '' and lower(title) <> lower(h1))::int
         + (title <> '' and ({_TITLE_CASE}) is not null)::int warnings from f)
select page_id, errors::bigint errors, warnings::bigint warnings, case when errors > 0 then 'fail' when warnings > 0 then 'review' else 'pass' end verdict from n""")
def page_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the page audit's findings rolled up to verdicts, one row a page."""
    pages = _table(spark, sf_dir, "pages")
    by = page_findings(pages).groupBy("page_id").agg(
        F.sum(F.when(F.col("severity") == "error", F.col("count")).otherwise(0)).alias("errors"),
        F.sum(F.when(F.col("severity") == "warning", F.col("count")).otherwise(0)).alias("warnings"),
    )
    joined = pages.select("page_id").join(by, "page_id", "left")
    e, w = F.coalesce("errors", F.lit(0)).cast("long"), F.coalesce("warnings", F.lit(0)).cast("long")
    return joined.select("page_id", e.alias("errors"), w.alias("warnings"), k.verdict(e, w).alias("verdict"))


@query(f"""select page_id, coalesce(regexp_extract(html, '<html[^>]* lang="([^"]*)"', 1), '') lang,
  regexp_matches(coalesce(regexp_extract(html, '<html[^>]* lang="([^"]*)"', 1), ''), '{LANG}') wellformed from pages""")
def lang_wellformed(spark, sf_dir):
    lang = F.coalesce(F.regexp_extract("html", r'<html[^>]* lang="([^"]*)"', 1), F.lit(""))
    return _table(spark, sf_dir, "pages").select("page_id", lang.alias("lang"), lang.rlike(LANG).alias("wellformed"))


@query(f"select page_id, title, coalesce({_TITLE_CASE}, 'good') problem from (select page_id, {_TITLE} title from pages)")
def title_quality(spark, sf_dir):
    f = page_facts(_table(spark, sf_dir, "pages"))
    return f.select("page_id", "title", F.coalesce(_title_problem(F.col("title")), F.lit("good")).alias("problem"))


@query(f"select (lower(t) = lower(h)) agree, count(*) n from (select {_TITLE} t, {_H1} h from pages) group by 1")
def titles_agree(spark, sf_dir):
    f = page_facts(_table(spark, sf_dir, "pages"))
    return f.groupBy((F.lower("title") == F.lower("h1")).alias("agree")).agg(F.count("*").alias("n"))


@query(rf"""select page_id, len(regexp_extract_all(b, '<h([1-6])[ >]', 1))::int headings, len(regexp_extract_all(b, '(?is)<a\b[^>]*>(.*?)</a>', 1))::int links,
  len(regexp_extract_all(b, '(<p[ >])', 1))::int paragraphs, len(regexp_extract_all(b, '(<li[ >])', 1))::int items,
  len(regexp_extract_all(b, '(<ul[ >])', 1))::int lists from (select page_id, {_BODY} b from pages)""")
def structure_counts(spark, sf_dir):
    f = page_facts(_table(spark, sf_dir, "pages"))
    return f.select("page_id", F.size("headings").alias("headings"), F.size("links").alias("links"), F.col("n_paragraphs").alias("paragraphs"), F.col("n_items").alias("items"), F.col("n_lists").alias("lists"))


@query(rf"""select page_id, len(l)::int n_links, len(list_filter(l, lambda x: x = ''))::int n_blank from (
  select page_id, list_transform(regexp_extract_all({_BODY}, '(?is)<a\b[^>]*>(.*?)</a>', 1), lambda x: {_PLAIN.format('x')}) l from pages)""")
def link_elements(spark, sf_dir):
    f = page_facts(_table(spark, sf_dir, "pages"))
    return f.select("page_id", F.size("links").alias("n_links"), F.size(F.filter("links", lambda x: x == "")).alias("n_blank"))


@query(r"""with l as (select doc_id, trim(regexp_replace(regexp_replace(lower(unnest(string_split(text, chr(10)))), '\p{Nd}+', '', 'g'), '[\s\x1c-\x1f\x{85}\x{a0}]+', ' ', 'g')) k from documents)
select k line_key, count(distinct doc_id) n_docs from l where length(k) >= 4 group by 1 having count(distinct doc_id) >= 3""")
def furniture_lines(spark, sf_dir):
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    keyed = lines.select("doc_id", tx.furniture_key(F.col("line")).alias("line_key")).where(F.length("line_key") >= 4)
    return k.recurring(keyed, [], "line_key", "doc_id", F.lit(3)).withColumnRenamed("n_pages", "n_docs")


@query(r"""select w word, count(*) n from (select unnest(regexp_extract_all(text, '[\p{L}\p{Nl}\p{No}]{2,}')) w from documents) group by 1""")
def word_counts(spark, sf_dir):
    w = _table(spark, sf_dir, "documents").select(F.explode(tx.words(F.col("text"))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n"))


@query(rf"""with a as (select distinct doc_id, unnest(regexp_extract_all(text, '{EMAIL}', 1)) address from documents),
  l as (select distinct unnest(regexp_extract_all(html, 'href="mailto:{EMAIL}"', 1)) address from pages)
  select doc_id, count(*) n_addresses, min(address) first_address from a anti join l using (address) group by 1""")
def unlinked_addresses(spark, sf_dir):
    found = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(EMAIL), F.lit(1))).alias("address")).distinct()
    linked = _table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(f'href="mailto:{EMAIL}"'), F.lit(1))).alias("address")).distinct()
    return found.join(linked, "address", "left_anti").groupBy("doc_id").agg(F.count("*").alias("n_addresses"), F.min("address").alias("first_address"))


@query("select l_orderkey, l_linenumber, count(*) n from lineitem group by 1, 2 having count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query(r"""with a as (select item_id, lower(w) w, count(*) n from (select item_id, unnest(regexp_extract_all(text, '[\p{L}\p{Nl}\p{No}]{2,}')) w from benchmark) where length(w) >= 3 group by 1, 2),
  b as (select doc_id item_id, lower(w) w, count(*) n from (select doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{Nl}\p{No}]{2,}')) w from documents) where length(w) >= 3 group by 1, 2)
  select item_id, sum(a.n)::bigint total, sum(greatest(a.n - coalesce(b.n, 0), 0))::bigint lost from a left join b using (item_id, w) group by 1""")
def text_fidelity(spark, sf_dir):
    cut = lambda df, key: df.select(F.col(key).alias("item_id"), F.explode(tx.words(F.col("text"))).alias("w")).where(F.length("w") >= 3).withColumn("w", F.lower("w"))
    items = _table(spark, sf_dir, "benchmark")
    partners = _table(spark, sf_dir, "documents").join(items.select(F.col("item_id").alias("doc_id")), "doc_id", "left_semi")
    return k.multiset_loss(cut(items, "item_id"), cut(partners, "doc_id"), ["item_id"], "w")


@query("""with l as (select user_id, ts, event_id, floor(value / 50)::int lv from events), p as (select *, lag(lv) over (partition by user_id order by ts, event_id) pv from l)
  select user_id, count(*) n_jumps, min(event_id) first_event from p where lv > pv + 1 group by 1""")
def skipped_levels(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.floor(F.col("value") / 50).cast("int").alias("level"))
    return k.jumps(e, ["user_id"], [F.col("ts"), F.col("event_id")], "level").groupBy("user_id").agg(F.count("*").alias("n_jumps"), F.min("event_id").alias("first_event"))


@query("""select user_id, event_id, floor(value / 50)::int lv from (select *, row_number() over (partition by user_id order by ts, event_id) r from events) where r = 1 and floor(value / 50) > 1""")
def first_level(spark, sf_dir):
    first = k.first_rows(_table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")])
    return first.select("user_id", "event_id", F.floor(F.col("value") / 50).cast("int").alias("lv")).where("lv > 1")


@query("""with p as (select *, lag(ts) over (partition by user_id order by ts, event_id) pt from events),
  s as (select *, sum(case when pt is null or ts - pt > interval 6 hour then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint session from p)
  select user_id, session, count(*) n_events, min(ts) first_ts, max(ts) last_ts from s group by 1, 2""")
def session_runs(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _table(spark, sf_dir, "events").withColumn("before", F.lag("ts").over(w))
    s = k.islands(e, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("ts") - F.col("before") > F.expr("interval 6 hours"), "session")
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""with i as (select l_orderkey, l_partkey, l_linenumber, l_suppkey, (l_extendedprice * 100)::bigint y, (l_quantity * 1000)::bigint h from lineitem),
  p as (select *, lag(y) over (partition by l_orderkey order by y desc, l_partkey, l_linenumber, l_suppkey, h) py from i),
  s as (select *, sum(case when py is null or py - y > h * 50 then 1 else 0 end) over (partition by l_orderkey order by y desc, l_partkey, l_linenumber, l_suppkey, h rows unbounded preceding)::bigint band from p)
  select l_orderkey, band, count(*) n_items, min(y) low, max(y) high from s group by 1, 2""")
def band_lines(spark, sf_dir):
    """Lines of items whose heights are close to their neighbour's, as text runs are put into lines."""
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("y"), F.round(F.col("l_quantity") * 1000).cast("long").alias("h"))
    order = [F.col("y").desc(), F.col("l_partkey"), F.col("l_linenumber"), F.col("l_suppkey"), F.col("h")]
    before = items.withColumn("before", F.lag("y").over(Window.partitionBy("l_orderkey").orderBy(*order)))
    s = k.islands(before, ["l_orderkey"], order, F.col("before") - F.col("y") > F.col("h") * 50, "band")
    return s.groupBy("l_orderkey", "band").agg(F.count("*").alias("n_items"), F.min("y").alias("low"), F.max("y").alias("high"))


@query("select conv_id, string_agg(text, ' ' order by turn, role, text) as text from conversations where text is not null group by 1")
def ordered_text(spark, sf_dir):
    return k.ordered_text(_table(spark, sf_dir, "conversations").where("text is not null"), ["conv_id"], ["turn", "role", "text"], "text")


@query("""with leaf as (select r_regionkey, n_nationkey, row_number() over (order by r_regionkey, n_nationkey) rn from nation join region on n_regionkey = r_regionkey),
  nd as (select rn + r_regionkey + 1 ord, rn + r_regionkey + 1 subtree_end, n_nationkey, r_regionkey from leaf),
  rg as (select r_regionkey, min(ord) - 1 ord, max(ord) subtree_end from nd group by 1),
  bal as (select c_nationkey, count(*) n, sum((c_acctbal * 100)::bigint)::bigint cents from customer group by 1)
  select rg.r_regionkey::int region, count(*) n_nodes, sum(bal.n)::bigint n_customers, sum(bal.cents)::bigint cents from rg join nd on nd.ord between rg.ord and rg.subtree_end join bal on bal.c_nationkey = nd.n_nationkey group by 1""")
def subtree_ranges(spark, sf_dir):
    """Customers below each region, with the tree as pre-order ranges."""
    leaf = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    per_region = leaf.groupBy("r_regionkey").agg(F.count("*").alias("n"))
    before = per_region.withColumn("first", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("r_regionkey")) - F.col("n") + F.col("r_regionkey") + 1)  # regions: a handful
    regions = before.select(F.lit(0).alias("doc_id"), "r_regionkey", F.col("first").alias("ord"), (F.col("first") + F.col("n")).alias("subtree_end"))
    place = F.row_number().over(Window.partitionBy("r_regionkey").orderBy("n_nationkey"))
    nodes = leaf.select("r_regionkey", "n_nationkey", place.alias("p")).join(before.select("r_regionkey", "first"), "r_regionkey").select(F.lit(0).alias("doc_id"), (F.col("first") + F.col("p")).alias("ord"), "n_nationkey")
    held = _table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"))
    return k.subtree(regions, nodes.join(held, F.col("n_nationkey") == F.col("c_nationkey"))).groupBy(F.col("a_r_regionkey").cast("int").alias("region")).agg(F.count("*").alias("n_nodes"), F.sum("n").alias("n_customers"), F.sum("cents").alias("cents"))


@query("""with recursive m as (select n_nationkey a, (n_nationkey * 7 + n_regionkey) % 25 b from nation),
  c(a, b, d) as (select a, b, 1 from m union all select c.a, m.b, d + 1 from c join m on c.b = m.a where d < 25 and c.b <> c.a)
  select a::int nation, max(d)::int steps, bool_or(b = a) circular from c group by 1""")
def role_chain(spark, sf_dir):
    """Chains of a mapping followed to their end or back to their start."""
    _table(spark, sf_dir, "nation").createOrReplaceTempView("lectern_nation")
    return spark.sql("""with recursive m as (select n_nationkey a, (n_nationkey * 7 + n_regionkey) % 25 b from lectern_nation),
      c(a, b, d) as (select a, b, 1 from m union all select c.a, m.b, d + 1 from c join m on c.b = m.a where d < 25 and c.b <> c.a)
      select cast(a as int) nation, cast(max(d) as int) steps, bool_or(b = a) circular from c group by 1""")


@query("select c_custkey, c_mktsegment from customer anti join (select o_custkey from orders where o_orderpriority = '1-URGENT') on o_custkey = c_custkey")
def orphans(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(orders, "c_custkey", "left_anti")


@query("select o_orderkey, o_orderpriority from orders semi join (select l_orderkey from lineitem where l_returnflag = 'R') on l_orderkey = o_orderkey")
def owned(spark, sf_dir):
    back = _table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(back, "o_orderkey", "left_semi")


@query("select l_orderkey, min(l_quantity) x0, min(l_extendedprice) y0, max(l_quantity) x1, max(l_extendedprice) y1 from lineitem group by 1")
def bbox_union(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").alias("x0"), F.min("l_extendedprice").alias("y0"), F.max("l_quantity").alias("x1"), F.max("l_extendedprice").alias("y1"))


@query("""with i as (select l_orderkey k, l_partkey p, l_linenumber n, l_suppkey s, l_quantity a, l_quantity + l_discount * 100 b from lineitem)
  select x.k l_orderkey, count(*) n_overlaps from i x join i y on x.k = y.k and (x.p, x.n, x.s) < (y.p, y.n, y.s) and x.b > y.a and x.a < y.b group by 1""")
def rect_overlap(spark, sf_dir):
    i = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_partkey", "l_linenumber", "l_suppkey").alias("id"), F.col("l_quantity").alias("a"), (F.col("l_quantity") + F.col("l_discount") * 100).alias("b"))
    j = i.select("l_orderkey", F.col("id").alias("id2"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    met = i.join(j, "l_orderkey").where((F.col("id") < F.col("id2")) & k.overlaps(F.col("a"), F.col("b"), F.col("a2"), F.col("b2")))
    return met.groupBy("l_orderkey").agg(F.count("*").alias("n_overlaps"))


@query("""with w as (select o_custkey, o_orderkey, count(l_orderkey) width from orders left join lineitem on l_orderkey = o_orderkey group by 1, 2)
  select o_custkey, count(*) n_rows, min(width) narrowest, max(width) widest from w group by 1 having count(*) > 1 and min(width) <> max(width)""")
def irregular_grid(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    rows = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(lines, "o_orderkey", "left").groupBy("o_custkey", "o_orderkey").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("width"))
    return rows.groupBy("o_custkey").agg(F.count("*").alias("n_rows"), F.min("width").alias("narrowest"), F.max("width").alias("widest")).where("n_rows > 1 and narrowest <> widest")


@query("""select user_id, count(*) n_cells, count_if(value < 60) n_empty from events group by 1 having count(*) >= 6 and count_if(value < 60) * 10 > count(*) * 6""")
def mostly_empty(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n_cells"), F.count_if(F.col("value") < 60).alias("n_empty")).where("n_cells >= 6 and n_empty * 10 > n_cells * 6")


@query("""with t as (select p_brand, p_type, count(*) n from part group by 1, 2) select p_brand, arg_max(p_type, (n, p_type)) top_type, max(n) n_codes, count(*) n_targets from t group by 1""")
def mapping_collisions(spark, sf_dir):
    t = _table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return t.groupBy("p_brand").agg(F.max_by("p_type", F.struct("n", "p_type")).alias("top_type"), F.max("n").alias("n_codes"), F.count("*").alias("n_targets"))


_SEVERITY = "case event_type when 'error' then 'error' when 'purchase' then 'warning' when 'signup' then 'warning' else 'info' end"


@query(f"""select user_id, case min(case s when 'error' then 0 when 'warning' then 1 else 2 end) when 0 then 'fail' when 1 then 'warning' else 'info' end outcome
  from (select user_id, {_SEVERITY} s from events) group by 1""")
def outcome_rollup(spark, sf_dir):
    return k.outcome(_table(spark, sf_dir, "events").select("user_id", F.expr(_SEVERITY).alias("severity")), ["user_id"])


_CRITERIA = [("click", "2.4.4"), ("click", "4.1.2"), ("view", "1.1.1"), ("purchase", "3.3.2"), ("purchase", "1.3.1"), ("error", "1.3.1"), ("signup", "3.3.2"), ("error", "3.3.2")]


@query(f"""with m(event_type, criterion) as (values {', '.join(map(str, _CRITERIA))})
  select criterion, user_id % 10 bucket, min(case {_SEVERITY} when 'error' then 0 when 'warning' then 1 else 2 end)::int worst, count(*) n from events join m using (event_type) group by 1, 2""")
def criteria_rollup(spark, sf_dir):
    m = F.broadcast(spark.createDataFrame(_CRITERIA, "event_type string, criterion string"))  # eight literal rows
    e = _table(spark, sf_dir, "events").withColumn("severity", F.expr(_SEVERITY)).join(m, "event_type")
    return e.groupBy("criterion", (F.col("user_id") % 10).alias("bucket")).agg(F.min(k.severity_rank(F.col("severity"))).alias("worst"), F.count("*").alias("n"))


@query("""select c_custkey, coalesce(bool_or(o_orderpriority = '1-URGENT'), false) urgent, case when count(o_orderkey) = 0 then 'not-applicable' when bool_or(o_totalprice > 300000) then 'fail' else 'pass' end outcome
  from customer left join orders on o_custkey = c_custkey group by 1""")
def applicability(spark, sf_dir):
    flags = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.bool_or(F.col("o_totalprice") > 300000).alias("big"))
    j = _table(spark, sf_dir, "customer").select("c_custkey").join(flags, "c_custkey", "left")
    return j.select("c_custkey", F.coalesce("urgent", F.lit(False)).alias("urgent"), F.when(F.col("big").isNull(), "not-applicable").when(F.col("big"), "fail").otherwise("pass").alias("outcome"))


@query("""with v as (select o_custkey, o_orderstatus, case when count_if(o_orderpriority = '1-URGENT') > 0 then 'fail' when count_if(o_orderpriority = '2-HIGH') > 0 then 'review' else 'pass' end verdict from orders group by 1, 2)
  select o_orderstatus, verdict, count(*) n from v group by rollup (o_orderstatus, verdict)""")
def verdict_batch(spark, sf_dir):
    v = _table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(k.verdict(F.count_if(F.col("o_orderpriority") == "1-URGENT"), F.count_if(F.col("o_orderpriority") == "2-HIGH")).alias("verdict"))
    return v.rollup("o_orderstatus", "verdict").agg(F.count("*").alias("n"))


@query(f"""select user_id, event_id, row_number() over (partition by user_id order by case {_SEVERITY} when 'error' then 0 when 'warning' then 1 else 2 end, ts, event_type, event_id)::int place from events""")
def finding_order(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(k.severity_rank(F.expr(_SEVERITY)), "ts", "event_type", "event_id")
    return _table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).alias("place"))


@query("""with recursive r as (select l_orderkey o, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) i, l_partkey v from lineitem),
  c as (select o, i, v, 1 n from r union select c.o, r.i, r.v, n + 1 from c join r on r.o = c.o and r.i > c.i and r.v > c.v)
  select o l_orderkey, max(n)::int in_order, max(i)::int n_items from c group by 1""")
def paint_order_lis(spark, sf_dir):
    """Longest run of items in rising order, in the order of their lines (as reading order is held against painting order)."""
    ordered = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")))
    g = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(ordered, lambda x: x["l_partkey"]).alias("seq"))
    return g.select("l_orderkey", tx.longest_increasing("seq").alias("in_order"), F.size("seq").alias("n_items"))


@query(None)
def actualtext_ratio(spark, sf_dir):
    """Similarity of each turn's letters with the turn before; the measure has no SQL form."""
    c = spread(_table(spark, sf_dir, "conversations"), "conv_id")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return c.withColumn("before", before).where("before is not null").select("conv_id", "turn", tx.similarity(tx.letters(F.col("text")), tx.letters(F.col("before"))).alias("ratio"))


def _expected() -> str:
    """What the statements' defects lead to, as SQL: (supplier, rule, severity, findings)."""
    from .catalogue import BY_ID
    from .sources.pdf.statements import DEFECTS

    values = ", ".join(f"('{r}', '{BY_ID[r].severity}', {m}, {rest}, {n})" for r, (m, rest, n) in DEFECTS.items())
    return f"select s_suppkey::bigint supplier, rule, severity, n::bigint findings from supplier join (values {values}) d(rule, severity, m, rest, n) on s_suppkey % m = rest"


def _statement_audit(spark: SparkSession, sf_dir: str):
    """The whole audit over a PDF file for each supplier: written, read back by the reader, shredded and held against every rule."""
    from .api import check
    from .sources.files import facts_of
    from .sources.pdf.statements import statements

    files = statements(_table(spark, sf_dir, "supplier").where("s_suppkey is not null"), F.col("s_suppkey"), F.col("s_name"), "supplier")
    return check(spark, facts=facts_of(spark, files))


def _supplier() -> Column:
    return F.regexp_extract("path", r"(\d+)\.pdf$", 1).cast("bigint").alias("supplier")


@query(_expected())
def pdf_findings(spark, sf_dir):
    """Findings of all 89 rules on PDF files."""
    r = _statement_audit(spark, sf_dir)
    found = r.findings.join(r.results.select("doc_id", "path"), "doc_id")
    return found.groupBy(_supplier(), "rule", "severity").agg(F.sum("count").cast("bigint").alias("findings"))


@query(f"""with f as ({_expected()}),
  g as (select supplier, sum(case when severity = 'error' then findings else 0 end) errors, sum(case when severity = 'warning' then findings else 0 end) warnings from f group by 1)
  select s_suppkey::bigint supplier, coalesce(errors, 0)::bigint errors, coalesce(warnings, 0)::bigint warnings,
         case when coalesce(errors, 0) > 0 then 'fail' when coalesce(warnings, 0) > 0 then 'review' else 'pass' end verdict
  from supplier left join g on supplier = s_suppkey""")
def pdf_verdicts(spark, sf_dir):
    """The verdict on each PDF file."""
    r = _statement_audit(spark, sf_dir).results
    return r.select(_supplier(), F.col("errors").cast("bigint").alias("errors"), F.col("warnings").cast("bigint").alias("warnings"), "verdict")
