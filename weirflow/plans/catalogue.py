"""The registered queries over the record-pipeline operators, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow import operators as O
from weirflow.builder import Pipeline
from weirflow.plans.command import Session, run, run_fork
from weirflow.storage import new_path
from weirflow.streaming import on_stream

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _p(spark: SparkSession, d: str, table: str, order: str | list[str], value: str | None, *cols: str) -> Pipeline:
    keys = [order] if isinstance(order, str) else order
    df = spark.read.parquet(f"{d}/{table}.parquet").select(*dict.fromkeys([*keys, *([value] if value else []), *cols]))
    return Pipeline.from_dataframe(df, keys, value)


def _out(p: Pipeline, value: str, *cols: str) -> DataFrame:
    return p.to_dataframe(value).select(*cols, value)


def _long(df: DataFrame, *cols: str) -> DataFrame:
    """Whole numbers that are known to fit 64 bits, which sums and products are not held to."""
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


def _calibrated(spark: SparkSession, d: str) -> Pipeline:
    """By line of text with a digit: its first and last digit as one number. The digits are an array in the line's own record,
    so there is no shuffle for the groups."""
    digits = "regexp_extract_all(line, '[0-9]', 0)"
    df = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    df = df.withColumn("digits", F.expr(digits)).where("size(digits) > 0").select("doc_id", "no", F.concat(F.element_at("digits", 1), F.element_at("digits", -1)).alias("pair"))
    return Pipeline.from_dataframe(df, ["doc_id", "no"], "pair").to_int()


_DIGITS = "SELECT doc_id, CAST(concat(d[1], d[-1]) AS BIGINT) n FROM (SELECT doc_id, regexp_extract_all(l, '[0-9]') d FROM (SELECT doc_id, unnest(string_split(text, chr(10))) l FROM documents)) WHERE len(d) > 0"


@_query(f"SELECT doc_id, CAST(sum(n) AS BIGINT) total, count(*) lines FROM ({_DIGITS}) GROUP BY doc_id")
def calibration_by_doc(spark: SparkSession, d: str) -> DataFrame:
    return _calibrated(spark, d).to_dataframe("n").groupBy("doc_id").agg(F.sum("n").alias("total"), F.count("*").alias("lines"))


@_query(f"SELECT CAST(sum(n) AS BIGINT) total FROM ({_DIGITS})")
def calibration_total(spark: SparkSession, d: str) -> DataFrame:
    return _long(_out(_calibrated(spark, d).sum(), "total"), "total")


@_query("SELECT CAST(sum(try_cast(concat(d[1], d[-1]) AS BIGINT)) AS BIGINT) total FROM (SELECT regexp_extract_all(l, '[0-9]') d FROM (SELECT unnest(string_split(text, chr(10))) l FROM documents)) WHERE len(d) > 0")
def calibration_operators(spark: SparkSession, d: str) -> DataFrame:
    """The same, written with foreach, regex, forkcat, head, tail and join."""
    body = O.chain(O.regex("[0-9]", multi=True), O.forkcat(O.head(1), O.tail(1)), O.join(""))
    return _long(_out(_p(spark, d, "documents", "doc_id", "text").lines().filter().regex("[0-9]", full=True).foreach(body).to_int().sum(), "total"), "total")


@_query("SELECT (r // 100)::BIGINT chunk, CAST(sum(CAST(value AS DECIMAL(38,12))) AS DOUBLE) total, min(event_id) first_id FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 r FROM events) GROUP BY 1")
def chunks_sum(spark: SparkSession, d: str) -> DataFrame:
    p = _p(spark, d, "events", "event_id", "value").enum().key("r").select("value").chunks(100, O.sum_())
    return p.to_dataframe("total").select(F.floor(F.col("r") / 100).alias("chunk"), "total", F.col("event_id").alias("first_id"))


@_query("SELECT CAST(sum(CAST(value AS DECIMAL(38,12))) AS DOUBLE) total FROM events")
def sum_exact(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", "value").sum(), "total")


@_query("SELECT round(sum(value), 3) total FROM events")
def sum_floating(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", "value").sum(exact=False), "total").select(F.round("total", 3).alias("total"))


@_query("SELECT CAST(sum(user_id) AS BIGINT) total FROM events")
def sum_int(spark: SparkSession, d: str) -> DataFrame:
    return _long(_out(_p(spark, d, "events", "event_id", "user_id").sum(), "total"), "total")


@_query("SELECT avg(user_id) mean FROM events")
def avg_int(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", "user_id").avg(), "mean")


@_query("SELECT count(*) n, arg_min(event_type, event_id) event_type FROM events")
def count_first_row(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", "value", "event_type").count(), "n", "event_type")


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def max_row(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "orders", "o_orderkey", "o_totalprice").max(), "o_totalprice", "o_orderkey")


@_query("SELECT event_id FROM events ORDER BY event_id LIMIT 5")
def head_root(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", "event_id").head(5), "event_id")


@_query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 7)")
def head_negative(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", "event_id").head(-7), "event_id")


@_query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 4")
def tail_root(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", "event_id").tail(4), "event_id")


@_query("SELECT event_id FROM events ORDER BY event_id OFFSET 11")
def tail_skip(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", "event_id").skip(11), "event_id")


def _grouped(sql: str) -> str:
    return f"WITH g AS (SELECT *, (row_number() OVER (ORDER BY event_id) - 1) // 50 k FROM events) {sql}"


@_query(_grouped("SELECT event_id FROM g QUALIFY row_number() OVER (PARTITION BY k ORDER BY event_id) <= 3"))
def head_per_group(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", "event_id").chunks(50, O.head(3)), "event_id")


@_query(_grouped("SELECT event_id FROM g QUALIFY row_number() OVER (PARTITION BY k ORDER BY event_id DESC) <= 2"))
def tail_per_group(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", "event_id").chunks(50, O.tail(2)), "event_id")


@_query(_grouped("SELECT event_id, row_number() OVER (PARTITION BY k ORDER BY event_id) - 1 i FROM g QUALIFY i < 20"))
def enum_per_group(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", "event_id").chunks(50, O.enum(20)), "i", "event_id")


@_query(_grouped("SELECT min(event_id) event_id, string_agg(event_type, ',' ORDER BY event_id) types FROM g GROUP BY k"))
def join_sep(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", "event_type").chunks(50, O.join(",")), "types", "event_id")


@_query(_grouped("SELECT min(event_id) event_id, list(user_id ORDER BY event_id) users FROM g GROUP BY k"))
def collect_values(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", "user_id").chunks(50, O.collect()), "users", "event_id")


@_query(_grouped("SELECT k, count(*) FILTER (WHERE value > 190) n FROM g GROUP BY k").replace("SELECT k, count", "SELECT CAST(k AS BIGINT) AS k, count"))
def empty_groups_count(spark: SparkSession, d: str) -> DataFrame:
    p = _p(spark, d, "events", "event_id", "value").chunks(50, O.compute("_ > 190.0"), O.filter_(), O.count())
    return _out(p.key("n").enum(), "k", "n")


@_query("SELECT event_id, concat(lpad(CAST(event_id AS VARCHAR), CAST(greatest(8, length(CAST(event_id AS VARCHAR))) AS INTEGER), '0'), ':', event_type) label FROM events")
def format_padded(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", None, "event_type").format("{event_id:08}:{event_type}"), "label", "event_id")


@_query("SELECT event_id, printf('%x|%o|%+d', user_id, user_id, user_id) label FROM events")
def format_bases(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", "user_id").format("{:x}|{:o}|{:+}"), "label", "event_id")


@_query("SELECT event_id, concat(repeat('*', 12 - length(event_type)), event_type, '|', event_type, repeat('.', 12 - length(event_type))) label FROM events")
def format_aligned(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", "event_type").format("{:*>12}|{:.<12}"), "label", "event_id")


@_query("SELECT page_id, regexp_extract(url, '^([a-z]+)://([^/]+)', 1) scheme, regexp_extract(url, '^([a-z]+)://([^/]+)', 2) AS host FROM pages WHERE regexp_matches(url, '^([a-z]+)://([^/]+)')")
def regex_groups(spark: SparkSession, d: str) -> DataFrame:
    return _p(spark, d, "pages", "page_id", "url").regex("^(?<scheme>[a-z]+)://(?<host>[^/]+)").to_dataframe("m").select("page_id", "scheme", "host")


@_query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) link FROM pages")
def regex_multimatch(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "pages", "page_id", "html").regex('href="(?<>[^"]*)"', multi=True), "link", "page_id")


@_query("SELECT event_id FROM events WHERE NOT regexp_matches(event_type, '^c')")
def regex_invert(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", "event_type").regex("^c", invert=True), "t", "event_id").select("event_id")


@_query("SELECT event_id, CASE WHEN regexp_matches(event_type, '^c') THEN regexp_extract(event_type, '^c..') END m FROM events")
def regex_optional(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", "event_type").regex("^c..", optional=True), "m", "event_id")


@_query("SELECT event_id, event_type FROM events WHERE regexp_matches(event_type, '(?i)IC')")
def regex_icase_full(spark: SparkSession, d: str) -> DataFrame:
    return _p(spark, d, "events", "event_id", "event_type").regex("IC", ignore_case=True, full=True).to_dataframe("v").select("event_id", F.col("v").alias("event_type"))


@_query("SELECT n_nationkey, count(*) n FROM (SELECT n_nationkey, unnest(range(1, length(n_name))) i, n_name FROM nation) WHERE regexp_matches(substr(n_name, i::BIGINT, 2), '^[A-Z][A-Z]$') GROUP BY n_nationkey")
def regex_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _p(spark, d, "nation", "n_nationkey", "n_name").regex("[A-Z]{2}", overlapping=True).to_dataframe("m").groupBy("n_nationkey").agg(F.count("*").alias("n"))


@_query("SELECT doc_id, count(*) n FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) l FROM documents) GROUP BY doc_id")
def lines_count(spark: SparkSession, d: str) -> DataFrame:
    return _p(spark, d, "documents", "doc_id", "text").lines().to_dataframe("l").groupBy("doc_id").agg(F.count("*").alias("n"))


@_query("SELECT item_id, length(text) n FROM benchmark")
def chars_count(spark: SparkSession, d: str) -> DataFrame:
    return _p(spark, d, "benchmark", "item_id", "text").chars().to_dataframe("c").groupBy("item_id").agg(F.count("*").alias("n"))


@_query("SELECT conv_id, turn, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') t FROM conversations")
def trim_text(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "conversations", ["conv_id", "turn"], "text").format("  {}\n ").trim(), "t", "conv_id", "turn")


@_query("SELECT event_id, 'k' AS key, props->>'$.k' AS val FROM events")
def flatten_object(spark: SparkSession, d: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.from_json("props", "map<string, string>").alias("props"))
    out = _out(Pipeline.from_dataframe(df, "event_id", "props").flatten(), "kv", "event_id")
    return out.select("event_id", F.col("kv")[0].alias("key"), F.col("kv")[1].alias("val"))


@_query("SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) x FROM embeddings")
def flatten_array(spark: SparkSession, d: str) -> DataFrame:
    out = _p(spark, d, "embeddings", "vec_id", "embedding").flatten().to_dataframe("x", order=True)
    return out.select("vec_id", F.element_at("order", -1).alias("i"), F.col("x").cast("double").alias("x"))


@_query("SELECT event_id, try_cast(props->>'$.k' AS BIGINT) AS k FROM events")
def explode_object(spark: SparkSession, d: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.from_json("props", "k bigint").alias("props"))
    return Pipeline.from_dataframe(df, "event_id", "props").explode().to_dataframe("v").select("event_id", "k")


@_query("SELECT event_id, try_cast(regexp_extract(event_type || event_id, '[a-z]?[0-9]+$') AS BIGINT) n, CASE WHEN try_cast(regexp_extract(event_type || event_id, '[a-z]?[0-9]+$') AS BIGINT) IS NULL THEN 'failed to parse value as int' END AS error FROM events")
def to_int_errors(spark: SparkSession, d: str) -> DataFrame:
    return _p(spark, d, "events", "event_id", "event_type").format("{}{event_id}").regex("[a-z]?[0-9]+$").to_int().to_dataframe("n", error=True).select("event_id", "n", "error")


@_query("SELECT count(*) n FROM events WHERE user_id % 2 = 0")
def eliminate_errors(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", "user_id").compute("1 / (1 - _ % 2)").eliminate_errors().count(), "n")


@_query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey // l_linenumber q, l_partkey % l_linenumber r FROM lineitem")
def compute_div(spark: SparkSession, d: str) -> DataFrame:
    p = _p(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], None).compute("l_partkey / l_linenumber").key("q").compute("l_partkey % l_linenumber")
    return _out(p, "r", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "q")


@_query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * (1 - l_discount) net FROM lineitem")
def compute_float(spark: SparkSession, d: str) -> DataFrame:
    p = _p(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], None, "l_extendedprice", "l_discount").compute("l_extendedprice * (1 - l_discount)")
    return _out(p, "net", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@_query("SELECT p_partkey, CAST(power(p_size, 2) AS BIGINT) AS sq, -p_size::BIGINT AS neg, (p_size > 20) AND (p_size <= 40) AS mid FROM part")
def compute_mixed(spark: SparkSession, d: str) -> DataFrame:
    p = _p(spark, d, "part", "p_partkey", None, "p_size").compute("p_size ** 2").key("sq").compute("-p_size").key("neg").compute("p_size > 20 && p_size <= 40")
    return _out(p, "mid", "p_partkey", "sq", "neg")


@_query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'large' ELSE upper(p_brand) END AS what FROM part")
def compute_if(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "part", "p_partkey", None, "p_size", "p_brand").compute("let b = upper(p_brand); if p_size > 25 { 'large' } else { b }"), "what", "p_partkey")


@_query("SELECT o_orderkey FROM orders WHERE o_totalprice > 200000")
def filter_compute(spark: SparkSession, d: str) -> DataFrame:
    return _p(spark, d, "orders", "o_orderkey", "o_totalprice").compute("_ > 200000").filter().to_dataframe("v").select("o_orderkey")


@_query("SELECT c_custkey, i FROM customer, (SELECT unnest(range(0, 3)) i)")
def seq_cross(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "customer", "c_custkey", None).seq(3), "i", "c_custkey")


@_query("SELECT c_custkey, i FROM customer, (SELECT unnest(range(10, 0, -4)) i)")
def seq_negative(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "customer", "c_custkey", None).seq(0, 10, -4), "i", "c_custkey")


@_query("SELECT n_name FROM nation UNION ALL SELECT n_name FROM nation UNION ALL SELECT n_name FROM nation")
def dup_three(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "nation", "n_nationkey", "n_name").dup(3), "n").select(F.col("n").alias("n_name"))


@_query("SELECT event_id, event_type AS v FROM events WHERE regexp_matches(event_type, '^p') UNION ALL SELECT event_id, CAST(user_id AS VARCHAR) FROM events")
def forkcat_union(spark: SparkSession, d: str) -> DataFrame:
    p = _p(spark, d, "events", "event_id", "event_type", "user_id").forkcat(O.regex("^p", full=True), O.select("user_id"))
    return _out(p, "v", "event_id")


@_query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT (SELECT max(n_nationkey) FROM nation), 'end'")
def aggregate_append(spark: SparkSession, d: str) -> DataFrame:
    p = _p(spark, d, "nation", "n_nationkey", "n_name").aggregate(O.nop(), O.literal("end")).to_dataframe("v")
    return p.select("n_nationkey", F.col("v").alias("n_name"))


@_query("SELECT event_id, event_type, user_id * 2 AS twice FROM events")
def transparent_key(spark: SparkSession, d: str) -> DataFrame:
    p = _p(spark, d, "events", "event_id", "event_type", "user_id").transparent(O.chain(O.compute("user_id * 2"), O.key("twice")))
    return _long(p.to_dataframe("v").select("event_id", F.col("v").alias("event_type"), "twice"), "twice")


@_query("SELECT event_id, 'int' AS a, 'str' AS b, 'float' AS c FROM events")
def typename_columns(spark: SparkSession, d: str) -> DataFrame:
    p = _p(spark, d, "events", "event_id", "user_id", "event_type", "value").typename().key("a").select("event_type").typename().key("b").select("value").typename()
    return _out(p, "c", "event_id", "a", "b")


@_query("SELECT event_id, event_type || '-' || user_id AS v FROM events")
def python_function(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", "user_id", "event_type").py("x = str(_)\nevent_type + '-' + x"), "v", "event_id")


@_query("SELECT CAST(sum(length(role)) AS BIGINT) AS total FROM conversations")
def chars_of_roles(spark: SparkSession, d: str) -> DataFrame:
    return _long(_out(_p(spark, d, "conversations", ["conv_id", "turn"], "role").foreach(O.chars(), O.count()).sum(), "total"), "total")


@_query("SELECT CAST(sum(i) AS BIGINT) total FROM range(0, 100000) t(i) WHERE contains(CAST(i AS VARCHAR), '7')")
def command_line(spark: SparkSession, d: str) -> DataFrame:
    return _long(_out(run(spark, "seq=100k r-f=7 to_int sum"), "total"), "total")


@_query("SELECT count(*) n FROM events WHERE false")
def drop_all(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", "value").drop().count(), "n")


@_query("SELECT event_id, '{a: ' || user_id || ', b: \"' || event_type || '\"}' AS v FROM events")
def object_literal(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", None, "user_id", "event_type").compute("{a: user_id, b: event_type}").to_literal(), "v", "event_id")


@_query("SELECT event_id, user_id + 5 AS v FROM events")
def parse_literals(spark: SparkSession, d: str) -> DataFrame:
    return _long(_out(_p(spark, d, "events", "event_id", "user_id").format("{}").from_literal("bigint").compute("_ + 5"), "v", "event_id"), "v")


@_query("SELECT event_id, CAST(event_id AS DOUBLE) / 4 AS v FROM events")
def to_float_text(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", "event_id").to_str().to_float().compute("_ / 4.0"), "v", "event_id")


# Generators and literals


@_query("SELECT c_custkey, i FROM customer, (SELECT unnest(range(1, 4)) i)")
def seqn_cross(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "customer", "c_custkey", None).seqn(3), "i", "c_custkey")


@_query(_grouped("SELECT event_id, row_number() OVER (PARTITION BY k ORDER BY event_id) i FROM g QUALIFY i <= 7"))
def enumn_groups(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", "event_id").chunks(50, O.enumn(7)), "i", "event_id")


@_query("SELECT i, CASE WHEN i < 5 THEN i END n_nationkey FROM (SELECT unnest(range(0, 8)) i)")
def enum_past_input(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "nation", "n_nationkey", None).head(5).enum_unbounded(8), "i", "n_nationkey")


@_query("SELECT CAST(p AS BIGINT) p FROM (SELECT unnest(range(2, 1000)) p) WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(range(2, 32)) q) WHERE q < p AND p % q = 0)")
def primes_head(spark: SparkSession, d: str) -> DataFrame:
    return _out(run(spark, "primes nop head=168"), "p")


@_query("SELECT * FROM (VALUES (0, 'null'), (1, 'undefined'), (2, 'error'), (3, 'bytes'), (4, 'float'), (5, 'bool'), (6, 'array'), (7, 'object'), (8, 'int'), (9, 'str')) t(i, kind)")
def literal_kinds(spark: SparkSession, d: str) -> DataFrame:
    words = "null next undefined next error=x next bytes=ab next v=1.5 next v=true next v=[1] next v={a:1} next int=3 next str=q".split(" next ")
    return _out(run(spark, f"fc: {' typename next '.join(words)} typename end key=kind enum"), "i", "kind")


@_query("SELECT n_nationkey, 'v' v FROM nation UNION ALL SELECT n_nationkey, 'v' FROM nation UNION ALL SELECT n_nationkey, 'v' FROM nation")
def literal_copies(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "nation", "n_nationkey", None).literal("v", 3), "v", "n_nationkey")


# Naming and scope


@_query("SELECT n_nationkey, n_name || ' in Rome' AS v FROM nation")
def atom_format(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "nation", "n_nationkey", "n_name").atom("city", "Rome").format("{} in {%city}"), "v", "n_nationkey")


@_query("SELECT * FROM (VALUES ('bs', '42'), ('sbs', '8192'), ('city', 'Rome')) t(name, v)")
def settings_read(spark: SparkSession, d: str) -> DataFrame:
    each = ["%bs=42 str=bs key=name f={%bs}", "str=sbs key=name f={%sbs}", "[ atom city Rome ] str=city key=name f={%city}"]
    frames = [_out(run(spark, c), "v", "name") for c in each]
    return frames[0].union(frames[1]).union(frames[2])


@_query("SELECT * FROM (VALUES ('text', CAST(90 AS BIGINT)), ('calls', 45)) t(name, v)")
def macros(spark: SparkSession, d: str) -> DataFrame:
    text = run(spark, "macro: doubled seq={arg} c=_*2 sum end str=text key=name doubled=10")
    made = run(spark, ["macro:=ten", "v=[['seq', 10], ['sum']]", "end", "str=calls", "key=name", "ten"])
    return _long(_out(text, "v", "name").union(_out(made, "v", "name")), "v")


@_query("SELECT CAST(sum(n_nationkey * 2) AS BIGINT) v FROM nation")
def call_label(spark: SparkSession, d: str) -> DataFrame:
    return _long(_out(_p(spark, d, "nation", "n_nationkey", "n_nationkey").define("twice", O.compute("_ * 2"), O.sum_()).call("twice"), "v"), "v")


@_query("SELECT CAST(10 + 45 AS BIGINT) v")
def session_last(spark: SparkSession, d: str) -> DataFrame:
    s = Session(spark)
    s.run("seq=10 sum")
    return _long(_out(s.run("_ c='_+10'"), "v"), "v")


@_query("SELECT event_id, 'undefined' AS a, 'int' AS b FROM events")
def select_unknown(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", None, "user_id").select("nothing").typename().key("a").select("user_id").nop().typename(), "b", "event_id", "a")


@_query("SELECT 'sum' AS what, CAST(sum(user_id) AS BIGINT) v FROM events UNION ALL SELECT 'count', count(*) FROM events UNION ALL SELECT 'max', max(user_id) FROM events")
def fork_three(spark: SparkSession, d: str) -> DataFrame:
    start = _p(spark, d, "events", "event_id", "user_id")
    got = [_long(_out(p, "v"), "v").select(F.lit(n).alias("what"), "v") for n, p in zip(("sum", "count", "max"), run_fork(spark, "fork: sum next count next max end", start), strict=True)]
    return got[0].union(got[1]).union(got[2])


# Fan-in in groups


@_query("SELECT * FROM (VALUES (0, CAST(0 AS BIGINT)), (1, 1), (2, 9)) t(i, v)")
def aggregate_head_sum(spark: SparkSession, d: str) -> DataFrame:
    return _long(_out(run(spark, "seq=5 aggregate: head=2 next sum end key=v enum"), "i", "v"), "v")


@_query(_grouped("SELECT min(event_id) event_id, CAST(coalesce(sum(user_id) FILTER (WHERE r >= 3), max(user_id) FILTER (WHERE r = n - 1)) AS BIGINT) v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY event_id) - 1 r, count(*) OVER (PARTITION BY k) n FROM g) GROUP BY k"))
def aggregate_in_groups(spark: SparkSession, d: str) -> DataFrame:
    """Of each chunk the sum of what is left after three; the last record again where nothing is."""
    p = _p(spark, d, "events", "event_id", "user_id").chunks(50, O.key("u"), O.aggregate(O.chain(O.head(3), O.drop()), O.sum_()), O.key("v"), O.head(1))
    firsts = _p(spark, d, "events", "event_id", "event_id").chunks(50, O.head(1)).enum().to_dataframe("k")
    return _long(p.enum().to_dataframe("k").select("k", "v").join(firsts.select("k", "event_id"), "k").select("event_id", "v"), "v")


@_query("SELECT CAST(row_number() OVER (ORDER BY c, b, i) - 1 AS BIGINT) AS at, v FROM (SELECT n_nationkey // 4 c, 0 b, n_nationkey i, n_name v FROM nation UNION ALL SELECT n_nationkey // 4, 1, n_nationkey, '-' FROM nation)")
def forkcat_in_groups(spark: SparkSession, d: str) -> DataFrame:
    p = _p(spark, d, "nation", "n_nationkey", "n_name").chunks(4, O.forkcat(O.nop(), O.literal("-")))
    return _out(p.key("v").enum(), "at", "v")


@_query("SELECT CAST(i AS BIGINT) AS at, v FROM (VALUES (0, '0'), (1, '1'), (2, 'x'), (3, 'x'), (4, '2'), (5, 'x'), (6, '0'), (7, '1'), (8, 'x'), (9, 'x'), (10, '2'), (11, 'x')) t(i, v)")
def forkcat_nested(spark: SparkSession, d: str) -> DataFrame:
    return _out(run(spark, "seq=2 fe: seq=3 chunks=2: forkcat: nop next str=x end end end key=v enum"), "at", "v")


@_query(_grouped("SELECT min(event_id) event_id, string_agg(event_type, ',' ORDER BY event_id) types FROM (SELECT *, (row_number() OVER (PARTITION BY k ORDER BY event_id) - 1) // 7 j FROM g) GROUP BY k, j"))
def join_bounded(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", "event_type").chunks(50, O.join(",", 7)), "types", "event_id")


@_query(_grouped("SELECT min(event_id) event_id, string_agg(event_type, '' ORDER BY event_id) types FROM (SELECT *, (row_number() OVER (PARTITION BY k ORDER BY event_id) - 1) // 7 j FROM g) GROUP BY k, j HAVING count(*) = 7"))
def join_drop_incomplete(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", "event_type").chunks(50, O.join("", 7, drop_incomplete=True)), "types", "event_id")


# Regular expressions


def _matches(flags: str, pattern: str) -> str:
    return f"SELECT doc_id, count(*) n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{flags}{pattern}')) m FROM documents) GROUP BY doc_id"


def _counted(spark: SparkSession, d: str, pattern: str, **flags: bool) -> DataFrame:
    return _p(spark, d, "documents", "doc_id", "text").regex(pattern, multi=True, **flags).to_dataframe("m").groupBy("doc_id").agg(F.count("*").alias("n"))


@_query(_matches("(?m)", "^[A-Z][a-z]+"))
def regex_line_mode(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d, "^[A-Z][a-z]+", lines=True)


@_query(_matches("(?s)", "[.].[A-Z]"))
def regex_dot_all(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d, "[.].[A-Z]", dot_all=True)


@_query(_matches("", r"\w+"))
def regex_ascii(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d, r"\w+", ascii_only=True)


@_query(_matches("", r"[\p{L}\p{M}\p{Nd}\p{Pc}]+"))
def regex_unicode(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d, r"\w+")


@_query("SELECT event_id, CASE WHEN event_type[1] = 'c' THEN 'c' END AS first, '' AS none, substr(event_type, CASE WHEN event_type[1] = 'c' THEN 2 ELSE 1 END, 1) AS next FROM events")
def regex_unmatched_groups(spark: SparkSession, d: str) -> DataFrame:
    p = _p(spark, d, "events", "event_id", "event_type").regex("^(?<first>c)?(?<none>0*)(?<next>[a-z])")
    return p.to_dataframe("m").select("event_id", "first", "none", "next")


# Formats


@_query("SELECT event_id, s[1] || CASE WHEN rtrim(s[2:], '0') <> '' THEN '.' || rtrim(s[2:], '0') ELSE '' END || 'e' || (length(s) - 1) AS a, s[1] || CASE WHEN rtrim(s[2:], '0') <> '' THEN '.' || rtrim(s[2:], '0') ELSE '' END || 'E' || (length(s) - 1) AS b FROM (SELECT event_id, CAST(event_id + 1 AS VARCHAR) s FROM events)")
def format_scientific(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", "event_id").compute("event_id + 1").key("n").format("{n:e}").key("a").format("{n:E}"), "b", "event_id", "a")


@_query("SELECT event_id, bin(user_id) AS a, '0b' || bin(user_id) AS b FROM events")
def format_binary(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", "user_id").format("{user_id:b}").key("a").format("{user_id:0b}"), "b", "event_id", "a")


@_query("SELECT event_id, printf('%.3f', value) AS a, CASE WHEN user_id % 2 = 0 THEN printf('%.2f', value) ELSE printf('%.3f', value) END AS b FROM events")
def format_precision(spark: SparkSession, d: str) -> DataFrame:
    p = _p(spark, d, "events", "event_id", None, "value", "user_id").compute("2 + user_id % 2").key("p").format("{value:.3}").key("a").format("{value:.p$}")
    return _out(p, "b", "event_id", "a")


@_query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN NULL ELSE 'n=' || (1000 // (user_id % 2)) END AS v, CASE WHEN user_id % 2 = 0 THEN 'Division by Zero' END AS error FROM events")
def format_errors(spark: SparkSession, d: str) -> DataFrame:
    p = _p(spark, d, "events", "event_id", "user_id").compute("1000 / (_ % 2)").format("n={}")
    return p.to_dataframe("v", error=True).select("event_id", "v", "error")


@_query("SELECT event_id, '{a:' || user_id || ',b:[1,2]}' AS a, '{a: ' || user_id || ', b: [1, 2]}' AS b FROM events")
def format_compact(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", None, "user_id").compute("{a: user_id, b: [1, 2]}").key("o").format("{o:##?}").key("a").format("{o:??}"), "b", "event_id", "a")


# Expressions


@_query("SELECT event_id, user_id & 7 AS a, user_id | 8 AS o, xor(user_id, 5) AS x, user_id << 2 AS l, user_id >> 1 AS r FROM events")
def compute_bits(spark: SparkSession, d: str) -> DataFrame:
    p = _p(spark, d, "events", "event_id", None, "user_id")
    for name, e in (("a", "user_id & 7"), ("o", "user_id | 8"), ("x", "user_id ^ 5"), ("l", "user_id << 2")):
        p = p.compute(e).key(name)
    return _out(p.compute("user_id >> 1"), "r", "event_id", "a", "o", "x", "l")


@_query("SELECT event_id, event_id > 0 AS more, event_id = 0 AS same FROM events")
def compute_exact_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Past 2^53, where a double can't tell neighbours apart."""
    p = _p(spark, d, "events", "event_id", "event_id").compute("event_id + 9007199254740992").key("n").compute("n > 9007199254740992.0").key("more")
    return _out(p.compute("n == 9007199254740992.0"), "same", "event_id", "more")


@_query("SELECT event_id, CAST(CAST(user_id AS HUGEINT) * 9223372036854775807 AS VARCHAR) v FROM events")
def compute_promote(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", "user_id").compute("_ * 9223372036854775807").to_str(), "v", "event_id")


@_query(f"SELECT p_partkey, CAST({' * '.join(['CAST(p_size AS HUGEINT)'] * 19)} AS VARCHAR) v FROM part")
def compute_power(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "part", "p_partkey", "p_size").compute("_ ** 19").to_str(), "v", "p_partkey")


@_query("SELECT event_id, CAST(user_id AS HUGEINT) * 9223372036854775807 // 1000 % 1000003 AS v FROM events")
def compute_big_division(spark: SparkSession, d: str) -> DataFrame:
    return _long(_out(_p(spark, d, "events", "event_id", "user_id").compute("(_ * 9223372036854775807) / 1000 % 1000003"), "v", "event_id"), "v")


@_query("SELECT event_id, user_id + 1 AS a, user_id + 5 AS b FROM events")
def compute_member(spark: SparkSession, d: str) -> DataFrame:
    p = _p(spark, d, "events", "event_id", None, "user_id").compute("{a: {b: user_id}}").compute("_.a.b + 1").key("a").compute("[user_id, 5][1] + user_id")
    return _long(_out(p, "b", "event_id", "a"), "a", "b")


@_query("SELECT event_id, '[null, ' || user_id || ']' AS a, '[\"' || event_type || '\", ' || user_id || ']' AS b FROM events")
def compute_mixed_array(spark: SparkSession, d: str) -> DataFrame:
    p = _p(spark, d, "events", "event_id", None, "user_id", "event_type").compute("[null, user_id]").to_str().key("a").compute("[event_type, user_id]")
    return _out(p.to_str(), "b", "event_id", "a")


@_query("SELECT event_id, user_id AS v FROM events")
def compute_dynamic_key(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", None, "user_id", "event_type").compute("{[event_type]: user_id, 'other': 0}[event_type]"), "v", "event_id")


@_query("SELECT event_id, 'invalid operands for binary op: `str` * `int`' AS error FROM events")
def compute_wrong_operand(spark: SparkSession, d: str) -> DataFrame:
    return _p(spark, d, "events", "event_id", "event_type").compute("_ * 2").to_dataframe("v", error=True).select("event_id", "error")


@_query("SELECT event_id, -value AS f, NOT (user_id > 5) AS b, CAST(-CAST(user_id AS HUGEINT) * 9223372036854775807 AS VARCHAR) AS big, ~user_id AS bits FROM events")
def compute_unary(spark: SparkSession, d: str) -> DataFrame:
    p = _p(spark, d, "events", "event_id", None, "value", "user_id").compute("-value").key("f").compute("!(user_id > 5)").key("b")
    return _out(p.compute("-(user_id * 9223372036854775807)").to_str().key("big").compute("~user_id"), "bits", "event_id", "f", "b", "big")


@_query("SELECT * FROM (VALUES ('nope(1)', 'unknown function nope()'), ('int(1, 2)', 'int() takes one argument, got 2')) t(code, refused)")
def compute_refusals(spark: SparkSession, d: str) -> DataFrame:
    """An unknown function and a wrong number of arguments are refused before anything runs."""
    rows = []
    for code in ("nope(1)", "int(1, 2)"):
        try:
            Pipeline(spark).compute(code)
        except ValueError as e:
            rows.append((code, str(e)))
    return spark.createDataFrame(rows, "code string, refused string")


# Values of several kinds


@_query("SELECT greatest(max(user_id + 1), max(value + 1)) AS v FROM events")
def flatten_mixed_max(spark: SparkSession, d: str) -> DataFrame:
    p = _p(spark, d, "events", "event_id", None, "user_id", "event_type", "value").compute("[user_id, event_type, value]").flatten()
    return _out(p.compute("_ + 1").eliminate_errors().max().to_float(), "v")


@_query("SELECT * FROM (VALUES (0, 'int', '1'), (1, 'str', 'a'), (2, 'float', '2.5'), (3, 'null', 'null'), (4, 'bool', 'true'), (5, 'array', '[1, \"b\"]')) t(i, kind, v)")
def typename_by_value(spark: SparkSession, d: str) -> DataFrame:
    p = run(spark, ["v=[1, 'a', 2.5, null, true, [1, 'b']]", "flatten", "key=x", "typename@kind", "select=x", "f={:?}", "key=y", "enum"])
    return _out(p, "i", "kind", "y").select("i", "kind", F.regexp_replace("y", '^"(.*)"$', "$1").alias("v"))


@_query("SELECT CAST(sum(CAST(value AS DECIMAL(38,12))) + sum(user_id) AS DOUBLE) AS v FROM events")
def sum_mixed(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", None, "user_id", "value").compute("[user_id, 0.5]").forkcat(O.chain(O.select("user_id")), O.select("value")).sum().to_float(), "v")


# Sums and means at the edges


@_query("SELECT CAST(sum(CAST(user_id AS HUGEINT) * 9223372036854775807) AS VARCHAR) v FROM events")
def sum_overflow(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", "user_id").compute("_ * 9223372036854775807").sum().to_str(), "v")


@_query("SELECT * FROM (VALUES ('huge', 2e300), ('tiny', 2e-15), ('cancelled', 1.0), ('infinite', CAST('inf' AS DOUBLE)), ('least', 1.5e-323), ('wide', 1e17 + 2)) t(name, v)")
def sum_edges(spark: SparkSession, d: str) -> DataFrame:
    cases = {"huge": [1e300, 1e300], "tiny": [1e-15, 1e-15], "cancelled": [1e300, 1.0, -1e300], "infinite": [1.0, float("inf")], "least": [5e-324, 5e-324, 5e-324], "wide": [1e17, 1.0, 1.0]}
    frames = [Pipeline.from_values(spark, v).sum().to_dataframe("v").select(F.lit(n).alias("name"), "v") for n, v in cases.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


@_query("SELECT CAST(s // n AS DOUBLE) + CAST(s % n AS DOUBLE) / n AS v FROM (SELECT sum(CAST(user_id AS HUGEINT) * 1000000007) s, count(*) n FROM events)")
def avg_exact(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", "user_id").compute("_ * 1000000007").avg(), "v")


@_query(_grouped("SELECT min(event_id) event_id, CAST(sum(CAST(value AS DECIMAL(38,12))) AS DOUBLE) / count(*) AS v FROM g GROUP BY k"))
def avg_in_groups(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "events", "event_id", "value").chunks(50, O.avg()), "v", "event_id")


# Sources and sinks


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", "value")


@_query("SELECT event_id, user_id, event_type, CAST(value AS VARCHAR) v FROM events")
def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "csv")
    _events(spark, d).select("event_id", "user_id", "event_type", F.col("value").cast("string").alias("v")).repartition(3).write.option("header", True).csv(path)
    return Pipeline.csv(spark, path, header=True).to_dataframe("none").select("event_id", "user_id", "event_type", "v")


@_query("SELECT n_nationkey, n_name || chr(10) || '\"' || n_name || '\", x' AS cell FROM nation")
def csv_quoted(spark: SparkSession, d: str) -> DataFrame:
    """Cells with line feeds, quotes and separators."""
    path = new_path(spark, "csv")
    cell = F.concat("n_name", F.lit('\n"'), "n_name", F.lit('", x'))
    spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", cell.alias("cell")).coalesce(1).write.option("escape", '"').csv(path)
    return Pipeline.csv(spark, path).to_dataframe("none").select(F.col("0").alias("n_nationkey"), F.col("1").alias("cell"))


@_query("SELECT event_id, '\"' || event_type || '\"' AS a, user_id AS b FROM events")
def csv_raw(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "csv")
    line = F.concat_ws(";", F.col("event_id"), F.concat(F.lit('"'), "event_type", F.lit('"')), F.col("user_id"))
    _events(spark, d).select(line.alias("line")).write.text(path)
    p = Pipeline.csv(spark, path, raw=True, sep=";").to_dataframe("none")
    return p.select(F.col("0").alias("event_id"), F.col("1").alias("a"), F.col("2").alias("b"))


@_query("SELECT event_id, user_id, event_type, value FROM events")
def jsonl_scan(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "jsonl")
    _events(spark, d).repartition(3).write.json(path)
    return Pipeline.jsonl(spark, path).to_dataframe("none").select("event_id", "user_id", "event_type", F.col("value").cast("double").alias("value"))


@_query("SELECT * FROM (VALUES (0, 'str', 'a'), (1, 'int', '42'), (2, 'error', 'ERROR'), (3, 'null', 'null')) t(i, kind, v)")
def jsonl_kinds(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "jsonl")
    spark.createDataFrame([('"a"',), ("42",), ("{",), ("null",)], "line string").coalesce(1).write.text(path)
    p = Pipeline.jsonl(spark, path, use_null=True).key("x").typename().key("kind").select("x").format("{:?}").key("v").enum()
    return _out(p, "i", "kind", "v").select("i", "kind", F.when(F.col("kind") == "error", F.lit("ERROR")).otherwise(F.regexp_replace("v", '"', "")).alias("v"))


@_query("SELECT CAST(event_id AS BIGINT) AS i, event_type AS line FROM events")
def file_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines keep their order over the files of a folder."""
    path = new_path(spark, "lines")
    _events(spark, d).repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select("event_type").write.text(path)
    return _out(Pipeline.text_lines(spark, path).key("line").enum(), "i", "line")


@_query("SELECT string_agg(event_type || chr(10), '' ORDER BY event_id) AS v FROM events")
def file_whole(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "lines")
    _events(spark, d).coalesce(1).sortWithinPartitions("event_id").select("event_type").write.text(path)
    return _out(run(spark, f"file={path}"), "v")


@_query("SELECT i, CAST(i * i AS VARCHAR) v FROM (SELECT unnest(range(0, 20)) i) WHERE i % 5 <> 0")
def print_file(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "printed")
    run(spark, ["seq=20", "c=if _ % 5 != 0 { _ * _ }", f"[", "print", path, "-n", "]"])
    return spark.read.text(path).select(F.sqrt(F.col("value").cast("double")).cast("long").alias("i"), F.col("value").alias("v"))


@_query("SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) link FROM pages")
def xpath_links(spark: SparkSession, d: str) -> DataFrame:
    return _out(_p(spark, d, "pages", "page_id", "html").xpath("//a/@href"), "link", "page_id")


@_query("SELECT event_id, user_id * 2 AS v FROM events WHERE regexp_matches(CAST(user_id AS VARCHAR), '[13579]$')")
def stream_chain(spark: SparkSession, d: str) -> DataFrame:
    """A stateless chain over a stream of the table's files."""
    folder, path = new_path(spark, "stream-in"), new_path(spark, "stream-out")
    _events(spark, d).write.parquet(folder)
    src = spark.readStream.schema("event_id long, user_id long, event_type string, value double").parquet(folder)
    out = on_stream(src, "event_id", "user_id", O.regex("[13579]$", full=True), O.to_int_(), O.compute("_ * 2"))
    writing = out.select(F.element_at("order", 1).alias("event_id"), F.col("value").cast("long").alias("v")).writeStream.format("parquet")
    writing.option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, v long").parquet(path)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
