"""The named query registry and the SQL that each entry is held against.

How the concepts bind to the tables: a command is a line item of an order (stage = return flag, branch = line status, from the earlier
of order and ship date to the later); an artifact is a document, order or event; the provenance graph is region -> nation -> customer ->
order -> line; an interval is a part on its brand's axis; log and text lines are the lines of documents and conversations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stagegraph.functions import naming, scalars
from stagegraph.operators import checks, lineage, lines, regions, resolve, split, stats
from stagegraph.plans import lanes
from stagegraph.session import dealt, load, shared_folder
from stagegraph.sources import files
from stagegraph.streaming import events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(fn):
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLE_SQL[name or fn.__name__] = sql.strip()
        return fn

    return add


# ---------------------------------------------------------------- bindings


def _ms(c: str):
    """Milliseconds since 1970 of a timestamp without a time zone, whatever the session's."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast({c} AS timestamp_ntz))")


def commands(spark, sf_dir) -> DataFrame:
    items = dealt(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate", "l_quantity"), "l_orderkey")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("stage"), F.col("l_linestatus").alias("branch"), _ms("least(o_orderdate, l_shipdate)").alias("start_ms"), _ms("greatest(o_orderdate, l_shipdate)").alias("stop_ms"),
        F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("exit_code"), F.col("l_linenumber").alias("procs"), F.col("l_quantity").cast("long").alias("bytes"), F.col("o_orderstatus").alias("status"),
    )


COMMANDS = """
commands AS (
  SELECT l_orderkey, l_linenumber, l_returnflag AS stage, l_linestatus AS branch, (epoch_us(least(o_orderdate, l_shipdate)) // 1000) AS start_ms,
         (epoch_us(greatest(o_orderdate, l_shipdate)) // 1000) AS stop_ms, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS exit_code,
         l_linenumber AS procs, CAST(l_quantity AS BIGINT) AS bytes, o_orderstatus AS status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""


def nodes_and_edges(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Five levels; a node is a letter and a key."""
    region, nation, customer = (load(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    items = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_shipdate").alias("ts"))
    node = lambda letter, *keys: F.concat_ws("_", F.lit(letter), *[F.col(k).cast("string") for k in keys])
    zero = F.lit(0).cast("long").alias("ts")
    nodes = (
        region.select(node("r", "r_regionkey").alias("node"), zero)
        .unionByName(nation.select(node("n", "n_nationkey").alias("node"), zero))
        .unionByName(customer.select(node("c", "c_custkey").alias("node"), zero))
        .unionByName(orders.select(node("o", "o_orderkey").alias("node"), _ms("o_orderdate").alias("ts")))
        .unionByName(items.select(node("l", "l_orderkey", "l_linenumber").alias("node"), _ms("ts").alias("ts")))
    )
    edges = (
        nation.select(node("r", "n_regionkey").alias("src"), node("n", "n_nationkey").alias("dst"))
        .unionByName(customer.select(node("n", "c_nationkey").alias("src"), node("c", "c_custkey").alias("dst")))
        .unionByName(orders.select(node("c", "o_custkey").alias("src"), node("o", "o_orderkey").alias("dst")))
        .unionByName(items.select(node("o", "l_orderkey").alias("src"), node("l", "l_orderkey", "l_linenumber").alias("dst")))
    )
    return nodes, edges


GRAPH = """
nodes AS (
  SELECT 'r_' || r_regionkey AS node, 0::BIGINT AS ts FROM region UNION ALL SELECT 'n_' || n_nationkey, 0 FROM nation
  UNION ALL SELECT 'c_' || c_custkey, 0 FROM customer UNION ALL SELECT 'o_' || o_orderkey, (epoch_us(o_orderdate) // 1000) FROM orders
  UNION ALL SELECT 'l_' || l_orderkey || '_' || l_linenumber, (epoch_us(max(l_shipdate)) // 1000) FROM lineitem GROUP BY l_orderkey, l_linenumber),
edges AS (
  SELECT 'r_' || n_regionkey AS src, 'n_' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n_' || c_nationkey, 'c_' || c_custkey FROM customer
  UNION ALL SELECT 'c_' || o_custkey, 'o_' || o_orderkey FROM orders
  UNION ALL SELECT DISTINCT 'o_' || l_orderkey, 'l_' || l_orderkey || '_' || l_linenumber FROM lineitem)
"""


def text_lines(spark, sf_dir) -> DataFrame:
    """(doc_id, n, line): every seventh line of a document is a comment."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "raw"))
    return rows.select("doc_id", "n", F.when(F.col("n") % 7 == 0, F.concat(F.lit("#"), "raw")).otherwise(F.col("raw")).alias("line"))


LINES = """
lines AS (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS n, CASE WHEN (i - 1) % 7 = 0 THEN '#' || raw ELSE raw END AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
"""


def artifacts(spark, sf_dir) -> DataFrame:
    """(path, ord) from documents."""
    d = load(spark, sf_dir, "documents")
    return d.select(F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit("."), "lang", F.lit(".txt")).alias("path"), F.col("doc_id").alias("ord"))


ARTIFACTS = "artifacts AS (SELECT source || '_' || doc_id || '.' || lang || '.txt' AS path, doc_id AS ord FROM documents)"


def event_files(spark, sf_dir) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("s_"), F.col("user_id").cast("string"), F.lit("_"), F.col("event_id").cast("string"), F.lit("."), "event_type").alias("path"), "event_id", "user_id", "event_type", _ms("ts").alias("ts_ms"))


EVENT_FILES = "files AS (SELECT 's_' || user_id || '_' || event_id || '.' || event_type AS path, event_id, user_id, event_type, (epoch_us(ts) // 1000) AS ts_ms FROM events)"


def bed(spark, sf_dir) -> DataFrame:
    start = F.col("p_partkey") * 100
    return load(spark, sf_dir, "part").select(F.col("p_brand").alias("chr"), start.alias("start"), (start + F.col("p_size") * 10).alias("end"), F.col("p_partkey").alias("id"))


BED = 'bed AS (SELECT p_brand AS chr, p_partkey * 100 AS "start", p_partkey * 100 + p_size * 10 AS "end", p_partkey AS id FROM part)'


# ---------------------------------------------------------------- run statistics


@query(f"""
WITH {COMMANDS}, ok AS (SELECT *, exit_code = 0 AND start_ms > 0 AS valid, stop_ms - start_ms AS ms FROM commands)
SELECT stage, count(*) AS n_commands, count(*) FILTER (WHERE valid) AS n_valid, min(ms) FILTER (WHERE valid) AS min_ms,
       round(avg(ms) FILTER (WHERE valid), 3) AS mean_ms, max(ms) FILTER (WHERE valid) AS max_ms,
       CAST(floor(sum(ms) FILTER (WHERE valid) / 1000) AS BIGINT) AS weight_s, max(procs) FILTER (WHERE valid) AS max_procs,
       CAST(sum(bytes) FILTER (WHERE valid) AS BIGINT) AS input_bytes,
       min(start_ms) FILTER (WHERE valid) - (SELECT min(start_ms) FROM ok WHERE start_ms > 0) AS rel_start,
       max(stop_ms) FILTER (WHERE valid) - (SELECT min(start_ms) FROM ok WHERE start_ms > 0) AS rel_end
FROM ok GROUP BY stage HAVING count(*) FILTER (WHERE valid) > 0
""")
def stage_stats(spark, sf_dir):
    return stats.stage_stats(commands(spark, sf_dir))


@query(f"""
WITH {COMMANDS}
SELECT count(*) AS n_commands, bool_and(exit_code = 0) AS succeeded, CAST(sum(stop_ms - start_ms) AS BIGINT) AS command_ms,
       round(CAST(sum((stop_ms - start_ms) * procs) FILTER (WHERE start_ms > 0 AND stop_ms > start_ms) AS DOUBLE) / 3600000, 4) AS cpu_hours FROM commands
""")
def run_totals(spark, sf_dir):
    return stats.run_totals(commands(spark, sf_dir), 0)


@query(f"""
WITH {COMMANDS}, first AS (SELECT stage, min(start_ms) AS s FROM commands WHERE start_ms > 0 AND stage IS NOT NULL GROUP BY stage)
SELECT l_orderkey, l_linenumber, stage, stop_ms - start_ms AS ms, start_ms - s AS rel_start, stop_ms - s AS rel_end
FROM commands JOIN first USING (stage) WHERE start_ms > 0
""")
def stage_instances(spark, sf_dir):
    return stats.instances(commands(spark, sf_dir), ["l_orderkey", "l_linenumber"])


@query(f"WITH {COMMANDS} SELECT status, count(*) AS n, count(*) FILTER (WHERE exit_code <> 0) AS n_failed FROM commands GROUP BY status")
def status_summary(spark, sf_dir):
    return stats.status_summary(commands(spark, sf_dir))


@query("""
SELECT o_custkey AS directory, o_orderkey AS job, (epoch_us(o_orderdate) // 1000) AS start_ms FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
""")
def jobs_latest_per_dir(spark, sf_dir):
    jobs = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("directory"), F.col("o_orderkey").alias("job"), _ms("o_orderdate").alias("start_ms"))
    return stats.latest_by(jobs, "directory", "start_ms")


@query("""
SELECT event_type AS message, count(*) AS n, count(DISTINCT user_id) AS n_branches, count(DISTINCT event_id % 7) AS n_stages FROM events GROUP BY event_type
""")
def error_summary(spark, sf_dir):
    return stats.error_summary(load(spark, sf_dir, "events").select(F.col("event_type").alias("message"), F.col("user_id").alias("branch"), (F.col("event_id") % 7).alias("stage")))


# ---------------------------------------------------------------- lines and rows


@query(f"WITH {LINES} SELECT doc_id, n, line FROM lines WHERE NOT starts_with(line, '#') AND regexp_matches(line, 'tion.*the')")
def grep_lines(spark, sf_dir):
    return lines.grep(text_lines(spark, sf_dir), "tion.*the")


@query(f"WITH {LINES} SELECT doc_id, n, line FROM lines WHERE starts_with(line, '#') OR length(line) > 200")
def filter_lines_keep_comments(spark, sf_dir):
    return lines.filter_lines(text_lines(spark, sf_dir), F.length("line") > 200)


@query("""
WITH rows AS (SELECT CASE WHEN n_nationkey % 7 = 0 THEN '#' ELSE '' END || n_nationkey || chr(9) || n_name || chr(9) || n_regionkey AS line, n_regionkey FROM nation)
SELECT line FROM rows WHERE starts_with(line, '#') OR n_regionkey = 2
""")
def filter_rows_tsv(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    rows = n.select(F.concat(F.when(F.col("n_nationkey") % 7 == 0, "#").otherwise(""), F.concat_ws("\t", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string"))).alias("line"))
    return lines.filter_rows(rows, ["id", "name", "region"], lambda c: c["region"] == "2")


@query("""
WITH w AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, user_id, event_type FROM w WHERE before IS NULL OR before IS DISTINCT FROM event_type
""")
def remove_runs(spark, sf_dir):
    return lines.without_runs(load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), "event_type", ["ts", "event_id"], ["user_id"]).drop("ts")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def tail_last_k(spark, sf_dir):
    return lines.last_lines(load(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", 2).drop("from_end")


@query("""
WITH l AS (SELECT role, conv_id, turn, replace(text, chr(10), ' ') AS content FROM conversations WHERE text IS NOT NULL)
SELECT role AS branch, conv_id AS command_id, count(*) AS n_lines, string_agg(ltrim(content, ' ' || chr(9)), chr(10) ORDER BY turn, ltrim(content, ' ' || chr(9))) AS content FROM l GROUP BY role, conv_id
""")
def log_demultiplex(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").where("text IS NOT NULL")
    log = c.select(F.concat(F.lit("["), "role", F.lit("."), F.col("conv_id").cast("string"), F.lit("]\t"), F.replace("text", F.lit("\n"), F.lit(" "))).alias("line"), F.col("turn").alias("n"))
    return files.demultiplexed(log)


# ---------------------------------------------------------------- splits and lanes


@query(f"""
WITH {ARTIFACTS}, k AS (SELECT path, regexp_extract(path, '^([^/]*?)_[^/]*', 1) AS key, ord FROM artifacts)
SELECT key, path, ord, CAST(row_number() OVER (PARTITION BY key ORDER BY CAST(regexp_extract(path, '_([0-9]+)', 1) AS BIGINT), ord) - 1 AS INTEGER) AS place FROM k
""")
def split_single_key(spark, sf_dir):
    return split.split(artifacts(spark, sf_dir), split.compile_pattern("%_*"))


@query(f"""
WITH {EVENT_FILES}, k AS (SELECT *, regexp_extract(path, 's_([^/]*?)_', 1) || '.' || regexp_extract(path, '[.]([^/]*)$', 1) AS key FROM files)
SELECT key, path, event_id, user_id, event_type, ts_ms, CAST(row_number() OVER (PARTITION BY key ORDER BY event_id) - 1 AS INTEGER) AS place FROM k
""")
def split_multi_key_ordered(spark, sf_dir):
    return split.split(event_files(spark, sf_dir), split.compile_pattern("s_%_*.%"), tie="event_id")


@query(r"""
WITH k AS (SELECT page_id, url AS path, regexp_extract(url, '^https?://([^/]+)/', 1) AS key FROM pages WHERE regexp_matches(url, '^https?://([^/]+)/'))
SELECT key, count(*) AS n, min(page_id) AS first_page FROM k GROUP BY key
""")
def regex_split(spark, sf_dir):
    p = split.regex_pattern("^https?://([^/]+)/")
    pages = load(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    return pages.where(F.col("path").rlike(p.regex)).groupBy(split.key(p).alias("key")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query("""
SELECT k.branch, s.segment, n_name FROM nation, (VALUES ('1'), ('10'), ('2')) k(branch), (VALUES ('align'), ('qc')) s(segment)
""")
def fanout_cross(spark, sf_dir):
    keyed = [10, 2, "1", 1] * lanes.Stage("keep", lambda d: d.select("branch", "n_name"))
    both = lanes.as_plan({"align": keyed, "qc": keyed})
    plan = lanes.Stage("names", lambda d: d.select("n_name")) + both
    return plan(load(spark, sf_dir, "nation")).select("segment", "n_name", "branch")


@query("SELECT r_name AS branch, n_name FROM region JOIN nation ON r_regionkey = n_regionkey")
def fanout_map(spark, sf_dir):
    mapping = load(spark, sf_dir, "region").join(load(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("branch"), "n_nationkey")
    return lanes.by_map(mapping, "n_nationkey")(load(spark, sf_dir, "nation").select("n_nationkey", "n_name")).select("branch", "n_name")


@query("SELECT event_type AS branch, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def dynamic_split(spark, sf_dir):
    plan = lanes.by_column("event_type") * lanes.Stage("sum", lambda d: d.groupBy("branch").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")))
    return plan(load(spark, sf_dir, "events"))


@query("""
SELECT CAST(o_custkey AS VARCHAR) AS branch, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY o_custkey
""")
def channel_resume_join(spark, sf_dir):
    channel = load(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    plan = lanes.by_channel(channel, "o_custkey") * lanes.Stage("count", lambda d: d.groupBy("branch").agg(F.count("*").alias("n")))
    return plan(load(spark, sf_dir, "orders"))


@query("""
WITH target AS (SELECT o_orderpriority AS branch, o_orderkey AS id FROM orders WHERE o_orderstatus = 'P'),
     source AS (SELECT o_orderpriority AS branch, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000)
SELECT branch, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT * FROM target UNION ALL SELECT * FROM source WHERE branch IN (SELECT branch FROM target)) GROUP BY branch
""")
def channel_forward(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("branch"), F.col("o_orderkey").alias("id"), "o_orderstatus", "o_totalprice")
    both = lanes.forward(o.where("o_orderstatus = 'F' AND o_totalprice > 300000").select("branch", "id"), o.where("o_orderstatus = 'P'").select("branch", "id"))
    return both.groupBy("branch").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("""
WITH u AS (SELECT c_nationkey AS path, 'a' AS branch, c_custkey AS ord FROM customer UNION ALL SELECT s_nationkey, 'b', s_suppkey FROM supplier)
SELECT path, branch, ord FROM u QUALIFY row_number() OVER (PARTITION BY path ORDER BY branch, ord) = 1
""")
def merge_union_distinct(spark, sf_dir):
    a = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("path"), F.lit("a").alias("branch"), F.col("c_custkey").alias("ord"))
    b = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("path"), F.lit("b").alias("branch"), F.col("s_suppkey").alias("ord"))
    return lanes.merge(a.unionByName(b))


@query("""
SELECT CAST(c_custkey AS BIGINT) AS position, c_mktsegment AS stage, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderpriority, o_orderkey) AS outputs
FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_mktsegment
""")
def merge_grouped_stages(spark, sf_dir):
    c, o = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    rows = c.join(o, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_custkey").alias("position"), F.col("c_mktsegment").alias("stage"), F.col("o_orderpriority").alias("branch"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("path"))
    return lanes.merge_stages(rows).withColumn("outputs", F.array_join("outputs", ","))


@query(f"WITH {ARTIFACTS} SELECT ord, regexp_replace(path, '^(.*?)[.](en|fr|de|es)[.]', '\\1.merge.') AS merged FROM artifacts")
def merge_point_names(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "lang")
    return artifacts(spark, sf_dir).join(d, F.col("ord") == F.col("doc_id")).select("ord", naming.merged_name("path", "lang").alias("merged"))


# ---------------------------------------------------------------- input resolution


@query(f"""
WITH {EVENT_FILES}, asked AS (SELECT event_id AS request_id, user_id, 'click' AS suffix, ts_ms FROM files WHERE event_type = 'purchase'),
level AS (SELECT a.request_id, a.user_id, max(f.ts_ms) AS stage_seq FROM asked a JOIN files f ON f.user_id = a.user_id AND f.event_type = a.suffix AND f.ts_ms < a.ts_ms GROUP BY ALL)
SELECT request_id, l.user_id, 'click' AS suffix, stage_seq, path FROM level l JOIN files f ON f.user_id = l.user_id AND f.event_type = 'click' AND f.ts_ms = stage_seq
""")
def resolve_nearest(spark, sf_dir):
    f = event_files(spark, sf_dir).select("path", "event_id", "user_id", F.col("event_type").alias("suffix"), F.col("ts_ms").alias("seq"))
    asked = f.where("suffix = 'purchase'").select(F.col("event_id").alias("request_id"), "user_id", F.lit("click").alias("suffix"), "seq")
    return resolve.nearest(asked, f, ["user_id"])


@query(f"WITH {EVENT_FILES} SELECT path, user_id, event_type FROM files QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts_ms DESC, event_id) = 2")
def resolve_nth(spark, sf_dir):
    return resolve.nth_match(event_files(spark, sf_dir), ["user_id", "event_type"], [F.desc("ts_ms"), F.asc("event_id")], 2).select("path", "user_id", "event_type")


@query("""
SELECT c_custkey, coalesce(CAST(last AS VARCHAR), '') AS last_order FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS last FROM orders GROUP BY 1) ON c_custkey = o_custkey
""")
def resolve_optional(spark, sf_dir):
    last = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("last_order"))
    return resolve.optional(load(spark, sf_dir, "customer").select("c_custkey"), last, "c_custkey", "last_order")


@query(f"WITH {EVENT_FILES} SELECT path, event_type AS ext, CAST(CASE event_type WHEN 'purchase' THEN 0 ELSE 1 END AS INTEGER) AS rank FROM files WHERE event_type IN ('purchase', 'click')")
def virtual_extension(spark, sf_dir):
    return naming.virtual_extension(event_files(spark, sf_dir).select("path"), {"action": ["purchase", "click"]}, "action").select("path", "ext", "rank")


@query("""
SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber = 1 THEN 'first' WHEN l_linenumber = 2 THEN 'second' END, 'line' || l_linenumber) AS path FROM lineitem
""")
def aliases(spark, sf_dir):
    named = spark.createDataFrame([("line1", "first"), ("line2", "second")], "path string, to string")
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("line"), F.col("l_linenumber").cast("string")).alias("path"))
    return resolve.aliased(rows, named).select("l_orderkey", "l_linenumber", "path")


@query("""
WITH a AS (SELECT n_regionkey AS k, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS place FROM nation),
     b AS (SELECT c_nationkey % 5 AS k, c_name, row_number() OVER (PARTITION BY c_nationkey % 5 ORDER BY c_custkey) AS place FROM customer)
SELECT k, CAST(place AS INTEGER) AS place, n_name, c_name FROM a JOIN b USING (k, place)
""")
def positional_zip(spark, sf_dir):
    a = load(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k"), "n_name", F.col("n_nationkey").cast("long").alias("ord"))
    b = load(spark, sf_dir, "customer").select((F.col("c_nationkey") % 5).alias("k"), "c_name", F.col("c_custkey").alias("ord"))
    return resolve.zipped(a, b, ["k"], "ord")


SETTINGS = [("default", "", "threads", "1"), ("default", "", "queue", "long"), ("stage", "1-URGENT", "threads", "4"), ("stage", "5-LOW", "threads", "8"), ("command", "O", "queue", "short")]


@query("""
SELECT o_orderkey AS id, 'threads' AS key, CASE o_orderpriority WHEN '1-URGENT' THEN '4' WHEN '5-LOW' THEN '8' ELSE '1' END AS value FROM orders
UNION ALL SELECT o_orderkey, 'queue', CASE o_orderstatus WHEN 'O' THEN 'short' ELSE 'long' END FROM orders
""")
def config_precedence(spark, sf_dir):
    c = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("stage"), F.col("o_orderstatus").alias("config"))
    return resolve.configured(c, spark.createDataFrame(SETTINGS, "level string, name string, key string, value string"))


@query(f"WITH {EVENT_FILES}, g AS (SELECT * FROM (VALUES ('*.click', '%.click'), ('s_1_*', 's!_1!_%'), ('*.view', '%.view')) v(pattern, l)) SELECT pattern, count(*) FILTER (WHERE path LIKE l ESCAPE '!') AS n FROM files, g GROUP BY pattern")
def glob_counts(spark, sf_dir):
    return resolve.glob_counts(event_files(spark, sf_dir), ["*.click", "s_1_*", "*.view"])


@query('SELECT r_name AS parent, n_name AS branch, CAST(dense_rank() OVER (PARTITION BY r_name ORDER BY n_name) - 1 AS INTEGER) AS "index" FROM nation JOIN region ON r_regionkey = n_regionkey')
def branch_index(spark, sf_dir):
    both = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return resolve.branch_index(both.select(F.col("r_name").alias("parent"), F.col("n_name").alias("branch")))


@query("""
SELECT c_custkey AS request_id, 'load' AS stage, path FROM customer JOIN (SELECT n_nationkey AS k, n_name AS path FROM nation UNION ALL SELECT n_nationkey, r_name FROM nation JOIN region ON r_regionkey = n_regionkey) ON k = c_nationkey
""")
def resolve_from_stage(spark, sf_dir):
    text = lambda c: F.col(c).cast("string")
    nation = load(spark, sf_dir, "nation")
    region = load(spark, sf_dir, "region")
    made = nation.select(F.lit("load").alias("stage"), F.array(text("n_regionkey"), text("n_nationkey")).alias("branch_path"), F.col("n_name").alias("path")).unionByName(region.select(F.lit("load").alias("stage"), F.array(text("r_regionkey")).alias("branch_path"), F.col("r_name").alias("path")))
    asked = load(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("request_id"), F.lit("load").alias("stage"), F.array(text("n_regionkey"), text("n_nationkey"), text("c_custkey")).alias("branch_path"))
    return resolve.from_stages(made, asked).select("request_id", "stage", "path")


# ---------------------------------------------------------------- names


@query(f"WITH {ARTIFACTS} SELECT ord, regexp_replace(path, '[.][^.]*$', '') || '.csv' AS output, 'txt' AS ext FROM artifacts")
def name_transform(spark, sf_dir):
    return artifacts(spark, sf_dir).select("ord", naming.transform_name("path", "csv").alias("output"), scalars.ext("path").alias("ext"))


@query(f"WITH {ARTIFACTS} SELECT ord, regexp_replace(path, '[.]txt$', '.clean.txt') AS output FROM artifacts")
def name_filter(spark, sf_dir):
    return artifacts(spark, sf_dir).select("ord", naming.filter_name("path", "clean").alias("output"))


@query(f"WITH {EVENT_FILES} SELECT event_id, 's_' || user_id || '_' || event_id AS prefix, event_type AS ext, 's_' || user_id || '_' || event_id || CASE WHEN event_type = 'view' THEN '.load.view' ELSE '.view' END AS output FROM files")
def name_prefix_ext(spark, sf_dir):
    return event_files(spark, sf_dir).select("event_id", scalars.prefix("path").alias("prefix"), scalars.ext("path").alias("ext"), naming.transform_name("path", "view", stage="load").alias("output"))


@query("""
WITH f AS (SELECT 'nation_' || n_nationkey || '.txt' AS path, row_number() OVER (ORDER BY n_nationkey) - 1 AS place FROM nation WHERE n_nationkey < 3),
     t AS (SELECT * FROM (VALUES (0, 'csv', 0), (1, 'bam', 0), (2, 'csv', 1), (3, 'csv', 2), (4, 'csv', 3)) x("at", target, turn))
SELECT "at", path, target, regexp_replace(path, '[.]txt$', '.' || target) AS output FROM t JOIN f ON place = turn % 3
""")
def name_transform_n_to_m(spark, sf_dir):
    f = load(spark, sf_dir, "nation").where("n_nationkey < 3").select(F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string"), F.lit(".txt")).alias("path"), F.col("n_nationkey").alias("ord"))
    return naming.n_to_m(f, ["csv", "bam", "csv", "csv", "csv"])


@query(f"WITH {ARTIFACTS} SELECT ord, 'out/' || path AS output, sha1('cp_' || path) AS fingerprint FROM artifacts")
def fingerprint(spark, sf_dir):
    return artifacts(spark, sf_dir).select("ord", naming.in_folder("out", "path").alias("output"), scalars.fingerprint(F.lit("cp"), "path").alias("fingerprint"))


# ---------------------------------------------------------------- intervals


@query(f'WITH {BED} SELECT id, chr, greatest("start" - 250, 0) AS "start", "end" + 250 AS "end" FROM bed')
def region_bed_padding(spark, sf_dir):
    return regions.padded(bed(spark, sf_dir), 250)


@query(f"""
WITH {BED}, p AS (SELECT *, unnest(generate_series("start", greatest("end" - 1, "start"), 150)) AS part_start FROM bed)
SELECT id, chr, "start", "end", part_start, least(part_start + 150, "end") AS part_end FROM p
""")
def region_partition(spark, sf_dir):
    return regions.partition(bed(spark, sf_dir), 150)


@query(f"""
WITH {BED}, wide AS (SELECT chr, greatest("start" - 900, 0) AS s, "end" + 900 AS e, id FROM bed)
SELECT a.chr, a.id AS l_id, b.id AS r_id, greatest(a."start", b.s) AS "start", least(a."end", b.e) AS "end" FROM bed a JOIN wide b ON a.chr = b.chr AND a."start" <= b.e AND b.s <= a."end"
""")
def region_overlap(spark, sf_dir):
    b = bed(spark, sf_dir)
    return regions.overlaps(b.withColumnRenamed("id", "l_id"), regions.padded(b, 900).withColumnRenamed("id", "r_id"), 2000)


@query(f'WITH {BED} SELECT chr, min("start") AS range_from, max("end") AS range_to, CAST(1 AS BIGINT) AS n_chr, CAST(sum("end" - "start") AS BIGINT) AS total_size FROM bed GROUP BY chr')
def region_size_summary(spark, sf_dir):
    return regions.summary(bed(spark, sf_dir).withColumn("key", F.col("chr")), ["key"]).withColumnRenamed("key", "chr")


@query(f"WITH {BED} SELECT id, chr || ':' || \"start\" || '-' || \"end\" AS region, left(sha1(chr || ':' || \"start\" || '-' || \"end\"), 8) AS region_id FROM bed")
def region_text(spark, sf_dir):
    return bed(spark, sf_dir).withColumn("region", regions.text()).select("id", "region", regions.region_id("region").alias("region_id"))


@query()
def region_split_balanced(spark, sf_dir):
    return regions.split_balanced(regions.summary(bed(spark, sf_dir).withColumn("key", F.col("chr")), ["key"]).select(F.col("key").alias("chr"), F.col("range_from").alias("start"), F.col("range_to").alias("end")), 7)


@query()
def region_split_sequential(spark, sf_dir):
    return regions.split_sequential(bed(spark, sf_dir), 40, 5000)


@query("""
WITH l AS (SELECT 'chr' || CASE WHEN p_partkey % 9 = 0 THEN 'X' WHEN p_partkey % 9 = 1 THEN 'M' WHEN p_partkey % 9 = 2 THEN 'Un' || p_partkey % 4 ELSE CAST(p_partkey % 23 + 1 AS VARCHAR) END AS chr FROM part),
d AS (SELECT DISTINCT chr, substr(chr, 4) AS n FROM l)
SELECT chr, row_number() OVER (ORDER BY CASE WHEN regexp_matches(n, '^[0-9]+$') THEN CAST(n AS INTEGER) WHEN n = 'X' THEN 1000001 WHEN n = 'M' THEN 1000003 ELSE 2000000 END, n) AS place FROM d
""")
def chromosome_order(spark, sf_dir):
    k = F.col("p_partkey")
    label = F.when(k % 9 == 0, "X").when(k % 9 == 1, "M").when(k % 9 == 2, F.concat(F.lit("Un"), (k % 4).cast("string"))).otherwise((k % 23 + 1).cast("string"))
    names = load(spark, sf_dir, "part").select(F.concat(F.lit("chr"), label).alias("chr")).distinct()
    return names.select("chr", F.row_number().over(Window.orderBy(regions.chromosome_rank())).cast("long").alias("place"))  # labels, not rows


CONTIGS = ["1", "chr2", "X", "M", "chrM", "GL000191.1", "Un_gl000211", "chrUn_KI270302v1", "chr1_KI270706v1_random", "chr6_apd_hap1", "chr1_KI270762v1_alt", "chr1_fix", "chrEBV", "HLA-A", "NC_007605"]


@query("SELECT * FROM (VALUES ('1'), ('chr2'), ('X')) v(chr)")
def minor_contigs(spark, sf_dir):
    return regions.without_minor_contigs(spark.createDataFrame([(c,) for c in CONTIGS], "chr string"))


# ---------------------------------------------------------------- provenance


@query("""
WITH i AS (SELECT l_orderkey AS k, max((epoch_us(l_shipdate) // 1000)) AS latest FROM lineitem GROUP BY 1)
SELECT o_orderkey AS k, (epoch_us(o_orderdate) // 1000) AS ts FROM orders LEFT JOIN i ON o_orderkey = k WHERE latest > (epoch_us(o_orderdate) // 1000)
""")
def stale_outputs(spark, sf_dir):
    out = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), _ms("o_orderdate").alias("ts"))
    return lineage.out_of_date(out, load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), _ms("l_shipdate").alias("ts")), "k")


@query("""
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE CASE WHEN l_shipdate < o_orderdate THEN FALSE WHEN l_shipdate > o_orderdate THEN TRUE WHEN l_linenumber = 0 THEN TRUE ELSE l_linenumber >= 3 END GROUP BY ALL
""")
def newer_inputs_tiebreak(spark, sf_dir):
    items = dealt(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), "l_orderkey")
    both = items.join(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    newer = lineage.is_newer(_ms("l_shipdate"), _ms("o_orderdate"), F.col("l_linenumber"), F.lit(3))
    return both.where(newer).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


UP = """
WITH RECURSIVE {graph}, up(origin, node, level) AS (
  SELECT node, node, 0 FROM nodes WHERE {start} UNION ALL SELECT origin, {there}, level + 1 FROM up JOIN edges ON {here} = node)
SELECT DISTINCT origin, node, level FROM up WHERE level > 0
"""


@query(UP.format(graph=GRAPH, start="starts_with(node, 'o_')", here="dst", there="src"))
def lineage_ancestors(spark, sf_dir):
    nodes, edges = nodes_and_edges(spark, sf_dir)
    return lineage.ancestors(edges, nodes.where(F.col("node").startswith("o_")), depth=4)


@query(UP.format(graph=GRAPH, start="starts_with(node, 'n_')", here="src", there="dst"))
def lineage_descendants(spark, sf_dir):
    nodes, edges = nodes_and_edges(spark, sf_dir)
    return lineage.descendants(edges, nodes.where(F.col("node").startswith("n_")), depth=4)


@query(f"""
WITH {GRAPH}, stub AS (SELECT node FROM nodes WHERE starts_with(node, 'c_') AND CAST(substr(node, 3) AS BIGINT) % 3 = 0),
o AS (SELECT dst AS node FROM edges JOIN stub ON src = node)
SELECT node FROM stub UNION SELECT node FROM o UNION SELECT dst FROM edges JOIN o ON src = o.node
""")
def stub_propagation(spark, sf_dir):
    nodes, edges = nodes_and_edges(spark, sf_dir)
    return lineage.stubs(nodes.withColumn("stub", F.col("node").startswith("c_") & (F.substring_index("node", "_", -1).cast("long") % 3 == 0)), edges, depth=2)


@query(f"""
WITH {GRAPH} SELECT dst AS node, src || '/' || dst AS path, CAST(1 AS INTEGER) AS level FROM edges WHERE starts_with(src, 'r_')
UNION ALL SELECT node, node, 0 FROM nodes WHERE starts_with(node, 'r_')
UNION ALL SELECT b.dst, a.src || '/' || a.dst || '/' || b.dst, 2 FROM edges a JOIN edges b ON b.src = a.dst WHERE starts_with(a.src, 'r_')
""")
def lineage_outline(spark, sf_dir):
    return lineage.outline(*nodes_and_edges(spark, sf_dir), depth=2)


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS output_path, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END, 'Unknown') AS stage, '-' AS command,
       CAST(NULL AS BIGINT) AS pending_ms, epoch_us(l_shipdate) // 1000 - epoch_us(o_orderdate) // 1000 AS running_ms, '-' AS tools
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1
""")
def provenance_rows(spark, sf_dir):
    both = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "lineitem").where("l_linenumber = 1"), F.col("o_orderkey") == F.col("l_orderkey"))
    out = both.select(F.col("o_orderkey").cast("string").alias("output_path"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("stage"), F.lit(None).cast("string").alias("command"), F.lit(0).cast("long").alias("create_ms"), _ms("o_orderdate").alias("start_ms"), _ms("l_shipdate").alias("stop_ms"), F.lit(None).cast("string").alias("tools"))
    return lineage.provenance(out)


@query(f"WITH {GRAPH} SELECT node, ts FROM nodes WHERE node NOT IN (SELECT src FROM edges)")
def lineage_leaves(spark, sf_dir):
    return lineage.leaves(*nodes_and_edges(spark, sf_dir))


@query(f"WITH {GRAPH} SELECT node, ts FROM nodes WHERE node NOT IN (SELECT dst FROM edges)")
def lineage_roots(spark, sf_dir):
    return lineage.roots(*nodes_and_edges(spark, sf_dir))


@query(f"""
WITH {GRAPH}, o AS (SELECT l.node AS line, l.ts AS lts, c.node AS ord, c.ts AS ots FROM edges JOIN nodes l ON l.node = dst JOIN nodes c ON c.node = src WHERE starts_with(dst, 'l_'))
SELECT line AS node, greatest(lts, ots) AS max_ts FROM o UNION ALL SELECT node, ts FROM nodes WHERE NOT starts_with(node, 'l_')
""")
def lineage_max_ts(spark, sf_dir):
    nodes, edges = nodes_and_edges(spark, sf_dir)
    return lineage.max_timestamps(nodes, edges)


@query("""
WITH l AS MATERIALIZED (SELECT l_orderkey AS o, l_linenumber AS n, max(epoch_us(l_shipdate) // 1000) AS ts FROM lineitem GROUP BY 1, 2),
o AS MATERIALIZED (SELECT o_orderkey AS o, epoch_us(o_orderdate) // 1000 AS ts FROM orders),
line AS MATERIALIZED (SELECT l.o, l.n, NOT (o.ts >= l.ts) AS fresh FROM l JOIN o ON o.o = l.o),
ord AS (SELECT o.o, CASE WHEN o.o % 5 <> 0 THEN TRUE ELSE coalesce(bool_and(line.fresh), FALSE) END AS fresh FROM o LEFT JOIN line ON line.o = o.o GROUP BY o.o)
SELECT 'l_' || o || '_' || n AS node, fresh FROM line UNION ALL SELECT 'o_' || o, fresh FROM ord UNION ALL SELECT 'c_' || c_custkey, FALSE FROM customer
UNION ALL SELECT 'n_' || n_nationkey, FALSE FROM nation UNION ALL SELECT 'r_' || r_regionkey, TRUE FROM region
""")
def lineage_up_to_date(spark, sf_dir):
    nodes, edges = nodes_and_edges(spark, sf_dir)
    gone = F.col("node").startswith("o_") & (F.substring_index("node", "_", -1).cast("long") % 5 == 0)
    return lineage.up_to_date(nodes.withColumn("file_exists", ~gone).withColumn("cleaned", gone), edges)


@query(f"""
WITH {GRAPH}, state AS (SELECT node, hash_key % 11 <> 0 AS file_exists, hash_key % 13 = 0 AS preserve, hash_key % 17 = 0 AS intermediate FROM (SELECT node, CAST(regexp_extract(node, '_([0-9]+)', 1) AS BIGINT) AS hash_key FROM nodes))
SELECT node FROM state WHERE file_exists AND NOT preserve AND (intermediate OR node IN (SELECT src FROM edges))
""")
def cleanup_candidates(spark, sf_dir):
    nodes, edges = nodes_and_edges(spark, sf_dir)
    k = F.regexp_extract("node", "_([0-9]+)", 1).cast("long")
    return lineage.cleanup_candidates(nodes.withColumn("file_exists", k % 11 != 0).withColumn("preserve", k % 13 == 0).withColumn("intermediate", k % 17 == 0).withColumn("accompanies", F.lit(None).cast("string")), edges)


@query(f"""
WITH {GRAPH}, state AS (SELECT node, k % 11 <> 0 AS file_exists, k % 13 = 0 AS preserve, k % 17 = 0 AS intermediate, k AS size FROM (SELECT node, CAST(regexp_extract(node, '_([0-9]+)', 1) AS BIGINT) AS k FROM nodes))
SELECT count(*) AS n_files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM state WHERE file_exists AND NOT preserve AND (intermediate OR node IN (SELECT src FROM edges))
""")
def cleanup_totals(spark, sf_dir):
    nodes, edges = nodes_and_edges(spark, sf_dir)
    k = F.regexp_extract("node", "_([0-9]+)", 1).cast("long")
    return lineage.cleanup_totals(nodes.withColumn("file_exists", k % 11 != 0).withColumn("preserve", k % 13 == 0).withColumn("intermediate", k % 17 == 0).withColumn("accompanies", F.lit(None).cast("string")).withColumn("size", k), edges)


@query("SELECT l_orderkey AS output, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) AS inputs FROM lineitem GROUP BY l_orderkey")
def group_outputs_by_inputs(spark, sf_dir):
    return lineage.grouped_by_inputs(load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("output"), F.col("l_partkey").cast("string").alias("input")))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id % 10 <> 0")
def missing_files(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 10 == 0).alias("cleaned"))
    return lineage.missing(d, load(spark, sf_dir, "labels").select("doc_id"), "doc_id").select("doc_id")


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_outputs(spark, sf_dir):
    return files.duplicate_outputs(load(spark, sf_dir, "documents").select("text"), "text")


@query(f"""
WITH {GRAPH}, leaf AS (SELECT node, ts FROM nodes WHERE node NOT IN (SELECT src FROM edges))
SELECT node, ts FROM leaf ORDER BY ts DESC, node LIMIT 5
""")
def final_outputs_top5(spark, sf_dir):
    return lineage.leaves(*nodes_and_edges(spark, sf_dir)).orderBy(F.desc("ts"), "node").limit(5)


@query("SELECT source AS stage, count(*) AS n_checks, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS n_failed FROM labels JOIN documents USING (doc_id) GROUP BY source")
def checks_failed(spark, sf_dir):
    c = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select(F.col("source").alias("stage"), (F.col("quality") == 1).alias("passed"), (F.col("toxic") == 1).alias("override"))
    return checks.summary(c, ["stage"])


@query("""
WITH n AS (SELECT o_orderkey AS k, o_custkey AS parent, o_orderstatus = 'O' AS preserve, o_orderkey % 11 <> 0 AS file_exists, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 1 END AS with_k FROM orders),
own AS (SELECT k FROM n WHERE file_exists AND NOT preserve AND k IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2))
SELECT k AS node FROM own UNION SELECT k FROM n WHERE file_exists AND NOT preserve AND with_k IN (SELECT k FROM own)
""")
def cleanup_accompanying(spark, sf_dir):
    k = F.col("o_orderkey")
    nodes = load(spark, sf_dir, "orders").select(k.alias("node"), (F.col("o_orderstatus") == "O").alias("preserve"), (k % 11 != 0).alias("file_exists"), F.lit(False).alias("intermediate"), F.when(k % 3 == 0, k + 1).alias("accompanies"))
    edges = load(spark, sf_dir, "lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("src"), F.lit(-1).cast("long").alias("dst"))
    return lineage.cleanup_candidates(nodes, edges)


@query(f"""
WITH RECURSIVE {GRAPH}, asked AS (SELECT node FROM nodes WHERE node IN ('n_3', 'n_7')),
down(node) AS (SELECT node FROM asked UNION SELECT dst FROM down JOIN edges ON src = node), up(node) AS (SELECT node FROM asked UNION SELECT src FROM up JOIN edges ON dst = node),
every AS (SELECT node FROM down UNION SELECT node FROM up)
SELECT src, dst FROM edges WHERE src IN (SELECT node FROM every) AND dst IN (SELECT node FROM every)
""")
def lineage_neighbourhood(spark, sf_dir):
    nodes, edges = nodes_and_edges(spark, sf_dir)
    return lineage.neighbourhood(edges, nodes.where("node IN ('n_3', 'n_7')"), 4)


@query("SELECT o_orderkey AS node, o_orderstatus = 'F' OR o_orderpriority = '1-URGENT' AS preserve FROM orders")
def lineage_marked(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), (F.col("o_orderstatus") == "F").alias("preserve"), "o_orderpriority")
    return lineage.marked(o.drop("o_orderpriority"), "preserve", o.where("o_orderpriority = '1-URGENT'").select("node"))


@query("SELECT o_orderkey AS node, CASE WHEN o_orderstatus = 'P' THEN 1700000000000 ELSE epoch_us(o_orderdate) // 1000 END AS ts FROM orders")
def lineage_touched(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), _ms("o_orderdate").alias("ts"), "o_orderstatus")
    return lineage.touched(o.drop("o_orderstatus"), o.where("o_orderstatus = 'P'").select("node"), 1_700_000_000_000)


@query("""
WITH new AS (SELECT o_orderkey AS k, o_custkey + 1 AS src FROM orders WHERE o_orderstatus = 'P')
SELECT o_custkey AS src, o_orderkey AS dst FROM orders WHERE o_orderkey NOT IN (SELECT k FROM new) UNION ALL SELECT src, k FROM new UNION ALL SELECT src, -k FROM new
""")
def lineage_added(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    nodes, edges = o.select(F.col("o_orderkey").alias("node")), o.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    new = o.where("o_orderstatus = 'P'").select((F.col("o_custkey") + 1).alias("src"), F.explode(F.array("o_orderkey", -F.col("o_orderkey"))).alias("dst"))
    return lineage.added(nodes, edges, new.select(F.col("dst").alias("node")), new)[1]


@query("SELECT o_orderkey AS output FROM orders WHERE o_orderkey % 4 = 0")
def modified_commands(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("output"), F.col("o_orderpriority").alias("command"), "o_orderkey")
    recorded = o.select("output", scalars.fingerprint(F.when(F.col("o_orderkey") % 4 == 0, F.concat("command", F.lit(" -x"))).otherwise(F.col("command")), "output").alias("fingerprint"))
    return lineage.modified_commands(recorded, o.select("output", "command")).select(F.col("output").cast("long").alias("output"))


@query("""
SELECT source AS stage, count(*) AS n_checks, count(*) FILTER (WHERE quality = 0 AND toxic = 0 AND doc_id % 3 <> 0) AS n_failed FROM labels JOIN documents USING (doc_id) GROUP BY source
""")
def checks_overridden(spark, sf_dir):
    c = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select(F.col("doc_id").alias("check_id"), F.col("source").alias("stage"), (F.col("quality") == 1).alias("passed"), (F.col("toxic") == 1).alias("override"), F.lit(None).cast("string").alias("comment"))
    return checks.summary(checks.overridden(c, c.where("check_id % 3 = 0").select("check_id", F.lit("seen").alias("comment"))), ["stage"])


@query("""
WITH i AS (SELECT l_orderkey, max(epoch_us(l_shipdate) // 1000) AS newest FROM lineitem GROUP BY 1)
SELECT o_orderkey AS check_id FROM orders LEFT JOIN i ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' OR newest > epoch_us(o_orderdate) // 1000
""")
def checks_due(spark, sf_dir):
    c = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("check_id"), F.when(F.col("o_orderstatus") != "P", _ms("o_orderdate")).alias("executed"))
    return checks.due(c, load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("check_id"), _ms("l_shipdate").alias("ts"))).select("check_id")


@query("""
SELECT a.c_custkey AS request_id, 'load' AS stage, CAST(b.o_orderkey % 7 AS VARCHAR) AS lane, CAST(b.o_orderkey AS VARCHAR) AS path FROM customer a JOIN orders b ON b.o_custkey = a.c_custkey
""")
def resolve_siblings(spark, sf_dir):
    text = lambda c: F.col(c).cast("string")
    made = load(spark, sf_dir, "orders").select(F.lit("load").alias("stage"), F.array(text("o_custkey"), (F.col("o_orderkey") % 7).cast("string")).alias("branch_path"), text("o_orderkey").alias("path"))
    asked = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), F.lit("load").alias("stage"), F.array(text("c_custkey"), F.lit("own")).alias("branch_path"))
    return resolve.siblings(made, asked)


@query("SELECT p_brand AS chr, p_type AS gene, min(p_partkey * 100) AS start, max(p_partkey * 100 + p_size * 10) AS \"end\" FROM part GROUP BY ALL")
def gene_extents(spark, sf_dir):
    start = F.col("p_partkey") * 100
    return regions.gene_extents(load(spark, sf_dir, "part").select(F.col("p_brand").alias("chr"), F.col("p_type").alias("gene"), start.alias("start"), (start + F.col("p_size") * 10).alias("end")))


@query("""
SELECT n_nationkey AS ord, n_regionkey + 1 AS wanted, least(n_regionkey + 1, 57 // 25 + CASE WHEN n_nationkey < 57 % 25 THEN 1 ELSE 0 END) AS granted FROM nation
""")
def resource_shares(spark, sf_dir):
    return stats.shares(load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), (F.col("n_regionkey") + 1).alias("wanted")), 57)


@query("""
WITH s AS (SELECT p_brand AS chr, max(p_partkey * 100) AS size FROM part WHERE p_size > 1 GROUP BY 1), l AS (SELECT DISTINCT p_brand AS chr FROM part UNION ALL SELECT 'chrUn')
SELECT l.chr, size, coalesce(l.chr || ':0-' || size, l.chr) AS region FROM l LEFT JOIN s ON s.chr = l.chr
""")
def whole_chromosomes(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    sizes = part.where("p_size > 1").groupBy(F.col("p_brand").alias("chr")).agg(F.max(F.col("p_partkey") * 100).alias("size"))
    return regions.whole_chromosomes(part.select(F.col("p_brand").alias("chr")).distinct().unionByName(spark.createDataFrame([("chrUn",)], "chr string")), sizes)


@query(f"WITH {ARTIFACTS} SELECT ord, regexp_replace(path, '^(.*)_([0-9]+)[.]([a-z]+)[.]txt$', '\\3.\\2.out') AS output FROM artifacts WHERE regexp_matches(path, '^(.*)_([0-9]+)[.]([a-z]+)[.]txt$')")
def name_substituted(spark, sf_dir):
    made = naming.substituted("path", r"(.*)_([0-9]+)\.([a-z]+)\.txt", "$3.$2.out")
    return artifacts(spark, sf_dir).select("ord", made.alias("output")).where("output IS NOT NULL")


# ---------------------------------------------------------------- scalars


@query("""
SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KiB', n / 1024.0) ELSE printf('%.1f MiB', n / 1048576.0) END AS size FROM (SELECT doc_id, n_chars * 74 + 1 AS n FROM documents)
""")
def human_bytes(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", scalars.human_bytes(F.col("n_chars") * 74 + 1).alias("size"))


@query("SELECT o_orderkey, CAST((o_orderkey % 4) * 3600 + (o_orderkey % 60) * 60 + (o_orderkey % 59) AS BIGINT) * 1000 AS ms FROM orders")
def walltime_ms(spark, sf_dir):
    k = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select(k, scalars.walltime_ms(F.concat_ws(":", (k % 4).cast("string"), F.lpad((k % 60).cast("string"), 2, "0"), F.lpad((k % 59).cast("string"), 2, "0"))).alias("ms"))


@query("SELECT p_partkey, CAST(CASE p_size % 3 WHEN 0 THEN p_size WHEN 1 THEN p_size * 1000 ELSE p_size END AS BIGINT) AS mb FROM part")
def memory_mb(spark, sf_dir):
    s = F.col("p_size")
    return load(spark, sf_dir, "part").select("p_partkey", scalars.memory_mb(F.concat(s.cast("string"), F.when(s % 3 == 0, "MB").when(s % 3 == 1, "gb").otherwise(""))).alias("mb"))


@query("SELECT n_nationkey, 'bwa ' || n_name || ';  sort -k1 out' AS command FROM nation")
def shell_join(spark, sf_dir):
    text = F.concat(F.lit("\n  bwa "), "n_name", F.lit("\n\n  sort -k1\n  out\n"))
    return load(spark, sf_dir, "nation").select("n_nationkey", scalars.join_shell_lines(text).alias("command"))


@query("SELECT page_id, CASE WHEN last = '' THEN host || '.html' WHEN contains(last, '.') THEN last ELSE last || '.html' END AS file FROM (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS last, regexp_replace(regexp_extract(url, '^[a-z]+://([^/:]+)', 1), '^www[.]', '') AS host FROM pages)")
def url_names(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", scalars.url_to_file_name("url", "html").alias("file"))


# ---------------------------------------------------------------- events


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def event_json_fields(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return load(spark, sf_dir, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


@query()
def throttled_notifications(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "event_type", (F.col("user_id") % 5).cast("string").alias("channel"), _ms("ts").alias("ts_ms"))
    return events.throttled(e, 6 * 3_600_000)


@query("SELECT event_id, user_id FROM events WHERE ts >= date_trunc('second', TIMESTAMP '2024-01-15 12:00:00.7')")
def modified_since(spark, sf_dir):
    return events.modified_since(load(spark, sf_dir, "events"), "2024-01-15 12:00:00.7").select("event_id", "user_id")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_event_counts(spark, sf_dir):
    """The counts of a stream that has read the whole table once, from its files in the shared folder."""
    import tempfile
    import uuid

    base = shared_folder(spark) or tempfile.mkdtemp(prefix="stream-")
    folder = f"{base}/stream-{uuid.uuid4().hex}"
    path = f"{sf_dir}/events.parquet"
    table = spark.read.parquet(path)
    stream = events.counts(events.read_events(spark, path, table))
    # each batch's complete counts replace the ones before, so a repeated batch changes nothing
    write = stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/out"))
    write.option("checkpointLocation", f"{folder}/checkpoint").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


# ---------------------------------------------------------------- Spark built-ins over the same tables, not of the reference


@query("SELECT event_type, user_id % 3 AS shard, count(*) AS n FROM events GROUP BY CUBE (event_type, user_id % 3)")
def extra_cube(spark, sf_dir):
    return load(spark, sf_dir, "events").withColumn("shard", F.col("user_id") % 3).cube("event_type", "shard").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3")
def extra_top_per_key(spark, sf_dir):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return load(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice").withColumn("n", F.row_number().over(w)).where("n <= 3").drop("n")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id, (epoch_us(min(ts)) // 1000) AS begun, count(*) AS n FROM s GROUP BY user_id, session
""")
def extra_sessions(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", _ms("w.start").alias("begun"), "n")
