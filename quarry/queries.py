"""The engine's queries over the driver's tables, each beside its DuckDB SQL.

``query(name, sql)`` registers a function of (tables) under a name; functions without
SQL are those that SQL cannot express.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import rules, scalar
from quarry.operators import findings, intervals, joins, robust, series, spectrum, text_rules
from quarry.plans import patches, selection
from quarry.session import ship
from quarry.storage import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of a folder, read when first named."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = partial(_run, f)
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _run(f: Callable[[Tables], DataFrame], spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return f(Tables(spark, folder))


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


#: Six decimals, so that engines that add doubles in another order agree.
def r6(c: Column) -> Column:
    return F.round(c, 6)


# --- intervals -------------------------------------------------------------------------

_EVENT_SPANS = """
WITH spans AS (
  SELECT event_type, epoch_us(ts) // 1000000 AS a, epoch_us(ts) // 1000000 + 60 + CAST(floor(value) AS BIGINT) AS b FROM events
), o AS (
  SELECT *, max(b) OVER (PARTITION BY event_type ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans
), g AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM o
), u AS (
  SELECT event_type, min(a) AS a, max(b) AS b FROM g GROUP BY event_type, grp
)"""


def _event_spans(t: Tables) -> DataFrame:
    start = F.floor(micros("ts") / 1_000_000).cast("long")
    return t.events.select("event_type", start.alias("a"), (start + 60 + F.floor("value")).cast("long").alias("b"))


_DAY = 86_400


@query("interval_union", _EVENT_SPANS + " SELECT event_type, a, b FROM u")
def interval_union(t: Tables) -> DataFrame:
    return intervals.union(_event_spans(t), ["event_type"], width=_DAY)


@query("interval_gaps", _EVENT_SPANS + """
SELECT event_type, f AS a, a AS b, a - f AS gap FROM (SELECT *, lag(b) OVER (PARTITION BY event_type ORDER BY a) AS f FROM u) WHERE a - f >= 16""")
def interval_gaps(t: Tables) -> DataFrame:
    return intervals.gaps(_event_spans(t), ["event_type"], least=16, width=_DAY)


@query("interval_complement", _EVENT_SPANS + """
, lim AS (SELECT min(a) - 1000 AS lo, max(b) + 1000 AS hi FROM u),
e AS (
  SELECT event_type, lag(b, 1, lo) OVER w AS f, a AS e FROM u, lim WINDOW w AS (PARTITION BY event_type ORDER BY a)
  UNION ALL SELECT event_type, max(b), any_value(hi) FROM u, lim GROUP BY event_type
) SELECT event_type, f AS a, e AS b FROM e WHERE e > f""")
def interval_complement(t: Tables) -> DataFrame:
    rows = _event_spans(t)
    limits = rows.agg((F.min("a") - 1000).alias("lo"), (F.max("b") + 1000).alias("hi"))
    return intervals.complement(rows, rows.select("event_type").distinct().join(F.broadcast(limits)), ["event_type"], width=_DAY)


@query("coverage_ratio", _EVENT_SPANS + """
SELECT event_type, CAST(sum(b - a) AS BIGINT) AS covered, max(b) - min(a) AS span, round(sum(b - a) / (max(b) - min(a)), 6) AS ratio FROM u GROUP BY event_type""")
def coverage_ratio(t: Tables) -> DataFrame:
    return intervals.covered(_event_spans(t), ["event_type"], width=_DAY).withColumn("ratio", r6(F.col("ratio")))


@query("gap_severity", _EVENT_SPANS + """
, h AS (SELECT event_type, a - lag(b) OVER (PARTITION BY event_type ORDER BY a) AS gap FROM u),
s AS (SELECT event_type, CAST(coalesce(sum(gap) FILTER (gap >= 16), 0) AS BIGINT) AS counted, CAST(coalesce(sum(gap), 0) AS BIGINT) AS raw FROM h GROUP BY event_type)
SELECT event_type, counted, raw, CASE WHEN counted >= 256 THEN 'HIGH' WHEN counted > 0 THEN 'LOW' ELSE 'INFO' END AS severity FROM s""")
def gap_severity(t: Tables) -> DataFrame:
    rows = _event_spans(t)
    holes = intervals.gaps(rows, ["event_type"], width=_DAY).groupBy("event_type").agg(F.sum(F.when(F.col("gap") >= 16, F.col("gap"))).alias("counted"), F.sum("gap").alias("raw"))
    every = rows.select("event_type").distinct().join(holes, "event_type", "left").fillna(0, ["counted", "raw"])
    return every.withColumn("severity", intervals.gap_severity(F.col("counted")))


_LINE_SPANS = """
WITH o AS (SELECT o_orderkey AS k, epoch_us(o_orderdate) // 86400000000 AS a, epoch_us(o_orderdate) // 86400000000 + 60 AS b FROM orders),
l AS (SELECT l_orderkey AS k, epoch_us(l_shipdate) // 86400000000 AS a, epoch_us(l_shipdate) // 86400000000 + 1 AS b, l_linenumber, l_partkey, l_suppkey FROM lineitem)"""


def _order_spans(t: Tables) -> tuple[DataFrame, DataFrame]:
    day = lambda c: F.floor(micros(c) / 86_400_000_000).cast("long")
    outer = t.orders.select(F.col("o_orderkey").alias("k"), day("o_orderdate").alias("a"), (day("o_orderdate") + 60).alias("b"))
    inner = t.lineitem.select(F.col("l_orderkey").alias("k"), day("l_shipdate").alias("a"), (day("l_shipdate") + 1).alias("b"), "l_linenumber", "l_partkey", "l_suppkey")
    return inner, outer


@query("containment_anti", _LINE_SPANS + " SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.k = l.k AND o.a <= l.a AND l.b <= o.b)")
def containment_anti(t: Tables) -> DataFrame:
    return intervals.not_contained(*_order_spans(t), ["k"])


@query("containment_semi", _LINE_SPANS + " SELECT * FROM l WHERE EXISTS (SELECT 1 FROM o WHERE o.k = l.k AND o.a <= l.a AND l.b <= o.b)")
def containment_semi(t: Tables) -> DataFrame:
    return intervals.contained(*_order_spans(t), ["k"])


@query("patch_overlap", """
WITH s AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS a, epoch_us(ts) // 1000000 + CAST(floor(value * 60) AS BIGINT) AS b FROM events)
SELECT user_id, event_id, a, b, reach FROM (
  SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s) WHERE reach > a""")
def patch_overlap(t: Tables) -> DataFrame:
    start = F.floor(micros("ts") / 1_000_000).cast("long")
    rows = t.events.select("user_id", "event_id", start.alias("a"), (start + F.floor(F.col("value") * 60)).cast("long").alias("b"))
    return intervals.overlaps(rows, ["user_id"], width=_DAY)


# --- series ----------------------------------------------------------------------------

_K = 0.8
_STEPS = f"""
WITH s AS (
  SELECT user_id, event_id, ts, value, row_number() OVER w - 1 AS i, abs(lead(value) OVER w - value) AS step,
         lead(value, 2) OVER w AS two_on, lead(value) OVER w AS nxt, lag(value) OVER w AS before
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), bar AS (SELECT user_id, avg(step) + {_K} * stddev_pop(step) AS bar FROM s GROUP BY user_id),
j AS (SELECT s.*, bar, coalesce(step > bar, false) AS is_jump FROM s JOIN bar USING (user_id))"""


@query("series_jumps", _STEPS + " SELECT user_id, event_id, i, round(step, 6) AS step, is_jump FROM j")
def series_jumps(t: Tables) -> DataFrame:
    return series.jumps(t.events, ["user_id"], ["ts", "event_id"], "value", _K).select("user_id", "event_id", F.col("i").cast("long").alias("i"), r6(F.col("step")).alias("step"), "is_jump")


@query("flash_intended", _STEPS + ", l AS (SELECT *, lead(step) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_step FROM j) SELECT user_id, event_id, CASE WHEN abs(two_on - value) < 0.45 * greatest(step, next_step) THEN 'flash' ELSE 'cut' END AS kind FROM l WHERE is_jump")
def flash_intended(t: Tables) -> DataFrame:
    return series.flashes(t.events, ["user_id"], ["ts", "event_id"], "value", _K).select("user_id", "event_id", "kind")


@query("flash_literal", _STEPS + """
, k AS (SELECT *, lead(is_jump) OVER w AS nj, lead(step) OVER w AS next_step, coalesce(before, last_value(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS bf
        FROM j WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, CASE WHEN coalesce(nj, false) AND abs(nxt - bf) < 0.45 * greatest(step, next_step) THEN 'flash' ELSE 'cut' END AS kind FROM k WHERE is_jump""")
def flash_literal(t: Tables) -> DataFrame:
    return series.flashes(t.events, ["user_id"], ["ts", "event_id"], "value", _K, mode="literal").select("user_id", "event_id", "kind")


@query("frozen_runs", """
WITH s AS (SELECT user_id, row_number() OVER w - 1 AS i, abs(lead(value) OVER w - value) AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
q AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM s WHERE step < 120)
SELECT user_id, min(i) AS a, max(i) AS b, count(*) AS n FROM q GROUP BY user_id, g HAVING count(*) >= 3""")
def frozen_runs(t: Tables) -> DataFrame:
    return series.frozen(t.events, ["user_id"], ["ts", "event_id"], "value", below=120.0, least=3)


@query("rle_runs", """
WITH c AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new, row_number() OVER w - 1 AS i
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS value, min(i) AS start, count(*) AS n FROM r GROUP BY user_id, run""")
def rle_runs(t: Tables) -> DataFrame:
    return series.run_lengths(t.events, ["user_id"], ["ts", "event_id"], "event_type")


@query("running_max", "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS most FROM events")
def running_max(t: Tables) -> DataFrame:
    return t.events.select("event_id", series.running_max(t.events, ["user_id"], ["ts", "event_id"], "value").alias("most"))


_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


@query("prefix_offsets", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS size,
       CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINE_ORDER)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS seg_start
FROM lineitem""")
def prefix_offsets(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("size", F.col("l_quantity").cast("long"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "size", series.prefix_offsets(rows, ["l_orderkey"], _LINE_ORDER, "size").alias("seg_start"))


@query("asof_segment", f"""
WITH s AS (SELECT l_orderkey AS k, CAST(l_quantity AS BIGINT) AS size, l_partkey, l_suppkey,
             coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINE_ORDER)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM lineitem),
p AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) % 97 AS at FROM orders)
SELECT p.k, p.at, s.l_partkey, s.l_suppkey FROM p LEFT JOIN s ON s.k = p.k AND s.size > 0 AND s.a <= p.at AND NOT EXISTS (SELECT 1 FROM s x WHERE x.k = p.k AND x.size > 0 AND x.a <= p.at AND x.a > s.a)""")
def asof_segment(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_quantity").cast("long").alias("size"), *_LINE_ORDER, "l_quantity").filter("size > 0")
    placed = joins.segments(rows, ["k"], _LINE_ORDER, "size")
    asks = t.orders.select(F.col("o_orderkey").alias("k"), (F.floor("o_totalprice") % 97).alias("at"))
    return joins.asof(asks, placed, ["k"], "at", "seg_start", ["l_partkey", "l_suppkey"])


# --- robust statistics -----------------------------------------------------------------


@query("robust_stats", """
SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS least, max(value) AS most,
  round(quantile_cont(value, 0.02), 6) AS p2, round(quantile_cont(value, 0.2), 6) AS p20, round(quantile_cont(value, 0.97), 6) AS p97, round(quantile_cont(value, 0.98), 6) AS p98
FROM events GROUP BY event_type""")
def robust_stats(t: Tables) -> DataFrame:
    out = robust.summary(t.events, ["event_type"], "value")
    return out.select("event_type", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"), "least", "most", *[r6(F.col(p)).alias(p) for p in ("p2", "p20", "p97", "p98")])


@query("median_mad", """
WITH m AS (SELECT event_type, median(value) AS median FROM events GROUP BY event_type)
SELECT event_type, round(any_value(m.median), 6) AS median, round(median(abs(value - m.median)), 6) AS mad FROM events JOIN m USING (event_type) GROUP BY event_type""")
def median_mad(t: Tables) -> DataFrame:
    return robust.median_mad(t.events, ["event_type"], "value").select("event_type", r6(F.col("median")).alias("median"), r6(F.col("mad")).alias("mad"))


@query("mad_outliers", """
WITH m AS (SELECT l_returnflag, median(l_extendedprice) AS median FROM lineitem GROUP BY l_returnflag),
d AS (SELECT l_returnflag, any_value(m.median) AS median, median(abs(l_extendedprice - m.median)) AS mad FROM lineitem JOIN m USING (l_returnflag) GROUP BY l_returnflag)
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem JOIN d USING (l_returnflag) WHERE abs(l_extendedprice - median) > 1.3 * 1.4826 * mad""")
def mad_outliers(t: Tables) -> DataFrame:
    return robust.mad_outliers(t.lineitem, ["l_returnflag"], "l_extendedprice", 1.3).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("p1_pick", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, n, value AS low FROM r WHERE r = greatest(0, floor(n * 0.01) - 1)""")
def p1_pick(t: Tables) -> DataFrame:
    return robust.low_pick(t.events, ["event_type"], "value")


@query("harmonic_mean", "SELECT event_type, round(count(value) / sum(1.0 / value), 6) AS harmonic FROM events GROUP BY event_type")
def harmonic(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(r6(robust.harmonic_mean("value")).alias("harmonic"))


@query("power_variation", """
SELECT event_type, round(avg(value), 6) AS power, round(sqrt(greatest(0, sum(value * value) / count(*) - avg(value) * avg(value))) / (avg(value) + 1e-12), 6) AS cv FROM events GROUP BY event_type""")
def power_variation(t: Tables) -> DataFrame:
    return robust.variation(t.events, ["event_type"], "value").select("event_type", r6(F.col("power")).alias("power"), r6(F.col("cv")).alias("cv"))


@query("block_means", """
WITH c AS (SELECT vec_id % 7 AS k, (generate_subscripts(embedding, 1) - 1) AS i, unnest(embedding)::DOUBLE AS value FROM embeddings)
SELECT k, CAST(floor((i // 8) * 4 / 8) AS INTEGER) AS row, CAST(floor((i % 8) * 4 / 8) AS INTEGER) AS col, round(avg(value), 6) AS mean FROM c GROUP BY 1, 2, 3""")
def block_means(t: Tables) -> DataFrame:
    cells = t.embeddings.select((F.col("vec_id") % 7).alias("k"), F.posexplode("embedding").alias("i", "v"))
    cells = cells.select("k", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).alias("x"), F.col("v").cast("double").alias("value"), F.lit(8).alias("h"), F.lit(8).alias("w"))
    return robust.block_means(cells, ["k"], 4, 4).withColumn("mean", r6(F.col("mean")))


@query("still_cells", """
WITH c AS (SELECT label, (generate_subscripts(embedding, 1) - 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
m AS (SELECT label, i, median(v) AS med FROM c GROUP BY label, i),
d AS (SELECT c.label, c.i, any_value(med) AS med, median(abs(v - med)) AS mad FROM c JOIN m ON c.label = m.label AND c.i = m.i GROUP BY c.label, c.i),
q AS (SELECT label, quantile_cont(mad, 0.2) AS still, quantile_cont(abs(med), 0.8) AS strong FROM d GROUP BY label)
SELECT d.label, CAST(d.i AS INTEGER) AS i, round(med, 6) AS median, round(mad, 6) AS mad FROM d JOIN q USING (label) WHERE mad <= still OR abs(med) >= strong""")
def still_cells(t: Tables) -> DataFrame:
    cells = t.embeddings.select("label", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    stats = robust.median_mad(cells, ["label", "i"], "v")
    cut = stats.groupBy("label").agg(F.percentile("mad", 0.2).alias("still"), F.percentile(F.abs("median"), 0.8).alias("strong"))
    hit = stats.join(cut, "label").filter((F.col("mad") <= F.col("still")) | (F.abs("median") >= F.col("strong")))
    return hit.select("label", "i", r6(F.col("median")).alias("median"), r6(F.col("mad")).alias("mad"))


# --- text ------------------------------------------------------------------------------


@query("content_hash", "SELECT doc_id, md5(coalesce(text, '')) AS md5, sha1(coalesce(text, '')) AS sha1, sha256(coalesce(text, '')) AS sha256 FROM documents")
def content_hash(t: Tables) -> DataFrame:
    return text_rules.hashes(t.documents, ["doc_id"], "text")


@query("hash_duplicates", "SELECT md5(text) AS md5, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def hash_duplicates(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.md5("text").alias("md5")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("hash_named", """
WITH h AS (SELECT doc_id, md5(text) AS m, CASE doc_id % 4 WHEN 0 THEN md5(text) WHEN 1 THEN left(md5(text), 10) WHEN 2 THEN left(md5(text), 5) ELSE source END AS stem FROM documents)
SELECT doc_id, stem FROM h WHERE stem = m OR (length(stem) >= 8 AND regexp_matches(stem, '^[0-9a-f]+$') AND starts_with(m, stem)) OR starts_with(stem, m)""")
def hash_named(t: Tables) -> DataFrame:
    m = F.md5("text")
    k = F.col("doc_id") % 4
    stem = F.when(k == 0, m).when(k == 1, F.left(m, F.lit(10))).when(k == 2, F.left(m, F.lit(5))).otherwise(F.col("source"))
    rows = t.documents.select("doc_id", stem.alias("stem"), m.alias("m"), F.sha1("text").alias("s"), F.sha2("text", 256).alias("l"))
    return rows.filter(text_rules.named_by_hash(F.col("stem"), F.col("m"), F.col("s"), F.col("l"))).select("doc_id", "stem")


@query("char_entropy", """
WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents), n AS (SELECT doc_id, c, count(*) AS n FROM c WHERE c <> '' GROUP BY doc_id, c)
SELECT doc_id, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 5) AS entropy FROM n GROUP BY doc_id""")
def char_entropy(t: Tables) -> DataFrame:
    return text_rules.char_entropy(t.documents, ["doc_id"], "text").select("doc_id", F.round("entropy", 5).alias("entropy"))


@query("printable_runs", r"SELECT doc_id, CAST(generate_subscripts(m, 1) - 1 AS INTEGER) AS pos, unnest(m) AS run FROM (SELECT doc_id, regexp_extract_all(text, '[\x20-\x7e]{7,}') AS m FROM documents)")
def printable_runs(t: Tables) -> DataFrame:
    return text_rules.printable_runs(t.documents, ["doc_id"], "text")


_INTEL = """
SELECT {id}, kind, CAST(len(m) AS BIGINT) AS n, CAST(len(list_distinct(m)) AS BIGINT) AS n_distinct FROM (
  SELECT {id}, 'url' AS kind, regexp_extract_all({text}, 'https?://[^\\s"''<>\\x00-\\x1f]{{6,200}}') AS m FROM {table}
  UNION ALL SELECT {id}, 'email', regexp_extract_all({text}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,10}}') FROM {table}
  UNION ALL SELECT {id}, 'ip', regexp_extract_all({text}, '\\b(?:[0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}\\b') FROM {table}
  UNION ALL SELECT {id}, 'uuid', regexp_extract_all({text}, '\\b[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}\\b') FROM {table}
) WHERE len(m) > 0"""


@query("text_intel", _INTEL.format(id="doc_id", text="text", table="documents"))
def text_intel(t: Tables) -> DataFrame:
    return text_rules.intelligence(t.documents, ["doc_id"], "text")


@query("url_intel", _INTEL.format(id="page_id", text="url", table="pages"))
def url_intel(t: Tables) -> DataFrame:
    return text_rules.intelligence(t.pages, ["page_id"], "url")


@query("url_parts", r"SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host, starts_with(url, 'https') AS secure FROM pages")
def url_parts(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text_rules.host(F.col("url")).alias("host"), F.startswith("url", F.lit("https")).alias("secure"))


_PLANTED = (
    (1, "comment=vid:v0300fg10000abcdefghijkl"),
    (2, "þvid:v0300fg1 中vid:v0300fg2 -vid:v0300fg3"),
    (3, "user_id=abcdef12"),
    (4, "api_key: 0123456789abcdef"),
    (5, "see https://a.example.com/x?y=1 or a.b@c.org"),
    (6, "10.0.0.1 and 123e4567-e89b-12d3-a456-426614174000"),
    (7, "0123456789abcdef0123456789abcdef"),
    (8, "QWxhZGRpbjpvcGVuIHNlc2FtZQ+/QWxhZGRpbg=="),
    (9, "plain words"),
    (10, "encoder Lavf58.29.100 by Adobe Premiere, bytedance watermark"),
    (11, "/var/lib/data/file.json and C:\\\\x"),
)
_VALUES = "(VALUES " + ", ".join(f"({k}, '{v}')" for k, v in _PLANTED) + ") AS p(id, text)"


def _planted(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(list(_PLANTED), "id int, text string")


def _rule_values() -> str:
    quoted = lambda s: s.replace("'", "''")
    return "(VALUES " + ", ".join(f"('{c}', '{quoted(p)}', '{s}')" for c, p, s in rules.FINGERPRINTS) + ") AS r(code, pattern, severity)"


@query("rule_hits", f"""
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS id, text FROM documents UNION ALL SELECT -id, text FROM {_VALUES})
SELECT id, code, severity, CAST(len(regexp_extract_all(text, pattern)) AS BIGINT) AS n FROM d, {_rule_values()} WHERE regexp_matches(text, pattern)""")
def rule_hits(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("doc_id").alias("id"), "text").unionByName(_planted(t).select((-F.col("id")).cast("long").alias("id"), "text"))
    return text_rules.rule_hits(rows, ["id"], "text", rules.fingerprints(t.spark)).select("id", "code", "severity", "n")


@query("planted_intel", _INTEL.format(id="id", text="text", table=f"(SELECT doc_id AS id, coalesce(d.text, '') || ' | ' || p.text AS text FROM documents d JOIN {_VALUES} ON p.id = d.doc_id % 11 + 1)"))
def planted_intel(t: Tables) -> DataFrame:
    """Every document, followed by one of the planted texts."""
    planted = _planted(t).select(F.col("id").alias("_k"), F.col("text").alias("_t"))
    rows = t.documents.join(planted, F.col("_k") == F.col("doc_id") % len(_PLANTED) + 1)
    return text_rules.intelligence(rows.select(F.col("doc_id").alias("id"), F.concat(F.coalesce("text", F.lit("")), F.lit(" | "), "_t").alias("text")), ["id"], "text")


@query("hexlike_values", """
WITH v AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN md5(text) WHEN doc_id % 3 = 1 THEN repeat('ab', 16) ELSE source END AS v FROM documents)
SELECT doc_id, v FROM v WHERE length(v) >= 24 AND regexp_matches(v, '^[0-9a-fA-F]{16,}$') AND len(list_distinct(string_split(lower(v), ''))) > 8""")
def hexlike_values(t: Tables) -> DataFrame:
    v = F.when(F.col("doc_id") % 3 == 0, F.md5("text")).when(F.col("doc_id") % 3 == 1, F.repeat(F.lit("ab"), 16)).otherwise(F.col("source"))
    return t.documents.select("doc_id", v.alias("v")).filter(text_rules.is_hex_like(F.col("v")))


@query("base64like_values", f"""
WITH v AS (SELECT doc_id, base64(unhex(sha256(text))) AS v FROM documents UNION ALL SELECT -id, text FROM {_VALUES})
SELECT doc_id, v FROM v WHERE length(v) >= 32 AND regexp_matches(v, '^[A-Za-z0-9+/=_-]{{24,}}$') AND regexp_matches(v, '[+/=_\\-]')
  AND NOT (regexp_matches(v, '^[0-9a-fA-F]{{16,}}$') AND len(list_distinct(string_split(lower(v), ''))) > 8)""")
def base64like_values(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.base64(F.unhex(F.sha2("text", 256))).alias("v")).unionByName(_planted(t).select((-F.col("id")).cast("long").alias("doc_id"), F.col("text").alias("v")))
    return rows.filter(text_rules.is_base64_like(F.col("v")))


@query("interesting_strings", f"""
WITH r AS (SELECT CAST(id AS BIGINT) AS id, CAST(0 AS INTEGER) AS pos, text FROM {_VALUES}
  UNION ALL SELECT -doc_id - 1, CAST(generate_subscripts(m, 1) - 1 AS INTEGER), unnest(m) FROM (SELECT doc_id, regexp_extract_all(text, '[\x20-\x7e]{{7,}}') AS m FROM documents))
SELECT id, pos FROM r WHERE length(text) >= 7 AND (
  regexp_matches(text, '(?i)http|ftp|www\\.|\\.com|\\.cn|\\.net|\\.org|\\.ru|\\.io') OR regexp_matches(text, '(?i)vid:|aweme|douyin|tiktok|bytedance|watermark|token|secret|passw|key=|uid|user')
  OR regexp_matches(text, '[0-9]{{10,}}') OR regexp_matches(text, '^[0-9a-fA-F]{{16,}}$') OR regexp_matches(text, '(?i)\\.(mp4|mov|jpg|png|json|xml|txt|db|log|zip)$')
  OR (regexp_matches(text, '[A-Za-z0-9+/]{{28,}}=?=?') AND regexp_matches(text, '[A-Z]') AND regexp_matches(text, '[a-z]')) OR regexp_matches(text, '^[A-Za-z]:\\\\\\\\|^/[0-9A-Za-z_/\\.\\-]{{6,}}'))""")
def interesting_strings(t: Tables) -> DataFrame:
    runs = text_rules.printable_runs(t.documents, ["doc_id"], "text").select((-F.col("doc_id") - 1).cast("long").alias("id"), "pos", F.col("run").alias("text"))
    rows = _planted(t).select(F.col("id").cast("long").alias("id"), F.lit(0).alias("pos"), "text").unionByName(runs)
    return rows.filter(text_rules.is_interesting(F.col("text"))).select("id", "pos")


@query("distinct_collect", "SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds FROM events GROUP BY user_id")
def distinct_collect(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"))


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# --- findings --------------------------------------------------------------------------

_GRADED = """
WITH f AS (SELECT user_id, event_id, event_type, value,
  CASE WHEN value > 400 THEN 'HIGH' WHEN value > 200 THEN 'MED' WHEN value > 50 THEN 'LOW' ELSE 'INFO' END AS severity, ts FROM events)"""


def _graded(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.withColumn("severity", F.when(v > 400, "HIGH").when(v > 200, "MED").when(v > 50, "LOW").otherwise("INFO"))


@query("severity_pivot", _GRADED + """
SELECT event_type, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MED') AS med, count(*) FILTER (severity = 'LOW') AS low, count(*) FILTER (severity = 'INFO') AS info FROM f GROUP BY event_type""")
def severity_pivot(t: Tables) -> DataFrame:
    return findings.severity_counts(_graded(t), ["event_type"])


@query("finding_rollup", _GRADED + " SELECT event_type, severity, count(*) AS n, CAST(grouping_id(event_type, severity) AS BIGINT) AS level FROM f GROUP BY ROLLUP (event_type, severity)")
def finding_rollup(t: Tables) -> DataFrame:
    return findings.rollup(_graded(t), ["event_type", "severity"])


@query("severity_top_k", _GRADED + """
SELECT user_id, event_id, severity, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE severity WHEN 'HIGH' THEN 0 WHEN 'MED' THEN 1 WHEN 'LOW' THEN 2 ELSE 3 END, event_id) AS INTEGER) AS rank FROM f) WHERE rank <= 5""")
def severity_top_k(t: Tables) -> DataFrame:
    return findings.top_k(_graded(t), ["user_id"], [findings.rank(F.col("severity")), F.col("event_id")], 5).select("user_id", "event_id", "severity", "rank")


@query("finding_diff", _GRADED + """
, o AS (SELECT user_id, event_type, severity, count(*) AS n_old FROM f WHERE ts < TIMESTAMP '2024-01-12' GROUP BY ALL),
n AS (SELECT user_id, event_type, severity, count(*) AS n_new FROM f WHERE ts >= TIMESTAMP '2024-01-12' GROUP BY ALL)
SELECT user_id, event_type, severity, coalesce(n_old, 0) AS n_old, coalesce(n_new, 0) AS n_new, CASE WHEN n_new IS NULL THEN 'gone' WHEN n_old IS NULL THEN 'added' ELSE 'still' END AS state
FROM o FULL OUTER JOIN n USING (user_id, event_type, severity)""")
def finding_diff(t: Tables) -> DataFrame:
    rows, cut = _graded(t), F.lit("2024-01-12").cast("timestamp_ntz")
    return findings.compare(rows.filter(F.col("ts") < cut), rows.filter(F.col("ts") >= cut), ["user_id", "event_type", "severity"])


@query("residual_high", _GRADED + " SELECT user_id, count(*) FILTER (severity = 'HIGH') AS residual_high FROM f GROUP BY user_id")
def residual_high(t: Tables) -> DataFrame:
    return findings.residual_high(_graded(t), ["user_id"])


@query("batch_index", "SELECT c_mktsegment AS name, count(*) AS videos, count(*) FILTER (c_acctbal >= 0) AS ok, count(*) FILTER (c_acctbal < 0) AS failed FROM customer GROUP BY c_mktsegment ORDER BY name")
def batch_index(t: Tables) -> DataFrame:
    return t.customer.groupBy(F.col("c_mktsegment").alias("name")).agg(F.count(F.lit(1)).alias("videos"), F.count_if(F.expr("c_acctbal >= 0")).alias("ok"), F.count_if(F.expr("c_acctbal < 0")).alias("failed")).orderBy("name")


# --- joins -----------------------------------------------------------------------------


@query("first_match_join", f"""
SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey FROM orders LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINE_ORDER)}) AS r FROM lineitem) l ON l_orderkey = o_orderkey AND r = 1""")
def first_match_join(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    return joins.first_match(t.orders.select("o_orderkey"), lines, ["o_orderkey"], _LINE_ORDER).select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("ordinal_join", """
WITH a AS (SELECT n_regionkey AS k, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS ordinal FROM nation),
b AS (SELECT s_nationkey % 5 AS k, s_name, row_number() OVER (PARTITION BY s_nationkey % 5 ORDER BY s_suppkey) AS ordinal FROM supplier)
SELECT k, CAST(ordinal AS INTEGER) AS ordinal, n_name, s_name FROM a JOIN b USING (k, ordinal)""")
def ordinal_join(t: Tables) -> DataFrame:
    left = t.nation.select(F.col("n_regionkey").alias("k"), "n_name")
    right = t.supplier.select((F.col("s_nationkey") % 5).alias("k"), "s_name", "s_suppkey")
    return joins.by_ordinal(left, right, ["k"], ["n_name"], ["s_suppkey"]).select("k", "ordinal", "n_name", "s_name")


@query("unknown_types", "SELECT p_partkey, p_type FROM part WHERE p_type NOT IN (SELECT DISTINCT p_type FROM part WHERE p_size > 25)")
def unknown_types(t: Tables) -> DataFrame:
    known = t.part.filter("p_size > 25").select("p_type").distinct()
    return joins.without_match(t.part, known, ["p_type"]).select("p_partkey", "p_type")


@query("flash_frames_semi", _STEPS + ", j2 AS (SELECT user_id, event_id FROM j WHERE is_jump) SELECT e.event_id, e.user_id FROM events e SEMI JOIN j2 ON e.event_id = j2.event_id WHERE e.value > 250")
def flash_frames_semi(t: Tables) -> DataFrame:
    hot = series.jumps(t.events, ["user_id"], ["ts", "event_id"], "value", _K).filter("is_jump")
    return joins.with_match(t.events.filter("value > 250"), hot, ["event_id"]).select("event_id", "user_id")


@query("duplicate_top_boxes", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_top_boxes(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("target_paths", """
WITH p AS (SELECT url AS path, page_id % 5 = 0 AS explicit, page_id AS seq FROM pages)
SELECT path, min(seq) AS seq FROM p WHERE explicit OR (regexp_extract(lower(path), '\\.([^.]+)$', 1) IN ('html') AND NOT contains(lower(regexp_extract(path, '([^/]+)$', 1)), 'repaired')) GROUP BY path""")
def target_paths(t: Tables) -> DataFrame:
    from quarry.sources.files import targets

    rows = t.pages.select(F.col("url").alias("path"), (F.col("page_id") % 5 == 0).alias("explicit"), F.col("page_id").alias("seq"))
    return targets(rows, ("html",))


# --- spectrum --------------------------------------------------------------------------

_DFT = """
WITH b AS (SELECT unnest(range(0, 33)) AS k), e AS (SELECT vec_id, embedding, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
p AS (SELECT vec_id, k, pow(sum(v * cos(-2 * pi() / 64 * ((k * i) % 64))), 2) + pow(sum(v * sin(-2 * pi() / 64 * ((k * i) % 64))), 2) AS p FROM e, b GROUP BY vec_id, k)"""


@query("band_energy", _DFT + """
SELECT vec_id, band, round(sum(p) FILTER (k >= lo AND k < hi) / (sum(p) + 1e-12), 6) AS share FROM p, (VALUES ('0-8', 0, 8), ('8-16', 8, 16), ('16-24', 16, 24), ('24-33', 24, 33)) AS d(band, lo, hi) GROUP BY vec_id, band""")
def band_energy(t: Tables) -> DataFrame:
    return spectrum.band_energy(t.embeddings, ["vec_id"], "embedding", 64, [(0, 8), (8, 16), (16, 24), (24, 33)]).withColumn("share", r6(F.col("share")))


@query("tone_pick", _DFT + """
SELECT vec_id, CAST(rank AS INTEGER) AS rank, CAST(k AS INTEGER) AS bin, round(p, 6) AS power FROM (SELECT vec_id, k, p, row_number() OVER (PARTITION BY vec_id ORDER BY round(p, 9) DESC, k) AS rank FROM p WHERE k > 4) WHERE rank <= 3""")
def tone_pick(t: Tables) -> DataFrame:
    return spectrum.strongest_bins(t.embeddings, ["vec_id"], "embedding", 64, 4, 3).withColumn("power", r6(F.col("power")))


# --- selection -------------------------------------------------------------------------

_TRIALS = """
WITH tr AS (SELECT p_brand AS video_id, p_type AS encoder, CAST(length(p_type) AS INTEGER) AS ladder_rank, CAST(p_partkey AS INTEGER) AS attempt, p_size AS crf,
  CASE WHEN p_partkey % 3 = 0 THEN 'ssim' ELSE 'vmaf' END AS metric, CASE WHEN p_partkey % 3 = 0 THEN 0.95 + p_size / 1000.0 ELSE 60.0 + p_size END AS mean,
  CASE WHEN p_partkey % 4 = 0 THEN 0.0 ELSE 50.0 + p_size END AS p1, CAST(floor(p_retailprice * 100) AS BIGINT) AS projected FROM part),
pass AS (SELECT * FROM tr WHERE (metric = 'vmaf' AND mean >= 95.0 AND (p1 <= 0 OR p1 >= 85.0)) OR (metric = 'ssim' AND mean >= 0.98)),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, encoder ORDER BY attempt) AS r FROM pass) WHERE r = 1)"""


def _trials(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    return t.part.select(
        F.col("p_brand").alias("video_id"), F.col("p_type").alias("encoder"), F.length("p_type").alias("ladder_rank"), k.cast("int").alias("attempt"), size.alias("crf"),
        F.when(k % 3 == 0, "ssim").otherwise("vmaf").alias("metric"), F.when(k % 3 == 0, F.lit(0.95) + size / 1000.0).otherwise(F.lit(60.0) + size).alias("mean"),
        F.when(k % 4 == 0, 0.0).otherwise(F.lit(50.0) + size).alias("p1"), F.floor(F.col("p_retailprice") * 100).cast("long").alias("projected"),
    )


def _high(t: Tables) -> DataFrame:
    return rules.targets(t.spark).filter("quality = 'high'").select("vmaf", "ssim")


@query("quality_gate", _TRIALS + " SELECT video_id, encoder, attempt, crf, metric, projected FROM firsts")
def quality_gate(t: Tables) -> DataFrame:
    return selection.first_passes(_trials(t), _high(t)).select("video_id", "encoder", "attempt", "crf", "metric", "projected")


@query("arg_min_choice", _TRIALS + """
, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY projected, ladder_rank, encoder) AS b FROM firsts) WHERE b = 1),
sz AS (SELECT p_brand AS video_id, CAST(floor(avg(p_retailprice) * 95) AS BIGINT) AS size FROM part GROUP BY p_brand)
SELECT sz.video_id, CASE WHEN projected IS NOT NULL AND projected < size * (1 - 0.10) THEN 'slim' ELSE 'skip' END AS action,
  CASE WHEN projected IS NULL THEN 'nothing_passes' WHEN projected >= size * (1 - 0.10) THEN 'saves_too_little' END AS reason, projected FROM sz LEFT JOIN best USING (video_id)""")
def arg_min_choice(t: Tables) -> DataFrame:
    sizes = t.part.groupBy(F.col("p_brand").alias("video_id")).agg(F.floor(F.avg("p_retailprice") * 95).cast("long").alias("size"))
    return selection.choose(_trials(t), sizes, _high(t)).select("video_id", "action", "reason", "projected")


@query("precheck", """
SELECT p_partkey, CASE WHEN p_size - 2 <= 0 THEN 'incomplete' WHEN p_partkey % 7 = 0 THEN 'no_video' WHEN p_partkey % 5 = 0 THEN 'hdr' WHEN p_size / 1000.0 < 0.045 AND p_partkey % 2 = 0 THEN 'already_tight' END AS reason FROM part""")
def precheck(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    codec = F.when(k % 7 == 0, "").when(k % 2 == 0, "hevc").otherwise("h264")
    reason = selection.precheck(size - 2, F.lit(1080), F.lit(10.0), codec, F.when(k % 5 == 0, "smpte2084").otherwise("bt709"), size / 1000.0)
    return t.part.select("p_partkey", reason.alias("reason"))


@query("next_quality", "SELECT p_partkey, CAST(greatest(0, p_size - CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 5 END * (p_partkey % 4)) AS BIGINT) AS quality FROM part")
def next_quality(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t.part.select("p_partkey", selection.next_quality(F.when(k % 2 == 0, "crf").otherwise("q"), F.col("p_size"), k % 4).alias("quality"))


@query("sample_windows", """
WITH d AS (SELECT o_orderkey, (CAST(floor(o_totalprice) AS BIGINT) % 900) / 10.0 AS d FROM orders),
w AS (SELECT o_orderkey, d, greatest(1.0, least(3.0, d / 3)) AS seg FROM d)
SELECT o_orderkey, CAST(i AS INTEGER) AS i, round(CASE WHEN d <= seg * 3 THEN 0 ELSE (d - seg) * (i + 0.5) / 3 END, 6) AS start, round(CASE WHEN d <= seg * 3 THEN d ELSE seg END, 6) AS seconds
FROM w, (VALUES (0), (1), (2)) AS n(i) WHERE i = 0 OR d > seg * 3""")
def sample_windows(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", ((F.floor("o_totalprice") % 900) / 10.0).alias("d"))
    rows = rows.select("o_orderkey", F.posexplode(scalar.sample_windows(F.col("d"), 3, 3.0)).alias("i", "w"))
    return rows.select("o_orderkey", "i", r6(F.col("w.start")).alias("start"), r6(F.col("w.seconds")).alias("seconds"))


@query("batch_totals", """
SELECT count(*) AS videos, count(*) FILTER (p_size > 3) AS ok, count(*) FILTER (p_size <= 3) AS failed, count(*) FILTER (p_size % 2 = 0) AS skipped,
  CAST(sum(p_partkey * 100) AS BIGINT) AS size_before, CAST(sum(CASE WHEN p_size % 2 = 0 THEN p_partkey * 100 ELSE p_partkey * p_size END) AS BIGINT) AS size_after,
  CAST(sum(p_partkey * 100) - sum(CASE WHEN p_size % 2 = 0 THEN p_partkey * 100 ELSE p_partkey * p_size END) AS BIGINT) AS saved FROM part""")
def batch_totals(t: Tables) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    return selection.batch_totals(t.part.select((size > 3).alias("ok"), (size % 2 == 0).alias("skipped"), (key * 100).alias("size_before"), (key * size).alias("size_after")))


# --- scalar functions ------------------------------------------------------------------


@query("scalar_functions", """
SELECT p_partkey, round(CASE WHEN p_size = 25 THEN 0.0 ELSE 30000.0 / (p_size - 25) END, 6) AS fps, round(100.0 * (1 - p_size / p_retailprice), 6) AS saved,
  CASE WHEN p_size * 500 >= 1024 THEN printf('%.1f KB', p_size * 500 / 1024.0) ELSE printf('%d B', p_size * 500) END AS human,
  left(rtrim(regexp_replace(p_name, '[\\\\/:*?"<>|]', '_', 'g')), 80) AS safe FROM part""")
def scalar_functions(t: Tables) -> DataFrame:
    size = F.col("p_size")
    return t.part.select(
        "p_partkey",
        r6(scalar.frame_rate(F.concat(F.lit("30000/"), (size - 25).cast("string")))).alias("fps"),
        r6(scalar.saved_percent(F.col("p_retailprice"), size)).alias("saved"),
        scalar.human_size(size * 500).alias("human"),
        scalar.safe_name(F.col("p_name")).alias("safe"),
    )


@query("clamped_regions", """
SELECT p_partkey, x, y, greatest(2, least(w, 1919 - x)) AS w, greatest(2, least(h, 1079 - y)) AS h FROM (
  SELECT p_partkey, CAST(greatest(1, least(p_partkey - 5, 1917)) AS BIGINT) AS x, CAST(greatest(1, least(p_size * 30, 1077)) AS BIGINT) AS y, CAST(p_size * 9 AS BIGINT) AS w, CAST(p_size * 5 AS BIGINT) AS h FROM part)""")
def clamped_regions(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("long")
    return t.part.select("p_partkey", scalar.clamped_region(k - 5, size * 30, size * 9, size * 5, F.lit(1920), F.lit(1080)).alias("r")).select("p_partkey", *[F.col(f"r.{c}").cast("long").alias(c) for c in "xywh"])


@query("audio_choice", """
SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN 'none' WHEN p_size % 4 = 0 OR p_size % 3 = 0 OR p_partkey * 1000 > 256000 THEN 'aac' ELSE 'copy' END AS choice FROM part""")
def audio_choice(t: Tables) -> DataFrame:
    size = F.col("p_size")
    codec = F.when(size % 9 == 0, "").when(size % 4 == 0, "flac").when(size % 3 == 0, "pcm_s16le").otherwise("aac")
    return t.part.select("p_partkey", scalar.audio_choice(codec, F.col("p_partkey") * 1000).alias("choice"))


# --- patches ---------------------------------------------------------------------------


@query("patch_overlay", "SELECT doc_id, left(text, 5) || '########' || substr(text, 14) AS content FROM documents WHERE length(text) >= 13")
def patch_overlay(t: Tables) -> DataFrame:
    rows = t.documents.filter(F.length("text") >= 13)  # a patch lies inside its text
    return rows.select("doc_id", patches.overlaid(F.col("text"), F.lit("########"), F.lit(5)).alias("content"))


@query("diff_runs", """
WITH p AS (SELECT doc_id, unnest(range(0, length(text))) AS p, unnest(string_split(text, '')) AS c, unnest(string_split(translate(text, 'aeo', 'xyz'), '')) AS new FROM documents),
d AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM p WHERE c <> new)
SELECT doc_id, min(p) AS a, max(p) AS b, count(*) AS n FROM d GROUP BY doc_id, g""")
def diff_runs(t: Tables) -> DataFrame:
    old = t.documents.select("doc_id", F.col("text").alias("v"))
    return patches.diff_runs(old, old.withColumn("v", F.translate("v", "aeo", "xyz")), ["doc_id"], "v")


@query("unplanned_runs", """
WITH d AS (SELECT user_id AS video_id, event_id AS a, event_id + CAST(floor(value) AS BIGINT) % 9 AS b, CAST(floor(value) AS BIGINT) % 9 + 1 AS n FROM events),
q AS (SELECT user_id AS video_id, event_id - 3 AS a, event_id - 3 + 6 + CAST(floor(value) AS BIGINT) % 5 AS b FROM events WHERE event_type = 'click'),
o AS (SELECT *, max(b) OVER (PARTITION BY video_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM q WHERE b > 0),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM o),
p AS (SELECT video_id, min(a) AS a, max(b) AS b FROM g GROUP BY video_id, grp)
SELECT video_id, a, b + 1 AS b, n FROM d WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.video_id = d.video_id AND p.a <= d.a AND d.b + 1 <= p.b)""")
def unplanned_runs(t: Tables) -> DataFrame:
    v = F.floor("value")
    diffs = t.events.select(F.col("user_id").alias("video_id"), F.col("event_id").alias("a"), (F.col("event_id") + v % 9).alias("b"), (v % 9 + 1).alias("n"))
    plan = t.events.filter("event_type = 'click'").select(F.col("user_id").alias("video_id"), (F.col("event_id") - 3).alias("offset"), F.lit(None).cast("binary").alias("data"), (v % 5 + 6).alias("zero_len"))
    return patches.unplanned(diffs, plan)


@query("stream_changes", """
WITH o AS (SELECT l_orderkey % 50 AS v, l_returnflag AS k, l_linenumber AS n, max(l_quantity) AS w FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL),
n AS (SELECT l_orderkey % 50 AS v, l_returnflag AS k, l_linenumber AS n, max(l_quantity) AS w FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)
SELECT CAST(v AS VARCHAR) AS video_id, k AS codec_type, n AS ordinal, CASE WHEN n.w IS NULL THEN 'gone' WHEN o.w IS NULL THEN 'added' ELSE 'changed' END AS state FROM o FULL OUTER JOIN n USING (v, k, n) WHERE o.w IS DISTINCT FROM n.w""")
def stream_changes(t: Tables) -> DataFrame:
    def side(flag: str) -> DataFrame:
        rows = t.lineitem.filter(F.col("l_linestatus") == flag)
        rows = rows.groupBy((F.col("l_orderkey") % 50).cast("string").alias("video_id"), F.col("l_returnflag").alias("codec_type"), F.col("l_linenumber").alias("ordinal")).agg(F.max("l_quantity").cast("int").alias("width"))
        return rows.withColumns({"codec_name": F.lit("h264"), "height": F.lit(1), "r_frame_rate": F.lit("25/1"), "channels": F.lit(None).cast("int")})

    return patches.stream_changes(side("O"), side("F"))


# --- containers: bytes made from the tables, decoded again ------------------------------


def _box(kind: str, payload: Column) -> Column:
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(payload) + 8), 8, "0")), F.lit(kind.encode()), payload)


def _containers(t: Tables) -> DataFrame:
    """A container a document: ftyp, padding that holds data for some, media, a private box for some, a tail for some."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    k = F.col("doc_id") % 5
    padding = F.when(k == 1, F.substring(text, 1, 100)).otherwise(F.rpad(F.lit(b""), 16, F.lit(b"\0")))
    tail = F.when(k == 2, F.lit(b"\0\0\0\x04tail")).otherwise(F.lit(b""))
    private = F.when(k == 3, _box("uuid", F.concat(F.unhex(F.md5("text")), F.lit(b"c2pa")))).otherwise(F.lit(b""))
    content = F.concat(_box("ftyp", F.lit(b"isom\0\0\0\0")), _box("free", padding), _box("mdat", text), private, tail)
    return t.documents.select(F.col("doc_id").cast("string").alias("video_id"), F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".mp4")).alias("path"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))


@query("box_tree", """
WITH d AS (SELECT doc_id, strlen(text) AS n, CASE WHEN doc_id % 5 = 1 THEN least(100, strlen(text)) ELSE 16 END AS p, doc_id % 5 AS k FROM documents)
SELECT doc_id::VARCHAR AS video_id, 'ftyp' AS type, 0::BIGINT AS start, 16::BIGINT AS size FROM d
UNION ALL SELECT doc_id::VARCHAR, 'free', 16, p + 8 FROM d UNION ALL SELECT doc_id::VARCHAR, 'mdat', 24 + p, n + 8 FROM d
UNION ALL SELECT doc_id::VARCHAR, 'uuid', 32 + p + n, 28 FROM d WHERE k = 3""")
def box_tree(t: Tables) -> DataFrame:
    from quarry.functions import boxes

    return boxes.boxes(_containers(t)).select("video_id", "type", "start", "size")


@query("box_anomalies", """
SELECT doc_id::VARCHAR AS video_id, 'bad_size' AS code, (32 + 16 + strlen(text))::BIGINT AS offset FROM documents WHERE doc_id % 5 = 2""")
def box_anomalies(t: Tables) -> DataFrame:
    from quarry.functions import boxes

    return boxes.anomalies(_containers(t)).select("video_id", "code", "offset")


def _sps() -> bytes:
    """A parameter set of 120 by 68 macroblocks, the last four pairs of lines cropped."""
    bits = format(77, "08b") + format(0, "08b") + format(40, "08b")
    ue = lambda v: "0" * (len(f"{v + 1:b}") - 1) + f"{v + 1:b}"
    bits += "".join(map(ue, (0, 0, 0, 0, 1))) + "0" + ue(119) + ue(67) + "111" + "".join(map(ue, (0, 0, 0, 4))) + "0" + "1"
    bits += "0" * (-len(bits) % 8)
    return b"\x67" + int(bits, 2).to_bytes(len(bits) // 8, "big")


def _movie(text: bytes, mark: bytes, source: bytes) -> tuple[bytes, int]:
    """A movie and where its media begin: ten-byte samples over the text, an SEI unit first, metadata with the source."""
    u32 = lambda *v: b"".join(x.to_bytes(4, "big") for x in v)
    box = lambda kind, *parts: u32(8 + sum(map(len, parts))) + kind + b"".join(parts)
    unit = b"\x06\x05\x20" + mark + b"\x80"
    first, n, sps = u32(len(unit)) + unit, len(text) // 10, _sps()
    config = bytes([1, 77, 0, 40, 0xFF, 0xE1]) + len(sps).to_bytes(2, "big") + sps + b"\0"
    entry = box(b"avc1", bytes(78), box(b"avcC", config))
    item = box(b"\xa9too", box(b"data", u32(1, 0), source))
    meta = box(b"udta", box(b"meta", u32(0), box(b"hdlr", bytes(24)), box(b"ilst", item)))

    def moov(at: int) -> bytes:
        table = box(
            b"stbl", box(b"stsd", u32(0, 1), entry), box(b"stts", u32(0, 1, n + 1, 512)), box(b"stsz", u32(0, 0, n + 1, len(first)), u32(10) * n),
            box(b"stsc", u32(0, 1, 1, n + 1, 1)), box(b"stco", u32(0, 1, at)),
        )
        handler = box(b"hdlr", u32(0, 0), b"vide", bytes(12), b"v\0")
        return box(b"moov", box(b"trak", box(b"mdia", handler, box(b"minf", table))), meta)

    base = 16 + len(moov(0)) + 8
    return box(b"ftyp", b"isom\0\0\0\0") + moov(base) + box(b"mdat", first, text), base


def _movies(t: Tables) -> DataFrame:
    """``video_id, length, content, base``: a movie a document, made where the document is read."""
    from quarry.operators import tiles

    def movie(video, text, mark, source):
        content, base = _movie(text.encode(), mark.encode(), source.encode())
        yield video, len(content), content, base

    docs = t.documents.select(F.col("doc_id").cast("string").alias("video_id"), F.coalesce("text", F.lit("")).alias("text"), F.md5(F.coalesce("text", F.lit(""))).alias("mark"), F.coalesce("source", F.lit("")).alias("source"))
    return tiles.each_row(docs, movie, "video_id string, length long, content binary, base long")


_MOVIE = """
WITH m AS (SELECT doc_id::VARCHAR AS video_id, text, source, strlen(text) AS n, (strlen(text) // 10)::BIGINT AS k, md5(text) AS mark
           FROM (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source FROM documents))"""


@query("sample_table", _MOVIE + """
, s AS (SELECT video_id, unnest(range(0, k + 1)) AS sample_no FROM m)
SELECT video_id, 1 AS track_no, 'vide' AS handler, sample_no, CASE WHEN sample_no = 0 THEN 0 ELSE 40 + 10 * (sample_no - 1) END AS place, CASE WHEN sample_no = 0 THEN 40 ELSE 10 END AS size FROM s""")
def sample_table(t: Tables) -> DataFrame:
    from quarry.functions import boxes

    rows = boxes.samples(_movies(t), kept=("base",))
    return rows.select("video_id", "track_no", "handler", "sample_no", (F.col("offset") - F.col("base")).alias("place"), "size")


@query("track_totals", _MOVIE + " SELECT video_id, k + 1 AS n_samples, 40 + 10 * k AS total_bytes, 0 AS unreachable_samples FROM m")
def track_totals(t: Tables) -> DataFrame:
    from quarry.functions import boxes

    return boxes.track_info(_movies(t)).select("video_id", "n_samples", "total_bytes", "unreachable_samples")


@query("track_timing", _MOVIE + " SELECT video_id, 'vide' AS handler, (k + 1) * 512 AS duration, k + 1 AS samples, 0 AS zero_deltas, 0 AS edits FROM m")
def track_timing(t: Tables) -> DataFrame:
    from quarry.operators import container_rules

    return container_rules.timing_rows(_movies(t)).select("video_id", "handler", "duration", "samples", "zero_deltas", "edits")


@query("sei_records", _MOVIE + " SELECT video_id, 0 AS sample_no, 5 AS type, 32 AS size, lower(hex(left(mark, 16))) AS uuid FROM m")
def sei_records(t: Tables) -> DataFrame:
    from quarry.functions import bitstream

    return bitstream.sei(_movies(t), deep=True).select("video_id", "sample_no", "type", "size", "uuid")


@query("sps_info", _MOVIE + " SELECT video_id, 1920 AS width, 1080 AS height, 77 AS profile_idc FROM m")
def sps_info(t: Tables) -> DataFrame:
    from quarry.functions import bitstream

    return bitstream.sequence_parameters(_movies(t)).select("video_id", "width", "height", "profile_idc")


@query("metadata_items", _MOVIE + " SELECT video_id, 'itunes' AS source, '©too' AS key, source AS value, 1 AS dtype, strlen(source) AS value_len FROM m")
def metadata_items(t: Tables) -> DataFrame:
    from quarry.functions import boxes

    return boxes.metadata_items(_movies(t)).select("video_id", "source", "key", "value", "dtype", "value_len")


@query("media_coverage", _MOVIE + " SELECT video_id, 'INFO' AS severity, concat_ws(' ', 0, n % 10) AS detail FROM m")
def media_coverage(t: Tables) -> DataFrame:
    from quarry.functions import boxes
    from quarry.operators import container_rules

    movies = _movies(t)
    facts, runs, lengths = (stored(rows) for rows in (container_rules.box_facts(movies), boxes.sample_runs(movies), movies.select("video_id", "length")))
    found = container_rules.coverage(lengths, facts, runs)
    return found.filter("rule_id = 'R10'").select("video_id", "severity", "detail")


@query("private_boxes", "SELECT doc_id::VARCHAR AS video_id, 'HIGH' AS severity FROM documents WHERE doc_id % 5 = 3")
def private_boxes(t: Tables) -> DataFrame:
    from quarry.operators import container_rules

    return container_rules.credentials(container_rules.box_facts(_containers(t))).select("video_id", "severity")


@query("padding_rule", """
SELECT doc_id::VARCHAR AS video_id, CASE WHEN doc_id % 5 = 1 AND least(100, strlen(text)) + 8 > 64 THEN 'HIGH' ELSE 'INFO' END AS severity FROM documents""")
def padding_rule(t: Tables) -> DataFrame:
    from quarry.operators import container_rules

    return container_rules.padding(container_rules.box_facts(_containers(t))).select("video_id", "severity")


@query("trailing_bytes", "SELECT doc_id::VARCHAR AS video_id, 8 AS n FROM documents WHERE doc_id % 5 = 2")
def trailing_bytes(t: Tables) -> DataFrame:
    from quarry.operators import container_rules

    files = _containers(t)
    none = t.spark.createDataFrame([], "video_id string, track_no int, handler string, sample_no long, offset long, size long")
    return container_rules.coverage(files, container_rules.box_facts(files), none).filter("rule_id = 'R9'").select("video_id", F.col("detail").cast("long").alias("n"))


@query("hexdump", """
SELECT s_suppkey, lower(printf('%08X', s_suppkey * 16)) || '  ' || rpad(regexp_replace(lower(hex(left(s_name, 16))), '(..)', '\\1 ', 'g'), 48, ' ') || ' ' || left(s_name, 16) AS line FROM supplier""")
def hexdump(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", scalar.hexdump(F.left("s_name", F.lit(16)).cast("binary"), F.col("s_suppkey") * 16).alias("line"))


@query("image_kinds", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'bmp' END AS kind FROM part")
def image_kinds(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 4
    head = F.when(k == 0, F.lit(b"\x89PNG\r\n\x1a\n")).when(k == 1, F.lit(b"\xff\xd8\xff\xe0")).when(k == 2, F.lit(b"BM")).otherwise(F.lit(b"text"))
    return t.part.select("p_partkey", scalar.image_kind(F.concat(head, F.col("p_name").cast("binary"))).alias("kind"))


def _probes(t: Tables) -> DataFrame:
    """A probe sidecar an order: streams from its lines, the first a video stream."""
    stream = F.struct(
        (F.col("l_linenumber") - 1).alias("index"),
        F.when(F.col("l_linenumber") == 1, "video").when(F.col("l_linenumber") < 5, "audio").otherwise("data").alias("codec_type"),
        F.when(F.col("l_linenumber") == 1, "h264").otherwise("aac").alias("codec_name"), F.lit(1280).alias("width"), F.lit(720).alias("height"), F.lit("30/1").alias("avg_frame_rate"),
    )
    lines = t.lineitem.select("l_orderkey", "l_linenumber").distinct()
    rows = lines.groupBy(F.col("l_orderkey").cast("string").alias("video_id")).agg(F.sort_array(F.collect_list(stream)).alias("streams"))
    body = F.struct(F.struct(F.lit("10.0").alias("duration"), F.lit("1000000").alias("size"), F.lit("800000").alias("bit_rate")).alias("format"), "streams")
    return rows.select("video_id", F.to_json(body).alias("probe"))


@query("stream_rules", """
WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
k AS (SELECT l_orderkey::VARCHAR AS video_id, count(*) FILTER (l_linenumber BETWEEN 2 AND 4) AS a, count(*) FILTER (l_linenumber >= 5) AS o FROM l GROUP BY l_orderkey)
SELECT video_id, 'HIGH' AS severity, o::VARCHAR AS detail FROM k WHERE o > 0 UNION ALL SELECT video_id, 'MED', a::VARCHAR FROM k WHERE a > 1""")
def stream_rules(t: Tables) -> DataFrame:
    from quarry.operators import container_rules
    from quarry.sources import files

    probe = files.probes(_probes(t))
    rows = files.streams(probe).withColumn("disposition", F.coalesce("disposition", F.create_map().cast("map<string,int>")))
    return container_rules.stream_rules(rows, probe).select("video_id", "severity", "detail")


@query("media_facts", """
WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT l_orderkey::VARCHAR AS video_id, bool_or(l_linenumber = 1) AS has_video, bool_or(l_linenumber BETWEEN 2 AND 4) AS has_audio,
  CASE WHEN bool_or(l_linenumber = 1) THEN round(800000.0 / (1280 * 720 * 30), 6) ELSE 0.0 END AS bpp FROM l GROUP BY l_orderkey""")
def media_facts(t: Tables) -> DataFrame:
    from quarry.sources import files

    facts = files.media_facts(files.probes(_probes(t)))
    return facts.select("video_id", F.col("vcodec").isNotNull().alias("has_video"), F.col("acodec").isNotNull().alias("has_audio"), r6(F.col("bpp")).alias("bpp"))


@query("embedded_signatures", "SELECT p_partkey::VARCHAR AS video_id, 'elf' AS code, p_partkey % 2 = 0 AS ok FROM part")
def embedded_signatures(t: Tables) -> DataFrame:
    from quarry.operators import container_rules

    body = F.concat(F.lit(b"lead"), F.lit(b"\x7fELF"), F.when(F.col("p_partkey") % 2 == 0, F.lit(b"\x02\x01")).otherwise(F.lit(b"\x07\x07")), F.col("p_name").cast("binary"))
    return container_rules.signature_hits(t.part.select(F.col("p_partkey").cast("string").alias("video_id"), _box("free", body).alias("content"))).select("video_id", "code", "ok")


@query("byte_ranges", """
WITH d AS (SELECT doc_id::VARCHAR AS video_id, strlen(text) AS n FROM documents), r AS (SELECT video_id, n, unnest(range(0, n, 1000)) AS a FROM d)
SELECT video_id, a AS offset, least(1000, n - a) AS length FROM r""")
def byte_ranges(t: Tables) -> DataFrame:
    from quarry.sources import files

    rows = t.documents.select(F.col("doc_id").cast("string").alias("video_id"), F.lit("x").alias("path"), F.octet_length("text").cast("long").alias("length"))
    return files.byte_ranges(rows, 1000).select("video_id", "offset", "length")


# --- rules over planted faults ----------------------------------------------------------

_SYSTEMS = {"Widevine": "edef8ba979d64acea3c827dcd51d21ed", "PlayReady": "9a04f07998404286ab92e65be0885f95"}


def _odd_containers(t: Tables) -> DataFrame:
    """A container a document: one protection header, two, an unknown box, an unprintable name, or nothing odd."""
    header = lambda name: _box("pssh", F.lit(bytes(4) + bytes.fromhex(_SYSTEMS[name]) + bytes(4)))
    k = F.col("doc_id") % 6
    odd = F.when(k == 0, header("Widevine")).when(k == 1, F.concat(header("PlayReady"), header("Widevine"))).when(k == 2, _box("zzzz", F.lit(b"....")))
    odd = odd.when(k == 3, _box("\x01abc", F.lit(b"...."))).otherwise(F.lit(b""))
    content = F.concat(_box("ftyp", F.lit(b"isom\0\0\0\0")), odd, _box("mdat", F.coalesce("text", F.lit("")).cast("binary")))
    return t.documents.select(F.col("doc_id").cast("string").alias("video_id"), content.alias("content"))


@query("protection_boxes", """
SELECT doc_id::VARCHAR AS video_id, 'HIGH' AS severity, CASE doc_id % 6 WHEN 0 THEN '1 Widevine' ELSE '2 PlayReady,Widevine' END AS detail, '16' AS locator
FROM documents WHERE doc_id % 6 IN (0, 1)""")
def protection_boxes(t: Tables) -> DataFrame:
    from quarry.operators import container_rules

    return container_rules.protection(container_rules.box_facts(_odd_containers(t))).select("video_id", "severity", "detail", "locator")


@query("odd_boxes", """
SELECT doc_id::VARCHAR AS video_id, 'R5' AS rule_id, CASE doc_id % 6 WHEN 1 THEN '2' ELSE '1' END AS detail, '16' AS locator FROM documents WHERE doc_id % 6 < 4
UNION ALL SELECT doc_id::VARCHAR, 'R6', '1', '16' FROM documents WHERE doc_id % 6 = 3""")
def odd_boxes(t: Tables) -> DataFrame:
    from quarry.functions import boxes
    from quarry.operators import container_rules

    files = _odd_containers(t)
    return container_rules.structure(container_rules.box_facts(files), boxes.anomalies(files)).select("video_id", "rule_id", "detail", "locator")


@query("sample_faults", """
SELECT doc_id::VARCHAR AS video_id, 'R11' AS rule_id, 'HIGH' AS severity, '1' AS detail FROM documents WHERE doc_id % 4 < 2
UNION ALL SELECT doc_id::VARCHAR, 'R12', 'HIGH', '1' FROM documents WHERE doc_id % 4 < 3""")
def sample_faults(t: Tables) -> DataFrame:
    """Samples before the file, after it, and in the first box."""
    from quarry.operators import container_rules

    files, k = _containers(t), F.col("video_id").cast("long") % 4
    offset = F.when(k == 0, F.lit(-1)).when(k == 1, F.col("length")).otherwise(F.lit(0)).cast("long")
    samples = files.filter(k < 3).select("video_id", F.lit(1).alias("track_no"), F.lit("vide").alias("handler"), F.lit(0).cast("long").alias("sample_no"), offset.alias("offset"), F.lit(8).cast("long").alias("size"))
    found = container_rules.coverage(files, container_rules.box_facts(files), samples)
    return found.filter("rule_id IN ('R11', 'R12')").select("video_id", "rule_id", "severity", "detail")


@query("embedded_images", """
SELECT doc_id::VARCHAR AS video_id, 'MED' AS severity, CASE doc_id % 3 WHEN 0 THEN 'name' ELSE ' covr' END AS detail, (doc_id * 2)::VARCHAR AS locator FROM documents WHERE doc_id % 3 < 2""")
def embedded_images(t: Tables) -> DataFrame:
    """Metadata that is an image by its type or by its key."""
    from quarry.functions.rules import fingerprints
    from quarry.operators import container_rules

    k = F.col("doc_id") % 3
    items = t.documents.select(
        F.col("doc_id").cast("string").alias("video_id"), F.when(k == 1, " covr").otherwise("name").alias("key"), F.lit("plain").alias("value"),
        F.when(k == 0, 14).otherwise(1).alias("dtype"), (F.col("doc_id") * 2).alias("value_offset"),
    )
    return container_rules.metadata_rules(items, fingerprints(t.spark)).filter("rule_id = 'R13'").select("video_id", "severity", "detail", "locator")


@query("stream_flags", """
SELECT o_orderkey::VARCHAR AS video_id, 'MED' AS severity, 'disposition attached_pic' AS title, '0' AS detail FROM orders WHERE o_orderkey % 2 = 1
UNION ALL SELECT o_orderkey::VARCHAR, 'LOW', 'chapters', (o_orderkey % 3)::VARCHAR FROM orders WHERE o_orderkey % 3 > 0""")
def stream_flags(t: Tables) -> DataFrame:
    from quarry.operators import container_rules

    key, video = F.col("o_orderkey"), F.col("o_orderkey").cast("string").alias("video_id")
    flags = F.create_map(F.lit("attached_pic"), (key % 2).cast("int"), F.lit("default"), F.lit(1))
    rows = t.orders.select(video, F.lit(0).alias("index"), F.lit("video").alias("codec_type"), flags.alias("disposition"))
    probe = t.orders.select(video, F.slice(F.array(F.lit(1), F.lit(2)), F.lit(1), (key % 3).cast("int")).alias("chapters"))
    return container_rules.stream_rules(rows, probe).select("video_id", "severity", "title", "detail")


@query("unit_findings", _MOVIE + """
SELECT video_id, 'R20' AS rule_id, 'HIGH' AS severity, 'SEI ' || lower(hex(left(mark, 16))) AS title, '1' AS detail FROM m
UNION ALL SELECT video_id, 'R21', 'MED', 'coded and declared size differ', '1920x1080' FROM m WHERE video_id::BIGINT % 2 = 1""")
def unit_findings(t: Tables) -> DataFrame:
    """Messages by mark, and the size of parameter sets against a declared one that is wrong for odd ids."""
    from quarry.functions import bitstream
    from quarry.operators import container_rules

    movies = _movies(t)
    declared = t.documents.select(F.col("doc_id").cast("string").alias("video_id"), F.lit(1920).alias("width"), (1080 + 8 * (F.col("doc_id") % 2)).alias("height"))
    found = container_rules.bitstream_rules(bitstream.sei(movies, deep=True), bitstream.sequence_parameters(movies), movies.select("video_id"), declared)
    return found.select("video_id", "rule_id", "severity", "title", "detail")


@query("timing_findings", """
WITH l AS (SELECT l_orderkey AS k, l_linenumber AS o, max(CAST(l_quantity AS BIGINT)) AS n FROM lineitem GROUP BY ALL)
SELECT k::VARCHAR AS video_id, 'R25' AS rule_id, (n + 1)::VARCHAR || ' ' || n::VARCHAR AS detail, o::VARCHAR AS locator FROM l WHERE k % 2 = 1
UNION ALL SELECT k::VARCHAR, 'R26', (o % 3)::VARCHAR, o::VARCHAR FROM l WHERE o % 3 > 0 UNION ALL SELECT k::VARCHAR, 'R26', (o % 2)::VARCHAR, o::VARCHAR FROM l WHERE o % 2 > 0""")
def timing_findings(t: Tables) -> DataFrame:
    from quarry.operators import container_rules

    tracks = t.lineitem.groupBy("l_orderkey", F.col("l_linenumber").alias("ordinal")).agg(F.max(F.col("l_quantity").cast("long")).alias("samples"))
    tracks = tracks.select("l_orderkey", F.col("l_orderkey").cast("string").alias("video_id"), F.lit("vide").alias("handler"), "ordinal", "samples", (F.col("ordinal") % 3).alias("zero_deltas"), (F.col("ordinal") % 2).alias("edits"))
    declared = tracks.select("video_id", "handler", "ordinal", (F.col("samples") + F.col("l_orderkey") % 2).alias("nb_frames"))
    return container_rules.timing_rules(tracks.drop("l_orderkey"), declared).select("video_id", "rule_id", "detail", "locator")


@query("flash_findings", """
WITH n AS (SELECT user_id::VARCHAR AS video_id, count(*) FILTER (event_type = 'click') AS f, count(*) FILTER (event_type = 'view') AS c FROM events GROUP BY ALL)
SELECT video_id, CASE WHEN f > 0 THEN 'HIGH' ELSE 'INFO' END AS severity, 'single-frame flashes' AS title, f::VARCHAR AS detail FROM n
UNION ALL SELECT video_id, 'INFO', 'cuts', c::VARCHAR FROM n""")
def flash_findings(t: Tables) -> DataFrame:
    from quarry.operators import container_rules

    kinds = t.events.select(F.col("user_id").cast("string").alias("video_id"), F.when(F.col("event_type") == "click", "flash").when(F.col("event_type") == "view", "cut").alias("kind"))
    return container_rules.flash_rules(kinds, kinds.select("video_id").distinct()).select("video_id", "severity", "title", "detail")


# --- plans -----------------------------------------------------------------------------


@query("zero_plan", """
WITH s AS (SELECT p_partkey, CASE p_size % 4 WHEN 1 THEN 700 WHEN 2 THEN 1048576 + p_partkey % 2 WHEN 3 THEN 2000000 ELSE 0 END AS n FROM part)
SELECT p_partkey::VARCHAR AS video_id, p_partkey AS "offset", n AS length, CASE WHEN n >= 1048576 THEN n END AS zero_len FROM s WHERE n > 0""")
def zero_plan(t: Tables) -> DataFrame:
    """Zero fill of stretches on both sides of the length from which no bytes are carried."""
    k, size = F.col("p_partkey"), F.col("p_size") % 4
    n = F.when(size == 1, 700).when(size == 2, 1048576 + k % 2).when(size == 3, 2000000).otherwise(0).cast("long")
    spans = t.part.select(k.cast("string").alias("video_id"), k.alias("a"), (k + n).alias("b"))
    return patches.zero_patches(spans, "padding").select("video_id", "offset", patches.patch_length().alias("length"), "zero_len")


@query("metadata_plan", _MOVIE + " SELECT video_id, 'encoder' AS kind, '©too' AS label, repeat(' ', strlen(source)) AS data FROM m WHERE strlen(source) > 0")
def metadata_plan(t: Tables) -> DataFrame:
    from quarry.functions import boxes

    plan = patches.metadata_patches(boxes.metadata_items(_movies(t)), "blank")
    return plan.select("video_id", "kind", "label", F.col("data").cast("string").alias("data"))


@query("sei_plan", _MOVIE + " SELECT video_id, 36 AS length, '0C' || repeat('FF', 34) || '80' AS data FROM m")
def sei_plan(t: Tables) -> DataFrame:
    """A filler unit of the same length for each user-data message."""
    from quarry.functions import bitstream

    movies = _movies(t)
    plan = patches.sei_patches(bitstream.sei(movies, deep=True), bitstream.nals(movies, deep=True), "user-data")
    return plan.select("video_id", patches.patch_length().alias("length"), F.hex("data").alias("data"))


@query("rewrite_policies", """
SELECT p_partkey, CASE WHEN p_size % 3 = 1 THEN 'all' WHEN p_size % 3 = 2 THEN 'keep' WHEN p_partkey % 3 = 0 THEN 'keep' ELSE 'user-data' END AS sei,
  CASE p_size % 3 WHEN 1 THEN true WHEN 2 THEN false ELSE p_partkey % 2 > 0 AND p_partkey % 5 > 0 END AS remux, p_partkey % 4 < 2 AS copied, p_partkey % 4 < 3 AS encoded FROM part""")
def rewrite_policies(t: Tables) -> DataFrame:
    """What to do with messages, whether a rewrite is asked for, and whether a duration is kept."""
    k, size = F.col("p_partkey"), F.col("p_size") % 3
    policy = F.when(size == 0, "auto").when(size == 1, "all").otherwise("keep")
    transfer = F.when(k % 3 == 0, "smpte2084").when(k % 3 == 1, "bt709")
    mode = F.when(size == 0, "auto").when(size == 1, "always").otherwise("never")
    # longer by 0, 0.03, 0.2 and 0.4 seconds
    longer = F.element_at(F.array(*[F.lit(x) for x in (10.0, 10.03, 10.2, 10.4)]), (k % 4 + 1).cast("int"))
    return t.part.select(
        "p_partkey", patches.sei_policy(policy, transfer).alias("sei"), patches.remux_choice(mode, k % 2, k % 5 > 0).alias("remux"),
        patches.duration_kept(F.lit(10.0), longer).alias("copied"), patches.duration_kept(F.lit(10.0), longer, encoded=True).alias("encoded"),
    )


@query("region_choice", """
WITH r AS (SELECT p_partkey AS k, 0 AS idx, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE p_size + 100 END AS x FROM part WHERE p_partkey % 5 > 0)
SELECT k::VARCHAR AS video_id, idx, x, CASE WHEN k % 4 = 0 THEN 'listed' WHEN k % 2 = 0 THEN 'a.png' END AS layer FROM r""")
def region_choice(t: Tables) -> DataFrame:
    """Regions a person chose, else the scan's, none where none are wanted; their layers listed or found."""
    k = F.col("p_partkey")
    base = lambda rows, x, *more: rows.select(k.cast("string").alias("video_id"), F.lit(0).alias("idx"), x, *more)
    manual, scanned = base(t.part.filter((k % 3 == 0) & (k % 5 > 0)), F.col("p_size").alias("x")), base(t.part, (F.col("p_size") + 100).alias("x"))
    none = t.part.filter(k % 5 == 0).select(k.cast("string").alias("video_id"))
    listed = base(t.part.filter(k % 4 == 0), F.lit("listed").alias("path"))
    found = base(t.part.filter(k % 2 == 0), F.explode(F.array(F.lit("b.png"), F.lit("a.png"))).alias("path"))
    return patches.region_layers(patches.regions_by_priority(manual, scanned, none), listed, found)


@query("pooled_trials", """
SELECT (l_orderkey % 200)::VARCHAR AS video_id, l_returnflag AS encoder, l_linenumber AS crf, round(avg(CAST(l_quantity AS DOUBLE)), 6) AS mean, min(CAST(l_quantity AS DOUBLE)) - 5 AS worst,
  coalesce(min(CASE WHEN CAST(l_quantity AS DOUBLE) > 10 THEN CAST(l_quantity AS DOUBLE) - 10 END), 0) AS p1 FROM lineitem GROUP BY ALL""")
def pooled_trials(t: Tables) -> DataFrame:
    q = F.col("l_quantity").cast("double")
    windows = t.lineitem.select((F.col("l_orderkey") % 200).cast("string").alias("video_id"), F.col("l_returnflag").alias("encoder"), F.col("l_linenumber").alias("crf"), F.lit("vmaf").alias("metric"), q.alias("mean"), (q - 5).alias("worst"), (q - 10).alias("p1"))
    return selection.pooled_quality(windows).select("video_id", "encoder", "crf", r6(F.col("mean")).alias("mean"), "worst", "p1")


@query("container_findings")
def container_findings(t: Tables) -> DataFrame:
    from quarry.operators import container_rules

    return container_rules.scan(_containers(t))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quarry import media_queries  # noqa: F401  registers its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from quarry import media_queries  # noqa: F401

    return dict(ORACLES)
