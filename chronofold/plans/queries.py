"""The library's queries over the driver's tables, each with the SQL that gives the same rows.

The tables hold no statutes, so a query runs its operators on a table of the same shape: ``events`` is an operation
log (a user is a law, ``error`` a repeal, ``purchase`` an overwrite, ``signup`` an insert), and so on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.evaluate import score
from chronofold.functions import text as t
from chronofold.operators import align, fold, history, numbering, oplog, register, segment
from chronofold.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

AS_OF = "2024-01-15 00:00:00"
MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- point in time


@query(f"""
SELECT user_id, r.v AS value FROM (
  SELECT user_id, list_reduce(list({{'k': event_type, 'v': value}} ORDER BY ts, event_id),
    lambda a, e: CASE WHEN e.k = 'error' THEN {{'k': 'd', 'v': NULL}} WHEN e.k = 'purchase' THEN {{'k': 's', 'v': e.v}}
                      WHEN e.k = 'signup' AND a.v IS NULL THEN {{'k': 's', 'v': e.v}} ELSE a END,
    {{'k': 'd', 'v': NULL::DOUBLE}}) AS r
  FROM events WHERE ts <= TIMESTAMP '{AS_OF}' GROUP BY user_id)
WHERE r.v IS NOT NULL""")
def pit_state_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").where(F.col("ts") <= F.lit(AS_OF).cast("timestamp_ntz"))
    kind = F.col("event_type")
    return fold.whole_state(log, ["user_id"], F.struct("ts", "event_id"), kind == "purchase", kind == "signup", kind == "error", "value")


@query(f"""
SELECT user_id, event_id, event_type AS why, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at FROM events
WHERE event_type IN ('click', 'view') AND ts <= TIMESTAMP '{AS_OF}'""")
def pit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").where(F.col("ts") <= F.lit(AS_OF).cast("timestamp_ntz"))
    return log.where(~F.col("event_type").isin("purchase", "signup", "error")).select("user_id", "event_id", F.col("event_type").alias("why"), F.date_format("ts", MICROS).alias("at"))


@query("""
SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest, count(*) AS parts FROM (
  SELECT *, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS said FROM conversations)
WHERE turn >= said AND (turn = said OR role = 'assistant') GROUP BY conv_id""")
def turn_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    last = turns.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("said"))
    since = turns.join(last, "conv_id").where("turn = said OR (turn > said AND role = 'assistant')")
    parts = since.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"))
    return parts.select("conv_id", F.md5(F.array_join(F.col("p.text"), "\n").cast("binary")).alias("digest"), F.size("p").cast("long").alias("parts"))


# ---- the log


@query("""
WITH both_streams AS (
  SELECT 1 AS stream_rank, event_id, user_id, event_type, date_trunc('day', ts)::DATE::VARCHAR AS day, value FROM events
  UNION ALL SELECT 2, event_id, user_id, event_type, date_trunc('day', ts)::DATE::VARCHAR, value + 1 FROM events WHERE event_id % 3 = 0)
SELECT user_id, event_type, day, stream_rank, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type, day ORDER BY stream_rank, event_id) AS n FROM both_streams)
WHERE n = 1""")
def oplog_union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("date").cast("string").alias("day"), "value")
    second = events.where("event_id % 3 = 0").withColumn("value", F.col("value") + 1)
    streams = oplog.union(events.withColumn("stream_rank", F.lit(1)), second.withColumn("stream_rank", F.lit(2)))
    return oplog.keep_first(streams, ["user_id", "event_type", "day"], ["stream_rank", "event_id"])


@query("""
SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d ') || (hour(ts) // 6) AS slot FROM events WHERE event_type = 'purchase'
UNION ALL
SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d ') || (hour(ts) // 6) FROM events r WHERE event_type = 'signup' AND NOT EXISTS (
  SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = r.user_id AND strftime(p.ts, '%Y-%m-%d ') || (hour(p.ts) // 6) = strftime(r.ts, '%Y-%m-%d ') || (hour(r.ts) // 6))""")
def recovery_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.concat(F.date_format("ts", "yyyy-MM-dd "), F.floor(F.hour("ts") / 6).cast("string")).alias("slot"))
    return oplog.gap_fill(events.where("event_type = 'purchase'"), events.where("event_type = 'signup'"), ["user_id", "slot"])


@query("""
SELECT doc_id, lang, length(coalesce(b.text, left(d.text, 100))) AS length, b.text IS NOT NULL AS patched
FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id""")
def override_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut, _ = t.bounded(F.col("text"), 100)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", cut.alias("text"), F.lit(False).alias("patched"))
    blocks = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text", F.lit(True).alias("patched"))
    patched = oplog.override(oplog.override(docs, blocks, ["doc_id"], "text"), blocks, ["doc_id"], "patched")
    return patched.select("doc_id", "lang", F.length("text").cast("long").alias("length"), "patched")


@query("""
SELECT user_id, arg_max(event_type, {'ts': ts, 'id': event_id}) AS event_type FROM events GROUP BY user_id
HAVING arg_max(event_type, {'ts': ts, 'id': event_id}) IN ('purchase', 'signup')""")
def last_kind_reconstructable(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = oplog.last_kind(table(spark, sf_dir, "events"), ["user_id"], "event_type", F.struct("ts", "event_id"))
    return last.where("event_type IN ('purchase', 'signup')")


@query("""
WITH own AS (SELECT o_orderkey::VARCHAR AS datokode, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END AS own_date, o_orderstatus FROM orders),
triggers AS (SELECT l_orderkey::VARCHAR AS datokode, count(*) AS n, min(strftime(l_shipdate, '%Y-%m-%d')) AS first FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT own.datokode, own_date, coalesce(n, 0)::INTEGER AS n_triggers, coalesce(own_date, first) AS resolved,
       CASE WHEN own_date IS NOT NULL THEN 'concrete' WHEN first IS NOT NULL THEN 'triggered' ELSE 'deferred_untriggered' END AS status
FROM own LEFT JOIN triggers USING (datokode)""")
def inforce_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    acts = orders.select(F.col("o_orderkey").cast("string").alias("datokode"), F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("own_date"))
    triggers = items.where("l_linestatus = 'O'").select(F.col("l_orderkey").cast("string").alias("datokode"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"))
    found = oplog.in_force(acts, triggers)
    return found.select("datokode", "own_date", F.size("trigger_dates").alias("n_triggers"), "resolved", "status")


# ---- history


@query("""
SELECT user_id, event_id, event_type FROM (
  SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
WHERE n = 1 OR before IS DISTINCT FROM event_type""")
def change_only_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.changes_only(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@query("""
SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS valid_from, strftime(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), '%Y-%m-%d %H:%M:%S.%f') AS valid_to
FROM events WHERE event_type IN ('purchase', 'signup')""")
def validity_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'signup')")
    spans = history.validity(versions, ["user_id"], "ts", ["ts", "event_id"])
    return spans.select("user_id", "event_id", F.date_format("ts", MICROS).alias("valid_from"), F.date_format("valid_to", MICROS).alias("valid_to"))


@query("""
SELECT q.user_id, q.event_id, v.event_id AS version_id, v.value AS value
FROM (SELECT * FROM events WHERE event_type = 'view') q
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') v ON q.user_id = v.user_id AND q.ts >= v.ts""")
def asof_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    asked = events.where("event_type = 'view'").select("user_id", "event_id", "ts")
    versions = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("version_id"), F.col("ts").alias("starts"), "value")
    return history.as_of_join(asked, versions, ["user_id"], "ts", "starts", ["version_id"]).select("user_id", "event_id", "version_id", "value")


# ---- the register


@query("""
SELECT l_suppkey AS act, count(DISTINCT l_partkey) AS n_laws, count(*) AS n_ops, list_sort(list(DISTINCT l_partkey))[1:5]::VARCHAR AS first_laws
FROM lineitem GROUP BY l_suppkey""")
def register_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("act"), F.col("l_partkey").alias("law"), F.lit(None).cast("string").alias("title"))
    made = register.index(rows, "act", "law", "title")
    return made.select("act", "n_laws", "n_ops", F.concat(F.lit("["), F.array_join(F.slice("affected_laws", 1, 5).cast("array<string>"), ", "), F.lit("]")).alias("first_laws"))


_GAPS = """
WITH want AS (SELECT DISTINCT l_partkey AS law, l_suppkey AS act FROM lineitem),
have AS (SELECT DISTINCT l_partkey AS law, l_suppkey AS act FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey % 10 <> 0),
per_law AS (
  SELECT want.law, count(*) AS edges, count(have.act) AS hit,
         count(*) FILTER (have.act IS NULL AND want.act IN (SELECT act FROM have)) AS mistargeted,
         count(*) FILTER (have.act IS NULL AND want.act NOT IN (SELECT act FROM have)) AS absent
  FROM want LEFT JOIN have USING (law, act) GROUP BY want.law)
"""


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("law"), F.col("l_suppkey").alias("act"), "l_returnflag")
    return register.gaps(items, items.where("l_returnflag = 'R' AND act % 10 <> 0"))


@query(_GAPS + "SELECT * FROM per_law")
def register_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir)


@query(_GAPS + """
SELECT sum(edges)::BIGINT AS edges, sum(hit)::BIGINT AS hit, sum(mistargeted)::BIGINT AS mistargeted, sum(absent)::BIGINT AS absent,
       (100 * sum(hit) // sum(edges))::BIGINT AS hit_pct, (100 * sum(mistargeted) // sum(edges))::BIGINT AS mistargeted_pct, (100 * sum(absent) // sum(edges))::BIGINT AS absent_pct
FROM per_law""")
def register_gap_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register.gap_totals(_gaps(spark, sf_dir))


@query(_GAPS + "SELECT law, mistargeted FROM per_law ORDER BY mistargeted DESC, law LIMIT 20")
def topk_recoverable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir).select("law", "mistargeted").orderBy(F.desc("mistargeted"), "law").limit(20)


@query("""
SELECT c_custkey AS law FROM customer INTERSECT SELECT o_custkey FROM orders
EXCEPT SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1""")
def candidate_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("law"), "c_nationkey")
    held = customers.join(table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey", "left_semi")
    return readers.candidates(customers, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("law")), held)


# ---- text


@query(r"""
SELECT doc_id, md5(trim(regexp_replace(lower(regexp_split_to_array(text, '\b(?:Endret|Endra|Opphevet|Oppheva)\s+ved\b|\bLov nr\.\s*\d+\b')[1]), '[^a-z0-9æøå]+', ' ', 'g'))) AS digest
FROM documents""")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.canonical(F.col("text")).cast("binary")).alias("digest"))


@query(r"""
SELECT doc_id, count(*) AS lines, count(*) FILTER (NOT regexp_full_match(trim(line, E' \t\r\v\f'), '\d{1,4}')) AS kept FROM (
  SELECT doc_id, unnest(string_split(text || chr(10) || (doc_id % 500)::VARCHAR, chr(10))) AS line FROM documents) GROUP BY doc_id""")
def strip_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    paged = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\n"), (F.col("doc_id") % 500).cast("string")).alias("text"))
    lines = lambda c: F.size(F.split(c, "\n")).cast("long")
    return paged.select("doc_id", lines(F.col("text")).alias("lines"), lines(t.without_running_headers(F.col("text"))).alias("kept"))


@query(r"""
SELECT doc_id, length(regexp_split_to_array(text || ' Endret ved lov 3', '\bEndret\s+ved\b')[1]) AS kept FROM documents""")
def annot_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    noted = F.concat("text", F.lit(" Endret ved lov 3"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(t.without_provenance(noted)).cast("long").alias("kept"))


@query(r"""
SELECT doc_id, (unnest(range(len(parts))))::INTEGER AS at, md5(unnest(parts)) AS digest FROM (
  SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)""")
def line_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = segment.split_into(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "\n")
    return parts.select("doc_id", "at", F.md5(F.col("part").cast("binary")).alias("digest"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\.\s+[^\p{Ll}\s]')) + (trim(text, ' ' || chr(10)) <> '')::INTEGER AS sentences FROM documents")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(segment.sentences(F.col("text"))).cast("long").alias("sentences"))


@query(r"""
SELECT doc_id, n, md5(trim(regexp_split_to_array(text, '\(\d+\)\s*')[n_at + 2])) AS digest FROM (
  SELECT doc_id, text, unnest(regexp_extract_all(text, '\((\d{1,9})\)\s*', 1))::INTEGER AS n, unnest(range(len(regexp_extract_all(text, '\(\d{1,9}\)')))) AS n_at FROM documents)""")
def para_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "documents").select("doc_id", F.explode(segment.numbered_parts(F.col("text"))).alias("p"))
    return parts.select("doc_id", "p.n", F.md5(F.col("p.text").cast("binary")).alias("digest"))


@query("""
SELECT doc_id, start::INTEGER AS start, md5(substr(text, start + 1, 1800)) AS digest FROM (
  SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 1650)) AS start FROM documents WHERE length(text) > 0)
WHERE start = 0 OR start + 150 < length(text)""")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = segment.windows(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 1800, 150)
    return cut.select("doc_id", "start", F.md5(F.col("chunk").cast("binary")).alias("digest"))


@query("""
SELECT doc_id, md5(replace(replace(replace(text, 'the', 'THE'), 'THE ', 'A '), 'que', 'QUE')) AS digest FROM documents""")
def term_reform(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("all").alias("law"), "doc_id", "text")
    rows = [("2001-01-01", 1, "the", "THE"), ("2002-01-01", 2, "THE ", "A "), ("2003-01-01", 3, "que", "QUE"), ("2099-01-01", 4, "a", "b")]
    reforms = spark.createDataFrame([("all", o, n, d, d, k) for d, k, o, n in rows], "target_law string, term_old string, term_new string, date_in_force_resolved string, date_in_force string, line_no int")
    return fold.reform(docs, F.broadcast(reforms), "2050-01-01").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


_VISIBLE = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '[ \t\r\n\f\v ]+', ' ', 'g'))"""


@query(f"SELECT page_id, length({_VISIBLE}) AS length, md5({_VISIBLE}) AS digest FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = t.page_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(text).cast("long").alias("length"), F.md5(text.cast("binary")).alias("digest"))


@query(r"""
SELECT page_id, unnest(range(len(items)))::INTEGER AS at, trim(regexp_replace(regexp_replace(unnest(items), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS item FROM (
  SELECT page_id, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) AS items FROM pages)""")
def html_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?s)<li>(.*?)</li>"), F.lit(1))).alias("at", "raw"))
    return items.select("page_id", "at", t.tag_text(F.col("raw")).alias("item"))


@query(r"""
WITH tags AS (SELECT page_id, unnest(range(len(x))) AS pos, unnest(x) AS tag FROM (SELECT page_id, regexp_extract_all(html, '(?s)<h[1-6][^>]*>.*?</h[1-6]>|<p>') AS x FROM pages))
SELECT page_id, pos::INTEGER AS pos, md5(heading) AS heading FROM (
  SELECT page_id, pos, tag, last_value(CASE WHEN tag <> '<p>' THEN tag END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading FROM tags)
WHERE tag = '<p>'""")
def html_nearest_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?s)<h[1-6][^>]*>.*?</h[1-6]>|<p>"), F.lit(0))).alias("pos", "tag"))
    found = segment.nearest_before(tags.where("tag <> '<p>'"), tags.where("tag = '<p>'").select("page_id", "pos"), ["page_id"], "pos", "tag")
    return found.select("page_id", "pos", F.md5(F.col("tag").cast("binary")).alias("heading"))


@query(r"""
SELECT page_id, slice_end - pos AS length FROM (
  SELECT page_id, pos, coalesce(lead(pos) OVER (PARTITION BY page_id ORDER BY pos), n) AS slice_end FROM (
    SELECT page_id, length(html) AS n, unnest(list_transform(range(len(parts) - 1), lambda i: list_sum(list_transform(parts[1:i + 1], lambda p: length(p))) + 3 * i))::BIGINT AS pos FROM (
      SELECT page_id, html, string_split(html, '<p>') AS parts FROM pages)))""")
def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.length("html").alias("n"), F.split("html", "<p>").alias("parts"))
    ends = F.aggregate(F.slice("parts", 1, F.size("parts") - 1), F.array(F.lit(-3)), lambda a, p: F.array_append(a, F.element_at(a, -1) + 3 + F.length(p)))
    marks = pages.select("page_id", "n", F.explode(F.slice(ends, 2, F.size("parts") - 1)).alias("pos"))
    return segment.slices(marks, ["page_id"], "pos", F.col("n")).select("page_id", (F.col("slice_end") - F.col("pos")).cast("long").alias("length"))


# ---- evaluation


@query("""
SELECT source, count(*) AS n, count(*) FILTER (sim >= 0.9) AS matched, round(avg((sim >= 0.9)::INTEGER::DOUBLE), 6) AS rate, round(avg((sim >= 0.98)::INTEGER::DOUBLE), 6) AS strict_rate, round(avg(sim), 6) AS mean
FROM (SELECT source, (n_chars % 201)::DOUBLE / 200 AS sim FROM documents JOIN labels USING (doc_id) WHERE toxic = 0) GROUP BY source""")
def scope_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("toxic = 0").select("doc_id"), "doc_id")
    sims = docs.select("source", F.col("doc_id").cast("string").alias("para"), ((F.col("n_chars") % 201) / 200).alias("sim"))
    rows = score.law_scores(sims, ["source"], F.lit(score.OCR))
    strict = sims.groupBy("source").agg(score.rate(F.col("sim") >= score.STRICT).alias("strict_rate"))
    return rows.join(strict, "source").select("source", "n", "matched", F.round("rate", 6).alias("rate"), F.round("strict_rate", 6).alias("strict_rate"), F.round("mean", 6).alias("mean"))


@query("""
SELECT count(*) AS n, median(rate) AS median, round(avg(rate), 6) AS mean, count(*) FILTER (rate >= 0.9) AS at_90, count(*) FILTER (rate >= 0.98) AS at_98
FROM (SELECT o_custkey, avg((o_orderstatus = 'F')::INTEGER::DOUBLE) AS rate FROM orders GROUP BY o_custkey)""")
def law_median_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_law = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(score.rate(F.col("o_orderstatus") == "F").alias("rate"))
    return score.breadth(per_law).withColumn("mean", F.round("mean", 6))


@query("""
SELECT CASE WHEN grouping(source) = 1 THEN NULL ELSE source END AS law, bucket, count(*) AS n, max(lever) AS lever FROM (
  SELECT source, CASE WHEN quality = 0 THEN 'base-missing' WHEN toxic = 1 THEN 'applied-wrong' ELSE 'base-ocr-noise' END AS bucket,
         CASE WHEN quality = 0 THEN 'base' WHEN toxic = 1 THEN 'coverage' ELSE 'OCR' END AS lever FROM documents JOIN labels USING (doc_id))
GROUP BY GROUPING SETS ((source, bucket), (bucket))""")
def bucket_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.when(F.col("quality") == 0, "base-missing").when(F.col("toxic") == 1, "applied-wrong").otherwise("base-ocr-noise")
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("source").alias("law"), bucket.alias("bucket"))
    return score.miss_table(docs)


@query("""
SELECT source AS bucket, place, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id)::INTEGER AS place FROM documents) WHERE place <= 12""")
def topk_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("bucket"), "doc_id", "n_chars")
    return numbering.top_of_each(docs, ["bucket"], [F.col("n_chars"), F.col("doc_id")], 12).select("bucket", "place", "doc_id")


@query("""
SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer) WHERE place % 5 = 0""")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbering.systematic_sample(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], 5)


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def contamination_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.verbatim(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def kind_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.histogram(table(spark, sf_dir, "events"), "event_type")


@query("SELECT count(DISTINCT source) AS laws, count(*) AS versions FROM (SELECT DISTINCT source, lang FROM documents)")
def truth_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.coverage(table(spark, sf_dir, "documents").select(F.col("source").alias("law"), F.col("lang").alias("date")))


@query("""
SELECT reason, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, reason)::INTEGER AS place FROM (
  SELECT CASE WHEN item_id IS NULL THEN 'no-anchor' WHEN n_chars < length(b.text) THEN 'source-too-short' ELSE 'anchor-' || lang END AS reason
  FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id) GROUP BY reason""")
def unresolved_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.length("text").alias("long"))
    docs = table(spark, sf_dir, "documents").join(quoted, "doc_id", "left")
    reason = F.when(F.col("long").isNull(), "no-anchor").when(F.col("n_chars") < F.col("long"), "source-too-short").otherwise(F.concat(F.lit("anchor-"), "lang"))
    return score.unresolved_reasons(docs.select(reason.alias("reason")))


@query("SELECT c_custkey AS law FROM customer UNION SELECT o_custkey FROM orders UNION SELECT user_id FROM events WHERE user_id IS NOT NULL")
def law_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    law = lambda name, column: table(spark, sf_dir, name).select(F.col(column).alias("law"))
    return oplog.universe(law("customer", "c_custkey"), law("orders", "o_custkey"), law("events", "user_id"))


# ---- similarity: provisions of two versions of each law, as the alignment is for; a conversation is a law, a turn a provision


def _two_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every conversation's turns, and a later version of them: the second turn and those behind it moved by one, each third worded with a word more."""
    turns = table(spark, sf_dir, "conversations")
    first = turns.select("conv_id", F.col("turn").alias("id"), "text")
    moved = F.when(F.col("turn") >= 2, F.col("turn") + 1).otherwise(F.col("turn"))
    later = turns.select("conv_id", moved.alias("id"), F.when(F.col("turn") % 3 == 1, F.concat("text", F.lit(" ny"))).otherwise(F.col("text")).alias("text"))
    return first, later


_ALIKE = """
WITH versions AS (
  SELECT conv_id, turn AS a_id, CASE WHEN turn >= 2 THEN turn + 1 ELSE turn END AS b_id, turn % 3 = 1 AS worded,
         length(trim(regexp_replace(lower(text), '[^a-z0-9æøå]+', ' ', 'g'))) AS n FROM conversations),
alike AS (
  SELECT conv_id, a_id, b_id, CASE WHEN NOT worded THEN 1.0::DOUBLE WHEN n = 0 THEN 0.0 ELSE 2.0::DOUBLE * n / (2 * n + 3) END AS score FROM versions)
SELECT conv_id, a_id, b_id, round(score, 4) AS score FROM alike WHERE score >= 0.9"""


@query(_ALIKE)
def similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, later = _two_versions(spark, sf_dir)
    return align.pairs(first, later, 0.9, ["conv_id"]).withColumn("score", F.round("score", 4))


@query(_ALIKE)
def mutual_best_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, later = _two_versions(spark, sf_dir)
    return align.mutual_best(first, later, 0.9, ["conv_id"])


@query(_ALIKE + " AND a_id <> b_id")
def renumber_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, later = _two_versions(spark, sf_dir)
    return align.renumbered(align.mutual_best(first, later, 0.9, ["conv_id"]))


def _similar_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return align.classes(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), 0.9)


@query()
def document_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of equal wording, and how many other classes are at least 0.9 like it; all texts whole, across sources."""
    members = _similar_documents(spark, sf_dir)[0]
    return members.select(F.col("id").alias("doc_id"), "class_id", "links")


@query()
def document_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of classes behind ``document_similarity`` with their ratios."""
    return _similar_documents(spark, sf_dir)[1].withColumn("score", F.round("score", 4))


@query("""
SELECT t.conv_id, t.turn, md5(regexp_replace(b.text, '\\s+', '', 'g')) AS before, md5(regexp_replace(t.text, '\\s+', '', 'g')) AS after FROM conversations t JOIN conversations b ON b.conv_id = t.conv_id AND b.turn + 1 = t.turn""")
def redline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent turns' redlines, of which both sides are put together again (but for white space, which separates runs)."""
    turns = table(spark, sf_dir, "conversations")
    pairs = turns.join(turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before")), ["conv_id", "turn"])
    runs = history.redline(pairs.select("conv_id", "turn", "before", "text"), "before", "text")
    side = lambda other: F.md5(F.regexp_replace(F.array_join(F.transform(F.filter("redline", lambda r: r["op"] != other), lambda r: r["text"]), ""), r"\s+", "").cast("binary"))
    return runs.select("conv_id", "turn", side("new").alias("before"), side("gone").alias("after"))
