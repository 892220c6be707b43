"""Queries of what takes sources in and keeps results up to date, over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.operators import segment
from chronofold.operators.numbering import own_folder
from chronofold.plans import refresh
from chronofold.plans.builds import WORDS, _documents, digest
from chronofold.plans.queries import AS_OF, MICROS, query, table
from chronofold.sources import readers
from chronofold.streaming import page_sink


def _event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a log: a user is a law of three provisions, a purchase words one anew, an error repeals it, the rest moves it."""
    k, kind = (F.col("event_id") % 3).cast("string"), F.col("event_type")
    said = F.concat(F.lit("§ "), k, F.when(kind == "purchase", " skal lyde:").when(kind == "error", " oppheves").otherwise(" flyttes"))
    payload = F.when(kind == "purchase", F.concat(F.lit("§ "), k, F.lit(". verdi "), F.col("event_id").cast("string")))
    change = F.when(kind == "purchase", "change").when(kind == "error", "repeal").otherwise("move")
    return table(spark, sf_dir, "events").where("user_id IS NOT NULL").select(
        F.col("user_id").cast("string").alias("law"), F.concat(F.lit("§"), k).alias("para"), F.lit("").alias("act"), F.date_format("ts", MICROS).alias("date"),
        change.alias("change_type"), said.alias("instruction"), payload.alias("new_text"), F.lit(0).alias("stream_rank"), F.col("event_id").alias("line_no"), F.lit(0).alias("piece_no"),
    )


@query("""
SELECT user_id::VARCHAR AS law, '§' || event_id % 3 AS para, 'verdi ' || event_id AS text FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type IN ('purchase', 'error') AND user_id IS NOT NULL)
WHERE n = 1 AND event_type = 'purchase'""")
def refreshed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of all laws as of a date, brought up to the whole log; equal to a full fold, though only changed laws were folded again."""
    folder = own_folder(spark, "refreshed")
    log = _event_log(spark, sf_dir)
    none = spark.createDataFrame([], "law string, para string, text string")
    refresh.refresh(spark, none, log.where(F.col("date") <= AS_OF), folder)
    refresh.refresh(spark, none, log, folder)
    return refresh.state(spark, folder)


@query("""
SELECT source AS urn, doc_id::INTEGER AS page, md5(coalesce(text, '')) AS digest, NULL::VARCHAR AS reason, count(*) OVER () AS rows FROM documents WHERE doc_id % 10 <> 0
UNION ALL SELECT NULL, NULL, NULL, 'no-json', (SELECT count(*) FROM documents) - count(*) OVER () FROM documents WHERE doc_id % 10 = 0""")
def harvested_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a page in a JSON line, each tenth of them cut off; ``rows`` is what the progress says of its kind."""
    folder = own_folder(spark, "harvest")
    line = F.to_json(F.struct(F.col("source").alias("urn"), F.col("doc_id").cast("int").alias("page"), "text"))
    table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 10 == 0, F.substring(line, 1, 30)).otherwise(line).alias("value")).repartition(3).write.text(f"{folder}/in")
    page_sink.harvest(spark, f"{folder}/in", f"{folder}/out", files=2).awaitTermination()
    counts = page_sink.progress(spark, f"{folder}/out").agg(F.sum("pages").alias("pages"), F.sum(F.col("lines") - F.col("dead")).alias("whole")).first()
    pages = spark.read.parquet(f"{folder}/out/pages").select("urn", "page", digest("text").alias("digest"), F.lit(None).cast("string").alias("reason"), F.lit(counts.pages).cast("long").alias("rows"))
    dead = spark.read.parquet(f"{folder}/out/dead")
    none = F.lit(None)
    return pages.unionByName(dead.select(none.cast("string").alias("urn"), none.cast("int").alias("page"), none.cast("string").alias("digest"), "reason", F.lit(counts.whole).cast("long").alias("rows")))


@query("""
SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN NULL WHEN 0 THEN 'URN:NBN:no-a' || doc_id ELSE 'URN:NBN:no-b' || doc_id END AS urn FROM documents""")
def catalogue_urns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue answers with a document's whole text beside URNs in names, in lists, behind an escape, and in members of members."""
    no = F.col("doc_id").cast("string")
    said = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("URN:NBN:name")))
    first = F.concat(F.lit('{"z": {"deep": [1, {"id": "\\u0055RN:NBN:no-a'), no, F.lit('"}]}, "a": "URN:NBN:no-later"}'))
    listed = F.concat(F.lit('{"list": ["URN:NBN:no-listed", "x"], "text": '), said, F.lit(', "URN:NBN:key": null, "meta": {"k": "a URN:NBN:no", "urn": "URN:NBN:no-b'), no, F.lit('"}}'))
    after = F.concat(F.lit('[{"text": '), said, F.lit('}, [["URN:NBN:no-listed"], {"urn": "URN:NBN:no-b'), no, F.lit('"}], {"urn": "URN:NBN:no-later"}]'))
    broken = F.concat(F.lit('{"urn": "URN:NBN:no-b'), no)
    answer = F.when(F.col("doc_id") % 4 == 0, first).when(F.col("doc_id") % 4 == 1, listed).when(F.col("doc_id") % 4 == 2, after).otherwise(broken)
    return table(spark, sf_dir, "documents").select("doc_id", readers.first_urn(answer).alias("urn"))


SIZE, OVERLAP = 2_000, 300
_HEADS = [f"Lov nr. {k} av mai om sak {k}" for k in (1, 2, 3)]


def _acts_text() -> Column:
    return F.concat(*(x for k, h in enumerate(_HEADS) for x in (F.lit(("\n" if k else "") + h + "\n"), F.col("words"))), F.lit(f"\n{_HEADS[0]}\nslutt"))


@query(f"""
WITH docs AS (SELECT doc_id, {WORDS} AS w FROM documents), heads AS (SELECT unnest([1, 2, 3]) AS nr)
SELECT doc_id, nr, ((nr - 1) * (length(w) + {len(_HEADS[0]) + 2}))::INTEGER AS at,
       md5('Lov nr. ' || nr || ' av mai om sak ' || nr || chr(10) || w || chr(10) || CASE WHEN nr = 3 THEN '{_HEADS[0]}' || chr(10) || 'slutt' ELSE '' END) AS digest FROM docs, heads""")
def window_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is an issue of three acts, the first of whose headings comes again as a running head; windows quote what they hold whole."""
    docs = _documents(spark, sf_dir).withColumn("issue", _acts_text()).select("doc_id", "issue")
    cut = segment.windows(docs, "issue", SIZE, OVERLAP)
    quotes = F.array(*(F.when(F.col("chunk").contains(h), F.struct(F.lit(9 - k).alias("n"), F.lit(k + 1).alias("nr"), F.lit("").alias("date"), F.lit(h).alias("title"), F.lit(h.replace(" ", "  ")).alias("anchor"))) for k, h in enumerate(_HEADS)))
    marks = cut.select("doc_id", "start", F.explode(F.filter(quotes, lambda x: x.isNotNull())).alias("m")).select("doc_id", "start", "m.*")
    acts = segment.window_marks(docs, marks, ["doc_id"], "issue", SIZE, OVERLAP)
    return acts.select("doc_id", "nr", F.col("at").cast("int").alias("at"), digest("body").alias("digest"))
