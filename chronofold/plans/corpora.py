"""Queries of the editor, the act parsers, the register and the scores over whole tables, each with its SQL.

Every document becomes a statute, an act or a page by expression, whole; every conversation is a law whose turns are
provisions. ``builds.WORDS`` keeps a text's letters only, so that what the parsers take as their own marks cannot stand in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.evaluate import score
from chronofold.functions import text as t
from chronofold.operators import fold, history, oplog, register, segment
from chronofold.plans.builds import WORDS, _documents, digest
from chronofold.plans.queries import query, table
from chronofold.plans.reconstruct import reconstruct, state
from chronofold.plans.recover import recover
from chronofold.sources import readers, writers

RAW_OP = "act_refid string, target_law string, paragraph string, change_type string, instruction string, new_text string, date_in_force_resolved string, date_in_force string, target string, stream_rank int, line_no bigint"


def join(*parts: str | Column) -> Column:
    """Columns and literal strings end to end."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with ``no``, their id as a string, and ``words``."""
    return _documents(spark, sf_dir).withColumn("no", F.col("doc_id").cast("string"))


def no() -> Column:
    return F.col("no")


def words() -> Column:
    return F.col("words")


def day() -> Column:
    return F.col("doc_id") % 28 + 1


def _raw_ops(rows: DataFrame, law: Column, n: int, paragraph: str, change: str, said: Column, payload: Column, date: str) -> DataFrame:
    values = (F.lit(f"2000-01-01-{n + 1}"), law, F.lit(paragraph), F.lit(change), said, payload, F.lit(date), F.lit(None), F.lit(None), F.lit(1), F.lit(n))
    named = [c.split(" ") for c in RAW_OP.split(", ")]
    return rows.select(*(v.cast(kind).alias(name) for v, (name, kind) in zip(values, named, strict=True)))


# ---- edits below the provision


def _edited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every document a law of three provisions: the first takes one of nine edits, the second is worded anew, the third by its content."""
    docs = _numbered(spark, sf_dir).withColumn("k", F.col("doc_id") % 9)
    own = join("Tittel\n(1) Alfa en. Alfa to.\n(2) ", F.trim(join(words(), " slutt")), "\n(3) Gamma a) første b) andre c) tredje")
    like = join("Tittel\n(1) Frist er ", no(), " dager.\n(2) Gebyr er ", no(), " kroner.\n(3) Klage sendes departementet.")
    base = lambda para, text: docs.select(no().alias("law"), F.lit(para).alias("para"), text.alias("text"), F.lit(None).cast("string").alias("base_as_of"))
    bases = base("§1", own).unionByName(base("§2", F.lit("gammel"))).unionByName(base("§5", like))
    new = F.trim(join("Ny ", words()))
    edits = {
        0: ("repeal", "§ 1 andre ledd oppheves", F.lit(None)), 1: ("change", "§ 1 første ledd andre punktum skal lyde:", join(new, ".")), 2: ("change", "§ 1 første ledd nytt andre punktum skal lyde:", join(new, ".")),
        3: ("change", "§ 1 tredje ledd bokstav b skal lyde:", join("b) ", new)), 4: ("repeal", "§ 1 tredje ledd bokstav a oppheves", F.lit(None)), 5: ("change", "§ 1 tredje ledd ny bokstav b skal lyde:", join("b) ", new)),
        6: ("change", "§ 1 nytt fjerde ledd skal lyde:", join("(4) Kort ", no())), 7: ("change", "§ 1 sjette ledd bokstav a skal lyde:", new), 8: ("change", "§ 1 nytt andre til tredje ledd skal lyde:", join("(2) ", new, " (3) Tre")),
    }
    raw = [_raw_ops(docs.where(F.col("k") == k), no(), k, "§ 1", change, F.lit(said), payload, "2001-01-01") for k, (change, said, payload) in edits.items()]
    raw.append(_raw_ops(docs, no(), 20, "§ 2", "change", F.lit("§ 2 skal lyde:"), join("§ 2. ", new), "2002-01-01"))
    raw.append(_raw_ops(docs.where("k = 7"), no(), 21, "§ 1", "renumber", F.lit("§ 1 blir § 3"), F.lit(None), "2003-01-01"))
    raw.append(_raw_ops(docs, no(), 22, "§ 5", "change", F.lit("§ 5 første ledd skal lyde:"), join("(2) Gebyr er ", no(), " 5 kroner."), "2004-01-01"))
    return bases, oplog.union(*raw)


_NEW = f"trim('Ny ' || {WORDS})"


@query(f"""
WITH parts AS (SELECT doc_id, doc_id % 9 AS k, {_NEW} AS new, '(1) Alfa en. Alfa to.' AS a, trim({WORDS} || ' slutt') AS b, 'Gamma a) første b) andre c) tredje' AS c FROM documents)
SELECT doc_id, '§1' AS para, md5('Tittel' || chr(10) || CASE k
  WHEN 0 THEN a || chr(10) || '(2) ' || c
  WHEN 1 THEN '(1) Alfa en. ' || new || '.' || chr(10) || '(2) ' || b || chr(10) || '(3) ' || c
  WHEN 2 THEN '(1) Alfa en. ' || new || '. Alfa to.' || chr(10) || '(2) ' || b || chr(10) || '(3) ' || c
  WHEN 3 THEN a || chr(10) || '(2) ' || b || chr(10) || '(3) Gamma a) første b) ' || new || ' c) tredje'
  WHEN 4 THEN a || chr(10) || '(2) ' || b || chr(10) || '(3) Gamma a) andre b) tredje'
  WHEN 5 THEN a || chr(10) || '(2) ' || b || chr(10) || '(3) Gamma a) første b) ' || new || ' c) andre d) tredje'
  WHEN 6 THEN a || chr(10) || '(2) ' || b || chr(10) || '(3) ' || c || chr(10) || '(4) Kort ' || doc_id
  WHEN 7 THEN a || chr(10) || '(2) ' || b || chr(10) || '(3) ' || c
  ELSE a || chr(10) || '(2) ' || new || chr(10) || '(3) Tre' || chr(10) || '(4) ' || b || chr(10) || '(5) ' || c END) AS digest FROM parts
UNION ALL SELECT doc_id, '§2', md5(new) FROM parts
UNION ALL SELECT doc_id, '§5', md5('Tittel' || chr(10) || '(1) Frist er ' || doc_id || ' dager.' || chr(10) || '(2) Gebyr er ' || doc_id || ' 5 kroner.' || chr(10) || '(3) Klage sendes departementet.') FROM parts""")
def edited_provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    bases, raw = _edited(spark, sf_dir)
    return state(bases, [raw], recovery=2).select(F.col("law").cast("long").alias("doc_id"), "para", digest("text").alias("digest"))


@query("""
SELECT doc_id, '§1' AS para, why, date, instruction FROM documents, (VALUES
  ('change', '2001-01-01', '§ 1 sjette ledd bokstav a skal lyde:'), ('renumber', '2003-01-01', '§ 1 blir § 3')) AS v(why, date, instruction) WHERE doc_id % 9 = 7""")
def edit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    bases, raw = _edited(spark, sf_dir)
    return reconstruct(bases, [raw], recovery=2)[1].select(F.col("law").cast("long").alias("doc_id"), "para", "why", "date", "instruction")


@query(f"""
WITH docs AS (SELECT doc_id, {WORDS} AS w, trim('Gammel ' || {WORDS}) AS b FROM documents)
SELECT doc_id, '1999-01-01' AS date, md5(b) AS digest, 0 AS acts FROM docs
UNION ALL SELECT doc_id, '2001-06-01', md5(trim('Ny ' || w)), 1 FROM docs
UNION ALL SELECT doc_id, '2003-06-01', md5('Siste'), 1 FROM docs WHERE doc_id % 2 = 1
UNION ALL SELECT doc_id, '2005-06-01', md5(CASE WHEN doc_id % 2 = 1 THEN 'Siste' ELSE trim('Ny ' || w) END), 1 FROM docs WHERE doc_id % 3 = 0""")
def provision_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A baseline, a new wording, for odd ids a last one (the others repeat theirs), and for each third a repeal and the same text again."""
    docs = _numbered(spark, sf_dir)
    bases = docs.select(no().alias("law"), F.lit("§1").alias("para"), F.trim(join("Gammel ", words())).alias("text"))
    new = F.trim(join("§ 1. Ny ", words()))
    last = F.when(F.col("doc_id") % 2 == 1, F.lit("§ 1. Siste")).otherwise(new)
    said = F.lit("§ 1 skal lyde:")
    third = docs.where("doc_id % 3 = 0")
    raw = oplog.union(
        _raw_ops(docs, no(), 0, "§ 1", "change", said, new, "2001-06-01"), _raw_ops(docs, no(), 1, "§ 1", "change", said, last, "2003-06-01"),
        _raw_ops(third, no(), 2, "§ 1", "repeal", F.lit("§ 1 oppheves"), F.lit(None), "2004-06-01"), _raw_ops(third, no(), 3, "§ 1", "add", said, last, "2005-06-01"),
    )
    enacted = docs.select(no().alias("law"), F.lit("1999-01-01").alias("enacted"))
    made = history.histories(fold.fold(bases, oplog.load(raw, 2)), enacted, bases)
    return made.select(F.col("law").cast("long").alias("doc_id"), F.explode("versions").alias("v")).select("doc_id", "v.date", digest("v.text").alias("digest"), F.size("v.src").alias("acts"))


# ---- acts

DAY = "(doc_id % 28 + 1)"


@query(f"""
SELECT doc_id, 0 AS n, '1997-06-13-44' AS target_law, 'change' AS change_type, '§ 1-1 Skal lyde:' AS instruction, md5('§ 1-1. ' || trim({WORDS} || ' a) en')) AS digest FROM documents
UNION ALL SELECT doc_id, 1, '1997-06-13-44', 'repeal', '§ 2-2 annet ledd oppheves.', NULL FROM documents
UNION ALL SELECT doc_id, 2, '2000-05-' || lpad({DAY}::VARCHAR, 2, '0') || '-' || doc_id, 'add', 'Ny § 9: Skal lyde:', md5('§ 9. Helt ' || {WORDS} || '.') FROM documents""")
def act_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = join(
        '<p>I lov 13. juni 1997 nr. 44 gjøres følgende endringer:</p>\n<article class="defaultP">§ 1-1 Skal lyde:</article><article class="legalP">', words(),
        ' <li data-li-identifier="a)">en</li></article>\n<article class="defaultP">§ 2-2 annet ledd oppheves.</article>\n<p>Lov av ', day().cast("string"), " mai 2000 nr ", no(),
        ' gjøres følgende endringer:</p><article class="defaultP">Ny § 9: Skal lyde:</article><article>Helt ', words(), ".</article>",
    )
    ops = segment.structured_ops(_numbered(spark, sf_dir).select("doc_id", raw.alias("raw")), ["doc_id"], "raw")
    return ops.select("doc_id", "n", "target_law", "change_type", "instruction", digest("new_text").alias("digest"))


@query(f"""
SELECT doc_id, n, '2000-05-' || lpad({DAY}::VARCHAR, 2, '0') || '-' || doc_id AS target_law, md5(CASE n WHEN 0 THEN 'C' ELSE trim('gammel ' || {WORDS}) END) AS term_old, md5(CASE n WHEN 0 THEN 'D' ELSE trim('ny ' || {WORDS}) END) AS term_new
FROM documents, (VALUES (0), (1)) AS v(n)""")
def act_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = F.trim(join("gammel ", words())), F.trim(join("ny ", words()))
    text = join("I lov ", day().cast("string"), ". mai 2000 nr. ", no(), " endres «", old, "» til «", new, "». Uttrykket «C» endres til «D». «§ 5» erstattes med «§ 6». «", old, "» erstattes med «", new, "»")
    made = segment.term_reforms(_numbered(spark, sf_dir).select("doc_id", text.alias("text")), ["doc_id"], "text")
    return made.select("doc_id", "n", "target_law", digest("term_old").alias("term_old"), digest("term_new").alias("term_new"))


@query(f"SELECT doc_id, n, CASE n WHEN 0 THEN '1999-01-02-1' ELSE '2000-05-' || lpad({DAY}::VARCHAR, 2, '0') || '-' || doc_id END AS amending FROM documents, (VALUES (0), (1)) AS v(n)")
def annotated_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = join("<p>", words(), ". Endret ved lover ", day().cast("string"), " mai 2000 nr. ", no(), " (ikr. iflg. res. 4 juni 2000 nr. 9), 2 jan 1999 nr. 1</p>")
    found = segment.amending_laws(_numbered(spark, sf_dir).select("doc_id", text.alias("text")), ["doc_id"], "text")
    return found.select("doc_id", "n", F.col("law").alias("amending"))


@query("""
WITH notes AS (
  SELECT doc_id, doc_id + 1 AS act, '§1' AS provision, ['change', 'repeal', 'add'][doc_id % 3 + 1] AS change_type, '1 juli 2002 iflg. r' AS in_force, 'forskrift/2002-05-9' AS source_ref FROM documents
  UNION ALL SELECT doc_id, doc_id + 2, NULL, 'change', NULL, NULL FROM documents WHERE doc_id % 2 = 0)
SELECT 'lov/2000-01-01-' || act AS act_id, 'Lov ' || d.doc_id AS act_title, n.doc_id AS target, provision, change_type, in_force, source_ref
FROM notes n LEFT JOIN (SELECT doc_id FROM documents) d ON d.doc_id = act""")
def edge_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document the current text of a law, with a note under its first provision and, for even ids, one under the law's own anchor."""
    verb = F.element_at(F.array(F.lit("Endret"), F.lit("Opphevet"), F.lit("Tilføyd")), (F.col("doc_id") % 3 + 1).cast("int"))
    act = lambda k: join('<a href="lov/2000-01-01-', (F.col("doc_id") + k).cast("string"), '">x</a>')
    own = join('<a data-lovdata-URL="NL/lov/2000-01-01-', no())
    self = join('<a href="lov/2000-01-01-', no(), '">selv</a>')
    first = join(own, '/§1"></a>', words(), '<a data-lovdata-URL="NL/lov/1999-09-09-9/§7"></a><article class="changesToParent">', verb, " ved ", self, ", ", act(1), ' (ikr. 1 juli 2002 iflg. <a href="forskrift/2002-05-9">r</a>)</article>')
    second = F.when(F.col("doc_id") % 2 == 0, join(own, '"></a><article class="changesToParent">Endret ved ', act(2), "</article>")).otherwise("")
    sources = _numbered(spark, sf_dir).select(join("2000-01-01-", no()).alias("law"), join("<title>Lov ", no(), "</title>", first, second).alias("raw"))
    return register.edges(sources).select("act_id", "act_title", F.substring_index("target_law", "-", -1).cast("long").alias("target"), "provision", "change_type", "in_force", "source_ref")


@query("SELECT doc_id AS act, '2000-05-03-' || doc_id % 50 AS law, doc_id % 4 AS n FROM documents WHERE doc_id % 4 >= 2 AND doc_id % 50 % 3 = 0")
def citing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    cite = join(" og lov 3. mai 2000 nr. ", (F.col("doc_id") % 50).cast("string"))
    docs = _numbered(spark, sf_dir)
    targets = docs.select((F.col("doc_id") % 50).alias("m")).where("m % 3 = 0").select(join("2000-05-03-", F.col("m").cast("string")).alias("law"))
    texts = docs.select(F.col("doc_id").alias("act"), join(words(), F.repeat(cite, (F.col("doc_id") % 4).cast("int"))).alias("text"))
    return register.citing(texts, targets, "act", "text", 2)


@query(f"""
SELECT doc_id, '§1' AS para, 'change' AS change_type, '§ 1 skal lyde:' AS instruction, md5(trim('Ny tekst ' || {WORDS}) || ' her.') AS digest, NULL AS flag FROM documents
UNION ALL SELECT doc_id, '§2', 'repeal', '§ 2 oppheves', NULL, NULL FROM documents
UNION ALL SELECT doc_id, '§3', 'add', '§ 3 første ledd skal lyde:', NULL, 'anchor-not-found' FROM documents""")
def quoted_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _numbered(spark, sf_dir)
    sections = docs.select("doc_id", join("§ 1 skal  lyde:\nNy\ttekst ", words(), "  her. § 2 oppheves.").alias("section"))
    said = [(0, "1", "", "replace", "Ny tekst", "her."), (1, "2", "", "repeal", "", ""), (2, "3", "første ledd", "insert", "7 finnes", "ikke")]
    names = ("n", "para", "unit", "kind", "head", "tail")
    quoted = docs.select("doc_id", F.explode(F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(names, q, strict=True))) for q in said))).alias("q")).select("doc_id", "q.*")
    found = segment.verified_ops(sections, quoted, ["doc_id"])
    return found.select("doc_id", "para", "change_type", "instruction", digest("new_text").alias("digest"), "flag")


@query(f"""
SELECT doc_id, '2000-05-' || lpad({DAY}::VARCHAR, 2, '0') || '-' || doc_id AS target_law, md5('I lov  ' || {DAY} || '. mai 2000 nr. ' || doc_id || ' endres. ' || {WORDS} || ' ') AS digest, NULL AS reason FROM documents
UNION ALL SELECT doc_id, '2000-05-03-8', md5('I lov 2000-05-03-8 endres.'), NULL FROM documents
UNION ALL SELECT doc_id, NULL, NULL, reason FROM documents, (VALUES ('cite-not-in-anchor'), ('anchor-not-found')) AS v(reason)""")
def quoted_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _numbered(spark, sf_dir)
    cite = join(day().cast("string"), ". mai 2000 nr. ", no())
    texts = docs.select("doc_id", join("Innledning. I lov  ", cite, " endres. ", words(), " I lov 2000-05-03-8 endres.").alias("text"))
    said = ((join("I lov ", cite, " endres."), cite), (F.lit("I lov 2000-05-03-8 endres."), F.lit("2000-05-03-8")), (F.lit("I lov x"), F.lit("y")), (F.lit("9 mangler helt"), F.lit("9 mangler")))
    mentions = docs.select("doc_id", F.explode(F.array(*(F.struct(F.lit(k).alias("n"), a.alias("anchor"), c.alias("cite")) for k, (a, c) in enumerate(said)))).alias("m")).select("doc_id", "m.*")
    return segment.located_targets(texts, mentions, ["doc_id"]).select("doc_id", "target_law", digest("section").alias("digest"), "reason")


@query(f"""
WITH acts AS (SELECT doc_id, '1999-01-01-' || doc_id AS act, '2000-05-' || lpad({DAY}::VARCHAR, 2, '0') || '-' || doc_id AS law, {WORDS} AS w, doc_id % 3 > 0 AS wanted FROM documents)
SELECT act, law AS target_law, '§1' AS paragraph, 'change' AS change_type, '§ 1 skal lyde:' AS instruction, md5(trim('Ny ' || w) || ' slutt.') AS digest, NULL AS flag, NULL AS reason FROM acts WHERE wanted
UNION ALL SELECT act, law, '§2', 'add', '§ 2 skal lyde:', NULL, 'anchor-not-found', NULL FROM acts WHERE wanted
UNION ALL SELECT act, NULL, NULL, NULL, NULL, NULL, NULL, 'no-amendatory-cue' FROM acts
UNION ALL SELECT act, NULL, NULL, NULL, NULL, NULL, NULL, 'cite-not-in-anchor' FROM acts""")
def recovered_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document an act that words a paragraph of a law by it, applies another, and quotes a third wrongly; two in three of the first are wanted."""
    docs = _numbered(spark, sf_dir).withColumn("act", join("1999-01-01-", no()))
    cite = join(day().cast("string"), ". mai 2000 nr. ", no())
    law = join("2000-05-", F.lpad(day().cast("string"), 2, "0"), "-", no())
    acts = docs.select("act", join("I lov ", cite, " skal § 1 lyde: Ny ", words(), " slutt. I lov 3. juni 1990 nr. 4 finnes mer.").alias("text"))
    said = ((join("I lov ", cite), cite), (F.lit("I lov 3. juni 1990 nr. 4"), F.lit("3. juni 1990 nr. 4")), (F.lit("I lov"), F.lit("9")))
    mentions = docs.select("act", F.explode(F.array(*(F.struct(F.lit(k).alias("n"), a.alias("anchor"), c.alias("cite")) for k, (a, c) in enumerate(said)))).alias("m")).select("act", "m.*")
    quotes = [(0, "1", "", "replace", "Ny", "slutt."), (1, "2", "", "insert", "7 finnes", "ikke")]
    names = ("n", "para", "unit", "kind", "head", "tail")
    quoted = docs.select("act", F.lit(0).alias("part"), F.explode(F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(names, q, strict=True))) for q in quotes))).alias("q")).select("act", "part", "q.*")
    targets = docs.where("doc_id % 3 > 0").select(law.alias("law")).unionByName(docs.select(F.lit("1990-06-03-4").alias("law")))
    found = recover(acts, mentions, quoted, targets)
    return found.select("act", "target_law", "paragraph", "change_type", "instruction", digest("new_text").alias("digest"), "flag", "reason")


@query(f"""
WITH docs AS (SELECT doc_id, doc_id % 3 AS k, {WORDS} AS w FROM documents)
SELECT doc_id, '§1-1' AS para, md5(trim('§ 1-1. ' || w)) AS digest FROM docs WHERE k = 0 UNION ALL SELECT doc_id, '§1-2', md5('§ 1-2. To jf. § 9. x') FROM docs WHERE k = 0
UNION ALL SELECT doc_id, '§5', md5(trim('§ 5. Tre ' || w)) FROM docs WHERE k = 1 UNION ALL SELECT doc_id, '§6', md5('§ 6. Fire se § 7 her.') FROM docs WHERE k = 1
UNION ALL SELECT doc_id, NULL, md5(trim('bare ' || w)) FROM docs WHERE k = 2""")
def payload_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    payload = F.when(k == 0, join("§ 1-1. ", words(), "\n§ 1-2. To jf. § 9. x")).when(k == 1, join("Kapittel 3 Navn § 5. Tre ", words(), " § 6. Fire se § 7 her.")).otherwise(F.trim(join("bare ", words())))
    rows = _numbered(spark, sf_dir).select("doc_id", payload.alias("payload"))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("para"), F.col("payload").alias("new_text")))
    return rows.select("doc_id", F.explode(F.coalesce(oplog.pieces_of(F.col("payload")), whole)).alias("p")).select("doc_id", "p.para", digest("p.new_text").alias("digest"))


@query("""
WITH RECURSIVE marks AS (
  SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY line, para) AS k, line, para FROM (
    SELECT l_orderkey, (l_linenumber + l_suppkey % 3)::BIGINT AS line, '§' || l_partkey % 5 AS para FROM lineitem)),
scan AS (
  SELECT doc, k, line, para, true AS kept, line AS last, [para] AS seen FROM marks WHERE k = 1
  UNION ALL
  SELECT m.doc, m.k, m.line, m.para, m.line > s.last AND NOT list_contains(s.seen, m.para), CASE WHEN m.line > s.last AND NOT list_contains(s.seen, m.para) THEN m.line ELSE s.last END,
         CASE WHEN m.line > s.last AND NOT list_contains(s.seen, m.para) THEN list_append(s.seen, m.para) ELSE s.seen END
  FROM scan s JOIN marks m ON m.doc = s.doc AND m.k = s.k + 1)
SELECT doc, para, line, kept FROM scan""")
def repaired_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    marks = items.select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") + F.col("l_suppkey") % 3).alias("line"), join("§ ", (F.col("l_partkey") % 5).cast("string")).alias("para"))
    return segment.repaired_boundaries(marks, ["doc"])


# ---- sources


@query(r"""
WITH volumes AS (
  SELECT doc_id AS id, ['Norsk Lovtidend Avd. I ' || (1870 + doc_id % 140), 'Norsk Lovtidend Avd. II', 'Norsk Lovtidende 1ste Afdeling', 'Norsk Lovtidend Avd. I register', 'Annet blad Avd. I 1990'][doc_id % 5 + 1] AS title,
         CASE WHEN doc_id % 3 > 0 THEN 1870 + doc_id % 140 END AS issued, n_chars % 3 AS pages, doc_id % 7 > 0 AS digital FROM documents)
SELECT id, year::INTEGER AS year, pages::INTEGER AS pages FROM (SELECT *, coalesce(issued, CASE WHEN id % 5 = 0 THEN 1870 + id % 140 END) AS year FROM volumes)
WHERE digital AND pages > 0 AND id % 5 IN (0, 2) AND year BETWEEN 1877 AND 2000""")
def catalogue_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = (F.col("doc_id") % 140 + 1870).cast("string")
    titles = F.array(join("Norsk Lovtidend Avd. I ", year), F.lit("Norsk Lovtidend Avd. II"), F.lit("Norsk Lovtidende 1ste Afdeling"), F.lit("Norsk Lovtidend Avd. I register"), F.lit("Annet blad Avd. I 1990"))
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.element_at(titles, (F.col("doc_id") % 5 + 1).cast("int")).alias("title"), F.when(F.col("doc_id") % 3 > 0, year).alias("issued"),
        (F.col("n_chars") % 3).cast("int").alias("pageCount"), (F.col("doc_id") % 7 > 0).alias("isDigital"),
    )
    return readers.worklist(rows).select("id", "year", "pages")


@query(r"""
SELECT doc_id, min(page)::INTEGER AS page, md5(arg_min(line, page)) AS digest FROM (
  SELECT doc_id, unnest(range(len(parts))) AS page, unnest(parts) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
WHERE contains(line, 'er ') AND regexp_matches(line, '[A-Z][a-z]+[.]') GROUP BY doc_id""")
def phrase_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    return segment.find_page(pages, ["doc_id"], "er ", "[A-Z][a-z]+[.]").select("doc_id", "page", digest("text").alias("digest"))


@query(f"""
SELECT doc_id, md5('Tittel' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || trim('venstre ' || {WORDS}) || CASE WHEN {WORDS} = '' THEN '' ELSE chr(10) || {WORDS} END
                                    ELSE CASE WHEN {WORDS} = '' THEN '' ELSE chr(10) || {WORDS} END || chr(10) || trim('venstre ' || {WORDS}) END) AS digest FROM documents""")
def page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document a page in two columns as XML; of odd ids the page has no width, so its blocks go by height."""
    strings = lambda text: F.array_join(F.transform(F.split(text, " "), lambda w: join('<String CONTENT="', w, '"/>')), "<SP/>")
    block = lambda h, v, text: join(f'<TextBlock HPOS="{h}" VPOS="{v}"><TextLine>', strings(text), "</TextLine></TextBlock>")
    width = F.when(F.col("doc_id") % 2 == 0, ' WIDTH="100"').otherwise("")
    xml = join("<Page", width, ">", block(60, 5, words()), block(5, 10, F.trim(join("venstre ", words()))), block(0, 1, F.lit("Tittel")), "</Page>")
    blocks = segment.alto_blocks(_numbered(spark, sf_dir).select("doc_id", xml.alias("xml")), ["doc_id"], "xml")
    return segment.reflow(blocks, ["doc_id"]).select("doc_id", digest("text").alias("digest"))


_MONTHS = ("januar", "februar", "mars", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "desember")


@query(f"""
SELECT doc_id, printf('%d-%02d-%02d-%d', 1900 + doc_id % 100, doc_id % 12 + 1, {DAY}, doc_id) AS law, ['amend', 'repeal', 'original'][doc_id % 3 + 1] AS class,
       'Lov ' || {DAY} || '. ' || {list(_MONTHS)}[doc_id % 12 + 1] || ' ' || (1900 + doc_id % 100) || ' nr. ' || doc_id AS label, printf('%d-%02d-%02d-%d', 1900 + doc_id % 100, doc_id % 12 + 1, {DAY}, doc_id) AS bare,
       printf('nl-%d%02d%02d-%03d.xml', 1900 + doc_id % 100, doc_id % 12 + 1, {DAY}, doc_id) AS file FROM documents""")
def cited_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document an act whose title cites a law by date; ids, labels and file names of that law."""
    month = F.element_at(F.array(*map(F.lit, _MONTHS)), (F.col("doc_id") % 12 + 1).cast("int"))
    lead = F.element_at(F.array(F.lit("om endringer i lov "), F.lit("om opphevelse av lov av "), F.lit("ny lov ")), (F.col("doc_id") % 3 + 1).cast("int"))
    title = join(lead, day().cast("string"), ". ", month, " ", (F.col("doc_id") % 100 + 1900).cast("string"), " nr. ", no(), " ", words())
    rows = _numbered(spark, sf_dir).select("doc_id", "words", title.alias("title")).withColumn("law", t.law_id(F.col("title")))
    return rows.select("doc_id", t.law_id_of_name(t.name_of_law_id(F.col("law"))).alias("law"), t.act_class(F.col("title")).alias("class"), t.act_label(join("lov/", F.col("law"))).alias("label"), t.bare_law_id(join(words(), " ", F.col("law"), " ", words())).alias("bare"), t.name_of_law_id(F.col("law")).alias("file"))


@query(f"""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN printf('2001-02-%02d', {DAY}) END AS in_force, (1900 + doc_id % 100)::INTEGER AS year, md5({WORDS}) AS folded, length(replace({WORDS}, ' ', '')) < 8 AS failed,
       doc_id % 2 = 0 AS notes, md5({WORDS} || 'x') AS joined, (doc_id % 40)::VARCHAR AS chapter, ['OPPH', 'NY', 'ENDR'][doc_id % 3 + 1] AS code, doc_id % 4 = 1 AS stub, doc_id % 5 = 1 AS annex FROM documents""")
def document_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = lambda n: F.col("doc_id") % n
    held = join('<dl><dt>i kraft</dt><DD class="dateInForce"> ', F.when(k(2) == 0, F.format_string("2001-02-%02d, 2002-01-01", day())).otherwise("Kongen bestemmer"), " </dd>", words())
    cover = F.when(k(2) == 0, join("Nr. 3 - ", (k(100) + 1900).cast("string"), " 1888")).otherwise(join(words(), " ", (k(100) + 1900).cast("string"), " 2001"))
    notes = join("<table><tr><td>", F.when(k(2) == 0, " 1 ").otherwise("x"), "</td><td>", words(), "</td></tr></table>")
    return _numbered(spark, sf_dir).select(
        "doc_id", t.in_force_date(held).alias("in_force"), t.issue_year(cover).alias("year"), digest_of(t.ocr_folded(F.translate(words(), "o", "ö"))).alias("folded"), t.is_failed_extraction(words()).alias("failed"),
        t.is_note_table(notes).alias("notes"), digest_of(t.joined_text(join("<p>", words(), "</p><p>x</p>"))).alias("joined"), t.chapter_of(join("§ ", k(40).cast("string"), "-3")).alias("chapter"),
        t.change_of_action(F.when(k(3) == 0, "repeal").otherwise("set"), F.when(k(3) == 1, "Kapittel 3").otherwise("annet ledd")).alias("code"),
        t.is_repealed_stub(F.when(k(4) == 1, " . (OPPHEVET) ved lov").otherwise(words())).alias("stub"), t.is_annex(F.when(k(5) == 1, "§a3").otherwise("§ 3")).alias("annex"),
    )


def digest_of(text: Column) -> Column:
    return F.md5(text.cast("binary"))


#: Instructions and what they are: kind, change, renumbering, amendatory, provision.
_SAID = [
    ("§ 4 annet ledd oppheves", "repeal", "repeal", False, True), ("ny § 5 a skal lyde:", "add", "add", False, True), ("§ 6 tredje punktum skal lyde:", "subprovision", "change", False, True), ("§ 7-2 skal lyde:", "replace", "change", False, True),
    ("nåværende § 8 blir ny § 9", "add", "change", True, True), ("§ 10 gjelder for", "other", "change", False, False), ("§ 11 flyttes til", "other", "change", True, False),
]
_PARAS = ("§4", "§5", "§6", "§7-2", "§8", "§10", "§11")


@query(f"""
SELECT doc_id, {[s[1] for s in _SAID]}[k] AS kind, {[s[2] for s in _SAID]}[k] AS change, {[s[3] for s in _SAID]}[k] AS renumbers, {[s[4] for s in _SAID]}[k] AS amends, {list(_PARAS)}[k] AS para
FROM (SELECT doc_id, doc_id % {len(_SAID)} + 1 AS k FROM documents)""")
def instruction_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*(F.lit(s[0]) for s in _SAID)), (F.col("doc_id") % len(_SAID) + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", said.alias("said"))
    return rows.select("doc_id", t.op_kind(F.col("said")).alias("kind"), t.change_of_instruction(F.col("said")).alias("change"), t.is_renumbering(F.col("said")).alias("renumbers"), t.is_amendatory(F.col("said")).alias("amends"), t.bare_id(F.col("said")).alias("para"))


# ---- scores: a conversation is a law, its turns are provisions; a fifth each is the same, a word longer, absent, empty of words, or repealed

_TURNS = """
WITH turns AS (
  SELECT conv_id, turn, conv_id::VARCHAR AS law, CASE WHEN turn = 3 THEN '§a3' ELSE '§' || turn END AS para, (conv_id + turn) % 5 AS k, text, length(trim(regexp_replace(lower(text), '[^a-z0-9æøå]+', ' ', 'g'))) AS n FROM conversations),
scored AS (
  SELECT *, turn = 3 AS annex, k = 4 AND turn <> 3 AS stub, k IN (2, 4) OR (k = 0 AND text = '') AS bare, CASE WHEN conv_id % 2 = 0 THEN 0.9::DOUBLE ELSE 0.98 END AS bar,
    CASE WHEN k = 4 THEN 0.0 WHEN k = 0 THEN 1.0 WHEN k = 1 THEN CASE WHEN n = 0 THEN 0.0 ELSE 2.0::DOUBLE * n / (2 * n + 3) END WHEN n = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS sim FROM turns)
"""


def _turns(spark: SparkSession, sf_dir: str, longer: Column | str = " ny") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(reconstruction, current text, provenance of laws, the turns with what became of them); a fifth is ``longer`` by so much."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", ((F.col("conv_id") + F.col("turn")) % 5).alias("k"), F.col("conv_id").cast("string").alias("law"), F.when(F.col("turn") == 3, "§a3").otherwise(join("§", F.col("turn").cast("string"))).alias("para"))
    wording = F.when(F.col("k") == 0, F.col("text")).when(F.col("k") == 1, join(F.col("text"), longer)).otherwise("§ §")
    recon = rows.where("k NOT IN (2, 4)").select("law", "para", wording.alias("text"))
    current = rows.select("law", "para", F.when(F.col("k") == 4, "(Opphevet)").otherwise(F.col("text")).alias("text"))
    return recon, current, rows.select("law", (F.col("conv_id") % 2 == 0).alias("is_ocr")).distinct(), rows


@query(_TURNS + """
SELECT matched, strict, total, annex, repealed, round(matched / greatest(total, 1), 6) AS matched_rate, round(strict / greatest(total, 1), 6) AS strict_rate FROM (
  SELECT count(*) FILTER (sim >= bar AND NOT annex AND NOT stub) AS matched, count(*) FILTER (sim >= 0.98 AND NOT annex AND NOT stub) AS strict, count(*) FILTER (NOT annex AND NOT stub) AS total,
         count(*) FILTER (annex) AS annex, count(*) FILTER (stub) AS repealed FROM scored)""")
def turn_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    recon, current, ocr, _ = _turns(spark, sf_dir)
    return score.convergence(recon, current, ocr).withColumn("matched_rate", F.round("matched_rate", 6)).withColumn("strict_rate", F.round("strict_rate", 6))


@query(_TURNS + """
SELECT count(*) AS n_laws, round(avg(rate), 4) AS rate_mean, count(*) FILTER (rate < 0.98)::INTEGER AS below FROM (
  SELECT law, avg((sim >= bar)::INTEGER::DOUBLE) AS rate FROM scored WHERE NOT annex AND NOT stub GROUP BY law)""")
def turn_law_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    recon, current, ocr, _ = _turns(spark, sf_dir)
    scored = score.compared(recon, score.in_scope(current, stubs=True), ["law", "para"]).join(ocr, "law")
    return score.corpus_mean(score.law_scores(scored, ["law"], score.tau(F.col("is_ocr")))).select("n_laws", "rate_mean", F.size("laws_below_bar").alias("below"))


@query(_TURNS + """
SELECT law, CASE WHEN turn < 2 THEN '2001-01-01' ELSE '2002-01-01' END AS date, count(*) AS n, count(*) FILTER (sim >= bar) AS matched, round(avg((sim >= bar)::INTEGER::DOUBLE), 6) AS rate, round(avg(sim), 6) AS mean, count(*) FILTER (sim < bar)::INTEGER AS flags
FROM scored WHERE NOT annex GROUP BY ALL""")
def turn_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    recon, current, ocr, rows = _turns(spark, sf_dir)
    when = rows.select("law", "para", F.when(F.col("turn") < 2, "2001-01-01").otherwise("2002-01-01").alias("date"))
    at = lambda side: side.join(when, ["law", "para"])
    return score.point_in_time(at(recon), at(current), ocr).select("law", "date", "n", "matched", F.round("rate", 6).alias("rate"), F.round("mean", 6).alias("mean"), F.size("flags").alias("flags"))


@query(_TURNS + "SELECT count(*) AS n, count(*) FILTER (sim >= 0.98) AS passed, round(avg(sim), 6) AS mean, round(min(sim), 6) AS least FROM scored WHERE k < 3")
def turn_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    recon, current, _, rows = _turns(spark, sf_dir)
    found = score.fidelity(recon, current, rows.where("k >= 3"))
    return found.select("n", "passed", F.round("mean", 6).alias("mean"), F.round("least", 6).alias("least"))


@query(_TURNS + """
, facts AS (
  SELECT * REPLACE (CASE WHEN k = 1 AND conv_id % 3 = 1 AND n > 0 THEN 2.0::DOUBLE * n / (2 * n + 3 * greatest(1, n // 10)) ELSE sim END AS sim),
         turn % 2 = 0 AS has, conv_id % 4 = 0 AS renumbered, conv_id % 3 = 0 AS part, conv_id % 7 < 2 AS flag FROM scored)
SELECT law, para, CASE WHEN bare THEN CASE WHEN NOT has THEN 'base-missing' WHEN flag AND renumbered THEN 'engine-gap:struct' WHEN flag AND part THEN 'engine-gap:ledd' ELSE 'base-missing' END
  WHEN flag AND has AND renumbered THEN 'engine-gap:struct' WHEN flag THEN 'engine-gap:ledd' WHEN NOT has THEN CASE WHEN sim < 0.85 THEN 'uncaptured-amdt' ELSE 'base-ocr-noise' END
  WHEN sim < 0.85 THEN 'applied-wrong' ELSE 'applied-ocr-noise' END AS bucket FROM facts WHERE sim < bar""")
def turn_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each law's misses at its own bar; of a third of the laws the longer wordings are so by about a third, which OCR does not explain."""
    grown = F.greatest(F.lit(1), F.floor(F.length(t.canonical(F.col("text"))) / 10)).cast("int")
    recon, current, ocr, rows = _turns(spark, sf_dir, F.when(F.col("conv_id") % 3 == 1, F.repeat(F.lit(" ny"), grown)).otherwise(" ny"))
    said = F.when(F.col("conv_id") % 4 == 0, "§ 1 blir § 2").otherwise("§ 1 skal lyde")
    ops = rows.where("turn % 2 = 0").select("law", "para", F.when(F.col("conv_id") % 3 == 0, "subprovision").otherwise("replace").alias("kind"), said.alias("instruction"))
    flags = rows.where("conv_id % 7 < 2").select("law", "para")
    scored = score.compared(recon, current, ["law", "para"]).join(ocr, "law")
    return score.misses(scored, current, ops, flags, score.tau(F.col("is_ocr"))).select("law", "para", "bucket")


@query(_TURNS + "SELECT law, para FROM scored WHERE NOT bare AND sim >= 0.999 AND (conv_id % 2 = 1 OR turn % 2 = 0)")
def turn_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laws of even number are snapshots, after which only every other turn was amended."""
    recon, current, _, rows = _turns(spark, sf_dir)
    ops = rows.select("law", "para", F.when(F.col("turn") % 2 == 0, "2002").otherwise("2000").alias("date"))
    snapshots = rows.where("conv_id % 2 = 0").select("law", F.lit("2001").alias("base_as_of")).distinct()
    return score.contaminated(recon, current, ops, snapshots).select("law", "para")


@query("""
SELECT source AS law, count(*) AS n_provisions, count(*) FILTER (doc_id % 3 > 1) AS n_amended, count(*) FILTER (n_chars % 101 >= 98) AS n_hifi FROM documents GROUP BY source""")
def provision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("law"), F.array_repeat(F.lit(0), (F.col("doc_id") % 3).cast("int")).alias("versions"), (F.col("n_chars") % 101 / 100).alias("fidelity"))
    return writers.history_index(rows)


# ---- the older log, typed by kind

_OLD_LOG = """
WITH raw AS (
  SELECT user_id::VARCHAR AS law, '2000-01-01-' || event_id % 5 AS act, '§' || event_id % 3 AS para, strftime(ts, '%Y-%m-%d') AS date, event_id % 2 AS stream_rank, event_id AS line_no,
         CASE event_type WHEN 'purchase' THEN 'replace' WHEN 'signup' THEN 'add' WHEN 'error' THEN 'repeal' ELSE 'other' END AS kind FROM events),
log AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY law, act, para, date, kind ORDER BY stream_rank, line_no) = 1),
state AS (SELECT law, para, kind, line_no FROM log WHERE kind <> 'other' QUALIFY row_number() OVER (PARTITION BY law, para ORDER BY date DESC, act DESC, stream_rank DESC, line_no DESC) = 1)
"""


def _old_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("event_id") % 3).cast("string")
    kind = F.col("event_type")
    said = F.when(kind == "purchase", join("§ ", k, " skal lyde:")).when(kind == "signup", join("ny § ", k, " skal lyde:")).when(kind == "error", join("§ ", k, " oppheves")).otherwise(join("§ ", k, " om noe"))
    raw = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("target_law"), join("2000-01-01-", (F.col("event_id") % 5).cast("string")).alias("act_refid"), said.alias("instruction"), join("verdi ", F.col("event_id").cast("string")).alias("new_text"),
        F.lit("").alias("date_in_force_resolved"), F.date_format("ts", "yyyy-MM-dd").alias("date_in_force"), (F.col("event_id") % 2).cast("int").alias("stream_rank"), F.col("event_id").alias("line_no"),
    )
    return oplog.load_by_kind(raw)


def _nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "law string, para string, text string")


@query(_OLD_LOG + "SELECT law, para, 'verdi ' || line_no AS text FROM state WHERE kind <> 'repeal'")
def older_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.state_at(_nothing(spark), _old_log(spark, sf_dir), by_kind=True)


@query(_OLD_LOG + """
, last AS (SELECT law, para, max(line_no) AS line_no FROM raw WHERE kind IN ('replace', 'add') GROUP BY law, para),
ends AS (SELECT law, para, kind FROM log QUALIFY row_number() OVER (PARTITION BY law, para ORDER BY date DESC, act DESC, stream_rank DESC, line_no DESC) = 1),
reach AS (SELECT law, para FROM ends WHERE kind IN ('replace', 'add'))
SELECT l.law, count(*) AS n_ops, coalesce(any_value(r.reach), 0) AS reach, coalesce(any_value(r.scored), 0) AS scored, coalesce(any_value(r.matched), 0) AS matched, count(*) FILTER (l.kind = 'other') AS flagged
FROM log l LEFT JOIN (
  SELECT reach.law, count(*) AS reach, count(last.law) AS scored, count(*) FILTER (last.line_no = state.line_no) AS matched FROM reach JOIN state USING (law, para) LEFT JOIN last ON last.law = reach.law AND last.para = reach.para GROUP BY reach.law) r ON r.law = l.law
WHERE l.law IS NOT NULL GROUP BY l.law""")
def older_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older log from nothing against what its last wordings say."""
    ops = _old_log(spark, sf_dir).where("law IS NOT NULL")
    kind = F.col("event_type").isin("purchase", "signup")
    current = table(spark, sf_dir, "events").where(kind).groupBy(F.col("user_id").cast("string").alias("law"), join("§", (F.col("event_id") % 3).cast("string")).alias("para")).agg(join("verdi ", F.max("event_id").cast("string")).alias("text"))
    return score.replayed(ops, fold.fold(_nothing(spark), ops, by_kind=True), current)
