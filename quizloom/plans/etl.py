"""Parsing lines into questions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quizloom.operators import keyed, lines as L, segmenter
from quizloom.plans.registry import query
from quizloom.session import read_table, scoped, sized
from quizloom.sources import standins as S


@query("SELECT doc_id, i - 1 AS line, string_split(text, chr(10))[i] AS text FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)")
def split_lines(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    return rows.withColumn("line", F.col("line").cast("long"))


@query("""WITH w AS (SELECT user_id AS usr, event_type, sum(CAST(event_id % 10 AS BIGINT)) AS w FROM events GROUP BY ALL)
SELECT usr, arg_min(event_type, (-w, event_type)) AS event_type, max(w) / sum(w) AS share FROM w GROUP BY usr""")
def majority_fill(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("usr"), "event_type", (F.col("event_id") % 10).alias("w"))
    return keyed.first_mode(rows, ["usr"], "event_type", "w", "share")


@query("""SELECT page_id, CASE WHEN length(t) > 0 THEN length(b) / length(t) >= 0.6 ELSE FALSE END AS mostly_bold FROM (SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS t,
 array_to_string(regexp_extract_all(html, '<b>([^<]*)', 1), '') AS b FROM pages)""")
def mostly_bold(spark, sf_dir):
    rows = read_table(spark, sf_dir, "pages").select("page_id", F.length(F.regexp_replace("html", "<[^>]+>", "")).alias("t"), F.length(F.array_join(F.regexp_extract_all("html", F.lit("<b>([^<]*)"), F.lit(1)), "")).alias("b"))
    return rows.select("page_id", F.when(F.col("t") > 0, F.col("b") / F.col("t") >= 0.6).otherwise(False).alias("mostly_bold"))


#: Texts that lines stand in for, by the order's priority and the line's flag.
LINE_TEXT = """CASE WHEN l_linenumber = 1 AND q % 5 = 0 THEN 'Finals 2019 - 2020' WHEN flag = 'R' THEN 'a. option' WHEN flag = 'A' AND q % 2 = 0 THEN '12. question' WHEN part % 9 = 0 THEN 'ii. first' WHEN part % 13 = 0 THEN '' WHEN part % 17 = 0 THEN 'Note: x' ELSE 'some text' END"""
LINES = "WITH " + S.SQL.rstrip() + f""", ln AS (SELECT q, i, part % 4 = 0 OR flag = 'A' AS bold, {LINE_TEXT.replace('l_linenumber = 1', 'i = 0')} AS text FROM opt),
k AS (SELECT *, CASE WHEN trim(text) = '' THEN 'e' WHEN regexp_matches(text, '(?i)^\\s*notes?\\s*:') THEN 'n' WHEN text LIKE 'Finals%' AND NOT bold THEN 'h' WHEN regexp_matches(text, '^[0-9]{{1,3}}\\.') AND bold THEN 's'
 WHEN regexp_matches(text, '(?i)^\\s*(i|ii|iii|iv|v|vi|vii|viii)\\s*[.)]\\s*\\S') THEN 'r' WHEN regexp_matches(text, '^\\s*[a-hA-H]\\s*[.)]\\s*\\S') THEN 'o' ELSE 't' END AS kind FROM ln)"""


def lines(spark, sf_dir):
    rows = S.options(spark, sf_dir).withColumn("bold", (F.col("part") % 4 == 0) | (F.col("flag") == "A"))
    rows = rows.withColumn("text", F.expr(LINE_TEXT.replace("l_linenumber = 1", "i = 0")))
    return rows.select("q", "i", "bold", "text", L.line_kind(F.col("text"), F.col("bold")).alias("kind"))


@query(LINES + " SELECT q, i, kind FROM k")
def line_kinds(spark, sf_dir):
    return lines(spark, sf_dir).select("q", "i", "kind")


REST = """, s AS (SELECT q, string_agg(kind, '' ORDER BY i) AS s FROM k GROUP BY q), r AS (SELECT k.*, replace(substr(s, CAST(i + 2 AS INTEGER)), 'e', '') AS rest FROM k JOIN s USING (q))"""


@query(LINES + REST + " SELECT q, i, kind = 's' AND regexp_matches(rest, '^[tT]{0,2}[oO]{2}') AS valid FROM r")
def valid_stems(spark, sf_dir):
    return L.with_rest(lines(spark, sf_dir), "q", "i", "kind").select("q", "i", L.valid_stem(F.col("kind"), F.col("rest")).alias("valid"))


@query(LINES + ", kb AS (SELECT q, i, CASE WHEN bold THEN upper(kind) ELSE kind END AS kind FROM k), s AS (SELECT q, string_agg(kind, '' ORDER BY i) AS s FROM kb GROUP BY q) SELECT q, i, regexp_matches(regexp_replace(substr(s, CAST(i + 2 AS INTEGER)), '[eE]', '', 'g'), '^[TS]{0,7}?([sS][tT]{0,2}[oO]{2}|[cCuU])') AS leads FROM kb JOIN s USING (q)")
def leading_to_stems(spark, sf_dir):
    kind = F.when(F.col("bold") & (F.col("kind") != "e"), F.upper("kind")).otherwise(F.col("kind"))
    rows = lines(spark, sf_dir).withColumn("kind", kind)
    return L.with_rest(rows, "q", "i", "kind").select("q", "i", L.leads_to_stem(F.col("rest")).alias("leads"))


@query(LINES + REST + """ SELECT q, row_number() OVER (PARTITION BY q ORDER BY i) AS question, i AS line, length(regexp_extract(rest, '^[tT]{0,2}([oO]+)', 1)) AS options FROM r WHERE kind = 's' AND regexp_matches(rest, '^[tT]{0,2}[oO]{2}')""")
def question_segments(spark, sf_dir):
    return L.segments(lines(spark, sf_dir), "q", "i", "kind")


#: Sheets: a customer's order lines in order, with texts of all kinds; paragraphs have six lines.
SHEET_R = "(part * 7 + i * 5 + q) % 24"
SHEET_TEXT = """CASE r WHEN 0 THEN '4. Skin diseases' WHEN 1 THEN 'Finals 2019 - 2020' WHEN 2 THEN '' WHEN 3 THEN 'Note: see the slides' WHEN 4 THEN 'Case: a patient of forty' WHEN 5 THEN '2. SCABIES:'
 WHEN 6 THEN 'A long vignette of a patient who comes to the clinic with a rash' WHEN 7 THEN '[correct answers in green]' WHEN 8 THEN '12. What is the next step?' WHEN 9 THEN '7) Which drug helps' WHEN 10 THEN '3. A 40 year old man has a rash'
 WHEN 11 THEN '5. Name the parasite' WHEN 12 THEN 'ii. roman' WHEN 13 THEN 'plain words.' ELSE 'b. option' END"""
SHEET = "WITH RECURSIVE " + S.SQL.rstrip() + f""", s0 AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY q, i) AS n, {SHEET_R} AS r FROM opt JOIN orders ON o_orderkey = q),
s1 AS (SELECT doc, n, (n - 1) // 6 AS para, r IN (5, 6, 8, 9, 10, 11) AS bold, {SHEET_TEXT} AS text,
 CASE WHEN r = 0 THEN 'i' WHEN r = 1 THEN 'h' WHEN r = 2 THEN 'e' WHEN r = 3 THEN 'n' WHEN r = 7 THEN 'l' WHEN r IN (5, 8, 9, 10, 11) THEN 's' WHEN r = 12 THEN 'r' WHEN r > 13 THEN 'o' ELSE 't' END AS kind FROM s0),
s2 AS (SELECT *, kind = 'o' AND coalesce(first_value(CASE WHEN kind <> 'e' THEN kind END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') = 'r' AS sub FROM s1),
w AS (SELECT doc, 0::BIGINT AS n, []::BIGINT[] AS cases, []::BIGINT[] AS stems FROM (SELECT DISTINCT doc FROM s2)
 UNION ALL SELECT doc, n, CASE WHEN hit IS NULL THEN cases ELSE list_append(cases, hit) END, CASE WHEN kind = 's' THEN list_append(stems, n) ELSE stems END FROM (
  SELECT w.doc, x.n, cases, stems, kind, CASE WHEN sub THEN list_max(list_filter(stems, lambda b: b >= x.n - 11 AND (b - 1) // 6 = x.para AND NOT list_contains(cases, b))) END AS hit FROM w JOIN s2 x ON x.doc = w.doc AND x.n = w.n + 1)),
fin AS (SELECT doc, arg_max(cases, n) AS cases FROM w GROUP BY doc),
k AS (SELECT doc, n, para, bold, text, CASE WHEN sub THEN 'u' WHEN list_contains(cases, n) THEN 'c' ELSE kind END AS kind FROM s2 JOIN fin USING (doc))"""


def sheets(spark, sf_dir):
    owner = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q"), F.col("o_custkey").alias("doc"))
    rows = S.options(spark, sf_dir).join(owner, "q").withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("q", "i")).cast("long")).withColumn("r", F.expr(SHEET_R))
    rows = rows.select("doc", "n", F.expr("(n - 1) div 6").alias("para"), F.col("r").isin(5, 6, 8, 9, 10, 11).alias("bold"), F.expr(SHEET_TEXT).alias("text"), F.when(F.col("r") == 0, "Title").alias("style"))
    return rows.withColumn("kind", L.line_kind(F.col("text"), F.col("bold"), F.col("style"))).drop("style")


@query(SHEET + " SELECT doc, n, kind FROM k")
@sized("lineitem")
@scoped
def relabelled_lines(spark, sf_dir):
    return segmenter.relabelled(sheets(spark, sf_dir)).select("doc", "n", "kind")


#: The same parts as a walk from line to line that carries all that a line can depend on.
WALK = SHEET + r""", m AS (SELECT doc, n, row_number() OVER (PARTITION BY doc ORDER BY n) AS n2, kind, bold, trim(text) AS text, CASE WHEN bold THEN upper(kind) ELSE kind END AS mk FROM k WHERE kind <> 'e'),
a AS (SELECT *, coalesce(string_agg(mk, '') OVER (PARTITION BY doc ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rest FROM m),
b AS (SELECT *, kind = 's' AND regexp_matches(rest, '^[tT]{0,2}[oO]{2}') AS ok, regexp_matches(rest, '^[TS]{0,7}?([sS][tT]{0,2}[oO]{2}|[cCuU])') AS leads FROM a),
l AS (SELECT doc, n2, n, kind, text, ok, kind IN ('t', 's') AND NOT ok AND leads AND text LIKE 'Case:%' AS pre, kind IN ('t', 's') AND NOT ok AND leads AND bold AND length(text) > 45 AS long,
 kind IN ('t', 's') AND NOT ok AND leads AND length(text) <= 45 AND text NOT LIKE '%?%' AS short FROM b),
g AS (SELECT doc, 0::BIGINT AS n2, '' AS act, '' AS mode, 0 AS topic, 0 AS sets, 0 AS q, 0 AS opts, false AS cur, 0 AS lastq, 0 AS cases, 0 AS cid, false AS fresh, false AS comp, '' AS chap, 0 AS owner, 0 AS used, '' AS text, '' AS kind FROM (SELECT DISTINCT doc FROM l)
 UNION ALL SELECT doc, n2, act,
  CASE WHEN act IN ('topic', 'set', 'chapter') THEN '' WHEN act IN ('stem', 'sub') THEN 'stem' WHEN act = 'option' THEN 'options' WHEN act IN ('case', 'case+') THEN 'case' WHEN act = 'notes' THEN 'notes' ELSE mode END,
  topic + CASE WHEN act = 'topic' THEN 1 ELSE 0 END,
  CASE WHEN act = 'topic' THEN 0 WHEN act = 'set' OR (act = 'stem' AND sets = 0) THEN sets + 1 ELSE sets END,
  q + CASE WHEN act IN ('stem', 'sub') THEN 1 ELSE 0 END,
  CASE WHEN act IN ('stem', 'sub') THEN 0 WHEN act = 'option' THEN opts + 1 ELSE opts END,
  CASE WHEN act IN ('stem', 'sub') THEN true WHEN act IN ('topic', 'set', 'case', 'case+', 'chapter') THEN false ELSE cur END,
  CASE WHEN act = 'topic' THEN 0 WHEN act IN ('set', 'case', 'case+', 'chapter', 'stem', 'sub') AND cur AND opts >= 2 THEN q ELSE lastq END,
  cases + CASE WHEN act = 'case' THEN 1 ELSE 0 END,
  CASE WHEN act IN ('topic', 'set', 'chapter') OR ends THEN 0 WHEN act = 'case' THEN cases + 1 ELSE cid END,
  CASE WHEN act IN ('case', 'case+') THEN true WHEN act IN ('stem', 'sub') THEN false ELSE fresh END,
  CASE WHEN act IN ('case', 'case+') THEN kind = 'c' ELSE comp END,
  CASE WHEN act IN ('topic', 'set') THEN '' WHEN act = 'chapter' THEN CASE WHEN text = '2. SCABIES:' THEN 'Scabies' WHEN text LIKE '__ %' THEN regexp_replace(text, '^[0-9]+[.)] *', '') ELSE regexp_replace(text, '^[0-9]+ *[.)-] *', '') END ELSE chap END,
  CASE WHEN act = 'notes' AND NOT cur THEN lastq WHEN act IN ('stem', 'sub') THEN q + 1 ELSE q END,
  CASE WHEN act = 'sub' AND NOT ends THEN cid WHEN act = 'stem' AND NOT ends AND cid > 0 AND (fresh OR regexp_matches(text, '(?i)\b(next step|the patient|her|his|she|he)\b')) THEN cid ELSE 0 END, text, kind
 FROM (SELECT *, act = 'stem' AND cid > 0 AND NOT fresh AND (comp OR text LIKE '3. A 40 year%') AS ends FROM (
  SELECT g.doc, l.n2, g.mode, g.topic, g.sets, g.q, g.opts, g.cur, g.lastq, g.cases, g.cid, g.fresh, g.comp, g.chap, l.text, l.kind,
   CASE WHEN l.kind = 'i' THEN 'topic' WHEN g.topic = 0 THEN '' WHEN l.kind = 'h' THEN 'set'
    WHEN l.kind = 'c' OR (g.mode <> 'stem' AND (l.pre OR (l.long AND g.mode <> 'notes'))) THEN CASE WHEN g.mode = 'case' THEN 'case+' ELSE 'case' END
    WHEN l.short AND g.mode IN ('', 'options', 'case') THEN 'chapter' WHEN l.kind = 'l' THEN '' WHEN l.ok THEN 'stem' WHEN l.kind = 'u' THEN 'sub'
    WHEN l.kind IN ('r', 'o') AND g.cur AND g.mode IN ('stem', 'options') THEN 'option' WHEN l.kind = 't' AND g.cur AND g.mode = 'stem' THEN 'stem+'
    WHEN l.kind = 'n' THEN CASE WHEN g.cur OR g.lastq > 0 THEN 'notes' ELSE '' END WHEN g.cur AND g.mode IN ('options', 'notes') THEN 'note' ELSE '' END AS act
  FROM g JOIN l ON l.doc = g.doc AND l.n2 = g.n2 + 1))),
e AS (SELECT doc, owner, max(CASE WHEN act IN ('stem', 'sub') THEN topic END) AS topic, max(CASE WHEN act IN ('stem', 'sub') THEN sets END) AS set, max(CASE WHEN act IN ('stem', 'sub') AND used > 0 THEN used END) AS "case",
 max(CASE WHEN act IN ('stem', 'sub') AND chap <> '' THEN chap END) AS chapter, count(*) FILTER (WHERE act = 'option') AS options, count(*) FILTER (WHERE act IN ('notes', 'note')) AS notes,
 string_agg(CASE act WHEN 'stem' THEN regexp_replace(text, '^[0-9]+[.)] *', '') WHEN 'sub' THEN regexp_replace(text, '^[a-h][.)] *', '') WHEN 'stem+' THEN text END, ' ' ORDER BY n2) AS stem
 FROM g WHERE act IN ('stem', 'sub', 'stem+', 'option', 'notes', 'note') GROUP BY doc, owner HAVING count(*) FILTER (WHERE act = 'option') >= 2)
SELECT doc, topic, set, row_number() OVER (PARTITION BY doc ORDER BY owner) AS question, stem, options, notes, "case", chapter FROM e"""


@query(WALK)
@sized("lineitem")
@scoped
def bank_questions(spark, sf_dir):
    """Sheets cut into topics, sets, questions with their notes, cases and chapters."""
    return segmenter.questions(segmenter.relabelled(sheets(spark, sf_dir)))


HEADERS = ["Finals 2019 - 2020", "mock 2018-2019 heart", "Midterm", "Second session 2020 – 2021", "Questions collected from the professor", "MCQ training 1-40"]


@query(f"""WITH h AS (SELECT o_orderkey AS q, ({HEADERS})[o_orderkey % 6 + 1] || ' ' || o_orderstatus AS h FROM orders)
SELECT q, CASE WHEN lower(h) LIKE 'final%' THEN 'Finals' WHEN lower(h) LIKE 'mock%' THEN 'Mock' WHEN lower(h) LIKE 'midterm%' THEN 'Midterms' WHEN lower(h) LIKE 'second session%' THEN 'Second session' ELSE 'Collected' END AS kind,
 CASE WHEN regexp_matches(h, '(20[0-9]{{2}})\\s*[-–]\\s*(20[0-9]{{2}})') THEN regexp_extract(h, '(20[0-9]{{2}})\\s*[-–]\\s*(20[0-9]{{2}})', 1) || '–' || regexp_extract(h, '(20[0-9]{{2}})\\s*[-–]\\s*(20[0-9]{{2}})', 2) END AS years FROM h""")
def headers(spark, sf_dir):
    h = F.concat(F.element_at(F.array(*map(F.lit, HEADERS)), (F.col("o_orderkey") % 6 + 1).cast("int")), F.lit(" "), F.col("o_orderstatus"))
    return read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q"), L.session_type(h).alias("kind"), L.session_years(h).alias("years"))


@query("WITH " + S.SQL + """, m AS (SELECT q, i, flag AS mark FROM opt), b AS (SELECT q, min(CASE mark WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 9 END) AS r FROM m GROUP BY q)
SELECT q, CASE r WHEN 1 THEN 'official' WHEN 2 THEN 'proposed' ELSE 'none' END AS key, coalesce(string_agg(CASE WHEN (r = 1 AND mark = 'R') OR (r = 2 AND mark = 'A') THEN i END, ',' ORDER BY i), '') AS answer FROM m JOIN b USING (q) GROUP BY q, r""")
def derived_keys(spark, sf_dir):
    """The key is the first kind of marking present; the answer is where it stands."""
    rows = S.options(spark, sf_dir).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("i", "flag"))).alias("_o"))
    has = lambda m: F.exists("_o", lambda x: x["flag"] == m)
    mark = F.when(has("R"), "R").when(has("A"), "A")
    places = F.transform(F.filter("_o", lambda x: x["flag"] == F.col("_m")), lambda x: x["i"])
    return rows.withColumn("_m", mark).select("q", F.when(F.col("_m") == "R", "official").when(F.col("_m") == "A", "proposed").otherwise("none").alias("key"), F.coalesce(F.array_join(places, ","), F.lit("")).alias("answer"))


@query("WITH " + S.SQL + ", kept AS (SELECT q FROM opt GROUP BY q HAVING count(*) >= 2) SELECT set_id, q, row_number() OVER (PARTITION BY set_id ORDER BY added, q) AS n FROM question WHERE q IN (SELECT q FROM kept)")
def kept_questions(spark, sf_dir):
    """Questions with two options or more, numbered within their set; sets without any are gone."""
    kept = S.options(spark, sf_dir).groupBy("q").agg(F.count("*").alias("_n")).where("_n >= 2").select("q")
    n = F.row_number().over(Window.partitionBy("set_id").orderBy("added", "q")).cast("long")
    return S.questions(spark, sf_dir).join(kept, "q", "left_semi").select("set_id", "q", n.alias("n"))


@query("WITH " + S.SQL + " SELECT q, count(*) AS options FROM opt GROUP BY q HAVING count(*) < 2")
def rejected_questions(spark, sf_dir):
    return S.options(spark, sf_dir).groupBy("q").agg(F.count("*").alias("options")).where("options < 2")


@query("WITH " + S.SQL + " SELECT DISTINCT set_id FROM question WHERE set_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def referenced_cases(spark, sf_dir):
    used = read_table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("set_id"))
    return S.questions(spark, sf_dir).select("set_id").distinct().join(used, "set_id", "left_semi")


@query("WITH " + S.SQL + " SELECT coalesce(module, '(all)') AS module, coalesce(kind, '(all)') AS kind, count(*) AS n FROM question GROUP BY GROUPING SETS ((module, kind), (module), ())")
def bank_profile(spark, sf_dir):
    rows = S.questions(spark, sf_dir).rollup("module", "kind").agg(F.count("*").alias("n"))
    return rows.select(F.coalesce("module", F.lit("(all)")).alias("module"), F.coalesce("kind", F.lit("(all)")).alias("kind"), "n")


@query("""WITH c AS (SELECT o_orderkey AS q, '"' || o_orderpriority || '" (source: set ' || o_custkey || ')' AS c, repeat('x', CAST(o_orderkey % 120 AS INTEGER)) AS anchor, 'a long enough context of a hundred characters that an anchor may stand in ' || o_orderkey AS ctx FROM orders)
SELECT q, regexp_extract(c, '"([^"]*)"', 1) AS quote, regexp_extract(c, '\\(source: ([^)]*)\\)', 1) AS source, CASE WHEN length(anchor) < 0.8 * length(ctx) AND length(anchor) <= 90 THEN anchor ELSE '' END AS anchor FROM c""")
def comment_parts(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    c = F.concat(F.lit('"'), "o_orderpriority", F.lit('" (source: set '), F.col("o_custkey"), F.lit(")"))
    anchor = F.expr("repeat('x', CAST(o_orderkey % 120 AS INT))")
    ctx = F.concat(F.lit("a long enough context of a hundred characters that an anchor may stand in "), F.col("o_orderkey"))
    short = (F.length(anchor) < F.length(ctx) * 0.8) & (F.length(anchor) <= 90)
    return o.select(F.col("o_orderkey").alias("q"), F.regexp_extract(c, '"([^"]*)"', 1).alias("quote"), F.regexp_extract(c, r"\(source: ([^)]*)\)", 1).alias("source"), F.when(short, anchor).otherwise("").alias("anchor"))


@query("""WITH e AS (SELECT user_id AS usr, event_id, event_type AS kind, substr(event_type, 1, 1) AS t, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS st FROM events),
r AS (SELECT *, CAST(sum(st) OVER (PARTITION BY usr ORDER BY event_id) AS BIGINT) AS run FROM e)
SELECT usr, run, kind, string_agg(t, '' ORDER BY event_id) AS t FROM r GROUP BY usr, run, kind""")
def merged_runs(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("usr"), "event_id", F.col("event_type").alias("kind"), F.substring("event_type", 1, 1).alias("t"))
    return L.runs_merged(rows, "usr", "event_id", "kind", "t")


@query("""WITH m AS (SELECT user_id AS usr, event_id, event_type, CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END AS d FROM events),
o AS (SELECT *, sum(d) OVER (PARTITION BY usr ORDER BY event_id) AS open FROM m)
SELECT usr, string_agg(event_id, ',' ORDER BY event_id) AS anchored FROM o WHERE open > 0 GROUP BY usr""")
def anchored_ranges(spark, sf_dir):
    """What stands between opening and closing marks: rows where more ranges have begun than ended."""
    rows = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("usr"), "event_id", F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", -1).otherwise(0).alias("d"))
    open_ = F.sum("d").over(Window.partitionBy("usr").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("open", open_).where("open > 0")
    return rows.groupBy("usr").agg(F.array_join(F.array_sort(F.collect_list("event_id")), ",").alias("anchored"))


@query("SELECT page_id, i - 1 AS p, regexp_replace(ps[i], '<[^>]+>', '', 'g') AS text FROM (SELECT page_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<p>([^<]*)', 1) AS ps FROM pages))")
def paragraphs(spark, sf_dir):
    rows = read_table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<p>([^<]*)"), F.lit(1))).alias("p", "text"))
    return rows.withColumn("p", F.col("p").cast("long"))


@query("""WITH s AS (SELECT page_id, split_part(split_part(url, '?', 1), '#', 1) AS src FROM pages)
SELECT page_id, min(page_id) OVER (PARTITION BY src) AS stored, 'bank-' || regexp_extract(src, '([^/]*)$', 1) || '.webp' AS name FROM s""")
def stored_once(spark, sf_dir):
    """Media that several pages name by one path are stored once, under a name that follows from the path."""
    rows = read_table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[^?#]*", 0).alias("src"))
    first = rows.groupBy("src").agg(F.min("page_id").alias("stored"), F.concat(F.lit("bank-"), F.regexp_extract("src", "([^/]*)$", 1), F.lit(".webp")).alias("name"))
    return rows.join(first, "src").select("page_id", "stored", "name")


@query("SELECT page_id, regexp_replace('see ' || url || ' now', '(https?://[^ <>\"]+)', '<a href=\"\\1\">\\1</a>', 'g') AS html FROM pages")
def linkified(spark, sf_dir):
    text = F.concat(F.lit("see "), "url", F.lit(" now"))
    return read_table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(text, r'(https?://[^ <>"]+)', '<a href="$1">$1</a>').alias("html"))
