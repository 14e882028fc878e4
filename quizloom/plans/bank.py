"""The question bank: grouping, ranking, keyed joins, set operations, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quizloom.operators import keyed, ranking
from quizloom.operators.graph import connected_components
from quizloom.plans.registry import query
from quizloom.session import read_table, scoped, sized
from quizloom.sources import standins as S

P = "WITH " + S.SQL


@query(P + "SELECT module, kind, count(*) AS n FROM question GROUP BY ALL")
def group_counts(spark, sf_dir):
    return S.questions(spark, sf_dir).groupBy("module", "kind").agg(F.count("*").alias("n"))


@query(P + "SELECT part, count(DISTINCT set_id) AS sets, count(DISTINCT q) AS versions FROM opt JOIN question USING (q) GROUP BY part HAVING count(DISTINCT set_id) >= 2")
@sized("lineitem")
@scoped
def clusters_spanning_sets(spark, sf_dir):
    rows = S.options(spark, sf_dir).join(S.questions(spark, sf_dir).select("q", "set_id"), "q")
    return rows.groupBy("part").agg(F.countDistinct("set_id").alias("sets"), F.countDistinct("q").alias("versions")).where("sets >= 2")


@query(P + "SELECT part, string_agg(q, ',' ORDER BY q) AS members FROM (SELECT DISTINCT part, q FROM opt) GROUP BY part")
def ordered_members(spark, sf_dir):
    rows = S.options(spark, sf_dir).select("part", "q").distinct()
    return rows.groupBy("part").agg(F.array_join(F.array_sort(F.collect_list("q")), ",").alias("members"))


RANK = "CASE kind WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END"


def key_rank(kind):
    return F.when(kind == "1-URGENT", 0).when(kind == "2-HIGH", 1).when(kind == "3-MEDIUM", 2).otherwise(3)


@query(P + f"SELECT part, arg_min(q, ({RANK}, q)) AS representative, count(*) AS copies, count(*) FILTER (WHERE status = 'P') AS unkeyed FROM (SELECT DISTINCT part, q FROM opt) JOIN question USING (q) GROUP BY part")
def duplicate_representative(spark, sf_dir):
    rows = S.options(spark, sf_dir).select("part", "q").distinct().join(S.questions(spark, sf_dir), "q")
    return rows.groupBy("part").agg(F.min_by("q", F.struct(key_rank(F.col("kind")), "q")).alias("representative"), F.count("*").alias("copies"), F.count_if(F.col("status") == "P").alias("unkeyed"))


DUP = ", canon AS (SELECT q, module, set_id, CASE WHEN q % 7 = 0 THEN q - q % 21 ELSE q END AS c FROM question)"


@query(P + DUP + " SELECT module, count(DISTINCT c) AS canons, count(*) AS questions FROM canon GROUP BY module")
def canon_sizes(spark, sf_dir):
    rows = S.questions(spark, sf_dir)
    dup_of = F.when(F.col("q") % 7 == 0, F.col("q") - F.col("q") % 21)
    rows = rows.withColumn("c", keyed.canon(F.col("q"), dup_of, F.lit(None).cast("long")))
    return rows.groupBy("module").agg(F.countDistinct("c").alias("canons"), F.count("*").alias("questions"))


@query(P + """, c AS (SELECT part, count(DISTINCT set_id) AS s, count(DISTINCT q) AS v, min(q) AS first FROM opt JOIN question USING (q) GROUP BY part)
SELECT part, s, v, first, row_number() OVER (ORDER BY s DESC, v DESC, first, part) - 1 AS rep FROM c""")
@sized("lineitem")
@scoped
def repeats_ranked(spark, sf_dir):
    rows = S.options(spark, sf_dir).join(S.questions(spark, sf_dir).select("q", "set_id"), "q")
    c = rows.groupBy("part").agg(F.countDistinct("set_id").alias("s"), F.countDistinct("q").alias("v"), F.min("q").alias("first"))
    return ranking.dense_position(c, [F.desc("s"), F.desc("v"), F.col("first"), F.col("part")], "rep")


LEAD = f"(CASE WHEN status = 'P' THEN 1 ELSE 0 END, added, {RANK}, q)"


@query(P + f""", m AS (SELECT part, question.* FROM (SELECT DISTINCT part, q FROM opt) JOIN question USING (q)), l AS (SELECT part, arg_min(q, {LEAD}) AS lead FROM m GROUP BY part)
SELECT part, lead, coalesce(string_agg(CASE WHEN q <> lead THEN q END, ',' ORDER BY kind, q), '') AS rest FROM m JOIN l USING (part) GROUP BY part, lead""")
def constellation_leads(spark, sf_dir):
    rows = S.options(spark, sf_dir).select("part", "q").distinct().join(S.questions(spark, sf_dir), "q")
    order = F.struct(F.when(F.col("status") == "P", 1).otherwise(0), "added", key_rank(F.col("kind")), "q")
    out = rows.groupBy("part").agg(F.min_by("q", order).alias("lead"), F.array_sort(F.collect_list(F.struct("kind", "q"))).alias("_all"))
    rest = F.array_join(F.transform(F.filter("_all", lambda x: x["q"] != F.col("lead")), lambda x: x["q"]), ",")
    return out.select("part", "lead", rest.alias("rest"))


@query(P + ", o AS (SELECT q, part, min(i) AS i FROM opt GROUP BY q, part) SELECT q, string_agg(part, ',' ORDER BY i) AS parts FROM o GROUP BY q")
def first_occurrences(spark, sf_dir):
    rows = S.options(spark, sf_dir).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("i", "part"))).alias("_o"))
    return rows.select("q", F.array_join(F.array_distinct(F.transform("_o", lambda x: x["part"])), ",").alias("parts"))


@query(P + "SELECT module, part, q FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY module, q) AS n FROM (SELECT DISTINCT module, part, q FROM opt JOIN question USING (q))) WHERE n = 1")
def running_distinct(spark, sf_dir):
    rows = S.options(spark, sf_dir).join(S.questions(spark, sf_dir).select("q", "module"), "q").select("module", "part", "q")
    return ranking.first_by(rows, ["part"], ["module", "q"]).select("module", "part", "q")


@query(P + "SELECT q, module, row_number() OVER (PARTITION BY module ORDER BY CASE WHEN q % 5 = 0 THEN q % 100 ELSE 1000000 END, q) AS place FROM question")
def rank_in_topic(spark, sf_dir):
    rep = F.when(F.col("q") % 5 == 0, F.col("q") % 100)
    place = F.row_number().over(Window.partitionBy("module").orderBy(F.coalesce(rep, F.lit(1000000)), "q"))
    return S.questions(spark, sf_dir).select("q", "module", place.cast("long").alias("place"))


@query(P + """, b AS (SELECT q, substr(sha1(module || '|' || kind || '|' || CAST(set_id % 50 AS VARCHAR)), 1, 10) AS base FROM question)
SELECT q, base, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS id FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY q) AS n FROM b)""")
def content_ids(spark, sf_dir):
    rows = S.questions(spark, sf_dir).select("q", keyed.content_id(F.col("module"), F.col("kind"), (F.col("set_id") % 50).cast("string")).alias("base"))
    return keyed.ordinals(rows, "base", ["q"], "id")


@query("SELECT note, stars, row_number() OVER (ORDER BY stars DESC, note) AS place FROM (SELECT doc_id % 97 AS note, count(*) AS stars FROM labels GROUP BY 1)")
def notes_by_votes(spark, sf_dir):
    rows = read_table(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 97).alias("note")).agg(F.count("*").alias("stars"))
    return ranking.dense_position(rows, [F.desc("stars"), F.col("note")], "place").withColumn("place", F.col("place") + 1)


SIZE = 50


@query(P + f""", s AS (SELECT module, count(*) AS n, sum(count(*)) OVER () AS t FROM question GROUP BY module),
f AS (SELECT module, n, greatest(1, (n * {SIZE}) // t) AS base, (n * {SIZE}) % t AS rest FROM s),
k AS (SELECT module, CAST(base + CASE WHEN row_number() OVER (ORDER BY rest DESC, module) <= {SIZE} - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f),
r AS (SELECT q, module, row_number() OVER (PARTITION BY module ORDER BY md5('7|' || q), q) AS place FROM question)
SELECT q, module, place FROM r JOIN k USING (module) WHERE place <= quota""")
def stratified_sample(spark, sf_dir):
    """A shuffled exam of SIZE questions: every topic in proportion (largest remainders), at least one, fixed by a seed."""
    rows = S.questions(spark, sf_dir).select("q", "module")
    every = Window.partitionBy()
    s = rows.groupBy("module").agg(F.count("*").alias("n")).withColumn("t", F.sum("n").over(every))  # one row a topic
    s = s.withColumns({"base": F.greatest(F.lit(1), F.floor(F.col("n") * SIZE / F.col("t"))), "rest": (F.col("n") * SIZE) % F.col("t")})
    more = F.row_number().over(Window.orderBy(F.desc("rest"), "module")) <= SIZE - F.sum("base").over(every)
    quota = s.select("module", (F.col("base") + F.when(more, 1).otherwise(0)).alias("quota"))
    seed = F.md5(F.concat(F.lit("7|"), F.col("q").cast("string")).cast("binary"))
    drawn = ranking.top_k(rows.withColumn("_s", seed), ["module"], ["_s", "q"], SIZE, "place")
    return drawn.join(quota, "module").where("place <= quota").select("q", "module", "place")


@query(P + "SELECT set_id, q, row_number() OVER (PARTITION BY set_id ORDER BY added, q) AS n FROM question")
def set_exam_order(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("set_id").orderBy("added", "q")).cast("long")
    return S.questions(spark, sf_dir).select("set_id", "q", n.alias("n"))


@query(P + "SELECT a.q, a.n, coalesce(c.module, '') AS module, coalesce(c.status, '') AS status FROM (SELECT q + 14950 AS q, count(*) AS n FROM attempt GROUP BY q) a LEFT JOIN question c ON a.q = c.q")
def lookup_with_default(spark, sf_dir):
    counts = S.attempts(spark, sf_dir).groupBy("q").agg(F.count("*").alias("n")).withColumn("q", F.col("q") + 14950)
    found = counts.join(S.questions(spark, sf_dir).select("q", "module", "status"), "q", "left")
    return found.select("q", "n", F.coalesce("module", F.lit("")).alias("module"), F.coalesce("status", F.lit("")).alias("status"))


TWINS = """, t AS (SELECT o.q, q.module AS stem, list(CAST(st || flag AS VARCHAR) ORDER BY i) AS opts FROM opt o JOIN question q USING (q) GROUP BY o.q, q.module)"""


def twin_rows(spark, sf_dir):
    """Every question that has options, however many, with its stem and options in order."""
    rows = S.options(spark, sf_dir).groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.concat("st", "flag").alias("t")))), lambda x: x["t"]).alias("opts"))
    return rows.join(S.questions(spark, sf_dir).select("q", F.col("module").alias("stem")), "q")


@query(P + TWINS + """, new AS (SELECT * FROM t WHERE q % 2 = 0), old AS (SELECT * FROM t WHERE q % 2 = 1)
, same AS (SELECT stem, opts, min(q) AS m FROM old GROUP BY ALL), like_ AS (SELECT stem, list_sort(opts) AS opts, min(q) AS m FROM old GROUP BY ALL)
SELECT q, coalesce(same.m, like_.m) AS match FROM new LEFT JOIN same ON same.stem = new.stem AND same.opts = new.opts LEFT JOIN like_ ON like_.stem = new.stem AND like_.opts = list_sort(new.opts)""")
def keyed_text_merge(spark, sf_dir):
    rows = twin_rows(spark, sf_dir)
    return keyed.twin_match(rows.where("q % 2 = 0"), rows.where("q % 2 = 1"), "q", "stem", "opts", "q").select("q", "match")


@query(P + TWINS + """, d AS (SELECT *, list_sort(opts) AS s FROM t)
SELECT q, array_to_string(list_transform(opts, lambda x: list_position(s, x) - 1), ',') AS perm FROM d""")
def option_permutation(spark, sf_dir):
    rows = twin_rows(spark, sf_dir)
    return rows.select("q", F.array_join(keyed.permutation(F.col("opts"), F.array_sort("opts")), ",").alias("perm"))


@query(P + TWINS + """, k AS (SELECT t.*, status <> 'P' AS keyed FROM t JOIN question USING (q))
, twins AS (SELECT stem, list_sort(opts) AS opts, min(q) AS m FROM k WHERE keyed GROUP BY ALL)
SELECT q, keyed, CASE WHEN NOT keyed THEN m END AS twin FROM k LEFT JOIN twins ON twins.stem = k.stem AND twins.opts = list_sort(k.opts)""")
def twin_fill(spark, sf_dir):
    """Rows without a key take the first keyed twin; the keyed rows are those from before, so fills do not chain."""
    rows = twin_rows(spark, sf_dir).join(S.questions(spark, sf_dir).select("q", (F.col("status") != "P").alias("keyed")), "q")
    open_, known = rows.where("NOT keyed"), rows.where("keyed")
    found = keyed.twin_match(open_, known, "q", "stem", "opts", "q", prefer_order=False).select("q", "keyed", F.col("match").alias("twin"))
    return known.select("q", "keyed", F.lit(None).cast("long").alias("twin")).unionByName(found)


@query(P + """SELECT q.q, CASE WHEN status = 'F' THEN 'own' WHEN t.part IS NOT NULL THEN 'twin' WHEN q.q % 3 = 0 THEN 'suggested' ELSE 'missing' END AS key_from
FROM question q LEFT JOIN (SELECT q, min(part) AS part FROM opt WHERE correct GROUP BY q HAVING count(*) >= 2) t USING (q)""")
def key_enrichment(spark, sf_dir):
    twins = S.options(spark, sf_dir).where("correct").groupBy("q").agg(F.count("*").alias("_n"), F.min("part").alias("_part")).where("_n >= 2")
    rows = S.questions(spark, sf_dir).join(twins, "q", "left")
    source = F.when(F.col("status") == "F", "own").when(F.col("_part").isNotNull(), "twin").when(F.col("q") % 3 == 0, "suggested").otherwise("missing")
    return rows.select("q", source.alias("key_from"))


@query(P + """SELECT q, CASE WHEN q % 10 = 0 AND status = 'O' THEN CASE WHEN q % 20 = 0 THEN 'F' ELSE 'X' END WHEN q % 20 = 10 AND status = 'X' THEN 'F' ELSE status END AS status FROM question""")
def corrections_applied(spark, sf_dir):
    rows = S.questions(spark, sf_dir).select("q", "status")
    fixes = _fixes(rows)
    return keyed.guarded_update(rows, fixes, "q", "status")[0]


def _fixes(rows: DataFrame) -> DataFrame:
    """Questions divisible by 10: O becomes X; then, of those divisible by 20, X becomes F."""
    first = rows.where("q % 10 = 0").select("q", F.lit(1).alias("ord"), F.lit("O").alias("was"), F.lit("X").alias("becomes"))
    second = rows.where("q % 20 = 0").select("q", F.lit(2).alias("ord"), F.lit("X").alias("was"), F.lit("F").alias("becomes"))
    return first.unionByName(second)


@query(P + "SELECT q, CAST(ord AS BIGINT) AS ord FROM question, (VALUES (1), (2)) v(ord) WHERE (ord = 1 AND q % 10 = 0 AND status <> 'O') OR (ord = 2 AND q % 20 = 0 AND status <> 'O')")
def corrections_refused(spark, sf_dir):
    rows = S.questions(spark, sf_dir).select("q", "status")
    return keyed.guarded_update(rows, _fixes(rows), "q", "status")[1]


@query(P + "SELECT q.q, CASE WHEN c.k = q.status THEN 'checked' ELSE kind END AS label FROM question q LEFT JOIN (SELECT o_orderkey AS q, CASE WHEN o_orderkey % 2 = 0 THEN 'F' ELSE 'O' END AS k FROM orders WHERE o_orderkey % 4 < 2) c USING (q)")
def checked_labels(spark, sf_dir):
    rows = S.questions(spark, sf_dir)
    checked = rows.where("q % 4 < 2").select("q", F.when(F.col("q") % 2 == 0, "F").otherwise("O").alias("_k"))
    return rows.join(checked, "q", "left").select("q", F.when(F.col("_k") == F.col("status"), "checked").otherwise(F.col("kind")).alias("label"))


@query(P + """, f AS (SELECT *, q % 10 = 0 AND status = 'O' AS one FROM question), g AS (SELECT *, CASE WHEN one THEN 'X' ELSE status END AS s1, CASE WHEN one THEN 'first' ELSE kind END AS k1 FROM f)
SELECT q, CASE WHEN q % 20 = 0 AND s1 = 'X' THEN 'F' ELSE s1 END AS status, CASE WHEN q % 20 = 0 AND s1 = 'X' AND q % 40 = 0 THEN 'second' ELSE k1 END AS kind FROM g""")
def corrections_with_columns(spark, sf_dir):
    """A correction that applies sets another column, too; the second one does so only for questions divisible by 40."""
    rows = S.questions(spark, sf_dir).select("q", "status", "kind")
    fixes = _fixes(rows).withColumn("kind", F.when(F.col("ord") == 1, "first").when(F.col("q") % 40 == 0, "second"))
    return keyed.guarded_update(rows, fixes, "q", "status", ["kind"])[0]


@query(P + """, n AS (SELECT q, list_sort(list(CASE WHEN part % 3 = 0 THEN 'suggested' ELSE 'user' END || i)) AS notes FROM opt GROUP BY q),
c AS (SELECT *, CASE WHEN q % 3 = 0 THEN 'suggested' ELSE 'official' END AS key, coalesce(q % 4 < 2 AND status = CASE WHEN q % 2 = 0 THEN 'F' ELSE 'O' END, FALSE) AS holds FROM question JOIN n USING (q))
SELECT q, CASE WHEN holds THEN 'checked' ELSE key END AS key, array_to_string(CASE WHEN holds AND key = 'suggested' THEN list_filter(notes, lambda x: NOT starts_with(x, 'suggested')) ELSE notes END, ',') AS notes FROM c""")
def checked_notes(spark, sf_dir):
    """A checked suggestion loses the notes that argued for it."""
    by = F.when(F.col("part") % 3 == 0, "suggested").otherwise("user")
    notes = S.options(spark, sf_dir).groupBy("q").agg(F.array_sort(F.collect_list(F.struct(by.alias("by"), "i"))).alias("notes"))
    rows = S.questions(spark, sf_dir).select("q", "status", F.when(F.col("q") % 3 == 0, "suggested").otherwise("official").alias("key")).join(notes, "q")
    checked = rows.where("q % 4 < 2").select("q", F.when(F.col("q") % 2 == 0, "F").otherwise("O").alias("status"))
    out = keyed.checked_label(rows, checked, "q", "status", "key", "notes", "suggested")
    return out.select("q", "key", F.array_join(F.array_sort(F.transform("notes", lambda x: F.concat(x["by"], x["i"]))), ",").alias("notes"))


@query(P + """, w AS (SELECT module, set_id, CAST(max(added) AS DATE) AS due FROM question GROUP BY ALL)
SELECT module, coalesce(arg_min(set_id, (due, set_id)) FILTER (WHERE due >= DATE '1998-07-01'), arg_max(set_id, (due, set_id))) AS set_id FROM w GROUP BY module""")
def current_quest(spark, sf_dir):
    """A module's set that is due next, else the one that was due last."""
    rows = S.questions(spark, sf_dir).groupBy("module", "set_id").agg(F.to_date(F.max("added")).alias("due"))
    return keyed.current_of(rows, ["module"], "set_id", "due", F.lit("1998-07-01").cast("date"))


@query(P + """, m AS (SELECT DISTINCT q FROM mark WHERE usr = 5 AND points < 1), s AS (SELECT DISTINCT q FROM attempt WHERE usr = 5 AND kind = 'click'),
x AS (SELECT question.*, m.q IS NOT NULL AS wrong, s.q IS NOT NULL AS star FROM question LEFT JOIN m ON m.q = question.q LEFT JOIN s ON s.q = question.q)
SELECT q, 'all' AS mode FROM x UNION ALL SELECT q, 'mistakes' FROM x WHERE wrong UNION ALL SELECT q, 'repeated' FROM x WHERE q % 5 = 0 UNION ALL SELECT q, 'marked' FROM x WHERE star
UNION ALL SELECT q, 'type' FROM x WHERE kind = '2-HIGH' UNION ALL SELECT q, 'set' FROM x WHERE set_id = 7""")
def session_mode_members(spark, sf_dir):
    """The questions of each of a user's six ways to practise."""
    from quizloom.plans.marks import marked

    wrong = marked(spark, sf_dir).where("usr = 5 AND points < 1").select("q", F.lit(True).alias("wrong")).distinct()
    star = S.attempts(spark, sf_dir).where("usr = 5 AND kind = 'click'").select("q", F.lit(True).alias("star")).distinct()
    rows = S.questions(spark, sf_dir).join(wrong, "q", "left").join(star, "q", "left")
    modes = {"all": F.lit(True), "mistakes": F.col("wrong"), "repeated": F.col("q") % 5 == 0, "marked": F.col("star"), "type": F.col("kind") == "2-HIGH", "set": F.col("set_id") == 7}
    return rows.select("q", F.explode(F.array_compact(F.array(*[F.when(holds, mode) for mode, holds in modes.items()]))).alias("mode"))


@query(P + "SELECT c.q, p.module || ' ' || p.kind AS case_text, p.set_id = c.set_id AS same_source FROM question c JOIN question p ON c.q % 9 = 8 AND p.q = c.q - 1")
def follow_ups(spark, sf_dir):
    rows = S.questions(spark, sf_dir)
    parents = rows.select((F.col("q") + 1).alias("q"), F.concat_ws(" ", "module", "kind").alias("case_text"), F.col("set_id").alias("_set"))
    return rows.where("q % 9 = 8").join(parents, "q").select("q", "case_text", (F.col("_set") == F.col("set_id")).alias("same_source"))


@query(P + """, e AS (SELECT q, 'own' AS src, 0 AS r FROM question WHERE q % 50 = 0), links AS (SELECT q, q - q % 7 AS root FROM question WHERE q % 7 < 3),
f AS (SELECT q, q AS entry, 0 AS r FROM e UNION ALL SELECT l2.q, e.q, 1 FROM e JOIN links l1 ON l1.q = e.q JOIN links l2 ON l2.root = l1.root AND l2.q <> e.q)
SELECT q, entry FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY r, entry) AS n FROM f) WHERE n = 1""")
def explanation_fan_out(spark, sf_dir):
    """An entry explains its own question and those linked to it; a question's own entry wins."""
    rows = S.questions(spark, sf_dir).select("q")
    entries = rows.where("q % 50 = 0")
    links = rows.where("q % 7 < 3").withColumn("root", F.col("q") - F.col("q") % 7)
    others = entries.withColumnRenamed("q", "entry").join(links.withColumnRenamed("q", "entry"), "entry").join(links, "root").where("q <> entry")
    every = entries.select("q", F.col("q").alias("entry"), F.lit(0).alias("r")).unionByName(others.select("q", "entry", F.lit(1).alias("r")))
    return ranking.first_by(every, ["q"], ["r", "entry"]).select("q", "entry")


@query(P + "SELECT q, module FROM question WHERE q IN (SELECT q FROM attempt) AND q NOT IN (SELECT q FROM attempt WHERE kind = 'error' AND q < 50)")
def seen_not_skipped(spark, sf_dir):
    tries = S.attempts(spark, sf_dir)
    return S.questions(spark, sf_dir).select("q", "module").join(tries.select("q"), "q", "left_semi").join(tries.where("kind = 'error' AND q < 50").select("q"), "q", "left_anti")


RULES = "(VALUES ('1-URGENT', 'A', 'L1'), ('1-URGENT', NULL, 'L2'), ('2-HIGH', 'B', 'L3'), ('3-MEDIUM', NULL, 'L4'), ('2-HIGH', NULL, 'L5'), ('5-LOW', 'A', 'L6')) r(concept, aspect, lecture)"


@query(P + f""", c AS (SELECT q, kind AS concept, 0 AS ord FROM question UNION ALL SELECT q, CASE WHEN q % 2 = 0 THEN '3-MEDIUM' ELSE '2-HIGH' END, 1 FROM question),
a AS (SELECT q, CASE WHEN q % 3 = 0 THEN 'A' ELSE 'B' END AS aspect FROM question),
m AS (SELECT c.q, lecture, row_number() OVER (PARTITION BY c.q ORDER BY ord, CASE WHEN r.aspect IS NULL THEN 1 ELSE 0 END, lecture) AS n FROM c JOIN a USING (q) JOIN {RULES} ON r.concept = c.concept AND (r.aspect IS NULL OR r.aspect = a.aspect))
SELECT q.q, CASE WHEN q.q % 100 = 0 THEN 'moved' ELSE coalesce(lecture, 'none') END AS lecture FROM question q LEFT JOIN m ON m.q = q.q AND n = 1""")
def lecture_assignment(spark, sf_dir):
    """A move wins; else the first concept with a rule for the question's aspect, or a plain rule, before the next concept."""
    from quizloom.operators.assign import assign_lectures

    rows = S.questions(spark, sf_dir)
    second = F.when(F.col("q") % 2 == 0, "3-MEDIUM").otherwise("2-HIGH")
    concepts = rows.select("q", F.posexplode(F.array(F.col("kind"), second)).alias("ord", "concept"))
    aspects = rows.select("q", F.when(F.col("q") % 3 == 0, "A").otherwise("B").alias("aspect"))
    rules = spark.sql(f"SELECT * FROM {RULES.replace('r(', 'AS r(')}")
    moves = rows.where("q % 100 = 0").select("q", F.lit("moved").alias("lecture"))
    return assign_lectures(rows.select("q"), concepts, aspects, rules, moves)


@query(P + """, w AS (SELECT q, module, CASE WHEN q % 5 = 0 THEN q % 100 END AS rep, q - q % 3 AS c, CAST(added AS DATE) AS d FROM question),
pick AS (SELECT * FROM w WHERE (module IN ('BUILDING', 'MACHINERY') OR q % 40 = 0) AND d < DATE '2000-01-01' AND q % 11 <> 0),
o AS (SELECT c, min((CASE WHEN rep IS NULL THEN 1000000 ELSE rep END, q)) AS first FROM pick GROUP BY c)
SELECT c AS question, row_number() OVER (ORDER BY first) AS place FROM o""")
def quest_build(spark, sf_dir):
    """Concept picks and added questions, before a cut-off and without drops, each canonical question once, in rank order."""
    rows = S.questions(spark, sf_dir).withColumns({"rep": F.when(F.col("q") % 5 == 0, F.col("q") % 100), "c": F.col("q") - F.col("q") % 3})
    pick = rows.where(F.col("module").isin("BUILDING", "MACHINERY") | (F.col("q") % 40 == 0)).where("CAST(added AS DATE) < DATE '2000-01-01' AND q % 11 <> 0")
    first = pick.groupBy("c").agg(F.min(F.struct(F.coalesce("rep", F.lit(1000000)).alias("a"), "q")).alias("_first"))
    return ranking.dense_position(first, [F.col("_first")], "place").select(F.col("c").alias("question"), (F.col("place") + 1).alias("place"))


@query(P + "SELECT q, module FROM question WHERE len(list_intersect([module, kind], ['BUILDING', '1-URGENT'])) > 0 AND q NOT IN (SELECT q FROM question WHERE q % 13 = 0)")
def overlap_and_drops(spark, sf_dir):
    rows = S.questions(spark, sf_dir)
    want = F.arrays_overlap(F.array("module", "kind"), F.array(F.lit("BUILDING"), F.lit("1-URGENT")))
    return rows.where(want).where("q % 13 <> 0").select("q", "module")


@query(P + "SELECT q.q, module FROM question q JOIN answer USING (q) WHERE len(ans) > 0 AND coalesce(strftime(added, '%Y-%m-%d'), '') < '1998-06-01' AND q.q % 7 <> 0")
def before_cutoff_with_key(spark, sf_dir):
    rows = S.questions(spark, sf_dir).join(S.answers(spark, sf_dir).where("size(ans) > 0"), "q")
    return rows.where((F.coalesce(F.date_format("added", "yyyy-MM-dd"), F.lit("")) < "1998-06-01") & (F.col("q") % 7 != 0)).select("q", "module")


@query(P + """, w AS (SELECT set_id, CAST(min(added) AS DATE) AS start, CAST(max(added) AS DATE) AS due FROM question GROUP BY set_id), today AS (SELECT DATE '1999-01-01' AS d)
SELECT set_id, CAST(due AS VARCHAR) AS due, d BETWEEN start AND due AS active FROM w, today WHERE due >= d""")
def active_windows(spark, sf_dir):
    rows = S.questions(spark, sf_dir).groupBy("set_id").agg(F.to_date(F.min("added")).alias("start"), F.to_date(F.max("added")).alias("due"))
    today = F.lit("1999-01-01").cast("date")
    return rows.where(F.col("due") >= today).select("set_id", F.col("due").cast("string").alias("due"), today.between(F.col("start"), F.col("due")).alias("active"))


@query(P + "SELECT event_id, usr FROM attempt WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOURS OR event_id = 17")
def last_day_or_pinned(spark, sf_dir):
    return S.attempts(spark, sf_dir).where("ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOURS OR event_id = 17").select("event_id", "usr")


@query(P + "SELECT usr, max(event_id) AS last FROM attempt WHERE ts > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 30 MINUTES AND ts <= TIMESTAMP '2024-01-20 12:00:00' AND usr <> 3 GROUP BY usr")
def recently_seen(spark, sf_dir):
    now = "TIMESTAMP '2024-01-20 12:00:00'"
    return S.attempts(spark, sf_dir).where(f"ts > {now} - INTERVAL 30 MINUTES AND ts <= {now} AND usr <> 3").groupBy("usr").agg(F.max("event_id").alias("last"))


@query(P + """, m AS (SELECT DISTINCT q FROM mark WHERE usr = 5 AND points < 1) SELECT q.q, kind, m.q IS NOT NULL AS mistake, q.q % 5 = 0 AS repeated
FROM question q LEFT JOIN m USING (q) WHERE (m.q IS NOT NULL OR q.q % 5 = 0) AND kind = '2-HIGH'""")
def session_modes(spark, sf_dir):
    from quizloom.plans.marks import marked

    wrong = marked(spark, sf_dir).where("usr = 5 AND points < 1").select("q", F.lit(True).alias("mistake")).distinct()
    rows = S.questions(spark, sf_dir).where("kind = '2-HIGH'").join(wrong, "q", "left")
    return rows.where("mistake OR q % 5 = 0").select("q", "kind", F.coalesce("mistake", F.lit(False)).alias("mistake"), (F.col("q") % 5 == 0).alias("repeated"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '/[a-z]{2}/[0-9]+(/|$)') THEN regexp_extract(url, '/([a-z]{2}/[0-9]+)(/|$)', 1) END AS ref FROM pages")
def validated_reference(spark, sf_dir):
    ok = F.col("url").rlike("/[a-z]{2}/[0-9]+(/|$)")
    return read_table(spark, sf_dir, "pages").select("page_id", F.when(ok, F.regexp_extract("url", "/([a-z]{2}/[0-9]+)(/|$)", 1)).alias("ref"))


PAIRS = """, s AS (SELECT q, list_sort(list_distinct(list(part % 20))) AS parts FROM opt GROUP BY q), two AS (SELECT a.q AS a, b.q AS b, a.parts AS pa, b.parts AS pb FROM s a JOIN s b ON b.q = a.q + 1)"""


@query(P + PAIRS + """ SELECT a, b, array_to_string(list_sort(list_intersect(pa, pb)), ',') AS both_, array_to_string(list_filter(pa, lambda x: NOT list_contains(pb, x)), ',') AS only_a,
 array_to_string(list_sort(list_concat(list_filter(pa, lambda x: NOT list_contains(pb, x)), list_filter(pb, lambda x: NOT list_contains(pa, x)))), ',') AS either FROM two""")
def set_operations(spark, sf_dir):
    s = S.options(spark, sf_dir).groupBy("q").agg(F.array_sort(F.collect_set(F.col("part") % 20)).alias("parts"))
    two = s.select(F.col("q").alias("a"), F.col("parts").alias("pa")).join(s.select((F.col("q") - 1).alias("a"), F.col("q").alias("b"), F.col("parts").alias("pb")), "a")
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return two.select("a", "b", text(F.array_intersect("pa", "pb")).alias("both_"), text(F.array_except("pa", "pb")).alias("only_a"), text(F.array_union(F.array_except("pa", "pb"), F.array_except("pb", "pa"))).alias("either"))


@query(P + TWINS + " SELECT a.q AS a, b.q AS b FROM t a JOIN t b ON b.q = a.q + 1 WHERE list_sort(a.opts) = list_sort(b.opts)")
def multiset_equality(spark, sf_dir):
    t = twin_rows(spark, sf_dir)
    next_ = t.select((F.col("q") - 1).alias("q"), F.col("q").alias("b"), F.col("opts").alias("other"))
    return t.join(next_, "q").where(F.array_sort("opts") == F.array_sort("other")).select(F.col("q").alias("a"), "b")


@query(P + "SELECT q, count(*) AS lectures FROM (SELECT q, module AS l FROM question UNION ALL SELECT q, 'extra' FROM question WHERE q % 1000 = 0) GROUP BY q HAVING count(*) <> 1")
def exact_cover_violations(spark, sf_dir):
    rows = S.questions(spark, sf_dir).select("q")
    return rows.unionByName(rows.where("q % 1000 = 0")).groupBy("q").agg(F.count("*").alias("lectures")).where("lectures <> 1")


@query(P + "SELECT q, module FROM question WHERE module IN ('BUILDING') UNION SELECT q, module FROM question WHERE kind = '5-LOW'")
def union_of_picks(spark, sf_dir):
    rows = S.questions(spark, sf_dir)
    return rows.where("module = 'BUILDING'").select("q", "module").unionByName(rows.where("kind = '5-LOW'").select("q", "module")).distinct()


def edges(spark, sf_dir):
    """Every option links its question l_orderkey to question l_partkey * 7 % 15000."""
    rows = read_table(spark, sf_dir, "lineitem")
    found = rows.select(F.col("l_orderkey").alias("a"), (F.col("l_partkey") * 7 % 15000).alias("b")).where("a <> b")
    kept = found.where("a % 97 <> 0 AND b % 97 <> 0")  # detached questions lose their links
    joined = spark.sql("SELECT * FROM VALUES (97L, 194L), (97L, 291L) AS t(a, b)")  # joined by hand, as stars
    return kept.unionByName(joined)


@query()
def components_of_links(spark, sf_dir):
    """Recursive SQL would name all pairs of a component's nodes; tests/test_whole.py compares with union-find."""
    return connected_components(edges(spark, sf_dir))


@query()
def repeated_clusters(spark, sf_dir):
    found = connected_components(edges(spark, sf_dir)).withColumnRenamed("node", "q").join(S.questions(spark, sf_dir).select("q", "set_id"), "q")
    return found.groupBy("component").agg(F.countDistinct("set_id").alias("sets"), F.count("*").alias("versions")).where("sets >= 2")


@query(P + TWINS + """, k AS (SELECT t.q, stem || '|' || array_to_string(list_sort(opts), '|') AS key, CASE status WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 3 END AS r FROM t JOIN question USING (q)),
d AS (SELECT key, arg_min(q, (r, q)) AS rep FROM k GROUP BY key HAVING count(*) > 1)
SELECT q, rep FROM k JOIN d USING (key) WHERE q <> rep AND q % 3 = rep % 3""")
def exact_duplicates(spark, sf_dir):
    """dupOf within a cluster: the best keyed, then first, of questions with equal stems and equal options in any order."""
    rows = twin_rows(spark, sf_dir).join(S.questions(spark, sf_dir).select("q", "status"), "q")
    rank = F.when(F.col("status") == "F", 0).when(F.col("status") == "O", 1).otherwise(3)
    rows = rows.select("q", F.concat_ws("|", F.col("stem"), F.concat_ws("|", F.array_sort("opts"))).alias("key"), rank.alias("r"))
    d = rows.groupBy("key").agg(F.min_by("q", F.struct("r", "q")).alias("rep"), F.count("*").alias("_n")).where("_n > 1")
    return rows.join(d, "key").where((F.col("q") != F.col("rep")) & (F.col("q") % 3).eqNullSafe(F.col("rep") % 3)).select("q", "rep")


@query(P + """, m AS (SELECT part AS sid, count(DISTINCT q) AS n FROM opt GROUP BY part)
SELECT sid, n, row_number() OVER (ORDER BY n DESC, sid) AS place FROM m WHERE sid IN (SELECT p_partkey FROM part WHERE p_size > 10)""")
def must_know(spark, sf_dir):
    """The most asked first, with how often, of all whose id is valid."""
    rows = S.options(spark, sf_dir).groupBy(F.col("part").alias("sid")).agg(F.countDistinct("q").alias("n"))
    valid = read_table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("sid"))
    out = ranking.dense_position(rows.join(valid, "sid", "left_semi"), [F.desc("n"), F.col("sid")], "place")
    return out.withColumn("place", F.col("place") + 1)
