"""Scalar functions over documents, pages and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizloom.functions import text as T
from quizloom.operators.aspects import ASPECTS, aspect_of
from quizloom.plans.registry import query
from quizloom.session import read_table
from quizloom.sources import standins as S


def fold_sql(x: str) -> str:
    return f"translate({x}, '{T.MARKED}', '{T.PLAIN}')"


def norm_sql(x: str) -> str:
    t = f"translate(lower({fold_sql(x)}), '’`', chr(39) || chr(39))"
    t = f"regexp_replace(regexp_replace({t}, '<[^>]+>', ' ', 'g'), '&[a-z#0-9]+;', ' ', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '[^a-z0-9''+\\-/ ]+', ' ', 'g'), ' +', ' ', 'g')"
    return f"(' ' || trim({t}, ' ') || ' ')"


def unescape_sql(x: str) -> str:
    for code, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        x = f"replace({x}, '{code}', '{plain}')"
    return x


def plain_sql(x: str) -> str:
    inner = unescape_sql(f"regexp_replace({x}, '<[^>]+>', ' ', 'g')")
    return f"trim(regexp_replace(regexp_replace({fold_sql(inner)}, '[^\\x00-\\x7F]', '', 'g'), '\\s+', ' ', 'g'), ' ')"


def words_sql(x: str) -> str:
    t = f"regexp_replace(lower({plain_sql(x)}), '\\([a-z0-9]{{2,8}}\\)', ' ', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '([0-9])([a-z])', '\\1 \\2', 'g'), '([a-z])([0-9])', '\\1 \\2', 'g')"
    table = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in T.ABBREVIATIONS.items()) + "}"
    full = f"list_transform(regexp_extract_all({t}, '[a-z0-9]+'), lambda w: coalesce({table}[w], w))"
    parts = f"list_filter(string_split(array_to_string({full}, ' '), ' '), lambda w: w <> '')"
    return f"list_transform({parts}, lambda w: CASE WHEN length(w) > 4 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN substr(w, 1, length(w) - 1) ELSE w END)"


def in_list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in sorted(set(words))) + ")"


@query(f"SELECT doc_id, md5({norm_sql('text')}) AS digest, length({norm_sql('text')}) AS n FROM documents")
def norm_tagger(spark, sf_dir):
    n = T.norm(F.col("text"))
    return read_table(spark, sf_dir, "documents").select("doc_id", F.md5(n.cast("binary")).alias("digest"), F.length(n).cast("long").alias("n"))


LETTERS_SQL = "regexp_replace(lower(" + unescape_sql("regexp_replace(html, '<[^>]+>', '', 'g')") + "), '[^a-z0-9]+', '', 'g')"


@query(f"SELECT page_id, md5({LETTERS_SQL}) AS digest FROM pages")
def norm_merge(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", F.md5(T.letters_only(F.col("html")).cast("binary")).alias("digest"))


@query(f"SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {words_sql('text')} AS w FROM documents)")
def word_tokens(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


@query(f"""SELECT item_id, len(list_distinct(k)) AS n, array_to_string(list_sort(list_distinct(k)), ' ') AS key, md5(array_to_string(k, '')) AS compact
FROM (SELECT item_id, list_filter({words_sql('text')}, lambda w: w NOT IN {in_list(T.STOP)}) AS k FROM benchmark)""")
def option_keys(spark, sf_dir):
    k = T.key(F.col("text"))
    return read_table(spark, sf_dir, "benchmark").select("item_id", F.size(k).cast("long").alias("n"), F.array_join(F.array_sort(k), " ").alias("key"), F.md5(T.compact(F.col("text")).cast("binary")).alias("compact"))


def tokens_sql(x: str) -> str:
    found = f"regexp_extract_all({norm_sql(x)}, '[a-z0-9][a-z0-9''+\\-/]*')"
    bare = f"list_transform({found}, lambda w: regexp_replace(w, '^[''\\-/]+|[''\\-/]+$', '', 'g'))"
    kept = f"list_filter({bare}, lambda w: length(w) >= 2 AND w NOT IN {in_list(T.SEARCH_STOP)})"
    return f"list_transform({kept}, lambda w: CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN substr(w, 1, length(w) - 3) || 'y' WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN substr(w, 1, length(w) - 1) ELSE w END)"


@query(f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)")
def search_tokens(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").select("doc_id", T.search_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query(f"""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part UNION SELECT DISTINCT lower(n_name) || 'ology' FROM nation UNION SELECT DISTINCT substr(lower(n_name), 2) || 'ology' FROM nation)
SELECT a.w AS a, b.w AS b FROM w a JOIN w b ON a.w < b.w WHERE length(a.w) >= 5 AND length(b.w) >= 5 AND abs(length(a.w) - length(b.w)) <= 2 AND a.w NOT IN {in_list(T.FLIP)} AND b.w NOT IN {in_list(T.FLIP)}
 AND levenshtein(a.w, b.w) <= CASE WHEN greatest(length(a.w), length(b.w)) < 9 THEN 1 ELSE 2 END
 AND NOT (substr(a.w, 1, 4) <> substr(b.w, 1, 4) AND (regexp_matches(a.w, '^hyp(er|o)') OR regexp_matches(b.w, '^hyp(er|o)')))""")
def near_words(spark, sf_dir):
    nation = read_table(spark, sf_dir, "nation").select(F.lower("n_name").alias("n"))
    own = read_table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w"))
    w = own.unionByName(nation.select(F.concat("n", F.lit("ology")).alias("w"))).unionByName(nation.select(F.concat(F.substring("n", 2, 100), F.lit("ology")).alias("w"))).distinct()
    # words within two edits share a length class, so lengths block the pairs
    other = w.select(F.col("w").alias("b"), F.explode(F.sequence(F.length("w") - 2, F.length("w") + 2)).alias("n"))
    return w.withColumn("n", F.length("w")).join(other, "n").where((F.col("w") < F.col("b")) & T.near(F.col("w"), F.col("b"))).select(F.col("w").alias("a"), "b")


@query("SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z0-9_])(not|except|false|incorrect|wrong|inexact|untrue|inaccurate|mistakes?|avoid)([^a-z0-9_]|$)') AS denies FROM documents WHERE lang = 'en'")
def polarity(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", T.denies(F.col("text")).alias("denies"))


ASPECT_SQL = "CASE " + " ".join(f"WHEN regexp_matches(t, '{rx}') THEN '{code}'" for code, rx in ASPECTS) + " ELSE 'G' END"
STEMS = ["treatment of the disease", "what causes it", "clinical signs", "the tests", "prevention by vaccines", "definition", "poor prognostic factors", "general"]


@query(f"SELECT q AS q, {ASPECT_SQL} AS aspect FROM (SELECT o_orderkey AS q, {norm_sql('(' + str(STEMS) + ")[o_orderkey % 8 + 1] || ' ' || lower(o_orderpriority)")} AS t FROM orders)")
def aspects(spark, sf_dir):
    stem = F.concat(F.element_at(F.array(*map(F.lit, STEMS)), (F.col("o_orderkey") % 8 + 1).cast("int")), F.lit(" "), F.lower("o_orderpriority"))
    return read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q"), aspect_of(T.norm(stem)).alias("aspect"))


TERMS = ["the", "thing", "de", "ist", "la"]


@query(f"SELECT doc_id, t.term, regexp_matches({norm_sql('text')}, '(^|[^a-z0-9])' || t.term || '(s|es)?([^a-z0-9]|$)') AS found FROM documents, (SELECT unnest({TERMS}) AS term) t")
def whole_word_terms(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").select("doc_id", T.norm(F.col("text")).alias("t"))
    found = F.array(*[F.struct(F.lit(x).alias("term"), F.col("t").rlike(T.term_pattern(x)).alias("found")) for x in TERMS])
    return rows.select("doc_id", F.inline(found))


@query("""WITH s AS (SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_type || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part)
SELECT p_partkey, slug, CASE WHEN row_number() OVER (PARTITION BY slug ORDER BY p_partkey) = 1 THEN slug ELSE slug || '-' || p_partkey END AS unique_slug FROM s""")
def slugs(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = read_table(spark, sf_dir, "part").select("p_partkey", T.slug(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("slug"))
    n = F.row_number().over(Window.partitionBy("slug").orderBy("p_partkey"))
    return rows.withColumn("unique_slug", F.when(n == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", "p_partkey")))


@query("WITH " + S.SQL + " SELECT q, array_to_string(list_transform(ans, lambda i: chr(CAST(i AS INTEGER) + 65)), '') AS letters, array_to_string(ans, ',') AS indexes FROM answer")
def answer_letters(spark, sf_dir):
    rows = S.answers(spark, sf_dir).withColumn("letters", T.indexes_to_letters(F.col("ans")))
    return rows.select("q", "letters", F.array_join(T.letters_to_indexes(F.col("letters")), ",").alias("indexes"))


@query(f"SELECT item_id, replace(replace(replace(replace(text || ' <b> & \"x\"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS html FROM benchmark")
def escaped_markup(spark, sf_dir):
    return read_table(spark, sf_dir, "benchmark").select("item_id", T.escape(F.concat("text", F.lit(' <b> & "x"'))).alias("html"))


@query("SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, CASE WHEN url LIKE '%?%' THEN regexp_extract(url, '[?&]page=([^&#]*)', 1) ELSE '' END AS page, url LIKE '%#%' AS anchored FROM pages")
def url_parts(spark, sf_dir):
    page = F.coalesce(F.try_parse_url(F.col("url"), F.lit("QUERY"), F.lit("page")), F.lit(""))
    return read_table(spark, sf_dir, "pages").select("page_id", F.try_parse_url(F.col("url"), F.lit("HOST")).alias("host"), page.alias("page"), F.col("url").contains("#").alias("anchored"))


@query("SELECT event_id, strftime(ts + INTERVAL 2 HOURS, '%Y-%m-%d') AS day, date_diff('day', CAST(ts + INTERVAL 2 HOURS AS DATE), DATE '2024-02-14') AS days_left FROM events")
def local_day_keys(spark, sf_dir):
    day = F.to_date(F.expr("ts + INTERVAL 2 HOURS"))
    return read_table(spark, sf_dir, "events").select("event_id", F.date_format(day, "yyyy-MM-dd").alias("day"), F.datediff(F.lit("2024-02-14").cast("date"), day).cast("long").alias("days_left"))


@query("SELECT o_orderkey, regexp_replace(regexp_replace(printf('%.2f', floor(o_totalprice / 10000 * 100 + 0.5) / 100), '0+$', ''), '\\.$', '') AS shown FROM orders")
def short_numbers(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").select("o_orderkey", T.short_number(F.col("o_totalprice") / 10000).alias("shown"))


@query("""WITH n AS (SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS k FROM customer)
SELECT a.c_custkey AS a, b.c_custkey AS b FROM n a JOIN n b ON a.c_custkey < b.c_custkey WHERE levenshtein(a.k, b.k) <= 1""")
def names_too_close(spark, sf_dir):
    """All pairs of customers whose name keys are at most one edit apart.

    Two such keys share themselves or a form with one character left out, so distinct keys meet in an equi-join on these
    forms and are verified; then the customers of each key take the places of keys. Customers and forms are many times the
    bytes by which a join would be a broadcast, so all joins are merges.
    """
    n = read_table(spark, sf_dir, "customer").select("c_custkey", T.name_key(F.col("c_name")).alias("k"))
    keys = n.select("k").distinct().where("k IS NOT NULL")
    without = F.transform(F.sequence(F.lit(1), F.greatest(F.length("k"), F.lit(1))), lambda i: F.concat(F.substring(F.col("k"), F.lit(1), i - 1), F.substring(F.col("k"), i + 1, F.length("k"))))
    forms = keys.select("k", F.explode(F.array_distinct(F.array_append(without, F.col("k")))).alias("form"))
    met = forms.join(forms.withColumnRenamed("k", "other").hint("merge"), "form").where(F.levenshtein("k", "other", 1) >= 0).select("k", "other").distinct()
    near = met.join(n.withColumnRenamed("c_custkey", "a").hint("merge"), "k").join(n.select(F.col("c_custkey").alias("b"), F.col("k").alias("other")).hint("merge"), "other")
    return near.where("a < b").select("a", "b")


@query("WITH " + S.SQL + """, l AS (SELECT q, '[' || string_agg(i, ',' ORDER BY i) || ',99]' AS j FROM opt GROUP BY q)
SELECT l.q, opt.i FROM l JOIN opt ON opt.q = l.q""")
def shared_links(spark, sf_dir):
    """A list coded in a link (base64url of JSON) read back; ids that do not exist go."""
    own = S.options(spark, sf_dir).select("q", "i")
    coded = own.groupBy("q").agg(F.translate(F.base64(F.to_json(F.array_append(F.array_sort(F.collect_list("i")), F.lit(99).cast("long"))).cast("binary")), "+/=", "-_").alias("link"))
    back = coded.select("q", F.explode(F.from_json(T.from_base64url(F.col("link")), "array<bigint>")).alias("i"))
    return back.join(own, ["q", "i"], "left_semi")


@query("SELECT doc_id, CASE WHEN length(text) > 400 THEN rtrim(substr(text, 1, 400), ' ') || '…' ELSE text END AS shown FROM documents")
def shortened_texts(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", T.shortened(F.col("text")).alias("shown"))


#: Ids whose digests are gathered in one step (4 MB of them); their digests are gathered in the next.
VERSION_RANGE = 100_000


@query(f"SELECT lang, sha1(string_agg(d, '' ORDER BY r)) AS version FROM (SELECT lang, doc_id // {VERSION_RANGE} AS r, sha1(string_agg(sha1(text), '' ORDER BY doc_id)) AS d FROM documents GROUP BY ALL) GROUP BY lang")
def content_versions(spark, sf_dir):
    """A digest of the digests in order, by ranges of ids first, so that no task gathers all of them."""
    joined = lambda at: F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, "d"))), lambda x: x["d"]), "").cast("binary"))
    rows = read_table(spark, sf_dir, "documents").select("lang", "doc_id", F.expr(f"doc_id div {VERSION_RANGE}").alias("r"), F.sha1(F.col("text").cast("binary")).alias("d"))
    return rows.groupBy("lang", "r").agg(joined("doc_id").alias("d")).groupBy("lang").agg(joined("r").alias("version"))


@query("""SELECT usr, string_agg(k || '=' || n, ',' ORDER BY k) AS merged FROM (SELECT user_id AS usr, event_type AS k, count(*) AS n FROM events GROUP BY ALL HAVING event_type <> 'error') GROUP BY usr""")
def deep_merge(spark, sf_dir):
    """Two documents' maps merged with increments, and a field deleted."""
    e = read_table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count_if(F.col("event_id") % 2 == 0).alias("a"), F.count_if(F.col("event_id") % 2 == 1).alias("b"))
    maps = e.groupBy(F.col("user_id").alias("usr")).agg(F.map_from_entries(F.collect_list(F.struct("event_type", "a"))).alias("x"), F.map_from_entries(F.collect_list(F.struct("event_type", "b"))).alias("y"))
    merged = F.map_filter(F.map_zip_with("x", "y", lambda k, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), lambda k, v: k != "error")
    parts = F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return maps.select("usr", F.array_join(parts, ",").alias("merged")).where("merged <> ''")


@query("""WITH d AS (SELECT CAST(range AS DATE) AS day FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-01', INTERVAL 1 DAY)),
a AS (SELECT day, date_diff('day', DATE '2000-01-06', day) % 29.530588853 / 29.530588853 AS age FROM d)
SELECT CAST(day AS VARCHAR) AS day, round(age, 4) AS age, round((1 - cos(2 * pi() * age)) / 2, 4) AS lit FROM a""")
def moon_phases(spark, sf_dir):
    from quizloom.functions.sky import moon_age, moon_lit

    days = spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-02-29')) AS day")
    return days.select(F.col("day").cast("string").alias("day"), F.round(moon_age(F.col("day")), 4).alias("age"), F.round(moon_lit(F.col("day")), 4).alias("lit"))


@query("SELECT item_id, replace(url_encode(text), '%20', '+') AS q, text AS back FROM (SELECT item_id, replace(text, chr(10), ' ') AS text FROM benchmark)")
def report_links(spark, sf_dir):
    """A form's address with the whole text filled in, and the text parsed out of it again."""
    text = F.replace("text", F.lit("\n"), F.lit(" "))
    rows = read_table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("https://forms.example.org/r?q="), F.url_encode(text)).alias("url"))
    query_ = F.try_parse_url(F.col("url"), F.lit("QUERY"), F.lit("q"))
    return rows.select("item_id", query_.alias("q"), F.url_decode(query_).alias("back"))


@query("SELECT DISTINCT lang, regexp_replace(lower(lang || '-' || source), '[^a-z0-9]+', '-', 'g') AS slug FROM documents")
def set_slugs(spark, sf_dir):
    """Slugs in which a repeated word stands once."""
    rows = read_table(spark, sf_dir, "documents").select("lang", "source").distinct()
    return rows.select("lang", T.set_slug(F.concat_ws(" ", "lang", "source", "lang")).alias("slug")).distinct()
