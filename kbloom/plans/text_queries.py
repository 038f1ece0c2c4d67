"""Text, pattern and term queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbloom.functions import text as T
from kbloom.functions.dialect import half_up, squash
from kbloom.operators import pages as P
from kbloom.operators import terms
from kbloom.plans.registry import literal, query, table
from kbloom.sources.scratch import cutter

# --- the same expressions in DuckDB's SQL ---

SQL_TEXT = r"trim(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g'))"
SQL_WORDS = f"regexp_extract_all(t, {literal(T.WORD)})"
SQL_SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+([A-Z"“(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: len(string_split(s, ' ')) >= 3)"""
_CLEAN = "regexp_replace(lower(w), '[^a-z]', '', 'g')"
SQL_SYLLABLES = f"CASE WHEN length({_CLEAN}) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(regexp_replace(regexp_replace({_CLEAN}, '(?:[^laeiouy]es|ed|[^laeiouy]e)$', ''), '^y', ''), '[aeiouy]{{1,2}}'))) END"
_LOW = "regexp_replace(lower(word), '[''’]s$', '')"
SQL_TERM = f"CASE WHEN length({_LOW}) BETWEEN 4 AND 24 AND {_LOW} NOT IN ({', '.join(map(literal, sorted({*T.STOP_WORDS, *T.BUSINESS_WORDS})))}) THEN {_LOW} END"
_INCIDENCE = f"""
w AS (SELECT source AS site, doc_id AS doc, unnest({SQL_WORDS.replace('(t,', '(text,')}) AS word, generate_subscripts({SQL_WORDS.replace('(t,', '(text,')}, 1) - 1 AS pos FROM documents),
i AS (SELECT site, doc, {SQL_TERM} AS term, count(*) AS n, min(pos) AS pos FROM w WHERE {SQL_TERM} IS NOT NULL GROUP BY ALL),
z AS (SELECT source AS site, count(*) AS docs FROM documents GROUP BY 1),
s AS (SELECT site, term, sum(n)::BIGINT AS tf, count(*) AS df, min({{'d': doc, 'p': pos}}) AS f FROM i GROUP BY ALL),
st AS (SELECT s.*, df / greatest(docs, 1) AS spread FROM s JOIN z USING (site)),
c AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY tf DESC, f) AS rank FROM st WHERE tf >= 4 AND spread < 0.9)"""


def _up(x: str, k: int) -> str:
    return f"floor(({x}) * {10.0**k} + 0.5) / {10.0**k}"


def _ratio(test: str) -> str:
    return f"CASE WHEN n = 0 OR w = 0 THEN 0.0::DOUBLE ELSE {_up(f'len(list_filter(ss, lambda s: {test})) / n', 2)} END"


_MEASURED = f"""
d AS (SELECT doc_id, {SQL_TEXT} AS t FROM documents),
p AS (SELECT doc_id, t, {SQL_SENTENCES} AS ss, {SQL_WORDS} AS ws FROM d),
q AS (SELECT *, len(ss) AS n, len(ws) AS w, list_sum(list_transform(ws, lambda w: {SQL_SYLLABLES})) AS y FROM p),
m AS (SELECT doc_id, w AS word_count, n AS sentence_count,
  CASE WHEN n = 0 OR w = 0 THEN 0.0::DOUBLE ELSE {_up('w / n', 2)} END AS mean_length,
  CASE WHEN n = 0 OR w = 0 THEN 0.0::DOUBLE ELSE {_up('sqrt(list_sum(list_transform(ss, lambda s: (len(string_split(s, chr(32)))::DOUBLE - w / n) * (len(string_split(s, chr(32)))::DOUBLE - w / n))) / n)', 2)} END AS length_stddev,
  CASE WHEN n = 0 OR w = 0 THEN 0.0::DOUBLE ELSE {_up('greatest(0.39::DOUBLE * (w / n) + 11.8::DOUBLE * (y / w) - 15.59::DOUBLE, 0.0::DOUBLE)', 2)} END AS reading_grade,
  {_ratio(f'regexp_matches(lower(s), {literal(T.YOU)})')} AS second_person, {_ratio(f'regexp_matches(lower(s), {literal(T.WE)})')} AS first_person,
  {_ratio("contains(s, '!')")} AS exclamations, {_ratio("contains(s, '?')")} AS questions, {_ratio(f'regexp_matches(lower(s), {literal(T.IMPERATIVE)})')} AS imperatives FROM q)"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", squash(F.col("text")).alias("t"))


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _documents(spark, sf_dir).select("doc_id", "t", T.sentences(F.col("t")).alias("ss"), T.words(F.col("t")).alias("ws"))
    return parts.select("doc_id", T.metrics(F.col("t"), F.col("ss"), F.col("ws")).alias("m")).select("doc_id", "m.*")


@query(f"WITH d AS (SELECT doc_id, {SQL_TEXT} AS t FROM documents) SELECT doc_id, len(ss) AS n_sentences, md5(array_to_string(ss, chr(10))) AS sentences_md5 FROM (SELECT doc_id, {SQL_SENTENCES} AS ss FROM d)")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _documents(spark, sf_dir).select("doc_id", T.sentences(F.col("t")).alias("ss"))
    return found.select("doc_id", F.size("ss").cast("long").alias("n_sentences"), F.md5(F.array_join("ss", "\n")).alias("sentences_md5"))


@query(f"WITH d AS (SELECT unnest({SQL_WORDS.replace('(t,', '(text,')}) AS w FROM documents), u AS (SELECT lower(w) AS w, count(*) AS n FROM d GROUP BY 1) SELECT w AS word, n, ({SQL_SYLLABLES})::INT AS syllables FROM u")
def syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "documents").select(F.explode(T.words(F.col("text"))).alias("word"))
    return each.groupBy(F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("n")).withColumn("syllables", T.syllables(F.col("word")))


@query(f"WITH {_MEASURED} SELECT * FROM m")
def text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir)


@query(f"""WITH {_MEASURED} SELECT doc_id,
  coalesce(nullif(array_to_string(list_filter([CASE WHEN reading_grade >= 12 THEN 'technical' END, CASE WHEN reading_grade < 9 THEN 'conversational' END, CASE WHEN second_person > 0.35 THEN 'direct' END,
    CASE WHEN first_person > 0.35 THEN 'warm' END, CASE WHEN exclamations > 0.05 THEN 'urgent' END], lambda x: x IS NOT NULL), ','), ''), 'professional') AS tone,
  CASE WHEN reading_grade >= 13 THEN 'formal' WHEN reading_grade < 8 THEN 'casual' ELSE 'neutral' END AS formality,
  CASE WHEN second_person > first_person * 1.5 THEN 'second-person' WHEN first_person > second_person * 1.5 THEN 'third-person' ELSE 'mixed' END AS reader_address,
  CASE WHEN word_count > 300 THEN 0.25::DOUBLE ELSE 0.1::DOUBLE END AS confidence FROM m""")
def writing_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a text is written, read off its measures."""
    c = F.col
    tones = [("technical", c("reading_grade") >= 12), ("conversational", c("reading_grade") < 9), ("direct", c("second_person") > 0.35), ("warm", c("first_person") > 0.35), ("urgent", c("exclamations") > 0.05)]
    tone = F.concat_ws(",", *[F.when(test, name) for name, test in tones])
    return _measured(spark, sf_dir).select(
        "doc_id",
        F.when(tone == "", "professional").otherwise(tone).alias("tone"),
        F.when(c("reading_grade") >= 13, "formal").when(c("reading_grade") < 8, "casual").otherwise("neutral").alias("formality"),
        F.when(c("second_person") > c("first_person") * 1.5, "second-person").when(c("first_person") > c("second_person") * 1.5, "third-person").otherwise("mixed").alias("reader_address"),
        F.when(c("word_count") > 300, 0.25).otherwise(0.1).alias("confidence"),
    )


@query(f"""
WITH d AS (SELECT doc_id, {SQL_TEXT} AS t FROM documents), p AS (SELECT doc_id, {SQL_SENTENCES} AS ss FROM d),
g AS (SELECT doc_id, list_filter(ss, lambda s: len(string_split(s, ' ')) BETWEEN 6 AND 45 AND length(s) <= 320 AND NOT regexp_matches(lower(s), {literal(T.BOILERPLATE)}) AND regexp_matches(s, '[.!?]$')) AS g FROM p),
e AS (SELECT doc_id, CASE WHEN len(g) <= 12 THEN g ELSE list_transform(range(12), lambda i: g[1 + floor(i * (len(g) / 12.0::DOUBLE))::INT]) END AS g FROM g)
SELECT doc_id, unnest(g) AS sentence, (generate_subscripts(g, 1) - 1)::INT AS place FROM e""")
def exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _documents(spark, sf_dir).select("doc_id", T.sentences(F.col("t")).alias("ss"))
    return found.select("doc_id", F.posexplode(T.exemplars(F.col("ss"))).alias("place", "sentence"))


def _incidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("site"), F.col("doc_id").alias("doc"), "text")
    return terms.incidence(docs), docs


@query(f"WITH {_INCIDENCE} SELECT site, term, tf AS n, row_number() OVER (PARTITION BY site ORDER BY tf DESC, term)::INT AS rank FROM s WHERE tf >= 3 QUALIFY row_number() OVER (PARTITION BY site ORDER BY tf DESC, term) <= 15")
def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.top_terms(_incidence(spark, sf_dir)[1]).select("site", "term", "n", "rank")


@query(f"WITH {_INCIDENCE} SELECT site, term, tf, df, {_up('spread', 6)} AS spread FROM st")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.statistics(*_incidence(spark, sf_dir)).select("site", "term", "tf", "df", half_up(F.col("spread"), 6).alias("spread"))


@query(f"""WITH {_INCIDENCE}, k AS (SELECT i.site, i.doc, i.term, c.df FROM i JOIN c USING (site, term))
SELECT a.site, a.term AS a, b.term AS b, count(*) AS "both", {_up('count(*) / least(min(a.df), min(b.df))', 6)} AS overlap
FROM k a JOIN k b ON a.site = b.site AND a.doc = b.doc AND a.term < b.term GROUP BY a.site, a.term, b.term""")
def term_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of all terms of a site that may found a theme."""
    return terms.theme_pairs(*_incidence(spark, sf_dir))


@query()
def themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, docs = _incidence(spark, sf_dir)
    cut = cutter(spark, "themes")
    found = cut(found, "found")
    return terms.themes(found, terms.candidates(terms.statistics(found, docs)), cut)


# --- patterns ---


@query(rf"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, {literal(T.PHONE)})) AS raw FROM documents),
n AS (SELECT doc_id, regexp_replace(regexp_replace(raw, '[^0-9]', '', 'g'), '^1([0-9]{{10}})$', '\1') AS x FROM m)
SELECT DISTINCT doc_id, x[1:3] || '-' || x[4:6] || '-' || x[7:10] AS phone FROM n WHERE length(x) = 10 AND NOT regexp_matches(x, '^(?:1{{7,}}|0{{7,}}|1234567890)$')""")
def phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(T.PHONE), F.lit(0))).alias("raw"))
    return each.select("doc_id", T.phone(F.col("raw")).alias("phone")).where("phone is not null").distinct()


@query(f"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), {literal(T.EMAIL)})) AS email FROM documents)
SELECT DISTINCT doc_id, email, regexp_matches(email, '(example|test|your|domain|email|sentry|wixpress|sample)\\.(com|org|net)$') OR regexp_matches(email, '^(user|name|youremail|info@example)') OR regexp_matches(email, '\\.(png|jpe?g|gif|webp|svg)$') AS junk FROM m""")
def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(T.EMAIL), F.lit(0))).alias("email"))
    return each.distinct().withColumn("junk", T.junk_email(F.col("email")))


_CLAIMS = "SELECT s_suppkey, 'We hold License No. ' || lpad(s_suppkey::VARCHAR, 5, '0') || '. Over ' || (s_suppkey % 60 + 1) || ' years of experience, since ' || (1950 + s_suppkey % 70) || '. More than ' || (s_suppkey * 10 + 25) || ' satisfied customers and ' || (s_suppkey + 12) || ' wells drilled.' AS text FROM supplier"


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    text = F.format_string(
        "We hold License No. %05d. Over %d years of experience, since %d. More than %d satisfied customers and %d wells drilled.",
        key, key % 60 + 1, key % 70 + 1950, key * 10 + 25, key + 12,
    )
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("text"))


@query(f"WITH c AS ({_CLAIMS}) SELECT s_suppkey, trim(unnest(regexp_extract_all(text, {literal('(?i)' + T.LICENCE)}, 1))) AS identifier FROM c")
def licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir).select("s_suppkey", F.explode(T.found(F.col("text"), T.LICENCE, 1)).alias("identifier")).select("s_suppkey", F.trim("identifier").alias("identifier"))


@query(f"WITH c AS ({_CLAIMS}) SELECT s_suppkey, unnest(regexp_extract_all(text, {literal('(?i)' + T.SINCE)}, 1))::INT AS year FROM c")
def since_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir).select("s_suppkey", F.explode(T.found(F.col("text"), T.SINCE, 1)).alias("y")).select("s_suppkey", F.col("y").cast("int").alias("year"))


_TRUST = " UNION ALL ".join(f"SELECT s_suppkey, {literal(c)} AS category, {literal(u)} AS unit, trim(unnest(regexp_extract_all(text, {literal('(?i)' + p)}))) AS claim, unnest(regexp_extract_all(text, {literal('(?i)' + p)}, 1)) AS raw FROM c" for c, u, p in T.TRUST)


@query(f"WITH c AS ({_CLAIMS}), a AS ({_TRUST}) SELECT s_suppkey, category, unit, claim, CASE WHEN lower(raw) IN ('a', 'one') THEN 1.0::DOUBLE ELSE try_cast(replace(raw, ',', '') AS DOUBLE) END AS value FROM a WHERE length(claim) <= 90")
def trust_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _claims(spark, sf_dir)
    rows = []
    for category, unit, pattern in T.TRUST:
        claim, raw = T.found(F.col("text"), pattern), T.found(F.col("text"), pattern, 1)
        rows.append(F.arrays_zip(claim.alias("claim"), raw.alias("raw"), F.array_repeat(F.lit(category), F.size(claim)).alias("category"), F.array_repeat(F.lit(unit), F.size(claim)).alias("unit")))
    each = claims.select("s_suppkey", F.explode(F.concat(*rows)).alias("r")).select("s_suppkey", "r.category", "r.unit", F.trim("r.claim").alias("claim"), "r.raw")
    value = F.when(F.lower("raw").isin("a", "one"), 1.0).otherwise(F.regexp_replace("raw", ",", "").try_cast("double"))
    return each.where(F.length("claim") <= 90).select("s_suppkey", "category", "unit", "claim", value.alias("value"))


_TITLES = ["Owner", "Co-Founder & CEO", "Vice President of Sales", "Lead Driller", "Office Manager", "Attorney at Law", "Receptionist", "", "Leader", "Partnership Director"]


@query(f"""
WITH t AS (SELECT c_custkey, ([{", ".join(map(literal, _TITLES))}])[1 + c_custkey % {len(_TITLES)}] AS title FROM customer)
SELECT c_custkey, title, CASE WHEN title = '' THEN NULL WHEN regexp_matches(lower(title), '\\b(owner|founder|co-?founder|proprietor)\\b') THEN 'owner'
  WHEN regexp_matches(lower(title), '\\b(ceo|cfo|coo|cto|president|vice president|vp|principal|partner)\\b') THEN 'executive'
  WHEN regexp_matches(lower(title), '\\b(manager|director|supervisor|lead|foreman|superintendent)\\b') THEN 'manager'
  WHEN regexp_matches(lower(title), '\\b(advisor|consultant|attorney|accountant)\\b') THEN 'advisor' ELSE 'staff' END AS role FROM t""")
def role_from_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("c_custkey") % len(_TITLES) + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", title.alias("title"), T.role_from_title(title).alias("role"))


@query("SELECT source, regexp_replace(lower(text), '[^a-z0-9]', '', 'g')[1:120] AS quote_key, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE regexp_replace(lower(text), '[^a-z0-9]', '', 'g') <> '' GROUP BY 1, 2")
def quote_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "documents").select("source", "doc_id", T.quote_key(F.col("text")).alias("quote_key")).where("quote_key <> ''")
    return keyed.groupBy("source", "quote_key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))


_OFFER = "SELECT p_partkey, p_brand, p_name || CASE p_partkey % 4 WHEN 0 THEN ' Services' WHEN 1 THEN ', Inc' WHEN 2 THEN ' maintenance plan' ELSE '' END AS name, p_type FROM part"
_KEY = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '[^a-z0-9\s]', ' ', 'g'), '\b(services?|solutions?|systems?|company|inc|llc)\b', '', 'g'), '\s+', ' ', 'g'))"


def _offerings(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.expr("CASE p_partkey % 4 WHEN 0 THEN ' Services' WHEN 1 THEN ', Inc' WHEN 2 THEN ' maintenance plan' ELSE '' END")
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat("p_name", suffix).alias("name"), "p_type")


@query(f"WITH o AS ({_OFFER}), k AS (SELECT *, {_KEY} AS key FROM o) SELECT p_brand, key, arg_min(name, length(name) * 1000000000 + p_partkey) AS name, arg_min(p_type, p_partkey) AS description, count(*) AS candidates FROM k GROUP BY p_brand, key")
def offering_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of one key become one offering with the shortest name."""
    keyed = _offerings(spark, sf_dir).withColumn("key", T.offering_key(F.col("name")))
    return keyed.groupBy("p_brand", "key").agg(F.min_by("name", F.struct(F.length("name"), "p_partkey")).alias("name"), F.min_by("p_type", "p_partkey").alias("description"), F.count(F.lit(1)).alias("candidates"))


_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(lower(name), {literal(p)}) THEN {literal(c)}" for c, p in T.CATEGORIES) + " ELSE 'service' END"


@query(f"WITH o AS ({_OFFER}) SELECT p_partkey, {_CATEGORY} AS category FROM o")
def offering_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offerings(spark, sf_dir).select("p_partkey", T.offering_category(F.col("name")).alias("category"))


_HEADS = ["How to oil a {}", "Top 10 {} tips", "Is your {} safe?", "{} vs. the rest", "Winter {} care", "Introducing the {}", "{} repair in Austin, TX", "A note on the {}", "7 {} facts"]
_TITLE = "replace(([" + ", ".join(map(literal, _HEADS)) + f"])[1 + (p_partkey * 7 // 3) % {len(_HEADS)}], '{{}}', p_name)".replace("{{}}", "{}")
_HEADLINE = "CASE " + " ".join(f"WHEN regexp_matches(lower(title), {literal(p)}) THEN {literal(n)}" for n, p in T.HEADLINES) + f" WHEN regexp_matches(title, {literal(T.LOCAL)}) THEN 'local-service' ELSE 'other' END"


@query(f"""
WITH t AS (SELECT p_brand, p_partkey, {_TITLE} AS title FROM part), h AS (SELECT *, {_HEADLINE} AS pattern FROM t)
SELECT p_brand, pattern, count(*) AS n, array_to_string(list(title ORDER BY p_partkey)[1:3], '|') AS examples, min(p_partkey) AS first_part
FROM h GROUP BY p_brand, pattern HAVING pattern <> 'other' OR count(*) >= 3""")
def headline_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.element_at(F.array(*map(F.lit, _HEADS)), (F.floor(F.col("p_partkey") * 7 / 3) % len(_HEADS) + 1).cast("int"))
    titles = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.replace(head, F.lit("{}"), "p_name").alias("title"))
    named = titles.withColumn("pattern", T.headline(F.col("title")))
    placed = named.withColumn("k", F.row_number().over(Window.partitionBy("p_brand", "pattern").orderBy("p_partkey")))
    examples = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.struct("k", "title")))), lambda x: x["title"]), "|")
    found = placed.groupBy("p_brand", "pattern").agg(F.count(F.lit(1)).alias("n"), examples.alias("examples"), F.min("p_partkey").alias("first_part"))
    return found.where("pattern <> 'other' or n >= 3")


_SIGNIFICANT = f"list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda w: length(w) > 3 AND w NOT IN ({', '.join(map(literal, T.GAP_WORDS))}))[1:3]"


@query(f"""
WITH o AS (SELECT p_partkey, p_brand, p_name || ' ' || p_type AS name FROM part WHERE p_partkey % 3 <> 0),
h AS (SELECT p_brand, lower(string_agg(p_name, ' ')) AS hay FROM part WHERE p_partkey % 3 = 0 GROUP BY p_brand),
g AS (SELECT o.p_brand, o.p_partkey, o.name FROM o LEFT JOIN h USING (p_brand)
      WHERE len({_SIGNIFICANT}) > 0 AND len(list_filter({_SIGNIFICANT}, lambda w: NOT contains(coalesce(hay, ''), w))) > 0)
SELECT p_brand, p_partkey, name AS topic FROM g QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 10""")
def content_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offerings whose telling words no post of the site has; ten of each site."""
    part = table(spark, sf_dir, "part")
    offers = part.where("p_partkey % 3 <> 0").select("p_partkey", "p_brand", F.concat_ws(" ", "p_name", "p_type").alias("name"))
    posts = part.where("p_partkey % 3 = 0").select("p_brand", F.lower("p_name").alias("post")).distinct()
    asked = offers.select("p_brand", "p_partkey", "name", F.explode(T.significant(F.col("name"))).alias("word"))
    held = asked.select("p_brand", "word").distinct().join(posts, "p_brand").where(F.contains("post", "word")).select("p_brand", "word").distinct()
    gaps = asked.join(held, ["p_brand", "word"], "left_anti").groupBy("p_brand", "p_partkey").agg(F.first("name").alias("topic"))
    return gaps.withColumn("k", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))).where("k <= 10").drop("k")


@query("""
WITH p AS (SELECT user_id, count(*) AS n, min(ts) AS a, max(ts) AS b FROM events WHERE event_type IN ('view', 'signup') GROUP BY user_id)
SELECT user_id, floor(n / greatest(1.0::DOUBLE, (epoch_us(b) - epoch_us(a)) / 2630016000000.0::DOUBLE) * 100.0 + 0.5) / 100.0 AS posts_per_month, strftime(a, '%Y-%m-%d') AS first_published, strftime(b, '%Y-%m-%d') AS last_published,
  greatest(0, floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(b)) / 86400000000.0))::BIGINT AS days_since_last, floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(b)) / 86400000000.0) > 90 AS is_stale FROM p""")
def cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = table(spark, sf_dir, "events").where("event_type in ('view', 'signup')")
    each = posts.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    span = F.expr("timestampdiff(MICROSECOND, a, b)") / F.lit(2630016000000.0)
    since = F.floor(F.expr("timestampdiff(MICROSECOND, b, timestamp_ntz'2024-02-01 00:00:00')") / F.lit(86400000000.0))
    return each.select(
        "user_id", half_up(F.col("n") / F.greatest(F.lit(1.0), span), 2).alias("posts_per_month"),
        F.date_format("a", "yyyy-MM-dd").alias("first_published"), F.date_format("b", "yyyy-MM-dd").alias("last_published"),
        F.greatest(F.lit(0), since).cast("long").alias("days_since_last"), (since > 90).alias("is_stale"),
    )


_MATCH = r"trim(regexp_replace(regexp_replace(translate(lower({}), '‘’‚‛“”„‟‐‑‒–—―' || chr(160), repeat(chr(39), 4) || repeat(chr(34), 4) || '------ '), '[^A-Za-z0-9_\s''\-]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"""
WITH b AS (SELECT item_id, {_MATCH.format('text')} AS q FROM benchmark), d AS (SELECT doc_id, {_MATCH.format('text')} AS t FROM documents)
SELECT item_id, doc_id FROM b JOIN d ON contains(t, q) WHERE length(q) >= 10""")
def verbatim_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes that stand word for word in a document.

    Candidates meet on words of the quote, or on parts of them for the shortest,
    so no quote is compared with a document that doesn't have them.
    """
    quotes = table(spark, sf_dir, "benchmark").select("item_id", T.for_match(F.col("text")).alias("q")).where("length(q) >= 10")
    docs = table(spark, sf_dir, "documents").select("doc_id", T.for_match(F.col("text")).alias("t"))
    return P.verbatim(quotes, docs)


@query(r"""
WITH t AS (SELECT source, doc_id, trim(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g')) AS t FROM documents),
c AS (SELECT source, doc_id, t, least(length(t), 4000) AS n FROM t WHERE t <> ''),
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM c)
SELECT source, doc_id, least(n, 60000 - used)::INT AS n_chars, md5(substr(t, 1, least(n, 60000 - used)::INT)) AS excerpt_md5 FROM r WHERE used < 60000""")
def excerpt_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of a source's documents, 4,000 characters each, 60,000 in all."""
    docs = _documents(spark, sf_dir).where("t <> ''").withColumn("n", F.least(F.length("t"), F.lit(4000)))
    return P.excerpts(docs, "source", "doc_id", 60_000).select("source", "doc_id", F.col("take").alias("n_chars"), F.md5(F.expr("substring(t, 1, take)")).alias("excerpt_md5"))
