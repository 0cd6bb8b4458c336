"""Queries of profiles, renderings, relative dates, relocation, refusals and receipts, each next to its SQL.

Customers stand for persons and places, nations for scopes, orders for mentions: the number of an order tells the form.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.functions import dates, keyed
from veilframe.operators import hashtree, metrics, profiles, receipts, relative, relocate, similar, spans, surrogates
from veilframe.operators.shared import kept, pinned
from veilframe.plans import catalogue as C

query = C.query

# Names by the number of a customer, forms by the number of an order.

_P_SQL = """p AS (SELECT 'n' || c_nationkey AS scope_id, 'E' || c_custkey AS who, c_custkey, o_orderkey,
  translate(lpad(CAST(c_custkey * 7919 % 10000 AS VARCHAR), 4, '0'), '0123456789', 'nolagidume') AS f,
  translate(lpad(CAST(c_custkey * 104729 % 100000 AS VARCHAR), 5, '0'), '0123456789', 'braketsohi') AS l
  FROM orders JOIN customer ON o_custkey = c_custkey),
q AS (SELECT *, upper(f[1]) || f[2:] AS fn, upper(l[1]) || l[2:] AS ln, upper(f[1]) AS fi, upper(l[1]) AS li, o_orderkey % 7 AS m FROM p)"""


def _people(spark, sf_dir):
    orders, customers = C._t(spark, sf_dir, "orders"), C._t(spark, sf_dir, "customer")
    word = lambda step, size, letters: F.translate(F.lpad((F.col("c_custkey") * step % 10**size).cast("string"), size, "0"), "0123456789", letters)
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("n"), "c_nationkey").alias("scope_id"), F.concat(F.lit("E"), "c_custkey").alias("who"), "c_custkey", "o_orderkey",
        F.initcap(word(7919, 4, "nolagidume")).alias("fn"), F.initcap(word(104729, 5, "braketsohi")).alias("ln"),
    )


def _key():
    return keyed.hmac_hex(F.col("scope_id")).alias("key")


def _name_mentions(spark, sf_dir):
    """Full names, titles, initials, capitals, first names and generic references."""
    fi, li, m = F.substring("fn", 1, 1), F.substring("ln", 1, 1), F.col("o_orderkey") % 7
    title = F.when(F.col("c_custkey") % 2 == 0, "Mr. ").otherwise("Mrs. ")
    form = (
        F.when(m == 0, F.concat_ws(" ", "fn", "ln")).when(m == 1, F.concat(title, "ln")).when(m == 2, F.concat(fi, F.lit(". "), "ln"))
        .when(m == 3, F.concat(fi, F.lit("."), li, F.lit("."))).when(m == 4, F.upper(F.concat_ws(" ", "fn", "ln"))).when(m == 5, F.col("fn")).otherwise("the patient")
    )
    return _people(spark, sf_dir).select("scope_id", _key(), F.lit("PATIENT").alias("type"), "who", form.alias("old"), m.alias("m"))


def _forms(mentions):
    """A table, as profiles read it a dozen times."""
    return kept(mentions.groupBy("scope_id", "key", "type", "who", "old").agg(F.count("*").alias("n")), "forms")


@query(f"""WITH {_P_SQL}, x AS (SELECT DISTINCT scope_id, lower(fi || li) AS pair FROM q WHERE m IN (0, 2, 3, 4))
SELECT scope_id, count(*) AS n_pairs, string_agg(pair, ' ' ORDER BY pair) AS pairs FROM x GROUP BY scope_id""")
def initials_pairs(spark, sf_dir):
    pairs = profiles.initials_pairs(_forms(_name_mentions(spark, sf_dir)))
    return pairs.groupBy("scope_id").agg(F.count("*").alias("n_pairs"), F.array_join(F.array_sort(F.collect_list("pair")), " ").alias("pairs"))


@query(f"""WITH {_P_SQL}, t AS (SELECT *, max(m IN (0, 4)) OVER (PARTITION BY who) AS has_full, max(m = 1) OVER (PARTITION BY who) AS titled FROM q),
x AS (SELECT scope_id, who, f AS word, 'first' AS place FROM t WHERE m IN (0, 4, 5)
  UNION ALL SELECT scope_id, who, l, CASE WHEN has_full OR titled THEN 'last' ELSE 'first' END FROM t WHERE m IN (0, 1, 2, 4))
SELECT scope_id, who, word, place, count(*) AS n FROM x GROUP BY ALL""")
def name_word_places(spark, sf_dir):
    """Whether a word is a first or a last name: by full names, by titles, by words near those."""
    return profiles.name_words(_forms(_name_mentions(spark, sf_dir)))


@query(f"""WITH {_P_SQL}, x AS (SELECT scope_id, count(DISTINCT who) AS n, count(DISTINCT lower(fi || li)) AS own FROM q WHERE m <> 6 GROUP BY scope_id)
SELECT scope_id, n AS n_persons, n AS n_first, n AS n_last, least(n, {len(profiles.PAIRS)} - own) AS n_pairs, 0::BIGINT AS n_own_initials, 0::BIGINT AS n_originals FROM x""")
def person_surrogates(spark, sf_dir):
    """Surrogates of each scope's persons: no word twice, no initials twice before all are in use, none of the scope's own."""
    people = _name_mentions(spark, sf_dir).where("m <> 6").groupBy("scope_id", "key", "who").agg(F.min("m").alias("m"))
    names = _people(spark, sf_dir).select("scope_id", "who", "fn", "ln").distinct()
    forms = people.join(names, ["scope_id", "who"]).select("scope_id", "key", F.lit("PATIENT").alias("type"), "who", F.concat_ws(" ", "fn", "ln").alias("old"), F.lit(1).alias("n"))
    forms = kept(forms, "forms")
    new = profiles.surrogates(forms).select("scope_id", F.split("old", " ").alias("o"), F.split("new", " ").alias("s"))
    first = lambda c, i: F.substring(F.get(c, F.lit(i)), 1, 1)
    own = forms.select("scope_id", F.explode(F.split(F.lower("old"), " ")).alias("word")).distinct()
    still = new.select("scope_id", F.explode(F.transform("s", lambda w: F.lower(w))).alias("word")).join(own, ["scope_id", "word"], "left_semi")
    by = new.groupBy("scope_id").agg(
        F.count("*").alias("n_persons"), F.countDistinct(F.get("s", F.lit(0))).alias("n_first"), F.countDistinct(F.get("s", F.lit(1))).alias("n_last"),
        F.countDistinct(F.concat(first("s", 0), first("s", 1))).alias("n_pairs"),
        F.count_if((first("s", 0) == first("o", 0)) | (first("s", 1) == first("o", 1))).alias("n_own_initials"),
    )
    return by.join(still.groupBy("scope_id").agg(F.count("*").alias("n_originals")), "scope_id", "left").fillna(0, "n_originals")


@query(f"""WITH {_P_SQL}, t AS (SELECT *, max(m IN (0, 4)) OVER (PARTITION BY who) AS has_full FROM q)
SELECT m, count(*) AS n, count(*) AS n_right, count(DISTINCT who) AS n_persons FROM t WHERE has_full AND m <> 6 GROUP BY m""")
def name_forms(spark, sf_dir):
    """Forms of persons with a full name: each is the same form of their one surrogate."""
    mentions = _name_mentions(spark, sf_dir).where("m <> 6")
    new = profiles.surrogates(_forms(mentions)).select("scope_id", "who", "old", "new")
    whole = mentions.where("m in (0, 4)").select("scope_id", "who", "old").distinct().join(new, ["scope_id", "who", "old"])
    whole = whole.groupBy("scope_id", "who").agg(F.min(F.initcap("new")).alias("name"))
    each = mentions.join(new, ["scope_id", "who", "old"]).join(whole, ["scope_id", "who"])
    a, b, m = F.substring_index("name", " ", 1), F.substring_index("name", " ", -1), F.col("m")
    want = (
        F.when(m == 0, F.col("name")).when(m == 1, F.concat(F.substring_index("old", " ", 1), F.lit(" "), b)).when(m == 2, F.concat(F.substring(a, 1, 1), F.lit(". "), b))
        .when(m == 3, F.concat(F.substring(a, 1, 1), F.lit("."), F.substring(b, 1, 1), F.lit("."))).when(m == 4, F.upper("name")).otherwise(a)
    )
    return each.groupBy("m").agg(F.count("*").alias("n"), F.count_if(F.col("new") == want).alias("n_right"), F.countDistinct("who").alias("n_persons"))


_W_SQL = _P_SQL + """, w AS (SELECT scope_id, who, o_orderkey, ln || 'burg' AS city, fn || 'ia' AS region, o_orderkey % 4 AS k FROM q),
v AS (SELECT *, CASE k WHEN 0 THEN city || ', ' || region || ', Canada' WHEN 1 THEN city || ', ' || region WHEN 2 THEN city ELSE region END AS old FROM w)"""
_Z_SQL = _W_SQL + """, z AS (SELECT scope_id, who, CASE WHEN min(k) < 2 THEN min(city) ELSE min(old) END AS city, CASE WHEN min(k) < 2 THEN min(region) END AS region,
  CASE WHEN min(k) = 0 THEN 'Canada' ELSE 'United States' END AS country FROM v GROUP BY scope_id, who)"""


def _place_mentions(spark, sf_dir):
    city, region, k = F.concat("ln", F.lit("burg")), F.concat("fn", F.lit("ia")), F.col("o_orderkey") % 4
    form = F.when(k == 0, F.concat_ws(", ", city, region, F.lit("Canada"))).when(k == 1, F.concat_ws(", ", city, region)).when(k == 2, city).otherwise(region)
    return _people(spark, sf_dir).select("scope_id", _key(), F.lit("LOCATION").alias("type"), "who", form.alias("old"), city.alias("city"), "o_orderkey")


def _site_mentions(spark, sf_dir):
    """Sites of each scope: after a city, or with a number of three digits."""
    places, k, number = _place_mentions(spark, sf_dir), F.col("o_orderkey") % 3, (F.col("o_orderkey") % 40 + 100).cast("string")
    form = F.when(k == 0, F.concat(F.lit("North "), "city", F.lit(" Memorial Hospital"))).when(k == 1, F.concat(F.lit("the "), "city", F.lit(" site"))).otherwise(F.concat(F.lit("Site "), number))
    return places.select("scope_id", "key", F.lit("SITE").alias("type"), F.concat(F.lit("S"), F.col("who")).alias("who"), form.alias("old"))


_S_SQL = """, s AS (SELECT scope_id, 'S' || who AS who, CASE o_orderkey % 3 WHEN 0 THEN 'North ' || city || ' Memorial Hospital' WHEN 1 THEN 'the ' || city || ' site' ELSE 'Site ' || (o_orderkey % 40 + 100) END AS old FROM v)"""


@query(f"WITH {_Z_SQL} SELECT * FROM z")
def place_profiles(spark, sf_dir):
    """City, region and country of each place, by its longest form."""
    return profiles.places(_forms(_place_mentions(spark, sf_dir)))


@query(f"""WITH {_Z_SQL}{_S_SQL}, n AS (SELECT DISTINCT scope_id, who, old FROM s WHERE old NOT LIKE 'Site %')
SELECT scope_id, n.who AS who, min_by(z.city, (-length(z.city), z.city)) AS city FROM n JOIN z USING (scope_id)
WHERE contains(' ' || old || ' ', ' ' || z.city || ' ') GROUP BY scope_id, n.who""")
def site_cities(spark, sf_dir):
    """The city of the scope that stands in a site's name: runs of words meet cities."""
    located = profiles.places(_forms(_place_mentions(spark, sf_dir)))
    return profiles.sites(_forms(_site_mentions(spark, sf_dir)), located)[1].select("scope_id", "who", "city")


@query(f"""WITH {_Z_SQL}{_S_SQL}, c AS (SELECT scope_id, count(DISTINCT city) AS n FROM z GROUP BY scope_id),
d AS (SELECT DISTINCT scope_id, who, old FROM s), e AS (SELECT DISTINCT d.scope_id, d.who, d.old FROM d JOIN z ON d.scope_id = z.scope_id AND contains(' ' || old || ' ', ' ' || z.city || ' '))
SELECT scope_id, count(DISTINCT who) AS n_places, count(DISTINCT who) AS n_towns, (SELECT count(*) FROM e WHERE e.scope_id = v.scope_id) AS n_follow,
  (SELECT count(DISTINCT old) FROM d WHERE d.scope_id = v.scope_id AND old LIKE 'Site %') AS n_numbers FROM v GROUP BY scope_id""")
def site_surrogates(spark, sf_dir):
    """Each place has its own town, sites named after a city carry a town of their scope, numbers of sites stay three digits and apart."""
    mentions = _place_mentions(spark, sf_dir).select("scope_id", "key", "type", "who", "old").union(_site_mentions(spark, sf_dir))
    forms = _forms(mentions)
    new = profiles.surrogates(forms)
    towns = new.where("type = 'LOCATION'").select("scope_id", "who", F.split("old", ", ").alias("o"), F.split("new", ", ").alias("s"))
    located = profiles.places(forms).select("scope_id", "who", "city")
    towns = towns.join(located, ["scope_id", "who"]).where(F.get("o", F.lit(0)) == F.col("city")).select("scope_id", "who", F.get("s", F.lit(0)).alias("town")).distinct()
    site = new.where("type = 'SITE'")
    named = site.where("old not like 'Site %' and new <> old").select("scope_id", "who", "old", F.regexp_replace("new", "^(the|North) | (site|Memorial Hospital)$", "").alias("town"))
    follow = named.join(towns.select("scope_id", "town").distinct(), ["scope_id", "town"], "left_semi").groupBy("scope_id").agg(F.count("*").alias("n_follow"))
    numbers = site.where("old like 'Site %'").where(F.col("new").rlike(r"^Site [1-9]\d\d$") & (F.col("new") != F.col("old")))
    numbers = numbers.groupBy("scope_id").agg(F.countDistinct("new").alias("n_numbers"))
    by = towns.groupBy("scope_id").agg(F.countDistinct("who").alias("n_places"), F.countDistinct("town").alias("n_towns"))
    return by.join(follow, "scope_id", "left").join(numbers, "scope_id", "left").fillna(0, ["n_follow", "n_numbers"])


@query("""WITH w AS (SELECT DISTINCT p_size, unnest(string_split(p_name, ' ')) AS word FROM part)
SELECT a.p_size, a.word, b.word AS near FROM w a JOIN w b ON a.p_size = b.p_size AND levenshtein(a.word, b.word) <= 2""")
def near_words(spark, sf_dir):
    """Words of parts of one size within two edits of each other."""
    w = C._t(spark, sf_dir, "part").select("p_size", F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return similar.near(w, w, ["p_size"])


# Relative dates

_N_SQL = "CAST(o_orderkey % 45 - 22 AS INTEGER)"
_REL_SQL = C._O + f""", r AS (SELECT *, day - {_N_SQL} AS anchor, {_N_SQL} AS n FROM o),
y AS (SELECT *, abs(n) >= 14 AND abs(n) % 7 = 0 AS weeks, CASE WHEN abs(n) >= 14 AND abs(n) % 7 = 0 THEN abs(n) // 7 ELSE abs(n) END AS k FROM r),
f AS (SELECT *, CASE WHEN o_orderkey % 9 = 0 THEN 'Day ' || n WHEN o_orderkey % 9 = 1 THEN 'the following ' || dayname(day) WHEN o_orderkey % 9 = 2 THEN monthname(day)
  WHEN o_orderkey % 9 = 3 THEN day(day) || 'th ' || monthname(day) WHEN o_orderkey % 9 = 4 AND o_orderkey % 2 = 0 THEN 'one week before the first dose visit' ELSE
  concat_ws(' ', CASE WHEN k BETWEEN 1 AND 12 THEN {C._WORDS}[k] ELSE CAST(k AS VARCHAR) END, CASE WHEN weeks THEN 'week' ELSE 'day' END || CASE WHEN k = 1 THEN '' ELSE 's' END,
  CASE WHEN n < 0 THEN 'before' ELSE 'after' END, 'the', monthname(anchor), 'visit') END AS phrase FROM y)"""


def _phrases(spark, sf_dir):
    o = C._orders(spark, sf_dir)
    n, k = F.col("o_orderkey") % 45 - 22, F.col("o_orderkey")
    anchor = F.date_sub("day", n.cast("int"))
    phrase = (
        F.when(k % 9 == 0, F.concat(F.lit("Day "), n.cast("string"))).when(k % 9 == 1, F.concat(F.lit("the following "), dates.weekday_name(F.col("day"))))
        .when(k % 9 == 2, F.date_format("day", "MMMM")).when(k % 9 == 3, F.concat(F.dayofmonth("day").cast("string"), F.lit("th "), F.date_format("day", "MMMM")))
        .when((k % 9 == 4) & (k % 2 == 0), "one week before the first dose visit").otherwise(dates.prose_interval(n, anchor))
    )
    return o.select("o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("scope_id"), F.concat(F.lit("D"), "o_orderkey").alias("who"), "day", "shape", "shift", phrase.alias("phrase"))


@query(f"""WITH {_REL_SQL} SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'study_day' WHEN o_orderkey % 9 = 1 THEN 'weekday' WHEN o_orderkey % 9 IN (2, 3) THEN NULL ELSE 'prose' END AS kind,
  CAST(CASE WHEN o_orderkey % 9 = 0 THEN n WHEN o_orderkey % 9 IN (1, 2, 3) THEN NULL WHEN o_orderkey % 9 = 4 AND o_orderkey % 2 = 0 THEN -7 ELSE n END AS VARCHAR) AS days,
  CASE WHEN o_orderkey % 9 < 4 OR o_orderkey % 9 = 4 AND o_orderkey % 2 = 0 THEN NULL ELSE monthname(anchor) END AS month FROM f""")
def relative_kinds(spark, sf_dir):
    """What a phrase says: a study day, a weekday, a distance with or without a month, or nothing that can be read."""
    p = relative.classified(_phrases(spark, sf_dir).select("o_orderkey", "phrase"), "phrase")
    return p.select("o_orderkey", "kind", F.col("days").cast("string").alias("days"), "month")


@query(f"""WITH {_REL_SQL} SELECT o_orderkey, phrase AS old,
  CASE WHEN o_orderkey % 9 < 4 OR o_orderkey % 9 = 4 AND o_orderkey % 2 = 0 THEN phrase ELSE replace(phrase, monthname(anchor), monthname(anchor + shift)) END AS new,
  CASE WHEN o_orderkey % 9 IN (2, 3) THEN 'unparsed' WHEN o_orderkey % 9 < 4 OR o_orderkey % 9 = 4 AND o_orderkey % 2 = 0 THEN NULL ELSE 'month' END AS note FROM f""")
def relative_rendered(spark, sf_dir):
    """Phrases after their scope's shift: months follow the anchor, unread ones are reported."""
    p = _phrases(spark, sf_dir)
    written = p.select("scope_id", "who", dates.render_date(F.col("day"), F.col("shape")).alias("old"), F.lit(1).alias("n"), "shift")
    forms = written.unionByName(p.select("scope_id", "who", F.col("phrase").alias("old"), F.lit(1).alias("n"), "shift"))
    new = relative.rendered(forms)
    return p.select("o_orderkey", "scope_id", "who", F.col("phrase").alias("old")).join(new, ["scope_id", "who", "old"]).select("o_orderkey", "old", "new", "note")


# Refusals

_BAD_SQL = C._M + """, b AS (SELECT m.doc_id, scope_id, start, "end" + CASE WHEN m.doc_id % 13 = 0 THEN 100000000 ELSE m.doc_id % 7 END AS "end", CASE WHEN m.doc_id % 11 = 0 THEN 'PERSON' ELSE type END AS type, length(d.text) AS size
  FROM m JOIN d USING (doc_id)), r AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM b),
x AS (SELECT DISTINCT scope_id, doc_id, CASE WHEN type = 'PERSON' THEN 'unknown_type' WHEN "end" > size THEN 'out_of_range' WHEN start < reached THEN 'overlap' END AS reason FROM r)"""


@query(f"WITH {_BAD_SQL} SELECT reason, count(*) AS n_docs, count(DISTINCT scope_id) AS n_scopes FROM x WHERE reason IS NOT NULL GROUP BY reason")
def mention_problems(spark, sf_dir):
    """Documents and scopes that cannot be worked on, by reason."""
    docs = C._docs(spark, sf_dir)
    end = F.col("end") + F.when(F.col("doc_id") % 13 == 0, 100000000).otherwise(F.col("doc_id") % 7)
    marks = spans.mentions(docs).withColumn("end", end).withColumn("type", F.when(F.col("doc_id") % 11 == 0, "PERSON").otherwise(F.col("type")))
    return surrogates.problems(docs, marks).groupBy("reason").agg(F.count("*").alias("n_docs"), F.countDistinct("scope_id").alias("n_scopes"))


# Relocation

def _anchored(spark, sf_dir):
    """docs, mentions, and a list of anchors for each document, some of them one or a hundred occurrences too far."""
    docs = C._docs(spark, sf_dir).select("doc_id", "text")
    m = spans.mentions(docs)
    each = C._indexed(docs)

    def number(x):
        return C._own_number(x) + F.when(x["start"] % 11 == 0, 1).when(x["start"] % 13 == 0, 100).otherwise(0)

    anchors = F.transform("ms", lambda x: F.struct(x["text"].alias("text"), number(x).alias("n"), x["type"].alias("type"), x["entity_id"].alias("id")))
    return docs, m, each.select("doc_id", anchors.alias("mentions"))


@query(f"""WITH {C._PLACES_SQL}, a AS (SELECT m.doc_id, start, "end", type, text, places, list_position(places, start) + CASE WHEN start % 11 = 0 THEN 1 WHEN start % 13 = 0 THEN 100 ELSE 0 END AS n FROM m JOIN pl ON m.doc_id = pl.doc_id AND m.text = needle),
g AS (SELECT DISTINCT doc_id, start, "end", type FROM m), l AS (SELECT DISTINCT doc_id, places[n] AS start, places[n] + length(text) AS "end", type FROM a WHERE n <= len(places)),
u AS (SELECT type, count(*) AS n FROM (SELECT DISTINCT doc_id, text, n, type FROM a WHERE n > len(places)) GROUP BY type),
o AS (SELECT coalesce(g.type, l.type) AS type, CAST(g.type IS NOT NULL AND l.type IS NOT NULL AS INTEGER) AS tp, CAST(g.type IS NULL AS INTEGER) AS fp, CAST(l.type IS NULL AS INTEGER) AS fn
  FROM g FULL JOIN l ON g.doc_id = l.doc_id AND g.start = l.start AND g."end" = l."end" AND g.type = l.type),
x AS (SELECT type, {C._SUMS} FROM o GROUP BY type), w AS (SELECT type, tp, fp + coalesce(u.n, 0) AS fp, fn FROM x LEFT JOIN u USING (type)) SELECT type, {C._PRF} FROM w""")
def anchored_scores(spark, sf_dir):
    """Predictions by anchors against the mentions: what cannot be located is a false positive of its type."""
    docs, m, anchors = _anchored(spark, sf_dir)
    outcomes = relocate.anchored_outcomes(m.select("doc_id", "start", "end", "type"), relocate.located(docs, anchors))
    return metrics.scores(outcomes, "type")


_PARA_SQL = r"""regexp_replace(replace(d.text, ' the ', ' this '), '^([^ ]+) ', CASE doc_id % 4 WHEN 0 THEN '\1 now ' WHEN 1 THEN '' WHEN 2 THEN '' ELSE '\1 ' END) || CASE WHEN doc_id % 4 = 2 THEN ' ' || string_split(d.text, ' ')[1] ELSE '' END"""


@query(f"""WITH RECURSIVE {C._M}, nt AS MATERIALIZED (SELECT doc_id, text, {_PARA_SQL} AS new_text FROM d),
k AS MATERIALIZED (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS i FROM m),
ch AS (SELECT DISTINCT k.doc_id FROM k JOIN nt USING (doc_id) WHERE len(string_split(nt.text, k.text)) <> len(string_split(nt.new_text, k.text))),
f AS (SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS place, 0::HUGEINT AS total FROM (SELECT DISTINCT doc_id FROM k WHERE doc_id NOT IN (SELECT doc_id FROM ch))
  UNION ALL SELECT f.doc_id, f.i + 1, CASE WHEN p = 0 THEN -1 ELSE f.place + p - 1 + length(k.text) END, CASE WHEN p = 0 THEN 0 ELSE f.total + f.place + p - 1 END
  FROM (SELECT f.*, k.text AS needle, strpos(substr(nt.new_text, f.place + 1), k.text) AS p FROM f JOIN k ON k.doc_id = f.doc_id AND k.i = f.i + 1 JOIN nt ON nt.doc_id = f.doc_id WHERE f.place >= 0) f JOIN k ON k.doc_id = f.doc_id AND k.i = f.i + 1),
e AS (SELECT doc_id, arg_max(place, i) AS place, arg_max(total, i) AS total, max(i) AS n FROM f GROUP BY doc_id)
SELECT nt.doc_id, CASE WHEN nt.text IS NULL THEN 'no_text' WHEN ch.doc_id IS NOT NULL THEN 'count_changed' WHEN e.place < 0 THEN 'not_found' END AS reason,
  CASE WHEN nt.text IS NULL OR ch.doc_id IS NOT NULL OR e.place < 0 THEN -1 ELSE coalesce(e.n, 0) END AS n_mentions, CASE WHEN nt.text IS NULL OR ch.doc_id IS NOT NULL OR e.place < 0 THEN -1 ELSE CAST(coalesce(total, 0) AS BIGINT) END AS sum_start
FROM nt LEFT JOIN ch USING (doc_id) LEFT JOIN e USING (doc_id)""")
def ordered_relocation(spark, sf_dir):
    """Mentions found again, from left to right, in texts with a word more, less or moved to the end."""
    docs = C._docs(spark, sf_dir)
    k, first = F.col("doc_id") % 4, F.get(F.split("text", " "), F.lit(0))
    head = F.when(k == 0, "$1 now ").when(k.isin(1, 2), "").otherwise("$1 ")
    new = F.concat(F.regexp_replace(F.replace("text", F.lit(" the "), F.lit(" this ")), F.lit("^([^ ]+) "), head), F.when(k == 2, F.concat(F.lit(" "), first)).otherwise(""))
    records = pinned(docs.select("doc_id", "text", new.alias("new_text"), spans.listed("text").alias("mentions")))
    total = F.aggregate("new_mentions", F.lit(0).cast("long"), lambda a, m: a + m["start"])
    size = F.when(F.col("new_mentions").isNotNull(), F.size("new_mentions")).otherwise(-1).cast("long")
    return relocate.ordered(records).select("doc_id", "reason", size.alias("n_mentions"), F.coalesce(total, F.lit(-1)).alias("sum_start"))


# Receipts

_LEVELS = 2
_RC_SQL = C._M + """, dh AS (SELECT scope_id, d.doc_id, sha256(to_json({'doc_id': CAST(d.doc_id AS VARCHAR), 'mentions': coalesce(list({'start': start, 'end': "end", 'type': type, 'entity_id': entity_id} ORDER BY start) FILTER (start IS NOT NULL), []), 'text': any_value(d.text)})) AS h
  FROM d LEFT JOIN m USING (doc_id) GROUP BY scope_id, d.doc_id),
bl AS (SELECT scope_id, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 2) AS block, count(*) AS n, sha256(string_agg(h, ',' ORDER BY doc_id)) AS h FROM dh GROUP BY ALL),
sc AS (SELECT scope_id, CAST(sum(n) AS BIGINT) AS n_docs, sha256(string_agg(h, ',' ORDER BY block)) AS digest FROM bl GROUP BY scope_id)"""


def _marked(spark, sf_dir):
    marks = F.transform(spans.listed("text"), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["type"].alias("type"), m["entity_id"].alias("entity_id")))
    return C._docs(spark, sf_dir).select("scope_id", "doc_id", "text", marks.alias("mentions"))


@query(f"WITH {_RC_SQL} SELECT * FROM sc")
def scope_document_hashes(spark, sf_dir):
    """Scope hashes over ids, texts and mentions of documents."""
    return receipts.document_hashes(_marked(spark, sf_dir))


@query(f"""WITH {_RC_SQL}, l2 AS (SELECT substr(sha256(scope_id), 1, 2) AS node, sha256(string_agg(sha256(scope_id) || ':' || digest, ',' ORDER BY sha256(scope_id))) AS h FROM sc GROUP BY 1),
l1 AS (SELECT substr(node, 1, 1) AS node, sha256(string_agg(node || ':' || h, ',' ORDER BY node)) AS h FROM l2 GROUP BY 1)
SELECT (SELECT count(*) FROM sc) AS n_leaves, sha256(string_agg(node || ':' || h, ',' ORDER BY node)) AS root FROM l1""")
def receipt_tree_root(spark, sf_dir):
    """The root of the hash tree over all scopes."""
    hashes = receipts.document_hashes(_marked(spark, sf_dir))
    return hashtree.root(hashes.select(F.col("scope_id").alias("key"), F.col("digest").alias("hash")), _LEVELS)


@query(f"""WITH {_RC_SQL}, x AS (SELECT scope_id, CASE WHEN min(doc_id) % 5 = 1 THEN 'text' WHEN min(doc_id) % 5 = 2 THEN 'lost' WHEN min(doc_id) % 5 = 3 THEN 'proof' END AS tampered FROM d GROUP BY scope_id),
y AS (SELECT scope_id, CASE WHEN tampered = 'lost' THEN 'no_output' WHEN tampered = 'text' THEN 'output' WHEN tampered = 'proof' THEN 'proof' END AS fault FROM x)
SELECT fault, count(*) AS n_scopes, min(scope_id) AS first_scope FROM y WHERE fault IS NOT NULL GROUP BY fault""")
def tampered_scopes(spark, sf_dir):
    """Signed receipts of all scopes against outputs and receipts of which some were changed: every such scope is named."""
    docs = _marked(spark, sf_dir)
    signer, policy = receipts.Signer(spark), {"min_weeks": 4}
    report = docs.groupBy("scope_id").agg(F.count("*").alias("n_docs"))
    proved, run = receipts.sign_scopes(receipts.scope_receipts(docs, docs, report, policy), signer, policy, keyed.TEST_KEY)
    kinds = docs.groupBy("scope_id").agg((F.min("doc_id") % 5).alias("k"))
    after = docs.join(kinds, "scope_id").where("k <> 2").withColumn("text", F.when(F.col("k") == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("x"))).otherwise(F.col("text")))
    changed = F.replace("payload", F.lit('"n_docs"'), F.lit('"n"'))
    proved = proved.join(kinds, "scope_id").withColumn("payload", F.when(F.col("k") == 3, changed).otherwise(F.col("payload"))).withColumn("hash", F.sha2("payload", 256))
    faults = receipts.verify_scopes(spark, proved, run, after.drop("k"), policy, signer.public_hex)[1]
    return faults.groupBy("fault").agg(F.count("*").alias("n_scopes"), F.min("scope_id").alias("first_scope"))
