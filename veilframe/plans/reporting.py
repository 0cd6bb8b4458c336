"""Queries of reports, evaluations, training rows and differences of runs, each next to its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.functions import text as T
from veilframe.operators import metrics, reports, spans
from veilframe.plans import catalogue as C
from veilframe.plans import identities as I
from veilframe.sources import corpus_plan, files

query = C.query

_WORDS_SQL = r"len(regexp_extract_all(text, '\S+'))"


@query(f"""WITH {C._M}, x AS (SELECT text, source, lang, {_WORDS_SQL} AS n FROM documents),
c AS (SELECT 'source' AS section, source AS item FROM x UNION ALL SELECT 'lang', lang FROM x
  UNION ALL SELECT 'words', (n // 50 * 50) || '-' || (n // 50 * 50 + 49) FROM x
  UNION ALL SELECT 'characters', (length(text) // 1000 * 1000) || '-' || (length(text) // 1000 * 1000 + 999) FROM x
  UNION ALL SELECT 'mention type', type FROM m
  UNION ALL SELECT 'mentions of an entity', CAST(least(n, 12) AS VARCHAR) FROM (SELECT count(*) AS n FROM m GROUP BY doc_id, entity_id))
SELECT section, item, count(*) AS n FROM c WHERE item IS NOT NULL GROUP BY ALL""")
def corpus_report(spark, sf_dir):
    """What the documents hold: sources, languages, lengths, mentions by type and by entity."""
    docs = C._t(spark, sf_dir, "documents")
    m = spans.mentions(C._docs(spark, sf_dir))
    size = F.length("text")
    found = reports.tally(docs, {
        "source": F.col("source"), "lang": F.col("lang"), "words": reports.binned(T.word_count(F.col("text")), 50), "characters": reports.binned(size, 1000),
    })
    each = m.groupBy("doc_id", "entity_id").agg(F.least(F.count("*"), F.lit(12)).alias("n"))
    return found.unionByName(reports.tally(m, {"mention type": F.col("type")})).unionByName(reports.tally(each, {"mentions of an entity": F.col("n")}))


@query(f"""WITH x AS (SELECT doc_id, {_WORDS_SQL} AS n_words, n_chars, lang FROM documents),
f AS (SELECT 'short' AS gate, doc_id, n_words FROM x WHERE n_words < 20 UNION ALL SELECT 'long', doc_id, n_words FROM x WHERE n_words > 1000 UNION ALL SELECT 'no language', doc_id, n_words FROM x WHERE lang IS NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY gate ORDER BY doc_id, n_words) AS place FROM f) SELECT gate, place, doc_id, CAST(n_words AS BIGINT) AS n_words FROM p WHERE place <= {reports.SHOWN}""")
def gate_failures(spark, sf_dir):
    """The first documents that fail each gate of length and language."""
    docs = C._t(spark, sf_dir, "documents").withColumn("n_words", T.word_count(F.col("text")).cast("long"))
    failed = F.array_compact(F.array(F.when(F.col("n_words") < 20, "short"), F.when(F.col("n_words") > 1000, "long"), F.when(F.col("lang").isNull(), "no language")))
    failures = docs.select("doc_id", "n_words", F.explode(failed).alias("gate"))
    return reports.first_failures(failures, "gate", "doc_id", "n_words").select("gate", F.col("place").cast("long").alias("place"), "doc_id", "n_words")


# Documents whose number ends in 3 have an output that is cut off, those in 7 none.

_EV_SQL = f"""{C._PLACES_SQL}, sl AS (SELECT doc_id, unnest(list_distinct(['all', coalesce(source, 'all')])) AS slice FROM documents),
a AS (SELECT m.doc_id, start, "end", type, text, entity_id, places, list_position(places, start) + CASE WHEN start % 11 = 0 THEN 1 WHEN start % 13 = 0 THEN 100 ELSE 0 END AS n
  FROM m JOIN pl ON m.doc_id = pl.doc_id AND m.text = needle WHERE m.doc_id % 10 NOT IN (3, 7)),
g AS (SELECT DISTINCT doc_id, start, "end", type FROM m), l AS (SELECT DISTINCT doc_id, places[n] AS start, places[n] + length(text) AS "end", type FROM a WHERE n <= len(places)),
o AS (SELECT coalesce(g.doc_id, l.doc_id) AS doc_id, coalesce(g.type, l.type) AS type, CAST(g.type IS NOT NULL AND l.type IS NOT NULL AS INTEGER) AS tp, CAST(g.type IS NULL AS INTEGER) AS fp, CAST(l.type IS NULL AS INTEGER) AS fn
  FROM g FULL JOIN l ON g.doc_id = l.doc_id AND g.start = l.start AND g."end" = l."end" AND g.type = l.type
  UNION ALL SELECT doc_id, type, 0, 1, 0 FROM (SELECT DISTINCT doc_id, text, n, type FROM a WHERE n > len(places)))"""


def _evaluation(spark, sf_dir):
    anchors = I._anchored(spark, sf_dir)[2]
    k = F.col("doc_id") % 10
    answers = anchors.where(k != 7).withColumn("raw_output", F.when(k == 3, F.lit('{"mentions":[')).otherwise(F.to_json(F.struct("mentions"))))
    gold = C._t(spark, sf_dir, "documents").select("doc_id", "text", spans.listed("text").alias("mentions"), F.array("source").alias("slices"))
    return reports.evaluate(gold, answers.select("doc_id", "raw_output", (k != 9).alias("finished")), "anchors")


@query(f"WITH {_EV_SQL}, x AS (SELECT slice, type, {C._SUMS} FROM o JOIN sl USING (doc_id) GROUP BY ALL) SELECT slice, type, {C._PRF} FROM x")
def evaluation_scores(spark, sf_dir):
    """Span scores of outputs by slice and type; outputs that are cut off or lacking miss everything."""
    return _evaluation(spark, sf_dir).scores("type")


@query(f"""WITH {_EV_SQL}, n AS (SELECT doc_id, count(*) AS p, count_if(n > len(places)) AS u FROM a GROUP BY doc_id)
SELECT slice, count(*) AS samples, count_if(doc_id % 10 IN (3, 7)) AS malformed, count_if(doc_id % 10 = 9) AS unfinished, CAST(sum(coalesce(p, 0)) AS BIGINT) AS n_predicted, CAST(sum(coalesce(u, 0)) AS BIGINT) AS n_unlocatable
FROM sl LEFT JOIN n USING (doc_id) GROUP BY slice""")
def evaluation_samples(spark, sf_dir):
    """Samples of each slice: void, unfinished, mentions predicted and unlocatable."""
    return _evaluation(spark, sf_dir).counts()


@query(f"""WITH {_EV_SQL}, q AS (SELECT doc_id, places[n] AS start, places[n] + length(text) AS "end", type, min(entity_id) AS id FROM a WHERE n <= len(places) GROUP BY ALL),
j AS (SELECT m.doc_id, m.entity_id, q.id FROM m LEFT JOIN q ON m.doc_id = q.doc_id AND m.start = q.start AND m."end" = q."end" AND m.type = q.type),
w AS (SELECT doc_id, id, count(DISTINCT entity_id) AS owners FROM j WHERE id IS NOT NULL GROUP BY ALL),
e AS (SELECT j.doc_id, entity_id, count_if(j.id IS NULL) AS missing, count(DISTINCT j.id) AS ids, max(owners) AS owners FROM j LEFT JOIN w ON j.doc_id = w.doc_id AND j.id = w.id GROUP BY ALL)
SELECT slice, CASE WHEN missing > 0 THEN 'incomplete' WHEN ids > 1 THEN 'split' WHEN owners > 1 THEN 'merged' ELSE 'consistent' END AS verdict, count(*) AS n FROM e JOIN sl USING (doc_id) GROUP BY ALL""")
def evaluation_entities(spark, sf_dir):
    """Entities of each slice by verdict."""
    return _evaluation(spark, sf_dir).entities()


def _training(spark, sf_dir):
    d, k = C._t(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(
        F.lpad(k.cast("string"), 12, "0").alias("sample_id"), F.when(k % 17 == 0, "v1").otherwise("v2").alias("instruction_version"),
        F.when(k % 13 == 0, "Mark names").otherwise("Mark all").alias("instruction"), F.col("text").alias("input"), F.when(k % 19 != 0, F.lit("{}")).alias("output"),
    )


@query("""WITH x AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS sample_id, CASE WHEN text IS NULL OR doc_id % 19 = 0 THEN 'missing_key' WHEN doc_id % 17 = 0 THEN 'other_version' WHEN doc_id % 13 = 0 THEN 'other_instruction' END AS problem FROM documents)
SELECT problem, count(*) AS n, min(sample_id) AS first_id FROM x WHERE problem IS NOT NULL GROUP BY problem""")
def training_problems(spark, sf_dir):
    """Rows that keep a training file from being used."""
    return files.training_problems(_training(spark, sf_dir), "v2")


def _second(outputs):
    k = F.col("doc_id")
    kept = outputs.where(k % 23 != 0).withColumn("raw_output", F.when(k % 7 == 0, F.concat("raw_output", F.lit(" "))).when(k % 11 == 0, F.lit(None)).otherwise(F.col("raw_output")))
    return kept.unionByName(outputs.where(k % 29 == 0).withColumn("doc_id", -k - 1))


@query("""WITH a AS (SELECT doc_id, text AS raw FROM documents),
b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN raw || ' ' WHEN doc_id % 11 = 0 THEN NULL ELSE raw END AS raw FROM a WHERE doc_id % 23 <> 0 UNION ALL SELECT -doc_id - 1, raw FROM a WHERE doc_id % 29 = 0),
x AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'lost' WHEN a.doc_id IS NULL THEN 'added' WHEN a.raw IS DISTINCT FROM b.raw THEN 'changed' END AS difference FROM a FULL JOIN b ON a.doc_id = b.doc_id)
SELECT doc_id, difference FROM x WHERE difference IS NOT NULL""")
def run_differences(spark, sf_dir):
    """Outputs that a second run changed, lost or added."""
    outputs = C._t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw_output"))
    return reports.run_differences(outputs, _second(outputs))


@query("""WITH h AS (SELECT sha256(CAST(doc_id AS VARCHAR)) AS place, sha256(coalesce('=' || text, '')) AS h FROM documents),
l2 AS (SELECT substr(place, 1, 2) AS node, sha256(string_agg(place || ':' || h, ',' ORDER BY place)) AS h FROM h GROUP BY 1),
l1 AS (SELECT substr(node, 1, 1) AS node, sha256(string_agg(node || ':' || h, ',' ORDER BY node)) AS h FROM l2 GROUP BY 1)
SELECT (SELECT count(*) FROM documents) AS n_leaves, sha256(string_agg(node || ':' || h, ',' ORDER BY node)) AS root FROM l1""")
def run_digest(spark, sf_dir):
    """One digest of a run's outputs, whatever their order."""
    return reports.run_digest(C._t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw_output")), 2)


# The plan of a corpus


def _of(name: str, column: str) -> str:
    return C._bits(C._hmac(f"'{name}' || {column}"))


def _turn(cycle) -> str:
    return f"[{', '.join(map(repr, cycle))}][nth % {len(cycle)} + 1]"


_SHARES = ", ".join(f"({i}, '{name}', {share})" for i, (name, share) in enumerate(corpus_plan.SHARES))
_WANTED = {name: f"hard * {part} // 100" for name, part in corpus_plan.HARD_PARTS}
_WANTED["bundle_listing"] = "hard - " + " - ".join(f"({x})" for x in _WANTED.values())
_HARD_SQL = " ".join(f"WHEN slice = '{name}' AND nth < {_WANTED[name]} THEN {_turn(cycle)}" for name, cycle in corpus_plan.CYCLES.items())


@query(f"""WITH t AS (SELECT count(*) AS n, CAST(round_even(count(*) * {corpus_plan.HARD_SHARE} / 100, 0) AS BIGINT) AS hard FROM documents),
s AS (SELECT i, name, n * share // 100 AS base, n * share % 100 AS rest, n, share FROM t, (VALUES {_SHARES}) v(i, name, share)),
b AS (SELECT i, name, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, i) <= n - sum(base) OVER () THEN 1 ELSE 0 END AS c FROM s),
o AS (SELECT i, name, CASE name WHEN 'bundle' THEN c - c % 2 WHEN 'single' THEN c + (SELECT c % 2 FROM b WHERE name = 'bundle') ELSE c END AS c FROM b),
r AS (SELECT name AS kind, CAST(sum(c) OVER (ORDER BY i) - c AS BIGINT) AS low, CAST(sum(c) OVER (ORDER BY i) AS BIGINT) AS high FROM o),
k AS (SELECT doc_id AS id, row_number() OVER (ORDER BY {C._hmac("'slot' || doc_id")}) - 1 AS slot FROM documents),
e AS (SELECT id, slot, kind, CASE WHEN kind = 'bundle' THEN (slot - low) // 2 END AS bundle_no, CASE WHEN kind <> 'bundle' THEN kind WHEN (slot - low) % 2 = 1 THEN 'bundle_listing' ELSE 'bundle_narrative' END AS slice,
  CASE WHEN kind = 'bundle' THEN (slot - low) // 2 ELSE slot - low END AS nth FROM k JOIN r ON slot >= low AND slot < high),
p AS (SELECT *, CAST(CASE kind WHEN 'single' THEN 1 WHEN 'multi' THEN CASE WHEN {_of('three', 'slot')} % 100 < {corpus_plan.THREE_SHARE} THEN 3 ELSE 2 END
  WHEN 'bundle' THEN CASE WHEN {_of('two', 'bundle_no')} % 100 < 30 THEN 2 ELSE 1 END ELSE 0 END AS BIGINT) AS n_patients FROM e),
x AS (SELECT p.*, CAST(CASE WHEN kind = 'listing' THEN 5 + {_of('rows', 'slot')} % 16 WHEN slice = 'bundle_listing' THEN n_patients + 4 + {_of('rows', 'slot')} % 9 ELSE 0 END AS BIGINT) AS listing_rows,
  CASE {_HARD_SQL} END AS hard_kind, row_number() OVER (ORDER BY CASE WHEN kind = 'bundle' THEN {C._hmac("'pair' || bundle_no")} ELSE {C._hmac("'unit' || slot")} END, slot) - 1 AS doc_index FROM p, t)
SELECT id, slice, n_patients, 'b' || bundle_no AS bundle_id, listing_rows, hard_kind, doc_index, row_number() OVER (PARTITION BY slice, n_patients ORDER BY doc_index) - 1 AS template_hint FROM x""")
def sample_plan(spark, sf_dir):
    """The plan of a corpus with as many samples as there are documents."""
    plan = corpus_plan.plan(C._t(spark, sf_dir, "documents"), "doc_id")
    return plan.withColumn("bundle_no", F.concat(F.lit("b"), F.col("bundle_no").cast("string"))).withColumnRenamed("bundle_no", "bundle_id")
