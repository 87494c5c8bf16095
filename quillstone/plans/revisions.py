"""Named queries over revised documents: clause changes and their summaries, each beside its SQL.

The revised text of a document drops every fifth line, adds a word to every fifth, and keeps the others; an amendment has
one more clause, which says what it amends.  The SQL derives the changes from the lines' places.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import changes as C
from quillstone.plans.catalogue import query
from quillstone.sources import policy as P
from quillstone.sources.policy import POL
from quillstone.sources.tables import spread

RELATIONS = "verified = 1 and relation_type in ('SUPERSEDES', 'AMENDS') and target_doc_id is not null"
AMENDED = "regexp_extract(scope, '[0-9]+[.][0-9]+')"


def revised_pairs(spark, folder):
    """(pair, id, new_id, scope, evidence, relation_type, amended): verified relations; every second one has its sentence as evidence."""
    amended = F.regexp_extract("scope", r"\d+\.\d+", 0)
    sentence = F.concat_ws(" ", F.lit("perenggan"), F.nullif(amended, F.lit("")), F.lit("adalah dipinda"))
    rows = P.policy_relations(spark, folder).where(RELATIONS)
    return rows.select(F.col("id").alias("pair"), F.col("target_doc_id").alias("id"), F.col("source_doc_id").alias("new_id"), "scope", "relation_type", sentence.alias("sentence"), F.when(F.col("id") % 2 == 0, sentence).alias("evidence"))


def revised_texts(spark, folder):
    """(pair, old, new): numbered clauses of the old document, and as revised."""
    lines = F.expr("transform(filter(split(text, '[.\\n]'), x -> trim(x) <> ''), x -> trim(x))")
    docs = spread(P.policy_documents(spark, folder).select("id", "text")).select("id", lines.alias("l"))
    section = lambda i: (i / 6 + 1).cast("int").cast("string")

    def text(line):
        def row(x, i):
            body = line(F.concat(F.lit("fasal "), x), i)
            numbered = F.when(i % 9 == 8, F.concat(F.lit("(a) "), body)).otherwise(F.concat(section(i), F.lit("."), (i % 6 + 1).cast("string"), F.lit(" "), body))
            rows = F.when(body.isNull(), F.array().cast("array<string>")).otherwise(F.array(numbered))
            return F.when(i % 6 == 0, F.concat(F.array(F.concat(section(i), F.lit(". TUJUAN DAN PEMAKAIAN"))), rows)).otherwise(rows)

        return F.array_join(F.flatten(F.transform("l", row)), "\n")

    old = docs.select("id", text(lambda body, i: body).alias("old"), text(lambda body, i: F.when(i % 5 == 2, F.concat(body, F.lit(" baharu"))).when(i % 5 != 1, body)).alias("new"))
    rows = revised_pairs(spark, folder).join(old, "id")
    more = F.when(F.col("relation_type") == "AMENDS", F.concat(F.lit("\n99.9 "), F.col("sentence"))).otherwise("")
    return rows.select("pair", "old", F.concat("new", more).alias("new"), "scope", "evidence", "relation_type")


def revised_clauses(spark, folder):
    rows = revised_texts(spark, folder)
    old, new = rows.select(F.col("pair").alias("id"), F.col("old").alias("text")), rows.select(F.col("pair").alias("id"), F.col("new").alias("text"))
    scopes = C.scope_pairs(rows.where("relation_type = 'AMENDS'").select("pair", "scope", "evidence"), new)
    return C.placed(C.clause_changes(old, new, scopes))


REVISED = POL + f""", rl AS (SELECT id AS pair, target_doc_id AS doc, source_doc_id AS new_doc, relation_type, {AMENDED} AS amended FROM pr WHERE {RELATIONS}),
ln AS (SELECT id AS doc, unnest(list_transform(l, lambda x, k: {{'i': k - 1, 'x': 'fasal ' || x}}), recursive := true) FROM (SELECT id, list_filter(list_transform(string_split_regex(text, '[.\\n]'), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM pd)),
cl AS (SELECT doc, i, (i // 6 + 1) || '.' || (i % 6 + 1) AS ref, x FROM ln WHERE i % 9 <> 8 AND i // 6 < 99),
plain AS (SELECT * FROM rl WHERE relation_type = 'SUPERSEDES' OR amended = ''),
df AS (SELECT pair, ref AS clause_old, CASE WHEN i % 5 = 2 THEN ref END AS clause_new, CASE WHEN i % 5 = 2 THEN 'CHANGED' ELSE 'REMOVED' END AS kind, x AS old_text, CASE WHEN i % 5 = 2 THEN x || ' baharu' ELSE '' END AS new_text,
  CASE WHEN i % 5 = 2 THEN '= ' || array_to_string(list_filter(string_split_regex(x, '\\s+'), lambda w: w <> ''), ' ') || '|+ baharu' ELSE '' END AS inline FROM plain JOIN cl USING (doc) WHERE i % 5 IN (1, 2)
 UNION ALL SELECT pair, NULL, '99.9', 'ADDED', '', 'perenggan adalah dipinda', '' FROM plain WHERE relation_type = 'AMENDS' AND doc IN (SELECT id FROM pd WHERE text IS NOT NULL)
 UNION ALL SELECT pair, amended, '99.9', 'CHANGED', x, 'perenggan ' || amended || ' adalah dipinda', '- ' || array_to_string(list_filter(string_split_regex(x, '\\s+'), lambda w: w <> ''), ' ') || '|+ perenggan ' || amended || ' adalah dipinda' FROM rl JOIN cl ON cl.doc = rl.doc AND cl.ref = amended WHERE relation_type = 'AMENDS'),
dp AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY list_transform(string_split(COALESCE(clause_new, clause_old), '.'), lambda n: CAST(n AS INTEGER)), clause_old IS NULL) AS place FROM df)"""


@query(REVISED + " SELECT pair, place, clause_old, clause_new, kind, old_text, new_text, inline FROM dp")
def clause_diff(spark, folder):
    return revised_clauses(spark, folder).withColumn("inline", F.array_join("inline", "|"))


@query(REVISED + """, li AS (SELECT pair, count(*) AS n, string_agg(COALESCE(clause_new, clause_old), ', ' ORDER BY place) AS listed FROM dp GROUP BY 1)
SELECT rl.pair, COALESCE(n, 0) AS n_changes, s.circular_no || ' mengubah perenggan ' || COALESCE(listed, '-') || ' berbanding ' || t.circular_no || '.' AS summary_ms,
 s.circular_no || ' changes paragraphs ' || COALESCE(listed, '-') || ' compared with ' || t.circular_no || '.' AS summary_en FROM rl LEFT JOIN li USING (pair) JOIN pd s ON s.id = new_doc JOIN pd t ON t.id = rl.doc WHERE rl.pair % 6 <> 0""")
def change_summaries(spark, folder):
    """Every sixth pair has its summary already."""
    number = P.policy_documents(spark, folder).select("id", "circular_no")
    rows = revised_pairs(spark, folder)
    pairs = rows.join(number.withColumnRenamed("circular_no", "old_no"), "id").join(number.toDF("new_id", "new_no"), "new_id").select("pair", "old_no", "new_no")
    return C.change_summaries(revised_clauses(spark, folder), pairs, rows.where("pair % 6 = 0").select("pair"))
