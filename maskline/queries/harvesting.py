"""Queries over identifiers and terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskline.functions import text as t
from maskline.operators import checks
from maskline.operators import identifiers as ids
from maskline.queries import duck as d
from maskline.queries.base import Tables, query

KEYED = f"keyed AS (SELECT *, {d.key('account_num')} AS key FROM ledger WHERE trim(account_num) <> '')"
COUNTS = "counts AS (SELECT key, institution, count(*) AS n, sum(CASE WHEN is_primary THEN 1 ELSE 0 END) AS n_primary FROM keyed WHERE institution <> '' GROUP BY key, institution)"


@query(
    """SELECT key, array_to_string(list_sort(list(DISTINCT account_num)), '|') AS forms, coalesce(array_to_string(list_sort(list(DISTINCT account) FILTER (account <> '')), '|'), '') AS names,
 CAST(count(*) AS BIGINT) AS n_records, CAST(sum(CASE WHEN is_primary THEN 1 ELSE 0 END) AS BIGINT) AS n_primary FROM keyed GROUP BY key""",
    "ledger", KEYED,
)
def account_identifiers(db: Tables) -> DataFrame:
    got = ids.account_identifiers(db.ledger)
    return got.select("key", F.array_join("forms", "|").alias("forms"), F.array_join("names", "|").alias("names"), "n_records", "n_primary")


@query(
    """SELECT key, kind, value, count(*) AS n, CAST(sum(CASE WHEN is_primary THEN 1 ELSE 0 END) AS BIGINT) AS n_primary
 FROM (SELECT key, is_primary, 'form' AS kind, account_num AS value FROM keyed UNION ALL SELECT key, is_primary, 'name', account FROM keyed) WHERE value <> '' GROUP BY 1, 2, 3""", "ledger", KEYED,
)
def identifier_counts(db: Tables) -> DataFrame:
    return ids.identifier_counts(db.ledger)


@query(
    """SELECT k.key, n_forms, n_names, n_records, n_primary, coalesce(names, '') AS names FROM (SELECT key, count(DISTINCT account_num) AS n_forms, count(DISTINCT account) FILTER (account <> '') AS n_names, count(*) AS n_records, CAST(sum(CASE WHEN is_primary THEN 1 ELSE 0 END) AS BIGINT) AS n_primary FROM keyed GROUP BY key) k
 LEFT JOIN (SELECT key, string_agg(account, '|' ORDER BY n DESC, account) AS names FROM (SELECT key, account, count(*) AS n, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, account) AS r FROM keyed WHERE account <> '' GROUP BY key, account) WHERE r <= 3 GROUP BY key) s ON s.key = k.key""", "ledger", KEYED,
)
def account_summary(db: Tables) -> DataFrame:
    got = ids.account_summary(db.ledger)
    return got.withColumn("names", F.array_join("names", "|"))


@query(
    """SELECT key, institution FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n_primary > 0 DESC, CASE WHEN n_primary > 0 THEN n_primary ELSE n END DESC, institution) AS k FROM counts) WHERE k = 1""",
    "ledger", f"{KEYED}, {COUNTS}",
)
def canonical_institution(db: Tables) -> DataFrame:
    return ids.canonical_institutions(db.ledger)


@query("SELECT key, count(*) AS n_institutions FROM counts GROUP BY key HAVING count(*) > 1", "ledger", f"{KEYED}, {COUNTS}")
def institution_conflicts(db: Tables) -> DataFrame:
    return ids.institution_conflicts(db.ledger)




@query(
    "SELECT DISTINCT account FROM thin WHERE account <> '' AND account_num = '' AND account NOT IN (SELECT account FROM thin WHERE account_num <> '')",
    "ledger", "thin AS (SELECT account, CASE WHEN length(account) % 3 = 0 THEN '' ELSE account_num END AS account_num FROM ledger)",
)
def name_only_accounts(db: Tables) -> DataFrame:
    thin = db.ledger.withColumn("account_num", F.when(F.length("account") % 3 == 0, "").otherwise(F.col("account_num")))
    return ids.name_only_accounts(thin)


@query(
    f"""SELECT DISTINCT category, value FROM (SELECT 'run' AS category, unnest({d.runs('description')}) AS value FROM ledger UNION ALL SELECT 'code', unnest({d.codes('description')}) FROM ledger
 UNION ALL SELECT 'account_name', account FROM ledger UNION ALL SELECT 'account_num', account_num FROM ledger
 UNION ALL SELECT 'last_four', lpad({d.key('account_num')}, 4, '0') FROM ledger WHERE regexp_matches({d.key('account_num')}, '^[0-9]+$')) WHERE value <> ''""",
    "ledger",
)
def identifier_inventory(db: Tables) -> DataFrame:
    return ids.inventory(db.ledger)


HARVEST = f"""harvest AS (SELECT DISTINCT category, trim(value) AS value FROM (
 SELECT 'name' AS category, term AS value FROM terms WHERE category = 'Names' UNION ALL SELECT 'town', term FROM terms WHERE category = 'Towns'
 UNION ALL SELECT 'account_name', account FROM accounts UNION ALL SELECT 'account_name', account FROM ledger UNION ALL SELECT 'account_num', account_num FROM accounts UNION ALL SELECT 'account_num', account_num FROM ledger
 UNION ALL SELECT 'account_num', bank1 FROM properties UNION ALL SELECT 'entity', trim(regexp_extract(unique_account_identifier, '^(.*?) - (\\S+) \\(([^)]+)\\)\\s*$', 3)) FROM accounts
 UNION ALL SELECT 'property', prop FROM properties UNION ALL SELECT 'llc', llc FROM properties UNION ALL SELECT 'address', address FROM properties) WHERE trim(value) <> '')"""


def harvested(db: Tables) -> DataFrame:
    terms, accounts, ledger, places = db.terms, db.accounts, db.ledger, db.properties
    return ids.harvest({
        "name": (terms.where("category = 'Names'"), F.col("term")), "town": (terms.where("category = 'Towns'"), F.col("term")),
        "account_name/1": (accounts, F.col("account")), "account_name/2": (ledger, F.col("account")), "account_num/1": (accounts, F.col("account_num")), "account_num/2": (ledger, F.col("account_num")),
        "account_num/3": (places, F.col("bank1")), "entity": (accounts, t.compound_parts(F.col("unique_account_identifier"))["code"]),
        "property": (places, F.col("prop")), "llc": (places, F.col("llc")), "address": (places, F.col("address")),
    })


@query("SELECT category, value FROM harvest", "terms accounts ledger properties", HARVEST)
def harvest(db: Tables) -> DataFrame:
    return harvested(db)


@query("SELECT category, lower(term) AS key, min(term) AS term FROM (SELECT * FROM terms UNION ALL SELECT category, upper(term) FROM terms) GROUP BY 1, 2", "terms")
def term_representatives(db: Tables) -> DataFrame:
    terms = db.terms
    return ids.representatives(terms.union(terms.select("category", F.upper("term"))))


@query("SELECT category, count(*) AS n_terms, count(DISTINCT lower(term)) AS n_distinct, count(*) - count(DISTINCT lower(term)) AS n_repeated FROM (SELECT * FROM terms UNION ALL SELECT category, upper(term) FROM terms) GROUP BY 1", "terms")
def term_lists(db: Tables) -> DataFrame:
    terms = db.terms
    return ids.term_lists(terms.union(terms.select("category", F.upper("term"))).union(terms.select("category", F.lit("  "))))


@query("SELECT b.term, l.k IS NOT NULL AS covered FROM terms b LEFT JOIN listed l ON l.k = lower(b.term) WHERE b.category = 'Blacklist'", "terms", "listed AS MATERIALIZED (SELECT DISTINCT lower(term) AS k FROM terms WHERE category IN ('Names', 'Towns'))")
def blacklist_coverage(db: Tables) -> DataFrame:
    return ids.blacklist_coverage(db.terms)


def cells(columns: dict[str, str], source: str = "ledger", key: str = "seq") -> str:
    """CTE hits (id, column, at, n, gram) of the words of cells."""
    parts = " UNION ALL ".join(f"SELECT {key} AS id, '{c}' AS col, {d.words(x)} AS w FROM {source}" for c, x in columns.items())
    return f"grams AS (SELECT id, col, g.at AS at, g.n AS n, g.gram AS gram FROM (SELECT id, col, unnest({d.grams('w')}) AS g FROM ({parts})))"


BOTH = {"description": "description", "account": "account"}


@query(f"SELECT col AS \"column\", category, term, count(*) AS n FROM grams JOIN (SELECT category, term, {d.gram('term')} AS tg FROM terms) ON gram = tg GROUP BY 1, 2, 3", "ledger terms", cells(BOTH))
def locate_terms(db: Tables) -> DataFrame:
    return ids.locate_terms(db.ledger, "seq", list(BOTH), db.terms).groupBy("column", "category", "term").agg(F.count("*").alias("n"))


LEAKS = f"""leak_terms AS (SELECT DISTINCT category, term FROM (SELECT 'word' AS category, term FROM terms UNION ALL SELECT 'word', account FROM ledger
 UNION ALL SELECT 'digit', lpad({d.key('account_num')}, 4, '0') FROM ledger WHERE regexp_matches({d.key('account_num')}, '^[0-9]+$')) WHERE term <> '')"""
SCAN = f"""leaks AS (SELECT id, col, category AS kind, term AS hit FROM (SELECT id, col, category, term, row_number() OVER (PARTITION BY id, col ORDER BY category <> 'word', "at", -n, category, term) AS k
 FROM grams JOIN (SELECT category, term, {d.gram('term')} AS tg FROM leak_terms) ON gram = tg) WHERE k = 1)"""


def forbidden(db: Tables) -> DataFrame:
    ledger = db.ledger
    key = t.account_key(F.col("account_num"))
    numbers = ledger.where(t.filled(F.col("account_num"))).select(t.bare_form(key).alias("term")).where("term is not null")
    return checks.leak_terms(db.terms, ledger.select(F.col("account").alias("term")), numbers)


@query("SELECT category, term FROM leak_terms", "ledger terms", LEAKS)
def leak_terms(db: Tables) -> DataFrame:
    return forbidden(db)


@query('SELECT id AS seq, col AS "column", kind, hit FROM leaks', "ledger terms", f"{LEAKS}, {cells(BOTH)}, {SCAN}")
def leak_scan(db: Tables) -> DataFrame:
    return checks.leak_scan(db.ledger, "seq", list(BOTH), forbidden(db))


@query(
    f"SELECT seq, tok AS term, count(*) AS n FROM (SELECT seq, unnest(regexp_extract_all(description, '[A-Za-z0-9]+')) AS tok FROM ledger) WHERE tok IN (SELECT term FROM leak_terms WHERE category = 'digit') GROUP BY 1, 2",
    "ledger terms", LEAKS,
)
def digit_leaks(db: Tables) -> DataFrame:
    return checks.digit_leaks(db.ledger, "seq", "description", forbidden(db).where("category = 'digit'"))


_PIECES = r"regexp_extract_all(cell, '[^\p{L}\p{N}]*[\p{L}\p{N}]+')"
_UPTO = lambda k: f"length(array_to_string({_PIECES}[1:{k}], ''))"


@query(
    rf"""SELECT tab AS "table", term, n_cells, first_id, col AS "column", translate(substr(cell, from0 + 1, upto - from0 + 25), chr(10) || chr(13) || chr(9), '   ') AS context FROM (SELECT *, {_UPTO('"at" + n - 1')} AS upto,
 greatest({_UPTO('"at"')} - length(regexp_extract({_PIECES}["at"], '[\p{{L}}\p{{N}}]+')) - 25, 0) AS from0
 FROM (SELECT tab, term, id AS first_id, col, cell, "at", n, count(*) OVER (PARTITION BY tab, term) AS n_cells, row_number() OVER (PARTITION BY tab, term ORDER BY length(id), id, col) AS k2
 FROM (SELECT *, row_number() OVER (PARTITION BY tab, term, id, col ORDER BY "at", n) AS k FROM (
 SELECT 'ledger' AS tab, term, CAST(id AS VARCHAR) AS id, col, "at", n, CASE col WHEN 'account' THEN account ELSE description END AS cell FROM grams JOIN bad ON gram = tg JOIN ledger ON seq = id
 UNION ALL SELECT 'part', term, CAST(p_partkey AS VARCHAR), 'p_name', i, 1, p_name FROM (SELECT p_partkey, p_name, unnest(w) AS g, unnest(range(1, len(w) + 1)) AS i FROM (SELECT *, {d.words('p_name')} AS w FROM part)) JOIN bad ON g = tg)) WHERE k = 1) WHERE k2 = 1)""",
    "ledger terms", f"{cells(BOTH)}, bad AS (SELECT term, {d.gram('term')} AS tg FROM terms WHERE category = 'Blacklist')",
)
def blacklist_scan(db: Tables) -> DataFrame:
    return checks.blacklist_scan({"ledger": (db.ledger, "seq", list(BOTH)), "part": (db.part, "p_partkey", ["p_name"])}, db.terms.where("category = 'Blacklist'"))


@query("SELECT value FROM (SELECT DISTINCT value FROM harvest WHERE category = 'account_name') ORDER BY lower(value), value LIMIT 20", "terms accounts ledger properties", HARVEST)
def inventory_sample(db: Tables) -> DataFrame:
    return ids.sample(harvested(db).where("category = 'account_name'"), "value", 20)
