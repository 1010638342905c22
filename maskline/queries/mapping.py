"""Queries over the mapping build."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskline.functions import text as t
from maskline.operators import mapping as m
from maskline.operators import related as rel
from maskline.plans import jobs
from maskline.queries import duck as d
from maskline.queries.base import Tables, query
from maskline.queries.duck import SEED
from maskline.queries.scalars import PARSED
from maskline.shared import shared_dir, written

ROUNDS, DIGITS = 3, 5
KINDS = ("single", "person", "town")


def candidates(db: Tables) -> DataFrame:
    """Pools of names and towns, as large as the ledger's accounts and the listed terms ask for, without forbidden words."""
    terms = db.terms
    n_reals, n_terms, out = db.ledger.select("account").distinct().count(), terms.count(), None
    for kind in KINDS:
        part = m.pool(db.spark, kind, m.pool_size(kind, n_reals, n_terms))
        out = part if out is None else out.union(part)
    bad = written(m.in_pools(terms.select(F.col("term").alias("value"))), shared_dir(db.spark), "forbidden")
    return out if bad.isEmpty() else m.allowed(out, bad)


_SIZE = lambda kind: d.pool_size(kind, "SELECT count(DISTINCT account) FROM ledger", "SELECT count(*) FROM terms")
POOLS = f"""pools AS ({" UNION ALL ".join(d.pool(k, _SIZE(k)) for k in KINDS)}),
 forbidden AS (SELECT term AS value FROM terms), candidates AS MATERIALIZED ({d.allowed('pools', 'forbidden')})"""


@query("SELECT kind, value FROM candidates", "ledger terms", POOLS)
def pool_candidates(db: Tables) -> DataFrame:
    return candidates(db)


def term_reals(db: Tables) -> DataFrame:
    return jobs.term_reals(db.terms)


REALS = f"""reals AS (SELECT CASE WHEN category = 'Towns' THEN 'town' ELSE 'name' END AS category, CASE WHEN category = 'Towns' THEN 'town' WHEN contains(g, ' ') THEN 'person' ELSE 'single' END AS kind, real
 FROM (SELECT category, {d.gram('term')} AS g, min(term) AS real FROM terms WHERE category IN ('Names', 'Towns') GROUP BY 1, 2))"""
FAKES = f"{POOLS}, {REALS}, fakes AS MATERIALIZED ({d.assigned('reals', 'candidates')})"


def term_fakes(db: Tables) -> DataFrame:
    return m.assign(term_reals(db), candidates(db), SEED)


@query("SELECT category, kind, real, fake FROM fakes", "ledger terms", FAKES)
def assign_fakes(db: Tables) -> DataFrame:
    return term_fakes(db)


_CORE, _SUFFIX = d.core("account")


def account_cores(db: Tables) -> DataFrame:
    names = db.ledger.where("account <> ''").select("account").distinct()
    return names.withColumn("x", t.split_core(F.col("account"))).select("account", "x.core", "x.suffix")


CORES = f"cores AS (SELECT account, {_CORE} AS core, {_SUFFIX} AS suffix FROM (SELECT DISTINCT account FROM ledger WHERE account <> ''))"


@query(
    "SELECT c.account AS real, f.fake || CASE WHEN suffix <> '' THEN ' ' || suffix ELSE '' END AS fake FROM cores c JOIN roots f ON lower(c.core) = lower(f.real)",
    "ledger terms",
    f"{POOLS}, {CORES}, root_reals AS (SELECT 'name' AS category, 'person' AS kind, min(core) AS real FROM cores GROUP BY lower(core)), roots AS ({d.assigned('root_reals', 'candidates')})",
)
def root_names(db: Tables) -> DataFrame:
    cores = account_cores(db)
    reals = cores.groupBy(F.lower("core").alias("k")).agg(F.min("core").alias("real")).select(F.lit("name").alias("category"), F.lit("person").alias("kind"), "real")
    roots = m.assign(reals, candidates(db), SEED).select(F.lower("real").alias("k"), "fake")
    joined = cores.withColumn("k", F.lower("core")).join(roots, "k")
    return joined.select(F.col("account").alias("real"), F.concat(F.col("fake"), F.when(F.col("suffix") != "", F.concat(F.lit(" "), F.col("suffix"))).otherwise("")).alias("fake"))


def account_name_fakes(db: Tables) -> DataFrame:
    """(category, real, fake): every account name its own fake, its type kept."""
    cores = account_cores(db)
    got = m.assign(cores.select(F.lit("account_name").alias("category"), F.lit("person").alias("kind"), F.col("account").alias("real")), candidates(db), SEED)
    both = got.join(cores.select(F.col("account").alias("real"), "suffix"), "real")
    return both.select("category", "real", F.concat(F.col("fake"), F.when(F.col("suffix") != "", F.concat(F.lit(" "), F.col("suffix"))).otherwise("")).alias("fake"))


@query(
    "SELECT 'account_name' AS category, f.real, f.fake || CASE WHEN suffix <> '' THEN ' ' || suffix ELSE '' END AS fake FROM own f JOIN cores c ON c.account = f.real",
    "ledger terms",
    f"{POOLS}, {CORES}, own_reals AS (SELECT 'account_name' AS category, 'person' AS kind, account AS real FROM cores), own AS ({d.assigned('own_reals', 'candidates')})",
)
def account_names(db: Tables) -> DataFrame:
    return account_name_fakes(db)


def account_fakes(db: Tables) -> DataFrame:
    """(key, fake_last4, fake_number) of the ledger's accounts."""
    keys = db.ledger.where(t.filled(F.col("account_num"))).select(t.account_key(F.col("account_num")).alias("key")).distinct()
    return m.numbers(keys, SEED, DIGITS)


NUMBERS = f"keys AS (SELECT DISTINCT {d.key('account_num')} AS key FROM ledger WHERE trim(account_num) <> ''), numbers AS MATERIALIZED ({d.numbers('keys', DIGITS)})"


@query("SELECT key, fake_last4, fake_number FROM numbers", "ledger", NUMBERS)
def account_numbers(db: Tables) -> DataFrame:
    return account_fakes(db)


RUNS = f"run_reals AS (SELECT DISTINCT unnest({d.runs('description')}) AS real FROM ledger)"


def run_reals(db: Tables) -> DataFrame:
    return db.ledger.select(F.explode(t.digit_runs(F.col("description"))).alias("real")).distinct()


@query("SELECT real, fake, CAST(salt AS INTEGER) AS salt FROM m", "ledger", f"{RUNS}, {d.salted('m', 'run_reals', 'run', ROUNDS)}")
def digit_run_map(db: Tables) -> DataFrame:
    return m.salted_unique(run_reals(db), SEED, "run", rounds=ROUNDS, widen=True)


@query(f"SELECT code AS real, {d.shape('code', 'code')} AS fake FROM (SELECT DISTINCT unnest({d.codes('description')}) AS code FROM ledger)", "ledger")
def alnum_code_map(db: Tables) -> DataFrame:
    codes = db.ledger.select(F.explode(t.alnum_codes(F.col("description"))).alias("real")).distinct()
    return codes.select("real", t.shape_fake(F.col("real"), SEED, "code").alias("fake"))


ENTITIES = r"entity_reals AS (SELECT DISTINCT trim(regexp_extract(unique_account_identifier, '^(.*?) - (\S+) \(([^)]+)\)\s*$', 3)) AS real FROM accounts)"


def entity_reals(db: Tables) -> DataFrame:
    return db.accounts.select(t.compound_parts(F.col("unique_account_identifier"))["code"].alias("real")).where("real is not null").distinct()


@query("SELECT real, fake, CAST(salt AS INTEGER) AS salt FROM m", "accounts", f"{ENTITIES}, {d.salted('m', 'entity_reals', 'entity', ROUNDS)}")
def entity_codes(db: Tables) -> DataFrame:
    return m.salted_unique(entity_reals(db), SEED, "entity", rounds=ROUNDS, widen=True)


_SHORT = "short_reals AS (SELECT DISTINCT substr(lpad(real, 6, '0'), 3, 4) AS real FROM run_reals)"


@query("SELECT CAST(salt AS INTEGER) AS salt, count(*) AS n, count(DISTINCT fake) AS n_fakes FROM m GROUP BY salt", "ledger", f"{RUNS}, {_SHORT}, {d.salted('m', 'short_reals', 'short', ROUNDS)}")
def salted_unique(db: Tables) -> DataFrame:
    """A crowded domain: four digits, so that many values need further rounds."""
    short = run_reals(db).select(F.substring(F.lpad("real", 6, "0"), 3, 4).alias("real")).distinct()
    return m.salted_unique(short, SEED, "short", rounds=ROUNDS, widen=True).groupBy("salt").agg(F.count("*").alias("n"), F.count_distinct("fake").alias("n_fakes"))


_OLD = "right(real, 1) < '6'"
EXTEND = f"""{RUNS}, old_reals AS (SELECT real FROM run_reals WHERE {_OLD}), {d.salted('o', 'old_reals', 'run', ROUNDS)}, new_reals AS (SELECT real FROM run_reals WHERE real NOT IN (SELECT real FROM o)),
 used AS (SELECT fake FROM o UNION SELECT real FROM o), {d.salted('n', 'new_reals', 'run', ROUNDS, 'used')}"""


def old_mapping(db: Tables) -> DataFrame:
    return m.salted_unique(run_reals(db).where("right(real, 1) < '6'"), SEED, "run", rounds=ROUNDS, widen=True).select("real", "fake")


@query("SELECT real, fake FROM o UNION ALL SELECT real, fake FROM n", "ledger", EXTEND)
def extend_mapping(db: Tables) -> DataFrame:
    return m.extend(written(old_mapping(db), shared_dir(db.spark), "old"), run_reals(db), SEED, "run", ROUNDS, widen=True)


@query("SELECT real FROM new_reals", "ledger", EXTEND)
def new_codes(db: Tables) -> DataFrame:
    return run_reals(db).join(old_mapping(db), "real", "left_anti")


@query("SELECT category, count(*) AS n_reals, count(DISTINCT fake) AS n_fakes FROM fakes GROUP BY category", "ledger terms", FAKES)
def mapping_summary(db: Tables) -> DataFrame:
    return term_fakes(db).groupBy("category").agg(F.count("*").alias("n_reals"), F.count_distinct("fake").alias("n_fakes"))


@query(
    f"""SELECT category, count(*) AS n FROM fakes GROUP BY category UNION ALL SELECT 'accounts', count(*) FROM numbers
 UNION ALL SELECT 'accounts in conflict', count(*) FROM (SELECT key FROM keyed WHERE institution <> '' GROUP BY key HAVING count(DISTINCT institution) > 1)""",
    "ledger terms", f"{FAKES}, {NUMBERS}, keyed AS (SELECT *, {d.key('account_num')} AS key FROM ledger WHERE trim(account_num) <> '')",
)
def mapping_sizes(db: Tables) -> DataFrame:
    """Reals by category, accounts, and accounts that occur with several institutions."""
    return jobs.mapping_sizes(term_fakes(db).select("category", "real", "fake"), account_fakes(db), db.ledger)


# addresses, properties and companies: the parts of the related-tables mapping


def related(db: Tables) -> dict[str, DataFrame]:
    """The mapping over the key table with its odd rows, the accounts, the ledger and the listed owners."""
    return jobs.build_related(related_tables(db), db.owners, jobs.Options(SEED, digits=DIGITS))


def related_tables(db: Tables) -> dict[str, DataFrame]:
    return {"holdings": db.holdings, "accounts": db.accounts, "ledger": db.ledger}


RELATED_VIEWS = "holdings owners accounts ledger"
_ACCT = "trim(regexp_extract(unique_account_identifier, '^(.*?) - (\\S+) \\(([^)]+)\\)\\s*$', {}))"
GATHERED = f"""found AS MATERIALIZED (SELECT DISTINCT category, value FROM (SELECT 'account_name' AS category, trim(account) AS value FROM ledger UNION ALL SELECT 'account_name', trim(account) FROM accounts UNION ALL SELECT 'account_name', {_ACCT.format(1)} FROM accounts
 UNION ALL SELECT 'account_num', trim(account_num) FROM ledger UNION ALL SELECT 'account_num', trim(account_num) FROM accounts UNION ALL SELECT 'account_num', {_ACCT.format(2)} FROM accounts UNION ALL SELECT 'account_num', trim(bank1) FROM holdings
 UNION ALL SELECT 'entity', {_ACCT.format(3)} FROM accounts UNION ALL SELECT 'llc', trim(llc) FROM holdings UNION ALL SELECT 'property', trim(prop) FROM holdings UNION ALL SELECT 'address', trim(address) FROM holdings) WHERE value <> '')"""


@query("SELECT category, value FROM found", RELATED_VIEWS, GATHERED)
def related_harvest(db: Tables) -> DataFrame:
    return rel.harvest(related_tables(db))


_NCORE, _NSUFFIX = d.core("real")
_COUNT = lambda kind: f"SELECT count(*) FROM wanted WHERE kind = '{kind}'"
_RPOOL = lambda kind: d.pool(kind, f"(SELECT CASE WHEN ({_COUNT(kind)}) = 0 THEN 0 ELSE {d.pool_size(kind, _COUNT(kind), 'SELECT count(*) FROM rforbidden')} END)")
_STREET = lambda category, value, salt="0": (
    f"(CAST({d.keyed(category, value, salt, 'number')} % 999 + 1 AS VARCHAR) || ' ' || {d.invented(d.keyed(category, value, salt, 'word') + f' % {m.POOL_WORDS}')} || ' ' || {d.literal(m.STREET_KINDS)}[{d.keyed(category, value, salt, 'kind')} % 4 + 1])"
)
_CODE = "substr(split_part(trim(street), ' ', 1), 1, 3) || '-' || upper(substr(regexp_replace(split_part(trim(street), ' ', 2), '[^\\p{L}]', '', 'g'), 1, 3))"
_DRAWN = lambda salt: f"(CAST({d.keyed('propcode', 'real', salt, 'number')} % 999 + 1 AS VARCHAR) || '-' || " + " || ".join(f"chr(CAST(65 + {d.keyed('propcode', 'real', salt, str(k))} % 26 AS INTEGER))" for k in range(3)) + ")"
RELATED = f"""{GATHERED}, {PARSED.replace("FROM properties))", "FROM (SELECT trim(address) AS address FROM holdings) WHERE address <> ''))").replace("SELECT DISTINCT address, p[1]", "SELECT DISTINCT address, coalesce(p[1], '')")},
 names AS (SELECT real, lower({_NCORE}) AS root, {_NSUFFIX} AS suffix, CASE WHEN contains({_NCORE}, ' ') THEN 'person' ELSE 'single' END AS kind FROM (SELECT min(term) AS real FROM owners WHERE category = 'Names' GROUP BY {d.gram('term')})),
 wanted AS MATERIALIZED (SELECT DISTINCT category, kind, real FROM (SELECT 'town' AS category, 'town' AS kind, lower(trim(term)) AS real FROM owners WHERE category = 'Towns' UNION ALL SELECT 'town', 'town', lower(city) FROM parsed UNION ALL SELECT 'street', 'street', lower(street) FROM parsed UNION ALL SELECT 'root', kind, root FROM names) WHERE real <> ''),
 rforbidden AS MATERIALIZED (SELECT term AS value FROM owners UNION SELECT value FROM found WHERE category IN ('account_name', 'llc', 'address')),
 rpools AS MATERIALIZED ({" UNION ALL ".join(map(_RPOOL, ("single", "person", "town", "street")))}), rcandidates AS MATERIALIZED ({d.allowed('rpools', 'rforbidden')}),
 drawn AS MATERIALIZED ({d.assigned('wanted', 'rcandidates')}),
 addresses AS MATERIALIZED (SELECT p.address AS real, s.fake AS fake_street, array_to_string(list_filter([coalesce(s.fake, p.street), coalesce(w.fake, p.city), trim(concat_ws(' ', p.state, p.zip))], lambda x: x <> ''), ', ') AS fake
 FROM parsed p LEFT JOIN drawn s ON s.category = 'street' AND s.real = lower(p.street) LEFT JOIN drawn w ON w.category = 'town' AND w.real = lower(p.city)),
 entity_reals AS (SELECT value AS real FROM found WHERE category = 'entity'), every_real AS (SELECT value AS fake FROM found), {d.salted('entities', 'entity_reals', 'entity', 3, 'every_real')},
 prop_taken AS (SELECT fake FROM every_real UNION SELECT fake FROM entities),
 prop_codes AS MATERIALIZED (SELECT real, {_CODE} AS code FROM (SELECT p.real, coalesce(a.fake_street, {_STREET('propstreet', 'p.spelled')}) AS street FROM (SELECT lower(value) AS real, min(value) AS spelled FROM found WHERE category = 'property' AND regexp_matches(value, '[0-9]') GROUP BY 1) p
 LEFT JOIN (SELECT lower(trim(prop)) AS owner, min(trim(address)) AS address FROM holdings WHERE trim(prop) <> '' AND trim(address) <> '' GROUP BY 1) l ON l.owner = p.real LEFT JOIN addresses a ON a.real = l.address)),
 {d.draws('props', 'prop_codes', 'code', _DRAWN, 'prop_taken')},
 llc_reals AS MATERIALIZED (SELECT l.owner AS real, coalesce(a.fake_street, {_STREET('llcstreet', 'l.owner')}) || ' LLC' AS name FROM (SELECT lower(trim(llc)) AS owner, min(trim(address)) AS address FROM holdings WHERE trim(llc) <> '' AND trim(address) <> '' GROUP BY 1) l LEFT JOIN addresses a ON a.real = l.address),
 {d.draws('llcs', 'llc_reals', 'name', lambda salt: f"({_STREET('llcname', 'real', salt)} || ' LLC')", 'every_real')},
 own AS (SELECT root, min_by(fake, real) AS fake FROM (SELECT lower({d.core('real')[0]}) AS root, real, fake FROM llcs) GROUP BY root),
 rnames AS MATERIALIZED (SELECT coalesce(o.root, n.real) AS real, coalesce(o.fake, n.fake) AS fake FROM (SELECT lower(n.real) AS real, d.fake || CASE WHEN suffix <> '' THEN ' ' || suffix ELSE '' END AS fake FROM names n JOIN drawn d ON d.category = 'root' AND d.real = n.root) n FULL JOIN own o ON o.root = n.real)"""


@query("SELECT real, fake_street, fake FROM addresses", RELATED_VIEWS, RELATED)
def address_map(db: Tables) -> DataFrame:
    return related(db)["addresses"]


def _category(db: Tables, category: str) -> DataFrame:
    return related(db)["mapping"].where(F.col("category") == category).select("real", "fake")


@query("SELECT real, fake FROM props", RELATED_VIEWS, RELATED)
def property_codes(db: Tables) -> DataFrame:
    """From the property's fake street, or one of its own; no two equal."""
    return _category(db, "propcode")


@query("SELECT real, fake FROM llcs", RELATED_VIEWS, RELATED)
def llc_names(db: Tables) -> DataFrame:
    return _category(db, "llc")


@query("SELECT real, fake FROM rnames", RELATED_VIEWS, RELATED)
def root_override(db: Tables) -> DataFrame:
    """Listed names, where a company's root takes the company's fake."""
    return _category(db, "name")
