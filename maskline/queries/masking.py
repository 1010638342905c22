"""Queries over masked tables and the checks that prove them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskline.functions import text as t
from maskline.operators import checks as c
from maskline.operators import identifiers as ids
from maskline.operators import mapping as m
from maskline.operators import masking as k
from maskline.operators import rows as r
from maskline.plans import jobs
from maskline.queries import duck as d
from maskline.queries import harvesting as h
from maskline.queries import mapping as mq
from maskline.queries.base import Tables, query
from maskline.queries.duck import SEED
from maskline.queries.scalars import FACTOR, HEADERS, statement_cells
from maskline.shared import shared_dir, written

FAKES = mq.FAKES
SINGLES = "singles AS (SELECT lower(real) AS k, fake FROM fakes WHERE NOT contains(real, ' ') AND NOT contains(real, '_'))"
LOOKUP = "look AS (SELECT map(list(k), list(fake)) AS mp FROM singles)"
_TOKENS = r"regexp_extract_all(description, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+')"


def single_fakes(db: Tables) -> DataFrame:
    """(category, real, fake) of one-word terms."""
    return mq.term_fakes(db).where("instr(real, ' ') = 0 and instr(real, '_') = 0").select("category", "real", "fake")


@query(f"SELECT seq, array_to_string(list_transform({_TOKENS}, lambda p: coalesce(mp[lower(p)], p)), '') AS description FROM ledger, look", "ledger terms", f"{FAKES}, {SINGLES}, {LOOKUP}")
def mask_tokens(db: Tables) -> DataFrame:
    """One-word terms by join of words, for any number of them."""
    return k.mask_tokens(db.ledger, "seq", "description", single_fakes(db)).select("seq", "description")


_MASKED = f"array_to_string(list_transform({_TOKENS}, lambda t: coalesce(mp[lower(t)], {d.blanket('t')})), '')"


_WORDS = f"{FAKES}, {d.masked('ledger', 'seq', {'description': 'description'}, 'fakes', k.RELATED)}"


@query("SELECT id AS seq, text AS description FROM walked", "ledger terms", _WORDS)
def mask_text(db: Tables) -> DataFrame:
    """All listed terms, of one word and more."""
    return k.mask_text(db.ledger, ["description"], mq.term_fakes(db), SEED).select("seq", "description")


@query("SELECT id AS seq, text AS description FROM walked", "ledger terms", _WORDS)
def mask_text_by_join(db: Tables) -> DataFrame:
    """The same by the way for mappings that are too large to send to executors."""
    terms = written(k.needed(mq.term_fakes(db), SEED, True), shared_dir(db.spark), "terms")
    return k.by_join(db.ledger, ["description"], terms, SEED).select("seq", "description")


def account_parts(db: Tables) -> DataFrame:
    """(account, suffix): every account name with its type."""
    return mq.account_cores(db).select(F.col("account").alias("real"), "suffix")


def name_fakes(db: Tables) -> DataFrame:
    """(category, real, fake): account names and listed terms, drawn together so that no two share a fake."""
    cores = account_parts(db)
    names = cores.select(F.lit("account_name").alias("category"), F.lit("person").alias("kind"), "real")
    got = m.assign(mq.term_reals(db).union(names), mq.candidates(db), SEED).select("category", "real", "fake")
    both = got.join(cores.withColumn("category", F.lit("account_name")), ["category", "real"], "left").withColumn("suffix", F.coalesce("suffix", F.lit("")))
    return both.select("category", "real", jobs.with_suffix("fake", "suffix").alias("fake"))


def ledger_mapping(db: Tables) -> DataFrame:
    """(category, real, fake): account names, listed terms, account numbers in every form, and digit runs; written once."""
    numbers = written(mq.account_fakes(db), shared_dir(db.spark), "numbers")
    runs = m.salted_unique(mq.run_reals(db), SEED, "run", numbers.select(F.col("fake_last4").alias("fake")), mq.ROUNDS, widen=True)
    whole = name_fakes(db).union(jobs.number_terms(db.ledger.select("account_num"), numbers)).union(jobs.row(runs, "run", "real", "fake"))
    return written(whole, shared_dir(db.spark), "mapping")


_CORE, _SUFFIX = d.core("real")
LEDGER_MAPPING = f"""{mq.POOLS}, {mq.REALS}, account_reals AS (SELECT DISTINCT 'account_name' AS category, 'person' AS kind, account AS real FROM ledger WHERE account <> ''),
 all_reals AS (SELECT * FROM reals UNION ALL SELECT * FROM account_reals), own AS MATERIALIZED ({d.assigned('all_reals', 'candidates')}), {mq.NUMBERS}, {mq.RUNS}, number_fakes AS (SELECT fake_last4 AS fake FROM numbers),
 {d.salted('runs', 'run_reals', 'run', mq.ROUNDS, 'number_fakes')}, mapping AS MATERIALIZED (SELECT category, real, fake || CASE WHEN category = 'account_name' AND {_SUFFIX} <> '' THEN ' ' || {_SUFFIX} ELSE '' END AS fake FROM own
 UNION ALL SELECT DISTINCT 'acctnum', account_num, fake_number FROM ledger JOIN numbers ON key = {d.key('account_num')} WHERE regexp_matches(account_num, '[A-Za-z]') AND regexp_matches(account_num, '[0-9]')
 UNION ALL SELECT 'last4', lpad(key, 4, '0'), fake_last4 FROM numbers WHERE regexp_matches(key, '^[0-9]+$') UNION ALL SELECT 'run', real, fake FROM runs)"""


def account_table(db: Tables) -> DataFrame:
    """(key, fake_last4, fake_number, institution)."""
    return mq.account_fakes(db).join(ids.canonical_institutions(db.ledger), "key", "left")


def masked_ledger(db: Tables) -> DataFrame:
    return k.mask_ledger(db.ledger, ledger_mapping(db), account_table(db), SEED)


_ACCOUNTS = f"{h.KEYED}, {h.COUNTS}, canon AS (SELECT key, institution FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n_primary > 0 DESC, CASE WHEN n_primary > 0 THEN n_primary ELSE n END DESC, institution) AS k FROM counts) WHERE k = 1)"


@query(
    f"""SELECT l.seq, l.date, a.text AS description, l.amount, b.text AS account, coalesce(n.fake_number, l.account_num) AS account_num, coalesce(c.institution, l.institution) AS institution, l.is_primary
 FROM ledger l JOIN walked a ON a.id = l.seq AND a.col = 'description' JOIN walked b ON b.id = l.seq AND b.col = 'account'
 LEFT JOIN numbers n ON trim(l.account_num) <> '' AND n.key = {d.key('l.account_num')} LEFT JOIN canon c ON trim(l.account_num) <> '' AND c.key = {d.key('l.account_num')}""",
    "ledger terms", f"{LEDGER_MAPPING}, {_ACCOUNTS}, {d.masked('ledger', 'seq', {'description': 'description', 'account': 'account'}, 'mapping', k.LEDGER)}",
)
def mask_ledger(db: Tables) -> DataFrame:
    return masked_ledger(db)


@query("SELECT id AS seq, text AS description, CAST(n_hits AS INTEGER) AS n_hits FROM walked", "ledger terms", f"{LEDGER_MAPPING}, {d.masked('ledger', 'seq', {'description': 'description'}, 'mapping', k.LEDGER, blanket_rule=False)}")
def mask_text_ledger(db: Tables) -> DataFrame:
    return k.mask_text(db.ledger, ["description"], ledger_mapping(db), SEED, k.LEDGER, blanket=False, hits=True).select("seq", "description", F.size("description_hits").alias("n_hits"))


@query(f"SELECT seq, coalesce(fake_number, account_num) AS account_num FROM ledger LEFT JOIN numbers n ON trim(account_num) <> '' AND n.key = {d.key('account_num')}", "ledger", mq.NUMBERS)
def normalize_account_number(db: Tables) -> DataFrame:
    return k.normalize_accounts(db.ledger, account_table(db)).select("seq", "account_num")


@query(f"SELECT seq, coalesce(n.institution, l.institution) AS institution FROM ledger l LEFT JOIN canon n ON trim(account_num) <> '' AND n.key = {d.key('account_num')}", "ledger", f"{_ACCOUNTS}, {mq.NUMBERS}")
def normalize_institution(db: Tables) -> DataFrame:
    return k.normalize_accounts(db.ledger, account_table(db)).select("seq", "institution")


@query(
    "SELECT o_orderkey, CAST(coalesce(CAST(fake_last4 AS BIGINT), o_custkey) AS BIGINT) AS account_num FROM orders LEFT JOIN numbers ON key = CAST(o_custkey % 10000 AS VARCHAR)", "ledger", mq.NUMBERS,
)
def mask_numeric_account(db: Tables) -> DataFrame:
    """Account numbers that are held as whole numbers."""
    numbers = db.orders.select("o_orderkey", F.col("o_custkey").cast("bigint").alias("account_num"))
    empty = db.spark.createDataFrame([], "category string, real string, fake string")
    return k.mask_table(numbers, empty, mq.account_fakes(db), SEED)


_SECTIONS = "parts AS (SELECT s.*, header_row FROM statements s JOIN headers h ON s.file = h.file)"


def _cell(c: str, money: bool, described: bool) -> str:
    data = d.scaled_text(c, FACTOR) if money else d.scrub(c) if described else c
    return f"CASE WHEN row_no > header_row THEN {data} WHEN row_no < header_row THEN {d.scaled_text(f'({d.scrub(c)})', FACTOR)} ELSE {c} END AS {c}"


@query(f"SELECT file, row_no, {_cell('c1', False, False)}, {_cell('c2', False, True)}, {_cell('c3', True, False)}, {_cell('c4', True, False)} FROM parts", "statements", f"{HEADERS}, {_SECTIONS}")
def mask_bank(db: Tables) -> DataFrame:
    cells = statement_cells(db)
    empty = db.spark.createDataFrame([], "category string, real string, fake string")
    got = k.mask_statements(cells, r.statement_headers(cells), empty, SEED, FACTOR)
    return got.select("file", "row_no", *(F.get("cells", F.lit(i)).alias(f"c{i + 1}") for i in range(4)))


#: Statements whose preamble has a first name and a surname in neighbouring cells, and whose descriptions have whole names.
PAYEES = """SELECT s.file, row_no, CASE WHEN c1 LIKE 'Beginning%' THEN given ELSE c1 END AS c1, CASE WHEN c1 LIKE 'Beginning%' THEN family WHEN c2 LIKE '% %' THEN concat(c2, ' ', given, ' ', family, ', ', given) ELSE c2 END AS c2, c3, c4
 FROM statements s JOIN people p ON p.id = cast(substr(s.file, 6, 2) AS int) * 3 + 3"""
_BANK = f"""payees AS ({PAYEES}), bank_cells AS (SELECT concat(p.file, ':', row_no, ':', col) AS id, text FROM (SELECT file, row_no, 'c1' AS col, c1 AS text FROM payees UNION ALL SELECT file, row_no, 'c2', c2 FROM payees UNION ALL SELECT file, row_no, 'c3', c3 FROM payees UNION ALL SELECT file, row_no, 'c4', c4 FROM payees) p
 JOIN headers h ON h.file = p.file WHERE row_no < header_row OR (row_no > header_row AND col = 'c2')), {d.masked('bank_cells', 'id', {'text': 'text'}, 'fakes', k.RELATED)}"""


def _named_cell(c: str, money: bool) -> str:
    data = d.scaled_text(f"p.{c}", FACTOR) if money else f"{c}.text" if c == "c2" else f"p.{c}"
    return f"CASE WHEN p.row_no < h.header_row THEN {d.scaled_text(f'{c}.text', FACTOR)} WHEN p.row_no > h.header_row THEN {data} ELSE p.{c} END AS {c}"


_CELLS_OF = " ".join(f"LEFT JOIN walked {c} ON {c}.id = concat(p.file, ':', p.row_no, ':{c}')" for c in ("c1", "c2", "c3", "c4"))


@query(
    f"SELECT p.file, p.row_no, {_named_cell('c1', False)}, {_named_cell('c2', False)}, {_named_cell('c3', True)}, {_named_cell('c4', True)} FROM payees p JOIN headers h ON h.file = p.file {_CELLS_OF}", "statements people ledger terms", f"{HEADERS}, {FAKES}, {_BANK}",
)
def mask_bank_names(db: Tables) -> DataFrame:
    """Statements under a mapping of names: a name over two cells is two cells, each masked by itself."""
    db.statements, db.people  # noqa: B018  the views that the next line reads
    cells = db.spark.sql(PAYEES).select("file", "row_no", F.array("c1", "c2", "c3", "c4").alias("cells"))
    got = k.mask_statements(cells, r.statement_headers(cells), mq.term_fakes(db), SEED, FACTOR)
    return got.select("file", "row_no", *(F.get("cells", F.lit(i)).alias(f"c{i + 1}") for i in range(4)))


_R = mq.RELATED
_RNUM = f"""rkeys AS (SELECT DISTINCT {d.key('value')} AS key FROM found WHERE category = 'account_num'), rnumbers AS MATERIALIZED ({d.numbers('rkeys', mq.DIGITS)}),
 rmapping AS MATERIALIZED (SELECT 'street' AS category, real, fake FROM drawn WHERE category = 'street' UNION ALL SELECT 'llc', real, fake FROM llcs UNION ALL SELECT 'name', real, fake FROM rnames UNION ALL SELECT 'town', real, fake FROM drawn WHERE category = 'town'
 UNION ALL SELECT 'propcode', real, fake FROM props UNION ALL SELECT 'entcode', real, fake FROM entities
 UNION ALL SELECT DISTINCT 'acctnum', value, fake_number FROM found JOIN rnumbers ON key = {d.key('value')} WHERE category = 'account_num' AND regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]')
 UNION ALL SELECT 'last4', lpad(key, 4, '0'), fake_last4 FROM rnumbers WHERE regexp_matches(key, '^[0-9]+$'))"""
_TABLE = f"""numbered AS MATERIALIZED (SELECT *, row_number() OVER () AS rid FROM holdings), {d.masked('numbered', 'rid', {'address': 'address', 'prop': 'prop', 'llc': 'llc'}, 'rmapping', k.RELATED)}"""


@query(
    f"""SELECT coalesce(m.fake, a.text) AS address, p.text AS prop, l.text AS llc, coalesce(k.fake_number, n.bank1) AS bank1 FROM numbered n LEFT JOIN addresses m ON m.real = n.address
 JOIN walked a ON a.id = n.rid AND a.col = 'address' JOIN walked p ON p.id = n.rid AND p.col = 'prop' JOIN walked l ON l.id = n.rid AND l.col = 'llc' LEFT JOIN rnumbers k ON trim(n.bank1) <> '' AND k.key = {d.key('n.bank1')}""",
    mq.RELATED_VIEWS, f"{_R}, {_RNUM}, {_TABLE}",
)
def mask_table(db: Tables) -> DataFrame:
    """The key table: addresses through their map, bank columns by account, the rest as text."""
    built = mq.related(db)
    return k.mask_table(db.holdings, built["mapping"], built["accounts"], SEED, FACTOR, built["addresses"])


#: A table with a column of every kind that is treated by type or heading.
KINDS = """SELECT cast(o_orderkey AS bigint) AS id, cast(o_custkey AS bigint) AS account_num, cast(o_totalprice AS decimal(18,2)) AS amount, cast(o_orderdate AS date) AS opened,
 concat(n_name, ' Bank') AS institution, CASE o_orderkey % 3 WHEN 0 THEN cast(o_custkey % 10000 AS string) WHEN 1 THEN concat('xxxx', lpad(cast(o_custkey % 10000 AS string), 4, '0')) ELSE '' END AS bank2, concat('$', cast(cast(o_totalprice AS decimal(18,2)) AS string)) AS rent
 FROM orders JOIN people ON o_custkey = id JOIN nation ON c_nationkey = n_nationkey"""


@query(
    f"""SELECT o.id, CAST(coalesce(CAST(a.fake_last4 AS BIGINT), o.account_num) AS BIGINT) AS account_num, CAST({d.scaled('o.amount', FACTOR)} AS DECIMAL(18,2)) AS amount, o.opened, o.institution, coalesce(b.fake_number, o.bank2) AS bank2, {d.scaled_text('o.rent', FACTOR)} AS rent
 FROM kinds o LEFT JOIN numbers a ON a.key = CAST(o.account_num % 10000 AS VARCHAR) LEFT JOIN numbers b ON trim(o.bank2) <> '' AND b.key = {d.key('o.bank2')}""", "ledger people", f"kinds AS ({KINDS}), {mq.NUMBERS}",
)
def mask_kinds(db: Tables) -> DataFrame:
    """Whole-number accounts, decimals, dates, institutions, bank columns in every form, and money in text."""
    db.people, db.orders, db.nation  # noqa: B018  the views that the next line reads
    empty = db.spark.createDataFrame([], "category string, real string, fake string")
    return k.mask_table(db.spark.sql(KINDS), empty, written(mq.account_fakes(db), shared_dir(db.spark), "numbers"), SEED, FACTOR)


_PIECES = r"""pieces AS (SELECT doc_id, w, sum(length(w)) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM (SELECT doc_id, unnest(p) AS w, unnest(range(1, len(p) + 1)) AS k
 FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+') AS p FROM documents)))"""
_FOUND = f"""found AS (SELECT doc_id, 'text' AS col, CAST(upto - length(w) AS INTEGER) AS "start", CAST(upto AS INTEGER) AS "end", CASE WHEN regexp_matches(w, '^[0-9]+$') THEN 'run' ELSE 'code' END AS category, w AS real, {d.blanket('w')} AS fake
 FROM pieces WHERE regexp_matches(w, '^[0-9]{{5,}}$') OR (regexp_matches(w, '^[A-Za-z0-9]+$') AND {d.is_code('w')}))"""


def document_spans(db: Tables) -> DataFrame:
    """What the blanket rule replaces in documents, written by one pass."""
    empty = db.spark.createDataFrame([], "category string, real string, fake string")
    masked = k.mask_text(db.documents.select("doc_id", "text"), ["text"], empty, SEED, hits=True)
    return written(k.spans(masked, ["doc_id"], ["text"]), shared_dir(db.spark), "spans")


@query('SELECT doc_id, col AS "column", "start", "end", category, real, fake FROM found', "", f"{_PIECES}, {_FOUND}")
def span_ledger(db: Tables) -> DataFrame:
    """Every replacement in documents with its place."""
    return document_spans(db)


@query("SELECT category AS kind, count(*) AS n FROM found GROUP BY category", "", f"{_PIECES}, {_FOUND}")
def replacement_stats(db: Tables) -> DataFrame:
    return k.replacement_counts(document_spans(db))


_GLUE = """glue AS (SELECT DISTINCT lower(given || given2) AS word FROM (SELECT given, lag(given) OVER (ORDER BY id) AS given2 FROM people) WHERE given2 IS NOT NULL UNION SELECT lower(given) FROM people UNION SELECT lower(family) FROM people),
 known AS (SELECT DISTINCT lower(real) AS w, fake FROM fakes WHERE category = 'name' AND regexp_matches(lower(real), '^\\p{L}+$'))"""


@query(
    """SELECT word, first, second, fake FROM (SELECT word, a.w AS first, b.w AS second, a.fake || b.fake AS fake, row_number() OVER (PARTITION BY word ORDER BY length(a.w) DESC) AS k
 FROM glue JOIN known a ON starts_with(word, a.w) AND length(a.w) >= 3 JOIN known b ON word = a.w || b.w AND length(b.w) >= 3 WHERE word NOT IN (SELECT w FROM known)) WHERE k = 1""",
    "people ledger terms", f"{FAKES}, {_GLUE}",
)
def glued_names(db: Tables) -> DataFrame:
    people = db.people  # names of neighbours by id make up the words
    pairs = people.select("id", "given").join(people.select((F.col("id") + 1).alias("id"), F.col("given").alias("given2")), "id")
    words = pairs.select(F.lower(F.concat("given", "given2")).alias("word")).union(people.select(F.lower("given"))).union(people.select(F.lower("family"))).distinct()
    return k.glued_names(words, mq.term_fakes(db).where("category = 'name'"))


@query("SELECT count(*) AS leaks_before, 0 AS leaks_after, true AS passed FROM leaks", "ledger terms", f"{h.LEAKS}, {h.cells(h.BOTH)}, {h.SCAN}")
def leak_gate(db: Tables) -> DataFrame:
    return leaks_of(db, masked_ledger(db))


def leaks_of(db: Tables, masked: DataFrame) -> DataFrame:
    terms = written(h.forbidden(db), shared_dir(db.spark), "terms")
    return c.leak_gate(c.leak_scan(db.ledger, "seq", list(h.BOTH), terms), c.leak_scan(masked, "seq", list(h.BOTH), terms))


@query("SELECT count(*) AS n_rows, 0 AS n_different FROM ledger", "ledger")
def integrity_check(db: Tables) -> DataFrame:
    return untouched(db, masked_ledger(db))


def untouched(db: Tables, masked: DataFrame) -> DataFrame:
    before = db.ledger
    cells = c.integrity(before, masked, "seq", ["date", "amount", "is_primary"])
    return before.agg(F.count("*").alias("n_rows")).crossJoin(cells.agg(F.count("*").alias("n_different")))  # one row each


@query(
    """SELECT seq, 'amount' AS "column", 1 AS n_gone, 1 AS n_new, amount AS old, amount || '0' AS new FROM ledger WHERE CAST(seq AS BIGINT) % 50 = 1
 UNION ALL SELECT seq, c, 2, 0, CASE c WHEN 'date' THEN date ELSE amount END, NULL FROM ledger, (SELECT unnest(['date', 'amount']) AS c) WHERE CAST(seq AS BIGINT) % 50 = 2""", "ledger",
)
def integrity_of_doubled_rows(db: Tables) -> DataFrame:
    """Rows that occur twice; of some, one copy is changed, and some are gone."""
    ledger = db.ledger.select("seq", "date", "amount")
    number, changed = F.col("seq").cast("long"), F.concat("amount", F.lit("0"))
    after = ledger.union(ledger.withColumn("amount", F.when(number % 50 == 1, changed).otherwise(F.col("amount")))).where(number % 50 != 2)
    return c.integrity(ledger.union(ledger), after.repartition(5), "seq", ["date", "amount"])


@query("SELECT 2 * count(DISTINCT seq) AS n_different, count(*) = 0 AS passed FROM ledger WHERE CAST(seq AS BIGINT) % 40 = 1", "ledger")
def determinism_refused(db: Tables) -> DataFrame:
    """Two builds that differ in some rows, one of them with its rows twice."""
    ledger = db.ledger.select("seq", "amount")
    other = ledger.withColumn("amount", F.when(F.col("seq").cast("long") % 40 == 1, F.lit(None)).otherwise(F.col("amount")))
    return c.determinism(ledger.union(ledger), other.union(other).repartition(3))


@query(
    f"""SELECT rule, mode, count(tok) AS before, count(tok) AS after, CAST(0 AS BIGINT) AS left_over, true AS passed
 FROM (SELECT 'runs' AS rule, 'exact' AS mode, real AS w FROM m UNION ALL SELECT 'names', 'drop', lower(real) FROM fakes WHERE kind = 'single')
 LEFT JOIN (SELECT lower(unnest(regexp_extract_all(description, '[A-Za-z0-9]+'))) AS tok FROM ledger) ON tok = w GROUP BY rule, mode""",
    "ledger terms", f"{FAKES}, {mq.RUNS}, {d.salted('m', 'run_reals', 'run', mq.ROUNDS)}",
)
def hit_counts(db: Tables) -> DataFrame:
    names = mq.term_fakes(db).where("kind = 'single'")
    mapping = written(jobs.row(mq.digit_run_map(db), "run", "real", "fake").union(names.select("category", "real", "fake")), shared_dir(db.spark), "mapping")
    rules = mapping.select(F.when(F.col("category") == "run", "runs").otherwise("names").alias("rule"), F.when(F.col("category") == "run", "exact").otherwise("drop").alias("mode"), "real", "fake")
    return c.hit_counts(db.ledger, k.mask_text(db.ledger, ["description"], mapping, SEED, k.LEDGER, blanket=False), "description", rules)


@query(
    """SELECT 'account names' AS rule, 'info' AS mode, count(*) AS before, count(*) AS after, CAST(0 AS BIGINT) AS left_over, true AS passed FROM ledger WHERE account <> ''
 UNION ALL SELECT 'last fours', 'drop', count(*), count(*) FILTER (CAST(seq AS BIGINT) % 10 <> 1), 0, count(*) FILTER (CAST(seq AS BIGINT) % 10 = 1) = 0 FROM (SELECT seq, unnest(regexp_extract_all(description, '[A-Za-z0-9]+')) AS tok FROM ledger) WHERE tok IN (SELECT lpad(key, 4, '0') FROM numbers WHERE regexp_matches(key, '^[0-9]+$'))""",
    "ledger", mq.NUMBERS,
)
def hit_counts_by_mode(db: Tables) -> DataFrame:
    """Account names of several words, for information; and last fours, of which a faulty pass has lost some: fewer fakes than reals."""
    mapping = ledger_mapping(db)
    after = k.mask_text(db.ledger.select("seq", "description", "account"), ["description", "account"], mapping, SEED, k.LEDGER, blanket=False)
    lost = F.when(F.col("seq").cast("long") % 10 == 1, F.regexp_replace("description", "[0-9]", "z")).otherwise(F.col("description"))
    name = F.col("category") == "account_name"
    rules = mapping.where("category in ('account_name', 'last4')").select(F.when(name, "account names").otherwise("last fours").alias("rule"), F.when(name, "info").otherwise("drop").alias("mode"), "real", "fake")
    counted = lambda df, x: c.hit_counts(db.ledger, df, x, rules.where(name if x == "account" else ~name))
    return counted(after, "account").union(counted(after.withColumn("description", lost), "description"))


@query("SELECT count(*) AS n_reals, count(DISTINCT fake) AS n_fakes, count(*) = count(DISTINCT fake) AS one_to_one FROM (SELECT real, fake FROM mapping WHERE category NOT IN ('acctnum', 'last4') UNION ALL SELECT key, fake_number FROM numbers)", "ledger terms", LEDGER_MAPPING)
def bijection_check(db: Tables) -> DataFrame:
    """All that masks the ledger: names, towns, runs, and accounts by key, since the forms of one account share its number."""
    return one_to_one(db, ledger_mapping(db))


def one_to_one(db: Tables, mapping: DataFrame) -> DataFrame:
    used = jobs.identities(mapping, mq.account_fakes(db))
    bad = c.bijection(used).agg((F.count("*") == 0).alias("one_to_one"))
    return used.agg(F.count("*").alias("n_reals"), F.count_distinct("fake").alias("n_fakes")).crossJoin(bad)  # one row each


@query("SELECT count(*) - count(*) AS n_different, true AS passed FROM fakes", "ledger terms", FAKES)
def determinism_check(db: Tables) -> DataFrame:
    return c.determinism(mq.term_fakes(db), m.assign(mq.term_reals(db).repartition(7), mq.candidates(db).repartition(3), SEED))


@query(
    f"SELECT n AS rows_before, n AS rows_after, true AS passed FROM (SELECT CAST(sum(a.x * b.y) AS BIGINT) AS n FROM (SELECT {d.key('account_num')} AS k, count(*) AS x FROM ledger WHERE trim(account_num) <> '' GROUP BY 1) a JOIN (SELECT {d.key('account_num')} AS k, count(*) AS y FROM accounts GROUP BY 1) b USING (k))",
    "ledger accounts",
)
def join_preservation(db: Tables) -> DataFrame:
    fakes = account_table(db)
    keyed = lambda df: df.where(t.filled(F.col("account_num"))).select(t.account_key(F.col("account_num")).alias("k"))
    masked = lambda df: k.normalize_accounts(df.where(t.filled(F.col("account_num"))).withColumn("institution", F.lit("")), fakes).select(F.col("account_num").alias("k"))
    return c.join_preservation((keyed(db.ledger), keyed(db.accounts)), (masked(db.ledger), masked(db.accounts)), "k")


@query("""SELECT unnest(['leaks', 'bijection', 'integrity', 'totals', 'joins', 'determinism', 'hit counts']) AS gate, false AS passed FROM region WHERE r_regionkey = 0""")
def gates_refuse(db: Tables) -> DataFrame:
    """Every gate on a faulty result: none may pass."""
    ledger = db.ledger.select("seq", "description", "amount", "account_num")
    black = db.terms.where("category = 'Blacklist'").select("category", "term")
    scan = c.leak_scan(ledger, "seq", ["description"], black)
    two = jobs.row(db.customer.withColumn("fake", F.lit("one")), "name", "c_custkey", "fake")
    changed = ledger.withColumn("amount", F.when(F.col("seq").cast("long") % 100 == 1, "0.00").otherwise(F.col("amount")))
    prices = db.lineitem.select(F.col("l_extendedprice").cast("decimal(18,2)").alias("p"))
    keyed = lambda df: df.select(t.account_key(F.col("account_num")).alias("k"))
    rules = db.people.select(F.lit("names").alias("rule"), F.lit("drop").alias("mode"), F.col("given").alias("real"), F.lit("x").alias("fake")).distinct()
    gates = {
        "leaks": c.leak_gate(scan, scan), "bijection": jobs.passed(c.bijection(two)), "integrity": jobs.passed(c.integrity(ledger, changed, "seq", ["amount"])), "totals": c.amount_tieout(prices, prices, "p", FACTOR),
        "joins": c.join_preservation((keyed(ledger), keyed(db.accounts)), (keyed(ledger), keyed(db.accounts.where("length(account) % 2 = 0"))), "k"),
        "determinism": c.determinism(ledger, changed), "hit counts": c.hit_counts(ledger, ledger, "description", rules).select("passed"),
    }
    return c.report(gates).where("check <> 'overall'").select(F.col("check").alias("gate"), "passed")


@query(f"SELECT CAST(sum(p) AS DECIMAL(28,2)) AS total_before, CAST(sum({d.scaled('p', FACTOR)}) AS DECIMAL(28,2)) AS total_after, true AS passed FROM (SELECT CAST(l_extendedprice AS DECIMAL(18,2)) AS p FROM lineitem)")
def amount_tieout(db: Tables) -> DataFrame:
    before = db.lineitem.select(F.col("l_extendedprice").cast("decimal(18,2)").alias("p"))
    return c.amount_tieout(before, before.select(t.scale(F.col("p"), FACTOR).alias("p")), "p", FACTOR)


@query("SELECT run, count(*) AS n FROM (SELECT unnest(run_list) AS run FROM (SELECT regexp_extract_all(description, '\\d{5,}') AS run_list FROM ledger)) WHERE run NOT IN (SELECT real FROM o) GROUP BY run", "ledger", mq.EXTEND)
def unmapped_runs(db: Tables) -> DataFrame:
    """Runs that a saved mapping lacks."""
    runs = db.ledger.select(F.explode(t.digit_runs(F.col("description"))).alias("real"))
    return runs.join(mq.old_mapping(db), "real", "left_anti").groupBy(F.col("real").alias("run")).agg(F.count("*").alias("n"))


@query("SELECT tok AS run, count(*) AS n FROM (SELECT unnest(regexp_extract_all(description, '[A-Za-z0-9]+')) AS tok FROM ledger) WHERE regexp_matches(tok, '^[0-9]{5,}$') AND tok NOT IN (SELECT real FROM o) GROUP BY tok", "ledger", mq.EXTEND)
def unmapped_replacements(db: Tables) -> DataFrame:
    """Runs that a masking pass replaced by their shape alone, since the saved mapping lacks them, from its spans."""
    mapping = written(jobs.row(mq.old_mapping(db), "run", "real", "fake"), shared_dir(db.spark), "mapping")
    masked = k.mask_text(db.ledger.select("seq", "description"), ["description"], mapping, SEED, k.LEDGER, hits=True)
    return k.unmapped_runs(k.spans(masked, ["seq"], ["description"]), mapping)


@query("SELECT unnest(['leaks', 'integrity', 'determinism', 'one to one', 'joins', 'totals', 'overall']) AS \"check\", true AS passed FROM region WHERE r_regionkey = 0")
def report(db: Tables) -> DataFrame:
    """All checks over one mapping and one masked ledger."""
    mapping = ledger_mapping(db)
    masked = written(k.mask_ledger(db.ledger.hint("rebalance"), mapping, account_table(db), SEED), shared_dir(db.spark), "masked")
    return c.report({
        "leaks": leaks_of(db, masked), "integrity": untouched(db, masked).select((F.col("n_different") == 0).alias("passed")), "determinism": determinism_check(db),
        "one to one": one_to_one(db, mapping).select(F.col("one_to_one").alias("passed")), "joins": join_preservation(db), "totals": amount_tieout(db),
    })
