"""Queries through files, and over whole runs of the three jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskline.functions import text as t
from maskline.operators import checks as c
from maskline.operators import masking as k
from maskline.operators import related as rel
from maskline.operators import rows as r
from maskline.plans import jobs
from maskline.queries import duck as d
from maskline.queries import harvesting as h
from maskline.queries import mapping as mq
from maskline.queries.base import Tables, query
from maskline.queries.duck import SEED
from maskline.queries.scalars import FACTOR, statement_cells
from maskline.shared import shared_dir, written
from maskline.sources import files


@query(f"SELECT {', '.join(f'{d.clean(x)} AS {x}' for x in r.LEDGER)} FROM ledger", "ledger")
def ledger_file(db: Tables) -> DataFrame:
    """The ledger as tab-delimited text and back."""
    path = shared_dir(db.spark) + "/ledger.tsv"
    files.write_tsv(db.ledger.withColumn("Notes", F.lit('a "quoted" note')), path)
    return r.project(files.read_tsv(db.spark, path))


def statement_folder(db: Tables) -> str:
    path = shared_dir(db.spark) + "/statements"
    files.write_cells(statement_cells(db), path)
    return path


@query("SELECT file, row_no, 'utf-8' AS encoding, c1, c2, c3, c4 FROM statements", "statements")
def statement_files(db: Tables) -> DataFrame:
    """Statements as CSV files and back: preamble, header and data in order."""
    got = files.read_cells(db.spark, statement_folder(db), "*.txt")
    return got.select("file", "row_no", "encoding", *(F.get("cells", F.lit(i)).alias(f"c{i + 1}") for i in range(4)))


@query("SELECT DISTINCT file FROM statements", "statements")
def input_files(db: Tables) -> DataFrame:
    return files.discover(db.spark, statement_folder(db), "*.txt").select(F.col("name").alias("file"))


@query(
    "SELECT DISTINCT category, term FROM (SELECT 'Names' AS category, given || ' ' || family AS term FROM people WHERE id % 3 = 0 UNION ALL SELECT 'Towns', given FROM people WHERE id % 5 = 0)", "people",
)
def term_list_table(db: Tables) -> DataFrame:
    """A ragged table with a column per list."""
    ragged = db.people.select(F.when(F.col("id") % 3 == 0, F.concat_ws(" ", F.lit(""), "given", "family")).alias("Names"), F.when(F.col("id") % 5 == 0, F.col("given")).otherwise(" ").alias("Towns"))
    return files.first_seen(files.read_terms(ragged)).select("category", "term")


@query("SELECT DISTINCT 'single' AS kind, trim(term) AS value FROM terms", "terms")
def pool_file(db: Tables) -> DataFrame:
    path = shared_dir(db.spark) + "/pool"
    db.terms.select(F.concat(F.lit(" "), "term")).write.text(path)
    return files.read_pool(db.spark, path, "single")


@query("SELECT category, real, fake FROM fakes", "ledger terms", mq.FAKES)
def saved_mapping(db: Tables) -> DataFrame:
    """The mapping of one seed, saved beside another seed's."""
    path, mapping = shared_dir(db.spark) + "/mappings", written(mq.term_fakes(db).select("category", "real", "fake"), shared_dir(db.spark), "fakes")
    files.write_mapping(mapping, path, SEED)
    files.write_mapping(mapping.withColumn("fake", F.lit("other")), path, "seed-2")
    return files.read_mapping(db.spark, path, SEED)


@query("SELECT 'ledger' AS name, count(*) AS n_rows FROM ledger UNION ALL SELECT 'accounts', count(*) FROM accounts", "ledger accounts")
def written_outputs(db: Tables) -> DataFrame:
    """Outputs by seed: the last run that passed replaces the earlier one; one that did not pass is not seen."""
    path = shared_dir(db.spark) + "/out"
    files.write_outputs({"ledger": db.accounts, "stale": db.terms}, path, SEED)
    files.write_outputs({"ledger": db.ledger, "accounts": db.accounts}, path, SEED)
    files.write_outputs({"ledger": db.terms, "leaky": db.terms}, path, SEED, passed=False, note="leaks")  # kept apart
    counts = None
    for name, df in sorted(files.read_outputs(db.spark, path, SEED).items()):
        part = df.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"))
        counts = part if counts is None else counts.union(part)
    return counts


@query("SELECT 'holdings' AS name, count(*) AS n_rows FROM holdings", "holdings")
def table_role(db: Tables) -> DataFrame:
    """The key table is found by its columns."""
    tables = {"accounts": db.accounts, "holdings": db.holdings, "ledger": db.ledger}
    name = files.role(tables, rel.KEY_TABLE)
    return tables[name].agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"))


_NAMED = "named AS (SELECT 'stmt' || l4 || '_' || given || ' ' || id || '.csv' AS file, l4, given, id FROM people)"


@query(
    "SELECT n.file, 'stmt' || coalesce(a.fake_last4, n.l4) || '_' || coalesce(f.fake, n.given) || ' ' || coalesce(b.fake_last4, CAST(n.id AS VARCHAR)) || '.csv' AS masked FROM named n LEFT JOIN numbers a ON lpad(a.key, 4, '0') = n.l4 AND regexp_matches(a.key, '^[0-9]+$') "
    "LEFT JOIN fakes f ON f.real = n.given AND f.category = 'name' LEFT JOIN numbers b ON lpad(b.key, 4, '0') = CAST(n.id AS VARCHAR)", "people ledger terms", f"{mq.FAKES}, {mq.NUMBERS}, {_NAMED}",
)
def masked_file_names(db: Tables) -> DataFrame:
    """Names of files: listed terms, and last fours wherever no other digit is beside them."""
    names = db.people.select(F.concat(F.lit("stmt"), "l4", F.lit("_"), "given", F.lit(" "), F.col("id").cast("string"), F.lit(".csv")).alias("file"))
    numbers = jobs.number_terms(db.ledger.select("account_num"), written(mq.account_fakes(db), shared_dir(db.spark), "numbers")).where("category = 'last4'")
    mapping = numbers.union(mq.term_fakes(db).select("category", "real", "fake"))
    return k.mask_file_names(names.withColumn("masked", F.col("file")), "masked", mapping, SEED)


@query(f"SELECT 'acctnum' AS category, account_num AS real, fake_number AS fake FROM (SELECT DISTINCT account_num FROM ledger WHERE regexp_matches(account_num, '[A-Za-z]') AND regexp_matches(account_num, '[0-9]')) JOIN numbers ON key = {d.key('account_num')} UNION ALL SELECT 'last4', lpad(key, 4, '0'), fake_last4 FROM numbers WHERE regexp_matches(key, '^[0-9]+$')", "ledger", mq.NUMBERS)
def number_terms(db: Tables) -> DataFrame:
    """Forms of account numbers that are safe anywhere in a text, and the bare last four."""
    return jobs.number_terms(db.ledger.select("account_num"), written(mq.account_fakes(db), shared_dir(db.spark), "numbers"))


@query(
    f"SELECT seq, CASE WHEN account_num = 'PP' THEN fake_number ELSE {d.scrub('account')} END AS account, coalesce(fake_number, account_num) AS account_num, {d.scrub('description')} || ' PP' AS memo FROM ledger LEFT JOIN numbers ON trim(account_num) <> '' AND key = {d.key('account_num')}", "ledger", mq.NUMBERS,
)
def word_accounts(db: Tables) -> DataFrame:
    """An account that is a word is replaced in account cells only."""
    table = db.ledger.select(F.col("seq").cast("long").alias("id"), F.when(F.col("account_num") == "PP", "PP").otherwise(F.col("account")).alias("account"), "account_num", F.concat("description", F.lit(" PP")).alias("memo"))
    empty = db.spark.createDataFrame([], "category string, real string, fake string")
    got = k.mask_table(table, empty, written(mq.account_fakes(db), shared_dir(db.spark), "numbers"), SEED)
    return got.select(F.col("id").cast("string").alias("seq"), "account", "account_num", "memo")


@query('SELECT id AS seq, col AS "column", kind, hit FROM leaks ORDER BY id, col LIMIT 10', "ledger terms", f"{h.LEAKS}, {h.cells(h.BOTH)}, {h.SCAN}")
def first_leaks(db: Tables) -> DataFrame:
    return c.first_leaks(c.leak_scan(db.ledger, "seq", list(h.BOTH), h.forbidden(db)), ["seq", "column"])


_ALL_PASSED = lambda *checks: f"SELECT unnest([{', '.join(repr(x) for x in checks)}]) AS \"check\", true AS passed FROM region WHERE r_regionkey = 0"


@query(_ALL_PASSED("leaks", "hit counts", "one to one", "untouched columns of ledger", "untouched columns of rules", "totals of ledger", "totals of rules", "determinism", "overall"))
def ledger_run(db: Tables) -> DataFrame:
    """A whole run over the ledger and its rules."""
    ledger = db.ledger
    return jobs.ledger_job(ledger.where("is_primary"), ledger.where("not is_primary"), db.terms, jobs.Options(SEED, factor=FACTOR))["report"]


@query("SELECT concat('rules:', seq) AS place, 'description' AS \"column\", 'Unlisted Word' AS hit, false AS passed FROM ledger WHERE NOT is_primary AND CAST(seq AS BIGINT) % 20 < 10", "ledger")
def rules_leak_refused(db: Tables) -> DataFrame:
    """A whole run whose rules alone have a term without a fake in some rows: each is told, and the run does not pass."""
    ledger, number = db.ledger, F.col("seq").cast("long")
    rules = ledger.where("not is_primary").withColumn("description", F.when(number % 20 < 10, F.concat("description", F.lit(" unlisted  WORD"))).otherwise(F.col("description")))
    done = jobs.ledger_job(ledger.where("is_primary"), rules, db.terms, jobs.Options(SEED))
    return done["leaks"].select("place", "column", "hit").crossJoin(done["report"].where("check = 'overall'").select("passed"))  # one row


_LATE = "bank_07.csv"


@query(f"SELECT CASE WHEN file = '{_LATE}' THEN 'batch=1' ELSE 'batch=0' END AS key, CASE WHEN file = '{_LATE}' THEN 'refused' ELSE 'published' END AS state, count(*) AS n_rows, CAST(count(*) FILTER (file = '{_LATE}' AND c2 LIKE '% %') AS BIGINT) AS n_leaks FROM statements GROUP BY 1, 2", "statements")
def stream_batches(db: Tables) -> DataFrame:
    """Statements in two batches of a stream; the late one has a forbidden term in every description and is kept apart with its leaks."""
    from maskline.sources.commits import PUBLISHED, REFUSED, Store
    from maskline.streaming.statements import mask_stream

    base = shared_dir(db.spark)
    leaky = db.statements.withColumn("c2", F.when((F.col("file") == _LATE) & F.col("c2").like("% %"), F.concat("c2", F.lit(" Unlisted Word"))).otherwise(F.col("c2")))
    cells = leaky.select("file", "row_no", F.array("c1", "c2", "c3", "c4").alias("cells"))
    files.write_mapping(mq.term_fakes(db).select("category", "real", "fake"), f"{base}/mapping", SEED)
    for late in (False, True):
        files.write_cells(cells.where((F.col("file") == _LATE) == late), f"{base}/in", "append")
        mask_stream(db.spark, f"{base}/in", f"{base}/mapping", f"{base}/out", SEED, f"{base}/checkpoint", FACTOR, db.terms.where("category = 'Blacklist'"), glob="*.txt").awaitTermination()
    store, out = Store(db.spark, f"{base}/out"), None
    for m in store.manifests():  # two batches
        n = lambda name, m=m: store.read(name, m.key, m.state).agg(F.count("*").alias(f"n_{name}"))
        part = n("rows").crossJoin(n("leaks")).select(F.lit(m.key).alias("key"), F.lit(m.state).alias("state"), "n_rows", "n_leaks")  # one row each
        out = part if out is None else out.union(part)
    assert {m.state for m in store.manifests()} == {PUBLISHED, REFUSED}
    return out


@query(_ALL_PASSED("leaks", "overall"))
def statements_run(db: Tables) -> DataFrame:
    """New statements under a saved mapping of names and runs."""
    mapping = written(mq.term_fakes(db).select("category", "real", "fake").union(jobs.row(mq.old_mapping(db), "run", "real", "fake")), shared_dir(db.spark), "mapping")
    return jobs.statements_job(statement_cells(db), mapping, SEED, FACTOR)["report"]


@query(_ALL_PASSED("blacklist", "determinism", "one to one", "totals of ledger.amount", "overall"))
def related_tables_report(db: Tables) -> DataFrame:
    """A whole run over the key table, accounts, ledger and statements."""
    tables = mq.related_tables(db) | {"ledger": db.ledger.withColumn("amount", F.col("amount").cast(t.AMOUNT))}
    return jobs.related_tables_job(tables, db.owners, jobs.Options(SEED, factor=FACTOR), statement_cells(db))["report"]
