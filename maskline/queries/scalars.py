"""Queries over rows, cells and single values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskline.functions import text as t
from maskline.operators import rows as r
from maskline.queries import duck as d
from maskline.queries.base import Tables, query
from maskline.queries.duck import SEED

FACTOR = "1.0730"
CELLS = "[c1, c2, c3, c4]"
WIDTH = f"greatest({', '.join(f'''CASE WHEN {d.clean(c)} <> '' THEN {k} ELSE 0 END''' for k, c in enumerate(('c1', 'c2', 'c3', 'c4'), 1))})"
FILLED = f"({' + '.join(f'''CASE WHEN {d.clean(c)} <> '' THEN 1 ELSE 0 END''' for c in ('c1', 'c2', 'c3', 'c4'))})"
HEADERS = f"""headers AS (SELECT file, CAST(coalesce(min(CASE WHEN 'description' IN ({', '.join(f'lower({d.clean(c)})' for c in ('c1', 'c2', 'c3', 'c4'))}) AND {FILLED} >= 3 THEN row_no END), 0) AS INTEGER) AS header_row
 FROM statements GROUP BY file)"""


def statement_cells(db: Tables) -> DataFrame:
    return db.statements.select("file", "row_no", F.array("c1", "c2", "c3", "c4").alias("cells"))


@query(f"SELECT {', '.join(f'{d.clean(c)} AS {c}' for c in r.LEDGER)} FROM ledger", "ledger")
def ledger_project(db: Tables) -> DataFrame:
    return r.project(db.ledger.withColumn("notes", F.lit("dropped")))


@query(f"SELECT file, row_no, c1, c2, c3, c4 FROM statements WHERE {WIDTH} > 0", "statements")
def drop_empty_rows(db: Tables) -> DataFrame:
    return db.statements.where(r.not_empty(F.array("c1", "c2", "c3", "c4")))


@query(f"SELECT file, row_no, CAST({WIDTH} AS INTEGER) AS width FROM statements", "statements")
def used_width(db: Tables) -> DataFrame:
    return statement_cells(db).select("file", "row_no", r.used_width(F.col("cells")).alias("width"))


@query("SELECT file, header_row FROM headers", "statements", HEADERS)
def bank_header_row(db: Tables) -> DataFrame:
    return r.statement_headers(statement_cells(db))


_FIT = " AND ".join(
    rf"({d.clean(c)} = '' OR (length({d.clean(c)}) <= 40 AND len(regexp_split_to_array({d.clean(c)}, '\s+')) <= 6 AND NOT regexp_matches({d.clean(c)}, '^\d{{4}}-\d{{2}}-\d{{2}}$|^\d{{1,2}}/\d{{1,2}}/\d{{2,4}}$')))" for c in ("c1", "c2", "c3", "c4")
)


@query(
    f"""SELECT f.file, CAST(coalesce(h.row_no, 0) AS INTEGER) AS header_row FROM (SELECT DISTINCT file FROM statements) f LEFT JOIN
 (SELECT file, row_no, row_number() OVER (PARTITION BY file ORDER BY {FILLED} DESC, row_no) AS k FROM statements WHERE row_no < {r.HEADER_DEPTH} AND {FILLED} > 0 AND {_FIT}) h ON f.file = h.file AND h.k = 1""",
    "statements",
)
def tab_header_row(db: Tables) -> DataFrame:
    return r.table_headers(statement_cells(db))


@query("SELECT s.file, row_no, CASE WHEN row_no < header_row THEN 'preamble' WHEN row_no = header_row THEN 'header' ELSE 'data' END AS section FROM statements s JOIN headers h ON s.file = h.file", "statements", HEADERS)
def bank_sections(db: Tables) -> DataFrame:
    cells = statement_cells(db)
    return r.sections(cells, r.statement_headers(cells)).select("file", "row_no", "section")


@query(f"SELECT file, CAST(sum(CASE WHEN {WIDTH} > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_rows, CAST(max({WIDTH}) AS BIGINT) AS used_columns, CAST(4 AS BIGINT) AS reported_columns FROM statements GROUP BY file", "statements")
def table_profile(db: Tables) -> DataFrame:
    return r.profile(statement_cells(db))


_MONEY = f"(lower(name) IN ({', '.join(repr(x) for x in d.MONEY_NAMES)}) OR regexp_matches(lower(name), '{'|'.join(d.MONEY_WORDS)}'))"


@query(
    "SELECT file, place, name FROM (" + " UNION ALL ".join(f"SELECT s.file, CAST({k} AS BIGINT) AS place, c{k} AS name FROM statements s JOIN headers h ON s.file = h.file AND s.row_no = h.header_row" for k in range(1, 5)) + f") WHERE {_MONEY}",
    "statements", HEADERS,
)
def money_columns(db: Tables) -> DataFrame:
    cells = statement_cells(db)
    return r.money_places(cells, r.statement_headers(cells))


@query("SELECT seq, is_primary FROM ledger WHERE trim(account) <> '' OR trim(account_num) <> '' OR trim(description) <> '' OR trim(institution) <> ''", "ledger")
def identifier_records(db: Tables) -> DataFrame:
    return r.with_identifiers(db.ledger).select("seq", "is_primary")


@query("SELECT is_primary, count(*) AS n FROM ledger GROUP BY is_primary", "ledger")
def pooled_records(db: Tables) -> DataFrame:
    led = db.ledger
    return r.pooled([led.where("is_primary")], [led.where("not is_primary")]).groupBy("is_primary").agg(F.count("*").alias("n"))


@query("SELECT unnest(['memo', 'branch']) AS missing, (SELECT count(*) FROM ledger) AS n_rows", "ledger")
def missing_target_columns(db: Tables) -> DataFrame:
    led = db.ledger
    missing = r.missing_columns(led, ["Description", "memo", "Account", "branch"])
    return led.agg(F.count("*").alias("n_rows")).select(F.explode(F.array(*map(F.lit, missing))).alias("missing"), "n_rows")


@query(f"SELECT doc_id, unnest({d.runs('text')}) AS run FROM documents UNION ALL SELECT CAST(seq AS BIGINT), unnest({d.runs('description')}) FROM ledger", "ledger")
def digit_runs(db: Tables) -> DataFrame:
    docs = db.documents.select("doc_id", F.explode(t.digit_runs(F.col("text"))).alias("run"))
    return docs.union(db.ledger.select(F.col("seq").cast("bigint"), F.explode(t.digit_runs(F.col("description")))))


@query(f"SELECT doc_id, unnest({d.codes('text')}) AS code FROM documents UNION ALL SELECT CAST(seq AS BIGINT), unnest({d.codes('description')}) FROM ledger", "ledger")
def alnum_codes(db: Tables) -> DataFrame:
    docs = db.documents.select("doc_id", F.explode(t.alnum_codes(F.col("text"))).alias("code"))
    return docs.union(db.ledger.select(F.col("seq").cast("bigint"), F.explode(t.alnum_codes(F.col("description")))))


@query(f"SELECT account_num, key, CASE WHEN regexp_matches(key, '^[0-9]+$') THEN lpad(key, 4, '0') END AS bare FROM (SELECT DISTINCT account_num, {d.key('account_num')} AS key FROM ledger)", "ledger")
def account_key(db: Tables) -> DataFrame:
    return db.ledger.select("account_num").distinct().withColumn("key", t.account_key(F.col("account_num"))).withColumn("bare", t.bare_form(F.col("key")))


_CORE, _SUFFIX = d.core("account")


@query(f"SELECT account, {_CORE} AS core, {_SUFFIX} AS suffix FROM (SELECT DISTINCT account FROM ledger WHERE account <> '')", "ledger")
def split_core(db: Tables) -> DataFrame:
    return db.ledger.where("account <> ''").select("account").distinct().withColumn("x", t.split_core(F.col("account"))).select("account", "x.core", "x.suffix")


_FORM = r"'^(.*?) - (\S+) \(([^)]+)\)\s*$'"


@query(f"SELECT unique_account_identifier AS text, trim(regexp_extract(unique_account_identifier, {_FORM}, 1)) AS name, trim(regexp_extract(unique_account_identifier, {_FORM}, 2)) AS number, trim(regexp_extract(unique_account_identifier, {_FORM}, 3)) AS code FROM accounts", "accounts")
def compound_parse(db: Tables) -> DataFrame:
    x = F.col("unique_account_identifier")
    return db.accounts.select(x.alias("text"), t.compound_parts(x).alias("p")).select("text", "p.name", "p.number", "p.code")


PARSED = r"""parsed AS (SELECT DISTINCT address, p[1] AS street, coalesce(p[2], '') AS city,
 coalesce(nullif(regexp_extract(address, '\b([A-Za-z]{2})\b[,\s]*\d{5}', 1), ''), regexp_extract(address, ',\s*([A-Za-z]{2})\b', 1)) AS state, regexp_extract(address, '\b(\d{5})\b', 1) AS zip
 FROM (SELECT address, list_filter(list_transform(str_split(address, ','), lambda s: trim(s)), lambda s: s <> '') AS p FROM properties))"""


@query("SELECT address, street, city, state, zip FROM parsed", "properties", PARSED)
def address_parse(db: Tables) -> DataFrame:
    return db.properties.select("address").distinct().withColumn("x", t.parse_address(F.col("address"))).select("address", "x.*")


@query(f"SELECT DISTINCT code, {d.shape('code', 'code')} AS fake FROM (SELECT unnest({d.codes('description')}) AS code FROM ledger)", "ledger")
def shape_fake(db: Tables) -> DataFrame:
    codes = db.ledger.select(F.explode(t.alnum_codes(F.col("description"))).alias("code")).distinct()
    return codes.select("code", t.shape_fake(F.col("code"), SEED, "code").alias("fake"))


_AMOUNTS = "SELECT file, row_no, c3 AS text FROM statements UNION ALL SELECT file, row_no, c4 FROM statements"


def amounts(db: Tables) -> DataFrame:
    s = db.statements
    return s.select("file", "row_no", F.col("c3").alias("text")).union(s.select("file", "row_no", "c4"))


@query(f"SELECT file, row_no, text, CAST({d.money('text')} AS DECIMAL(18,2)) AS value FROM ({_AMOUNTS})", "statements")
def parse_money(db: Tables) -> DataFrame:
    return amounts(db).withColumn("value", t.parse_money(F.col("text")))


@query(f"SELECT file, row_no, text, {d.scaled_text('text', FACTOR)} AS new FROM ({_AMOUNTS})", "statements")
def scale_amount_text(db: Tables) -> DataFrame:
    return amounts(db).withColumn("new", t.scale_amount_text(F.col("text"), FACTOR))


@query(f"SELECT l_orderkey, l_linenumber, {d.scaled('CAST(l_extendedprice AS DECIMAL(18,2))', FACTOR)} AS price FROM lineitem")
def scale_amounts(db: Tables) -> DataFrame:
    return db.lineitem.select("l_orderkey", "l_linenumber", t.scale(F.col("l_extendedprice"), FACTOR).alias("price"))


@query("SELECT o_orderkey, strftime(CAST(o_orderdate AS TIMESTAMP), '%-m/%-d/%Y') AS date, CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) ELSE 'part' END AS amount FROM orders")
def ledger_text_export(db: Tables) -> DataFrame:
    whole = t.number_text(F.col("o_totalprice"))
    return db.orders.select("o_orderkey", t.date_text(F.col("o_orderdate").cast("timestamp")).alias("date"), F.when(F.col("o_totalprice") == F.floor("o_totalprice"), whole).otherwise("part").alias("amount"))


@query(f"SELECT doc_id, {d.scrub('text')} AS text FROM documents")
def mask_documents(db: Tables) -> DataFrame:
    return db.documents.select("doc_id", t.scrub_codes(F.col("text"), SEED).alias("text"))


@query(f"SELECT conv_id, turn, {d.scrub('text')} AS text FROM conversations")
def mask_conversations(db: Tables) -> DataFrame:
    return db.conversations.select("conv_id", "turn", t.scrub_codes(F.col("text"), SEED).alias("text"))


@query(f"SELECT seq, {d.scrub('description')} AS description FROM ledger", "ledger")
def scrub_codes(db: Tables) -> DataFrame:
    return db.ledger.select("seq", t.scrub_codes(F.col("description"), SEED).alias("description"))
