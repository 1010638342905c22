"""Example tables shaped like the inputs of the library, derived from the benchmark tables.

Each view is one SQL statement that Spark and DuckDB read alike; later views use earlier ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")

VIEWS: dict[str, str] = {
    "people": """
SELECT c_custkey AS id, c_nationkey,
 concat('Na', translate(lpad(cast(c_custkey % 50 AS string),2,'0'),'0123456789','bdfgklmnpr')) AS given,
 concat('Ro', translate(lpad(cast(c_custkey AS string),6,'0'),'0123456789','bdfgklmnpr')) AS family,
 CASE c_custkey % 4 WHEN 0 THEN ' CK' WHEN 1 THEN ' LLC' WHEN 2 THEN ' Visa' ELSE '' END AS suffix,
 lpad(cast(c_custkey % 10000 AS string),4,'0') AS l4
FROM customer""",
    "ledger": """
SELECT cast(o_orderkey AS string) AS seq,
 cast(cast(o_orderdate AS date) AS string) AS date,
 concat('XFER TO ', l4, ' REF ', upper(substr(md5(cast(o_orderkey AS string)),1,9)),
   CASE WHEN o_orderkey % 3 = 0 THEN concat(' LOAN ', cast(10000 + o_orderkey * 37 AS string)) ELSE '' END,
   ' ', upper(given), ' ', upper(family), ' ', n_name) AS description,
 cast(cast(o_totalprice AS decimal(18,2)) AS string) AS amount,
 CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat(given,' ',family,suffix) END AS account,
 CASE WHEN id % 97 = 0 THEN 'PP' WHEN o_orderkey % 5 = 0 THEN ''
      WHEN o_orderkey % 5 = 2 THEN l4 WHEN o_orderkey % 5 = 3 THEN cast(id % 10000 AS string)
      ELSE concat('xxxx', l4) END AS account_num,
 CASE WHEN o_orderkey % 7 = 0 THEN r_name ELSE n_name END AS institution,
 o_orderstatus <> 'P' AS is_primary
FROM orders JOIN people ON o_custkey = id
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "terms": """
SELECT DISTINCT 'Names' AS category, concat(given,' ',family) AS term FROM people WHERE id % 3 = 0
UNION ALL SELECT DISTINCT 'Names', given FROM people
UNION ALL SELECT 'Towns', n_name FROM nation UNION ALL SELECT 'Towns', r_name FROM region
UNION ALL SELECT DISTINCT 'Blacklist', given FROM people WHERE id % 2 = 0
UNION ALL SELECT 'Blacklist', 'Unlisted Word'""",
    "properties": """
SELECT concat(cast(1 + s_suppkey % 900 AS string), ' Old ', translate(cast(s_suppkey % 40 AS string),'0123456789','bdfgklmnpr'), ' Rd, ',
   n_name, CASE WHEN s_suppkey % 2 = 0 THEN ', NJ, ' ELSE ', NJ ' END, lpad(cast(7000 + s_suppkey % 900 AS string),5,'0')) AS address,
 CASE WHEN s_suppkey % 10 = 9 THEN 'Commo' ELSE concat('G', cast(s_suppkey AS string), upper(substr(md5(cast(s_suppkey AS string)),1,2))) END AS prop,
 concat('Ho', translate(lpad(cast(s_suppkey AS string),5,'0'),'0123456789','bdfgklmnpr'),' LLC') AS llc,
 concat('xxxx', lpad(cast(s_suppkey * 13 % 10000 AS string),4,'0')) AS bank1
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "holdings": """
SELECT address, prop, llc, bank1 FROM properties
UNION ALL SELECT address, concat(prop, 'B'), concat('Al', llc), '' FROM properties WHERE prop LIKE '%1%'
UNION ALL SELECT '', concat(prop, '7'), '', 'cash' FROM properties WHERE prop LIKE '%2%'
UNION ALL SELECT ', ', concat(prop, '8'), concat('Ov', llc), '' FROM properties WHERE prop LIKE '%3%'""",
    "owners": """
SELECT category, term FROM terms WHERE category <> 'Names' OR term LIKE '% %5%' OR length(term) < 6
UNION ALL SELECT 'Names', substr(llc, 1, length(llc) - 4) FROM properties WHERE prop LIKE '%4%'
UNION ALL SELECT 'Names', concat(substr(llc, 1, length(llc) - 4), ' CK') FROM properties WHERE prop LIKE '%5%'""",
    "accounts": """
SELECT concat(given,' ',family,suffix) AS account, concat('xxxx',l4) AS account_num,
 concat(given,' ',family,suffix,' - xxxx',l4,' (',upper(substr(md5(cast(id AS string)),1,4)),')') AS unique_account_identifier
FROM people""",
    "statements": """
SELECT file, cast(row_number() OVER (PARTITION BY file ORDER BY sec, k) - 1 AS int) AS row_no, c1, c2, c3, c4 FROM (
 SELECT DISTINCT concat('bank_', lpad(cast(user_id % 20 AS string),2,'0'), '.csv') AS file, 0 AS sec, cast(0 AS bigint) AS k, 'Description' AS c1, '' AS c2, 'Summary Amt.' AS c3, '' AS c4 FROM events
 UNION ALL SELECT DISTINCT concat('bank_', lpad(cast(user_id % 20 AS string),2,'0'), '.csv'), 1, cast(0 AS bigint), 'Beginning balance as of 01/01/2024', '', '1,250.10', '' FROM events WHERE user_id % 20 < 15
 UNION ALL SELECT DISTINCT concat('bank_', lpad(cast(user_id % 20 AS string),2,'0'), '.csv'), 2, cast(0 AS bigint), 'Date', 'Description', 'Amount', 'Running Bal.' FROM events
 UNION ALL SELECT concat('bank_', lpad(cast(user_id % 20 AS string),2,'0'), '.csv'), 3, event_id,
   CASE WHEN event_id % 50 = 0 THEN '' ELSE cast(cast(ts AS date) AS string) END,
   CASE WHEN event_id % 50 = 0 THEN ' ' ELSE concat(upper(event_type),' ', upper(substr(md5(cast(event_id AS string)),1,8)),' ', cast(20000 + event_id * 31 AS string)) END,
   CASE WHEN event_id % 50 = 0 THEN '' WHEN event_id % 3 = 0 THEN concat('(', cast(cast(value AS decimal(18,2)) AS string), ')') WHEN event_id % 3 = 1 THEN concat('-', cast(cast(value AS decimal(18,2)) AS string)) ELSE cast(cast(value AS decimal(18,2)) AS string) END,
   CASE WHEN event_id % 50 = 0 THEN '' ELSE concat('$1,', lpad(cast(event_id % 1000 AS string),3,'0'), '.05') END FROM events) u""",
}

#: View -> what it reads.
NEEDS: dict[str, tuple[str, ...]] = {
    "people": ("customer",),
    "ledger": ("orders", "people", "nation", "region"),
    "terms": ("people", "nation", "region"),
    "properties": ("supplier", "nation"),
    "holdings": ("properties",),
    "owners": ("terms", "properties"),
    "accounts": ("people",),
    "statements": ("events",),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view, registered under its name as a temporary view of this session."""
    for need in NEEDS.get(name, ()):
        view(spark, sf_dir, need)
    df = spark.sql(VIEWS[name]) if name in VIEWS else spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df.createOrReplaceTempView(name)
    return df


def ctes(*names: str) -> str:
    """Common table expressions for the oracle, with what they need, in order."""
    wanted: set[str] = set()

    def add(name: str) -> None:
        if name in VIEWS:
            wanted.add(name)
            for need in NEEDS[name]:
                add(need)

    for name in names:
        add(name)
    return ", ".join(f"{n} AS ({sql})" for n, sql in VIEWS.items() if n in wanted)
