"""Row shapes: projection by header, empty rows, used width, and header search under a preamble."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskline.functions import text as t

LEDGER = ("seq", "date", "description", "amount", "account", "account_num", "institution")
IDENTIFIERS = ("account", "account_num", "description", "institution")
#: Rows in which a table's header is looked for.
HEADER_DEPTH = 30


def heading(name: str) -> str:
    """A column's name for comparison: lower case, ``_`` as a space, ``account num`` as ``account #``."""
    low = name.strip().lower().replace("_", " ")
    return "account #" if low == "account num" else low


def column_of(df: DataFrame, name: str) -> Column:
    """A column by name, in any case and with white space around; empty text if there is none."""
    found = next((c for c in df.columns if c.strip().lower() == name.lower()), None)
    return t.clean(F.col(f"`{found}`")) if found is not None else F.lit("")


def project(df: DataFrame, names: Sequence[str] = LEDGER, keep: Sequence[str] = ()) -> DataFrame:
    """The named columns, in order, as clean text; what is missing is empty and what is not named goes."""
    return df.select(*(column_of(df, n).alias(n) for n in names), *(F.col(f"`{k}`") for k in keep))


def missing_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    have = {c.strip().lower() for c in df.columns}
    return [w for w in wanted if w.lower() not in have]


def has_columns(df: DataFrame, wanted: Sequence[str]) -> bool:
    """True if the table can play the role that needs these columns."""
    return not missing_columns(df, wanted)


def with_identifiers(df: DataFrame, names: Sequence[str] = IDENTIFIERS) -> DataFrame:
    """Rows with at least one identifier field that is not empty."""
    keep = F.lit(False)
    for n in names:
        keep = keep | t.filled(F.col(n))
    return df.where(keep)


def pooled(primary: Sequence[DataFrame], secondary: Sequence[DataFrame], names: Sequence[str] = IDENTIFIERS) -> DataFrame:
    """Identifier records of all tables under one schema, marked by their rank."""
    out = None
    for tables, mark in ((primary, True), (secondary, False)):
        for df in tables:
            part = with_identifiers(project(df, names), names).withColumn("is_primary", F.lit(mark))
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no tables")
    return out


def used_width(cells: Column) -> Column:
    """Place of the last cell that is not empty, 0 if there is none."""
    places = F.transform(cells, lambda c, i: F.when(t.filled(c), i + 1).otherwise(F.lit(0)))
    return F.coalesce(F.array_max(places), F.lit(0)).cast("int")


def clamp(cells: Column) -> Column:
    return F.slice(cells, 1, used_width(cells))


def not_empty(cells: Column) -> Column:
    return F.exists(cells, t.filled)


def filled_cells(cells: Column) -> Column:
    return F.size(F.filter(cells, t.filled))


def statement_headers(rows: DataFrame, name: str = "description", least: int = 3) -> DataFrame:
    """(file, header_row): the first row of rows (file, row_no, cells) with the named cell and enough others, else 0."""
    hit = F.exists("cells", lambda c: F.lower(t.clean(c)) == name.lower()) & (filled_cells(F.col("cells")) >= least)
    return rows.groupBy("file").agg(F.coalesce(F.min(F.when(hit, F.col("row_no"))), F.lit(0)).cast("int").alias("header_row"))


def looks_like_header(cells: Column) -> Column:
    """Every filled cell is short (40 characters, 6 words) and no date."""
    fine = lambda c: ~t.filled(c) | ((F.length(t.clean(c)) <= 40) & (F.size(F.split(t.clean(c), r"\s+")) <= 6) & ~t.is_date_like(t.clean(c)))
    return not_empty(cells) & F.forall(cells, fine)


def table_headers(rows: DataFrame, depth: int = HEADER_DEPTH) -> DataFrame:
    """(file, header_row): the fullest header-like row among the first, the earliest of equals, else 0."""
    fit = (F.col("row_no") < depth) & looks_like_header(F.col("cells"))
    best = F.max(F.when(fit, F.struct(filled_cells(F.col("cells")).alias("n"), (-F.col("row_no")).alias("at"))))
    return rows.groupBy("file").agg(best.alias("b")).select("file", F.coalesce(-F.col("b.at"), F.lit(0)).cast("int").alias("header_row"))


def sections(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """rows with section: preamble, header or data. headers has one row per file."""
    at = F.col("header_row")
    kind = F.when(F.col("row_no") < at, "preamble").when(F.col("row_no") == at, "header").otherwise("data")
    return rows.join(headers, "file").withColumn("section", kind)


def profile(rows: DataFrame) -> DataFrame:
    """(file, n_rows with a filled cell, used_columns, reported_columns)."""
    return rows.groupBy("file").agg(
        F.count_if(not_empty(F.col("cells"))).alias("n_rows"), F.max(used_width(F.col("cells"))).cast("bigint").alias("used_columns"), F.max(F.size("cells")).cast("bigint").alias("reported_columns")
    )


def money_places(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """(file, place, name): header cells that name money, by whole name or by a word in it."""
    named = rows.join(headers, "file").where("row_no = header_row").select("file", F.posexplode("cells").alias("place", "name"))
    low = F.lower(t.clean(F.col("name")))
    hit = low.isin(*t.MONEY_NAMES)
    for w in t.MONEY_WORDS:
        hit = hit | low.contains(w)
    return named.where(hit).select("file", (F.col("place") + 1).cast("bigint").alias("place"), "name")
