"""Checks that prove a run: leaks, hit counts, untouched columns, determinism, bijection, joins and totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskline.functions import text as t
from maskline.operators.identifiers import locate_terms
from maskline.shared import shared_dir, written


def leak_terms(terms: DataFrame, names: DataFrame, numbers: DataFrame) -> DataFrame:
    """(category, term): words (listed terms, account names) and digits (what numbers holds in term: last fours, runs, codes) that must not come out."""
    word = terms.select(F.lit("word").alias("category"), "term").union(names.select(F.lit("word"), "term"))
    return word.union(numbers.select(F.lit("digit"), "term")).where("term <> ''").distinct()


def leak_scan(df: DataFrame, id_col: str, columns: Sequence[str], terms: DataFrame) -> DataFrame:
    """(id, column, kind, hit): one leak per cell; words before digits, then the first place, then the longest term."""
    found = locate_terms(df, id_col, list(columns), terms)
    first = F.min(F.struct((F.col("category") != "word").alias("p"), "at", (-F.col("n")).alias("n"), "category", "term")).alias("b")
    return found.groupBy(id_col, "column").agg(first).select(id_col, "column", F.col("b.category").alias("kind"), F.col("b.term").alias("hit"))


def digit_leaks(df: DataFrame, id_col: str, column: str, numbers: DataFrame) -> DataFrame:
    """(id, term, n): numbers that stand in a cell between characters that are no ASCII letters or digits."""
    tokens = df.select(id_col, F.explode(t.alnum_tokens(F.col(column))).alias("term"))
    return tokens.join(numbers.select("term").distinct(), "term").groupBy(id_col, "term").agg(F.count("*").alias("n"))


def leak_gate(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: leaks found before (the scanner works if more than 0) and after (must be 0)."""
    counts = before.agg(F.count("*").alias("leaks_before")).crossJoin(after.agg(F.count("*").alias("leaks_after")))  # one row each
    return counts.withColumn("passed", (F.col("leaks_before") > 0) & (F.col("leaks_after") == 0))


def first_leaks(leaks: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    """The first n leaks (or failing rules) for a report."""
    return leaks.orderBy(*order).limit(n)


def blacklist_scan(tables: dict[str, tuple[DataFrame, str, Sequence[str]]], terms: DataFrame) -> DataFrame:
    """(table, term, n_cells, first_id, column, context): blacklist terms in all cells of all tables, with the first cell that has each and what surrounds it.

    Places alone are compared; a cell is fetched only where it is a term's first.
    """
    out = None
    for name, (df, id_col, columns) in tables.items():
        folder = shared_dir(df.sparkSession)
        hits = locate_terms(df, id_col, list(columns), terms).select("term", id_col, "column", "at", "n")
        # one row per cell, then one per term: no cell is counted twice and no list is built
        cells = hits.groupBy("term", id_col, "column").agg(F.min(F.struct("at", "n")).alias("at")).withColumn("id", F.col(id_col).cast("string"))
        first = F.min_by(F.struct(id_col, "id", "column", "at"), F.struct(F.length("id"), "id", "column")).alias("f")
        won = written(cells.groupBy("term").agg(F.count("*").alias("n_cells"), first).select("term", "n_cells", f"f.{id_col}", "f.id", "f.column", "f.at"), folder, "first")
        one = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("cell")) for c in columns))).alias("x")
        texts = df.join(won.select(id_col).distinct(), id_col, "left_semi").select(id_col, one).select(id_col, "x.*")
        both = won.join(texts.groupBy(id_col, "column").agg(F.min("cell").alias("cell")), [id_col, "column"])
        part = both.select(F.lit(name).alias("table"), "term", "n_cells", F.col("id").alias("first_id"), "column", t.clip(F.col("cell"), F.col("at.at"), F.col("at.n")).alias("context"))
        out = part if out is None else out.union(part)
    return out


def _matches(df: DataFrame, columns: Sequence[str], sides: DataFrame) -> DataFrame:
    """(rule, side, n): how often each text of sides (rule, text, side) stands in the columns.

    A text of ASCII letters and digits is a token between other characters; any other is found by its words.
    """
    plain = sides.where("text rlike '^[A-Za-z0-9]+$'").withColumn("w", F.lower("text"))
    tokens = df.select(F.explode(F.concat(*(t.alnum_tokens(F.lower(F.col(f"`{c}`"))) for c in columns))).alias("w"))
    found = tokens.join(plain, "w").select("rule", "side")
    worded = sides.where("not text rlike '^[A-Za-z0-9]+$'").withColumnRenamed("text", "term")
    places = locate_terms(df.withColumn("_one", F.lit(1)), "_one", list(columns), worded, ("rule", "side"))
    return found.union(places.select("rule", "side")).groupBy("rule", "side").agg(F.count("*").alias("n"))


def hit_counts(before: DataFrame, after: DataFrame, columns: str | Sequence[str], rules: DataFrame) -> DataFrame:
    """(rule, mode, before, after, left_over, passed) of rules (rule, mode, real, fake): matches of reals in the input, of fakes and of reals in the output.

    Mode exact wants equal counts, drop wants no fewer fakes than there were reals and none of these left, info always
    passes. Case does not count; reals and fakes have any number of words. The rules are written once, as each side reads them.
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    rules = written(rules, shared_dir(before.sparkSession), "rules")
    side = lambda c: F.struct(F.col(c).alias("text"), F.lit(c).alias("side"))
    reals = rules.select("rule", F.explode(F.array(side("real"))).alias("x")).select("rule", "x.*")
    both = rules.select("rule", F.explode(F.array(side("real"), side("fake"))).alias("x")).select("rule", "x.*")
    one = _matches(before, columns, reals).groupBy("rule").agg(F.sum("n").alias("before"))
    of = lambda name: F.sum(F.when(F.col("side") == name, F.col("n")).otherwise(0))
    two = _matches(after, columns, both).groupBy("rule").agg(of("fake").alias("after"), of("real").alias("left_over"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    counts = rules.select("rule", "mode").distinct().join(one, "rule", "left").join(two, "rule", "left").select("rule", "mode", zero("before"), zero("after"), zero("left_over"))
    passed = F.when(F.col("mode") == "exact", F.col("before") == F.col("after")).when(F.col("mode") == "drop", (F.col("after") >= F.col("before")) & (F.col("left_over") == 0)).otherwise(True)
    return counts.withColumn("passed", passed)


#: Buckets of a table's rows whose sums are compared before any row is.
BUCKETS = 4096


def checksums(df: DataFrame, keys: Sequence[str], columns: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """(bucket, column, n, total): of each bucket of rows by key and each column, the number of rows and the sum of their hashes, which no order changes."""
    bucket = F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in keys)), F.lit(buckets)).alias("bucket")
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.xxhash64(*(F.col(f"`{k}`") for k in keys), F.col(f"`{c}`"), F.col(f"`{c}`").isNull()).alias("h")) for c in columns))
    rows = df.select(bucket, F.explode(each).alias("x"))
    return rows.groupBy("bucket", "x.column").agg(F.count("*").alias("n"), F.sum(F.col("x.h").cast("decimal(20,0)")).alias("total"))


def unequal_buckets(before: DataFrame, after: DataFrame, keys: Sequence[str], columns: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """(bucket, column) whose sums differ between two tables; buckets * columns rows at most."""
    a, b = (checksums(df, keys, columns, buckets).select("bucket", "column", F.struct("n", "total").alias(name)) for df, name in ((before, "a"), (after, "b")))
    return a.join(b, ["bucket", "column"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("bucket", "column")


def _suspects(df: DataFrame, keys: Sequence[str], columns: Sequence[str], bad: DataFrame, buckets: int) -> DataFrame:
    """(keys..., column, value) of the cells in unequal buckets."""
    bucket = F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in keys)), F.lit(buckets)).alias("bucket")
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))
    cells = df.select(*(F.col(f"`{k}`") for k in keys), bucket, F.explode(each).alias("x")).select(*(f"`{k}`" for k in keys), "bucket", "x.*")
    return cells.join(F.broadcast(bad), ["bucket", "column"], "left_semi").drop("bucket")  # buckets * columns rows at most


def integrity(before: DataFrame, after: DataFrame, id_col: str, columns: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """(id, column, n_gone, n_new, old, new): per id, the cells of columns that only one side has; empty if nothing changed.

    Sums over buckets of ids are compared first, and only where they differ are
    cells counted by id and value, so an id may occur any number of times. old
    and new are the least of the values that are gone and that are new. Rows
    that only one side has are gone, or new, in every column.
    """
    one, two = (df.select(F.col(f"`{id_col}`"), *(F.col(f"`{c}`").cast("string").alias(c) for c in columns)) for df in (before, after))
    bad = written(unequal_buckets(one, two, [id_col], columns, buckets), shared_dir(before.sparkSession), "unequal")
    side = lambda df, n: _suspects(df, [id_col], columns, bad, buckets).withColumn("_n", F.lit(n))
    counts = side(one, -1).union(side(two, 1)).groupBy(id_col, "column", "value").agg(F.sum("_n").alias("d")).where("d <> 0")
    gone, new = F.col("d") < 0, F.col("d") > 0
    return counts.groupBy(id_col, "column").agg(
        F.sum(F.when(gone, -F.col("d")).otherwise(0)).alias("n_gone"), F.sum(F.when(new, F.col("d")).otherwise(0)).alias("n_new"), F.min(F.when(gone, F.col("value"))).alias("old"), F.min(F.when(new, F.col("value"))).alias("new")
    )


def bijection(mapping: DataFrame) -> DataFrame:
    """(fake, n_reals): fakes that stand for more than one real; empty if the mapping is one to one."""
    return mapping.groupBy("fake").agg(F.count_distinct(F.concat_ws("|", "category", F.lower("real"))).alias("n_reals")).where("n_reals > 1")


def determinism(one: DataFrame, two: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: distinct rows that two builds do not have equally often. Only buckets with unequal sums are counted row by row."""
    names = [f"`{c}`" for c in one.columns]
    whole = [df.select(F.to_json(F.struct(*(F.col(c).cast("string") for c in names)), {"ignoreNullFields": "false"}).alias("row")) for df in (one, two)]
    bad = written(unequal_buckets(*whole, ["row"], ["row"], buckets), shared_dir(one.sparkSession), "unequal")
    side = lambda df, n: _suspects(df, ["row"], ["row"], bad, buckets).withColumn("_n", F.lit(n))
    diff = side(whole[0], -1).union(side(whole[1], 1)).groupBy("row").agg(F.sum("_n").alias("d")).where("d <> 0")
    return diff.agg(F.count("*").alias("n_different")).withColumn("passed", F.col("n_different") == 0)


def join_preservation(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], on: str) -> DataFrame:
    """One row: rows of the join of two tables before and after masking. Key counts are joined, not the rows."""
    def size(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        count = lambda df, c: df.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias(c))
        return count(a, "x").join(count(b, "y"), on).agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias(name))

    return size(*before, "rows_before").crossJoin(size(*after, "rows_after")).withColumn("passed", F.col("rows_before") == F.col("rows_after"))


def amount_tieout(before: DataFrame, after: DataFrame, column: str, factor: str) -> DataFrame:
    """One row: totals before and after, and whether they tie within half a cent per row."""
    total = lambda df, c: df.agg(F.sum(F.col(column).cast("decimal(18,2)")).cast("decimal(28,2)").alias(c), F.count(column).alias(f"{c}_n"))
    both = total(before, "total_before").crossJoin(total(after, "total_after"))
    gap = F.abs(F.col("total_after").cast("decimal(32,6)") - F.col("total_before").cast("decimal(24,2)") * F.lit(factor).cast("decimal(6,4)"))
    return both.select("total_before", "total_after", (gap <= F.col("total_before_n") * F.lit("0.005").cast("decimal(4,3)")).alias("passed"))


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, passed): one row per check (a one-row table with passed), and the overall result."""
    out = None
    for name, df in checks.items():
        part = df.select(F.lit(name).alias("check"), "passed")
        out = part if out is None else out.union(part)
    return out.union(out.agg(F.lit("overall").alias("check"), F.coalesce(F.bool_and("passed"), F.lit(False)).alias("passed")))
