"""Harvest of identifiers from tables and texts, canonical values, and where known terms stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskline.functions import text as t
from maskline.shared import shared_dir, written

#: Bits of the filter of first words for each of them, and at most (4 MB): it is always small enough to send.
FILTER_BITS, MOST_BITS = 16, 1 << 25
#: A term with more than this share of all places is joined apart from the others, by broadcast: fewer terms than HOT_TERMS can have it.
HOT_SHARE, HOT_TERMS = 0.005, 200


def keyed(records: DataFrame) -> DataFrame:
    """Records with an account number, by account key."""
    return records.where(t.filled(F.col("account_num"))).withColumn("key", t.account_key(F.col("account_num")))


def account_identifiers(records: DataFrame) -> DataFrame:
    """One row per account key: its forms and names, and how often it occurs. Forms and names are short distinct lists."""
    once = keyed(records).groupBy("key", "account_num", "account").agg(F.count("*").alias("n"), F.count_if("is_primary").alias("p"))
    return once.groupBy("key").agg(
        F.array_sort(F.collect_set("account_num")).alias("forms"), F.array_sort(F.collect_set(F.when(F.col("account") != "", F.col("account")))).alias("names"),
        F.sum("n").alias("n_records"), F.sum("p").alias("n_primary"),
    )


def identifier_counts(records: DataFrame) -> DataFrame:
    """(key, kind, value, n, n_primary): a row for each form and each name of an account, with how often it occurs. No key is one row."""
    part = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("value"))
    each = keyed(records).select("key", "is_primary", F.explode(F.array(part("form", "account_num"), part("name", "account"))).alias("x")).select("key", "is_primary", "x.*")
    return each.where("value <> ''").groupBy("key", "kind", "value").agg(F.count("*").alias("n"), F.count_if("is_primary").alias("n_primary"))


def account_summary(records: DataFrame, top: int = 3) -> DataFrame:
    """(key, n_forms, n_names, n_records, n_primary, names): numbers of an account, and its most frequent names, top at most; ties by name."""
    counts = written(identifier_counts(records), shared_dir(records.sparkSession), "counts")
    of = lambda kind, c: F.sum(F.when(F.col("kind") == kind, c).otherwise(0))
    sums = counts.groupBy("key").agg(of("form", F.lit(1)).alias("n_forms"), of("name", F.lit(1)).alias("n_names"), of("form", F.col("n")).alias("n_records"), of("form", F.col("n_primary")).alias("n_primary"))
    order = Window.partitionBy("key").orderBy(F.desc("n"), "value")
    first = counts.where("kind = 'name'").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top)  # no task keeps more of a key
    names = first.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "value"))), lambda x: x["value"]).alias("names"))
    return sums.join(names, "key", "left").select("key", "n_forms", "n_names", "n_records", "n_primary", F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def institution_counts(records: DataFrame) -> DataFrame:
    """(key, institution, n, n_primary)."""
    return keyed(records).where("institution <> ''").groupBy("key", "institution").agg(F.count("*").alias("n"), F.count_if("is_primary").alias("n_primary"))


def canonical_institutions(records: DataFrame) -> DataFrame:
    """(key, institution): the most frequent among primary records, or among all if no primary record has one; ties by name."""
    counts = institution_counts(records)
    order = Window.partitionBy("key").orderBy(F.desc(F.col("n_primary") > 0), F.desc(F.when(F.col("n_primary") > 0, F.col("n_primary")).otherwise(F.col("n"))), "institution")
    return counts.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("key", "institution")


def institution_conflicts(records: DataFrame) -> DataFrame:
    return institution_counts(records).groupBy("key").agg(F.count("*").alias("n_institutions")).where("n_institutions > 1")


def name_only_accounts(records: DataFrame) -> DataFrame:
    """Account names that never occur with a number."""
    named = records.where("account <> ''")
    return named.where("account_num = ''").select("account").distinct().join(named.where("account_num <> ''").select("account").distinct(), "account", "left_anti")


def inventory(records: DataFrame) -> DataFrame:
    """(category, value): distinct runs, codes, last fours, names and numbers."""
    part = lambda category, value: F.struct(F.lit(category).alias("category"), value.alias("value"))
    each = lambda category, values: F.transform(values, lambda v: part(category, v))
    key = t.account_key(F.col("account_num"))
    one = lambda category, value: F.when(value != "", F.array(part(category, value))).otherwise(F.array().cast("array<struct<category:string,value:string>>"))
    last = F.when(F.col("account_num") != "", F.coalesce(t.bare_form(key), F.lit(""))).otherwise("")
    found = F.concat(
        each("run", t.digit_runs(F.col("description"))), each("code", t.alnum_codes(F.col("description"))), one("last_four", last), one("account_name", F.col("account")), one("account_num", F.col("account_num"))
    )
    return records.select(F.explode(found).alias("x")).select("x.category", "x.value").distinct()


def harvest(parts: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(category, value): distinct clean values of a column of each table, by category; ``a/b`` names are category a."""
    out = None
    for name, (df, column) in parts.items():
        part = df.select(F.lit(name.split("/")[0]).alias("category"), t.clean(column).alias("value")).where("value <> ''")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def representatives(terms: DataFrame) -> DataFrame:
    """(category, key, term): one spelling per lower-case key, the first in sort order."""
    return terms.groupBy("category", F.lower("term").alias("key")).agg(F.min("term").alias("term"))


def term_lists(terms: DataFrame) -> DataFrame:
    """(category, n_terms, n_distinct, n_repeated) of lists with blanks dropped."""
    return terms.where(t.filled(F.col("term"))).groupBy("category").agg(F.count("*").alias("n_terms"), F.count_distinct(F.lower("term")).alias("n_distinct")).withColumn("n_repeated", F.col("n_terms") - F.col("n_distinct"))


def blacklist_coverage(terms: DataFrame) -> DataFrame:
    """(term, covered): whether Names or Towns have a blacklist term."""
    listed = terms.where("category in ('Names', 'Towns')").select(F.lower("term").alias("k")).distinct().withColumn("hit", F.lit(True))
    black = terms.where("category = 'Blacklist'").select("term", F.lower("term").alias("k"))
    return black.join(listed, "k", "left").select("term", F.coalesce("hit", F.lit(False)).alias("covered"))


def term_keys(terms: DataFrame) -> DataFrame:
    """terms with gram, their words in lower case joined by one space, first (its first word) and n_words; terms without words go."""
    keyed = terms.withColumn("_w", t.words(F.col("term"))).where(F.size("_w") > 0)
    return keyed.select(*terms.columns, F.array_join("_w", " ").alias("gram"), F.get("_w", F.lit(0)).alias("first"), F.size("_w").alias("n_words"))


def word_filter(words: DataFrame, n_words: int) -> tuple[DataFrame, int]:
    """((slot, bits), number of slots): a bit for each word (first) by its hash, 64 to a slot; sized by the count of words."""
    slots = 1 << max(0, (min(MOST_BITS, n_words * FILTER_BITS) // 64).bit_length())
    slot, place = _slot(F.col("first"), slots)
    bits = words.select(slot.alias("slot"), place.alias("place")).groupBy("slot").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("bits"))
    return bits, slots


def _slot(word: Column, slots: int) -> tuple[Column, Column]:
    h = F.xxhash64(word)
    return F.pmod(F.shiftright(h, 6), F.lit(slots)), F.pmod(h, F.lit(64)).cast("int")


def frequent(values: DataFrame, column: str) -> list[str]:
    """Values of the column that have more than HOT_SHARE of the rows, by a sketch of bounded size and an exact count of what it names."""
    top = values.agg(F.expr(f"approx_top_k(`{column}`, {HOT_TERMS}, {20 * HOT_TERMS})").alias("top"), F.count("*").alias("n")).first()
    named = [x["item"] for x in top.top or []]
    exact = values.where(F.col(column).isin(named)).groupBy(column).agg(F.count("*").alias("n")).collect() if named else []  # HOT_TERMS at most
    return [x[0] for x in exact if x.n > HOT_SHARE * top.n]


def locate_terms(df: DataFrame, id_col: str, columns: list[str], terms: DataFrame, keep: tuple[str, ...] = ("category", "term")) -> DataFrame:
    """(id, column, at, n, kept columns of terms): every place where a term (column term) stands as whole words.

    Words are found once per cell, where it is read, and a filter there drops
    what begins no term. Only places go on, never cells: a place has runs of the
    lengths that terms with its first word have, and these meet the terms by
    equality. Terms with a large share of all places are counted first and
    joined apart, so that a term in every cell makes no task larger than others.
    """
    folder = shared_dir(df.sparkSession)
    keys = written(term_keys(terms).select(*keep, "gram", "first", "n_words"), folder, "terms")
    firsts = written(keys.select("first", "n_words").distinct(), folder, "firsts")
    longest, n = firsts.agg(F.max("n_words"), F.count("*")).first()
    bits, slots = word_filter(firsts, n)
    one = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("cell")) for c in columns))).alias("x")
    words = df.select(id_col, one).select(id_col, "x.column", t.words(F.col("x.cell")).alias("_w"))
    places = words.select(id_col, "column", F.explode(t.word_runs(F.col("_w"), longest or 1)).alias("p"))
    places = places.select(id_col, "column", "p.at", "p.run", F.get("p.run", F.lit(0)).alias("first"))
    slot, place = _slot(F.col("first"), slots)
    places = places.withColumn("slot", slot).join(F.broadcast(bits), "slot").where(F.getbit("bits", place) == 1)  # MOST_BITS at most
    sizes = firsts.groupBy("first").agg(F.collect_set("n_words").alias("sizes"))  # lengths of terms
    runs = places.drop("slot", "bits").join(sizes, "first").select(id_col, "column", "at", "run", F.explode("sizes").alias("n")).where(F.size("run") >= F.col("n"))
    runs = written(runs.select(id_col, "column", "at", "n", F.array_join(F.slice("run", F.lit(1), F.col("n")), " ").alias("gram")), folder, "places")
    own, out = keys.select("gram", *keep), [id_col, "column", "at", "n", *keep]
    hot = frequent(runs, "gram")
    cold = runs.where(~F.col("gram").isin(hot)).join(own.where(~F.col("gram").isin(hot)), "gram") if hot else runs.join(own, "gram")
    found = cold.select(*out)
    if hot:
        some = own.where(F.col("gram").isin(hot))  # HOT_TERMS terms, each with the few rows that share its words
        found = found.union(runs.where(F.col("gram").isin(hot)).join(F.broadcast(some), "gram").select(*out))
    return found


def sample(values: DataFrame, column: str, n: int) -> DataFrame:
    """The first n values, without regard to case."""
    return values.select(column).distinct().orderBy(F.lower(column), column).limit(n)
