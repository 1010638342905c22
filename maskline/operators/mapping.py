"""The seeded real-to-fake mapping.

Contract: the same seed gives the same fakes; a fake is never a real value, is
used once, and holds no forbidden word; a pool that is too small is an error.
Reals and candidates are ranked by a keyed hash and joined on rank, which needs
no sequential draw. Ranks are counted in buckets of the hash, so that no task
sees a whole category.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskline.functions import text as t
from maskline.shared import shared_dir, written

#: Parts of invented names. Fixed values of this library.
STARTS = ("Bal", "Cor", "Del", "Fen", "Gar", "Hol", "Jun", "Kel", "Lom", "Mar", "Nev", "Ost", "Pal", "Quin", "Ras", "Sel", "Tor", "Ulm", "Ver", "Wes")
MIDDLES = ("a", "e", "i", "o", "u", "an", "en", "il", "or", "ys")
ENDS = ("dan", "lea", "mont", "nis", "rick", "sby", "tin", "vale", "wyn", "zel")
STREET_KINDS, TOWN_KINDS = ("St", "Ave", "Rd", "Ln"), ("Falls", "Heights", "Grove", "Harbor")
#: Rounds of draws at most, where no number is asked for.
MOST_ROUNDS = 20
#: Rows that a bucket of ranks holds at most.
BUCKET_ROWS = 50_000


def new_seed() -> str:
    """A seed for a run that names none; it is kept with the mapping, so the run can be repeated."""
    return secrets.token_hex(3)


def hashed(seed: str, category: Column | str, value: Column) -> Column:
    label = F.lit(category) if isinstance(category, str) else category
    return F.sha2(F.concat_ws("|", F.lit(seed), label, value).cast("binary"), 256)


def rank_digits(n: int, most: int) -> int:
    """First digits of a hex hash that part n rows into buckets of most / 2 on average, so that none has more than most."""
    digits = 1
    while 16**digits * most < 2 * n:
        digits += 1
    return digits


def ranked(df: DataFrame, by: str, group: list[str], name: str = "rank", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """df with rank (from 1) in order of a hex hash, within each group.

    Rows are counted first, and dealt to buckets by as many digits of the hash as
    their number asks for; a bucket knows how many rows come before it. df is read three times.
    """
    n = df.groupBy(*group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bucketed = df.withColumn("_b", F.substring(by, 1, rank_digits(n, bucket_rows)))
    sizes = bucketed.groupBy(*group, "_b").agg(F.count("*").alias("_n"))  # a row for each bucket
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy(*group, "_b").orderBy(by)
    return bucketed.withColumn("_row", F.row_number().over(own)).join(firsts, [*group, "_b"]).withColumn(name, F.col("_first") + F.col("_row")).drop("_b", "_row", "_first")


def _pick(words: tuple[str, ...], place: Column) -> Column:
    return F.get(F.array(*map(F.lit, words)), place.cast("int"))


def invented(i: Column) -> Column:
    """The i-th invented word: 2,000 in all."""
    a, b = len(STARTS), len(MIDDLES)
    return F.concat(_pick(STARTS, i % a), _pick(MIDDLES, (i / a).cast("bigint") % b), _pick(ENDS, (i / (a * b)).cast("bigint") % len(ENDS)))


POOL_WORDS = len(STARTS) * len(MIDDLES) * len(ENDS)


def pool(spark: SparkSession, kind: str, size: int) -> DataFrame:
    """(kind, value): candidates by rule. single: one word; person: two words; town: a word and its kind; street: number, word and kind.

    Past the product of its parts each value gets one more invented word, and past the product with that a second
    one, so a pool follows the data and no value occurs twice.
    """
    i = F.col("id")
    stride = 7919  # prime to POOL_WORDS, so that second words differ along the pool
    most = {"single": POOL_WORDS, "person": POOL_WORDS**2, "town": POOL_WORDS * 4, "street": 999 * POOL_WORDS * 4}[kind]
    if size > most * POOL_WORDS**2:
        raise ValueError(f"pool {kind} has {most * POOL_WORDS**2} candidates at most")
    k, more = i % most, (i / most).cast("bigint")
    second = invented((k * stride + (k / POOL_WORDS).cast("bigint")) % POOL_WORDS)
    value = {
        "single": invented(k % POOL_WORDS),
        "person": F.concat_ws(" ", invented(k % POOL_WORDS), second),
        "town": F.concat_ws(" ", invented(k % POOL_WORDS), _pick(TOWN_KINDS, (k / POOL_WORDS).cast("bigint") % 4)),
        "street": F.concat_ws(" ", (k % 999 + 1).cast("string"), invented((k / 999).cast("bigint") % POOL_WORDS), _pick(STREET_KINDS, (k / (999 * POOL_WORDS)).cast("bigint") % 4)),
    }[kind]
    longer = lambda v, w: F.concat(v, F.lower(w)) if kind == "single" else F.concat_ws(" ", v, w)
    second_more = ((more - 1) / POOL_WORDS).cast("bigint")
    one = longer(value, invented((more - 1) % POOL_WORDS))
    whole = F.when(more > POOL_WORDS, longer(one, invented(second_more - 1))).when(more > 0, one).otherwise(value)
    return spark.range(size).select(F.lit(kind).alias("kind"), whole.alias("value"))


#: Least size of each pool; with more reals or forbidden terms it grows (``pool_size``).
LEAST_POOL = {"single": POOL_WORDS, "person": 40_000, "town": 4_000, "street": 100_000}


def pool_size(kind: str, n_reals: int, n_forbidden: int) -> int:
    """Candidates that leave enough for n_reals when n_forbidden terms strike some out."""
    return max(LEAST_POOL[kind], 3 * (n_reals + n_forbidden))


def grams(values: DataFrame) -> DataFrame:
    """(gram): the distinct values (value) by their words."""
    return values.select(F.array_join(t.words(F.col("value")), " ").alias("gram")).where("gram <> ''").distinct()


#: Words of pools: invented ones, up to three as one, numbers and kinds of streets and towns. Words of another form are in no pool.
POOL_WORD = rf"(?:(?:(?:{'|'.join(STARTS)})(?:{'|'.join(MIDDLES)})(?:{'|'.join(ENDS)})){{1,3}}|[0-9]{{1,3}}|{'|'.join((*STREET_KINDS, *TOWN_KINDS))})".lower()


def in_pools(forbidden: DataFrame) -> DataFrame:
    """The forbidden values (value) that a candidate of ``pool`` can hold: few, as names are seldom made of such words alone."""
    return forbidden.where(F.array_join(t.words(F.col("value")), " ").rlike(f"^{POOL_WORD}(?: {POOL_WORD}){{0,2}}$"))


def allowed(candidates: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Candidates that are no forbidden value and hold no forbidden word or run of words (forbidden has a column value)."""
    bad = grams(forbidden)
    parts = candidates.select("kind", "value", F.explode(t.ngrams(t.words(F.col("value")), 3)).alias("g")).select("kind", "value", "g.gram")
    hit = parts.join(bad, "gram", "left_semi").select("kind", "value").distinct()
    return candidates.join(hit, ["kind", "value"], "left_anti")


def assign(reals: DataFrame, candidates: DataFrame, seed: str, check: bool = True) -> DataFrame:
    """(category, kind, real, fake): reals (category, kind, real) take candidates (kind, value) by rank.

    Categories of one kind share the pool, so fakes differ across categories too.
    """
    folder = shared_dir(reals.sparkSession)  # both sides are read twice: to count their buckets, and to rank
    one = written(reals.distinct().withColumn("_h", hashed(seed, F.col("kind"), F.concat_ws("|", "category", "real"))), folder, "reals")
    pool = written(candidates.withColumn("_h", hashed(seed, F.concat(F.lit("pool-"), F.col("kind")), F.col("value"))), folder, "pool")
    real, fake = ranked(one, "_h", ["kind"]), ranked(pool, "_h", ["kind"])
    out = real.join(fake.select("kind", "rank", F.col("value").alias("fake")), ["kind", "rank"], "left").select("category", "kind", "real", "fake")
    if check:
        out = out.where(F.assert_true(F.col("fake").isNotNull(), F.lit("a pool of fakes is exhausted")).isNull())
    return out


def numbers(keys: DataFrame, seed: str, digits: int = 4) -> DataFrame:
    """(key, fake_last4, fake_number): each numeric or word key takes a number of that many digits that no real key has."""
    spark = keys.sparkSession
    folder = shared_dir(spark)
    real = written(keys.select("key").distinct(), folder, "keys")
    free = spark.range(10**digits).select(F.lpad(F.col("id").cast("string"), digits, "0").alias("value"))
    taken = real.select(t.bare_form(F.col("key")).alias("value")).where("value is not null")
    free = ranked(written(free.join(taken, "value", "left_anti").withColumn("_h", hashed(seed, "pool-last4", F.col("value"))).withColumn("g", F.lit(1)), folder, "free"), "_h", ["g"])
    mine = ranked(real.withColumn("_h", hashed(seed, "last4", F.col("key"))).withColumn("g", F.lit(1)), "_h", ["g"])
    out = mine.join(free.select("rank", F.col("value").alias("fake_last4")), "rank", "left")
    return out.where(F.assert_true(F.col("fake_last4").isNotNull(), F.lit("no free account numbers; use more digits")).isNull()).select("key", "fake_last4", F.concat(F.lit("xxxx"), F.col("fake_last4")).alias("fake_number"))


#: Characters of a shape and how many values each stands for. Fixed values.
SIZES = {"0": 10, "A": 26, "a": 26}


def shape(c: Column) -> Column:
    """The text with 0 for digits, A for capitals and a for small letters."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "0"), "[A-Z]", "A"), "[a-z]", "a")


def _choices(c: Column) -> Column:
    return F.when(c == "0", 10).when(c.isin("A", "a"), 26).otherwise(1).cast("bigint")


def room(shape: Column, most: Column) -> Column:
    """How many values have that shape, most at most."""
    return F.aggregate(F.split(shape, ""), F.lit(1).cast("bigint"), lambda n, c: F.least(n * _choices(c), most))


def nth(shape: Column, i: Column) -> Column:
    """The i-th value of a shape, from 0; the last character counts fastest."""
    start = F.struct(i.cast("bigint").alias("i"), F.lit("").alias("text"))
    step = lambda acc, c: F.struct((acc["i"] / _choices(c)).cast("bigint").alias("i"), F.concat(F.char(F.ascii(c) + acc["i"] % _choices(c)), acc["text"]).alias("text"))
    plain = lambda acc, c: F.when(c.isin(*SIZES), step(acc, c)).otherwise(F.struct(acc["i"].alias("i"), F.concat(c, acc["text"]).alias("text")))
    any_shape = F.aggregate(F.reverse(F.split(shape, "")), start, plain, lambda acc: acc["text"])
    return F.when(shape.rlike("^0+$"), F.lpad(i.cast("string"), F.length(shape), F.lit("0"))).otherwise(any_shape)


def placed_by_rank(left: DataFrame, taken: DataFrame, seed: str, category: str, folder: str, widen: bool = False, forbidden: DataFrame | None = None) -> DataFrame:
    """(real, fake): each real of left takes a free value of its shape by rank; of a full shape, with widen, one with digits added.

    Of the first len(left) + len(taken) + len(forbidden) values of a shape, len(left) are free or the shape is full, so
    no more are made. A shape of several words may be called full where only forbidden values (value) are in the way.
    """
    left, placed, k, tasks = left.select("real", shape(F.col("real")).alias("shape")), None, 0, left.sparkSession.sparkContext.defaultParallelism
    while True:
        wanted = left.groupBy("shape").agg(F.count("*").alias("n"))
        used = taken.groupBy(shape(F.col("fake")).alias("shape")).agg(F.count("*").alias("m"))
        bad = None if forbidden is None else written(in_shapes(wanted.select(F.col("shape").alias("real")), forbidden), folder, f"forbidden-{k}")
        spare = F.lit(0 if bad is None else bad.count())
        sizes = wanted.join(used, "shape", "left").select("shape", room(F.col("shape"), F.col("n") + F.coalesce("m", F.lit(0)) + spare).alias("n"))
        chunks = sizes.select("shape", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(10_000))).alias("first")).repartition(4 * tasks, "shape", "first")
        ids = chunks.select("shape", F.explode(F.sequence("first", F.least(F.col("first") + 9_999, F.col("n") - 1))).alias("i"))
        free = ids.select("shape", nth(F.col("shape"), F.col("i")).alias("fake")).join(taken.select("fake"), "fake", "left_anti")
        free = written(free if bad is None else free.join(holding(free, bad), "fake", "left_anti"), folder, f"free-{k}")
        fakes = ranked(free.withColumn("_h", hashed(seed, f"free-{category}", F.col("fake"))), "_h", ["shape"]).select("shape", "rank", "fake")
        reals = ranked(left.withColumn("_h", hashed(seed, f"left-{category}", F.col("real"))), "_h", ["shape"]).select("shape", "rank", "real")
        both = written(reals.join(fakes, ["shape", "rank"], "left").select("real", "shape", "fake"), folder, f"ranked-{k}")
        won = both.where("fake is not null").select("real", "fake")
        placed = won if placed is None else placed.union(won)
        left = both.where("fake is null").select("real", F.concat("shape", F.lit("0")).alias("shape"))
        if left.isEmpty():
            return placed
        if not widen:
            raise ValueError(f"{category}: fakes are exhausted: no value of the shape is free")
        taken, k = taken.select("fake").union(won.select("fake")), k + 1


def unique_draws(reals: DataFrame, draw: Callable[[int], Column], taken: DataFrame, rounds: int | None, folder: str, forbidden: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed (real, fake, salt), left, taken (fake)) after so many rounds of draw(salt), a column of reals (real, ...), each once.

    Of equal candidates the first real keeps it; the others are drawn again, and so is what holds a run of words of
    forbidden (gram). Without a number of rounds they end when one has placed less than half of what was left, after
    MOST_ROUNDS at most. Two tables are written per round; what was placed meets what is left by real, so no fake that
    many share makes a task larger than others.
    """
    left, placed, n, tasks = reals, None, None, reals.sparkSession.sparkContext.defaultParallelism
    for salt in range(MOST_ROUNDS if rounds is None else rounds):
        tried = left.repartition(tasks).withColumn("fake", draw(salt)).select("real", "fake")  # draws cost time, not bytes: they are dealt to all tasks
        if forbidden is not None:
            bad = holding(tried, forbidden)
            tried = tried.join(bad, "fake", "left_anti")
        known = tried.select("fake", "real", F.lit(False).alias("_taken")).union(taken.select("fake", F.lit(None).cast("string"), F.lit(True)))
        best = known.groupBy("fake").agg(F.min("real").alias("real"), F.bool_or("_taken").alias("_taken"))
        won = written(best.where("not _taken").select("real", "fake", F.lit(salt).alias("salt")), folder, f"round-{salt}")
        placed = won if placed is None else placed.union(won)
        left, taken = written(left.join(won.select("real"), "real", "left_anti"), folder, f"left-{salt}"), taken.union(won.select("fake"))
        before, n = n, left.count()
        if n == 0 or (rounds is None and before is not None and 2 * n > before):
            break
    return placed, left, taken


def holding(values: DataFrame, forbidden: DataFrame) -> DataFrame:
    """(fake): the values (fake) that hold a run of words of forbidden (gram), three at most."""
    parts = values.select("fake", F.explode(t.ngrams(t.words(F.col("fake")), 3)["gram"]).alias("gram"))
    return parts.join(forbidden, "gram", "left_semi").select("fake").distinct()


def folded(c: Column) -> Column:
    """The shape of a text, without regard to case."""
    return shape(F.lower(c))


def in_shapes(reals: DataFrame, forbidden: DataFrame) -> DataFrame:
    """(gram): the forbidden values (value) that a fake of the shape of one of the reals (real) can hold."""
    shapes = reals.select(folded(F.col("real")).alias("fake")).distinct()  # few
    runs = shapes.select(F.explode(t.ngrams(t.words(F.col("fake")), 3)["gram"]).alias("_shape")).distinct()
    return grams(forbidden).withColumn("_shape", folded(F.col("gram"))).join(runs, "_shape", "left_semi").select("gram")


def salted_unique(
    reals: DataFrame, seed: str, category: str, used: DataFrame | None = None, rounds: int | None = None, widen: bool = False, forbidden: DataFrame | None = None,
) -> DataFrame:
    """(real, fake, salt): same-shape fakes, distinct and neither real nor used; only losers are drawn again.

    No fake holds a run of words of a forbidden value (value). What the rounds have not placed takes a free value by
    rank, with salt = rounds. If a shape has no free value left, that is an error, or with widen the fake is longer.
    """
    folder = shared_dir(reals.sparkSession)
    left = written(reals.select("real").distinct(), folder, "reals")
    taken = left.select(F.col("real").alias("fake"))
    if used is not None:
        taken = written(taken.union(used.select("fake")).distinct(), folder, "taken")
    bad = None if forbidden is None else written(in_shapes(left, forbidden), folder, "forbidden")
    bad = None if bad is None or bad.isEmpty() else bad
    placed, left, taken = unique_draws(left, lambda salt: t.shape_fake(F.col("real"), seed, category, salt), taken, rounds, folder, bad)
    if left.isEmpty():
        return placed
    late = placed_by_rank(left, taken, seed, category, folder, widen, forbidden).withColumn("salt", F.lit(MOST_ROUNDS if rounds is None else rounds))
    return late if placed is None else placed.union(late)


def extend(mapping: DataFrame, reals: DataFrame, seed: str, category: str, rounds: int | None = None, widen: bool = False) -> DataFrame:
    """(real, fake) of a saved mapping and of values that are new; old fakes stay."""
    new = reals.select("real").distinct().join(mapping.select("real"), "real", "left_anti")
    return mapping.select("real", "fake").union(salted_unique(new, seed, category, mapping.select("fake").union(mapping.select(F.col("real").alias("fake"))), rounds, widen).select("real", "fake"))
