"""Mappings that crowd their domain are still whole."""

import pytest

from maskline.operators import mapping as m


def test_what_the_salt_rounds_leave_is_placed(spark):
    reals = spark.createDataFrame([(f"{i:02d}",) for i in range(48)] + [("A1",), ("-",)], "real string")
    with pytest.raises(ValueError, match="exhausted"):
        m.salted_unique(reals, "s", "run", rounds=1)  # no other value has the shape of "-"
    got = m.salted_unique(reals, "s", "run", rounds=1, widen=True).collect()
    fakes, real = {x.real: x.fake for x in got}, {x.real for x in reals.collect()}
    assert len(got) == 50 == len(fakes) == len(set(fakes.values())) and not set(fakes.values()) & real
    assert all(len(fakes[f"{i:02d}"]) == 2 for i in range(48)) and len(fakes["-"]) == 2
    assert fakes == {x.real: x.fake for x in m.salted_unique(reals.repartition(5), "s", "run", rounds=1, widen=True).collect()}


def test_a_full_shape_is_widened(spark):
    reals = spark.createDataFrame([(f"{i:02d}",) for i in range(100)], "real string")
    got = m.salted_unique(reals, "s", "short", rounds=2, widen=True).collect()
    assert len(got) == 100 == len({x.fake for x in got}) and {len(x.fake) for x in got} == {3} and {x.salt for x in got} == {2}
    used = spark.createDataFrame([("00", "100")], "real string, fake string")
    more = m.extend(used, reals, "s", "short", rounds=1, widen=True).collect()
    assert len(more) == 100 == len({x.fake for x in more})


def test_pools_go_on_past_one_more_word(spark):
    for kind, base in (("single", m.POOL_WORDS), ("town", 4 * m.POOL_WORDS)):
        tail = lambda size, kind=kind: [x.value for x in m.pool(spark, kind, size).tail(5)]
        one, two = tail(2 * base), tail(base * (2 + m.POOL_WORDS))  # the last values with the first word more, and with a second one
        assert len({*one, *two}) == 10 and all(b.startswith(a) for a, b in zip(one, two, strict=True))


def test_forbidden_words_that_no_pool_has_strike_nothing(spark):
    pool = m.pool(spark, "street", 3_000).union(m.pool(spark, "single", 5_000)).union(m.pool(spark, "town", 9_000)).union(m.pool(spark, "person", 100))
    assert pool.count() == m.in_pools(pool.select("value")).count()
    words = spark.createDataFrame([("Balalea",), ("Ann Balalea",), ("grove",), ("12 balalea st",), ("Nabb",), ("Ann",)], "value string")
    assert {x.value for x in m.in_pools(words).collect()} == {"Balalea", "grove", "12 balalea st"}
    assert m.allowed(pool, m.in_pools(words)).exceptAll(m.allowed(pool, words)).isEmpty() and m.allowed(pool, words).count() == m.allowed(pool, m.in_pools(words)).count() < pool.count()


def test_rounds_end_where_few_are_placed(spark):
    reals = spark.createDataFrame([(f"{i:03d}",) for i in range(900)], "real string")  # of 100 free values each round places less
    got = m.salted_unique(reals, "s", "run", widen=True).collect()
    assert len(got) == 900 == len({x.fake for x in got}) and not {x.fake for x in got} & {f"{i:03d}" for i in range(900)}
    assert max(x.salt for x in got if x.salt < m.MOST_ROUNDS) <= 2
