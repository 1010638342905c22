"""Worked cases of the behaviour, on small inputs."""

from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskline.functions import text as t
from maskline.operators import checks as c
from maskline.operators import identifiers as ids
from maskline.operators import mapping as m
from maskline.operators import masking as k
from maskline.operators import rows as r
from maskline.plans import jobs
from maskline.sources import files


def column(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").repartition(1)
    return [x.r for x in df.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


def test_account_keys(spark):
    assert column(spark, t.account_key, ["xxxx0585", "0585", "585", "PP", " pp ", "12345"]) == ["585", "585", "585", "PP", "PP", "2345"]
    assert column(spark, lambda v: t.bare_form(t.account_key(v)), ["225", "PP"]) == ["0225", None]


def test_codes(spark):
    assert column(spark, t.alnum_codes, ["6P038A5O05B 99clacfxo x0104", "1STBANK abc12", None]) == [["6P038A5O05B", "99clacfxo", "x0104"], ["abc12"], []]


def test_money(spark):
    d = lambda x: x and Decimal(x)
    texts = ["24,120.66", "-113,871.10", "(45.02)", "-$5.00", "$-5.00", "(5.00", "abc", "", None, "$1,000.05", "2024", "12345678901234567", "12345678901234567.00", "(-5.00)", ",.00"]
    assert column(spark, t.parse_money, texts) == [d(x) for x in ("24120.66", "-113871.10", "-45.02", "-5.00", "-5.00", None, None, None, None, "1000.05", None, None, None, "5.00", "0.00")]
    assert column(spark, lambda v: t.scale_amount_text(v, "1.1000"), ["1,000.00", "10.05", "x", "2024", "9999999999999999.99"]) == ["1,100.00", "11.06", "x", "2024", "9999999999999999.99"]


def test_addresses_and_property_codes(spark):
    got = column(spark, t.parse_address, ["1 Old b Rd, Town, NJ, 07026", "2 New Rd, Town, nj 07047", "", "only"])
    assert [(x.street, x.city, x.state, x.zip) for x in got] == [("1 Old b Rd", "Town", "NJ", "07026"), ("2 New Rd", "Town", "nj", "07047"), ("", "", "", ""), ("only", "", "", "")]
    assert column(spark, t.property_code, ["142 Maple Ave", "1234 O'Hare St", "12 St Marks Pl", "7"]) == ["142-MAP", "123-OHA", "12-ST", "7-"]


def test_money_columns():
    assert [t.is_money_column(x) for x in ("Depreciation", "Late fee", "Net income", "expenses", "Seq", "Account #")] == [True] * 4 + [False] * 2


def test_split_core(spark):
    assert [(x.core, x.suffix) for x in column(spark, t.split_core, ["Ann Lee CK", "Ann Lee LLC.", "Visa", "Ann Lee", "Motia Bus", "Motia Holdings"])] == [("Ann Lee", "CK"), ("Ann Lee", "LLC."), ("Visa", ""), ("Ann Lee", ""), ("Motia", "Bus"), ("Motia", "Holdings")]


def mapping(spark, *rows):
    return spark.createDataFrame(rows, "category string, real string, fake string")


def masked(spark, rows, texts, order=k.RELATED, blanket=True, **more):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(texts)], "i int, v string")
    return [x.v for x in k.mask_text(df, ["v"], mapping(spark, *rows), "s", order, blanket, **more).orderBy("i").collect()]


def test_boundaries_order_and_no_chaining(spark):
    names = [("name", "Ofir", "Ann"), ("name", "Tali", "Bea"), ("name", "Dom", "Zed"), ("name", "Lee", "Kim"), ("name", "Ann", "Ofir"), ("name", "Lee Ann", "Sue Roe")]
    got = masked(spark, names, ["Ofir_Tali", "Domínguez", "sleeve LEE", "Ofir Ann", "lee ann", None, ""])
    assert got == ["Ann_Bea", "Domínguez", "sleeve Kim", "Ann Ofir", "Sue Roe", None, ""]
    # the earlier category wins even if its term is shorter
    assert masked(spark, [("street", "12 Oak", "9 Elm"), ("name", "12 Oak Lane", "X Y")], ["at 12 Oak Lane"]) == ["at 9 Elm Lane"]


def test_blanket_and_join_path(spark, monkeypatch):
    rows = [("run", "123456", "654321"), ("name", "Ann Lee", "Bo Ray"), ("last4", "0585", "9999"), ("entcode", "A1", "B2")]
    texts = ["x 123456 ann lee 77777 A1B2C3", "plain", None, "é0585 acct0585 a1é Ann_Lee"]
    one = masked(spark, rows, texts)
    assert one[0].startswith("x 654321 Bo Ray ") and one[0].split()[-1] == k.shape_fake("A1B2C3", "s", "code") and len(one[0]) == len(texts[0]) - 1
    assert one[3].startswith("é9999 ") and one[3].endswith(" B2é Bo Ray")
    monkeypatch.setattr(k, "MAX_TERMS", 1)
    assert masked(spark, rows, texts) == one
    df = spark.createDataFrame([(x, x) for x in texts], "v string, w string")
    assert sorted(((x.v, x.w) for x in k.mask_text(df, ["w", "v"], mapping(spark, *rows), "s").collect()), key=str) == sorted(((x, x) for x in one), key=str)


def test_spellings_of_a_term(spark):
    rows = [("name", "Acme Inc.", "Bal Cor Inc."), ("acctnum", "(xxxx0585)", "xxxx77"), ("name", "Ann Lee", "Bo Ray")]
    texts = ["pay Acme Inc. now", "(xxxx0585)", "ANN  lee", "Ann_Lee", "Ann\nLee!", "acme inc"]
    assert masked(spark, rows, texts) == ["pay Bal Cor Inc. now", "(xxxx77)", "Bo Ray", "Bo Ray", "Bo Ray!", "Bal Cor Inc"]
    scan = spark.createDataFrame([("word", r[1]) for r in rows], "category string, term string")
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    assert c.leak_scan(df, "i", ["v"], scan).count() == len(texts)
    assert c.leak_scan(k.mask_text(df, ["v"], mapping(spark, *rows), "s"), "i", ["v"], scan).count() == 0


def test_computed_fakes_are_not_sent(spark):
    own = k.shape_fake("123456", "s", "run")
    got = k.needed(mapping(spark, ("run", "123456", own), ("run", "77777", "11111"), ("code", "A1B2C", k.shape_fake("A1B2C", "s", "code")), ("name", "x", "y")), "s", True)
    assert {x.real for x in got.collect()} == {"77777", "x"}
    assert masked(spark, [("run", "123456", own)], ["a 123456"]) == [f"a {own}"]


def test_file_names(spark):
    df = spark.createDataFrame([("acct0585 Ann: 12345.csv",), ("x10585.csv",), (None,), ("none",)], "f string")
    got = k.mask_file_names(df, "f", mapping(spark, ("last4", "0585", "9999"), ("name", "Ann", "Bo")), "s")
    assert [x.f for x in got.collect()] == ["acct9999 Bo_ 12345.csv", "x10585.csv", None, "none"]


def test_long_cells_take_linear_time(spark):
    import time

    df = spark.createDataFrame([(1, " ".join(f"w{i % 50}" for i in range(20_000)) + " the end")], "i int, v string")
    terms = spark.createDataFrame([("word", "the end"), ("word", "w3 w4 w5")], "category string, term string")
    c.leak_scan(df, "i", ["v"], terms).collect()
    began = time.time()
    assert c.locate_terms(df, "i", ["v"], terms).count() == 401
    assert time.time() - began < 20


def test_a_hit_with_its_context(spark):
    df = spark.createDataFrame([(10, "x", "a\tlong line of words before Unlisted\nWord and some more words after it"), (9, "Unlisted word", None), (2, None, "")], "i int, a string, b string")
    terms = spark.createDataFrame([("Blacklist", "unlisted word"), ("Blacklist", "Not there")], "category string, term string")
    got = c.blacklist_scan({"t": (df, "i", ["a", "b"])}, terms).collect()
    assert [(x.term, x.n_cells, x.first_id, x.column, x.context) for x in got] == [("unlisted word", 2, "9", "a", "Unlisted word")]
    got = c.blacklist_scan({"t": (df.where("i = 10"), "i", ["a", "b"])}, terms).first()
    assert got.context == " long line of words before Unlisted Word and some more words af"[1 + 26 - 25 - 1 :] or "Unlisted Word" in got.context


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("aB3 é_", max_size=12), min_size=1, max_size=8))
def test_shape_fake_agrees_and_keeps_shape(spark, texts):
    got = column(spark, lambda v: t.shape_fake(v, "s", "c"), texts)
    assert got == [k.shape_fake(x, "s", "c") for x in texts]
    shape = lambda x: ["0" if "0" <= ch <= "9" else "A" if "A" <= ch <= "Z" else "a" if "a" <= ch <= "z" else ch for ch in x]
    assert [shape(x) for x in got] == [shape(x) for x in texts]


def test_assign_is_seeded_one_to_one_and_clean(spark):
    reals = spark.createDataFrame([("name", "single", f"n{i}") for i in range(300)] + [("town", "single", f"t{i}") for i in range(50)], "category string, kind string, real string")
    pool = m.allowed(m.pool(spark, "single", 500), spark.createDataFrame([("Baladan",), ("BALADAN x",)], "value string"))
    build = lambda seed, n: {(x.category, x.real): x.fake for x in m.assign(reals.repartition(n), pool, seed).collect()}
    one = build("a", 1)
    assert one == build("a", 9) and one != build("b", 1) and len(set(one.values())) == 350 and "Baladan" not in one.values()
    with pytest.raises(Exception, match="exhausted"):
        m.assign(reals, pool.limit(100), "a").collect()


def test_ranks_equal_a_global_row_number(spark):
    from pyspark.sql.window import Window

    df = spark.range(3000).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("h"), (F.col("id") % 3).alias("g"))
    for most in (20, 50_000):
        both = m.ranked(df, "h", ["g"], bucket_rows=most).withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy("h")))
        assert both.where("rank <> want").count() == 0 and both.count() == 3000
    digits = m.rank_digits(1000, 20)
    assert df.groupBy("g", F.substring("h", 1, digits)).count().agg(F.max("count")).first()[0] <= 20 and m.rank_digits(10, 20) == 1 and m.rank_digits(10**10, 50_000) == 5
    assert m.ranked(df.limit(0), "h", ["g"]).isEmpty()


def test_no_key_is_one_row(spark):
    records = spark.range(3000).select(F.lit("xxxx0585").alias("account_num"), F.concat(F.lit("n"), F.col("id") % 1000).alias("account"), (F.col("id") % 2 == 0).alias("is_primary"))
    records = records.union(spark.createDataFrame([("0585", "n7", True), ("0585", "", False), ("", "x", True), ("77", "", True)], "a string, b string, c boolean"))
    counts = ids.identifier_counts(records)
    assert counts.count() == 1003 and counts.where("value = 'n7'").first().n == 4
    got = {x.key: x for x in ids.account_summary(records, top=2).collect()}
    assert (got["585"].n_forms, got["585"].n_names, got["585"].n_records, got["585"].names) == (2, 1000, 3002, ["n7", "n0"]) and got["77"].names == []


def test_lines_with_open_quotes(spark, tmp_path):
    (tmp_path / "one.tsv").write_text('a\tb\n1\t"x ""y"" z"\n2\tw\n')
    (tmp_path / "two.tsv").write_text('a\tb\n1\t"x\ny"\n2\tw\n')
    assert [files.has_open_quotes(spark, str(tmp_path / n)) for n in ("one.tsv", "two.tsv")] == [False, True]
    assert {x.b for x in files.read_tsv(spark, str(tmp_path / "two.tsv")).collect()} == {"x\ny", "w"} and files.read_tsv(spark, str(tmp_path / "one.tsv")).count() == 2


def test_salted_rounds_and_extension(spark):
    reals = spark.createDataFrame([(f"{i:02d}",) for i in range(40)], "real string")
    got = m.salted_unique(reals, "s", "run", rounds=60).collect()
    assert len(got) == 40 == len({x.fake for x in got}) and not {x.fake for x in got} & {x.real for x in got}
    with pytest.raises(ValueError):
        m.salted_unique(spark.createDataFrame([(f"{i:02d}",) for i in range(60)], "real string"), "s", "run", rounds=3)
    old = spark.createDataFrame([("00", "77"), ("01", "78")], "real string, fake string")
    new = {x.real: x.fake for x in m.extend(old, reals.limit(10), "s", "run").collect()}
    assert new["00"] == "77" and new["01"] == "78" and len(set(new.values())) == len(new)


def test_headers(spark):
    rows = spark.createDataFrame(
        [("a", 0, ["Description", "", "Summary Amt."]), ("a", 1, [" date ", "DESCRIPTION", "Amount"]), ("a", 2, ["1/2/2024", "x", "3"]), ("b", 0, ["x"]), ("b", 1, None)], "file string, row_no int, cells array<string>"
    )
    assert {x.file: x.header_row for x in r.statement_headers(rows).collect()} == {"a": 1, "b": 0}
    assert {x.file: x.header_row for x in r.table_headers(rows).collect()} == {"a": 1, "b": 0}


def test_checks_find_what_is_wrong(spark):
    a = spark.createDataFrame([(1, "x", "5.00"), (2, "y", None), (3, "z", "1")], "id int, d string, amount string")
    b = spark.createDataFrame([(1, "x", "5.00"), (2, "y", "7"), (4, "w", "1")], "id int, d string, amount string")
    for buckets in (1, 4096):
        found = {(x.id, x.column): (x.n_gone, x.n_new, x.old, x.new) for x in c.integrity(a, b, "id", ["d", "amount"], buckets).collect()}
        assert found == {(2, "amount"): (1, 1, None, "7"), (3, "amount"): (1, 0, "1", None), (3, "d"): (1, 0, "z", None), (4, "amount"): (0, 1, None, "1"), (4, "d"): (0, 1, None, "w")}
    twice = a.union(a)
    assert c.integrity(twice, twice.repartition(3), "id", ["d", "amount"]).isEmpty() and c.integrity(a.limit(0), a.limit(0), "id", ["d"]).isEmpty()
    assert [(x.id, x.n_gone, x.n_new) for x in c.integrity(twice, a.union(a.where("id > 1")), "id", ["d"]).collect()] == [(1, 1, 0)]
    assert c.determinism(twice, a).first().n_different == 3 and c.determinism(a.limit(0), a.limit(0)).first().passed
    rules = spark.createDataFrame([("runs", "exact", "x", "q"), ("names", "drop", "y", "p")], "rule string, mode string, real string, fake string")
    counts = {x.rule: (x.before, x.after, x.left_over, x.passed) for x in c.hit_counts(a, b, "d", rules).collect()}
    assert counts == {"runs": (1, 0, 1, False), "names": (1, 0, 1, False)}
    one, two = (spark.createDataFrame([(x, "Ann Lee CK")], "d string, e string") for x in ("acct 0585, 0585 Ann  LEE", "acct 9999, zzzz Bo Ray"))
    rules = spark.createDataFrame([("last4", "drop", "0585", "9999"), ("names", "info", "ann lee", "bo ray"), ("none", "drop", "q", "r")], "rule string, mode string, real string, fake string")
    counts = {x.rule: (x.before, x.after, x.left_over, x.passed) for x in c.hit_counts(one, two, ["d", "e"], rules).collect()}
    assert counts == {"last4": (2, 1, 0, False), "names": (2, 1, 1, True), "none": (0, 0, 0, True)}
    assert c.bijection(mapping(spark, ("n", "a", "f"), ("n", "A", "f"), ("n", "b", "g"), ("t", "c", "g"))).collect()[0].n_reals == 2
    assert c.determinism(a, b).first().n_different == 4 and c.determinism(a, a.repartition(3)).first().passed


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.csv").write_bytes("Bank,é\r\nDate,Description,Amount\r\n1/2/2024,\"PAY 1234567, x\",\"1,000.00\"\r\n".encode())
    (tmp_path / "in" / "two.csv").write_bytes("Date,Description,Amount\n1/2/2024,caf\xe9,5\n".encode("cp1252"))
    (tmp_path / "in" / "one_anon.csv").write_text("skip")
    cells = files.read_cells(spark, str(tmp_path / "in"))
    got = {(x.file, x.row_no): (x.encoding, x.cells) for x in cells.collect()}
    assert got["one.csv", 2] == ("utf-8", ["1/2/2024", "PAY 1234567, x", "1,000.00"]) and got["two.csv", 1] == ("windows-1252", ["1/2/2024", "café", "5"]) and len(got) == 5
    files.write_cells(cells, str(tmp_path / "out"))
    again = spark.read.text(str(tmp_path / "out")).where("file = 'one.csv'").collect()
    assert [x.value for x in again][2] == '1/2/2024,"PAY 1234567, x","1,000.00"'
    one = mapping(spark, ("run", "1", "2"), ("name", "a", "b"))
    for seed in ("s1", "s2"):
        files.write_mapping(one, str(tmp_path / "map"), seed)
    files.write_mapping(one.limit(1), str(tmp_path / "map"), "s1")
    assert files.read_mapping(spark, str(tmp_path / "map"), "s2").count() == 2
    with pytest.raises(ValueError):
        files.read_mapping(spark, str(tmp_path / "map"), "s3")
    df = spark.createDataFrame([('a"b', "t\tab"), ("", "é")], "x string, y string")
    files.write_tsv(df, str(tmp_path / "t.tsv"))
    assert sorted(map(tuple, files.read_tsv(spark, str(tmp_path / "t.tsv")).fillna("").collect())) == [("", "é"), ('a"b', "t\tab")]
    terms = files.read_terms(spark.createDataFrame([("Ann", " "), ("Bo", "X"), ("Ann", None)], "Names string, Towns string"))
    assert sorted((x.category, x.term) for x in files.first_seen(terms).collect()) == [("Names", "Ann"), ("Names", "Bo"), ("Towns", "X")]


def ledger_rows(spark, n=30):
    rows = [(str(i), "2024-01-01", f"PAY {50000 + i} to Ann Lee in Troy, acct 0585", "5.00", "Ann Lee CK" if i % 2 else "Bo Ray", "xxxx0585" if i % 3 else "585", "Bank A" if i % 4 else "Bank B", "secret") for i in range(n)]
    return spark.createDataFrame(rows, "Seq string, Date string, Description string, Amount string, Account string, account_num string, Institution string, Notes string")


def term_rows(spark, *more):
    return spark.createDataFrame([("Names", "Ann Lee"), ("Towns", "Troy"), ("Blacklist", "Ann Lee"), *more], "category string, term string")


def test_ledger_job(spark, tmp_path):
    ledger = ledger_rows(spark)
    got = jobs.ledger_job(ledger, ledger.limit(3), term_rows(spark), jobs.Options("seed", factor="1.1000"), out=str(tmp_path / "out"))
    assert all(x.passed for x in got["report"].collect()) and got["report"].count() == 9
    out = got["ledger"].collect()
    assert got["ledger"].columns == list(r.LEDGER) and len({x.account_num for x in out}) == 1 and {x.institution for x in out} == {"Bank A"}
    assert not any(w in x.description for x in out for w in ("Ann", "Lee", "Troy", "0585", "5000")) and {x.amount for x in out} == {"5.50"}
    kinds = {x.kind: x.n for x in got["stats"].collect()}
    assert kinds["town"] == 33 and kinds["run"] == 33 and kinds["last4"] == 33 and got["unmapped"].isEmpty()
    span = got["spans"].where("table = 'ledger' and seq = '7' and category = 'town'").first()
    assert "PAY 50007 to Ann Lee in Troy, acct 0585"[span.start : span.end] == "Troy"
    assert files.read_outputs(spark, str(tmp_path / "out"), "seed")["rules"].count() == 3


def test_a_leak_in_the_rules_alone_is_refused(spark, tmp_path):
    ledger = ledger_rows(spark, 9)
    rules = ledger.limit(2).withColumn("Description", F.lit("pay Unlisted"))
    got = jobs.ledger_job(ledger, rules, term_rows(spark, ("Blacklist", "Unlisted")), jobs.Options("seed"), out=str(tmp_path / "out"))
    report = {x.check: x.passed for x in got["report"].collect()}
    assert not report["leaks"] and not report["overall"] and {x.place for x in got["leaks"].collect()} == {"rules:0", "rules:1"}
    with pytest.raises(ValueError, match="nothing is published"):
        files.read_outputs(spark, str(tmp_path / "out"), "seed")


def test_cells_are_masked_by_themselves(spark):
    rows = spark.createDataFrame([("f", 0, ["Ann", "Lee", "5.00"]), ("f", 1, ["Date", "Description", "Amount"]), ("f", 2, ["1/1/2024", "to Ann Lee", "1.00"]), ("g", 0, ["Date", "Description", "Amount"]), ("g", 1, []), ("g", 2, None)], "file string, row_no int, cells array<string>")
    got = {(x.file, x.row_no): x.cells for x in k.mask_statements(rows, r.statement_headers(rows), mapping(spark, ("name", "Ann Lee", "Bo Ray"), ("name", "Lee", "Kim")), "s", "1.1000").collect()}
    assert got["f", 0] == ["Ann", "Kim", "5.50"] and got["f", 2] == ["1/1/2024", "to Bo Ray", "1.10"] and got["g", 1] == [] and got["g", 2] is None


def test_letters_that_become_two(spark):
    assert masked(spark, [("name", "İstanbul", "Troy")], ["to İstanbul, i\u0307stanbul", "İx İSTANBUL"]) == ["to Troy, Troy", "İx Troy"]
    df = spark.createDataFrame([(1, "to İstanbul, i\u0307stanbul")], "i int, v string")
    terms = spark.createDataFrame([("n", "İstanbul")], "category string, term string")
    assert c.leak_scan(df, "i", ["v"], terms).count() == 1
    assert c.leak_scan(k.mask_text(df, ["v"], mapping(spark, ("n", "İstanbul", "Troy")), "s", order=("n",)), "i", ["v"], terms).isEmpty()


def test_bank_columns_are_accounts(spark):
    accounts = spark.createDataFrame([("585", "99999", "xxxx99999")], "key string, fake_last4 string, fake_number string")
    df = spark.createDataFrame([("585", "0585", "xxxx0585", "77", "")], ["bank1", "Account #", "Bank2", "bank3", "memo"])
    assert tuple(k.mask_table(df, mapping(spark), accounts, "s").first()) == ("xxxx99999", "xxxx99999", "xxxx99999", "77", "")


def test_one_term_in_every_cell(spark):
    df = spark.range(4000).select("id", F.concat(F.lit("the bank "), F.when(F.col("id") % 100 == 0, F.lit("of Troy")).otherwise(F.col("id").cast("string"))).alias("v"))
    terms = spark.createDataFrame([("a", "the bank"), ("a", "bank"), ("b", "bank"), ("a", "of troy")], "category string, term string")
    got = ids.locate_terms(df, "id", ["v"], terms)
    assert {(x.category, x.term): x["count"] for x in got.groupBy("category", "term").count().collect()} == {("a", "the bank"): 4000, ("a", "bank"): 4000, ("b", "bank"): 4000, ("a", "of troy"): 40}
    assert sorted(ids.frequent(got, "term")) == ["bank", "of troy", "the bank"][0:3:2] and ids.locate_terms(df, "id", ["v"], terms.limit(0)).isEmpty()


def stream(spark, tmp_path, **more):
    from maskline.streaming import statements as st

    st.mask_stream(spark, str(tmp_path / "in"), str(tmp_path / "map"), str(tmp_path / "out"), "seed", str(tmp_path / "cp"), "1.1000", **more).awaitTermination()
    return st


def statement(tmp_path, name, text):
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / name).write_text(f'Date,Description,Amount\n1/1/2024,{text},"1,000.00"\n')


def test_stream_publishes_rows_and_mapping_together(spark, tmp_path, monkeypatch):
    from maskline.sources import commits

    files.write_mapping(mapping(spark, ("run", "50001", "60002"), ("name", "Ann Lee", "Bo Ray")), str(tmp_path / "map"), "seed")
    statement(tmp_path, "a.csv", "PAY 50001 Ann Lee 99887766")
    publish, ends = commits.Attempt.publish, ["before", "after"]

    def killed(self, note=""):
        end = ends.pop(0) if ends else None
        if end == "before":
            raise RuntimeError("killed before the manifest")
        made = publish(self, note)
        if end == "after":
            raise RuntimeError("killed after the manifest")
        return made

    monkeypatch.setattr(commits.Attempt, "publish", killed)
    for n_published in (0, 1):
        with pytest.raises(Exception, match="killed"):
            stream(spark, tmp_path)
        store = commits.Store(spark, str(tmp_path / "out"))
        assert len(store.manifests()) == n_published and (store.read("rows") is None) == (n_published == 0) == (store.read("runs") is None)
    for _ in range(2):
        st = stream(spark, tmp_path)
    rows = {x.row_no: x.cells for x in st.published_rows(spark, str(tmp_path / "out")).collect()}
    assert len(rows) == 2 and rows[1][2] == "1,100.00" and "PAY 60002 Bo Ray " in rows[1][1] and "99887766" not in rows[1][1]
    assert st.stream_mapping(spark, str(tmp_path / "map"), str(tmp_path / "out"), "seed").count() == 3
    assert len(list((tmp_path / "out" / "data" / "batch=0").iterdir())) == 1  # what the failed attempt staged is gone


def test_stream_refuses_a_batch_with_a_leak(spark, tmp_path):
    files.write_mapping(mapping(spark, ("run", "50001", "60002")), str(tmp_path / "map"), "seed")
    bad = spark.createDataFrame([("Blacklist", "Unlisted Word")], "category string, term string")
    statement(tmp_path, "a.csv", "PAY 50001")
    stream(spark, tmp_path, forbidden=bad)
    statement(tmp_path, "b.csv", "unlisted  word 7654321")
    st = stream(spark, tmp_path, forbidden=bad)
    statement(tmp_path, "c.csv", "PAY 7654399")
    stream(spark, tmp_path, forbidden=bad)
    out = str(tmp_path / "out")
    from maskline.sources.commits import Store

    assert [(x.key, x.state) for x in Store(spark, out).ledger().orderBy("key").collect()] == [("batch=0", "published"), ("batch=1", "refused"), ("batch=2", "published")]
    assert {x.file for x in st.published_rows(spark, out).collect()} == {"a.csv", "c.csv"}
    assert {x.real for x in st.stream_mapping(spark, str(tmp_path / "map"), out, "seed").collect()} == {"50001", "7654399"}
    assert [x.hit for x in st.quarantine(spark, out).collect()] == ["Unlisted Word"] and st.quarantine(spark, out, "files").first().path.endswith("b.csv")


def test_outputs_of_a_seed_are_published_at_once(spark, tmp_path):
    df, path = spark.createDataFrame([(1,)], "a int"), str(tmp_path / "out")
    names = lambda seed: sorted(files.read_outputs(spark, path, seed))
    files.write_outputs({"one": df, "gone": df}, path, "s1")
    files.write_outputs({"one": df}, path, "s2")
    fails = df.select(F.raise_error(F.lit("third table")).cast("int").alias("a"))
    with pytest.raises(Exception, match="third table"):
        files.write_outputs({"one": df.union(df), "two": df, "three": fails}, path, "s1")
    assert names("s1") == ["gone", "one"] and files.read_outputs(spark, path, "s1")["one"].count() == 1
    files.write_outputs({"one": files.read_outputs(spark, path, "s1")["one"].union(df), "two": df}, path, "s1")  # reads what it replaces
    assert names("s1") == ["one", "two"] and names("s2") == ["one"] and files.read_outputs(spark, path, "s1")["one"].count() == 2
    assert len(list((tmp_path / "out" / "data" / "seed=s1").iterdir())) == 1
    with pytest.raises(ValueError):
        files.read_outputs(spark, path, "s3")


def test_roles_pools_and_inputs(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    assert files.role({"x": df, "y": df.withColumnRenamed("a", " Prop ")}, ["prop"]) == "y"
    with pytest.raises(ValueError):
        files.role({"x": df}, ["prop"])
    (tmp_path / "pool").mkdir()
    (tmp_path / "pool" / "p.txt").write_text("Elm St\n\n  Oak St \n")
    assert {x.value for x in files.read_pool(spark, str(tmp_path / "pool"), "street").collect()} == {"Elm St", "Oak St"}
    (tmp_path / "pool" / "p.txt").write_text("\n")
    with pytest.raises(ValueError):
        files.read_pool(spark, str(tmp_path / "pool"), "street")
    (tmp_path / "in").mkdir()
    for name in ("a.csv", "~$a.csv", "b_anon.csv", "run9.config.csv"):
        (tmp_path / "in" / name).write_text("x")
    assert [x.name for x in files.discover(spark, str(tmp_path / "in")).collect()] == ["a.csv"]


def test_pools_follow_the_data(spark):
    assert m.pool_size("single", 5000, 1000) == 18_000 and m.pool(spark, "single", 18_000).select("value").distinct().count() == 18_000
    assert m.pool(spark, "town", 20_000).select("value").distinct().count() == 20_000
    assert m.new_seed() != m.new_seed() and jobs.Options().seed
    with pytest.raises(ValueError):
        jobs.Options("s", factor="1.50")
