"""The run over related tables."""

from decimal import Decimal

import pytest

from maskline.operators import mapping as m
from maskline.operators import related as rel
from maskline.plans import jobs

KEY = [
    ("196 Central Ave, Troy, NJ, 07026", "G42VW", "Danmir LLC", "xxxx0585", "cash"), ("7 Elm St, Utica, nj 07047", "G43", "Motia LLC", "", ""), ("7 Elm St, Utica, nj 07047", "G44", "Motia Holdings", "", ""),
    ("", "G45X", "", "", ""), (",", "G46", "Lost LLC", "", ""), ("7 Elm St, Utica, nj 07047", "Commo", "", "", ""),
]
ACCOUNTS = [("Danmir CK", "xxxx0585", "Danmir LLC", "Danmir CK - xxxx0585 (A1B2)", "Ofir Tal - 7788 (C3D4)"), ("Motia Bus", "cash", "", "", None)]
LEDGER = [("1", "pay danmir and motia ck for G42VW at 196 Central Ave", Decimal("10.00"), "Danmir CK", "585", "G42VW", "Chase"), ("2", "danmirmotia Blue Cash 7788 A1B2 12345678", Decimal("5.55"), "Motia Bus", "cash", "G99Z", "Chase cash")]


@pytest.fixture(scope="module")
def run(spark):
    tables = {
        "key": spark.createDataFrame(KEY, "Address string, Prop string, LLC string, bank1 string, bank2 string"),
        "accounts": spark.createDataFrame(ACCOUNTS, ["Account", "Account #", "LLC", "Unique Account Identifier", "Sorted Accounts"]),
        "Transactions": spark.createDataFrame(LEDGER, "Seq string, Description string, Amount decimal(18,2), Account string, `Account #` string, Prop string, Institution string"),
    }
    terms = spark.createDataFrame([("Names", "Danmir"), ("Names", "Motia CK"), ("Names", "Ofir"), ("Towns", "Troy"), ("Blacklist", "Danmir"), ("Blacklist", "Troy"), ("Names", "Motia")], "category string, term string")
    rows = spark.createDataFrame([("a.csv", 0, ["Description", "", "Summary Amt."]), ("a.csv", 1, ["Danmir at 2024", "", "1,000.00"]), ("a.csv", 2, ["Date", "Description", "Amount"]), ("a.csv", 3, ["1/2/2024", "to DANMIR x", "(2.00)"])], "file string, row_no int, cells array<string>")
    return tables, terms, jobs.related_tables_job(tables, terms, jobs.Options("seed", factor="1.1000"), rows)


def fakes(out, category):
    return {x.real: x.fake for x in out["mapping"].where(f"category = '{category}'").collect()}


def test_harvest(spark, run):
    got = {(x.category, x.value) for x in rel.harvest(run[0]).collect()}
    assert {("account_name", "Ofir Tal"), ("account_num", "7788"), ("entity", "C3D4"), ("entity", "A1B2"), ("llc", "Lost LLC"), ("property", "G99Z"), ("account_num", "cash"), ("address", ",")} <= got


def test_mapping(run):
    _, _, out = run
    assert all(x.passed for x in out["report"].collect()), out["report"].collect()
    llc, names, props, streets = fakes(out, "llc"), fakes(out, "name"), fakes(out, "propcode"), fakes(out, "street")
    assert set(llc) == {"danmir llc", "motia llc", "motia holdings", "lost llc"} and len(set(llc.values())) == 4
    assert llc["danmir llc"] == streets["196 central ave"] + " LLC" and llc["motia holdings"] == streets["7 elm st"] + " LLC" != llc["motia llc"]
    assert names["danmir"] == llc["danmir llc"] and names["motia"] == llc["motia holdings"] and names["lost"] == llc["lost llc"]  # the least company of a root
    assert names["motia ck"].endswith(" CK") and names["ofir"] and "motia bus" not in names
    assert set(props) == {"g42vw", "g43", "g44", "g45x", "g46", "g99z"} and len(set(props.values())) == 6
    number, word = streets["196 central ave"].split()[:2]
    assert props["g42vw"] == f"{number}-{word[:3].upper()}"


def test_tables(run):
    tables, _, out = run
    ledger = {x.Seq: x for x in out["tables"]["Transactions"].collect()}
    streets, names, llc, props, ent = (fakes(out, x) for x in ("street", "name", "llc", "propcode", "entcode"))
    assert ledger["1"].Description == f"pay {names['danmir']} and {names['motia ck']} for {props['g42vw']} at {streets['196 central ave']}"
    assert ledger["2"].Description.startswith(names["danmir"] + names["motia"] + " Blue Cash ") and ent["A1B2"] in ledger["2"].Description
    assert ledger["1"].Account == f"{names['danmir']} CK" and ledger["2"]["Account #"].startswith("xxxx") and ledger["2"].Institution == "Chase cash"
    assert ledger["1"].Amount == Decimal("11.00") and ledger["2"].Prop == props["g99z"]
    key = [tuple(x) for x in out["tables"]["key"].collect()]
    assert any(a.startswith(streets["196 central ave"]) and a.endswith(", NJ 07026") and b == llc["danmir llc"] for a, _, b, *_ in key)
    assert out["tables"]["key"].columns == tables["key"].columns and "Commo" in [x[1] for x in key]
    cells = {x.row_no: x.cells for x in out["tables"]["statements"].collect()}
    assert cells[1] == [f"{names['danmir']} at 2024", "", "1,100.00"] and cells[3] == ["1/2/2024", f"to {names['danmir']} x", "-2.20"] and cells[2] == ["Date", "Description", "Amount"]


def test_the_key_table_is_needed(spark, run):
    tables, terms, _ = run
    with pytest.raises(ValueError, match="address"):
        jobs.build_related({"Transactions": tables["Transactions"]}, terms, jobs.Options("seed"))


def test_collisions_of_codes_are_drawn_anew(spark):
    reals = spark.createDataFrame([(f"p{k}", "1-ABC") for k in range(5)], "real string, code string")
    from maskline.shared import shared_dir

    got, left, _ = m.unique_draws(reals, lambda salt: rel.drawn_code("s", m.F.col("real"), salt) if salt else m.F.col("code"), spark.createDataFrame([("9-ZZZ",)], "fake string"), 5, shared_dir(spark))
    got = {x.real: x.fake for x in got.collect()}
    assert left.isEmpty() and got["p0"] == "1-ABC" and len(set(got.values())) == 5


def test_codes_hold_no_forbidden_word(spark):
    reals = spark.createDataFrame([("BABF",), ("C0DE",)], "real string")
    plain = {x.real: x.fake for x in m.salted_unique(reals, "seed-1", "entity", widen=True).collect()}
    assert plain["BABF"] == "NAFP"
    words = spark.createDataFrame([("Nafp",), ("Unlisted Word",), ("nbc",)], "value string")
    codes = {x.real: x.fake for x in m.salted_unique(reals, "seed-1", "entity", widen=True, forbidden=words).collect()}
    assert codes["BABF"] != "NAFP" and len(codes["BABF"]) == 4 and codes["C0DE"] == plain["C0DE"]
    late = {x.real: x.fake for x in m.salted_unique(reals, "seed-1", "entity", rounds=1, widen=True, forbidden=words).collect()}
    assert len(late) == 2 and "NAFP" not in late.values()  # also by rank
    from maskline.shared import shared_dir

    props = spark.createDataFrame([("G1",), ("G2",)], "value string")
    streets = spark.createDataFrame([("g1", "1 a"), ("g2", "2 a")], "owner string, address string")
    found = spark.createDataFrame([("1 a", "7 Nbcor St"), ("2 a", "8 Mardan St")], "real string, fake_street string")
    got = {x.real: x.fake for x in rel.property_codes(props, streets, found, props.selectExpr("value as fake"), "s", shared_dir(spark), words).collect()}
    assert got["g2"] == "8-MAR" and "NBC" not in got["g1"] and len(got) == 2


def test_what_draws_leave_is_numbered(spark, tmp_path, monkeypatch):
    from maskline.operators import related

    monkeypatch.setattr(related, "ROUNDS", 2)
    reals = spark.createDataFrame([(f"p{k}",) for k in range(9)], "real string")
    taken = spark.createDataFrame([("a-2-3",)], "fake string")
    got = related._unique(reals, lambda salt: related.F.lit(f"a-{salt}"), taken, "s", str(tmp_path)).collect()
    assert len(got) == 9 == len({x.fake for x in got} - {"a-2-3"}) and {x.real for x in got} == {f"p{k}" for k in range(9)}


def test_work_folders_go(spark, tmp_path):
    from pathlib import Path

    from maskline import shared

    with shared.work(spark):
        folder = shared.shared_dir(spark)
        assert shared.written(spark.range(3), folder, "x").count() == 3 and Path(folder, "x").exists()
    assert not Path(folder).exists() and folder not in shared._made
