"""The mapping that masks the ledger is one to one as a whole."""

from maskline.operators import checks as c
from maskline.queries import masking as q
from maskline.queries.base import Tables


def test_ledger_mapping_is_one_to_one_and_the_check_sees_it(spark, monkeypatch):
    db = Tables(spark, "/root/testdata/sf0.001")
    whole = q.ledger_mapping(db).where("category <> 'acctnum'").cache()
    assert {x.category for x in whole.select("category").distinct().collect()} >= {"account_name", "name", "town", "last4", "run"}
    assert c.bijection(whole).count() == 0
    merged = spark.createDataFrame([("account_name", "Ann Lee", "Bo Ray"), ("name", "Tom Fox", "Bo Ray")], "category string, real string, fake string")
    for mapping, right in ((whole, True), (merged, False)):
        monkeypatch.setattr(q, "ledger_mapping", lambda _, mapping=mapping: mapping)
        assert q.bijection_check(db).first().one_to_one is right


def test_the_report_builds_one_mapping(spark, monkeypatch):
    calls, own = [], q.ledger_mapping
    monkeypatch.setattr(q, "ledger_mapping", lambda db: calls.append(1) or own(db))
    q.report(Tables(spark, "/root/testdata/sf0.001"))
    assert len(calls) == 1
