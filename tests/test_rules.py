"""One clean and one broken row per rule type (C01-C11), plus C12/C13 on a small batch."""

import datetime as dt

from larder.catalogue import CATALOGUE
from larder.operators import rules


def test_row_rules(spark):
    df = spark.createDataFrame([("RM1", "ok", "t", "Y", 1), ("XX2", "", "t", "Q", 2), (None, "n", "t", None, 3)],
                               "material_Id string, materialName string, typeofMaterial string, "
                               "cold_storage string, quantity long")
    found = {(r.rule, r.column_name, r.row_key) for r in rules.row_rules(df, CATALOGUE["raw_materials"]).collect()}
    assert ("prefix", "material_Id", "XX2") in found
    assert ("not_null", "materialName", "XX2") in found  # '' counts as NULL
    assert ("in", "cold_storage", "XX2") in found
    assert ("not_null", "material_Id", "NULL") in found  # a NULL key part has a mark of its own
    assert not any(k == "RM1" for _, _, k in found)


def test_single_checks(spark):
    df = spark.createDataFrame([(1, "SMALL", 5.0, "F", 99999.0), (1, "LONGER NAME", -1.0, "P", 100000.0),
                                (2, "SMALL", 6.0, None, None)],
                               "k long, name string, v double, s string, p double")
    assert rules.check_primary_key(df, "t", ["k"]).count() == 1
    assert rules.check_unique(df, "t", "name").count() == 1
    assert rules.check_prefix(df, "t", "name", "S", ["k"]).count() == 1
    assert rules.check_min(df, "t", "v", 0, ["k"]).count() == 1
    assert rules.check_between(df, "t", "v", 0, 5, ["k"]).count() == 2
    assert rules.check_in(df, "t", "s", ["F", "O"], ["k"]).count() == 1  # NULL passes
    assert rules.check_max_length(df, "t", "name", 10, ["k"]).count() == 1
    assert rules.check_precision(df, "t", "p", 5, ["k"]).count() == 1
    assert rules.check_not_null(df, "t", ["s", "p"], ["k"]).count() == 2
    parent = spark.createDataFrame([(1,)], "k long")
    assert rules.check_foreign_key(df, "t", "k", parent, "k").count() == 1


def test_report_and_quarantine(spark):
    po = spark.createDataFrame([("PO1", dt.date(2000, 1, 1), 3, "RM1"), ("PO1", dt.date(2000, 1, 1), 4, "RM1"),
                                ("QQ2", dt.date(2000, 1, 1), 1, "RM7"), ("PO3", dt.date(2000, 1, 1), 2, None)],
                               "PONo string, PODate date, PurcQty long, Material_Id string")
    mats = spark.createDataFrame([("RM1", "a", "b", "Y", 1)], "material_Id string, materialName string, "
                                 "typeofMaterial string, cold_storage string, quantity long")
    report = {(r.table_name, r.rule): r.violations
              for r in rules.constraint_report({"purchase_order": po, "raw_materials": mats}).collect()}
    unchecked = {t for t, rule in report if rule == "unchecked"}
    assert len(unchecked) == len(CATALOGUE) - 2 and not unchecked & {"purchase_order", "raw_materials"}
    report = {k: v for k, v in report.items() if k[1] != "unchecked"}
    assert report == {("purchase_order", "primary_key"): 1, ("purchase_order", "prefix"): 1,
                      ("purchase_order", "foreign_key"): 1}
    split = rules.quarantine(po, CATALOGUE["purchase_order"], {"raw_materials": mats})
    assert sorted((r.PONo, r.PurcQty) for r in split.accepted.collect()) == [("PO1", 3), ("PO3", 2)]  # the first of a key
    why = {(r.PONo, r.PurcQty): r.reasons for r in split.rejected.collect()}
    assert why[("QQ2", 1)] == "foreign_key(Material_Id); prefix(PONo)"
    assert why[("PO1", 4)] == "primary_key(PONo)"


def test_quarantine_and_intake_accept_the_same_orders(spark):
    """C13 and E04 judge one batch: they agree on the row that has a number, ties in arrival included."""
    from larder.plans import registry
    for sf in ("0.001", "0.01"):
        jobs = registry.queries()
        split = sorted(map(tuple, jobs["c13_quarantine_accepted"](spark, f"/root/testdata/sf{sf}").collect()))
        intake = sorted(map(tuple, jobs["e04_po_accepted"](spark, f"/root/testdata/sf{sf}").select("PONo", "PODate", "PurcQty", "Material_Id").collect()))
        known = {r.material_Id for r in registry.Fixtures(spark, f"/root/testdata/sf{sf}").raw_materials.collect()}
        assert [r for r in split if r[3] in known] == intake and intake


def test_batch_hands_verdicts_down(spark):
    """A child of a rejected parent goes with it, one of an accepted parent of the batch stays; keys see earlier tables only."""
    import datetime as dt
    from decimal import Decimal

    from larder.operators import rules
    d = dt.date(2001, 1, 1)
    orders = spark.createDataFrame(
        [("CO1", d, Decimal(5), "FA1"), ("CO2", d, Decimal(-5), "FA1"), ("CO3", d, Decimal(5), "FA9"), ("CO4", d, Decimal(5), None),
         ("CO5", d, Decimal(5), "FA1"), ("CO5", d, Decimal(6), "FA1"), ("OLD", d, Decimal(5), "FA1"), ("", d, Decimal(1), "FA1")],
        "order_id string, orderdate date, totalamount decimal(18,2), franchise_id string")
    lists = spark.createDataFrame([("CO1", "MI1"), ("CO1", "MI1"), ("CO2", "MI1"), ("CO5", "MI2"), ("COLD", "MI1"), ("CO1", "MI9"), (None, "MI1")],
                                  "order_id string, mitemID string")
    feedback = spark.createDataFrame([("FB1", Decimal(9)), ("FB2", Decimal(3))], "feedbackID string, rating decimal(18,2)")
    links = spark.createDataFrame([("CO1", "FB2"), ("CO1", "FB1"), ("CO3", "FB2")], "order_id string, feedbackID string")
    stored = {"franchise": spark.createDataFrame([("FA1",)], "franchise_id string"),
              "menu_items": spark.createDataFrame([("MI1",), ("MI2",)], "mItemID string"),
              "customer_orders": spark.createDataFrame([("COLD", d, Decimal(1), "FA1"), ("OLD", d, Decimal(1), "FA1")], orders.schema)}
    got = rules.quarantine_batch({"feedback_info": links, "customer_orders": orders, "lists": lists, "customer_feedbacks": feedback}, stored,
                                 {"customer_orders": ["totalamount"]})
    assert list(got) == ["customer_orders", "lists", "customer_feedbacks", "feedback_info"]
    kept = {name: sorted(tuple(r) for r in split.accepted.collect()) for name, split in got.items()}
    assert [(r[0], r[2]) for r in kept["customer_orders"]] == [("CO1", 5), ("CO5", 5)]
    assert kept["lists"] == [("CO1", "MI1"), ("CO5", "MI2"), ("COLD", "MI1")]
    assert kept["customer_feedbacks"] == [("FB2", 3)] and kept["feedback_info"] == [("CO1", "FB2")]
    why = {(r.order_id, r.mitemID): r.reasons for r in got["lists"].rejected.collect()}
    assert why == {("CO1", "MI1"): "primary_key(order_id,mitemID)", ("CO2", "MI1"): "foreign_key(order_id)",
                   ("CO1", "MI9"): "foreign_key(mitemID)", (None, "MI1"): "not_null(order_id)"}
    assert rules.quarantine_batch({}, stored) == {}


def test_report_keys_do_not_run_together(spark):
    """Parts of a longer key keep their lengths; a hot key, NULL parts and users of one key set are told apart."""
    from larder.operators import rules
    pairs = [("1:a", "b"), ("1", "a1:b"), ("x", "y"), ("x", "y"), (None, "y"), (None, "y"), ("", "y")] + [("hot", "hot")] * 500
    tables = {
        "operated_by": spark.createDataFrame(pairs, "TPL_ID string, center_ID string"),
        "third_party_logistics": spark.createDataFrame([("hot",), ("x",), ("x",)], "TPL_ID string"),
        "third_party_logistics_services": spark.createDataFrame([("hot",), ("gone",)], "TPL_ID string"),
        "distribution_centers": spark.createDataFrame([], "center_ID string")}
    got = {(r.table_name, r.rule): r.violations for r in rules.constraint_report(tables).collect() if r.rule in ("primary_key", "foreign_key")}
    assert got == {("operated_by", "primary_key"): 2 + 3, ("operated_by", "foreign_key"): 2 + 507,
                   ("third_party_logistics", "primary_key"): 1, ("third_party_logistics_services", "foreign_key"): 1}
