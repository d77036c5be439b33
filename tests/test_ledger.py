"""Maps of segments, and the ledger against a plain fold with retries and negative receipts."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.operators import ledger
from larder.operators.events import reserve_stock
from larder.plans import registry
from larder.session import shared_dir

EVENT = st.one_of(st.just(None), st.integers(-4, 4))  # None: a reservation


def fold(stock, events):
    for e in events:
        stock = stock + e if e is not None else stock - 1 if stock > 0 else stock
    return stock


def mapped(events):
    import numpy as np
    m = ledger.StockMap()
    m.add(np.array([e is not None for e in events], dtype=bool), np.array([e or 0 for e in events], dtype=np.int64))
    return m


@settings(max_examples=300, deadline=None)
@given(st.lists(EVENT, max_size=40), st.integers(-30, 30))
def test_map_equals_fold(events, floor):
    m = mapped(events)
    shift, at, extra = m.stretches(floor)
    for stock in range(floor, floor + 60):
        assert ledger.stock_after(stock, shift, at, extra) == fold(stock, events)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.just(None), st.integers(0, 4)), max_size=60))
def test_map_without_negative_receipts_has_one_stretch(events):
    assert len(mapped(events).stretches(0)[1]) <= 1


def plain(events, start):
    stock, taken, out = dict(start), set(), []
    for e in sorted(events, key=lambda e: (e[0], *e[3:])):
        material, kind, quantity, ref = e[0], e[1], e[2], e[7]
        if material not in stock:
            continue
        ok = True
        if kind == "receipt":
            stock[material] += quantity
        else:
            ok = stock[material] > 0 and (material, ref) not in taken
            if ok:
                stock[material] -= 1
                taken.add((material, ref))
        out.append((*e, ok, stock[material]))
    return sorted(out)


def ledger_rows(spark, events, start, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        ev = spark.createDataFrame(events, ledger.LEDGER_SCHEMA).repartition(3)
        mats = spark.createDataFrame(list(start.items()), "material_Id string, quantity long")
        return sorted(tuple(r) for r in ledger.stock_ledger(ev, mats).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("seed, parts", [(1, 7), (2, 3), (3, 11)])
def test_ledger_with_retries_and_negative_receipts(spark, seed, parts):
    rnd = random.Random(seed)
    start = {f"RM{i}": rnd.randint(-3, 5) for i in range(5)}
    events = []
    for i in range(900):
        m = "RM0" if i % 3 == 0 else f"RM{rnd.randint(0, 5)}"  # RM0 holds a third of all rows; RM5 is unknown
        if rnd.random() < 0.25:
            events.append((m, "receipt", rnd.randint(-6, 6), i, 0, i, 7, f"PO{i}"))
        else:  # few ids: many lines come again
            events.append((m, "reservation", 1, i, 1, 0, 0, f"SPM{rnd.randint(0, 200)}"))
    assert ledger_rows(spark, events, start, parts) == plain(events, start)


def test_retry_is_taken_after_a_receipt_and_displaces_a_later_line(spark):
    start = {"RM1": 0}
    events = [("RM1", "reservation", 1, 1, 1, 0, 0, "A"), ("RM1", "receipt", 1, 2, 0, 0, 0, "PO1"),
              ("RM1", "reservation", 1, 3, 1, 0, 0, "A"), ("RM1", "reservation", 1, 4, 1, 0, 0, "B"),
              ("RM1", "receipt", 1, 5, 0, 0, 0, "PO2"), ("RM1", "reservation", 1, 6, 1, 0, 0, "A"),
              ("RM1", "reservation", 1, 7, 1, 0, 0, "B"), ("RM1", "reservation", 1, 7, 1, 0, 0, "B")]
    got = ledger_rows(spark, events, start, 4)
    assert got == plain(events, start)
    assert [r[-2] for r in sorted(got, key=lambda r: (r[3], r[7], not r[-2]))] == [False, True, True, False, True, False, True, False]


def test_hot_key_and_odd_rows(spark):
    start = {"RM1": 2, "RM2": None, "RM3": 10**12}
    events = [("RM1", "reservation", 1, i, 1, 0, 0, "SAME") for i in range(300)]
    events += [("RM1", "reservation", 1, 500, 1, 0, 0, None)] * 2 + [(None, "receipt", 5, 1, 0, 0, 0, "PO")]
    got = ledger_rows(spark, events, {k: v for k, v in start.items() if v is not None}, 5)
    assert sum(r[-2] for r in got) == 2 and len(got) == 302  # the key once; of two lines without an id one finds stock
    assert ledger_rows(spark, [("RM9", "receipt", 5, 1, 0, 0, 0, "PO")], {"RM1": 1}, 4) == []


def test_eligible_lines_keep_repeats(spark):
    lines = spark.createDataFrame([("RM1", "SPM1", 1), ("RM1", "SPM1", 2), ("RM1", None, 3), ("RM9", "SPM1", 4), ("RM1", "SPM2", 5),
                                   ("RM1", "SPM3", 6)], "Material_Id string, trackingID string, arrival_seq long")
    mats = spark.createDataFrame([("RM1", 1)], "material_Id string, quantity long")
    old = spark.createDataFrame([("RM1", "SPM2")], "Material_Id string, trackingID string")
    ships = spark.createDataFrame([("SPM1",), ("SPM2",)], "trackingID string")
    got = reserve_stock(lines, mats, shipments=ships, existing=old).eligible.collect()
    assert sorted((r.trackingID, r.arrival_seq) for r in got) == [("SPM1", 1), ("SPM1", 2)]


def shaped(rng, materials, rows):
    """Events of many materials: retries, receipts below 0, unknown materials, lines without an id."""
    events = []
    for i in range(rows):
        m = f"RM{rng.randint(0, materials - 1)}"
        if rng.random() < 0.3:
            events.append((m, "receipt", rng.randint(-3, 4), i, 0, i, 7, f"PO{i}"))
        else:
            events.append((m, "reservation", 1, i, 1, 0, 0, f"SPM{rng.randint(0, 4)}"))
    return events


def test_materials_inside_a_partition(spark):
    rng = random.Random(5)
    events, start = shaped(rng, 300, 4000), {f"RM{i}": rng.randint(-2, 4) for i in range(290)}
    assert ledger_rows(spark, events, start, 3) == plain(events, start)


def test_folded_leaves_what_may_be_cut_and_long_materials(monkeypatch):
    monkeypatch.setattr(ledger, "LONG", 50)
    rng = random.Random(6)
    events, start = shaped(rng, 40, 1500), {f"RM{i}": rng.randint(-2, 4) for i in range(38)}
    events += [("RM20", "reservation", 1, 2000 + i, 1, 0, 0, f"SPM{i}") for i in range(120)]
    events.sort(key=lambda e: (e[0], *e[3:]))
    rows = sorted([(m, None, q, None, None, None, None, None, True) for m, q in start.items()] + [(*e, False) for e in events],
                  key=lambda r: (r[0], not r[-1]))
    names = [*(x.split()[0] for x in ledger.LEDGER_SCHEMA.split(", ")), "_opens"]
    table = pa.table({n: pa.array([r[i] for r in rows], pa.string() if n in ("Material_Id", "kind", "ref") else None) for i, n in enumerate(names)})
    for size in (1, 7, 64, 5000):
        found = pa.Table.from_batches(list(ledger._folded(iter(table.to_batches(size))))).to_pylist()
        left = {r["Material_Id"] for r in found if r["accepted"] is None}
        assert left >= {rows[0][0], rows[-1][0]} and ("RM20" in left) == (size < 5000)  # a long one that one batch has is folded
        assert len(left) < 12  # the others are folded
        want = [r for r in plain(events, start) if r[0] not in left]
        assert sorted(tuple(r[n] for n in names[:-1]) + (r["accepted"], r["balance"]) for r in found if r["Material_Id"] not in left) == want
        apart = [(*(r[n] for n in names),) for r in found if r["Material_Id"] in left]
        assert apart == [r for r in rows if r[0] in left]  # whole, with the row that opens each


def test_materials_that_come_twice_and_without_stock(spark):
    """Each row of a material stands for a copy of its events, inside a partition as across cuts; without a stock no line finds any."""
    events = [(f"RM{m}", "reservation", 1, i, 1, 0, 0, f"S{i}") for m in range(30) for i in range(6)]
    events += [(f"RM{m}", "receipt", 3, 9, 0, 0, 0, "PO") for m in range(30)]
    much = 10 ** 17 + 1  # no double has it
    stocks = [(f"RM{m}", (2, None, much)[m % 3]) for m in range(30)] * 2
    all_found = []
    for parts in (2, 40):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            found = ledger.stock_ledger(spark.createDataFrame(events, ledger.LEDGER_SCHEMA),
                                        spark.createDataFrame(stocks, "material_Id string, quantity long")).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert len(found) == 2 * len(events)
        all_found.append(sorted(found))
        for m in range(30):
            taken = [(r.ref, r.balance) for r in found if r.Material_Id == f"RM{m}" and r.accepted and r.ref != "PO"]
            assert sorted(taken) == ([("S0", 1), ("S1", 0)], [], [(f"S{i}", much - 1 - i) for i in range(6)])[m % 3]
    assert all_found[0] == all_found[1]  # to the last unit, also of the number that stands for no stock


def held(spark):
    """Bytes of the shuffle files, and of what is stored in the shared folder, by file."""
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    shuffles = {f.getName(): f.length() for f in (local.apply(i) for i in range(local.size())) if f.getName().startswith("shuffle_")}
    root = shared_dir(spark).removeprefix("file:")
    stored = {os.path.join(d, x): os.path.getsize(os.path.join(d, x)) for d, _, names in os.walk(root) for x in names}
    return shuffles, stored


def test_ledger_holds_no_more_on_disk_than_its_last_copies(spark, tmp_path):
    """Shuffle files of a finished step are gone, and copies that no later step reads."""
    rng = np.random.default_rng(7)
    n = 20000
    keys, parts = rng.integers(1, n // 4, n), rng.integers(1, 800, n)
    spark.createDataFrame([(int(k), int(p), 1, i % 7 + 1, float(i % 50 + 1), f"1998-01-{i % 28 + 1:02d}") for i, (k, p) in enumerate(zip(keys, parts))],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_shipdate string").selectExpr(
        "* except (l_shipdate)", "to_date(l_shipdate) AS l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(1, n // 4).selectExpr("id AS o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(1, 800).selectExpr("id AS p_partkey", "concat('p', id) AS p_name", "'T' AS p_type", "CAST(id % 5 AS INT) AS p_size").write.parquet(
        str(tmp_path / "part.parquet"))
    before = held(spark)
    found = registry.queries()["e05_stock_ledger"](spark, str(tmp_path))
    shuffles, stored = ({k: v for k, v in now.items() if k not in was} for now, was in zip(held(spark), before))
    rows = found.count()
    assert rows > n
    assert sum(shuffles.values()) < 2 * rows  # 150 bytes a row in one shuffle of the events, and there are many
    assert sum(stored.values()) < 40 * rows
