"""The pipeline's stages against a brute-force version, and the SQL of the queries that have one."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import corpus_pipeline  # noqa: E402
from check_oracle import digest, duck  # noqa: E402
from larder.llm import langid, quality, queries, secrets  # noqa: E402
from larder.llm.common import stored  # noqa: E402
from tests.llm.cases import ROWS, frame  # noqa: E402
from tests.llm.test_native import counts  # noqa: E402
from tests.llm.test_simhash import components, simhash  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_matches_sql(spark, name, sf):
    df = queries.queries()[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    found = duck(sf).execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    want = found.fetchall()
    assert sorted(df.columns) == sorted(columns) and len(rows) == len(want)
    assert digest(rows, df.columns) == digest(want, columns)


def test_stages_by_hand(spark):
    """Each stage's result from its input: row by row, and all pairs of fingerprints."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        steps[name] = docs
        docs = stored(spark, stage(spark, docs, SF), name)
    steps["end"] = docs
    rows = {k: [r.asDict() for r in v.collect()] for k, v in steps.items()}
    assert all(steps[k].columns == columns for k in steps if k != "end")

    judged = {r.doc_id: r.kept for r in quality.measure(steps["quality_rules"]).collect()}
    assert {r["doc_id"] for r in rows["language_id"]} == {d for d, kept in judged.items() if kept}
    assert not any(counts(r["text"])[-1] for r in rows["language_id"])

    model = langid.train(langid.learned_rows(steps["language_id"]))
    spoken = {r.doc_id: r for r in langid.identify(steps["language_id"], model, ["doc_id"]).collect()}
    assert {r["doc_id"] for r in rows["simhash_dedup"]} == {
        d for d, r in spoken.items() if r.lang_pred != "und" and r.score >= 0.3}

    prints = {r["doc_id"]: simhash(r["text"]) for r in rows["simhash_dedup"]}
    root, best = components(prints.values()), {}
    for d, f in prints.items():
        best[root[f]] = min(best.get(root[f], d), d)
    assert sorted(r["doc_id"] for r in rows["secret_scan"]) == sorted(best.values())

    before = {r["doc_id"]: r["text"] for r in rows["secret_scan"]}
    spans = dict(secrets.scan(steps["secret_scan"], secrets.train(steps["secret_scan"])).select("row.doc_id", "spans").collect())
    for r in rows["packing"]:
        text, out, at = before[r["doc_id"]], [], 0
        for s in spans[r["doc_id"]]:
            if s.start >= at:
                out += [text[at:s.start], secrets.REDACTED]
            at = max(at, s.end)
        assert r["text"] == "".join(out) + text[at:] and r["n_chars"] == len(r["text"])

    packed = {}
    for p in rows["end"]:
        packed.setdefault(p["doc_id"], []).append((p["start"], p["ids"]))
    assert set(packed) == {r["doc_id"] for r in rows["packing"]}
    assert sum(p["length"] for p in rows["end"]) == sum(
        {p["doc_id"]: p["doc_tokens"] for p in rows["end"]}.values())


@pytest.mark.parametrize("rows", [[], ROWS])
def test_stages_take_odd_rows(spark, rows):
    docs = frame(spark, rows, lang=True)
    for name, stage in corpus_pipeline.STAGES:
        out = stored(spark, stage(spark, docs, SF), name)
        if name == "packing":
            assert sum(r.length for r in out.collect()) == sum({r.doc_id: r.doc_tokens for r in out.collect()}.values())
        else:
            assert out.columns == docs.columns and out.count() <= docs.count()
            docs = out


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and corpus_pipeline.ORACLE_SQL is None
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "simhash_dedup", "secret_scan", "packing"]
