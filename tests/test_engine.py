"""Rule engines, geometry, sources and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from parcelforge.operators import bundle, geo, rules
from parcelforge.plans import bundles, engine
from parcelforge.sources import exports, files


def test_registry_rejects_a_second_rule():
    with pytest.raises(ValueError):
        rules.rule("SHARE_MISSING", "again")(lambda p, t: None)


def test_disabled_rule_is_skipped(spark):
    policy = rules.Policy(rules={"TOTAL_AREA_MISSING": rules.Tolerance(enabled=False)})
    codes = {r.rule_code for r in rules.validate(engine.records(spark), policy, F.lit(engine.TODAY)).collect()}
    assert "TOTAL_AREA_MISSING" not in codes and "SHARE_MISSING" in codes


def test_clean_record_has_full_integrity(spark):
    r = {x.parcel_key: x for x in rules.report(engine.records(spark), rules.DEFAULT, F.lit(engine.TODAY)).collect()}
    assert r["clean"].integrity_score == 1.0 and not r["clean"].is_blocking and r["exceeds"].is_blocking


def test_policy_text():
    p = files.policy(json.dumps({"name": "x", "rules": {"AREA_SUM_MISMATCH": {"absolute_sq_metre": 2.0, "note": "n"}}}))
    assert p.of("AREA_SUM_MISMATCH").absolute == 2.0 and p.of("AREA_SUM_MISMATCH").relative == 0.005
    for bad in ({"rules": {"NOPE": {}}}, {"rules": {"SHARE_MISSING": {"colour": 1}}}, []):
        with pytest.raises(ValueError):
            files.policy(json.dumps(bad))


def test_risk_is_the_sum_of_contributions(spark):
    for r in bundles.reports(spark).collect():
        assert r.risk_score == round(min(100.0, sum(c.points for c in r.contributions)), 2)


def test_bundle_checks(spark):
    got = {}
    for r in bundles.reports(spark).collect():
        for c in r.checks:
            got.setdefault((r.case_id, c.rule), set()).add(c.status)
    assert got["wrong_deceased", "OWNER_IDENTITY_MATCH"] == {"fail"}
    assert got["other_khasra", "PARCEL_MATCH"] == {"fail"} and got["hissa", "PARCEL_MATCH"] == {"warning"}
    assert got["larger", "AREA_CONSISTENCY"] == {"fail", "pass"} and got["smaller", "AREA_CONSISTENCY"] == {"warning", "pass"} and got["close", "AREA_CONSISTENCY"] == {"pass"}
    assert got["deed_both", "EXCLUSIVE_TRANSFER_EVIDENCE"] == {"pass"} and got["deed_one", "EXCLUSIVE_TRANSFER_EVIDENCE"] == {"warning"} and got["deed_other", "EXCLUSIVE_TRANSFER_EVIDENCE"] == {"review_required"}
    assert got["early", "TRANSITION_AFTER_DEATH"] == {"fail"} and got["chain", "TRANSITION_CHAIN_COMPLETE"] == {"review_required"}
    assert got["no_mutation", "SUCCESSION_EVIDENCE"] == {"review_required"} and got["no_mutation", "MUTATION_RECORD_PRESENT"] == {"warning"}
    assert got["approximate", "NAME_MATCH_QUALITY"] == {"warning"} and got["base", "NAME_MATCH_QUALITY"] == {"pass"}
    assert len(bundle.REGISTRY) == 16  # fifteen checks, one of them in two parts


def test_timeline_is_dense_and_ordered(spark):
    for r in bundles.reports(spark).collect():
        assert [e.sequence for e in r.timeline] == list(range(len(r.timeline)))
        at = [e.anchor for e in r.timeline if e.anchor]
        assert at == sorted(at)


def _square(lat, lon, metres):
    from math import cos, radians

    dy = metres / 110_655.0
    dx = metres / (111_320.0 * cos(radians(lat)))
    return [(lon, lat), (lon + dx, lat), (lon + dx, lat + dy), (lon, lat + dy), (lon, lat)]


def test_geometry(spark):
    t = spark.createDataFrame([("a", _square(18.5, 73.9, 80))], f"parcel_key string, ring {geo.RING}")
    area = t.select(geo.ring_area(F.col("ring"))).first()[0]
    assert 6200 < area < 6600
    rec = lambda k, a, ocr=0.95: (k, a, ocr, 0.95, 1.0)
    records = spark.createDataFrame([rec("a", area), rec("none", area)], "parcel_key string, textual_area double, ocr double, llm double, integrity double")
    got = {r.parcel_key: r for r in geo.discrepancies(records, t.withColumn("source", F.lit("cadastral_shapefile"))).collect()}
    assert got["a"].band == "exact" and got["a"].recommended_action == "auto_approve" and got["a"].mismatch_score == 0
    assert got["none"].band == "undetermined" and got["none"].confidence_score <= 0.55 and not got["none"].geometry_matched
    low = geo.discrepancies(spark.createDataFrame([rec("a", area * 1.15, 0.2)], records.schema), t.withColumn("source", F.lit("mock"))).first()
    assert low.band == "severe" and low.mismatch_score == 100 and low.confidence_score <= 0.2 and low.recommended_action == "reject_re_scan"


def test_overlap_of_shifted_squares():
    p = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    q = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0), (1.0, 1.0)]
    notched = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (1.0, 1.0), (0.0, 2.0), (0.0, 0.0)]
    assert abs(geo.intersection_area(p, q) - 1) < 1e-9
    assert abs(geo.intersection_area(p, notched) - 3) < 1e-9
    assert geo.intersection_area(p, [(x + 9, y) for x, y in p]) == 0


def test_csv_and_html(spark):
    df = spark.createDataFrame([(1, 'a,"b"', None), (2, "ग्राम", True)], "id int, name string, ok boolean").orderBy("id")
    assert b"".join(exports.csv_stream(df)).decode() == '﻿id,name,ok\n1,"a,""b""",\n2,ग्राम,True\n'
    row = df.first()
    page = exports.report_html(row, [], [spark.createDataFrame([("<x>",)], "c string").first()], [])
    assert "&lt;x&gt;" in page and "<x>" not in page


def test_geojson_round_trip(spark, tmp_path):
    p = spark.createDataFrame([("k1", 1, [(1.0, 2.0), (3.0, 2.0), (3.0, 4.0), (1.0, 2.0)]), ("k2", 2, None)], f"parcel_key string, id int, ring {geo.RING}")
    row = exports.feature_collection(p, ("parcel_key",)).first()
    (tmp_path / "x.json").write_text(row.collection)
    back = files.geojson(spark, str(tmp_path / "x.json")).collect()
    assert [(r.parcel_key, len(r.parts[0][0])) for r in back] == [("k1", 4)] and json.loads(row.collection)["without_geometry"] == 1


def test_messages_cover_every_status_that_is_not_clear(spark):
    rows = bundle.validate(spark.createDataFrame(bundles.cases(), bundle.CASE)).select("case_id", F.explode("checks").alias("c")).select("case_id", "c.*").collect()
    assert all((r.message is None) == (r.status in ("pass", "not_applicable")) for r in rows)
    one = next(r for r in rows if r.case_id == "wrong_deceased" and r.rule == "OWNER_IDENTITY_MATCH")
    assert (one.observed, one.expected, list(one.documents)) == ("Mahesh Kulkarni", "Ramesh Sharma", ["death of Mahesh Kulkarni", "old"])


def test_events_of_revalidated_cases_are_replaced(spark):
    reports = bundle.validate(spark.createDataFrame(bundles.cases()[:2], bundle.CASE))
    fresh = bundle.ownership_events(reports)
    stored = spark.createDataFrame([("base", "key", "other", None, None, False, None, 0), ("elsewhere", "key", "other", None, None, False, None, 7)], fresh.schema)
    out = bundle.replaced_events(stored, reports).collect()
    assert [r.sequence for r in out if r.case_id == "elsewhere"] == [7]
    assert sorted(r.sequence for r in out if r.case_id == "base") == list(range(sum(r.case_id == "base" for r in fresh.collect())))


def test_assembly_puts_register_snapshots_first(spark):
    base = bundles.cases()[0]
    documents = spark.createDataFrame([base], bundle.CASE).withColumn("document_ids", F.array(F.lit("d9"), F.lit("d1")))
    register = documents.select("parcel_key", F.lit("d1").alias("document_id"), F.get("snapshots", F.lit(0)).withField("label", F.lit("register")).alias("snapshot"))
    r = bundle.assembled(register, documents).first()
    assert [s.label for s in r.snapshots] == ["register", "old", "new"] and list(r.document_ids) == ["d1", "d9"] and r.case_id == "base"
    alone = bundle.assembled(register.filter("false"), documents).first()
    assert [s.label for s in alone.snapshots] == ["old", "new"] and list(alone.document_ids) == ["d1", "d9"]


def test_literal_cases_give_their_outcomes(spark):
    rows = bundles.reports(spark).collect()
    assert sorted((r.case_id, r.outcome, r.risk_level, r.risk_score) for r in rows) == sorted(bundles.EXPECTED)
    assert {(r.outcome, r.recommended_action) for r in rows} <= set(bundle.ACTIONS.items())
    diff = {r.case_id: (r.gone, r.left, r.kept) for r in bundle.prepared(spark.createDataFrame(bundles.cases(), bundle.CASE)).select("case_id", F.size("__diff.gone").alias("gone"), F.size("__diff.left").alias("left"), F.size("__diff.kept").alias("kept")).collect()}
    assert diff["not_updated"] == (0, 0, 1) and diff["empty"] == (0, 0, 0) and diff["base"] == (1, 1, 0)
    heirs = {r.case_id: len(r.heirs) for r in rows}
    assert (heirs["base"], heirs["sole_heir"], heirs["chain"]) == (3, 1, 0)


def test_python_folds_are_those_of_columns(spark):
    from parcelforge.functions import identifiers, names

    raw = ["Shri/Late Ramesh  Sharma", "Smt. सीता S/O Ram", "राम बिन हरि", "Ｒａｍ　K.", "क़मर १२३", "A B s/o C D", "", None, "  m/s X-Y ", "İstanbul Σ", "O'Neil\t(Late)", "W/O", "x wife of"]
    plots = [" 0125 / 2 ", "१२५-०२", "a_007.00", "000", "é01/x010", None, "", "Angol (New)", "12 3"]
    got = spark.createDataFrame([(x,) for x in raw], "t string").select("t", names.normalized(F.col("t")).alias("f")).collect()
    assert [(r.t, r.f) for r in got] == [(r.t, names.folded_of(r.t)) for r in got]
    got = spark.createDataFrame([(x,) for x in plots], "t string").select("t", identifiers.normalized(F.col("t")).alias("a"), identifiers.place(F.col("t")).alias("b")).collect()
    assert [(r.t, r.a, r.b) for r in got] == [(r.t, identifiers.normalized_of(r.t), identifiers.place_of(r.t)) for r in got]


def test_reports_work_out_what_is_asked_for(spark, monkeypatch):
    from parcelforge.operators import casework

    monkeypatch.setattr(casework, "timeline", None)
    monkeypatch.setattr(casework, "evidence", None)
    cases = spark.createDataFrame(bundles.cases(), bundle.CASE)
    out = [x for b in casework.Reports(("case_id", "outcome", "checks"), ("rule", "status"), None, ())(iter(cases.toArrow().to_batches())) for x in b.to_pylist()]
    assert {r["case_id"]: r["outcome"] for r in out} == {c: o for c, o, *_ in bundles.EXPECTED} and set(out[0]["checks"][0]) == {"rule", "status"}
    assert bundle.validate(cases, columns=("case_id", "risk_score")).columns == ["case_id", "risk_score"]


def test_rows_of_reports_keep_cases_of_one_id_apart(spark):
    two = [("same", *c[1:]) for c in bundles.cases() if c[0] in ("base", "sole_heir")]
    rows = bundle.report_rows(bundle.validate(spark.createDataFrame(two, bundle.CASE))).collect()
    assert sorted((r.outcome, bool(r.issues)) for r in rows) == [("review_required", True), ("validated", False)]


def test_only_rules_that_give_a_code_are_run(spark, monkeypatch):
    def never(policy, today):
        raise AssertionError("run for nothing")

    for code in rules.REGISTRY:
        if code != "SHARE_SUM_NOT_UNITY":
            monkeypatch.setitem(rules.REGISTRY, code, ("", never))
    rows = rules.validate(engine.records(spark), rules.DEFAULT, F.lit(engine.TODAY), ("SHARE_SUM_EXCEEDS_UNITY",)).collect()
    assert {(r.parcel_key, r.observed) for r in rows} == {("shares_over", "4/3")}


def test_divisors_of_numbers_of_many_steps(spark):
    from math import gcd

    from parcelforge.functions import shares

    f = [1, 1]
    while len(f) < 86:
        f.append(f[-1] + f[-2])
    pairs = [(f[-1], f[-2]), (f[-2], f[-1]), (f[40], f[39] * 3), (0, 7), (7, 0), (0, 0), (9, 10**17), (12, -18)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", shares.gcd(F.col("a"), F.col("b")).alias("g")).collect()
    assert [(r.a, r.b, r.g) for r in got] == [(a, b, gcd(a, b)) for a, b in pairs]


def test_rates_are_written_as_sql_writes_them(spark):
    import random

    r = random.Random(5)
    values = [(2 * k + 1) / 20000 for k in range(400)] + [-0.00015, 0.0, 0.03125, 0.09375, 1.00005, 123456.78905, 2e9, 11 / 20000] + [r.random() / 100 for _ in range(200)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", rules.four_places(F.col("v")).alias("t"), F.format_string("%.4f", F.col("v")).alias("j")).collect()
    assert [(x.v, x.t) for x in got] == [(v, f"{v:.4f}") for v in values]
    assert any(x.t != x.j for x in got)
