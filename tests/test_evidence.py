"""Gates and records from reports of differing shape."""

import json

from tidemark.operators import evidence

GOOD = {"net_return_dollars": 100.0, "gross_return_dollars": 200.0, "cost_dollars": 50.0, "turnover_per_bar": 0.05, "trade_count": 7}
GOOD["net_return_dollars"] = 150.0


def report(**changes):
    parts = [{"scope": "market", "market": m, "net_return_dollars": n} for m, n in (("ES", 75.0), ("CL", 75.0))]
    parts += [{"scope": "fold", "fold_id": f, "net_return_dollars": 50.0} for f in range(3)]
    return {"metrics": {"overall": GOOD, "summaries": parts}, **changes}


def overall(**changes):
    return {"metrics": {**report()["metrics"], "overall": {**GOOD, **changes}}}


def rows(spark, *given):
    data = [(e, k, t if t is None or isinstance(t, str) else json.dumps(t)) for e, k, t in given]
    return spark.createDataFrame(data, "experiment string, kind string, text string")


def test_gate(spark):
    moved = {"metrics": {"summaries": "elsewhere"}, "costed_oos": {k: str(v) for k, v in GOOD.items()}, "markets": [{"net_return_dollars": 1}, {"net_return_dollars": "1"}, 3], "folds": [{"net_return_dollars": 1}]}
    cases = {
        "good": ([("metrics", report())], ""),
        "moved": ([("metrics", moved)], ""),
        "twice": ([("metrics", report()), ("metrics", report())], ""),
        "differ": ([("metrics", report()), ("metrics", report(profile="x"))], "ambiguous_evidence"),
        "loss": ([("metrics", overall(net_return_dollars=-1, gross_return_dollars=49))], "base_net_nonpositive|cost_stress_1_5x_nonpositive|cost_stress_2x_nonpositive"),
        "sum": ([("metrics", overall(net_return_dollars=140))], "cost_stress_unavailable|cost_stress_unavailable"),
        "nan": ([("metrics", overall(turnover_per_bar="NaN"))], "turnover_unavailable"),
        "busy": ([("metrics", overall(turnover_per_bar=0.2))], "turnover_above_ceiling"),
        "null": ([("metrics", {"metrics": {"overall": None}, "costed_oos": GOOD})], "base_net_nonpositive|cost_stress_unavailable|cost_stress_unavailable|turnover_unavailable|market_breakdown_unavailable|fold_pass_rate_unavailable"),
        "wfa": ([("metrics", report()), ("wfa", {"failure_count": "2"})], "validation_failure_markers_present"),
        "named": ([("metrics", report()), ("split", {"failures": ["a", {"b": 1}, None]})], "validation_failure_markers_present"),
        "ready": ([("metrics", report()), ("breakdown", {"artifact_evidence_ready": False})], "validation_failure_markers_present"),
        "zero": ([("metrics", report()), ("breakdown", {"artifact_evidence_ready": 0, "failures": "text"})], ""),
        "cut": ([("metrics", report()), ("wfa", '{"a": ')], "report_unreadable"),
        "list": ([("metrics", report()), ("wfa", "[1]")], "report_unreadable"),
        "absent": ([("metrics", report()), ("wfa", None)], ""),
        "none": ([("wfa", {})], "base_net_nonpositive|cost_stress_unavailable|cost_stress_unavailable|turnover_unavailable|market_breakdown_unavailable|fold_pass_rate_unavailable"),
        None: ([("metrics", report())], ""),
    }
    got = {r["experiment"]: r for r in evidence.gate(rows(spark, *[(e, k, t) for e, (reports, _) in cases.items() for k, t in reports])).collect()}
    assert {e: r["failures"] for e, r in got.items()} == {e: want for e, (_, want) in cases.items()}
    assert all(r["status"] == ("FAIL" if r["failures"] else "PASS") and r["failure_count"] == len([x for x in r["failures"].split("|") if x]) for r in got.values())
    assert got["named"]["markers"] == 3 and got["moved"]["market_count"] == 2 and got["good"]["top_share"] == 0.5 and got["good"]["cost_stress_2x"] == 100.0


def test_concentration_and_folds(spark):
    one = report()
    one["metrics"]["summaries"] = [{"scope": "market", "net_return_dollars": 3}, {"scope": "market", "net_return_dollars": 1}, {"scope": "market", "net_return_dollars": -9}, {"scope": "fold", "net_return_dollars": 1}, {"scope": "fold", "net_return_dollars": 0}]
    lost = report()
    lost["metrics"]["summaries"] = [{"scope": "market", "net_return_dollars": -3}, {"scope": "fold"}]
    got = {r["experiment"]: r for r in evidence.gate(rows(spark, ("one", "metrics", one), ("lost", "metrics", lost))).collect()}
    assert got["one"]["failures"] == "single_market_profit_contribution_above_cap|fold_pass_rate_below_minimum" and got["one"]["top_share"] == 0.75 and got["one"]["fold_pass_rate"] == 0.5
    assert got["lost"]["failures"] == "single_market_profit_contribution_above_cap|fold_pass_rate_unavailable"


def test_breakdowns_and_reasons(spark):
    df = rows(
        spark,
        ("a", "breakdown", {"side_damage": [{"side": "long", "net": 1}, 4], "outputs": {"market_side_hour": "x", "regime": "y"}, "unavailable_diagnostics": ["regime: none"], "failures": ["late"], "failure_count": 1}),
        ("a", "metrics", report(promotion_gate={"model_promotion_allowed": False, "promotion_blockers": ["net", "folds"]}, git_commit="m", costs_config="c")),
        ("a", "wfa", {"git_commit": "w", "fold_count": 3, "markets": ["ES"]}),
        ("a", "split", {"markets": ["CL"], "years": [2023, 2024]}),
    )
    g = evidence.gate(df).first()
    assert (g["side"], g["hour"], g["regime"], g["session"], g["markers"]) == ("available", "available", "unavailable", "unavailable", 2)
    parsed = evidence.parse(df)
    assert {(r["kind"], r["reason"]) for r in evidence.reasons(parsed).collect()} == {("breakdown", "failure_count is nonzero"), ("breakdown", "late")}
    assert {(r["kind"], r["reason"]) for r in evidence.reasons(parsed, promotion=True).collect()} == {("breakdown", "late"), ("metrics", "net"), ("metrics", "folds")}
    assert [tuple(r) for r in evidence.items(parsed, "breakdown", "$.side_damage", "side", "net").collect()] == [("a", "long", "1")]
    r = evidence.ledger(df, profile="p").first()
    assert (r["git_hash"], r["profile"], r["markets"], r["years"], r["folds"], r["configs"], r["trades"]) == ("m", "p", '["CL"]', "[2023,2024]", 3, "c", 7)
    assert r["reasons"] == 3 and not r["passed"] and len(json.loads(r["market_breakdown"])) == 2
    assert evidence.audited(df).first()["pass_fail_reason"] == "validation_failure_markers_present"


def test_manifests_and_promotion(spark):
    ok = {"prediction_count": 5, "output_file_hashes": {"a": "f0"}, "artifact_evidence_ready": True}
    files = {"ok": ok, "none": {}, "bad": "{", "hash": {**ok, "output_file_hashes": {"a": "NOT_WRITTEN"}}, "stale": {**ok, "stale_output_path_exists": True, "failure_count": 2}, "not": {**ok, "artifact_evidence_ready": False}}
    df = spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in files.items()], "path string, text string")
    got = {r["path"]: r["failures"] for r in evidence.manifests(df).collect()}
    assert got == {"ok": "", "none": "prediction_count is zero", "bad": "invalid json; prediction_count is zero", "hash": "output hash is NOT_WRITTEN", "stale": "failure_count is nonzero; stale prediction output exists", "not": "artifact_evidence_ready is false"}
    yes = {"research_alpha_ready": True, "model_promotion_allowed": True}
    p = rows(spark, ("a", "metrics", yes), ("a", "model_selection", yes), ("b", "metrics", {**yes, "failure_count": 1}), ("c", "wfa", {}), ("d", "metrics", "x"), ("d", "model_selection", {"research_alpha_ready": "true", "promotion_gate": {"promotion_blockers": ["n"]}}))
    assert {r["experiment"]: (r["failures"], r["blockers"]) for r in evidence.promotion(p).collect()} == {
        "a": ("", 0), "b": ("model_selection_missing|metrics_failed", 0), "c": ("metrics_missing|model_selection_missing", 0),
        "d": ("metrics_invalid|model_selection_not_ready|model_selection_not_allowed", 1)}


def test_no_reports(spark):
    empty = rows(spark)
    assert evidence.gate(empty).count() == evidence.ledger(empty).count() == evidence.promotion(empty).count() == 0
