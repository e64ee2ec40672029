"""Gates and ledgers over reports that the policy frame writes, in the shapes that different writers use.

An experiment is the whole frame (``all``) or one market. By its number of trades a metrics report is nested, flat with numbers as text, or
without turnover and folds; a second experiment of each market has its report cut short. Twins work from the frame and read no report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import evidence
from tidemark.plans.registry import q, query
from tidemark.plans.research_queries import POLICY, _quantized, frame
from tidemark.sources.staging import shared_path, stage
from tidemark.sources.tables import append_jsonl

_c = F.col


def _reports(spark, sf_dir) -> DataFrame:
    """Reports of every experiment, written as text and read back."""
    money = {"gross_return_dollars": "gross", "net_return_dollars": "net", "cost_dollars": "cost"}
    sums = [F.sum(v).alias(k) for k, v in money.items()]
    cells = frame(spark, sf_dir).groupBy("market", "fold_id").agg(*sums, F.sum("turnover").alias("turnover"), F.count("*").alias("n"), F.count_if(_c("position") != 0).alias("trade_count"))
    cells = stage(cells, "report-cells").withColumn("experiment", F.explode(F.array(F.lit("all"), "market")))
    total = cells.groupBy("experiment").agg(*[F.sum(k).alias(k) for k in (*money, "trade_count")], (F.sum("turnover") / F.sum("n")).alias("turnover_per_bar"))

    def part(scope: str, key: str) -> DataFrame:
        one = cells.groupBy("experiment", key).agg(F.sum("net_return_dollars").alias("net_return_dollars"))
        lost = F.count_if(_c("net_return_dollars") <= 0).alias(f"lost_{scope}s")
        return one.groupBy("experiment").agg(F.collect_list(F.struct(F.lit(scope).alias("scope"), _c(key).cast("string").alias(key), "net_return_dollars")).alias(f"{scope}s"), lost)

    df = stage(total.join(part("market", "market"), "experiment").join(part("fold", "fold_id"), "experiment"), "report-parts")
    numbers = [*money, "trade_count", "turnover_per_bar"]
    nested = lambda *without: F.struct(*[_c(n) for n in numbers if n not in without])
    as_json = lambda *cols: F.to_json(F.struct(*cols))
    items = lambda c: F.transform(c, lambda x: F.to_json(x))  # noqa: E731  each scope has a key of its own
    listed = lambda *cs: F.concat(F.lit("["), F.array_join(F.concat(*[items(c) for c in cs]), ","), F.lit("]"))
    shape = _c("trade_count") % 3
    text = (
        F.when(shape == 0, F.concat(F.lit('{"profile":"smoke","costs_config":"costs","metrics":{"overall":'), F.to_json(nested()), F.lit(',"summaries":'), listed("markets", "folds"), F.lit("}}")))
        .when(shape == 1, as_json(F.struct(F.lit("elsewhere").alias("summaries")).alias("metrics"), F.struct(*[_c(n).cast("string").alias(n) for n in numbers]).alias("costed_oos"), "markets", "folds"))
        .otherwise(F.concat(F.lit('{"metrics":{"overall":'), F.to_json(nested("turnover_per_bar")), F.lit(',"summaries":'), listed("markets"), F.lit("}}")))
    )
    lost = F.transform(F.filter("folds", lambda x: x["net_return_dollars"] <= 0), lambda x: F.concat(F.lit("fold "), x["fold_id"]))
    wfa = as_json(F.size("folds").alias("fold_count"), _c("lost_folds").alias("failure_count"), F.when(_c("lost_folds") % 2 == 0, lost).alias("failures"))
    split = as_json((_c("net_return_dollars") > 0).alias("artifact_evidence_ready"), F.lit("none").alias("failures"), F.transform("markets", lambda x: x["market"]).alias("markets"), F.array(F.lit(2024)).alias("years"))
    sides = as_json(F.transform("markets", lambda x: F.struct(x["market"].alias("market"), x["net_return_dollars"].alias("net"))).alias("side_damage"), F.struct(F.lit("hours").alias("market_side_hour"), F.lit("regimes").alias("regime")).alias("outputs"), F.array(F.lit("regime: no column")).alias("unavailable_diagnostics"))
    ready = as_json((_c("net_return_dollars") > 0).alias("research_alpha_ready"), F.lit(True).alias("model_promotion_allowed"), F.struct(lost.alias("promotion_blockers")).alias("promotion_gate"))
    one = lambda kind, body: F.struct(F.lit(kind).alias("kind"), body.alias("text"))
    every = df.select("experiment", F.explode(F.array(one("metrics", text), one("wfa", wfa), one("split", split), one("breakdown", sides), one("model_selection", ready))).alias("r")).select("experiment", "r.*")
    every = every.where("kind <> 'wfa' or experiment <> 'all'")
    cut = df.where("experiment <> 'all'").select(F.concat("experiment", F.lit("_cut")).alias("experiment"), F.lit("metrics").alias("kind"), F.left(text, F.lit(40)).alias("text"))
    path = shared_path(spark, "reports")
    every.unionByName(cut).write.partitionBy("experiment", "kind").text(path)
    return evidence.read(spark, path)


_EX = f"""with {POLICY}, cells as (select market, fold_id, sum(gross) as gross, sum(net) as net, sum(cost) as cost, sum(turnover) as turnover, count(*) as n, count(*) filter (where position <> 0) as trades from pf group by 1, 2),
ec as (select 'all' as experiment, * from cells union all select market, * from cells),
tot as (select experiment, sum(gross) as gross, sum(net) as net, sum(cost) as cost, sum(turnover) / sum(n) as turn, cast(sum(trades) as bigint) as trades from ec group by 1),
mk as (select experiment, cast(count(*) as int) as markets, max(n) as best, sum(greatest(n, 0)) as gain from (select experiment, market, sum(net) as n from ec group by 1, 2) group by 1),
fo as (select experiment, cast(count(*) as int) as folds, count(*) filter (where n > 0) / count(*) as rate, cast(count(*) filter (where n <= 0) as int) as lost from (select experiment, fold_id, sum(net) as n from ec group by 1, 2) group by 1),
ex as (select *, case when trades % 3 <> 2 then turn end as seen_turn, case when trades % 3 <> 2 then rate end as seen_rate, case when gain > 0 then best / gain end as share,
    case when experiment <> 'all' then (lost > 0)::int + case when lost % 2 = 0 then lost else 0 end else 0 end + (net <= 0)::int as markers from tot join mk using (experiment) join fo using (experiment)),
gt as (select *, list_filter([case when net <= 0 then 'base_net_nonpositive' end, case when gross - 1.5 * cost <= 0 then 'cost_stress_1_5x_nonpositive' end, case when gross - 2 * cost <= 0 then 'cost_stress_2x_nonpositive' end,
    case when seen_turn is null then 'turnover_unavailable' when seen_turn > 0.1 then 'turnover_above_ceiling' end, case when coalesce(share, 1) > 0.5 then 'single_market_profit_contribution_above_cap' end,
    case when seen_rate is null then 'fold_pass_rate_unavailable' when seen_rate < 1 then 'fold_pass_rate_below_minimum' end, case when markers > 0 then 'validation_failure_markers_present' end], lambda x: x is not null) as names from ex)"""
_NONE = "base_net_nonpositive|cost_stress_unavailable|cost_stress_unavailable|turnover_unavailable|market_breakdown_unavailable|fold_pass_rate_unavailable|report_unreadable"
_GATED = ["base_cost_net", "cost_stress_1_5x", "cost_stress_2x", "turnover_per_bar", "top_share", "fold_pass_rate"]


@query(
    "gov_robustness",
    f"""{_EX} select experiment, case when len(names) = 0 then 'PASS' else 'FAIL' end as status, cast(len(names) as int) as failure_count, array_to_string(names, '|') as failures, {q('net')} as base_cost_net, {q('gross - 1.5 * cost')} as cost_stress_1_5x,
    {q('gross - 2 * cost')} as cost_stress_2x, {q('seen_turn')} as turnover_per_bar, markets as market_count, {q('share')} as top_share, case when trades % 3 <> 2 then folds else 0 end as fold_count, {q('seen_rate')} as fold_pass_rate, cast(markers as bigint) as markers,
    'available' as side, 'available' as hour, 'unavailable' as session, 'unavailable' as regime from gt
    union all select experiment || '_cut', 'FAIL', 7, '{_NONE}', null, null, null, null, 0, null, 0, null, 0, 'unavailable', 'unavailable', 'unavailable', 'unavailable' from gt where experiment <> 'all'""",
)
def gov_robustness(spark, sf_dir):
    """The gate over reports of every experiment; reports cut short fail."""
    return _quantized(evidence.gate(_reports(spark, sf_dir)), _GATED)


_FLAT = "trades % 3 <> 1"  # shapes whose overall numbers stand where a ledger looks
_RECORD = f"""select experiment, 'smoke' as command, case when trades % 3 = 0 then 'smoke' end as profile, case when trades % 3 = 0 then 'costs' else '' end as configs, case when {_FLAT} then {q('gross')} end as gross_return_dollars, case when {_FLAT} then {q('net')} end as net_return_dollars,
    case when {_FLAT} then {q('cost')} end as cost_dollars, case when trades % 3 = 0 then {q('turn')} end as turnover_per_bar, case when {_FLAT} then trades end as trades, case when experiment <> 'all' then folds end as folds, '[2024]' as years, cast(markets as bigint) as side_rows"""


@query(
    "gov_ledger",
    f"""{_EX}, r as ({_RECORD}, cast(case when experiment = 'all' then 0 when lost % 2 = 0 then lost else 1 end as bigint) as reasons from ex), a as (select *, reasons = 0 as passed from r
    union all select experiment || '_cut', 'smoke', null, '', null, null, null, null, null, null, null, 0, 0, true from ex where experiment <> 'all') select *, cast(2 as bigint) as records from a""",
)
def gov_ledger(spark, sf_dir):
    """Records appended twice to a ledger and read back."""
    path = shared_path(spark, "ledger")
    names = ["experiment", "command", "profile", "configs", "gross_return_dollars", "net_return_dollars", "cost_dollars", "turnover_per_bar", "trades", "folds", "years", "side_rows", "reasons", "passed"]
    records = stage(evidence.ledger(_reports(spark, sf_dir), command="smoke").select(*names), "records")
    for _ in range(2):
        append_jsonl(records, path)
    back = spark.read.schema(records.schema).json(path)
    return _quantized(back.groupBy(*names).agg(F.count("*").alias("records")), ["gross_return_dollars", "net_return_dollars", "cost_dollars", "turnover_per_bar"])


@query("gov_anti_overfit", f"{_EX} select experiment, 'smoke' as command, case when len(names) = 0 then 'PASS' else 'FAIL' end as robustness_status, len(names) = 0 as passed, array_to_string(names, '|') as pass_fail_reason, case when {_FLAT} then {q('net')} end as net_return_dollars from gt union all select experiment || '_cut', 'smoke', 'FAIL', false, '{_NONE}', null from gt where experiment <> 'all'")
def gov_anti_overfit(spark, sf_dir):
    df = evidence.audited(_reports(spark, sf_dir), command="smoke")
    return _quantized(df.select("experiment", "command", "robustness_status", "passed", "pass_fail_reason", "net_return_dollars"), ["net_return_dollars"])


@query(
    "gov_failure_reasons",
    f"""{_EX}, lf as (select experiment, fold_id from ec where experiment <> 'all' group by 1, 2 having sum(net) <= 0), x as (select experiment, 'wfa' as kind, 'failure_count is nonzero' as reason from ex where experiment <> 'all' and lost > 0
    union all select experiment, 'wfa', 'fold ' || fold_id from lf join ex using (experiment) where lost % 2 = 0 union all select experiment, 'split', 'artifact_evidence_ready is false' from ex where net <= 0) select experiment, kind, reason, count(*) as n from x group by 1, 2, 3""",
)
def gov_reasons(spark, sf_dir):
    """Every failure that some report states."""
    return evidence.reasons(evidence.parse(_reports(spark, sf_dir)))


@query("val_promotion_evidence", f"{_EX} select experiment, 'FAIL' as status, 'metrics_not_ready|metrics_not_allowed' || case when net > 0 then '' else '|model_selection_not_ready' end as failures, cast(lost as bigint) as blockers from ex union all select experiment || '_cut', 'FAIL', 'model_selection_missing|metrics_invalid', 0 from ex where experiment <> 'all'")
def val_promotion(spark, sf_dir):
    return evidence.promotion(_reports(spark, sf_dir))


@query(
    "val_manifests",
    f"""with {POLICY}, m as (select market, fold_id, count(*) as n, count(*) filter (where p_fade is null) as gaps, count(*) filter (where position <> 0) as trades from pf group by 1, 2) select market || '/' || fold_id as path, gaps = 0 and trades % 4 > 0 and trades % 5 > 0 and n % 7 > 0 as artifact_evidence_ready,
    cast(gaps as int) as failure_count, n as prediction_count, trades % 5 = 0 as stale_output_path_exists, array_to_string(list_filter([case when gaps > 0 then 'failure_count is nonzero' end, case when trades % 4 = 0 then 'output hash is NOT_WRITTEN' end, case when trades % 5 = 0 then 'stale prediction output exists' end, case when n % 7 = 0 then 'artifact_evidence_ready is false' end], lambda x: x is not null), '; ') as failures from m""",
)
def val_manifests(spark, sf_dir):
    """A manifest for each market and fold, stating predictions without a fade probability as failures."""
    m = frame(spark, sf_dir).groupBy("market", "fold_id").agg(F.count("*").alias("prediction_count"), F.count_if(_c("p_fade").isNull()).alias("failure_count"), F.count_if(_c("position") != 0).alias("trades"))
    name = lambda k: F.concat("market", F.lit(f"_{k}"))
    hashes = F.create_map(name("folds"), F.sha2("market", 256), name("predictions"), F.when(_c("trades") % 4 == 0, "NOT_WRITTEN").otherwise(F.sha2(_c("fold_id").cast("string"), 256)))
    text = F.to_json(F.struct("prediction_count", "failure_count", hashes.alias("output_file_hashes"), F.when(_c("trades") % 5 == 0, True).alias("stale_output_path_exists"), F.when(_c("prediction_count") % 7 == 0, False).alias("artifact_evidence_ready")))
    return evidence.manifests(m.select(F.concat_ws("/", "market", "fold_id").alias("path"), text.alias("text")))
