"""Gates, ledger records and manifest checks that read reports: nested JSON whose shape differs from writer to writer.

A table of reports has a row for each: ``experiment``, ``kind`` (metrics, wfa, split, breakdown, model_selection) and ``text``. Texts become
VARIANT, each report is taken down to a few numbers in its own row, and one aggregation by experiment does the rest. Whatever is absent, of
another type, not finite or unreadable counts as missing, and what is missing fails. Lists that may be long (reasons, sides) are tables
of their own (``reasons``, ``items``), never arrays of a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import finite

_c = F.col


@dataclass(frozen=True)
class Limits:
    turnover: float = 0.10
    fold_pass_rate: float = 1.0
    market_share: float = 0.50


def read(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Reports of a folder ``experiment=…/kind=…/``: one a line, or one a file where ``whole``."""
    return spark.read.schema("text string, experiment string, kind string").option("wholetext", whole).text(path)


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _number(v: Column, name: str) -> Column:
    return finite(_get(v, f"$.{name}", "double"))


def _list(v: Column, path: str) -> Column:
    """The list at a path; empty if there is none, or something else."""
    return F.coalesce(_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _false(v: Column, path: str) -> Column:
    """There, a boolean, and false."""
    found = _get(v, path)
    return _is(found, "BOOLEAN") & ~F.coalesce(_get(v, path, "boolean"), F.lit(True))


def _true(v: Column, path: str) -> Column:
    return _is(_get(v, path), "BOOLEAN") & F.coalesce(_get(v, path, "boolean"), F.lit(False))


def _failure_count(v: Column) -> Column:
    return F.coalesce(_get(v, "$.failure_count", "int"), F.lit(0))


def parse(reports: DataFrame) -> DataFrame:
    """Adds ``v``, NULL where the text is no JSON object, and ``unreadable``. A NULL text is a report that is not there."""
    v = F.try_parse_json("text")
    return reports.withColumn("v", v).withColumn("unreadable", _c("text").isNotNull() & ~_is(_c("v"), "OBJECT")).withColumn("v", F.when(_is(_c("v"), "OBJECT"), _c("v")))


def overall(v: Column) -> Column:
    """``metrics.overall``; ``costed_oos`` where that key is absent."""
    return F.coalesce(_get(v, "$.metrics.overall"), _get(v, "$.costed_oos"))


def summaries(v: Column, scope: str) -> Column:
    """Objects of ``metrics.summaries`` in a scope. If that is there but is no list, the list ``<scope>s`` of the report."""
    at = _get(v, "$.metrics.summaries")
    mine = F.filter(_list(v, "$.metrics.summaries"), lambda x: F.coalesce(_get(x, "$.scope", "string") == scope, F.lit(False)))
    other = F.filter(_list(v, f"$.{scope}s"), lambda x: _is(x, "OBJECT"))
    return F.when(at.isNotNull() & ~_is(at, "ARRAY"), other).otherwise(mine)


def items(parsed: DataFrame, kind: str, path: str, *fields: str) -> DataFrame:
    """One row for each object of a list in reports of a kind, with these fields as text."""
    rows = parsed.where(_c("kind") == kind).select("experiment", F.explode(_list(_c("v"), path)).alias("x"))
    return rows.where(_is(_c("x"), "OBJECT")).select("experiment", *[_get(_c("x"), f"$.{f}", "string").alias(f) for f in fields])


def reasons(parsed: DataFrame, promotion: bool = False) -> DataFrame:
    """(experiment, kind, reason, n): every failure that a report states. With ``promotion``, what blocks a promotion as well."""
    v = _c("v")
    failures, counted = _list(v, "$.failures"), _failure_count(v) > 0
    named = F.transform(failures, lambda x: F.coalesce(_get(x, "$", "string"), F.lit("null")))
    if promotion:
        counted = counted & (F.size(failures) == 0)
    parts = [F.when(counted, F.array(F.lit("failure_count is nonzero"))), named]
    if promotion:
        parts.append(F.when(_false(v, "$.promotion_gate.model_promotion_allowed"), F.transform(_list(v, "$.promotion_gate.promotion_blockers"), lambda x: F.coalesce(_get(x, "$", "string"), F.lit("null")))))
    else:
        parts.append(F.when(_false(v, "$.artifact_evidence_ready"), F.array(F.lit("artifact_evidence_ready is false"))))
    every = F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts])
    return parsed.select("experiment", "kind", F.explode(every).alias("reason")).groupBy("experiment", "kind", "reason").agg(F.count("*").alias("n"))


def _stated(v: Column) -> Column:
    """How many failures a report states, as ``reasons`` lists them."""
    return (_failure_count(v) > 0).cast("long") + F.size(_list(v, "$.failures")) + _false(v, "$.artifact_evidence_ready").cast("long")


def _facts(parsed: DataFrame) -> DataFrame:
    """What a gate needs of each report, in its own row."""
    v, is_metrics, is_breakdown = _c("v"), _c("kind") == "metrics", _c("kind") == "breakdown"
    of = lambda c: F.when(is_metrics, c)
    nets = lambda scope: F.transform(summaries(v, scope), lambda x: _number(x, "net_return_dollars"))
    gains = F.filter(_c("market_nets"), lambda x: x > 0)
    says = lambda word: F.exists(_list(v, "$.unavailable_diagnostics"), lambda x: F.coalesce(_get(x, "$", "string").contains(word), F.lit(False)))
    flag = lambda c: F.coalesce(is_breakdown & c, F.lit(False))
    o = overall(v)
    wide = parsed.select(
        "experiment",
        "unreadable",
        of(F.sha2("text", 256)).alias("digest"),
        *[of(_number(o, f"{n}_return_dollars")).alias(n) for n in ("net", "gross")],
        of(_number(o, "cost_dollars")).alias("cost"),
        of(_number(o, "turnover_per_bar")).alias("turnover_per_bar"),
        of(nets("market")).alias("market_nets"),
        of(nets("fold")).alias("fold_nets"),
        F.coalesce(_stated(v), F.lit(0)).alias("stated"),
        flag(F.size(_list(v, "$.side_damage")) > 0).alias("side"),
        *[flag(_get(v, f"$.outputs.{key}").isNotNull()).alias(name) for name, key in (("hour", "market_side_hour"), ("regime", "regime"))],
        *[flag(says(key)).alias(f"no_{name}") for name, key in (("hour", "market_side_hour"), ("regime", "regime"))],
    )
    return wide.select(
        *[c for c in wide.columns if not c.endswith("_nets")],
        F.when(_c("market_nets").isNotNull(), F.size("market_nets")).alias("markets"),
        F.array_max(gains).alias("best"),
        F.aggregate(gains, F.lit(0.0), lambda a, x: a + x).alias("gain"),
        F.when(_c("fold_nets").isNotNull(), F.size("fold_nets")).alias("folds"),
        F.size(F.filter("fold_nets", lambda x: x.isNull())).alias("folds_unknown"),
        F.size(F.filter("fold_nets", lambda x: x > 0)).alias("folds_passed"),
    )


def gate(reports: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row an experiment: status, what fails in the order of the checks, the checks, and which breakdowns there are.

    Equal reports count once, but for the number of failures stated. Metrics reports of one experiment that differ are ``ambiguous_evidence``.
    A breakdown by hour or regime is there if some report puts it out and none calls it unavailable.
    """
    most = ["net", "gross", "cost", "turnover_per_bar", "markets", "best", "gain", "folds", "folds_unknown", "folds_passed"]
    g = _facts(parse(reports)).groupBy("experiment").agg(
        *[F.max(n).alias(n) for n in most],
        F.coalesce(F.min("digest") != F.max("digest"), F.lit(False)).alias("ambiguous"),
        F.max("unreadable").alias("unreadable"),
        F.sum("stated").cast("long").alias("markers"),
        *[F.max(n).alias(n) for n in ("side", "hour", "regime", "no_hour", "no_regime")],
    )
    net, gross, cost = _c("net"), _c("gross"), _c("cost")
    adds_up = F.coalesce(F.abs(gross - cost - net) <= F.greatest(F.lit(1e-6), F.abs(net) * 1e-9), F.lit(False))
    g = g.withColumns(
        {
            "cost_stress_1_5x": F.when(adds_up, gross - 1.5 * cost),
            "cost_stress_2x": F.when(adds_up, gross - 2.0 * cost),
            "market_count": F.coalesce("markets", F.lit(0)),
            "fold_count": F.coalesce("folds", F.lit(0)),
            "top_share": F.when(_c("gain") > 0, _c("best") / _c("gain")),
            "fold_pass_rate": F.when((_c("folds") > 0) & (_c("folds_unknown") == 0), _c("folds_passed") / _c("folds")),
        }
    )
    fails = lambda c: F.coalesce(c, F.lit(True))
    stress = [F.when(_c(n).isNull(), "cost_stress_unavailable").when(_c(n) <= 0, f"{n}_nonpositive") for n in ("cost_stress_1_5x", "cost_stress_2x")]
    names = F.array_compact(
        F.array(
            F.when(fails(net <= 0), "base_net_nonpositive"),
            *stress,
            F.when(_c("turnover_per_bar").isNull(), "turnover_unavailable").when(_c("turnover_per_bar") > limits.turnover, "turnover_above_ceiling"),
            F.when(_c("market_count") == 0, "market_breakdown_unavailable").when(fails(_c("top_share") > limits.market_share), "single_market_profit_contribution_above_cap"),
            F.when(_c("fold_pass_rate").isNull(), "fold_pass_rate_unavailable").when(_c("fold_pass_rate") < limits.fold_pass_rate, "fold_pass_rate_below_minimum"),
            F.when(_c("markers") > 0, "validation_failure_markers_present"),
            F.when(_c("unreadable"), "report_unreadable"),
            F.when(_c("ambiguous"), "ambiguous_evidence"),
        )
    )
    there = lambda c: F.when(c, "available").otherwise("unavailable")
    return g.select(
        "experiment",
        F.when(F.size(names) == 0, "PASS").otherwise("FAIL").alias("status"),
        F.size(names).alias("failure_count"),
        F.concat_ws("|", names).alias("failures"),
        net.alias("base_cost_net"),
        *["cost_stress_1_5x", "cost_stress_2x", "turnover_per_bar", "market_count", "top_share", "fold_count", "fold_pass_rate", "markers"],
        there(_c("side")).alias("side"),
        there(_c("hour") & ~_c("no_hour")).alias("hour"),
        F.lit("unavailable").alias("session"),
        there(_c("regime") & ~_c("no_regime")).alias("regime"),
    )


_MONEY = ("gross_return_dollars", "net_return_dollars", "cost_dollars", "cost_drag_to_abs_gross", "slippage_cost_dollars", "commission_cost_dollars", "turnover_per_bar")


def ledger(reports: DataFrame, command: str | None = None, profile: str | None = None, timestamp: str | None = None) -> DataFrame:
    """One flat record an experiment, each value from the first kind of report that has it. Nested values stay as JSON text.

    ``passed`` is whether no report states a reason; ``reasons(…, promotion=True)`` lists them.
    """
    parsed = parse(reports)
    v = _c("v")
    o = _get(v, "$.metrics.overall")
    promotion = F.when(_false(v, "$.promotion_gate.model_promotion_allowed"), F.size(_list(v, "$.promotion_gate.promotion_blockers"))).otherwise(0)
    failures = F.size(_list(v, "$.failures"))
    stated = failures + ((_failure_count(v) > 0) & (failures == 0)).cast("int") + promotion
    from_ = {
        "metrics": {"git_commit": "git_commit", "profile": "profile", "costs_config": "costs_config", "models_config": "models_config", "execution_realism": "execution_realism", "policy_config": "policy_config"},
        "wfa": {"git_commit": "git_commit", "profile": "profile", "markets": "markets", "folds": "fold_count"},
        "split": {"git_commit": "git_commit", "profile": "profile", "markets": "markets", "folds": "fold_count", "years": "years"},
    }
    rows = parsed.select(
        "experiment",
        *[F.when(_c("kind") == kind, _get(v, f"$.{path}", "string")).alias(f"{kind}_{name}") for kind, names in from_.items() for name, path in names.items()],
        *[F.when(_c("kind") == "metrics", _number(o, n)).alias(n) for n in _MONEY],
        F.when(_c("kind") == "metrics", _get(o, "$.trade_count", "long")).alias("trades"),
        F.when((_c("kind") == "metrics") & (F.size(summaries(v, "market")) > 0), F.to_json(summaries(v, "market"))).otherwise(F.when(_c("kind") == "metrics", _get(v, "$.markets", "string"))).alias("market_breakdown"),
        F.when(_c("kind") == "breakdown", F.size(_list(v, "$.side_damage"))).otherwise(0).alias("sides"),
        F.coalesce(stated, F.lit(0)).alias("stated"),
    )
    plain = [c for c in rows.columns if c not in ("experiment", "sides", "stated")]
    g = rows.groupBy("experiment").agg(*[F.max(c).alias(c) for c in plain], F.sum("sides").alias("side_rows"), F.sum("stated").cast("long").alias("reasons"))
    first = lambda name, kinds: F.coalesce(*[_c(f"{k}_{name}") for k in kinds])
    every = ("metrics", "wfa", "split")
    return g.select(
        "experiment",
        F.lit(timestamp).cast("string").alias("timestamp"),
        F.lit(command).cast("string").alias("command"),
        first("git_commit", every).alias("git_hash"),
        F.coalesce(F.lit(profile).cast("string"), first("profile", every)).alias("profile"),
        F.concat_ws(",", "metrics_costs_config", "metrics_models_config").alias("configs"),
        first("markets", ("split", "wfa")).alias("markets"),
        _c("split_years").alias("years"),
        *[_c(f"metrics_{n}").alias(n) for n in ("costs_config", "execution_realism", "policy_config")],
        *_MONEY,
        "trades",
        first("folds", ("wfa", "split")).cast("int").alias("folds"),
        "market_breakdown",
        "side_rows",
        "reasons",
        (_c("reasons") == 0).alias("passed"),
    )


def audited(reports: DataFrame, **about: str | None) -> DataFrame:
    """Ledger records whose verdict is the gate's."""
    verdict = gate(reports).select(_c("experiment").alias("_e"), (_c("status") == "PASS").alias("passed"), _c("status").alias("robustness_status"), _c("failures").alias("pass_fail_reason"))
    records = ledger(reports, **about).drop("passed")
    return records.join(verdict, records["experiment"].eqNullSafe(verdict["_e"])).drop("_e")


def manifests(files: DataFrame) -> DataFrame:
    """Each prediction manifest (``path``, ``text``) with what it states and what makes it no evidence."""
    df = parse(files)
    v = _c("v")
    n = F.coalesce(_get(v, "$.prediction_count", "long"), F.lit(0))
    hashes = F.map_values(F.coalesce(_get(v, "$.output_file_hashes", "map<string,string>"), F.create_map().cast("map<string,string>")))
    problems = F.array_compact(
        F.array(
            F.when(_c("v").isNull(), "invalid json"),
            F.when(_failure_count(v) > 0, "failure_count is nonzero"),
            F.when(n <= 0, "prediction_count is zero"),
            F.when(F.array_contains(hashes, "NOT_WRITTEN"), "output hash is NOT_WRITTEN"),
            F.when(_true(v, "$.stale_output_path_exists"), "stale prediction output exists"),
            F.when(_false(v, "$.artifact_evidence_ready"), "artifact_evidence_ready is false"),
        )
    )
    return df.select("path", (F.size(problems) == 0).alias("artifact_evidence_ready"), _failure_count(v).alias("failure_count"), n.alias("prediction_count"), _true(v, "$.stale_output_path_exists").alias("stale_output_path_exists"), F.concat_ws("; ", problems).alias("failures"))


def promotion(reports: DataFrame, needed: Sequence[str] = ("metrics", "model_selection")) -> DataFrame:
    """Whether an experiment may be promoted: every needed report there, readable, without failures, and ready by its own word."""
    df = parse(reports.where(_c("kind").isin(*needed)))
    v, there = _c("v"), _c("v").isNotNull()
    tests = {
        "invalid": _c("unreadable"),
        "failed": there & (_failure_count(v) > 0),
        "not_ready": there & ~_true(v, "$.research_alpha_ready"),
        "not_allowed": there & ~_true(v, "$.model_promotion_allowed"),
    }
    experiments = reports.select("experiment").distinct()
    by = df.groupBy(_c("experiment").alias("_e")).agg(
        *[F.coalesce(F.max(F.when(_c("kind") == k, _c("text").isNotNull())), F.lit(False)).alias(f"{k}_there") for k in needed],
        *[F.coalesce(F.max(F.when(_c("kind") == k, c)), F.lit(False)).alias(f"{k}_{n}") for k in needed for n, c in tests.items()],
        F.sum(F.size(_list(v, "$.promotion_gate.promotion_blockers"))).alias("blockers"),
    )
    out = experiments.join(by, experiments["experiment"].eqNullSafe(by["_e"]), "left")
    wrong = [F.when(~F.coalesce(_c(f"{k}_there"), F.lit(False)), f"{k}_missing") for k in needed]
    wrong += [F.when(_c(f"{k}_{n}"), f"{k}_{n}") for k in needed for n in tests]
    failures = F.concat_ws("|", *wrong)
    return out.select("experiment", F.when(failures == "", "PASS").otherwise("FAIL").alias("status"), failures.alias("failures"), F.coalesce("blockers", F.lit(0)).cast("long").alias("blockers"))
