"""Sources, sinks, projections, filters, sorts, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.plans.registry import BARS, CLOCK, COSTS, PREDS, clock_bars, costs, out, preds, q, query, tick_bars
from tidemark.sources import tables
from tidemark.sources.bars import events
from tidemark.sources.staging import shared_path

_TABLES = ["benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier"]
_EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
_PROFILES = {"tier_1": {"markets": ["ES", "CL", "ZN", "6E"], "years": [2023, 2024]}, "smoke": {"markets": ["ES"], "years": [2024]}}
_ALIASES = {"default": "core", "core": "tier_1"}


# sources


@query("src_parquet_full", f"select event_type, count(*) as n, {q('sum(value)')} as total from events group by 1")
def src_full(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), S.quantize(F.sum("value")).alias("total"))


@query("src_parquet_pruned", f"select event_id, {q('value')} as value, cast(null as varchar) as absent from events")
def src_pruned(spark, sf_dir):
    df = tables.read_columns(spark, f"{sf_dir}/events.parquet", {"event_id": "bigint", "value": "double", "absent": "string"})
    return df.select(*out("event_id", value=F.col("value")), "absent")


@query("src_parquet_rows_subset", "select event_id, event_type from events where user_id in (select c_custkey from customer where c_nationkey = 3)")
def src_rows(spark, sf_dir):
    wanted = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_nationkey = 3").select(F.col("c_custkey").alias("user_id"))
    return tables.read_columns(spark, f"{sf_dir}/events.parquet", {"event_id": "bigint", "event_type": "string", "user_id": "bigint"}).join(wanted, "user_id", "left_semi").select("event_id", "event_type")


@query("src_schema_peek", "select cast(i as int) as position, name from (values " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(_EVENT_COLUMNS)) + ") t(i, name)")
def src_schema(spark, sf_dir):
    return tables.schema_frame(spark, f"{sf_dir}/events.parquet")


@query("src_footer_rowcount", "select count(*) as n from lineitem")
def src_count(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg(F.count("*").alias("n"))


@query("src_discover", "select unnest([" + ", ".join(f"'{n}'" for n in _TABLES) + "]) as stem")
def src_discover(spark, sf_dir):
    return tables.list_files(spark, sf_dir).select("stem").distinct()


@query("src_profile_inputs", "select m as market, cast(y as int) as year from (values ('ES'), ('CL'), ('ZN'), ('6E')) a(m), (values (2023), (2024)) b(y)")
def src_profile(spark, sf_dir):
    return tables.profile_inputs(spark, _PROFILES, _ALIASES, "default")


@query("src_alias_resolve", "with recursive a(k, v) as (values ('default', 'core'), ('core', 'tier_1')), r(name, goal) as (select k, v from a union all select r.name, a.v from r join a on a.k = r.goal) select name, goal as profile from r where goal not in (select k from a)")
def src_alias(spark, sf_dir):
    return spark.createDataFrame([(n, tables.resolve_alias(n, _ALIASES)) for n in _ALIASES], "name string, profile string")


@query("src_filter_shard", f"with {CLOCK}, d as (select distinct market, cast(ts as date) as day from clock_bars where market in ('ES', 'CL')), n as (select *, row_number() over (order by market, day) - 1 as i from d) select market, day from n where i % 4 = 1")
def src_shard(spark, sf_dir):
    days = clock_bars(spark, sf_dir).where(F.col("market").isin("ES", "CL")).select("market", F.to_date("ts").alias("day")).distinct()
    return tables.shard(days, ["market", "day"], 2, 4)


@query("src_yaml", f"with {COSTS} select market, {q('tick_size')} as tick_size, {q('tick_value')} as tick_value from costs")
def src_yaml(spark, sf_dir):
    return costs(spark).select(*out("market", tick_size=F.col("tick_size"), tick_value=F.col("tick_value")))


@query("src_json", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def src_json(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(
    "src_vendor_conditions",
    f"""with {CLOCK}, cond(date, status) as (values (date '2024-01-03', 'degraded'), (date '2024-01-09', ' OK '), (date '2024-01-11', 'missing'))
    select market, ts, coalesce(status, 'available') as status, coalesce(lower(trim(status)), 'available') not in ('available', 'ok', 'normal', '') as degraded
    from clock_bars left join cond on cond.date = cast(clock_bars.ts as date)""",
)
def src_conditions(spark, sf_dir):
    cond = spark.sql("select * from values (date'2024-01-03', 'degraded'), (date'2024-01-09', ' OK '), (date'2024-01-11', 'missing') t(date, status)")
    return tables.with_quality(clock_bars(spark, sf_dir), cond).select("market", "ts", F.col("data_quality_status").alias("status"), F.col("data_quality_degraded").alias("degraded"))


@query("cb_enrich_quality", f"with {CLOCK} select market, count(*) as n, count(*) filter (where cast(ts as date) in (date '2024-01-03', date '2024-01-11')) as n_degraded from clock_bars group by 1")
def cb_quality(spark, sf_dir):
    return src_conditions(spark, sf_dir).groupBy("market").agg(F.count("*").alias("n"), F.count_if("degraded").alias("n_degraded"))


_PATHS = ["/a/ES/2023/ES_01.dbn.zst", "/a/CL_2024_x.dbn", "/a/notes.txt", "/a/6E/2022/f.dbn", "/a/ES/23/f.dbn"]


@query("src_dbn_archive_listing", "select * from (values ('/a/ES/2023/ES_01.dbn.zst', 'ES', 2023), ('/a/CL_2024_x.dbn', 'CL', 2024), ('/a/notes.txt', null, null), ('/a/6E/2022/f.dbn', '6E', 2022), ('/a/ES/23/f.dbn', null, null)) t(path, product, year)")
def src_archive(spark, sf_dir):
    return tables.archive_names(spark.createDataFrame([(p,) for p in _PATHS], "path string"))


@query("src_chunk_ranges", "select cast(greatest(date '2023-11-15', m) as date) as chunk_start, cast(least(date '2024-03-10', m + interval 1 month) as date) as chunk_end from (select unnest(generate_series(timestamp '2023-11-01', timestamp '2024-03-01', interval 1 month)) as m)")
def src_chunks(spark, sf_dir):
    span = spark.sql("select date'2023-11-15' as a, date'2024-03-10' as b")
    return tables.chunk_ranges(span, "a", "b", "month").select("chunk_start", "chunk_end")


@query(
    "src_task_plan",
    """with p(product, available_start) as (values ('ES', date '2010-01-01'), ('RTY', date '2017-07-10'), ('SR3', date '2018-05-07')),
    c as (select unnest(generate_series(2016, 2018)) as y), t as (select product, greatest(available_start, make_date(y, 1, 1)) as chunk_start, make_date(y + 1, 1, 1) as chunk_end from p, c)
    select product, cast(chunk_start as date) as chunk_start, cast(chunk_end as date) as chunk_end from t where chunk_start < chunk_end""",
)
def src_tasks(spark, sf_dir):
    products = spark.sql("select * from values ('ES', date'2010-01-01'), ('RTY', date'2017-07-10'), ('SR3', date'2018-05-07') t(product, available_start)")
    span = spark.sql("select date'2016-01-01' as a, date'2019-01-01' as b")
    chunks = tables.chunk_ranges(span, "a", "b", "year").select("chunk_start", "chunk_end")
    return tables.task_plan(products, chunks).select("product", "chunk_start", "chunk_end")


# sinks: what is read back


_BACK = f"with {BARS} select market, count(*) as n, sum(volume)::bigint as volume from bars group by 1"


def _back(df):
    return df.groupBy("market").agg(F.count("*").alias("n"), F.sum("volume").cast("long").alias("volume"))


@query("snk_parquet", _BACK)
def snk_parquet(spark, sf_dir):
    path = shared_path(spark, "snk-parquet")
    tables.write_parquet(tick_bars(spark, sf_dir), path)
    return _back(spark.read.parquet(path))


@query("snk_parquet_atomic", _BACK)
def snk_atomic(spark, sf_dir):
    """A table published twice, the second time in place of the first."""
    path = shared_path(spark, "snk-atomic")
    for bars in (tick_bars(spark, sf_dir).where("bar < 2"), tick_bars(spark, sf_dir)):
        tables.publish(bars, path, S.bad_ohlc())
    return _back(spark.read.parquet(path))


@query("snk_csv", _BACK)
def snk_csv(spark, sf_dir):
    path = shared_path(spark, "snk-csv")
    tables.write_csv(tick_bars(spark, sf_dir).select("market", "bar", "volume"), path)
    return _back(spark.read.option("header", True).schema("market string, bar int, volume long").csv(path))


@query("snk_json", _BACK)
def snk_json(spark, sf_dir):
    path = shared_path(spark, "snk-json")
    tick_bars(spark, sf_dir).select("market", "volume").write.json(path)
    return _back(spark.read.schema("market string, volume long").json(path))


@query("snk_jsonl_append", f"with {BARS} select market, 2 * count(*) as n, cast(2 * sum(volume) as bigint) as volume from bars group by 1")
def snk_jsonl(spark, sf_dir):
    path = shared_path(spark, "snk-ledger")
    for _ in range(2):
        tables.append_jsonl(tick_bars(spark, sf_dir).select("market", "volume"), path)
    return _back(spark.read.schema("market string, volume long").json(path))


@query("snk_markdown", f"with {COSTS} select '| ' || market || ' | ' || cast(cast(cost_ticks * 10 as int) as varchar) || ' |' as line from costs union all select '| market | cost |' union all select '|---|---|'")
def snk_markdown(spark, sf_dir):
    text = tables.markdown(costs(spark).select("market", (F.col("cost_ticks") * 10).cast("int").alias("cost")))
    return spark.createDataFrame([(x,) for x in text.split("\n")], "line string")


@query("snk_sha256")
def snk_sha256(spark, sf_dir):
    """Every file of the folder, and one that is not there."""
    hashes = tables.file_hashes(spark, sf_dir, "*.parquet")
    names = hashes.select(F.concat(tables.file_stem(), F.lit(".parquet")).alias("name")).unionByName(spark.createDataFrame([("absent.parquet",)], "name string"))
    return tables.hash_map(names, hashes)


@query(
    "snk_manifest",
    "select * from (values ('ES', 2023, ''), ('', 2031, 'product_missing|year_out_of_range|bad_checksum|empty_file'), ('CL', 2024, 'rows_missing')) t(product, year, problems)",
)
def snk_manifest(spark, sf_dir):
    rows = [("ES", 2023, "a" * 64, 10, 5), ("", 2031, "xyz", 0, 1), ("CL", 2024, "0" * 64, 1, None)]
    return tables.manifest_problems(spark.createDataFrame(rows, tables.MANIFEST), (2010, 2026)).select("product", "year", "problems")


@query("snk_migration_plan", "select * from (values ('a', 'ES/2023/x', 'duplicate'), ('b', 'ES/2023/x', 'duplicate'), ('c', 'CL/2023/x', 'conflict'), ('d', 'CL/2023/x', 'conflict'), ('e', 'ZN/2024/y', 'move')) t(path, target, action)")
def snk_migration(spark, sf_dir):
    rows = [("a", "ES", 2023, "x", "1"), ("b", "ES", 2023, "x", "1"), ("c", "CL", 2023, "x", "1"), ("d", "CL", 2023, "x", "2"), ("e", "ZN", 2024, "y", "3")]
    return tables.migration_plan(spark.createDataFrame(rows, "path string, product string, year int, name string, sha256 string")).select("path", "target", "action")


# projections


@query("prj_select_order", f"with {BARS} select market, bar, volume, seg from bars")
def prj_select(spark, sf_dir):
    return tick_bars(spark, sf_dir).select("market", "bar", "volume", "seg")


@query("prj_with_columns", f"with {BARS} select market, bar, {q('high - low')} as spread, {q('(high + low) / 2')} as mid from bars")
def prj_with(spark, sf_dir):
    df = tick_bars(spark, sf_dir).withColumns({"spread": F.col("high") - F.col("low"), "mid": (F.col("high") + F.col("low")) / 2})
    return df.select(*out("market", "bar", spread=F.col("spread"), mid=F.col("mid")))


@query("prj_rename", f"with {BARS}, {PREDS} select market as m, bar as b, y_sign as actual from preds")
def prj_rename(spark, sf_dir):
    return preds(spark, sf_dir).select("market", "bar", "y_sign").withColumnsRenamed({"market": "m", "bar": "b", "y_sign": "actual"})


@query("prj_coerce_numeric", f"select event_id, {q('try_cast(case when event_id % 3 = 0 then event_type else cast(value as varchar) end as double)')} as v from events")
def prj_coerce(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))
    return events(spark, sf_dir).select(*out("event_id", v=S.number(text)))


@query("prj_default_bool", "select event_id, coalesce(case when event_id % 5 > 0 then value > 50 end, false) as flag, true as absent from events")
def prj_default(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", S.default(F.when(F.col("event_id") % 5 > 0, F.col("value") > 50), False).alias("flag"), F.lit(True).alias("absent"))


@query("prj_where", f"with {BARS} select market, bar, {q('case when causal_valid then close end')} as v from bars")
def prj_where(spark, sf_dir):
    return tick_bars(spark, sf_dir).select(*out("market", "bar", v=F.when(F.col("causal_valid"), F.col("close"))))


@query("prj_case_overwrite", f"with {BARS} select market, bar, case when volume > 250 then 'high' when bar % 3 = 0 then 'third' when causal_valid then 'valid' else 'none' end as label from bars")
def prj_overwrite(spark, sf_dir):
    label = S.last_match("none", (F.col("causal_valid"), "valid"), (F.col("bar") % 3 == 0, "third"), (F.col("volume") > 250, "high"))
    return tick_bars(spark, sf_dir).select("market", "bar", label.alias("label"))


@query("prj_first_match", f"with {BARS} select market, bar, case when is_synthetic then 'synthetic' when not causal_valid then 'invalid' when roll_window_flag then 'roll' end as reason from bars")
def prj_first(spark, sf_dir):
    reason = S.first_match((F.col("is_synthetic"), "synthetic"), (~F.col("causal_valid"), "invalid"), (F.col("roll_window_flag"), "roll"))
    return tick_bars(spark, sf_dir).select("market", "bar", reason.alias("reason"))


@query("prj_reason_list", f"with {BARS} select market, bar, concat_ws('|', case when is_synthetic then 'synthetic' end, case when not causal_valid then 'invalid' end, case when roll_window_flag then 'roll' end, case when boundary_session_flag then 'boundary' end) as reasons from bars")
def prj_reasons(spark, sf_dir):
    r = S.reasons((F.col("is_synthetic"), "synthetic"), (~F.col("causal_valid"), "invalid"), (F.col("roll_window_flag"), "roll"), (F.col("boundary_session_flag"), "boundary"))
    return tick_bars(spark, sf_dir).select("market", "bar", r.alias("reasons"))


# filters


def _filter(name, sql, cond):
    @query(name, f"with {BARS} select market, bar from bars where {sql}")
    def run(spark, sf_dir):
        return tick_bars(spark, sf_dir).where(cond()).select("market", "bar")


_filter("flt_mask", "causal_valid and not is_synthetic", lambda: F.col("causal_valid") & ~F.col("is_synthetic"))
_filter("flt_isin", "market in ('ES', 'ZN')", lambda: F.col("market").isin("ES", "ZN"))
_filter("flt_between", "bar between 100 and 200", lambda: F.col("bar").between(100, 200))
_filter("flt_valid_price", "case when bar % 7 > 0 then close - 110 end > 0", lambda: S.valid_price(F.when(F.col("bar") % 7 == 1, float("nan")).when(F.col("bar") % 7 > 0, F.col("close") - 110)) | ((F.col("bar") % 7 == 1) & (F.col("close") > 110)))
_filter("flt_valid_ohlcv", "high >= low and low <= open and open <= high and low <= close and close <= high and volume >= 0 and bar % 9 > 0", lambda: S.valid_ohlcv(o=F.when(F.col("bar") % 9 > 0, F.col("open"))))
_filter("flt_bad_ohlc", "bar % 9 = 0 or high < close + 3", lambda: S.bad_ohlc(o=F.when(F.col("bar") % 9 > 0, F.col("open")), cl=F.col("close") + 3))
_filter("flt_finite", "bar % 4 not in (1, 2)", lambda: S.finite(F.when(F.col("bar") % 4 == 1, float("inf")).when(F.col("bar") % 4 == 2, float("nan")).otherwise(F.col("close"))).isNotNull())
_filter("flt_csv_arg", "market in ('CL', 'RTY')", lambda: F.col("market").isin([x.strip() for x in "CL, RTY".split(",")]))


@query("flt_blank", "select o_orderkey from (select o_orderkey, case o_orderkey % 3 when 0 then '  ' when 1 then null else o_orderstatus end as s from orders) where trim(coalesce(s, '')) = ''")
def flt_blank(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    s = F.when(k == 0, "  ").when(k == 2, F.col("o_orderstatus"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").where(S.blank(s)).select("o_orderkey")


# sorts and limits: positions are columns, for results have no order


@query("srt_stable_ts", f"with {BARS} select market, bar, cast(row_number() over (partition by market order by volume, bar) as int) as pos from bars")
def srt_stable(spark, sf_dir):
    return tick_bars(spark, sf_dir).select("market", "bar", F.row_number().over(Window.partitionBy("market").orderBy("volume", "bar")).alias("pos"))


@query("srt_multi", f"with {BARS} select market, bar, cast(row_number() over (partition by market order by case when causal_valid then volume end desc nulls last, bar) as int) as pos from bars")
def srt_multi(spark, sf_dir):
    w = Window.partitionBy("market").orderBy(F.when(F.col("causal_valid"), F.col("volume")).desc_nulls_last(), F.col("bar").asc())
    return tick_bars(spark, sf_dir).select("market", "bar", F.row_number().over(w).alias("pos"))


@query("topk_head", f"with {BARS} select market, bar, volume from bars order by volume desc, market, bar limit 20")
def topk_head(spark, sf_dir):
    return tick_bars(spark, sf_dir).select("market", "bar", "volume").orderBy(F.desc("volume"), "market", "bar").limit(20)


@query("topk_nlargest", f"with {BARS}, {PREDS}, r as (select *, row_number() over (partition by market order by abs(expected_return) desc, bar) as n, count(*) over (partition by market) as c from preds) select market, bar from r where n <= ceil(0.1 * c)")
def topk_nlargest(spark, sf_dir):
    from tidemark.operators.policy import top_fraction

    return top_fraction(preds(spark, sf_dir), F.abs("expected_return"), 0.1, ["market"], ["bar"]).select("market", "bar")


@query("topk_outliers", f"with {BARS}, {PREDS} select market, bar, {q('expected_return - y_sign * 0.001')} as residual from preds order by abs(expected_return) desc, market, bar limit 25")
def topk_outliers(spark, sf_dir):
    df = preds(spark, sf_dir).withColumn("residual", F.col("expected_return") - F.col("y_sign") * 0.001)
    return df.orderBy(F.abs("expected_return").desc(), "market", "bar").limit(25).select(*out("market", "bar", residual=F.col("residual")))


@query("topk_largest_gaps", f"with {CLOCK}, g as (select market, ts, cast((epoch(lead(ts) over (partition by market order by ts)) - epoch(ts)) // 60 as bigint) as gap from clock_bars) select market, ts, gap from g where gap > 60 order by gap desc, market, ts limit 10")
def topk_gaps(spark, sf_dir):
    by = Window.partitionBy("market").orderBy("ts")
    df = clock_bars(spark, sf_dir).select("market", "ts", S.minutes_between(F.lead("ts").over(by), "ts").alias("gap"))
    return df.where("gap > 60").orderBy(F.desc("gap"), "market", "ts").limit(10)


@query("lim_sample_head", f"with {BARS} select market, bar from bars where causal_valid order by bar, market limit 200000")
def lim_head(spark, sf_dir):
    return tick_bars(spark, sf_dir).where("causal_valid").select("market", "bar").orderBy("bar", "market").limit(200_000)


@query("lim_max_folds", f"with {BARS}, {PREDS} select market, fold_id from (select distinct market, fold_id from preds) where fold_id < 3")
def lim_folds(spark, sf_dir):
    folds = preds(spark, sf_dir).select("market", "fold_id").distinct()
    return folds.withColumn("n", F.row_number().over(Window.partitionBy("market").orderBy("fold_id"))).where("n <= 3").drop("n")


# sets


@query("set_union_years", f"with {BARS} select market, bar, volume from bars where bar % 2 = 0 union all select market, bar, null from bars where bar % 2 = 1")
def set_years(spark, sf_dir):
    b = tick_bars(spark, sf_dir)
    return b.where("bar % 2 = 0").select("market", "bar", "volume").unionByName(b.where("bar % 2 = 1").select("bar", "market"), allowMissingColumns=True)


@query("set_union_synth", f"with {BARS} select market, bar, false as synthetic from bars union all select market, bar, true from bars where bar % 10 = 0")
def set_synth(spark, sf_dir):
    b = tick_bars(spark, sf_dir).select("market", "bar", F.lit(False).alias("synthetic"))
    return b.unionByName(b.where("bar % 10 = 0").withColumn("synthetic", F.lit(True)))


@query("set_union_folds", f"with {BARS}, {PREDS} select market, bar, fold_id from preds where fold_id in (1, 3)")
def set_folds(spark, sf_dir):
    p = preds(spark, sf_dir).select("market", "bar", "fold_id")
    return p.where("fold_id = 1").unionByName(p.where("fold_id = 3"))


@query("set_union_shards", f"with {BARS} select market, bar from bars")
def set_shards(spark, sf_dir):
    a, b = shared_path(spark, "shard-1"), shared_path(spark, "shard-2")
    bars = tick_bars(spark, sf_dir).select("market", "bar")
    bars.where("bar % 2 = 0").write.parquet(a)
    bars.where("bar % 2 = 1").write.parquet(b)
    return spark.read.parquet(a, b)


@query("set_union_chunks", f"with {BARS} select market, bar, cast(row_number() over (partition by market order by ts) as int) as pos from bars")
def set_chunks(spark, sf_dir):
    b = tick_bars(spark, sf_dir)
    both = b.where("seg % 2 = 1").unionByName(b.where("seg % 2 = 0"))
    return both.select("market", "bar", F.row_number().over(Window.partitionBy("market").orderBy("ts")).alias("pos"))


@query("set_distinct", f"with {BARS} select distinct market, seg, causal_valid from bars")
def set_distinct(spark, sf_dir):
    return tick_bars(spark, sf_dir).select("market", "seg", "causal_valid").distinct()


@query("set_dup_detect", f"with {BARS} select market, count(*) - count(distinct (seg, volume)) as duplicates from bars group by 1")
def set_dups(spark, sf_dir):
    return tick_bars(spark, sf_dir).groupBy("market").agg((F.count("*") - F.count_distinct(F.struct("seg", "volume"))).alias("duplicates"))


@query("set_except", f"with {BARS} select distinct market, bar % 50 as k from bars except select market, bar % 50 from bars where volume > 200")
def set_except(spark, sf_dir):
    k = tick_bars(spark, sf_dir).withColumn("k", F.col("bar") % 50)
    return k.select("market", "k").subtract(k.where("volume > 200").select("market", "k"))


@query("set_intersect", f"with {BARS} select market, bar % 50 as k from bars intersect select market, bar % 50 from bars where volume > 250")
def set_intersect(spark, sf_dir):
    k = tick_bars(spark, sf_dir).withColumn("k", F.col("bar") % 50)
    return k.select("market", "k").intersect(k.where("volume > 250").select("market", "k"))


# scalar functions


def _fn(name, spark_expr, sql, numeric=True):
    @query(name, f"with {BARS}, {PREDS}, x as (select b.*, p_long, p_short, p_flat, p_fade, p_trend, expected_return, y_sign from bars b join preds using (market, bar)) select market, bar, {q(sql) if numeric else sql} as v from x")
    def run(spark, sf_dir):
        p = preds(spark, sf_dir).select("market", "bar", "p_long", "p_short", "p_flat", "p_fade", "p_trend", "expected_return", "y_sign")
        df = tick_bars(spark, sf_dir).join(p, ["market", "bar"])
        return df.select(*out("market", "bar", v=spark_expr())) if numeric else df.select("market", "bar", spark_expr().alias("v"))


_C = F.col
_fn("fn_safe_div", lambda: S.safe_div(_C("close"), _C("bar") % 5), "case when bar % 5 <> 0 then close / (bar % 5) end")
_fn("fn_sign", lambda: S.sign(_C("p_fade") - 0.5), "sign(p_fade - 0.5)")
_fn("fn_log1p", lambda: F.log1p(_C("expected_return")), "ln(1 + expected_return)")
_fn("fn_abs_clip", lambda: S.clip(F.abs(_C("p_fade") - 0.5), 0.1, 0.4), "case when p_fade is not null then least(greatest(abs(p_fade - 0.5), 0.1), 0.4) end")
_fn("fn_row_max_min", lambda: F.greatest("p_fade", "p_trend", "p_long") - F.least("p_fade", "p_trend", "p_long"), "greatest(p_fade, p_trend, p_long) - least(p_fade, p_trend, p_long)")
_fn("fn_row_std", lambda: S.row_std("p_fade", "p_trend", "p_long"), "list_stddev_samp(list_filter([p_fade, p_trend, p_long], lambda x: x is not null))")
_fn("fn_row_sum_min_count", lambda: S.row_sum("p_fade", "p_trend", "p_long"), "p_fade + p_trend + p_long")
_fn("fn_sin_cos", lambda: F.sin(2 * F.pi() * (_C("bar") % 1440) / 1440) + F.cos(2 * F.pi() * (_C("bar") % 1440) / 1440), "sin(2 * pi() * (bar % 1440) / 1440) + cos(2 * pi() * (bar % 1440) / 1440)")
_fn("fn_ceil_floor", lambda: F.ceil(_C("close") / 7) * 1000 + F.floor(_C("close") / 3), "ceil(close / 7) * 1000 + floor(close / 3)")
_fn("fn_round", lambda: F.bround(_C("bar") / 8, 2), "case when bar % 8 % 2 = 0 then bar / 8 else round_even(bar / 8, 2) end")
_fn("fn_tz_convert", lambda: S.local_time("ts"), "ts at time zone 'UTC' at time zone 'America/Chicago'", False)
_fn("fn_tz_localize", lambda: S.utc_time(F.date_trunc("day", _C("ts")).cast("timestamp_ntz")), "cast(date_trunc('day', ts) as timestamp) at time zone 'America/Chicago' at time zone 'UTC'", False)
_fn("fn_dow", lambda: F.weekday("ts"), "cast(isodow(ts) - 1 as int)", False)
_fn("fn_minute_of_day", lambda: S.minute_of_day("ts"), "cast(hour(ts) * 60 + minute(ts) as int)", False)
_fn("fn_date_add", lambda: S.session_date("ts", 960), "case when hour(ts) * 60 + minute(ts) < 960 then cast(ts as date) else cast(cast(ts as date) + 1 as date) end", False)
_fn("fn_strftime", lambda: F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "yyyy-MM")), "strftime(ts, '%Y-%m-%d|%Y-%m')", False)
_fn("fn_hour_utc", lambda: F.hour("ts"), "cast(hour(ts) as int)", False)
_fn("fn_parse_ts", lambda: F.try_to_timestamp(F.when(_C("bar") % 3 > 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("bad")).isNotNull(), "bar % 3 > 0", False)
_fn("fn_epoch_diff", lambda: S.minutes_between("ts", F.lit("2024-01-01").cast("timestamp_ntz")), "cast(floor((epoch(ts) - epoch(timestamp '2024-01-01')) / 60) as bigint)", False)
_fn("fn_str_split", lambda: F.element_at(F.split(F.date_format("ts", "HH:mm"), ":"), 1).cast("int") * 60 + F.element_at(F.split(F.date_format("ts", "HH:mm"), ":"), 2).cast("int"), "cast(split_part(strftime(ts, '%H:%M'), ':', 1) as int) * 60 + cast(split_part(strftime(ts, '%H:%M'), ':', 2) as int)", False)
_fn("fn_str_concat", lambda: F.concat_ws("_", F.lit("session"), "market", "session_segment_id"), "'session_' || market || '_' || session_segment_id", False)
_fn("fn_str_strip_upper", lambda: F.upper(F.trim(F.concat(F.lit("  "), F.lower("market"), F.lit(" ")))), "upper(trim('  ' || lower(market) || ' '))", False)
_fn("fn_zfill", lambda: S.pad_id("fold_", _C("bar") % 1000, 4), "'fold_' || lpad(cast(bar % 1000 as varchar), 4, '0')", False)
_fn("fn_regex_contains", lambda: F.col("session_segment_id").rlike("0[13]$"), "regexp_matches(session_segment_id, '0[13]$')", False)
_fn("fn_cut", lambda: S.cut("p_fade", [0.05, 0.1, 0.5]), "case when p_fade is null then 'missing' when p_fade <= 0.05 then '<=0.05' when p_fade <= 0.1 then '(0.05,0.1]' when p_fade <= 0.5 then '(0.1,0.5]' else '>0.5' end", False)
_fn("fn_cut10", lambda: S.cut10("p_fade"), "cast(case when p_fade is not null then greatest(1, least(10, ceil(p_fade * 10))) end as int)", False)
_fn("fn_argmax3", lambda: S.argmax3("p_short", "p_flat", "p_fade"), "cast(case when p_short >= p_flat and p_short >= coalesce(p_fade, '-infinity'::double) then -1 when p_flat >= coalesce(p_fade, '-infinity'::double) then 0 else 1 end as int)", False)
_fn("fn_sha256", lambda: F.sha2(F.concat_ws(",", "market", F.col("bar").cast("string")), 256), "sha256(market || ',' || cast(bar as varchar))", False)
_fn("fn_quality_degraded", lambda: S.degraded(F.when(_C("bar") % 4 == 0, " OK ").when(_C("bar") % 4 == 1, "bad").when(_C("bar") % 4 == 2, "")), "bar % 4 = 1", False)
_fn("fn_shock_denom", lambda: S.shock_denominator(F.abs(_C("close") - _C("open")), (_C("high") - _C("low")) * 50), "case when abs(close - open) >= greatest(1e-12, (high - low) * 50 * 0.01) then abs(close - open) else (high - low) * 50 end")
_fn("fn_safe_float_int", lambda: S.finite(F.when(_C("bar") % 3 == 0, float("nan")).when(_C("bar") % 3 == 1, float("inf")).otherwise(_C("close"))), "case when bar % 3 = 2 then close end")


@query("fn_json_get", "select event_id, cast(json_extract_string(props, '$.k') as int) > 50 as big, json_extract_string(props, '$.absent') is null as absent from events")
def fn_json(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", (F.get_json_object("props", "$.k").cast("int") > 50).alias("big"), F.get_json_object("props", "$.absent").isNull().alias("absent"))
