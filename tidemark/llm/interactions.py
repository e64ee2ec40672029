"""Which filter removes what, in every order: an audit through the Walsh-Hadamard transform.

Five filters look at a document; those that it fails make a mask of five bits. For each part and label the corpus
becomes 32 signed parity sums, one for each set s of filters: rows whose mask shares an even number of filters with s
count 1, the others -1. The transform is its own inverse but for a factor of 32, so the sums give back exactly how
many rows have each mask, and those 32 cells are all that the 120 orders need: what a prefix of filters keeps is the
sum of the cells that meet none of them. The Shapley value over all orders is closed: a row that fails k filters is
removed by each of them, as the first of its k, in 120/k orders.

Repeats (filter E) are decided by groups: rows with equal text, part, label and id are counted first, so a group of
copies of any size is a few rows when its least id is found.

Nulls: a null text counts as empty, a null source is the part '', a null doc_id is never smaller and never greater, so
such a row neither fails E nor makes others fail it; rows of equal id and text do not make each other fail. A document
is good (toxic) if any label row of its id says so. Repeated rows count as often as they stand. An empty table gives
no part. Columns beside doc_id, text and source are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table

LETTERS = "ABCDE"
N_MASKS, REPEAT = 32, 16
ORDERS = ["".join(p) for p in permutations(LETTERS)]
KINDS = ("all", "good", "toxic")


def own_failures(text: Column) -> Column:
    """The mask of filters A to D, which need the text alone; ``text`` has no nulls."""
    return (
        F.when(F.size("_words") < 200, 1).otherwise(0)
        + F.when(F.size(F.array_distinct("_words")) * 100 < F.size("_words") * 50, 2).otherwise(0)
        + F.when(F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") * 100 > F.length(text).cast("long") * 2, 4).otherwise(0)
        + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)
    )


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, mask, n): rows by the set of filters they fail."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    text = F.coalesce("text", F.lit(""))
    facts = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    facts = facts.withColumn("_words", F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != ""))
    facts = facts.select("doc_id", "part", own_failures(F.col("text")).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    marked = facts.join(known, "doc_id", "left").select("doc_id", "part", "mask", "digest", *[F.coalesce(x, F.lit(False)).alias(x) for x in KINDS[1:]])
    keys = ["digest", "part", "mask", "good", "toxic"]
    by_id = marked.groupBy("doc_id", *keys).agg(F.count("*").alias("n"))
    groups = by_id.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_free"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"),
    )
    # a digest has at most one row here for each part and label
    least = F.min("least.doc_id").over(Window.partitionBy("digest"))
    groups = groups.withColumn("n_first", F.col("n_free") + F.when(F.col("least.doc_id") == least, F.col("least.n")).otherwise(0))
    both = F.array(F.struct("mask", F.col("n_first").alias("n")), F.struct((F.col("mask") + REPEAT).alias("mask"), (F.col("n") - F.col("n_first")).alias("n")))
    return groups.select("part", "good", "toxic", F.inline(both)).where(F.col("n") > 0)


def _sign(a: Column, b: Column | int) -> Column:
    return 1 - 2 * (F.bit_count(a.bitwiseAND(b if isinstance(b, Column) else F.lit(b))) % 2)


def parity_sums(cells: DataFrame) -> DataFrame:
    """(part, good, toxic, sums): element s is, for set s of filters, the rows that share an even number with s less the others."""
    sums = cells.groupBy("part", "good", "toxic").agg(*[F.sum(F.col("n") * _sign(F.col("mask"), s)).alias(f"w{s}") for s in range(N_MASKS)])
    return sums.select("part", "good", "toxic", F.array(*[f"w{s}" for s in range(N_MASKS)]).alias("sums"))


def inverted(sums: DataFrame) -> DataFrame:
    """(part, all, good, toxic): arrays of 32 exact cells for each part; element m has the rows whose mask is m."""
    each = sums.select("part", "good", "toxic", F.posexplode("sums").alias("s", "w")).select("*", F.explode(F.sequence(F.lit(0), F.lit(N_MASKS - 1))).alias("m"))
    own = F.col("w") * _sign(F.col("m"), F.col("s"))
    held = {"all": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    cells = each.groupBy("part", "m").agg(*[F.shiftright(F.sum(F.when(on, own).otherwise(0)), 5).alias(kind) for kind, on in held.items()])  # by 32, without a remainder
    ordered = cells.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("m", *KINDS))).alias("cells"))
    return ordered.select("part", *[F.col(f"cells.{kind}").alias(kind) for kind in KINDS])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    cells = inverted(parity_sums(masks(docs, labels)))

    def survivors(kind: str) -> Column:
        """Element p: rows that meet none of the filters in p."""
        return F.expr(f"transform(sequence(0, 31), p -> aggregate(sequence(0, 31), 0L, (n, m) -> n + if((m & p) = 0, `{kind}`[m], 0L)))")

    shapley = F.expr("transform(sequence(0, 4), i -> aggregate(sequence(1, 31), 0L, (n, m) -> n + if((m & shiftleft(1, i)) = 0, 0L, `all`[m] * (120 div bit_count(m)))))")
    parts = cells.select("part", "all", *[survivors(k).alias(f"left_{k}") for k in KINDS], shapley.alias("shapley"))
    steps = parts.select("*", F.explode(F.lit(ORDERS)).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    bit = F.expr("ascii(substring(filter_order, step, 1)) - 65")
    before = F.expr("aggregate(sequence(1, step), 0, (m, i) -> m | if(i < step, shiftleft(1, ascii(substring(filter_order, i, 1)) - 65), 0))")
    steps = steps.withColumns({"_bit": bit, "_before": before}).withColumn("_own", F.expr("shiftleft(1, _bit)")).withColumn("_after", F.expr("_before | _own"))
    left = lambda kind, p: F.get(f"left_{kind}", p)
    removed = {k: left(k, F.col("_before")) - left(k, F.col("_after")) for k in KINDS}
    return steps.select(
        "part",
        "filter_order",
        "step",
        left("all", F.col("_after")).alias("kept"),
        removed["all"].alias("removed"),
        (left("all", F.lit(0)) - left("all", F.col("_own")) - removed["all"]).alias("redundant"),
        F.get("all", F.col("_own")).alias("unique_fails"),
        removed["good"].alias("good_lost"),
        removed["toxic"].alias("toxic_lost"),
        F.get("shapley", F.col("_bit")).alias("shapley"),
    )


def op12(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
w as (select doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from d),
l as (select doc_id, max(quality) = 1 as good, max(toxic) = 1 as toxic from labels group by 1),
f as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
             len(words) < 200 as fa, 100 * len(list_distinct(words)) < 50 * len(words) as fb,
             100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) as fc, regexp_matches(text, '[#$%&*|]') as fd,
             coalesce(w.doc_id > min(w.doc_id) over (partition by text), false) as fe
      from w left join l on w.doc_id = l.doc_id),
c as (select part, good, toxic, (case when fa then 'A' else '' end) || (case when fb then 'B' else '' end) || (case when fc then 'C' else '' end)
             || (case when fd then 'D' else '' end) || (case when fe then 'E' else '' end) as fails, count(*) as n from f group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order from x a, x b, x c, x d, x e where length(replace(replace(replace(replace(replace('ABCDE', a.x, ''), b.x, ''), c.x, ''), d.x, ''), e.x, '')) = 0),
s as (select filter_order, step, substr(filter_order, step, 1) as own, substr(filter_order, 1, step - 1) as before from o, (select unnest([1, 2, 3, 4, 5]) as step)),
t as (select part, filter_order, step, good, toxic, fails, n, contains(fails, own) as hit, len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0 and before != '' and fails != '' as gone from c, s)
select part, filter_order, cast(step as integer) as step,
       cast(coalesce(sum(n) filter (not hit and not gone), 0) as bigint) as kept, cast(coalesce(sum(n) filter (hit and not gone), 0) as bigint) as removed,
       cast(coalesce(sum(n) filter (hit and gone), 0) as bigint) as redundant, cast(coalesce(sum(n) filter (hit and length(fails) = 1), 0) as bigint) as unique_fails,
       cast(coalesce(sum(n) filter (hit and not gone and good), 0) as bigint) as good_lost, cast(coalesce(sum(n) filter (hit and not gone and toxic), 0) as bigint) as toxic_lost,
       cast(coalesce(sum(n * 120 // greatest(length(fails), 1)) filter (hit), 0) as bigint) as shapley
from t group by 1, 2, 3
"""
