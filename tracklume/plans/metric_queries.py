"""Metrics over labels and documents read as predictions (P), and lineitem as residual rows (L) or action groups (V)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklume.operators import calibration as C
from tracklume.operators import inversions as N
from tracklume.operators import ranking as R
from tracklume.sources.tables import table


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", "lang", "source", F.col("toxic").alias("label"), "quality", ((F.col("n_chars") % 1000) / 1000.0).alias("score"))


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", (F.col("l_discount") * 10).alias("y"), (F.col("l_tax") * 10).alias("q"))


_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_linenumber) is not unique: actions are numbered over all columns."""
    order = Window.partitionBy("l_orderkey").orderBy(*_ALL[1:])
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), F.row_number().over(order).alias("a"), F.col("l_tax").alias("pred"), F.col("l_discount").alias("target"), (F.col("l_quantity") / 1000).alias("cost"))


P = "p as (select l.doc_id, lang, source, toxic as label, quality, (n_chars % 1000) / 1000.0 as score from labels l join documents d on l.doc_id = d.doc_id)"
L = "l as (select l_returnflag, l_linestatus, l_quantity, l_discount * 10 as y, l_tax * 10 as q from lineitem)"
V = f"v as (select l_orderkey as g, row_number() over (partition by l_orderkey order by {', '.join(_ALL[1:])}) as a, l_tax as pred, l_discount as target, l_quantity / 1000 as cost from lineitem)"


def auroc(spark, sf_dir):
    return R.auroc(predictions(spark, sf_dir), "label", "score")


def average_precision(spark, sf_dir):
    return R.average_precision(predictions(spark, sf_dir), "label", "score")


def auprc_trapezoid(spark, sf_dir):
    return R.auprc_trapezoid(predictions(spark, sf_dir), "label", "score")


def brier_nll(spark, sf_dir):
    return C.brier_nll(predictions(spark, sf_dir), "label", "score")


def ece_bins(spark, sf_dir):
    return C.ece_bins(predictions(spark, sf_dir), "label", "score")


def ece(spark, sf_dir):
    return C.ece(predictions(spark, sf_dir), "label", "score")


def false_safe_rate(spark, sf_dir):
    return C.false_safe_rate(predictions(spark, sf_dir), "label", "score", 0.5)


def coverage_tightness(spark, sf_dir):
    rows = residuals(spark, sf_dir)
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), *C.coverage(rows, "y", "q"))


def clearance_summary(spark, sf_dir):
    """Mean, least and largest over rows that have a critical object; the others are counted."""
    kept = F.when(F.col("l_quantity") >= 10, F.col("y") - F.col("q"))
    rows = residuals(spark, sf_dir).groupBy("l_linestatus")
    return rows.agg(F.round(F.avg(kept), 9).alias("mean"), F.round(F.min(kept), 9).alias("least"), F.round(F.max(kept), 9).alias("most"), F.sum(F.when(kept.isNull(), 1).otherwise(0)).alias("excluded"))


def pairwise_ordering(spark, sf_dir):
    return R.pairwise_ordering(actions(spark, sf_dir), "g", "a", "target", "pred", F.col("cost") > 0.005)


def pair_accuracy(spark, sf_dir):
    return R.pairwise_ordering(actions(spark, sf_dir), "g", "a", "target", "pred", F.lit(True)).select(F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"), "pairs")


def spearman(spark, sf_dir):
    return R.spearman(table(spark, sf_dir, "supplier"), "s_acctbal", "s_nationkey")


def kendall_tau_b(spark, sf_dir):
    """tau-b of tax and quantity over the line items of each return flag, ties and all."""
    return N.kendall(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_tax", "l_quantity")


def kendall_of_prices(spark, sf_dir):
    """tau-b of key and price of the orders of each status: all but no ties."""
    return N.kendall(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderkey", "o_totalprice")


def topk_regret(spark, sf_dir):
    best = R.best_by_group(actions(spark, sf_dir), "g", "a", "pred", "target")
    return best.agg(F.count("*").alias("groups"), F.round(F.avg("regret"), 9).alias("mean_regret"), F.round(F.avg(F.col("top2").cast("double")), 9).alias("top2_rate"))


def action_selection_counts(spark, sf_dir):
    """How often each canonical action is selected, never ones included."""
    rows = actions(spark, sf_dir)
    chosen = R.best_by_group(rows, "g", "a", "pred", "target").groupBy(F.col("selected").alias("a")).agg(F.count("*").alias("n"))
    return rows.select("a").distinct().join(chosen, "a", "left").select("a", F.coalesce("n", F.lit(0)).alias("n"))


def useful_f1_huber(spark, sf_dir, delta: float = 0.03):
    rows = actions(spark, sf_dir).select((F.col("pred") >= 0.04).alias("said"), (F.col("target") > 0.05).alias("useful"), (F.col("pred") - F.col("target")).alias("e"))
    huber = F.when(F.abs("e") <= delta, F.col("e") ** 2 / 2).otherwise(delta * (F.abs("e") - delta / 2))
    sums = rows.agg(*(F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in (("tp", F.col("said") & F.col("useful")), ("fp", F.col("said") & ~F.col("useful")), ("fn", ~F.col("said") & F.col("useful")))), F.round(F.avg(huber), 9).alias("huber"), F.round(F.avg(F.col("e") ** 2), 9).alias("mse"))
    return sums.select("tp", "fp", "fn", F.round(F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0), 9).alias("f1"), "huber", "mse")


def loss_aggregates(spark, sf_dir, tau: float = 0.9):
    """Pinball, binary cross-entropy, Huber and pairwise hinge losses as plain aggregates, by return flag.

    The hinge is over all pairs of a positive (y > 0.5) and a negative, which
    come from counts of the ten values that q can have, not from rows.
    """
    e = F.col("y") - F.col("q")
    pinball = F.greatest(tau * e, (tau - 1) * e)
    positive = F.when(F.col("y") > 0.5, 1.0).otherwise(0.0)
    p = F.greatest(F.least("q", F.lit(1 - 1e-7)), F.lit(1e-7))
    huber = F.when(F.abs(e) <= 0.3, e * e / 2).otherwise(0.3 * (F.abs(e) - 0.15))
    rows = residuals(spark, sf_dir)
    plain = rows.groupBy("l_returnflag").agg(F.round(F.avg(pinball), 9).alias("pinball"), F.round(F.avg(F.abs(e)), 9).alias("mae"), F.round(F.avg(-(positive * F.log(p) + (1 - positive) * F.log(1 - p))), 9).alias("bce"), F.round(F.avg(huber), 9).alias("huber"))
    cells = rows.groupBy("l_returnflag", positive.alias("positive"), F.round("q", 6).alias("q")).agg(F.count("*").alias("n"))
    other = cells.where("positive = 0").select("l_returnflag", F.col("q").alias("r"), F.col("n").alias("m"))
    pairs = cells.where("positive = 1").join(other, "l_returnflag")
    hinge = pairs.groupBy("l_returnflag").agg(F.round(F.sum(F.col("n") * F.col("m") * F.greatest(F.lit(0.0), 0.1 - (F.col("q") - F.col("r")))) / F.sum(F.col("n") * F.col("m")), 9).alias("hinge"))
    return plain.join(hinge, "l_returnflag", "left")


def _binned(spark, sf_dir):
    return residuals(spark, sf_dir).withColumn("quantity_bin", C.bin_label(F.col("l_quantity"), [1.0, 10.0, 25.0, 50.0]))


DIMENSIONS = ["l_returnflag", "l_linestatus", "quantity_bin"]


def conformal_global(spark, sf_dir):
    return C.conformal(residuals(spark, sf_dir), "y", "q", [], 0.1).select(F.round("correction", 9).alias("correction"), "n", "k")


def conformal_grouped(spark, sf_dir):
    return C.conformal(_binned(spark, sf_dir), "y", "q", DIMENSIONS, 0.1).withColumn("correction", F.round("correction", 9))


def conformal_apply(spark, sf_dir):
    rows = _binned(spark, sf_dir)
    done = C.apply_conformal(rows, C.conformal(rows, "y", "q", DIMENSIONS, 0.1), "q", "quantity_bin")
    return done.groupBy("quantity_bin").agg(F.count("*").alias("n"), F.round(F.avg("calibrated"), 9).alias("mean_upper"), F.round(F.avg(F.when(F.col("y") <= F.col("calibrated"), 1.0).otherwise(0.0)), 9).alias("coverage"))


def group_bins(spark, sf_dir):
    return _binned(spark, sf_dir).groupBy("quantity_bin").agg(F.count("*").alias("n"))


def subset_report(spark, sf_dir):
    """Named subsets, which may overlap; each is there even when empty."""
    named = {"all": F.lit(True), "english": F.lower(F.trim("lang")) == "en", "low_quality": F.col("quality") == 0, "unknown_source": F.col("source") == "none"}
    one = F.array(*(F.struct(F.lit(n).alias("subset"), F.coalesce(c, F.lit(False)).cast("int").alias("inside")) for n, c in named.items()))
    rows = predictions(spark, sf_dir).select("label", F.explode(one).alias("s")).select("label", "s.*")
    return rows.groupBy("subset").agg(F.sum("inside").alias("n"), F.sum(F.col("inside") * F.col("label")).alias("positives"))


def method_compare(spark, sf_dir):
    """Two methods' tables on one id: inner join, which must be complete, and the means of their difference."""
    rows = predictions(spark, sf_dir)
    a, b = rows.select("doc_id", "label", F.col("score").alias("one")), rows.select("doc_id", F.col("label").alias("other_label"), (1 - F.col("score")).alias("two"))
    both = a.join(b, "doc_id", "full")
    return both.agg(F.count("*").alias("n"), F.sum(F.when(F.col("one").isNull() | F.col("two").isNull() | (F.col("label") != F.col("other_label")), 1).otherwise(0)).alias("unmatched"), F.round(F.avg((F.col("one") - F.col("label")) ** 2 - (F.col("two") - F.col("label")) ** 2), 9).alias("brier_gain"))


QUERIES = {f.__name__: f for f in (auroc, average_precision, auprc_trapezoid, brier_nll, ece_bins, ece, false_safe_rate, coverage_tightness, clearance_summary, pairwise_ordering, pair_accuracy, spearman, kendall_tau_b, kendall_of_prices, topk_regret, action_selection_counts, useful_f1_huber, loss_aggregates, conformal_global, conformal_grouped, conformal_apply, group_bins, subset_report, method_compare)}

_CURVE = P + """, s as (select score as s, sum(label) as pos, count(*) as n from p group by score),
 c as (select *, sum(pos) over (order by s desc) as tp, sum(n) over (order by s desc) as seen from s), d as (select *, tp / seen as pr from c)"""
_BIN = "case when l_quantity is null then 'missing' when l_quantity >= 1 and l_quantity < 10 then '[1,10)' when l_quantity >= 10 and l_quantity < 25 then '[10,25)' when l_quantity >= 25 and l_quantity <= 50 then '[25,50]' else 'out_of_range' end"
_CONFORMAL = L + f""", b as (select *, greatest(0.0, y - q) as r, {_BIN} as quantity_bin from l),
 g as (select r, 'all' as dimension, 'all' as key from b union all select r, 'l_returnflag', l_returnflag from b union all select r, 'l_linestatus', l_linestatus from b union all select r, 'quantity_bin', quantity_bin from b),
 o as (select *, row_number() over (partition by dimension, key order by r) as i, count(*) over (partition by dimension, key) as n from g),
 k as (select dimension, key, r as correction, n, cast(least(n, ceil((n + 1) * (1 - 0.1))) as bigint) as k from o where i = least(n, ceil((n + 1) * (1 - 0.1)))),
 f as (select a.dimension, a.key, case when a.n < 20 and a.dimension <> 'all' then z.correction else a.correction end as correction, a.n, a.k, case when a.n < 20 and a.dimension <> 'all' then 'small_group' end as reason from k a, k z where z.dimension = 'all')"""
_WINNERS = V + """, r as (select *, row_number() over (partition by g order by pred desc, a) as i, max(target) over (partition by g) as best from v),
 w as (select g, max(case when i = 1 then a end) as selected, max(case when i = 1 then best - target end) as regret, max(case when i <= 2 and target = best then 1 else 0 end) as top2 from r group by g)"""


def _pairs_sql(condition: str) -> str:
    return f"""with {V}, u as (select * from v where {condition}), s as (select g, count(*) as c from u group by g),
 x as (select case when a.pred > b.pred then 1.0 when a.pred = b.pred then 0.5 else 0.0 end as credit from u a join u b on a.g = b.g and a.target > b.target),
 t as (select count(*) as pairs, avg(credit) as acc from x)"""


ORACLE = {
    "auroc": f"with {P}, s as (select score as s, sum(label) as pos, count(*) as n from p group by score), r as (select pos, n, coalesce(sum(n) over (order by s rows between unbounded preceding and 1 preceding), 0) + (n + 1) / 2 as k from s) select 'auroc' as metric, round((sum(pos * k) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * sum(n - pos)), 9) as value, cast(null as varchar) as reason from r",
    "average_precision": f"with {_CURVE} select 'average_precision' as metric, round(sum(pos * pr) / sum(pos), 9) as value, cast(null as varchar) as reason from d",
    "auprc_trapezoid": f"with {_CURVE}, e as (select *, coalesce(lag(pr) over (order by s desc), 1.0) as before from d) select 'auprc_trapezoid' as metric, round(sum(pos * (before + pr) / 2) / sum(pos), 9) as value, cast(null as varchar) as reason from e",
    "brier_nll": f"with {P} select round(avg((score - label) * (score - label)), 9) as brier, round(-avg(case when label = 1 then ln(greatest(least(score, 1 - 1e-7), 1e-7)) else ln(1 - greatest(least(score, 1 - 1e-7), 1e-7)) end), 9) as nll from p",
    "ece_bins": f"with {P}, b as (select cast(least(floor(score * 10), 9) as int) as bin, count(*) as n, avg(score) as c, avg(label) as a from p group by 1) select cast(i as int) as bin, coalesce(n, 0) as n, round(c, 9) as confidence, round(a, 9) as accuracy from generate_series(0, 9) t(i) left join b on i = bin",
    "ece": f"with {P}, b as (select least(floor(score * 10), 9) as bin, count(*) as n, abs(avg(score) - avg(label)) as gap from p group by 1) select round(sum(n * gap) / sum(n), 9) as ece from b",
    "false_safe_rate": f"with {P} select cast(sum(label) as bigint) as positives, count(*) filter (label = 1 and score < 0.5) as false_safe, round(count(*) filter (label = 1 and score < 0.5) / sum(label), 9) as rate from p",
    "coverage_tightness": f"with {L} select l_returnflag, count(*) as n, round(avg(case when y <= q then 1.0 else 0.0 end), 9) as coverage, round(avg(greatest(0.0, q - y)), 9) as excess, round(avg(q), 9) as mean_upper from l group by l_returnflag",
    "clearance_summary": f"with {L} select l_linestatus, round(avg(y - q) filter (l_quantity >= 10), 9) as mean, round(min(y - q) filter (l_quantity >= 10), 9) as least, round(max(y - q) filter (l_quantity >= 10), 9) as most, count(*) filter (not l_quantity >= 10) as excluded from l group by l_linestatus",
    "pairwise_ordering": _pairs_sql("cost > 0.005") + " select round(acc, 9) as accuracy, pairs, (select cast(sum(c * (c - 1) / 2) as bigint) from s) - pairs as target_ties, (select count(*) from s where c = 1) as singletons, (select count(*) from v where not cost > 0.005) as ineligible from t",
    "pair_accuracy": _pairs_sql("true") + " select coalesce(round(acc, 9), 0.0) as accuracy, pairs from t",
    "spearman": "with r as (select rank() over (order by s_acctbal) + (count(*) over (partition by s_acctbal) - 1) / 2 as x, rank() over (order by s_nationkey) + (count(*) over (partition by s_nationkey) - 1) / 2 as y from supplier) select 'spearman' as metric, round(corr(x, y), 9) as value from r",
    "kendall_tau_b": """with c as (select l_returnflag as g, l_tax as a, l_quantity as b, count(*) as n from lineitem group by all),
 p as (select x.g, sign(x.a - y.a) * sign(x.b - y.b) as s, x.a = y.a as ta, x.b = y.b as tb, x.n * y.n as w from c x join c y on x.g = y.g and (x.a, x.b) < (y.a, y.b)),
 k as (select g, sum(w) filter (s > 0) as c, sum(w) filter (s < 0) as d, coalesce(sum(w) filter (ta), 0) as ta, coalesce(sum(w) filter (tb), 0) as tb from p group by g)
select g as l_returnflag, cast(c as bigint) as concordant, cast(d as bigint) as discordant, cast(ta as bigint) as tied_a, cast(tb as bigint) as tied_b, round((c - d) / sqrt((c + d + ta) * (c + d + tb)), 9) as tau_b from k""",
    "kendall_of_prices": """with o as (select o_orderstatus as g, o_orderkey as a, o_totalprice as b from orders), p as (select x.g, sign(y.b - x.b) as s from o x join o y on x.g = y.g and x.a < y.a),
 k as (select g, count(*) filter (s > 0) as c, count(*) filter (s < 0) as d, count(*) filter (s = 0) as tb from p group by g)
select g as o_orderstatus, c as concordant, d as discordant, 0::bigint as tied_a, tb as tied_b, round((c - d) / sqrt((c + d)::double * (c + d + tb)), 9) as tau_b from k""",
    "topk_regret": f"with {_WINNERS} select count(*) as groups, round(avg(regret), 9) as mean_regret, round(avg(top2), 9) as top2_rate from w",
    "action_selection_counts": f"with {_WINNERS}, k as (select distinct a from v) select cast(k.a as int) as a, count(w.g) as n from k left join w on w.selected = k.a group by k.a",
    "useful_f1_huber": f"""with {V}, e as (select pred >= 0.04 as said, target > 0.05 as useful, pred - target as e from v),
 s as (select count(*) filter (said and useful) as tp, count(*) filter (said and not useful) as fp, count(*) filter (not said and useful) as fn, round(avg(case when abs(e) <= 0.03 then e * e / 2 else 0.03 * (abs(e) - 0.015) end), 9) as huber, round(avg(e * e), 9) as mse from e)
select tp, fp, fn, round(2 * tp / (2 * tp + fp + fn), 9) as f1, huber, mse from s""",
    "loss_aggregates": f"""with {L}, s as (select *, case when y > 0.5 then 1.0 else 0.0 end as z, greatest(least(q, 1 - 1e-7), 1e-7) as p, y - q as e from l),
 a as (select l_returnflag, round(avg(greatest(0.9 * e, -0.1 * e)), 9) as pinball, round(avg(abs(e)), 9) as mae, round(avg(-(z * ln(p) + (1 - z) * ln(1 - p))), 9) as bce, round(avg(case when abs(e) <= 0.3 then e * e / 2 else 0.3 * (abs(e) - 0.15) end), 9) as huber from s group by all),
 c as (select l_returnflag, z, round(q, 6) as q, count(*) as n from s group by all),
 h as (select u.l_returnflag, round(sum(u.n * v.n * greatest(0.0, 0.1 - (u.q - v.q))) / sum(u.n * v.n), 9) as hinge from c u join c v on u.l_returnflag = v.l_returnflag and u.z = 1 and v.z = 0 group by all)
select a.*, hinge from a left join h using (l_returnflag)""",
    "conformal_global": f"with {_CONFORMAL} select round(correction, 9) as correction, n, k from f where dimension = 'all'",
    "conformal_grouped": f"with {_CONFORMAL} select dimension, key, round(correction, 9) as correction, n, k, reason from f",
    "conformal_apply": f"with {_CONFORMAL}, done as (select quantity_bin, y, least(greatest(q + coalesce(a.correction, z.correction), 0.0), 1.0) as u from b left join f a on a.dimension = 'quantity_bin' and a.key = quantity_bin join f z on z.dimension = 'all') select quantity_bin, count(*) as n, round(avg(u), 9) as mean_upper, round(avg(case when y <= u then 1.0 else 0.0 end), 9) as coverage from done group by quantity_bin",
    "group_bins": f"with {L} select {_BIN} as quantity_bin, count(*) as n from l group by 1",
    "subset_report": f"with {P}, s as (select 'all' as subset, label, true as inside from p union all select 'english', label, lower(trim(lang)) = 'en' from p union all select 'low_quality', label, quality = 0 from p union all select 'unknown_source', label, source = 'none' from p) select subset, count(*) filter (inside) as n, cast(coalesce(sum(label) filter (inside), 0) as bigint) as positives from s group by subset",
    "method_compare": f"with {P} select count(*) as n, cast(0 as bigint) as unmatched, round(avg((score - label) * (score - label) - (1 - score - label) * (1 - score - label)), 9) as brier_gain from p",
}
