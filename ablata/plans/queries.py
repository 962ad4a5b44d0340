"""One query for each operator, over whole tables, with SQL twins where SQL can say it.

Twins are written from the definitions, not from the DataFrame code. Floating values are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import durable
from ..functions import keyed
from ..operators import clustering, cohort, correlation, hierarchy, incidence, jobs, linear, metrics, ranking, reshape, ridge, sampling, scoring
from ..sources import adapters, readers, sinks
from ..streaming import incremental
from . import oracles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = oracles.ORACLES
SEED = 7


def query(run: Query) -> Query:
    """Registers a query by its name."""
    QUERIES[run.__name__] = run
    return run


def _r(column: Column | str, places: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, places)


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: _r(c, places) for c in columns})


# Sources, selection, joins


@query
def cohort_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' and customers' nations with a positive balance, and at least 20 items."""
    customers = adapters.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("subject"), F.col("c_acctbal").alias("severity"))
    return cohort.min_count(cohort.positives(customers), 20).select("subject", "n_items")


@query
def negative_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = adapters.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_acctbal").alias("severity"))
    return cohort.negatives(customers).select("subject")


@query
def list_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands' types written as a list literal and parsed again."""
    from ..sources.readers import list_literal as parse

    typed = adapters.read(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("types"))
    cell = F.concat(F.lit("['"), F.array_join("types", "', '"), F.lit("']"))
    parsed = typed.select("p_brand", parse(cell).alias("parsed"))
    return parsed.select("p_brand", F.size("parsed").alias("n"), F.array_join("parsed", "|").alias("joined"))


@query
def label_binarized(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = (F.col("p_size") % 4).cast("int")
    return adapters.read(spark, sf_dir, "part").select("p_partkey", cohort.binarized(level).alias("two"), cohort.binarized(level, 3).alias("three"))


@query
def first_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's first customer."""
    keys = adapters.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("subject"), "n_name")
    table = adapters.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("subject"), "c_custkey", "c_name")
    return cohort.lookup(keys, table, "subject", "c_custkey")


@query
def zipped_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation's customers and their segments, as two arrays zipped again."""
    customers = adapters.read(spark, sf_dir, "customer")
    pairs = F.array_sort(F.collect_list(F.struct("c_custkey", "c_mktsegment")))
    listed = customers.groupBy(F.col("c_nationkey").alias("subject")).agg(pairs.alias("p")).select("subject", F.col("p.c_custkey").alias("items"), F.col("p.c_mktsegment").alias("clusters"))
    return cohort.zipped(listed, "items", "clusters", ("item", "cluster"))


@query
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a pending order yet."""
    subjects = adapters.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"))
    pending = adapters.read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return cohort.not_done(subjects, pending.select(F.col("o_custkey").alias("subject")))


@query
def selected_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers with a positive balance, counted by nation."""
    rows = adapters.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), "o_orderkey")
    good = cohort.positives(adapters.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_acctbal").alias("severity")))
    return cohort.selected(rows, good).groupBy("subject").agg(F.count("*").alias("n"))


@query
def pool_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = adapters.strata(spark, sf_dir).select("subject", "feature")
    pool = adapters.outcomes(spark, sf_dir).filter("yhat = y").select(F.col("id").alias("feature")).join(items, "feature").select("subject", "feature")
    return cohort.other_pool(items, pool, ["subject", "feature"])


@query
def merged_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = adapters.read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.count("*").alias("value"))
    right = adapters.read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.count("*").alias("value"))
    return cohort.merged(left, right, "key")


@query
def item_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.strata(spark, sf_dir).select("feature", cohort.item_path("images", F.col("subject"), F.col("feature")).alias("path"))


# Incidence


@query
def incidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidence.counts(adapters.incidence(spark, sf_dir))


@query
def incidence_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 0/1 matrix of all samples over all brands."""
    return incidence.wide(adapters.incidence(spark, sf_dir), adapters.samples(spark, sf_dir), [f"Brand#{i}" for i in range(1, 26)])


@query
def row_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidence.deduplicated(adapters.samples(spark, sf_dir), adapters.incidence(spark, sf_dir), adapters.tasks(spark, sf_dir, "orders"))


@query
def unique_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of an order within a nation as features: few samples hold one, so that equal columns occur."""
    return incidence.unique_features(_part_incidence(spark, sf_dir), tasks=adapters.tasks(spark, sf_dir, "lineitem"))


def _part_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = adapters.spread(adapters.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), adapters.tasks(spark, sf_dir, "lineitem"), "l_orderkey")
    own = adapters.samples(spark, sf_dir)
    return lines.join(own, F.col("l_orderkey") == F.col("sample")).select("subject", F.col("l_orderkey").alias("sample"), F.col("l_partkey").alias("feature")).distinct()


@query
def single_class_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose orders have both labels."""
    orders = adapters.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), (F.col("o_orderstatus") == "F").cast("int").alias("yhat"))
    return cohort.two_classes(orders)


@query
def few_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    inc = adapters.read(spark, sf_dir, "lineitem").join(adapters.read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("subject"), F.col("p_brand").alias("feature"))
    return incidence.few_features(inc, 4)


# Reshape


@query
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reshape.communities(adapters.embeddings(spark, sf_dir))
    return found.select("subject", "cluster", F.array_join("items", ",").alias("items"))


@query
def community_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = reshape.communities(adapters.embeddings(spark, sf_dir)).groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("cluster", "items"))).alias("c"))
    return reshape.community_labels(grouped.select("subject", F.col("c.items").alias("communities")))


@query
def subject_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.chunked(adapters.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("subject")), 10)


@query
def item_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.indexed(adapters.strata(spark, sf_dir).select("subject", "feature"), "feature", ["subject"])


@query
def embeddings_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    wide = adapters.read(spark, sf_dir, "embeddings").select("vec_id", e[0].alias("PCA1"), e[1].alias("PCA2"), e[2].alias("TSNE1"), e[3].alias("TSNE2"))
    return _rounded(reshape.embeddings_long(wide, "vec_id"), "x", "y", places=4)


@query
def flat_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested report of each label's members, flattened."""
    rows = adapters.read(spark, sf_dir, "embeddings").groupBy("label").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.count("*").alias("n"))
    report = rows.select("label", F.struct("ids", "n").alias("members"))
    return reshape.flattened(report, "label", ["members"]).select("label", "metric", F.coalesce("position", F.lit(-1)).alias("position"), "value")


@query
def edge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered pairs of nations in a region."""
    nations = adapters.read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("subject"), F.col("n_nationkey").alias("item"))
    return correlation.edges(nations)


@query
def grouped_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = adapters.read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("subject"), F.format_string("results/%d/ridge_coefs.csv", "s_suppkey").alias("path"))
    grouped = ranking.grouped_paths(paths)
    return grouped.select("subject", F.array_join("paths", ",").alias("paths"), ranking.stem_kind(F.col("paths")[0]).alias("kind"))


# Aggregates and metrics


@query
def cluster_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.proportions(adapters.strata(spark, sf_dir)), "proportion")


@query
def min_sample_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.min_sample_size(adapters.strata(spark, sf_dir))


@query
def minority_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = adapters.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), (F.col("o_orderstatus") == "F").cast("int").alias("yhat"))
    return metrics.folds(orders)


@query
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(adapters.samples(spark, sf_dir), "subject")


@query
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.accuracy(adapters.samples(spark, sf_dir), "subject"), "accuracy")


@query
def matthews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.matthews(adapters.samples(spark, sf_dir), "subject"), "mcc").select("subject", "mcc")


@query
def true_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.true_positives(metrics.correctness(adapters.samples(spark, sf_dir))).select("subject", "sample", "crt")


@query
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = adapters.outcomes(spark, sf_dir).join(adapters.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars"), "id")
    return _rounded(metrics.roc_auc(scored, "n_chars"), "auc")


@query
def spearman_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = adapters.read(spark, sf_dir, "part").select("p_brand", "p_size", "p_retailprice")
    return _rounded(metrics.spearman(parts, "p_size", "p_retailprice", ("p_brand",)), "rho")


@query
def coef_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts, centred, as a bootstrap of each ship mode's coefficient."""
    lines = adapters.read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("subject"), F.col("l_linestatus").alias("feature"), (F.col("l_discount") - 0.05).alias("coef"))
    estimates = lines.groupBy("subject", "feature").agg(F.avg("coef").alias("estimate"))
    return _rounded(metrics.bootstrap_summary(lines, estimates), "estimate", "se", "bootstrap_lower", "bootstrap_upper", "se_lower", "se_upper", places=5)


@query
def five_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.five_numbers(adapters.read(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag")


@query
def middle_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.middle(adapters.read(spark, sf_dir, "lineitem"), "l_quantity", "l_linestatus"), "mean", "median")


@query
def heat_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = adapters.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("subject"), F.col("c_custkey").alias("segment"), F.col("c_acctbal").alias("weight"))
    return _rounded(metrics.heat_scale(weights), "weight", "vmax", places=2)


# Correlations


@query
def marginal_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: influence of each brand on each nation's orders."""
    found = correlation.influence(adapters.incidence(spark, sf_dir), adapters.samples(spark, sf_dir))
    return _rounded(found, "corr", "se", "lower", "upper")


@query
def marginal_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole marginal job with p and verdicts."""
    found = correlation.marginal_job(adapters.incidence(spark, sf_dir), adapters.samples(spark, sf_dir))
    return _rounded(found, "corr", "se", "lower", "upper", "p").select("subject", "feature", "corr", "se", "lower", "upper", "p", "verdict")


@query
def interval_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of the marginal job as one struct, taken apart."""
    found = correlation.with_p(correlation.influence(adapters.incidence(spark, sf_dir), adapters.samples(spark, sf_dir)))
    return _rounded(found.select("subject", "feature", F.col("corr_ci.lo").alias("lo"), F.col("corr_ci.hi").alias("hi")), "lo", "hi")


@query
def marginal_samples_dof(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = correlation.influence(adapters.incidence(spark, sf_dir), adapters.samples(spark, sf_dir), dof="samples", unique=False)
    return _rounded(found, "corr", "se").select("subject", "feature", "corr", "se")


@query
def spearman_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(correlation.spearman_influence(adapters.incidence(spark, sf_dir), adapters.samples(spark, sf_dir)), "rho", "p")


@query
def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation.gram(adapters.incidence(spark, sf_dir), tasks=adapters.tasks(spark, sf_dir, "lineitem"))


@query
def feature_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(correlation.feature_correlations(adapters.incidence(spark, sf_dir), adapters.samples(spark, sf_dir), adapters.tasks(spark, sf_dir, "lineitem")), "corr")


@query
def embedding_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(correlation.vector_correlations(adapters.embeddings(spark, sf_dir)), "corr", places=5)


@query
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(correlation.silhouette(adapters.embeddings(spark, sf_dir)), "silhouette")


@query
def rank_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spearman between marginal r and ridge coefficients, over features of each subject."""
    inc, samples = adapters.incidence(spark, sf_dir), adapters.samples(spark, sf_dir)
    r = correlation.influence(inc, samples).select("subject", "feature", "corr")
    ridge = linear.coefficient_path(inc, samples, [1.0]).select("subject", "feature", "coef")
    return metrics.spearman(r.join(ridge, ["subject", "feature"]), "corr", "coef", ("subject",))


# Ranking


def _influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = correlation.influence(adapters.incidence(spark, sf_dir), adapters.samples(spark, sf_dir), unique=False)
    verdict = ranking.interval_verdict(F.col("lower"), F.col("upper"), strict=True)
    return found.withColumn("corr", _r("corr")).withColumn("verdict", verdict)


@query
def rank_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(_influence(spark, sf_dir), "corr").select("subject", "feature", "sign", "rank", "corr")


@query
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top(_influence(spark, sf_dir), "corr", 3).select("subject", "feature", "sign", "rank")


@query
def significance_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    strong, weak = ranking.split_by(_influence(spark, sf_dir), "verdict")
    return strong.unionByName(weak).groupBy("subject", "verdict").agg(F.count("*").alias("n"), F.count_if(F.col("corr") > 0).alias("n_positive"))


@query
def tone_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _influence(spark, sf_dir)
    return rows.select("subject", "feature", ranking.tone(F.col("corr"), F.col("verdict")).alias("tone"))


@query
def bar_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.bars(_influence(spark, sf_dir), "corr", "se", "verdict").select("subject", "feature", "position", "tone")


@query
def path_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.manifest(_influence(spark, sf_dir), "corr", "images", "ranked")


@query
def label_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eighths, so that half of the odd ones are rounded from the middle."""
    parts = adapters.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("feature"), (F.col("p_size") / 8).alias("v"))
    return ranking.labelled(parts, "v").select("feature", "label")


@query
def best_algorithm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as algorithms, scored by their mean balance in each nation."""
    customers = adapters.read(spark, sf_dir, "customer")
    scores = customers.groupBy(F.col("c_nationkey").alias("subject"), F.col("c_mktsegment").alias("algorithm")).agg(_r(F.avg("c_acctbal"), 2).alias("score"))
    found = ranking.extremes(scores.withColumn("position", F.col("algorithm")))
    return found.select("subject", "best_algorithm", "worst_algorithm")


@query
def best_cluster_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part sizes as k, scored by how many parts have them; the first of equals wins."""
    counted = adapters.read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("subject"), F.col("p_size").alias("k")).agg(F.count("*").cast("double").alias("score"))
    return ranking.best_k(counted, 4, 30, ("subject",)).select("subject", "k", "score")


# Sampling


@query
def sample_size_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_sizes(adapters.strata(spark, sf_dir), 20, SEED)


@query
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty stratified subsets of each source: items and their id sum."""
    drawn = sampling.stratified(adapters.strata(spark, sf_dir), 20, SEED)
    return drawn.groupBy("subject", "sample").agg(F.count("*").alias("n"), F.sum("feature").alias("id_sum"))


@query
def uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = sampling.uniform(adapters.strata(spark, sf_dir).select("subject", "feature"), 10, sampling.SizeRule(min_size=2, max_size=9), SEED)
    return drawn.groupBy("subject", "sample").agg(F.count("*").alias("n"), F.sum("feature").alias("id_sum"))


def _pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = adapters.strata(spark, sf_dir).select("subject", "feature")
    return sampling.pools(items.join(adapters.outcomes(spark, sf_dir).withColumnRenamed("id", "feature"), "feature"))


@query
def class_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pools(spark, sf_dir)


@query
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = sampling.balanced(_pools(spark, sf_dir), 10, 0.85, sampling.SizeRule(min_size=2, max_size=10), SEED)
    return drawn.groupBy("subject", "sample", "pool").agg(F.count("*").alias("n"), F.sum("feature").alias("id_sum"))


@query
def running_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = sampling.until_quota(adapters.samples(spark, sf_dir), 40)
    return kept.groupBy("subject").agg(F.count("*").alias("n"), F.max("sample").alias("last"))


@query
def quota_deficits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.deficits(sampling.until_quota(adapters.samples(spark, sf_dir), 40), 40)


@query
def top_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage two for sources whose needs follow from their number of documents."""
    n = adapters.strata(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("n"))
    needs = n.select("subject", (F.col("n") % 7).alias("need_positive"), (F.col("n") % 40).alias("need_negative"))
    drawn = sampling.top_up(_pools(spark, sf_dir), needs, rule=sampling.SizeRule(max_size=8))
    return drawn.groupBy("subject", "side", "sample").agg(F.count("*").alias("n"), F.count_if(F.col("pool") == "positive").alias("n_positive"))


@query
def share_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = adapters.samples(spark, sf_dir).select("subject", "sample", F.col("yhat").alias("positives"), F.lit(1).alias("size"))
    return sampling.until_share(orders, 0.4, 0.01).groupBy("subject").agg(F.count("*").alias("n"), F.max("sample").alias("last"))


@query
def subset_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = adapters.read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("subject"), F.col("n_nationkey").alias("feature"))
    return sampling.all_subsets(nations).select("subject", "mask", "size", F.array_join("features", ",").alias("features"))


@query
def subset_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = adapters.read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("subject"), F.col("n_nationkey").alias("feature"))
    return sampling.all_subsets(nations, (2, 3)).groupBy("subject", "size").agg(F.count("*").alias("n"), F.sum("mask").alias("mask_sum"))


@query
def bootstrap_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty replicates of as many draws as there are customers."""
    return sampling.bootstrap_rows(adapters.read(spark, sf_dir, "customer").count(), 20, SEED, spark)


@query
def minority_top_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws over the labelled documents; as many toxic ones are asked for as there are, which about half of the replicates lack."""
    numbered = reshape.numbered(adapters.outcomes(spark, sf_dir).withColumn("all", F.lit(0)), "all", "id")
    labels = numbered.select(F.col("position").alias("row"), F.col("yhat").alias("y"))
    n, rare = labels.agg(F.count("*"), F.sum("y")).first()
    return sampling.minority_top_up(sampling.bootstrap_rows(n, 20, SEED, spark), labels, rare, SEED)


@query
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split(adapters.outcomes(spark, sf_dir).select("id", "y"), 0.2)


@query
def monte_carlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = adapters.strata(spark, sf_dir).select("subject", "feature")
    right = _pools(spark, sf_dir).filter("pool = 'positive'").select("subject", "feature")
    return sampling.monte_carlo(items, 5, 6, right, SEED).groupBy("subject", "sample").agg(F.count("*").alias("n"), F.sum("feature").alias("id_sum"))


@query
def sample_to_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample, gather, score with a column, and spread out again."""
    drawn = sampling.uniform(adapters.strata(spark, sf_dir).select("subject", "feature"), 10, sampling.SizeRule(max_size=9), SEED)
    subsets = drawn.groupBy("subject", "sample").agg(F.array_sort(F.collect_list("feature")).alias("features"))
    scored = scoring.score(subsets, (F.size("features") > 4).cast("int"))
    inc = incidence.from_subsets(scored).join(scored.select("subject", "sample", "yhat"), ["subject", "sample"])
    return incidence.counts(inc)


@query
def sampling_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job over all sources with its number of samples: what is committed, from the manifest, with sums over the rows read back."""
    path = durable.new_path(spark, "sampling-job")
    done = jobs.sampling_job(adapters.strata(spark, sf_dir), (F.size("features") % 2).cast("int"), path, seed=SEED)
    inc, scored = jobs.sampled_tables(jobs.sampled(spark, path, "string", "bigint"))
    sums = inc.groupBy("subject").agg(F.count("*").alias("n_items"), F.sum("feature").alias("id_sum"))
    return done.join(sums, "subject").select("subject", "n_samples", "label_sum", "n_items", "id_sum")


@query
def matrices_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Design matrices and prediction tables of all subjects in one write, and their lines read again."""
    path = durable.new_path(spark, "matrices")
    sinks.write_all_matrices(adapters.incidence(spark, sf_dir), adapters.samples(spark, sf_dir), path)
    lines = spark.read.schema("value string, table string, subject int, chunk int").text(path)
    cells, is_row = F.split("value", ","), ~F.col("value").startswith("sample")
    ones = F.when(is_row, F.size(F.filter(F.slice(cells, 2, 1 << 20), lambda c: c == "1")))
    return lines.groupBy("table", "subject").agg(F.count_if(is_row).alias("n_samples"), F.max(F.size(cells) - 1).alias("n_columns"), F.sum(ones).alias("ones"))


@query
def scored_by_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single items scored by a Python function."""
    items = scoring.single_items(adapters.strata(spark, sf_dir).select("subject", "feature"))
    return scoring.score(items, _odd_majority).select("subject", "feature", "yhat")


def _odd_majority(features: list) -> int:
    return int(2 * sum(f % 2 for f in features) > len(features))


@query
def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = adapters.read(spark, sf_dir, "customer").select("c_custkey", scoring.probabilities(F.col("c_acctbal") / 5000).alias("p"))
    return customers.select("c_custkey", _r(F.col("p")[0]).alias("p0"), _r(F.col("p")[1]).alias("p1"))


# Scans, sinks and small reshapings


@query
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as a CSV and read with a stated schema and required columns."""
    path = durable.new_path(spark, "csv-scan")
    adapters.read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").write.option("header", True).csv(path)
    return readers.read_csv(spark, path, "n_nationkey long, n_name string, n_regionkey long", required=("n_name",))


@query
def csv_index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a first column whose name is not the index's."""
    path = durable.new_path(spark, "csv-index")
    adapters.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("_c0"), "n_name").write.option("header", True).csv(path)
    return readers.read_csv(spark, path, "_c0 long, n_name string", index_name="n_nationkey")


@query
def csv_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marginal influence written in a folder for each subject, and read again."""
    path = durable.new_path(spark, "csv-by-subject")
    sinks.write_by_subject(_influence(spark, sf_dir).select("subject", "feature", "n", "sx", "corr"), path, "csv")
    return spark.read.csv(path, header=True, schema="feature string, n long, sx long, corr double, subject long")


@query
def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions' nations written as nested JSON documents, one to a file, and read again."""
    path = durable.new_path(spark, "json-scan")
    nested = adapters.read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations"))
    nested.write.partitionBy("n_regionkey").json(path)
    read = readers.read_json(spark, path, "nations array<struct<n_nationkey: long, n_name: string>>, n_regionkey long")
    return read.select("n_regionkey", F.explode("nations").alias("x")).select("n_regionkey", "x.*")


@query
def versions_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a table beside each other, and the files that a pattern finds."""
    from datetime import datetime

    path, table = durable.new_path(spark, "versions"), adapters.read(spark, sf_dir, "region").select("r_regionkey", "r_name").coalesce(1)
    for day in (1, 2):
        sinks.write_version(table.filter(F.col("r_regionkey") >= day), path, datetime(2024, 1, day))
    found = readers.discover(spark, f"{path}/*/*.parquet")
    version = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    rows = [spark.read.parquet(p).withColumn("version", F.lit(p.rstrip("/").rsplit("/", 1)[-1])) for p in (sinks.stamped(path, datetime(2024, 1, d)) for d in (1, 2))]
    files = found.groupBy(version.alias("version")).agg(F.count("*").alias("files"))
    return rows[0].unionByName(rows[1]).join(files, "version").select("version", "r_regionkey", "files")


@query
def nan_to_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("p_size") % 7 == 0, F.lit(float("nan"))).when(F.col("p_size") % 5 != 0, F.col("p_size").cast("double"))
    return adapters.read(spark, sf_dir, "part").select("p_partkey", metrics.nan_to_zero(value).alias("v"))


@query
def columns_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' balances and segments as two tables, put side by side."""
    customers = adapters.read(spark, sf_dir, "customer")
    return reshape.columns_joined(customers.select("c_custkey", "c_acctbal"), customers.select("c_custkey", "c_mktsegment"), ["c_custkey"])


@query
def silhouette_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part sizes as k and types as algorithms; containers of one letter less tell series apart."""
    linkage = F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))
    swept = adapters.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("subject"), F.col("p_type").alias("algorithm"), linkage.alias("linkage"), F.col("p_size").alias("k"), F.col("p_retailprice").alias("score"))
    return reshape.silhouette_curve(swept)


@query
def flat_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions' nations in lists of lists, flattened to sorted sets."""
    nations = adapters.read(spark, sf_dir, "nation")
    nested = nations.groupBy("n_regionkey").agg(F.collect_list(F.array("n_nationkey", F.col("n_nationkey") % 3)).alias("ids"))
    return reshape.flat_set(nested, "ids").select("n_regionkey", F.array_join("ids", ",").alias("ids"))


@query
def subset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many subsets of two to four nations a region has."""
    n = adapters.read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    return n.select("n_regionkey", metrics.subset_counts(F.col("n"), 2, 4).alias("subsets"))


@query
def constant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a joined table by name, repeats dropped, and which of them have one value only."""
    region = adapters.read(spark, sf_dir, "region")
    return reshape.constant_flags(region.join(region.withColumnRenamed("r_regionkey", "_key"), F.col("r_regionkey") == F.col("_key")).drop("_key").withColumn("one", F.lit(1)))


# Models: no SQL twins; tests hold them against closed forms and optimality conditions


@query
def ridge_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ridge.fit(adapters.incidence(spark, sf_dir), adapters.samples(spark, sf_dir))


@query
def ridge_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that ridge regression sees of a subject's samples: counts, sums and co-occurrences by fold."""
    packed = ridge.blocks(adapters.incidence(spark, sf_dir), adapters.samples(spark, sf_dir))
    return ridge.statistic_rows(ridge.fold_statistics(packed))


@query
def ridge_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job's grid and number of replicates."""
    return ridge.job(adapters.incidence(spark, sf_dir), adapters.samples(spark, sf_dir), 10_000, tasks=adapters.tasks(spark, sf_dir, "orders"))


@query
def ridge_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ridge.coefficient_path(ridge.blocks(adapters.incidence(spark, sf_dir), adapters.samples(spark, sf_dir)), linear.RIDGE_GRID.tolist())


@query
def elastic_net_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten penalties by fifty mixes."""
    return linear.fit(adapters.incidence(spark, sf_dir), adapters.samples(spark, sf_dir), "elastic_net")


@query
def elastic_net_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job's grid, with the number of replicates that the estimator has by itself."""
    return linear.conditional_job(adapters.incidence(spark, sf_dir), adapters.samples(spark, sf_dir), "elastic_net", 250, block=50)


@query
def path_net_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred mixes by a hundred penalties, then a thousand penalties at the best mix."""
    return linear.fit(adapters.incidence(spark, sf_dir), adapters.samples(spark, sf_dir), "path_net")


@query
def model_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    inc, samples = adapters.incidence(spark, sf_dir), adapters.samples(spark, sf_dir)
    fitted = ridge.fit(inc, samples).filter("error is null")
    return metrics.roc_auc(linear.margins(inc, samples, fitted).withColumn("y", F.col("yhat")), "margin", "y", ("subject",))


@query
def regression_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear.diagnostics(adapters.incidence(spark, sf_dir), adapters.samples(spark, sf_dir))


@query
def local_surrogate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's brands by weight in a local surrogate model."""
    return linear.explain_each(adapters.incidence(spark, sf_dir), adapters.samples(spark, sf_dir))


def _small_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors dealt into subjects of about 25 items."""
    vectors = adapters.embeddings(spark, sf_dir)
    return vectors.withColumn("subject", F.floor(F.col("item") / 25).cast("int"))


@query
def cluster_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.sweep(_small_subjects(spark, sf_dir))


@query
def sweep_runtimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many results each algorithm was timed for; the seconds themselves differ from run to run."""
    return clustering.runtimes(clustering.timed_sweep(_small_subjects(spark, sf_dir))).select("subject", "algorithm", "results")


@query
def threshold_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the similarity graph at a thousand thresholds of two metrics, with the sum of all labels at each."""
    vectors = _small_subjects(spark, sf_dir)
    found = hierarchy.threshold_components(vectors.select("subject", "item"), hierarchy.forest_edges(vectors, ("euclidean", "cosine")))
    return _rounded(found, "threshold").drop("step")


@query
def spanning_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each subject's least spanning tree: its edges and their weight."""
    tree = hierarchy.spanning_tree(hierarchy.forest_edges(_small_subjects(spark, sf_dir)))
    return _rounded(tree.groupBy("subject").agg(F.count("*").alias("n"), F.sum("d").alias("weight")), "weight")


@query
def first_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of items that are each other's nearest: what agglomerative clustering merges in its first round, under every linkage."""
    merged = hierarchy.merges(hierarchy.distance_edges(_small_subjects(spark, sf_dir)), rounds=1)
    return _rounded(merged.select("subject", "linkage", "a", "b", "height"), "height")


@query
def agglomerative_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item's cluster for each k from four on, under Ward's linkage, which the sampler takes its strata from."""
    vectors = _small_subjects(spark, sf_dir)
    merged = hierarchy.merges(hierarchy.distance_edges(vectors), ("ward",))
    return hierarchy.labels_at(vectors.select("subject", "item"), merged, clustering.MIN_CLUSTERS + 1, 22)


@query
def cluster_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.leaderboard(clustering.sweep(_small_subjects(spark, sf_dir)))


@query
def reduced_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.reduced(_small_subjects(spark, sf_dir))


@query
def topic_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.topics(adapters.embeddings(spark, sf_dir))


# Extension, not a capability of the reference


@query
def ext_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four counts of the marginal influence, merged from batches of new samples."""
    return incremental.merged_counts(adapters.incidence(spark, sf_dir), parts=3)


@query
def keyed_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.read(spark, sf_dir, "nation").select("n_nationkey", keyed.whole(SEED, F.col("n_nationkey")).alias("draw"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which features most change the predicted label of each subject, marginally."""
    return marginal_corr(spark, sf_dir)
