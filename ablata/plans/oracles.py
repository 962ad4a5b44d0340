"""SQL twins of the queries, for DuckDB. Shared parts are common table expressions."""

from __future__ import annotations

_SAMPLES = """samples AS (
    SELECT c_nationkey AS subject, o_orderkey AS sample, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS yhat,
        CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS y
    FROM orders JOIN customer ON o_custkey = c_custkey)"""
_INC = (
    _SAMPLES
    + """, inc AS (
    SELECT DISTINCT subject, sample, p_brand AS feature, yhat, y
    FROM lineitem JOIN samples ON l_orderkey = sample JOIN part ON l_partkey = p_partkey)"""
)
_INFLUENCE_OF = """, totals AS (
    SELECT subject, count(*) AS n, sum(yhat) AS sy FROM samples GROUP BY subject HAVING count(DISTINCT yhat) >= 2),
columns_ AS (
    SELECT subject, feature, count(*) AS sx, sum(yhat) AS sxy, string_agg(CAST(sample AS VARCHAR), ',' ORDER BY sample) AS sig FROM inc GROUP BY subject, feature),
ranked_ AS (SELECT *, row_number() OVER (PARTITION BY subject, sig ORDER BY feature) AS same FROM columns_),
kept AS (SELECT *, count(*) OVER (PARTITION BY subject) AS k FROM ranked_ WHERE {which}),
r AS (
    SELECT subject, feature, n, sx, sxy, k, sx IN (0, n) AS constant,
        CASE WHEN sx IN (0, n) THEN 0.0 ELSE coalesce((CAST(n AS DOUBLE) * sxy - CAST(sx AS DOUBLE) * sy) / nullif(sqrt((CAST(n AS DOUBLE) * sx - CAST(sx AS DOUBLE) * sx) * (CAST(n AS DOUBLE) * sy - CAST(sy AS DOUBLE) * sy)), 0), 0.0) END AS corr
    FROM kept JOIN totals USING (subject)),
s AS (SELECT *, CASE WHEN constant THEN 1.0 WHEN {df} > 0 THEN sqrt(greatest(1 - corr * corr, 0.0) / {df}) END AS se FROM r),
influence AS (
    SELECT subject, feature, n, sx, CAST(sxy AS BIGINT) AS sxy, corr, se,
        CASE WHEN constant OR se IS NULL THEN -1.0 ELSE greatest(corr - se, -1.0) END AS lower,
        CASE WHEN constant OR se IS NULL THEN 1.0 ELSE least(corr + se, 1.0) END AS upper
    FROM s)"""
_INFLUENCE = _INC + _INFLUENCE_OF
# The same of samples without repeats.
_ONCE = (
    _INC.replace("samples", "every_sample").replace(", inc AS (", ", every_inc AS (")
    + """, sets AS (SELECT s.subject, s.sample, s.yhat, s.y, coalesce(string_agg(feature, ',' ORDER BY feature), '') AS sig FROM every_sample s LEFT JOIN every_inc i ON i.subject = s.subject AND i.sample = s.sample GROUP BY ALL),
samples AS (SELECT subject, min(sample) AS sample, yhat, y FROM sets GROUP BY subject, sig, yhat, y),
inc AS (SELECT i.* FROM every_inc i SEMI JOIN samples s ON i.subject = s.subject AND i.sample = s.sample)"""
    + _INFLUENCE_OF.format(which="same = 1", df="(k - 2)")
)
# Two-sided p of Student's t for r of n pairs, as the finite series in sine (r) and cosine of the angle whose tangent is t / sqrt(df).
_P = """CASE WHEN sx IN (0, n) OR n < 3 THEN 1.0 WHEN abs(corr) >= 1 THEN 0.0
    WHEN n % 2 = 0 THEN 1 - abs(corr) * list_sum(list_transform(range(0, (n - 2) // 2), lambda k: exp(k * ln(1 - corr * corr) + lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1.0))))
    WHEN n = 3 THEN 1 - asin(abs(corr)) * 2 / pi()
    ELSE 1 - 2 / pi() * (asin(abs(corr)) + abs(corr) * list_sum(list_transform(range(0, (n - 3) // 2), lambda k: exp((k + 0.5) * ln(1 - corr * corr) + lgamma(k + 1.0) + lgamma(1.5) - lgamma(k + 1.5))))) END"""
_UNIQUE = _INFLUENCE.format(which="same = 1", df="(k - 2)")
_ALL = (
    _INFLUENCE.format(which="TRUE", df="(k - 2)")
    + """, judged AS (
    SELECT subject, feature, se, round(corr, 6) AS corr, CASE WHEN lower < 0 AND upper > 0 THEN 'INSIGNIFICANT' ELSE 'SIGNIFICANT' END AS verdict FROM influence),
signed_ AS (SELECT *, CASE WHEN corr > 0 THEN 'positive' ELSE 'negative' END AS sign FROM judged WHERE corr <> 0),
ranks AS (SELECT *, CAST(row_number() OVER (PARTITION BY subject, sign ORDER BY CASE WHEN sign = 'positive' THEN -corr ELSE corr END, feature) AS INTEGER) AS rank FROM signed_)"""
)
_TONE = """CASE WHEN corr = 0 THEN 'none' ELSE (CASE WHEN verdict = 'SIGNIFICANT' THEN 'strong' ELSE 'weak' END) || (CASE WHEN corr > 0 THEN '-positive' ELSE '-negative' END) END"""
_STRATA = "strata AS (SELECT source AS subject, lang AS cluster, doc_id AS feature FROM documents)"
_SHARES = _STRATA + ", counts_ AS (SELECT subject, cluster, count(*) AS n FROM strata GROUP BY ALL), shares AS (SELECT subject, cluster, n, n / sum(n) OVER (PARTITION BY subject) AS proportion FROM counts_)"
_MIN = _SHARES + ", least_ AS (SELECT subject, CAST(sum(n) AS BIGINT) AS n_items, CAST(least(ceil(1.0::DOUBLE / min(proportion)), sum(n)) AS BIGINT) AS min_size FROM shares GROUP BY subject)"


def _hash(*parts: str) -> str:
    return f"md5(concat_ws('|', {', '.join(parts)}))"


def _draw(*parts: str) -> str:
    return f"(('0x' || substr({_hash(*parts)}, 1, 8))::BIGINT)"


_SIZES = _MIN + f", sizes AS (SELECT subject, sample, min_size + {_draw('7', 'subject', 'sample')} % (n_items - min_size + 1) AS size FROM least_, range(20) AS g(sample))"
_ITEMS = _STRATA + ", items AS (SELECT subject, feature, count(*) OVER (PARTITION BY subject) AS n FROM strata)"
_POOLS = _STRATA + ", pools AS (SELECT subject, feature, CASE WHEN quality = toxic THEN 'positive' ELSE 'negative' END AS pool FROM strata JOIN labels ON doc_id = feature)"


#: ``d``: distances of a subject's items by metric, and ``m``: the least greatest step between them.
_PATHS = """e AS MATERIALIZED (SELECT CAST(vec_id // 25 AS INTEGER) AS subject, vec_id AS item, embedding::DOUBLE[] AS v FROM embeddings),
d AS MATERIALIZED (SELECT a.subject, metric, a.item AS a, b.item AS b, CASE WHEN a.item = b.item THEN 0.0 WHEN metric = 'euclidean' THEN list_distance(a.v, b.v) ELSE greatest(0.0, 1 - list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))) END AS d
    FROM e a JOIN e b USING (subject), (VALUES ('euclidean'), ('cosine')) AS t(metric)),
m0 AS (SELECT * FROM d)""" + "".join(
    f", m{k} AS MATERIALIZED (SELECT x.subject, x.metric, x.a, y.b, min(greatest(x.d, y.d)) AS d FROM m{k - 1} x JOIN m{k - 1} y ON x.subject = y.subject AND x.metric = y.metric AND x.b = y.a GROUP BY ALL)" for k in range(1, 6)
) + ", m AS (SELECT * FROM m5)"


def _uniform(source: str, samples: int, least: str, most: str) -> str:
    """Common table expressions that end in ``drawn`` (subject, sample, feature)."""
    return f"""n_ AS (SELECT subject, count(*) AS n FROM {source} GROUP BY subject),
bounds AS (SELECT subject, n, least({least}, least(greatest({most}, 1), n)) AS lo, least(greatest({most}, 1), n) AS hi FROM n_),
sized AS (SELECT subject, sample, lo + {_draw("7", "subject", "sample")} % (hi - lo + 1) AS k FROM bounds, range({samples}) AS g(sample)),
drawn AS (
    SELECT subject, sample, feature FROM {source} JOIN sized USING (subject)
    QUALIFY row_number() OVER (PARTITION BY subject, sample ORDER BY {_hash("7", "subject", "sample", "feature")}, feature) <= any_value(k) OVER (PARTITION BY subject, sample))"""


_QUOTA = (
    _SAMPLES
    + """, running AS (
    SELECT *, coalesce(sum(CASE WHEN yhat = y THEN 1 ELSE 0 END) OVER w, 0) AS p, coalesce(sum(CASE WHEN yhat = y THEN 0 ELSE 1 END) OVER w, 0) AS q
    FROM samples WINDOW w AS (PARTITION BY subject ORDER BY sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
kept AS (SELECT * FROM running WHERE p < 20 AND q < 20)"""
)
_SUMMED = "SELECT subject, sample, count(*) AS n, CAST(sum(feature) AS BIGINT) AS id_sum FROM drawn GROUP BY subject, sample"

ORACLES = {
    "cohort_filter": "SELECT c_nationkey AS subject, count(*) AS n_items FROM customer WHERE c_acctbal > 0 GROUP BY 1 HAVING count(*) >= 20",
    "negative_cohort": "SELECT c_custkey AS subject FROM customer WHERE c_acctbal <= 0",
    "list_literal": "SELECT p_brand, CAST(count(DISTINCT p_type) AS INTEGER) AS n, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS joined FROM part GROUP BY p_brand",
    "label_binarized": "SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN 1 ELSE 0 END AS two, CASE WHEN p_size % 4 = 3 THEN 2 ELSE CAST(p_size % 4 AS INTEGER) END AS three FROM part",
    "first_lookup": "SELECT n_nationkey AS subject, n_name, c_custkey, c_name FROM nation JOIN customer ON c_nationkey = n_nationkey QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) = 1",
    "zipped_arrays": "SELECT c_nationkey AS subject, c_custkey AS item, c_mktsegment AS cluster FROM customer",
    "resume_antijoin": "SELECT c_custkey AS subject FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "selected_semijoin": "SELECT o_custkey AS subject, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1",
    "pool_difference": "SELECT source AS subject, doc_id AS feature FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = toxic)",
    "merged_tables": "SELECT coalesce(a.key, b.key) AS key, coalesce(b.value, a.value) AS value FROM (SELECT c_nationkey AS key, count(*) AS value FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS key, count(*) AS value FROM supplier GROUP BY 1) b ON a.key = b.key",
    "item_paths": "SELECT doc_id AS feature, 'images/' || source || '_' || doc_id || '.jpg' AS path FROM documents",
    "incidence_counts": f"WITH {_INC} SELECT subject, feature, count(*) AS n_samples, CAST(sum(yhat) AS BIGINT) AS n_positive FROM inc GROUP BY subject, feature",
    "incidence_wide": f"WITH {_INC} SELECT s.subject, s.sample, "
    + ", ".join(f"CAST(coalesce(max(CASE WHEN feature = 'Brand#{b}' THEN 1 END), 0) AS INTEGER) AS \"Brand#{b}\"" for b in range(1, 26))
    + ", s.yhat, s.y FROM samples s LEFT JOIN inc i ON i.subject = s.subject AND i.sample = s.sample GROUP BY s.subject, s.sample, s.yhat, s.y",
    "row_dedup": f"WITH {_INC}, sets AS (SELECT s.subject, s.sample, s.yhat, s.y, coalesce(string_agg(feature, ',' ORDER BY feature), '') AS sig FROM samples s LEFT JOIN inc i ON i.subject = s.subject AND i.sample = s.sample GROUP BY ALL) SELECT subject, min(sample) AS sample, yhat, y FROM sets GROUP BY subject, sig, yhat, y",
    "unique_columns": f"WITH {_SAMPLES}, inc AS (SELECT DISTINCT subject, sample, l_partkey AS feature FROM lineitem JOIN samples ON l_orderkey = sample), sets AS (SELECT subject, feature, string_agg(CAST(sample AS VARCHAR), ',' ORDER BY sample) AS sig FROM inc GROUP BY subject, feature) SELECT subject, min(feature) AS feature FROM sets GROUP BY subject, sig",
    "single_class_skip": "SELECT o_custkey AS subject, count(DISTINCT o_orderstatus = 'F') AS n_classes FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus = 'F') >= 2",
    "few_features": "SELECT l_orderkey AS subject, count(DISTINCT p_brand) AS n_features FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(DISTINCT p_brand) < 4",
    "communities": "SELECT 0 AS subject, label AS cluster, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id) AS items FROM embeddings GROUP BY label",
    "community_labels": "SELECT 0 AS subject, vec_id AS item, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS cluster FROM embeddings",
    "subject_chunks": "SELECT n_nationkey AS subject, CAST(floor((row_number() OVER (ORDER BY n_nationkey) - 1) / 10) AS INTEGER) AS chunk FROM nation",
    "item_positions": "SELECT source AS subject, doc_id AS feature, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS position FROM documents",
    "embeddings_long": "SELECT vec_id, 'PCA' AS method, round(embedding[1]::DOUBLE, 4) AS x, round(embedding[2]::DOUBLE, 4) AS y FROM embeddings UNION ALL SELECT vec_id, 'TSNE', round(embedding[3]::DOUBLE, 4), round(embedding[4]::DOUBLE, 4) FROM embeddings",
    "flat_report": "SELECT label, 'ids' AS metric, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS position, CAST(vec_id AS DOUBLE) AS value FROM embeddings UNION ALL SELECT label, 'n', -1, CAST(count(*) AS DOUBLE) FROM embeddings GROUP BY label",
    "edge_list": "SELECT a.n_regionkey AS subject, a.n_nationkey AS i, b.n_nationkey AS j FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey",
    "grouped_paths": "SELECT s_nationkey AS subject, string_agg('results/' || s_suppkey || '/ridge_coefs.csv', ',' ORDER BY 'results/' || s_suppkey || '/ridge_coefs.csv') AS paths, 'ridge' AS kind FROM supplier GROUP BY 1",
    "cluster_proportions": f"WITH {_SHARES} SELECT subject, cluster, n, round(proportion, 6) AS proportion FROM shares",
    "min_sample_size": f"WITH {_MIN} SELECT * FROM least_",
    "minority_folds": "WITH c AS (SELECT o_custkey AS subject, o_orderstatus = 'F' AS yhat, count(*) AS n FROM orders GROUP BY 1, 2), m AS (SELECT subject, min(n) AS minority FROM c GROUP BY 1) SELECT subject, minority, least(minority, 10) AS n_splits, CASE WHEN minority < 10 THEN minority - 1 ELSE 10 END AS adjusted FROM m",
    "confusion_matrix": f"WITH {_SAMPLES} SELECT subject, count(*) FILTER (y = 0 AND yhat = 0) AS tn, count(*) FILTER (y = 0 AND yhat = 1) AS fp, count(*) FILTER (y = 1 AND yhat = 0) AS fn, count(*) FILTER (y = 1 AND yhat = 1) AS tp FROM samples GROUP BY subject",
    "accuracy": f"WITH {_SAMPLES} SELECT subject, round(avg(CASE WHEN y = yhat THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM samples GROUP BY subject",
    "matthews": f"WITH {_SAMPLES}, c AS (SELECT subject, (count(*) FILTER (y = 0 AND yhat = 0))::DOUBLE AS tn, (count(*) FILTER (y = 0 AND yhat = 1))::DOUBLE AS fp, (count(*) FILTER (y = 1 AND yhat = 0))::DOUBLE AS fn, (count(*) FILTER (y = 1 AND yhat = 1))::DOUBLE AS tp FROM samples GROUP BY subject) SELECT subject, round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0.0), 6) AS mcc FROM c",
    "true_positives": f"WITH {_SAMPLES} SELECT subject, sample, TRUE AS crt FROM samples WHERE y = 1 AND yhat = 1",
    "roc_auc": "WITH r AS (SELECT quality AS y, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS rank FROM labels JOIN documents USING (doc_id)) SELECT round((sum(rank) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc, count(*) AS n FROM r",
    "spearman_rank": "WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS a, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2 AS b FROM part) SELECT p_brand, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY p_brand",
    "coef_summary": """
        WITH l AS (SELECT l_returnflag AS subject, l_linestatus AS feature, l_discount - 0.05::DOUBLE AS coef FROM lineitem),
        s AS (SELECT subject, feature, avg(coef) AS estimate, stddev_samp(coef) AS se, quantile_cont(coef, 0.025) AS lo, quantile_cont(coef, 0.975) AS hi FROM l GROUP BY ALL)
        SELECT subject, feature, round(estimate, 5) AS estimate, round(se, 5) AS se, round(lo, 5) AS bootstrap_lower, round(hi, 5) AS bootstrap_upper, round(estimate - 1.96 * se, 5) AS se_lower, round(estimate + 1.96 * se, 5) AS se_upper,
            CASE WHEN lo < 0 AND hi > 0 THEN 'INSIGNIFICANT' ELSE 'SIGNIFICANT' END AS bootstrap_verdict, CASE WHEN estimate - 1.96 * se <= 0 AND estimate + 1.96 * se >= 0 THEN 'INSIGNIFICANT' ELSE 'SIGNIFICANT' END AS se_verdict
        FROM s""",
    "five_numbers": "SELECT l_returnflag, round_even(min(l_quantity)::DOUBLE, 4) AS minimum, round_even(quantile_cont(l_quantity::DOUBLE, 0.25), 4) AS q1, round_even(quantile_cont(l_quantity::DOUBLE, 0.5), 4) AS median, round_even(quantile_cont(l_quantity::DOUBLE, 0.75), 4) AS q3, round_even(max(l_quantity)::DOUBLE, 4) AS maximum FROM lineitem GROUP BY 1",
    "middle_values": "SELECT l_linestatus, round(avg(l_quantity), 6) AS mean, round(quantile_cont(l_quantity::DOUBLE, 0.5), 6) AS median FROM lineitem GROUP BY 1",
    "heat_scale": "SELECT c_nationkey AS subject, c_custkey AS segment, round(c_acctbal, 2) AS weight, round(max(abs(c_acctbal)) OVER (PARTITION BY c_nationkey), 2) AS vmax FROM customer",
    "marginal_corr": f"WITH {_UNIQUE} SELECT subject, feature, n, sx, sxy, round(corr, 6) AS corr, round(se, 6) AS se, round(lower, 6) AS lower, round(upper, 6) AS upper FROM influence",
    "marginal_samples_dof": f"WITH {_INFLUENCE.format(which='TRUE', df='(n - 2)')} SELECT subject, feature, round(corr, 6) AS corr, round(se, 6) AS se FROM influence",
    "gram_matrix": f"WITH {_INC} SELECT a.subject, a.feature AS a, b.feature AS b, count(*) AS together FROM inc a JOIN inc b ON a.subject = b.subject AND a.sample = b.sample AND a.feature <= b.feature GROUP BY ALL",
    "feature_corr": f"""WITH {_INC}, n_ AS (SELECT subject, count(*)::DOUBLE AS n FROM samples GROUP BY subject), one AS (SELECT subject, feature, count(*)::DOUBLE AS s FROM inc GROUP BY ALL),
        two AS (SELECT a.subject, a.feature AS a, b.feature AS b, count(*)::DOUBLE AS t FROM inc a JOIN inc b ON a.subject = b.subject AND a.sample = b.sample AND a.feature < b.feature GROUP BY ALL),
        pairs AS (SELECT x.subject, x.feature AS a, y.feature AS b, x.s AS sa, y.s AS sb, coalesce(t, 0) AS t, n FROM one x JOIN one y ON x.subject = y.subject AND x.feature < y.feature JOIN n_ ON n_.subject = x.subject LEFT JOIN two ON two.subject = x.subject AND a = x.feature AND b = y.feature)
        SELECT subject, a, b, round(coalesce((n * t - sa * sb) / nullif(sqrt((n * sa - sa * sa) * (n * sb - sb * sb)), 0), 0.0), 6) AS corr FROM pairs""",
    "marginal_job": f"WITH {_ONCE} SELECT subject, feature, round(corr, 6) AS corr, round(se, 6) AS se, round(lower, 6) AS lower, round(upper, 6) AS upper, round({_P}, 6) AS p, CASE WHEN {_P} >= 0.05 THEN 'INSIGNIFICANT' ELSE 'SIGNIFICANT' END AS verdict FROM influence",
    "interval_struct": f"WITH {_UNIQUE} SELECT subject, feature, round(lower, 6) AS lo, round(upper, 6) AS hi FROM influence",
    "spearman_influence": f"WITH {_INFLUENCE.format(which='same = 1', df='(n - 2)')} SELECT subject, feature, round(corr, 6) AS rho, round({_P}, 6) AS p FROM influence",
    "embedding_corr": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT vec_id, list_transform(v, lambda x: x - list_avg(v)) AS v FROM e), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM c)
        SELECT 0 AS subject, a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 5) AS corr FROM u a JOIN u b ON a.vec_id < b.vec_id""",
    "silhouette": """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
        d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.v, b.v)) AS total, count(*) AS n FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY ALL),
        s AS (SELECT vec_id, max(CASE WHEN own = other THEN total / n END) AS a, min(CASE WHEN own <> other THEN total / n END) AS b FROM d GROUP BY vec_id)
        SELECT 0 AS subject, round(avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, count(*) AS n FROM s""",
    "rank_features": f"WITH {_ALL} SELECT subject, feature, sign, rank, corr FROM ranks",
    "top_features": f"WITH {_ALL} SELECT subject, feature, sign, rank FROM ranks WHERE rank <= 3",
    "significance_split": f"WITH {_ALL} SELECT subject, verdict, count(*) AS n, count(*) FILTER (corr > 0) AS n_positive FROM judged GROUP BY subject, verdict",
    "tone_case": f"WITH {_ALL} SELECT subject, feature, {_TONE} AS tone FROM judged",
    "bar_data": f"WITH {_ALL} SELECT subject, feature, CAST(row_number() OVER (PARTITION BY subject ORDER BY corr DESC, feature) AS INTEGER) AS position, {_TONE} AS tone FROM judged",
    "path_manifest": f"WITH {_ALL} SELECT subject, feature, rank, 'images/' || subject || '_' || feature || '.jpg' AS src, 'ranked/' || subject || '/' || sign || '/' || rank || '_' || feature || '.jpg' AS dest FROM ranks",
    "label_text": "SELECT p_partkey AS feature, p_partkey || '_' || printf('%.2f', round_even(p_size / 8.0::DOUBLE, 2)) AS label FROM part",
    "best_algorithm": """WITH s AS (SELECT c_nationkey AS subject, c_mktsegment AS algorithm, round(avg(c_acctbal), 2) AS score FROM customer GROUP BY ALL)
        SELECT subject, first(algorithm ORDER BY score DESC, algorithm) AS best_algorithm, first(algorithm ORDER BY score, algorithm) AS worst_algorithm FROM s GROUP BY subject""",
    "best_cluster_count": "WITH c AS (SELECT p_brand AS subject, p_size AS k, count(*)::DOUBLE AS score FROM part GROUP BY ALL) SELECT subject, k, score FROM c WHERE k BETWEEN 4 AND 30 QUALIFY row_number() OVER (PARTITION BY subject ORDER BY score DESC, k) = 1",
    "sample_size_draw": f"WITH {_SIZES} SELECT subject, CAST(sample AS INTEGER) AS sample, size FROM sizes",
    "sampling_job": f"""WITH {_SIZES.replace("range(20)", "range(10000)")}, quotas AS (SELECT subject, sample, cluster, least(CAST(round_even(size * proportion, 0) AS BIGINT), n) AS k FROM shares JOIN sizes USING (subject)),
        drawn AS (SELECT subject, sample, feature FROM strata JOIN quotas USING (subject, cluster)
            QUALIFY row_number() OVER (PARTITION BY subject, sample, cluster ORDER BY {_hash("7", "subject", "sample", "feature")}, feature) <= any_value(k) OVER (PARTITION BY subject, sample, cluster)),
        sets AS (SELECT subject, sample, count(*) AS n, sum(feature) AS id_sum FROM drawn GROUP BY ALL)
        SELECT subject, count(*) AS n_samples, CAST(sum(n % 2) AS BIGINT) AS label_sum, CAST(sum(n) AS BIGINT) AS n_items, CAST(sum(id_sum) AS BIGINT) AS id_sum FROM sets GROUP BY subject""",
    "ridge_statistics": f"""WITH {_INC}, c AS (SELECT subject, yhat, count(*) AS n FROM samples GROUP BY ALL), m AS (SELECT subject, least(coalesce(min(CASE WHEN yhat = 0 THEN n END), 0), coalesce(min(CASE WHEN yhat = 1 THEN n END), 0), 10) AS m FROM c GROUP BY subject),
        k AS (SELECT subject, greatest(CASE WHEN m < 10 THEN m - 1 ELSE m END, 2) AS k FROM m),
        f AS (SELECT subject, sample, 2 * yhat - 1 AS t, CAST((row_number() OVER (PARTITION BY subject, yhat ORDER BY sample) - 1) % k AS INTEGER) AS fold FROM samples JOIN k USING (subject)),
        i AS (SELECT inc.subject, inc.sample, inc.feature, f.fold, f.t FROM inc JOIN f ON f.subject = inc.subject AND f.sample = inc.sample),
        g AS (SELECT subject, unnest(range(k)) AS fold FROM k), d AS (SELECT DISTINCT subject, feature FROM inc),
        one AS (SELECT subject, fold, feature, count(*) AS s, sum(t) AS st FROM i GROUP BY ALL),
        two AS (SELECT x.subject, x.fold, x.feature AS a, y.feature AS b, count(*) AS n FROM i x JOIN i y ON x.subject = y.subject AND x.sample = y.sample AND x.feature <= y.feature GROUP BY ALL)
        SELECT g.subject, CAST(g.fold AS INTEGER) AS fold, kind, NULL AS a, NULL AS b, coalesce(CASE WHEN kind = 'n' THEN n ELSE t END, 0)::DOUBLE AS value FROM g JOIN (VALUES ('n'), ('target')) v(kind) ON TRUE LEFT JOIN (SELECT subject, fold, count(*) AS n, sum(t) AS t FROM f GROUP BY ALL) x ON x.subject = g.subject AND x.fold = g.fold
        UNION ALL SELECT g.subject, CAST(g.fold AS INTEGER), kind, d.feature, NULL, coalesce(CASE WHEN kind = 'count' THEN s ELSE st END, 0)::DOUBLE FROM g JOIN d USING (subject) JOIN (VALUES ('count'), ('by_target')) v(kind) ON TRUE LEFT JOIN one ON one.subject = g.subject AND one.fold = g.fold AND one.feature = d.feature
        UNION ALL SELECT g.subject, CAST(g.fold AS INTEGER), 'together', d.feature, e.feature, coalesce(two.n, 0)::DOUBLE FROM g JOIN d USING (subject) JOIN d e ON e.subject = g.subject AND d.feature <= e.feature LEFT JOIN two ON two.subject = g.subject AND two.fold = g.fold AND two.a = d.feature AND two.b = e.feature""",
    "matrices_written": f"""WITH {_INC}, n_ AS (SELECT subject, count(*) AS n_samples FROM samples GROUP BY subject), c AS (SELECT subject, count(DISTINCT feature) AS d, count(*) AS ones FROM inc GROUP BY subject),
        extra AS (SELECT subject, sum(yhat + y) AS labels FROM samples GROUP BY subject)
        SELECT "table", subject, n_samples, CAST(coalesce(d, 0) + extra_columns AS INTEGER) AS n_columns, CAST(coalesce(ones, 0) + CASE WHEN extra_columns = 2 THEN labels ELSE 0 END AS BIGINT) AS ones
        FROM n_ LEFT JOIN c USING (subject) JOIN extra USING (subject), (VALUES ('design_matrix', 0), ('pred_results', 2)) AS t("table", extra_columns)""",
    "stratified_sample": f"""WITH {_SIZES}, quotas AS (SELECT subject, sample, cluster, least(CAST(round_even(size * proportion, 0) AS BIGINT), n) AS k FROM shares JOIN sizes USING (subject)),
        drawn AS (SELECT subject, sample, feature FROM strata JOIN quotas USING (subject, cluster)
            QUALIFY row_number() OVER (PARTITION BY subject, sample, cluster ORDER BY {_hash("7", "subject", "sample", "feature")}, feature) <= any_value(k) OVER (PARTITION BY subject, sample, cluster))
        SELECT subject, CAST(sample AS INTEGER) AS sample, count(*) AS n, CAST(sum(feature) AS BIGINT) AS id_sum FROM drawn GROUP BY ALL""",
    "uniform_sample": f"WITH {_ITEMS}, {_uniform('items', 10, '2', '9')} {_SUMMED}",
    "class_pools": f"WITH {_POOLS} SELECT * FROM pools",
    "balanced_sample": f"""WITH {_POOLS}, n_ AS (SELECT subject, count(*) AS n, count(*) FILTER (pool = 'positive') AS np FROM pools GROUP BY subject),
        sized AS (SELECT subject, sample, n, np, least(2, least(10, n)) + {_draw("7", "subject", "sample")} % (least(10, n) - least(2, least(10, n)) + 1) AS size FROM n_, range(10) AS g(sample)),
        quota AS (SELECT subject, sample, least(CAST(floor(size * 0.85::DOUBLE) AS BIGINT), np) AS kp, least(size - CAST(floor(size * 0.85::DOUBLE) AS BIGINT), n - np) AS kn FROM sized),
        drawn AS (SELECT subject, sample, feature, pool FROM pools JOIN quota USING (subject)
            QUALIFY row_number() OVER (PARTITION BY subject, sample, pool ORDER BY {_hash("7", "subject", "sample", "feature")}, feature) <= any_value(CASE WHEN pool = 'positive' THEN kp ELSE kn END) OVER (PARTITION BY subject, sample, pool))
        SELECT subject, CAST(sample AS INTEGER) AS sample, pool, count(*) AS n, CAST(sum(feature) AS BIGINT) AS id_sum FROM drawn GROUP BY ALL""",
    "running_quota": f"WITH {_QUOTA} SELECT subject, count(*) AS n, max(sample) AS last FROM kept GROUP BY subject",
    "quota_deficits": f"WITH {_QUOTA} SELECT subject, greatest(20 - count(*) FILTER (yhat = y), 0) AS need_positive, greatest(20 - count(*) FILTER (yhat <> y), 0) AS need_negative FROM kept GROUP BY subject",
    "share_convergence": f"""WITH {_SAMPLES}, s AS (SELECT subject, sample, CASE WHEN abs((sum(yhat) OVER w)::DOUBLE / count(*) OVER w - 0.4) <= 0.01 THEN 1 ELSE 0 END AS near FROM samples WINDOW w AS (PARTITION BY subject ORDER BY sample ROWS UNBOUNDED PRECEDING)),
        t AS (SELECT *, coalesce(sum(near) OVER (PARTITION BY subject ORDER BY sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r FROM s)
        SELECT subject, count(*) AS n, max(sample) AS last FROM t WHERE r = 0 GROUP BY subject""",
    "subset_enumeration": """WITH a AS (SELECT n_regionkey AS subject, n_nationkey AS f, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation),
        m AS (SELECT DISTINCT subject, mask FROM a, LATERAL (SELECT unnest(range(1, CAST(pow(2, n) AS BIGINT))) AS mask))
        SELECT a.subject, mask, CAST(count(*) AS INTEGER) AS size, string_agg(CAST(f AS VARCHAR), ',' ORDER BY i) AS features FROM m JOIN a ON a.subject = m.subject AND (mask >> i) & 1 = 1 GROUP BY a.subject, mask""",
    "subset_combinations": """WITH a AS (SELECT n_regionkey AS subject, count(*) AS n FROM nation GROUP BY 1), m AS (SELECT subject, unnest(range(1, CAST(pow(2, n) AS BIGINT))) AS mask FROM a)
        SELECT subject, CAST(bit_count(mask) AS INTEGER) AS size, count(*) AS n, CAST(sum(mask) AS BIGINT) AS mask_sum FROM m WHERE bit_count(mask) IN (2, 3) GROUP BY ALL""",
    "top_up": f"""WITH {_POOLS}, n_ AS (SELECT subject, count(*) AS n, count(*) FILTER (pool = 'positive') AS np FROM pools GROUP BY subject),
        needs AS (SELECT subject, count(*) % 7 AS positive, count(*) % 40 AS negative FROM strata GROUP BY subject),
        sides AS (SELECT 'positive' AS side, 0.85::DOUBLE AS share, 1 AS seed, subject, positive AS need FROM needs UNION ALL SELECT 'negative', 1 - 0.85::DOUBLE, 2, subject, negative FROM needs),
        grid AS (SELECT side, share, seed, subject, n, np, sample FROM sides JOIN n_ USING (subject), range(40) AS g(sample) WHERE sample < need),
        sized AS (SELECT *, 1 + {_draw("seed", "subject", "sample")} % least(8, n) AS size FROM grid),
        wanted AS (SELECT *, CASE WHEN np = n THEN size WHEN np = 0 THEN 0 ELSE CAST(floor(size * share) AS BIGINT) END AS w FROM sized),
        quota AS (SELECT side, seed, subject, sample, least(w, np) AS kp, least(size - w, n - np) AS kn FROM wanted),
        drawn AS (SELECT side, subject, sample, pool FROM pools JOIN quota USING (subject)
            QUALIFY row_number() OVER (PARTITION BY side, subject, sample, pool ORDER BY {_hash("seed", "subject", "sample", "feature")}, feature) <= any_value(CASE WHEN pool = 'positive' THEN kp ELSE kn END) OVER (PARTITION BY side, subject, sample, pool))
        SELECT subject, side, CAST(sample AS INTEGER) AS sample, count(*) AS n, count(*) FILTER (pool = 'positive') AS n_positive FROM drawn GROUP BY ALL""",
    "bootstrap_indices": f"WITH n_ AS (SELECT count(*) AS n FROM customer) SELECT replicate, CAST(draw AS INTEGER) AS draw, {_draw('7', 'replicate', 'draw')} % n AS row FROM range(20) AS r(replicate), n_, LATERAL (SELECT unnest(range(0, n)) AS draw)",
    "minority_top_up": f"""WITH l AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row, toxic AS y FROM labels), n_ AS (SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS k FROM l),
        place AS (SELECT row AS other, y AS rare, row_number() OVER (PARTITION BY y ORDER BY row) - 1 AS place, count(*) OVER (PARTITION BY y) AS of_ FROM l),
        d AS (SELECT replicate, CAST(draw AS INTEGER) AS draw, {_draw('7', 'replicate', 'draw')} % n AS row, n, k FROM range(20) AS r(replicate), n_, LATERAL (SELECT unnest(range(0, n)) AS draw)),
        c AS (SELECT replicate, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1 FROM d JOIN l USING (row) GROUP BY replicate),
        m AS (SELECT d.*, CASE WHEN n0 <= n1 THEN 0 ELSE 1 END AS rare, least(n0, n1) < k AND draw > n - 1 - k AS swap FROM d JOIN c USING (replicate))
        SELECT replicate, draw, CASE WHEN swap THEN other ELSE row END AS row FROM m JOIN (SELECT DISTINCT rare, of_ FROM place) USING (rare) LEFT JOIN place p ON p.rare = m.rare AND p.place = {_draw('7', 'replicate', 'draw', "'swap'")} % p.of_""",
    # The least greatest step between two items over all paths, by five squarings: subjects have 25 items at most.
    "threshold_components": f"""WITH {_PATHS}, far AS (SELECT subject, metric, max(d) AS far FROM d GROUP BY ALL),
        t AS (SELECT step, 0.15::DOUBLE + step * ((0.97::DOUBLE - 0.15::DOUBLE) / 999) AS threshold FROM range(1000) AS r(step)),
        l AS (SELECT m.subject, m.metric, t.threshold, m.a, min(m.b) AS label FROM m JOIN far USING (subject, metric), t WHERE 1 - m.d / far >= t.threshold AND m.b <= m.a GROUP BY ALL)
        SELECT subject, metric, round(threshold, 6) AS threshold, CAST(count(DISTINCT label) AS INTEGER) AS k, CAST(sum(label) AS BIGINT) AS label_sum FROM l GROUP BY subject, metric, l.threshold""",
    # An item that isn't the least of all stops being the least of its component at its least such step to a lesser item.
    "spanning_trees": f"""WITH {_PATHS}, s AS (SELECT subject, a, min(d) AS d FROM m WHERE b < a AND metric = 'euclidean' GROUP BY ALL) SELECT subject, count(*) AS n, round(sum(d), 6) AS weight FROM s GROUP BY subject""",
    "first_merges": """WITH e AS (SELECT CAST(vec_id // 25 AS INTEGER) AS subject, vec_id AS item, embedding::DOUBLE[] AS v FROM embeddings),
        d AS (SELECT a.subject, a.item AS i, least(a.item, b.item) AS a, greatest(a.item, b.item) AS b, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.subject = b.subject AND a.item <> b.item),
        n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY subject, i ORDER BY d, a, b) = 1),
        p AS (SELECT subject, a, b, min(d) AS d FROM n GROUP BY ALL HAVING count(*) = 2)
        SELECT subject, linkage, a, b, round(CASE WHEN linkage = 'ward' THEN d * d ELSE d END, 6) AS height FROM p, (VALUES ('ward'), ('complete'), ('average'), ('single')) AS t(linkage)""",
    "csv_scan": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "csv_index_scan": "SELECT n_nationkey, n_name FROM nation",
    "csv_by_subject": f"WITH {_INFLUENCE.format(which='TRUE', df='(k - 2)')} SELECT subject, feature, n, sx, round(corr, 6) AS corr FROM influence",
    "json_scan": "SELECT n_regionkey, n_nationkey, n_name FROM nation",
    "versions_discovered": "SELECT '01-0' || day || '-2024-00-00-00' AS version, r_regionkey, 1::BIGINT AS files FROM region, range(1, 3) AS d(day) WHERE r_regionkey >= day",
    "nan_to_zero": "SELECT p_partkey, CASE WHEN p_size % 7 = 0 OR p_size % 5 = 0 THEN 0.0 ELSE p_size END::DOUBLE AS v FROM part",
    "columns_joined": "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer",
    "silhouette_curve": "SELECT p_partkey AS subject, CASE WHEN p_size % 2 = 0 THEN p_type || '-' || p_brand ELSE p_type END AS series, p_size AS cluster_n, p_retailprice AS score FROM part",
    "flat_set": "WITH i AS (SELECT n_regionkey, n_nationkey AS i FROM nation UNION SELECT n_regionkey, n_nationkey % 3 FROM nation) SELECT n_regionkey, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS ids FROM i GROUP BY 1",
    "subset_counts": "WITH c AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) SELECT n_regionkey, CAST(coalesce(sum(factorial(n::INTEGER) / (factorial(k::INTEGER) * factorial((n - k)::INTEGER))), 0) AS BIGINT) AS subsets FROM c LEFT JOIN range(2, 5) AS r(k) ON k <= n GROUP BY n_regionkey",
    "constant_columns": "SELECT * FROM (VALUES ('r_regionkey', FALSE), ('r_name', FALSE), ('one', TRUE)) AS t(name, constant) UNION ALL SELECT 'r_comment', FALSE WHERE FALSE",
    "train_test_split": f"SELECT doc_id AS id, quality AS y, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY {_hash('42', 'doc_id')}, doc_id) <= ceil(count(*) OVER (PARTITION BY quality) * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM labels",
    "monte_carlo": f"WITH {_POOLS}, items AS (SELECT subject, feature FROM pools WHERE pool = 'positive'), {_uniform('items', 5, '1', '6')} {_SUMMED}",
    "sample_to_incidence": f"WITH {_ITEMS}, {_uniform('items', 10, '1', '9')}, scored AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY subject, sample) > 4 THEN 1 ELSE 0 END AS yhat FROM drawn) SELECT subject, feature, count(*) AS n_samples, CAST(sum(yhat) AS BIGINT) AS n_positive FROM scored GROUP BY subject, feature",
    "scored_by_function": "SELECT source AS subject, doc_id AS feature, CAST(doc_id % 2 AS INTEGER) AS yhat FROM documents",
    "probabilities": "SELECT c_custkey, round(1 - 1 / (1 + exp(-c_acctbal / 5000)), 6) AS p0, round(1 / (1 + exp(-c_acctbal / 5000)), 6) AS p1 FROM customer",
    "ext_stream_counts": f"WITH {_INC} SELECT subject, feature, count(*) AS sx, CAST(sum(yhat) AS BIGINT) AS sxy FROM inc GROUP BY subject, feature",
    "keyed_draws": f"SELECT n_nationkey, {_draw('7', 'n_nationkey')} AS draw FROM nation",
}
