"""Queries on statistics, models, clusters and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.exprs import numeric_columns, significance_text
from lectern.operators import clusters, features, models, reports, statistics
from lectern.plans.model_queries import _integrated
from lectern.plans.registry import Registry
from lectern.plans.sql import rnd, with_tables
from lectern.plans.tables import REFERENCE_DATE, ROW_ID, Tables

NUMBERS = ["progress_pct", "learning_hours", "grade"]
VIDEO_NUMBERS = ["completion_pct", "watch_count", "watch_seconds"]


def _distribution_sql(table: str, columns: list[str], digits: int = 6) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count({c}) AS count, {rnd(f'avg({c})', digits)} AS mean,
            {rnd(f'quantile_cont({c}, 0.5)', digits)} AS median, {rnd(f'stddev_samp({c})', digits)} AS std,
            {rnd(f'skewness({c})', digits)} AS skew, {rnd(f'kurtosis({c})', digits)} AS kurtosis, {rnd(f'min({c})', digits)} AS min,
            {rnd(f'max({c})', digits)} AS max, {rnd(f'quantile_cont({c}, 0.25)', digits)} AS q25,
            {rnd(f'quantile_cont({c}, 0.75)', digits)} AS q75 FROM {table}"""
        for c in columns
    )


def _pearson_sql(columns: list[str], table: str) -> str:
    def cell(a: str, b: str) -> str:
        return f"1.0::DOUBLE AS {b}" if a == b else f"{rnd(f'corr({a}, {b})')} AS {b}"

    return " UNION ALL ".join(
        f"SELECT '{a}' AS feature, {', '.join(cell(a, b) for b in columns)} FROM {table}" for a in columns
    )


def _spearman_sql(columns: list[str], table: str) -> str:
    def rank(c: str) -> str:
        return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"

    def cell(a: str, b: str) -> str:
        if a == b:
            return f"1.0::DOUBLE AS {b}"
        inner = f"SELECT {rank(a)} AS x, {rank(b)} AS y FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        return f"(SELECT {rnd('corr(x, y)')} FROM ({inner})) AS {b}"

    return " UNION ALL ".join(f"SELECT '{a}' AS feature, {', '.join(cell(a, b) for b in columns)}" for a in columns)


def _kendall_sql(columns: list[str], table: str) -> str:
    def cell(a: str, b: str) -> str:
        if a == b:
            return f"1.0::DOUBLE AS {b}"
        pts = f"(SELECT {a} AS x, {b} AS y, count(*)::DOUBLE AS w FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2)"

        def ties(k: str) -> str:
            return f"(SELECT sum(c * (c - 1) / 2) FROM (SELECT sum(w) AS c FROM {pts} GROUP BY {k}))"

        n = f"(SELECT sum(w) * (sum(w) - 1) / 2 FROM {pts})"
        s = f"(SELECT sum(p.w * q.w * sign(p.x - q.x) * sign(p.y - q.y)) FROM {pts} p, {pts} q WHERE p.x < q.x)"
        return f"{rnd(f'{s} / (sqrt({n} - {ties(chr(120))}) * sqrt({n} - {ties(chr(121))}))')} AS {b}"

    return " UNION ALL ".join(f"SELECT '{a}' AS feature, {', '.join(cell(a, b) for b in columns)}" for a in columns)


def _kendall_levels_sql(a: str, b: str, table: str) -> str:
    """Kendall's tau-b of two columns with many distinct values: pairs are split by the highest bit in which their x ranks differ."""
    pts = f"(SELECT {a} AS x, {b} AS y, count(*)::DOUBLE AS w FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2)"

    def ties(k: str) -> str:
        return f"(SELECT sum(c * (c - 1) / 2) FROM (SELECT sum(w) AS c FROM {pts} GROUP BY {k}))"

    ranks = f"SELECT dense_rank() OVER (ORDER BY x) - 1 AS r, y, w FROM {pts}"
    bits = f"SELECT bit, r >> (bit + 1) AS block, (r >> bit) & 1 AS half, y, w FROM ({ranks}), (SELECT unnest(range(0, 40)) AS bit)"
    lower = "CASE WHEN half = 0 THEN w ELSE 0 END"
    sums = f"""SELECT half, w, sum({lower}) OVER (PARTITION BY bit, block ORDER BY y) AS upto,
            sum({lower}) OVER (PARTITION BY bit, block, y) AS same, sum({lower}) OVER (PARTITION BY bit, block) AS every FROM ({bits})"""
    s = f"(SELECT sum(w * ((upto - same) - (every - upto))) FROM ({sums}) WHERE half = 1)"
    n = f"(SELECT sum(w) * (sum(w) - 1) / 2 FROM {pts})"
    r = rnd(f"{s} / (sqrt({n} - {ties('x')}) * sqrt({n} - {ties('y')}))")
    return f"SELECT '{a}' AS feature, 1.0::DOUBLE AS {a}, {r} AS {b} UNION ALL SELECT '{b}', {r}, 1.0::DOUBLE"


T_COLUMNS = ["group_a", "group_b", "group_a_mean", "group_b_mean", "group_a_n", "group_b_n", "t_statistic"]


def _t_sql(a: str, b: str, group: str) -> str:
    return f"""SELECT a.g AS group_a, b.g AS group_b, {rnd('a.m')} AS group_a_mean, {rnd('b.m')} AS group_b_mean,
            a.n AS group_a_n, b.n AS group_b_n, {rnd('(a.m - b.m) / sqrt(a.v / a.n + b.v / b.n)')} AS t_statistic
        FROM (SELECT {group} AS g, count(*) AS n, avg(learning_hours) AS m, var_samp(learning_hours) AS v FROM caw
                WHERE {group} = {a} GROUP BY 1) a,
            (SELECT {group} AS g, count(*) AS n, avg(learning_hours) AS m, var_samp(learning_hours) AS v FROM caw
                WHERE {group} = {b} GROUP BY 1) b"""


def _statistics(r: Registry) -> None:
    for name in ("sta_1_distributions", "flt_6_numeric_columns"):
        r.add(
            name,
            lambda t: statistics.distributions(t.course_activity().select("email", "course_id", *NUMBERS)),
            with_tables("ca", _distribution_sql("ca", NUMBERS)),
        )
    summary = f"SELECT feature, count::DOUBLE AS count, * EXCLUDE (feature, count) FROM ({_distribution_sql('va', VIDEO_NUMBERS, 3)})"
    r.add(
        "sta_2_summary_table",
        lambda t: statistics.summary_table(t.video_activity(), VIDEO_NUMBERS),
        with_tables("va", summary),
    )
    r.add(
        "sta_3_pearson",
        lambda t: statistics.correlations(t.course_activity(), NUMBERS),
        with_tables("ca", _pearson_sql(NUMBERS, "ca")),
    )
    r.add(
        "sta_4_spearman",
        lambda t: statistics.correlations(t.course_activity(), NUMBERS, "spearman"),
        with_tables("ca", _spearman_sql(NUMBERS, "ca")),
    )
    r.add(
        "sta_5_kendall",
        lambda t: statistics.correlations(t.video_activity(), ["completion_pct", "watch_count"], "kendall"),
        with_tables("va", _kendall_sql(["completion_pct", "watch_count"], "va")),
    )
    r.add(
        "sta_5_kendall_with_gaps",
        lambda t: statistics.correlations(t.course_activity(), ["progress_pct", "grade"], "kendall"),
        with_tables("ca", _kendall_sql(["progress_pct", "grade"], "ca")),
    )
    r.add(
        "sta_5_kendall_continuous",
        lambda t: statistics.correlations(t.course_activity(), ["progress_pct", "learning_hours"], "kendall"),
        with_tables("ca", _kendall_levels_sql("progress_pct", "learning_hours", "ca")),
    )
    r.add(
        "sta_6_t_test",
        lambda t: statistics.t_test(
            t.course_activity(wide=True), "learning_hours", "business_unit", "BUILDING", "MACHINERY"
        ).select(*T_COLUMNS),
        with_tables("caw", _t_sql("'BUILDING'", "'MACHINERY'", "business_unit")),
    )
    r.add(
        "sta_6_t_test_p_value",
        lambda t: statistics.t_test(
            t.course_activity(wide=True), "learning_hours", "business_unit", "BUILDING", "MACHINERY"
        ),
    )
    smallest = "(SELECT min(role) FROM caw)"
    r.add(
        "sta_7_t_test_first_two",
        lambda t: statistics.t_test_first_two(t.course_activity(wide=True), "learning_hours", "role").select(*T_COLUMNS),
        with_tables("caw", _t_sql(smallest, f"(SELECT min(role) FROM caw WHERE role > {smallest})", "role")),
    )
    anova = f"""SELECT k AS n_groups, {rnd('(b / (k - 1)) / (w / (n - k))')} AS f_statistic FROM (
            SELECT count(*) AS k, sum(n) AS n, sum(n * (m - g) * (m - g)) AS b, sum(v * (n - 1)) AS w
            FROM (SELECT location, count(*) AS n, avg(learning_hours) AS m, var_samp(learning_hours) AS v FROM caw GROUP BY 1),
                (SELECT avg(learning_hours) AS g FROM caw))"""
    r.add(
        "sta_8_anova",
        lambda t: statistics.anova(t.course_activity(wide=True), "learning_hours", "location").select("n_groups", "f_statistic"),
        with_tables("caw", anova),
    )
    r.add(
        "sta_8_anova_p_value",
        lambda t: statistics.anova(t.course_activity(wide=True), "learning_hours", "location"),
    )
    p = "value / 2000"
    stars = f"CASE WHEN {p} < 0.001 THEN '***' WHEN {p} < 0.01 THEN '**' WHEN {p} < 0.05 THEN '*' ELSE '' END"
    r.add(
        "sta_9_format_table",
        lambda t: statistics.format_table(
            t.raw("events").select("event_id", (F.col("value") / 2000).alias("p_value"), F.col("value").alias("score"))
        ),
        f"SELECT event_id, format('{{:.3f}}', {rnd(p, 3)}) || {stars} AS p_value, {rnd('value', 3)} AS score FROM events",
    )
    r.add(
        "scl_14_significance_text",
        lambda t: t.raw("events").select("event_id", significance_text(F.col("value") / 2000, 5).alias("p_text")),
        f"SELECT event_id, format('{{:.5f}}', {rnd(p, 5)}) || {stars} AS p_text FROM events",
    )


def _reports(r: Registry) -> None:
    def combined(t: Tables) -> DataFrame:
        a = t.course_activity()
        return reports.combined_report(
            {
                "distributions": statistics.distributions(a.select(*NUMBERS)).withColumn("count", F.col("count").cast("double")),
                "correlations": statistics.correlations(a, NUMBERS),
            }
        )

    parts = [c for c in ("count", "mean", "median", "std", "skew", "kurtosis", "min", "max", "q25", "q75")]
    r.add(
        "set_2_combined_report",
        combined,
        with_tables(
            "ca",
            f"""SELECT 'Distribution Analysis' AS section, feature, count::DOUBLE AS count, {', '.join(parts[1:])},
                {', '.join(f'NULL::DOUBLE AS {c}' for c in NUMBERS)} FROM ({_distribution_sql('ca', NUMBERS)})
            UNION ALL SELECT 'Correlation Analysis', feature, {', '.join('NULL' for _ in parts)}, {', '.join(NUMBERS)}
                FROM ({_pearson_sql(NUMBERS, 'ca')})""",
        ),
    )
    r.add(
        "ins_12_key_findings",
        lambda t: reports.key_findings(
            {
                "t_test_engagement": statistics.t_test_first_two(t.course_activity(wide=True), "learning_hours", "role"),
                "anova_engagement": statistics.anova(t.course_activity(wide=True), "learning_hours", "location"),
                "regression": models.regression(
                    _matrix(t), "avg_progress", "email", BEHAVIOUR, "linear"
                )["metrics"],
            }
        ),
    )


BEHAVIOUR = ["courses_enrolled", "total_hours", "avg_hours_per_course", "std_hours", "hours_per_week"]


def _matrix(t: Tables) -> DataFrame:
    return features.scored_learner_matrix(t.course_activity(), t.video_activity(), REFERENCE_DATE)


def _students(t: Tables) -> DataFrame:
    made = features.generate_features(_integrated(t), ("_order",))
    return made.withColumn("late", F.when(F.col("semester") >= "1999", 1).otherwise(0))


STUDENT_INPUTS = ["engagement_score", "session_frequency", "video_completion_pct", "forum_posts", "gpa"]
CLUSTER_INPUTS = ["hours_component", "recency_component", "std_hours"]


def _dbscan_sql(eps: float, least: int) -> str:
    """Density clusters by all pairs of learners: core points reach others through core points, and a cluster is named by its smallest core."""
    scaled = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS x{i}" for i, c in enumerate(CLUSTER_INPUTS))
    square = " + ".join(f"(p.x{i} - o.x{i}) ** 2" for i in range(len(CLUSTER_INPUTS)))
    body = """SELECT id, CAST(coalesce(c, -1) AS INT) AS cluster FROM spots LEFT JOIN (
            SELECT i, min(c) AS c FROM (SELECT i, j FROM near WHERE i NOT IN (SELECT i FROM core) UNION ALL SELECT i, i FROM core)
                JOIN named ON named.id = j GROUP BY i) ON i = id"""
    return with_tables(
        "ca eng",
        body,
        hours="SELECT email, coalesce(stddev_samp(learning_hours), 0) AS std_hours FROM ca GROUP BY email",
        spots=f"SELECT CAST(email AS BIGINT) AS id, {scaled} FROM hours JOIN eng USING (email)",
        near=f"SELECT p.id AS i, o.id AS j FROM spots p JOIN spots o ON {square} <= {eps} * {eps}",
        core=f"SELECT i FROM near GROUP BY i HAVING count(*) >= {least}",
        links="SELECT i, j FROM near WHERE i IN (SELECT i FROM core) AND j IN (SELECT i FROM core)",
        # a cluster's smallest core reaches all of it through larger ones
        reach="SELECT i AS id, i AS root FROM core UNION SELECT j, root FROM reach JOIN links ON links.i = reach.id WHERE j > root",
        named="SELECT id, dense_rank() OVER (ORDER BY min(root)) - 1 AS c FROM reach GROUP BY id",
    ).replace("WITH ", "WITH RECURSIVE ", 1)


def _models(r: Registry) -> None:
    r.add(
        "ml_1_prepared_data",
        lambda t: models.prepare(t.course_activity(), "grade", ["progress_pct", "learning_hours"], "email")[0].select(
            F.col("_key").alias("email"), "progress_pct", "learning_hours", F.col("label").alias("grade")
        ),
        with_tables(
            "ca",
            f"SELECT email, progress_pct, {rnd('learning_hours')} AS learning_hours, {rnd('grade')} AS grade FROM ca WHERE grade IS NOT NULL",
        ),
    )
    r.add(
        "ml_2_stratified_split",
        lambda t: models.split(
            models.prepare(models.completion_label(_matrix(t)), "_label", ["total_hours"], "email")[0], stratify=True
        ).groupBy("label", "_test").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("_test", "in_test"),
    )
    for kind in ("linear", "ridge", "lasso"):
        r.add(
            f"ml_3_regression_{kind}",
            lambda t, kind=kind: models.regression(_matrix(t), "avg_progress", "email", BEHAVIOUR, kind)["metrics"],
        )
    for kind in ("random_forest", "gradient_boosting"):
        r.add(
            f"ml_4_regression_{kind}",
            lambda t, kind=kind: models.regression(
                _matrix(t), "avg_progress", "email", BEHAVIOUR, kind
            )["metrics"],
        )
    for kind in ("logistic", "random_forest", "gradient_boosting"):
        r.add(
            f"ml_5_classification_{kind}",
            lambda t, kind=kind: models.classification(
                models.high_performer_label(_matrix(t)), "_label", "email", BEHAVIOUR, kind
            )["metrics"],
        )
    r.add(
        "ml_6_classification_svm",
        lambda t: models.classification(
            models.high_performer_label(_matrix(t)), "_label", "email", BEHAVIOUR, "svm"
        )["metrics"],
    )
    r.add(
        "ml_7_kmeans",
        lambda t: clusters.clustering(_matrix(t), CLUSTER_INPUTS, "email", "kmeans", 4)["centres"],
    )
    r.add(
        "ml_8_dbscan",
        lambda t: clusters.clustering(
            _matrix(t).withColumn("id", F.col("email").cast("long")), CLUSTER_INPUTS, "id", "dbscan", eps=0.25
        )["labels"],
        _dbscan_sql(0.25, 5),
    )
    r.add(
        "ml_9_hierarchical",
        lambda t: clusters.clustering(_matrix(t), CLUSTER_INPUTS, "email", "hierarchical", 4)["sizes"],
    )
    r.add(
        "ml_9_ward_merges",
        lambda t: clusters.clustering(_matrix(t), CLUSTER_INPUTS, "email", "hierarchical", 4)["merges"],
    )
    r.add(
        "ml_9_bisecting",
        lambda t: clusters.clustering(_matrix(t), CLUSTER_INPUTS, "email", "bisecting", 4)["sizes"],
    )
    r.add(
        "ml_10_silhouette",
        lambda t: clusters.clustering(_matrix(t), CLUSTER_INPUTS, "email", "kmeans", 3)["metrics"],
    )
    labels = {
        "ml_11_dropout_model": ("dropout", lambda m: models.dropout_label(m, 45.0)),
        "ml_12_completion_model": ("completion", models.completion_label),
        "ml_13_high_performer_model": ("high_performer", models.high_performer_label),
    }
    for name, (task, label) in labels.items():
        r.add(
            name,
            lambda t, task=task, label=label: models.train_and_score(
                label(_matrix(t)), task, "logistic_regression"
            )["metrics"],
        )
    r.add(
        "ml_14_train_and_score",
        lambda t: models.train_and_score(models.high_performer_label(_matrix(t)), "high_performer")[
            "top_flagged"
        ],
    )
    r.add(
        "ml_15_prediction_summary",
        lambda t: reports.prediction_summary(
            models.prediction_metrics(models.all_predictions(_matrix(t), "logistic_regression"))
        ),
    )
    r.add(
        "ml_16_all_predictions",
        lambda t: models.prediction_metrics(models.all_predictions(_matrix(t), "random_forest")),
    )
    r.add(
        "ml_17_feature_importance",
        lambda t: models.regression(_matrix(t), "avg_progress", "email", BEHAVIOUR, "random_forest")[
            "importances"
        ],
    )
    r.add(
        "ml_18_confusion_matrix",
        lambda t: models.classification(
            models.high_performer_label(_matrix(t)), "_label", "email", BEHAVIOUR, "logistic"
        )["confusion"],
    )


def register(r: Registry) -> None:
    for part in (_statistics, _reports, _models):
        part(r)
