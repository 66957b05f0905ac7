"""SQL that recomputes the registered queries from the given tables, independently of the library.

Queries with no entry here (trained classifiers and what follows from them) are not SQL.
"""

from __future__ import annotations

from steadymark.functions.corruption import LEVELS, SEVERITIES

METRICS = ("entropy", "sparsity", "deletion_score", "insertion_score")


def r(expression: str, digits: int = 6) -> str:
    """Rounded, without a negative zero."""
    return f"(round({expression}, {digits}) + 0.0)"


def cte(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def short(metric: str) -> str:
    return metric.removesuffix("_score")


# ---------------------------------------------------------------- the fact

SILVER = """silver AS (
  SELECT l_orderkey AS image_path, l_returnflag AS adapter_rank,
         round(avg(l_quantity), 6) AS entropy, round(avg(l_discount), 6) AS sparsity,
         round(avg(l_tax), 6) AS deletion_score, round(avg(l_extendedprice), 6) AS insertion_score
  FROM lineitem GROUP BY 1, 2)"""
OOD = """ood AS (
  SELECT l_orderkey AS image_path, l_returnflag AS adapter_rank, l_linestatus AS corruption_type,
         CASE WHEN l_quantity <= 17 THEN 'shallow' WHEN l_quantity <= 34 THEN 'medium' ELSE 'heavy' END AS corruption_level,
         CASE WHEN l_tax <= 0.04 THEN 1 ELSE 0 END AS is_correct,
         concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_key
  FROM lineitem)"""
JOINED = "joined AS (SELECT * FROM ood JOIN silver USING (image_path, adapter_rank))"
DEGRADED = """accuracy AS (
  SELECT adapter_rank, corruption_type, corruption_level, avg(is_correct) AS accuracy FROM joined GROUP BY ALL),
pivoted AS (
  SELECT adapter_rank, corruption_type,
         max(accuracy) FILTER (corruption_level = 'shallow') AS shallow,
         max(accuracy) FILTER (corruption_level = 'medium') AS medium,
         max(accuracy) FILTER (corruption_level = 'heavy') AS heavy
  FROM accuracy GROUP BY ALL),
degraded AS (
  SELECT *, shallow - heavy AS drop_shallow_heavy, (shallow - heavy) / nullif(shallow, 0) * 100 AS drop_pct,
         shallow - medium AS drop_shallow_medium, medium - heavy AS drop_medium_heavy
  FROM pivoted)"""
SUMMARY = """summary AS (
  SELECT adapter_rank, avg(is_correct) AS accuracy, avg(entropy) AS mean_entropy, avg(sparsity) AS mean_sparsity,
         avg(deletion_score) AS mean_deletion, avg(insertion_score) AS mean_insertion,
         stddev_samp(entropy) AS std_entropy, count(*) AS n_samples
  FROM joined GROUP BY 1)"""
FACT = cte(SILVER, OOD, JOINED)
FACT_DEGRADED = cte(SILVER, OOD, JOINED, DEGRADED)
FACT_SUMMARY = cte(SILVER, OOD, JOINED, SUMMARY)

STATS = (
    "s AS ("
    + " UNION ALL ".join(
        f"""SELECT '{m}' AS feature, corr({m}, is_correct) AS pearson_r,
  avg({m}) FILTER (is_correct = 1) AS m1, avg({m}) FILTER (is_correct = 0) AS m0,
  stddev_pop({m}) FILTER (is_correct = 1) AS s1, stddev_pop({m}) FILTER (is_correct = 0) AS s0,
  count(*) FILTER (is_correct = 1) AS n1, count(*) FILTER (is_correct = 0) AS n0 FROM joined"""
        for m in METRICS
    )
    + """),
effects AS (
  SELECT *, sqrt(((n1 - 1) * s1 * s1 + (n0 - 1) * s0 * s0) / greatest(n1 + n0 - 2, 1)) AS pooled,
         abs(m1 - m0) / (s1 + s0 + 1e-8) AS separation_ratio FROM s),
sized AS (SELECT *, CASE WHEN pooled > 0 THEN (m1 - m0) / pooled ELSE 0 END AS cohens_d FROM effects)"""
)
RANKS = (
    "ranks AS ("
    + " UNION ALL ".join(
        f"""SELECT '{m}' AS feature, is_correct,
  rank() OVER (ORDER BY {m}) + (count(*) OVER (PARTITION BY {m}) - 1) / 2.0 AS rx,
  rank() OVER (ORDER BY is_correct) + (count(*) OVER (PARTITION BY is_correct) - 1) / 2.0 AS ry FROM joined"""
        for m in METRICS
    )
    + "),\nrho AS (SELECT feature, corr(rx, ry) AS spearman_r, count(*) AS n FROM ranks GROUP BY 1)"
)
# Student's t tail by Simpson's rule on 20,000 intervals between 0 and |t| (nothing is left beyond 40).
P_VALUES = """coefficients AS (
  SELECT feature, 'pearson_p' AS kind, pearson_r AS rr, n1 + n0 - 2.0 AS nu FROM sized
  UNION ALL SELECT feature, 'spearman_p', spearman_r, n - 2.0 FROM rho),
bounds AS (SELECT *, least(abs(rr) * sqrt(nu / (1 - rr * rr)), 40.0) AS t FROM coefficients),
grid AS (SELECT *, unnest(range(0, 20001)) AS g FROM bounds),
density AS (
  SELECT feature, kind, t,
         CASE WHEN g = 0 OR g = 20000 THEN 1 WHEN g % 2 = 1 THEN 4 ELSE 2 END
           * exp(lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5 * ln(nu * pi())
                 - (nu + 1) / 2 * ln(1 + (t * g / 20000) * (t * g / 20000) / nu)) AS f
  FROM grid),
tails AS (SELECT feature, kind, 1 - 2 * sum(f) * any_value(t) / 60000 AS p FROM density GROUP BY 1, 2)"""

# ---------------------------------------------------------------- the vectors

PIXELS = """px AS (
  SELECT vec_id, label, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"""
CENTRES = "centres AS (SELECT label AS k, i, avg(v) AS c FROM px GROUP BY 1, 2)"
MODELS = """adapters AS (SELECT unnest([4, 16, 32]) AS a),
weights AS (SELECT a, k, i, sum(c) OVER (PARTITION BY a, k, i % a) AS c FROM centres, adapters),
biases AS (SELECT a, k, -0.5 * sum(c * c) AS b FROM weights WHERE i < a GROUP BY 1, 2)"""
SEEN = """seen AS (
  SELECT vec_id, label, a, i, v, abs(v) / (sum(abs(v)) OVER image + 1e-10) AS h, avg(v) OVER image AS fill, count(*) OVER image AS patches
  FROM px, adapters WINDOW image AS (PARTITION BY vec_id, a))"""
CLEAN = """clean_logits AS (
  SELECT vec_id, label, a, k, sum(v * c) + any_value(b) AS z
  FROM seen JOIN weights USING (a, i) JOIN biases USING (a, k) GROUP BY 1, 2, 3, 4),
clean AS (
  SELECT vec_id, label, a, arg_min(k, (-z, k)) AS predicted,
         1 / sum(exp(z - top)) AS confidence
  FROM (SELECT *, max(z) OVER (PARTITION BY vec_id, a) AS top FROM clean_logits) GROUP BY 1, 2, 3)"""
CURVES = """placed AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id, a ORDER BY h DESC, i) - 1 AS place, greatest(1, patches // 10) AS size FROM seen),
masks AS (
  SELECT *, unnest(range(0, (patches + size - 1) // size + 1)) AS step FROM placed),
mask_logits AS (
  SELECT vec_id, a, step, k,
         sum(c * CASE WHEN place < step * size THEN fill ELSE v END) + any_value(b) AS del,
         sum(c * CASE WHEN place < step * size THEN v ELSE 0 END) + any_value(b) AS ins
  FROM masks JOIN weights USING (a, i) JOIN biases USING (a, k) GROUP BY 1, 2, 3, 4),
mask_scores AS (
  SELECT l.vec_id, l.a, step,
         max(exp(del - dtop)) FILTER (k = predicted) / sum(exp(del - dtop)) AS del,
         max(exp(ins - itop)) FILTER (k = predicted) / sum(exp(ins - itop)) AS ins
  FROM (SELECT *, max(del) OVER one AS dtop, max(ins) OVER one AS itop
        FROM mask_logits WINDOW one AS (PARTITION BY vec_id, a, step)) l
  JOIN clean p ON p.vec_id = l.vec_id AND p.a = l.a GROUP BY 1, 2, 3),
curves AS (
  SELECT vec_id, a,
         (sum(del) - (arg_min(del, step) + arg_max(del, step)) / 2) / (count(*) - 1)
           / greatest(arg_min(del, step), 1e-10) AS deletion_score,
         (sum(ins) - (arg_min(ins, step) + arg_max(ins, step)) / 2) / (count(*) - 1) AS insertion_score
  FROM mask_scores GROUP BY 1, 2)"""
MAPS = """maps AS (
  SELECT vec_id, a, -sum((h + 1e-10) * log2(h + 1e-10)) / log2(any_value(patches)) AS entropy,
         1 - 2.0 / any_value(patches) * sum((patches - place + 0.5) * h / (whole + 1e-10)) AS sparsity
  FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, a ORDER BY h) AS place,
               sum(h) OVER (PARTITION BY vec_id, a) AS whole FROM seen) GROUP BY 1, 2)"""
SILVER_M1 = """silver AS (
  SELECT vec_id AS image_path, a AS adapter_rank, entropy, sparsity, deletion_score, insertion_score, confidence,
         predicted::VARCHAR AS predicted_class, label::VARCHAR AS true_label
  FROM maps JOIN curves USING (vec_id, a) JOIN clean USING (vec_id, a))"""


def levels(kind: str) -> str:
    return ", ".join(f"('{level}', {SEVERITIES[kind][level]})" for level in LEVELS)


CONTRAST = f"""contrast AS (
  SELECT vec_id, label, 'contrast' AS kind, level, i, (v - mu) * p + mu AS v
  FROM (SELECT *, avg(v) OVER (PARTITION BY vec_id) AS mu FROM px), (VALUES {levels("contrast")}) s(level, p))"""
NOISE = f"""words AS (
  SELECT vec_id, label, level, p, i, v, sd, md5(concat_ws('|', vec_id, 'gaussian_noise', level, i)) AS d
  FROM (SELECT *, stddev_pop(v) OVER (PARTITION BY vec_id) AS sd FROM px), (VALUES {levels("gaussian_noise")}) s(level, p)),
noise AS (
  SELECT vec_id, label, 'gaussian_noise' AS kind, level, i,
         v + p * sd / 25 * sqrt(-2 * ln((concat('0x', d[1:8])::BIGINT + 0.5) / 4294967296.0))
           * cos(2 * pi() * concat('0x', d[9:16])::BIGINT / 4294967296.0) AS v
  FROM words)"""
BLUR = f"""taps AS (
  SELECT level, d, exp(-d * d / (2 * p * p)) / sum(exp(-d * d / (2 * p * p))) OVER (PARTITION BY level) AS w
  FROM (SELECT level, p, unnest(range(-3 * p::INT, 3 * p::INT + 1)) AS d FROM (VALUES {levels("blur")}) s(level, p))),
near AS (
  SELECT level, spot, least(7, greatest(0, spot + d)) AS source, sum(w) AS w
  FROM taps, (SELECT unnest(range(0, 8)) AS spot) GROUP BY 1, 2, 3),
down AS (
  SELECT vec_id, label, level, spot AS y, i % 8 AS x, sum(w * v) AS v FROM px JOIN near ON i // 8 = source GROUP BY ALL),
blur AS (
  SELECT vec_id, label, 'blur' AS kind, n.level, y * 8 + n.spot AS i, sum(w * v) AS v
  FROM down d JOIN near n ON d.level = n.level AND d.x = n.source GROUP BY ALL)"""


def _boxes() -> str:
    """The edge weight of a box with the variance of a third of the kernel, and three passes along each axis."""
    parts = [f"""box AS (
  SELECT level, s, floor((sqrt(12 * s + 1) - 1) / 2)::INT AS l FROM (SELECT level, p * p / 3 AS s FROM (VALUES {levels("blur")}) t(level, p))),
edges AS (SELECT level, l, (2 * l + 1) * (l * (l + 1) - 3 * s) / (6 * (s - (l + 1) * (l + 1))) AS a FROM box),
taps AS (
  SELECT level, d, CASE WHEN abs(d) > l THEN a ELSE 1 END / (2 * l + 1 + 2 * a) AS w FROM (SELECT *, unnest(range(-l - 1, l + 2)) AS d FROM edges)),
near AS (
  SELECT level, spot, least(7, greatest(0, spot + d)) AS source, sum(w) AS w
  FROM taps, (SELECT unnest(range(0, 8)) AS spot) GROUP BY 1, 2, 3),
pass_0 AS (SELECT vec_id, label, level, i // 8 AS y, i % 8 AS x, v FROM px, box)"""]
    for number, (axis, other) in enumerate([("x", "y")] * 3 + [("y", "x")] * 3):
        parts.append(f"""pass_{number + 1} AS (
  SELECT vec_id, label, p.level, {other}, spot AS {axis}, sum(w * v) AS v
  FROM pass_{number} p JOIN near n ON p.level = n.level AND p.{axis} = n.source GROUP BY vec_id, label, p.level, {other}, spot)""")
    return ",\n".join([*parts, "box_blur AS (SELECT vec_id, label, 'blur' AS kind, level, y * 8 + x AS i, v FROM pass_6)"])


OOD_M1 = """corrupted AS (FROM contrast UNION ALL BY NAME FROM noise UNION ALL BY NAME FROM blur),
ood_logits AS (
  SELECT vec_id, label, kind, level, a, k, sum(v * c) + any_value(b) AS z
  FROM corrupted JOIN weights USING (i) JOIN biases USING (a, k) GROUP BY ALL),
ood AS (
  SELECT vec_id AS image_path, kind AS corruption_type, level AS corruption_level, a AS adapter_rank,
         arg_min(k, (-z, k))::VARCHAR AS predicted_class, label::VARCHAR AS true_label,
         CASE WHEN arg_min(k, (-z, k)) = label THEN 1 ELSE 0 END AS is_correct
  FROM ood_logits GROUP BY vec_id, label, kind, level, a)"""
M1 = (PIXELS, CENTRES, MODELS, SEEN)


def corrupted(body: str, name: str) -> str:
    return cte(PIXELS, body) + (
        f"SELECT vec_id AS image_path, level AS corruption_level, i::BIGINT AS i, {r('v')} AS value FROM {name}"
    )


def stat_columns(digits: int) -> str:
    means = ", ".join(f"{r(f'avg({m})', digits)} AS mean_{short(m)}" for m in METRICS)
    deviations = ", ".join(f"{r(f'stddev_samp({m})', digits)} AS std_{short(m)}" for m in METRICS)
    return f"{means}, {deviations}"


def base_stats_select(digits: int) -> str:
    return f"""SELECT adapter_rank, corruption_type, corruption_level, {stat_columns(digits)},
  {r('avg(is_correct)', digits)} AS accuracy, sum(is_correct)::BIGINT AS correct_count, count(*) AS total_count,
  {r('var_samp(entropy)', digits)} AS var_entropy, {r('1 - avg(is_correct)', digits)} AS error_rate
FROM joined GROUP BY 1, 2, 3"""


def class_scores(score: str) -> str:
    """Running counts per distinct score, per return flag."""
    return f"""WITH rows AS (
  SELECT l_returnflag, {score} AS score, CASE WHEN l_tax <= 0.04 THEN 1 ELSE 0 END AS y FROM lineitem)"""


def _profile() -> str:
    columns = []
    for name, call in (
        ("mean", "avg({})"), ("std", "stddev_samp({})"), ("min", "min({})"), ("max", "max({})"),
        ("median", "quantile_disc({}, 0.5)"), ("q25", "quantile_disc({}, 0.25)"), ("q75", "quantile_disc({}, 0.75)"),
    ):
        columns += [f"{r(call.format(m), 5)} AS {name}_{m}" for m in METRICS]
    return FACT + "SELECT " + ", ".join(columns) + " FROM joined"


def _separation() -> str:
    columns = []
    for name, side in (("correct", 1), ("wrong", 0)):
        for m in METRICS:
            columns.append(f"{r(f'avg({m}) FILTER (is_correct = {side})', 4)} AS {m}_{name}_mean")
            columns.append(f"{r(f'stddev_samp({m}) FILTER (is_correct = {side})', 4)} AS {m}_{name}_std")
    return FACT + "SELECT " + ", ".join(columns) + " FROM joined"


def all_sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    sql["workload_cross"] = (
        "SELECT vec_id AS image_path, a::BIGINT AS adapter_rank "
        "FROM (SELECT DISTINCT vec_id FROM embeddings), (VALUES (4), (16), (32)) t(a)"
    )
    severities = ", ".join(f"('{k}', '{lv}', {v})" for k, by in SEVERITIES.items() for lv, v in by.items())
    sql["workload_ood"] = (
        "SELECT vec_id AS image_path, label::BIGINT AS true_label, kind AS corruption_type, level AS corruption_level, "
        f"p::DOUBLE AS severity, a::BIGINT AS adapter_rank FROM embeddings, (VALUES {severities}) c(kind, level, p), "
        "(VALUES (4), (16), (32)) t(a)"
    )
    sql["severity_order"] = cte(OOD) + (
        "SELECT corruption_level, CASE corruption_level WHEN 'shallow' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END::BIGINT "
        "AS level_order, count(*) AS rows FROM ood GROUP BY 1, 2"
    )
    dictionary = "dict AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS idx FROM (SELECT DISTINCT lang FROM documents))"
    sql["label_dictionary"] = cte(dictionary) + "SELECT lang AS label, idx::BIGINT AS label_index FROM dict"
    sql["label_decode"] = cte(
        dictionary,
        "docs AS (SELECT doc_id, lang, regexp_extract(source, '([0-9]+)$', 1)::INT AS p FROM documents)",
    ) + (
        "SELECT doc_id, docs.lang, p::BIGINT AS predicted_index, coalesce(d.lang, p::VARCHAR) AS predicted_class, "
        "CASE WHEN t.idx = p THEN 1 ELSE 0 END::BIGINT AS is_correct "
        "FROM docs LEFT JOIN dict d ON d.idx = p LEFT JOIN dict t ON t.lang = docs.lang"
    )
    sql["path_label"] = "SELECT page_id, string_split(url, '/')[-2] AS label FROM pages"
    sql["struct_expand"] = "SELECT page_id, string_split(url, '/')[-2] AS true_label FROM pages"
    sql["key_rewrite"] = (
        "SELECT page_id, replace(url, 'http://', 'file:/staged/') AS literal_key, "
        "regexp_replace(url, '^https?://[^/]+', '/staged', 'g') AS pattern_key FROM pages"
    )

    metric_columns = ", ".join(f"{r(m)} AS {m}" for m in METRICS)
    sql["joined_fact"] = FACT + (
        "SELECT image_path, adapter_rank, corruption_type, corruption_level, is_correct::BIGINT AS is_correct, row_key, "
        f"{metric_columns} FROM joined"
    )
    sql["joined_count"] = FACT + "SELECT count(*) AS rows FROM joined"
    sql["unmatched_counts"] = """SELECT 'explanations' AS side, count(*) AS unmatched_rows
FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'outcomes', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)"""
    sql["base_stats"] = FACT + base_stats_select(4)
    drops = ("shallow", "medium", "heavy", "drop_shallow_heavy", "drop_pct", "drop_shallow_medium", "drop_medium_heavy")
    sql["degradation"] = FACT_DEGRADED + (
        "SELECT adapter_rank, corruption_type, " + ", ".join(f"{r(c)} AS {c}" for c in drops) + " FROM degraded"
    )
    sql["global_profile"] = _profile()
    sql["adapter_summary"] = FACT_SUMMARY + (
        "SELECT adapter_rank, "
        + ", ".join(
            f"{r(c, 4)} AS {c}"
            for c in ("accuracy", "mean_entropy", "mean_sparsity", "mean_deletion", "mean_insertion", "std_entropy")
        )
        + ", n_samples FROM summary"
    )
    means = ", ".join(f"{r(f'avg({m})', 4)} AS mean_{short(m)}" for m in METRICS)
    sql["by_corruption"] = FACT + (
        f"SELECT corruption_type, corruption_level, {means}, {r('avg(is_correct)', 4)} AS accuracy, "
        "count(*) AS n_samples FROM joined GROUP BY 1, 2"
    )
    sql["feature_separation"] = _separation()
    sql["worst_cases"] = FACT_DEGRADED + (
        f"SELECT adapter_rank, corruption_type, corruption_level, {r('accuracy')} AS accuracy "
        "FROM accuracy WHERE accuracy < 0.56"
    )
    sql["impact_rank"] = FACT + f"""SELECT adapter_rank, corruption_type, {r('a')} AS accuracy,
  row_number() OVER (PARTITION BY adapter_rank ORDER BY a, corruption_type) AS impact_rank
FROM (SELECT adapter_rank, corruption_type, avg(is_correct) AS a FROM joined GROUP BY 1, 2)"""
    sql["mean_drop_by_type"] = FACT_DEGRADED + (
        f"SELECT corruption_type, {r('avg(drop_pct)')} AS mean_drop_pct FROM degraded GROUP BY 1"
    )
    sql["drop_summary"] = FACT_DEGRADED + f"""SELECT {r('max(drop_pct)')} AS max_drop_pct, {r('min(drop_pct)')} AS min_drop_pct,
  {r('avg(drop_pct)')} AS mean_drop_pct, first(adapter_rank ORDER BY drop_pct DESC, adapter_rank, corruption_type) AS worst_adapter,
  first(corruption_type ORDER BY drop_pct DESC, adapter_rank, corruption_type) AS worst_type FROM degraded"""
    sql["drop_matrix"] = FACT_DEGRADED + (
        "SELECT corruption_type, "
        + ", ".join(f"{r(f'max(drop_pct) FILTER (adapter_rank = {a!r})')} AS drop_{a}" for a in ("A", "N", "R"))
        + " FROM degraded GROUP BY 1"
    )
    sql["best_worst_gap"] = FACT_SUMMARY + f"""SELECT first(adapter_rank ORDER BY accuracy DESC, adapter_rank) AS best_adapter,
  {r('max(accuracy)')} AS best_accuracy, first(adapter_rank ORDER BY accuracy, adapter_rank) AS worst_adapter,
  {r('min(accuracy)')} AS worst_accuracy, {r('(max(accuracy) - min(accuracy)) * 100')} AS gap_points FROM summary"""
    sql["worst_corruption"] = FACT_DEGRADED + f"""SELECT adapter_rank, corruption_type AS worst_corruption, {r('drop_pct')} AS max_drop_pct
FROM degraded QUALIFY row_number() OVER (PARTITION BY adapter_rank ORDER BY drop_pct DESC, corruption_type) = 1"""
    sql["adapter_ranking"] = FACT_SUMMARY + f"""SELECT adapter_rank, {r('accuracy', 5)} AS accuracy, {r('mean_entropy', 5)} AS mean_entropy,
  {r('mean_sparsity', 5)} AS mean_sparsity, row_number() OVER (ORDER BY accuracy DESC, adapter_rank) AS rank FROM summary"""
    sql["quantitative_summary"] = cte(SILVER, OOD, JOINED, DEGRADED) + """SELECT 'Adapters tested' AS metric, count(DISTINCT adapter_rank)::VARCHAR AS value FROM joined
UNION ALL SELECT 'Corruption types', count(DISTINCT corruption_type)::VARCHAR FROM degraded
UNION ALL SELECT 'Max accuracy drop (%)', format('{:.2f}', max(drop_pct)) FROM degraded
UNION ALL SELECT 'Avg accuracy drop (%)', format('{:.2f}', avg(drop_pct)) FROM degraded"""

    sql["correlations"] = cte(SILVER, OOD, JOINED, STATS) + f"""SELECT feature, {r('pearson_r', 5)} AS pearson_r,
  {r('pearson_r', 5)} AS point_biserial_r, {r('cohens_d', 5)} AS cohens_d, {r('separation_ratio', 5)} AS separation_ratio,
  {r('m1', 5)} AS mean_correct, {r('m0', 5)} AS mean_wrong, {r('s1', 5)} AS std_correct, {r('s0', 5)} AS std_wrong,
  (n1 + n0)::BIGINT AS n FROM sized"""
    sql["spearman"] = cte(SILVER, OOD, JOINED, RANKS) + f"SELECT feature, {r('spearman_r')} AS spearman_r, n FROM rho"
    sql["p_values"] = cte(SILVER, OOD, JOINED, STATS, RANKS, P_VALUES) + f"""SELECT feature,
  {r("max(p) FILTER (kind = 'pearson_p')", 5)} AS pearson_p, {r("max(p) FILTER (kind = 'spearman_p')", 5)} AS spearman_p
FROM tails GROUP BY 1"""
    sql["association_summary"] = cte(SILVER, OOD, JOINED, STATS) + f"""SELECT
  first(feature ORDER BY abs(cohens_d) DESC, feature) AS best_feature, {r('max(abs(pearson_r))')} AS largest_r,
  {r('max(abs(cohens_d))')} AS largest_d FROM sized"""

    sql["attention_heatmap"] = cte(PIXELS, """heads AS (
  SELECT vec_id, i % 16 AS p, avg(abs(v)) AS w FROM px GROUP BY 1, 2)""") + f"""SELECT vec_id AS image_path, (p - 1)::BIGINT AS patch,
  {r('w / (sum(w) OVER (PARTITION BY vec_id) + 1e-10)')} AS weight FROM heads WHERE p > 0"""
    keyed = "vec_id AS image_path, a::BIGINT AS adapter_rank"
    sql["attention_entropy"] = cte(*M1, MAPS) + f"SELECT {keyed}, {r('entropy')} AS entropy FROM maps"
    sql["gini_sparsity"] = cte(*M1, MAPS) + f"SELECT {keyed}, {r('sparsity')} AS sparsity FROM maps"
    sql["corrupt_contrast"] = corrupted(CONTRAST, "contrast")
    sql["corrupt_noise"] = corrupted(NOISE, "noise")
    sql["corrupt_blur"] = corrupted(BLUR, "blur")
    sql["corrupt_box_blur"] = corrupted(_boxes(), "box_blur")

    predictions = f"SELECT {keyed}, predicted::VARCHAR AS predicted_class, (predicted = label)::INT::BIGINT AS is_correct FROM clean"
    sql["clean_predictions"] = cte(*M1, CLEAN) + predictions
    sql["batch_score_python"] = sql["clean_predictions"]
    everything = (*M1, CLEAN, CONTRAST, NOISE, BLUR, OOD_M1)
    sql["ood_outcomes"] = cte(*everything) + (
        "SELECT image_path, corruption_type, corruption_level, adapter_rank::BIGINT AS adapter_rank, predicted_class, "
        "true_label, is_correct::BIGINT AS is_correct FROM ood"
    )
    sql["generalisation_gap"] = cte(*everything) + f"""SELECT adapter_rank::BIGINT AS adapter_rank, {r('clean_accuracy')} AS clean_accuracy,
  {r('corrupted_accuracy')} AS corrupted_accuracy, {r('(clean_accuracy - corrupted_accuracy) * 100')} AS gap_points
FROM (SELECT a AS adapter_rank, avg((predicted = label)::INT) AS clean_accuracy FROM clean GROUP BY 1)
JOIN (SELECT adapter_rank, avg(is_correct) AS corrupted_accuracy FROM ood GROUP BY 1) USING (adapter_rank)"""
    sql["ood_outcomes_python"] = sql["ood_outcomes"]
    sql["bronze_embeddings"] = f"""WITH cells AS (
  SELECT vec_id, unnest(range(0, 64)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT vec_id::VARCHAR AS image_path, (j % 16)::BIGINT AS i, {r('avg(v)::FLOAT::DOUBLE')} AS value, 4::BIGINT AS patches FROM cells GROUP BY 1, 2"""
    whole = [part.replace("unnest([4, 16, 32])", "unnest([64])") for part in (*M1, CLEAN, CURVES, MAPS, SILVER_M1)]
    sql["silver_python"] = cte(*whole) + (
        "SELECT image_path, adapter_rank::BIGINT AS adapter_rank, "
        + ", ".join(f"{r(c)} AS {c}" for c in METRICS)
        + ", predicted_class, true_label FROM silver"
    )
    sql["deletion_score"] = cte(*M1, CLEAN, CURVES) + f"SELECT {keyed}, {r('deletion_score')} AS deletion_score FROM curves"
    sql["insertion_score"] = cte(*M1, CLEAN, CURVES) + f"SELECT {keyed}, {r('insertion_score')} AS insertion_score FROM curves"
    sql["batch_explain_python"] = cte(*M1, CLEAN, CURVES) + (
        f"SELECT {keyed}, {r('deletion_score')} AS deletion_score, {r('insertion_score')} AS insertion_score FROM curves"
    )
    sql["silver_metrics"] = cte(*M1, CLEAN, CURVES, MAPS, SILVER_M1) + (
        "SELECT image_path, adapter_rank::BIGINT AS adapter_rank, "
        + ", ".join(f"{r(c)} AS {c}" for c in (*METRICS, "confidence"))
        + ", predicted_class, true_label FROM silver"
    )
    sql["robustness_end_to_end"] = cte(
        *everything, CURVES, MAPS, SILVER_M1,
        "joined AS (SELECT ood.*, entropy, sparsity, deletion_score, insertion_score "
        "FROM ood JOIN silver USING (image_path, adapter_rank))",
    ) + base_stats_select(6).replace("SELECT adapter_rank,", "SELECT adapter_rank::BIGINT AS adapter_rank,", 1)
    sql["patch_curves"] = cte(
        PIXELS, CENTRES,
        "biases AS (SELECT k, -0.5 * sum(c * c) AS b FROM centres GROUP BY 1)",
        """logits AS (SELECT vec_id, k, sum(v * c) + any_value(b) AS z FROM px JOIN centres USING (i) JOIN biases USING (k) GROUP BY 1, 2)""",
        "target AS (SELECT vec_id, arg_min(k, (-z, k)) AS t FROM logits GROUP BY 1)",
        "cells AS (SELECT *, i // 8 // 2 * 4 + i % 8 // 2 AS p, avg(v) OVER (PARTITION BY vec_id) AS fill FROM px)",
        "patches AS (SELECT vec_id, p, sum(abs(v)) AS h FROM cells GROUP BY 1, 2)",
        "ordered AS (SELECT vec_id, p, row_number() OVER (PARTITION BY vec_id ORDER BY h DESC, p) - 1 AS place FROM patches)",
        "masks AS (SELECT vec_id, i, v, fill, place, unnest(range(0, 17)) AS step FROM cells JOIN ordered USING (vec_id, p))",
        """mask_logits AS (SELECT vec_id, step, k,
    sum(c * CASE WHEN place < step THEN fill ELSE v END) + any_value(b) AS del,
    sum(c * CASE WHEN place < step THEN v ELSE 0 END) + any_value(b) AS ins
  FROM masks JOIN centres USING (i) JOIN biases USING (k) GROUP BY 1, 2, 3)""",
        """scores AS (SELECT vec_id, step, max(exp(del)) FILTER (k = t) / sum(exp(del)) AS del,
    max(exp(ins)) FILTER (k = t) / sum(exp(ins)) AS ins FROM mask_logits JOIN target USING (vec_id) GROUP BY 1, 2)""",
    ) + f"""SELECT vec_id AS image_path,
  {r('(sum(del) - (arg_min(del, step) + arg_max(del, step)) / 2) / 16 / greatest(arg_min(del, step), 1e-10)')} AS deletion_score,
  {r('(sum(ins) - (arg_min(ins, step) + arg_max(ins, step)) / 2) / 16')} AS insertion_score FROM scores GROUP BY 1"""

    sql["standardised"] = FACT + "SELECT row_key, " + ", ".join(
        f"{r(f'({m} - avg({m}) OVER ()) / (stddev_pop({m}) OVER ())', 4)} AS {m}_z" for m in METRICS
    ) + " FROM joined"
    place = (
        "placed AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(concat_ws('|', doc_id, '42')), doc_id)"
        " AS position, count(*) OVER (PARTITION BY quality) AS n FROM labels)"
    )
    sql["stratified_split"] = cte(place) + (
        "SELECT doc_id, quality::BIGINT AS quality, (position <= ceil(0.2 * n))::INT::BIGINT AS is_test FROM placed"
    )
    sql["stratified_folds"] = cte(place) + (
        "SELECT doc_id, quality::BIGINT AS quality, ((position - 1) % 5)::BIGINT AS fold FROM placed"
    )
    share = lambda kind: r(f"avg((event_type = '{kind}')::INT)")
    sql["training_table"] = f"""WITH runs AS (SELECT CASE user_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 16 ELSE 32 END AS rank, * FROM events)
SELECT rank::BIGINT AS "Rank", (2 * rank)::BIGINT AS "Alpha", CASE rank WHEN 4 THEN '702K' WHEN 16 THEN '2.25M' ELSE '4.31M' END AS "Trainable Params",
  CASE rank WHEN 4 THEN 0.80 WHEN 16 THEN 2.53 ELSE 4.75 END::DOUBLE AS "Trainable (%)", {r('avg(value)')} AS "Train Loss", {r('max(value)')} AS "Eval Loss",
  {share('click')} AS "Accuracy", {share('signup')} AS "F1 Score", {share('view')} AS "Precision", {share('purchase')} AS "Recall",
  count(*)::DOUBLE AS "Duration (min)" FROM runs GROUP BY rank"""
    sql["partition_overwrite"] = """SELECT l_returnflag AS adapter_rank, l_linestatus AS corruption_type, count(*) AS rows,
  sum(CASE WHEN l_returnflag = 'R' THEN (l_tax > 0.04)::INT ELSE (l_tax <= 0.04)::INT END)::BIGINT AS correct FROM lineitem GROUP BY 1, 2"""
    sql["table_set"] = f"SELECT event_type, count(*) AS rows, {r('max(value)')} AS largest FROM events WHERE value >= 0 GROUP BY 1"
    strata = "PARTITION BY floor(log2(n)), floor(10 * hits / n)"
    sql["grouped_folds"] = f"""WITH orders AS (
  SELECT l_orderkey, count(*) AS n, sum((l_tax <= 0.04)::INT) AS hits FROM lineitem GROUP BY 1)
SELECT l_orderkey AS image_path, n AS rows,
  floor(5 * (row_number() OVER ({strata} ORDER BY md5(concat_ws('|', l_orderkey, '42'))) - 0.5) / count(*) OVER ({strata}))::BIGINT AS fold
FROM orders"""
    sql["class_weights"] = f"""WITH c AS (SELECT quality, count(*) AS rows FROM labels GROUP BY 1)
SELECT quality::BIGINT AS quality, rows, {r('rows / (SELECT sum(rows) FROM c)')} AS share,
  {r('(SELECT sum(rows) FROM c) / ((SELECT count(*) FROM c) * rows)')} AS balanced_weight,
  {r('(SELECT sum(rows) FROM c WHERE quality = 0) / (SELECT sum(rows) FROM c WHERE quality = 1)')} AS negatives_per_positive FROM c"""
    sql["confusion"] = f"""WITH m AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp,
  count(*) FILTER (quality <> 1 AND toxic <> 1) AS tn, count(*) FILTER (quality <> 1 AND toxic = 1) AS fp,
  count(*) FILTER (quality = 1 AND toxic <> 1) AS fn FROM labels)
SELECT tp, tn, fp, fn, {r('coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0)')} AS accuracy,
  {r('coalesce(tp / nullif(tp + fp, 0), 0)')} AS precision, {r('coalesce(tp / nullif(tp + fn, 0), 0)')} AS recall,
  {r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS f1, {r('coalesce(tn / nullif(tn + fp, 0), 0)')} AS specificity FROM m"""
    sql["weighted_prf"] = cte(
        *M1, CLEAN,
        "classes AS (SELECT a, k FROM (SELECT DISTINCT a, label AS k FROM clean UNION SELECT DISTINCT a, predicted FROM clean))",
        """per AS (SELECT classes.a, k, count(*) FILTER (label = k) AS support, count(*) FILTER (predicted = k) AS chosen,
    count(*) FILTER (label = k AND predicted = k) AS hits FROM classes JOIN clean ON clean.a = classes.a GROUP BY 1, 2)""",
    ) + f"""SELECT a::BIGINT AS adapter_rank, {r('sum(hits) / sum(support)')} AS accuracy,
  {r('sum(support * coalesce(hits / nullif(chosen, 0), 0)) / sum(support)')} AS precision,
  {r('sum(support * coalesce(hits / nullif(support, 0), 0)) / sum(support)')} AS recall,
  {r('sum(support * coalesce(2 * hits / nullif(support + chosen, 0), 0)) / sum(support)')} AS f1 FROM per GROUP BY 1"""
    scored = class_scores("l_quantity / 50")
    sql["roc_auc"] = scored + f"""SELECT l_returnflag,
  {r('(sum(y * rk) - sum(y)::DOUBLE * (sum(y) + 1) / 2) / (sum(y)::DOUBLE * (count(*) - sum(y)))')} AS roc_auc
FROM (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY score)
        + (count(*) OVER (PARTITION BY l_returnflag, score) - 1) / 2.0 AS rk FROM rows) GROUP BY 1"""
    sql["average_precision"] = scored + f""", per AS (SELECT l_returnflag, score, count(*) AS n, sum(y) AS y FROM rows GROUP BY 1, 2),
running AS (SELECT *, sum(n) OVER down AS n_above, sum(y) OVER down AS y_above FROM per
  WINDOW down AS (PARTITION BY l_returnflag ORDER BY score DESC))
SELECT l_returnflag, {r('sum(y::DOUBLE * y_above / n_above) / sum(y)')} AS avg_precision FROM running GROUP BY 1"""
    sql["brier"] = scored + f"SELECT l_returnflag, {r('avg((score - y) * (score - y))')} AS brier FROM rows GROUP BY 1"
    sql["permuted_column"] = cte(SILVER, OOD, JOINED, """placed AS (
  SELECT row_key, entropy, row_number() OVER (ORDER BY md5(concat_ws('|', row_key, '42')), row_key) - 1 AS place FROM joined),
digests AS (SELECT rep, md5(concat('42|entropy|', rep)) AS d, (SELECT count(*) FROM placed) AS n FROM (VALUES (1), (2)) t(rep)),
starts AS (SELECT *, 524288 + concat('0x', d[1:8])::BIGINT % 524288 AS low, concat('0x', d[9:16])::BIGINT % n AS b FROM digests),
maps AS (SELECT rep, n, b, min(low + step) AS a FROM starts, range(1000) s(step) WHERE gcd(low + step, n) = 1 GROUP BY ALL)""") + (
        f"SELECT t.row_key, rep::BIGINT AS rep, {r('t.entropy')} AS entropy, {r('d.entropy')} AS permuted "
        "FROM (SELECT *, (a * place + b) % n AS donor FROM placed, maps) t JOIN placed d ON d.place = t.donor"
    )
    sql["resource_stats"] = (
        "SELECT event_type, coalesce(round(avg(value), 2), 0.0) AS avg_value, coalesce(round(max(value), 2), 0.0) AS max_value "
        "FROM events GROUP BY 1"
    )
    return sql
