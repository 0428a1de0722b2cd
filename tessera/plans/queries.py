"""Named queries over the driver's tables, each with the same rows in SQL where SQL has them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import distributions, dtypes, formats, names, special
from tessera.operators import catalog, compare, generate, linalg, numeric, ordered, stats, transcripts, validate
from tessera.plans.tables import CATALOGUE, TWO_CONFIGS, TWO_MODELS, catalogue, matrix, read, two_configs, two_models

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Floating-point columns rounded, so that the order of sums does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes])


def _lines(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "lineitem")


# ---- aggregates


@query("""
    WITH m AS (SELECT l_returnflag AS g, avg(l_extendedprice) AS mu, var_pop(l_extendedprice) AS v FROM lineitem GROUP BY 1)
    SELECT l_returnflag, count(*) AS n, 0 AS n_nan, round(sum(l_extendedprice) / 1e6, 4) AS total_m, round(avg(l_extendedprice), 4) AS mean,
        round(var_samp(l_extendedprice) / 1e6, 4) AS var_samp_m, round(var_pop(l_extendedprice) / 1e6, 4) AS var_pop_m,
        round(stddev_samp(l_extendedprice), 4) AS std_samp, round(stddev_pop(l_extendedprice), 4) AS std_pop,
        round(min(l_extendedprice), 4) AS least, round(max(l_extendedprice), 4) AS most,
        round(avg(pow(l_extendedprice - mu, 3)) / pow(max(v), 1.5), 4) AS skew, round(avg(pow(l_extendedprice - mu, 4)) / pow(max(v), 2) - 3, 4) AS kurt
    FROM lineitem JOIN m ON l_returnflag = g GROUP BY l_returnflag
""")
def f_summary(s, d):
    """The ten-field summary by flag."""
    g = stats.summary(_lines(s, d), "l_extendedprice", "l_returnflag")
    scaled = g.select("l_returnflag", "n", "n_nan", (F.col("total") / 1e6).alias("total_m"), "mean", (F.col("var_samp") / 1e6).alias("var_samp_m"), (F.col("var_pop") / 1e6).alias("var_pop_m"), "std_samp", "std_pop", "least", "most", "skew", "kurt")
    return rounded(scaled)


@query("""
    SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.05), 4) AS p5, round(quantile_cont(o_totalprice, 0.25), 4) AS p25,
        round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.75), 4) AS p75, round(quantile_cont(o_totalprice, 0.95), 4) AS p95
    FROM orders GROUP BY 1
""")
def f_quantiles(s, d):
    """exact quantiles."""
    return rounded(stats.quantiles(read(s, d, "orders"), "o_totalprice", [0.05, 0.25, 0.5, 0.75, 0.95], "o_orderpriority"))


@query("""
    SELECT event_type, round(sum(abs(value)), 3) AS l1, round(sqrt(sum(value * value)), 3) AS l2, round(max(abs(value)), 3) AS l_inf FROM events GROUP BY 1
""")
def f_norms(s, d):
    """F13-F15."""
    return rounded(stats.norms(read(s, d, "events"), "value", "event_type"), 3)


@query("""
    SELECT l_shipmode_g AS flag, round(quantile_cont(x, 0.99), 4) AS p99, round(quantile_cont(x, 0.999), 4) AS p99_9, round(quantile_cont(x, 0.9999), 4) AS p99_99,
        round(max(abs(x)) / stddev_pop(x), 4) AS max_over_std
    FROM (SELECT l_linestatus AS l_shipmode_g, l_extendedprice AS x FROM lineitem) GROUP BY 1
""")
def f_tails(s, d):
    """F16."""
    return rounded(stats.tails(_lines(s, d).withColumnRenamed("l_linestatus", "flag"), "l_extendedprice", "flag"))


@query("""
    SELECT l_returnflag, count(*) AS n, round(covar_pop(l_quantity, l_extendedprice), 3) AS cov, round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem GROUP BY 1
""")
def f_covariance(s, d):
    """covariance and guarded correlation."""
    g = stats.covariance(_lines(s, d), "l_quantity", "l_extendedprice", "l_returnflag")
    return g.select("l_returnflag", "n", F.round("cov", 3).alias("cov"), F.round("corr", 6).alias("corr"))


@query("""
    WITH m AS (SELECT event_type AS g, avg(value) AS mu, stddev_pop(value) AS sd FROM events GROUP BY 1)
    SELECT event_type, count(*) AS n, count(*) FILTER (abs(value - mu) / sd > 3) AS n_outliers, count(*) FILTER (abs(value - mu) / sd > 5) AS n_super,
        round(100.0 * count(*) FILTER (abs(value - mu) / sd > 3) / count(*), 4) AS outlier_percent,
        round(100.0 * count(*) FILTER (abs(value - mu) / sd > 5) / count(*), 4) AS super_percent,
        round(100.0 * count(*) FILTER (value = 0) / count(*), 4) AS zero_percent
    FROM events JOIN m ON event_type = g GROUP BY 1
""")
def f_magnitudes(s, d):
    """F27, F29, F30, F37, F38, C227: shares beyond three and five deviations, zeros."""
    return rounded(stats.magnitudes(read(s, d, "events"), "value", "event_type"))


@query("SELECT l_linenumber, round(avg(CASE WHEN abs(l_discount) > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS density FROM lineitem GROUP BY 1")
def f_density(s, d):
    """F57, F58."""
    return stats.density(_lines(s, d), "l_discount", 0.05, "l_linenumber").select("l_linenumber", F.round("density", 6).alias("density"))


@query("""
    WITH m AS (SELECT event_type AS g, avg(value) AS mu, stddev_pop(value) AS sd FROM events GROUP BY 1)
    SELECT event_id, event_type, round(value, 6) AS value FROM events JOIN m ON event_type = g WHERE abs(value - mu) > 2.0 * sd
""")
def d_outliers(s, d):
    """Rows beyond two deviations of their group's mean."""
    return stats.outliers(read(s, d, "events"), "value", 2.0, "event_type").select("event_id", "event_type", F.round("value", 6).alias("value"))


@query("""
    WITH m AS (SELECT stddev_pop(value) AS sd FROM events) SELECT event_id, round(value, 6) AS value FROM events, m WHERE abs(value) > 2.0 * sd
""")
def d_outliers_compat(s, d):
    """Uncentred threshold."""
    return stats.outliers(read(s, d, "events"), "value", 2.0, centred=False).select("event_id", F.round("value", 6).alias("value"))


@query("""
    WITH m AS (SELECT quantile_cont(abs(value), 0.95) AS q FROM events) SELECT event_id, round(value, 6) AS value FROM events, m WHERE abs(value) > q
""")
def d_outliers_quantile(s, d):
    """Beyond the magnitudes' quantile."""
    return stats.outliers_by_quantile(read(s, d, "events"), "value", 0.95).select("event_id", F.round("value", 6).alias("value"))


# ---- ordered analytics

_ERF = "(CASE WHEN ({x}) < 0 THEN -1 ELSE 1 END * (1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-({x}) * ({x}))))"
_RANKS = """c AS (SELECT {g} AS g, {x} AS x, count(*) AS c FROM {t} WHERE {x} IS NOT NULL GROUP BY 1, 2),
r AS (SELECT g, x, sum(c) OVER (PARTITION BY g ORDER BY x) AS upto, sum(c) OVER (PARTITION BY g ORDER BY x) - c AS before, sum(c) OVER (PARTITION BY g) AS n FROM c)"""
_P = """CASE WHEN sqrt(n) * d < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, list_sum(list_transform(range(1, 101), lambda i: CASE WHEN i % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * i * i * n * d * d))))) END"""
_P_COMPAT = """CASE WHEN sqrt(n) * d < 0.01 THEN 1.0 WHEN sqrt(n) * d < 1.18 THEN 1 - exp(-2 * n * d * d) ELSE least(1.0, list_sum(list_transform(range(1, 101), lambda i: 2.0 * exp(-2.0 * i * i * n * d * d)))) END"""


def _ks_sql(table: str, group: str, column: str, fit: str, z: str | None, cdf: str, params: str, compat: bool = False) -> str:
    """SQL of a fit and its test; ``z`` is the argument of erf where the cdf needs it."""
    inner = f"SELECT r.*, f.*, {z} AS z, 1 / (1 + 0.3275911 * abs({z})) AS t" if z else "SELECT r.*, f.*"
    other = "abs((before + 1) / n - p)" if compat else "abs(before / n - p)"
    return f"""
        WITH {_RANKS.format(g=group, x=column, t=table)}, f AS ({fit}),
        j AS ({inner} FROM r JOIN f ON r.g = f.fg), e AS (SELECT *, {cdf} AS p FROM j),
        k AS (SELECT g, {params}, max(n) AS n, max(greatest(abs(upto / n - p), {other})) AS d FROM e GROUP BY ALL)
        SELECT g AS {group}, {", ".join(f"round({c.strip()}, 4) AS {c.strip()}" for c in params.split(","))}, CAST(n AS BIGINT) AS n, round(d, 6) AS d, round({_P_COMPAT if compat else _P}, 6) AS p FROM k
    """


def _tested(df: DataFrame, column: str, family: str, by: str, compat: bool = False) -> DataFrame:
    got = ordered.test_fit(df, column, family, by, compat=compat)
    return got.select(*[F.round(c, 6 if c in ("d", "p") else 4).alias(c) if t == "double" else F.col(c) for c, t in got.dtypes])


_NORMAL_FIT = "SELECT event_type AS fg, avg(value) AS mu, stddev_pop(value) AS sigma FROM events GROUP BY 1"
_NORMAL_CDF = "0.5 * (1 + " + _ERF.format(x="z") + ")"


@query(_ks_sql("events", "event_type", "value", _NORMAL_FIT, "(x - mu) / sigma / sqrt(2)", _NORMAL_CDF, "mu, sigma"))
def g_ks_normal(s, d):
    """G2, G3, G8, G9, C311, C312, M4: normal fit, two-sided distance, Kolmogorov's series."""
    return _tested(read(s, d, "events"), "value", "normal", "event_type")


@query(_ks_sql("events", "event_type", "value", _NORMAL_FIT, "(x - mu) / sigma / sqrt(2)", _NORMAL_CDF, "mu, sigma", compat=True))
def g_ks_normal_compat(s, d):
    """One-sided distance and the series without alternating signs."""
    return _tested(read(s, d, "events"), "value", "normal", "event_type", compat=True)


@query(_ks_sql("orders", "o_orderstatus", "o_totalprice", "SELECT o_orderstatus AS fg, avg(ln(o_totalprice)) AS mu, least(10, greatest(0.01, stddev_pop(ln(o_totalprice)))) AS sigma FROM orders WHERE o_totalprice > 0 GROUP BY 1", "(ln(x) - mu) / sigma / sqrt(2)", _NORMAL_CDF, "mu, sigma"))
def g_ks_lognormal(s, d):
    """G7, G12."""
    return _tested(read(s, d, "orders"), "o_totalprice", "lognormal", "o_orderstatus")


@query(_ks_sql("orders", "o_orderstatus", "o_totalprice", "SELECT o_orderstatus AS fg, min(o_totalprice) AS least, least(100, greatest(0.1, count(*) / (sum(ln(o_totalprice)) - count(*) * ln(min(o_totalprice))))) AS alpha FROM orders WHERE o_totalprice > 0 GROUP BY 1", None, "CASE WHEN x < least THEN 0.0 ELSE 1 - pow(least / x, alpha) END", "least, alpha"))
def g_ks_pareto(s, d):
    """G6, G11."""
    return _tested(read(s, d, "orders"), "o_totalprice", "pareto", "o_orderstatus")


_WEIBULL_FIT = """
    SELECT fg, least(10, greatest(0.1, sl)) AS shape, exp(-(my - sl * mx) / sl) AS scale FROM (
        SELECT fg, covar_pop(lx, ly) / var_pop(lx) AS sl, avg(lx) AS mx, avg(ly) AS my FROM (
            SELECT o_orderstatus AS fg, ln(o_totalprice) AS lx,
                ln(-ln(1 - (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) - 0.5) / count(*) OVER (PARTITION BY o_orderstatus))) AS ly
            FROM orders WHERE o_totalprice > 0) GROUP BY 1)"""


@query(_ks_sql("orders", "o_orderstatus", "o_totalprice", _WEIBULL_FIT, None, "CASE WHEN x <= 0 THEN 0.0 ELSE 1 - exp(-pow(x / scale, shape)) END", "shape, scale"))
def g_ks_weibull(s, d):
    """G5, G10."""
    return _tested(read(s, d, "orders"), "o_totalprice", "weibull", "o_orderstatus")


@query()
def g_ks_student_t(s, d):
    """G4, G13, C33, C34, C38, C320: Student's t by the incomplete beta function (no SQL form)."""
    return _tested(read(s, d, "events"), "value", "student_t", "event_type")


@query("SELECT l_returnflag, round(avg(CASE WHEN l_extendedprice <= 30000.0 THEN 1.0 ELSE 0.0 END), 6) AS share FROM lineitem GROUP BY 1")
def g_ecdf(s, d):
    """G1."""
    return ordered.ecdf_at(_lines(s, d), "l_extendedprice", 30000.0, "l_returnflag").select("l_returnflag", F.round("share", 6).alias("share"))


@query("""
    WITH e AS (SELECT event_id // 64 AS block, event_id, value FROM events),
    p AS (SELECT block, value AS x, lag(value) OVER (PARTITION BY block ORDER BY event_id) AS y FROM e)
    SELECT block, count(*) AS n, round(corr(x, y), 6) AS corr FROM p GROUP BY 1 HAVING count(*) = 64
""")
def g_lag_correlation(s, d):
    """Lag-1 correlation in blocks of 64."""
    g = ordered.lag_correlation(read(s, d, "events"), "value", "event_id", 64)
    return g.select("block", "n", F.round("corr", 6).alias("corr"))


@query("""
    WITH e AS (SELECT c_nationkey AS g, abs(c_acctbal) + c_custkey / 1e6 AS sigma FROM customer),
    r AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY sigma DESC) AS rank,
        sum(sigma * sigma) OVER (PARTITION BY g ORDER BY sigma DESC ROWS UNBOUNDED PRECEDING) / sum(sigma * sigma) OVER (PARTITION BY g) AS share FROM e)
    SELECT g AS c_nationkey, coalesce(min(CASE WHEN share >= 0.9 THEN rank END), max(rank)) AS effective_rank FROM r GROUP BY 1
""")
def g_effective_rank(s, d):
    """Cumulative energy and the rank that reaches 90 %."""
    c = read(s, d, "customer").select("c_nationkey", (F.abs("c_acctbal") + F.col("c_custkey") / 1e6).alias("sigma"))
    got = ordered.effective_rank(ordered.energy(c, "sigma", "c_nationkey"), 0.9, "c_nationkey")
    return got.select("c_nationkey", F.col("effective_rank").cast("bigint").alias("effective_rank"))


@query("""
    WITH m AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd FROM events),
    h AS (SELECT event_type, event_id, value, abs(value - mu) > 1.5 * sd AS hit FROM events, m),
    n AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS k FROM h)
    SELECT event_id, round(value * 10, 6) AS value FROM n WHERE hit AND k <= 5
""")
def g_super_weights(s, d):
    """Only the first hits in order of index are scaled."""
    e = read(s, d, "events")
    m = e.agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    j = e.crossJoin(F.broadcast(m))
    hit = F.abs(F.col("value") - F.col("mu")) > 1.5 * F.col("sd")
    chosen = ordered.capped_hits(j, hit, "event_id", 5, "event_type")
    return generate.super_weights(chosen, F.lit(True), 10.0, "value").select("event_id", F.round("value", 6).alias("value"))


@query("SELECT i AS chunk_id, i * 300 AS start, least((i + 1) * 300, 1000) AS \"end\" FROM range(4) t(i)")
def g_chunks(s, d):
    """G20, G21, N1."""
    return ordered.chunk_ranges(s, 1000, 300)


# ---- names, formats, hashes

_ROLE_RULES = [
    ("attention", "contains(name, 'self_attn') OR contains(name, 'attention')"),
    ("mlp", "contains(name, 'mlp') OR contains(name, 'ffn')"),
    ("embedding", "contains(name, 'embed')"),
    ("normalization", "contains(name, 'norm')"),
]
_TYPE_RULES = [
    ("attention_qkv", "contains(name, 'q_proj') OR contains(name, 'k_proj') OR contains(name, 'v_proj')"),
    ("attention_output", "contains(name, 'o_proj')"),
    ("mlp_gate", "contains(name, 'gate_proj')"),
    ("mlp_up", "contains(name, 'up_proj')"),
    ("mlp_down", "contains(name, 'down_proj')"),
    ("normalization", "contains(name, 'norm')"),
]


def _case(rules, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{label}'" for label, c in rules) + f" ELSE '{otherwise}' END"


_DESCRIBED = f"""{CATALOGUE}, described AS (
    SELECT *, shape[1] * shape[2] AS elements, {_case(_ROLE_RULES, 'other')} AS role, {_case(_TYPE_RULES, 'other')} AS kind,
        TRY_CAST(regexp_extract(name, 'layers\\.([0-9]+)', 1) AS BIGINT) AS layer, TRY_CAST(nullif(regexp_extract(name, 'experts\\.([0-9]+)', 1), '') AS BIGINT) AS expert
    FROM catalogue)"""


@query(f"""
    WITH {_DESCRIBED}
    SELECT name, role, kind, layer, expert,
        {_case([("Norm", "contains(name, 'layernorm')"), ("MoeRouter", "contains(name, 'mlp.gate')"), ("MoeRoutedExpert", "contains(name, 'experts.')"), ("AttentionQuery", "contains(name, 'q_proj')"), ("AttentionKey", "contains(name, 'k_proj')"), ("AttentionOutput", "contains(name, 'o_proj')"), ("MlpGate", "contains(name, 'gate_proj')"), ("MlpUp", "contains(name, 'up_proj')"), ("MlpDown", "contains(name, 'down_proj')")], "Other")} AS fine_role,
        regexp_matches(name, '^model\\.layers\\.[^.]+(\\.[^.]+)*\\.weight$') AS is_weight
    FROM described
""")
def c_names(s, d):
    """C116-C121, C133: roles, layer and expert numbers, patterns."""
    c = catalog.described(catalogue(s, d))
    n = F.col("name")
    return c.select("name", "role", "kind", "layer", "expert", names.tensor_role(n).alias("fine_role"), names.matches(n, "model.layers.{layer}.weight").alias("is_weight"))


@query(f"""
    WITH {CATALOGUE}, x AS (SELECT path, name, CASE
            WHEN contains(name, 'q_proj') OR contains(name, 'k_proj') THEN 'attention_dim' WHEN contains(name, 'o_proj') THEN 'output_dim'
            WHEN contains(name, 'gate_proj') OR contains(name, 'up_proj') THEN 'mlp_intermediate' WHEN contains(name, 'down_proj') THEN 'mlp_output' END AS key, shape[1] AS value FROM catalogue)
    SELECT key, arg_max(value, path || '|' || name) AS value FROM x WHERE key IS NOT NULL GROUP BY 1
""")
def c_dimensions(s, d):
    """C122: named dimensions, the last in order wins."""
    return catalog.dimensions(catalogue(s, d))


@query("""
    SELECT p_partkey, CASE WHEN n >= 1e12 THEN printf('%.2f TB', n / 1e12) WHEN n >= 1e9 THEN printf('%.2f GB', n / 1e9) WHEN n >= 1e6 THEN printf('%.2f MB', n / 1e6)
            WHEN n >= 1e3 THEN printf('%.2f KB', n / 1e3) ELSE n || ' B' END AS decimal_size,
        CASE WHEN n >= 1099511627776 THEN printf('%.2f TiB', n / 1099511627776.0) WHEN n >= 1073741824 THEN printf('%.2f GiB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.2f MiB', n / 1048576.0)
            WHEN n >= 1024 THEN printf('%.2f KiB', n / 1024.0) ELSE n || ' o' END AS binary_size,
        CASE WHEN n < 60 THEN n || 's' WHEN n < 3600 THEN (n // 60) || 'm ' || (n % 60) || 's' ELSE (n // 3600) || 'h ' || (n % 3600 // 60) || 'm ' || (n % 60) || 's' END AS duration,
        printf('model-%05d-of-%05d.safetensors', p_partkey, 2000) AS shard, (n + 7) // 8 * 8 AS padded
    FROM (SELECT p_partkey, p_partkey * p_partkey * 40 + 3 AS n FROM part)
""")
def c_formats(s, d):
    """C216, C218, C220, B10, B13."""
    n = F.col("p_partkey") * F.col("p_partkey") * 40 + 3
    return read(s, d, "part").select(
        "p_partkey", formats.format_size(n).alias("decimal_size"), formats.format_bytes(n).alias("binary_size"), formats.format_duration(n).alias("duration"),
        formats.shard_name(F.col("p_partkey"), F.lit(2000)).alias("shard"), formats.padded_header_size(n).alias("padded"),
    )


@query("""
    SELECT doc_id, sha256(text) AS digest, 'sha256:' || sha256(text)[1:8] AS short, sha256(lang || source) = sha256(lang || source) AS same, length(sha256(text)) = 64 AS valid FROM documents
""")
def c_hashes(s, d):
    """Digests of whole texts."""
    h = F.sha2("text", 256)
    both = F.concat("lang", "source")
    return read(s, d, "documents").select("doc_id", h.alias("digest"), formats.hash_short(h).alias("short"), (F.sha2(both, 256) == F.sha2(both, 256)).alias("same"), formats.is_hash(F.concat(F.lit("sha256:"), h)).alias("valid"))


@query("""
    SELECT p_partkey, sha256(encode('') || from_hex(concat(printf('%02x', p_partkey & 255), printf('%02x', (p_partkey >> 8) & 255), printf('%02x', (p_partkey >> 16) & 255), '0000000000'))
        || from_hex(printf('%02x', length(p_brand)) || '00000000000000') || encode(p_brand) || from_hex(printf('%02x', length(p_type)) || '00000000000000') || encode(p_type)
        || from_hex(concat(printf('%02x', p_size & 255), '000000')) || from_hex('0200000000000000') || encode('v1')) AS seed FROM part
""")
def c_seeds(s, d):
    """C212, K7: a tensor's seed from framed fields."""
    return read(s, d, "part").select("p_partkey", formats.derive_seed(F.col("p_partkey"), F.col("p_brand"), F.col("p_type"), F.col("p_size"), F.lit("v1")).alias("seed"))


@query("""
    WITH t AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || CASE WHEN o_orderkey % 3 = 0 THEN 'Z' WHEN o_orderkey % 3 = 1 THEN '.123Z' ELSE '.12Z' END AS ts FROM orders)
    SELECT o_orderkey, regexp_matches(ts, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]{3})?Z$') AS valid FROM t
""")
def c_timestamps(s, d):
    """C29."""
    k = F.col("o_orderkey")
    ts = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.when(k % 3 == 0, "Z").when(k % 3 == 1, ".123Z").otherwise(".12Z"))
    return read(s, d, "orders").select("o_orderkey", formats.is_timestamp(ts).alias("valid"))


@query("""
    WITH v(text) AS (VALUES ('100K'), ('1.5g'), ('2T'), ('1024'), ('0'), ('x'), (' 3m '), ('1t2k'), ('')),
    n AS (SELECT text, lower(trim(text)) AS s FROM v),
    f AS (SELECT text, CASE WHEN contains(s, 't') THEN TRY_CAST(split_part(s, 't', 1) AS DOUBLE) * 1e12 WHEN contains(s, 'g') THEN TRY_CAST(split_part(s, 'g', 1) AS DOUBLE) * 1e9
        WHEN contains(s, 'm') THEN TRY_CAST(split_part(s, 'm', 1) AS DOUBLE) * 1e6 WHEN contains(s, 'k') THEN TRY_CAST(split_part(s, 'k', 1) AS DOUBLE) * 1e3 ELSE TRY_CAST(s AS DOUBLE) END AS x FROM n)
    SELECT text, CASE WHEN floor(x) > 0 THEN CAST(floor(x) AS BIGINT) END AS size FROM f
""")
def c_parse_size(s, d):
    """C215."""
    v = s.createDataFrame([(x,) for x in ("100K", "1.5g", "2T", "1024", "0", "x", " 3m ", "1t2k", "")], "text string")
    return v.select("text", formats.parse_size(F.col("text")).alias("size"))


@query(f"""
    WITH {CATALOGUE} SELECT name, dtype, [4, 2, 2, 1][p_partkey % 4 + 1] AS size, [32, 16, 16, 8][p_partkey % 4 + 1] AS bits, dtype <> 'I8' AS is_float,
        CAST(shape[1] * shape[2] AS DOUBLE) AS elements, CAST(bytes AS DOUBLE) AS bytes FROM catalogue
""")
def c_dtypes(s, d):
    """C11-C19, C110-C114, A8."""
    t = F.col("dtype")
    return catalogue(s, d).select(
        "name", dtypes.parse_dtype(F.lower(t)).alias("dtype"), dtypes.size_bytes(t).cast("bigint").alias("size"), dtypes.bits_per_element(t).cast("bigint").alias("bits"),
        dtypes.is_float(t).alias("is_float"), dtypes.num_elements(F.col("shape")).cast("double").alias("elements"), dtypes.byte_size(F.col("shape"), t).cast("double").alias("bytes"),
    )


@query("""
    WITH e AS (SELECT event_id, value AS x FROM events), t AS (SELECT *, 1 / (1 + 0.2316419 * abs(x / 50)) AS t FROM e)
    SELECT event_id,
        round(CASE WHEN x >= 0 THEN 1 - u ELSE u END, 6) AS normal,
        round(CASE WHEN x < 10 THEN 0.5 * exp(-abs(x - 10) / 20.0) ELSE 1 - 0.5 * exp(-abs(x - 10) / 20.0) END, 6) AS laplace,
        round(CASE WHEN x <= 0 THEN 0.0 ELSE 1 - exp(-pow(greatest(x, 0) / 30.0, 1.5)) END, 6) AS weibull,
        round(CASE WHEN x < 5 THEN 0.0 ELSE 1 - pow(5.0 / x, 2.0) END, 6) AS pareto,
        round(least(1.0, greatest(0.0, (x + 10) / 110.0)), 6) AS uniform
    FROM (SELECT *, exp(-x * x / 5000) / sqrt(2 * pi()) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) AS u FROM t)
""")
def c_distributions(s, d):
    """C310, C314-C319: distribution functions as expressions."""
    x = F.col("value")
    kinds = {"normal": distributions.Normal(0, 50), "laplace": distributions.Laplace(10, 20), "weibull": distributions.Weibull(30, 1.5), "pareto": distributions.Pareto(5, 2), "uniform": distributions.Uniform(-10, 100)}
    return read(s, d, "events").select("event_id", *[F.round(k.cdf(x), 6).alias(n) for n, k in kinds.items()])


@query()
def c_special(s, d):
    """Gamma, incomplete gamma and beta, quantiles (no SQL form; tested against known values)."""
    x = F.col("p_size") / 10.0
    u = F.col("p_size") / 60.0
    return read(s, d, "part").select(
        "p_partkey", special.ln_gamma(x).alias("ln_gamma"), special.chi2_cdf(x, F.lit(3.0)).alias("chi2"), special.beta_inc(x, F.lit(2.0), u).alias("beta"),
        special.student_t_cdf(x - 2, F.lit(5.0)).alias("t"), special.chi2_quantile(u, F.lit(4.0)).alias("chi2_q"), special.normal_inv_cdf(u).alias("normal_q"),
    )


# ---- catalogue


@query(f"""
    WITH {_DESCRIBED} SELECT count(*) AS tensors, CAST(sum(elements) AS DOUBLE) AS elements, count(DISTINCT layer) AS layers, count(DISTINCT expert) AS experts,
        count(DISTINCT path) AS shards, array_to_string(list_sort(list_distinct(list(dtype))), ',') AS dtypes FROM described
""")
def f_structure(s, d):
    """F31, A14, B30."""
    g = catalog.structure(catalogue(s, d))
    return g.withColumn("elements", F.col("elements").cast("double")).withColumn("dtypes", F.array_join("dtypes", ","))


_ROLL = "SELECT '{0}' AS dimension, CAST({0} AS VARCHAR) AS key, count(*) AS tensors, CAST(sum(elements) AS DOUBLE) AS elements, CAST(sum(bytes) AS BIGINT) AS bytes FROM described GROUP BY {0}"


@query(f"""
    WITH {_DESCRIBED} {" UNION ALL ".join(_ROLL.format(k) for k in ("layer", "role", "kind", "path", "dtype"))}
    UNION ALL SELECT 'all', NULL, count(*), CAST(sum(elements) AS DOUBLE), CAST(sum(bytes) AS BIGINT) FROM described
""")
def f_rollups(s, d):
    """Five roll-ups in one grouping-sets pass."""
    return catalog.rollups(catalogue(s, d)).withColumn("elements", F.col("elements").cast("double"))


@query(f"""
    WITH {_DESCRIBED}, t AS (SELECT dtype, count(*) AS c FROM described GROUP BY 1)
    SELECT CAST(sum(bytes) AS BIGINT) AS bytes, round(sum(bytes) / sum(elements), 6) AS bytes_per_element, (SELECT dtype FROM t ORDER BY c DESC, dtype LIMIT 1) AS main_dtype FROM described
""")
def f_physical(s, d):
    """F32, C124."""
    g = catalog.physical(catalogue(s, d))
    return g.select("bytes", F.round("bytes_per_element", 6).alias("bytes_per_element"), "main_dtype")


@query(f"""
    WITH {CATALOGUE} SELECT path, count(*) AS tensors, CAST(sum(bytes) AS BIGINT) AS bytes, array_to_string(list_sort(list_distinct(list(dtype))), ',') AS dtypes FROM catalogue GROUP BY 1
""")
def f_shards(s, d):
    """F35, E15."""
    return catalog.shard_table(catalogue(s, d)).withColumn("dtypes", F.array_join("dtypes", ","))


@query("SELECT c_name_part AS name, count(*) AS n FROM (SELECT p_name AS c_name_part FROM part) GROUP BY 1 HAVING count(*) > 1")
def f_duplicates(s, d):
    """F42, F44, I5."""
    return catalog.duplicates(read(s, d, "part").withColumnRenamed("p_name", "name"))


@query("""
    WITH l AS (SELECT i AS layer FROM range(6) t(i)),
    c(part, shape) AS (VALUES ('self_attn.q_proj', '64,64'), ('self_attn.k_proj', '16,64'), ('self_attn.v_proj', '16,64'), ('self_attn.o_proj', '64,64'), ('input_layernorm', '64'), ('post_attention_layernorm', '64')),
    m(part, shape) AS (VALUES ('gate_proj', '128,64'), ('up_proj', '128,64'), ('down_proj', '64,128')),
    x(part, shape) AS (VALUES ('gate_proj', '32,64'), ('up_proj', '32,64'), ('down_proj', '64,32'))
    SELECT 'layer' AS section, 'model.layers.' || layer || '.' || part || '.weight' AS name, shape FROM l, c
    UNION ALL SELECT 'layer', 'model.layers.' || layer || '.mlp.' || part || '.weight', shape FROM l, m WHERE layer < 2
    UNION ALL SELECT 'layer', 'model.layers.' || layer || '.mlp.gate.weight', '4,64' FROM l WHERE layer >= 2
    UNION ALL SELECT 'layer', 'model.layers.' || layer || '.mlp.shared_experts.' || part || '.weight', shape FROM l, x WHERE layer >= 2
    UNION ALL SELECT 'layer', 'model.layers.' || layer || '.mlp.experts.' || e.i || '.' || part || '.weight', shape FROM l, x, range(4) e(i) WHERE layer >= 2
    UNION ALL VALUES ('embed', 'model.embed_tokens.weight', '1000,64'), ('final_norm', 'model.norm.weight', '64'), ('lm_head', 'lm_head.weight', '1000,64')
""")
def i_blueprint(s, d):
    """The tensor catalogue of a mixture model."""
    b = catalog.blueprint(s, layers=6, hidden=64, heads=4, kv_heads=1, intermediate=128, vocab=1000, experts=4, dense_first=2, expert_size=32)
    return b.select("section", "name", F.array_join(F.transform("shape", lambda x: x.cast("string")), ",").alias("shape"))


@query(f"""
    WITH RECURSIVE {CATALOGUE}, o AS (SELECT name, bytes, row_number() OVER (ORDER BY name) AS i FROM catalogue),
    f AS (SELECT i, name, bytes, 1 AS shard, bytes AS used FROM o WHERE i = 1
        UNION ALL SELECT o.i, o.name, o.bytes, CASE WHEN f.used = 0 OR f.used + o.bytes <= 5000 THEN f.shard ELSE f.shard + 1 END, CASE WHEN f.used = 0 OR f.used + o.bytes <= 5000 THEN f.used + o.bytes ELSE o.bytes END FROM f JOIN o ON o.i = f.i + 1)
    SELECT name, bytes, CAST(shard AS BIGINT) AS shard, bytes > 5000 AS too_large FROM f
""")
def b_shard_plan(s, d):
    """Next-fit packing of tensors into shards."""
    return catalog.shard_plan(catalogue(s, d), 5000)


# ---- comparison


@query(f"""
    WITH {TWO_MODELS}, u AS (SELECT name, max(a) AS a, max(b) AS b FROM (SELECT name, 1 AS a, 0 AS b FROM a UNION ALL SELECT name, 0, 1 FROM b) GROUP BY 1),
    g AS (SELECT count(*) AS total, count(*) FILTER (a = 1 AND b = 1) AS common, count(*) FILTER (b = 0) AS original_only, count(*) FILTER (a = 0) AS compared_only, count(*) FILTER (b = 0 AND (contains(name, 'weight') OR contains(name, 'bias'))) AS blocking FROM u)
    SELECT *, round(common / total, 6) AS score, CASE WHEN common = total THEN 'MATCH' WHEN common / total >= 0.8 THEN 'PARTIAL' ELSE 'DIFFERENT' END AS status FROM g
""")
def e_tensors(s, d):
    """E1, E2, F55."""
    a, b = two_models(s, d)
    return compare.compare_tensors(a, b).withColumn("score", F.round("score", 6))


@query(f"""
    WITH {TWO_MODELS} SELECT CASE WHEN b.name IS NULL THEN 'REMOVED' ELSE 'ADDED' END AS diff_type, coalesce(a.name, b.name) AS path FROM a FULL JOIN b ON a.name = b.name WHERE a.name IS NULL OR b.name IS NULL
""")
def e_diffs(s, d):
    """D1, D2, D4, D5, E1."""
    return compare.tensor_diffs(*two_models(s, d))


def _value_sql(column: str) -> str:
    return f"""
        WITH {TWO_MODELS}, g AS (SELECT count(*) AS total, count(*) FILTER (a.{column} = b.{column}) AS matching FROM a JOIN b ON a.name = b.name)
        SELECT total, matching, round(matching / total, 6) AS score, total - matching AS blocking, CASE WHEN total = matching THEN 'MATCH' WHEN matching / total >= 0.8 THEN 'PARTIAL' ELSE 'DIFFERENT' END AS status FROM g"""


@query(_value_sql("shape"))
def e_shapes(s, d):
    """E3, E4."""
    return compare.compare_values(*two_models(s, d), "shape").withColumn("score", F.round("score", 6))


@query(_value_sql("dtype"))
def e_dtypes(s, d):
    """E5, E6."""
    return compare.compare_values(*two_models(s, d), "dtype").withColumn("score", F.round("score", 6))


@query(f"WITH {TWO_MODELS} SELECT 'MODIFIED' AS diff_type, a.name AS path, a.dtype AS original, b.dtype AS compared FROM a JOIN b ON a.name = b.name WHERE a.dtype <> b.dtype")
def e_dtype_diffs(s, d):
    """D3, D6."""
    return compare.value_diffs(*two_models(s, d), "dtype")


@query(f"""
    WITH {TWO_MODELS}, g AS (SELECT count(*) AS total, count(*) FILTER (a.path = b.path AND a.bytes = b.bytes) AS matching, count(*) FILTER (a.path <> b.path) AS moved, count(*) FILTER (a.path = b.path AND a.bytes <> b.bytes) AS resized FROM a JOIN b ON a.name = b.name),
    s AS (SELECT (SELECT count(DISTINCT path) FROM a) AS shards_a, (SELECT count(DISTINCT path) FROM b) AS shards_b)
    SELECT *, round(matching / total, 6) AS score, moved + CASE WHEN shards_a <> shards_b THEN 1 ELSE 0 END AS blocking,
        CASE WHEN total = matching AND shards_a = shards_b THEN 'MATCH' WHEN matching / total >= 0.8 THEN 'PARTIAL' ELSE 'DIFFERENT' END AS status FROM g, s
""")
def e_sharding(s, d):
    """E7, E8."""
    return compare.compare_sharding(*two_models(s, d), shard="path", size="bytes").withColumn("score", F.round("score", 6))


@query(f"WITH {TWO_CONFIGS} SELECT * FROM diffs")
def e_config_diffs(s, d):
    """E9."""
    return compare.config_diffs(*two_configs(s))


@query(f"""
    WITH {TWO_CONFIGS}, g AS (SELECT count(*) AS total, count(*) FILTER (diff_type IS NULL) AS matching, count(*) FILTER (diff_type = 'REMOVED' OR (diff_type = 'MODIFIED' AND path IN ('vocab_size', 'hidden_size'))) AS blocking FROM diffs)
    SELECT *, round(matching / total, 6) AS score, CASE WHEN total = matching THEN 'MATCH' WHEN matching / total >= 0.8 THEN 'PARTIAL' ELSE 'DIFFERENT' END AS status FROM g
""")
def e_configs(s, d):
    """E9, E10."""
    return compare.compare_configs(*two_configs(s)).withColumn("score", F.round("score", 6))


@query(f"""
    WITH {TWO_CONFIGS}, g AS (SELECT count(*) AS total, count(*) FILTER (diff_type IS NULL) AS matching, count(*) FILTER (diff_type IS NOT NULL AND path IN ('num_layers', 'hidden_size', 'vocab_size')) AS blocking FROM diffs)
    SELECT *, round(matching / total, 6) AS score, CASE WHEN total = matching THEN 'IDENTICAL' WHEN matching / total >= 0.8 THEN 'COMPATIBLE' WHEN matching > 0 THEN 'DIFFERENT' ELSE 'UNKNOWN' END AS architecture FROM g
""")
def e_architecture(s, d):
    """E11-E13."""
    return compare.compare_architectures(*two_configs(s)).withColumn("score", F.round("score", 6))


@query("""
    WITH x AS (SELECT n_nationkey, n_regionkey / 4.0 AS r, (n_nationkey % 5) / 4.0 AS t FROM nation),
    w AS (SELECT *, 0.2 * r + 0.25 * t + 0.2 * r + 0.15 * 1.0 + 0.1 * t + 0.1 * 1.0 AS v FROM x)
    SELECT n_nationkey, round(100 * v, 6) AS percent, CASE WHEN 100 * v >= 100 AND n_nationkey <> 7 THEN 'MATCH' WHEN 100 * v < 50 OR n_nationkey = 7 THEN 'DIFFERENT' ELSE 'PARTIAL' END AS status,
        floor(10 * v + 1e-9) * 10.0 AS compat_percent
    FROM w
""")
def e_global_score(s, d):
    """The weighted score in both forms."""
    r, t = F.col("n_regionkey") / 4.0, (F.col("n_nationkey") % 5) / 4.0
    scores = {"config": r, "architecture": t, "tensors": r, "shapes": F.lit(1.0), "dtypes": t, "sharding": F.lit(1.0)}
    blocking = (F.col("n_nationkey") == 7).cast("int")
    plain, compat = compare.global_score(scores, blocking), compare.global_score(scores, blocking, compat=True)
    return read(s, d, "nation").select("n_nationkey", F.round(plain[0], 6).alias("percent"), plain[1], compat[0].alias("compat_percent"))


@query("""
    WITH r(ord, lo, hi, factor) AS (VALUES (1, 10, 20, 2.0), (2, 0, 30, 1.5), (3, 25, 60, 3.0)),
    x AS (SELECT p_partkey, p_size, factor, row_number() OVER (PARTITION BY p_partkey ORDER BY ord) AS n FROM part LEFT JOIN r ON p_size BETWEEN lo AND hi)
    SELECT p_partkey, p_size, CAST(factor AS DOUBLE) AS factor FROM x WHERE n = 1
""")
def e_first_rule(s, d):
    """Range lookup, the first rule counts."""
    rules = s.createDataFrame([(1, 10, 20, 2.0), (2, 0, 30, 1.5), (3, 25, 60, 3.0)], "ord int, lo int, hi int, factor double")
    return compare.first_rule(read(s, d, "part").select("p_partkey", "p_size"), rules, "p_size", "factor")


# ---- linear algebra


@query()
def j_singular_values(s, d):
    """Exact singular values by label (no SQL form; tested against numpy)."""
    return linalg.singular_values(matrix(s, d), "label")


# ---- generation and transforms


@query()
def k_stream(s, d):
    """Seeded streams by chunk (no SQL form; tested against a plain generator)."""
    t = catalogue(s, d).select("name", names.layer_number(F.col("name")).alias("layer"), dtypes.num_elements(F.col("shape")).cast("bigint").alias("elements"))
    return generate.stream_values(generate.chunk_table(t, 64, "model", "v1", 42))


@query()
def k_counter(s, d):
    """Counter-based normals and marks as expressions (no SQL form)."""
    rows = generate.counter_values(read(s, d, "orders").select("o_orderkey"), distributions.Normal(1.0, 2.0), 7, "o_orderkey")
    return rows.withColumn("hit", generate.bernoulli(9, 0.1, "o_orderkey"))


@query("""
    WITH m AS (SELECT event_type AS g, avg(value) AS mu, stddev_pop(value) AS sd FROM events GROUP BY 1)
    SELECT event_id, round(CASE WHEN abs(value - mu) > 1.5 * sd THEN greatest(least(value, mu + 1.5 * sd), mu - 1.5 * sd) ELSE value END, 4) AS value FROM events JOIN m ON event_type = g
""")
def l_clip(s, d):
    """L4."""
    return generate.clip_outliers(read(s, d, "events"), "value", 1.5, "event_type").select("event_id", F.round("value", 4).alias("value"))


@query("SELECT i AS layer, round(i / 11.0, 6) AS depth, round(least(1.0, 0.3 * (1 + 3 * i / 11.0)), 6) AS probability, round(2 * (1 + 3 * i / 11.0), 6) AS scale FROM range(12) t(i)")
def l_policies(s, d):
    """C228, C229, L14-L17."""
    return rounded(generate.layer_policies(s, 12, 0.3, 2.0, "increasing", 3.0), 6)


# ---- validation


@query("""
    WITH m AS (SELECT event_type AS g, avg(value) AS mu, stddev_pop(value) AS sd FROM events GROUP BY 1),
    z AS (SELECT event_type, abs(value - mu) / sd AS z FROM events JOIN m ON event_type = g),
    a AS (SELECT event_type, count(*) AS n, count(*) FILTER (z > 2) AS n_outliers, coalesce(max(z) FILTER (z > 2), 0.0) AS max_magnitude FROM z GROUP BY 1),
    i AS (SELECT *, n_outliers / n AS f FROM a),
    v AS (SELECT *, CASE WHEN f > 0.06 THEN 'ERROR' WHEN f > 0.03 THEN 'WARNING' END AS frequency_issue, CASE WHEN max_magnitude > 4 THEN 'WARNING' END AS magnitude_issue FROM i)
    SELECT event_type, n, n_outliers, round(max_magnitude, 4) AS max_magnitude, round(f, 6) AS frequency, frequency_issue, magnitude_issue,
        CASE WHEN n_outliers > 0 AND frequency_issue IS NULL AND magnitude_issue IS NULL THEN 'INFO' END AS note FROM v
""")
def m_outliers(s, d):
    """M7, M8."""
    g = validate.outliers(read(s, d, "events"), "value", 2.0, 0.03, "event_type")
    return g.withColumn("max_magnitude", F.round("max_magnitude", 4)).withColumn("frequency", F.round("frequency", 6))


_STATS_SQL = """g AS (SELECT l_linenumber, l_returnflag, avg(l_quantity) AS mean, stddev_pop(l_quantity) AS std FROM lineitem GROUP BY 1, 2),
e AS (SELECT 'STATISTICAL' AS category, l_linenumber || l_returnflag AS path, abs(mean - 25) / 25 AS dev FROM g UNION ALL SELECT 'STATISTICAL', l_linenumber || l_returnflag, abs(std - 14) / 14 FROM g),
i AS (SELECT category, path, CASE WHEN dev > 0.02 THEN 'ERROR' WHEN dev > 0.01 THEN 'WARNING' END AS severity FROM e)"""


def _stat_issues(s, d):
    g = _lines(s, d).groupBy("l_linenumber", "l_returnflag").agg(F.avg("l_quantity").alias("mean"), F.stddev_pop("l_quantity").alias("std"))
    named = g.select(F.concat(F.col("l_linenumber").cast("string"), "l_returnflag").alias("path"), "mean", "std", F.lit(25.0).alias("target_mean"), F.lit(14.0).alias("target_std"))
    return validate.statistics(named, "path", 0.01)


@query(f"WITH {_STATS_SQL} SELECT category, severity, path, count(*) AS n FROM i WHERE severity IS NOT NULL GROUP BY ALL")
def m_statistics(s, d):
    """C226, M1-M3, M17: deviations as issue rows."""
    return _stat_issues(s, d).groupBy("category", "severity", "path").agg(F.count("*").alias("n"))


@query(f"""
    WITH {_STATS_SQL}, c AS (SELECT count(*) AS n, count(*) FILTER (severity = 'WARNING') AS w, count(*) FILTER (severity = 'ERROR') AS e FROM i WHERE severity IS NOT NULL)
    SELECT n AS n_issues, w AS n_warning, e AS n_error, e = 0 AS valid, round(CAST(1 - least(1.0, 0.05 * w + 0.2 * e) AS DOUBLE), 6) AS structural,
        round(CAST(0.3 * (1 - least(1.0, 0.05 * w + 0.2 * e)) + 0.7 AS DOUBLE), 6) AS score FROM c
""")
def m_tally(s, d):
    """Severities, validity, scores."""
    g = validate.tally(_stat_issues(s, d))
    return g.select("n_issues", "n_warning", "n_error", "valid", F.round("structural", 6).alias("structural"), F.round("score", 6).alias("score"))


@query(f"""
    WITH {TWO_MODELS} SELECT a.name, CASE WHEN len(a.shape) <> len(b.shape) THEN 'CRITICAL' WHEN a.shape <> b.shape THEN 'ERROR' END AS shape_issue,
        CASE WHEN a.dtype <> b.dtype THEN 'ERROR' END AS dtype_issue, CASE WHEN (a.dtype = 'I8') <> (b.dtype = 'I8') THEN 'WARNING' END AS mix_issue,
        len(a.shape) = len(b.shape) AND (len(b.shape) < 2 OR (a.shape[1] = b.shape[1] AND a.shape[2] = b.shape[2])) AS fits
    FROM a JOIN b ON a.name = b.name
""")
def m_shapes(s, d):
    """Shape and type rules on common tensors."""
    a, b = two_models(s, d)
    j = a.alias("a").join(b.alias("b"), "name")
    x, y = F.col("a.shape"), F.col("b.shape")
    p, q = F.col("a.dtype"), F.col("b.dtype")
    return j.select(
        "name", validate.shape_severity(y, x).alias("shape_issue"), validate.dtype_severity(q, p).alias("dtype_issue"),
        validate.dtype_pair_severity(dtypes.kind(p), dtypes.kind(q), "add").alias("mix_issue"), linalg.broadcastable(x, y).alias("fits"),
    )


# ---- transcripts and numeric shapes


@query("""
    WITH o AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx FROM conversations)
    SELECT conv_id, max(CASE WHEN role IN ('user', 'developer') THEN idx ELSE -1 END) AS last_user_idx, count(*) AS n FROM o GROUP BY 1
""")
def q_last_user(s, d):
    """Q1."""
    g = transcripts.last_user_index(read(s, d, "conversations"))
    return g.groupBy("conv_id").agg(F.max("last_user_idx").cast("bigint").alias("last_user_idx"), F.count("*").alias("n"))


@query("""
    WITH o AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, lag(role) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    i AS (SELECT *, sum(CASE WHEN role = 'user' AND before = 'user' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM o),
    m AS (SELECT conv_id, island, min(turn) AS turn, first(role ORDER BY turn) AS role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM i GROUP BY 1, 2),
    n AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS following FROM m),
    p AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN '<｜User｜>' || text || CASE WHEN following IS NULL OR following = 'assistant' THEN '<｜Assistant｜></think>' ELSE '' END WHEN 'assistant' THEN text || '<｜end▁of▁sentence｜>' ELSE text END AS piece FROM n)
    SELECT conv_id, sha256('<｜begin▁of▁sentence｜>' || string_agg(piece, '' ORDER BY turn)) AS digest FROM p GROUP BY 1
""")
def q_encode(s, d):
    """Q2, Q5, Q6: merged turns, rendered and joined."""
    c = read(s, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))
    return transcripts.encode(c).select("conv_id", F.sha2("text", 256).alias("digest"))


@query("""
    WITH x AS (SELECT vec_id AS id, unnest(range(64)) AS expert, unnest(CAST(embedding AS DOUBLE[])) AS raw FROM embeddings),
    s AS (SELECT id, expert, 1 / (1 + exp(-raw * 4)) AS score FROM x),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, expert) AS rank FROM s)
    SELECT id, expert, rank, round(2.5 * score / sum(score) OVER (PARTITION BY id), 6) AS weight FROM r WHERE rank <= 4
""")
def r_gate(s, d):
    """Top experts with renormalised weights."""
    e = read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("expert", "raw"))
    scores = e.select("id", "expert", (1 / (1 + F.exp(-F.col("raw").cast("double") * 4))).alias("score"))
    return rounded(numeric.gate(scores, 4, 2.5), 6)


@query("""
    WITH x AS (SELECT event_id // 32 AS block, event_id, value FROM events), m AS (SELECT *, greatest(max(abs(value)) OVER (PARTITION BY block), 1e-4) / 448 AS scale FROM x)
    SELECT event_id, round(scale, 6) AS scale, round(greatest(-448.0, least(448.0, value / scale)), 3) AS scaled FROM m
""")
def r_quantise(s, d):
    """Scales of blocks."""
    g = numeric.block_quantise(read(s, d, "events"), "value", "event_id", 32, 448.0)
    return g.select("event_id", F.round("scale", 6).alias("scale"), F.round("scaled", 3).alias("scaled"))


@query()
def r_sample(s, d):
    """R2: a token by Gumbel noise (seeded; no SQL form)."""
    e = read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("token", "logit"))
    return numeric.sample(e.withColumn("logit", F.col("logit").cast("double")), 3)


@query("""
    SELECT code, CAST(CASE WHEN code >= 8 THEN -1 ELSE 1 END * [0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0][code % 8 + 1] AS DOUBLE) AS val FROM range(16) t(code)
""")
def r_nibbles(s, d):
    """Values of four-bit floats."""
    return s.range(16).select(F.col("id").alias("code"), (numeric.nibble_values(F.col("id").cast("int")) + 0.0).alias("val"))


# ---- extras: what Spark adds


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def x_cube(s, d):
    """Extra: cube."""
    return rounded(_lines(s, d).cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")), 2)


@query("SELECT CAST(epoch(time_bucket(INTERVAL '1 hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def x_windows(s, d):
    """Extra: tumbling event-time windows in a batch."""
    w = read(s, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.unix_timestamp("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
