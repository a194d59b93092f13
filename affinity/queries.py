"""The queries of the engine over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.adapter import connections, connections_sql, raw_connections
from affinity.functions import dates, estimators, text
from affinity.operators import network, sections, temporal
from affinity.plans import analysis, insights as findings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _conn(sql: str) -> str:
    return connections_sql() + sql


def _days(spark: SparkSession, d: str) -> DataFrame:
    return temporal.day_counts(connections(spark, d))


def _share(part: str, whole: str) -> str:
    return f"coalesce(round(CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0), 4), 0)"


# --- overview, quality, text ---------------------------------------------------------------------
@_add(
    "overview",
    _conn("""SELECT count(*) AS connections, count(DISTINCT CASE WHEN company <> '' THEN company END) AS distinct_companies, count(*) FILTER (company <> '') AS with_company,
    count(*) FILTER (position <> '') AS with_position, count(connected_on) AS with_date, min(connected_on) AS first_connection, max(connected_on) AS last_connection,
    CAST(CASE WHEN count(connected_on) > 1 THEN max(connected_on) - min(connected_on) ELSE 0 END AS BIGINT) AS span_days FROM conn"""),
)
def overview(spark, d):
    return sections.overview(connections(spark, d))


@_add(
    "entity_resolution",
    _conn("""SELECT raw_distinct, canonical_distinct, greatest(raw_distinct - canonical_distinct, 0) AS merged,
    round(greatest(raw_distinct - canonical_distinct, 0) / greatest(raw_distinct, 1), 4) AS merge_rate
    FROM (SELECT count(DISTINCT CASE WHEN trim(company_raw) <> '' THEN trim(company_raw) END) AS raw_distinct, count(DISTINCT CASE WHEN company <> '' THEN company END) AS canonical_distinct FROM conn)"""),
)
def entity_resolution(spark, d):
    return sections.entity_resolution(connections(spark, d))


@_add(
    "data_quality",
    _conn("""SELECT rows, missing_company, missing_position, unparsed_dates, round(1 - missing_company / greatest(rows, 1), 4) AS company, round(1 - missing_position / greatest(rows, 1), 4) AS position,
    round(1 - unparsed_dates / greatest(rows, 1), 4) AS connected_on
    FROM (SELECT count(*) AS rows, count(*) FILTER (trim(company_raw) = '') AS missing_company, count(*) FILTER (trim(position_raw) = '') AS missing_position, count(*) FILTER (connected_on IS NULL) AS unparsed_dates FROM conn)"""),
)
def data_quality(spark, d):
    return sections.completeness(connections(spark, d))


@_add("canonical_company", _conn("SELECT DISTINCT company_raw, company FROM conn"))
def canonical_company(spark, d):
    return raw_connections(spark, d).select("company_raw", text.canonical_company(F.col("company_raw"), unicode=False).alias("company")).distinct()


@_add("clean_title", _conn("SELECT DISTINCT position_raw, position FROM conn"))
def clean_title(spark, d):
    return raw_connections(spark, d).select("position_raw", text.clean_title(F.col("position_raw"), unicode=False).alias("position")).distinct()


@_add("classify_seniority", _conn("SELECT DISTINCT position, seniority, seniority_rank FROM conn"))
def classify_seniority(spark, d):
    return connections(spark, d).select("position", "seniority", "seniority_rank").distinct()


@_add("classify_function", _conn("SELECT DISTINCT position, function FROM conn"))
def classify_function(spark, d):
    return connections(spark, d).select("position", "function").distinct()


@_add("date_parse", _conn("SELECT row_idx, connected_on_raw, connected_on, strftime(connected_on, '%Y-%m') AS month FROM conn"))
def date_parse(spark, d):
    return connections(spark, d).select("row_idx", "connected_on_raw", "connected_on", dates.month_key(F.col("connected_on")).alias("month"))


@_add("enriched", _conn("SELECT row_idx, company, position, connected_on, seniority, seniority_rank, function FROM conn"))
def enriched(spark, d):
    return connections(spark, d).select("row_idx", "company", "position", "connected_on", "seniority", "seniority_rank", "function")


@_add("text_search", _conn("SELECT row_idx, company, position FROM conn WHERE contains(lower(first_name || ' ' || last_name || ' ' || company || ' ' || position), 'engineer')"))
def text_search(spark, d):
    df = connections(spark, d)
    return df.filter(text.matches("Engineer", *map(F.col, ("first_name", "last_name", "company", "position")))).select("row_idx", "company", "position")


# --- employers -----------------------------------------------------------------------------------
_COUNTS = "counts AS (SELECT company, count(*) AS n, min(row_idx) AS first_idx FROM conn WHERE company <> '' GROUP BY company)"


@_add("company_top25", _conn(f", {_COUNTS} SELECT company, n AS count FROM counts ORDER BY n DESC, first_idx LIMIT 25"))
def company_top25(spark, d):
    return sections.top_companies(sections.company_counts(connections(spark, d)))


@_add("size_distribution", _conn(f", {_COUNTS} SELECT n AS size, count(*) AS companies FROM counts GROUP BY n"))
def size_distribution(spark, d):
    return sections.size_distribution(sections.company_counts(connections(spark, d)))


def _estimators_sql(values: str) -> str:
    """The estimators over a relation ``vals(v)``, from their definitions over the single values."""
    return f"""vals AS ({values}),
    placed AS (SELECT v, row_number() OVER (ORDER BY v) AS i, row_number() OVER (ORDER BY v DESC) AS r, sum(v) OVER () AS total, count(*) OVER () AS n FROM vals WHERE v >= 0),
    sums AS (SELECT any_value(n) AS n, any_value(total) AS total, sum(i * v) AS ix, count(*) FILTER (v > 0) AS m, sum((v / total) * (v / total)) FILTER (v > 0) AS sq, -sum((v / total) * ln(v / total)) FILTER (v > 0) AS h,
        sum(v) FILTER (r <= 10) AS top, count(*) FILTER (v >= 1) AS tail, sum(ln(v / 0.5)) FILTER (v >= 1) AS logs, count(*) FILTER (v = 1) AS single, median(v) AS med, quantile_cont(v, 0.95) AS p95 FROM placed),
    est AS (SELECT n, round(2 * ix / (n * total) - (n + 1) / n, 4) AS gini, CASE WHEN m = 1 THEN 1.0::DOUBLE ELSE round(greatest((sq - 1 / m) / (1 - 1 / m), 0), 4) END AS hhi, CASE WHEN m > 1 THEN round(h, 4) ELSE 0.0::DOUBLE END AS entropy,
        m, round(top / total, 4) AS top_k, CASE WHEN tail >= 10 AND logs > 0 THEN round(1 + tail / logs, 3) END AS alpha, single, med, round(p95, 2) AS p95 FROM sums),
    out AS (SELECT n AS "distinct", gini, hhi AS hhi_normalized, entropy AS shannon_entropy, CASE WHEN m > 1 THEN round(entropy / ln(m), 4) ELSE 0.0::DOUBLE END AS pielou_evenness, round(exp(entropy), 2) AS effective_companies,
        top_k AS top_10_share, round(single / n, 4) AS singleton_rate, alpha AS powerlaw_alpha,
        CASE WHEN alpha IS NULL THEN 'insufficient_data' WHEN alpha < 2 THEN 'extreme_hub_dominance' WHEN alpha < 3 THEN 'heavy_tailed' ELSE 'thin_tailed' END AS tail_regime, med AS median_cluster_size, p95 AS p95_cluster_size FROM est)
    SELECT * FROM out"""


@_add("concentration", _conn(f", {_COUNTS}, {_estimators_sql('SELECT CAST(n AS DOUBLE) AS v FROM counts')}"))
def concentration(spark, d):
    return sections.concentration(sections.company_counts(connections(spark, d)))


@_add("order_concentration", f"WITH {_estimators_sql('SELECT CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY o_custkey')}")
def order_concentration(spark, d):
    return sections.concentration(spark.read.parquet(f"{d}/orders.parquet").groupBy("o_custkey").count())


@_add("supplier_concentration", f"WITH {_estimators_sql('SELECT CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY l_suppkey')}")
def supplier_concentration(spark, d):
    return sections.concentration(spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_suppkey").count())


# --- time ----------------------------------------------------------------------------------------
_MONTHS = """dated AS (SELECT connected_on AS c FROM conn WHERE connected_on IS NOT NULL),
    cal AS (SELECT strftime(unnest(generate_series(CAST(date_trunc('month', min(c)) AS TIMESTAMP), CAST(date_trunc('month', max(c)) AS TIMESTAMP), INTERVAL 1 MONTH)), '%Y-%m') AS month FROM dated),
    months AS (SELECT month, (SELECT count(*) FROM dated WHERE strftime(c, '%Y-%m') = cal.month) AS count FROM cal)"""
_Z = """mid AS (SELECT median(count) AS med FROM months),
    dev AS (SELECT median(abs(count - med)) AS mad, avg(abs(count - med)) AS aad FROM months, mid),
    zs AS (SELECT month, count, round(CASE WHEN mad > 0 THEN 0.6745 * (count - med) / mad WHEN aad > 0 THEN 0.7979 * (count - med) / aad ELSE 0 END, 3)::DOUBLE AS z FROM months, mid, dev)"""


@_add("monthly_dense", _conn(f", {_MONTHS} SELECT month, count FROM months"))
def monthly_dense(spark, d):
    return temporal.monthly(_days(spark, d))


@_add("monthly_z", _conn(f", {_MONTHS}, {_Z} SELECT month, count, z FROM zs"))
def monthly_z(spark, d):
    return estimators.modified_z(temporal.monthly(_days(spark, d)), "count")


@_add("bursts", _conn(f", {_MONTHS}, {_Z} SELECT month, count, z FROM zs WHERE z >= 3.5"))
def bursts(spark, d):
    return temporal.bursts(temporal.monthly(_days(spark, d)))


@_add(
    "burst_series",
    "WITH months(month, count) AS (VALUES ('a', 2), ('b', 2), ('c', 3), ('d', 2), ('e', 40), ('f', 2), ('g', 3)), " + _Z + " SELECT month, CAST(count AS BIGINT) AS count, z FROM zs WHERE z >= 3.5",
)
def burst_series(spark, d):
    """A fixed series with one anomalous month."""
    return temporal.bursts(spark.createDataFrame([("a", 2), ("b", 2), ("c", 3), ("d", 2), ("e", 40), ("f", 2), ("g", 3)], "month string, count long"))


@_add("yearly", _conn("SELECT CAST(year(connected_on) AS BIGINT) AS year, count(*) AS count FROM conn WHERE connected_on IS NOT NULL GROUP BY 1"))
def yearly(spark, d):
    return temporal.yearly(_days(spark, d))


_GAPS = "placed AS (SELECT connected_on AS d, row_idx, row_number() OVER (ORDER BY connected_on, row_idx) AS i, count(*) OVER () AS n, lag(connected_on) OVER (ORDER BY connected_on, row_idx) AS p FROM conn WHERE connected_on IS NOT NULL)"


@_add(
    "half_life",
    _conn(f""", {_GAPS}, ends AS (SELECT min(d) AS a, max(d) AS b FROM placed), half AS (SELECT min(d) AS half_life FROM placed WHERE i >= n / 2)
    SELECT half_life, round((half_life - a) / nullif(b - a, 0), 4) AS elapsed_fraction FROM half, ends"""),
)
def half_life(spark, d):
    return temporal.half_life(_days(spark, d))


@_add("dormancy", _conn(f""", {_GAPS} SELECT CAST(d - p AS BIGINT) AS days, p AS "from", d AS "to" FROM placed WHERE p IS NOT NULL ORDER BY d - p DESC, p LIMIT 1"""))
def dormancy(spark, d):
    return temporal.longest_dormancy(_days(spark, d))


@_add(
    "velocity",
    _conn("""SELECT t AS trailing_12m, p AS prior_12m, round((t - p) / nullif(p, 0), 4) AS pct_change,
    CASE WHEN round((t - p) / nullif(p, 0), 4) > 0.1 THEN 'expanding' WHEN round((t - p) / nullif(p, 0), 4) < -0.1 THEN 'contracting' ELSE 'steady' END AS direction
    FROM (SELECT count(*) FILTER (connected_on > b - 365) AS t, count(*) FILTER (connected_on > b - 730 AND connected_on <= b - 365) AS p FROM conn, (SELECT max(connected_on) AS b FROM conn))"""),
)
def velocity(spark, d):
    return temporal.velocity(_days(spark, d))


@_add(
    "activity",
    _conn(f""", {_MONTHS}, {_Z}, a AS (SELECT count(*) FILTER (count > 0) AS active_months, count(*) AS total_months, median(count) AS median_month, coalesce(sum(count) FILTER (z >= 3.5), 0) AS burst, sum(count) AS total FROM zs),
    peak AS (SELECT month AS peak_month, count AS peak_count FROM zs ORDER BY count DESC, month LIMIT 1)
    SELECT active_months, total_months, {_share('active_months', 'total_months')} AS duty_cycle, median_month, peak_month, peak_count, {_share('burst', 'total')} AS burst_share_of_volume FROM a, peak"""),
)
def activity(spark, d):
    return temporal.activity(temporal.monthly(_days(spark, d)))


# --- composition ---------------------------------------------------------------------------------
@_add(
    "seniority_distribution",
    _conn(f"""SELECT t.tier, (SELECT count(*) FROM conn WHERE seniority = t.tier) AS count, CAST(t.rank AS INTEGER) AS rank
    FROM (VALUES {', '.join(f"('{x}', {k})" for k, x in enumerate(text.LADDER))}) t(tier, rank)"""),
)
def seniority_distribution(spark, d):
    return sections.seniority_distribution(connections(spark, d))


@_add(
    "seniority_summary",
    _conn(f"""SELECT {_share("count(*) FILTER (seniority <> 'unknown')", 'count(*)')} AS classified_rate, coalesce(round(avg(seniority_rank) FILTER (seniority <> 'unknown'), 3), 0) AS mean_rank,
    {_share("count(*) FILTER (seniority IN ('manager', 'director', 'executive', 'founder_owner'))", "greatest(count(*) FILTER (seniority <> 'unknown'), 1)")} AS leadership_share FROM conn"""),
)
def seniority_summary(spark, d):
    return sections.seniority_summary(connections(spark, d))


@_add("function_mix", _conn("SELECT function, count(*) AS count FROM conn WHERE function <> 'unclassified' GROUP BY function"))
def function_mix(spark, d):
    return sections.function_counts(connections(spark, d)).select("function", "count")


@_add(
    "function_summary",
    _conn(""", f AS (SELECT function, count(*) AS n, min(row_idx) AS i FROM conn WHERE function <> 'unclassified' GROUP BY function),
    t AS (SELECT sum(n) AS total, count(*) AS m FROM f), h AS (SELECT CASE WHEN any_value(m) > 1 THEN round(-sum(n / total * ln(n / total)), 4) ELSE 0.0::DOUBLE END AS entropy FROM f, t),
    top AS (SELECT function AS modal, n FROM f ORDER BY n DESC, i LIMIT 1)
    SELECT entropy, CASE WHEN m > 1 THEN round(entropy / ln(m), 4) ELSE 0.0::DOUBLE END AS evenness, round(exp(entropy), 2) AS effective_functions, modal, round(n / total, 4) AS homophily_index FROM h, t, top"""),
)
def function_summary(spark, d):
    return sections.function_summary(sections.function_counts(connections(spark, d)))


_YEARS = "years AS (SELECT CAST(year(connected_on) AS BIGINT) AS year, round(avg(seniority_rank), 3) AS mean_rank, count(*) AS n FROM conn WHERE connected_on IS NOT NULL AND seniority <> 'unknown' GROUP BY 1 HAVING count(*) >= 3)"


@_add("seniority_by_year", _conn(f", {_YEARS} SELECT year, mean_rank, n FROM years"))
def seniority_by_year(spark, d):
    return sections.seniority_by_year(connections(spark, d))


@_add(
    "seniority_drift",
    _conn(f""", {_YEARS}, l AS (SELECT count(*) AS years, round(regr_slope(mean_rank, year), 4) AS s, round(regr_intercept(mean_rank, year), 4) AS b, round(CASE WHEN regr_syy(mean_rank, year) = 0 THEN 0 ELSE regr_r2(mean_rank, year) END, 4) AS r FROM years)
    SELECT years >= 3 AS available, years, CASE WHEN years >= 3 THEN s END AS slope_rank_per_year, CASE WHEN years >= 3 THEN b END AS intercept, CASE WHEN years >= 3 THEN r END AS r_squared,
    CASE WHEN years < 3 THEN NULL WHEN abs(s) > 0.02 AND r > 0.3 AND s > 0 THEN 'rising' WHEN abs(s) > 0.02 AND r > 0.3 THEN 'falling' ELSE 'flat' END AS interpretation FROM l"""),
)
def seniority_drift(spark, d):
    return sections.seniority_drift(sections.seniority_by_year(connections(spark, d)))


# --- structure -----------------------------------------------------------------------------------
def _structure_sql(counts: str, people: str) -> str:
    return f"""c AS (SELECT count(*) AS companies, coalesce(sum(n), 0) AS edges, coalesce(sum(n * (n - 1) / 2), 0) AS projected, coalesce(max(n), 0) AS largest, count(*) FILTER (n = 1) AS single FROM {counts}), p AS ({people})
    SELECT people, companies, CAST(edges AS BIGINT) AS edges, coalesce(round(edges / nullif(people * companies, 0), 6), 0)::DOUBLE AS density, CAST(people - edges AS BIGINT) AS unaffiliated_people, CAST(projected AS BIGINT) AS projection_edges,
    coalesce(round(2 * projected / nullif(people, 0), 3), 0)::DOUBLE AS mean_degree, greatest(largest - 1, 0) AS max_degree, coalesce(round(projected / nullif(people * (people - 1) / 2, 0), 6), 0)::DOUBLE AS projection_density,
    CAST(companies + people - edges AS BIGINT) AS components, coalesce(round(largest / nullif(people, 0), 4), 0)::DOUBLE AS largest_component_share, coalesce(round((people - edges + single) / nullif(people, 0), 4), 0)::DOUBLE AS isolate_share FROM c, p"""


@_add("structure", _conn(f", {_COUNTS}, {_structure_sql('counts', 'SELECT count(*) AS people FROM conn')}"))
def structure(spark, d):
    df = connections(spark, d)
    return sections.structure(sections.company_counts(df), df)


@_add("part_supplier_structure", f"WITH counts AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1), {_structure_sql('counts', 'SELECT count(*) AS people FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)')}")
def part_supplier_structure(spark, d):
    """Suppliers and the parts they deliver as a bipartite network."""
    pairs = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct()
    return sections.structure(pairs.groupBy("l_suppkey").count(), pairs)


_EDGES = f"""{_COUNTS}, member AS (SELECT strftime(connected_on, '%Y-%m') AS month, company, min(row_idx) AS idx FROM conn JOIN counts USING (company) WHERE n >= 2 AND connected_on IS NOT NULL GROUP BY 1, 2),
    firsts AS (SELECT month, min(idx) AS month_idx FROM member GROUP BY month),
    edges AS (SELECT a.company AS source, b.company AS target, count(*) AS weight, min(month_idx) AS first_idx FROM member a JOIN member b ON a.month = b.month AND a.company < b.company JOIN firsts f ON f.month = a.month GROUP BY 1, 2 HAVING count(*) >= 2)"""


def _edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    df = connections(spark, d)
    counts = sections.company_counts(df)
    return network.cooccurrence_edges(df, counts), counts


@_add("cooccurrence_edges", _conn(f", {_EDGES} SELECT source, target, weight FROM edges"))
def cooccurrence_edges(spark, d):
    return _edges(spark, d)[0].select("source", "target", "weight")


@_add("cooccurrence_top", _conn(f", {_EDGES} SELECT source, target, weight FROM edges ORDER BY weight DESC, first_idx, source, target LIMIT 30"))
def cooccurrence_top(spark, d):
    return network.top_edges(_edges(spark, d)[0])


_DEGREES = f"""{_EDGES}, ends AS (SELECT source AS company, first_idx, source, target, 0 AS e FROM edges UNION ALL SELECT target, first_idx, source, target, 1 FROM edges),
    degrees AS (SELECT company, count(*) AS degree, min((first_idx, source, target, e)) AS first FROM ends GROUP BY company)"""


@_add("bridges", _conn(f", {_DEGREES} SELECT company, degree, n AS size FROM degrees JOIN counts USING (company) ORDER BY degree DESC, first LIMIT 15"))
def bridges(spark, d):
    return network.bridges(*_edges(spark, d))


_REACH = f"""{_EDGES}, reach AS (SELECT source AS a, source AS b FROM edges UNION SELECT target, target FROM edges UNION SELECT r.a, CASE WHEN e.source = r.b THEN e.target ELSE e.source END FROM reach r JOIN edges e ON e.source = r.b OR e.target = r.b),
    parts AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a)"""


@_add("components", _conn(f", {_REACH} SELECT node, component FROM parts").replace("WITH picked", "WITH RECURSIVE picked", 1))
def components(spark, d):
    return network.connected_components(_edges(spark, d)[0])


@_add(
    "cooccurrence_summary",
    _conn(f""", {_REACH}, s AS (SELECT component, count(*) AS size FROM parts GROUP BY component)
    SELECT CAST(sum(size) AS BIGINT) AS nodes, (SELECT count(*) FROM edges) AS edges, coalesce(round((SELECT count(*) FROM edges) / nullif(sum(size) * (sum(size) - 1) / 2, 0), 6), 0)::DOUBLE AS density, count(*) AS components, max(size) AS largest_component FROM s""").replace("WITH picked", "WITH RECURSIVE picked", 1),
)
def cooccurrence_summary(spark, d):
    return network.cooccurrence_summary(_edges(spark, d)[0])


# --- eras ----------------------------------------------------------------------------------------
_ERAS = f"""{_GAPS}, rule AS (SELECT greatest(45.0, 3 * median(d - p)) AS threshold, greatest(5, CAST(floor((count(*) + 0) * 0.02) AS BIGINT)) AS least, any_value(n) AS n FROM placed),
    cand AS (SELECT coalesce(list(i - 1 ORDER BY i), []) AS spots FROM placed, rule WHERE p IS NOT NULL AND d - p > threshold),
    fold AS (SELECT list_reduce(list_prepend([CAST(0 AS BIGINT)], list_transform(spots, lambda x: [CAST(x AS BIGINT)])), lambda a, x: CASE WHEN x[1] - a[len(a)] >= least THEN list_concat(a, x) ELSE a END) AS cuts, least, threshold, n FROM cand, rule),
    kept AS (SELECT CASE WHEN len(cuts) > 1 AND n - cuts[len(cuts)] < least THEN cuts[1:len(cuts) - 1] ELSE cuts END AS cuts, least, threshold, n FROM fold),
    member AS (SELECT c.*, CAST(len(list_filter(cuts, lambda x: x <= i - 1)) - 1 AS BIGINT) AS era, least, threshold FROM placed JOIN conn c USING (row_idx), kept WHERE kept.n >= 12)"""


@_add("eras", _conn(f", {_ERAS} SELECT era, connected_on AS day, count(*) AS n, round(any_value(threshold), 1)::DOUBLE AS gap_threshold_days, any_value(least) AS min_segment_size FROM member GROUP BY era, connected_on"))
def eras(spark, d):
    return temporal.era_days(_days(spark, d))


def _with_eras(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    df = connections(spark, d)
    return df, temporal.era_days(temporal.day_counts(df))


@_add(
    "era_profile",
    _conn(f""", {_ERAS} SELECT era, min(connected_on) AS start, max(connected_on) AS "end", CAST(greatest(max(connected_on) - min(connected_on), 1) AS BIGINT) AS span_days, count(*) AS count,
    round(count(*) / (greatest(max(connected_on) - min(connected_on), 1) / 30.44::DOUBLE), 2) AS rate_per_month, round(avg(seniority_rank) FILTER (seniority <> 'unknown'), 2) AS mean_seniority_rank FROM member GROUP BY era"""),
)
def era_profile(spark, d):
    return temporal.era_profile(*_with_eras(spark, d))


def _era_top_sql(column: str, none: str, k: int) -> str:
    return _conn(f""", {_ERAS}, c AS (SELECT era, {column}, count(*) AS count, min((connected_on, row_idx)) AS first FROM member WHERE {column} <> '{none}' GROUP BY 1, 2),
    r AS (SELECT era, row_number() OVER (PARTITION BY era ORDER BY count DESC, first) AS place, {column}, count FROM c) SELECT * FROM r WHERE place <= {k}""")


@_add("era_companies", _era_top_sql("company", "", 5))
def era_companies(spark, d):
    return temporal.era_top(*_with_eras(spark, d), "company", "", 5)


@_add("era_functions", _era_top_sql("function", "unclassified", 4))
def era_functions(spark, d):
    return temporal.era_top(*_with_eras(spark, d), "function", "unclassified", 4)


@_add(
    "distinctive_terms",
    _conn(f""", {_ERAS}, w AS (SELECT era, unnest(regexp_extract_all(lower(position), '{text.TITLE_TOKEN}')) AS term FROM member),
    l AS (SELECT era, term, count(*) AS count FROM w WHERE term NOT IN ({', '.join(repr(x) for x in text.TITLE_STOP_WORDS)}) GROUP BY 1, 2),
    g AS (SELECT term, sum(count) AS g FROM l GROUP BY 1), t AS (SELECT era, sum(count) AS lt FROM l GROUP BY 1), s AS (SELECT sum(count) AS gt FROM l),
    x AS (SELECT era, term, count, ln(((count + 1) / (lt + 2)) / ((g + 1) / (gt + 2))) AS s FROM l JOIN g USING (term) JOIN t USING (era), s WHERE count >= 2),
    r AS (SELECT era, row_number() OVER (PARTITION BY era ORDER BY s DESC, term DESC) AS place, term, count, round(s, 3) AS log_odds FROM x) SELECT * FROM r WHERE place <= 6"""),
)
def distinctive_terms(spark, d):
    return temporal.distinctive_terms(*_with_eras(spark, d))


# --- payload -------------------------------------------------------------------------------------
_PEOPLE = "people AS (SELECT *, row_number() OVER (ORDER BY row_idx) - 1 AS id, company AS key FROM (SELECT * FROM conn ORDER BY row_idx LIMIT 6000))"
_HUBS = "hubs AS (SELECT key, (SELECT count(*) FROM people) + row_number() OVER (ORDER BY min(id)) - 1 AS hub, count(*) AS members FROM people WHERE key <> '' GROUP BY key)"


@_add(
    "graph_nodes",
    _conn(f""", {_PEOPLE}, {_HUBS} SELECT id, 'person' AS kind, first_name || ' ' || last_name AS label, NULL::BIGINT AS members FROM people UNION ALL SELECT hub, 'hub', key, members FROM hubs"""),
)
def graph_nodes(spark, d):
    return network.graph_payload(connections(spark, d))[0].select("id", "kind", "label", "members")


@_add("graph_edges", _conn(f", {_PEOPLE}, {_HUBS} SELECT id AS person, hub FROM people JOIN hubs USING (key)"))
def graph_edges(spark, d):
    return network.graph_payload(connections(spark, d))[1]


@_add("graph_edges_by_year", _conn(f", {_PEOPLE.replace('company AS key', "coalesce(CAST(year(connected_on) AS VARCHAR), 'Undated') AS key")}, {_HUBS} SELECT id AS person, hub FROM people JOIN hubs USING (key)"))
def graph_edges_by_year(spark, d):
    return network.graph_payload(connections(spark, d), "year")[1]


@_add(
    "redacted_people",
    _conn("""SELECT row_idx, upper(first_name[1]) || '.' || upper(last_name[1]) || '.' AS name, company, position, seniority, seniority_rank, function, strftime(connected_on, '%Y-%m-%d') AS connected_on, '' AS url FROM conn"""),
)
def redacted_people(spark, d):
    return network.public_people(connections(spark, d), redact=True)


@_add(
    "public_people",
    _conn("""SELECT row_idx, first_name || ' ' || last_name AS name, company, position, seniority, seniority_rank, function, strftime(connected_on, '%Y-%m-%d') AS connected_on, url FROM conn"""),
)
def public_people(spark, d):
    return network.public_people(connections(spark, d))


# --- findings ------------------------------------------------------------------------------------
def _insights_sql() -> str:
    """The rules as conditions over the SQL of the sections, written out apart from the table of rules."""
    parts = {"o": "overview", "c": "concentration", "h": "half_life", "v": "velocity", "a": "activity", "s": "seniority_summary", "d": "seniority_drift", "f": "function_summary", "e": "entity_resolution", "q": "data_quality"}
    one = ", ".join(f"{k}_ AS (SELECT count(*) AS {k}_rows, {{}} FROM ({SQL[name]}))" for k, name in parts.items())
    columns = {
        "o": "any_value(connections) AS n, any_value(with_date) AS dated",
        "c": "any_value(singleton_rate) AS singles, any_value(tail_regime) AS regime, any_value(powerlaw_alpha) AS alpha",
        "h": "any_value(half_life) AS half_life, any_value(elapsed_fraction) AS part",
        "v": "any_value(prior_12m) AS prior",
        "a": "any_value(duty_cycle) AS duty",
        "s": "any_value(classified_rate) AS classified",
        "d": "any_value(interpretation) AS trend, any_value(r_squared) AS fit",
        "f": "any_value(modal) AS modal, any_value(homophily_index) AS homophily",
        "e": "any_value(merged) AS merged",
        "q": "least(any_value(company), any_value(position), any_value(connected_on)) AS filled",
    }
    one = one.format(*columns.values())
    return f"""WITH {one}, b_ AS (SELECT count(*) AS bursts FROM ({SQL['bursts']})), p_ AS (SELECT count(*) AS pairs FROM ({SQL['cooccurrence_edges']})), r_ AS (SELECT count(DISTINCT era) AS eras FROM ({SQL['eras']})),
    x AS (SELECT *, dated >= 2 AS timed FROM o_, c_, h_, v_, a_, s_, d_, f_, e_, q_, b_, p_, r_),
    found AS (
        SELECT 1 AS i, 'few_employers_weigh_most' AS rule, 'concentration' AS kind, n >= 150 AS sure, 'medium' AS other FROM x WHERE c_rows > 0
        UNION ALL SELECT 2, 'employers_of_one_person', 'structure', n >= 100, 'medium' FROM x WHERE singles >= 0.5
        UNION ALL SELECT 3, 'heavy_tail', 'distribution', FALSE, 'medium' FROM x WHERE regime IN ('heavy_tailed', 'extreme_hub_dominance') AND alpha <> 0
        UNION ALL SELECT 4, 'when_half_was_there', 'temporal', TRUE, '' FROM x WHERE timed AND part IS NOT NULL AND half_life IS NOT NULL
        UNION ALL SELECT 5, 'months_out_of_line', 'temporal', n >= 100, 'medium' FROM x WHERE timed AND bursts > 0
        UNION ALL SELECT 6, 'pace_of_late', 'temporal', FALSE, 'medium' FROM x WHERE timed AND prior > 0
        UNION ALL SELECT 7, 'episodes', 'temporal', TRUE, '' FROM x WHERE timed AND duty < 0.5
        UNION ALL SELECT 8, 'leaders', 'composition', n >= 150, 'medium' FROM x WHERE classified >= 0.4
        UNION ALL SELECT 9, 'trend_of_rank', 'composition', FALSE, CASE WHEN fit > 0.5 THEN 'medium' ELSE 'low' END FROM x WHERE trend <> 'flat'
        UNION ALL SELECT 10, 'one_function', 'composition', n >= 150, 'medium' FROM x WHERE modal IS NOT NULL AND homophily > 0
        UNION ALL SELECT 11, 'employers_in_step', 'structure', FALSE, 'medium' FROM x WHERE pairs > 0
        UNION ALL SELECT 12, 'only_one_hop', 'methodology', TRUE, '' FROM x
        UNION ALL SELECT 13, 'chapters', 'temporal', FALSE, 'medium' FROM x WHERE eras >= 2
        UNION ALL SELECT 14, 'spellings_merged', 'data_quality', TRUE, '' FROM x WHERE merged > 0
        UNION ALL SELECT 15, 'empty_fields', 'data_quality', TRUE, '' FROM x WHERE filled < 0.85),
    said AS (SELECT i, rule, kind, CASE WHEN sure THEN 'high' ELSE other END AS confidence FROM found WHERE (SELECT n FROM x) > 0)
    SELECT row_number() OVER (ORDER BY list_position(['high', 'medium', 'low'], confidence), kind, i) AS place, rule, kind, confidence FROM said"""


@_add("insights", _insights_sql())
def insights(spark, d):
    """Which rules of the findings hold, in their order."""
    doc = analysis.analyze(connections(spark, d), include_graph=False)
    rows = [(k, r.name, r.kind, sure) for k, (r, _, sure) in enumerate(findings.fired(doc), 1)]
    return spark.createDataFrame(rows, "place long, rule string, kind string, confidence string")
