"""The evidence tables as DuckDB SQL."""

from __future__ import annotations

TENTHS = "[0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0]"


def numeric(source: str, label: str, features: list[str], name: str = "") -> str:
    """CTEs long, zero, edges, binned and woe (each with `name` appended) over the relation `source`."""
    union = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS v, {label} AS y FROM {source}" for f in features)
    return f"""
long{name} AS ({union}),
zero{name} AS (
  SELECT feature, coalesce(avg(CASE WHEN v = 0 THEN 1e0 WHEN v IS NOT NULL THEN 0e0 END), 0) >= 0.05e0 AS use_zero FROM long{name} GROUP BY feature
), edges{name} AS (
  SELECT z.feature, z.use_zero, coalesce(list_sort(list_distinct(q.q)), CAST([] AS DOUBLE[])) AS edges
  FROM zero{name} z LEFT JOIN (
    SELECT l.feature, quantile_cont(v, {TENTHS}) AS q FROM long{name} l JOIN zero{name} z USING (feature)
    WHERE v IS NOT NULL AND (NOT use_zero OR v <> 0) GROUP BY l.feature
  ) q USING (feature)
), binned{name} AS (
  SELECT feature, v, y,
         CASE WHEN v IS NULL THEN 'missing' WHEN use_zero AND v = 0 THEN 'zero' WHEN len(edges) < 2 THEN 'whole' ELSE 'interval' END AS bin_kind,
         CAST(CASE WHEN v IS NULL OR (use_zero AND v = 0) OR len(edges) < 2 THEN 0 ELSE len(list_filter(edges[2:len(edges) - 1], lambda e: v > e)) END AS INTEGER) AS bin_number
  FROM long{name} JOIN edges{name} USING (feature)
), count{name} AS (
  SELECT feature, bin_kind, bin_number, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_positive, CAST(count(*) - sum(y) AS BIGINT) AS n_negative FROM binned{name} GROUP BY ALL
), share{name} AS (
  SELECT *, (n_positive + 0.5e0) / sum(n_positive + 0.5e0) OVER (PARTITION BY feature) AS positive_share,
         (n_negative + 0.5e0) / sum(n_negative + 0.5e0) OVER (PARTITION BY feature) AS negative_share FROM count{name}
), woe{name} AS (
  SELECT *, ln(positive_share / negative_share) AS woe, (positive_share - negative_share) * ln(positive_share / negative_share) AS iv_term FROM share{name}
), iv{name} AS (SELECT feature, sum(iv_term) AS iv, count(*) AS n_bins FROM woe{name} GROUP BY feature)"""


def categorical(source: str, label: str, features: list[str], name: str = "c", least: float = 0.01) -> str:
    union = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS VARCHAR) AS c, {label} AS y FROM {source}" for f in features)
    return f"""
long{name} AS ({union}),
kept{name} AS (
  SELECT feature, c FROM (SELECT feature, c, count(*) AS n, sum(count(*)) OVER (PARTITION BY feature) AS total FROM long{name} WHERE c IS NOT NULL GROUP BY feature, c) WHERE n / total >= {least}
), binned{name} AS (
  SELECT l.feature, l.y, CASE WHEN l.c IS NULL THEN 'missing' WHEN k.c IS NOT NULL THEN 'category' ELSE 'other' END AS bin_kind, k.c AS category
  FROM long{name} l LEFT JOIN kept{name} k ON l.feature = k.feature AND l.c = k.c
), count{name} AS (
  SELECT feature, bin_kind, category, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_positive, CAST(count(*) - sum(y) AS BIGINT) AS n_negative FROM binned{name} GROUP BY ALL
), share{name} AS (
  SELECT *, (n_positive + 0.5e0) / sum(n_positive + 0.5e0) OVER (PARTITION BY feature) AS positive_share,
         (n_negative + 0.5e0) / sum(n_negative + 0.5e0) OVER (PARTITION BY feature) AS negative_share FROM count{name}
), woe{name} AS (
  SELECT *, ln(positive_share / negative_share) AS woe, (positive_share - negative_share) * ln(positive_share / negative_share) AS iv_term FROM share{name}
), iv{name} AS (SELECT feature, sum(iv_term) AS iv, count(*) AS n_bins FROM woe{name} GROUP BY feature)"""


BAND = "CASE WHEN iv < 0.02e0 THEN 'unpredictive' WHEN iv < 0.1e0 THEN 'weak' WHEN iv < 0.3e0 THEN 'medium' WHEN iv < 0.5e0 THEN 'strong' ELSE 'suspicious' END"
