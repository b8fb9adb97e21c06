"""Oracle SQL fragments (DuckDB dialect) shared by the registered queries.

Literals are written as ``CAST(... AS DOUBLE)`` and rounding as
floor(x*10^n+0.5)/10^n so both engines do the same IEEE arithmetic."""

WEBLOGS_CTE = """weblogs AS (
  SELECT event_id AS id,
         ts AS "timestamp",
         CASE user_id % 5 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT'
                          WHEN 3 THEN 'DELETE' ELSE 'PATCH' END AS method,
         '/api/' || event_type AS path,
         CAST(CASE WHEN event_type = 'error' THEN
                CASE event_id % 7 WHEN 0 THEN 400 WHEN 1 THEN 401 WHEN 2 THEN 403 WHEN 3 THEN 404
                                  WHEN 4 THEN 500 WHEN 5 THEN 502 ELSE 503 END
              ELSE CASE event_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 201 WHEN 2 THEN 204
                                     WHEN 3 THEN 301 ELSE 302 END END AS INTEGER) AS status_code,
         "value" * CAST(10 AS DOUBLE) AS response_time_ms,
         CAST(NULL AS VARCHAR) AS user_agent,
         CAST(NULL AS VARCHAR) AS ip_address,
         CAST(TRY_CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) * 100 AS INTEGER) AS bytes_sent
  FROM events)"""


def r(expr: str, digits: int) -> str:
    """Half-up rounding text identical to ``round_half_up``."""
    k = f"CAST({10 ** digits} AS DOUBLE)"
    return f"CAST(floor(({expr}) * {k} + CAST(0.5 AS DOUBLE)) / {k} AS DOUBLE)"


def with_weblogs(*ctes: str) -> str:
    parts = [WEBLOGS_CTE, *ctes]
    return "WITH " + ",\n".join(parts) + "\n"
