"""Bus tables derived from the driver's tables, so domain operators run on them whole.

Each stand-in is one SQL text that Spark and DuckDB both read. Orders play the trips and lineitems
the stop passages: 29 lines, 7 stops each, 30 days. Instants are epoch seconds in the text;
on the Spark side the columns listed in TIMES become timestamps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from busloom.functions.geo import num
from busloom.operators.metrics import POISSON_CDF

TEXT: dict[str, str] = {}
TIMES: dict[str, list[str]] = {}
USES: dict[str, list[str]] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _add(name: str, text: str, uses: list[str], times: list[str] = ()):
    TEXT[name], USES[name], TIMES[name] = text, list(uses), list(times)


_add("passages", """
WITH b AS (
  SELECT l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS n, min(l_partkey * 7 + l_suppkey * 13) AS k
  FROM {lineitem} GROUP BY l_orderkey, CAST(l_linenumber AS BIGINT)
), c AS (
  SELECT o, n, k, o % 29 + 1 AS cl, 1704067200 + (o * 7919) % 2592000 AS t0 FROM b
), d AS (
  SELECT *, CASE WHEN CAST(floor(((t0 - 10800) % 86400) / 3600) AS BIGINT) IN (7, 8, 16, 17, 18)
                 THEN 40 ELSE 0 END AS slow
  FROM c
)
SELECT o, k, t0, cl, concat('L', CAST(cl % 15 AS VARCHAR(9))) AS letreiro, cl % 2 + 1 AS sentido,
  CAST(10000 + o % 211 AS VARCHAR(9)) AS prefixo,
  concat(CAST(cl AS VARCHAR(9)), '-', CAST(10000 + o % 211 AS VARCHAR(9)), '-', CAST(t0 AS VARCHAR(12))) AS viagem_id,
  (cl % 10) * 100 + n AS cp, n AS ordem,
  t0 + n * (240 + slow) + k % 200 + (CASE WHEN k % 17 = 0 THEN 300 ELSE 0 END) AS t_chegada,
  CASE WHEN k % 10 < 8 THEN 'cruzamento' ELSE 'aproximacao' END AS metodo,
  (k % 900) / 10 AS dist_min_m, (k % 5000) / 10 AS salto_m, (k % 600) / 10 AS salto_s,
  (30 + k % 71) / 100 AS confianca,
  -23.55 + ((((cl % 10) * 100 + n) * 37) % 1000 - 500) / 10000 + (k % 10) / 100000 AS lat,
  -46.63 + ((((cl % 10) * 100 + n) * 91) % 1000 - 500) / 10000 + (k % 7) / 100000 AS lon
FROM d
""", ["lineitem"], ["t_chegada"])

# a row for each lineitem, at least as many of each key as passages has: enough to see that no group is hot
_add("passage_rows", """
SELECT o % 29 + 1 AS cl, CAST(10000 + o % 211 AS VARCHAR(9)) AS prefixo, ((o % 29 + 1) % 10) * 100 + n AS cp, n AS ordem,
  concat(CAST(o % 29 + 1 AS VARCHAR(9)), '-', CAST(10000 + o % 211 AS VARCHAR(9)), '-', CAST(1704067200 + (o * 7919) % 2592000 AS VARCHAR(12))) AS viagem_id
FROM (SELECT l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS n FROM {lineitem})
""", ["lineitem"])

_add("arrivals", """
SELECT cl, letreiro, sentido, prefixo, viagem_id, cp, ordem, t_chegada, metodo, dist_min_m, salto_m,
  salto_s, confianca, lat, lon
FROM {passages}
""", ["passages"], ["t_chegada"])

_add("line_stops", """
SELECT cl, cp, min(ordem) AS ordem, CAST(min(ordem * 420 + (cp * ordem * 37) % 160) AS DOUBLE) AS s_m
FROM {passages} GROUP BY cl, cp
""", ["passages"])

_add("lines", """
SELECT cl, min(letreiro) AS letreiro, min(sentido) AS sentido,
  CASE WHEN cl % 11 = 0 THEN NULL ELSE concat('T', CAST(cl % 4 AS VARCHAR(9))) END AS terminal_principal,
  concat('T', CAST(cl % 5 + 2 AS VARCHAR(9))) AS terminal_secundario
FROM {passages} GROUP BY cl
""", ["passages"])

_add("stops", """
SELECT cp, CASE WHEN cp % 5 = 0 THEN '' ELSE concat('PARADA ', CAST(cp AS VARCHAR(9))) END AS nome,
  -23.55 + ((cp * 37) % 1000 - 500) / 10000 AS lat, -46.63 + ((cp * 91) % 1000 - 500) / 10000 AS lon
FROM {passages} GROUP BY cp
""", ["passages"])

_add("forecasts", """
WITH q AS (
  SELECT *, 1 AS j FROM {passages} UNION ALL SELECT *, 2 AS j FROM {passages}
), r AS (
  SELECT *, t_chegada - (120 + (k * 31 * j) % 1700) AS ts_coleta,
    CAST(floor((t_chegada - ((k * 17 * j) % 900 - 300)) / 60) AS BIGINT) * 60 AS t_previsto
  FROM q
)
SELECT cl, letreiro, sentido, cp, CASE WHEN k % 3 = 0 THEN '' ELSE concat('P', CAST(cp AS VARCHAR(9))) END AS parada_nome,
  CASE WHEN k % 9 = 0 THEN '99999' ELSE prefixo END AS prefixo, ts_coleta, t_previsto,
  t_previsto - ts_coleta AS horizonte_s, o * 100 + ordem * 10 + j AS qid
FROM r
""", ["passages"], ["ts_coleta", "t_previsto"])

_add("positions", """
SELECT event_id, CAST(user_id AS VARCHAR(20)) AS prefixo, CAST(length(event_type) AS BIGINT) AS cl,
  event_type AS letreiro, {secs} AS ta, {secs} + event_id % 45 AS ts_coleta, value,
  -23.55 + ((user_id * 37 + event_id) % 1000 - 500) / 10000 AS lat,
  -46.63 + ((user_id * 91 + event_id * 3) % 1000 - 500) / 10000 AS lon
FROM {events}
""", ["events"], ["ta", "ts_coleta"])

_add("points", """
SELECT vec_id, label, floor(10000 * {e1}) AS x, floor(10000 * {e2}) AS y, vec_id * 97 % 86400 AS t
FROM {embeddings}
""", ["embeddings"])

_add("track_points", """
SELECT user_id AS linha, event_id AS seq, event_id * 3 AS x, (event_id * 37) % 200 AS y FROM {events}
""", ["events"])

_add("probes", """
SELECT user_id AS linha, event_id AS pid, event_id * 3 + 7 AS x, (event_id * 37) % 200 + 11 + event_id % 90 AS y FROM {events}
""", ["events"])

_add("zone_edges", """
WITH z AS (
  SELECT n_name AS zona, CAST(n_nationkey AS BIGINT) AS ordem, -46.69 + (n_nationkey % 5) * 0.02 AS x0,
    -23.61 + CAST(floor(n_nationkey / 5) AS BIGINT) * 0.02 AS y0 FROM {nation}
), r AS (
  SELECT zona, ordem, x0 AS xa, y0 AS ya, 0.025 AS w FROM z
  UNION ALL SELECT zona, ordem, x0 + 0.008 AS xa, y0 + 0.008 AS ya, 0.006 AS w FROM z
)
SELECT zona, ordem, CAST(xa AS DOUBLE) AS x1, CAST(ya AS DOUBLE) AS y1, CAST(xa + w AS DOUBLE) AS x2, CAST(ya AS DOUBLE) AS y2 FROM r
UNION ALL SELECT zona, ordem, CAST(xa + w AS DOUBLE) AS x1, CAST(ya AS DOUBLE) AS y1, CAST(xa + w AS DOUBLE) AS x2, CAST(ya + w AS DOUBLE) AS y2 FROM r
UNION ALL SELECT zona, ordem, CAST(xa + w AS DOUBLE) AS x1, CAST(ya + w AS DOUBLE) AS y1, CAST(xa AS DOUBLE) AS x2, CAST(ya + w AS DOUBLE) AS y2 FROM r
UNION ALL SELECT zona, ordem, CAST(xa AS DOUBLE) AS x1, CAST(ya + w AS DOUBLE) AS y1, CAST(xa AS DOUBLE) AS x2, CAST(ya AS DOUBLE) AS y2 FROM r
""", ["nation"])

_add("trips", """
SELECT viagem_id AS trip_id, min(concat(letreiro, '-10')) AS route_id, min(sentido) - 1 AS direction_id,
  CASE WHEN min(o) % 50 = 0 THEN NULL ELSE concat('S', CAST(min(cl) AS VARCHAR(9))) END AS shape_id, min(cl) AS cl
FROM {passages} GROUP BY viagem_id
""", ["passages"])

_add("stop_times", """
SELECT viagem_id AS trip_id, cp AS stop_id, ordem AS stop_sequence, t_chegada - t0 AS arrival_s FROM {passages}
""", ["passages"])

_add("routes", """
SELECT concat(letreiro, '-10') AS route_id, CASE WHEN min(cl) % 7 = 0 THEN 1 ELSE 3 END AS route_type
FROM {passages} GROUP BY letreiro
""", ["passages"])

_add("frequencies", """
SELECT concat(letreiro, '-10-', CAST(sentido - 1 AS VARCHAR(3))) AS trip_id, o % 20 AS h0, o % 20 + o % 7 AS h1,
  CAST(300 + (o % 13) * 60 AS DOUBLE) AS headway_secs
FROM {passages} WHERE ordem = 1
""", ["passages"])

_add("gps", """
SELECT o * 10 + ordem AS rid, cl, prefixo, t_chegada AS ta, CAST(ordem * 420 + k % 91 - 45 AS DOUBLE) AS x, CAST(cl * 300 + k % 331 - 165 AS DOUBLE) AS y,
  CAST(ordem * 420 + k % 91 - 45 AS DOUBLE) AS s, CAST(abs(k % 331 - 165) AS DOUBLE) AS dist
FROM {passages}
""", ["passages"], ["ta"])

_add("gps_stops", """
SELECT cl, cp, min(ordem) AS ordem, CAST(min(ordem) * 420 AS DOUBLE) AS x, CAST(cl * 300 AS DOUBLE) AS y, CAST(min(ordem) * 420 AS DOUBLE) AS s_m
FROM {passages} GROUP BY cl, cp
""", ["passages"])

_DIALECT = {
    "spark": {
        "secs": "CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / 1000000) AS BIGINT)",
        "e1": "CAST(embedding[0] AS DOUBLE)", "e2": "CAST(embedding[1] AS DOUBLE)",
    },
    "duckdb": {
        "secs": "CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)",
        "e1": "CAST(embedding[1] AS DOUBLE)", "e2": "CAST(embedding[2] AS DOUBLE)",
    },
}


class Bus:
    """Stand-in tables of one scale folder, built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._built = spark, sf_dir, {}
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _raw(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._build(name)
        return self._built[name]

    def _build(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        parts = {u: self._raw(u) for u in USES[name]}
        text = TEXT[name]
        for k, v in _DIALECT["spark"].items():
            text = text.replace("{" + k + "}", v)
        return self.spark.sql(text, **parts)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TEXT:
            raise AttributeError(name)
        df = self._raw(name)
        return df.withColumns({c: F.timestamp_seconds(c) for c in TIMES[name]})


def duck(name: str) -> str:
    """The stand-in as DuckDB text reading its parents by name."""
    text = TEXT[name]
    for k, v in _DIALECT["duckdb"].items():
        text = text.replace("{" + k + "}", v)
    return text.replace("{", "").replace("}", "").strip()


_DERIVED: dict[str, tuple[list[str], str]] = {}


def derive(name: str, parents: list[str], text: str):
    """A further oracle table: SQL over other stand-ins or derived tables."""
    _DERIVED[name] = (parents, text)


def _order(names: list[str], seen: list[str]):
    for n in names:
        if n in TABLES or n in seen:
            continue
        _order(_DERIVED[n][0] if n in _DERIVED else USES[n], seen)
        seen.append(n)


def oracle(uses: str, body: str) -> str:
    """Oracle SQL: a WITH prelude of the tables in `uses`, then the body."""
    seen: list[str] = []
    _order(uses.split(), seen)
    ctes = [f"{n} AS ({_DERIVED[n][1] if n in _DERIVED else duck(n)})" for n in seen]
    return f"WITH {', '.join(ctes)} {body}" if ctes else body


# -- oracle forms of the local calendar on epoch seconds
def sql_hour(t: str) -> str:
    return f"((({t}) - 10800) // 3600) % 24"


def sql_weekday(t: str) -> str:
    return f"((({t}) - 10800) // 86400 + 3) % 7"


def sql_date(t: str) -> str:
    return f"(({t}) - 10800) // 86400"


def sql_part(h: str) -> str:
    return (
        f"CASE WHEN {h} < 6 THEN 'madrugada' WHEN {h} < 9 THEN 'pico_manha' WHEN {h} < 16 THEN "
        f"'entrepico' WHEN {h} < 20 THEN 'pico_tarde' ELSE 'noite' END"
    )


# -- oracle forms of draws fixed by md5
def sql_draw(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13))::BIGINT"


def sql_poisson(*parts: str) -> str:
    return f"len(list_filter({POISSON_CDF}::DOUBLE[], lambda p: {sql_draw(*parts)} / {1 << 52}::DOUBLE >= p))"


__all__ = ["Bus", "oracle", "derive", "num"]
