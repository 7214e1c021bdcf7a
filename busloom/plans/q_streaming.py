"""The live transforms on the tables at rest (X); the stream form is compared in the tests."""

from pyspark.sql import functions as F

from busloom.plans.q_delay import epoch, rounded, seg_of
from busloom.plans.registry import query
from busloom.plans.standins import Bus, oracle
from busloom.streaming import live as L


@query("x03_heartbeat", oracle("positions", """
SELECT ts_coleta // 60 * 60 AS minuto, count(*) AS amostras FROM positions GROUP BY 1"""))
def x03(spark, sf):
    return epoch(L.heartbeat(Bus(spark, sf).positions), "minuto").drop("veiculos")


@query("x04_rolling_delay", oracle("segments", """
SELECT (t_chegada // 300 - i) * 300 + 1800 AS ate, cl, ordem_origem, count(*) AS n, round(avg(atraso_s), 6) AS atraso_medio_s
FROM segments, (SELECT unnest(generate_series(0, 5)) AS i) GROUP BY 1, 2, 3"""))
def x04(spark, sf):
    return rounded(epoch(L.rolling_delay(seg_of(Bus(spark, sf))), "ate"), "atraso_medio_s")


@query("x05_trip_sessions", oracle("gps", """
, c AS (SELECT *, CASE WHEN ta - lag(ta) OVER w <= 900 THEN 0 ELSE 1 END AS corte FROM gps WINDOW w AS (PARTITION BY cl, prefixo ORDER BY ta, rid)),
s AS (SELECT *, sum(corte) OVER (PARTITION BY cl, prefixo ORDER BY ta, rid) AS k FROM c)
SELECT cl, prefixo, min(ta) AS inicio, max(ta) AS fim, count(*) AS amostras FROM s GROUP BY cl, prefixo, k""".strip()))
def x05(spark, sf):
    return epoch(L.trip_sessions(Bus(spark, sf).gps), "inicio", "fim")
