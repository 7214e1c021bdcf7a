"""Clustering queries (C) and the episode reports."""

from pyspark.sql import functions as F

from busloom.functions import calendar as cal
from busloom.functions.geo import sql_x, sql_y
from busloom.operators import clusters as C
from busloom.operators import dbscan as DB
from busloom.operators import spatial as S
from busloom.operators.reports import modal_value
from busloom.plans.q_delay import pairs_of, rounded, seg_of
from busloom.plans.q_geo import ZONE_CELL
from busloom.plans.q_reports import typed_segments
from busloom.plans.registry import query
from busloom.plans.standins import Bus, derive, oracle, sql_draw, sql_hour
from busloom.session import cut_lineage

derive("late", ["segments"], f"""
SELECT t0id AS id, dia, t_chegada AS t, {sql_x('lon')} AS x, {sql_y('lat')} AS y, atraso_s AS valor, cp_destino AS cp, letreiro, prefixo, viagem_id, lat, lon, hora, regiao_origem, regiao_destino
FROM (SELECT *, CAST(split_part(viagem_id, '-', 3) AS BIGINT) * 10 + ordem_origem AS t0id, {sql_hour('t_chegada')} AS hh FROM segments) WHERE atrasado = 1""")


derive("segz", ["segments", "zone_edges"], """
SELECT s.*, zona FROM segments s LEFT JOIN (SELECT lat, lon, arg_min(zona, ordem) AS zona FROM (
  SELECT p.lat, p.lon, z.zona, z.ordem FROM (SELECT DISTINCT lat, lon FROM segments) p JOIN zone_edges z
    ON (z.y1 > p.lat) <> (z.y2 > p.lat) AND p.lon < (z.x2 - z.x1) * (p.lat - z.y1) / (z.y2 - z.y1) + z.x1
  GROUP BY ALL HAVING count(*) % 2 = 1) GROUP BY 1, 2) USING (lat, lon)""")


def dbscan_sql(src: str, eps: float | str, minp: int, eps_t: float | None = None, by: str | None = None) -> str:
    """Brute force as SQL: neighbours, cores, transitive closure over cores, lowest cluster for borders. `eps` may name a column."""
    reach = f"pow(a.{eps}, 2)" if isinstance(eps, str) else eps * eps
    b = f"a.{by} = b.{by} AND " if by else ""
    t = f" AND abs(a.t - b.t) <= {eps_t}" if eps_t else ""
    return f"""
, nb AS (SELECT a.id AS u, b.id AS v FROM {src} a JOIN {src} b ON {b}pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= {reach}{t}),
co AS (SELECT u AS id FROM nb GROUP BY u HAVING count(*) >= {minp}),
ce AS (SELECT u, v FROM nb WHERE u IN (SELECT id FROM co) AND v IN (SELECT id FROM co)),
r AS (SELECT id AS v, id AS c FROM co UNION SELECT ce.v, r.c FROM r JOIN ce ON ce.u = r.v),
k AS (SELECT v AS id, min(c) AS rotulo FROM r GROUP BY v),
lab AS (SELECT s.id, s.id IN (SELECT id FROM co) AS nucleo, coalesce(k.rotulo, bd.rotulo, -1) AS rotulo FROM {src} s LEFT JOIN k ON k.id = s.id
  LEFT JOIN (SELECT nb.u AS id, min(k.rotulo) AS rotulo FROM nb JOIN k ON k.id = nb.v GROUP BY 1) bd ON bd.id = s.id)"""


def rec(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


#: What late passages are made of: the places, instants and ids that are clustered, and what is reported of them.
PLACED = ["viagem_id", "ordem_origem", "t_origem", "t_chegada", "lat", "lon", "atrasado"]
REPORTED = ["atraso_s", "cp_destino", "letreiro", "prefixo", "hora", "regiao_origem", "regiao_destino"]


def late_of(seg):
    s = seg.where("atrasado = 1")
    pid = F.split("viagem_id", "-")[2].cast("long") * 10 + F.col("ordem_origem")
    names = {"atraso_s": "valor", "cp_destino": "cp"}
    return C.with_xy(s).select(
        pid.alias("id"), cal.local_date("t_origem").alias("dia"), F.col("t_chegada").alias("t"), "x", "y", "viagem_id", "lat", "lon",
        F.unix_seconds("t_chegada").alias("ts"), *[F.col(c).alias(names.get(c, c)) for c in REPORTED if c in seg.columns])


@query("c01_unified_base", oracle("pairs", """
SELECT CAST(erro_s AS DOUBLE) AS valor, CAST(erro_s >= 300 AS INTEGER) AS evento, cp, letreiro, viagem_id FROM pairs"""))
def c01(spark, sf):
    return C.unified_base(pairs_of(Bus(spark, sf)), "erro_s", F.col("erro_s") >= 300, "t_chegada", "cp").select("valor", "evento", "cp", "letreiro", "viagem_id")


@query("c02_stop_samples", oracle("segments", """
SELECT cp_destino AS cp, count(*) AS n, round(avg(atraso_s), 6) AS media, round(avg(atrasado), 6) AS taxa, median(atraso_s) AS mediana, round(quantile_cont(atraso_s, 0.9), 6) AS p90
FROM segments GROUP BY 1 HAVING count(*) >= 20"""))
def c02(spark, sf):
    b = C.unified_base(seg_of(Bus(spark, sf)), "atraso_s", F.col("atrasado") == 1, "t_chegada", "cp_destino")
    return rounded(C.stop_samples(b), "media", "taxa", "p90").select("cp", "n", "media", "taxa", "mediana", "p90")


@query("c03_weighted_kmeans")
def c03(spark, sf):
    b = C.unified_base(seg_of(Bus(spark, sf)), "atraso_s", F.col("atrasado") == 1, "t_chegada", "cp_destino")
    return C.weighted_kmeans(cut_lineage(C.event_samples(b)), 8).groupBy("rotulo").agg(F.count("*").alias("n"), F.sum("peso").alias("peso"))


derive("pts", ["points"], "SELECT vec_id AS id, x, y, t FROM points")


@query("c04_dbscan", rec(oracle("pts", dbscan_sql("pts", 150.0, 5).strip() + " SELECT * FROM lab")))
def c04(spark, sf):
    p = Bus(spark, sf).points.withColumnRenamed("vec_id", "id")
    return DB.st_dbscan(p, "id", "x", "y", 150.0, 5)


@query("c05_level_sweep", rec(oracle("pts", f"""
, lv AS (SELECT id * 10 + k AS id, id AS pid, x, y, k AS g, raio FROM pts, (VALUES (0, 100.0::DOUBLE), (1, 150.0), (2, 250.0)) v(k, raio))
{dbscan_sql("lv", "raio", 5, by="g").strip()},
m AS (SELECT pid, g, rotulo // 10 AS rotulo FROM lv JOIN lab ON lab.id = lv.id WHERE rotulo <> -1),
b AS (SELECT pid, rotulo FROM m JOIN (SELECT rotulo, count(DISTINCT g) AS vida FROM m GROUP BY 1) USING (rotulo) QUALIFY row_number() OVER (PARTITION BY pid ORDER BY vida DESC, g) = 1)
SELECT id AS vec_id, coalesce(rotulo, -1) AS rotulo FROM pts LEFT JOIN b ON b.pid = pts.id""".strip())))
def c05(spark, sf):
    return DB.level_sweep(Bus(spark, sf).points, "vec_id", "x", "y", [100.0, 150.0, 250.0], 5)


@query("c06_space_time_dbscan", rec(oracle("pts", dbscan_sql("pts", 400.0, 5, 10800.0).strip() + " SELECT * FROM lab")))
def c06(spark, sf):
    p = Bus(spark, sf).points.withColumnRenamed("vec_id", "id")
    return DB.st_dbscan(p, "id", "x", "y", 400.0, 5, t="t", eps_t=10800.0)


@query("c07_border_rule", rec(oracle("pts", dbscan_sql("pts", 200.0, 8).strip() + " SELECT id, rotulo FROM lab WHERE NOT nucleo")))
def c07(spark, sf):
    p = Bus(spark, sf).points.withColumnRenamed("vec_id", "id")
    return DB.st_dbscan(p, "id", "x", "y", 200.0, 8).where("NOT nucleo").select("id", "rotulo")


@query("c09_impacted_stops", oracle("segments", """
SELECT cp_destino AS cp, round(avg(atrasado), 6) AS taxa FROM segments GROUP BY 1 HAVING count(*) >= 20 AND avg(atrasado) >= (SELECT avg(atrasado) FROM segments)"""))
def c09(spark, sf):
    b = C.unified_base(seg_of(Bus(spark, sf)), "atraso_s", F.col("atrasado") == 1, "t_chegada", "cp_destino")
    return rounded(C.impacted_stops(C.stop_samples(b), b), "taxa").select("cp", "taxa")


def daily(seg):
    """Late passages with their episode label."""
    late = cut_lineage(late_of(seg))
    lab = DB.st_dbscan(late, "id", "x", "y", 400.0, 4, by=["dia"], t="ts", eps_t=7200.0)
    return late.join(lab.drop("nucleo"), ["dia", "id"])


EP = dbscan_sql("late", 400.0, 4, 7200.0, "dia").strip() + ", ep AS (SELECT late.*, rotulo FROM late JOIN lab ON lab.id = late.id)"


def ep(body, uses="late"):
    return rec(oracle(uses, EP + body))


@query("c10_cluster_summary", ep("""
, mid AS (SELECT dia, rotulo, avg(x) AS mx, avg(y) AS my FROM ep WHERE rotulo <> -1 GROUP BY 1, 2)
SELECT e.rotulo, count(*) AS n, round(avg(valor), 6) AS atraso_medio_s, count(DISTINCT cp) AS paradas, min(t) AS inicio, max(t) AS fim, round(quantile_cont(sqrt(pow(x - mx, 2) + pow(y - my, 2)), 0.9), 4) AS raio_m,
  median(valor) AS atraso_mediano_s, round(avg(valor) * count(*), 3) AS impacto FROM ep e JOIN mid m ON m.dia = e.dia AND m.rotulo = e.rotulo GROUP BY e.rotulo"""))
def c10(spark, sf):
    s = C.cluster_summary(daily(seg_of(Bus(spark, sf), *PLACED, *REPORTED)))
    s = rounded(rounded(rounded(s, "impacto", digits=3), "atraso_medio_s"), "raio_m", digits=4)
    return s.select("rotulo", "n", "atraso_medio_s", "paradas", F.unix_seconds("inicio").alias("inicio"), F.unix_seconds("fim").alias("fim"), "raio_m", "atraso_mediano_s", "impacto")


@query("c10_stop_clusters", rec(oracle("segments", f"""
, sp AS (SELECT cp_destino AS id, count(*) AS n, avg(atraso_s) AS media, avg(atrasado) AS taxa, avg(lat) AS lat, avg(lon) AS lon FROM segments GROUP BY 1 HAVING count(*) >= 20),
sxy AS (SELECT *, {sql_x('lon')} AS x, {sql_y('lat')} AS y FROM sp)
{dbscan_sql("sxy", 2500.0, 3).strip()}
SELECT rotulo, count(*) AS paradas, CAST(sum(n) AS BIGINT) AS observacoes, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, round(sum(media * n) / sum(n), 6) AS atraso_medio_s, round(sum(taxa * n) / sum(n), 6) AS prob_atraso,
  round(sum(media * n), 3) AS impacto FROM sxy JOIN lab USING (id) WHERE rotulo <> -1 GROUP BY 1""".strip())))
def c10_stops(spark, sf):
    b = C.unified_base(seg_of(Bus(spark, sf)), "atraso_s", F.col("atrasado") == 1, "t_chegada", "cp_destino")
    stops = cut_lineage(C.stop_samples(b))
    lab = DB.st_dbscan(stops, "cp", "x", "y", 2500.0, 3).drop("nucleo")
    s = C.stop_cluster_summary(stops.join(lab, "cp"))
    return rounded(rounded(s, "impacto", digits=3), "lat", "lon", "atraso_medio_s", "prob_atraso")


@query("c11_top_flows", ep("""
, f AS (SELECT rotulo, concat(regiao_origem, ' > ', regiao_destino) AS fl, count(*) AS n FROM ep WHERE rotulo <> -1 AND regiao_origem IS NOT NULL AND regiao_destino IS NOT NULL GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY rotulo ORDER BY count(*) DESC, fl) <= 5)
SELECT rotulo, string_agg(fl, '; ' ORDER BY n DESC, fl) AS fluxos FROM f GROUP BY 1"""))
def c11(spark, sf):
    return C.top_flows(daily(seg_of(Bus(spark, sf), *PLACED, *REPORTED))).select("rotulo", F.array_join("fluxos", "; ").alias("fluxos"))


@query("c12_label_back", rec(oracle("pts", dbscan_sql("pts", 150.0, 5).strip() + " SELECT pts.id, coalesce(rotulo, -3) AS rotulo FROM pts LEFT JOIN lab ON lab.id = pts.id")))
def c12(spark, sf):
    p = Bus(spark, sf).points.withColumnRenamed("vec_id", "id")
    return C.label_back(p.select("id"), DB.st_dbscan(p, "id", "x", "y", 150.0, 5), "id")


@query("c13_daily_episodes", ep(" SELECT CAST(dia AS BIGINT) AS dia, id, rotulo FROM ep"))
def c13(spark, sf):
    return daily(seg_of(Bus(spark, sf), *PLACED, *REPORTED)).select(F.datediff("dia", F.lit("1970-01-01").cast("date")).cast("long").alias("dia"), "id", "rotulo")


@query("c14_parameter_grid", rec(oracle("late", f"""
, grid AS (SELECT id * 10 + k AS id, dia * 10 + k AS g, dia, t, x, y, cp, eps FROM late, (VALUES (0, 300.0::DOUBLE), (1, 600.0)) v(k, eps))
{dbscan_sql("grid", "eps", 4, 7200.0, "g").strip()},
m AS (SELECT grid.*, rotulo FROM grid JOIN lab ON lab.id = grid.id),
e AS (SELECT eps, dia, rotulo, count(*) AS n, (max(t) - min(t)) / 60 AS dur FROM m WHERE rotulo <> -1 GROUP BY 1, 2, 3),
z AS (SELECT eps, count(*) AS episodios, max(n) AS maior, median(n) AS tamanho_mediano, round(median(dur), 6) AS duracao_mediana_min FROM e GROUP BY 1),
c AS (SELECT eps, count(*) FILTER (d >= 5) AS paradas_recorrentes FROM (SELECT eps, cp, count(DISTINCT dia) AS d FROM m WHERE rotulo <> -1 GROUP BY 1, 2) GROUP BY 1)
SELECT n.*, episodios, maior, tamanho_mediano, duracao_mediana_min, paradas_recorrentes FROM (SELECT eps, count(*) AS eventos, round(100 * avg(CASE WHEN rotulo = -1 THEN 1 ELSE 0 END), 6) AS ruido_pct FROM m GROUP BY 1) n
LEFT JOIN z ON z.eps = n.eps LEFT JOIN c ON c.eps = n.eps""".strip())))
def c14(spark, sf):
    late = cut_lineage(late_of(seg_of(Bus(spark, sf), *PLACED, *REPORTED)))
    grid = late.withColumn("eps", F.explode(F.array(F.lit(300.0), F.lit(600.0))))
    lab = DB.st_dbscan(grid, "id", "x", "y", F.col("eps"), 4, by=["eps", "dia"], t="ts", eps_t=7200.0)
    return rounded(C.grid_measures(cut_lineage(grid.join(lab.drop("nucleo"), ["eps", "dia", "id"])), ["eps"]), "ruido_pct", "duracao_mediana_min")


def zoned(b, df):
    return S.locate(df, S.zone_cells(b.zone_edges, "zona", "ordem", ZONE_CELL), ZONE_CELL)


@query("c15_episode_table", ep("""
 SELECT CAST(dia AS BIGINT) AS dia, rotulo, count(*) AS n, count(DISTINCT letreiro) AS linhas_n, round((max(t) - min(t)) / 60, 6) AS duracao_min, CAST((min(t) - 10800) // 3600 % 24 AS INTEGER) AS hora_inicio
FROM ep WHERE rotulo <> -1 GROUP BY 1, 2"""))
def c15(spark, sf):
    e = C.episode_table(daily(seg_of(Bus(spark, sf), *PLACED, *REPORTED)))
    return rounded(e, "duracao_min").select(F.datediff("dia", F.lit("1970-01-01").cast("date")).cast("long").alias("dia"), "rotulo", "n", F.size("linhas").cast("long").alias("linhas_n"), "duracao_min", "hora_inicio")


@query("c16_episodes_per_zone", ep("""
, z AS (SELECT dia, rotulo, zona FROM ep JOIN (SELECT DISTINCT lat, lon, zona FROM segz) USING (lat, lon) WHERE rotulo <> -1 AND zona IS NOT NULL
  GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY dia, rotulo ORDER BY count(*) DESC, zona) = 1),
e AS (SELECT zona, count(*) AS episodios, count(DISTINCT dia) AS dias FROM z GROUP BY 1)
SELECT p.zona, passagens, coalesce(episodios, 0) AS episodios, coalesce(dias, 0) AS dias, round(1e4 * coalesce(episodios, 0) / passagens, 6) AS por_10mil
FROM (SELECT zona, count(*) AS passagens FROM segz GROUP BY 1) p LEFT JOIN e ON e.zona = p.zona""", "late segz"))
def c16(spark, sf):
    b = Bus(spark, sf)
    s = seg_of(b, *PLACED)
    z = zoned(b, daily(s).where("rotulo <> -1").select("dia", "rotulo", "lat", "lon"))
    e = modal_value(z.where("zona IS NOT NULL"), ["dia", "rotulo"], "zona", "zona")
    return rounded(C.per_zone(e, zoned(b, s.select("lat", "lon")), "zona"), "por_10mil")


@query("c17_episode_profile", ep("""
, e AS (SELECT dia, rotulo, count(DISTINCT prefixo) AS v, count(DISTINCT viagem_id) AS g, count(DISTINCT letreiro) AS l FROM ep WHERE rotulo <> -1 GROUP BY 1, 2)
SELECT count(*) AS episodios, round(avg(CASE WHEN v = 1 THEN 1 ELSE 0 END), 6) AS um_veiculo, round(avg(CASE WHEN l >= 2 THEN 1 ELSE 0 END), 6) AS duas_linhas,
  median(v) AS veiculos_mediana, median(g) AS viagens_mediana, round(quantile_cont(l, 0.9), 6) AS linhas_p90 FROM e"""))
def c17(spark, sf):
    return rounded(C.episode_profile(daily(seg_of(Bus(spark, sf), *PLACED, *REPORTED))), "um_veiculo", "duas_linhas", "linhas_p90")


SHUFFLES = {"hora_tipo": (["cl", "sentido", "hora", "tipo"], 3), "hora_dia": (["cl", "sentido", "hora", "dia"], 2)}


def shuffle_sql(k: int, name: str) -> str:
    """Late passages of one way of shuffling: the first by md5 rank, as many as each group has; replicate 0 as observed."""
    groups, n = SHUFFLES[name]
    part = f"PARTITION BY r, {', '.join(groups)}"
    draws = ", ".join(f"({r})" for r in range(1, n + 1))
    return f"""SELECT {k} * 100 + r AS code, pid, dia, x, y, t, zona FROM (SELECT *, row_number() OVER ({part} ORDER BY {sql_draw('5', 'r', 'pid')}, pid) AS pos,
  sum(atrasado) OVER ({part}) AS late_n FROM base, (VALUES {draws}) v(r)) WHERE pos <= late_n
UNION ALL SELECT {k} * 100, pid, dia, x, y, t, zona FROM base WHERE atrasado = 1"""


@query("c18_permutation_test", rec(oracle("segz", f"""
, base AS (SELECT CAST(split_part(viagem_id, '-', 3) AS BIGINT) * 10 + ordem_origem AS pid, dia, cl, sentido, hora, tipo, zona, {sql_x('lon')} AS x, {sql_y('lat')} AS y, t_chegada AS t, atrasado FROM segz WHERE tipo = 'util'),
ev AS (SELECT *, pid * 1000 + code AS id, dia * 1000 + code AS g FROM ({' UNION ALL '.join(shuffle_sql(k, n) for k, n in enumerate(SHUFFLES))}))
{dbscan_sql("ev", 400.0, 4, 7200.0, "g").strip()},
zn AS (SELECT code, zona, count(DISTINCT dia) AS d FROM ev JOIN lab ON lab.id = ev.id WHERE rotulo <> -1 AND zona IS NOT NULL GROUP BY 1, 2),
z AS (SELECT code // 100 AS k, code % 100 AS r, count(*) FILTER (d >= 2) AS z FROM (SELECT DISTINCT code FROM ev) LEFT JOIN zn USING (code) GROUP BY 1, 2)
SELECT CASE a.k {' '.join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(SHUFFLES))} END AS modelo, o.z AS observado, count(*) AS repeticoes, round(avg(a.z), 6) AS media, min(a.z) AS minimo, max(a.z) AS maximo,
  round(avg(CASE WHEN a.z >= o.z THEN 1.0 ELSE 0.0 END), 6) AS fracao_igual_ou_acima FROM z a JOIN z o ON o.k = a.k AND o.r = 0 WHERE a.r > 0 GROUP BY a.k, o.z""".strip())))
def c18(spark, sf):
    b = Bus(spark, sf)
    pid = F.split("viagem_id", "-")[2].cast("long") * 10 + F.col("ordem_origem")
    s = zoned(b, C.with_xy(typed_segments(b).where("tipo = 'util'"))).withColumns({"id": pid, "ts": F.unix_seconds("t_chegada")})
    s = s.select("id", "x", "y", "ts", "dia", "cl", "sentido", "hora", "tipo", "zona", "atrasado")
    return rounded(C.permutation_test(s, "id", "zona", SHUFFLES, 2, 400.0, 7200.0, 4), "media", "fracao_igual_ou_acima")


@query("c19_episode_context", ep(f"""
, e AS (SELECT rotulo AS episodio, {sql_x('avg(lon)')} AS x, {sql_y('avg(lat)')} AS y, min(t) AS a, max(t) AS b FROM ep WHERE rotulo <> -1 GROUP BY dia, rotulo),
s AS (SELECT {sql_x('lon')} AS x, {sql_y('lat')} AS y, t_chegada AS t, atrasado FROM segments)
SELECT episodio, t // 900 * 900 AS bloco, count(*) AS n, round(avg(atrasado), 6) AS taxa FROM e JOIN s ON t BETWEEN a - 5400 AND b + 5400 AND pow(s.x - e.x, 2) + pow(s.y - e.y, 2) <= 490000 GROUP BY 1, 2"""))
def c19(spark, sf):
    b = Bus(spark, sf)
    e = cut_lineage(C.episode_table(daily(seg_of(b, *PLACED, *REPORTED))))
    return rounded(C.episode_context(e, seg_of(b).withColumn("t", F.col("t_chegada"))), "taxa").withColumn("bloco", F.unix_seconds("bloco"))


@query("q21_stop_recurrence", ep("""
 SELECT cp, count(DISTINCT dia) AS dias, count(DISTINCT rotulo) AS episodios, count(*) AS ocorrencias, median(valor) AS mediana_s FROM ep WHERE rotulo <> -1 GROUP BY 1"""))
def q21(spark, sf):
    d = daily(seg_of(Bus(spark, sf), *PLACED, *REPORTED)).where("rotulo <> -1")
    return C.summarize(d, ["cp"], [F.countDistinct("dia").alias("dias"), F.countDistinct("rotulo").alias("episodios"), F.count("*").alias("ocorrencias")], {"valor": {"mediana_s": 0.5}})


@query("q22_episode_filter", ep("""
 SELECT rotulo, count(*) AS n, round(avg(valor), 6) AS atraso_medio_s FROM ep WHERE rotulo <> -1 GROUP BY 1 HAVING count(*) >= 5 ORDER BY 3 DESC, 1 LIMIT 10"""))
def q22(spark, sf):
    e = C.cluster_summary(daily(seg_of(Bus(spark, sf), *PLACED, *REPORTED))).where("n >= 5")
    return rounded(e, "atraso_medio_s").orderBy(F.desc("atraso_medio_s"), "rotulo").limit(10).select("rotulo", "n", "atraso_medio_s")
