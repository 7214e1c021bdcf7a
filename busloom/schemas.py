"""Explicit schemas of all tables and payloads, and the cast that enforces them at write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "tinyint": T.ByteType(),
    "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(), "date": T.DateType(),
}


def _s(columns: str) -> T.StructType:
    """From `name type` pairs; needs no running session, unlike a DDL string."""
    pairs = (c.split() for c in columns.split(","))
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in pairs])


# The data model.
TABLES = {
    "posicoes": _s(
        "ts_coleta timestamp, hr_api string, cl int, letreiro string, sentido tinyint, destino string, "
        "prefixo string, acessivel boolean, ta timestamp, lat double, lon double"
    ),
    "previsoes": _s(
        "ts_coleta timestamp, hr_api string, cl int, letreiro string, sentido tinyint, cp int, "
        "parada_nome string, parada_lat double, parada_lon double, prefixo string, acessivel boolean, "
        "t_previsto_str string, t_previsto timestamp, horizonte_s int, ta timestamp, lat double, lon double"
    ),
    "linhas": _s(
        "cl int, letreiro string, letreiro_completo string, tl int, sentido tinyint, circular boolean, "
        "terminal_principal string, terminal_secundario string, atualizado_em timestamp"
    ),
    "paradas": _s(
        "cp int, nome string, endereco string, lat double, lon double, celula string, atualizado_em timestamp"
    ),
    "linha_parada": _s(
        "cl int, cp int, ordem_api int, ordem int, s_m double, dist_tracado_m double, atualizado_em timestamp"
    ),
    "chegadas": _s(
        "cl int, letreiro string, sentido tinyint, prefixo string, viagem_id string, cp int, ordem int, "
        "t_chegada timestamp, metodo string, dist_min_m double, salto_m double, salto_s double, "
        "velocidade_kmh double, confianca float, lat double, lon double"
    ),
    "percursos": _s(
        "cl int, letreiro string, sentido tinyint, prefixo string, viagem_id string, trecho string, "
        "cp_origem bigint, cp_destino bigint, ordem_origem bigint, ordem_destino bigint, t_origem timestamp, "
        "t_chegada timestamp, tempo_percurso_s double, percurso_tipico_s double, n_referencia bigint, "
        "atraso_s double, atraso_rel double, atrasado tinyint, headway_s double, extensao_m double, "
        "velocidade_kmh double, hora tinyint, dia_semana tinyint, faixa string, pico tinyint, "
        "fim_de_semana tinyint, regiao_origem string, regiao_destino string, lat double, lon double, "
        "celula string, confianca float"
    ),
    "previsao_realizado": _s(
        "cl int, letreiro string, sentido tinyint, cp int, parada_nome string, prefixo string, "
        "viagem_id string, ts_coleta timestamp, t_previsto timestamp, t_chegada timestamp, horizonte_s int, "
        "erro_s int, erro_abs_s int, headway_obs_s int, lat double, lon double, celula string, "
        "dia_semana tinyint, hora tinyint, faixa string, confianca float"
    ),
    "frota": _s(
        "t timestamp, vel_ms double, cl_medidor int, prefixo string, cp_origem bigint, cp_destino bigint, dt date"
    ),
}

# Payload shapes as type strings for from_json.
VEHICLE_LIST = "array<struct<p:string,a:boolean,t:string,ta:string,py:double,px:double>>"
POSITIONS_PAYLOAD = (
    "hr string, l array<struct<c:string,cl:bigint,sl:int,lt0:string,lt1:string,qv:int,"
    f"vs:{VEHICLE_LIST}>>, vs {VEHICLE_LIST}"
)
SUBLINE_LIST = f"array<struct<c:string,cl:bigint,sl:int,vs:{VEHICLE_LIST}>>"
_STOP = f"struct<cp:bigint,np:string,py:double,px:double,vs:{VEHICLE_LIST},l:{SUBLINE_LIST}>"
FORECAST_PAYLOAD = f"hr string, ps array<{_STOP}>, p {_STOP}"


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of the schema in order, cast; missing ones become NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLES[table].fields
        ]
    )


def empty(spark, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])
