"""Explicit schemas; nothing is inferred."""

from pyspark.sql import types as T

_L, _D, _S, _I = T.LongType(), T.DoubleType(), T.StringType(), T.IntegerType()


def _struct(**cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols.items()])


# fixed values: the raw table, every value as text
RAW_TEXT = _struct(
    id_fluxo=_S, periodo=_S, anchor_id=_S, anchor_ip=_S, probe_id=_S, probe_ip=_S, msm_id=_S,
    ttl=_S, result=_S, dup=_S, rcvd=_S, sent=_S, min=_S, max=_S, avg=_S, timestamp=_S,
    type=_S, packets=_S, interval=_S,
)
# fixed values: the 24-hour trial table
TRIAL_TEXT = _struct(
    anchor_id=_S, anchor_ip=_S, probe_id=_S, probe_ip=_S, msm_id=_S, ttl=_S, result=_S, dup=_S,
    rcvd=_S, sent=_S, min=_S, max=_S, avg=_S, timestamp=_S, type=_S, packets=_S, interval=_S,
)
# fixed values: one stored prediction
PREDICTION = T.StructType([
    T.StructField("run_id", _S), T.StructField("ts_previsao", _S), T.StructField("fluxo_id", _S),
    T.StructField("anchor_id", _L), T.StructField("modelo_versao", _S),
    T.StructField("modelo_hash", _S), T.StructField("features", T.MapType(_S, _D)),
    T.StructField("proba", T.MapType(_S, _D)), T.StructField("classe_prevista", _S),
    T.StructField("classe_atual", _S), T.StructField("latencia_inferencia_ms", _L),
    T.StructField("rotulo_real", _S), T.StructField("ts_rotulo", _S),
])
# fixed values: one collection-log entry
COLLECTION_LOG = T.StructType([
    T.StructField("run_id", _S), T.StructField("fluxo_id", _S),
    T.StructField("situacoes", _struct(ok=_L, timeout=_L, invalida=_L, sem_resultado=_L, probe_offline=_L)),
])
# fixed values: one raw API ping result
API_RESULT = T.StructType([
    T.StructField("timestamp", _L), T.StructField("prb_id", _L), T.StructField("msm_id", _L),
    T.StructField("sent", _I), T.StructField("rcvd", _I), T.StructField("min", _D),
    T.StructField("max", _D), T.StructField("avg", _D), T.StructField("ttl", _I),
    T.StructField("result", _S), T.StructField("offline", T.BooleanType()),
    T.StructField("type", _S), T.StructField("af", _I), T.StructField("src_addr", _S),
    T.StructField("dst_addr", _S),
])
