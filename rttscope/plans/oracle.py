"""DuckDB text of the same stages, used only to check results.

``sql(body)`` prefixes a statement with the common table expressions it mentions.
"""

from __future__ import annotations

import re

from rttscope import contract as K
from rttscope.sources.adapter import (
    A_START, ANCHOR_COLUMNS, B_END, B_START, CONTINENT, COUNTRY, GAP_S, INTERVAL_S, MEASUREMENT_COLUMNS,
    PROBE_COLUMNS, TRAIN_DAYS, VALID_DAYS,
)


def _projection(columns: dict[str, str]) -> str:
    return ", ".join(f"{e.format(str='varchar', div='//')} AS {n}" for n, e in columns.items())



def _packet(nth: int, col: str) -> str:
    return (
        f"CASE WHEN rcvd >= {nth} THEN concat('{{\"rtt\":', CAST({col} // 100 AS VARCHAR), '.', "
        f"lpad(CAST({col} % 100 AS VARCHAR), 2, '0'), '}}') ELSE '{{\"x\":\"*\"}}' END"
    )


def _stat(value: str) -> str:
    return (
        "CASE WHEN rcvd = 0 THEN CAST(-1 AS DOUBLE) WHEN event_id % 11 = 0 THEN NULL "
        f"ELSE {value} END"
    )


def usage_sql(rows: str, interval_s: float) -> str:
    return f"""
  SELECT *, motivo = 'ok' AS usado FROM (
    SELECT *, CASE WHEN linhas = 0 THEN '{K.REASON_EMPTY}'
      WHEN cobertura IS NULL OR cobertura < 80 THEN concat('cobertura abaixo do mínimo (', printf('%.2f', cobertura), '%)')
      WHEN periodo = 'A' AND ttl_validos < 30 THEN '{K.REASON_FEW_TTL}' ELSE 'ok' END AS motivo
    FROM (SELECT * EXCLUDE (dur), dur / {float(interval_s)} AS esperado,
        round(100.0 * linhas / (dur / {float(interval_s)}), 4) AS cobertura
      FROM (SELECT f.probe_id, f.anchor_id, f.id_fluxo, p.periodo, p.dur,
          count(c.event_id) AS linhas, count(c.ttl) AS ttl_validos
        FROM (SELECT DISTINCT probe_id, anchor_id, id_fluxo FROM {rows}) f
        CROSS JOIN (VALUES ('A', {float(B_START - A_START)}), ('B', {float(B_END - B_START)})) p(periodo, dur)
        LEFT JOIN {rows} c ON c.id_fluxo = f.id_fluxo AND c.periodo = p.periodo
        GROUP BY ALL)))"""


def _frame(n: int) -> str:
    return f"OVER (PARTITION BY id_fluxo ORDER BY timestamp, msm_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_ROLL = ",\n    ".join(
    f"""avg(perda_pct) {_frame(n)} AS perda_media_w{n}, max(razao_rtt_p95) {_frame(n)} AS rtt_p95_max_w{n},
    max(razao_jitter_p95) {_frame(n)} AS jitter_p95_max_w{n},
    sum(CASE WHEN razao_rtt_p95 IS NULL THEN NULL WHEN razao_rtt_p95 > 1 THEN 1.0 ELSE 0.0 END) {_frame(n)} AS n_rtt_acima_p95_w{n}"""
    for n in K.WINDOWS
)
_Q = "quantile_cont({v}, {p})"

CTES: dict[str, str] = {
    "pings": f"""
  SELECT event_id, user_id % 5 AS probe_id, user_id % 2 AS anchor_id,
    concat(CAST(user_id % 5 AS VARCHAR), '_', CAST(user_id % 2 AS VARCHAR)) AS id_fluxo,
    1000 + user_id % 10 AS msm_id, ts_s AS timestamp, 3 AS sent, rcvd,
    CASE WHEN rcvd = 0 THEN NULL WHEN event_id % 50 = 0 THEN 120 ELSE 54 + event_id % 3 END AS ttl,
    concat('[', {_packet(1, 'c0')}, ',', {_packet(2, 'c1')}, ',', {_packet(3, 'c2')}, ']') AS result,
    {_stat('CAST(c0 AS DOUBLE) / 100')} AS min, {_stat('CAST(cmax AS DOUBLE) / 100')} AS max,
    {_stat('round(CAST(csum AS DOUBLE) / (100 * rcvd), 6)')} AS avg,
    CASE WHEN event_id % 97 = 0 THEN 'traceroute' ELSE 'ping' END AS type,
    CASE WHEN event_id % 101 = 0 THEN 6 ELSE 4 END AS af
  FROM (SELECT *, CASE rcvd WHEN 3 THEN c2 WHEN 2 THEN c1 ELSE c0 END AS cmax,
      CASE rcvd WHEN 3 THEN c0 + c1 + c2 WHEN 2 THEN c0 + c1 ELSE c0 END AS csum
    FROM (SELECT *, c0 + j * 25 AS c1, c0 + j * 50 AS c2, 3 - lost AS rcvd
      FROM (SELECT event_id, user_id, event_id % 7 AS j, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s,
        CAST(round(value * 100) AS BIGINT) + 500 AS c0,
        CASE WHEN event_type = 'error' THEN event_id % 4 ELSE 0 END AS lost FROM events)))""",
    "tagged": f"""
  SELECT *, CASE WHEN timestamp >= {A_START} AND timestamp < {B_START} THEN 'A'
    WHEN timestamp >= {B_START} AND timestamp < {B_END} THEN 'B' END AS periodo FROM pings""",
    "collected": """
  SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (
    PARTITION BY probe_id, msm_id, timestamp ORDER BY event_id) AS nth
    FROM tagged WHERE periodo IS NOT NULL) WHERE nth = 1""",
    "usage_rows": usage_sql("collected", INTERVAL_S),
    "classes": """
  SELECT probe_id, anchor_id, id_fluxo,
    CASE WHEN bool_or(usado AND periodo = 'A') AND bool_or(usado AND periodo = 'B') THEN 'A+B'
      WHEN bool_or(usado AND periodo = 'B') THEN 'B' WHEN bool_or(usado AND periodo = 'A') THEN 'A'
      ELSE 'nenhum' END AS classe_fluxo
  FROM usage_rows GROUP BY ALL""",
    "used": """
  SELECT c.*, classe_fluxo FROM collected c JOIN classes k USING (id_fluxo)
  WHERE contains(classe_fluxo, periodo)""",
    "instants": """
  SELECT *, rtt_avg AS latencia_ms FROM (
    SELECT *, CASE WHEN rcvd <> 0 THEN coalesce(CASE WHEN min >= 0 THEN min END, list_min(rtts)) END AS rtt_min,
      CASE WHEN rcvd <> 0 THEN coalesce(CASE WHEN max >= 0 THEN max END, list_max(rtts)) END AS rtt_max,
      CASE WHEN rcvd <> 0 THEN coalesce(CASE WHEN avg >= 0 THEN avg END, rtt_mean) END AS rtt_avg,
      CASE WHEN sent > 0 THEN CAST(sent - rcvd AS DOUBLE) / sent * 100 END AS perda_pct,
      CASE WHEN rcvd <> 0 THEN round(list_aggregate(rtts, 'stddev_pop'), 9) END AS jitter_ms
    FROM (SELECT *, CASE WHEN len(rtts) > 0 THEN list_sum(rtts) / len(rtts) END AS rtt_mean FROM (
      SELECT *, CASE WHEN rcvd = 0 THEN CAST([] AS DOUBLE[])
        ELSE list_transform(json_extract(result, '$[*].rtt'), lambda x: CAST(x AS DOUBLE)) END AS rtts
      FROM used WHERE type = 'ping')))""",
    "baseline": """
  SELECT k.anchor_id, k.probe_id, k.id_fluxo, coalesce(n, 0) AS n_amostras_A, coalesce(nr, 0) AS n_rtt_validos_A,
    CASE WHEN nr >= 30 THEN r50 END AS mediana_rtt_A, CASE WHEN nr >= 30 THEN r95 END AS p95_rtt_A,
    CASE WHEN nr >= 30 THEN r99 END AS p99_rtt_A, CASE WHEN nr >= 30 THEN j50 END AS mediana_jitter_A,
    CASE WHEN nr >= 30 THEN j95 END AS p95_jitter_A, CASE WHEN nr >= 30 THEN j99 END AS p99_jitter_A,
    CASE WHEN nt >= 30 THEN t50 END AS ttl_baseline, tmin AS ttl_min_A, tmax AS ttl_max_A,
    nullif(td, 0) AS n_ttl_distintos_A,
    CASE WHEN nr >= 30 THEN 'VALIDO' ELSE 'INSUFICIENTE' END AS status_baseline
  FROM classes k LEFT JOIN (
    SELECT id_fluxo, count(*) AS n, count(rtt_avg) AS nr, count(ttl) AS nt,
      quantile_cont(rtt_avg, 0.5) AS r50, quantile_cont(rtt_avg, 0.95) AS r95, quantile_cont(rtt_avg, 0.99) AS r99,
      quantile_cont(jitter_ms, 0.5) AS j50, quantile_cont(jitter_ms, 0.95) AS j95, quantile_cont(jitter_ms, 0.99) AS j99,
      median(ttl) AS t50, min(ttl) AS tmin, max(ttl) AS tmax, count(DISTINCT ttl) AS td
    FROM instants WHERE periodo = 'A' GROUP BY id_fluxo) USING (id_fluxo)
  WHERE classe_fluxo IN ('A+B', 'A')""",
    "processed": """
  SELECT i.*, ttl_baseline, p95_rtt_A, p99_rtt_A, p95_jitter_A, status_baseline,
    ttl - ttl_baseline AS delta_ttl, CAST(ttl - ttl_baseline <> 0 AS INTEGER) AS ttl_changed
  FROM instants i LEFT JOIN baseline b USING (id_fluxo) WHERE periodo = 'B'""",
    "labelled": f"""
  SELECT *, CASE WHEN motivo_rotulagem IN ('perda_severa', 'latencia_acima_p99') THEN 'FALHA'
    WHEN motivo_rotulagem IN ('perda_parcial', 'latencia_acima_p95', 'jitter_acima_p95') THEN 'RISCO'
    WHEN motivo_rotulagem = 'sem_alerta' THEN 'OK' END AS classe
  FROM (SELECT *, CASE WHEN status_baseline IS NULL THEN 'baseline_nao_encontrado'
    WHEN status_baseline <> 'VALIDO' THEN 'baseline_insuficiente'
    WHEN perda_pct IS NULL THEN 'perda_pct_vazio'
    WHEN perda_pct >= {K.LOSS_FAIL - K.LOSS_EPS} THEN 'perda_severa'
    WHEN latencia_ms > p99_rtt_A THEN 'latencia_acima_p99'
    WHEN perda_pct >= {K.LOSS_RISK - K.LOSS_EPS} THEN 'perda_parcial'
    WHEN latencia_ms > p95_rtt_A THEN 'latencia_acima_p95'
    WHEN jitter_ms > p95_jitter_A THEN 'jitter_acima_p95' ELSE 'sem_alerta' END AS motivo_rotulagem
  FROM processed)""",
    "stale": """
  SELECT anchor_id, probe_id, id_fluxo, avg(CAST(motivo_rotulagem = 'latencia_acima_p99' AS INTEGER)) AS fracao, count(*) AS n
  FROM labelled WHERE status_baseline = 'VALIDO' GROUP BY ALL HAVING fracao >= 0.5""",
    "series": """
  SELECT * FROM labelled WHERE status_baseline = 'VALIDO' AND id_fluxo NOT IN (SELECT id_fluxo FROM stale)""",
    "featured": """
  SELECT *, CAST(rtt_avg IS NULL AS INTEGER) AS rtt_ausente,
    rtt_avg / nullif(p95_rtt_A, 0) AS razao_rtt_p95, rtt_avg / nullif(p99_rtt_A, 0) AS razao_rtt_p99,
    jitter_ms / nullif(p95_jitter_A, 0) AS razao_jitter_p95,
    (rtt_max - rtt_min) / nullif(rtt_avg, 0) AS amplitude_rtt_rel,
    CASE WHEN delta_ttl IS NOT NULL THEN greatest(-16.0, least(16.0, delta_ttl)) END AS delta_ttl_clip,
    CAST(coalesce(abs(delta_ttl) >= 64, false) AS INTEGER) AS ttl_reset
  FROM series""",
    "candidates": f"""
  SELECT *, CASE WHEN classe IS NULL THEN 'perda_pct_vazio' WHEN gap_s IS NULL THEN 'sem_medicao_t_mais_h'
    WHEN alvo IS NULL THEN 'alvo_sem_rotulo' WHEN gap_s > {GAP_S} THEN 'intervalo_acima_de_gap' END AS motivo_descarte,
    CAST(row_number() OVER (PARTITION BY id_fluxo, ilha ORDER BY timestamp, msm_id)
      - CASE WHEN first_value(zera) OVER (PARTITION BY id_fluxo, ilha ORDER BY timestamp, msm_id) = 1 THEN 1 ELSE 0 END
      AS BIGINT) AS perdas_consecutivas
  FROM (SELECT *, sum(zera) OVER (PARTITION BY id_fluxo ORDER BY timestamp, msm_id) AS ilha FROM (
    SELECT *, CASE WHEN perda_pct > 0 THEN 0 ELSE 1 END AS zera,
    {_ROLL},
    row_number() OVER (PARTITION BY id_fluxo ORDER BY timestamp, msm_id) AS pos,
    lead(classe) OVER (PARTITION BY id_fluxo ORDER BY timestamp, msm_id) AS alvo,
    lead(timestamp) OVER (PARTITION BY id_fluxo ORDER BY timestamp, msm_id) - timestamp AS gap_s
    FROM featured))""",
    "split_rows": f"""
  SELECT c.*, CASE WHEN timestamp < t0 + {TRAIN_DAYS * 86400} THEN 'treino'
    WHEN timestamp < t0 + {TRAIN_DAYS * 86400 + K.EMBARGO_MIN * 60} THEN 'embargo'
    WHEN timestamp < t0 + {VALID_DAYS * 86400} THEN 'validacao'
    WHEN timestamp < t0 + {VALID_DAYS * 86400 + K.EMBARGO_MIN * 60} THEN 'embargo' ELSE 'teste' END AS split
  FROM candidates c, (SELECT min(timestamp) AS t0 FROM candidates WHERE motivo_descarte IS NULL)
  WHERE motivo_descarte IS NULL""",
    "final": "\n  SELECT id_fluxo, anchor_id, probe_id, timestamp, split, classe AS classe_atual,\n    "
    + ",\n    ".join(
        c if c in K.NO_SENTINEL else f"coalesce({c}, -1.0) AS {c}" for c in K.FEATURES
    )
    + ", alvo\n  FROM split_rows WHERE split <> 'embargo'",
}

CTES.update({
    "country_dim": f"""
  SELECT n_nationkey, {COUNTRY} AS country, {CONTINENT} AS continent, r_name AS region
  FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "anchor_dim": f"""
  SELECT {_projection(ANCHOR_COLUMNS)} FROM supplier JOIN country_dim ON s_nationkey = n_nationkey""",
    "msm_dim": f"""
  SELECT {_projection(MEASUREMENT_COLUMNS)}
  FROM (SELECT anchor_id, fqdn, ip_v4, unnest([0, 1, 2]) AS k FROM anchor_dim)""",
    "probe_dim": f"""
  SELECT {_projection(PROBE_COLUMNS)} FROM customer JOIN country_dim ON c_nationkey = n_nationkey""",
    "participant_dim": """
  SELECT DISTINCT ((probe_id * 7 + i * 13) % (SELECT count(*) FROM supplier)) * 10 + probe_id % 2 AS msm_id, probe_id
  FROM (SELECT c_custkey AS probe_id, unnest(range(0, c_custkey % 4 + 1)) AS i FROM customer)""",
})


def sql(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` with the CTEs it needs; ``extra`` adds query-specific ones after them."""
    known = {**CTES, **(extra or {})}
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(known[name])

    visit(body)
    if not needed:
        return body
    chain = ",\n".join(f"{n} AS MATERIALIZED ({known[n]})" for n in known if n in needed)
    return f"WITH {chain}\n{body}"
