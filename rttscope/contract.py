"""Fixed values of the data contract.

Every constant in this module is a fixed value: column names, class and reason
texts, thresholds and grids that results must share with existing data and
consumers.  Logic lives elsewhere.
"""

# --- fixed values: classes, splits, periods, statuses -------------------------
CLASSES = ("OK", "RISCO", "FALHA")
SPLITS = ("treino", "validacao", "teste")
PERIOD_A, PERIOD_B = "A", "B"
FLOW_CLASSES = ("A+B", "B", "A", "nenhum")
STATUS_VALID, STATUS_SHORT = "VALIDO", "INSUFICIENTE"
VERDICTS = ("PASSOU", "ATENCAO", "FALHOU", "INCONCLUSIVO")
DRIFT_STATUS = ("amostra_insuficiente", "estavel", "atencao", "alerta")
PING = "ping"
ADDRESS_FAMILY = 4

# --- fixed values: label rule -------------------------------------------------
LOSS_RISK = 100 / 3
LOSS_FAIL = 200 / 3
LOSS_EPS = 0.01
EXPECTED_LOSSES = (0.0, 100 / 3, 200 / 3, 100.0)
REASON_NO_BASELINE = "baseline_nao_encontrado"
REASON_SHORT_BASELINE = "baseline_insuficiente"
REASON_NO_LOSS = "perda_pct_vazio"
REASON_SEVERE_LOSS = "perda_severa"
REASON_P99 = "latencia_acima_p99"
REASON_PARTIAL_LOSS = "perda_parcial"
REASON_P95 = "latencia_acima_p95"
REASON_JITTER = "jitter_acima_p95"
REASON_NONE = "sem_alerta"

# --- fixed values: target, windows, discard and split -------------------------
HORIZON = 1
WINDOWS = (3, 6, 12)
GAP_MAX_S = 600
SENTINEL = -1.0
TTL_CLIP = 16
TTL_RESET = 64
STALE_SHARE = 0.5
TRAIN_DAYS = 5
VALID_DAYS = 6
EMBARGO_MIN = 60
LEAK_SAMPLE = 200
TOLERANCE = 1e-6
SEED = 42
REASON_STALE = "baseline_desatualizado"
REASON_NO_NEXT = "sem_medicao_t_mais_h"
REASON_NEXT_UNLABELLED = "alvo_sem_rotulo"
REASON_GAP = "intervalo_acima_de_gap"
REASON_EMBARGO = "embargo"

# --- fixed values: collection and baselines -----------------------------------
MIN_SAMPLES = 30
COVERAGE_MIN = 80.0
INTERVAL_S = 240
DIVERGENCE_MS = 0.01
HIGH_LOSS_SHARE = 0.20
REASON_TYPE = "type diferente de ping"
ITEM_OFFLINE = "probe_offline"
ITEM_OTHER_PROBE = "probe_diferente"
ITEM_BAD_TIME = "timestamp_invalido"
ITEM_BAD_LOSS = "perda_fora_de_0_a_100"
ITEM_NEGATIVE = "latencia_negativa"
ITEM_NO_LATENCY = "latencia_ausente"
ITEM_REPEATED = "timestamp_duplicado"
REASON_WINDOW = "timestamp fora da janela do período"
REASON_AF = "af da medição divergente entre as fontes ou diferente de 4"
REASON_MSM_TYPE = "medição não é ping Ongoing"
REASON_ANCHOR_OFF = "anchor com is_disabled diferente de false"
REASON_OK = "ok"
REASON_EMPTY = "sem resultados na janela"
REASON_COVERAGE = "cobertura abaixo do mínimo ({}%)"
REASON_COVERAGE_NO_INTERVAL = "sem intervalo"
REASON_FEW_TTL = "menos de 30 amostras de TTL em A"

# --- fixed values: column lists, in contract order ----------------------------
RAW_COLUMNS = (
    "id_fluxo", "periodo", "anchor_id", "anchor_ip", "probe_id", "probe_ip", "msm_id",
    "ttl", "result", "dup", "rcvd", "sent", "min", "max", "avg", "timestamp", "type",
    "packets", "interval",
)
DATASET_COLUMNS = (
    "anchor_id", "probe_id", "rtt_min", "rtt_max", "rtt_avg", "perda_pct", "jitter_ms",
    "ttl", "ttl_baseline", "delta_ttl", "ttl_changed", "latencia_ms", "timestamp",
)
AUDIT_COLUMNS = (
    "anchor_id", "probe_id", "timestamp", "perda_pct", "latencia_ms", "jitter_ms",
    "p95_rtt_A", "p99_rtt_A", "p95_jitter_A", "classe", "motivo_rotulagem",
)
BASELINE_COLUMNS = (
    "anchor_id", "probe_id", "id_fluxo", "n_amostras_A", "n_rtt_validos_A",
    "mediana_rtt_A", "p95_rtt_A", "p99_rtt_A", "mediana_jitter_A", "p95_jitter_A",
    "p99_jitter_A", "ttl_baseline", "ttl_min_A", "ttl_max_A", "n_ttl_distintos_A",
    "status_baseline",
)
INSTANT_FEATURES = (
    "perda_pct", "rtt_ausente", "razao_rtt_p95", "razao_rtt_p99", "razao_jitter_p95",
    "amplitude_rtt_rel", "delta_ttl_clip", "ttl_reset",
)
WINDOW_FEATURES = ("perda_media", "rtt_p95_max", "jitter_p95_max", "n_rtt_acima_p95")
STREAK_FEATURE = "perdas_consecutivas"
FEATURES = (
    INSTANT_FEATURES
    + tuple(f"{name}_w{n}" for n in WINDOWS for name in WINDOW_FEATURES)
    + (STREAK_FEATURE,)
)
NO_SENTINEL = ("perda_pct", "rtt_ausente", "ttl_reset", "perdas_consecutivas")
FINAL_META = ("id_fluxo", "anchor_id", "probe_id", "timestamp", "split", "classe_atual")
TARGET = "alvo"
FORBIDDEN_COLUMNS = (
    "anchor_id", "probe_id", "timestamp", "classe", "classe_atual", "motivo_rotulagem",
    "ttl", "ttl_baseline", "latencia_ms", "rtt_min", "rtt_max", "rtt_avg", "jitter_ms",
    "p95_rtt_A", "p99_rtt_A", "p95_jitter_A",
)
LOG_FIELDS = (
    "run_id", "ts_previsao", "fluxo_id", "anchor_id", "modelo_versao", "modelo_hash",
    "features", "proba", "classe_prevista", "classe_atual", "latencia_inferencia_ms",
    "rotulo_real", "ts_rotulo",
)

# --- fixed values: drift and alert thresholds ---------------------------------
PSI_STABLE, PSI_ALERT = 0.1, 0.25
JS_ALERT = 0.1
MIN_DRIFT_ROWS = 30
MACRO_F1_MIN = 0.60
RECALL_FAIL_MIN = 0.50
NULL_RATE_STEP = 0.2
PSI_FLOOR = 1e-6
QUANTILE_BINS = 10
REFERENCE_SAMPLE = 2000
ROUTE_RATIO, ROUTE_LOSS = 1.5, 5.0
COOLDOWN_H = 24
LOW_F1_WINDOWS = 3
SCORE_WARMUP = 12
HISTORY_CAP = 48
PROBA_TOLERANCE = 1e-6
LABEL_SHARE_MIN = 0.5
RETENTION_DAYS = 90

# --- fixed values: model grids, simplest candidate first ----------------------
FAMILIES = ("naive_bayes", "arvore_decisao", "random_forest")
GRIDS = {
    "naive_bayes": {"var_smoothing": (1e-9, 1e-6, 1e-3, 1e-1)},
    "arvore_decisao": {
        "max_depth": (3, 5, 8, 12, None),
        "min_samples_leaf": (1, 20, 100),
        "class_weight": (None, "balanced"),
    },
    "random_forest": {
        "n_estimators": (100, 200),
        "max_depth": (6, 12, None),
        "min_samples_leaf": (5, 50),
        "class_weight": (None, "balanced_subsample"),
    },
}
SLICES = ("geral", "transicoes", "inicio_falha", "sem_anchor_dominante")
OVERFIT_GAP = 0.10
LOW_MACRO_F1 = 0.60
LOW_FAIL_RECALL = 0.50
LOW_ONSET_RECALL = 0.50
SMALL_GAIN = 0.03
DOMINANT_SHARE = 0.50
TEST_DROP = 0.05

# --- fixed values: anchor and probe selection ---------------------------------
TOTAL_ANCHORS = 30
HOME_COUNTRY = "BR"
EUROPE = "Europa"
MAX_EUROPE = 6
MAX_PER_ASN, MAX_PER_ASN_FALLBACK = 1, 2
CONTINENT_QUOTAS = {
    "África": 3, "América do Norte": 3, "América do Sul": 3, "Ásia": 5, "Europa": 4,
    "Oceania": 2, "Antártida": 0,
}
BANDS = ("curta", "media", "longa")
BAND_SHORT_KM, BAND_MEDIUM_KM = 4000.0, 10000.0
EARTH_RADIUS_KM = 6371.0
MIN_PROBES, MAX_PROBES, PROBES_WHEN_FEW = 3, 5, 1
UNKNOWN_CONTINENT = "desconhecido"
STATUS_CONNECTED, STATUS_ONGOING = "Connected", "Ongoing"
