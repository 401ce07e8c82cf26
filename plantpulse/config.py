"""Study parameters and the fixed vocabulary shared by every operator.

A study is a set of column names plus a few thresholds; operators never hard-code
either, they receive them from a ``StudyConfig`` or as plain arguments.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# --- Fixed values: vocabulary of the published tables --------------------------
CLASSES = ["normal", "alerta", "critico"]
SPLITS = ["train", "val", "test"]
PSI_STABLE, PSI_MODERATE = 0.10, 0.25
PSI_BANDS = ["estable", "cambio_moderado", "drift", "sin_dato"]
MODEL, SPLIT = "modelo", "particion"
MEDIAN_MODEL = "mediana_entrenamiento"
DUMMY_MODEL = "dummy_frecuente"
PERSISTENCE, DAILY_PERSISTENCE = "persistencia", "persistencia_diaria"

# Text written by the acquisition system in place of a number.
ACQUISITION_MARKERS = ["configure", "bad", "tag not found", "nan", "none", ""]
# Text that stands for "no wind direction".
NO_DIRECTION = ["---", "nan", "None", ""]
# Fixed value: 16 compass points clockwise from north, 22.5 degrees apart.
COMPASS_POINTS = "N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW".split()
# Unit conversions and rating.
INHG_TO_MBAR = 33.8639
BAR_TO_MBAR = 1000.0
RATED_MW = 300.0

# Historian tags, their description, model column and role.
TAGS = [
    ("FNX:00TI7004.PV", "Temperatura de agua de mar", "temp_agua_mar", "driver"),
    ("FNX:10TI3005.PV", "Temperatura de condensador", "temp_condensador", "contrast"),
    ("FNX:10PI3001.PV", "Vacío del condensador (tag nominal, sin datos)", None, None),
    ("FNX:S1_EV_P.PV", "Presión de escape de TV10 (proxy de vacío)", "vacio", "target"),
    ("FNX:10PIC2333.PV", "Presión de vapor de eyectores", "presion_eyectores", "driver"),
    ("FNX:S1.TT_EXH.PV", "Temperatura de descarga de turbina LP (sin datos)", None, None),
    ("FNX:G1_DWATT.PV", "Potencia TG11", "potencia_tg11", "driver"),
    ("FNX:G2_DWATT.PV", "Potencia TG12", "potencia_tg12", "driver"),
    ("FNX:S1_DWATT.PV", "Potencia TV10", "potencia_tv", "driver"),
    ("FNX:12PI1801A.PV", "Presión del domo HP del HRSG 12", None, None),
    ("FNX:12TI1245B.PV", "Temperatura de entrada al domo HP", None, None),
    ("FNX:12PI1701A.PV", "Presión del domo IP del HRSG 12", None, None),
    ("FNX:12PI1601A.PV", "Presión del domo LP del HRSG 12", None, None),
    ("FNX:11PI1601A.PV", "Presión del domo LP del HRSG 11", None, None),
    ("FNX:12PI2620.PV", "Presión de vapor LP", "presion_vapor_lp", "driver"),
    ("FNX:12TI1305B.PV", "Temperatura de salida del sobrecalentador LP", None, None),
    ("FNX:12FI1630.PV", "Flujo de agua de alimentación al domo LP", None, None),
    ("FNX:12FT1630.PV", "Flujo de agua de alimentación LP", "flujo_fw_lp", "driver"),
    ("FNX:12TI1682B.PV", "Temperatura de agua de alimentación al domo LP", None, None),
    ("FNX:12TI1634B.PV", "Temperatura de agua de alimentación LP", None, None),
    ("FNX:12PI1615.PV", "Presión de agua de alimentación LP", None, None),
    ("FNX:S1_IP_P.PV", "Presión de admisión IP", None, None),
    ("FNX:S1_TT_IS.PV", "Temperatura de vapor de admisión", None, None),
    ("FNX:S1_TT_ES.PV", "Temperatura de escape HP", None, None),
    ("FNX:S1_HRHP_P.PV", "Presión de recalentamiento", None, None),
    ("FNX:S1_TT_RHS.PV", "Temperatura de vapor recalentado", None, None),
    ("FNX:S1_AP_P.PV", "Presión de admisión", None, None),
    ("FNX:S1_TT_EXH.PV", "Temperatura de vapor de escape LP", "temp_escape", "contrast"),
    ("FNX:10TI1919.PV", "Temperatura del header LP", None, None),
    ("FNX:12PI2441.PV", "Presión de vapor frío de recalentamiento", None, None),
]

# Scoring-request field -> (model column, lowest, highest accepted).
RECORD_FIELDS = {
    "temperatura_agua_mar": ("temp_agua_mar", 0.0, 120.0),
    "potencia_tv_mw": ("potencia_tv", 0.0, 400.0),
    "potencia_tg11_mw": ("potencia_tg11", 0.0, 400.0),
    "potencia_tg12_mw": ("potencia_tg12", 0.0, 400.0),
    "presion_eyectores": ("presion_eyectores", 0.0, 300.0),
    "presion_vapor_lp": ("presion_vapor_lp", 0.0, 200.0),
    "flujo_fw_lp": ("flujo_fw_lp", 0.0, 2000.0),
}
OBSERVED_FIELD = ("vacio_observado", 0.0, 35.0)


@dataclass(frozen=True)
class StudyConfig:
    """Column names, bounds and parameters of one study."""

    name: str
    target: str
    drivers: tuple[str, ...]
    baseline: tuple[str, ...]
    baseline_name: str
    cold: str
    load: str
    hot: str | None = None
    exhaust: str | None = None
    contrasts: tuple[str, ...] = ()
    profile: tuple[str, ...] = ()
    time: str = "Time"
    seq: str = "seq"
    unit: str | None = None
    min_load: float | None = None
    target_range: tuple[float, float] | None = None
    train_fraction: float = 0.70
    val_fraction: float = 0.15
    lags: tuple[int, ...] = (1, 2, 4, 8, 96)
    horizon: int = 4
    step_minutes: float = 15.0
    daily_lag: int = 96
    preview_rows: int = 672
    alert_quantile: float = 0.75
    critical_quantile: float = 0.95
    psi_bins: int = 10
    seed: int = 42
    to_mbar: float = 1.0
    rated_mw: float = RATED_MW
    trees: dict = field(default_factory=dict)

    def __post_init__(self):
        # Hot-side temperatures move with the saturation pressure being explained,
        # so a model that saw one would leak its own target.
        leaked = {self.hot, self.exhaust, self.target} & (set(self.drivers) | set(self.baseline))
        if leaked:
            raise ValueError(f"hot-side or target columns used as drivers: {sorted(leaked)}")

    @property
    def keys(self) -> list[str]:
        return [self.time, self.seq]

    def with_(self, **changes) -> "StudyConfig":
        return replace(self, **changes)


SURFACE = StudyConfig(
    name="superficie",
    target="vacio",
    drivers=(
        "temp_agua_mar", "potencia_tv", "potencia_tg11", "potencia_tg12",
        "presion_eyectores", "presion_vapor_lp", "flujo_fw_lp",
    ),
    baseline=("temp_agua_mar", "potencia_tv"),
    baseline_name="lineal_agua_y_carga",
    cold="temp_agua_mar",
    load="potencia_tv",
    hot="temp_condensador",
    exhaust="temp_escape",
    contrasts=("presion_eyectores", "temp_agua_mar"),
    profile=("vacio", "temp_agua_mar", "potencia_tv"),
    min_load=50.0,
    target_range=(0.4, 5.0),
    to_mbar=INHG_TO_MBAR,
)

AIR_COOLED = StudyConfig(
    name="aerocondensador",
    target="vacio",
    drivers=("temp_ambiente", "potencia_mw", "viento", "flujo_bp", "viento_sin", "viento_cos"),
    baseline=("temp_ambiente", "potencia_mw"),
    baseline_name="lineal_ambiente_y_carga",
    cold="temp_ambiente",
    load="potencia_mw",
    hot="temp_salida_bp",
    exhaust="temp_salida_bp",
    contrasts=("temp_ambiente", "viento", "potencia_mw"),
    profile=("vacio", "temp_ambiente", "potencia_mw"),
    lags=(15, 30, 60, 120),
    horizon=60,
    step_minutes=1.0,
    preview_rows=720,
    to_mbar=BAR_TO_MBAR,
)
