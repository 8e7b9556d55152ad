"""Column roles and the fixed values the operators must share with the
original pipeline for equal results.

Every operator takes a :class:`Roles` (which column plays which part) and reads
its thresholds from module constants, which callers may override through
keyword arguments.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must equal the original pipeline's for equal results)
# ---------------------------------------------------------------------------
CLASSES = (0, 1, 2)
PRIOR_MIX = (0.463, 0.269, 0.268)            # assumed label mix of classes 0 / 1 / 2
PRIOR_SAMPLING = (0.46, 0.27, 0.27)          # mix of the prior-sampled baseline labels
TARGET_ACCURACY = 0.50
NUMERIC = ("age", "tenure", "frequent", "payment_interval", "contract_length")
SUSPECT = "after_interaction"
CATEGORICAL = ("gender", "subscription_type")
STABILITY_NUMERIC = NUMERIC + (SUSPECT,)
INTERACTION_PAIRS = (("age", "tenure"), ("frequent", "payment_interval"),
                     ("tenure", "contract_length"), ("age", "frequent"))
UNKNOWN_CATEGORY = "Unknown"

# profiling / leakage
SEQ_CUTOFF_PCT = 0.85
LEAK_ABS_CORR = 0.35
LEAK_MI = 0.65
LEAK_P = 0.0005
GATE_MIN_ROWS = 800
GATE_ABS_CORR_WITH_CUTOFF = 0.18
GATE_SEPARATION = 4.0
GATE_ABS_CORR_NO_CUTOFF = 0.15
HIGH_CORR = 0.7
HIGH_MISSING = 0.40
CO_MISSING_MIN = 0.01
OUTLIER_LO, OUTLIER_HI, OUTLIER_FLAG = 0.01, 0.99, 0.15
TEMPORAL_OVERLAP_FLAG = 0.02

# drift
STABILITY_MIN_ROWS = 100
KS_STABLE = 0.12
PSI_STABLE = 0.20
PSI_BINS = 10
CHI2_STABLE_P = 0.02

# filtering / imputation routing
FILTER_MAX_REMOVAL = 0.06
FILTER_FALLBACK_PCT = 0.95
FILTER_MIN_KEPT = 9500
ROUTE_HIGH_MISSING = 0.20
ROUTE_LOW_MISSING = 0.03

# features: clip bounds used by the business / statistical / interaction families
SUSPECT_CLIP_Q = (0.001, 0.999)
AGE_BINS = (25, 35, 50, 65, 100)             # right-closed upper edges of groups 0..4
AGE_YOUNG, AGE_OLD = 30, 60
AGE_RISK = (1.2, 1.1, 1.0)                   # young / old / other
STAT_CLIP = (0.0, 10000.0)
PAIR_CLIP = (0.0, 2000.0)
TARGET_ENC_FOLDS = 5
TARGET_ENC_ALPHA = (3, 25, 150)              # alpha = min(25, max(3, n // 150))
CLUSTER_WINSOR_Q = (0.002, 0.998)
CLUSTER_SCALE_Q = (0.05, 0.95)
CLUSTER_KS = (3, 5, 7)

# preprocessing
WINSOR_Q = (0.001, 0.999)
WINSOR_MIN_ROWS = 100
ROBUST_Q = (0.025, 0.975)
QUANTILE_LANDMARKS = 500
VARIANCE_MIN = 5e-5
VARIANCE_MIN_FE = 1e-4
PRUNE_ABS_CORR = 0.97
MAX_FEATURES = 60
MAX_FEATURES_FE = 75
PCA_MAX = 10
QUALITY_MAX_STD = 1000.0

# splits
VAL_SIZE = 0.16
GAP_SIZE = 0.005
GAP_SIZE_MAIN = 0.008
SPLIT_MIN_TRAIN, SPLIT_MIN_VAL = 700, 350
WF_SPLITS = 5
WF_DIVISOR = 12.5                            # fold size m = n // (splits * 2.5)
WF_MIN_FOLD = 500
WF_MIN_TRAIN, WF_MIN_VAL = 250, 125
WF_MIN_SCORED = 3
HOLDOUT_SIZES = (0.16, 0.18, 0.20)
STABILITY_RUNS = 10
STABILITY_MIN_OK = 6
SEED = 42

# class weights: balanced n / (k * n_c) times one multiplier profile
WEIGHT_PROFILES = {
    "train": (1.13, 1.08, 0.93),
    "validation": (1.16, 1.04, 0.90),
    "baseline": (1.3, 1.1, 0.8),
    "fallback": (1.35, 1.12, 0.78),
}

# evaluation
BLEND_SCORE = (0.60, 0.20, 0.20)             # accuracy, macro F1, minus L1 mix penalty
LOW_CONFIDENCE = 0.55
COMPOSITE_WEIGHTS = {
    "holdout_score": 0.22, "distribution_score": 0.20, "class_balance_score": 0.15,
    "cv_score": 0.18, "repeated_cv_score": 0.12, "stability_score": 0.10,
    "separation_score": 0.03,
}

# score correction
DEFAULT_BLEND = {"lightgbm": 0.28, "xgboost": 0.26, "catboost": 0.22, "stacking": 0.15,
                 "random_forest": 0.06, "gradient_boosting": 0.02, "extra_trees": 0.01}
UNKNOWN_MODEL_WEIGHT_SAVED = 0.1
UNKNOWN_MODEL_WEIGHT_DEFAULT = 0.02
ZERO_ROW_PROBS = (0.33, 0.34, 0.33)
TEMPERATURE = 1.01
PROB_CLIP = 1e-7
CONFIDENCE_THRESHOLD = 0.6
CONFIDENCE_BLEND = 0.7
MIX_STEPS = {  # class: (diff threshold, factor) checked in order
    0: ((0.03, 1.15), (0.01, 1.08)),
    2: ((-0.03, 0.88), (-0.01, 0.94)),
    1: ((0.01, 1.05), (-0.01, 0.98)),
}
BASELINE_FACTORS = (1.15, 1.05, 0.92)
FLOOR_CLASS1 = 0.25
FLOOR_CLASS0 = 0.42
CAP_CLASS2 = 0.30
BASELINE_FLOOR0 = 0.40
BASELINE_FLOOR1 = 0.22
BASELINE_BLEND = (0.65, 0.35)
VERDICT_TIERS = ((1.0, 0.8), (0.98, 0.7))    # (share of target, min mix score)
VERDICT_STAGE_SHARE, VERDICT_STAGE_MIX = 0.83, 0.6


@dataclass(frozen=True)
class Roles:
    """Which column plays which role. Defaults are the original column names."""

    key: str = "id"
    label: str = "support_needs"
    split: str = "split"
    seq: str = "seq"
    numeric: tuple[str, ...] = NUMERIC
    suspect: str = SUSPECT
    categorical: tuple[str, ...] = CATEGORICAL
    probs: tuple[str, str, str] = ("p0", "p1", "p2")
    extra: dict = field(default_factory=dict)

    @property
    def stability_numeric(self) -> tuple[str, ...]:
        return self.numeric + (self.suspect,)


DEFAULT_ROLES = Roles()
