"""Numbers that define the semantics of the pipeline (fixed values) and the run settings."""

from __future__ import annotations

from dataclasses import dataclass, field

# Gate, retrieval and window sizes.
QUOTE_THRESHOLD = 0.40
TOP_K = 10
MAX_TOP_K = 50
NEXT_WORDS = 12
EMBED_DIM = 384
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "

# Confidence bands.
BAND_AUTOPILOT = "autopilot-eligible"
BAND_REVIEW = "review queue"
BAND_IGNORED = "ignored"
AUTOPILOT_THRESHOLD = 0.60
REVIEW_THRESHOLD = 0.40

# Rule score.
STRONG_SCORE = 0.92
EXTRA_SIGNAL_BONUS = 0.03
NO_SIGNAL_SCORE = 0.05
SCORE_CAP = 0.99

# Transcript quality limits.
MIN_AVG_LOGPROB = -0.8
MAX_NO_SPEECH_PROB = 0.6

# Live detection.
LIVE_CONFIDENCE_FLOOR = 0.45
RESCUE_FLOOR = 0.15
MIN_WORDS = 3
TAIL_WORDS = 20
OVERLAP_WORDS = 10
CHUNK_SECONDS = 8.0
OVERLAP_SECONDS = 2.0
UTTERANCE_GAP_SECONDS = 0.5
LAG_RATIO = 0.95
AGREEMENT_STEP = 0.03
AGREEMENT_CAP = 0.12

# Label building, synthetic rows, activation log.
LINE_TARGET_WORDS = 9
LINE_MIN_WORDS = 5
LINE_MAX_WORDS = 14
MAX_TEXT_CHARS = 500
MIN_QUOTE_OVERLAP = 3
SEED_MIN_WORDS = 8
SEED_MAX_WORDS = 45
GRACE_DAYS = 21
DEFAULT_EDITION = "NKJV"


@dataclass(frozen=True)
class RerankWeights:
    """Weights of the final score; a zero weight drops its term from the plan."""

    semantic: float = 0.80
    lexical: float = 0.20
    context: float = 0.0
    history: float = 0.0
    quote_prob: float = 0.0


@dataclass(frozen=True)
class Concordance:
    """Constants of the cross-edition agreement boost."""

    search_k: int = 5
    min_words: int = 3
    dual_threshold: float = 0.70
    dual_base: float = 0.40
    dual_semantic: float = 0.50
    dual_rule: float = 0.10
    top1_threshold: float = 0.80
    top1_rule_min: float = 0.25
    top1_base: float = 0.50
    top1_semantic: float = 0.30
    top1_rule: float = 0.20


@dataclass(frozen=True)
class Settings:
    quote_threshold: float = QUOTE_THRESHOLD
    top_k: int = TOP_K
    next_words: int = NEXT_WORDS
    weights: RerankWeights = field(default_factory=RerankWeights)
    concordance: Concordance = field(default_factory=Concordance)
    include_ignored: bool = False
    default_edition: str = DEFAULT_EDITION
    max_candidates: int = 10
    pair_scorer_topn: int = 10
    pair_scorer_weight: float = 0.30


def checked_top_k(k: int) -> int:
    """Searches take any positive k; a front end may bound it by MAX_TOP_K."""
    if int(k) < 1:
        raise ValueError(f"k must be positive: {k}")
    return int(k)
