"""Parameters and fixed values shared by the jobs."""

from __future__ import annotations

from dataclasses import dataclass, field

# They decide which rows come out, so they are stated once, here.
VAL_PERCENT = 5
MIN_CHARS = 5  # exclusive
MAX_CHARS = 20000  # exclusive
TRAIN_SEED = 42
VAL_SEED = 1337
MIX_WEIGHTS = {"web": 0.45, "code": 0.25, "math": 0.20, "academic": 0.10}
ACADEMIC_WEIGHTS = {"arxiv": 0.5, "books": 0.5}
SHINGLE_CHARS = 5
NUM_PERM = 128
DEDUP_THRESHOLD = 0.9
VOCAB_SIZE = 32_000
BLOCK_SIZE = 1024

# Special ids of the built-in vocabulary. Padding is the end-of-sequence id.
UNK_ID = 0
BOS_ID = 1
EOS_ID = 2
PAD_ID = EOS_ID
FIRST_WORD_ID = 3

SPLIT_SEEDS = {"train": TRAIN_SEED, "val": VAL_SEED}



# How a training run spends tokens and what it logs.
SEQUENCES_PER_PASS = 6
PASSES_PER_STEP = 192
STEPS = 15_000
LOG_EVERY, VALIDATE_EVERY, SAVE_EVERY = 10, 1_000, 3_000


@dataclass(frozen=True)
class RateCurve:
    """Learning rate: linear warm-up to the peak, half a cosine down to the floor."""

    # Fixed values.
    peak: float = 6e-4
    floor: float = 6e-5
    warmup: int = 700
    last: int = STEPS


@dataclass(frozen=True)
class MixConfig:
    """A two-level mixture: some outer sources are themselves mixtures."""

    weights: dict[str, float] = field(default_factory=lambda: dict(MIX_WEIGHTS))
    nested: dict[str, dict[str, float]] = field(
        default_factory=lambda: {"academic": dict(ACADEMIC_WEIGHTS)}
    )
