"""Settings that the jobs of an experiment read."""

from __future__ import annotations

from dataclasses import dataclass

from .constants import THRESHOLD


@dataclass(frozen=True)
class ExperimentConfig:
    """``test_size``, ``seed``, ``threshold``, ``max_len``, ``epochs`` and ``weight_decay`` decide results.

    ``max_len`` is the encoder's length: a text counts with its first ``max_len - 2`` tokens.
    ``epochs`` is the most epochs a model trains for; early stopping may end it sooner.  The hashed
    features are as wide as twice the distinct tokens.

    ``optimizer`` is ``lbfgs`` (``operators.lbfgs``: all heads together in whole passes) or ``adam`` (``operators.joint``: all
    heads together in mini-batches).  The batch sizes and ``learning_rate`` are read by ``adam`` alone; a
    step is one job, so a large table wants batches of many thousands.  ``fit_parallelism`` is not read any more.
    """

    test_size: float = 0.15
    seed: int = 42
    threshold: float = THRESHOLD
    max_len: int = 300
    epochs: int = 5
    weight_decay: float = 1e-6
    fit_parallelism: int = 4
    optimizer: str = "lbfgs"
    learning_rate: float = 3e-5
    train_batch_size: int = 16
    valid_batch_size: int = 16
