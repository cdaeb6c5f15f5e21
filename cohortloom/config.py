"""Defaults of the analytics operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    jaccard: float = 0.90
    min_cooccurrence: int = 5
    asymmetry: float = 0.10
    markov: float = 0.05
    prune: int = 500
    support: float = 0.005
    min_support: int = 3
    negative_floor: float = 0.05
    chi2_critical: float = 3.841458820694124
    permutations: int = 1000
    fdr: float = 0.05
    readmission_days: int = 30
    signal: float = 0.01
    redundancy: float = -0.01
    interaction_order: int = 3
