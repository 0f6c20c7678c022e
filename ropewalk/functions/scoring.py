"""Heat, utility and other derived numbers over the usage counters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class HeatConfig:
    """Weights of visits, coverage and recency, and the recency constant in logical steps."""

    alpha: float = 1.0
    beta: float = 1.0
    gamma: float = 1.0
    tau: float = 50.0


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def trials(success="success_count", failure="failure_count") -> Column:
    return _col(success) + _col(failure)


def success_rate(success="success_count", failure="failure_count", empty: float = 0.0) -> Column:
    n = trials(success, failure)
    return F.when(n > 0, _col(success) / n).otherwise(F.lit(empty))


def avg_pos(pos_sum="pos_sum", pos_n="pos_n") -> Column:
    return F.when(_col(pos_n) > 0, _col(pos_sum) / _col(pos_n)).otherwise(F.lit(0.5))


def time_decay(last_used, now, tau: float = 50.0) -> Column:
    """exp(-age / tau); a record that was never used (negative step) has none."""
    age = F.greatest(F.lit(0), _col(now) - _col(last_used))
    return F.when(_col(last_used) < 0, F.lit(0.0)).otherwise(F.exp(-age / F.lit(tau)))


def skill_heat(now, cfg: HeatConfig = HeatConfig(), n_visit="n_visit", coverage="coverage",
               last_used="last_used_step") -> Column:
    return (F.lit(cfg.alpha) * _col(n_visit) + F.lit(cfg.beta) * _col(coverage)
            + F.lit(cfg.gamma) * time_decay(last_used, now, cfg.tau))


def utility(now, cfg: HeatConfig = HeatConfig(), success="success_count",
            failure="failure_count") -> Column:
    """Heat times success rate; an untried record is taken to succeed half the time."""
    return skill_heat(now, cfg) * success_rate(success, failure, empty=0.5)


def token_efficiency(tokens, full: float) -> Column:
    return (F.lit(1.0) - _col(tokens) / F.lit(float(full))) * F.lit(100.0)
