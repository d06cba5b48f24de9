"""Every threshold a reviewer might question, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # recurring debit streams
    min_payments: int = 3
    period_min_days: float = 20
    period_max_days: float = 400
    amount_cv_max: float = 0.35
    amount_round_dp: int = 0
    # recurring income
    income_min_events: int = 3
    income_period_min_days: float = 5
    income_period_max_days: float = 40
    income_amount_cv_max: float = 0.35
    income_min_monthly: float = 100.0
    # schedule and lateness
    ontime_abs_tol_days: float = 3
    ontime_rel_tol: float = 0.10
    missed_dpd_days: float = 90
    mad_scale: float = 1.4826
    dpd_cap_days: float = 90.0
    dpd_serious_days: float = 30.0
    overdue_tol: float = 1.0
    # look-back windows
    days_per_month: float = 30.44
    full_months: int = 24
    recent_months: int = 6
    short_months: int = 3
    # parity between the two sources
    parity_abs_tol: float = 1e-6
    parity_rel_tol: float = 1e-4

    def window_days(self, months: int) -> int:
        return int(self.days_per_month * months)


DEFAULT = Settings()
