"""Parameters of the operators. Defaults are the published values of the modelled business."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    # cadence, in days
    period_days: float = 7.0
    dedup_days: float = 3.0
    return_days: float = 60.0
    late_days: float = 10.0
    # curve lengths, in periods
    hmax: int = 52
    h_ext: int = 104
    horizons: tuple[int, ...] = (12, 26, 52)
    report_horizons: tuple[int, ...] = (4, 12, 26, 52, 104)
    seen_weeks: tuple[int, ...] = (1, 2, 3, 4, 5, 6, 7, 8)
    # thresholds
    min_payers: int = 500
    min_mature: int = 200
    min_risk: int = 30
    min_rows: int = 2000
    min_cohorts: int = 3
    crash_floor: float = 0.65
    crash_min_risk: int = 50
    clean_step_max: int = 8
    # model
    levers: tuple[str, ...] = ("geo", "media_source", "billday_bin")
    clip: tuple[float, float] = (0.4, 2.5)
    hazard_clip: tuple[float, float] = (0.001, 0.999)
    oe_clip: tuple[float, float] = (0.2, 5.0)
    hr_min_n: int = 20
    k_shrink: float = 800.0
    sanity: tuple[float, float] = (0.9, 1.1)
    # money
    base_price: float = 9.99
    price_tolerance: float = 0.05
    full_price_floor: float = 5.0
    net_base_price: float = 9.5635
    net_ups_price: float = 11.4866
    ups_first: int = 2
    ups_every: int = 4
    attach_shrink: float = 30.0
    haircut: float = 0.00913
    trial_price: float = 0.99
    trial_placeholder: float = 1.00
    product_b_trial: float = 4.99
    product_b_base_min: float = 20.00
    net_missing_max: float = 0.005
    # reporting
    low_n: int = 40
    min_age: int = 1

    @property
    def return_periods(self) -> float:
        return self.return_days / self.period_days


MOBILE = Params()
WEB = Params(
    return_days=21.0, min_rows=250, levers=("utm_source", "geo", "billday_bin"),
)

# Parameters for the driver's retail tables, where a "period" is months rather than a week.
ORDERS = Params(
    period_days=90.0, dedup_days=30.0, return_days=180.0, late_days=100.0, hmax=12, h_ext=16,
    horizons=(4, 8, 12), report_horizons=(4, 8, 12, 16), seen_weeks=(1, 2, 3, 4),
    min_payers=100, min_mature=50, min_risk=30, min_rows=200, crash_floor=0.35,
)
ORDERS_WEB = replace(
    ORDERS, period_days=120.0, return_days=240.0, late_days=150.0, h_ext=24,
    levers=("utm_source", "geo", "billday_bin"), min_rows=150,
    report_horizons=(4, 8, 12, 20), product_b_base_min=49.5,
)
USERS = replace(
    ORDERS, period_days=1.0, dedup_days=0.25, return_days=3.0, late_days=2.0,
    min_payers=20, min_risk=10, min_mature=10,
)
