"""Locked constants of the strategy. A test pins them."""

from __future__ import annotations

STRATEGY_VERSION, POSITIVE_CLASS, CENSOR_STATUS = "event_driven_v1", "broken", "pending"
RULESET, BUY_THRESHOLD, SELL_THRESHOLD, MA_WINDOW = "ma5_v1", 0.0025, -0.0025, 5
SWEEP_BUY, SWEEP_SELL, SWEEP_WINDOWS = (0.0, 0.0025, 0.005, 0.0075), (0.0, -0.0025, -0.005, -0.0075), (3, 5, 7, 10)
COST_FP, COST_FN, COST_RATIO_GRID = 1.0, 15.0, (5, 10, 15, 20)
MIN_SAMPLE_N, MIN_CLASS_N = 20, 2
MAX_PRINT_AGE_DAYS = 3.0
TX_COST_BPS, CAPITAL_PER_DEAL = 10.0, 1_000_000.0
SIMULATION_PATHS, SIMULATION_RHO = 50_000, 0.15
START_DATE = "2026-04-20"

#: New York exchange closures of 2026.
HOLIDAYS_2026 = {
    "2026-01-01": "New Year's Day",
    "2026-01-19": "Martin Luther King Jr. Day",
    "2026-02-16": "Washington's Birthday",
    "2026-04-03": "Good Friday",
    "2026-05-25": "Memorial Day",
    "2026-06-19": "Juneteenth",
    "2026-07-03": "Independence Day (observed)",
    "2026-09-07": "Labor Day",
    "2026-11-26": "Thanksgiving",
    "2026-12-25": "Christmas Day",
}
#: The series dimension (id, name, unit).
SERIES = (
    ("SP500", "S&P 500", "index"),
    ("NASDAQCOM", "NASDAQ Composite", "index"),
    ("DJIA", "Dow Jones Industrial Average", "index"),
    ("DCOILWTICO", "WTI Cushing Spot", "usd_per_bbl"),
    ("DCOILBRENTEU", "Brent Europe Spot", "usd_per_bbl"),
    ("DGS10", "10-Year Treasury", "percent"),
    ("DFF", "Federal Funds Effective", "percent"),
    ("FEDFUNDS", "Federal Funds Monthly", "percent"),
)
#: Lifecycle events, and those that end a deal.
EVENT_TYPES = (
    "announcement financing_secured shareholder_approval hsr_filing hsr_clearance second_request doj_challenge ftc_challenge "
    "cfius_review cfius_clearance eu_clearance uk_cma_action tender_threshold_achieved shareholder_vote amended_consideration "
    "expected_close_revision termination closing withdrawal"
).split()
RESOLUTION_EVENTS = ("closing", "termination", "withdrawal")
#: Stress scenarios (name, predicate over a position, floor of the break probability; 1 forces a break).
SCENARIOS = (
    ("broad_risk_off", "true", 0.35),
    ("financing_shock", "break_vector = 'financing' OR sponsor IS NOT NULL", 0.60),
    ("regulatory_tightening", "break_vector IN ('antitrust', 'regulatory')", 0.55),
    ("antitrust_shock", "break_vector = 'antitrust'", 1.0),
    ("cfius_shock", "break_vector = 'cfius'", 1.0),
    ("sponsor_financing_stress", "sponsor IS NOT NULL", 0.50),
)
#: Words that say nothing about which company a name means.
NAME_FILLER = (
    "the inc incorporated corp corporation co company companies ltd limited plc llc lp l p sa s a nv n v ag se holdings "
    "holding group trust class cl common stock shares share ordinary new com de del delaware and"
).split()
#: Words that a company's code skips.
TOKEN_FILLER = (
    "INC INCORPORATED CORP CORPORATION COMPANY CO LTD PLC THE AND OF GROUP HOLDINGS HOLDING LLC LP N A CLASS COMMON STOCK AFFILIATE AFFILIATES"
).split()
#: Tolerances (absolute, relative) of the price reconciliation rules.
RECONCILE_RULES = {"price_reconcile_v1": (1e-4, 1e-6), "price_reconcile_v2": (0.01, 1e-4)}
#: Snapshot policies, counted in sessions or in calendar days after the announcement.
SNAPSHOT_POLICIES = {
    "ann_tplus_5_session": ("sessions", (5,)),
    "ann_tplus_10_session": ("sessions", (10,)),
    "ann_tplus_20_session": ("sessions", (20,)),
    "weekly_grid_5_60": ("sessions", (5, 10, 15, 20, 25, 30, 40, 60)),
    "calendar_7_14_30": ("days", (7, 14, 30)),
    "active_deal_weekly_panel": ("sessions", (5, 10, 15, 20, 25, 30, 40, 60)),
}
