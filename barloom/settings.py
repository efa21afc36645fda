"""Settings: defaults, overrides from YAML, paths."""

from __future__ import annotations

import copy
from pathlib import Path

import yaml

# The defaults of the engine's tunables.
DEFAULTS: dict = {
    "data": {
        "source": "parquet",
        "history_years": 10,
        "min_history_years": 3,
        "ohlc_repair_tolerance": 0.005,
        "drop_holiday_placeholder_bars": True,
        "cache": {"directory": "cache/ohlcv", "max_age_hours": 12},
        "csv": {"directory": "user_data/csv"},
    },
    "market": {
        "exchange_timezone": "Asia/Kolkata",
        "market_close_time": "15:30",
        "trading_days_per_year": 248,
        "benchmark_index": "^NSEI",
        "sector_indices": {"Technology": "^CNXIT", "Financial Services": "^NSEBANK", "Healthcare": "^CNXPHARMA"},
        "risk_free_rate_annual": 0.065,
        "round_trip_cost": 0.0025,
        "price_bands": {},
    },
    "forecast": {"horizon_days": 5, "monte_carlo_paths": 10000, "random_seed": 42, "interval_levels": [0.5, 0.68, 0.8, 0.9, 0.95], "move_thresholds": [0.02, 0.05]},
    "walk_forward": {"min_training_days": 504, "max_training_days": None, "forecast_every_days": 5, "refit_every_days": 21, "min_scored_forecasts_for_model_selection": 20, "default_volatility_model": "garch_t"},
    "indicators": {
        "moving_average_spread": {"fast_ema": 20, "slow_sma": 50},
        "macd": {"fast": 12, "slow": 26, "signal": 9},
        "directional_movement": {"period": 14},
        "adx": {"period": 14},
        "rsi": {"period": 14},
        "stochastic": {"period": 14, "smoothing": 3},
        "cci": {"period": 20},
        "bollinger": {"period": 20, "width_in_std": 2.0},
        "atr": {"period": 14},
        "realized_volatility": {"window": 21},
        "obv": {"slope_window": 20},
        "vwap": {"window": 20},
        "chaikin_money_flow": {"period": 20},
    },
    "normalization": {"scale_window": 252, "percentile_window": 252, "cci_scale": 100.0},
    "redundancy": {
        "max_abs_correlation": 0.8,
        "priority": ["moving_average_spread", "macd", "directional_movement", "rsi", "cci", "stochastic", "bollinger_position", "obv_slope", "vwap_distance", "chaikin_money_flow", "realized_volatility", "atr_percent", "bollinger_bandwidth"],
    },
    "regimes": {"trend_adx_threshold": 25},
    "models": {
        "garch": {"asymmetric": True, "max_iterations": 3000},
        "merton": {"max_jumps_per_day": 8, "initial_jump_threshold_sd": 3.0, "max_iterations": 3000},
        "hmm": {"states": 2, "max_iterations": 300, "tolerance": 1e-7, "random_restarts": 4},
        "kalman": {"max_iterations": 800},
        "mean_reversion": {"adf_significance": 0.05},
        "earnings": {"min_events": 8},
    },
    "bayes": {"prior_annual_drift": 0.10, "prior_annual_drift_sd": 0.20, "signal_effect_prior_sd": 0.0025},
    "fundamentals": {
        "cache_max_age_hours": 24,
        "max_annual_tilt": 0.03,
        "component_weights": {"valuation_vs_history": 0.3, "valuation_vs_peers": 0.3, "growth": 0.2, "earnings_surprise": 0.2},
        "fair_value_band": 0.2,
        "growth_scale": 0.15,
        "surprise_scale_pct": 5.0,
        "peer_log_ratio_scale": 0.5,
        "plausible_multiple_max": {"trailingPE": 200, "priceToBook": 50, "enterpriseToEbitda": 100},
        "peers": {},
    },
    "evaluation": {"significance_level": 0.05, "reliability_bins": 10, "pit_bins": 10},
    "strategy_check": {"enter_probability": 0.55},
    "output": {"directory": "reports"},
}


def merged(base: dict, over: dict) -> dict:
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def load_settings(path: str | Path | None = None, **over) -> dict:
    """The defaults, with the YAML file's and then the caller's values over them."""
    found = yaml.safe_load(Path(path).read_text()) or {} if path else {}
    return merged(merged(DEFAULTS, found), over)


def resolve_path(setting: str | Path, root: str | Path | None = None) -> Path:
    """An absolute path as it is; a relative one under `root` (default: the working folder)."""
    p = Path(setting).expanduser()
    return p if p.is_absolute() else Path(root or Path.cwd()) / p
