"""Settings of the operators: frozen dataclasses, constant at plan time."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class IndicatorConfig:
    """Periods, thresholds and score weights (fixed default values of the method)."""

    ema_fast: int = 9
    ema_slow: int = 21
    sma_long: int = 200
    vwap_rows: int = 20
    rsi_period: int = 14
    rsi_oversold: float = 30
    rsi_overbought: float = 70
    macd_fast: int = 12
    macd_slow: int = 26
    macd_signal: int = 9
    stochrsi_period: int = 14
    stochrsi_oversold: float = 20
    bb_period: int = 20
    bb_std: float = 2.0
    atr_period: int = 14
    atr_sl_mult: float = 1.5
    adx_period: int = 14
    adx_min: float = 25
    st_atr_period: int = 10
    st_atr_mult: float = 3.0
    vol_rows: int = 20
    vol_spike_mult: float = 1.5
    fib_levels: tuple = (0.236, 0.382, 0.618, 0.786)
    fib_tolerance: float = 0.015
    fib_rows: int = 252
    wr_period: int = 14
    wr_oversold: float = -80
    wr_overbought: float = -20
    cci_period: int = 20
    cci_oversold: float = -100
    min_confirmations: int = 3
    weight_rsi: float = 0.25
    weight_macd: float = 0.20
    weight_bb: float = 0.15
    weight_volume: float = 0.15
    weight_fib: float = 0.10
    weight_ema: float = 0.15
    weight_news: float = 0.20


@dataclass(frozen=True)
class RiskConfig:
    total_capital: float = 1_000_000.0
    max_capital_deployed: float = 0.80
    max_position_size: float = 0.05
    max_single_option: float = 0.03
    max_daily_loss_pct: float = 0.02
    max_weekly_loss_pct: float = 0.05
    max_drawdown_pct: float = 0.15
    max_open_positions: int = 10
    max_trades_per_day: int = 20
    max_sector_exposure: float = 0.25
    no_new_trades_after: str = "15:00"
    no_options_after: str = "15:20"
    max_iv_to_trade: float = 50.0
    min_ml_confidence: float = 60.0
    min_tech_score: float = 65.0


@dataclass(frozen=True)
class CostPlan:
    """Rates of one brokerage plan; `regulator_buy` says whether purchases pay the regulator fee."""

    flat: float = 0.0
    pct: float = 0.0
    sell_tax: float = 0.001
    regulator: float = 0.000001
    exchange: float = 0.0000325
    stamp_buy: float = 0.00015
    levy: float = 0.18
    levy_on_regulator: bool = True
    regulator_buy: bool = True


# The plans of the method, by neutral names.
COST_PLANS = {
    "delivery": CostPlan(),
    "per_order": CostPlan(flat=20.0),
    "three_bp": CostPlan(pct=0.0003),
    "five_bp": CostPlan(pct=0.0005),
    "paper": CostPlan(regulator_buy=False, levy_on_regulator=False),
    "paper_flat": CostPlan(flat=20.0, regulator=0.0, exchange=0.0001, stamp_buy=0.0, levy=0.0),
}


@dataclass(frozen=True)
class TradeConfig:
    entry_slip: float = 0.05
    exit_slip: float = 0.03
    max_days: int = 20
    reversal_score: float = 35.0
    trail_lag: int = 0
    levels: str = "row"  # 'row' takes the signal row's levels, 'regime' the regime multiples
    min_score: float = 60.0
    min_prob: float = 0.55
    top_k: int = 10
