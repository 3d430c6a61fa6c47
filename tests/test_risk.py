"""Life of positions and halts against a plain state machine."""

import datetime
import random

import pytest

from barloom.config import RiskConfig
from barloom.operators import risk

CFG = RiskConfig(total_capital=1000.0, max_capital_deployed=0.5, max_position_size=0.2, max_single_option=0.1, max_daily_loss_pct=0.02, max_weekly_loss_pct=0.03,
                 max_drawdown_pct=0.08, max_open_positions=4, max_trades_per_day=6, no_options_after="13:00")


def plain(orders, positions, lifts):
    events = [(o[1], 2, o[0], o) for o in orders] + [(p[1], 3, p[0], p) for p in positions] + [(p[2], 0, p[0], p) for p in positions if p[2]] + [(t, 1, 0, None) for t in lifts]
    cap, out, day, week = CFG.total_capital, {}, None, None
    current = peak = start_of_week = cap
    for at, rank, key, x in sorted(events, key=lambda e: e[:3]):
        if at.date() != day:
            day = at.date()
            pnl, used, held, trades, halted = 0.0, 0.0, 0, 0, False
            if day.isocalendar()[:2] != week:
                week, start_of_week = day.isocalendar()[:2], current
        if rank == 0:
            pnl, used, held, current = pnl + x[4], max(0, used - x[3]), max(0, held - 1), current + x[4]
            peak = max(peak, current)
            halted = halted or pnl < -cap * CFG.max_daily_loss_pct
        elif rank == 1:
            halted = False
        elif rank == 3:
            used, held, trades = used + x[3], held + 1, trades + 1
        else:
            _, _, value, ml, tech, option, iv = x
            clock = at.strftime("%H:%M")
            loss = ("DAILY_LOSS" if pnl < -cap * CFG.max_daily_loss_pct else "WEEKLY_LOSS" if (start_of_week - current) / start_of_week > CFG.max_weekly_loss_pct
                    else "DRAWDOWN" if (peak - current) / peak > CFG.max_drawdown_pct else None)
            rules = [(halted, "HALTED"), (clock >= "15:00", "CUTOFF_TIME"), (option and clock >= "13:00", "OPTION_CUTOFF"), (ml < 60, "LOW_CONFIDENCE"), (tech < 65, "LOW_SCORE"),
                     (loss, loss), (trades >= 6, "TRADE_COUNT"), (held >= 4, "OPEN_POSITIONS"), (value > cap * (0.1 if option else 0.2), "POSITION_SIZE"),
                     (used + value > cap * 0.5, "DEPLOYMENT"), (option and iv > 50, "HIGH_IV")]
            out[key] = held, halted, next((name for met, name in rules if met), "APPROVED")
            halted = halted or out[key][2] in ("DAILY_LOSS", "WEEKLY_LOSS", "DRAWDOWN")
    return out


@pytest.mark.parametrize("bucket", ["minute", "hour", "day"])
def test_life_of_positions(spark, bucket):
    rng = random.Random(21)

    def moment(day):
        return datetime.datetime(2024, 1, 1 + day, rng.randrange(9, 16), rng.choice((0, 30)))

    orders, positions = [], []
    for i in range(400):
        at = moment(rng.randrange(20))
        orders.append((i, at, float(rng.choice((40, 90, 150, 210))), float(rng.choice((55, 80, 90))), float(rng.choice((60, 70, 80))), rng.random() < 0.3, float(rng.choice((20, 70)))))
        if rng.random() < 0.5:
            closed = at + datetime.timedelta(minutes=rng.choice((30, 60, 200, 1500)))
            positions.append((1000 + i, at, rng.choice((closed, closed, None)), float(rng.choice((40, 90, 120))), rng.choice((-13.0, -6.0, 2.0, 5.0, 9.0))))
    lifts = [datetime.datetime(2024, 1, 1 + d, 12, 0) for d in range(0, 20, 2)]
    got = risk.life_verdicts(
        spark.createDataFrame(orders, "order_id long, at timestamp, trade_value double, ml_confidence double, tech_score double, is_option boolean, iv double"),
        spark.createDataFrame(positions, "position_id long, opened_at timestamp, closed_at timestamp, trade_value double, pnl double"),
        spark.createDataFrame([(t,) for t in lifts], "at timestamp"), CFG, bucket)
    expected = plain(orders, positions, lifts)
    assert {r.order_id: (r.open_positions, r.halted, r.verdict) for r in got.collect()} == expected
    assert len({v for _, _, v in expected.values()}) >= 11
