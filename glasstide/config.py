"""Settings of the indicators, the rule engine and the feature universe, as plain frozen values."""

from __future__ import annotations

from dataclasses import dataclass, field


# The defaults of the three settings below, which labels must share to be comparable.


@dataclass(frozen=True)
class TrendSettings:
    ema_short: int = 21
    ema_mid: int = 50
    ema_long: int = 200
    ema_tolerance: float = 0.0015
    reg_length: int = 30
    slope_lookback: int = 20
    slope_min: float = 0.00015
    r2_min: float = 0.12


@dataclass(frozen=True)
class VolSettings:
    atr_lookback: int = 14
    atr_low: float = 0.8
    atr_high: float = 2.0
    atr_extreme: float = 4.0
    bb_length: int = 20
    bb_std: float = 2.0
    kc_length: int = 20
    kc_atr_mult: float = 1.5
    squeeze_in: float = 0.9
    squeeze_out: float = 1.1
    expansion_lookback: int = 5
    pctl_lookback: int = 60
    pctl_high: float = 65.0
    pctl_low: float = 25.0


@dataclass(frozen=True)
class ChopSettings:
    adx_lookback: int = 14
    adx_trend: float = 20.0


@dataclass(frozen=True)
class RuleSettings:
    trend: TrendSettings = field(default_factory=TrendSettings)
    vol: VolSettings = field(default_factory=VolSettings)
    chop: ChopSettings = field(default_factory=ChopSettings)


@dataclass(frozen=True)
class Universe:
    """Which symbol plays which part. All but target and vol_index may be missing from the bars."""

    target: str
    vol_index: str
    sectors: tuple[str, ...] = ()
    growth: str = ""
    high_yield: str = ""
    mid_duration: str = ""
    long_duration: str = ""
    gold: str = ""
    copper: str = ""
    short_rate: str = ""
    long_rate: str = ""

    def symbols(self) -> list[str]:
        single = (self.target, self.vol_index, self.growth, self.high_yield, self.mid_duration, self.long_duration, self.gold, self.copper, self.short_rate, self.long_rate)
        return sorted({s for s in (*single, *self.sectors) if s})
