"""Names that describe one panel; every operator takes one of these."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from monthloom.functions.fixed import WEATHER_COLUMNS

LAGS = (1, 2, 3, 6, 12)
ROLLS = (3, 6)


@dataclass(frozen=True)
class PanelSpec:
    """A panel has at most one row per (series, month).

    That uniqueness is what bounds every per-series window or array in this
    package: a group never holds more rows than there are months on record.
    """

    series: tuple[str, ...] = ("DRS",)
    time: str = "PERIODE"
    target: str = "cas"
    exog: tuple[str, ...] = WEATHER_COLUMNS
    lags: tuple[int, ...] = LAGS
    rolls: tuple[int, ...] = ROLLS
    exog_agg: dict[str, str] = field(default_factory=dict, hash=False)

    @property
    def keys(self) -> list[str]:
        return [*self.series, self.time]

    @property
    def depth(self) -> int:
        """Observed targets a forecast step can look back at."""
        return max(self.lags + self.rolls)

    def having(self, **changes) -> "PanelSpec":
        return replace(self, **changes)


REGION = PanelSpec()
DISTRICT = PanelSpec(series=("DISTRICT",), lags=tuple(range(1, 13)))
NATION = PanelSpec(series=(), exog_agg={"precipitation": "sum"})
