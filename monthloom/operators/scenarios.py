"""What-if adjustments of the measures, all scenarios in one plan."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.functions import fixed, maths
from monthloom.spec import PanelSpec

TEMPERATURES = ("temperature_moyenne", "temperature_max", "temperature_min")


@dataclass(frozen=True)
class Adjustment:
    """Relative change of rain, wind and sun in %, absolute of the others."""

    name: str
    precip_pct: float = 0.0
    temp_delta: float = 0.0
    humid_delta: float = 0.0
    wind_pct: float = 0.0
    solar_pct: float = 0.0

    def is_neutral(self) -> bool:
        return not any(v for k, v in asdict(self).items() if k != "name")

    def as_column(self) -> Column:
        return F.struct(*[F.lit(v).alias(k) for k, v in asdict(self).items()])


def relative_presets() -> list[Adjustment]:
    return [
        Adjustment(name, float(rain), float(temp), float(humid), float(wind), float(sun))
        for name, rain, temp, humid, wind, sun in fixed.RELATIVE_SCENARIOS
    ]


def absolute_presets() -> dict[str, dict[str, float]]:
    """Measures of each absolute scenario; one temperature serves all three columns."""
    return {
        name: {
            **dict.fromkeys(TEMPERATURES, temp),
            "precipitation": rain, "humidite": humid, "vent": wind, "rayonnement_solaire": sun,
        }
        for name, temp, rain, humid, wind, sun in fixed.ABSOLUTE_SCENARIOS
    }


def adjusted_measures(scenario: Column) -> dict[str, Column]:
    """Adjusted measures given a scenario struct column."""
    def scaled(name: str, pct: str) -> Column:
        return maths.at_least_zero(F.col(name) * (1 + scenario[pct] / 100))

    columns = {t: F.col(t) + scenario["temp_delta"] for t in TEMPERATURES}
    columns["precipitation"] = scaled("precipitation", "precip_pct")
    columns["humidite"] = maths.between(F.col("humidite") + scenario["humid_delta"], 0.0, 100.0)
    columns["vent"] = scaled("vent", "wind_pct")
    columns["rayonnement_solaire"] = scaled("rayonnement_solaire", "solar_pct")
    return columns


def apply_adjustments(weather: DataFrame, scenarios: list[Adjustment], name: str = "scenario") -> DataFrame:
    """Every weather row under every scenario.

    The scenarios ride along as a constant array that each row unfolds, so no
    second table and no shuffle is involved.
    """
    constant = F.array(*[s.as_column() for s in scenarios])
    unfolded = weather.withColumn("_s", F.explode(constant))
    return unfolded.withColumns({name: F.col("_s.name"), **adjusted_measures(F.col("_s"))}).drop("_s")


def apply_absolute(months: DataFrame, spec: PanelSpec, presets: dict[str, dict[str, float]], name: str = "scenario") -> DataFrame:
    """Every month under every absolute scenario."""
    constant = F.array(*[
        F.struct(F.lit(key).alias("name"), *[F.lit(float(values[m])).alias(m) for m in spec.exog])
        for key, values in presets.items()
    ])
    return (
        months.select(*spec.keys, F.explode(constant).alias("_s"))
        .select(F.col("_s.name").alias(name), *spec.keys, *[F.col(f"_s.{m}").alias(m) for m in spec.exog])
    )


def scenario_totals(forecast: DataFrame, base: str = fixed.BASE_SCENARIO, name: str = "scenario") -> DataFrame:
    """Total of each scenario, its change on the base in %, and how many months have no prediction.

    The totals, one row per scenario, are packed into one row to meet the
    base, so the forecast behind them is evaluated once.
    """
    totals = forecast.groupBy(name).agg(
        F.sum("prediction").alias("total"), F.sum(F.col("prediction").isNull().cast("long")).alias("unanswered"))
    packed = totals.agg(F.collect_list(F.struct(name, "total", "unanswered")).alias("_all"))
    base_total = F.get(F.filter("_all", lambda r: r[name] == base), 0)["total"]
    return packed.select(base_total.alias("_base"), F.inline("_all")).select(
        name, "total",
        F.when(F.col(name) != base, maths.change_percent(F.col("total"), F.col("_base"))).alias("vs_base_percent"),
        "unanswered",
    )


def scenario_gaps(forecast: DataFrame, spec: PanelSpec, base: str = fixed.BASE_SCENARIO, name: str = "scenario") -> DataFrame:
    """Prediction of each other scenario and its monthly difference to the base.

    One grouping by series and month, whose groups hold one row per scenario.
    """
    grouped = forecast.groupBy(*spec.keys).agg(
        F.max(F.when(F.col(name) == base, F.col("prediction"))).alias("_base"),
        F.collect_list(F.struct(name, "prediction")).alias("_all"),
    )
    return (
        grouped.select(*spec.keys, "_base", F.inline("_all"))
        .filter(F.col(name) != base)
        .select(name, *spec.keys, "prediction", (F.col("prediction") - F.col("_base")).alias("gap"))
    )


def scenario_columns(forecast: DataFrame, keys: list[str], names: list[str], name: str = "scenario") -> DataFrame:
    """One column per scenario, aligned by the keys, rounded half-even."""
    return forecast.groupBy(*keys).pivot(name, names).agg(F.bround(F.first("prediction"), 0))
