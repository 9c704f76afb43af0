"""Regimes of markets from persistence, stationarity, strength of trend, volatility and liquidity, and what they do to convictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The unit-root statistic's critical value, the strength from which there is a trend, the least liquidity, the share of volatility that is stress.
UNIT_ROOT, TREND, LEAST_LIQUIDITY, STRESS = -2.86, 25.0, 0.3, 0.85
#: Each regime's factor on the conviction of the families of strategies.
FAMILIES = ("continuation", "reversion", "breakout", "skew", "event")
FACTORS = {
    "trending_bull": (1.25, 0.6, 1.15, 0.95, 1.0),
    "trending_bear": (1.1, 0.55, 0.85, 1.05, 0.95),
    "mean_reverting": (0.6, 1.3, 0.7, 1.1, 1.0),
    "high_volatility": (0.55, 0.7, 0.6, 1.15, 0.8),
    "low_volatility_drift": (1.05, 0.9, 1.3, 0.9, 1.0),
    "illiquid": (0.3, 0.3, 0.3, 0.4, 0.5),
}
INPUTS = ("hurst", "adf", "adx", "di_spread", "vol_share", "liquidity", "primary_trend")


def _within(x: str, low: float = -1.0, high: float = 1.0) -> str:
    return f"greatest({low}D, least({high}D, {x}))"


def regimes(rows: DataFrame) -> DataFrame:
    """The rows with trend_score, reversion_score, label, confidence and beneath, which is the label without the rule of liquidity.

    Of INPUTS, a null is the value of a market without a finding: 0.5 for hurst, vol_share and liquidity, 0 for the others.
    Illiquidity comes first, then stress, then the stronger case of a trend or of reversion; without a case, a quiet market drifts."""
    given = {c: f"coalesce({c}, {'0.5D' if c in ('hurst', 'vol_share', 'liquidity') else '0.0D'})" for c in INPUTS}
    x = rows.withColumn("_in", F.expr("named_struct(" + ", ".join(f"'{c}', CAST({v} AS DOUBLE)" for c, v in given.items()) + ")"))
    persistent, still, strong = _within("(_in.hurst - 0.5D) / 0.15D"), _within(f"({UNIT_ROOT}D - _in.adf) / 1.5D"), _within(f"(_in.adx - {TREND}D) / 15")
    x = x.withColumn("trend_score", F.expr(f"0.4D * {persistent} + 0.6D * {strong}")).withColumn("reversion_score", F.expr(f"0.55D * {still} - 0.45D * {persistent}"))
    rising = "(_in.di_spread > 0 OR (abs(_in.di_spread) < 2 AND _in.primary_trend > 0))"
    found = lambda label, confidence: f"named_struct('label', {label}, 'confidence', CAST({confidence} AS DOUBLE))"
    side = lambda up: f"if({up}, 'trending_bull', 'trending_bear')"
    beneath = f"""CASE WHEN _in.vol_share >= {STRESS}D THEN {found("'high_volatility'", _within(f'(_in.vol_share - {STRESS}D) / (1 - {STRESS}D)', 0.4, 0.98))}
      WHEN trend_score > 0.2D AND trend_score >= reversion_score THEN {found(side(rising), _within('0.5D + trend_score / 2', 0.4, 0.97))}
      WHEN reversion_score > 0.2D THEN {found("'mean_reverting'", _within('0.5D + reversion_score / 2', 0.4, 0.97))}
      WHEN _in.vol_share < 0.3D THEN {found("'low_volatility_drift'", _within('0.8D - _in.vol_share', 0.4, 0.9))}
      WHEN trend_score >= reversion_score THEN {found(side('_in.di_spread > 0'), '0.35D')} ELSE {found("'mean_reverting'", '0.35D')} END"""
    dry = f"_in.liquidity < {LEAST_LIQUIDITY}D"
    dry_confidence = _within(f"({LEAST_LIQUIDITY}D - _in.liquidity) / {LEAST_LIQUIDITY}D", 0.35, 0.98)
    x = x.withColumn("_out", F.expr(beneath))
    x = x.withColumn("label", F.expr(f"if({dry}, 'illiquid', _out.label)")).withColumn("confidence", F.expr(f"if({dry}, {dry_confidence}, _out.confidence)")).withColumn("beneath", F.col("_out.label"))
    return x.drop("_in", "_out")


def factors(rows: DataFrame, label: str = "label") -> DataFrame:
    """The rows, once for each family, with the factor that the label puts on its convictions."""
    table = F.create_map(*[x for name, own in FACTORS.items() for x in (F.lit(name), F.array(*[F.struct(F.lit(f).alias("family"), F.lit(v).alias("factor")) for f, v in zip(FAMILIES, own, strict=True)]))])
    return rows.select("*", F.explode(table[F.col(label)]).alias("_f")).select("*", "_f.*").drop("_f")
