"""Greenhouse-gas columns derived from fire radiative power and age."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberbasin.functions.columns import round_ties_even
from emberbasin.schemas import (
    CH4_KG_PER_MJ,
    CH4_WARMING,
    CO2_KG_PER_MJ,
    CO_KG_PER_MJ,
    N2O_KG_PER_MJ,
    N2O_WARMING,
)

SECONDS_PER_HOUR = 3600


def emission_columns(frp: Column, hours: Column) -> dict[str, Column]:
    """Energy and gas masses of one fire, each rounded as it is reported.

    The age of a detection serves as its burning time, so an age of zero gives
    zero emissions.
    """
    energy = frp * hours * SECONDS_PER_HOUR
    co2 = energy * CO2_KG_PER_MJ
    ch4 = energy * CH4_KG_PER_MJ
    n2o = energy * N2O_KG_PER_MJ
    equivalent = co2 + ch4 * CH4_WARMING + n2o * N2O_WARMING
    return {
        "total_energy_mj": round_ties_even(energy, 2),
        "co2_kg": round_ties_even(co2, 2),
        "ch4_kg": round_ties_even(ch4, 4),
        "n2o_kg": round_ties_even(n2o, 4),
        "co_kg": round_ties_even(energy * CO_KG_PER_MJ, 2),
        "total_co2e_kg": round_ties_even(equivalent, 2),
        "total_co2e_tonnes": round_ties_even(equivalent / 1000, 4),
    }


def emission_totals(frp: Column, hours: Column) -> list[Column]:
    """Aggregates over many fires: the count, sums of the rounded masses, mean CO2e per fire."""
    masses = emission_columns(frp, hours)
    summed = ["total_energy_mj", "co2_kg", "ch4_kg", "n2o_kg", "co_kg", "total_co2e_kg"]
    totals = [F.count(F.lit(1)).alias("fire_count")]
    totals += [F.coalesce(F.sum(masses[name]), F.lit(0.0)).alias(name) for name in summed]
    totals.append(F.avg(masses["total_co2e_kg"]).alias("co2e_kg_per_fire"))
    return totals
