"""Star luminosities, dust attenuation, marker and point-spread shading as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dust opacity per band (cm²/g) and the factor to code units for columns in Msun/pc².
TO_CODE = 2.0834e-4
BANDS = {"U": 700.0, "B": 440.0, "V": 200.0, "R": 140.0, "I": 100.0}
RGB_BANDS = ("I", "V", "B")


def kappa(band: str) -> float:
    return BANDS[band] * TO_CODE


def zams_luminosity(mass: Column) -> Column:
    """Main-sequence luminosity in solar units, piecewise in mass."""
    return (
        F.when(mass < 0.43, 0.23 * F.pow(mass, F.lit(2.3)))
        .when(mass < 2.0, mass * mass * mass * mass)
        .when(mass < 55.0, 1.4 * mass * mass * mass * F.sqrt(mass))
        .otherwise(32000.0 * mass)
    )


def star_mass(columns: Sequence[str], masses: Column) -> Column:
    """Raw ``Sink_Mass`` where the table has it (no unit correction), else the corrected masses."""
    return F.col("Sink_Mass").cast("double") if "Sink_Mass" in columns else masses


def star_luminosity(columns: Sequence[str], mass: Column, catalog: bool = False) -> Column:
    for name in ("StarLuminosity_Solar", "StarLuminosity"):
        if name in columns:
            return F.col(name).cast("double")
    return mass if catalog else zams_luminosity(mass)


def cluster_size_luminosity(mass_msun: Column, pc_in_code: float) -> Column:
    """Squared cluster radius, R = 10 pc·√(M/10⁴): the size law later takes its root."""
    r = F.lit(10.0 * pc_in_code) * F.sqrt(mass_msun / 1e4)
    return r * r


def attenuated(luminosity: Column, column: Column, opacity: Column | float) -> Column:
    return luminosity * F.exp(-(F.lit(opacity) if isinstance(opacity, float) else opacity) * column)


def redshift(aexp: Column) -> Column:
    return 1.0 / F.greatest(aexp, F.lit(1e-6)) - 1.0


def marker_radius(size: Column, world_radius: float, exponent: float, depth: Column, focal: float, height: int) -> Column:
    """World radius R·max(L,1e-6)^p, at least two pixels at that depth."""
    pixel = 2.0 * F.greatest(F.abs(depth), F.lit(1e-6)) / max(focal * height, 1e-6)
    base = F.greatest(size, F.lit(1e-6))
    grown = F.sqrt(base) if exponent == 0.5 else F.pow(base, F.lit(exponent))
    return F.greatest(world_radius * grown, 2.0 * pixel)


def marker_coordinate(value: Column, low: Column | float, high: Column | float, log: bool) -> Column:
    """Colour coordinate of a marker, clamped to 0..1."""
    v = F.log10(F.greatest(value, F.lit(1e-30))) if log else value
    lo, hi = (F.lit(b) if isinstance(b, float) else b for b in (low, high))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - lo) / F.greatest(hi - lo, F.lit(1e-12))))


def marker_shade(r: Column, fill: Sequence[Column], border: Sequence[float], border_frac: float) -> list[Column]:
    """Fill inside, border ring outside ``1 - border_frac`` of the radius."""
    inner = max(0.0, 1.0 - border_frac)
    return [F.when(r <= inner, f).otherwise(F.lit(float(b))) for f, b in zip(fill, border)]


def psf_shade(r2: Column, attenuation: Column, intensity: float) -> Column:
    """Peak-normalised Gaussian profile, root tone curve, times intensity and dimming."""
    return F.sqrt(F.exp(-8.0 * r2)) * intensity * F.greatest(F.lit(0.0), F.least(F.lit(1.0), attenuation))
