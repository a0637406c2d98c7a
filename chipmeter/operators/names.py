"""Reading facts out of scene and chip names, and places in the year and on the globe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Export suffix, chip offsets and the parts of a product name.
EXPORT = r"_png\.rf\.[0-9a-f]{32}"
OFFSETS = r"^(.*)_r(\d+)_c(\d+)$"
PRODUCT = r"^(S2[AB])_MSIL1C_(\d{8})T(\d{6})_N\d{4}_R(\d{3})_T(\d{2}[A-Z]{3})_"
#: Tiles of each region.
TILE_REGION = {"25WER": "KQ", "24VWQ": "SK", "22WEA": "SK"}


def group(name: Column, pattern: str, k: int) -> Column:
    """Group of a pattern, NULL where the pattern doesn't match."""
    return F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))


def without_suffix(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, EXPORT, ""), r"\.tif$", "")


def chip_parts(stem: Column) -> Column:
    """struct(stem, row, col) of a chip name; row and col are NULL and the stem is whole where there are no offsets."""
    return F.struct(
        F.coalesce(group(stem, OFFSETS, 1), stem).alias("stem"), group(stem, OFFSETS, 2).cast("int").alias("row"), group(stem, OFFSETS, 3).cast("int").alias("col")
    )


def chip_key(stem: Column, row: Column, col: Column) -> Column:
    return F.when(row.isNotNull() & col.isNotNull(), F.format_string("%s_r%04d_c%04d", stem, row, col)).otherwise(F.concat(F.lit("null_"), stem))


def scene_parts(name: Column) -> Column:
    stamp = F.try_to_timestamp(F.concat(group(name, PRODUCT, 2), group(name, PRODUCT, 3)), F.lit("yyyyMMddHHmmss"))
    return F.struct(group(name, PRODUCT, 1).alias("satellite"), stamp.alias("acquired"), group(name, PRODUCT, 4).cast("int").alias("orbit"), group(name, PRODUCT, 5).alias("tile"))


def region_of(tile: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in TILE_REGION.items() for x in kv])
    return F.coalesce(table[tile], F.lit("unknown"))


def sza_bin(degrees: Column) -> Column:
    """Bin of an angle given as text or number; what is not a number has no bin."""
    d = degrees.try_cast("double")
    return F.when(d.isNull() | F.isnan(d), "sza_unknown").when(d < 65, "sza_lt65").when(d < 70, "sza_65_70").when(d < 75, "sza_70_75").otherwise("sza_gt75")


def solar_zenith(at: Column, lat: Column, lon: Column) -> Column:
    """Zenith angle of the sun in degrees by the low-precision formulas of the Astronomical Almanac (about 0.01 degrees)."""
    n = F.unix_timestamp(at) / 86400.0 - 10957.5  # days from 2000-01-01 12:00
    mean = F.radians(F.pmod(F.lit(357.528) + F.lit(0.9856003) * n, F.lit(360.0)))
    ecl = F.radians(F.pmod(F.lit(280.460) + F.lit(0.9856474) * n, F.lit(360.0)) + F.lit(1.915) * F.sin(mean) + F.lit(0.020) * F.sin(2 * mean))
    tilt = F.radians(F.lit(23.439) - F.lit(0.0000004) * n)
    right = F.atan2(F.cos(tilt) * F.sin(ecl), F.cos(ecl))
    decl = F.asin(F.sin(tilt) * F.sin(ecl))
    sidereal = F.radians(F.pmod(F.lit(280.46061837) + F.lit(360.98564736629) * n + lon, F.lit(360.0)))
    cos_z = F.sin(F.radians(lat)) * F.sin(decl) + F.cos(F.radians(lat)) * F.cos(decl) * F.cos(sidereal - right)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos_z))))
