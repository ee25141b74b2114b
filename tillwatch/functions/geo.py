"""Great-circle distance, implied travel speed, and the province lookup."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .times import HOUR

EARTH_RADIUS_KM = 6371.0

# Province id, name, latitude, longitude.
PROVINCES = [
    (1, "Phnom Penh", 11.5564, 104.9282),
    (2, "Banteay Meanchey", 13.6673, 102.8975),
    (3, "Battambang", 13.0957, 103.2022),
    (4, "Kampong Cham", 11.9934, 105.4645),
    (5, "Kampong Chhnang", 12.25, 104.6667),
    (6, "Kampong Speu", 11.4532, 104.5208),
    (7, "Kampong Thom", 12.7111, 104.8887),
    (8, "Kampot", 10.6096, 104.1806),
    (9, "Kandal", 11.4842, 104.9492),
    (10, "Kep", 10.4828, 104.3167),
    (11, "Koh Kong", 11.6152, 102.9838),
    (12, "Kratie", 12.4881, 106.0188),
    (13, "Mondulkiri", 12.4558, 107.1881),
    (14, "Oddar Meanchey", 14.1782, 103.5181),
    (15, "Pailin", 12.8489, 102.6092),
    (16, "Preah Sihanouk", 10.6261, 103.5201),
    (17, "Preah Vihear", 13.8074, 104.9804),
    (18, "Pursat", 12.5333, 103.9167),
    (19, "Prey Veng", 11.4869, 105.3253),
    (20, "Ratanakiri", 13.7394, 106.9873),
    (21, "Siem Reap", 13.3633, 103.8564),
    (22, "Stung Treng", 13.5259, 105.9683),
    (23, "Svay Rieng", 11.0878, 105.7994),
    (24, "Takeo", 10.9904, 104.7846),
    (25, "Tboung Khmum", 11.9389, 105.6514),
]


def coordinate(col: Column) -> Column:
    """Ledger coordinates may be text; anything unreadable counts as missing."""
    return col.try_cast("double")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = (F.radians(lat2) - F.radians(lat1)) / 2
    half_lon = (F.radians(lon2) - F.radians(lon1)) / 2
    chord = F.pow(F.sin(half_lat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(half_lon), F.lit(2.0))
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), chord))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(clamped))


def speed_kmh(
    us: Column, lat: Column, lon: Column, prev_us: Column, prev_lat: Column, prev_lon: Column
) -> Column:
    """Speed needed from the previous place; 0 when either place or the gap is missing."""
    known = (
        lat.isNotNull() & lon.isNotNull() & prev_lat.isNotNull() & prev_lon.isNotNull()
        & (us > prev_us)
    )
    hours = (us - prev_us) / F.lit(float(HOUR))
    return F.when(known, haversine_km(prev_lat, prev_lon, lat, lon) / hours).otherwise(F.lit(0.0))


def nearest_province(lat: Column, lon: Column) -> Column:
    """Struct (km, id, province) of the closest province, ties to the lower id.

    The fixed list is folded into the expression, so this is a projection: no
    join and no shuffle.  Without coordinates the struct is NULL.
    """
    options = F.array(
        *[
            F.struct(
                haversine_km(lat, lon, F.lit(plat), F.lit(plon)).alias("km"),
                F.lit(pid).alias("id"),
                F.lit(name).alias("province"),
            )
            for pid, name, plat, plon in PROVINCES
        ]
    )
    return F.when(lat.isNotNull() & lon.isNotNull(), F.array_min(options))
