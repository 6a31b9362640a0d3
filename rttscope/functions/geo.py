"""Coordinates, distances and bands."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from rttscope import contract as K


def coordinates(lon: Column, lat: Column) -> Column:
    """(lon, lat) when both are numbers inside the globe's ranges, else NULL."""
    lon, lat = lon.try_cast("double"), lat.try_cast("double")
    return F.when(
        lon.between(-180, 180) & lat.between(-90, 90), F.struct(lon.alias("lon"), lat.alias("lat"))
    )


def haversine_km(a: Column, b: Column) -> Column:
    """Great-circle distance of two (lon, lat) structs, one decimal."""
    lat1, lat2 = F.radians(a["lat"]), F.radians(b["lat"])
    dlat, dlon = lat2 - lat1, F.radians(b["lon"]) - F.radians(a["lon"])
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin(dlon / 2), 2)
    # least() skips NULL, so a missing coordinate is guarded explicitly
    bounded = F.when(h.isNotNull(), F.least(h, F.lit(1.0)))
    return F.round(2 * K.EARTH_RADIUS_KM * F.asin(F.sqrt(bounded)), 1)


def distance_band(km: Column) -> Column:
    return (
        F.when(km < K.BAND_SHORT_KM, "curta").when(km < K.BAND_MEDIUM_KM, "media")
        .when(km.isNotNull(), "longa")
    )
