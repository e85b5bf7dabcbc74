"""Distances, areas and ranking scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Earth radius in metres, the inclusive city box, and the reach of proximity.
EARTH_RADIUS_M = 6_371_000
CITY_BOX = {"lat_min": 10.35, "lat_max": 10.55, "lng_min": -67.05, "lng_max": -66.75}
PROXIMITY_REACH_M = 20_000
# Search score weights.
MATCHING_BOOST = 10
TAG_WEIGHT = 3
VISIBLE_BOOST = 5
PROXIMITY_BONUS = 5
EXACT_TAG = 1000
VISIBLE_TAG_FACTOR = 5
GLOBAL_TAG_FACTOR = 0.01


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lng = F.radians(lng2 - lng1) / 2
    a = F.pow(F.sin(half_lat), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lng), F.lit(2))
    return F.lit(2.0 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def in_city(lat: Column, lng: Column) -> Column:
    """Inside the inclusive city box."""
    return lat.between(CITY_BOX["lat_min"], CITY_BOX["lat_max"]) & lng.between(CITY_BOX["lng_min"], CITY_BOX["lng_max"])


def in_quadrilateral(lat: Column, lng: Column, corners: list[tuple[float, float]]) -> Column:
    """Ray casting over the edges of a (lat, lng) polygon."""
    def crosses(a: tuple[float, float], b: tuple[float, float]) -> Column:
        (ya, xa), (yb, xb) = a, b
        if ya == yb:
            return F.lit(False)
        at = (F.lit(xb) - F.lit(xa)) * (lat - F.lit(ya)) / F.lit(yb - ya) + F.lit(xa)
        return ((F.lit(ya) > lat) != (F.lit(yb) > lat)) & (lng < at)
    edges = [crosses(corners[i], corners[i - 1]) for i in range(len(corners))]
    return reduce(lambda x, y: x != y, edges)


def coordinate_key(value: Column) -> Column:
    """Coordinate at five decimals, half up on the exact decimal."""
    return F.round(value.cast("decimal(10,6)"), 5).cast("decimal(10,5)")


def location_key(lat: Column, lng: Column) -> Column:
    return F.concat_ws(",", lat.cast("string"), lng.cast("string"))


def proximity_bonus(distance: Column, bonus: float = PROXIMITY_BONUS, reach: float = PROXIMITY_REACH_M) -> Column:
    """``bonus`` at the centre, falling to zero at ``reach`` metres."""
    return F.greatest(F.lit(0.0), F.lit(float(bonus)) * (1 - distance / F.lit(float(reach))))


def tag_weight(tag: Column, weights: dict[str, float]) -> Column:
    """What one matched tag adds to a score, only with two or more selected."""
    if len(weights) < 2:
        return F.lit(0.0)
    table = F.create_map(*[F.lit(x) for name, w in weights.items() for x in (name, float(w))])
    return F.coalesce(table[tag] * TAG_WEIGHT, F.lit(0.0))


def item_score(matching: Column, visible: Column, distance: Column, tag_score: Column) -> Column:
    """Score of a location or event (J5, J6; the bonus for time is constant zero)."""
    return (
        F.lit(1.0)
        + F.when(matching, MATCHING_BOOST).otherwise(0)
        + F.coalesce(tag_score, F.lit(0.0))
        + proximity_bonus(F.coalesce(distance, F.lit(0.0)))
        + F.when(visible, VISIBLE_BOOST).otherwise(0)
    )


def tag_score(dynamic: Column, exact: Column, visible_frequency: Column, total: Column) -> Column:
    """Score of a tag."""
    return (
        F.coalesce(dynamic, F.lit(0)).cast("double")
        + F.when(exact, EXACT_TAG).otherwise(0)
        + F.when(visible_frequency > 0, visible_frequency * VISIBLE_TAG_FACTOR + VISIBLE_BOOST).otherwise(0.0)
        + F.coalesce(total, F.lit(0)) * GLOBAL_TAG_FACTOR
    )
