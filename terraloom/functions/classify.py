"""Classification ladders; the bounds are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def difficulty(n: Column) -> Column:
    return F.when(n <= 25, "easy").when(n <= 100, "medium").when(n <= 500, "hard").otherwise("extreme")


def distance_bucket(km: Column) -> Column:
    out = F.when(km < 1, "<1")
    for low, high in ((1, 2), (2, 5), (5, 10), (10, 20), (20, 50), (50, 100)):
        out = out.when(km < high, f"{low}-{high}")
    return out.otherwise("100+")


#: By kind of place, fixed values: weight, shift of the zoom from which a label shows, that zoom where the population is unknown.
PLACES = {
    "city": (500.0, -0.2, 6.0),
    "town": (400.0, 0.0, 7.0),
    "village": (300.0, 0.4, 8.0),
    "hamlet": (200.0, 1.0, 9.25),
    "suburb": (125.0, 1.5, 10.25),
    "isolated_dwelling": (75.0, 2.0, 11.0),
}
#: Label spacing in pixels below each zoom, and beyond the last.
SPACING = ((5, 90), (6, 80), (7, 70), (8, 60), (9, 50), (10, 42), (11, 35), (12, 30), (13, 25), (None, 20))


def _by_place(place: Column, which: int) -> Column:
    table = F.create_map(*[F.lit(x) for name, values in PLACES.items() for x in (name, values[which])])
    return F.element_at(table, place)


def significance_tier(place: Column, population: Column, capital: Column, first_order: Column) -> Column:
    """0 to 5 by population, or by rank as a capital, or by kind of place."""
    people = F.coalesce(population, F.lit(0))
    ladder = F.when(capital | (people >= 1_000_000), 0).when(first_order | (people >= 250_000), 1).when(people >= 75_000, 2)
    return ladder.when(place.isin("city", "town") | (people >= 20_000), 3).when(place.isin("village", "hamlet"), 4).otherwise(5)


def importance(tier: Column, place: Column, population: Column, capital: Column, first_order: Column, regional: Column) -> Column:
    """A thousand for each tier above 5, the place's weight, log10(population) * 140, and what the best rank as a capital adds."""
    size = F.when(population > 0, F.log10(population.cast("double")) * 140.0).otherwise(F.lit(0.0))
    rank = F.when(capital, 500.0).when(first_order, 25.0).when(regional, 20.0).otherwise(0.0)
    return (5 - tier) * 1000.0 + _by_place(place, 0) + size + rank


def min_zoom(place: Column, population: Column, capital: Column, first_order: Column, regional: Column, low: float = 3.5, high: float = 14.0) -> Column:
    """Zoom from which a label shows, in [low, high]: 10.5 - log10(population) with the place's shift, or by place alone."""
    zoom = F.when(population > 0, 10.5 - F.log10(population.cast("double")) + _by_place(place, 1)).otherwise(_by_place(place, 2))
    zoom = F.when(capital, F.least(zoom, F.lit(3.75))).otherwise(zoom)
    zoom = F.when(first_order, F.least(zoom - 0.05, F.lit(4.9))).otherwise(zoom)
    zoom = F.when(regional, zoom - 0.05).otherwise(zoom)
    return F.greatest(F.lit(low), F.least(F.lit(high), zoom))


def marker_type(place: Column, population: Column, capital: Column, first_order: Column, regional: Column) -> Column:
    """Kind of the marker of a settlement; null for a plain one."""
    people = F.coalesce(population, F.lit(0))
    large = (people >= 100_000) | ((place == "city") & ((people >= 50_000) | regional))
    return F.when(capital, "country-capital").when(first_order, "admin-capital").when(large, "major-city")


def label_spacing(zoom: Column) -> Column:
    """Least distance of labels in pixels at a zoom."""
    out = None
    for bound, pixels in SPACING[:-1]:
        out = F.when(zoom < bound, pixels) if out is None else out.when(zoom < bound, pixels)
    return out.otherwise(SPACING[-1][1])


def spacing_at(zoom: float) -> int:
    """:func:`label_spacing` of a known zoom."""
    return next(pixels for bound, pixels in SPACING if bound is None or zoom < bound)


def label_delay(tier: Column) -> Column:
    """The most zoom levels by which crowding may delay a label."""
    return F.when(tier <= 2, 0.0).when(tier == 3, 0.5).when(tier == 4, 1.25).otherwise(1.75)


def outlier_severity(same_near: Column, other_near: Column, same_middle: Column, other_middle: Column, same_far: Column, other_far: Column) -> Column:
    """How a code disagrees with others within three radii (5, 15 and 50 km): 3 isolated, 2 outnumbered, 1 mixed or thinly contradicted, 0 fine."""
    near, middle, far = same_near + other_near, same_middle + other_middle, same_far + other_far
    return (
        F.when((same_middle == 0) & (other_middle >= 5), 3)
        .when((near >= 5) & (same_near <= 0.20 * near), 2)
        .when((middle >= 8) & (same_middle <= 0.25 * middle), 2)
        .when((same_middle >= 2) & (other_middle >= 2), 1)
        .when((far >= 5) & (same_far == 0) & (other_far >= 5), 1)
        .otherwise(0)
    )


def seed_severity(same: Column, leader_differs: Column, leader: Column, dispersed: Column) -> Column:
    """How unlikely a seed is, from its ten nearest: those of its own code, the leading code's count and whether it is another
    code, and whether the seed's number also stands far away. 3 to exclude, 2 suspicious, 1 to review, 0 consistent."""
    return (
        F.when((same == 0) & leader_differs & ((leader >= 9) | (leader >= 8) & dispersed), 3)
        .when(dispersed & (same <= 2), 2)
        .when((same <= 1) & leader_differs & (leader >= 7), 2)
        .when((same <= 3) & leader_differs & (leader >= 6), 1)
        .otherwise(0)
    )


def dominance(first: Column, second: Column, total: Column) -> Column:
    """How clear a vote is: unanimous, dominant (of 3 votes, twice the runner-up), majority (of 5, 60 %), else ambiguous."""
    return (
        F.when(total <= 0, "none")
        .when(first == total, "unanimous")
        .when((total >= 3) & (first >= 2 * second), "dominant")
        .when((total >= 5) & (first >= 0.6 * total), "majority")
        .otherwise("ambiguous")
    )


def vote_status(winner: Column, samples: Column) -> Column:
    """Confidence of a pixel vote by the winner's share: HIGH from 0.80 on with 20 pixels, REVIEW from 0.60 on."""
    return F.when(samples == 0, "UNCLASSIFIED").when((winner >= 0.80) & (samples >= 20), "HIGH").when(winner >= 0.60, "REVIEW").otherwise("UNCERTAIN")


#: Colours of right and wrong answers, and how much of them one answered right away shows (fixed values).
RIGHT, WRONG, LEAST_STRENGTH = (34, 197, 94), (239, 68, 68), 0.25


def feature_colour(right: Column, wrong: Column, total: Column, normal: tuple[int, int, int], shading: bool = True) -> Column:
    """Colour (r, g, b, a) of a feature with ``total`` answers: red to green by accuracy, over the normal colour by completion; not answered at all, it is
    the normal colour, seen only with shading."""
    done = right + wrong
    accuracy = F.try_divide(right, done)
    strength = F.try_divide(done, total) * (1 - LEAST_STRENGTH) + LEAST_STRENGTH
    mixed = lambda n, w, r: F.when(done > 0, n * (1 - strength) + (w * (1 - accuracy) + r * accuracy) * strength).otherwise(F.lit(float(n)))
    channels = [mixed(n, w, r).alias(c) for c, n, w, r in zip("rgb", normal, WRONG, RIGHT, strict=True)]
    return F.struct(*channels, F.when(done > 0, 1.0).otherwise(1.0 if shading else 0.0).alias("a"))


def colour_between(share: Column, low: tuple[int, int, int] = (220, 38, 38), high: tuple[int, int, int] = (22, 163, 74)) -> Column:
    """CSS colour at a share of the way between two."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    return F.format_string("rgb(%d, %d, %d)", *[F.round(F.lit(float(a)) + (F.lit(float(b)) - a) * x).cast("int") for a, b in zip(low, high, strict=True)])
