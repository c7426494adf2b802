"""Rules that sort points of interest into sectors, classes, weights and radii."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tags import any_of, tag

# ---- fixed values: which tags make a point of interest relevant -------------------------------------------------
WHITELIST = {
    "amenity": (
        "courthouse", "townhall", "bank", "post_office", "university", "college", "school", "kindergarten",
        "marketplace", "conference_centre", "concert_hall", "exhibition_centre", "theatre", "planetarium",
        "events_venue", "library", "cinema", "music_school", "public_bath", "community_centre", "place_of_worship",
        "clinic", "hospital", "pharmacy", "doctors", "dentist", "social_facility", "nursing_home", "youth_centre",
        "social_centre",
    ),
    "office": ("government", "employment_agency"),
    "shop": (
        "mall", "department_store", "chemist", "general", "beverages", "supermarket", "bakery", "butcher",
        "convenience", "kiosk",
    ),
    "tourism": ("aquarium", "gallery", "museum", "theme_park", "zoo"),
    "leisure": ("stadium", "water_park", "sports_centre", "sports_hall"),
    "healthcare": ("clinic", "hospital", "pharmacy", "doctor", "dentist", "centre"),
}

# ---- fixed values: sectors, first match wins ---------------------------------------------------------------------
SECTORS = {
    "GOVERNMENT": {
        "amenity": ("courthouse", "townhall", "bank", "post_office"),
        "office": ("government", "employment_agency"),
    },
    "EDUCATION": {"amenity": ("university", "college", "school", "kindergarten")},
    "RETAIL": {"shop": WHITELIST["shop"], "amenity": ("marketplace",)},
    "LEISURE": {
        "tourism": WHITELIST["tourism"],
        "leisure": WHITELIST["leisure"],
        "amenity": (
            "conference_centre", "concert_hall", "exhibition_centre", "theatre", "planetarium", "events_venue",
            "library", "cinema", "music_school", "public_bath", "community_centre", "place_of_worship",
        ),
    },
    "HEALTHCARE": {
        "amenity": (
            "clinic", "hospital", "pharmacy", "doctors", "dentist", "social_facility", "nursing_home",
            "youth_centre", "social_centre",
        ),
        "healthcare": WHITELIST["healthcare"],
    },
}
SECTOR_NAMES = tuple(SECTORS)

# ---- fixed values: class letters inside each sector, tested in this order; the last entry is the default ----------
# (letter, pattern on the school level, wanted tags, pattern on all names)
CLASSES = {
    "EDUCATION": (
        (
            "F", ".*[5-8].*", {"amenity": ("university", "college", "research_institute")},
            "(universit|hochschule|akademie|fakult|college|academy|faculty|polytechnic|seminary)",
        ),
        (
            "D", "^[01;-]+$", {"amenity": ("kindergarten",)},
            "(grundschule|primarschule|kindergarten|kita|vorschule|primary|elementary|nursery|maternelle|preescolar)",
        ),
        ("E", None, {}, None),
    ),
    "GOVERNMENT": (
        ("C", None, {"amenity": ("courthouse",)}, "(gericht|justiz|court|tribunal|juzgado|суд)"),
        (
            "B", None,
            {"amenity": ("social_facility",), "office": ("government", "employment_agency", "lawyer", "notary")},
            "(amt|behörde|bureau|administration|администрация)",
        ),
        ("A", None, {}, None),
    ),
    "HEALTHCARE": (
        (
            "O", None, {"amenity": ("hospital",), "healthcare": ("hospital", "hospice", "rehabilitation")},
            "(krankenhaus|klinikum|spital|hospital|hôpital|больница|医院|病院)",
        ),
        (
            "M", None,
            {"amenity": ("pharmacy",), "healthcare": ("pharmacy",), "shop": ("chemist", "drugstore")},
            "(apotheke|pharmacy|chemist|drugstore|pharmacie|farmacia|аптека|药店|薬局)",
        ),
        ("N", None, {}, None),
    ),
    "LEISURE": (
        (
            "L", None,
            {
                "leisure": ("stadium", "water_park"),
                "tourism": ("theme_park", "zoo", "aquarium", "attraction"),
                "amenity": ("conference_centre", "exhibition_centre", "events_venue"),
            },
            "(stadion|stadium|zoo|freizeitpark|theme park|messe|exhibition|parc d'attraction)",
        ),
        (
            "K", None,
            {
                "leisure": ("sports_centre", "sports_hall"),
                "amenity": (
                    "cinema", "theatre", "public_bath", "arts_centre", "concert_hall", "planetarium", "music_school",
                ),
                "tourism": ("museum",),
            },
            "(kino|cinema|theater|theatre|museum|musée|sporthalle|sports centre|体育中心)",
        ),
        ("J", None, {}, None),
    ),
    "RETAIL": (
        (
            "T", None, {"shop": ("mall", "department_store")},
            "(einkaufszentrum|kaufhaus|shopping cent|department store|mall|commercial|торговый центр)",
        ),
        (
            "S", None,
            {
                "shop": (
                    "clothes", "electronics", "furniture", "doityourself", "books", "shoes", "sports", "general",
                )
            },
            "(baumarkt|möbelhaus|fachmarkt|diy|bricolage|furniture|electronics|fashion|одежда)",
        ),
        ("R", None, {}, None),
    ),
}
NAME_KEYS = (
    "name", "name:en", "name:de", "name:es", "name:fr", "name:pt", "name:ru", "name:ar", "name:zh", "name:ja",
    "name:hi", "alt_name", "official_name",
)

# ---- fixed values: (key, value, weight), first match wins ----------------------------------------------------------
WEIGHTS = (
    ("amenity", "courthouse", 4), ("office", "government", 3), ("office", "employment_agency", 3),
    ("amenity", "townhall", 2), ("amenity", "bank", 1), ("amenity", "post_office", 1), ("amenity", "university", 4),
    ("amenity", "college", 3), ("amenity", "school", 2), ("amenity", "kindergarten", 2), ("shop", "mall", 4),
    ("shop", "department_store", 2), ("amenity", "marketplace", 3), ("shop", "chemist", 2), ("shop", "general", 2),
    ("shop", "beverages", 2), ("shop", "supermarket", 2), ("shop", "bakery", 1), ("shop", "butcher", 1),
    ("shop", "convenience", 1), ("shop", "kiosk", 1), ("tourism", "aquarium", 4), ("amenity", "conference_centre", 4),
    ("amenity", "concert_hall", 4), ("tourism", "gallery", 4), ("amenity", "exhibition_centre", 4),
    ("tourism", "museum", 4), ("amenity", "theatre", 4), ("amenity", "planetarium", 4), ("leisure", "stadium", 4),
    ("tourism", "theme_park", 4), ("amenity", "events_venue", 4), ("tourism", "zoo", 4), ("amenity", "library", 3),
    ("leisure", "water_park", 3), ("amenity", "cinema", 3), ("amenity", "music_school", 3),
    ("leisure", "sports_centre", 2), ("amenity", "public_bath", 3), ("amenity", "community_centre", 3),
    ("amenity", "place_of_worship", 2), ("leisure", "sports_hall", 2), ("amenity", "clinic", 3),
    ("healthcare", "clinic", 3), ("amenity", "hospital", 3), ("healthcare", "hospital", 3), ("amenity", "pharmacy", 2),
    ("healthcare", "pharmacy", 2), ("amenity", "doctors", 2), ("healthcare", "doctor", 2), ("amenity", "dentist", 2),
    ("healthcare", "dentist", 2), ("healthcare", "centre", 2), ("amenity", "social_facility", 2),
    ("amenity", "nursing_home", 2), ("amenity", "youth_centre", 2), ("amenity", "social_centre", 2),
)
RADII = ((4, 500), (3, 250), (2, 175), (1, 100))

# ---- fixed values: (key, value, description), first match wins -----------------------------------------------------
DESCRIPTIONS = (
    ("amenity", "courthouse", "Court of law for legal proceedings"),
    ("office", "government", "Government office or public administration"),
    ("office", "employment_agency", "Employment or job center"),
    ("office", "lawyer", "Lawyer or legal office"),
    ("amenity", "bank", "Bank or financial institution"),
    ("office", "notary", "Notary public office"),
    ("amenity", "post_office", "Post office for mail services"),
    ("amenity", "townhall", "Town hall or city administration"),
    ("amenity", "social_facility", "Social or care facility"),
    ("amenity", "university", "University or higher education"),
    ("amenity", "college", "College or vocational school"),
    ("amenity", "kindergarten", "Kindergarten or preschool"),
    ("amenity", "school", "Primary or secondary school"),
    ("shop", "mall", "Shopping mall with many stores"),
    ("shop", "department_store", "Large department store"),
    ("amenity", "marketplace", "Marketplace or weekly market"),
    ("shop", "chemist", "Chemist or drugstore"),
    ("shop", "general", "General or mixed goods store"),
    ("shop", "beverages", "Beverage or drinks shop"),
    ("shop", "supermarket", "Supermarket for groceries"),
    ("shop", "bakery", "Bakery for bread and pastries"),
    ("shop", "butcher", "Butcher shop for meat"),
    ("shop", "convenience", "Convenience store for daily needs"),
    ("shop", "kiosk", "Kiosk or small booth"),
    ("tourism", "aquarium", "Aquarium for aquatic life"),
    ("amenity", "conference_centre", "Conference or convention center"),
    ("amenity", "concert_hall", "Concert hall for live music"),
    ("amenity", "arts_centre", "Arts or cultural center"),
    ("tourism", "gallery", "Art gallery for exhibitions"),
    ("amenity", "exhibition_centre", "Exhibition or trade fair center"),
    ("tourism", "museum", "Museum for history or art"),
    ("amenity", "theatre", "Theatre or opera house"),
    ("amenity", "planetarium", "Planetarium for astronomy shows"),
    ("tourism", "attraction", "Tourist attraction or landmark"),
    ("leisure", "stadium", "Stadium for sports and events"),
    ("tourism", "theme_park", "Theme park or amusement park"),
    ("amenity", "events_venue", "Events or performance venue"),
    ("tourism", "zoo", "Zoo for animals"),
    ("amenity", "library", "Library for books and study"),
    ("leisure", "water_park", "Water park or outdoor pool"),
    ("amenity", "cinema", "Cinema or movie theater"),
    ("amenity", "music_school", "Music school for lessons"),
    ("leisure", "sports_centre", "Sports center or gym"),
    ("amenity", "public_bath", "Public bath or spa"),
    ("amenity", "community_centre", "Community or activity center"),
    ("amenity", "youth_centre", "Youth or children’s center"),
    ("amenity", "place_of_worship", "Religious building or church"),
    ("leisure", "sports_hall", "Indoor sports hall"),
    ("leisure", "pitch", "Sports pitch or field"),
    ("amenity", "social_centre", "Social meeting center"),
    ("amenity", "clinic", "Clinic for outpatient care"),
    ("healthcare", "clinic", "Clinic for outpatient care"),
    ("amenity", "hospital", "Hospital for medical care"),
    ("healthcare", "hospital", "Hospital for medical care"),
    ("amenity", "pharmacy", "Pharmacy for medicine"),
    ("healthcare", "pharmacy", "Pharmacy for medicine"),
    ("amenity", "doctors", "Doctors’ office or practice"),
    ("healthcare", "doctor", "Doctors’ office or practice"),
    ("amenity", "dentist", "Dentist office"),
    ("healthcare", "dentist", "Dentist office"),
    ("healthcare", "centre", "Medical center"),
)


def is_relevant(df: DataFrame) -> Column:
    return any_of(df, WHITELIST)


def _rank(df: DataFrame, rules: list[tuple[str, str, int]], default: int) -> Column:
    """Smallest rank among the rules (key, value, rank) that a row's tags meet, by one literal lookup per key."""
    by_key: dict[str, dict[str, int]] = {}
    for key, value, rank in rules:
        table = by_key.setdefault(key, {})
        table[value] = min(rank, table.get(value, rank))
    found = [F.lit(default)]
    for key, table in by_key.items():
        lookup = F.create_map(*[F.lit(item) for pair in table.items() for item in pair])
        found.append(F.coalesce(lookup[tag(df, key)], F.lit(default)))
    return F.least(*found)


def _at(rank: Column, results: list) -> Column:
    return F.element_at(F.array(*[F.lit(r) for r in results]), rank)


def poi_sector(df: DataFrame) -> Column:
    chain = F
    for sector, wanted in SECTORS.items():
        chain = chain.when(any_of(df, wanted), F.lit(sector))
    return chain.otherwise(F.lit("OTHER"))


def poi_class(df: DataFrame, sector: Column) -> Column:
    """Letter inside the sector; NULL outside the five sectors."""
    names = F.lower(F.concat_ws(" ", *[F.coalesce(tag(df, key), F.lit("")) for key in NAME_KEYS]))

    def letter_of(row: Column) -> Column:
        by_sector = F
        for name, (*tests, default) in CLASSES.items():
            letters = F
            for letter, level_pattern, wanted, name_pattern in tests:
                hit = any_of(df, wanted) | row["names"].rlike(name_pattern)
                if level_pattern:
                    hit = hit | F.coalesce(tag(df, "isced:level").rlike(level_pattern), F.lit(False))
                letters = letters.when(hit, F.lit(letter))
            by_sector = by_sector.when(row["sector"] == name, letters.otherwise(F.lit(default[0])))
        return by_sector

    # Binding the two long inputs keeps them single however often the rules look at them.
    bound = F.array(F.struct(sector.alias("sector"), names.alias("names")))
    return F.element_at(F.transform(bound, letter_of), 1)


def _first_match(df: DataFrame, rules, default) -> Column:
    rank = _rank(df, [(key, value, i) for i, (key, value, _) in enumerate(rules, 1)], default=len(rules) + 1)
    return _at(rank, [result for _, _, result in rules] + [default])


def poi_weight(df: DataFrame) -> Column:
    return _first_match(df, WEIGHTS, -1)


def poi_radius(weight: Column) -> Column:
    chain = F
    for value, radius in RADII:
        chain = chain.when(weight == value, F.lit(radius))
    return chain.otherwise(F.lit(0))


def poi_description(df: DataFrame) -> Column:
    return _first_match(df, DESCRIPTIONS, "Other")


def main_tag(df: DataFrame) -> Column:
    """The tag that says what the feature is, for comparing two features."""
    keys = ("shop", "amenity", "leisure", "tourism", "office", "healthcare")
    return F.coalesce(*[tag(df, key) for key in keys], F.lit("unknown"))
