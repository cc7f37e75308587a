"""Fixed values of the record layout: codes, bounds and category groups."""

# Land use of a detached single-family house.
SINGLE_FAMILY = "RR101"
# Deed with concurrent mortgage, mortgage.
MORTGAGE_CLASSES = ["H", "M"]
# Deed, deed with concurrent mortgage.
SALE_CLASSES = ["D", "H"]
# Price codes of partial-interest or otherwise unusable sales.
BAD_PRICE_CODES = ["CU", "CM", "CN", "CP", "DL", "EP", "ST"]
# Child table codes behind each feature.
WATERFRONT = ["VWL", "VWO", "VWR", "WFB", "WFC", "WFS"]
GOLF = ["GLF"]
LIVING_AREAS = ["BAB", "BAE", "BAF", "BAG", "BAH", "BAJ", "BAL", "BAT", "BLF"]
CARPET = ["CP"]
WOOD_FLOOR = ["WD"]
DECK = ["DCK", "DKS", "WDD"]
FENCE_PREFIX = "FN"
POOL = ["POL", "SHP"]
TILE_ROOF = "TL"
WALL_GROUPS = {
    "block": ["BL", "CB", "CC"],
    "brick": ["BR", "BV", "MY", "RK"],
    "wood": ["WD", "WG", "WS"],
    "stucco": ["ST"],
    "siding": ["SD"],
}
DEED_GROUPS = {
    "warranty": ["WRDE", "SPWD", "CPDE"],
    "foreclosure": ["TRFC", "BSDE", "SHDE", "FCDE", "LDCR", "DELU", "COCA", "TXDE", "JGFC"],
}
OTHER_TOPOGRAPHY = ["MT", "SW", "BR", "MR", "RK"]
# Accepted sale price, lot and building sizes, first year built, caps.
PRICE_RANGE = (1_000, 5_000_000)
MAX_LOT_SQFT = 87_120
BUILDING_SQFT_RANGE = (1, 15_000)
FIRST_YEAR = 1960
ROOM_CAPS = {"totrms": 10, "bdrms": 6, "baths": 5}
# 100 metres in degrees, and the clustering radius and weights.
HUNDRED_METRES = 0.00089831
CLUSTER_RADIUS = 0.75 * HUNDRED_METRES
CLUSTER_MIN = 5
YEAR_WEIGHT = 0.5
