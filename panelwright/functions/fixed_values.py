"""Fixed values. They must equal the published study's values for right results."""

# Compliance codes that are kept, and those that count as compliant.
KEPT_CODES = ("A", "B", "E")
COMPLIANT_CODES = ("A", "E")

# Trading period label -> phase number.
PHASES = {
    "2005-2007": 1,
    "2008-2012": 2,
    "2013-2020": 3,
    "2021-2030": 4,
}

# Activity codes per sector; anything else is "Other".
SECTORS = {
    "Power": (1, 20),
    "Cement": (6, 29),
    "Steel/Metal": (5, 24, 25),
    "Refining": (2, 21),
    "Pulp/Paper": (9, 35, 36),
}

# Account types, the preferred one first.
ACCOUNT_TYPES = ("100-7", "120-0")

# Shareholder types that count as the state.
STATE_TYPES = ("Public authority, state, government", "Public")

# Country groups by climate policy.
GREEN_COUNTRIES = ("AT", "DE", "DK", "FI", "FR", "NL", "NO", "SE")
LAGGARD_COUNTRIES = ("BG", "CZ", "HU", "PL", "RO", "SK")

# Fuel patterns, first match wins.
FUEL_PATTERNS = (
    ("coal|lignite", "coal"),
    ("gas", "gas"),
    ("oil", "oil"),
    ("biomass", "biomass"),
    ("peat", "peat"),
    ("waste", "waste"),
)
COMBUSTION_PATTERN = "fossil|biomass|peat|waste"

# Two-letter to three-letter country codes (XI counts as GBR).
ISO2_TO_ISO3 = {
    "AT": "AUT", "BE": "BEL", "BG": "BGR", "CY": "CYP", "CZ": "CZE", "DE": "DEU",
    "DK": "DNK", "EE": "EST", "ES": "ESP", "FI": "FIN", "FR": "FRA", "GB": "GBR",
    "GR": "GRC", "HR": "HRV", "HU": "HUN", "IE": "IRL", "IS": "ISL", "IT": "ITA",
    "LI": "LIE", "LT": "LTU", "LU": "LUX", "LV": "LVA", "MT": "MLT", "NL": "NLD",
    "NO": "NOR", "PL": "POL", "PT": "PRT", "RO": "ROU", "SE": "SWE", "SI": "SVN",
    "SK": "SVK", "XI": "GBR",
}

# Country name to two-letter code.
COUNTRY_TO_ISO2 = {
    "Austria": "AT", "Belgium": "BE", "Bulgaria": "BG", "Croatia": "HR", "Cyprus": "CY",
    "Czech Republic": "CZ", "Denmark": "DK", "Estonia": "EE", "Finland": "FI",
    "France": "FR", "Germany": "DE", "Greece": "GR", "Hungary": "HU", "Iceland": "IS",
    "Ireland": "IE", "Italy": "IT", "Latvia": "LV", "Liechtenstein": "LI",
    "Lithuania": "LT", "Luxembourg": "LU", "Malta": "MT", "Netherlands": "NL",
    "Norway": "NO", "Poland": "PL", "Portugal": "PT", "Romania": "RO", "Slovakia": "SK",
    "Slovenia": "SI", "Spain": "ES", "Sweden": "SE", "United Kingdom": "GB",
}

# Carbon tax identifier to country (Tax_LT is the Latvian tax).
TAX_COUNTRY = {
    "Tax_DK": "DK", "Tax_EE": "EE", "Tax_ES": "ES", "Tax_FI": "FI", "Tax_FR": "FR",
    "Tax_IE": "IE", "Tax_IS": "IS", "Tax_LI": "LI", "Tax_LT": "LV", "Tax_LU": "LU",
    "Tax_NL": "NL", "Tax_NO": "NO", "Tax_PL": "PL", "Tax_PT": "PT", "Tax_SE": "SE",
    "Tax_SL": "SI", "Tax_UK": "GB",
}

# Texts that stand for a missing number.
MISSING_TEXTS = ("n.a.", "WO", "-", "")

# Ownership bands in display order.
OWNERSHIP_BANDS_3 = ("Private (0%)", "Majority state", "Fully state (100%)")
OWNERSHIP_BANDS_4 = (
    "Private (0%)",
    "Minority state (<50%)",
    "Majority state (50-99%)",
    "Fully state (100%)",
)

# Significance levels and their marks.
STAR_LEVELS = ((0.01, "***"), (0.05, "**"), (0.1, "*"))

# Earth radius in metres used for great-circle distances.
EARTH_RADIUS_M = 6378137.0
