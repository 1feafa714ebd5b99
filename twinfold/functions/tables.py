"""Fixed values that results depend on: word lists, unit spellings, patterns, the prime of the hash family."""

# Words that don't belong to a brand when they end it.
BRAND_ENDINGS = ("tv", "electronics", "inc", "inc.", "corp", "corporation", "company", "co")
# Spellings that become one unit, by unit.
UNITS = {
    "inch ": ("inches", "inch", '"', "”", "'", "-inch"),
    "hz ": ("hertz", "hz", "hz."),
    "lb ": ("pounds", "pound", "lbs.", "lbs", "lb.", "lb"),
    "kg ": ("kg.", "kg", "kgs", "kilograms", "kilogram", "kg)", "kg )", "Kg", "Kg.", "Kgs"),
    "w ": ("watts", "watt", "w.", "w"),
    "cd/m2 ": ("cd/mÂ²", "cd/m²", "cd/m2", "cd / m2", "cd / mÂ²", "cd / m²"),
    "deg ": ("°", "º", "&#176;", "degrees", "degree"),
}
# What titles lose besides.
TITLE_NOISE = ("and", "or", "-", ",", "/", "&", "refurbished", "diagonal", "diag.", "best buy", "thenerds.net", "newegg.com")
# Patterns, in the regex dialect of the JVM.
NUMBER = r"\d+(?:\.\d+)?"
TITLE_WORD = r"([a-zA-Z0-9]*((\d*\.)?\d+[^0-9, ]+)[a-zA-Z0-9]*)"
STRONG_WORD = r"(?i)^(?=.*[a-z])(?=.*\d)(?!.*(inch|hz|p)$)[a-z0-9-]{6,}$"
INCHES = r"(?i)(?<!\d)(\d{2,3}(?:\.\d+)?)\s*(?:inches|inch|in\b|[\"”])"
RESOLUTION = r"(?<!\S)\d{3,}\s*[x]\s*\d{3,}(?!\S)"
VALUE_WORD = r"^\d+\.\d+|\b\d+:\d+\b|(?<!\S)\d{3,}\s*[x]\s*\d{3,}(?!\S)"
SIZE_KEYS = ("size", "screen", "diagonal")
# Fixed value: the largest prime below 2 ** 32.
PRIME = 4294967291
