"""Fixed values of text normalisation: word lists, patterns and script tables."""

from __future__ import annotations

# Brahmic blocks U+0900..U+0D7F share one layout of 0x80 code points; sounds by offset.
INDEPENDENT_VOWELS = {
    0x05: "a", 0x06: "a", 0x07: "i", 0x08: "i", 0x09: "u", 0x0A: "u", 0x0B: "ri", 0x0C: "li",
    0x0D: "e", 0x0E: "e", 0x0F: "e", 0x10: "ai", 0x11: "o", 0x12: "o", 0x13: "o", 0x14: "au",
}
CONSONANTS = {
    0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "n", 0x1A: "ch", 0x1B: "chh", 0x1C: "j", 0x1D: "jh", 0x1E: "n",
    0x1F: "t", 0x20: "th", 0x21: "d", 0x22: "dh", 0x23: "n", 0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n",
    0x29: "n", 0x2A: "p", 0x2B: "f", 0x2C: "b", 0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x31: "r", 0x32: "l",
    0x33: "l", 0x34: "l", 0x35: "v", 0x36: "sh", 0x37: "sh", 0x38: "s", 0x39: "h",
    0x58: "q", 0x59: "kh", 0x5A: "g", 0x5B: "z", 0x5C: "d", 0x5D: "rh", 0x5E: "f", 0x5F: "y",
}
VOWEL_SIGNS = {
    0x3E: "a", 0x3F: "i", 0x40: "i", 0x41: "u", 0x42: "u", 0x43: "ri", 0x44: "ri", 0x45: "e", 0x46: "e", 0x47: "e",
    0x48: "ai", 0x49: "o", 0x4A: "o", 0x4B: "o", 0x4C: "au", 0x62: "li", 0x63: "li",
}
OTHER_SIGNS = {
    0x01: "n", 0x02: "n", 0x03: "h", 0x4E: "r", 0x7A: "n", 0x7B: "n", 0x7C: "r", 0x7D: "l", 0x7E: "l", 0x7F: "k",
}
VIRAMA, NUKTA = 0x4D, 0x3C
SILENT_MARKS = (0x55, 0x56, 0x57, 0x70, 0x71)
FIRST_DIGIT = 0x66
TRANSLITERATED_WORDS = {
    "praivet": "private", "praivat": "private", "piraivet": "private", "prayvet": "private", "praivetu": "private",
    "limitet": "limited", "limitedu": "limited", "limitad": "limited", "limittad": "limited", "limittadu": "limited",
    "elelpi": "llp", "elelsi": "llc",
}
PRIVATE_LIMITED_SHORT = r"\bpra\.?\s*li\b\.?"
MAP_TOKEN = r"[^\s,.\-()\[\]/&+]+"

# Cleaning patterns.
WEBSITE = r"https?://|\bwww\.|\.(?:co\.in|com|net|org|in|fr|biz|info|io|us)\b"
NAME_JUNK = r"\bid\s*[:#]?\s*\d+|\b\d{6,}\b|\bd\s*/\s*b\s*/\s*a\b|\bdba\b"
DIGITS, AS_LETTERS = "0134568", "oleasgb"
ORDINAL = r"^\d+(?:st|nd|rd|th)$"
LANDMARK = r"(?i)\b(near|opp|opposite|behind|beside|adjacent to|adj|next to|in front of)\s+([^,]+)"
NUMBER = r"(\d+[a-z]?(?:\s*[/-]\s*\d+[a-z]?)*)"
HOUSE_EXPLICIT = r"(?i)\b(?:plot|door|house|flat|shop|h|d|kh|khasra|survey|sy|s)\s*(?:no|n|number|#)?[\s\.:#-]*" + NUMBER
HOUSE_NO = r"(?i)(?:\bno|#|\bn[o°º])[\s\.:#-]*" + NUMBER
HOUSE_COMPONENT = r"(?i)^\s*([a-z]{0,2}[-/]?\d+[a-z]?(?:\s*[/-]\s*\d+[a-z]?)*)(?:\s+\d+/\d+)?(?:\s+(?:bis|ter))?(?:\s+[a-z]|\s*$)"
MISSING_ADDRESSES = ("nan", "null", "none")

# Whole-word rules for names.
NAME_WORDS = {
    "pvt": "private", "praivet": "private", "ltd": "limited", "corp": "corporation", "inc": "incorporated",
    "eleipi": "llp", "elepi": "llp", "eleli": "llc", "intl": "international", "mfg": "manufacturing",
    "tech": "technologies", "saint": "st", "sainte": "ste",
}
LEGAL_FORMS = (
    "private limited", "limited", "corporation", "incorporated", "llc", "llp", "plc", "gmbh", "co", "company", "sarl", "sas",
    "sasu", "sa", "eurl", "sci", "snc", "selarl", "societe anonyme", "societe par actions simplifiee",
    "entreprise individuelle", "ei",
)

# Whole-word rules for addresses.
ADDRESS_WORDS = {
    "rd": "road", "street": "st", "saint": "st", "st": "st", "ave": "avenue", "av": "avenue", "blvd": "boulevard",
    "bd": "boulevard", "ln": "lane", "dr": "drive", "ct": "court", "pkwy": "parkway", "pky": "parkway", "hwy": "highway",
    "suite": "ste", "sainte": "ste", "ste": "ste", "flr": "floor", "indl": "industrial", "ph": "phase", "pl": "place",
    "r": "rue", "opp": "opposite", "nr": "near", "adj": "adjacent", "trl": "trail", "cir": "circle", "ter": "terrace",
    "terr": "terrace", "sq": "square", "hts": "heights", "cres": "crescent", "xing": "crossing", "expy": "expressway",
    "fwy": "freeway", "apt": "apartment", "bldg": "building", "che": "chemin", "chem": "chemin", "ch": "chemin",
    "imp": "impasse", "rte": "route", "fg": "faubourg", "all": "allee", "crs": "cours",
}
