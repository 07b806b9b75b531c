"""Masks for links, addresses, ids, amounts, times and places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from riskloom.functions import fixed_values as fv

_BIG = r"(?:\s(?:hundred|thousand|million|billion|trillion)\w*)"
_MONTH = (
    r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?"
    r"|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
)
_DAY = (
    r"(?:Mo(?:n(?:day)?)?|Tu(?:e(?:sday)?)?|We(?:d(?:nesday)?)?|Th(?:u(?:rsday)?)?|Fr(?:i(?:day)?)?"
    r"|Sa(?:t(?:urday)?)?|Su(?:n(?:day)?)?)"
)
_ONES = r"(?:one|two|three|four|five|six|seven|eight|nine|ten|twenty|thirty|fifty|sixty|seventy|eighty|ninety)"
_CODE = "(?:" + "|".join(fv.STATE_CODES) + ")"
_STREETS = "(?:Avenue|Lane|Road|Boulevard|Drive|Street|Ave|Dr|Rd|Blvd|Ln|St)"
_STATE = "(?:" + "|".join((*fv.STATE_NAMES, *fv.STATE_CODES)) + ")"

# brackets that close again, at most two deep; unrolled, so that no text is scanned twice
_BRACKETS = r"\([^\s()<>]*(?:\([^\s()<>]+\)[^\s()<>]*)*\)"

# Entity name and pattern, in order of masking. Names and order are fixed values; the patterns are
# written for the formats they name: whole words only, alternatives of one kind in one pattern. Kinds of
# street, and state codes before a zip of an address, hold in any case; streets and towns have any number of words.
PATTERNS = (
    (
        "URL",
        rf"(?i)\b(?:https?://|www\d{{0,3}}[.]|[a-z0-9.\-]+[.][a-z]{{2,4}}/)(?:[^\s()<>]|{_BRACKETS})"
        rf"[^\s()<>]*(?:{_BRACKETS}[^\s()<>]*)*(?:{_BRACKETS}|[^\s`!()\[\]{{}};:'\".,<>?«»“”‘’])",
    ),
    ("EMAIL", r"[\w-]+@(?:[\w-]+\.)+[\w-]+"),
    ("ORDER_ID", r"\b[0-9]{3}-[0-9]{7}-[0-9]{7}\b"),
    (
        "TRACKING_ID",
        r"\b1Z ?[0-9A-Z]{3} ?[0-9A-Z]{3} ?[0-9A-Z]{2} ?[0-9A-Z]{4} ?[0-9A-Z]{3} ?[0-9A-Z]\b"
        r"|\b[kKJj][0-9]{10}\b|\b\d{30}\b|\b\d{20}\b|\bE[A-Z]\d{9}[A-Z]{2}\b|\b9\d{15,21}\b|\b91[0-9]+\b|\b[A-Za-z]{2}[0-9]+US\b"
        r"|\b(?:98\d{4}\d?\d{4}|98\d{2}) ?\d{4} ?\d{4}(?: ?\d{3})?\b"  # before the shorter forms it can begin with
        r"|\b\d{4}(?:\s?\d{4}){4}\s?\d{2}\b|\b\d{2}(?:\s?\d{3}){2}\s?\d{2}\b|\b[A-Za-z]{2}(?:\s?\d{3}){3}\s?[A-Za-z]{2}\b"
        r"|\b96\d{20}\b|\b\d{15}\b|\b\d{12}\b",
    ),
    ("PHONE", r"(?:\(\+?\d{1,2}\)\s*|\b\d{1,2}-)?(?:\b[2-9]\d{2}-|\([2-9]\d{2}\) )\d{3}-\d{4}\b"),
    ("ASIN", r"\b(?:[0-9]{9}[0-9X]|[A-Z][A-Z0-9]{9})\b"),
    (
        "DOLLAR_AMOUNT",
        rf"\$[\d,]+(?:\.\d{{2}})?{_BIG}?|\b\d+{_BIG}?\s(?:dollar|cent)\w*(?:\sand\s\d+\scent\w*)?|\b{_ONES}+{_BIG}*\sdollars",
    ),
    ("PERCENTAGE", r"\b[0-9]+(?:\.[0-9]+)?%"),
    ("DATE", rf"\b[0-3]?[0-9]/[0-3]?[0-9]/(?:[0-9]{{2}})?[0-9]{{2}}\b|\b{_DAY},\s+{_MONTH}\s+\d{{1,2}},\s+\d{{4}}\b"),
    ("MON_DAY", rf"\b{_MONTH}\s+\d{{1,2}}(?:st|nd|rd|th)?\b"),
    ("WEEKDAY", rf"\b{_DAY}\b"),
    ("TIME", r"\b(?:[01]?[0-9]|2[0-3])[:.][0-5][0-9](?:[:.][0-5][0-9])?(?: ?[AaPp][Mm])?\b"),
    ("ADDRESS", rf"\b(?:[A-Z][a-z.\-]+ ?)+, (?:{_STATE}|(?i:{_CODE})) \d{{5}}(?:-\d{{4}})?\b"),
    ("STATE_ZIP", rf"\b{_STATE} \d{{5}}(?:-\d{{4}})?\b"),
    ("ZIP", r"\b\d{5}(?:-\d{4})?\b"),
    ("STATE", rf"\b{_STATE}\b"),
    ("STREET", rf"\b\d+ (?:[A-Za-z0-9.\-]+ )+(?i:{_STREETS})\b\.?"),
    ("DECIMAL", r"\b\d*\.?\d+(?: bps)?\b"),
)


# how an entity can begin; only saves time
_FIRST = {
    "ORDER_ID": r"\d{3}-",
    "TRACKING_ID": r"\d|[kKJj]\d|[A-Za-z]{2}\s?\d",
    "PHONE": r"[(\d]",
    "ASIN": r"[0-9A-Z]{10}",
    "DOLLAR_AMOUNT": r"[$\dofstne]",
    "PERCENTAGE": r"\d",
    "DATE": r"\d|[MTWFS][a-z]",
    "MON_DAY": r"[JFMASOND][a-z]{2}",
    "WEEKDAY": r"[MTWFS][a-z]",
    "TIME": r"\d",
    "ADDRESS": r"[A-Z]",
    "STATE_ZIP": r"[A-Z]",
    "ZIP": r"\d{5}",
    "STATE": r"[A-Z]",
    "STREET": r"\d",
    "DECIMAL": r"[\d.]",
}
# texts of which every occurrence contains one: looked for before any pattern is tried
_NEEDS = {"EMAIL": ("@",), "DOLLAR_AMOUNT": ("$", "dollar", "cent"), "PERCENTAGE": ("%",), "DATE": ("/", ",")}
# kinds that can occur in a text without any digit
_WORDS = ("URL", "EMAIL", "ASIN", "DOLLAR_AMOUNT", "WEEKDAY", "STATE")
_NEVER = r"\A(?!)"  # fails at the first character


def _has_digit(text: Column) -> Column:
    return F.regexp_like(text, F.lit("[0-9]"))


def _needs(name: str, text: Column) -> Column | None:
    """Whether the text holds what the kind cannot do without; None: nothing quickly found."""
    if name == "URL":  # a slash after a scheme or an ending, or a host that begins with www
        return F.contains(text, F.lit("/")) | F.regexp_like(text, F.lit(r"[wW]{3}\d{0,3}[.]"))
    if name == "STREET":  # a run of words is looked through only where a kind of street follows somewhere
        return F.regexp_like(text, F.lit(rf" (?=[ALRBDSalrbds])(?i:{_STREETS})(?U:\b)"))
    if name in _NEEDS:
        return reduce(Column.__or__, [F.contains(text, F.lit(part)) for part in _NEEDS[name]])
    return None


def _pattern(name: str) -> str:
    pattern = dict(PATTERNS)[name]
    if name == "EMAIL":
        # a run of word characters is tried once, not from each of its letters
        pattern = r"(?<![\w-])[\w-]++@(?:[\w-]+\.)+[\w-]+"
    # letters of every script count as letters at a word boundary
    pattern = pattern.replace(r"\b", r"(?U:\b)")
    if name in _FIRST:
        pattern = f"(?={_FIRST[name]})(?:{pattern})"
    return pattern


def entity_mask(c: Column, names: tuple[str, ...] | None = None) -> Column:
    """Replace each entity by its upper-case name, in the fixed order."""

    def masked(kinds: list[str]) -> Column:
        out = c
        for name in kinds:
            found = _needs(name, c)  # masks hold none of the texts that are needed
            pattern = F.lit(_pattern(name))
            if found is not None:
                pattern = F.when(found, pattern).otherwise(_NEVER)
            out = F.regexp_replace(out, pattern, F.lit(name))
        return out

    wanted = [name for name, _ in PATTERNS if names is None or name in names]
    return F.when(_has_digit(c), masked(wanted)).otherwise(masked([name for name in wanted if name in _WORDS]))


def entity_count(c: Column, name: str) -> Column:
    found = _needs(name, c)
    if name not in _WORDS:
        found = _has_digit(c) if found is None else _has_digit(c) & found
    count = F.regexp_count(c, F.lit(_pattern(name)))
    return count if found is None else F.when(found, count).when(c.isNotNull(), 0)
