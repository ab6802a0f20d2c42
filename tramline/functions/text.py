"""Name, route and text normalisers as column expressions. The rules differ on purpose; pick by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about a place, the exact aliases, suffixes and filler words of each rule.
ALIAS_WORDS = "bus stop|bus stand|bus terminus|terminus|bazar|more|mor|cross|crossing|gate|old|new|station|halt|stn"
ALIASES = {"arambagh": "arambag", "kgp": "kharagpur", "kharagpur": "kharagpur", "howrah stn": "howrah station", "sdl": "sealdah", "burdwan": "bardhaman", "midnapore": "medinipur", "chinsurah": "chuchura"}
SUFFIXES = "bus stop|bus stand|bus terminus|terminus|station|halt|mor|more|bazar|bazaar|market|chowk|crossing"
GOV_WORDS = "bus stand|bus terminus|bus terminal|stand|terminus|terminal"
TRANSFER_WORDS = "metro|station|bus|stand|platform"
TRANSFER_SAME = "kbs|kempegowda"
TRANSFER_AS = "majestic"


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[ \\t\\r\\n]+", " "))


def name_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def spaces(c: Column) -> Column:
    return collapse(F.lower(c))


def stop_strict(c: Column) -> Column:
    return collapse(F.regexp_replace(spaces(c), "[^a-z0-9 \\-./,()]", ""))


def alnum_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def alias(c: Column) -> Column:
    clean = F.regexp_replace(F.trim(F.lower(c)), f"\\b({ALIAS_WORDS})\\b", "")
    clean = collapse(F.regexp_replace(clean, "\\(.*?\\)", ""))
    known = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, clean), clean)


def suffix_strip(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), f"( +({SUFFIXES}))+ *$", ""))


def gov_stop(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(spaces(c), f"\\b({GOV_WORDS})\\b", ""), "[^a-z0-9]+", " "))


def transfer_key(c: Column) -> Column:
    words = F.regexp_replace(F.regexp_replace(alnum_space(c), f"\\b({TRANSFER_WORDS})\\b", ""), f"\\b({TRANSFER_SAME})\\b", TRANSFER_AS)
    return F.array_join(F.array_distinct(F.filter(F.split(words, " "), lambda w: w != "")), " ")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.replace(F.lower(F.trim(c)), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", "-"), "^-|-$", "")


def route_key(origin: Column, destination: Column) -> Column:
    return F.concat(spaces(origin), F.lit("->"), spaces(destination))


def external_id(prefix: str, origin: Column, destination: Column) -> Column:
    part = lambda c: F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9 ]", ""), " +", "_")
    return F.upper(F.concat(F.lit(f"{prefix}_ROUTE_"), part(origin), F.lit("->"), part(destination)))


def registration(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), " +", "")


def phone(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[^0-9]", ""), "^91([0-9]{10})$", "$1")


def split_via(c: Column) -> Column:
    parts = F.split(F.regexp_replace(collapse(c), "(?i)^via +", ""), " *[,;→>–—-] *")
    return F.filter(F.transform(parts, collapse), lambda p: p != "")


def route_ends(c: Column) -> tuple[Column, Column]:
    """Both ends of "A to B", null where the text isn't of that form."""
    end = lambda i: F.nullif(F.regexp_extract(collapse(c), "(?i)^(.+?) +to +(.+)$", i), F.lit(""))
    return end(1), end(2)


def stop_list(origin: Column, via: Column, destination: Column) -> Column:
    """Origin, via stops and destination without fillers and without a stop that repeats the one before."""
    stops = F.filter(F.transform(F.concat(F.array(origin), via, F.array(destination)), collapse), lambda s: (s != "") & ~F.lower(s).isin("via", "nil", "n/a", "na"))
    return F.filter(stops, lambda s, i: (i == 0) | (gov_stop(s) != gov_stop(F.try_element_at(stops, i.cast("int")))))


def recover_ends(c: Column) -> tuple[Column, Column, Column]:
    """Operator, origin and destination from a scraped block of lines "operator ... origin ( destination )", else the last line as origin."""
    pair = r"^\s*([^\n]+?)\s*\n[\s\S]*?([^\n(]+?)\s*\(\s*([^\n)]+?)\s*\n\s*[^)]*\)\s*$"
    single = r"^\s*([^\n]+?)\s*\n[\s\S]*?\n\s*([^\n:()]+?)\s*$"
    is_pair = c.rlike(pair)
    get = lambda p, i: F.nullif(F.trim(F.regexp_extract(c, p, i)), F.lit(""))
    return F.when(is_pair, get(pair, 1)).otherwise(get(single, 1)), F.when(is_pair, get(pair, 2)).otherwise(get(single, 2)), F.when(is_pair, get(pair, 3))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise((longest - F.levenshtein(a, b)) / longest)


def first_match(rules: list[tuple[Column, str]], default: str) -> Column:
    """The value of the first rule that holds."""
    return reduce(lambda rest, rule: F.when(rule[0], rule[1]).otherwise(rest), reversed(rules), F.lit(default))


def service_class(c: Column) -> Column:
    low = F.lower(c)
    return first_match([(low.rlike(r"\b(ac|a/c|volvo|premium)\b"), "PREMIUM"), (low.rlike(r"\bexpress\b"), "EXPRESS"), (low.rlike(r"\bnight\b"), "NIGHT")], "REGULAR")


# Labels of filters and menus that are no routes; kinds of scraped texts and the words that tell them, in
# the order in which they count.
UI_LABELS = ["filter", "search", "sort", "menu", "home", "next", "previous"]
UI_KIND, ROUTE_KIND, NO_KIND = "Filter/UI Element", "Route", "Unknown"
TEXT_KINDS = {"Authentication": ["login", "register", "password"], "Static Content": ["privacy", "terms", "about us", "contact us"], "District Page": ["district", "block", "panchayat"]}


def candidate_kind(c: Column) -> Column:
    """What a scraped text is: a label, a kind that its words tell, a route if it has two different ends, or unknown."""
    low = F.trim(F.lower(c))
    any_of = lambda conditions: reduce(Column.__or__, conditions)
    label = any_of([(low == w) | low.startswith(f"{w} ") | low.endswith(f" {w}") for w in UI_LABELS])
    told = [(any_of([F.contains(low, F.lit(w)) for w in words]), kind) for kind, words in TEXT_KINDS.items()]
    ends = F.filter(F.transform(F.split(low, r"\bto\b|-|→"), lambda p: F.trim(p)), lambda p: p != "")
    first, last = F.try_element_at(ends, F.lit(1)), F.try_element_at(ends, F.lit(-1))
    two = (F.length(c) > 5) & (F.size(ends) >= 2)
    real = (first != last) & (F.length(first) >= 3) & (F.length(last) >= 3)
    return first_match([(label, UI_KIND), *told, (two & ~real, UI_KIND), (two, ROUTE_KIND)], NO_KIND)


def page_kind(url: Column) -> Column:
    path = F.regexp_replace(url, "[?#].*$", "")
    return first_match([(path.rlike("^https?://[^/]+/?$"), "HOMEPAGE"), (path.contains("/routes"), "ROUTE_INDEX"), (path.contains("/district"), "DISTRICT_PAGE"), (path.contains("/bus/") | path.contains("/route/"), "ROUTE_DETAIL"), (path.contains("/search"), "SEARCH")], "OTHER")
