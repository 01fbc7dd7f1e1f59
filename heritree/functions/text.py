"""Scalar functions as Column -> Column; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript has it; Java's \s has less.
SPACE = r"[\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def parse_year(c: Column) -> Column:
    """The first run of four digits anywhere, as int; else null."""
    return F.regexp_extract(c, r"([0-9]{4})", 1).try_cast("int")


def year_start(c: Column) -> Column:
    return blank_to_null(F.regexp_extract(c, r"^([0-9]{4})", 1))


def location_key(c: Column) -> Column:
    """Lower-cased, white space collapsed, commas as ", ", no closing .,; and null if nothing is left. Not trimmed again at the end."""
    k = F.regexp_replace(F.lower(c), f"^{SPACE}+|{SPACE}+$", "")
    k = F.regexp_replace(k, f"{SPACE}+", " ")
    k = F.regexp_replace(k, f"{SPACE}*,{SPACE}*", ", ")
    k = F.regexp_replace(k, f"^{SPACE}+|{SPACE}+$", "")
    return blank_to_null(F.regexp_replace(k, r"[.,;]+$", ""))


def first_filled(*cs: Column) -> Column:
    """The first that is neither null nor ""."""
    return F.coalesce(*map(blank_to_null, cs))


def full_name(first: Column, middle: Column, birth_last: Column, current_last: Column, suffix: Column, name: Column) -> Column:
    joined = F.concat_ws(" ", blank_to_null(first), blank_to_null(middle), first_filled(birth_last, current_last), blank_to_null(suffix))
    return F.coalesce(blank_to_null(joined), blank_to_null(name), F.lit("Unknown"))


def profile_date(c: Column) -> Column:
    """Null for null, "" and unknown years ("0000..."), else unchanged."""
    return F.when(~c.startswith("0000") & (c != ""), c)


def display_name(name: Column, first: Column, middle: Column, last: Column, wiki_id: Column) -> Column:
    joined = F.concat_ws(" ", *map(blank_to_null, (first, middle, last)))
    return F.coalesce(blank_to_null(name), blank_to_null(joined), wiki_id)


def map_name(name: Column, first: Column, last: Column) -> Column:
    return first_filled(name, F.trim(F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit("")))))


def gender_code(c: Column) -> Column:
    return F.when(c == "Male", "M").when(c == "Female", "F").otherwise("U")


def lifespan(birth: Column, death: Column) -> Column:
    return F.concat_ws(" - ", blank_to_null(birth), blank_to_null(death))


def truncate_text(c: Column, max_width: float, font: float) -> Column:
    n = int(max_width // (font * 0.55))
    cut = F.substring(c, 1, n) if n <= 3 else F.concat(F.substring(c, 1, n - 3), F.lit("..."))
    return F.when(F.char_length(c) <= n, c).otherwise(cut)


def detail_level(zoom: Column) -> Column:
    return F.when(zoom > 0.6, "full").when(zoom > 0.25, "medium").otherwise("minimal")


def node_colour(selected: Column, gender: Column) -> Column:
    return F.when(selected, "selected").when(gender == "M", "male").when(gender == "F", "female").otherwise("unknown")


def marker_radius(n: Column) -> Column:
    return F.greatest(F.lit(4.0), F.least(F.lit(20.0), F.sqrt(n) * 3))


def marker_colour(year: Column, first_year: Column) -> Column:
    """By how long before `year` the cluster's first birth was; no `year`: blue; unknown first year: gray."""
    ago = year - first_year
    return F.when(first_year.isNull(), "gray").when(year.isNull(), "blue").when(ago < 0, "gray").when(ago < 20, "green").when(ago < 50, "blue").otherwise("purple")


def marker_label(n: Column, radius: Column) -> Column:
    """Font size of the count shown on the marker, or null where none is shown."""
    return F.when(n > 3, F.greatest(F.lit(8.0), radius * 0.8))


def tooltip(label: Column, n: Column, first_year: Column, last_year: Column, persons: Column) -> Column:
    """Lines: place, number of persons, years of birth unless unknown (9999), and up to five persons (name, birth_year) each."""
    people = F.concat(n.cast("string"), F.when(n == 1, " person").otherwise(" people"))
    years = F.when(first_year == last_year, F.concat(F.lit("Born "), first_year)).otherwise(F.concat(F.lit("Born "), first_year, F.lit(" - "), last_year))
    line = lambda p: F.concat(first_filled(p["name"], F.lit("Unknown")), F.when(F.coalesce(p["birth_year"], F.lit(0)) != 0, F.concat(F.lit(" ("), p["birth_year"], F.lit(")"))).otherwise(""))
    return F.concat_ws("\n", label, people, F.when(first_year != 9999, years), F.when(F.size(persons) <= 5, blank_to_null(F.array_join(F.transform(persons, line), "\n"))))


def cluster_label(normalized: Column, city: Column, state: Column) -> Column:
    return F.coalesce(first_filled(normalized, city, state), F.lit("Unknown"))


def number_text(c: Column) -> Column:
    """A number's shortest text without a closing .0, as scripts on the web print it."""
    return F.when(c == 0, "0").otherwise(F.regexp_replace(c.cast("string"), r"\.0$", ""))


def cluster_id(lat: Column, lon: Column) -> Column:
    return F.concat_ws(",", number_text(lat), number_text(lon))


def valid_id(c: Column) -> Column:
    return c.isNotNull() & ~c.cast("string").isin("", "0")


def start_id_format(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z]+-\d+$")


def pair_key(a: Column, b: Column) -> Column:
    return F.concat(F.least(a, b), F.lit("<=>"), F.greatest(a, b))


def edge_key(parent: Column, child: Column) -> Column:
    return F.concat(parent, F.lit("->"), child)


def contains_pattern(term: str) -> str:
    """The user's text is not escaped: % and _ in it are wildcards."""
    return f"%{term}%"


def backup_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH-mm-ss")


def parse_backup_stamp(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "T", " "), "-", ":")


def megabytes(c: Column) -> Column:
    return F.round(c / 1024 / 1024, 2)


def person_link(base: str, wiki_id: Column) -> Column:
    return F.concat(F.lit(base + "/wiki/"), wiki_id)


def half_up(c: Column) -> Column:
    """Math.round: halves go up."""
    return F.floor(c + 0.5)
