"""String functions: plates, identifiers, masks, class names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that plate readers confuse, plate formats, and names of object classes.
CONFUSABLE = [("3", "E"), ("5", "S"), ("0", "O"), ("1", "I")]
PLATE_FORMATS = [r"^[A-Z]{2}[0-9]{1,2}[A-Z]{1,3}[0-9]{4}$", r"^[0-9]{2}[A-Z][0-9]{5,6}[A-Z]?$", r"^[A-Z]{2}\s?\d{1,2}\s?[A-Z]{1,3}\s?\d{1,4}$"]
CLASS_NAMES = {"person": ["person", "people", "man", "woman", "pedestrian"], "car": ["car", "cars", "sedan"], "truck": ["truck", "trucks", "lorry"], "motorcycle": ["motorcycle", "motorbike", "bike"], "bus": ["bus", "buses"]}
VEHICLES = ["car", "truck", "motorcycle", "bus", "bicycle"]


def plate(text: Column) -> Column:
    """A plate in capitals without white space."""
    return F.regexp_replace(F.upper(F.trim(text)), r"\s", "")


def letters_and_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9]", "")


def is_plate(text: Column) -> Column:
    return reduce(lambda a, b: a | b, (text.rlike(p) for p in PLATE_FORMATS))


def chars(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substr(text, i, F.lit(1)))


def confusable(a: Column, b: Column, most: int = 2) -> Column:
    """Whether two plates of equal length differ in at most ``most`` characters, all of them confusable."""
    swap = lambda p, q: reduce(lambda x, y: x | y, (((p == l) & (q == r)) | ((p == r) & (q == l)) for l, r in CONFUSABLE))  # noqa: E731, E741
    costs = F.zip_with(chars(a), chars(b), lambda p, q: F.when(p == q, 0).when(swap(p, q), 1).otherwise(99))
    return (F.length(a) == F.length(b)) & (F.aggregate(costs, F.lit(0), lambda s, c: s + c) <= most)


def masked_credentials(url: Column) -> Column:
    """A URL whose user and password are stars."""
    return F.regexp_replace(url, r"://[^/@\s]+@", "://***:***@")


def entity_id(text: Column) -> Column:
    """PERSON-n and VEHICLE-n as global ids, the number filled up to three digits; null if it is neither."""
    kind = F.regexp_extract(F.upper(text), r"(?:GLOBAL-)?(PERSON|VEHICLE)-(\d+)", 1)
    number = F.regexp_extract(F.upper(text), r"(?:GLOBAL-)?(PERSON|VEHICLE)-(\d+)", 2)
    return F.when(kind != "", F.concat(F.lit("GLOBAL-"), kind, F.lit("-"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)))


def class_named(text: Column) -> Column:
    """The first known class that a text names as a whole word; null if none."""
    return F.coalesce(*(F.when(F.lower(text).rlike(r"\b(" + "|".join(names) + r")\b"), F.lit(name)) for name, names in CLASS_NAMES.items()))


def iso_time(ts: Column) -> Column:
    """ISO 8601 without microseconds where they are zero."""
    return F.when(F.date_format(ts, "SSSSSS") == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


#: Words that name no track or camera.
STOP_WORDS = ["this", "the", "that", "all", "each", "a", "an", "is", "was", "any", "id"]
#: Units of a look-back in seconds.
LOOK_BACK_UNITS = {"hour": 3600, "min": 60, "sec": 1}


def _first(text: Column, pattern: str) -> Column:
    """The first group of the first match, null if there is none."""
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found)


def _no_stop_word(name: Column) -> Column:
    return F.when(~F.lower(name).isin(STOP_WORDS), name)


def track_named(text: Column) -> Column:
    """The track that a question names after the word track; a stop word is none."""
    return _no_stop_word(_first(text, r"(?i)\btrack\s*(?:id)?\s*#?\s*([0-9]+|[a-zA-Z0-9_\-]+)\b"))


def camera_named(text: Column) -> Column:
    """The camera that a question names by its id, or after the word camera, then with cam_ before it."""
    direct = _first(text, r"(?i)\b(cam(?:era)?[_\-][a-zA-Z0-9_\-]+|cctv[_\-][a-zA-Z0-9_\-]+)\b")
    named = _no_stop_word(_first(text, r"(?i)\b(?:camera|cam)\s+(?:id\s+)?#?\s*([0-9]+|[a-zA-Z0-9_\-]+)\b"))
    return F.coalesce(direct, F.when(named.startswith("cam") | named.startswith("cctv"), named).otherwise(F.concat(F.lit("cam_"), named)))


def zone_named(text: Column) -> Column:
    """The zone that a question names after zone, sector or area."""
    return _first(text, r"(?i)\b(?:zone|sector|area)\s*#?([a-zA-Z0-9_\-]+)")


def look_back(text: Column) -> Column:
    """Seconds of "last n minutes" (hours, seconds), null if a question has none."""
    number, unit = _first(text, r"(?i)last\s+(\d+)\s+(?:minute|min|hour|second|sec)"), F.lower(F.regexp_extract(text, r"(?i)last\s+\d+\s+(minute|min|hour|second|sec)", 1))
    seconds = reduce(lambda c, u: c.when(unit.contains(u[0]), u[1]), LOOK_BACK_UNITS.items(), F.when(F.lit(False), 0))
    return number.cast("long") * seconds
