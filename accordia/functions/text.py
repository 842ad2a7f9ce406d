"""Text scalars as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from accordia.functions.vocabulary import ACT_ALIASES, FOREIGN_MARKERS, OPERATIVE_CUES, REPEAL_CUES


def normalize(text: Column) -> Column:
    """Plain quotes, dashes and spaces; no leading answer label or markup; single spaces; trimmed; lower case. Null is empty."""
    plain = F.translate(F.coalesce(text, F.lit("")), "‘’“”–— ", "''\"\"-- ")
    plain = F.regexp_replace(plain, r"(?U)^\s+|\s+$", "")
    plain = F.regexp_replace(plain, r"(?iU)^\s*(?:final\s+)?(?:answer|ans|response)\s*[:\-]\s*", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"[*_`>#]+", ""), r"(?U)\s+", " ")
    return F.lower(F.btrim(plain, F.lit(" .;:,-")))


def first_alias(text: Column, aliases: Iterable[tuple[str, str]] = ACT_ALIASES) -> Column:
    """The value of the first alias that the lower-cased text contains; null without one."""
    low, out = F.lower(text), None
    for alias, value in aliases:
        out = F.when(low.contains(alias), value) if out is None else out.when(low.contains(alias), value)
    return out


def contains_any(text: Column, cues: Iterable[str]) -> Column:
    """Whether the lower-cased text contains a cue; a null text does not."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*map(F.lit, cues)), lambda c: F.contains(low, c))


def is_superseded(sentence: Column) -> Column:
    return contains_any(sentence, REPEAL_CUES)


def is_operative(sentence: Column) -> Column:
    return contains_any(sentence, OPERATIVE_CUES)


def first_marker(text: Column, markers: Iterable[str] = FOREIGN_MARKERS) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.try_element_at(F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(low, m)), F.lit(1))


def plain_number(number: Column) -> Column:
    """Letters and digits only, lower case, without leading zeros."""
    return F.ltrim(F.lower(F.regexp_replace(F.coalesce(number, F.lit("")), "[^0-9A-Za-z]", "")), F.lit("0"))


def base_number(provision: Column) -> Column:
    return plain_number(F.substring_index(F.coalesce(provision, F.lit("")), "(", 1))


def subsection(provision: Column) -> Column:
    found = plain_number(F.regexp_extract(F.coalesce(provision, F.lit("")), r"\(([^)]*)\)", 1))
    return F.when(found != "", found)


def match_kind(number: Column, sub: Column, act: Column, provision: Column, wanted_act: Column) -> Column:
    """exact, base (the wanted subsection is left out) or null, for a mention against a provision."""
    want, wanted_sub, said_sub = first_alias(F.coalesce(wanted_act, F.lit(""))), subsection(provision), plain_number(sub)
    same = (plain_number(number) != "") & (plain_number(number) == base_number(provision))
    other_act = F.coalesce((want.isNotNull()) & (act != want), F.lit(False))
    other_sub = F.coalesce((said_sub != "") & (said_sub != wanted_sub), F.lit(False))
    return F.when(same & ~other_act & ~other_sub, F.when(wanted_sub.isNotNull() & (said_sub == ""), "base").otherwise("exact"))


def provision_key(act: Column, provision: Column, unknown: str = "UNKNOWN") -> Column:
    """NONE, FOREIGN:x, ACT (no section) or ACT n; a null act with a provision is the unknown act."""
    return (
        F.when(act.isNull() & provision.isNull(), "NONE")
        .when(act == "FOREIGN", F.concat(F.lit("FOREIGN:"), F.coalesce(provision, F.lit("None"))))
        .when(provision.isNull(), F.concat(act, F.lit(" (no section)")))
        .otherwise(F.concat_ws(" ", F.coalesce(act, F.lit(unknown)), provision))
    )


def normal_key(key: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(F.coalesce(key, F.lit("")), r"\s+", " ")))


def base_key(key: Column) -> Column:
    return F.trim(F.substring_index(normal_key(key), "(", 1))


def is_reference(key: Column) -> Column:
    """Whether a key can be looked up: no sentinel, no foreign law."""
    k = normal_key(key)
    return ~((k == "") | (k == "NONE") | k.startswith("FOREIGN") | k.startswith("UNKNOWN") | k.endswith("(NO SECTION)"))


def plain_text(text: Column) -> Column:
    """The text with single spaces; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def text_hash(text: Column) -> Column:
    """First 16 hex digits of the sha256 of the text with single spaces."""
    return F.substring(F.sha2(plain_text(text), 256), 1, 16)


def pair_id(a: Column, b: Column) -> Column:
    """The same for either order of two texts."""
    both = F.array_sort(F.array(text_hash(a), text_hash(b)))
    return F.concat(F.lit("pb1-"), F.substring(F.sha2(F.concat_ws("|", both), 256), 1, 16))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(normalize(text), F.lit("[a-z0-9]+"), F.lit(0)))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the larger set's; 0 if either is empty."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / most).otherwise(F.lit(0.0))


def clip01(x: Column) -> Column:
    """x held to [0, 1]; null stays null (greatest and least alone would drop it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def surface_form(index: Column, act: Column, number: Column) -> Column:
    """One of six wordings of a citation."""
    forms = ("Section %s of the %s", "Sec. %s, %s", "s. %s %s", "section %s under the %s", "%s of the %s")
    out = F.when(index == 5, F.concat_ws(" ", act, number))
    for i, form in enumerate(forms):
        out = out.when(index == i, F.format_string(form, number, act))
    return out


def redact(text: Column, secret: Column) -> Column:
    return F.when(F.coalesce(F.length(secret), F.lit(0)) > 0, F.replace(text, secret, F.lit("[redacted]"))).otherwise(text)


def serialized_pair(a: Column, b: Column, as_of: Column, jurisdiction: Column, link: Column) -> Column:
    """Two answers and their context as one text for a classifier."""
    words = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    context = F.concat(F.lit("as_of="), F.coalesce(as_of, F.lit("unknown")), F.lit("; jurisdiction="), F.coalesce(jurisdiction, F.lit("IN")), F.lit("; crosswalk="), F.coalesce(F.nullif(link, F.lit("")), F.lit("none")))
    return F.concat(F.lit("[A] "), words(a), F.lit(" [/A] [B] "), words(b), F.lit(" [/B] [CTX] "), context, F.lit(" [/CTX]"))
