"""Scalar column functions: cleaning, identifiers, numbers, names. Nulls give null unless said otherwise."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = ["", "NA"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean(c: Column) -> Column:
    """Text with white space collapsed and trimmed; null becomes empty (M1)."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "[\\s\\u00a0]+", " "))


def normalized_text(c: Column) -> Column:
    """Collapsed and lower-cased text (M2). Lower-casing differs from case folding on letters like sharp s."""
    return F.lower(clean(c))


def clean_id(c: Column) -> Column:
    """Trimmed upper-case identifier (M2)."""
    return F.upper(clean(c))


def alias_key(c: Column, ascii_only: bool = False) -> Column:
    """Key for alias comparison: dashes and punctuation to spaces, collapsed, lower-cased (M3)."""
    word = "[^a-z0-9_]+" if ascii_only else "(?U)[^\\w]+"
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), word, " "))


def mesh_id(c: Column) -> Column:
    """The first D plus six digits, with or without a prefix, upper-cased; empty when there is none (M4)."""
    return F.upper(F.regexp_extract(F.coalesce(c, F.lit("")), "(?i)(?<![a-z0-9])(d[0-9]{6})(?![0-9])", 1))


def strip_identifiers(c: Column) -> Column:
    """Text without vocabulary identifiers and the separators they leave (M5)."""
    bare = F.regexp_replace(c, "(?i)\\b(MESH|UMLS|ICD-11|DOID|SNOMED(?:CT)?)\\s*:\\s*[A-Za-z0-9.]+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "\\s*[,;|]\\s*(?=[,;|]|$)", ""), "^[\\s,;|]+", ""))


def to_nanomolar(value: Column, unit: Column) -> Column:
    """A value in nM from nM or uM (any micro sign); null for other units (M6)."""
    plain = F.lower(F.translate(F.trim(unit), "\u00b5\u03bc", "uu"))
    return F.when(plain == "nm", value).when(plain == "um", value * 1000)


def canonical_number(c: Column) -> Column:
    """Numeric text without trailing zeros or exponent; other text, and numbers beyond decimal(38,18), trimmed (M7)."""
    text = F.trim(c)
    number = F.expr("null") if c is None else text.try_cast("decimal(38,18)")
    plain = F.regexp_replace(F.regexp_replace(number.cast("string"), "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")
    tiny = (number == 0) & (text.try_cast("double") != 0)
    return F.when(number.isNull() | tiny, text).when(number == 0, "0").otherwise(plain)


def number_15g(c: Column) -> Column:
    """Whole numbers without a point, others with at most 15 significant digits, other text upper-cased (M8)."""
    x = F.trim(c).try_cast("double")
    digits = F.regexp_replace(F.regexp_replace(F.format_string("%.15g", x), "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")
    return F.when(x.isNull(), F.upper(F.trim(c))).when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("long").cast("string")).otherwise(digits)


def part_id(name: Column, code: Column) -> Column:
    """First two letters of genus and species and a part code, XX for a missing piece (M10). Different names may share it."""
    words = F.filter(F.split(clean(name), " "), lambda w: w.rlike("^[A-Za-z]{2}"))
    two = lambda i: F.coalesce(F.upper(F.substring(F.try_element_at(words, F.lit(i)), 1, 2)), F.lit("XX"))
    return F.concat_ws("-", two(1), two(2), F.coalesce(F.nullif(clean(code), F.lit("")), F.lit("XX")))


def species_name(c: Column) -> Column:
    """Genus, species and any infraspecific rank; hybrid signs kept, author words dropped."""
    t = F.regexp_replace(clean(c), "\\s*\u00d7\\s*", " \u00d7 ")
    binomial = F.regexp_extract(t, "^([A-Z][a-z-]+ (?:\u00d7 )?[a-z-]+)", 1)
    infra = F.regexp_extract(t, " ((?:subsp|var|f)\\. [a-z-]+)", 1)
    return F.trim(F.concat_ws(" ", F.when(binomial == "", t).otherwise(binomial), infra))


# First words of common names that have the shape of a genus.
COMMON_WORDS = ["african", "american", "asian", "basil", "banana", "babool", "babul", "bitter", "black", "chinese", "common", "curry", "drumstick", "ginger", "green", "holy", "indian", "japanese", "mango", "neem", "orange", "pepper", "plant", "red", "sweet", "tree", "turmeric", "water", "white", "wild"]


def looks_scientific(c: Column, common: list[str] | None = None) -> Column:
    """Whether text has the shape of a binomial and is no common phrase."""
    shape = clean(c).rlike("^[A-Z][a-z]{2,} (?:\u00d7 )?[a-z-]{3,}( (subsp|var|f)\\. [a-z-]+)?$")
    words = F.split(F.lower(clean(c)), " ")
    return shape & ~F.exists(words, lambda w: w.isin(common or COMMON_WORDS))


# Plant part names as they are found, and their codes.
PART_ALIASES = {
    "roots": "root", "rhizomes": "rhizome", "leaves": "leaf", "flowers": "flower", "fruits": "fruit", "seeds": "seed", "barks": "bark", "stems": "stem", "woods": "wood", "bulbs": "bulb", "tubers": "tuber",
    "stigmas": "stigma", "stamens": "stamen", "husks": "husk", "gums": "gum", "resins": "resin", "oils": "oil", "whole herb": "whole plant", "whole plant parts": "whole plant", "aerial part": "aerial parts", "plant exudates": "plant exudate",
}
PART_CODES = {
    "root": "RO", "root bark": "RB", "rhizome": "RH", "leaf": "LE", "flower": "FL", "fruit": "FR", "seed": "SE", "bark": "BA", "stem": "ST", "wood": "WO", "bulb": "BU", "tuber": "TU",
    "stigma": "SG", "stamen": "SM", "husk": "HU", "gum": "GU", "resin": "RE", "latex": "LX", "oil": "OI", "whole plant": "WH", "aerial parts": "AE", "plant exudate": "PL",
}


def _mapped(c: Column, table: dict[str, str]) -> Column:
    """The table's value of a text, null where it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def normalize_part(c: Column, unknown: str = "blank", aliases: dict[str, str] | None = None) -> Column:
    """The singular name of a part (M9); an unknown one is blank, or with ``unknown="keep"`` the text as it stands, cleaned and lower-cased."""
    low = F.lower(clean(c))
    table = PART_ALIASES if aliases is None else aliases
    known = {name: name for name in [*PART_CODES, *table.values()]} | table
    return F.coalesce(_mapped(low, known), low if unknown == "keep" else F.lit(""))


def part_code(c: Column) -> Column:
    """The code of a part after ``normalize_part``, null for an unknown one."""
    return _mapped(normalize_part(c), PART_CODES)


# Conservation status codes with their names, and further names.
STATUS = {
    "EX": "Extinct", "EW": "Extinct in the Wild", "RE": "Regionally Extinct", "CR": "Critically Endangered", "EN": "Endangered", "VU": "Vulnerable",
    "NT": "Near Threatened", "LC": "Least Concern", "DD": "Data Deficient", "NE": "Not Evaluated", "NA": "Not Applicable",
}
STATUS_NAMES = {"Not Assessed": "Not Evaluated"}


def status_label(c: Column) -> Column:
    """Full name of a status given by its code or name in any case, a code in parentheses first; unknown text collapsed, an unknown code upper-cased."""
    inside = F.nullif(F.upper(F.regexp_extract(c, "\\(([A-Za-z]{2})\\)", 1)), F.lit(""))
    given = F.when(c.isNotNull(), F.coalesce(inside, clean(c)))
    names = STATUS | {name: name for name in STATUS.values()} | STATUS_NAMES
    return F.coalesce(_mapped(F.lower(given), {k.lower(): v for k, v in names.items()}), given)


def tokens(c: Column) -> Column:
    """Distinct words with their singular forms: ies to y, ves to f, s dropped."""
    words = F.filter(F.split(alias_key(c), " "), lambda w: w != "")
    forms = lambda w: F.when(w.endswith("ies"), F.array(w, F.regexp_replace(w, "ies$", "y"))).when(w.endswith("ves"), F.array(w, F.regexp_replace(w, "ves$", "f"))).when(w.endswith("s") & ~w.endswith("ss"), F.array(w, F.regexp_replace(w, "s$", ""))).otherwise(F.array(w))
    return F.array_distinct(F.flatten(F.transform(words, forms)))


def sequence_ratio(a: Column, b: Column) -> Column:
    """2 M / T similarity of matching blocks, in the order (term, candidate)."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)


def common_letters(a: Column, b: Column) -> Column:
    """How many characters two texts have in common, each counted as often as both have it."""
    times = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    letters = F.array_distinct(F.filter(F.split(a, ""), lambda c: c != ""))
    return F.aggregate(letters, F.lit(0), lambda n, c: n + F.least(times(a, c), times(b, c)))


def split_list(c: Column, sep: str = ",") -> Column:
    """Distinct trimmed, lower-cased, non-empty items."""
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), sep), lambda x: F.trim(x)), lambda x: x != ""))


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in cols])


def labelled_fields(c: Column, labels: list[str], colon: bool = True) -> Column:
    """Array of (label, value) of each known label in a text, in order: a value runs up to the next known label.

    Labels are found as whole words in any case, their own spaces as any run of spaces and slashes; ``colon`` asks for one
    behind them. Values are cleaned. Labels come back as given. A null text has no fields.
    """
    start, end = "\u0001", "\u0002"  # control marks, taken out of the text first
    ordered = sorted(labels, key=len, reverse=True)
    shape = lambda label: "[\\s/]+".join(re.escape(w) for w in re.split("[ /]+", label))
    found = "(?i)(?<![\\p{L}\\p{N}])(" + "|".join(map(shape, ordered)) + ")(?![\\p{L}\\p{N}])\\s*" + (":" if colon else ":?")
    pieces = F.split(F.regexp_replace(F.translate(clean(c), start + end, ""), found, f"{start}$1{end}"), start)
    key = lambda x: F.regexp_replace(F.lower(x), "[\\s/]+", " ")
    given = {re.sub("[ /]+", " ", label).lower(): label for label in labels}
    parts = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: F.split(p, end))
    return F.transform(parts, lambda p: F.struct(_mapped(key(p[0]), given).alias("label"), F.trim(p[1]).alias("value")))


def field_value(fields: Column, label: str) -> Column:
    """The value of the first field of a label, null where there is none."""
    return F.try_element_at(F.filter(fields, lambda f: f["label"] == label), F.lit(1))["value"]


def labelled_value(c: Column, label: str, following: list[str]) -> Column:
    """The text between a label and the next of the labels or the end; empty where it is absent."""
    return F.coalesce(field_value(labelled_fields(c, [label, *following], colon=False), label), F.lit(""))


def shortest_path(paths: Column) -> Column:
    """The tree number with fewest segments, then the least."""
    return F.array_min(F.transform(paths, lambda p: F.struct(F.size(F.split(p, "\\.")).alias("n"), p.alias("p"))))["p"]


def distinct_ignoring_case(items: Column) -> Column:
    """List items with case-insensitive repeats dropped, the first kept."""
    low = F.transform(items, F.lower)
    return F.filter(items, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def safe_name(c: Column) -> Column:
    """File-safe name of at most 180 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.trim(c), "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""), 1, 180)


def signature(*parts: Column) -> Column:
    """Hash of the parts with their lengths, null when one is missing."""
    sized = [F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")) for p in parts]
    return F.sha2(F.concat(*sized), 256)


def accession(own: Column, synonyms: Column) -> Column:
    """The own accession, else the first synonym that looks like one."""
    return F.coalesce(F.nullif(F.trim(own), F.lit("")), F.try_element_at(F.filter(synonyms, lambda s: s.rlike("^[PQOA][0-9]")), F.lit(1)))


def page_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles and tags removed."""
    return clean(F.regexp_replace(F.regexp_replace(html, "(?is)<(script|style|noscript)[^>]*>.*?</\\1>", " "), "<[^>]+>", " "))


def filled_properties(props: Column) -> Column:
    """Map entries that are neither null nor blank."""
    return F.map_filter(props, lambda k, v: v.isNotNull() & (F.trim(v) != ""))


# Labels on pages. The levels of a classification and what stands behind it; the fields of a species page.
CLASS_LEVELS = ["Kingdom", "Superclass", "Class", "Subclass"]
CLASS_OTHERS = ["NP Classifier Biosynthetic pathway", "NP Classifier Superclass", "NP Classifier Class", "NP-Likeness score", "Chemical structure download", "External chemical identifiers", "Synonymous chemical names"]
SPECIES_LABELS = ["Citation", "Comments / notes", "Common name", "Conservation Status", "Habit", "Habitat", "Literature", "Permalink", "Read more", "Vernacular name"]


def classification(c: Column, scheme: str, levels: list[str] | None = None, ends: list[str] | None = None) -> Column:
    """Struct of a labelled classification's levels, without separators at their ends; empty where absent."""
    levels = levels or CLASS_LEVELS
    fields = labelled_fields(c, [*[f"{scheme} {x}" for x in levels], *(CLASS_OTHERS if ends is None else ends)], colon=False)
    return let(fields, lambda f: F.struct(*[F.coalesce(F.rtrim(field_value(f, f"{scheme} {x}"), F.lit(" ,;")), F.lit("")).alias(x.lower()) for x in levels]))


def page_record(html: Column, subject: Column) -> Column:
    """Struct of a species page's common name and conservation status; null where its text doesn't name the subject."""
    name = normalized_text(subject)
    status = lambda fields: status_label(F.nullif(field_value(fields, "Conservation Status"), F.lit("")))
    record = lambda fields: F.struct(F.coalesce(field_value(fields, "Common name"), F.lit("")).alias("common_names"), F.coalesce(status(fields), F.lit("Not Found")).alias("status"))
    # the text is made once, its fields only where it names the subject
    return let(page_text(html), lambda text: F.when((name != "") & F.contains(F.lower(text), name), let(labelled_fields(text, SPECIES_LABELS), record)))
