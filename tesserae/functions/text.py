"""Column functions on text: stripping, labels, numbers, entities, identifiers, shapes. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip removes among ASCII and the usual Unicode spaces.
WHITE = r"[\s\u001c-\u001f\u0085   -     　]"
SPACES = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Patterns of the record formats, and identifiers that need no reference.
IDENTIFIER = r"\b[a-z0-9][a-z0-9.]*\.[a-z]{2,}/[A-Za-z0-9][A-Za-z0-9._-]*\b"
KNOWN_IDENTIFIERS = ("apps/v1", "v1", "batch/v1")
SNAKE_WORD = r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b"
K8S_NAME = r"^[a-z0-9]([-a-z0-9.]{0,251}[a-z0-9])?$"


def py_strip(c: Column) -> Column:
    """White space off both ends, as Python does it (Spark's trim takes blanks only)."""
    return F.btrim(c, F.lit(SPACES))


def segments(c: Column, sep: str = "[|]") -> Column:
    return F.transform(F.split(c, sep), py_strip)


def primary_label(c: Column, mode: str, taxonomy: list[str] | None = None) -> Column:
    """The label of an output like `a|b` by one of four rules.

    first: the first segment, or the whole if there is no bar. report: the second non-blank segment if there are two,
    else the first, else the whole. taxonomy: the first non-blank segment in the taxonomy, else null. cli: what stands
    before the first bar unless that is the first character.
    """
    whole, parts = py_strip(c), segments(c)
    full = F.filter(parts, lambda x: F.length(x) > 0)
    if mode == "first":
        return F.when(F.contains(c, F.lit("|")), F.get(parts, F.lit(0))).otherwise(whole)
    if mode == "report":
        return F.coalesce(F.get(full, F.lit(1)), F.get(full, F.lit(0)), whole)
    if mode == "taxonomy":
        kept = full if taxonomy is None else F.filter(full, lambda x: x.isin(taxonomy))
        return F.get(kept, F.lit(0))
    if mode == "cli":
        at = F.instr(c, "|")
        return py_strip(F.when(at > 1, F.substring_index(c, "|", 1)).otherwise(c))
    raise ValueError(mode)


def py_float(c: Column) -> Column:
    """The number that Python's float() reads from a text (underscores between digits, nan and inf too), else null."""
    t = py_strip(c)
    digits = r"\d+(_\d+)*"
    number = t.rlike(rf"^[+-]?({digits}\.?({digits})?|\.{digits})([eE][+-]?{digits})?$")
    value = F.when(number, F.replace(t, F.lit("_"), F.lit("")).try_cast("double"))
    infinite = F.when(t.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(t.rlike("(?i)^[+-]?nan$"), F.lit(float("nan"))).when(t.rlike("(?i)^[+-]?inf(inity)?$"), infinite).otherwise(value)


def parsed_score(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """A score as `%.4f` text, or null where it is not a number in [lo, hi]; percents above hi are divided by 100."""
    bare = py_strip(F.regexp_replace(py_strip(F.regexp_replace(c, "%", "")), '^"+|"+$', ""))
    token = F.split(bare, r"\s+")[0]
    value = py_float(token)
    value = F.when((value > hi) & F.contains(c, F.lit("%")), value / 100).otherwise(value)
    sign = F.when((value == 0) & token.startswith("-"), "-").otherwise("")  # a negative zero keeps its sign
    return F.when(value.between(lo, hi), F.concat(sign, F.format_string("%.4f", F.abs(F.bround(value, 4)))))


def entities(c: Column) -> Column:
    """`TYPE :: surface || TYPE :: surface` as an array of (type, text); incomplete parts go."""
    def one(x):
        return F.struct(py_strip(F.substring_index(x, "::", 1)).alias("type"), py_strip(F.substring(x, F.instr(x, "::") + 2, F.length(x))).alias("text"))

    parts = F.filter(F.split(c, r"\|\|"), lambda x: F.contains(x, F.lit("::")))
    return F.filter(F.transform(parts, one), lambda e: (F.length(e["type"]) > 0) & (F.length(e["text"]) > 0))


def encode_entities(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda e: F.concat(e["type"], F.lit(" :: "), e["text"])), " || ")


def identifiers(c: Column) -> Column:
    """Distinct dotted-host/name identifiers."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(IDENTIFIER), 0))


def reference_text(c: Column, opened: str, closed: str) -> Column:
    """What stands between the first of two markers; the whole text where one is missing or they are in the wrong order."""
    a, b = F.instr(c, opened), F.instr(c, closed)
    start = a + len(opened)
    return F.when((a > 0) & (b > a), F.substring(c, start, F.greatest(b - start, F.lit(0)))).otherwise(c)


def band(c: Column, high: float = 0.8, medium: float = 0.5) -> Column:
    return F.when(c >= high, "high").when(c >= medium, "medium").otherwise("low")


def snake_words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(SNAKE_WORD), 0))


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def strip_think(c: Column) -> Column:
    """The answer after the last closing think tag, without opening ones."""
    return py_strip(F.replace(F.substring_index(c, "</think>", -1), F.lit("<think>"), F.lit("")))


def slug(c: Column) -> Column:
    return F.substring_index(F.regexp_replace(c, "/+$", ""), "/", -1)


def shape(c: Column) -> Column:
    """Word shape: upper X, lower x, digit d, other characters as they are, 8 at most."""
    c = F.regexp_replace(c, r"\p{Ll}", "x")
    c = F.regexp_replace(c, r"\p{Lu}", "X")
    return F.substring(F.regexp_replace(c, r"\p{Nd}", "d"), 1, 8)


def quantity(c: Column) -> Column:
    """A quantity with an SI or binary suffix as a double; null where it is none."""
    #: The suffixes, by powers of 1000 and of 1024; k and K are alike.
    decimal = {"n": -3, "u": -2, "m": -1, "": 0, "k": 1, "K": 1, "M": 2, "G": 3, "T": 4, "P": 5, "E": 6}
    binary = {"Ki": 1, "Mi": 2, "Gi": 3, "Ti": 4, "Pi": 5, "Ei": 6}
    factors = {k: float(f"1e{3 * v}") for k, v in decimal.items()} | {k: 1024.0**v for k, v in binary.items()}
    table = F.create_map(*(F.lit(x) for kv in factors.items() for x in kv))
    number, suffix = (F.regexp_extract(py_strip(c), r"^([+-]?[0-9]*\.?[0-9]+)([A-Za-z]*)$", k) for k in (1, 2))
    return number.try_cast("double") * F.try_element_at(table, suffix)


def truncated(c: Column, n: int) -> Column:
    """One line of at most n characters, with dots where it was cut."""
    line = F.replace(c, F.lit("\n"), F.lit(" "))
    return F.when(F.length(line) > n, F.concat(F.substring(line, 1, n), F.lit("..."))).otherwise(line)


#: Hints of a model's name in the order in which they are tried, with billions of parameters.
SIZE_HINTS = (("70b", 70), ("14b", 14), ("13b", 13), ("8b", 8), ("7b", 7), ("4b", 4), ("3b", 3), ("2b", 2), ("1.7b", 2), ("1.5b", 2), ("1b", 1), ("0.6b", 1), ("0.5b", 1))
DEFAULT_SIZE = 7


def model_size(c: Column) -> Column:
    """Billions of parameters from a model's name: the first of an ordered list of hints that it contains, else 7."""
    known = F.array(*(F.struct(F.lit(hint).alias("hint"), F.lit(size).alias("size")) for hint, size in SIZE_HINTS))
    return F.coalesce(F.get(F.filter(known, lambda h: F.contains(F.lower(c), h["hint"])), F.lit(0))["size"], F.lit(DEFAULT_SIZE))


def label_display(c: Column) -> Column:
    """A label's name as a title: blanks for underscores, each word with a capital."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def valid_name(c: Column) -> Column:
    return F.coalesce(c.rlike(K8S_NAME), F.lit(False))


def ordered_distinct(c: Column) -> Column:
    """Non-blank stripped values in order of first appearance."""
    return F.array_distinct(F.filter(F.transform(c, py_strip), lambda x: F.length(x) > 0))
