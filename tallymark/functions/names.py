"""Party-name comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms dropped from the end of a name, written as normalised tokens.
LEGAL_FORMS = (
    "gmbh and co kg", "s a r l", "s à r l", "s p a", "s r l", "s a s", "pty ltd", "co ltd", "and co kg", "and co",
    "s a", "b v", "n v", "k k", "s l", "co kg",
    "inc", "incorporated", "llc", "llp", "lp", "ltd", "limited", "plc", "corp", "corporation", "co", "company",
    "gmbh", "ag", "kg", "ug", "sa", "sas", "sarl", "srl", "spa", "bv", "nv", "kk", "oy", "oyj", "ab", "as", "aps",
    "pty", "sl", "se",
)

NOT_ALPHANUMERIC = r"[^\p{L}\p{Nd}]+"

# Read from the end of the name, the forms are a prefix: one anchored pass drops them all, each time taking the form
# with the most tokens. A form must be followed by a space, so the last remaining token is never dropped.
_TRAILING_FORMS = "^(?:(?:{}) )+".format(
    "|".join(form[::-1] for form in sorted(LEGAL_FORMS, key=lambda f: -len(f.split())))
)


def _words(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), NOT_ALPHANUMERIC, " "))


def normalize_name(c: Column) -> Column:
    """Lower case, ``&`` as "and", punctuation as spaces, trailing legal forms dropped. Diacritics are kept."""
    words = _words(F.replace(c, F.lit("&"), F.lit(" and ")))
    return F.reverse(F.regexp_replace(F.reverse(words), _TRAILING_FORMS, ""))


def tokens(c: Column) -> Column:
    """The set of lower-case alphanumeric tokens, as an array."""
    return F.array_remove(F.array_distinct(F.split(_words(F.coalesce(c, F.lit(""))), " ")), "")


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token sets; two empty sets count as equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def names_match(a: Column, b: Column) -> Column:
    """Equal after normalisation; names printed alike, which is most of them, are settled without it."""
    return (a == b) | (normalize_name(a) == normalize_name(b))
