"""Text functions as Column expressions; each stays inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausemill.functions import tables as T

#: Unicode white space, written out so that every regex engine agrees.
WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NON_ALNUM = r"[^\p{L}\p{N}]+"
REF = r"(?i)(clauses?\s+)(\d+(?:\.\d+)*)"
VARIABLE = r"\{\{([A-Za-z0-9_]+)(?:\|[^}]*)?\}\}"
PLACEHOLDER = r"(?s)\{\{(.*?)\}\}"
#: Latin letters with a mark, and without it (no NFD in the built-in functions).
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrsssstt" + "uuuuuuwyzzz"

#: The combining marks U+0300 to U+036F; translate() drops what has no counterpart.
COMBINING = "".join(map(chr, range(0x300, 0x370)))


def squash(x: Column) -> Column:
    """All runs of white space as one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(x, rf"{WS}+", " "), r"^ | $", "")


def trim_ws(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{WS}+|{WS}+\z", "")


def all_caps(x: Column, most: int) -> Column:
    """At most ``most`` bytes, with a letter, and no letter that isn't a capital."""
    return (F.octet_length(x) <= most) & x.rlike(r"\p{L}") & ~x.rlike(r"[\p{L}&&[^\p{Lu}]]")


def schedule_like(x: Column) -> Column:
    return x.rlike(r"(?i)^(schedule|annexure|annex |appendix|exhibit)")


def phrase_norm(x: Column) -> Column:
    """Lower-cased words between single blanks, with a blank at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(x), NON_ALNUM, " ")), F.lit(" "))


def _needle(word: str) -> str:
    import re

    return re.sub(r"[\W_]+", " ", word.lower()).strip()


def contains_phrase(normed: Column, needle: str) -> Column:
    """Whether whole words of ``needle`` stand in a normed text; a needle of six bytes or more may begin a longer word."""
    n = _needle(needle)
    return normed.contains(f" {n}" if len(n.encode()) >= 6 else f" {n} ")


def first_family(normed: Column, families) -> Column:
    """The first family, in order, with a keyword in a normed text; null if none."""
    out = None
    for label, words in families:
        hit = contains_phrase(normed, words[0])
        for w in words[1:]:
            hit = hit | contains_phrase(normed, w)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def normalize_label(x: Column) -> Column:
    """A heading as a label: no number before, no mark behind, ALL CAPS as Title Case with small words small."""
    s = F.regexp_replace(trim_ws(x), r"^[.:;]+|[.:;]+\z", "")
    s = squash(F.regexp_replace(s, rf"^[0-9.()]+{WS}+", ""))
    def word(w: Column, i: Column) -> Column:
        low = F.lower(w)
        parts = F.split(F.regexp_replace(low, r"([-/])", "$1\x01"), "\x01")
        upper = F.array_join(F.transform(parts, _upper_first), "")
        small = (i > 0) & low.isin(*T.SMALL_WORDS)
        return F.when(small, low).when(~w.rlike(r"[\p{L}&&[^\p{Lu}]]"), upper).otherwise(w)

    return F.array_join(F.transform(F.split(s, " "), word), " ")


def _upper_first(p: Column) -> Column:
    head = F.regexp_extract(p, r"^(\P{L}*)", 1)
    n = F.length(head)
    return F.concat(head, F.upper(F.substring(p, n + 1, F.lit(1))), F.substring(p, n + 2, F.length(p)))


def substitute(x: Column, variables: Column) -> Column:
    """``{{name}}`` and ``{{name|Label}}`` by the map ``variables``; unknown names stay."""
    parts = F.split(F.regexp_replace(x, r"(\{\{[A-Za-z0-9_]+(?:\|[^}]*)?\}\})", "\x01$1\x01"), "\x01")
    value = lambda s: F.element_at(variables, F.regexp_extract(s, VARIABLE, 1))
    return F.array_join(F.transform(parts, lambda s, i: F.when(i % 2 == 1, F.coalesce(value(s), s)).otherwise(s)), "")


def rewrite_refs(x: Column, numbers: Column) -> Column:
    """The first number behind each 'clause' by the map ``numbers``; unmapped ones stay."""
    parts = F.split(F.regexp_replace(x, REF, "$1\x01$2\x01"), "\x01")
    return F.array_join(F.transform(parts, lambda s, i: F.when(i % 2 == 1, F.coalesce(F.element_at(numbers, s), s)).otherwise(s)), "")


def cross_refs(x: Column) -> Column:
    """The sorted distinct clause numbers that a text refers to."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit(REF), F.lit(2))))


def placeholders(x: Column) -> Column:
    """Names between double braces, before the first bar, that aren't blank."""
    names = F.transform(F.regexp_extract_all(x, F.lit(PLACEHOLDER), F.lit(1)), lambda s: trim_ws(F.split(s, r"\|", 2)[0]))
    return F.filter(names, lambda s: s != "")


def terms_used(x: Column, terms: Column) -> Column:
    """The terms (of three bytes or more) that stand in a text as they are written."""
    return F.filter(terms, lambda t: (F.octet_length(t) >= 3) & x.contains(t))


def title_similarity(a: Column, b: Column) -> Column:
    """Share of the words (over two bytes) of ``b`` that ``a`` has."""
    words = lambda s: F.filter(F.split(F.lower(s), NON_ALNUM), lambda t: F.octet_length(t) > 2)
    ta, tb = words(F.coalesce(a, F.lit(""))), words(F.coalesce(b, F.lit("")))
    both = F.size(F.filter(tb, lambda t: F.array_contains(ta, t)))
    return F.when((F.size(ta) > 0) & (F.size(tb) > 0), both / F.size(tb)).otherwise(0.0)


def fold(x: Column) -> Column:
    """Lower case without marks on Latin letters, written as one character or as a letter and its marks."""
    return F.translate(F.lower(x), MARKED + COMBINING, PLAIN)


def tokens(x: Column) -> Column:
    """Words of the full-text index."""
    return F.filter(F.split(fold(x), NON_ALNUM), lambda t: t != "")


def slug(x: Column, fallback: str = "") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(s == "", F.lit(fallback)).otherwise(s)


def default_file_name(title: Column) -> Column:
    """A title as a file's name: runs of other characters than letters, digits, '_', '.' and '-' as one '_'; 'draft' if blank."""
    return F.when(trim_ws(F.coalesce(title, F.lit(""))) == "", "draft").otherwise(F.regexp_replace(title, r"[^A-Za-z0-9_.-]+", "_"))


def snippet_bytes(x: Column, most: int = 300) -> Column:
    """A beginning of at most ``most`` bytes that splits no character, with a mark if cut."""
    cut = F.make_valid_utf8(F.substring(F.encode(x, "UTF-8"), 1, most).cast("string"))
    return F.when(F.octet_length(x) <= most, x).otherwise(F.concat(F.regexp_replace(cut, r"\x{FFFD}\z", ""), F.lit("…")))


def snippet_chars(x: Column, most: int = 320) -> Column:
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.substring(x, 1, most), F.lit("…")))


def strip_fences(x: Column) -> Column:
    s = trim_ws(x)
    return F.when(s.rlike(r"(?s)^```(?:json)?.*```\z"), trim_ws(F.regexp_extract(s, r"(?s)^```(?:json)?(.*)```\z", 1))).otherwise(s)


def xml_escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def fnv1a64(x: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, as DECIMAL(20,0): Spark has no unsigned 64-bit type."""
    zero = F.lit("14695981039346656037").cast("decimal(38,0)")
    hexes = F.hex(F.encode(x, "UTF-8"))
    places = F.when(F.length(hexes) > 0, F.sequence(F.lit(1), F.length(hexes) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    bytes_ = F.transform(places, lambda i: F.conv(F.substring(hexes, i, F.lit(2)), 16, 10).cast("int"))

    def step(h: Column, b: Column) -> Column:
        low = (h % 256).cast("int")
        mixed = (h - low + low.bitwiseXOR(b)).cast("decimal(20,0)")
        return (mixed * F.lit("1099511628211").cast("decimal(13,0)") % F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(38,0)")

    return F.aggregate(bytes_, zero, step).cast("decimal(20,0)")
