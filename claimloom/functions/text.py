"""Text expressions: normalisation, entities, lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of web text, beyond what \s means: no-break and other Unicode spaces.
SPACE = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
#: Those of SPACE beyond Latin-1.
FAR_SPACE = r"[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

#: Named entities and what they stand for, in the order in which they are replaced.
ENTITIES = [("<![CDATA[", ""), ("]]>", ""), ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]

NUMERIC_ENTITY = r"&#[xX][0-9a-fA-F]+;|&#[0-9]+;|[^&]+|&"


def normalize_text(c: Column) -> Column:
    """Lower case, white space squeezed to one blank, trimmed."""
    # classes of single characters below 256 are one look-up in a table of bits; SPACE asks one predicate after the other
    low = F.lower(c)
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"[\t\n\x0B\f\r\x{a0}]+", " "), " {2,}", " "))
    return F.when(low.rlike(r"[\x{1680}-\x{feff}]"), plain(F.regexp_replace(low, FAR_SPACE + "+", " "))).otherwise(plain(low))


def replace_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Java regular expressions and replacements, one after the other."""
    for pattern, to in pairs:
        c = F.regexp_replace(c, pattern, to)
    return c


def decode_entities(c: Column) -> Column:
    """Named entities, CDATA marks, decimal and hexadecimal code points; numbers that are no character stay as they are."""
    for name, to in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(to))

    def piece(p: Column) -> Column:
        digits = F.regexp_extract(p, r"^&#[xX]?([0-9a-fA-F]+);$", 1)
        hexadecimal = p.rlike(r"^&#[xX][0-9a-fA-F]+;$")
        n = F.when(F.length(digits) > 7, F.lit(-1)).when(hexadecimal, F.conv(digits, 16, 10).cast("long")).when(p.rlike(r"^&#[0-9]+;$"), digits.cast("long"))
        is_char = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        return F.when(is_char, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(p)

    return F.when(c.contains("&#"), F.array_join(F.transform(F.regexp_extract_all(c, F.lit(NUMERIC_ENTITY), F.lit(0)), piece), "")).otherwise(c)


def lines(c: Column) -> Column:
    """The lines of a text: no carriage returns, white space squeezed, trimmed, empty ones left out."""
    squeezed = F.transform(F.split(F.replace(c, F.lit("\r"), F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, SPACE + "+", " ")))
    return F.filter(squeezed, lambda x: x != "")


def normalize_lines(c: Column) -> Column:
    return F.array_join(lines(c), "\n")
