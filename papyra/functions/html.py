"""HTML to text blocks, as column expressions inside one row.

One scan cuts the page into tokens (comment, script, style, head, preformatted text, tag, text).  Each token becomes what
it contributes: a block tag a border, ``<br>`` a line break, a cell border a tab, an inline tag nothing, text itself.
The joined result is split at the borders, so unclosed and wrongly nested tags lose no text.  Entities are decoded after
the tags are gone.  No pattern repeats a group except possessively, so a long page needs no deep stack.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of HTML: the tags that begin and end a block of text.
BLOCK_TAGS = ("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
              "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p "
              "section summary table tbody tfoot thead title tr ul").split()
CELL_TAGS = ["td", "th"]

_TOKEN = (r"(?is)<!--.*?(?:-->|\z)|<(?:script|style|template|noscript)\b.*?(?:</(?:script|style|template|noscript)\s*+>|\z)"
          r"|<head\b.*?(?:</head\s*+>|(?=<body\b)|\z)|<pre\b.*?(?:</pre\s*+>|\z)"
          r"|<[a-z/!?](?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+>|<[a-z/!?][^<>]*+>|[^<]++|<")
_NAME = r"(?i)^</?([a-z][a-z0-9]*)"
_ENTITY = r"&(#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,8}|[A-Za-z][A-Za-z0-9]{1,31});"
BLOCK, BREAK, CELL, SPACE, TAB = "\x01", "\x02", "\x03", "\x04", "\x05"      # marks: no HTML text holds them


def _char(code: Column) -> Column:
    """The character of a code point; those that are none become the replacement character."""
    ok = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("�"))


def decode_entities(text: Column) -> Column:
    """Named (HTML 4) and numeric character references; unknown names stay as they are."""
    named = F.create_map(*[F.lit(x) for k, v in sorted(name2codepoint.items()) for x in (k, chr(v))])

    def one(e: Column) -> Column:
        return (F.when(F.lower(e).startswith("#x"), _char(F.conv(F.substring(e, 3, 8), 16, 10).cast("bigint")))
                .when(e.startswith("#"), _char(F.substring(e, 2, 9).cast("bigint")))
                .otherwise(F.coalesce(F.try_element_at(named, F.when(e == "apos", "#39").otherwise(e)),
                                      F.when(e == "apos", F.lit("'")), F.concat(F.lit("&"), e, F.lit(";")))))
    pieces, found = F.split(text, _ENTITY, -1), F.regexp_extract_all(text, F.lit(_ENTITY), 1)
    joined = F.array_join(F.zip_with(pieces, found, lambda p, e: F.concat(p, F.when(e.isNull(), F.lit("")).otherwise(one(e)))), "")
    return F.when(text.contains("&"), joined).otherwise(text)


def _text(token: Column) -> Column:
    """Text outside tags: any run of white space is one space."""
    return F.regexp_replace(token, r"[ \t\r\n\f]+", " ")


def _preformatted(token: Column) -> Column:
    """Text of a ``pre`` element with its white space, each line end a break."""
    inner = F.regexp_replace(token, r"(?s)<[a-zA-Z/!?][^<>]*+>", "")
    kept = F.translate(F.regexp_replace(inner, r"\r\n?", "\n"), "\n \t", BREAK + SPACE + TAB)
    return F.concat(F.lit(BLOCK), kept, F.lit(BLOCK))


def _contribution(token: Column) -> Column:
    name = F.lower(F.regexp_extract(token, _NAME, 1))
    silent = name.isin("script", "style", "template", "noscript", "head")
    return (F.when(~token.startswith("<") | (token == "<"), _text(token))
            .when(name == "", F.lit(""))                                  # comments, doctype, instructions
            .when((name == "pre") & ~token.startswith("</"), _preformatted(token))
            .when(silent, F.lit(""))
            .when(name == "br", F.lit(BREAK))
            .when(name.isin(*CELL_TAGS), F.lit(CELL))
            .when(name.isin(*BLOCK_TAGS), F.lit(BLOCK))
            .otherwise(F.lit("")))


def html_blocks(html: Column) -> Column:
    """``array<string>``: the text of each block with any (headings, paragraphs, list items, table rows with their
    cells separated by tabs, other block elements), in document order; NULL for NULL."""
    clean = F.translate(html, BLOCK + BREAK + CELL + SPACE + TAB + "\x00", "")
    joined = F.array_join(F.transform(F.regexp_extract_all(clean, F.lit(_TOKEN), 0), _contribution), "")

    def tidy(b: Column) -> Column:
        # The border of one cell and of the next are one tab; breaks and cells have no spaces around them.
        b = F.regexp_replace(b, " *" + CELL + "[ " + CELL + "]*", CELL)
        b = F.regexp_replace(F.regexp_replace(b, " {2,}", " "), " *" + BREAK + " *", BREAK)
        b = F.regexp_replace(b, f"^[ {CELL}{BREAK}]+|[ {CELL}{BREAK}]+$", "")
        return F.translate(b, BREAK + CELL + SPACE + TAB, "\n\t \t")
    blocks = F.transform(F.split(joined, BLOCK), tidy)
    return F.transform(F.filter(blocks, lambda b: F.trim(b) != ""), decode_entities)
