"""Text and metadata extraction, the text gate and extraction outcomes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.settings import DEFAULTS

# Keys of the extraction metadata that tell about pages.
CHARS_PER_PAGE_KEY = "pdf:charsPerPage"
PAGES_KEY = "xmpTPg:NPages"

# Characters stripped from both ends of a text before it is measured.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Names under which contents declare single-byte character sets.
SINGLE_BYTE = {
    "cp1250": ("windows-1250", "cp1250", "x-cp1250"),
    "cp1251": ("windows-1251", "cp1251"),
    "cp1252": ("windows-1252", "cp1252", "iso-8859-1", "latin1", "us-ascii", "ascii"),
    "iso-8859-2": ("iso-8859-2", "latin2"),
    "iso-8859-15": ("iso-8859-15", "latin9"),
}

# Elements of HTML that stand on lines of their own, and cells of a line.
BLOCK_TAGS = (
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noframes "
    "noscript ol option p pre search section select summary table tbody textarea tfoot thead title tr ul"
).split()
CELL_TAGS = ("td", "th")
# Other elements that show that a content is marked up.
INLINE_TAGS = (
    "a abbr acronym b base bdi bdo big button canvas cite code col colgroup data datalist del dfn em embed font i "
    "iframe img input ins kbd label link map mark meta object param picture q rp rt ruby s samp script small source "
    "span strike strong style sub sup svg template time tt u var video wbr"
).split()


def _tags(names: Sequence[str]) -> str:
    return rf"</?(?:{'|'.join(names)})(?:\s[^<>]*|/)?>"


# Markup to text, in this order: hidden parts, comments, cells, blocks, other tags.
MARKUP_STEPS = (
    (r"(?is)<(script|style|template)\b[^>]*>.*?</\1\s*>", " "),
    (r"(?s)<!--.*?-->", " "),
    ("(?i)" + _tags(CELL_TAGS), "\t"),
    ("(?i)" + _tags(BLOCK_TAGS), "\n"),
    (r"<[/!?]?[A-Za-z\[][^>]*>", ""),
)
SPACE_STEPS = ((r"[ \t]+", " "), (r"\s*\n\s*", "\n"))

#: A content is marked up if it has a document type or an element anywhere.
_MARKUP = rf"(?i)<!doctype\s+html|<\?xml\s|{_tags([*BLOCK_TAGS, *CELL_TAGS, *INLINE_TAGS])}"
_REFERENCE = r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});|&[A-Za-z][A-Za-z0-9]{1,31};"


def _named_references() -> Column:
    """The characters of all named references of HTML that end with a semicolon."""
    names = [name for name in html5 if name.endswith(";")]
    return F.map_from_arrays(F.lit([f"&{n}" for n in names]), F.lit([html5[n] for n in names]))


def _references(text: Column) -> Column:
    """Character references as characters, each decoded once; unknown ones stay as they are."""
    names = _named_references()

    def decoded(piece: Column) -> Column:
        digits = F.regexp_extract(piece, "^&#[xX]?([0-9a-fA-F]+);$", 1)
        hexadecimal = piece.rlike("^&#[xX]")
        code = F.when(hexadecimal, F.conv(digits, 16, 10).try_cast("long")).otherwise(digits.try_cast("long"))
        valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        numeric = piece.rlike("^&#.+;$")
        named = piece.rlike("^&[A-Za-z].*;$")
        return (
            F.when(numeric & valid, char)
            .when(named, F.coalesce(F.try_element_at(names, piece), piece))
            .otherwise(piece)
        )

    parts = F.regexp_extract_all(text, F.lit(f"{_REFERENCE}|[^&]+|&"), F.lit(0))
    return F.when(text.rlike(_REFERENCE), F.array_join(F.transform(parts, decoded), "")).otherwise(text)


def markup_text(html: Column) -> Column:
    """The readable text of a page, one block per line, cells of a line apart."""
    for pattern, replacement in MARKUP_STEPS:
        html = F.regexp_replace(html, pattern, replacement)
    html = _references(html)
    for pattern, replacement in SPACE_STEPS:
        html = F.regexp_replace(html, pattern, replacement)
    return html


def extract_text(content: Column) -> Column:
    """Text of plain or marked-up content; the content decides, not a declared type."""
    return F.when(content.rlike(_MARKUP), markup_text(content)).otherwise(content)


def extract_metadata(content: Column) -> Column:
    """Metadata of the content as a map from name to a list of values."""

    def found(name: str, value: Column) -> Column:
        return F.when(value != "", F.struct(F.lit(name), F.array(value)))

    title = markup_text(F.regexp_extract(content, r"(?is)<title[^>]*>(.*?)</title>", 1))
    language = F.regexp_extract(content, r"(?is)<html[^>]*\slang=\"([^\"]*)\"", 1)
    charset = F.regexp_extract(content, r"(?is)<meta[^>]*\scharset=\"?([A-Za-z0-9_-]+)", 1)
    kind = F.when(content.rlike(_MARKUP), "text/html").otherwise("text/plain")
    entries = F.array(
        found("Content-Type", kind),
        found("Content-Encoding", charset),
        found("dc:language", language),
        found("dc:title", F.btrim(title, F.lit(" \n"))),
    )
    return F.map_from_entries(F.filter(entries, lambda e: e.isNotNull()))


def _single_byte(content: Column, charset: str) -> Column:
    """Bytes of a single-byte character set as text."""
    high = bytes(range(128, 256)).decode("iso-8859-1")
    chars = bytes(range(128, 256)).decode(charset, "replace")
    return F.translate(F.decode(content, "ISO-8859-1"), high, chars)


def _wide(content: Column, charset: str, size: int, little: bool) -> Column:
    """UTF-16 or UTF-32 bytes, their mark included, as text; null if they are malformed."""
    units = F.regexp_extract_all(F.hex(content), F.lit(f".{{{2 * size}}}"), F.lit(0))
    if little:
        pairs = F.lit("(..)(..)(..)(..)" if size == 4 else "(..)(..)")
        turned = "$4$3$2$1" if size == 4 else "$2$1"
        units = F.transform(units, lambda u: F.regexp_replace(u, pairs, F.lit(turned)))
    if size == 4:
        fine = F.forall(units, lambda u: (u <= "0010FFFF") & ~u.between("0000D800", "0000DFFF"))
    else:
        # A high surrogate stands before each low one, and nowhere else.
        high = F.transform(units, lambda u: u.between("D800", "DBFF"))
        low = F.transform(units, lambda u: u.between("DC00", "DFFF"))
        before = F.concat(F.array(F.lit(False)), high)
        after = F.concat(low, F.array(F.lit(False)))
        fine = before == after
    whole = F.octet_length(content) % size == 0
    return F.when(whole & fine, F.decode(content, charset))


def decoded_text(content: Column, fallback: str = "cp1250") -> Column:
    """Bytes as text; null if they are no text.

    A byte order mark decides, then valid UTF-8, then the character set that the content names,
    then `fallback`. Bytes with a zero are no text unless a mark says UTF-16 or UTF-32.
    """
    mark = F.hex(F.substring(content, 1, 4))
    utf8 = F.try_validate_utf8(content.cast("string"))
    latin = F.decode(content, "ISO-8859-1")
    named = F.lower(F.regexp_extract(latin, r"(?is)<(?:meta|\?xml)[^>]*?(?:charset|encoding)\s*=\s*[\"']?([A-Za-z0-9_:-]+)", 1))
    declared = F.lit(None).cast("string")
    for charset, names in SINGLE_BYTE.items():
        declared = F.when(named.isin(*names), _single_byte(content, charset)).otherwise(declared)
    return (
        F.when(mark.startswith("EFBBBF"), F.try_validate_utf8(F.substring(content, F.lit(4), F.octet_length(content)).cast("string")))
        .when(mark == "FFFE0000", _wide(content, "UTF-32", 4, True))
        .when(mark == "0000FEFF", _wide(content, "UTF-32", 4, False))
        .when(mark.startswith("FFFE"), _wide(content, "UTF-16", 2, True))
        .when(mark.startswith("FEFF"), _wide(content, "UTF-16", 2, False))
        .when(F.contains(latin, F.lit("\0")), F.lit(None).cast("string"))
        .when(utf8.isNotNull(), utf8)
        .otherwise(F.coalesce(declared, _single_byte(content, fallback)))
    )


def builtin_extractor(objects: DataFrame) -> DataFrame:
    """Extract plain and marked-up text with built-in functions only.

    Input has `content`; output adds text, meta, http_code (200, or 422 for other formats) and
    message.
    """
    text = F.col("_decoded")
    decoded = objects.select("sha256", decoded_text(F.col("content").cast("binary")).alias("_decoded"))
    return decoded.select(
        "sha256",
        extract_text(text).alias("text"),
        extract_metadata(text).alias("meta"),
        F.when(text.isNull(), 422).otherwise(200).alias("http_code"),
        F.when(text.isNull(), "unsupported content").alias("message"),
    )


def python_extractor(
    parse: Callable[[bytes], tuple[str, dict[str, list[str]]]],
) -> Callable[[DataFrame], DataFrame]:
    """An extractor for other formats from a function of bytes to (text, metadata).

    Runs in Arrow batches where the objects are. A ValueError marks one object as permanently
    unsupported, any other exception as failed; the batch goes on.
    """
    schema = "sha256 string, text string, meta map<string,array<string>>, http_code int, message string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for sha256, content in zip(batch["sha256"], batch["content"]):
                try:
                    text, meta = parse(bytes(content))
                    rows.append((sha256, text, meta, 200, None))
                except ValueError as fault:
                    rows.append((sha256, None, None, 422, str(fault)))
                except Exception as fault:
                    rows.append((sha256, None, None, 500, str(fault)))
            yield pd.DataFrame(rows, columns=["sha256", "text", "meta", "http_code", "message"])

    def extract(objects: DataFrame) -> DataFrame:
        return objects.select("sha256", "content").mapInPandas(run, schema)

    return extract


def chars_per_page(meta: Column, text: Column) -> Column:
    """Characters per page: the extractor's figure if it is a number, else length by pages."""
    stated = F.get(F.element_at(meta, CHARS_PER_PAGE_KEY), 0)
    number = r"(?i)^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)\s*$"
    figure = F.when(stated.rlike(number), F.btrim(stated).try_cast("double"))
    counted = F.get(F.element_at(meta, PAGES_KEY), 0)
    whole = F.when(counted.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.btrim(counted).try_cast("long"))
    pages = F.greatest(F.lit(1).cast("long"), F.coalesce(whole, F.lit(1).cast("long")))
    measured = F.length(F.btrim(text, F.lit(WHITE_SPACE))) / pages
    return F.coalesce(figure, measured)


def low_text(per_page: Column, minimum: float = DEFAULTS.min_chars_per_page) -> Column:
    """Whether a document has too little text to be searched."""
    return per_page < F.lit(minimum)


def outcome_class(code: Column) -> Column:
    """`ok`, `permanent` for 4xx, and `retryable` for 5xx or no answer at all."""
    return (
        F.when(code.isNull(), "retryable")
        .when(code.between(400, 499), "permanent")
        .when(code >= 500, "retryable")
        .otherwise("ok")
    )


def outcome_message(
    code: Column, message: Column, limit: int = DEFAULTS.max_message_chars
) -> Column:
    """The error text kept on a row; null for a success."""
    cut = F.substring(F.coalesce(message, F.lit("")), 1, limit)
    return (
        F.when(code.isNull(), F.concat(F.lit("no answer: "), cut))
        .when(code >= 400, F.concat(F.lit("status "), code.cast("string"), F.lit(": "), cut))
    )
