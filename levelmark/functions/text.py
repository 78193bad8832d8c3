"""Keys, ids, list cells and name parsing."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from levelmark.reference_values import ABOUT_SEPARATOR, TITLE_SEPARATOR

# All Unicode white space plus the four ASCII separators.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Fixed values. No bracket anywhere, or bracketed as a whole ((?d): only \n ends a line).
TITLE_FORMAT = r"(?d)^[^\[\]]+$|^\[.*\]$"
SECTOR_LABEL = r"^(.*?) \((.*?)\)*$"
OBJECT_URI = r"^s3://([^/]+)/(.*)$"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def normalise_key(c: Column) -> Column:
    """Lower case, then strip: the join key of topics and skills."""
    return strip(F.lower(c))


def course_text(title: Column, about: Column, learn: Column) -> Column:
    """Title, about and learn in one text; null when any part is null."""
    return F.concat(title, F.lit(TITLE_SEPARATOR), about, F.lit(ABOUT_SEPARATOR), learn)


def content_id(text: Column, title: Column) -> Column:
    """Hex SHA-256 of the lower-cased text and title."""
    return F.sha2(F.lower(F.concat(text, title)), 256)


def content_id_stripped(c: Column) -> Column:
    return F.sha2(normalise_key(c), 256)


def is_list_like(c: Column) -> Column:
    """True when the stripped cell is one JSON list (double quotes only)."""
    # Stripped once: an inner array column that the tests below share.
    return F.coalesce(F.get(F.transform(F.array(strip(c)), _is_list), F.lit(0)), F.lit(False))


def _is_list(cell: Column) -> Column:
    options = {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "_bad"}
    wrapped = F.from_json(
        F.concat(F.lit('{"v":'), cell, F.lit("}")), "v string, _bad string", options
    )
    # The array wrapping rejects text that closes the list and adds another field.
    single = F.json_array_length(F.concat(F.lit("["), cell, F.lit("]"))) == 1
    strict = wrapped["v"].isNotNull() & wrapped["_bad"].isNull()
    # The cheaper tests first: most cells are plain names.
    bracketed = cell.startswith("[") & cell.endswith("]")
    return F.when(bracketed & single, strict)


def parse_list_cell(c: Column) -> Column:
    """List literal, single or double quoted, to array; null when it is none."""
    trailing_comma = F.regexp_replace(c, r",\s*\]\s*$", "]")
    options = {"allowBackslashEscapingAnyCharacter": "true"}
    return F.when(c.startswith("["), F.from_json(trailing_comma, "array<string>", options))


def title_format_ok(c: Column) -> Column:
    """Null, a plain name, or a bracketed list."""
    return c.isNull() | c.rlike(TITLE_FORMAT)


def sector_alias(label: Column) -> Column:
    return F.regexp_extract(label, SECTOR_LABEL, 1)


def sector_name(label: Column) -> Column:
    return F.regexp_extract(label, SECTOR_LABEL, 2)


def uri_bucket(uri: Column) -> Column:
    """Bucket of an object URI, null when the URI is malformed."""
    return F.when(uri.rlike(OBJECT_URI), F.regexp_extract(uri, OBJECT_URI, 1))


def uri_key(uri: Column) -> Column:
    return F.when(uri.rlike(OBJECT_URI), F.regexp_extract(uri, OBJECT_URI, 2))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/?$", 1)


def file_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def tokens(c: Column) -> Column:
    """Lower-cased words (letters and digits) in order, with an empty one where
    the text starts or ends with something else."""
    return F.split(F.lower(c), r"[^\p{L}\p{N}]+")
