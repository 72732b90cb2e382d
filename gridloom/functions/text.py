"""Text functions. Positions and lengths count code points."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the Latin-ASCII transliteration: characters that become several, and single ones without a decomposition.
SEVERAL = {
    "ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH", "ĳ": "ij", "Ĳ": "IJ", "ŉ": "'n",
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
    "©": "(C)", "®": "(R)", "«": "<<", "»": ">>", "„": ",,", "…": "...", "¼": " 1/4", "½": " 1/2", "¾": " 3/4",
}
SINGLES = {
    "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i", "ŧ": "t", "Ŧ": "T",
    "ĸ": "q", "ŋ": "n", "Ŋ": "N", "ſ": "s", "ƀ": "b", "Ɓ": "B", "ƒ": "f", "Ɨ": "I", "ƶ": "z", "Ƶ": "Z",
    "×": "*", "÷": "/", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "‘": "'", "’": "'", "‚": ",", "‛": "'",
    "“": '"', "”": '"', "‟": '"', "‹": "<", "›": ">",
}


def latin_letters() -> tuple[str, str]:
    """Single characters and, at the same places, what they become: SINGLES, accented letters of the Latin blocks (to U+024F, and U+1E00
    to U+1EFF) without their marks, fullwidth forms as the plain ones."""
    pairs = dict(SINGLES)
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code) and chr(code) not in SEVERAL:
            plain = SINGLES.get(plain, plain)
            if plain.isascii():
                pairs[chr(code)] = plain
    pairs |= {chr(code): chr(code - 0xFEE0) for code in range(0xFF01, 0xFF5F)}
    return "".join(pairs), "".join(pairs.values())


def transliterate(text: Column) -> Column:
    """Latin letters without accents and punctuation in ASCII, case kept; combining accents go."""
    for letter, several in SEVERAL.items():
        text = F.replace(text, F.lit(letter), F.lit(several))
    return F.translate(F.regexp_replace(text, "[\u0300-\u036f]", ""), *latin_letters())


def paste(*parts: Column | str) -> Column:
    """Concatenation in which a missing value prints as NA."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("NA")) for p in parts))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def popup(label: Column, value: Column) -> Column:
    """Label in bold, then the value; both escaped, missing values as NA."""
    return F.concat(F.lit("<b>"), escape_html(paste(label)), F.lit("</b><br>"), escape_html(paste(value)))


def first_index(text: Column, query: Column) -> Column:
    """Place (from 0) of the first match whatever the case; -1 without one, null for a null text."""
    return F.instr(F.lower(text), F.lower(query)) - 1


MARK, MARK_END = "<mark class='search-match'>", "</mark>"
_BEFORE, _AFTER = 50, 200


def snippet(text: Column, query: str) -> Column:
    """The text around the first match of query, the match marked.

    It begins at the delimiter (blank, comma, colon) before a match that lies 50 characters in or more, else at the beginning. It
    ends at the first delimiter 200 characters after its beginning and the marks, with an ellipsis; where none follows, the last
    character goes. A text without a match stays as it is.
    """
    n = len(query)
    upto_delimiter = lambda s: F.length(F.regexp_extract(s, "^[^ ,:]*", 0))

    def around(m: Column) -> Column:
        marked = F.concat(F.substring(text, F.lit(1), m), F.lit(MARK), F.substring(text, m + 1, F.lit(n)), F.lit(MARK_END), F.substring(text, m + 1 + n, F.length(text)))
        back = F.reverse(F.substring(text, F.lit(1), m))
        begin = F.when(m < _BEFORE, 0).otherwise(_let(upto_delimiter(back), lambda d: F.when(d < m, m - d).otherwise(0)))
        return _let(F.struct(marked.alias("marked"), begin.alias("begin")), clipped)

    def clipped(x: Column) -> Column:
        clip, whole = x.begin + len(MARK) + len(MARK_END) + _AFTER, F.length(x.marked)
        part = lambda end: F.substring(x.marked, x.begin + 1, end - x.begin)
        to_delimiter = _let(upto_delimiter(F.substring(x.marked, clip + 1, whole)), lambda d: F.when(clip + d < whole, F.concat(part(clip + d), F.lit("…"))).otherwise(part(whole - 1)))
        return F.when(clip > whole, part(whole)).otherwise(to_delimiter)

    return _let(first_index(text, F.lit(query)), lambda m: F.when(m >= 0, around(m)).otherwise(text))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def quote_regex(text: str) -> str:
    return "".join("\\" + c if c in r".*+?^${}()|[]\-" else c for c in text)


def highlight_all(text: Column, query: str) -> Column:
    """Every match marked, whatever the case."""
    return F.regexp_replace(text, "(?i)" + quote_regex(query), "<mark>$0</mark>")


def unhighlight(text: Column) -> Column:
    return F.regexp_replace(text, r"</?mark(?: class='search-match')?>", "")


def encode_list(items: Column) -> Column:
    """Base64 of the URI-encoded, comma-joined items. Blanks become %20, as in URI components."""
    return F.base64(F.replace(F.url_encode(F.array_join(items, ",")), F.lit("+"), F.lit("%20")).cast("binary"))


def decode_list(text: Column) -> Column:
    return F.split(F.url_decode(F.decode(F.unbase64(text), "UTF-8")), ",", -1)


def base_href(href: Column) -> Column:
    """The address without its fragment."""
    return F.substring_index(href, "#", 1)


def add_param(url: Column, name: str, value: Column) -> Column:
    """The url with name=value before its fragment."""
    base = base_href(url)
    sep = F.when(F.instr(base, "?") > 1, "&").otherwise("?")
    return F.concat(base, sep, F.lit(name + "="), value, F.substring(url, F.length(base) + 1, F.length(url)))


def split_escaped(text: Column, sep: str, escape: str = "\\") -> Column:
    """Pieces between unescaped separators; an escaped character stands for itself; an empty last piece is left out."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(False).alias("esc"))

    def step(acc: Column, c: Column) -> Column:
        new = lambda done, now, esc: F.struct(done.alias("done"), now.alias("now"), F.lit(esc).alias("esc"))
        grown = F.concat(acc.now, c)
        return F.when(acc.esc, new(acc.done, grown, False)).when(c == sep, new(F.array_append(acc.done, acc.now), F.lit(""), False)).when(c == escape, new(acc.done, acc.now, True)).otherwise(new(acc.done, grown, False))

    return F.aggregate(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), empty, step, lambda acc: F.when(acc.now != "", F.array_append(acc.done, acc.now)).otherwise(acc.done))


def json_member(text: Column, path: str) -> Column:
    """A member of a JSON text by its dotted path. Members are data: nothing is ever evaluated."""
    return F.get_json_object(text, "$." + path)


def words(text: Column) -> Column:
    """Words between runs of white space."""
    return F.filter(F.split(text, r"\s+", -1), lambda w: w != "")


def lat_lng_text(lat: Column, lng: Column) -> Column:
    return F.concat(F.lit("LatLng("), lat.cast("string"), F.lit(", "), lng.cast("string"), F.lit(")"))


def box_text(west: Column, south: Column, east: Column, north: Column) -> Column:
    return F.concat_ws(",", *(x.cast("string") for x in (west, south, east, north)))


def offset_url(offset: Column, url: Column) -> Column:
    """A site path from the page's offset to the root: "../" and "a/b" give "../a/b"."""
    return F.concat(offset, F.regexp_replace(url, "^/", ""))


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """{name} replaced by each value; names without a value stay."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def breadcrumb(crumbs: Column, kind: str = "path") -> Column:
    """root: the first crumb; parent: the last but one; path: all, joined. Null unless there are two crumbs or more."""
    shown = {"root": F.get(crumbs, 0), "parent": F.get(crumbs, F.size(crumbs) - 2), "path": F.array_join(crumbs, " > ")}[kind]
    return F.when(F.size(crumbs) > 1, shown)
