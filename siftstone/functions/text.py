"""Text normalisation as Column -> Column functions; everything stays inside Spark's generated code."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: letters that fold to several letters, or to one that isn't their decomposition's base
MULTI = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
SINGLE = {"ł": "l", "ø": "o", "đ": "d", "ð": "d", "ı": "i", "ħ": "h", "ŧ": "t"}
# fixed values: folds within other scripts
SCRIPTS = {"ё": "е", "ς": "σ", "ά": "α", "έ": "ε", "ή": "η", "ί": "ι", "ϊ": "ι", "ΐ": "ι", "ό": "ο", "ύ": "υ", "ϋ": "υ", "ΰ": "υ", "ώ": "ω", "أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ی": "ي", "ک": "ك", "ة": "ه"}
# fixed values: Arabic articles, in the order in which they are tried
ARTICLES = ("وال", "بال", "كال", "فال", "ال", "لل")
#: Combining marks, Arabic vowel signs, superscript alef and tatweel: dropped
DROPPED = r"[\u0300-\u036F\u064B-\u065F\u0670\u0640]"
#: Scripts written without spaces: Thai, Lao, Myanmar, Khmer, kana, Han, Hangul
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uAC00-\uD7AF\uF900-\uFAFF\x{20000}-\x{2A6DF}"


def _latin() -> tuple[str, str]:
    """Small letters up to U+024F and U+1EFF whose decomposition starts with an ASCII letter."""
    pairs = {}
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(cp)
        base = unicodedata.normalize("NFKD", c)[0]
        if c == c.lower() and base.isascii() and base.isalpha() and c not in MULTI:
            pairs[c] = base.lower()
    pairs |= SINGLE
    return "".join(pairs), "".join(pairs.values())


LATIN_FROM, LATIN_TO = _latin()


def fold(text: Column, han: tuple[str, str] = ("", "")) -> Column:
    """Lower case, no accents, one form of a letter. han: traditional characters and their simplified ones."""
    out = F.regexp_replace(F.lower(text), DROPPED, "")
    out = F.translate(out, LATIN_FROM + "".join(SCRIPTS) + han[0], LATIN_TO + "".join(SCRIPTS.values()) + han[1])
    for a, b in MULTI.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def fold_sql(x: str) -> str:
    """The same for a DuckDB expression, for texts without marks and other scripts."""
    out = f"translate(lower({x}), '{LATIN_FROM}', '{LATIN_TO}')"
    for a, b in MULTI.items():
        out = f"replace({out}, '{a}', '{b}')"
    return out


def drop_empty(words: Column) -> Column:
    return F.filter(words, lambda w: w != "")


def name_words(name: Column) -> Column:
    """Folded words of a name: split at white space, ASCII punctuation and the marks of other scripts."""
    return drop_empty(F.split(fold(name), r"[\s\p{Z}\p{Punct}–—‐·•«»“”‘’、。，（）【】「」]+"))


def name_text(words: Column) -> Column:
    """Words with a space at every edge; a single space without words."""
    return F.when(F.size(words) == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")))


def name_grams(text: Column) -> Column:
    """Every slice of 2 and 3 characters of a name text, and each unspaced character alone."""
    n = F.char_length(text)
    two = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(text, i, 2))).otherwise(F.array().cast("array<string>"))
    three = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(text, i, 3))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(two, three, F.regexp_extract_all(text, F.lit(f"[{UNSPACED}]"), F.lit(0))))


def compose(text: Column) -> Column:
    """NFKC, which Spark lacks: a Pandas UDF that is handed only the texts with characters that it may change.

    That is what fold() has no table for: jamo, marks of kana, half- and full-width forms, letter-like signs.
    """
    some = F.when(text.rlike(COMPOSED), text)
    return F.coalesce(F.pandas_udf(_normalised, "string")(some), text)


def _normalised(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


COMPOSED = r"[\u1100-\u11FF\u2000-\u206F\u2070-\u218F\u2460-\u24FF\u3099\u309A\u3130-\u318F\u3200-\u33FF\uA960-\uA97F\uD7B0-\uD7FF\uF900-\uFAFF\uFB00-\uFEFF\uFF00-\uFFEF]"


def terms(text: Column, index: bool = True) -> Column:
    """Folded terms of a body. Unspaced runs give bigrams; in the index each of their characters too.

    Terms of 40 bytes and more are left out; an Arabic article goes if three letters remain. Only texts that have such
    scripts are looked at term by term.
    """
    # the folded text is bound to a variable, as it is read more than once
    return F.transform(F.array(fold(text)), lambda folded: F.when(folded.rlike(rf"[{UNSPACED}\u0600-\u06FF]"), _script_terms(folded, index)).otherwise(_short(F.regexp_extract_all(folded, F.lit(WORD), F.lit(0)))))[0]


WORD = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"


def _short(words: Column) -> Column:
    return F.filter(words, lambda t: F.octet_length(t) < 40)


def _script_terms(folded: Column, index: bool) -> Column:
    pieces = F.regexp_extract_all(folded, F.lit(f"[{UNSPACED}]+|[\\p{{L}}\\p{{N}}&&[^{UNSPACED}]][\\p{{L}}\\p{{N}}\\p{{M}}&&[^{UNSPACED}]]*"), F.lit(0))

    def cut(w: Column) -> Column:
        n = F.char_length(w)
        grams = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(w, i, 2))).otherwise(F.array(w))
        singles = F.when(n >= 2, F.split(w, "")) if index else None
        both = F.concat(grams, drop_empty(F.coalesce(singles, F.array().cast("array<string>")))) if index else grams
        return F.when(w.rlike(f"^[{UNSPACED}]"), both).otherwise(F.array(F.regexp_replace(w, f"^({'|'.join(ARTICLES)})(?=.{{3,}})", "")))

    return _short(F.flatten(F.transform(pieces, cut)))


def spaced_terms(text: Column) -> Column:
    """terms() for corpora without unspaced scripts: one regular expression over the folded text."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def norm(text: Column) -> Column:
    """Folded words joined by single spaces; what is neither letter, digit nor _ separates."""
    return F.trim(F.regexp_replace(fold(text), r"[^\p{L}\p{N}_]+", " "))


def lines(text: Column) -> Column:
    """Lines at every Unicode line boundary; a terminator at the end begins no line."""
    split = F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]")
    return F.when(F.element_at(split, -1) == "", F.slice(split, F.lit(1), F.size(split) - 1)).otherwise(split)


def content_lines(text: Column) -> Column:
    """Lines without white space and zero-width characters at their ends; empty ones left out."""
    edge = r"^[\s\u200B-\u200D\u2060\uFEFF]+|[\s\u200B-\u200D\u2060\uFEFF]+$"
    return drop_empty(F.transform(lines(text), lambda x: F.regexp_replace(x, edge, "")))


def word_count(text: Column) -> Column:
    return F.size(drop_empty(F.split(text, r"\s+")))


# fixed values: the references that are decoded by name
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "amp": "&"}


def decode_entities(text: Column) -> Column:
    """amp, lt, gt, quot, apos, nbsp, decimal and hexadecimal references; others stay. Each is decoded once.

    A text is cut where references stand and put together from what lies between them and what they mean.
    """
    reference = r"&(#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,8}|amp|lt|gt|quot|apos|nbsp);"
    between = F.split(text, reference)
    named = F.create_map(*[F.lit(x) for k, v in ENTITIES.items() for x in (k, v)])

    def meant(name: Column) -> Column:
        digits = F.substring(name, 2, 9)
        code = F.when(digits.rlike("^[xX]"), F.conv(F.substring(digits, 2, 8), 16, 10)).otherwise(digits).cast("bigint")
        high, low = F.floor((code - 0x10000) / 1024) + 0xD800, F.pmod(code - 0x10000, F.lit(1024)) + 0xDC00
        # two bytes of UTF-16 for each unit
        units = F.when(code < 0x10000, F.lpad(F.hex(code), 4, "0")).otherwise(F.concat(F.hex(high.cast("bigint")), F.hex(low.cast("bigint"))))
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.when(name.startswith("#"), F.when(valid, F.decode(F.unhex(units), "UTF-16BE")).otherwise(F.concat(F.lit("&"), name, F.lit(";")))).otherwise(F.element_at(named, name))

    signs = F.transform(F.regexp_extract_all(text, F.lit(reference), F.lit(1)), meant)
    joined = F.concat(F.array_join(F.flatten(F.transform(F.arrays_zip(F.slice(between, F.lit(1), F.size(between) - 1).alias("a"), signs.alias("b")), lambda x: F.array(x["a"], x["b"]))), ""), F.element_at(between, -1))
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


#: Tags that end a line of text
BLOCKS = "p|div|br|li|ul|ol|tr|td|th|table|h1|h2|h3|h4|h5|h6|section|article|header|footer|nav|blockquote|pre|title"


def html_text(html: Column) -> Column:
    """Text of markup: script and style go (to the end if unclosed), block tags break lines, other tags vanish."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?(</(script|style)\s*>|$(?![\s\S]))", "")
    out = F.regexp_replace(out, rf"(?is)</?({BLOCKS})(\s[^>]*)?/?>", "\n")
    return decode_entities(F.regexp_replace(out, r"(?s)<[^>]*>", ""))


def html_element(html: Column, tag: str) -> Column:
    """White-space-collapsed text of the first such element; null if there is none or it is empty."""
    inner = F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}", 1)
    text = F.trim(F.regexp_replace(decode_entities(F.regexp_replace(inner, r"(?s)<[^>]*>", "")), r"\s+", " "))
    return F.when(text != "", text)


def markdown_headings(text: Column) -> Column:
    """Up to three headings of the first level, then up to three of the second."""
    first = F.slice(F.regexp_extract_all(text, F.lit(r"(?m)^# +(.*)$"), F.lit(1)), 1, 3)
    second = F.slice(F.regexp_extract_all(text, F.lit(r"(?m)^## +(.*)$"), F.lit(1)), 1, 3)
    return F.concat(first, second)


def domain_from_url(url: Column) -> Column:
    """Host of an address in lower case, without user, port and www.; null where it is no valid host."""
    rest = F.regexp_extract(F.regexp_replace(url, r"^blob:", ""), r"(?s)^[^:/?#]+://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"^.*@", ""), r":\d*$", ""), r"(?i)^www\.", ""))
    good = host.rlike(r"^(\[[0-9a-f:.]+\]|[\p{L}\p{N}]([\p{L}\p{N}_-]*[\p{L}\p{N}])?(\.[\p{L}\p{N}]([\p{L}\p{N}_-]*[\p{L}\p{N}])?)*)$")
    return F.when(good, host)


def webkit_to_unix(micros: Column) -> Column:
    """Microseconds since 1601 as seconds since 1970; 0 if that is not after 1970."""
    return F.greatest(((micros - F.pmod(micros, F.lit(1_000_000))) / 1_000_000).cast("bigint") - F.lit(11_644_473_600), F.lit(0).cast("bigint"))


def percent_decoded(value: Column) -> Column:
    """%hh as bytes of UTF-8; a plus sign stays, what isn't two hexadecimal digits too."""
    pieces = F.regexp_extract_all(value, F.lit(r"(?s)%[0-9A-Fa-f]{2}|[^%]+|%"), F.lit(0))
    digits = F.transform(pieces, lambda x: F.when(x.rlike("^%[0-9A-Fa-f]{2}$"), F.substring(x, 2, 2)).otherwise(F.hex(F.encode(x, "UTF-8"))))
    return F.make_valid_utf8(F.unhex(F.array_join(digits, "")).cast("string"))


def normalize_tag(tag: Column) -> Column:
    return F.concat(F.lit("xdgtag"), F.regexp_replace(F.lower(tag), r"[^\p{L}\p{N}]+", ""))


def truncate_bytes(text: Column, limit: int) -> Column:
    """The longest prefix of whole characters within limit bytes."""
    cut = F.substring(F.encode(text, "UTF-8"), 1, limit)
    kept = F.regexp_replace(F.decode(cut, "ISO-8859-1"), r"(?s)([\xC2-\xDF]|[\xE0-\xEF][\x80-\xBF]?|[\xF0-\xF4][\x80-\xBF]{0,2})$", "")
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.decode(F.encode(kept, "ISO-8859-1"), "UTF-8"))


# fixed values: function words that tell English from Iberian text
ENGLISH = ("the", "and", "of", "to", "is", "for", "that", "with", "this", "by", "be", "are")
IBERIAN = ("de", "que", "em", "en", "el", "do", "da", "os", "los", "las", "para", "con", "com", "um", "una")


def stopword_language(text: Column) -> Column:
    """en if English function words are five or more and over twice the Iberian ones, in the first 4000 characters; else other."""
    words = F.split(norm(F.left(text, F.lit(4000))), " ")
    en = F.size(F.filter(words, lambda w: w.isin(*ENGLISH)))
    ib = F.size(F.filter(words, lambda w: w.isin(*IBERIAN)))
    return F.when((en >= 5) & (en > ib * 2), "en").otherwise("other")
