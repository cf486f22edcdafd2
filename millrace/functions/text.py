"""Text functions of the retrieval engine, as Spark columns.

Regular expressions follow Python's rules where Java's differ: ``(?U)`` for Unicode classes, ``(?d)`` so that only
``\\n`` ends a line, and the four separators U+001C to U+001F as white space.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
SOLID = r"[^\s\x1c-\x1f]"
MALAYALAM = "ഀ-ൿ"
TOKENIZER = "ml-norm-v1"
SUBWORDS = ("none", "prefix", "ngram")

# Fixed values of the search form: letters that are dropped or folded, and punctuation at the edges of words.
ZERO_WIDTH = "​‌‍⁠﻿­"
# Where one of these or a Malayalam sign may be, in ranges: Java tries the single signs of a class one after the other.
MOVED = r"[^\x00-\xAC\xAE-\u0CFF\u0D80-\u200A\u200E-\u205F\u2061-\uFEFE\uFF00-\x{10FFFF}]"
CHILLU = {"ൺ": "ണ്", "ൻ": "ന്", "ർ": "ര്", "ൽ": "ല്", "ൾ": "ള്", "ൿ": "ക്", "ൔ": "മ്", "ൕ": "യ്", "ൖ": "ഴ്"}
AU_SIGN = ("ൌ", "ൗ")
SEQUENCES = {"ളള": "ള്ള", "ററ": "റ്റ"}
EDGES = "\"'`.,;:!?()[]{}<>«»“”‘’—–-=_|*©°#~^+/\\"


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.transform(F.array(c), f)[0]


def where(c: Column, marks: tuple[str, ...], f: Callable[[Column], Column], fold: bool = False) -> Column:
    """``f`` of texts that have one of ``marks``, without which it would change nothing; looking for a mark is cheap."""

    def guarded(x: Column) -> Column:
        seen = F.lower(x) if fold else x
        return F.when(reduce(Column.__or__, [F.contains(seen, F.lit(m)) for m in marks]), f(x)).otherwise(x)

    return let(c, guarded)


def replaced(c: Column, pattern: str, by: str = "", flags: str = "Ud") -> Column:
    return F.regexp_replace(c, f"(?{flags})" + pattern, by)


def nfc(c: Column) -> Column:
    """Unicode NFC, by the ICU library that Spark brings along. Text all below U+0300 is in NFC already. Null stays null."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))
    return F.when(c.rlike("[^\\x00-\\x{2FF}]"), composed).otherwise(c)


def casefold(c: Column) -> Column:
    """Full case folding, by the same library; for texts of ASCII alone lower case is that. Null stays null."""
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    return F.when(c.rlike("[^\\x00-\\x7F]"), folded).otherwise(F.lower(c))


def collapse(c: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(replaced(c, SPACE + "+", " "))


def truncate_query(c: Column, most: int = 2000) -> Column:
    return F.substring(collapse(c), 1, most)


def normalize(c: Column) -> Column:
    """The form that is indexed and searched, from NFC on. Null gives an empty text. ASCII texts only change case."""
    digits = "".join(chr(0x0D66 + i) for i in range(10))

    def beyond(x: Column) -> Column:
        moved = digits + AU_SIGN[0] + ZERO_WIDTH
        out = let(nfc(x), lambda y: F.when(y.rlike(MOVED), F.translate(y, moved, "0123456789" + AU_SIGN[1])).otherwise(y))
        return let(let(out, lambda y: F.when(has_malayalam(y), native(y)).otherwise(y)), casefold)  # named more than once there

    def native(y: Column) -> Column:
        for old, new in (CHILLU | SEQUENCES).items():
            y = F.replace(y, F.lit(old), F.lit(new))
        return y

    return let(F.coalesce(c, F.lit("")), lambda x: F.when(x.rlike("[^\\x00-\\x7F]"), beyond(x)).otherwise(F.lower(x)))


def canonical(c: Column) -> Column:
    return collapse(normalize(c))


def tokenizer_version(subword: str = "prefix", prefix_len: int = 5, ngram_n: int = 4) -> str:
    if subword not in SUBWORDS:
        raise ValueError(f"subword must be one of {SUBWORDS}")
    return f"{TOKENIZER}|{subword}" + {"none": "", "prefix": str(prefix_len), "ngram": str(ngram_n)}[subword]


def tokenize(c: Column, subword: str = "prefix", prefix_len: int = 5, ngram_n: int = 4) -> Column:
    """Tokens in order, repeated ones too: identifiers whole and in parts, numbers without leading zeros, words of two
    letters and more, and for Malayalam words a prefix or character n-grams."""
    tokenizer_version(subword)
    digits = lambda p: F.when(F.contains(p, F.lit(",")), F.regexp_replace(p, r"(?U)(?<=\d),(?=\d)", "")).otherwise(p)
    letter = f"[0-9a-z{MALAYALAM}]"
    # Pieces with a digit or a Malayalam letter, whole, and else words as they are.
    apart = rf"[\d{MALAYALAM}]"
    pieces = rf"(?U)(?<!{SOLID})[^\s\x1c-\x1f\d{MALAYALAM}]*+{apart}{SOLID}*|[a-zà-ɏ]{{2,}}"

    def parts(w: Column) -> Column:
        number = F.regexp_replace(w, "^0+(?=[0-9])", "")
        plain = F.when(w.rlike("^[0-9]+$"), F.array(number)).when(F.length(w) < 2, F.array().cast("array<string>"))
        native = w.rlike(f"[{MALAYALAM}]")
        if subword == "prefix":
            more = F.when(native & (F.length(w) >= prefix_len), F.array(w, F.concat(F.lit("~"), F.substring(w, 1, prefix_len))))
        elif subword == "ngram":
            grams = F.transform(F.sequence(F.lit(1), F.length(w) - ngram_n + 1), lambda i: F.concat(F.lit("#"), w.substr(i, F.lit(ngram_n))))
            more = F.when(native & (F.length(w) > ngram_n), F.concat(F.array(w), grams))
        else:
            return F.coalesce(plain, F.array(w))
        return F.coalesce(plain, more, F.array(w))

    def tokens(p: Column) -> Column:
        whole = F.when(p.rlike(f"{letter}[/.\\-:]{letter}") & p.rlike(r"(?U)\d"), F.array(p)).otherwise(F.array().cast("array<string>"))
        words = F.regexp_extract_all(p, F.lit(f"[0-9a-zà-ɏ{MALAYALAM}]+"), F.lit(0))
        return F.concat(whole, F.flatten(F.transform(words, parts)))

    def of_text(x: Column) -> Column:
        found = F.regexp_extract_all(x, F.lit(pieces), F.lit(0))
        cut = lambda p: F.when(p.rlike(f"(?U){apart}"), tokens(F.btrim(digits(p), F.lit(EDGES)))).otherwise(F.array(p))
        return F.when(x.rlike(f"(?U){apart}"), F.flatten(F.transform(found, cut))).otherwise(found)

    return let(normalize(c), of_text)


def tokenize_raw(c: Column) -> Column:
    """Lower case, cut at white space: the baseline."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), f"(?U){SPACE}+"), lambda p: p != "")


def content_hash(c: Column) -> Column:
    return F.sha1(F.encode(F.coalesce(c, F.lit("")), "UTF-8"))


def has_malayalam(c: Column) -> Column:
    return F.coalesce(c.rlike(f"[{MALAYALAM}]"), F.lit(False))


# ---------------------------------------------------------------- cleaning

# What counts as a page label, an address, junk, a heading or needless space; with each, marks one of which
# is in any text that it matches.
PAGE_RULES = (
    (rf"Page{SPACE}*\d+", "i", ("page",)), (rf"താൾ{SPACE}*\d+", "", ("താൾ",)), (rf"പേജ്{SPACE}*\d+", "", ("പേജ്",)),
    (rf"\bPage{SPACE}+\d+\b", "im", ("page",)), (rf"\bപേജ്{SPACE}+\d+\b", "im", ("പേജ്",)), (rf"\bതാൾ{SPACE}+\d+\b", "im", ("താൾ",)),
    (r"^\d+$", "im", ()), (r"\[\d+\]", "im", ("[",)), (r"\(\d+\)", "im", ("(",)),
)
# Rules for whole lines are tied to a line's start, from where they match if they match at all.
URL_RULES = (
    (rf"^.*https?://{SOLID}+.*", "m", ("http",)), (rf"https?://{SOLID}+|www\.{SOLID}+", "", ("http", "www.")),
    (rf"^.*email{SPACE}*:{SPACE}*{SOLID}+.*", "im", ("ema",)), (rf"{SOLID}+@{SOLID}+", "", ("@",)),
)
JUNK_RULES = (
    (r"[|_]{2,}", ("||", "|_", "_|", "__")), (r"[|\\]{2,}", ("||", "|\\", "\\|", "\\\\")), (r"_{3,}", ("___",)), (r"-{3,}", ("---",)), (r"\.{4,}", ("....",)),
    (rf"{SPACE}+[\|\\/]{SPACE}+", ("|", "\\", "/")), (r"[•●■◆◦]+", ("•", "●", "■", "◆", "◦")),
)
HEADER_RULES = (rf"^copyright{SPACE}+©", r"^\d{1,2}/\d{1,2}/\d{2,4}\n?$", rf"^chapter{SPACE}+\d+\n?$", rf"^section{SPACE}+\d+\n?$")
SPACE_RULES = ((r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"))


def strip(c: Column) -> Column:
    return replaced(c, rf"\A{SPACE}+|{SPACE}+\z")


def _without(c: Column, pattern: str, flags: str, marks: tuple[str, ...]) -> Column:
    if not marks:
        return replaced(c, pattern, "", "Ud" + flags)
    return where(c, marks, lambda x: replaced(x, pattern, "", "Ud" + flags), "i" in flags)


def remove_page_numbers(c: Column) -> Column:
    for pattern, flags, marks in PAGE_RULES:
        c = _without(c, pattern, flags, marks)
    return c


def remove_urls(c: Column) -> Column:
    """Lines with a URL or an address label go as a whole, then what is left of either."""
    for pattern, flags, marks in URL_RULES:
        c = _without(c, pattern, flags, marks)
    return c


def remove_junk(c: Column) -> Column:
    for pattern, marks in JUNK_RULES:
        c = _without(c, pattern, "", marks)
    return c


def remove_headers(c: Column) -> Column:
    """Lines of under three characters go, but for Malayalam, and lines that are only a heading or a date."""
    heading = "(?Udi)" + "|".join(HEADER_RULES)
    stays = lambda own: F.when(F.length(own) < 3, has_malayalam(own)).otherwise(~own.rlike(heading))
    return F.array_join(F.filter(F.split(c, "\n"), lambda line: let(strip(line), stays)), "\n")


def fix_whitespace(c: Column) -> Column:
    for pattern, by in SPACE_RULES:
        c = F.regexp_replace(c, pattern, by)
    return c


def clean_text(c: Column) -> Column:
    """All steps in order, NFC first; null gives an empty text."""
    c = nfc(F.coalesce(c, F.lit("")))
    return strip(fix_whitespace(remove_headers(remove_junk(remove_urls(remove_page_numbers(c))))))


# ---------------------------------------------------------------- extraction, display


def needs_ocr(c: Column, least: int = 50) -> Column:
    return F.length(strip(F.coalesce(c, F.lit("")))) < least


def page_method(text: Column, ocr: Column, least: int = 50) -> Column:
    return F.when(~needs_ocr(text, least), "pypdf").when(~needs_ocr(ocr, least), "ocr").otherwise("pypdf_fallback")


def source_label(source: Column) -> Column:
    name = F.regexp_replace(source, r"(?i)\.pdf$", "")
    return F.when(name.rlike(r"^\d+(\s+\d+)?$"), F.concat(F.lit("Kerala Gazette No. "), name)).otherwise(F.regexp_replace(name, "[-_]", " "))


# Fixed value: the messages that are answered without a search.
CASUAL = "hi|hello|hey|hii|helo|hai|helo|namaste|വണക്കം|ഹലോ|ഹായ്|thanks|thank you|നന്ദി|ok|okay|yes|no|ഉം|ശരി"


def is_casual(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))).rlike(rf"(?i)^({CASUAL})[\s!.?]*$")
