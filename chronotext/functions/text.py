"""Column expressions for titles, lines, tokens and years. All of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Stop words of the vocabulary step.
VOCABULARY_STOPWORDS = (
    "a b c d e f g h j k l m n o p q r s t u v w x y z also all about who have not has th had "
    "been be its this or an but are that were as which with it from on at for is by was to and "
    "in of the"
).split()

# Stop words of the topic-model step, by kind.
NUMERALS = "1 2 3 4 5 6 7 8 9 0 000".split()
ROMAN_NUMERALS = "ii iii iv".split()
LETTERS = "a b c d e f g h j k l m n o p q r s t u v w x y z".split()
COMMON_WORDS = "and in for to was by a of is as from on it at which with that s were are but or".split()
TOPIC_STOPWORDS = sorted({*NUMERALS, *ROMAN_NUMERALS, *LETTERS, *COMMON_WORDS})

# A year mention is a whole run of letters, digits and underscores that is four ASCII digits.
YEAR = r"(?=[0-9])(?<![\p{L}\p{Nd}_])[0-9]{4}(?![\p{L}\p{Nd}_])"
# The same with the value limited to 501 ... 2199.
DATABLE_YEAR = (
    r"(?=[0-2])(?<![\p{L}\p{Nd}_])"
    r"(?:050[1-9]|05[1-9][0-9]|0[6-9][0-9]{2}|1[0-9]{3}|2[01][0-9]{2})"
    r"(?![\p{L}\p{Nd}_])"
)


def _text(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# --- titles and pages -----------------------------------------------------------------------


def slug(title: Column | str) -> Column:
    """Lower-cased title without anything but ASCII word characters."""
    return F.lower(F.regexp_replace(_text(title), r"[^A-Za-z0-9_]+", ""))


def flatten_whitespace(content: Column | str) -> Column:
    """Every run of line breaks and tabs becomes one space."""
    return F.regexp_replace(_text(content), r"[\r\n\t]+", " ")


def html_title(html: Column | str) -> Column:
    return F.regexp_extract(_text(html), r"<title>(.*?)</title>", 1)


def html_content(html: Column | str) -> Column:
    """Page text: the markup without scripts, styles and tags."""
    without_code = F.regexp_replace(_text(html), r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.regexp_replace(without_code, r"<[^>]*>", " ")


# --- lines ----------------------------------------------------------------------------------


def fields(line: Column | str) -> Column:
    """Tab-separated fields of a line; trailing empty fields do not count."""
    line = _text(line)
    trimmed = F.split(F.regexp_replace(line, r"\t+\z", ""), "\t")
    return F.when(line.rlike(r"\A\t+\z"), F.array().cast("array<string>")).otherwise(trimmed)


def field(line: Column | str, position: int) -> Column:
    """Field by position, NULL when the line has fewer."""
    return F.get(fields(line), F.lit(position))


def first_field(line: Column | str) -> Column:
    """Field 0, without splitting the rest of a long line; NULL for a line of tabs only."""
    line = _text(line)
    return F.when((line == "") | line.rlike(r"[^\t]"), F.substring_index(line, "\t", 1))


def leading_year(text: Column | str) -> Column:
    """The first four characters as a number, NULL if they are none."""
    return F.substring(_text(text), 1, 4).try_cast("int")


def clip(text: Column | str, length: int = 500) -> Column:
    return F.left(_text(text), F.lit(length))


# --- tokens ---------------------------------------------------------------------------------


def letter_tokens(text: Column | str) -> Column:
    """Lower-case runs that start with a letter and go on with letters or apostrophes."""
    return F.regexp_extract_all(F.lower(_text(text)), F.lit(r"[a-z]['a-z]*"), F.lit(0))


def word_tokens(text: Column | str) -> Column:
    """Lower-case runs of ASCII word characters."""
    return F.regexp_extract_all(F.lower(_text(text)), F.lit(r"[a-z0-9_]+"), F.lit(0))


def is_number(token: Column | str) -> Column:
    return _text(token).rlike(r"\A[0-9]+\z")


def drop_tokens(tokens: Column | str, stopwords: list[str]) -> Column:
    """Token array without the stop words; repeated tokens stay repeated."""
    return F.filter(_text(tokens), lambda token: ~token.isin(stopwords))


def topic_tokens(text: Column | str) -> Column:
    """Word tokens without stop words and without plain numbers."""
    return F.filter(
        word_tokens(text), lambda token: ~token.isin(TOPIC_STOPWORDS) & ~is_number(token)
    )


# --- years ----------------------------------------------------------------------------------


def first_year(text: Column | str) -> Column:
    """The first year mention between 501 and 2199 as written, NULL if there is none."""
    found = F.regexp_extract(_text(text), DATABLE_YEAR, 0)
    return F.when(found != "", found)


def explode_first_year(text: Column | str) -> Column:
    """``first_year`` as a generator, which drops texts without one and runs the pattern once.

    A filter on the year would be pushed below it, and the pattern run again there.
    """
    found = F.regexp_extract(_text(text), DATABLE_YEAR, 0)
    return F.explode(F.array_remove(F.array(found), ""))


# --- rendering ------------------------------------------------------------------------------


def sparse_line(terms: Column | str) -> Column:
    """``<number of terms> <idx>:<n> <idx>:<n> ...`` from an array of (idx, n)."""
    terms = _text(terms)
    pairs = F.transform(
        terms, lambda t: F.concat(t["idx"].cast("string"), F.lit(":"), t["n"].cast("string"))
    )
    return F.concat(F.size(terms).cast("string"), F.lit(" "), F.array_join(pairs, " "))


def lookup_line(idx: Column | str, token: Column | str) -> Column:
    return F.concat_ws(",", _text(idx).cast("string"), _text(token))
