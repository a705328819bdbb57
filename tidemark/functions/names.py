"""Name keys: folding, transliteration, surname and initial."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Latin spellings of Cyrillic letters, and particles that are no part of a surname.
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e",
    "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m",
    "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u",
    "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch",
    "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
PARTICLES = ["de", "del", "della", "di", "da", "van", "von", "der", "den", "la", "le", "st"]


@F.pandas_udf(StringType())
def decomposed(text: pd.Series) -> pd.Series:
    """Unicode NFKD; Spark has no function for it."""
    return text.str.normalize("NFKD")


def fold(text: Column) -> Column:
    """Lower case without accents and punctuation, white space squeezed; null gives an empty text."""
    bare = F.lower(F.regexp_replace(decomposed(F.coalesce(text, F.lit(""))), r"\p{M}", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^a-zа-я0-9\s]", " "), r"\s+", " "))


def latin(folded: Column) -> Column:
    """A folded text in Latin letters."""
    table = F.create_map(*[F.lit(x) for pair in LATIN.items() for x in pair])
    return F.trim(F.array_join(F.transform(F.split(folded, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), ""))


def surname_and_initial(latin_name: Column) -> Column:
    """struct(surname, initial) of a folded Latin name; particles do not count.

    A single last letter makes all longer words the surname; a single first letter, all the others; else
    the last word is the surname and the first one gives the initial.
    """
    parts = F.filter(F.split(latin_name, " "), lambda w: (w != "") & ~w.isin(PARTICLES))
    n = F.size(parts)
    first, last = F.get(parts, F.lit(0)), F.get(parts, n - 1)
    long_words, letters = F.filter(parts, lambda w: F.length(w) > 1), F.filter(parts, lambda w: F.length(w) == 1)
    pair = lambda s, i: F.struct(s.alias("surname"), i.alias("initial"))
    none = F.lit("")
    return (
        F.when(n == 0, pair(none, none))
        .when((n >= 2) & (F.length(last) == 1) & (F.size(long_words) > 0), pair(F.array_join(long_words, " "), F.get(letters, F.lit(0))))
        .when((n >= 2) & (F.length(first) == 1), pair(F.array_join(F.slice(parts, F.lit(2), n), " "), first))
        .when(n >= 2, pair(last, F.substring(first, 1, 1)))
        .otherwise(pair(first, none))
    )


def cleaned(name: Column) -> Column:
    """Without seeds in brackets, marks at the ends and doubled spaces."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(name), r"[(\[{].*?[)\]}]", ""), r"^[ .,-]+|[ .,-]+$", ""), r"\s+", " ")


#: Words that are no part of a name, and what stands between the two sides of a title.
STOP = ["the", "and", "vs", "атп", "wta", "atp", "теннис", "tennis"]
VERSUS = r"(?iU)\s+(?:vs\.?|v\.?|против)\s+|[–—/]|(?<!\w)\s-\s"
WORD = "[A-Za-zА-Яа-яЁё]"
_SINGLE = {k: v for k, v in LATIN.items() if len(v) == 1} | {k: "" for k, v in LATIN.items() if not v}


def latin_letters(lower: Column) -> Column:
    """A lower-case text in Latin letters, whatever else it holds."""
    for letter, spelled in LATIN.items():
        if len(spelled) > 1:
            lower = F.replace(lower, F.lit(letter), F.lit(spelled))
    kept = {k: v for k, v in _SINGLE.items() if v}
    return F.translate(lower, "".join(kept) + "".join(k for k in _SINGLE if k not in kept), "".join(kept.values()))


def name_tokens(text: Column) -> Column:
    """Words of three letters or more, in lower case, also in Latin letters, and the longer ones without their last letter too."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD + "{3,}"), 0), F.lower))
    pairs = F.transform(words, lambda w: F.struct(w.alias("w"), F.when(w.rlike("[а-яё]"), latin_letters(w)).otherwise(w).alias("l")))
    but_last = lambda x: F.substring(x, F.lit(1), F.length(x) - 1)
    forms = F.transform(pairs, lambda p: F.array(
        p["w"], p["l"], F.when(F.length(p["w"]) >= 5, but_last(p["w"])), F.when((F.length(p["w"]) >= 5) & (F.length(p["l"]) >= 5), but_last(p["l"]))
    ))
    return F.array_sort(F.array_distinct(F.filter(F.flatten(forms), lambda t: t.isNotNull() & (F.length(t) >= 3) & ~t.isin(STOP))))


def folded_word(word: Column) -> Column:
    """A word in lower-case Latin letters; the ending -ez counts as -es."""
    return F.regexp_replace(latin_letters(F.lower(word)), "ez$", "es")


def surnames_and_letters(name: Column) -> Column:
    """struct(surnames, letters): folded surnames of four letters or more, and first letters that the given name may have.

    With an initial, or with one long word only, all long words are surnames; else the first is the given name.
    """
    words = F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(WORD + "+"), 0)
    initials, longs = F.filter(words, lambda w: F.length(w) == 1), F.filter(words, lambda w: F.length(w) >= 3)
    one = (F.size(initials) > 0) | (F.size(longs) < 2)
    surnames = F.transform(F.when(one, longs).otherwise(F.slice(longs, F.lit(2), F.greatest(F.size(longs), F.lit(1)))), folded_word)
    given = F.concat(initials, F.when(one, F.array().cast("array<string>")).otherwise(F.slice(longs, 1, 1)))
    first = F.flatten(F.transform(given, lambda w: F.array(F.substring(F.lower(w), 1, 1), F.substring(latin_letters(F.lower(w)), 1, 1))))
    return F.struct(F.filter(surnames, lambda w: F.length(w) >= 4).alias("surnames"), F.array_distinct(F.filter(first, lambda x: x != "")).alias("letters"))


def title_sides(title: Column, url: Column) -> Column:
    """The sides of what a page is about: the name in a person's address, else the title up to a colon or bar."""
    person = F.regexp_extract(F.coalesce(url, F.lit("")), "(?i)/person/([^/?#]+)", 1)
    subject = F.when(person != "", F.translate(person, "-_", "  ")).otherwise(F.get(F.split(F.coalesce(title, F.lit("")), "[:|]"), F.lit(0)))
    return F.split(subject, VERSUS)


def about(name: Column, title: Column, url: Column) -> Column:
    """Whom a page with this surname means: ``same`` person, ``other``, ``both``, or ``absent``.

    A surname at the start of a side, after another surname, or after a word with a fitting first
    letter is the person's own; after any other word it is a namesake's. Names without a surname or a
    first letter cannot be told from namesakes: ``absent``.
    """
    return about_person(surnames_and_letters(name), title, url)


def about_person(own: Column, title: Column, url: Column) -> Column:
    """``about`` of a column of ``surnames_and_letters``. It is asked for every word, so where it is no plain column it is reckoned for every word."""
    surnames, letters = own["surnames"], own["letters"]
    fits = lambda w: F.array_contains(letters, F.substring(F.lower(w), 1, 1)) | F.array_contains(letters, F.substring(latin_letters(F.lower(w)), 1, 1))
    surname = lambda w: F.array_contains(surnames, folded_word(w))

    def verdicts(side: Column) -> Column:
        words = F.regexp_extract_all(side, F.lit(WORD + "+"), 0)

        def verdict(w: Column, i: Column) -> Column:
            before = F.get(words, i - 1)
            return F.when(surname(w), (i == 0) | F.coalesce(surname(before) | fits(before), F.lit(False)))

        return F.filter(F.transform(words, verdict), lambda v: v.isNotNull())

    all_ = F.flatten(F.transform(title_sides(title, url), verdicts))
    known = (F.size(surnames) > 0) & (F.size(letters) > 0)
    same, other = F.exists(all_, lambda v: v), F.exists(all_, lambda v: ~v)
    return F.when(~known, "absent").when(same & other, "both").when(same, "same").when(other, "other").otherwise("absent")
