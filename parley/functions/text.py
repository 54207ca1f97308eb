"""Text functions as Spark columns: normalisation, tokens, n-grams, multiset comparison, validators.

All are JVM expressions but ``fold(exact=True)`` and ``to_devanagari``, whose Unicode tables
Spark lacks; those are small Arrow functions over distinct characters of a batch.
A null text stays null unless a function says otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.once import let

# Number words of the metric, their values, and phrases of several words.
DIGITS = "०१२३४५६७८९"
NUMBER_WORDS = {
    "शून्य": "0", "जीरो": "0", "एक": "1", "दो": "2", "तीन": "3", "चार": "4", "पांच": "5", "पाँच": "5", "छह": "6", "सात": "7",
    "आठ": "8", "नौ": "9", "दस": "10", "ग्यारह": "11", "बारह": "12", "तेरह": "13", "चौदह": "14", "पंद्रह": "15", "सोलह": "16",
    "सत्रह": "17", "अठारह": "18", "उन्नीस": "19", "बीस": "20", "इक्कीस": "21", "बाईस": "22", "तेईस": "23", "चौबीस": "24",
    "पच्चीस": "25", "छब्बीस": "26", "सत्ताईस": "27", "अट्ठाईस": "28", "उनतीस": "29", "तीस": "30", "चालीस": "40", "पचास": "50",
    "चौवन": "54", "साठ": "60", "चौंसठ": "64", "चौसठ": "64", "सत्तर": "70", "अस्सी": "80", "असी": "80", "एटी": "80", "ऐटी": "80",
    "नब्बे": "90", "सौ": "100", "एकसौआठ": "108",
}
NUMBER_PHRASES = {
    "64": ("सिक्सटी फोर", "सिक्स्टी फोर", "सिक्सटी फौर", "सिक्स्टी फौर"),
    "54": ("फिफ्टी फोर", "फिफ्टी फौर"),
    "108": ("वन हंड्रेड एट", "वन हंड्रेड एट्"),
}
#: What separates tokens: everything but letters, numbers, the underscore and the Devanagari block (danda included).
SEPARATORS = r"[^\p{L}\p{N}_\x{0900}-\x{097F}]+"
NOT_TOKEN = r"[^\p{L}\p{N}\x{0900}-\x{097F}]"
NUMBER = r"(?<![\p{L}\p{N}_])[0-9]+(?![\p{L}\p{N}_])"
TERMINATORS = ".!?।"


def _fold_batch(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t).casefold())


def fold(text: Column, exact: bool = False) -> Column:
    """Case-folded text.

    Plain: lower case and ss for the sharp s, which equals full folding for composed Latin, Greek
    without final sigma, Cyrillic and Indic text. ``exact`` also composes (NFC) and folds the rest, in
    an Arrow function.
    """
    if exact:
        return F.pandas_udf(_fold_batch, "string")(text)
    return F.lower(F.regexp_replace(text, "[ßẞ]", "ss"))


def canonical_numbers(text: Column) -> Column:
    """Number words and phrases of normalised text as digits; 1 100 8 becomes 108."""
    out = text
    for value, phrases in NUMBER_PHRASES.items():
        out = F.regexp_replace(out, rf"(?<![^ ])(?:{'|'.join(sorted(phrases, key=len, reverse=True))})(?![^ ])", value)
    known = F.create_map(*(F.lit(x) for pair in NUMBER_WORDS.items() for x in pair))
    mapped = F.array_join(F.transform(F.split(out, " "), lambda w: F.coalesce(F.try_element_at(known, w), w)), " ")
    whole = lambda t: F.regexp_replace(t, r"(?<![^ ])1 100 8(?![^ ])", "108")
    # Words and phrases are Devanagari; most other texts meet no pattern at all.
    return F.when(text.rlike(r"[\x{0900}-\x{097F}]"), whole(mapped)).when(text.contains("1 100 8"), whole(text)).otherwise(text)


def normalize(text: Column, numbers: bool = True, exact: bool = False) -> Column:
    """Folded tokens joined by a space; with ``numbers`` in canonical digits."""
    plain = F.trim(F.regexp_replace(fold(F.translate(text, DIGITS, "0123456789"), exact), SEPARATORS, " "))
    return canonical_numbers(plain) if numbers else plain


def split_tokens(normalized: Column) -> Column:
    """Tokens of normalised text; none of an empty or null one."""
    return F.when(F.coalesce(normalized, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(normalized, " "))


def token(word: Column, exact: bool = False) -> Column:
    """A word folded, without anything but letters, numbers and Devanagari."""
    return F.regexp_replace(fold(word, exact), NOT_TOKEN, "")


def tokens(text: Column) -> Column:
    """The non-empty tokens of a text's words, in order."""
    spaced = F.regexp_replace(fold(F.coalesce(text, F.lit(""))), r"(?U)\s+", " ")
    return F.array_remove(F.split(F.regexp_replace(spaced, r"[^\p{L}\p{N}\x{0900}-\x{097F} ]", ""), " +"), "")


def ngrams(items: Column, size: int) -> Column:
    """All runs of ``size`` consecutive items, joined by a space."""

    def runs(v: Column) -> Column:
        n = F.size(v)
        starts = F.when(n >= size, F.sequence(F.lit(1), F.greatest(F.lit(1), n - (size - 1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(v, i, size), " "))

    return let(items, runs)


def prompt_copied(heard: Column, supplied: Column, run: int = 4) -> Column:
    """Whether two token arrays share a run of ``run`` tokens."""
    return F.coalesce(F.arrays_overlap(ngrams(heard, run), ngrams(supplied, run)), F.lit(False))


def context_copied(candidate: Column, context: Column, primary: Column) -> Column:
    """Whether over a quarter, and four or more, of the candidate's tokens are the context's and not the primary's."""

    def judged(foreign: Column) -> Column:
        # Sets settle most texts: without a foreign token there is nothing to count.
        endless = F.transform(foreign, lambda t: F.struct(t.alias("item"), F.lit(2**31 - 1).alias("n")))
        copied = let(common_sorted(counts(candidate), endless), lambda n: (n >= 4) & (n / F.greatest(F.lit(1), F.size(candidate)) > 0.25))
        return F.when(F.size(foreign) == 0, F.lit(False)).otherwise(copied)

    return let(F.array_intersect(candidate, F.array_except(context, primary)), judged)


def counts(items: Column) -> Column:
    """Distinct items, in order, with how often each is there: array<struct<item, n>>. Nulls don't count.

    Items are sorted and the runs measured, so a text's work grows like that of a sort.
    """
    empty = F.array().cast("array<int>")

    def runs(v: Column) -> Column:
        places = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(v) - 1))).otherwise(empty)
        starts = F.filter(places, lambda i: (i == 0) | (F.get(v, i) != F.get(v, i - 1)))
        length = lambda at, i, k: F.coalesce(F.get(at, k + 1), F.size(v)) - i
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(v, i).alias("item"), length(at, i, k).alias("n"))))

    return let(F.array_sort(F.array_compact(items)), runs)


def common(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays of distinct items as ``counts`` returns them.

    Items meet as sets, by hashing; so do the second, third, ... places of those that are there more than once, each
    under its item and number.
    """

    def more(c: Column) -> Column:
        often = F.filter(c, lambda x: x["n"] > 1)
        return F.flatten(F.transform(often, lambda x: F.transform(F.sequence(F.lit(2), x["n"]), lambda k: F.concat_ws(" ", x["item"], k.cast("string")))))

    return let(a, lambda x: let(b, lambda y: F.size(F.array_intersect(x["item"], y["item"])) + F.size(F.array_intersect(more(x), more(y)))))


def common_sorted(a: Column, b: Column) -> Column:
    """The same by order, whatever the counts: an item may be there any number of times.

    Both are sorted together, where an item of both has itself for its neighbour.
    """
    keyed = lambda c: F.transform(c, lambda x: F.struct(x["item"].alias("item"), x["n"].alias("n")))

    def shared(v: Column) -> Column:
        both = F.transform(v, lambda x, i: F.when(F.get(v, i + 1)["item"] == x["item"], F.least(x["n"], F.get(v, i + 1)["n"])).otherwise(0))
        return F.aggregate(both, F.lit(0), lambda s, n: s + n)

    return let(F.array_sort(F.concat(keyed(a), keyed(b))), shared)


def recall(expected: Column, actual: Column) -> Column:
    """Share of the expected items that are there, with multiplicity; 1.0 of none (arguments: results of ``counts``)."""
    total = lambda e: F.aggregate(e, F.lit(0), lambda s, x: s + x["n"])
    return let(expected, lambda e: F.when(F.size(e) == 0, F.lit(1.0)).otherwise(common(e, actual) / F.greatest(total(e), F.lit(1))))


def numbers(normalized: Column) -> Column:
    """The numbers in normalised text, in order."""
    return F.regexp_extract_all(normalized, F.lit(NUMBER), 0)


def name_recall(reference: Column, hypothesis: Column, names: Iterable[str]) -> Column:
    """Of the names in the normalised reference, the share that the hypothesis has; 1.0 of none."""
    wanted = F.array(*(normalize(F.lit(n), numbers=False) for n in names)) if names else F.array().cast("array<string>")
    there = let(reference, lambda r: F.filter(wanted, lambda n: (n != "") & F.contains(r, n)))
    share = lambda t, h: F.when(F.size(t) == 0, F.lit(1.0)).otherwise(F.size(F.filter(t, lambda n: F.contains(h, n))) / F.greatest(F.size(t), F.lit(1)))
    return let(there, lambda t: let(hypothesis, lambda h: share(t, h)))


def near_repeat(a: Column, b: Column) -> Column:
    return (a == b) | ((F.least(F.length(a), F.length(b)) >= 2) & (F.startswith(a, b) | F.startswith(b, a)))


def repetition_count(items: Column) -> Column:
    """Neighbours that repeat or begin each other, and repeated neighbouring pairs and triples, of a token array."""

    def hits(v: Column) -> Column:
        at = lambda i, k: F.get(v, i + k)
        count = lambda where: F.coalesce(where.cast("int"), F.lit(0))
        each = lambda x, i: (
            count(near_repeat(x, at(i, 1))) + count((x == at(i, 2)) & (at(i, 1) == at(i, 3))) + count((x == at(i, 3)) & (at(i, 1) == at(i, 4)) & (at(i, 2) == at(i, 5)))
        )
        return F.aggregate(F.transform(v, each), F.lit(0), lambda s, x: s + x)

    return let(items, hits)


def valid_rewrite(source: str, rewritten: str, glossary: Iterable[str] = ()) -> Column:
    """Whether a rewrite keeps its source. ``source`` and ``rewritten`` name columns made by ``rewrite_parts``."""
    total = F.greatest(F.lit(1), F.aggregate(F.col(f"{source}.counted"), F.lit(0), lambda s, x: s + x["n"]))
    new = F.aggregate(F.col(f"{rewritten}.counted"), F.lit(0), lambda s, x: s + x["n"])
    kept = common(F.col(f"{source}.counted"), F.col(f"{rewritten}.counted"))
    terms = [normalize(F.lit(g), numbers=False) for g in glossary]
    agreed = F.lit(True)
    for t in terms:
        agreed = agreed & ((t == "") | (F.contains(F.col(f"{source}.plain"), t) == F.contains(F.col(f"{rewritten}.plain"), t)))
    return (
        (F.col(f"{rewritten}.plain") != "")
        & (F.col(f"{source}.numbers") == F.col(f"{rewritten}.numbers"))
        & (kept / total >= 0.85)
        & ((new - kept) / total <= 0.15)
        & agreed
    )


def rewrite_parts(text: Column) -> Column:
    """What ``valid_rewrite`` compares of a text: its plain form, token counts and numbers."""
    plain = normalize(text, numbers=False)
    return F.struct(plain.alias("plain"), counts(split_tokens(plain)).alias("counted"), numbers(normalize(text)).alias("numbers"))


def valid_turns(sources: Column, rewritten: Column, valid: Column) -> Column:
    """Texts of a batch of rewritten turns, null where a turn isn't valid; null if ids aren't 1, 2, ... n.

    ``sources``: array of texts; ``rewritten``: array<struct<id, text>>; ``valid``: array of booleans.
    """
    in_order = (F.size(sources) == F.size(rewritten)) & (F.transform(rewritten, lambda x: x["id"].cast("int")) == F.sequence(F.lit(1), F.size(rewritten)))
    texts = F.zip_with(F.transform(rewritten, lambda x: F.trim(x["text"])), valid, lambda t, ok: F.when(ok, t))
    return F.when((F.size(rewritten) > 0) & in_order, texts)


def end_sentence(text: Column) -> Column:
    """A trimmed text that ends in a terminator; an empty one stays empty."""
    t = F.trim(text)
    return F.when((t == "") | F.right(t, F.lit(1)).isin(*TERMINATORS), t).otherwise(F.concat(t, F.lit("।")))


def rejected_turn(text: Column) -> Column:
    """The text kept for a turn whose rewrite was rejected: one final danda and a tag."""
    return F.concat(F.lit("[uncertain] "), F.regexp_replace(F.trim(text), rf"[{TERMINATORS}\s]+$", ""), F.lit("।"))


def redact(text: Column) -> Column:
    """Masks access tokens in stored messages."""
    return F.regexp_replace(text, r"\bhf_[A-Za-z0-9]+", "hf_***")


def split_list(text: Column) -> Column:
    """Items of a comma- or line-separated list, trimmed, without blanks."""
    return F.filter(F.transform(F.split(text, r"[,\n]"), lambda x: F.trim(x)), lambda x: x != "")


def alignment_form(romanized: Column) -> Column:
    """A romanised word in the letters of an aligner: a-z and the apostrophe, without spaces; a star if nothing is left."""
    kept = F.regexp_replace(F.replace(F.lower(romanized), F.lit("’"), F.lit("'")), "[^a-z']+", "")
    return F.when(kept == "", F.lit("*")).otherwise(kept)


def merge_maps(a: Column, b: Column) -> Column:
    """Both maps' entries; of equal keys those of ``b``, whatever the session's policy for duplicates."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k)), b)


def _devanagari() -> dict[int, str]:
    """Characters of neighbouring Indic scripts by the name that they share with a Devanagari one."""
    scripts = ("BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM")
    # Marks whose names differ.
    marks = {"ਂ": "ं", "ੰ": "ं", "ੱ": "्", "ঁ": "ँ", "ઁ": "ँ"}
    out = {ord(a): b for a, b in marks.items()}
    for code in range(0x0980, 0x0D80):
        script, _, rest = unicodedata.name(chr(code), "").partition(" ")
        if code not in out and script in scripts:
            try:
                out[code] = unicodedata.lookup(f"DEVANAGARI {rest}")
            except KeyError:
                continue
    return out


def to_devanagari(text: Column) -> Column:
    """Text of neighbouring Indic scripts in Devanagari letters, composed; other characters stay."""
    table = _devanagari()

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t.translate(table)))

    return F.pandas_udf(run, "string")(text)
