"""Words in Latin letters: Indic scripts by what Unicode calls their characters, Latin ones without their marks.

Letters are looked up in a trie, the longest entry first: a consonant with the sign that follows it is one entry, so that its own
vowel goes. A word's last consonant of a script that is read that way loses it too. Names of letters decide, so no table of them is kept.
"""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import alignment_form

#: Scripts of the blocks from U+0900 on, and those whose words drop a last vowel that isn't written.
SCRIPTS = ("DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM")
CLIPPED = ("DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI")
FIRST, LAST = 0x0900, 0x0D7F
SIGNS = {"ANUSVARA": "n", "CANDRABINDU": "n", "BINDI": "n", "ADAK BINDI": "n", "TIPPI": "n", "VISARGA": "h", "AVAGRAHA": "", "NUKTA": "", "VIRAMA": ""}
LATIN = {"ß": "ss", "ẞ": "ss", "Æ": "ae", "æ": "ae", "Œ": "oe", "œ": "oe", "þ": "th", "Þ": "th", "ð": "d", "Ð": "d", "ı": "i"}


def _sound(name: str) -> str:
    """The sound that a letter's name gives: that of its last word, without what tells long from short or candra forms."""
    words = [w for w in name.split() if w not in ("CANDRA", "SHORT", "VOCALIC", "ARCHAIC", "CHILLU")]
    return words[-1].lower() if words else ""


@functools.cache
def _letters() -> dict[str, tuple[str, str, str]]:
    """Each character's (script, kind, sound); kinds: vowel, consonant, sign (of a vowel), mark, digit."""
    found = {}
    for code in range(FIRST, LAST + 1):
        name = unicodedata.name(chr(code), "")
        script, _, rest = name.partition(" ")
        if script not in SCRIPTS:
            continue
        if rest.startswith("DIGIT "):
            found[chr(code)] = script, "digit", str(unicodedata.digit(chr(code)))
        elif rest.startswith("VOWEL SIGN "):
            found[chr(code)] = script, "sign", _sound(rest.removeprefix("VOWEL SIGN "))
        elif rest.startswith("SIGN ") and rest.removeprefix("SIGN ") in SIGNS:
            found[chr(code)] = script, "mark", SIGNS[rest.removeprefix("SIGN ")]
        elif rest.startswith("LETTER "):
            sound = _sound(rest.removeprefix("LETTER "))
            found[chr(code)] = script, "consonant" if len(sound) > 1 and sound[-1] == "a" and sound[0] not in "aeiou" else "vowel", sound
    return found


@functools.cache
def trie() -> dict:
    """Nested dicts by character; "" holds an entry's (sound, sound at a word's end)."""
    letters, root = _letters(), {}

    def add(text: str, sound: str, last: str | None = None) -> None:
        node = root
        for c in text:
            node = node.setdefault(c, {})
        node[""] = sound, sound if last is None else last

    for c, (script, kind, sound) in letters.items():
        add(c, sound, sound[:-1] if kind == "consonant" and script in CLIPPED else None)
        if kind == "consonant":
            for nukta in ("", *(m for m, (s, _, _) in letters.items() if s == script and unicodedata.name(m).endswith("SIGN NUKTA"))):
                if nukta:
                    add(c + nukta, sound, sound[:-1] if script in CLIPPED else None)
                for m, (s, k, vowel) in letters.items():
                    if s == script and k == "sign":
                        add(c + nukta + m, sound[:-1] + vowel)
                    elif s == script and unicodedata.name(m).endswith("SIGN VIRAMA"):
                        add(c + nukta + m, sound[:-1])
    for c, sound in LATIN.items():
        add(c, sound)
    return root


def romanize(word: str) -> str:
    """A word in Latin letters; characters of other scripts stay as their compatibility forms without marks."""
    text, root, out, at = unicodedata.normalize("NFC", word), trie(), [], 0
    while at < len(text):
        node, end, entry, to = root, at, None, at
        while end < len(text) and text[end] in node:
            node, end = node[text[end]], end + 1
            if "" in node:
                entry, to = node[""], end
        if entry is None:
            out.append("".join(c for c in unicodedata.normalize("NFKD", text[at]) if not unicodedata.combining(c)))
            at += 1
        else:
            # A single letter does not lose its vowel.
            out.append(entry[1] if to == len(text) and at else entry[0])
            at = to
    return "".join(out)


def romanized(word: Column) -> Column:
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else romanize(w))

    return F.pandas_udf(run, "string")(word)


def aligner_words(words: DataFrame, word: str, out: str = "letters") -> DataFrame:
    """``words`` with ``out``, the word as an aligner takes it: a-z and the apostrophe, or a star.

    Every distinct word is romanised once and joined back; a word that a third of all rows have is one row of the smaller side, so
    the adaptive join can split it.
    """
    known = words.select(word).where(F.col(word).isNotNull()).distinct().withColumn(out, alignment_form(romanized(F.col(word))))
    return words.join(known, word, "left").select(*words.columns, out)
