"""Text functions as columns; all run in the JVM.

Patterns take Unicode classes where the reference semantics do: ``(?U)``. Columns
that hold arrays should be made with ``once`` before they are used more than once.
"""

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

from . import constants as K

_MASK = "\u0001"
#: What (?U)\\s matches.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _any(words) -> str:
    return "|".join(words)


def stripped(c: Column) -> Column:
    """Without white space (Unicode's) at both ends. No pattern, which would try every blank inside."""
    return F.btrim(c, F.lit(_SPACES))


def matches(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def words(c: Column) -> Column:
    """Runs of ASCII letters with inner apostrophes and hyphens."""
    return matches(c, K.WORD)


def lowered(array: Column) -> Column:
    return F.transform(array, F.lower)


def space_words(c: Column) -> Column:
    """Number of runs between white space."""
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


@lru_cache(maxsize=1)
def _bare_letters() -> tuple[str, str]:
    """Characters that are one character and combining marks, with that character for each; then the marks, for which there is none."""
    letters, marks = {}, []
    for k in range(sys.maxunicode + 1):
        c = chr(k)
        if unicodedata.category(c) == "Mn":
            marks.append(c)
        elif unicodedata.decomposition(c):
            left = [x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"]
            if len(left) == 1 and left[0] != c:
                letters[c] = left[0]
    return "".join([*letters, *marks]), "".join(letters.values())


def unaccented(c: Column) -> Column:
    """Lower case without combining marks, alone or as parts of characters."""
    return F.lower(F.translate(c, *_bare_letters()))


def name_forms(name: Column) -> Column:
    """'Last, First' for every place where a name of several parts can be cut; a single part stays."""
    parts = F.filter(F.split(name, r"(?U)\s+"), lambda p: p != "")
    n = F.size(parts)
    forms = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, i + 1, F.greatest(n - i, F.lit(1))), " "), F.lit(", "), F.array_join(F.slice(parts, 1, i), " ")))
    return F.when(n < 2, F.array(name)).otherwise(forms)


def paragraphs(c: Column, between: str = K.PROFILE_PARAGRAPH) -> Column:
    """Stripped, not empty; between is a pattern."""
    return F.filter(F.transform(F.split(c, "\n" if between == r"\n" else f"(?U){between}"), stripped), lambda p: p != "")


def unwrapped(c: Column) -> Column:
    return F.regexp_replace(c, "\n+", " ")


def pieces_by_sentence(c: Column, most: int = -1) -> Column:
    """Cut after . ! ? and white space, before a capital or a quote; into at most so many pieces, if a number is given."""
    return F.split(c, f"(?<=[{K.SENTENCE_END}])(?U:\\s)+(?=[{K.SENTENCE_START}])", most)


def sentences(c: Column) -> Column:
    """As pieces_by_sentence, but periods of abbreviations end nothing."""
    masked = F.regexp_replace(c, rf"\.(?<=(?iU:\b(?:{_any(K.ABBREVIATIONS)}))\.)", _MASK)  # only periods are looked at
    return F.transform(pieces_by_sentence(masked), lambda s: F.replace(s, F.lit(_MASK), F.lit(".")))


def adverbs(c: Column) -> Column:
    r"""Matches of (?iU)\b\w+ly\b, found from their ends."""
    return F.regexp_count(c, F.lit(r"(?U)[lL][yY](?<=\B[lL][yY])\b"))


def nominalizations(c: Column) -> Column:
    return F.regexp_count(c, F.lit(rf"(?iU)\b\w{{2,}}(?:{_any(K.NOMINAL_SUFFIXES)})\b"))


def is_passive(sentence: Column) -> Column:
    be = _any([*K.BE_FORMS, *K.BE_CONTRACTIONS])
    return sentence.rlike(rf"(?iU)\b(?:{be})\b(?:\s+\w{{2,}}){{0,3}}\s+\b(?:\w{{3,}}ed|{_any(K.IRREGULAR_PARTICIPLES)})\b")


def has_speech(paragraph: Column) -> Column:
    return paragraph.rlike('["“][^"”]+["”]')


def function_words(lower_words: Column) -> Column:
    return F.size(F.filter(lower_words, lambda w: w.isin(K.FUNCTION_WORDS)))


def occurrences(c: Column, what: str) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))) / len(what)


def last_char(c: Column) -> Column:
    return F.substring(stripped(c), -1, 1)


def bigrams(words_: Column) -> Column:
    """Pairs of neighbours as structs of w1 and w2."""
    n = F.size(words_)
    return F.when(n < 2, F.array().cast("array<struct<w1:string,w2:string>>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct(F.element_at(words_, i).alias("w1"), F.element_at(words_, i + 1).alias("w2"))))


def without_markers(c: Column) -> Column:
    """The text between the start and the end marker, stripped; either may be missing."""
    body = F.regexp_replace(c, rf"(?iU)\A(?s:.*?){K.START_MARKER}", "")
    return stripped(F.regexp_replace(body, rf"(?iU){K.END_MARKER}(?s:.*)\z", ""))


def first_line(c: Column) -> Column:
    return stripped(F.split_part(c, F.lit("\n"), F.lit(1)))


def clean_brief(c: Column) -> Column:
    """First line without a leading label and surrounding quotes."""
    return F.btrim(stripped(F.regexp_replace(first_line(c), f"(?iU){K.BRIEF_LABEL}", "")), F.lit("\"' "))


def prompt(display: Column, brief: Column) -> Column:
    return F.concat(F.lit(K.PROMPT[0]), display, F.lit(K.PROMPT[1]), brief, F.lit(K.PROMPT[2]))


def baseline_prompt(style_hint: Column, brief: Column) -> Column:
    """style_hint is null for an unknown register."""
    system = F.coalesce(F.concat(style_hint, F.lit(K.BASELINE_SUFFIX)), F.lit(K.BASELINE_GENERIC))
    return F.concat(F.lit("[INST] "), system, F.lit("\n\n"), brief, F.lit(f"\n\n{K.BASELINE_START} {K.INSTRUCTION_END}"))


def brief_request(preview: Column, most_chars: int = 1500) -> Column:
    return F.concat(F.lit(f"[INST] {K.BRIEF_INSTRUCTION}\n\nScene:\n"), F.left(preview, F.lit(most_chars)), F.lit(f"\n{K.INSTRUCTION_END}"))


def response(c: Column) -> Column:
    """What follows the first end of an instruction, stripped; all if there is none."""
    at = F.instr(c, K.INSTRUCTION_END)
    return F.when(at > 0, stripped(F.substring(c, at + len(K.INSTRUCTION_END), F.length(c)))).otherwise(c)


def forward_slashes(c: Column) -> Column:
    return F.translate(c, "\\", "/")


def is_leaked(brief: Column) -> Column:
    return brief.rlike(f"(?iU){K.LEAKED_BRIEF}")


def is_not_prose(title: Column) -> Column:
    return title.rlike(f"(?iU){K.NOT_PROSE_TITLE}")
