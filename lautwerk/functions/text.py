"""Normal forms of personal names, as column expressions: comparison form, skeleton, Cologne code."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with a transcription of their own.
LETTERS = {
    "ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "Ä": "ae", "Ö": "oe", "Ü": "ue", "ẞ": "ss", "ı": "i", "İ": "i",
    "ł": "l", "Ł": "l", "ø": "oe", "Ø": "oe", "đ": "d", "Đ": "d", "ð": "d", "Ð": "d", "þ": "th", "Þ": "th",
    "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe", "ħ": "h", "ŋ": "ng",
}

# Particles before a surname.
PARTICLES = (
    "von und zu", "von der", "von dem", "von den", "van der", "van den", "van de", "de la", "de le", "zu der",
    "in der", "auf dem", "auf der", "von", "vom", "van", "zu", "zur", "zum", "de", "del", "della", "di", "da", "du",
    "le", "la", "ter", "ten", "op", "af", "dos", "das", "dei",
)

# The rewrites of the skeleton, in order.
SKELETON = (
    ("sch", "s"), ("ph", "f"), ("th", "t"), ("dt$", "t"), ("ck", "k"), ("tz|cz|zz", "z"), ("chs|x", "ks"), ("ch", "k"),
    ("ei|ai|ey|ay", "ai"), ("eu|oi|oy", "oi"), ("ie", "i"), ("ue", "u"), ("oe", "o"), ("ae", "a"), ("v|w", "f"),
    ("c|q|g", "k"), ("y|j", "i"), ("d$", "t"), ("b$", "p"), ("mann$", "man"),
)

#: White space as names are trimmed of it; wider than what Spark trims.
SPACES = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"


def _accented() -> tuple[str, str]:
    """Every character that is one ASCII letter with marks, and these letters."""
    marked, plain = [], []
    for c in map(chr, range(0xC0, sys.maxunicode)):
        if c in LETTERS:
            continue
        parts = unicodedata.normalize("NFD", c)
        if parts == c:
            continue
        bare = "".join(p for p in parts if not unicodedata.category(p).startswith("M"))
        if len(bare) == 1 and bare.isascii() and bare.isalpha():
            marked.append(c)
            plain.append(bare)
    return "".join(marked), "".join(plain)


MARKED, PLAIN = _accented()
LONG_LETTERS = {k: v for k, v in LETTERS.items() if len(v) > 1}
SHORT_FROM = "".join(k for k, v in LETTERS.items() if len(v) == 1)
SHORT_TO = "".join(v for v in LETTERS.values() if len(v) == 1)


def trim(name: Column) -> Column:
    return F.regexp_replace(name, f"^[{SPACES}]+|[{SPACES}]+$", "")


def strip_accents(text: Column) -> Column:
    """Transcribed letters, then letters without their marks."""
    out = F.translate(text, SHORT_FROM + MARKED, SHORT_TO + PLAIN)
    for letter, written in LONG_LETTERS.items():
        out = F.replace(out, F.lit(letter), F.lit(written))
    return F.regexp_replace(out, r"\p{M}+", "")


_PARTICLE = "|".join(sorted(PARTICLES, key=len, reverse=True))
_SPLIT = f"(?is)^({_PARTICLE}) (.*[^{SPACES}].*)$"


def prefix_of(name: Column) -> Column:
    """The particle, in lower case, or an empty string."""
    return F.lower(F.regexp_extract(trim(name), _SPLIT, 1))


def core_of(name: Column) -> Column:
    """The name after its particle."""
    cleaned = trim(name)
    return F.when(cleaned.rlike(_SPLIT), trim(F.regexp_extract(cleaned, _SPLIT, 2))).otherwise(cleaned)


def normalize(name: Column, keep_prefix: bool = False) -> Column:
    """The comparison form: only a to z. Null gives an empty string."""
    base = core_of(name)
    if keep_prefix:
        base = F.when(prefix_of(name) != "", F.concat(prefix_of(name), F.lit(" "), base)).otherwise(base)
    return F.coalesce(F.regexp_replace(F.lower(strip_accents(base)), "[^a-z]", ""), F.lit(""))


def skeleton_of(norm: Column) -> Column:
    """The skeleton of a comparison form."""
    for pattern, by in SKELETON:
        norm = F.regexp_replace(norm, pattern, by)
    return F.regexp_replace(norm, r"(.)\1+", "$1")


def skeleton(name: Column) -> Column:
    return skeleton_of(normalize(name))


def cologne_of(norm: Column) -> Column:
    """The Cologne phonetics code of a comparison form."""

    def code(x: Column, i: Column) -> Column:
        before = F.substr(norm, i, F.lit(1))  # i counts from 0
        after = F.substr(norm, i + 2, F.lit(1))
        at_start = i == 0
        among = lambda c, letters: c.isin(*letters)
        c_code = (
            F.when(at_start, F.when(among(after, "ahkloqrux"), "4").otherwise("8"))
            .when(among(before, "sz"), "8")
            .when(among(after, "ahkoqux"), "4")
            .otherwise("8")
        )
        return (
            F.when(among(x, "aeijouy"), "0")
            .when(x == "b", "1")
            .when(x == "p", F.when(after == "h", "3").otherwise("1"))
            .when(among(x, "dt"), F.when(among(after, "csz"), "8").otherwise("2"))
            .when(among(x, "fvw"), "3")
            .when(among(x, "gkq"), "4")
            .when(x == "c", c_code)
            .when(x == "x", F.when(~at_start & among(before, "ckq"), "8").otherwise("48"))
            .when(x == "l", "5")
            .when(among(x, "mn"), "6")
            .when(x == "r", "7")
            .when(among(x, "sz"), "8")
            .otherwise("")
        )

    letters = F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, ""))
    digits = F.regexp_replace(F.array_join(F.transform(letters, code), ""), r"(.)\1+", "$1")
    return F.concat(F.substring(digits, 1, 1), F.replace(F.substr(digits, F.lit(2)), F.lit("0"), F.lit("")))


def cologne(name: Column) -> Column:
    """The Cologne code of a name; its comparison form is bound once, as code of a letter's lambda would compute it per letter."""
    return F.get(F.transform(F.array(normalize(name)), cologne_of), 0)


# Letter groups that are spelled as one.
_GROUPS = r"(?isu)(sch|ch|ck|tz|ie|ei|eu|äu|ue|oe|ae|.)"


def spell_out(name: Column) -> Column:
    """The groups in which a name is spelled on the phone."""
    return F.regexp_extract_all(trim(F.coalesce(name, F.lit(""))), F.lit(_GROUPS), 1)


# --- the same in DuckDB's SQL, for oracles


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def transcribe_sql(text: str) -> str:
    out = f"translate({text}, {_quote(SHORT_FROM + MARKED)}, {_quote(SHORT_TO + PLAIN)})"
    for letter, written in LONG_LETTERS.items():
        out = f"replace({out}, {_quote(letter)}, {_quote(written)})"
    return out


def strip_accents_sql(text: str) -> str:
    return f"regexp_replace({transcribe_sql(text)}, '\\p{{M}}+', '', 'g')"


def normalize_sql(name: str) -> str:
    """For names without white space other than ASCII."""
    cleaned = f"trim({name}, ' ' || chr(9) || chr(10) || chr(13))"
    split = f"'^({_PARTICLE}) (.*\\S.*)$'"
    core = f"CASE WHEN regexp_matches({cleaned}, {split}, 'is') THEN regexp_extract({cleaned}, {split}, 2, 'is') ELSE {cleaned} END"
    return f"regexp_replace(lower({transcribe_sql(core)}), '[^a-z]', '', 'g')"


def collapse_sql(text: str, letters: str) -> str:
    for c in letters:
        text = f"regexp_replace({text}, '{c}+', '{c}', 'g')"
    return text


def skeleton_sql(norm: str) -> str:
    for pattern, by in SKELETON:
        norm = f"regexp_replace({norm}, '{pattern}', '{by}', 'g')"
    return collapse_sql(norm, "abcdefghijklmnopqrstuvwxyz")


def cologne_sql(norm: str) -> str:
    x, before, after = f"substr({norm}, i, 1)", f"substr({norm}, i - 1, 1)", f"substr({norm}, i + 1, 1)"
    among = lambda c, letters: f"{c} IN ({', '.join(map(_quote, letters))})"
    code = f"""CASE WHEN {among(x, "aeijouy")} THEN '0' WHEN {x} = 'b' THEN '1'
      WHEN {x} = 'p' THEN CASE WHEN {after} = 'h' THEN '3' ELSE '1' END
      WHEN {among(x, "dt")} THEN CASE WHEN {among(after, "csz")} THEN '8' ELSE '2' END
      WHEN {among(x, "fvw")} THEN '3' WHEN {among(x, "gkq")} THEN '4'
      WHEN {x} = 'c' AND i = 1 THEN CASE WHEN {among(after, "ahkloqrux")} THEN '4' ELSE '8' END
      WHEN {x} = 'c' THEN CASE WHEN {among(before, "sz")} THEN '8' WHEN {among(after, "ahkoqux")} THEN '4' ELSE '8' END
      WHEN {x} = 'x' THEN CASE WHEN i > 1 AND {among(before, "ckq")} THEN '8' ELSE '48' END
      WHEN {x} = 'l' THEN '5' WHEN {among(x, "mn")} THEN '6' WHEN {x} = 'r' THEN '7'
      WHEN {among(x, "sz")} THEN '8' ELSE '' END"""
    digits = f"coalesce(array_to_string(list_transform(range(1, length({norm}) + 1), lambda i: {code}), ''), '')"
    flat = collapse_sql(digits, "012345678")
    return f"(substr({flat}, 1, 1) || replace(substr({flat}, 2), '0', ''))"
