"""Rules on invented names, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words too general to tell a name, drug name stems, consonant pairs that are easy to say.
GENERIC = ("syndrome", "disease", "disorder", "fever", "anemia")
SUFFIX_STEMS = ("ase", "lol", "fil", "pam")
STEMS = (
    "vastin", "sartan", "pril", "olol", "dipine", "gliflozin", "prazole", "tinib", "mab", "ciclib", "azepam", "zolam", "oxacin", "mycin", "cillin", "conazole",
    "tide", "parin", "xaban", "gatran", "dronate", "thiazide", "semide", "setron", "triptan", "tropium", "terol", "lukast", "afil", "profen", "oxetine", "apine", "idone",
    "grel", "vir", "stat", "nib", "caine", "relin", "platin", "taxel", "rubicin", "vudine", "azole", "sone", "olone", "cort", "zide", "umab", "ximab", "zumab", "kinase",
)
CLUSTERS = ("br", "dr", "tr", "gr", "kr", "pl", "bl", "st", "sp", "nd", "nt", "rv", "lv")


def distinctive_token(name: Column) -> Column:
    """The first run of three letters or more that isn't a general word, in lower case; else the whole name."""
    runs = F.regexp_extract_all(F.lower(name), F.lit("[a-z]+"), 0)
    return F.coalesce(F.get(F.filter(runs, lambda t: (F.length(t) >= 3) & ~t.isin(*GENERIC)), F.lit(0)), F.lower(F.trim(name)))


def has_stem(name: Column, drug: bool = True) -> Column:
    """Whether a stem is in the name, or a short one (for drugs also ine) at its end."""
    ends = "|".join(SUFFIX_STEMS + (("ine",) if drug else ()))
    return F.lower(F.trim(name)).rlike(f"{'|'.join(STEMS)}|({ends})$")


def pronounceable(token: Column) -> Column:
    """Six to ten letters with two to four groups of vowels, consonants alone but for one easy pair at most."""
    t = F.lower(F.trim(token))
    pair, one = f"({'|'.join(CLUSTERS)})", "[b-df-hj-np-tv-xz]"
    runs = F.regexp_extract_all(t, F.lit("[b-df-hj-np-tv-xz]{2,}"), 0)
    vowels = F.regexp_count(t, F.lit("[aeiouy]+"))
    return t.rlike("^[a-z]{6,10}$") & vowels.between(2, 4) & (F.size(runs) <= 1) & ~t.rlike(f"{one}{{3}}") & ((F.size(runs) == 0) | F.coalesce(F.get(runs, F.lit(0)).rlike(f"^{pair}$"), F.lit(False)))
