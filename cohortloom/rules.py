"""Code-category rules as data."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CodeRule:
    """Codes of one version that begin with one of the prefixes, equal one of the whole codes or are LIKE one of the patterns."""

    prefixes: tuple[str, ...] = ()
    codes: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()


# Categories of psychiatric diagnosis codes, by version of the code system.
CATEGORY_RULES: dict[str, dict[int, CodeRule]] = {
    "psychotic": {
        10: CodeRule(("F20", "F21", "F22", "F23", "F24", "F25", "F28", "F29")),
        9: CodeRule(("295", "297", "298"), ("V110",)),
    },
    "substance_related": {
        10: CodeRule(("F10", "F11", "F12", "F13", "F14", "F15", "F16", "F17", "F18", "F19")),
        9: CodeRule(("291", "292", "303", "304", "305"), ("V113",)),
    },
    "internalizing": {
        10: CodeRule(("F30", "F31", "F32", "F33", "F34", "F38", "F39", "F40", "F41", "F42", "F43", "F44", "F45", "F48", "F50")),
        9: CodeRule(("296", "300", "306", "308", "309", "3071", "3132"), ("311", "3130", "3131", "V111", "V112", "V114")),
    },
    "personality_behavioral": {
        10: CodeRule(("F60", "F61", "F62", "F63", "F64", "F65", "F66", "F68", "F69", "F51", "F52", "F53", "F54", "F55", "F59")),
        9: CodeRule(("301", "302", "3070", "3073", "3074", "3075", "3076", "3077", "3078", "3079", "312", "3133", "3138"), ("3139",)),
    },
    "neurodevelopmental": {
        10: CodeRule(("F70", "F71", "F72", "F73", "F78", "F79", "F80", "F81", "F82", "F83", "F84", "F88", "F89", "F90", "F91", "F92", "F93", "F94", "F95", "F98")),
        9: CodeRule(("299", "3072", "314", "315", "317", "318", "319")),
    },
    "neurocognitive": {
        10: CodeRule(("F01", "F02", "F03")),
        9: CodeRule(("290", "2941", "2942"), ("2948", "2949")),
    },
}
SELF_HARM_TITLES = ("suicid", "self-harm", "self harm", "intentional self")
# Organ damage by alcohol, and titles of poisoning and the like.
GREY_CODES = {
    9: ("3575", "4255", "53530", "53531", "5710", "5711", "5712", "5713"),
    10: (
        "G621", "G721", "I426", "K292", "K2920", "K2921", "K70", "K700", "K701", "K7010", "K7011", "K702", "K703", "K7030", "K7031", "K704", "K7040", "K7041",
        "K709", "K860",
    ),
}
GREY_TITLES = ("poisoning", "overdose", "toxic effect", "drug-induced", "medication-induced", "withdrawal", "intoxication")
CATEGORIES = [*CATEGORY_RULES, "suicide_self_harm", "other"]
FOCUS = ["internalizing", "substance_related", "psychotic", "personality_behavioral"]

# Narrower lists of psychosis codes, and the rule that looks for titles that the wide list lacks.
PSYCHOSIS_EXTENDED = {
    10: CodeRule(
        ("F20", "F22", "F23", "F24", "F25", "F28", "F29", "F060", "F061", "F062", "F531"),
        (
            "F0152", "F01A2", "F01B2", "F01C2", "F0282", "F02A2", "F02B2", "F02C2", "F0392", "F03A2", "F03B2", "F03C2", "F302", "F312", "F315", "F3164",
            "F323", "F333",
        ),
        ("F10%5%", "F11%5%", "F12%5%", "F13%5%", "F14%5%", "F15%5%", "F16%5%", "F17%5%", "F18%5%", "F19%5%"),
    ),
    9: CodeRule(
        ("295",),
        (
            "2971", "2973", "2980", "2981", "2984", "2988", "2989", "29012", "29020", "29042", "29381", "29382", "29211", "29212", "2913", "2915", "29604",
            "29614", "29624", "29634", "29644", "29654", "29664", "V110", "2908", "2909",
        ),
    ),
}
PSYCHOSIS_RESTRICTED = {
    10: CodeRule(("F20", "F22", "F23", "F24", "F25", "F28", "F29", "F531"), ("F302", "F312", "F315", "F3164", "F323", "F333")),
    9: CodeRule(
        ("295",),
        ("2971", "2973", "2980", "2981", "2988", "2989", "2984", "29604", "29614", "29624", "29634", "29644", "29654", "29664", "V110"),
    ),
}
PSYCHOSIS_SEEN = {
    10: CodeRule(
        ("F20", "F22", "F23", "F24", "F25", "F28", "F29", "F060", "F061", "F062", "F531"),
        patterns=("F10%5%", "F11%5%", "F12%5%", "F13%5%", "F14%5%", "F15%5%", "F16%5%", "F17%5%", "F18%5%", "F19%5%"),
    ),
    9: CodeRule(("295", "6484"), ("2971", "2973", "2988", "2989", "29381", "29382", "29211", "29212")),
}
PSYCHOSIS_TITLES = ("psycho", "schizo", "delusion")


def any_of(tests: list[Column]) -> Column:
    """Whether any test holds; a null test counts as not held."""
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(False))


def title_has(title: Column, needles: tuple[str, ...]) -> Column:
    """Whether a title contains one of the needles, whatever its case. One pattern keeps the plan small."""
    return F.coalesce(F.lower(title).rlike("|".join(needles)), F.lit(False))


def by_version(version: Column, code: Column, rules: dict[int, CodeRule]) -> Column:
    """Whether a code meets the rule of its version (FLT-01, FLT-02, FLT-05)."""
    tests = []
    for number, rule in rules.items():
        own = [code.rlike(f"^(?:{'|'.join(rule.prefixes)})")] if rule.prefixes else []
        own += [code.isin(*rule.codes)] if rule.codes else []
        tests.append((version == number) & any_of([*own, *[code.like(p) for p in rule.patterns]]))
    return any_of(tests)


def is_psychiatric(version: Column, code: Column, title: Column) -> Column:
    """COH-01: a code of the psychiatric chapters, or a title of self-harm."""
    in_chapter = ((version == 10) & code.startswith("F")) | (
        (version == 9) & (code.rlike(r"^(29[0-9]|30[0-9]|31[0-9])") | code.startswith("V11"))
    )
    return any_of([in_chapter, title_has(title, SELF_HARM_TITLES)])


def is_listed_grey(version: Column, code: Column) -> Column:
    """The listed part of COH-03."""
    return any_of([(version == v) & code.isin(*codes) for v, codes in GREY_CODES.items()])
