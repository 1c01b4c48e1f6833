"""Comorbidity groups and their weighted score (STA-08, AGG-16)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The published groups as code prefixes without dots, by version of the code system (Quan and others, 2005);
# a range stands for every prefix from its first to its last.
GROUPS: dict[str, dict[int, tuple[str, ...]]] = {
    "congestive_heart_failure": {
        10: ("I099", "I110", "I130", "I132", "I255", "I420", "I425-I429", "I43", "I50", "P290"),
        9: ("39891", "40201", "40211", "40291", "40401", "40403", "40411", "40413", "40491", "40493", "4254-4259", "428"),
    },
    "cardiac_arrhythmia": {
        10: ("I441-I443", "I456", "I459", "I47-I49", "R000", "R001", "R008", "T821", "Z450", "Z950"),
        9: ("4260", "42613", "4267", "4269", "42610", "42612", "4270-4274", "4276-4279", "7850", "99601", "99604", "V450", "V533"),
    },
    "valvular_disease": {
        10: ("A520", "I05-I08", "I091", "I098", "I34-I39", "Q230-Q233", "Z952-Z954"),
        9: ("0932", "394-397", "424", "7463-7466", "V422", "V433"),
    },
    "pulmonary_circulation": {10: ("I26", "I27", "I280", "I288", "I289"), 9: ("4150", "4151", "416", "4170", "4178", "4179")},
    "peripheral_vascular": {
        10: ("I70", "I71", "I731", "I738", "I739", "I771", "I790", "I792", "K551", "K558", "K559", "Z958", "Z959"),
        9: ("0930", "4373", "440", "441", "4431-4439", "4471", "5571", "5579", "V434"),
    },
    "hypertension_uncomplicated": {10: ("I10",), 9: ("401",)},
    "hypertension_complicated": {10: ("I11-I13", "I15"), 9: ("402-405",)},
    "paralysis": {
        10: ("G041", "G114", "G801", "G802", "G81", "G82", "G830-G834", "G839"),
        9: ("3341", "342", "343", "3440-3446", "3449"),
    },
    "other_neurological": {
        10: ("G10-G13", "G20-G22", "G254", "G255", "G312", "G318", "G319", "G32", "G35-G37", "G40", "G41", "G931", "G934", "R470", "R56"),
        9: ("3319", "3320", "3321", "3334", "3335", "33392", "334-335", "3362", "340", "341", "345", "3481", "3483", "7803", "7843"),
    },
    "chronic_pulmonary": {
        10: ("I278", "I279", "J40-J47", "J60-J67", "J684", "J701", "J703"),
        9: ("4168", "4169", "490-505", "5064", "5081", "5088"),
    },
    "diabetes_uncomplicated": {
        10: ("E100", "E101", "E109", "E110", "E111", "E119", "E120", "E121", "E129", "E130", "E131", "E139", "E140", "E141", "E149"),
        9: ("2500-2503",),
    },
    "diabetes_complicated": {10: ("E102-E108", "E112-E118", "E122-E128", "E132-E138", "E142-E148"), 9: ("2504-2509",)},
    "hypothyroidism": {10: ("E00-E03", "E890"), 9: ("2409", "243", "244", "2461", "2468")},
    "renal_failure": {
        10: ("I120", "I131", "N18", "N19", "N250", "Z490-Z492", "Z940", "Z992"),
        9: ("40301", "40311", "40391", "40402", "40403", "40412", "40413", "40492", "40493", "585", "586", "5880", "V420", "V451", "V56"),
    },
    "liver_disease": {
        10: ("B18", "I85", "I864", "I982", "K70", "K711", "K713-K715", "K717", "K72-K74", "K760", "K762-K769", "Z944"),
        9: (
            "07022", "07023", "07032", "07033", "07044", "07054", "0706", "0709", "4560-4562", "570", "571", "5722-5728", "5733", "5734", "5738", "5739", "V427",
        ),
    },
    "peptic_ulcer": {
        10: ("K257", "K259", "K267", "K269", "K277", "K279", "K287", "K289"),
        9: ("5317", "5319", "5327", "5329", "5337", "5339", "5347", "5349"),
    },
    "aids": {10: ("B20-B22", "B24"), 9: ("042-044",)},
    "lymphoma": {10: ("C81-C85", "C88", "C96", "C900", "C902"), 9: ("200-202", "2030", "2386")},
    "metastatic_cancer": {10: ("C77-C80",), 9: ("196-199",)},
    "solid_tumor": {10: ("C00-C26", "C30-C34", "C37-C41", "C43", "C45-C58", "C60-C76", "C97"), 9: ("140-172", "174-195")},
    "rheumatoid_arthritis": {
        10: ("L940", "L941", "L943", "M05", "M06", "M08", "M120", "M123", "M30", "M310-M313", "M32-M35", "M45", "M461", "M468", "M469"),
        9: ("446", "7010", "7100-7104", "7108", "7109", "7112", "714", "7193", "720", "725", "7285", "72889", "72930"),
    },
    "coagulopathy": {10: ("D65-D68", "D691", "D693-D696"), 9: ("286", "2871", "2873-2875")},
    "obesity": {10: ("E66",), 9: ("2780",)},
    "weight_loss": {10: ("E40-E46", "R634", "R64"), 9: ("260-263", "7832", "7994")},
    "fluid_electrolyte": {10: ("E222", "E86", "E87"), 9: ("2536", "276")},
    "blood_loss_anemia": {10: ("D500",), 9: ("2800",)},
    "deficiency_anemia": {10: ("D508", "D509", "D51-D53"), 9: ("2801-2809", "281")},
    "alcohol_abuse": {
        10: ("F10", "E52", "G621", "I426", "K292", "K700", "K703", "K709", "T51", "Z502", "Z714", "Z721"),
        9: ("2652", "2911-2913", "2915-2919", "3030", "3039", "3050", "3575", "4255", "5353", "5710-5713", "980", "V113"),
    },
    "drug_abuse": {10: ("F11-F16", "F18", "F19", "Z715", "Z722"), 9: ("292", "304", "3052-3059", "V6542")},
    "psychoses": {10: ("F20", "F22-F25", "F28", "F29", "F302", "F312", "F315"), 9: ("2938", "295", "29604", "29614", "29644", "29654", "297", "298")},
    "depression": {10: ("F204", "F313-F315", "F32", "F33", "F341", "F412", "F432"), 9: ("2962", "2963", "2965", "3004", "309", "311")},
}
# The published weights (van Walraven and others, 2009); other groups weigh nothing.
WEIGHTS = {
    "congestive_heart_failure": 7,
    "cardiac_arrhythmia": 5,
    "valvular_disease": -1,
    "pulmonary_circulation": 4,
    "peripheral_vascular": 2,
    "paralysis": 7,
    "other_neurological": 6,
    "chronic_pulmonary": 3,
    "renal_failure": 5,
    "liver_disease": 11,
    "lymphoma": 9,
    "metastatic_cancer": 12,
    "solid_tumor": 4,
    "coagulopathy": 3,
    "obesity": -4,
    "weight_loss": 6,
    "fluid_electrolyte": 5,
    "blood_loss_anemia": -2,
    "deficiency_anemia": -2,
    "drug_abuse": -7,
    "depression": -3,
}
# A milder group doesn't count beside the graver one.
GRAVER = {
    "hypertension_uncomplicated": "hypertension_complicated",
    "diabetes_uncomplicated": "diabetes_complicated",
    "solid_tumor": "metastatic_cancer",
}


def expanded(prefixes: tuple[str, ...]) -> list[str]:
    """The single prefixes of a group: a range is counted up in its last digits."""
    out = []
    for told in prefixes:
        first, _, last = told.partition("-")
        letters, digits = re.fullmatch(r"([A-Z]*)(\d+)", first).groups()
        end = int(re.fullmatch(r"[A-Z]*(\d+)", last or first).group(1))
        out += [f"{letters}{n:0{len(digits)}d}" for n in range(int(digits), end + 1)]
    return out


def comorbidity_scores(admissions: DataFrame, diagnoses: DataFrame, groups: dict = GROUPS, weights: dict = WEIGHTS, graver: dict = GRAVER) -> DataFrame:
    """hadm_id, n_groups, groups (sorted, joined by bars) and score of every admission, 0 without any group.

    Codes are compared without blanks, dots and case. A group counts once for each version of the
    code system in the score, and once in n_groups. The prefixes are a few hundred rows by the table above,
    so they are broadcast; codes meet them by their beginnings of three, four and five characters.
    """
    rows = [(v, p, g) for g, by_version in groups.items() for v, prefixes in by_version.items() for p in expanded(prefixes)]
    rules = diagnoses.sparkSession.createDataFrame(rows, "icd_version int, prefix string, grp string")
    code = F.upper(F.replace(F.trim("icd_code"), F.lit("."), F.lit("")))
    each = diagnoses.select("hadm_id", F.col("icd_version").cast("int"), code.alias("code")).where("hadm_id is not null and length(code) >= 3")
    each = each.select("hadm_id", "icd_version", F.explode(F.array_distinct(F.transform(F.array(*map(F.lit, (3, 4, 5))), lambda n: F.substring("code", F.lit(1), n)))).alias("prefix"))
    found = each.join(F.broadcast(rules), ["icd_version", "prefix"]).groupBy("hadm_id", "icd_version").agg(F.collect_set("grp").alias("g"))
    for mild, grave in graver.items():
        found = found.withColumn("g", F.when(F.array_contains("g", grave), F.array_remove("g", mild)).otherwise(F.col("g")))
    weight = F.create_map(*[F.lit(x) for item in weights.items() for x in item])
    score = F.aggregate(F.transform("g", lambda x: F.coalesce(F.try_element_at(weight, x), F.lit(0))), F.lit(0), lambda a, x: a + x)
    each = found.select("hadm_id", "g", score.alias("s")).groupBy("hadm_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("g")))).alias("g"), F.sum("s").alias("score"))
    told = each.select("hadm_id", F.size("g").cast("long").alias("n_groups"), F.array_join("g", "|").alias("groups"), F.col("score").cast("long"))
    return admissions.select("hadm_id").join(told, "hadm_id", "left").fillna(0, ["n_groups", "score"]).fillna("", ["groups"])
