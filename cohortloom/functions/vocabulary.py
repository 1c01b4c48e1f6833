"""Word lists and tables that the text operators read."""

from __future__ import annotations

# Headings of discharge notes, in lower case without their colon, and the section each opens.
SECTION_OF = {
    "cc": "chief_complaint",
    "chief complaint": "chief_complaint",
    "major surgical or invasive procedure": "major_surgical_or_invasive_procedure",
    "major surgical or invasive procedures": "major_surgical_or_invasive_procedure",
    "present illness": "present_illness",
    "history of present illness": "present_illness",
    "hpi": "present_illness",
    "medical history": "medical_history",
    "past medical history": "medical_history",
    "pmh": "medical_history",
    "past psychiatric history": "past_psychiatric_history",
    "psychiatric history": "past_psychiatric_history",
    "medications on admission": "medication_admission",
    "medication on admission": "medication_admission",
    "admission medications": "medication_admission",
    "allergies": "allergies",
    "review of systems": "review_of_systems",
    "ros": "review_of_systems",
    "admission physical": "physical_exam",
    "admission physical exam": "physical_exam",
    "physical exam": "physical_exam",
    "pe": "physical_exam",
    "physical examination": "physical_exam",
    "physical exam on discharge": "physical_exam",
    "discharge physical": "physical_exam",
    "discharge physical exam": "physical_exam",
    "family history": "family_history",
    "social history": "social_history",
    "personal and social history": "social_history",
    "problems": "problems",
    "pertinent results": "pertinent_results",
    "admission labs": "pertinent_results",
    "pertinent labs": "pertinent_results",
    "micro": "pertinent_results",
    "microbiology": "pertinent_results",
    "imaging": "pertinent_results",
    "imaging/other studies": "pertinent_results",
    "imaging and other studies": "pertinent_results",
    "labs on discharge": "pertinent_results",
    "discharge labs": "pertinent_results",
    "brief hospital course": "brief_hospital_course",
    "hospital course": "brief_hospital_course",
    "acute issues": "problems",
    "chronic issues": "problems",
    "plan/transitional issues": "problems",
    "transitional issues": "problems",
    "discharge medications": "discharge_medications",
    "discharge medication": "discharge_medications",
    "discharge disposition": "discharge_disposition",
    "discharge diagnosis": "discharge_diagnosis",
    "discharge diagnoses": "discharge_diagnosis",
    "primary diagnosis": "discharge_diagnosis",
    "primary diagnoses": "discharge_diagnosis",
    "secondary diagnosis": "discharge_diagnosis",
    "secondary diagnoses": "discharge_diagnosis",
    "discharge condition": "discharge_condition",
    "discharge instructions": "discharge_instructions",
    "followup instructions": "discharge_instructions",
    "follow-up instructions": "discharge_instructions",
}

# Fixed value: a line that may be a heading: its name, a colon, the rest.
HEADING_LINE = r"^\s*([A-Za-z][A-Za-z0-9/_&,\-() ]{1,90}|[A-Z]{2,12})\s*:\s*(.*)$"
# Fixed value: a line in capitals that the pattern above leaves out.
CAPITAL_LINE = r"^\s*([A-Z][A-Z0-9 /_&,\-()]{1,90})\s*:\s*"
# Fixed value: the chief complaint, up to the next line that looks like a heading.
CHIEF_COMPLAINT = r"(?i)(?:chief complaint:)([\s\S]+?)(?:\n\s*(?:(?:hpi|[A-Z][A-Za-z]{4,}(?:[ \t]+(?:[A-Za-z]{2,}|_+)){0,8})[ \t]*:)|\z)"

# What tells headings of sections from other lines with a colon.
NO_SECTION = [
    "date of birth", "sex", "service", "unit", "phone", "fax", "provider", "attending", "dictated by", "completed by", "signed electronically",
    "level of consciousness", "mental status", "temperature", "heart rate", "blood pressure", "respiratory rate", "oxygen saturation", r"\bsat\b",
    r"\bpulse\b", "vitals?", r"\bdp right\b", r"\bdp left\b", r"\bpt right\b", r"\bpt left\b",
]
LIKELY_SECTION = [
    "admission", "assessment", "course", "diagnos", "exam", "history", "hospital", "imaging", "impression", "instruction", "issue", "lab", "medication",
    "micro", "plan", "procedure", "problem", "result", "social", "study",
]

# Words of psychiatric context by group. The matches of every pattern count on their own.
KEYWORDS = {
    "psychosis_schizophrenia": [r"schizophren\w*", "schizoaffective", "psychosis", "psychotic", "paranoid schizophrenia"],
    "bipolar_mania": ["bipolar", "mania", "manic"],
    "psychiatry_general": [r"psychiatr\w*", "mental health", "behavioral health", "psych history", "psych hx", "psychiatric history"],
    "common_psych_meds": [
        "haloperidol", "haldol", "risperidone", "risperdal", "olanzapine", "zyprexa", "quetiapine", "seroquel", "clozapine", "clozaril", "aripiprazole",
        "abilify", "ziprasidone", "geodon", "paliperidone", "invega", "fluphenazine", "perphenazine", "chlorpromazine", "thorazine", "lurasidone", "latuda",
    ],
    "other_psych_conditions": ["depression", "depressive", "anxiety", "ptsd", "personality disorder", r"suicid\w*", "self harm"],
    "substance_use": ["alcohol use", "substance use", "substance abuse", "cocaine", "opioid", "heroin", "marijuana", "cannabis", "etoh"],
    "cognitive_behavioral": [
        "delirium", "dementia", "altered mental status", "agitation", "confusion", "confused", "somatization", "somatizing", r"somatize\w*",
        r"somatic symptom\w*", r"somatic complaint\w*", "somatoform", "psychosomatic", "conversion disorder", r"functional neurologic\w*",
        "functional neurological disorder", r"medically unexplained symptom\w*", "hypochondriasis", "illness anxiety",
    ],
}
# Stigmatising words by group, each with the root it is reported under.
STIGMA_ROOTS = {
    "adamant": {
        "adamant": "adamant",
        "adamantly": "adamant",
        "adament": "adamant",
        "adamently": "adamant",
        "allegedly": "allegedly",
        "claim": "claim",
        "claimed": "claim",
        "claiming": "claim",
        "claims": "claim",
        r"inconsistent\s+historian": "inconsistent historian",
        "insist": "insist",
        "insisted": "insist",
        "insistence": "insist",
        "insisting": "insist",
        "insists": "insist",
        "purportedly": "purportedly",
        "questionable": "questionable",
        "reportedly": "reportedly",
        "supposedly": "supposedly",
        r"unreliable\s+historian": "unreliable historian",
    },
    "compliance": {
        "declined": "decline",
        "declines": "decline",
        "declining": "decline",
        "nonadherance": "nonadherence",
        "nonadherence": "nonadherence",
        "nonadherent": "nonadherence",
        "noncompliance": "noncompliance",
        "noncompliant": "noncompliance",
        "refusal": "refuse",
        "refuse": "refuse",
        "refused": "refuse",
        "refuses": "refuse",
        "refusing": "refuse",
    },
    "other": {
        "aggression": "aggressive",
        "aggressive": "aggressive",
        "aggressively": "aggressive",
        "agitated": "agitation",
        "agitation": "agitation",
        "anger": "angry",
        "angered": "angry",
        "angers": "angry",
        "angrier": "angry",
        "angrily": "angry",
        "angry": "angry",
        "argumentative": "argumentative",
        "argumentatively": "argumentative",
        "belligerence": "belligerent",
        "belligerent": "belligerent",
        "belligerently": "belligerent",
        "combative": "combative",
        "combatively": "combative",
        "confrontational": "confrontational",
        "defensive": "defensive",
        r"difficult\s+patient": "difficult patient",
        "disheveled": "disheveled",
        r"drug[\s-]+seeking": "drug seeking",
        "exaggerate": "exaggerate",
        "exaggerates": "exaggerate",
        "exaggerating": "exaggerate",
        "fake": "fake",
        "fakes": "fake",
        "faking": "fake",
        "homeless": "homeless",
        "homelessness": "homeless",
        r"in\s+denial": "in denial",
        "malinger": "malinger",
        "malingered": "malinger",
        "malingerer": "malinger",
        "malingering": "malinger",
        "malingers": "malinger",
        r"narcotic[\s-]+seeking": "narcotic seeking",
        r"poorly[\s-]+groomed": "poorly groomed",
        r"poor\s+historian": "poor historian",
        r"secondary\s+gain": "secondary gain",
        "uncooperative": "uncooperative",
        "unkempt": "unkempt",
        "unmotivated": "unmotivated",
        "unwilling": "unwilling",
        "unwillingly": "unwilling",
    },
}
STIGMA = {group: list(roots) for group, roots in STIGMA_ROOTS.items()}

# Shorthand of complaints.
SHORTHAND = {
    "abd": "abdominal",
    "ams": "altered mental status",
    "brbpr": "bright red blood per rectum",
    "cp": "chest pain",
    "cva": "stroke",
    "doe": "dyspnea on exertion",
    "etoh": "alcohol",
    "fx": "fracture",
    "gi": "gastrointestinal",
    "gi bleed": "gastrointestinal bleed",
    "gib": "gastrointestinal bleed",
    "ha": "headache",
    "lle": "left lower extremity",
    "llq": "left lower quadrant",
    "loc": "loss of consciousness",
    "lue": "left upper extremity",
    "luq": "left upper quadrant",
    "mva": "motor vehicle collision",
    "mvc": "motor vehicle collision",
    "n/v": "nausea vomiting",
    "n/v/d": "nausea vomiting diarrhea",
    "pna": "pneumonia",
    "rle": "right lower extremity",
    "rlq": "right lower quadrant",
    "rue": "right upper extremity",
    "ruq": "right upper quadrant",
    "sob": "shortness of breath",
    "uti": "urinary tract infection",
}
# Contractions and what they stand for.
CONTRACTIONS = {
    r"\bdon['’]?t\b": "do not",
    r"\bdoesn['’]?t\b": "does not",
    r"\bdidn['’]?t\b": "did not",
    r"\bcan['’]?t\b": "cannot",
    r"\bwon['’]?t\b": "will not",
    r"\bisn['’]?t\b": "is not",
    r"\baren['’]?t\b": "are not",
    r"\bwasn['’]?t\b": "was not",
    r"\bweren['’]?t\b": "were not",
}
# Administrative beginnings of complaints.
PREFIXES = [
    r"\s*(?:cc|chief complaint|pcp|primary care provider|provider|referring provider)\s*:\s*",
    r"\s*(?:admit(?:ted)?\s+for|admission\s+for)\s+",
    r"\s*(?:s/p|status post)\s+",
    r"\s*major\s+(?:surgical\s+)?or\s+invasive\s+procedure\s*:\s*",
]
# The shorter list of beginnings that are taken off once to see whether a complaint is a placeholder.
SCREEN_PREFIXES = [r"^\s*(?:cc|chief complaint)\s*:\s*", r"^\s*(?:admit(?:ted)?\s+for|admission\s+for)\s+", r"^\s*(?:s/p|status post)\s+"]
MISSING = ["", "none", "nan", "null", "na", "n/a", "unknown", "?"]

# Concepts of mental health, substances and self-harm, with the words that name them.
CONCEPTS = {
    "anxiety": ["anxiety", "panic attack", "panic"],
    "depression": ["depression", "depressed"],
    "hallucinations": ["hallucinations", "hallucination", "auditory hallucinations", "visual hallucinations", "hearing voices", "seeing things"],
    "homicidal_ideation": ["homicidal ideation", "homicidal", "hi"],
    "intoxication": ["intoxication", "intoxicated", "alcohol intoxication", "etoh intoxication"],
    "overdose_ingestion": ["overdose", "od", "ingestion", "intentional ingestion"],
    "psychosis": [
        "psychiatric", "psychiatric complaint", "psychiatric evaluation", "psychiatric problem", "psych eval", "psych evaluation", "psych complaint",
        "psychosis", "psychotic", "paranoia", "paranoid", "delusions", "delusional", "schizophrenia", "schizophrenic", "schizoaffective",
        "schizoaffective disorder", "paranoid schizophrenia",
    ],
    "substance_use": ["alcohol", "etoh", "cocaine", "heroin", "opioid", "opiate", "substance use", "drug use", "withdrawal"],
    "suicidal_ideation": ["suicidal ideation", "suicidal", "suicide", "suicidality", "si"],
}
NEGATING_WORDS = ["no", "not", "denies", "denied", "without"]
NEGATING_PHRASES = ["do not", "does not", "did not"]

# Clinical subgroups of complaints: phrases in the complaint and terms of its concepts.
SUBGROUPS = {
    "abdominal_pain": (
        ["abdominal pain", "abd pain", "abdominal discomfort", "abd discomfort", "belly pain"],
        ["abdominal pain", "abdominal discomfort", "abdomen", "abdomen pain"],
    ),
    "shortness_of_breath": (
        ["shortness of breath", "short of breath", "sob", "dyspnea", "difficulty breathing", "trouble breathing"],
        ["shortness of breath", "dyspnea", "breathing difficulty", "difficulty breathing", "sob"],
    ),
    "chest_pain": (["chest pain", "cp", "chest discomfort", "chest pressure"], ["chest pain", "chest discomfort", "chest pressure"]),
    "altered_mental_status": (
        ["altered mental status", "mental status", "altered mental", "ams", "confusion", "confused"],
        ["altered mental status", "mental status", "confusion", "confused", "disorientation"],
    ),
    "nausea_vomiting": (["nausea vomiting", "nausea and vomiting", "nausea", "vomiting", "emesis"], ["nausea", "vomiting", "emesis"]),
}
COMBINED_SUBGROUPS = {
    "abdominal_pain_nausea_vomiting": ["abdominal_pain", "nausea_vomiting"],
    "chest_pain_shortness_of_breath": ["chest_pain", "shortness_of_breath"],
}
OVERLAPS = {"fever": (["fever", "fevers", "febrile"], ["fever", "febrile"]), "altered_mental_status": SUBGROUPS["altered_mental_status"]}

# Single words that may be a parent phrase by themselves.
PARENT_WORDS = ["fall", "fever", "fracture", "seizure", "syncope", "trauma"]

# What a classifier may answer.
CONTEXT_LABELS = ["positive", "negative"]
MENTION_TYPES = [
    "current_context", "background_only", "medication_only", "diagnosis_list_only", "negated_only", "family_history_only", "none", "symptom_attribution",
    "diagnostic_reasoning", "management", "disposition_or_capacity", "behavior_or_reliability", "care_interference", "active_psychiatric_course",
    "disproportionate_detail", "incidental_history", "negated_or_irrelevant",
]
