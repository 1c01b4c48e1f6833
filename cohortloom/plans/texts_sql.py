"""SQL of the text queries. Its lists are written out here on their own, not taken from the library."""

from __future__ import annotations

_S = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_N = r"[^\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_S}+', ' ', 'g'))"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


def _words(x: str) -> str:
    return f"coalesce(len(regexp_extract_all({x}, '{_N}+')), 0)"


def _terms(x: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({x}, ''), '|'), lambda x: trim(x)), lambda x: x <> '')"


def _stripped(x: str) -> str:
    return f"list_filter(list_transform({x}, lambda x: {_strip('x')}), lambda x: x <> '')"


_NOTES = "notes as (select distinct note_id, text from export_mhh_psychotic)"

# group and pattern of the words of psychiatric context
_PSYCH = r"""psych(g, p) as (values
  ('psychosis_schizophrenia', 'schizophren\w*'), ('psychosis_schizophrenia', 'schizoaffective'), ('psychosis_schizophrenia', 'psychosis'),
  ('psychosis_schizophrenia', 'psychotic'), ('psychosis_schizophrenia', 'paranoid schizophrenia'),
  ('bipolar_mania', 'bipolar'), ('bipolar_mania', 'mania'), ('bipolar_mania', 'manic'),
  ('psychiatry_general', 'psychiatr\w*'), ('psychiatry_general', 'mental health'), ('psychiatry_general', 'behavioral health'),
  ('psychiatry_general', 'psych history'), ('psychiatry_general', 'psych hx'), ('psychiatry_general', 'psychiatric history'),
  ('common_psych_meds', 'haloperidol'), ('common_psych_meds', 'haldol'), ('common_psych_meds', 'risperidone'), ('common_psych_meds', 'risperdal'),
  ('common_psych_meds', 'olanzapine'), ('common_psych_meds', 'zyprexa'), ('common_psych_meds', 'quetiapine'), ('common_psych_meds', 'seroquel'),
  ('common_psych_meds', 'clozapine'), ('common_psych_meds', 'clozaril'), ('common_psych_meds', 'aripiprazole'), ('common_psych_meds', 'abilify'),
  ('common_psych_meds', 'ziprasidone'), ('common_psych_meds', 'geodon'), ('common_psych_meds', 'paliperidone'), ('common_psych_meds', 'invega'),
  ('common_psych_meds', 'fluphenazine'), ('common_psych_meds', 'perphenazine'), ('common_psych_meds', 'chlorpromazine'), ('common_psych_meds', 'thorazine'),
  ('common_psych_meds', 'lurasidone'), ('common_psych_meds', 'latuda'),
  ('other_psych_conditions', 'depression'), ('other_psych_conditions', 'depressive'), ('other_psych_conditions', 'anxiety'),
  ('other_psych_conditions', 'ptsd'), ('other_psych_conditions', 'personality disorder'), ('other_psych_conditions', 'suicid\w*'),
  ('other_psych_conditions', 'self harm'),
  ('substance_use', 'alcohol use'), ('substance_use', 'substance use'), ('substance_use', 'substance abuse'), ('substance_use', 'cocaine'),
  ('substance_use', 'opioid'), ('substance_use', 'heroin'), ('substance_use', 'marijuana'), ('substance_use', 'cannabis'), ('substance_use', 'etoh'),
  ('cognitive_behavioral', 'delirium'), ('cognitive_behavioral', 'dementia'), ('cognitive_behavioral', 'altered mental status'),
  ('cognitive_behavioral', 'agitation'), ('cognitive_behavioral', 'confusion'), ('cognitive_behavioral', 'confused'),
  ('cognitive_behavioral', 'somatization'), ('cognitive_behavioral', 'somatizing'), ('cognitive_behavioral', 'somatize\w*'),
  ('cognitive_behavioral', 'somatic symptom\w*'), ('cognitive_behavioral', 'somatic complaint\w*'), ('cognitive_behavioral', 'somatoform'),
  ('cognitive_behavioral', 'psychosomatic'), ('cognitive_behavioral', 'conversion disorder'), ('cognitive_behavioral', 'functional neurologic\w*'),
  ('cognitive_behavioral', 'functional neurological disorder'), ('cognitive_behavioral', 'medically unexplained symptom\w*'),
  ('cognitive_behavioral', 'hypochondriasis'), ('cognitive_behavioral', 'illness anxiety'))"""
_PSYCH_GROUPS = [
    "psychosis_schizophrenia", "bipolar_mania", "psychiatry_general", "common_psych_meds", "other_psych_conditions", "substance_use", "cognitive_behavioral",
]

# number of the group, group, number in the group, pattern and root of the stigmatising words
_STIGMA = r"""words(gn, g, roots) as (values
  (0, 'adamant', 'adamant=adamant;adamantly=adamant;adament=adamant;adamently=adamant;allegedly=allegedly;claim=claim;claimed=claim;claiming=claim;claims=claim;'
    || 'inconsistent\s+historian=inconsistent historian;insist=insist;insisted=insist;insistence=insist;insisting=insist;insists=insist;purportedly=purportedly;'
    || 'questionable=questionable;reportedly=reportedly;supposedly=supposedly;unreliable\s+historian=unreliable historian'),
  (1, 'compliance', 'declined=decline;declines=decline;declining=decline;nonadherance=nonadherence;nonadherence=nonadherence;nonadherent=nonadherence;'
    || 'noncompliance=noncompliance;noncompliant=noncompliance;refusal=refuse;refuse=refuse;refused=refuse;refuses=refuse;refusing=refuse'),
  (2, 'other', 'aggression=aggressive;aggressive=aggressive;aggressively=aggressive;agitated=agitation;agitation=agitation;anger=angry;angered=angry;angers=angry;'
    || 'angrier=angry;angrily=angry;angry=angry;argumentative=argumentative;argumentatively=argumentative;belligerence=belligerent;belligerent=belligerent;'
    || 'belligerently=belligerent;combative=combative;combatively=combative;confrontational=confrontational;defensive=defensive;'
    || 'difficult\s+patient=difficult patient;disheveled=disheveled;drug[\s-]+seeking=drug seeking;exaggerate=exaggerate;exaggerates=exaggerate;'
    || 'exaggerating=exaggerate;fake=fake;fakes=fake;faking=fake;homeless=homeless;homelessness=homeless;in\s+denial=in denial;malinger=malinger;'
    || 'malingered=malinger;malingerer=malinger;malingering=malinger;malingers=malinger;narcotic[\s-]+seeking=narcotic seeking;'
    || 'poorly[\s-]+groomed=poorly groomed;poor\s+historian=poor historian;secondary\s+gain=secondary gain;uncooperative=uncooperative;unkempt=unkempt;'
    || 'unmotivated=unmotivated;unwilling=unwilling;unwillingly=unwilling')),
split_words as (select gn, g, string_split(roots, ';') as l from words),
stigma as (select gn, g, generate_subscripts(l, 1) as pn, split_part(unnest(l), '=', 1) as p, split_part(unnest(l), '=', 2) as root from split_words)"""


def _counted(source: str, key: str, patterns: str, groups: list[str], prefix: str = "") -> str:
    """CTE c: key and the hits of each group in a source's text."""
    sums = ", ".join(f"coalesce(sum(h) filter (where g = '{g}'), 0)::bigint as {prefix}{g}" for g in groups)
    return rf"""h as (select {key}, g, sum(len(regexp_extract_all(text, '(?i)\b(?:' || p || ')\b'))) as h from {source} cross join {patterns}
  where text is not null group by all),
c as (select {key}, {sums} from (select distinct {key} from {source}) left join h using ({key}) group by 1)"""


# heading and section
_ALIASES = """alias(name, section) as (values
  ('cc', 'chief_complaint'), ('chief complaint', 'chief_complaint'), ('major surgical or invasive procedure', 'major_surgical_or_invasive_procedure'),
  ('major surgical or invasive procedures', 'major_surgical_or_invasive_procedure'), ('present illness', 'present_illness'),
  ('history of present illness', 'present_illness'), ('hpi', 'present_illness'), ('medical history', 'medical_history'),
  ('past medical history', 'medical_history'), ('pmh', 'medical_history'), ('past psychiatric history', 'past_psychiatric_history'),
  ('psychiatric history', 'past_psychiatric_history'), ('medications on admission', 'medication_admission'),
  ('medication on admission', 'medication_admission'), ('admission medications', 'medication_admission'), ('allergies', 'allergies'),
  ('review of systems', 'review_of_systems'), ('ros', 'review_of_systems'), ('admission physical', 'physical_exam'),
  ('admission physical exam', 'physical_exam'), ('physical exam', 'physical_exam'), ('pe', 'physical_exam'), ('physical examination', 'physical_exam'),
  ('physical exam on discharge', 'physical_exam'), ('discharge physical', 'physical_exam'), ('discharge physical exam', 'physical_exam'),
  ('family history', 'family_history'), ('social history', 'social_history'), ('personal and social history', 'social_history'),
  ('problems', 'problems'), ('pertinent results', 'pertinent_results'), ('admission labs', 'pertinent_results'), ('pertinent labs', 'pertinent_results'),
  ('micro', 'pertinent_results'), ('microbiology', 'pertinent_results'), ('imaging', 'pertinent_results'), ('imaging/other studies', 'pertinent_results'),
  ('imaging and other studies', 'pertinent_results'), ('labs on discharge', 'pertinent_results'), ('discharge labs', 'pertinent_results'),
  ('brief hospital course', 'brief_hospital_course'), ('hospital course', 'brief_hospital_course'), ('acute issues', 'problems'),
  ('chronic issues', 'problems'), ('plan/transitional issues', 'problems'), ('transitional issues', 'problems'),
  ('discharge medications', 'discharge_medications'), ('discharge medication', 'discharge_medications'), ('discharge disposition', 'discharge_disposition'),
  ('discharge diagnosis', 'discharge_diagnosis'), ('discharge diagnoses', 'discharge_diagnosis'), ('primary diagnosis', 'discharge_diagnosis'),
  ('primary diagnoses', 'discharge_diagnosis'), ('secondary diagnosis', 'discharge_diagnosis'), ('secondary diagnoses', 'discharge_diagnosis'),
  ('discharge condition', 'discharge_condition'), ('discharge instructions', 'discharge_instructions'),
  ('followup instructions', 'discharge_instructions'), ('follow-up instructions', 'discharge_instructions'))"""
_HEAD = r"'^\s*([A-Za-z][A-Za-z0-9/_&,\-() ]{1,90}|[A-Z]{2,12})\s*:\s*(.*)$'"
_NAME = f"trim(replace(lower({_squeeze(f'regexp_extract(line, {_HEAD}, 1)')}), '___', ''))"
_LINES = r"string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10))"
_READ = rf"""{_NOTES}, {_ALIASES},
raw_lines as (select note_id, {_LINES} as l from notes),
numbered as (select note_id, unnest(l) as line, generate_subscripts(l, 1) as i from raw_lines),
named as (select *, {_NAME} as name from numbered),
read as (select n.note_id, n.i, a.section, case when a.section is not null then n.name end as name,
    case when a.section is not null then regexp_extract(n.line, {_HEAD}, 2) else n.line end as rest,
    case when a.section is not null then {_strip(f"regexp_extract(n.line, {_HEAD}, 1)")} end as heading
  from named n left join alias a on a.name = n.name),
blocks as (select *, sum((section is not null)::int) over (partition by note_id order by i) as b from read),
parts as (select note_id, b, min(i) as i, coalesce(max(section), 'unsectioned') as section, coalesce(max(heading), 'unsectioned') as heading,
  coalesce(max(name), 'unsectioned') as name, string_agg(rest, chr(10) order by i) as t from blocks group by 1, 2),
clean as (select * replace (case when regexp_matches(t, '[A-Za-z0-9]') then t else '' end as t) from (select note_id, b, i, section, heading, name,
  {_squeeze(f"regexp_replace(regexp_replace(t, '(^|{_S})_+({_S}|$)', ' ', 'g'), '(^|{_S})_+({_S}|$)', ' ', 'g')")} as t from parts))"""
_SECTIONS = f"""{_READ},
sections as (select note_id, section, min(i) - 1 as position, string_agg(t, ' ' order by b) as text from clean where t <> '' group by 1, 2)"""
_COMPLAINT = r"'(?i)(?:chief complaint:)([\s\S]+?)(?:\n\s*(?:(?:hpi|[A-Z][A-Za-z]{4,}(?:[ \t]+(?:[A-Za-z]{2,}|_+)){0,8})[ \t]*:)|\z)'"

_NO_WORD = r"[^\p{L}\p{N}_]"


def _prepared(column: str) -> str:
    """A complaint in lower case, without placeholders, beginnings and contractions."""
    out = f"regexp_replace(coalesce({column}, ''), '_+', ' ', 'g')"
    begins = (
        r"(?i)^(?:\s*(?:cc|chief complaint|pcp|primary care provider|provider|referring provider)\s*:\s*|\s*(?:admit(?:ted)?\s+for|admission\s+for)\s+"
        r"|\s*(?:s/p|status post)\s+|\s*major\s+(?:surgical\s+)?or\s+invasive\s+procedure\s*:\s*)+"
    )
    out = f"replace(lower(regexp_replace({out}, '{begins}', '')), '&', ' and ')"
    for stem, words in (
        ("don", "do not"), ("doesn", "does not"), ("didn", "did not"), ("can", "cannot"), ("won", "will not"), ("isn", "is not"), ("aren", "are not"),
        ("wasn", "was not"), ("weren", "were not"),
    ):
        mark = "['’]?t" if stem != "can" else "['’]?t"
        out = rf"regexp_replace({out}, '\b{stem}" + mark.replace("'", "''") + rf"\b', '{words}', 'g')"
    return rf"regexp_replace({out}, '\bs\.?\s*/\s*p\.?\b', ' ', 'g')"


# longest forms first, as they are applied
_FORMS = (
    "['gi bleed=gastrointestinal bleed', 'brbpr=bright red blood per rectum', 'n/v/d=nausea vomiting diarrhea', 'etoh=alcohol', 'abd=abdominal', "
    "'ams=altered mental status', 'cva=stroke', 'doe=dyspnea on exertion', 'gib=gastrointestinal bleed', 'lle=left lower extremity', "
    "'llq=left lower quadrant', 'loc=loss of consciousness', 'lue=left upper extremity', 'luq=left upper quadrant', 'mva=motor vehicle collision', "
    "'mvc=motor vehicle collision', 'n/v=nausea vomiting', 'pna=pneumonia', 'rle=right lower extremity', 'rlq=right lower quadrant', "
    "'rue=right upper extremity', 'ruq=right upper quadrant', 'sob=shortness of breath', 'uti=urinary tract infection', 'cp=chest pain', 'fx=fracture', "
    "'gi=gastrointestinal', 'ha=headache']"
)


def _written_out(text: str) -> str:
    once = lambda t: rf"regexp_replace({t}, '(^|{_NO_WORD})' || split_part(x, '=', 1) || '($|{_NO_WORD})', '\1' || split_part(x, '=', 2) || '\2', 'g')"
    both = once(once("acc"))  # neighbours share a bound
    return _squeeze(f"list_reduce(list_concat([{text}], {_FORMS}), lambda acc, x: {both})")


_MISSING = "('', 'none', 'nan', 'null', 'na', 'n/a', 'unknown', '?')"


def _normal(column: str) -> str:
    out = _written_out(_squeeze(rf"regexp_replace({_prepared(column)}, '[^\p{{L}}\p{{N}}_\s/+-]', ' ', 'g')"))
    return f"(select case when t in {_MISSING} then '' else t end from (select {out} as t))"


def _context(column: str) -> str:
    out = _written_out(_squeeze(rf"regexp_replace({_prepared(column)}, '[^\p{{L}}\p{{N}}_\s/+.;:?!-]', ' ', 'g')"))
    out = rf"regexp_replace(regexp_replace({out}, '\s+([.;:?!])', '\1', 'g'), '([.;:?!])', '\1 ', 'g')"
    bare = _squeeze(r"regexp_replace(t, '[^\p{L}\p{N}_\s/+-]', ' ', 'g')")
    return f"(select case when {bare} in {_MISSING} then '' else t end from (select {_squeeze(out)} as t))"


# mentions of concepts: text=concept, longest first
_MENTIONS = (
    "['paranoid schizophrenia=psychosis', 'schizoaffective disorder=psychosis', 'auditory hallucinations=hallucinations', 'psychiatric evaluation=psychosis', "
    "'psychiatric complaint=psychosis', 'intentional ingestion=overdose_ingestion', 'visual hallucinations=hallucinations', 'alcohol intoxication=intoxication', "
    "'psychiatric problem=psychosis', 'homicidal ideation=homicidal_ideation', 'etoh intoxication=intoxication', 'suicidal ideation=suicidal_ideation', "
    "'psych evaluation=psychosis', 'psych complaint=psychosis', 'schizoaffective=psychosis', 'hallucinations=hallucinations', 'hearing voices=hallucinations', "
    "'seeing things=hallucinations', 'hallucination=hallucinations', 'schizophrenic=psychosis', 'schizophrenia=psychosis', 'substance use=substance_use', "
    "'panic attack=anxiety', 'intoxication=intoxication', 'suicidality=suicidal_ideation', 'intoxicated=intoxication', 'psychiatric=psychosis', "
    "'psych eval=psychosis', 'delusional=psychosis', 'depression=depression', 'withdrawal=substance_use', 'homicidal=homicidal_ideation', "
    "'depressed=depression', 'ingestion=overdose_ingestion', 'psychotic=psychosis', 'psychosis=psychosis', 'delusions=psychosis', 'suicidal=suicidal_ideation', "
    "'paranoid=psychosis', 'paranoia=psychosis', 'overdose=overdose_ingestion', 'drug use=substance_use', 'suicide=suicidal_ideation', "
    "'cocaine=substance_use', 'anxiety=anxiety', 'alcohol=substance_use', 'opioid=substance_use', 'opiate=substance_use', 'heroin=substance_use', "
    "'panic=anxiety', 'etoh=substance_use', 'od=overdose_ingestion', 'hi=homicidal_ideation', 'si=suicidal_ideation']"
)
# Mentions are marked one after the other, the longest first: no text inside a mark is read again.
_MENTIONED = rf"""
listed as (select {_MENTIONS} as l),
alternation as (select string_agg(split_part(x, '=', 1), '|' order by length(split_part(x, '=', 1)) desc, x) as a from (select unnest(l) as x from listed)),
marked as (select k, t, regexp_extract_all(' ' || replace(t, ' ', '  ') || ' ', '{_NO_WORD}((?:' || replace(a, ' ', '  ') || '))(?:{_NO_WORD}|$)', 1) as m,
  string_split_regex(' ' || replace(t, ' ', '  ') || ' ', '{_NO_WORD}(?:' || replace(a, ' ', '  ') || ')({_NO_WORD}|$)') as pieces from said, alternation),
mentions as (select k, m[i] as x, array_to_string(list_transform(range(1, i + 1), lambda j: pieces[j] || ' ' || case when j < i then m[j] || ' ' else '' end), '') as before
  from (select *, unnest(range(1, len(m) + 1)) as i from marked)),
near as (select k, replace(x, '  ', ' ') as x, list_slice(string_split({_squeeze(r"regexp_replace(before, '(?s)^.*[.!?;]', '')")}, ' '), -5, -1) as w from mentions),
judged as (select k, x, (select split_part(y, '=', 2) from (select unnest(l) as y from listed) where split_part(y, '=', 1) = x) as concept,
  (len(list_intersect(w, ['no', 'not', 'denies', 'denied', 'without'])) > 0 or regexp_matches(array_to_string(w, ' '), 'do not|does not|did not')) as negated from near),
told as (select k, coalesce(string_agg(distinct x || '=>' || concept, ' | ' order by x || '=>' || concept) filter (where not negated), '') as affirmed,
  coalesce(string_agg(distinct x || '=>' || concept, ' | ' order by x || '=>' || concept) filter (where negated), '') as negated from judged group by 1)"""


def _said(phrases: str, names: str) -> str:
    return f"(len(list_filter({phrases}, lambda p: contains(t, ' ' || p || ' '))) > 0 or len(list_intersect(names, {names})) > 0)"


_GROUPS = {
    "abdominal_pain": _said("['abdominal pain', 'abd pain', 'abdominal discomfort', 'abd discomfort', 'belly pain']", "['abdominal pain', 'abdominal discomfort', 'abdomen', 'abdomen pain']"),
    "shortness_of_breath": _said(
        "['shortness of breath', 'short of breath', 'sob', 'dyspnea', 'difficulty breathing', 'trouble breathing']",
        "['shortness of breath', 'dyspnea', 'breathing difficulty', 'difficulty breathing', 'sob']",
    ),
    "chest_pain": _said("['chest pain', 'cp', 'chest discomfort', 'chest pressure']", "['chest pain', 'chest discomfort', 'chest pressure']"),
    "altered_mental_status": _said(
        "['altered mental status', 'mental status', 'altered mental', 'ams', 'confusion', 'confused']",
        "['altered mental status', 'mental status', 'confusion', 'confused', 'disorientation']",
    ),
    "nausea_vomiting": _said("['nausea vomiting', 'nausea and vomiting', 'nausea', 'vomiting', 'emesis']", "['nausea', 'vomiting', 'emesis']"),
}
_FEVER = _said("['fever', 'fevers', 'febrile']", "['fever', 'febrile']")

_HITS = rf"""
found as (select s.*, w.gn, w.g, w.pn, w.root, regexp_extract_all(text, '(?i)\b(?:' || p || ')\b') as m, string_split_regex(text, '(?i)\b(?:' || p || ')\b') as pieces
  from sections s cross join stigma w where regexp_matches(text, '(?i)\b(?:' || p || ')\b')),
spots as (select *, length(array_to_string(pieces[1:i], '')) + length(array_to_string(m[1:i - 1], '')) as match_start from (select *, unnest(range(1, len(m) + 1)) as i from found)),
hits as (select note_id, section, row_number() over (partition by note_id, section order by gn, pn, match_start) - 1 as hit_index, g as keyword_group, root as matched_term,
  match_start, match_start + length(m[i]) as match_end,
  {_squeeze("substring(text, greatest(0, match_start - 140)::bigint + 1, (match_start + length(m[i]) + 140 - greatest(0, match_start - 140))::bigint)")} as snippet from spots)"""

_LINE = r"'\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]'"
_WORD = r"'[A-Za-z]+(?:[-''][A-Za-z]+)?'"
_BARE = "lower(regexp_replace(x, '[^A-Za-z]', '', 'g'))"
_SYLLABLES = rf"greatest(1, len(regexp_extract_all({_BARE}, '[aeiouy]+')) - (regexp_matches({_BARE}, '[^ly]e$') and len(regexp_extract_all({_BARE}, '[aeiouy]+')) > 1)::int)"

SQL = {
    "stigma_counts": f"with {_STIGMA}, {_counted('documents', 'doc_id', 'stigma', ['adamant', 'compliance', 'other'], 'n_')} select * from c",
    "keyword_density": f"""with {_PSYCH}, {_counted("documents", "doc_id", "psych", _PSYCH_GROUPS)},
w as (select doc_id, {_words("text")}::bigint as n_words from documents),
s as (select w.n_words, c.*, ({" + ".join(_PSYCH_GROUPS)})::bigint as n_hits from w join c using (doc_id))
select *, case when n_words > 0 then 1000.0::double * n_hits / n_words else 0 end as hits_per_1000_words, case when n_words > 0 then round(ln(n_words), 6) end as log_words from s""",
    "keyword_group_explode": f"""with {_PSYCH}, {_counted("documents", "doc_id", "psych", _PSYCH_GROUPS)},
l as (unpivot c on {", ".join(_PSYCH_GROUPS)} into name keyword_group value hits)
select keyword_group, sum(hits)::bigint as n_hits, count(*) as n_documents from l where hits > 0 group by 1""",
    "keyword_hits": f"with {_STIGMA}, {_SECTIONS}, {_HITS} select * from hits",
    "keyword_flags": f"""with {_STIGMA}, {_SECTIONS}, {_HITS} select note_id, bool_or(keyword_group = 'adamant') as has_adamant_keyword,
  bool_or(keyword_group = 'compliance') as has_compliance_keyword, bool_or(keyword_group = 'other') as has_other_keyword from hits group by 1""",
    "note_sections": f"with {_SECTIONS} select note_id, section, text from sections",
    "section_report": f"""with {_READ}, kept as (select * from clean where t <> '' or section <> 'unsectioned')
select n.note_id, coalesce('[' || string_agg(to_json({{'heading': heading, 'normalized_heading': name, 'canonical_section': section, 'text': t}})::varchar, ',' order by b) filter (where kept.b is not null) || ']', '[]')
    as all_detected_sections_json,
  coalesce(string_agg(heading, ' | ' order by b) filter (where heading <> 'unsectioned'), '') as detected_section_headings,
  count(*) filter (where heading <> 'unsectioned') as n_detected_sections from notes n left join kept using (note_id) group by n.note_id""",
    "section_length_profile": f"""with {_SECTIONS} select section, count(*) as n_notes, sum(length(text))::bigint as n_characters,
  sum({_words("text")})::bigint as n_words from sections group by 1""",
    "length_profile": f"""with t as (select source, {_strip("coalesce(text, '')")} as t from documents),
c as (select source, count(*) as n_rows, count(*) filter (where t <> '') as n_nonempty, sum(length(t))::bigint as n_characters, sum({_words("t")})::bigint as n_words from t group by 1)
select *, round(n_characters::double / n_rows, 6) as mean_characters_all, case when n_nonempty > 0 then round(n_characters::double / n_nonempty, 6) else 0 end as mean_characters_nonempty,
  round(n_words::double / n_rows, 6) as mean_words_all, case when n_nonempty > 0 then round(n_words::double / n_nonempty, 6) else 0 end as mean_words_nonempty from c""",
    "classifier_input": f"""with {_STIGMA}, {_SECTIONS},
kept as (select note_id, section, text from sections where section in ('present_illness', 'brief_hospital_course', 'discharge_condition', 'discharge_instructions')),
h as (select note_id, section, sum(len(regexp_extract_all(text, '(?i)\\b(?:' || p || ')\\b')))::bigint as n from kept cross join stigma group by 1, 2)
select note_id, section as section_name, {_words("text")} as section_word_count, length(text) as section_char_length, n as n_keyword_hits,
  (n > 0)::int as has_sl_keyword_hit from kept join h using (note_id, section)""",
    "chief_complaints": f"""with {_NOTES}, c as (select note_id, trim(replace(coalesce(regexp_extract(text, {_COMPLAINT}, 1), ''), chr(10), ' ')) as t from notes)
select note_id, case when starts_with(t, '[]') then '' else t end as chief_complaint from c""",
    "text_normalise": f"select distinct pair_id, {_normal('mhh_chief_complaint_raw')} as normalized from matched_pairs",
    "complaint_context": f"""with p as (select distinct pair_id, mhh_chief_complaint_raw as raw from matched_pairs),
n as (select pair_id, raw, {_normal("raw")} as normal, {_context("raw")} as context from p),
s as (select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(raw, ''), '_+', ' ', 'g'), '(?i)^\\s*(?:cc|chief complaint)\\s*:\\s*', ''),
  '(?i)^\\s*(?:admit(?:ted)?\\s+for|admission\\s+for)\\s+', ''), '(?i)^\\s*(?:s/p|status post)\\s+', '') as bare from n)
select distinct pair_id, context, array_to_string(regexp_extract_all(normal, '[a-z][a-z0-9/+.-]*'), ' | ') as tokens,
  ({_squeeze("regexp_replace(lower(bare), '[^\\p{L}\\p{N}_\\s/+-]', ' ', 'g')")} in {_MISSING})::int as is_placeholder from s""",
    "concept_mentions": f"""with said as (select distinct classifier_row_id as k, {_normal("section_text")} as t from psych_history_llm_input), {_MENTIONED}
select s.k as classifier_row_id, coalesce(affirmed, '') as affirmed, coalesce(negated, '') as negated from said s left join told using (k)""",
    "usable_complaints": f"""with raw as (select distinct pair_id, mhh_chief_complaint_raw as raw, mhh_quickumls_terms as terms from matched_pairs),
all_of as (select row_number() over () as k, * from raw), said as (select k, {_normal("raw")} as t from all_of), {_MENTIONED}
select distinct b.pair_id, s.t as normalized from all_of b join said s using (k) left join told using (k)
where s.t <> '' and coalesce(affirmed, '') = '' and coalesce(negated, '') = '' and len({_terms("terms")}) between 1 and 8 and not coalesce(contains(terms, 'negated:'), false)""",
    "complaint_subgroups": f"""with p as (select distinct * from matched_pairs),
s as (select pair_id, 'case' as role, mhh_chief_complaint_normalized as c, mhh_quickumls_terms as q from p
  union all select pair_id, 'control', mhc0_chief_complaint_normalized, mhc0_quickumls_terms from p),
e as (select pair_id, role, ' ' || {_squeeze("lower(c)")} || ' ' as t, {_terms("lower(q)")} as q from s),
n as (select pair_id, role, coalesce(t, '') as t, list_concat(q, flatten(list_transform(q, lambda x: list_transform(
  string_split(regexp_replace(x, '^negated:', ''), ' '), lambda w: case when starts_with(x, 'negated:') then 'negated:' || w else w end)))) as names from e),
f as (select pair_id, role, {", ".join(f"{test}::int as has_{g}" for g, test in _GROUPS.items())}, {_FEVER}::int as has_overlap_fever from n),
g as (select *, has_abdominal_pain | has_nausea_vomiting as has_abdominal_pain_nausea_vomiting, has_chest_pain | has_shortness_of_breath as has_chest_pain_shortness_of_breath,
  has_altered_mental_status as has_overlap_altered_mental_status,
  (has_abdominal_pain + has_shortness_of_breath + has_chest_pain + has_altered_mental_status + has_nausea_vomiting)::bigint as n_subgroups,
  concat_ws(' | ', case when has_abdominal_pain = 1 then 'abdominal_pain' end, case when has_shortness_of_breath = 1 then 'shortness_of_breath' end,
    case when has_chest_pain = 1 then 'chest_pain' end, case when has_altered_mental_status = 1 then 'altered_mental_status' end,
    case when has_nausea_vomiting = 1 then 'nausea_vomiting' end) as subgroups from f)
select *, case when n_subgroups = 1 then subgroups end as pure_group, case has_abdominal_pain_nausea_vomiting * 2 + has_chest_pain_shortness_of_breath
  when 2 then 'abdominal_pain_nausea_vomiting' when 1 then 'chest_pain_shortness_of_breath' end as exclusive_group from g""",
    "chunk_windows": f"""with {_NOTES}, w as (select note_id, string_split({_squeeze("coalesce(text, '')")}, ' ') as w from notes),
c as (select note_id, w, greatest(1, ceil((len(w) - 75) / 525.0))::bigint as n_chunks from w where len(w) > 1 or w[1] <> ''),
e as (select note_id, w, n_chunks, unnest(range(n_chunks)) as chunk from c)
select note_id, chunk, n_chunks, length(array_to_string(w[chunk * 525 + 1 : chunk * 525 + 600], ' ')) as n_characters from e""",
    "readability_metrics": rf"""
with t as (select doc_id, coalesce(text, '') as t, {_strip("coalesce(text, '')")} as b from documents),
w as (select doc_id, t, b, regexp_extract_all(t, {_WORD}) as words, len(regexp_extract_all(t, '[A-Za-z]+(?:[-''][A-Za-z]+)?|\p{{Nd}}+(?:\.\p{{Nd}}+)?')) as n_tokens,
  {_stripped(f"string_split_regex(t, {_LINE})")} as lines,
  {_stripped(f"string_split_regex(regexp_replace(b, '([.!?]){_S}+', '\\1' || chr(1), 'g'), chr(1) || '|\\n{{2,}}')")} as units from t),
s as (select *, case when len(units) <= 1 and contains(b, chr(10)) then {_stripped(f"string_split_regex(b, {_LINE})")} else units end as sentences,
  list_transform(words, lambda x: {_SYLLABLES}) as syl, list_transform(words, lambda x: length(regexp_replace(x, '[^A-Za-z]', '', 'g'))) as letters,
  list_transform(lines, lambda x: {_words("x")}) as by_line from w),
c as (select doc_id, length(t) as n_characters, coalesce(list_sum(by_line), 0)::bigint as n_whitespace_words, n_tokens, len(words) as n_alpha_words,
  len(sentences) as n_sentences, len(lines) as n_nonempty_lines, coalesce(list_sum(syl), 0)::bigint as n_syllables,
  len(list_filter(letters, lambda x: x >= 7)) as n_long_alpha_words, len(list_filter(syl, lambda x: x >= 3)) as n_complex_alpha_words,
  coalesce(list_sum(letters), 0)::bigint as n_letters, len(list_filter(by_line, lambda x: x <= 5)) as n_short from s),
r as (select *, (n_tokens > 0 and n_alpha_words > 0 and n_sentences > 0) as ok, coalesce(n_tokens::double / nullif(n_sentences, 0), 0) as ps,
  coalesce(n_syllables::double / nullif(n_alpha_words, 0), 0) as rate, 100.0::double * coalesce(n_complex_alpha_words::double / nullif(n_alpha_words, 0), 0) as hard,
  coalesce(n_letters::double / nullif(n_alpha_words, 0), 0) as size from c)
select doc_id, n_characters, n_whitespace_words, n_tokens, n_alpha_words, n_sentences, n_nonempty_lines, n_syllables, n_long_alpha_words, n_complex_alpha_words,
  round(ps, 9) as mean_words_per_sentence, round(coalesce(n_whitespace_words::double / nullif(n_nonempty_lines, 0), 0), 9) as mean_words_per_line,
  round(100.0::double * coalesce(n_short::double / nullif(n_nonempty_lines, 0), 0), 9) as pct_short_lines, round(size, 9) as mean_characters_per_alpha_word,
  round(rate, 9) as mean_syllables_per_alpha_word, round(100.0::double * coalesce(n_long_alpha_words::double / nullif(n_alpha_words, 0), 0), 9) as pct_long_alpha_words,
  round(hard, 9) as pct_complex_alpha_words,
  round(case when ok then 206.835::double - 1.015::double * ps - 84.6::double * rate else 0 end, 9) as flesch_reading_ease,
  round(case when ok then 0.39::double * ps + 11.8::double * rate - 15.59::double else 0 end, 9) as flesch_kincaid_grade,
  round(case when ok then 0.4::double * (ps + hard) else 0 end, 9) as gunning_fog_index,
  round(case when ok then 1.043::double * sqrt(n_complex_alpha_words * 30.0::double / n_sentences) + 3.1291::double else 0 end, 9) as smog_index,
  round(case when ok then 4.71::double * size + 0.5::double * ps - 21.43::double else 0 end, 9) as automated_readability_index from r""",
    "bigram_counts": r"""
with w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') as w from documents),
g as (select doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as ngram from w)
select ngram, 2::bigint as n, count(*) as n_occurrences, count(distinct doc_id) as n_documents from g group by 1""",
    "token_phrase_flags": f"""
with b as (select doc_id, ' ' || {_squeeze("lower(text)")} || ' ' as t from documents)
select doc_id, coalesce(contains(t, ' emergency department '), false)::int as has_emergency_department, coalesce(contains(t, ' heavy drinking '), false)::int as has_heavy_drinking,
  coalesce(contains(t, ' low mood '), false)::int as has_low_mood, coalesce(contains(t, ' hearing voices '), false)::int as has_hearing_voices from b""",
    "confused_in_section": rf"""with {_SECTIONS} select note_id, regexp_matches(text, '(?i)\bconfused\b')::int as flag from sections where section = 'discharge_condition'""",
    "missed_headings": rf"""
with {_ALIASES}, l as (select doc_id, unnest({_LINES}) as line from documents),
h as (select doc_id, case when regexp_matches(line, {_HEAD}) then {_NAME}
  else trim(replace(lower({_squeeze("regexp_extract(line, '^\\s*([A-Z][A-Z0-9 /_&,\\-()]{1,90})\\s*:\\s*', 1)")}), '___', '')) end as heading from l)
select heading, count(*) as n_occurrences, count(distinct doc_id) as n_notes,
  (regexp_matches(heading, 'admission|assessment|course|diagnos|exam|history|hospital|imaging|impression|instruction|issue|lab|medication|micro|plan|procedure|problem|result|social|study')
   and not regexp_matches(heading, 'date of birth|sex|service|unit|phone|fax|provider|attending|dictated by|completed by|signed electronically|level of consciousness|mental status'
     || '|temperature|heart rate|blood pressure|respiratory rate|oxygen saturation|\bsat\b|\bpulse\b|vital|\bdp right\b|\bdp left\b|\bpt right\b|\bpt left\b'))::int as likely
from h where heading <> '' and heading not in (select name from alias) group by 1""",
    "parent_phrases": f"""
with r as (select distinct hadm_id, trim(lower({_squeeze("chief_complaint_normalized")})) as whole from chief_complaint_cluster_qc_output),
t as (select whole, count(distinct hadm_id) as n, string_split(whole, ' ') as w from r where whole <> '' group by 1),
g as (select distinct whole, n, array_to_string(w[i : i + size - 1], ' ') as phrase, size from (select *, unnest(range(1, len(w) - size + 2)) as i from (select *, unnest([1, 2, 3, 4, 5]) as size from t))),
k as (select phrase, sum(n)::bigint as n_records, count(*) as n_texts, coalesce(sum(n) filter (where whole = phrase), 0)::bigint as n_exact from g group by 1),
s as (select *, string_split(phrase, ' ') as w from k where n_records >= 20 and n_texts >= 2),
m as (select * from s where case when len(w) = 1 then phrase in ('fall', 'fever', 'fracture', 'seizure', 'syncope', 'trauma')
  else w[1] not in ('a', 'an', 'and', 'at', 'by', 'for', 'from', 'in', 'of', 'on', 'or', 'the', 'to', 'with')
    and w[-1] not in ('a', 'an', 'and', 'at', 'by', 'for', 'from', 'in', 'of', 'on', 'or', 'the', 'to', 'with') end)
select phrase, n_exact, n_records, n_texts from m where n_exact > 0 or not exists
  (select 1 from m l where len(l.w) > len(m.w) and contains(' ' || l.phrase || ' ', ' ' || m.phrase || ' ') and l.n_records >= 0.85 * m.n_records)""",
    "term_pairs": f"""
with r as (select distinct pair_id, mhh_quickumls_terms as t from matched_pairs), e as (select pair_id, unnest(list_distinct({_terms("t")})) as x, t from r)
select a.x as term_a, b.x as term_b, count(*) as n_rows from e a join e b on a.pair_id = b.pair_id and a.t = b.t and a.x < b.x group by 1, 2""",
    "shared_terms": f"""
with r as (select distinct pair_id, mhh_quickumls_terms, mhc0_quickumls_terms from matched_pairs),
t as (select pair_id, {_terms("mhh_quickumls_terms")} as a, {_terms("mhc0_quickumls_terms")} as b from r),
s as (select *, list_sort(list_intersect(a, b)) as s, list_distinct(a || b) as u from t)
select pair_id, len(s) as n_shared, array_to_string(s, ' | ') as shared,
  case when len(a) = 0 or len(b) = 0 then 0 else len(s)::double / len(u) end as jaccard from s""",
    "json_props": "select event_id, (props->>'$.k')::bigint as k from events",
    "json_recovered": """with p as (select event_id, unnest([props, props[1:-2]]) as props from events)
select event_id, trim(regexp_extract(props, '"k"\\s*:\\s*([0-9]+)', 1))::bigint as k, (not json_valid(props))::int as recovered from p""",
    "lenient_days": "select distinct note_id, strftime(charttime, '%Y-%m-%d') as day from export_mhh_psychotic",
    "keyword_prefilter": rf"""with {_PSYCH}, {_SECTIONS},
h as (select note_id, section, position, g, sum(len(regexp_extract_all(text, '(?i)\b(?:' || p || ')\b')))::bigint as n from sections cross join psych group by all),
k as (select note_id, section, position, sum(n)::bigint as n_hits, count(*) as n_groups, string_agg(g || ':' || n, ' | ' order by g) as group_hit_counts from h where n > 0 group by 1, 2, 3)
select note_id, section, n_hits, n_groups, group_hit_counts, row_number() over (order by note_id, position) - 1 as classifier_row_id from k""",
}
