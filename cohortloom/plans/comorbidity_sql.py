"""SQL of the comorbidity score: groups as patterns of their own, each with its weight."""

GROUPS_SQL = r"""rules(grp, weight, v, p) as (values
('congestive_heart_failure', 7, 10, 'I099|I110|I130|I132|I255|I420|I42[5-9]|I43|I50|P290'),
('congestive_heart_failure', 7, 9, '39891|402[019]1|404[019][13]|425[4-9]|428'),
('cardiac_arrhythmia', 5, 10, 'I44[1-3]|I456|I459|I4[789]|R00[018]|T821|Z450|Z950'),
('cardiac_arrhythmia', 5, 9, '426[079]|4261[023]|427[0-46-9]|7850|9960[14]|V450|V533'),
('valvular_disease', -1, 10, 'A520|I0[5-8]|I091|I098|I3[4-9]|Q23[0-3]|Z95[2-4]'),
('valvular_disease', -1, 9, '0932|39[4-7]|424|746[3-6]|V422|V433'),
('pulmonary_circulation', 4, 10, 'I26|I27|I28[089]'), ('pulmonary_circulation', 4, 9, '415[01]|416|417[089]'),
('peripheral_vascular', 2, 10, 'I70|I71|I73[189]|I771|I79[02]|K55[189]|Z95[89]'), ('peripheral_vascular', 2, 9, '0930|4373|440|441|443[1-9]|4471|557[19]|V434'),
('hypertension_uncomplicated', 0, 10, 'I10'), ('hypertension_uncomplicated', 0, 9, '401'),
('hypertension_complicated', 0, 10, 'I1[1235]'), ('hypertension_complicated', 0, 9, '40[2-5]'),
('paralysis', 7, 10, 'G041|G114|G80[12]|G8[12]|G83[0-49]'), ('paralysis', 7, 9, '3341|34[23]|344[0-69]'),
('other_neurological', 6, 10, 'G1[0-3]|G2[0-2]|G25[45]|G31[289]|G32|G3[567]|G4[01]|G93[14]|R470|R56'),
('other_neurological', 6, 9, '3319|332[01]|333[45]|33392|33[45]|3362|34[015]|348[13]|7803|7843'),
('chronic_pulmonary', 3, 10, 'I27[89]|J4[0-7]|J6[0-7]|J684|J70[13]'), ('chronic_pulmonary', 3, 9, '416[89]|49[0-9]|50[0-5]|5064|508[18]'),
('diabetes_uncomplicated', 0, 10, 'E1[0-4][019]'), ('diabetes_uncomplicated', 0, 9, '250[0-3]'),
('diabetes_complicated', 0, 10, 'E1[0-4][2-8]'), ('diabetes_complicated', 0, 9, '250[4-9]'),
('hypothyroidism', 0, 10, 'E0[0-3]|E890'), ('hypothyroidism', 0, 9, '2409|24[34]|246[18]'),
('renal_failure', 5, 10, 'I120|I131|N1[89]|N250|Z49[0-2]|Z940|Z992'), ('renal_failure', 5, 9, '403[019]1|404[019][23]|58[56]|5880|V420|V451|V56'),
('liver_disease', 11, 10, 'B18|I85|I864|I982|K70|K71[13457]|K7[234]|K76[02-9]|Z944'),
('liver_disease', 11, 9, '0702[23]|0703[23]|07044|07054|070[69]|456[012]|57[01]|572[2-8]|573[3489]|V427'),
('peptic_ulcer', 0, 10, 'K2[5-8][79]'), ('peptic_ulcer', 0, 9, '53[1-4][79]'), ('aids', 0, 10, 'B2[0124]'), ('aids', 0, 9, '04[234]'),
('lymphoma', 9, 10, 'C8[1-58]|C96|C90[02]'), ('lymphoma', 9, 9, '20[012]|2030|2386'),
('metastatic_cancer', 12, 10, 'C7[789]|C80'), ('metastatic_cancer', 12, 9, '19[6-9]'),
('solid_tumor', 4, 10, 'C[01][0-9]|C2[0-6]|C3[0-4789]|C4[01356789]|C5[0-8]|C6[0-9]|C7[0-6]|C97'), ('solid_tumor', 4, 9, '1[4-6][0-9]|17[0-24-9]|18[0-9]|19[0-5]'),
('rheumatoid_arthritis', 0, 10, 'L94[013]|M0[568]|M12[03]|M30|M31[0-3]|M3[2-5]|M45|M46[189]'),
('rheumatoid_arthritis', 0, 9, '446|7010|710[0-489]|7112|714|7193|720|725|7285|72889|72930'),
('coagulopathy', 3, 10, 'D6[5-8]|D69[13456]'), ('coagulopathy', 3, 9, '286|287[1345]'), ('obesity', -4, 10, 'E66'), ('obesity', -4, 9, '2780'),
('weight_loss', 6, 10, 'E4[0-6]|R634|R64'), ('weight_loss', 6, 9, '26[0-3]|7832|7994'), ('fluid_electrolyte', 5, 10, 'E222|E8[67]'), ('fluid_electrolyte', 5, 9, '2536|276'),
('blood_loss_anemia', -2, 10, 'D500'), ('blood_loss_anemia', -2, 9, '2800'), ('deficiency_anemia', -2, 10, 'D50[89]|D5[123]'), ('deficiency_anemia', -2, 9, '280[1-9]|281'),
('alcohol_abuse', 0, 10, 'F10|E52|G621|I426|K292|K70[039]|T51|Z502|Z714|Z721'), ('alcohol_abuse', 0, 9, '2652|291[1-35-9]|303[09]|3050|3575|4255|5353|571[0-3]|980|V113'),
('drug_abuse', -7, 10, 'F1[1-689]|Z715|Z722'), ('drug_abuse', -7, 9, '292|304|305[2-9]|V6542'),
('psychoses', 0, 10, 'F2[0234589]|F302|F31[25]'), ('psychoses', 0, 9, '2938|295|296[0145]4|297|298'),
('depression', -3, 10, 'F204|F31[345]|F3[23]|F341|F412|F432'), ('depression', -3, 9, '296[235]|3004|309|311')),
coded as (select distinct hadm_id, icd_version, upper(replace(trim(icd_code), '.', '')) as code from diagnoses where hadm_id is not null),
raw as (select distinct hadm_id, icd_version, grp, weight from coded join rules on v = icd_version and regexp_matches(code, '^(?:' || p || ')')),
kept as (select * from raw a where not exists (select 1 from raw b where b.hadm_id = a.hadm_id and b.icd_version = a.icd_version and (a.grp, b.grp) in
  (('hypertension_uncomplicated', 'hypertension_complicated'), ('diabetes_uncomplicated', 'diabetes_complicated'), ('solid_tumor', 'metastatic_cancer')))),
told as (select hadm_id, count(distinct grp) as n_groups, string_agg(distinct grp, '|' order by grp) as groups, sum(weight)::bigint as score from kept group by 1)
select a.hadm_id, coalesce(n_groups, 0) as n_groups, coalesce(groups, '') as groups, coalesce(score, 0)::bigint as score from admissions a left join told using (hadm_id)"""
