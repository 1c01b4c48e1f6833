"""The driver's star schema in the roles of a clinical schema, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.session import table


def _coded(parts: DataFrame) -> DataFrame:
    key = F.col("p_partkey")
    finer = F.when(key % 12 == 0, (F.floor(key / 12) % 7).cast("string")).otherwise("")
    code10 = (
        F.when(key % 3 == 0, F.concat(F.lit("F"), F.lpad((F.floor(key / 3) % 100).cast("string"), 2, "0"), finer))
        .when(key % 3 == 1, F.concat(F.lit("K70"), (key % 10).cast("string")))
        .otherwise(F.concat(F.lit("J"), F.lpad((key % 100).cast("string"), 2, "0")))
    )
    code9 = F.when(key % 7 == 0, F.concat(F.lit("V11"), (key % 5).cast("string"))).otherwise(
        F.concat((key % 60 + 280).cast("string"), (key % 3).cast("string"))
    )
    endings = {0: " suicide attempt", 1: ", Self-Harm", 2: " poisoning", 3: " withdrawal", 4: " Delusion"}
    ending = F.lit("")
    for rest, text in endings.items():
        ending = F.when(key % 40 == rest, F.lit(text)).otherwise(ending)
    version = F.when(F.col("p_size") % 2 == 0, 10).otherwise(9)
    return parts.select(
        "p_partkey", version.alias("icd_version"), F.when(version == 10, code10).otherwise(code9).alias("icd_code"), F.concat("p_name", ending).alias("long_title")
    )


def dictionary(spark: SparkSession, d: str) -> DataFrame:
    return _coded(table(spark, d, "part").select("p_partkey", "p_size", "p_name")).drop("p_partkey").distinct()


def admissions(spark: SparkSession, d: str) -> DataFrame:
    stay = F.make_dt_interval(F.col("o_orderkey").cast("int") % 9)
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderkey").alias("hadm_id"),
        F.col("o_orderdate").alias("admittime"),
        (F.col("o_orderdate") + stay).alias("dischtime"),
        F.col("o_orderpriority").alias("admission_type"),
        "o_orderstatus",
        "o_totalprice",
    )


def notes(spark: SparkSession, d: str) -> DataFrame:
    return admissions(spark, d).where("o_orderstatus <> 'P'").select("subject_id", "hadm_id")


def diagnoses(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hadm_id"), F.col("l_linenumber").alias("seq_num"), "l_partkey")
    codes = _coded(table(spark, d, "part").select("p_partkey", "p_size", "p_name"))
    owners = admissions(spark, d).select("subject_id", "hadm_id")
    coded = lines.join(codes, F.col("l_partkey") == F.col("p_partkey")).select("hadm_id", "seq_num", "icd_version", "icd_code")
    return coded.join(owners, "hadm_id")


def patients(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("score")
    )


def matched(spark: SparkSession, d: str) -> DataFrame:
    """A matched cohort: urgent admissions, neighbours in number being a pair."""
    case = F.col("hadm_id") % 2 == 0
    rows = admissions(spark, d).where("admission_type = '1-URGENT'")
    return rows.select(
        F.floor(F.col("hadm_id") / 2).alias("pair_id"), F.when(case, "case").otherwise("control").alias("matched_role"),
        F.when(case, "MHH1_psychotic").otherwise("MHC0").alias("cohort"), "subject_id", "hadm_id",
    )


def lab_events(spark: SparkSession, d: str) -> DataFrame:
    owners = admissions(spark, d).select("subject_id", "hadm_id")
    lines = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("hadm_id"), F.col("l_partkey").alias("itemid"), F.col("l_quantity").alias("valuenum"), F.col("l_shipdate").alias("charttime")
    )
    return lines.join(owners, "hadm_id")


def lab_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("itemid"), F.col("p_name").alias("label"), F.col("p_brand").alias("fluid"), F.col("p_type").alias("category"))


def orders(spark: SparkSession, d: str) -> DataFrame:
    return admissions(spark, d).select("subject_id", "hadm_id", F.col("hadm_id").alias("poe_id"), F.col("admission_type").alias("order_type"))


def order_details(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("poe_id"), F.col("l_returnflag").alias("field_name"), F.col("l_quantity").alias("field_value"))


#: The same roles as a list of common table expressions.
SQL = """
codes as (select p_partkey, case when p_size % 2 = 0 then 10 else 9 end as icd_version,
  case when p_size % 2 = 0 then
    case p_partkey % 3 when 0 then 'F' || lpad(((p_partkey // 3) % 100)::varchar, 2, '0') || case when p_partkey % 12 = 0 then ((p_partkey // 12) % 7)::varchar else '' end
      when 1 then 'K70' || (p_partkey % 10)::varchar else 'J' || lpad((p_partkey % 100)::varchar, 2, '0') end
  else case when p_partkey % 7 = 0 then 'V11' || (p_partkey % 5)::varchar
    else (p_partkey % 60 + 280)::varchar || (p_partkey % 3)::varchar end end as icd_code,
  p_name || case p_partkey % 40 when 0 then ' suicide attempt' when 1 then ', Self-Harm' when 2 then ' poisoning'
    when 3 then ' withdrawal' when 4 then ' Delusion' else '' end as long_title from part),
dictionary as (select distinct icd_version, icd_code, long_title from codes),
admissions as (select o_custkey as subject_id, o_orderkey as hadm_id, o_orderdate::timestamp as admittime,
  o_orderdate::timestamp + to_days((o_orderkey % 9)::int) as dischtime, o_orderpriority as admission_type, o_orderstatus, o_totalprice from orders),
diagnoses as (select a.subject_id, a.hadm_id, l.l_linenumber as seq_num, c.icd_version, c.icd_code
  from lineitem l join codes c on l.l_partkey = c.p_partkey join admissions a on a.hadm_id = l.l_orderkey),
notes as (select subject_id, hadm_id from admissions where o_orderstatus <> 'P'),
psychiatric as (select distinct icd_version, icd_code from dictionary where
  (icd_version = 10 and icd_code like 'F%') or (icd_version = 9 and (regexp_matches(icd_code, '^(29[0-9]|30[0-9]|31[0-9])') or icd_code like 'V11%'))
  or regexp_matches(lower(long_title), 'suicid|self-harm|self harm|intentional self')),
category_of as (
  select p.icd_version, p.icd_code, 'psychotic' as category from psychiatric p where
    (icd_version = 10 and regexp_matches(icd_code, '^F2[0-5,8-9]')) or (icd_version = 9 and (regexp_matches(icd_code, '^29[578]') or icd_code = 'V110'))
  union select icd_version, icd_code, 'substance_related' from psychiatric where
    (icd_version = 10 and icd_code like 'F1%') or (icd_version = 9 and (regexp_matches(icd_code, '^(291|292|303|304|305)') or icd_code = 'V113'))
  union select icd_version, icd_code, 'internalizing' from psychiatric where
    (icd_version = 10 and regexp_matches(icd_code, '^(F3[0-489]|F4[0-58]|F50)')) or (icd_version = 9 and
      (regexp_matches(icd_code, '^(296|300|306|308|309|3071|3132)') or icd_code in ('311', '3130', '3131', 'V111', 'V112', 'V114')))
  union select icd_version, icd_code, 'personality_behavioral' from psychiatric where
    (icd_version = 10 and regexp_matches(icd_code, '^(F6[0-689]|F5[1-59])')) or (icd_version = 9 and
      (regexp_matches(icd_code, '^(301|302|307[03-9]|312|313[38])') or icd_code = '3139'))
  union select icd_version, icd_code, 'neurodevelopmental' from psychiatric where
    (icd_version = 10 and regexp_matches(icd_code, '^(F7[0-389]|F8[0-489]|F9[0-58])')) or (icd_version = 9 and
      regexp_matches(icd_code, '^(299|3072|314|315|317|318|319)'))
  union select icd_version, icd_code, 'neurocognitive' from psychiatric where
    (icd_version = 10 and regexp_matches(icd_code, '^F0[123]')) or (icd_version = 9 and
      (regexp_matches(icd_code, '^(290|2941|2942)') or icd_code in ('2948', '2949')))
  union select distinct p.icd_version, p.icd_code, 'suicide_self_harm' from psychiatric p join dictionary d using (icd_version, icd_code)
    where regexp_matches(lower(d.long_title), 'suicid|self-harm|self harm|intentional self')),
categories as (select * from category_of union all
  select p.icd_version, p.icd_code, 'other' from psychiatric p where not exists
    (select 1 from category_of c where c.icd_version = p.icd_version and c.icd_code = p.icd_code)),
grey as (select icd_version, icd_code, long_title from dictionary where
    (icd_version = 9 and icd_code in ('3575', '4255', '53530', '53531', '5710', '5711', '5712', '5713')) or
    (icd_version = 10 and icd_code in ('G621', 'G721', 'I426', 'K292', 'K2920', 'K2921', 'K70', 'K700', 'K701', 'K7010', 'K7011',
      'K702', 'K703', 'K7030', 'K7031', 'K704', 'K7040', 'K7041', 'K709', 'K860'))
  union select d.icd_version, d.icd_code, d.long_title from dictionary d where
    regexp_matches(lower(d.long_title), 'poisoning|overdose|toxic effect|drug-induced|medication-induced|withdrawal|intoxication')
    and not exists (select 1 from psychiatric p where p.icd_version = d.icd_version and p.icd_code = d.icd_code)),
base as (select distinct a.subject_id, a.hadm_id, a.admittime from admissions a join notes using (subject_id, hadm_id)
  join diagnoses d on d.subject_id = a.subject_id and d.hadm_id = a.hadm_id and d.seq_num = 1
  where not exists (select 1 from psychiatric p where p.icd_version = d.icd_version and p.icd_code = d.icd_code)
    and not exists (select 1 from grey g where g.icd_version = d.icd_version and g.icd_code = d.icd_code)),
same_categories as (select distinct b.subject_id, b.hadm_id, c.category from base b join diagnoses d using (subject_id, hadm_id)
  join categories c using (icd_version, icd_code) where d.seq_num > 1),
prior_categories as (select distinct b.subject_id, b.hadm_id, c.category from base b join admissions p on p.subject_id = b.subject_id and p.admittime < b.admittime
  join diagnoses d on d.subject_id = p.subject_id and d.hadm_id = p.hadm_id join categories c using (icd_version, icd_code)),
same_text as (select subject_id, hadm_id, string_agg(category, ' | ' order by category) as same_admission_psych_categories from same_categories group by 1, 2),
prior_text as (select subject_id, hadm_id, string_agg(category, ' | ' order by category) as prior_psych_categories from prior_categories group by 1, 2),
history as (select b.*, (s.hadm_id is not null or p.hadm_id is not null)::int as mhc,
    (s.hadm_id is not null)::int as has_secondary_psychiatric_same_admission, (p.hadm_id is not null)::int as has_prior_psychiatric_history,
    s.same_admission_psych_categories, p.prior_psych_categories
  from base b left join same_text s using (subject_id, hadm_id) left join prior_text p using (subject_id, hadm_id)),
grouped as (select h.*, case when max(mhc) over w = 0 then 'only_MHC0' when min(mhc) over w = 1 then 'only_MHC1' else 'MHC_0_to_1' end as subject_group
  from history h window w as (partition by subject_id))
"""
