"""Test inputs that Spark derives from the given tables (whole tables, no caps).

Every fixture also has a DuckDB text, so oracles start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(df: DataFrame, *keys: str, always: bool = False) -> DataFrame:
    """``df`` dealt to as many partitions as ``parafid.fixture.partitions`` says; as it is when that is unset.

    For single-file test tables on many cores. A cluster leaves the setting
    alone, and large scans of texts then have no exchange at any size. ``always``
    deals to ``spark.sql.shuffle.partitions`` even then: for a few narrow columns
    from which long texts are made, whose file may be one row group and so one task.
    """
    conf = df.sparkSession.conf
    n = conf.get("parafid.fixture.partitions", None) or (conf.get("spark.sql.shuffle.partitions") if always else None)
    return df.repartition(int(n), *keys) if n else df


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ------------------------------------------------------------------- note pairs
_X = """'Dose '||cast(cast(l_quantity as int) as string)||' '||{unit_x}||' given to the '
||case when l_suppkey%2=0 then 'left' else 'right' end||' side'
||case when l_partkey%11=0 then '. You should take aspirin daily'
       when l_partkey%13=0 then '. No sign of stroke was seen'
       when l_partkey%17=0 then '. Blood pressure '||cast(100+l_partkey%60 as string)||'/'||cast(60+l_partkey%30 as string)||' mmHg'
       else '' end"""
_Y = """'Dose '||cast(cast(l_quantity as int) as string)||' '||{unit_y}||' on the '
||case when (l_suppkey%2=0)<>(l_partkey%10=0) then 'left' else 'right' end||' side'
||case when l_partkey%19=0 then '. You need surgery' when l_partkey%23=0 then '. This may be cancer' else '' end"""
_UNIT = "case ({n})%5 when 0 then 'mg' when 1 then 'mm' when 2 then 'cm' when 3 then 'kg' else 'ml' end"
_X = _X.format(unit_x=_UNIT.format(n="l_linenumber"))
_Y = _Y.format(unit_y=_UNIT.format(n="case when l_partkey%9=0 then l_linenumber+1 else l_linenumber end"))


def notes(spark: SparkSession, d: str) -> DataFrame:
    """One (original, simplified) pair per order: pair_id, original, simplified."""
    scan = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = spread(scan, "l_orderkey", always=True).select(
        F.col("l_orderkey").alias("pair_id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"),
        F.col("l_suppkey").alias("q"), ((F.col("l_linenumber") + F.col("l_partkey")) % 4 != 0).alias("keep"),
        F.expr(_X).alias("x"), F.expr(_Y).alias("y"))
    parts = F.array_sort(F.collect_list(F.struct("n", "p", "q", "x", "y", "keep")))
    g = rows.groupBy("pair_id").agg(parts.alias("l"))  # a pair has a handful of lines

    def text(items, field):
        return F.concat(F.array_join(F.transform(items, lambda z: z[field]), ". "), F.lit("."))
    return g.select("pair_id", text(F.col("l"), "x").alias("original"),
                    text(F.filter("l", lambda z: z["keep"]), "y").alias("simplified"))


NOTES_SQL = f"""l as (select l_orderkey pair_id, l_linenumber n, l_partkey p, l_suppkey q,
 (l_linenumber+l_partkey)%4<>0 as keep, {_X} as x, {_Y} as y from lineitem),
notes as (select pair_id, string_agg(x,'. ' order by n,p,q,x,y)||'.' original,
 coalesce(string_agg(y,'. ' order by n,p,q,x,y) filter (keep),'')||'.' simplified from l group by 1)"""

# --------------------------------------------------------------- clinical reports
_NL = "||chr(10)||"
_DATE = "cast(1+o_custkey%12 as string)||'/'||cast(1+o_orderkey%28 as string)||'/'||cast(1990+o_custkey%30 as string)"
_DX = "case o_custkey%6 when 0 then 'acute stroke' when 1 then 'lung cancer' when 2 then 'mild anemia' when 3 then 'chronic bronchitis' when 4 then 'heart failure' else 'type 2 diabetes' end"
REPORT_ORIGINAL = _NL.join([
    "case when o_orderkey%3=0 then 'Patient record' when o_orderkey%3=1 then '  ' else 'Intake, page '||cast(1+o_custkey%4 as string)||' of 4' end",
    "case when o_orderkey%2=0 then 'CC: pain in the left knee' else 'Chief Complaint: swelling of the right ankle' end",
    f"'HPI: seen on '||{_DATE}||' at '||cast(8+o_custkey%10 as string)||':30 AM. MRN: '||cast(1000000+o_orderkey as string)||'. Call 555-123-'||cast(1000+o_custkey%9000 as string)||'.'",
    "'Physical Exam: blood pressure '||cast(100+o_orderkey%70 as string)||'/'||cast(60+o_custkey%35 as string)||' mmHg, heart rate '||cast(60+o_orderkey%50 as string)||' bpm. Weight '||cast(50+o_custkey%40 as string)||'.5 kg. A nodule measures '||cast(2+o_orderkey%11 as string)||' mm in the left lung. No fever. Narrowing of '||cast(10+o_custkey%80 as string)||'% at C4-C5.'",
    f"'Assessment: diagnosed with '||{_DX}||'. The scan shows no fracture. Findings: stable heart size.'",
    "'Medications: aspirin '||cast(75+o_custkey%25 as string)||' mg daily and amoxicillin '||cast(o_orderkey%9 as string)||' tablets for '||cast(1+o_custkey%6 as string)||' weeks.'",
    "case when o_custkey%4=0 then 'Plan: recommend follow-up biopsy. Go to the emergency room if pain is severe.' else 'Imaging: CT scan within normal limits.' end",
])
REPORT_SIMPLIFIED = "||' '||".join([
    "case when o_orderkey%5=0 then 'You have pain in the right knee.' else 'You have pain in the left knee.' end",
    f"'You were seen on '||{_DATE}||'.'",
    "'Your blood pressure was '||cast(100+o_orderkey%70 as string)||'/'||cast(60+(case when o_custkey%7=0 then o_custkey+1 else o_custkey end)%35 as string)||' mmHg.'",
    "case when o_custkey%3=0 then '' else 'There is a '||cast(2+o_orderkey%11 as string)||case when o_orderkey%13=0 then ' cm' else ' mm' end||' spot in the left lung (Source: \"A nodule measures '||cast(2+o_orderkey%11 as string)||' mm in the left lung\").' end",
    f"case when o_orderkey%4=0 then 'The report shows a change [Quote: \"made up words\"].' else 'The doctor diagnosed with '||{_DX}||'.' end",
    "case when o_custkey%9=0 then 'This is a stroke and you need surgery.' when o_custkey%10=0 then 'I cannot help without the text.' else '' end",
    "'Take aspirin '||cast(75+o_custkey%25 as string)||' mg. You should take your medicine dose daily.'",
    "case when o_orderkey%6=0 then 'This is terminal. It is terminal.' else 'There was no fever.' end",
])


def reports(spark: SparkSession, d: str) -> DataFrame:
    """One sectioned report and rewrite per order: pair_id, original, simplified."""
    scan = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return spread(scan, "o_orderkey", always=True).select(F.col("o_orderkey").alias("pair_id"),
                                            F.expr(REPORT_ORIGINAL).alias("original"),
                                            F.expr(REPORT_SIMPLIFIED).alias("simplified"))


REPORTS_SQL = f"""reports as (select o_orderkey pair_id, {REPORT_ORIGINAL} as original,
 {REPORT_SIMPLIFIED} as simplified from orders)"""


# ----------------------------------------------------------------- dialogue pairs
def dialogue(spark: SparkSession, d: str) -> DataFrame:
    """User turn -> next assistant turn."""
    c = spread(table(spark, d, "conversations"), "conv_id")
    nxt = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                F.col("text").alias("simplified"))
    return c.filter("role = 'user'").join(nxt, ["conv_id", "turn"]).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("pair_id"),
        F.col("text").alias("original"), "simplified")


DIALOGUE_SQL = """dialogue as (select cast(u.conv_id as varchar)||'-'||cast(u.turn as varchar) pair_id,
 u.text original, a.text simplified from conversations u join conversations a
 on a.conv_id=u.conv_id and a.turn=u.turn+1 and a.role='assistant' where u.role='user')"""


# ------------------------------------------------------------- terminology rows
CONSO = """'C'||lpad(cast(cast(substr(p_brand,7) as int) as string),7,'0') as CUI,
 case when p_partkey%5=0 then 'SPA' else 'ENG' end as LAT, case when p_partkey%3=0 then 'P' else 'S' end as TS,
 case when p_partkey%2=0 then 'Y' else 'N' end as ISPREF, p_type as SAB, 'PT' as TTY, p_name as STR,
 case when p_partkey%7=0 then 'Y' else 'N' end as SUPPRESS, p_partkey as ord"""


def mrconso(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr(*[c.strip() for c in _split_cols(CONSO)])


def _split_cols(text: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in text:
        depth += ch == "("
        depth -= ch == ")"
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


STY = """'C'||lpad(cast(cast(substr(p_brand,7) as int) as string),7,'0') as CUI,
 'T'||lpad(cast(p_size%12+180 as string),3,'0') as TUI, p_type as STY, p_partkey as ord"""
DEF = """'C'||lpad(cast(cast(substr(p_brand,7) as int) as string),7,'0') as CUI,
 case when p_size%9=0 then '' else 'About '||p_type||' '||cast(p_size as string) end as DEF,
 case when p_partkey%6=0 then 'Y' else 'N' end as SUPPRESS, p_partkey as ord"""


def mrsty(spark: SparkSession, d: str) -> DataFrame:
    """One row per (concept, type): first part row carrying it."""
    rows = table(spark, d, "part").selectExpr(*[c.strip() for c in _split_cols(STY)])
    return rows.groupBy("CUI", "TUI").agg(F.min("ord").alias("ord"), F.min_by("STY", "ord").alias("STY"))


def mrdef(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr(*[c.strip() for c in _split_cols(DEF)])


CONSO_SQL = f"conso as (select {CONSO} from part)"
STY_SQL = f"sty0 as (select {STY} from part), sty as (select CUI, TUI, min(ord) ord, arg_min(STY, ord) STY from sty0 group by 1,2)"
DEF_SQL = f"def as (select {DEF} from part)"
SYN_SQL = ("syn as (select CUI cui, lower(STR) term_lower, arg_min(STR, ord) term, arg_min(TS='P' and ISPREF='Y', ord) is_preferred,"
           " arg_min(LAT, ord) language, arg_min(SAB, ord) source, arg_min(TTY, ord) term_type, min(ord) ord"
           " from conso where SUPPRESS<>'Y' group by 1,2)")


# -------------------------------------------------------------------- ops runs
RUNS = """event_type, value as latency_ms, cast(event_id%50 as int) as input_tokens, cast(event_id%30 as int) as output_tokens,
 cast(event_id%3 as int) as retry_count, cast(event_id%5 as int) as refinement_count, event_type<>'error' as first_pass_success"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(*[c.strip() for c in _split_cols(RUNS)])


RUNS_SQL = f"runs as (select {RUNS} from events)"
