"""Employer names and job titles as column expressions.

Everything runs in the JVM but Unicode compatibility normalisation, for which
Spark has no function: a vectorised UDF sees only the values that need it, and
only where ``unicode`` is asked for.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Legal suffixes, quotes, aliases, the seniority ladder, and the ordered rules of both taxonomies.
LEGAL_SUFFIXES = r"inc|inc\.|llc|l\.l\.c\.|ltd|ltd\.|limited|corp|corp\.|corporation|co|co\.|plc|gmbh|s\.a\.|sa|ag|bv|nv|pty|llp|lp|pc|pllc"
QUOTES = "‘’“”`'\""
ALIASES = {
    "ibm corporation": "IBM",
    "international business machines": "IBM",
    "alphabet": "Google",
    "meta platforms": "Meta",
    "facebook": "Meta",
    "microsoft corporation": "Microsoft",
    "amazon web services": "Amazon",
    "aws": "Amazon",
    "jp morgan chase": "JPMorgan Chase",
    "jpmorgan": "JPMorgan Chase",
    "deloitte consulting": "Deloitte",
    "ey": "EY",
    "ernst & young": "EY",
    "pwc": "PwC",
    "pricewaterhousecoopers": "PwC",
    "kpmg llp": "KPMG",
    "self employed": "Self-Employed",
    "self-employed": "Self-Employed",
    "freelance": "Self-Employed",
    "independent": "Self-Employed",
    "n/a": "",
    "none": "",
    "-": "",
}
LADDER = ["unknown", "student", "individual_contributor", "senior", "staff_principal", "manager", "director", "executive", "founder_owner"]
LEADERSHIP = ["manager", "director", "executive", "founder_owner"]
#: Whole words, first rule that fits.
SENIORITY_RULES = [
    ("founder_owner", r"founder|co-?founder|owner|proprietor|managing partner|partner"),
    ("executive", r"chief|c[etofimdpr]o\b|cxo|president|vice president|vp|svp|evp|avp|head of|global head|general manager|gm|board member|managing director"),
    ("director", r"director|dir\.|sr\.? director|senior director|dean|chair"),
    ("manager", r"manager|mgr|supervisor|team lead|team leader|foreman|superintendent"),
    ("staff_principal", r"principal|staff|distinguished|fellow|architect|lead|master"),
    ("senior", r"senior|sr\.?|sme|specialist iii|iii"),
    ("student", r"student|intern|trainee|apprentice|resident|fellowship|candidate|phd"),
    (
        "individual_contributor",
        r"engineer|developer|analyst|scientist|designer|consultant|associate|coordinator|administrator|technician|nurse|rn|representative|assistant|officer|advisor|agent|clerk|writer|"
        r"recruiter|accountant|attorney|pharmacist|therapist|teacher|controller|counsel|specialist|paralegal|professor|instructor|manager i\b",
    ),
]
#: Beginnings of words, first rule that fits.
FUNCTION_RULES = [
    ("data_ai", r"data scien|machine learning|ml engineer|ai\b|artificial intelligence|data engineer|analytics|statistic|biostat|nlp|mlops|data analyst|business intelligence|bi developer|research scientist"),
    ("engineering", r"software|engineer|engineering|developer|development|devops|sre|programmer|architect|infrastructure|platform|cloud|security|cyber|qa|full.?stack|backend|frontend|systems"),
    ("product", r"product manager|product owner|product lead|cpo|product manage|program manager|technical program|scrum|agile coach"),
    ("design", r"design|ux|ui|user experience|creative|brand|illustrat|architect of record"),
    ("healthcare", r"nurse|nursing|rn\b|bsn|physician|doctor|md\b|clinical|pharmac|patient|health|medical|surgeon|therap|radiolog|care team|epic analyst"),
    ("sales", r"sales|account executive|account manager|business development|bdr|sdr|revenue|partnership|customer success|client"),
    ("marketing", r"marketing|growth|seo|content|communications|brand manager|demand gen|social media|public relations|pr manager"),
    ("finance", r"financ|account|audit|controller|treasur|investment|equity|banking|actuar|tax|cfo|fp&a"),
    ("people_ops", r"human resources|hr\b|recruit|talent|people ops|people operations|chro|benefits|compensation|learning and development|l&d"),
    ("legal", r"legal|attorney|counsel|paralegal|compliance|contract|privacy officer|regulatory"),
    ("operations", r"operations|supply chain|logistics|procurement|manufactur|quality|facilities|project manager|coo\b"),
    ("education_research", r"professor|lecturer|teacher|instructor|research|faculty|academic|postdoc|dean|principal investigator"),
    ("executive_general", r"chief executive|ceo|president|owner|founder|general manager"),
]
TITLE_STOP_WORDS = "the and for of at in to with a an on by from is are as senior sr jr ii iii new global north south east west world group team dept department".split()
TITLE_TOKEN = "[a-z][a-z+#.]{2,}"

_STRIP = " \t,-–—"


def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def nfkc(c: Column) -> Column:
    """Compatibility normalisation; plain ASCII never leaves the JVM's value."""
    return F.coalesce(F.pandas_udf(_nfkc, StringType())(F.when(c.rlike(r"[^\x00-\x7f]"), c)), c)


def _collapsed(c: Column, strip: str) -> Column:
    c = F.translate(c, QUOTES, "")
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "), F.lit(strip))


def canonical_company(raw: Column, unicode: bool = True) -> Column:
    """One name for the trivial spelling variants of an employer; ``''`` where there is none."""
    s = F.coalesce(raw, F.lit(""))
    s = _collapsed(nfkc(s) if unicode else s, _STRIP)
    s = F.regexp_replace(s, r"(?U)\s*\([^)]*\)\s*$", "")
    for _ in range(2):
        s = F.btrim(F.regexp_replace(s, rf"(?iU)[,\s]+(?:{LEGAL_SUFFIXES})\s*$", ""), F.lit(" ,"))
    alias = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    shouted = (F.upper(s) == s) & (F.lower(s) != s) & (F.length(s) > 4) & s.contains(" ")
    words = F.transform(F.regexp_extract_all(s, F.lit(r"(\p{L}+|\P{L}+)"), 1), lambda w: F.initcap(w))
    return F.coalesce(F.try_element_at(alias, F.lower(s)), F.when(shouted, F.array_join(words, "")).otherwise(s))


def clean_title(raw: Column, unicode: bool = True) -> Column:
    s = F.coalesce(raw, F.lit(""))
    return _collapsed(nfkc(s) if unicode else s, _STRIP + "|")


def seniority(title: Column) -> Column:
    t, out = F.lower(title), F.lit("unknown")
    for label, words in reversed(SENIORITY_RULES):
        out = F.when(t.rlike(rf"\b({words})\b"), label).otherwise(out)
    return out


def seniority_rank(label: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(x) for x in LADDER]), label) - 1).cast("int")


def job_function(title: Column) -> Column:
    out = F.lit("unclassified")
    for label, words in reversed(FUNCTION_RULES):
        out = F.when(title.rlike(rf"(?i)\b({words})"), label).otherwise(out)
    return out


def title_tokens(title: Column) -> Column:
    """The words of a title that say something about it, repeats kept."""
    found = F.regexp_extract_all(F.lower(title), F.lit(f"({TITLE_TOKEN})"), 1)
    stop = F.array(*[F.lit(w) for w in TITLE_STOP_WORDS])
    return F.filter(found, lambda w: ~F.array_contains(stop, w))


def initials(first: Column, last: Column) -> Column:
    one = lambda c: F.coalesce(F.upper(F.nullif(F.left(F.btrim(c), F.lit(1)), F.lit(""))), F.lit("?"))
    return F.concat(one(first), F.lit("."), one(last), F.lit("."))


def matches(term: str, *columns: Column) -> Column:
    """Whether a search term of two letters or more occurs in any of the columns."""
    term = term.strip().lower()
    if len(term) < 2:
        return F.lit(False)
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(term))
