"""Rule packs as plain data.

Everything below is a FIXED VALUE: pattern texts, word lists, thresholds and
label tables that must hold exactly for results to be right.  Patterns are
written in portable regex syntax; ``rx.jrx`` adapts them to Java.
"""

# --------------------------------------------------------------- sections
SECTION_HEADERS = [
    r"^(CHIEF COMPLAINT|CC):",
    r"^(HISTORY OF PRESENT ILLNESS|HPI):",
    r"^(PAST MEDICAL HISTORY|PMH):",
    r"^(PHYSICAL EXAMINATION|PE|PHYSICAL EXAM):",
    r"^(ASSESSMENT|ASSESSMENT AND PLAN|A&P):",
    r"^(PLAN):",
    r"^(DIAGNOSIS):",
    r"^(MEDICATIONS):",
    r"^(LABORATORY|LABS):",
    r"^(IMAGING):",
]

# ---------------------------------------------------------------- numbers
NUMBER = r"\d+(?:\.\d+)?"
UNITS_FIRST = (
    r'mm|cm|m|kg|g|mg|mcg|μg|ml|mL|L|cc|mmHg|bpm|%|°[CF]|IU|units?|mEq|mmol|'
    r'mg/dL|g/dL|kg/m²|lb|oz|inches?|in|"'
)
# same units, longest alternative first and closed by a non-letter
UNITS_LONGEST = (
    r'(?:mg/dL|inches|kg/m²|units|mmHg|mmol|g/dL|inch|unit|mcg|bpm|mEq|mm|cm|kg|'
    r'mg|μg|ml|cc|IU|lb|oz|in|m|g|L)(?![A-Za-z])|°[CF]|%|"'
)
CONTEXT_CHARS = 30
BLOOD_PRESSURE = r"(\d{2,3})\s*/\s*(\d{2,3})(?:\s*mmHg)?"
# (pattern, extra flags)
DATE_PATTERNS = [
    (r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", ""),
    (r"\b\d{1,2}-\d{1,2}-\d{2,4}\b", ""),
    (r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2}", "i"),
    (r"\b\d{1,2}\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*", "i"),
]
IGNORE_PATTERNS = [
    (r"\b(?:19|20)\d{2}\b", ""),
    (r"\bpage\s*\d+", "i"),
    (r"\b\d+\s*(?:of|/)\s*\d+\s*$", "m"),
    (r"#\d+", ""),
    (r"\d{3}[-.]?\d{3}[-.]?\d{4}", ""),
    (r"\b\d{7,}\b", ""),
    (r"\bMRN[:\s]*\d+", "i"),
    (r"\d{1,2}:\d{2}(?:\s*(?:AM|PM))?", "i"),
]
MIN_SIGNIFICANT_VALUE = 3.0
LATERALITY_WORD = r"\b\w+(?:-\w+)?\.?\b"
LATERALITY_LEFT = ["left", "left-sided", "l."]
LATERALITY_RIGHT = ["right", "right-sided", "r."]
UNIT_MAP = {
    "cm3": "cc", "cm³": "cc", "microgram": "mcg", "μg": "mcg", "ug": "mcg",
    "inches": "in", '"': "in", "feet": "ft", "'": "ft",
}
ALLOWED_UNIT_CHANGES = [
    ("cm", "mm"), ("mm", "cm"), ("kg", "lb"), ("lb", "kg"), ("in", "cm"), ("cm", "in"),
]
NUMBER_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
    "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14",
    "fifteen": "15", "sixteen": "16", "seventeen": "17", "eighteen": "18",
    "nineteen": "19", "twenty": "20",
}

# ------------------------------------------------------------------ drugs
DRUG_PATTERNS = [
    r"\b\w+(?:mab|nib|zole|mycin|cillin|pril|sartan|statin|olol|dipine|pam|lam|zepam)\b",
    r"\b(?:aspirin|ibuprofen|acetaminophen|tylenol|advil|motrin)\b",
]

# ------------------------------------------------------- critical patterns
CRITICAL_PATTERNS = [
    r"\b(?:diagnosed with|diagnosis of|positive for|confirmed)\s+[\w\s]+",
    r"\b\d+\s*(?:mg|mcg|g|ml|units?)\b",
    r"\b\d+\.?\d*\s*(?:mg/dL|g/dL|mmol/L|mEq/L|U/L|IU/L|ng/mL|pg/mL)\b",
    r"\b(?:blood pressure|BP|heart rate|HR|temperature|temp|pulse|SpO2|oxygen)\s*:?\s*\d+",
    r"\b(?:left|right|bilateral)\s+[\w\s]+",
    r"\b\d+\.?\d*\s*(?:mm|cm|m|inches?|feet|kg|lbs?|pounds?)\b",
    r"\b[CTLS]\d+(?:-[CTLS]?\d+)?\b",
    r"\b\d+\.?\d*\s*%\b",
    r"\b\d+\s*(?:days?|weeks?|months?|years?)\b",
]
CRITICAL_TYPED = {
    "diagnosis": r"\b(?:diagnosed with|diagnosis of|positive for|confirmed)\s+[\w\s]+",
    "medication_dosage": r"\b\d+\s*(?:mg|mcg|g|ml|units?)\b",
    "lab_value": r"\b\d+\.?\d*\s*(?:mg/dL|g/dL|mmol/L|mEq/L|U/L|IU/L|ng/mL|pg/mL)\b",
    "vital_sign": r"\b(?:blood pressure|BP|heart rate|HR|temperature|temp|pulse|SpO2|oxygen)\s*:?\s*\d+",
    "laterality": r"\b(?:left|right|bilateral)\s+[\w\s]{2,20}",
    "measurement": r"\b\d+\.?\d*\s*(?:mm|cm|m|inches?|feet|kg|lbs?|pounds?)\b",
    "spinal_level": r"\b[CTLS]\d+(?:-[CTLS]?\d+)?\b",
    "percentage": r"\b\d+\.?\d*\s*%\b",
}
# corrected percentage rule: a percent sign needs no word character after it
CRITICAL_TYPED_CORRECTED = {**CRITICAL_TYPED, "percentage": r"\b\d+\.?\d*\s*%"}
DIAGNOSIS_PATTERNS = [
    r"\b(?:diagnosed with|diagnosis of|positive for|confirmed|impression:?)\s*[:\s]*([^\.]+)",
    r"\b(?:findings?:?)\s*[:\s]*([^\.]+)",
]
MEDICATION_PATTERNS = [
    r"\b(\d+\.?\d*)\s*(mg|mcg|g|ml|units?|tablets?|capsules?)\b",
    r"\b(aspirin|ibuprofen|acetaminophen|metformin|lisinopril|atorvastatin|omeprazole|amlodipine|metoprolol|losartan)\b",
]
MEASUREMENT_PATTERNS = [
    r"\b(\d+\.?\d*)\s*(mm|cm|m|kg|g|lbs?|pounds?|inches?|feet)\b",
    r"\b(\d+\.?\d*)\s*(mg/dL|g/dL|mmol/L|mEq/L|U/L|IU/L|ng/mL|pg/mL)\b",
    r"\b(\d+)\s*/\s*(\d+)\s*(?:mmHg)?\b",
    r"\b(\d+\.?\d*)\s*%\b",
    r"\b[CTLS]\d+(?:-[CTLS]?\d+)?\b",
    r"\b(\d+)\s*(?:bpm|beats per minute)\b",
]
COVERAGE_MEASUREMENTS = [
    r"(\d+\.?\d*)\s*(mm|cm|m|kg|g|mg|μg|ml|L|dL|mL|%|mmHg|bpm)",
    r"(\d+\.?\d*)\s*-\s*(\d+\.?\d*)\s*(mm|cm|m|kg|g|mg|μg|ml|L|dL|mL|%)",
    r"(\d+)\s*/\s*(\d+)",
    r"(\d+\.?\d*)\s*(U/L|mEq/L|mmol/L|mg/dL|g/dL)",
    r"\b(C|T|L|S)\d+-?\d*\b",
    r"(\d+)\s*(hours?|days?|weeks?|months?|years?)",
]
ITEM_NUMBER = r"\d+\.?\d*"
MEDICAL_TERM_PATTERNS = [
    r"\b\w+itis\b", r"\b\w+osis\b", r"\b\w+ectomy\b", r"\b\w+opathy\b",
    r"\b\w+emia\b", r"\b\w+oma\b", r"\b\w+scopy\b", r"\b\w+graphy\b",
    r"\b\d+\s*mm\b", r"\b\d+\s*cm\b", r"\b\d+\s*mg\b",
    r"\bC\d+-\d+\b", r"\bT\d+-\d+\b", r"\bL\d+-\d+\b",
]
COMMON_LONG_WORDS = [
    "the", "and", "that", "have", "for", "not", "with", "you", "this",
    "but", "his", "from", "they", "she", "which", "there", "been",
    "their", "said", "each", "about", "would", "your", "when", "will",
    "patient", "treatment", "medical", "condition", "hospital", "doctor",
]

# -------------------------------------------------------------- grounding
STOP_WORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "can", "must", "shall", "this", "that",
    "these", "those", "i", "you", "he", "she", "it", "we", "they",
]
CONTEXT_ALLOWLIST = [
    "procedure", "surgery", "operation", "treatment", "therapy",
    "reconstruction", "repair", "technique", "method", "incision",
    "chest", "body", "skin", "tissue", "bone", "sternum", "ribs",
    "breastbone", "nerves", "wall",
    "doctor", "surgeon", "hospital", "clinic", "patient",
    "recovery", "discomfort", "pain",
    "thoracoscopic", "minimally", "invasive", "cryotherapy",
    "pectus", "excavatum", "carinatum", "deformity", "deformities",
]
GROUNDING_PHRASES = [
    r"\b([a-z]+\s+(?:cancer|carcinoma|tumor|syndrome|disease|disorder|failure))\b",
    r"\b((?:acute|chronic|severe|mild)\s+[a-z]+)\b",
    r"\b([a-z]+\s+(?:infarction|embolism|thrombosis|hemorrhage))\b",
]
RISK_TERMS = [
    "cancer", "carcinoma", "malignant", "malignancy", "neoplasm",
    "metastasis", "metastatic", "metastases", "lymphoma", "leukemia",
    "sarcoma", "melanoma", "adenocarcinoma",
    "stroke", "cerebrovascular accident", "cva",
    "myocardial infarction", "heart attack", "mi",
    "pulmonary embolism", "pulmonary embolus",
    "deep vein thrombosis", "dvt",
    "aortic dissection", "ruptured aneurysm",
    "sepsis", "septic shock",
    "respiratory failure", "cardiac arrest",
    "brain death", "terminal",
]
RISK_SEMANTIC_TYPES = ["T191"]
MIN_TERM_LENGTH = 4

# --------------------------------------------------------- action sentences
# (cue regex without the sentence padding, category, severity)
ACTION_RULES = [
    (r"\b(go to|visit|call|contact|seek)\b[^.]*\b(er|emergency|hospital|doctor|911|care|attention|help)\b",
     "emergency_directive", "CRITICAL"),
    (r"\b(start|begin|take|stop|discontinue|prescribe)\b[^.]*\b(medication|medicine|drug|prescription|treatment|dose)\b",
     "medication_advice", "CRITICAL"),
    (r"\byou should\s+(start|begin|take|stop|continue)\b", "medication_advice", "HIGH"),
    (r"\b(this is|you have|diagnosed with|confirms?|consistent with)\b[^.]*\b(cancer|malignant|malignancy|tumor|carcinoma)\b",
     "diagnosis_claim", "CRITICAL"),
    (r"\b(this is|you have|confirms?)\b[^.]*\b(stroke|heart attack|infarction|embolism|aneurysm|thrombosis)\b",
     "diagnosis_claim", "CRITICAL"),
    (r"\b(urgent|urgently|emergency|immediately|life.threatening|critical condition)\b",
     "urgency_claim", "HIGH"),
    (r"\brequires?\s+(immediate|urgent|emergency)\b", "urgency_claim", "HIGH"),
    (r"\b(will|going to)\s+(die|survive|recover|spread|metastasize|worsen)\b",
     "prognosis_claim", "CRITICAL"),
    (r"\b(terminal|incurable|fatal|deadly|hopeless)\b", "prognosis_claim", "CRITICAL"),
    (r"\b(need|needs|require|requires|must have)\b[^.]*\b(surgery|chemotherapy|radiation|treatment|biopsy|procedure)\b",
     "treatment_recommendation", "HIGH"),
    (r"\bshould\s+(have|get|undergo|schedule|receive)\b[^.]*\b(surgery|chemotherapy|radiation|treatment|biopsy|procedure|scan)\b",
     "treatment_recommendation", "HIGH"),
    (r"\brecommend(s|ed|ation)?\b[^.]*\b(follow.?up|biopsy|surgery|treatment|evaluation|consultation)\b",
     "treatment_recommendation", "MEDIUM"),
]
PREMISE_STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been",
    "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "must", "to", "of", "in",
    "for", "on", "with", "at", "by", "from", "as", "this", "that",
    "it", "its", "or", "and", "but", "if", "so", "you", "your",
]
ENTAILMENT_THRESHOLD = 0.5
CONTRADICTION_THRESHOLD = 0.85
MIN_MATCH_SCORE_NLI = 0.25
MIN_MATCH_SCORE = 0.3

# --------------------------------------------------------------- evidence
# (pattern, flags) - group 1 is the quoted span
EVIDENCE_PATTERNS = [
    (r"\((?:Source|Evidence|Quote|Original):\s*[\"'](.+?)[\"']\)", "is"),
    (r"\[(?:Source|Evidence|Quote):\s*[\"'](.+?)[\"']\]", "is"),
    (r"^>\s*(.+?)$", "m"),
]
CLAIM_PATTERNS = [
    r"\bthe (?:report|scan|test|results?) (?:shows?|indicates?|reveals?|found)\b",
    r"\baccording to the (?:report|scan|results?)\b",
    r"\bdiagnosed with\b",
    r"\bmeasures?\s+\d",
]

# ---------------------------------------------------------- keyword checks
PLAIN_NUMBER = r"\d+[\d\-%]*"
NEGATION = r"\b(no|not|without|none|never|did not|does not)\b"
KEYWORD_METACHARS = r"[.\[\](){}^$*+?|\\]"

# --------------------------------------------------------------- meta talk
META_TALK_PATTERNS = [
    r"I need the.*text", r"please provide.*text", r"I cannot.*without",
    r"I don't have.*information", r"please share.*report",
    r"provide.*medical.*text", r"I'm unable to", r"I can't.*without",
    r"no (?:medical )?text (?:was )?provided", r"waiting for.*input",
    r"send me the.*text",
]
MIN_ORIGINAL_LENGTH = 20
MIN_SIMPLIFIED_LENGTH = 50

# ----------------------------------------------------------------- safety
SAFE_RECALL = 0.70
REVIEW_RECALL = 0.50

# ------------------------------------------------------------ terminology
MRCONSO_COLUMNS = ["CUI", "LAT", "TS", "LUI", "STT", "SUI", "ISPREF", "AUI", "SAUI", "SCUI",
                   "SDUI", "SAB", "TTY", "CODE", "STR", "SRL", "SUPPRESS", "CVF"]
MRDEF_COLUMNS = ["CUI", "AUI", "ATUI", "SATUI", "SAB", "DEF", "SUPPRESS", "CVF"]
MRSTY_COLUMNS = ["CUI", "TUI", "STN", "STY", "ATUI", "CVF"]
IMPORTANT_TYPES = ["T047", "T048", "T184", "T121", "T200", "T060", "T061", "T033", "T034",
                   "T191", "T046"]
WEIGHTED_TYPES = ["T047", "T048", "T184", "T121", "T200", "T060", "T061", "T033", "T034"]
WEIGHT_HIGH = 2.0
FALLBACK_SYNONYMS = [
    ["normal", "unremarkable", "within normal limits", "wnl", "negative", "benign", "no abnormality"],
    ["no", "without", "absent", "none", "no evidence of", "no sign of", "no signs of", "not seen",
     "not identified"],
    ["recommend", "recommends", "recommended", "recommendation", "advised", "advise", "suggest",
     "suggested"],
    ["bilateral", "bilaterally", "both", "both sides"],
    ["ct", "ct scan", "computed tomography", "cat scan"],
    ["doctor", "physician", "your doctor", "doctors"],
]
MIN_LOOKUP_SCORE = 5.0
CONCEPT_CAPS = {"critical": 15, "high": 10, "normal": 5}
SKIPPED_ENTITY_LABELS = ["ORG", "GPE", "PERSON", "PRODUCT"]
ENTITY_LABELS = {
    "DRUG": (["CHEMICAL", "DRUG"], ["DRUG", "CHEM"]),
    "DISEASE": (["DISEASE", "DISORDER", "FINDING"], ["DISEASE"]),
    "PROCEDURE": (["PROCEDURE", "TREATMENT"], ["PROCEDURE"]),
    "ANATOMY": (["ANATOMY", "BODY_PART", "ORGAN"], ["ANAT"]),
}

# ------------------------------------------------------------ proposition
EXACT_MATCH = 0.8
SEMANTIC_MATCH = 0.5
ALIGN_THRESHOLD = 0.3

# --------------------------------------------------------------- glossary
GLOSSARY_WORD = r"\b[A-Z]{2,}\b"
GLOSSARY_DOSE = r"\b\d+\s*(mg|ml|mcg|units?|IU|mEq)\b"
GLOSSARY_MAX_TERMS = 30
GLOSSARY_CATEGORIES = ["diagnosis", "test", "treatment", "anatomy"]
GLOSSARY_AFFIXES = [
    "itis", "osis", "emia", "oma", "pathy", "algia", "ectomy", "otomy",
    "scopy", "graphy", "gram", "logy", "phobia", "philia", "phage",
    "cyte", "blast", "gen", "genic", "trophy", "plasia",
    "hyper", "hypo", "dys", "mal", "pseudo", "neo", "meta", "para",
    "anti", "pre", "post", "sub", "super", "trans", "intra", "inter",
    "peri", "endo", "exo", "ecto", "epi",
]
DEFAULT_DEFINITION = "Definition not available"
MISSING_DEFINITION = "Medical term related to patient care."
DEFAULT_CATEGORY = "other"

# ---------------------------------------------------------------- reports
SEVERITY_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
ERROR_CODES = [
    "NUMERIC_MISMATCH", "NUMERIC_MISSING", "NUMERIC_ADDED", "UNIT_MISMATCH", "LATERALITY_FLIP",
    "EVIDENCE_NOT_FOUND", "CLAIM_WITHOUT_EVIDENCE",
    "UMLS_CUI_INTRODUCED", "UMLS_HIGH_RISK_TERM", "UMLS_PRECISION_LOW",
    "CONTRADICTION_DETECTED", "UNSAFE_RECOMMENDATION", "UNGROUNDED_ADVICE",
    "EMPTY_CONTENT", "META_TALK_DETECTED", "CONCEPT_MISSING", "CONCEPT_RECALL_LOW",
]
PREVIEW_CHARS = 500
MAX_PDF_BYTES = 10 * 1024 * 1024
MAX_TXT_BYTES = 1024 * 1024
