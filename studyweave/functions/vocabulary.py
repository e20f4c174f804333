"""Fixed values. Results depend on them, so they are stated as they are."""

# Placeholder texts that stand for "not recorded" (exact, case-sensitive).
MISSING_CODES = (
    "", "NA", "N/A", "NaN", "Unknown", "unknown", "UNKNOWN",
    "[Not Available]", "[Unknown]", "[Not Applicable]",
    "[Not Evaluated]", "[Discrepancy]", "[Pending]",
    "[Completed]", "[Redacted]", "[Missing]",
)

# Recorded attribute id, shared concept id.
HARMONIZATION = (
    ("AGE", "AGE"),
    ("AGE_AT_DIAGNOSIS", "AGE"),
    ("SEX", "SEX"),
    ("AJCC_PATHOLOGIC_TUMOR_STAGE", "TUMOR_STAGE"),
    ("TUMOR_STAGE", "TUMOR_STAGE"),
    ("PRIM_STAGE_DX", "TUMOR_STAGE"),
    ("PATH_T_STAGE", "T_STAGE"),
    ("PRIM_T", "T_STAGE"),
    ("PATH_N_STAGE", "N_STAGE"),
    ("PRIM_N", "N_STAGE"),
    ("PATH_M_STAGE", "M_STAGE"),
    ("PRIM_M", "M_STAGE"),
    ("GRADE", "GRADE"),
    ("NEOPLASM_HISTOLOGIC_GRADE", "GRADE"),
    ("TUMOR_SIZE", "TUMOR_SIZE"),
    ("ER_STATUS", "ER_STATUS"),
    ("ER_IHC", "ER_STATUS"),
    ("ER_STATUS_BY_IHC", "ER_STATUS"),
    ("PRIM_ER", "ER_STATUS"),
    ("PR_STATUS", "PR_STATUS"),
    ("PR_STATUS_BY_IHC", "PR_STATUS"),
    ("PRIM_PR", "PR_STATUS"),
    ("HER2_STATUS", "HER2_STATUS"),
    ("IHC_HER2", "HER2_STATUS"),
    ("PRIM_HER2_INTERPRETATION", "HER2_STATUS"),
    ("MUTATION_COUNT", "MUTATION_COUNT"),
    ("FRACTION_GENOME_ALTERED", "FRACTION_GENOME_ALTERED"),
    ("OS_STATUS", "OS_STATUS"),
    ("OS_MONTHS", "OS_MONTHS"),
)

# Which studies belong to the disease.
STUDY_TAGS = ("brca", "breast")
STUDY_WORD = "breast"

# Study id pattern, cohort label; other studies are their own cohort.
COHORT_PATTERNS = (("^brca_tcga", "TCGA"), ("metabric", "METABRIC"))
REQUIRED_COHORTS = ("TCGA", "METABRIC")

# How recorded texts of a concept are read, after upper-casing.
STAGE_PREFIX = r"^STAGE\s*"
CONCEPT_PATTERNS = (
    ("TUMOR_STAGE", "^(IV|III|II|I|[0-4])"),
    ("T_STAGE", "T[0-4X]"),
    ("N_STAGE", "N[0-3X]"),
    ("M_STAGE", "M[01X]"),
)
RECEPTOR_CONCEPTS = ("ER_STATUS", "PR_STATUS", "HER2_STATUS")
POSITIVE_PATTERN = r"^POS|^\+|^YES"
NEGATIVE_PATTERN = r"^NEG|^-|^NO"

# Attribute groups.
OUTCOME_ATTRS = ("OS_STATUS", "OS_MONTHS")
ALL_OUTCOME_ATTRS = (
    "OS_STATUS", "OS_MONTHS", "DFS_STATUS", "DFS_MONTHS", "DSS_STATUS", "DSS_MONTHS",
    "PFS_STATUS", "PFS_MONTHS", "RFS_STATUS", "RFS_MONTHS", "VITAL_STATUS",
)
NUMERIC_ATTRS = (
    "AGE", "AGE_AT_DIAGNOSIS", "OS_MONTHS", "TUMOR_SIZE",
    "MUTATION_COUNT", "FRACTION_GENOME_ALTERED", "TMB_NONSYNONYMOUS",
)
PREDICTOR_CONCEPTS = (
    "AGE", "SEX", "TUMOR_STAGE", "T_STAGE", "N_STAGE",
    "M_STAGE", "GRADE", "TUMOR_SIZE",
    "ER_STATUS", "PR_STATUS", "HER2_STATUS",
)
VOCABULARY_ATTRS = (
    "TUMOR_STAGE", "GRADE", "NEOPLASM_HISTOLOGIC_GRADE",
    "ER_STATUS", "PR_STATUS", "HER2_STATUS", "ER_IHC",
)
SAMPLE_MEASURES = (("MUTATION_COUNT", "mutation_count"), ("FRACTION_GENOME_ALTERED", "fga"))

# Patterns of the probes over attribute ids, and of a recorded death.
CONCEPT_PROBE = "AGE|STAGE|_T$|_N$|_M$|GRADE|SIZE|ER|PR|HER2|RECEPT|NODE"
MAPPING_PROBE = "STAGE|GRADE|SIZE|^ER|^PR|HER2|NODE|AGE"
EVENT_PATTERN = "^1|DECEASED"

CANCER_TYPE = "Breast Cancer"

# Characters with the Unicode White_Space property.
WHITE_SPACE = "".join(
    chr(c)
    for c in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
