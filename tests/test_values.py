"""Column expressions on handwritten rows."""

import pytest
from pyspark.sql import functions as F

from studyweave.functions import vocabulary as voc
from studyweave.functions.clinical import cohort_of, normalise_value, os_event
from studyweave.functions.text import is_recorded, number_or_null, prefix_real, trim_all


def apply(spark, values, expression, schema="v string"):
    rows = [(i, v) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, f"i int, {schema}")
    return [r[0] for r in frame.orderBy("i").select(expression).collect()]


def test_a_text_without_white_space_at_its_ends_is_not_searched(spark):
    texts = ["a", "ab", "a ", " a", "!~", "\u3000b", "b\u2029", "é", "aé", "éa", "a\u00a0b", "\x7f", "\x1fa"]
    searched = F.btrim(F.col("v"), F.lit(voc.WHITE_SPACE))
    assert apply(spark, texts, trim_all(F.col("v"))) == apply(spark, texts, searched)
    assert "CASE WHEN" in str(trim_all(F.col("v")))


def test_records_are_derived_in_generated_code(spark):
    from studyweave.sources import bridge

    plan = bridge.records(spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    assert "lambda" not in plan.optimizedPlan().toString()
    assert bridge.records(spark, "/root/testdata/sf0.001").filter("data_level IS NULL").count() == 0


def test_trim_takes_all_unicode_white_space(spark):
    texts = [" a ", "\ta b\n", " x　", "plain", "", None, "   "]
    assert apply(spark, texts, trim_all(F.col("v"))) == ["a", "a b", "x", "plain", "", None, ""]


def test_missing_codes_match_exactly(spark):
    texts = [*voc.MISSING_CODES, None, "na", "UnKnown", "[missing]", "0"]
    kept = apply(spark, texts, is_recorded(F.col("v")))
    assert kept == [False] * (len(voc.MISSING_CODES) + 1) + [True] * 4


@pytest.mark.parametrize(
    "concept, text, expected",
    [
        ("TUMOR_STAGE", "Stage IIA", "II"),
        ("TUMOR_STAGE", "2", "2"),
        ("TUMOR_STAGE", "STAGE IS", "I"),
        ("TUMOR_STAGE", "Stage X", None),
        ("TUMOR_STAGE", " STAGE IV ", "IV"),
        ("TUMOR_STAGE", "Stage IIIB", "III"),
        ("T_STAGE", "pT1a", "T1"),
        ("T_STAGE", "PT2N0", "T2"),
        ("T_STAGE", "TIS", None),
        ("N_STAGE", "pN3a", "N3"),
        ("N_STAGE", "N4", None),
        ("M_STAGE", "cM0 (i+)", "M0"),
        ("ER_STATUS", "Positive", "POSITIVE"),
        ("PR_STATUS", "+ve", "POSITIVE"),
        ("HER2_STATUS", "yes", "POSITIVE"),
        ("ER_STATUS", "Negative", "NEGATIVE"),
        ("ER_STATUS", "-", "NEGATIVE"),
        ("ER_STATUS", "NOT PERFORMED", "NEGATIVE"),
        ("ER_STATUS", "Indeterminate", None),
        ("SEX", "Female", "Female"),
        ("GRADE", "high", "high"),
    ],
)
def test_normalise_value(spark, concept, text, expected):
    assert apply(spark, [text], normalise_value(F.lit(concept), F.col("v"))) == [expected]


def test_prefix_real(spark):
    texts = ["12abc", "abc", " 3.5", None, "-.5x", "1e3", "1e", "7.", "+2", "NaN"]
    expected = [12.0, 0.0, 3.5, None, -0.5, 1000.0, 1.0, 7.0, 2.0, 0.0]
    assert apply(spark, texts, prefix_real(F.col("v"))) == expected


def test_number_or_null(spark):
    texts = ["3D", "2f", "NaN", " 12 ", "1e5", "T2", "", None, "-0.5"]
    expected = [None, None, None, 12.0, 1e5, None, None, None, -0.5]
    assert apply(spark, texts, number_or_null(F.col("v"))) == expected


def test_event_flag(spark):
    texts = ["1:DECEASED", "Deceased", "0:LIVING", "ALIVE", None]
    assert apply(spark, texts, os_event(F.col("v"))) == ["1", "1", "0", "0", None]


def test_cohort_label(spark):
    ids = ["brca_tcga_pub", "brca_metabric", "other_study", "x_brca_tcga"]
    assert apply(spark, ids, cohort_of(F.col("v"))) == ["TCGA", "METABRIC", "other_study", "x_brca_tcga"]


def test_fixed_lists_are_the_published_ones():
    """The SQL twins read these lists, too, so they are pinned here."""
    codes = ["", "NA", "N/A", "NaN", "Unknown", "unknown", "UNKNOWN", "[Not Available]", "[Unknown]", "[Not Applicable]"]
    codes += ["[Not Evaluated]", "[Discrepancy]", "[Pending]", "[Completed]", "[Redacted]", "[Missing]"]
    assert list(voc.MISSING_CODES) == codes
    assert list(voc.OUTCOME_ATTRS) == ["OS_STATUS", "OS_MONTHS"]
    pairs = [f"{kind}_{what}" for kind in ("OS", "DFS", "DSS", "PFS", "RFS") for what in ("STATUS", "MONTHS")]
    assert set(voc.ALL_OUTCOME_ATTRS) == {*pairs, "VITAL_STATUS"}
    concepts = ["AGE", "SEX", "TUMOR_STAGE", "T_STAGE", "N_STAGE", "M_STAGE", "GRADE", "TUMOR_SIZE", "ER_STATUS"]
    assert set(voc.PREDICTOR_CONCEPTS) == {*concepts, "PR_STATUS", "HER2_STATUS"}
    mapping = dict(voc.HARMONIZATION)
    for raw, concept in (("AGE_AT_DIAGNOSIS", "AGE"), ("ER_IHC", "ER_STATUS"), ("ER_STATUS_BY_IHC", "ER_STATUS"), ("PATH_T_STAGE", "T_STAGE")):
        assert mapping[raw] == concept


def test_harmonization_map_is_a_function(spark):
    assert len(voc.HARMONIZATION) == 29
    assert len(dict(voc.HARMONIZATION)) == 29
    assert len({concept for _, concept in voc.HARMONIZATION}) == 15
