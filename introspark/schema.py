"""Constants that must agree with the published file formats."""

from __future__ import annotations

# --- fixed values: parent-of-origin states --------------------------------------------------------
STATE_A, STATE_H, STATE_B, STATE_X, STATE_N, STATE_U = range(6)
STATE_LABELS = ("A", "H", "B", "X", "N", "U")

# --- fixed values: roles, missing tokens ----------------------------------------------------------
SAMPLE_ROLES = ("recurrent_parent", "donor_parent", "candidate", "progeny")
PROGENY_ROLES = ("progeny", "candidate")
PARENT_ROLES = ("recurrent_parent", "donor_parent")
NUCLEOTIDE_MISSING = ("", "N", "NN", "NA", "-", "--", ".", "./.", ".|.")
HAPMAP_EXTRA_MISSING = ("X", "XX")
CODED_MISSING = ("", "N", "NA")

# --- fixed values: quality-control flags ----------------------------------------------------------
EXCLUDING_FLAGS = ("possible_self_or_outcross", "possible_outcross", "possible_rp_sample", "possible_donor_sample")
DUPLICATE_IBS = 0.995
DUPLICATE_OVERLAP_FRACTION = 0.5
SIBLING_MIN_BACKCROSS = 6
OUTLIER_MIN_MEMBERS = 6
OUTLIER_MIN_SCALE = 0.01
OUTLIER_Z = 2.5
MAD_TO_SIGMA = 1.4826

# --- fixed values: marker coverage caps of the weighted background model ----------------------------
DEFAULT_COVERAGE = {"cm": 10.0, "bp": 2_000_000.0}

# --- fixed values: results table ------------------------------------------------------------------
RESULTS_SCHEMA = "1.2.0"
RESULT_PREFIX = (
    "rank_overall", "rank_in_family", "sample_id", "line_name", "family_id", "generation", "passes_filters",
    "exclusion_reason", "composite_score", "foreground_all_pass", "avoid_all_pass", "rpp_total", "rpp_carrier",
    "rpp_noncarrier", "expected_rpp", "drag_total_est", "drag_total_max", "drag_unit", "ibs_rp", "ibs_donor",
    "missing_rate", "het_rate", "expected_het", "qc_flags", "role", "n_informative_called", "frac_a", "frac_h",
    "frac_b", "background_model", "background_unit", "rank_mode", "assembly", "results_schema", "crop",
    "call_set_db_id", "sample_db_id", "background_max_marker_coverage", "tool", "tool_version", "tool_commit",
)
RESULT_LAST = "token_profile"
SELECTION_COLUMNS = (
    "sample_id", "line_name", "family_id", "generation", "rank_overall", "rank_in_family", "composite_score",
    "rpp_total", "notes", "results_schema", "crop", "call_set_db_id", "sample_db_id", "tool", "tool_version",
    "tool_commit", "token_profile",
)
MANIFEST_COLUMNS = ("sample_id", "line_name", "role", "generation", "family_id", "notes")
CALL_SET_COLUMNS = ("sample_id", "call_set_name", "call_set_db_id", "sample_db_id")
NUMERIC_RESULT_COLUMNS = (
    "rank_overall", "rank_in_family", "composite_score", "rpp_total", "frac_a", "frac_h", "frac_b",
)

TOOL_NAME = "introspark"

# --- fixed values: soybean reference lengths (bp), chromosomes Gm01..Gm20 in order -------------------
SOYBEAN_LENGTHS = {
    "Wm82.a1": (
        55915596, 51656714, 47781077, 49243853, 41936505, 50722822, 44683158, 46995533, 46843751, 50969636,
        39172791, 40113141, 44408972, 49711205, 50939161, 37397386, 41906775, 62308141, 50589442, 46773168,
    ),
    "Wm82.a2": (
        56831625, 48577506, 45779782, 52389147, 42234499, 51416487, 44630647, 47837941, 50189765, 51566899,
        34766868, 40091315, 45874163, 49042193, 51756344, 37887015, 41641367, 58018743, 50746917, 47904182,
    ),
    "Wm82.a4": (
        57932356, 50400359, 46951867, 51203390, 42274531, 50945865, 44949257, 47227185, 50572669, 51638688,
        39643746, 41531200, 45225049, 49893279, 53754296, 38112071, 41740657, 58286271, 51272881, 47846027,
    ),
}
DEFAULT_ASSEMBLY = "Wm82.a4"
