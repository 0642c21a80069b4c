"""Fixed values.

These must equal the values of the studied workflow for the same results: the label
order, the metadata columns dropped before training, the ambiguity type codes, the
experiment display names, the decision threshold and the NA tokens of a pandas CSV read.
They are stated here once, plainly, and imported everywhere else.
"""

from __future__ import annotations

# --- fixed values (label order matters: it is the order of every label list) ---
LABELS = [
    "compute",
    "data_handling",
    "network",
    "security_compliance",
    "management_monitoring",
    "cloud_service_essentials",
]

DROP_COLUMNS = ["source", "goal", "ambiguity_type", "ambuiguity", "comments"]

AMBIGUITY_TYPES = {
    1: "lexical",
    2: "syntactic",
    3: "semantic",
    4: "language_error",
    5: "pragmatic",
}

EXPERIMENT_DISPLAY_NAMES = {
    "baseline": "Benchmark all",
    "no_ambiguity": "No ambiguity",
    "no_lexical_ambiguity": "No lexical ambiguity",
    "no_syntactic_ambiguity": "No syntactic ambiguity",
    "no_semantic_ambiguity": "No semantic ambiguity",
    "no_language_error_ambiguity": "No language-error ambiguity",
    "no_pragmatic_ambiguity": "No pragmatic ambiguity",
}

THRESHOLD = 0.20

# pandas' default NA tokens of read_csv (19 values)
NA_TOKENS = [
    "", "NA", "N/A", "n/a", "NaN", "nan", "-NaN", "-nan", "null", "NULL",
    "None", "<NA>", "#N/A", "#NA", "#N/A N/A", "1.#IND", "1.#QNAN", "-1.#IND", "-1.#QNAN",
]

# number of points of the macro-average ROC grid (linspace(0, 1, 100))
ROC_GRID_POINTS = 100

# safe experiment names: runs of other characters become "_", these end characters are
# stripped, and an empty result becomes the fallback name
SAFE_NAME_OTHER_RUN = "[^A-Za-z0-9._-]+"
SAFE_NAME_STRIP_CHARS = "._-"
SAFE_NAME_FALLBACK = "experiment"
# --- end of fixed values ---

# Derived names (rules, not copied tables).
BASELINE = "baseline"
NO_AMBIGUITY = "no_ambiguity"


def type_subset_name(type_name: str) -> str:
    return f"no_{type_name}_ambiguity"


EXPERIMENTS = [BASELINE, NO_AMBIGUITY] + [type_subset_name(n) for n in AMBIGUITY_TYPES.values()]

# The dataset-size table names the unfiltered subset differently from the suite.
SIZE_TABLE_NAMES = {BASELINE: "benchmark_all"}

# Every character Python's str.strip()/str.split() treats as whitespace (29 code points),
# as a plain character set (for trim) and as a Java regex class (for runs inside a text).
WS_CODEPOINTS = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
                 *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WS_CHARS = "".join(map(chr, WS_CODEPOINTS))
WS_CLASS = "[" + "".join(f"\\x{{{c:x}}}" for c in WS_CODEPOINTS) + "]"

# Numbers pandas.to_numeric accepts (used by the lenient cast); group 1 is the number.
NUMBER_RE = "^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)\\s*\\z"
