"""Prompt wording and result labels.

Fixed values: answers are only comparable when every prompt is worded exactly
like this, and result tables only when they carry exactly these labels.
"""

SYSTEM = (
    "You are an expert in missing-value imputation for tabular data. "
    "Your task is to estimate one numeric target value from observed feature values. "
    "Use statistical consistency and feature relationships. "
    "Think silently and return only the final numeric answer."
)
RETRY_SYSTEM = (
    "You perform numeric imputation for tabular data. "
    "Return exactly one numeric value only."
)
LEGACY_SYSTEM = (
    "You are performing a missing value imputation task for tabular data. "
    "Given observed feature values, predict the missing target value. "
    "Return only the imputed value and no explanation."
)
LEGACY_SYSTEM_START = "you are performing a missing value imputation task for tabular data."
CURRENT_SYSTEM_PART = "expert in missing-value imputation for tabular data"

USER_OPENING = "Impute the missing target value for this record."
USER_CLOSING = (
    "Here are the output constraints:\n"
    "- Return exactly one number.\n"
    "- No words, no units, no commas, no explanation, no markdown.\n"
    "Imputed value:"
)
RETRY_CLOSING = "Strict output:\nOne number only. No text.\nAnswer:"
RETRY_TURN = "Return exactly one number. No words, no units, no explanation."

STATS_HEADING = "Target distribution summary (observed rows):"
STATS_ABSENT = "Target distribution summary: not there."
STATS_ORDER = ("min", "q1", "median", "q3", "max", "mean")
GUIDE_HEADING = "Target distribution guidance (observed rows):"
GUIDE_ABSENT = "Target distribution summary: unavailable."
GUIDE_LINES = (
    ("plausible minimum", "min"),
    ("typical center (not a default)", "median"),
    ("plausible maximum", "max"),
)

FEATURE_HEADING = "Observed feature values:"
HINT_HEADING = "Domain hints:"
MISSING = "MISSING"

RECORD_OPENING = (
    "You are an expert data analyst. I am providing one record from the {dataset} Dataset.\n"
    "Task: Use your knowledge of this specific dataset's statistical properties "
    "(feature ranges, class distributions, and correlations) to perform data imputation.\n"
    "Constraint: DO NOT execute Python code. DO NOT provide any conversational text. "
    "Do NOT return any NaN or ? value.\n"
    "\n"
    "The record below contains one missing target value. Impute it to be as consistent as "
    "possible with the original dataset.\n"
    "Target column: {target}"
)
RECORD_RULES = (
    "Critical anti-collapse rules:\n"
    "- Do not use a fixed default value across records.\n"
    "- Do not copy summary anchors (minimum / median / maximum) unless the features strongly "
    "justify it.\n"
    "- Two different records should usually produce different imputations."
)
RECORD_CLOSING = (
    "Output Format:\n"
    "Return exactly one numeric value for {target} as plain text.\n"
    "\n"
    "Strict Rules:\n"
    "1. Output must contain exactly one number.\n"
    "2. No explanations, no introductory text, no markdown.\n"
    "3. No units and no thousands separators.\n"
    "4. Do not echo the input features.\n"
    "5. The value must be record-specific, not a reused default anchor.\n"
    "Imputed value:"
)
RECORD_RETRY = (
    "\n"
    "\n"
    "CRITICAL OUTPUT VALIDATION:\n"
    "- Return one plain number only.\n"
    "- Do not output a sentence.\n"
    "- Do not output markdown.\n"
    "- Do not output multiple candidates.\n"
    "- Recompute from this record's features; do not reuse a default number.\n"
    "- Do not return the median or any summary anchor unless strictly implied by the features.\n"
)

MATRIX_PROMPT = """
    You are an expert data analyst. I am providing a subset of the {dataset} Dataset.
    Task: Use your knowledge of this specific dataset's statistical properties (feature ranges, class distributions, and correlations) to perform data imputation.
    Constraint: DO NOT execute Python code. DO NOT provide any conversational text. Do NOT return any NaN or ? value.

    The matrix below contains missing values. Impute them to be as consistent as possible with the original dataset.
    Matrix:
    {matrix}

    Output Format:
    Return the complete imputed matrix as plain CSV text (no markdown code block).
    Use comma-separated values with the original headers.
    Expected Columns ({n_columns}):
    [{header}]

    Strict Rules:
    1. First line must be exactly the CSV header with these columns.
    2. Return exactly {n_rows} data rows after the header.
    3. Every data row must have exactly {n_commas} commas.
    4. No explanations, no introductory text, no markdown.
    5. Do not add an index column.
    """
MATRIX_RETRY = (
    "\n"
    "\n"
    "CRITICAL OUTPUT VALIDATION:\n"
    "- Return plain CSV only (no markdown code block).\n"
    "- The CSV must contain exactly {n_columns} columns.\n"
    "- The CSV must contain exactly {n_rows} data rows.\n"
    "- Do not return markdown tables using pipes.\n"
    "- Do not return explanations.\n"
)

FIRST_TRY, RETRY = "model_first_try", "model_retry"
RECORD_FIRST_TRY, RECORD_RETRIED = "paper_single_prompt", "paper_single_prompt_retry"
MATRIX_SOURCE, MATRIX_FOLD_SOURCE = "paper_prompt", "paper_prompt_fold"
# Sources of an answer that the model gave when it was first asked.
FIRST_ANSWERS = (FIRST_TRY, RECORD_FIRST_TRY, MATRIX_SOURCE, MATRIX_FOLD_SOURCE)
TRAIN_MEDIAN_SOURCE = "fallback_train_median"
