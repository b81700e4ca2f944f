"""Fixed values that decide results. They are parameters' defaults, not logic."""

# Romanised Hindi words that mark a post as code-mixed.
CODE_MIX_TOKENS = (
    "kya", "hai", "nahi", "nahin", "hain", "tha", "thi", "the",
    "mera", "meri", "tera", "teri", "tumhara", "apna", "apni",
    "yaar", "bhai", "bhen", "behan", "dost", "log", "sab",
    "bahut", "zyada", "thoda", "acha", "achha", "accha", "theek",
    "bilkul", "sahi", "galat", "bekaar", "bakwaas",
    "karo", "karna", "karein", "karte", "kar",
    "aao", "jao", "agar", "toh", "tou", "aur", "par", "lekin",
    "kyunki", "isliye", "phir", "fir",
    "bohot", "bohat", "kaafi",
    "isko", "usko", "inko", "unko", "mujhe", "tumhe", "use",
    "desh", "bharat", "india", "hindustan",
    "gali", "gaali", "maa", "baap",
)

# Code point ranges treated as emoji, as hexadecimal (first, last).
EMOJI_RANGES = (
    ("1F1E0", "1F1FF"), ("1F300", "1F5FF"), ("1F600", "1F64F"),
    ("1F680", "1F8FF"), ("2600", "27BF"),
)

# Strings the usual pandas CSV reader turns into missing values.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Label names that count as hateful, lower case.
POSITIVE_LABELS = ("hate", "offensive", "1", "abusive", "hateful")

# Label codes of the second source.
HS_CODES = {"HS0": 0, "HS1": 1, "HSN": 1}

# The eleven sweep thresholds, as the doubles a 0.25..0.75 float
# range in steps of 0.05 produces (some differ from the two-digit decimal).
SWEEP_THRESHOLDS = (
    0.25, 0.3, 0.35, 0.39999999999999997, 0.44999999999999996,
    0.49999999999999994, 0.5499999999999999, 0.5999999999999999,
    0.6499999999999999, 0.7, 0.7499999999999999,
)

# Severity bands (lower bound, name), and moderation routes.
SEVERITY_BANDS = ((80, "extreme"), (51, "likely"), (21, "mild"), (0, "safe"))
MODERATION_ROUTES = (
    (81, "auto_remove"), (50, "human_review"), (20, "log"), (0, "none"),
)

# Display labels and the "prediction confirmed" answer.
HATE, NON_HATE = "HATE", "NON-HATE"
MODEL_IS_CORRECT = "Model is correct ✓"
CONTEXT_SEPARATOR = " [CTX] "
