"""Fixed values that results depend on: word lists, patterns, thresholds, formats."""

# --- fixed values: retrieval -------------------------------------------------

STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "do", "does", "did", "for",
    "from", "had", "has", "have", "he", "her", "him", "his", "how", "i", "if", "in", "is", "it",
    "its", "me", "my", "no", "not", "of", "on", "or", "our", "so", "than", "that", "the", "their",
    "them", "then", "there", "these", "they", "this", "to", "too", "us", "was", "we", "were",
    "what", "when", "where", "which", "who", "will", "with", "would", "you", "your", "yeah", "um",
    "uh", "mm", "hmm", "okay", "ok", "like", "just", "really", "know", "think", "thing", "things",
    "kind", "sort", "get", "got", "go", "going",
]

TIERS = ["absent", "contextual", "expanded", "lexical", "direct"]

CROSS_CUTTING = "CROSS_CUTTING"

RELATIONS = ["probe", "reverse", "context"]

STRENGTHS = ["direct", "indirect"]

NEGATION_CUES = ["not", "n't", "never", "nothing", "without", "rather", "instead"]

NEGATION_WINDOW = 4

HYPOTHETICAL = (
    r"\bwhat are you like\b|\bwhat would you\b|\bhow would you\b|"
    r"\bif you (?:were|didn't|weren't|would)\b|\bimagine\b"
)

FREQUENCY = (
    r"\b(never|not at all|rarely|occasionally|sometimes|often|usually|always|"
    r"constantly|every day|everyday|nearly every day|most days|more than half|"
    r"half the days|a few days|several days|couple of days|once a week|"
    r"twice a week|few times a week|\d+\s*(?:days?|times?|nights?|weeks?))\b"
)

AGE = r"\b(?:i'?m|i am)\s+(\d{1,2})\b|\b(\d{1,2})\s+years?\s+old\b"

# --- fixed values: rendered evidence -----------------------------------------

NO_EVIDENCE_TEXT = (
    "EVIDENCE: none.\n"
    "This topic was never raised anywhere in the interview. The participant neither "
    "reported nor denied this symptom."
)

RELATION_HEADERS = {
    "probe": "EVIDENCE — the participant was asked about this symptom:",
    "reverse": (
        "EVIDENCE (REVERSE POLARITY) — these questions asked about the OPPOSITE of "
        "this symptom. A specific, engaged answer is evidence AGAINST the symptom; a "
        "flat, vague or 'I can't think of anything' answer is evidence FOR it:"
    ),
    "context": (
        "BACKGROUND — general mood, diagnosis or treatment history. Not specific to "
        "this symptom and not sufficient on its own:"
    ),
}

BUNDLE_CONTEXT_TEXT = (
    "No direct disclosure found for this topic. Overall mood/history context from "
    "elsewhere in the interview:\n"
)

BUNDLE_EMPTY_TEXT = (
    "No direct disclosure found for this topic, and no general mood context "
    "available either."
)

# --- fixed values: replies ---------------------------------------------------

REASONING_TAGS = ["think", "thinking", "reasoning", "thought", "analysis"]

REASONING_HEADING = (
    r"^\s*[*#>\s]*(?:thinking|thought|reasoning|chain[ -]of[ -]thought)"
    r"(?:\s+process)?[*#\s]*:"
)

ANSWER_MARKER = (
    r"^\s*(?:[*#>\s]*)(?:final\s+answer|final\s+response|final\s+output|answer|"
    r"response|output|result|json)(?:[*#\s]*)\s*:"
)

HORIZONTAL_RULE = r"^\s*(?:-{3,}|={3,}|\*{3,})\s*$"

FENCE = r"^\s*```[a-zA-Z0-9_+-]*\s*$"

LABEL_LEAK = (
    r"\b(ground[\s-]?truth|reference score|gold (?:score|label)|true score|"
    r"phq[\s-]?8?[\s-]?(?:score|total)|correct answer|the label)\b"
)

POLARITIES = ["supports", "refutes", "uncertain"]

FREQUENCY_BASES = [
    "stated_days",
    "frequency_word",
    "ongoing_state",
    "single_episode",
    "none",
]

REASON_EMPTY = "empty response"

REASON_REASONING_ONLY = "reasoning-only response (likely truncated before the answer)"

REASON_NO_SCORE = "no score field found in response"

REASON_NO_NECESSITY = "no necessity rating found in response"

REASON_NO_UPDATES = "no JSON summary/updated_scores found in response"

REASON_NO_OBJECT = "no JSON object in reply"

CONTRADICTION_REASON = "a flat denial stands against a later report that it occurred"

# --- fixed values: scoring ---------------------------------------------------

DAY_BANDS = ["0-1 day", "2-6 days", "7-11 days", "12-14 days"]

COUNTERFACTUAL_UNSCORED = (
    "no evidence was found; a credible report of how often this occurred over the "
    "last two weeks would let this item be scored instead of abstained"
)

COUNTERFACTUAL_UP = ("evidence of ", " would raise the score to ")

COUNTERFACTUAL_DOWN = ("evidence of only ", " would lower the score to ")

#: A lesson as one sentence: what stands before trigger, action, avoidance and criterion.
RULE_TEXT = ("When ", ", ", " Avoid: ", " You will know it applied when ")

SEVERITY = [
    (4, "None / Minimal depression (0-4)"),
    (9, "Mild depression (5-9)"),
    (14, "Moderate depression (10-14)"),
    (19, "Moderately severe depression (15-19)"),
    (24, "Severe depression (20-24)"),
]

BIAS_BANDS = [(0, 4, "0-4"), (5, 9, "5-9"), (10, 14, "10-14"), (15, 24, "15-24")]

ITEM_MAX = 3

TOTAL_MAX = 24.0

UNFITTED_ITEM = 0.9

EXPERIENCE_WEIGHT = 0.25

REDUNDANCY_WEIGHT = 0.5

# --- fixed values: governance ------------------------------------------------

FORBIDDEN_LABEL_KEYS = [
    "label",
    "labels",
    "phq8_binary",
    "phq8_score",
    "real_interview",
    "scale_scores",
    "symptom_level",
]

RUNTIME_SENSITIVE_FIELDS = [
    "system_prompt",
    "user_prompt",
    "completion",
    "memory",
    "demographics",
]

PERMITTED_USES = {
    "evolve": ["collection", "hard_states", "branches", "pairs", "lesson_candidates"],
    "development": [
        "threshold_selection",
        "transfer_validation",
        "regression",
        "retrieval_index",
    ],
    "final-test": ["final_claim"],
    "external": ["final_claim"],
}

LIFECYCLE_MOVES = [
    ("candidate", "validated"),
    ("candidate", "rejected"),
    ("validated", "promoted"),
    ("promoted", "quarantined"),
    ("promoted", "retired"),
]

DECISION_ROLES = ["interviewer", "evaluator", "scorer", "updater"]

SCORE_REVISING_ROLES = ["updater"]

# --- fixed values: files ---------------------------------------------------------

SPEAKERS = ["Ellie", "Participant"]

MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

ITEM_COLUMNS = [
    "PHQ8_NoInterest",
    "PHQ8_Depressed",
    "PHQ8_Sleep",
    "PHQ8_Tired",
    "PHQ8_Appetite",
    "PHQ8_Failure",
    "PHQ8_Concentrating",
    "PHQ8_Moving",
]

ID_COLUMNS = ["Participant_ID", "participant_ID"]

LABEL_ALIASES = {"PHQ_Score": "PHQ8_Score", "PHQ_Binary": "PHQ8_Binary"}
