"""Domain vocabularies and rule weights.

FIXED VALUES: the lists, maps and weights below must equal the behaviour being
reproduced (category names, their order, ordinal codes, the topic families of
each school and the additive scorecard weights). They are written out plainly, in
their natural order, and are the only hand-entered tables of the package.
"""

from __future__ import annotations

# ---- FIXED VALUES: category vocabularies (natural order) -------------------
DEPARTMENTS = [
    "School of Technology",
    "School of Design",
    "School of Business",
    "School of Music",
]
TOPICS = [
    "Data Science",
    "Machine Learning",
    "AI & Deep Learning",
    "Web Development",
    "Cybersecurity",
    "Cloud Computing",
    "UI/UX Design",
    "Career Guidance",
    "Entrepreneurship",
    "Digital Marketing",
    "Product Management",
    "Music Production",
    "Sound Design",
    "Creative Coding",
    "Design Thinking",
    "Branding & Identity",
]
SPEAKER_TYPES = ["Industry", "Alumni", "Faculty", "Student"]
TIME_SLOTS = ["Morning (9-11 AM)", "Afternoon (2-4 PM)", "Evening (5-7 PM)"]
DAY_ORDER = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MODES = ["Online", "Offline"]
LEVELS = ["Low", "Medium", "High"]  # promotion and club activity
REG_TIMINGS = ["Early", "On-time", "Late"]
EXAM_LABELS = {1: "Near", 2: "Moderate", 3: "Far"}

# ---- FIXED VALUES: ordinal codes (unknown -> null) --------------------------
TIMING_CODE = {"Early": 3, "On-time": 2, "Late": 1}
LEVEL_CODE = {"High": 3, "Medium": 2, "Low": 1}
MODE_CODE = {"Offline": 1, "Online": 0}

# ---- FIXED VALUES: topic family of each school ------------------------------
SCHOOL_TOPICS = {
    "School of Technology": [
        "Data Science",
        "Machine Learning",
        "AI & Deep Learning",
        "Web Development",
        "Cybersecurity",
        "Cloud Computing",
    ],
    "School of Design": ["UI/UX Design", "Design Thinking", "Branding & Identity", "Creative Coding"],
    "School of Business": ["Entrepreneurship", "Digital Marketing", "Product Management"],
    "School of Music": ["Music Production", "Sound Design"],
}

# ---- FIXED VALUES: additive scorecard, in integer hundredths ----------------
SCORE_BASE = 18
SCORE_MIN = 3
SCORE_MAX = 90
HOT_TOPICS = ["Data Science", "Machine Learning", "AI & Deep Learning"]
WARM_TOPICS = ["UI/UX Design", "Entrepreneurship", "Product Management"]
MILD_TOPICS = ["Creative Coding", "Career Guidance", "Design Thinking"]
COLD_TOPICS = ["Sound Design", "Branding & Identity", "Cybersecurity"]
CROSS_SCHOOL_TOPICS = ["Career Guidance", "Entrepreneurship"]
MIDWEEK_DAYS = ["Tuesday", "Wednesday", "Thursday"]
WEEKEND_DAYS = ["Saturday", "Sunday"]
CGPA_DEFAULT_WHEN_ABSENT = 7.0

# ---- FIXED VALUES: one-hot encoded nominal columns (order of encoding) ------
NOMINAL_COLUMNS = ["department", "topic", "speaker_type", "time_slot", "day_of_week"]

# ---- FIXED VALUES: columns never used as model features ---------------------
NON_FEATURE_COLUMNS = [
    "student_id",
    "event_id",
    "attended",
    "event_date",
    "department",
    "topic",
    "speaker_type",
    "day_of_week",
    "time_slot",
    "mode",
    "club_activity_level",
    "registration_timing",
    "promotion_level",
]

# ---- FIXED VALUES: training, threshold and retraining parameters ------------
SEED = 42
TEST_FRACTION = 0.2
N_FOLDS = 5
SMOTE_TRIGGER = 0.35
SMOTE_TARGET_CAP = 0.45
SMOTE_K = 5
THRESHOLD_START = 0.10
THRESHOLD_STOP = 0.60
THRESHOLD_STEP = 0.02
DEFAULT_THRESHOLD = 0.5
MIN_IMPROVEMENT = 0.01
MODEL_ORDER = ["xgboost", "random_forest", "logistic_regression"]
CONFIDENCE_HIGH = 0.3
CONFIDENCE_MEDIUM = 0.15
RETRAIN_MIN_NEW_EVENTS = 10
LOG_TAIL = 10
FIRST_FEATURES_SHOWN = 15
TOP_FEATURES = 15
TOP_CORRELATIONS = 10
