"""Dimension constants and tunables (M8).

The block marked FIXED VALUES holds literals that must equal the original
application's for results to agree; they are stated once, in their natural
order, and every operator reads them from here.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the original application's)
# ---------------------------------------------------------------------------
TOPICS = ["lists", "numpy", "built_in_functions", "functions", "data_types"]
DIFFICULTY_LEVELS = ["beginner", "intermediate", "advanced"]
DEFAULT_DIFFICULTY = "beginner"
LETTERS = ["A", "B", "C", "D"]
WEAK_THRESHOLD = 70  # percent; strictly below is weak
QUESTIONS_PER_TOPIC = 2
ANSWER_DEADLINE_SECONDS = 20
RECENT_LIMIT_DEFAULT = 10
RECENT_LIMIT_MIN = 1
RECENT_LIMIT_MAX = 50
TIMER_NORMAL_ABOVE = 10  # seconds left: > 10 normal, > 5 warning, else critical
TIMER_WARNING_ABOVE = 5
PREVIEW_CHARS = 60
SEED_HINT_MIN = 1000
SEED_HINT_MAX = 9999
MAX_PARSE_ATTEMPTS = 3
MAX_HTTP_TRIES = 3
RETRY_STATUS = 502
BAR_FULL = "█"
BAR_EMPTY = "░"
TIMEOUT_SYMBOL = "⏰"
STATUS_OK = "OK"
STATUS_WEAK = "WEAK"
BADGE_PERFECT = "🎉"
BADGE_OK = "✅"
BADGE_WARN = "⚠️"
ICON_CORRECT = "✅"
ICON_WRONG = "❌"
TIMER_CLASSES = ["timer-normal", "timer-warning", "timer-critical"]
BAND_MESSAGES = [
    "Perfect score! 🎉",
    "Great job! 🌟",
    "Good effort! Keep practicing.",
    "Keep studying — you'll get it!",
]
# errors of a generation request
ERROR_502 = "502 Bad Gateway (attempt "
ERROR_HTTP = "API error "
ERROR_EMPTY = "Empty response from API (attempt "
ERROR_UNREADABLE = "Unreadable response (attempt "
ERROR_PARSE = "JSON parse error (attempt "
HTTP_GIVEN_UP = "Failed after 3 attempts: "
GIVEN_UP = "Failed to generate valid question after 3 attempts: "
# messages of the reports
WEAK_MESSAGE = "📌 Weak topics (below 70%): "
NO_WEAK_MESSAGE = "🎉 No weak topics! Everything is above 70%."
LINE_OK = "OK ✅"
LINE_WEAK = "WEAK ⚠️"
PROGRESS_OK = "✅ OK"
PROGRESS_WEAK = "⚠️ Weak"
ANALYSIS_OK = "✅ OK"
ANALYSIS_WEAK = "⚠️  WEAK"
DIFFICULTY_SYMBOLS = {"beginner": "🟢", "intermediate": "🟡", "advanced": "🔴"}
DIFFICULTY_INSTRUCTIONS_LONG = {
    "beginner": (
        "Ask about basic syntax, definitions, or simple concepts.\n"
        "A student who just started learning Python should be able to answer this.\n"
        'Example: "What does the len() function return?" '
    ),
    "intermediate": (
        "Ask about applying concepts, combining features, or reading code.\n"
        "A student who has practiced Python for a few weeks should be able to answer this.\n"
        'Example: "What is the output of: [x**2 for x in range(5) if x > 2]?" '
    ),
    "advanced": (
        "Ask about edge cases, performance trade-offs, or tricky behavior.\n"
        "A student preparing for exams or interviews should be challenged by this.\n"
        'Example: "What happens when you modify a list while iterating over it with a for loop?" '
    ),
}
DIFFICULTY_INSTRUCTIONS_SHORT = {
    "beginner": "Ask about basic syntax, definitions, or simple concepts.",
    "intermediate": "Ask about applying concepts, combining features, or reading code.",
    "advanced": "Ask about edge cases, performance trade-offs, or tricky behavior.",
}
# prompt templates: {topic}, {difficulty}, {diff_instruction}, {seed_hint} are
# filled per request; doubled braces are literal braces
PROMPT_TEMPLATE = """Create one multiple-choice Python question for a data science student.
Topic: {topic}
Difficulty level: {difficulty}

{diff_instruction}

Reply with ONLY valid JSON, no other text, no markdown formatting,
in exactly this shape:

{{
  "question": "the question text",
  "options": {{
    "A": "option A text",
    "B": "option B text",
    "C": "option C text",
    "D": "option D text"
  }},
  "answer": "A",
  "explanation": "1-2 sentences explaining why the correct answer is right."
}}

The "answer" must be one of "A", "B", "C", or "D" — whichever option is correct.
The "explanation" should be clear and helpful for a student learning Python."""
PROMPT_TEMPLATE_SEEDED = """Create one multiple-choice Python question for a data science student.
Topic: {topic}
Difficulty level: {difficulty}

{diff_instruction}

IMPORTANT: Make this question DIFFERENT from typical ones about this topic.
Use this random seed as inspiration for variety: seed-{seed_hint}

Reply with ONLY valid JSON, no other text, no markdown formatting,
in exactly this shape:

{{
  "question": "the question text",
  "options": {{
    "A": "option A text",
    "B": "option B text",
    "C": "option C text",
    "D": "option D text"
  }},
  "answer": "A"
}}

The "answer" must be one of "A", "B", "C", or "D" — whichever option is correct."""
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class QuizConfig:
    """Tunables an operator may take instead of the module constants."""

    weak_threshold: int = WEAK_THRESHOLD
    questions_per_topic: int = QUESTIONS_PER_TOPIC
    deadline_seconds: int = ANSWER_DEADLINE_SECONDS
    seed: str = "quizlake"
    # hex digits of the md5 bucket used to give every bank question a dense
    # per-topic position without a window over a whole topic (operators/practice.py)
    position_bucket_digits: int = 4


DEFAULT_CONFIG = QuizConfig()
